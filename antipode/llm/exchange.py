"""Compressed fingerprint exchange between the partitions of a staged table and the owners of hash ranges.

A *sender* (a scan partition, see ``common.stage``) sorts the distinct 48-bit fingerprints of its rows, cuts
them at the owners' range bounds and Golomb-codes the gaps. Each owner meets, for its range, every
sender's list, and answers each sender with one value per fingerprint in the order sent. Text never moves;
what moves is about 48 - log2(fingerprints a sender) + 2 bits per distinct fingerprint and sender, however
many rows hold it. An owner's work is bounded by its range; ``owners`` grows with the number of shuffle
partitions.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed

BITS = 48
MESSAGE = "sender int, owner int, n int, k int, first long, quotients binary, remainders binary, counts binary"
REPLY = "sender int, owner int, values binary"


def golomb_encode(values: np.ndarray) -> tuple[int, int, bytes, bytes]:
    """Sorted distinct uint64 -> (k, first, quotients, remainders). Gaps are cut in a unary quotient and k low bits."""
    gaps = np.diff(values)
    mean = float(values[-1] - values[0]) / max(1, len(gaps))
    k = max(0, int(np.log2(max(1.0, mean * np.log(2)))))
    ends = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 1
    low = gaps & np.uint64((1 << k) - 1)
    bits = ((low[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return k, int(values[0]), np.packbits(unary).tobytes(), np.packbits(bits.ravel()).tobytes()


def golomb_decode(n: int, k: int, first: int, quotients: bytes, remainders: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(quotients, np.uint8)))[: n - 1]
    high = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    bits = np.unpackbits(np.frombuffer(remainders, np.uint8))[: (n - 1) * k].reshape(n - 1, k)
    low = (bits.astype(np.uint64) << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.concatenate([[np.uint64(first)], np.uint64(first) + np.cumsum(high + low, dtype=np.uint64)]).astype(np.uint64)


def owner_bounds(owners: int) -> np.ndarray:
    """The first fingerprint of each owner's range."""
    return np.array([(o << BITS) // owners for o in range(owners)], np.uint64)


def small(counts: np.ndarray) -> np.ndarray:
    """Counts in a byte each: exact below 128, then 121 + log2, rounded down."""
    large = 121 + np.log2(np.maximum(counts, 1)).astype(np.int64)
    return np.where(counts < 128, counts, large).astype(np.uint8)


def large(codes: np.ndarray) -> np.ndarray:
    return np.where(codes < 128, codes, np.int64(1) << np.maximum(codes.astype(np.int64) - 121, 0))


def message_rows(sender: int, fingerprints: np.ndarray, owners: int) -> list[tuple]:
    """A sender's messages: its distinct fingerprints with the number of its rows that hold each (a byte each: from 128 on
    rounded down to a power of two). Sorts fingerprints in place and goes owner by owner, to spare memory."""
    fingerprints.sort()
    cuts = [*np.searchsorted(fingerprints, owner_bounds(owners)).tolist(), len(fingerprints)]
    out = []
    for owner, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if a < b:
            own = fingerprints[a:b]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            k, base, q, r = golomb_encode(own[first])
            out.append((sender, owner, len(first), k, base, q, r, zlib.compress(small(np.diff(np.append(first, b - a))).tobytes(), 1)))
    return out


def message_table(rows: list[tuple]):
    import pyarrow as pa

    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [[]] * 8
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in MESSAGE.split(", ")])


def answer(messages: DataFrame, owners: int) -> DataFrame:
    """REPLY rows: for each fingerprint of a message, its level: twice the log2, rounded down, of the rows that hold it,
    over all senders (0: one row only). A fingerprint that several keys share counts their rows together, which can
    only make it look more frequent. Each owner is a partition, however small the messages are."""

    def owned(table):
        import pyarrow as pa

        m = table.to_pydict()
        # Sorted, equal fingerprints stand together, and their counts are summed.
        told = np.concatenate([golomb_decode(*x) for x in zip(m["n"], m["k"], m["first"], m["quotients"], m["remainders"], strict=True)])
        counts = large(np.concatenate([np.frombuffer(zlib.decompress(c), np.uint8) for c in m["counts"]]))
        order = np.argsort(told, kind="stable")
        told = told[order]
        first = np.flatnonzero(np.concatenate([[True], told[1:] != told[:-1]]))
        del told
        total = np.minimum(2 * np.log2(np.add.reduceat(counts[order], first)), 254).astype(np.uint8)
        level = np.empty(len(order), np.uint8)
        level[order] = np.repeat(total, np.diff(np.append(first, len(order))))
        cuts = np.cumsum([0, *m["n"]])
        values = [zlib.compress(level[a:b].tobytes(), 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return trimmed(pa.table([table["sender"], table["owner"], pa.array(values, pa.binary())], ["sender", "owner", "values"]))

    return messages.repartition(owners, "owner").groupBy("owner").applyInArrow(owned, REPLY)


def read_answers(owners_values: list[tuple[int, bytes]]) -> np.ndarray:
    """A sender's answers in the order of its sorted fingerprints."""
    parts = [np.frombuffer(zlib.decompress(v), np.uint8) for _, v in sorted(owners_values)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8)


def levels_of(hashes: np.ndarray, answers: np.ndarray) -> np.ndarray:
    """The answer for each 64-bit hash, from the answers for the sorted distinct fingerprints. Goes by sixteenths of the
    hash range, so that temporaries stay small."""
    out, done = np.zeros(len(hashes), np.uint8), 0
    part_of = (hashes >> np.uint64(60)).astype(np.uint8)
    for part in range(16):
        at = np.flatnonzero(part_of == part)
        found, where = np.unique(hashes[at] >> np.uint64(64 - BITS), return_inverse=True)
        out[at] = answers[done : done + len(found)][where]
        done += len(found)
    return out


def bit(bitmap, position):
    """Is the bit at an int position of a binary column set? (numpy's packbits order)"""
    byte = F.conv(F.hex(F.substr(bitmap, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.pmod(F.floor(byte / F.pow(F.lit(2), F.lit(7) - position % 8)), F.lit(2)) == 1
