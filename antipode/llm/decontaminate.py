"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts are lower-cased and white space is folded to single spaces. If an item of m characters occurs in a
document with at most k edits, then at least m - q + 1 - k q of its q-grams occur there too, on diagonals
(place in the document minus place in the item) that lie within k of each other. So for each document and
item, shared q-grams are counted in bands of 2 (k + 1) diagonals that overlap by half; bands that reach the
bound are kept, and banded alignment of the item with the kept region decides. An item's edit budget k is
``error_rate`` of its length, less where the bound would not be above 0; items shorter than q match exactly.

Every document is read once and judged by itself: nothing is shuffled, and memory is bounded by a block of
documents (or one document), a block of items and ``ENTRIES`` shared q-grams. The items are sent to all tasks in
blocks of at most ``ITEM_BYTES`` of text, one pass over the documents for each block, so no broadcast grows with
them. Items shorter than q are looked up by length in hash tables of their own.

Nulls: null or empty document text holds nothing; null or empty items are not looked for; null ids are
kept. Repeated rows are reported each. Empty tables: no matches. Extra columns are carried by ``clean``
whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cache

Q = 10
ITEM_BYTES = 4 << 20
#: Shared q-grams (place in a document, place in an item) that are counted at once.
ENTRIES = 1 << 21
#: Characters of documents that are searched at once.
BLOCK_CHARS = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q characters from each place on."""
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = points.astype(np.uint64) + np.uint64(1)
    out = np.zeros(n, np.uint64)
    for k in range(q):
        out *= _MULTIPLIER
        out += wide[k : k + n]
    out ^= out >> np.uint64(29)
    out *= _MULTIPLIER
    return out


class Items:
    """The items' q-grams: a bit table to pass most places by, then sorted grams with the places they occur in."""

    def __init__(self, items: list[tuple], q: int, error_rate: float):
        self.q = q
        self.ids = [i for i, _ in items]
        self.points = [code_points(normal(t)) for _, t in items]
        size = np.array([len(p) for p in self.points], np.int64)
        self.size = size
        self.budget = np.maximum(0, np.minimum((size * error_rate).astype(np.int64), (size - q) // q))
        self.bound = size - q + 1 - self.budget * q
        self.short = {}  # by length: the items' hashes, sorted, and their numbers
        for n in range(1, q):
            own = np.flatnonzero(size == n)
            if len(own):
                hashes = np.concatenate([gram_hashes(self.points[k], n) for k in own])
                order = np.argsort(hashes, kind="stable")
                self.short[n] = hashes[order], own[order]
        grams = [gram_hashes(p, q) for p in self.points]
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.grams, self.first, self.many = np.unique(flat[order], return_index=True, return_counts=True)
        self.owner, self.place = owner[order], place[order].astype(np.int64)
        # Gram and item in one number, sorted: where a gram's entries of a range of items stand.
        self.keyed = np.repeat(np.arange(len(self.grams)), self.many) * len(items) + self.owner
        bits = max(16, min(26, int(len(self.grams) * 64).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[(self.grams >> self.shift).astype(np.int64)] = True
        long = size >= q
        self.least = int(self.bound[long].min()) if long.any() else 1 << 60
        self.reach = int((size + self.budget)[long].max()) if long.any() else 0

    def candidates(self, points: np.ndarray, starts: np.ndarray):
        """(document, item, first diagonal of the band) of bands that reach the bound. points: documents one
        after the other, each followed by one separator; starts: where each begins."""
        none = (np.zeros(0, np.int64),) * 3
        if not len(self.grams):
            return none
        grams = gram_hashes(points, self.q)
        at = np.flatnonzero(self.table[(grams >> self.shift).astype(np.int64)])
        where = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        true = self.grams[where] == grams[at]
        at, where = at[true], where[true]
        # Places with too few shared grams within the longest item's reach to either side can't count.
        near = np.searchsorted(at, at + self.reach, "right") - np.searchsorted(at, at - self.reach, "left")
        at, where = at[near >= self.least], where[near >= self.least]
        if not len(at):
            return none
        doc = np.searchsorted(starts, at, "right") - 1
        found = [self._bands(at[a:b], where[a:b], doc[a:b], starts, lo, hi) for a, b, lo, hi in self._slices(self.many[where], doc)]
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else none

    def _slices(self, many: np.ndarray, doc: np.ndarray):
        """(first place, last place, first item, last item): whole documents of about ENTRIES entries together; one
        document with more by ranges of items."""
        edges = np.append(np.flatnonzero(np.diff(doc, prepend=-1)), len(doc))
        total = np.concatenate([[0], np.cumsum(many)])
        k = 0
        while k < len(edges) - 1:
            a = edges[k]
            k = max(k + 1, int(np.searchsorted(total[edges], total[a] + ENTRIES, "right")) - 1)
            ranges = -(-int(total[edges[k]] - total[a]) // ENTRIES)
            step = -(-len(self.ids) // max(1, ranges))
            for lo in range(0, len(self.ids), step):
                yield a, edges[k], lo, min(len(self.ids), lo + step)

    def _bands(self, at, where, doc, starts, lo: int, hi: int):
        """(document, item, first diagonal) of the bands of items lo to hi that reach their bound."""
        first = np.searchsorted(self.keyed, where * len(self.ids) + lo)
        many = np.searchsorted(self.keyed, where * len(self.ids) + hi) - first
        entry = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
        item, at, doc = self.owner[entry], np.repeat(at, many), np.repeat(doc, many)
        band = (at - starts[doc] - self.place[entry]) // (self.budget[item] + 1)
        pair, number = np.unique(doc * len(self.ids) + item, return_inverse=True)
        # Pair and band stay apart until pairs are numbered, so that both fit in 63 bits.
        key, count = np.unique(np.concatenate([number, number]) << 32 | np.concatenate([band, band - 1]) + (1 << 31), return_counts=True)
        doc, item = np.divmod(pair[key >> 32], len(self.ids))
        fits = count >= self.bound[item]
        item = item[fits]
        return doc[fits], item, ((key[fits] & 0xFFFFFFFF) - (1 << 31)) * (self.budget[item] + 1)

    def short_matches(self, points: np.ndarray, starts: np.ndarray):
        """(document, item, 0 edits, start, end) of the items shorter than q, wherever they stand."""
        for n, (hashes, items) in self.short.items():
            told = gram_hashes(points, n)
            first, last = np.searchsorted(hashes, told), np.searchsorted(hashes, told, "right")
            for at in np.flatnonzero(first < last).tolist():
                doc = int(np.searchsorted(starts, at, "right")) - 1
                for k in items[first[at] : last[at]].tolist():
                    if (points[at : at + n] == self.points[k]).all():
                        yield doc, k, 0, int(at - starts[doc]), int(at - starts[doc]) + n

    def align(self, points: np.ndarray, begin: np.ndarray, end: np.ndarray, item: np.ndarray, diagonal: np.ndarray):
        """(edits, start, end) of each item's best alignment whose diagonals lie around the band, with free
        ends in the document points[begin:end]. One row of all candidates' bands at a time."""
        k, m = self.budget[item], self.size[item]
        width = int((4 * k + 3).max())
        low = diagonal - k  # the first diagonal that is looked at
        column = np.arange(width)
        unit = 1 << 24  # a cell is edits * unit + the alignment's start, as far from low
        wall = (1 << 20) * unit
        cell = np.where((low[:, None] + column >= 0) & (low[:, None] + column <= (end - begin)[:, None]), column, wall)
        cell[column[None, :] >= (4 * k + 3)[:, None]] = wall
        best = np.full(len(item), wall, np.int64)
        best_at = np.zeros(len(item), np.int64)
        pattern = np.zeros((len(item), int(m.max())), np.int64)
        for row, i in enumerate(item):
            pattern[row, : m[row]] = self.points[i]
        alive = 4 * k[:, None] + 3 > column
        for i in range(1, pattern.shape[1] + 1):
            place = begin[:, None] + low[:, None] + i - 1 + column  # the character that ends the cell's text
            inside = (place >= begin[:, None]) & (place < end[:, None]) & alive
            said = points[np.clip(place, 0, len(points) - 1)]
            put = np.where(inside, cell + unit * (said != pattern[:, i - 1 : i]), wall)
            skip = np.full_like(cell, wall)
            skip[:, :-1] = cell[:, 1:] + unit  # the item's character has none in the document
            skip = np.where(alive & (place >= begin[:, None] - 1) & (place < end[:, None]), skip, wall)
            cell = np.minimum(np.minimum(put, skip), wall)
            # The document's characters that the item lacks: cheapest from any cell to the left.
            cell = np.minimum.accumulate(cell - unit * column, axis=1) + unit * column
            cell = np.where(alive, np.minimum(cell, wall), wall)
            done = np.flatnonzero(m == i)
            if len(done):
                best_at[done] = cell[done].argmin(axis=1)
                best[done] = cell[done, best_at[done]]
        return best // unit, low + best % unit, low + best_at + m

    def matches(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(document's number, item's number, start, end, edits): places that don't overlap, best first."""
        points = [code_points(t) for t in texts]
        sizes = np.array([len(p) + 1 for p in points], np.int64)
        starts = np.cumsum(sizes) - sizes
        mark = np.array([0xFFFFFFFF], np.uint32)
        flat = np.concatenate([x for p in points for x in (p, mark)]) if points else mark
        doc, item, diagonal = self.candidates(flat, starts)
        found = []
        for a in range(0, len(doc), 256):
            d, i, g = doc[a : a + 256], item[a : a + 256], diagonal[a : a + 256]
            edits, start, end = self.align(flat, starts[d], starts[d] + sizes[d] - 1, i, g)
            fits = edits <= self.budget[i]
            found += zip(d[fits].tolist(), i[fits].tolist(), edits[fits].tolist(), start[fits].tolist(), end[fits].tolist(), strict=True)
        found += self.short_matches(flat, starts)
        out, taken = [], {}
        for d, i, e, s, t in sorted(found):
            if all(t <= a or b <= s for a, b in taken.setdefault((d, i), [])):
                taken[d, i].append((s, t))
                out.append((d, i, s, t, e))
        return out


def _item_blocks(benchmark: DataFrame) -> list[list[tuple]]:
    """The items in blocks that are small enough to send to all tasks, one block on the driver at a time."""
    items = benchmark.select("item_id", F.col("text")).where(F.trim(F.coalesce("text", F.lit(""))) != "")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // ITEM_BYTES)
    for b in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield sorted(((r[0], r[1]) for r in own.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def _searcher(spark, items, q, error_rate):
    import uuid

    held, name = spark.sparkContext.broadcast(items), f"items_{uuid.uuid4().hex}"

    def search(texts):
        """(number of the text, item_id, start, end, edits), block of texts by block; texts may be null."""
        index = cache(name, lambda: Items(held.value, q, error_rate))
        first, block, chars = 0, [], 0
        for text in texts:
            block.append(normal(text or ""))
            chars += len(block[-1])
            if chars >= BLOCK_CHARS:
                for n, i, *rest in index.matches(block):
                    yield first + n, index.ids[i], *rest
                first, block, chars = first + len(block), [], 0
        for n, i, *rest in index.matches(block) if block else ():
            yield first + n, index.ids[i], *rest

    return search


def _texts(column):
    """One text at a time, so that a batch's texts are never all held as Python strings."""
    return (x.as_py() for x in column)


def find_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, error_rate: float = 0.08) -> DataFrame:
    """doc_id, item_id, start long, end long (characters of the normalised text), edits int."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    schema = "doc_id long, item_id long, start long, end long, edits int"
    out = spark.createDataFrame([], schema)

    def finder(search):
        def find(batches):
            import pyarrow as pa

            for batch in batches:
                ids = batch.column("doc_id")
                found = [(ids[n].as_py(), *rest) for n, *rest in search(_texts(batch.column("text")))]
                columns = list(zip(*found, strict=True)) or [[]] * 5
                kinds = [pa.int64()] * 4 + [pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "start", "end", "edits"])

        return find

    for items in _item_blocks(benchmark):
        out = out.unionByName(rows.mapInArrow(finder(_searcher(spark, items, q, error_rate)), schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, q: int = Q, error_rate: float = 0.08) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    spark = docs.sparkSession
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))

    def keeper(search):
        def keep(batches):
            import pyarrow as pa

            for batch in batches:
                mask = np.ones(batch.num_rows, bool)
                mask[[n for n, *_ in search(_texts(batch.column("doc").field("text")))]] = False
                yield batch.filter(pa.array(mask))

        return keep

    for items in _item_blocks(benchmark):
        rows = rows.mapInArrow(keeper(_searcher(spark, items, q, error_rate)), rows.schema)
    return rows.select("doc.*")
