import random
import struct
import zlib

import public_tokenizers
import pytest
from cases import ROWS, documents, empty
from tokenizers import Tokenizer

from antipode.llm import bpe, packing, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def compiled():
    return bpe.compile_tokenizer(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(n, seed):
    rnd = random.Random(seed)
    bits = ["a", "b", " ", "  ", "\n", "\n ", " \n", "'s", "'", "é", "<|endoftext|>", "1", "९", "՘", "᲻", "漢", "!", "\t", "the", " th", "\U0001f600", " ", "'ll", "\x1c", "\x85", "ing"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 24))) for _ in range(n)]


def test_counts_and_ids_are_the_library_s(compiled, library):
    encode, count = bpe.Encoder(compiled), token_counts.Counter(compiled)
    for text in texts(3000, 1) + [t or "" for _, t in ROWS]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert encode(text) == struct.pack(f"<{len(ids)}I", *ids)
        assert count(text) == len(ids)


def test_latin_texts_are_split_by_the_quicker_library(compiled, library):
    encode, rnd = bpe.Encoder(compiled), random.Random(21)
    latin = [chr(c) for c in range(0xA1, 0x250)]
    bits = [*latin, *"abc XYZ 0129 '-_.,!  \n\t\r", "'s", "'ll", " \n ", "  ", "the ", "\n\n\n"]
    # Each letter beside letters, numbers, marks and white space; then mixtures; then long runs.
    rows = [f"a{c}1{c} {c}{c}'s{c}-{c}\n{c}  {c}" for c in latin]
    rows += ["é" + "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    rows += ["é" + x * 60_000 for x in (" ", "\n", "é", "1", "!", " \n")] + ["é\x1c a\x85b\xa0c ", "é" * (bpe.WHOLE + 5)]
    whole, seen = encode.whole, []
    encode.whole = lambda text: seen.append(text) or whole(text)
    for text in rows:
        ids = library.encode(text, add_special_tokens=False).ids
        assert encode(text) == struct.pack(f"<{len(ids)}I", *ids)
    assert len(seen) >= len(rows) - 3


def test_all_code_points(compiled, library):
    text = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    assert token_counts.Counter(compiled)(text) == len(library.encode(text, add_special_tokens=False).ids)


def cut_like(whole, chunk, compiled):
    """A counter with small chunks that shares what the other remembers."""
    cut = token_counts.Counter(compiled, chunk)
    cut.run, cut.machine, cut.transducer = whole.run, whole.machine, whole.transducer
    return cut


def test_chunk_maps_compose(compiled, library):
    whole = token_counts.Counter(compiled)
    for chunk in (1, 2, 3, 7):
        cut = cut_like(whole, chunk, compiled)
        for text in texts(400, chunk):
            n = len(library.encode(text, add_special_tokens=False).ids)
            assert cut(text) == n
            pieces = cut.pieces(text, chunk + 2)
            assert "".join(p for _, p in pieces) == text
            assert cut.total([cut.parts(p, before) for before, p in pieces]) == n


def test_state_maps_are_functions_of_any_state(compiled):
    """A map gives what reading the text gives, for every state of entry, and so do composed maps."""
    counter = cut_like(token_counts.Counter(compiled), 5, compiled)
    machine = counter.machine
    entries = [machine.run(machine.START, t)[0] for t in ("", "a", " ", "  ", "\n", "'", "'r", "12", "--", "abcdefghijklmnop", " th", "!'")]
    kinds = set()
    for text in [*texts(150, 9), "aaaaaaaaaaaa", "      ", "漢" * 20, "x"]:
        text = text.replace("<|endoftext|>", "")
        made = counter.map_of(text)
        kinds.add(made.exit is None)
        told = token_counts.StateMap(*made.told())
        for entry in entries:
            state, n = machine.run(entry, text)
            for m in (made, told):
                exit, more = m(machine, entry)
                assert machine.close(exit) + more == machine.close(state) + n
                assert machine.run(exit, "ing 's")[1] + more == machine.run(state, "ing 's")[1] + n
    assert kinds == {True, False}


def test_adjacent_tokens_by_definition(compiled):
    transducer, rnd = token_counts.Transducer(compiled), random.Random(3)
    ids, true = list(transducer.bytes_of), 0
    for turn in range(6000):
        # Two tokens, cut anew; or one, which mostly isn't the encoding of its parts.
        both = b"".join(transducer.bytes_of[rnd.choice(ids)] for _ in range(1 + turn % 2))
        cuts = [k for k in range(1, len(both)) if both[:k] in transducer.id_of and both[k:] in transducer.id_of]
        if not cuts:
            continue
        k = rnd.choice(cuts)
        a, b = both[:k], both[k:]
        said = transducer.adjacent(transducer.id_of[a], transducer.id_of[b])
        assert said == (transducer.merge(both)[0] == [a, b])
        true += said
    assert 1000 < true < 4500


def test_long_texts_over_several_tasks(spark, library):
    bits = ["漢字" * 500, "a" * 3000, " " * 700, "it's <|endoftext|>" * 60, "words and, more 12 words\n" * 90, "'s" * 400]
    rows = [(k, "".join(bits[k % 6 :] + bits[: k % 6])) for k in range(8)] + ROWS
    found = token_counts.count_tokens(documents(spark, rows), PATH, chunk=64, long=300).collect()
    expected = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert sorted((tuple(r)[:3] for r in found), key=repr) == sorted(expected, key=repr)


def test_memory_is_bounded():
    memory = bpe.Memory(len, limit=10, longest=3)
    for k in range(100):
        assert memory[str(k)] == len(str(k))
    assert len(memory) <= 10 and len(memory.old) <= 10 and memory["x" * 9] == 9 and "x" * 9 not in memory


def test_token_report(spark, library):
    rows = token_counts.count_tokens(documents(spark), PATH).collect()
    expected = []
    for i, t in ROWS:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        expected.append((i, len((t or "").encode()), n, n > 1024))
    assert sorted(map(tuple, rows), key=repr) == sorted(expected, key=repr)
    assert token_counts.count_tokens(empty(spark), PATH).count() == 0


def check_packing(rows, documents_in, library, size):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    expected = []
    for i, t in documents_in:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % size or size if len(ids) > size else len(ids)
        cuts = [0, *range(first, len(ids) + 1, size)]
        expected += [(i, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    return len(sequences), sum(r["length"] for r in rows)


def test_packing(spark, library):
    rows = packing.pack(documents(spark), PATH).collect()
    check_packing(rows, ROWS, library, 1024)
    assert packing.pack(empty(spark), PATH).count() == 0


def test_packing_in_shards_is_tight(spark, library):
    rnd = random.Random(4)
    many = [(k, "a " * rnd.randint(0, 70)) for k in range(1500)]
    found = packing.pack(documents(spark, many), PATH, size=64, shard=200).collect()
    used, tokens = check_packing(found, many, library, 64)
    assert used <= 1.02 * -(-tokens // 64) + 2


def test_packing_ends_where_nothing_fills(spark, library):
    import pandas as pd

    shard = pd.DataFrame({"row_id": range(301), "length": 40, "_shard": 0})
    out = packing._packer(64, 0, False)(shard)
    assert sorted(out["row_id"]) == list(range(301)) and 2 * (~out["_done"]).sum() <= 301
    # More than `shard` pieces of one length above half the size, alone and beside others.
    alike = [(k, "a " * 40) for k in range(450)]
    rnd = random.Random(5)
    for many in (alike, alike + [(1000 + k, "a " * rnd.randint(0, 70)) for k in range(450)]):
        found = packing.pack(documents(spark, many), PATH, size=64, shard=100).collect()
        used, _ = check_packing(found, many, library, 64)
        lengths = pd.Series([r["length"] for r in found])
        assert used <= 1.05 * len(packing.pack_shard(lengths[lengths < 64].to_numpy(), 64)) + (lengths == 64).sum() + 2


def test_sum_of_squares_rule():
    import numpy as np

    # By the definition, over all choices.
    rnd = random.Random(0)
    lengths = np.array([rnd.randint(1, 15) for _ in range(200)])
    got = packing.sum_of_squares(lengths, 16)
    gaps = []
    where = []
    for n in lengths:
        def cost(to, n=n):
            after = [g - n if k == to else g for k, g in enumerate(gaps)] + ([16 - n] if to == len(gaps) else [])
            return sum(sum(g == x for g in after) ** 2 for x in range(1, 16))

        choices = [k for k, g in enumerate(gaps) if g >= n] + [len(gaps)]
        best = min(choices, key=lambda k: (cost(k), (gaps + [16])[k]))
        if best == len(gaps):
            gaps.append(16)
        gaps[best] -= n
        where.append(best)
    assert sorted(sum(lengths[s]) for s in got) == sorted(16 - g for g in gaps)
