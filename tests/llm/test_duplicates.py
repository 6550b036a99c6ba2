import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from cases import EXTRA, ROWS, documents, empty
from pyspark.sql import functions as F

from antipode.llm import common, exact_dedup, exchange, near_jaccard, suffix_dedup


def key(row):
    return repr(tuple(row))


# --- exchange ------------------------------------------------------------------------------------------


def test_golomb_round_trip():
    rng = np.random.default_rng(0)
    for values in (np.unique(rng.integers(0, 1 << 48, 3000).astype(np.uint64)), np.arange(9, dtype=np.uint64), np.array([5], np.uint64), np.array([0, (1 << 48) - 1], np.uint64)):
        assert (exchange.golomb_decode(len(values), *exchange.golomb_encode(values)) == values).all()


def test_counts_in_a_byte():
    counts = np.array([0, 1, 127, 128, 255, 256, 10**6, 1 << 40])
    assert exchange.large(exchange.small(counts)).tolist() == [0, 1, 127, 128, 128, 256, 1 << 19, 1 << 40]


def test_each_sender_has_a_bucket(spark):
    for senders, buckets in ((1, 1), (40, 40), (90, 25)):
        numbers = common.sender_numbers(senders, buckets)
        rows = spark.createDataFrame([(n,) for n in numbers], "n int").select(F.pmod(F.hash("n"), F.lit(buckets)).alias("b")).collect()
        assert [r.b for r in rows] == [k % buckets for k in range(senders)] and len(set(numbers)) == senders


def test_what_was_written_can_be_released(spark):
    common.release(spark)
    exact_dedup.duplicate_report(documents(spark)).count()
    names = [n for n, _ in common._held() if n]
    assert names and all(spark.catalog.tableExists(n) for n in names)
    common.release(spark)
    assert not any(spark.catalog.tableExists(n) for n in names) and not common._held()


# --- exact -----------------------------------------------------------------------------------------------


def exact_brute(rows):
    out = []
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        kept = [False] * len(ids)
        kept[ids.index(keep)] = True
        out += [(i, keep, len(ids), k, hashlib.sha256(t.encode()).hexdigest()) for i, k in zip(ids, kept, strict=True)]
    return sorted(map(key, out))


def test_exact_report(spark):
    assert sorted(map(key, exact_dedup.duplicate_report(documents(spark)).collect())) == exact_brute(ROWS)
    assert exact_dedup.duplicate_report(empty(spark)).count() == 0


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "fingerprint", lambda text: F.lit(7).cast("long"))
    assert sorted(map(key, exact_dedup.duplicate_report(documents(spark)).collect())) == exact_brute(ROWS)


def test_exact_keeps_columns(spark):
    kept = exact_dedup.deduplicate(documents(spark))
    assert kept.columns == ["doc_id", "text", *EXTRA]
    rows = kept.collect()
    assert len(rows) == len({t or "" for _, t in ROWS}) and all(tuple(r)[2:] == tuple(EXTRA.values()) for r in rows)
    assert exact_dedup.deduplicate(empty(spark)).count() == 0


# --- near ------------------------------------------------------------------------------------------------


def near_brute(rows, k, percent):
    sets = []
    for _, t in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if o and 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                parent[root(a)] = root(b)
    names = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            names[root(a)] = min(i, names.get(root(a), i))
    return sorted(key((i, len(sets[a]), names.get(root(a)) if sets[a] else i)) for a, (i, _) in enumerate(rows))


def families(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(15):
        base = [rnd.choice(words) for _ in range(rnd.randint(1, 90))]
        for _ in range(rnd.choice([1, 2, 5, 25])):
            own = list(base)
            for _ in range(rnd.randint(0, max(1, len(own) // 25))):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            if rnd.random() < 0.3:
                own = words[:30] + own
            rows.append((len(rows), rnd.choice([" ", "  ", "\n"]).join(w.upper() if rnd.random() < 0.1 else w for w in own)))
    return rows


@pytest.mark.parametrize(("words", "percent", "block", "group"), [(4, 85, 4096, 2048), (5, 80, 7, 3)])
def test_components(spark, monkeypatch, words, percent, block, group):
    monkeypatch.setattr(near_jaccard, "BLOCK", block)
    monkeypatch.setattr(near_jaccard, "GROUP", group)
    rows = families(words) + [(i and i + 5000, t) for i, t in ROWS]
    found = near_jaccard.component_report(documents(spark, rows), words, percent)
    assert sorted(map(key, found.collect())) == near_brute(rows, words, percent)


def test_near_edges(spark):
    assert near_jaccard.component_report(empty(spark)).count() == 0
    kept = near_jaccard.deduplicate(documents(spark))
    assert kept.columns == ["doc_id", "text", *EXTRA]
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, [1, 3, 4, None, None, 5, 6, 8]))


def test_walk_prunes_nothing_that_is_linked():
    rnd = random.Random(7)
    for _ in range(200):
        universe = range(30)
        probe = np.array(sorted(rnd.sample(universe, rnd.randint(1, 20))), np.int64)
        n_probe = len(probe) + rnd.randint(0, 3)
        members = [(m, 0, np.array(sorted(rnd.sample(universe, rnd.randint(1, 20))), np.int64)) for m in range(12)]
        members = [(m, len(s) + rnd.randint(0, 3), s) for m, _, s in members]
        want = []
        for m, n, s in members:
            o = len(set(s.tolist()) & set(probe.tolist()))
            if 100 * o >= 60 * (n + n_probe - o):
                want.append((m, o))
        assert sorted(near_jaccard.walk(probe, n_probe, members, 60)) == want


def test_star_contraction(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 202), (202, 200)]
    found = dict(map(tuple, near_jaccard.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert found == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 140)} | {201: 200, 202: 200}


# --- substrings ------------------------------------------------------------------------------------------


def substring_brute(rows, length=50):
    first = {}
    told = [(-(1 << 63) if i is None else i, (t or "").encode()) for i, t in rows]
    for i, t in told:
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for (i, t), (own, _) in zip(told, rows, strict=True):
        gone = np.zeros(len(t) + 2, bool)
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < i:
                gone[p + 1 : p + 1 + length] = True
        turns = np.flatnonzero(np.diff(gone)).tolist()
        kept = bytes(b for b, g in zip(t, gone[1:], strict=False) if not g)
        out.append(key((own, len(t), list(zip(turns[::2], turns[1::2], strict=True)), kept)))
    return sorted(out)


def test_collections_group_equal_strings():
    rnd = random.Random(2)
    for length in (3, 5):
        for _ in range(60):
            parts = [bytes(rnd.choice(b"abc") for _ in range(rnd.randint(length, 14))) for _ in range(rnd.randint(1, 25))]
            owner = np.array([rnd.randint(0, 9) for _ in parts])
            least = {}
            for t, o in zip(parts, owner, strict=True):
                for p in range(len(t) - length + 1):
                    least[t[p : p + length]] = min(least.get(t[p : p + length], 99), o)
            for way in (suffix_dedup.smallest_owner(parts, owner, length), suffix_dedup.by_string(parts, owner.tolist(), length)):
                for t, found in zip(parts, way, strict=True):
                    assert [least[t[p : p + length]] for p in range(len(t) - length + 1)] == found.tolist()


def test_short_documents_cover_each_string_once():
    rnd = random.Random(3)
    for n in (0, 49, 50, 51, 400, 3000):
        data = bytes(rnd.choice(b"abcdef ") for _ in range(n))
        _, first, last = suffix_dedup.short_documents(data)
        assert sorted(p for a, b in zip(first, last, strict=True) for p in range(a, b + 1)) == list(range(max(0, n - 49)))


@pytest.mark.parametrize(("hot", "collection", "keys"), [(22, 50, 1 << 60), (1, 50, 1 << 60), (90, 2000, 3), (90, 2, 3)])
def test_repeated_spans(spark, monkeypatch, hot, collection, keys):
    """With three keys only, almost all short documents share one without being equal."""
    hashes = suffix_dedup.span_hashes
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "COLLECTION", collection)
    monkeypatch.setattr(suffix_dedup, "span_hashes", lambda *a: hashes(*a) % np.uint64(keys) << np.uint64(60 if keys == 3 else 0))
    rnd = random.Random(hot)
    base = ["".join(rnd.choice("abcdefgh éñ") for _ in range(rnd.randint(30, 200))) for _ in range(8)]
    rows = []
    for i in range(80):
        parts = [rnd.choice(base)[rnd.randint(0, 20) : rnd.randint(40, 200)] if rnd.random() < 0.6 else "".join(rnd.choice("abcde ") for _ in range(rnd.randint(0, 40))) for _ in range(rnd.randint(0, 4))]
        rows.append((i, "".join(parts)))
    rows += [(500, "a" * 400), (501, "a" * 300), (502, "ab" * 100), (503, "ba" * 90)] + [(i and i + 5000, t and t[:4000]) for i, t in ROWS]
    found = suffix_dedup.repeated_spans(documents(spark, rows)).collect()
    assert sorted(key((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept))) for r in found) == substring_brute(rows)


def test_repeated_spans_by_small_pieces(spark, monkeypatch):
    """Owners decide a few short documents at once, and texts and results go in batches of a few bytes."""
    monkeypatch.setattr(suffix_dedup, "AT_ONCE", 3, raising=False)
    monkeypatch.setattr(suffix_dedup, "BATCH", 100, raising=False)
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcdefgh éñ") for _ in range(150)) for _ in range(4)]
    rows = [(i, "".join(rnd.choice(base)[rnd.randint(0, 40) :] for _ in range(rnd.randint(0, 3)))) for i in range(40)]
    found = suffix_dedup.repeated_spans(documents(spark, rows)).collect()
    assert sorted(key((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept))) for r in found) == substring_brute(rows)


def test_an_owner_holds_few_short_documents_as_objects(monkeypatch):
    """The objects of all short documents at once took over 300 bytes each."""
    rng, n = np.random.default_rng(1), 40_000
    messages = []
    for _ in range(5):
        keys = np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64))
        text = rng.integers(97, 123, 60 * n).astype(np.uint8).tobytes()
        messages.append((suffix_dedup._packed(keys), suffix_dedup._packed(np.full(n, 60, np.int32)), suffix_dedup._packed(np.arange(n)), zlib.compress(text, 1)))
    messages.append(messages[0][:2] + (suffix_dedup._packed(np.arange(n) - 1),) + messages[0][3:])
    monkeypatch.setattr(suffix_dedup, "AT_ONCE", 4096, raising=False)
    tracemalloc.start()
    told = suffix_dedup.decide(messages, 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    least = [suffix_dedup._unpacked(t[0], np.int64) for t in told]
    assert all((x == np.arange(n) - (k in (0, 5))).all() for k, x in enumerate(least))
    assert peak < 150 * 6 * n


def test_no_documents(spark):
    assert suffix_dedup.repeated_spans(empty(spark)).count() == 0
