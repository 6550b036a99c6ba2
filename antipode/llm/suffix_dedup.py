"""Removal of repeated byte strings through a column-wise Burrows-Wheeler construction.

Bytes are removed where a string of ``length`` bytes covers them that also starts in a document with a
smaller doc_id. A construction that adds one symbol per document and round takes as many rounds as the
longest document is long, and each round passes over all that was built. So whole documents are first cut
into short ones without losing a string:

1. The *anchor* of a string of 50 bytes is the place of the smallest hash among its 24-byte grams. Consecutive
   strings mostly share it, so a text falls into runs of at most 27 strings; a run's bytes are one short
   document. Equal strings have equal anchors, and so the same key: the hash of the anchor with the 13
   bytes before it (strings that have those) or after it (the others, which have those).
2. Keys go through the compressed ``exchange``; only short documents whose key occurs in another document
   go on. Short documents of equal bytes (bytes are compared) are one from then on, with the smallest doc_id.
3. Senders send their short documents, equal ones once, to the owners of key ranges. There, those that share a
   key but aren't equal are taken together in collections of bounded size, built column by column: round r
   inserts the suffix of length r of each document into the collection's transform (positions by rank in
   the transform built so far) and updates the common prefixes around it by range minima. Runs of common
   prefixes of at least ``length`` are the groups of equal strings; a group's smallest doc_id decides. A
   short document alone with its key is a collection of one, whose strings are all its own.
4. What is decided goes back to the senders' staged texts, which never moved, and the bytes are cut there.

Texts that are equal to one of a smaller doc_id are removed as a whole before (if they have ``length``
bytes), so groups of copies cost nothing more. A key that thousands of documents hold is dealt string by
string instead, by the string's own hash. The construction's files are Spark's own shuffle files, read one
after another by the tasks: executors' local folders don't last.

Null text is empty. A null doc_id counts as smaller than any. Repeated rows (same doc_id, same text) don't
remove from each other. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .common import owners_of, stage, text_or_empty, trimmed, written
from .shingles import span_hashes, window_hashes

LENGTH = 50
GRAM = 24
#: Level (twice the log2 of the documents) from which on a key is dealt string by string.
HOT = 26
#: Short documents of one collection.
COLLECTION = 1 << 14
#: Short documents that an owner decides at once, and bytes of text and of results that tasks hold as objects at once.
AT_ONCE = 1 << 17
BATCH = 1 << 22
_PART = 1 << 23
_LEAST = -(1 << 63)


def runs(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, anchor): the runs of strings, by where they start, that share an anchor."""
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    width = length - gram + 1
    parts = []
    for a in range(0, n, _PART):  # places are kept in the low bits of the hashes
        b = min(n, a + _PART)
        key = window_hashes(data[a : b + length - 1], gram) & ~np.uint64(_PART * 2 - 1)
        key |= np.arange(len(key), dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        key = np.minimum(key[: b - a], key[width - size : width - size + b - a])
        parts.append((key & np.uint64(_PART * 2 - 1)).astype(np.int64) + a)
    anchor = np.concatenate(parts)
    first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
    last = np.concatenate([first[1:], [n]]) - 1
    return first, last, anchor[first]


def short_documents(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first, last): the text's strings, by where they start, in groups whose equals share the key."""
    first, last, anchor = runs(data, length, gram)
    side = (length - gram) // 2
    # Strings that start side or more before the anchor have the side bytes before it; the others those after it.
    split = np.minimum(last, anchor - side)
    left, right = first <= split, split < last
    start_right = np.maximum(first, split + 1)
    grams = [anchor[left] - side, anchor[right]]
    keys = [span_hashes(data, g, g + gram + side) for g in grams]
    keys[1] = keys[1] ^ np.uint64(0x5851F42D4C957F2D)
    return np.concatenate(keys), *(np.concatenate(x).astype(np.int32) for x in ([first[left], start_right[right]], [split[left], last[right]]))


def collection_groups(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, group) of every string of length bytes, equal strings in one group.

    Rows are the suffixes so far in sorted order: ``before`` is the transform (the symbol before the suffix,
    255 at a document's start, which no UTF-8 text holds), ``common`` the common prefix with the row above."""
    m = len(texts)
    size = np.fromiter(map(len, texts), np.int64, m)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    end = np.cumsum(size)

    def symbol(docs, r):
        """The symbol before the suffix of length r."""
        at = end[docs] - r - 1
        return np.where(size[docs] > r, flat[np.maximum(at, 0)], 255).astype(np.uint8)

    active = np.arange(m)
    name = active.astype(np.int64) << 8  # document and suffix length
    before, common = symbol(active, 0), np.zeros(m, np.uint8)
    place = np.arange(m)
    for r in range(1, int(size.max()) + 1):
        keep = size[active] >= r
        active, place = active[keep], place[keep]
        turn = np.argsort(place, kind="stable")
        active, place = active[turn], place[turn]
        n = len(before)
        by_symbol = np.argsort(before, kind="stable")
        rank = np.empty(n, np.int64)
        rank[by_symbol] = np.arange(n)
        mine = rank[place]
        said = before[place]
        # The rows whose suffixes, one symbol longer, stand right above and below the new one.
        above, below = by_symbol[np.maximum(mine - 1, 0)], by_symbol[np.minimum(mine + 1, n - 1)]
        has_above = (mine > 0) & (before[above] == said)
        has_below = (mine < n - 1) & (before[below] == said)
        padded = np.append(common, np.uint8(0))

        def least(lo, hi, padded=padded):
            cuts = np.empty(2 * len(lo), np.int64)
            cuts[0::2], cuts[1::2] = lo, hi
            return np.minimum.reduceat(padded, cuts)[0::2]

        up = np.where(has_above, 1 + least(np.where(has_above, above + 1, place), place + 1).astype(np.int64), 0)
        down = np.where(has_below, 1 + least(np.minimum(place + 1, n - 1), np.where(has_below, below + 1, np.minimum(place + 1, n - 1) + 1)).astype(np.int64), 0)
        # Rows are: all empty suffixes, then each row's suffix made longer in the order of the symbols.
        new = m + mine
        fresh = np.zeros(n + len(new), bool)
        fresh[new] = True
        old = ~fresh
        grown = np.empty(len(fresh), np.uint8)
        grown[old], grown[new] = before, symbol(active, r)
        names = np.empty(len(fresh), np.int64)
        names[old], names[new] = name, active << 8 | r
        shared = np.empty(len(fresh), np.uint8)
        shared[old] = common
        under = new[has_below] + 1
        shared[under] = down[has_below]
        shared[new] = up
        before, name, common, place = grown, names, shared, new
    group = np.cumsum(common < length)
    whole = (name & 255) >= length
    doc = name[whole] >> 8
    return doc, size[doc] - (name[whole] & 255), group[whole]


def smallest_owner(texts: list[bytes], owner: np.ndarray, length: int) -> list[np.ndarray]:
    """For each text, by start, the smallest owner among all texts that hold the string."""
    doc, start, group = collection_groups(texts, length)
    _, group = np.unique(group, return_inverse=True)
    best = np.full(int(group.max()) + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(best, group, owner[doc])
    out = [np.empty(len(t) - length + 1, np.int64) for t in texts]
    flat = np.empty(sum(map(len, out)), np.int64)
    first = np.concatenate([[0], np.cumsum([len(x) for x in out])])
    flat[first[doc] + start] = best[group]
    return [flat[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


# --- what senders and owners tell each other -----------------------------------------------------------

PARTS = "sender int, owner int, keys binary, sizes binary, least binary, text binary, places binary"
DECIDED = "sender int, owner int, least binary, several binary, best binary"


def _packed(values: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(values).data, 1)


def _unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def _texts(data: bytes, sizes: np.ndarray) -> list[bytes]:
    cuts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def shared_parts(documents: list, flat: np.ndarray, level: np.ndarray, length: int) -> list[np.ndarray]:
    """[key, document, start, end] of the short documents whose key occurs elsewhere, hot ones string by string. documents:
    (docno, owner id, bytes, first, last), of which the list keeps the first three; flat and level have their keys and
    the keys' levels one after the other."""
    found = [[np.zeros(0, np.uint64)], *([np.zeros(0, np.int32)] for _ in range(3))]
    at = 0
    for n, (docno, own, data, first, last) in enumerate(documents):
        documents[n] = docno, own, data
        key, levels = flat[at : at + len(first)], level[at : at + len(first)]
        at += len(first)
        cold, hot = np.flatnonzero((levels > 0) & (levels < HOT)), np.flatnonzero(levels >= HOT)
        mine = [(key[cold], first[cold], last[cold])]
        if len(hot):
            each = np.concatenate([np.arange(first[k], last[k] + 1) for k in hot])
            mine.append((span_hashes(data, each, each + length) ^ np.uint64(0x2545F4914F6CDD1D), each, each))
        for k, a, b in mine:
            for to, x in zip(found, (k, np.full(len(k), n, np.int32), a.astype(np.int32), b.astype(np.int32) + np.int32(length)), strict=True):
                to.append(x)
    out = []
    while found:
        out.append(np.concatenate(found.pop(0)))
    return out


def part_messages(sender: int, documents: list, parts: list[np.ndarray], owners: int):
    """Yields a sender's shared short documents, equal ones once, sorted by key and cut by owner; and, as a message to
    itself (owner -1), where each stands. documents: (docno, owner id, bytes), given up at the end; parts: as from
    ``shared_parts``. One owner's short documents are held at a time."""
    key, doc, start, end = parts
    del parts
    if not len(key):
        return
    order = np.argsort(key, kind="stable").astype(np.int32)
    number = np.empty(len(key), np.int32)
    bounds = np.array([(o << 64) // owners for o in range(owners)], np.uint64)
    cuts = [*np.searchsorted(key, bounds, sorter=order).tolist(), len(key)]
    done = 0
    for owner, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if a == b:
            continue
        turn = order[a:b]
        texts, chosen, least, mine = [], [], [], []
        before, known = None, {}
        for k, n, x, y in zip(key[turn].tolist(), doc[turn].tolist(), start[turn].tolist(), end[turn].tolist(), strict=True):
            if k != before:  # equal bytes have equal keys
                before, known = k, {}
            own, text = documents[n][1], documents[n][2][x:y]
            at = known.get(text)
            if at is None:
                at = known[text] = len(texts)
                texts.append(text)
                chosen.append(k)
                least.append(own)
            elif own < least[at]:
                least[at] = own
            mine.append(at)
        number[turn] = np.array(mine, np.int32) + np.int32(done)
        done += len(texts)
        sizes = np.fromiter(map(len, texts), np.int32, len(texts))
        yield sender, owner, _packed(np.array(chosen, np.uint64)), _packed(sizes), _packed(np.array(least, np.int64)), zlib.compress(b"".join(texts), 1), None
    del order, key
    docnos = np.fromiter((d for d, _, _ in documents), np.int32, len(documents))
    documents.clear()
    to, places = zlib.compressobj(1), []
    for make in (lambda: docnos[doc], lambda: start, lambda: number, lambda: end - start):
        places.append(to.compress(make().data))
    yield sender, -1, None, None, None, None, b"".join([*places, to.flush()])


def in_batches(rows, columns: str, size):
    """A table of the rows in batches of about ``BATCH`` bytes, so that what reads it holds one at a time."""
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in columns.split(", "))])
    batches, held, n = [], [], 0

    def take():
        batches.append(pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema))
        held.clear()

    for row in rows:
        held.append(row)
        n += size(row)
        if n >= BATCH:
            take()
            n = 0
    if held:
        take()
    return pa.Table.from_batches(batches, schema)


def by_string(texts: list[bytes], owner: list[int], length: int) -> list[np.ndarray]:
    """What ``smallest_owner`` tells, by a table of the strings: for more short documents of one key than a
    collection takes."""
    best: dict[bytes, int] = {}
    for t, o in zip(texts, owner, strict=True):
        for k in range(len(t) - length + 1):
            s = t[k : k + length]
            if o < best.get(s, o + 1):
                best[s] = o
    return [np.array([best[t[k : k + length]] for k in range(len(t) - length + 1)], np.int64) for t in texts]


def decide(messages: list[tuple], length: int) -> list[tuple[bytes, bytes, bytes]]:
    """For each message (keys, sizes, least, text): the smallest owner of each short document, the numbers of
    those whose strings differ in owner, and these strings' owners one after the other. Goes by ranges of keys of about
    ``AT_ONCE`` short documents, whole keys together."""
    parts = []
    while messages:
        m = messages.pop(0)
        cuts = np.concatenate([[0], np.cumsum(_unpacked(m[1], np.int32), dtype=np.int64)])
        parts.append((_unpacked(m[0], np.uint64), cuts, _unpacked(m[2], np.int64), zlib.decompress(m[3])))
    every = np.sort(np.concatenate([p[0] for p in parts]))
    bounds = np.unique(every[AT_ONCE::AT_ONCE])
    del every
    edges = [[0, *np.searchsorted(p[0], bounds).tolist(), len(p[0])] for p in parts]
    out = [([], [], []) for _ in parts]
    for r in range(len(bounds) + 1):
        ranges = [(e[r], e[r + 1]) for e in edges]
        if not any(a < b for a, b in ranges):  # the smallest key fills a range
            continue
        some = [(key[a:b].tolist(), _texts(text[cuts[a] : cuts[b]], np.diff(cuts[a : b + 1])), least[a:b].tolist()) for (key, cuts, least, text), (a, b) in zip(parts, ranges, strict=True)]
        for told, (a, _), found in zip(out, ranges, _decide(some, length), strict=True):
            for to, x in zip(told, (found[0], found[1] + np.int32(a), found[2]), strict=True):
                to.append(x)
    return [tuple(_packed(np.concatenate(x)) for x in told) for told in out]


def _decide(messages: list[tuple], length: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``decide`` for messages (keys, texts, least) of one range of keys."""
    numbers = []
    known: dict[bytes, int] = {}
    keys, smallest = [], []
    for key, given, least in messages:
        mine = np.empty(len(key), np.int64)
        for k, (text, x, own) in enumerate(zip(given, key, least, strict=True)):
            number = known.get(text)
            if number is None:
                number = known[text] = len(keys)
                keys.append(x)
                smallest.append(own)
            elif own < smallest[number]:
                smallest[number] = own
            mine[k] = number
        numbers.append(mine)
    texts, keys = list(known), np.array(keys, np.uint64)
    del known
    # Alone with its key, a short document's strings are all its own; the others are built, whole keys together.
    order = np.argsort(keys, kind="stable")
    joins = np.concatenate([[False], keys[order][1:] == keys[order][:-1]])
    at = order[joins | np.append(joins[1:], False)]
    opens = np.append(np.flatnonzero(np.diff(keys[at].astype(np.uint64), prepend=~keys[at][:1])), len(at)) if len(at) else np.zeros(1, np.int64)
    several: dict[int, np.ndarray] = {}
    a = 0
    while a < len(opens) - 1:
        b = max(a + 1, int(np.searchsorted(opens, opens[a] + COLLECTION, "right")) - 1)
        group = at[opens[a] : opens[b]].tolist()
        own = [smallest[k] for k in group]
        strings = [texts[k] for k in group]
        found = smallest_owner(strings, np.array(own, np.int64), length) if len(group) <= COLLECTION else by_string(strings, own, length)
        for k, best in zip(group, found, strict=True):
            if best.min() < smallest[k]:
                several[k] = best
        a = b
    smallest, out = np.array(smallest, np.int64), []
    for own in numbers:
        differ = [k for k, x in enumerate(own.tolist()) if x in several]
        best = [several[int(own[k])] for k in differ]
        out.append((smallest[own], np.array(differ, np.int32), np.concatenate(best) if best else np.zeros(0, np.int64)))
    return out


def covering(places: np.ndarray, decided: list[tuple], length: int):
    """A function of documents (docno, owner id, bytes), some at a time: by docno, a boolean for each byte, true if it goes."""
    docno, start, number, size = places
    parts = [(_unpacked(a, np.int64), _unpacked(b, np.int32), _unpacked(c, np.int64)) for _, a, b, c in sorted(decided, key=lambda d: d[0])]
    least = np.concatenate([p[0] for p in parts])
    base = np.cumsum([0, *(len(p[0]) for p in parts)])
    differ = np.concatenate([p[1] + b for p, b in zip(parts, base[:-1], strict=True)]).astype(np.int64)
    best = np.concatenate([p[2] for p in parts])
    del parts
    sizes = np.zeros(len(least), np.int32)
    sizes[number] = size
    first = np.full(len(least), -1, np.int64)  # of several owners
    strings = sizes[differ].astype(np.int64) - length + 1
    first[differ] = np.cumsum(strings) - strings
    del sizes, strings, differ
    turn = np.argsort(docno, kind="stable").astype(np.int32)
    ids, begins = np.unique(docno[turn], return_index=True)
    rows = dict(zip(ids.tolist(), zip(begins.tolist(), [*begins[1:].tolist(), len(turn)], strict=True), strict=True))

    def of(documents: list[tuple]) -> dict[int, np.ndarray]:
        mine = [turn[slice(*rows.get(d, (0, 0)))] for d, _, _ in documents]
        doc = np.repeat(np.arange(len(mine)), [len(x) for x in mine])
        mine = np.concatenate(mine)
        begin_at, numbers, lengths_at = start[mine], number[mine], size[mine]
        lengths = np.array([len(t) + 1 for _, _, t in documents], np.int64)
        begin = np.cumsum(lengths) - lengths
        own = np.array([o for _, o, _ in documents], np.int64)
        # A byte lies in at most length strings and as many short documents, so 16 bits do.
        edge = np.zeros(int(lengths.sum()) + 1, np.int16)
        mixed = first[numbers] >= 0
        whole = np.flatnonzero(~mixed & (least[numbers] < own[doc]))
        at = begin[doc[whole]] + begin_at[whole]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + lengths_at[whole], -1)
        some = np.flatnonzero(mixed)
        many = lengths_at[some].astype(np.int64) - length + 1
        inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        hit = best[np.repeat(first[numbers[some]], many) + inner] < np.repeat(own[doc[some]], many)
        at = (np.repeat(begin[doc[some]] + begin_at[some], many) + inner)[hit]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length, -1)
        gone = np.cumsum(edge, dtype=np.int16, out=edge) > 0
        return {d: gone[b : b + len(t)] for (d, _, t), b in zip(documents, begin.tolist(), strict=True)}

    return of


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes long, spans array of (start, end) long (maximal removed runs), kept binary: one row per
    row of docs, bytes of the UTF-8 text."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    own_id = F.coalesce("doc_id", F.lit(_LEAST))
    staged = stage(rows.select("*", own_id.alias("_id"), F.unhex(F.sha2("text", 256)).alias("_class")), "suffix")
    owners = owners_of(staged)
    named = staged.select("_class", "_id", "sender", "docno")
    firsts = written(named.groupBy("_class").agg(F.min("_id").alias("_id")), "firsts")
    control = named.join(firsts, ["_class", "_id"]).groupBy("sender").agg(F.collect_list("docno").alias("docnos"))
    control = written(control.select("sender", F.lit(-1).alias("owner"), "docnos", F.lit(None).cast("binary").alias("values")), "control")
    drop = np.uint64(64 - exchange.BITS)

    def first_documents(table, control):
        wanted = set(next((d for d in control["docnos"].to_pylist() if d is not None), []))
        rows = zip(table["docno"].to_pylist(), table["_id"].to_pylist(), table["text"], strict=True)
        return ((docno, own, text.as_py().encode()) for docno, own, text in rows if docno in wanted)

    def send(key, table, control):
        found = [np.unique(short_documents(data, length)[0] >> drop) for _, _, data in first_documents(table, control)]
        return trimmed(exchange.message_table(exchange.message_rows(key[0].as_py(), np.concatenate(found), owners) if found else []))

    def cut(key, table, control):
        answers = exchange.read_answers([(o, v) for o, v in zip(control["owner"].to_pylist(), control["values"].to_pylist(), strict=True) if o >= 0])
        documents, keys = [], []
        for docno, own, data in first_documents(table, control):
            found, first, last = short_documents(data, length)
            keys.append(found)
            documents.append((docno, own, data, first, last))
        flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        del keys, table
        parts = shared_parts(documents, flat, exchange.levels_of(flat, answers), length)
        del flat, answers
        rows = part_messages(key[0].as_py(), documents, parts, owners)
        del parts
        return trimmed(in_batches(rows, PARTS, lambda row: sum(map(len, filter(None, row[2:])))))

    def owned(table):
        import pyarrow as pa

        messages = list(zip(*(table[c].to_pylist() for c in ("keys", "sizes", "least", "text")), strict=True))
        told = decide(messages, length)
        columns = [pa.array(c, pa.binary()) for c in zip(*told, strict=True)]
        return trimmed(pa.table([table["sender"], table["owner"], *columns], ["sender", "owner", "least", "several", "best"]))

    def finish(key, table, known):
        rows = known.to_pylist()
        firsts = {d for r in rows if r["docnos"] is not None for d in r["docnos"]}
        places = next((r["places"] for r in rows if r["places"] is not None), None)
        told = [(r["owner"], r["least"], r["several"], r["best"]) for r in rows if r["owner"] >= 0]
        of = covering(_unpacked(places, np.int32).reshape(4, -1), told, length) if places is not None else None
        del places, told, rows

        def ended(some):
            """Rows of the result for (docno, owner id, bytes, doc_id)."""
            where = of([x[:3] for x in some if x[0] in firsts]) if of and any(x[0] in firsts for x in some) else {}
            for docno, _, data, doc_id in some:
                gone = where.get(docno)
                if docno not in firsts:  # a copy of a text with a smaller doc_id
                    gone = np.full(len(data), len(data) >= length)
                turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]))).tolist() if gone is not None else []
                spans = [{"start": a, "end": b} for a, b in zip(turns[0::2], turns[1::2], strict=True)]
                kept = data if not spans else b"".join(data[a:b] for a, b in zip([0, *turns[1::2]], [*turns[0::2], len(data)], strict=True))
                yield doc_id, len(data), spans, kept

        def every():
            some, held = [], 0
            for docno, own, doc_id, text in zip(table["docno"].to_pylist(), table["_id"].to_pylist(), table["doc_id"].to_pylist(), table["text"], strict=True):
                data = text.as_py().encode()
                some.append((docno, own, data, doc_id))
                held += len(data)
                if held >= BATCH:
                    yield from ended(some)
                    some, held = [], 0
            yield from ended(some)

        return trimmed(in_batches(every(), "doc_id long, n_bytes long, spans spans, kept binary", lambda row: len(row[3]) + 16 * len(row[2])))

    left = staged.select("sender", "docno", "_id", "text").groupBy("sender")
    answers = exchange.answer(left.cogroup(control.groupBy("sender")).applyInArrow(send, exchange.MESSAGE), owners)
    answers = answers.select("sender", "owner", F.lit(None).cast("array<int>").alias("docnos"), "values")
    parts = written(left.cogroup(control.unionByName(answers).groupBy("sender")).applyInArrow(cut, PARTS), "parts")
    decided = parts.where("owner >= 0").groupBy("owner").applyInArrow(owned, DECIDED)
    known = decided.withColumns({"docnos": F.lit(None).cast("array<int>"), "places": F.lit(None).cast("binary")})
    for more in (control.select("sender", "owner", "docnos"), parts.where("owner < 0").select("sender", "owner", "places")):
        known = known.unionByName(more, allowMissingColumns=True)
    whole = staged.select("sender", "docno", "_id", "doc_id", "text").groupBy("sender").cogroup(known.groupBy("sender"))
    return whole.applyInArrow(finish, "doc_id long, n_bytes long, spans array<struct<start: bigint, end: bigint>>, kept binary")
