"""N-gram Jaccard join by prefix trees.

Sets of word shingles are ordered globally, rare shingles first, and two sets are linked when
100 * |x & y| >= threshold * |x | y|. All links' components come out exactly:

1. Equal texts are one *representative* (class of copies). The rest works on representatives.
2. Document frequencies of all shingles go through the compressed ``exchange``; each sender learns the
   frequency level of its own shingles. A shingle that only one representative holds can't be shared, so a
   set is carried as its size and its shared shingles, and a representative whose shared shingles are
   fewer than the threshold needs is done.
3. Linked sets share a shingle among the first |x| - need(x) + 1 of the global order. Those are posted.
4. Each set is compared with one *hub*: of the least unshared sets of its posting lists the one it meets
   most often. A large group of copies so becomes a star, in as many comparisons as it has members.
5. Of what posting lists still hold in different components, pairs that pass the size and position bounds
   are compared. A list is cut in blocks of its largest component and blocks of the rest; pairs of blocks go to
   different tasks, but for those within the largest component, of which none is made.
6. Comparing goes by probe: the sets that one probe meets are put in a prefix tree, which is walked once;
   sets below a node share the overlap counted so far, and a subtree is left when what remains of its sets
   or of the probe can't reach the overlap they need.

A group is never gathered. A token says itself how frequent it is, so joins by token are salted by it on both sides;
pairs are dealt by ranges of (probe, member), so a hub's members spread over tasks; components come from star
contraction. Joins by a text's class or a component's name have one small row a class on one side, and
Spark's adaptive execution cuts the other side where a class is large.

Nulls: null text is empty; without words a set is empty, linked with nothing, and its component is its own
doc_id. A null doc_id never is a component's name unless all its ids are null. Repeated rows are linked as
equal texts. Empty tables give no rows; extra columns are carried by ``deduplicate`` whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .common import owners_of, row_id, stage, tasks, text_or_empty, trimmed, written
from .shingles import shingle_set

#: Members of one comparing group, members of one block of a posting list, and rows of a token that join in one go.
GROUP = 2048
BLOCK = 512
SALT = 512
#: Bits of a token below its frequency level.
LEVEL = 57


def need(n: int, percent: int) -> int:
    """The least overlap with which a set of n can be linked at all."""
    return -(-percent * n // 100)


def overlap_needed(n: int, m: int, percent: int) -> int:
    """100 * o >= percent * (n + m - o)."""
    return -(-percent * (n + m) // (100 + percent))


def _docs_of(table, wanted):
    """(docno, text) of the wanted documents, one text at a time."""
    keep = set(wanted)
    for docno, text in zip(table["docno"].to_pylist(), table["text"], strict=True):
        if docno in keep:
            yield docno, text.as_py()


def representative_sets(staged: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """rep long, n int, shared array<long> (ordered; null if the set can't be linked): one row per class."""
    owners = owners_of(staged)
    reps = classes.select(F.shiftright("rep", 33).cast("int").alias("sender"), F.col("rep").bitwiseAND(F.lit((1 << 33) - 1)).cast("int").alias("docno"))
    control = reps.groupBy("sender").agg(F.collect_list("docno").alias("docnos"))
    control = written(control.select("sender", F.lit(-1).alias("owner"), "docnos", F.lit(None).cast("binary").alias("values")), "control")
    texts = staged.select("sender", "docno", text_or_empty("doc.text").alias("text"))

    def hashes(table, control):
        """(docnos, where each one's hashes begin and the last one's end, the hashes one after the other)"""
        wanted = next((d for d in control["docnos"].to_pylist() if d is not None), [])
        docnos, sets = [], []
        for docno, text in _docs_of(table, wanted):
            docnos.append(docno)
            sets.append(shingle_set(text, words))
        at = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
        return docnos, at.tolist(), np.concatenate(sets) if sets else np.zeros(0, np.uint64)

    def send(key, table, control):
        flat = hashes(table, control)[2]
        flat >>= np.uint64(64 - exchange.BITS)
        return trimmed(exchange.message_table(exchange.message_rows(key[0].as_py(), flat, owners)))

    def order(key, table, control):
        import pyarrow as pa

        docnos, at, flat = hashes(table, control)
        answers = exchange.read_answers([(o, v) for o, v in zip(control["owner"].to_pylist(), control["values"].to_pylist(), strict=True) if o >= 0])
        level = exchange.levels_of(flat, answers)
        rep, n, shared = [], [], []
        for docno, a, b in zip(docnos, at[:-1], at[1:], strict=True):
            own = np.flatnonzero(level[a:b]) + a
            rep.append(key[0].as_py() << 33 | docno)
            n.append(b - a)
            # The global order: by level (half a power of two), then hash, in one number below 2^63.
            ranks = np.minimum(level[own], 63).astype(np.uint64) << np.uint64(LEVEL) | flat[own] >> np.uint64(64 - LEVEL)
            shared.append(np.sort(ranks.astype(np.int64)) if len(own) and len(own) >= need(b - a, percent) else None)
        return trimmed(pa.table([pa.array(rep, pa.int64()), pa.array(n, pa.int32()), pa.array(shared, pa.list_(pa.int64()))], ["rep", "n", "shared"]))

    left = texts.groupBy("sender")
    answers = exchange.answer(left.cogroup(control.groupBy("sender")).applyInArrow(send, exchange.MESSAGE), owners)
    answers = answers.select("sender", "owner", F.lit(None).cast("array<int>").alias("docnos"), "values")
    return left.cogroup(control.unionByName(answers).groupBy("sender")).applyInArrow(order, "rep long, n int, shared array<bigint>")


# --- comparing ------------------------------------------------------------------------------------


def walk(probe: np.ndarray, n_probe: int, members: list[tuple[int, int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """(member, overlap) for the members linked with the probe: one walk over the members' prefix tree.

    The tree is the sorted list of the members' sequences; depth d of a sequence is a node that it shares
    with the sequence before it if their common prefix is longer than d."""
    found = []
    place = {t: k for k, t in enumerate(probe.tolist())}
    here = len(probe)
    sequences = sorted(((m, n, s.tolist()) for m, n, s in members), key=lambda x: x[2])
    before: list[int] = []
    overlap = [0]  # overlap[d]: with the first d of the sequence
    passed = [0]  # passed[d]: how many of the probe's own come before the d-th of the sequence
    dead, dead_needs = 1 << 60, 0  # the walk left the sequence before at this depth, for want of so much
    for member, n, seq in sequences:
        d = 0
        limit = min(len(before), len(seq), len(overlap) - 1)
        while d < limit and before[d] == seq[d]:
            d += 1
        wants = overlap_needed(n_probe, n, percent)
        before = seq
        if d >= dead and wants >= dead_needs and len(seq) <= dead_longest:
            continue  # below the node that was left, and in need of no less
        del overlap[d + 1 :], passed[d + 1 :]
        o, p, size = overlap[d], passed[d], len(seq)
        dead = 1 << 60
        while d < size:
            if o + min(size - d, here - p) < wants:
                dead, dead_needs, dead_longest = d, wants, size
                break
            at = place.get(seq[d])
            d += 1
            if at is not None:
                o, p = o + 1, at + 1
            overlap.append(o)
            passed.append(p)
        if dead == 1 << 60 and o >= wants:
            found.append((member, o))
    return found


def compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (probe, member) that are linked. Pairs are dealt by ranges, so that a probe with very many members has
    them in several parts, each with the probe's set; a part goes by groups of GROUP members."""
    pairs = written(pairs, "pairs")
    count = tasks(pairs.sparkSession)
    dealt = written(pairs.repartitionByRange(count, "probe", "member").withColumn("part", F.spark_partition_id()), "dealt")
    members = dealt.join(sets.withColumnRenamed("rep", "member"), "member").select("probe", "part", "member", "n", "shared")
    probes = dealt.select("probe", "part").distinct()
    probes = probes.join(sets.withColumnRenamed("rep", "probe"), "probe").select("probe", "part", F.lit(-1).cast("long").alias("member"), "n", "shared")
    rows = probes.unionByName(members).repartition(count, "probe", "part").sortWithinPartitions("probe", "part", "member")

    def linked(batches):
        import pyarrow as pa

        def result(out):
            columns = list(zip(*out, strict=True)) or [[], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["probe", "member"])

        key, probe, group = None, None, []
        for batch in batches:
            shared = batch.column("shared")
            values, at = shared.flatten().to_numpy(), np.concatenate([[0], np.cumsum(shared.value_lengths().to_numpy())])
            for k, (p, s, m, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("probe", "part", "member", "n")), strict=True)):
                seq = values[at[k] : at[k + 1]]
                if (p, s) != key:
                    if group:
                        yield result([(key[0], m_) for m_, _ in walk(*probe, group, percent)])
                    key, probe, group = (p, s), (seq, n), []
                else:
                    if len(group) >= GROUP:
                        yield result([(key[0], m_) for m_, _ in walk(*probe, group, percent)])
                        group = []
                    group.append((m, n, seq))
        if group:
            yield result([(key[0], m_) for m_, _ in walk(*probe, group, percent)])

    return rows.mapInArrow(linked, "probe long, member long")


# --- components -----------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for the nodes of edges (a, b), by star contraction in joins."""
    def both(e):
        return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e, small: bool):
        e = both(e)
        if small:
            e = e.where("b < a")
        least = e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        hung = e.join(least, "a")
        hung = hung.select(F.col("b").alias("x"), "m") if small else hung.where("b > a").select(F.col("b").alias("x"), "m")
        out = hung.unionByName(least.select(F.col("a").alias("x"), "m")) if small else hung
        return out.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()

    def mark(e):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while (now := mark(edges)) != seen and now[0]:
        seen = now
        edges = written(star(star(edges, small=False), small=True), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _salts():
    """How many parts a token's rows join in: from its level, which bounds how many rows there are."""
    most = F.pow(F.lit(2.0), (F.shiftright("token", LEVEL) + 1) / 2)
    return F.greatest(F.lit(1), F.ceil(most / SALT).cast("int"))


def _with_token(postings: DataFrame, by_token: DataFrame) -> DataFrame:
    """Each posting with the row of its token; a frequent token's rows meet copies of it in several tasks."""
    rows = postings.withColumn("salt", F.pmod(F.xxhash64("rep"), _salts()).cast("int"))
    return rows.join(by_token.withColumn("salt", F.explode(F.sequence(F.lit(0), _salts() - 1))), ["token", "salt"]).drop("salt")


def _hub_pairs(postings: DataFrame) -> DataFrame:
    """One pair (probe, member) per set: the hub that most of the set's posting lists have."""
    # A hub is the list's set with the fewest unshared shingles, then the smallest number.
    hubs = postings.groupBy("token").agg(F.min_by("rep", F.struct("unshared", "rep")).alias("hub"), F.count("*").alias("m")).where("m > 1").drop("m")
    met = _with_token(postings.select("token", "rep"), hubs).where("rep <> hub").groupBy("rep", "hub").count()
    return met.groupBy("rep").agg(F.max_by("hub", F.struct("count", -F.col("hub"))).alias("probe")).select("probe", F.col("rep").alias("member"))


def _rest_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of different components that share a posting list and pass the size and position bounds."""
    parts = postings.groupBy("token", "component").agg(F.count("*").alias("k"))
    mixed = parts.groupBy("token").agg(F.max_by("component", F.struct("k", "component")).alias("major"), F.max("k").alias("most"), F.sum("k").alias("m"), F.count("*").alias("parts"))
    mixed = mixed.where("parts > 1").select("token", "major", F.ceil(F.col("most") / BLOCK).cast("int").alias("big"), F.ceil((F.col("m") - F.col("most")) / BLOCK).cast("int").alias("small"))
    rows = _with_token(postings.select("token", "rep", "n", "place", "component"), mixed).withColumn("main", F.col("component") == F.col("major"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.when(F.col("main"), F.col("big")).otherwise(F.col("small"))).cast("int"))
    # (i, j): block i of the largest component with block j of the rest, or, with i below 0, block -i - 1 of the rest with j.
    up_to = lambda n: F.sequence(F.lit(0), n - 1)
    one = F.transform(up_to(F.col("small")), lambda j: F.struct(F.col("block").alias("i"), j.alias("j")))
    other = F.transform(up_to(F.col("big")), lambda i: F.struct(i.alias("i"), F.col("block").alias("j")))
    own = F.transform(up_to(F.col("small")), lambda j: F.struct((-F.least("block", j) - 1).alias("i"), F.greatest("block", j).alias("j")))
    rows = rows.withColumn("at", F.explode(F.when(F.col("main"), one).otherwise(F.concat(other, own))))
    rows = rows.select("token", "at.i", "at.j", F.when(F.col("main"), -1).otherwise(F.col("block")).alias("block"), "rep", "n", "place", "component")
    rows = rows.repartition(tasks(postings.sparkSession), "token", "i", "j").sortWithinPartitions("token", "i", "j")

    def pairs(batches):
        import pyarrow as pa

        def close(group):
            block, rep, n, place, component = (np.array(c, np.int64) for c in zip(*group, strict=True))
            across = block.min() != block.max()
            # Across blocks, from the smaller one to the other; row by row: memory stays that of the block.
            from_block = min((block.min(), block.max()), key=lambda b: (block == b).sum())
            for x in np.flatnonzero(block == from_block) if across else range(len(rep)):
                fits = (component != component[x]) & ((block != from_block) if across else (rep > rep[x]))
                wants = -(-percent * (n + n[x]) // (100 + percent))
                fits &= 1 + np.minimum(n - place - 1, n[x] - place[x] - 1) >= wants
                fits &= np.minimum(n, n[x]) >= wants
                if fits.any():
                    hit, mine = rep[fits], rep[x]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(hit, mine)), pa.array(np.maximum(hit, mine))], ["probe", "member"])

        key, group = None, []
        for batch in batches:
            for token, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (token, i, j) != key:
                    if group:
                        yield from close(group)
                    key, group = (token, i, j), []
                group.append(row)
        if group:
            yield from close(group)

    return rows.mapInArrow(pairs, "probe long, member long").distinct()


def link(docs: DataFrame, words: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(staged documents as doc, with _class binary; one row per class: _class, n long, component long,
    component_id). component is the number of the component's first representative, component_id the
    smallest doc_id; both null for empty sets, which are linked with nothing."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    staged = stage(rows.withColumn("_class", F.unhex(F.sha2(text_or_empty("doc.text"), 256))), "jaccard")
    classes = staged.select("_class", row_id().alias("_row"), F.col("doc.doc_id").alias("doc_id"))
    classes = written(classes.groupBy("_class").agg(F.min("doc_id").alias("least"), F.min("_row").alias("rep")), "classes")
    sets = written(representative_sets(staged, classes, words, percent), "sets")
    able = sets.where(F.col("shared").isNotNull())
    least = F.ceil(F.col("n") * percent / 100).cast("int")
    unshared = F.col("n") - F.size("shared")
    first = F.col("n") - least + 1 - unshared
    postings = able.withColumn("unshared", unshared).select("rep", "n", "unshared", F.posexplode(F.slice("shared", F.lit(1), first)).alias("at", "token"))
    postings = written(postings.select("token", "rep", "n", "unshared", (F.col("at") + F.col("unshared")).alias("place")), "postings")
    links = written(compare(_hub_pairs(postings), able, percent), "links")
    found = components(links.toDF("a", "b"))
    labelled = postings.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    rest = written(_rest_pairs(labelled, percent), "rest")
    more = compare(rest, able, percent).toDF("a", "b")
    whole = written(components(links.toDF("a", "b").unionByName(more)), "components")
    named = classes.join(sets.select("rep", F.col("n").cast("long").alias("n")), "rep").join(whole.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.withColumn("component", F.when(F.col("n") > 0, F.coalesce("component", "rep")))
    names = named.where("n > 0").groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(names, "component", "left").select("_class", "n", "component", "component_id")
    return staged, named


def component_report(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles long, component_id: one row per row of docs."""
    staged, named = link(docs.select("doc_id", "text"), words, percent)
    rows = staged.select(F.col("doc.doc_id").alias("doc_id"), "_class").join(named, "_class")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component the row with the smallest
    doc_id (of rows that repeat it, one); all rows without words."""
    staged, named = link(docs, words, percent)
    rows = staged.select("_class", row_id().alias("_row"), F.col("doc.doc_id").alias("doc_id")).join(named, "_class")
    first = F.min_by("_row", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    kept = rows.where("n > 0").groupBy("component").agg(first.alias("_row")).select("_row").unionByName(rows.where("n = 0").select("_row"))
    kept = written(kept, "kept")
    marks = kept.select(F.shiftright("_row", 33).cast("int").alias("sender"), F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)).cast("int").alias("docno"))
    return staged.join(marks.hint("shuffle_hash"), ["sender", "docno"], "left_semi").select("doc.*")
