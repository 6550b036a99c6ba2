"""Token counts by a compiled finite-state tokenizer.

``Transducer`` is the byte-pair encoder as a deterministic transducer, determinised while it runs (like a
lazy regular-expression matcher). After reading a prefix of a pre-token, the only thing the future depends
on is, for every position from which a longer vocabulary entry may still be spelt (a *live start*): the
vocabulary trie's node reached from there, the last token of the encoding up to there, and how many tokens
that encoding has compared with the encoding of the whole prefix. That tuple is a state. It is finite
because entries are; a transition carries the change of the emitted-token count. Which token ends a
prefix is decided by adjacent pairs: a sequence of tokens is the encoding of its text exactly if every
adjacent pair is the encoding of its own text.

``Machine`` puts the split into pre-tokens around it: a state of the whole transducer is what kind of pre-token is
being read, the transducer's state in it, and the few characters whose place is not yet settled (white space
before a word, an apostrophe before a contraction's letters). Arcs that whole pre-tokens spell from a settled
place to the next are remembered as one arc.

Every text is cut into chunks, wherever the cut falls. A chunk's *state map* says for any state in which the chunk
may be entered in which state it is left and how many tokens are emitted. From the first place where all states
agree (a pre-token starts there whatever came before) the map is constant, so it holds the characters up to there,
which are run from the state of entry, the tokens from there on, and the state at the end. A chunk without
such a place (a run of one kind of characters) holds a table of entries instead: it is run from the state that the
text before it most likely leaves, and from another one only if the composition comes with another. Maps
compose to maps, pairwise in a balanced tree, and the text's map is applied to the starting state.

A text of up to ``LONG`` characters is mapped in the task that scanned its row; nothing is shuffled. The pieces of
longer ones are dealt over tasks, each gives its map, and only maps meet, in the order of the pieces. Memory is
bounded by one Arrow batch plus the two-generation memory of pre-tokens and the state limit.

Nulls: a null text counts as empty (0 bytes, 0 tokens); a null doc_id is kept. Repeated rows give a row
each, an empty table none, other columns are ignored.
"""

from __future__ import annotations

import bisect
import pickle

from pyspark.sql import DataFrame

from pyspark.sql import functions as F

from . import bpe
from .common import cache, tasks, text_or_empty, written

#: Characters of a chunk.
CHUNK = 1 << 12
#: Characters of a piece of a text that several tasks share.
LONG = 1 << 16
#: Characters before a chunk that guess the state in which it is entered.
BEFORE = 64


class Transducer:
    """States are numbers; ``arcs[state]`` maps a byte to (next state, change of the token count)."""

    def __init__(self, compiled: dict, state_limit: int = 300_000):
        self.id_of, merges = bpe.spelt_vocabulary(compiled)
        self.bytes_of = {i: b for b, i in self.id_of.items()}
        self.rank = {pair: k for k, pair in enumerate(merges)}
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for b, i in self.id_of.items():
            node = 0
            for x in b:
                if x not in self.children[node]:
                    self.children[node][x] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = self.children[node][x]
            self.token_at[node] = i
        self.pairs: dict[tuple[int, int], bool] = {}
        self.spines: dict[tuple[bytes, int], list[tuple[bytes, int]] | None] = {}
        self.state_limit = state_limit
        self._forget()

    def _forget(self):
        # A live start is (trie node, last token before it, tokens before it less tokens of the prefix).
        self.states = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.arcs: list[dict[int, tuple[int, int]]] = [{}]

    def merge(self, text: bytes) -> tuple[list[bytes], tuple | None]:
        """Byte-pair encoding by definition: again and again merge the leftmost pair of the lowest rank. (parts, the last
        merge as (rank, left, right))"""
        parts, last = [text[k : k + 1] for k in range(len(text))], None
        while len(parts) > 1:
            rank, k = min((self.rank.get((a, b), 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            last = rank, parts[k], parts[k + 1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts, last

    def spine(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The parts that stand at an end of a token while it is merged, longest first (side 0: its start, 1: its end), each
        with the rank of the merge that takes it up. None if the token isn't the encoding of its own text."""
        key = (token, side)
        if key not in self.spines:
            parts, last = self.merge(token)
            self.spines[key] = None if len(parts) > 1 else [(token, 1 << 60)]
            if last is not None and len(parts) == 1:
                (inner, _), *more = self.spine(last[1 + side], side)
                self.spines[key] += [(inner, last[0]), *more]
        return self.spines[key]

    def adjacent(self, left: int, right: int) -> bool:
        """Can the two tokens stand side by side in an encoding? left is -1 at a pre-token's start. Merges come in the order
        of ranks, so a merge across the border needs a part of either side that isn't taken up before; of equal
        merges the leftmost comes first."""
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            end = self.spine(self.bytes_of[left], 1) if left >= 0 else []
            start, rank = self.spine(self.bytes_of[right], 0), self.rank
            found = end is not None and start is not None
            if found:
                found = not any((r := rank.get((x, y))) is not None and r < takes_x and r <= takes_y for x, takes_x in end for y, takes_y in start)
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            self.pairs[key] = found
        return found

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """The arc of a state for a byte, made when it is first asked for."""
        live, last, count = [], None, 0
        for node, before, n in self.states[state]:
            to = self.children[node].get(byte)
            if to is None:
                continue
            token = self.token_at[to]
            if last is None and token >= 0 and self.adjacent(before, token):
                last, count = token, n + 1
            if self.children[to]:
                live.append((to, before, n))
        if last is None:
            raise ValueError("the vocabulary lacks a byte")
        key = (*((node, before, n - count) for node, before, n in live), (0, last, 0))
        to = self.number_of(key)
        arc = self.arcs[state][byte] = (to, count)
        return arc

    def number_of(self, key: tuple) -> int:
        """The state's number; states come with maps from elsewhere as what they are."""
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            self.arcs.append({})
        return to

    def run(self, key: tuple, text: str) -> tuple[tuple, int]:
        """(the state after the text, tokens that the arcs emit)"""
        if len(self.states) > self.state_limit:
            self._forget()
        state, n = self.number_of(key), 0
        for byte in text.encode():
            arc = self.arcs[state].get(byte) or self.step(state, byte)
            state = arc[0]
            n += arc[1]
        return self.states[state], n

    def count(self, word: str) -> int:
        """Tokens of one pre-token: the sum of what the arcs emit."""
        if len(self.states) > self.state_limit:
            self._forget()
        arcs, state, n = self.arcs, 0, 0
        for byte in word.encode():
            arc = arcs[state].get(byte) or self.step(state, byte)
            state = arc[0]
            n += arc[1]
        return n


class Machine:
    """The split into pre-tokens and the transducer in one: states are (kind, transducer's state, characters that
    are not settled). Kinds: L, N, O, in a run of letters, numbers, others; W, in white space, whose last character is
    not settled; A, after an apostrophe that may open a contraction, with a letter of it or without."""

    START = ("S", ((0, -1, 0),), "")
    SHORT, TWO = "stmd", {"r": "e", "v": "e", "l": "l"}

    def __init__(self, compiled: dict, transducer: Transducer):
        import regex

        letter, number = bpe.letters_numbers(compiled)
        self.transducer = transducer
        kinds = (("L", letter), ("N", number), ("W", r"\s"))
        self.tests = [(k, regex.compile(p, regex.V1).fullmatch) for k, p in kinds]
        self.kinds: dict[str, str] = {}
        self.rest = {k: regex.compile(p + "*", regex.V1).match for k, p in (("L", letter), ("N", number), ("O", rf"[^\s{letter}{number}]"))}

    def kind(self, c: str) -> str:
        found = self.kinds.get(c)
        if found is None:
            found = next((k for k, test in self.tests if test(c)), "O")
            if len(self.kinds) < 10_000:
                self.kinds[c] = found
        return found

    def run(self, state: tuple, text: str) -> tuple[tuple, int]:
        """(the state after the text, tokens emitted)"""
        kind, inner, held = state
        start, feed = self.START[1], self.transducer.run
        n = at = 0
        while at < len(text):
            c = text[at]
            k = self.kind(c)
            if kind in "LNO":
                if k == kind:  # as much of the run as there is
                    end = self.rest[kind](text, at).end()
                    inner, more = feed(inner, text[at:end])
                    n, at = n + more, end
                    continue
                kind, inner, held = self.START
            if kind == "W":
                if k == "W":
                    inner, more = feed(inner, held)
                    n, held, at = n + more, c, at + 1
                    continue
                # All but the last white space is a pre-token of its own; a last space goes with what follows.
                if held == " ":
                    inner, more = feed(start, held)
                    kind = k
                else:
                    more = feed(start, held)[1]
                    kind, inner = "S", start
                n, held = n + more, ""
                continue
            if kind == "A":
                if held == "'" and c in self.SHORT or len(held) == 2 and self.TWO[held[1]] == c:
                    n += feed(start, held + c)[1]
                    kind, inner, held, at = "S", start, "", at + 1
                    continue
                if held == "'" and c in self.TWO:
                    held, at = held + c, at + 1
                    continue
                inner, more = feed(start, "'")
                kind, n = "O", n + more
                if len(held) == 2:  # the letter opens a pre-token
                    inner, more = feed(start, held[1])
                    kind, n = "L", n + more
                held = ""
                continue
            # At a pre-token's start.
            if k == "W":
                kind, inner, held, at = "W", start, c, at + 1
            elif c == "'":
                kind, inner, held, at = "A", start, c, at + 1
            else:
                kind, inner, held = k, start, ""
        return (kind, inner, held), n

    def close(self, state: tuple) -> int:
        """Tokens that the end of the text emits."""
        kind, inner, held = state
        if kind == "W":
            return self.transducer.run(inner, held)[1]
        if kind == "A":
            return sum(self.transducer.run(self.START[1], c)[1] for c in held)
        return 0


class StateMap:
    """What a text does to the state in which it is entered. With an agreed place: head is the text up to there, n counts
    the tokens after it, exit is the state at the end. Without one head is the whole text and exit None. table
    holds entries that are known: {entry: (exit, tokens)}."""

    def __init__(self, head: str, n: int, exit: tuple | None, table: dict):
        self.head, self.n, self.exit, self.table = head, n, exit, table

    def __call__(self, machine: Machine, entry: tuple) -> tuple[tuple, int]:
        found = self.table.get(entry)
        if found is None:
            state, n = machine.run(entry, self.head)
            found = (state, n) if self.exit is None else (self.exit, n + machine.close(state) + self.n)
            if self.exit is None:
                self.table[entry] = found
        return found

    def then(self, machine: Machine, other: StateMap) -> StateMap:
        """The map of this text and the other's after it."""
        table = {}
        for entry, (state, n) in self.table.items():
            state, more = other(machine, state)
            table[entry] = state, n + more
        if self.exit is not None:
            state, more = other(machine, self.exit)
            return StateMap(self.head, self.n + more, state, table)
        return StateMap(self.head + other.head, other.n, other.exit, table)

    def told(self) -> tuple:
        return self.head, self.n, self.exit, self.table


class Counter:
    """Counts tokens of whole texts by the state maps of their chunks."""

    def __init__(self, compiled: dict, chunk: int = CHUNK):
        import regex

        self.transducer = Transducer(compiled)
        self.machine = Machine(compiled, self.transducer)
        self.special, self.specials, self.chunk = bpe.special_splitter(compiled), list(compiled["specials"]), chunk
        self.run = bpe.Pieces(bpe.splitter(compiled), self.transducer.count, sum)
        # Places at which a pre-token starts whatever came before: white space after something else, the last white
        # space before something else, and a change of kind, but for letters that an apostrophe may take.
        letter, number = bpe.letters_numbers(compiled)
        other = rf"[^\s{letter}{number}]"
        places = [r"(?<=\S)(?=\s)", r"(?=\s\S)", rf"(?<={letter})(?=[^\s{letter}])", rf"(?<={number})(?=[^\s{number}])", rf"(?<={other})(?={number})", rf"(?<=[{other}--[']])(?={letter})"]
        self.agree = regex.compile("|".join(places), regex.V1)
        self.agree_quick = regex.compile(r"(?<=\S)(?=\s)")
        self.agree_last = regex.compile(r"(?r)(?<=\S)(?=\s)")
        self.agree_end = regex.compile(f"(?r)(?:{'|'.join(places)})", regex.V1)

    def chunk_map(self, text: str, before: str = "") -> StateMap:
        """The map of a chunk; before is what stands right before it, for a guess."""
        first = self.agree_quick.search(text)
        if first is not None:
            last = self.agree_last.search(text)
        else:
            first, last = self.agree.search(text), self.agree_end.search(text)
        if first is None:
            guess = self.machine.run(self.machine.START, before)[0]
            return StateMap(text, 0, None, {guess: self.machine.run(guess, text)})
        a, b = first.start(), last.start()
        exit, n = self.machine.run(self.machine.START, text[b:])
        return StateMap(text[:a], self.run(text[a:b]) + n, exit, {})

    def map_of(self, text: str, before: str = "") -> StateMap:
        """The map of a whole text: chunk by chunk, composed in a balanced tree."""
        if len(text) <= self.chunk:
            return self.chunk_map(text, before)
        cuts = range(0, len(text), self.chunk)
        maps = [self.chunk_map(text[k : k + self.chunk], text[max(0, k - BEFORE) : k] or before) for k in cuts]
        while len(maps) > 1:
            maps = [maps[k].then(self.machine, maps[k + 1]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        return maps[0]

    def plain(self, text: str) -> int:
        exit, n = self.map_of(text)(self.machine, self.machine.START)
        return n + self.machine.close(exit)

    def __call__(self, text: str) -> int:
        if not any(s in text for s in self.specials):
            return self.plain(text)
        n = at = 0
        for m in self.special.finditer(text):
            n += self.plain(text[at : m.start()]) + 1
            at = m.end()
        return n + self.plain(text[at:])

    def pieces(self, text: str, size: int) -> list[tuple[str, str]]:
        """(what stands right before, piece) of about size characters; special strings are not cut."""
        cuts = list(range(size, len(text), size))
        if any(s in text for s in self.specials):
            spans = [m.span() for m in self.special.finditer(text)]
            firsts = [a for a, _ in spans]
            for k, cut in enumerate(cuts):
                at = bisect.bisect_right(firsts, cut) - 1
                if at >= 0 and cut < spans[at][1]:
                    cuts[k] = firsts[at]
            cuts = sorted(set(cuts) - {0})
        return [(text[max(0, a - BEFORE) : a], text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]

    def parts(self, text: str, before: str = "") -> list[tuple | None]:
        """A piece as what its maps tell, and None for each special string in it."""
        out, at = [], 0
        if any(s in text for s in self.specials):
            for m in self.special.finditer(text):
                out += [self.map_of(text[at : m.start()], "" if at else before).told(), None]
                at = m.end()
        return [*out, self.map_of(text[at:], "" if at else before).told()]

    def total(self, pieces: list[list[tuple | None]]) -> int:
        """Tokens of a text, from its pieces' parts in order."""
        state, n = self.machine.START, 0
        for part in (p for parts in pieces for p in parts):
            if part is None:
                n, state = n + self.machine.close(state) + 1, self.machine.START
            else:
                state, more = StateMap(*part)(self.machine, state)
                n += more
        return n + self.machine.close(state)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, chunk: int = CHUNK, long: int = LONG) -> DataFrame:
    """doc_id, n_bytes long, n_tokens long, over_limit boolean (n_tokens > limit), one row per row of docs."""
    compiled = bpe.compile_tokenizer(tokenizer_path)
    name = f"token_counter_{chunk}_{hash(compiled['json'])}"
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]

    def size(text: str) -> int:
        return len(text) if text.isascii() else len(text.encode())

    def count(batches):
        import pyarrow as pa

        counter = cache(name, lambda: Counter(compiled, chunk))
        for batch in batches:
            ids, texts = batch.columns
            texts = texts.to_pylist()
            n = [counter(t) for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array([size(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names)

    def cut(batches):
        import pyarrow as pa

        counter = cache(name, lambda: Counter(compiled, chunk))
        for batch in batches:
            for row, doc_id, text in zip(*batch.columns, strict=True):
                text = text.as_py()
                found = counter.pieces(text, long)
                columns = [pa.array([row.as_py()] * len(found), pa.int64()), pa.array(range(len(found)), pa.int32()), pa.array([doc_id.as_py()] * len(found), pa.int64())]
                columns += [pa.array([size(text)] * len(found), pa.int64()), pa.array([b for b, _ in found]), pa.array([p for _, p in found])]
                yield pa.RecordBatch.from_arrays(columns, ["row", "piece", "doc_id", "n_bytes", "before", "text"])

    def mapped(batches):
        import pyarrow as pa

        counter = cache(name, lambda: Counter(compiled, chunk))
        for batch in batches:
            told = [pickle.dumps(counter.parts(t.as_py(), b.as_py())) for b, t in zip(batch.column("before"), batch.column("text"), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(told, pa.binary())], ["row", "piece", "doc_id", "n_bytes", "maps"])

    def composed(table):
        import pyarrow as pa

        counter = cache(name, lambda: Counter(compiled, chunk))
        table = table.sort_by("piece")
        n = counter.total([pickle.loads(m.as_py()) for m in table["maps"]])
        return pa.table([table["doc_id"][:1], table["n_bytes"][:1], pa.array([n], pa.int64()), pa.array([n > limit], pa.bool_())], names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_or_empty().alias("text"))
    whole = rows.where(F.length("text") <= long).select("doc_id", "text").mapInArrow(count, schema)
    pieces = written(rows.where(F.length("text") > long).mapInArrow(cut, "row long, piece int, doc_id long, n_bytes long, before string, text string"), "pieces")
    maps = pieces.repartition(tasks(docs.sparkSession), "row", "piece").mapInArrow(mapped, "row long, piece int, doc_id long, n_bytes long, maps binary")
    return whole.unionByName(maps.groupBy("row").applyInArrow(composed, schema))
