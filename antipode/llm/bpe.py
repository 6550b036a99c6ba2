"""Byte-pair tokenisation of whole texts through a bounded memory of pre-tokens.

``compile_tokenizer`` reads a tokenizers ``.json`` file on the driver into a plain dictionary that tasks
receive; the vocabulary file itself is never copied into the repository.
"""

from __future__ import annotations

import json
import re
import sys
import types

LETTER, NUMBER = r"\p{L}", r"\p{N}"
#: The split pattern of byte-level BPE as published with its vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s{L}{N}]+|\s+(?!\S)|\s+"


def compile_tokenizer(path: str) -> dict:
    """The file's text, its special strings, and the split pattern with the library's own Unicode classes. Callers
    share the result and don't change it. What is kept lies outside this module, which travels to workers by value."""
    held = sys.modules.setdefault("_antipode_compiled", types.ModuleType("_antipode_compiled")).__dict__.setdefault("files", {})
    if path not in held:
        held[path] = _compile(path)
    return held[path]


def _compile(path: str) -> dict:
    """The library and the ``regex`` module know different Unicode versions; code points that they class
    differently are found by two probe strings over all assigned planes and taken out of the pattern."""
    import regex
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        text = f.read()
    spec = json.loads(text)
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["model"].get("type") != "BPE":
        raise ValueError("only byte-level BPE files without a normaliser are supported")
    split = Tokenizer.from_str(text).pre_tokenizer
    points = [cp for cp in (*range(0x80, 0xD800), *range(0xF900, 0x34000), 0xE0001, *range(0xE0020, 0xE01F0)) if not chr(cp).isspace()]
    joined, known = {"a": set(), "1": set()}, {"a": set(), "1": set()}
    for probe, kind in (("a", LETTER), ("1", NUMBER)):  # "ax" stays one piece if x is a letter, "1x" if x is a number
        for a in range(0, len(points), 4096):
            part = points[a : a + 4096]
            pieces = split.pre_tokenize_str(" ".join(probe + chr(cp) for cp in part))
            starts = {a for _, (a, b) in pieces if b - a == 3 or (a == 0 and b == 2)}
            joined[probe].update(cp for k, cp in enumerate(part) if (0 if k == 0 else 3 * k - 1) in starts)
        known[probe].update(ord(c) for c in regex.findall(kind, "".join(map(chr, points))))
    odd = {p: (sorted(known[p] - joined[p]), sorted(joined[p] - known[p])) for p in known}
    return {
        "json": text,
        "specials": {t["content"]: t["id"] for t in spec.get("added_tokens", [])},
        "drop": {p: _ranges(odd[p][0]) for p in odd},
        "add": {p: _ranges(odd[p][1]) for p in odd},
    }


def _ranges(points: list[int]) -> list[list[int]]:
    out: list[list[int]] = []
    for cp in points:
        if out and out[-1][1] == cp - 1:
            out[-1][1] = cp
        else:
            out.append([cp, cp])
    return out


def _chars(ranges) -> str:
    return "".join(rf"\U{a:08X}-\U{b:08X}" for a, b in ranges)


def letters_numbers(compiled: dict) -> tuple[str, str]:
    """The library's classes of letters and numbers, as sets of the ``regex`` module's version 1."""
    out = []
    for p, kind in (("a", LETTER), ("1", NUMBER)):
        keep = f"[{kind}--[{_chars(compiled['drop'][p])}]]" if compiled["drop"][p] else f"[{kind}]"
        out.append(f"[{keep}||[{_chars(compiled['add'][p])}]]" if compiled["add"][p] else keep)
    return out[0], out[1]


def splitter(compiled: dict):
    """A function from a text without special strings to its pre-tokens."""
    import regex

    plain = regex.compile(SPLIT.replace("{L}", LETTER).replace("{N}", NUMBER)).findall
    odd = [r for kind in ("drop", "add") for p in "a1" for r in compiled[kind][p]]
    if not odd:
        return plain
    odd_chars = regex.compile(f"[{_chars(odd)}]").search
    letter, number = letters_numbers(compiled)
    exact = rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?[^\s{letter}{number}]+|\s+(?!\S)|\s+"
    exact = regex.compile(exact, regex.V1).findall

    def split(text: str) -> list[str]:
        return plain(text) if text.isascii() or not odd_chars(text) else exact(text)

    return split


def special_splitter(compiled: dict):
    """A regex that finds special strings, or None; the library takes them out before it splits a text."""
    import regex

    names = sorted(compiled["specials"], key=len, reverse=True)
    return regex.compile("|".join(map(regex.escape, names))) if names else None


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, the others
    are numbered from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    out = {chr(b): b for b in own}
    for k, b in enumerate(b for b in range(256) if b not in set(own)):
        out[chr(256 + k)] = b
    return out


def spelt_vocabulary(compiled: dict) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]]]:
    """Ids by bytes, and the merges in their order."""
    model, alphabet = json.loads(compiled["json"])["model"], byte_alphabet()
    spell = lambda t: bytes(alphabet[c] for c in t)
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return {spell(t): i for t, i in model["vocab"].items()}, [(spell(a), spell(b)) for a, b in merges]


def merge_ranks(compiled: dict) -> dict[bytes, int]:
    """Ids by bytes, which are ranks too if every merge makes the next id; other files are refused."""
    ids, merges = spelt_vocabulary(compiled)
    made = [ids[a + b] for a, b in merges]
    if made != sorted(set(made)) or any(len(b) > 1 and i < made[0] for b, i in ids.items()):
        raise ValueError("the vocabulary isn't numbered in the order of its merges")
    return ids


class Memory(dict):
    """What each pre-token came to: two generations of at most ``limit`` entries, so memory is bounded.
    ``make`` computes a missing entry; pre-tokens over ``longest`` characters are never kept."""

    def __init__(self, make, limit: int = 400_000, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, word: str):
        found = self.old[word] if word in self.old else self.make(word)
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


class Pieces:
    """What a text without special strings comes to, by its pieces between single spaces.

    A pre-token never runs from something else into a space, so a piece and the space before it can be
    looked up as a whole, and the split pattern runs over new pieces only. That fails where a space meets
    white space or the end after it; such a piece is kept as None, which ``total`` can't take, and the
    text then goes through the split pattern as a whole."""

    def __init__(self, split, of_word, total, of_ascii=None, limit: int = 400_000):
        self.split, self.total = split, total
        self.of_ascii = of_ascii or self.plain
        self.words = Memory(of_word, limit)
        self.pieces = Memory(self._piece, limit)

    def plain(self, text: str):
        return self.total(map(self.words.__getitem__, self.split(text)))

    def _piece(self, piece: str):
        if not piece or piece[0].isspace():
            return None
        return (self.of_ascii if piece.isascii() else self.plain)(" " + piece)

    def __call__(self, text: str):
        first, space, rest = text.partition(" ")
        if not space:
            return self.plain(text)
        try:
            return self.plain(first) + self.total(map(self.pieces.__getitem__, rest.split(" ")))
        except TypeError:
            return self.plain(text)


#: Other than plain white space, printable ASCII and the Latin blocks to U+024F, whose letters and numbers are the same
#: in every version of Unicode in use.
UNSAFE = "[^\t\n\r -~\u00a1-\u024f]"
#: Characters of a text that the quicker library splits itself; its pattern matcher has a stack.
WHOLE = 1 << 16


class Encoder:
    """Whole texts to their ids as little-endian unsigned 32-bit bytes, as the library gives them. ASCII texts, long ones
    and those with other scripts go by the memory of pieces, other Latin ones through the quicker library at once."""

    def __init__(self, compiled: dict):
        import struct

        import tiktoken

        # The file's merges run in the library that is quickest for short strings. All versions of Unicode
        # agree on ASCII and Latin, so there it may split too; other pieces are split by the pattern above.
        def merger(pattern: str):
            merge = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=merge_ranks(compiled), special_tokens={}).encode_ordinary

            def ids(word: str) -> bytes:
                found = merge(word)
                return struct.pack(f"<{len(found)}I", *found)

            return ids

        self.special = special_splitter(compiled)
        self.specials = {k: struct.pack("<I", v) for k, v in compiled["specials"].items()}
        self.whole = merger(SPLIT.replace("{L}", LETTER).replace("{N}", NUMBER))
        self.pieces = Pieces(splitter(compiled), merger(r"(?s:.+)"), b"".join, self.whole)
        self.unsafe = re.compile(UNSAFE).search

    def plain(self, text: str) -> bytes:
        if text.isascii() or len(text) > WHOLE or self.unsafe(text):
            return self.pieces(text)
        return self.whole(text)

    def __call__(self, text: str) -> bytes:
        if not any(s in text for s in self.specials):
            return self.plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self.plain(text[at : m.start()]), self.specials[m[0]]]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])
