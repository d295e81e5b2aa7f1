"""BPE as a tokenization automaton: encode by arcs, decode by arc labels.

The merge list is compiled by applying one *merge gadget* per rule, in rank order, to a deterministic
automaton whose arcs are labelled with tokens. It starts with one state that loops on every base symbol.
The gadget of rule ``(u, v) -> w`` does two things:

* the state that ``u`` leads to is replaced by a copy that lacks the ``v`` arc, because ``u v`` is merged from now on;
* every state that has a ``u`` arc into a state with a ``v`` arc gets a ``w`` arc to where that ``v`` arc led.

By induction all arcs of one label lead to one state, so there is one state per token, and the state of ``w``
starts as the state of ``v`` at that rank. The automaton is therefore stored as differences: for each state the
arcs that a gadget removed with the rank of the removal, and for each token the two tokens it was made of. Arc
``p --t-->`` exists unless some gadget removed it while the right edge of ``p`` and the left edge of ``t`` still
were separate symbols. Rows of the transition table are filled on first use from these differences.

Each string has exactly one accepting path, so every reachable position of a word belongs to one state. Encoding
follows the arcs, longest label first, and never visits a position twice: time is linear in the word's length.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable
from functools import lru_cache

#: Code points that the tokenizer's ``\s`` takes for white space, and that str.split() also splits at.
NOT_SPACE = "\x1c\x1d\x1e\x1f"
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES = re.compile(f"[{_SPACE}]+")
END_OF_WORD = "</w>"


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


#: Added to the code of a word's last symbol.
_LAST = 0x1000
#: Symbols looked at in one step.
_WINDOW = 5

#: Letters and numbers that Unicode 16 has and older tables lack, and its new pairs of cases.
_LETTERS_16 = ((0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0))
_NUMBERS_16 = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))


def _ranges(kind: str, more: tuple) -> str:
    """The inside of a character class: code points of a general category."""
    have = sorted({c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == kind} | {c for a, b in more for c in range(a, b + 1)})
    runs: list[list[int]] = []
    for c in have:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs)


@lru_cache(maxsize=1)
def _pattern() -> re.Pattern:
    """What the pre-tokenizer keeps: contractions, runs of letters, single numbers, runs of anything else but spaces."""
    letter, number = _ranges("L", _LETTERS_16), _ranges("N", _NUMBERS_16)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{_SPACE}{letter}{number}]+")


#: Capitals of Unicode 16 and 17 (first, last, step, distance to the small letter).
_CASES_17 = ((0x1C89, 0x1C89, 1, 1), (0xA7CB, 0xA7CB, 1, -42343), (0xA7CC, 0xA7D4, 2, 1), (0xA7DA, 0xA7DA, 1, 1), (0xA7DC, 0xA7DC, 1, -42561), (0x10D50, 0x10D65, 1, 32), (0x16EA0, 0x16EB8, 1, 27))
_NEW_CAPITALS = re.compile("[\ua7cb-\ua7dc\u1c89\U00010d50-\U00010d65\U00016ea0-\U00016eb8]")


class MergeAutomaton:
    """Automaton over tokens, compiled from an ordered merge list.

    ``labels``: token id -> label; ``merges``: pairs of labels in rank order. Only tokens that the merges make,
    and single symbols, get arcs.
    """

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], end: str = END_OF_WORD):
        self.size = max(vocab.values(), default=0) + 1
        self.removed: dict[int, int] = {}  # u * size + v -> rank of the gadget that removed arc v from u's state
        self.made: dict[int, tuple[int, int, int]] = {}  # w -> (u, v, rank)
        for rank, (u, v) in enumerate(merges):
            self._gadget(vocab[u], vocab[v], vocab[u + v], rank)
        self.end = end
        self.root: dict = {}  # the labels by their symbols; a token's id stands under "" of its last node
        for t, i in vocab.items():
            symbols = self.symbols(t.removesuffix(end)) if end and t.endswith(end) and t != end else t
            if i in self.made or len(symbols) == 1:
                node = self.root
                for c in symbols:
                    node = node.setdefault(c, {})
                node[""] = i
        self._left: dict[int, tuple] = {}
        self._right: dict[int, tuple] = {}
        self.table: dict[int, bool] = {}
        self.starts = _Recent(self._starts, 100_000)

    def symbols(self, word: str) -> str:
        """The word with a last symbol of its own kind, where the merges know an end of word."""
        return word[:-1] + chr(ord(word[-1]) + _LAST) if self.end else word

    def _gadget(self, u: int, v: int, w: int, rank: int) -> None:
        self.removed.setdefault(u * self.size + v, rank)
        self.made.setdefault(w, (u, v, rank))

    def _edge(self, t: int, side: int, memo: dict) -> tuple:
        """The symbols at one edge of a token, outermost last, each with the rank at which it is merged away."""
        got = memo.get(t)
        if got is None:
            out, rank, x = [], sys.maxsize, t
            while True:
                out.append((x, rank))
                if x not in self.made:
                    break
                part = self.made[x]
                x, rank = part[side], part[2]
            got = memo[t] = tuple(out)
        return got

    def arc(self, state: int, token: int) -> bool:
        """Whether the state of token ``state`` has an arc labelled ``token``. One entry of the table."""
        key = state * self.size + token
        got = self.table.get(key)
        if got is None:
            removed, size, got = self.removed, self.size, True
            left = self._edge(token, 0, self._left)
            for y, until in self._edge(state, 1, self._right):
                for x, upto in left:
                    rank = removed.get(y * size + x)
                    # of equal ranks the leftmost pair is merged first: it wins against its right neighbour only
                    if rank is not None and rank < until and rank <= upto:
                        got = False
                        break
                if not got:
                    break
            if len(self.table) > 1_000_000:  # the rows can be computed again: bounds memory, not results
                self.table.clear()
            self.table[key] = got
        return got

    def _starts(self, window: str) -> tuple:
        """The arcs that can begin a window of symbols, longest first, and where longer labels go on, if any do."""
        node, arcs = self.root, ()
        for k, c in enumerate(window, 1):
            node = node.get(c)
            if node is None:
                break
            if "" in node:
                arcs = (node[""], k, arcs)
        return arcs, node if node and len(window) == _WINDOW and (len(node) > 1 or "" not in node) else None

    def walk(self, word: str) -> list[int]:
        """Tokens of the accepting path of a word of symbols. Arcs are chains (token, length, shorter arcs)."""
        table, size, n, starts = self.table, self.size, len(word), self.starts
        out, tried, dead, state, i = [], [], None, -1, 0
        while i < n:
            arcs, node = starts[word[i : i + _WINDOW]]
            if node is not None:
                k = i + _WINDOW
                while k < n and (node := node.get(word[k])) is not None:
                    k += 1
                    if "" in node:
                        arcs = (node[""], k - i, arcs)
            while True:
                if arcs:
                    token, k, arcs = arcs
                    if dead and i + k in dead:
                        continue
                    if state < 0:
                        break
                    there = table.get(state * size + token)
                    if there or there is None and self.arc(state, token):
                        break
                elif out:
                    dead = dead or set()
                    dead.add(i)
                    out.pop()
                    i, arcs = tried.pop()
                    state = out[-1] if out else -1
                else:
                    raise ValueError(f"no path for {word!r}")
            out.append(token)
            tried.append((i, arcs))
            i, state = i + k, token
        return out


def chunks(text: str) -> list[str]:
    """The text's parts between white space."""
    if any(c in text for c in NOT_SPACE):
        return [c for c in _SPACES.split(text) if c]
    return text.split()


def _lower(text: str) -> str:
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    if "Σ" in text or _NEW_CAPITALS.search(text):  # one code point at a time: the tokenizer knows no context such as a final sigma
        return "".join(map(_one_lower, text))
    return text.lower()


def _one_lower(c: str) -> str:
    return next((chr(ord(c) + d) for a, b, step, d in _CASES_17 if a <= ord(c) <= b and (ord(c) - a) % step == 0), None) or c.lower()


def pieces(chunk: str) -> list[str] | tuple[str, ...]:
    """The words of a chunk without white space and special tokens, as they are merged: composed, in lower case."""
    low = _lower(chunk)
    if low.isalpha():
        return (low,)
    if (head := low[:-1]).isalpha() and (last := low[-1]).isascii() and not last.isalnum():  # a word and one mark
        return head, last
    return _pattern().findall(low)


class _Recent(dict):
    """What ``make`` gives for a text; what was used lately is kept: up to ``bound`` entries in each of two generations."""

    def __init__(self, make, bound: int):
        self.make, self.bound, self.old = make, bound, {}

    def __missing__(self, text: str):
        got = self.old.get(text)
        if got is None:
            got = self.make(text)
        if len(text) <= 64:
            if len(self) >= self.bound:
                self.old = dict(self)
                self.clear()
            self[text] = got
        return got


class WordBpe:
    """Encoder and decoder for a tokenizer file of word-level BPE with an end-of-word suffix.

    Same ids as the tokenizers library gives for such a file without added special tokens, truncation or padding;
    the strings of special tokens in a text get their ids there too. White space is never part of a token, so a
    text is encoded chunk by chunk and the ids of frequent chunks are kept (``cache_chunks`` at most; this bounds
    memory and doesn't change results).
    """

    def __init__(self, source: str | bytes, cache_chunks: int = 200_000):
        spec = json.loads(source)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = MergeAutomaton(self.vocab, merges, model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        n = max([*self.vocab.values(), *self.special.values()], default=-1) + 1
        self.labels = [""] * n
        for t, i in (*self.vocab.items(), *self.special.items()):
            self.labels[i] = t
        self._symbols = dict(enumerate(_byte_symbols()))
        self._chunks = _Recent(self.encode_chunk, cache_chunks)
        self._pieces = _Recent(self.encode_word, cache_chunks // 2)

    def encode_word(self, piece: str) -> bytes:
        ids = array("I", self.automaton.walk(self.automaton.symbols(piece.encode().decode("latin-1").translate(self._symbols))))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def encode_chunk(self, chunk: str) -> bytes:
        if self._special and "<" in chunk:
            parts = self._special.split(chunk)
            if len(parts) > 1:
                return b"".join(self.special[x].to_bytes(4, "little") if x in self.special else self.encode_chunk(x) for x in parts if x)
        return b"".join(map(self._pieces.__getitem__, pieces(chunk)))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; a null text is an empty one."""
        return b"".join(map(self._chunks.__getitem__, chunks(text))) if text else b""

    def count(self, text: str | None) -> int:
        return len(self.encode(text)) >> 2

    def decode(self, ids: bytes) -> str:
        """The arcs' labels, special tokens too, joined as the file's decoder does (none: by spaces)."""
        got = array("I", ids)
        if sys.byteorder == "big":
            got.byteswap()
        return " ".join(map(self.labels.__getitem__, got))
