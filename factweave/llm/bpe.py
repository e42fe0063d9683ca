"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

Encoding rests on one property of merge lists that make each token once: a token sequence is the encoding of its text
exactly if every two neighbours are the encoding of theirs. So each prefix of a word has one possible last token, which
follows from those of shorter prefixes, and symbols can be read one at a time. A token is emitted once it is stable:
once the paths from every place where a later token could start go through its end. ``sufficient_lookahead`` bounds
from the merge list how far a merge can depend on what follows; the transducer looks for stable tokens whenever it
holds that much more than the longest token, so a run of letters of any length is encoded in constant memory.
Words that end before that (nearly all) are read in lock step, many at a time: ``Lockstep`` makes the same steps as
``Transducer`` on arrays, a symbol of each word a round. Words are remembered in two bounded generations.

Decoding is the reverse machine: ids in, text out, with the state of an incremental UTF-8 decoder in byte mode.
"""

from __future__ import annotations

import codecs
import functools
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import held, id_text
from .shingles import slices

END = "</w>"
#: Words remembered by a generation, and the longest (in bytes) that is.
_CACHE = 120_000
_LONG = 64
#: Pairs of tokens remembered.
_PAIRS = 1 << 19


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: visible Latin-1 stands for itself, others follow from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


def _ranges(kind: str, most: int) -> str:
    """A regular expression class body of all code points up to ``most`` whose category starts with ``kind``."""
    out, start = [], None
    for c in range(most + 2):
        inside = c <= most and unicodedata.category(chr(c))[0] == kind
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


# Letters and numbers of Unicode 16 that this Python's tables lack, and the lower case of some.
_NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
_NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
_NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_NEW_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_WHITE = "\t-\r \x85\xa0  -     　"


#: Texts with no code point beyond the first or second of these are split by smaller, much faster classes.
_LEVELS = (0xFF, 0xFFFF, sys.maxunicode)
_BEYOND = tuple(re.compile(f"[^\\U00000000-\\U{most:08x}]") for most in _LEVELS[:-1])


@functools.cache
def word_pattern(most: int = sys.maxunicode) -> re.Pattern:
    """Words of texts without a code point above ``most``."""
    new = lambda pairs: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in pairs if b <= most)
    letters, digits = (_ranges(kind, most) + new(pairs) for kind, pairs in (("L", _NEW_LETTERS), ("N", _NEW_NUMBERS)))
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{_WHITE}{letters}{digits}]+")


def sufficient_lookahead(merges: list[tuple[str, str]], length=len) -> int:
    """Symbols after a token's end on which its merges can depend.

    Whether the left part of a merge is still free depends on merges of it with what follows that come earlier in the
    list, and those on still earlier ones further right: the longest such chain, in one pass over the list.
    """
    reach: dict[str, int] = {}
    for left, right in merges:
        n = length(right) + reach.get(right, 0)
        if n > reach.get(left, 0):
            reach[left] = n
    return max(reach.values(), default=0)


class Vocabulary:
    """A merge list with word ends, read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.tokens = {i: t for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.size = lambda t: len(t) - 4 * t.endswith(END)
        self.longest = max(map(self.size, self.ids))
        self.lookahead = sufficient_lookahead(merges, self.size)
        self.rank = {m: r for r, m in enumerate(merges)}
        if len({a + b for a, b in merges}) != len(merges):
            raise ValueError("a token has two merges; neighbours do not determine the encoding")
        self.pairs: dict[int, bool] = {}
        self.alphabet = byte_alphabet()
        self.byte_of = {c: b for b, c in enumerate(self.alphabet)}
        self.mapped = str.maketrans({b: c for b, c in enumerate(self.alphabet)})

    @functools.cached_property
    def endings(self) -> tuple[dict[str, int], dict[str, int]]:
        """Every ending of a token -> the token's id if it is one itself, else -1; inside a word and at its end."""
        inner: dict[str, int] = {}
        final: dict[str, int] = {}
        for t, i in self.ids.items():
            ends = t.endswith(END) and len(t) > len(END)
            body, table = (t[: -len(END)], final) if ends else (t, inner)
            for k in range(1, len(body)):
                table.setdefault(body[k:], -1)
            table[body] = i
        return inner, final

    def symbols(self, token: str) -> list[str]:
        if token.endswith(END) and len(token) > 4:
            body = token[:-4]
            return [*body[:-1], body[-1] + END]
        return list(token)

    def by_rank(self, parts: list[str]) -> list[str]:
        """The definition: the earliest merge of the list first, leftmost first."""
        parts = list(parts)
        rank = self.rank
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def follows(self, left: int, right: int) -> bool:
        """Whether two tokens are the encoding of their text. left -1: the start of a word."""
        key = (left << 20) | right if left >= 0 else -right - 1
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= _PAIRS:
                self.pairs.clear()
            b = self.tokens[right]
            want = [b] if left < 0 else [self.tokens[left], b]
            known = self.pairs[key] = self.by_rank([s for t in want for s in self.symbols(t)]) == want
        return known


class Transducer:
    """One word, fed in pieces of byte-alphabet characters; ``feed`` and ``close`` return the ids that became stable."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.text = ""  # what is pending
        self.last: list[int] = []  # the last token of the encoding up to each pending symbol
        self.size: list[int] = []
        self.before = -1  # the last token emitted
        self.hold = v.longest + v.lookahead

    def _extend(self, symbols: str, end: str = "") -> None:
        """Append the last token for each further symbol; ``end`` closes the last of them."""
        v, follows = self.v, self.v.follows
        text, last, size, before = self.text + symbols, self.last, self.size, self.before
        close = len(text) - 1 if end else -1
        inner, final = v.endings
        for j in range(len(last), len(text)):
            endings = final if j == close else inner
            found, s = [], j
            while s >= 0:
                t = endings.get(text[s : j + 1])
                if t is None:
                    break
                if t >= 0:
                    found.append((s, t))
                s -= 1
            for s, t in reversed(found):
                left = last[s - 1] if s else before
                if left != -2 and follows(left, t):
                    last.append(t)
                    size.append(j + 1 - s)
                    break
            else:
                last.append(-2)
                size.append(1)
        self.text = text

    def _path(self, at: int) -> list[int]:
        """Ends of the tokens up to the pending symbol ``at``, last first."""
        out = []
        while at >= 0:
            out.append(at)
            at -= self.size[at]
        return out

    def _emit(self, at: int) -> list[int]:
        out = [self.last[p] for p in reversed(self._path(at))]
        self.text, self.last, self.size = self.text[at + 1 :], self.last[at + 1 :], self.size[at + 1 :]
        if out:
            self.before = out[-1]
        return out

    def feed(self, symbols: str) -> list[int]:
        out: list[int] = []
        for i in range(0, len(symbols), self.hold):
            self._extend(symbols[i : i + self.hold])
            n = len(self.text)
            if n <= self.hold:
                continue
            live = [p for p in range(max(0, n - self.v.longest), n) if self.last[p] >= 0]
            common = set(self._path(live[0])) if live else set()
            for p in live[1:]:
                common &= set(self._path(p))
            if common:
                out += self._emit(max(common))
        return out

    def close(self, symbols: str) -> list[int]:
        """The word's last symbols (at least one) and its end."""
        self._extend(symbols, END)
        return self._emit(len(self.text) - 1)


class IntMap:
    """Non-negative 64-bit integers to 32-bit ones, many at a time: open addressing in arrays of a fixed size."""

    def __init__(self, slots: int):
        self.bits = max(4, (slots - 1).bit_length())
        self.clear()

    def clear(self) -> None:
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.int32)
        self.size = 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where there is none."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], np.int32(-1))
        live = np.flatnonzero((there != keys) & (there >= 0))
        while len(live):
            slot[live] = (slot[live] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[live]]
            hit = there == keys[live]
            out[live[hit]] = self.values[slot[live[hit]]]
            live = live[~hit & (there >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New distinct keys."""
        self.size += len(keys)
        slot = self._slot(keys)
        live = np.arange(len(keys))
        while len(live):
            free = live[self.keys[slot[live]] < 0]
            self.keys[slot[free]] = keys[free]  # of several that want a slot, one gets it
            self.values[slot[free]] = values[free]
            live = live[self.keys[slot[live]] != keys[live]]
            slot[live] = (slot[live] + 1) & ((1 << self.bits) - 1)


class Lockstep:
    """The transducer's steps for many words at once, none longer than its lookahead."""

    def __init__(self, v: Vocabulary):
        n = 1 + max(v.tokens)
        symbol = {t: i for t, i in v.ids.items()}
        # the tree of merges: when a token is made (-1: a symbol) and of what
        self.made = np.full(n, -1, np.int64)
        self.left, self.right = np.arange(n), np.arange(n)
        for (a, b), r in v.rank.items():
            i = symbol[a + b]
            self.made[i], self.left[i], self.right[i] = r, symbol[a], symbol[b]
        merged = np.flatnonzero(self.made >= 0)
        if (np.maximum(self.made[self.left[merged]], self.made[self.right[merged]]) >= self.made[merged]).any():
            raise ValueError("a merge comes before those of its parts")
        self.merges = IntMap(4 * max(1, len(merged)))
        self.merges.put(self.left[merged] << 20 | self.right[merged], self.made[merged].astype(np.int32))
        # whether a token is the encoding of its own text: its parts are, and nothing joins them earlier otherwise
        whole = np.ones(n, bool)
        whole[merged] = self._apart(self.left[merged], self.right[merged], self.made[merged])
        before = None
        while before is None or (before != whole).any():
            before = whole.copy()
            whole[merged] &= whole[self.left[merged]] & whole[self.right[merged]]
        self.whole = whole
        # a tree of the tokens' bytes from the last to the first; node 0 inside words, node 1 at their ends
        steps: dict[int, int] = {}
        token = [-1, -1]
        for t, i in v.ids.items():
            ends = t.endswith(END) and len(t) > len(END)
            body = t[: -len(END)] if ends else t
            if not all(c in v.byte_of for c in body):
                continue
            node = int(ends)
            for c in reversed(body):
                key = node << 8 | v.byte_of[c]
                node = steps.setdefault(key, len(token))
                if node == len(token):
                    token.append(-1)
            token[node] = i
        self.steps = IntMap(4 * len(steps) + 4)
        self.steps.put(np.fromiter(steps, np.int64), np.fromiter(steps.values(), np.int32))
        self.token = np.array(token, np.int64)
        self.known = IntMap(2 * _PAIRS)

    def _apart(self, x: np.ndarray, y: np.ndarray, until: np.ndarray) -> np.ndarray:
        """Whether no merge that comes before ``until`` joins the end of x's text to the beginning of y's.

        Time runs backwards: of the two pieces at the border the one that was made later is taken apart. Two pieces
        would have been joined if their merge comes before those that made each part of something larger (of equal
        merges the left one is first).
        """
        out = np.ones(len(x), bool)
        live = np.arange(len(x))
        p, q, end_p, end_q = x.copy(), y.copy(), until.copy(), until - 1
        while len(live):
            m = self.merges.get(p << 20 | q)
            joined = (m >= 0) & (m < end_p) & (m <= end_q)
            out[live[joined]] = False
            born_p, born_q = self.made[p], self.made[q]
            go = ~joined & ((born_p >= 0) | (born_q >= 0))
            live, p, q, end_p, end_q, born_p, born_q = (a[go] for a in (live, p, q, end_p, end_q, born_p, born_q))
            of_p = born_p > born_q
            end_p, end_q = np.where(of_p, born_p, end_p), np.where(of_p, end_q, born_q)
            p, q = np.where(of_p, self.right[p], p), np.where(of_p, q, self.left[q])
        return out

    def follows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``Vocabulary.follows`` of tokens that are both encodings of their own texts."""
        key = left << 20 | right
        got = self.known.get(key)
        new = np.unique(key[got < 0])
        if len(new):
            apart = self._apart(new >> 20, new & ((1 << 20) - 1), np.full(len(new), 1 << 40))
            if self.known.size + len(new) > _PAIRS:
                self.known.clear()
            if len(new) <= _PAIRS:
                self.known.put(new, apart.astype(np.int32))
            miss = got < 0
            got[miss] = apart[np.searchsorted(new, key[miss])]
        return got == 1

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of at least one byte, as little-endian unsigned 32-bit integers."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")
        length = size[order]
        begin = np.cumsum(length) - length
        data = np.frombuffer(b"".join([words[i] for i in order.tolist()]), np.uint8)
        last = np.full((int(length[0]), len(words)), -2, np.int64)  # the last token of the encoding up to each symbol
        width = np.ones((int(length[0]), len(words)), np.int64)
        for j in range(int(length[0])):
            n = int(np.searchsorted(-length, -j, side="left"))  # words with more than j symbols
            which, node = np.arange(n), (length[:n] == j + 1).astype(np.int64)
            found = []
            for d in range(j + 1):
                node = self.steps.get(node << 8 | data[begin[which] + (j - d)])
                alive = node >= 0
                which, node = which[alive], node[alive].astype(np.int64)
                if not len(which):
                    break
                t = self.token[node]
                is_token = t >= 0
                w, t = which[is_token], t[is_token]
                left = last[j - d - 1, w] if d < j else np.full(len(w), -1)
                ok = self.whole[t] & (left != -2)
                found.append((w[ok], t[ok], left[ok], d))
            w, t, left = (np.concatenate([f[k] for f in found]) for k in range(3))
            d = np.repeat([f[3] for f in found], [len(f[0]) for f in found])
            ok = left < 0
            inside = np.flatnonzero(~ok)
            ok[inside] = self.follows(left[inside], t[inside])
            last[j, w[ok]], width[j, w[ok]] = t[ok], d[ok] + 1
        # the paths back from the last symbols
        paths, at, which = [], length - 1, np.arange(len(words))
        while len(which):
            paths.append((which, last[at, which]))
            at = at - width[at, which]
            which, at = which[at >= 0], at[at >= 0]
        count = np.zeros(len(words), np.int64)
        for which, _ in paths:
            count[which] += 1
        end = np.cumsum(count)
        ids = np.empty(int(end[-1]), "<u4")
        for k, (which, t) in enumerate(paths):
            ids[end[which] - 1 - k] = t
        raw = ids.tobytes()
        out: list[bytes] = [b""] * len(words)
        for i, a, b in zip(order.tolist(), ((end - count) * 4).tolist(), (end * 4).tolist(), strict=True):
            out[i] = raw[a:b]
        return out


class Encoder:
    """Texts to ids."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.lockstep = Lockstep(v)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.special = re.compile("|".join(map(re.escape, sorted(v.special, key=len, reverse=True)))) if v.special else None

    def word(self, w: str) -> bytes:
        """One word through the streaming transducer."""
        mapped = w.encode("utf-8").decode("latin-1").translate(self.v.mapped)
        t = Transducer(self.v)
        out = array("I", t.feed(mapped[:-1]))
        out.extend(t.close(mapped[-1:]))
        return out.tobytes()

    def _learn(self, words: set[str]) -> None:
        """Make sure that ``self.words`` has these; what an earlier generation still knows is not encoded again."""
        if len(self.words) >= _CACHE:
            self.words, self.older = {}, self.words
        new = []
        for w in words.difference(self.words):
            known = self.older.get(w)
            if known is None:
                new.append(w)
            else:
                self.words[w] = known
        if new:
            self.words.update(zip(new, self.lockstep.encode([w.encode() for w in new]), strict=True))

    def _matches(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if _BEYOND[0].search(text):
                text = text.replace("Σ", "σ").translate(_NEW_LOWER)
        text = text.lower()
        level = 0 if text.isascii() else next((k for k, beyond in enumerate(_BEYOND) if not beyond.search(text)), len(_BEYOND))
        return word_pattern(_LEVELS[level]).findall(text)

    def _segments(self, text: str) -> list:
        """Words in order; ids of special tokens as bytes."""
        if "<|" not in text or not self.special:
            return self._matches(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*self._matches(text[at : m.start()]), self.v.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return out + self._matches(text[at:])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts = [self._segments(t) for t in texts]
        distinct = set().union(*parts)
        apart = {w: w if isinstance(w, bytes) else self.word(w) for w in distinct if isinstance(w, bytes) or len(w) > _LONG // 4 and len(w.encode()) > _LONG}
        self._learn(distinct.difference(apart))
        if not apart:
            return [b"".join(map(self.words.__getitem__, p)) for p in parts]
        return [b"".join([apart[w] if w in apart else self.words[w] for w in p]) for p in parts]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


class Decoder:
    """Ids to text, in pieces. mode ``tokens``: the vocabulary's strings, with a space between two (what a tokenizer
    without a decoder does); mode ``bytes``: the bytes that they stand for, a space for each word end, and what is not
    UTF-8 replaced."""

    def __init__(self, v: Vocabulary, mode: str = "tokens"):
        self.v, self.mode, self.first = v, mode, True
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def _raw(self, i: int) -> bytes:
        t = self.v.tokens[i]
        if i in self.v.special.values():
            return t.encode()
        body = t[:-4] if t.endswith(END) and len(t) > 4 else t
        return bytes(self.v.byte_of[c] for c in body) + b" " * (body != t)

    def feed(self, ids: Iterable[int]) -> str:
        if self.mode == "bytes":
            return "".join(self.utf8.decode(self._raw(i)) for i in ids)
        piece = " ".join(map(self.v.tokens.__getitem__, ids))
        if not piece:
            return ""
        lead = "" if self.first else " "
        self.first = False
        return lead + piece

    def close(self) -> str:
        return self.utf8.decode(b"", True)


def _encoder(path: str) -> Encoder:
    return held(("bpe", path), lambda: Encoder(Vocabulary(path)))


def _coded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for b in batches:
            for i, j in slices(b.column(1), 1 << 20):
                part = b.slice(i, j - i)
                ids = enc.encode_all(part.column(1).to_pylist())
                texts = []
                for x in ids:
                    d = Decoder(enc.v)
                    texts.append(d.feed(memoryview(x).cast("I")) + d.close())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return run


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (little-endian unsigned 32-bit integers), decoded.

    ``path`` is a tokenizers JSON file that every executor can open (a file of an installed package). Text is
    normalised (NFC, lower case), white space is dropped, special tokens in the text are themselves. Null counts as
    empty and gives no ids and an empty text; other columns are ignored; equal texts give equal rows; an empty table
    gives an empty result. No shuffle.
    """
    return id_text(docs, id_col, text_col).mapInArrow(_coded(path), "doc_id long, ids binary, decoded string")
