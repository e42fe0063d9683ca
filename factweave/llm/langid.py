"""Language identification by cross-parsing entropy.

For every labelled language a suffix automaton of a bounded sample of its text is built. A text is cut into phrases,
each the longest that occurs in the sample, by walking the automaton's transitions; the language that needs the fewest
phrases per symbol is predicted. Walks of many texts advance in lock step on a dense transition table, so a step is a
few array operations; texts are parsed in blocks, each of which starts a phrase of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, release
from .shingles import slices

UNKNOWN = "und"
BLOCK = 2048
#: Bytes of text that are parsed at a time.
STEP = 1 << 20


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (null: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


@dataclass(frozen=True)
class Settings:
    """Bounds of the training sample: documents a language, pieces of each and code points of a piece, symbols in all."""

    docs_per_language: int = 48
    pieces: int = 8
    piece_chars: int = 512
    symbols: int = 256 << 10


def symbols(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes as letters: lower case (ASCII and Latin-1), bytes from 0x80 kept, all else one space a run."""
    out = data.copy()
    upper = (out >= 65) & (out <= 90)
    out[upper] += 32
    if len(out) > 1:
        latin = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][latin] += 32
    out[((out < 97) | (out > 122)) & (out < 128)] = 32
    return out


def squeezed(out: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Mask of what stays when runs of spaces become one and a text has none at its start. ``new``: text starts."""
    space = out == 32
    before = np.empty_like(space)
    before[:1] = True
    before[1:] = space[:-1]
    before[new[new < len(out)]] = True
    return ~(space & before)


class SuffixAutomaton:
    """All substrings of a sequence of small integers."""

    def __init__(self, seq):
        nxt, link, length = [{}], [-1], [0]
        last = 0
        for c in seq:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.next = nxt


class CrossParser:
    """Phrase counts of texts against each language. ``samples``: (language, rows, training symbols as bytes).

    States of all automata are numbered through. Most have one transition: ``only`` is its symbol and ``goto`` the
    state it leads to. The others (``only`` 0) have a row of ``branches`` that begins at ``goto``, with -1 where a
    phrase ends. ``roots`` says where the next phrase of a language is after its first symbol.
    """

    def __init__(self, samples: list[tuple[str, int, bytes]]):
        self.languages = [s[0] for s in samples]
        used = np.unique(np.frombuffer(b"".join(s[2] for s in samples), np.uint8))
        self.code = np.zeros(256, np.uint8)  # 0: in no sample
        self.code[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        self.root = np.zeros(len(samples), np.int32)
        self.roots = np.zeros((len(samples), width), np.int32)
        only, goto, rows = [], [], []
        for k, (_, _, sample) in enumerate(samples):
            states = SuffixAutomaton(self.code[np.frombuffer(sample, np.uint8)].tolist()).next
            first = len(only)
            self.root[k] = self.roots[k] = first
            for c, s in states[0].items():
                self.roots[k, c] = first + s
            for i, d in enumerate(states):
                if len(d) == 1 and i:
                    ((c, s),) = d.items()
                    only.append(c)
                    goto.append(first + s)
                else:
                    only.append(0)
                    goto.append(len(rows) * width)
                    row = np.full(width, -1, np.int32)
                    for c, s in d.items():
                        row[c] = first + s
                    rows.append(row)
        self.only, self.goto = np.array(only, np.uint8), np.array(goto, np.int32)
        self.branches = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        self.prior = np.argsort(np.argsort([(-s[1]) for s in samples], kind="stable"), kind="stable")

    def step(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[language, text] states, after a symbol of each text, and where a phrase ended before it."""
        only, goto = self.only[state], self.goto[state]
        branches = only == 0
        to = np.where(branches, self.branches[np.where(branches, goto + c, 0)], np.where(only == c, goto, -1))
        ended = to < 0
        return np.where(ended, self.roots[:, c], to), ended

    def phrases(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """[language, text] -> phrases, for the texts codes[start:end]."""
        lengths = ends - starts
        blocks = -(-lengths // BLOCK)
        owner = np.repeat(np.arange(len(starts)), blocks)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        at = starts[owner] + within * BLOCK
        n = np.minimum(BLOCK, ends[owner] - at)
        order = np.argsort(-n, kind="stable")
        at, n = at[order], n[order]
        count = np.zeros((len(self.languages), len(at)), np.int32)
        state = np.repeat(self.root[:, None], len(at), 1)
        for t in range(int(n[0]) if len(n) else 0):
            k = int(np.searchsorted(-n, -t, side="left"))  # blocks with more than t symbols
            state[:, :k], ended = self.step(state[:, :k], codes[at[:k] + t])
            count[:, :k] += ended
        total = np.zeros((len(self.languages), len(starts)), np.int64)
        for i in range(len(self.languages)):
            total[i] = np.bincount(owner[order], weights=count[i] + 1, minlength=len(starts)).astype(np.int64)
        return total

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and phrases per symbol of each text (no nulls)."""
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        letters = symbols(data)
        stays = squeezed(letters, offsets[:-1])
        kept = np.concatenate([[0], np.cumsum(stays)])
        bounds = kept[offsets]
        codes = self.code[letters[stays]]
        size = np.diff(bounds)
        # any ASCII letter or byte from 0x80; only texts without the former need a look at their characters
        ascii_letter = np.concatenate([[0], np.cumsum((letters >= 97) & (letters <= 122))])
        has = np.diff(ascii_letter[offsets]) > 0
        for i in np.flatnonzero(~has & (size > 0)):
            has[i] = any(map(str.isalpha, texts[int(i)].as_py()))
        if not self.languages:
            return [UNKNOWN] * n, np.zeros(n), np.zeros(n)
        counts = self.phrases(codes, bounds[:-1], bounds[1:])
        order = np.lexsort((np.broadcast_to(self.prior[:, None], counts.shape), counts), axis=0)
        best = np.take_along_axis(counts, order[:1], 0)[0]
        second = np.take_along_axis(counts, order[1:2], 0)[0] if len(self.languages) > 1 else np.full(n, np.inf)
        score = np.where(has, 1 - best / np.maximum(second, 1), 0.0)
        if len(self.languages) == 1:
            score = has.astype(float)
        names = [self.languages[j] if h else UNKNOWN for j, h in zip(order[0].tolist(), has.tolist(), strict=True)]
        return names, np.clip(score, 0, 1), best / np.maximum(size, 1)


def sample(rows: DataFrame, s: Settings) -> list[tuple[str, int, bytes]]:
    """Training symbols per language from ``rows`` (doc_id, text, lang; labelled, not empty).

    Of each language the documents with the smallest hashes of their ids, of each of these up to ``s.pieces`` pieces
    that are spread evenly over the whole text, and of all pieces, in the order of a hash, as many as fit. The numbers
    of rows by language come from all rows, so the sample is drawn evenly whatever the table's size. What reaches the
    driver is bounded by ``s``.
    """
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    unit = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(7)), 11) / float(1 << 53)
    share = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, 3 * s.docs_per_language / n)))])
    spread = F.transform(
        F.sequence(F.lit(0), F.lit(s.pieces - 1)),
        lambda i: F.substring(F.col("text"), (F.floor(i * F.char_length("text") / s.pieces) + 1).cast("int"), F.lit(s.piece_chars)),
    )
    pieces = F.when(F.char_length("text") > s.pieces * s.piece_chars, spread).otherwise(F.array("text"))
    drawn = rows.filter(unit < share[F.col("lang")]).select("lang", unit.alias("u"), "doc_id", pieces.alias("pieces")).collect()
    per = max(1024, s.symbols // len(counts))
    out = []
    for lang in sorted(counts):
        chosen = sorted((r for r in drawn if r["lang"] == lang), key=lambda r: (r["u"], r["doc_id"] or 0))[: s.docs_per_language]
        found = []
        for r in chosen:
            for i, text in enumerate(r["pieces"]):
                x = symbols(np.frombuffer(text.encode(), np.uint8))
                x = x[squeezed(x, np.zeros(1, np.int64))]
                found.append((zlib.crc32(f"{r['doc_id']} {i}".encode()), len(found), x.tobytes() + b" "))
        fits, size = [], 0
        for _, _, x in sorted(found):
            if fits and size + len(x) > per:
                continue
            fits.append(x)
            size += len(x)
        out.append((lang, counts[lang], b"".join(fits)))
    return out


def _sent(docs: DataFrame, model: list):
    return docs.sparkSession.sparkContext.broadcast(CrossParser(model))


def _parser(sent) -> CrossParser:
    release()
    return sent.value


def _predicted(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(sent)
        for b in batches:
            for i, j in slices(b.column(1), STEP):
                part = b.slice(i, j - i)
                lang, score, rate = parser.predict(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], ["doc_id", "lang_pred", "score", "phrase_rate"])

    return run


def train(docs: DataFrame, labelled: Column, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"):
    """The model, from rows of ``docs`` where ``labelled`` holds and language and text are there."""
    rows = docs.filter(labelled & F.col(lang_col).isNotNull() & (F.col(text_col) != "")).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return sample(rows, s)


def identify(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score, phrase_rate.

    ``score`` is 1 - (phrases of the best language / of the second); ties go to the language with more labelled rows,
    then by name. Null, empty and letterless texts, and all texts if nothing was labelled, get ``und`` and 0. Equal
    texts get equal results; other columns are ignored; an empty table gives an empty result. No shuffle.
    """
    return id_text(docs, id_col, text_col).mapInArrow(_predicted(_sent(docs, model)), "doc_id long, lang_pred string, score double, phrase_rate double")


def keep_identified(docs: DataFrame, model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text has a language, with all columns; a null ``lang_col`` gets the prediction."""
    sent = _sent(docs, model)
    text_at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(sent)
        for b in batches:
            text = b.column(text_at)
            text = pc.fill_null(text, "") if text.null_count else text
            for i, j in slices(text, STEP):
                part = b.slice(i, j - i)
                lang = pa.array(parser.predict(text.slice(i, j - i))[0], pa.string())
                columns = list(part.columns)
                columns[lang_at] = pc.coalesce(columns[lang_at], lang)
                yield pa.RecordBatch.from_arrays(columns, part.schema.names).filter(pc.not_equal(lang, UNKNOWN))

    return docs.mapInArrow(run, docs.schema)
