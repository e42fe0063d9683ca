"""Suffix-array dedup: which bytes lie in a string of 100 bytes that also starts earlier.

Every string of ``LENGTH`` bytes is dealt by its minimiser: the leftmost of its ``K``-byte windows with the smallest
hash. Equal strings have equal minimisers, so they meet, and the strings of one minimiser's place form a span. Places
are posted as packed numbers (bucket, minimiser). In a bucket, places with equal spans are settled at once: all but the
first are repeats. Where a minimiser has several different spans, the text of the first place of each goes to a shard,
whose suffix array (induced sorting) and permuted common prefixes group the equal strings exactly; all but the first of
a group are repeats. Shards are bounded: a minimiser with more than ``MOST_SPANS`` spans (a line shorter than
``LENGTH`` in very many texts) goes by the hashes of its whole strings instead, which are dealt evenly. Repeated
ranges return to their documents' chunk and are cut out there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, with_row
from .shingles import mix, slices, utf8
from .suffixes import common_prefixes, suffix_array

LENGTH = 100
K = 32
_WINDOWS = LENGTH - K + 1
MOST_SPANS = 512
#: Bytes of text that are hashed at a time, and strings that are packed at a time.
BLOCK = 256 << 10
STRINGS = 256 << 10
_B = 0x9E3779B97F4A7C15 | 1
#: 40 bits of the minimiser's hash above those of its bucket, 64 bits of the span's.
_PLACE = np.dtype([("mark", "<u4"), ("mark_high", "u1"), ("span", "<u4"), ("span_high", "<u4"), ("doc", "<i8"), ("lo", "<u4"), ("n", "u1")])
_WANT = np.dtype([("mark", "<u8"), ("doc", "<i8"), ("lo", "<u4"), ("n", "u1"), ("hot", "u1")])
_RANGE = np.dtype([("doc", "<i8"), ("start", "<u4"), ("end", "<u4")])
_STRING = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("start", "<u4")])
_KEYED = "kind int, key int, blob binary"
_BATCH = ["kind", "key", "blob"]


def pack(records: np.ndarray) -> bytes:
    """Records by columns, compressed."""
    return zstandard.compress(b"".join(np.ascontiguousarray(records[f]).tobytes() for f in records.dtype.names), 1)


def unpack(blobs: list[bytes], kind: np.dtype) -> np.ndarray:
    out = []
    for blob in blobs:
        raw = zstandard.decompress(blob)
        part = np.empty(len(raw) // kind.itemsize, kind)
        at = 0
        for f in kind.names:
            part[f] = np.frombuffer(raw, kind[f], len(part), at)
            at += kind[f].itemsize * len(part)
        out.append(part)
    return np.concatenate(out) if out else np.zeros(0, kind)


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            inverse = pow(_B, -1, 1 << 64)
            one = np.ones(1, np.uint64)
            cls.up = np.cumprod(np.concatenate([one, np.full(n - 1, _B, np.uint64)]))
            cls.down = np.cumprod(np.concatenate([one, np.full(n - 1, inverse, np.uint64)]))
        return cls.up, cls.down


class Hashes:
    """Hashes of any substrings of ``data``."""

    def __init__(self, data: np.ndarray):
        up, self.down = Powers.upto(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def places(data: np.ndarray, at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all strings of LENGTH bytes of texts data[at[i]:at[i+1]], as _PLACE records, and their minimisers."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, _PLACE), np.zeros(0, np.uint64)
    h = Hashes(data)
    m = h.of(np.arange(len(data) - K + 1), np.arange(K, len(data) + 1))
    mark = m
    arg = np.arange(len(m), dtype=np.int32)
    width = 1
    while 2 * width <= _WINDOWS:
        left = m[:-width] <= m[width:]
        m, arg = np.where(left, m[:-width], m[width:]), np.where(left, arg[:-width], arg[width:])
        width *= 2
    rest = _WINDOWS - width
    if rest:
        arg = np.where(m[:-rest] <= m[rest:], arg[:-rest], arg[rest:])
    owner = np.repeat(np.arange(len(ids)), np.diff(at))[:n]
    inside = np.arange(n) + LENGTH <= at[owner + 1]
    start = np.flatnonzero(inside)
    if len(start) == 0:
        return np.zeros(0, _PLACE), np.zeros(0, np.uint64)
    arg, owner = arg[start], owner[start]
    head = np.ones(len(start), bool)
    head[1:] = (arg[1:] != arg[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(head)
    count = np.diff(np.append(first, len(start)))
    lo = start[first]
    out = np.empty(len(first), _PLACE)
    m, span = mark[arg[first]], h.of(lo, lo + count - 1 + LENGTH)
    out["mark"], out["mark_high"] = m >> np.uint64(24), m >> np.uint64(56)
    out["span"], out["span_high"] = span, span >> np.uint64(32)
    out["doc"], out["lo"], out["n"] = ids[owner[first]], lo - at[owner[first]], count
    return out, m


def keyed(kind: int, key: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
    """One row per key, with its records packed."""
    order = np.argsort(key, kind="stable")
    key, records = key[order], records[order]
    cuts = np.flatnonzero(np.diff(key, prepend=-1)) if len(key) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(key))
    blobs = [pack(records[i:j]) for i, j in zip(cuts.tolist(), ends.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(blobs), pa.int32()), pa.array(key[cuts], pa.int32()), pa.array(blobs, pa.binary())], _BATCH)


def chunk_of(doc: np.ndarray, chunks: int) -> np.ndarray:
    x = doc.astype(np.int64).view(np.uint64)
    x = (x ^ (x >> np.uint64(21)) ^ (x >> np.uint64(42))) & np.uint64((1 << 62) - 1)
    return (x % np.uint64(chunks)).astype(np.int32)


def chunk_column(doc: Column, chunks: int) -> Column:
    x = doc.bitwiseXOR(F.shiftrightunsigned(doc, 21)).bitwiseXOR(F.shiftrightunsigned(doc, 42)).bitwiseAND(F.lit((1 << 62) - 1))
    return F.pmod(x, F.lit(chunks)).cast("int")


def _repeats(again: np.ndarray, chunks: int) -> pa.RecordBatch:
    """Places whose every string starts earlier too -> ranges (kind 1), by chunk."""
    r = np.empty(len(again), _RANGE)
    r["doc"], r["start"] = again["doc"], again["lo"]
    r["end"] = again["lo"] + again["n"] + np.uint32(LENGTH - 1)
    return keyed(1, chunk_of(r["doc"], chunks), r)


def _posted(buckets: int, chunks: int, hold: int = 400_000):
    """Texts -> places by bucket (kind 0). Places with the same minimiser and span that are held together are settled
    here already (kind 1, by chunk), so a passage of very many texts is posted about once an input partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, marks, held = [], [], 0

        def flush():
            p, m = np.concatenate(parts), np.concatenate(marks)
            order = np.lexsort((p["lo"], p["doc"], p["span_high"], p["span"], m))
            p, m = p[order], m[order]
            first = _heads(m, p["span"], p["span_high"])
            if not first.all():
                yield _repeats(p[~first], chunks)
            yield keyed(0, (m[first] % np.uint64(buckets)).astype(np.int32), p[first])

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for i, j in slices(b.column(1), BLOCK):
                data, at = utf8(b.column(1).slice(i, j - i))
                # a long text comes alone, and is read in blocks that overlap by a string
                for lo in range(0, max(1, len(data)), BLOCK) if len(data) > 2 * BLOCK else (0,):
                    some = data[lo : lo + BLOCK + LENGTH - 1] if len(data) > 2 * BLOCK else data
                    p, m = places(some, at if some is data else np.array([0, len(some)]), ids[i:j])
                    p["lo"] += np.uint32(lo)
                    parts.append(p)
                    marks.append(m)
                    held += len(p)
                    if held >= hold:
                        yield from flush()
                        parts, marks, held = [], [], 0
        if held:
            yield from flush()

    return run


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[bytes]]]]:
    """Rows sorted by key -> (key, {kind: its blobs})."""
    now, held = None, {}
    for b in batches:
        for kind, key, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key != now and held:
                yield now, held
                held = {}
            now = key
            held.setdefault(kind, []).append(blob)
    if held:
        yield now, held


def _heads(*keys: np.ndarray) -> np.ndarray:
    """True where any key differs from the one before."""
    head = np.ones(len(keys[0]), bool)
    if len(head) > 1:
        head[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return head


def _settled(chunks: int, buckets: int):
    """Buckets of places -> ranges that repeat (kind 1) and places whose text is wanted (kind 2), by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs in _by_key(batches):
            if 1 in blobs:
                k = len(blobs[1])
                yield pa.RecordBatch.from_arrays([pa.array([1] * k, pa.int32()), pa.array([bucket] * k, pa.int32()), pa.array(blobs[1], pa.binary())], _BATCH)
            if 0 not in blobs:
                continue
            p = unpack(blobs[0], _PLACE)
            mark = p["mark"].astype(np.uint64) | p["mark_high"].astype(np.uint64) << np.uint64(32)
            span = p["span"].astype(np.uint64) | p["span_high"].astype(np.uint64) << np.uint64(32)
            order = np.lexsort((p["lo"], p["doc"], span, mark))
            p, mark = p[order], mark[order]
            first = _heads(mark, span[order])
            if not first.all():
                yield _repeats(p[~first], chunks)
            f, mark = p[first], mark[first]
            head = np.flatnonzero(_heads(mark))
            size = np.diff(np.append(head, len(f)))
            size = np.repeat(size, size)
            f, mark, size = f[size > 1], mark[size > 1], size[size > 1]
            if len(f):
                w = np.empty(len(f), _WANT)
                w["mark"] = mark * np.uint64(buckets) + np.uint64(bucket)
                for k in ("doc", "lo", "n"):
                    w[k] = f[k]
                w["hot"] = size > MOST_SPANS
                yield keyed(2, chunk_of(w["doc"], chunks), w)

    return run


def _texts(table: pa.Table):
    """(rows, bytes, offsets) of a chunk's documents."""
    ids = table.column("row").to_numpy()
    text = table.column("text").combine_chunks()
    text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
    data, at = utf8(text)
    return ids, data, at


def _rows_of(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    order = np.argsort(ids, kind="stable")
    return order[np.searchsorted(ids[order], doc)]


def _strings(data: np.ndarray, hot: np.ndarray, lo: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """The strings of places (in order; ``lo``: where they start in ``data``) by shard (kind 4), hashed in blocks."""
    if not len(hot):
        return
    held, size = [], 0
    block = lo // BLOCK
    cuts = np.flatnonzero(np.diff(block, prepend=-1)).tolist()
    for i, j in zip(cuts, [*cuts[1:], len(hot)], strict=True):
        n = hot["n"][i:j].astype(np.int64)
        base = int(lo[i])
        which = np.repeat(np.arange(i, j), n)
        step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        start = lo[which] + step - base
        s = np.empty(len(which), _STRING)
        s["hash"] = Hashes(data[base : base + int(start.max()) + LENGTH]).of(start, start + LENGTH)
        s["doc"], s["start"] = hot["doc"][which], hot["lo"][which] + step
        held.append(s)
        size += len(s)
        if size >= STRINGS or j == len(hot):
            s = np.concatenate(held)
            yield keyed(4, (s["hash"] % np.uint64(shards)).astype(np.int32), s)
            held, size = [], 0


def _fetched(shards: int):
    """A chunk's documents and wanted places -> pieces of text by shard (kind 3), strings by shard (kind 4)."""

    def run(docs: pa.Table, wanted: pa.Table) -> pa.Table:
        out = []
        if wanted.num_rows and docs.num_rows:
            w = unpack(wanted.column("blob").to_pylist(), _WANT)
            ids, data, at = _texts(docs)
            lo = at[_rows_of(ids, w["doc"])] + w["lo"]
            order = np.argsort(lo, kind="stable")
            w, lo = w[order], lo[order]
            cold = w["hot"] == 0
            pieces: dict[int, list[bytes]] = {}
            shard = (mix(w["mark"]) % np.uint64(shards)).astype(np.int32)
            raw = data.tobytes()
            for k in np.flatnonzero(cold).tolist():
                size = int(w["n"][k]) + LENGTH - 1
                a = int(lo[k])
                pieces.setdefault(int(shard[k]), []).append(w[k].tobytes() + raw[a : a + size])
            out.append(pa.RecordBatch.from_arrays([pa.array([3] * len(pieces), pa.int32()), pa.array(list(pieces), pa.int32()), pa.array([zstandard.compress(b"".join(v), 1) for v in pieces.values()], pa.binary())], _BATCH))
            out += _strings(data, w[~cold], lo[~cold], shards)
        return pa.Table.from_batches(out, schema=pa.schema([("kind", pa.int32()), ("key", pa.int32()), ("blob", pa.binary())]))

    return run


def repeats_in_pieces(pieces: list[tuple[int, int, bytes]]) -> list[tuple[int, int, int]]:
    """pieces: (doc, lo, text) -> (doc, start, end) of the strings of LENGTH that start earlier in the pieces too.

    A piece's strings are those that it holds whole.
    """
    pieces = sorted(pieces)
    size = np.array([len(t) + 1 for _, _, t in pieces], np.int64)
    begin = np.cumsum(size) - size
    s = np.frombuffer(b"\xff".join([t for _, _, t in pieces]) + b"\xff", np.uint8)  # no byte of UTF-8
    sa = suffix_array(s.astype(np.int16), LENGTH)
    same = common_prefixes(s, sa, LENGTH)[sa] >= LENGTH
    owner = np.repeat(np.arange(len(pieces)), size)
    whole = np.arange(len(s)) + LENGTH < begin[owner] + size[owner]
    valid = whole[sa]
    same &= valid
    group = np.cumsum(~same)
    heads = np.flatnonzero(~same)
    earliest = np.minimum.reduceat(sa, heads)
    again = np.sort(sa[valid & (earliest[group - 1] != sa)])
    out = []
    if len(again):
        cuts = np.flatnonzero((np.diff(again, prepend=-2) != 1) | (np.diff(owner[again], prepend=-1) != 0))
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(again)], strict=True):
            a, k = int(again[i]), int(owner[again[i]])
            doc, lo, _ = pieces[k]
            start = lo + a - int(begin[k])
            out.append((doc, start, start + (j - i) - 1 + LENGTH))
    return out


def _sharded(chunks: int):
    """Shards of pieces and of strings -> ranges that repeat (kind 1), by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in _by_key(batches):
            ranges = []
            blob, at, pieces = b"".join(map(zstandard.decompress, blobs.get(3, []))), 0, []
            while at < len(blob):
                w = np.frombuffer(blob, _WANT, 1, at)[0]
                at += _WANT.itemsize
                end = at + int(w["n"]) + LENGTH - 1
                pieces.append((int(w["doc"]), int(w["lo"]), blob[at:end]))
                at = end
            if pieces:
                ranges.append(np.array(repeats_in_pieces(pieces), _RANGE))
            if blobs.get(4):
                s = unpack(blobs[4], _STRING)
                s = s[np.lexsort((s["start"], s["doc"], s["hash"]))]
                again = s[~_heads(s["hash"])]
                r = np.empty(len(again), _RANGE)
                r["doc"], r["start"], r["end"] = again["doc"], again["start"], again["start"] + np.uint32(LENGTH)
                ranges.append(r)
            r = np.concatenate(ranges) if ranges else np.zeros(0, _RANGE)
            if len(r):
                yield keyed(1, chunk_of(r["doc"], chunks), r)

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def _cut_out(docs: pa.Table, ranges: pa.Table) -> pa.Table:
    """A chunk's documents and ranges -> what is left of each document."""
    if not docs.num_rows:
        return _OUT.empty_table()
    ids, data, at = _texts(docs)
    cover = np.zeros(len(data) + 1, np.int32)
    if ranges.num_rows:
        r = unpack(ranges.column("blob").to_pylist(), _RANGE)
        base = at[_rows_of(ids, r["doc"])]
        cover += np.bincount(base + r["start"], minlength=len(cover)).astype(np.int32)
        cover -= np.bincount(base + r["end"], minlength=len(cover)).astype(np.int32)
    gone = np.cumsum(cover[:-1]) > 0
    spans, kept = [], []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        g = gone[a:b]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8)))
        spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edges[::2], edges[1::2], strict=True)])
        kept.append(data[a:b][~g].tobytes())
    return pa.Table.from_arrays([docs.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(spans, _OUT.field("spans").type), pa.array(kept, pa.binary())], schema=_OUT)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 4 << 20, bucket_bytes: int = 64 << 20, shard_bytes: int = 16 << 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, spans, kept.

    ``spans`` are the maximal ranges of bytes of the text's UTF-8 that lie in a string of 100 bytes which also starts
    earlier (in a document with a smaller id, or earlier in the same one; overlaps count, on the input as it is);
    ``kept`` are the other bytes, in order. Null counts as empty; texts under 100 bytes are never touched. Rows without
    an id come after all others; rows that repeat an id are documents of their own, in an order that is fixed for the
    call. Other columns are ignored; an empty table gives an empty result. Work is dealt by hashes of content and of
    ids: buckets of places (at least 1024, and one for every ``bucket_bytes`` of input), shards of text (the same with
    ``shard_bytes``), chunks of about ``chunk_bytes``.
    """
    wide = with_row(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    rows = wide.select("row", "doc_id", "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(64, total // chunk_bytes) | 1
    buckets = max(1024, total // bucket_bytes)
    shards = max(1024, total // shard_bytes)
    chunked = rows.withColumn("chunk", chunk_column(F.col("row"), chunks))

    posted = rows.select("row", "text").mapInArrow(_posted(buckets, chunks), _KEYED)
    settled = cut(posted.repartition("key").sortWithinPartitions("key").mapInArrow(_settled(chunks, buckets), _KEYED))
    wanted = settled.filter("kind = 2")
    fetched = chunked.select("chunk", "row", "text").groupBy("chunk").cogroup(wanted.groupBy("key")).applyInArrow(_fetched(shards), _KEYED)
    more = cut(fetched.repartition("key").sortWithinPartitions("key").mapInArrow(_sharded(chunks), _KEYED))
    ranges = settled.filter("kind = 1").union(more)
    return chunked.groupBy("chunk").cogroup(ranges.groupBy("key")).applyInArrow(_cut_out, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
