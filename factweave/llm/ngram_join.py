"""N-gram Jaccard join: which texts are linked by 5-word shingle sets with Jaccard similarity 0.8 or more.

Equal sets are one node, so copies are never paired. A set's shingles are ordered rare first (shingles that are
frequent in the corpus last, by frequency; the rest by hash) and its prefix of ``n - ceil(0.8 n) + 1`` shingles is
posted: linked sets share a posted shingle. Postings travel as packed arrays, a row per bucket and input chunk.

A posting list is not expanded into pairs. First each list's member for which the shingle stands earliest in its order
(the one with the fewest shingles of its own) is compared with the others; the links found are contracted to
components; and only pairs of a list that are still in different components are compared after that, after length,
positional and suffix filters. Every comparison is made on the whole sets, once a pair. So no link between components
is lost, and a group of near copies costs about one comparison a member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_text, release, unique_ids, with_row
from .components import components
from .shingles import shingle_sets, slices

_FACTS = "kind int, doc_id long, n long, set_id long, blob binary"
_POSTED = "bucket int, blob binary"
_FOUND = "kind int, a long, b long, list_id long, members binary"
_POST = np.dtype([("token", "<u8"), ("set_id", "<i8"), ("n", "<u4"), ("pos", "<u2")])
_MEMBER = np.dtype([("set_id", "<i8"), ("n", "<u4"), ("pos", "<u2")])
#: Up to this many ids of texts to compare are broadcast (8 bytes each); beyond, the texts are joined by shuffle.
BROADCAST_IDS = 1_000_000
_CHUNK = 2_000_000  # shingles that one chunk of postings or counts holds


def least_common(n):
    """Smallest intersection with a set of n that a link needs: ceil(0.8 n), in whole numbers."""
    return (4 * n + 4) // 5


def linked(common, a, b):
    return 5 * common >= 4 * (a + b - common)


def set_id(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def histogram(s: np.ndarray) -> bytes:
    """How many shingles fall in each of 256 parts of the hash range; empty if a part has more than a byte counts."""
    n = np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=256)
    return n.astype(np.uint8).tobytes() if n.max() < 256 else b""


def _by_bytes(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Pieces of batches with about 4 MB in a text column, which bounds what is held as arrays."""
    release()
    for b in batches:
        for i, j in slices(b.column(column), 4 << 20):
            yield b.slice(i, j - i)


def facts(often: int):
    """Per document its set's size, id and histogram (kind 0); per chunk the shingles that ``often`` documents of it have (kind 1)."""

    def blob(parts):
        token, n = np.unique(np.concatenate(parts), return_counts=True)
        keep = n >= often
        return token[keep].astype("<u8").tobytes() + n[keep].astype("<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        blobs = []
        for b in _by_bytes(batches, 1):
            sets = shingle_sets(b.column(1))
            n = len(sets)
            yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([histogram(s) for s in sets], pa.binary())], ["kind", "doc_id", "n", "set_id", "blob"])
            for s in sets:
                parts.append(s)
                held += len(s)
                if held >= _CHUNK:
                    blobs.append(blob(parts))
                    parts, held = [], 0
        if held:
            blobs.append(blob(parts))
        n = len(blobs)
        yield pa.RecordBatch.from_arrays([pa.array([1] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(blobs, pa.binary())], ["kind", "doc_id", "n", "set_id", "blob"])

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for x in b.column(0).to_pylist():
            n = len(x) // 12
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, "<i8", n)), pa.array(np.frombuffer(x, "<u4", n, 8 * n).astype(np.int64))], ["token", "df"])


def ordered(s: np.ndarray, frequent: np.ndarray, df: np.ndarray) -> np.ndarray:
    """The set rare first. ``frequent`` (sorted) with ``df``; all other shingles come before, by hash."""
    if len(frequent) == 0:
        return s
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    weight = np.where(frequent[at] == s, df[at], 0)
    return s[np.lexsort((s, weight))]


def postings(order, buckets: int):
    """Per chunk and bucket of shingles the postings of the prefixes of its distinct sets."""

    def packed(parts):
        p = np.concatenate(parts)
        bucket = (p["token"] % np.uint64(buckets)).astype(np.int32)
        at = np.argsort(bucket, kind="stable")
        p, bucket = p[at], bucket[at]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = np.append(cuts[1:], len(p))
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts], pa.int32()), pa.array([p[i:j].tobytes() for i, j in zip(cuts, ends, strict=True)], pa.binary())], ["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, df = order.value
        seen: set[int] = set()
        parts, held = [], 0
        for b in _by_bytes(batches, 0):
            for s in shingle_sets(b.column(0)):
                n = len(s)
                if n == 0 or (i := set_id(s)) in seen:
                    continue
                seen.add(i)
                k = n - least_common(n) + 1
                p = np.empty(k, _POST)
                p["token"] = ordered(s, frequent, df)[:k]
                p["set_id"], p["n"], p["pos"] = i, n, np.minimum(np.arange(k), 65535)
                parts.append(p)
                held += k
                if held >= _CHUNK // 2:
                    yield packed(parts)
                    parts, held = [], 0
        if held:
            yield packed(parts)

    return run


def possible(n_a, pos_a, n_b, pos_b):
    """Length and positional filter for two sets that share the shingle at these places of their orders (arrays)."""
    low, high = np.minimum(n_a, n_b).astype(np.int64), np.maximum(n_a, n_b).astype(np.int64)
    before = np.minimum(pos_a, pos_b).astype(np.int64)
    after = np.minimum(n_a.astype(np.int64) - pos_a, n_b.astype(np.int64) - pos_b)
    return (5 * low >= 4 * high) & linked(before + after, low, high)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (bucket, blob), a bucket's together: first comparisons (kind 0) and lists of three or more (kind 1)."""

    def found(blobs):
        p = np.frombuffer(b"".join(blobs), _POST)
        # within a shingle: earliest place first, then smaller sets
        p = p[np.lexsort((p["set_id"], p["n"], p["pos"], p["token"]))]
        same = np.zeros(len(p), bool)
        same[1:] = p["token"][1:] == p["token"][:-1]
        copy = same.copy()
        copy[1:] &= p["set_id"][1:] == p["set_id"][:-1]
        p = p[~copy]
        head = np.ones(len(p), bool)
        head[1:] = p["token"][1:] != p["token"][:-1]
        starts = np.flatnonzero(head)
        size = np.diff(np.append(starts, len(p)))
        lead = p[np.repeat(starts, size)]
        ok = ~head & possible(lead["n"], lead["pos"], p["n"], p["pos"])
        pairs = np.unique(np.column_stack([np.minimum(lead["set_id"], p["set_id"]), np.maximum(lead["set_id"], p["set_id"])])[ok], axis=0)
        lists: dict[bytes, bytes] = {}
        for i, k in zip(starts[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            m = np.empty(k, _MEMBER)
            for f in _MEMBER.names:
                m[f] = p[f][i : i + k]
            ids = np.sort(m["set_id"]).tobytes()
            key = hashlib.blake2b(ids, digest_size=8).digest()
            if key not in lists:
                lists[key] = m.tobytes()  # the same members once, with the places of one shingle
        return pairs, lists

    def rows(blobs):
        pairs, lists = found(blobs)
        n, m = len(pairs), len(lists)
        keys = [int.from_bytes(k, "little", signed=True) for k in lists]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([0] * n + [1] * m, pa.int32()),
                pa.array([*pairs[:, 0].tolist(), *[None] * m], pa.int64()),
                pa.array([*pairs[:, 1].tolist(), *[None] * m], pa.int64()),
                pa.array([*[None] * n, *keys], pa.int64()),
                pa.array([*[None] * n, *lists.values()], pa.binary()),
            ],
            ["kind", "a", "b", "list_id", "members"],
        )

    now, blobs = None, []
    for b in batches:
        for bucket, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if bucket != now and blobs:
                yield rows(blobs)
                blobs = []
            now = bucket
            blobs.append(blob)
    if blobs:
        yield rows(blobs)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for key, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            m = np.frombuffer(x, _MEMBER)
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(m), pa.int64()), pa.array(m["set_id"]), pa.array(m["n"].astype(np.int64)), pa.array(m["pos"].astype(np.int64))], ["list_id", "set_id", "n", "pos"])


def parts_allow(one: np.ndarray, many: np.ndarray, n_one, n_many) -> np.ndarray:
    """Suffix filter: what the sizes of 256 parts of two sets have in common must reach what a link needs.

    Histograms as rows of 256 bytes; a row of zeros (not known) allows all.
    """
    known = many.any(1) & one.any()
    upto = np.minimum(many, one).astype(np.int32).sum(1)
    return ~known | linked(np.minimum(upto, np.minimum(n_one, n_many)), n_one, n_many)


def _grams(blobs: list) -> np.ndarray:
    return np.array([np.frombuffer(x, np.uint8) if x else np.zeros(256, np.uint8) for x in blobs], np.uint8).reshape(-1, 256)


def _allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n_a, n_b, gram_a, gram_b) -> the pairs that the suffix filter allows."""
    for b in batches:
        n_a, n_b = (b.column(k).to_numpy() for k in (2, 3))
        x, y = (_grams(b.column(k).to_pylist()) for k in (4, 5))
        known = x.any(1) & y.any(1)
        upto = np.minimum(np.minimum(x, y).astype(np.int32).sum(1), np.minimum(n_a, n_b))
        ok = ~known | linked(upto, n_a, n_b)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) -> the linked ones; a text's set is made once a piece of a batch."""
    for b in _by_bytes(batches, 3):
        sets: dict[int, np.ndarray] = {}
        ids = (b.column(0).to_pylist(), b.column(1).to_pylist())
        for side in (0, 1):
            where = {}
            for k, i in enumerate(ids[side]):
                if i not in sets and i not in where:
                    where[i] = k
            made = shingle_sets(b.column(2 + side).take(pa.array(list(where.values()), pa.int64())))
            sets.update(zip(where, made, strict=True))
        out = []
        for i, j in zip(*ids, strict=True):
            x, y = sets[i], sets[j]
            if linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
                out.append((i, j))
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])


def _compare(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Linked pairs among ``pairs`` (a, b: ids, distinct). ``rows``: doc_id, text."""
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = rows.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_compared, "a long, b long")


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(members: root, node, n, pos, gram) -> pairs in different components that the filters allow."""
    for b in batches:
        for members in b.column(0):
            m = members.as_py()
            root, node, n, pos = (np.array([r[k] for r in m], np.int64) for k in ("root", "node", "n", "pos"))
            gram = _grams([r["gram"] for r in m])
            order = np.argsort(n, kind="stable")
            root, node, n, pos, gram = root[order], node[order], n[order], pos[order], gram[order]
            stop = np.searchsorted(n, 5 * n // 4, side="right")
            for i in range(len(n)):
                j = np.arange(i + 1, stop[i])
                j = j[(root[j] != root[i]) & possible(n[i], pos[i], n[j], pos[j])]
                if len(j):
                    j = j[parts_allow(gram[i], gram[j], n[i], n[j])]
                if len(j):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[j], node[i])), pa.array(np.maximum(node[j], node[i]))], ["a", "b"])


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; the set holds the distinct 5-word shingles, or the whole
    sequence if there are fewer words. Sets are compared by 64-bit hashes of their shingles. Texts that are null, empty
    or blank have an empty set and link with nothing; equal sets are linked. Every row is a document: rows that repeat
    an id are linked only if their texts are, and rows without one come after all others, so a component of such rows
    alone has no id. Other columns are ignored; an empty table gives no rows. ``settings``: see ``linked_rows``.
    """
    named = id_text(docs, id_col, text_col)
    if unique_ids(named):
        return linked_rows(named, **settings)
    rows = with_row(named).select(F.col("row"), "doc_id", "text")
    out = linked_rows(rows.select(F.col("row").alias("doc_id"), "text"), **settings)
    own = rows.select(F.col("row").alias("doc_id"), F.col("doc_id").alias("own"))
    least = rows.select(F.col("row").alias("component_id"), F.col("doc_id").alias("least"))
    return out.join(own, "doc_id").join(least, "component_id").select(F.col("own").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"))


def linked_rows(
    rows: DataFrame,
    often: int = 4,
    frequent_df: int = 64,
    most_frequent: int = 1_000_000,
    bucket_bytes: int = 64 << 20,
) -> DataFrame:
    """``ngram_join`` of rows (doc_id, text) with unique ids and without nulls.

    ``often``, ``frequent_df`` and ``most_frequent`` only shape the order of shingles: those with a counted frequency
    of ``frequent_df`` or more, at most ``most_frequent`` of them (12 bytes each, which bounds what is broadcast), come
    last. No pair is lost by them. Postings are dealt to at least 1024 buckets, and one for every ``bucket_bytes``.
    """
    spark = rows.sparkSession
    buckets = max(1024, (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // bucket_bytes)
    about = cut(rows.mapInArrow(facts(often), _FACTS))
    sizes = about.filter("kind = 0").select("doc_id", "n", "set_id")
    frequent = (
        about.filter("kind = 1").select("blob").mapInArrow(_counts, "token long, df long")
        .groupBy("token").agg(F.sum("df").alias("df")).filter(F.col("df") >= frequent_df)
        .orderBy(F.desc("df"), "token").limit(most_frequent).toPandas()
    )
    token = frequent["token"].to_numpy(np.int64).view(np.uint64)
    at = np.argsort(token)
    order = spark.sparkContext.broadcast((token[at], frequent["df"].to_numpy(np.int64)[at].astype(np.uint32)))

    posted = rows.select("text").mapInArrow(postings(order, buckets), _POSTED)
    found = cut(posted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_lists, _FOUND))

    # a node is the smallest id that has a set
    nodes = about.filter("kind = 0 AND n > 0").groupBy("set_id").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("blob").alias("gram"))
    nodes = cut(nodes)
    side = lambda k, c: nodes.select(F.col("set_id").alias(k), F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("gram").alias(f"gram_{c}"))
    first = found.filter("kind = 0").select("a", "b").distinct().join(side("a", "x"), "a").join(side("b", "y"), "b")
    first = first.select(F.col("x").alias("a"), F.col("y").alias("b"), "n_x", "n_y", "gram_x", "gram_y").mapInArrow(_allowed, "a long, b long")
    first = cut(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    links = cut(_compare(first, rows))
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    lists = found.filter("kind = 1").select("list_id", "members").dropDuplicates(["list_id"]).mapInArrow(_members, "list_id long, set_id long, n long, pos long")
    placed = nodes.select("set_id", "node", "gram").join(roots.withColumnRenamed("id", "node"), "node", "left").select("set_id", "node", "gram", F.coalesce("root", "node").alias("root"))
    member = F.struct("root", "node", "n", "pos", "gram")
    open_lists = lists.join(placed, "set_id").groupBy("list_id").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.collect_list(member).alias("members")).filter("lo != hi")
    rest = cut(open_lists.select("members").mapInArrow(_across, "a long, b long").distinct().join(first, ["a", "b"], "left_anti"))
    more = cut(_compare(rest, rows))
    if more.limit(1).count():
        roots = components(links.union(more).select(F.col("a").alias("u"), F.col("b").alias("v")))

    classes = nodes.join(roots.withColumnRenamed("id", "node"), "node", "left").select("set_id", F.coalesce("root", "node").alias("component_id"))
    out = sizes.join(classes, "set_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
