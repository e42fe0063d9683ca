"""Exact dedup by Grace hashing.

Records are dealt to buckets by a hash of their content. A bucket is read as a stream into an open-addressing
table (a CPython dict: open addressing, and equal hashes are followed by a comparison of the complete key). When the
table would outgrow ``memory_bytes`` the rest of the bucket is partitioned again, by the next bits of the hash, into
spill files, and each of those is treated the same way. Before the shuffle each input partition collapses its own
copies in such a table, so a bucket gets one record per distinct content and input partition however many copies exist.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, unique_ids, with_row

_DELETED = b" \t\n\v\f\r"
_PARTIAL = "digest binary, content binary, n_chars long, doc_id long, n long"
_CLASSES = "digest binary, keep_id long, group_size long"
_FAN_OUT = 16
#: Nibbles of a SHA-256: beyond the last, records have one digest and so one content.
_MAX_LEVEL = 64


def _better(a: tuple, b: tuple) -> bool:
    """a, b: (n_chars, doc_id). More code points win, then the smaller id; a null id comes last."""
    return (-a[0], a[1] is None, a[1] or 0) < (-b[0], b[1] is None, b[1] or 0)


class ContentTable:
    """Groups by complete content: content -> [digest, n_chars, doc_id, n]."""

    def __init__(self):
        self.rows: dict[bytes, list] = {}
        self.bytes = 0

    def add(self, digest: bytes, content: bytes, n_chars: int, doc_id, n: int) -> None:
        row = self.rows.get(content)
        if row is None:
            self.rows[content] = [digest, n_chars, doc_id, n]
            self.bytes += len(content) + 200
        else:
            row[3] += n
            if _better((n_chars, doc_id), (row[1], row[2])):
                row[1], row[2] = n_chars, doc_id


def _partial_batch(t: ContentTable) -> pa.RecordBatch:
    rows = list(t.rows.items())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for _, r in rows], pa.binary()),
            pa.array([c for c, _ in rows], pa.binary()),
            pa.array([r[1] for _, r in rows], pa.int64()),
            pa.array([r[2] for _, r in rows], pa.int64()),
            pa.array([r[3] for _, r in rows], pa.int64()),
        ],
        ["digest", "content", "n_chars", "doc_id", "n"],
    )


def collapse(memory_bytes: int):
    """Map side: the copies within one input partition become one record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = ContentTable()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = text.as_py()
                content = s.encode("utf-8").translate(None, _DELETED)
                t.add(hashlib.sha256(content).digest(), content, len(s), doc_id, 1)
                if t.bytes >= memory_bytes:
                    yield _partial_batch(t)
                    t = ContentTable()
        if t.rows:
            yield _partial_batch(t)

    return run


def _spilled(path: str) -> Iterator[tuple]:
    with open(path, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def grace(records: Iterator[tuple], memory_bytes: int, folder: str, level: int = 0) -> Iterator[tuple]:
    """Yield (digest, keep_id, group_size) of every content with two rows or more among ``records``.

    A record that finds its content in the table is merged there even after the table is full, so a spill file
    only holds contents that are not in memory; each level uses other bits of the digest.
    """
    t = ContentTable()
    spills: list = []
    try:
        for r in records:
            if t.bytes < memory_bytes or level >= _MAX_LEVEL or r[1] in t.rows:
                t.add(*r)
                continue
            if not spills:
                spills = [open(os.path.join(folder, f"{level}-{i}-{os.urandom(4).hex()}"), "wb") for i in range(_FAN_OUT)]
            pickle.dump(r, spills[(r[0][level // 2] >> (4 * (level % 2))) % _FAN_OUT], protocol=5)
    finally:
        for f in spills:
            f.close()
    seen: set[bytes] = set()
    for digest, _, keep, n in t.rows.values():
        if digest in seen:
            raise ValueError("two contents with one SHA-256")
        seen.add(digest)
        if n > 1:
            yield digest, keep, n
    del t, seen
    for f in spills:
        yield from grace(_spilled(f.name), memory_bytes, folder, level + 1)
        os.unlink(f.name)


def bucket_classes(memory_bytes: int):
    """Reduce side: one bucket, with task-local spill files that end with the task (as Spark's own spills do)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        local = [d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(d)]
        with tempfile.TemporaryDirectory(dir=local[0] if local else None) as folder:
            out: list = []
            for row in grace(records(), memory_bytes, folder):
                out.append(row)
                if len(out) >= 10_000:
                    yield _class_batch(out)
                    out = []
            if out:
                yield _class_batch(out)

    return run


def _class_batch(rows: list) -> pa.RecordBatch:
    d, k, n = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(d, pa.binary()), pa.array(k, pa.int64()), pa.array(n, pa.int64())], ["digest", "keep_id", "group_size"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory_bytes: int = 64 << 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Texts are equal when identical without the characters ``[\\x20\\x09-\\x0D]``; of a group one row stays, that with
    the most code points in its original text, then the smallest id. Null text counts as empty, so null, empty and
    blank texts form one group. Rows without an id come last among ties, and of rows that repeat an id the first in an
    order that is fixed for the call. Other columns are ignored. An empty table gives an empty result.
    ``memory_bytes`` bounds each task's table; beyond it the bucket is split into spill files.
    """
    named = id_text(docs, id_col, text_col)
    unique = unique_ids(named)
    rows = named.select(F.col("doc_id").alias("row"), "text", "doc_id") if unique else with_row(named).select("row", "text", "doc_id")
    classes = (
        rows.select("row", "text").mapInArrow(collapse(memory_bytes), _PARTIAL)
        .repartition("digest")
        .mapInArrow(bucket_classes(memory_bytes), _CLASSES)
        .select(F.lower(F.hex("digest")).alias("text_sha256"), F.col("keep_id").alias("keep_row"), "group_size")
    )
    small = rows.select(
        "row",
        "doc_id",
        F.sha2(F.translate("text", " \t\n\x0b\x0c\r", ""), 256).alias("text_sha256"),
        F.char_length("text").cast("long").alias("n_chars"),
    )
    joined = small.join(classes, "text_sha256", "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("row")).otherwise(F.col("keep_row"))
    out = joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.when(alone, F.lit(1).cast("long")).otherwise(F.col("group_size")).alias("group_size"),
        (F.col("row") == keep).alias("kept"),
        "text_sha256",
        "n_chars",
    )
    if unique:
        return out
    ids = rows.select(F.col("row").alias("keep_id"), F.col("doc_id").alias("keep_doc"))
    return out.join(ids, "keep_id").select("doc_id", F.col("keep_doc").alias("keep_id"), "group_size", "kept", "text_sha256", "n_chars")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, keep_id = doc_id AS kept, text_sha256,
       CAST(n_chars AS BIGINT) AS n_chars
FROM k
"""
