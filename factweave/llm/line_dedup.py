"""Line dedup by winnowing over line hashes (DataFrame operations only).

A text is the sequence of its lines that are not blank. Of every window of ``WINDOW`` consecutive lines, and of every
window of fewer lines with ``MIN_WORDS`` words or more, the smallest line hash (the first on ties) is selected: these
fingerprints are guaranteed, as equal windows select the same line in the same place. Positions of equal fingerprints
are joined; what occurs once goes no further. From each joined position a match is extended both ways over the windows
that selected it, by the hash of their lines, and meets the first place of the same lines, not all places, so the work
is linear in the number of places however often a line occurs. A longer match is one of neighbouring fingerprints, so
its windows cover all of it; the lines of every window that starts earlier elsewhere are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, id_text, with_row
from .fingerprints import let

WINDOW = 3
MIN_WORDS = 50


def _bare(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, SPACE + "+", " "))


def line_hashes(text: Column) -> Column:
    """array<struct<h, words>> of the lines that are not blank; runs of white space count as one space."""
    lines = F.filter(F.transform(F.split(text, "\n"), _bare), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("words")))


def _size(words: int) -> list[tuple[int, int]]:
    """(offset of the selected line, lines) of all windows that can select a line."""
    return [(o, size) for size in range(1, words + 1) for o in range(size)]


def winnow(lines: Column) -> Column:
    """array<struct<mark, windows>>: the selected lines, each with the windows (at, size, hash) that select it."""

    def selected(x, i):
        def window(offset, size):
            members = [x if j == offset else F.get(lines, i + (j - offset)) for j in range(size)]
            least = [x["h"] < members[j]["h"] if j < offset else x["h"] <= members[j]["h"] for j in range(size) if j != offset]
            ok = F.lit(True) if size == 1 else (i >= offset) & (i + (size - 1 - offset) < F.size(lines))
            for c in least:
                ok = ok & c
            if size < WINDOW:
                ok = ok & (sum(m["words"] for m in members) >= MIN_WORDS)
            return F.when(ok, F.struct((i - offset).alias("at"), F.lit(size).alias("size"), F.xxhash64(*[m["h"] for m in members]).alias("hash")))

        return F.struct(x["h"].alias("mark"), F.array_compact(F.array(*[window(o, size) for o, size in _size(WINDOW)])).alias("windows"))

    return F.filter(F.transform(lines, selected), lambda s: F.size(s["windows"]) > 0)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(row, starts): the windows (at, size) that start earlier elsewhere. ``docs``: row (unique, in order), text."""
    prints = cut(docs.select("row", F.explode(let(line_hashes(F.col("text")), winnow)).alias("p")).select("row", "p.mark", "p.windows"))
    joined = prints.join(prints.groupBy("mark").agg(F.count("*").alias("n")).filter("n > 1").select("mark"), "mark", "left_semi")
    extended = joined.select("row", F.explode("windows").alias("w")).select("row", "w.*")
    first = extended.groupBy("hash", "size").agg(F.min(F.struct("row", "at")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("hash", "size", "first")
    later = extended.join(first, ["hash", "size"]).filter(F.struct("row", "at") > F.col("first"))
    return later.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("at", "size"))).alias("starts"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, n_runs, kept_text.

    A line goes if a run that holds it, of ``WINDOW`` lines or of fewer with ``MIN_WORDS`` words, starts earlier too
    (smaller id, or earlier in the same text). Null counts as empty; blank lines are no lines and stay in ``kept_text``.
    Rows without an id come after all others;
    rows that repeat an id are documents of their own, in an order that is fixed for the call. Other columns are ignored; an empty table gives an empty result.
    """
    rows = with_row(id_text(docs, id_col, text_col))
    joined = rows.join(repeated_windows(rows), "row", "left").select("doc_id", "text", "starts")
    # lines with their number among those not blank (null: blank)
    gone = F.coalesce(F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1)))), F.array().cast("array<int>"))
    split = F.split(F.col("text"), "\n")
    t = joined.select("doc_id", "text", gone.alias("gone"), "starts")
    kept_all = F.col("text")

    def kept(lines):
        full = F.transform(lines, lambda x: _bare(x) != "")
        index = F.filter(F.transform(full, lambda b, i: F.when(b, i)), lambda x: x.isNotNull())  # n-th line -> its place
        return let(index, lambda at: let(F.transform(F.col("gone"), lambda g: F.get(at, g)), lambda out: F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(out, i)), "\n")))

    n_lines = F.size(F.filter(split, lambda x: _bare(x) != ""))
    runs = F.size(F.filter(F.col("gone"), lambda g: ~F.array_contains(F.col("gone"), g - 1)))
    return t.select(
        "doc_id",
        n_lines.cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_removed"),
        runs.cast("long").alias("n_runs"),
        F.when(F.size("gone") == 0, kept_all).otherwise(let(split, kept)).alias("kept_text"),
    )


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS ix
  FROM documents
), n AS (
  SELECT *, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS bare FROM l
), p AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ix) - 1 AS pos, len(string_split(bare, ' ')) AS words FROM n WHERE bare <> ''
), q AS (
  SELECT *, lead(bare, 1) OVER d AS b1, lead(bare, 2) OVER d AS b2, lead(words, 1) OVER d AS w1 FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY ix)
), w AS (
  SELECT doc_id, pos, 3 AS size, bare || chr(10) || b1 || chr(10) || b2 AS win FROM q WHERE b2 IS NOT NULL
  UNION ALL SELECT doc_id, pos, 2, bare || chr(10) || b1 FROM q WHERE words + w1 >= 50
  UNION ALL SELECT doc_id, pos, 1, bare FROM q WHERE words >= 50
), r AS (
  SELECT doc_id, pos, size, row_number() OVER (PARTITION BY size, win ORDER BY doc_id, pos) AS nth FROM w
), g AS (
  SELECT DISTINCT doc_id, pos + j AS pos FROM r, (SELECT unnest([0, 1, 2]) AS j) WHERE nth > 1 AND j < size
), m AS (
  SELECT n.doc_id, n.ix, n.line, p.pos, g.pos AS gone,
         g.pos IS NOT NULL AND lag(g.pos) OVER (PARTITION BY n.doc_id, p.pos IS NULL ORDER BY n.ix) IS NULL AS starts
  FROM n LEFT JOIN p ON n.doc_id = p.doc_id AND n.ix = p.ix LEFT JOIN g ON p.doc_id = g.doc_id AND p.pos = g.pos
)
SELECT doc_id, count(pos) AS n_lines, count(gone) AS n_removed, count(*) FILTER (WHERE starts) AS n_runs,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY ix) FILTER (WHERE gone IS NULL), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
