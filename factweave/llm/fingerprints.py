"""Document fingerprints by Order MinHash (DataFrame operations only).

The k-mers of a text are its runs of ``K`` words, or of ``K`` code points if it has few or very long words (as texts
without spaces do), each numbered by its occurrence, so repeats stay apart. One hash
deals the numbered k-mers to ``1 << SLOT_BITS`` slots (one-permutation hashing); a slot selects its two smallest,
puts them back in text order and hashes the pair. A slot of two texts agrees only if the selected k-mers and their
order agree, which is what makes the signature follow edit distance rather than set overlap. Everything happens within
a row, on arrays of longs that pack (hash, position), so sorting is primitive and nothing is exploded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, id_text, unique_ids, with_row

K = 5
#: Code points a word, on average, beyond which a text is read by code points.
LONG_WORDS = 32
SLOT_BITS = 6
_POS_BITS = 26
_POS_MASK = (1 << _POS_BITS) - 1
_SLOT_SHIFT = 63 - SLOT_BITS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+"))


def units(text: Column) -> Column:
    """What k-mers are made of: words, or code points where there are fewer than ``K`` words or they are long."""

    def chosen(w):
        by_words = (F.size(w) >= K) & (F.char_length(text) <= LONG_WORDS * F.size(w))
        return F.when(by_words | (F.size(w) == 0), w).otherwise(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)))

    return let(words(text), chosen)


def _pack(h: Column, pos: Column) -> Column:
    """37 bits of the hash above 26 bits of the position; not negative, so order is by hash, then position."""
    return F.shiftleft(F.shiftrightunsigned(h, 27), _POS_BITS).bitwiseOR(pos.cast("long").bitwiseAND(F.lit(_POS_MASK).cast("long")))


def _high(x: Column) -> Column:
    return F.shiftright(x, _POS_BITS)


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_POS_MASK).cast("long"))


def _kmers(w: Column) -> Column:
    return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(
        F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - K, F.lit(0))), lambda i: _pack(F.xxhash64(*[F.get(w, i + j) for j in range(K)]), i)))
    )


def _numbered(s: Column) -> Column:
    """Each k-mer hashed again with its occurrence number, found by binary descent in the sorted array."""

    def start(x, i):
        return F.aggregate(
            F.array(*[F.lit(1 << b) for b in range(25, -1, -1)]),
            i,
            lambda at, jump: F.when((at >= jump) & (_high(F.get(s, at - jump)) == _high(x)), at - jump).otherwise(at),
        )

    def number(x, i):
        first = (i == 0) | (_high(F.get(s, i - 1)) != _high(x))
        return F.when(first, F.lit(0)).otherwise(i - start(x, i))

    return F.sort_array(F.transform(s, lambda x, i: _pack(F.xxhash64(_high(x), number(x, i)), _low(x))))


def _slot(x: Column) -> Column:
    return F.shiftright(x, _SLOT_SHIFT)


def _smallest_two(s: Column) -> Column:
    return F.filter(s, lambda x, i: (i < 2) | (_slot(F.get(s, i - 2)) != _slot(x)))


def _tuples(s: Column) -> Column:
    def entry(x, i):
        y = F.get(s, i + 1)
        pair = F.when(y.isNull() | (_slot(y) != _slot(x)), F.xxhash64(_high(x))).when(_low(x) <= _low(y), F.xxhash64(_high(x), _high(y))).otherwise(F.xxhash64(_high(y), _high(x)))
        leads = (i == 0) | (_slot(F.get(s, i - 1)) != _slot(x))
        return F.when(leads, F.shiftleft(_slot(x), 32).bitwiseOR(F.shiftrightunsigned(pair, 32)))

    return F.filter(F.transform(s, entry), lambda x: x.isNotNull())


def signature(text: Column) -> Column:
    """array<bigint>: (slot << 32 | 32 bits of the tuple's hash) for every slot that got a k-mer."""
    return let(units(text), lambda w: let(_kmers(w), lambda s: let(_numbered(s), lambda n: let(_smallest_two(n), _tuples))))


def likeness(a: Column, b: Column) -> Column:
    """Share of the slots used by either text in which both agree; two empty texts are alike."""
    slots = lambda x: F.transform(x, lambda v: F.shiftright(v, 32))
    used = F.size(F.array_union(slots(a), slots(b)))
    return F.when(used == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / used)


def as_string(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lower(F.hex(x))), " ")


def followers(ids: DataFrame) -> DataFrame:
    """(row, next_row, n_chars) with the next row in ascending order, after the last the first. ``row`` is unique.

    Rows are range-partitioned once; the next one comes from a window within a partition, and for a partition's last
    from the table of the partitions' first rows, which has one row per partition.
    """
    parts = cut(ids.repartitionByRange("row").withColumn("part", F.spark_partition_id()))
    firsts = parts.groupBy("part").agg(F.min("row").alias("first"))
    order = Window.orderBy("part")
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(order), F.first("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    inside = F.lead("row").over(Window.partitionBy("part").orderBy("row"))
    return parts.withColumn("inside", inside).join(firsts, "part").select("row", F.coalesce("inside", "after").alias("next_row"), "n_chars")


def order_minhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, sig): the operator itself, one row per row of ``docs``."""
    return id_text(docs, id_col, text_col).withColumn("sig", signature(F.col("text")))


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses (see the module for the method).

    The edited text is the text whose last ``floor(n_chars / 2)`` code points are replaced by the first as many (or
    all) of the next document's. Null counts as empty; an empty text has an empty fingerprint, is like another empty
    one (1.0) and unlike all others (0.0). Fewer than ``K`` units make one k-mer. A single document is its own next.
    Every row is a document: rows without an id come after all others, and rows that repeat an id follow one another in
    an order that is fixed for the call. Other columns are ignored; an empty table gives an empty result.
    """
    named = id_text(docs, id_col, text_col)
    unique = unique_ids(named)
    wide = named.withColumn("row", F.col("doc_id")) if unique else with_row(named)
    rows = wide.select("row", "text")
    # both joins read the same columns of these, so their texts are shuffled once
    signed = rows.withColumn("sig", signature(F.col("text")))
    ids = rows.select("row", F.char_length("text").cast("long").alias("n_chars"))
    before = followers(ids).select(F.col("next_row").alias("row"), F.col("row").alias("prev_row"), F.expr("int(n_chars div 2)").alias("need"))
    heads = signed.join(before, "row").select(F.col("prev_row").alias("row"), F.expr("left(text, need)").alias("head"), F.col("sig").alias("next_sig"))
    both = signed.join(heads, "row").withColumn("n_chars", F.char_length("text"))
    edited = both.select("row", F.col("n_chars").cast("long").alias("n_chars"), "sig", "next_sig", F.expr("concat(left(text, n_chars - n_chars div 2), head)").alias("edited"))
    signed2 = edited.select("row", "n_chars", "sig", "next_sig", F.sha2("edited", 256).alias("edited_sha256"), signature(F.col("edited")).alias("edited_sig"))
    signed2 = signed2.withColumnRenamed("row", "doc_id") if unique else signed2.join(wide.select("row", "doc_id"), "row")
    return signed2.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_string(F.col("sig")).alias("fingerprint"),
        as_string(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
