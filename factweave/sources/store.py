"""Claims and snapshots: JSON lines, Parquet, versioned snapshots (survey S1-S3, S6, S14, S15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators.writing import CLAIM, FACTS

CLAIM_SCHEMA = ", ".join(f"{n} {t}" for n, t in CLAIM.items())


def read_claims(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """JSON lines or Parquet with the columns of a claim; malformed lines are kept apart in ``_corrupt``."""
    if fmt == "json":
        return spark.read.schema(f"{CLAIM_SCHEMA}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return spark.read.parquet(path)


def save_snapshot(facts: DataFrame, root: str, version: int) -> str:
    """A version is complete once its folder has _SUCCESS; readers take the newest complete one."""
    path = f"{root}/version={version:010d}"
    facts.write.mode("overwrite").parquet(path)
    return path


def versions(spark: SparkSession, root: str) -> list[int]:
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    found = [s.getPath() for s in fs.listStatus(base)]
    return sorted(int(p.getName().split("=")[1]) for p in found if p.getName().startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def load_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    known = versions(spark, root)
    if not known:
        return None
    return spark.read.parquet(f"{root}/version={known[-1] if version is None else version:010d}")


def save_buckets(facts: DataFrame, root: str, version: int) -> str:
    """A version that holds only the buckets (column ``bucket``) that changed."""
    path = f"{root}/version={version:010d}"
    facts.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    return path


def load_buckets(spark: SparkSession, root: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """The facts of ``buckets`` (all by default) in their newest versions, up to ``version``; null if there are none."""
    jvm = spark._jvm
    found: dict[str, str] = {}
    for v in reversed([v for v in versions(spark, root) if version is None or v <= version]):
        base = jvm.org.apache.hadoop.fs.Path(f"{root}/version={v:010d}")
        for s in base.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(base):
            name = s.getPath().getName()
            if name.startswith("bucket=") and (buckets is None or int(name.split("=")[1]) in buckets):
                found.setdefault(name, s.getPath().toString())
    return spark.read.schema(FACTS).parquet(*found.values()) if found else None


def append_confidence(memories: DataFrame, path: str, day) -> None:
    """One row per memory and day."""
    memories.select(F.lit(day).alias("date"), "id", F.round("confiance", 4).alias("confiance")).write.mode("append").parquet(path)


def save_memories(memories: DataFrame, path: str) -> None:
    """The memories of the first generation as JSON lines, their confidence with four decimals; no vectors."""
    rows = memories.drop("embedding", "vecteur")
    rows.withColumn("confiance", F.round("confiance", 4)).write.mode("overwrite").json(path)


def save_report(rows: DataFrame, path: str, fmt: str = "csv") -> None:
    """The results of an experiment as CSV with a header, or as JSON lines."""
    writer = rows.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.json(path)
