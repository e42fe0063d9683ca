import random

WORDS = "the quick brown fox jumps over lazy dog while seven wizards make toxic brew for evil queen and jack of clubs in zone".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, rows, schema="doc_id long, text string"):
    """With an extra column whose name an operator might use."""
    df = spark.createDataFrame(rows, schema)
    from pyspark.sql import functions as F

    for name in ("key", "n", "size", "digest", "chunk"):
        df = df.withColumn(name, F.lit("x"))
    return df


def corpus(seed=1):
    """Texts with copies, near copies, shared passages, repeats, nulls and blanks."""
    rng = random.Random(seed)
    base = prose(rng, 120)
    passage = prose(rng, 60)
    rows = [base, base, base.upper(), base + " tail", prose(rng, 3), "", None, " \t\n", "é" * 300, "é" * 300 + "x", prose(rng, 4), prose(rng, 5)]
    for i in range(12):
        w = base.split()
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = "changed" + str(i)
        rows.append(" ".join(w))
    for _ in range(8):
        rows.append(prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 30))
    rows.append("\n".join([prose(random.Random(5), 9)] * 40))
    rows.append("ab" * 400)
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(i * 3 + 1, rows[j]) for i, j in enumerate(order)]


EMPTY = []
