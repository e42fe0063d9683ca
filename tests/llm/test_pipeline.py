import corpus_pipeline
from factweave.llm import langid

from .helpers import corpus
from .test_exact_dedup import brute as exact_brute
from .test_ngram_join import brute as near_brute


def test_stages(spark, tmp_path):
    rows = [(i, t, "en" if i % 2 else None, "s" + str(i % 3), len(t or "")) for i, t in corpus()]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    d = str(tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    text = {r[0]: r[1] for r in rows}

    first = corpus_pipeline.language_id(spark, docs, d)
    assert first.columns == docs.columns
    left = {r.doc_id for r in first.collect()}
    assert left == {i for i, t in text.items() if t and any(map(str.isalpha, t))}

    second = corpus_pipeline.exact_copies(spark, first, d)
    copies = exact_brute([(i, text[i]) for i in left])
    left = {r.doc_id for r in second.collect()}
    assert left == {i for i, c in copies.items() if c[2]}

    third = corpus_pipeline.near_copies(spark, second, d)
    near = near_brute([(i, text[i]) for i in left])
    left = {r.doc_id for r in third.collect()}
    assert left == {i for i, c in near.items() if c[1] == i}

    fourth = corpus_pipeline.mixed(spark, third, d).collect()
    assert {r.doc_id for r in fourth} <= left and len(fourth) > 0
    words = sum(len(text[i].split()) for i in left)
    assert abs(sum(len(r.text.split()) for r in fourth) - words) <= 0.1 * words

    out = corpus_pipeline.run(spark, d).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in fourth)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_join", "mix_sources", "bpe_coding"]
    assert langid.UNKNOWN == "und"
