"""All ten queries and the pipeline on odd tables: missing and repeated ids, blanks, long texts, ties, clashing names."""

from __future__ import annotations

import hashlib
import random

import pytest

import corpus_pipeline
from factweave.llm.queries import QUERIES

from .helpers import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, copies string, hash string, key string"


def written(spark, folder, rows):
    docs = [(i, t, g, s, None if t is None else len(t), 1, "x", "x", "x") for i, t, g, s in rows]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 2), 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rng = random.Random(6)
    long = " ".join(prose(rng, 40) for _ in range(2500))
    same = prose(rng, 80)
    rows = [(i, prose(rng, rng.randint(1, 90)), "en" if i % 3 else None, f"s{i % 3}" if i % 7 else None) for i in range(30)]
    rows += [(40, long, "en", "s1"), (41, long + " end", "en", "s1"), (42, same, "en", None), (43, same, "xx", None), (42, same, "en", "s0"), (42, "another text under the same id", "en", "s0")]
    rows += [(50, None, "en", "s0"), (51, "", "en", "s0"), (52, " \n\t", "en", "s0"), (53, "1 2 3 !?", "en", "s0"), (54, "日本語" * 60, None, "s2"), (55, "\n".join(["a line that is there twice " * 4] * 2), "en", "s2")]
    rows += [(None, same, "en", "s0"), (None, None, None, None), (None, "no id " + prose(rng, 30), "en", "s1")]
    return written(spark, str(tmp_path_factory.mktemp("odd")), rows), rows


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return written(spark, str(tmp_path_factory.mktemp("empty")), [])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_one_row_a_row(spark, odd, empty, name):
    folder, rows = odd
    got = [r.asDict() for r in QUERIES[name](spark, folder).collect()]
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, *_ in rows)
    assert QUERIES[name](spark, empty).count() == 0
    of = {r["doc_id"]: r for r in got}
    if name == "op3_exact_dedup":
        assert sum(r["kept"] for r in got) == len({r["text_sha256"] for r in got})
        # the copies of one text: the smallest id stays, of the rows that have it one
        assert [(r["keep_id"], r["group_size"]) for r in got if r["doc_id"] == 43] == [(42, 4)]
    if name == "op4_bpe_coding":
        assert of[50] == of[51] | {"doc_id": 50} and of[50]["n_tokens"] == 0 and of[50]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    if name == "op7_mix_sources":
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in got) and of[50]["size"] == 0
    if name == "op8_ngram_join":
        assert of[41]["component_id"] == of[40]["component_id"] == 40 and of[43]["component_id"] == 42 and of[52]["n_shingles"] == 0
    if name == "op9_language_id":
        assert {of[i]["lang_pred"] for i in (50, 51, 52, 53)} == {"und"} and all(0 <= r["score"] <= 1 for r in got)
    if name == "op10_quality":
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got) and len({of[i]["score"] for i in (50, 51)}) == 1
    if name == "op6_line_dedup":
        assert (of[55]["n_lines"], of[55]["n_removed"]) == (2, 0) and of[43]["n_removed"] == 1 and of[50]["n_lines"] == 0


def test_pipeline(spark, odd, empty):
    folder, rows = odd
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
    kept = corpus_pipeline.near_copies(spark, corpus_pipeline.exact_copies(spark, docs, folder), folder).collect()
    texts = [r.text for r in kept]
    assert len(texts) == len(set(texts)) and sum(t is not None and t.startswith("no id") for t in texts) == 1
    assert corpus_pipeline.run(spark, empty).count() == 0
    assert corpus_pipeline.run(spark, folder).count() > 20
