"""What the pipeline leaves on disk, and the steps that keep it small."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foldwright.llm import common, ngram_join
from foldwright.llm.common import numbered


def _tags(before):
    return sorted(re.sub(r".*/foldwright-|-[0-9a-f]{32}$", "", p) for p in set(common._scratch) - before)


def _texts(n):
    return [" ".join(f"w{(i * 31 + j * j) % 89}x{j}" for j in range(40)) for i in range(n)]


@pytest.mark.parametrize("stage", ["near_duplicates", "mixture"])
def test_stages_copy_no_parquet_input(spark, tmp_path, stage):
    rows = [(i // 2, t, "en", "s", 1) for i, t in enumerate(_texts(40))]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(str(tmp_path / "docs"))
    docs, before = spark.read.parquet(str(tmp_path / "docs")), set(common._scratch)
    getattr(corpus_pipeline, stage)(spark, docs, "").count()
    assert not [t for t in _tags(before) if t.endswith("-rows")]


def test_row_numbers(spark, tmp_path):
    path = str(tmp_path / "a b%c")
    spark.range(0, 1000, 1, 7).select("id", (F.col("id") % 3).alias("text")).write.parquet(path)
    df = spark.read.parquet(path)
    got = numbered(df, "t").collect()
    assert sorted(r["id"] for r in got) == list(range(1000)) and len({r["__row"] for r in got}) == 1000
    narrow = numbered(df.select("*"), "t").where("text = 1").select("id", "__row").collect()
    assert {r["id"]: r["__row"] for r in numbered(df, "t").where("text = 1").select("id", "__row").collect()} == {r["id"]: r["__row"] for r in got if r["text"] == 1}
    assert len({r["__row"] for r in narrow}) == len(narrow)
    twice = numbered(spark.read.parquet(path, path), "t").collect()  # a path given twice
    assert len({r["__row"] for r in twice}) == len(twice)
    doubled = numbered(df.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))), "t").collect()
    assert len({r["__row"] for r in doubled}) == 2000
    assert numbered(df.limit(0), "t").count() == 0


def test_rounds_of_lists_find_the_same_links(spark):
    texts = _texts(60)
    rng = np.random.default_rng(3)
    for i in range(30):
        w = texts[i].split()
        w[int(rng.integers(40))] = "changed"
        texts.append(" ".join(w))
    texts += ["a b", "a b", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    want = sorted(map(tuple, ngram_join.join(docs, 5, 80).collect()))
    assert sorted(map(tuple, ngram_join.join(docs, 5, 80, rounds=3).collect())) == want
    keys = ngram_join.Keys(80)
    whole, part = ngram_join.keyed(docs, 5, keys).count(), [ngram_join.keyed(docs, 5, keys, i, 3).count() for i in range(3)]
    assert max(part) < 0.5 * whole and sum(part) >= whole


def test_batch_size_is_set_back(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), common.small_batches(spark, 10):
        assert spark.conf.get(key) == "10"
        raise ZeroDivisionError
    assert spark.conf.get(key) == before


def test_run_leaves_one_stage_behind(spark, tmp_path):
    rows = [(i, t, "en", f"s{i % 2}", 1) for i, t in enumerate(_texts(40))]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    before = set(common._scratch)
    df = corpus_pipeline.run(spark, str(tmp_path))
    assert _tags(before) == ["stage-mixing"]
    assert df.count() > 0
