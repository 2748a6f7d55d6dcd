import random
import re

import public_tokenizers
import tiktoken

import corpus_pipeline
from foldwright.llm.bpe import load_ranks

from .test_ngram_join import brute
from .test_text_models import base_spans


def test_stages_have_the_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "secret scans", "mixing sources", "byte-level BPE"]


def test_one_row_of_each_group_stays(spark, tmp_path):
    same, other = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(5, same), (5, same), (None, same), (9, same), (9, other), (None, "red green blue black white"), (None, "red green blue black white"), (1, ""), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert got.columns == ["doc_id", "text"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(5, same), (9, other), rows[5], (1, ""), (1, None)]))


def test_whole_pipeline(spark, tmp_path):
    rng = random.Random(1)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    rows = []
    for i in range(80):
        text = " ".join(rng.choices(vocabulary, k=rng.randrange(20, 90)))
        if i % 8 == 3:
            text += " password=abcdefgh12345"
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
    for i in range(80, 110):  # copies with one word changed
        w = rows[i - 80][1].split()
        w[-1] = "changed"
        rows.append((i, " ".join(w), "en", "s0", 1))
    rows += [(200, None, "en", "s1", 0), (201, "123 456", "en", "s1", 7), (202, rows[0][1], None, None, 1)]
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        seen[name] = docs.collect()
        if name != "byte-level BPE":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {r["doc_id"] for r in seen["language ID"]}
    assert kept == {r[0] for r in rows} - {200, 201}
    own = sorted((r["doc_id"], r["text"]) for r in seen["language ID"])
    _, roots = brute([t for _, t in own], 5, 80)
    assert sorted(r["doc_id"] for r in seen["n-gram Jaccard join"]) == sorted({own[i][0] for i in roots})
    texts = dict(own)
    for r in seen["secret scans"]:
        assert ("[SECRET]" in r["text"]) == bool(base_spans(texts[r["doc_id"]])) and r["n_chars"] == len(r["text"])
        assert "[SECRET]" in r["text"] or r["text"] == texts[r["doc_id"]]
    words = lambda rs: sum(len(re.findall(r"\S+", r["text"])) for r in rs)
    assert abs(words(seen["mixing sources"]) - 1.5 * words(seen["secret scans"])) < 400
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    final = {r["doc_id"]: r["text"] for r in seen["mixing sources"]}
    assert len(seen["byte-level BPE"]) == len(seen["mixing sources"])
    for r in seen["byte-level BPE"]:
        assert list(r["ids"]) == encoding.encode_ordinary(final[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["byte-level BPE"])


def test_stages_on_odd_tables(spark, tmp_path):
    """Repeated rows, null ids, ids shared by two texts, further columns, no rows."""
    text = lambda i: " ".join(f"w{(i * 7 + j * j) % 97}x{j}" for j in range(30))
    rows = [(i // 2, text(i), "en", f"s{i % 3}", 9, "size", i, "node") for i in range(60)]
    rows += [rows[3]] * 3 + [(None, text(100), None, None, None, None, None, None), (None, text(101), "fr", "s1", 1, "", 0, "")]
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, passes bigint, node string"
    docs = spark.createDataFrame(rows, columns).repartition(3)
    for table in (docs, docs.limit(0)):
        table.write.mode("overwrite").parquet(str(tmp_path / "odd"))
        own = spark.read.parquet(str(tmp_path / "odd"))
        n = own.count()
        for name, stage in corpus_pipeline.STAGES[:4]:
            got = stage(spark, own, str(tmp_path))
            assert got.columns == own.columns, name
            assert got.count() == n if name != "n-gram Jaccard join" and name != "mixing sources" else True
        assert corpus_pipeline.tokens(spark, own, str(tmp_path)).count() == n
    kept = [r["text"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(kept) == sorted({r[1] for r in rows})
    mixed = [r["text"] for r in corpus_pipeline.mixture(spark, docs, "").collect()]
    words = 30 * len(rows)
    assert abs(30 * len(mixed) - 1.5 * words) <= 30 * 4 and max(map(mixed.count, {r[1] for r in rows[:3]})) <= 2


def test_passes_are_each_rows_own(spark):
    """Rows that share an id and differ in text: the mix isn't overshot."""
    docs = spark.createDataFrame([(1, f"a b c d {i}", "en", "s", 1) for i in range(200)], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(2)
    assert abs(corpus_pipeline.mixture(spark, docs, "").count() - 300) <= 1
