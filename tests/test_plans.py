import json

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import text
from lumenfold.operators import retrieval, structured
from lumenfold.plans import extraction, reports
from lumenfold.sources.providers import EchoChat

GOOD = {f: ["X  y", "x y"] for f in structured.LISTS} | {"lucidity": False, "lucidity_level": "none"} | {k: v[0] for k, v in structured.ENUMS.items() if k != "lucidity_level"} | {"tone": "calm", "summary": "s"}


# classes inside functions go to the workers by value


def extractor():
    good = json.dumps(GOOD)

    class Extractor:
        model = "extractor"

        def __call__(self, prompts):
            return [good if p.partition("<entry>")[2].strip().startswith("good") else "no json" for p in prompts]

    return Extractor()


def judging():
    answer = json.dumps([{"dream_id": "a", "relevance": 5, "generic_overlap": 1, "reason": "r"}, {"dream_id": "z", "relevance": 9, "generic_overlap": 1, "reason": "r"}])

    class Judge:
        model = "judge"

        def __call__(self, prompts):
            return [answer for _ in prompts]

    return Judge()


def test_extraction_fails_by_row_and_skips_what_is_done(spark):
    entries = spark.createDataFrame([("a", "good"), ("b", "bad"), ("c", "good")], "dream_id string, text string")
    records = spark.createDataFrame([("c", 4), ("a", 3)], "dream_id string, schema_version int")
    rows = {r.dream_id: r for r in extraction.extract(entries, records, extractor(), ["dream_id"]).collect()}
    assert set(rows) == {"a", "b"} and rows["a"].status == "completed" and rows["a"].themes == ["x y"] and rows["a"].schema_version == 4
    assert rows["b"].status == "failed" and rows["b"].error == "not a JSON object"
    assert extraction.extract(entries, records, extractor(), ["dream_id"], overwrite=True).count() == 3


def test_judging(spark):
    hits = spark.createDataFrame([(1, "a"), (1, "b")], "query_id int, dream_id string")
    ctx = spark.createDataFrame([(1, "text")], "query_id int, context string")
    rows, problems = extraction.judge(hits, ctx, judging(), query="query_id", key="dream_id")
    assert rows.count() == 2
    assert sorted((r.dream_id, r.problem) for r in problems.collect()) == [("b", "missing"), ("z", "relevance"), ("z", "unexpected")]


def test_focus():
    assert extraction.focus(question=" q ") == "q" and extraction.focus(passage="b", text="abc") == "b" and extraction.focus(text="t") == "t"
    for bad in ({"passage": "x", "text": "abc"}, {}):
        with pytest.raises(ValueError):
            extraction.focus(**bad)


def test_labels_and_comparison(spark):
    tags = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (0, 3, "c")], "label int, rank int, tag string")
    terms = spark.createDataFrame([(0, 1, "b"), (0, 2, "d"), (1, 1, "e")], "label int, rank int, term string")
    assert {r.label: r.cluster_label for r in extraction.cluster_labels(tags, terms, "label").collect()} == {0: "a, b, d", 1: "e"}
    ctx = spark.createDataFrame([(1, "one two three")], "query_id int, context string")
    rows = extraction.compare({"i": ctx, "j": ctx}, [EchoChat(1, "m"), EchoChat(2, "n")], query="query_id").collect()
    assert sorted((r.index_name, r.model, r.answer) for r in rows) == [("i", "m", "one"), ("i", "n", "one two"), ("j", "m", "one"), ("j", "n", "one two")]


def test_analysis(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id long, text string")
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "id long, embedding array<double>")
    r = extraction.analyze(index.filter("id = 1"), index, docs, EchoChat(40), key="id", text_column="text").collect()
    assert len(r) == 1 and r[0].status == "completed" and "y" in r[0].answer and "z" not in r[0].answer.split()


def test_excerpt(spark):
    assert spark.range(1).select(text.excerpt(F.lit("a <b>\n& 'c'"))).first()[0] == "a &lt;b&gt; &amp; &#x27;c&#x27;"


def test_reports(spark):
    runs = spark.createDataFrame([("a", "c", "ok", 0.5, None, None), ("b", "d", "error", 0.1, "ValueError", "no")], "embed_model string, collection_name string, status string, retrieval_seconds double, error_type string, error string")
    hits = spark.createDataFrame([("a", 1, "x", "1/2/2020", "one|two\n", 0.25, 5, 1, "a|b"), ("b", 1, "y", "1/3/2020", "t", None, None, None, None)], "embed_model string, rank int, dream_id string, date string, text string, distance double, relevance int, generic_overlap int, reason string")
    summary = spark.createDataFrame([("a", 5.0, 5.0, 1, 1)], "embed_model string, mean_relevance double, median_relevance double, relevant long, judged long")
    r = reports.retrieval_report({"Top k": 1}, runs, hits, summary, target_text="t")
    assert "- Top k: `1`" in r and "| 1 | x | 1/2/2020 | 0.2500 | 5 | 1 | a\\|b |" in r and "- Scores of 4–5: `1/1`" in r and "**ValueError:** no" in r and "#### 1. y — 1/3/2020" in r
    cells = spark.createDataFrame([("m", "a", "c", "completed", "yes", None, None, 0.5, 2.0), ("n", "a", "c", "failed", None, "E", "bad", 0.5, None)], "model string, index_name string, collection_name string, status string, answer string, error_type string, error string, retrieval_seconds double, generation_seconds double")
    r = reports.comparison_report({"Mode": "ask"}, {"q": "?"}, {"k": 1}, cells, hits.filter("embed_model = 'a'").withColumnRenamed("embed_model", "index_name"))
    assert "## 1. m + a" in r and "- Total time: `2.5` seconds" in r and "### Response\n\nyes" in r and "**E:** bad" in r
    sizes = spark.createDataFrame([(0, "home", 3), (1, "sea", 2)], "label int, cluster_label string, size long")
    terms = spark.createDataFrame([(0, 2, "b"), (0, 1, "a")], "label int, rank int, term string")
    tags = spark.createDataFrame([(0, 1, "t", 3, 1.25)], "label int, rank int, tag string, n long, lift double")
    members = spark.createDataFrame([(0, 1, "x", None, "a\n b")], "label int, rank int, dream_id string, date string, text string")
    r = reports.cluster_report({"Dreams": 5}, {}, sizes, terms, tags, members)
    assert "Distinctive terms: a, b" in r and "`t` (1.2× baseline; 3)" in r and "- **x** (unknown): a b" in r and "## Cluster 1: sea\n\nDreams: 2\n\nDistinctive terms: none" in r


def test_pool_keeps_the_last_value_and_context_its_details(spark):
    a = spark.createDataFrame([(1, "x", 0.1), (1, "y", 0.2)], "q int, k string, score double")
    b = spark.createDataFrame([(1, "x", 0.9)], "q int, k string, score double")
    assert {r.k: r.score for r in retrieval.pooled([a, b], query="q", key="k", values=["score"]).collect()} == {"x": 0.9, "y": 0.2}
    docs = spark.createDataFrame([("x", "text", "1/2/2020")], "k string, t string, date string")
    c = retrieval.rank_context(b.withColumn("rank", F.lit(1)), docs, query="q", key="k", text="t", date="date", score="score").first().context
    assert c == "[1] x\nDATE: 1/2/2020\nSCORE: 0.9000\ntext"
