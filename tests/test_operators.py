import json
import math

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import dates, text
from lumenfold.operators import clusters, evaluation, ordered, quality, retrieval, stats, structured
from lumenfold.plans import questions
from lumenfold.sources import providers, tables
from lumenfold.streaming import incremental


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace as N

    from lumenfold import runtime

    conf = lambda v: N(get=lambda *_: v)
    far = N(sparkContext=N(master="spark://host:7077", getCheckpointDir=lambda: None), conf=conf(None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_dir(far)
    assert runtime.shared_dir(N(sparkContext=far.sparkContext, conf=conf("hdfs://x/y/"))) == "hdfs://x/y"


def test_staged_tables_are_left_behind_by_nobody(spark, tmp_path):
    from lumenfold import runtime

    rows, at = runtime.stage(spark.range(3), "x")
    assert rows.count() == 3 and runtime.new_path(spark, "x") != at
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "part").write_text("x")
    runtime._leave(spark, f"file://{tmp_path}/a")
    assert not (tmp_path / "a").exists()


def test_text_functions(spark):
    v = lambda x: F.lit(x)
    assert one(spark, text.preview(v("a  b\nc"), 10)) == "a b c"
    assert one(spark, text.preview(v("x" * 12), 10)) == "x" * 10 + "..."
    assert one(spark, text.word_preview(v("a b c"), 2)) == "a b..."
    assert one(spark, text.truncated(v("abcd"), 2)) == "ab\n[TRUNCATED]"
    assert one(spark, text.after_separator(v("h\n--- DREAM TEXT ---\n t --- DREAM TEXT --- u "))) == "t --- DREAM TEXT --- u"
    assert one(spark, text.after_separator(v(" none "))) == "none"
    assert one(spark, text.slug(v("  Ann-Lee! "))) == "ann_lee"
    assert one(spark, text.slug(v("!!"))) == "character"
    assert one(spark, text.identity(v(" Weiß  X"))) == "weiss x"
    assert one(spark, text.tokens(v("'Tis don't A1 b"))) == ["tis", "don't", "a", "b"]
    assert one(spark, text.ordered_distinct(F.array(v("  Big  Dog"), v("big dog"), v("")))) == ["big dog"]
    assert one(spark, text.ordered_distinct(F.array(v("Ann  Lee"), v("ann lee")), fold=False)) == ["Ann Lee"]
    assert one(spark, text.comma_tags(v(" a, ,b "))) == ["a", "b"]
    assert one(spark, text.markdown_cell(v("a|b\nc"))) == "a\\|b c"
    assert one(spark, text.clean_phrase(v(' "a  b" '))) == "a b"
    assert one(spark, text.safe_name(v("a b/c"))) == "a_b_c"


def test_dates(spark):
    assert one(spark, dates.iso_date(F.lit("2022-02-31"))) is None
    assert one(spark, dates.iso_date(F.lit("20220201"))) is None
    d = F.lit("2022-05-03").cast("date")
    assert [one(spark, dates.period_label(dates.period(d, f), f)) for f in "MQY"] == ["5-2022", "Q2-2022", "2022"]
    p = lambda a, b: one(spark, dates.placeholder(F.lit(a), F.lit(b)))
    assert (p("0/1/2022", "day"), p("1/1/2022", "month"), p("1/1/2022", "day"), p(None, None)) == (True, True, False, False)
    assert [p(x, "day") for x in ("3/5/0", "2022/0/5", "00/00/0000", "10/20/2000", "x/0/1", "12345/0/1")] == [True, True, True, False, False, False]


def entries(spark, rows):
    return spark.createDataFrame(rows, "journal_id string, entry_no long, dream_id string, date string, year int, date_precision string, date_sort string, tags array<string>, text string, word_count int")


def day(n, iso, journal="j", tags=None, words=1):
    y, m, d = map(int, iso.split("-"))
    return (journal, n, f"d{n}", f"{m}/{d}/{y}", y, "day", iso, tags, "t", words)


def test_chunks_of_an_order_agree_with_one_window(spark):
    rows = spark.createDataFrame([(i % 3, i * 7 % 50, i % 5) for i in range(50)], "g int, o long, v int")
    for chunk in (3, 1000):
        a = ordered.with_running_sum(rows, "g", "o", F.col("v"), "s", chunk=chunk)
        a = ordered.with_neighbour(a, "g", "o", {"p": F.col("v")}, chunk=chunk)
        a = ordered.with_neighbour(a, "g", "o", {"n": F.col("v")}, after=True, chunk=chunk)
        got = sorted(tuple(r) for r in a.select("g", "o", "s", "p", "n").collect())
        want = sorted(tuple(r) for r in rows.selectExpr("g", "o", "sum(v) over (partition by g order by o) s", "lag(v) over (partition by g order by o) p", "lead(v) over (partition by g order by o) n").collect())
        assert got == want


def test_isolated_run_and_what_is_charged_to_it(spark):
    df = entries(spark, [day(1, "2022-01-01"), day(2, "2023-01-05"), day(3, "2022-01-09")])
    blocks = quality.date_blocks(df)
    assert [(r.first_block, r.last_block, r.expected_year) for r in quality.isolated_runs(blocks).collect()] == [(2, 2, 2022)]
    f = {r.block: r.reasons for r in quality.findings(df).collect()}
    assert set(f) == {2} and f[2].startswith("short run of 1 date(s) in 2023 is surrounded by dates in 2022; changing the year to 2022 restores chronological order; next date 1/9/2022 goes backward")
    leap = entries(spark, [day(1, "2022-02-01"), day(2, "2024-02-29"), day(3, "2022-03-09")])
    assert quality.isolated_runs(quality.date_blocks(leap)).count() == 0
    with pytest.raises(ValueError):
        quality.isolated_runs(blocks, 0)


def test_empty_tables(spark):
    df = entries(spark, [])
    assert stats.length_stats(df).first().asDict() == {"entries": 0, "mean_words": 0.0, "median_words": 0.0}
    assert stats.entries_per_period(df).count() == stats.tag_stats(df).count() == quality.findings(df).count() == 0
    assert stats.longest_and_shortest(df, "entry_no").count() == 0
    assert stats.common_words(df, "entry_no", []).count() == 0


def test_tag_counts(spark):
    df = entries(spark, [day(1, "2022-01-01", tags=["a", "a"]), day(2, "2022-01-02", tags=["a", "b"]), day(3, "2022-01-03", tags=[])])
    assert {r.tag: (r.entries, r.percent) for r in stats.tag_stats(df).collect()} == {"a": (2, 66.67), "b": (1, 33.33)}
    assert [(r.tag, r.uses) for r in stats.top_tags(df).collect()] == [("a", 3), ("b", 1)]
    with pytest.raises(ValueError):
        stats.dated(df, "2023-01-01", "2022-01-01")
    assert stats.dated(df, "2021-9-1", "2022-1-2").count() == 2  # compared as dates, not as texts
    with pytest.raises(ValueError, match="end_date"):
        stats.dated(df, "2022-01-01", "soon")
    assert stats.dated(df, keep_undated=True).count() == 3


def test_first_of_equals_wins(spark):
    df = entries(spark, [day(2, "2022-01-01", words=5), day(1, "2022-01-02", words=5)])
    assert [(r.kind, r.entry_no) for r in stats.longest_and_shortest(df, "entry_no").collect()] == [("longest", 1), ("shortest", 1)]


def test_fusion(spark):
    hits = spark.createDataFrame([(0, 1, "A", 1, 0.5), (0, 2, "B", 2, 0.1), (0, 3, "A", 3, 0.2)], "q int, s int, id string, rank int, score double")
    rows = retrieval.fuse(hits, by="q", query="s", key="id", most=5).collect()
    assert [(r.id, r.fused, r.place) for r in rows] == [("A", 0.03226646, 1), ("B", 0.01612903, 2)]


def test_cosine_of_zero_and_of_other_length(spark):
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, retrieval.cosine(a(0, 0), a(1, 2))) == 0.0
    with pytest.raises(Exception, match="length"):
        one(spark, retrieval.cosine(a(1), a(1, 2)))


def test_knn_blocks_agree(spark):
    v = spark.createDataFrame([(i, [math.sin(i * k) for k in range(1, 9)]) for i in range(60)] + [(60, None)], "vec_id long, embedding array<double>")
    q = v.filter("vec_id % 5 = 0")
    a = sorted(map(tuple, retrieval.knn(v, q, 3).collect()))
    b = sorted(map(tuple, retrieval.knn(v, q, 3, block_mb=0.0005).collect()))
    assert a == b and len(a) == 36
    ranks = {}
    for query_id, _, score, rank in [(r.query_id, r.vec_id, r.score, r["rank"]) for r in retrieval.knn(v, q, 3).collect()]:
        ranks.setdefault(query_id, []).append((rank, score))
    assert all(s == sorted(s) and [x for _, x in sorted(s)] == sorted(x for _, x in s) for s in map(sorted, ranks.values()))


def test_summary_of_judgements(spark):
    j = spark.createDataFrame([("m", x) for x in (5, 4, 3, 1)] + [("n", None)], "model string, relevance int")
    rows = {r.model: tuple(r)[1:] for r in evaluation.summarize(j, "model").collect()}
    assert rows["m"] == (3.25, 3.5, 2, 4, 0.5) and rows["n"][0] is None and rows["n"][4] is None
    bad = spark.createDataFrame([("a", 0, 1, "x"), ("b", 5, 1, " "), ("c", 5, 1, "x"), ("c", 5, 1, "x")], "id string, relevance int, generic_overlap int, reason string")
    assert sorted((r.id, r.problem) for r in evaluation.faulty_judgements(bad, ["id"]).collect()) == [("a", "relevance"), ("b", "reason"), ("c", "repeated")]


def test_lift(spark):
    df = spark.createDataFrame([(1, 0, ["t"]), (2, 0, ["t"]), (3, -1, ["u"]), (4, 1, None)], "id int, label int, tags array<string>")
    r = clusters.tag_lift(df).collect()
    assert [(x.label, x.tag, x.n, x.lift) for x in r] == [(0, "t", 2, 2.0)]


def test_term_weights_by_brute_force(spark):
    docs = {1: "red fox red", 2: "red dog", 3: "blue dog", 4: ""}
    df = spark.createDataFrame(list(docs.items()), "id int, text string")
    got = {(r.id, r.term): r.weight for r in clusters.term_weights(df, "id", "text", least_docs=2, most_share=1.0).collect()}
    grams = {k: t.split() + [" ".join(p) for p in zip(t.split(), t.split()[1:])] for k, t in docs.items()}
    df_of = {g: sum(g in v for v in grams.values()) for v in grams.values() for g in v}
    want = {}
    for k, v in grams.items():
        raw = {g: v.count(g) * (math.log(5 / (1 + df_of[g])) + 1) for g in set(v) if df_of[g] >= 2}
        n = math.sqrt(sum(x * x for x in raw.values()))
        want |= {(k, g): x / n for g, x in raw.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_silhouette_by_brute_force(spark):
    v = [(0, 0, [1.0, 0.1]), (1, 0, [1.0, 0.2]), (2, 1, [0.1, 1.0]), (3, 1, [0.3, 1.0]), (4, -1, [1.0, 1.0])]
    r = clusters.quality(spark.createDataFrame(v, "vec_id int, label int, embedding array<double>")).first()
    d = lambda a, b: 1 - sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b)
    s = []
    for i, l, x in v[:4]:
        a = [d(x, y) for j, m, y in v[:4] if m == l and j != i]
        b = [d(x, y) for _, m, y in v[:4] if m != l]
        a, b = sum(a) / len(a), sum(b) / len(b)
        s.append((b - a) / max(a, b))
    assert (r.points, r.clusters, r.noise_share) == (5, 2, 0.2) and abs(r.silhouette - sum(s) / 4) < 1e-5


def test_silhouette_in_blocks(spark):
    v = spark.createDataFrame([(i, i % 7, [math.sin(i * k) for k in range(1, 9)]) for i in range(90)], "vec_id long, label int, embedding array<double>")
    assert clusters.quality(v).first() == clusters.quality(v, block_mb=0.0002).first()


def test_clusterer_runs(spark):
    v = spark.createDataFrame([(i, [float(i % 3 == k) + 0.01 * (i % 7) for k in range(4)]) for i in range(60)], "vec_id long, embedding array<double>")
    assert clusters.cluster(v, dims=2, groups=3).count() == 60
    assert clusters.automatic_label(["a", "b", "c"], ["b", "d", "e", "f"]) == "a, b, d, e"


def test_records_from_json(spark):
    good = {f: [] for f in structured.LISTS} | {"lucidity": True, "lucidity_level": "lucid"} | {k: v[0] for k, v in structured.ENUMS.items() if k != "lucidity_level"} | {"tone": "calm", "summary": "s"}
    rows = [good, good | {"lucidity": False}, good | {"more": 1}, {k: v for k, v in good.items() if k != "tone"}, good | {"violence": "huge"}, good | {"summary": " "}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)] + [(9, "nonsense")], "n int, raw string")
    got = {r.n: r.errors for r in structured.parse(df, "raw").collect()}
    kinds = [{"setting": [1, True, {"x": 1}]}, {"characters": [None, "a"]}, {"named_characters": "Ann Lee"}, {"tone": 5}, {"lucidity": "true"}, {"summary": None}, {"violence": " low "}, {"themes": [" A ", "a"]}, {"objects": None}]
    df2 = spark.createDataFrame([(i, json.dumps(good | k)) for i, k in enumerate(kinds)], "n int, raw string")
    rows2 = {r.n: r for r in structured.parse(df2, "raw").collect()}
    assert [rows2[i].errors for i in range(9)] == [["setting: not a list of texts"], ["characters: not a list of texts"], ["named_characters: not a list of texts"], ["tone: not a text"], ["lucidity: not a truth value"], ["summary: not a text"], [], [], ["objects: not a list of texts"]]
    assert rows2[6].violence == "low" and rows2[7].themes == ["a"]
    assert got == {0: [], 1: ["lucidity: contradicts lucidity_level"], 2: ["more: unexpected"], 3: ["tone: missing"], 4: ["violence: not allowed"], 5: ["summary: empty"], 9: ["not a JSON object"]}


def test_jsonl(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"dream_id":"a","date":"1/2/2022"}\n\n{"dream_id":"b","date":"1/3/2022","date_sort":null}\n')
    rows = tables.read_jsonl(spark, str(p)).orderBy("line_no").collect()
    assert [(r.line_no, r.dream_id, r.date_sort) for r in rows] == [(1, "a", "1/2/2022"), (3, "b", None)]
    p.write_text('{"dream_id":"a"}\nnot json\n')
    with pytest.raises(Exception, match="line 2"):
        tables.read_jsonl(spark, str(p)).collect()
    assert [r.bad_line for r in tables.read_jsonl(spark, str(p), strict=False).orderBy("line_no").collect()] == [None, "not json"]
    with pytest.raises(ValueError, match="repeat"):
        tables.check_unique(spark.createDataFrame([("a",), ("a",)], "k string"), ["k"])
    with pytest.raises(ValueError, match="not found"):
        tables.find(spark.createDataFrame([("a", 1)], "k string, o int"), "k", "z", "o")


def test_lines_of_split_files(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text("".join("\n" if i % 7 == 3 else json.dumps({"dream_id": f"d{i}"}) + "\n" for i in range(4000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        rows = tables.read_jsonl(spark, str(p))
        assert rows.select(F.spark_partition_id()).distinct().count() > 1
        assert sorted((r.line_no, r.dream_id) for r in rows.collect()) == [(i + 1, f"d{i}") for i in range(4000) if i % 7 != 3]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_selection_and_recovery(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert tables.select_entries(df, "k").count() == 2 and tables.select_entries(df, "k", "b").first().v == 2
    with pytest.raises(ValueError, match="not found"):
        tables.select_entries(df, "k", "z")
    t = tmp_path / "t"
    tables.replace(df, str(t))
    t.rename(tmp_path / "t.old")  # as if a writer had ended between its moves
    tables.replace(df.limit(1), str(t))
    assert spark.read.parquet(str(t)).count() == 1 and not (tmp_path / "t.old").exists()


def test_related_rows_are_all_there(spark):
    v = spark.createDataFrame([(i, [1.0, i / 100]) for i in range(80)], "vec_id long, embedding array<double>")
    q = v.filter("vec_id = 0")
    assert retrieval.related(v, q, 0.0).count() == 79 and retrieval.related(v, q, 0.0, most=5).count() == 5
    assert retrieval.related(v, q, 0.9, most=0).count() == 0


def test_density_clusters(spark):
    rows = [(i, [1.0, 0.001 * i, 0.0]) for i in range(12)] + [(20 + i, [0.0, 0.001 * i, 1.0]) for i in range(12)] + [(50, [0.5, 5.0, 0.5]), (51, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.cluster for r in clusters.density_clusters(v, cut=0.2, core=3).collect()}
    assert {got[i] for i in range(12)} == {0} and {got[20 + i] for i in range(12)} == {20} and got[50] == -1 and 51 not in got


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", 1)], "k string, v int")
    out = str(tmp_path / "j")
    tables.write_jsonl(df, out)
    assert any('"v":null' in r.value for r in spark.read.text(out).collect())
    with pytest.raises(Exception):
        tables.write_jsonl(df, out)
    t = str(tmp_path / "t")
    for n in (1, 2):
        tables.replace(df.limit(n), t)
        assert spark.read.parquet(t).count() == n
    c = str(tmp_path / "c")
    v = spark.createDataFrame([("x", 1), ("y", 2)], "collection_name string, id int")
    tables.write_collection(v, c)
    tables.write_collection(v.filter("collection_name = 'x'").withColumn("id", F.lit(7)), c)
    assert sorted((r.collection_name, r.id) for r in spark.read.parquet(c).collect()) == [("x", 7), ("y", 2)]
    a = str(tmp_path / "a")
    tables.write_assignments(spark.createDataFrame([(1, -1, 0.5, 1.0)], "id int, cluster int, x double, y double").withColumn("cluster_label", F.lit("z")), a)
    r = spark.read.option("header", True).csv(a).first()
    assert (r.cluster_label, r.x) == ("noise / ambiguous", "0.500000")


def test_models_fail_by_row(spark):
    class Picky:
        model = "picky"

        def __call__(self, texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no")
            return [t.upper() for t in texts]

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "n int, t string")
    rows = {r.n: (r.out, r.status, r.error_type) for r in providers.with_model(df, "t", Picky(), "out", "string").collect()}
    assert rows == {1: ("A", "completed", None), 2: (None, "failed", "RuntimeError"), 3: (None, "skipped", None)}

    class Short:
        model = "short"

        def __call__(self, texts):
            return texts[:-1]

    rows = {r.n: (r.out, r.status, r.error_type) for r in providers.with_model(df, "t", Short(), "out", "string").collect()}
    assert rows == {1: (None, "failed", "ValueError"), 2: (None, "failed", "ValueError"), 3: (None, "skipped", None)}
    assert providers.finished("", None) == providers.NO_ANSWER and providers.finished("x", "length").endswith("value.]") and providers.finished("x", "stop") == "x"


def test_answers(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "id long, text string")
    index = docs.select("id", providers.hashed_embedding(F.col("text"), 8).alias("embedding"))
    asked = spark.createDataFrame([(100, "text 3")], "query_id long, question string").withColumn("embedding", providers.hashed_embedding(F.col("question"), 8))
    r = questions.answer(index, docs, asked, providers.EchoChat(), key="id", text_column="text", k=2).first()
    assert r.status == "completed" and r.answer.startswith("Answer only")
    assert questions.query_plan(" Q ", ["q", "Other", '"other"'], 4) == ["Q", "Other"]
    with pytest.raises(ValueError):
        questions.query_plan("q", [], 9)
    assert "| a\\|b |" in questions.markdown_table(spark.createDataFrame([("a|b",)], "x string"))


def test_streamed_upsert(spark, tmp_path):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    schema = "k string, n int, v string"
    spark.createDataFrame([("a", 1, "old"), ("b", 2, "b")], schema).write.parquet(src)
    merge = incremental.upsert_into(dst, ["k"], "n")
    for _ in range(2):
        q = incremental.stream_of(spark, src, schema).writeStream.foreachBatch(merge).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        spark.createDataFrame([("a", 3, "new")], schema).write.mode("append").parquet(src)
    q = incremental.stream_of(spark, src, schema).writeStream.foreachBatch(merge).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.k, r.v) for r in spark.read.parquet(dst).collect()) == [("a", "new"), ("b", "b")]
