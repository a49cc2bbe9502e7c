"""Queries of scans, sinks, the journal grammar and plans around models, and the SQL that says the same."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold import runtime
from lumenfold.catalog import _COS, _DATED, _L2, _SQUASH, _embeddings, _knn_sql, query
from lumenfold.functions import text
from lumenfold.operators import quality, retrieval, stats, structured
from lumenfold.plans import extraction, questions
from lumenfold.runtime import table
from lumenfold.sources import journal, providers, tables

# --- scans, sinks and the journal grammar --------------------------------------------------------------------------
# Journals are made of entries whose text the grammar can hold: without headings, tag lines, blanks at line ends and
# line ends other than a line feed.

_ODD = r"[\s\p{Z}]\n|[\s\p{Z}]$|[\r\x{b}\x{c}\x{1c}-\x{1f}\x{85}\x{a0}\x{2028}\x{2029}\x{feff}]|(^|\n)\s*#|(^|\n)\s*\d{1,2}/\d{1,2}/\d{2,4}\s*(\n|$)"
_LINES = f"text <> '' AND text = trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AND NOT regexp_matches(text, '{_ODD}') AND regexp_matches(date, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$')"
_TAGS_OF = "list_filter(coalesce(tags, []), lambda x: regexp_matches(x, '^[A-Za-z0-9_?+-]+$'))"


def _journals(spark: SparkSession, d: str) -> DataFrame:
    """Journals of at most 50 entries each, a heading to an entry."""
    fit = (F.col("text") != "") & (F.col("text") == F.btrim("text", F.lit(" \t\n\r\x0b\x0c"))) & ~F.col("text").rlike(_ODD) & F.col("date").rlike(r"^\d{1,2}/\d{1,2}/\d{4}$")
    tags = F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda x: x.rlike("^[A-Za-z0-9_?+-]+$"))
    line = F.when(F.size(tags) > 0, F.concat(F.lit("#"), F.array_join(tags, " #"), F.lit("\n"))).otherwise("")
    entry = F.concat("date", F.lit("\n"), line, "text")
    rows = table(spark, d, "dreams").filter(fit).select(F.floor(F.col("entry_no") / 50).cast("string").alias("journal_id"), "entry_no", entry.alias("entry"))
    return rows.groupBy("journal_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entry_no", "entry"))), lambda x: x["entry"]), "\n\n").alias("content"))


_M, _D, _Y = (f"CAST(split_part(date, '/', {i}) AS INT)" for i in (1, 2, 3))
_PRECISION = f"CASE WHEN {_M} = 0 AND {_D} = 0 AND {_Y} = 0 THEN 'unknown' WHEN {_M} = 0 AND {_D} = 0 THEN 'year' WHEN {_D} = 0 THEN 'month' ELSE 'day' END"
_WORDS = "len(regexp_extract_all(text, '[\\p{L}\\p{N}_''\\p{M}]+'))"


@query(
    f"""SELECT journal_id, dream_id, date, CAST(CASE WHEN p <> 'unknown' THEN y END AS VARCHAR) AS year, CAST(CASE WHEN p IN ('month', 'day') THEN m END AS VARCHAR) AS month, CAST(CASE WHEN p = 'day' THEN d END AS VARCHAR) AS day, p AS date_precision,
CASE p WHEN 'year' THEN printf('%04d-01-01', y) WHEN 'month' THEN printf('%04d-%02d-01', y, m) WHEN 'day' THEN printf('%04d-%02d-%02d', y, m, d) END AS date_sort, tags, text, words AS word_count
FROM (SELECT CAST(CAST(floor(entry_no / 50) AS BIGINT) AS VARCHAR) AS journal_id, 'dream-' || {_Y} || '-' || {_M} || '-' || {_D} || '-0' AS dream_id, {_M} || '/' || {_D} || '/' || {_Y} AS date, {_Y} AS y, {_M} AS m, {_D} AS d, {_PRECISION} AS p, array_to_string({_TAGS_OF}, ' ') AS tags, text, {_WORDS} AS words FROM dreams WHERE {_LINES})"""
)
def journal_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries written as plain-text journals and parsed again."""
    rows = journal.parse_journals(_journals(spark, d), separator=1000)
    return _parts_as_text(rows.withColumn("tags", F.array_join("tags", " "))).drop("line_no")


def _parts_as_text(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("string") for c in ("year", "month", "day")})


_PLAIN = [
    ("a", "1/2/70\n#x #y\n#z\nOne.\nTwo\n\nThree\n\n\n0/0/22\nFour\n"),
    ("b", "﻿03/0/2021\n\nfirst\n\n#t\nsecond\n\nthird\n\n\n\n1/1/69\n\n\n"),
    ("c", "0/0/00\r\nonly\r\n#late\r\n"),
    ("e", "5/6/2020\none\n\ntwo\nlines\n\n#tag\nthree"),
]


@query(
    """SELECT * FROM (VALUES ('a', 'dream-1970-1-2-0', '1/2/1970', '1970-01-02', 'day', 'x y z', 'One.' || chr(10) || 'Two' || chr(10) || chr(10) || 'Three', 3), ('a', 'dream-2022-0-0-0', '0/0/2022', '2022-01-01', 'year', '', 'Four', 1),
('b', 'dream-2021-3-0-0', '3/0/2021', '2021-03-01', 'month', '', 'first' || chr(10) || chr(10) || '#t' || chr(10) || 'second' || chr(10) || chr(10) || 'third', 4), ('c', 'dream-2000-0-0-0', '0/0/2000', NULL, 'unknown', '', 'only' || chr(10) || '#late', 2),
('e', 'dream-2020-5-6-0', '5/6/2020', '2020-05-06', 'day', '', 'one', 1), ('e', 'dream-2020-5-6-1', '5/6/2020', '2020-05-06', 'day', '', 'two' || chr(10) || 'lines', 2), ('e', 'dream-2020-5-6-2', '5/6/2020', '2020-05-06', 'day', 'tag', 'three', 1)) t(journal_id, dream_id, date, date_sort, date_precision, tags, text, word_count)"""
)
def journal_grammar(spark: SparkSession, d: str) -> DataFrame:
    """The grammar on small journals: pivot of years, partial dates, leading tags, separators found, marks and line ends."""
    rows = journal.parse_journals(spark.createDataFrame(_PLAIN, "journal_id string, content string"))
    return rows.select("journal_id", "dream_id", "date", "date_sort", "date_precision", F.array_join("tags", " ").alias("tags"), "text", "word_count")


_ENTRY = "entry_no bigint, journal_id string, dream_id string, date string, year int, month int, day int, date_precision string, date_sort string, tags array<string>, text string, word_count int"


@query("SELECT entry_no, journal_id, dream_id, date, CAST(year AS VARCHAR) AS year, CAST(month AS VARCHAR) AS month, CAST(day AS VARCHAR) AS day, date_precision, date_sort, array_to_string(tags, '|') AS tags, text, word_count FROM dreams")
def jsonl_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries written as JSON Lines and read again, with a check of the key."""
    at = runtime.new_path(spark, "entries")
    tables.write_jsonl(table(spark, d, "dreams").select(*[c.split()[0] for c in _ENTRY.split(", ")]), at)
    rows = tables.check_unique(tables.read_jsonl(spark, at, T.StructType.fromDDL(_ENTRY)), ["entry_no"])
    return _parts_as_text(rows.drop("file", "line_no").withColumn("tags", F.array_join("tags", "|")))


@query("SELECT entry_no, journal_id, dream_id FROM dreams WHERE journal_id = 'j0000000' ORDER BY entry_no LIMIT 1")
def first_entry(spark: SparkSession, d: str) -> DataFrame:
    return tables.find(table(spark, d, "dreams"), "journal_id", "j0000000", "entry_no").select("entry_no", "journal_id", "dream_id")


@query("SELECT entry_no, dream_id FROM dreams WHERE journal_id = 'j0000000'")
def selected_entries(spark: SparkSession, d: str) -> DataFrame:
    return tables.select_entries(table(spark, d, "dreams"), "journal_id", "j0000000").select("entry_no", "dream_id")


@query("SELECT * FROM (VALUES ('and'), ('moon'), ('the'), ('über')) t(word)")
def stop_word_list(spark: SparkSession, d: str) -> DataFrame:
    at = runtime.new_path(spark, "stop-words")
    spark.createDataFrame([("  Moon ",), ("# a remark",), ("",), ("the",), ("Über",)], "value string").write.text(at)
    return spark.createDataFrame([(w,) for w in tables.stop_words(spark, at, ["the", "and"])], "word string")


@query("SELECT collection_name, count(*) AS vectors, any_value(CAST(len(embedding) AS INT)) AS dims FROM dream_vectors v JOIN vector_collections c USING (collection_name) WHERE collection_name = 'dreams' AND len(embedding) = dims GROUP BY 1")
def collection_rows(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "dream_vectors").join(F.broadcast(table(spark, d, "vector_collections").select("collection_name", "dims")), "collection_name")
    rows = tables.collection(v.filter(F.size("embedding") == F.col("dims")), "dreams")
    return rows.groupBy("collection_name").agg(F.count("*").alias("vectors"), F.max(F.size("embedding")).alias("dims"))


@query("SELECT vec_no, collection_name, CAST(len(embedding) AS INT) AS dims FROM dream_vectors WHERE embedding IS NOT NULL AND collection_name IS NOT NULL")
def collection_sink(spark: SparkSession, d: str) -> DataFrame:
    """Collections written twice: the second time in place of the first."""
    at = runtime.new_path(spark, "collections")
    rows = table(spark, d, "dream_vectors").filter(F.col("embedding").isNotNull() & F.col("collection_name").isNotNull()).select("vec_no", "collection_name", F.size("embedding").alias("dims"))
    tables.write_collection(rows.withColumn("dims", F.lit(0)), at)
    tables.write_collection(rows, at)
    return spark.read.parquet(at).select("vec_no", "collection_name", "dims")


@query("SELECT CAST(vec_id AS VARCHAR) AS vec_id, CAST(CASE WHEN label = 9 THEN -1 ELSE label END AS VARCHAR) AS cluster, CASE WHEN label = 9 THEN 'noise / ambiguous' ELSE CAST(label AS VARCHAR) END AS cluster_label, printf('%.6f', CAST(label AS DOUBLE) / 4) AS x FROM embeddings")
def assignment_sink(spark: SparkSession, d: str) -> DataFrame:
    at = runtime.new_path(spark, "assignments")
    rows = table(spark, d, "embeddings").select("vec_id", F.when(F.col("label") == 9, -1).otherwise(F.col("label")).alias("cluster"), F.lit(None).cast("string").alias("cluster_label"), (F.col("label") / 4).alias("x"))
    tables.write_assignments(rows, at)
    return spark.read.option("header", True).csv(at).select("vec_id", "cluster", "cluster_label", "x")


@query(f"SELECT count(*) AS entries, count(d) AS dated FROM {_DATED}")
def undated_kept(spark: SparkSession, d: str) -> DataFrame:
    return stats.dated(table(spark, d, "dreams"), keep_undated=True).agg(F.count("*").alias("entries"), F.count("entry_date").alias("dated"))


@query(f"SELECT count(*) AS entries FROM {_DATED} WHERE d BETWEEN DATE '2018-09-01' AND DATE '2018-12-05'")
def lenient_bounds(spark: SparkSession, d: str) -> DataFrame:
    return stats.dated(table(spark, d, "dreams"), "2018-9-1", "2018-12-5").agg(F.count("*").alias("entries"))


@query(r"SELECT doc_id, replace(replace(text, '|', '\|'), chr(10), ' ') AS cell, trim(" + _SQUASH + ", ' ' || chr(39) || chr(34)) AS phrase, contains(text, 'the door') AS has_passage FROM documents WHERE text IS NOT NULL")
def text_cells(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").filter(t.isNotNull()).select("doc_id", text.markdown_cell(t).alias("cell"), text.clean_phrase(t).alias("phrase"), text.contains_passage(t, "the door").alias("has_passage"))


_RECORD = {f: [] for f in structured.LISTS} | {"tone": "calm", "lucidity": True, "lucidity_level": "lucid"} | {k: v[0] for k, v in structured.ENUMS.items() if k != "lucidity_level"} | {"summary": "s"}
_CHANGED: list[dict] = [{}, {"setting": [1, True]}, {"characters": [None, "a"]}, {"named_characters": "Ann Lee"}, {"tone": 5}, {"lucidity": "true"}, {"violence": " low "}, {"violence": "huge"}, {"summary": " "}, {"lucidity": False}, {"more": 1}]


@query(
    "SELECT * FROM (VALUES (0, ''), (1, 'setting: not a list of texts'), (2, 'characters: not a list of texts'), (3, 'named_characters: not a list of texts'), (4, 'tone: not a text'), (5, 'lucidity: not a truth value'), (6, ''), (7, 'violence: not allowed'), (8, 'summary: empty'), (9, 'lucidity: contradicts lucidity_level'), (10, 'more: unexpected'), (11, 'tone: missing'), (12, 'not a JSON object')) t(n, errors)"
)
def record_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Records in JSON with values of wrong kinds, missing and unexpected fields."""
    raw = [json.dumps(_RECORD | c) for c in _CHANGED] + [json.dumps({k: v for k, v in _RECORD.items() if k != "tone"}), "[1]"]
    return structured.parse(spark.createDataFrame(list(enumerate(raw)), "n int, raw string"), "raw").select("n", F.array_join("errors", "; ").alias("errors"))


def _planted(spark: SparkSession) -> DataFrame:
    """Two journals with an isolated run, a jump of several years, and what follows an isolated run."""
    days = [("p", "2021-01-05"), ("p", "2022-01-09"), ("p", "2021-01-12"), ("p", "2025-03-01"), ("p", "2025-03-02"), ("q", "2020-05-01"), ("q", "2019-05-03"), ("q", "2019-05-04"), ("q", "2020-05-06"), ("q", "2020-05-01")]
    rows = [(j, n, f"d{n}", "/".join(str(int(x)) for x in (s[5:7], s[8:], s[:4])), int(s[:4]), "day", s) for n, (j, s) in enumerate(days)]
    return spark.createDataFrame(rows, "journal_id string, entry_no long, dream_id string, date string, year int, date_precision string, date_sort string")


@query("SELECT * FROM (VALUES ('p', 2, 2022, 2021, 2, 2), ('q', 2, 2019, 2020, 2, 3)) t(journal_id, run, year, expected_year, first_block, last_block)")
def planted_isolated_runs(spark: SparkSession, d: str) -> DataFrame:
    return quality.isolated_runs(quality.date_blocks(_planted(spark)))


@query("SELECT * FROM (VALUES ('p', 4, 2021, 2025)) t(journal_id, block, previous_year, year)")
def planted_year_jumps(spark: SparkSession, d: str) -> DataFrame:
    return quality.year_jumps(quality.date_blocks(_planted(spark)))


_SHORT = "'short run of {} date(s) in {} is surrounded by dates in {}; changing the year to {} restores chronological order{}'"


@query(
    f"""SELECT * FROM (VALUES ('p', 2, '1/9/2022', '1/5/2021', '1/12/2021', {_SHORT.format(1, 2022, 2021, 2021, '; next date 1/12/2021 goes backward')}), ('p', 4, '3/1/2025', '1/12/2021', '3/2/2025', 'year changes by 4 after 1/12/2021'),
('q', 2, '5/3/2019', '5/1/2020', '5/4/2019', {_SHORT.format(2, 2019, 2020, 2020, '; date goes backward after 5/1/2020')}), ('q', 3, '5/4/2019', '5/3/2019', '5/6/2020', {_SHORT.format(2, 2019, 2020, 2020, '')}), ('q', 5, '5/1/2020', '5/6/2020', NULL, 'date duplicates the earlier block at 5/1/2020; date goes backward after 5/6/2020')) t(journal_id, block, date_text, previous_date, next_date, reasons)"""
)
def planted_findings(spark: SparkSession, d: str) -> DataFrame:
    return quality.findings(_planted(spark)).select("journal_id", "block", "date_text", "previous_date", "next_date", "reasons")


# --- plans around models, with answers by rule ----------------------------------------------------------------------


@query("SELECT * FROM (VALUES (1, 'Where was the sea?'), (2, 'sea'), (3, 'water at night')) t(place, query)")
def planned_queries(spark: SparkSession, d: str) -> DataFrame:
    made = questions.query_plan("  Where was   the sea? ", ["sea", "SEA", '"water  at night"', "where was the sea?", "too many"], 3)
    return spark.createDataFrame(list(enumerate(made, 1)), "place int, query string")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    _, q = _embeddings(spark, d)
    return q.select(F.col("vec_id").alias("query_id"), F.concat(F.lit("what stands beside number "), F.col("vec_id").cast("string")).alias("question"), "embedding")


@query(f"SELECT query_id, 'beside number ' || query_id AS answer, 'completed' AS status FROM (SELECT query_id FROM ({_knn_sql(_L2, 'ASC', 4, 'true')}) h JOIN documents t ON t.doc_id = h.vec_id GROUP BY query_id)")
def grounded_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers to questions from the nearest documents; the model repeats the end of its prompt, where the question stands."""
    e, _ = _embeddings(spark, d)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return questions.answer(e, docs, _asked(spark, d), providers.EchoChat(-3), key="vec_id", text_column="text", k=4).select("query_id", "answer", "status")


@query("SELECT question_id, replace(min(q), 'what stands ', '') AS answer, 'completed' AS status FROM (SELECT CAST(floor(vec_id / 200) AS BIGINT) AS question_id, 'what stands beside number ' || vec_id AS q FROM embeddings WHERE vec_id % 50 = 0) GROUP BY question_id")
def fused_answers(spark: SparkSession, d: str) -> DataFrame:
    """Four queries make one question; their hits are fused and answered from."""
    e, _ = _embeddings(spark, d)
    asked = _asked(spark, d).withColumn("question_id", F.floor(F.col("query_id") / 200))
    docs = e.select("vec_id", F.lit("text").alias("text"))
    return questions.multi_query_answer(e, docs, asked, providers.EchoChat(-3), key="vec_id", text_column="text").select("question_id", "answer", "status")


def _count_related(prompt: str) -> str:
    """The number of related entries in a prompt; nothing for none."""
    n = len(re.findall(r"(?m)^\[\d+\] ", prompt.partition("<related>")[2]))
    return str(n) if n else ""


@query(f"SELECT q.vec_id AS query_id, CASE WHEN coalesce(n, 0) = 0 THEN '{providers.NO_ANSWER}' ELSE CAST(n AS VARCHAR) END AS answer FROM embeddings q LEFT JOIN (SELECT query_id, count(*) AS n FROM ({_knn_sql(_COS, 'DESC', 5)}) WHERE score >= 0.25 GROUP BY 1) h ON h.query_id = q.vec_id WHERE q.vec_id % 50 = 0")
def analyses(spark: SparkSession, d: str) -> DataFrame:
    """Analyses of entries with related ones above a threshold; the model counts those in its prompt."""
    e, q = _embeddings(spark, d)
    docs = e.select("vec_id", F.lit("text").alias("text"))
    return extraction.analyze(q, e, docs, providers.RuleChat(_count_related), key="vec_id", text_column="text", threshold=0.25).select("query_id", "answer")


def _judge_all(prompt: str) -> str:
    """A judgement of each entry in a prompt by its number, if the focus is named; one entry in eleven is forgotten."""
    ids = re.findall(r"(?m)^\[\d+\] (\d+)$", prompt)
    return json.dumps([{"dream_id": i, "relevance": int(i) % 5 + 1, "generic_overlap": 1, "reason": "r"} for i in ids if int(i) % 11 and "FOCUS" in prompt])


@query(f"SELECT query_id, CAST(vec_id AS VARCHAR) AS vec_id, CAST(vec_id % 5 + 1 AS INT) AS relevance, '' AS problem FROM ({_knn_sql(_L2, 'ASC', 4)}) WHERE vec_id % 11 <> 0 UNION ALL SELECT query_id, CAST(vec_id AS VARCHAR), 0, 'missing' FROM ({_knn_sql(_L2, 'ASC', 4)}) WHERE vec_id % 11 = 0")
def judgements(spark: SparkSession, d: str) -> DataFrame:
    """Judgements of hits against a focus, and what is missing."""
    e, q = _embeddings(spark, d)
    hits = retrieval.knn(e, q, 4)
    ctx = retrieval.rank_context(hits, e.select("vec_id", F.lit("text").alias("text")), query="query_id", key="vec_id", text="text").withColumn("focus", F.lit("a door in the sea"))
    rows, problems = extraction.judge(hits, ctx, providers.RuleChat(_judge_all), query="query_id", key="vec_id")
    return rows.select("query_id", "vec_id", "relevance", F.lit("").alias("problem")).unionByName(problems.select("query_id", "vec_id", F.lit(0).alias("relevance"), "problem"))


def _record_of(prompt: str) -> str:
    """A valid record for texts of even length, one of a wrong kind for others, an error for very short ones."""
    body = prompt.partition("<entry>\n")[2].rpartition("\n</entry>")[0]
    if len(body) < 80:
        raise RuntimeError("too short")
    return json.dumps(_RECORD if len(body) % 2 == 0 else _RECORD | {"tone": 5})


_TODO = "SELECT journal_id, dream_id, coalesce(length(text), 0) AS n FROM dreams a WHERE NOT EXISTS (SELECT 1 FROM dream_features f WHERE f.journal_id = a.journal_id AND f.dream_id = a.dream_id AND f.schema_version = 4)"


@query(f"SELECT journal_id, dream_id, count(*) AS entries, count(*) FILTER (WHERE n >= 80 AND n % 2 = 0) AS completed, count(*) FILTER (WHERE n < 80) AS broken, count(*) FILTER (WHERE n >= 80 AND n % 2 = 1) AS invalid FROM ({_TODO}) GROUP BY 1, 2")
def extractions(spark: SparkSession, d: str) -> DataFrame:
    """Records made for entries that have none: good ones, invalid ones, and failures that stay in their row."""
    rows = extraction.extract(table(spark, d, "dreams"), table(spark, d, "dream_features"), providers.RuleChat(_record_of), ["journal_id", "dream_id"])
    counts = {"completed": F.col("status") == "completed", "broken": F.col("error_type") == "RuntimeError", "invalid": F.col("error") == "tone: not a text"}
    return rows.groupBy("journal_id", "dream_id").agg(F.count("*").alias("entries"), *[F.count_if(c).alias(n) for n, c in counts.items()])


@query("SELECT vec_id, vec_id % 3 <> 0 AS is_stored, 64 AS dims FROM embeddings")
def stored_or_embedded(spark: SparkSession, d: str) -> DataFrame:
    """The stored vector of an entry, else one made of its text."""
    e = table(spark, d, "embeddings")
    docs = e.select("vec_id", F.concat(F.lit("entry "), F.col("vec_id").cast("string")).alias("text"), F.col("embedding").alias("known"))
    got = retrieval.embedding_for(docs, e.filter(F.col("vec_id") % 3 != 0).select("vec_id", "embedding"), lambda t: providers.hashed_embedding(t, 64), key="vec_id", text="text")
    return got.select("vec_id", (F.col("embedding") == F.col("known")).alias("is_stored"), F.size("embedding").alias("dims"))


@query("SELECT collection_name, embedding_model FROM vector_collections WHERE collection_name = 'dreams'")
def guarded_model(spark: SparkSession, d: str) -> DataFrame:
    """A collection, after a check of the model that made it."""
    c = table(spark, d, "vector_collections")
    retrieval.check_model(c, "dreams", c.filter("collection_name = 'dreams'").first()["embedding_model"])
    return c.filter("collection_name = 'dreams'").select("collection_name", "embedding_model")


@query("SELECT * FROM (VALUES (0, 'home, water, boat'), (1, 'sea')) t(label, cluster_label)")
def labelled_clusters(spark: SparkSession, d: str) -> DataFrame:
    tags = spark.createDataFrame([(0, 1, "home"), (0, 2, "water"), (0, 3, "left out")], "label int, rank int, tag string")
    words = spark.createDataFrame([(0, 1, "water"), (0, 2, "boat"), (1, 1, "sea")], "label int, rank int, term string")
    return extraction.cluster_labels(tags, words, "label")
