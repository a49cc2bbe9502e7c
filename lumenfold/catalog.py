"""Queries over the given tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import dates, text
from lumenfold.operators import clusters, entities, evaluation, quality, retrieval, stats, structured
from lumenfold.runtime import table
from lumenfold.sources import tables
from lumenfold.streaming import incremental

#: Parameters of the queries below, the same in their SQL.
START, END = "2018-01-01", "2020-12-31"
TAGS = ["home", "water", "recurring", "vivid"]
ASKED = ["home", "water", "no-such-tag", "zeppelin-race"]
STOP = "the and was were for that this with from into then they them her his she had not but all one out our you are who why how its where which when what there some two".split()

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _iso(c: str) -> str:
    return rf"(CASE WHEN regexp_matches({c}, '^\d{{4}}-\d{{2}}-\d{{2}}$') THEN try_cast({c} AS DATE) END)"


_DATED = f"(SELECT *, {_iso('date_sort')} AS d FROM dreams)"


_SQUASH = r"trim(regexp_replace(text, '[\s\x{{A0}}\x{{2028}}\x{{85}}]+', ' ', 'g'))".replace("{{", "{").replace("}}", "}")


# --- statistics --------------------------------------------------------------------------------------------------

for _f, _name, _trunc, _label in (("M", "month", "month", "month(s) || '-' || year(s)"), ("Q", "quarter", "quarter", "'Q' || quarter(s) || '-' || year(s)"), ("Y", "year", "year", "CAST(year(s) AS VARCHAR)")):
    _QUERIES[f"entries_per_{_name}"] = lambda spark, d, f=_f: stats.entries_per_period(table(spark, d, "dreams"), f)
    _SQL[f"entries_per_{_name}"] = f"SELECT CAST(s AS VARCHAR) AS period, {_label} AS label, entries FROM (SELECT CAST(date_trunc('{_trunc}', d) AS DATE) AS s, count(*) AS entries FROM {_DATED} WHERE d IS NOT NULL GROUP BY 1)"


@query(f"SELECT count(*) AS entries, CAST(min(d) AS VARCHAR) AS first_date, CAST(max(d) AS VARCHAR) AS last_date FROM {_DATED} WHERE d BETWEEN DATE '{START}' AND DATE '{END}'")
def date_range_summary(spark: SparkSession, d: str) -> DataFrame:
    return stats.summary(stats.dated(table(spark, d, "dreams"), START, END))


@query(f"SELECT count(*) FILTER (WHERE d IS NULL) AS excluded, count(*) AS entries FROM {_DATED}")
def excluded_undated(spark: SparkSession, d: str) -> DataFrame:
    return stats.undated(table(spark, d, "dreams"))


@query("SELECT tag, count(*) AS entries, round(100.0 * count(*) / (SELECT count(*) FROM dreams), 2) AS percent FROM (SELECT entry_no, unnest(list_distinct(tags)) AS tag FROM dreams) WHERE tag IS NOT NULL GROUP BY tag")
def tag_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.tag_stats(table(spark, d, "dreams"))


@query("SELECT tag, count(*) AS uses FROM (SELECT unnest(tags) AS tag FROM dreams) WHERE tag IS NOT NULL GROUP BY tag ORDER BY uses DESC, tag LIMIT 10")
def top_tags(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_tags(table(spark, d, "dreams"), 10)


_GRID = f"SELECT CAST(date_trunc('quarter', d) AS DATE) AS s, t.tag, count(*) FILTER (WHERE list_contains(tags, t.tag)) AS n, count(*) AS a FROM {_DATED}, (VALUES {', '.join(f"('{t}')" for t in TAGS)}) t(tag) WHERE d IS NOT NULL GROUP BY 1, 2"


@query(f"SELECT CAST(s AS VARCHAR) AS period, 'Q' || quarter(s) || '-' || year(s) AS label, tag, n AS value FROM ({_GRID})")
def tag_counts_over_time(spark: SparkSession, d: str) -> DataFrame:
    return stats.tag_counts_over_time(table(spark, d, "dreams"), TAGS, "Q")


@query(f"SELECT CAST(s AS VARCHAR) AS period, 'Q' || quarter(s) || '-' || year(s) AS label, tag, round(100.0 * n / a, 4) AS value FROM ({_GRID})")
def tag_shares_over_time(spark: SparkSession, d: str) -> DataFrame:
    return stats.tag_counts_over_time(table(spark, d, "dreams"), TAGS, "Q", normalize=True)


@query(f"SELECT CAST(CAST(date_trunc('year', d) AS DATE) AS VARCHAR) AS period, count(*) AS entries, {', '.join(f"count(*) FILTER (WHERE list_contains(tags, '{t}')) AS tag_{t}" for t in TAGS)} FROM {_DATED} WHERE d IS NOT NULL GROUP BY 1")
def tag_pivot(spark: SparkSession, d: str) -> DataFrame:
    return stats.tag_pivot(table(spark, d, "dreams"), TAGS, "Y")


@query(f"SELECT tag FROM (VALUES {', '.join(f"('{t}')" for t in ASKED)}) t(tag) WHERE tag NOT IN (SELECT unnest(tags) FROM dreams WHERE tags IS NOT NULL)")
def missing_tags(spark: SparkSession, d: str) -> DataFrame:
    return stats.missing_tags(table(spark, d, "dreams"), ASKED)


@query(f"SELECT journal_id, count(*) AS entries FROM dreams WHERE list_has_any(tags, [{', '.join(f"'{t}'" for t in TAGS[:2])}]) GROUP BY 1")
def tagged_entries(spark: SparkSession, d: str) -> DataFrame:
    return stats.with_any_tag(table(spark, d, "dreams"), TAGS[:2]).groupBy("journal_id").agg(F.count("*").alias("entries"))


@query(r"SELECT entry_no, len(regexp_extract_all(text, '[\p{L}\p{N}_''\p{M}]+')) AS words FROM dreams")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dreams").select("entry_no", text.word_count(F.col("text")).alias("words"))


@query("SELECT count(*) AS entries, round(avg(word_count), 2) AS mean_words, round(median(word_count), 2) AS median_words FROM dreams")
def length_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.length_stats(table(spark, d, "dreams"))


@query("(SELECT 'longest' AS kind, entry_no, date, word_count FROM dreams WHERE word_count IS NOT NULL ORDER BY word_count DESC, entry_no LIMIT 1) UNION ALL (SELECT 'shortest', entry_no, date, word_count FROM dreams WHERE word_count IS NOT NULL ORDER BY word_count, entry_no LIMIT 1)")
def longest_and_shortest(spark: SparkSession, d: str) -> DataFrame:
    return stats.longest_and_shortest(table(spark, d, "dreams"), "entry_no")


_WORDS = f"SELECT entry_no, p, w FROM (SELECT entry_no, unnest(l) AS w, generate_subscripts(l, 1) AS p FROM (SELECT entry_no, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z'']+'), lambda x: trim(lower(x), '''')), lambda x: x <> '') AS l FROM dreams)) WHERE length(w) >= 3 AND w NOT IN ({', '.join(f"'{w}'" for w in STOP)})"


@query(f"SELECT w AS word, count(*) AS uses, round(100.0 * count(*) / (SELECT count(*) FROM ({_WORDS})), 2) AS percent FROM ({_WORDS}) GROUP BY w ORDER BY uses DESC, min(entry_no * 1000000 + p) LIMIT 20")
def common_words(spark: SparkSession, d: str) -> DataFrame:
    return stats.common_words(table(spark, d, "dreams"), "entry_no", STOP)


# --- checks ------------------------------------------------------------------------------------------------------

_PART = r"try_cast(regexp_extract(date, '^\s*(\d{{1,4}})/(\d{{1,2}})/(\d{{1,4}})\s*$', {}) AS INT) = 0"
_HOLD = f"(coalesce(date_precision IN ('month', 'year', 'unknown'), false) OR coalesce({' OR '.join(_PART.format(i) for i in (1, 2, 3))}, false))"


@query(f"SELECT * FROM (SELECT journal_id, trim(dream_id) AS dream_id, entry_no, date, count(*) OVER w AS times, min(entry_no) OVER w AS first_row, bool_or({_HOLD}) OVER w AS has_placeholder FROM dreams WHERE trim(dream_id) <> '' WINDOW w AS (PARTITION BY journal_id, trim(dream_id))) WHERE times > 1")
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicate_ids(table(spark, d, "dreams"))


@query("SELECT doc_id, min(doc_id) OVER w AS first_id, count(*) OVER w AS copies FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY text)")
def duplicate_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the first one of the same text and their number."""
    rows = table(spark, d, "documents").filter(F.col("text").isNotNull()).select("doc_id", F.sha2("text", 256).alias("digest"))
    classes = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    return rows.join(classes, "digest").select("doc_id", "first_id", "copies")


@query("SELECT sha256(text) AS digest, count(*) AS documents, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_text_sizes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").filter(F.col("text").isNotNull())
    return rows.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_id")).filter(F.col("documents") > 1)


_BLOCKS = f"""
k AS (SELECT journal_id, entry_no, date AS date_text, year, coalesce({_iso('date_sort')}, {_iso('date')}) AS sort_date FROM dreams WHERE NOT {_HOLD} AND year IS NOT NULL AND date IS NOT NULL),
f AS (SELECT *, CASE WHEN lag(date_text) OVER w IS NOT DISTINCT FROM date_text AND lag(year) OVER w IS NOT DISTINCT FROM year AND lag(sort_date) OVER w IS NOT DISTINCT FROM sort_date THEN 0 ELSE 1 END AS n FROM k WINDOW w AS (PARTITION BY journal_id ORDER BY entry_no)),
g AS (SELECT *, sum(n) OVER (PARTITION BY journal_id ORDER BY entry_no) AS block FROM f),
b AS (SELECT journal_id, CAST(block AS BIGINT) AS block, any_value(date_text) AS date_text, any_value(year) AS year, any_value(sort_date) AS sort_date, min(entry_no) AS first_row, max(entry_no) AS last_row, count(*) AS entries FROM g GROUP BY journal_id, block)"""
_RUNS = """,
rf AS (SELECT *, CASE WHEN lag(year) OVER (PARTITION BY journal_id ORDER BY block) IS NOT DISTINCT FROM year THEN 0 ELSE 1 END AS n2 FROM b),
rg AS (SELECT *, CAST(sum(n2) OVER (PARTITION BY journal_id ORDER BY block) AS BIGINT) AS run FROM rf)"""
_ISO = (
    _RUNS
    + """,
r AS (SELECT journal_id, run, any_value(year) AS year, min(block) AS first_block, max(block) AS last_block, arg_min(sort_date, block) AS fd, arg_max(sort_date, block) AS ld, count(*) AS blocks, count(sort_date) AS dated FROM rg GROUP BY 1, 2),
rn AS (SELECT *, lag(year) OVER w AS py, lag(CASE WHEN true THEN last_block END) OVER w AS pb, lead(year) OVER w AS ny, lead(first_block) OVER w AS nb FROM r WINDOW w AS (PARTITION BY journal_id ORDER BY run)),
c AS (SELECT rn.*, p.sort_date AS pd, x.sort_date AS nd FROM rn JOIN b p ON p.journal_id = rn.journal_id AND p.block = rn.pb JOIN b x ON x.journal_id = rn.journal_id AND x.block = rn.nb WHERE rn.blocks <= 3 AND rn.py = rn.ny AND rn.py <> rn.year AND rn.dated = rn.blocks AND p.sort_date IS NOT NULL AND x.sort_date IS NOT NULL),
m AS (SELECT c.journal_id, c.run, c.year, c.py, c.pd, c.nd, c.first_block, c.last_block, rg.block, try_cast(lpad(CAST(c.py AS VARCHAR), 4, '0') || strftime(rg.sort_date, '-%m-%d') AS DATE) AS moved FROM c JOIN rg ON rg.journal_id = c.journal_id AND rg.run = c.run),
mo AS (SELECT *, lag(moved) OVER (PARTITION BY journal_id, run ORDER BY block) AS pm FROM m),
iso AS (SELECT journal_id, run, year, py AS expected_year, first_block, last_block FROM mo GROUP BY ALL HAVING bool_and(moved IS NOT NULL) AND bool_and(pm IS NULL OR pm <= moved) AND min(moved) >= any_value(pd) AND max(moved) <= any_value(nd))"""
)


@query(f"WITH {_BLOCKS} SELECT journal_id, block, date_text, year, CAST(sort_date AS VARCHAR) AS sort_date, first_row, last_row, entries FROM b")
def date_blocks(spark: SparkSession, d: str) -> DataFrame:
    return quality.date_blocks(table(spark, d, "dreams")).withColumn("sort_date", F.col("sort_date").cast("string"))


@query(f"WITH {_BLOCKS}{_RUNS} SELECT journal_id, run, any_value(year) AS year, min(block) AS first_block, max(block) AS last_block, count(*) AS blocks FROM rg GROUP BY 1, 2")
def year_runs(spark: SparkSession, d: str) -> DataFrame:
    return quality.year_runs(quality.date_blocks(table(spark, d, "dreams")))


_REP = "SELECT journal_id, block, date_text, eb AS earlier_block, ed AS earlier_date FROM (SELECT *, first_value(block) OVER w AS eb, first_value(date_text) OVER w AS ed FROM b WINDOW w AS (PARTITION BY journal_id, coalesce(CAST(sort_date AS VARCHAR), concat_ws('|', date_text, CAST(year AS VARCHAR))) ORDER BY block)) WHERE block > eb"
_BACK = "SELECT journal_id, block, date_text, pt AS previous_date, nt AS next_date FROM (SELECT *, lag(date_text) OVER w AS pt, lead(date_text) OVER w AS nt, lag(sort_date) OVER w AS ps FROM b WINDOW w AS (PARTITION BY journal_id ORDER BY block)) WHERE sort_date < ps"
_JUMP = "SELECT journal_id, block, py AS previous_year, year FROM (SELECT *, lag(year) OVER (PARTITION BY journal_id ORDER BY block) AS py FROM b) WHERE abs(year - py) > 1"


@query(f"WITH {_BLOCKS} {_REP}")
def repeated_dates(spark: SparkSession, d: str) -> DataFrame:
    return quality.repeated_dates(quality.date_blocks(table(spark, d, "dreams")))


@query(f"WITH {_BLOCKS} {_BACK}")
def backward_dates(spark: SparkSession, d: str) -> DataFrame:
    return quality.backward_dates(quality.date_blocks(table(spark, d, "dreams")))


@query(f"WITH {_BLOCKS} {_JUMP}")
def year_jumps(spark: SparkSession, d: str) -> DataFrame:
    return quality.year_jumps(quality.date_blocks(table(spark, d, "dreams")))


@query(f"WITH {_BLOCKS}{_ISO} SELECT * FROM iso")
def isolated_runs(spark: SparkSession, d: str) -> DataFrame:
    return quality.isolated_runs(quality.date_blocks(table(spark, d, "dreams")))


@query(
    f"""WITH {_BLOCKS}{_ISO},
ib AS (SELECT journal_id, unnest(range(first_block, last_block + 1)) AS block, year, expected_year, last_block - first_block + 1 AS n FROM iso),
nb AS (SELECT *, lag(date_text) OVER w AS pt, lead(date_text) OVER w AS nt FROM b WINDOW w AS (PARTITION BY journal_id ORDER BY block)),
p AS (SELECT journal_id, block, 3 AS kind, 'date goes backward after ' || previous_date AS reason, 'next date ' || date_text || ' goes backward' AS charged FROM ({_BACK}) UNION ALL SELECT j.journal_id, j.block, 4, 'year changes by ' || abs(j.year - j.previous_year) || ' after ' || nb.pt, 'year changes by ' || abs(j.year - j.previous_year) || ' after ' || nb.pt FROM ({_JUMP}) j JOIN nb ON nb.journal_id = j.journal_id AND nb.block = j.block),
ps AS (SELECT p.journal_id, CASE WHEN ib.block IS NULL THEN p.block ELSE p.block - 1 END AS block, CASE WHEN ib.block IS NULL THEN kind ELSE kind + 2 END AS rank, CASE WHEN ib.block IS NULL THEN reason ELSE charged END AS reason FROM p LEFT JOIN ib ON ib.journal_id = p.journal_id AND ib.block + 1 = p.block),
a AS (SELECT journal_id, block, 1 AS rank, 'date duplicates the earlier block at ' || earlier_date AS reason FROM ({_REP}) UNION ALL SELECT journal_id, block, 2, 'short run of ' || n || ' date(s) in ' || year || ' is surrounded by dates in ' || expected_year || '; changing the year to ' || expected_year || ' restores chronological order' FROM ib UNION ALL SELECT * FROM ps)
SELECT a.journal_id, a.block, string_agg(reason, '; ' ORDER BY rank, reason) AS reasons, any_value(nb.date_text) AS date_text, any_value(nb.year) AS year, any_value(nb.pt) AS previous_date, any_value(nb.nt) AS next_date, any_value(nb.first_row) AS first_row FROM a JOIN nb ON nb.journal_id = a.journal_id AND nb.block = a.block GROUP BY 1, 2"""
)
def date_findings(spark: SparkSession, d: str) -> DataFrame:
    return quality.findings(table(spark, d, "dreams"))


@query(f"SELECT entry_no, {_HOLD} AS is_placeholder, CAST({_iso('date_sort')} AS VARCHAR) AS valid_date FROM dreams")
def placeholder_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dreams").select("entry_no", dates.placeholder(F.col("date"), F.col("date_precision")).alias("is_placeholder"), dates.iso_date(F.col("date_sort")).cast("string").alias("valid_date"))


# --- retrieval ---------------------------------------------------------------------------------------------------

_DOT = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
_COS = f"round({_DOT.format(a='q.embedding', b='c.embedding')} / (sqrt({_DOT.format(a='q.embedding', b='q.embedding')}) * sqrt({_DOT.format(a='c.embedding', b='c.embedding')})), 9)"
_L2 = "round(list_sum(list_transform(list_zip(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 9)"


def _knn_sql(score: str, order: str, k: int, where: str = "q.vec_id <> c.vec_id") -> str:
    return f"SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, {score} AS score FROM embeddings q JOIN embeddings c ON {where} WHERE q.vec_id % 50 = 0)) WHERE rank <= {k}"


def _embeddings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    return e, e.filter(F.col("vec_id") % 50 == 0)


@query(f"SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM ({_knn_sql(_L2, 'ASC', 10)})")
def knn_l2(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.knn(*_embeddings(spark, d), 10).withColumn("score", F.round("score", 6))


@query(f"SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM ({_knn_sql(_COS, 'DESC', 10)})")
def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.knn(*_embeddings(spark, d), 10, measure="cosine").withColumn("score", F.round("score", 6))


@query(f"SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM ({_knn_sql(_COS, 'DESC', 1_000_000_000)}) WHERE score >= 0.2")
def related_threshold(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.related(*_embeddings(spark, d), 0.2).withColumn("score", F.round("score", 6))


def _fused(spark: SparkSession, d: str) -> DataFrame:
    """Four queries make one question: keys 0, 50, 100, 150 the first, and so on."""
    hits = retrieval.knn(*_embeddings(spark, d), 6, drop_self=False)
    return retrieval.fuse(hits.withColumn("question_id", F.floor(F.col("query_id") / 200)), by="question_id", query="query_id", key="vec_id", most=12)


_RRF = f"SELECT CAST(floor(query_id / 200) AS BIGINT) AS question_id, vec_id, sum(1.0::DOUBLE / (60 + rank)) AS s, min(score) AS best, string_agg(query_id || ':' || rank, ',' ORDER BY query_id) AS matched FROM ({_knn_sql(_L2, 'ASC', 6, 'true')}) GROUP BY 1, 2"


@query(f"SELECT question_id, vec_id, round(s, 8) AS fused, round(best, 6) AS best, matched, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(s, 12) DESC, best, vec_id) AS place FROM ({_RRF})) WHERE place <= 12")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d)


_HALF = _L2.replace("q.embedding", "q.embedding[1:32]").replace("c.embedding", "c.embedding[1:32]")


def _two_indexes(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    e, q = _embeddings(spark, d)
    half = F.slice("embedding", 1, 32)
    return {"full": retrieval.knn(e, q, 8), "half": retrieval.knn(e.withColumn("embedding", half), q.withColumn("embedding", half), 8)}


@query(f"SELECT query_id, vec_id, digest, CAST(row_number() OVER (PARTITION BY query_id ORDER BY digest) AS INT) AS place FROM (SELECT *, sha256(CAST(query_id AS VARCHAR) || chr(0) || CAST(vec_id AS VARCHAR)) AS digest FROM (SELECT query_id, vec_id FROM ({_knn_sql(_L2, 'ASC', 8)}) UNION SELECT query_id, vec_id FROM ({_knn_sql(_HALF, 'ASC', 8)})))")
def pooled_candidates(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.pooled(list(_two_indexes(spark, d).values()), query="query_id", key="vec_id")


@query(f"SELECT model, index_name, query_id, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY rank) AS hits FROM (SELECT 'full' AS index_name, * FROM ({_knn_sql(_L2, 'ASC', 8)}) UNION ALL SELECT 'half', * FROM ({_knn_sql(_HALF, 'ASC', 8)})), (VALUES ('chat-a'), ('chat-b')) m(model) GROUP BY 1, 2, 3")
def model_matrix(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.matrix(_two_indexes(spark, d), ["chat-a", "chat-b"], query="query_id", key="vec_id")


@query(f"SELECT query_id, string_agg('[' || rank || '] ' || CAST(h.vec_id AS VARCHAR) || chr(10) || CASE WHEN length(t.text) > 200 THEN substr(t.text, 1, 200) || chr(10) || '[TRUNCATED]' ELSE coalesce(t.text, '') END, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM ({_knn_sql(_L2, 'ASC', 4)}) h JOIN documents t ON t.doc_id = h.vec_id GROUP BY query_id")
def rank_context(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieval.knn(*_embeddings(spark, d), 4)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return retrieval.rank_context(hits, docs, query="query_id", key="vec_id", text="text", most_chars=200)


# --- evaluation --------------------------------------------------------------------------------------------------
# A hit is judged 5 if it bears the label of its query, 4 if a neighbouring one, else by its own label.

_GRADE = "CASE WHEN q.label = c.label THEN 5 WHEN abs(q.label - c.label) = 1 THEN 4 ELSE 1 + c.label % 3 END"
_JUDGED = f"SELECT h.query_id, h.vec_id, {_GRADE} AS relevance FROM ({_knn_sql(_L2, 'ASC', 8)}) h JOIN embeddings q ON q.vec_id = h.query_id JOIN embeddings c ON c.vec_id = h.vec_id"


def _judged(spark: SparkSession, d: str) -> DataFrame:
    e, q = _embeddings(spark, d)
    label = e.select("vec_id", F.col("label").alias("c"))
    hits = retrieval.knn(e, q, 8).join(label, "vec_id").join(q.select(F.col("vec_id").alias("query_id"), F.col("label").alias("q")), "query_id")
    grade = F.when(F.col("q") == F.col("c"), 5).when(F.abs(F.col("q") - F.col("c")) == 1, 4).otherwise(1 + F.col("c") % 3)
    return hits.select("query_id", "vec_id", grade.alias("relevance"))


@query(f"SELECT query_id, round(avg(relevance), 3) AS mean_relevance, CAST(median(relevance) AS DOUBLE) AS median_relevance, count(*) FILTER (WHERE relevance >= 4) AS relevant, count(relevance) AS judged, round(count(*) FILTER (WHERE relevance >= 4) / count(relevance), 3) AS precision_at_k FROM ({_JUDGED}) GROUP BY query_id")
def precision_at_k(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.summarize(_judged(spark, d), "query_id")


_A, _B = _knn_sql(_L2, "ASC", 8), _knn_sql(_HALF, "ASC", 8)


@query(f"SELECT query_id, vec_id, 'missing' AS problem FROM ({_A}) a WHERE NOT EXISTS (SELECT 1 FROM ({_B}) b WHERE b.query_id = a.query_id AND b.vec_id = a.vec_id) UNION ALL SELECT query_id, vec_id, 'unexpected' FROM ({_B}) a WHERE NOT EXISTS (SELECT 1 FROM ({_A}) b WHERE b.query_id = a.query_id AND b.vec_id = a.vec_id)")
def judgement_mismatch(spark: SparkSession, d: str) -> DataFrame:
    two = _two_indexes(spark, d)
    return evaluation.mismatch(two["full"], two["half"], ["query_id", "vec_id"])


# --- clusters ----------------------------------------------------------------------------------------------------

_UNIT = "SELECT vec_id, label, i, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)"
_CENTRE = f"SELECT label, i, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS m FROM (SELECT label, i, avg(x) AS m FROM ({_UNIT}) GROUP BY 1, 2)"


@query(f"SELECT label, CAST(rank AS INT) AS rank, vec_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS rank FROM (SELECT u.vec_id, u.label, round(sum(u.x * c.m), 9) AS s FROM ({_UNIT}) u JOIN ({_CENTRE}) c ON c.label = u.label AND c.i = u.i GROUP BY 1, 2)) WHERE rank <= 3")
def cluster_representatives(spark: SparkSession, d: str) -> DataFrame:
    return clusters.representatives(table(spark, d, "embeddings"), 3)


_TAGGED = "SELECT e.label, unnest(list_distinct(list_filter([t.lang, t.source, t.doc_kind], lambda x: x IS NOT NULL))) AS tag FROM embeddings e JOIN documents t ON t.doc_id = e.vec_id"


@query(f"SELECT label, tag, n, round(lift, 6) AS lift, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(lift, 6) DESC, n DESC, tag) AS rank FROM (SELECT a.label, a.tag, a.n, a.n / s.c / (g.n / (SELECT count(*)::DOUBLE FROM embeddings e JOIN documents t ON t.doc_id = e.vec_id)) AS lift FROM (SELECT label, tag, count(*) AS n FROM ({_TAGGED}) GROUP BY 1, 2) a JOIN (SELECT label, count(*) AS c FROM embeddings e JOIN documents t ON t.doc_id = e.vec_id GROUP BY 1) s ON s.label = a.label JOIN (SELECT tag, count(*) AS n FROM ({_TAGGED}) GROUP BY 1) g ON g.tag = a.tag)) WHERE rank <= 5")
def cluster_tag_lift(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.array_compact(F.array("lang", "source", "doc_kind")).alias("tags"))
    return clusters.tag_lift(table(spark, d, "embeddings").select("vec_id", "label").join(docs, "vec_id"))


_N = "SELECT vec_id, CASE WHEN label = 9 THEN -1 ELSE label END AS label, i, x FROM"


@query(
    f"""WITH u AS ({_N} ({_UNIT})), g AS (SELECT * FROM u WHERE label <> -1), s AS (SELECT label, i, sum(x) AS s FROM g GROUP BY 1, 2), n AS (SELECT label, count(DISTINCT vec_id) AS n FROM g GROUP BY 1),
p AS (SELECT g.vec_id, g.label, s.label AS other, sum(g.x * s.s) AS p FROM g JOIN s ON s.i = g.i GROUP BY 1, 2, 3),
w AS (SELECT vec_id, max(CASE WHEN other = p.label AND n > 1 THEN 1 - (p - 1) / (n - 1) END) AS a, min(CASE WHEN other <> p.label THEN 1 - p / n END) AS b FROM p JOIN n ON n.label = p.other GROUP BY 1)
SELECT count(*) AS points, count(DISTINCT label) FILTER (WHERE label <> 9) AS clusters, round(count(*) FILTER (WHERE label = 9) / count(*), 6) AS noise_share, (SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) FROM w) AS silhouette FROM embeddings"""
)
def cluster_quality(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("label", F.when(F.col("label") == 9, clusters.NOISE).otherwise(F.col("label")))
    return clusters.quality(e)


_TERMS = f"""WITH w AS (SELECT feature_no, tone, list_filter(regexp_extract_all(lower(summary), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({', '.join(repr(w) for w in STOP)})) AS w FROM dream_features WHERE summary IS NOT NULL AND tone IS NOT NULL),
t AS (SELECT feature_no, tone, unnest(w || CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END) AS term FROM w),
n AS (SELECT count(*)::DOUBLE AS n FROM w), tf AS (SELECT feature_no, tone, term, count(*) AS tf FROM t GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.9 * (SELECT n FROM n)),
r AS (SELECT tf.*, tf * (ln((1 + (SELECT n FROM n)) / (1.0::DOUBLE + df)) + 1) AS x FROM tf JOIN df USING (term)),
v AS (SELECT tone, term, x / sqrt(sum(x * x) OVER (PARTITION BY feature_no)) AS v FROM r),
c AS (SELECT tone, term, sum(v) AS s FROM v GROUP BY ALL), g AS (SELECT term, sum(s) AS a FROM c GROUP BY term), z AS (SELECT tone, count(*) AS size FROM w GROUP BY tone),
y AS (SELECT c.tone, c.term, round(s / size - a / (SELECT n FROM n), 9) AS gain FROM c JOIN g USING (term) JOIN z USING (tone))
SELECT tone, term, CAST(rank AS INT) AS rank, round(gain, 6) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY tone ORDER BY gain DESC, term) AS rank FROM y WHERE gain > 0) WHERE rank <= 8"""


@query(_TERMS)
def cluster_terms(spark: SparkSession, d: str) -> DataFrame:
    """Telling terms of each tone, from summaries."""
    f = table(spark, d, "dream_features").filter(F.col("summary").isNotNull() & F.col("tone").isNotNull())
    return clusters.distinctive_terms(clusters.term_weights(f, "feature_no", "summary", stop_words=STOP), f, key="feature_no", label="tone")


@query("SELECT doc_id, replace(replace(replace(replace(replace(substr(" + _SQUASH + ", 1, 300), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;') AS excerpt FROM documents")
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.excerpt(F.col("text")).alias("excerpt"))


@query()
def clustered_map(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in clustering with two map coordinates."""
    return clusters.cluster(table(spark, d, "embeddings"))


# --- records and entities ----------------------------------------------------------------------------------------

_NAMES = f"SELECT journal_id, feature_no, dream_id, {_iso('date_sort')} AS day, unnest(named_characters) AS raw, generate_subscripts(named_characters, 1) AS pos FROM dream_features"
_CLEAN = r"trim(regexp_replace(raw, '\s+', ' ', 'g'))"
_MENTION = f"SELECT journal_id, feature_no, dream_id, day, replace(lower({_CLEAN}), 'ß', 'ss') AS identity, arg_min({_CLEAN}, pos) AS name FROM ({_NAMES}) WHERE raw IS NOT NULL AND trim(raw) <> '' GROUP BY 1, 2, 3, 4, 5"
_PERSON = f"SELECT journal_id, identity, arg_min(name, feature_no) AS name, count(*) AS records, CAST(min(day) AS VARCHAR) AS first_date, CAST(max(day) AS VARCHAR) AS last_date, arg_min(dream_id, feature_no) AS first_record, arg_max(dream_id, feature_no) AS last_record FROM ({_MENTION}) GROUP BY 1, 2"


@query(_PERSON)
def entity_rollup(spark: SparkSession, d: str) -> DataFrame:
    return entities.roll_up(table(spark, d, "dream_features"))


@query(
    rf"""WITH p AS ({_PERSON}), s AS (SELECT *, coalesce(nullif(trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'character') AS slug FROM p)
SELECT journal_id, identity, name, records, first_date, last_date, first_record, last_record, CASE WHEN row_number() OVER (PARTITION BY journal_id, slug ORDER BY identity) = 1 THEN slug ELSE slug || '_' || substr(sha256(name), 1, 8) END AS character_id FROM s"""
)
def entity_ids(spark: SparkSession, d: str) -> DataFrame:
    return entities.with_ids(entities.roll_up(table(spark, d, "dream_features")))


@query(f"SELECT journal_id, feature_no, dream_id, CAST(day AS VARCHAR) AS day, identity, name, CAST(row_number() OVER (PARTITION BY journal_id, identity ORDER BY day ASC NULLS LAST, feature_no) AS BIGINT) AS nth FROM ({_MENTION})")
def entity_history(spark: SparkSession, d: str) -> DataFrame:
    return entities.history(table(spark, d, "dream_features")).withColumn("day", F.col("day").cast("string"))


@query("SELECT entry_no, journal_id, dream_id FROM dreams a WHERE NOT EXISTS (SELECT 1 FROM dream_features f WHERE f.journal_id = a.journal_id AND f.dream_id = a.dream_id AND f.schema_version = 4)")
def pending_entries(spark: SparkSession, d: str) -> DataFrame:
    return structured.pending(table(spark, d, "dreams"), table(spark, d, "dream_features"), ["journal_id", "dream_id"]).select("entry_no", "journal_id", "dream_id")


@query("SELECT journal_id, dream_id, feature_no, schema_version, tone FROM (SELECT *, row_number() OVER (PARTITION BY journal_id, dream_id ORDER BY (schema_version = 4)::INT DESC, feature_no DESC) AS r FROM dream_features WHERE schema_version IN (3, 4)) WHERE r = 1")
def upserted_records(spark: SparkSession, d: str) -> DataFrame:
    """Older records with those of the current version in their place."""
    f = table(spark, d, "dream_features").select("journal_id", "dream_id", "feature_no", "schema_version", "tone")
    old = structured.latest(f.filter("schema_version = 3"), ["journal_id", "dream_id"], "feature_no")
    return structured.upsert(old, f.filter("schema_version = 4"), ["journal_id", "dream_id"], "feature_no")


def _lists_sql(f: str, fold: bool) -> str:
    clean = rf"list_filter(list_transform({f}, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x IS NOT NULL AND x <> '')"
    if fold:
        return f"(SELECT array_to_string(list(x ORDER BY p), '|') FROM (SELECT x, min(p) AS p FROM (SELECT unnest(l) AS x, generate_subscripts(l, 1) AS p FROM (SELECT list_transform({clean}, lambda x: lower(x)) AS l)) GROUP BY x))"
    return f"(SELECT array_to_string(list(n ORDER BY p), '|') FROM (SELECT arg_min(x, p) AS n, min(p) AS p FROM (SELECT unnest(l) AS x, generate_subscripts(l, 1) AS p FROM (SELECT {clean} AS l)) GROUP BY lower(x)))"


@query(f"SELECT feature_no, coalesce({_lists_sql('themes', True)}, '') AS themes, coalesce({_lists_sql('named_characters', False)}, '') AS named_characters FROM dream_features")
def normalized_lists(spark: SparkSession, d: str) -> DataFrame:
    n = structured.normalize_lists(table(spark, d, "dream_features"))
    return n.select("feature_no", F.array_join("themes", "|").alias("themes"), F.array_join("named_characters", "|").alias("named_characters"))


def _problem_sql() -> str:
    parts = []
    for f in structured.FIELDS:
        if f in structured.LISTS or f == "lucidity":
            parts.append(f"CASE WHEN {f} IS NULL THEN '{f}: missing' END")
        elif f in structured.ENUMS:
            parts.append(f"CASE WHEN {f} IS NULL THEN '{f}: missing' WHEN trim(regexp_replace({f}, '\\s+', ' ', 'g')) NOT IN ({', '.join(repr(v) for v in structured.ENUMS[f])}) THEN '{f}: not allowed' END")
        else:
            parts.append(f"CASE WHEN {f} IS NULL THEN '{f}: missing' WHEN trim({f}) = '' THEN '{f}: empty' END")
    parts.append("CASE WHEN lucidity <> (lucidity_level = 'lucid') THEN 'lucidity: contradicts lucidity_level' END")
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), '; ')"


@query(f"SELECT * FROM (SELECT feature_no, {_problem_sql()} AS problems FROM dream_features) WHERE problems <> ''")
def record_problems(spark: SparkSession, d: str) -> DataFrame:
    p = F.array_join(structured.problems(), "; ")
    return table(spark, d, "dream_features").select("feature_no", p.alias("problems")).filter(F.col("problems") != "")


@query("SELECT CASE WHEN schema_version = 4 THEN 'completed' ELSE 'stale' END AS status, count(*) AS records FROM dream_features GROUP BY 1")
def run_counts(spark: SparkSession, d: str) -> DataFrame:
    return structured.run_counts(table(spark, d, "dream_features").select(F.when(F.col("schema_version") == 4, "completed").otherwise("stale").alias("status")))


# --- documents ---------------------------------------------------------------------------------------------------


@query(f"SELECT entry_no, CASE WHEN length(c) > 300 THEN rtrim(substr(c, 1, 300)) || '...' ELSE c END AS preview, CASE WHEN len(w) > 25 THEN array_to_string(w[1:25], ' ') || '...' ELSE array_to_string(w, ' ') END AS words, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || chr(10) || '[TRUNCATED]' ELSE text END AS cut FROM (SELECT entry_no, text, {_SQUASH} AS c, string_split({_SQUASH}, ' ') AS w FROM dreams)")
def previews(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "dreams").select("entry_no", text.preview(t).alias("preview"), text.word_preview(t).alias("words"), text.truncated(t, 500).alias("cut"))


@query(f"SELECT vec_no, trim(CASE WHEN position('{text.SEPARATOR}' IN document) > 0 THEN substr(document, position('{text.SEPARATOR}' IN document) + {len(text.SEPARATOR)}) ELSE document END, ' ' || chr(9) || chr(10) || chr(13)) AS body FROM dream_vectors")
def indexed_bodies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dream_vectors").select("vec_no", text.after_separator(F.col("document")).alias("body"))


@query("SELECT vec_no, array_to_string(list_filter(list_transform(string_split(coalesce(tags, ''), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS tags FROM dream_vectors")
def indexed_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dream_vectors").select("vec_no", F.array_join(text.comma_tags(F.col("tags")), "|").alias("tags"))


@query("SELECT coalesce(nullif(trim(dream_id), ''), 'dream-' || lpad(CAST(entry_no AS VARCHAR), 6, '0')) AS id, 'DREAM_ID: ' || coalesce(nullif(trim(dream_id), ''), 'dream-' || lpad(CAST(entry_no AS VARCHAR), 6, '0')) || chr(10) || 'DATE: ' || coalesce(date, '') || chr(10) || 'YEAR: ' || coalesce(CAST(year AS VARCHAR), '') || chr(10) || 'MONTH: ' || coalesce(CAST(month AS VARCHAR), '') || chr(10) || 'DAY: ' || coalesce(CAST(day AS VARCHAR), '') || chr(10) || 'DATE_PRECISION: ' || coalesce(date_precision, '') || chr(10) || 'TAGS: ' || t || chr(10) || chr(10) || '--- DREAM TEXT ---' || chr(10) || chr(10) || coalesce(text, '') AS document, coalesce(date, '') AS date, coalesce(date_precision, 'day') AS date_precision, coalesce(date_sort, '') AS date_sort, coalesce(year, 0) AS year, coalesce(month, 0) AS month, coalesce(day, 0) AS day, coalesce(word_count, 0) AS word_count, t AS tags FROM (SELECT *, coalesce(array_to_string(tags, ', '), '') AS t FROM dreams)")
def index_documents(spark: SparkSession, d: str) -> DataFrame:
    return tables.index_documents(table(spark, d, "dreams"), "entry_no")


@query("SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS VARCHAR) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly_events(spark: SparkSession, d: str) -> DataFrame:
    w = incremental.windowed_counts(table(spark, d, "events"), "ts", "event_type")
    return w.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS events FROM (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events)) GROUP BY user_id, s")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = incremental.sessions(table(spark, d, "events"), "ts", "user_id")
    return s.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("session_start", "session_end")})


def _all() -> None:
    """The queries of the second module are added when they are asked for; it uses this one."""
    from lumenfold import catalog_plans  # noqa: F401


def queries() -> dict[str, Query]:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)
