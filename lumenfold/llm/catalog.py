"""Queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.llm import leaks, names, pieces, pii, terms, toxic, vectors
from lumenfold.runtime import collect_bounded, stage, table

FIELDS = (("dreams", ("tags",)), ("dream_features", ("themes", "objects")))


def _dims(spark: SparkSession, d: str) -> dict[str, int]:
    rows = collect_bounded(table(spark, d, "vector_collections").select("collection_name", "dims"), 10_000, "the table of collections")
    return {r[0]: r[1] for r in rows if r[0] is not None and r[1]}


def _among(vectors_: DataFrame, keys: DataFrame, most: int = 4_000_000) -> DataFrame:
    """Rows with one of ``keys``; the keys are broadcast only if there are at most ``most`` of them."""
    keys = keys.select("vec_no").distinct()
    return vectors_.join(F.broadcast(keys) if keys.count() <= most else keys, "vec_no", "left_semi")


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every grouped vector with its group."""
    return vectors.similar_groups(table(spark, d, "dream_vectors"), _dims(spark, d))


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Every group with its size, most typical members and tags."""
    v = table(spark, d, "dream_vectors")
    return vectors.describe_groups(vectors.similar_groups(v, _dims(spark, d)), v)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_groups(spark, d).select("vec_no", "cluster_no")


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every vector whose key is divisible by 50."""
    v = table(spark, d, "dream_vectors")
    return vectors.nearest(v, v.filter(F.col("vec_no") % 50 == 0), _dims(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "dream_vectors")
    n = vectors.nearest(v, _among(v, table(spark, d, "probe_vectors")), _dims(spark, d))
    return n.select(F.least("vec_no", "neighbour").alias("vec_a"), F.greatest("vec_no", "neighbour").alias("vec_b")).distinct()


def _personal(spark: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    dreams, records = table(spark, d, "dreams"), table(spark, d, "dream_features")
    texts = dreams.select(F.col("entry_no").alias("row_no"), "text").unionAll(records.select("feature_no", "summary"))
    net = pii.network(texts.filter(F.length("text") > 0), "text", "row_no", records, "named_characters")
    return [("dreams", pii.find_personal(dreams, "entry_no", "text", net)), ("dream_features", pii.find_personal(records, "feature_no", "summary", net))]


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every text with typed placeholders, and what they stand for."""
    parts = [f.select(F.lit(src).alias("src"), F.col(f.columns[0]).alias("row_no"), "redacted", "items") for src, f in _personal(spark, d)]
    return parts[0].unionAll(parts[1])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    item = F.explode(F.array_distinct(F.transform("items", lambda x: F.struct(x["pii_type"].alias("pii_type"), x["value"].alias("value"))))).alias("x")
    return p3_redacted(spark, d).select("src", "row_no", item).select("src", "row_no", "x.pii_type", "x.value")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return names.link_names(table(spark, d, "dream_features"), "journal_id", ["named_characters", "characters"])


def p5_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every term with its counts and verdict."""
    out = []
    for name, fields in FIELDS:
        t = table(spark, d, name)
        out.append(terms.mark_terms(terms.term_frequencies(t, list(fields)), t.count()))
    return reduce(DataFrame.unionByName, out)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_terms(spark, d).filter(F.col("verdict").isNotNull()).select("field", "term", "verdict")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of all entries longer than 1,500 characters."""
    long = table(spark, d, "dreams").filter(F.length("text") > 1500)
    return pieces.split_texts(long, "entry_no", "text", limit=1500, overlap=150)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    p = p6_pieces(spark, d).filter(F.col("piece_no") == 1)
    return p.select("entry_no", F.when(F.col("n_forced") > 0, "forced").otherwise("natural").alias("cut"))


def p6_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """The text of each long entry put together again from its pieces, as a digest, and whether a piece breaks a rule."""
    p = p6_pieces(spark, d)
    before = F.lag("end_char", 1, 0).over(Window.partitionBy("entry_no").orderBy("piece_no"))  # the pieces of one text
    p = p.withColumn("before", before).withColumn("fresh", F.expr("substring(piece, CAST(before - first_char + 1 AS INT))"))
    wrong = (F.length("piece") > 1500) | (F.length("piece") != F.col("end_char") - F.col("first_char")) | (F.col("before") - F.col("first_char") > 150)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "fresh"))), lambda x: x["fresh"]), "")
    return p.groupBy("entry_no").agg(F.md5(whole).alias("digest"), F.max("end_char").alias("chars"), F.count_if(wrong).alias("broken"))


def p7_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of terms with its counts and significance."""
    return terms.cooccurrence(table(spark, d, "dreams"), "tags").unionByName(terms.cooccurrence(table(spark, d, "dream_features"), "themes"))


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every pair with its counts, rounded lift and log-likelihood ratio."""
    return p7_pairs(spark, d).withColumns({"lift": F.round("lift", 6), "llr": F.round("llr", 3)})


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    p = p7_pairs(spark, d)
    return p.filter((F.col("n") >= 5) & (F.col("n") * F.col("n_records") >= 3 * F.col("n_a") * F.col("n_b"))).select("field", "item_a", "item_b")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of each text, or of each part of a text longer than a container."""
    return pieces.pack_texts(table(spark, d, "documents"), "doc_id", "text")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full each container is."""
    return pieces.container_fill(p8_containers(spark, d))


def p8_totals(spark: SparkSession, d: str) -> DataFrame:
    """Documents packed, containers above their capacity, texts split without need, and pieces in no container."""
    c = p8_containers(spark, d)
    c, _ = stage(c, "containers")
    fill = pieces.container_fill(c).agg(F.count_if(F.col("tokens") > 2048).alias("too_full"))
    texts = c.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"), F.min("first_token").alias("first"), F.count_if(F.col("container").isNull()).alias("open"))
    per = texts.agg(F.count("*").alias("documents"), F.count_if(F.col("n") != F.ceil(F.col("tokens") / 2048)).alias("split_needlessly"), F.count_if(F.col("first") != 0).alias("cut_short"), F.coalesce(F.sum("open"), F.lit(0)).alias("left_out"))
    return per.join(F.broadcast(fill))


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items by document, with the stretch of the text and the number of words."""
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).select("doc_id", "item_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """A score of each category for each document."""
    return toxic.score_texts(table(spark, d, "documents"), table(spark, d, "review_labels"))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of each category by source."""
    return toxic.rates(p10_scores(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    s = p10_scores(spark, d)
    pairs = F.explode(F.array(*[F.when(F.col(f"{c}_flag"), F.lit(c)) for c in toxic.CATEGORIES])).alias("category")
    return s.select("doc_id", pairs).filter(F.col("category").isNotNull())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit() and callable(v)}


_TERM = r"trim(regexp_replace(trim(regexp_replace(lower(x), '\s+', ' ', 'g')), '^[# ]+', ''))"


def _terms_sql(t: str, f: str, key: str) -> str:
    return f"SELECT '{f}' AS field, {key} AS rec, {_TERM} AS term FROM (SELECT {key}, unnest({f}) AS x FROM {t}) WHERE x IS NOT NULL AND {_TERM} <> ''"


_LISTS = [("dreams", "tags", "entry_no"), ("dream_features", "themes", "feature_no"), ("dream_features", "objects", "feature_no")]
_ALL_TERMS = " UNION ALL ".join(_terms_sql(*x) for x in _LISTS)
_TOTALS = " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) AS total FROM {t}" for t, f, _ in _LISTS)
_COUNTS = f"""
WITH one AS (SELECT DISTINCT field, rec, term FROM ({" UNION ALL ".join(_terms_sql(*x) for x in _LISTS[:2])})),
c AS (SELECT field, term, count(*) AS k FROM one GROUP BY ALL), totals AS ({_TOTALS}),
p AS (SELECT a.field, a.term AS item_a, b.term AS item_b, count(*) AS n FROM one a JOIN one b ON a.field = b.field AND a.rec = b.rec AND a.term < b.term GROUP BY ALL),
q AS (SELECT p.field, p.item_a, p.item_b, n, x.k AS n_a, y.k AS n_b, t.total AS n_records FROM p JOIN c x ON x.field = p.field AND x.term = p.item_a JOIN c y ON y.field = p.field AND y.term = p.item_b JOIN totals t ON t.field = p.field),
s AS (SELECT *, list_transform([n, n_a - n, n_b - n, n_records - n_a - n_b + n, n_records], lambda v: CASE WHEN v > 0 THEN v * ln(v::DOUBLE) ELSE 0.0 END) AS e, list_transform([n_a, n_records - n_a, n_b, n_records - n_b], lambda v: CASE WHEN v > 0 THEN v * ln(v::DOUBLE) ELSE 0.0 END) AS f FROM q)
SELECT field, item_a, item_b, n, n_a, n_b, n_records, round(n::DOUBLE * n_records / (n_a * n_b), 6) AS lift, round(greatest(0.0, 2 * (list_sum(e) - list_sum(f))), 3) AS llr FROM s
"""
_PAIRS = f"""
WITH one AS (SELECT DISTINCT field, rec, term FROM ({" UNION ALL ".join(_terms_sql(*x) for x in _LISTS[:2])})),
c AS (SELECT field, term, count(*) AS k FROM one GROUP BY ALL), totals AS ({_TOTALS}),
p AS (SELECT a.field, a.term AS item_a, b.term AS item_b, count(*) AS n FROM one a JOIN one b ON a.field = b.field AND a.rec = b.rec AND a.term < b.term GROUP BY ALL)
SELECT p.field, p.item_a, p.item_b FROM p JOIN c x ON x.field = p.field AND x.term = p.item_a JOIN c y ON y.field = p.field AND y.term = p.item_b
JOIN totals t ON t.field = p.field WHERE n >= 5 AND n * t.total >= 3 * x.k * y.k
"""


def oracle_sql() -> dict[str, str]:
    freq = f"SELECT field, term, count(*) AS occurrences, count(DISTINCT rec) AS records FROM ({_ALL_TERMS}) GROUP BY field, term"
    verdict = "CASE WHEN records < 3 THEN 'rare' WHEN records > 0.2 * total THEN 'common' END"
    return {
        "p5_terms": f"SELECT field, term, occurrences, records, {verdict} AS verdict FROM ({freq}) JOIN ({_TOTALS}) USING (field)",
        "p5_found": f"SELECT field, term, {verdict} AS verdict FROM ({freq}) JOIN ({_TOTALS}) USING (field) WHERE {verdict} IS NOT NULL",
        "p6_found": r"SELECT entry_no, CASE WHEN regexp_matches(text, '\S{1000}\S{501}') THEN 'forced' ELSE 'natural' END AS cut FROM dreams WHERE length(text) > 1500",
        "p6_rebuilt": "SELECT entry_no, md5(text) AS digest, length(text) AS chars, 0 AS broken FROM dreams WHERE length(text) > 1500",
        "p7_found": _PAIRS,
        "p7_counts": _COUNTS,
        "p8_totals": "SELECT count(*) AS documents, 0 AS too_full, 0 AS split_needlessly, 0 AS cut_short, 0 AS left_out FROM documents WHERE length(text) > 0",
    }
