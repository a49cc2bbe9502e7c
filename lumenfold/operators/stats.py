"""Counts by period and tag, lengths and words of dated, tagged entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import dates, text


def dated(entries: DataFrame, start: str | None = None, end: str | None = None, *, keep_undated: bool = False) -> DataFrame:
    """Entries with ``entry_date``, within bounds that are included. Undated ones are dropped, unless ``keep_undated``
    and there is no bound. Bounds are compared as dates; one that is none is an error that names it."""
    first = dates.lenient_date(start, "start_date") if start else None
    last = dates.lenient_date(end, "end_date") if end else None
    if first and last and first > last:
        raise ValueError(f"start date {start} is after end date {end}")
    out = entries.withColumn("entry_date", dates.iso_date(F.col("date_sort")))
    if not (keep_undated and not start and not end):
        out = out.filter(F.col("entry_date").isNotNull())
    if first:
        out = out.filter(F.col("entry_date") >= F.lit(first))
    if last:
        out = out.filter(F.col("entry_date") <= F.lit(last))
    return out


def undated(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count_if(dates.iso_date(F.col("date_sort")).isNull()).alias("excluded"), F.count("*").alias("entries"))


def summary(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("entries"), F.min("entry_date").cast("string").alias("first_date"), F.max("entry_date").cast("string").alias("last_date"))


def entries_per_period(entries: DataFrame, freq: str = "M") -> DataFrame:
    """Entries of each period that has any: ``period, label, entries``."""
    p = dated(entries).groupBy(dates.period(F.col("entry_date"), freq).alias("start")).agg(F.count("*").alias("entries"))
    return p.select(F.col("start").cast("string").alias("period"), dates.period_label(F.col("start"), freq).alias("label"), "entries")


def tag_stats(entries: DataFrame) -> DataFrame:
    """Entries with each tag, a tag counting once an entry, and their share in percent of all entries."""
    total = entries.agg(F.count("*").alias("total"))
    counts = entries.select(F.explode(F.array_distinct("tags")).alias("tag")).filter(F.col("tag").isNotNull()).groupBy("tag").agg(F.count("*").alias("entries"))
    return counts.join(F.broadcast(total)).select("tag", "entries", F.round(100.0 * F.col("entries") / F.col("total"), 2).alias("percent"))


def top_tags(entries: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most frequent tags, repeats in an entry counting; ties by tag."""
    return entries.select(F.explode("tags").alias("tag")).filter(F.col("tag").isNotNull()).groupBy("tag").agg(F.count("*").alias("uses")).orderBy(F.desc("uses"), "tag").limit(n)


def tag_counts_over_time(entries: DataFrame, tags: list[str], freq: str = "Y", *, normalize: bool = False) -> DataFrame:
    """Entries with each of ``tags`` by period, 0 where there are none: ``period, label, tag, value``.

    Every period that has entries appears. ``normalize`` gives percent of the entries of the period.
    """
    rows = dated(entries).withColumn("start", dates.period(F.col("entry_date"), freq))
    wanted = F.array(*[F.struct(F.lit(t).alias("tag"), F.array_contains("tags", t).cast("long").alias("has")) for t in tags])
    grid = rows.select("start", F.explode(wanted).alias("w")).groupBy("start", "w.tag").agg(F.sum(F.coalesce("w.has", F.lit(0))).alias("n"), F.count("*").alias("all"))
    value = F.round(100.0 * F.col("n") / F.col("all"), 4) if normalize else F.col("n")
    return grid.select(F.col("start").cast("string").alias("period"), dates.period_label(F.col("start"), freq).alias("label"), "tag", value.alias("value"))


def tag_pivot(entries: DataFrame, tags: list[str], freq: str = "Y") -> DataFrame:
    """One row a period, one column a tag, in the order of ``tags``; and all entries of the period."""
    rows = dated(entries).groupBy(dates.period(F.col("entry_date"), freq).alias("start"))
    cells: list[Column] = [F.count_if(F.array_contains("tags", t)).alias(f"tag_{t}") for t in tags]
    return rows.agg(F.count("*").alias("entries"), *cells).withColumn("start", F.col("start").cast("string")).withColumnRenamed("start", "period")


def missing_tags(entries: DataFrame, tags: list[str]) -> DataFrame:
    """Tags of the list that no entry has."""
    wanted = entries.sparkSession.createDataFrame([(t,) for t in tags], "tag string")
    used = entries.select(F.explode("tags").alias("tag")).filter(F.col("tag").isin(tags)).distinct()
    return wanted.join(used, "tag", "left_anti")


def with_any_tag(entries: DataFrame, tags: list[str]) -> DataFrame:
    return entries.filter(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))


def length_stats(entries: DataFrame) -> DataFrame:
    """Mean and median number of words, 0 without entries."""
    a = entries.agg(F.count("*").alias("entries"), F.avg("word_count").alias("mean"), F.median("word_count").alias("median"))
    return a.select("entries", F.round(F.coalesce("mean", F.lit(0.0)), 2).alias("mean_words"), F.round(F.coalesce(F.col("median").cast("double"), F.lit(0.0)), 2).alias("median_words"))


def longest_and_shortest(entries: DataFrame, key: str) -> DataFrame:
    """The longest and the shortest entry, the first of equals."""
    row = F.struct(F.col(key).alias("key"), "date", "word_count")
    a = entries.filter(F.col("word_count").isNotNull()).agg(F.max_by(row, F.struct("word_count", -F.col(key))).alias("longest"), F.min_by(row, F.struct("word_count", F.col(key))).alias("shortest"))
    both = F.explode(F.array(F.struct(F.lit("longest").alias("kind"), F.col("longest").alias("r")), F.struct(F.lit("shortest").alias("kind"), F.col("shortest").alias("r")))).alias("x")
    return a.select(both).filter(F.col("x.r").isNotNull()).select("x.kind", F.col("x.r.key").alias(key), "x.r.date", "x.r.word_count")


def common_words(entries: DataFrame, key: str, stop_words: list[str], *, n: int = 20, least_length: int = 3) -> DataFrame:
    """The ``n`` most frequent words with their percent of all kept words; ties by first appearance."""
    words = entries.select(F.col(key).alias("_k"), F.posexplode(text.tokens(F.col("text"))).alias("_p", "word"))
    words = words.filter((F.length("word") >= least_length) & ~F.col("word").isin(stop_words))
    counts = words.groupBy("word").agg(F.count("*").alias("uses"), F.min(F.struct("_k", "_p")).alias("first"))
    total = counts.agg(F.sum("uses").alias("total"))
    top = counts.orderBy(F.desc("uses"), "first").limit(n)
    return top.join(F.broadcast(total)).select("word", "uses", F.round(100.0 * F.col("uses") / F.col("total"), 2).alias("percent"))
