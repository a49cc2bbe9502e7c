"""Plain-text journals as rows of entries. Each file is one journal; files are parsed side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.functions import dates, text

#: The grammar of date headings and lines of tags.
HEADING = r"^\s*(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})\s*$"
TAG_LINE = r"^\s*(#[A-Za-z0-9_?+-]+(?:\s+#[A-Za-z0-9_?+-]+)*)\s*$"
#: Line ends as a text editor sees them.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029]"


def read_journals(spark: SparkSession, path: str) -> DataFrame:
    """Whole files: ``journal_id`` (the file's path), ``content``."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("journal_id"), F.col("value").alias("content"))


def lines_of(journals: DataFrame, content: str = "content") -> DataFrame:
    """``journal_id, pos, line, month, day, year_text, is_heading, is_blank, is_tags``; a byte order mark is dropped.

    A line end at the end of a file makes no further line.
    """
    body = F.regexp_replace(F.regexp_replace(F.col(content), f"(?:{LINE_END})$", ""), r"\ufeff", "")
    rows = journals.select("journal_id", F.posexplode(F.split(body, LINE_END)).alias("pos", "line")).withColumn("line", F.regexp_replace("line", r"(?U)\s+$", ""))
    part: list[Column] = [F.when(F.col("is_heading"), F.regexp_extract("line", HEADING, i)) for i in (1, 2, 3)]
    rows = rows.withColumn("is_heading", F.col("line").rlike(HEADING))
    return rows.select("journal_id", "pos", "line", part[0].cast("int").alias("month"), part[1].cast("int").alias("day"), part[2].alias("year_text"), "is_heading", (F.col("line") == "").alias("is_blank"), F.col("line").rlike(TAG_LINE).alias("is_tags"))


def separators(lines: DataFrame) -> DataFrame:
    """Blank lines that part entries, by journal: 2 if any two blank lines follow each other, else 1."""
    w = Window.partitionBy("journal_id").orderBy("pos")
    pair = F.col("is_blank") & F.coalesce(F.lag("is_blank").over(w), F.lit(False))
    return lines.withColumn("_p", pair).groupBy("journal_id").agg(F.when(F.bool_or("_p"), 2).otherwise(1).alias("separator"))


def parse_journals(journals: DataFrame, *, separator: int | None = None) -> DataFrame:
    """Entries of journals (``journal_id, content``) in order: ``journal_id, line_no, dream_id, date, year, month, day,
    date_precision, date_sort, tags, text, word_count``.

    An entry begins at a date heading and after at least ``separator`` blank lines (found by journal if not given);
    fewer blank lines belong to the text. Lines of tags only at its start are its tags. Text before the first heading is
    an error. An id repeats if a heading repeats. Null and empty journals have no entries. A journal is one window, as
    its lines depend on each other; journals are as many windows.
    """
    if separator is not None and separator < 1:
        raise ValueError("the separator must be at least one blank line")
    lines = lines_of(journals.filter(F.col("content").isNotNull()))
    w = Window.partitionBy("journal_id").orderBy("pos")
    lines = lines.withColumn("heading", F.sum(F.col("is_heading").cast("int")).over(w))
    early = (F.col("heading") == 0) & ~F.col("is_blank")
    lines = lines.withColumn("heading", F.when(early, F.raise_error(F.concat(F.lit("text before the first date heading, line "), (F.col("pos") + 1).cast("string"))).cast("long")).otherwise(F.col("heading")))
    lines = lines.join(separators(lines), "journal_id") if separator is None else lines.withColumn("separator", F.lit(separator))
    # a written line and the blank lines after it are a block; ``_run`` is the number of these
    lines = lines.withColumn("_g", F.sum((~F.col("is_blank")).cast("int")).over(w))
    block = Window.partitionBy("journal_id", "_g")
    lines = lines.withColumn("_run", F.sum(F.col("is_blank").cast("int")).over(block)).withColumn("_head", F.bool_or("is_heading").over(block))
    first = F.coalesce(F.lag("_head").over(w), F.lit(False))
    apart = F.coalesce(F.lag("_run").over(w), F.lit(0)) >= F.col("separator")
    lines = lines.withColumn("_start", ~F.col("is_blank") & ~F.col("is_heading") & (first | apart))
    inside = Window.partitionBy("journal_id", "heading").orderBy("pos")
    parts = lines.withColumn("_s", F.sum(F.col("_start").cast("int")).over(inside))
    # blank lines too few to part entries belong to the text, those after a heading to its first entry
    kept = parts.filter(~F.col("is_heading") & (~F.col("is_blank") | (F.col("_run") < F.col("separator")))).withColumn("_s", F.greatest("_s", F.lit(1)))
    at = F.struct("pos", "line", "is_tags", "is_blank")
    heads = lines.filter("is_heading").select("journal_id", "heading", F.col("month").alias("m"), F.col("day").alias("d"), "year_text")
    groups = kept.groupBy("journal_id", "heading", "_s").agg(F.min("pos").alias("_from"), F.array_sort(F.collect_list(at)).alias("_l"))
    groups = groups.filter(F.exists("_l", lambda x: ~x["is_blank"])).join(heads, ["journal_id", "heading"])
    flags = F.transform("_l", lambda x: x["is_tags"])
    n_tags = F.coalesce(F.nullif(F.array_position(flags, False), F.lit(0)) - 1, F.size("_l")).cast("int")
    groups = groups.withColumn("_n", n_tags)
    tags = F.flatten(F.transform(F.slice("_l", 1, F.col("_n")), lambda x: F.transform(F.split(F.btrim(x["line"], F.lit(" \t")), r"\s+"), lambda t: F.substring(t, 2, 10_000))))
    rest = F.array_join(F.transform(F.slice("_l", F.col("_n") + 1, F.size("_l")), lambda x: x["line"]), "\n")
    groups = groups.select("journal_id", "heading", "_from", "m", "d", "year_text", tags.alias("tags"), F.btrim(rest, F.lit(" \t\r\n\x0b\x0c")).alias("text"), dates.date_parts(F.col("m"), F.col("d"), F.col("year_text")).alias("p"))
    wi = Window.partitionBy("journal_id", "heading").orderBy("_from")
    y = dates.full_year(F.col("year_text")).cast("string")
    return groups.select(
        "journal_id",
        (F.col("_from") + 1).alias("line_no"),
        F.concat_ws("-", F.lit("dream"), y, F.col("m").cast("string"), F.col("d").cast("string"), (F.row_number().over(wi) - 1).cast("string")).alias("dream_id"),
        F.concat_ws("/", F.col("m").cast("string"), F.col("d").cast("string"), y).alias("date"),
        "p.*",
        "tags",
        "text",
        text.word_count(F.col("text")).alias("word_count"),
    )
