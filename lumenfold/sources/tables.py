"""JSON Lines, stop words, point lookups and collections; and the sinks."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lumenfold import runtime
from lumenfold.functions import text
from lumenfold.operators.structured import latest

ENTRY = T.StructType([T.StructField(n, t) for n, t in (("dream_id", T.StringType()), ("date", T.StringType()), ("year", T.IntegerType()), ("month", T.IntegerType()), ("day", T.IntegerType()), ("date_precision", T.StringType()), ("date_sort", T.StringType()), ("tags", T.ArrayType(T.StringType())), ("text", T.StringType()), ("word_count", T.IntegerType()))])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = ENTRY, *, strict: bool = True) -> DataFrame:
    """Records with ``line_no`` (physical, from 1; blank lines count but give no record) and ``file``.

    A line that is no JSON object is an error with its number, or, if not ``strict``, a row with ``bad_line``. If the key
    ``date_sort`` is absent, ``date`` stands for it; if it is null, the entry has no date.
    """
    rows = numbered_lines(spark, path).filter(F.trim("raw") != "")
    keys = F.json_object_keys("raw")
    rows = rows.withColumn("r", F.from_json("raw", schema, {"mode": "PERMISSIVE"})).withColumn("ok", keys.isNotNull())
    if strict:
        checked = F.when(F.col("ok"), F.col("line_no")).otherwise(F.raise_error(F.concat(F.lit("invalid JSON in line "), F.col("line_no").cast("string"))).cast("int"))
        rows = rows.withColumn("line_no", checked)
    out = rows.select("file", "line_no", "r.*", *([] if strict else [F.when(~F.col("ok"), F.col("raw")).alias("bad_line")]), keys.alias("_keys"))
    if {"date_sort", "date"} <= set(schema.fieldNames()):
        out = out.withColumn("date_sort", F.when(F.array_contains("_keys", "date_sort"), F.col("date_sort")).otherwise(F.col("date")))
    return out.drop("_keys")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their number in the file: ``file, line_no, raw``.

    Files are split: a line is known by where its part begins (``_metadata`` of the scan) and its place inside the part;
    the lines of earlier parts of the file are then added, one row a part.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_part"), F.col("value").alias("raw"), F.monotonically_increasing_id().alias("_at"))
    # a part of a file is read by one task from its beginning, so that the ids of its rows ascend without a gap
    parts = lines.groupBy("file", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("file", "_part", (before - F.col("_first")).alias("_shift"))
    return lines.join(parts, ["file", "_part"]).select("file", (F.col("_at") + F.col("_shift") + 1).cast("int").alias("line_no"), "raw")


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The table itself, after a check that no key is empty or repeated."""
    for k in keys:
        if dict(df.dtypes)[k] != "string" and k.endswith("_id"):
            raise ValueError(f"{k} must be a text")
    bad = df.filter(F.greatest(*[(F.col(k).isNull() | (F.col(k).cast("string") == "")).cast("int") for k in keys], F.lit(0)) > 0).limit(1).collect()
    if bad:
        raise ValueError(f"a row has no {', '.join(keys)}")
    twice = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{keys} repeat: {tuple(twice[0])[:-1]}")
    return df


def find(df: DataFrame, key: str, value: Any, order: str) -> DataFrame:
    """The first row of a key; an error if there is none."""
    got = df.filter(F.col(key) == F.lit(value)).orderBy(order).limit(1)
    if got.isEmpty():
        raise ValueError(f"{key} {value!r} not found")
    return got


def select_entries(df: DataFrame, key: str, value: Any = None) -> DataFrame:
    """All rows, or those with one key if it is given; an error if there are none with it."""
    if value is None:
        return df
    got = df.filter(F.col(key) == F.lit(value))
    if got.isEmpty():
        raise ValueError(f"{key} {value!r} not found")
    return got


def last_records(df: DataFrame, key: str, order: str) -> DataFrame:
    return latest(df, [key], order)


def stop_words(spark: SparkSession, path: str | None = None, built_in: list[str] | None = None) -> list[str]:
    """Built-in words and those of a file: lower case, without blank lines and comments."""
    from pyspark.ml.feature import StopWordsRemover

    base = set(built_in if built_in is not None else StopWordsRemover.loadDefaultStopWords("english"))
    if path:
        rows = spark.read.text(path).select(F.lower(F.trim("value")).alias("w")).filter((F.col("w") != "") & ~F.col("w").startswith("#"))
        base |= {r[0] for r in runtime.collect_bounded(rows, 100_000, "the list of stop words")}
    return sorted(base)


def collection(vectors: DataFrame, name: str) -> DataFrame:
    """All vectors of a collection; an error if it is empty or holds vectors of several lengths."""
    rows = vectors.filter(F.col("collection_name") == name)
    lengths = rows.filter(F.col("embedding").isNotNull()).select(F.size("embedding").alias("n")).distinct().limit(2).collect()
    if len(lengths) != 1:
        raise ValueError(f"collection {name} is empty" if not lengths else f"collection {name} is not a matrix")
    return rows


def index_documents(entries: DataFrame, order: str) -> DataFrame:
    """Indexed document and flat metadata of each entry; a missing id becomes one of its order. The labels of the header
    are fixed values."""
    key = F.coalesce(F.nullif(F.trim("dream_id"), F.lit("")), F.concat(F.lit("dream-"), F.lpad(F.col(order).cast("string"), 6, "0")))
    tags = F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ", ")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("year", "month", "day", "word_count")]
    said = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("date", "year", "month", "day", "date_precision", "text")}
    head = [F.concat(F.lit(f"{c.upper()}: "), said[c]) for c in ("date", "year", "month", "day", "date_precision")]
    doc = F.concat_ws("\n", F.concat(F.lit("DREAM_ID: "), key), *head, F.concat(F.lit("TAGS: "), tags), F.lit(""), F.lit(text.SEPARATOR), F.lit(""), said["text"])
    return entries.select(key.alias("id"), doc.alias("document"), F.coalesce("date", F.lit("")).alias("date"), F.coalesce("date_precision", F.lit("day")).alias("date_precision"), F.coalesce("date_sort", F.lit("")).alias("date_sort"), *zero, tags.alias("tags"))


# --- sinks -------------------------------------------------------------------------------------------------------


def write_jsonl(df: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """JSON Lines with null fields kept; refuses an existing folder unless told to overwrite."""
    df.write.mode("overwrite" if overwrite else "error").option("ignoreNullFields", "false").json(path)


def replace(df: DataFrame, path: str) -> None:
    """Write the new table beside the old one, move that away and the new one into its place, then delete the old one.

    At each moment at least one whole table exists. Between the two moves there is none at ``path``: a reader that comes
    just then fails, and a writer that ends there leaves the old one at ``path.old``, which ``recover`` (and the next call)
    puts back.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    recover(spark, path)
    df.write.mode("overwrite").parquet(f"{path}.new")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(p(f"{path}.old"), True)
    if fs.exists(p(path)) and not fs.rename(p(path), p(f"{path}.old")):
        raise OSError(f"cannot move {path} away")
    if not fs.rename(p(f"{path}.new"), p(path)):
        raise OSError(f"cannot move {path}.new to {path}")
    fs.delete(p(f"{path}.old"), True)


def recover(spark: SparkSession, path: str) -> None:
    """Put the old table back where a ``replace`` ended between its moves."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p(path)) and fs.exists(p(f"{path}.old")):
        fs.rename(p(f"{path}.old"), p(path))


def write_collection(vectors: DataFrame, path: str) -> None:
    """Drop and recreate the collections that occur in ``vectors``; others stay."""
    vectors.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection_name").parquet(path)


def write_assignments(rows: DataFrame, path: str) -> None:
    """CSV of cluster assignments: six decimals, -1 as noise."""
    label = F.when(F.col("cluster") < 0, "noise / ambiguous").otherwise(F.coalesce("cluster_label", F.col("cluster").cast("string")))
    shown = rows.withColumn("cluster_label", label).withColumns({c: F.format_string("%.6f", c) for c in ("x", "y") if c in rows.columns})
    shown.write.mode("overwrite").option("header", "true").csv(path)


def report_json(sections: dict[str, DataFrame], most: int = 10_000) -> str:
    """One JSON text of small tables."""
    return json.dumps({k: [r.asDict(recursive=True) for r in runtime.collect_bounded(v, most, k)] for k, v in sections.items()}, ensure_ascii=False, default=str, indent=2)
