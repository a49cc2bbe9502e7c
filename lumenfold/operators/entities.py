"""Named persons over records: one row a person, with mentions, dates and a stable id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import dates, text
from lumenfold.operators.ordered import with_running_sum


def mentions(records: DataFrame, scope: str = "journal_id", order: str = "feature_no", key: str = "dream_id") -> DataFrame:
    """One row for each record and person: the first display name in the list, by case-folded identity."""
    rows = records.select(scope, order, key, dates.iso_date(F.col("date_sort")).alias("day"), F.posexplode("named_characters").alias("pos", "raw"))
    rows = rows.filter(F.trim("raw") != "").withColumn("name", text.compact(F.col("raw"))).withColumn("identity", text.identity(F.col("raw")))
    return rows.groupBy(scope, order, key, "day", "identity").agg(F.min(F.struct("pos", "name")).alias("f")).select(scope, order, key, "day", "identity", F.col("f.name").alias("name"))


def roll_up(records: DataFrame, scope: str = "journal_id", order: str = "feature_no", key: str = "dream_id") -> DataFrame:
    """Persons of each scope: display name of the first mention, number of records, first and last date, first and last
    record. Lists of all records stay in ``mentions``, for a name can stand in any number of them."""
    m = mentions(records, scope, order, key)
    at = F.struct(order, key, "name")
    a = m.groupBy(scope, "identity").agg(F.min(at).alias("f"), F.max(at).alias("l"), F.count("*").alias("records"), F.min("day").cast("string").alias("first_date"), F.max("day").cast("string").alias("last_date"))
    return a.select(scope, "identity", F.col("f.name").alias("name"), "records", "first_date", "last_date", F.col(f"f.{key}").alias("first_record"), F.col(f"l.{key}").alias("last_record"))


def with_ids(persons: DataFrame, scope: str = "journal_id") -> DataFrame:
    """``character_id``: the slug of the name; of several with one slug in a scope, the first identity keeps it and each
    other gets the first 8 digits of the SHA-256 of its name."""
    rows = persons.withColumn("_s", text.slug(F.col("name")))
    first = rows.groupBy(scope, "_s").agg(F.min("identity").alias("_f"))
    rows = rows.join(first, [scope, "_s"])
    longer = F.concat("_s", F.lit("_"), F.left(F.sha2("name", 256), F.lit(8)))
    return rows.withColumn("character_id", F.when(F.col("identity") == F.col("_f"), F.col("_s")).otherwise(longer)).drop("_s", "_f")


def history(records: DataFrame, scope: str = "journal_id", order: str = "feature_no", key: str = "dream_id") -> DataFrame:
    """Mentions of each person in order of date, then record, undated ones last, numbered from 1.

    The numbers are running sums over chunks of a month, so that a name in a third of all records is no single task.
    """
    shift = 1 << 40
    m = mentions(records, scope, order, key)
    day = F.coalesce(F.date_diff("day", F.lit("0001-01-01").cast("date")), F.lit(4_000_000)).cast("long")
    m = m.withColumn("_person", F.concat_ws("\0", scope, "identity")).withColumn("_at", day * shift + F.col(order))
    return with_running_sum(m, "_person", "_at", F.lit(1), "nth", chunk=31 * shift).drop("_person", "_at")
