"""Checks of journals: repeated ids, repeated, isolated, backward and jumping dates. All by journal, in row order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold import runtime
from lumenfold.functions import dates
from lumenfold.operators.ordered import with_neighbour, with_running_sum


def duplicate_ids(entries: DataFrame, journal: str = "journal_id", key: str = "dream_id", order: str = "entry_no") -> DataFrame:
    """Every row whose id stands in two or more rows of its journal: with their number, the first of them, and whether
    any has a placeholder date. Ids are trimmed; null and empty ones skipped."""
    rows = entries.select(journal, F.trim(key).alias(key), order, "date", dates.placeholder(F.col("date"), F.col("date_precision")).alias("_p")).filter(F.col(key) != "")
    a = rows.groupBy(journal, key).agg(F.count("*").alias("times"), F.min(order).alias("first_row"), F.bool_or("_p").alias("has_placeholder")).filter(F.col("times") > 1)
    return rows.join(a, [journal, key]).select(journal, key, order, "date", "times", "first_row", "has_placeholder")


def date_blocks(entries: DataFrame, journal: str = "journal_id", order: str = "entry_no") -> DataFrame:
    """Runs of consecutive rows of one date, after rows with placeholder dates or without a year are left out.

    ``journal_id, block, date_text, year, sort_date, first_row, last_row, entries``; blocks count from 1.
    """
    keep = entries.filter(~dates.placeholder(F.col("date"), F.col("date_precision")) & F.col("year").isNotNull() & F.col("date").isNotNull())
    rows = keep.select(journal, order, F.col("date").alias("date_text"), "year", F.coalesce(dates.iso_date(F.col("date_sort")), dates.iso_date(F.col("date"))).alias("sort_date"))
    rows = with_neighbour(rows, journal, order, {"_d": F.col("date_text"), "_y": F.col("year"), "_s": F.col("sort_date")})
    same = F.col("_d").eqNullSafe(F.col("date_text")) & F.col("_y").eqNullSafe(F.col("year")) & F.col("_s").eqNullSafe(F.col("sort_date"))
    rows = with_running_sum(rows, journal, order, (~same).cast("int"), "block")
    return rows.groupBy(journal, "block").agg(F.first("date_text").alias("date_text"), F.first("year").alias("year"), F.first("sort_date").alias("sort_date"), F.min(order).alias("first_row"), F.max(order).alias("last_row"), F.count("*").alias("entries"))


def year_runs(blocks: DataFrame, journal: str = "journal_id") -> DataFrame:
    """Runs of consecutive blocks of one year: ``run, year, first_block, last_block, blocks``."""
    return _with_runs(blocks, journal).groupBy(journal, "run").agg(F.first("year").alias("year"), F.min("block").alias("first_block"), F.max("block").alias("last_block"), F.count("*").alias("blocks"))


def _with_runs(blocks: DataFrame, journal: str) -> DataFrame:
    rows = with_neighbour(blocks, journal, "block", {"_y": F.col("year")})
    return with_running_sum(rows, journal, "block", (~F.col("_y").eqNullSafe(F.col("year"))).cast("int"), "run").drop("_y")


def repeated_dates(blocks: DataFrame, journal: str = "journal_id") -> DataFrame:
    """Blocks whose date stands in an earlier block of the journal, with that block."""
    key = F.coalesce(F.col("sort_date").cast("string"), F.concat_ws("|", "date_text", F.col("year").cast("string")))
    rows = blocks.withColumn("k", key)
    first = rows.groupBy(journal, "k").agg(F.min(F.struct("block", "date_text")).alias("f")).select(journal, "k", F.col("f.block").alias("earlier_block"), F.col("f.date_text").alias("earlier_date"))
    return rows.join(first, [journal, "k"]).filter(F.col("block") > F.col("earlier_block")).select(journal, "block", "date_text", "earlier_block", "earlier_date")


def backward_dates(blocks: DataFrame, journal: str = "journal_id") -> DataFrame:
    """Blocks dated before the block ahead of them, with the dates around."""
    rows = with_neighbour(blocks, journal, "block", {"previous_date": F.col("date_text"), "_s": F.col("sort_date")})
    rows = with_neighbour(rows, journal, "block", {"next_date": F.col("date_text")}, after=True)
    return rows.filter(F.col("sort_date") < F.col("_s")).select(journal, "block", "date_text", "previous_date", "next_date")


def year_jumps(blocks: DataFrame, most: int = 1, journal: str = "journal_id") -> DataFrame:
    """Blocks whose year is more than ``most`` away from that of the block ahead."""
    rows = with_neighbour(blocks, journal, "block", {"previous_year": F.col("year")})
    return rows.filter(F.abs(F.col("year") - F.col("previous_year")) > most).select(journal, "block", "previous_year", "year")


def isolated_runs(blocks: DataFrame, most: int = 3, journal: str = "journal_id") -> DataFrame:
    """Short runs of a year between runs of another one and the same year that would be in order in that year.

    A run of at most ``most`` blocks counts if all its blocks and both neighbouring blocks have a date and the dates,
    with the year replaced, exist, do not go back, and lie within those of the neighbours.
    """
    if most < 1:
        raise ValueError("the length of an isolated run must be at least 1")
    rows = _with_runs(blocks, journal)
    runs = rows.groupBy(journal, "run").agg(F.first("year").alias("year"), F.min("block").alias("first_block"), F.max("block").alias("last_block"), F.min_by("sort_date", "block").alias("_first"), F.max_by("sort_date", "block").alias("_last"), F.count("*").alias("blocks"), F.count("sort_date").alias("n_dated"))
    runs = with_neighbour(runs, journal, "run", {"prev_year": F.col("year"), "prev_date": F.col("_last")})
    runs = with_neighbour(runs, journal, "run", {"next_year": F.col("year"), "next_date": F.col("_first")}, after=True)
    short = runs.filter((F.col("blocks") <= most) & (F.col("prev_year") == F.col("next_year")) & (F.col("prev_year") != F.col("year")) & (F.col("n_dated") == F.col("blocks")) & F.col("prev_date").isNotNull() & F.col("next_date").isNotNull())
    inside = rows.select(journal, "run", "block", "sort_date").join(short.select(journal, "run", "year", "prev_year", "prev_date", "next_date", "first_block", "last_block"), [journal, "run"])
    moved = F.try_to_date(F.concat(F.format_string("%04d", "prev_year"), F.date_format("sort_date", "-MM-dd")), "yyyy-MM-dd")
    inside = inside.withColumn("moved", moved)
    # at most `most` blocks a run: the list is bounded
    a = inside.groupBy(journal, "run", "year", "prev_year", "prev_date", "next_date", "first_block", "last_block").agg(F.array_sort(F.collect_list(F.struct("block", "moved"))).alias("l"))
    a = a.withColumn("m", F.transform("l", lambda x: x["moved"]))
    ordered = F.forall("m", lambda x: x.isNotNull()) & (F.array_sort("m") == F.col("m")) & (F.element_at("m", 1) >= F.col("prev_date")) & (F.element_at("m", -1) <= F.col("next_date"))
    return a.filter(ordered).select(journal, "run", "year", F.col("prev_year").alias("expected_year"), "first_block", "last_block")


def findings(entries: DataFrame, *, max_isolated: int = 3, max_year_jump: int = 1) -> DataFrame:
    """Every suspicious block with the dates around it and its reasons in the order repeated, isolated, backward, jump; what
    is found between an isolated block and the next one is charged to the isolated one.

    ``journal_id, block, date_text, year, previous_date, next_date, first_row, reasons``. The neighbours of a block are
    looked up once; the wording of the reasons is a fixed value.
    """
    if max_year_jump < 0:
        raise ValueError("the largest year jump must not be negative")
    blocks = with_neighbour(date_blocks(entries), "journal_id", "block", {"previous_date": F.col("date_text"), "_d": F.col("sort_date"), "_y": F.col("year")})
    blocks = with_neighbour(blocks, "journal_id", "block", {"next_date": F.col("date_text")}, after=True)
    blocks, _ = runtime.stage(blocks, "blocks")  # read by each of the detectors
    iso, _ = runtime.stage(isolated_runs(blocks.drop("_d", "_y"), max_isolated), "isolated")
    iso_blocks = iso.select("journal_id", F.explode(F.sequence("first_block", "last_block")).alias("block"), "year", "expected_year", (F.col("last_block") - F.col("first_block") + 1).alias("n"))
    say = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    rep = repeated_dates(blocks).select("journal_id", "block", F.lit(1).alias("rank"), say("date duplicates the earlier block at ", F.col("earlier_date")).alias("reason"))
    one = iso_blocks.select("journal_id", "block", F.lit(2).alias("rank"), say("short run of ", F.col("n"), " date(s) in ", F.col("year"), " is surrounded by dates in ", F.col("expected_year"), "; changing the year to ", F.col("expected_year"), " restores chronological order").alias("reason"))
    gap = F.abs(F.col("year") - F.col("_y"))
    back = F.when(F.col("sort_date") < F.col("_d"), F.struct(F.lit(3).alias("kind"), say("date goes backward after ", F.col("previous_date")).alias("own"), say("next date ", F.col("date_text"), " goes backward").alias("charged")))
    jump = F.when(gap > max_year_jump, F.struct(F.lit(4).alias("kind"), say("year changes by ", gap, " after ", F.col("previous_date")).alias("own"), say("year changes by ", gap, " after ", F.col("previous_date")).alias("charged")))
    marked = iso_blocks.select("journal_id", (F.col("block") + 1).alias("block"), F.lit(True).alias("after_isolated"))
    pair = blocks.select("journal_id", "block", F.explode(F.array_compact(F.array(back, jump))).alias("x")).join(marked, ["journal_id", "block"], "left")
    shift = F.coalesce("after_isolated", F.lit(False))
    pair = pair.select("journal_id", F.when(shift, F.col("block") - 1).otherwise(F.col("block")).alias("block"), F.when(shift, F.col("x.kind") + 2).otherwise(F.col("x.kind")).alias("rank"), F.when(shift, F.col("x.charged")).otherwise(F.col("x.own")).alias("reason"))
    every = reduce(DataFrame.unionAll, [rep, one, pair])
    reasons = every.groupBy("journal_id", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "reason"))), lambda x: x["reason"]), "; ").alias("reasons"))
    return blocks.select("journal_id", "block", "date_text", "year", "previous_date", "next_date", "first_row").join(reasons, ["journal_id", "block"])
