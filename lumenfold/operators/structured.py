"""Structured feature records: schema, normalisation, validation, what is still to do, and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.functions import text

SCHEMA_VERSION = 4
LISTS = ("setting", "characters", "named_characters", "emotions", "themes", "objects", "actions", "sensory_details", "dream_mechanics")
#: The allowed words of each closed field, and the fields in the order of the record.
LEVELS = ("none", "low", "moderate", "high")
ENUMS = {
    "lucidity_level": ("none", "questioning", "lucid"),
    "violence": LEVELS,
    "sexual_content": LEVELS,
    "social_conflict": LEVELS,
    "threat_level": LEVELS,
    "agency": ("low", "moderate", "high", "unclear"),
    "bizarreness": LEVELS,
    "perspective": ("first_person", "third_person", "mixed", "unclear"),
    "ending": ("resolved", "unresolved", "interrupted", "unclear"),
    "memory_quality": ("fragmentary", "partial", "detailed"),
}
FREE = ("tone", "summary")
FIELDS = (*LISTS, "tone", "lucidity", *ENUMS, "summary")


def schema() -> T.StructType:
    """Type of the fields of a record."""
    kinds = {f: T.ArrayType(T.StringType()) for f in LISTS} | {"lucidity": T.BooleanType()}
    return T.StructType([T.StructField(f, kinds.get(f, T.StringType())) for f in FIELDS])


def normalize_lists(records: DataFrame) -> DataFrame:
    """Lists with white space collapsed, lower-cased but for names, without empty and repeated items."""
    return records.withColumns({f: text.ordered_distinct(F.col(f), fold=f != "named_characters") for f in LISTS})


def problems(fields: tuple[str, ...] = FIELDS) -> Column:
    """Problems of a typed record in field order, as an array of ``field: what``."""
    found = []
    for f in fields:
        c = F.col(f)
        if f in LISTS or f == "lucidity":
            found.append(F.when(c.isNull(), f"{f}: missing"))
        elif f in ENUMS:
            found.append(F.when(c.isNull(), f"{f}: missing").when(~text.compact(c).isin(*ENUMS[f]), f"{f}: not allowed"))
        else:
            found.append(F.when(c.isNull(), f"{f}: missing").when(F.trim(c) == "", f"{f}: empty"))
    if "lucidity" in fields and "lucidity_level" in fields:
        found.append(F.when(F.col("lucidity") != (F.col("lucidity_level") == "lucid"), "lucidity: contradicts lucidity_level"))
    return F.array_compact(F.array(*found))


def raw_problems(raw: Column) -> Column:
    """Fields that a raw JSON text lacks, and fields it has beyond the schema."""
    keys = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    want = F.array(*map(F.lit, FIELDS))
    return F.concat(F.transform(F.array_except(want, keys), lambda x: F.concat(x, F.lit(": missing"))), F.transform(F.array_except(keys, want), lambda x: F.concat(x, F.lit(": unexpected"))))


def kind_problems(raw: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    """Fields that a raw JSON text has with values of another kind: lists must hold texts only, no null."""
    record = F.try_parse_json(raw)

    def kind(v: Column) -> Column:
        return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))

    found = []
    for f in fields:
        v = F.try_variant_get(record, f"$.{f}", "variant")
        if f in LISTS:
            items = F.try_variant_get(record, f"$.{f}", "array<variant>")
            good = kind(v).startswith("ARRAY") & F.coalesce(F.forall(items, lambda x: kind(x) == "STRING"), F.lit(False))
            found.append(F.when(~good, f"{f}: not a list of texts"))
        else:
            want = "BOOLEAN" if f == "lucidity" else "STRING"
            found.append(F.when(kind(v) != want, f"{f}: not a {'truth value' if f == 'lucidity' else 'text'}"))
    keys = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    return F.filter(F.array_compact(F.array(*found)), lambda p: F.array_contains(keys, F.substring_index(p, ":", 1)))


def parse(raw: DataFrame, column: str) -> DataFrame:
    """Raw JSON texts as typed records with ``errors``; a record is good if ``errors`` is empty.

    Lists and texts are normalised. A value of a wrong kind is one error of its field, whatever else it would be.
    """
    rows = raw.withColumn("_r", F.from_json(column, schema())).select(*raw.columns, "_r.*")
    rows = normalize_lists(rows).withColumns({f: text.compact(F.col(f)) for f in (*ENUMS, *FREE)}).withColumn("_k", kind_problems(F.col(column)))
    wrong = F.transform("_k", lambda p: F.substring_index(p, ":", 1))
    rest = F.filter(problems(), lambda p: ~F.array_contains(wrong, F.substring_index(p, ":", 1)))
    bad = F.when(F.json_object_keys(F.col(column)).isNull(), F.array(F.lit("not a JSON object"))).otherwise(F.array_distinct(F.concat(raw_problems(F.col(column)), F.col("_k"), rest)))
    return rows.withColumn("errors", bad).drop("_k")


def pending(entries: DataFrame, records: DataFrame, keys: list[str], *, version: int = SCHEMA_VERSION, overwrite: bool = False) -> DataFrame:
    """Entries without a record of the current schema version; all of them if ``overwrite``."""
    return entries if overwrite else entries.join(records.filter(F.col("schema_version") == version).select(*keys).distinct(), keys, "left_anti")


def latest(records: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last record of each key."""
    row = F.struct(*[F.col(c) for c in records.columns])
    return records.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(row, F.col(order)).alias("r")).select("r.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Old records with the new ones in their place; of several for a key the last of the new ones."""
    n = latest(new, keys, order)
    return old.join(n.select(*keys), keys, "left_anti").select(*old.columns).unionByName(n.select(*old.columns))


def run_counts(statuses: DataFrame) -> DataFrame:
    """Rows by status: completed, failed, skipped."""
    return statuses.groupBy("status").agg(F.count("*").alias("records"))
