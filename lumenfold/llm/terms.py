"""Frequency of every distinct term (radix partitioning, DuckDB per leaf) and co-occurrence of terms (stripes)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold import runtime

#: White space as ``str.isspace`` sees it, for Java's regex engine.
SPACE = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x1c-\x1f]"


def normal_term(c: Column) -> Column:
    """Outer blanks removed, inner blanks collapsed, lower-cased, leading ``#`` removed."""
    c = F.trim(F.regexp_replace(F.lower(c), f"{SPACE}+", " "))
    return F.trim(F.regexp_replace(c, "^[# ]+", ""))


def normal_terms(c: Column) -> Column:
    """Sorted normal terms of a list; null lists, null items and blank items give none."""
    return F.array_sort(F.filter(F.transform(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull()), normal_term), lambda x: x != ""))


def _duck(folder: str, memory_mb: int):
    """DuckDB that spills to the shared folder; where that is no mounted one, it keeps to its memory and does not spill."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"SET threads=1; SET memory_limit='{memory_mb}MB'; SET preserve_insertion_order=false")
    con.execute(f"SET temp_directory='{folder if folder.startswith('/') else ''}'")
    return con


def _local(path: str) -> str:
    return path[5:].replace("//", "/", 1) if path.startswith("file:") else path


def term_frequencies(df: DataFrame, fields: list[str], *, bits: int = 6, leaf_mb: int = 256, max_depth: int = 5, memory_mb: int = 256, combine_rows: int = 1_000_000) -> DataFrame:
    """Occurrences and records of each distinct term of the list columns ``fields``.

    Recursive radix spilling: every scan task combines its own repeats, some ``combine_rows`` items at a time, so that a
    hot term leaves it once for that many; the terms are written by the first hash bits to the shared folder, a few files
    a bucket. Parts above ``leaf_mb`` are written again by the next bits. Each leaf is then aggregated by one DuckDB
    process that spills to the shared folder (if that is no mounted folder, leaves are smaller and fit its memory).

    Null lists, empty lists, null and blank items count as records without terms; an item repeated in one record
    adds occurrences but one record; no rows give no terms; other columns are not read.
    Result: ``field, term, occurrences, records``.
    """
    spark = df.sparkSession
    root = runtime.new_path(spark, "radix")
    spill = _local(f"{root}-spill")
    fan = 1 << bits
    parts = []
    for f in fields:
        terms = normal_terms(F.col(f"`{f}`"))
        # a term is the first of its run in the sorted list, or a repeat in the same record
        marked = F.transform(terms, lambda x, i: F.struct(x.alias("term"), F.when(i == 0, 1).when(F.get(terms, i - 1) == x, 0).otherwise(1).alias("one")))
        parts.append(df.select(F.lit(f).alias("field"), F.explode(marked).alias("t")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.select("field", "t.term", F.xxhash64("field", "t.term").alias("h"), F.lit(1).cast("long").alias("occurrences"), F.col("t.one").cast("long").alias("records"))

    if not spill.startswith("/"):
        leaf_mb = min(leaf_mb, memory_mb // 4)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            con = _duck(spill, memory_mb)
            src = pa.Table.from_batches(held)  # noqa: F841
            yield from con.sql("SELECT field, term, h, CAST(sum(occurrences) AS BIGINT) AS occurrences, CAST(sum(records) AS BIGINT) AS records FROM src GROUP BY field, term, h").to_arrow_reader(50_000)
            con.close()

        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) >= combine_rows:
                yield from out()
                held.clear()
        if held:
            yield from out()

    schema = "field string, term string, h long, occurrences long, records long"
    level = f"{root}/0"
    # some files a bucket, by higher bits, instead of one for each scan task
    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // fan)

    def spread(df: DataFrame) -> None:
        df.repartition(F.col("bucket"), F.pmod(F.shiftrightunsigned(F.col("h"), 48), F.lit(files))).write.partitionBy("bucket").parquet(level)

    spread(rows.mapInArrow(combine, schema).withColumn("bucket", F.col("h").bitwiseAND(F.lit(fan - 1)).cast("int")))
    leaves: list[str] = []
    pending = runtime.sizes(spark, level)
    for depth in range(1, max_depth + 1):
        big = [p for p, n in pending.items() if n > leaf_mb << 20]
        leaves += [p for p, n in pending.items() if n <= leaf_mb << 20]
        if not big or depth == max_depth:
            leaves += big  # DuckDB spills them
            break
        level = f"{root}/{depth}"
        deeper = F.shiftrightunsigned(F.col("h"), depth * bits).bitwiseAND(F.lit(fan - 1)).cast("int")
        parent = F.regexp_replace(F.input_file_name(), r".*bucket=([0-9_]+)/[^/]*$", "$1")
        spread(spark.read.schema(schema).parquet(*big).withColumn("bucket", F.concat_ws("_", parent, deeper)))
        pending = runtime.sizes(spark, level)

    def aggregate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds
        import pyarrow.fs as pfs

        for b in batches:
            for leaf in b.column(0).to_pylist():
                if leaf.startswith("file:"):
                    fs, where = pfs.LocalFileSystem(), _local(leaf)
                else:
                    fs, where = pfs.FileSystem.from_uri(leaf)
                src = ds.dataset(where, filesystem=fs, format="parquet", exclude_invalid_files=False).scanner(columns=["field", "term", "occurrences", "records"], batch_size=50_000).to_reader()  # noqa: F841
                con = _duck(spill, memory_mb)
                out = con.sql("SELECT field, term, CAST(sum(occurrences) AS BIGINT) AS occurrences, CAST(sum(records) AS BIGINT) AS records FROM src GROUP BY field, term")
                yield from out.to_arrow_reader(50_000)
                con.close()

    result = "field string, term string, occurrences long, records long"
    if not leaves:
        return spark.createDataFrame([], result)
    tasks = min(len(leaves), max(1, 2 * spark.sparkContext.defaultParallelism))
    return spark.createDataFrame([(p,) for p in leaves], "leaf string").repartition(tasks).mapInArrow(aggregate, result)


def mark_terms(freq: DataFrame, records: int, *, min_records: int = 3, max_share: float = 0.2) -> DataFrame:
    """Add ``verdict``: ``rare`` below ``min_records``, ``common`` above ``max_share`` of ``records``, else null."""
    return freq.withColumn("verdict", F.when(F.col("records") < min_records, "rare").when(F.col("records") > max_share * records, "common"))


def _pair_steps(rows, m: int, most: int):
    """Index pairs (i <= j) of records of ``m`` items that begin at ``rows``, at most about ``most`` at a time."""
    import numpy as np

    if m * (m + 1) // 2 <= most:
        i, j = np.triu_indices(m)
        step = max(1, most // len(i))
        for s in range(0, len(rows), step):
            yield rows[s : s + step, None], i, j
        return
    for r in rows:  # a record of very many items goes by rows of its triangle
        a = 0
        while a < m:
            b = min(m, a + max(1, most // m))
            i = np.repeat(np.arange(a, b), m - np.arange(a, b))
            j = np.concatenate([np.arange(x, m) for x in range(a, b)])
            for s in range(0, len(i), most):
                yield np.array([[r]]), i[s : s + most], j[s : s + most]
            a = b


def cooccurrence(df: DataFrame, field: str, *, flush: int = 500_000, segments: int = 4) -> DataFrame:
    """Every pair of different terms that stand in one record, with counts, lift and log-likelihood ratio.

    Stripes: a scan task keeps one associative array of neighbours per item and sends it on, split by a hash of the
    neighbour into ``segments`` so that the array of a hot item is never one row; arrays of a key are then merged.
    The stripe of an item also holds the item itself, which gives its own number of records.

    Records with null or empty lists count in ``n_records`` only; repeats in one record count once; no rows, no pairs.
    Result: ``field, item_a, item_b, n, n_a, n_b, n_records, lift, llr`` with item_a < item_b by code point.
    """
    import numpy as np

    total = df.count()

    def stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        words: dict[str, int] = {}
        names: list[str] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def squeeze() -> tuple[np.ndarray, np.ndarray]:
            code, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            return code, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

        def emit():
            code, n = squeeze()
            a, b = code >> 32, code & 0xFFFFFFFF
            seg = np.array([zlib.crc32(names[x].encode()) % segments for x in range(len(names))])[b]
            order = np.lexsort((b, seg, a))
            a, b, seg, n = a[order], b[order], seg[order], n[order]
            cut = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (seg[1:] != seg[:-1])])
            off = pa.array(np.r_[cut, len(a)], pa.int32())
            look = pa.array(names)
            near = pa.ListArray.from_arrays(off, look.take(pa.array(b)))
            rows = pa.RecordBatch.from_arrays([look.take(pa.array(a[cut])), pa.array(seg[cut], pa.int32()), near, pa.ListArray.from_arrays(off, pa.array(n))], ["item", "seg", "near", "n"])
            for s in range(0, rows.num_rows, 2000):
                yield rows.slice(s, 2000)

        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten().to_pylist()
            lens = np.diff(lists.offsets.to_numpy())
            for w in flat:
                if w not in words:
                    words[w] = len(names)
                    names.append(w)
            code = np.fromiter((words[w] for w in flat), np.int64, len(flat))
            start = np.r_[0, np.cumsum(lens)][:-1]
            for m in np.unique(lens):
                if not m:
                    continue
                rows = start[lens == m]
                for r, i, j in _pair_steps(rows, int(m), 1_000_000):
                    c, n = np.unique((code[r + i] << 32) | code[r + j], return_counts=True)
                    held.append((c.ravel(), n))
                    if sum(len(c) for c, _ in held) > flush:
                        held = [squeeze()]
                        if len(held[0][0]) > flush // 2:
                            yield from emit()
                            held, words, names = [], {}, []
                            # the codes of this batch stay valid only with their names
                            for w in flat:
                                if w not in words:
                                    words[w] = len(names)
                                    names.append(w)
                            code = np.fromiter((words[w] for w in flat), np.int64, len(flat))
        if held:
            yield from emit()

    lists = df.select(F.array_distinct(normal_terms(F.col(f"`{field}`"))).alias("t")).filter(F.size("t") > 0)
    sent = lists.mapInArrow(stripes, "item string, seg int, near array<string>, n array<long>")
    # stripes of a key meet in one task and are merged there by the JVM's aggregate, which spills; no further shuffle
    pairs = sent.repartition("item", "seg").select("item", "seg", F.explode(F.arrays_zip("near", "n")).alias("x")).groupBy("item", "seg", F.col("x.near").alias("near")).agg(F.sum("x.n").alias("n"))
    pairs, _ = runtime.stage(pairs.select("item", "near", "n"), "stripes")
    own = pairs.filter(F.col("item") == F.col("near")).select(F.col("item").alias("own"), F.col("n").alias("n_own"))
    out = pairs.filter(F.col("item") != F.col("near")).select(F.col("item").alias("item_a"), F.col("near").alias("item_b"), "n")
    out = out.join(own.select(F.col("own").alias("item_a"), F.col("n_own").alias("n_a")), "item_a").join(own.select(F.col("own").alias("item_b"), F.col("n_own").alias("n_b")), "item_b")
    big = F.lit(float(total))
    k11, k12, k21 = F.col("n").cast("double"), (F.col("n_a") - F.col("n")).cast("double"), (F.col("n_b") - F.col("n")).cast("double")
    k22 = big - k11 - k12 - k21

    def xlx(x: Column) -> Column:
        return F.when(x > 0, x * F.log(x)).otherwise(0.0)

    llr = 2 * (xlx(k11) + xlx(k12) + xlx(k21) + xlx(k22) + xlx(big) - xlx(k11 + k12) - xlx(k21 + k22) - xlx(k11 + k21) - xlx(k12 + k22))
    return out.select(F.lit(field).alias("field"), "item_a", "item_b", "n", "n_a", "n_b", F.lit(total).cast("long").alias("n_records"), (k11 * big / (F.col("n_a") * F.col("n_b"))).alias("lift"), F.greatest(F.lit(0.0), llr).alias("llr"))
