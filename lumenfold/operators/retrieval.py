"""Exact nearest neighbours, thresholds, fusion of ranked lists, and the text that is built from hits."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold import runtime


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of vectors of one length; 0 if one is all zero; an error if lengths differ."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    checked = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double"))
    return checked.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalized(a: Column) -> Column:
    """Vector of length one, zeros if all are zero; its length is taken once, not for each element."""
    long = let(a, lambda v: F.struct(v.alias("v"), F.sqrt(dot(v, v)).alias("n")))
    return let(long, lambda p: F.transform(p["v"], lambda x: F.when(p["n"] == 0, 0.0).otherwise(x.cast("double") / p["n"])))


def check_model(collections: DataFrame, name: str, model: str) -> None:
    """Error unless the collection is known and was embedded by ``model``."""
    got = collections.filter(F.col("collection_name") == name).select("embedding_model").limit(1).collect()
    if not got:
        raise ValueError(f"collection {name} is unknown")
    if got[0][0] != model:
        raise ValueError(f"collection {name} was embedded by {got[0][0]}, not {model}")


def knn(corpus: DataFrame, queries: DataFrame, k: int, *, key: str = "vec_id", vector: str = "embedding", measure: str = "l2", drop_self: bool = True, block_mb: float = 64) -> DataFrame:
    """The ``k`` nearest rows of the corpus for each query: ``query_id, <key>, score, rank``.

    ``l2`` is the squared distance, ``cosine`` the similarity (0 with a vector of zeros); rounded to 9 digits before
    ranking, ties by key. The queries are broadcast in blocks of at most ``block_mb``, lengths known; each task multiplies
    a batch of the corpus with a block and keeps the best k of each query before the shuffle. Null vectors are neither
    queries nor answers; vectors of different lengths are an error.
    """
    hits = _scored(corpus, queries, k, None, key, vector, measure, drop_self, block_mb)
    w = Window.partitionBy("query_id").orderBy(F.asc("score") if measure == "l2" else F.desc("score"), key)
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _scored(corpus: DataFrame, queries: DataFrame, k: int | None, least: float | None, key: str, vector: str, measure: str, drop_self: bool, block_mb: float) -> DataFrame:
    """Candidates of each query: the best ``k`` of each task, or all of a score of ``least``."""
    spark = corpus.sparkSession
    runtime.ship(spark)
    q = queries.filter(F.col(vector).isNotNull()).select(F.col(key).alias("query_id"), F.col(vector).cast("array<double>").alias("_q"))
    n, dims = q.agg(F.count("*"), F.max(F.size("_q"))).first()
    blocks = max(1, math.ceil((n or 0) * (8 * (dims or 0) + 32) / (block_mb * (1 << 20))))
    c = corpus.filter(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("_v"))
    kind = corpus.schema[key].dataType.simpleString()
    out = None
    for b in range(blocks):
        got = (q if blocks == 1 else q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow()  # at most block_mb
        block = spark.sparkContext.broadcast((got.column("query_id").to_pylist(), got.column("_q").combine_chunks() if got.num_rows else None))
        part = c.mapInArrow(_ranker(block, k, least, measure, drop_self), f"query_id {queries.schema[key].dataType.simpleString()}, `{key}` {kind}, score double")
        out = part if out is None else out.unionAll(part)
    return out


def _matrix(column: pa.Array, dims: int | None = None):
    import numpy as np

    lengths = np.diff(column.offsets.to_numpy())
    dims = int(lengths[0]) if dims is None and len(lengths) else dims
    if len(lengths) and (lengths != dims).any():
        raise ValueError("vectors differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(lengths), dims or 0)


def _ranker(block, k: int | None, least: float | None, measure: str, drop_self: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        ids, vectors = block.value
        if vectors is None:
            return
        y = _matrix(vectors)
        ids_at = {v: i for i, v in enumerate(ids)}
        y2 = np.einsum("ij,ij->i", y, y)
        best: tuple = ()
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.array(batch.column(0).to_pylist(), object)
            x = _matrix(batch.column(1), y.shape[1])
            x2 = np.einsum("ij,ij->i", x, x)
            for s in range(0, len(x), max(1, 4_000_000 // len(y))):
                z = slice(s, s + max(1, 4_000_000 // len(y)))
                p = y @ x[z].T
                if measure == "l2":
                    near = y2[:, None] + x2[z][None] - 2 * p
                else:
                    n = np.sqrt(y2)[:, None] * np.sqrt(x2[z])[None]
                    near = np.where(n == 0, 0.0, p / np.where(n == 0, 1, n))
                good = np.ones(near.shape, bool)
                if drop_self:
                    for j, v in enumerate(keys[z]):
                        if v in ids_at:
                            good[ids_at[v], j] = False
                if least is not None:
                    good &= np.round(near, 9) >= least
                elif near.shape[1] > k:  # with all that may tie, and one for the row itself
                    rank = near if measure == "l2" else -near
                    limit = np.partition(np.where(good, rank, np.inf), k - 1, axis=1)[:, k - 1]
                    good &= rank <= limit[:, None] + 1e-8
                q, c = np.nonzero(good)
                if measure == "l2":  # exactly, for the few that are left
                    d = y[q] - x[z][c]
                    score = np.round(np.einsum("ij,ij->i", d, d), 9)
                else:
                    score = np.round(near[q, c], 9)
                found = (q, keys[z][c], score)
                if least is not None:
                    yield _hits(ids, found, batch.schema.field(0).type)
                    continue
                best = tuple(np.concatenate(v) for v in zip(best, found)) if best else found
                if len(best[0]) > 4 * k * len(y) + 100_000:
                    best = _first(best, k, measure)
            kind = batch.schema.field(0).type
        if best:
            yield _hits(ids, _first(best, k, measure), kind)

    return run


def _first(hits: tuple, k: int, measure: str) -> tuple:
    """The best ``k`` of each query by score, then key."""
    import numpy as np

    q, keys, score = hits
    by_key = np.empty(len(keys), np.int64)
    by_key[sorted(range(len(keys)), key=lambda i: keys[i])] = np.arange(len(keys))
    o = np.lexsort((by_key, score if measure == "l2" else -score, q))
    new = np.flatnonzero(np.r_[True, q[o][1:] != q[o][:-1]]) if len(o) else np.zeros(0, int)
    place = np.arange(len(o)) - np.repeat(new, np.diff(np.r_[new, len(o)]))
    o = o[place < k]
    return q[o], keys[o], score[o]


def _hits(ids: list, found: tuple, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in found[0]]) if len(found[0]) else pa.array([], pa.null()).cast(kind), pa.array(list(found[1]), kind), pa.array(found[2], pa.float64())], ["query_id", "key", "score"])


def related(corpus: DataFrame, queries: DataFrame, threshold: float, *, key: str = "vec_id", vector: str = "embedding", most: int | None = None) -> DataFrame:
    """All other rows with a cosine of at least ``threshold``, best first; at most ``most`` a query if that is given."""
    if not -1 <= threshold <= 1:
        raise ValueError("threshold must lie between -1 and 1")
    if most is not None and most < 0:
        raise ValueError("the number of related rows must not be negative")
    if most == 0:
        return knn(corpus, queries, 1, key=key, vector=vector, measure="cosine").limit(0)
    if most is not None:  # the best ones, of which those below the threshold fall away
        return knn(corpus, queries, most, key=key, vector=vector, measure="cosine").filter(F.col("score") >= threshold)
    hits = _scored(corpus, queries, None, threshold, key, vector, "cosine", True, 64)
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key)))


def fuse(hits: DataFrame, *, by: str, query: str, key: str, most: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of the lists of several queries: ``<by>, <key>, fused, best, matched, place``.

    Each list adds 1 / (constant + rank); order by the sum, the least distance, the key.
    """
    a = hits.groupBy(by, key).agg(F.sum(1.0 / (constant + F.col("rank"))).alias("s"), F.min("score").alias("best"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(query, "rank"))), lambda x: F.concat_ws(":", x[query].cast("string"), x["rank"].cast("string"))), ",").alias("matched"))
    w = Window.partitionBy(by).orderBy(F.desc(F.round("s", 12)), "best", key)
    return a.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select(by, key, F.round("s", 8).alias("fused"), F.round("best", 6).alias("best"), "matched", "place")


def pooled(lists: list[DataFrame], *, query: str, key: str, values: list[str] | None = None) -> DataFrame:
    """Union of several hit lists without repeats, in an order that tells nothing: by SHA-256 of query and key. ``values``
    are kept from the last list that has the key."""
    kept = values or []
    every = reduce(DataFrame.unionByName, [x.select(query, key, F.struct(F.lit(i).alias("_list"), *kept).alias("_v")) for i, x in enumerate(lists)])
    every = every.groupBy(query, key).agg(F.max_by("_v", "_v._list").alias("_v")).select(query, key, *[F.col(f"_v.{c}").alias(c) for c in kept])
    digest = F.sha2(F.concat(F.col(query).cast("string"), F.lit("\0"), F.col(key).cast("string")), 256)
    w = Window.partitionBy(query).orderBy("digest")
    return every.withColumn("digest", digest).withColumn("place", F.row_number().over(w))


def rank_context(hits: DataFrame, documents: DataFrame, *, query: str, key: str, text: str, most_chars: int = 2500, date: str | None = None, score: str | None = None) -> DataFrame:
    """Context of each query: its hits in order of rank, each cut to ``most_chars``, between rules; below the key the
    column ``date`` of the documents and ``score`` of the hits, if they are named."""
    cut = F.when(F.length(text) > most_chars, F.concat(F.substring(text, 1, most_chars), F.lit("\n[TRUNCATED]"))).otherwise(F.col(text))
    more = [F.concat(F.lit("DATE: "), F.coalesce(F.col(date).cast("string"), F.lit("")))] if date else []
    more += [F.concat(F.lit("SCORE: "), F.format_string("%.4f", F.col(score).cast("double")))] if score else []
    part = F.concat_ws("\n", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col(key).cast("string")), *more, F.coalesce(cut, F.lit("")))
    rows = hits.join(documents.select(key, text, *([date] if date else [])), key).select(query, "rank", part.alias("part"))
    return rows.groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda x: x["part"]), "\n\n---\n\n").alias("context"))


def matrix(hits_by_index: dict[str, DataFrame], models: list[str], *, query: str, key: str) -> DataFrame:
    """Every index with every model; the hits of an index are found once and shared."""
    spark = next(iter(hits_by_index.values())).sparkSession
    parts = [h.groupBy(F.lit(name).alias("index_name"), query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", key))), lambda x: x[key].cast("string")), ",").alias("hits")) for name, h in hits_by_index.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every, _ = runtime.stage(every, "matrix")
    del spark
    return every.select(F.explode(F.array(*map(F.lit, models))).alias("model"), "index_name", query, "hits")


def embedding_for(target: DataFrame, index: DataFrame, embed, *, key: str, text: str) -> DataFrame:
    """Stored vector of each target, else the one that ``embed`` (a Column function) makes of its text."""
    return target.join(index.select(key, F.col("embedding").alias("_stored")), key, "left").withColumn("embedding", F.coalesce("_stored", embed(F.col(text)))).drop("_stored")
