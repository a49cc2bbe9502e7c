"""What a labelling of vectors says: centroids, typical members, telling terms and tags, quality; and a clusterer."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold import runtime
from lumenfold.operators.graph import linked
from lumenfold.operators.retrieval import _matrix, dot, knn, normalized

NOISE = -1


def centroids(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """Mean of the members' unit vectors, of unit length again: ``<label>, centroid``."""
    rows = vectors.filter(F.col(vector).isNotNull() & (F.col(label) != NOISE)).select(label, normalized(F.col(vector)).alias("v"))
    return _means(rows, label).select(label, normalized(F.col("mean")).alias("centroid"))


def _means(rows: DataFrame, label: str, vector: str = "v") -> DataFrame:
    """``<label>, mean, n``: vectors are summed inside each task, one sum a label leaves it."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    s = rows.groupBy(label).agg(Summarizer.metrics("mean", "count").summary(array_to_vector(vector)).alias("s"))
    return s.select(label, vector_to_array("s.mean").alias("mean"), F.col("s.count").alias("n"))


def representatives(vectors: DataFrame, k: int = 3, *, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """The ``k`` members nearest to the centroid of each cluster, ties by key."""
    c, _ = runtime.stage(centroids(vectors, label, vector), "centroids")
    rows = vectors.filter(F.col(vector).isNotNull()).join(F.broadcast(c) if c.count() <= 10_000 else c, label)
    rows = rows.select(key, label, F.round(dot(normalized(F.col(vector)), F.col("centroid")), 9).alias("similarity"))
    w = Window.partitionBy(label).orderBy(F.desc("similarity"), key)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(label, "rank", key, F.round("similarity", 6).alias("similarity"))


def tag_lift(tagged: DataFrame, label: str = "label", tags: str = "tags", top: int = 5) -> DataFrame:
    """Tags of each cluster by share in the cluster over share in all rows (noise included); ties by count, then tag."""
    rows = tagged.select(label, F.array_distinct(F.coalesce(tags, F.array().cast("array<string>"))).alias("t"))
    total = rows.count()
    size = rows.groupBy(label).agg(F.count("*").alias("size"))
    one = rows.select(label, F.explode("t").alias("tag")).filter(F.col("tag").isNotNull())
    here = one.groupBy(label, "tag").agg(F.count("*").alias("n"))
    every = here.groupBy("tag").agg(F.sum("n").alias("all"))
    lift = F.col("n") / F.col("size") / (F.col("all") / F.lit(float(max(1, total))))
    out = here.join(size, label).join(every, "tag").filter(F.col(label) != NOISE).select(label, "tag", "n", F.round(lift, 6).alias("lift"))
    w = Window.partitionBy(label).orderBy(F.desc("lift"), F.desc("n"), "tag")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def term_weights(docs: DataFrame, key: str, text: str, *, least_docs: int = 2, most_share: float = 0.9, stop_words: list[str] | None = None) -> DataFrame:
    """TF-IDF of single words and pairs with smoothed idf and length 1 a document: ``<key>, term, weight``."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)), lambda x: ~x.isin(stop_words or []))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i)))
    rows = docs.select(key, words.alias("w")).select(key, F.explode(F.concat(F.col("w"), F.when(F.size("w") > 1, pairs).otherwise(F.array().cast("array<string>")))).alias("term"))
    tf = rows.groupBy(key, "term").agg(F.count("*").alias("tf"))
    n = docs.count()
    df = tf.groupBy("term").agg(F.count("*").alias("df")).filter((F.col("df") >= least_docs) & (F.col("df") <= most_share * n))
    raw = tf.join(df, "term").select(key, "term", (F.col("tf") * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0)).alias("w"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def distinctive_terms(weights: DataFrame, labels: DataFrame, *, key: str, label: str, top: int = 8) -> DataFrame:
    """Terms whose mean weight in a cluster is furthest above their mean over all documents; ties by term."""
    n_all = labels.count()
    size = labels.groupBy(label).agg(F.count("*").alias("size"))
    rows = weights.join(labels.select(key, label), key)
    here = rows.groupBy(label, "term").agg(F.sum("weight").alias("s"))
    every = here.groupBy("term").agg(F.sum("s").alias("a"))
    gain = F.round(F.col("s") / F.col("size") - F.col("a") / F.lit(float(max(1, n_all))), 9)
    out = here.join(every, "term").join(size, label).select(label, "term", gain.alias("gain")).filter((F.col("gain") > 0) & (F.col(label) != NOISE if dict(labels.dtypes)[label] != "string" else F.lit(True)))
    w = Window.partitionBy(label).orderBy(F.desc("gain"), "term")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select(label, "rank", "term", F.round("gain", 6).alias("gain"))


def quality(vectors: DataFrame, *, key: str = "vec_id", label: str = "label", vector: str = "embedding", block_mb: float = 64) -> DataFrame:
    """Rows, clusters, share of noise, and the cosine silhouette over the others.

    With unit vectors the mean distance of a row to a cluster is 1 minus its product with the mean of the cluster, so
    that one vector a cluster stands for all pairs. These are broadcast in blocks of at most ``block_mb``; a batch of rows
    is multiplied with a block.
    """
    rows, _ = runtime.stage(vectors.filter(F.col(vector).isNotNull()).select(key, label, normalized(F.col(vector)).alias("v")), "units")
    counts = rows.agg(F.count("*").alias("points"), F.count_if(F.col(label) == NOISE).alias("noise"), F.countDistinct(F.when(F.col(label) != NOISE, F.col(label))).alias("clusters"))
    good = rows.filter(F.col(label) != NOISE)
    means, _ = runtime.stage(_means(good, label), "means")
    many, dims = means.agg(F.count("*"), F.max(F.size("mean"))).first()
    blocks = max(1, math.ceil((many or 0) * (8 * (dims or 0) + 16) / (block_mb * (1 << 20))))
    near = None
    for b in range(blocks):
        part = (means if blocks == 1 else means.filter(F.pmod(F.xxhash64(label), F.lit(blocks)) == b)).toArrow()  # at most block_mb
        block = rows.sparkSession.sparkContext.broadcast((part.column(label).to_numpy(), part.column("n").to_numpy(), part.column("mean").combine_chunks() if part.num_rows else None))
        found = good.select(label, "v", key).mapInArrow(_distances(block), f"`{key}` {vectors.schema[key].dataType.simpleString()}, a double, b double")
        near = found if near is None else near.unionAll(found)
    if blocks > 1:
        near = near.groupBy(key).agg(F.max("a").alias("a"), F.min("b").alias("b"))
    width = F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    s = near.agg(F.round(F.avg(width), 6).alias("s"))
    silhouette = F.when((F.col("clusters") > 1) & (F.col("points") - F.col("noise") > F.col("clusters")), F.col("s"))
    return counts.join(F.broadcast(s)).select("points", "clusters", F.round(F.col("noise") / F.greatest("points", F.lit(1)), 6).alias("noise_share"), silhouette.alias("silhouette"))


def _distances(block):
    """Mean distance of each row to the others of its cluster (null if there are none), and the least one to another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        names, n, means = block.value
        for batch in batches:
            if not batch.num_rows or means is None:
                continue
            x, c = _matrix(batch.column(1)), _matrix(means)
            p = x @ c.T
            own = batch.column(0).to_numpy()[:, None] == names[None]
            a = np.where(own & (n > 1), 1 - (p * n - 1) / np.maximum(n - 1, 1), -np.inf).max(axis=1)
            b = np.where(own, np.inf, 1 - p).min(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(a, mask=np.isinf(a)), pa.array(b, mask=np.isinf(b))], ["key", "a", "b"])

    return run


def automatic_label(tags: list[str], terms: list[str]) -> str:
    """The first two tags and three terms, each once."""
    return ", ".join(dict.fromkeys([*tags[:2], *terms[:3]])) or "unlabelled"


def principal_components(vectors: DataFrame, k: int, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Scores on the first ``k`` principal components of the centred unit vectors: ``<key>, scores``."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.filter(F.col(vector).isNotNull()).select(key, array_to_vector(normalized(F.col(vector))).alias("_v"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(rows).transform(rows)
    return PCA(k=k, inputCol="_c", outputCol="_p").fit(centred).transform(centred).select(key, vector_to_array("_p").alias("scores"))


def density_clusters(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", cut: float = 0.4, core: int = 5, least_size: int = 5, near: int = 15) -> DataFrame:
    """Density clusters: ``<key>, cluster``, -1 for noise.

    The core distance of a row is that to its ``core``-th neighbour (one minus the cosine); rows are linked where the
    mutual reachability (the largest of both core distances and their distance) is at most ``cut``, among the ``near``
    nearest of each; components of at least ``least_size`` rows are clusters, numbered by their smallest key. This is the
    hierarchy of a density clusterer cut at one level. Keys must be whole numbers; null vectors are left out.
    """
    rows = vectors.filter(F.col(vector).isNotNull()).select(key, vector)
    hits, _ = runtime.stage(knn(rows, rows, max(near, core), key=key, vector=vector, measure="cosine"), "near")
    cores = hits.filter(F.col("rank") == core).select(F.col("query_id").alias("_k"), (1 - F.col("score")).alias("_c"))
    pairs = hits.join(cores.select(F.col("_k").alias("query_id"), F.col("_c").alias("_a")), "query_id").join(cores.select(F.col("_k").alias(key), F.col("_c").alias("_b")), key)
    edges = pairs.filter(F.round(F.greatest("_a", "_b", 1 - F.col("score")), 9) <= cut).select(F.col("query_id").cast("long").alias("a"), F.col(key).cast("long").alias("b"))
    root = linked(edges, "density")
    large = root.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") >= least_size).select("root", F.col("root").alias("cluster"))
    of = root.join(large, "root").select(F.col("node").alias("_n"), "cluster")
    return rows.join(of, rows[key] == of["_n"], "left").select(key, F.coalesce("cluster", F.lit(NOISE)).alias("cluster"))


def cluster(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", dims: int = 16, groups: int = 10, least_size: int = 5, cut: float = 0.995, seed: int = 42) -> DataFrame:
    """A stand-in for density clustering: bisecting k-means on principal components; rows beyond the ``cut`` quantile of
    the distance to their centre, and clusters below ``least_size``, are noise (-1). With the first two components as a
    map. The labels are not those of a density method."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    scores = principal_components(vectors, dims, key=key, vector=vector).withColumn("_f", array_to_vector("scores"))
    model = BisectingKMeans(k=groups, seed=seed, featuresCol="_f", predictionCol="cluster").fit(scores)
    centres = scores.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, _c array<double>")
    d2 = F.aggregate(F.zip_with("scores", "_c", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    rows = model.transform(scores).join(F.broadcast(centres), "cluster").withColumn("_d", d2)
    limits = rows.groupBy("cluster").agg(F.percentile_approx("_d", cut).alias("_l"), F.count("*").alias("_n"))
    rows = rows.join(F.broadcast(limits), "cluster")
    lost = (F.col("_d") > F.col("_l")) | (F.col("_n") < least_size)
    return rows.select(key, F.when(lost, NOISE).otherwise(F.col("cluster")).alias("cluster"), F.round(F.get("scores", 0), 6).alias("x"), F.round(F.get("scores", 1), 6).alias("y"))
