"""Nearest vectors by additive quantisation, and groups of similar vectors by neighbour descent and modularity."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold import runtime
from lumenfold.operators.graph import linked

SHAPE = ("vec_no", "collection_name", "embedding")


def of_length(vectors: DataFrame, dims: dict[str, int]) -> DataFrame:
    """Rows whose embedding has the length of its collection, is finite and not all zero (null items: see matrix)."""
    if not dims:
        return vectors.filter(F.lit(False))
    known = F.create_map(*[F.lit(x) for kv in dims.items() for x in kv])
    top, low = F.array_max("embedding"), F.array_min("embedding")
    inf = float("inf")
    sound = ~F.isnan(top) & (top < inf) & (low > -inf) & ((top != 0) | (low != 0))
    return vectors.filter((F.size("embedding") == F.try_element_at(known, F.col("collection_name"))) & sound)


def matrix(column: pa.Array, dim: int):
    """Float32 matrix of a list column, and which rows are usable (finite, not all zero)."""
    import numpy as np

    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)
    return x, np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)


def unit(x):
    """Rows of length one, the length taken in double precision."""
    import numpy as np

    big = np.abs(x).max(axis=1, keepdims=True)
    y = x / np.where(big > 0, big, 1)
    return (y / np.sqrt(np.einsum("ij,ij->i", y, y, dtype=np.float64))[:, None]).astype(np.float32)


def cosine64(x, y):
    """Cosine of rows in double precision; the same for equal rows wherever they stand."""
    import numpy as np

    a, b = x.astype(np.float64), y.astype(np.float64)
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def by_dim(batch: pa.RecordBatch, dims: dict[str, int], column: str = "embedding"):
    """Parts of a batch by collection: (name, row numbers, matrix) of the usable rows."""
    import numpy as np

    name = batch.column("collection_name")
    code = name.dictionary_encode() if not pa.types.is_dictionary(name.type) else name
    ids = code.indices.to_numpy(zero_copy_only=False)
    for i, c in enumerate(code.dictionary.to_pylist()):
        rows = np.flatnonzero(ids == i)
        if c in dims and len(rows):
            x, good = matrix(batch.column(column).take(pa.array(rows)), dims[c])
            yield c, rows[good], x[good]


def sample(vectors: DataFrame, name: str, dim: int, most: int, total: int):
    """At most about ``most`` usable vectors of a collection, chosen by a hash of the key."""
    share = min(1.0, most / max(1, total))
    pick = F.pmod(F.xxhash64(F.lit("sample"), "vec_no"), F.lit(1 << 30)) < int(share * (1 << 30))
    got = vectors.filter((F.col("collection_name") == name) & pick).select("embedding").limit(2 * most).toArrow()
    if not got.num_rows:
        return matrix(pa.array([], pa.list_(pa.float32())), dim)[0]
    x, good = matrix(got.column("embedding").combine_chunks(), dim)
    return x[good]


def fixed(x) -> pa.Array:
    """Rows of a matrix as binary values, without a loop over them."""
    import numpy as np

    x = np.ascontiguousarray(x)
    ends = (np.arange(len(x) + 1) * (x.shape[1] * x.itemsize)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x)])


# --- additive quantisation -------------------------------------------------------------------------------------


def _means(x, k: int, rounds: int, rng):
    """k-means; empty cells take random points."""
    import numpy as np

    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        a = (x @ c.T - 0.5 * np.einsum("ij,ij->i", c, c)).argmax(axis=1)
        one = np.zeros((k, len(x)), np.float32)
        one[a, np.arange(len(x))] = 1
        n = one.sum(axis=1)
        c = (one @ x) / np.maximum(n, 1)[:, None]
        lost = np.flatnonzero(n == 0)
        c[lost] = x[rng.choice(len(x), len(lost))]
    return c


def train_books(x, lists: int, books: int = 10, words: int = 256, rounds: int = 6, seed: int = 7, second: int = 256) -> list:
    """Full-dimensional codebooks, each fitted to what the ones before it leave; the first one (or two) names the lists."""
    import numpy as np

    rng = np.random.default_rng(seed)
    left, out = x.copy(), []
    for m in range(books):
        own = left if m < 2 else left[rng.choice(len(left), min(len(left), 60 * words), replace=False)]  # 60 rows a word
        c = _means(own, lists if m == 0 else second if m == 1 else words, rounds, rng)
        out.append(c.astype(np.float32))
        left = left - c[(left @ c.T - 0.5 * np.einsum("ij,ij->i", c, c)).argmax(axis=1)]
    return out


def encode(x, books: list, beam: int = 2):
    """Beam search over the codebooks: codes (rows x books) and the length of each sum of words.

    The first word is the nearest one, as it names the list; each later step keeps the ``beam`` best sums.
    """
    import numpy as np

    n, d = x.shape
    rows = np.arange(n)[:, None]
    first = (x @ books[0].T - 0.5 * np.einsum("ij,ij->i", books[0], books[0])).argmax(axis=1)
    codes = first[:, None, None]
    left = (x - books[0][first])[:, None, :]
    for c in books[1:]:
        cost = np.einsum("ij,ij->i", c, c) - 2 * (left.reshape(-1, d) @ c.T)
        cost += np.einsum("ij,ij->i", left.reshape(-1, d), left.reshape(-1, d))[:, None]
        cost = cost.reshape(n, -1)
        top = np.empty((n, min(beam, cost.shape[1])), np.int64)
        for b in range(top.shape[1]):  # one minimum after the other: few are wanted
            top[:, b] = cost.argmin(axis=1)
            cost[rows[:, 0], top[:, b]] = np.inf
        at, word = top // len(c), top % len(c)
        left = left[rows, at] - c[word]
        codes = np.concatenate([codes[rows, at], word[:, :, None]], axis=2)
    best = np.einsum("ijk,ijk->ij", left, left).argmin(axis=1)
    total = x - left[rows[:, 0], best]
    return codes[rows[:, 0], best], np.sqrt(np.einsum("ij,ij->i", total, total))


def _fit_lists(x, lists: int, books: int, n: int, list_rows: int, first_words: int):
    """Codebooks of a sample of unit rows, how many words name a list, and into how many parts each list is cut."""
    import numpy as np

    two = min(256, lists // first_words) if lists > first_words else 1  # then the second word names the list as well
    trained = train_books(x, min(lists, first_words), books, second=two if two > 1 else 256)
    seen = np.bincount(_list_of(encode(x, trained[:2], 1)[0], two), minlength=len(trained[0]) * two)
    return trained, two, np.maximum(1, np.ceil(seen * (n / len(x)) / list_rows)).astype(np.int32)


def _list_of(codes, two: int):
    return codes[:, 0] * two + codes[:, 1] if two > 1 else codes[:, 0]


def _best_lists(u, books: list, two: int, probes: int):
    """The lists whose words are nearest to each unit row: (rows x probes)."""
    import numpy as np

    c = books[0]
    cost = -(u @ c.T) + 0.5 * np.einsum("ij,ij->i", c, c)
    m = min(probes, len(c))
    near = np.argpartition(cost, m - 1, axis=1)[:, :m]
    if two == 1:
        return near.astype(np.int64)
    probes = min(probes, m * len(books[1]))
    out = np.empty((len(u), probes), np.int64)
    for i in range(len(u)):  # sums of two words, below the best first words
        w = c[near[i]][:, None] + books[1][None]
        v = -(w @ u[i]) + 0.5 * np.einsum("ijk,ijk->ij", w, w)
        top = np.argpartition(v.ravel(), probes - 1)[:probes]
        out[i] = near[i][top // v.shape[1]] * two + top % v.shape[1]
    return out


def nearest(vectors: DataFrame, queries: DataFrame, dims: dict[str, int], *, k: int = 10, books: int = 64, probes: int = 32, short: int = 100, short_share: float = 0.25, train_rows: int = 40_000, list_rows: int = 20_000, first_words: int = 4096, most_known: int = 1_000_000) -> DataFrame:
    """The ``k`` most similar vectors (cosine) of the same collection for each row of ``queries``, itself excluded.

    Additive quantisation: codebooks of full length are fitted to residuals of a sample of ``train_rows`` rows a
    collection; every vector is encoded by beam search and goes, with the length of its reconstruction, to the list
    of its first word (above ``first_words`` lists, of its first two words, so that lists grow in number with the
    table). A list of more than ``list_rows`` rows is cut into parts. Queries go by the same shuffle to all parts of
    their ``probes`` best lists. A task holds one part of one list at a time and streams its queries through: the
    codes of all its rows are scored by table lookup, and the best ``short`` (or ``short_share`` of a longer list) are
    ranked again by the exact cosine. Nothing but the codebooks is broadcast, no query passes through the driver.

    Of a vector that is repeated more than ``k`` times, the ``k + 1`` rows with the smallest keys are indexed, as no
    other can be an answer, and one row asks for all of them. Ties: the smaller vec_no first.

    Null, empty, all-zero, not finite and wrongly long embeddings and unknown collections are neither queries nor
    answers; copies are answers like others; fewer than ``k`` others give fewer rows; empty tables give none.
    Result: ``vec_no, neighbour, similarity, rank``.
    """
    import pickle

    import numpy as np

    spark = vectors.sparkSession
    out_schema = "vec_no long, neighbour long, similarity double"
    rows = of_length(vectors.select(*SHAPE), dims).withColumn("h", F.xxhash64("collection_name", "embedding"))
    # the (k + 1)-th key of each vector that is repeated more often: a window limit, narrow rows only
    by_key = Window.partitionBy("h").orderBy("vec_no")
    last = rows.select("h", "vec_no").withColumn("r", F.row_number().over(by_key)).filter(F.col("r") <= k + 1).filter(F.col("r") == k + 1)
    last, last_at = runtime.stage(last.select("h", F.col("vec_no").alias("last")), "repeated")
    repeated = last.count()
    small = F.broadcast if repeated <= most_known else lambda df: df
    if repeated:
        rows = rows.join(small(last), "h", "left").filter(F.col("last").isNull() | (F.col("vec_no") <= F.col("last"))).drop("last")
    totals = {r[0]: r[1] for r in rows.groupBy("collection_name").count().collect()}
    if not totals:
        return spark.createDataFrame([], out_schema + ", rank int")
    lists_of = {c: max(16, 1 << round(math.log2(max(1.0, 0.75 * math.sqrt(n))))) for c, n in totals.items()}

    def fit(key, table):
        c = key[0].as_py()
        x, good = matrix(table.column("embedding").combine_chunks(), dims[c])
        x = unit(x[good])
        made = _fit_lists(x, lists_of[c], books, totals[c], list_rows, first_words) if len(x) else None
        return pa.table({"collection_name": pa.array([c]), "model": pa.array([pickle.dumps(made)], pa.binary())})

    share = F.create_map(*[F.lit(v) for c, n in totals.items() for v in (c, int(min(1.0, max(train_rows, 30 * min(lists_of[c], first_words)) / n) * (1 << 30)))])
    chosen = rows.filter(F.pmod(F.xxhash64(F.lit("sample"), "vec_no"), F.lit(1 << 30)) < F.try_element_at(share, F.col("collection_name")))
    fitted = chosen.select("collection_name", "embedding").groupBy("collection_name").applyInArrow(fit, "collection_name string, model binary").collect()
    trained = {r[0]: m for r in fitted if (m := pickle.loads(bytes(r[1])))}
    if not trained:
        return spark.createDataFrame([], out_schema + ", rank int")
    model = spark.sparkContext.broadcast(trained)  # bounded: collections x (books x words + first_words) x length
    known = {c: dims[c] for c in trained}
    number = {c: i for i, c in enumerate(sorted(trained))}
    names = ["coll", "list", "part", "asks", "vec_no", "codes", "size", "embedding"]
    shape = "coll int, list long, part int, asks boolean, vec_no long, codes binary, size float, embedding binary"

    def packed(c, lists, part, asks, key, codes, size, raw) -> pa.RecordBatch:
        n = len(lists)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, number[c]), pa.int32()), pa.array(lists, pa.int64()), pa.array(part, pa.int32()), pa.array(np.full(n, asks)), key, codes, pa.array(size, pa.float32()), raw], names)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("vec_no")
            for c, at, x in by_dim(batch, known):
                words, two, parts = model.value[c]
                for s in range(0, len(at), 2000):
                    y, key = x[s : s + 2000], keys.take(pa.array(at[s : s + 2000]))
                    codes, size = encode(unit(y), words)
                    lists = _list_of(codes, two)
                    yield packed(c, lists, key.to_numpy() % parts[lists], False, key, fixed(codes[:, 1:].astype(np.uint8)), size, fixed(y))

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("vec_no")
            for c, at, x in by_dim(batch, known):
                words, two, parts = model.value[c]
                for s in range(0, len(at), 1000):
                    y, key = x[s : s + 1000], keys.take(pa.array(at[s : s + 1000]))
                    near = _best_lists(unit(y), words, two, probes)
                    who = np.repeat(np.arange(len(y)), near.shape[1])
                    lists = near.ravel()
                    cut = parts[lists]
                    who, lists, part = np.repeat(who, cut), np.repeat(lists, cut), np.arange(cut.sum()) - np.repeat(np.cumsum(cut) - cut, cut)
                    for p in range(0, len(who), 20_000):
                        z = slice(p, p + 20_000)
                        pick = pa.array(who[z])
                        yield packed(c, lists[z], part[z], True, key.take(pick), pa.array([b""] * len(pick), pa.binary()), np.zeros(len(pick)), fixed(y).take(pick))

    asked = of_length(queries.select(*SHAPE), dims).withColumn("h", F.xxhash64("collection_name", "embedding"))
    if repeated:  # one row asks for all its copies
        copied = asked.select("h", "vec_no").join(small(last.select("h")), "h", "left_semi")
        one, one_at = runtime.stage(copied.groupBy("h").agg(F.min("vec_no").alias("one")), "asking")
        asked = asked.join(small(one), "h", "left").filter(F.col("one").isNull() | (F.col("vec_no") == F.col("one")))
    index = rows.select(*SHAPE).mapInArrow(route, shape)
    ask = asked.select(*SHAPE).mapInArrow(aim, shape)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(sum(totals.values()) / (4 * list_rows)))
    met = index.unionAll(ask).repartition(tasks, "coll", "list", "part").sortWithinPartitions("coll", "list", "part", "asks")
    best = Window.partitionBy("vec_no").orderBy(F.col("similarity").desc(), "neighbour")
    hits = met.mapInArrow(_searcher(model, sorted(trained), known, k + 1, short, short_share), out_schema)
    if repeated:
        top = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k + 1).drop("rank")
        top, _ = runtime.stage(top, "answers")
        many = copied.join(small(one), "h").select(F.col("one").alias("asker"), "vec_no")
        theirs = many.join(top.withColumnRenamed("vec_no", "asker"), "asker")
        itself = many.filter(F.col("vec_no") != F.col("asker")).select("vec_no", F.col("asker").alias("neighbour"), F.lit(1.0).alias("similarity"))
        hits = top.join(small(one.select(F.col("one").alias("vec_no"))), "vec_no", "left_anti").unionByName(theirs.filter(F.col("neighbour") != F.col("vec_no")).select("vec_no", "neighbour", "similarity")).unionByName(itself)
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _searcher(model, order: list[str], known: dict[str, int], k: int, short: int, short_share: float):
    """Streams sorted rows: the rows of a list part first, then the queries that visit it."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def dense(column: pa.Array, dim: int):
            flat = np.frombuffer(column.buffers()[2], np.float32)
            first = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
            return flat[first // 4 : first // 4 + len(column) * dim].reshape(-1, dim)

        at, held, ready, hits, size = None, [], None, [], 0
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            edge = np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in cols])]) if batch.num_rows else []
            for a, z in zip(edge, [*edge[1:], batch.num_rows]):
                key = (int(cols[0][a]), int(cols[1][a]), int(cols[2][a]))
                c = order[key[0]]
                part = batch.slice(a, z - a)
                if key != at:
                    at, held, ready = key, [], None
                if not cols[3][a]:
                    held.append((part.column("vec_no").to_numpy(), np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(z - a, -1), part.column("size").to_numpy(), dense(part.column("embedding"), known[c])))
                    continue
                if not held:
                    continue
                if ready is None:
                    no, codes, length, raw = (np.concatenate([h[i] for h in held]) for i in (0, 1, 2, 3))
                    ready = no, codes, length, raw
                    words, two, _ = model.value[c]
                    first = words[0][key[1] // two]
                asks, q_raw = part.column("vec_no").to_numpy(), dense(part.column("embedding"), known[c])
                hits += _answers(first, words[1:], *ready, asks, q_raw, k, short, short_share)
                size += len(hits[-1][0]) if hits else 0
                if size > 500_000:
                    yield from _sent(_best(hits, k))
                    hits, size = [], 0
        if hits:
            yield from _sent(_best(hits, k))

    return search


def _sent(best: tuple) -> Iterator[pa.RecordBatch]:
    q, x, s = best
    for i in range(0, len(q), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(q[i : i + 50_000]), pa.array(x[i : i + 50_000]), pa.array(s[i : i + 50_000])], ["vec_no", "neighbour", "similarity"])


def _answers(first, books: list, no, codes, length, raw, asks, q_raw, k: int, short: int, short_share: float) -> list[tuple]:
    """Best rows of one list part for each query: all codes scored by tables, the short list by the exact cosine."""
    import numpy as np

    n = len(no)
    r = min(n, max(short, k + 1, math.ceil(short_share * n)))
    out = []
    u = unit(raw)
    step = max(1, 1_000_000 // n)
    for s in range(0, len(asks), step):
        q = q_raw[s : s + step]
        y = unit(q).T
        score = np.repeat((first @ y)[None], n, axis=0)
        for m, b in enumerate(books):
            score += (b @ y)[codes[:, m]]  # the table of this book, looked up
        score = np.ascontiguousarray((score / -np.maximum(length, 1e-6)[:, None]).T)
        pick = np.argpartition(score, r - 1, axis=1)[:, :r] if r < n else np.broadcast_to(np.arange(n), (len(q), n))
        for p in range(0, len(q), max(1, 20_000 // r)):
            own = pick[p : p + max(1, 20_000 // r)]
            near = np.einsum("qrd,qd->qr", u[own], y.T[p : p + len(own)])
            last = np.partition(near, r - k, axis=1)[:, r - k] if r > k else np.full(len(own), -2.0)
            at, place = np.nonzero(near >= last[:, None] - 2e-6)  # with all that may tie; these in double precision
            x_at, q_at = own[at, place], p + at
            sim = np.round(cosine64(raw[x_at], q[q_at]), 12)
            keep = no[x_at] != asks[s + q_at]
            out.append(_best([(asks[s + q_at][keep], no[x_at][keep], sim[keep])], k))
    return out


def _best(hits: list[tuple], k: int) -> tuple:
    """The first ``k`` of each query by similarity, then key."""
    import numpy as np

    q, x, s = (np.concatenate(v) for v in zip(*hits))
    o = np.lexsort((x, -s, q))
    q, x, s = q[o], x[o], s[o]
    new = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(new, np.diff(np.r_[new, len(q)]))
    return q[rank < k], x[rank < k], s[rank < k]


# --- groups of similar vectors ----------------------------------------------------------------------------------


def neighbour_descent(x, k: int = 10, *, trees: int = 2, leaf: int = 64, rounds: int = 4, take: int = 4, seed: int = 1):
    """Approximate nearest neighbours of unit rows: (ids, similarities), best first, -1 where there are none.

    Random projection trees give first neighbours; then each row looks at the neighbours of its neighbours, in both
    directions, until fewer than one list entry in 200 changes.
    """
    import numpy as np

    n = len(x)
    k = min(k, n - 1)
    if k < 1:
        return np.full((n, 0), -1), np.zeros((n, 0), np.float32)
    if n <= max(leaf, k + 1):
        s = x @ x.T
        np.fill_diagonal(s, -2)
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        v = np.take_along_axis(s, top, axis=1)
        o = np.argsort(-v, axis=1)
        return np.take_along_axis(top, o, axis=1), np.take_along_axis(v, o, axis=1)
    rng = np.random.default_rng(seed)

    def merge(ids, sim, new_ids, new_sim):
        a, b = np.concatenate([ids, new_ids], axis=1), np.concatenate([sim, new_sim], axis=1)
        o = np.argsort(a, axis=1, kind="stable")
        a, b = np.take_along_axis(a, o, axis=1), np.take_along_axis(b, o, axis=1)
        b[:, 1:][a[:, 1:] == a[:, :-1]] = -2
        b[a == np.arange(n)[:, None]] = -2
        b[a < 0] = -2
        top = np.argpartition(-b, k - 1, axis=1)[:, :k]
        a, b = np.take_along_axis(a, top, axis=1), np.take_along_axis(b, top, axis=1)
        o = np.argsort(-b, axis=1)
        a, b = np.take_along_axis(a, o, axis=1), np.take_along_axis(b, o, axis=1)
        a[b <= -2] = -1
        return a, b

    ids, sim = np.full((n, k), -1), np.full((n, k), -2, np.float32)
    depth = max(1, math.ceil(math.log2(n / leaf)))
    for _ in range(trees):
        order, part = np.arange(n), np.zeros(n, np.int64)
        for d in range(depth):
            edge = np.searchsorted(part, np.arange(1 << d))
            many = np.diff(np.r_[edge, n])
            one = order[edge + (rng.random(1 << d) * many).astype(int)]
            two = order[edge + (rng.random(1 << d) * many).astype(int)]
            way = x[one] - x[two] + 1e-6 * rng.standard_normal((1 << d, x.shape[1])).astype(np.float32)
            side = np.einsum("ij,ij->i", x[order], way[part])
            o = np.lexsort((side, part))
            order = order[o]
            where = np.arange(n) - np.repeat(edge, many)
            part = 2 * part + (where >= np.repeat((many + 1) // 2, many))
        edge = np.searchsorted(part, np.arange(1 << depth))
        width = int(np.diff(np.r_[edge, n]).max())
        box = np.minimum(edge[:, None] + np.arange(width), np.r_[edge[1:], n][:, None] - 1)
        rows = order[box]
        for s in range(0, len(rows), 64):
            r = rows[s : s + 64]
            v = x[r] @ x[r].transpose(0, 2, 1)
            flat = np.broadcast_to(r[:, None, :], v.shape).reshape(-1, width)
            own = r.ravel()
            v = v.reshape(-1, width)
            v[flat == own[:, None]] = -2
            m = min(k, width - 1)
            top = np.argpartition(-v, m - 1, axis=1)[:, :m]
            cand, cs = np.take_along_axis(flat, top, axis=1), np.take_along_axis(v, top, axis=1)
            if s == 0:
                all_ids, all_sim = np.full((n, m), -1), np.full((n, m), -2, np.float32)
            all_ids[own, : cand.shape[1]], all_sim[own, : cand.shape[1]] = cand, cs
        ids, sim = merge(ids, sim, all_ids, all_sim)
    for _ in range(rounds):
        src, dst = np.repeat(np.arange(n), k), ids.ravel()
        fine = dst >= 0
        src, dst = src[fine], dst[fine]
        o = np.lexsort((rng.random(len(dst)), dst))
        src, dst = src[o], dst[o]
        first = np.searchsorted(dst, np.arange(n))
        nth = np.arange(len(dst)) - first[dst]
        back = np.full((n, take), -1)
        back[dst[nth < take], nth[nth < take]] = src[nth < take]
        pick = np.argsort(rng.random((n, k)), axis=1)[:, : min(take, k)]
        hub = np.concatenate([np.take_along_axis(ids, pick, axis=1), back], axis=1)
        far = np.argsort(rng.random((n, k)), axis=1)[:, : min(6, k)]
        cand = np.where(hub[:, :, None] >= 0, np.take_along_axis(ids, far, axis=1)[hub], -1).reshape(n, -1)
        cand = np.concatenate([cand, back], axis=1)
        score = np.empty(cand.shape, np.float32)
        for s in range(0, n, 2000):
            score[s : s + 2000] = (x[cand[s : s + 2000]] @ x[s : s + 2000, :, None])[:, :, 0]
        new_ids, new_sim = merge(ids, sim, cand, score)
        changed = (np.sort(new_ids, axis=1) != np.sort(ids, axis=1)).mean()
        ids, sim = new_ids, new_sim
        if changed < 0.005:
            break
    return ids, sim


def communities(n: int, i, j, w, *, passes: int = 8, levels: int = 4, seed: int = 1):
    """Communities of high modularity: nodes move to the neighbouring community that gains most, half of them at a
    time; communities then become nodes. Each result is connected."""
    import numpy as np

    rng = np.random.default_rng(seed)
    label = np.arange(n)
    a, b, v, size = np.r_[i, j], np.r_[j, i], np.r_[w, w].astype(np.float64), n
    if len(i) == 0:
        return label
    twice = v.sum()
    for _ in range(levels):
        degree = np.bincount(a, v, size)
        own = np.arange(size)
        for _ in range(passes):
            total = np.bincount(own, degree, size)
            key, at = np.unique(a * size + own[b], return_inverse=True)
            weight = np.bincount(at, v)
            node, comm = key // size, key % size
            stay = comm == own[node]
            gain = weight - degree[node] * (total[comm] - np.where(stay, degree[node], 0)) / twice
            o = np.lexsort((-comm, gain, node))
            last = o[np.flatnonzero(np.r_[node[o][1:] != node[o][:-1], True])]
            here = np.zeros(size)
            here[node[stay]] = gain[stay]
            here = np.where(np.bincount(node[stay], minlength=size) > 0, here, -degree * (total[own] - degree) / twice)
            move = (gain[last] > here[node[last]] + 1e-9) & (rng.random(len(last)) < 0.5)
            own[node[last][move]] = comm[last][move]
            if move.mean() < 0.005:
                break
        names, own = np.unique(own, return_inverse=True)
        label = own[label]
        if len(names) == size:
            break
        key, at = np.unique(own[a] * len(names) + own[b], return_inverse=True)
        v = np.bincount(at, v)
        a, b, size = key // len(names), key % len(names), len(names)
    inside = label[i] == label[j]
    return components(n, i[inside], j[inside])


def components(n: int, i, j):
    """Smallest connected node of each node."""
    import numpy as np

    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        lower = np.minimum(a, b)
        new = root.copy()
        np.minimum.at(new, a, lower)
        np.minimum.at(new, b, lower)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, root):
            return root
        root = new


class _Tree:
    """Pivots by which vectors find their cells. A crowded cell has pivots of its own, and so on down.

    ``leaves`` holds, for each cell, the pivots on the way to it. A vector goes to its nearest pivot, right below a
    crowded cell to the two nearest.
    """

    def __init__(self, x, per_row: float, cells: int, hot_rows: int, rng):
        import numpy as np

        self.leaves: list = []
        once = np.unique(x, axis=0)  # a cell is crowded by different vectors, not by copies of one
        per_row *= len(x) / len(once)
        self.root = self._grow(once, per_row, once[rng.choice(len(once), min(cells, len(once)), replace=False)], 1, hot_rows, [], rng)

    def _grow(self, x, per_row: float, pivots, wide: int, hot_rows: int, way: list, rng):
        import numpy as np

        home = (x @ pivots.T).argmax(axis=1)
        kids: list = []
        for p in range(len(pivots)):
            own, path = x[home == p], [*way, pivots[p]]
            size = len(own) * per_row * wide
            if size > hot_rows and len(own) >= 4 and len(path) < 12:
                many = int(min(64, len(own) // 2, max(2, math.ceil(4 * size / hot_rows))))
                kids.append(self._grow(own, per_row, _central(own, many, path, rng), 2 if len(path) == 1 else 1, hot_rows, path, rng))
            else:
                kids.append(len(self.leaves))
                self.leaves.append(np.stack(path))
        return pivots, wide, kids

    def place(self, u):
        """Pairs of (row, cell)."""
        import numpy as np

        rows, cells, todo = [], [], [(self.root, np.arange(len(u)))]
        while todo:
            (pivots, wide, kids), at = todo.pop()
            s = u[at] @ pivots.T
            w = min(wide, len(kids))
            near = s.argmax(axis=1)[:, None] if w == 1 else np.argpartition(-s, w - 1, axis=1)[:, :w]
            for p in np.unique(near):
                own = at[(near == p).any(axis=1)]
                if isinstance(kids[p], int):
                    rows.append(own)
                    cells.append(np.full(len(own), kids[p]))
                else:
                    todo.append((kids[p], own))
        return np.concatenate(rows), np.concatenate(cells)


def _central(x, many: int, known: list, rng, least: float = 0.6, look: int = 2000):
    """Pivots of a crowded cell: half of them those with most neighbours that no earlier one has, the others at random."""
    import numpy as np

    some = x[rng.choice(len(x), min(look, len(x)), replace=False)]
    near = some @ some.T >= least
    free = ~(some @ np.stack(known).T >= 1 - 1e-6).any(axis=1)
    chosen: list[int] = []
    open_ = np.ones(len(some), bool)
    for _ in range((many + 1) // 2):
        count = (near & open_).sum(axis=1) * free
        best = int(count.argmax())
        if count[best] < 3:
            break
        chosen.append(best)
        open_ &= ~near[best]
        free[best] = False
    rest = rng.permutation([i for i in range(len(some)) if i not in set(chosen)])[: many - len(chosen)]
    return some[np.r_[np.array(chosen, int), rest.astype(int)]]


def _border_links(u, label, degree, *, around: int = 10, look: int = 8):
    """Candidate links between communities: for each, the members nearest to the centre of each of the communities
    around it, and the other way round. Returns pairs of rows."""
    import numpy as np

    names, at = np.unique(label, return_inverse=True)
    m = len(names)
    if m < 2:
        return np.zeros(0, int), np.zeros(0, int)
    order = np.argsort(at, kind="stable")
    first = np.searchsorted(at[order], np.arange(m))
    size = np.diff(np.r_[first, len(at)])
    centre = unit(np.add.reduceat(u[order], first, axis=0) + 1e-9)
    left, right = [], []
    for s in range(0, m, 512):
        near = centre[s : s + 512] @ centre.T
        near[np.arange(len(near)), np.arange(s, s + len(near))] = -2
        w = min(around, m - 1)
        for a, tops in zip(range(s, s + len(near)), np.argpartition(-near, w - 1, axis=1)[:, :w]):
            mine = order[first[a] : first[a] + size[a]]
            for b in tops.tolist():
                if near[a - s, b] < 0.2:
                    continue
                theirs = order[first[b] : first[b] + size[b]]
                x = mine[np.argsort(-(u[mine] @ centre[b]))[:look]]
                y = theirs[np.argsort(-(u[theirs] @ centre[a]))[:look]]
                left.append(np.repeat(x, len(y)))
                right.append(np.tile(y, len(x)))
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def _cosines(raw, i, j):
    """Exact cosines of pairs of rows, in bounded steps."""
    import numpy as np

    return np.concatenate([cosine64(raw[i[s : s + 20_000]], raw[j[s : s + 20_000]]) for s in range(0, len(i), 20_000)]) if len(i) else np.zeros(0)


def communities_of_cell(raw, pivots, k: int, least: float, seed: int):
    """Graph, communities and parts of the vectors of one cell: (part, degree inside the community, has any edge).

    Neighbour descent proposes edges, and so do the pivots on the way to the cell, which are rows as well (the last
    ones); every edge is checked exactly. Modularity makes communities of the graph; communities are one part where an
    edge of the graph, or one of the candidates along their border, holds.
    """
    import numpy as np

    n = len(raw)
    u = unit(raw)
    ids, sim = neighbour_descent(u, k, seed=seed)
    i, j = np.repeat(np.arange(n), ids.shape[1]), ids.ravel()
    good = (j >= 0) & (sim.ravel() > least - 0.01)
    hub = np.arange(n - pivots, n)
    p, q = np.nonzero(u[hub] @ u.T > least - 0.01)
    i, j = np.r_[i[good], hub[p]], np.r_[j[good], q]
    pair = np.unique((np.minimum(i, j) * n + np.maximum(i, j))[i != j])
    i, j = pair // n, pair % n
    w = _cosines(raw, i, j)
    i, j, w = i[w >= least], j[w >= least], w[w >= least]
    label = communities(n, i, j, w, seed=seed)
    inside = label[i] == label[j]
    degree = np.bincount(i[inside], w[inside], n) + np.bincount(j[inside], w[inside], n)
    x, y = _border_links(u, label, degree)
    apart = components(n, np.r_[i, np.arange(n)], np.r_[j, label])
    new = apart[x] != apart[y]
    x, y = x[new], y[new]
    near = np.einsum("ij,ij->i", u[x], u[y]) > least - 0.01
    x, y = x[near], y[near]
    hold = _cosines(raw, x, y) >= least
    x, y = x[hold], y[hold]
    part = components(n, np.r_[np.arange(n), x], np.r_[apart, y])
    return part, degree.astype(np.float64), np.bincount(np.r_[i, j, x, y], minlength=n) > 0


def similar_groups(vectors: DataFrame, dims: dict[str, int], *, least_cosine: float = 0.6, least_size: int = 5, k: int = 10, rounds: int = 3, cell_rows: int = 8192, hot_rows: int = 20_000, sample_mb: int = 128, pass_rows: int | None = None) -> DataFrame:
    """Groups of at least ``least_size`` vectors linked, directly or through others, by a cosine of ``least_cosine``.

    In each of ``rounds`` rounds the vectors of a collection go to the cell of the nearest of other random pivots, one
    cell for ``cell_rows`` vectors: cells grow in number with the table, not in size. A cell that a sample shows to hold
    more than ``hot_rows`` different vectors has pivots of its own, the most central vectors first, and its vectors go
    to the two nearest of them, and so on down. In each cell neighbour descent builds the graph, whose edges are checked
    exactly, modularity finds its communities, and communities with an edge between them, or along their border, are one
    part; the pivots on the way to a cell are members of it, so that what a crowded cell parts meets again at its hubs.
    Parts of different cells that share a vector are linked, by distributed components over parts, not vectors. Links
    that alone hold a group together, between vectors that share no cell in any round, are not seen.

    A pass routes at most ``pass_rows`` vectors (what a sample of ``sample_mb`` finds cells for); a larger collection is
    first cut into blocks by coarse pivots, in each round by others, which are routed one after the other.

    Unusable embeddings (null, empty, all zero, not finite, wrong length, unknown collection) are in no group; copies
    are members each and travel once a task; ties do not matter as a group is a set; empty tables give no rows.
    Result: ``vec_no, collection_name, cluster_no, cluster_size, degree`` (degree: largest weight of a vector's edges
    inside its community).
    """
    spark = vectors.sparkSession
    rows = of_length(vectors.select(*SHAPE), dims).withColumn("h", F.xxhash64("collection_name", "embedding"))
    result = "vec_no long, collection_name string, cluster_no long, cluster_size long, degree double"
    seen: list[DataFrame] = []

    def meet(part: DataFrame, only: str | None, turns: list[int], depth: int) -> None:
        """Adds what the cells of ``part`` find; blocks of it, if it is too large for one pass."""
        totals = {r[0]: r[1] for r in part.groupBy("collection_name").count().collect() if only in (None, r[0])}
        small = {}
        for c, n in totals.items():
            most = pass_rows or max(cell_rows, cell_rows * (sample_mb << 20) // (16 * 4 * dims[c]))
            own = part.filter(F.col("collection_name") == c)
            if n <= most or depth > 3:
                small[c] = n
                continue
            for turn in turns:
                blocks = min(1024, math.ceil(2 * n / most))
                x = _fresh(sample(own, c, dims[c], 20 * blocks, n))
                cut, _ = runtime.stage(_into_blocks(own, {c: dims[c]}, x, blocks, turn + 7 * depth), "block")
                for b in sorted(r[0] for r in cut.select("block").distinct().collect()):
                    meet(cut.filter(F.col("block") == b).drop("block"), c, [turn], depth + 1)
        if small:
            of = part if only is None and len(small) == len(totals) else part.filter(F.col("collection_name").isin(list(small)))
            seen.append(_found_in_cells(of, small, dims, turns, depth, k, least_cosine, cell_rows, hot_rows))

    meet(rows, None, list(range(rounds)), 0)
    seen = [s for s in seen if s is not None]
    if not seen:
        return spark.createDataFrame([], result)
    member, _ = runtime.stage(reduce(DataFrame.unionAll, seen), "communities")
    own = member.groupBy("h").agg(F.min("part").alias("first"), F.collect_set("part").alias("all"), F.max("degree").alias("degree"))  # a part a cell: a few
    own, _ = runtime.stage(own.select("h", "first", "degree", "all"), "parts")
    edges = own.select(F.col("first").alias("a"), F.explode("all").alias("b")).distinct()
    roots = linked(edges, "groups")
    of = own.join(roots, F.col("first") == F.col("node")).select("h", "root", "degree")
    # enough copies of one vector are a group though they have no other neighbour
    holes = F.size("embedding") - F.size(F.array_compact("embedding"))
    copied = rows.groupBy("h").agg(F.count("*").alias("n"), F.max(holes).alias("holes")).filter((F.col("n") >= least_size) & (F.col("holes") == 0))
    of = of.unionByName(copied.join(of, "h", "left_anti").select("h", F.col("h").alias("root"), F.lit(0.0).alias("degree")))
    placed = rows.select("vec_no", "collection_name", "h").join(of, "h")
    groups = placed.groupBy("root").agg(F.min("vec_no").alias("cluster_no"), F.count("*").alias("cluster_size")).filter(F.col("cluster_size") >= least_size)
    return placed.join(groups, "root").select("vec_no", "collection_name", "cluster_no", "cluster_size", "degree")


def _fresh(x):
    import numpy as np

    return np.unique(unit(x), axis=0) if len(x) else x


def _into_blocks(rows: DataFrame, known: dict[str, int], x, blocks: int, seed: int) -> DataFrame:
    """Rows with the number of the nearest of ``blocks`` coarse pivots, chosen anew by each seed."""
    import numpy as np

    pivots = rows.sparkSession.sparkContext.broadcast(x[np.random.default_rng(seed).choice(len(x), min(blocks, len(x)), replace=False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, at, y in by_dim(batch, known):
                block = (unit(y) @ pivots.value.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, pa.array(block, pa.int32())], [*batch.schema.names, "block"])

    out = rows.mapInArrow(run, "vec_no long, collection_name string, embedding array<float>, h long, block int")
    return out.repartition("block")


def _found_in_cells(rows: DataFrame, totals: dict[str, int], dims: dict[str, int], turns: list[int], depth: int, k: int, least: float, cell_rows: int, hot_rows: int) -> DataFrame | None:
    """``h, part, degree`` of all vectors with a link, cell by cell."""
    import numpy as np

    spark = rows.sparkSession
    trees: dict[str, dict[int, _Tree]] = {}
    for c, n in totals.items():
        cells = max(1, round(n / cell_rows))
        x = sample(rows, c, dims[c], max(4000, 16 * cells), n)
        if len(x):
            x = unit(x)
            trees[c] = {r: _Tree(x, n / len(x), cells, hot_rows, np.random.default_rng([r, depth])) for r in turns}
    if not trees:
        return None
    plan = spark.sparkContext.broadcast(trees)  # bounded by the rows of a pass
    known = {c: dims[c] for c in trees}
    salt = runtime.new_path(spark, "cells")  # cells of different passes are different

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            h_all = batch.column("h").to_numpy()
            for c, at, x in by_dim(batch, known):
                h = h_all[at]
                fresh = np.zeros(len(at), bool)
                for p, v in enumerate(h.tolist()):
                    if v not in sent:
                        if len(sent) < 1_000_000:  # a bound of memory only: what is sent twice is merged in its cell
                            sent.add(v)
                        fresh[p] = True
                x, h = x[fresh], h[fresh]
                if not len(h):
                    continue
                u = unit(x)
                raw = fixed(x)
                for r, tree in plan.value[c].items():
                    row, cell = tree.place(u)
                    pick = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array([c] * len(row)), pa.array(np.full(len(row), r), pa.int32()), pa.array(cell, pa.int32()), pa.array(h[row]), raw.take(pick)], ["collection_name", "round", "cell", "h", "embedding"])

    def detect(key, table):
        import hashlib

        c, r, cell = (v.as_py() for v in key)
        h, first = np.unique(table.column("h").to_numpy(), return_index=True)
        raw = np.frombuffer(b"".join(table.column("embedding").take(pa.array(first)).to_pylist()), np.float32).reshape(-1, known[c])
        way = plan.value[c][r].leaves[cell]
        part, degree, some = communities_of_cell(np.concatenate([raw, way]), len(way), k, least, r + 1)

        def named(what: str) -> int:
            return int.from_bytes(hashlib.blake2b(what.encode(), digest_size=8).digest(), "little", signed=True)

        # a pivot has a part of its own name, by which the cells below it meet
        roots = {x: named(f"{salt}|{c}|{r}|{cell}|{x}") for x in np.unique(part[some]).tolist()}
        hub = [named(f"{salt}|{c}|{r}|pivot|{hashlib.blake2b(v.tobytes()).hexdigest()}") for v in way]
        at = np.flatnonzero(some[: len(raw)])
        own = np.array([roots[x] for x in part[at].tolist()], np.int64)
        ties = [(roots[part[len(raw) + i]], hub[i]) for i in range(len(way)) if some[len(raw) + i]]
        return pa.table({"h": pa.array(np.r_[h[at], np.array([b for _, b in ties], np.int64)].astype(np.int64)), "part": pa.array(np.r_[own, np.array([a for a, _ in ties], np.int64)].astype(np.int64)), "degree": pa.array(np.r_[degree[at], np.zeros(len(ties))])})

    sent = rows.mapInArrow(spread, "collection_name string, round int, cell int, h long, embedding binary")
    cells = sum(len(t.leaves) for of in trees.values() for t in of.values())
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(20_000, cells // 2))  # what a task reads does not grow
    return sent.repartition(tasks, "collection_name", "round", "cell").groupBy("collection_name", "round", "cell").applyInArrow(detect, "h long, part long, degree double")


def describe_groups(members: DataFrame, vectors: DataFrame, *, typical: int = 3, tags: int = 3) -> DataFrame:
    """One row a group: size, the members of highest internal weighted degree, and the tags of most members.

    Tags are split at commas; empty tags and groups without tags give an empty string; ties by key, then by tag.
    """
    one = members.select("cluster_no", "vec_no", "degree")
    # ordered aggregates with a bounded result: the first by (degree, key) without gathering a group
    rank = F.struct((-F.col("degree")).alias("d"), F.col("vec_no").alias("v"))
    salted = one.withColumn("s", F.pmod(F.xxhash64("vec_no"), F.lit(64)))
    w1 = Window.partitionBy("cluster_no", "s").orderBy(rank)
    w2 = Window.partitionBy("cluster_no").orderBy(rank)
    top = salted.withColumn("r", F.row_number().over(w1)).filter(F.col("r") <= typical).withColumn("r", F.row_number().over(w2)).filter(F.col("r") <= typical)
    top = top.groupBy("cluster_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "vec_no"))), lambda x: x["vec_no"].cast("string")), ",").alias("typical_members"))
    words = one.join(vectors.select("vec_no", F.explode(F.array_distinct(F.transform(F.split(F.coalesce("tags", F.lit("")), ","), lambda x: F.trim(x)))).alias("tag")), "vec_no").filter(F.col("tag") != "")
    counts = words.groupBy("cluster_no", "tag").agg(F.count("*").alias("n"))
    w3 = Window.partitionBy("cluster_no").orderBy(F.col("n").desc(), "tag")
    tag = counts.withColumn("r", F.row_number().over(w3)).filter(F.col("r") <= tags).groupBy("cluster_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "tag"))), lambda x: x["tag"]), ",").alias("typical_tags"))
    size = members.groupBy("cluster_no", "collection_name").agg(F.max("cluster_size").alias("cluster_size"))
    return size.join(top, "cluster_no", "left").join(tag, "cluster_no", "left").select("cluster_no", "collection_name", "cluster_size", "typical_members", F.coalesce("typical_tags", F.lit("")).alias("typical_tags"))
