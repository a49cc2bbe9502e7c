"""Splitting long texts at natural boundaries, and packing texts into containers of fixed capacity."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold import runtime

#: Boundary kinds, best first; ``forced`` is a cut inside a run without white space.
KINDS = ("paragraph", "line", "sentence", "word", "forced", "end")
_BLOCK = 1_000_000  # characters looked at together; each takes some 150 bytes for a while


def _cuts(texts: list[str], limit: int, overlap: int, fill: float, done: int = 0):
    """Cut positions of all texts at once: ``(text, start, end, kind)`` arrays, ends in order. ``done`` is a place where all
    of them were cut before; cuts follow from there."""
    import numpy as np

    space = np.zeros(0x3001, bool)
    space[[c for c in range(0x3001) if chr(c).isspace()]] = True
    cp = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.r_[0, np.cumsum(lens + 1)[:-1]].astype(np.int64)
    last = first + lens
    n = len(cp)
    owner = np.repeat(np.arange(len(texts)), lens + 1)[: n + 1]
    ws = space[np.minimum(cp, 0x3000)] & (cp <= 0x3000)
    nl = cp == 10
    prev_ws, here_ws = np.r_[False, ws], np.r_[ws, False]
    inner = np.zeros(n + 1, bool)
    inner[: len(owner)] = True
    inner[first] = False
    inner[last] = False
    ink = np.where(ws, -1, np.arange(n))
    ink = np.maximum.accumulate(ink) if n else ink
    ender = np.isin(cp, [ord(c) for c in ".!?…。"])
    closer = np.isin(cp, [ord(c) for c in "\"')]»”’"])
    ends = ender.copy()
    ends[1:] |= closer[1:] & ender[:-1]
    fresh = prev_ws & ~here_ws  # first sign after white space
    after = np.flatnonzero(inner & fresh)
    words = np.flatnonzero(inner & (prev_ws | here_ws))
    sentences = after[ends[ink[after - 1]] & (ink[after - 1] >= 0)] if len(after) else after
    lines = np.flatnonzero(inner & np.r_[False, nl])
    paragraphs = lines[np.r_[False, False, nl[:-1]][lines]] if n > 1 else lines[:0]
    levels = [paragraphs, lines, sentences, words]
    # forced points follow from the start of each run that no piece can hold
    edge = np.unique(np.r_[words, first, last])
    length = np.diff(edge)
    long = np.flatnonzero((length > limit) & (owner[edge[:-1]] == owner[np.maximum(edge[1:] - 1, 0)]))
    forced = []
    for i in long:
        c, e = int(edge[i]), int(edge[i + 1])
        start = int(first[owner[c]])
        s = max(c - overlap, start) if c > start else c
        while e > s + limit:
            forced.append(s + limit)
            s = s + limit - overlap
    forced = np.array(forced, np.int64)
    state = np.unique(np.r_[first, first + done, last, words, forced]).astype(np.int64)
    own = owner[np.minimum(state, len(owner) - 1)] if len(owner) else owner
    own = np.searchsorted(last, state, "left") if len(texts) else own
    s = np.maximum(state - overlap, first[own])
    hi = np.minimum(s + limit, last[own])
    nxt = np.full(len(state), -1, np.int64)
    nxt[hi == last[own]] = last[own][hi == last[own]]
    for k, b in enumerate(levels):
        todo = np.flatnonzero(nxt < 0)
        if not len(todo) or not len(b):
            continue
        j = np.searchsorted(b, hi[todo], "right") - 1
        cand = np.where(j >= 0, b[np.maximum(j, 0)], -1)
        good = cand > state[todo]
        if k < 3:
            good &= cand >= s[todo] + fill * limit
        nxt[todo[good]] = cand[good]
    for b in (np.unique(np.r_[words, last]), forced):  # less overlap, then a cut by force
        todo = np.flatnonzero(nxt < 0)
        if not len(todo) or not len(b):
            continue
        j = np.minimum(np.searchsorted(b, state[todo], "right"), len(b) - 1)
        good = (b[j] > state[todo]) & (b[j] <= np.minimum(state[todo] + limit, last[own[todo]]))
        nxt[todo[good]] = b[j][good]
    nxt[nxt < 0] = last[own][nxt < 0]
    step = np.searchsorted(state, nxt)
    # pointer doubling: after round t every cut of the first 2^t is marked
    seen = np.zeros(len(state), bool)
    seen[np.searchsorted(state, first + done)] = True
    while True:
        seen[step[seen]] = True
        twice = step[step]
        if np.array_equal(twice, step):
            break
        step = twice
    cut = state[seen]
    who = np.searchsorted(last, cut, "left")
    end_at = cut > first[who] + done
    end, who = cut[end_at], who[end_at]
    before = np.r_[0, cut[:-1]][end_at]
    start = np.maximum.reduce([np.where(before > first[who], before - overlap, first[who]), end - limit, first[who]])
    kind = np.full(len(end), 4)
    for k in (3, 2, 1, 0):
        kind[np.isin(end, levels[k])] = k
    kind[end == last[who]] = 5
    return who, start - first[who], end - first[who], kind


def _long_cuts(text: str, limit: int, overlap: int, fill: float, block: int):
    """``_cuts`` of one long text, ``block`` characters at a time. A next slice begins before the last kept cut and goes on
    from it; cuts near the end of a slice are made again, as what follows matters to them."""
    import numpy as np

    block = max(block, 6 * limit)
    parts, a, after = [], 0, 0
    while True:
        seg = text[a : a + block]
        _, start, end, kind = _cuts([seg], limit, overlap, fill, after)
        if a + block >= len(text):
            parts.append((start + a, end + a, kind))
            break
        keep = end <= len(seg) - limit
        parts.append((start[keep] + a, end[keep] + a, kind[keep]))
        cut = a + int(end[keep][-1])
        a = max(0, cut - limit)  # what stands before the cut tells where runs and overlaps begin
        after = cut - a
    start, end, kind = (np.concatenate(x) for x in zip(*parts))
    return np.zeros(len(end), np.int64), start, end, kind


def split_texts(df: DataFrame, key: str, text: str, *, limit: int = 1500, overlap: int = 150, fill: float = 0.5) -> DataFrame:
    """Pieces of at most ``limit`` characters (code points) that cover every text in order.

    Pointer doubling over the boundaries of a text: each boundary gets its farthest legal successor, counting the
    overlap, a better kind (paragraph, line, sentence, word) being taken if the piece is then at least ``fill`` full;
    squaring the successor table marks all greedy cuts in a logarithmic number of rounds, for all texts of a batch; a text
    of more than a million characters goes in slices.
    Neighbours share ``overlap`` characters; less if no natural cut is in reach with it; a run of more than ``limit``
    characters without white space is cut by force.

    Null and empty texts give no piece; a text within the limit gives one; repeated rows give their pieces each.
    Result: ``<key>, piece_no, n_pieces, first_char, end_char, piece, boundary, n_forced`` (``n_forced`` by text).
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size + len(texts[stop]) <= _BLOCK):
                    size += len(texts[stop])
                    stop += 1
                part = texts[at:stop]
                who, start, end, k = _cuts(part, limit, overlap, fill) if size <= _BLOCK else _long_cuts(part[0], limit, overlap, fill, _BLOCK)
                many = np.bincount(who, minlength=len(part))
                hard = np.bincount(who, k == 4, minlength=len(part)).astype(np.int64)
                no = np.arange(len(who)) - np.r_[0, np.cumsum(many)[:-1]][who] + 1
                for x in range(0, len(who), 5000):
                    y = slice(x, x + 5000)
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array(who[y] + at)), pa.array(no[y], pa.int32()), pa.array(many[who[y]], pa.int32()), pa.array(start[y]), pa.array(end[y]), pa.array([part[w][a:b] for w, a, b in zip(who[y], start[y], end[y])], pa.string()), pa.array([KINDS[i] for i in k[y]]), pa.array(hard[who[y]])],
                        ["key", "piece_no", "n_pieces", "first_char", "end_char", "piece", "boundary", "n_forced"],
                    )
                at = stop

    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).filter(F.length("text") > 0)
    out = rows.mapInArrow(run, f"key {kind}, piece_no int, n_pieces int, first_char long, end_char long, piece string, boundary string, n_forced long")
    return out.withColumnRenamed("key", key)


_ENCODERS: dict[tuple[int, str], object] = {}


def encoder_of(ranks: bytes, pattern: str):
    """Byte-level tokenizer from the content of a file of ranks, once a process."""
    mark = (hash(ranks), pattern)
    if mark not in _ENCODERS:
        import base64

        import tiktoken

        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _ENCODERS[mark] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens={})
    return _ENCODERS[mark]


def encoder(path: str, pattern: str):
    with open(path, "rb") as f:
        return encoder_of(f.read(), pattern)


#: Fixed value: the public pre-tokenization pattern of the byte-level vocabulary.
BYTE_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _filler(level: int, capacity: int, classes: int, filler: int):
    """Harmonic packing of measured pieces inside a task; what stays open comes out without a container."""
    names = ["container", "key", "piece_no", "first_token", "n_tokens"]
    types = [pa.string(), None, pa.int32(), pa.int64(), pa.int32()]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import heapq

        from pyspark import TaskContext

        mark = f"{level}-{TaskContext.get().partitionId()}"
        made = 0
        waiting: dict[int, list] = {}
        small: list = []
        used = 0
        spare: list[tuple[int, str]] = []
        key_type = None

        def batch_of(rows):
            cols = list(zip(*rows)) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t or key_type) for c, t in zip(cols, types)], names)

        for batch in batches:
            key_type = batch.schema.field(0).type
            out = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                n = row[3]
                c = min(capacity // n, classes + 1)
                if c > filler and spare and -spare[0][0] >= n:  # room that a container of few pieces leaves
                    room, where = heapq.heappop(spare)
                    out.append((where, *row))
                    if -room - n >= 16:
                        heapq.heappush(spare, (room + n, where))
                elif c > classes:  # small ones, side by side
                    if used + n > capacity:
                        out += [(f"s{mark}-{made}", *r) for r in small]
                        made, small, used = made + 1, [], 0
                    small.append(row)
                    used += n
                else:
                    waiting.setdefault(c, []).append(row)
                    if len(waiting[c]) == c:
                        rows = waiting.pop(c)
                        out += [(f"h{mark}-{made}", *r) for r in rows]
                        room = capacity - sum(r[3] for r in rows)
                        if c <= filler and room >= 16:
                            heapq.heappush(spare, (-room, f"h{mark}-{made}"))
                        made += 1
            yield batch_of(out)
        if key_type is not None:
            yield batch_of([(None, *r) for rows in [*waiting.values(), small] for r in rows])

    return fill


def _best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Container of each size, in the order given: the one with least room that holds it, else a new one."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    there, bins, out = 0, 0, []  # a bit for each room that some container has
    for n in sizes:
        fits = there >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                there ^= 1 << room
        else:
            room, b, bins = capacity, bins, bins + 1
        by_room[room - n].append(b)
        there |= 1 << (room - n)
        out.append(b)
    return out


def pack_texts(df: DataFrame, key: str, text: str, *, capacity: int = 2048, classes: int = 48, filler: int = 8, tokenizer: str = "/opt/tokenizers/byte_bpe_50k.tiktoken", pattern: str = BYTE_PATTERN, last_rows: int = 20_000) -> DataFrame:
    """Assign every text, measured in tokens, to a container of ``capacity`` tokens.

    Harmonic packing: a length in (capacity/(k+1), capacity/k] belongs to class k, whose containers hold exactly k
    pieces, so that every scan task fills its containers by itself. Lengths up to capacity/(classes+1) are put
    next to each other until the container is full. A piece of a class above ``filler`` first goes where a full container
    of a class up to ``filler`` of this task has room, most room first. What tasks leave unfilled, fewer than ``classes``
    squared pieces each, is packed in the same way by fewer tasks, and so on, until at most ``last_rows`` pieces are left;
    these go by decreasing size into the container with least room.
    Only a text longer than a container is split, into full containers and one remainder that is packed like others.
    The tokenizer's file is read once, by the driver, and sent to the tasks.

    Null and empty texts have no tokens and no container; repeated rows are packed each; no rows, no containers.
    Result: ``container, <key>, piece_no, first_token, n_tokens``.
    """
    kind = df.schema[key].dataType.simpleString()
    spark = df.sparkSession
    with open(tokenizer, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())  # a vocabulary: about 1 MB

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(ranks.value, pattern)
        for batch in batches:
            rows = [(i, p + 1, s, min(capacity, n - s)) for i, t in enumerate(batch.column(1).to_pylist()) if (n := len(enc.encode_ordinary(t))) for p, s in enumerate(range(0, n, capacity))]
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32())], names)

    names = ["key", "piece_no", "first_token", "n_tokens"]
    piece = f"key {kind}, piece_no int, first_token long, n_tokens int"
    cols = f"container string, {piece}"
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).filter(F.length("text") > 0)
    todo = rows.mapInArrow(measure, piece)
    out: list[DataFrame] = []
    level, before = 0, None
    while True:
        done, _ = runtime.stage(todo.mapInArrow(_filler(level, capacity, classes, filler), cols), "packed")
        out.append(done.filter(F.col("container").isNotNull()))
        left = done.filter(F.col("container").isNull()).select(*names)
        n = left.count()
        if n <= last_rows or before is not None and n > before / 2:
            break
        level, before = level + 1, n
        todo = left.repartition(max(1, n // (5 * last_rows)))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).sort_by([("n_tokens", "descending"), ("key", "ascending"), ("piece_no", "ascending")])
        where = _best_fit(t.column("n_tokens").to_pylist(), capacity)
        yield from t.add_column(0, "container", pa.array([f"x-{i}" for i in where], pa.string())).to_batches(50_000)

    out.append(left.repartition(1).mapInArrow(finish, cols))  # a bounded number of rows
    return reduce(DataFrame.unionByName, out).withColumnRenamed("key", key)


def container_fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """Tokens and unused share by container."""
    return packed.groupBy("container").agg(F.count("*").alias("n_pieces"), F.sum("n_tokens").cast("long").alias("tokens")).withColumn("unused", 1 - F.col("tokens") / capacity)
