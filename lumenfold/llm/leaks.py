"""Passages of held-out items inside a corpus: one Aho-Corasick scan, then an exact alignment of each candidate."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold import runtime

#: Letters of other scripts that look like Latin ones.
LOOK_ALIKE = {
    "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ɡ": "g", "ɑ": "a", "ո": "n", "ս": "u", "հ": "h",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y", "ı": "i", "ł": "l", "ø": "o",
}
#: Signs that may stand inside a word without parting it.
_INNER = set("-'’‘`´­‐‑‒") | {"​", "‌", "‍", "⁠", "﻿"}


class _Fold(dict):
    """Character map of equal length: lower case, compatibility form, no accents, look-alikes as Latin."""

    def __missing__(self, c: int) -> str:
        ch = chr(c)
        if ch in _INNER or unicodedata.category(ch) in ("Mn", "Cf"):
            out = "\0"
        else:
            out = unicodedata.normalize("NFKD", ch)[:1].lower()[:1] or ch
            out = LOOK_ALIKE.get(out, out)
            out = LOOK_ALIKE.get(ch.lower(), out) if not out.isascii() else out
            if out.isspace():
                out = " "
        self[c] = out
        return out


_FOLD = _Fold()
_WORD = re.compile(r"[^\W_]+(?:\0+[^\W_]+)*")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->|&(?:#\d+|#x[0-9a-fA-F]+|[A-Za-z]+);", re.S)
_INLINE = re.compile(r"</?(?:b|i|u|em|strong|span|a|mark|font|small|sub|sup|wbr)\b", re.I)


def _blank(m: re.Match) -> str:
    s = m.group()
    if s[0] == "&":
        c = html.unescape(s)
        return c[0] + "\0" * (len(s) - 1) if c != s and len(c) == 1 else s
    return ("\0" if _INLINE.match(s) else " ") * len(s)


def fold(text: str) -> str:
    """Text of the same length in which only letters, digits, blanks and signs that part words differ from nothing."""
    return _TAG.sub(_blank, text).translate(_FOLD) if "<" in text or "&" in text else text.translate(_FOLD)


def words_of(text: str) -> list[str]:
    return [w.replace("\0", "") if "\0" in w else w for w in _WORD.findall(fold(text))]


def spans_of(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _WORD.finditer(fold(text))]


def sentences_of(text: str) -> list[str]:
    """Normalised sentences of an item."""
    return [" ".join(words_of(s)) for s in re.split(r"(?<=[.!?:])\s+", text) if s]


def passages(items: list[tuple[int, str]], *, standard: int = 3, common: set[str] | None = None) -> list[tuple[int, list[str]]]:
    """Words of the passage of each item: without sentences that stand in ``standard`` or more different items (``common``
    has them, if these items are not all)."""
    split = {i: sentences_of(t or "") for i, t in items}
    if common is None:
        seen = Counter(k for ss in split.values() for k in set(ss))
        common = {k for k, n in seen.items() if n >= standard}
    out = []
    for i, ss in split.items():
        w = [x for s in ss if s not in common for x in s.split()]
        if w:
            out.append((i, w))
    return out


def _item_blocks(items: DataFrame, key: str, text: str, most: int, standard: int = 3) -> Iterator[list[tuple[int, list[str]]]]:
    """Passages of all items, at most about ``most`` items at a time on the driver."""
    rows = items.select(F.col(f"`{key}`").alias("i"), F.col(f"`{text}`").alias("t")).filter(F.col("i").isNotNull())
    blocks = -(-max(1, rows.count()) // most)
    if blocks == 1:
        yield passages([(r[0], r[1]) for r in rows.collect()])
        return

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, s) for i, t in enumerate(batch.column(1).to_pylist()) for s in set(sentences_of(t or ""))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([o[0] for o in out], pa.int64())), pa.array([o[1] for o in out], pa.string())], ["i", "s"])

    kind = rows.schema["i"].dataType.simpleString()
    said = rows.mapInArrow(spread, f"i {kind}, s string").distinct()
    common, _ = runtime.stage(said.groupBy("s").count().filter(F.col("count") >= standard).select("s"), "standard-sentences")
    for b in range(blocks):
        here = F.pmod(F.xxhash64("i"), F.lit(blocks)) == b
        own = common.join(said.filter(here).select("s").distinct(), "s", "left_semi")
        yield passages([(r[0], r[1]) for r in rows.filter(here).collect()], common={r[0] for r in own.collect()})


@lru_cache(maxsize=1 << 18)
def near(a: str, b: str) -> bool:
    """Same word but for one slip of the fingers; two in words of eight letters or more."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    most = 2 if min(la, lb) >= 8 else 1
    if min(la, lb) < 3 or abs(la - lb) > most or a[0] != b[0] and a[-1] != b[-1] and a[1:3] != b[1:3]:
        return False
    two, row = None, list(range(lb + 1))
    for i in range(1, la + 1):
        new = [i] + [0] * lb
        for j in range(1, lb + 1):
            c = a[i - 1] != b[j - 1]
            v = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + c)
            if two is not None and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                v = min(v, two[j - 2] + 1)
            new[j] = v
        if min(new) > most:
            return False
        two, row = row, new
    return row[lb] <= most


def align(p: list[str], w: list[str], need: int = 1, *, remark: int = 40, remark_cost: float = 3.0) -> tuple[int, float, int, int]:
    """Best local alignment, with ``need`` matches at least, of passage words ``p`` with document words ``w``.

    A match (also of a misspelled word) scores 1, a missing or added word costs 1, hence an exchanged one 2, and once
    up to ``remark`` added words together cost ``remark_cost``. Returns (matched words, score, first and last word in ``w``).
    """
    n, m = len(p), len(w)
    same: dict[tuple[str, str], bool] = {}
    best = (0, 0.0, 0, 0)
    zero = (0.0, 0, -1)  # score, matches, first word
    prev = [[zero] * (m + 1), [zero] * (m + 1)]
    for i in range(1, n + 1):
        a = p[i - 1]
        cur = [[zero] * (m + 1), [zero] * (m + 1)]
        for j in range(1, m + 1):
            b = w[j - 1]
            if a == b:
                hit = True
            elif len(a) < 3 or len(b) < 3:
                hit = False
            else:
                hit = same.get((a, b))
                if hit is None:
                    hit = same[a, b] = near(a, b)
            for layer in (0, 1):
                s, k, f = prev[layer][j - 1]
                x = (s + 1, k + 1, f if k else j - 1) if hit else zero
                s, k, f = prev[layer][j]
                if s - 1 > x[0]:
                    x = (s - 1, k, f)
                s, k, f = cur[layer][j - 1]
                if s - 1 > x[0]:
                    x = (s - 1, k, f)
                cur[layer][j] = x
                if x[1] >= need and (x[0], x[1]) > (best[1], best[0]):
                    best = (x[1], x[0], x[2], j - 1)
        # the remark: from the first layer to the second over added words
        for j in range(2, m + 1):
            lo = max(1, j - remark)
            s, k, f = max(cur[0][lo:j])
            if s - remark_cost > cur[1][j][0]:
                cur[1][j] = (s - remark_cost, k, f)
        prev = cur
    return best


def _chain(hits: list[tuple[int, int]], gram: int) -> float:
    """Most passage words covered by hits that ascend in both texts, less what lies between them. All hits are looked at;
    ``windows`` bounds how many there can be."""
    most: list[float] = []
    for i, (x, a) in enumerate(hits):
        v = float(gram)
        for j in range(i - 1, -1, -1):
            y, b = hits[j]
            if y < x and b < a:
                dx, da = x - y, a - b
                gap, skip = max(0, dx - gram), max(0, da - gram)
                v = max(v, most[j] + min(gram, da, dx) - min(3.0, abs(dx - da)) - 0.5 * max(0, min(gap, skip) - 1))
        most.append(v)
    return max(most)


def _around(p: list[str], w: list[str], x: int, a: int, need: int) -> int:
    """Words of the passage that stand where they should, give or take two, around place ``a`` of the passage and ``x`` of
    the text, no further than ``need`` words away."""
    count = 0
    for i in range(max(0, a - need), min(len(p), a + need + 3)):
        j = x + i - a
        there = w[max(0, j - 2) : j + 3] if j > -3 else []
        count += p[i] in there or any(near(p[i], b) for b in there)
    return count


def aligned(p: list[str], w: list[str], need: int, least_score: float, *, remark: int = 40, remark_cost: int = 3) -> tuple[int, float, int, int] | None:
    """What ``align`` finds if it has ``need`` matched words and ``least_score``, else nothing; row by row in numpy.

    A cell holds 1024 times the score plus the matched words, and beside it the first word of its alignment.
    """
    import numpy as np

    there = set(w)
    if sum(a in there for a in p) + 6 < need:
        return None
    m, one = len(w), 1024
    at: dict[str, list[int]] = {}
    for j, b in enumerate(w):
        at.setdefault(b, []).append(j)
    rows = {}
    for a in set(p):
        hit = np.zeros(m, bool)
        hit[[j for b, js in at.items() if near(a, b) for j in js]] = True
        rows[a] = hit
    places = np.arange(m)
    slope = places * one
    state, first = np.zeros((2, m + 1), np.int64), np.tile(np.arange(m + 1), (2, 1))  # by layer; column 0 stays 0
    best: tuple[int, float, int, int] | None = None
    for a in p:
        new, start = np.zeros((2, m + 1), np.int64), np.zeros((2, m + 1), np.int64)
        fresh = state[:, :-1] < one
        np.multiply(state[:, :-1] * ~fresh + (one + 1), rows[a], out=new[:, 1:])
        start[:, 1:] = np.where(fresh, places, first[:, :-1])
        up = state[:, 1:] - one
        better = up > new[:, 1:]
        new[:, 1:] = np.where(better, up, new[:, 1:])
        start[:, 1:] = np.where(better, first[:, 1:], start[:, 1:])
        for layer in (0, 1):
            x, f = new[layer, 1:], start[layer, 1:]
            if layer:  # over a remark: the best cell of the first layer among the last words
                lead = np.r_[np.zeros(remark - 1, np.int64), new[0, :-1]]
                seen = np.lib.stride_tricks.sliding_window_view(lead, remark)
                top = seen.argmax(axis=1)
                jump = seen[places, top] - remark_cost * one
                better = jump > x
                x[:] = np.where(better, jump, x)
                f[:] = np.where(better, start[0][np.maximum(places + top - remark + 1, 0)], f)
            run = np.maximum.accumulate(x + slope)
            source = np.maximum.accumulate(np.where(x + slope == run, places, 0))
            x[:], f[:] = run - slope, f[source]
            x[x < one] = 0
        words = new & (one - 1)
        good = (words >= need) & (new >= least_score * one)
        if good.any():
            key = np.where(good, words * (1 << 40) + new, -1)
            layer, j = np.unravel_index(int(key.argmax()), key.shape)
            k, s = int(words[layer, j]), int(new[layer, j] >> 10)
            if best is None or (k, s) > best[:2]:
                best = (k, float(s), int(start[layer, j]), int(j) - 1)
        state, first = new, start
    return best


def reaches(cases: list[tuple[list[str], list[str], int, float]], *, remark: int = 40, remark_cost: int = 3) -> list[bool]:
    """Whether some alignment as in ``align`` of each ``(passage, words, need, least score)`` has as many matched words and
    that score. All cases go row by row together, those of like size in one matrix."""
    out = [False] * len(cases)
    # words that do not stand there can only match as slips, of which there are few
    open_ = [i for i, (p, w, need, _) in enumerate(cases) if (there := set(w)) and sum(a in there for a in p) + 6 >= need]
    open_.sort(key=lambda i: (len(cases[i][0]), len(cases[i][1])))
    for s in range(0, len(open_), 64):
        part = open_[s : s + 64]
        for i, good in zip(part, _rows_together([cases[i] for i in part], remark, remark_cost)):
            out[i] = good
    return out


def _rows_together(cases: list[tuple[list[str], list[str], int, float]], remark: int, remark_cost: int) -> list[bool]:
    import numpy as np

    one, k = 1024, len(cases)
    n, m = max(len(p) for p, *_ in cases), max(len(w) for _, w, *_ in cases)
    rows = np.zeros((n, k, m), bool)  # what is added to short ones matches nothing
    for c, (p, w, *_) in enumerate(cases):
        at: dict[str, list[int]] = {}
        for j, b in enumerate(w):
            at.setdefault(b, []).append(j)
        known: dict[str, list[int]] = {}
        for i, a in enumerate(p):
            if a not in known:
                known[a] = [j for b, js in at.items() if near(a, b) for j in js]
            rows[i, c, known[a]] = True
    need = np.array([x[2] for x in cases])[None, :, None]
    least = np.array([x[3] * one for x in cases])[None, :, None]
    slope = np.arange(m, dtype=np.int32) * one
    state = np.zeros((2, k, m + 1), np.int32)  # 1024 times the score plus the matched words, by layer; column 0 stays 0
    found = np.zeros(k, bool)
    for i in range(n):
        new = np.zeros((2, k, m + 1), np.int32)
        np.multiply(state[:, :, :-1] + (one + 1), rows[i], out=new[:, :, 1:])
        np.maximum(new[:, :, 1:], state[:, :, 1:] - one, out=new[:, :, 1:])
        for layer in (0, 1):
            x = new[layer, :, 1:]
            if layer:  # over a remark: the running maximum of the first layer over the last words
                lead = new[0].copy()
                reach = 1
                while reach < min(remark, m):
                    np.maximum(lead[:, reach:], lead[:, :-reach].copy(), out=lead[:, reach:])
                    reach *= 2
                np.maximum(x, lead[:, :-1] - remark_cost * one, out=x)
            x[:] = np.maximum.accumulate(x + slope, axis=1) - slope
            x[x < one] = 0
        found |= (((new & (one - 1)) >= need) & (new >= least)).any(axis=(0, 2))
        state = new
    return found.tolist()


def windows(hits: list[tuple[int, int]], words: int, remark: int = 40) -> list[list[tuple[int, int]]]:
    """Hits (place in the text, place in the passage) of a passage of some ``words``, in order, as groups that an alignment
    can span. A group covers a bounded stretch: a longer one is cut into overlapping ones, each alignment whole in one."""
    span = 2 * words + remark + 5
    groups = [[hits[0]]]
    for h in hits[1:]:
        if h[0] - groups[-1][-1][0] > words + remark + 5:
            groups.append([])
        groups[-1].append(h)
    out = []
    for g in groups:
        a = g[0][0]
        while a <= g[-1][0]:
            part = [h for h in g if a <= h[0] < a + 3 * span] if g[-1][0] - g[0][0] >= 3 * span else g
            if part:
                out.append(part)
            if part is g:
                break
            a += 2 * span
    return out


def find_leaks(docs: DataFrame, items: DataFrame, *, doc_key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", least: int = 12, least_score: float = 6.0, gram: int = 3, most_items: int = 200_000, block_words: int = 2_000_000) -> DataFrame:
    """Documents that hold at least ``least`` words of an item's passage in their order.

    One Aho-Corasick automaton over all runs of ``gram`` words of the normalised passages is built for each block of
    items (``block_words`` words bound what a task holds, ``most_items`` items what the driver holds at a time); each document is normalised and scanned once a block; where
    it meets runs of an item, the stretch around them is aligned with the passage, so that changed, missing and added
    words and one inserted remark are allowed for. Words are folded for case, accents, look-alikes, markup and signs.

    Null and empty texts hold nothing; an item whose passage has fewer than ``least`` words is found if all its words
    stand there; repeated rows give a row each; no items or documents, no rows.
    Result: ``<doc_key>, <item_key>, n_words, score, first_char, end_char`` (the stretch in the original text).
    """
    kinds = docs.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"d {kinds[0]}, i {kinds[1]}, n_words int, score double, first_char long, end_char long"
    source = docs.select(F.col(f"`{doc_key}`").alias("d"), F.col(f"`{text}`").alias("t")).filter(F.length("t") > 0)
    out = docs.sparkSession.createDataFrame([], schema)
    for found in _item_blocks(items, item_key, item_text, most_items):
        block: list[tuple[int, list[str]]] = []
        size = 0
        for n, p in enumerate(found):
            block.append(p)
            size += len(p[1])
            if size > block_words or n == len(found) - 1:
                out = out.unionByName(source.mapInArrow(_scanner(block, gram, least, least_score), schema))
                block, size = [], 0
    return out.withColumnRenamed("d", doc_key).withColumnRenamed("i", item_key)


def _scanner(block: list[tuple[int, list[str]]], gram: int, least: int, least_score: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick
        import numpy as np

        where: dict[str, list[tuple[int, int]]] = {}
        for x, (_, w) in enumerate(block):
            g = min(gram, len(w))
            for a in range(len(w) - g + 1):
                where.setdefault(f" {' '.join(w[a : a + g])} ", []).append((x, a))
        auto = ahocorasick.Automaton()
        for k, v in where.items():
            auto.add_word(k, (k.count(" ") - 1, v))
        if where:
            auto.make_automaton()
        for batch in batches:
            got = []
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first in range(0, len(docs) if where else 0, 500):
                cases: list[tuple[int, int, int, list[str], int, float]] = []
                for d in range(first, min(first + 500, len(docs))):
                    words = words_of(texts[d])
                    hits: dict[int, list[tuple[int, int]]] = {}
                    ends = None
                    for at, (g, places) in auto.iter(f" {' '.join(words)} "):
                        if ends is None:
                            ends = np.cumsum([len(w) + 1 for w in words])
                        last = int(np.searchsorted(ends, at))
                        for x, a in places:
                            hits.setdefault(x, []).append((last - g + 1, a))
                    for x, at in hits.items():
                        p = block[x][1]
                        need = min(least, len(p))
                        at.sort()
                        for g in windows(at, len(p)):
                            # one clean run is enough if all words needed stand around it, though misspelled
                            if _chain(g, gram) < min(need, 5) and max(_around(p, words, x_, a, need) for x_, a in g) < need:
                                continue
                            lo = max(0, g[0][0] - g[0][1] - 15)
                            cases.append((d, x, lo, words[lo : g[-1][0] + len(p) - g[-1][1] + 15], need, min(least_score, need / 2)))
                best: dict[tuple[int, int], tuple] = {}
                for (d, x, lo, there, need, enough), good in zip(cases, reaches([(block[c[1]][1], *c[3:]) for c in cases])):
                    r = aligned(block[x][1], there, need, enough) if good else None
                    if r and ((d, x) not in best or r > best[d, x][0]):
                        best[d, x] = (r, lo)
                spans: dict[int, list[tuple[int, int]]] = {}
                for (d, x), ((k, s, f, e), lo) in best.items():
                    own = spans[d] if d in spans else spans.setdefault(d, spans_of(texts[d]))
                    got.append((docs[d], block[x][0], k, s, own[lo + f][0], own[lo + e][1]))
            cols = list(zip(*got)) if got else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1]) if got else pa.array([], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int64())], ["d", "i", "n_words", "score", "first_char", "end_char"])

    return run
