"""Abusive, hateful and sexual content: linear classifiers trained by non-negative positive-unlabelled learning."""

from __future__ import annotations

import pickle
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CATEGORIES = ("abusive", "hateful", "sexual")
BITS = 18
#: Digits and signs that stand for letters.
LEET = str.maketrans("013457@$!|", "oieastasil")
_PART = re.compile(r"(?<=[.!?…])[\s\"'»”)\]]+|[\r\n]+|<br\s*/?>|</?p>")
_WORD = re.compile(r"[\w@$!|*]+(?:['’][\w]+)*")


def normal_words(sentence: str) -> list[str]:
    """Words in lower case without accents; digits for letters, stretched and spaced letters undone."""
    if "Ã" in sentence or "Â" in sentence:  # UTF-8 once read as Latin-1
        sentence = re.sub("[\u00c2-\u00df][\u0080-\u00bf]", lambda m: m.group().encode("latin-1").decode("utf-8", "replace"), sentence)
    s = unicodedata.normalize("NFKD", re.sub("[\u200b-\u200d\ufeff\xad]", "", sentence).lower())
    s = "".join(c for c in s if not unicodedata.combining(c))
    s = re.sub(r"(?<!\w)((?:\w[ .\-_*]){2,}\w)(?!\w)", lambda m: re.sub(r"[ .\-_*]", "", m.group()) if not m.group()[0].isdigit() else m.group(), s)
    out = []
    words = [w for w in (w.strip("!|'’") for w in _WORD.findall(s)) if w]
    mixed = sum(1 for w in words if len(w) > 2 and any(c.isalpha() for c in w) and any(c in "013457@$" for c in w)) > 1
    for w in words:
        if mixed or any(c.isalpha() for c in w) and not w.isalpha():
            w = w.translate(LEET)
        if w.isdigit():
            w = "0"
        out.append(re.sub(r"(\w)\1{2,}", r"\1", w))
    return out


def sentences(text: str, most: int = 30, step: int = 12) -> list[list[str]]:
    """Normal words by sentence; a long one as overlapping windows of ``2 * step`` words, so that nothing is lost."""
    out = []
    for part in _PART.split(text):
        w = normal_words(part) if part else []
        if len(w) > most:
            out += [w[i : i + 2 * step] for i in range(0, len(w) - step, step)]
        elif w:
            out.append(w)
    return out


def features(words: list[str]) -> list[int]:
    """Hashed single words, pairs and triples, each once."""
    mask = (1 << BITS) - 1
    w = ["^", *words, "$"]
    got = {zlib.crc32(x.encode()) & mask for x in words}
    got |= {zlib.crc32(f"{a} {b}".encode()) & mask for a, b in zip(w, w[1:])}
    got |= {zlib.crc32(f"{a} {b} {c}".encode()) & mask for a, b, c in zip(w, w[1:], w[2:])}
    return list(got)


class Rows:
    """Sparse binary rows."""

    def __init__(self, lists: list[list[int]]):
        import numpy as np

        self.n = len(lists)
        self.start = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int64)
        self.at = np.fromiter((v for x in lists for v in x), np.int64, int(self.start[-1]))
        self.row = np.repeat(np.arange(self.n), np.diff(self.start))

    def dot(self, w):
        import numpy as np

        return np.bincount(self.row, w[self.at], self.n)

    def back(self, g):
        import numpy as np

        return np.bincount(self.at, g[self.row], 1 << BITS)


def fit_nnpu(p: Rows, u: Rows, u_weight, prior: float, *, steps: int = 120, rate: float = 0.15, ridge: float = 2e-5):
    """Logistic scorer of least non-negative positive-unlabelled risk: prior R+(P) + max(0, R-(U) - prior R-(P)).

    While the negative part is below zero its gradient is turned round. Adam on full batches, started at zero.
    """
    import numpy as np

    w, bias = np.zeros(1 << BITS), -2.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    share = u_weight / u_weight.sum()
    for t in range(1, steps + 1):
        sp, su = p.dot(w) + bias, u.dot(w) + bias
        ep, eu = 1 / (1 + np.exp(-sp)), 1 / (1 + np.exp(-su))
        negative = float((share * np.logaddexp(0, su)).sum() - prior * np.logaddexp(0, sp).mean())
        # logistic loss: d/ds of the positive part is -(1 - e), of the negative part e
        gp, gu = -prior * (1 - ep) / p.n, np.zeros(u.n)
        if negative >= 0:
            gp -= prior * ep / p.n
            gu = share * eu
        else:
            gp, gu = prior * ep / p.n, -share * eu
        g, gb = p.back(gp) + u.back(gu) + ridge * w, float(gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-7)
    return w, bias


def _evidence(p_docs: list[list[list[str]]], n_docs: list[list[list[str]]], u_docs: list[list[list[str]]]):
    """What speaks for a sentence of a positive document before anything is learned: log odds of its features in positive
    against unlabelled documents, less where documents rated otherwise have them. Returns a function that gives the mean
    of the eight most telling features, and that of all."""
    import numpy as np

    def spread(docs: list[list[list[str]]]) -> Counter[int]:
        return Counter(f for d in docs for f in {f for s in d for f in features(s)})

    pos, neg, rest = spread(p_docs), spread(n_docs), spread(u_docs)
    a, b = max(1, len(p_docs)), max(1, len(u_docs))

    def of(s: list[str]) -> tuple[float, float]:
        v = sorted((float(np.log(pos[f] / a) - np.log((rest[f] + 3) / b)) - 2 * min(neg[f], 2) for f in features(s)), reverse=True)
        return float(np.mean(v[:8])), float(np.mean(v))

    return of


def _common(lists: list[list[int]], sure: list[bool], least: int = 2) -> Rows:
    """Rows without features of fewer than ``least`` of them, but those of ``sure`` rows: what one document alone says is no
    evidence unless much else speaks for it."""
    n = Counter(f for x in lists for f in x)
    return Rows([[f for f in x if s or n[f] >= least] for x, s in zip(lists, sure)])


def train(labelled: list[tuple[str, dict[str, float]]], unlabelled: list[str], *, rounds: int = 2, folds: int = 3, prior: float = 0.005, doubt: float = 0.4, telling: float = 1.7, whole: float = -1.0, categories: tuple[str, ...] = CATEGORIES) -> dict:
    """One scorer a category from confirmed documents and unlabelled text.

    A label holds for a document, but a sentence earns it: in each round the best sentence of each positive document,
    as a scorer trained without this document sees it, is its positive example; all sentences of the unlabelled texts
    are unlabelled; and the prior of the next round is the share of those found positive. As raters err, documents in
    which the other documents' scorer finds nothing are left out, at most a share of ``doubt``, and those whose
    sentence most rated documents hold without this label; but documents with a sentence whose features hardly stand in
    unlabelled documents and in those rated otherwise (``_evidence`` above ``telling`` and ``whole``) stay, as where
    ratings are few no other document tells of such a sentence. The threshold is low among those of the best F1 over the
    labelled documents, but above what a text without any known feature scores.
    """
    import numpy as np

    u_docs = [sentences(t) for t in unlabelled]
    l_docs = [sentences(t) for t, _ in labelled]
    uniq = Counter(" ".join(s) for d in u_docs for s in d)
    u_rows = Rows([features(s.split(" ")) for s in uniq])
    weight = np.array([float(n) for n in uniq.values()])
    rated: Counter[tuple[str, str]] = Counter()
    seen: Counter[tuple[str, str]] = Counter()
    for d, (_, y) in zip(l_docs, labelled):
        for x in {" ".join(q) for q in d}:
            for c in CATEGORIES:
                if y.get(c) is not None:
                    rated[c, x] += 1
                    seen[c, x] += y[c] > 0.5
    out: dict = {}
    told: Counter[str] = Counter()
    for c in categories:
        marks = [y.get(c) for _, y in labelled]
        docs = [d for d, y in zip(l_docs, marks) if y is not None and y > 0.5 and d]
        if len(docs) < 3 or not uniq:
            out[c] = None
            continue
        others = [d for d, y in zip(l_docs, marks) if y is not None and y <= 0.5 and d]
        speaks = _evidence(docs, others, u_docs)
        pick = [max(d, key=speaks) for d in docs]
        sure = [v >= telling and w >= whole for v, w in map(speaks, pick)]
        fold = np.arange(len(docs)) % folds
        kept, p0 = np.ones(len(docs), bool), prior
        for _ in range(rounds):
            score = np.full(len(docs), -20.0)
            for k in range(folds):
                own = np.flatnonzero(kept & (fold != k))
                own = own if len(own) else np.flatnonzero(fold != k)
                w, bias = fit_nnpu(_common([features(pick[i]) for i in own], [sure[i] for i in own]), u_rows, weight, p0, steps=40)
                for i in np.flatnonzero(fold == k):
                    v = [float(w[features(s)].sum() + bias) for s in docs[i]]
                    score[i] = max(v)
                    if not sure[i] or score[i] > 0:
                        pick[i] = docs[i][int(np.argmax(v))]
            kept = (score >= min(0.0, float(np.quantile(score, doubt)))) | np.array(sure)
            # a sentence that stands in several rated documents, most of them without this label, did not earn it
            kept &= np.array([seen[c, x] * 2 >= rated[c, x] or rated[c, x] < 3 for x in (" ".join(q) for q in pick)])
            kept = kept if kept.any() else np.ones(len(docs), bool)
            found = float((weight * (u_rows.dot(w) + bias > 0)).sum() / weight.sum())
            p0 = float(np.clip(found, prior / 10, 0.2))
        w, bias = fit_nnpu(_common([features(pick[i]) for i in np.flatnonzero(kept)], [sure[i] for i in np.flatnonzero(kept)]), u_rows, weight, p0)
        top = np.array([max((float(w[features(s)].sum() + bias) for s in d), default=-20.0) for d in l_docs])
        y = np.array([np.nan if m is None else float(m > 0.5) for m in marks])
        known = ~np.isnan(y)
        grid = np.arange(-4, 6.1, 0.25)
        f1 = [2 * ((top >= t) & (y == 1)).sum() / max(1, (top[known] >= t).sum() + (y == 1).sum()) for t in grid]
        good = grid[np.array(f1) >= max(f1) - 0.005]
        out[c] = (w.astype(np.float32), bias, max(float(np.quantile(good, 0.35)), bias + 1.2))
        told.update(x for i in np.flatnonzero(kept) for x in pick[i] if "*" not in x)
    out["told"] = told
    return out


def _joined(parts: list[dict]) -> dict:
    """Scorers of all categories, and the words of their examples by length, the most frequent first."""
    told: Counter[str] = sum((p["told"] for p in parts), Counter())
    known: dict[int, list[str]] = {}
    for x, _ in sorted(told.items(), key=lambda v: (-v[1], v[0])):
        known.setdefault(len(x), []).append(x)
    return {c: p[c] for p in parts for c in p if c != "told"} | {"known": known}


def unmask(words: list[str], known: dict[int, list[str]]) -> list[str]:
    """Words with starred letters as the most frequent fitting word of the confirmed examples."""
    if not any("*" in w.strip("*") for w in words):
        return words
    out = []
    for w in words:
        if "*" in w.strip("*"):
            w = next((k for k in known.get(len(w), []) if all(a in ("*", b) for a, b in zip(w, k))), w)
        out.append(w)
    return out


def _window(text: str, chars: int):
    """At most ``chars`` characters of a text, from a place that a hash of it names; for training only."""
    start = F.pmod(F.xxhash64(text), F.greatest(F.length(text) - chars, F.lit(1)).cast("long")).cast("int") + 1
    return F.substring(F.col(text), start, F.lit(chars)).alias(text)


def _fitted(docs: DataFrame, labels: DataFrame, most_labelled: int, most_unlabelled: int, most_chars: int):
    spark = docs.sparkSession
    ratings = labels.groupBy("doc_id").agg(*[F.avg(c).alias(c) for c in CATEGORIES])
    n_labelled, n_docs = ratings.count(), docs.count()
    some = F.pmod(F.xxhash64(F.lit("rated"), "doc_id"), F.lit(1 << 20)) < int(min(1.0, most_labelled / max(1, n_labelled)) * (1 << 20))
    few = F.pmod(F.xxhash64(F.lit("plain"), "doc_id"), F.lit(1 << 20)) < int(min(1.0, most_unlabelled / max(1, n_docs)) * (1 << 20))
    ratings = ratings.filter(some)
    ratings = F.broadcast(ratings) if n_labelled <= 1_000_000 else ratings
    text = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    # bounded by rows, and by characters a row; a label needs its whole text
    rated = text.filter(F.length("text") <= most_chars).join(ratings, "doc_id").select("text", *CATEGORIES, F.lit(True).alias("rated"))
    plain = text.filter(few).select(_window("text", most_chars // 2), *[F.lit(None).cast("double").alias(c) for c in CATEGORIES], F.lit(False).alias("rated"))

    def fit(key, table):
        c = key[0].as_py()
        rows = table.to_pylist()
        known = sorted(((r["text"], {x: r[x] for x in CATEGORIES}) for r in rows if r["rated"]), key=lambda x: x[0])
        rest = sorted(r["text"] for r in rows if not r["rated"])
        return pa.table({"model": pa.array([pickle.dumps(train(known, rest, categories=(c,)))], pa.binary())})

    # one task a category; the sample does not pass through the driver
    sample = rated.unionByName(plain).withColumn("category", F.explode(F.array(*map(F.lit, CATEGORIES))))
    jobs = sample.repartitionByRange(len(CATEGORIES), "category").groupBy("category").applyInArrow(fit, "model binary")
    parts = [pickle.loads(bytes(r[0])) for r in jobs.collect()]
    joined = _joined(parts) if parts else {"known": {}}
    return spark.sparkContext.broadcast({c: None for c in CATEGORIES} | joined)  # bounded: 3 x 2^18 weights, words of the sample


def score_texts(docs: DataFrame, labels: DataFrame, *, most_labelled: int = 12_000, most_unlabelled: int = 8_000, most_chars: int = 8_000) -> DataFrame:
    """A score for each category of each document, and whether it applies.

    The classifiers are fitted to at most about ``most_labelled`` rated documents of up to ``most_chars`` characters and
    windows of half of that from ``most_unlabelled`` others, chosen by a hash of the key, in one task a category; every
    document is scored in whole, by its most telling sentence. A sentence that just reaches one category (a logit under
    1) and is far beyond the threshold of another (2.5 logits more) counts for the other only, as sentences of one kind
    have words of the other.

    Null and empty texts score 0; ratings that are null or of unknown documents are not used; a category with fewer
    than 3 confirmed documents scores 0 everywhere; documents that occur twice come out twice; no documents, no rows.
    Result: ``doc_id, source, <category> double, <category>_flag boolean``.
    """
    model = _fitted(docs, labels, most_labelled, most_unlabelled, most_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        fitted = model.value
        use = [c for c in CATEGORIES if fitted[c]]
        if use:
            w = np.stack([fitted[c][0] for c in use], axis=1)
            margin = 2.5
            shift = np.array([fitted[c][1] - fitted[c][2] for c in use])
        seen: dict[str, object] = {}
        for batch in batches:
            cols = {c: np.zeros(batch.num_rows) for c in CATEGORIES}
            for r, t in enumerate(batch.column("text").to_pylist()):
                if not t or not use:
                    continue
                best = None
                for s in sentences(t):
                    key = " ".join(s)
                    v = seen.get(key)
                    if v is None:
                        v = w[features(unmask(s, fitted["known"]))].sum(axis=0) + shift
                        v = v - 5.0 * ((v < v.max() - margin) & (v < 1))  # just there and far behind another category
                        if len(seen) < 100_000:
                            seen[key] = v
                    best = v if best is None else np.maximum(best, v)
                if best is not None:
                    for c, x in zip(use, 1 / (1 + np.exp(-best))):
                        cols[c][r] = x
            arrays = [pa.array(cols[c]) for c in CATEGORIES]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), *arrays, *[pa.array(cols[c] >= 0.5) for c in CATEGORIES]], ["doc_id", "source", *CATEGORIES, *[f"{c}_flag" for c in CATEGORIES]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, source string, " + ", ".join([*[f"{c} double" for c in CATEGORIES], *[f"{c}_flag boolean" for c in CATEGORIES]])
    return docs.select("doc_id", "source", "text").mapInArrow(run, schema)


def rates(scored: DataFrame) -> DataFrame:
    """Share of documents by source to which each category applies; a null source is a source."""
    return scored.groupBy("source").agg(F.count("*").alias("documents"), *[F.avg(F.col(f"{c}_flag").cast("double")).alias(f"{c}_rate") for c in CATEGORIES])
