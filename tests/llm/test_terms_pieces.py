import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenfold.llm import pieces, terms


def norm(x):
    return re.sub("^[# ]+", "", " ".join(x.lower().split())).strip()


@pytest.fixture(scope="module")
def lists(spark):
    rng = random.Random(4)
    words = ["#Home", " home ", "Big  Dog", "big dog", "", " ", "#", "été", None, *[f"w{i}" for i in range(12)]]
    rows = [(i, [rng.choice(words) for _ in range(rng.randrange(7))] if i % 9 else None, i) for i in range(300)]
    return rows, spark.createDataFrame(rows, "id int, tags array<string>, term int").repartition(5)


def test_frequencies_by_brute_force(lists):
    rows, df = lists
    occ, rec = Counter(), Counter()
    for _, t, _ in rows:
        n = [norm(x) for x in t or [] if x is not None and norm(x)]
        occ.update(n)
        rec.update(set(n))
    for leaf_mb in (256, 0):  # 0: every part is split again
        got = {r.term: (r.occurrences, r.records) for r in terms.term_frequencies(df, ["tags"], leaf_mb=leaf_mb, bits=2, max_depth=3).collect()}
        assert got == {k: (occ[k], rec[k]) for k in occ}


def test_marks(spark):
    f = spark.createDataFrame([("t", "a", 2, 2), ("t", "b", 9, 3), ("t", "c", 50, 21), ("t", "d", 50, 20)], "field string, term string, occurrences long, records long")
    assert {r.term: r.verdict for r in terms.mark_terms(f, 100).collect()} == {"a": "rare", "b": None, "c": "common", "d": None}


def test_pairs_by_brute_force(lists):
    rows, df = lists
    one, two = Counter(), Counter()
    for _, t, _ in rows:
        s = sorted({norm(x) for x in t or [] if x is not None and norm(x)})
        one.update(s)
        two.update((a, b) for i, a in enumerate(s) for b in s[i + 1 :])
    for flush in (500_000, 8):
        got = {(r.item_a, r.item_b): (r.n, r.n_a, r.n_b, r.n_records) for r in terms.cooccurrence(df, "tags", flush=flush).collect()}
        assert got == {p: (n, one[p[0]], one[p[1]], 300) for p, n in two.items()}


def test_records_of_very_many_items():
    import numpy as np

    for m, most in ((7, 10), (7, 3), (30, 100), (5, 1000)):
        got = [(int(r), int(x), int(y)) for rows, i, j in terms._pair_steps(np.array([100, 200]), m, most) for r in np.ravel(rows) for x, y in zip(i, j)]
        assert sorted(got) == [(r, x, y) for r in (100, 200) for x in range(m) for y in range(x, m)]


def test_combined_in_steps(lists):
    _, df = lists
    a, b = (sorted(map(tuple, terms.term_frequencies(df, ["tags"], combine_rows=n).collect())) for n in (1_000_000, 1))
    assert a == b


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id int, tags array<string>, text string")
    assert terms.term_frequencies(df, ["tags"]).count() == terms.cooccurrence(df, "tags").count() == 0
    assert pieces.split_texts(df, "id", "text").count() == pieces.pack_texts(df, "id", "text").count() == 0


def holds(t, limit, overlap):
    _, s, e, k = pieces._cuts([t], limit, overlap, 0.5)
    if not t:
        assert len(s) == 0
        return
    assert s[0] == 0 and e[-1] == len(t)
    assert all(0 < b - a <= limit for a, b in zip(s, e))
    assert all(s[i] <= e[i - 1] < e[i] and e[i - 1] - s[i] <= overlap for i in range(1, len(s)))
    assert any(len(r) > limit for r in re.findall(r"\S+", t)) == bool((k == 4).any())


def test_cuts_hold_whatever_the_text():
    rng = random.Random(1)
    for n in range(3000):
        t = "".join(rng.choice("aaaaaab .\n" if n % 2 else "aaaaaaaaaaaaab ") for _ in range(rng.randrange(120)))
        limit = rng.randrange(3, 30)
        holds(t, limit, rng.randrange(0, max(1, limit // 2)))


def test_slices_of_a_long_text_agree():
    rng = random.Random(7)
    same = 0
    for n in range(60):
        t = "".join(rng.choice(["word ", "a ", "Longer. ", "end.\n", "\n\n", "x" * rng.choice([3, 9, 70])]) for _ in range(400)).strip()
        limit, overlap = rng.randrange(20, 60), rng.randrange(0, 8)
        a, b = pieces._cuts([t], limit, overlap, 0.5), pieces._long_cuts(t, limit, overlap, 0.5, 300)
        assert b[1][0] == 0 and b[2][-1] == len(t) and all(0 < y - x <= limit for x, y in zip(b[1], b[2]))
        assert all(b[1][i] <= b[2][i - 1] < b[2][i] and b[2][i - 1] - b[1][i] <= overlap for i in range(1, len(b[1])))
        same += all(x.tolist() == y.tolist() for x, y in zip(a, b))
    assert same >= 55


def test_pieces(spark):
    long = "One two three. " * 300 + "\n\n" + "x" * 4000 + " end"
    df = spark.createDataFrame([(1, long, 7), (2, "short", 7), (3, "", 7), (4, None, 7), (2, "short", 8)], "id long, text string, piece int")
    rows = pieces.split_texts(df, "id", "text").collect()
    assert Counter(r.id for r in rows)[2] == 2 and not {3, 4} & {r.id for r in rows}
    own = sorted((r for r in rows if r.id == 1), key=lambda r: r.piece_no)
    assert all(len(r.piece) <= 1500 and r.piece == long[r.first_char : r.end_char] for r in own)
    assert own[0].n_forced > 0 and own[1].first_char == own[0].end_char - 150
    with pytest.raises(ValueError):
        pieces.split_texts(df, "id", "text", limit=10, overlap=10)


def test_best_fit():
    sizes = sorted(random.Random(1).choices(range(1, 2049), k=500), reverse=True)
    where = pieces._best_fit(sizes, 2048)
    fill = Counter()
    for n, b in zip(sizes, where):
        fill[b] += n
    assert max(fill.values()) <= 2048 and len(fill) <= 1.1 * sum(sizes) / 2048 + 1


@pytest.mark.parametrize("last_rows", [20_000, 5])
def test_containers(spark, last_rows):
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice(["moon", "river", "a", "stone"]) for _ in range(rng.choice([3, 40, 300, 1200, 5000])))) for i in range(200)] + [(900, ""), (901, None), (5, "again")]
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    rows = pieces.pack_texts(df, "id", "text", last_rows=last_rows).collect()
    enc = pieces.encoder("/opt/tokenizers/byte_bpe_50k.tiktoken", pieces.BYTE_PATTERN)
    size = Counter()
    for i, t in texts:
        size[i] += len(enc.encode_ordinary(t or ""))
    got, fill = Counter(), Counter()
    for r in rows:
        got[r.id] += r.n_tokens
        fill[r.container] += r.n_tokens
    assert got == +size and max(fill.values()) <= 2048
    many = Counter(r.id for r in rows)
    assert all(many[i] == -(-size[i] // 2048) for i in many if i != 5)
    f = pieces.container_fill(spark.createDataFrame(rows))
    assert f.agg(F.max("unused")).first()[0] < 1
