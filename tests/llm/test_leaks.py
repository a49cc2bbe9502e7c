import pytest

from lumenfold.llm import leaks

PASSAGE = "Once the orchard grows silver every miller confesses that lanterns were only patient rivers beneath a folded sky of copper bells"
OTHER = "Nobody knows why the tailor hides seven clocks under the green bridge before the winter market opens its wooden doors again"


@pytest.fixture(scope="module")
def items(spark):
    ask = "What does the dreamer do last?"
    return spark.createDataFrame([(1, f"Read this. {PASSAGE}. {ask}", 0), (2, f"Read this. {OTHER}. {ask}", 0), (3, f"Read this. Third passage has its own words entirely here. {ask}", 0), (4, None, 0), (5, "", 0)], "item_id long, text string, doc_id int")


def found(spark, items, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return sorted((r.doc_id, r.item_id) for r in leaks.find_leaks(df, items).collect())


def test_ways_to_write_a_passage(spark, items):
    w = PASSAGE.split()
    texts = [
        f"Before. {PASSAGE}. After.",
        PASSAGE.upper().replace(" ", "\n> "),
        "<p>" + PASSAGE.replace("silver", "<b>sil</b>ver").replace("every", "every&nbsp;") + "</p>",
        PASSAGE.replace("o", "о").replace("every", "eve​ry"),
        " ".join(w[:8]) + " (and here I had to stop and drink a glass of cold water) " + " ".join(w[8:]),
        PASSAGE.replace("confesses", "confeses").replace("only ", "").replace("patient", "really patient"),
        " ".join(w[4:17]),
        PASSAGE.replace("every", f'<a href="{"x" * 900}">every</a>'),
    ]
    assert found(spark, items, *texts) == [(i, 1) for i in range(len(texts))]


def test_what_is_no_leak(spark, items):
    w = PASSAGE.split()
    assert found(spark, items, " ".join(w[:8]), "Read this. What does the dreamer do last?", " ".join(reversed(w)), "", None, "every second word " + " x y z ".join(w)) == []


def test_long_text_and_repeats(spark, items):
    t = "filler words here " * 20_000 + OTHER
    assert found(spark, items, t, t) == [(0, 2), (1, 2)]
    df = spark.createDataFrame([(1, t)], "doc_id long, text string")
    r = leaks.find_leaks(df, items).first()
    assert t[r.first_char : r.end_char] == OTHER and r.n_words == len(OTHER.split())


def test_blocks_agree_and_empty_tables(spark, items):
    df = spark.createDataFrame([(1, PASSAGE), (2, OTHER)], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in leaks.find_leaks(df, items, block_words=1).collect()) == [(1, 1), (2, 2)]
    assert sorted((r.doc_id, r.item_id) for r in leaks.find_leaks(df, items, most_items=1).collect()) == [(1, 1), (2, 2)]
    asked = spark.createDataFrame([(7, "Read this. What does the dreamer do last?")], "doc_id long, text string")
    assert leaks.find_leaks(asked, items, most_items=1, least=3).count() == 0  # standard sentences are known over all blocks
    assert leaks.find_leaks(df.limit(0), items).count() == leaks.find_leaks(df, items.limit(0)).count() == 0


def test_quick_test_agrees_with_alignment():
    import random

    rng = random.Random(3)
    vocab = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "lambda"]
    for _ in range(200):
        p = [rng.choice(vocab) for _ in range(14)]
        w = [rng.choice(vocab) for _ in range(10)] + [x for x in p if rng.random() < 0.85] + [rng.choice(vocab) for _ in range(5)]
        k, s, _, _ = leaks.align(p, w, 8)
        assert leaks.reaches([(p, w, 8, 5)])[0] >= (k >= 8 and s >= 5)


def test_cases_together_are_as_one_by_one():
    import random

    rng = random.Random(8)
    vocab = [f"word{i}" for i in range(25)]
    cases = []
    for _ in range(150):
        p = [rng.choice(vocab) for _ in range(rng.randrange(5, 30))]
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 20))] + [x for x in p if rng.random() < rng.choice([0.5, 0.9])]
        cases.append((p, w or ["x"], min(12, len(p)), 6.0))
    got = leaks.reaches(cases)
    assert got == [leaks.reaches([c])[0] for c in cases] == [leaks.aligned(*c) is not None for c in cases] and 20 < sum(got) < 140


def test_alignment_in_rows_agrees_with_the_table():
    import random

    rng = random.Random(5)
    vocab = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "lambda", *[f"w{i}" for i in range(30)]]
    same = 0
    for n in range(150):
        p = [rng.choice(vocab) for _ in range(18)]
        mid = [x for x in p if rng.random() < 0.9]
        mid[6:6] = ["zz"] * (20 if n % 3 == 0 else 0)
        w = [rng.choice(vocab) for _ in range(12)] + mid + [rng.choice(vocab) for _ in range(9)]
        want, got = leaks.align(p, w, 8), leaks.aligned(p, w, 8, 4)
        assert (got is None) == (want[0] < 8 or want[1] < 4)
        if got:
            assert got[0] >= want[0] and 0 <= got[2] <= got[3] < len(w)
            same += got == want
    assert same > 120


def test_stretches_are_bounded_and_lose_nothing():
    hits = [(i, i % 20) for i in range(0, 5000, 2)]
    parts = leaks.windows(hits, 20)
    assert {h for g in parts for h in g} == set(hits) and max(g[-1][0] - g[0][0] for g in parts) <= 3 * 85
    assert all(any(g[0][0] <= a and a + 65 <= g[-1][0] + 2 for g in parts) for a in range(0, 4900, 7))


def test_one_clean_run_and_repeats(spark, items):
    w = PASSAGE.split()
    slips = w[:12]
    for i in (3, 6, 9):
        slips[i] = slips[i][:-1] + "q"
    assert found(spark, items, " ".join(slips), "once the orchard " * 400 + PASSAGE + " once the orchard" * 400) == [(0, 1), (1, 1)]
