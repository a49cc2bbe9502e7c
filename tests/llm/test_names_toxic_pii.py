import random

import numpy as np
import pytest

from lumenfold.llm import names, pii, toxic

SAME = [
    "samuel naxowberg", "naxowberg, samuel", "naxowberg samuel", "sam naxowberg", "dr. samuel naxowberg", "samuel k. naxowberg", "samuelnaxowberg", "samuel náxowberg", "samuel naxwberg", "samuel naxovberg", "s. naxowberg", "naxowberg, s."
]
ORG = ["ostlemouth film institute", "film institute of ostlemouth", "film institute ostlemouth", "ofi", "o.f.i.", "ostlemouth film inst.", "the ostlemouth film institute"]
ROLE = ["museum caretaker", "caretaker (museum)", "caretaker of museum", "museum-caretaker", "muse. caretaker", "museum caretkaer"]
ALONE = ["robert naxowberg", "museum teacher", "unknown man", "unknown woman", "mother", "brother", "ostlemouth tram company"]


def test_variants_meet_and_others_do_not(spark):
    rows = [("j", [n.upper() if i % 3 == 0 else f"  {n.replace(' ', '  ')} "], None) for i, n in enumerate(SAME + ORG + ROLE + ALONE)]
    rows += [("j", None, ["", None, " "]), (None, ["samuel naxowberg"], ["sam naxowberg"]), ("k", ["sam naxowberg"], ["mother", "mother"])]
    df = spark.createDataFrame(rows, "journal_id string, named_characters array<string>, characters array<string>")
    got = {(r.journal_id, r.name_a, r.name_b) for r in names.link_names(df, "journal_id", ["named_characters", "characters"]).collect()}
    want = {("j", *sorted(p)) for g in (SAME, ORG, ROLE) for a, x in enumerate(g) for p in [(x, y) for y in g[a + 1 :]]}
    assert got == want


@pytest.mark.parametrize(
    ("names_", "groups"),
    [
        (["acme ltd", "acme limited", "ACME"], [{"acme ltd", "acme limited", "acme"}]),
        (["nordlicht gmbh", "nordlicht", "nordsee gmbh"], [{"nordlicht gmbh", "nordlicht"}]),
        (["bob smithson", "r. smithson", "robert smithson"], [{"bob smithson", "r. smithson", "robert smithson"}]),
        (["r. smithson", "bob smithson"], [{"r. smithson", "bob smithson"}]),
        (["ted smithson", "edward smithson", "theodore smithson"], []),
        (["ulla brandner", "ulrike brandner", "rike brandner"], [{"ulla brandner", "ulrike brandner", "rike brandner"}]),
        (["jim harding", "jimmy harding"], [{"jim harding", "jimmy harding"}]),
        (["sue harding", "suzie harding"], [{"sue harding", "suzie harding"}]),
        (["unknown man", "unknown woman", "old man"], []),
    ],
)
def test_rules(spark, names_, groups):
    df = spark.createDataFrame([("j", names_)], "journal_id string, characters array<string>")
    got = {(r.name_a, r.name_b) for r in names.link_names(df, "journal_id", ["characters"]).collect()}
    assert got == {tuple(sorted((a, b))) for g in groups for a in g for b in g if a != b}


def test_no_names(spark):
    df = spark.createDataFrame([], "journal_id string, named_characters array<string>, characters array<string>")
    assert names.link_names(df, "journal_id", ["named_characters", "characters"]).count() == 0


def test_established_near_names_stay_apart(spark):
    rows = [(f"j{i}", ["ann lindermark"]) for i in range(6)] + [(f"k{i}", ["ann lindevmark"]) for i in range(6)] + [("z", ["ann lindermark", "ann lindevmark"])]
    df = spark.createDataFrame(rows, "journal_id string, named_characters array<string>")
    assert names.link_names(df, "journal_id", ["named_characters"]).count() == 0


@pytest.mark.parametrize(("text", "words"), [("S0rry th1s 1s b4d", "sorry this is bad"), ("n a k e d people", "naked people"), ("Whaaaat", "what"), ("cafÃ© Ünï", "cafe uni"), ("room 12", "room 0"), ("f**k you", "f**k you")])
def test_normal_words(text, words):
    assert " ".join(toxic.normal_words(text)) == words


def texts_and_labels(n=1200):
    rng = random.Random(1)
    plain = ["The clock showed nine.", "We walked to the old harbour.", "My sister painted a door.", "Rain fell upward all night.", "Nobody said a word."]
    bad = {"abusive": ["You are a worthless fool and should vanish."], "hateful": ["All hill people are vermin to be driven out."], "sexual": ["They had wild sex on the floor."]}
    docs, labels = [], []
    for i in range(n):
        s = [rng.choice(plain) for _ in range(5)]
        kind = list(bad)[i % 3] if i % 20 == 0 else None
        if kind:
            s.insert(rng.randrange(5), rng.choice(bad[kind]))
        docs.append((i, " ".join(s), "s" if i % 2 else None, kind))
        labels.append((i, "r", int(kind == "abusive"), int(kind == "hateful"), int(kind == "sexual") if i % 20 == 0 or i % 7 else None))
    return docs, labels


def test_classifier(spark):
    docs, labels = texts_and_labels()
    df = spark.createDataFrame([(*d[:3], 1.5) for d in docs] + [(900, None, "s", 0.0), (901, "", "s", 0.0)], "doc_id long, text string, source string, abusive double")
    lab = spark.createDataFrame(labels + [(5555, "r", 1, 1, 1), (3, None, None, None, None)], "doc_id long, rater string, abusive int, hateful int, sexual int")
    scored = toxic.score_texts(df, lab)
    got = {r.doc_id: {c for c in toxic.CATEGORIES if r[f"{c}_flag"]} for r in scored.collect()}
    wrong = sum(got[d[0]] != ({d[3]} if d[3] else set()) for d in docs)
    assert wrong <= 0.03 * len(docs) and got[900] == got[901] == set()
    assert {r.source: r.documents for r in toxic.rates(scored).collect()} == {None: 600, "s": 602}
    assert toxic.score_texts(df.limit(0), lab).count() == 0
    assert toxic.score_texts(df, lab.limit(0)).filter("abusive > 0").count() == 0


def test_few_ratings_are_enough_for_what_they_show():
    """A sentence that one rated document alone shows is found in others, in spite of wrong ratings."""
    rng = random.Random(2)
    plain = [f"The {a} {b} {c} the {d}." for a in ("old", "red", "wet", "odd") for b in ("clock", "boat", "lamp", "door") for c in ("left", "met", "saw") for d in ("harbour", "garden", "tower")]
    bad = ["You worthless fool should vanish from this earth.", "Shut your filthy mouth you pathetic clown.", "I will break every bone in your body tonight."]
    docs = []
    for i in range(600):
        s = [rng.choice(plain) for _ in range(6)]
        if i % 20 == 0:
            s.insert(3, bad[i // 20 % 3])
        docs.append((" ".join(s), i % 20 == 0))
    rated = [(t, {"abusive": float(y or i == 7), "hateful": None, "sexual": None}) for i, (t, y) in enumerate(docs[:60])]
    m = toxic.train(rated, [t for t, _ in docs], categories=("abusive",))["abusive"]
    found = [max(float(m[0][toxic.features(s)].sum() + m[1] - m[2]) for s in toxic.sentences(t)) >= 0 for t, _ in docs]
    assert sum(f and y for f, (_, y) in zip(found, docs)) >= 28 and sum(f and not y for f, (_, y) in zip(found, docs)) <= 6


def test_risk_is_not_negative():
    p, u = toxic.Rows([[1, 2]] * 5), toxic.Rows([[1, 2]] * 5 + [[3]] * 95)
    w, b = toxic.fit_nnpu(p, u, np.ones(100), 0.05)
    assert w[[1, 2]].sum() + b > 0 > w[3] + b


def test_gradients_by_finite_differences():
    rng = np.random.default_rng(0)
    tags = len(pii.TAGS)
    net = {"table_f": rng.normal(0, 0.3, (pii.SIGNS, 4 * pii.HIDDEN)), "table_b": rng.normal(0, 0.3, (pii.SIGNS, 4 * pii.HIDDEN)), "rec_f": rng.normal(0, 0.2, (pii.HIDDEN, 4 * pii.HIDDEN)), "rec_b": rng.normal(0, 0.2, (pii.HIDDEN, 4 * pii.HIDDEN)), "out": rng.normal(0, 0.3, (2 * pii.HIDDEN, tags)), "bias": rng.normal(0, 0.1, tags), "trans": rng.normal(0, 0.3, (tags, tags))}
    net = {k: v.astype(np.float32) for k, v in net.items()}
    ids, gold = rng.integers(4, 60, (7, 2)), rng.integers(0, tags, (7, 2))
    mask = np.ones((7, 2), bool)
    mask[5:, 1] = False

    def loss():
        return float(pii._crf(pii.emissions(net, ids)[0].astype(np.float64), gold, net["trans"].astype(np.float64), mask)[0])

    score, both, fo, ba = pii.emissions(net, ids, keep=True)
    _, ds, dt = pii._crf(score, gold, net["trans"], mask)
    d_both = ds @ net["out"].T
    tf, rf = pii._lstm_back(ids, net["table_f"], net["rec_f"], *fo, np.ascontiguousarray(d_both[:, :, : pii.HIDDEN]))
    tb, rb = pii._lstm_back(ids[::-1], net["table_b"], net["rec_b"], *ba, np.ascontiguousarray(d_both[::-1, :, pii.HIDDEN :]))
    grads = {"table_f": tf, "rec_f": rf, "table_b": tb, "rec_b": rb, "trans": dt, "bias": ds.sum(axis=(0, 1)), "out": both.reshape(-1, 2 * pii.HIDDEN).T @ ds.reshape(-1, tags)}
    for k, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep, eps = float(net[k][at]), 3e-2
        net[k][at] = keep + eps
        hi = loss()
        net[k][at] = keep - eps
        lo = loss()
        net[k][at] = keep
        assert abs((hi - lo) / (2 * eps) - g[at]) < 0.03 * max(1e-2, abs(g[at])), k


@pytest.fixture(scope="module")
def net():
    rng = random.Random(3)
    first, last = ["Johannes", "Priya", "Édith", "Robert", "Ingrid", "Samuel"], ["Fennarick", "Dovergas", "Hulaquist", "Morackbert", "Zellashaw", "Lindowgast"]
    base = ["the clock was late and we walked to the old harbour before the bell", "My sister painted a door while the rain came in and nobody moved", "Somebody behind me counted 17 steps, then the lamp failed again"]
    texts = [f"{rng.choice(base)}. I told {rng.choice(first)} {rng.choice(last)} about it. {rng.choice(base)}." for _ in range(700)]
    people = [f"{a} {b}" for a in first for b in last]
    return pii.fit(texts, people)


def test_held_out_accuracy(net):
    rng = random.Random(9)
    hit = total = false = 0
    for _ in range(150):
        kind, v = pii._made_up(rng, ["johannes", "priya", "robert", "ingrid"], ["fennarick", "hulaquist", "zellashaw", "dovergas"])
        t = f"We walked to the old harbour. I told {v} about it, then the lamp failed again."
        got = [(k, t[a:b]) for a, b, k in pii.settle(t, pii.decode(net, [t])[0], net["given"])]
        total += 1
        hit += (kind, v) in got
        false += len(got) - ((kind, v) in got)
    assert hit / total > 0.8 and false / total < 0.2


def test_whole_texts_and_round_trip(spark, net):
    far = "the clock was late and we walked to the old harbour. " * 200
    t = far + "I told Priya Hulaquist about it. " + far
    df = spark.createDataFrame([(1, t, 0), (2, None, 0), (3, "", 0), (1, t, 0)], "n long, text string, items int")
    rows = pii.find_personal(df, "n", "text", net).collect()
    for r in rows:
        if r.n != 1:
            assert r["items"] == [] and r.redacted in (None, "")
            continue
        assert ("name", "Priya Hulaquist") in [(i.pii_type, i.value) for i in r["items"]]
        back, text = [], r.redacted
        for i in r["items"]:
            a, _, text = text.partition(f"[{i.pii_type.upper()}]")
            back += [a, i.value]
        assert "".join([*back, text]) == t
    assert sum(r.n == 1 for r in rows) == 2
    assert pii.find_personal(df.limit(0), "n", "text", net).count() == 0


def test_slices_of_long_texts_agree(net):
    t = "The bell rang. I told Priya Hulaquist about it. We walked on. " * 30
    whole = pii.decode(net, [t])[0]
    assert whole and pii.decode_bounded(net, ["x", t, ""], most=400, around=200)[1] == whole


def test_forms():
    t = "Call 1-415-555-0175 ext. 938, write to ann dot lee at post dot example, SSN 918 69 3755, 109 Quillen Court, Mabryahaven 15775. ISBN 978 0 00 000000 0. 2125550 coins."
    got = {(k, t[a:b]) for a, b, k in pii.teacher(t, {"ann"}, {"lee"})}
    assert got == {("phone", "1-415-555-0175 ext. 938"), ("email", "ann dot lee at post dot example"), ("id_number", "918 69 3755"), ("address", "109 Quillen Court, Mabryahaven 15775")}


@pytest.mark.parametrize(
    ("kind", "value"),
    [("address", "Gartenweg 5"), ("address", "Via Roma 12"), ("address", "12 rue de la Paix"), ("address", "5 Elm Terrace"), ("id_number", "12345678Z"), ("email", "kim arroba post punto example")]
    + [("name", n) for n in ("Sean O'Brien", "Ann Smith-Jones", "Ann Li", "ann wu", "Ann\nFennarick", "ann Fennarick", "Zoë D’Arcy")],
)
def test_finds_without_a_form_are_kept(kind, value):
    for before, after in (("We met ", " there."), ("", ""), ("(", "), then")):
        t = before + value + after
        a, b = len(before), len(before) + len(value)
        for x, y in ((a, b), (a + value[:2].isalnum(), b - value[-2:].isalnum())):  # also off by a letter of a word
            assert pii.settle(t, [(x, y, kind)], frozenset({"ann"})) == [(a, b, kind)]


def test_what_cannot_be_of_its_type_is_dropped():
    t = "hahaha 12 walls. Ann Lee's dog. The Smith-like man\n\nAnn called 555."
    assert pii.settle(t, [(0, 6, "email"), (7, 9, "address"), (7, 9, "phone"), (51, 57, "name"), (62, 66, "id_number")]) == []
    assert pii.settle(t, [(17, 26, "name")]) == [(17, 24, "name")]


def test_training_values_are_not_those_of_the_test_tables():
    rng = random.Random(1)
    values = [pii._made_up(rng, ["ann", "bob"], ["fennarick", "hulaquist"]) for _ in range(4000)]
    taken = ("harrow", "larkspur", "saltmarsh", "tamsin", "bramblecote", "quillen", "old mill", "kite-mail", "dreams.invalid", "wexley", "post.example", "20 7946", "0491 570", "01 99 00")
    assert not [v for _, v in values if any(x in v.lower() for x in taken)]
    phones = [v for k, v in values if k == "phone"]
    assert sum("555" in v for v in phones) < 0.1 * len(phones)
