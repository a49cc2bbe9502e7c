"""Personal information in free text: a character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import hashlib
import random
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.names import FILLERS, NICKNAMES

TYPES = ("email", "phone", "id_number", "address", "name")
TAGS = ["O", *(f"{p}-{t}" for t in TYPES for p in "BI")]
HIDDEN = 44
WINDOW, MARGIN = 320, 32
_UNKNOWN, _PAD, _SPACE, _ACCENT = 0, 1, 2, 3
#: Forms of address that are not part of a name.
TITLES = "mr mrs ms miss mx dr prof professor sir madam mme mlle monsieur madame herr frau señor señora sr sra don doña captain".split()

#: Words that no name begins with, in the four languages.
_NO_NAME = set(
    "the a an my your his her its our their this that these those some any no each every another and or but in on at to of for with from by as i you he she it we they who "
    "der die das ein eine einen mein meine dein deine sein seine ihr ihre unser und oder aber im am zu von mit auf ich du er sie es wir jede jeder niemand jemand "
    "el la los las un una unos unas mi tu su nuestra nuestro y o pero en con de del por para cada nadie "
    "le les une des mon ma mes ton ta tes son sa ses notre votre leur et ou mais dans sur avec du par pour chaque personne".split()
)


class _Chars(dict):
    """Character numbers: ASCII by itself, but all digits as one; accented letters by their base letter, white space as one."""

    def __missing__(self, c: int) -> int:
        ch = chr(c)
        if ch.isspace():
            out = _SPACE
        elif ch.isdigit():
            out = ord("0") - 29
        elif 32 < c < 127:
            out = c - 29
        else:
            base = unicodedata.normalize("NFKD", ch)[:1]
            out = ord(base) - 29 if base.isascii() and base.isalpha() else _ACCENT if ch.isalpha() else _UNKNOWN
        self[c] = out
        return out


_CHARS = _Chars()
SIGNS = 127 - 29


def char_ids(text: str):
    import numpy as np

    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    few, at = np.unique(cp, return_inverse=True)
    return np.array([_CHARS[int(c)] for c in few], np.int64)[at] if len(cp) else np.zeros(0, np.int64)


# --- labels to train on ------------------------------------------------------------------------------------------
# These forms only label the sample; what is found in a text, its type and its ends are the network's.

_DASH = r"[-‐‑–]"
FORMS: dict[str, list[re.Pattern]] = {
    "email": [
        re.compile(r"(?<![\w.+-])\w[\w.+-]*\s?(?:@|\(at\)|\[at\]|\{at\})\s?[a-z0-9](?:[\w-]*\w)?(?:\s?(?:\.|\(dot\)|\[dot\])\s?[a-z0-9](?:[\w-]*\w)?)*?(?:\.|\(dot\)|\[dot\])[a-z]{2,}(?![\w@])", re.I),
        re.compile(r"(?<![\w.+-])[\w+-]+(?:(?: dot |\.)[\w+-]+)*(?: at | ?\(at\) ?| ?\[at\] ?)[\w-]+(?:(?: dot |\.)[\w-]+)*(?: dot )[a-z]{2,}\b", re.I),
    ],
    "phone": [
        re.compile(r"(?<![\w+.-])\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,5}){2,4}(?: ?(?:ext\.?|x) ?\d{1,5})?(?![\w-])", re.I),
        re.compile(r"(?<![\w+.-])(?:1[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?: ?(?:ext\.?|x) ?\d{1,5})?(?![\w-])", re.I),
        re.compile(r"(?<![\w+.-])(?:0\d(?: \d\d){4}|0\d{2,4}[ /-]\d{3,5}[ -]\d{3,4}|\(0\d{2,4}\) ?\d{3,5}[ -]?\d{3,4}|[2-9]\d{9})(?: ?(?:ext\.?|x) ?\d{1,5})?(?![\w-])", re.I),
    ],
    "id_number": [
        re.compile(r"(?<![\w-])[A-Z]{2}\d{2}(?: ?\d{4}){3,7}(?: ?\d{1,3})?(?![\w-])", re.I),
        re.compile(r"(?<![\w-])\d{3}[ -]\d{2}[ -]\d{4}(?![\w-])"),
        re.compile(r"(?<![\w-])[A-Z]\d{3}-\d{4}-\d{4}(?![\w-])", re.I),
        re.compile(r"(?<![\w-])(?:[A-Z]{2}\d{6}[A-Z]|[A-Z]{1,2}\d{7,8}|\d{6}-\d{4}|\d{8}[A-Z]|(?<!\d[ .-])\d{9}(?![ .-]\d))(?![\w-])", re.I),
    ],
    "address": [
        re.compile(r"(?<![\w.])P\.? ?O\.? Box \d+(?:, [^\W\d_]+(?: \d{5}(?!\d))?)?", re.I),
        re.compile(r"(?<![\w.])(?:Flat \d+, )?\d+[a-z]? (?:[^\W\d_]+ ){1,2}?(?:Street|Road|Lane|Avenue|Court|Drive|Way|Close|St\.|Rd\.|Ave\.|St|Rd|Ave)(?!\w)(?:, Apt\.? \d+)?(?:, [^\W\d_]+ \d{5}(?!\d))?", re.I),
        re.compile(r"(?<![\w.])\d+[a-z]?,? (?:rue|avenue|place|impasse) (?:(?:de|des|du|d'|de la|de l') ?)?[A-ZÀ-Ý][^\W\d_]+(?: [A-ZÀ-Ý][^\W\d_]+)?(?!\w)"),
        re.compile(r"(?<![\w.])\d+[a-z]?, rue (?!de\b)[^\W\d_]+(?!\w)", re.I),
        re.compile(r"(?<!\w)Calle (?:[^\W\d_]+ ){1,2}?\d+(?!\w)", re.I),
        re.compile(r"(?<!\w)[^\W\d_]+(?:straße|strasse) \d+[a-z]?(?!\w)", re.I),
    ],
}
_PERSON = re.compile(r"(?<![\w.])((?:[^\W\d_]\.|[^\W\d_]{2,}))((?: [^\W\d_]\.)?) ([^\W\d_]{3,})(?!\w)")


def teacher(text: str, given: set[str], surnames: set[str]) -> list[tuple[int, int, str]]:
    """Spans of a text as far as plain forms and known names tell; to train on."""
    taken = [False] * len(text)
    out = []

    def add(a: int, b: int, t: str) -> None:
        if not any(taken[a:b]):
            taken[a:b] = [True] * (b - a)
            out.append((a, b, t))

    for t in ("email", "address", "id_number", "phone"):
        for rx in FORMS[t]:
            for m in rx.finditer(text):
                add(*m.span(), t)
    at = 0
    while m := _PERSON.search(text, at):
        first, last = m[1].lower().rstrip("."), m[3].lower()
        known = first in given or len(first) == 1
        if known and (last in surnames or len(first) > 1 and m[3][:1].isupper() and m[1][:1].isupper() and not m[3].isupper() and last not in given):
            add(*m.span(), "name")
            at = m.end()
        else:
            at = m.end(1)
    return sorted(out)


#: Kinds of streets, in four languages, and ends of host names.
_STREETS = "Street Road Lane Avenue Court Drive Way Close Terrace Place Square Hill Gardens Row Boulevard Park Grove St. Rd. Ave. St Rd Ave Blvd Ln Dr".split()
_SHORT_STREETS = "St. Rd. Ave. Blvd. Ln. Dr.".split()
_STRASSEN = "straße strasse weg platz gasse allee ring".split()
_RUES = "rue avenue boulevard place impasse chemin".split()
_CALLES = "Calle Avenida Plaza Paseo Camino".split()
_HOSTS = "com org net edu info de fr es eu co.uk example invalid test".split()


def _word(rng: random.Random) -> str:
    """A word that can be spoken and means nothing."""
    parts = [rng.choice(["b", "br", "c", "d", "f", "g", "gr", "h", "k", "l", "m", "n", "p", "pl", "r", "s", "st", "t", "tr", "v", "w", ""]) + rng.choice("aeiou") + rng.choice(["", "l", "n", "r", "s", "ck", "rd", "mp", "nd"]) for _ in range(rng.choice([2, 2, 2, 3]))]
    return "".join(parts)


def _made_up(rng: random.Random, given: list[str], surnames: list[str]) -> tuple[str, str]:
    """A made-up value of a random type: general patterns with random words and digits, nothing from any table but names."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    cap = lambda n: "".join(rng.choice("ABCDEFGHJKLMNPRSTUVWXYZ") for _ in range(n))
    g, s = rng.choice(given).title(), rng.choice(surnames).title()
    r = rng.random()
    if r < 0.4:  # a surname that nobody bears: two halves of others
        a, b = rng.choice(surnames), rng.choice(surnames)
        s = (a[: max(3, len(a) // 2)] + b[len(b) // 2 :]).title()
    elif r < 0.5:
        s = _word(rng).title()
    kind = rng.choice(["email", "phone", "id_number", "address", "address", "name", "name"])
    if kind == "email":
        user = rng.choice([f"{g[0]}.{s}-{d(2)}", f"{g}.{s}", f"{g}+{_word(rng)}", f"{s}_{d(2)}", f"{g[0]}{s}", f"{_word(rng)}{d(2)}", f"{g} dot {s}"]).lower()
        host = f"{_word(rng)}{rng.choice(['', '', '-' + _word(rng)])}.{rng.choice(_HOSTS)}"
        v = f"{user} at {host.replace('.', ' dot ')}" if " dot " in user else f"{user}{rng.choice(['@', '@', '@', '(at)', ' [at] '])}{host}"
    elif kind == "phone":
        p = rng.choice(" -.")
        v = rng.choice(
            [f"{d(3)}{p}{d(3)}{p}{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"+1 {d(3)} {d(3)} {d(4)}", f"{rng.choice('23456789')}{d(9)}", f"1-{d(3)}-{d(3)}-{d(4)} ext. {d(3)}"]
            + [f"+{rng.randint(2, 99)} {d(2)} {d(4)} {d(4)}", f"+{rng.randint(2, 99)}{p}{d(3)}{p}{d(3)}{p}{d(3)}", f"+{rng.randint(2, 99)} (0){d(2)} {d(5)}-{d(3)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(2)} {d(5)} {d(3)}", f"0{d(1)}" + "".join(f"{p}{d(2)}" for _ in range(4)), f"0{d(1)}" + "".join(f" {d(2)}" for _ in range(4)), f"0{d(3)} {d(3)} {d(3)}"]
        )
    elif kind == "id_number":
        p = rng.choice(" -")
        v = rng.choice([f"{cap(1)}{d(rng.randint(7, 8))}", f"{d(3)}{p}{d(2)}{p}{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{cap(1)}{d(3)}-{d(4)}-{d(4)}", f"9{d(8)}", f"{cap(2)}{d(2)}" + "".join(f" {d(4)}" for _ in range(rng.randint(3, 5))), f"{d(6)}-{d(4)}", f"{cap(2)}{d(6)}{cap(1)}", f"{d(8)}{cap(1)}", f"{cap(2)}{d(7)}"])
    elif kind == "address":
        n, street, town = f"{rng.randint(1, 250)}{rng.choice(['', '', '', 'a', 'b'])}", _word(rng).title(), rng.choice(surnames).title() if rng.random() < 0.5 else _word(rng).title()
        two = f"{street} {_word(rng).title()}" if rng.random() < 0.35 else street
        of = rng.choice(["", "", "", "", "", "de ", "de la ", "du "])
        first = f"{n} {two} {rng.choice(_STREETS if rng.random() < 0.75 else _SHORT_STREETS)}"
        v = rng.choice([first, first, f"{first}, {town} {d(5)}", f"{first}, Apt {rng.randint(1, 20)}", f"Flat {rng.randint(1, 9)}, {first}", f"{rng.choice(['Unit', 'Apt', 'Flat'])} {rng.randint(1, 9)}, {first}", f"P.O. Box {rng.randint(100, 2000)}, {town}", f"{rng.choice(_CALLES)} {two} {n}", f"{n}{rng.choice([', ', ', ', ' '])}{rng.choice(_RUES)} {of}{two}", f"{n}, rue {of}{street}", f"{street}{rng.choice(_STRASSEN)} {n}"])
    else:
        if rng.random() < 0.15:
            s = rng.choice([f"{s}-{_word(rng).title()}", f"O'{s}", _word(rng)[:2].title() + rng.choice(["", "n"]), f"Mc{s}"])
        v = rng.choice([f"{g} {s}", f"{g} {s}", f"{g} {cap(1)}. {s}", f"{g[0]}. {s}"])
    return kind, v


def _nothing(rng: random.Random) -> str:
    """What looks like an item and is none: a number of things, a sum, an order number, a book number, a place in a book."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w, p = _word(rng), rng.choice(" -")
    if rng.random() < 0.4:
        return rng.choice([f"ISBN {d(3)}{p}{d(1)}{p}{d(2)}{p}{d(6)}{p}{d(1)}", f"page {d(3)}, line {d(2)}, word {d(1)}", f"{d(2)}:{d(2)}", f"version {d(1)}.{d(1)}.{d(2)}", f"{d(1)}/{d(2)}/{d(4)}"])
    n = rng.randint(2, 250)
    return rng.choice([f"{n} {w.title()}", f"{n} {w}", f"{n} {w.title()}. {_word(rng).title()}", f"{n},{rng.randint(100, 999)} {w}", f"{n} to {rng.randint(2, 99)}", f"{n}.{rng.randint(10, 99)}", f"no. {rng.randint(1000, 9999999)}"])


def examples(texts: list[str], given: set[str], surnames: set[str], seed: int = 5, most: int = 12_000, width: int = 100) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Labelled windows: what the teacher finds in the texts, with made-up values put between words."""
    rng = random.Random(seed)
    g, s = sorted(given) or ["ann"], sorted(surnames) or ["lee"]
    lead = ["", "", "call ", "my passport ", "i told ", "signed by ", "write to ", "we drove to ", "SSN ", "the name was "]
    out = []
    for text in texts:
        if len(text) < 20:
            continue
        whole = teacher(text, given, surnames)
        a = max(0, rng.choice(whole)[0] - rng.choice([0, rng.randrange(width), rng.randrange(10, width)]) * 3 // 4) if whole and rng.random() < 0.75 else rng.randrange(max(1, len(text) - width))
        a = text.find(" ", a) + 1 if a else 0
        b = text.find(" ", a + width)
        part = text[a : b if b > 0 else None] if b < a + width + 40 else text[a : a + width]
        spans = teacher(part, given, surnames)
        if rng.random() < 0.75:
            for _ in range(rng.randint(1, 2)):
                gaps = [m.start() for m in re.finditer(r"(?<=[\w.,]) (?=\w)", part) if not any(x <= m.start() < y for x, y, _ in spans)]
                if not gaps:
                    break
                at = rng.choice(gaps)
                kind, v = _made_up(rng, g, s) if rng.random() < 0.86 else ("", _nothing(rng))
                before = " " + rng.choice(lead)
                after = rng.choice(["", "", ".", ","] if not v.endswith(("St", "Rd", "Ave", "Blvd", "Ln", "Dr")) else ["", ","])
                add = len(before) + len(v) + len(after)
                spans = [(x, y, t) if y <= at else (x + add, y + add, t) for x, y, t in spans]
                if kind:
                    spans.append((at + len(before), at + len(before) + len(v), kind))
                part = part[:at] + before + v + after + part[at:]
        r = rng.random()
        part = part.lower() if r < 0.22 and len(part.lower()) == len(part) else part.upper() if r < 0.26 and len(part.upper()) == len(part) else part
        out.append((part, spans))
        if len(out) >= most:
            break
    return out


# --- the network -------------------------------------------------------------------------------------------------


def _sigmoid(x):
    import numpy as np

    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lstm(ids, table, rec, keep: bool):
    """One direction over ids (time x batch): outputs (time x batch x hidden) and what the way back needs."""
    import numpy as np

    t_max, n = ids.shape
    h = np.zeros((n, HIDDEN), np.float32)
    c = np.zeros((n, HIDDEN), np.float32)
    out = np.empty((t_max, n, HIDDEN), np.float32)
    gates = np.empty((t_max, n, 4 * HIDDEN), np.float32) if keep else None
    cells = np.empty((t_max, n, HIDDEN), np.float32) if keep else None
    k = HIDDEN
    for t in range(t_max):
        z = table[ids[t]]
        z += h @ rec
        # the first three blocks are sigmoids, whose weights are halved beforehand by the 0.5 below
        z[:, : 3 * k] *= 0.5
        np.tanh(z, out=z)
        z[:, : 3 * k] *= 0.5
        z[:, : 3 * k] += 0.5
        c = z[:, k : 2 * k] * c + z[:, :k] * z[:, 3 * k :]
        h = z[:, 2 * k : 3 * k] * np.tanh(c)
        out[t] = h
        if keep:
            gates[t], cells[t] = z, c
    return out, gates, cells


def _lstm_back(ids, table, rec, out, gates, cells, d_out):
    """Gradients of table and recurrent weights."""
    import numpy as np

    t_max, n = ids.shape
    k = HIDDEN
    d_rec = np.zeros_like(rec)
    dz_all = np.empty((t_max, n, 4 * k), np.float32)
    dh = np.zeros((n, k), np.float32)
    dc = np.zeros((n, k), np.float32)
    for t in range(t_max - 1, -1, -1):
        i, f, o, g = (gates[t][:, x * k : (x + 1) * k] for x in range(4))
        tc = np.tanh(cells[t])
        dh = dh + d_out[t]
        dc = dc + dh * o * (1 - tc * tc)
        before = cells[t - 1] if t else np.zeros_like(dc)
        dz = dz_all[t]
        dz[:, :k] = dc * g * i * (1 - i)
        dz[:, k : 2 * k] = dc * before * f * (1 - f)
        dz[:, 2 * k : 3 * k] = dh * tc * o * (1 - o)
        dz[:, 3 * k :] = dc * i * (1 - g * g)
        if t:
            d_rec += out[t - 1].T @ dz
        dh = dz @ rec.T
        dc = dc * f
    flat, z = ids.ravel(), dz_all.reshape(-1, 4 * k)
    one = np.zeros((SIGNS, len(flat)), np.float32)
    one[flat, np.arange(len(flat))] = 1
    return one @ z, d_rec


def emissions(net: dict, ids, keep: bool = False):
    """Tag scores (time x batch x tags) of windows (time x batch)."""
    import numpy as np

    fo = _lstm(ids, net["table_f"], net["rec_f"], keep)
    ba = _lstm(ids[::-1], net["table_b"], net["rec_b"], keep)
    both = np.concatenate([fo[0], ba[0][::-1]], axis=2)
    return both @ net["out"] + net["bias"], both, fo, ba


def _crf(score, gold, trans, mask):
    """Mean negative log likelihood and its gradients for scores and transitions (time x batch x tags)."""
    import numpy as np

    t_max, n, k = score.shape
    al = np.empty_like(score)
    al[0] = score[0]
    et = np.exp(trans)
    for t in range(1, t_max):
        top = al[t - 1].max(axis=1, keepdims=True)
        new = np.log(np.exp(al[t - 1] - top) @ et + 1e-30) + top + score[t]
        al[t] = np.where(mask[t][:, None], new, al[t - 1])
    top = al[-1].max(axis=1, keepdims=True)
    z = (np.log(np.exp(al[-1] - top).sum(axis=1, keepdims=True)) + top)[:, 0]
    be = np.zeros((n, k), np.float32)
    d_score = np.zeros_like(score)
    d_trans = np.zeros_like(trans)
    every = np.arange(n)
    nll = z.sum()
    for t in range(t_max - 1, -1, -1):
        m = mask[t]
        p = np.exp(al[t] + be - z[:, None]) * m[:, None]
        d_score[t] = p
        d_score[t][every, gold[t]] -= m
        nll -= (score[t][every, gold[t]] * m).sum()
        if t:
            step = be + score[t]
            a = al[t - 1] - z[:, None]
            sa, sb = a.max(axis=1, keepdims=True), step.max(axis=1, keepdims=True)
            ea, eb = np.exp(a - sa), np.exp(step - sb) * np.exp(np.clip(sa + sb, -80, 80)) * m[:, None]
            d_trans += (ea.T @ eb) * et
            np.subtract.at(d_trans, (gold[t - 1][m], gold[t][m]), 1)
            nll -= trans[gold[t - 1][m], gold[t][m]].sum()
            new = np.log(np.exp(step - sb) @ et.T + 1e-30) + sb
            be = np.where(m[:, None], new, be)
    return nll / n, d_score / n, d_trans / n


def start(seed: int = 2) -> dict:
    """A network that has learned nothing."""
    import numpy as np

    rng = np.random.default_rng(seed)
    k4, tags = 4 * HIDDEN, len(TAGS)
    net = {"table_f": rng.normal(0, 0.25, (SIGNS, k4)), "table_b": rng.normal(0, 0.25, (SIGNS, k4)), "rec_f": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, k4)) * 0.7, "rec_b": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, k4)) * 0.7, "out": rng.normal(0, 0.2, (2 * HIDDEN, tags)), "bias": np.zeros(tags), "trans": np.zeros((tags, tags))}
    net["bias"][0] = 2
    for b in range(tags):
        if TAGS[b][0] == "I":
            for a in range(tags):
                if TAGS[a][1:] != TAGS[b][1:]:
                    net["trans"][a, b] = -6
    net = {k: v.astype(np.float32) for k, v in net.items()}
    for k in ("table_f", "table_b"):
        net[k][:, HIDDEN : 2 * HIDDEN] += 1  # remember at first
    return net


def _batches(samples: list, batch: int) -> list[tuple]:
    """Characters, tags and mask (time x batch) of labelled texts, those of like length together."""
    import numpy as np

    number = {t: i for i, t in enumerate(TAGS)}
    out = []
    samples = sorted(samples, key=lambda x: len(x[0]))
    for s in range(0, len(samples), batch):
        part = samples[s : s + batch]
        t_max = max(len(x) for x, _ in part)
        ids, gold, mask = np.full((t_max, len(part)), _PAD), np.zeros((t_max, len(part)), np.int64), np.zeros((t_max, len(part)), bool)
        for i, (text, spans) in enumerate(part):
            ids[: len(text), i], mask[: len(text), i] = char_ids(text), True
            for a, b, t in spans:
                gold[a:b, i] = number[f"I-{t}"]
                gold[a, i] = number[f"B-{t}"]
        out.append((ids, gold, mask))
    return out


def gradients(net: dict, ids, gold, mask) -> dict:
    """Gradients of the CRF likelihood of one batch."""
    import numpy as np

    score, both, fo, ba = emissions(net, ids, keep=True)
    _, ds, dt = _crf(score, gold, net["trans"], mask)
    grad = {"trans": dt, "bias": ds.sum(axis=(0, 1)), "out": both.reshape(-1, 2 * HIDDEN).T @ ds.reshape(-1, len(TAGS))}
    d_both = ds @ net["out"].T
    grad["table_f"], grad["rec_f"] = _lstm_back(ids, net["table_f"], net["rec_f"], *fo, np.ascontiguousarray(d_both[:, :, :HIDDEN]))
    grad["table_b"], grad["rec_b"] = _lstm_back(ids[::-1], net["table_b"], net["rec_b"], *ba, np.ascontiguousarray(d_both[::-1, :, HIDDEN:]))
    return grad


def advance(state: tuple, batches: list[tuple], steps: int, *, rate: float) -> tuple:
    """Some steps of Adam, one a batch: ``state`` is (network, first moments, second moments, steps done)."""
    import numpy as np

    net, m1, m2, step = ({k: v.copy() for k, v in x.items()} if isinstance(x, dict) else x for x in state)
    for ids, gold, mask in batches:
        grad = gradients(net, ids, gold, mask)
        size = np.sqrt(sum(float((v * v).sum()) for v in grad.values()))
        cut = min(1.0, 5.0 / max(size, 1e-9))
        step += 1
        lr = rate * min(1.0, step / 10) * max(0.05, 1 - 0.95 * step / steps)
        for k, v in grad.items():
            v = v * cut
            m1[k] = 0.9 * m1[k] + 0.1 * v
            m2[k] = 0.99 * m2[k] + 0.01 * v * v
            net[k] -= (lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net, m1, m2, step


def _empty_moments(net: dict) -> dict:
    import numpy as np

    return {k: np.zeros_like(v) for k, v in net.items()}


def train(samples: list, *, epochs: int = 12, batch: int = 64, rate: float = 0.012, seed: int = 2) -> dict:
    """Network fitted to labelled texts by Adam on the CRF likelihood, in this process."""
    import numpy as np

    rng = np.random.default_rng(seed)
    net = start(seed)
    groups = _batches(samples, batch)
    epochs = max(epochs, -(-300 // max(1, len(groups))))  # few examples are gone through more often
    state = (net, _empty_moments(net), _empty_moments(net), 0)
    for _ in range(epochs):
        state = advance(state, [groups[g] for g in rng.permutation(len(groups))], epochs * len(groups), rate=rate)
    return state[0]


def train_spread(spark: SparkSession, samples: list, *, workers: int = 6, steps: int = 540, round_steps: int = 15, batch: int = 64, rate: float = 0.015, seed: int = 2) -> dict:
    """Network fitted by ``workers`` tasks side by side: each makes ``round_steps`` steps on its own share of the examples
    from the weights of the round before, and the mean of their weights and moments begins the next round. A lost task is
    run again from the weights it was given. The examples and the weights are small and bounded by their parameters."""
    import pickle

    import numpy as np

    net = start(seed)
    state = (net, _empty_moments(net), _empty_moments(net), 0)
    given = spark.sparkContext.broadcast(samples)
    tasks = spark.range(0, workers, 1, workers)
    for r in range(-(-steps // round_steps)):
        now = spark.sparkContext.broadcast(state)

        def run(parts: Iterator[pa.RecordBatch], r=r, now=now) -> Iterator[pa.RecordBatch]:
            for b in parts:
                for w in b.column(0).to_pylist():
                    rng = np.random.default_rng([seed, w, r])
                    own = given.value[w::workers] or given.value
                    pick = [own[i] for i in rng.permutation(max(len(own), round_steps * batch))[: round_steps * batch] % len(own)]
                    groups = _batches(pick, batch)
                    made = advance(now.value, [groups[g] for g in rng.permutation(len(groups))], steps, rate=rate)
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], ["state"])

        made = [pickle.loads(bytes(x[0])) for x in tasks.mapInArrow(run, "state binary").collect()]
        state = (*({k: np.mean([m[i][k] for m in made], axis=0, dtype=np.float32) for k in net} for i in range(3)), made[0][3])
        now.unpersist()
    return state[0]


def decode(net: dict, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Spans of each text. Windows overlap; the inner part of each gives the scores of its characters, and one best path
    over the whole text is sought where any tag but O has a chance."""
    import numpy as np

    core = WINDOW - 2 * MARGIN
    ids = [char_ids(t) for t in texts]
    places = [(i, s, max(0, s - MARGIN), min(len(x), s + core + MARGIN)) for i, x in enumerate(ids) for s in range(0, len(x), core)]
    places.sort(key=lambda p: p[2] - p[3])  # windows of like length together, so that little is padding
    score = [np.empty((len(x), len(TAGS)), np.float32) for x in ids]
    for at in range(0, len(places), 1024):
        part = places[at : at + 1024]
        box = np.full((part[0][3] - part[0][2], len(part)), _PAD)
        for j, (i, _, a, b) in enumerate(part):
            box[: b - a, j] = ids[i][a:b]
        e = emissions(net, box)[0]
        for j, (i, s, a, b) in enumerate(part):
            n = min(core, len(ids[i]) - s)
            score[i][s : s + n] = e[s - a : s - a + n, j]
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    order = sorted((i for i in range(len(texts)) if len(ids[i])), key=lambda i: -len(ids[i]))
    at = 0
    while at < len(order):
        many = max(1, min(256, 1_000_000 // len(ids[order[at]])))
        for i, path in zip(order[at : at + many], _best_paths([score[i] for i in order[at : at + many]], net["trans"])):
            # a span begins at B, or at an I that nothing of its type comes before
            kind = (path + 1) // 2
            inside = (path > 0) & (path % 2 == 0)
            starts = np.flatnonzero((path > 0) & ~(inside & (np.r_[0, kind[:-1]] == kind)))
            for a in starts.tolist():
                b = a + 1
                while b < len(path) and inside[b] and kind[b] == kind[a]:
                    b += 1
                out[i].append((a, b, TYPES[kind[a] - 1]))
        at += many
    return out


def _best_paths(scores: list, trans) -> list:
    """Best tag sequence of each text (longest first), all texts a step at a time."""
    import numpy as np

    n, k, t_max = len(scores), len(TAGS), len(scores[0])
    lens = np.array([len(s) for s in scores])
    back = np.empty((t_max, n, k), np.int8)
    best = np.stack([s[0] for s in scores])
    box = np.zeros((t_max, n, k), np.float32)
    for i, s in enumerate(scores):
        box[: len(s), i] = s
    by_end = np.ascontiguousarray(trans.T)[None]
    for t in range(1, t_max):
        m = int(np.searchsorted(-lens, -t, "left"))  # texts that go on
        v = best[:m, None, :] + by_end
        p = v.argmax(axis=2)
        back[t, :m] = p
        best[:m] = np.take_along_axis(v, p[:, :, None], axis=2)[:, :, 0] + box[t, :m]
    path = np.zeros((t_max, n), np.int64)
    tag = best.argmax(axis=1)
    for t in range(t_max - 1, -1, -1):
        m = int(np.searchsorted(-lens, -t, "left"))
        path[t, :m] = tag[:m]
        if t:
            tag[:m] = back[t, np.arange(m), tag[:m]]
    return [path[: lens[i], i] for i in range(n)]


def decode_bounded(net: dict, texts: list[str], most: int = 1_000_000, around: int = 1000) -> list[list[tuple[int, int, str]]]:
    """``decode`` for texts of any length and number: at most about ``most`` characters are held at a time.

    A longer text goes in slices that see ``around`` characters of their neighbours; a span counts where it begins.
    """
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    part: list[tuple[int, int, int, int, str]] = []
    size = 0

    def flush() -> None:
        nonlocal part, size
        for (i, lo, a, b, _), spans in zip(part, decode(net, [p[4] for p in part])):
            out[i] += [(lo + x, lo + y, t) for x, y, t in spans if a <= lo + x < b]
        part, size = [], 0

    for i, t in enumerate(texts):
        for a in range(0, len(t), most):
            b = min(a + most, len(t))
            lo, hi = max(0, a - around), min(len(t), b + around)
            if part and size + hi - lo > most:
                flush()
            part.append((i, lo, a, b, t[lo:hi]))
            size += hi - lo
    flush()
    return out


_APOSTROPHE, _HYPHEN = "'’", "‐‑-"
_SURNAME = re.compile(rf"[^\W\d_]+(?:[{_APOSTROPHE}{_HYPHEN}][^\W\d_]+)*")


def _inner(text: str, at: int) -> bool:
    """Whether a sign stands inside a name (O'Brien, Smith-Jones), which that of a possessive or of Smith-like does not."""
    if not (0 < at < len(text) - 1 and text[at - 1].isalpha() and text[at + 1].isalpha()):
        return False
    if text[at] in _APOSTROPHE:
        return text[at + 1 : at + 3].isalpha()
    start = at
    while start > 0 and text[start - 1].isalpha():
        start -= 1
    return text[at] in _HYPHEN and text[at + 1].isupper() == text[start].isupper()


def _whole_words(text: str, a: int, b: int, kind: str) -> tuple[int, int, str] | None:
    """A find with its ends at whole words; none if it lacks what each item of its type has: an at in an e-mail address,
    5 digits in a phone number, 4 in an id number, a digit and a word in an address.

    A word goes on over the signs that stand inside e-mail addresses and numbers; a number begins with its plus sign or
    bracket; the full stop of a shortened kind of street is part of that word.
    """
    inner = "._+-%@" if kind == "email" else "-" if kind in ("phone", "id_number") else ""

    def goes_on(i: int, step: int) -> bool:
        """Whether the word of the sign before ``i`` (as seen in the direction ``step``) goes on at ``i``."""
        if not 0 <= i < len(text) or not text[i - step].isalnum() and text[i - step] not in inner:
            return False
        return text[i].isalnum() or text[i] in inner and 0 <= i + step < len(text) and text[i + step].isalnum()

    while a < b and not (text[a].isalnum() or text[a] in "+(" and kind == "phone"):
        a += 1
    while a < b and not text[b - 1].isalnum():
        b -= 1
    if a >= b:
        return None
    while text[a].isalnum() and goes_on(a - 1, -1):
        a -= 1
    while goes_on(b, 1):
        b += 1
    if kind == "phone":
        while a > 0 and text[a - 1] in "+(" and (text[a - 1] == "+" or ")" in text[a:b]):
            a -= 1
    if kind == "address" and text[b : b + 1] == "." and re.split(r"\W", text[a:b])[-1].lower() in {s.rstrip(".").lower() for s in _SHORT_STREETS}:
        b += 1
    value, digits = text[a:b], sum(c.isdigit() for c in text[a:b])
    has = re.search(r"@|\b(?:at|arroba|ät)\b", value, re.I) if kind == "email" else digits >= {"phone": 5, "id_number": 4, "address": 1}[kind] and (kind != "address" or re.search(r"[^\W\d_]{2}", value))
    return (a, b, kind) if has else None


def _name(text: str, a: int, b: int, given: frozenset[str]) -> tuple[int, int, str] | None:
    """A find of a name at whole words, without titles, sentence ends and what else is no part of one; or none."""
    while a > 0 and (text[a - 1].isalnum()):
        a -= 1
    while b < len(text) and (text[b].isalnum() or _inner(text, b)):
        b += 1
    words = [(a + m.start(), a + m.end()) for m in re.finditer(r"[^\s]+", text[a:b])]
    words = [(x, y) for x, y in words if any(c.isalpha() for c in text[x:y])]
    if not words:
        return None
    stops = [i + 1 for i, (x, y) in enumerate(words) if text[y - 1] in ".!?" and y - x > 2 and text[x:y].lower().strip(".") not in TITLES]
    parts = [words[i:j] for i, j in zip([0, *stops], [*stops, len(words)])]
    words = max(parts, key=len)  # a sentence may end inside
    if len(words) > 2 and text[words[0][0]].islower() and text[words[-1][0]].isupper():
        words = words[1:]
    while len(words) > 2 and given:
        low = [text[x:y].lower() for x, y in words]
        begins = [w in given or bool(re.fullmatch(r"[^\W\d_]\.", w)) for w in low]
        if begins[0] or not any(begins[1:-1]):
            break
        words = words[1:]
    if len(words) == 1:  # an initial before it
        m = re.search(r"(?<![\w.])[^\W\d_]\. $", text[max(0, words[0][0] - 3) : words[0][0]])
        if m:
            words.insert(0, (words[0][0] - 3 + m.start() if words[0][0] >= 3 else m.start(), words[0][0] - 1))
    if words and re.fullmatch(r"[^\W\d_]\.", text[words[0][0] : words[0][1]]):  # a known given name before it
        m = re.search(r"([^\W\d_]+) $", text[max(0, words[0][0] - 30) : words[0][0]])
        if m and m[1].lower() in given:
            words.insert(0, (words[0][0] - len(m[0]), words[0][0] - 1))
    if not 2 <= len(words) <= 4:
        return None
    x, y = words[0][0], words[-1][1]
    while y > x and not text[y - 1].isalpha():
        y -= 1
    while x < y and not text[x].isalpha():
        x += 1
    y -= 2 if y - x > 2 and text[y - 2] in _APOSTROPHE and text[y - 1] in "sS" else 0
    value = text[x:y]
    if len(value.split()) < 2 or value.split()[0].lower() in _NO_NAME or value.split()[-1].lower() in _NO_NAME:
        return None
    if value[0].isupper() != value.split()[-1][0].isupper() and value.split()[0].lower().rstrip(".") not in given:
        return None
    if re.search(r"\n\s*\n", value) or any(c.isdigit() or c in "@()[]:;!?" for c in value) or not _SURNAME.fullmatch(value.split()[-1]):
        return None
    return x, y, "name"


def settle(text: str, spans: list[tuple[int, int, str]], given: frozenset[str] = frozenset()) -> list[tuple[int, int, str]]:
    """What the network found, with its types, at whole words: no form decides. Parts of one type with no more than a
    blank or a hyphen between them are one find. What cannot be of its type is dropped: see ``_whole_words``; a name of
    one word or of more than 4, over an empty line, with digits or brackets, or of a word in upper and one in lower case
    unless it begins with a known given name."""
    joined: list[tuple[int, int, str]] = []
    for s in spans:
        if joined and s[2] == joined[-1][2] and text[joined[-1][1] : s[0]] in ("", " ") + (("-", ".", ") ", ")") if s[2] != "name" else ()):
            s = (joined.pop()[0], s[1], s[2])
        joined.append(s)
    out = sorted((f for a, b, kind in joined if (f := _name(text, a, b, given) if kind == "name" else _whole_words(text, a, b, kind))), key=lambda s: (s[0], -s[1]))
    clean: list[tuple[int, int, str]] = []
    for s in out:
        if not clean or s[0] >= clean[-1][1]:
            clean.append(s)
    return clean


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Text with ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[ADDRESS]``, ``[NAME]`` in place of the spans."""
    parts, at = [], 0
    for a, b, t in spans:
        parts += [text[at:a], f"[{t.upper()}]"]
        at = b
    return "".join([*parts, text[at:]])


def _people(people: list[str]) -> tuple[set[str], set[str]]:
    """Given names and surnames of names as written in a structured column."""
    pairs: dict[str, set[str]] = {}
    for p in people:
        w = [x for x in re.split(r"\s+", p.strip().lower()) if x.rstrip(".") not in TITLES]
        if len(w) in (2, 3) and all(x.replace(".", "").isalpha() for x in w) and len(w[-1]) >= 5 and len(w[0].rstrip(".")) > 1:
            pairs.setdefault(w[0].rstrip("."), set()).add(w[-1])
    # a given name stands before several surnames; what else begins with a capital does not
    short = {x for k, v in NICKNAMES.items() for x in [k, *v.split()]}
    given = {g for g, s in pairs.items() if len(s) > 2 or g in short} - FILLERS - {"old"}
    return given | short, {s for g in given for s in pairs[g]}


def fit(texts: list[str], people: list[str], spark: SparkSession | None = None) -> dict:
    """Network trained on labelled windows of ``texts``, by tasks of ``spark`` if it is given; ``people`` are names as
    written in a structured column."""
    given, surnames = _people(people)
    labelled = examples(sorted(texts), given, surnames)
    return (train_spread(spark, labelled) if spark and labelled else train(labelled)) | {"given": frozenset(given)}


_FITTED: dict[str, dict] = {}


def network(samples: DataFrame, text: str, key: str, names: DataFrame, name_column: str, *, most_texts: int = 9000, most_names: int = 20_000) -> dict:
    """Network fitted to at most about ``most_texts`` texts and ``most_names`` names, both chosen by a hash; in one
    application the same sample is fitted to once."""
    total = samples.count()
    pick = F.pmod(F.xxhash64(F.lit("pii"), key), F.lit(1 << 20)) < int(min(1.0, most_texts / max(1, total)) * (1 << 20))
    # a window of a long text, from a place that a hash names: the sample is bounded by characters too
    start = F.pmod(F.xxhash64(text), F.greatest(F.length(text) - 4000, F.lit(1)).cast("long")).cast("int") + 1
    window = F.substring(F.col(text), start, F.lit(4000))
    texts = [t for t in samples.filter(pick).select(window.alias("t")).limit(2 * most_texts).toArrow().column(0).to_pylist() if t]
    flat = names.select(F.explode(name_column).alias("n")).filter(F.col("n").contains(" ") & (F.length("n") < 60)).groupBy("n").count()
    known = flat.filter(F.col("count") > 1).orderBy(F.xxhash64("n")).limit(most_names).select("n").toArrow().column(0).to_pylist()
    spark = samples.sparkSession
    mark = hashlib.sha256("\0".join([spark.sparkContext.applicationId, *sorted(texts), *sorted(known)]).encode("utf-8", "surrogatepass")).hexdigest()
    if mark not in _FITTED:
        _FITTED.clear()
        _FITTED[mark] = fit(texts, known, spark)
    return _FITTED[mark]


def find_personal(df: DataFrame, key: str, text: str, net: dict) -> DataFrame:
    """Each item of personal information in each text, by the network; and the text with placeholders.

    Whole texts are read, in overlapping windows. Null and empty texts hold nothing (the redacted text is the text
    itself); repeated rows come out each; no rows, none.
    Result: ``<key>, redacted, items array<struct<pii_type, value, first_char, end_char>>``.
    """
    model = df.sparkSession.sparkContext.broadcast(net)  # bounded: some 40,000 weights
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.list_(pa.struct([("pii_type", pa.string()), ("value", pa.string()), ("first_char", pa.int64()), ("end_char", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(1).to_pylist()
                spans = [settle(t or "", s, model.value["given"]) for t, s in zip(texts, decode_bounded(model.value, [t or "" for t in texts]))]
                items = [[{"pii_type": t, "value": x[a:b], "first_char": a, "end_char": b} for a, b, t in s] for x, s in zip(texts, spans)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([redact(t, s) if t else t for t, s in zip(texts, spans)], pa.string()), pa.array(items, item)], ["key", "redacted", "items"])

    out = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"key {kind}, redacted string, items array<struct<pii_type:string,value:string,first_char:bigint,end_char:bigint>>")
    return out.withColumnRenamed("key", key)
