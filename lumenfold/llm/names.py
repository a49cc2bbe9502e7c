"""Variant spellings of names: canonical rewritings, equi-joins on them, and linking by the rarity of a rewriting."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold import runtime
from lumenfold.llm.terms import SPACE
from lumenfold.operators.graph import linked

#: Well-known English short forms that no rule makes of the full name; a parameter of ``link_names``. Short
#: forms that are a part of the name with or without an ending (Sam, Rob, Leo, Tilli) follow from ``ENDINGS``.
NICKNAMES = {
    "alexander": "sandy sasha alec", "alexandra": "sandy sasha", "andrew": "drew", "anna": "annie", "anthony": "tony", "catherine": "kate katie", "charles": "charlie chuck", "charlotte": "lottie", "christopher": "kit topher", "deborah": "debbie", "dorothea": "dot dottie dolly dora", "dorothy": "dot dottie dolly dora",
    "edward": "ted teddy ned", "eleanor": "ellie nell nora", "elizabeth": "betty liz lizzie eliza bess libby lisa elsie betsy", "frances": "fran fanny", "francis": "frank", "francisco": "paco pancho paquito frank", "frederick": "fritz rick", "gabriella": "gaby ella bella", "gerald": "jerry", "harold": "harry hal", "henry": "harry hank hal",
    "isabella": "izzy ella", "jacob": "jake", "james": "jim jimmy jamie", "johannes": "hans jan", "john": "jack johnny", "jonathan": "jon", "joseph": "joey", "josephine": "fifi", "katherine": "kate katie kitty", "lawrence": "larry", "margaret": "peggy maggie meg greta daisy rita madge", "matthew": "matt", "michael": "mike mick mickey micky",
    "nathaniel": "nate", "ottilie": "tilly tilli", "nicholas": "nick nicky klaus claus nico niko", "patrick": "paddy", "patricia": "patty trish", "rebecca": "becky", "richard": "dick rick ricky", "robert": "bob bobby", "sarah": "sally", "stephen": "steve", "susannah": "sue suzy suzie sukie suki", "susan": "sue suzy suzie", "theodore": "ted teddy", "theresa": "tess terry", "timothy": "tim", "victoria": "vicky tori", "william": "bill billy liam willie willy",
}
#: Endings that a short form adds to a part of the full name.
ENDINGS = ("", "y", "ie", "i", "ey", "o", "a", "e", "s", "ek", "ka", "ito", "ita")
#: Legal forms at the end of names of organisations.
LEGAL_FORMS = set("ltd limited inc incorporated corp corporation co company llc llp lp plc gmbh mbh ag kg kgaa ohg ug ev eg sa sarl sas srl spa bv nv oy ab aps pty".split())
#: Forms of address, in several languages.
TITLES = set("mr mrs ms miss mx dr prof professor sir madam mme mlle m monsieur herr frau fraulein senor senora sr sra don dona rev fr".split())
#: Words that carry no meaning in names of organisations and roles.
FILLERS = set("the of for and a an der die das des von of la le les de du del".split())


def formal_names(nicknames: dict[str, str]) -> dict[str, list[str]]:
    """Full names of each short form."""
    out: dict[str, list[str]] = {}
    for full, short in nicknames.items():
        for s in short.split():
            out.setdefault(s, []).append(full)
    return out


_FORMAL = formal_names(NICKNAMES)


def stems(full: str) -> list[str]:
    """Parts of a full name that a short form may begin with: beginnings of 2 letters or more, ends of 3 or more."""
    return list(dict.fromkeys(p for n in range(2, len(full)) for p in (full[:n], full[-n:])[: 1 + (n > 2)]))


def bare(short: str) -> list[str]:
    """What a short form is without one of the endings, a letter doubled before the ending once."""
    out = []
    for e in ENDINGS:
        if short.endswith(e):
            s = short[: len(short) - len(e)]
            out += [s, s[:-1]] if e and len(s) > 2 and s[-1] == s[-2] else [s]
    return list(dict.fromkeys(s for s in out if len(s) >= 2))


def plain(text: str) -> str:
    """Lower case without accents; German sz as ss."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower().replace("ß", "ss")) if not unicodedata.combining(c))


def tokens_of(name: str, titled: bool = False) -> tuple[list[str], set[int]]:
    """Words of a name in natural order, and which of them are marked as shortened by a full stop; without titles
    unless ``titled``."""
    s = plain(name).replace("’", "'")
    s = re.sub(r"^(.*?)\s*\(([^()]*)\)\s*$", r"\2 \1", s)  # assistant (museum)
    of = re.match(r"^(?:the\s+)?(\S+(?:\s\S+){0,2}) (?:of|for)(?: the)? (\S+)$", s)
    if of:
        s = f"{of[2]} {of[1]}"  # assistant of chemistry, hospital of a town
    m = re.match(r"^([^,]+),\s*([^,]+)$", s)
    if m:
        s = f"{m[2]} {m[1]}"  # surname, given name
    if re.fullmatch(r"(?:[a-z]\.){2,5}[a-z]?\.?", s):
        return [s.replace(".", "")], set()
    raw = [w for w in re.split(r"[\s\-_/]+", s) if w.strip(".,;:'\"")]
    words = [(w.strip(".,;:'\""), w.endswith(".")) for w in raw]
    kept = [(w, d) for w, d in words if w not in FILLERS] or words
    while not titled and len(kept) > 1 and kept[0][0] in TITLES and (len(kept[0][0]) > 1 or len(kept) > 2):
        kept = kept[1:]
    return [w for w, _ in kept], {i for i, (w, d) in enumerate(kept) if d and len(w) > 1}


def sound(text: str) -> str:
    """Spelling without what sounds alike: w as v, c and q as k, doubled letters once."""
    for a, b in (("ph", "f"), ("ck", "k"), ("qu", "kv"), ("w", "v"), ("c", "k"), ("y", "i"), ("z", "s"), ("th", "t")):
        text = text.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", text)


def rewritings(name: str, formal: dict[str, list[str]] = _FORMAL, full_names: frozenset[str] = frozenset(NICKNAMES)) -> list[tuple[str, str, str]]:
    """Canonical forms of a name as (rule, form, side).

    ``both`` forms are equal for variants; of a shortened rule only a ``short`` form meets a ``full`` one. Forms of the
    rule ``slip`` (one letter left out) make candidates that are looked at again. The rule ``given`` parts a given name
    from the rest, for ``pet_forms``. ``formal`` has the full names of each short form of a table, ``full_names`` all.
    """
    words, cut = tokens_of(name)
    if not words:
        return []
    out = [("order", " ".join(sorted(words)), "both"), ("spaces", "".join(words), "both")]
    if len(words) == 2:
        out.append(("spaces", words[1] + words[0], "both"))
    stem = list(words)
    while len(stem) > 1 and stem[-1].replace(".", "") in LEGAL_FORMS:
        stem.pop()
    if len(stem) < len(words):
        out.append(("legal", " ".join(sorted(stem)), "both"))
    people = [words]
    if len(words) >= 3:
        inner = [w for i, w in enumerate(words) if not (len(w) == 1 and 0 < i < len(words) - 1)]
        if len(inner) < len(words):
            people.append(inner)
        tail = [w for w in words if len(w) > 1]
        if len(tail) == 2 and tail not in people:
            people.append(tail)
    for p in people:
        out.append(("middle", " ".join(sorted(p)), "both"))
        out.append(("sound", " ".join(sorted(map(sound, p))), "both"))
        if 2 <= len(p) <= 3 and not cut:
            for i in (0, len(p) - 1):
                rest = " ".join(sorted([*p[:i], *p[i + 1 :]]))
                if len(rest) < 3:
                    continue
                if p[i] in full_names:  # others have no short form in the table
                    out.append(("nickname", f"{rest}|{p[i]}", "full"))
                out += [("nickname", f"{rest}|{full}", "short") for full in formal.get(p[i], [])]
            if len(p[-1]) >= 4:  # a part of the given name, with or without an ending
                out.append(("given", f"{' '.join(p[1:])}|{p[0]}", "both"))
            if len(p) == 2 and p[0] in formal and len(p[1]) > 2:  # initials of the full name: r. smith, bob smith
                out += [("initial", f"{full[0]} {p[1]}", "full") for full in formal[p[0]]]
        if len(p) == 2:
            a, b = p
            if len(a) == 1 and len(b) > 2:
                out.append(("initial", f"{a} {b}", "short"))
            elif len(b) == 1 and len(a) > 2:
                out.append(("initial", f"{b} {a}", "short"))
            elif len(a) > 1 and len(b) > 1 and not cut:
                out += [("initial", f"{a[0]} {b}", "full"), ("initial", f"{b[0]} {a}", "full")]
    if len(words) == 1 and 2 <= len(words[0]) <= 5:
        out.append(("acronym", "".join(sorted(words[0])), "short"))
    if len(words) >= 3 and not cut:
        out.append(("acronym", "".join(sorted(w[0] for w in words)), "full"))
    if len(cut) == 1:
        i = next(iter(cut))
        out.append(("cut", " ".join(sorted([*words[:i], *words[i + 1 :]])) + f"|{words[i]}.", "short"))
    elif len(words) >= 2 and not cut:
        for i, w in enumerate(words):
            rest = " ".join(sorted([*words[:i], *words[i + 1 :]]))
            out += [("cut", f"{rest}|{w[:n]}.", "full") for n in range(2, min(len(w), 8))]
    for whole in {" ".join(words), " ".join(tokens_of(name, titled=True)[0])}:
        if len(whole) >= 5 and not cut:
            out.append(("slip", whole, "both"))
            out += [("slip", whole[:i] + whole[i + 1 :], "both") for i in range(len(whole)) if i == 0 or whole[i] != whole[i - 1]]
    return list(dict.fromkeys(out))


def pet_forms(form: str) -> list[tuple[str, str, int]]:
    """Parts of a given name (``rest|given``) as (form, side, letters of the given name): what a short form is without its
    ending meets a part of a longer name."""
    rest, _, given = form.rpartition("|")
    out = [(f"{rest}|{s}", "full", len(given)) for s in stems(given)]
    return out + [(f"{rest}|{s}", "short", len(given)) for s in bare(given) if len(given) <= 7]


def one_slip(a: str, b: str) -> bool:
    """One letter changed, added, left out, or two neighbours exchanged."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y or x == y[1:] or x[1:] == y[1:] or (x[2:] == y[2:] and x[:2] == y[:2][::-1])


def name_entities(df: DataFrame, scope: str, columns: list[str], *, established: int = 3, share: float = 0.2, nicknames: dict[str, str] | None = None) -> DataFrame:
    """The entity (person, animal, organisation or role) that each spelling inside one ``scope`` means.

    Each distinct spelling of a scope is rewritten by all rules (order of parts, spaces, accents, titles, middle
    initials, legal forms, sound; slips of one letter; and shortened: nicknames of the table ``nicknames``, parts of a
    given name with an ending, initials, acronyms, cut words); forms are exploded and equi-joined. A link is scored by
    the rarity of its rewriting. A form that keeps all that a name says links at once. A slip links unless both words
    that differ are ``established``: found in at least that many scopes, the rarer in over ``share`` of the scopes of the
    other, for a slip is rare. A shortened form scores 1 over the number of entities in its scope that it can mean by one
    rule, and links only at 1. Links close transitively.

    Null lists, null and blank items are skipped; repeats count once; a null scope is left out; no rows, no entities.
    Result: ``<scope>, name, entity``.
    """
    formal = _FORMAL if nicknames is None else formal_names(nicknames)
    full_names = frozenset(NICKNAMES if nicknames is None else nicknames)
    spark = df.sparkSession
    lists = [df.select(F.col(f"`{scope}`").alias("scope"), F.explode(F.col(f"`{c}`")).alias("raw")) for c in columns]
    rows = reduce(DataFrame.unionAll, lists).filter(F.col("scope").isNotNull())
    rows = rows.select("scope", F.trim(F.regexp_replace(F.lower("raw"), f"{SPACE}+", " ")).alias("name")).filter(F.col("name") != "").distinct()
    rows = rows.withColumn("id", F.xxhash64("scope", "name"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out = [(i, *f) for i, n in enumerate(part.column("name").to_pylist()) for f in rewritings(n, formal, full_names)]
                who = pa.array([o[0] for o in out], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("scope").take(who), part.column("id").take(who), part.column("name").take(who), *(pa.array([o[k] for o in out], pa.string()) for k in (1, 2, 3))], ["scope", "id", "name", "rule", "form", "side"])

    forms, forms_at = runtime.stage(rows.mapInArrow(rewrite, "scope string, id long, name string, rule string, form string, side string"), "forms")
    strict = forms.filter(F.col("rule").isin("order", "spaces", "middle", "legal", "sound"))
    # star edges: the whole group of a form meets at its least member; rules share one name space of full forms
    keyed = strict.withColumn("space", F.when(F.col("rule").isin("order", "middle", "legal"), "words").otherwise(F.col("rule")))
    stars = keyed.groupBy("scope", "space", "form").agg(F.min("id").alias("a"), F.collect_set("id").alias("all")).filter(F.size("all") > 1).select("a", F.explode("all").alias("b"))

    slips = forms.filter(F.col("rule") == "slip")
    many = slips.groupBy("scope", "form").agg(F.collect_set(F.struct("id", "name")).alias("all")).filter(F.size("all") > 1)
    left = many.select("scope", F.posexplode("all").alias("p", "x"), "all").select("scope", "x", F.explode(F.slice("all", F.col("p") + 2, F.size("all"))).alias("y"))
    pairs = left.select("scope", F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), F.when(F.col("x.id") < F.col("y.id"), F.col("x.name")).otherwise(F.col("y.name")).alias("na"), F.when(F.col("x.id") < F.col("y.id"), F.col("y.name")).otherwise(F.col("x.name")).alias("nb")).distinct()

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, na, nb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "na", "nb"))):
                for titled in (False, True):
                    wa, wb = tokens_of(na, titled)[0], tokens_of(nb, titled)[0]
                    if not one_slip(" ".join(wa), " ".join(wb)):
                        continue
                    odd = [(x, y) for x, y in zip(wa, wb) if x != y] if len(wa) == len(wb) else []
                    if len(wa) == len(wb) and (len(odd) != 1 or min(len(odd[0][0]), len(odd[0][1])) < 3):
                        continue
                    out.append((a, b, *(odd[0] if odd else ("", ""))))
                    break
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))], ["a", "b", "wa", "wb"])

    near = pairs.mapInArrow(differ, "a long, b long, wa string, wb string")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, w) for i, n in enumerate(batch.column("name").to_pylist()) for w in set(tokens_of(n)[0])]
            yield pa.RecordBatch.from_arrays([batch.column("scope").take(pa.array([o[0] for o in out], pa.int64())), pa.array([o[1] for o in out], pa.string())], ["scope", "word"])

    seen = rows.select("scope", "name").mapInArrow(words, "scope string, word string").distinct().groupBy("word").agg(F.count("*").alias("n"))
    near = near.join(seen.select(F.col("word").alias("wa"), F.col("n").alias("n_a")), "wa", "left").join(seen.select(F.col("word").alias("wb"), F.col("n").alias("n_b")), "wb", "left")
    low, high = F.least(F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0))), F.greatest(F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0)))
    near = near.filter(~((low >= established) & (low > share * high))).select("a", "b")
    sure, sure_at = runtime.stage(stars.filter(F.col("a") != F.col("b")).unionAll(near).distinct(), "links")
    root = linked(sure, "names")
    entity = rows.select("id").join(root.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("entity"))

    # parts of given names only where different entities of a scope share the rest of their names
    person = forms.filter(F.col("rule") == "given").select("scope", "id", "form", F.substring_index("form", "|", 1).alias("rest")).distinct().join(entity, "id")
    several = person.groupBy("scope", "rest").agg(F.min("entity").alias("lo"), F.max("entity").alias("hi")).filter(F.col("lo") < F.col("hi")).select("scope", "rest")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, *f) for i, n in enumerate(batch.column("form").to_pylist()) for f in pet_forms(n)]
            who = pa.array([o[0] for o in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("scope").take(who), pa.array(["pet"] * len(out), pa.string()), pa.array([o[1] for o in out], pa.string()), batch.column("id").take(who), pa.array([o[2] for o in out], pa.string()), pa.array([o[3] for o in out], pa.int32())], ["scope", "rule", "form", "id", "side", "long"])

    pets = person.join(several, ["scope", "rest"], "left_semi").select("scope", "form", "id").mapInArrow(parts, "scope string, rule string, form string, id long, side string, long int")
    some = forms.filter(F.col("rule").isin("nickname", "initial", "acronym", "cut")).select("scope", "rule", "form", "id", "side", F.lit(0).alias("long"))
    some, some_at = runtime.stage(some.unionByName(pets).distinct(), "short-forms")

    def met(rules: tuple[str, ...], of: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Short forms of some rules with the entities they can mean; and all short forms."""
        here = some.filter(F.col("rule").isin(*rules)).join(of, "id")
        full = here.filter(F.col("side") == "full").groupBy("scope", "rule", "form", F.col("long").alias("longer")).agg(F.min("entity").alias("lo"), F.max("entity").alias("hi"))
        short = here.filter(F.col("side") == "short")
        return short.join(full, ["scope", "rule", "form"]).filter((F.col("rule") != "pet") | (F.col("longer") > F.col("long"))), short

    def sole(found: DataFrame) -> DataFrame:
        """The score of a short form is 1 over the entities it can mean; two different ones are enough to know that it is less."""
        one = found.groupBy("scope", "entity", "rule").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter(F.col("lo") == F.col("hi"))
        return one.select(F.col("entity").alias("a"), F.col("lo").alias("b")).filter(F.col("a") != F.col("b"))

    def joined(more: DataFrame, name: str, of: DataFrame) -> DataFrame:
        root_ = linked(more.filter(F.col("a") != F.col("b")).distinct(), name)
        return of.join(root_.withColumnRenamed("node", "entity"), "entity", "left").select("id", F.coalesce("root", "entity").alias("entity"))

    # given names first, so that an initial finds one entity where a name stands in full and in short
    named, short = met(("nickname", "pet"), entity)
    # nicknames of one full name that stands nowhere in the scope
    alone = short.filter(F.col("rule") == "nickname").join(named.select("scope", "entity").distinct(), ["scope", "entity"], "left_anti")
    pair = alone.groupBy("scope", "form").agg(F.min("entity").alias("b"))
    more = sole(named).unionByName(alone.join(pair, ["scope", "form"]).select(F.col("entity").alias("a"), "b"))
    entity, entity_at = runtime.stage(joined(more, "names-short", entity), "named")
    entity = joined(sole(met(("initial", "acronym", "cut"), entity)[0]), "names-initial", entity)
    done = rows.join(entity, "id").select("scope", "name", "entity")
    done, _ = runtime.stage(done, "entities")
    for path in (forms_at, sure_at, entity_at, some_at):
        runtime.delete_path(spark, path)
    return done.withColumnRenamed("scope", scope)


def link_names(df: DataFrame, scope: str, columns: list[str], **how) -> DataFrame:
    """Pairs of different spellings of one entity (see ``name_entities``): ``<scope>, name_a, name_b`` with name_a < name_b
    by code point. An entity of many spellings has many pairs; ``name_entities`` has a row a spelling."""
    done = name_entities(df, scope, columns, **how).withColumnRenamed(scope, "scope")
    b = done.select(F.col("scope").alias("s"), F.col("entity").alias("e"), F.col("name").alias("name_b"))
    out = done.join(b, (F.col("scope") == F.col("s")) & (F.col("entity") == F.col("e")) & (F.col("name") < F.col("name_b")))
    return out.select(F.col("scope").alias(scope), F.col("name").alias("name_a"), "name_b")
