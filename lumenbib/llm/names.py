"""Variant spellings of names of persons and organisations that mean one entity.

Method: every name is rewritten in all canonical ways its rules allow (token order, initials, nicknames, short and legal
forms, transcriptions, one slip of the pen); the forms are exploded and joined on equality within a block (an identifier
or an organisation for persons, nothing for organisations). A candidate's score is the rarity of the forms it shares:
the sum over them of one over the number of different spellings that have the form. Whole forms, in which nothing is
left out, are evidence however many spellings have them; partial ones (an initial, a slip, a short form) only down to
MIN_SCORE, so a form that a crowd of spellings has in common links nobody by itself. No pair is left out for that: those of
a crowd are all compared, too, and linked unless one of them is ambiguous, which a name is that is alike to two of the
crowd whose given names contradict each other. Candidates are checked name against name, and what is linked is closed to
entities by connected components. Records that are alike in all that counts are one node, so a hot name is a few nodes
and not all pairs of its records.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.checkpoints import cut
from ..operators.components import connected_components
from ..operators.parallel import spread

#: Rarity a candidate needs that shares partial forms only: such a form counts if at most one over this many spellings have it.
MIN_SCORE = 1 / 64

#: Short forms of given names (fixed values): name, then what stands for it.
NICKNAMES = """alexander alex al sasha|alexandra alex sandra sasha|andrew andy drew|anthony tony|benjamin ben benny|catherine cathy kate katie|katherine kathy kate katie kat|charles charlie chuck|christopher chris|christina chris tina|daniel dan danny|david dave|deborah deb debbie|dmitri dima mitya|dolores lola|donald don|dorothy dot dottie|edward ed eddie ted ned|ekaterina katya|elizabeth liz beth betty lizzie eliza|elisabeth lisa lis elise elli elsbeth lisbeth lilli ilse bettina|penelope penny nell|francisco paco pancho fran|francis frank|frederick fred freddy|friedrich fritz|giuseppe beppe peppe|gregory greg|heinrich heinz heiner|irina ira|jacob jake|james jim jimmy jamie|jennifer jen jenny|johannes hannes hans|john johnny jack jon|jonathan jon|jose pepe|joseph joe joey|joshua josh|katarzyna kasia|lawrence larry|leonard len lenny|lucia lucy|luigi gigi|malgorzata gosia|margaret maggie meg peggy greta|maria mary mia|matthew matt|michael mike mick mikey|nicholas nick nicky|olga olya|patricia pat patty tricia|patrick pat paddy|pavel pasha|peter pete|philip phil|rebecca becky becca|richard rick dick rich ricky|robert rob bob bobby robbie|ronald ron|samuel sam sammy|stephen steve|steven steve|susan sue susie|susanna susi sanna zuzu|suzanne sue|theodora dora thea|theodore ted theo|thomas tom tommy|timothy tim|ulrich uli|victoria vicky tori|vladimir vova volodya|walter walt|wanda wandzia|william bill will billy willy|yusuf joseph|zachary zach"""
TITLES = set("dr prof professor mr mrs ms miss sir dame phd md msc bsc ing dipl dott dra sra herr frau mme jr sr ii iii".split())
PARTICLES = set("van von de der den da di del della dos du la le zu ter ten af av al el bin ibn".split())
#: Full words of organisation names for their short and foreign forms (fixed values).
ORG_WORDS = {
    "univ": "university", "universitat": "university", "universite": "university", "universidad": "university", "universidade": "university", "universita": "university", "uniwersytet": "university",
    "inst": "institute", "institut": "institute", "instituto": "institute", "istituto": "institute", "instytut": "institute",
    "natl": "national", "nat": "national", "nac": "national", "lab": "laboratory", "labs": "laboratory", "laboratories": "laboratory",
    "coll": "college", "eng": "engineering", "engr": "engineering", "engin": "engineering", "acad": "academy", "akademie": "academy", "sci": "sciences", "science": "sciences",
    "med": "medical", "tech": "technical", "techn": "technical", "technol": "technology", "sch": "school", "hosp": "hospital", "dept": "department", "ctr": "center", "centre": "center",
    "phys": "physics", "ecol": "ecology", "res": "research", "intl": "international", "fac": "faculty", "corp": "corporation", "assoc": "association", "soc": "society",
}
ORG_DROP = set("the of at for and in de del della di der des du la le fur y e gmbh ltd inc llc ag sa ev plc co".split())

_LETTERS = {"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "a", "œ": "o", "þ": "th", "ð": "d", "ı": "i", "ħ": "h"}
_DIGRAPHS = re.compile("ae|oe|ue")


@lru_cache(maxsize=1 << 16)
def plain(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    x = "".join(_LETTERS.get(c, c) for c in text.lower())
    return "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))


@lru_cache(maxsize=1 << 16)
def fold(text: str) -> str:
    """Plain text in which transcribed umlauts (ae, oe, ue) are the bare vowel, as accented ones are."""
    return _DIGRAPHS.sub(lambda m: m.group()[0], plain(text))


@lru_cache(maxsize=1 << 16)
def variants(word: str) -> tuple[str, ...]:
    """A plain word with each of its digraphs as two letters, which a slip may have brought together, and as one vowel."""
    parts = re.split("(ae|oe|ue)", word)
    if len(parts) == 1:
        return (word,)
    if len(parts) > 7:
        return word, fold(word)
    return tuple(dict.fromkeys("".join(x) for x in product(*[(x, x[0]) if i % 2 else (x,) for i, x in enumerate(parts)])))


_NICK: dict[str, set[str]] = {}
for _row in NICKNAMES.split("|"):
    _full, *_short = [fold(_w) for _w in _row.split()]
    for _s in _short:
        _NICK.setdefault(_s, set()).add(_full)


def slip(a: str, b: str) -> int:
    """0 for equal words, 1 if one insertion, deletion, substitution or swap of neighbours makes them equal, else 2."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 1:
        return 2
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return 1 if a[i + 1 :] == b[i + 1 :] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :] else 2
    s, t = (a, b) if len(a) < len(b) else (b, a)
    return 1 if s[i:] == t[i + 1 :] else 2


@lru_cache(maxsize=1 << 18)
def near(a: str, b: str) -> int:
    """The fewest slips between any variants of two plain words; 2 stands for more than one."""
    return min(slip(x, y) for x in variants(a) for y in variants(b))


@lru_cache(maxsize=1 << 14)
def deletions(word: str) -> frozenset[str]:
    """The word and all words that lack one of its characters: words one slip apart share one of these."""
    return frozenset(x for v in variants(word) for x in (v, *(v[:i] + v[i + 1 :] for i in range(len(v)))))


@lru_cache(maxsize=1 << 16)
def parse_person(name: str | None) -> tuple[tuple[str, tuple[str, ...], bool], ...]:
    """All readings (surname, given names or initials, turned) of a name; empty for null, blank and unreadable names.

    Two full names without a comma may also stand in turned order, surname first.
    A surname has its particles before it and no hyphens; an initial is one letter; hyphenated given names are two. Two
    capitals that could be a title are initials where nothing else would be left beside the surname.
    """
    if not name or not name.strip():
        return ()
    comma = name.count(",") == 1
    mixed = any(c.islower() for c in name)
    readings: list[tuple[list[str], list[str], bool]] = []

    def words(part: str, least: int) -> list[str]:
        bare = [x for x in (w.strip(".,;()'\"") for w in part.replace(".", ". ").split()) if x]
        out = [w for w in bare if fold(w) not in TITLES]
        return out if len(out) >= least else [w for w in bare if w in out or mixed and w.isupper()]

    def initials(w: str) -> list[str] | None:
        letters = w.replace("-", "")
        if len(letters) == 1 or (mixed and letters.isupper() and len(letters) <= (4 if "-" in w else 3)):
            return list(letters)
        return None

    def given(ws: list[str]) -> list[str]:
        out = []
        for w in ws:
            i = initials(w)
            out += i if i else [x for x in w.split("-") if x]
        return out

    particle = lambda w: fold(w) in PARTICLES and not (mixed and w.isupper())
    if comma:
        last, first = name.split(",")
        readings.append((words(last, 1), words(first, 1), False))
    else:
        ws = words(name, 2)
        full = [i for i, w in enumerate(ws) if initials(w) is None and not particle(w)]
        spots = [full[-1]] if full else []
        if len(full) == 2 and all(particle(w) for i, w in enumerate(ws) if i not in full):
            spots.append(full[0])
        for at in spots:
            start = at
            while start and particle(ws[start - 1]):
                start -= 1
            readings.append((ws[start : at + 1], ws[:start] + ws[at + 1 :], at != full[-1]))
    out = []
    for last, first, turned in readings:
        surname = "".join(plain(w).replace("-", "").replace("'", "").replace("’", "") for w in last)
        rest = tuple(plain(x) for x in given(first) if not particle(x))
        if surname and rest:
            out.append((surname, rest, turned))
    return tuple(out)


@lru_cache(maxsize=1 << 14)
def full_names(given: str) -> frozenset[str]:
    """What a given name may stand for: its variants and the full names that it is a nickname of."""
    return frozenset(variants(given)) | frozenset(f for v in variants(given) for f in _NICK.get(v, ()))


def person_forms(name: str | None) -> list[str]:
    """Whole forms `=surname|full given name` and partial ones `surname|initial`, of every reading.

    A whole form has the first given name or what it is a nickname of; partial ones the surname with up to one character
    left out, and the initial of the first given name, or of a later one that is written in full.
    """
    out = set()
    for surname, given, _ in parse_person(name):
        if len(given[0]) > 1:
            out |= {f"={s}|{f}" for s in variants(surname) for f in full_names(given[0])}
        firsts = {f[0] for g in (given[0], *(g for g in given[1:] if len(g) > 1)) for f in full_names(g)}
        words = deletions(surname) if len(surname) > 2 else {surname}
        out.update([f"{s}|{i}" for i in firsts for s in words])
    return sorted(out)


@lru_cache(maxsize=1 << 18)
def _given_alike(a: str, b: str) -> int:
    """Slips between two given names or initials; 2 if they can't stand for one name."""
    if len(a) == 1 or len(b) == 1:
        return 0 if {x[0] for x in full_names(a)} & {x[0] for x in full_names(b)} else 2
    if full_names(a) & full_names(b):
        return 0
    return near(a, b) if min(len(a), len(b)) > 2 else 2


def _givens_alike(g: tuple[str, ...], h: tuple[str, ...]) -> bool:
    """Whether given names don't contradict: they agree place by place, or one side leaves out the other's first name or
    initial and they agree from the next one on, which is the same full name in both. Beside a full name that is left
    out the side without it may have no further names."""
    if all(_given_alike(x, y) < 2 for x, y in zip(g, h)):
        return True
    return any(len(long) > 1 and len(short[0]) > 1 and len(long[1]) > 1 and (len(long[0]) == 1 or len(short) < len(long)) and all(_given_alike(x, y) == 0 for x, y in zip(short, long[1:])) for short, long in ((g, h), (h, g)))


def persons_alike(a: str | None, b: str | None) -> bool:
    """Whether two names can stand for one name: one reading each with the same surname and given names that don't contradict, up to a slip in each.

    A surname of four letters or fewer may have a slip only beside a full given name that is the same.
    """
    for s, g, turned in parse_person(a):
        for t, h, also in parse_person(b):
            if turned and also:
                continue
            apart = near(s, t)
            if apart == 1 and min(len(s), len(t)) <= 4:
                apart = 1 if min(len(s), len(t)) > 2 and min(len(g[0]), len(h[0])) > 1 and _given_alike(g[0], h[0]) == 0 else 2
            if apart < 2 and _givens_alike(g, h):
                return True
    return False


@lru_cache(maxsize=1 << 14)
def parse_org(name: str | None) -> tuple[tuple[str, ...], str]:
    """(words in order, short form or ''): full words without articles and country tails; a short form is the one word in capitals beside the rest."""
    if not name or not name.strip():
        return (), ""
    x = re.sub(r",\s*[A-Z]{2}\s*$", "", name.strip())
    raw = re.findall(r"[^\W_]+", re.sub(r"\.", " ", x))
    short = ""
    if len(raw) <= 2:
        caps = [w for w in raw if w.isupper() and 2 <= len(w) <= 6]
        if caps and (len(raw) == 1 or any(not w.isupper() for w in raw)):
            short = caps[0]
            raw = [w for w in raw if w != short]
    words = [ORG_WORDS.get(fold(w), plain(w)) for w in raw]
    return tuple(w for w in words if w not in ORG_DROP), fold(short)


def org_forms(name: str | None) -> list[str]:
    """Whole forms `=words` in any order; partial ones with up to one character left out of a word; short forms with the place; a bare short form."""
    words, short = parse_org(name)
    if short:
        return [f"a:{short}|{'|'.join(map(fold, words))}"] if words else [f"b:{short}"]
    out = {"=" + " ".join(sorted(map(fold, words)))} if words else set()
    for i, w in enumerate(words):
        rest = " ".join(sorted(map(fold, words[:i] + words[i + 1 :])))
        out |= {f"w:{rest}|{d}" for d in (deletions(w) if len(w) > 4 else {w})}
        letters = w[0] + "".join(v[0] for j, v in enumerate(words) if j != i)
        if len(words) > 1:
            out |= {f"a:{letters}|{fold(w)}", f"b:{letters}"}
    return sorted(out)


def orgs_alike(a: str | None, b: str | None) -> bool:
    """Whether two names can stand for one organisation's name: the same words in any order up to one slip, or a short form of them."""
    (w, s), (v, t) = parse_org(a), parse_org(b)
    if s or t:
        if s and t:
            return s == t and (w == v or not w or not v)
        full, short, place = (v, s, w) if s else (w, t, v)
        return any(full[i][0] + "".join(x[0] for j, x in enumerate(full) if j != i) == short and (not place or [fold(x) for x in place] == [fold(full[i])]) for i in range(len(full)))
    if len(w) != len(v) or not w:
        return False
    x, y = {fold(z): z for z in w}, {fold(z): z for z in v}
    left, right = sorted(set(x) - set(y)), sorted(set(y) - set(x))
    if not left and not right:
        return sorted(map(fold, w)) == sorted(map(fold, v))
    return len(left) == len(right) == 1 and min(len(left[0]), len(right[0])) > 4 and near(x[left[0]], y[right[0]]) < 2


def clean_orcid(raw: Column) -> Column:
    """Sixteen characters of an orcid in any notation; null for none and for zeros only."""
    x = F.regexp_extract(F.regexp_replace(F.upper(raw), "[-\\s]", ""), r"(\d{15}[\dX])/*$", 1)
    return F.when((x != "") & ~x.rlike("^0+$"), x)


def clean_ror(raw: Column) -> Column:
    """Nine lower-case characters of a ror in any notation; null if there are none."""
    x = F.regexp_extract(F.lower(F.trim(raw)), r"(?:^|/)(0[0-9a-z]{8})/*$", 1)
    return F.when((x != "") & ~x.rlike("^0+$"), x)


def _udf(f, kind: str):
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([f(x) for x in s], dtype=object)

    return run


def _alike(f):
    @F.pandas_udf("boolean")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([f(x, y) for x, y in zip(a, b)], dtype=bool)

    return run


def _candidates(forms: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """forms (key, whole, node; key a number) -> pairs a < b that share a key, with score: the sum over shared keys of one over its nodes.

    Whole keys count whatever their size, partial ones if at most 1 / min_score nodes have them; for the rest see
    `_crowd`. Nodes are distinct spellings. One shuffle brings a key's nodes together: the window counts them before any are gathered, and of keys
    within the bound the pairs are made in place; larger whole keys are joined, where adaptive execution splits them.
    """
    bound = int(round(1 / min_score))
    w = Window.partitionBy("key")
    sized = forms.withColumn("size", F.count("*").over(w)).filter((F.col("size") > 1) & (F.col("whole") | (F.col("size") <= bound)))
    few = sized.filter(F.col("size") <= bound).groupBy("key").agg(F.sort_array(F.collect_set("node")).alias("n"))
    each = F.flatten(F.transform("n", lambda x, i: F.transform(F.slice("n", i + 2, F.lit(bound)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = few.select((1.0 / F.size("n")).alias("rarity"), F.explode(each).alias("p")).select("p.a", "p.b", "rarity")
    many = sized.filter(F.col("size") > bound)
    more = many.select("key", "size", F.col("node").alias("a")).join(many.select("key", F.col("node").alias("b")), "key").filter("a < b").select("a", "b", (1.0 / F.col("size")).alias("rarity"))
    return pairs.unionByName(more).groupBy("a", "b").agg(F.sum("rarity").alias("score"))


def _crowd(forms: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """forms (key, whole, node) -> (key, node) of the partial keys that `_candidates` makes no pairs of."""
    sized = forms.withColumn("size", F.count("*").over(Window.partitionBy("key")))
    return sized.filter(~F.col("whole") & (F.col("size") > int(round(1 / min_score)))).select("key", "node")


def _crowd_pairs(crowd: DataFrame) -> DataFrame:
    """crowd (key, node) -> all pairs a < b that share a key, with a score of 0."""
    return crowd.withColumnRenamed("node", "a").join(crowd.withColumnRenamed("node", "b"), "key").filter("a < b").select("a", "b", F.lit(0.0).alias("score")).distinct()


def givens_clash(names: list[str]) -> bool:
    """Whether the given names of any two of the names contradict each other."""
    readings = list({frozenset(g for _, g, _ in parse_person(n)) for n in names})
    return any(not any(_givens_alike(g, h) for g in a for h in b) for i, a in enumerate(readings) for b in readings[i + 1 :])


def _crowd_edges(crowd: DataFrame, nodes: DataFrame) -> DataFrame:
    """crowd (key, node) of persons -> (a, b): equal spellings, and those that are alike and neither of which is ambiguous."""
    named = crowd.join(nodes.select("node", "name"), "node")
    first = named.groupBy("key", "name").agg(F.min("node").alias("a"))
    same = named.join(first, ["key", "name"]).filter("a < node").select("a", F.col("node").alias("b"))
    side = lambda end: first.select("key", F.col("a").alias(end), F.col("name").alias(f"name_{end}"))
    alike = side("a").join(side("b"), "key").filter("a < b").drop("key").distinct().filter(_alike(persons_alike)("name_a", "name_b"))
    around = alike.select(F.col("a").alias("node"), F.col("name_b").alias("name")).unionByName(alike.select(F.col("b").alias("node"), F.col("name_a").alias("name")))
    clear = around.groupBy("node").agg(F.collect_set("name").alias("names")).filter(~_udf(givens_clash, "boolean")("names")).select("node")
    for end in "ab":
        alike = alike.join(clear.withColumnRenamed("node", end), end, "left_semi")
    return same.unionByName(alike.select("a", "b"))


def _checked(pairs: DataFrame, nodes: DataFrame, carry: list[str], test, alike) -> DataFrame:
    """Pairs (a, b, score) whose nodes pass test(suffix function) on the columns carried, then alike, name against name."""
    for end in "ab":
        side = nodes.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("name", *carry)])
        pairs = pairs.join(side, end)
    return pairs.filter(test).filter(_alike(alike)("name_a", "name_b")).select("a", "b", "score")


def _closed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (node, ...) with entity: the component of the edges, or the node itself."""
    comp = connected_components(edges.select("a", "b"))
    return nodes.join(comp.select("node", "component"), "node", "left").withColumn("entity", F.coalesce("component", "node")).drop("component")


def link_institutions(df: DataFrame) -> DataFrame:
    """df (institution_id, display_name, ror, country_code) -> (institution_id, entity): records of one organisation have one entity.

    Names must be able to stand for one name and neither ror nor country contradict; a bare short form needs the same
    ror. Null and blank names link to nothing; repeated rows are one node; an empty table gives an empty result.
    """
    base = df.filter("institution_id is not null").select("institution_id", F.col("display_name").alias("name"), clean_ror(F.col("ror")).alias("ror"), F.upper(F.nullif(F.trim("country_code"), F.lit(""))).alias("country"))
    # a name that says nothing, or a bare short form without its ror, is a node of its own
    lone = F.trim(F.coalesce("name", F.lit(""))).rlike("^([A-Z]{2,6})?$") & (F.col("ror").isNull() | ~F.coalesce("name", F.lit("")).rlike("[A-Z]"))
    base = base.withColumn("alone", F.when(lone, F.col("institution_id")))
    same = ["name", "ror", "country", "alone"]
    grouped = cut(base.groupBy(*same).agg(F.min("institution_id").alias("node")))
    forms = spread(grouped).select("node", "ror", F.explode(_udf(org_forms, "array<string>")("name")).alias("form"))
    # a bare short form stands in its ror only
    bare = F.col("form").startswith("b:")
    forms = forms.filter(~bare | F.col("ror").isNotNull()).select(F.xxhash64("form", F.when(bare, F.col("ror"))).alias("key"), F.col("form").startswith("=").alias("whole"), "node")
    ok = lambda c: F.col(f"{c}_a").isNull() | F.col(f"{c}_b").isNull() | (F.col(f"{c}_a") == F.col(f"{c}_b"))
    edges = _checked(_candidates(forms).unionByName(_crowd_pairs(_crowd(forms))), grouped, ["ror", "country"], ok("ror") & ok("country"), orgs_alike)
    closed = _closed(grouped, edges)
    on = [base[c].eqNullSafe(closed[c]) for c in same]
    return base.join(closed, on[0] & on[1] & on[2] & on[3]).select("institution_id", "entity")


def link_authors(df: DataFrame, organisations: DataFrame) -> DataFrame:
    """df (author_id, display_name, orcid, institution_id), organisations (institution_id, entity) -> (author_id, entity).

    Names must be able to stand for one name, and an orcid or an organisation be shared. Null names, placeholder orcids
    and unknown organisations link to nothing; repeated rows are one node; an empty table gives an empty result.
    """
    base = df.filter("author_id is not null").select("author_id", F.col("display_name").alias("name"), clean_orcid(F.col("orcid")).alias("orcid"), "institution_id")
    base = base.join(organisations.select("institution_id", F.col("entity").alias("org")), "institution_id", "left").select("author_id", "name", "orcid", "org")
    # equal names alone aren't enough: without an orcid and an organisation, or a name, a record is a node of its own
    lone = (F.col("orcid").isNull() & F.col("org").isNull()) | (F.trim(F.coalesce("name", F.lit(""))) == "")
    base = base.withColumn("alone", F.when(lone, F.col("author_id")))
    same = ["name", "orcid", "org", "alone"]
    grouped = cut(base.groupBy(*same).agg(F.min("author_id").alias("node")))
    block = F.explode(F.array_compact(F.array(F.concat(F.lit("o:"), F.col("orcid")), F.concat(F.lit("i:"), F.col("org").cast("string")))))
    forms = spread(grouped).filter("alone is null").select("node", "orcid", "org", _udf(person_forms, "array<string>")("name").alias("forms"))
    forms = forms.select("node", "forms", block.alias("block")).select("node", "block", F.explode("forms").alias("form"))
    forms = forms.select(F.xxhash64("block", "form").alias("key"), F.col("form").startswith("=").alias("whole"), "node")
    shared = F.coalesce(F.col("orcid_a") == F.col("orcid_b"), F.lit(False)) | F.coalesce(F.col("org_a") == F.col("org_b"), F.lit(False))
    edges = _checked(_candidates(forms), grouped, ["orcid", "org"], shared, persons_alike).select("a", "b")
    closed = _closed(grouped, edges.unionByName(_crowd_edges(_crowd(forms), grouped)))
    on = [base[c].eqNullSafe(closed[c]) for c in same]
    return base.join(closed, on[0] & on[1] & on[2] & on[3]).select("author_id", "entity")


def entity_pairs(links: DataFrame, id_col: str, kind: str) -> DataFrame:
    """(kind, id_a, id_b; id_a < id_b): all pairs of records of one entity."""
    many = links.groupBy("entity").agg(F.count("*").alias("n")).filter("n > 1").select("entity")
    x = links.join(many, "entity")
    a, b = x.select("entity", F.col(id_col).alias("id_a")), x.select(F.col("entity").alias("e"), F.col(id_col).alias("id_b"))
    return a.join(b, (F.col("entity") == F.col("e")) & (F.col("id_a") < F.col("id_b"))).select(F.lit(kind).alias("kind"), "id_a", "id_b").distinct()


def entities(authors: DataFrame, institutions: DataFrame) -> DataFrame:
    """(kind, id, entity, n_records): every record with the smallest node of its entity and how many records that has."""
    orgs = cut(link_institutions(institutions))
    people = link_authors(authors, orgs)
    each = people.select(F.lit("author").alias("kind"), F.col("author_id").alias("id"), "entity").unionByName(orgs.select(F.lit("institution").alias("kind"), F.col("institution_id").alias("id"), "entity"))
    each = each.distinct()
    return each.join(each.groupBy("kind", "entity").agg(F.count("*").alias("n_records")), ["kind", "entity"]).select("kind", "id", "entity", "n_records")


def found(authors: DataFrame, institutions: DataFrame) -> DataFrame:
    """p2_found's rows."""
    orgs = cut(link_institutions(institutions))
    people = link_authors(authors, orgs)
    return entity_pairs(people, "author_id", "author").unionByName(entity_pairs(orgs, "institution_id", "institution"))
