"""Variant spellings of names typed by people: phonetic blocking, Jaro-Winkler with nicknames, connected components.

Spellings are reduced to a normal form per tenant and kind (person, organisation). Normal forms that share a block are compared;
a block is a phonetic code of a sorted token (with one-deletion neighbours, so that a typing slip stays in its block) plus the class
of another token's initial, which keeps blocks small for common given names. Accepted pairs of full forms are clustered by connected
components. Forms that leave something out (initials, a dropped trade word) join a cluster only if they fit exactly one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.components import connected_components
from palimpsest.runtime import materialize

# Common English short forms of given names.
NICKNAMES = """
abby abigail|al albert alan alexander|alex alexander alexandra|andy andrew|ann anna|annie anna anne|ash ashley|barb barbara|becky rebecca|
ben benjamin|bernie bernard|bert albert robert|beth elizabeth|betsy elizabeth|betty elizabeth|bill william|billy william|bob robert|
bobby robert|brad bradley|cathy catherine katherine|charlie charles|chris christopher christine|christy christine|chuck charles|
cindy cynthia|claire clara|cliff clifford|connie constance|dan daniel|danny daniel|dave david|deb deborah|debbie deborah|dick richard|
dmitry dmitri|don donald|dora theodora isadora|doug douglas|drew andrew|ed edward|eddie edward|eli elijah|ella eleanor|ellie eleanor|fran francesca frances|
frank francis franklin|frankie frank francesca|fred frederick|freddie frederick|gabe gabriel|gabby gabriela gabrielle|gabi gabriela|gene eugene|gerry gerald|
greg gregory|gus augustus|hal harold henry|hank henry|harry harold henry|ike isaac|izzy isabella isabel|bella isabella|jack john|jake jacob|
jamie james|jan janet|jeff jeffrey|jen jennifer|jenny jennifer|jerry gerald jerome|jess jessica|jim james|jimmy james|joe joseph|joey joseph|
johnny john|jon jonathan|josh joshua|judy judith|kate katherine catherine|kathy katherine catherine|katie katherine catherine|ken kenneth|
kit christopher|larry lawrence|len leonard|leo leonardo leonard|lexi alexandra|lena helena|liam william|lily lillian|lisa elizabeth|liz elizabeth|lizzie elizabeth|
lou louis louise|lucy lucia|maggie margaret|mandy amanda|marge margaret|matt matthew matthias|max maximilian|meg margaret|megan margaret|mel melanie|mick michael|
mickey michael|mike michael|mimi miriam|mitch mitchell|molly mary|nan nancy|nate nathan nathaniel|ned edward|nell eleanor|nick nicholas|nicky nicholas|
nora eleanor|ollie oliver|pam pamela|pat patricia patrick|patty patricia|peggy margaret|pete peter|phil philip|quent quentin|randy randall|ray raymond|
rich richard|rick richard|ricky richard|rob robert|robbie robert|ron ronald|rosie rose|roxy roxanne|russ russell|sally sarah|sam samuel samantha|
sandy sandra alexander|sasha alexander alexandra|steph stephanie|steve steven stephen|stu stuart|sue susan susannah|susie susan susannah|suzy susannah|tammy tamara|
ted theodore edward|teddy theodore|terry terrence teresa|tess teresa|theo theodore|tim timothy|timmy timothy|toby tobias|tom thomas|tommy thomas|tony anthony|
tricia patricia|trish patricia|trudy gertrude|val valerie|vicky victoria|vic victor victoria|vin vincent|vince vincent|viv vivian|walt walter|wes wesley|will william|xen xenia|
zach zachary|zack zachary|zak zachary|zo zofia
"""
# Legal forms of organisations.
LEGAL = "inc incorporated corp corporation ltd limited llc llp plc gmbh ag kg co company sa sas sarl srl spa bv nv oy ab as pty pte lp".split()
# Trade words and the short forms that are no beginnings of them.
TRADES = """
technologies technology systems services industries laboratories labs logistics engineering manufacturing robotics associates
international holdings group partners solutions consulting energy dynamics software networks
""".split()
SHORT = {
    "intl": "international", "assoc": "associates", "assocs": "associates", "svcs": "services", "svc": "services", "mfg": "manufacturing", "mfrs": "manufacturing", "tech": "technologies",
    "techs": "technologies", "sys": "systems", "labs": "laboratories", "lab": "laboratories", "eng": "engineering", "engg": "engineering", "ind": "industries", "inds": "industries",
    "log": "logistics", "rob": "robotics", "grp": "group", "hldgs": "holdings", "mgmt": "management", "natl": "national",
}
#: Forms of a block that one task compares with the whole block.
PART = 2_000
PERSON_TYPES, ORGANISATION_TYPES = ["person", "per"], ["organization", "organisation", "org"]

_NICK: dict[str, set[str]] = {}
for _line in NICKNAMES.replace("\n", "").split("|"):
    _short, *_full = _line.split()
    _NICK.setdefault(_short, set()).update(_full)

# The letter classes of the Soundex code.
_SOUNDEX = {c: d for d, letters in zip("123456", ["bfpv", "cgjkqsxz", "dt", "l", "mn", "r"]) for c in letters}


def plain(text: str) -> str:
    """Lower case without accents; letters that have no base letter are spelled out."""
    text = text.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("ł", "l").replace("Ł", "L").replace("æ", "ae")
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


@lru_cache(100_000)
def code(token: str) -> str:
    """Soundex digits of all letters, the first too, without neighbours of one class; vowels part nothing."""
    out = ""
    for c in token:
        d = _SOUNDEX.get(c, "")
        if d and out[-1:] != d:
            out += d
    return out


def _neighbourhood(digits: str) -> set[str]:
    head = digits[:5]
    return {head[:4]} | {head[:k] + head[k + 1 :] for k in range(len(head))} if len(head) > 2 else {head}


@lru_cache(200_000)
def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity with prefix weight 0.1 over up to four letters; 1 for equal strings, 0 if either is empty."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, found = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                found.append(c)
                break
    m = len(found)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(found, (b[j] for j in range(len(b)) if taken[j]))) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


@lru_cache(200_000)
def slips(a: str, b: str, most: int = 2) -> int:
    """Typing slips (insert, drop, replace, swap neighbours) between two words, counted up to ``most`` + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row, older = row, [i], before
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if older is not None and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
        before = last
    return row[-1]


@lru_cache(200_000)
def alike(a: str, b: str, least: float = 0.86) -> bool:
    """One typing slip at most (two in words of ten letters) and Jaro-Winkler of ``least``."""
    return a == b or (jaro_winkler(a, b) >= least and slips(a, b) <= (2 if min(len(a), len(b)) >= 10 else 1) and min(len(a), len(b)) >= 3)


def person_form(text: str) -> tuple[str, bool] | None:
    """Normal form ``tokens`` (a token with a stop is a short form) and whether it leaves out the given name; None: not a name."""
    text = re.sub(r"\s+", " ", plain(text)).strip()
    if not text or any(c.isdigit() for c in text) or re.search(r"[/\\@_:]", text):
        return None
    if text.count(",") == 1:
        tail, head = (x.strip() for x in text.split(","))
        text = f"{head} {tail}"
    found = re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*\.?", text)
    tokens = []
    for t in found:
        bare = re.sub(r"[.'’-]", "", t)
        tokens.append(bare + "." if len(bare) == 1 or t.endswith(".") else bare)
    words = [t for t in tokens if not t.endswith(".")]
    if not words or len(tokens) < 2:
        return None
    return " ".join(sorted(tokens, key=lambda t: (t.endswith("."), t))), len(words) == 1


def organisation_form(text: str) -> tuple[str, bool] | None:
    """Normal form: words in order without article, legal form; and whether no trade word is left."""
    text = plain(text)
    text = re.sub(r"\b((?:[a-z]\.){2,})", lambda m: m.group().replace(".", "") + " ", text)
    tokens = re.findall(r"[a-z0-9]+\.?", text.replace("-", " ").replace("&", " "))
    out = []
    for t in tokens:
        bare = t.rstrip(".")
        if bare in LEGAL or bare in ("the", "and", "of"):
            continue
        out.append(SHORT.get(bare, t if t.endswith(".") and len(bare) > 1 else bare))
    if not out:
        return None
    return " ".join(out), not any(_trade(t) for t in out)


@lru_cache(50_000)
def _trade(token: str) -> str | None:
    bare = token.rstrip(".")
    for t in TRADES:
        if bare == t or (len(bare) >= (2 if token.endswith(".") else 4) and t.startswith(bare)) or (len(bare) > 5 and alike(bare, t)):
            return t
    return None


def _class(c: str) -> str:
    return _SOUNDEX.get(c, "0")


def _given(token: str) -> set[str]:
    return {token} | _NICK.get(token, set())


def person_keys(form: str) -> list[str]:
    tokens = form.split()
    keys = set()
    for k, t in enumerate(tokens):
        if len(t) >= 4 and not t.endswith("."):
            others = {_class(g[0]) for j, o in enumerate(tokens) if j != k for g in _given(o.rstrip("."))}
            keys |= {f"{d}/{c}" for d in _neighbourhood(code(t)) for c in others}
        elif not t.endswith("."):  # a short word is only like itself
            keys |= {f"={t}/{_class(g[0])}" for j, o in enumerate(tokens) if j != k for g in _given(o.rstrip("."))}
    return sorted(keys)


def organisation_core(form: str) -> tuple[list[str], str | None]:
    tokens = form.split()
    trades = [t for t in tokens if _trade(t)]
    core = [t for t in tokens if not _trade(t)]
    return (core or tokens), (_trade(trades[0]) if trades and core else None)


def _acronym(form: str) -> str:
    """The initials of a form of several words; a form of one short word is taken as initials itself."""
    tokens = form.split()
    return "".join(t[0] for t in tokens) if len(tokens) > 1 else tokens[0].rstrip(".") if 3 <= len(form) <= 5 else ""


def organisation_keys(form: str) -> list[str]:
    core, _ = organisation_core(form)
    short = _acronym(form)
    return sorted(_neighbourhood(code("".join(t.rstrip(".") for t in core))) | ({f"={short}"} if len(short) > 2 else set()))


def same_person(a: str, b: str) -> bool:
    """Whether two normal forms can be one person: a surname alike, and every given name, nickname or initial compatible."""
    x, y = a.split(), b.split()
    wx, wy = [t for t in x if not t.endswith(".")], [t for t in y if not t.endswith(".")]
    for s in wx:
        for t in wy:
            if len(s) >= 4 and len(t) >= 4 and alike(s, t) and _givens([g for g in x if g != s] or [], [g for g in y if g != t] or [], s == t):
                return True
            # A short surname must be the same, and no other word may contradict: it may be a particle ('de').
            if s == t and len(s) < 4:
                rest_x, rest_y = [g for g in x if g != s], [g for g in y if g != t]
                few, many = (rest_x, rest_y) if len(rest_x) <= len(rest_y) else (rest_y, rest_x)
                if few and all(any(_fits(g, h) for h in many) for g in few):
                    return True
    return False


def _fits(g: str, h: str) -> bool:
    bare_g, bare_h = g.rstrip("."), h.rstrip(".")
    if g.endswith(".") or h.endswith("."):
        if len(bare_g) > len(bare_h) or (len(bare_g) == len(bare_h) and h.endswith(".")):
            g, h, bare_g, bare_h = h, g, bare_h, bare_g
        return any(full.startswith(bare_g) for full in _given(bare_h)) if g.endswith(".") else (bare_g == bare_h or bool(_given(bare_g) & _given(bare_h)))
    if _given(g) & _given(h):
        return True
    return any(alike(p, q) for p in _given(g) for q in _given(h) if len(p) > 3 and len(q) > 3)


def _givens(x: list[str], y: list[str], exact: bool) -> bool:
    if not x or not y:
        return False
    words_x, words_y = [t for t in x if not t.endswith(".")], [t for t in y if not t.endswith(".")]
    if words_x and words_y:
        if not any(_fits(g, h) for g in words_x for h in words_y):
            return False
        middle_x, middle_y = [t for t in x if t.endswith(".")], [t for t in y if t.endswith(".")]
        return not middle_x or not middle_y or any(_fits(g, h) for g in middle_x for h in middle_y)
    few, many = (x, y) if len(x) <= len(y) else (y, x)
    return all(any(_fits(g, h) for h in many) for g in few) or (len(words_x) + len(words_y) == 1 and any(_fits(g, h) for g in x for h in y))


def same_organisation(a: str, b: str) -> bool:
    """Whether two normal forms can be one organisation: the names proper alike, in any order or run together, and no other trade."""
    core_a, trade_a = organisation_core(a)
    core_b, trade_b = organisation_core(b)
    if trade_a and trade_b and trade_a != trade_b:
        return False
    if (" " in a) != (" " in b) and len(_acronym(a)) > 2 and _acronym(a) == _acronym(b):
        return True
    joined_a, joined_b = "".join(core_a), "".join(core_b)
    if alike(joined_a, joined_b):
        return True
    if len(core_a) != len(core_b):
        return False
    left, errors = list(core_b), 0
    for t in core_a:
        hit = next((u for u in left if u == t), None) or next((u for u in left if _begins(t, u) or alike(t, u)), None)
        if hit is None:
            return False
        errors += not (hit == t or _begins(t, hit))
        left.remove(hit)
    return errors <= len(core_a)


def _begins(t: str, u: str) -> bool:
    return (t.endswith(".") and len(t) > 2 and u.startswith(t[:-1])) or (u.endswith(".") and len(u) > 2 and t.startswith(u[:-1]))


def _forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for user, kind, text in zip(batch["user_id"], batch["kind"], batch["text"]):
            if kind == "unknown":
                form = organisation_form(text)
                kind = "organisation" if form and not form[1] and len(form[0].split()) > 1 and text[:1].isupper() else "person"
                person = person_form(text) if kind == "person" else None
                if person and len(person[0].split()) > 5:
                    continue  # a phrase; a long name has its type somewhere
            form = person_form(text) if kind == "person" else organisation_form(text)
            if form:
                rows.append((user, kind, form[0], form[1], text, person_keys(form[0]) if kind == "person" else organisation_keys(form[0])))
        yield pd.DataFrame(rows, columns=["user_id", "kind", "form", "partial", "text", "keys"])


def spellings(memories: DataFrame) -> DataFrame:
    """Distinct ``(user_id, kind, text)`` of persons and organisations. Entities without a type take the type that the same text
    has elsewhere; texts that are typed as something else anywhere are no candidates when untyped."""
    entity = memories.select("user_id", F.explode("entities").alias("e")).select("user_id", F.col("e.text").alias("text"), F.lower(F.trim("e.type")).alias("type"))
    seen = entity.where("length(trim(text)) > 0").groupBy("user_id", "text").agg(
        F.bool_or(F.col("type").isin(PERSON_TYPES)).alias("person"),
        F.bool_or(F.col("type").isin(ORGANISATION_TYPES)).alias("organisation"),
        F.bool_or(F.col("type").isNotNull() & ~F.col("type").isin(PERSON_TYPES + ORGANISATION_TYPES)).alias("other"),
    )
    anywhere = seen.groupBy(F.col("text").alias("same")).agg(F.bool_or("person").alias("p"), F.bool_or("organisation").alias("o"), F.bool_or("other").alias("x"))
    is_person, is_organisation = F.coalesce("person", F.lit(False)), F.coalesce("organisation", F.lit(False))
    untyped = ~is_person & ~is_organisation & ~F.coalesce("other", F.lit(False))
    kind = (
        F.when(is_person, "person").when(is_organisation, "organisation")
        .when(untyped & F.coalesce("p", F.lit(False)), "person").when(untyped & F.coalesce("o", F.lit(False)), "organisation")
        .when(untyped & ~F.coalesce("x", F.lit(False)), "unknown")
    )
    return seen.join(anywhere, seen.text == anywhere.same).select("user_id", kind.alias("kind"), "text").where("kind is not null")


def clusters(memories: DataFrame) -> DataFrame:
    """Rows ``(user_id, kind, text, cluster)`` for every spelling of a person or organisation; one cluster per real thing.

    ``memories``: ``user_id, entities array<struct<text, type, ...>>``. Null entities, null or blank texts give nothing; repeated
    rows change nothing. A spelling that is like no other is a cluster of its own.
    """
    forms = materialize(spellings(memories).mapInPandas(_forms, "user_id string, kind string, form string, partial boolean, text string, keys array<string>"))
    node = F.xxhash64("user_id", "kind", "form")
    nodes = forms.groupBy("user_id", "kind", "form").agg(F.first("partial").alias("partial"), F.first("keys").alias("keys")).withColumn("node", node)
    blocks = nodes.select("user_id", "kind", "form", "partial", "node", F.explode("keys").alias("block"))
    block = ["user_id", "kind", "block"]
    # Blocks of one form are gone before the join; a block of many is cut into parts, each of which meets the whole block in a task.
    sizes = blocks.groupBy(*block).agg(F.count("*").alias("n")).where("n > 1").select(*block, F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    blocks = materialize(blocks.join(sizes, block))
    one = blocks.withColumn("part", F.pmod(F.xxhash64("form"), F.col("parts")).cast("int"))
    other = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*block, "part", *(F.col(c).alias(f"{c}_b") for c in ("form", "partial", "node")))
    pairs = one.join(other, [*block, "part"]).where("form < form_b").select("kind", "form", "form_b", "partial", "partial_b", "node", "node_b").distinct()

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            same = [same_person(x, y) if k == "person" else same_organisation(x, y) for k, x, y in zip(b["kind"], b["form"], b["form_b"])]
            yield b.loc[same, ["node", "node_b", "partial", "partial_b"]]

    links = materialize(pairs.mapInPandas(judge, "node long, node_b long, partial boolean, partial_b boolean"))
    both = links.union(links.select("node_b", "node", "partial_b", "partial"))
    whole = nodes.where("not partial").select("node")
    core = connected_components(links.where("not partial and not partial_b").select(F.col("node").alias("src"), F.col("node_b").alias("dst")))
    core = materialize(whole.join(core, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    offers = both.where("partial and not partial_b").select("node", "node_b").join(core.withColumnRenamed("node", "node_b"), "node_b").groupBy("node").agg(F.min("component").alias("component"), F.max("component").alias("most"))
    joined = offers.where("component = most").select("node", "component")
    # Forms that leave something out and fit no full form may still be spellings of one another.
    alone = links.where("partial and partial_b").join(offers.select("node"), "node", "left_anti").join(offers.select(F.col("node").alias("node_b")), "node_b", "left_anti")
    rest = connected_components(alone.select(F.col("node").alias("src"), F.col("node_b").alias("dst")))
    labels = core.union(joined).union(rest)
    return (
        forms.withColumn("node", node).join(labels, "node", "left").select("user_id", "kind", "text", F.coalesce("component", "node").alias("cluster"))
    )


def variant_pairs(memories: DataFrame) -> DataFrame:
    """All pairs ``(user_id, text_a, text_b)`` of different spellings of one cluster, ``text_a < text_b`` in byte order."""
    mine = materialize(clusters(memories))
    big = mine.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").select("cluster")
    mine = mine.join(big, "cluster")
    other = mine.select(F.col("cluster").alias("c"), F.col("user_id").alias("u"), F.col("text").alias("text_b"))
    return mine.join(other, (mine.cluster == other.c) & (mine.user_id == other.u) & (mine.text < other.text_b)).select("user_id", F.col("text").alias("text_a"), "text_b").distinct()
