"""Analysis of one query string, on the driver: weights of words, kind, parts, channel weights; and importance of memories as a column."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.operators.texts import STOP_WORDS, stem

# Information content of nouns, modifiers and relations.
NOUN, MODIFIER, RELATION = 2.3, 1.7, 1.0
_MODIFIER_ENDS = ("able", "ible", "ful", "less", "ous", "ive", "al", "ic", "ary", "ish")
_RELATION_ENDS = ("ing", "ed", "ize", "ise", "ify")
_NEGATIONS = {"not", "no", "never", "without", "except"}


@dataclass
class Analysis:
    nouns: list[str]
    modifiers: list[str]
    relations: list[str]
    negated: list[str]
    phrases: list[tuple[str, str]]

    def weights(self) -> dict[str, float]:
        """Weight by stem; negated words have none."""
        out: dict[str, float] = {}
        for words, value in ((self.relations, RELATION), (self.modifiers, MODIFIER), (self.nouns, NOUN)):
            out |= {stem(w): value for w in words if w not in self.negated}
        return out


def analyse(query: str) -> Analysis:
    """Content words by their endings; a negation holds for the next three words; neighbouring nouns form phrases."""
    tokens = re.findall(r"[a-z0-9]+(?:'[a-z]+)?", query.lower())
    nouns, modifiers, relations, negated, kinds = [], [], [], [], []
    reach = 0
    for t in tokens:
        if t in _NEGATIONS or t.endswith("n't"):
            reach = 3
            kinds.append("")
            continue
        kind = ""
        if t not in STOP_WORDS and len(t) > 1:
            kind = "relation" if t.endswith(_RELATION_ENDS) and len(t) > 4 else "modifier" if t.endswith(_MODIFIER_ENDS) and len(t) > 4 else "noun"
            {"relation": relations, "modifier": modifiers, "noun": nouns}[kind].append(t)
            if reach:
                negated.append(t)
        reach = max(0, reach - 1)
        kinds.append(kind)
    phrases = [(a, b) for a, b, x, y in zip(tokens, tokens[1:], kinds, kinds[1:]) if y == "noun" and x in ("noun", "modifier")]
    return Analysis(nouns, modifiers, relations, negated, phrases)


def kind_of(query: str) -> str:
    """'temporal', 'attribute' or 'exploratory'."""
    q = query.lower()
    if re.search(r"\b(when|yesterday|today|last|ago|before|after|since|during|how long|week|month|year)\b", q):
        return "temporal"
    if re.search(r"\b(what|which|who)('s| is| are| was| were)?\b.*\b(name|colou?r|size|type|owner|status|version|role|age|of)\b", q):
        return "attribute"
    return "exploratory"


def decompose(query: str, most: int = 4) -> list[str]:
    """Parts of a compound question, at most ``most``; a simple one stays whole."""
    parts = [p.strip(" ?.,;") for p in re.split(r"\?\s+|;|,?\s+\b(?:and then|and also|as well as|and (?=who|what|when|where|why|how|which))", query, flags=re.I)]
    parts = [p for p in parts if len(p.split()) > 1]
    return parts[:most] if len(parts) > 1 else [query.strip()]


def channel_weights(discriminative: float, learned: tuple[float, float] = (0.5, 0.5), updates: int = 0, base: tuple[float, float] = (0.5, 0.5)) -> tuple[float, float]:
    """(keyword, vector) weights: 0.75 and 0.25 for very discriminative words, 0.6 and 0.4 for fairly so, else base blended with learned ones
    by at most 0.6 after ten updates."""
    if discriminative >= 0.8:
        return 0.75, 0.25
    if discriminative >= 0.5:
        return 0.6, 0.4
    share = min(updates / 10, 1.0) * 0.6
    mixed = [b * (1 - share) + v * share for b, v in zip(base, learned)]
    return mixed[0] / sum(mixed), mixed[1] / sum(mixed)


def learned_weights(current: tuple[float, float], helped_by_keywords: bool, rate: float = 0.05) -> tuple[float, float]:
    """One feedback step of the weights, kept normalised."""
    target = (1.0, 0.0) if helped_by_keywords else (0.0, 1.0)
    moved = [c + rate * (t - c) for c, t in zip(current, target)]
    return moved[0] / sum(moved), moved[1] / sum(moved)


def rerank_blend(fused: Column, refined: Column) -> Column:
    """0.6 of the fused score and 0.4 of it times a refined score in [0, 1]."""
    return fused * 0.6 + fused * 0.4 * F.least(F.greatest(refined, F.lit(0.0)), F.lit(1.0))


def importance_of(kind: Column, text: Column, entities: Column, tags: Column) -> Column:
    """Importance of a memory from its type, length, entities and tags, in [0, 1]."""
    base = F.when(kind.isin("Decision", "Error"), 0.30).when(kind.isin("Learning", "Discovery", "Pattern"), 0.25).when(kind.isin("Task", "CodeEdit"), 0.20).otherwise(0.10)
    count = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))
    length = F.when(count > 50, 0.25).when(count > 20, 0.15).when(count > 5, 0.05).otherwise(0.0)
    some = lambda c, step, most: F.least(F.coalesce(F.size(c), F.lit(0)) * step, F.lit(most))
    return F.least(base + length + some(entities, 0.04, 0.20) + some(tags, 0.03, 0.10), F.lit(1.0))


# Labels that a question word expects.
QUESTION_LABELS = """
who whom: Person Organization Team
where: Location Environment
when: Date Event
why: Event Concept
how: Concept Technology
"""
# Labels that a question with 'how' expects where it speaks of one of the words, and one with 'what' or 'which'.
HOW_LABELS = """
deploy ci cd pipeline build releas: Pipeline Technology Configuration
monitor metric alert observ: Metric Service
configur set_up setup: Configuration Technology
"""
WHAT_LABELS = """
tool tech framework language library stack: Technology Product Module
"""
# Relations that a verb's stem speaks of.
VERB_RELATIONS = """
work collabor: WorksWith WorksAt EmployedBy
employ hire: EmployedBy WorksAt
locat live base resid situat: LocatedIn LocatedAt
learn studi discover: Learned Knows
teach mentor instruct: Teaches
know familiar: Knows
use util adopt leverag read consult refer: Uses
creat build develop design: CreatedBy DevelopedBy
caus result lead: Causes ResultsIn
own belong possess: OwnedBy PartOf
contain includ consist: Contains PartOf
manag supervis oversee direct coordin schedul plan arrang organiz: Manages
assign deleg allocat: AssignedTo
approv reject review sign: Approves
depend requir need reliant: DependsOn Requires
prefer like favor favour chose choos select: Prefers
recommend suggest advis propos: Recommends
write document author draft compil: Documents CreatedBy
implement realiz fulfill: Implements
run execut launch start invok: Uses Triggers
deploy releas ship promot: DeploysTo
monitor track observ watch alert: Monitors
trigger fire emit: Triggers
configur tune adjust: Configures
migrat upgrad patch updat replac supersed obsolet deprec: SupersededBy
compar differ contrast benchmark: AlternativeTo
fix solv resolv debug repair: ResultsIn
connect integr link bridg coupl: DependsOn Uses
"""
# Concrete words for the stems of abstract ones, which a keyword search adds with little weight.
EXPANSIONS = """
pattern: decisions choices recurring repeated trend
prioriti: goals focus important urgent next
risk: concerns issues problems challenges threats
strategi: plan approach direction roadmap
lesson: learned mistakes insights takeaways
progress: status milestone completed remaining
impact: effect consequence result outcome
blocker: obstacle impediment stuck waiting
tradeoff: compromise versus cost benefit
retrospect: review reflection improvement feedback
evolv evolut: changed grew adapted shifted
theme: recurring common trend motif
perform: speed latency throughput faster optimized
improv: better faster fixed enhanced upgraded
achiev: completed accomplished reached delivered
key: important critical main primary essential
peopl person: team member responsible leading working
infrastructur: deploy server cloud hosting kubernetes
decis: chose decided selected picked adopted
deploy: infrastructure kubernetes server hosting cloud
moral: team mood happy celebrate social
dynamic: interaction relationship team collaboration
"""
EXPANSION_WEIGHT = 0.3


def _listed(text: str) -> dict[str, list[str]]:
    out = {}
    for line in text.strip().splitlines():
        names, values = line.split(":")
        out |= dict.fromkeys(names.split(), values.split())
    return out


_LABELS, _HOW, _WHAT, _VERBS, _MORE = map(_listed, (QUESTION_LABELS, HOW_LABELS, WHAT_LABELS, VERB_RELATIONS, EXPANSIONS))


@dataclass
class Intent:
    labels: list[str]
    relations: list[str]
    confidence: float


def intent_of(query: str) -> Intent:
    """What kinds of things and relations a question is after: its first word (and, for 'how', 'what' and 'which', what it speaks of) names
    labels, the stems of its words relations; 0.4 of confidence for each of the two, 0.2 for both."""
    line = " " + " ".join(query.lower().split())
    first = line.split()[0] if line.strip() else ""
    speaks = lambda table: next((v for k, v in table.items() if f" {k.replace('_', ' ')}" in line), None)
    labels = speaks(_HOW) or _LABELS["how"] if first == "how" else speaks(_WHAT) or [] if first in ("what", "which") else _LABELS.get(first, [])
    stems = [stem(w) for w in re.findall("[a-z]+", line)]
    relations = list(dict.fromkeys(r for s in stems for r in _VERBS.get(s, [])))
    return Intent(labels, relations, round(0.4 * bool(labels) + 0.4 * bool(relations) + 0.2 * bool(labels and relations), 6))


def expanded(query: str) -> dict[str, float]:
    """Words to add to a keyword search for the abstract ones in a question, with their weight; words that it holds are left out."""
    own = re.findall("[a-z]+", query.lower())
    return {w: EXPANSION_WEIGHT for s in map(stem, own) for w in _MORE.get(s, []) if w not in own}


def parsed(query: str) -> dict:
    """A question as a flat record: its kind, parts, words by role, phrases, negations, weights, intent, expansion, dates it names."""
    a, intent = analyse(query), intent_of(query)
    return {
        "kind": kind_of(query), "parts": decompose(query), "nouns": a.nouns, "modifiers": a.modifiers, "relations": a.relations, "negated": a.negated, "phrases": [" ".join(p) for p in a.phrases], "weights": a.weights(),
        "labels": intent.labels, "wanted": intent.relations, "confidence": intent.confidence, "expansion": sorted(expanded(query)), "dates": re.findall(r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])", query),
    }
