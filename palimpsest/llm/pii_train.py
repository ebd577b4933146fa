"""Train the personal-information tagger: ``python -m palimpsest.llm.pii_train FOLDER [TEACHER]``.

Labelled spans come from a bounded sample of contents: names from the persons annotated in ``entities`` (and the given names and
surnames that these annotations show), the other kinds from the formats of numbers and addresses and the class of the nearest word that
announces them. Training is maximum likelihood of the CRF by back-propagation through the BiLSTM, in numpy, with Adam. A tenth of all
contents is held out and reports span precision and recall. Annotations leave some names out, so the shipped weights come from two
rounds: the second run takes earlier weights as TEACHER of names.
"""

from __future__ import annotations

import multiprocessing
import re
import sys
import time
import zlib
from collections import Counter

import numpy as np

from palimpsest.llm import pii

#: Contents in the labelled sample, characters of a training window, hidden size; passes at most, windows of a batch, batches of a step
#: (one for each process), and seconds after which no further pass begins.
SAMPLE, CUT, HIDDEN = 9_000, 160, 24
PASSES, LANES, WORKERS, SECONDS = 60, 32, 8, 270
EMBED = 11

_L = r"[^\W\d_]"
#: Words that announce a number as a telephone's or a person's, and words that announce another number. Any of them may stand up to
#: ``NEAR`` characters before it in the same line; the nearest counts.
CONTEXT = {
    "PHONE": "tel telephone phone mobile cell fax call calls called callback ring rang dial text texted texting sms whatsapp line hotline reach reached voicemail left back".split(),
    "ID_NUMBER": "id ssn social security tax tin identity identification national nino insurance passport nif nie dni licence license".split(),
    "OTHER": "lot reference ref serial ticket version order invoice batch counter port build commit from to ran between of".split(),
}
NEAR = 40
_ANNOUNCED = {w: kind for kind, words in CONTEXT.items() for w in words}
_NUMBER = re.compile(r"(?<![\w.+/-])(?:\+|00(?=[ .-]))?\(?\d{1,5}\)?(?:[ .\-/]{1,2}\(?\d{1,8}\)?)*\d*(?:,?\s*(?:ext|extension|x)\.?\s*\d{1,6})?(?!\w)", re.I)
#: Shapes of identity numbers that no other number has, and shapes that need an announcing word.
_ID_ALONE = re.compile(r"(?<![\w-])(?:\d{3}-\d{2}-\d{4}|[A-Z]{2}[ -]?\d{2}[ -]?\d{2}[ -]?\d{2}[ -]?[A-D]|[XYZ]\d{7}[A-Z])(?![\w-])")
_ID_ANNOUNCED = re.compile(r"(?<![\w-])(?:\d{3} \d{2} \d{4}|\d{9}|[A-Z]{0,2}\d{6,9}[A-Z]?|[A-Z]{1,2}(?:[ -]?\d{2}){3}[ -]?[A-Z])(?![\w-])", re.I)
_EMAIL = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}\b|[\w.+-]+ ?[(\[{]at[)\]}] ?[\w-]+(?: ?[(\[{]?dot[)\]}]? ?[\w-]+|\.[\w-]+)+|[\w.+-]+ at [\w-]+(?: dot [\w-]+)+", re.I)
# Kinds of streets, before or behind their name.
_STREET = r"(?:street|st\.?|road|rd\.?|avenue|ave\.?|lane|ln\.?|close|drive|dr\.?|way|court|ct\.?|place|square|boulevard|blvd\.?)"
_FRONT = r"(?:calle|avenida|plaza|rue|via)"
_GERMAN = r"(?:straße|strasse|str\.|weg|platz|gasse|allee)"
_UNIT = r"(?:(?:flat|unit|apt\.?|suite) \w+)"
_PLACE = re.compile(
    rf"(?<!\w)(?:(?:{_UNIT}, )?\d{{1,5}}[a-z]? (?:{_L}+ ){{1,3}}?{_STREET}(?!\w)(?:, {_UNIT})?|{_FRONT} (?:{_L}+ ){{1,3}}\d{{1,4}}[a-z]?(?:, \d+º {_L})?|{_L}+{_GERMAN} \d{{1,4}}[a-z]?)"
    rf",(?P<code> \d{{5}})? (?P<town>{_L}+(?: {_L}+)?)(?P<tail>,?(?: [A-Z]{{2}})? \d{{5}})?",
    re.I,
)


def announced(text: str, at: int) -> str | None:
    """The kind that the nearest announcing word before a place in a line names."""
    words = re.findall(rf"{_L}+", text[max(0, at - NEAR, text.rfind("\n", 0, at) + 1) : at].lower())
    return next((_ANNOUNCED[w] for w in reversed(words) if w in _ANNOUNCED), None)


def towns(texts: list[str]) -> set[str]:
    """Towns of the addresses whose end a postcode or the case of letters shows, in lower case."""
    found: Counter = Counter()
    for m in (m for t in texts for m in _PLACE.finditer(t)):
        words = m["town"].split()
        if m["tail"] or len(words) == 1 or not words[1][0].isupper() or not words[0][0].isupper():
            found[(m["town"] if m["tail"] else words[0]).lower() if m["tail"] or words[0][0].isupper() else ""] += 1
        else:
            found[m["town"].lower()] += 1
    return {t for t, n in found.items() if t and n > 2}


def formats(text: str, known_towns: set[str]) -> list[tuple[int, int, str]]:
    """Spans that their format and the words around them show: addresses, e-mail addresses, identity and telephone numbers."""
    out: list[tuple[int, int, str]] = []

    def add(a: int, b: int, kind: str) -> None:
        if not any(a < y and x < b for x, y, _ in out):
            out.append((a, b, kind))

    for m in _PLACE.finditer(text):
        end, words = m.end(), m["town"].split()
        if not m["tail"] and len(words) == 2 and not (words[0].istitle() and words[1].istitle() or m["town"].lower() in known_towns):
            end = m.start("town") + len(words[0])
        add(m.start(), end, "ADDRESS")
    for m in _EMAIL.finditer(text):
        add(m.start(), m.end(), "EMAIL")
    for m in _ID_ALONE.finditer(text):
        if announced(text, m.start()) != "OTHER":
            add(m.start(), m.end(), "ID_NUMBER")
    for m in _ID_ANNOUNCED.finditer(text):
        if announced(text, m.start()) == "ID_NUMBER":
            add(m.start(), m.end(), "ID_NUMBER")
    for m in _NUMBER.finditer(text):
        digits = sum(c.isdigit() for c in m.group())
        plain_date = re.fullmatch(r"\d{4}-\d\d-\d\d", m.group())
        marked = m.group()[0] in "+(" or m.group().startswith("00 ") or re.search("[xX]", m.group())
        kind = announced(text, m.start())
        if 9 <= digits <= 20 and not plain_date and (kind == "PHONE" or (marked and kind is None)):
            add(m.start(), m.end(), "PHONE")
    return out


def name_lists(people: list[str]) -> tuple[set[str], set[str]]:
    """Given names (seen with many surnames) and the other words of annotated persons, in lower case."""
    beside: dict[str, set[str]] = {}
    for p in people:
        words = [w.lower() for w in re.findall(r"[^\W\d_]{2,}", p)]
        for w in words:
            beside.setdefault(w, set()).update(x for x in words if x != w)
    given = {w for w, others in beside.items() if len(others) >= 8 and sum(len(beside[o]) < len(others) for o in others) > len(others) / 2}
    return given, {w for w in beside if w not in given and len(w) > 4}


def label(text: str, people: list[str], given: set[str], surnames: set[str], known_towns: set[str] = frozenset()) -> list[tuple[int, int, int]]:
    spans: list[tuple[int, int, int]] = []

    def add(a: int, b: int, kind: str) -> None:
        if a < b and not any(a < y and x < b for x, y, _ in spans):
            spans.append((a, b, pii.KINDS.index(kind)))

    for a, b, kind in formats(text, known_towns):
        add(a, b, kind)
    for p in sorted(set(people), key=len, reverse=True):
        for m in re.finditer(rf"(?<!\w){re.escape(p)}(?!\w)", text):
            add(m.start(), m.end(), "NAME")
    word = r"[^\W\d_]+"
    for m in re.finditer(rf"(?<![\w@.+-])(?:({word})\.? +(?:{word}\. ?)?({word})|((?:[A-Za-z]\.){{1,2}}) ({word})|({word}), (?:({word})|[A-Z]\.))(?![\w@])", text):
        w = [x.lower() for x in m.groups() if x]
        if any(x in surnames for x in w) and (any(x in given for x in w) or m.group(3) or (m.group(5) and not m.group(6))):
            add(m.start(), m.end(), "NAME")
    return sorted(spans)


def tags_of(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    tags = np.zeros(length, np.int8)
    for a, b, kind in spans:
        tags[a:b] = 2 * kind + 2
        tags[a] = 2 * kind + 1
    return tags


class Net:
    """The network's parameters, its forward and backward pass over windows laid out as (time, features, lanes)."""

    def __init__(self, hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        f = lambda *s, by: (rng.standard_normal(s) * by).astype(np.float32)
        self.p = {"embed": f(pii.SYMBOLS, EMBED, by=0.3)}
        for d in "fb":
            self.p |= {f"in_{d}": f(EMBED, 4 * hidden, by=0.3), f"b_{d}": np.zeros(4 * hidden, np.float32), f"rec_{d}": f(4 * hidden, hidden, by=1 / np.sqrt(hidden))}
            self.p[f"b_{d}"][hidden : 2 * hidden] = 2.0
        self.p |= {"out": f(pii.TAGS, 2 * hidden, by=0.2), "bias": np.zeros(pii.TAGS, np.float32), "trans": np.zeros((pii.TAGS, pii.TAGS), np.float32), "start": np.zeros(pii.TAGS, np.float32)}
        self.hidden = hidden
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        self.steps = 0

    def frozen(self) -> dict[str, np.ndarray]:
        """The form that decoding uses: the bias as a last element of every symbol's vector, hidden and input weights side by side."""
        p = self.p
        weights = {f"rec_{d}": np.concatenate([p[f"rec_{d}"], p[f"in_{d}"].T, p[f"b_{d}"][:, None]], axis=1) for d in "fb"}
        return pii.strict(weights | {"embed": np.concatenate([p["embed"], np.ones((pii.SYMBOLS, 1), np.float32)], axis=1)} | {k: p[k] for k in ("out", "bias", "trans", "start")})

    def _run(self, symbols, d):
        p, size = self.p, self.hidden
        table = p["embed"] @ p[f"in_{d}"] + p[f"b_{d}"]
        h, c = np.zeros((size, symbols.shape[1]), np.float32), np.zeros((size, symbols.shape[1]), np.float32)
        kept, out = [], np.empty((len(symbols), size, symbols.shape[1]), np.float32)
        for t in range(len(symbols)):
            z = p[f"rec_{d}"] @ h + table[symbols[t]].T
            s = np.clip(z[: 3 * size] * 0.25 + 0.5, 0, 1)
            g = np.tanh(z[3 * size :])
            old = c
            c = old * s[size : 2 * size] + g * s[:size]
            u = np.tanh(c)
            kept.append((h, old, s, g, u))
            h = out[t] = s[2 * size :] * u
        return out, kept

    def _unrun(self, symbols, d, kept, grad, g_out):
        p, size, lanes = self.p, self.hidden, symbols.shape[1]
        g_table = np.zeros((pii.SYMBOLS, 4 * size), np.float32)
        g_rec = np.zeros_like(p[f"rec_{d}"])
        dh_next, dc = np.zeros((size, lanes), np.float32), np.zeros((size, lanes), np.float32)
        dzs = np.empty((len(symbols), 4 * size, lanes), np.float32)
        for t in range(len(symbols) - 1, -1, -1):
            h, old, s, g, u = kept[t]
            dh = g_out[t] + dh_next
            dc = dc + dh * s[2 * size :] * (1 - u * u)
            ds = np.concatenate([dc * g, dc * old, dh * u])
            dz = dzs[t]
            dz[: 3 * size] = ds * ((s > 0) & (s < 1)) * 0.25
            dz[3 * size :] = dc * s[:size] * (1 - g * g)
            dc = dc * s[size : 2 * size]
            g_rec += dz @ h.T
            dh_next = p[f"rec_{d}"].T @ dz
        flat = dzs.transpose(0, 2, 1).reshape(-1, 4 * size)
        np.add.at(g_table, symbols.ravel(), flat)
        grad[f"rec_{d}"] = g_rec
        grad[f"in_{d}"] = p["embed"].T @ g_table
        grad[f"b_{d}"] = g_table.sum(0)
        grad["embed"] = grad.get("embed", 0) + g_table @ p[f"in_{d}"].T

    def loss(self, symbols, tags, lengths):
        """Mean negative log likelihood per lane, and gradients."""
        p = self.p
        steps, lanes = symbols.shape
        ahead, kept_f = self._run(symbols, "f")
        back, kept_b = self._run(symbols[::-1], "b")
        back = back[::-1]
        both = np.concatenate([ahead, back], axis=1)
        scores = np.matmul(p["out"], both) + p["bias"][None, :, None]
        live = np.arange(steps)[:, None] < lengths[None]
        alpha = np.empty((steps, pii.TAGS, lanes))
        alpha[0] = scores[0] + p["start"][:, None]
        trans = p["trans"].astype(float)
        exp_t = np.exp(trans - trans.max())
        for t in range(1, steps):
            top = alpha[t - 1].max(0)
            step = np.log(exp_t.T @ np.exp(alpha[t - 1] - top) + 1e-300) + top + trans.max() + scores[t]
            alpha[t] = np.where(live[t], step, alpha[t - 1])
        top = alpha[-1].max(0)
        norm = np.log(np.exp(alpha[-1] - top).sum(0)) + top
        beta = np.zeros((pii.TAGS, lanes))
        d_scores = np.empty_like(scores)
        g_trans = np.zeros_like(trans)
        lane = np.arange(lanes)
        for t in range(steps - 1, -1, -1):
            d_scores[t] = np.exp(alpha[t] + beta - norm) * live[t]
            if t:
                ahead_t = beta + scores[t]
                peak = ahead_t.max(0)
                e = np.exp(ahead_t - peak)
                before = np.exp(alpha[t - 1] + peak - norm + trans.max()) * live[t]
                g_trans += exp_t * (before @ e.T)
                beta = np.where(live[t], np.log(exp_t @ e + 1e-300) + peak + trans.max(), beta)
        g_start = d_scores[0].sum(1)
        gold = 0.0
        for t in range(steps):
            d_scores[t, tags[t], lane] -= live[t]
            gold = gold + scores[t, tags[t], lane] * live[t]
            if t:
                np.add.at(g_trans, (tags[t - 1], tags[t]), -1.0 * live[t])
                gold = gold + trans[tags[t - 1], tags[t]] * live[t]
        np.add.at(g_start, tags[0], -1.0)
        gold = gold + p["start"][tags[0]]
        d_scores /= lanes
        grad: dict[str, np.ndarray] = {"trans": g_trans / lanes, "start": g_start / lanes, "bias": d_scores.sum((0, 2)), "out": np.einsum("tkl,thl->kh", d_scores, both, optimize=True)}
        d_both = np.matmul(p["out"].T, d_scores.astype(np.float32))
        self._unrun(symbols, "f", kept_f, grad, d_both[:, : self.hidden])
        self._unrun(symbols[::-1], "b", kept_b, grad, d_both[::-1, self.hidden :])
        return float((norm - gold).mean()), grad

    def step(self, grad: dict[str, np.ndarray], rate: float) -> None:
        self.steps += 1
        size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        shrink = min(1.0, 5.0 / (size + 1e-9))
        for k, g in grad.items():
            m, v = self.moments[k]
            g = (g * shrink).astype(np.float32)
            m += 0.1 * (g - m)
            v += 0.002 * (g * g - v)
            self.p[k] -= (rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.998**self.steps)) + 1e-8)).astype(np.float32)


def cut(texts: list[str], spans: list[list], rng) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for t, s in zip(texts, spans):
        codes, tags = pii.encode(t), tags_of(len(t), s)
        at = -int(rng.integers(0, CUT // 2)) if len(t) > CUT else 0
        while at < len(t):
            a, b = max(0, at), min(len(t), at + CUT)
            if b - a >= 12 and (tags[a:b].any() or rng.random() < 0.5):
                own = tags[a:b].copy()
                if own[0] and own[0] % 2 == 0:
                    own[0] -= 1  # a span cut by the window's edge begins there
                out.append((codes[a:b], own))
            at += CUT
    return out


def _padded(batch: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(c) for c, _ in batch])
    symbols, tags = np.full((lengths.max(), len(batch)), pii._PAD, np.uint8), np.zeros((lengths.max(), len(batch)), np.int64)
    for k, (c, g) in enumerate(batch):
        symbols[: len(c), k], tags[: len(c), k] = c, g
    return symbols, tags, lengths


def _gradient(job: tuple[int, dict, list]) -> tuple[float, dict[str, np.ndarray]]:
    hidden, parameters, batch = job
    net = Net(hidden)
    net.p = parameters
    return net.loss(*_padded(batch))


def train(texts: list[str], spans: list[list], passes: int = PASSES, lanes: int = LANES, hidden: int = HIDDEN, seconds: float = SECONDS, said=print, workers: int = 1) -> Net:
    """A step takes the mean gradient of ``workers`` batches, computed in as many processes."""
    net, rng, began = Net(hidden), np.random.default_rng(7), time.time()
    pool = multiprocessing.get_context("fork").Pool(workers) if workers > 1 else None
    for n in range(passes):
        pieces = cut(texts, spans, rng)
        pieces.sort(key=lambda x: len(x[0]) + rng.random() * 20)
        starts = rng.permutation(range(0, len(pieces), lanes))
        total, rate = 0.0, 0.012 * 0.5 ** (6.0 * max(n / passes, (time.time() - began) / seconds))
        for k in range(0, len(starts), workers):
            jobs = [(hidden, net.p, pieces[s : s + lanes]) for s in starts[k : k + workers]]
            results = pool.map(_gradient, jobs) if pool else map(_gradient, jobs)
            values, grads = zip(*results)
            net.step({key: sum(g[key] for g in grads) / len(grads) for key in grads[0]}, rate)
            total += sum(values)
        said(f"pass {n}: loss {total / len(starts):.3f}, {time.time() - began:.0f} s", flush=True) if said is print else said(total / len(starts))
        if time.time() - began > seconds:
            break
    if pool:
        pool.close()
    return net


def measure(model: dict[str, np.ndarray], texts: list[str], spans: list[list]) -> dict[str, tuple[int, int, int]]:
    """Per kind: labelled, found, and found exactly."""
    found = pii.find(texts, model)
    out = {}
    for kind in pii.KINDS:
        true = {(k, a, b) for k, s in enumerate(spans) for a, b, c in s if pii.KINDS[c] == kind}
        got = {(k, a, b) for k, s in enumerate(found) for a, b, c in s if c == kind}
        out[kind] = (len(true), len(got), len(true & got))
    return out


def held_out(content: str) -> bool:
    """A tenth of all contents, all records that share a content alike, is never trained on."""
    return zlib.crc32(content.encode()) % 10 == 0


def labelled_sample(folder: str, most: int = SAMPLE, teacher: dict[str, np.ndarray] | None = None, held: bool = False) -> tuple[list[str], list[list]]:
    """A bounded sample of contents with labelled spans: all kinds but names first, then names, and a fifth without any; of the contents
    that are trained on, or of those held out.

    Annotations leave names out; with a ``teacher`` (a tagger trained on the annotations alone) its names are added.
    """
    import pyarrow.dataset as ds

    table = ds.dataset(f"{folder}/memories.parquet").to_table(columns=["id", "content", "entities"]).to_pylist()
    judged = ds.dataset(f"{folder}/eval_memories.parquet").to_table(columns=["id", "content"]).to_pylist()
    rows = [r for r in [*{r["id"]: r for r in table}.values(), *judged] if r["content"]]
    person = lambda e: e["text"] and (e["type"] or "").lower() in ("person", "per")
    given, surnames = name_lists([e["text"] for r in rows for e in r.get("entities") or [] if person(e)])
    known_towns = towns([r["content"] for r in rows])
    rows = [rows[k] for k in np.random.default_rng(11).permutation(len(rows)) if held_out(rows[k]["content"]) == held]
    labelled = [(r["content"], label(r["content"], [e["text"] for e in r.get("entities") or [] if person(e)], given, surnames, known_towns)) for r in rows]
    rank = [0 if any(pii.KINDS[k] != "NAME" for _, _, k in s) else 1 if s else 2 for _, s in labelled]
    rare, named, none = ([x for x, r in zip(labelled, rank) if r == k] for k in range(3))
    chosen = rare[: most // 2]
    chosen += none[: most // 5]
    chosen += named[: most - len(chosen)]
    chosen = [chosen[k] for k in np.random.default_rng(13).permutation(len(chosen))]
    texts, spans = [t for t, _ in chosen], [s for _, s in chosen]
    if teacher is not None:
        for own, seen in zip(spans, pii.find(texts, teacher)):
            own += [(a, b, pii.KINDS.index(k)) for a, b, k in seen if k == "NAME" and not any(a < y and x < b for x, y, _ in own)]
            own.sort()
    return texts, spans


def main(folder: str, teacher: str | None = None) -> None:
    names_of = pii.load(teacher) if teacher else None
    texts, spans = labelled_sample(folder, teacher=names_of)
    print(len(texts), "texts", Counter(pii.KINDS[k] for s in spans for _, _, k in s))
    model = train(texts, spans, workers=WORKERS).frozen()
    print("held out", measure(model, *labelled_sample(folder, SAMPLE // 4, names_of, held=True)))
    np.savez_compressed(pii.MODEL, **{k: v.astype(np.float16 if k not in ("trans", "start", "bias") else np.float32) for k, v in model.items()})


if __name__ == "__main__":
    main(*sys.argv[1:])
