"""Personal information inside free text: a character BiLSTM with CRF transitions, in numpy.

Texts are cut into overlapping windows. A bidirectional LSTM over characters gives emission scores for the tags O, B-k, I-k of the
kinds e-mail, phone, identity number, address and name; a linear-chain CRF decodes them. Positions that no winning path can mark (a
bound over all runs of positions) are known to be O; only the stretches between them are decoded. The spans of all windows of a text are
reconciled globally: of conflicting spans the set of greatest total score is kept (weighted interval scheduling), where spans cut by a
window's edge count for less than whole ones. An exact check follows: the ends of a span are moved to the form of its kind that it
touches; a span that touches none keeps the network's ends, without labels and punctuation.

Weights are read from ``pii_model.npz``, made by ``python -m palimpsest.llm.pii_train`` from labelled spans.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME"]
TAGS = 1 + 2 * len(KINDS)
WINDOW, OVERLAP = 640, 96
LANES = 512
MODEL = Path(__file__).with_name("pii_model.npz")

_ONLY_O = np.where(np.arange(TAGS) == 0, np.float32(0), np.float32(-1e4))[:, None]
_clip = np._core.umath.clip
_SIGNS = "\n !\"#$%&'()*+,-./0123456789:;<=>?@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]^_`abcdefghijklmnopqrstuvwxyz{|}~"
_TABLE = np.zeros(0x250, np.uint8)
_UPPER, _LOWER, _OTHER, _PAD = len(_SIGNS), len(_SIGNS) + 1, len(_SIGNS) + 2, len(_SIGNS) + 3
SYMBOLS = len(_SIGNS) + 4
for _k in range(0x250):
    _c = chr(_k)
    _TABLE[_k] = _SIGNS.index(_c) if _c in _SIGNS else _SIGNS.index(" ") if _c.isspace() else _UPPER if _c.isupper() else _LOWER if _c.isalpha() else _OTHER


def encode(text: str) -> np.ndarray:
    """A symbol per character; letters outside ASCII are told apart by case only, rare signs are one symbol."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 0x250, _TABLE[np.minimum(points, 0x24F)], np.uint8(_OTHER))


def one_way(symbols: np.ndarray, idle: np.ndarray, embed: np.ndarray, weights: np.ndarray, out: np.ndarray) -> Iterator[np.ndarray]:
    """Scores (tags, lanes) that one direction of the LSTM gives each of its steps; the array is used again in the next step. ``idle``:
    of each step, the number of lanes, from the first on, whose text is not read in it; a lane's state is zero until its text begins.
    ``embed``: a vector per symbol, the last element 1 for the bias; ``weights``: of the hidden state and that vector; ``out``: of the
    hidden state alone. Gates i, f, o are piecewise linear, their slope and offset folded into the weights. As exp takes half the time
    of tanh, p tanh(x) is p - p / ((1 + exp(2 x)) / 2), with 2 and the half folded into the weights where they can be. The scores of a
    step come with the product of the next one."""
    steps, lanes = symbols.shape
    size, tags = len(weights) // 4, len(out)
    weights = weights * np.repeat(np.array([0.25, 1.0], np.float32), [3 * size, size])[:, None]
    weights[: 3 * size, -1] += 0.5
    weights[3 * size :] *= 2
    weights[3 * size :, -1] -= np.log(2)
    rows = 4 * size + -(-tags // 4) * 4  # whole blocks of the matrix product
    weights = np.concatenate([weights, np.pad(out, ((0, rows - 4 * size - tags), (0, weights.shape[1] - size)))])
    all_given, all_c, all_z = np.zeros((weights.shape[1], lanes), np.float32), np.zeros((size, lanes), np.float32), np.empty((rows, lanes), np.float32)
    vectors, symbols = np.ascontiguousarray(embed.T), symbols.astype(np.intp, order="C")
    zero, half, one, two = np.float32([0, 0.5, 1, 2])
    from_lane = np.minimum(idle, np.concatenate([idle[:1], idle])[:-1]).tolist()  # with those whose last scores are due
    low = -1
    for t in range(steps):
        if from_lane[t] != low:
            low = from_lane[t]
            given, c, z = all_given[:, low:], all_c[:, low:], all_z[:, low:]
            h, x, s, g = given[:size], given[size:], z[: 3 * size], z[3 * size : 4 * size]
            i, f, o = s[:size], s[size : 2 * size], s[2 * size :]
        if low:
            x[:] = vectors.take(symbols[t, low:], axis=1)
        else:
            vectors.take(symbols[t], axis=1, out=x, mode="clip")
        np.matmul(weights, given, out=z)
        if t:
            yield all_z[4 * size : 4 * size + tags]
        _clip(s, zero, one, out=s)
        np.exp(g, out=g)
        g += half
        np.divide(i, g, out=g)
        c *= f
        c += i
        c -= g
        np.multiply(c, two, out=h)
        np.exp(h, out=h)
        h += one
        np.divide(o, h, out=h)
        h *= two
        np.subtract(o, h, out=h)
    if steps:
        yield np.matmul(out, all_given[:size])


def emissions(model: dict[str, np.ndarray], symbols: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
    """Scores (time, tags, lanes) of windows given as columns of ``symbols``, which end at ``ends`` (in ascending order); only O is
    possible behind. What a window's scores are does not depend on the windows beside it."""
    steps, lanes = symbols.shape
    size, bias = len(model["rec_f"]) // 4, model["bias"][:, None]
    idle = np.searchsorted(np.full(lanes, steps) if ends is None else ends, np.arange(steps), side="right")
    scores = np.empty((steps, len(model["out"]), lanes), np.float32)
    with np.errstate(over="ignore"):  # an infinite exp stands for a tanh of 1
        for own, low, told in zip(scores, idle, one_way(symbols, idle, model["embed"], model["rec_f"], model["out"][:, :size])):
            np.add(told[:, low:], bias, out=own[:, low:])
            own[:, :low] = _ONLY_O
        for own, low, told in zip(scores[::-1], idle[::-1], one_way(symbols[::-1], idle[::-1], model["embed"], model["rec_b"], model["out"][:, size:])):
            own[:, low:] += told[:, low:]
    return scores


def possible(model: dict[str, np.ndarray], scores: np.ndarray) -> np.ndarray:
    """Positions (time, lanes) that a path of greatest score may mark.

    Set against O in its place, a run of one kind gains what its positions gain, its first as a beginning, and the ways in and out
    (``load`` forbids other beginnings). At each position the kind that gains most bounds the others. A position all of whose runs
    lose by these bounds is O.
    """
    step, start = model["trans"], model["start"]
    first, inner = np.arange(1, TAGS, 2), np.arange(2, TAGS, 2)
    enter = np.maximum((step[:, first] - step[:, :1]).max(axis=0), start[first] - start[0])
    stay = step[[first, inner], inner].max(axis=0) - step[0, 0]
    onto = np.concatenate([[0], first])
    leave = max(float((np.maximum(step[first], step[inner])[:, onto] - step[0, onto]).max()), 0.0)
    upto, gone_on = np.empty((2, len(scores), scores.shape[2]), np.float32)
    way = np.empty((len(first), scores.shape[2]), np.float32)
    for own, begun, more in zip(scores, upto, gone_on):
        for rows, gain, best in ((own[1::2], enter, begun), (own[2::2], stay, more)):
            np.add(rows, gain[:, None], out=way)
            np.maximum.reduce(way, axis=0, out=best)
            best -= own[0]
    onward = np.zeros_like(upto)
    for t in range(1, len(scores)):
        np.maximum(upto[t], upto[t - 1] + gone_on[t], out=upto[t])
        np.maximum(onward[-t] + gone_on[-t], 0, out=onward[-t - 1])
    upto += onward
    return upto > -leave


def viterbi(model: dict[str, np.ndarray], scores: np.ndarray, fresh: np.ndarray | bool = True) -> np.ndarray:
    """Best tags (time, lanes) of scores (time, tags, lanes). Only the best totals are kept on the way; the way back picks the one
    predecessor that it needs. Lanes not ``fresh`` go on from O."""
    step = model["trans"]
    totals = np.empty_like(scores)
    totals[0] = scores[0] + np.where(fresh, model["start"][:, None], step[0][:, None])
    way, steps = np.empty((TAGS, TAGS, scores.shape[2]), np.float32), np.ascontiguousarray(step)[:, :, None]
    for t in range(1, len(scores)):
        np.add(totals[t - 1][:, None], steps, out=way)
        np.maximum.reduce(way, axis=0, out=totals[t])
        totals[t] += scores[t]
    tags = np.empty((len(scores), scores.shape[2]), np.int8)
    tags[-1] = totals[-1].argmax(axis=0)
    into = np.ascontiguousarray(step.T)
    for t in range(len(scores) - 1, 0, -1):
        tags[t - 1] = (into[tags[t]].T + totals[t - 1]).argmax(axis=0)
    return tags


def decoded(model: dict[str, np.ndarray], scores: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Tags of the stretches ``(lane, first position, tags)`` that hold spans, of windows that end at ``ends``; all else is O.

    A stretch is decoded with one O behind it, also at its window's end, so that the way out of a span is paid for.
    """
    maybe = possible(model, scores) & (np.arange(len(scores))[:, None] < ends)
    turns = np.diff(np.pad(maybe, ((1, 1), (0, 0))).astype(np.int8), axis=0)
    lane, first = np.nonzero(turns.T == 1)
    end = np.nonzero(turns.T == -1)[1]
    order = np.argsort(end - first, kind="stable")
    lengths, low, flat = (end - first)[order], 0, scores.reshape(-1)
    while low < len(order):
        # Stretches of like length side by side, so that little is decoded behind their ends.
        high = min(low + LANES, max(low + LANES // 8, int(np.searchsorted(lengths, lengths[low] * 1.3 + 8, "right"))), len(order))
        some, low = order[low:high], high
        at = first[some] + np.arange(int(lengths[high - 1]) + 1)[:, None]
        place = np.minimum(at, len(scores) - 1) * (TAGS * scores.shape[2]) + lane[some]
        taken = flat.take(place[:, None] + np.arange(TAGS)[:, None] * scores.shape[2])
        np.copyto(taken, _ONLY_O, where=(at >= end[some])[:, None])
        tags = viterbi(model, taken, first[some] == 0)
        for j in np.flatnonzero(tags.any(axis=0)):
            yield int(lane[some[j]]), int(first[some[j]]), tags[: end[some[j]] - first[some[j]], j]


@functools.lru_cache(1)
def load(path: str = str(MODEL)) -> dict[str, np.ndarray]:
    with np.load(path) as f:
        return strict({k: np.ascontiguousarray(f[k].astype(np.float32)) for k in f.files})


def strict(model: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The model with spans that begin with their beginning: I-k follows only B-k and I-k."""
    trans, start = model["trans"].copy(), model["start"].copy()
    for k in range(2, TAGS, 2):
        trans[[t for t in range(TAGS) if t not in (k - 1, k)], k] = start[k] = -1e4
    return model | {"trans": trans, "start": start}


def windows(length: int) -> list[tuple[int, int]]:
    """Overlapping windows that cover a text of ``length`` characters."""
    if length <= WINDOW:
        return [(0, length)]
    step = WINDOW - OVERLAP
    return [(a, min(length, a + WINDOW)) for a in range(0, length - OVERLAP, step)]


def runs(tags: list[int]) -> Iterator[tuple[int, int, int]]:
    """The runs ``(start, end, kind)`` of tags of one kind; a beginning starts a run."""
    begun = kind = -1
    for t, tag in enumerate([*tags, 0]):
        if tag % 2 or (tag + 1) // 2 != kind + 1:
            if kind >= 0:
                yield begun, t, kind
            begun, kind = t, (tag - 1) // 2 if tag else -1


def raw_spans(model: dict[str, np.ndarray], texts: list[str]) -> list[list[tuple[int, int, int, float]]]:
    """Per text the reconciled spans ``(start, end, kind, score)`` that the network marks."""
    codes, ends = encode("".join(texts)), np.cumsum([len(t) for t in texts]).tolist()
    codes = [codes[end - len(t) : end] for t, end in zip(texts, ends)]
    jobs = [(k, a, b) for k, c in enumerate(codes) for a, b in windows(len(c)) if b > a]
    jobs.sort(key=lambda j: j[2] - j[1])
    spans: list[list] = [[] for _ in texts]
    for low in range(0, len(jobs), LANES):
        batch = jobs[low : low + LANES]
        steps = max(b - a for _, a, b in batch)
        symbols = np.full((len(batch), steps), _PAD, np.uint8)
        for lane, (k, a, b) in enumerate(batch):
            symbols[lane, : b - a] = codes[k][a:b]
        ends = np.array([b - a for _, a, b in batch])
        scores = emissions(model, symbols.T, ends)
        for lane, first, tags in decoded(model, scores, ends):
            k, a, b = batch[lane]
            for x, y, kind in runs(tags.tolist()):
                own = scores[first + x : first + y, :, lane]
                gain = float((own[:, 2 * kind + 1 : 2 * kind + 3].max(axis=1) - own[:, 0]).sum())
                x, y = first + x, first + y
                whole = (x > 0 or a == 0) and (y < b - a or b == len(codes[k]))
                spans[k].append((a + x, a + y, kind, max(gain, 0.1) * (1.0 if whole else 0.3)))
    return [reconcile(s) for s in spans]


def reconcile(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """The non-overlapping spans of greatest total score."""
    if len(spans) < 2:
        return spans
    spans = sorted(set(spans), key=lambda s: (s[1], s[0]))
    best, keep = [0.0], [()]
    ends = [s[1] for s in spans]
    from bisect import bisect_right

    for k, s in enumerate(spans):
        before = bisect_right(ends, s[0], 0, k)
        with_it = best[before] + s[3]
        if with_it > best[k]:
            best.append(with_it)
            keep.append((before, k))
        else:
            best.append(best[k])
            keep.append(())
    out, k = [], len(spans)
    while k:
        if keep[k]:
            out.append(spans[keep[k][1]])
            k = keep[k][0]
        else:
            k -= 1
    return out[::-1]


# The forms to which ends are moved.
_LETTER = r"[^\W\d_]"
FORMS = {
    "EMAIL": re.compile(r"[\w.+%-]+(?:@|\s?[(\[{]\s?at\s?[)\]}]\s?|\s+at\s+)[a-z0-9-]+(?:(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?|\s+dot\s+)[a-z0-9-]+)*(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?|\s+dot\s+)[a-z]{2,}(?![\w@])", re.I),
    "PHONE": re.compile(r"(?<![\w.+-])(?:\+\d{7,15}|\d{10})(?![\w-])|(?<![\w.+])(?!\d{4}-\d\d-\d\d(?!\d))(?:\+|00(?=[ .-]))?(?:\(\d{1,5}\)|\d{1,5})(?:[ .\-/]{1,2}(?:\(\d{1,5}\)|\d{2,8}|\d(?=[ .-]\d)))+(?:,?\s*(?:ext|extension|x|durchwahl)\.?\s*\d{1,6})?(?!\w)", re.I),
    "ID_NUMBER": re.compile(r"(?<![\w-])(?:[A-Z]{1,2}[ -]?\d{2}[ -]?\d{2}[ -]?\d{2}[ -]?[A-Z]|[A-Z]\d{7}[A-Z]|\d{8}[A-Z]|\d{3}[- ]?\d{2}[- ]?\d{4}|[A-Z]{0,2}\d{6,9}[A-Z]?)(?![\w-])", re.I),
    "ADDRESS": re.compile(
        rf"(?<!\w)(?:(?:flat|unit|apt\.?|suite)\s+\w+,\s+)?(?:\d{{1,5}}[a-z]?\s+(?:{_LETTER}+\s+){{1,3}}?(?:street|st|road|rd|avenue|ave|lane|ln|close|drive|dr|way|court|ct|place|square|boulevard|blvd)\b\.?"
        rf"|(?:calle|avenida|rue|plaza|via)\s+(?:{_LETTER}+\s+){{1,3}}\d{{1,4}}[a-z]?|{_LETTER}+(?:straße|strasse|str\.|weg|platz|gasse|allee)\s+\d{{1,4}}[a-z]?)"
        rf"(?:,\s+(?:apt|unit|flat|suite)\.?\s+\w+|,\s+\d+º\s*[a-z])?(?:,\s+(?:\d{{5}}\s+)?(?-i:[A-Z]{_LETTER}+(?: [A-Z]{_LETTER}+)?|[a-z]+(?= \d{{5}})|[a-z]+ [a-z]+(?= \d{{5}})|[a-z]+)(?:,?\s+(?:[A-Z]{{2}}\s+)?\d{{5}})?)?",
        re.I,
    ),
}
_WORD = rf"(?:{_LETTER}+(?:['’-]{_LETTER}+)*)"
_INITIALS = rf"(?:{_LETTER}\.\s?){{1,3}}"
_TOKENISH = re.compile(rf"{_LETTER}\.(?:{_LETTER}\.)*|{_WORD}\.?")


def _name(text: str, a: int, b: int) -> tuple[int, int] | None:
    """Whole words from ``a`` to ``b``; the stop of an initial or short form belongs to the name, a sentence's does not."""
    while a > 0 and (text[a - 1].isalpha() or text[a - 1] in "'’-") and text[a].isalpha():
        a -= 1
    while b < len(text) and text[b].isalpha() and text[b - 1].isalpha():
        b += 1
    piece = text[a:b]
    lead = len(piece) - len(piece.lstrip(" \t\n,;:.-–'\"(*_"))
    a, piece = a + lead, piece[lead:]
    piece = piece.rstrip(" \t\n,;:-–'\"()*_")
    b = a + len(piece)
    if not piece or "\n" in piece or re.search(r"[\d@/_<>]", piece):
        return None
    # An initial right before or behind belongs to it.
    m = re.search(rf"(?<![\w.])(?<!\d )(?:{_LETTER}\.\s?){{1,3}}$", text[max(0, a - 12) : a])
    if m and (m.group()[0].isupper() or piece.islower()) and "." not in piece and "," not in piece:
        a -= len(m.group())
    m = re.match(rf",?\s(?:{_LETTER}\.){{1,3}}(?=\s|,|:|$)", text[b : b + 9])
    if m and "." not in piece and "," not in piece:
        b += m.end()
    piece = text[a:b]
    if piece.endswith("."):
        last = re.search(rf"({_LETTER}+)\.$", piece)
        if not last or (len(last.group(1)) > 1 and "," not in piece):
            b -= 1
    elif text[b : b + 1] == "." and re.search(rf"(?:^|[\s,.]){_LETTER}$", piece):
        b += 1
    words = _TOKENISH.findall(text[a:b])
    if len(words) < 2 or not any(len(w.rstrip(".")) > 2 for w in words):
        return None
    return a, b


#: What a span without a form needs, at least, to be one of its kind; labels that are no part of it.
_LEAST = {"EMAIL": r"\w.*(?:@|\bat\b).*\w(?:\.|.*\bdot\b).*\w", "PHONE": r"(?:\D*\d){7}", "ID_NUMBER": r"(?:\D*\d){5}", "ADDRESS": r"(?=.*\d)[^\W_]+\W+(?:\w+\W+)*?[^\W\d_]{2,}"}
_LABEL = re.compile(r"^(?:(?:e-?mail|mail|tel(?:ephone)?|phone|mobile|cell|fax|id|ssn|no|number|address|at)\b[\s.:#]*)+", re.I)


def _bare(text: str, a: int, b: int) -> tuple[int, int]:
    """The span's whole words without labels, blanks and punctuation around it."""
    while a > 0 and a < len(text) and text[a - 1].isalnum() and text[a].isalnum():
        a -= 1
    while b < len(text) and text[b - 1].isalnum() and text[b].isalnum():
        b += 1
    a += len(text[a:b]) - len(text[a:b].lstrip(" \t\n,;:.-–'\"*_"))
    label = _LABEL.match(text[a:b])
    a += label.end() if label and label.end() < b - a else 0
    return a, a + len(text[a:b].rstrip(" \t\n,;:.-–'\"(*_"))


def settle(text: str, spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, str]]:
    """The exact check: each span takes the ends of the form of its kind that it overlaps most; an address may end behind its form,
    where the network ends it. A span without such a form keeps its own whole words, if they can be of its kind at all."""
    out: list[tuple[int, int, str]] = []
    for a, b, kind, _ in spans:
        name = KINDS[kind]
        if name == "NAME":
            ends = _name(text, a, b)
        else:
            near = [(max(0, min(m.end(), b) - max(m.start(), a)), m.start(), m.end()) for m in FORMS[name].finditer(text, _line_start(text, a), min(len(text), b + 80))]
            touching = [x for x in near if x[0] > 0]
            if touching:
                ends = max(touching)[1:]
                if name == "ADDRESS" and b > ends[1] and not re.search(r"[.,;:!?\n]", text[ends[1] : b]):
                    ends = (ends[0], max(ends[1], _bare(text, ends[0], b)[1]))
            else:
                ends = _bare(text, a, b)
                if re.search(r"[^\W_][-_/]?$", text[max(0, ends[0] - 2) : ends[0]]) or re.match(r"[-_/]?[^\W_]", text[ends[1] : ends[1] + 2]):
                    continue  # part of a longer token
            if not re.search(_LEAST[name], text[ends[0] : ends[1]], re.I | re.S):
                ends = None
        if ends and not any(ends[0] < y and x < ends[1] for x, y, _ in out):
            out.append((*ends, name))
    return out


def _line_start(text: str, a: int) -> int:
    low = max(0, a - 80)
    cut = max(text.rfind("\n", low, a), text.rfind(". ", low, max(low, a - 12)))
    return low if cut < 0 else cut + 1


def find(texts: list[str | None], model: dict[str, np.ndarray] | None = None) -> list[list[tuple[int, int, str]]]:
    """Spans ``(start, end, kind)`` of each text; nulls and empty texts have none."""
    model = model or load()
    some = list(dict.fromkeys(t for t in texts if t))  # a text that repeats is read once
    settled = {t: settle(t, spans) for t, spans in zip(some, raw_spans(model, some))}
    return [settled.get(t, []) for t in texts]


def placeholders(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in sorted(spans):
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join(out) + text[at:]


def _apply(width: int, what: str):
    """Tag batches of (keys..., content): ``what`` is 'spans' (a row per span) or 'texts' (a row per record)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(width).to_pylist()
            spans = find(texts)
            keys = list(range(width))
            if what == "texts":
                done = [None if t is None else placeholders(t, s) for t, s in zip(texts, spans)]
                listed = [[{"kind": k, "value": t[a:b], "start": a} for a, b, k in s] for t, s in zip(texts, spans)]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string()), ("start", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(done, pa.string()), pa.array(listed, kind)], [*batch.schema.names[:width], "redacted", "replaced"])
            else:
                rows = [(k, s) for k, own in enumerate(spans) for s in own]
                taken = batch.take(pa.array([k for k, _ in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*(taken.column(k) for k in keys), pa.array([s[2] for _, s in rows], pa.string()), pa.array([texts[k][s[0] : s[1]] for k, s in rows], pa.string()), pa.array([s[0] for _, s in rows], pa.int32())],
                    [*batch.schema.names[:width], "kind", "found_value", "start"],
                )

    return run


def _keyed(records: DataFrame, keys: list[str], content: str) -> tuple[DataFrame, str]:
    shown = records.select(*keys, F.col(content).alias("content"))
    return shown, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shown.schema.fields[: len(keys)])


def found(records: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """A row ``(keys..., kind, found_value, start)`` per span found; records without any give none."""
    shown, schema = _keyed(records, keys, content)
    return shown.where("content is not null").mapInArrow(_apply(len(keys), "spans"), f"{schema}, kind string, found_value string, start int")


def redacted(records: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """A row ``(keys..., redacted, replaced)`` per record: the text with typed placeholders, and what they stand for. Null stays null."""
    shown, schema = _keyed(records, keys, content)
    return shown.mapInArrow(_apply(len(keys), "texts"), f"{schema}, redacted string, replaced array<struct<kind:string,value:string,start:int>>")
