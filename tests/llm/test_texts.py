"""Tagger, packing and truncation: learning, round trips, held-out accuracy and edge cases."""

import random

import numpy as np
import pytest

from palimpsest.llm import packing, pii, pii_train, truncation
from palimpsest.runtime import table

FOLDER = "/root/testdata/sf0.001"


# Personal information


def test_gradients_are_right():
    net = pii_train.Net(hidden=3, seed=1)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    rng = np.random.default_rng(0)
    symbols, tags, lengths = rng.integers(0, pii.SYMBOLS - 1, (7, 2)).astype(np.uint8), rng.integers(0, pii.TAGS, (7, 2)), np.array([7, 5])
    symbols[5:, 1] = pii._PAD
    _, grad = net.loss(symbols, tags, lengths)
    for key in ("out", "rec_f", "in_b", "embed", "trans", "start"):
        flat = net.p[key].reshape(-1)
        for i in rng.choice(flat.size, 4, replace=False):
            old, eps = flat[i], 1e-3
            flat[i] = old + eps
            up = net.loss(symbols, tags, lengths)[0]
            flat[i] = old - eps
            down = net.loss(symbols, tags, lengths)[0]
            flat[i] = old
            assert abs((up - down) / (2 * eps) - grad[key].reshape(-1)[i]) < 2e-3, key


def test_training_learns_a_small_task():
    rng = random.Random(1)
    texts, spans = [], []
    for _ in range(160):
        head, mail = "see " * rng.randint(1, 5), "".join(rng.choice("abcdef") for _ in range(6)) + "@example.org"
        texts.append(head + mail + " for more.")
        spans.append([(len(head), len(head) + len(mail), 0)])
    net = pii_train.train(texts[:130], spans[:130], passes=14, lanes=16, hidden=8, seconds=60, said=lambda *a: None)
    true, found, exact = pii_train.measure(net.frozen(), texts[130:], spans[130:])["EMAIL"]
    assert true == 30 and exact >= 28


def test_decoding_equals_brute_force_over_paths():
    import itertools

    model, rng = pii.load(), np.random.default_rng(2)
    scores = rng.standard_normal((3, pii.TAGS, 2)).astype(np.float32) * 3
    got = pii.viterbi(model, scores)
    for lane in range(2):
        value = lambda p: model["start"][p[0]] + sum(scores[t, k, lane] for t, k in enumerate(p)) + sum(model["trans"][a, b] for a, b in zip(p, p[1:]))
        assert tuple(got[:, lane]) == max(itertools.product(range(pii.TAGS), repeat=3), key=value)


def test_scores_equal_a_plain_recurrence_over_each_window():
    model = pii.load()
    texts = ["Ask Xenia Velzoman.", "Tel: 415-555-0152 ext. 46. ID: QQ147901B, to be masked.", "Call with Xenia Velzoman: agreed to wait. " * 5]
    codes = [pii.encode(t) for t in texts]
    symbols = np.full((max(map(len, codes)), 3), pii._PAD, np.uint8)
    for k, c in enumerate(codes):
        symbols[: len(c), k] = c
    got = pii.emissions(model, symbols, np.array([len(c) for c in codes]))
    size = len(model["rec_f"]) // 4
    for k, c in enumerate(codes):
        want = np.tile(model["bias"].astype(float), (len(c), 1))
        for weights, out, way in ((model["rec_f"], model["out"][:, :size], 1), (model["rec_b"], model["out"][:, size:], -1)):
            h = cell = np.zeros(size)
            for row, symbol in zip(want[::way], c[::way]):
                z = weights.astype(float) @ np.concatenate([h, model["embed"][symbol]])
                i, f, o = np.clip(z[: 3 * size] * 0.25 + 0.5, 0, 1).reshape(3, size)
                cell = f * cell + i * np.tanh(z[3 * size :])
                h = o * np.tanh(cell)
                row += out @ h
        assert np.abs(got[: len(c), :, k] - want).max() < 1e-4
        assert (got[len(c) :, :, k].argmax(axis=1) == 0).all()


def test_spans_of_a_text_do_not_depend_on_the_texts_beside_it():
    model = pii.load()
    texts = ["Ask daniel.kes4@example.com", "Call with Xenia Velzoman", "The retry loop kept stale tag lists. " * 12 + "Reach Xenia Velzoman"]
    together = pii.raw_spans(model, texts)
    for text, spans in zip(texts, together):
        alone = pii.raw_spans(model, [text])[0]
        assert spans and [s[:3] for s in spans] == [s[:3] for s in alone]
        assert np.allclose([s[3] for s in spans], [s[3] for s in alone], rtol=1e-4)


def test_decoding_of_stretches_equals_decoding_of_windows():
    model, rng = pii.load(), np.random.default_rng(4)
    scores = rng.standard_normal((60, pii.TAGS, 64)).astype(np.float32) * 3
    scores[:, 0] += np.linspace(0, 14, 64, dtype=np.float32)
    maybe = pii.possible(model, scores)
    behind = np.full((1, pii.TAGS, 64), -1e4, np.float32)
    behind[:, 0] = 0
    tags = pii.viterbi(model, np.concatenate([scores, behind]))[:-1]
    assert not (tags[~maybe] > 0).any() and maybe.any() and not maybe.all()
    again = np.zeros_like(tags)
    for lane, first, own in pii.decoded(model, scores, np.full(64, 60)):
        again[first : first + len(own), lane] = own
    assert (again == tags).all()


def test_spans_without_a_form_keep_their_whole_words():
    text = "Home address 1230 old mill street, north tarrow showed up; reach Otto at +15551234567, see 0013-4455-kit and 12 rue des Lilas."
    at = lambda x, kind: (text.index(x), text.index(x) + len(x), pii.KINDS.index(kind), 1.0)
    got = pii.settle(text, [at("1230 old mill street, north tarrow", "ADDRESS"), at("+15551234567", "PHONE"), at("0013-4455", "ID_NUMBER"), at("12 rue des Lilas", "ADDRESS")])
    assert [text[a:b] for a, b, _ in got] == ["1230 old mill street, north tarrow", "+15551234567", "12 rue des Lilas"]


def test_kinds_and_placeholders():
    text = "Ask daniel.kes4@example.com for the export. Tel: 415-555-0152 ext. 46. ID: QQ147901B, to be masked. The dock is at 2285 Quarry Road, Apt 15A, North Tarrow, ZZ 00094; use the side gate. Call with Xenia Velzoman: agreed to wait. Lot 9795-184-52 of the recall planner boards shows gaps."
    spans = pii.find([text])[0]
    got = {(k, text[a:b]) for a, b, k in spans}
    assert got == {("EMAIL", "daniel.kes4@example.com"), ("PHONE", "415-555-0152 ext. 46"), ("ID_NUMBER", "QQ147901B"), ("ADDRESS", "2285 Quarry Road, Apt 15A, North Tarrow, ZZ 00094"), ("NAME", "Xenia Velzoman")}
    assert "[EMAIL] for the export. Tel: [PHONE]. ID: [ID_NUMBER], to" in pii.placeholders(text, spans)


def test_long_texts_are_read_whole():
    body = "The retry loop kept stale tag lists. " * 400
    text = body + "Ask daniel.kes4@example.com for the export. " + body + "Call with Xenia Velzoman: agreed to wait."
    assert {text[a:b] for a, b, _ in pii.find([text])[0]} >= {"daniel.kes4@example.com", "Xenia Velzoman"}


def test_reconciling_takes_the_greatest_total():
    spans = [(0, 10, 4, 5.0), (8, 20, 4, 6.0), (20, 30, 1, 2.0), (0, 7, 4, 3.0)]
    assert pii.reconcile(spans) == [(0, 7, 4, 3.0), (8, 20, 4, 6.0), (20, 30, 1, 2.0)]
    assert pii.reconcile([]) == []


def test_held_out_accuracy():
    texts, spans = pii_train.labelled_sample("/root/testdata/sf0.1", 2000, held=True)  # contents that training leaves out
    for kind, (true, found, exact) in pii_train.measure(pii.load(), texts, spans).items():
        assert exact >= 0.93 * true, (kind, true, found, exact)


def test_redaction_round_trip_and_edges(spark):
    rows = [(1, None, "k"), (2, "", "k"), (3, "Ask daniel.kes4@example.com for the export.", "k"), (3, "Ask daniel.kes4@example.com for the export.", "k")]
    df = spark.createDataFrame(rows, "id long, content string, kind string")
    out = pii.redacted(df, ["id"]).collect()
    assert len(out) == 4 and {r.id: r.redacted for r in out} == {1: None, 2: "", 3: "Ask [EMAIL] for the export."}
    for r in out:
        if r.redacted:
            text = r.redacted
            for x in sorted(r.replaced, key=lambda x: x.start):
                text = text[: x.start] + text[x.start :].replace(f"[{x.kind}]", x.value, 1)
            assert text == rows[2][1]
    assert pii.found(df.limit(0), ["id"]).count() == 0 and pii.found(df, ["id"]).count() == 2


# Packing


def _packed(spark, rows, capacity, **how):
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    return packing.packed(df, capacity, **how).collect()


def test_packing_is_whole_tight_and_never_overfull(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice("aab"), rng.choice([0, 1, 5, 40, 99, 100, 101, 250, 1000])) for k in range(3000)]
    out = _packed(spark, rows, 100, items_per_partition=500)
    boxes, pieces = {}, {}
    for r in out:
        boxes[r.container] = boxes.get(r.container, 0) + r.tokens
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.tokens))
    assert max(boxes.values()) <= 100
    for doc, _, tokens in rows:
        own = sorted(pieces.get(doc, []))
        assert sum(t for _, _, t in own) == tokens and (tokens > 100 or len(own) == (tokens > 0))
        assert all(a[1] + a[2] == b[1] for a, b in zip(own, own[1:]))
    assert sum(boxes.values()) / (100 * len(boxes)) > 0.97


def test_windows_keep_the_mixture_and_carry_deficits():
    rng = random.Random(3)
    sources = [rng.choice(["a"] * 8 + ["b", "c"]) for _ in range(6000)]
    sizes = [rng.randint(1, 60) for _ in sources]
    total = sum(sizes)
    targets = {s: sum(z for z, t in zip(sizes, sources) if t == s) / total for s in "abc"}
    deficits = {"a": 0.0, "b": 0.0, "c": 0.0}
    windows = list(packing.draw_windows(sources, sizes, targets, deficits, 500))
    assert sorted(k for w in windows for k in w) == list(range(6000))
    for w in windows[:-2]:
        own = sum(sizes[k] for k in w)
        for s in "abc":
            assert abs(sum(sizes[k] for k in w if sources[k] == s) / own - targets[s]) < 0.03


def test_partitions_start_with_what_sources_are_owed(spark):
    rng = random.Random(5)
    rows = [(p, rng.choice("aaab" if p % 2 else "abbc"), rng.randint(1, 50)) for p in range(12) for _ in range(20)]
    df = spark.createDataFrame(rows, "part int, source string, tokens long")
    targets = {"a": 0.5, "b": 0.5}
    for r in packing.owed_at_start(df, targets, 0).collect():
        before = [t for p, _, t in rows if p < r.part]
        own = sum(t for p, s, t in rows if p < r.part and s == r.source)
        assert abs(r.deficit - (targets.get(r.source, 0.0) * sum(before) - own)) < 1e-6


def test_given_targets_are_met_while_queues_last(spark):
    rng = random.Random(6)
    rows = [(k, "a" if k % 4 else "b", rng.randint(5, 60)) for k in range(6000)]
    out = [r for r in _packed(spark, rows, 200, targets={"a": 0.5, "b": 0.5}, items_per_partition=2000)]
    windows: dict = {}
    for r in out:
        windows.setdefault((r.container.split("-")[0], r.window), []).append(r)
    early = [w for (p, k), w in windows.items() if p == "0" and k < 2]  # nothing is owed there yet, and b, a fourth of the items, still lasts
    for w in early:
        assert abs(sum(r.tokens for r in w if r.source == "b") / sum(r.tokens for r in w) - 0.5) < 0.1
    boxes: dict = {}
    for w in early:
        for r in w:
            boxes.setdefault(r.container, []).append(r)
    both = sum(1 for b in boxes.values() if {r.source for r in b} == {"a", "b"})
    assert both > 0.8 * len(boxes)


def test_packing_edges(spark):
    assert _packed(spark, [], 10) == [] and _packed(spark, [(1, "a", 0)], 10) == []
    assert [(r.piece, r.start, r.tokens) for r in sorted(_packed(spark, [(1, "a", 25)], 10), key=lambda r: r.piece)] == [(0, 0, 10), (1, 10, 10), (2, 20, 5)]
    with pytest.raises(ValueError):
        _packed(spark, [(1, "a", 1)], 0)


def test_token_counts_round_trip(spark):
    df = spark.createDataFrame([(1, "a", "Hello <|endoftext|> wörld"), (2, None, None), (3, "a", "")], "doc_id long, source string, text string")
    got = {r.doc_id: r.tokens for r in packing.token_counts(df).collect()}
    encoder = packing._encoder(packing.tokenizer_path())
    tokens = encoder.encode_ordinary("Hello <|endoftext|> wörld")
    assert got == {1: len(tokens), 2: 0, 3: 0} and encoder.decode(tokens) == "Hello <|endoftext|> wörld"


# Truncation


def test_structures():
    assert truncation.structure('{"a": [1, 2') == 1 and truncation.structure('{"a": "x}"}') == -1 and truncation.structure("plain") == 0
    assert truncation.structure("x\n```\ncode") == 1 and truncation.structure("x\n```\ncode\n```") == -1


def test_censored_fit_recovers_the_distribution():
    rng = np.random.default_rng(1)
    x = np.minimum(np.exp(rng.normal(6, 0.8, 20_000)).astype(int), 500)
    lengths, counts = np.unique(x, return_counts=True)
    mean, sd = truncation.fit_censored(lengths, counts, [500])
    assert abs(mean - 6) < 0.05 and abs(sd - 0.8) < 0.05
    naive, _ = truncation.fit_censored(lengths, counts, [])
    assert naive < 5.8


def test_cut_texts_are_told_from_whole_ones(spark):
    whole = [r.text for r in table(spark, "/root/testdata/sf0.01", "documents").where("source = 'session_note' and text rlike '[.]$' and length(text) < 900").select("text").collect()]
    rng = random.Random(4)
    rows = []
    for k, t in enumerate(whole):
        at = rng.randint(len(t) // 2, len(t) - 12)
        rows.append((k, "s", t[:at].rstrip(". ") if k % 10 == 0 and len(t) > 60 else t))
    rows += [(9001, "s", None), (9002, "s", "   "), (9003, None, "Fine.")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    cut = {r.doc_id for r in truncation.truncated(df).collect()}
    true = {k for k, t in enumerate(whole) if k % 10 == 0 and len(t) > 60}
    assert len(cut & true) >= 0.8 * len(true) and len(cut - true) <= 0.05 * len(rows)
    rates = {r.source: r for r in truncation.truncation_rates(df).collect()}
    assert rates["s"].documents == len(whole) and rates[""].cut == 0
    assert truncation.endings(df.limit(0)).count() == 0


def test_limits_at_short_lengths_and_alike_at_all_sizes():
    import pandas as pd

    rng = np.random.default_rng(5)
    lengths, n = np.unique(np.minimum(np.maximum(rng.lognormal(3.5, 0.5, 4000).astype(int), 1), 40), return_counts=True)
    found = truncation.source_limits(pd.DataFrame({"source": "s", "unit": "chars", "length": lengths, "n": n}))
    assert 40 in set(found["length"])
    few = {}
    for wide in (3000, 5000):  # lengths around the pile are the same, only more lengths exist far away
        length = np.concatenate([np.arange(500, 700), np.arange(10_000, 10_000 + wide)])
        frame = pd.DataFrame({"source": "s", "unit": "chars", "length": length, "n": np.where(length == 600, 16, 2)})
        few[wide] = 600 in set(truncation.source_limits(frame)["length"])
    assert few[3000] and few[5000]
