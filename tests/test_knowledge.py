"""Operators without SQL against plain computations: activation, consolidation, momentum, stems, chunks, keywords, graph indices."""

import math
import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from palimpsest.operators import graph_index as gi
from palimpsest.operators import knowledge as kn
from palimpsest.operators import plasticity as pl
from palimpsest.operators import recall as rc
from palimpsest.operators import segments as sg
from palimpsest.operators import texts as tx
from palimpsest.operators import vectors as vc
from palimpsest.runtime import table
from palimpsest.sources.datasets import Datasets

NOW = datetime(2025, 6, 1, tzinfo=timezone.utc)
EDGE = "uuid string, from_entity string, to_entity string, relation_type string, strength double, tier string, ltp_status string, activation_count int, activation_timestamps array<timestamp>, created_at timestamp, last_activated timestamp, invalidated_at timestamp, entity_confidence double"


def _edges(spark, rows):
    full = [(f"e{k:03}", a, b, t, w, "L3", "Full", 0, None, NOW, NOW, None, None) for k, (a, b, t, w) in enumerate(rows)]
    return spark.createDataFrame(full, EDGE)


def _walk(rows, seeds, hops, adaptive, wanted=()):
    """Activation by dictionaries; all edges are fresh, of the third tier and potentiated: effective strength is the weight, trust 0.95."""
    steps = defaultdict(list)
    for a, b, t, w in rows:
        for s, d in {(a, b), (b, a)}:
            steps[s].append((d, w, 1.0 if not wanted or t in wanted or t in pl.GENERIC_RELATIONS else pl.RELATION_PENALTY))
    active, threshold, before = dict(seeds), pl.THRESHOLD, len(seeds)
    for hop in range(1, hops + 1):
        new = dict(active)
        for s, a in active.items():
            if a >= threshold:
                for d, w, p in steps[s]:
                    rate = 0.05 + (1 - w) * 0.10
                    new[d] = new.get(d, 0.0) + a * math.exp(-rate * hop) * w * 0.95 * p / math.sqrt(1 + len(steps[s]))
        top = max(new.values(), default=0)
        scale = 2.0 / top if top > 2 else 1.0
        active = {n: v * scale for n, v in new.items() if v * scale > threshold}
        after = len(active)
        if adaptive:
            if after < 5:
                threshold = pl.RELAXED
            if hop >= 3 and after and ((after - before) / after < 0.05 or after >= 50):
                break
        before = after
    return active


@pytest.mark.parametrize("wanted", [[], ["Uses"]])
def test_activation_equals_a_plain_walk(spark, wanted):
    rng = random.Random(4)
    nodes = [f"n{k}" for k in range(25)]
    rows = [(rng.choice(nodes), rng.choice(nodes), rng.choice(["Uses", "Owns", "CoOccurs"]), round(rng.uniform(0.2, 0.95), 3)) for _ in range(60)]
    seeds = {"n1": 0.9, "n7": 0.4}
    df = spark.createDataFrame(list(seeds.items()), "node string, activation double")
    for adaptive in (True, False):
        got = {r.node: r.activation for r in pl.spread_activation(_edges(spark, rows), df, F.lit(NOW), 5, adaptive, wanted).collect()}
        want = _walk(rows, seeds, 5, adaptive, wanted)
        assert got.keys() == want.keys() and len(got) > 5
        assert all(abs(got[n] - want[n]) < 1e-6 for n in got)
    assert pl.spread_activation(_edges(spark, rows), df.limit(0), F.lit(NOW)).count() == 0


def test_activation_from_two_sides_meets(spark):
    rows = [("a", "m", "Uses", 0.9), ("m", "b", "Uses", 0.9), ("b", "z", "Uses", 0.9)]
    seeds = spark.createDataFrame([(0, "a", 1.0), (1, "b", 1.0)], "place int, node string, activation double")
    got = {r.node: r.activation for r in pl.spread_from_both(_edges(spark, rows), seeds, F.lit(NOW), density=3.0).collect()}
    one, two = _walk(rows, {"a": 1.0}, 2, False), _walk(rows, {"b": 1.0}, 2, False)
    assert abs(got["m"] - (one["m"] + two["m"]) * 1.5) < 1e-6 and got["z"] > 0


def test_a_hub_lets_its_weakest_edges_go(spark):
    rows = [("hub", f"s{k}", "Uses", 0.1 + k / 100) for k in range(40)]
    gone = {r.uuid for r in pl.over_degree(_edges(spark, rows), F.lit(NOW), 30).collect()}
    assert gone == {f"e{k:03}" for k in range(10)}


def test_strengthening_promotes_and_keeps_bounds(spark):
    rows = spark.createDataFrame([("a", "x", "y", "r", 0.45, "L1", None, 1, None, NOW, NOW, None, None), ("b", "x", "y", "r", None, None, None, None, None, None, None, None, None), ("c", "x", "y", "r", 0.69, "L2", "Full", 20, [NOW] * 9, NOW - timedelta(days=40), NOW, None, 0.9)], EDGE)
    got = {r.uuid: r for r in pl.strengthened(rows, F.lit(NOW)).collect()}
    assert got["a"].promoted and got["a"].tier == "L2" and abs(got["a"].strength - (0.45 + 0.25 * 0.55)) < 1e-9
    assert got["b"].activation_count == 1 and abs(got["b"].strength - 0.175) < 1e-9
    assert got["c"].tier == "L3" and got["c"].ltp_status == "Full" and got["c"].strength <= 1


def test_similar_sets_equal_brute_force(spark):
    rng = random.Random(7)
    rows = [(k, sorted(rng.sample([f"t{i}" for i in range(30)], rng.randint(0, 9)))) for k in range(150)] + [(900, ["t1", "t2"]), (901, ["t1", "t2"])]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    for least in (0.45, 0.8):
        got = {(r.a, r.b) for r in kn.similar_sets(df, least).collect()}
        want = {(a, b) for a, x in rows for b, y in rows if a < b and x and y and len({*x} & {*y}) / len({*x} | {*y}) >= least - 1e-12}
        assert got == want and want


def test_linked_sets_have_the_components_of_all_pairs(spark):
    rng = random.Random(5)
    rows = [(k, ["u", "v", "w", None][min(k % 7, 3)], rng.sample(range(1, 26), rng.randint(0, 9))) for k in range(160)] + [(k, "u", [30, 31, 32, 33, 34, 35, 1000 + k]) for k in range(160, 190)]
    df = spark.createDataFrame(rows, "id long, user_id string, tokens array<long>")
    for least in (0.45, 0.7):
        part = {i: i for i, *_ in rows}
        for i, u, x in rows:
            for j, v, y in rows:
                if i < j and u == v and u and x and y and len({*x} & {*y}) >= least * len({*x} | {*y}) - 1e-12 and part[i] != part[j]:
                    part = {k: min(part[i], part[j]) if p in (part[i], part[j]) else p for k, p in part.items()}
        for bucket in (1, 6, 256):
            got = {i: i for i, *_ in rows}
            for r in kn.linked_sets(df, least, "user_id", bucket).collect():
                got = {k: min(got[r.a], got[r.b]) if p in (got[r.a], got[r.b]) else p for k, p in got.items()}
            assert got == part


def test_consolidation_moves_little_for_many_tenants(spark):
    """Sentences alike in many tenants meet within each; before, all tenants met, were told apart behind the join, and every candidate moved."""
    context = spark.sparkContext._jsc.sc()

    def moved():
        context.listenerBus().waitUntilEmpty(30_000)
        return context.statusStore().executorSummary("driver").totalShuffleWrite()

    rng, old = random.Random(7), NOW - timedelta(days=30)
    words = ["".join("bcdfghklmn"[int(d)] for d in str(n)) for n in range(1000, 1040)]
    rows = [(f"m{u}-{k}", f"u{u}", "Decision", f"Robots {' '.join(rng.sample(words, 9))}.", 0.5, old) for u in range(60) for k in range(40)]
    rows += [(f"{i}+", u, kind, f"{text[:-1]}!", c, t) for i, u, kind, text, c, t in rows if i.endswith("-7")]
    df = spark.createDataFrame(rows, "id string, user_id string, experience_type string, content string, importance double, created_at timestamp")
    before = moved()
    got = kn.consolidated(df, F.lit(NOW), ["Decision"]).collect()
    assert {r.user_id for r in got} == {f"u{u}" for u in range(60)}
    assert moved() - before < 5_000_000


def test_consolidated_facts_need_two_memories(spark):
    old = NOW - timedelta(days=30)
    rows = [
        ("m1", "u", "Decision", "We decided to cache query plans in memory. Fine.", 0.5, old), ("m2", "u", "Learning", "Decided to cache the query plans in memory!", 0.9, old), ("m3", "v", "Learning", "Decided to cache the query plans in memory!", 0.9, old),
        ("m4", "u", "Task", "Decided to cache the query plans in memory!", 0.9, old), ("m5", "u", "Decision", "Robots lost the map near the dock.", 0.4, old), ("m6", "u", "Decision", None, 0.4, old), ("m7", "u", "Decision", "Robots lost the map near the dock.", 0.4, NOW),
    ]
    df = spark.createDataFrame(rows, "id string, user_id string, experience_type string, content string, importance double, created_at timestamp")
    got = kn.consolidated(df, F.lit(NOW), ["Decision", "Learning"]).collect()
    assert [(r.user_id, r.fact, r.support, round(r.confidence, 6)) for r in got] == [("u", "Decided to cache the query plans in memory!", 2, 0.7)]
    assert kn.consolidated(df.limit(0), F.lit(NOW), ["Decision"]).count() == 0


def test_consolidation_covers_all_types_hot_memories_relations_and_sources(spark, tmp_path):
    """The query itself: before, eight of fourteen types, memories of three to seven days, relations and all sources but one were left out."""
    at = datetime(2025, 6, 1, tzinfo=timezone.utc)
    age = lambda days: at - timedelta(days=days)
    names = lambda *texts: [{"text": t} for t in texts]
    six, map_lost = ["Alpha", "bravo", "Charlie", "delta", "Echo", "foxtrot"], "Robots lost the map near the dock."
    rows = [
        ("m1", "u", map_lost, "Task", 0.5, age(30), 0, names(*six)), ("m2", "u", "The robots lost a map near docks!", "CodeEdit", 0.9, age(8), 0, names(*reversed(six), "bravo", "foxtrot line", "up", None)),
        ("m3", "u", map_lost, "Conversation", 0.1, age(4), 9, None),  # hot: 9 * ln(1 + 1) / 1.4
        ("m4", "u", map_lost, "Task", 0.1, age(4), 1, None), ("m5", "u", map_lost, "Task", 0.1, age(2), 900, None), ("m6", "u", map_lost, "Task", 0.1, age(4), None, None),
        ("m7", None, "Queue depth stayed low today.", "Context", None, age(9), 0, None), ("m8", None, "Queue depth stayed low.", "Search", 0.4, age(9), 0, None), ("m9", "v", map_lost, "Command", 0.4, age(9), 0, names("Alpha", "bravo")), ("m1", "u", map_lost, "Task", 0.5, age(30), 0, names(*six)),
    ]
    shape = "id string, user_id string, content string, experience_type string, importance float, created_at timestamp, access_count int, entities array<struct<text: string>>"
    df = spark.createDataFrame(rows, shape).withColumns({"tags": F.array(F.lit("t")), "episode_id": F.lit(None).cast("string"), "robot_id": F.lit(None).cast("string"), "parent_id": F.lit(None).cast("string")})
    df.write.parquet(f"{tmp_path}/memories.parquet")
    got = {(r.user_id, r.fact): (r.support, r.confidence, r.sources) for r in entry.queries()["facts_consolidated"](spark, str(tmp_path)).collect()}
    # "foxtrot" is a part of "foxtrot line" in m2, so it stands for nothing there; "up" is short.
    pairs = [(x, y) for x in sorted(map(str.lower, six)) for y in sorted(map(str.lower, six)) if x < y and "foxtrot" not in (x, y)]
    want = {("u", f"{x} relates to {y}"): (2, 0.7, ["m1", "m2"]) for x, y in pairs}
    assert len(pairs) == 10 and got == want | {("u", "The robots lost a map near docks!"): (3, 0.5, ["m1", "m2", "m3"]), (None, "Queue depth stayed low."): (2, 0.2, ["m7", "m8"])}


def test_consolidated_facts_equal_brute_force(spark):
    rng, old = random.Random(11), NOW - timedelta(days=30)
    words = ["robot", "dock", "map", "queue", "cache", "tenant", "planner", "vector", "lens", "gripper", "crate", "beacon"]
    say = lambda: " ".join(rng.sample(words, rng.randint(3, 6))).capitalize() + "."
    rows = [(f"m{k:03}", rng.choice(["u", "v", None]), " ".join(say() for _ in range(rng.randint(0, 2))) or None, round(rng.random(), 3), old, rng.sample(["Ada", "ada lake", "Bo", "Cyd", "Dee", "the"], rng.randint(0, 5))) for k in range(60)]
    df = spark.createDataFrame(rows, "id string, user_id string, content string, importance double, created_at timestamp, names array<string>")
    got = [(r.user_id or "", r.fact, r.support, round(r.confidence, 9), r.sources) for r in kn.consolidated(df, F.lit(NOW), names=F.col("names")).collect()]
    want, related, told = [], defaultdict(list), [(u or "", i, c, t + ".", {tx.stem(w) for w in t.lower().split()}) for i, u, text, c, _, _ in rows if text for t in text[:-1].split(". ")]
    group = [*range(len(told))]
    for a, (u, _, _, _, x) in enumerate(told):
        for b, (v, _, _, _, y) in enumerate(told):
            if u == v and len(x & y) >= 0.45 * len(x | y) - 1e-12 and group[a] != group[b]:
                group = [group[a] if g == group[b] else g for g in group]
    for g in {*group}:
        own = {}
        for k, (u, i, c, t, _) in enumerate(told):
            if group[k] == g:
                own[i] = max(own.get(i, (c, t)), (c, t))
        if len(own) > 1:
            want.append((told[group.index(g)][0], max(own.values())[1], len(own), round(sum(c for c, _ in own.values()) / len(own), 9), sorted(own)))
    said = len(want)
    for i, u, _, c, _, named in rows:
        low = sorted({n.lower() for n in named if len(n) > 2 and n != "the"})
        low = [n for n in low if not any(n != o and n in o for o in low)]
        for x in low:
            for y in low:
                if x < y:
                    related[u or "", f"{x} relates to {y}"].append((i, c))
    want += [(u, fact, len(m), round(sum(c for _, c in m) / len(m), 9), [i for i, _ in m]) for (u, fact), m in related.items() if len(m) > 1]
    assert sorted(got) == sorted(want) and len(want) > said > 2


def test_momentum_equals_a_plain_fold(spark):
    rng = random.Random(2)
    rows = [(f"m{k % 3}", ["Learning", "Error", None][k % 3], NOW - timedelta(hours=rng.randint(1, 2000)), rng.uniform(-1, 1), rng.uniform(0.3, 1)) for k in range(60)] + [("m0", "Learning", NOW, None, 0.9), (None, "Error", NOW, 0.3, 0.9)]
    df = spark.createDataFrame(rows, "id string, kind string, at timestamp, value double, confidence double")
    got = {r.id: r for r in kn.momentum(df, F.lit(NOW)).collect()}
    for name in ("m0", "m1", "m2"):
        own = sorted((r[2], r[3], r[4]) for r in rows if r[0] == name and r[3] is not None)
        base = kn.INERTIA.get(next(r[1] for r in rows if r[0] == name), 0.5)
        ema, stable, last = 0.0, 0.5, None
        for n, (t, v, c) in enumerate(own):
            inertia = min(max(base * min(0.8 + n * 0.01, 1.0) * (0.7 + stable * 0.3), 0.5), 0.99)
            pause = (t - last).total_seconds() if last else 0
            alpha = (1 - inertia) * (1.0 if pause < 3600 else 0.9 if pause < 86400 else 0.7 if pause < 604800 else 0.5) * c
            before = ema
            if c > 0.8 and v < -0.3:
                ema, stable = v, stable * 0.3
            else:
                ema = ema * (1 - alpha) + v * alpha
            same = (v > 0) == (before > 0) or abs(before) < 1e-7
            stable = min(stable + 0.05, 1.0) if same else max(stable - 0.1 * abs(v - before), 0.0)
            last = t
        assert abs(got[name].ema - ema) < 1e-9 and got[name].signals == len(own) and abs(got[name].stability - stable) < 1e-9
    assert set(got) == {"m0", "m1", "m2"}


def test_contradictions_and_duplicates_of_edge_rows(spark):
    rows = [("a", "u", "the cache is not warm", ["x"]), ("b", "u", "the cache is warm", ["x", "x", None]), ("c", "u", "the cache is warm now", ["x"]), ("d", "v", "the cache is warm", ["x"]), ("e", "u", None, ["x"]), ("f", "u", "the cache is warm", None), ("g", "u", "the cache is warm", ["x"])]
    df = spark.createDataFrame(rows, "id string, user_id string, fact string, related_entities array<string>")
    assert {(r.id, r.id_b) for r in kn.contradictions(df).collect()} == {("a", "b"), ("a", "c")}  # b stands for its copy g
    assert {r.id: r.match for r in kn.duplicate_facts(df).collect()} == {"b": "c", "c": "b"}


def test_opposition_and_polarity():
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rows = [("the feature is enabled", "the feature is disabled", True), ("it was done", "it was not done", True), ("all good", "all good", False), (None, "x", None)]
    got = spark.createDataFrame(rows, "a string, b string, want boolean").select(kn.opposed(F.col("a"), F.col("b")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_stem_field_counts_all_words_of_a_stem(spark):
    rows = [("1", "Caching plans helps.", None, None), ("2", "The cache cached a plan.", ["cache"], []), ("3", None, None, None), ("4", "Nothing here.", ["other"], None)]
    df = spark.createDataFrame(rows, "id string, content string, tags array<string>, entities array<struct<text:string,type:string>>")
    got = {r.id: r.score for r in rc.bm25_fields(df, "id", {"content": tx.words(F.col("content"))}, "cached plans").collect()}
    texts = {"1": ["caching", "plans", "helps"], "2": ["cache", "cached", "plan"], "4": ["nothing"]}
    n, want = 4, defaultdict(float)

    def add(field, terms, weight):
        mean = sum(map(len, field.values())) / len(field)
        for t in terms:
            df_ = sum(t in w for w in field.values())
            for d, w in field.items():
                tf = w.count(t)
                if tf:
                    want[d] += weight * math.log(1 + (n - df_ + 0.5) / (df_ + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))

    add(texts, ["cached", "plans"], 1.0)
    add({d: [tx.stem(x) for x in w] for d, w in texts.items()}, [tx.stem("cached"), tx.stem("plans")], 0.8)
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-6 for d in got)
    assert rc.bm25_fields(df, "id", {"content": tx.words(F.col("content"))}, "the of").count() == 0


def test_weights_learn_and_modes_dispatch(spark):
    w = rc.learned_weights({"semantic": 0.5, "entity": 0.3, "tag": 0.2}, {"semantic": True}, True)
    assert abs(sum(w.values()) - 1) < 1e-9 and w["semantic"] > 0.5 and rc.learned_weights(w, {"tag": True}, False)["tag"] < w["tag"]
    assert rc.prefetch_kind({"entities": [], "hour": 3}) == "time" and rc.prefetch_kind({}) is None
    with pytest.raises(ValueError):
        rc.by_mode("psychic")


def test_injection_cools_down_from_what_was_shown(spark):
    at = lambda s: NOW + timedelta(seconds=s)
    rows = [("s", "m", at(t)) for t in (0, 100, 179, 180, 300, 361)] + [("s", "n", at(5)), ("t", "m", at(5)), ("t", "m", at(5))]
    got = rc.injected(spark.createDataFrame(rows, "session_id string, id string, ts timestamp")).where("shown").collect()
    assert sorted((r.session_id, r.id, (r.ts.replace(tzinfo=timezone.utc) - NOW).total_seconds()) for r in got) == [("s", "m", 0), ("s", "m", 180), ("s", "m", 361), ("s", "n", 5), ("t", "m", 5)]


def test_chunks_cover_and_end_naturally():
    rng = random.Random(5)
    words = ["größe", "map", "robot", "日本", "cache", "naïve"]
    text = " ".join(rng.choice(words) + ("." if rng.random() < 0.1 else "") for _ in range(1500))
    out = sg.chunked(text)
    assert len(out) > 5 and all(len(p.encode()) <= 800 + 201 for p in out)
    assert all(p in text or p.rsplit(" ", 1)[0] in text for p in out[:-1]) and text.startswith(out[0]) and text.rstrip().endswith(out[-1][-20:])
    at = 0
    for p in out[:-1]:  # each piece begins before the last one ended
        k = text.find(p[:40], max(0, at - 400))
        assert 0 <= k <= at + 1
        at = k + len(p)
    assert sg.chunked(None) == [] and sg.chunked("  ") == [] and sg.chunked("short") == ["short"]
    assert "".join(sg.chunked("x" * 3000)).count("x") >= 3000


def test_keywords_prefer_telling_words():
    text = "The Scheduler drops tasks. Scheduler restarts fix the Scheduler. People like tea. The scheduler is written in Rust."
    best = [w for w, _ in sg.yake(text, 3)]
    assert "scheduler" in best and not set(best) & set(tx.STOP_WORDS)
    assert sg.yake(None) == [] and sg.yake("12 34") == []


def test_segments_threads_and_entities(spark):
    docs = spark.createDataFrame([(1, "- We decided to ship it\n\n2. error: disk full\nok\n" + "Long sentence here. " * 40), (2, None), (3, "")], "doc_id long, text string")
    got = [(r.doc_id, r.kind) for r in sg.segmented(docs, "doc_id", "text").orderBy("doc_id", "place").collect()]
    assert got[:2] == [(1, "Decision"), (1, "Error")] and len(got) == 42
    turns = spark.createDataFrame([(1, "s", 1, "caching query plans"), (2, "s", 2, "cached plans of queries"), (3, "s", 3, "robots lost maps"), (4, "t", 1, None)], "id long, s string, at int, text string")
    threads = {r.id: (r.thread, r.tag) for r in sg.topic_threads(turns, "s", ["at"], "text").collect()}
    assert threads[1] == threads[2] and threads[3][0] == 2 and threads[4][0] == 1
    found = {(r.name, r.label) for r in sg.extracted_entities(spark.createDataFrame([(1, "Today we met Anna Berg of Acme Labs about spark in Berlin."), (2, None)], "id long, c string"), "id", "c").collect()}
    assert {("anna berg", "Person"), ("acme labs", "Organization"), ("spark", "Technology"), ("berlin", "Location")} <= found


def test_word_pairs_are_all_of_a_sentence(spark):
    df = spark.createDataFrame([("cache plans fail. cache maps", ), (None,), ("",)], "t string")
    got = {(r.first, r.second): r.n for r in sg.word_pairs(df, "t").collect()}
    assert got == {("cache", "plans"): 1, ("cache", "fail"): 1, ("plans", "fail"): 1, ("cache", "maps"): 1}


def test_datasets_refuse_what_does_not_fit(spark, tmp_path):
    store = Datasets(spark, str(tmp_path))
    store.create("ann", "notes", [("id", "i64", False), ("label", "text", True)], ["id"])
    with pytest.raises(ValueError):
        store.create("ann", "notes", [("id", "i64", False)], ["id"])
    with pytest.raises(ValueError):
        store.create("ann", "other", [("id", "i64", True)], ["id"])
    with pytest.raises(KeyError):
        store.drop("bob", "notes")
    assert store.count("ann", "notes") == 0
    bad = store.insert("ann", "notes", spark.createDataFrame([('{"id": 1}',), ('{"label": "x"}',), ("nonsense",)], "row string"))
    assert bad.count() == 2 and store.count("ann", "notes") == 1
    store.drop("ann", "notes")
    assert store.list("ann").count() == 0
    store.create("ann", "notes", [("id", "i64", False)], ["id"])
    assert store.count("ann", "notes") == 0


@pytest.mark.parametrize("layered", [False, True])
def test_graph_indices_find_the_nearest(spark, layered):
    e = table(spark, "/root/testdata/sf0.1", "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    index = gi.build(e, layered=layered, shard=700).cache()
    exact = {(r["query"], r.vec_id) for r in vc.top_k_each(e, asked, 5).collect()}
    found = {(r["query"], r.vec_id) for r in gi.search(index, asked, 5).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    gone = e.where("vec_id % 3 = 0")
    left = {r.vec_id for r in gi.search(index, asked, 5, removed=gone).collect()}
    assert left and not any(v % 3 == 0 for v in left)
    more = spark.createDataFrame([(10_000_001, [1.0] * 64), (10_000_002, None)], "vec_id long, embedding array<float>")
    grown = gi.added(index, more, layered=layered)
    ask = spark.createDataFrame([(1, [1.0] * 64)], "query long, vector array<float>")
    assert gi.search(grown, ask, 1).first().vec_id == 10_000_001
    assert gi.search(index, asked.limit(0), 5).count() == 0
    index.unpersist()


def test_gap_impact_equals_brute_force(spark):
    from palimpsest.operators.ranking import gap_impact

    rng = random.Random(3)
    names = [f"n{k}" for k in range(9)]
    rows = [(f"g{k}", rng.sample(names, rng.randint(1, 6))) for k in range(40)] + [("none", []), ("lone", ["zz", "zz"])]
    got = {r.gap: r.impact for r in gap_impact(spark.createDataFrame(rows, "gap string, entities array<string>")).collect()}
    for g, e in rows:
        assert abs(got[g] - sum(1 for h, f in rows if h != g and set(e) & set(f)) / len(rows)) < 1e-9


def test_components_of_many_tasks_and_flushes(spark, monkeypatch):
    from palimpsest.operators import components as co

    rng = random.Random(1)
    rows = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(500, 500), (None, 1)]
    parent = list(range(501))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in rows:
        if a is not None:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    df = spark.createDataFrame(rows, "src long, dst long").repartition(6)
    got = {r.node: r.component for r in co.connected_components(df).collect()}
    assert got == {n: root(n) for pair in rows if pair[0] is not None for n in pair}


def test_asked_vectors_come_in_blocks(spark, monkeypatch):
    e = table(spark, "/root/testdata/sf0.01", "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    want = sorted((r["query"], r.vec_id, r.rank) for r in vc.top_k_each(e, asked, 3).collect())
    monkeypatch.setattr(vc, "QUERY_BLOCK", 7)
    assert sorted((r["query"], r.vec_id, r.rank) for r in vc.top_k_each(e, asked, 3).collect()) == want


def test_questions_are_taken_apart():
    from palimpsest.functions import querying as qy

    who = qy.intent_of("Who manages the release pipeline?")
    assert who.labels == ["Person", "Organization", "Team"] and who.relations == ["Manages", "DeploysTo"] and who.confidence == 1.0
    assert qy.intent_of("How do we monitor latency?").labels == ["Metric", "Service"] and qy.intent_of("how are you").labels == ["Concept", "Technology"]
    assert qy.intent_of("Which library do we use").labels == ["Technology", "Product", "Module"] and qy.intent_of("which one").labels == []
    assert qy.intent_of("").confidence == 0.0
    assert qy.expanded("Any risks, concerns?") == {w: 0.3 for w in ("issues", "problems", "challenges", "threats")} and qy.expanded("plain words") == {}
    p = qy.parsed("When did it fail, 2024-05-01 or later, but not staging?")
    assert p["kind"] == "temporal" and p["dates"] == ["2024-05-01"] and "staging" in p["negated"]


def test_intent_of_time_follows_the_most_telling_phrase(spark):
    from palimpsest.functions import strings as st

    rows = [("When did we meet yesterday?", "when"), ("how long until today", "duration"), ("was it before the fix", "ordering"), ("the latest run", "specific"), ("what broke", "none"), (None, None), ("", "none")]
    got = spark.createDataFrame(rows, "q string, want string").select(st.temporal_intent(F.col("q")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_a_graph_is_written_as_a_document(spark, tmp_path):
    from palimpsest.operators.graphs import dot_lines, write_dot

    e = spark.createDataFrame([("a", 'A "x"'), ("b", None), ("b", None)], "uuid string, name string")
    write_dot(dot_lines(e, _edges(spark, [("a", "b", "Uses", 0.5)])).coalesce(1), str(tmp_path / "g"))
    text = "\n".join(open(f).read() for f in sorted((tmp_path / "g").glob("part-*")))
    assert [x for x in text.split("\n") if x] == ["digraph {", "  \"a\" [label=\"A 'x'\"];", '  "b" [label=""];', '  "a" -> "b" [label="Uses", weight=0.500];', "}"]


def test_cells_and_voids_equal_plain_computations(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 8)).astype(np.float32)
    rows = [(k, [float(a) for a in v]) for k, v in enumerate(x)] + [(3, [float(a) for a in x[3]]), (900, None), (901, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    knn = vc.knn_blocks(df, 4, block=17)
    u = x.astype(float) / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -9)
    best = {k: sorted(range(60), key=lambda j: (-s[k, j], j))[:4] for k in range(60)}
    got: dict = {}
    for r in sorted(knn.collect(), key=lambda r: r.rank):
        got.setdefault(r.vec_id, []).append(r.other)
    assert got == best
    for r in vc.shapes_of_cells(knn, df).collect():
        d = x[best[r.vec_id]].astype(float) - x[r.vec_id]
        d /= np.linalg.norm(d, axis=1, keepdims=True)
        off = np.abs((d @ d.T)[np.triu_indices(4, 1)])
        assert abs(r.anisotropy - max(1, off.max() / off.mean())) < 1e-6 and abs(r.isolation - np.mean([1 - s[r.vec_id, j] for j in best[r.vec_id]])) < 1e-6
        assert np.allclose(r.sparse, -d.mean(0) / np.linalg.norm(d.mean(0)), atol=1e-6)
    assert vc.knn_blocks(df.limit(0), 4).count() == 0
    axes = spark.createDataFrame([(k, [float(k == j) for j in range(4)]) for k in range(4)], "vec_id long, embedding array<float>")
    cells = vc.shapes_of_cells(vc.knn_blocks(axes, 2), axes)
    hole = vc.void(cells, axes, 0.5).collect()
    assert len(hole) == 1 and hole[0].boundary == 4 and abs(hole[0].nearest - 0.5) < 1e-9 and vc.void(cells, axes, 2.0).count() == 0


def test_names_resolve_by_stem(spark):
    from palimpsest.operators.ranking import resolve_entities_by_stem

    e = spark.createDataFrame([("u", "e1", "Query Planner", 0.5), ("u", "e2", "Robots", 0.9), ("v", "e3", "Robot", 0.9), ("u", "e4", None, 0.1)], "user_id string, uuid string, name string, salience double")
    n = spark.createDataFrame([("u", "query planners"), ("u", "robot"), ("v", "Robot"), ("u", "xx"), ("u", "nothing")], "user_id string, asked string")
    assert {(r.user_id, r.asked): (r.uuid, r.score) for r in resolve_entities_by_stem(n, e).collect()} == {("u", "query planners"): ("e1", 0.8), ("u", "robot"): ("e2", 0.8), ("v", "Robot"): ("e3", 1.0)}
