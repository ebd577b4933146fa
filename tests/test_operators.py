"""Small fixtures and edge cases of the core operators: nulls, ties, repeats, empty tables, clashing names."""

import datetime as dt
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from palimpsest.functions import geo, scoring, strings
from palimpsest.operators import filters as fl
from palimpsest.operators import graphs as gr
from palimpsest.operators import mutations as mu
from palimpsest.operators import ordered as od
from palimpsest.operators import texts as tx
from palimpsest.operators import vectors as vc
from palimpsest.operators.components import connected_components
from palimpsest.plans import planner
from palimpsest.runtime import table
from palimpsest.sources import tabular as tb
from palimpsest.streaming import messages as ms

FOLDER = "/root/testdata/sf0.001"


def test_components(spark):
    rows = [(1, 2), (2, 3), (5, 4), (7, 7), (None, 1), (3, 1), (1, 2)] + [(100 + k, 101 + k) for k in range(200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert {got[k] for k in (1, 2, 3)} == {1} and got[5] == got[4] == 4 and got[7] == 7 and {got[100 + k] for k in range(201)} == {100}
    assert connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_predicates_refuse_unknown_columns():
    with pytest.raises(ValueError):
        fl.equals("password", 1)


def test_unknown_columns_match_nothing_when_not_strict(spark):
    df = spark.range(3)
    assert df.where(fl.equals("password", 1, strict=False)).count() == 0 and df.where(fl.one_of("id", [])).count() == 0 and df.where(fl.between("id", None, None)).count() == 3


def test_prefix_lookup(spark):
    df = spark.createDataFrame([("abc1",), ("abc2",), ("xyz",), ("xyz",)], "id string")
    assert fl.find_by_prefix(df, "x").count() == 1 and fl.find_by_prefix(df, "q").count() == 0
    with pytest.raises(ValueError):
        fl.find_by_prefix(df, "abc")


def test_filters_reach_the_scan(spark):
    plan = table(spark, FOLDER, "memories").where(fl.matching(fl.Criteria(user_id="u", types=["Error"]))).select("id")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "EqualTo(user_id,u)" in plan and "vector" not in plan


@settings(max_examples=300, deadline=None)
@given(hs.floats(-89, 89), hs.floats(-179.9, 179.9), hs.floats(10, 200_000), hs.floats(-1, 1), hs.floats(-1, 1))
def test_covering_cells_cover(lat, lon, radius, dy, dx):
    import math

    reach = radius / 111_195 * 0.999
    y = max(-90.0, min(90.0, lat + dy * reach / 1.5))
    x = (lon + dx * reach / 1.5 / max(0.02, math.cos(math.radians(lat))) + 180) % 360 - 180
    a = math.sin(math.radians(y - lat) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(lat)) * math.sin(math.radians(x - lon) / 2) ** 2
    if 2 * geo.EARTH_RADIUS * math.asin(min(1, math.sqrt(a))) <= radius:
        assert geo._encode(y, x, geo.covering_precision(radius)) in geo.covering_cells(lat, lon, radius)


def test_geohash_known_value_and_round_trip(spark):
    got = spark.createDataFrame([(57.64911, 10.40744), (None, 1.0)], "a double, b double").select(geo.geohash(F.col("a"), F.col("b"), 9).alias("g")).collect()
    assert got[0].g == "u4pruydqq" and got[1].g is None
    lat, lon = geo.geohash_decode("u4pruydqq")
    assert abs(lat - 57.64911) < 1e-4 and abs(lon - 10.40744) < 1e-4


def test_decay_is_continuous_and_falls(spark):
    days = spark.createDataFrame([(d,) for d in (-1.0, 0.0, 1.0, 2.999999, 3.0, 3.000001, 30.0)], "d double")
    v = [r.v for r in days.select(scoring.memory_decay(F.col("d"), F.lit(False)).alias("v")).collect()]
    assert v[0] == v[1] == 1.0 and abs(v[3] - v[4]) < 1e-5 and abs(v[4] - v[5]) < 1e-5 and abs(v[2] - 0.5) < 1e-3 and v[6] < v[4]


def test_density_and_query_type_weights():
    assert scoring.density_weights(0.1)[1] == 0.5 and abs(scoring.density_weights(9)[1] - 0.1) < 1e-12 and abs(sum(scoring.density_weights(1.2)) - 1) < 1e-12
    for kind in ("temporal", "attribute", "exploratory"):
        w = scoring.query_type_weights(scoring.density_weights(2.0), kind)
        assert abs(sum(w) - 1) < 1e-9 and min(w) >= 0.05 - 1e-12


def test_sessions_with_ties_and_nulls(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("u", 1, t), ("u", 2, t), ("u", 3, t + dt.timedelta(hours=2)), ("u", 4, t + dt.timedelta(hours=4, seconds=1)), ("u", 5, None), ("v", 6, t)]
    s = {r.id: r.session for r in od.sessions(spark.createDataFrame(rows, "user_id string, id int, ts timestamp"), "user_id", "ts", "id").collect()}
    assert s == {1: 1, 2: 1, 3: 1, 4: 2, 6: 1}


def test_adaptive_gap_finds_the_jump(spark):
    t, rows, at = dt.datetime(2024, 1, 1), [], 0
    for k in range(14):
        at += 100 + k if k != 7 else 9000
        rows.append(("u", k, t + dt.timedelta(seconds=at)))
    r = od.adaptive_gaps(spark.createDataFrame(rows, "user_id string, id int, ts timestamp"), "user_id", "ts", "id").first()
    assert 300 <= r.threshold < 9000 and r.gaps == 13


def test_star_gaps_do_not_form_pairs_of_spokes(spark):
    rows = [("h", f"s{k}", 0.5) for k in range(6)] + [("s0", "s1", 0.5), ("s1", "s0", 0.5), ("h", "h", 1.0)]
    r = gr.star_gaps(spark.createDataFrame(rows, "from_entity string, to_entity string, strength float"), 5, 0.3).collect()
    assert [(x.hub, x.spokes, x.linked) for x in r] == [("h", 6, 1)]


def test_traversals_of_cycles_and_strangers(spark):
    e = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 0.5), ("c", "a", 0.1), ("a", "a", 1.0)], "from_entity string, to_entity string, strength float")
    s = spark.createDataFrame([("a",), ("zz",)], "n string")
    assert {(r.start, r.node): r.hop for r in gr.reach(e, s, 5).collect()} == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 1, ("zz", "zz"): 0}
    assert {r.node: round(r.score, 4) for r in gr.best_paths(e, s, 5).collect() if r.start == "a"} == {"a": 1.0, "b": 0.5, "c": 0.25}


def test_vector_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 0.0], [1.0]), (None, [1.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<float>, b array<float>")
    assert [r.c for r in df.select(vc.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.0, None, None, 1.0]


def test_stems():
    assert [tx.stem(w) for w in ("caresses", "ponies", "relational", "hopping", "happy", "adjustment", "probate", "controlling", "at")] == ["caress", "poni", "relat", "hop", "happi", "adjust", "probat", "control", "at"]


def test_chunks_cover_the_whole_text(spark):
    text = "".join(chr(97 + k % 26) for k in range(5000))
    rows = sorted(tx.chunks(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "x")], "k int, t string"), "k", "t", 800, 200).where("k in (1, 4)").collect(), key=lambda r: (r.k, r.chunk))
    own = [r for r in rows if r.k == 1]
    assert "".join(r.piece[:600] for r in own[:-1]) + own[-1].piece == text and [r.piece for r in rows if r.k == 4] == ["x"]


def test_bm25_of_nothing_and_ties(spark):
    q = spark.createDataFrame([("q", "alpha beta")], "query string, text string")
    d = spark.createDataFrame([(2, "alpha"), (1, "alpha"), (3, None), (4, "")], "id int, text string")
    assert [(r.id, r.rank) for r in sorted(tx.bm25(d, "id", "text", q, 2).collect(), key=lambda r: r.rank)] == [(1, 1), (2, 2)]
    assert tx.bm25(d.limit(0), "id", "text", q).count() == 0


def test_planner_orders_and_limits(spark):
    m = table(spark, FOLDER, "memories")
    p = planner.Plan("usr_fleet_ops", [fl.between("importance", 0.1)], limit=3)
    assert planner.execute(p, m).count() == 3 and planner.describe(p)[-1] == "limit 3"


def test_csv_and_json_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1,"two\nlines"\n2,\n')
    (tmp_path / "b.json").write_text(json.dumps([{"a": 1, "b": {"c": [1]}}, {"a": None}]))
    assert [(r["__row"], r.id, r.note) for r in sorted(tb.read_csv(spark, str(tmp_path / "a.csv")).collect(), key=lambda r: r["__row"])] == [(0, "1", "two\nlines"), (1, "2", None)]
    assert {(r.a, r.b) for r in tb.read_json(spark, str(tmp_path / "b.json")).collect()} == {("1", '{"c":[1]}'), (None, None)}


def test_html_flattening_and_formats():
    title, headings, text = tb.html_parts("<html><head><title>T &amp; U</title><style>x</style></head><body><h1>Head</h1><script>no</script><p>One<br>two</p></body></html>")
    assert (title, headings) == ("T & U", ["Head"]) and text == "Head\nOne\ntwo" and tb.html_parts(None) == ("", [], "")
    assert tb.flatten_json('{"a": {"b": [1, "x"]}, "c": null}') == ["a.b[0]: 1", "a.b[1]: x", "c: "] and tb.flatten_json("no") == []
    assert [tb.detect_format(None, t) for t in ('{"a":1}', "# Head", "a,b\n1,2", "<html>", "plain")] == ["json", "markdown", "csv", "html", "text"] and tb.detect_format("x.RS", "") == "code"


def test_dataset_validation(spark):
    schema = tb.dataset_schema([("id", "i64", False), ("note", "text", True)])
    df = spark.createDataFrame([('{"id": 1, "note": "x"}',), ('{"note": "x"}',), ('{"id": 2, "other": 1}',), ("no json",), (None,)], "row string")
    assert [r.violations for r in tb.validated(df, schema).collect()] == [[], ["missing id"], ["unknown other"], ["no object"], ["no object"]]
    with pytest.raises(ValueError):
        tb.dataset_schema([("Bad Name", "text", True)])


def test_snapshot_round_trip(spark, tmp_path):
    df = table(spark, FOLDER, "facts")
    mark = tb.snapshot(df, str(tmp_path / "s"))
    assert tb.restore(spark, str(tmp_path / "s"), mark).count() == df.count()
    with pytest.raises(ValueError):
        tb.restore(spark, str(tmp_path / "s"), "1-2-3")


def test_forget_is_idempotent(spark):
    df = spark.createDataFrame([(1, {"a": "b"}), (2, None)], "id int, metadata map<string,string>")
    once = mu.forget(df, F.col("id") == 1)
    assert mu.forget(once, F.col("id") == 1).where(fl.forgotten()).count() == 1 and mu.forget(df, F.lit(None).cast("boolean"), hard=True).count() == 2


def test_interference(spark):
    rows = [("n", "o", 0.9, 0.5, 0.4, 100.0), ("n", "p", 0.9, 0.5, 0.9, 100.0), ("d", "o", 0.96, 0.5, 0.4, 1.0), ("n", "n", 1.0, 0.5, 0.5, 0.0)]
    got = {(r.new_id, r.old_id): (r.duplicate, round(r.retroactive, 4), round(r.proactive, 4)) for r in mu.interference(spark.createDataFrame(rows, "new_id string, old_id string, similarity double, new_importance double, old_importance double, old_age_hours double")).collect()}
    assert got == {("n", "o"): (False, 0.0333, 0.0), ("n", "p"): (False, 0.0, 0.0017), ("d", "o"): (True, 0.0, 0.0)}


def test_stream_and_batch_agree(spark):
    stream = ms.replay(spark, FOLDER, "stream_messages", ms.session_extractor)
    got = {r.session_id: r.n for r in stream.groupBy("session_id").agg(F.sum("messages").alias("n")).collect()}
    batch = fl.once(table(spark, FOLDER, "stream_messages"), "msg_id")
    want = {r.session_id: r.n for r in ms.extracted(batch).groupBy("session_id").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_relative_dates_and_ordinals(spark):
    df = spark.createDataFrame([("what did we say in the second session?",), ("the 12th meeting",), ("none",), (None,)], "t string")
    assert [r.o for r in df.select(strings.ordinal_reference(F.col("t")).alias("o")).collect()] == [2, 12, None, None]


def test_query_analysis():
    from palimpsest.functions import querying as q

    a = q.analyse("stale map tiles without the useful robot restarting")
    assert ("map", "tiles") in a.phrases and "robot" in a.negated and "useful" in a.modifiers and "restarting" in a.relations
    assert a.weights()["map"] == 2.3 and "robot" not in a.weights()
    assert q.kind_of("When did the robot stop?") == "temporal" and q.kind_of("robots in docks") == "exploratory" and q.kind_of("What is the name of the dock?") == "attribute"
    assert q.decompose("Who moved it and when did it fall?") == ["Who moved it", "when did it fall"] and q.decompose("one thing") == ["one thing"] and q.decompose("") == [""]
    assert q.channel_weights(0.9) == (0.75, 0.25) and abs(sum(q.channel_weights(0.1, (0.8, 0.2), 5)) - 1) < 1e-12 and q.learned_weights((0.5, 0.5), True)[0] > 0.5


def test_competition_and_persistence():
    import numpy as np
    import pandas as pd

    from palimpsest.operators import ranking as rk

    c = pd.DataFrame({"id": [1, 2, 3], "vector": [[1.0, 0.0], [1.0, 0.01], [0.0, 1.0]], "strength": [0.5, 0.9, 0.1]})
    assert rk.compete(c)["id"].tolist() == [2, 3]
    assert np.allclose(rk.persistence(np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]])), [0.0, 1.0])
    x = np.random.default_rng(1).standard_normal((40, 5))
    turn = np.linalg.qr(np.random.default_rng(2).standard_normal((5, 5)))[0]
    assert np.allclose(rk.aligned(x, x @ turn), turn)


def test_persistence_of_all_vectors(spark):
    import numpy as np

    from palimpsest.operators import ranking as rk
    from palimpsest.plans.ranking import shape_persistence

    x = np.random.default_rng(4).standard_normal((150, 6))
    x[7] = x[3]
    rows = [(k, [float(a) for a in v]) for k, v in enumerate(x)]
    got = rk.deaths(spark.createDataFrame([*rows, rows[5], (999, None)], "id long, vector array<double>"), block=40).collect()
    assert np.allclose(sorted(d for d, in got), rk.persistence(x))
    assert rk.deaths(spark.createDataFrame(rows[:1], "id long, vector array<double>")).count() == 0
    every = np.stack([r.embedding for r in table(spark, "/root/testdata/sf0.1", "embeddings").collect()])
    assert np.allclose(sorted(d for d, in shape_persistence(spark, "/root/testdata/sf0.1").collect()), rk.persistence(every), atol=2e-6)


def _memories_in(spark, folder):
    rows = [(f"m{k:02}", f"u{k % 2}", "e1" if k < 30 else None, ["A", "a", "B"][: k % 4], [f"m{k - 1:02}"] if k else None) for k in range(40)]
    df = spark.createDataFrame(rows, "id string, user_id string, episode_id string, names array<string>, cited array<string>")
    df = df.select("id", "user_id", "episode_id", F.transform("names", lambda x: F.struct(x.alias("text"))).alias("entities"), F.struct(F.col("cited").alias("related_memories")).alias("relations"))
    df.union(df.limit(3)).write.parquet(f"{folder}/memories.parquet")
    return rows


def test_links_and_traces_of_all_memories(spark, tmp_path):
    from palimpsest.plans import graphing, relating

    rows = _memories_in(spark, tmp_path)
    names = {i: (u, {n.lower() for n in ns}) for i, u, _, ns, _ in rows}
    want = {i: sum(len(ns & ms) for j, (v, ms) in names.items() if j != i and v == u) for i, (u, ns) in names.items()}
    assert {r.id: r.links for r in relating.join_entity_links(spark, tmp_path).collect()} == want and max(want.values()) > 0
    got = {(r.start, r.node): r.depth for r in graphing.lineage_trace_all(spark, tmp_path).collect()}
    assert got == {(f"m{k:02}", f"m{k - d:02}"): d for k in range(40) for d in range(4) if k >= d}


def test_coactivation_of_whole_episodes(spark, tmp_path):
    from palimpsest.plans import graphing

    rows = [(i, episode) for i, _, episode, *_ in _memories_in(spark, tmp_path) if episode]
    got = {r.id: r.links for r in graphing.graph_coactivation_all(spark, tmp_path).collect()}
    assert got == {i: sum(1 for j, other in rows if other == episode and j != i) for i, episode in rows} and sum(got.values()) == 870


def test_heat_of_memories_ten_days_ahead(spark, tmp_path):
    """Ten days ahead of the reference time the divisor is 0: infinite, or not a number for a memory without anything, as in the SQL."""
    import pyarrow.parquet as pq

    from palimpsest.plans import relating
    from tests.oracle import connect, difference, rows_of_spark

    day = lambda d: dt.datetime(2025, 6, 1, tzinfo=dt.timezone.utc) + dt.timedelta(days=d)
    rows = [("a", 3, day(10), ["x"]), ("b", 3, day(9.5), []), ("c", 3, day(9.5), ["x"]), ("d", 2, day(11), ["x"]), ("e", 2, day(9), ["x"]), ("f", 2, None, ["x"]), ("g", 0, day(10), ["x"]), ("h", 1, day(-40), None)]
    df = spark.createDataFrame([(*r, None, None, None, None) for r in rows], "id string, access_count int, created_at timestamp, tags array<string>, entities array<string>, episode_id string, robot_id string, parent_id string")
    pq.write_table(df.toArrow(), tmp_path / "memories.parquet")
    heat = relating.agg_heat(spark, tmp_path)
    assert difference(heat, connect(tmp_path), relating.ORACLE_SQL["agg_heat"]) == ""
    assert {("inf", "a"), ("nan", "b"), ("inf", "c")} <= {(str(h), i) for h, i in rows_of_spark(heat)[1]}
