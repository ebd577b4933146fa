"""Exactness, recall and edge cases of the pair and search operators."""

import itertools
import random
import re

import numpy as np
import pytest

from palimpsest.llm import cooccurrence, leakage, name_variants, near_duplicates, neighbours, queries
from palimpsest.runtime import table
from tests.oracle import connect, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_rows_equal_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.ORACLE_SQL[name]) == ""


# Near duplicates


def _near(spark, rows, **how):
    df = spark.createDataFrame(rows, "id string, content string, gid string, words string")
    return sorted((r.id_a, r.id_b) for r in near_duplicates.similar_ids(df, "id", "content", **how).collect())


def _brute(rows, shingle, least, least_words):
    sets = {}
    for key, text, *_ in rows:
        w = re.findall("[a-z0-9]+", (text or "").lower())
        if len(w) >= max(least_words, shingle):
            sets[key] = set(zip(*(w[k:] for k in range(shingle))))
    return sorted((a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-12)


@pytest.mark.parametrize("shingle,least,least_words", [(3, 0.6, 12), (5, 0.8, 1), (1, 0.5, 1)])
def test_near_duplicates_equal_brute_force(spark, shingle, least, least_words):
    rng = random.Random(shingle)
    words = [f"w{k}" for k in range(60)]
    rows = [("null", None, "x", "y"), ("empty", "", "x", "y"), ("short", "one two", "x", "y")]
    for k in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([6, 12, 13, 30, 80, 300]))]
        rows.append((f"a{k}", " ".join(base), None, None))
        for j in range(3):
            edited = list(base)
            for _ in range(rng.randint(0, len(base) // 6)):
                edited[rng.randrange(len(edited))] = rng.choice(words)
            rows.append((f"a{k}-{j}", " ".join(edited).upper() + "!", None, None))
    rows += rows[5:9]  # redelivered
    assert _near(spark, rows, shingle=shingle, least=least, least_words=least_words) == _brute(rows, shingle, least, least_words)


def test_near_duplicates_of_a_hot_wording_and_a_long_text(spark):
    long = " ".join(str(k) for k in range(20_000))
    rows = [(f"c{k:03}", "the same status note again and again and then some more of it", None, None) for k in range(40)] + [("x", long, None, None), ("y", long + " end", None, None)]
    got = _near(spark, rows, shingle=3, least=0.6, least_words=12)
    assert len(got) == 40 * 39 // 2 + 1 and ("x", "y") in got
    df = spark.createDataFrame(rows, "id string, content string, gid string, words string")
    by = {r.id: r for r in near_duplicates.groups(df, "id", "content", 3, 0.6, 12).collect()}
    assert len({by[f"c{k:03}"].group for k in range(40)}) == 1 and by["x"].group == by["y"].group != by["c000"].group and by["x"].links == 1


def test_near_duplicates_of_nothing(spark):
    assert _near(spark, [], shingle=3, least=0.6) == []
    with pytest.raises(ValueError):
        near_duplicates.Plan(0.0)


def test_allocation_spends_exactly_its_units():
    rng = np.random.default_rng(1)
    one, units = rng.random((50, 9)).astype(np.float32), rng.integers(1, 15, 50)
    two = one + rng.random((50, 9)).astype(np.float32)
    given = near_duplicates._allocate(one, two, units)
    assert (given.sum(1) == units).all()
    for row in range(50):
        best = min(sum((0, one[row, j], two[row, j])[g] for j, g in enumerate(gs)) for gs in itertools.product(range(3), repeat=9) if sum(gs) == units[row]) if row < 4 else None
        if best is not None:
            assert abs(sum((0, one[row, j], two[row, j])[g] for j, g in enumerate(given[row])) - best) < 1e-4


# Neighbours


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, model string, dimensions int, vector array<float>, copy string, code int")


def test_neighbours_equal_brute_force_on_a_small_set(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 16))
    rows = [(k, "a" if k % 3 else "b", 16, [float(v) for v in x[k]], None, None) for k in range(300)]
    rows += [(400 + k, "a", 16, rows[1][3], None, None) for k in range(9)]  # copies
    rows += [rows[7], (900, "a", 16, None, None, None), (901, "a", 3, [1.0, 2.0], None, None), (902, "a", 16, [float("nan")] * 16, None, None), (903, "a", 16, [0.0] * 16, None, None), (904, "lone", 2, [1.0, 0.0], None, None)]
    got = {(r.vec_id, r.other): r.similarity for r in neighbours.neighbours(_vectors(spark, rows), 5).collect()}
    usable = {r[0]: (r[1], np.array(r[3], np.float32).astype(float)) for r in rows if r[0] < 900 or r[0] == 904}
    unit = {k: (m, v / np.linalg.norm(v)) for k, (m, v) in usable.items()}
    for k, (m, v) in unit.items():
        best = sorted(((-round(float(v @ w), 6), j) for j, (n, w) in unit.items() if n == m and j != k))[:5]
        mine = sorted(((-round(s, 6), o) for (q, o), s in got.items() if q == k))
        assert len(mine) == len(best) and np.allclose([a for a, _ in mine], [a for a, _ in best], atol=1e-5), k
        if 400 <= k < 900:
            assert [o for _, o in mine][:5] == sorted(j for j in [1, *range(400, 409)] if j != k)[:5]
    assert not any(900 <= q < 904 or 900 <= o < 904 for q, o in got)


def test_neighbours_of_nothing(spark):
    assert neighbours.neighbours(_vectors(spark, []), 5).count() == 0


def test_neighbours_recall_on_stated_queries(spark):
    v = table(spark, "/root/testdata/sf0.01", "memory_vectors")
    exact = {(r.vec_id, r.other) for r in neighbours.exact_neighbours(v, v.where("vec_id % 100 = 0"), 5).collect() if r.similarity >= 0.75}
    found = {(r.vec_id, r.other) for r in neighbours.neighbours(v, 5, 0.75).collect()}
    assert exact and len(exact & found) >= 0.9 * len(exact)


def _clustered(n, spread, seed=3, dimensions=64):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 4, dimensions))
    x = centres[np.arange(n) % len(centres)] + spread * rng.standard_normal((n, dimensions))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_ascent_takes_longest_prefixes_first_in_all_trees():
    x = _clustered(900, 0.5).astype(np.float32)
    codes = [neighbours.hashed(x, neighbours.planes(0, t, 64)) for t in range(4)]
    orders, low, high = neighbours.ascend(codes, 40)
    shared = lambda t, i, j: neighbours.BITS - int(codes[t][i] ^ codes[t][j]).bit_length()
    for i in range(0, 900, 37):
        met = [(t, int(j)) for t in range(4) for j in orders[t][low[t, i] : high[t, i]] if j != i]
        assert 20 <= len(met) <= 84  # the trees' shares, trimmed at the last length
        shortest = min(shared(t, i, j) for t, j in met)
        # Whoever shares more than the last length with the row, in any tree, was met there.
        assert {(t, j) for t in range(4) for j in range(900) if j != i and shared(t, i, j) > shortest} <= set(met)


def test_ascent_is_bounded_where_all_rows_share_a_prefix():
    same = np.zeros((5000, 8), np.float32) + np.float32(1)
    _, low, high = neighbours.ascend([neighbours.hashed(same, neighbours.planes(0, t, 8)) for t in range(4)], 40)
    assert ((high - low - 1).sum(axis=0) <= 80).all() and ((high - low - 1).sum(axis=0) >= 40).all()


def test_neighbours_keep_their_recall_when_the_collection_outgrows_stretches_and_candidates(spark, monkeypatch):
    x = _clustered(12_000, 0.5).astype(np.float32)
    s = x @ x.T
    np.fill_diagonal(s, -1)
    top = np.argsort(-s, axis=1)[:, :5]
    exact = {(k, int(j)) for k in range(len(x)) for j in top[k] if s[k, j] >= 0.75}
    df = _vectors(spark, [(k, "m", 64, [float(a) for a in v], "x", 0) for k, v in enumerate(x)])
    monkeypatch.setattr(neighbours, "ROWS_PER_STRETCH", 3000)
    found = {(r.vec_id, r.other) for r in neighbours.neighbours(df, 5, 0.75, candidates=75).collect()}  # under 2 % with three groves
    assert len(exact) > 1000 and len(exact & found) >= 0.9 * len(exact)


@pytest.mark.parametrize("candidates", [60, 15])  # 2 % and 0.5 % of the collection with three groves
def test_neighbours_recall_where_few_rows_are_compared(spark, monkeypatch, candidates):
    monkeypatch.setattr(neighbours, "ROWS_PER_STRETCH", 3000)
    v = table(spark, "/root/testdata/sf0.1", "memory_vectors")
    exact = {(r.vec_id, r.other) for r in neighbours.exact_neighbours(v, v.where("vec_id % 100 = 0"), 5).collect() if r.similarity >= 0.75}
    found = {(r.vec_id, r.other) for r in neighbours.neighbours(v, 5, 0.75, candidates=candidates).collect()}
    assert len(exact) > 100 and len(exact & found) >= 0.9 * len(exact)


def test_hot_blocks_cut_into_parts_link_the_same(spark, monkeypatch):
    rng = random.Random(9)
    given = ["Robert", "Bob", "Rob", "Anna", "Anne", "William", "Bill", "Liz", "Elizabeth"]
    rows = [("u" if k % 5 else "v", [(f"{rng.choice(given)} {rng.choice(['Hartmann', 'Hartman', 'Hartmanns'])}", "person")]) for k in range(120)]
    df = spark.createDataFrame(rows, "user_id string, entities array<struct<text:string,type:string>>")
    want = sorted(map(tuple, name_variants.variant_pairs(df).collect()))
    monkeypatch.setattr(name_variants, "PART", 3)
    assert sorted(map(tuple, name_variants.variant_pairs(df).collect())) == want and len(want) > 10


# Leakage


def test_leaks_equal_brute_force(spark):
    rng = random.Random(3)
    pool = [f"word{k}" for k in range(200)]
    items = [(k, " ".join(rng.choice(pool) for _ in range(rng.choice([5, 10, 40])))) for k in range(12)] + [(12, None), (13, ""), (14, items_dup := "same " * 12)]
    docs = [(100, None, "x"), (101, "", "x"), (102, "Word1", "x"), (103, items_dup, "x")]
    for k in range(60):
        words = [rng.choice(pool) for _ in range(80)]
        source = (items[k % 12][1]).split()
        n = rng.choice([0, 7, 9, 10, 11, 30])
        words[20:20] = source[:n]
        docs.append((k, "  ".join(words).title().replace("word", "wo­rd") + "​.", "x"))
    ddf = spark.createDataFrame(docs, "doc_id long, text string, shingle string")
    idf = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaked_passages(ddf, idf).collect()}
    grams = lambda t: {tuple(w[k : k + 10]) for w in [leakage.words(t)] for k in range(len(w) - 9)}
    want = {(d, i) for d, t, _ in docs for i, u in items if grams(t) & grams(u)}
    assert got == want and len(want) > 10


def test_items_in_blocks_leak_alike(spark, monkeypatch):
    rng = random.Random(8)
    pool = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(pool) for _ in range(30))) for k in range(20)]
    docs = [(k, " ".join([*rng.choices(pool, k=20), *items[k % 20][1].split()[: rng.choice([5, 12, 30])], *rng.choices(pool, k=20)])) for k in range(50)]
    ddf, idf = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, leakage.leaked_passages(ddf, idf).collect()))
    monkeypatch.setattr(leakage, "ITEM_BYTES", 24 * 800)
    assert sorted(map(tuple, leakage.leaked_passages(ddf, idf).collect())) == want and len(want) > 20


def test_pair_codes_of_high_numbers_come_apart_again(spark):
    pair = ((1 << 31) + 5 << 32) | 7
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(pair - (1 << 64),)], "pair long").select(F.shiftrightunsigned("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")).first()
    assert tuple(row) == ((1 << 31) + 5, 7)


def test_leaks_of_nothing(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert leakage.leaked_passages(d, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert leakage.leaked_passages(d.limit(0), spark.createDataFrame([(1, "a " * 20)], "item_id long, text string")).count() == 0


# Co-occurrence


def test_pairs_with_ties_nulls_and_a_large_basket(spark, monkeypatch):
    monkeypatch.setattr(cooccurrence, "BUFFER_PAIRS", 50)
    rows = [("t", ["a", "b", None, "b"]), ("t", ["b", "a"]), ("t", None), ("t", []), ("t", [f"x{k:02}" for k in range(20)]), ("u", ["a", "b"]), ("t", ["é", "z"])]
    df = spark.createDataFrame(rows, "kind string, items array<string>")
    got = {(r.item_kind, r.item_a, r.item_b): (r.together, r.count_a, r.count_b) for r in cooccurrence.pair_counts(df).collect()}
    assert got[("t", "a", "b")] == (2, 2, 2) and got[("u", "a", "b")] == (1, 1, 1) and got[("t", "z", "é")] == (1, 1, 1) and len(got) == 190 + 3
    assert cooccurrence.pair_counts(df.limit(0)).count() == 0


# Names


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("Xenia Velzoman", "Velzoman, Xenia", True), ("Daniel Galrissen", "Dan Galrissen", True), ("Quentin Marmossen", "Quen. Marmossen", True), ("Q.E. Marmossen", "Quentin Marmossen", True),
        ("Christopher Halnniford", "Christophre Halnniford", True), ("Noemí Velzoman", "Xenia Velzoman", False), ("Frederick J. Orr", "Frederick K. Orr", False), ("JOSEPH JASSKAMERE", "joseph jasskamere", True),
    ],
)
def test_persons(a, b, same):
    x, y = name_variants.person_form(a)[0], name_variants.person_form(b)[0]
    assert (x == y or name_variants.same_person(x, y)) is same
    if same and x != y:
        assert set(name_variants.person_keys(x)) & set(name_variants.person_keys(y))


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("Marther Harbor Associates Incorporated", "marther harbor assoc.", True), ("Lnuman Meridian Laboratories", "Lunman Meridian Laboratories GmbH", True), ("Zorthersummit Systems", "Zorther Summit Systems Limited", True),
        ("Zorther Delta Logistics", "Zorther Summit Systems", False), ("Manufacturing Norkon Orchard", "Norkon Orchard Mfg G.m.b.H.", True), ("Brostolo High. Technologies", "The Brostolo Highland Technologies Corporation", True),
    ],
)
def test_organisations(a, b, same):
    x, y = name_variants.organisation_form(a)[0], name_variants.organisation_form(b)[0]
    assert (x == y or name_variants.same_organisation(x, y)) is same
    if same and x != y:
        assert set(name_variants.organisation_keys(x)) & set(name_variants.organisation_keys(y))


def test_jaro_winkler_known_values():
    assert round(name_variants.jaro_winkler("martha", "marhta"), 4) == 0.9611
    assert round(name_variants.jaro_winkler("dixon", "dicksonx"), 4) == 0.8133
    assert name_variants.jaro_winkler("", "a") == 0.0 and name_variants.jaro_winkler("a", "a") == 1.0


def test_clusters_respect_tenants_and_ambiguous_initials(spark):
    names = [("u1", "Daniel Galrissen"), ("u1", "Diana Galrissen"), ("u1", "D. Galrissen"), ("u1", "Danl Galrissen"), ("u2", "Daniel Galrissen"), ("u2", "D. Galrissen"), ("u2", None), ("u2", " ")]
    rows = [(u, [(n, "PERSON", 1.0)], "x") for u, n in names] + [("u3", None, "x"), ("u3", [], "x")]
    df = spark.createDataFrame(rows, "user_id string, entities array<struct<text:string,type:string,confidence:float>>, node string")
    got = {(r.user_id, r.text_a, r.text_b) for r in name_variants.variant_pairs(df).collect()}
    assert ("u2", "D. Galrissen", "Daniel Galrissen") in got and not any("Diana" in a + b or ("D. " in a + b and u == "u1") for u, a, b in got)
    assert name_variants.clusters(df.limit(0)).count() == 0


@pytest.mark.parametrize("a,b,same", [("Bob Lee", "Robert Lee", True), ("B. Kim", "Ben Kim", True), ("Sam Cox", "Samuel Cox", True), ("Bob Lee", "Bob Kim", False), ("Ana de Souza", "Ana de Silva", False)])
def test_short_surnames(a, b, same):
    x, y = name_variants.person_form(a)[0], name_variants.person_form(b)[0]
    assert name_variants.same_person(x, y) is same
    assert not same or set(name_variants.person_keys(x)) & set(name_variants.person_keys(y))


def test_long_names_are_kept():
    assert name_variants.person_form("Maria del Carmen Garcia Lopez Fernandez")
