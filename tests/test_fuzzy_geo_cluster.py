"""Near-duplicate labels, geo grid, clustering invariants."""

import difflib
import random

from pyspark.sql import functions as F

from lapse import session
from lapse.operators import cluster as cl
from lapse.operators import fuzzy as fz
from lapse.operators import geo as gx

# Category-like labels, ten of them with a near twin.
NAMES = ["costruction_tools_garden", "construction_tools_safety", "fashion_male_clothing", "fashio_female_clothing", "home_appliances",
         "home_appliances_2", "home_confort", "home_comfort_2", "costruction_tools_tools", "construction_tools_lights", "auto", "toys", "pet_shop",
         "perfumery", "telephony", "cool_stuff", "watches_gifts", "garden_tools", "music", "books_imported", "furniture_decor", "bed_bath_table"]


def _golden_close(words, cutoff=0.8, n=3):
    return {w: difflib.get_close_matches(w, words, n=n, cutoff=cutoff) for w in words}


def test_close_labels_match_standard_library(spark):
    df = spark.createDataFrame([(w,) for w in NAMES], "c string")
    got = {}
    for r in fz.close_labels(df, "c").orderBy("word", "rank").collect():
        got.setdefault(r.word, []).append(r.candidate)
    want = _golden_close(NAMES)
    assert got == want
    multi = {w for w, m in want.items() if len(m) > 1}
    assert len(multi) == 10 and {r.word for r in fz.labels_with_neighbours(fz.close_labels(df, "c")).collect()} == multi


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_short_and_empty_labels(spark):
    rnd = random.Random(6)
    words = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 4))) for _ in range(120)} | {"", "ab", "cd", "xyzw"})
    df = spark.createDataFrame([(w,) for w in words], "c string")
    for k in (1, 2):
        got = {(r.word, r.candidate): r.distance for r in fz.close_labels_levenshtein(df, "c", k).collect()}
        assert got == {(a, b): _edits(a, b) for a in words for b in words if _edits(a, b) <= k}
    close = {(r.word, r.candidate) for r in fz.close_labels(df, "c", n=200).collect()}
    assert close == {(w, c) for w, cs in {w: difflib.get_close_matches(w, words, n=200, cutoff=0.8) for w in words if w}.items() for c in cs} | {("", "")}


def test_close_labels_random_words_exact(spark):
    rnd = random.Random(1)
    base = ["".join(rnd.choice("abcdefgh_") for _ in range(rnd.randint(4, 14))) for _ in range(80)]
    words = sorted(set(base + [w[:-1] + "x" for w in base[:30]] + [w + "s" for w in base[30:50]]))
    df = spark.createDataFrame([(w,) for w in words], "c string")
    got = {}
    for r in fz.close_labels(df, "c").orderBy("word", "rank").collect():
        got.setdefault(r.word, []).append(r.candidate)
    assert got == _golden_close(words)


def test_raster_counts_sum_to_points(spark):
    rnd = random.Random(2)
    pts = [(rnd.uniform(0, 10), rnd.uniform(-5, 5), rnd.random()) for _ in range(500)]
    df = spark.createDataFrame(pts, "x double, y double, v double")
    g = gx.raster_mean(df, "x", "y", "v", 50, 25)
    assert g.agg(F.sum("n")).first()[0] == 500
    assert g.agg(F.max("col"), F.max("row")).first() == (49, 24)


def test_assign_centers_and_elbow(spark):
    rnd = random.Random(4)
    pts = [(rnd.gauss(cx, 0.3), rnd.gauss(cy, 0.3)) for cx, cy in ((0, 0), (5, 5), (0, 5)) for _ in range(100)]
    df = spark.createDataFrame(pts, "a double, b double")
    a = cl.assign_centers(df, ["a", "b"], [[0, 0], [5, 5], [0, 5]])
    assert a.groupBy("Cluster").count().count() == 3
    e = {r.k: r.sse for r in cl.elbow(df, ["a", "b"], ks=[1, 2, 3]).collect()}
    assert e[1] > e[2] > e[3]


def test_lloyd_matches_numpy_for_all_k_at_once(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.5, (80, 2)) for c in ((0, 0), (4, 1), (1, 5))] + [np.tile([2.0, 2.0], (90, 1))])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double").repartition(5)
    starts = {k: cl.first_centers(np.unique(x, axis=0), k, 7) for k in (1, 2, 4, 6)}
    got = cl.lloyd(df, ["a", "b"], starts)
    for k, c in starts.items():
        c = np.array(c)
        for _ in range(200):
            at = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            c = np.array([x[at == j].mean(axis=0) if (at == j).any() else c[j] for j in range(k)])
        assert np.allclose(got[k], c, atol=1e-8)
    assert cl.lloyd(df.repartition(3), ["a", "b"], starts) == got  # bit for bit


def test_lloyd_assigns_rows_in_tasks_and_sums_exactly(spark, monkeypatch):
    import numpy as np
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(0, 1, (500, 2)), 1) + np.array([[-0.5, 2.0 ** 10]])  # negative and larger values
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double").repartition(3)
    starts = {k: cl.first_centers(np.unique(x, axis=0), k, 7) for k in (1, 3, 5)}
    fixed = [[round(v * cl.UNIT) for v in r] for r in x.tolist()]
    want = {}
    for k, c in starts.items():
        for _ in range(4):
            at = np.sqrt(((x[:, None] - np.array(c)[None]) ** 2).sum(axis=2)).argmin(axis=1)
            c = [[sum(f[d] for f, j in zip(fixed, at) if j == i) / int((at == i).sum()) / cl.UNIT for d in range(2)] if (at == i).any() else c[i] for i in range(k)]
        want[k] = c
    plain = cl.nearest

    def refused(*_):
        raise AssertionError("a row is copied for each start and its distances are found several times")
    monkeypatch.setattr(cl, "nearest", refused)
    assert {k: np.array(v).tolist() for k, v in cl.lloyd(df, ["a", "b"], starts, max_iter=4).items()} == {k: np.array(v, float).tolist() for k, v in want.items()}
    monkeypatch.setattr(cl, "nearest", plain)
    far = spark.createDataFrame([(0.0,), (2.0,), (1e12,)], "a double")  # beyond longs in fixed point
    assert cl.lloyd(far, ["a"], {2: [[0.0], [1e12]]}) == {2: [[1.0], [1e12]]}


def test_kmeans_on_few_points_and_none(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 5 + [(3.0, 4.0)], "x double, MonetaryValue double")
    lab, centers = cl.kmeans_labels(df, ["x"], k=4)
    assert centers == [[3.0], [1.0]] and sorted((r["x"], r["Cluster"]) for r in lab.collect()) == [(1.0, 1)] * 5 + [(3.0, 0)]
    empty, none = cl.kmeans_labels(df.limit(0), ["x"], k=4)
    assert none == [] and empty.count() == 0
    assert cl.elbow(df.limit(0), ["x"]).count() == 0
    e = {r["k"]: r for r in cl.elbow(df, ["x"], ks=range(1, 4)).collect()}
    assert round(e[1]["sse"], 9) == round(sum((v - 4 / 3) ** 2 for v in [1.0] * 5 + [3.0]), 9) and e[2]["sse"] == e[3]["sse"] == 0.0


def test_rounds_find_distances_where_the_rows_lie(spark, monkeypatch):
    """No array of distances is planned in Spark a round, and numpy picks what the plan's expression picks."""
    import numpy as np
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(0, 2, (300, 3)), 1)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").repartition(3)
    centers = [[0.0, 0.0, 0.0], [1.0, 1.0, -1.0], [-2.0, 0.5, 0.0], [1.0, 1.0, -1.0]]
    rows = df.select("a", "b", "c", cl.nearest(["a", "b", "c"], centers)[0].alias("j")).collect()
    assert cl.nearest_of([np.array([r[d] for r in rows]) for d in range(3)], centers).tolist() == [r["j"] for r in rows]
    plain = cl.distances

    def refused(*_):
        raise AssertionError("distances are sent to the tasks")
    monkeypatch.setattr(cl, "distances", refused)
    before = list(session._WRITTEN)
    got = cl.lloyd(df, ["a", "b", "c"], {4: centers})[4]
    assert session._WRITTEN == before  # the blocks are deleted
    monkeypatch.setattr(cl, "distances", plain)
    at = cl.nearest_of(list(x.T), got)
    assert all(np.allclose(got[j], x[at == j].mean(axis=0)) for j in set(at.tolist()))
