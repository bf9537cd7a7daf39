"""Models as tables: trees and boosting against a plain version, the logistic optimum, features without a driver dictionary."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapse.operators import features, linear, ml, split, trees
from lapse.operators.trees import UNIT, Params, grow, poisson, score, uniform

NUM, CAT = ["a", "b"], ["c", "d"]


def _rows(n=400, seed=5):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c, d = rnd.choice([0.0, rnd.uniform(0, 10)]), rnd.randint(0, 6), rnd.choice("uvwxyz"), rnd.choice(["p", "q", "r s"])
        y = int(rnd.random() < 1 / (1 + math.exp(3 - a / 2 - (c == "w") * 2 + (d == "q"))))
        out.append((i, a, b, c, d, y, 1.0 if y == 0 else 1.7))
    return out


def _frame(spark, rows):
    return spark.createDataFrame(rows, "id int, a double, b int, c string, d string, y int, w double").repartition(4)


def _edges(values, k=32):
    v = sorted(values)
    return sorted({v[i * (len(v) - 1) // k] for i in range(1, k)})


def _plain(rows, p, hashes, offsets, slot_of):
    """Trees by loops over rows: {(tree, node): (column, end or value, n, value)}."""
    edges = [_edges([r[1] for r in rows]), _edges([r[2] for r in rows])]
    out, margin = {}, np.zeros(len(rows))
    values = {c: sorted({r[3 + i] for r in rows}) for i, c in enumerate(CAT)}
    for t in range(p.trees):
        if p.rows == "bootstrap":
            times = poisson(uniform(p.seed, t, hashes))
        else:
            times = (uniform(p.seed, t, hashes) < p.rows).astype(int) if p.rows < 1 else np.ones(len(rows), int)
        prob = 1 / (1 + np.exp(-margin))
        y, w = np.array([r[5] for r in rows]), np.array([r[6] for r in rows])
        g, h = (w * (prob - y), w * prob * (1 - prob)) if p.boosting else (w * y, w)
        g, h = np.rint(g * UNIT).astype(int), np.rint(h * UNIT).astype(int)
        at = {i: 1 for i in range(len(rows))}
        leaf = {}
        for level in range(p.depth + 1):
            for node in sorted({v for v in at.values() if v.bit_length() == level + 1}):
                mine = [i for i in at if at[i] == node and times[i]]
                s = lambda ids: (sum(int(g[i]) * int(times[i]) for i in ids), sum(int(h[i]) * int(times[i]) for i in ids), sum(int(times[i]) for i in ids))
                total = s(mine)
                fit = lambda x: (x[0] / UNIT) ** 2 / (x[1] / UNIT + p.l2) if x[1] / UNIT + p.l2 > 0 else 0.0
                best = None
                if level < p.depth:
                    tests = [((j, e), offsets[j] + k, j, lambda r, j=j, e=e: r[1 + j] > e) for j in range(2) for k, e in enumerate(edges[j])]
                    tests += [((2 + i, v), slot_of[c, v], None, lambda r, i=i, v=v: r[3 + i] == v) for i, c in enumerate(CAT) for v in values[c]]
                    for name, slot, j, right in tests:
                        if isinstance(p.columns, float) and p.columns < 1:
                            if not uniform(p.seed, t, -1, np.array([slot if j is None else j]))[0] < p.columns:
                                continue
                        rs = s([i for i in mine if right(rows[i])])
                        ls = tuple(a - b for a, b in zip(total, rs))
                        if min(rs[2], ls[2]) < max(1, p.least_rows) or min(rs[1], ls[1]) < p.least_hess * UNIT:
                            continue
                        gain = fit(ls) + fit(rs) - fit(total)
                        if gain > 0 and (best is None or gain > best[0] + 1e-12):
                            best = (gain, name, right)
                value = -p.rate * total[0] / (total[1] + p.l2 * UNIT) if p.boosting else total[0] / total[1]
                leaf[node] = value
                out[t, node] = (None if best is None else ([*NUM, *CAT][best[1][0]], best[1][1]), total[2], value)
                for i in [i for i in at if at[i] == node]:
                    if best is None:
                        at[i] = -node
                    else:
                        at[i] = 2 * node + int(best[2](rows[i]))
        margin = margin + np.array([leaf[abs(at[i])] for i in range(len(rows))])
    return out, margin


@pytest.mark.parametrize("p", [Params(depth=4, least_rows=9), Params(trees=4, depth=3, boosting=True, rate=0.3, l2=1.0, least_hess=1.0, rows=0.8, columns=0.7, seed=3),
                               Params(trees=12, depth=2, boosting=True, rate=0.5, l2=0.5), Params(trees=3, depth=3, rows="bootstrap", least_rows=5)])
def test_trees_match_a_plain_version(spark, p):
    rows = _rows()
    df = _frame(spark, rows)
    f = features.learn(df, NUM, CAT)
    hashes = dict(df.select("id", F.xxhash64("a", "b", "c", "d", "y")).collect())
    slot_of = {(r["column"], r["value"]): r["code"] + f.offsets[-1] for r in f.dictionary.collect()}
    want, margin = _plain(rows, p, np.array([hashes[i] for i in range(len(rows))]), f.offsets, slot_of)
    nodes = grow(df, f, "y", "w", p, refresh=5)
    got = {(r["tree"], r["node"]): r for r in nodes.collect()}
    assert set(got) == set(want)
    for k, (test, n, value) in want.items():
        r = got[k]
        assert r["n"] == n and r["value"] == pytest.approx(value, rel=1e-6, abs=1e-9)
        assert (None if not r["kind"] else (r["column"], r["threshold"] if r["kind"] == 1 else r["feature_value"])) == test
    scored = {r["id"]: r["score"] for r in score(df, nodes, p).collect()}
    for i in range(len(rows)):
        assert scored[i] == pytest.approx(1 / (1 + math.exp(-margin[i])) if p.boosting else margin[i] / p.trees, rel=1e-6)
    again = {(r["tree"], r["node"]): r for r in grow(df.repartition(3), f, "y", "w", p).collect()}
    assert again == got  # bit for bit, whatever the partitions


def test_scores_come_from_the_table_alone(spark):
    """DuckDB walks the stored nodes and finds the same scores."""
    import duckdb
    rows = _rows(200)
    df = _frame(spark, rows)
    p = Params(trees=5, depth=3, boosting=True, rate=0.3, l2=1.0)
    nodes = grow(df, features.learn(df, NUM, CAT), "y", "w", p)
    scored = {r["id"]: r["score"] for r in score(df, nodes, p).collect()}
    con = duckdb.connect()
    con.register("n", nodes.toPandas())
    con.register("r", df.toPandas())
    con.sql("CREATE TABLE at0 AS SELECT r.*, t.tree, 1 AS node FROM r, (SELECT DISTINCT tree FROM n) t")
    for d in range(p.depth):
        con.sql(f"""CREATE TABLE at{d + 1} AS SELECT at{d}.* REPLACE (CASE kind WHEN 0 THEN at{d}.node
                    WHEN 1 THEN 2 * at{d}.node + CAST(CASE "column" WHEN 'a' THEN a ELSE b END > threshold AS INTEGER)
                    ELSE 2 * at{d}.node + CAST(CASE "column" WHEN 'c' THEN c ELSE d END = feature_value AS INTEGER) END AS node)
                    FROM at{d} JOIN n ON at{d}.tree = n.tree AND at{d}.node = n.node""")
    found = con.sql(f"SELECT id, 1 / (1 + exp(-sum(value))) FROM at{p.depth} a JOIN n ON a.tree = n.tree AND a.node = n.node GROUP BY id").fetchall()
    assert len(found) == 200
    for i, s in found:
        assert scored[i] == pytest.approx(s, rel=1e-12)


def test_forest_draws_columns_per_node(spark):
    rows = _rows(600)
    df = _frame(spark, rows)
    f = features.learn(df, NUM, CAT)
    p = Params(trees=30, depth=4, least_rows=5, rows="bootstrap", columns="sqrt per node")
    nodes = grow(df, f, "y", "w", p, together=7)
    assert nodes.select("tree").distinct().count() == 30
    assert nodes.where("node = 1 AND kind > 0").select("column").distinct().count() >= 3  # one best column would be in every root
    auc = ml.evaluate(score(df, nodes, p).withColumn("prediction", F.col("score") > 0.5).withColumn("is_churned", F.col("y"))).first()["roc_auc"]
    assert auc > 0.7
    assert trees.importance(nodes, p).agg(F.sum("importance")).first()[0] == pytest.approx(1.0)


def test_no_rows_one_class_unknown_values(spark):
    df = _frame(spark, [(i, 1.0 * i, 2, "u", None, 1, 1.0) for i in range(30)])
    f = features.learn(df, NUM, CAT)
    nodes = grow(df, f, "y", "w", Params(depth=3))
    assert [(r["node"], r["kind"], r["value"]) for r in nodes.collect()] == [(1, 0, 1.0)]
    new = spark.createDataFrame([(1, None, None, None, None), (2, float("nan"), 9, "never", "seen")], "id int, a double, b int, c string, d string")
    assert [r["score"] for r in score(new, nodes, Params(depth=3)).collect()] == [1.0, 1.0]
    empty = df.limit(0)
    assert grow(empty, features.learn(empty, NUM, CAT), "y", "w", Params(depth=3)).count() == 0
    grown = grow(_frame(spark, _rows()), features.learn(_frame(spark, _rows()), NUM, CAT), "y", "w", Params(depth=3))
    assert score(new, grown, Params(depth=3)).where("score BETWEEN 0 AND 1").count() == 2


def test_many_values_stay_off_the_driver(spark):
    """A column of 150,000 values: several chunks of slots, and no list of values is collected."""
    df = spark.range(150_000).selectExpr("CAST(id % 7 AS DOUBLE) AS a", "concat('city ', id) AS c", "CAST(id % 7 > 3 AS INT) AS y", "1.0D AS w")
    f = features.learn(df, ["a"], ["c"])
    assert f.values == [150_000] and f.slots > 2 * trees.CHUNK
    codes = [r["code"] for r in f.dictionary.orderBy("value").limit(3).collect()]
    assert codes == [0, 1, 2]
    nodes = grow(df, f, "y", "w", Params(depth=2, least_rows=50)).collect()
    assert [(r["column"], r["threshold"]) for r in nodes if r["kind"]] == [("a", 3.0)]
    table = linear.fit_logistic(df.where("a < 5"), f, "y", "w")
    assert table.count() == 150_002


def test_logistic_is_at_its_optimum(spark):
    rows = _rows(500)
    df = _frame(spark, rows)
    f = features.learn(df, NUM, CAT)
    table = linear.fit_logistic(df, f, "y", "w")
    e = {r["feature"]: r for r in linear.score_equations(df, table, "y", "w").collect()}
    assert set(e) == {"(intercept)", "a", "b", *[f"c_{v}" for v in "uvwxyz"], "d_p", "d_q", "d_r s"}
    assert max(r["residual"] for r in e.values()) < 1e-7 and e["a"]["n_rows"] == 500
    # the same objective by Newton steps in numpy
    x = np.array([[1.0, (r[1] - np.mean([q[1] for q in rows])) / np.std([q[1] for q in rows]), (r[2] - np.mean([q[2] for q in rows])) / np.std([q[2] for q in rows]),
                   *[r[3] == v for v in "uvwxyz"], *[r[4] == v for v in ("p", "q", "r s")]] for r in rows], float)
    y, w = np.array([r[5] for r in rows]), np.array([r[6] for r in rows])
    b, ridge = np.zeros(x.shape[1]), np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(50):
        q = 1 / (1 + np.exp(-x @ b))
        b = b - np.linalg.solve(x.T @ (x * (w * q * (1 - q))[:, None]) + ridge, x.T @ (w * (q - y)) + ridge @ b)
    scored = {r["id"]: r["score"] for r in linear.score(df, table).collect()}
    assert all(scored[i] == pytest.approx(v, abs=1e-6) for i, v in enumerate(1 / (1 + np.exp(-x @ b))))


def test_models_saved_and_loaded(spark, tmp_path):
    rows = [(r[0], r[1], r[2], r[3], r[4], r[5]) for r in _rows()]
    df = spark.createDataFrame(rows, "id int, a double, b int, c string, d string, is_churned int")
    for kind in ("tree", "logistic"):
        model = ml.fit(df, kind, NUM, CAT)
        ml.save(model, str(tmp_path / kind))
        again = ml.load(spark, str(tmp_path / kind))
        key = lambda m: sorted((r["id"], r["score"], r["prediction"]) for r in ml.score(m, df).collect())
        assert again.kind == kind and key(again) == key(model)


def test_split_takes_the_first_by_md5(spark):
    import hashlib
    rnd = random.Random(9)
    rows = [(i % 900, rnd.choice([None, rnd.uniform(-9, 9)]), rnd.choice([0, 1, 1, None])) for i in range(1000)] + [(7, 1.5, 1)] * 300
    df = spark.createDataFrame(rows, "k long, x double, y int").repartition(5)
    got = sorted((r["k"], r["x"] or 0.0, r["y"], r["is_test"]) for r in split.stratified_split(df, "y", 0.3, 11).collect())
    text = lambda v: "\\" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)
    h = lambda r: hashlib.md5("|".join(["11", *map(text, r)]).encode()).hexdigest()
    want = []
    for y in (0, 1):
        mine = sorted((h(r), r) for r in rows if r[2] == y)
        cut = mine[int(len(mine) * 0.3 + 0.5) - 1][0]
        want += [(r[0], r[1] or 0.0, y, q <= cut) for q, r in mine]
    assert got == sorted(want)
    assert split.stratified_split(df.limit(0), "y", 0.3, 1).count() == 0


def test_histograms_add_up_over_blocks_and_chunks(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(trees, "CHUNK", 16)
    n_slots, active, p = 300, np.array([2, 3]), Params(depth=3)
    tree = trees.Tree(3)
    tree.kind[1], tree.col[1], tree.code[1] = trees.NUMERIC, 0, 4
    held, want, merged = [], {}, []
    merge = trees._merge
    monkeypatch.setattr(trees, "_merge", lambda parts: merged.append(sum(len(k) for k, _ in parts)) or merge(parts))
    parts: dict = {}
    for at in range(60):
        n = rng.integers(1, 6)
        codes = np.concatenate([rng.integers(0, 8, (n, 1)), np.where(rng.random((n, 1)) < 0.2, -1, rng.integers(8 + 4 * at, 60 + 4 * at, (n, 1)))], axis=1).astype(np.int32)
        b = {"codes": codes, "y": rng.integers(0, 2, n).astype(float), "w": rng.random(n), "id": np.arange(n)}
        for row, y, w in zip(codes, b["y"], b["w"]):
            for slot in [*row[row >= 0], -1]:
                s = want.setdefault((int(row[0] > 4), int(slot)), [0, 0, 0])
                s[:] = [s[0] + int(np.rint(w * y * UNIT)), s[1] + int(np.rint(w * UNIT)), s[2] + 1]
        one = trees._histogram(b, 0, tree, 1, active, None, p, n_slots)
        held = trees._add(held, one)
        for key, found in trees._chunks(0, one, 16, n_slots):  # each block as if alone in its task
            parts[key] = trees._add(parts.get(key, []), found)
    got = {}
    for (_, chunk), found in parts.items():
        keys, sums = merge(found)
        size = min(16, n_slots - chunk * 16) + 1
        for k, s in zip(keys.tolist(), sums.T.tolist()):
            slot = -1 if k % size == size - 1 else chunk * 16 + k % size
            assert got.setdefault((k // size, slot), s) == s  # all chunks know the same totals
    assert got == want
    keys, sums = merge(held)
    assert {(k // 301, -1 if k % 301 == 300 else k % 301): s for k, s in zip(keys.tolist(), sums.T.tolist())} == want


def test_adding_blocks_costs_their_keys_not_all_that_is_held(monkeypatch):
    touched, merge = [], trees._merge
    monkeypatch.setattr(trees, "_merge", lambda parts: touched.append(sum(len(k) for k, _ in parts)) or merge(parts))
    held: list = []
    for i in range(512):
        held = trees._add(held, (np.arange(i * 10, i * 10 + 10), np.ones((3, 10), np.int64)))
    assert sum(touched) < 512 * 10 * 12  # pairwise into one sum: 512 * 10 * 256
    assert len(merge(held)[0]) == 5120


def test_logistic_looks_for_no_intervals(spark, monkeypatch):
    """The linear model reads numbers as they are, so no quantile of them is taken; trees still take theirs."""
    def refused(*_, **__):
        raise AssertionError("ranks were looked for")
    df = _frame(spark, _rows(300))
    expected = {r["feature"]: r["coefficient"] for r in linear.fit_logistic(ml.with_weights(df.drop("w"), "y"), features.learn(df, NUM, CAT), "y", "weight").collect()}
    monkeypatch.setattr(features, "values_at_ranks", refused)
    got = {r["feature"]: r["coefficient"] for r in ml.fit(df, "logistic", NUM, CAT, "y").table.collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-6 for k in got)
    with pytest.raises(AssertionError):
        ml.fit(df, "tree", NUM, CAT, "y")


def test_only_drawn_columns_and_values_are_counted():
    """A forest's task counts what a node may split by, and finds the same sums for it as a task that counts all."""
    rng = np.random.default_rng(6)
    p, offsets, spans = Params(columns="sqrt per node", rows="bootstrap"), [0, 8, 16], [(0, 8), (8, 16), (16, 20), (20, 420)]
    n_slots, active = 420, np.array([2, 3])
    tree = trees.Tree(3)
    tree.kind[1], tree.col[1], tree.code[1] = trees.VALUE, 2, 17
    drawn = trees._drawn(4, active, p, offsets, n_slots)
    every, some = trees._Sums(active, spans, n_slots, trees.ROOM), trees._Sums(active, spans, n_slots, trees.ROOM, drawn)
    for size in (700, 900):
        b = {"first": np.array([lo for lo, _ in spans]), "id": np.arange(size), "pairs": np.array([[0.0, 1.5], [1.0, 0.75]]), "pair": rng.integers(0, 2, size)}
        b |= {f"c{c}": np.where((rng.random(size) < 0.1) & (c > 1), -1, rng.integers(0, hi - lo, size)).astype(np.int16) for c, (lo, hi) in enumerate(spans)}
        for s in (every, some):
            columns, times = trees._columns(b), trees._times(b, 4, p)
            s.add(columns, tree.rows(columns, np.flatnonzero(times), 1), trees._gradients(b, p), times)
    full = dict(zip(every.found()[0].tolist(), every.found()[1].T.tolist()))
    got = dict(zip(some.found()[0].tolist(), some.found()[1].T.tolist()))
    assert all(full[k] == v for k, v in got.items()) and len(got) < len(full) / 4
    share = math.sqrt(406) / 406
    for j, node in enumerate(active.tolist()):
        for k in [k for k in full if k // 421 == j]:
            slot = k % 421
            feature = slot // 8 if slot < 16 else slot
            if slot == 420 or uniform(p.seed, 4, node, np.array([feature]))[0] < share:
                assert got[k] == full[k]


def test_sums_of_any_weights_and_of_two_kinds_agree():
    """Rows of two kinds are counted once for all three sums; hessians and counts share a long; both as sums by loops."""
    rng = np.random.default_rng(2)
    pair, rows, times = rng.integers(0, 2, 500), np.flatnonzero(rng.random(500) < 0.7), rng.integers(1, 5, 500)
    keys = rng.integers(0, 7, len(rows))
    units = np.array([[0, 3 * UNIT], [UNIT, UNIT // 3]])
    want = [[sum(int(v) for r, k in zip(rows, keys) if k == i for v in [w(r) * times[r]]) for i in range(7)] for w in (lambda r: units[pair[r]][0], lambda r: units[pair[r]][1], lambda r: 1)]
    assert trees._Weights((pair, units.tolist()), times, rows).sums(keys, 7).tolist() == want
    assert trees._Weights((units[pair][:, 0].astype(float), units[pair][:, 1].astype(float)), times, rows).sums(keys, 7).tolist() == want
    big = units[pair] * 2.0 ** 15  # too large to share a long
    found = trees._Weights((big[:, 0], big[:, 1]), times, rows).sums(keys, 7)
    assert found.tolist() == [[v * 2 ** 15 for v in want[0]], [v * 2 ** 15 for v in want[1]], want[2]]


def test_blocks_are_dealt_by_rows():
    place = trees._deal([(100, (0, i)) for i in range(9)] + [(30, (1, i)) for i in range(10)], 4)
    rows = [sum((100 if k[0] == 0 else 30) for k, v in place.items() if v == i) for i in range(4)]
    assert len(place) == 19 and max(rows) - min(rows) <= 30


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_same_trees_with_and_without_a_second_stage(spark, monkeypatch, few):
    monkeypatch.setattr(trees, "FEW_SUMS", few)
    monkeypatch.setattr(trees, "ROOM", 64)  # most columns by the keys that occur
    df = _frame(spark, _rows(300))
    f = features.learn(df, NUM, CAT)
    p = Params(trees=3, depth=3, boosting=True, rate=0.3, l2=1.0, rows=0.8, columns=0.8)
    got = sorted(tuple(r) for r in grow(df, f, "y", "w", p, refresh=2).drop("code", "feature_value").fillna("", ["column"]).fillna(-1.0, ["threshold"]).collect())
    monkeypatch.undo()
    assert got == sorted(tuple(r) for r in grow(df.repartition(2), f, "y", "w", p).drop("code", "feature_value").fillna("", ["column"]).fillna(-1.0, ["threshold"]).collect())


def test_intervals_of_nulls_and_nan():
    import pyarrow as pa
    x = pa.array([None, float("-inf"), 1.0, 1.5, 2.0, 9.0, float("nan")])
    assert features.intervals(x, np.array([1.0, 2.0])).tolist() == [0, 0, 0, 1, 1, 2, 2]
    assert features.intervals(x, np.array([])).tolist() == [0] * 7
