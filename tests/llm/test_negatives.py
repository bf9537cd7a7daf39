"""Hard negatives against all pairs in plain Python, and the sorted stream on random keys."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapse.llm.negatives import first_rows, hard_negatives, mine, pack, unpack

OUT = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows, step, positives=5, negatives=10, low=30, high=90):
    ok = {}
    for i, v, c in rows:
        if i is None or v is None or c is None or not all(x is not None and np.isfinite(x) for x in v):
            continue
        r = (c, [int(np.floor(256 * float(np.float32(x)))) for x in v])
        ok[i] = min(ok.get(i, r), r)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = Counter()
    for a in [i for i in ok if i % step == 0]:
        scored = sorted((-dot(ok[a][1], v), i, c) for i, (c, v) in ok.items() if i != a)
        for p, pi in [(-s, i) for s, i, c in scored if c == ok[a][0]][:positives]:
            fit = [(-s, i) for s, i, c in scored if c != ok[a][0] and low * p <= 100 * -s <= high * p][:negatives]
            out.update((a, pi, r, i, p, s) for r, (s, i) in enumerate(fit, 1))
    return out


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.withColumns({c: F.lit(3) for c in ("id", "x", "anchor", "scores", "blk", "grp", "score", "kind", "rank")})


def got(df):
    return Counter(tuple(r) for r in df.select(*OUT).collect())


def sample(rng):
    rows = [(i, rng.normal(size=6).tolist(), int(rng.integers(4))) for i in range(300)]
    rows += [(i, rows[3][1], i % 3) for i in range(300, 420)]  # one vector for a third of the rows: ties in both classes
    rows += [(500, None, 1), (510, [None] + [0.5] * 5, 1), (520, [float("nan")] * 6, 1), (530, [float("inf")] * 6, 2), (None, [0.1] * 6, 1), (540, [0.5] * 6, None),
             (550, [0.3, -0.2], 1), (560, [], 2), (570, [0.0] * 6, 1), (580, rows[5][1], 0), (580, rows[5][1], 0), (580, rows[8][1], 3), (-20, rows[4][1], 1)]
    return rows


def test_negatives_match_all_pairs(spark):
    rows = sample(np.random.default_rng(4))
    df = table(spark, rows).repartition(4)
    want = brute(rows, 10)
    assert len(want) > 500
    assert got(hard_negatives(df, "vec_id % 10 = 0", "vec_id", "embedding", "label", group_rows=7, block_rows=50)) == want
    assert got(hard_negatives(df, F.col("vec_id") % 10 == 0, "vec_id", "embedding", "label")) == want
    assert got(hard_negatives(df, "vec_id % 10 = 0", "vec_id", "embedding", "label", positives=2, negatives=3, low=10, high=50, block_rows=64)) == brute(rows, 10, 2, 3, 10, 50)


def test_negatives_zero_scores(spark):
    """A positive of score 0 has the rows of score 0 in its window, also those of smaller id."""
    rows = [(10, [1.0, 0.0], 1), (20, [0.0, 1.0], 1), (11, [0.0, 2.0], 2), (30, [0.0, 3.0], 2), (7, [-1.0, 0.0], 1), (8, [-1.0, 0.0], 2)]
    want = brute(rows, 10)
    assert (10, 20, 1, 11, 0, 0) in want
    assert got(hard_negatives(table(spark, rows), "vec_id % 10 = 0", "vec_id", "embedding", "label")) == want


def test_negatives_large_numbers(spark):
    """Scores beyond 2^53 are exact; huge vectors that no pair needs do no harm; what does not fit in a long raises."""
    big = [(10, [3e5, 3e5], 1), (11, [2e5, 3e5], 1), (12, [1e5, 2e5], 2), (13, [1e5, 2.0000002e5], 2), (14, [-1e30, -1e30], 1), (15, [-1e38, 0.0], 2)]
    assert got(hard_negatives(table(spark, big), "vec_id = 10", "vec_id", "embedding", "label")) == brute(big[:-1], 10) != Counter()
    too = big + [(16, [1e30, 1.0], 1)]
    with pytest.raises(Exception, match="does not fit in a long"):
        hard_negatives(table(spark, too), "vec_id = 10", "vec_id", "embedding", "label").collect()


def test_negatives_of_few_rows(spark):
    for rows in ([], [(10, [1.0], 1)], [(10, [1.0], 1), (11, [1.0], 1)], [(10, [1.0], 1), (11, [0.5], 2)], [(1, [1.0], 1)]):
        assert hard_negatives(table(spark, rows), "vec_id % 10 = 0", "vec_id", "embedding", "label").count() == 0
    with pytest.raises(ValueError):
        hard_negatives(table(spark, []), "true", "vec_id", "embedding", "label", low=50, high=120)


def test_keys_sort_as_pairs():
    rng = random.Random(1)
    edge = [-2 ** 63, -5, -1, 0, 1, 2, 2 ** 63 - 1]
    pairs = [(rng.choice(edge), rng.choice([0, 1, 7, 2 ** 63 - 1]), rng.randrange(2), rng.choice(edge)) for _ in range(500)]
    assert [unpack(k) for k in sorted(pack(*p) for p in pairs)] == sorted(pairs, key=lambda p: (p[0], -p[1], p[2], p[3]))
    with pytest.raises(OverflowError):
        pack(1, 2 ** 63, 0, 2)


def test_stream_reads_once_and_keeps_counters_only():
    """The stream is consumed lazily: results come out before the anchor's last pair is read."""
    read = []

    def keys():
        for p in [(1, 100, 0, 5), *[(1, 80 - i // 50, 1, 100 + i) for i in range(1000)], (2, 9, 0, 3), (2, 8, 1, 4)]:
            read.append(p)
            yield pack(*p), None
    out = mine(keys(), 5, 10, 30, 90)
    assert next(out) == (1, 5, 1, 100, 100, 80) and len(read) == 2
    assert list(out)[-1] == (2, 3, 1, 4, 9, 8)


def test_first_rows():
    rng = np.random.default_rng(3)
    for _ in range(200):
        s, among, n = rng.integers(0, 6, 40), rng.random(40) < 0.6, int(rng.integers(1, 12))
        assert first_rows(s, among, n).tolist() == sorted(np.flatnonzero(among).tolist(), key=lambda i: (-s[i], i))[:n]
