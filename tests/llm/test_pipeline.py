"""The corpus pipeline against a brute-force version of its stages, and on awkward and empty tables."""

import random
from collections import Counter, defaultdict

import pytest

from tests.llm.conftest import frame, messy_rows, sentence
from tests.llm.test_operators import components_brute, contamination_brute, fingerprint_brute, targets_brute, words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def write(spark, folder, docs, labels, items):
    frame(spark, docs).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(3)
    rows, labels, toxic = messy_rows(), [], set()
    for i in range(1000, 1500):
        w = sentence(rng, rng.randrange(30, 120)).split()
        if i % 5 == 0:
            toxic.add(i)
            for _ in range(5):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron", "scum"]))
        rows.append((i, " ".join(w), "en", f"s{i % 4}", 5))
        labels.append((i, 1, int(i in toxic)))
    items = [(1, sentence(rng, 30)), (2, sentence(rng, 20)), (3, None)]
    rows += [(2000, sentence(rng, 50) + " " + items[0][1], "en", "s1", 4), (2001, sentence(rng, 3000) + " " + items[1][1], "en", "s1", 4)]
    return write(spark, tmp_path_factory.mktemp("corpus"), rows, labels, items), rows, toxic, items


def test_stages_match_brute_force(spark, corpus):
    import corpus_pipeline as cp
    from lapse.llm.common import stored, table
    folder, rows, toxic, items = corpus
    seen, docs = [], table(spark, folder, "documents")
    for name, stage in cp.STAGES:
        docs = stored(stage(spark, docs, folder), name)
        seen.append(docs)
    assert all(d.columns == frame(spark, []).columns for d in seen[:-1])
    take = lambda d: [tuple(r) for r in d.select(*COLUMNS).collect()]

    clean = [r for r in rows if r[0] not in toxic]
    assert Counter(take(seen[0])) == Counter(clean)

    groups = defaultdict(list)
    for r, c in zip(clean, components_brute([fingerprint_brute(r[1]) for r in clean], 2)):
        groups[c].append(r)
    single = take(seen[1])
    assert Counter(r[0] for r in single) == Counter(min((r[0] for r in g if r[0] is not None), default=None) for g in groups.values())
    assert not Counter(single) - Counter(clean)

    def kept(r):
        n, hit, _ = contamination_brute(r[1], items)
        return not (hit > 0 and 20 * hit >= n)
    assert Counter(take(seen[2])) == Counter(r for r in single if kept(r))
    assert 2000 not in {r[0] for r in take(seen[2])} and 2001 in {r[0] for r in take(seen[2])}

    sizes, mixed = Counter(), Counter()
    for r in take(seen[2]):
        sizes[r[3]] += len(words(r[1]))
    for r in take(seen[3]):
        mixed[r[3]] += len(words(r[1]))
    assert all(abs(mixed[s] - t) <= 64 for s, t in targets_brute(sizes).items())
    most = {r[0]: len(words(r[1])) for r in take(seen[2])}
    times = Counter()
    for r in take(seen[3]):
        times[r[0]] += len(words(r[1]))
    assert all(times[i] <= 3 * most[i] for i in times)

    assert Counter(take(seen[4])) == Counter(take(seen[3]))
    slots = defaultdict(list)
    for r in seen[4].select("shard", "slot").collect():
        slots[int(r["shard"])].append(r["slot"])
    assert len(slots) == 24 and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_agrees_with_itself(spark, corpus):
    import corpus_pipeline as cp
    folder = corpus[0]
    a, b = (Counter(tuple(r) for r in cp.run(spark, folder).select("doc_id", "n_chars", "shard", "slot").collect()) for _ in range(2))
    assert a == b


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline as cp
    assert cp.run(spark, write(spark, tmp_path, [], [], [])).count() == 0


@pytest.mark.parametrize("marks", [[], "null", "positive", "negative", "held out", "absent", "two"])
def test_toxicity_stage_keeps_all_without_evidence(spark, tmp_path, marks):
    import zlib

    import corpus_pipeline as cp
    from lapse.llm.common import table
    rng = random.Random(8)
    rows = [(i, sentence(rng, 30), "en", "a", 1) for i in range(40)] + [(None, None, None, None, None), (41, "", "en", "a", 0)]
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 == 2]
    learnt = [i for i in range(40) if i not in held]
    labels = {"null": [(i, 1, None) for i in range(40)], "positive": [(i, 1, 1) for i in learnt], "negative": [(learnt[0], 1, 0)],
              "held out": [(i, 1, i % 2) for i in held], "absent": [(1000 + i, 1, i % 2) for i in range(40)],
              "two": [(learnt[0], 1, 0), (learnt[1], 1, 1)]}[marks] if marks else []
    folder = write(spark, tmp_path, rows, labels, [])
    kept = cp.toxic_out(spark, table(spark, folder, "documents"), folder)
    assert Counter(tuple(r) for r in kept.select(*COLUMNS).collect()) == Counter(rows)


def test_run_without_labels_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline as cp
    rng = random.Random(9)
    rows = [(i, sentence(rng, 60), "en", "a", 1) for i in range(20)]
    assert cp.run(spark, write(spark, tmp_path, rows, [], [])).count() > 0
