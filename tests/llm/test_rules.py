"""Quality rules against a plain count of each text."""

import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lapse.llm.rules import COUNTS, RULES, STOP_WORDS, Rule, apply_rules

WORD = r"[^\x20\x09-\x0D]+"


def counts(t):
    t = t or ""
    w, lines = re.findall(WORD, t), [x for x in t.split("\n") if re.search(WORD, x)]
    seen, covered = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2)), set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i:i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    stop = {x for s in STOP_WORDS for x in (s, s[:1].upper() + s[1:])}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(covered),
            sum(x in stop for x in w), sum(not any(c.isalpha() for c in x) for x in w),
            sum(x.strip(" \t\n\x0b\x0c\r")[:1] in tuple("-*•") for x in lines),
            sum(x.rstrip(" \t\n\x0b\x0c\r").endswith(("...", "…")) for x in lines))


def broken(c):
    m = dict(zip(COUNTS, c))
    w, n = m["n_words"], m["n_lines"]
    limits = [w < 50, 100 * m["n_repeat_words"] > 50 * w, not 2 * w <= m["word_chars"] <= 12 * w, m["n_symbols"] > 0.1 * w, m["n_letterless"] > 0.3 * w,
              m["n_stop"] < 0.02 * w, 2 * m["n_dup_lines"] > n, m["n_bullet"] > 0.9 * n, m["n_ellipsis"] > 0.3 * n]
    return [r.name for r, hit in zip(RULES, limits) if hit]


EXTRA = [(900, "\n".join(["- the item of a list and more words here"] * 3 + [f"- word{i} of the list" for i in range(20)])),
         (901, "\n".join(f"the line number {chr(97 + i)} goes on…" for i in range(20))), (902, "| a | b |\n" * 30),
         (903, "the of and " * 20 + "x#*$%&|<> \U0001F600 é 12,3 --- ß " * 5), (904, "a b c"), (905, "a b"), (906, "x y x y x y x"),
         (907, "\n \n\nthe one\r\nthe one\n the one\nthe one"), (908, "same " * 200), (909, " ".join(f"Und w{i}" for i in range(80)))]


def test_rules_match_brute_force(spark, rows, docs):
    more = docs.sparkSession.createDataFrame(EXTRA, "doc_id long, text string")
    df = docs.unionByName(more, allowMissingColumns=True)
    out = apply_rules(df, "doc_id", carry=["score", "source"])
    assert out.columns == ["doc_id", "score", "source", *COUNTS, "failed", "base_failed", "kept"]
    want = Counter()
    for i, t in [(r[0], r[1]) for r in rows] + EXTRA:
        c = counts(t)
        want[(i, *c, tuple(broken(c)), bool(set(broken(c)) & {"too few words", "repeated words"}), not broken(c))] += 1
    got = Counter((r["doc_id"], *[r[c] for c in COUNTS], tuple(r["failed"]), r["base_failed"], r["kept"]) for r in out.collect())
    assert got == want
    assert len({n for k in want for n in k[-3]}) == len(RULES)  # each rule is broken by some text


def test_rules_of_ones_own_and_clashes(spark, docs, empty):
    own = (Rule("long", "n_words", most=2),)
    df = spark.createDataFrame([(1, "a b c", 5), (2, "a", 6), (3, None, 7)], "doc_id long, text string, kept int")
    assert {(r["doc_id"], tuple(r["failed"]), r["kept"]) for r in apply_rules(df, "doc_id", rules=own, base=()).collect()} == {(1, ("long",), False), (2, (), True), (3, (), True)}
    assert apply_rules(df, "doc_id", rules=(), base=()).where("kept").count() == 3
    with pytest.raises(ValueError, match="kept"):
        apply_rules(df, "doc_id", carry=["kept"])
    assert apply_rules(empty, "doc_id").count() == 0


def test_rules_need_no_shuffle_and_no_python(docs):
    plan = apply_rules(docs, "doc_id")._jdf.queryExecution().toString()
    body = plan.split("== Physical Plan ==")[1]
    assert "Python" not in body and "Arrow" not in body and "Sort " not in body


def test_rules_on_a_very_long_text(spark):
    """Half a million words that all repeat: sorting windows, no comparison of all places."""
    df = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("the same three words again and again in lines\n"), 55_000).alias("text"))
    at = time.time()
    r = apply_rules(df, "doc_id").first()
    assert (r["n_words"], r["n_repeat_words"], r["n_dup_lines"]) == (495_000, 495_000, 54_999) and time.time() - at < 60
