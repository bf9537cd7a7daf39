"""Near-duplicate labels (D12): for each distinct label, up to ``n`` labels
(itself included) whose Ratcliff-Obershelp ratio is at least ``cutoff``.

Candidate pairs come from a set-similarity self-join with prefix filtering
(Vernica, Carey, Li: "Efficient parallel set-similarity joins using
MapReduce", SIGMOD 2010), never from all pairs:

* each label is a multiset of characters, written as tokens ``c#k`` (k-th
  occurrence of character c); tokens are ordered globally rare-first;
* a ratio ≥ t needs a multiset overlap M ≥ t·(|a|+|b|)/2, hence
  |b| ≥ t·|a|/(2−t) and M ≥ α(a) = ⌈t·|a|/(2−t)⌉; two labels that qualify
  must share a token among the first |a|−α(a)+1 tokens of a and of b;
* candidates sharing a prefix token are verified: length bound, then the
  exact ratio (``difflib``, candidate first, as the reference calls it) in
  a vectorised UDF on the candidate pairs only.

The result is exact: every pair with ratio ≥ t survives the filters.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lapse.session import materialize, ship_by_value

ship_by_value(__name__)


@F.pandas_udf(DoubleType())
def sequence_ratio(candidate: pd.Series, word: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of (candidate, word)."""
    sm = difflib.SequenceMatcher(None)
    out = []
    for a, b in zip(candidate, word):
        sm.set_seqs(a, b)
        out.append(sm.ratio())
    return pd.Series(out, dtype="float64")


def _labels(df: DataFrame, c: str) -> DataFrame:
    return df.select(F.col(c).cast("string").alias("label")).where(F.col("label").isNotNull()).distinct()


def _tokens(labels: DataFrame) -> DataFrame:
    """(label, token) for every character occurrence: ``c#k``."""
    chars = labels.select("label", F.posexplode(F.split("label", "")).alias("_pos", "_ch")).where(F.col("_ch") != "")
    w = Window.partitionBy("label", "_ch").orderBy("_pos")
    return chars.select("label", F.concat("_ch", F.lit("#"), F.row_number().over(w).cast("string")).alias("token"))


def _prefixes(labels: DataFrame, required_overlap) -> DataFrame:
    """Prefix tokens of every label under the global rare-first order;
    ``required_overlap(len)`` is a Column giving α for a label of that length."""
    toks = _tokens(labels)
    freq = toks.groupBy("token").agg(F.count("*").alias("_df"))
    t = toks.join(freq, "token")
    w = Window.partitionBy("label").orderBy("_df", "token")
    ranked = t.withColumn("_r", F.row_number().over(w)).withColumn("_len", F.length("label"))
    return ranked.where(F.col("_r") <= F.col("_len") - required_overlap(F.col("_len")) + 1).select("label", "token")


def _candidates(labels: DataFrame, required_overlap) -> DataFrame:
    p = _prefixes(labels, required_overlap)
    a = p.select(F.col("label").alias("word"), "token")
    b = p.select(F.col("label").alias("candidate"), "token")
    return a.join(b, "token").select("word", "candidate").distinct()


def close_labels(df: DataFrame, c: str, cutoff: float = 0.8, n: int = 3) -> DataFrame:
    """``(word, candidate, ratio, rank)``: the ``n`` best labels with ratio ≥
    ``cutoff`` for each distinct label (itself included, ratio 1.0), ties
    broken by the larger candidate text, as the reference's selection."""
    labels = _labels(df, c)
    t = float(cutoff)

    def alpha(length):
        return F.ceil(F.lit(t) * length / F.lit(2.0 - t) - F.lit(1e-9)).cast("int")
    cand = _candidates(labels, alpha)
    # the empty label has no character to share, but is its own neighbour
    empty = labels.where("label = ''").select(F.col("label").alias("word"), F.col("label").alias("candidate"))
    cand = cand.union(empty)
    lw, lc = F.length("word"), F.length("candidate")
    cand = cand.where((lc >= F.lit(t / (2 - t)) * lw - 1e-9) & (lw >= F.lit(t / (2 - t)) * lc - 1e-9))
    scored = cand.withColumn("ratio", sequence_ratio("candidate", "word")).where(F.col("ratio") >= t)
    w = Window.partitionBy("word").orderBy(F.desc("ratio"), F.desc("candidate"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def labels_with_neighbours(matches: DataFrame) -> DataFrame:
    """Words with more than one close label (the reference prints these)."""
    return (matches.groupBy("word").agg(F.count("*").alias("matches"))
            .where(F.col("matches") > 1))


def deletions(label, k: int):
    """All distinct texts that up to ``k`` deletions leave of a label, itself included (an array; sum of C(length, i) texts)."""
    cut = lambda s: F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))),
                                                        lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))).otherwise(F.array().cast("array<string>"))
    level = [F.array(label)]
    for _ in range(k):
        level.append(F.array_distinct(F.flatten(F.transform(level[-1], cut))))
    return F.array_distinct(F.concat(*level))


def close_labels_levenshtein(df: DataFrame, c: str, max_distance: int = 2) -> DataFrame:
    """``(word, candidate, distance)`` for labels within ``max_distance``
    edits (itself included).

    Deletion neighbourhood (Bocek, Hunt, Stiller: "Fast similarity search in
    large dictionaries", 2007): two labels within k edits have a text in common
    that at most k deletions leave of each. Labels meet on such texts alone,
    which only labels within 2 k edits of each other share, and are verified.
    A label of length L emits about L^k / k! texts, so this is for labels, not
    for long text."""
    labels = _labels(df, c)
    k = int(max_distance)
    left = materialize(labels.select(F.col("label").alias("word"), F.explode(deletions(F.col("label"), k)).alias("text")), "label_deletions")
    pairs = left.join(left.select(F.col("word").alias("candidate"), F.col("text").alias("_t")), F.col("text") == F.col("_t"))
    pairs = pairs.where(F.abs(F.length("word") - F.length("candidate")) <= k).select("word", "candidate").distinct()
    return pairs.withColumn("distance", F.levenshtein("word", "candidate")).where(F.col("distance") <= k)
