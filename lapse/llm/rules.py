"""Quality rules: a threshold table over length, symbol, stop-word, line and repetition ratios.

The measures of a text are row expressions (no shuffle, no user function):
words come from one ``split``; repeated word windows from sorting the hashes
of all windows of the text together with their places, so that equal windows
lie side by side, which is n log n however often a passage repeats. The table
of rules (:data:`RULES`) is compiled to one projection that names the rules a
text breaks.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapse.llm.common import WORD


class Rule(NamedTuple):
    """A text breaks the rule if its measure lies below ``least`` or above ``most`` (None: no limit on that side)."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: Base rules: both are exact comparisons of whole numbers (see :func:`_broken`).
BASE = (Rule("too few words", "n_words", least=50), Rule("repeated words", "repeat_ratio", most=0.5))
RULES = BASE + (
    Rule("word length", "mean_word_length", least=2, most=12),
    Rule("symbols", "symbol_ratio", most=0.1),
    Rule("words without a letter", "letterless_ratio", most=0.3),
    Rule("stop words", "stop_ratio", least=0.02),
    Rule("repeated lines", "dup_line_ratio", most=0.5),
    Rule("list lines", "bullet_ratio", most=0.9),
    Rule("cut lines", "ellipsis_ratio", most=0.3),
)

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = tuple(dict.fromkeys((
    "the of and to a in is that it for on was with be this as by at are from or an not have he we they you but his had "
    "der die und das den von zu mit sich auf für ist im nicht dem ein eine als auch es an werden aus er hat dass sie "
    "de la le et les des en un du une que est pour dans qui au sur pas par avec il ce plus sont "
    "el y los se del las por con no una su para al lo como más o pero sus").split()))

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
BULLET = r"^[\x20\x09-\x0D]*[-*•]"
ELLIPSIS = r"(\.\.\.|…)[\x20\x09-\x0D]*$"
LETTERLESS = r"(?<![^\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]++(?![^\x20\x09-\x0D])"

#: Whole-number counts, and the ratios made of them (part, whole).
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop", "n_letterless", "n_bullet", "n_ellipsis")
RATIOS = {"mean_word_length": ("word_chars", "n_words"), "symbol_ratio": ("n_symbols", "n_words"), "stop_ratio": ("n_stop", "n_words"),
          "letterless_ratio": ("n_letterless", "n_words"), "repeat_ratio": ("n_repeat_words", "n_words"),
          "dup_line_ratio": ("n_dup_lines", "n_lines"), "bullet_ratio": ("n_bullet", "n_lines"), "ellipsis_ratio": ("n_ellipsis", "n_lines")}


def _matching(items: Column, pattern: str) -> Column:
    return F.size(F.filter(items, lambda x: x.rlike(pattern)))


def _sorted_windows(words: Column, width: int) -> Column:
    """(hash, place) of all windows, equal windows side by side."""
    last = F.size(words) - width
    window = lambda i: F.struct(F.xxhash64(*[F.get(words, i + j) for j in range(width)]).alias("h"), i.alias("i"))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    return F.sort_array(F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), window)).otherwise(none))


def _covered(places: Column, width: int) -> Column:
    """Words that lie in one of the windows at these places (ascending)."""
    start = F.struct(F.lit(-width).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(width), p - a["last"])).alias("n"))
    return F.aggregate(places, start, step, lambda a: a["n"])


def measures(docs: DataFrame, text: str, keep: Iterable[str], stop_words: Iterable[str] = STOP_WORDS, width: int = 3) -> DataFrame:
    """The columns ``keep`` and a struct ``m`` of all counts of the text."""
    both_cases = [w for s in stop_words for w in {s, s[:1].upper() + s[1:]}]
    # every stage is one Project; what later expressions read more than once is a column
    df = docs.select(*[F.col(c) for c in keep], F.coalesce(F.col(text), F.lit("")).alias("_t"))
    df = df.withColumns({"_w": F.array_remove(F.split("_t", r"[\x20\x09-\x0D]+"), ""),
                         "_l": F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD))})
    df = df.withColumn("_s", _sorted_windows(F.col("_w"), width))
    near = lambda j: F.get(F.col("_s"), j)["h"]
    twice = F.filter("_s", lambda x, j: F.coalesce(x["h"] == near(j - 1), F.lit(False)) | F.coalesce(x["h"] == near(j + 1), F.lit(False)))
    df = df.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    m = {
        "n_words": F.size("_w"), "word_chars": F.length(F.translate("_t", SPACE, "")),
        "n_symbols": F.length("_t") - F.length(F.translate("_t", SYMBOLS, "")),
        "n_lines": F.size("_l"), "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": _covered(F.col("_p"), width),
        "n_stop": F.size(F.filter("_w", lambda x: x.isin(both_cases))),
        "n_letterless": F.regexp_count("_t", F.lit(LETTERLESS)),
        "n_bullet": _matching(F.col("_l"), BULLET), "n_ellipsis": _matching(F.col("_l"), ELLIPSIS),
    }
    return df.select(*[F.col(c) for c in keep], F.struct(*[m[c].cast("long").alias(c) for c in COUNTS]).alias("m"))


def _broken(rule: Rule) -> Column:
    """Whether the counts in ``m`` break the rule: part against limit times whole, no division (a text of no words has no ratio)."""
    part, whole = RATIOS.get(rule.measure, (rule.measure, None))
    part, whole = F.col("m")[part], F.lit(1) if whole is None else F.col("m")[whole]
    side = [part < F.lit(float(rule.least)) * whole] if rule.least is not None else []
    side += [part > F.lit(float(rule.most)) * whole] if rule.most is not None else []
    out = side[0]
    for s in side[1:]:
        out = out | s
    return out


def apply_rules(docs: DataFrame, key: str, text: str = "text", rules: Iterable[Rule] = RULES, base: Iterable[Rule] = BASE,
                stop_words: Iterable[str] = STOP_WORDS, carry: Iterable[str] = ()) -> DataFrame:
    """The key, ``carry``, all counts, ``failed`` (names of the broken rules, in table order), ``base_failed`` and ``kept`` (no rule is broken).

    Words are maximal runs of what is not ASCII white space; lines are what
    ``\\n`` parts, and count only if they hold a word. ``n_dup_lines`` counts
    lines equal to an earlier line, ``n_repeat_words`` words in windows of
    three words that the text holds twice or more, the first included. Two
    different windows are taken for one if their 64-bit hashes agree (for a
    text of a million words once in some 3e7 such texts).

    Null and empty texts have no words: every count is 0, they break the rule
    on length and are not kept. Null keys are kept as such. Every input row
    gives one row, repeated rows too; an empty table gives no rows. Other
    columns are not read, so their names clash with nothing; a ``carry`` column
    named like an output raises.
    """
    carry, rules = list(carry), list(rules)
    out = (*COUNTS, "failed", "base_failed", "kept")
    if clash := {key, *carry} & set(out):
        raise ValueError(f"columns named like outputs: {sorted(clash)}")
    boxes = docs.select(F.struct(*[F.col(f"`{c}`") for c in (key, *carry)]).alias("_box"), F.col(f"`{text}`").alias("_text"))
    m = measures(boxes, "_text", ["_box"], stop_words)
    names = F.array_compact(F.array(*[F.when(_broken(r), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
    base_failed = F.lit(False)
    for r in base:
        base_failed = base_failed | _broken(r)
    verdict = m.select("_box", "m", names.alias("failed"), base_failed.alias("base_failed"))
    return verdict.select(*[F.col("_box")[c].alias(c) for c in (key, *carry)], "m.*", "failed", "base_failed",
                          (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"))
