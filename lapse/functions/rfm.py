"""RFM scoring expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lapse.functions.util import col

# Segment labels by (R, F) score ranges. The labels are shown
# to users as they stand; nine are Russian, one is English. In order they name
# customers who sleep, are at risk, must not be lost, are about to leave, need
# attention, are loyal, promise more, are new, may become loyal, are champions.
SEGMENT_RULES = [
    ((1, 2), (1, 2), "Спящие"),
    ((1, 2), (3, 4), "В зоне риска"),
    ((1, 2), (5, 5), "Нельзя потерять"),
    ((3, 3), (1, 2), "На грани ухода"),
    ((3, 3), (3, 3), "Требуют внимания"),
    ((3, 4), (4, 5), "Лояльные клиенты"),
    ((4, 4), (1, 1), "Перспективные"),
    ((5, 5), (1, 1), "Новые клиенты"),
    ((4, 5), (2, 3), "Potential loyalists"),
    ((5, 5), (4, 5), "Чемпионы"),
]

# Value tiers by RFM_Score above a limit, highest first, as the
# condition chain takes the first that holds: platinum, gold, silver, bronze.
TIER_RULES = [
    (10, "Платина"),
    (9, "Золото"),
    (7, "Серебро"),
    (5, "Бронза"),
]
TIER_DEFAULT = "Стандарт"  # standard

SCORE_PROBS = [0.2, 0.4, 0.6, 0.8]


def score_by_cuts(x, cuts: list, ascending: bool = True) -> Column:
    """1..5 by the first cut point that ``x`` does not exceed (``<=``);
    ``ascending`` gives 1 for the lowest values (F, M), else 5 (R)."""
    x = col(x)
    n = len(cuts)
    expr = None
    for i, c in enumerate(cuts):
        val = (i + 1) if ascending else (n + 1 - i)
        expr = F.when(x <= col(c), val) if expr is None else expr.when(x <= col(c), val)
    return expr.otherwise(n + 1 if ascending else 1)


def rfm_segment_code(r, f, m) -> Column:
    """Concatenated score digits, e.g. '535' (B12)."""
    return F.concat(col(r).cast("string"), col(f).cast("string"), col(m).cast("string"))


def rfm_segment(r, f) -> Column:
    """Segment label from the R and F scores."""
    r, f = col(r), col(f)
    expr = None
    for (r0, r1), (f0, f1), label in SEGMENT_RULES:
        cond = r.between(r0, r1) & f.between(f0, f1)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


def value_tier(score) -> Column:
    """Tier label from RFM_Score."""
    s = col(score)
    expr = None
    for limit, label in TIER_RULES:
        expr = F.when(s > limit, label) if expr is None else expr.when(s > limit, label)
    return expr.otherwise(TIER_DEFAULT)
