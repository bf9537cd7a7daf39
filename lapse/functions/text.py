"""Label normalisation."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from lapse.functions.util import col

# Category corrections applied after normalisation.
CATEGORY_CORRECTIONS = {
    "home_confort": "home_comfort",
    "home_appliances_2": "home_appliances",
}


def normalize_label(c) -> Column:
    """Trim and lower-case."""
    return F.lower(F.trim(col(c)))


def correct_labels(c, mapping: dict[str, str] | None = None) -> Column:
    """Replace whole values found in ``mapping`` (B10); others pass through.

    The mapping is a literal map expression (evaluated in generated code);
    for a mapping that grows with the data, join a mapping table instead.
    """
    mapping = CATEGORY_CORRECTIONS if mapping is None else mapping
    if not mapping:
        return col(c)
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.coalesce(F.element_at(m, col(c)), col(c))
