"""Registered queries: near-duplicate category labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapse.operators import fuzzy as fz
from lapse.plans import fact as fx
from lapse.plans.registry import register, with_ctes
from lapse.sources.roles import Roles

LEV_K = 2


def category_labels(spark, sf_dir):
    r = Roles(spark, sf_dir)
    return fx.translate_categories(r.products(), r.translation()).select("product_category_name")


@register("close_labels_ratio")
def q_close_labels_ratio(spark, sf_dir):
    """Up to 3 labels with ratio ≥ 0.8 per category (rows-only; the tests
    compare with the standard library's own selection)."""
    m = fz.close_labels(category_labels(spark, sf_dir), "product_category_name", 0.8, 3)
    return m.select("word", "candidate", F.round("ratio", 6).alias("ratio"), "rank")


@register("close_labels_lev", with_ctes(
    [("lab", "SELECT DISTINCT product_category_name AS label FROM (SELECT CASE lower(trim(t.product_category_name_english)) "
             "WHEN 'home_confort' THEN 'home_comfort' WHEN 'home_appliances_2' THEN 'home_appliances' "
             "ELSE lower(trim(t.product_category_name_english)) END AS product_category_name FROM r_products p "
             "LEFT JOIN r_translation t ON p.product_category_name = t.product_category_name) WHERE product_category_name IS NOT NULL")],
    f"SELECT a.label AS word, b.label AS candidate, CAST(levenshtein(a.label, b.label) AS INTEGER) AS distance "
    f"FROM lab a, lab b WHERE levenshtein(a.label, b.label) <= {LEV_K}", roles=["r_products", "r_translation"]))
def q_close_labels_lev(spark, sf_dir):
    return fz.close_labels_levenshtein(category_labels(spark, sf_dir), "product_category_name", LEV_K)
