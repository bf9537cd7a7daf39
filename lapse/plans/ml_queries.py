"""Registered queries: splits, weights, metrics on a closed-form score, and the four trained models."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lapse.operators import linear
from lapse.operators import metrics as mt
from lapse.operators import ml
from lapse.plans.memo import fingerprint, memo
from lapse.plans.registry import ORACLE, register
from lapse.session import checkpoint_dir, materialize
from lapse.operators.split import split_key
from lapse.plans.report_queries import MI_COLS, app_model_input, mi_sql

R6 = 6
# Fixed parameters: a closed-form score in [0, 1] from the RFM score, so
# that the metric operators can be checked against SQL.
SCORE_EXPR = "(RFM_Score - 3) / 12.0"
THRESHOLD = 0.5


def scored_input(spark, sf_dir, once=False):
    """Customers' labels, scores and predictions; ``once`` for a query that reads them a single time."""
    mi = app_model_input(spark, sf_dir, ["customer_unique_id", "is_churned", "RFM_Score"] if once else None)
    return mi.select("customer_unique_id", F.col("is_churned").alias("label"),
                     F.expr(SCORE_EXPR).alias("score")).withColumn(
        "prediction", (F.col("score") >= THRESHOLD).cast("int"))


SC_CTE = ("sc", f"SELECT customer_unique_id, is_churned AS label, {SCORE_EXPR} AS score, "
                f"CAST({SCORE_EXPR} >= {THRESHOLD} AS INTEGER) AS prediction FROM mi")
CONF_CTE = ("cf", "SELECT count_if(label = 1 AND prediction = 1) AS tp, count_if(label = 0 AND prediction = 0) AS tn, "
                  "count_if(label = 0 AND prediction = 1) AS fp, count_if(label = 1 AND prediction = 0) AS fn FROM sc")


def sc_sql(final, extra=None):
    return mi_sql(final, [SC_CTE, CONF_CTE] + (extra or []))


def _div(a, b):
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0.0)"


@register("confusion", sc_sql("SELECT CAST(tp AS BIGINT) AS tp, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn FROM cf"))
def q_confusion(spark, sf_dir):
    return mt.confusion(scored_input(spark, sf_dir, once=True))


@register("classification_metrics", sc_sql(
    f"SELECT round({_div('tn', 'tn + fp')}, 6) AS specificity, round({_div('tp', 'tp + fn')}, 6) AS sensitivity, "
    f"round({_div('tp', 'tp + fp')}, 6) AS precision, round({_div('2 * tp', '2 * tp + fp + fn')}, 6) AS f1, "
    f"round({_div('tp + tn', 'tp + tn + fp + fn')}, 6) AS accuracy, CAST(tp AS BIGINT) AS tp, CAST(tn AS BIGINT) AS tn, "
    f"CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn FROM cf"))
def q_classification_metrics(spark, sf_dir):
    m = mt.classification_metrics(scored_input(spark, sf_dir))
    return m.select(*[F.round(c, R6).alias(c) for c in ("specificity", "sensitivity", "precision", "f1", "accuracy")],
                    "tp", "tn", "fp", "fn")


@register("class_report", sc_sql(
    "SELECT t.class, round(" + _div("t.hit", "coalesce(p.predicted, 0)") + ", 6) AS precision, round(" + _div("t.hit", "t.support") + ", 6) AS recall, "
    "round(" + _div("2 * t.hit", "t.support + coalesce(p.predicted, 0)") + ", 6) AS f1, CAST(t.support AS BIGINT) AS support "
    "FROM (SELECT label AS class, count(*) AS support, count_if(label = prediction) AS hit FROM sc GROUP BY label) t "
    "LEFT JOIN (SELECT prediction AS class, count(*) AS predicted FROM sc GROUP BY prediction) p ON t.class = p.class"))
def q_class_report(spark, sf_dir):
    r = mt.class_report(scored_input(spark, sf_dir))
    return r.select("class", *[F.round(c, R6).alias(c) for c in ("precision", "recall", "f1")], "support")


ST_CTES = [("st", "SELECT score, count_if(label = 1) AS pos, count_if(label = 0) AS neg FROM sc GROUP BY score")]


@register("roc_auc", sc_sql(
    "SELECT round(sum(pos * (neg_below + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM "
    "(SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM st)",
    ST_CTES))
def q_roc_auc(spark, sf_dir):
    return mt.roc_auc(scored_input(spark, sf_dir, once=True)).select(F.round("roc_auc", R6).alias("roc_auc"))


@register("roc_points", sc_sql(
    "SELECT threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM ("
    "SELECT score AS threshold, sum(neg) OVER (ORDER BY score DESC) / sum(neg) OVER () AS fpr, "
    "sum(pos) OVER (ORDER BY score DESC) / sum(pos) OVER () AS tpr FROM st "
    "UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0, 0.0)", ST_CTES))
def q_roc_points(spark, sf_dir):
    p = mt.roc_points(scored_input(spark, sf_dir, once=True))
    return p.select("threshold", F.round("fpr", R6).alias("fpr"), F.round("tpr", R6).alias("tpr"))


@register("class_weights", mi_sql(
    "SELECT is_churned, CAST(n_c AS BIGINT) AS n_c, round(n * 1.0 / (k * n_c), 6) AS balanced_weight, round(n0 * 1.0 / n1, 6) AS pos_weight FROM "
    "(SELECT is_churned, count(*) AS n_c FROM mi GROUP BY is_churned), "
    "(SELECT count(*) AS n, count(DISTINCT is_churned) AS k, count_if(is_churned = 0) AS n0, count_if(is_churned = 1) AS n1 FROM mi)"))
def q_class_weights(spark, sf_dir):
    w = ml.class_weights(app_model_input(spark, sf_dir))
    return w.select("is_churned", "n_c", F.round("balanced_weight", R6).alias("balanced_weight"),
                    F.round("pos_weight", R6).alias("pos_weight"))


_REAL = ("payment_value", "price", "approval_delay")
_KEY_TEXT = ", ".join(f"coalesce(CAST({f'CAST({c} AS DECIMAL(38,6))' if c in _REAL else c} AS VARCHAR), chr(92))" for c in MI_COLS)
# rows of mi with is_test: the first round(0.3 n) of each class by md5, rows of one md5 on the same side
SPLIT_CTES = [
    ("hashed", f"SELECT *, md5(concat_ws('|', '{ml.SEED}', {_KEY_TEXT})) AS h FROM mi"),
    ("placed", "SELECT is_churned AS y, h, row_number() OVER (PARTITION BY is_churned ORDER BY h) AS r, count(*) OVER (PARTITION BY is_churned) AS n FROM hashed"),
    ("cut", "SELECT y, max(h) AS c FROM placed WHERE r <= round(0.3 * n) GROUP BY y"),
    ("sp", "SELECT hashed.*, coalesce(h <= c, false) AS is_test FROM hashed LEFT JOIN cut ON is_churned = y"),
]


@register("stratified_split", mi_sql(
    "SELECT customer_unique_id, is_churned, is_test, CAST(count(*) AS BIGINT) AS n_rows, min(h) AS first_hash FROM sp GROUP BY ALL", SPLIT_CTES))
def q_stratified_split(spark, sf_dir):
    """Rows of every customer on each side."""
    mi = app_model_input(spark, sf_dir)
    s = ml.stratified_split(mi)
    return (s.withColumn("h", split_key(mi, mi.columns, ml.SEED)).groupBy("customer_unique_id", "is_churned", "is_test")
            .agg(F.count("*").alias("n_rows"), F.min("h").alias("first_hash")))


# --- trained models: a model is a stored table, fitted once per input version --------------------


def train_test(spark, sf_dir):
    """The 70 % and 30 % sides of the split, stored."""
    def build():
        both = materialize(ml.stratified_split(app_model_input(spark, sf_dir)), "split")
        return both.where(~F.col("is_test")).drop("is_test"), both.where(F.col("is_test")).drop("is_test")
    return memo(spark, ("train_test", fingerprint(sf_dir)), build)


def fitted(spark, sf_dir, kind, numeric):
    return memo(spark, ("model", kind, tuple(numeric), fingerprint(sf_dir)), lambda: ml.fit(train_test(spark, sf_dir)[0], kind, numeric))


def _metrics(spark, sf_dir, kind, numeric):
    model = fitted(spark, sf_dir, kind, numeric)
    return ml.evaluate(ml.score(model, train_test(spark, sf_dir)[1])).withColumn("model", F.lit(kind))


# The decision tree grown again in SQL: the same histograms, gains and order of equal gains, level by level.
_NUM, _CAT = ml.NUMERIC_FEATURES_APP, ml.CATEGORICAL_FEATURES
_P = ml.SETTINGS["tree"]
_G = lambda p: f"(({p}) * w1 / 16777216)"
_H = lambda p, n: f"((({p}) * w1 + (({n}) - ({p})) * w0) / 16777216)"
_FIT = lambda p, n: f"{_G(p)} * {_G(p)} / {_H(p, n)}"
TREE_CTES = SPLIT_CTES + [
    ("rw", "SELECT row_number() OVER (ORDER BY h) AS rid, * FROM sp"),
    ("wt", "SELECT " + ", ".join(f"round(CAST(count(*) AS DOUBLE) / (2 * count_if(is_churned = {y})) * 16777216) AS w{y}" for y in (0, 1)) + " FROM rw WHERE NOT is_test"),
    ("num", " UNION ALL ".join(f"SELECT rid, {j} AS f, CAST({c} AS DOUBLE) AS x, is_test FROM rw" for j, c in enumerate(_NUM))),
    ("rk", "SELECT f, x, row_number() OVER (PARTITION BY f ORDER BY x) - 1 AS r, count(*) OVER (PARTITION BY f) AS n FROM num WHERE NOT is_test"),
    ("ed", "SELECT f, list_sort(list_distinct(list(x))) AS es FROM rk WHERE list_contains(list_transform(range(1, 32), lambda i: (i * (n - 1)) // 32), r) GROUP BY f"),
    ("lng", "SELECT rid, num.f AS f, len(list_filter(es, lambda e: e < x)) AS b, CAST(NULL AS VARCHAR) AS v FROM num JOIN ed ON num.f = ed.f "
            + " ".join(f"UNION ALL SELECT rid, {len(_NUM) + i}, 0, CAST({c} AS VARCHAR) FROM rw" for i, c in enumerate(_CAT))),
    ("a0", "SELECT rid, is_test, is_churned AS y, 1 AS node FROM rw"),
]
for _k in range(_P.depth + 1):
    TREE_CTES.append((f"t{_k}", f"SELECT node, sum(y) AS tp, count(*) AS tn FROM a{_k} WHERE NOT is_test GROUP BY node"))
    if _k == _P.depth:
        break
    TREE_CTES += [
        (f"h{_k}", f"SELECT node, f, b, v, sum(y) AS p, count(*) AS n FROM a{_k} JOIN lng ON a{_k}.rid = lng.rid WHERE NOT is_test GROUP BY node, f, b, v"),
        (f"c{_k}", f"SELECT node, f, b, v, sum(p) OVER w AS lp, sum(n) OVER w AS ln FROM h{_k} WHERE f < {len(_NUM)} WINDOW w AS (PARTITION BY node, f ORDER BY b) "
                   f"UNION ALL SELECT h.node, f, b, v, tp - p, tn - n FROM h{_k} h JOIN t{_k} t ON h.node = t.node WHERE f >= {len(_NUM)}"),
        (f"s{_k}", f"SELECT c.node AS node, f, b, v, {_FIT('lp', 'ln')} + {_FIT('tp - lp', 'tn - ln')} - {_FIT('tp', 'tn')} AS gain "
                   f"FROM c{_k} c JOIN t{_k} t ON c.node = t.node, wt WHERE ln >= {_P.least_rows} AND tn - ln >= {_P.least_rows} "
                   f"QUALIFY row_number() OVER (PARTITION BY c.node ORDER BY gain DESC, f, b, v) = 1"),
        (f"a{_k + 1}", f"SELECT a.rid AS rid, is_test, y, 2 * a.node + CASE WHEN s.f < {len(_NUM)} THEN CAST(l.b > s.b AS INTEGER) ELSE CAST(l.v = s.v AS INTEGER) END AS node "
                       f"FROM a{_k} a JOIN s{_k} s ON a.node = s.node AND gain > 0 JOIN lng l ON l.rid = a.rid AND l.f = s.f"),
    ]
_NAMES = "[" + ", ".join(f"'{c}'" for c in _NUM + _CAT) + "]"
TREE_CTES += [
    ("nodes", " UNION ALL ".join(
        [f"SELECT t.node AS node, {k} AS depth, s.f AS f, s.b AS b, s.v AS v, s.gain AS gain, tp, tn FROM t{k} t LEFT JOIN s{k} s ON t.node = s.node AND gain > 0" for k in range(_P.depth)]
        + [f"SELECT node, {_P.depth}, NULL, NULL, NULL, NULL, tp, tn FROM t{_P.depth}"])),
    ("nv", f"SELECT nodes.*, {_G('tp')} / {_H('tp', 'tn')} AS value FROM nodes, wt"),
    ("leaf", "SELECT rid, max(node) AS node FROM (" + " UNION ALL ".join(f"SELECT rid, node FROM a{k} WHERE is_test" for k in range(_P.depth + 1)) + ") GROUP BY rid"),
    ("sc", "SELECT customer_unique_id, is_churned AS label, value AS score, CAST(value > 0.5 AS INTEGER) AS prediction FROM leaf JOIN nv ON leaf.node = nv.node JOIN rw ON leaf.rid = rw.rid"),
]


@register("tree_nodes", mi_sql(
    f"SELECT node, depth, {_NAMES}[nv.f + 1] AS column_name, CASE WHEN nv.f < {len(_NUM)} THEN round(es[b + 1], 6) END AS threshold, v AS feature_value, "
    "CAST(tn AS BIGINT) AS n, round(coalesce(gain, 0.0), 6) AS gain, round(value, 6) AS value FROM nv LEFT JOIN ed ON nv.f = ed.f", TREE_CTES))
def q_tree_nodes(spark, sf_dir):
    """The decision tree as a table: splits with their gain, and every node's rows and share of class 1."""
    t = fitted(spark, sf_dir, "tree", _NUM).table
    return t.select("node", "depth", F.col("column").alias("column_name"), F.round("threshold", R6).alias("threshold"), "feature_value", "n",
                    F.round("gain", R6).alias("gain"), F.round("value", R6).alias("value"))


_AUC = ("(SELECT sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below "
        "FROM (SELECT score, count_if(label = 1) AS pos, count_if(label = 0) AS neg FROM sc GROUP BY score)))")


@register("model_tree", mi_sql(
    f"SELECT round({_div('tn', 'tn + fp')}, 6) AS specificity, round({_div('tp', 'tp + fn')}, 6) AS sensitivity, "
    f"round({_div('tp', 'tp + fp')}, 6) AS precision, round({_div('2 * tp', '2 * tp + fp + fn')}, 6) AS f1, "
    f"round({_div('tp + tn', 'tp + tn + fp + fn')}, 6) AS accuracy, CAST(tp AS BIGINT) AS tp, CAST(tn AS BIGINT) AS tn, "
    f"CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round({_AUC}, 6) AS roc_auc, 'tree' AS model FROM cf", TREE_CTES + [CONF_CTE]))
def q_model_tree(spark, sf_dir):
    m = _metrics(spark, sf_dir, "tree", _NUM)
    return m.select(*[F.round(c, R6).alias(c) for c in ("specificity", "sensitivity", "precision", "f1", "accuracy")], "tp", "tn", "fp", "fn",
                    F.round("roc_auc", R6).alias("roc_auc"), "model")


@register("feature_importance", mi_sql(
    f"SELECT CASE WHEN f < {len(_NUM)} THEN {_NAMES}[f + 1] ELSE concat({_NAMES}[f + 1], '_', v) END AS feature, round(sum(gain) / (SELECT sum(gain) FROM nv), 6) AS importance "
    "FROM nv WHERE gain IS NOT NULL GROUP BY 1 ORDER BY sum(gain) DESC, 1 LIMIT 15", TREE_CTES))
def q_feature_importance(spark, sf_dir):
    return ml.feature_importance(fitted(spark, sf_dir, "tree", _NUM), 15).select("feature", F.round("importance", R6).alias("importance"))


@register("model_logistic")
def q_model_logistic(spark, sf_dir):
    """Metrics on the test side; the fit itself is checked by ``logistic_equations``."""
    return _metrics(spark, sf_dir, "logistic", _NUM)


@register("logistic_equations", mi_sql(
    "SELECT '(intercept)' AS feature, CAST(count(*) AS BIGINT) AS n_rows, CAST(0 AS DOUBLE) AS residual FROM sp WHERE NOT is_test "
    + " ".join(f"UNION ALL SELECT '{c}', count(*), CAST(0 AS DOUBLE) FROM sp WHERE NOT is_test" for c in _NUM) + " "
    + " ".join(f"UNION ALL SELECT concat('{c}_', {c}), count(*), CAST(0 AS DOUBLE) FROM sp WHERE NOT is_test GROUP BY {c}" for c in _CAT), SPLIT_CTES))
def q_logistic_equations(spark, sf_dir):
    """For each coefficient the rows that it applies to and its score equation, which is 0 at the one optimum."""
    model = fitted(spark, sf_dir, "logistic", _NUM)
    train = ml.with_weights(train_test(spark, sf_dir)[0], ml.LABEL)
    e = linear.score_equations(train, model.table, ml.LABEL, "weight")
    return e.select("feature", "n_rows", F.round("residual", R6).alias("residual"))


@register("model_forest")
def q_model_forest(spark, sf_dir):
    return _metrics(spark, sf_dir, "forest", ml.NUMERIC_FEATURES)


@register("model_boosted")
def q_model_boosted(spark, sf_dir):
    return _metrics(spark, sf_dir, "boosted", _NUM)


@register("compare_models")
def q_compare_models(spark, sf_dir):
    """The four models on the test side, best first."""
    return ml.compare({k: fitted(spark, sf_dir, k, ml.NUMERIC_FEATURES) for k in ("logistic", "tree", "forest", "boosted")}, train_test(spark, sf_dir)[1])


@register("score_customers")
def q_score_customers(spark, sf_dir):
    return ml.score_customers(fitted(spark, sf_dir, "logistic", _NUM), app_model_input(spark, sf_dir))


_FIRST = ("fr", f"SELECT rw.*, row_number() OVER (PARTITION BY customer_unique_id ORDER BY {', '.join(c for c in MI_COLS if c != 'customer_unique_id')}) AS nth FROM rw")
_REACHED = ("reached", "SELECT rid, max(node) AS node FROM (" + " UNION ALL ".join(f"SELECT rid, node FROM a{k}" for k in range(_P.depth + 1)) + ") GROUP BY rid")


@register("customer_outlook", mi_sql(
    "SELECT customer_unique_id, customer_state, RFM_Score, round(payment_value, 6) AS payment_value, review_score, is_churned, round(value, 6) AS score, "
    "CAST(value > 0.5 AS INTEGER) AS prediction, CASE WHEN value > 0.5 THEN 'high' ELSE 'low' END AS risk "
    "FROM fr JOIN reached ON fr.rid = reached.rid JOIN nv ON reached.node = nv.node WHERE nth = 1", TREE_CTES + [_FIRST, _REACHED]))
def q_customer_outlook(spark, sf_dir):
    """Each customer's record with the tree's churn probability and risk, as the one-customer view shows them."""
    mi = app_model_input(spark, sf_dir)
    rest = [c for c in MI_COLS if c != "customer_unique_id"]
    s = ml.score_customers(fitted(spark, sf_dir, "tree", _NUM), mi, order_by=rest, keep=["customer_state", "RFM_Score", "payment_value", "review_score", "is_churned"])
    return s.select("customer_unique_id", "customer_state", "RFM_Score", F.round("payment_value", R6).alias("payment_value"), "review_score", "is_churned",
                    F.round("score", R6).alias("score"), "prediction", "risk")


@register("model_saved", ORACLE["tree_nodes"])
def q_model_saved(spark, sf_dir):
    """The tree saved to the shared folder and loaded again: the same table."""
    path = f"{checkpoint_dir(spark)}/model-{uuid.uuid4().hex[:12]}"
    ml.save(fitted(spark, sf_dir, "tree", _NUM), path)
    t = ml.load(spark, path).table
    return t.select("node", "depth", F.col("column").alias("column_name"), F.round("threshold", R6).alias("threshold"), "feature_value", "n",
                    F.round("gain", R6).alias("gain"), F.round("value", R6).alias("value"))
