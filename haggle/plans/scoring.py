"""Metrics and models over the seller-action, agreement and latency cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from haggle.operators import metrics as E
from haggle.operators import models as M
from haggle.operators.isotonic import isotonic
from haggle.operators.neighbours import nearest_target
from haggle.operators.search import forward_search
from haggle.plans.learning import cases_of
from haggle.plans.registry import query, view
from haggle.sources.tables import table

LABELS = ["accept", "counter", "decline", "expire"]
CUT = "1996-01-01"


def parts(spark, sf, target="seller_next_action"):
    c = cases_of(spark, sf, target).filter(F.col("outcome_state") == "supervised")
    if target in ("response_latency", "final_price_ratio"):
        c = c.withColumn("label", F.col("value"))
    day = F.to_timestamp_ntz(F.lit(f"{CUT} 00:00:00"))
    return c.filter(F.col("timestamp") < day), c.filter(F.col("timestamp") >= day)


def _cases_sql(target: str, op: str) -> str:
    label = "value AS label" if target in ("response_latency", "final_price_ratio") else "label"
    return f"""SELECT row_id, {label}, category, condition, listing_price, current_actor, current_action, current_amount, offer_to_asking_ratio,
  round_number, prior_turn_count, prior_counter_count, event_hour, "timestamp", COALESCE(offer_to_asking_ratio, 0) AS r
  FROM v_cases WHERE target = '{target}' AND outcome_state = 'supervised' AND "timestamp" {op} TIMESTAMP '{CUT} 00:00:00'"""


view("v_tr", _cases_sql("seller_next_action", "<"))
view("v_dv", _cases_sql("seller_next_action", ">="))
view("v_ltr", _cases_sql("response_latency", "<"))
view("v_ldv", _cases_sql("response_latency", ">="))
_BIN = "LEAST(7, FLOOR(GREATEST(0.0::DOUBLE, LEAST(1.5::DOUBLE, r)) / 1.5::DOUBLE * 8))::INTEGER"
_CNT = ", ".join(f"COUNT(*) FILTER (WHERE label = '{x}') AS n_{x}" for x in LABELS)


def _normal(raw: dict[str, str]) -> str:
    tot = "(" + " + ".join(raw.values()) + ")"
    return ", ".join(f"({v})::DOUBLE / {tot} AS p_{x}" for x, v in raw.items())


view("v_hist", f"""
SELECT d.row_id, d.label, d.category, d.r, d."timestamp", {_normal({x: f"(COALESCE(c.n_{x}, 0) + 1.0::DOUBLE * (g.n_{x} + 1.0::DOUBLE))" for x in LABELS})}
FROM v_dv d CROSS JOIN (SELECT {_CNT} FROM v_tr) g
LEFT JOIN (SELECT category AS cat, {_BIN} AS b, {_CNT} FROM v_tr GROUP BY 1, 2) c ON c.cat = d.category AND c.b = ({_BIN.replace(', r)', ', d.r)')})""")


def _best(src: str) -> str:
    top = "GREATEST(" + ", ".join(f"p_{x}" for x in LABELS) + ")"
    pred = "CASE " + " ".join(f"WHEN p_{x} = {top} THEN '{x}'" for x in LABELS[:-1]) + f" ELSE '{LABELS[-1]}' END"
    mine = "CASE label " + " ".join(f"WHEN '{x}' THEN p_{x}" for x in LABELS) + " END"
    return f"SELECT *, {pred} AS prediction, {top} AS top, {mine} AS mine FROM {src}"


view("v_pred", _best("v_hist"))


def hist_pred(spark, sf):
    train, dev = parts(spark, sf)
    return M.offer_histogram(train, dev, LABELS)


def _wide(pred):
    return pred.select("row_id", "label", "prediction", *[E.prob_of(x).alias(f"p_{x}") for x in LABELS])


_PD = " ".join(f"p_{x}" for x in LABELS)
_OUT = f"row_id, label, prediction, {', '.join(f'p_{x}' for x in LABELS)}"


@query("offer_histogram", f"SELECT {_OUT} FROM v_pred", _PD)
def _(spark, sf):
    return _wide(hist_pred(spark, sf))


view("v_maj", f"SELECT d.row_id, d.label, {_normal({x: f'g.n_{x}' for x in LABELS})} FROM v_dv d CROSS JOIN (SELECT {_CNT} FROM v_tr) g")
view("v_majp", _best("v_maj"))


@query("majority", f"SELECT {_OUT} FROM v_majp", _PD)
def _(spark, sf):
    return _wide(M.majority(*parts(spark, sf), LABELS))


view("v_cat", f"""SELECT d.row_id, d.label, {_normal({x: f'g.n_{x}' for x in LABELS})} FROM v_dv d
  JOIN (SELECT category AS cat, {_CNT} FROM v_tr GROUP BY 1) g ON g.cat = d.category""")
view("v_catp", _best("v_cat"))


@query("category_majority", f"SELECT {_OUT} FROM v_catp", _PD)
def _(spark, sf):
    return _wide(M.category_majority(*parts(spark, sf), LABELS))


@query("rule_classifiers", """
SELECT row_id, CASE WHEN r >= 0.85::DOUBLE THEN 'accept' WHEN r >= 0.65::DOUBLE THEN 'counter' ELSE 'decline' END AS ratio_rule,
       CASE WHEN prior_counter_count > 0 THEN 'counter' ELSE (SELECT prediction FROM v_majp LIMIT 1) END AS concession_rule,
       CASE WHEN r >= 0.875::DOUBLE THEN 'accept' WHEN r >= 0.5::DOUBLE THEN 'counter' ELSE 'decline' END AS split_rule FROM v_dv""")
def _(spark, sf):
    train, dev = parts(spark, sf)
    d = M.ratio_rule(dev).withColumnRenamed("prediction", "ratio_rule").drop("probs")
    d = M.prior_concession_rule(train, d, LABELS).withColumnRenamed("prediction", "concession_rule").drop("probs")
    return M.split_difference_rule(d, LABELS).select("row_id", "ratio_rule", "concession_rule", F.col("prediction").alias("split_rule"))


_REG = ["median_regressor", "category_median_regressor", "offer_ratio_regressor", "split_the_difference_regressor",
        "prior_concession_regressor", "small_tree_regressor"]


@query("regression_baselines", """
WITH cut AS (SELECT MEDIAN(r) AS c FROM v_ltr),
s AS (SELECT MEDIAN(label) AS med, SUM(r * label) / SUM(r * r) AS slope, AVG(label) AS base,
  AVG(label) FILTER (WHERE prior_counter_count > 0) AS pos, AVG(label) FILTER (WHERE prior_counter_count <= 0) AS zero,
  AVG(label) FILTER (WHERE r < (SELECT c FROM cut)) AS lft, AVG(label) FILTER (WHERE r >= (SELECT c FROM cut)) AS rgt FROM v_ltr),
k AS (SELECT category AS cat, MEDIAN(label) AS m FROM v_ltr GROUP BY 1)
SELECT d.row_id, d.label, s.med AS median_regressor, COALESCE(k.m, s.med) AS category_median_regressor, d.r * s.slope AS offer_ratio_regressor,
  CASE WHEN COALESCE(d.listing_price, 0) <> 0 THEN (COALESCE(d.current_amount, 0) + d.listing_price) / 2 / d.listing_price ELSE 0.0 END AS split_the_difference_regressor,
  s.base + (s.pos - s.zero) * LEAST(d.prior_counter_count, 1) AS prior_concession_regressor,
  CASE WHEN d.r >= (SELECT c FROM cut) THEN s.rgt ELSE COALESCE(s.lft, s.base) END AS small_tree_regressor
FROM v_ldv d CROSS JOIN s LEFT JOIN k ON k.cat = d.category""", " ".join(f"{c}:5" for c in _REG) + " label:5")
def _(spark, sf):
    return M.regression_baselines(*parts(spark, sf, "response_latency"))


@query("category_quantiles", """
SELECT d.row_id, d.label, q.prediction, q.lower, q.upper FROM v_ldv d JOIN (
  SELECT category AS cat, MAX(label) FILTER (WHERE k = round_even((n - 1) * 0.5::DOUBLE, 0)) AS prediction,
         MAX(label) FILTER (WHERE k = round_even((n - 1) * 0.1::DOUBLE, 0)) AS lower, MAX(label) FILTER (WHERE k = round_even((n - 1) * 0.9::DOUBLE, 0)) AS upper
  FROM (SELECT category, label, ROW_NUMBER() OVER (PARTITION BY category ORDER BY label, row_id) - 1 AS k, COUNT(*) OVER (PARTITION BY category) AS n FROM v_ltr) t
  GROUP BY 1) q ON q.cat = d.category""", "label prediction lower upper")
def _(spark, sf):
    return M.category_quantiles(*parts(spark, sf, "response_latency"))


_SIDE = {f: f"COALESCE({f}, 0)" for f in ["offer_to_asking_ratio", "round_number", "prior_counter_count"]}
view("v_votes", "SELECT d.row_id, d.label, " + _normal({x: "(1.0::DOUBLE + " + " + ".join(
    [f"CASE WHEN COALESCE(d.{f}, 0) >= c.{f} THEN s.{f}_1_{x} ELSE s.{f}_0_{x} END" for f in _SIDE] + [f"COALESCE(k.n_{x}, 0)", f"COALESCE(a.n_{x}, 0)"]) + ")" for x in LABELS}) +
    " FROM v_dv d CROSS JOIN (SELECT " + ", ".join(f"MEDIAN({e}) AS {f}" for f, e in _SIDE.items()) + " FROM v_tr) c CROSS JOIN (SELECT " + ", ".join(
        f"COUNT(*) FILTER (WHERE label = '{x}' AND {e} {'>=' if s else '<'} (SELECT MEDIAN({e}) FROM v_tr)) AS {f}_{s}_{x}" for f, e in _SIDE.items() for s in (0, 1) for x in LABELS) +
    f" FROM v_tr) s LEFT JOIN (SELECT category AS v, {_CNT} FROM v_tr GROUP BY 1) k ON k.v = d.category LEFT JOIN (SELECT current_action AS v, {_CNT} FROM v_tr GROUP BY 1) a ON a.v = d.current_action")
view("v_votesp", _best("v_votes"))


@query("stump_votes", f"SELECT {_OUT} FROM v_votesp", _PD)
def _(spark, sf):
    return _wide(M.stump_votes(*parts(spark, sf), LABELS))


@query("monotone_accept")
def _(spark, sf):
    return _wide(M.monotone_accept(*parts(spark, sf), LABELS))


_TERM = {
    "relative_offer": "r", "gap_to_listing": "CASE WHEN COALESCE(listing_price, 0) <> 0 THEN (listing_price - COALESCE(current_amount, 0)) / listing_price ELSE 0.0 END",
    "round_number": "round_number", "timing_hour": "event_hour / 24.0::DOUBLE", "seller_experience": "prior_counter_count", "prior_counter_count": "prior_counter_count",
    "listing_price_ratio": "CASE WHEN COALESCE(listing_price, 0) <> 0 THEN COALESCE(current_amount, 0) / listing_price ELSE 0.0 END",
    "category_refurbished": "CASE WHEN lower(category) LIKE '%refurbished%' THEN 1.0 ELSE 0.0 END",
    "relative_offer_below_70": "CASE WHEN r < 0.7::DOUBLE THEN 1.0 ELSE 0.0 END", "relative_offer_above_85": "CASE WHEN r >= 0.85::DOUBLE THEN 1.0 ELSE 0.0 END",
    "relative_offer_x_round": "r * round_number"}


def _formula_sql() -> str:
    out = []
    for f, (g, xs) in M.FORMULAS.items():
        coef = ", ".join(f"AVG({_TERM[x]}) FILTER (WHERE label = '{g}') - AVG({_TERM[x]}) FILTER (WHERE label <> '{g}') AS c{i}" for i, x in enumerate(xs))
        fit = f"(SELECT COUNT(*) AS n, {_CNT}, (COUNT(*) FILTER (WHERE label = '{g}') + 0.5::DOUBLE) / (COUNT(*) + 1.0::DOUBLE) AS rate, {coef} FROM v_tr)"
        score = "ln(rate / GREATEST(1 - rate, 1e-9)) + " + " + ".join(f"c{i} * ({_TERM[x]})" for i, x in enumerate(xs))
        rest = [x for x in LABELS if x != g]
        raw = {x: "p" if x == g else f"(1 - p) * (n_{x} + 1.0::DOUBLE) / ({' + '.join('n_' + y for y in rest)} + {len(rest)})" for x in LABELS}
        tot = " + ".join(raw.values())
        mine = "CASE label " + " ".join(f"WHEN '{x}' THEN {v}" for x, v in raw.items()) + " END"
        out.append(f"""SELECT '{f}' AS formula_id, {len(xs)} AS complexity, AVG(-ln(GREATEST(1e-12, LEAST(1 - 1e-12, ({mine}) / ({tot}))))) AS log_loss
          FROM (SELECT d.label, f.*, 1 / (1 + exp(-GREATEST(-20.0, LEAST(20.0, {score})))) AS p FROM v_dv d CROSS JOIN {fit} f) t""")
    base = "(SELECT AVG(-ln(GREATEST(1e-12, mine))) FROM v_majp)"
    return f"SELECT formula_id, complexity, log_loss, {base} AS baseline_log_loss, log_loss < {base} AS passed FROM ({' UNION ALL '.join(out)}) u"


@query("formula_models", _formula_sql(), "log_loss baseline_log_loss")
def _(spark, sf):
    return M.formula_models(*parts(spark, sf), LABELS)


FEATS = ["listing_price", "current_amount", "offer_to_asking_ratio", "round_number", "prior_counter_count"]


def binary(df):
    return df.withColumn("target", (F.col("label") == "accept").cast("int"))


_T = "CASE WHEN label = 'accept' THEN 1 ELSE 0 END"


@query("rank_features", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, ABS(AVG(COALESCE({f}, 0)) FILTER (WHERE label = 'accept') - AVG(COALESCE({f}, 0)) FILTER (WHERE label <> 'accept')) / "
    f"GREATEST(stddev_pop(COALESCE({f}, 0)), 1e-9) AS score FROM v_tr" for f in FEATS), "score")
def _(spark, sf):
    return M.rank_features(binary(parts(spark, sf)[0]), FEATS)


@query("residual_terms", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, ABS(corr(COALESCE(d.{f}, 0), {_T.replace('label', 'd.label')} - p.p_accept)) AS score FROM v_dv d JOIN v_pred p ON p.row_id = d.row_id" for f in FEATS), "score")
def _(spark, sf):
    pred = binary(hist_pred(spark, sf)).withColumn("p", E.prob_of("accept"))
    return M.residual_terms(pred, FEATS)


def _clip(p: str) -> str:
    return f"GREATEST(1e-6, LEAST(1 - 1e-6, {p}))"


def _threshold_sql() -> str:
    per = " UNION ALL ".join(f"SELECT {i} AS pos, '{f}' AS variable, COALESCE({f}, 0)::DOUBLE AS value, {_T} AS t FROM v_tr" for i, f in enumerate(FEATS))
    return f"""WITH l AS ({per}), d AS (SELECT pos, variable, value, COUNT(*) AS c, SUM(t) AS s FROM l GROUP BY 1, 2, 3),
r AS (SELECT *, ROW_NUMBER() OVER w - 1 AS idx, COUNT(*) OVER (PARTITION BY pos) - 1 AS cuts, LEAD(value) OVER w AS nv, SUM(c) OVER w AS ln, SUM(s) OVER w AS lk,
      SUM(c) OVER (PARTITION BY pos) AS n, SUM(s) OVER (PARTITION BY pos) AS k FROM d WINDOW w AS (PARTITION BY pos ORDER BY value)),
q AS (SELECT *, (lk + 1.0::DOUBLE) / (ln + 2.0::DOUBLE) AS low_rate, (k - lk + 1.0::DOUBLE) / (n - ln + 2.0::DOUBLE) AS high_rate FROM r WHERE nv IS NOT NULL AND
  (cuts <= 25 OR list_contains(list_transform(range(25), lambda i: round_even(i * (cuts - 1) / 24.0::DOUBLE, 0)::BIGINT), idx)))
SELECT variable, (value + nv) / 2 AS threshold, low_rate, high_rate,
  -(lk * ln(low_rate) + (ln - lk) * ln(1 - low_rate) + (k - lk) * ln(high_rate) + (n - ln - k + lk) * ln(1 - high_rate)) / n AS log_loss
FROM q ORDER BY round(log_loss, 12), pos, threshold LIMIT 1"""


@query("threshold_rule", _threshold_sql(), "threshold low_rate high_rate log_loss")
def _(spark, sf):
    return M.threshold_rule(binary(parts(spark, sf)[0]), FEATS)


_PROPS = {"p_offer": ("accept", ["relative_offer", "round_number"]), "p_low": ("decline", ["relative_offer_below_70"])}


@query("score_proposals", " UNION ALL ".join(f"""
SELECT '{k}' AS proposal_id, {len(xs)} AS complexity, AVG(-(y * ln(q) + (1 - y) * ln(1 - q))) AS log_loss FROM (
  SELECT CASE WHEN label = '{g}' THEN 1.0 ELSE 0.0 END AS y, {_clip(f"f.base + 0.25::DOUBLE * tanh({' + '.join(_TERM[x] for x in xs)} - f.mid)")} AS q
  FROM v_dv CROSS JOIN (SELECT (COUNT(*) FILTER (WHERE label = '{g}') + 0.5::DOUBLE) / (COUNT(*) + 1.0::DOUBLE) AS base,
    (AVG({' + '.join(_TERM[x] for x in xs)}) FILTER (WHERE label = '{g}') + AVG({' + '.join(_TERM[x] for x in xs)}) FILTER (WHERE label <> '{g}')) / 2 AS mid FROM v_tr) f) t"""
    for k, (g, xs) in _PROPS.items()), "log_loss")
def _(spark, sf):
    t = M.terms()
    return M.score_proposals(*parts(spark, sf), {k: (g, [t[x] for x in xs]) for k, (g, xs) in _PROPS.items()})


_BRIER = " + ".join(f"pow(p_{x} - CASE WHEN label = '{x}' THEN 1 ELSE 0 END, 2)" for x in LABELS)


def _metrics_sql(src: str) -> str:
    return (f"COUNT(*) AS n, AVG(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS accuracy, AVG(-ln(GREATEST(1e-12, LEAST(1 - 1e-12, mine)))) AS log_loss, "
            f"AVG({_BRIER}) AS brier FROM {src}")


@query("classification_metrics", "SELECT " + _metrics_sql("v_pred"), "accuracy log_loss brier")
def _(spark, sf):
    return E.classification_metrics(hist_pred(spark, sf), LABELS)


@query("regression_metrics", """
SELECT COUNT(*) AS n, SQRT(AVG(pow(p - label, 2))) AS rmse, AVG(ABS(p - label)) AS mae, AVG(ABS(label - p) * 0.5) AS pinball
FROM (SELECT label, (SELECT MEDIAN(label) FROM v_ltr) AS p FROM v_ldv) t""", "rmse:4 mae:4 pinball:4")
def _(spark, sf):
    p = M.regression_baselines(*parts(spark, sf, "response_latency"))
    return E.regression_metrics(p.select("label", F.col("median_regressor").alias("prediction")))


def _bins(p: str, hit: str, b: int, src: str, keys: str = "") -> str:
    return (f"SELECT {keys} LEAST({b - 1}, GREATEST(0, FLOOR(({p}) * {b})::INTEGER)) AS bin, COUNT(*) AS count, AVG({p}) AS mean_prediction, "
            f"AVG(CASE WHEN {hit} THEN 1.0 ELSE 0.0 END) AS empirical_rate FROM {src} GROUP BY ALL")


@query("reliability", f"""SELECT b.bin::INTEGER AS bin, COALESCE(count, 0) AS count, COALESCE(mean_prediction, 0) AS mean_prediction, COALESCE(empirical_rate, 0) AS empirical_rate
FROM range(10) b(bin) LEFT JOIN ({_bins('p_accept', "label = 'accept'", 10, 'v_pred')}) r ON r.bin = b.bin""", "mean_prediction empirical_rate")
def _(spark, sf):
    return E.reliability(hist_pred(spark, sf), "accept")


_ECE = "SUM(count * ABS(mean_prediction - empirical_rate)) / SUM(count)"
_CLS = " UNION ALL ".join(f"SELECT '{x}' AS class, {_ECE} AS ece FROM ({_bins(f'p_{x}', f'''label = '{x}' ''', 10, 'v_pred')})" for x in LABELS)


@query("calibration_report", f"""WITH c AS (SELECT 'top_label' AS class, {_ECE} AS ece FROM ({_bins('top', 'label = prediction', 10, 'v_pred')}) UNION ALL {_CLS})
SELECT * FROM c UNION ALL SELECT 'macro', AVG(ece) FROM c WHERE class <> 'top_label'""", "ece")
def _(spark, sf):
    return E.calibration_report(hist_pred(spark, sf), LABELS)


_Q = """(SELECT MAX(label) FILTER (WHERE k = round_even((n - 1) * {q}::DOUBLE, 0)) FROM (SELECT label, ROW_NUMBER() OVER (ORDER BY label, row_id) - 1 AS k, COUNT(*) OVER () AS n FROM v_ltr) z)"""


@query("interval_report", f"""
WITH p AS (SELECT d.label, {_Q.format(q=0.5)} AS prediction, {_Q.format(q=0.1)} AS lower, {_Q.format(q=0.9)} AS upper, (SELECT MEDIAN(label) FROM v_ltr) AS med FROM v_ldv d)
SELECT AVG(CASE WHEN label BETWEEN lower AND upper THEN 1 ELSE 0 END) AS coverage, ABS(AVG(CASE WHEN label BETWEEN lower AND upper THEN 1 ELSE 0 END) - 0.8::DOUBLE) AS coverage_error,
  MEDIAN(upper - lower) / ({_Q.format(q=0.75)} - {_Q.format(q=0.25)}) AS width_to_iqr, AVG(ABS(label - prediction)) / AVG(ABS(label - med)) AS pinball_ratio FROM p""",
       "coverage coverage_error width_to_iqr pinball_ratio")
def _(spark, sf):
    train, dev = parts(spark, sf, "response_latency")
    every = E.exact_quantiles(train.withColumn("_k", F.lit(1)), ["_k"], "label", "row_id", {"lower": 0.1, "prediction": 0.5, "upper": 0.9})
    pred = M._attach(dev.select("row_id", "label"), every.drop("_k"))
    return E.interval_report(pred, train.select("row_id", "label"))


@query("abstention", """
SELECT row_id, (""" + " OR ".join(
    f"COALESCE({c}, 0) < (SELECT MIN({c}) FROM v_tr) OR COALESCE({c}, 0) > (SELECT MAX({c}) FROM v_tr)" for c in E.NUMERIC_FEATURES) + " OR " + " OR ".join(
    f"COALESCE({c}, 'missing') NOT IN (SELECT COALESCE({c}, 'missing') FROM v_tr)" for c in E.CATEGORICAL_FEATURES) + ") AS abstained FROM v_dv")
def _(spark, sf):
    train, dev = parts(spark, sf)
    return E.abstain(dev, E.support_profile(train)).select("row_id", "abstained")


_SL = "CASE WHEN r < 0.7::DOUBLE THEN 'low_offer' WHEN r < 0.85::DOUBLE THEN 'middle_offer' ELSE 'high_offer' END"


@query("calibration_slices", f"""SELECT slice, key, {_ECE} AS ece, SUM(count)::BIGINT AS n FROM (
{_bins('p_accept', "label = 'accept'", 5, 'v_pred', "'category' AS slice, category AS key,")} UNION ALL
{_bins('p_accept', "label = 'accept'", 5, 'v_pred', f"'offer_range' AS slice, {_SL} AS key,")}) t GROUP BY 1, 2""", "ece")
def _(spark, sf):
    return E.calibration_slices(hist_pred(spark, sf), "accept")


@query("calibration_drift", f"""
WITH h AS (SELECT *, CASE WHEN ROW_NUMBER() OVER (ORDER BY "timestamp", row_id) <= FLOOR(COUNT(*) OVER () / 2) THEN 'early' ELSE 'late' END AS half FROM v_pred),
e AS (SELECT half, {_ECE} AS ece, SUM(count)::BIGINT AS n FROM ({_bins('p_accept', "label = 'accept'", 5, 'h', 'half,')}) b GROUP BY 1)
SELECT a.ece AS early_ece, a.n AS early_rows, b.ece AS late_ece, b.n AS late_rows, ABS(b.ece - a.ece) AS absolute_drift FROM e a, e b WHERE a.half = 'early' AND b.half = 'late'""",
       "early_ece late_ece absolute_drift")
def _(spark, sf):
    return E.drift(hist_pred(spark, sf), "accept", ["timestamp", "row_id"])


@query("bootstrap_brier")
def _(spark, sf):
    return E.bootstrap_brier(hist_pred(spark, sf), "accept", samples=40)


def accept_pred(spark, sf):
    return binary(hist_pred(spark, sf)).select("row_id", E.prob_of("accept").alias("p"), "target", "timestamp")


view("v_bin", f"SELECT row_id, p_accept AS p, {_T} AS target, \"timestamp\" FROM v_pred")
_LL = f"-(target * ln({_clip('p')}) + (1 - target) * ln(1 - {_clip('p')}))"


@query("evaluate_binary", f"""SELECT n, log_loss, brier, calibration_error, base_rate, base_loss - log_loss AS lift FROM (
SELECT COUNT(*) AS n, AVG({_LL}) AS log_loss, AVG(pow({_clip('p')} - target, 2)) AS brier, AVG(target) AS base_rate,
  -(AVG(target) * ln(AVG(target)) + (1 - AVG(target)) * ln(1 - AVG(target))) AS base_loss,
  (SELECT {_ECE} FROM ({_bins('p', 'target = 1', 10, 'v_bin')})) AS calibration_error FROM v_bin) t""", "log_loss brier calibration_error base_rate lift")
def _(spark, sf):
    return E.evaluate_binary(accept_pred(spark, sf))


@query("paired_compare", f"""
SELECT COUNT(*) AS n, AVG(d) AS improvement, AVG(d) - 1.96 * stddev_pop(d) / SQRT(COUNT(*)) AS low, AVG(d) + 1.96 * stddev_pop(d) / SQRT(COUNT(*)) AS high,
  AVG(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS b_wins FROM (SELECT {_LL.replace('p)', 'b.p_accept)').replace('target', 'a.target')} - {_LL.replace('target', 'a.target').replace('p)', 'a.p)')} AS d
  FROM v_bin a JOIN v_maj b ON b.row_id = a.row_id) t""".replace("1 - 1e-6, b.p_accept", "1 - 1e-6, b.p_accept"), "improvement low high b_wins")
def _(spark, sf):
    a = binary(M.majority(*parts(spark, sf), LABELS)).select("row_id", E.prob_of("accept").alias("p"), "target")
    return E.paired_compare(a, accept_pred(spark, sf))


@query("top_residuals", "SELECT row_id, p, target, ABS(target - p) AS residual FROM v_bin ORDER BY round(ABS(target - p), 10) DESC, row_id LIMIT 8", "p residual")
def _(spark, sf):
    return E.top_residuals(accept_pred(spark, sf).withColumn("p", F.round("p", 12)), 8)


@query("top_disagreements", """SELECT a.row_id, a.p AS pa, b.p_accept AS pb, ABS(a.p - b.p_accept) AS gap FROM v_bin a JOIN v_maj b ON b.row_id = a.row_id
ORDER BY round(ABS(a.p - b.p_accept), 10) DESC, a.row_id LIMIT 8""", "pa pb gap")
def _(spark, sf):
    b = M.majority(*parts(spark, sf), LABELS).select("row_id", F.round(E.prob_of("accept"), 12).alias("p"))
    return E.top_disagreements(accept_pred(spark, sf).withColumn("p", F.round("p", 12)), b, 8)


@query("recent_rate", """SELECT (SUM(target) + 1.0::DOUBLE) / (COUNT(*) + 2.0::DOUBLE) AS rate, COUNT(*) AS rows FROM
(SELECT target FROM v_bin ORDER BY "timestamp" DESC, row_id DESC LIMIT 25) t""", "rate")
def _(spark, sf):
    return E.recent_rate(accept_pred(spark, sf), ["timestamp", "row_id"])


@query("assert_finite", """SELECT 'p' AS metric, 0::BIGINT AS bad_rows UNION ALL SELECT 'ratio', COUNT(*) FROM v_dv WHERE offer_to_asking_ratio IS NULL""")
def _(spark, sf):
    p = hist_pred(spark, sf).select(E.prob_of("accept").alias("p"), F.when(F.col("offer_to_asking_ratio").isNull(), F.lit(float("nan")))
                                    .otherwise(F.col("offer_to_asking_ratio")).alias("ratio"))
    return E.assert_finite(p)


_MODELS = {"majority": ("v_majp", 1), "category_majority": ("v_catp", 2), "offer_histogram": ("v_pred", 3), "stump_votes": ("v_votesp", 4)}


@query("leaderboard", "WITH s AS (" + " UNION ALL ".join(
    f"SELECT 'chronological' AS split, 'seller_next_action' AS target, '{m}' AS model, {c} AS complexity, {_metrics_sql(v)}" for m, (v, c) in _MODELS.items()) + """),
b AS (SELECT *, MIN(CASE WHEN model IN ('majority', 'category_majority') THEN log_loss END) OVER () AS baseline, MIN(log_loss) OVER () AS best FROM s)
SELECT split, target, model, complexity, n, accuracy, log_loss, brier, baseline, (baseline - log_loss) / baseline AS relative_improvement,
  ROW_NUMBER() OVER (ORDER BY CASE WHEN log_loss <= best * 1.01::DOUBLE THEN 0 ELSE 1 END, complexity, model) = 1 AS selected FROM b""",
       "accuracy log_loss brier baseline relative_improvement")
def _(spark, sf):
    train, dev = parts(spark, sf)
    fits = {"majority": M.majority, "category_majority": M.category_majority, "offer_histogram": M.offer_histogram, "stump_votes": M.stump_votes}
    preds = None
    for name, fit in fits.items():
        p = fit(train, dev, LABELS).select(F.lit("chronological").alias("split"), F.lit("seller_next_action").alias("target"), F.lit(name).alias("model"),
                                           F.lit(_MODELS[name][1]).alias("complexity"), "label", "prediction", "probs")
        preds = p if preds is None else preds.unionByName(p)
    scores = E.classification_metrics(preds, LABELS, ["split", "target", "model", "complexity"])
    return M.leaderboard(scores, "log_loss", ["majority", "category_majority"])


# ---- fits by pyspark.ml: checked by rows and in tests


@query("glm")
def _(spark, sf):
    return _wide(M.glm(*parts(spark, sf), ["offer_to_asking_ratio", "round_number", "prior_counter_count"], ["category", "current_action"]))


@query("linear")
def _(spark, sf):
    return M.linear(*parts(spark, sf, "response_latency"), ["offer_to_asking_ratio", "round_number"], ["category"])


@query("fit_terms")
def _(spark, sf):
    train, dev = [binary(x) for x in parts(spark, sf)]
    exprs = ["offer_to_asking_ratio", "if(round_number > 2, 1, 0)"]
    return M.score_terms(dev, exprs, M.fit_terms(train, exprs)).select("row_id", "p", "target")


@query("two_state")
def _(spark, sf):
    train, dev = [binary(x) for x in parts(spark, sf)]
    return M.two_state(train, dev, FEATS).select("row_id", "p", "target")


@query("forward_search")
def _(spark, sf):
    found = forward_search(*[binary(x) for x in parts(spark, sf)], FEATS)
    rows = [(i, t, x) for i, (t, x) in enumerate(zip(found["terms"], found["losses"]))]
    return spark.createDataFrame(rows, "pos int, term string, log_loss double")


@query("platt")
def _(spark, sf):
    return M.platt(accept_pred(spark, sf)).select("row_id", "p", "calibrated")


# the pooled curve by its max-min formula: of all averages from a point at or before x, the least that ends at or behind it; of those the greatest
@query("isotonic", """
SELECT row_id, b.p, v AS calibrated FROM v_bin b JOIN (
  WITH a AS (SELECT p AS x, ROW_NUMBER() OVER (ORDER BY p) AS i, SUM(SUM(target)) OVER (ORDER BY p) AS s, SUM(COUNT(*)) OVER (ORDER BY p) AS w FROM v_bin GROUP BY p),
  pairs AS (SELECT f.i AS f, t.i AS t, (t.s - COALESCE(z.s, 0))::DOUBLE / (t.w - COALESCE(z.w, 0)) AS m FROM a f JOIN a t ON f.i <= t.i LEFT JOIN a z ON z.i = f.i - 1),
  least AS (SELECT f, t, MIN(m) OVER (PARTITION BY f ORDER BY t DESC) AS m FROM pairs)
  SELECT x, MAX(m) AS v FROM least JOIN a ON a.i = t GROUP BY x) c ON c.x = b.p""", "calibrated")
def _(spark, sf):
    return isotonic(accept_pred(spark, sf)).select("row_id", "p", "calibrated")


# ---- neighbours

def _sides(spark, sf):
    train, dev = parts(spark, sf)
    keep = F.col("offer_to_asking_ratio").isNotNull()
    ratio = F.col("offer_to_asking_ratio").alias("ratio")
    return (dev.filter(keep).select(F.col("row_id").alias("cand_id"), "category", ratio),
            train.filter(keep).select(F.col("row_id").alias("hist_id"), "category", ratio, "label"))


@query("nearest_ratio")
def _(spark, sf):
    return M.nearest_ratio(*_sides(spark, sf), 5)


@query("offer_frontier")
def _(spark, sf):
    return M.offer_frontier(*_sides(spark, sf), 5)


@query("nearest_row", """
WITH scales AS (SELECT list(CASE WHEN sd > 1e-9 THEN sd ELSE 1 END ORDER BY i) AS s FROM (
    SELECT i, stddev_pop(x) AS sd FROM (SELECT generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE vec_id % 5 <> 0) GROUP BY i)),
d AS (SELECT r.vec_id AS id, t.vec_id AS tid, t.label >= 5 AS hit,
             list_sum(list_transform(range(1, len(s) + 1), lambda i: pow((t.embedding[i]::DOUBLE - r.embedding[i]::DOUBLE) / s[i], 2))) AS d
      FROM embeddings r JOIN embeddings t ON r.vec_id % 5 = 0 AND t.vec_id % 5 <> 0, scales)
SELECT id, arg_min(tid, (d, tid)) AS nearest_id, MIN(d) AS distance, CASE WHEN arg_min(hit, (d, tid)) THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END AS p FROM d GROUP BY id""", "distance")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), (F.col("label") >= 5).cast("int").alias("target"))
    return nearest_target(e.filter("id % 5 <> 0"), e.filter("id % 5 = 0")).drop("tested")
