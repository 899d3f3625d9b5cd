"""Scoring, curve, ensemble and statistics queries with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratafold.functions.keys import cell_id, point_key
from stratafold.operators import classify, coverage, curves, ensemble, ranking, stats
from stratafold.operators.ordering import largest_group, prefix_totals
from stratafold.plans.views import view, with_views
from stratafold.session import cut

RUN = ["realiz", "model"]
PLANS: dict = {}


def plan(name: str, sql: str | None = None):
    def add(fn):
        PLANS[name] = (fn, sql)
        return fn
    return add


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


CURVE = """+s AS (SELECT realiz, model, probability, count(*) AS n, sum(label) AS pos FROM v_pred GROUP BY ALL),
c AS (SELECT *, CAST(sum(n) OVER w AS DOUBLE) AS cn, CAST(sum(pos) OVER w AS DOUBLE) AS cp,
  CAST(sum(n) OVER (PARTITION BY realiz, model) AS DOUBLE) AS tn, CAST(sum(pos) OVER (PARTITION BY realiz, model) AS DOUBLE) AS tp
  FROM s WINDOW w AS (PARTITION BY realiz, model ORDER BY probability DESC))"""
RANKED = CURVE + """, m AS (SELECT realiz, model, CAST(sum(n) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS positives,
  CASE WHEN max(tp) > 0 AND max(tp) < max(tn) THEN sum(pos * cp / cn) / max(tp) END AS ap,
  CASE WHEN max(tp) > 0 AND max(tp) < max(tn) THEN sum((n - pos) * (cp - pos / 2.0)) / (max(tp) * (max(tn) - max(tp))) END AS auc
  FROM c GROUP BY realiz, model)"""


def metrics(spark, folder):
    return ranking.ranking_metrics(view(spark, folder, "v_pred"), RUN, "probability", "label")


@plan("ap_by_model", with_views(RANKED + " SELECT realiz, model, n, positives, round(ap, 6) AS average_precision FROM m", "v_pred"))
def ap_by_model(spark, folder):
    return metrics(spark, folder).select(*RUN, "n", "positives", *r6("average_precision"))


@plan("roc_auc_by_model", with_views(RANKED + " SELECT realiz, model, round(auc, 6) AS roc_auc FROM m", "v_pred"))
def roc_auc_by_model(spark, folder):
    return metrics(spark, folder).select(*RUN, *r6("roc_auc"))


@plan("model_ranking", with_views(RANKED + """, a AS (SELECT model, count(ap) AS runs, round(avg(ap), 6) AS mean_ap,
 round(coalesce(stddev_samp(ap), 0), 6) AS sd_ap, round(quantile_cont(ap, 0.25), 6) AS q1, round(median(ap), 6) AS median, round(quantile_cont(ap, 0.75), 6) AS q3 FROM m GROUP BY model)
 SELECT *, row_number() OVER (ORDER BY mean_ap DESC, model) AS place FROM a""", "v_pred"))
def model_ranking(spark, folder):
    """Which model has the highest mean average precision over the realizations."""
    per_run = metrics(spark, folder).withColumnRenamed("average_precision", "ap")
    table = stats.metric_summary(per_run, ["model"], "ap").select(
        "model", F.col("n").alias("runs"), F.round("mean", 6).alias("mean_ap"), F.round("sd", 6).alias("sd_ap"),
        *r6("q1", "median", "q3"),
    )
    return prefix_totals(table, [], [F.col("mean_ap").desc(), F.col("model").asc()], position="place")


@plan("roc_curve", with_views(CURVE + """ SELECT realiz, model, probability AS threshold, round((cn - cp) / (tn - tp), 6) AS fpr, round(cp / tp, 6) AS tpr
 FROM c WHERE tp > 0 AND tp < tn""", "v_pred"))
def roc_curve(spark, folder):
    return ranking.roc_points(view(spark, folder, "v_pred"), RUN, "probability", "label").select(*RUN, "threshold", *r6("fpr", "tpr"))


@plan("pr_curve", with_views(CURVE + """ SELECT realiz, model, probability AS threshold, round(cp / tp, 6) AS recall, round(cp / cn, 6) AS precision
 FROM c WHERE tp > 0 AND tp < tn""", "v_pred"))
def pr_curve(spark, folder):
    return ranking.pr_points(view(spark, folder, "v_pred"), RUN, "probability", "label").select(*RUN, "threshold", *r6("recall", "precision"))


CELLS = """+q AS (SELECT realiz, model, CAST(sum(CASE WHEN label=0 AND probability<0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
 CAST(sum(CASE WHEN label=0 AND probability>=0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
 CAST(sum(CASE WHEN label=1 AND probability<0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
 CAST(sum(CASE WHEN label=1 AND probability>=0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tp, count(*) AS n,
 avg((label - probability) * (label - probability)) AS brier,
 avg(-(label * ln(greatest(1e-7, least(1 - 1e-7, probability))) + (1 - label) * ln(1 - greatest(1e-7, least(1 - 1e-7, probability))))) AS log_loss
 FROM v_pred GROUP BY realiz, model)"""


@plan("confusion", with_views(CELLS + " SELECT realiz, model, tn, fp, fn, tp FROM q", "v_pred"))
def confusion(spark, folder):
    return classify.confusion(view(spark, folder, "v_pred"), RUN, "probability", "label")


# A run with one class only, whose probability scores are undefined.
FLAT = "SELECT id, 99 AS realiz, model, 0 AS label, probability FROM {t} WHERE realiz = 0"


@plan("threshold_metrics", with_views("+pr AS (SELECT * FROM v_pred UNION ALL " + FLAT.format(t="v_pred") + "), " + CELLS[1:].replace("FROM v_pred", "FROM pr") + """ SELECT realiz, model, n, round((tp + fn) / n, 6) AS positive_ratio, round((tp + tn) / n, 6) AS accuracy,
 round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
 round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
 round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / (CASE WHEN tp + fn > 0 THEN 1 ELSE 0 END + CASE WHEN tn + fp > 0 THEN 1 ELSE 0 END), 6) AS balanced_accuracy,
 round(coalesce((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / nullif(sqrt(CAST(tp + fp AS DOUBLE)) * sqrt(CAST(tp + fn AS DOUBLE)) * sqrt(CAST(tn + fp AS DOUBLE)) * sqrt(CAST(tn + fn AS DOUBLE)), 0), 0), 6) AS mcc,
 CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN round(brier, 6) END AS brier, CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN round(log_loss, 6) END AS log_loss FROM q""", "v_pred"))
def threshold_metrics(spark, folder):
    pred = view(spark, folder, "v_pred")
    flat = spark.sql(FLAT.format(t="{pred}"), pred=pred)
    out = classify.threshold_metrics(pred.unionByName(flat), RUN, "probability", "label")
    return out.select(*RUN, "n", *r6("positive_ratio", "accuracy", "precision", "recall", "f1", "balanced_accuracy", "mcc", "brier", "log_loss"))


@plan("class_report", with_views(CELLS + """, k AS (
 SELECT realiz, model, '0' AS class, coalesce(tn / nullif(tn + fn, 0), 0) AS p, coalesce(tn / nullif(tn + fp, 0), 0) AS r, coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0) AS f, tn + fp AS s FROM q
 UNION ALL SELECT realiz, model, '1', coalesce(tp / nullif(tp + fp, 0), 0), coalesce(tp / nullif(tp + fn, 0), 0), coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), tp + fn FROM q),
 z AS (SELECT * FROM k UNION ALL SELECT realiz, model, 'macro avg', avg(p), avg(r), avg(f), CAST(sum(s) AS BIGINT) FROM k GROUP BY realiz, model
 UNION ALL SELECT realiz, model, 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), CAST(sum(s) AS BIGINT) FROM k GROUP BY realiz, model)
 SELECT realiz, model, class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, s AS support FROM z""", "v_pred"))
def class_report(spark, folder):
    out = classify.class_report(view(spark, folder, "v_pred"), RUN, "probability", "label")
    return out.select(*RUN, "class", *r6("precision", "recall", "f1"), "support")


@plan("topk_capture", with_views("""+o AS (SELECT *, row_number() OVER (PARTITION BY realiz, model ORDER BY probability DESC, id) AS rn FROM v_pred),
 g AS (SELECT realiz, model, count(*) AS n, sum(label) AS tp FROM v_pred GROUP BY realiz, model),
 k AS (SELECT *, f AS fraction, CAST(greatest(1, ceil(n * f)) AS BIGINT) AS k FROM g, (VALUES (CAST(0.01 AS DOUBLE)), (CAST(0.05 AS DOUBLE)), (CAST(0.1 AS DOUBLE))) AS v(f)),
 h AS (SELECT k.realiz, k.model, fraction, k, tp, CAST(sum(label) AS BIGINT) AS captured FROM k JOIN o ON o.realiz = k.realiz AND o.model = k.model AND rn <= k GROUP BY ALL)
 SELECT realiz, model, fraction, k, captured, round(captured / greatest(1, tp), 6) AS capture, round(captured / k, 6) AS precision FROM h""", "v_pred"))
def topk_capture(spark, folder):
    out = ranking.top_fraction(view(spark, folder, "v_pred"), RUN, "probability", "label", "id")
    return out.select(*RUN, "fraction", "k", "captured", *r6("capture", "precision"))


GAIN = """+o AS (SELECT *, row_number() OVER w AS position, sum(label) OVER w AS hits, count(*) OVER (PARTITION BY realiz, model) AS n,
 sum(label) OVER (PARTITION BY realiz, model) AS tp FROM v_pred WINDOW w AS (PARTITION BY realiz, model ORDER BY probability DESC, id ROWS UNBOUNDED PRECEDING)),
 gc AS (SELECT realiz, model, position, position / n AS share, hits / greatest(tp, 1) AS gain FROM o
 UNION ALL SELECT DISTINCT realiz, model, CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM v_pred)"""


@plan("cumulative_gain", with_views(GAIN + " SELECT realiz, model, position, round(share, 6) AS share, round(gain, 6) AS gain FROM gc", "v_pred"))
def cumulative_gain(spark, folder):
    return ranking.gain_curve(view(spark, folder, "v_pred"), RUN, "probability", "label", "id").select(*RUN, "position", *r6("share", "gain"))


def grid_sql(source: str, x: str, y: str, points: int) -> str:
    return f""", u AS (SELECT realiz, model, {x} AS x, max({y}) AS y FROM {source} GROUP BY ALL),
 gr AS (SELECT i AS step, i / {points - 1}.0::DOUBLE AS grid FROM range({points}) AS t(i)),
 lo AS (SELECT realiz, model, step, grid, arg_max(x, x) FILTER (x <= grid) AS lx, arg_max(y, x) FILTER (x <= grid) AS ly,
   arg_min(x, x) FILTER (x > grid) AS hx, arg_min(y, x) FILTER (x > grid) AS hy FROM u, gr GROUP BY ALL),
 iv AS (SELECT realiz, model, CAST(step AS BIGINT) AS step, grid, CASE WHEN lx IS NULL THEN hy WHEN hx IS NULL OR lx = grid THEN ly
   ELSE (hy - ly) / (hx - lx) * (grid - lx) + ly END AS value FROM lo)"""


@plan("gain_on_grid", with_views(GAIN + grid_sql("gc", "share", "gain", 101) + " SELECT realiz, model, step, round(value, 6) AS value FROM iv", "v_pred"))
def gain_on_grid(spark, folder):
    gain = ranking.gain_curve(view(spark, folder, "v_pred"), RUN, "probability", "label", "id")
    return curves.interpolate_on_grid(gain, RUN, "share", "gain", 101).select(*RUN, "step", *r6("value"))


@plan("mean_curve", with_views(CURVE + """, pr AS (SELECT realiz, model, cp / tp AS recall, cp / cn AS precision FROM c WHERE tp > 0 AND tp < tn)"""
      + grid_sql("pr", "recall", "precision", 301) + """, b AS (SELECT model, step, count(value) AS runs, avg(value) AS m, coalesce(stddev_samp(value), 0) AS sd FROM iv GROUP BY model, step)
 SELECT model, step, runs, round(m, 6) AS mean, round(sd, 6) AS sd, round(greatest(0, least(1, m - sd)), 6) AS low, round(greatest(0, least(1, m + sd)), 6) AS high FROM b""", "v_pred"))
def mean_curve(spark, folder):
    pr = ranking.pr_points(view(spark, folder, "v_pred"), RUN, "probability", "label")
    band = curves.mean_band(curves.interpolate_on_grid(pr, RUN, "recall", "precision", 301), ["model"])
    return band.select("model", "step", "runs", *r6("mean", "sd", "low", "high"))


PARTS = ["a", "b", "c"]


def rank_sql(keys: str, parts=PARTS) -> str:
    cols = ", ".join(
        f"(count(*) OVER g - (rank() OVER (PARTITION BY {keys} ORDER BY p_{p} DESC) + (count(*) OVER (PARTITION BY {keys}, p_{p}) - 1) / 2.0)) / greatest(count(*) OVER g - 1, 1) AS r_{p}"
        for p in parts)
    ones = ", ".join(f"CASE WHEN cnt = 1 THEN 1.0 ELSE r_{p} END AS rank_{p}" for p in parts)
    return f"+rk0 AS (SELECT *, count(*) OVER g AS cnt, {cols} FROM v_comp WINDOW g AS (PARTITION BY {keys})), rk AS (SELECT *, {ones} FROM rk0)"


def normalized(spark, folder):
    """Normalised components, written once because selection and scoring both read them."""
    return cut(rank_columns(spark, folder))


def rank_columns(spark, folder):
    out = view(spark, folder, "v_comp")
    keys = ["realiz", "part"]
    rows = largest_group(out, keys)
    for name in PARTS:
        out = ranking.rank_normalize(out, keys, f"p_{name}", f"rank_{name}", rows)
    return out


@plan("rank_normalize", with_views(rank_sql("realiz, part") + " SELECT id, realiz, part, round(rank_a, 6) AS rank_a, round(rank_b, 6) AS rank_b, round(rank_c, 6) AS rank_c FROM rk", "v_comp"))
def rank_normalize(spark, folder):
    return rank_columns(spark, folder).select("id", "realiz", "part", *r6("rank_a", "rank_b", "rank_c"))


WEIGHTS = rank_sql("realiz, part") + """, wv AS (SELECT i / 20.0::DOUBLE AS w_a, j / 20.0::DOUBLE AS w_b, (20 - i - j) / 20.0::DOUBLE AS w_c FROM range(21) AS a(i), range(21) AS b(j) WHERE i + j <= 20),
 sc AS (SELECT realiz, w_a, w_b, w_c, id, label, round(w_a * rank_a + w_b * rank_b + w_c * rank_c, 12) AS s FROM rk, wv WHERE part = 'validation'),
 sg AS (SELECT realiz, w_a, w_b, w_c, s, count(*) AS n, sum(label) AS pos FROM sc GROUP BY ALL),
 sw AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp FROM sg WINDOW w AS (PARTITION BY realiz, w_a, w_b, w_c ORDER BY s DESC)),
 ap AS (SELECT realiz, w_a, w_b, w_c, sum(CAST(pos AS DOUBLE) * cp / cn) / sum(pos) AS ap FROM sw GROUP BY ALL),
 tk AS (SELECT *, row_number() OVER (PARTITION BY realiz, w_a, w_b, w_c ORDER BY s DESC, id) AS rn, count(*) OVER (PARTITION BY realiz, w_a, w_b, w_c) AS n, sum(label) OVER (PARTITION BY realiz, w_a, w_b, w_c) AS tp FROM sc),
 tc AS (SELECT realiz, w_a, w_b, w_c, sum(label) / greatest(1, max(tp)) AS capture FROM tk WHERE rn <= greatest(1, ceil(n * CAST(0.05 AS DOUBLE))) GROUP BY ALL),
 pk AS (SELECT *, row_number() OVER (PARTITION BY realiz ORDER BY round(ap, 10) DESC, round(capture, 10) DESC, (CASE WHEN w_a > 0 THEN 1 ELSE 0 END + CASE WHEN w_b > 0 THEN 1 ELSE 0 END + CASE WHEN w_c > 0 THEN 1 ELSE 0 END), w_a DESC, w_b DESC, w_c DESC) AS rn
   FROM ap JOIN tc USING (realiz, w_a, w_b, w_c)),
 best AS (SELECT realiz, w_a, w_b, w_c, ap, capture FROM pk WHERE rn = 1)"""


STEP = 0.05  # of the weights (fixed value)


def chosen_weights(ranked):
    valid = ranked.where(F.col("part") == "validation")
    return ensemble.select_weights(valid, ["realiz"], "label", "id", {p: f"rank_{p}" for p in PARTS}, STEP)


@plan("rank_ensemble_weights", with_views(WEIGHTS + " SELECT realiz, w_a, w_b, w_c, round(ap, 6) AS average_precision, round(capture, 6) AS capture FROM best", "v_comp"))
def rank_ensemble_weights(spark, folder):
    return chosen_weights(normalized(spark, folder)).select("realiz", "w_a", "w_b", "w_c", *r6("average_precision", "capture"))


@plan("rank_ensemble_scores", with_views(WEIGHTS + """, ts AS (SELECT realiz, id, label, round(w_a * rank_a + w_b * rank_b + w_c * rank_c, 12) AS s FROM rk JOIN best USING (realiz) WHERE part = 'test'),
 tg AS (SELECT realiz, s, count(*) AS n, sum(label) AS pos FROM ts GROUP BY ALL),
 tw AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, sum(n) OVER (PARTITION BY realiz) AS tn, sum(pos) OVER (PARTITION BY realiz) AS tp FROM tg WINDOW w AS (PARTITION BY realiz ORDER BY s DESC))
 SELECT realiz, CAST(sum(n) AS BIGINT) AS n, round(CASE WHEN max(tp) BETWEEN 1 AND max(tn) - 1 THEN sum(CAST(pos AS DOUBLE) * cp / cn) / max(tp) END, 6) AS average_precision,
 round(CASE WHEN max(tp) BETWEEN 1 AND max(tn) - 1 THEN sum((n - pos) * (cp - pos / 2.0)) / (CAST(max(tp) AS DOUBLE) * (max(tn) - max(tp))) END, 6) AS roc_auc FROM tw GROUP BY realiz""", "v_comp"))
def rank_ensemble_scores(spark, folder):
    both = normalized(spark, folder)
    ranked = both.where(F.col("part") == "test")
    weights = cut(chosen_weights(both)).select("realiz", *[f"w_{p}" for p in PARTS])
    scored = curves.join_small(ranked, weights, ["realiz"]).withColumn(
        "s", F.round(ensemble.weighted_score(PARTS, [f"rank_{p}" for p in PARTS]), 12))
    return ranking.ranking_metrics(scored, ["realiz"], "s", "label").select("realiz", "n", *r6("average_precision", "roc_auc"))


@plan("mean_weights", with_views(WEIGHTS + " SELECT count(*) AS runs, round(avg(w_a), 6) AS w_a, round(avg(w_b), 6) AS w_b, round(avg(w_c), 6) AS w_c FROM best", "v_comp"))
def mean_weights(spark, folder):
    return chosen_weights(normalized(spark, folder)).agg(
        F.count("*").alias("runs"), *[F.round(F.avg(f"w_{p}"), 6).alias(f"w_{p}") for p in PARTS])


# The second variant: a prior as fourth component, equal to the third in half the runs, so that its small weight decides ties.
PRIOR_SCORE = "CASE WHEN realiz % 2 = 0 THEN p_c ELSE CAST((id * 15485863) % 1013 AS DOUBLE) / 1013.0 END"
PRIOR = f"""+v4 AS (SELECT *, {PRIOR_SCORE} AS p_g FROM v_comp), """ + rank_sql("realiz, part", [*PARTS, "g"])[1:].replace("FROM v_comp", "FROM v4") + """,
 wv AS (SELECT i / 20.0::DOUBLE AS w_a, j / 20.0::DOUBLE AS w_b, k / 20.0::DOUBLE AS w_c, (20 - i - j - k) / 20.0::DOUBLE AS w_g FROM range(21) AS a(i), range(21) AS b(j), range(21) AS c(k) WHERE i + j + k <= 20),
 sc AS (SELECT realiz, w_a, w_b, w_c, w_g, id, label, round(w_a * rank_a + w_b * rank_b + w_c * rank_c + w_g * rank_g, 12) AS s FROM rk, wv WHERE part = 'validation'),
 sg AS (SELECT realiz, w_a, w_b, w_c, w_g, s, count(*) AS n, sum(label) AS pos FROM sc GROUP BY ALL),
 sw AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp FROM sg WINDOW w AS (PARTITION BY realiz, w_a, w_b, w_c, w_g ORDER BY s DESC)),
 ap AS (SELECT realiz, w_a, w_b, w_c, w_g, sum(CAST(pos AS DOUBLE) * cp / cn) / sum(pos) AS ap FROM sw GROUP BY ALL),
 tk AS (SELECT *, row_number() OVER (PARTITION BY realiz, w_a, w_b, w_c, w_g ORDER BY s DESC, id) AS rn, count(*) OVER (PARTITION BY realiz, w_a, w_b, w_c, w_g) AS n, sum(label) OVER (PARTITION BY realiz, w_a, w_b, w_c, w_g) AS tp FROM sc),
 tc AS (SELECT realiz, w_a, w_b, w_c, w_g, sum(label) / greatest(1, max(tp)) AS capture FROM tk WHERE rn <= greatest(1, ceil(n * CAST(0.05 AS DOUBLE))) GROUP BY ALL),
 pk AS (SELECT *, row_number() OVER (PARTITION BY realiz ORDER BY round(ap, 10) DESC, round(capture, 10) DESC, w_g, (CASE WHEN w_a > 0 THEN 1 ELSE 0 END + CASE WHEN w_b > 0 THEN 1 ELSE 0 END + CASE WHEN w_c > 0 THEN 1 ELSE 0 END + CASE WHEN w_g > 0 THEN 1 ELSE 0 END),
   w_a DESC, w_b DESC, w_c DESC, w_g DESC) AS rn FROM ap JOIN tc USING (realiz, w_a, w_b, w_c, w_g))
 SELECT realiz, w_a, w_b, w_c, w_g, round(ap, 6) AS average_precision, round(capture, 6) AS capture FROM pk WHERE rn = 1"""


@plan("rank_ensemble_with_prior", with_views(PRIOR, "v_comp"))
def rank_ensemble_with_prior(spark, folder):
    """The second ensemble variant: four components, the prior's weight as small as ties allow."""
    names = [*PARTS, "g"]
    rows = view(spark, folder, "v_comp").withColumn("p_g", F.expr(PRIOR_SCORE.replace("CAST((id", "CAST((CAST(id AS BIGINT)"))).where("part = 'validation'")
    most = largest_group(rows, ["realiz"])
    for name in names:
        rows = ranking.rank_normalize(rows, ["realiz"], f"p_{name}", f"rank_{name}", most)
    ranks = {n: f"rank_{n}" for n in names}
    best = ensemble.select_weights(cut(rows), ["realiz"], "label", "id", ranks, STEP, "g", most)
    return best.select("realiz", *[f"w_{n}" for n in names], *r6("average_precision", "capture"))


POISSON_CASE = "CASE " + " ".join(f"WHEN u >= CAST({step!r} AS DOUBLE) THEN {count}" for count, step in reversed(list(enumerate(stats.POISSON_STEPS, start=1)))) + " ELSE 0 END"
SCORED = ["average_precision", "roc_auc", "brier", "balanced_accuracy", "mcc", "precision", "recall", "f1"]
TOP = [f"top_{100 * f:02.0f}pct_{kind}" for f in (0.01, 0.05, 0.1) for kind in ("capture", "precision")]
AXIS = ["average_precision", "roc_auc", "mcc", "recall", "precision", "f1", "brier"]  # summed up by axis (fixed choice)
LONG = RANKED + ", " + CELLS[1:] + """, sm AS (SELECT realiz, model, CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN brier END AS brier,
 coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
 (coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / (CASE WHEN tp + fn > 0 THEN 1 ELSE 0 END + CASE WHEN tn + fp > 0 THEN 1 ELSE 0 END) AS balanced_accuracy,
 coalesce((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / nullif(sqrt(CAST(tp + fp AS DOUBLE)) * sqrt(CAST(tp + fn AS DOUBLE)) * sqrt(CAST(tn + fp AS DOUBLE)) * sqrt(CAST(tn + fn AS DOUBLE)), 0), 0) AS mcc FROM q),
 ol AS (SELECT *, row_number() OVER (PARTITION BY realiz, model ORDER BY probability DESC, id) AS rn FROM v_pred),
 kl AS (SELECT realiz, model, tp + fn AS tp, f, CAST(greatest(1, ceil(n * f)) AS BIGINT) AS k FROM q, (VALUES (CAST(0.01 AS DOUBLE)), (CAST(0.05 AS DOUBLE)), (CAST(0.1 AS DOUBLE))) AS v(f)),
 hl AS (SELECT kl.realiz, kl.model, f, k, tp, CAST(sum(label) AS BIGINT) AS hit FROM kl JOIN ol ON ol.realiz = kl.realiz AND ol.model = kl.model AND rn <= k GROUP BY ALL),
 lg AS (SELECT realiz, model, 'average_precision' AS metric, ap AS value FROM m UNION ALL SELECT realiz, model, 'roc_auc', auc FROM m""" + "".join(
    f" UNION ALL SELECT realiz, model, '{c}', {c} FROM sm" for c in SCORED[2:]) + """
   UNION ALL SELECT realiz, model, 'top_' || lpad(CAST(CAST(100 * f AS INT) AS VARCHAR), 2, '0') || 'pct_capture', hit / greatest(1, tp) FROM hl
   UNION ALL SELECT realiz, model, 'top_' || lpad(CAST(CAST(100 * f AS INT) AS VARCHAR), 2, '0') || 'pct_precision', hit / k FROM hl)"""


def wide_metrics(spark, folder):
    """All metrics of every run, one row a run."""
    pred = view(spark, folder, "v_pred")
    cells = classify.threshold_metrics(pred, RUN, "probability", "label").select(*RUN, *SCORED[2:])
    named = F.concat(F.lit("top_"), F.lpad(F.round(F.col("fraction") * 100).cast("int").cast("string"), 2, "0"), F.lit("pct"))
    top = ranking.top_fraction(pred, RUN, "probability", "label", "id").withColumn("_f", named)
    top = top.groupBy(*RUN).agg(*[F.max(F.when(F.col("_f") == name.rsplit("_", 1)[0], F.col(name.rsplit("_", 1)[1]))).alias(name) for name in TOP])
    return cut(metrics(spark, folder).select(*RUN, *SCORED[:2]).join(cells, RUN).join(top, RUN))


INTERVALS = f"""u AS (SELECT realiz, model, rep, ('0x' || substr(md5('2026|poisson|' || model || '|' || rep || '|' || realiz), 1, 13))::BIGINT / CAST(4503599627370496 AS DOUBLE) AS u FROM m, range(10000) AS t(rep)),
 pw AS (SELECT realiz, model, rep, {POISSON_CASE} AS w FROM u),
 bm AS (SELECT model, metric, rep, sum(w * value) / nullif(sum(w) FILTER (value IS NOT NULL), 0) AS mean FROM lg JOIN pw USING (realiz, model) GROUP BY model, metric, rep),
 bq AS (SELECT model, metric, quantile_cont(mean, 0.025) AS ci_low, quantile_cont(mean, 0.975) AS ci_high FROM bm GROUP BY model, metric)"""


@plan("metric_summary_long", with_views(LONG + ", " + INTERVALS + """ SELECT model, metric, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd,
 round(quantile_cont(value, 0.25), 6) AS q1, round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, round(max(ci_low), 6) AS ci_low, round(max(ci_high), 6) AS ci_high
 FROM lg JOIN bq USING (model, metric) GROUP BY model, metric""", "v_pred"))
def metric_summary_long(spark, folder):
    """Eight metrics and the captures and precisions at three depths, each with its bootstrap interval."""
    wide = wide_metrics(spark, folder)
    rows = wide.unpivot(RUN, [*SCORED, *TOP], "metric", "value")
    summary = stats.metric_summary(rows, ["model", "metric"], "value")
    intervals = stats.bootstrap_means_ci(wide, ["model"], [*SCORED, *TOP], "realiz")
    return summary.join(intervals, ["model", "metric"], "left").select("model", "metric", "n", *r6("mean", "sd", "q1", "median", "q3", "ci_low", "ci_high"))


@plan("axis_summary", with_views(LONG + f""" SELECT CASE WHEN realiz < 5 THEN 'first' ELSE 'second' END AS axis, model AS variant, metric, count(value) AS n, round(avg(value), 6) AS mean,
 round(stddev_samp(value), 6) AS sd, round(min(value), 6) AS min, round(max(value), 6) AS max FROM lg WHERE metric IN ({", ".join(repr(x) for x in AXIS)}) GROUP BY ALL""", "v_pred"))
def axis_summary(spark, folder):
    rows = wide_metrics(spark, folder).unpivot(RUN, AXIS, "metric", "value")
    rows = rows.withColumn("axis", F.when(F.col("realiz") < 5, "first").otherwise("second"))
    return rows.groupBy("axis", F.col("model").alias("variant"), "metric").agg(
        F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"),
        F.round(F.min("value"), 6).alias("min"), F.round(F.max("value"), 6).alias("max"))


TARGET = "click"
DIFFS = """+vm AS (SELECT realiz, model, round(metric, 9) AS metric FROM v_metric),
 df AS (SELECT b.model AS baseline, a.realiz, a.metric - b.metric AS diff FROM vm a JOIN vm b ON a.realiz = b.realiz AND a.model = 'click' AND b.model <> 'click'),
 nz AS (SELECT *, abs(diff) AS size FROM df WHERE diff <> 0),
 sr AS (SELECT *, rank() OVER (PARTITION BY baseline ORDER BY size) + (count(*) OVER (PARTITION BY baseline, size) - 1) / 2.0 AS rk FROM nz)"""
WILCOXON = DIFFS + """, ob AS (SELECT baseline, count(*) AS n, least(sum(CASE WHEN diff > 0 THEN rk ELSE 0 END), sum(CASE WHEN diff < 0 THEN rk ELSE 0 END)) AS w FROM sr GROUP BY baseline),
 ix AS (SELECT baseline, rk, row_number() OVER (PARTITION BY baseline ORDER BY realiz) - 1 AS pos FROM sr),
 mk AS (SELECT ob.baseline, ob.n, ob.w, mask, sum(CASE WHEN (mask >> pos) & 1 = 1 THEN rk ELSE 0 END) AS s FROM ob, range(1024) AS t(mask), ix WHERE ix.baseline = ob.baseline AND mask < (1 << n) GROUP BY ALL),
 wx AS (SELECT baseline, n, CAST(w AS DOUBLE) AS statistic, least(1, 2.0 * count(*) FILTER (s <= w) / count(*)) AS p_raw FROM mk GROUP BY baseline, n, w)"""


def metric_table(spark, folder):
    return view(spark, folder, "v_metric").withColumn("metric", F.round("metric", 9))


def click_diffs(spark, folder):
    return stats.paired_differences(metric_table(spark, folder), "realiz", "model", "metric", TARGET)


@plan("wilcoxon_exact", with_views(WILCOXON + " SELECT baseline, n, statistic, round(p_raw, 6) AS p_raw FROM wx", "v_metric"))
def wilcoxon_exact(spark, folder):
    return stats.wilcoxon(click_diffs(spark, folder), ["baseline"], "exact").select("baseline", "n", "statistic", *r6("p_raw"))


@plan("holm_adjust", with_views(WILCOXON + """, ho AS (SELECT *, least(1, (count(*) OVER () - row_number() OVER (ORDER BY p_raw, baseline) + 1) * p_raw) AS raw FROM wx)
 SELECT baseline, round(p_raw, 6) AS p_raw, round(max(raw) OVER (ORDER BY p_raw, baseline ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM ho""", "v_metric"))
def holm_adjust(spark, folder):
    tests = stats.wilcoxon(click_diffs(spark, folder), ["baseline"], "exact")
    return stats.holm(tests, [], "p_raw", "baseline").select("baseline", *r6("p_raw", "p_holm"))


@plan("signed_rank_biserial", with_views(DIFFS + """ SELECT baseline, round(sum(CASE WHEN diff > 0 THEN rk ELSE -rk END) / sum(rk), 6) AS rank_biserial FROM sr GROUP BY baseline""", "v_metric"))
def signed_rank_biserial(spark, folder):
    return stats.rank_biserial(click_diffs(spark, folder), ["baseline"]).select("baseline", *r6("rank_biserial"))


@plan("friedman", with_views("""+vm AS (SELECT realiz, model, round(metric, 9) AS metric FROM v_metric), kk AS (SELECT count(DISTINCT model) AS k FROM vm),
 fb AS (SELECT realiz FROM vm, kk GROUP BY realiz, k HAVING count(*) = k),
 rk AS (SELECT vm.*, rank() OVER (PARTITION BY realiz ORDER BY metric) + (count(*) OVER (PARTITION BY realiz, metric) - 1) / 2.0 AS r FROM vm JOIN fb USING (realiz)),
 rs AS (SELECT model, sum(r) AS s, count(*) AS n FROM rk GROUP BY model),
 ti AS (SELECT sum(t * t * t - t) AS ties FROM (SELECT count(*) AS t FROM rk GROUP BY realiz, metric)),
 st AS (SELECT count(*) AS k, max(n) AS n, sum(s * s) AS ss FROM rs),
 fs AS (SELECT k AS n_models, n AS n_blocks, (12.0::DOUBLE / (n * k * (k + 1)) * ss - 3 * n * (k + 1)) / (1 - ties / CAST(n * k * (k * k - 1) AS DOUBLE)) AS x FROM st, ti)
 SELECT n_models, n_blocks, round(x, 6) AS statistic, round(exp(-x / 2) * (1 + x / 2), 6) AS p_value FROM fs""", "v_metric"))
def friedman(spark, folder):
    return stats.friedman(metric_table(spark, folder), "realiz", "model", "metric").select("n_models", "n_blocks", *r6("statistic", "p_value"))


@plan("paired_diff", with_views(DIFFS + """ SELECT baseline, count(*) AS n, round(avg(diff), 6) AS mean_diff, round(median(diff), 6) AS median_diff,
 round(quantile_cont(diff, 0.25), 6) AS q1_diff, round(quantile_cont(diff, 0.75), 6) AS q3_diff FROM df GROUP BY baseline""", "v_metric"))
def paired_diff(spark, folder):
    return stats.difference_summary(click_diffs(spark, folder), ["baseline"]).select("baseline", "n", *r6("mean_diff", "median_diff", "q1_diff", "q3_diff"))


@plan("jarque_bera", with_views("""+a AS (SELECT model, count(*) AS n, avg(metric) AS m FROM v_metric GROUP BY model),
 b AS (SELECT v.model, n, avg((metric - m) * (metric - m)) AS m2, avg(pow(metric - m, 3)) AS m3, avg(pow(metric - m, 4)) AS m4 FROM v_metric v JOIN a USING (model) GROUP BY v.model, n),
 j AS (SELECT model, n, CASE WHEN n >= 3 AND m2 > 0 THEN n / 6.0 * (m3 * m3 / pow(m2, 3) + pow(m4 / (m2 * m2) - 3, 2) / 4) END AS jb FROM b)
 SELECT model, n, round(jb, 6) AS statistic, round(exp(-jb / 2), 6) AS p_value FROM j""", "v_metric"))
def jarque_bera(spark, folder):
    return stats.jarque_bera(view(spark, folder, "v_metric"), ["model"], "metric").select("model", "n", *r6("statistic", "p_value"))


@plan("bootstrap_ci", with_views(f"""+u AS (SELECT model, metric, rep, ('0x' || substr(md5('2026|poisson|' || model || '|' || rep || '|' || realiz), 1, 13))::BIGINT / CAST(4503599627370496 AS DOUBLE) AS u FROM v_metric, range(10000) AS t(rep)),
 w AS (SELECT *, {POISSON_CASE} AS w FROM u),
 d AS (SELECT model, rep, sum(w * metric) / nullif(sum(w), 0) AS mean FROM w GROUP BY model, rep),
 q AS (SELECT model, quantile_cont(mean, 0.025) AS ci_low, quantile_cont(mean, 0.975) AS ci_high FROM d GROUP BY model)
 SELECT model, count(*) AS n, round(avg(metric), 6) AS mean, round(max(ci_low), 6) AS ci_low, round(max(ci_high), 6) AS ci_high FROM v_metric JOIN q USING (model) GROUP BY model""", "v_metric"))
def bootstrap_ci(spark, folder):
    out = stats.bootstrap_mean_ci(view(spark, folder, "v_metric"), ["model"], "metric", "realiz")
    return out.select("model", "n", *r6("mean", "ci_low", "ci_high"))


@plan("ranking_gaps", with_views(RANKED + """, a AS (SELECT model, avg(ap) AS v FROM m GROUP BY model)
 SELECT a.model AS better, b.model AS worse, round(a.v - b.v, 6) AS gap FROM a JOIN a b ON a.v > b.v""", "v_pred"))
def ranking_gaps(spark, folder):
    per_run = metrics(spark, folder)
    means = per_run.groupBy("model").agg(F.avg("average_precision").alias("v"))
    return coverage.ranking_gaps(means, "model", "v").select("better", "worse", *r6("gap"))


@plan("ensemble_mean_std", with_views("""+z AS (SELECT 1) SELECT cell, count(probability) AS members, round(avg(probability), 9) AS mean, round(coalesce(stddev_samp(probability), 0), 9) AS std FROM v_member GROUP BY cell""", "v_member"))
def ensemble_mean_std(spark, folder):
    return ensemble.member_moments(view(spark, folder, "v_member"), ["cell"], "probability").select(
        "cell", "members", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@plan("member_ranges", with_views("""+z AS (SELECT 1) SELECT member, count(probability) AS cells, round(min(probability), 6) AS min, round(max(probability), 6) AS max, round(avg(probability), 6) AS mean FROM v_member GROUP BY member""", "v_member"))
def member_ranges(spark, folder):
    return ensemble.member_ranges(view(spark, folder, "v_member"), "member", "probability").select("member", "cells", *r6("min", "max", "mean"))


KEY_SQL = "+k AS (SELECT id, realiz, score, label, x, y, printf('%.3f', x % 1000) || '|' || printf('%.3f', y % 1000) AS key FROM v_point)"


def keyed_points(spark, folder):
    return view(spark, folder, "v_point").withColumn("key", point_key(F.col("x") % 1000, F.col("y") % 1000))


# One realization without any score, and one without a name.
BLANK = "SELECT CAST(NULL AS DOUBLE) AS score, 77 AS realiz FROM {t} WHERE id % 50 = 0 UNION ALL SELECT score, CAST(NULL AS INT) AS realiz FROM {t} WHERE id % 50 = 0"


@plan("distribution_summary", with_views("+pt AS (SELECT score, realiz FROM v_point UNION ALL " + BLANK.format(t="v_point") + """) SELECT realiz, count(score) AS n, round(avg(score), 6) AS mean, round(median(score), 6) AS median, round(quantile_cont(score, 0.05), 6) AS p05,
 round(quantile_cont(score, 0.25), 6) AS p25, round(quantile_cont(score, 0.75), 6) AS p75, round(quantile_cont(score, 0.95), 6) AS p95, round(min(score), 6) AS min, round(max(score), 6) AS max FROM pt GROUP BY realiz""", "v_point"))
def distribution_summary(spark, folder):
    points = view(spark, folder, "v_point")
    blank = spark.sql(BLANK.format(t="{points}"), points=points)
    return coverage.distribution_summary(points.select("score", "realiz").unionByName(blank), ["realiz"], "score").select(
        "realiz", "n", *r6("mean", "median", "p05", "p25", "p75", "p95", "min", "max"))


@plan("coverage_summary", with_views("""+z AS (SELECT 1) SELECT realiz, count(*) AS rows, count(DISTINCT floor(x / 1000) * 1000 + floor(y / 1000)) AS cells FROM v_point GROUP BY realiz""", "v_point"))
def coverage_summary(spark, folder):
    points = view(spark, folder, "v_point").withColumn("cell", cell_id(F.col("x"), F.col("y"), 1000.0))
    return coverage.coverage_summary(points, ["realiz"], "cell")


@plan("ecdf", with_views("""+z AS (SELECT 1) SELECT realiz, id, score, round(row_number() OVER (PARTITION BY realiz ORDER BY score, id) / count(*) OVER (PARTITION BY realiz), 6) AS ecdf FROM v_point""", "v_point"))
def ecdf(spark, folder):
    return curves.ecdf(view(spark, folder, "v_point"), ["realiz"], "score", "id").select("realiz", "id", "score", *r6("ecdf"))


@plan("pairwise_jaccard", with_views(KEY_SQL + """, s AS (SELECT DISTINCT realiz, key FROM k), n AS (SELECT realiz, count(*) AS n FROM s GROUP BY realiz),
 i AS (SELECT a.realiz AS a, b.realiz AS b, count(*) AS shared FROM s a JOIN s b ON a.key = b.key AND a.realiz < b.realiz GROUP BY ALL)
 SELECT x.realiz AS a, y.realiz AS b, x.n AS n_a, y.n AS n_b, coalesce(shared, 0) AS shared, round(coalesce(shared, 0) / (x.n + y.n - coalesce(shared, 0)), 6) AS jaccard
 FROM n x JOIN n y ON x.realiz < y.realiz LEFT JOIN i ON i.a = x.realiz AND i.b = y.realiz""", "v_point"))
def pairwise_jaccard(spark, folder):
    return coverage.pairwise_jaccard(keyed_points(spark, folder), "realiz", "key").select("a", "b", "n_a", "n_b", "shared", *r6("jaccard"))


@plan("overlap_with_original", with_views(KEY_SQL + """, s AS (SELECT DISTINCT realiz, key FROM k WHERE label = 0), o AS (SELECT DISTINCT key FROM k WHERE label = 1), t AS (SELECT count(*) AS n_original FROM o),
 f AS (SELECT realiz, count(*) AS n, count(o.key) AS shared FROM s LEFT JOIN o USING (key) GROUP BY realiz)
 SELECT realiz, n, n_original, shared, round(shared / (n + n_original - shared), 6) AS jaccard FROM f, t""", "v_point"))
def overlap_with_original(spark, folder):
    points = keyed_points(spark, folder)
    out = coverage.overlap_with(points.where(F.col("label") == 0), points.where(F.col("label") == 1), "realiz", "key")
    return out.select("realiz", "n", "n_original", "shared", *r6("jaccard"))
