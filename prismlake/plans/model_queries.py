"""More registered queries: diagnostics, calibration, validation, selection, side tables, sanitising.

SQL follows a one-component model from the data on; models of more components have no SQL and are held
against numpy versions in the tests."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.functions import rowlocal as R
from prismlake.functions import titles
from prismlake.operators import attribution, benchmark, diagnostics, holdout, hull, latent, metrics, oneclass, pipeline, preprocess, quantify, resampling, selection, splits, validation
from prismlake.operators.gram import moments
from prismlake.plans.catalog import _PAIRS, _SC, _TITLE, E, P, WN, _folded, _pairs, _pca, _scores, _titles, query
from prismlake.schema import embeddings_as_spectra, to_long
from prismlake.sources import folders

#: One component of PLS on conc: m means, y mean, w weights, t scores, pl loadings, q.
_PLS = f"""{E}, m AS (SELECT j, avg(v) AS m FROM e GROUP BY j), y AS (SELECT avg(conc) AS y FROM e WHERE j = 0),
c AS (SELECT j, sum((v - m) * (conc - y)) AS c FROM e JOIN m USING (j), y GROUP BY j), w AS (SELECT j, c / sqrt(sum(c * c) OVER ()) * sign(first_value(c) OVER (ORDER BY abs(c) DESC)) AS w FROM c),
t AS (SELECT sample_id, label, conc, sum((v - m) * w) AS t FROM e JOIN m USING (j) JOIN w USING (j) GROUP BY ALL), tt AS (SELECT sum(t * t) AS tt FROM t),
pl AS (SELECT j, sum((v - m) * t) / any_value(tt) AS p FROM e JOIN m USING (j) JOIN t USING (sample_id), tt GROUP BY j), q AS (SELECT sum(t * (t.conc - y)) / any_value(tt) AS q FROM t, tt, y)"""


def _one(spark, d, a=1):
    e = embeddings_as_spectra(spark, d)
    m = diagnostics.whole(e, F.array("conc"))
    return e, m, latent.fit_pls(m, P, a)


@query("explained_variance", f"WITH {_PLS}, s AS (SELECT sum((v - m) * (v - m)) AS s FROM e JOIN m USING (j)) SELECT 1 AS component, round(100 * tt / s, 6) AS percent FROM tt, s")
def explained_variance(spark, d):
    _, m, model = _one(spark, d)
    return spark.createDataFrame([(1, round(float(diagnostics.explained_variance(model, m, P)[0]), 6))], "component int, percent double")


@query("model_metrics", f"""WITH {_PLS}, s AS (SELECT sum((v - m) * (v - m)) AS s FROM e JOIN m USING (j)), p AS (SELECT sum(p * p) AS pp FROM pl), r AS (SELECT sum((conc - y - q * t) ** 2) AS r, sum((conc - y) ** 2) AS ss FROM t, q, y)
SELECT round(tt * pp / s, 8) AS r2x, round(1 - r / ss, 8) AS r2y FROM tt, s, p, r""")
def model_metrics(spark, d):
    _, m, model = _one(spark, d)
    v = diagnostics.model_metrics(model, 1, m, P)
    return spark.createDataFrame([(round(v["r2x"], 8), round(v["r2y"], 8))], "r2x double, r2y double")


@query("dmodx", f"""WITH {_PLS}, r AS (SELECT sample_id, sum((v - m - t * p) ** 2) AS q FROM e JOIN m USING (j) JOIN pl USING (j) JOIN t USING (sample_id) GROUP BY sample_id), s AS (SELECT sqrt(sum(q) / ((count(*) - 2) * 63)) AS s FROM r)
SELECT sample_id, round(sqrt(q / 63) / s, 6) AS dmodx FROM r, s""")
def dmodx(spark, d):
    e, _, model = _one(spark, d)
    rows = e.select("sample_id", diagnostics.x_residual(model, F.col("x"), 1).alias("q"))
    return diagnostics.dmodx(rows, "q", P, 1).select("sample_id", F.round("dmodx", 6).alias("dmodx"))


@query("dmody", f"WITH {_PLS}, r AS (SELECT sample_id, conc - y - q * t AS r FROM t, q, y), s AS (SELECT sqrt(sum(r * r) / (count(*) - 2)) AS s FROM r) SELECT sample_id, round(abs(r) / s, 6) AS dmody FROM r, s")
def dmody(spark, d):
    e, _, model = _one(spark, d)
    rows = e.select("sample_id", (F.col("conc") - model.predict(F.col("x"), 1)[0]).alias("r"))
    return diagnostics.dmody(rows, F.col("r"), 1).select("sample_id", F.round("dmody", 6).alias("dmody"))


@query("vip_one_component", f"WITH {_PLS}, b AS (SELECT j, var_samp(v) AS vv, any_value(p) AS p, any_value(w) AS w FROM e JOIN pl USING (j) JOIN w USING (j) GROUP BY j), n AS (SELECT count(*) AS n FROM t) SELECT j, round(sqrt(64 * w * w), 6) AS vip, round(tt * p * p / (n - 1) / greatest(vv - tt * p * p / (n - 1), 1e-12), 6) AS sr FROM b, tt, n")
def vip_one_component(spark, d):
    _, m, model = _one(spark, d)
    both = zip(latent.vip(model, 1), latent.selectivity_ratio(model, 1, m, P), strict=True)
    return spark.createDataFrame([(j, round(float(v), 6), round(float(s), 6)) for j, (v, s) in enumerate(both)], "j long, vip double, sr double")


@query("score_contributions", f"WITH {_PLS} SELECT e.label, j, round(avg(v * w), 8) + 0.0 AS mean, round(stddev_samp(v * w) / sqrt(count(*)), 8) AS se FROM e JOIN w USING (j) GROUP BY e.label, j")
def score_contributions(spark, d):
    e, _, model = _one(spark, d)
    c = diagnostics.score_contributions(e, model.w[:, 0])
    return c.select("label", F.col("j").cast("long").alias("j"), (F.round("mean", 8) + 0.0).alias("mean"), F.round("se", 8).alias("se"))


@query("discriminant_power", f"WITH {_PLS}, k AS (SELECT e.label, j, avg(v * w) AS m FROM e JOIN w USING (j) GROUP BY e.label, j), p AS (SELECT j, var_pop(m) AS power FROM k GROUP BY j) SELECT j, round(power, 10) AS power FROM p ORDER BY power DESC, j LIMIT 10")
def discriminant_power(spark, d):
    e, _, model = _one(spark, d)
    power = diagnostics.discriminant_power(diagnostics.score_contributions(e, model.w[:, 0]))
    return diagnostics.top(power, "power", 10, "j").select(F.col("j").cast("long").alias("j"), F.round("power", 10).alias("power"))


_OPLS = f"""{_PLS}, a AS (SELECT sum(p * w) AS pw FROM pl JOIN w USING (j)), wo0 AS (SELECT j, p - pw * w AS o FROM pl JOIN w USING (j), a), wo AS (SELECT j, o / sqrt(sum(o * o) OVER ()) AS o FROM wo0),
raw AS (SELECT sample_id, sum((v - m) * o) AS u FROM e JOIN m USING (j) JOIN wo USING (j) GROUP BY sample_id), g AS (SELECT sum(u * t) / any_value(tt) AS g FROM raw JOIN t USING (sample_id), tt),
ot AS (SELECT sample_id, u - g * t AS o FROM raw JOIN t USING (sample_id), g), oo AS (SELECT sum(o * o) AS oo FROM ot), po AS (SELECT j, sum((v - m) * o) / any_value(oo) AS po FROM e JOIN m USING (j) JOIN ot USING (sample_id), oo GROUP BY j),
xr AS (SELECT sample_id, j, conc, v, v - m - o * po AS r FROM e JOIN m USING (j) JOIN ot USING (sample_id) JOIN po USING (j)), c2 AS (SELECT j, sum(r * (conc - y)) AS c FROM xr, y GROUP BY j),
w2 AS (SELECT j, c / sqrt(sum(c * c) OVER ()) * sign(first_value(c) OVER (ORDER BY abs(c) DESC)) AS w FROM c2), tp AS (SELECT sample_id, sum(r * w) AS t FROM xr JOIN w2 USING (j) GROUP BY sample_id)"""


def _opls(spark, d):
    e = embeddings_as_spectra(spark, d)
    model = diagnostics.fit_opls(diagnostics.whole(e, F.array("conc")), P, 1)
    return e.select("sample_id", "x", model.predictive(F.col("x")).alias("t_predictive"), model.scores(F.col("x"))[0].alias("t_orthogonal"))


@query("opls_scores", f"WITH {_OPLS} SELECT sample_id, round(t, 6) + 0.0 AS t_predictive, round(o, 6) + 0.0 AS t_orthogonal FROM tp JOIN ot USING (sample_id)")
def opls_scores(spark, d):
    return _opls(spark, d).select("sample_id", (F.round("t_predictive", 6) + 0.0).alias("t_predictive"), (F.round("t_orthogonal", 6) + 0.0).alias("t_orthogonal"))


@query("opls_s_plot", f"WITH {_OPLS} SELECT j, round(covar_samp(v, t), 8) + 0.0 AS covariance, round(corr(v, t), 6) + 0.0 AS correlation FROM xr JOIN tp USING (sample_id) GROUP BY j")
def opls_s_plot(spark, d):
    s = diagnostics.s_plot(_opls(spark, d), "t_predictive")
    return s.select(F.col("j").cast("long").alias("j"), (F.round("covariance", 8) + 0.0).alias("covariance"), (F.round("correlation", 6) + 0.0).alias("correlation"))


_FOLDS = f"{E}, h AS (SELECT sample_id, j, conc, v, CAST(('0x' || substr(md5('42:' || group_id), 1, 8)) AS BIGINT) % 5 AS fold FROM e), k AS (SELECT unnest(range(5)) AS f), fm AS (SELECT f, j, avg(v) AS m FROM h JOIN k ON h.fold <> k.f GROUP BY f, j), fy AS (SELECT f, avg(conc) AS y FROM h JOIN k ON h.fold <> k.f WHERE j = 0 GROUP BY f), fc AS (SELECT f, j, sum((v - m) * (conc - y)) AS c FROM h JOIN k ON h.fold <> k.f JOIN fm USING (f, j) JOIN fy USING (f) GROUP BY f, j), fw AS (SELECT f, j, c / sqrt(sum(c * c) OVER (PARTITION BY f)) AS w FROM fc), ft AS (SELECT f, sample_id, any_value(fold) AS fold, any_value(conc) AS conc, any_value(y) AS y, sum((v - m) * w) AS t FROM h CROSS JOIN k JOIN fm USING (f, j) JOIN fy USING (f) JOIN fw USING (f, j) GROUP BY f, sample_id), fq AS (SELECT f, sum(t * (conc - y)) / sum(t * t) AS q FROM ft WHERE fold <> f GROUP BY f)"


@query("cv_error_one_component", f"WITH {_FOLDS}, r AS (SELECT conc - y - q * t AS r, conc FROM ft JOIN fq USING (f) WHERE fold = f) SELECT 1 AS components, round(sqrt(avg(r * r)), 6) AS rmsecv, round(1 - sum(r * r) / (var_pop(conc) * count(*)), 6) AS q2 FROM r")
def cv_error_one_component(spark, d):
    rows = splits.hashed_folds(embeddings_as_spectra(spark, d), 5).withColumn("y", F.array("conc"))
    return spark.createDataFrame([(a, round(e, 6), round(q, 6)) for a, e, q in latent.lv_curve(rows, P, 1)], "components int, rmsecv double, q2 double")


@query("jackknife_one_component", f"""WITH {_FOLDS}, {_PLS.replace(E + ', ', '').replace('q AS', 'q0 AS')}, b AS (SELECT f, j, w * q AS b FROM fw JOIN fq USING (f)), s AS (SELECT j, sqrt(4.0 / 5 * (count(*) * var_pop(b))) AS se FROM b GROUP BY j)
SELECT j, round(w * q, 7) + 0.0 AS coefficient, round(se, 7) AS se FROM s JOIN w USING (j), q0""")
def jackknife_one_component(spark, d):
    rows = splits.hashed_folds(embeddings_as_spectra(spark, d), 5).withColumn("y", F.array("conc"))
    t = spark.createDataFrame(resampling.martens(rows, P, 1))
    return t.select("j", (F.round("coefficient", 7) + 0.0).alias("coefficient"), F.round("se", 7).alias("se"))


@query("ellipses", f"""WITH {E}, s AS (SELECT sample_id, label, sum(v) FILTER (j = 0) AS a, sum(v) FILTER (j = 1) AS b FROM e GROUP BY ALL), g AS (SELECT label, count(*) AS n, avg(a) AS ca, avg(b) AS cb, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS c FROM s GROUP BY label),
h AS (SELECT *, (va + vb) / 2 + sqrt(((va - vb) / 2) ** 2 + c * c) AS hi, (va + vb) / 2 - sqrt(((va - vb) / 2) ** 2 + c * c) AS lo FROM g)
SELECT label, n, round(ca, 8) + 0.0 AS centre_a, round(cb, 8) + 0.0 AS centre_b, CASE WHEN n >= 4 THEN round(sqrt(hi * 5.991464547107979), 7) END AS major, CASE WHEN n >= 4 THEN round(sqrt(lo * 5.991464547107979), 7) END AS minor FROM h""")
def ellipses(spark, d):
    s = embeddings_as_spectra(spark, d).select("label", F.get("x", F.lit(0)).alias("a"), F.get("x", F.lit(1)).alias("b"))
    g = diagnostics.ellipse(s, "a", "b", "label")
    return g.select("label", "n", *((F.round(c, 8) + 0.0).alias(c) for c in ("centre_a", "centre_b")), *(F.round(c, 7).alias(c) for c in ("major", "minor")))


@query("mad_flags", f"""WITH {E}, s AS (SELECT sample_id, label, sum(v) FILTER (j = 3) AS a FROM e GROUP BY ALL), m AS (SELECT label, quantile_cont(a, 0.5) AS m FROM s GROUP BY label), d AS (SELECT label, quantile_cont(abs(a - m), 0.5) AS d FROM s JOIN m USING (label) GROUP BY label)
SELECT sample_id, label, d > 0 AND 0.6745 * abs(a - m) / d > 2 AS flagged FROM s JOIN m USING (label) JOIN d USING (label)""")
def mad_flags(spark, d):
    s = embeddings_as_spectra(spark, d).select("sample_id", "label", F.get("x", F.lit(3)).alias("a"))
    return diagnostics.mad_outliers(s, ["a"], "label", limit=2.0).select("sample_id", "label", "flagged")


@query("outlier_union", f"WITH {E}, s AS (SELECT sample_id, sum(v) FILTER (j = 3) AS a, sum(v) FILTER (j = 4) AS b FROM e GROUP BY ALL) SELECT sample_id FROM s WHERE a > 0.15 OR b > 0.15")
def outlier_union(spark, d):
    s = embeddings_as_spectra(spark, d).select("sample_id", F.get("x", F.lit(3)).alias("a"), F.get("x", F.lit(4)).alias("b"))
    return diagnostics.outlier_union(s, {"a": 0.15, "b": 0.15}).select("sample_id")


@query("outlier_shares", f"WITH {E} SELECT label, round(avg(CAST(v > 0.15 AS INT)), 9) AS share, avg(CAST(v > 0.15 AS INT)) > 0.1 AS many FROM e WHERE j = 3 GROUP BY label")
def outlier_shares(spark, d):
    s = embeddings_as_spectra(spark, d).select("label", F.get("x", F.lit(3)).alias("a"))
    return diagnostics.outlier_shares(s, "a", 0.15, 0.1).withColumn("share", F.round("share", 9))


@query("class_pairs", "WITH c AS (SELECT DISTINCT CAST(label AS VARCHAR) AS c FROM embeddings) SELECT a.c AS a, b.c AS b FROM c a JOIN c b ON a.c < b.c ORDER BY 1, 2 LIMIT 6")
def class_pairs(spark, d):
    return diagnostics.class_pairs(embeddings_as_spectra(spark, d))


@query("cooman", f"""WITH {E}, m AS (SELECT label AS model, j, avg(v) AS m FROM e GROUP BY ALL), q AS (SELECT sample_id, label, model, sum((v - m) ** 2) AS q FROM e JOIN m USING (j) WHERE model IN ('1', '2') GROUP BY ALL), l AS (SELECT model, avg(q) AS q_limit FROM q WHERE label = model GROUP BY model)
SELECT sample_id, label, round(max(sqrt(q / q_limit)) FILTER (model = '1'), 7) AS x, round(max(sqrt(q / q_limit)) FILTER (model = '2'), 7) AS y FROM q JOIN l USING (model) GROUP BY sample_id, label""")
def cooman(spark, d):
    e = embeddings_as_spectra(spark, d)
    means = to_long(e.select("label", "x")).where("label in ('1', '2')").groupBy(F.col("label").alias("model"), "j").agg(F.avg("v").alias("m"))
    q = to_long(e.select("sample_id", "label", "x")).join(means, "j").groupBy("sample_id", "label", "model").agg(F.sum((F.col("v") - F.col("m")) ** 2).alias("q"))
    limits = q.where("label = model").groupBy("model").agg(F.avg("q").alias("q_limit"))
    c = diagnostics.cooman(q.join(limits, "model"), "1", "2")
    return c.select("sample_id", "label", F.round("x", 7).alias("x"), F.round("y", 7).alias("y"))


@query("confusion_table", f"WITH {_PAIRS}, c AS (SELECT label AS c FROM pairs UNION SELECT predicted FROM pairs) SELECT a.c AS label, b.c AS predicted, count(p.sample_id) AS n, round(count(p.sample_id) / nullif((SELECT count(*) FROM pairs x WHERE x.label = a.c), 0), 9) AS share FROM c a CROSS JOIN c b LEFT JOIN pairs p ON p.label = a.c AND p.predicted = b.c GROUP BY a.c, b.c")
def confusion_table(spark, d):
    return metrics.confusion_table(_pairs(spark, d)).withColumn("share", F.round("share", 9))


_DET = f"""{_SC}, a AS (SELECT target, score, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS q FROM sc GROUP BY ALL),
b AS (SELECT target, score, 1 - sum(p) OVER w / sum(p) OVER (PARTITION BY target) AS miss, sum(q) OVER w / sum(q) OVER (PARTITION BY target) AS alarm FROM a WINDOW w AS (PARTITION BY target ORDER BY score DESC))"""


@query("det_curve", f"WITH {_DET} SELECT target AS label, score, round(miss, 9) AS miss, round(alarm, 9) AS alarm FROM b")
def det_curve(spark, d):
    return metrics.det_curve(_scores(spark, d)).select("label", "score", F.round("miss", 9).alias("miss"), F.round("alarm", 9).alias("alarm"))


@query("det_at", f"WITH {_DET}, g AS (SELECT DISTINCT target, unnest([0.01, 0.05, 0.2]) AS t FROM b) SELECT b.target AS label, CAST(t AS DOUBLE) AS alarm, round(coalesce(min(miss) FILTER (alarm <= t), 1), 9) AS miss FROM g JOIN b USING (target) GROUP BY b.target, t")
def det_at(spark, d):
    return metrics.det_at(metrics.det_curve(_scores(spark, d)), [0.01, 0.05, 0.2]).withColumn("miss", F.round("miss", 9))


@query("clip_normalize", f"WITH {E}, c AS (SELECT sample_id, j, greatest(0, least(1, v)) AS v FROM e) SELECT sample_id, j, round(v / nullif(sum(v) OVER (PARTITION BY sample_id), 0), 8) AS v FROM c")
def clip_normalize(spark, d):
    x = embeddings_as_spectra(spark, d).select("sample_id", R.clip_normalize(F.col("x")).alias("x"))
    return to_long(x).select("sample_id", F.col("j").cast("long").alias("j"), F.round("v", 8).alias("v"))


@query("majority_class", "WITH n AS (SELECT 'g' || (vec_id // 7) AS group_id, CAST(label AS VARCHAR) AS label, count(*) AS n FROM embeddings GROUP BY ALL) SELECT group_id, label FROM n QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY n DESC, label) = 1")
def majority_class(spark, d):
    return validation.majority_class(embeddings_as_spectra(spark, d).withColumn("group_id", F.concat(F.lit("g"), F.expr("sample_id div 7"))))


@query("effective_splits", f"WITH {E}, g AS (SELECT label, count(*) AS n, count(DISTINCT group_id) AS g FROM e WHERE j = 0 GROUP BY label) SELECT CAST(greatest(2, least(5, min(n), min(g))) AS INT) AS folds FROM g")
def effective_splits(spark, d):
    return spark.createDataFrame([(validation.effective_splits(embeddings_as_spectra(spark, d), 5),)], "folds int")


@query("stratified_folds", f"WITH {E}, r AS (SELECT sample_id, row_number() OVER (PARTITION BY label ORDER BY md5('42:0:' || sample_id), sample_id) AS r FROM e WHERE j = 0) SELECT sample_id, CAST((r - 1) % 5 AS INT) AS fold FROM r")
def stratified_folds(spark, d):
    return validation.stratified_folds(embeddings_as_spectra(spark, d), 5).select("sample_id", "fold")


_MAJOR = f"{E}, c0 AS (SELECT group_id, label, count(*) AS n FROM e WHERE j = 0 GROUP BY ALL), mj AS (SELECT group_id, label FROM c0 QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY n DESC, label) = 1)"


@query("shuffle_splits", f"WITH {_MAJOR}, r AS (SELECT r, group_id, label, row_number() OVER (PARTITION BY r, label ORDER BY md5('42:' || r || ':' || group_id), group_id) AS k FROM mj, range(10) t(r)), n AS (SELECT label, ceil(count(*) * 0.2) AS take FROM mj GROUP BY label) SELECT CAST(r AS INT) AS round, group_id, label FROM r JOIN n USING (label) WHERE k <= take")
def shuffle_splits(spark, d):
    return validation.shuffle_splits(embeddings_as_spectra(spark, d), 10)


@query("permuted_labels", f"""WITH {_MAJOR}, n AS (SELECT label, CAST(label AS INT) AS k, count(*) AS n FROM mj GROUP BY label), ends AS (SELECT k, sum(n) OVER (ORDER BY k) AS e FROM n), r AS (SELECT r, group_id, row_number() OVER (PARTITION BY r ORDER BY md5('42:' || r || ':' || group_id), group_id) AS rank FROM mj, range(1, 21) t(r))
SELECT group_id, CAST(r AS INT) AS round, CAST((SELECT count(*) FROM ends WHERE e < rank) AS INT) AS k FROM r""")
def permuted_labels(spark, d):
    e = embeddings_as_spectra(spark, d)
    classes = sorted(r[0] for r in e.select("label").distinct().collect())
    return validation.permuted_labels(e, classes, 20).select("group_id", F.posexplode("labels").alias("round", "k")).where("round > 0")


@query("conformal_accepts", f"""WITH {E}, g AS (SELECT label, group_id, quantile_cont(v, 0.5) AS s FROM e WHERE j = 4 GROUP BY ALL), n AS (SELECT label, CAST(ceil(round((count(*) + 1) * 0.9, 9)) AS INT) AS k FROM g GROUP BY label), r AS (SELECT label, s, row_number() OVER (PARTITION BY label ORDER BY s, group_id) AS rank FROM g),
t AS (SELECT n.label, max(s) FILTER (rank = k) AS top FROM n JOIN r USING (label) GROUP BY ALL) SELECT sample_id, coalesce(v <= top, false) AS accepted FROM e JOIN t USING (label) WHERE j = 4""")
def conformal_accepts(spark, d):
    s = embeddings_as_spectra(spark, d).select("sample_id", "label", "group_id", F.get("x", F.lit(4)).alias("score"))
    return oneclass.conformal_accepts(s, oneclass.conformal_threshold(s, 0.1, "group_id", "score", "label"), "score", "label").select("sample_id", "accepted")


@query("interval_summary", "SELECT count(*) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(stddev_pop(v), 6) AS sd, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM (SELECT value AS v FROM events WHERE event_id % 9 <> 0 AND event_id % 11 <> 0)")
def interval_summary(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    v = F.when(F.col("event_id") % 9 == 0, F.lit(None)).when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    s = validation.interval_summary(ev.select(v.alias("v")), "v")
    return s.select("n", *(F.round(c, 6).alias(c) for c in s.columns[1:]))


@query("wold_lines", "WITH p AS (SELECT l_discount * 10 AS s, l_tax * 5 AS r2, (l_quantity - 25) / 50 AS q2 FROM lineitem) SELECT round(regr_intercept(r2, s), 8) AS intercept_r2, round(regr_slope(r2, s), 8) AS slope_r2, round(regr_intercept(q2, s), 8) AS intercept_q2, round(regr_slope(q2, s), 8) AS slope_q2, regr_intercept(r2, s) < 0.4 AS valid_r2, regr_intercept(q2, s) < 0.05 AS valid_q2 FROM p")
def wold_lines(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    p = validation.wold_lines(li.select((F.col("l_discount") * 10).alias("similarity"), (F.col("l_tax") * 5).alias("r2"), ((F.col("l_quantity") - 25) / 50).alias("q2")))
    return p.select(*(F.round(c, 8).alias(c) for c in ("intercept_r2", "slope_r2", "intercept_q2", "slope_q2")), "valid_r2", "valid_q2")


@query("class_exclusion", "SELECT vec_id AS sample_id FROM embeddings WHERE label NOT IN (2, 5)")
def class_exclusion(spark, d):
    return embeddings_as_spectra(spark, d).where(~F.col("label").isin("2", "5")).select("sample_id")


_CONC = "z AS (SELECT vec_id AS sample_id, CAST(label AS VARCHAR) AS label, CASE WHEN vec_id % 13 = 0 THEN NULL ELSE CAST((vec_id // 3) % 9 * 5 AS DOUBLE) END AS conc FROM embeddings)"


def _with_unknown(spark, d):
    return embeddings_as_spectra(spark, d).withColumn("conc", F.when(F.col("sample_id") % 13 != 0, F.col("conc")))


@query("pure_rows", f"WITH {_CONC} SELECT sample_id FROM z WHERE conc IS NULL OR conc = 0")
def pure_rows(spark, d):
    return _with_unknown(spark, d).where(quantify.is_pure()).select("sample_id")


@query("quantifiable", f"WITH {_CONC} SELECT label, count(*) FILTER (conc > 0) AS n, count(*) FILTER (conc > 0) >= 40 AND stddev_pop(conc) >= 1e-8 AS quantifiable FROM z WHERE conc IS NOT NULL GROUP BY label")
def quantifiable(spark, d):
    return quantify.quantifiable(_with_unknown(spark, d), 40)


@query("outside_range", "SELECT p_partkey, p_retailprice NOT BETWEEN 950 AND 1400 AS outside FROM part")
def outside_range(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", quantify.outside_range(F.col("p_retailprice"), 950, 1400).alias("outside"))


@query("class_seen", f"WITH {_PAIRS} SELECT sample_id, predicted AS seen, 'blind' AS mode FROM pairs")
def class_seen(spark, d):
    """Blind mode: a calibration sees the class that was predicted."""
    e = embeddings_as_spectra(spark, d)
    return quantify.class_seen(_pairs(spark, d), e).select("sample_id", "seen", "mode")


@query("blind_levels", f"WITH {_PAIRS}, z AS (SELECT DISTINCT sample_id, conc FROM e) SELECT predicted AS seen, count(*) AS n, round(avg(conc), 9) AS mean_conc, count(DISTINCT conc) AS levels FROM pairs JOIN z USING (sample_id) GROUP BY predicted")
def blind_levels(spark, d):
    s = quantify.class_seen(_pairs(spark, d), embeddings_as_spectra(spark, d))
    return s.groupBy("seen").agg(F.count("*").alias("n"), F.round(F.avg("conc"), 9).alias("mean_conc"), F.countDistinct("conc").alias("levels"))


@query("resolved_titles", f"""WITH {_TITLE}, r AS (SELECT o_orderkey, trim(title) AS s, CASE WHEN o_orderkey % 101 = 0 THEN 'XXX' WHEN valid THEN code END AS code, CASE WHEN o_orderkey % 101 = 0 THEN 'XXX-01-01-2000-A2.50' ELSE group_id END AS group_id FROM k),
a AS (SELECT o_orderkey, s, code, CASE WHEN group_id = 'XXX-01-01-2000-A2.50' THEN 'merged' ELSE group_id END AS group_id FROM r) SELECT o_orderkey, CASE code WHEN 'OAB' THEN 'open' WHEN 'FAB' THEN 'filled' ELSE code END AS label, group_id, CASE WHEN o_orderkey % 103 = 0 THEN 'unsure' END AS excluded FROM a""")
def resolved_titles(spark, d):
    """Titles with corrections, code names, a group alias and exclusions, each from its table."""
    t = _titles(spark, d).withColumn("title", F.concat(F.col("title"), F.when((F.col("o_orderkey") % 101 == 0) | (F.col("o_orderkey") % 103 == 0), F.concat(F.lit("#"), F.col("o_orderkey"))).otherwise("")))
    # the marked titles fit no pattern: corrections and exclusions match them exactly
    plain = _titles(spark, d).select("o_orderkey", F.col("title").alias("plain"))
    marked = t.join(plain, "o_orderkey")
    fixed = titles.parse_title(F.col("plain"))
    corrections = marked.where("o_orderkey % 101 = 0").select("title", F.lit("XXX").alias("code"), F.lit("01-01-2000").alias("date"), F.lit("A").alias("adulterant"), F.lit(2.5).alias("content"), F.lit(1).alias("replicate"))
    corrections = corrections.unionAll(marked.where("o_orderkey % 103 = 0 and o_orderkey % 101 <> 0").where(fixed["valid"]).select("title", *(fixed[k] for k in ("code", "date", "adulterant", "content", "replicate"))))
    names = spark.createDataFrame([("OAB", "open"), ("FAB", "filled")], "code string, name string")
    aliases = spark.createDataFrame([("XXX-01-01-2000-A2.50", "merged")], "source string, target string")
    exclusions = t.where("o_orderkey % 103 = 0").select("title", F.lit("unsure").alias("reason"))
    return folders.resolve_titles(t, names, corrections, aliases, exclusions).select("o_orderkey", "label", "group_id", "excluded")


def _headers(spark, d):
    """Headers made from orders: a folder by priority, a title, an end of range that is missing now and then."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("folder"), F.when(F.col("o_orderkey") % 31 != 0, F.round(F.col("o_totalprice") / 1000)).alias("last_x"))
    return _titles(spark, d).join(o, "o_orderkey")


_HEAD = f"{_TITLE}, hd AS (SELECT substr(o_orderpriority, 1, 1) AS folder, CASE WHEN o_orderkey % 31 <> 0 THEN round(o_totalprice / 1000) END AS last_x, valid, group_id FROM orders JOIN k USING (o_orderkey)), rk AS (SELECT *, round_even(last_x / 100, 0) * 100 AS key FROM hd WHERE last_x IS NOT NULL), mo AS (SELECT key AS mode FROM rk GROUP BY key ORDER BY count(*) DESC, key LIMIT 1)"


@query("prescan", f"WITH {_HEAD} SELECT (SELECT count(*) FROM hd) AS n_files, (SELECT count(*) FROM hd WHERE last_x IS NULL) AS n_no_header, any_value(mode) AS dominant, count(*) FILTER (abs(key - mode) >= 50) AS n_out_of_range, count(*) FILTER (abs(key - mode) < 50) AS n_kept, count(*) FILTER (abs(key - mode) < 50 AND NOT valid) AS n_orphans, count(DISTINCT group_id) FILTER (abs(key - mode) < 50 AND valid) + count(*) FILTER (abs(key - mode) < 50 AND NOT valid) AS n_groups FROM rk, mo")
def prescan(spark, d):
    return folders.prescan(_headers(spark, d))


@query("out_of_range_by_folder", f"WITH {_HEAD} SELECT folder, count(*) AS n FROM rk, mo WHERE abs(key - mode) >= 50 GROUP BY folder")
def out_of_range_by_folder(spark, d):
    return folders.out_of_range(_headers(spark, d))


@query("preview", f"WITH {E}, r AS (SELECT label, sample_id, row_number() OVER (PARTITION BY label ORDER BY lpad(CAST(sample_id AS VARCHAR), 9, '0')) AS r FROM e WHERE j = 0) SELECT label AS folder, sample_id FROM r WHERE r <= 5")
def preview(spark, d):
    s = embeddings_as_spectra(spark, d).select(F.col("label").alias("folder"), F.lpad(F.col("sample_id").cast("string"), 9, "0").alias("path"), "sample_id", "x")
    return folders.preview(s).select("folder", "sample_id")


def _lines(spark, d):
    """Lines of header records made from lineitem: a file for each order, a record for each line."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    kinds = ["##TITLE= x", "##AUDIT-TRAIL= a", "( 1, somebody)", "##$Detector Gain=1", "## owner =me", "##$Detector_Model=7", ""]
    first = li.groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey"))["l_linenumber"].alias("f"))
    kind = F.get(F.lit(kinds), ((F.col("l_linenumber") * 5 + F.col("l_orderkey")) % 7).cast("int"))
    return li.join(first, "l_orderkey").select(F.col("l_orderkey").alias("path"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("n"), kind.alias("line"))


@query("without_provenance", """WITH l AS (SELECT l_orderkey AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n, CAST((l_linenumber * 5 + l_orderkey) % 7 AS INT) AS k FROM lineitem),
o AS (SELECT path, n, k, CASE WHEN k = 6 THEN 0 WHEN k IN (1, 4, 5) THEN 1 WHEN k IN (0, 3) THEN 0 END AS bad FROM l), b AS (SELECT path, k, last_value(bad IGNORE NULLS) OVER (PARTITION BY path ORDER BY n) AS bad FROM o)
SELECT path, ['##TITLE= x', '##AUDIT-TRAIL= a', '( 1, somebody)', '##$Detector Gain=1', '## owner =me', '##$Detector_Model=7', ''][k + 1] AS line, count(*) AS n FROM b WHERE coalesce(bad, 0) = 0 GROUP BY ALL""")
def without_provenance(spark, d):
    return folders.without_provenance(_lines(spark, d)).groupBy("path", "line").agg(F.count("*").alias("n"))


@query("summary_metrics", "SELECT o_orderkey, CAST(o_custkey AS DOUBLE) / 4 AS q2, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 100 AS DOUBLE) / 8 END AS rmsep FROM orders")
def summary_metrics(spark, d):
    """Numbers read back from the text of a summary."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    text = F.concat(F.lit("Model\n  q2 : "), (F.col("o_custkey") / 4).cast("string"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("\nRMSEP="), (F.col("o_orderkey") % 100 / 8).cast("string"))).otherwise("\nnote: RMSEP = 3"))
    t = o.select("o_orderkey", text.alias("text"))
    return t.select("o_orderkey", titles.metric_in(F.col("text"), "Q2").alias("q2"), titles.metric_in(F.col("text"), "rmsep").alias("rmsep"))


@query("name_parts", "SELECT p_partkey, split_part(p_brand, '#', 1) || p_partkey AS code, 'T' || (p_partkey % 3) AS part, CAST(p_size AS DOUBLE) + 0.25 AS content FROM part")
def name_parts(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    path = F.concat(F.lit("/data/a/"), F.split("p_brand", "#")[0], F.col("p_partkey"), F.lit("_T"), F.col("p_partkey") % 3, F.lit("_"), F.col("p_size"), F.lit(",25 %.dx"))
    t = p.select("p_partkey", path.alias("path"))
    return t.select("p_partkey", folders.name_parts(F.col("path")).alias("code"), folders.name_parts(F.col("path"), 1).alias("part"), titles.content_from_name(F.element_at(F.split("path", "/"), -1)).alias("content"))


@query("hash_sample", "SELECT vec_id AS sample_id FROM embeddings ORDER BY md5('11:' || vec_id), vec_id LIMIT 50")
def hash_sample(spark, d):
    """A sample without replacement: the first 50 by a seeded hash."""
    return embeddings_as_spectra(spark, d).select("sample_id").orderBy(F.md5(F.concat(F.lit("11:"), F.col("sample_id"))), "sample_id").limit(50)


# Models of more components: no SQL; tests hold them against numpy versions.


@query("axis_diagnosis")
def axis_diagnosis(spark, d):
    return preprocess.diagnose_axis(embeddings_as_spectra(spark, d), WN)[0]


@query("validation_report")
def validation_report(spark, d):
    return preprocess.validation_report(embeddings_as_spectra(spark, d))


@query("applicability_domain")
def applicability_domain(spark, d):
    e = embeddings_as_spectra(spark, d)
    domain = diagnostics.applicability(e.where("sample_id % 5 <> 0"), 5)
    return domain.score(e.where("sample_id % 5 = 0")).select("sample_id", "t2", "q", "distance", "inside")


@query("training_flags")
def training_flags(spark, d):
    e = embeddings_as_spectra(spark, d)
    return oneclass.training_flags(e, oneclass.fit(e)[0])


@query("one_class_specificity")
def one_class_specificity(spark, d):
    e = embeddings_as_spectra(spark, d)
    scored = oneclass.score(e, oneclass.fit(e.where("conc = 0"), 2)[0]).join(e.select("sample_id", "conc"), "sample_id")
    return oneclass.specificity(scored, F.col("conc") > 0)


@query("acceptance_boundary")
def acceptance_boundary(spark, d):
    models, _ = oneclass.fit(embeddings_as_spectra(spark, d))
    return spark.createDataFrame([(m.label, x, y) for m in models for x, y in oneclass.boundary(m)], "label string, t2 double, q double")


@query("opls_da_scores")
def opls_da_scores(spark, d):
    rows, _ = latent.with_targets(embeddings_as_spectra(spark, d))
    model = diagnostics.fit_opls(moments(rows.withColumn("all", F.lit("all")), "all")["all"], P, 2)
    return rows.select("sample_id", "label", model.predictive(F.col("x")).alias("t_predictive"), model.scores(F.col("x")).alias("t_orthogonal"))


@query("plsda_scores")
def plsda_scores(spark, d):
    rows, _ = latent.with_targets(embeddings_as_spectra(spark, d))
    model = latent.fit_pls(moments(rows.withColumn("all", F.lit("all")), "all")["all"], P, 3)
    return rows.select("sample_id", "label", F.posexplode(model.scores(F.col("x"), 3)).alias("component", "score"))


@query("pca_loadings")
def pca_loadings(spark, d):
    """Loadings with the distinct peaks of each component marked, for a biplot."""
    _, pca = _pca(spark, d)
    peaks = {(k, j) for k in range(5) for j in diagnostics.distinct_peaks(pca.loadings[:, k], WN, 5, 40.0)}
    return spark.createDataFrame([(k, j, float(WN[j]), float(pca.loadings[j, k]), (k, j) in peaks) for k in range(5) for j in range(P)], "component int, j int, wn double, loading double, peak boolean")


def _parted(spark, d):
    """Every fourth group, by hash, is validation."""
    e = embeddings_as_spectra(spark, d)
    h = F.conv(F.substring(F.md5(F.concat(F.lit("cal:"), "group_id")), 1, 4), 16, 10).cast("int")
    return e.withColumn("part", F.when(h % 4 == 0, "validation").otherwise("calibration"))


@query("calibration_holdout")
def calibration_holdout(spark, d):
    return quantify.calibrate_by_part(_parted(spark, d))[0]


@query("calibration_blind")
def calibration_blind(spark, d):
    seen = quantify.class_seen(_pairs(spark, d), _parted(spark, d))
    return quantify.calibrate_by_part(seen, ("seen",))[0]


@query("r2_class_adulterant")
def r2_class_adulterant(spark, d):
    """The adulterant comes from the key of each group: its number decides the letter."""
    e = embeddings_as_spectra(spark, d)
    letter = F.substring(F.lit("AMS"), (F.expr("sample_id div 3") % 3).cast("int") + 1, F.lit(1))
    e = e.withColumn("group_id", F.concat("group_id", F.when(F.col("conc") > 0, F.concat(F.lit("-"), letter, F.format_string("%.2f", "conc"))).otherwise("-P")))
    return quantify.r2_by_class_and_adulterant(e)


@query("merit_table")
def merit_table(spark, d):
    e = splits.hashed_folds(embeddings_as_spectra(spark, d), 5)
    m = quantify.figures_of_merit(e, quantify.calibrate(e)[2])
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in m.items()], "figure string, value double")


@query("kennard_stone_split")
def kennard_stone_split(spark, d):
    return validation.kennard_stone_split(splits.group_means(embeddings_as_spectra(spark, d))).select("group_id", "part")


@query("wold_test")
def wold_test(spark, d):
    e = embeddings_as_spectra(spark, d)
    return validation.wold_test(e, sorted(r[0] for r in e.select("label").distinct().collect()), 3)


@query("bca_interval")
def bca_interval(spark, d):
    return validation.bca_interval(_pairs(spark, d))


@query("bootstrap_vip")
def bootstrap_vip(spark, d):
    return validation.bootstrap_vip(embeddings_as_spectra(spark, d), 3)


@query("preprocessing_comparison")
def preprocessing_comparison(spark, d):
    return validation.compare_preprocessings(embeddings_as_spectra(spark, d), 6)


@query("monte_carlo")
def monte_carlo(spark, d):
    return validation.monte_carlo(embeddings_as_spectra(spark, d), 3)


@query("interval_selection")
def interval_selection(spark, d):
    rows, _ = latent.with_targets(splits.hashed_folds(embeddings_as_spectra(spark, d), 4))
    return spark.createDataFrame(selection.judged_intervals(rows, P, 3))


@query("genetic_convergence")
def genetic_convergence(spark, d):
    rows, _ = latent.with_targets(splits.hashed_folds(embeddings_as_spectra(spark, d), 4))
    history = selection.genetic(moments(rows, "fold"), P, 3)[1]
    return spark.createDataFrame([(g, float(v)) for g, v in enumerate(history)], "generation int, best_q2 double")


@query("classifier_benchmark")
def classifier_benchmark(spark, d):
    return benchmark.classifiers(embeddings_as_spectra(spark, d), 3)


@query("regressor_benchmark")
def regressor_benchmark(spark, d):
    return benchmark.regressors(_parted(spark, d), 3)


_POINTS = f"{E}, pt AS (SELECT DISTINCT a.label, a.v AS x, b.v AS y FROM e a JOIN e b USING (sample_id) WHERE a.j = 0 AND b.j = 1)"


@query("convex_hull", f"""WITH {_POINTS}, edge AS (SELECT a.label, a.x, a.y, b.x AS ex, b.y AS ey FROM pt a JOIN pt b ON a.label = b.label AND (a.x <> b.x OR a.y <> b.y))
SELECT label, x, y FROM edge g WHERE NOT EXISTS (SELECT 1 FROM pt c WHERE c.label = g.label AND (ex - g.x) * (c.y - g.y) - (ey - g.y) * (c.x - g.x) < 0)""")
def convex_hull(spark, d):
    """The vertices around each class in the plane of two channels: ends of an edge that leaves no point outside."""
    e = embeddings_as_spectra(spark, d).select("label", F.get("x", F.lit(0)).alias("u"), F.get("x", F.lit(1)).alias("v"))
    return hull.convex_hull(e, "label", "u", "v").select("label", "x", "y")


@query("holdout_parts", f"""WITH {E}, g AS (SELECT group_id, md5('42:' || group_id) AS h FROM e WHERE conc > 0 GROUP BY group_id), d AS (SELECT group_id FROM g QUALIFY row_number() OVER (ORDER BY h, group_id) <= (SELECT ceil(count(*) * 0.2) FROM g))
SELECT sample_id, CASE WHEN group_id IN (SELECT group_id FROM d) THEN 'holdout' ELSE 'train' END AS part FROM e WHERE j = 0""")
def holdout_parts(spark, d):
    """Groups are drawn among those with an adulterated row; pure rows stay in training."""
    return holdout.set_aside(embeddings_as_spectra(spark, d), keep_pure=True).select("sample_id", "part")


@query("holdout_stratified", f"""WITH {E}, r AS (SELECT sample_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || sample_id), sample_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM e WHERE j = 0)
SELECT sample_id, CASE WHEN r <= ceil(n * 0.2) THEN 'holdout' ELSE 'train' END AS part FROM r""")
def holdout_stratified(spark, d):
    return holdout.set_aside(embeddings_as_spectra(spark, d), groups=False).select("sample_id", "part")


@query("holdout_report")
def holdout_report(spark, d):
    """Cross-validated figures beside those of groups that were set aside first, under the default preset."""
    parted = holdout.set_aside(embeddings_as_spectra(spark, d))
    return holdout.report(parted, pipeline.Steps(preprocess.preset("snv_sg_mc")), 6)[1]


@query("processed_replicate_noise", f"""WITH {E}, s AS (SELECT sample_id, avg(v) AS m, stddev_pop(v) AS s FROM e GROUP BY ALL), t AS (SELECT group_id, j, (v - m) / CASE WHEN s = 0 THEN 1 ELSE s END AS v FROM e JOIN s USING (sample_id)),
g AS (SELECT group_id, j, count(*) AS n, var_samp(v) AS s FROM t GROUP BY ALL HAVING count(*) > 1), p AS (SELECT j, sum((n - 1) * s) / sum(n - 1) AS pooled FROM g GROUP BY j) SELECT round(sqrt(avg(pooled)), 9) AS noise FROM p""")
def processed_replicate_noise(spark, d):
    e = embeddings_as_spectra(spark, d)
    return quantify.replicate_noise(quantify.processed_replicates(e, e, ("snv", "center"))).select(F.round("noise", 9).alias("noise"))


@query("forest_attributions")
def forest_attributions(spark, d):
    """What a forest's class shares owe to each channel."""
    e = embeddings_as_spectra(spark, d).withColumn("features", array_to_vector("x"))
    index = StringIndexer(inputCol="label", outputCol="target", stringOrderType="alphabetAsc").fit(e)
    model = RandomForestClassifier(numTrees=20, maxDepth=5, seed=42, labelCol="target").fit(index.transform(e))
    return attribution.importance(attribution.tree_attributions(e, model)).withColumn("label", F.get(F.lit(index.labels), F.col("output"))).drop("output")


@query("regressor_benchmark_by_class")
def regressor_benchmark_by_class(spark, d):
    return benchmark.regressors(_parted(spark, d), 3, {"ridge": benchmark.REGRESSORS["ridge"]}, by_class=True)


@query("lv_curve_wide")
def lv_curve_wide(spark, d):
    """The component curve of 2,000 channels: the spectra on a finer axis, which bends them anew between channels."""
    fine = preprocess.interpolate(embeddings_as_spectra(spark, d), WN, np.linspace(WN[0], WN[-1], 2000))
    rows, classes = latent.with_targets(splits.hashed_folds(fine, 3))
    parts = pipeline.fold_moments(rows, pipeline.Steps(("savgol", "center"), 25))
    return spark.createDataFrame(pipeline.curve(parts, len(classes), 10), "components int, rmsecv double, q2 double")


@query("variant_trees")
def variant_trees(spark, d):
    """Ward merges of the class centroids in the plane of each variant of the spectra."""
    e = embeddings_as_spectra(spark, d)
    rows = []
    for name, steps in {"raw": (), "sg": ("savgol",), "snv_sg": ("snv", "savgol"), "msc_sg": ("msc", "savgol"), "l2": ("l2",)}.items():
        x = preprocess.fit_apply(e, e, steps) if steps else e
        pca = latent.fit_pca(diagnostics.whole(x), P, 5)
        means = to_long(x.select("label", pca.scores(F.col("x")).alias("x"))).groupBy("label", "j").agg(F.avg("v").alias("m")).toPandas()
        merges = latent.ward({k: g.sort_values("j")["m"].to_numpy() for k, g in means.groupby("label")})
        rows += [(name, i, a, b, h) for i, (a, b, h) in enumerate(merges)]
    return spark.createDataFrame(rows, "variant string, step int, left string, right string, height double")


def identifiers(spark, d) -> DataFrame:
    """A row per sample: true and predicted class, scores, T2, Q and what they say."""
    rows, classes = latent.with_targets(_folded(spark, d))
    predicted = latent.out_of_fold(rows, classes, P, 3).select("sample_id", "fold", "predicted")
    model = latent.fit_pls(moments(rows.withColumn("all", F.lit("all")), "all")["all"], P, 3)
    e, pca = _pca(spark, d)
    limit = oneclass.hotelling_limit(spark, e.count(), 5)
    t = model.scores(F.col("x"), 3)
    flat = e.select("sample_id", "label", "group_id", *(t[k].alias(f"lv{k + 1}") for k in range(3)), pca.t2(F.col("x")).alias("t2"), pca.q(F.col("x")).alias("q"))
    top = diagnostics.q_limit(spark, flat, "q")
    return flat.join(predicted, "sample_id").withColumn("t2_outlier", F.col("t2") > limit).withColumn("q_outlier", F.col("q") > top)


query("identifiers")(identifiers)


@query("model_summary")
def model_summary(spark, d):
    """What there is to say of a model, as key and value."""
    rows = identifiers(spark, d)
    s = metrics.summary(rows.select("label", "predicted"))
    flags = rows.agg(F.count("*").alias("n_samples"), F.countDistinct("group_id").alias("n_groups"), F.countDistinct("label").alias("n_classes"), F.count_if("t2_outlier").alias("n_t2_outliers"), F.count_if("q_outlier").alias("n_q_outliers"))
    both = s.drop("degenerate").crossJoin(flags)
    return both.select(F.explode(F.map_from_arrays(F.lit(both.columns), F.array(*(F.col(c).cast("double") for c in both.columns)))).alias("key", "value"))


