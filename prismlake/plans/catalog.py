"""The registered queries of the analytics library, and SQL for those that SQL can express.

Tables stand in for spectra as follows: embeddings are spectra of 64 channels; lineitem gives regression
pairs; orders give titles and acquisition ranges; events give user profiles.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.functions import rowlocal as R
from prismlake.functions import titles
from prismlake.functions.ordering import by_number, numbered
from prismlake.operators import latent, metrics, oneclass, pipeline, preprocess, quality, quantify, resampling, selection, splits, validation
from prismlake.operators.gram import moments
from prismlake.schema import embeddings_as_spectra, to_long
from prismlake.streaming import scoring

P = 64
WN = 4000.0 + 10.0 * np.arange(P)
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Shared parts of the SQL. E: long form of the embeddings as schema.embeddings_as_spectra gives them.
E = """e AS (SELECT vec_id AS sample_id, CAST(label AS VARCHAR) AS label, CAST((vec_id // 3) % 9 * 5 AS DOUBLE) AS conc,
  CAST(label AS VARCHAR) || '-' || CAST(vec_id // 3 AS VARCHAR) AS group_id, i - 1 AS j, CAST(embedding[i] AS DOUBLE) AS v
  FROM embeddings, range(1, 65) t(i))"""
_PAIRS = f"""{E}, m AS (SELECT label AS k, j, avg(v) AS m FROM e GROUP BY ALL),
d AS (SELECT sample_id, label, k, round(sum((v - m) * (v - m)), 9) AS d FROM e JOIN m USING (j) GROUP BY ALL),
pairs AS (SELECT sample_id, label, k AS predicted FROM d QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY d, k) = 1)"""
_REG = """r AS (SELECT l_returnflag AS g, l_extendedprice AS y, l_quantity * p_retailprice AS predicted FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _long_out(df: DataFrame, places: int = 6) -> DataFrame:
    return to_long(df.select("sample_id", "x")).select("sample_id", F.col("j").cast("long").alias("j"), (F.round("v", places) + 0.0).alias("v"))


@query("scan_long", f"WITH {E} SELECT sample_id, j, round(v, 6) + 0.0 AS v FROM e")
def scan_long(spark, d):
    return _long_out(embeddings_as_spectra(spark, d))


@query("truncate_axis", f"WITH {E} SELECT sample_id, j - 10 AS j, round(v, 6) + 0.0 AS v FROM e WHERE 4000 + 10 * j BETWEEN 4100 AND 4300")
def truncate_axis(spark, d):
    return _long_out(preprocess.truncate(embeddings_as_spectra(spark, d), WN, 4100, 4300)[0])


@query("interpolate_axis", """WITH g AS (SELECT k, 3990 + 13.0 * k AS t FROM range(0, 50) r(k)),
c AS (SELECT k, greatest(least(t, 4630), 4000) AS t FROM g), n AS (SELECT k, t, least(CAST(floor((t - 4000) / 10) AS BIGINT), 62) AS j0 FROM c)
SELECT vec_id AS sample_id, k AS j, round(embedding[j0 + 1]::DOUBLE + (embedding[j0 + 2]::DOUBLE - embedding[j0 + 1]::DOUBLE) * (t - 4000 - 10 * j0) / 10, 6) + 0.0 AS v FROM embeddings, n""")
def interpolate_axis(spark, d):
    return _long_out(preprocess.interpolate(embeddings_as_spectra(spark, d), WN, 3990 + 13.0 * np.arange(50)))


_SNV = f"{E}, s AS (SELECT sample_id, avg(v) AS m, stddev_pop(v) AS s FROM e GROUP BY ALL), t AS (SELECT sample_id, label, group_id, j, (v - m) / CASE WHEN s = 0 THEN 1 ELSE s END AS v FROM e JOIN s USING (sample_id))"


@query("snv", f"WITH {_SNV} SELECT sample_id, j, round(v, 6) + 0.0 AS v FROM t")
def snv(spark, d):
    return _long_out(embeddings_as_spectra(spark, d).withColumn("x", R.snv(F.col("x"))))


@query("msc", f"""WITH {E}, r AS (SELECT j, avg(v) AS r FROM e GROUP BY j), s AS (SELECT sample_id, covar_pop(r, v) / var_pop(r) AS b, avg(v) AS mx, avg(r) AS mr FROM e JOIN r USING (j) GROUP BY sample_id)
SELECT sample_id, j, printf('%.4e', CASE WHEN abs(b) <= 1e-12 THEN v - (mx - b * mr) ELSE (v - (mx - b * mr)) / b END + 0.0) AS v FROM e JOIN s USING (sample_id)""")
def msc(spark, d):
    """All rows; a nearly flat one has large values, so values compare by significant digits."""
    e = embeddings_as_spectra(spark, d)
    x = e.withColumn("x", R.msc(F.col("x"), R.constants(preprocess.column_moments(e)[0])))
    return to_long(x.select("sample_id", "x")).select("sample_id", F.col("j").cast("long").alias("j"), F.format_string("%.4e", F.col("v") + 0.0).alias("v"))


@query("mean_center", f"WITH {E}, m AS (SELECT j, avg(v) AS m FROM e GROUP BY j) SELECT sample_id, j, round(v - m, 6) + 0.0 AS v FROM e JOIN m USING (j)")
def mean_center(spark, d):
    e = embeddings_as_spectra(spark, d)
    return _long_out(preprocess.fit_apply(e, e, ("center",)))


@query("autoscale", f"WITH {E}, m AS (SELECT j, avg(v) AS m, stddev_pop(v) AS s FROM e GROUP BY j) SELECT sample_id, j, round((v - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) + 0.0 AS v FROM e JOIN m USING (j)")
def autoscale(spark, d):
    e = embeddings_as_spectra(spark, d)
    return _long_out(preprocess.fit_apply(e, e, ("autoscale",)))


@query("l2_normalize", f"WITH {E}, m AS (SELECT sample_id, sqrt(sum(v * v)) AS n FROM e GROUP BY sample_id) SELECT sample_id, j, round(v / n, 6) + 0.0 AS v FROM e JOIN m USING (sample_id)")
def l2_normalize(spark, d):
    return _long_out(embeddings_as_spectra(spark, d).withColumn("x", R.l2_normalize(F.col("x"))))


def _savgol_sql(window: int) -> str:
    """o, i, w: the published weights of a quadratic's first derivative. In the middle i over the sum of squares;
    at the ends the slope, at that place, of the parabola through the first or last window."""
    h = window // 2
    s2, s4 = 2 * sum(i**2 for i in range(1, h + 1)), 2 * sum(i**4 for i in range(1, h + 1))
    return f"""place AS (SELECT o, greatest(least(o, {P - 1 - h}), {h}) AS c FROM range(0, {P}) r(o)),
kernel AS (SELECT o, c + u AS i, u / {s2}.0 + 2.0 * (o - c) * ({window} * u * u - {s2}) / {window * s4 - s2**2}.0 AS w FROM place, range(-{h}, {h + 1}) t(u))"""


@query("savgol", f"WITH {E}, {_savgol_sql(7)} SELECT sample_id, o AS j, round(sum(v * w), 6) + 0.0 AS v FROM e JOIN kernel k ON e.j = k.i GROUP BY sample_id, o")
def savgol(spark, d):
    return _long_out(embeddings_as_spectra(spark, d).withColumn("x", R.savgol(F.col("x"), 7)))


@query("preset_snv_sg_mc", f"WITH {_SNV}, {_savgol_sql(25)}, f AS (SELECT sample_id, o AS j, sum(v * w) AS v FROM t JOIN kernel k ON t.j = k.i GROUP BY sample_id, o) SELECT sample_id, j, round(v - avg(v) OVER (PARTITION BY j), 6) + 0.0 AS v FROM f")
def preset_snv_sg_mc(spark, d):
    """The default preset as one path: SNV, derivative of window 25, centring."""
    e = embeddings_as_spectra(spark, d)
    return _long_out(preprocess.fit_apply(e, e, preprocess.preset("snv_sg_mc"), 25))


@query("preset_msc_sg_mc", f"""WITH {E}, {_savgol_sql(25)}, r AS (SELECT j, avg(v) AS r FROM e GROUP BY j), s AS (SELECT sample_id, covar_pop(r, v) / var_pop(r) AS b, avg(v) AS mx, avg(r) AS mr FROM e JOIN r USING (j) GROUP BY sample_id),
t AS (SELECT sample_id, j, CASE WHEN abs(b) <= 1e-12 THEN v - (mx - b * mr) ELSE (v - (mx - b * mr)) / b END AS v FROM e JOIN s USING (sample_id)),
f AS (SELECT sample_id, o AS j, sum(v * w) AS v FROM t JOIN kernel k ON t.j = k.i GROUP BY sample_id, o) SELECT sample_id, j, printf('%.4e', v - avg(v) OVER (PARTITION BY j) + 0.0) AS v FROM f""")
def preset_msc_sg_mc(spark, d):
    """Nearly flat rows have large values, so values compare by significant digits."""
    e = embeddings_as_spectra(spark, d)
    x = preprocess.fit_apply(e, e, preprocess.preset("msc_sg_mc"), 25)
    return to_long(x.select("sample_id", "x")).select("sample_id", F.col("j").cast("long").alias("j"), F.format_string("%.4e", F.col("v") + 0.0).alias("v"))


_SMOOTH = f"{E}, w AS (SELECT sample_id, j, v, sum(v) OVER (PARTITION BY sample_id ORDER BY j ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7 AS m FROM e), smooth AS (SELECT a.sample_id, a.j, a.v, b.m AS smooth FROM w a JOIN w b ON a.sample_id = b.sample_id AND b.j = greatest(3, least(60, a.j)))"


@query("moving_average", f"WITH {_SMOOTH} SELECT sample_id, j, round(smooth, 6) + 0.0 AS v FROM smooth")
def moving_average(spark, d):
    s = preprocess.moving_average(to_long(embeddings_as_spectra(spark, d)), 3)
    return s.select("sample_id", F.col("j").cast("long").alias("j"), (F.round("smooth", 6) + 0.0).alias("v"))


_SNR = f"{_SMOOTH}, c AS (SELECT j, stddev_samp(smooth) AS signal, stddev_samp(v - smooth) AS noise FROM smooth GROUP BY j), snr AS (SELECT j, signal / greatest(noise, (SELECT quantile_cont(noise, 0.5) * 1e-3 FROM c)) AS snr FROM c)"


@query("snr_mask", f"WITH {_SNR} SELECT j, round(snr, 5) AS snr, snr >= 3 AS useful FROM snr")
def snr_mask(spark, d):
    return preprocess.snr_by_channel(to_long(embeddings_as_spectra(spark, d))).select(F.col("j").cast("long").alias("j"), F.round("snr", 5).alias("snr"), "useful")


@query("low_signal_regions", f"""WITH {_SNR}, f AS (SELECT j, snr < 0.4 AS bad FROM snr), r AS (SELECT j, j - row_number() OVER (ORDER BY j) AS run FROM f WHERE bad)
SELECT min(j) AS first, max(j) AS last, count(*) AS channels FROM r GROUP BY run""")
def low_signal_regions(spark, d):
    s = preprocess.snr_by_channel(to_long(embeddings_as_spectra(spark, d))).withColumn("bad", F.col("snr") < 0.4)
    return preprocess.regions(s, "bad").select(F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "channels")


@query("class_mean_sd", f"WITH {E} SELECT label, j, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) AS sd, count(*) AS n FROM e GROUP BY label, j")
def class_mean_sd(spark, d):
    g = to_long(embeddings_as_spectra(spark, d)).groupBy("label", F.col("j").cast("long").alias("j"))
    return g.agg((F.round(F.avg("v"), 6) + 0.0).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("sd"), F.count("*").alias("n"))


@query("snv_class_mean_sd", f"WITH {_SNV} SELECT label, j, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) AS sd FROM t GROUP BY label, j")
def snv_class_mean_sd(spark, d):
    g = to_long(embeddings_as_spectra(spark, d).withColumn("x", R.snv(F.col("x")))).groupBy("label", F.col("j").cast("long").alias("j"))
    return g.agg((F.round(F.avg("v"), 6) + 0.0).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("sd"))


@query("nonfinite_rows", f"WITH {E}, b AS (SELECT sample_id, bool_and(NOT (sample_id % 7 = 0 AND j = 3)) AS good FROM e GROUP BY sample_id) SELECT sample_id FROM b WHERE good")
def nonfinite_rows(spark, d):
    """Every seventh row gets a NaN at channel 3, and must go."""
    e = embeddings_as_spectra(spark, d)
    e = e.withColumn("x", F.transform("x", lambda v, j: F.when((F.col("sample_id") % 7 == 0) & (j == 3), F.lit(float("nan"))).otherwise(v)))
    return quality.drop_nonfinite(e).select("sample_id")


@query("constant_columns", f"WITH {E} SELECT j, var_pop(CASE WHEN j % 8 = 0 THEN 1.0 ELSE v END) <= 1e-12 AS constant FROM e GROUP BY j")
def constant_columns(spark, d):
    e = embeddings_as_spectra(spark, d).withColumn("x", F.transform("x", lambda v, j: F.when(j % 8 == 0, 1.0).otherwise(v)))
    return quality.constant_columns(e).select(F.col("j").cast("long").alias("j"), "constant")


@query("exact_duplicates", "WITH u AS (SELECT embedding FROM embeddings UNION ALL SELECT embedding FROM embeddings WHERE vec_id % 5 = 0) SELECT count(*) AS n_rows, count(DISTINCT embedding) AS n_distinct, count(*) - count(DISTINCT embedding) AS n_copies FROM u")
def exact_duplicates(spark, d):
    e = embeddings_as_spectra(spark, d)
    r = quality.exact_duplicates(e.unionAll(e.where("sample_id % 5 = 0")))
    return r.select(*(F.col(c).cast("long").alias(c) for c in r.columns))


@query("near_duplicates", """WITH z AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), m AS (SELECT id, list_transform(x, lambda v: v - list_avg(x)) AS x FROM z), u AS (SELECT id, list_transform(x, lambda v: v / sqrt(list_sum(list_transform(x, lambda w: w * w)))) AS x FROM m),
a AS (SELECT id, x FROM u UNION ALL SELECT id + 1000000, x FROM u) SELECT p.id AS a, q.id AS b, round(list_dot_product(p.x, q.x), 6) AS r FROM a p JOIN a q ON p.id < q.id WHERE list_dot_product(p.x, q.x) > 0.99995""")
def near_duplicates(spark, d):
    e = embeddings_as_spectra(spark, d)
    pairs = quality.near_duplicates(e.unionAll(e.withColumn("sample_id", F.col("sample_id") + 1000000).withColumn("x", F.transform("x", lambda v: v * 2 + 1))))
    return pairs.select("a", "b", F.round("r", 6).alias("r"))


@query("class_balance", f"WITH {E}, c AS (SELECT label, count(*) AS n FROM e WHERE j = 0 GROUP BY label) SELECT count(*) AS n_classes, min(n) AS least, max(n) AS most, round(max(n) / min(n), 9) AS ratio, max(n) / min(n) > 5 AS unbalanced FROM c")
def class_balance(spark, d):
    return quality.class_balance(embeddings_as_spectra(spark, d)).withColumn("ratio", F.round("ratio", 9))


@query("dominant_range", """WITH o AS (SELECT o_orderkey, round_even(o_totalprice / 100000, 0) * 100 AS range_key FROM orders), m AS (SELECT range_key AS mode FROM o GROUP BY range_key ORDER BY count(*) DESC, range_key LIMIT 1)
SELECT o_orderkey, range_key, abs(range_key - mode) < 50 AS kept FROM o, m""")
def dominant_range(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("x_max"))
    return quality.dominant_range(o).select("o_orderkey", "range_key", "kept")


def _titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles made from orders: code by status, date, an adulterant for odd keys, a replicate; with the
    variants of the format by the key: underscores, no separator before T, T_1, a doubled percent sign, outer
    blanks, and codes in lower case, which don't fit."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    k = F.col("o_orderkey")
    either = lambda m: F.when(k % m == 0, "_").otherwise("-")
    tail = F.when(k % 2 == 1, F.concat(either(11), F.lit("AD-"), F.substring(F.lit("AMS"), (k % 3).cast("int") + 1, F.lit(1)), F.lit("-"), (k % 40).cast("string"), F.lit(","), F.lpad((k % 100).cast("string"), 2, "0"), F.when(k % 13 == 0, "%%").otherwise("%"))).otherwise("")
    code = F.concat(F.substring("o_orderstatus", 1, 1), F.when(k % 29 == 0, "ab").otherwise("AB"))
    last = F.concat(F.when(k % 5 == 0, "").otherwise(either(7)), F.when(k % 3 == 0, "T_").otherwise("T"), (k % 4).cast("string"), F.when(k % 17 == 0, "  ").otherwise(""))
    return o.select("o_orderkey", F.concat(F.when(k % 19 == 0, " ").otherwise(""), code, either(23), F.date_format("o_orderdate", "dd-MM-yyyy"), tail, last).alias("title"))


#: Titles are taken apart by splitting, not by the pattern of the library.
_TITLE = r"""t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 19 = 0 THEN ' ' ELSE '' END || substr(o_orderstatus, 1, 1) || CASE WHEN o_orderkey % 29 = 0 THEN 'ab' ELSE 'AB' END || CASE WHEN o_orderkey % 23 = 0 THEN '_' ELSE '-' END || strftime(o_orderdate, '%d-%m-%Y')
 || CASE WHEN o_orderkey % 2 = 1 THEN CASE WHEN o_orderkey % 11 = 0 THEN '_' ELSE '-' END || 'AD-' || substr('AMS', CAST(o_orderkey % 3 AS INT) + 1, 1) || '-' || (o_orderkey % 40) || ',' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || CASE WHEN o_orderkey % 13 = 0 THEN '%%' ELSE '%' END ELSE '' END
 || CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN '_' ELSE '-' END || CASE WHEN o_orderkey % 3 = 0 THEN 'T_' ELSE 'T' END || (o_orderkey % 4) || CASE WHEN o_orderkey % 17 = 0 THEN '  ' ELSE '' END AS title FROM orders),
u AS (SELECT o_orderkey, title, trim(title) AS s FROM t),
w AS (SELECT o_orderkey, title, s, CAST(right(s, 1) AS INT) AS rep, substr(s, 1, 3) AS code, substr(s, 5, 10) AS day, rtrim(replace(left(s, length(s) - 1), 'T_', 'T'), 'T') AS r FROM u),
x AS (SELECT o_orderkey, title, rep, code, day, rtrim(substr(r, 15), '-_%') AS body FROM w),
v AS (SELECT o_orderkey, title, rep, code, day, CASE WHEN body = '' THEN NULL ELSE substr(body, 5, 1) END AS ad, CASE WHEN body = '' THEN NULL ELSE CAST(replace(substr(body, 7), ',', '.') AS DOUBLE) END AS pct FROM x),
z AS (SELECT *, code = upper(code) AND rep BETWEEN 1 AND 3 AND coalesce(pct > 0, true) AS valid FROM v),
k AS (SELECT *, CASE WHEN valid THEN code || '-' || day || CASE WHEN ad IS NULL THEN '' ELSE '-' || ad || printf('%.2f', pct) END END AS group_id FROM z)"""


@query("title_parse", f"WITH {_TITLE} SELECT o_orderkey, CASE WHEN valid THEN code END AS code, CASE WHEN valid THEN ad END AS adulterant, CASE WHEN valid THEN pct END AS content, CASE WHEN valid THEN rep ELSE 0 END AS replicate, valid, group_id FROM k")
def title_parse(spark, d):
    f = titles.parse_title(F.col("title"))
    f["replicate"] = F.coalesce(f["replicate"], F.lit(0))
    return _titles(spark, d).select("o_orderkey", *(f[c].alias(c) for c in ("code", "adulterant", "content", "replicate", "valid", "group_id")))


@query("adulterant_counts", f"WITH {_TITLE} SELECT nullif(regexp_extract(split_part(group_id, '-', -1), '^([AMS])\\d', 1), '') AS adulterant, count(*) AS n FROM k WHERE valid GROUP BY ALL".replace("\\\\", "\\"))
def adulterant_counts(spark, d):
    t = _titles(spark, d).withColumn("group_id", titles.parse_title(F.col("title"))["group_id"]).where("group_id is not null")
    return t.groupBy(titles.adulterant_of(F.col("group_id")).alias("adulterant")).agg(F.count("*").alias("n"))


@query("orphan_groups", f"WITH {_TITLE} SELECT count(*) FILTER (NOT valid) AS n_orphans, count(DISTINCT coalesce(group_id, 'orphan_' || title)) AS n_groups FROM k")
def orphan_groups(spark, d):
    f = titles.parse_title(F.col("title"))
    return _titles(spark, d).select(f["valid"].alias("valid"), F.coalesce(f["group_id"], F.concat(F.lit("orphan_"), "title")).alias("g")).agg(F.count_if(~F.col("valid")).alias("n_orphans"), F.countDistinct("g").alias("n_groups"))


@query("code_alias", "SELECT p_partkey, coalesce(m.name, p_brand) AS brand FROM part LEFT JOIN (VALUES ('Brand#11', 'Alpha'), ('Brand#22', 'Beta')) m(code, name) ON p_brand = m.code")
def code_alias(spark, d):
    names = spark.createDataFrame([("Brand#11", "Alpha"), ("Brand#22", "Beta")], "code string, name string")
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.join(F.broadcast(names), p["p_brand"] == names["code"], "left").select("p_partkey", F.coalesce("name", "p_brand").alias("brand"))


@query("anonymous_groups", f"WITH {_TITLE}, f AS (SELECT group_id, min(o_orderkey) AS f FROM k WHERE valid GROUP BY group_id) SELECT o_orderkey, 'G' || lpad(CAST(dense_rank() OVER (ORDER BY f) AS VARCHAR), 6, '0') AS replicate_group FROM k JOIN f USING (group_id)")
def anonymous_groups(spark, d):
    """Groups numbered by first appearance. Bounds of the keys are those of the table: no title is parsed for them."""
    # exploded, so that no filter parses a title again
    t = _titles(spark, d).select("o_orderkey", F.explode(F.array_compact(F.array(titles.group_key(F.col("title"))))).alias("group_id"))
    first = t.groupBy("group_id").agg(F.min("o_orderkey").alias("f"))
    low, high = spark.read.parquet(f"{d}/orders.parquet").agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    first = numbered(first, by_number(F.col("f"), low or 0, high or 0), "f", name="g")
    return t.join(first, "group_id").select("o_orderkey", F.concat(F.lit("G"), F.lpad(F.col("g").cast("string"), 6, "0")).alias("replicate_group"))


def _pairs(spark, d):
    return metrics.nearest_centroid(embeddings_as_spectra(spark, d))


@query("confusion", f"WITH {_PAIRS} SELECT label, predicted, count(*) AS n FROM pairs GROUP BY ALL")
def confusion(spark, d):
    return metrics.confusion(_pairs(spark, d))


_CLASS = f"""{_PAIRS}, c AS (SELECT label FROM pairs UNION SELECT predicted FROM pairs), z AS (SELECT c.label, count(*) FILTER (p.label = c.label) AS support, count(*) FILTER (p.label = c.label AND p.predicted = c.label) AS tp, count(*) FILTER (p.predicted = c.label) AS named, count(*) AS n FROM c, pairs p GROUP BY c.label)"""


@query("class_metrics", f"""WITH {_CLASS} SELECT label, support, round(CASE WHEN support = 0 THEN 0 ELSE tp / support END, 9) AS recall, round(CASE WHEN named = 0 THEN 0 ELSE tp / named END, 9) AS precision,
round(CASE WHEN support + named = 0 THEN 0 ELSE 2 * tp / (support + named) END, 9) AS f1, round(CASE WHEN n = support THEN 0 ELSE (n - support - named + tp) / (n - support) END, 9) AS specificity FROM z""")
def class_metrics(spark, d):
    return metrics.per_class(_pairs(spark, d)).select("label", "support", *(F.round(c, 9).alias(c) for c in ("recall", "precision", "f1", "specificity")))


@query("classification_summary", f"""WITH {_CLASS}, k AS (SELECT sum(support * named) / any_value(n * n) AS pe, sum(tp) / any_value(n) AS acc, avg(tp / support) FILTER (support > 0) AS bal, avg(CASE WHEN support + named = 0 THEN 0 ELSE 2 * tp / (support + named) END) AS f1, avg(CASE WHEN named = 0 THEN 0 ELSE tp / named END) AS precision, avg(CASE WHEN support = 0 THEN 0 ELSE tp / support END) AS recall FROM z)
SELECT round(acc, 9) AS accuracy, round(bal, 9) AS balanced_accuracy, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, round((acc - pe) / (1 - pe), 9) AS kappa, false AS degenerate FROM k""")
def classification_summary(spark, d):
    s = metrics.summary(_pairs(spark, d))
    return s.select(*(F.round(c, 9).alias(c) for c in s.columns if c != "degenerate"), "degenerate")


def _scores(spark, d):
    e = embeddings_as_spectra(spark, d)
    classes = sorted(r[0] for r in e.select("label").distinct().collect())
    return e.select(F.explode(F.lit(classes)).alias("target"), "label", F.round(F.get("x", F.col("sample_id") * 0 + 5) + F.get("x", F.lit(9)), 4).alias("score")).select("target", "score", (F.col("target") == F.col("label")).alias("positive"))


_SC = f"{E}, s AS (SELECT sample_id, label, round(sum(v), 4) AS score FROM e WHERE j IN (5, 9) GROUP BY ALL), t AS (SELECT DISTINCT label AS target FROM s), sc AS (SELECT target, score, label = target AS positive FROM s, t)"


@query("roc_auc", f"""WITH {_SC}, r AS (SELECT target, positive, (rank() OVER (PARTITION BY target ORDER BY score)) + (count(*) OVER (PARTITION BY target, score) - 1) / 2 AS r FROM sc),
u AS (SELECT target, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS q, sum(r) FILTER (positive) AS r FROM r GROUP BY target) SELECT target AS label, round((r - p * (p + 1) / 2) / (p * q), 9) AS auc FROM u""")
def roc_auc(spark, d):
    return metrics.roc_auc(_scores(spark, d)).select("label", F.round("auc", 9).alias("auc"))


@query("det_eer", f"""WITH {_SC}, a AS (SELECT target, score, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS q FROM sc GROUP BY ALL),
b AS (SELECT target, score, 1 - sum(p) OVER w / sum(p) OVER (PARTITION BY target) AS miss, sum(q) OVER w / sum(q) OVER (PARTITION BY target) AS alarm FROM a WINDOW w AS (PARTITION BY target ORDER BY score DESC))
SELECT target AS label, round((miss + alarm) / 2, 9) AS eer FROM b QUALIFY row_number() OVER (PARTITION BY target ORDER BY round(abs(miss - alarm), 12), score DESC) = 1""")
def det_eer(spark, d):
    return metrics.det_eer(_scores(spark, d)).select("label", F.round("eer", 9).alias("eer"))


def _regression(spark, d):
    li, p = spark.read.parquet(f"{d}/lineitem.parquet"), spark.read.parquet(f"{d}/part.parquet")
    return li.join(p, li["l_partkey"] == p["p_partkey"]).select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * F.col("p_retailprice")).alias("predicted"))


_STATS = f"{_REG}, s AS (SELECT g, count(*) AS n, sqrt(avg((predicted - y) ** 2)) AS rmse, 1 - sum((predicted - y) ** 2) / (var_pop(y) * count(*)) AS r2, avg(predicted - y) AS bias, stddev_samp(predicted - y) AS sep, stddev_samp(y) AS sd, max(y) - min(y) AS span FROM r GROUP BY g)"


@query("regression_metrics", f"WITH {_STATS} SELECT g, n, round(rmse, 4) AS rmse, round(r2, 6) AS r2, round(bias, 4) AS bias, round(sep, 4) AS sep, round(sd / sep, 6) AS rpd, round(span / sep, 6) AS rer FROM s")
def regression_metrics(spark, d):
    return metrics.regression(_regression(spark, d), "g").select("g", "n", *(F.round(c, k).alias(c) for c, k in (("rmse", 4), ("r2", 6), ("bias", 4), ("sep", 4), ("rpd", 6), ("rer", 6))))


@query("rpd_band", f"WITH {_STATS} SELECT g, CASE WHEN sep IS NULL OR sep = 0 THEN 'not estimable' WHEN sd / sep < 2 THEN 'unsuitable' WHEN sd / sep < 2.5 THEN 'screening' WHEN sd / sep < 3 THEN 'fair' WHEN sd / sep < 5 THEN 'good' ELSE 'excellent' END AS band FROM s")
def rpd_band(spark, d):
    return metrics.regression(_regression(spark, d), "g").select("g", metrics.rpd_band(F.col("rpd")).alias("band"))


@query("replicate_noise", f"WITH {E}, g AS (SELECT group_id, j, count(*) AS n, var_samp(v) AS s FROM e GROUP BY ALL HAVING count(*) > 1), p AS (SELECT j, sum((n - 1) * s) / sum(n - 1) AS p FROM g GROUP BY j) SELECT round(sqrt(avg(p)), 6) AS noise FROM p")
def replicate_noise(spark, d):
    return quantify.replicate_noise(embeddings_as_spectra(spark, d)).select(F.round("noise", 6).alias("noise"))


@query("group_median", f"WITH {E} SELECT group_id, round(quantile_cont(v, 0.5), 6) + 0.0 AS med FROM e WHERE j = 7 GROUP BY group_id")
def group_median(spark, d):
    e = embeddings_as_spectra(spark, d)
    return e.groupBy("group_id").agg((F.round(F.percentile(F.get("x", F.lit(7)), 0.5), 6) + 0.0).alias("med"))


@query("group_mean", f"WITH {E} SELECT group_id, j, round(avg(v), 6) + 0.0 AS v FROM e GROUP BY group_id, j")
def group_mean(spark, d):
    return to_long(splits.group_means(embeddings_as_spectra(spark, d))).select("group_id", F.col("j").cast("long").alias("j"), (F.round("v", 6) + 0.0).alias("v"))


@query("hotelling_t2", f"WITH {E}, s AS (SELECT sample_id, sum(v) FILTER (j = 0) AS a, sum(v) FILTER (j = 1) AS b FROM e GROUP BY sample_id) SELECT sample_id, round(a * a / (SELECT var_samp(a) FROM s) + b * b / (SELECT var_samp(b) FROM s), 6) AS t2 FROM s")
def hotelling_t2(spark, d):
    s = embeddings_as_spectra(spark, d).select("sample_id", F.get("x", F.lit(0)).alias("a"), F.get("x", F.lit(1)).alias("b"))
    return metrics.hotelling(s, ["a", "b"]).select("sample_id", F.round("t2", 6).alias("t2"))


@query("moments_dof", f"WITH {E} SELECT label, round(avg(v * v), 9) AS mean, round(CASE WHEN stddev_samp(v * v) > 0 THEN 2 * (avg(v * v) / stddev_samp(v * v)) ** 2 ELSE 1 END, 6) AS dof FROM e WHERE j = 2 GROUP BY label")
def moments_dof(spark, d):
    e = embeddings_as_spectra(spark, d).select("label", (F.get("x", F.lit(2)) * F.get("x", F.lit(2))).alias("q"))
    return metrics.moments_dof(e, "q", "label").select("label", F.round("mean", 9).alias("mean"), F.round("dof", 6).alias("dof"))


@query("conformal_threshold", f"""WITH {E}, g AS (SELECT label, group_id, quantile_cont(v, 0.5) AS s FROM e WHERE j = 4 GROUP BY ALL), n AS (SELECT label, count(*) AS n, CAST(ceil(round((count(*) + 1) * 0.9, 9)) AS INT) AS k FROM g GROUP BY label),
r AS (SELECT label, s, row_number() OVER (PARTITION BY label ORDER BY s, group_id) AS rank FROM g) SELECT n.label, n, k, round(max(s) FILTER (rank = k), 6) AS threshold FROM n JOIN r USING (label) GROUP BY ALL""")
def conformal_threshold(spark, d):
    s = embeddings_as_spectra(spark, d).select("label", "group_id", F.get("x", F.lit(4)).alias("score"))
    return oneclass.conformal_threshold(s, 0.1, "group_id", "score", "label").select("label", "n", "k", F.round("threshold", 6).alias("threshold"))


_HASHED = f"{E}, h AS (SELECT DISTINCT sample_id, group_id, label, conc, CAST(('0x' || substr(md5('42:' || group_id), 1, 8)) AS BIGINT) % 5 AS fold FROM e)"


@query("hashed_folds", f"WITH {_HASHED} SELECT sample_id, CAST(fold AS INT) AS fold FROM h")
def hashed_folds(spark, d):
    return splits.hashed_folds(embeddings_as_spectra(spark, d), 5).select("sample_id", "fold")


@query("leak_check", f"WITH {E}, f AS (SELECT DISTINCT sample_id, group_id, sample_id % 5 AS fold FROM e) SELECT group_id, min(fold) AS first_fold, max(fold) AS last_fold, count(*) AS n FROM f GROUP BY group_id HAVING min(fold) <> max(fold)")
def leak_check(spark, d):
    """A deliberately leaking split by row number, caught."""
    return splits.leaks(embeddings_as_spectra(spark, d).withColumn("fold", F.col("sample_id") % 5))


@query("holdout_groups", f"WITH {E}, g AS (SELECT group_id, md5('42:' || group_id) AS h FROM e GROUP BY group_id HAVING max(conc) > 0) SELECT group_id FROM g QUALIFY row_number() OVER (ORDER BY h, group_id) <= (SELECT ceil(count(*) * 0.2) FROM g)")
def holdout_groups(spark, d):
    return splits.holdout_groups(embeddings_as_spectra(spark, d))


@query("pls1_one_component", f"""WITH {E}, m AS (SELECT j, avg(v) AS m FROM e GROUP BY j), y AS (SELECT avg(conc) AS y FROM e WHERE j = 0), c AS (SELECT j, sum((v - m) * (conc - y)) AS c FROM e JOIN m USING (j), y GROUP BY j), w AS (SELECT j, c / sqrt(sum(c * c) OVER ()) AS w FROM c),
t AS (SELECT sample_id, conc, sum((v - m) * w) AS t FROM e JOIN m USING (j) JOIN w USING (j) GROUP BY ALL), q AS (SELECT sum(t * (conc - y)) / sum(t * t) AS q FROM t, y) SELECT sample_id, round(y + q * t, 6) AS predicted FROM t, q, y""")
def pls1_one_component(spark, d):
    e = embeddings_as_spectra(spark, d).withColumn("y", F.array("conc")).withColumn("all", F.lit("all"))
    model = latent.fit_pls(moments(e, "all")["all"], P, 1)
    return e.select("sample_id", F.round(model.predict(F.col("x"), 1)[0], 6).alias("predicted"))


@query("s_plot", f"""WITH {E}, m AS (SELECT j, avg(v) AS m FROM e GROUP BY j), y AS (SELECT avg(conc) AS y FROM e WHERE j = 0), c AS (SELECT j, sum((v - m) * (conc - y)) AS c FROM e JOIN m USING (j), y GROUP BY j), w AS (SELECT j, c / sqrt(sum(c * c) OVER ()) * sign(first_value(c) OVER (ORDER BY abs(c) DESC)) AS w FROM c),
t AS (SELECT sample_id, sum((v - m) * w) AS t FROM e JOIN m USING (j) JOIN w USING (j) GROUP BY ALL) SELECT j, round(covar_samp(v, t), 9) AS covariance, round(corr(v, t), 6) AS correlation FROM e JOIN t USING (sample_id) GROUP BY j""")
def s_plot(spark, d):
    e = embeddings_as_spectra(spark, d).withColumn("y", F.array("conc")).withColumn("all", F.lit("all"))
    model = latent.fit_pls(moments(e, "all")["all"], P, 1)
    long = to_long(e.select(model.scores(F.col("x"), 1)[0].alias("t"), "x"))
    return long.groupBy(F.col("j").cast("long").alias("j")).agg(F.round(F.covar_samp("v", "t"), 9).alias("covariance"), F.round(F.corr("v", "t"), 6).alias("correlation"))


@query("user_profiles", "SELECT user_id, CAST(extract(hour FROM ts) AS INT) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def user_profiles(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    return ev.groupBy("user_id", F.hour("ts").alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _folded(spark, d, folds=5):
    e = embeddings_as_spectra(spark, d)
    return e.join(splits.grouped_folds(e, folds), "group_id")


@query("grouped_folds")
def grouped_folds(spark, d):
    return splits.grouped_folds(embeddings_as_spectra(spark, d), 5)


@query("lv_curve")
def lv_curve(spark, d):
    rows, _ = latent.with_targets(splits.hashed_folds(embeddings_as_spectra(spark, d), 5))
    return spark.createDataFrame(latent.lv_curve(rows, P, 10), "components int, rmsecv double, q2 double")


@query("plsda_out_of_fold")
def plsda_out_of_fold(spark, d):
    rows, classes = latent.with_targets(_folded(spark, d))
    return latent.out_of_fold(rows, classes, P, latent.choose_lv(latent.lv_curve(rows, P, 6))).drop("scores")


@query("vip_and_sr")
def vip_and_sr(spark, d):
    rows, _ = latent.with_targets(embeddings_as_spectra(spark, d))
    m = moments(rows.withColumn("all", F.lit("all")), "all")["all"]
    model = latent.fit_pls(m, P, 5)
    return spark.createDataFrame([(j, float(WN[j]), float(v), float(s)) for j, (v, s) in enumerate(zip(latent.vip(model, 5), latent.selectivity_ratio(model, 5, m, P), strict=True))], "j int, wn double, vip double, sr double")


def _pca(spark, d, k=5):
    e = embeddings_as_spectra(spark, d)
    return e, latent.fit_pca(moments(e.withColumn("y", F.array(F.lit(0.0))).withColumn("all", F.lit("all")), "all")["all"], P, k)


@query("pca_scores")
def pca_scores(spark, d):
    e, pca = _pca(spark, d)
    return e.select("sample_id", "label", F.posexplode(pca.scores(F.col("x"))).alias("component", "score"))


@query("t2_and_q")
def t2_and_q(spark, d):
    e, pca = _pca(spark, d)
    limit = oneclass.hotelling_limit(spark, e.count(), 5)
    return e.select("sample_id", pca.t2(F.col("x")).alias("t2"), pca.q(F.col("x")).alias("q")).withColumn("outlier", F.col("t2") > limit)


@query("class_tree")
def class_tree(spark, d):
    e, pca = _pca(spark, d)
    c = e.select("label", pca.scores(F.col("x")).alias("x"))
    means = to_long(c).groupBy("label", "j").agg(F.avg("v").alias("m")).toPandas()
    return spark.createDataFrame(latent.ward({k: g.sort_values("j")["m"].to_numpy() for k, g in means.groupby("label")}), "left string, right string, height double")


@query("one_class_scores")
def one_class_scores(spark, d):
    e = embeddings_as_spectra(spark, d)
    return oneclass.score(e, oneclass.fit(e)[0])


@query("one_class_decisions")
def one_class_decisions(spark, d):
    e = embeddings_as_spectra(spark, d)
    return oneclass.decide(e, oneclass.fit(e)[0])


@query("one_class_sensitivity")
def one_class_sensitivity(spark, d):
    return oneclass.leave_group_out(embeddings_as_spectra(spark, d))


@query("one_class_procrustes")
def one_class_procrustes(spark, d):
    return oneclass.procrustes_sensitivity(embeddings_as_spectra(spark, d))


def _farthest_sql(k: int) -> str:
    """Farthest-first written out: c0 is the group farthest from the centroid, each next one the group whose least
    distance to those before is greatest."""
    m = f"{E}, m AS MATERIALIZED (SELECT group_id AS g, j, avg(v) AS m FROM e GROUP BY ALL), o AS (SELECT j, avg(m) AS o FROM m GROUP BY j), c0 AS MATERIALIZED (SELECT g FROM m JOIN o USING (j) GROUP BY g ORDER BY round(sum((m - o) ** 2), 12) DESC, g LIMIT 1)"
    for i in range(1, k):
        before = " UNION ALL ".join(f"SELECT g FROM c{n}" for n in range(i))
        m += f""", d{i} AS (SELECT p.g, q.g AS h, round(sum((p.m - q.m) ** 2), 12) AS d FROM m p JOIN m q USING (j) WHERE q.g IN ({before}) AND p.g NOT IN ({before}) GROUP BY ALL),
c{i} AS MATERIALIZED (SELECT g FROM d{i} GROUP BY g ORDER BY min(d) DESC, g LIMIT 1)"""
    return f"WITH {m} " + " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS step, g AS group_id FROM c{i}" for i in range(k))


@query("kennard_stone", _farthest_sql(8))
def kennard_stone(spark, d):
    chosen = splits.kennard_stone(splits.group_means(embeddings_as_spectra(spark, d)), 8)
    return spark.createDataFrame([(i, g) for i, g in enumerate(chosen)], "step int, group_id string")


@query("calibration_pooled")
def calibration_pooled(spark, d):
    out, _, _ = quantify.calibrate(splits.hashed_folds(embeddings_as_spectra(spark, d), 5))
    return metrics.regression(out)


@query("calibration_by_class")
def calibration_by_class(spark, d):
    return quantify.by_class(splits.hashed_folds(embeddings_as_spectra(spark, d), 3))


@query("figures_of_merit")
def figures_of_merit(spark, d):
    e = splits.hashed_folds(embeddings_as_spectra(spark, d), 5)
    m = quantify.merit(e, quantify.calibrate(e)[2])
    return spark.createDataFrame([tuple(m[k] for k in ("sensitivity", "noise", "lod", "loq"))], "sensitivity double, noise double, lod double, loq double")


@query("permutation_test")
def permutation_test(spark, d):
    e = embeddings_as_spectra(spark, d)
    return validation.permutation_test(e, sorted(r[0] for r in e.select("label").distinct().collect()), 3)


@query("cv_anova")
def cv_anova(spark, d):
    rows, classes = latent.with_targets(splits.hashed_folds(embeddings_as_spectra(spark, d), 5))
    curve = latent.lv_curve(rows, P, 3)
    n = rows.count()
    press = curve[-1][1] ** 2 * n * len(classes)
    r = resampling.cv_anova(spark, press / (1 - curve[-1][2]), press, n, 3)
    return spark.createDataFrame([(r["f"], r["p"], r["df_model"], r["df_residual"])], "f double, p_value double, df_model int, df_residual int")


@query("jackknife_coefficients")
def jackknife_coefficients(spark, d):
    rows, _ = latent.with_targets(splits.hashed_folds(embeddings_as_spectra(spark, d), 5))
    return spark.createDataFrame(resampling.martens(rows, P, 3))


@query("bootstrap_accuracy", f"""WITH {_PAIRS}, n AS (SELECT row_number() OVER (ORDER BY sample_id) - 1 AS i, CAST(label = predicted AS INT) AS hit, count(*) OVER () AS n FROM pairs),
draws AS (SELECT b, CAST(('0x' || substr(md5('7:' || b || ':' || i), 1, 8)) AS BIGINT) % n AS i FROM n, range(0, 200) t(b)), a AS (SELECT b, avg(hit) AS acc FROM draws JOIN n USING (i) GROUP BY b)
SELECT count(*) AS n_boot, round(quantile_cont(acc, 0.025), 9) AS low, round(quantile_cont(acc, 0.975), 9) AS high FROM a""")
def bootstrap_accuracy(spark, d):
    return resampling.bootstrap_accuracy(_pairs(spark, d)).select("n_boot", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query("variable_selection")
def variable_selection(spark, d):
    rows, _ = latent.with_targets(splits.hashed_folds(embeddings_as_spectra(spark, d), 4))
    return spark.createDataFrame(selection.selection_table(rows, P, 3))


@query("score_new_samples")
def score_new_samples(spark, d):
    e = embeddings_as_spectra(spark, d)
    package = scoring.train_package(e.where("sample_id % 5 <> 0"), 4)
    return scoring.score(e.where("sample_id % 5 = 0"), package).select("sample_id", "label", "predicted", "confidence", "t2", "q", "accepted")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Balanced accuracy and company of PLS-DA under the default preset: every sample is transformed and predicted
    by what the folds that never saw it teach."""
    e = embeddings_as_spectra(spark, d)
    rows, classes = latent.with_targets(e.join(splits.grouped_folds(e, 5), "group_id"))
    steps = pipeline.Steps(preprocess.preset("snv_sg_mc"))
    parts = pipeline.fold_moments(rows, steps)
    best = latent.choose_lv(pipeline.curve(parts, len(classes), 6))
    return metrics.summary(pipeline.out_of_fold(rows, classes, steps, best, parts=parts))


@query("plsda_summary")
def plsda_summary(spark, d):
    return flagship(spark, d)


def queries() -> dict[str, Query]:
    from prismlake.plans import model_queries  # noqa: F401  (registers its queries)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
