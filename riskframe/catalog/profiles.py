"""Profiling and correlation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.catalog.common import MATRIX, MATRIX_CTE, TYPES, WEEKS, outcome_matrix, query, rounded, table
from riskframe.operators import correlation, labels, profile, schema


@query(f"""WITH {MATRIX_CTE}
SELECT variable, count(value) AS n_non_missing, count(*) - count(value) AS n_missing,
  round((count(*) - count(value)) / count(*)::DOUBLE, 6) AS missing_rate, round(avg(value), 6) AS mean,
  round(stddev_samp(value), 6) AS std, round(quantile_cont(value, 0.5), 6) AS median,
  round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr,
  round(min(value), 6) AS min, round(max(value), 6) AS max
FROM long GROUP BY variable""")
def outcome_profile(spark, sf):
    return rounded(profile.describe_columns(outcome_matrix(spark, sf), MATRIX))


@query("""SELECT 'l_quantity' AS variable, count(l_quantity) AS n_non_missing, count(*) - count(l_quantity) AS n_missing,
  0.0::DOUBLE AS missing_rate, round(avg(l_quantity), 4) AS mean, round(stddev_samp(l_quantity), 4) AS std,
  round(quantile_cont(l_quantity, 0.5), 4) AS median,
  round(quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25), 4) AS iqr, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem
UNION ALL SELECT 'l_extendedprice', count(l_extendedprice), count(*) - count(l_extendedprice), 0.0::DOUBLE,
  round(avg(l_extendedprice), 4), round(stddev_samp(l_extendedprice), 4), round(quantile_cont(l_extendedprice, 0.5), 4),
  round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 4), min(l_extendedprice), max(l_extendedprice) FROM lineitem
UNION ALL SELECT 'l_discount', count(l_discount), count(*) - count(l_discount), 0.0::DOUBLE,
  round(avg(l_discount), 4), round(stddev_samp(l_discount), 4), round(quantile_cont(l_discount, 0.5), 4),
  round(quantile_cont(l_discount, 0.75) - quantile_cont(l_discount, 0.25), 4), min(l_discount), max(l_discount) FROM lineitem""")
def describe_lineitem(spark, sf):
    return rounded(profile.describe_columns(
        table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), 4)


def labelled_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, sf, "labels"), "doc_id", "left")


_LABELLED = "(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


@query(f"""WITH t AS (SELECT *, CASE WHEN lang = 'de' THEN NULL ELSE lang END AS lang_text FROM {_LABELLED})
SELECT v AS variable, n AS missing_count, round(n / total::DOUBLE, 6) AS missing_ratio FROM (
  SELECT 'quality' AS v, count(*) - count(quality) AS n, count(*) AS total FROM t
  UNION ALL SELECT 'toxic', count(*) - count(toxic), count(*) FROM t
  UNION ALL SELECT 'lang_text', count(*) - count(lang_text), count(*) FROM t
  UNION ALL SELECT 'source', count(*) - count(source), count(*) FROM t)""")
def missingness_rank(spark, sf):
    marked = labelled_documents(spark, sf).withColumn(
        "lang_text", F.when(F.col("lang") == "de", " nan ").otherwise(F.col("lang")))
    return rounded(profile.missingness(schema.normalize_missing(marked), ["quality", "toxic", "lang_text", "source"]))


@query(f"SELECT doc_id, lang, n_chars, toxic FROM {_LABELLED}")
def prune_sparse(spark, sf):
    dropped = schema.drop_columns(labelled_documents(spark, sf), name_contains=["sour"])
    return schema.prune_sparse_columns(dropped, 0.7, ["toxic"])


@query("""WITH c AS (SELECT l_suppkey::VARCHAR AS value, count(*) AS n FROM lineitem GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS rn, sum(n) OVER () AS total FROM c)
SELECT 'l_suppkey' AS variable, CASE WHEN rn <= 30 THEN value ELSE '<OTHER>' END AS category,
  sum(n)::BIGINT AS count, round(sum(n) / max(total)::DOUBLE, 6) AS ratio FROM r GROUP BY 2""")
def frequency_top_other(spark, sf):
    return rounded(profile.frequency_table(table(spark, sf, "lineitem"), ["l_suppkey"]))


@query(f"""WITH t AS (SELECT quality::VARCHAR AS quality, toxic::VARCHAR AS toxic FROM {_LABELLED}),
c AS (SELECT 'quality' AS variable, quality AS v, count(*) AS n FROM t GROUP BY 2
  UNION ALL SELECT 'toxic', toxic, count(*) FROM t GROUP BY 2)
SELECT variable, coalesce(v, '<NA>') AS category, n AS count,
  round(n / (sum(n) OVER (PARTITION BY variable))::DOUBLE, 6) AS ratio FROM c""")
def frequency_with_missing(spark, sf):
    return rounded(profile.in_table_order(profile.frequency_table(labelled_documents(spark, sf), ["quality", "toxic"])))


def _histogram_sql(columns):
    parts = []
    for c in columns:
        parts.append(f"""SELECT '{c}' AS variable, v, (SELECT count(*) FROM lineitem) AS total, n, lo, hi, bins, (hi - lo) / bins AS w FROM
  (SELECT {c} AS v FROM lineitem), (SELECT count({c}) AS n, min({c}) AS lo, max({c}) AS hi,
   least(30, greatest(10, floor(sqrt(count({c})))::INT)) AS bins FROM lineitem)""")
    return f"""WITH s AS ({' UNION ALL '.join(parts)}),
g AS (SELECT *, least(floor((v - lo) / (hi - lo) * bins), bins - 1)::INT AS g FROM s),
b AS (SELECT variable, CASE WHEN v < lo + g * w THEN g - 1 WHEN v >= lo + (g + 1) * w AND g < bins - 1 THEN g + 1 ELSE g END AS bin,
  count(*) AS n FROM g GROUP BY 1, 2),
f AS (SELECT DISTINCT variable, lo, hi, bins, w, total, unnest(range(0, bins))::INT AS bin FROM s)
SELECT f.variable, f.bin, round(lo + f.bin * w, 6) AS bin_left,
  round(CASE WHEN f.bin = bins - 1 THEN hi ELSE lo + (f.bin + 1) * w END, 6) AS bin_right,
  coalesce(b.n, 0) AS count, round(coalesce(b.n, 0) / total::DOUBLE, 6) AS ratio
FROM f LEFT JOIN b ON f.variable = b.variable AND f.bin = b.bin"""


@query(_histogram_sql(["l_extendedprice", "l_quantity"]))
def histogram_numeric(spark, sf):
    return rounded(profile.histogram(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"]))


PART_TYPES = ["STANDARD", "SMALL", "MEDIUM", "LARGE", "ECONOMY", "PROMO"]


@query(f"""WITH c AS (SELECT unnest({PART_TYPES}) AS t, unnest(range(0, 6)) AS i), n AS (SELECT count(*) AS total FROM part)
SELECT CASE t WHEN 'PROMO' THEN 'Promotion' ELSE t END AS category,
  (SELECT count(*) FROM part WHERE p_type = t) AS count,
  round((SELECT count(*) FROM part WHERE p_type = t) / total::DOUBLE, 6) AS ratio, i::INT AS position FROM c, n""")
def flag_family_counts(spark, sf):
    flags, _ = labels.one_hot_fixed(table(spark, sf, "part"), "p_type", PART_TYPES, "type_")
    return rounded(profile.grouped_flag_counts(flags, "type_", PART_TYPES, {"PROMO": "Promotion"}))


@query("""SELECT m::INT AS value, (SELECT count(*) FROM orders WHERE month(o_orderdate) = m) AS count,
  round((SELECT count(*) FROM orders WHERE month(o_orderdate) = m) / (SELECT count(*) FROM orders)::DOUBLE, 6) AS ratio
FROM range(1, 13) t(m)""")
def month_domain(spark, sf):
    return rounded(profile.domain_count(table(spark, sf, "orders"), F.month("o_orderdate"), 1, 12))


def _levels(spark, sf):
    """Discount level of each line, one column per return flag."""
    li = table(spark, sf, "lineitem")
    return li.select(*[F.when(F.col("l_returnflag") == f, F.col("l_discount")).otherwise(0.0).alias(f) for f in "ANR"])


_LEVELS = """WITH l AS (SELECT l_returnflag AS drug, l_discount AS level, count(*) AS count FROM lineitem
  WHERE l_discount > 0 GROUP BY 1, 2), n AS (SELECT count(*) AS total FROM lineitem)"""


@query(_LEVELS + """ SELECT drug, level, count, round(count / total::DOUBLE, 6) AS ratio_all_rows,
  round(count / (sum(count) OVER (PARTITION BY drug))::DOUBLE, 6) AS ratio_within_drug_nonzero FROM l, n""")
def level_counts(spark, sf):
    return rounded(profile.dose_levels(_levels(spark, sf), ["A", "N", "R"]))


LEVELS = [round(0.01 * i, 2) for i in range(1, 11)]


@query(_LEVELS + " SELECT drug, " + ", ".join(
    f"coalesce(sum(count) FILTER (WHERE round(level, 2) = {v}), 0)::BIGINT AS \"{profile.level_column(v)}\"" for v in LEVELS)
    + " FROM l GROUP BY drug")
def level_pivot(spark, sf):
    return profile.pivot_counts(profile.dose_levels(_levels(spark, sf), ["A", "N", "R"]), ["drug"], "level", "count")


@query(_LEVELS + """ SELECT drug, level, count, round(count / (sum(count) OVER (PARTITION BY drug))::DOUBLE, 6) AS share FROM l""")
def level_share(spark, sf):
    d = profile.dose_levels(_levels(spark, sf), ["A", "N", "R"]).select("drug", "level", "count")
    return rounded(profile.row_share(d, ["drug"], "level", "count"))


@query(f"""WITH {MATRIX_CTE}
SELECT upper(left(variable, 2)) AS day, variable AS column_name, count(value) AS non_missing_count,
  count(*) - count(value) AS missing_count, round((count(*) - count(value)) / count(*)::DOUBLE, 6) AS missing_ratio,
  round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median
FROM long WHERE variable LIKE '%_purchase' GROUP BY variable""")
def trend_by_period(spark, sf):
    return rounded(profile.trend_by_day(outcome_matrix(spark, sf), {w.upper(): f"{w}_purchase" for w in WEEKS}))


_PROFILED = ["l_quantity", "l_discount", "l_returnflag", "l_extendedprice", "l_shipdate", "l_linenumber"]


def _profile_sql():
    one = lambda c, typed: f"""SELECT '{c}' AS variable, count(*) AS n_rows, count(try_cast({c}::VARCHAR AS DOUBLE)) AS n_numeric,
  count(DISTINCT try_cast({c}::VARCHAR AS DOUBLE)) AS n_distinct_numeric, {str(typed).lower()} AS typed FROM lineitem"""
    union = " UNION ALL ".join(one(c, c not in ("l_returnflag", "l_shipdate")) for c in _PROFILED)
    return f"""SELECT variable, n_rows, n_numeric, n_distinct_numeric, CASE WHEN (typed OR n_numeric / n_rows::DOUBLE >= 0.95)
  AND n_distinct_numeric > 20 THEN 'histogram' ELSE 'bar' END AS analysis_type FROM ({union})"""


@query(_profile_sql())
def profile_manifest(spark, sf):
    return profile.profile_table(table(spark, sf, "lineitem"), _PROFILED)


_PAIRS_CTE = MATRIX_CTE + f""",
ord AS (SELECT unnest({MATRIX}) AS v, unnest(range(0, {len(MATRIX)})) AS i),
pairs AS (SELECT a.v AS variable_1, b.v AS variable_2 FROM ord a JOIN ord b ON a.i < b.i),
both_ AS (SELECT p.*, x.value AS x, y.value AS y FROM pairs p JOIN long x ON x.variable = p.variable_1
  JOIN long y ON y.variable = p.variable_2 AND x.row_id = y.row_id WHERE x.value IS NOT NULL AND y.value IS NOT NULL),
pear AS (SELECT variable_1, variable_2, count(*) AS n, CASE WHEN count(*) >= 3 AND min(x) < max(x) AND min(y) < max(y)
  THEN corr(x, y) END AS r FROM both_ GROUP BY 1, 2),
ranked AS (SELECT variable_1, variable_2, x, y,
  rank() OVER (PARTITION BY variable_1, variable_2 ORDER BY x) + (count(*) OVER (PARTITION BY variable_1, variable_2, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY variable_1, variable_2 ORDER BY y) + (count(*) OVER (PARTITION BY variable_1, variable_2, y) - 1) / 2.0 AS ry FROM both_),
spear AS (SELECT variable_1, variable_2, count(*) AS n, CASE WHEN count(*) >= 3 AND min(x) < max(x) AND min(y) < max(y)
  THEN corr(rx, ry) END AS r FROM ranked GROUP BY 1, 2),
rel AS (SELECT p.variable_1, p.variable_2, coalesce(q.n, 0) AS n, q.r AS pearson_r, round(s.r, 9) AS spearman_r,
  CASE WHEN left(p.variable_1, 2) = left(p.variable_2, 2) THEN 'within_day'
       WHEN substr(p.variable_1, 4) = substr(p.variable_2, 4) THEN 'cross_day_same_outcome' ELSE 'cross_day_mixed_outcome' END AS relationship
  FROM pairs p LEFT JOIN pear q USING (variable_1, variable_2) LEFT JOIN spear s USING (variable_1, variable_2))"""


@query(f"WITH {_PAIRS_CTE} SELECT variable_1, variable_2, n AS n_pairwise, round(pearson_r, 6) AS pearson_r FROM rel")
def pearson_pairs(spark, sf):
    return rounded(correlation.pearson_pairs(outcome_matrix(spark, sf), MATRIX))


@query(f"WITH {_PAIRS_CTE} SELECT variable_1, variable_2, n AS n_pairwise, round(spearman_r, 6) AS spearman_r FROM rel")
def spearman_pairs(spark, sf):
    return rounded(correlation.spearman_pairs(outcome_matrix(spark, sf), MATRIX))


def _both(spark, sf):
    m = outcome_matrix(spark, sf)
    pair = ["variable_1", "variable_2"]
    out = correlation.pearson_pairs(m, MATRIX).join(correlation.spearman_pairs(m, MATRIX).drop("n_pairwise"), pair)
    d1, m1 = correlation.split_name(F.col("variable_1"), WEEKS)
    d2, m2 = correlation.split_name(F.col("variable_2"), WEEKS)
    return (out.withColumn("spearman_r", F.round("spearman_r", 9)).withColumn("abs_spearman_r", F.abs("spearman_r"))
            .withColumn("relationship", correlation.relationship(d1, m1, d2, m2)))


@query()
def correlation_pvalues(spark, sf):
    return rounded(correlation.pairwise_table(outcome_matrix(spark, sf), MATRIX, WEEKS))


_matrix_cols = ", ".join(
    f"round(max(CASE WHEN b = '{c}' THEN r END), 6) AS {c}" for c in MATRIX)


@query(f"""WITH {_PAIRS_CTE}, two AS (SELECT variable_1 AS a, variable_2 AS b, pearson_r AS r FROM rel
  UNION ALL SELECT variable_2, variable_1, pearson_r FROM rel UNION ALL SELECT v, v, 1.0 FROM ord)
SELECT a AS variable, {_matrix_cols} FROM two GROUP BY a""")
def correlation_matrix(spark, sf):
    pairs = correlation.pearson_pairs(outcome_matrix(spark, sf), MATRIX)
    return rounded(correlation.correlation_matrix(pairs, MATRIX, "pearson_r"))


@query(f"""WITH {_PAIRS_CTE} SELECT relationship, count(*) AS n_pairs, count(*) FILTER (WHERE abs(spearman_r) >= 0.7) AS n_strong,
  count(*) FILTER (WHERE abs(spearman_r) >= 0.4 AND abs(spearman_r) < 0.7) AS n_moderate,
  count(*) FILTER (WHERE abs(spearman_r) < 0.4) AS n_weak, round(max(abs(spearman_r)), 6) AS max_abs
FROM rel WHERE spearman_r IS NOT NULL GROUP BY relationship""")
def strength_summary(spark, sf):
    return rounded(correlation.strength_summary(_both(spark, sf)))


@query(f"""WITH {_PAIRS_CTE} SELECT substr(variable_1, 4) AS metric, round(quantile_cont(spearman_r, 0.5), 6) AS median_r,
  round(max(spearman_r), 6) AS max_r,
  arg_max(variable_1 || ' vs ' || variable_2, abs(spearman_r)) AS strongest_pair
FROM rel WHERE relationship = 'cross_day_same_outcome' AND spearman_r IS NOT NULL GROUP BY 1""")
def same_outcome_summary(spark, sf):
    return rounded(correlation.same_outcome_summary(_both(spark, sf), WEEKS))


@query(f"""WITH {_PAIRS_CTE} SELECT variable_1, variable_2, round(spearman_r, 6) AS spearman_r,
  CASE WHEN spearman_r IS NULL THEN 'not computable' ELSE
   (CASE WHEN abs(spearman_r) >= 0.7 THEN 'strong' WHEN abs(spearman_r) >= 0.4 THEN 'moderate'
         WHEN abs(spearman_r) >= 0.2 THEN 'weak' ELSE 'very weak' END) || ' ' ||
   (CASE WHEN spearman_r >= 0 THEN 'positive' ELSE 'negative' END) END AS strength
FROM rel WHERE (substr(variable_1, 4) IN ('click', 'view')) <> (substr(variable_2, 4) IN ('click', 'view'))""")
def group_pair_strength(spark, sf):
    from riskframe.functions.scalars import strength_label
    left = [f"{w}_{t}" for w in WEEKS for t in ("click", "view")]
    right = [c for c in MATRIX if c not in left]
    pairs = correlation.spearman_pairs(outcome_matrix(spark, sf), MATRIX)
    pairs = pairs.withColumn("spearman_r", F.round("spearman_r", 9))
    return rounded(correlation.group_pairs(pairs, left, right).select(
        "variable_1", "variable_2", "spearman_r", strength_label(F.col("spearman_r")).alias("strength")))


@query(f"""WITH {MATRIX_CTE}, m AS (SELECT variable, (count(*) - count(value)) / count(*)::DOUBLE AS missing_rate
  FROM long GROUP BY 1) SELECT variable, round(missing_rate, 6) AS missing_rate FROM m WHERE missing_rate > 0.05
ORDER BY m.missing_rate DESC, variable LIMIT 5""")
def high_missing_top(spark, sf):
    d = profile.missingness(outcome_matrix(spark, sf), MATRIX).withColumnRenamed("missing_ratio", "missing_rate")
    return rounded(correlation.high_missing(d).select("variable", "missing_rate"))


_PRED = "(SELECT l_quantity AS y_true, round(l_extendedprice / 2100.0, 1) AS y_pred FROM lineitem)"


def predicted_quantity(spark, sf):
    """A simple predictor: quantity read off the price."""
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_quantity").alias("y_true"), F.round(F.col("l_extendedprice") / 2100.0, 1).alias("y_pred"))


@query(f"SELECT y_true, count(*) AS n, round(avg(abs(y_true - y_pred)), 6) AS mean_abs_error FROM {_PRED} GROUP BY 1")
def error_by_true(spark, sf):
    return rounded(profile.error_by_true(predicted_quantity(spark, sf)))


@query(f"""WITH e AS (SELECT y_pred - y_true AS e FROM {_PRED}), s AS (SELECT min(e) AS lo, max(e) AS hi FROM e),
c AS (SELECT least(floor((e - lo) / ((hi - lo) / 35)), 34)::INT AS bin, count(*) AS n FROM e, s GROUP BY 1)
SELECT b::INT AS bin, round(lo + b * ((hi - lo) / 35), 6) AS bin_left, coalesce(n, 0) AS count
FROM range(0, 35) t(b) CROSS JOIN s LEFT JOIN c ON c.bin = b""")
def signed_error_histogram(spark, sf):
    return rounded(profile.signed_error_histogram(predicted_quantity(spark, sf)))


_week_names = {f"{w}": f"Week {i} " for i, w in enumerate(WEEKS)}


@query(f"""WITH {MATRIX_CTE}, s AS (SELECT variable AS feature, round(stddev_pop(value), 6) AS importance FROM long GROUP BY 1)
SELECT feature, importance, trim(regexp_replace(replace(replace(replace(replace(feature, 'w0', 'Week 0'), 'w1', 'Week 1'),
  'w2', 'Week 2'), 'w3', 'Week 3'), '_+', '_', 'g'), '_') AS display_name FROM s ORDER BY importance DESC, feature LIMIT 8""")
def top_feature_table(spark, sf):
    long = schema.to_long(outcome_matrix(spark, sf), [], MATRIX, "feature", "value")
    spread = long.groupBy("feature").agg(F.round(F.stddev_pop("value"), 6).alias("importance"))
    return profile.top_features(spread, 8, {w: f"Week {i}" for i, w in enumerate(WEEKS)})


assert len(TYPES) * len(WEEKS) == len(MATRIX)
