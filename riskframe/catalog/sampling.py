"""Split, sampling and augmentation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.catalog.common import MATRIX, MATRIX_CTE, outcome_matrix, query, rounded, table
from riskframe.operators import augment, profile, schema, splits
from riskframe.plans.outcomes import POSITIVE_MIN, matrix_targets

SEED = 42
N_TEST = "CASE WHEN n < 3 THEN (CASE WHEN n >= 2 THEN 1 ELSE 0 END) WHEN t + v >= n THEN 1 ELSE t END"
N_VAL = "CASE WHEN n < 3 THEN 0 WHEN t + v >= n THEN 1 ELSE v END"


def order_by(key: str, seed: object = SEED) -> str:
    """Seeded order of the rows in SQL."""
    return f"md5({key} || '|{seed}'), {key}"


def _priced(spark, sf):
    """Orders as two binary targets in long form."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), "o_totalprice")
    both = o.withColumns({"high": (F.col("o_totalprice") >= 300000).cast("int"), "rare": (F.col("o_totalprice") >= 499900).cast("int")})
    return both.unpivot(["row_id"], ["high", "rare"], "target", "y_binary")


_PRICED = """o AS (SELECT o_orderkey AS row_id, 'high' AS target, (o_totalprice >= 300000)::INT AS y_binary FROM orders
  UNION ALL SELECT o_orderkey, 'rare', (o_totalprice >= 499900)::INT FROM orders)"""


def stratified_sql(source: str, group: str, columns: str) -> str:
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order_by('row_id')}) AS rn,
  count(*) OVER (PARTITION BY {group}) AS n FROM {source}),
k AS (SELECT *, greatest(1, round_even(n * 0.1, 0)) AS t, greatest(1, round_even(n * 0.1, 0)) AS v FROM r)
SELECT {columns}, CASE WHEN rn <= {N_TEST} THEN 'test' WHEN rn <= {N_TEST} + {N_VAL} THEN 'validation' ELSE 'train' END AS split FROM k"""


@query(f"WITH {_PRICED}, " + stratified_sql("o", "target, y_binary", "row_id, target, y_binary"))
def stratified_split(spark, sf):
    return splits.stratified_split(_priced(spark, sf), SEED)


def _matrix_splits(spark, sf):
    long = schema.to_long(outcome_matrix(spark, sf), ["row_id"], MATRIX, "target", "value")
    return splits.reference_splits(long, matrix_targets(spark), SEED)


_min = " ".join(f"WHEN '{m}' THEN {v}" for m, v in POSITIVE_MIN.items())
_LABELLED = f"""lab AS (SELECT row_id, variable AS target, value AS y_value, (CASE substr(variable, 4) {_min} END)::DOUBLE AS positive_min,
  (value >= CASE substr(variable, 4) {_min} END)::BIGINT AS y_binary FROM long WHERE value IS NOT NULL)"""
_MATRIX_SPLITS = f"WITH {MATRIX_CTE}, {_LABELLED}, " + stratified_sql(
    "lab", "target, y_binary", "row_id, target, 'Week' || substr(target, 2, 1) || '_' || upper(substr(target, 4, 1)) || substr(target, 5) AS target_en, "
    "CASE WHEN substr(target, 2, 1) IN ('0', '1') THEN 'main' ELSE 'exploratory' END AS target_tier, 42::BIGINT AS split_seed, y_value, y_binary, positive_min")


@query(_MATRIX_SPLITS)
def reference_splits(spark, sf):
    return _matrix_splits(spark, sf)


@query(f"""SELECT target, split_seed, count(*) AS n_total, count(*) FILTER (WHERE y_binary = 1) AS n_positive,
  round(avg((y_binary = 1)::INT), 6) AS positive_rate, """ + ", ".join(
    f"count(*) FILTER (WHERE split = '{s}') AS {s}_size, count(*) FILTER (WHERE split = '{s}' AND y_binary = 1) AS {s}_positive"
    for s in ("train", "validation", "test")) + f" FROM ({_MATRIX_SPLITS}) GROUP BY target, split_seed")
def split_summary(spark, sf):
    return rounded(profile.split_summary(_matrix_splits(spark, sf)))


_RARE = {"w0_click": 95.0, "w1_view": 95.0, "w2_signup": 95.0}


@query(f"""WITH {MATRIX_CTE}, y AS (SELECT row_id, variable AS target, (value >= 95)::INT AS y FROM long
  WHERE variable IN ('w0_click', 'w1_view', 'w2_signup') AND value IS NOT NULL),
ids AS (SELECT DISTINCT row_id FROM y), s AS (SELECT unnest(range(0, 64)) AS salt),
r AS (SELECT salt, row_id, row_number() OVER (PARTITION BY salt ORDER BY md5(row_id || '#' || salt || '|42'), row_id || '#' || salt) AS rn,
  count(*) OVER (PARTITION BY salt) AS n FROM ids, s),
c AS (SELECT salt, row_id, CASE WHEN rn <= greatest(1, round_even(n * 0.1, 0)) THEN 'test'
  WHEN rn <= 2 * greatest(1, round_even(n * 0.1, 0)) THEN 'validation' ELSE 'train' END AS split FROM r),
need AS (SELECT target FROM y GROUP BY target HAVING sum(y) >= 3),
ok AS (SELECT salt FROM (SELECT salt, target, split FROM c JOIN y USING (row_id) WHERE y = 1 AND target IN (SELECT target FROM need)
  GROUP BY 1, 2, 3) GROUP BY salt HAVING count(*) = 3 * (SELECT count(*) FROM need))
SELECT row_id, '__shared_backbone__' AS target, 42::BIGINT AS split_seed, split, salt::INT AS salt FROM c WHERE salt = (SELECT min(salt) FROM ok)""")
def shared_split(spark, sf):
    m = outcome_matrix(spark, sf)
    y = schema.to_long(m, ["row_id"], list(_RARE), "target", "value").withColumn(
        "y_binary", F.when(F.col("value").isNotNull(), (F.col("value") >= 95.0).cast("int")))
    return splits.shared_split(y, SEED)


@query(f"""WITH s AS ({_MATRIX_SPLITS}), m AS (SELECT c_custkey AS row_id, c_acctbal FROM customer)
SELECT m.row_id, m.c_acctbal, s.split FROM m LEFT JOIN (SELECT * FROM s WHERE target = 'w0_view' AND split_seed = 42) s USING (row_id)""")
def split_lookup(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("row_id"), "c_acctbal")
    return splits.apply_split(c, _matrix_splits(spark, sf), "w0_view", SEED, validate=False)


@query(f"""WITH s AS ({_MATRIX_SPLITS}) SELECT c_custkey AS row_id FROM customer
WHERE c_custkey NOT IN (SELECT row_id FROM s WHERE target = 'w0_view' AND split_seed = 42)""")
def rows_without_split(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("row_id"))
    return splits.missing_from_split(c, _matrix_splits(spark, sf), "w0_view", SEED)


_RANDOM = f"""SELECT o_orderkey, o_totalprice, CASE WHEN rn <= ceil(round(ceil(round(n * 0.2, 9)) * 0.5, 9)) THEN 'test'
  WHEN rn <= ceil(round(n * 0.2, 9)) THEN 'validation' ELSE 'train' END AS split FROM
  (SELECT *, row_number() OVER (ORDER BY {order_by('o_orderkey')}) AS rn, count(*) OVER () AS n FROM orders)"""


@query(_RANDOM)
def random_split(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return splits.random_split(o, 0.1, 0.1, SEED, "o_orderkey")


@query(f"""SELECT row_id, y_binary, rn <= least(greatest(1, round_even(n * 0.15, 0)), n - 1) AS held_out FROM
  (SELECT o_orderkey AS row_id, (o_totalprice >= 300000)::INT AS y_binary,
    row_number() OVER (PARTITION BY (o_totalprice >= 300000) ORDER BY {order_by('o_orderkey')}) AS rn,
    count(*) OVER (PARTITION BY (o_totalprice >= 300000)) AS n FROM orders)""")
def stratified_two_way(spark, sf):
    y = _priced(spark, sf).where(F.col("target") == "high").drop("target")
    return splits.stratified_two_way(y, "y_binary", 0.15, SEED)


@query(f"""WITH {MATRIX_CTE}, r AS (SELECT row_id, (w0_click >= 60)::INT AS a, (w1_view >= 60)::INT AS b,
  row_number() OVER (ORDER BY {order_by('row_id', '42#0')}) AS rn, count(*) OVER () AS n FROM matrix)
SELECT row_id, a, b, rn <= least(greatest(1, round_even(n * 0.2, 0)), n - 1) AS held_out FROM r""")
def multitask_two_way(spark, sf):
    m = outcome_matrix(spark, sf).select(
        "row_id", (F.col("w0_click") >= 60).cast("int").alias("a"), (F.col("w1_view") >= 60).cast("int").alias("b"))
    return splits.multitask_two_way(m, ["a", "b"], 0.2, SEED)


@query(f"""SELECT o_orderkey AS row_id, 'train' AS origin, split FROM ({_RANDOM.replace('o_totalprice, ', '')})
UNION ALL SELECT s_suppkey, 'named', CASE WHEN s_nationkey < 5 THEN 'test' WHEN s_nationkey < 8 THEN 'validation' ELSE 'train' END FROM supplier""")
def resolved_split(spark, sf):
    """No named part: a random split; named parts win otherwise."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.lit("train").alias("origin"))
    s = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("row_id"), F.lit("named").alias("origin"),
        F.when(F.col("s_nationkey") < 5, "test").when(F.col("s_nationkey") < 8, "validation").otherwise("other").alias("__meta_dataset_split"))
    one = splits.resolve_split(o, "any", SEED)
    return one.unionByName(splits.resolve_split(s, "any", SEED).select("row_id", "origin", "split"))


@query(f"""SELECT o_orderkey AS row_id, o_totalprice FROM orders ORDER BY {order_by('o_orderkey')}
LIMIT (SELECT greatest(1, round_even(count(*) * 0.137, 0))::BIGINT FROM orders)""")
def sample_fraction(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), "o_totalprice")
    return splits.sample_fraction(o, 0.137, SEED)


@query(f"SELECT o_orderkey AS row_id, (ntile(4) OVER (ORDER BY {order_by('o_orderkey')}) - 1)::INT AS fold FROM orders")
def kfold(spark, sf):
    return splits.kfold(table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id")), 4, SEED)


@query("""WITH b AS (SELECT c_custkey AS row_id, CASE WHEN c_acctbal > 5000 THEN 2.5 ELSE 1.0 END::DECIMAL(28, 10) AS w,
  md5(c_custkey || '|42#row') AS h FROM customer),
p AS (SELECT row_id, w, row_number() OVER (ORDER BY h, row_id) AS rn, sum(w) OVER (ORDER BY h, row_id ROWS UNBOUNDED PRECEDING) AS cum,
  sum(w) OVER () AS total, count(*) OVER () AS n FROM b),
i AS (SELECT row_id, (cum - w)::DOUBLE / total::DOUBLE * n AS lo, cum::DOUBLE / total::DOUBLE * n AS hi FROM p),
d AS (SELECT rn - 1 AS draw, ('0x' || substr(md5(rn || '|42#draw'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * n AS u FROM p)
SELECT row_id, draw FROM i JOIN d ON u >= lo AND u < hi""")
def weighted_resample(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("row_id"), F.when(F.col("c_acctbal") > 5000, 2.5).otherwise(1.0).alias("w"))
    return splits.weighted_resample(c, "w", SEED).select("row_id", "draw")


# --- augmentation -------------------------------------------------------------------

SPEC = augment.AugmentSpec(
    sex="sex", age="age", weight="weight", families={"rest": [f"w{i}_click" for i in range(4)], "movement": [f"w{i}_view" for i in range(4)]},
    same_day=["w0_click", "w0_view"], same_day_from=60, wave_above=70)


def people(spark, sf):
    """Outcome matrix with demographics from the customer table."""
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("row_id"), F.when(F.col("c_nationkey") < 12, 1.0).otherwise(0.0).alias("sex"),
        F.floor(F.abs("c_acctbal") / 100).cast("double").alias("age"), F.round(F.abs("c_acctbal") / 90, 1).alias("weight"))
    keep = ["row_id", *SPEC.scores]
    return outcome_matrix(spark, sf).select(*keep).join(c, "row_id")


_SCORES = ", ".join(SPEC.scores)
_PEOPLE = f"""WITH {MATRIX_CTE}, people AS (SELECT m.row_id, {_SCORES}, CASE WHEN c_nationkey < 12 THEN 1.0 ELSE 0.0 END::DOUBLE AS sex,
  floor(abs(c_acctbal) / 100)::DOUBLE AS age, round(abs(c_acctbal) / 90, 1) AS weight FROM matrix m JOIN customer ON c_custkey = m.row_id),
trig AS (SELECT *, concat_ws('|', CASE WHEN sex = 1 THEN 'male' END, CASE WHEN age > 60 THEN 'age_gt_60' END, 'same_day_pain_gte_60') AS reason
  FROM people WHERE (sex = 1 OR age > 60) AND greatest(coalesce(w0_click, w0_view), coalesce(w0_view, w0_click)) >= 60)"""
_GRID = """, d AS (SELECT unnest([-2, -1, 0, 1, 2]) AS x), g AS (SELECT s.s, a.x AS a, w.x AS w,
  CASE s.s WHEN 0 THEN 'high_pain_original_jitter' ELSE 'high_pain_upshift_jitter' END AS rule,
  CASE s.s WHEN 0 THEN 'orig' ELSE 'upshift' END || '_age_' || printf('%+d', a.x) || '_weight_' || printf('%+d', w.x) AS name
  FROM (SELECT unnest([0, 1]) AS s) s, d a, d w WHERE NOT (s.s = 0 AND a.x = 0 AND w.x = 0)),
j AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY md5(row_id || '|' || name || '|42'), s, a, w) AS rn
  FROM trig, g) WHERE rn <= 10)"""
_jit = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN round(greatest(0, {c} + s), 4) END AS {c}" for c in SPEC.scores)
_JITTER = f"SELECT row_id, {_jit}, sex, age + a AS age, round(weight + w, 4) AS weight, rule, reason, s::INT AS shift, name FROM j"


def _wave_sql() -> str:
    parts = []
    for fam, cols in SPEC.families.items():
        high = " + ".join(f"coalesce(({c} > 70)::INT, 0)" for c in cols)
        for step, way in ((1, "up"), (-1, "down")):
            vals = ", ".join((f"CASE WHEN {c} IS NOT NULL THEN round(greatest(0, {c} + {step}), 4) END AS {c}" if c in cols else c) for c in SPEC.scores)
            parts.append(f"SELECT row_id, {vals}, sex, age, weight, '{fam}_wave_{way}' AS rule, '{fam}_pain_2of4_gt_70' AS reason, "
                         f"{step}::INT AS shift, '{fam}_wave_{way}' AS name FROM people WHERE {high} >= 2")
    return " UNION ALL ".join(parts)


_SHOWN = ["row_id", *SPEC.scores, "sex", "age", "weight"]


def _shown(df):
    return rounded(df.select(*_SHOWN, F.col(augment.RULE).alias("rule"), F.col(augment.TRIGGER).alias("reason"),
                             F.col(augment.SCORE_SHIFT).alias("shift"), F.col(augment.VARIANT).alias("name")), 4)


def _train(spark, sf):
    return augment.original_rows(people(spark, sf), "train")


@query(_PEOPLE + " SELECT row_id, reason FROM trig")
def trigger_rows(spark, sf):
    return augment.trigger_rows(people(spark, sf), SPEC).select("row_id", F.col(augment.TRIGGER).alias("reason"))


@query(f"""WITH {MATRIX_CTE} SELECT row_id, CASE WHEN w0_click IS NOT NULL THEN least(90, greatest(10, w0_click - 20)) END AS clipped FROM matrix""")
def shift_clip(spark, sf):
    from riskframe.functions.scalars import shift_clip as clip
    return outcome_matrix(spark, sf).select("row_id", clip(F.col("w0_click"), -20.0, 10.0, 90.0).alias("clipped"))


@query(_PEOPLE + _GRID + " " + _JITTER)
def jitter_candidates(spark, sf):
    return _shown(augment.jitter_candidates(_train(spark, sf), SPEC, SEED))


@query(_PEOPLE + " " + _wave_sql())
def wave_rows(spark, sf):
    return _shown(augment.wave_rows(_train(spark, sf), SPEC))


_values = ", ".join([*SPEC.scores, "sex", "age", "weight"])
_ALL_GEN = _PEOPLE + _GRID + f""", gen AS ({_JITTER} UNION ALL {_wave_sql()}),
uniq AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY {_values} ORDER BY row_id, rule, name) AS k FROM gen) WHERE k = 1)"""


def _generated(spark, sf):
    train = _train(spark, sf)
    return augment.augment_training_part(train.withColumn("weight", F.round("weight", 4)), SPEC, SEED)


@query(_ALL_GEN + " SELECT * FROM uniq")
def dedup_generated(spark, sf):
    """Coarse weights make different variants coincide."""
    rows = _generated(spark, sf).withColumn("weight", F.round("weight", 4))
    return _shown(rows.withColumn("row_id", F.col(augment.PARENT)))


@query(_ALL_GEN + " SELECT rule, count(*) AS rows, count(DISTINCT row_id) AS parents FROM uniq GROUP BY rule")
def lineage_counts(spark, sf):
    return profile.lineage_counts(_generated(spark, sf))


@query(_ALL_GEN + """ SELECT count(*) AS parents, min(n) AS min, max(n) AS max, round(avg(n), 6) AS mean
FROM (SELECT row_id, count(*) AS n FROM uniq GROUP BY 1)""")
def duplicates_per_parent(spark, sf):
    return rounded(profile.duplicates_per_parent(_generated(spark, sf)))


@query(_ALL_GEN + """ SELECT (SELECT count(*) FROM people) AS train_original_rows, (SELECT count(*) FROM supplier WHERE s_nationkey < 9) AS validation_original_rows,
  (SELECT count(*) FROM supplier WHERE s_nationkey >= 9) AS test_original_rows, (SELECT count(*) FROM uniq) AS generated_rows,
  (SELECT count(*) FROM people) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM uniq) AS final_rows""")
def assembled_summary(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("row_id"), "s_nationkey", F.col("s_acctbal").alias("weight"))
    val = augment.original_rows(s.where("s_nationkey < 9").drop("s_nationkey"), "validation")
    test = augment.original_rows(s.where("s_nationkey >= 9").drop("s_nationkey"), "test")
    whole = augment.assemble_augmented(_train(spark, sf), _generated(spark, sf), val, test)
    return augment.augmentation_report(whole)["summary"]


@query(_ALL_GEN + f""", n AS (SELECT row_id, count(*) AS n FROM uniq GROUP BY 1)
SELECT p.row_id, {_values}, 'direct_duplicate' AS rule, 'matched_reference_augmentation_count' AS reason, 0::INT AS shift,
  'duplicate_' || lpad(i::VARCHAR, 4, '0') AS name FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM people JOIN n USING (row_id)) p""")
def copy_control(spark, sf):
    return _shown(augment.copy_control(_train(spark, sf), _generated(spark, sf)))


_POOL = _ALL_GEN + f""", pool AS (SELECT 'o' || row_id AS key, row_id, 0 AS gen FROM people UNION ALL
  SELECT row_id || '/' || name, row_id, 1 FROM uniq),
side AS (SELECT *, CASE WHEN row_id IN (SELECT row_id FROM uniq) THEN 'augmented' ELSE 'untouched' END AS side FROM pool),
cnt AS (SELECT count(*) FILTER (WHERE side = 'untouched') AS nu, count(*) FILTER (WHERE side = 'augmented') AS na FROM side),
pick AS (SELECT key, gen, side FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY {order_by('key')}) AS rn FROM side) s, cnt
  WHERE nu = 0 OR na = 0 OR side = 'untouched' OR rn <= least(nu, na))"""


def _pool(spark, sf):
    rows = augment.align_union([_train(spark, sf), _generated(spark, sf)])
    key = F.when(F.col(augment.IS_GENERATED) == 1, F.concat_ws("/", augment.PARENT, augment.VARIANT)).otherwise(
        F.concat(F.lit("o"), F.col(augment.PARENT)))
    return splits.balanced_training_pool(rows.withColumn("key", key), SEED, "key")


@query(_POOL + " SELECT key, gen::INT AS gen FROM pick")
def balanced_pool(spark, sf):
    return _pool(spark, sf)[0].select("key", F.col(augment.IS_GENERATED).alias("gen"))


@query(_POOL + """ SELECT (SELECT nu FROM cnt) AS untouched_available, (SELECT na FROM cnt) AS augmented_pool_available,
  count(*) FILTER (WHERE side = 'untouched') AS untouched_selected, count(*) FILTER (WHERE side = 'augmented' AND gen = 0) AS augmented_original_selected,
  count(*) FILTER (WHERE gen = 1) AS generated_selected, count(*) AS selected_total FROM pick""")
def balanced_pool_counts(spark, sf):
    return _pool(spark, sf)[1]


_SYNTH = f"""WITH cand AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, l_quantity AS score, CASE WHEN l_tax >= 0.5 THEN 1 ELSE 0 END::INT AS flag,
  row_number() OVER (ORDER BY {order_by('(l_orderkey * 10 + l_linenumber)')}) AS all_rn, count(*) OVER () AS all_n,
  row_number() OVER (PARTITION BY l_quantity >= 45 ORDER BY {order_by('(l_orderkey * 10 + l_linenumber)')}) AS hit_rn FROM (
    SELECT DISTINCT ON (l_orderkey * 10 + l_linenumber) * FROM lineitem ORDER BY l_orderkey * 10 + l_linenumber, l_quantity, l_tax)),
need AS (SELECT ceil(0.5 * count(*) FILTER (WHERE o_totalprice >= 400000)) AS k, ceil(0.25 * count(*)) AS m FROM orders)"""


def _candidates(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    first = F.min_by(F.struct("l_quantity", "l_tax"), F.struct("l_quantity", "l_tax")).alias("r")
    one = li.groupBy("row_id").agg(first)
    return one.select("row_id", F.col("r.l_quantity").alias("score"), F.col("r.l_tax").alias("flag"))


def _scored_orders(spark, sf):
    return table(spark, sf, "orders").select((F.when(F.col("o_totalprice") >= 400000, 50.0).otherwise(1.0)).alias("score"))


_META = """1 AS "__meta_is_generated", -1::BIGINT AS "__meta_source_row_id", '{task}' AS "__meta_generation_task" """
_META_COLS = ["__meta_is_generated", "__meta_source_row_id", "__meta_generation_task"]


@query(_SYNTH + f" SELECT row_id, score, flag, {_META.format(task='classification')} FROM cand, need WHERE score >= 45 AND hit_rn <= k")
def select_synthetic(spark, sf):
    out = augment.select_synthetic(_candidates(spark, sf), _scored_orders(spark, sf), "score", 45.0, 0.5, ["flag"])
    return out.select("row_id", "score", "flag", *_META_COLS)


@query(_SYNTH + f""" SELECT row_id, score, flag, {_META.format(task='classification')} FROM
  (SELECT *, row_number() OVER (ORDER BY score DESC, {order_by('row_id')}) AS rn FROM cand), (SELECT ceil(0.5 * count(*) FILTER (WHERE c_acctbal >= 60)) AS k FROM customer)
  WHERE rn <= k""")
def select_synthetic_fallback(spark, sf):
    """No candidate reaches the threshold, so the highest scores are taken."""
    train = table(spark, sf, "customer").select(F.col("c_acctbal").alias("score"))
    out = augment.select_synthetic(_candidates(spark, sf), train, "score", 60.0, 0.5, ["flag"])
    return out.select("row_id", "score", "flag", *_META_COLS)


@query(_SYNTH + f" SELECT row_id, score, flag, {_META.format(task='regression')} FROM cand, need WHERE all_rn <= least(m, all_n)")
def take_synthetic_regression(spark, sf):
    out = augment.take_synthetic_regression(_candidates(spark, sf), _scored_orders(spark, sf), "score", 45.0, 0.25, ["flag"])
    return out.select("row_id", "score", "flag", *_META_COLS)


# --- neighbours -----------------------------------------------------------------------

_NEAR = """WITH x AS (SELECT vec_id AS row_id, embedding::DOUBLE[] AS v, (label = 0)::INT AS y FROM embeddings),
nn AS (SELECT * FROM (SELECT a.row_id, b.row_id AS other, b.y, row_number() OVER (PARTITION BY a.row_id ORDER BY list_distance(a.v, b.v), b.row_id) AS rn
  FROM x a JOIN x b ON a.row_id <> b.row_id WHERE a.y = 1) WHERE rn <= 10),
dg AS (SELECT row_id, count(*) FILTER (WHERE y = 0) AS n_majority, count(*) FILTER (WHERE y = 0) >= 5 AND count(*) FILTER (WHERE y = 0) < 10 AS danger FROM nn GROUP BY 1)"""


def _classes(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"), (F.col("label") == 0).cast("int").alias("y"))


@query(_NEAR + " SELECT * FROM dg")
def danger_rows(spark, sf):
    from riskframe.operators import neighbours
    return neighbours.danger_rows(_classes(spark, sf), 10)


def _unit(part: str) -> str:
    return f"('0x' || substr(md5(g || '|42#{part}'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


@query(_NEAR + f""", d AS (SELECT row_id, row_number() OVER (ORDER BY md5(row_id || '|42#danger'), row_id) AS rn, count(*) OVER () AS nd FROM dg WHERE danger),
mn AS (SELECT * FROM (SELECT a.row_id, b.row_id AS other, row_number() OVER (PARTITION BY a.row_id ORDER BY list_distance(a.v, b.v), b.row_id) AS rn
  FROM x a JOIN x b ON a.row_id <> b.row_id WHERE a.y = 1 AND b.y = 1) WHERE rn <= 5),
g AS (SELECT unnest(range(0, (SELECT count(*) FILTER (WHERE y = 0) - count(*) FILTER (WHERE y = 1) FROM x))) AS g),
pick AS (SELECT g, floor({_unit('row')} * (SELECT max(nd) FROM d)) + 1 AS rn, floor({_unit('to')} * 5) + 1 AS rk, {_unit('step')} AS step FROM g)
SELECT g AS generated_id, d.row_id AS from_id, mn.other AS to_id, round(step, 6) AS step, round(a.v[1] + (b.v[1] - a.v[1]) * step, 6) AS f0
FROM pick JOIN d USING (rn) JOIN mn ON mn.row_id = d.row_id AND mn.rn = rk JOIN x a ON a.row_id = d.row_id JOIN x b ON b.row_id = mn.other""")
def borderline_smote(spark, sf):
    from riskframe.operators import neighbours
    out = neighbours.borderline_smote(_classes(spark, sf), 5, 10, SEED)
    return rounded(out.select("generated_id", "from_id", "to_id", "step", F.get("features", 0).alias("f0")))


@query()
def borderline_smote_table(spark, sf):
    """Generated rows in table form for one outcome of the user matrix."""
    from riskframe.operators import neighbours
    m = outcome_matrix(spark, sf).where(F.col("w1_view").isNotNull()).withColumn("y", (F.col("w1_view") >= 95).cast("int"))
    features = [f"w0_{t}" for t in ("click", "view", "purchase", "signup", "error")]
    out = neighbours.borderline_smote(neighbours.feature_array(m, features), 5, 10, SEED, "borderline-2")
    return rounded(neighbours.smote_rows(out, [c for c in m.columns if c not in ("row_id", "y")], features, "w1_view", 95.0))
