"""Cleaning, imputation and text-rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.catalog.common import MATRIX, MATRIX_CTE, WEEKS, outcome_matrix, query, rounded, table
from riskframe.functions import dates, scalars, text
from riskframe.operators import impute, labels, schema
from riskframe.presets import clinical

# --- projections and predicates ---------------------------------------------------


@query("""SELECT p_partkey, try_cast(p_name AS DOUBLE) AS name_number, p_size::DOUBLE AS prefix,
  CASE WHEN p_type = 'PROMO' THEN 0 ELSE p_size END::INT AS token FROM part""")
def number_parsing(spark, sf):
    p = table(spark, sf, "part")
    sized = p.withColumn("size_text", F.concat_ws(" ", F.col("p_size"), F.lit("cm")))
    sized = sized.withColumn("token_text", F.when(F.col("p_type") == "PROMO", "无").otherwise(F.col("p_size").cast("string")))
    sized = schema.coerce_numeric(sized.withColumn("name_number", F.col("p_name")), ["name_number"])
    return sized.select("p_partkey", "name_number", scalars.number_prefix(F.col("size_text")).alias("prefix"),
                        scalars.token_to_int(F.col("token_text"), ["无", "未见"]).alias("token"))


@query("""SELECT o_orderkey, (o_totalprice >= 300000)::INT AS y_binary,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' ELSE o_orderpriority END AS priority,
  coalesce(CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderstatus END, o_orderpriority) AS first_known
FROM orders""")
def binarize_and_label(spark, sf):
    o = table(spark, sf, "orders")
    marked = F.when(F.col("o_orderstatus") == "O", " None ").otherwise(F.col("o_orderstatus"))
    return o.select("o_orderkey", scalars.binarize(F.col("o_totalprice"), 300000.0).alias("y_binary"),
                    scalars.map_label(F.col("o_orderpriority"), {"1-URGENT": "urgent"}).alias("priority"),
                    scalars.first_present(marked, F.col("o_orderpriority")).alias("first_known"))


@query(f"""WITH {MATRIX_CTE} SELECT row_id, w0_click, w0_view, w0_purchase, w0_signup, w0_error,
  w1_click, w1_view, w1_purchase, w1_signup, w1_error, w2_view FROM matrix WHERE w2_view IS NOT NULL""")
def temporal_features(spark, sf):
    """Features of earlier weeks for one target, rows with that target."""
    m = outcome_matrix(spark, sf)
    kept, _ = schema.temporal_filter(m.columns, "w2_view", WEEKS)
    shared = schema.shared_features(m.columns, ["w2_view", "w3_view"], MATRIX, WEEKS)
    if kept != shared:
        raise ValueError("both rules give the same columns here")
    return schema.drop_null_target(m, "w2_view").select(*kept, "w2_view")


@query(f"""WITH {MATRIX_CTE} SELECT variable, left(variable, 2) AS day, substr(variable, 4) AS metric,
  CASE WHEN substr(variable, 4) IN ('view', 'click') THEN 60.0 ELSE 50.0 END::DOUBLE AS positive_min,
  count(value) AS n, count(*) FILTER (WHERE value >= CASE WHEN substr(variable, 4) IN ('view', 'click') THEN 60.0 ELSE 50.0 END) AS n_positive
FROM long GROUP BY variable""")
def long_targets(spark, sf):
    from riskframe.plans.outcomes import matrix_targets
    long = schema.to_long(outcome_matrix(spark, sf), ["row_id"], MATRIX)
    dim = matrix_targets(spark).withColumnRenamed("target", "variable")
    rows = schema.target_dim(long, dim, "variable")
    return rows.groupBy("variable", "day", "metric", "positive_min").agg(
        F.count("value").alias("n"), F.count_if(F.col("value") >= F.col("positive_min")).alias("n_positive"))


@query("""WITH f AS (SELECT l_returnflag, l_linestatus, (l_returnflag = 'A')::INT AS is_a, (l_linestatus = 'O')::INT AS is_o, l_tax FROM lineitem)
SELECT c AS column_name, n FROM (SELECT 'is_a' AS c, sum(is_a)::BIGINT AS n FROM f UNION ALL SELECT 'is_o', sum(is_o)::BIGINT FROM f)""")
def binary_columns(spark, sf):
    li = table(spark, sf, "lineitem").select(
        (F.col("l_returnflag") == "A").cast("double").alias("is_a"), (F.col("l_linestatus") == "O").cast("int").alias("is_o"), "l_tax")
    found = schema.infer_binary_columns(li, li.columns)
    flags = schema.round_binary_columns(li.withColumn("is_a", F.col("is_a") * 0.9), found)
    return schema.to_long(flags, [], found, "column_name", "v").groupBy("column_name").agg(
        F.sum("v").cast("bigint").alias("n"))


@query("""SELECT key, name, balance, 0 AS "__meta_is_generated", 'original' AS "__meta_rule" FROM (
  SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance FROM customer
  UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier)""")
def align_union(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("key"))
    both = schema.align_union([c, s], ["key", "name", "balance"])
    schema.require_columns(both, ["key", "balance"], min_rows=10)
    return schema.attach_provenance(both, {"is_generated": 0, "rule": "original"})


# --- imputation ---------------------------------------------------------------------


@query("""WITH e AS (SELECT event_id, user_id, event_type, CASE WHEN event_type <> 'error' THEN value END AS seen FROM events)
SELECT event_id, last_value(seen IGNORE NULLS) OVER (ORDER BY event_id) AS filled,
  last_value(seen IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS filled_by_user FROM e""")
def forward_fill(spark, sf):
    e = table(spark, sf, "events").withColumn("seen", F.when(F.col("event_type") != "error", F.col("value")))
    e = e.select("event_id", "user_id", F.col("seen").alias("filled"), F.col("seen").alias("filled_by_user"))
    e = impute.forward_fill(e, ["filled"], "event_id", span=4096)
    return impute.forward_fill(e, ["filled_by_user"], "event_id", ["user_id"], span=100_000).drop("user_id")


@query("""WITH t AS (SELECT p_partkey, CASE WHEN p_type <> 'PROMO' THEN p_retailprice END AS price,
  CASE WHEN p_type <> 'PROMO' THEN p_size END AS size FROM part),
m AS (SELECT size FROM t WHERE size IS NOT NULL GROUP BY size ORDER BY count(*) DESC, size LIMIT 1)
SELECT p_partkey, round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM t)), 6) AS price,
  coalesce(t.size, m.size) AS size, coalesce(price, 4.0) AS price_or_default, 200.0::DOUBLE AS created FROM t, m""")
def fill_missing(spark, sf):
    """Median, mode and constant fills of the same gaps."""
    known = lambda c: F.when(F.col("p_type") != "PROMO", F.col(c))
    p = table(spark, sf, "part").select("p_partkey", known("p_retailprice").alias("price"), known("p_size").alias("size"),
                                        known("p_retailprice").alias("price_or_default"))
    p = impute.fill_default(p, {"price_or_default": 4.0, "created": 200.0})
    return rounded(impute.fill_mode(impute.fill_median(p, ["price"]), "size"))


@query(f"""WITH {MATRIX_CTE}, q AS (SELECT variable, quantile_cont(value, 0.5) AS m FROM long GROUP BY 1)
SELECT row_id, round(coalesce(w0_view, (SELECT m FROM q WHERE variable = 'w0_view'), 0), 6) AS w0_view,
  round(coalesce(w3_error, (SELECT m FROM q WHERE variable = 'w3_error'), 0), 6) AS w3_error FROM matrix""")
def inference_medians(spark, sf):
    m = outcome_matrix(spark, sf).select("row_id", "w0_view", "w3_error")
    return rounded(impute.impute_at_inference(m, ["w0_view", "w3_error"]))


@query("""WITH t AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size::DOUBLE END AS volume, p_retailprice AS price, p_size FROM part)
SELECT p_partkey, CASE WHEN coalesce(volume, p_size) = 30 THEN 15.0 ELSE coalesce(volume, p_size) END AS volume,
  CASE WHEN coalesce(volume, p_size) = 30 THEN 1.0 ELSE price END AS price FROM t""")
def text_fill_and_correct(spark, sf):
    p = table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_size") > 25, F.col("p_size").cast("double")).alias("volume"), F.col("p_retailprice").alias("price"),
        F.concat_ws("", F.lit("mix, "), F.col("p_size").cast("string"), F.lit(" ml")).alias("formula"))
    p = impute.fill_from_text(p, "volume", "formula", clinical.VOLUME_IN_TEXT)
    return impute.correct_records(p, [(F.col("volume") == 30, {"volume": 15.0, "price": 1.0})]).drop("formula")


@query("""WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS sp FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 6) AS l_quantity, round((l_extendedprice - mp) / sp, 6) AS l_extendedprice FROM lineitem, s""")
def standardize(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    stats = impute.fit_standardizer(li, ["l_quantity", "l_extendedprice"])
    return rounded(impute.apply_standardizer(li, stats))


# --- text rules -----------------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN lower(trim(lang)) = 'nan' THEN '' ELSE trim(lang) END AS lang,
  coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(source, '\\s+', '', 'g'), '[^0-9A-Za-z一-鿿]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown') AS source
FROM documents""")
def clean_names(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.clean_text(F.col("lang")).alias("lang"), text.sanitize_name(F.col("source")).alias("source"))


@query("""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderstatus AS s FROM orders)
SELECT o_orderkey, CASE s WHEN 'P' THEN make_date(2023, month(d), day(d)) ELSE d END AS parsed,
  month(CASE s WHEN 'P' THEN make_date(2023, month(d), day(d)) ELSE d END)::INT AS month,
  (isodow(CASE s WHEN 'P' THEN make_date(2023, month(d), day(d)) ELSE d END) - 1)::INT AS weekday,
  strftime(CASE s WHEN 'P' THEN make_date(2023, month(d), day(d)) ELSE d END, '%Y-%m-%d') AS iso
FROM d WHERE NOT (s = 'P' AND month(d) = 2 AND day(d) = 29)""")
def mixed_date(spark, sf):
    """Order dates written as serial, month.day and ISO text, then parsed."""
    o = table(spark, sf, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    written = (F.when(F.col("o_orderstatus") == "F", F.datediff("d", F.lit("1899-12-30").cast("date")).cast("string"))
               .when(F.col("o_orderstatus") == "P", F.concat(F.month("d"), F.lit("."), F.lpad(F.day("d").cast("string"), 2, "0"), F.lit("日")))
               .otherwise(F.date_format("d", "yyyy/M/d")))
    parsed = o.select("o_orderkey", dates.parse_mixed_date(written).alias("parsed")).where(F.col("parsed").isNotNull())
    parts = dates.date_parts(F.col("parsed"))
    return parsed.select("o_orderkey", "parsed", *[e.alias(n) for n, e in parts.items()])


@query("""SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 1 WHEN 'HOUSEHOLD' THEN 0 END::INT AS gender,
  CASE c_mktsegment WHEN 'BUILDING' THEN 2 WHEN 'MACHINERY' THEN 3 WHEN 'HOUSEHOLD' THEN 6 WHEN 'FURNITURE' THEN 4 END::INT AS grade FROM customer""")
def coded_person(spark, sf):
    c = table(spark, sf, "customer")
    seg = F.col("c_mktsegment")
    sex = F.when(seg == "BUILDING", "男性").when(seg == "MACHINERY", " m ").when(seg == "HOUSEHOLD", "Female")
    grade = (F.when(seg == "BUILDING", "ASA Ⅱ级").when(seg == "MACHINERY", "iii").when(seg == "HOUSEHOLD", "ASA：Ⅵ级")
             .when(seg == "FURNITURE", "约4级"))
    return c.select("c_custkey", text.parse_gender(sex).alias("gender"), text.parse_grade(grade).alias("grade"))


WORD_RULES = [text.KeywordRule("english", ["the ", "and "]), text.KeywordRule("german", ["der ", "und "], [("sch", "ich")]),
              text.KeywordRule("french", ["eau", "les "])]


@query("""SELECT class, count(*) AS n FROM (SELECT CASE
  WHEN regexp_matches(text, 'the |and ') THEN 'english'
  WHEN regexp_matches(text, 'der |und ') OR (contains(text, 'sch') AND contains(text, 'ich')) THEN 'german'
  WHEN regexp_matches(text, 'eau|les ') THEN 'french' ELSE 'other' END AS class FROM documents) GROUP BY class""")
def classify_first(spark, sf):
    d = table(spark, sf, "documents")
    return (d.select(text.classify_keywords(F.col("text"), WORD_RULES, "other").alias("class"))
            .groupBy("class").agg(F.count(F.lit(1)).alias("n")))


_NAMES = """WITH t AS (SELECT p_partkey, p_size, replace(p_name, ' ', ' ＋ ') || '，t-' || p_type || ';无/II' AS names FROM part),
l AS (SELECT p_partkey, p_size, list_filter(list_transform(regexp_split_to_array(replace(replace(names, '＋', '+'), '，', ','), '[+,/;|]'), lambda x: trim(x)),
  lambda x: x <> '' AND x NOT IN ('无', '未见', 'none', 'None', 'I', 'II', '1', '2')) AS labels FROM t)"""


def _named(spark, sf):
    """Multi-valued text composed from the name and type of a part."""
    p = table(spark, sf, "part")
    return p.select("p_partkey", "p_size", F.concat(F.replace("p_name", F.lit(" "), F.lit(" ＋ ")), F.lit("，t-"), F.col("p_type"), F.lit(";无/II")).alias("names"))


@query(_NAMES + " SELECT p_partkey, labels FROM l")
def split_label_lists(spark, sf):
    return _named(spark, sf).select("p_partkey", text.split_labels(F.col("names")).alias("labels"))


COLOUR_RULES = [text.KeywordRule("warm", ["red", "orange"]), text.KeywordRule("thing", ["ring", "widget"])]


@query(_NAMES + """, c AS (SELECT p_partkey, list_distinct(list_transform(labels, lambda x: CASE
    WHEN regexp_matches(lower(x), 'red|orange') THEN 'warm' WHEN regexp_matches(lower(x), 'ring|widget') THEN 'thing' ELSE 'rest' END)) AS k,
    p_size FROM l)
SELECT p_partkey, CASE WHEN p_size = 1 THEN ['absent'] ELSE list_sort(k) END AS classes FROM c""")
def classify_multi(spark, sf):
    named = F.when(F.col("p_size") == 1, "未做").otherwise(F.replace("names", F.lit(";无/II"), F.lit("/II")))
    return _named(spark, sf).select("p_partkey", F.array_sort(
        text.classify_multi(named, COLOUR_RULES, ["无", "未做"], "absent", "rest")).alias("classes"))


_HOT = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query(_NAMES + """, e AS (SELECT p_partkey, unnest(labels) AS label FROM l),
k AS (SELECT label FROM e GROUP BY label HAVING count(*) >= 10), h AS (SELECT k.label, count(*) FILTER (WHERE list_contains(l.labels, k.label)) AS n FROM k, l GROUP BY 1)
SELECT 'names_oh_' || replace(label, '-', '_') AS flag, n FROM h UNION ALL
SELECT 'names_oh_其他', count(*) FILTER (WHERE len(list_filter(labels, lambda x: NOT list_contains(all_k, x))) > 0) FROM l, (SELECT list(label) AS all_k FROM k)""")
def onehot_multi(spark, sf):
    hot, names = labels.one_hot_multi(_named(spark, sf), "names", 10)
    return schema.to_long(hot, [], names, "flag", "v").groupBy("flag").agg(F.sum("v").cast("bigint").alias("n"))


@query("SELECT p_partkey, " + ", ".join(f"(p_type = '{t}')::INT AS \"type_{t}\"" for t in _HOT) + " FROM part")
def onehot_fixed(spark, sf):
    hot, names = labels.one_hot_fixed(table(spark, sf, "part"), "p_type", _HOT, "type_")
    return hot.select("p_partkey", *names)


@query("""SELECT doc_id, contains(text, 'the')::INT AS has_the, regexp_matches(text, '[0-9]{3}')::INT AS has_number FROM documents""")
def term_flags(spark, sf):
    terms = [labels.Term("the", "the"), labels.Term("number", "[0-9]{3}", True), labels.Term("absent", "\u0000never\u0000")]
    flagged, kept = labels.contains_flags(table(spark, sf, "documents"), "text", terms, "has_", skip_unseen=True)
    return flagged.select("doc_id", *[f"has_{t.name}" for t in kept])


def _formulas(spark, sf):
    """Dose text composed from the columns of a part."""
    p = table(spark, sf, "part")
    size, price = F.col("p_size").cast("string"), F.round(F.col("p_retailprice") / 10000, 3).cast("string")
    t = (F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("Drug "), size, F.lit("ug，"), size, F.lit("0ml 2ml/h")))
         .when(F.col("p_type") == "LARGE", F.concat(F.lit("Drug"), size, F.lit("MG+other 3mg")))
         .when(F.col("p_type") == "MEDIUM", F.concat(price, F.lit("％Drug "), size, F.lit(" ml；5ml")))
         .when(F.col("p_type") == "PROMO", F.concat(F.lit("Drug 0.5% 各"), size, F.lit("ml")))
         .when(F.col("p_type") == "SMALL", F.concat(F.lit("Drug稀释至"), size, F.lit("ml(7ml)")))
         .otherwise(F.concat(F.lit("Drugx "), size, F.lit("g"))))
    return p.select("p_partkey", "p_type", "p_size", t.alias("formula"))


_FORMULA = """WITH p AS (SELECT p_partkey, p_type, p_size::DOUBLE AS s, round(p_retailprice / 10000, 3) AS pct FROM part)"""


@query(_FORMULA + """ SELECT p_partkey, round(CASE p_type WHEN 'ECONOMY' THEN s / 1000.0 WHEN 'LARGE' THEN s
  WHEN 'PROMO' THEN 0.5 * 10 * s END, 6) AS dose FROM p""")
def dose_extract(spark, sf):
    """Only the plain percent sign counts here, so the full-width one gives no dose."""
    return rounded(_formulas(spark, sf).select("p_partkey", text.extract_dose(F.col("formula"), "Drug").alias("dose")))


@query(_FORMULA + """ SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN s * 10 WHEN 'MEDIUM' THEN s + 5 WHEN 'PROMO' THEN 2 * s
  WHEN 'SMALL' THEN 7.0 END AS final_volume, CASE p_type WHEN 'ECONOMY' THEN s * 10 WHEN 'MEDIUM' THEN s + 5 WHEN 'PROMO' THEN 2 * s
  WHEN 'SMALL' THEN s + 7 END AS summed_volume FROM p""")
def volume_extract(spark, sf):
    f = F.col("formula")
    return _formulas(spark, sf).select("p_partkey", text.extract_volume(f).alias("final_volume"),
                                       text.extract_volume(f, prefer_final=False).alias("summed_volume"))


@query(_FORMULA + """ SELECT p_partkey, (p_type <> 'STANDARD')::INT AS has_dose_text, round(CASE p_type WHEN 'ECONOMY' THEN s / 1000.0 WHEN 'LARGE' THEN s
  WHEN 'MEDIUM' THEN pct * 10 * s WHEN 'PROMO' THEN 0.5 * 10 * 2 * s WHEN 'SMALL' THEN s + 7 ELSE 0 END, 6) AS dose FROM p""")
def block_dose(spark, sf):
    f = _formulas(spark, sf)
    has = (~F.col("formula").rlike("Drugx")).cast("int")
    dose = text.zero_when_absent(F.col("has_dose_text"), text.extract_block_dose(F.col("formula"), "(?:Drug)"))
    return rounded(f.withColumn("has_dose_text", has).select("p_partkey", "has_dose_text", text.row_total([dose]).alias("dose")))


@query(_FORMULA + """ SELECT 'Drug' AS drug, count(*) AS named, count(*) FILTER (WHERE p_type IN ('ECONOMY', 'LARGE', 'PROMO')) AS dosed,
  count(*) - count(*) FILTER (WHERE p_type IN ('ECONOMY', 'LARGE', 'PROMO')) AS without_dose FROM p""")
def dose_coverage(spark, sf):
    f = _formulas(spark, sf).withColumn("has", F.col("formula").contains("Drug").cast("int"))
    f = f.withColumn("dose", text.zero_when_absent(F.col("has"), text.extract_dose(F.col("formula"), "Drug")))
    return labels.extraction_coverage(f, {"Drug": ("has", "dose")})


@query("""SELECT s_suppkey, CASE WHEN s_nationkey < 8 THEN s_acctbal / 1000.0 WHEN s_nationkey < 16 THEN
  CASE WHEN s_acctbal < 10 THEN s_acctbal * 1000 ELSE s_acctbal END ELSE s_acctbal END AS mg FROM supplier""")
def mass_units(spark, sf):
    unit = F.when(F.col("s_nationkey") < 8, "UG").when(F.col("s_nationkey") < 16, "g").otherwise("mg")
    return table(spark, sf, "supplier").select("s_suppkey", text.mass_to_mg(F.col("s_acctbal"), unit).alias("mg"))


@query("""SELECT p_partkey, p_type || ':(' || p_size || 'ml)+50%' AS formula FROM part""")
def normalized_formula(spark, sf):
    raw = F.concat(F.lit(" 盐酸"), F.col("p_type"), F.lit("：（"), F.col("p_size"), F.lit("ml）＋50&"))
    return table(spark, sf, "part").select("p_partkey", text.normalize_formula(raw).alias("formula"))


@query()
def vectorized_surgeries(spark, sf):
    """Raw surgical table composed from orders, customers and parts, then vectorised."""
    from riskframe.plans.outcomes import raw_surgeries
    from riskframe.plans.vectorize import vectorize_table
    return rounded(vectorize_table(raw_surgeries(spark, sf)))


@query("""SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_id, c_custkey AS key, CASE WHEN c_custkey % 5 > 0 THEN c_name END AS name,
  c_acctbal AS balance FROM customer""")
def csv_round_trip(spark, sf):
    """Customers written as CSV files of doubling size, read back as text with missing words, numbered in file order and typed."""
    import uuid

    from riskframe.session import shared_folder
    from riskframe.sources import tables
    path = f"{shared_folder(spark)}/customers-{uuid.uuid4().hex}"
    name = F.when(F.col("c_custkey") % 5 > 0, F.col("c_name")).otherwise(F.when(F.col("c_custkey") % 2 > 0, "N/A").otherwise("nan"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), name.alias("name"), F.col("c_acctbal").alias("balance"))
    spread = c.repartitionByRange(16, F.floor(F.log2(F.col("key") + 1))).sortWithinPartitions("key")
    tables.write_table(spread, path, "csv")
    back = tables.with_row_id(tables.read_table(spark, path))
    return back.select("row_id", F.col("key").cast("bigint").alias("key"), "name", scalars.to_double(F.col("balance")).alias("balance"))
