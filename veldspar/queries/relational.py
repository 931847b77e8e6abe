"""Star schema, identity, context, profiling, scalar and set queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldspar.contracts import checked_join
from veldspar.functions import semantics as S
from veldspar.functions.names import fold_name, folded, name_similarity
from veldspar.operators import context, identity, profile, reconcile, review, star

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


HALF = "year({d}) || CASE WHEN month({d}) <= 6 THEN '-H1' ELSE '-H2' END"
_OD = HALF.format(d="o_orderdate")

# ---- star schema -----------------------------------------------------------------------------------------------------

_METRICS_SQL = f"""m AS (SELECT {_OD} AS reporting_period, 'lineitem' AS source_workbook, l_returnflag AS source_sheet, l_orderkey AS source_row, l_linenumber AS source_column,
  s_name AS firm_name, CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE l_suppkey || '.0' END AS resolved_frn, p_type AS product_group, 'discount' AS metric_name, l_returnflag AS canonical_sheet,
  'percentage' AS measurement_unit, l_discount * 25 AS metric_value, CASE WHEN l_tax > 0.07 THEN 'missing' ELSE 'valid' END AS value_status,
  CASE WHEN l_suppkey % 5 = 0 THEN 'unmatched' ELSE 'matched' END AS match_status
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""
_FIRM_KEY = "CASE WHEN resolved_frn <> '' THEN 'FRN:' || regexp_replace(resolved_frn, '\\.0$', '') ELSE 'NAME-' || upper(substr(sha256(lower(firm_name)), 1, 16)) END"


def _metrics(spark, sf):
    j = t(spark, sf, "lineitem").join(t(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).join(t(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    named = F.col("l_suppkey") % 5 == 0
    return j.select(
        S.half_year(F.to_date("o_orderdate")).alias("reporting_period"), F.lit("lineitem").alias("source_workbook"), F.col("l_returnflag").alias("source_sheet"), F.col("l_orderkey").alias("source_row"), F.col("l_linenumber").alias("source_column"),
        F.col("s_name").alias("firm_name"), F.when(named, "").otherwise(F.concat(F.col("l_suppkey").cast("string"), F.lit(".0"))).alias("resolved_frn"), F.col("p_type").alias("product_group"), F.lit("discount").alias("metric_name"), F.col("l_returnflag").alias("canonical_sheet"),
        F.lit("percentage").alias("measurement_unit"), (F.col("l_discount") * 25).alias("metric_value"), F.when(F.col("l_tax") > 0.07, "missing").otherwise("valid").alias("value_status"), F.when(named, "unmatched").otherwise("matched").alias("match_status"),
    )


@query(
    f"""WITH {_METRICS_SQL} SELECT {_FIRM_KEY} AS firm_key, 'PRODUCT:' || product_group AS product_key, 'METRIC-' || upper(substr(sha256(canonical_sheet || '|discount|percentage'), 1, 16)) AS metric_key,
'FACT-' || upper(substr(sha256('lineitem|' || source_sheet || '|' || source_row || '|' || source_column), 1, 20)) AS fact_id, reporting_period,
CASE WHEN value_status = 'valid' AND (metric_value < 0 OR metric_value > 1) THEN 'percentage_above_expected_range' ELSE '' END AS quality_flag,
CASE WHEN value_status = 'valid' AND (metric_value < 0 OR metric_value > 1) THEN 'pending_review' ELSE 'not_flagged' END AS quality_review_status,
value_status = 'valid' AND metric_value BETWEEN 0 AND 1 AS is_analysis_ready_value FROM m"""
)
def star_fact(spark, sf):
    return star.facts(_metrics(spark, sf)).select("firm_key", "product_key", "metric_key", "fact_id", "reporting_period", "quality_flag", "quality_review_status", "is_analysis_ready_value")


@query(
    f"""WITH {_METRICS_SQL}, k AS (SELECT *, {_FIRM_KEY} AS firm_key FROM m)
SELECT firm_key, max_by(regexp_replace(resolved_frn, 'x', ''), reporting_period) AS resolved_frn, max_by(firm_name, reporting_period) AS display_firm_name, max_by(match_status, reporting_period) AS identity_match_status,
min(reporting_period) AS first_reporting_period, max(reporting_period) AS last_reporting_period, count(DISTINCT firm_name) AS observed_name_count FROM k GROUP BY 1"""
)
def star_dim_firm(spark, sf):
    m = _metrics(spark, sf)
    return star.firm_dim(m.withColumn("firm_key", star.firm_key(F.col("resolved_frn"), F.col("firm_name"))))


@query(f"WITH {_METRICS_SQL} SELECT DISTINCT 'METRIC-' || upper(substr(sha256(canonical_sheet || '|discount|percentage'), 1, 16)) AS metric_key, canonical_sheet, metric_name, measurement_unit, false AS is_additive, 'Discount' AS metric_label FROM m")
def star_dim_metric(spark, sf):
    return star.metric_dim(star.facts(_metrics(spark, sf)))


@query("SELECT user_id, event_id, event_type, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_row_per_group(spark, sf):
    return star.latest_rows(t(spark, sf, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


@query(f"""WITH p AS (SELECT DISTINCT {_OD} AS reporting_period FROM orders) SELECT reporting_period, CAST(left(reporting_period, 4) AS INT) AS year, CAST(right(reporting_period, 1) AS INT) AS half,
CAST(left(reporting_period, 4) || CASE WHEN right(reporting_period, 1) = '1' THEN '-01-01' ELSE '-07-01' END AS DATE) AS period_start, CAST(left(reporting_period, 4) || CASE WHEN right(reporting_period, 1) = '1' THEN '-06-30' ELSE '-12-31' END AS DATE) AS period_end,
lag(reporting_period) OVER (ORDER BY reporting_period) AS previous_reporting_period FROM p""")
def previous_period_dim(spark, sf):
    from veldspar.operators.marts import period_dim

    return period_dim(t(spark, sf, "orders").select(S.half_year(F.to_date("o_orderdate")).alias("reporting_period")).distinct())


# ---- windows ---------------------------------------------------------------------------------------------------------


@query("SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_type || event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS inherited_label FROM events")
def forward_fill_hierarchy(spark, sf):
    e = t(spark, sf, "events").withColumn("label", F.when(F.col("event_type") == "purchase", F.concat("event_type", F.col("event_id").cast("string"))).otherwise(" "))
    return profile.fill_down(e, ["user_id"], "event_id", ["label"]).select("user_id", "event_id", "inherited_label")


@query("""WITH s AS (SELECT *, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS section_number FROM events)
SELECT user_id, event_id, section_number, row_number() OVER (PARTITION BY user_id, section_number ORDER BY event_id)::INT AS sequence FROM s""")
def section_sequence(spark, sf):
    return profile.number_in_section(t(spark, sf, "events"), ["user_id"], "event_id", F.col("event_type") == "signup").select("user_id", "event_id", "section_number", "sequence")


_CELLS = """cells AS (SELECT o_custkey % 20 AS sheet, dense_rank() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) AS row, unnest([CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice::VARCHAR END]) AS value,
unnest(['text', 'text', 'numeric']) AS kind, unnest([1, 2, 3]) AS col FROM orders)"""


@query(
    f"""WITH {_CELLS}, f AS (SELECT *, lower(value) AS norm FROM cells WHERE trim(value) <> ''), p AS (SELECT sheet, row, count(*) AS n, count(*) FILTER (norm LIKE '%urgent%' OR norm LIKE '%high%') AS k, count(DISTINCT norm) AS d, count(*) FILTER (kind = 'text') AS x, count(*) FILTER (kind = 'numeric') AS y FROM f GROUP BY 1, 2),
q AS (SELECT *, lead(row) OVER w AS nr, lead(n) OVER w AS nn FROM p WINDOW w AS (PARTITION BY sheet ORDER BY row)),
s AS (SELECT sheet, row, round(n * 1.5::DOUBLE + k * 2 + d / n * 2 + x / n - y / n + least(CASE WHEN nr = row + 1 THEN nn ELSE 0 END / n, 1), 4) AS score FROM q WHERE row <= 40)
SELECT sheet, row, score, row_number() OVER (PARTITION BY sheet ORDER BY score DESC, row)::INT AS candidate_rank FROM s"""
)
def header_candidate_rank(spark, sf):
    """Every order is a worksheet row; each seventh is a row of blank cells, which leaves a gap."""
    o = t(spark, sf, "orders")
    rank = F.dense_rank().over(W.partitionBy(F.col("o_custkey") % 20).orderBy("o_orderkey"))
    cell = lambda i, c, k: F.struct(F.lit(i).alias("col"), F.lit(k).alias("kind"), F.when(F.col("o_orderkey") % 7 != 0, F.col(c).cast("string")).alias("value"))
    cells = o.select((F.col("o_custkey") % 20).alias("sheet"), rank.cast("long").alias("row"), F.explode(F.array(cell(1, "o_orderpriority", "text"), cell(2, "o_orderstatus", "text"), cell(3, "o_totalprice", "numeric"))).alias("c")).select("sheet", "row", "c.*")
    return profile.header_candidates(cells, ["sheet"], ["urgent", "high"]).select("sheet", "row", "score", "candidate_rank")


@query("SELECT l_returnflag, l_linestatus, count(*) AS cells, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag) * 100, 4) AS share_percent FROM lineitem GROUP BY 1, 2")
def share_of_total(spark, sf):
    c = t(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("cells"))
    return c.withColumn("share_percent", F.round(F.col("cells") / F.sum("cells").over(W.partitionBy("l_returnflag")) * 100, 4))


@query("SELECT p_partkey, CASE WHEN row_number() OVER w > 1 THEN p_name || '_' || row_number() OVER w ELSE p_name END AS unique_name FROM part WINDOW w AS (PARTITION BY p_type, p_name ORDER BY p_partkey)")
def duplicate_suffixing(spark, sf):
    return profile.suffix_duplicates(t(spark, sf, "part"), ["p_type"], "p_name", "p_partkey").select("p_partkey", "unique_name")


@query("""WITH b AS (SELECT c_nationkey, o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders JOIN customer ON o_custkey = c_custkey),
k AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_totalprice DESC, o_custkey) AS rank FROM b WHERE r = 1) SELECT c_nationkey, o_custkey, o_orderkey, rank::INT AS rank FROM k WHERE rank <= 3""")
def topn_distinct_key(spark, sf):
    """Best order of each customer, then the top three customers of each nation."""
    j = t(spark, sf, "orders").join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    best = j.groupBy("c_nationkey", "o_custkey").agg(F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"))).alias("b"))
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("c_nationkey").orderBy(F.desc("b.o_totalprice"), "o_custkey"))).filter("rank <= 3")
    return ranked.select("c_nationkey", "o_custkey", (-F.col("b.k")).alias("o_orderkey"), "rank")


# ---- context ---------------------------------------------------------------------------------------------------------

_CH = "ch AS (SELECT user_id, CAST(ts AS DATE) AS d, max_by(round(value, 4), event_id) AS rate FROM events WHERE event_type = 'purchase' GROUP BY 1, 2), pd AS (SELECT '2024-01-' || lpad(x::VARCHAR, 2, '0') AS reporting_period, CAST('2024-01-' || lpad(x::VARCHAR, 2, '0') AS DATE) AS period_start, CAST('2024-01-' || lpad(x::VARCHAR, 2, '0') AS DATE) + 4 AS period_end FROM (SELECT unnest([5, 10, 15, 20, 25]) AS x))"


def _rates(spark, sf):
    e = t(spark, sf, "events").filter("event_type = 'purchase'")
    changes = e.groupBy("user_id", F.to_date("ts").alias("effective_date")).agg(F.max_by(F.round("value", 4), "event_id").alias("rate"))
    periods = spark.createDataFrame([(f"2024-01-{x:02d}", f"2024-01-{x:02d}", f"2024-01-{x + 4:02d}") for x in (5, 10, 15, 20, 25)], "reporting_period string, s string, e string")
    return changes, periods.select("reporting_period", F.to_date("s").alias("period_start"), F.to_date("e").alias("period_end"))


@query(f"WITH {_CH}, u AS (SELECT DISTINCT user_id FROM ch) SELECT u.user_id, pd.reporting_period, ch.rate AS end_rate FROM (u CROSS JOIN pd) ASOF JOIN ch ON u.user_id = ch.user_id AND pd.period_end >= ch.d")
def asof_rate(spark, sf):
    return context.rate_context(*_rates(spark, sf), by=["user_id"]).select("user_id", "reporting_period", "end_rate")


@query(
    f"""WITH {_CH} SELECT user_id, reporting_period, count(*) FILTER (d >= period_start) AS rate_decision_count, max_by(rate, d) FILTER (d <= period_start) AS start_rate,
round(max_by(rate, d) - max_by(rate, d) FILTER (d <= period_start), 4) AS rate_change, least(max_by(rate, d) FILTER (d <= period_start), min(rate) FILTER (d >= period_start)) AS minimum_rate
FROM ch JOIN pd ON d <= period_end GROUP BY 1, 2"""
)
def interval_changes(spark, sf):
    return context.rate_context(*_rates(spark, sf), by=["user_id"]).select("user_id", "reporting_period", "rate_decision_count", "start_rate", F.round("rate_change", 4).alias("rate_change"), "minimum_rate")


_MONTHLY = "mo AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS d, o_orderpriority AS indicator_name, round(avg(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2)"
_MD = HALF.format(d="d")


def _monthly(spark, sf):
    return t(spark, sf, "orders").groupBy(F.trunc(F.to_date("o_orderdate"), "month").alias("observation_date"), F.col("o_orderpriority").alias("indicator_name")).agg(F.round(F.avg("o_totalprice"), 2).alias("indicator_value"))


@query(f"WITH {_MONTHLY} SELECT {_MD} AS reporting_period, indicator_name, round(avg(v), 3) AS period_mean, max_by(v, d) AS period_end_value, min(v) AS period_minimum, max(v) AS period_maximum, round(max_by(v, d) - min_by(v, d), 3) AS within_period_change, count(*) AS month_count FROM mo GROUP BY 1, 2")
def series_half_year(spark, sf):
    s = context.series_half_year(_monthly(spark, sf))
    return s.withColumns({c: F.round(c, 3) for c in ("period_mean", "within_period_change")})


@query(f"""WITH {_MONTHLY}, h AS (SELECT {_MD} AS reporting_period, indicator_name, max_by(v, d) AS e FROM mo GROUP BY 1, 2)
SELECT reporting_period, max(e) FILTER (indicator_name = '1-URGENT') AS urgent_period_end, max(e) FILTER (indicator_name = '5-LOW') AS low_period_end FROM h GROUP BY 1""")
def context_wide(spark, sf):
    s = context.series_half_year(_monthly(spark, sf))
    return s.groupBy("reporting_period").pivot("indicator_name", ["1-URGENT", "5-LOW"]).agg(F.first("period_end_value")).toDF("reporting_period", "urgent_period_end", "low_period_end")


@query("""SELECT p_partkey, CASE WHEN lower(p_name || ' ' || p_type) LIKE '%small%' THEN 'small' WHEN lower(p_name || ' ' || p_type) LIKE '%red%' OR lower(p_name || ' ' || p_type) LIKE '%blue%' THEN 'coloured' ELSE '' END AS label FROM part""")
def keyword_classifier(spark, sf):
    p = t(spark, sf, "part")
    return p.select("p_partkey", S.first_keyword(F.concat_ws(" ", "p_name", "p_type"), [("small", "size", ["small"]), ("coloured", "colour", ["red", "blue"])], ("", "none"))["label"].alias("label"))


# ---- identity --------------------------------------------------------------------------------------------------------

_ALIAS = "al AS (SELECT '1' AS reporting_period, p_name AS firm_name, (p_partkey % 500)::VARCHAR AS frn FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT '2', p_name, (p_partkey % 500)::VARCHAR FROM part WHERE p_partkey % 41 = 0)"
_SEEN = "se AS (SELECT DISTINCT (p_size % 3)::VARCHAR AS reporting_period, upper(p_name) AS firm_name FROM part)"


def _names(spark, sf):
    p = t(spark, sf, "part")
    frn = (F.col("p_partkey") % 500).cast("string").alias("frn")
    aliases = p.filter("p_partkey % 3 = 0").select(F.lit("1").alias("reporting_period"), F.col("p_name").alias("firm_name"), frn).unionByName(p.filter("p_partkey % 41 = 0").select(F.lit("2").alias("reporting_period"), F.col("p_name").alias("firm_name"), frn))
    return p.select((F.col("p_size") % 3).cast("string").alias("reporting_period"), F.upper("p_name").alias("firm_name")), aliases


@query(
    f"""WITH {_ALIAS}, {_SEEN}, ev AS (SELECT lower(firm_name) AS name, string_agg(DISTINCT frn, '|' ORDER BY frn) AS frns, count(DISTINCT frn) AS n, list(DISTINCT reporting_period) AS ps, count(DISTINCT (reporting_period, firm_name, frn)) AS rows FROM al GROUP BY 1)
SELECT se.reporting_period, se.firm_name, CASE WHEN n = 1 THEN frns ELSE '' END AS resolved_frn, CASE WHEN n IS NULL THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS match_status,
CASE WHEN n IS NULL THEN 'no_exact_legal_name_reference' WHEN n > 1 THEN 'exact_name_multiple_frns' WHEN list_contains(ps, se.reporting_period) THEN 'exact_name_same_period' ELSE 'exact_name_global_unique' END AS match_method,
coalesce(n, 0)::INT AS candidate_frn_count, coalesce(rows, 0) AS evidence_rows FROM se LEFT JOIN ev ON lower(se.firm_name) = name"""
)
def crosswalk_exact(spark, sf):
    return identity.crosswalk(*_names(spark, sf), F.lower).select("reporting_period", "firm_name", "resolved_frn", "match_status", "match_method", "candidate_frn_count", "evidence_rows")


_JAC = """a AS (SELECT DISTINCT p_name AS x, string_split(p_name, ' ') AS tx FROM part), j AS (SELECT a.x, b.x AS y, len(list_intersect(a.tx, b.tx)) / len(list_distinct(list_concat(a.tx, b.tx))) AS s, least(length(a.x), length(b.x)) / greatest(length(a.x), length(b.x)) AS l FROM a, a b WHERE a.x <> b.x)"""


@query(f"WITH {_JAC} SELECT x AS source_name, y AS candidate_name, round(0.8 * s + 0.2 * l, 6) AS shortlist_score FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY round(0.8 * s + 0.2 * l, 9) DESC, y) AS rn FROM j WHERE s > 0) WHERE rn <= 5")
def token_jaccard_shortlist(spark, sf):
    """Candidates share a word by an equi-join on words, so no pair without overlap is ever made."""
    n = t(spark, sf, "part").select(F.col("p_name").alias("x")).distinct()
    words = n.withColumn("w", F.explode(F.array_distinct(F.split("x", " "))))
    pairs = words.join(words.select(F.col("x").alias("y"), "w"), "w").filter("x <> y").select("x", "y").distinct()
    score = 0.8 * S.token_jaccard(F.split("x", " "), F.split("y", " ")) + 0.2 * F.least(F.length("x"), F.length("y")) / F.greatest(F.length("x"), F.length("y"))
    ranked = pairs.withColumn("s", score).withColumn("rn", F.row_number().over(W.partitionBy("x").orderBy(F.desc(F.round("s", 9)), "y"))).filter("rn <= 5")
    return ranked.select(F.col("x").alias("source_name"), F.col("y").alias("candidate_name"), F.round("s", 6).alias("shortlist_score"))


@query()
def name_similarity_suggestions(spark, sf):
    s = t(spark, sf, "supplier").select(F.lit("1").alias("reporting_period"), F.concat("s_name", F.lit(" Limited")).alias("firm_name"))
    aliases = t(spark, sf, "supplier").select(F.lit("1").alias("reporting_period"), F.concat("s_name", F.lit(" Ltd")).alias("firm_name"), F.col("s_suppkey").cast("string").alias("frn"), F.lit("").alias("trading_name"))
    return identity.suggest(s, aliases, fold_name).select("unmatched_firm_name", "suggestion_rank", "candidate_name", "combined_score", "suggestion_quality", "exact_comparison_key")


@query("""SELECT s_suppkey, trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(s_name) || ' & Co. (Holdings) LIMITED', '&', ' and '), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g'), '\\b(LIMITED|limited)\\b', 'ltd', 'g')) AS comparison_key FROM supplier""")
def comparison_key(spark, sf):
    return t(spark, sf, "supplier").select("s_suppkey", S.comparison_key(F.lower(F.concat("s_name", F.lit(" & Co. (Holdings) LIMITED")))).alias("comparison_key"))


ORACLES["comparison_key"] = ORACLES["comparison_key"].replace("lower(s_name) || ' & Co. (Holdings) LIMITED'", "lower(s_name || ' & Co. (Holdings) LIMITED')")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'firm ss ' END || trim(regexp_replace(lower(c_name), '\\s+', ' ', 'g')) || ' co' AS name FROM customer")
def nfkc_casefold_names(spark, sf):
    """Names, every second behind a ligature and a capital sharp s; the SQL states what these fold to, the names themselves are ASCII."""
    odd = F.when(F.col("c_custkey") % 2 == 0, "").otherwise("  ﬁrm ẞ ")
    c = t(spark, sf, "customer").select("c_custkey", F.concat(odd, "c_name", F.lit(" \t Co\n")).alias("n"))
    return folded(c, "n", "name").select("c_custkey", "name")


_UPD = "up AS (SELECT s_suppkey, 'REVIEWED-' || s_suppkey AS new FROM supplier WHERE s_suppkey % 4 = 0)"


@query(f"WITH {_UPD} SELECT s.s_suppkey, coalesce(up.new, s.s_name) AS s_name, s.s_nationkey FROM supplier s LEFT JOIN up USING (s_suppkey)")
def keyed_update_overrides(spark, sf):
    s = t(spark, sf, "supplier")
    up = s.filter("s_suppkey % 4 = 0").select("s_suppkey", F.concat(F.lit("REVIEWED-"), F.col("s_suppkey").cast("string")).alias("s_name"))
    return identity.keyed_update(s, up, ["s_suppkey"], ["s_name"]).select("s_suppkey", "s_name", "s_nationkey")


# ---- scalars ---------------------------------------------------------------------------------------------------------

_RAW = ["NULL", "''", "' '", "'1,234'", "'12%'", "'#N/A'", "'n/a'", "'-'", "'true'", "'5d'", "'nan'", "'Infinity'", "'1e3'", "'abc'"]


@query(
    f"""WITH r AS (SELECT l_orderkey, l_linenumber, (CASE (l_orderkey + l_linenumber) % {len(_RAW)} {" ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(_RAW))} END)::VARCHAR AS raw FROM lineitem),
c AS (SELECT *, replace(replace(trim(raw), ',', ''), '%', '') AS cl FROM r), n AS (SELECT *, CASE WHEN regexp_full_match(cl, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(cl AS DOUBLE) END AS num FROM c)
SELECT raw, count(*) AS n, any_value(CASE WHEN raw IS NULL OR trim(raw) = '' OR lower(trim(raw)) IN ('null', 'n/a', 'na', '-', 'true', 'false') OR raw LIKE '#%' THEN NULL WHEN raw LIKE '%\\%' ESCAPE '\\' THEN num / 100 ELSE num END) AS value,
any_value(CASE WHEN raw IS NULL OR trim(raw) = '' THEN 'missing' WHEN lower(trim(raw)) IN ('null', 'n/a', 'na', '-') THEN 'missing_marker' WHEN raw LIKE '#%' OR raw IN ('true', 'false') OR num IS NULL THEN 'invalid' ELSE 'valid' END) AS status FROM n GROUP BY raw"""
)
def normalise_metric_value(spark, sf):
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % len(_RAW)
    raw = F.lit(None).cast("string")
    for i, v in enumerate(_RAW[1:], 1):
        raw = F.when(k == i, v.strip("'")).otherwise(raw)
    m = t(spark, sf, "lineitem").select(raw.alias("raw")).groupBy("raw").agg(F.count("*").alias("n")).withColumn("m", S.metric_value(F.col("raw")))
    return m.select("raw", "n", "m.value", "m.status")


@query("""WITH l AS (SELECT p_partkey, p_type || ' (per 1,000 ' || p_brand || ')' AS x FROM part) SELECT p_partkey, regexp_replace(x, '\\s*\\([^)]*\\)\\s*$', '') AS base_label, replace(replace(lower(regexp_extract(x, '\\((per\\s+1[,.]?000\\s+[^)]*)\\)', 1)), ' ', '_'), ',', '') AS basis FROM l""")
def label_split(spark, sf):
    x = F.concat("p_type", F.lit(" (per 1,000 "), "p_brand", F.lit(")"))
    basis = F.replace(F.replace(F.lower(F.regexp_extract(x, r"(?i)\((per\s+1[,.]?000\s+[^)]*)\)", 1)), F.lit(" "), F.lit("_")), F.lit(","))
    return t(spark, sf, "part").select("p_partkey", S.strip_qualifier(x).alias("base_label"), basis.alias("basis"))


@query("""WITH w AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 3 AS k FROM orders) SELECT o_orderkey, CASE WHEN k < 2 THEN d END AS observation_start, CASE WHEN k < 2 THEN d + 30 END AS observation_end, CASE WHEN k < 2 THEN 31 END::INT AS observation_days FROM w""")
def window_string_parse(spark, sf):
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 3
    iso = F.concat(d.cast("string"), F.lit(" to "), F.date_add(d, 30).cast("string"))
    dmy = F.concat(F.date_format(d, "dd-MM-yyyy"), F.lit(" to "), F.date_format(F.date_add(d, 30), "dd-MM-yyyy"))
    o = t(spark, sf, "orders").select("o_orderkey", F.when(k == 0, iso).when(k == 1, dmy).otherwise("unknown").alias("w"))
    a, b = S.window_bounds(F.col("w"))
    return o.select("o_orderkey", a.alias("observation_start"), b.alias("observation_end"), (F.datediff(b, a) + 1).alias("observation_days"))


@query("SELECT c_custkey, 'CUST-' || upper(substr(sha256(c_name || '|' || c_nationkey || '|'), 1, 16)) AS key, 'OLD-' || upper(substr(sha1(c_name), 1, 10)) AS old_key, sha256(lower(c_name)) AS text_hash FROM customer")
def stable_hash_keys(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", S.stable_key("CUST", F.col("c_name"), F.col("c_nationkey"), F.lit(None)).alias("key"), S.stable_key("OLD", F.col("c_name"), length=10, algorithm="sha1").alias("old_key"), F.sha2(S.normalise_text(F.col("c_name")), 256).alias("text_hash"))


# ---- profiling, reconciliation, gates --------------------------------------------------------------------------------


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def crosstab_outcomes(spark, sf):
    return review.crosstab(t(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


_REC = """mm AS (SELECT l_orderkey AS source_row, l_returnflag AS product_group, l_quantity AS metric_value, CASE WHEN l_tax > 0.07 THEN 'missing' ELSE 'valid' END AS st FROM lineitem
UNION ALL SELECT o_orderkey, 'grand_total', (SELECT sum(l_quantity) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END, 'valid' FROM orders o)"""


@query(
    f"""WITH {_REC}, g AS (SELECT source_row, max(metric_value) FILTER (product_group = 'grand_total') AS tot, count(*) FILTER (product_group = 'grand_total') AS tn, count(*) FILTER (product_group <> 'grand_total') AS c, count(*) FILTER (product_group <> 'grand_total' AND st = 'valid') AS v,
coalesce(sum(metric_value) FILTER (product_group <> 'grand_total' AND st = 'valid'), 0) AS s FROM mm GROUP BY 1)
SELECT source_row, c AS component_count, v AS valid_component_count, tot AS reported_total, CASE WHEN c > 0 AND c = v THEN tot - s END AS difference, CASE WHEN c = 0 OR c <> v THEN 'not_comparable' WHEN abs(tot - s) < 1e-9 THEN 'matched' ELSE 'mismatch' END AS reconciliation_status FROM g WHERE tn > 0 AND tot IS NOT NULL"""
)
def total_reconciliation(spark, sf):
    li, o = t(spark, sf, "lineitem"), t(spark, sf, "orders")
    parts = li.select(F.col("l_orderkey").alias("source_row"), F.col("l_returnflag").alias("product_group"), F.col("l_quantity").alias("metric_value"), F.when(F.col("l_tax") > 0.07, "missing").otherwise("valid").alias("value_status"))
    sums = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"))
    tot = o.join(sums, "o_orderkey").select(F.col("o_orderkey").alias("source_row"), F.lit("grand_total").alias("product_group"), (F.col("q") + F.when(F.col("o_orderkey") % 10 == 0, 1.0).otherwise(0.0)).alias("metric_value"), F.lit("valid").alias("value_status"))
    out = reconcile.totals(parts.unionByName(tot).withColumn("measurement_unit", F.lit("count")), ["source_row"])
    return out.select("source_row", "component_count", "valid_component_count", "reported_total", "difference", "reconciliation_status")


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) * count(DISTINCT l_linenumber) AS expected_records, count(*) AS records, CASE WHEN count(*) = count(DISTINCT l_suppkey) * count(DISTINCT l_linenumber) THEN 'matched' ELSE 'mismatch' END AS reconciliation_status FROM (SELECT DISTINCT l_returnflag, l_suppkey, l_linenumber FROM lineitem) GROUP BY 1")
def structural_reconciliation(spark, sf):
    r = t(spark, sf, "lineitem").select("l_returnflag", F.col("l_suppkey").alias("source_row"), F.col("l_linenumber").alias("source_column")).distinct()
    return reconcile.structure(r, ["l_returnflag"]).select("l_returnflag", "expected_records", "records", "reconciliation_status")


def _profile_sql():
    cols = {"o_orderkey": "identifier", "o_custkey": "integer_like", "o_orderstatus": "text", "o_totalprice": "", "o_orderpriority": "text", "o_orderdate": "date", "custkey_text": "numeric_text", "percentage_late": "percentage", "is_open": "boolean", "nothing": "empty"}
    number = ("o_orderkey", "o_custkey", "o_totalprice", "percentage_late")
    source = "(SELECT *, o_custkey::VARCHAR AS custkey_text, o_custkey % 3 AS percentage_late, o_orderstatus = 'O' AS is_open, '-' AS nothing FROM orders)"
    extremes = lambda c: f"count(*) FILTER ({c} < 0) AS negative_count, min({c})::DOUBLE AS minimum, max({c})::DOUBLE AS maximum" if c in number else "0 AS negative_count, NULL::DOUBLE AS minimum, NULL::DOUBLE AS maximum"
    kind = lambda c, k: f"'{k}'" if k else f"CASE WHEN count(*) FILTER ({c} <> floor({c})) = 0 THEN 'integer_like' ELSE 'decimal_like' END"
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS row_count, count(*) FILTER ({c} IS NULL) AS null_count, count(DISTINCT {c}) AS distinct_count, {extremes(c)}, {kind(c, k)} AS semantic_type FROM {source}" for c, k in cols.items())


@query(_profile_sql())
def column_profile(spark, sf):
    """Profile and semantic type of every column of the orders, and of some made from them."""
    made = {"custkey_text": "cast(o_custkey AS string)", "percentage_late": "o_custkey % 3", "is_open": "o_orderstatus = 'O'", "nothing": "'-'"}
    p = profile.profile_columns(t(spark, sf, "orders").withColumns({c: F.expr(e) for c, e in made.items()}))
    return profile.semantic_type(p, ("o_orderkey",)).select("column", "row_count", "null_count", "distinct_count", "negative_count", "minimum", "maximum", "semantic_type")


@query(
    f"""WITH g AS (SELECT {_OD} AS period, o_custkey, count(*) AS n FROM orders GROUP BY 1, 2), p AS (SELECT period, dense_rank() OVER (ORDER BY period) AS o FROM (SELECT DISTINCT period FROM g)), d AS (SELECT g.*, o FROM g JOIN p USING (period)),
j AS (SELECT coalesce(a.o + 1, b.o) AS o, coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.n AS previous_n, b.n AS current_n FROM d a FULL JOIN d b ON b.o = a.o + 1 AND a.o_custkey = b.o_custkey)
SELECT p.period AS current_period, o_custkey, previous_n, current_n, CASE WHEN previous_n IS NULL THEN 'added' WHEN current_n IS NULL THEN 'removed' ELSE 'changed' END AS change_type FROM j JOIN p USING (o) WHERE o > 1 AND previous_n IS DISTINCT FROM current_n"""
)
def schema_diff_full_outer(spark, sf):
    g = t(spark, sf, "orders").groupBy(S.half_year(F.to_date("o_orderdate")).alias("period"), "o_custkey").agg(F.count("*").alias("n"))
    return profile.consecutive_changes(g, "period", ["o_custkey"], ["n"]).select("current_period", "o_custkey", "previous_n", "current_n", "change_type")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def semi_join(spark, sf):
    return t(spark, sf, "customer").join(t(spark, sf, "orders").filter("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_join_coverage(spark, sf):
    """Customers without an order in progress."""
    return t(spark, sf, "customer").join(t(spark, sf, "orders").filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT l_suppkey AS suppkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49")
def except_keys(spark, sf):
    li = t(spark, sf, "lineitem")
    return li.filter("l_returnflag = 'A'").select(F.col("l_suppkey").alias("suppkey")).subtract(li.filter("l_returnflag = 'R' AND l_quantity > 49").select("l_suppkey"))


@query("SELECT o_custkey AS custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def intersect_keys(spark, sf):
    o = t(spark, sf, "orders")
    return o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("custkey")).intersect(o.filter("o_orderstatus = 'O'").select("o_custkey"))


@query("SELECT n_name, r_name, count(s_suppkey) AS suppliers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2")
def checked_dimension_join(spark, sf):
    n = t(spark, sf, "nation").withColumnRenamed("n_regionkey", "r_regionkey").withColumnRenamed("n_nationkey", "s_nationkey")
    j = checked_join(n, F.broadcast(t(spark, sf, "region")), ["r_regionkey"], "inner", "m:1")
    return checked_join(j, t(spark, sf, "supplier"), ["s_nationkey"], "left", "1:m").groupBy("n_name", "r_name").agg(F.count("s_suppkey").alias("suppliers"))


@query("""WITH f AS (SELECT 'REV-' || upper(substr(sha256('order|' || o_orderpriority || '|late'), 1, 10)) AS id, o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 2), d AS (SELECT *, CASE WHEN o_orderpriority < '3' THEN 'approved' END AS s FROM f)
SELECT count(*) AS blocking_items, count(*) FILTER (s IS NULL) AS pending_items, 0::BIGINT AS rejected_items, count(s) AS approved_items, CASE WHEN count(*) FILTER (s IS NULL) > 0 THEN 'awaiting_manual_review' ELSE 'approved' END AS review_status, count(*) FILTER (s IS NULL) = 0 AS extraction_authorised FROM d""")
def review_gate(spark, sf):
    f = t(spark, sf, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_orderpriority").alias("scope")).count()
    items = profile.review_items(f.select(F.lit("order").alias("category"), "scope", F.lit("late").alias("issue"), F.lit("high").alias("severity"), F.lit(True).alias("blocks")))
    return profile.gate(items, items.filter("scope < '3'").select("review_item_id", F.lit("approve_mapping").alias("decision")))
