"""Worksheet, extraction and work-queue queries: orders host the cells, one workbook for each half-year and a sheet for each priority."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veldspar.functions.semantics import half_year
from veldspar.operators import context, extract, governance, ledger, packs, review, worksheets as X
from veldspar.plans.scan import scan
from veldspar.sources import files
from veldspar.store import cut, folder, rows

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


def _numbered(df, keys, order):
    """`df` with the number of each row within its key; a key may hold any share of the rows."""
    return scan(df, keys, order, sums={"row": F.lit(1)}, name="numbered").withColumn("row", F.col("row").cast("int"))


# ---- names, formats, headers -----------------------------------------------------------------------------------------

_NAMES = ["Opened", "Closed %", "% closed within 3 days", "Closed >3 days & within 8 weeks", "% Upheld", "Context – provision", "Context - Intermediation", "Consumer  credit", "Joint reporters (consumer credit)", "Joint reporters", "Trading names", "Notes", "Other: Extra!"]
_HEADERS = ["Home finance", "Investments (a)", "Banking and credit cards (per 1,000 accounts)", "Insurance & pure protection (per 1,000 policies sold) (B)", "Grand Total", "Complaints received", "Complaints closed", "Complaints upheld", "Complaints upheld %", "Firm  Name", "FRN", "Submission date"]
_FORMATS = ["General", "0.0%", "£#,##0", "dd/mm/yyyy", "#,##0.00", ""]
_list = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
_NORM = lambda c: f"trim(lower(regexp_replace({c}, '\\s+', ' ', 'g')))"
_SHARE_PERIODS = ("1996-H1", "1998-H2", "2000-H1")


def _pick(values, key):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


@query(
    f"""WITH n AS (SELECT o_orderkey, {_list(_NAMES)}[o_orderkey % {len(_NAMES)} + 1] AS name, {_list(_FORMATS)}[o_orderkey % {len(_FORMATS)} + 1] AS f FROM orders),
r AS (SELECT *, replace({_NORM('name')}, '–', '-') AS x FROM n),
k AS (SELECT *, CASE WHEN x LIKE '%context%' AND x LIKE '%intermediation%' THEN 'context_intermediation' WHEN x LIKE '%context%' AND x LIKE '%provision%' THEN 'context_provision'
  WHEN x LIKE '%joint reporter%' AND x LIKE '%consumer credit%' THEN 'consumer_credit_joint_reporters' WHEN x LIKE '%joint reporter%' THEN 'main_return_joint_reporters' WHEN x LIKE '%trading name%' THEN 'trading_names'
  WHEN x LIKE '%consumer credit%' THEN 'consumer_credit' WHEN x LIKE '%upheld%' THEN 'percentage_upheld' WHEN x LIKE '%3 day%' AND (x LIKE '%8%' OR x LIKE '%>3%' OR x LIKE '%after%') THEN 'percentage_after_3_days_within_8_weeks'
  WHEN x LIKE '%3 day%' THEN 'percentage_within_3_days' WHEN x LIKE '%opened%' THEN 'opened' WHEN x LIKE '%closed%' THEN 'closed' WHEN x LIKE '%note%' THEN 'notes' ELSE trim(regexp_replace(x, '[^a-z0-9]+', '_', 'g'), '_') END AS canonical_sheet FROM r)
SELECT o_orderkey, canonical_sheet, CASE WHEN canonical_sheet IN ('opened', 'closed', 'percentage_within_3_days', 'percentage_after_3_days_within_8_weeks', 'percentage_upheld') THEN 'metric_wide_table' WHEN canonical_sheet = 'consumer_credit' THEN 'consumer_credit_metric_table'
  WHEN canonical_sheet LIKE 'context%' THEN 'context_rate_table' WHEN canonical_sheet = 'trading_names' THEN 'firm_alias_reference' WHEN canonical_sheet LIKE '%joint%' THEN 'joint_reporter_reference' WHEN canonical_sheet = 'notes' THEN 'product_reference' ELSE 'unclassified' END AS sheet_type,
  CASE WHEN f LIKE '%\\%%' ESCAPE '\\' THEN 'percentage' WHEN f LIKE '%£%' THEN 'currency' WHEN f LIKE '%yy%' OR f LIKE '%dd%' OR f LIKE '%mm%' THEN 'date' WHEN f LIKE '%0%' OR f LIKE '%#%' THEN 'number' ELSE 'general' END AS number_format_class FROM k"""
)
def sheet_roles(spark, sf):
    """Roles, structural types and number-format classes of sheets named after orders."""
    o = t(spark, sf, "orders").select("o_orderkey", X.sheet_role(_pick(_NAMES, "o_orderkey")).alias("canonical_sheet"), X.format_class(_pick(_FORMATS, "o_orderkey")).alias("number_format_class"))
    return o.withColumn("sheet_type", X.role_type(F.col("canonical_sheet")))


@query(
    f"""WITH n AS (SELECT o_orderkey, {_list(_HEADERS)}[o_orderkey % {len(_HEADERS)} + 1] AS h, year(o_orderdate) || CASE WHEN month(o_orderdate) <= 6 THEN '-H1' ELSE '-H2' END AS p FROM orders),
f AS (SELECT *, lower(regexp_extract(h, '\\(([A-Za-z])\\)$', 1)) AS foot, trim(regexp_replace(h, '\\s*\\([A-Za-z]\\)$', '')) AS r, {_NORM('h')} AS x FROM n),
b AS (SELECT *, regexp_extract(r, '\\((per 1,000.+)\\)$', 1) AS basis FROM f)
SELECT o_orderkey, {_NORM("regexp_replace(r, '\\s*\\((per 1,000.+)\\)$', '')")} AS base, nullif(basis, '') AS basis, nullif(foot, '') AS footnote,
  CASE x WHEN 'firm name' THEN 'firm_name' WHEN 'frn' THEN 'frn' WHEN 'submission date' THEN 'source_reporting_period' END AS identifier,
  CASE WHEN x LIKE '%received%' THEN 'complaints_opened' WHEN x LIKE '%closed%' THEN 'complaints_closed' WHEN x LIKE '%upheld%' THEN 'complaints_upheld' ELSE '' END AS metric_name,
  CASE WHEN x LIKE '%received%' OR x LIKE '%closed%' THEN 'count' WHEN x LIKE '%upheld%' AND (h LIKE '%\\%%' ESCAPE '\\' OR p IN {_SHARE_PERIODS}) THEN 'percentage' WHEN x LIKE '%upheld%' THEN 'count' ELSE '' END AS measurement_unit,
  CASE WHEN h LIKE '%per 1,000%' THEN replace(replace(lower(regexp_extract(h, '\\((per 1,000 [^)]*)\\)', 1)), ' ', '_'), ',', '') ELSE 'per_1000_accounts_or_policies_provided' END AS measurement_basis FROM b"""
)
def header_semantics(spark, sf):
    """Product, identifier and measure that a header stands for."""
    o = t(spark, sf, "orders").select("o_orderkey", _pick(_HEADERS, "o_orderkey").alias("h"), half_year(F.to_date("o_orderdate")).alias("p"))
    m, parts = X.credit_measure(F.col("h"), F.col("p"), _SHARE_PERIODS), X.label_parts(F.col("h"))
    return o.select("o_orderkey", parts["base"].alias("base"), parts["basis"].alias("basis"), parts["footnote"].alias("footnote"), X.identifier_name(F.col("h")).alias("identifier"), m["metric_name"].alias("metric_name"), m["measurement_unit"].alias("measurement_unit"), X.context_basis(F.col("h"), F.lit("context_provision")).alias("measurement_basis"))


@query("SELECT o_orderkey, CASE WHEN a IN ('null', 'NULL', '0', '') THEN '' ELSE a END AS alias, CASE WHEN a = '' THEN 'missing' WHEN lower(a) = 'null' OR a = '0' THEN 'missing_marker' ELSE 'valid' END AS status, CASE WHEN a = '' THEN 'blank_source_cell' WHEN lower(a) = 'null' THEN 'source_null_literal' WHEN a = '0' THEN 'source_zero_placeholder' ELSE '' END AS reason FROM (SELECT o_orderkey, trim(['null', '0', ' ', ' Shop ', 'NULL', o_orderstatus][o_orderkey % 6 + 1]) AS a FROM orders)")
def alias_literals(spark, sf):
    """Literals that stand for an absent trading name."""
    values = F.array(*[F.lit(x) for x in ("null", "0", " ", " Shop ", "NULL")], F.col("o_orderstatus"))
    o = t(spark, sf, "orders").select("o_orderkey", X.alias_value(F.element_at(values, (F.col("o_orderkey") % 6 + 1).cast("int"))).alias("a"))
    return o.select("o_orderkey", "a.*")


# ---- cells -----------------------------------------------------------------------------------------------------------

_COLUMNS = [
    ("Firm Name", "text", "'Customer ' || {cust}", "general"),
    ("Percentage upheld", "numeric", "cast({key} % 7 AS string)", "number"),
    ("Redress", "numeric", "cast({key} % 100 AS string)", "number"),
    ("Rate", "numeric", "cast({key} % 100 / 4.0 - 3 AS string)", "number"),
    ("Count", "numeric", "cast({cust} - 20 AS string)", "number"),
    ("Code", "text", "cast({cust} AS string)", "general"),
    ("Empty", "text", "CASE {key} % 4 WHEN 0 THEN ' ' WHEN 1 THEN '-' WHEN 2 THEN '[x]' ELSE 'n/a' END", "general"),
    ("Mixed", "", "CASE WHEN {key} % 3 = 0 THEN '#REF!' WHEN {key} % 3 = 1 THEN cast({cust} AS string) ELSE o_orderstatus END", "general"),
    ("Word", "text", "o_orderstatus", "general"),
    ("Day", "date", "cast(cast(o_orderdate AS date) AS string)", "date"),
]


def _grid(spark, sf):
    """Row numbers of orders in their workbook and sheet; row 1 is the header."""
    o = t(spark, sf, "orders").withColumn("workbook", half_year(F.to_date("o_orderdate")))
    return _numbered(o, ["workbook", "o_orderpriority"], ["o_orderkey"]).withColumn("row", F.col("row") + 1)


def _cells(spark, sf):
    kind = lambda k: f"'{k}'" if k else "CASE WHEN o_orderkey % 3 = 1 THEN 'numeric' ELSE 'text' END"
    one = [f"named_struct('col', {i}, 'kind', {kind(k)}, 'value', {v.format(cust='o_custkey', key='o_orderkey')})" for i, (_, k, v, _) in enumerate(_COLUMNS, 1)]
    return _grid(spark, sf).select("workbook", F.col("o_orderpriority").alias("sheet"), "row", F.expr(f"explode(array({', '.join(one)}))").alias("x")).select("workbook", "sheet", "row", "x.*")


_CELLS_SQL = (
    "g AS (SELECT *, year(o_orderdate) || CASE WHEN month(o_orderdate) <= 6 THEN '-H1' ELSE '-H2' END AS workbook, o_orderpriority AS sheet FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY workbook, sheet ORDER BY o_orderkey) + 1 AS row FROM g), cells AS ("
    + " UNION ALL ".join(
        f"SELECT workbook, sheet, row, {i} AS col, '{name}' AS column_name, '{fmt}' AS fmt, {repr(k) if k else 'CASE WHEN o_orderkey % 3 = 1 THEN $$numeric$$ ELSE $$text$$ END'} AS kind, {v.format(cust='o_custkey', key='o_orderkey').replace('AS string', 'AS VARCHAR').replace('/ 4.0', '/ 4.0::DOUBLE')} AS value FROM r"
        for i, (name, k, v, fmt) in enumerate(_COLUMNS, 1)
    )
    + ")"
)


@query(
    f"""WITH {_CELLS_SQL}, c AS (SELECT *, kind = 'text' AND trim(value) IN ('', '-', '[x]', 'n/a', '#REF!') AS absent, CASE WHEN kind = 'numeric' THEN value::DOUBLE END AS num FROM cells),
p AS (SELECT workbook, sheet, col, any_value(column_name) AS "column", any_value(fmt) AS number_format_class, count(*) FILTER (NOT absent AND kind = 'numeric') AS n_numeric, count(*) FILTER (NOT absent AND kind = 'text') AS n_text, count(*) FILTER (kind = 'date') AS n_date,
  count(*) FILTER (trim(value) = '' AND value <> '') AS whitespace_string_count, count(*) FILTER (kind = 'text' AND value = '-') AS missing_marker_count, count(*) FILTER (value = '[x]') AS suppressed_marker_count, count(*) FILTER (value = 'n/a') AS not_applicable_marker_count, count(*) FILTER (value = '#REF!') AS excel_error_count,
  count(*) FILTER (num = 0) AS zero_count, count(*) FILTER (num < 0) AS negative_count, min(num) AS minimum_numeric_value, max(num) AS maximum_numeric_value, count(*) FILTER (num <> floor(num)) AS fractions,
  count(*) FILTER (NOT absent AND kind = 'text' AND regexp_full_match(value, '[0-9]+')) AS parsed FROM c GROUP BY workbook, sheet, col)
SELECT workbook, sheet, col::INT AS col, "column", number_format_class, n_numeric, n_text, n_date, whitespace_string_count, missing_marker_count, suppressed_marker_count, not_applicable_marker_count, excel_error_count, zero_count, negative_count, minimum_numeric_value, maximum_numeric_value,
  round((n_numeric + parsed) / nullif(n_numeric + n_text, 0) * 100, 4) AS numeric_parse_success_percent,
  CASE WHEN n_numeric + n_text + n_date = 0 THEN 'empty' WHEN "column" = 'Firm Name' THEN 'identifier' WHEN "column" LIKE 'Percentage%' THEN 'percentage' WHEN "column" = 'Redress' THEN 'currency' WHEN n_numeric + n_text = 0 THEN 'date'
    WHEN n_text = 0 AND fractions = 0 THEN 'integer_like' WHEN n_text = 0 THEN 'decimal_like' WHEN n_numeric = 0 AND parsed = n_text THEN 'numeric_text' WHEN n_numeric = 0 THEN 'text' ELSE 'mixed' END AS semantic_type FROM p"""
)
def value_profile(spark, sf):
    """Value profile and semantic type of every column of every sheet."""
    cells = _cells(spark, sf)
    heads = F.expr("inline(array(" + ", ".join(f"named_struct('col', {i}, 'column', '{n}', 'number_format_class', '{f}')" for i, (n, _, _, f) in enumerate(_COLUMNS, 1)) + "))")
    columns = cells.select("workbook", "sheet").distinct().select("workbook", "sheet", heads)
    wanted = "workbook sheet col column number_format_class semantic_type n_numeric n_text n_date whitespace_string_count missing_marker_count suppressed_marker_count not_applicable_marker_count excel_error_count zero_count negative_count minimum_numeric_value maximum_numeric_value numeric_parse_success_percent"
    return X.value_profile(cells, columns).select(*wanted.split())


@query(
    f"""WITH {_CELLS_SQL}, d AS (SELECT workbook, sheet, max(row) + 5 AS dr FROM cells GROUP BY 1, 2), u AS (SELECT workbook, sheet, max(row) AS lr, count(DISTINCT row) AS n FROM cells WHERE col = 7 AND trim(value) <> '' GROUP BY 1, 2)
SELECT d.workbook, d.sheet, coalesce(lr, 0)::INT AS last_row, CASE WHEN lr IS NULL THEN 0 ELSE 7 END AS last_column, dr - coalesce(n, 0) AS empty_rows, CASE WHEN lr IS NULL THEN 0 ELSE 8 END::BIGINT AS empty_columns FROM d LEFT JOIN u USING (workbook, sheet)"""
)
def sheet_bounds(spark, sf):
    """Used bounds of sheets of which only one column holds values, some of them blank."""
    cells = _cells(spark, sf)
    declared = cells.groupBy("workbook", "sheet").agg((F.max("row") + 5).alias("declared_rows")).withColumn("declared_columns", F.lit(9))
    return X.bounds(cells.filter("col = 7"), declared)


@query(
    """WITH g AS (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS row,
  ['Grand Total', ' total ', 'Firm', 'Note: text', 'notes', 'Total cost', 'Source', ''][(l_orderkey + l_linenumber) % 8 + 1] AS v, CASE l_returnflag WHEN 'N' THEN 'notes' ELSE 'opened' END AS role FROM lineitem)
SELECT row::INT AS row, l_returnflag AS sheet, CASE WHEN role = 'opened' THEN 'total' ELSE 'note' END AS row_type, lower(trim(v)) AS label FROM g
WHERE (role = 'opened' AND lower(trim(v)) IN ('grand total', 'total', 'subtotal')) OR (role = 'notes' AND (lower(trim(v)) IN ('note', 'notes', 'source', 'definition') OR lower(v) LIKE 'note: %'))"""
)
def special_rows(spark, sf):
    """Total rows of metric sheets and note rows of notes sheets; the label may stand behind blank cells."""
    values = ["Grand Total", " total ", "Firm", "Note: text", "notes", "Total cost", "Source", ""]
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    g = _numbered(t(spark, sf, "lineitem").select("l_returnflag", *order), ["l_returnflag"], order)
    v = F.element_at(F.array(*map(F.lit, values)), ((F.col("l_orderkey") + F.col("l_linenumber")) % 8 + 1).cast("int"))
    one = lambda col, value: F.struct(F.lit(col).alias("col"), value.alias("value"))
    cells = g.select(F.lit("book").alias("workbook"), F.col("l_returnflag").alias("sheet"), F.when(F.col("l_returnflag") == "N", "notes").otherwise("opened").alias("canonical_sheet"), "row", F.explode(F.array(one(1, F.lit(" ")), one(2, v), one(3, F.when(v != "", F.lit("5"))))).alias("x")).select("workbook", "sheet", "canonical_sheet", "row", "x.*")
    return X.special_rows(cells).select("row", "sheet", "row_type", "label")


@query(
    """WITH c AS (SELECT o_orderpriority AS sheet, 1 AS col, ['General', '0%', '#,##0.00'][o_orderkey % 3 + 1] AS number_format FROM orders
UNION ALL SELECT o_orderpriority, 2, CASE WHEN o_custkey % 10 = 0 THEN '@' ELSE 'General' END FROM orders WHERE o_orderstatus <> 'F')
SELECT sheet, col, number_format, count(*) AS formatted_cell_count, round(count(*) * 100 / sum(count(*)) OVER (PARTITION BY sheet, col), 4) AS formatted_cell_percent FROM c GROUP BY sheet, col, number_format"""
)
def number_format_distribution(spark, sf):
    """Number formats of each column, from the grouping sets that profile values too."""
    o = t(spark, sf, "orders")
    first = o.select(F.col("o_orderpriority").alias("sheet"), F.lit(1).alias("col"), "o_orderkey", F.col("o_totalprice").cast("string").alias("value"), F.lit("numeric").alias("kind"), F.element_at(F.array(*map(F.lit, ("General", "0%", "#,##0.00"))), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("number_format"))
    second = o.select(F.col("o_orderpriority").alias("sheet"), F.lit(2).alias("col"), "o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("value"), F.lit("text").alias("kind"), F.when(F.col("o_custkey") % 10 == 0, "@").otherwise("General").alias("number_format"))
    cells = first.unionByName(second).withColumn("workbook", F.lit("book")).withColumnRenamed("o_orderkey", "row")
    return X.format_counts(X.value_shapes(cells)).drop("workbook")


@query(
    """WITH c AS (SELECT 'error' AS severity, 'line_unique' AS rule, (SELECT count(*) FROM (SELECT count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1) AS count
UNION ALL SELECT 'error', 'order_known', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'))
UNION ALL SELECT 'error', 'part_known', (SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part))
UNION ALL SELECT 'warning', 'discount_small', (SELECT count(*) FROM lineitem WHERE NOT l_discount <= 0.05::DOUBLE)
UNION ALL SELECT 'error', 'as_many_as_orders', abs((SELECT count(*) FROM lineitem) - (SELECT count(*) FROM orders))) SELECT severity, rule, count::BIGINT AS count FROM c WHERE count > 0"""
)
def rule_pack_counts(spark, sf):
    """Broken rules of a pack over order lines, counted by the one write that makes the table."""
    pack = (
        packs.Unique("line_unique", ("l_orderkey", "l_linenumber")), packs.Refers("order_known", "l_orderkey", "orders", "o_orderkey"), packs.Refers("part_known", "l_partkey", "part", "p_partkey"),
        packs.Row("discount_small", "l_discount <= 0.05D", "warning"), packs.Size("not_empty", 1), packs.AsMany("as_many_as_orders", "all_orders"),
    )
    orders = t(spark, sf, "orders")
    seen = packs.observed(t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount"), pack, {"orders": orders.filter("o_orderstatus <> 'P'"), "part": t(spark, sf, "part")})
    written = rows(cut(seen.rows, "pack-lines"))
    return packs.table_of(spark, [*seen.issues(written), *packs.across({"lines": written, "all_orders": orders.count()}, {"lines": pack})])


@query(
    """WITH d AS (SELECT cast(o_orderkey AS VARCHAR) AS review_item_id, CASE WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'rejected' END AS decision, 1 AS update FROM orders
UNION ALL SELECT cast(o_orderkey AS VARCHAR), 'approved_with_conditions', 2 FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT review_item_id, arg_max(decision, update) AS decision, max(update)::BIGINT AS update FROM d GROUP BY 1"""
)
def ledger_latest(spark, sf):
    """The decision that holds for each key after two updates of a ledger."""
    said = lambda df, d: df.select(F.col("o_orderkey").cast("string").alias("review_item_id"), d.alias("decision"), F.lit("me").alias("reviewer"), F.lit("2025-01-01").alias("reviewed_at"), F.lit("").alias("reviewer_comment"))
    orders, book = t(spark, sf, "orders"), ledger.Ledger(spark, f"{folder(spark)}/ledger-{uuid.uuid4().hex}", ledger.PROFILING)
    book.append(said(orders, F.when(F.col("o_orderstatus") == "F", "approved").otherwise("rejected")))
    book.append(said(orders.filter("o_orderpriority = '1-URGENT'"), F.lit("approved_with_conditions")))
    return book.latest().select("review_item_id", "decision", "update")


@query("SELECT 'orders' AS source, (SELECT count(*) FROM orders) AS rows, 6 AS columns UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem), (SELECT count(*)::INT FROM (DESCRIBE lineitem)) UNION ALL SELECT 'part', (SELECT count(*) FROM part), 6")
def source_inventory(spark, sf):
    """Rows and columns of each source."""
    return files.inventory({n: t(spark, sf, n) for n in ("orders", "lineitem", "part")})


# ---- schema changes --------------------------------------------------------------------------------------------------

def _schema(spark, sf):
    """Columns of yearly schemas: part types are sheets, part sizes that a year's orders hold are columns."""
    j = t(spark, sf, "lineitem").join(t(spark, sf, "orders"), F.expr("l_orderkey = o_orderkey")).join(t(spark, sf, "part"), F.expr("l_partkey = p_partkey"))
    g = j.groupBy(F.year("o_orderdate").cast("string").alias("reporting_period"), F.col("p_type").alias("canonical_sheet"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("normalised_column")).agg(F.count("*").alias("n"), F.max("l_linenumber").alias("m"))
    return g.select("reporting_period", "canonical_sheet", "normalised_column", F.initcap("normalised_column").alias("column"), (F.col("m") % 3).cast("int").alias("column_position"), F.lit("double").alias("storage_dtype"), F.when(F.col("n") % 2 == 0, "text").otherwise("mixed").alias("semantic_type"), F.lit("general").alias("number_format_class"))


_SCHEMA_SQL = """c AS (SELECT year(o_orderdate)::VARCHAR AS reporting_period, p_type AS canonical_sheet, 'size ' || p_size AS normalised_column, 'Size ' || p_size AS "column", (max(l_linenumber) % 3)::INT AS column_position, CASE WHEN count(*) % 2 = 0 THEN 'text' ELSE 'mixed' END AS semantic_type
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
p AS (SELECT reporting_period, lag(reporting_period) OVER (ORDER BY reporting_period) AS previous_period FROM (SELECT DISTINCT reporting_period FROM c)),
j AS (SELECT a.reporting_period AS previous_period, p.reporting_period AS current_period, a.canonical_sheet, a."column" AS oc, b."column" AS nc, a.column_position AS op, b.column_position AS np, a.semantic_type AS ot, b.semantic_type AS nt
  FROM c a JOIN p ON p.previous_period = a.reporting_period JOIN c b ON b.reporting_period = p.reporting_period AND b.canonical_sheet = a.canonical_sheet AND b.normalised_column = a.normalised_column)"""


@query(
    f"""WITH {_SCHEMA_SQL} SELECT previous_period, current_period, canonical_sheet, oc AS "column", 'column_order_changed' AS change_type, op::VARCHAR AS previous_value, np::VARCHAR AS current_value, 'informational' AS review_status FROM j WHERE op <> np
UNION ALL SELECT previous_period, current_period, canonical_sheet, oc, 'semantic_type_changed', ot, nt, 'manual_review' FROM j WHERE ot <> nt"""
)
def schema_changes_kept_columns(spark, sf):
    """Changes of columns that two consecutive years have."""
    out = _changes(_schema(spark, sf)).filter(F.col("change_type").isin("column_order_changed", "semantic_type_changed"))
    return out.select("previous_period", "current_period", "canonical_sheet", F.col("previous_column").alias("column"), "change_type", "previous_value", "current_value", "review_status")


def moving_schema(spark, sf):
    """Yearly schemas whose columns come and go: a part name and what became of it is a column of a part type where a year has an even number of such lines."""
    j = t(spark, sf, "lineitem").join(t(spark, sf, "orders"), F.expr("l_orderkey = o_orderkey")).join(t(spark, sf, "part"), F.expr("l_partkey = p_partkey"))
    fate = F.expr("CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'A' THEN 'accepted' ELSE 'new' END")
    g = j.groupBy(F.year("o_orderdate").cast("string").alias("reporting_period"), F.col("p_type").alias("canonical_sheet"), F.concat_ws(" ", "p_name", fate).alias("normalised_column")).agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("m"))
    g = g.filter("n % 2 = 0")
    return g.select("reporting_period", "canonical_sheet", "normalised_column", F.initcap("normalised_column").alias("column"), (F.col("m") % 40).cast("int").alias("column_position"), F.lit("double").alias("storage_dtype"), F.when(F.col("n") % 3 == 0, "text").otherwise("mixed").alias("semantic_type"), F.lit("general").alias("number_format_class"))


def _changes(columns):
    sheets = columns.select("reporting_period", "canonical_sheet").distinct().withColumns({"sheet": F.initcap("canonical_sheet"), "header_row": F.lit(3)})
    return X.schema_changes(columns, sheets)


@query()
def schema_renames(spark, sf):
    """Columns that came, went or were possibly renamed; the likeness of names has no SQL form, so a test holds this query against brute force."""
    return _changes(moving_schema(spark, sf)).filter(F.col("change_type").isin("column_added", "column_removed", "possible_column_renamed"))


@query(
    """WITH d AS (SELECT year(o_orderdate)::VARCHAR AS reporting_period, 'c' || o_custkey AS product, max(o_orderpriority) AS grp FROM orders GROUP BY ALL),
p AS (SELECT reporting_period, lag(reporting_period) OVER (ORDER BY reporting_period) AS pp FROM (SELECT DISTINCT reporting_period FROM d)),
k AS (SELECT p.pp AS previous_period, p.reporting_period AS current_period, s.product FROM p CROSS JOIN (SELECT DISTINCT product FROM d) s WHERE p.pp IS NOT NULL)
SELECT previous_period, current_period, k.product, CASE WHEN a.grp IS NULL THEN 'product_service_added' WHEN b.grp IS NULL THEN 'product_service_removed' ELSE 'product_group_reassigned' END AS change_type, a.grp AS previous_value, b.grp AS current_value
FROM k LEFT JOIN d a ON a.reporting_period = previous_period AND a.product = k.product LEFT JOIN d b ON b.reporting_period = current_period AND b.product = k.product WHERE a.grp IS DISTINCT FROM b.grp"""
)
def taxonomy_changes(spark, sf):
    """Products that came, went or were reassigned between consecutive years."""
    d = t(spark, sf, "orders").groupBy(F.year("o_orderdate").cast("string").alias("reporting_period"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("product")).agg(F.max("o_orderpriority").alias("grp"))
    return X.keyed_changes(d, ["product"], "grp", ("product_service_added", "product_service_removed", "product_group_reassigned"))


_SECTORS = ["Home finance", "Hire purchase", "Annuities", "Funds & bonds", "Funeral plans", "Current accounts", "Other"]


@query(
    f"""WITH x AS (SELECT DISTINCT {_list(_SECTORS)}[p_size % {len(_SECTORS)} + 1] AS sector, p_name AS product_type FROM part), k AS (SELECT *, lower(sector || ' ' || product_type) AS w FROM x)
SELECT 'TAX-' || upper(left(sha1(sector || '|' || product_type), 10)) AS mapping_id, sector, product_type, CASE WHEN w LIKE '%home finance%' THEN 'home_finance' WHEN w LIKE '%hire purchase%' THEN 'consumer_credit' WHEN w LIKE '%annuit%' THEN 'decumulation_and_pensions' WHEN w LIKE '%fund%' OR w LIKE '%bond%' THEN 'investments'
  WHEN w LIKE '%funeral plan%' THEN 'insurance_and_pure_protection' WHEN w LIKE '%current account%' THEN 'banking_and_credit_cards' ELSE '' END AS suggested_group, CASE WHEN w LIKE '%home finance%' THEN 'mortgage_or_home_finance_keyword' WHEN w LIKE '%hire purchase%' THEN 'consumer_credit_keyword' WHEN w LIKE '%annuit%' THEN 'pension_or_annuity_keyword' WHEN w LIKE '%fund%' OR w LIKE '%bond%' THEN 'investment_keyword'
  WHEN w LIKE '%funeral plan%' THEN 'insurance_or_protection_keyword' WHEN w LIKE '%current account%' THEN 'banking_or_payment_keyword' ELSE 'no_safe_suggestion' END AS suggestion_basis, 'pending_review' AS review_decision FROM k"""
)
def taxonomy_mapping_template(spark, sf):
    """Distinct taxonomy rows with a suggestion by keyword that waits for review."""
    return context.mapping_template(t(spark, sf, "part").select(_pick(_SECTORS, "p_size").alias("sector"), F.col("p_name").alias("product_type")), ["sector", "product_type"])


# ---- notes, taxonomy, extraction -------------------------------------------------------------------------------------


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS row FROM documents), h AS (SELECT lang, doc_id, row, trim(text) AS tx, length(trim(text)) <= 100 AS heading FROM r WHERE trim(text) <> ''),
s AS (SELECT *, coalesce(last_value(CASE WHEN heading THEN trim(regexp_replace(trim(regexp_replace(lower(tx), '\\s+', ' ', 'g')), '[^a-z0-9]+', '_', 'g'), '_') END IGNORE NULLS) OVER (PARTITION BY lang ORDER BY row), 'preamble') AS section FROM h),
n AS (SELECT *, count(*) FILTER (NOT heading) OVER (PARTITION BY lang, section ORDER BY row) AS n FROM s)
SELECT lang, row::INT AS source_row, CASE WHEN heading THEN section ELSE section || '__' || n END AS definition_key, CASE WHEN heading THEN 'heading' ELSE 'narrative' END AS definition_type, sha256(tx) AS definition_text_hash FROM n"""
)
def notes_definitions(spark, sf):
    """Headings and numbered narratives: documents of a language are the rows of its notes sheet."""
    r = _numbered(t(spark, sf, "documents").select("lang", "doc_id", "text"), ["lang"], ["doc_id"])
    cells = r.select(F.lit("book").alias("workbook"), F.col("lang").alias("sheet"), "row", F.lit(1).alias("col"), F.col("text").alias("value"))
    header = cells.groupBy("workbook", "sheet").agg((F.max("row") + 1).alias("header_row"))
    return X.definitions(cells, header).select(F.col("sheet").alias("lang"), "source_row", "definition_key", "definition_type", "definition_text_hash")


@query(
    """WITH r AS (SELECT o_orderkey, o_orderpriority AS sheet, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) + 2 AS row, o_orderpriority IN ('1-URGENT', '2-HIGH') AS narrow, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS sec, CASE WHEN o_orderkey % 2 = 0 THEN 'G' || (o_custkey % 5) END AS grp, 'T' || (o_orderkey % 7) AS typ FROM orders),
v AS (SELECT sheet, row, 'new' AS version, sec, grp, typ FROM r UNION ALL SELECT sheet, row, 'old', grp, sec, typ FROM r WHERE NOT narrow),
f AS (SELECT sheet, version, row, coalesce(last_value(sec IGNORE NULLS) OVER (PARTITION BY sheet, version ORDER BY row), '') AS sector, coalesce(last_value(grp IGNORE NULLS) OVER (PARTITION BY sheet, version ORDER BY row), '') AS product_group, typ FROM v)
SELECT sheet, version AS taxonomy_version, sector, product_group, typ AS product_type, row::INT AS source_row FROM f"""
)
def taxonomy_layouts(spark, sf):
    """One layout, or an old and a new one side by side, as tagged rows."""
    r = _numbered(t(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderpriority"], ["o_orderkey"]).withColumn("row", F.col("row") + 2)
    r = r.withColumns({"sec": F.expr("CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END"), "grp": F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'G' || (o_custkey % 5) END"), "typ": F.expr("'T' || (o_orderkey % 7)")})
    narrow = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    one = lambda col, c: F.struct(F.lit(col).alias("col"), F.col(c).alias("value"))
    cells = F.when(narrow, F.array(one(2, "sec"), one(3, "grp"), one(4, "typ"))).otherwise(F.array(one(2, "grp"), one(3, "sec"), one(4, "typ"), one(6, "sec"), one(7, "grp"), one(8, "typ")))
    cells = r.select(F.lit("book").alias("workbook"), F.col("o_orderpriority").alias("sheet"), "row", F.explode(cells).alias("x")).select("workbook", "sheet", "row", "x.*")
    return X.taxonomy(cells).select("sheet", "taxonomy_version", "sector", "product_group", "product_type", "source_row")


_FIRMS = "CASE WHEN o_orderkey % 11 = 0 THEN 'Grand Total' WHEN o_orderkey % 13 = 0 THEN '' ELSE 'Customer ' || o_custkey END"
_VALUE = "CASE o_orderkey % 6 WHEN 0 THEN '#N/A' WHEN 1 THEN '-' WHEN 2 THEN '12%' WHEN 3 THEN '' ELSE cast(o_custkey AS {s}) END"


def _body(spark, sf):
    """Orders as a sheet for each priority: firm name, two mapped products and one header that no mapping knows."""
    heads = "array(named_struct('col', 1, 'value', 'Firm Name'), named_struct('col', 2, 'value', 'Home finance'), named_struct('col', 3, 'value', 'Investments (per 1,000 accounts)'), named_struct('col', 4, 'value', 'Mystery'))"
    grid = _grid(spark, sf).withColumnRenamed("o_orderpriority", "sheet")
    rows = grid.select("workbook", "sheet", "row", F.expr(f"explode(array(named_struct('col', 1, 'value', {_FIRMS}), named_struct('col', 2, 'value', {_VALUE.format(s='string')}), named_struct('col', 3, 'value', cast(o_custkey AS string)), named_struct('col', 4, 'value', 'x')))").alias("x"))
    top = grid.select("workbook", "sheet").distinct().select("workbook", "sheet", F.lit(1).alias("row"), F.expr(f"explode({heads})").alias("x"))
    cells = rows.unionByName(top).select("workbook", "sheet", "row", "x.*")
    sheets = top.select("workbook", "sheet").distinct().select("workbook", "sheet", F.col("workbook").alias("reporting_period"), F.when(F.col("sheet") == "1-URGENT", "context_provision").otherwise("opened").alias("canonical_sheet"), F.lit(1).alias("header_row"))
    return extract.placed(cells, sheets)


def _registry(spark):
    table = lambda names, rows: spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, rows))} AS t({', '.join(names)})")
    return extract.Registry(
        table(["raw_label", "canonical_product_group"], [("Home Finance", "home_finance"), ("investments", "investments")]),
        table(["canonical_sheet", "output_entity", "metric_name", "measurement_unit"], [("opened", "complaint_metrics", "complaints_opened", "count"), ("context_provision", "complaint_metrics", "complaints_in_context", "context_rate")]),
        table(["reporting_period", "canonical_sheet", "product_group", "raw_value", "value_status", "value_reason"], [("1996-H1", "opened", "home_finance", "#N/A", "not_calculable", "no_component_values")]),
    )


_BODY_SQL = f"""g AS (SELECT *, year(o_orderdate) || CASE WHEN month(o_orderdate) <= 6 THEN '-H1' ELSE '-H2' END AS workbook, o_orderpriority AS sheet FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY workbook, sheet ORDER BY o_orderkey) + 1 AS row, {_FIRMS} AS firm_name,
  {_VALUE.format(s='VARCHAR')} AS v2, CASE WHEN sheet = '1-URGENT' THEN 'context_provision' ELSE 'opened' END AS role FROM g), ok AS (SELECT * FROM r WHERE firm_name NOT IN ('', 'Grand Total'))"""


@query(
    f"""WITH {_BODY_SQL}, m AS (SELECT workbook AS reporting_period, firm_name, role AS canonical_sheet, 'home_finance' AS product_group, v2 AS raw_value, row, sheet, 2 AS source_column FROM ok UNION ALL SELECT workbook, firm_name, role, 'investments', o_custkey::VARCHAR, row, sheet, 3 FROM ok UNION ALL SELECT workbook, firm_name, role, NULL, 'x', row, sheet, 4 FROM ok)
SELECT reporting_period, firm_name, canonical_sheet, CASE canonical_sheet WHEN 'opened' THEN 'complaints_opened' ELSE 'complaints_in_context' END AS metric_name, product_group, CASE WHEN raw_value = '12%' THEN 0.12 ELSE TRY_CAST(raw_value AS DOUBLE) END AS metric_value,
  CASE WHEN canonical_sheet = 'opened' THEN '' WHEN source_column = 3 THEN 'per_1000_accounts' ELSE 'per_1000_accounts_or_policies_provided' END AS measurement_basis, raw_value, sheet AS source_sheet, row::INT AS source_row, source_column,
  CASE WHEN raw_value = '#N/A' AND reporting_period = '1996-H1' AND canonical_sheet = 'opened' THEN 'not_calculable' WHEN raw_value = '' THEN 'missing' WHEN raw_value = '-' THEN 'missing_marker' WHEN raw_value IN ('#N/A', 'x') THEN 'invalid' ELSE 'valid' END AS value_status, product_group IS NULL AS rejected FROM m"""
)
def metric_extraction(spark, sf):
    """Metric cells under a mapping registry, with reviewed exceptions and headers that no mapping knows."""
    return extract.metrics(_body(spark, sf), _registry(spark)).select("reporting_period", "firm_name", "canonical_sheet", "metric_name", "product_group", "metric_value", "measurement_basis", "raw_value", "source_sheet", "source_row", "source_column", "value_status", "rejected")


@query(
    f"""WITH {_BODY_SQL} SELECT workbook, sheet, count(*) AS eligible_source_rows, 2::BIGINT AS mapped_metric_columns, 2 * count(*) AS expected_metric_records, 2 * count(*) AS extracted_metric_records, count(*) AS rejected_records, 'mismatch' AS reconciliation_status FROM ok GROUP BY 1, 2"""
)
def extraction_reconciliation(spark, sf):
    """Firms times mapped headers against the rows made, for each sheet."""
    body = _body(spark, sf)
    out = extract.reconciliation(body, extract.metrics(body, _registry(spark)))
    return out.select("workbook", "sheet", "eligible_source_rows", "mapped_metric_columns", "expected_metric_records", "extracted_metric_records", "rejected_records", "reconciliation_status")


# ---- governance ------------------------------------------------------------------------------------------------------

_REGISTER = """SELECT cast(o_orderkey AS {s}) AS action_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'in_progress' ELSE 'blocked' END AS status,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'approved' ELSE 'pending_business_review' END AS approval_status, CASE WHEN o_custkey % 3 = 0 THEN ' ' ELSE cast(o_custkey AS {s}) END AS owner, CASE WHEN o_orderkey % 400 = 1 THEN 'doc' || (o_orderkey % 7) END AS evidence_reference FROM orders"""


def _register(spark, sf):
    return spark.sql(_REGISTER.format(s="string").replace("FROM orders", "FROM {orders}"), orders=t(spark, sf, "orders"))


@query(
    f"""WITH r AS ({_REGISTER.format(s='VARCHAR')}), g AS (SELECT count(*) AS action_count, count(*) FILTER (status <> 'completed') AS open_action_count, count(*) FILTER (status <> 'completed' AND trim(owner) = '') AS unassigned_open_action_count, count(*) FILTER (approval_status = 'pending_business_review') AS pending_approval_count,
  count(*) FILTER (status = 'blocked') AS blocked, count(*) FILTER (action_id = '1' AND approval_status = 'approved') > 0 AS methodology_approved, count(*) FILTER (action_id IN ('1', '2', '3') AND approval_status <> 'approved') AS pending_decision_count FROM r),
m AS (SELECT count(*) AS missing_evidence_count FROM r WHERE evidence_reference IS NOT NULL AND evidence_reference NOT IN ('doc1', 'doc2', 'doc3'))
SELECT *, methodology_approved AND missing_evidence_count = 0 AND pending_decision_count = 0 AS release_authorised FROM g, m"""
)
def register_handoff(spark, sf):
    """The gate of a register that orders host, against three known references."""
    evidence = spark.sql("SELECT * FROM VALUES ('doc1'), ('doc2'), ('doc3') AS t(evidence_reference)")
    g = governance.handoff_gate(_register(spark, sf), evidence, "1", ["1", "2", "3"])
    return g.select("action_count", "open_action_count", "unassigned_open_action_count", "pending_approval_count", F.col("status_counts")["blocked"].alias("blocked"), "methodology_approved", "pending_decision_count", F.size("missing_evidence_references").cast("long").alias("missing_evidence_count"), "release_authorised")


_OUTCOMES = (*review.OUTCOMES, "other")
_BANDS = ("priority_review", "review", "monitor", "no_current_signal", "insufficient_data")


@query(
    f"""SELECT o_orderkey, CASE o WHEN 'coherent_priority_case' THEN CASE WHEN b = 'priority_review' THEN 'aligned' ELSE 'needs_review' END WHEN 'likely_false_positive' THEN CASE WHEN b IN ('no_current_signal', 'monitor', 'insufficient_data') THEN 'aligned' ELSE 'needs_review' END
  WHEN 'potential_false_negative' THEN CASE WHEN b IN ('monitor', 'review', 'priority_review') THEN 'aligned' ELSE 'needs_review' END ELSE 'not_targeted_by_revision' END AS review_alignment
FROM (SELECT o_orderkey, {_list(_OUTCOMES)}[o_orderkey % {len(_OUTCOMES)} + 1] AS o, {_list(_BANDS)}[o_custkey % {len(_BANDS)} + 1] AS b FROM orders)"""
)
def review_alignment(spark, sf):
    """Whether a revised band agrees with what a reviewer found."""
    return t(spark, sf, "orders").select("o_orderkey", review.alignment(_pick(_OUTCOMES, "o_orderkey"), _pick(_BANDS, "o_custkey")).alias("review_alignment"))
