"""Registered queries of the quality contracts, the key joins and the cell rules."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes, cells, tags
from ..operators import contracts, relate
from ..operators.contracts import Check, Contract, Field
from .areas import table

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return register


PROFILED = {"customer": ["c_custkey"], "orders": ["o_custkey"], "lineitem": ["l_orderkey", "l_linenumber"], "events": ["user_id", "event_type"],
            "documents": ["doc_id"], "labels": ["doc_id"], "pages": ["page_id"], "conversations": ["conv_id"],
            "region": ["r_regionkey"], "nation": ["n_regionkey"], "supplier": ["s_nationkey"], "part": ["p_partkey"], "embeddings": ["vec_id"], "benchmark": ["item_id"]}
COLUMN_COUNTS = {"customer": 5, "orders": 6, "lineitem": 11, "events": 6, "documents": 5, "labels": 3, "pages": 3, "conversations": 4,
                 "region": 2, "nation": 3, "supplier": 4, "part": 6, "embeddings": 3, "benchmark": 2}


def _missing_sql(t):
    columns = {"customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
               "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
               "events": "event_id ts user_id event_type value props", "documents": "doc_id text lang source n_chars", "labels": "doc_id quality toxic",
               "pages": "page_id url html", "conversations": "conv_id turn role text", "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey",
               "supplier": "s_suppkey s_name s_nationkey s_acctbal", "part": "p_partkey p_name p_brand p_type p_size p_retailprice", "embeddings": "vec_id embedding label", "benchmark": "item_id text"}[t].split()
    return " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in columns)


@query("profile_table", " UNION ALL ".join(
    f"""SELECT '{t}' AS dataset, count(*) AS rows, {COLUMN_COUNTS[t]} AS columns, {_missing_sql(t)} AS missing_values,
    count(*) - count(DISTINCT ({', '.join(k)})) AS duplicate_keys FROM {t}""" for t, k in PROFILED.items()))
def profile_table(spark, sf):
    return relate.stack_tables(*[contracts.profile(table(spark, sf, t), t, k) for t, k in PROFILED.items()])


LINES = Contract((
    Field("l_orderkey", "int", low=0), Field("l_partkey", "int"), Field("l_suppkey", "int"), Field("l_linenumber", "int", low=1, high=6),
    Field("l_quantity", "float", above=2), Field("l_extendedprice", "float", low=1000, high=90000), Field("l_discount", "float", low=0, high=0.08),
    Field("l_tax", "int"), Field("l_returnflag", "text", allowed=("A", "R")), Field("l_linestatus", "text"), Field("l_comment", "text")),
    unique=("l_orderkey", "l_linenumber"))


@query("contract_report", """WITH r AS (
    SELECT 0 AS position, 'l_comment' AS "column", 'column present' AS rule, 1 AS n UNION ALL SELECT 1, 'l_shipdate', 'no other columns', 1
    UNION ALL SELECT 106, 'l_linenumber', 'in range 1 to 6', count(*) FROM lineitem WHERE l_linenumber NOT BETWEEN 1 AND 6
    UNION ALL SELECT 109, 'l_quantity', 'above 2', count(*) FROM lineitem WHERE l_quantity <= 2
    UNION ALL SELECT 112, 'l_extendedprice', 'in range 1000 to 90000', count(*) FROM lineitem WHERE l_extendedprice NOT BETWEEN 1000 AND 90000
    UNION ALL SELECT 115, 'l_discount', 'in range 0 to 0.08', count(*) FROM lineitem WHERE l_discount NOT BETWEEN 0 AND 0.08
    UNION ALL SELECT 116, 'l_tax', 'is int', count(*) FROM lineitem WHERE l_tax <> floor(l_tax)
    UNION ALL SELECT 119, 'l_returnflag', 'in [''A'', ''R'']', count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'R')
    UNION ALL SELECT 1000, 'table', 'unique l_orderkey, l_linenumber', sum(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
    SELECT 'lineitem' AS dataset, "column", rule, n FROM r WHERE n > 0""")
def contract_report(spark, sf):
    return contracts.contract_failures(table(spark, sf, "lineitem"), LINES, "lineitem").select("dataset", "column", "rule", "n")


@query("contract_record", """WITH r AS (
    SELECT 102 AS p, 'o_totalprice: at least 5000 (e.g. ' || (SELECT min(o_totalprice::VARCHAR) FROM orders WHERE o_totalprice < 5000) || ')' AS t, count(*) AS n FROM orders WHERE o_totalprice < 5000
    UNION ALL SELECT 104, 'o_orderpriority: in [''1-URGENT'', ''2-HIGH'', ''3-MEDIUM'', ''5-LOW''] (e.g. ' || (SELECT min(o_orderpriority) FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')) || ')', count(*)
      FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')),
    f AS (SELECT * FROM r WHERE n > 0)
    SELECT 'contract:orders' AS dataset, 'FAIL' AS status, (SELECT count(*) FROM orders) AS rows, 6 AS columns, 0 AS missing_values, 0 AS duplicate_keys,
    'schema failed with ' || sum(n) || ' failing case(s) of ' || count(*) || ' rule(s): ' || string_agg(t, '; ' ORDER BY p) AS notes FROM f""")
def contract_record(spark, sf):
    orders = table(spark, sf, "orders")
    rules = Contract((Field("o_totalprice", "float", low=5000), Field("o_orderpriority", "text", allowed=("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")),
                      Field("o_orderkey", "int", unique=True)), strict=False)
    failures = contracts.contract_failures(orders, rules, "orders")
    return contracts.contract_record(failures, contracts.profile(orders, "orders", ["o_orderkey"]), "orders")


@query("quality_rollup", """WITH v AS (SELECT count(*) AS n, min(o_totalprice) AS lo FROM orders)
    SELECT 'orders' AS dataset, 'FAIL' AS status, n AS rows, 6 AS columns, 0 AS missing_values, 0 AS duplicate_keys,
    'only ' || format('{:,}', n) || ' orders; 3 order states; lowest total ' || lo::VARCHAR || ' is small' AS notes FROM v""")
def quality_rollup(spark, sf):
    orders = table(spark, sf, "orders")
    issues = contracts.run_checks(orders, "orders", [
        Check(F.count(F.lit(1)), "only {value} orders", low=10_000_000_000),
        Check(F.count_if(F.col("o_totalprice").isNull()), "{value} empty totals", level="warn", high=0),
        Check(F.countDistinct("o_orderstatus"), "{value} order states", level="warn", equals=4),
        Check(F.min("o_totalprice"), "lowest total {value} is small", level="warn", low=1_000_000)])
    return contracts.issue_record(issues, contracts.profile(orders, "orders", ["o_orderkey"]), "orders")


@query("coverage", """SELECT (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS missing,
    (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS unknown""")
def coverage(spark, sf):
    used = table(spark, sf, "orders").select(F.col("o_custkey").alias("code"))
    return relate.coverage(used, table(spark, sf, "customer").select(F.col("c_custkey").alias("code")), "code")


@query("reconcile", """SELECT l_suppkey, a, r, n, total, a + r + n - total AS difference FROM (SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'A') AS a,
    count(*) FILTER (WHERE l_returnflag = 'R') AS r, count(*) FILTER (WHERE l_returnflag = 'N') AS n, count(*) + l_suppkey % 9 AS total FROM lineitem GROUP BY l_suppkey)
    WHERE abs(a + r + n - total) > 5""")
def reconcile(spark, sf):
    flag = F.col("l_returnflag")
    bands = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count_if(flag == "A").alias("a"), F.count_if(flag == "R").alias("r"), F.count_if(flag == "N").alias("n"), F.count(F.lit(1)).alias("_all"))
    return contracts.reconcile(bands.withColumn("total", F.col("_all") + F.col("l_suppkey") % 9).drop("_all"), ["a", "r", "n"], "total")


@query("share_threshold", """WITH m AS (SELECT count(*) AS n, count(*) FILTER (WHERE c_custkey % 200 = 0) AS few, count(*) FILTER (WHERE c_custkey % 20 = 0) AS many FROM customer)
    SELECT 'few' AS dataset, 0 AS position, 'warn' AS level, few || ' places have unusable coordinates and are kept without a point' AS message FROM m
    UNION ALL SELECT 'many', 0, 'error', many || ' of ' || n || ' places have unusable coordinates' FROM m""")
def share_threshold(spark, sf):
    key = F.col("c_custkey")
    out = []
    for name, step in (("few", 200), ("many", 20)):
        lon = F.when(key % step != 0, key % 18 + 141.5)
        out.append(contracts.placed_share(table(spark, sf, "customer").select(lon.alias("lon"), F.lit(-33.0).alias("lat")), name, "places"))
    return relate.stack_tables(*out)


@query("missing_measure_rows", """WITH j AS (SELECT o_custkey, r FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS r FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) ON l_orderkey = o_orderkey)
    SELECT count(*) AS rows, count(*) FILTER (WHERE r IS NULL) AS rows_with_missing, count(DISTINCT o_custkey) AS distinct_keys FROM j""")
def missing_measure_rows(spark, sf):
    returned = (table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R").groupBy(F.col("l_orderkey").alias("o_orderkey"))
                .agg(F.sum("l_quantity").alias("returned")))
    joined = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(returned, "o_orderkey", "left")
    return contracts.missing_measures(joined, ["o_totalprice", "returned"], "o_custkey")


@query("source_checks", """SELECT 'lineitem' AS dataset, 1 AS position, 'error' AS level, 'returns differ: 3' AS message
    UNION ALL SELECT 'lineitem', 2, 'warn', format('{:,}', (SELECT count(*) FROM lineitem WHERE l_discount > 0.08)) || ' large discounts'""")
def source_checks(spark, sf):
    lines = table(spark, sf, "lineitem")
    return contracts.run_checks(lines, "lineitem", [
        Check(F.count(F.lit(1)), "only {value} lines", low=10), Check(F.countDistinct("l_returnflag"), "returns differ: {value}", equals=2),
        Check(F.count_if(F.col("l_discount") > 0.08), "{value} large discounts", level="warn", high=0)])


@query("replace_by_key", """WITH cur AS (SELECT o_orderkey AS k, o_orderstatus AS kind, o_orderpriority AS info FROM orders WHERE o_orderkey % 5 <> 0),
    fut AS (SELECT l_orderkey AS k, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS kind, CASE WHEN l_linenumber % 3 = 0 THEN 'line ' || l_linenumber END AS info FROM lineitem WHERE l_returnflag = 'R')
    SELECT * FROM cur WHERE k NOT IN (SELECT k FROM fut) UNION ALL SELECT f.k, coalesce(f.kind, c.kind), coalesce(f.info, c.info) FROM fut f JOIN cur c ON c.k = f.k""")
def replace_by_key(spark, sf):
    current = table(spark, sf, "orders").filter(F.col("o_orderkey") % 5 != 0).select(
        F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("info"))
    n = F.col("l_linenumber")
    future = table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("k"), F.when(n % 2 == 0, F.col("l_returnflag")).alias("kind"),
        F.when(n % 3 == 0, F.concat(F.lit("line "), n.cast("string"))).alias("info"))
    return relate.replace_by_key(current, future, "k", ["kind", "info"], [F.col("kind"), F.col("info")])


@query("first_per_key", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem) WHERE k = 1""")
def first_per_key(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return relate.first_per_key(lines, ["l_orderkey"], [F.col(c) for c in lines.columns[1:]])


CELL_SQL = """c AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN format('{:,}', p_partkey) WHEN 1 THEN (p_retailprice)::VARCHAR WHEN 2 THEN 'np' WHEN 3 THEN ' ' || p_size || '.5 '
    WHEN 4 THEN '' WHEN 5 THEN NULL WHEN 6 THEN 'N/A' ELSE p_size || 'd' END AS cell FROM part)"""


def _cells(spark, sf):
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    kind = key % 8
    cell = (F.when(kind == 0, F.format_number(key, 0)).when(kind == 1, F.col("p_retailprice").cast("string")).when(kind == 2, "np")
            .when(kind == 3, F.concat(F.lit(" "), size, F.lit(".5 "))).when(kind == 4, "").when(kind == 6, "N/A").when(kind == 7, F.concat(size, F.lit("d"))))
    return table(spark, sf, "part").select(key, cell.alias("cell"))


@query("to_int_cells", f"""WITH {CELL_SQL} SELECT p_partkey, round_even(try_cast(replace(trim(cell), ',', '') AS DOUBLE), 0)::BIGINT AS whole, try_cast(trim(cell) AS DOUBLE) AS number FROM c""")
def to_int_cells(spark, sf):
    return _cells(spark, sf).select("p_partkey", cells.to_int(F.col("cell")).alias("whole"), cells.to_numeric(F.col("cell")).alias("number"))


@query("clean_codes", """SELECT c_custkey, CASE WHEN regexp_full_match(code, '[0-9]{9}') THEN code::BIGINT END AS area_code, regexp_full_match(code, '1[0-9]{8}') AS in_state,
    CASE seg WHEN 'veh' THEN 'Vehicle' WHEN 'ped' THEN 'Pedestrian' ELSE c_mktsegment END AS asset, regexp_full_match(left(c_mktsegment, 1), '[A-S]') AS industry
    FROM (SELECT *, CASE c_custkey % 3 WHEN 0 THEN (100000000 + c_custkey)::VARCHAR WHEN 1 THEN (800000000 + c_custkey)::VARCHAR ELSE c_name END AS code,
    CASE c_mktsegment WHEN 'MACHINERY' THEN 'veh' WHEN 'BUILDING' THEN 'ped' END AS seg FROM customer)""")
def clean_codes(spark, sf):
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    code = (F.when(key % 3 == 0, (key + 100000000).cast("string")).when(key % 3 == 1, F.concat(F.lit(" "), (key + 800000000).cast("string")))
            .otherwise(F.col("c_name")))
    mapping = {"machinery": "Vehicle", "building": "Pedestrian"}
    return table(spark, sf, "customer").select(
        key, F.when(cells.is_area_code(code), cells.to_int(code)).alias("area_code"), cells.is_state_area_code(code).alias("in_state"),
        cells.recode(segment, mapping).alias("asset"), cells.is_industry(F.substring(segment, 1, 1)).alias("industry"))


@query("blank_default", """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_custkey % 4 END AS location_type, CASE WHEN c_custkey % 6 <> 0 THEN 'code ' || c_custkey % 6 END AS stop_code FROM customer""")
def blank_default(spark, sf):
    key = F.col("c_custkey")
    kind = F.when(key % 4 == 0, "").otherwise((key % 4).cast("string"))
    code = F.when(key % 6 == 0, "").otherwise(F.concat(F.lit("code "), (key % 6).cast("string")))
    return table(spark, sf, "customer").select(
        key, F.coalesce(cells.to_int(kind), F.lit(0)).alias("location_type"), cells.blank_to_null(code).alias("stop_code"))


@query("age_labels", """SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'total' WHEN 1 THEN '85-and-over' WHEN 2 THEN '5-9' WHEN 3 THEN '0-4' END AS band FROM part""")
def age_labels(spark, sf):
    kind = F.col("p_size") % 6
    heading = (F.when(kind == 0, "Total persons").when(kind == 1, "85 and over").when(kind == 2, " 5–9 ").when(kind == 3, "0—4")
               .when(kind == 4, F.col("p_name")))
    return table(spark, sf, "part").select("p_partkey", cells.age_label(heading).alias("band"))


TAG_TEXT_SQL = """t AS (SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN '"shop"=>"' || shop || '","name"=>"' || name || '","foot"=>"' || foot || '","access"=>"' || access ||
    '","foot"=>"' || foot2 || '"' END AS txt, shop, name, foot2 AS foot, access FROM (SELECT p_partkey, ['supermarket', 'convenience', 'grocery', 'newsagent', 'kiosk'][p_partkey % 5 + 1] AS shop,
    CASE WHEN p_partkey % 3 = 0 THEN 'IGA ' || p_name WHEN p_partkey % 3 = 1 THEN 'Big' || 'alow ' || p_name ELSE p_name END AS name,
    ['no', 'yes', 'x'][p_partkey % 3 + 1] AS foot, ['yes', 'no', 'designated', 'other'][p_partkey % 4 + 1] AS foot2, ['private', 'no', 'customers'][p_partkey % 3 + 1] AS access FROM part))"""


def _tagged(spark, sf):
    key = F.col("p_partkey")

    def pick(values):
        return F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))
    name = (F.when(key % 3 == 0, F.concat(F.lit("IGA "), F.col("p_name"))).when(key % 3 == 1, F.concat(F.lit("Bigalow "), F.col("p_name")))
            .otherwise(F.col("p_name")))
    text = F.concat(F.lit('"shop"=>"'), pick(["supermarket", "convenience", "grocery", "newsagent", "kiosk"]), F.lit('","name"=>"'), name, F.lit('","foot"=>"'),
                    pick(["no", "yes", "x"]), F.lit('","access"=>"'), pick(["private", "no", "customers"]), F.lit('","foot"=>"'),
                    pick(["yes", "no", "designated", "other"]), F.lit('"'))
    frame = table(spark, sf, "part").select(key, F.when(key % 11 != 0, text).alias("text"))
    return frame.withColumn("tags", tags.tag_map(F.col("text")))


@query("hstore_tags", f"""WITH {TAG_TEXT_SQL} SELECT p_partkey, CASE WHEN txt IS NULL THEN 0 ELSE 4 END AS n_tags, CASE WHEN txt IS NOT NULL THEN foot END AS foot, CASE WHEN txt IS NOT NULL THEN name END AS name FROM t""")
def hstore_tags(spark, sf):
    return _tagged(spark, sf).select("p_partkey", F.size("tags").alias("n_tags"), F.try_element_at("tags", F.lit("foot")).alias("foot"),
                                     F.try_element_at("tags", F.lit("name")).alias("name"))


@query("classify_text", f"""WITH {TAG_TEXT_SQL} SELECT p_partkey, CASE WHEN txt IS NULL THEN NULL WHEN shop = 'supermarket' THEN 'supermarket'
    WHEN shop IN ('convenience', 'grocery') AND regexp_matches(name, '\\b(aldi|coles|foodworks|iga|woolworths)\\b', 'i') THEN 'supermarket'
    WHEN shop IN ('convenience', 'newsagent') THEN 'convenience' END AS kind FROM t""")
def classify_text(spark, sf):
    t = F.col("tags")
    kind = tags.shop_kind(F.try_element_at(t, F.lit("shop")), F.try_element_at(t, F.lit("amenity")), F.try_element_at(t, F.lit("name")))
    return _tagged(spark, sf).select("p_partkey", kind.alias("kind"))


@query("predicate_tags", f"""WITH {TAG_TEXT_SQL} SELECT p_partkey, txt IS NULL OR (foot <> 'no' AND (access NOT IN ('no', 'private') OR foot IN ('yes', 'designated', 'permissive'))) AS walkable,
    txt IS NOT NULL AND shop = 'kiosk' AS zebra FROM t""")
def predicate_tags(spark, sf):
    crossing = F.when(F.try_element_at("tags", F.lit("shop")) == "kiosk", "zebra")
    return _tagged(spark, sf).select("p_partkey", tags.walkable(F.col("tags")).alias("walkable"), tags.zebra(crossing, F.lit(None).cast("string")).alias("zebra"))


@query("usable_points", """SELECT c_custkey, CASE WHEN lon > 140 AND lon < 160 AND lat > -38 AND lat < -27 AND lon <> 0 AND lat <> 0 THEN lon END AS lon FROM (SELECT c_custkey,
    CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE 135 + c_custkey % 30 END AS lon, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE -40 + c_custkey % 16 END AS lat FROM customer)""")
def usable_points(spark, sf):
    key = F.col("c_custkey")
    frame = table(spark, sf, "customer").select(key, F.when(key % 10 != 0, key % 30 + 135).alias("lon"),
                                                F.when(key % 7 == 0, 0).otherwise(key % 16 - 40).alias("lat"))
    good = boxes.usable_point(F.col("lon"), F.col("lat"), boxes.STATE_BOX)
    return frame.select("c_custkey", F.when(good, F.col("lon")).alias("lon"))


@query("bbox_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000 AND o_custkey BETWEEN 100 AND 900")
def bbox_scan(spark, sf):
    orders = table(spark, sf, "orders")
    inside = boxes.bounds_meet_box(F.col("o_totalprice"), F.col("o_custkey"), F.col("o_totalprice"), F.col("o_custkey"), (100000, 100, 200000, 900))
    return orders.filter(inside).select("o_orderkey", "o_totalprice")


@query("domain_sets", "SELECT count(*) FILTER (WHERE n = 0) AS absent, count(*) FILTER (WHERE NOT known) AS unexpected FROM (SELECT event_type, count(*) AS n, event_type IN ('view', 'click', 'purchase') AS known FROM events GROUP BY event_type)")
def domain_sets(spark, sf):
    """Domain equality: wanted values that do not occur, and values that are not wanted."""
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in ("view", "click", "purchase")])).alias("event_type"))
    both = relate.coverage(table(spark, sf, "events").select("event_type"), wanted, "event_type")
    return both.select(F.col("missing").alias("absent"), F.col("unknown").alias("unexpected"))
