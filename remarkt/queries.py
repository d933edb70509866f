"""One query for each operator over the test tables, with the same result as DuckDB SQL where SQL can express it."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .functions import extract, features, legacy, scalars
from .operators import ranks, rows, statistics
from .plans import etl, ingest, models, search, training, trigrams
from .schema import FORECASTS, LISTINGS, PRICE_HISTORY, PRODUCTS, RAW_ITEMS, ensure_columns
from .sources import html, store, tables
from .streaming import changes, incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def now():
    """The clock of all queries."""
    return F.lit("2026-01-02 03:04:05").cast("timestamp")


def today():
    return F.lit("2026-01-02").cast("date")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            # halves are nudged on both sides, so that both engines round them alike
            ORACLES[f.__name__] = sql.replace("round(", "round(1e-7 + ")
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, *names: str, places: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(1e-7 + F.col(n).cast("double"), places) for n in names})


# --- aggregation


@query("""SELECT p_partkey, round(avg(l_extendedprice), 4) AS avg_price, min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price, count(l_extendedprice) AS listing_count
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_extendedprice BETWEEN 5000 AND 300000 GROUP BY p_partkey""")
def price_history(spark, d):
    part, line = read(spark, d, "part").select("p_partkey"), read(spark, d, "lineitem").select("l_partkey", "l_extendedprice")
    df = line.join(part, line.l_partkey == part.p_partkey).where(F.col("l_extendedprice").between(config.MIN_PRICE, config.MAX_PRICE))
    return rounded(statistics.price_history(df, "p_partkey", "l_extendedprice"), "avg_price")


@query("""SELECT l_partkey, CAST(year(l_shipdate) AS INTEGER) AS record_year, round(avg(l_extendedprice), 4) AS avg_price, min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price, count(*) AS listing_count FROM lineitem GROUP BY ALL""")
def price_history_merge(spark, d):
    df = read(spark, d, "lineitem").withColumn("record_year", F.year("l_shipdate"))
    part = lambda c: df.where(c).groupBy("l_partkey", "record_year").agg(F.avg("l_extendedprice").alias("avg_price"), F.min("l_extendedprice").alias("min_price"), F.max("l_extendedprice").alias("max_price"), F.count(F.lit(1)).alias("listing_count"))
    return rounded(rows.merge_statistics(part(F.month("l_shipdate") <= 6), part(F.month("l_shipdate") > 6), ["l_partkey", "record_year"]), "avg_price")


@query("""WITH m AS (SELECT l_partkey, l_returnflag AS v, count(*) AS n FROM lineitem GROUP BY ALL), s AS (SELECT l_partkey, l_linestatus AS v, count(*) AS n FROM lineitem GROUP BY ALL),
a AS (SELECT l_partkey, v, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, v) AS k FROM m), b AS (SELECT l_partkey, v, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, v) AS k FROM s),
q AS (SELECT l_partkey, round(avg(l_quantity), 4) AS quantity FROM lineitem GROUP BY ALL)
SELECT q.l_partkey, quantity, a.v AS l_returnflag, b.v AS l_linestatus FROM q JOIN a ON a.l_partkey = q.l_partkey AND a.k = 1 JOIN b ON b.l_partkey = q.l_partkey AND b.k = 1""")
def product_modes(spark, d):
    return rounded(rows.modes(read(spark, d, "lineitem"), ["l_partkey"], {"quantity": "l_quantity"}, {"l_returnflag": "N", "l_linestatus": "O"}), "quantity")


@query("""WITH m AS (SELECT p_brand, median(l_extendedprice) AS base FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 5 GROUP BY p_brand)
SELECT p_partkey, round(coalesce(base, (SELECT avg(base) FROM m)), 4) AS base_price FROM (SELECT p_partkey, CASE WHEN p_size = 7 THEN 'none' ELSE p_brand END AS p_brand FROM part) LEFT JOIN m USING (p_brand)""")
def target_encoding(spark, d):
    part, line = read(spark, d, "part"), read(spark, d, "lineitem")
    each, fallback = statistics.target_encoding(line.join(part, line.l_partkey == part.p_partkey).where("p_size > 5"), "p_brand", "l_extendedprice")
    df = part.select("p_partkey", F.when(F.col("p_size") == 7, "none").otherwise(F.col("p_brand")).alias("p_brand"))
    return rounded(statistics.apply_encoding(df, each, fallback, "p_brand", "base").select("p_partkey", F.col("base").alias("base_price")), "base_price")


@query("""SELECT o_orderstatus, o_orderpriority, CASE WHEN grouping(o_orderstatus) = 0 THEN 'o_orderstatus' WHEN grouping(o_orderpriority) = 0 THEN 'o_orderpriority' ELSE 'all' END AS level,
min(o_totalprice) AS min_price, max(o_totalprice) AS max_price, round(avg(o_totalprice), 4) AS avg_price, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""")
def stats_by_source_condition(spark, d):
    return rounded(statistics.grouped_statistics(read(spark, d, "orders"), "o_totalprice", "o_orderstatus", "o_orderpriority"), "avg_price")


@query("""SELECT o_orderstatus, o_orderpriority, min(o_totalprice) AS low, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.75), 4) AS q3, max(o_totalprice) AS high FROM orders GROUP BY ALL""")
def box_plot(spark, d):
    return rounded(statistics.box_plot(read(spark, d, "orders"), "o_totalprice", "o_orderstatus", "o_orderpriority"), "q1", "median", "q3")


@query("""SELECT count(l_extendedprice) AS n, round(avg(l_extendedprice), 4) AS mean, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(median(l_extendedprice), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3, min(l_extendedprice) AS low, max(l_extendedprice) AS high, round(stddev_samp(l_extendedprice), 4) AS std FROM lineitem""")
def describe_prices(spark, d):
    return rounded(statistics.describe(read(spark, d, "lineitem"), "l_extendedprice"), "mean", "q1", "median", "q3", "std")


@query("""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS status, o_totalprice > 100000 AS dear FROM orders)
SELECT 'o_orderkey' AS column_name, count(o_orderkey) AS non_null, round(100.0 * count(o_orderkey) / count(*), 4) AS share, CAST(NULL AS BIGINT) AS n_true FROM t
UNION ALL SELECT 'status', count(status), round(100.0 * count(status) / count(*), 4), NULL FROM t UNION ALL SELECT 'dear', count(dear), round(100.0 * count(dear) / count(*), 4), count(*) FILTER (dear) FROM t""")
def profile_coverage(spark, d):
    df = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("status"), (F.col("o_totalprice") > 100000).alias("dear"))
    return rounded(statistics.coverage(df), "share")


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1")
def value_counts(spark, d):
    return statistics.value_counts(read(spark, d, "orders"), "o_orderpriority")


CONFUSION = """WITH t AS (SELECT quality AS l, CASE WHEN length(text) > 1000 THEN 1 ELSE 0 END AS p FROM documents JOIN labels USING (doc_id)),
c AS (SELECT x AS label, count(*) FILTER (l = x) AS support, count(*) FILTER (p = x) AS predicted, count(*) FILTER (l = x AND p = x) AS hit FROM t, (SELECT unnest([0, 1]) AS x) GROUP BY x)
SELECT label, round(hit / predicted, 6) AS precision, round(hit / support, 6) AS recall, round(2 * hit / (predicted + support), 6) AS f1, support FROM c"""


@query(CONFUSION)
def classifier_report(spark, d):
    df = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").withColumn("p", (F.length("text") > 1000).cast("int"))
    return rounded(statistics.confusion(df, "quality", "p"), "precision", "recall", "f1", places=6)


@query("""SELECT round(avg(abs(o_totalprice - 1000 - o_custkey * 10)), 4) AS mae, round(1 - sum((o_totalprice - 1000 - o_custkey * 10) ^ 2) / (var_pop(o_totalprice) * count(*)), 6) AS r2, count(*) AS n FROM orders""")
def regression_report(spark, d):
    df = read(spark, d, "orders").withColumn("p", 1000 + F.col("o_custkey") * 10)
    return rounded(rounded(statistics.regression_metrics(df, "o_totalprice", "p"), "mae"), "r2", places=6)


@query("""SELECT CASE WHEN e < 10 THEN 'under 10' WHEN e < 20 THEN 'under 20' ELSE '20 and over' END AS band, count(*) AS n FROM (SELECT l_discount * 300 AS e FROM lineitem) GROUP BY 1""")
def error_bands(spark, d):
    return read(spark, d, "lineitem").groupBy(statistics.error_bands(F.col("l_discount") * 300).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN l_extendedprice NOT BETWEEN 5000 AND 300000 THEN 'price' WHEN l_returnflag = 'R' THEN 'returned' END AS drop_reason, count(*) AS n FROM lineitem GROUP BY 1""")
def drop_audit(spark, d):
    df = statistics.audit(read(spark, d, "lineitem"), [("price", F.col("l_extendedprice").between(5000, 300000)), ("returned", F.col("l_returnflag") != "R")])
    return df.groupBy("drop_reason").agg(F.count(F.lit(1)).alias("n"))


# --- rows


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def keep_first_dedupe(spark, d):
    # a digest, so that whole texts are not sorted
    df = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("text"))
    return rows.keep_first(df, ["text"], ["doc_id"]).select("doc_id")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')")
def anti_existing(spark, d):
    return rows.absent_from(read(spark, d, "customer").select("c_custkey"), read(spark, d, "orders").where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'"), "c_custkey", "o_custkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def semi_ids(spark, d):
    return rows.present_in(read(spark, d, "part").select("p_partkey", "p_name"), read(spark, d, "lineitem").where("l_quantity > 45"), "p_partkey", "l_partkey")


@query("SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A'")
def except_keys(spark, d):
    df = read(spark, d, "lineitem")
    return rows.absent_from(df.where("l_returnflag = 'R'").select("l_orderkey").distinct(), df.where("l_returnflag = 'A'"), "l_orderkey")


@query("""SELECT 'u' || p_partkey AS url, p_brand AS source, p_name AS name, coalesce(l_extendedprice, p_retailprice) AS price_yen, coalesce(l_extendedprice * 175, p_retailprice * 175) AS price_vnd, p_type AS condition, coalesce(l_shipdate, TIMESTAMP '1990-01-01') AS created_at
FROM part LEFT JOIN lineitem ON p_partkey = l_partkey WHERE p_name ILIKE '%Widget%'""")
def keyword_search(spark, d):
    return search.search(spark, *catalog(spark, d), "Widget")


def catalog(spark, d):
    items = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("u"), F.col("p_partkey")).alias("url"), F.col("p_brand").alias("source"), F.col("p_name").alias("name"), F.col("p_type").alias("condition"), F.col("p_retailprice").alias("price_yen"), (F.col("p_retailprice") * 175).alias("price_vnd"), F.lit("1990-01-01").cast("timestamp").alias("created_at"))
    prices = read(spark, d, "lineitem").select(F.col("l_partkey").alias("item_id"), F.col("l_extendedprice").alias("price_yen"), (F.col("l_extendedprice") * 175).alias("price_vnd"), F.col("l_shipdate").cast("timestamp").alias("record_time"))
    return items, prices


@query("""SELECT user_id, event_type, arg_max(value, ts) FILTER (value IS NOT NULL) AS value, arg_max(props, ts) FILTER (props IS NOT NULL) AS props FROM (SELECT user_id, event_type, ts, props, CASE WHEN value > 50 THEN value END AS value FROM events) WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL""")
def latest_per_group(spark, d):
    df = read(spark, d, "events").withColumn("value", F.when(F.col("value") > 50, F.col("value")))
    return rows.latest(df, ["user_id", "event_type"], "ts", ["value", "props"])


@query("""WITH old AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0), new AS (SELECT o_orderkey, 'X' AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(old.o_orderkey, new.o_orderkey) AS o_orderkey, coalesce(old.o_orderstatus, new.o_orderstatus) AS o_orderstatus, coalesce(new.o_totalprice, old.o_totalprice) AS o_totalprice FROM old FULL JOIN new ON old.o_orderkey = new.o_orderkey""")
def upsert_listings(spark, d):
    df = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = df.where("o_orderkey % 2 = 0").withColumns({"o_orderstatus": F.lit("X"), "o_totalprice": F.col("o_totalprice") + 1})
    return rows.upsert(df.where("o_orderkey % 3 <> 0"), new, "o_orderkey", ["o_totalprice"])


@query("""WITH t AS (SELECT p_name, p_brand FROM (SELECT p_name, p_brand, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part WHERE p_size < 10) WHERE k = 1)
SELECT * FROM t UNION ALL SELECT p_name, p_brand FROM (SELECT p_name, p_brand, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part WHERE p_size >= 10) WHERE k = 1 AND p_name NOT IN (SELECT p_name FROM t)""")
def insert_absent(spark, d):
    df = read(spark, d, "part")
    table = rows.keep_first(df.where("p_size < 10"), ["p_name"], ["p_partkey"]).select("p_name", "p_brand")
    return rows.insert_absent(table, df.where("p_size >= 10"), "p_name", ["p_partkey"])


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'loaded_mysql' WHEN o_orderpriority = '1-URGENT' THEN 'dropped_etl' ELSE 'new' END AS status, o_orderstatus = 'F' OR o_orderpriority = '1-URGENT' AS processed FROM orders""")
def status_machine(spark, d):
    df = read(spark, d, "orders").withColumns({"status": F.lit("new"), "processed": F.lit(False), "processed_at": F.lit(None).cast("timestamp")})
    return rows.transition(df, df.where("o_orderstatus = 'F'"), df.where("o_orderpriority = '1-URGENT'"), now(), "o_orderkey").select("o_orderkey", "status", "processed")


@query("SELECT CASE WHEN o_orderstatus IN ('F', 'O') THEN 'extracted_layer2' ELSE o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY 1")
def status_reset(spark, d):
    df = rows.reset_status(read(spark, d, "orders").withColumnRenamed("o_orderstatus", "status"), ("F", "O"))
    return df.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice + (o_orderkey % 2) END AS price_yen FROM orders WHERE o_orderkey % 2 = 1 OR o_orderkey % 5 = 0""")
def price_change_log(spark, d):
    old = read(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price_yen"))
    new = old.withColumn("price_yen", F.when(F.col("o_orderkey") % 5 != 0, F.col("price_yen") + F.col("o_orderkey") % 2))
    return rows.price_changes(old, new, "o_orderkey", ["price_yen"], now()).drop("record_time")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def cascade_delete(spark, d):
    child = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return rows.without_orphans(child, read(spark, d, "customer").where("c_acctbal > 0"), "c_custkey").select("o_orderkey")


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, NULL AS size FROM customer UNION ALL SELECT p_partkey, p_name, NULL, p_size FROM part")
def union_sources(spark, d):
    a = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return a.unionByName(read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size")), allowMissingColumns=True)


SHARE_SQL = "CAST('0x' || substr(md5(o_orderkey || '|42'), 1, 8) AS BIGINT) % 100"


@query(f"SELECT o_orderkey, CASE WHEN {SHARE_SQL} < 80 THEN 'train' ELSE 'test' END AS part FROM orders")
def train_test_split(spark, d):
    train, test = rows.split(read(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("""SELECT *, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY md5(concat_ws('|', quality, doc_id, 42)), doc_id) <= (count(*) OVER (PARTITION BY quality) * 80 + 50) // 100 THEN 'train' ELSE 'test' END AS part FROM labels""")
def stratified_split(spark, d):
    train, test = rows.stratified_split(read(spark, d, "labels"), "doc_id", "quality")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("SELECT p_partkey, p_name FROM part ORDER BY md5(p_partkey || '|42'), p_partkey LIMIT 10")
def sample_ten(spark, d):
    return rows.sample_rows(read(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", 10)


# --- scalars


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 6 WHEN 0 THEN NULL WHEN 1 THEN '¥' || CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) || ' YEN' WHEN 2 THEN CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) || ',000円 + 500円' WHEN 3 THEN 'free' WHEN 4 THEN '0円' ELSE CAST(l_partkey AS VARCHAR) || ' 000 000' END AS s FROM lineitem),
u AS (SELECT *, regexp_replace(s, '[^0-9]', '', 'g') AS d FROM t), v AS (SELECT *, CASE WHEN d <> '' THEN CAST(d AS DOUBLE) END AS x, CAST(TRY_CAST(d AS HUGEINT) AS VARCHAR) AS e FROM u)
SELECT l_orderkey, l_linenumber, nullif(CASE WHEN x > 3000000 AND length(e) > 6 THEN CAST(substring(e, 1, 6) AS DOUBLE) ELSE x END, 0) AS price, coalesce(TRY_CAST(d AS BIGINT), 0) AS plain FROM v""")
def clean_prices(spark, d):
    n, k = F.floor("l_extendedprice").cast("string"), F.col("l_linenumber") % 6
    s = F.when(k == 0, None).when(k == 1, F.concat(F.lit("¥"), n, F.lit(" YEN"))).when(k == 2, F.concat(n, F.lit(",000円 + 500円"))).when(k == 3, "free").when(k == 4, "0円").otherwise(F.concat(F.col("l_partkey").cast("string"), F.lit(" 000 000")))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalars.clean_price(s).alias("price"), scalars.digits_or_zero(s).alias("plain"))


@query("""SELECT page_id, CASE WHEN u LIKE '%mercari%' THEN 'Mercari' WHEN u LIKE '%rakuma%' OR u LIKE '%rakuten%' THEN 'Rakuma' WHEN u LIKE '%yahoo%' OR u LIKE '%jdirectitems%' THEN 'YahooAuction' END AS platform, 'https://shop.example/x/' || page_id AS link,
CASE WHEN page_id % 2 = 0 THEN 'https://shop.example/rakuma/item/description/' || page_id END AS description_link FROM (SELECT page_id, lower(url || ['/Mercari', '/rakuten', '/JDirectItems', ''][page_id % 4 + 1]) AS u FROM pages)""")
def platforms(spark, d):
    k = F.col("page_id")
    tail = F.element_at(F.array(F.lit("/Mercari"), F.lit("/rakuten"), F.lit("/JDirectItems"), F.lit("")), (k % 4 + 1).cast("int"))
    item = F.when(k % 2 == 0, F.concat(F.lit("https://shop.example/rakuma/item/"), k, F.lit("?a=1"))).otherwise("https://shop.example/other")
    base = "https://shop.example"
    return read(spark, d, "pages").select("page_id", scalars.platform(F.concat("url", tail)).alias("platform"), scalars.normalize_link(F.concat(F.lit("/x/"), k, F.lit("/undefined")), base).alias("link"), scalars.description_link(item, base).alias("description_link"))


@query("""SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY event_type""")
def json_props(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k"), F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END AS b, CASE WHEN p_size % 2 = 0 THEN p_size || 'GB' END AS cap, CASE WHEN p_size % 5 = 0 THEN (p_size + 1) || 'TB' END AS sto, p_name FROM part)
SELECT p_partkey, CASE WHEN length(n) < 5 THEN substring(p_name, 1, 100) ELSE n END AS standard_name, '{"storage":' || coalesce('"' || replace(coalesce(sto, cap), 'GB', '') || '"', 'null') || ',"ram":' || coalesce('"' || replace(cap, 'GB', '') || '"', 'null') || '}' AS base_specs
FROM (SELECT *, concat_ws(' ', b, coalesce(cap, sto)) AS n FROM t)""")
def standard_names(spark, d):
    k = F.col("p_size")
    brand, cap, sto, none = F.when(k % 3 != 0, F.col("p_brand")), F.when(k % 2 == 0, F.concat(k, F.lit("GB"))), F.when(k % 5 == 0, F.concat(k + 1, F.lit("TB"))), F.lit(None).cast("string")
    return read(spark, d, "part").select("p_partkey", scalars.standard_name(brand, F.lit(""), none, none, cap, sto, F.col("p_name")).alias("standard_name"), scalars.base_specs(sto, cap, cap).alias("base_specs"))


JUNK_SQL = """SELECT p_partkey, CASE WHEN n IS NULL OR trim(n) = '' THEN 1 WHEN p > 0 AND p < 3000 THEN 1 WHEN regexp_matches(lower(n), '(ケース|カバー)') AND NOT regexp_matches(lower(n), '(本体|gb|セット)') THEN 1 ELSE 0 END AS junk
FROM (SELECT p_partkey, CAST(p_retailprice AS BIGINT) * 4 AS p, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN p_name || ' ケース' WHEN 2 THEN p_name || ' カバー 64GB' ELSE p_name END AS n FROM part)"""


@query(JUNK_SQL)
def junk_heuristic(spark, d):
    k = F.col("p_size") % 5
    name = F.when(k == 0, None).when(k == 1, F.concat("p_name", F.lit(" ケース"))).when(k == 2, F.concat("p_name", F.lit(" カバー 64GB"))).otherwise(F.col("p_name"))
    price = F.concat((F.round(F.col("p_retailprice").cast("decimal(18,2)")).cast("bigint") * 4).cast("string"), F.lit(" YEN"))
    return read(spark, d, "part").select("p_partkey", scalars.junk_heuristic(name, price, F.lit("")).alias("junk"))


# --- extraction

TITLE = "['iPhone', 'Galaxy S', 'Pixel ', 'Redmi Note ', 'AQUOS sense'][p_size % 5 + 1] || (p_size % 20 + 1) || ' ' || CASE WHEN p_size % 3 = 0 THEN '' ELSE (p_size % 8 + 2) || 'GB/' END || (p_size * 16) || 'GB ' || ['Black', 'Sierra Blue', 'plain', 'Rose Gold'][p_size % 4 + 1]"


def titles(spark, d):
    k = F.col("p_size")
    pick = lambda *v: F.element_at(F.array(*(F.lit(x) for x in v)), (k % len(v) + 1).cast("int"))
    title = F.concat(pick("iPhone", "Galaxy S", "Pixel ", "Redmi Note ", "AQUOS sense"), k % 20 + 1, F.lit(" "), F.when(k % 3 == 0, "").otherwise(F.concat(k % 8 + 2, F.lit("GB/"))), k * 16, F.lit("GB "), pick("Black", "Sierra Blue", "plain", "Rose Gold"))
    return read(spark, d, "part").select("p_partkey", title.alias("name"))


@query(f"""SELECT p_partkey, ['iPhone', 'Galaxy', 'Pixel', 'Redmi', 'AQUOS'][p_size % 5 + 1] AS model_line, ['', 'S', '', 'Note ', 'sense'][p_size % 5 + 1] || (p_size % 20 + 1) AS model_number, ['Apple', 'Samsung', 'Google', 'Xiaomi', 'SHARP'][p_size % 5 + 1] AS brand, ['Black', 'Blue', NULL, 'Gold'][p_size % 4 + 1] AS color,
CASE WHEN p_size % 3 = 0 THEN p_size * 16 WHEN p_size * 16 >= 32 THEN p_size * 16 ELSE greatest(p_size * 16, p_size % 8 + 2) END || 'GB' AS capacity,
CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_size * 16 <= 24 THEN (p_size * 16) || 'GB' END ELSE least(p_size % 8 + 2, CASE WHEN p_size * 16 <= 24 THEN p_size * 16 ELSE 99 END) || 'GB' END AS ram FROM (SELECT p_partkey, p_size, {TITLE} AS name FROM part)""")
def title_features(spark, d):
    return extract.title_features(titles(spark, d)).select("p_partkey", "model_line", "model_number", "brand", "color", "capacity", "ram")


#: Words amid edges of every kind: Japanese neighbours, nested and colliding aliases, words inside words.
TAGGED = (*(w for words in (config.BRANDS, config.VARIANTS, config.COLORS) for own in words.values() for w in own), "plain", "x黒", "iPhoneケース", "Promax", "Pro Maxi", "金色", "Rose Golden", "ProMax", "黒い")
EDGES = (" ", "", "黒", "/", "_", "い", "  ", "1", "-", "の", "・", "Pro ")


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def walked_sql(words: dict[str, tuple[str, ...]]) -> str:
    known = extract.aliases(words, True)
    longest = "|".join(re.sub(r"([.+*?()])", r"\\\1", w) for w in sorted(known, key=lambda w: -len(w)))
    steps = f"regexp_extract_all(lower(title), '({longest})(?:[^a-z0-9_]|$)|[a-z0-9_]+(?:[^a-z0-9_]|$)|[^a-z0-9_]', 1)"
    return f"list_transform(list_filter({steps}, lambda x: x <> ''), lambda x: MAP({sql_list(known)}, {sql_list(known.values())})[x])"


@query(f"""WITH t AS (SELECT l_orderkey, l_linenumber, w[l_partkey % {len(TAGGED)} + 1] || e[l_orderkey % {len(EDGES)} + 1] || w[l_suppkey % {len(TAGGED)} + 1] || e[(l_orderkey + l_linenumber) % {len(EDGES)} + 1] || w[l_orderkey % {len(TAGGED)} + 1] AS title
FROM lineitem, (SELECT {sql_list(TAGGED)} AS w, {sql_list(EDGES)} AS e)), f AS (SELECT *, {walked_sql(config.BRANDS)} AS b, {walked_sql(config.VARIANTS)} AS v, {walked_sql(config.COLORS)} AS c FROM t),
j AS (SELECT *, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), ' ') AS one FROM f)
SELECT l_orderkey, l_linenumber, title, array_to_string(b, '/') AS brands, array_to_string(v, '/') AS variants, array_to_string(c, '/') AS colors,
CASE WHEN len(v) = 0 THEN NULL WHEN contains(one, 'Pro Max') THEN regexp_replace(trim(replace(replace(one, 'Pro Max', ''), 'Pro', 'Pro Max')), '\\s+', ' ', 'g') ELSE one END AS variant FROM j""")
def title_tags(spark, d):
    word = lambda i: F.element_at(F.array(*(F.lit(x) for x in TAGGED)), (i % len(TAGGED) + 1).cast("int"))
    edge = lambda i: F.element_at(F.array(*(F.lit(x) for x in EDGES)), (i % len(EDGES) + 1).cast("int"))
    order = F.col("l_orderkey")
    title = F.concat(word(F.col("l_partkey")), edge(order), word(F.col("l_suppkey")), edge(order + F.col("l_linenumber")), word(order))
    made = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", title.alias("title"))
    found = made.withColumns({n: extract.walked(F.col("title"), words) for n, words in (("b", config.BRANDS), ("v", config.VARIANTS), ("c", config.COLORS))})
    joined = [F.array_join(x, "/").alias(n) for x, n in (("b", "brands"), ("v", "variants"), ("c", "colors"))]
    return found.select("l_orderkey", "l_linenumber", "title", *joined, extract.variant(F.col("v")).alias("variant"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size + 50 END AS battery_percentage, p_size % 3 <> 0 AS has_box, p_size % 4 = 0 AS has_scratches, CASE WHEN p_size % 4 = 0 THEN 'scratched' ELSE 'clean' END AS screen_condition, p_size % 5 = 0 AS is_sim_free, CASE WHEN p_size % 7 = 0 THEN 'restricted' ELSE 'none' END AS network_restriction FROM part""")
def description_features(spark, d):
    k = F.col("p_size")
    text = F.concat(
        F.when(k % 2 == 0, F.concat(F.lit("バッテリー最大容量 "), k + 50, F.lit("％ "))).otherwise(""), F.when(k % 3 == 0, "箱はなし、そのほか色々そろっています。").otherwise("元箱あり。そのほか色々そろっていますので。"), F.when(k % 4 == 0, "画面に傷が少々あり、使用には問題がございません。").otherwise("傷なし。"),
        F.when(k % 5 == 0, "SIMフリー ").otherwise(""), F.when(k % 7 == 0, "利用制限×").otherwise("利用制限○"),
    )
    df = extract.description_features(read(spark, d, "part").select("p_partkey", "p_size", text.alias("explanation")))
    return df.select("p_partkey", "battery_percentage", "has_box", "has_scratches", "screen_condition", "is_sim_free", "network_restriction")


@query()
def listing_parse(spark, d):
    """Pages of no marketplace: no card, no condition, and their visible text."""
    df = read(spark, d, "pages")
    return df.select("page_id", html.detail(F.col("html"), "mercari").alias("found"), F.size(html.listing_cards(F.col("html"), "mercari", "https://shop.example")).alias("cards")).select("page_id", "found.description", "found.condition", "cards")


#: A page of each marketplace for a part: cards that are read, cards that are not, and a detail.
PAGES = {
    "mercari": """<body><script>no</script><ul><li class="list"><a href="/i/{p_partkey}/undefined"><h2 class="name"> {p_name} </h2><p class="price">{p_size},000 YEN</p></a></li><li class="list x"><h2 class="name">{p_brand}</h2></li><li class="other"><h2 class="name">no</h2></li></ul>
<dl class="m-goodsTable"><dt>Size</dt><dd>L</dd><dt>Item condition</dt><dd> {p_type} </dd></dl><p class="m-itemDetail__content">one<br>{p_name}</p></body>""",
    "rakuma": """<body><ul class="item-lists"><li class="list"><a href="https://h.example/{p_partkey}"><h2 class="name">{p_name}</h2><p class="price">{p_size} YEN</p></a><ul><li class="list">no</li></ul></li></ul>
<dl class="attrContainer__detail"><dd><a href="/s?condition=1">{p_type}</a></dd></dl><div class="itemDetail__content">{p_name}<span> &amp; two </span></div></body>""",
    "yahooauction": """<body><li class="itemCard"><a href="/a"></a><div class="itemCard__itemName">no price yet</div><div class="g-priceDetails"><li class="g-priceDetails__item"><span class="g-title">Current Price</span><span class="g-price">1</span></li></div></li>
<li class="itemCard"><a href="/b/{p_partkey}"></a><div class="itemCard__itemName">{p_name}</div><div class="g-priceDetails"><li class="g-priceDetails__item"><span class="g-title">現在価格</span><span class="g-price">2</span></li><li class="g-priceDetails__item"><span class="g-title">Buyout Price</span><span class="g-price">{p_size}</span></li></div></li>
<li class="itemCard"><a href="/c/{p_partkey}"></a><div class="itemCard__itemName">{p_brand}</div><div class="itemCard__fleamarket"></div><div class="g-priceDetails"><li class="g-priceDetails__item"><span class="g-title">Current Price</span><span class="g-price">3</span></li></div></li>
<li class="itemDetail__list"><div class="itemDetail__listName">Bidder condition</div><div class="itemDetail__listValue">no</div></li><li class="itemDetail__list"><div class="itemDetail__listName">Item  Condition<span class="tooltip-auc">bidder</span></div><div class="itemDetail__listValue">{p_type}</div></li>
<p class="m-itemDetail__content">{p_name}</p></body>""",
}


@query("""SELECT p_partkey, 'mercari' AS kind, 0 AS position, 'https://shop.example/i/' || p_partkey AS link, p_name AS name, p_size || ',000 YEN' AS price, NULL AS price_type, NULL AS listing_type, p_type AS condition, 'one' || chr(10) || p_name AS description FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, 'mercari', 1, NULL, p_brand, NULL, NULL, NULL, p_type, 'one' || chr(10) || p_name FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, 'rakuma', 0, 'https://h.example/' || p_partkey, p_name, p_size || ' YEN', NULL, NULL, p_type, p_name || chr(10) || '& two' FROM part WHERE p_partkey % 3 = 1
UNION ALL SELECT p_partkey, 'yahooauction', 0, 'https://shop.example/b/' || p_partkey, p_name, CAST(p_size AS VARCHAR), 'buyout', 'auction', p_type, p_name FROM part WHERE p_partkey % 3 = 2
UNION ALL SELECT p_partkey, 'yahooauction', 1, 'https://shop.example/c/' || p_partkey, p_brand, '3', 'fixed', 'fleamarket', p_type, p_name FROM part WHERE p_partkey % 3 = 2""")
def marketplace_pages(spark, d):
    """Cards and details of a page of each part, a third of them from each marketplace."""
    def parsed(k: int, kind: str) -> DataFrame:
        page = F.lit(PAGES[kind])
        for name in ("p_partkey", "p_name", "p_brand", "p_type", "p_size"):
            page = F.replace(page, F.lit(f"{{{name}}}"), F.col(name).cast("string"))
        # parts take a few row groups, their pages much time
        df = rows.spread(read(spark, d, "part").where(F.col("p_partkey") % 3 == k)).select("p_partkey", page.alias("html"))
        df = df.select("p_partkey", html.detail(F.col("html"), kind).alias("found"), html.listing_cards(F.col("html"), kind, "https://shop.example").alias("cards"))
        return df.select("p_partkey", F.lit(kind).alias("kind"), "found", F.posexplode_outer("cards").alias("position", "card")).where("position is not null").select("p_partkey", "kind", "position", "card.*", "found.*")

    return reduce(DataFrame.unionByName, (parsed(k, kind) for k, kind in enumerate(html.KINDS)))


# --- features and models

PHONES = """SELECT l_orderkey, l_linenumber, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT)) AS item, ['Good', 'A', 'C', 'odd'][l_linenumber % 4 + 1] AS condition, 60 + l_quantity * 0.75 AS battery, ['clean', 'scratched', 'cracked'][CAST(l_quantity AS INT) % 3 + 1] AS screen, l_linenumber % 2 = 0 AS box, l_linenumber % 3 = 0 AS charger, ['64GB', '128GB', '1TB', '512GB'][CAST(l_quantity AS INT) % 4 + 1] AS storage FROM lineitem"""
SCORES = f"""SELECT *, CASE condition WHEN 'A' THEN 85 WHEN 'C' THEN 50 ELSE 70 END AS cs, CASE WHEN battery < 80 THEN (80 - battery) * 0.5 ELSE 0 END AS bp, CASE screen WHEN 'scratched' THEN -5 WHEN 'cracked' THEN -20 ELSE 0 END AS sp,
CASE WHEN box THEN 3 ELSE 0 END + CASE WHEN charger THEN 2 ELSE 0 END + CASE WHEN box AND charger THEN 5 ELSE 0 END AS bonus, CAST(regexp_extract(storage, '[0-9]+') AS DOUBLE) AS gb FROM ({PHONES})"""


def phones(spark, d, *more):
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    pick = lambda i, *v: F.element_at(F.array(*(F.lit(x) for x in v)), (i % len(v) + 1).cast("int"))
    return read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", *more, F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", q).alias("item"), pick(n, "Good", "A", "C", "odd").alias("condition"), (60 + F.col("l_quantity") * 0.75).alias("battery_percentage"), pick(q, "clean", "scratched", "cracked").alias("screen_condition"),
        (n % 2 == 0).alias("has_box"), (n % 3 == 0).alias("has_charger"), pick(q, "64GB", "128GB", "1TB", "512GB").alias("storage"),
    )


@query(f"""SELECT l_orderkey, l_linenumber, CAST(cs AS DOUBLE) AS condition_score, round(greatest(least(cs - bp, 100), 0), 6) AS battery_score, CAST(greatest(cs + sp, 0) AS DOUBLE) AS screen_score, CAST(bonus AS DOUBLE) AS accessories_bonus,
round(least(greatest(greatest(least(cs - bp, 100), 0) * 0.4 + greatest(cs + sp, 0) * 0.3 + greatest(cs - 2, 0) * 0.2 + cs * 0.1 + bonus, 0), 110), 6) AS quality_score, CASE WHEN gb <= 64 THEN 1 WHEN gb <= 256 THEN 2 ELSE 3 END AS storage_tier,
round(greatest(least(cs - bp, 100), 0) * ln(1 + gb), 6) AS battery_storage, CASE WHEN sp < -15 THEN 2 ELSE 0 END AS damage_severity, 30 AS functionality_score, CAST(cs * 6 AS DOUBLE) AS age_condition_interaction FROM ({SCORES})""")
def price_features(spark, d):
    df = features.engineer(phones(spark, d))
    return rounded(df, "battery_score", "quality_score", "battery_storage", places=6).select(
        "l_orderkey", "l_linenumber", "condition_score", "battery_score", "screen_score", "accessories_bonus", "quality_score", "storage_tier", "battery_storage", "damage_severity", "functionality_score", "age_condition_interaction"
    )


def linear(df: DataFrame) -> DataFrame:
    """A scorer that SQL can follow."""
    return df.withColumn("prediction", 10000 + F.col("quality_score") * 100 - F.col("device_age_years") * 500 + F.col("release_year") + F.col("age_condition_interaction"))


QUALITY = "least(greatest(greatest(least(cs - bp, 100), 0) * 0.4 + greatest(cs + sp, 0) * 0.3 + greatest(cs - 2, 0) * 0.2 + cs * 0.1 + bonus, 0), 110)"


@query(f"""SELECT l_orderkey, l_linenumber, age / 2.0 AS device_age_years, round(10000 + {QUALITY} * 100 - age / 2.0 * 500 + (2026 - round_even(age / 2.0, 0)) + age / 2.0 * cs, 4) AS price_yen FROM ({SCORES}), (SELECT unnest(range(0, 9)) AS age)""")
def depreciation_grid(spark, d):
    df = models.depreciation(phones(spark, d), features.engineer, linear, low=0, high=4, step=0.5)
    return rounded(df, "price_yen").select("l_orderkey", "l_linenumber", "device_age_years", "price_yen")


@dataclass
class Shifted:
    """A model that SQL can follow: the scorer and a sum."""

    by: int

    def predict(self, df: DataFrame) -> DataFrame:
        return linear(features.engineer(df)).withColumn("prediction", F.col("prediction") + self.by)


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'Apple' ELSE 'Android' END AS ecosystem, round(10000 + {QUALITY} * 100 - 6 * 500 + 2020 + 6 * cs + CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE 1000 END, 4) AS price_yen FROM ({SCORES})""")
def ensemble_routes(spark, d):
    """Apple's devices by one model, others and those without a brand by the other."""
    brand = F.element_at(F.array(F.lit(" apple "), F.lit("Sony"), F.lit(None).cast("string")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    found = models.Ensemble(Shifted(0), Shifted(1000)).predict(phones(spark, d).withColumn("brand", brand)).withColumns({"ecosystem": scalars.ecosystem(F.col("brand")), "price_yen": F.col("prediction")})
    return rounded(found, "price_yen").select("l_orderkey", "l_linenumber", "ecosystem", "price_yen")


DUE = """WITH l AS (SELECT l_partkey, 50 + l_quantity AS battery, ['A', 'C'][l_linenumber % 2 + 1] AS condition, l_linenumber % 3 = 0 AS box FROM lineitem WHERE l_partkey % 7 <> 0),
b AS (SELECT l_partkey, avg(battery) AS battery FROM l GROUP BY ALL), c AS (SELECT l_partkey, condition FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, condition) AS k FROM (SELECT l_partkey, condition, count(*) AS n FROM l GROUP BY ALL)) WHERE k = 1),
x AS (SELECT l_partkey, box FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, box) AS k FROM (SELECT l_partkey, box, count(*) AS n FROM l GROUP BY ALL)) WHERE k = 1),
s AS (SELECT p_partkey, CASE condition WHEN 'A' THEN 85 WHEN 'C' THEN 50 ELSE 70 END AS cs, greatest(80 - coalesce(battery, 80), 0) * 0.5 AS bp, 0 AS sp, CASE WHEN box THEN 3 ELSE 0 END AS bonus
FROM part LEFT JOIN b ON b.l_partkey = p_partkey LEFT JOIN c ON c.l_partkey = p_partkey LEFT JOIN x ON x.l_partkey = p_partkey WHERE p_partkey % 5 <> 0) """


@query(DUE + f"""SELECT 'p' || p_partkey AS product_id, round(round((10000 + {QUALITY} * 100 - 6 * 500 + 2020 + 6 * cs) * 175, 2), 0) AS predicted_price, 87.5 :: DOUBLE AS confidence_score, 'smart_v1_r2_0.875' AS model_version FROM s""")
def forecast_due(spark, d):
    """Forecasts of products without one today, by what their listings are like; products of no listing by the defaults."""
    part, line = read(spark, d, "part"), read(spark, d, "lineitem").where("l_partkey % 7 <> 0")
    product = lambda c: F.concat(F.lit("p"), c.cast("string"))
    products = part.select(product(F.col("p_partkey")).alias("product_id"), F.lit('{"storage":"64","ram":"4"}').alias("base_specs"), F.lit("M").alias("model_series"))
    condition = F.when(F.col("l_linenumber") % 2 == 0, "A").otherwise("C")
    listings = line.select(product(F.col("l_partkey")).alias("product_id"), (50 + F.col("l_quantity")).alias("battery_percentage"), condition.alias("condition_rank"), (F.col("l_linenumber") % 3 == 0).alias("has_box"))
    day = F.when(F.col("p_partkey") % 5 == 0, today()).otherwise(F.date_sub(today(), 1))
    known = part.where("p_partkey % 5 < 2").select(product(F.col("p_partkey")).alias("product_id"), day.alias("forecast_date"))
    found = models.forecast(ensure_columns(products, PRODUCTS), ensure_columns(listings, LISTINGS), ensure_columns(known, FORECASTS), lambda x: linear(features.engineer(x)), 0.875, today(), now())
    return rounded(found.withColumn("confidence_score", F.col("confidence_score").cast("double")), "predicted_price", places=0).select("product_id", "predicted_price", "confidence_score", "model_version")


def _impact_sql() -> str:
    q = lambda bp="bp", sp="sp", bonus="bonus": QUALITY.replace("bp", bp).replace("sp", sp).replace("+ bonus", f"+ {bonus}")
    cases = (("battery_to_100", "battery < 99.5", q(bp="0")), ("has_box_true", "NOT box", q(bonus="(3 + CASE WHEN charger THEN 7 ELSE 0 END)")), ("has_charger_true", "NOT charger", q(bonus="(2 + CASE WHEN box THEN 8 ELSE 0 END)")), ("screen_clean", "screen <> 'clean'", q(sp="0")))
    return " UNION ALL ".join(f"SELECT item, '{n}' AS scenario, round({x} * 100 - {q()} * 100, 2) AS delta_yen FROM ({SCORES}) WHERE {w}" for n, w, x in cases)


@query(_impact_sql())
def counterfactual(spark, d):
    df = models.baseline(phones(spark, d)).withColumn("model_line", F.lit(""))
    return rounded(models.impact(df, "item", lambda x: linear(features.engineer(x))), "delta_yen", places=2).select("item", "scenario", "delta_yen")


def raw_items(spark, d):
    """Listings made of parts and their lines."""
    line, part = read(spark, d, "lineitem"), read(spark, d, "part")
    df = line.join(part, line.l_partkey == part.p_partkey)
    df = df.select(
        F.concat(F.lit("https://x.example/"), F.element_at(F.array(F.lit("mercari"), F.lit("rakuma"), F.lit("none")), (F.col("l_linenumber") % 3 + 1).cast("int")), F.lit("/"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).alias("link"),
        F.col("p_name").alias("name"), F.concat(F.floor("l_extendedprice").cast("string"), F.lit(" YEN")).alias("price"), F.col("p_brand").alias("brand"), F.concat(F.lit("M"), F.col("p_size")).alias("model_line"),
        F.concat(F.lit(64), F.lit("GB")).alias("capacity"), (F.col("l_returnflag") == "R").alias("is_junk"), F.lit("extracted_layer2").alias("status"), F.lit(False).alias("processed"), now().alias("ingested_at"),
    )
    return ensure_columns(df, RAW_ITEMS)


def loaded(spark, d) -> etl.Tables:
    empty = lambda s: spark.createDataFrame([], s)
    return etl.load(raw_items(spark, d), empty(PRODUCTS), empty(LISTINGS), empty(PRICE_HISTORY), now(), today())


LOADED = """WITH t AS (SELECT p_brand || ' M' || p_size || ' 64GB' AS name, floor(l_extendedprice) AS yen, p_brand, p_size, l_linenumber, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey), k AS (SELECT * FROM t WHERE l_returnflag <> 'R' AND l_linenumber % 3 <> 2 AND yen BETWEEN 5000 AND 300000) """


@query(LOADED + """SELECT substring(sha256(name), 1, 36) AS product_id, round(avg(yen * 175), 2) AS avg_price, round(avg(yen), 2) AS original_price, CAST(min(yen * 175) AS DOUBLE) AS min_price, CAST(max(yen * 175) AS DOUBLE) AS max_price, count(*) AS listing_count FROM k GROUP BY name""")
def etl_price_history(spark, d):
    return rounded(loaded(spark, d).history, "avg_price", "original_price", "min_price", "max_price", places=2).drop("record_date")


@query(LOADED + """SELECT DISTINCT name, p_brand AS brand, 'M' || p_size AS model_series FROM k""")
def etl_products(spark, d):
    return loaded(spark, d).products.select("name", "brand", "model_series")


@query(LOADED + """SELECT CASE WHEN l_linenumber % 3 = 2 THEN 'platform' WHEN yen NOT BETWEEN 5000 AND 300000 THEN 'price' END AS drop_reason, count(*) AS n FROM t WHERE l_returnflag <> 'R' GROUP BY 1""")
def etl_audit(spark, d):
    return loaded(spark, d).audit


@query(LOADED + """SELECT CASE WHEN l_returnflag = 'R' THEN 'extracted_layer2' WHEN l_linenumber % 3 <> 2 AND yen BETWEEN 5000 AND 300000 THEN 'loaded_mysql' ELSE 'dropped_etl' END AS status, count(*) AS n FROM t GROUP BY 1""")
def etl_status(spark, d):
    return loaded(spark, d).raw.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(LOADED + """SELECT substring(sha256(name), 1, 36) AS product_id, 70.0 * 100 AS p FROM k GROUP BY name""".replace("70.0 * 100 AS p", "CAST((10000 + least(70 * 0.4 + 70 * 0.3 + 68 * 0.2 + 70 * 0.1, 110) * 100 - 6 * 500 + 2020 + 6 * 70) * 175 AS DOUBLE) AS predicted_price, CAST(50 AS DOUBLE) AS confidence_score"))
def etl_forecast(spark, d):
    t = loaded(spark, d)
    df = models.forecast(t.products, t.listings, spark.createDataFrame([], FORECASTS), lambda x: linear(features.engineer(x)), None, today(), now())
    return df.select("product_id", F.col("predicted_price").cast("double").alias("predicted_price"), F.col("confidence_score").cast("double").alias("confidence_score"))


def reloaded(spark, d) -> etl.Tables:
    """A load over tables that hold something: every other product by an id of its own, the links of every fourth line, and today's history of these products."""
    raw = raw_items(spark, d)
    old = read(spark, d, "part").where("p_size % 2 = 0").select(F.concat("p_brand", F.lit(" M"), "p_size", F.lit(" 64GB")).alias("name"), F.col("p_brand").alias("brand"), F.concat(F.lit("M"), "p_size").alias("model_series")).distinct().withColumn("product_id", F.concat(F.lit("old-"), "name"))
    listed = raw.where("cast(split(element_at(split(link, '/'), -1), '-')[1] as int) % 4 = 0").select(F.col("link").alias("source_url"), F.lit("known").alias("product_id"), F.lit(1).alias("price"), F.lit(2).alias("original_price"))
    history = old.select("product_id", today().alias("record_date"), F.lit(1000000).alias("avg_price"), F.lit(7).alias("original_price"), F.lit(500000).alias("min_price"), F.lit(2000000).alias("max_price"), F.lit(2).alias("listing_count"))
    return etl.load(raw, ensure_columns(old, PRODUCTS), ensure_columns(listed, LISTINGS), ensure_columns(history, PRICE_HISTORY), now(), today())


RELOADED = LOADED + """, n AS (SELECT *, CASE WHEN p_size % 2 = 0 THEN 'old-' || name ELSE substring(sha256(name), 1, 36) END AS product_id FROM k WHERE l_linenumber % 4 <> 0),
o AS (SELECT DISTINCT p_brand || ' M' || p_size || ' 64GB' AS name, p_brand, p_size FROM part WHERE p_size % 2 = 0) """


@query(RELOADED + """, h AS (SELECT product_id, sum(yen * 175) AS s, avg(yen) AS y, min(yen * 175) AS low, max(yen * 175) AS high, count(*) AS c FROM n GROUP BY product_id)
SELECT coalesce(h.product_id, 'old-' || o.name) AS product_id, round((coalesce(s, 0) + CASE WHEN o.name IS NULL THEN 0 ELSE 2000000 END) / (coalesce(c, 0) + CASE WHEN o.name IS NULL THEN 0 ELSE 2 END), 2) AS avg_price, round(coalesce(y, 7), 2) AS original_price,
CAST(least(low, CASE WHEN o.name IS NOT NULL THEN 500000 END) AS DOUBLE) AS min_price, CAST(greatest(high, CASE WHEN o.name IS NOT NULL THEN 2000000 END) AS DOUBLE) AS max_price, CAST(coalesce(c, 0) + CASE WHEN o.name IS NULL THEN 0 ELSE 2 END AS BIGINT) AS listing_count
FROM h FULL JOIN o ON h.product_id = 'old-' || o.name""")
def etl_again_history(spark, d):
    return rounded(reloaded(spark, d).history, "avg_price", "original_price", "min_price", "max_price", places=2).withColumn("listing_count", F.col("listing_count").cast("bigint")).drop("record_date")


@query(RELOADED + """SELECT 'old-' || name AS product_id, name FROM o UNION SELECT product_id, name FROM n""")
def etl_again_products(spark, d):
    return reloaded(spark, d).products.select("product_id", "name")


@query(RELOADED + """SELECT 'known' AS product_id, count(*) AS n, CAST(count(*) AS DOUBLE) AS price, CAST(2 * count(*) AS DOUBLE) AS original_price FROM t WHERE l_linenumber % 4 = 0 UNION ALL SELECT product_id, count(*), CAST(sum(yen * 175) AS DOUBLE), CAST(sum(yen) AS DOUBLE) FROM n GROUP BY product_id""")
def etl_again_listings(spark, d):
    return reloaded(spark, d).listings.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"), F.sum("price").cast("double").alias("price"), F.sum("original_price").cast("double").alias("original_price"))


@query(LOADED + """SELECT CASE WHEN l_returnflag = 'R' THEN 'extracted_layer2' WHEN l_linenumber % 4 <> 0 AND l_linenumber % 3 <> 2 AND yen BETWEEN 5000 AND 300000 THEN 'loaded_mysql' ELSE 'dropped_etl' END AS status, count(*) AS n FROM t GROUP BY 1""")
def etl_again_status(spark, d):
    return reloaded(spark, d).raw.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, CAST(2026 - CASE l_partkey % 4 WHEN 0 THEN 2020 WHEN 1 THEN 2021 WHEN 2 THEN 2023 ELSE 2020 END AS DOUBLE) AS device_age_years FROM lineitem""")
def release_years(spark, d):
    """Ages by a dictionary of release years: the first model in its order that the name holds, the default without one."""
    years = {"iPhone 13": 2021, "Galaxy S23": 2023, "iPhone 12": 2020}
    k = (F.col("l_partkey") % 4).cast("int")
    line = F.element_at(F.array(F.lit("iphone"), F.lit("iPhone"), F.lit("Galaxy"), F.lit("Pixel")), k + 1)
    number = F.element_at(F.array(F.lit("12 Pro"), F.lit("13 mini"), F.lit("S23"), F.lit("8a")), k + 1)
    df = phones(spark, d, "l_partkey")
    return features.engineer(df.withColumns({"model_line": line, "model_number": number, "variant": F.lit("")}), years).select("l_orderkey", "l_linenumber", "l_partkey", "device_age_years")


@query()
def junk_model(spark, d):
    df = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select("doc_id", F.col("text").alias("name"), F.lit(None).cast("string").alias("explanation"), F.col("n_chars").cast("string").alias("price"), (1 - F.col("quality")).alias("is_junk"))
    # n-grams of texts in few row groups
    df = rows.spread(df)
    model = models.train_junk(df.withColumn("name", F.regexp_replace("name", r"\s+", " ")))
    return model.predict(df).select("doc_id", "junk_probability", F.col("is_junk"))


@query()
def price_model(spark, d):
    df = phones(spark, d).withColumns({"price": F.col("battery_percentage") * 100 + F.length("storage") * 1000.0, "key": F.concat_ws("-", "l_orderkey", "l_linenumber"), "model_line": F.lit("M"), "model_number": F.col("storage"), "variant": F.lit("")})
    _, errors = models.train_price(df, {}, "key")
    return errors


@query("SELECT 'remarkt_part' AS table_name, count(*) AS n FROM part UNION ALL SELECT 'remarkt_orders', count(*) FROM orders")
def table_counts(spark, d):
    for name in ("part", "orders"):
        read(spark, d, name).createOrReplaceTempView(f"remarkt_{name}")
    return tables.table_counts(spark, ["remarkt_part", "remarkt_orders"])


@query("""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS a, CASE WHEN o_orderpriority = '1-URGENT' THEN 'u' END AS b FROM orders)
SELECT o_orderkey, a, coalesce(b, 'Unknown') AS b FROM t WHERE a IS NOT NULL OR (SELECT avg(CASE WHEN a IS NULL THEN 1.0 ELSE 0.0 END) FROM t) > 0.5""")
def conditional_fill(spark, d):
    df = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("a"), F.when(F.col("o_orderpriority") == "1-URGENT", "u").alias("b"))
    # b is filled where most are null; rows without a go where few are
    filled = statistics.fill_or_drop(df, "a", "Unknown")
    return filled.withColumn("b", F.coalesce("b", F.lit("Unknown")))


@query("""SELECT count(*) AS n, count(*) FILTER (trim(x) <> '' AND lower(trim(x)) <> 'nan') AS n_described FROM (SELECT CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN ' NaN ' WHEN 2 THEN '  ' ELSE p_name END AS x FROM part)""")
def described_listings(spark, d):
    k = F.col("p_size") % 4
    return statistics.described(read(spark, d, "part").select(F.when(k == 0, None).when(k == 1, " NaN ").when(k == 2, "  ").otherwise(F.col("p_name")).alias("explanation")))


@query("""WITH t AS (SELECT l_partkey AS product_id, l_quantity AS battery, l_returnflag AS v, l_linenumber % 2 = 0 AS box FROM lineitem), q AS (SELECT product_id, round(median(battery), 4) AS battery_percentage, count(*) FILTER (box) > count(*) FILTER (NOT box) AS has_box FROM t GROUP BY ALL),
m AS (SELECT product_id, v, row_number() OVER (PARTITION BY product_id ORDER BY n DESC, v) AS k FROM (SELECT product_id, v, count(*) AS n FROM t GROUP BY ALL))
SELECT q.product_id, battery_percentage, m.v AS condition, has_box FROM q JOIN m ON m.product_id = q.product_id AND k = 1""")
def product_baselines(spark, d):
    df = read(spark, d, "lineitem").select(F.col("l_partkey").alias("product_id"), F.col("l_quantity").alias("battery_percentage"), F.col("l_returnflag").alias("condition_rank"), (F.col("l_linenumber") % 2 == 0).alias("has_box"))
    return rounded(training.product_baseline(df), "battery_percentage")


@query("""WITH t AS (SELECT p_name AS name, CAST(floor(l_extendedprice) AS DOUBLE) AS price, ['mercari', 'rakuma', 'else'][l_linenumber % 3 + 1] AS source, CASE WHEN l_quantity > 40 THEN NULL ELSE p_brand END AS brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE floor(l_extendedprice) BETWEEN 5000 AND 300000),
f AS (SELECT * FROM t WHERE brand IS NOT NULL OR (SELECT avg(CASE WHEN brand IS NULL THEN 1.0 ELSE 0.0 END) FROM t) > 0.5)
SELECT DISTINCT name, price, source, CASE source WHEN 'mercari' THEN 'Mercari' WHEN 'rakuma' THEN 'Rakuma' ELSE 'Mercari' END AS platform, 'Android' AS ecosystem, 'B' AS condition FROM f""")
def training_rows(spark, d):
    line, part = read(spark, d, "lineitem"), read(spark, d, "part")
    df = line.join(part, line.l_partkey == part.p_partkey).select(
        F.col("p_name").alias("name"), F.concat(F.lit("¥"), F.floor("l_extendedprice")).alias("price"), F.element_at(F.array(F.lit("mercari"), F.lit("rakuma"), F.lit("else")), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("source"),
        F.when(F.col("l_quantity") <= 40, F.col("p_brand")).alias("brand"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("link"),
    )
    return training.training_rows(df).select("name", "price", "source", "platform", "ecosystem", "condition")


def weights_sql(table: str, key: str, text: str) -> str:
    return f"""w AS (SELECT {key}, regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9_]+') AS w FROM {table}), g AS (SELECT {key}, unnest(w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS term FROM w),
c AS (SELECT {key}, term, count(*) AS tf FROM g GROUP BY ALL), n AS (SELECT count(*) AS n FROM {table}),
v AS (SELECT term, count(*) AS df, sum(tf) AS many FROM c GROUP BY term HAVING count(*) BETWEEN 2 AND 0.8 * (SELECT n FROM n) ORDER BY many DESC, term LIMIT 500), t AS (SELECT {key}, c.term, tf * ln((n + 1) / (df + 1)) AS score FROM c JOIN v ON c.term = v.term, n)"""


@query(f"WITH {weights_sql('documents', 'doc_id', 'text')} SELECT term, round (sum(score) / any_value(n), 9) AS score FROM t, n GROUP BY term ORDER BY score DESC, term LIMIT 30")
def word_keywords(spark, d):
    return training.mean_weights(read(spark, d, "documents"), "doc_id", "text")


@query(f"WITH {weights_sql('documents', 'doc_id', 'text')}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round (score, 9) DESC, term) AS k FROM t WHERE score > 0) SELECT doc_id, string_agg(term, '/' ORDER BY k) AS keywords FROM r WHERE k <= 5 GROUP BY doc_id")
def document_keywords(spark, d):
    return training.keywords(read(spark, d, "documents"), "doc_id", "text").select("doc_id", F.array_join("keywords", "/").alias("keywords"))


# --- tables in buckets, layouts, ranks, trigrams


@query("""WITH old AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0), a AS (SELECT o_orderkey, 'X' AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0),
one AS (SELECT coalesce(old.o_orderkey, a.o_orderkey) AS o_orderkey, coalesce(old.o_orderstatus, a.o_orderstatus) AS o_orderstatus, coalesce(a.o_totalprice, old.o_totalprice) AS o_totalprice FROM old FULL JOIN a ON old.o_orderkey = a.o_orderkey),
b AS (SELECT o_orderkey, 'Y' AS o_orderstatus, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderkey % 7 = 0)
SELECT * FROM one UNION ALL SELECT * FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM one)""")
def bucket_merge(spark, d):
    """Upsert, the same load again, then insert-if-absent, each on the buckets it touches alone."""
    df = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    held = store.BucketTable(spark, store.fresh(spark, "orders"), "o_orderkey", 16)
    held.create(df.where("o_orderkey % 3 <> 0"))
    new = df.where("o_orderkey % 2 = 0").withColumns({"o_orderstatus": F.lit("X"), "o_totalprice": F.col("o_totalprice") + 1})
    for _ in range(2):
        held.upsert(new, "a", ["o_totalprice"])
    held.insert_absent(df.where("o_orderkey % 7 = 0").withColumns({"o_orderstatus": F.lit("Y"), "o_totalprice": F.col("o_totalprice") * 2}), "b", ["o_totalprice"])
    return held.read()


@query("SELECT o_orderkey, o_orderstatus, 'new' AS state FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT o_orderkey, o_orderstatus, 'known' FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def layout_membership(spark, d):
    """Anti and semi join of two tables bucketed and sorted by the key: neither side is shuffled."""
    name = uuid.uuid4().hex
    lake = store.write_layout(read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), f"remarkt_orders_{name}", "o_orderkey", 8, store.fresh(spark, "layout"), ["o_orderkey"])
    known = store.write_layout(read(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey"), f"remarkt_lines_{name}", "l_orderkey", 8, store.fresh(spark, "layout"), ["l_orderkey"])
    return rows.absent_from(lake, known, "o_orderkey", "l_orderkey").withColumn("state", F.lit("new")).unionByName(rows.present_in(lake, known, "o_orderkey", "l_orderkey").withColumn("state", F.lit("known")))


#: Nine rows of ten have one key.
HOT_KEY = "CASE WHEN l_linenumber % 10 < 9 AND l_orderkey % 10 < 9 THEN 0 ELSE l_suppkey END"


@query(f"""SELECT k, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM (SELECT {HOT_KEY} AS k, l_extendedprice FROM lineitem) GROUP BY k""")
def spread_quantiles(spark, d):
    df = read(spark, d, "lineitem").select(F.expr(HOT_KEY).alias("k"), "l_extendedprice")
    return rounded(ranks.quantiles(df, ["k"], "l_extendedprice", {"q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95}), "q1", "median", "q3", "p95")


@query(f"""WITH t AS (SELECT {HOT_KEY} AS k, l_quantity, l_returnflag, l_partkey FROM lineitem), a AS (SELECT k, l_quantity, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, l_quantity) AS i FROM t GROUP BY k, l_quantity),
b AS (SELECT k, l_returnflag, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, l_returnflag) AS i FROM t GROUP BY k, l_returnflag), c AS (SELECT k, l_partkey, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, l_partkey) AS i FROM t GROUP BY k, l_partkey)
SELECT a.k, l_quantity, l_returnflag, l_partkey FROM a JOIN b ON a.k = b.k AND a.i = 1 AND b.i = 1 JOIN c ON a.k = c.k AND c.i = 1""")
def spread_modes(spark, d):
    df = read(spark, d, "lineitem").withColumn("k", F.expr(HOT_KEY))
    return ranks.modes(df, ["k"], ["l_quantity", "l_returnflag", "l_partkey"])


#: Wildcards, a literal per cent sign, cases, no three letters in a row, no letters at all, nothing found.
KEYWORDS = ("Widget", "WIDGET", "ld_wid", "s%ll%dg", "e b", "ro", "_", "%", "100\\%", "zzzz")


@query(" UNION ALL ".join(f"SELECT '{k}' AS keyword, p_partkey, p_name FROM part WHERE p_name ILIKE '%{k}%' ESCAPE '\'" for k in KEYWORDS))
def trigram_search(spark, d):
    index = trigrams.TrigramIndex(spark, store.fresh(spark, "trigrams"), "p_partkey", "p_name", 16).build(read(spark, d, "part").select("p_partkey", "p_name"))
    found = [index.search(k).select(F.lit(k).alias("keyword"), "p_partkey", "p_name") for k in KEYWORDS]
    return reduce(DataFrame.unionByName, found)


#: Prices of few values, so that many stay as they were.
EVENT_PRICES = "user_id AS key, ts, event_id AS nth, CASE WHEN value >= 0.5 THEN CAST(floor(value / 20) AS DOUBLE) END AS price"


@query(f"""WITH e AS (SELECT {EVENT_PRICES} FROM events), p AS (SELECT *, lag(price) OVER (PARTITION BY key ORDER BY ts, nth) AS old_price, row_number() OVER (PARTITION BY key ORDER BY ts, nth) AS i FROM e)
SELECT key, nth, old_price, price FROM p WHERE i > 1 AND price IS DISTINCT FROM old_price""")
def price_log_stream(spark, d):
    """All events as a stream, each user's last price as state; the log as it was written."""
    schema = read(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).selectExpr(*EVENT_PRICES.split(", ")).withColumnRenamed("ts", "at")
    out = store.fresh(spark, "log")
    changes.run_change_log(stream, out, store.fresh(spark, "checkpoint"))
    return spark.read.schema("key bigint, at timestamp, nth bigint, old_price double, price double").parquet(out).drop("at")


#: Phrases of which titles and descriptions are made: affirmed, denied, both, amid others.
OLD_TITLES = ("iPhone 14", "Galaxy S 23", "Pixel 7a", "Redmi Note 12", "Realme 9i", "Apple", "アップル", "Pro", "Promax", "mini", "マックス", "ULTRA", "ブルー", "Seagreen", "64GB", "8GB", "1TB", "OUKITEL", "plain", "redo")
OLD_PHRASES = (
    "元箱あり", "箱なし", "with box", "充電器なし", "充電器付き", "USBケーブル", "AirPods", "付属品完備", "SIMロック解除済み", "SIMロックあり", "利用制限○", "判定△", "利用制限×", "利用制限なし", "画面割れなし", "画面に割れ", "画面に傷", "綺麗", "good", "中古", "カメラ正常",
    "カメラに傷", "Face ID OK", "顔認証 不可", "指紋 ×", "Touch ID 正常", "完動品", "問題なし", "不具合あり", "ジャンク", "バッテリー良好", "バッテリー交換済み", "battery 85%", "最大容量 91％", "RAM 8GB", "128GB", "ストレージ 1TB",
)


def old_first_sql(column: str, cases) -> str:
    value = lambda v: str(v).upper() if isinstance(v, bool) else f"'{v}'"
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '(?i){p}') THEN {value(v)}" for p, v in cases) + " END"


def _old_sql() -> str:
    made = f"""SELECT l_orderkey, l_linenumber, t[l_partkey % {len(OLD_TITLES)} + 1] || ' ' || t[l_suppkey % {len(OLD_TITLES)} + 1] || ' ' || t[l_orderkey % {len(OLD_TITLES)} + 1] AS title,
    p[l_partkey % {len(OLD_PHRASES)} + 1] || '、' || p[l_suppkey % {len(OLD_PHRASES)} + 1] || ' ' || p[l_orderkey % {len(OLD_PHRASES)} + 1] AS description FROM lineitem, (SELECT {sql_list(OLD_TITLES)} AS t, {sql_list(OLD_PHRASES)} AS p)"""
    # signs of full width are folded before
    text = "replace(description, '％', '%')"
    flags = ", ".join(f"regexp_matches({text}, '(?i){p}') AS {n}" for n, p in config.OLD_FLAGS.items())
    firsts = ", ".join(f"coalesce({old_first_sql(text, c)}, FALSE) AS {n}" if n in ("has_damage", "has_issues") else f"{old_first_sql(text, c)} AS {n}" for n, c in config.OLD_FIRST.items())
    lines = " ".join(f"WHEN regexp_matches(title, '(?i){p}') THEN '{n}'" for n, p in reversed(config.OLD_LINES))
    numbers = " ".join(f"WHEN regexp_matches(title, '(?i){p}') THEN trim(regexp_extract(title, '(?i){p}', 1))" for _, p in reversed(config.OLD_LINES))
    variants = ", ".join(f"CASE WHEN regexp_matches(title, '(?i){p}') THEN '{n}' END" for n, p in config.OLD_VARIANTS)
    colors = " ".join(f"WHEN contains(lower(title), '{w.lower()}') THEN '{n}'" for w, n in config.OLD_COLORS)
    # one range of signs takes kana and ideographs away too
    clean = r"SELECT * REPLACE (trim(regexp_replace(regexp_replace(title, '[\x{24C2}-\x{1F251}]+', ' ', 'g'), '\s+', ' ', 'g')) AS title)"
    return f"""WITH m AS ({clean} FROM ({made})), f AS (SELECT *, {flags}, {firsts}, CASE {lines} END AS model_line, CASE {numbers} END AS model_number, nullif(concat_ws(' ', {variants}), '') AS variant, CASE {colors} END AS color FROM m)
SELECT l_orderkey, l_linenumber, model_line, model_number, variant, color, {', '.join([*config.OLD_FLAGS, *config.OLD_FIRST])}, CASE WHEN is_sim_free THEN 'unlocked' WHEN regexp_matches(description, '(?i)SIMロック|sim.*lock') THEN 'locked' END AS sim_lock_status FROM f"""


@query(_old_sql())
def old_features(spark, d):
    pick = lambda i, words: F.element_at(F.array(*(F.lit(x) for x in words)), (i % len(words) + 1).cast("int"))
    three = lambda words, sign: F.concat(pick(F.col("l_partkey"), words), F.lit(sign), pick(F.col("l_suppkey"), words), F.lit(" "), pick(F.col("l_orderkey"), words))
    made = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", three(OLD_TITLES, " ").alias("name"), three(OLD_PHRASES, "、").alias("explanation"))
    df = legacy.description_features(legacy.title_features(made))
    return df.select("l_orderkey", "l_linenumber", "model_line", "model_number", "variant", "color", *config.OLD_FLAGS, *config.OLD_FIRST, "sim_lock_status")


# --- further columns and branches


#: Inputs of the price model that are null, of odd case or unknown in some rows.
SPECS = """CASE l_linenumber % 4 WHEN 0 THEN 'iPhone' WHEN 1 THEN 'Galaxy' WHEN 2 THEN 'None' END AS model_line, CASE WHEN l_suppkey % 5 > 0 THEN CAST(l_suppkey % 20 AS STRING) END AS model_number, CASE l_linenumber % 3 WHEN 0 THEN 'Pro' WHEN 1 THEN 'nan' END AS variant,
CASE l_partkey % 6 WHEN 0 THEN 'perfect' WHEN 1 THEN 'good' WHEN 2 THEN 'fair' WHEN 3 THEN 'poor' WHEN 4 THEN 'odd' END AS body_condition, CASE l_suppkey % 4 WHEN 0 THEN '3GB' WHEN 1 THEN '12 GB' WHEN 2 THEN 'none' END AS ram,
CASE l_orderkey % 4 WHEN 0 THEN 'Mercari' WHEN 1 THEN 'Rakuma' WHEN 2 THEN 'YahooAuction' END AS platform, CASE l_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS has_box, CASE l_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS has_charger,
CASE l_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS has_scratches, CASE l_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN false END AS fully_functional, CASE l_partkey % 5 WHEN 0 THEN true WHEN 1 THEN false END AS is_sim_free,
CASE l_partkey % 7 WHEN 0 THEN true WHEN 1 THEN false END AS has_damage, CASE l_suppkey % 7 WHEN 0 THEN true WHEN 1 THEN false END AS has_issues, CASE l_linenumber % 5 WHEN 0 THEN 'S' WHEN 1 THEN 'New' WHEN 2 THEN 'Poor' WHEN 3 THEN 'J' END AS condition"""


@query(f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, {SPECS} FROM lineitem), f AS (SELECT * REPLACE (CAST(coalesce(has_box, FALSE) AS INTEGER) AS has_box, CAST(coalesce(has_charger, FALSE) AS INTEGER) AS has_charger,
CAST(coalesce(has_scratches, FALSE) AS INTEGER) AS has_scratches, CAST(coalesce(fully_functional, TRUE) AS INTEGER) AS fully_functional, CAST(coalesce(is_sim_free, TRUE) AS INTEGER) AS is_sim_free, CAST(coalesce(has_damage, FALSE) AS INTEGER) AS has_damage, CAST(coalesce(has_issues, FALSE) AS INTEGER) AS has_issues),
CASE condition WHEN 'S' THEN 100 WHEN 'New' THEN 100 WHEN 'Poor' THEN 30 WHEN 'J' THEN 30 ELSE 70 END AS score, CASE coalesce(body_condition, 'good') WHEN 'perfect' THEN 0 WHEN 'good' THEN -2 WHEN 'fair' THEN -5 WHEN 'poor' THEN -10 ELSE -2 END AS body_penalty FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, trim(replace(replace(coalesce(model_line, '') || ' ' || coalesce(model_number, '') || ' ' || coalesce(variant, ''), 'None', ''), 'nan', '')) AS full_model_name, CAST(body_penalty AS DOUBLE) AS body_penalty, CAST(greatest(least(score + body_penalty, 100), 0) AS DOUBLE) AS body_score,
CAST(CASE ram WHEN '3GB' THEN 3 WHEN '12 GB' THEN 12 ELSE 4 END AS DOUBLE) AS ram_gb, round(score * (1 + (has_box * 3 + has_charger * 2 + has_box * has_charger * 5) / 10.0), 6) AS condition_accessories, CAST(CASE platform WHEN 'Rakuma' THEN 2 WHEN 'YahooAuction' THEN 3 ELSE 1 END AS DOUBLE) AS platform_encoded,
has_box, has_charger, has_scratches, fully_functional, is_sim_free, has_damage, has_issues, greatest(has_scratches, has_damage, has_issues) AS has_any_damage, CASE WHEN has_damage = 1 THEN 2 WHEN has_scratches = 1 THEN 1 ELSE 0 END AS damage_severity, fully_functional * 20 + is_sim_free * 10 - has_issues * 15 AS functionality_score FROM f""")
def price_inputs(spark, d):
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    df = features.engineer(spark.sql(f"SELECT {', '.join(keys)}, {SPECS} FROM {{line}}", line=read(spark, d, "lineitem")))
    own = ("full_model_name", "body_penalty", "body_score", "ram_gb", "condition_accessories", "platform_encoded", "has_box", "has_charger", "has_scratches", "fully_functional", "is_sim_free", "has_damage", "has_issues", "has_any_damage", "damage_severity", "functionality_score")
    doubles = ("body_penalty", "body_score", "ram_gb", "platform_encoded")
    return rounded(df, "condition_accessories", places=6).select(*keys, *(F.col(c).cast("double").alias(c) if c in doubles else c for c in own))


@query("""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'u' END AS a FROM orders) SELECT o_orderkey, coalesce(a, 'Unknown') AS a FROM t WHERE a IS NOT NULL OR (SELECT avg(CASE WHEN a IS NULL THEN 1.0 ELSE 0.0 END) FROM t) > 0.5""")
def mostly_null_fill(spark, d):
    """Most of the column is null, so nulls are filled and no row goes."""
    return statistics.fill_or_drop(read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", "u").alias("a")), "a", "Unknown")


@query("""WITH t AS (SELECT CASE WHEN p_size % 3 > 0 THEN 1 END AS s, CASE WHEN p_size % 4 = 0 THEN 1 END AS r FROM part)
SELECT count(*) AS n, count(s) AS with_storage, count(r) AS with_ram, round (100.0 * count(s) / count(*), 1) AS storage_share, round (100.0 * count(r) / count(*), 1) AS ram_share FROM t""")
def spec_completeness(spark, d):
    size = F.col("p_size")
    specs = scalars.base_specs(F.when(size % 3 == 1, "64GB"), F.when(size % 3 == 2, "128gb"), F.when(size % 4 == 0, "8GB"))
    return statistics.completeness(read(spark, d, "part").select(specs.alias("base_specs")))


RUN_SOURCES = ("0-LOW", "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "none")


@query(f"""WITH b AS (SELECT o_orderpriority AS source, CASE WHEN o_orderpriority LIKE '2%' THEN ' ' WHEN o_orderkey % 4 > 0 THEN ' k' || (o_orderkey // 3) || ' ' END AS link FROM orders), l AS (SELECT 'k' || (o_orderkey // 3) AS link FROM orders WHERE o_orderkey % 2 = 0 OR o_orderpriority LIKE '1%'),
v AS (SELECT source, trim(link) AS link FROM b WHERE trim(link) <> ''), f AS (SELECT link, min(source) AS source FROM v GROUP BY link), s AS (SELECT unnest({sql_list(RUN_SOURCES)}) AS source),
c AS (SELECT s.source, (SELECT count(*) FROM b WHERE b.source = s.source) AS received, (SELECT count(*) FROM v WHERE v.source = s.source) AS valid, (SELECT count(DISTINCT link) FROM v WHERE v.source = s.source) AS "distinct", (SELECT count(*) FROM f WHERE f.source = s.source AND link NOT IN (SELECT link FROM l)) AS inserted FROM s),
d AS (SELECT *, CASE WHEN received = 0 THEN 'empty_df' WHEN valid = 0 THEN 'no_valid_links' WHEN inserted = 0 THEN 'all_duplicates' ELSE 'inserted' END AS code FROM c)
SELECT *, CASE code WHEN 'empty_df' THEN 'WARNING' WHEN 'no_valid_links' THEN 'WARN' WHEN 'all_duplicates' THEN 'OK' ELSE 'SUCCESS' END AS status FROM d""")
def run_ledger(spark, d):
    key = F.concat(F.lit("k"), F.floor(F.col("o_orderkey") / 3).cast("string"))
    orders = read(spark, d, "orders")
    link = F.when(F.col("o_orderpriority").startswith("2"), F.lit(" ")).when(F.col("o_orderkey") % 4 > 0, F.concat(F.lit(" "), key, F.lit(" ")))
    lake = orders.where("o_orderkey % 2 = 0 or o_orderpriority like '1%'").select(key.alias("link"))
    return ingest.ledger(orders.select(F.col("o_orderpriority").alias("source"), link.alias("link")), lake, RUN_SOURCES)


# --- intake, exchange, requests


#: A capture's columns in both engines' SQL: blank and missing links, blank names, prices that are no number, unknown marks.
CAPTURED = """CASE WHEN l_quantity > 45 THEN '  ' WHEN l_quantity <= 40 THEN concat(' L', l_orderkey % 5000, '-', l_linenumber, ' ') END AS link, CASE WHEN l_partkey % 4 = 0 THEN ' ' ELSE concat('n', l_partkey) END AS name,
CASE WHEN l_linenumber % 5 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(floor(l_extendedprice) AS DOUBLE) END AS price, CASE l_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_junk, CAST(l_suppkey % 100 AS INTEGER) AS battery_percentage"""
CAPTURE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(f"""WITH c AS (SELECT * REPLACE (trim(link) AS link) FROM (SELECT *, {CAPTURED} FROM lineitem) WHERE trim(link) <> ''), a AS (SELECT *, 'first' AS source, row_number() OVER (PARTITION BY link ORDER BY {', '.join(CAPTURE_ORDER)}) AS k FROM c WHERE l_linenumber < 4),
b AS (SELECT *, 'second' AS source, row_number() OVER (PARTITION BY link ORDER BY {', '.join(CAPTURE_ORDER)}) AS k FROM c WHERE link NOT IN (SELECT link FROM a))
SELECT link, nullif(name, ' ') AS name, CASE WHEN NOT isnan(price) THEN CAST(price AS VARCHAR) END AS price, coalesce(is_junk, FALSE) AS is_junk, battery_percentage, source, 'extracted_layer2' AS status, FALSE AS processed, '2026-01-02 03:04:05' AS ingested_at
FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE k = 1""")
def lake_ingest(spark, d):
    """A capture, a wider one and the first again into the lake: each valid link comes in once, with the capture that had it first."""
    df = spark.sql(f"SELECT {', '.join(CAPTURE_ORDER)}, {CAPTURED} FROM {{line}}", line=read(spark, d, "lineitem"))
    path, lake = store.fresh(spark, "lake"), spark.createDataFrame([], RAW_ITEMS)
    for batch, source in ((df.where("l_linenumber < 4"), "first"), (df, "second"), (df.where("l_linenumber < 4"), "again")):
        ingest.ingest(batch, lake, path, F.lit(source), now(), F.struct(*CAPTURE_ORDER))
        lake = spark.read.schema(RAW_ITEMS).parquet(path)
    return lake.select("link", "name", "price", "is_junk", "battery_percentage", "source", "status", "processed", F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss").alias("ingested_at"))


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 < 2 THEN 1 ELSE 2 END AS run FROM orders")
def incremental_runs(spark, d):
    """Files that came between runs: the first run takes what is there, the second the new ones alone, the third none."""
    df = read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    came, out, seen = (store.fresh(spark, name) for name in ("came", "loaded", "checkpoint"))
    for run, part in enumerate((df.where("o_orderkey % 3 < 2"), df.where("o_orderkey % 3 = 2"), None), 1):
        if part is not None:
            part.write.mode("append").parquet(came)
        incremental.run_new_files(spark, came, df.schema, seen, lambda batch, number, run=run: batch.write.mode("overwrite").parquet(f"{out}/run={run}/batch={number}"))
    return spark.read.schema("o_orderkey bigint, o_orderstatus string, run int, batch bigint").parquet(out).drop("batch")


@query("SELECT doc_id, source, CASE WHEN doc_id % 3 > 0 THEN lang END AS lang, '  ' || text || ' ' AS text FROM documents")
def csv_exchange(spark, d):
    """Texts with line ends, quotes and blanks at their ends, out as text for spreadsheets and back."""
    df = read(spark, d, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("lang"), F.concat(F.lit("  "), "text", F.lit(" ")).alias("text"))
    path = store.fresh(spark, "csv")
    tables.write_csv(df, path)
    return tables.read_csv(spark, path, df.schema)


#: Words of requests, and what they are as a flag and as a boolean.
REQUESTED = (("0", 0, False), ("false", 0, False), (" No ", 0, False), ("", 0, False), ("OFF", 0, False), ("1", 1, True), ("TRUE", 1, True), (" yes ", 1, True), ("on", 1, True), ("2", 1, True), ("0.5", 0, True), ("-3", 1, True), ("abc", 0, True), ("1e3", 1, True))


def pick(i, words):
    return F.element_at(F.array(*(F.lit(x) for x in words)), (i % len(words) + 1).cast("int"))


@query(f"""SELECT event_id, CASE WHEN user_id % 4 > 0 THEN {[f for _, f, _ in REQUESTED]}[event_id % {len(REQUESTED)} + 1] ELSE 0 END AS flag, user_id % 4 > 0 AND {[b for _, _, b in REQUESTED]}[event_id % {len(REQUESTED)} + 1] AS truth FROM events""")
def request_flags(spark, d):
    value = F.when(F.col("user_id") % 4 > 0, pick(F.col("event_id"), [w for w, _, _ in REQUESTED]))
    return read(spark, d, "events").select("event_id", scalars.as_flag(value).alias("flag"), scalars.as_boolean(value).alias("truth"))


@query("SELECT page_id, CASE WHEN page_id % 3 < 2 THEN replace(url, '://', '://***:***@') ELSE url END AS uri FROM pages")
def redacted_uris(spark, d):
    """Addresses with a user's name, with name and password, and with neither."""
    who = F.element_at(F.array(F.lit("://reader@"), F.lit("://reader:s3cret@"), F.lit("://")), (F.col("page_id") % 3 + 1).cast("int"))
    return read(spark, d, "pages").select("page_id", scalars.redact_uri(F.replace("url", F.lit("://"), who)).alias("uri"))


@query("""WITH t AS (SELECT p_partkey, '{"battery": ' || p_size || ', "brand": "' || p_brand || '"}' AS json, 'smart_v1.0_r2_' || printf('%.3f', p_size / 100.0) AS version FROM part)
SELECT p_partkey, substr(sha256(json), 1, 16) AS mark, 'depcurve:' || p_partkey || ':' || version || ':' || substr(sha256(json), 1, 16) || ':0-12:fx175.5' AS key FROM t""")
def curve_keys(spark, d):
    """Of each product the mark of its inputs, and the key that its curve is kept by."""
    size = F.col("p_size")
    mark = scalars.fingerprint(F.concat(F.lit('{"battery": '), size, F.lit(', "brand": "'), "p_brand", F.lit('"}')))
    key = scalars.cache_key(F.col("p_partkey").cast("string"), scalars.model_version(size / 100.0, "smart_v1.0"), mark, F.lit("0-12"), F.lit(175.5))
    return read(spark, d, "part").select("p_partkey", mark.alias("mark"), key.alias("key"))


#: Labels in detail pages, and whether they name the condition.
LABELS = (
    ("Item Condition", True), ("condition", True), (" CONDITION\u3000", True), ("the Item  condition", True), ("商品の状態", True), ("コンディション", True), ("状態：中古", True), ("Highest Bidder condition", False), ("Number of bids", False),
    ("International shipping 状態", False), ("conditions", False), ("Color", False), ("", False),
)


@query(f"SELECT o_orderkey, o_orderstatus <> 'P' AND {[b for _, b in LABELS]}[o_orderkey % {len(LABELS)} + 1] AS is_condition FROM orders")
def condition_labels(spark, d):
    label = F.when(F.col("o_orderstatus") != "P", pick(F.col("o_orderkey"), [x for x, _ in LABELS]))
    return read(spark, d, "orders").select("o_orderkey", scalars.is_condition_label(label).alias("is_condition"))


@query("""WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS yen FROM orders WHERE o_orderkey % 2 = 1)
SELECT o_orderkey, yen AS price_yen, CASE WHEN yen IS NULL THEN 7.0 ELSE round (yen * 180) END AS price_vnd, '2026-01-02 03:04:05' AS updated_at, '2026-01-02 03:04:05' AS record_time FROM n""")
def every_update_log(spark, d):
    """What an update sets on its row, and a log row for every update, changed or not."""
    old = read(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price_yen"), F.lit(7.0).alias("price_vnd"))
    new = rows.touch(old.where("o_orderkey % 2 = 1").withColumn("price_yen", F.when(F.col("o_orderkey") % 5 > 0, F.col("price_yen"))), now(), config.YEN_TO_VND_TRIGGER)
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    log = rows.price_changes(old.withColumn("updated_at", F.lit(None).cast("timestamp")), new, "o_orderkey", ["price_yen", "price_vnd", "updated_at"], now(), every=True)
    return log.select("o_orderkey", "price_yen", "price_vnd", at("updated_at"), at("record_time"))


@query("SELECT 'o' || o_orderkey AS link, o_orderpriority AS name FROM orders ORDER BY 1 LIMIT 3000")
def label_rows(spark, d):
    """Rows for labelling: the first 3000 by link, of the wide lake six columns."""
    lake = ensure_columns(read(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("link"), F.col("o_orderpriority").alias("name")), RAW_ITEMS)
    wide = lake.withColumn("original_explanation", F.col("explanation"))
    return tables.label_candidates(wide).select("link", "name")


#: Phrases of descriptions and what they say; texts between them keep a phrase's negations to itself.
SAID = (
    ("充電器あり", "charger"), ("充電器はなし", ""), ("ACアダプター付属", "charger"), ("ケーブル付き", "cable"), ("ケーブルNG", ""), ("イヤホンあり", "earphones"), ("EarPodsはありません", ""), ("付属品完備", "complete box charger cable"), ("外箱付き", "box"), ("箱は無し", ""),
    ("画面割れあり", "cracked"), ("割れなし", ""), ("画面に傷あり", "scratched"), ("スレは無し", ""), ("Face ID OK", "face_named face"), ("顔認証不可", "face_named"), ("指紋で開く", "touch_named touch"), ("Touch IDなし", "touch_named"), ("バッテリー交換済み", "replaced"),
    ("battery good", "good"), ("battery degraded", "degraded"), ("SIMロックあり", "lock"), ("シムフリー", "free"), ("ジャンク品", "issues"), ("メモリ 8GB", "ram"), ("容量 128GB", "small"), ("容量 1TB", "large"), ("最大容量 91％", "percent"), ("外装きれい", ""),
)
BETWEEN = "、写真をよくご確認のうえご購入をお願いします、"


def said_sql(mark: str) -> str:
    marks = [mark in own.split() for _, own in SAID]
    return "(" + " OR ".join(f"{marks}[{k} % {len(SAID)} + 1]" for k in ("l_partkey", "l_suppkey", "l_orderkey")) + ")"


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {said_sql("box")} AS has_box, {said_sql("charger")} AS has_charger, {said_sql("cable")} AS has_cable, {said_sql("earphones")} AS has_earphones, {said_sql("complete")} AS accessories_complete,
{said_sql("scratched")} AS has_scratches, {said_sql("cracked")} AS has_damage, CASE WHEN {said_sql("cracked")} THEN 'cracked' WHEN {said_sql("scratched")} THEN 'scratched' ELSE 'clean' END AS screen_condition, CASE WHEN {said_sql("scratched")} THEN 'used' ELSE 'good' END AS body_condition,
CASE WHEN {said_sql("face_named")} THEN NOT {said_sql("face")} END AS face_id_working, CASE WHEN {said_sql("touch_named")} THEN NOT {said_sql("touch")} END AS touch_id_working, {said_sql("issues")} AS has_issues,
NOT ({said_sql("issues")} OR {said_sql("face")} OR {said_sql("touch")}) AS fully_functional, {said_sql("replaced")} AS battery_replaced, CASE WHEN {said_sql("good")} THEN 'good' WHEN {said_sql("degraded")} THEN 'degraded' END AS battery_status,
{said_sql("free")} AS is_sim_free, CASE WHEN {said_sql("free")} THEN 'unlocked' WHEN {said_sql("lock")} THEN 'locked' END AS sim_lock_status, CASE WHEN {said_sql("ram")} THEN '8GB' END AS ram, CASE WHEN {said_sql("large")} THEN '1TB' WHEN {said_sql("small")} THEN '128GB' END AS storage,
CASE WHEN {said_sql("percent")} THEN 91 END AS battery_percentage FROM lineitem""")
def described_items(spark, d):
    """Three phrases a description, affirmed or denied: accessories, cracks, unlocking by face or finger, battery, sizes, locks."""
    said = [F.concat(pick(F.col(k), [p for p, _ in SAID]), F.lit(BETWEEN)) for k in ("l_partkey", "l_suppkey", "l_orderkey")]
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    df = extract.description_features(read(spark, d, "lineitem").select(*keys, F.concat(*said).alias("explanation")))
    own = ("has_box", "has_charger", "has_cable", "has_earphones", "accessories_complete", "has_scratches", "has_damage", "screen_condition", "body_condition", "face_id_working", "touch_id_working", "has_issues", "fully_functional")
    return df.select(*keys, *own, "battery_replaced", "battery_status", "is_sim_free", "sim_lock_status", "ram", "storage", "battery_percentage")
