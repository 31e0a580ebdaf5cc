"""Queries over the test tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import noise, scalar
from ..operators import align, bound, capsule, exact, families, models, windows
from ..sources import tables
from ..sources.tables import scan
from . import release
from .policy import CoxSpec, DatasetDescriptor, DescribeSpec, Disclosure, GlmSpec, Policy

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
CUSTOMER = Policy("c_custkey", 1 << 40, 64, {"c_acctbal": (-1000.0, 10000.0)}, {"c_mktsegment": SEGMENTS})
ORDERS = Policy("o_custkey", 1 << 40, 64, {"o_totalprice": (0.0, 500000.0)}, {"o_orderstatus": ("F", "O", "P"), "o_orderpriority": PRIORITIES})
ORDER = Policy("o_orderkey", 1 << 40, 64, {"o_totalprice": (0.0, 500000.0)}, {"o_orderpriority": PRIORITIES})
LINES = Policy("l_orderkey", 1 << 40, 64, {"l_quantity": (0.0, 50.0), "l_extendedprice": (0.0, 120000.0)}, {"l_returnflag": ("A", "N", "R"), "l_linestatus": ("F", "O")})
EVENTS = Policy("user_id", 1 << 40, 1 << 30, {"day": (0.0, 30.0)}, {"outcome": ("censored", "error")})
DAYS = [5.0, 10.0, 15.0, 20.0, 25.0, 30.0]
GUARD = Disclosure()
SECRET = b"a fixed secret for tests"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def cells(name: str, body: str, columns: list[str]) -> str:
    """SQL: one row of ``body`` as a block of coordinates."""
    return " UNION ALL ".join(f"SELECT '{name}' AS block, {i}::BIGINT AS coord, coalesce({c}, 0)::BIGINT AS value FROM ({body})" for i, c in enumerate(columns, 1))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Sums of doubles without the last digits, which depend on the order of rows."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---- shared inputs -------------------------------------------------------------------------------


def price_units(spark: SparkSession, sf: str) -> DataFrame:
    return bound.bounded_numeric(scan(spark, sf, "orders"), ORDERS, "o_totalprice", digits=2)


def both_units(spark: SparkSession, sf: str) -> DataFrame:
    a = bound.bounded_numeric(scan(spark, sf, "customer"), CUSTOMER, "c_acctbal", digits=2, name="c_acctbal")
    return a.join(price_units(spark, sf).withColumnRenamed("v", "o_totalprice"), "unit")


BOTH = Policy("unit", 1 << 40, 1, {**CUSTOMER.bounds, **ORDERS.bounds})
PRICE = "SELECT o_custkey AS unit, least(500000.0, greatest(0.0, sum(least(500000.0, greatest(0.0, o_totalprice))::DECIMAL(28,2))::DOUBLE / count(o_totalprice))) AS v FROM orders GROUP BY 1"
BALANCE = "SELECT c_custkey AS unit, least(10000.0, greatest(-1000.0, sum(least(10000.0, greatest(-1000.0, c_acctbal))::DECIMAL(28,2))::DOUBLE / count(c_acctbal))) AS v FROM customer GROUP BY 1"
ZP, ZB = "(v / 500000.0)", "((v + 1000.0) / 11000.0)"
JOINED = f"SELECT (b.v + 1000.0) / 11000.0 AS a, p.v / 500000.0 AS b FROM ({BALANCE}) b JOIN ({PRICE}) p USING (unit)"


def rint(x: str) -> str:
    return f"round_even({x} * 65536.0, 0)::BIGINT"


def event_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = scan(spark, sf, "events")
    seconds = F.date_diff("ts", F.lit("2024-01-01").cast("date")).cast("long") * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60
    day = (seconds * 1000000 + (F.extract(F.lit("SECOND"), "ts") * 1000000).cast("long")) / F.lit(86400000000.0)
    return e.select("user_id", day.alias("day"), F.when((F.col("event_type") == "error") & (F.col("value") > 200), "error").otherwise("censored").alias("outcome"))


EVENT_ROWS = "SELECT user_id, (epoch_us(ts) - 1704067200000000) / 86400000000.0::DOUBLE AS day, CASE WHEN event_type = 'error' AND value > 200 THEN 'error' ELSE 'censored' END AS outcome FROM events"
SURVIVAL = f"SELECT user_id, CASE WHEN max(CASE WHEN outcome = 'error' THEN 1 ELSE 0 END) = 1 THEN 'error' ELSE 'censored' END AS outcome, coalesce(min(CASE WHEN outcome = 'error' THEN day END), max(day)) AS t FROM ({EVENT_ROWS}) GROUP BY 1"


def bins(x: str, grid: list[float]) -> str:
    return "1" + "".join(f" + CASE WHEN {x} > {g} THEN 1 ELSE 0 END" for g in grid[:-1])


def survival_units(spark: SparkSession, sf: str) -> DataFrame:
    return bound.survival_unit(event_rows(spark, sf), EVENTS, "day", "outcome", "censored")


# ---- sources -------------------------------------------------------------------------------------


@query("SELECT c_acctbal, c_custkey, c_mktsegment, c_name, c_nationkey FROM customer")
def snapshot(spark, sf):
    return tables.snapshot(scan(spark, sf, "customer"))


@query("SELECT * FROM (VALUES ('c_acctbal','numeric','bounded'), ('c_custkey','identifier','unit'), ('c_mktsegment','categorical','declared')) t(\"column\", kind, role)")
def catalogue(spark, sf):
    return tables.catalogue(spark, CUSTOMER)


@query("SELECT unnest(['F', 'O', 'P']) AS level")
def outcome_levels(spark, sf):
    return tables.declared_levels(spark, ORDERS, "o_orderstatus")


DIGEST_COLUMNS = ("c_acctbal", "c_custkey", "c_mktsegment", "c_name", "c_nationkey")
DIGEST = f"""WITH r AS (SELECT c_custkey AS p, sha256({' || '.join(f"coalesce('v' || strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, 'n')" for c in DIGEST_COLUMNS)}) AS h FROM customer),
b AS (SELECT p // 256 AS p, sha256(string_agg(h, '' ORDER BY p)) AS h, count(*) AS n, 1 AS m FROM r GROUP BY 1),
c AS (SELECT p // 4 AS p, sha256(string_agg(h, '' ORDER BY p)) AS h, sum(n) AS n, sum(m) AS m FROM b GROUP BY 1),
d AS (SELECT p // 4 AS p, sha256(string_agg(h, '' ORDER BY p)) AS h, sum(n) AS n, sum(m) AS m FROM c GROUP BY 1)
SELECT sha256('{','.join(DIGEST_COLUMNS)}' || string_agg(h, '' ORDER BY p)) AS sha256, sum(n)::BIGINT AS n_rows, sum(m)::BIGINT AS n_blocks FROM d"""


@query(DIGEST)
def snapshot_digest(spark, sf):
    c = scan(spark, sf, "customer")
    return tables.digest(c.withColumn("row_pos", F.col("c_custkey")), "row_pos", block=256, fan=4)


@query("SELECT c_acctbal, c_custkey, c_mktsegment, c_name, c_nationkey FROM customer")
def frozen_snapshot(spark, sf):
    session, table = tables.Session(spark), scan(spark, sf, "customer").withColumn("row_pos", F.col("c_custkey"))
    session.assign("customer_table", table)
    expected = tables.digest(table, "row_pos").first()["sha256"]
    return session.snapshot("customer_table", DatasetDescriptor("customer", "1"), "row_pos", expected).drop("row_pos")


@query("SELECT c_mktsegment AS level, count(*) AS n FROM customer GROUP BY 1")
def named_domains(spark, sf):
    c, levels = scan(spark, sf, "customer"), CUSTOMER.levels["c_mktsegment"]
    domain = spark.createDataFrame([(x,) for x in levels], "level string")
    n = c.groupBy(F.col("c_mktsegment").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return domain.join(n, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT count(c_acctbal) AS n, count(*) FILTER (WHERE c_acctbal < 0) AS below, count(*) FILTER (WHERE c_acctbal > 5000) AS above FROM customer")
def numeric_bounds(spark, sf):
    lo, hi = Policy("c_custkey", 1 << 40, 64, {"c_acctbal": (0.0, 5000.0)}).bounds["c_acctbal"]
    x = F.col("c_acctbal")
    return scan(spark, sf, "customer").agg(F.count(x).alias("n"), F.count_if(x < lo).alias("below"), F.count_if(x > hi).alias("above"))


@query("SELECT n_nationkey, n_name FROM nation")
def reset_columns(spark, sf):
    return tables.drop_temporary(scan(spark, sf, "nation").select("n_nationkey", "n_name").withColumn("__tmp_a", F.lit(1)), "__tmp_")[0]


# ---- filters and projections ---------------------------------------------------------------------


@query("SELECT c_custkey, upper((c_acctbal > 0)::VARCHAR) AS positive, c_nationkey::VARCHAR AS nation, 'R' || strlen(c_name) || ':' || c_name AS prefixed, CASE WHEN c_acctbal = floor(c_acctbal) THEN c_acctbal::BIGINT::VARCHAR END AS whole FROM customer")
def canonical_labels(spark, sf):
    c = scan(spark, sf, "customer")
    return c.select("c_custkey", scalar.label(F.col("c_acctbal") > 0, "boolean").alias("positive"), scalar.label(F.col("c_nationkey"), "int").alias("nation"), scalar.length_prefixed(F.col("c_name")).alias("prefixed"), scalar.label(F.col("c_acctbal"), "double", strict=False).alias("whole"))


HMAC = "sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode({message}))))"
PADS = {name: bytes(b ^ x for b in b"key".ljust(64, b"\0")).hex() for name, x in (("inner", 0x36), ("outer", 0x5C))}


@query("SELECT c_custkey, " + HMAC.format(**PADS, message="'R5:study' || 'R' || strlen(c_name) || ':' || c_name") + " AS pseudonym FROM customer")
def pseudonyms(spark, sf):
    return scan(spark, sf, "customer").select("c_custkey", scalar.pseudonym(F.col("c_name"), "key", "study").alias("pseudonym"))


@query("SELECT c_custkey, rtrim(replace(replace(base64(encode(c_name)), '+', '-'), '/', '_'), '=') AS b64, lower(hex(encode(c_mktsegment))) AS bytes FROM customer")
def encoded_names(spark, sf):
    return scan(spark, sf, "customer").select("c_custkey", scalar.base64url(F.col("c_name").cast("binary")).alias("b64"), F.lower(F.hex(F.col("c_mktsegment").cast("binary"))).alias("bytes"))


def with_gaps(spark, sf):
    return scan(spark, sf, "events").withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))


GAPS = "SELECT * REPLACE (CASE WHEN event_id % 7 <> 0 THEN value END AS value) FROM events"


@query(f"SELECT CASE WHEN count(value) >= 5 THEN count(value) END AS n_obs FROM ({GAPS})")
def obs_count(spark, sf):
    return exact.observation_count(with_gaps(spark, sf), ["value"], GUARD)


@query(f"SELECT count(*) AS n_before, count(value) AS n_after, count(*) - count(value) AS n_dropped FROM ({GAPS})")
def na_omit(spark, sf):
    return exact.complete_case_counts(with_gaps(spark, sf), ["value"])


@query(f"SELECT event_id, value FROM ({GAPS}) WHERE value IS NOT NULL")
def na_omit_rows(spark, sf):
    return exact.complete_cases(with_gaps(spark, sf).select("event_id", "value"), ["value"])


@query(f"SELECT event_id, user_id, value FROM ({GAPS}) WHERE value IS NOT NULL AND event_id IS NOT NULL")
def analysis_rows(spark, sf):
    return align.analysis_rows(with_gaps(spark, sf).select("event_id", "user_id", "value"), "event_id")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END AS \"p2.HIGH\", CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END AS \"p3.MEDIUM\", CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1 ELSE 0 END AS \"p4.NOT.SPECIFIED\", CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS \"p5.LOW\" FROM orders")
def factor_dummies(spark, sf):
    return exact.factor_dummies(scan(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", list(PRIORITIES), GUARD, prefix="p").drop("o_orderpriority")


@query("SELECT o_orderkey, concat_ws('', (o_orderstatus = 'F')::INTEGER, (o_orderstatus = 'O')::INTEGER, (o_orderstatus = 'P')::INTEGER) AS one_hot FROM orders WHERE o_orderstatus IS NOT NULL")
def one_hot_matrix(spark, sf):
    d = exact.one_hot(scan(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O", "P"], GUARD)
    return d.select("o_orderkey", F.array_join(F.col("one_hot").cast("array<string>"), "").alias("one_hot"))


@query("SELECT level, count(o_orderstatus) AS n FROM (SELECT unnest(['F', 'O', 'P']) AS level) LEFT JOIN orders ON o_orderstatus = level GROUP BY 1")
def one_hot(spark, sf):
    return exact.one_hot_margins(scan(spark, sf, "orders"), "o_orderstatus", ["F", "O", "P"], GUARD)


STANDARD = "SELECT l_orderkey, l_linenumber, round({}, 8) AS l_quantity FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM lineitem)"


@query(STANDARD.format("(l_quantity - m) / s"))
def standardize_full(spark, sf):
    return rounded(exact.standardise(scan(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"]), 8, "l_quantity")


@query(STANDARD.format("l_quantity / s"))
def standardize_scale_only(spark, sf):
    return rounded(exact.standardise(scan(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"], "scale_only"), 8, "l_quantity")


@query("SELECT c_custkey, CASE WHEN c_acctbal <= a THEN 'Q1' WHEN c_acctbal <= b THEN 'Q2' WHEN c_acctbal <= c THEN 'Q3' ELSE 'Q4' END AS q FROM customer, (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.5) AS b, quantile_cont(c_acctbal, 0.75) AS c FROM customer)")
def quartile_bins(spark, sf):
    return exact.quartiles(scan(spark, sf, "customer"), "c_acctbal", "q").select("c_custkey", "q")


@query("SELECT o_orderkey, (o_orderkey // 13 + 1)::INTEGER AS cluster FROM orders")
def block_clusters(spark, sf):
    return exact.block_clusters(scan(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 13)


def md5_share(x: str, salt: str) -> str:
    """SQL: the whole number below 2^48 that a salted MD5 gives."""
    return f"('0x' || substr(md5('{salt}' || {x}), 1, 12))::BIGINT"


@query(f"SELECT c_custkey, ({md5_share('c_custkey', '')} % 13 + 1)::INTEGER AS cluster FROM customer")
def hash_clusters(spark, sf):
    return exact.hash_clusters(scan(spark, sf, "customer").select("c_custkey"), "c_custkey", 13)


@query(f"SELECT c_custkey, CASE WHEN {md5_share('c_custkey', '7|')} % 1000000 >= 200000 THEN c_acctbal END AS c_acctbal FROM customer")
def injected_nulls(spark, sf):
    return exact.inject_nulls(scan(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 0.2, 7)


@query("SELECT c_custkey, c_nationkey, round(-ln((" + md5_share("c_custkey", "13|1|") + " + 0.5) / 281474976710656.0) * 20.0 * exp(-0.05 * c_nationkey), 8) AS time, ((" + md5_share("c_custkey", "13|2|") + " + 0.5) / 281474976710656.0 < 0.6)::INTEGER AS event FROM customer")
def synthetic_survival(spark, sf):
    return rounded(exact.synthetic_survival(scan(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey", "c_nationkey"), 8, "time")


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity - l_tax, 8) AS centred, l_quantity - (SELECT avg(l_quantity) FROM lineitem) < 0 AS below FROM lineitem")
def standardize_none(spark, sf):
    d = exact.standardise(scan(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax"), ["l_quantity", "l_tax"], "none")
    mean = scan(spark, sf, "lineitem").agg(F.avg("l_quantity")).first()[0]
    return rounded(d.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") - F.col("l_tax")).alias("centred"), (F.col("l_quantity") < mean).alias("below")), 8, "centred")


@query(f"SELECT event_id, round((coalesce(value, m) - m) / s, 8) AS value FROM ({GAPS}), (SELECT avg(value) AS m, stddev_samp(value) AS s FROM ({GAPS}))")
def standardize_mean(spark, sf):
    return rounded(exact.standardise(with_gaps(spark, sf).select("event_id", "value"), ["value"], missing="mean"), 8, "value")


ETA = "(0.5 + 0.1 * l_discount + -0.2 * l_tax)"


def lines_eta():
    return scalar.linear([F.col("l_discount"), F.col("l_tax")], [0.1, -0.2], 0.5)


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - {ETA}) * (l_quantity - {ETA}), 6) AS r2_gaussian, round(pow(l_quantity - exp(least({ETA}, 50.0)), 2) / exp(least({ETA}, 50.0)), 6) AS r2_poisson FROM lineitem")
def pearson_r2(spark, sf):
    d = scan(spark, sf, "lineitem")
    y, eta = F.col("l_quantity"), lines_eta()
    return rounded(d.select("l_orderkey", "l_linenumber", "l_partkey", models.pearson_r2(y, eta, "gaussian").alias("r2_gaussian"), models.pearson_r2(y, eta, "poisson").alias("r2_poisson")), 6, "r2_gaussian", "r2_poisson")


@query("SELECT doc_id, round(pow(toxic - 1 / (1 + exp(-(-2.0 + 0.3 * quality))), 2) / (1 / (1 + exp(-(-2.0 + 0.3 * quality))) * (1 - 1 / (1 + exp(-(-2.0 + 0.3 * quality))))), 6) AS r2 FROM labels")
def pearson_r2_binomial(spark, sf):
    eta = scalar.linear([F.col("quality").cast("double")], [0.3], -2.0)
    return rounded(scan(spark, sf, "labels").select("doc_id", models.pearson_r2(F.col("toxic").cast("double"), eta, "binomial").alias("r2")), 6, "r2")


@query("SELECT c_custkey, coalesce(w, 1.0)::DOUBLE AS w FROM customer LEFT JOIN (SELECT n_nationkey AS c_nationkey, n_nationkey / 10.0::DOUBLE AS w FROM nation WHERE n_nationkey < 20) USING (c_nationkey)")
def cluster_weights(spark, sf):
    w = scan(spark, sf, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("cluster"), (F.col("n_nationkey") / 10.0).alias("w"))
    return exact.expand_cluster_weights(scan(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", w).select("c_custkey", "w")


@query("SELECT c_custkey, c_acctbal + c_nationkey AS added, c_acctbal - c_nationkey AS less, c_acctbal * c_nationkey AS product, 2.5 * c_acctbal - 0.5 * c_nationkey + 1.0 AS combined, round(1 / (1 + exp(-(c_acctbal / 5000))), 10) AS sigmoid, round(greatest(c_acctbal / 500, 0.0) + ln(1 + exp(-abs(c_acctbal / 500))), 10) AS softplus, round(exp(least(8.0, greatest(-3.0, c_acctbal / 1000))), 6) AS expo, round(1 / least(500.0, greatest(0.01, c_acctbal)), 10) AS reciprocal, round(ln(least(100.0, greatest(0.01, c_acctbal))), 10) AS logged FROM customer")
def scalar_functions(spark, sf):
    x, n = F.col("c_acctbal"), F.col("c_nationkey")
    d = scan(spark, sf, "customer").select("c_custkey", (x + n).alias("added"), (x - n).alias("less"), (x * n).alias("product"), (2.5 * x - 0.5 * n + 1.0).alias("combined"), scalar.sigmoid(x / 5000).alias("sigmoid"), scalar.softplus(x / 500).alias("softplus"), scalar.exp_clipped(x / 1000).alias("expo"), scalar.reciprocal(x).alias("reciprocal"), scalar.log_clipped(x).alias("logged"))
    return rounded(rounded(d, 10, "sigmoid", "softplus", "reciprocal", "logged"), 6, "expo")


@query("SELECT c_custkey, round(exp(c_acctbal / 500) / 1e6, 6) AS expo, round(ln(least(10.0, greatest(1.0, c_acctbal / 900))), 10) AS shifted, round(ln(least(1000.0, greatest(0.1, c_acctbal / 9))), 10) AS wide, round(1 - 1 / (1 + exp(-(c_acctbal / 5000))), 10) AS complement, (c_acctbal < 100)::INTEGER AS small, (round_even(c_acctbal * 65536.0, 0)::BIGINT >> 8) AS truncated, round_even(c_acctbal * 65536.0, 0)::BIGINT AS lattice FROM customer")
def scalar_ranges(spark, sf):
    x = F.col("c_acctbal")
    whole = scalar.lattice(x, 65536)
    d = scan(spark, sf, "customer").select("c_custkey", (scalar.exp_extended(x / 500) / 1e6).alias("expo"), scalar.log_shift(x / 900).alias("shifted"), scalar.log_shift_wide(x / 9).alias("wide"), scalar.one_minus(scalar.sigmoid(x / 5000)).alias("complement"), (x < 100).cast("int").alias("small"), scalar.rescaled(whole, 256).alias("truncated"), whole.alias("lattice"))
    return rounded(rounded(d, 6, "expo"), 10, "shifted", "wide", "complement")


@query("SELECT o_custkey, string_agg(lpad(hex(b), 2, '0'), '' ORDER BY i) AS bits FROM (SELECT o_custkey, i, sum(v << k)::UTINYINT AS b FROM (SELECT o_custkey, p // 8 AS i, p % 8 AS k, v FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS p, (o_orderkey % 2)::INTEGER AS v FROM orders)) GROUP BY 1, 2) GROUP BY 1")
def packed_bits(spark, sf):
    lists = scan(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", (F.col("o_orderkey") % 2).cast("int").alias("v")))).alias("own"))
    return lists.select("o_custkey", F.hex(scalar.pack_bits(F.transform("own", lambda x: x.v))).alias("bits"))


MATRIX = "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS a, l_discount AS b, l_tax AS c FROM lineitem"


@query(f"SELECT unnest([0, 1, 2]) AS j, unnest([round(sum(a), 4), round(sum(b), 4), round(sum(c), 4)]) AS value FROM ({MATRIX})")
def column_sums(spark, sf):
    d = scan(spark, sf, "lineitem").select(F.array("l_quantity", "l_discount", "l_tax").alias("x"))
    return rounded(exact.column_sums(d, "x", GUARD), 4, "value")


@query("SELECT c_custkey, c_acctbal AS first, o_totalprice AS last, 4 AS width FROM customer JOIN (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY 1) ON c_custkey = o_custkey JOIN orders o ON o.o_orderkey = k")
def bound_columns(spark, sf):
    first = align.select_rows(scan(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", ["o_orderkey"])
    left = scan(spark, sf, "customer").select("c_custkey", F.array("c_acctbal", F.col("c_nationkey").cast("double")).alias("x"))
    right = first.select(F.col("o_custkey").alias("c_custkey"), F.array(F.col("o_orderkey").cast("double"), "o_totalprice").alias("x"))
    d = models.bind_columns(left, right, "c_custkey")
    return d.select("c_custkey", models.column("x", 0).alias("first"), models.column("x", 3).alias("last"), F.size("x").alias("width"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_tax AS x1, l_discount AS x2, l_extendedprice AS x3, l_quantity AS y FROM lineitem")
def reordered_design(spark, sf):
    d = models.design(scan(spark, sf, "lineitem"), ["l_discount", "l_extendedprice", "l_tax"], "l_quantity", ("l_orderkey", "l_linenumber", "l_partkey"), order=["l_tax", "l_discount", "l_extendedprice"])
    return d.select("l_orderkey", "l_linenumber", "l_partkey", *[models.column("x", i).alias(f"x{i}") for i in (1, 2, 3)], "y")


# ---- joins ---------------------------------------------------------------------------------------


@query("SELECT c_custkey AS id, c_acctbal AS a_c_acctbal, o.o_orderkey AS b_o_orderkey, o.o_totalprice AS b_o_totalprice FROM customer JOIN (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY 1) f ON c_custkey = f.o_custkey JOIN orders o ON o.o_orderkey = f.k")
def align_customer_orders(spark, sf):
    a = scan(spark, sf, "customer").select("c_custkey", "c_acctbal")
    b = scan(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return align.align([a, b], ["c_custkey", "o_custkey"], [["c_acctbal"], ["o_orderkey"]], ["a", "b"])


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey IN (SELECT user_id FROM events)")
def align_three_way(spark, sf):
    return align.matched_ids([scan(spark, sf, "customer"), scan(spark, sf, "orders"), scan(spark, sf, "events")], ["c_custkey", "o_custkey", "user_id"])


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS row_pos FROM orders")
def row_positions(spark, sf):
    d = scan(spark, sf, "orders").select("o_orderkey", (-F.col("o_totalprice")).alias("less"))
    return align.row_positions(d, ["less", "o_orderkey"], parts=32).select("o_orderkey", F.col("row_pos").cast("long").alias("row_pos"))


@query("SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS row_pos, c_custkey AS id, c_acctbal AS customer_c_acctbal, o_orderkey AS orders_o_orderkey, o_totalprice AS orders_o_totalprice FROM customer JOIN (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY 1) f ON c_custkey = f.o_custkey JOIN orders o ON o.o_orderkey = f.k")
def align_in_reference_order(spark, sf):
    return aligned(spark, sf)


def aligned(spark, sf):
    reference = scan(spark, sf, "customer").select("c_custkey", "c_acctbal")
    orders = scan(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return align.align_to(reference, "c_custkey", ["c_acctbal"], {"orders": (orders, "o_custkey", ["o_orderkey"])}, "customer")


ORDERED_IDS = "SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS row_pos, c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"
BOUND = "sha256('k' || '|' || row_pos || '|' || strlen(id::VARCHAR) || '|' || id)"


@query(f"SELECT count(*) AS n_rows, sum(('0x' || substr(h, 1, 12))::BIGINT)::VARCHAR || '-' || sum(('0x' || substr(h, 13, 12))::BIGINT)::VARCHAR || '-' || max(row_pos) AS order_hash FROM (SELECT row_pos, {BOUND} AS h FROM ({ORDERED_IDS}))")
def alignment_manifest(spark, sf):
    rows = aligned(spark, sf)
    left, right = rows.select("row_pos", "id", "customer_c_acctbal"), rows.select("row_pos", "id", "orders_o_totalprice")
    align.check_consistent(left, right, key="k")
    return align.manifest(left, key="k")


@query(f"SELECT row_pos, id FROM ({ORDERED_IDS})")
def aligned_sink(spark, sf):
    session = tables.Session(spark)
    session.assign("aligned_customers", aligned(spark, sf).select("row_pos", "id"))
    return spark.sql("SELECT row_pos, id FROM aligned_customers")


@query(f"SELECT string_agg(lpad(hex(b), 2, '0'), '' ORDER BY i) AS bits, sum(n)::BIGINT AS n_set FROM (SELECT i, coalesce(sum(1 << k), 0)::UTINYINT AS b, count(k) AS n FROM (SELECT unnest(range(0, 20000)) AS i) LEFT JOIN (SELECT (id // 8) AS i, (id % 8)::INTEGER AS k FROM ({ORDERED_IDS})) USING (i) GROUP BY 1)")
def packed_selection(spark, sf):
    ids = align.matched_ids([scan(spark, sf, "customer"), scan(spark, sf, "orders")], ["c_custkey", "o_custkey"])
    got = align.packed_selection(ids, 160_000, "id")
    return got.select(F.hex("bits").alias("bits"), "n_set")


@query("SELECT c_custkey, row_number() OVER (ORDER BY sha256('seed' || '|' || c_custkey), c_custkey) - 1 AS row_pos FROM customer")
def shuffled(spark, sf):
    return align.shuffled(scan(spark, sf, "customer").select("c_custkey"), "c_custkey", "seed")


@query("SELECT row_number() OVER (ORDER BY c_custkey DESC) - 1 AS target, c_custkey, c_name FROM customer")
def gathered(spark, sf):
    c = align.row_positions(scan(spark, sf, "customer").select("c_custkey", "c_name"), ["c_custkey"])
    n = c.count()
    return align.gather(c, c.select((F.lit(n - 1) - F.col("row_pos")).alias("target"), F.col("row_pos").alias("source"))).select("target", "c_custkey", "c_name")


@query("SELECT c_custkey, dense_rank() OVER (ORDER BY c_nationkey)::INTEGER AS cluster FROM customer")
def cluster_ids(spark, sf):
    return windows.dense_ids(scan(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", "cluster").select("c_custkey", "cluster")


@query("SELECT o_orderkey, cluster_id FROM orders JOIN (SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment)::INTEGER AS cluster_id FROM customer) ON o_custkey = c_custkey")
def broadcast_cluster_ids(spark, sf):
    return windows.broadcast_clusters(scan(spark, sf, "customer"), "c_custkey", "c_mktsegment", scan(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", GUARD).select("o_orderkey", "cluster_id")


@query("SELECT count(*) AS n, round(sum(l_quantity * p_retailprice), 2) AS xy FROM lineitem JOIN part ON l_partkey = p_partkey")
def cross_product(spark, sf):
    return rounded(exact.cross_product(scan(spark, sf, "lineitem"), "l_partkey", "l_quantity", scan(spark, sf, "part"), "p_partkey", "p_retailprice", GUARD), 2, "xy")


@query("SELECT n_nationkey, (24 - n_nationkey)::INTEGER AS row_pos FROM nation")
def permuted(spark, sf):
    d = scan(spark, sf, "nation").select("n_nationkey").withColumn("row_pos", F.col("n_nationkey"))
    return windows.permute(d, "row_pos", d.select(F.col("row_pos").alias("source"), (24 - F.col("row_pos")).alias("target")))


# ---- statistics of bounded units -----------------------------------------------------------------


@query(cells("admitted_count", "SELECT count(DISTINCT o_custkey) AS n FROM orders", ["n"]))
def admitted_count(spark, sf):
    orders = scan(spark, sf, "orders")
    bound.admit(orders, ORDERS)
    return families.admitted_count(orders, ORDERS)


MOMENTS = cells("numeric:o_totalprice", f"SELECT count(v) AS n, sum({rint(ZP)}) AS s, sum({rint(ZP + ' * ' + ZP)}) AS q FROM ({PRICE})", ["n", "s", "q"])


@query(MOMENTS)
def numeric_moments(spark, sf):
    return families.moments(price_units(spark, sf), ORDERS, "o_totalprice")


PAIR = cells("pair:c_acctbal,o_totalprice", f"SELECT count(*) AS n, sum({rint('a')}) AS x, sum({rint('b')}) AS y, sum({rint('a * a')}) AS xx, sum({rint('b * b')}) AS yy, sum({rint('a * b')}) AS xy FROM ({JOINED})", ["n", "x", "y", "xx", "yy", "xy"])


@query(PAIR)
def numeric_pair_moments(spark, sf):
    return families.pair_moments(both_units(spark, sf), BOTH, "c_acctbal", "o_totalprice", "c_acctbal", "o_totalprice")


@query(f"SELECT 'pair:c_acctbal,o_totalprice' AS block, n::BIGINT AS n, round((n * xy * 65536.0 - x * y) / sqrt((n * xx * 65536.0 - x * x) * (n * yy * 65536.0 - y * y)), 10) AS correlation FROM (SELECT count(*)::DOUBLE AS n, sum({rint('a')})::DOUBLE AS x, sum({rint('b')})::DOUBLE AS y, sum({rint('a * a')})::DOUBLE AS xx, sum({rint('b * b')})::DOUBLE AS yy, sum({rint('a * b')})::DOUBLE AS xy FROM ({JOINED}))")
def correlation(spark, sf):
    return rounded(families.correlation(numeric_pair_moments(spark, sf), BOTH.scale), 10, "correlation")


GAUSS = cells("gaussian:o_totalprice", f"SELECT count(*) AS n, count(*) * 65536 AS a, sum({rint('a')}) AS b, sum({rint('a * a')}) AS c, sum({rint('b')}) AS d, sum({rint('a * b')}) AS e, sum({rint('b * b')}) AS f FROM ({JOINED})", list("nabcdef"))


@query(GAUSS)
def gaussian_same_owner(spark, sf):
    return families.gaussian(both_units(spark, sf), BOTH, "o_totalprice", ["c_acctbal"])


CROSS = cells("gaussian_cross:o_totalprice", f"SELECT count(*) * 65536 AS n, count(*) * 65536 AS a, sum(x) AS b, sum((x * x) >> 16) AS c, sum(y) AS d, sum((x * y) >> 16) AS e, sum((y * y) >> 16) AS f FROM (SELECT {rint('a')} AS x, {rint('b')} AS y FROM ({JOINED}))", list("nabcdef"))


@query(CROSS)
def gaussian_cross_owner(spark, sf):
    return families.gaussian_cross(both_units(spark, sf), BOTH, "o_totalprice", ["c_acctbal"])


GRID = [0.0, 2500.0, 5000.0, 7500.0, 10000.0]
HIST = cells("histogram:c_acctbal", f"SELECT {', '.join(f'count(*) FILTER (WHERE b = {i}) AS b{i}' for i in range(1, 6))}, count(*) FILTER (WHERE v IS NULL) AS z FROM (SELECT v, CASE WHEN v IS NOT NULL THEN {bins('v', GRID)} END AS b FROM ({BALANCE}))", [*(f"b{i}" for i in range(1, 6)), "z"])


@query(HIST)
def histogram_fixed_grid(spark, sf):
    return families.histogram(bound.bounded_numeric(scan(spark, sf, "customer"), CUSTOMER, "c_acctbal", digits=2), "c_acctbal", GRID)


def one_level(column: str, unit: str, table: str) -> str:
    return f"SELECT {unit} AS unit, CASE WHEN count(DISTINCT {column}) = 1 THEN min({column}) END AS level FROM {table} GROUP BY 1"


MARGINALS = cells("categorical:c_mktsegment", f"SELECT {', '.join(f'''count(*) FILTER (WHERE level = '{s}') AS s{i}''' for i, s in enumerate(SEGMENTS))} FROM ({one_level('c_mktsegment', 'c_custkey', 'customer')})", [f"s{i}" for i in range(5)])


@query(MARGINALS)
def categorical_marginals(spark, sf):
    return families.marginals(bound.bounded_category(scan(spark, sf, "customer"), CUSTOMER, "c_mktsegment"), CUSTOMER, "c_mktsegment")


CELLS = [(r, c) for c in ("F", "O") for r in ("A", "N", "R")]
PAIRS = cells("categories:l_returnflag,l_linestatus", f"SELECT {', '.join(f'''count(*) FILTER (WHERE r = '{r}' AND c = '{c}') AS x{i}''' for i, (r, c) in enumerate(CELLS))} FROM (SELECT l_orderkey, min(l_returnflag) AS r, min(l_linestatus) AS c FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag || l_linestatus) = 1)", [f"x{i}" for i in range(6)])


@query(PAIRS)
def categorical_pairs_same_owner(spark, sf):
    return families.pairs(bound.bounded_pair(scan(spark, sf, "lineitem"), LINES, "l_returnflag", "l_linestatus"), LINES, "l_returnflag", "l_linestatus")


PCELLS = [(r, c) for c in ("F", "O") for r in PRIORITIES]
PAIRS_CROSS = cells("categories_cross:o_orderpriority,l_linestatus", f"SELECT {', '.join(f'''65536 * count(*) FILTER (WHERE a.level = '{r}' AND b.level = '{c}') AS x{i}''' for i, (r, c) in enumerate(PCELLS))} FROM ({one_level('o_orderpriority', 'o_orderkey', 'orders')}) a JOIN ({one_level('l_linestatus', 'l_orderkey', 'lineitem')}) b USING (unit)", [f"x{i}" for i in range(10)])


@query(PAIRS_CROSS)
def categorical_pairs_cross_owner(spark, sf):
    return families.pairs_cross(scan(spark, sf, "orders"), ORDER, "o_orderpriority", scan(spark, sf, "lineitem"), LINES, "l_linestatus")


DGRID = [100000.0, 200000.0, 300000.0, 400000.0, 500000.0]
DESCRIBE = cells(
    "describe:o_totalprice",
    f"SELECT count(z) AS n, sum({rint('z')}) AS s, sum({rint('z * z')}) AS q, {', '.join(f'count(*) FILTER (WHERE b = {i}) AS b{i}' for i in range(1, 6))}, count(*) FILTER (WHERE z IS NULL) AS i FROM (SELECT z, {bins('z', [g / 500000.0 for g in DGRID])} AS b FROM (SELECT o_custkey, sum((least(500000.0, greatest(0.0, o_totalprice)) / 500000.0)::DECIMAL(28,8))::DOUBLE / count(o_totalprice) AS z FROM orders GROUP BY 1))",
    ["n", "s", "q", *(f"b{i}" for i in range(1, 6)), "i"],
)


@query(DESCRIBE)
def describe(spark, sf):
    return families.describe(scan(spark, sf, "orders"), ORDERS, {"o_totalprice": DGRID}, digits=8)


SURV_COLUMNS = ", ".join(f"count(*) FILTER (WHERE outcome = '{o}' AND b = {i}) AS {o}{i}" for o in ("censored", "error") for i in range(1, 7))
SURVIVED = cells("survival", f"SELECT {SURV_COLUMNS}, 0 AS z FROM (SELECT outcome, {bins('t', DAYS)} AS b FROM ({SURVIVAL}))", [*(f"{o}{i}" for o in ("censored", "error") for i in range(1, 7)), "z"])


@query(SURVIVED)
def survival_histogram(spark, sf):
    return families.survival(survival_units(spark, sf), EVENTS, "outcome", "censored", DAYS)


DELAYED = cells(
    "survival_delayed",
    f"SELECT {', '.join(f'count(*) FILTER (WHERE e = {i}) AS e{i}' for i in range(1, 7))}, {SURV_COLUMNS}, 0 AS z FROM (SELECT outcome, {bins('t', DAYS)} AS b, {bins('f', DAYS)} AS e FROM ({SURVIVAL}) JOIN (SELECT user_id, min(day) AS f FROM ({EVENT_ROWS}) GROUP BY 1) USING (user_id))",
    [*(f"e{i}" for i in range(1, 7)), *(f"{o}{i}" for o in ("censored", "error") for i in range(1, 7)), "z"],
)


@query(DELAYED)
def survival_delayed_entry(spark, sf):
    rows = event_rows(spark, sf)
    first = rows.groupBy("user_id").agg(F.min("day").alias("entry"))
    units = bound.survival_unit(rows.join(first, "user_id"), EVENTS, "day", "outcome", "censored", "entry")
    return families.survival(units, EVENTS, "outcome", "censored", DAYS, delayed=True, name="survival_delayed")


VECTOR = [("admitted_count", SQL["admitted_count"]), ("numeric_moments", MOMENTS), ("numeric_pair_moments", PAIR), ("gaussian_same_owner", GAUSS), ("gaussian_cross_owner", CROSS), ("histogram_fixed_grid", HIST), ("categorical_marginals", MARGINALS), ("categorical_pairs_same_owner", PAIRS), ("categorical_pairs_cross_owner", PAIRS_CROSS), ("survival_histogram", SURVIVED)]


@query(" UNION ALL ".join(f"SELECT {i} AS at, * FROM ({sql})" for i, (_, sql) in enumerate(VECTOR)))
def capsule_vector(spark, sf):
    customer = capsule.Owner("customer", scan(spark, sf, "customer"), CUSTOMER).numeric("c_acctbal", "c_acctbal", 2).category("segment", "c_mktsegment")
    orders = capsule.Owner("orders", scan(spark, sf, "orders"), ORDERS).numeric("o_totalprice", "o_totalprice", 2)
    own = F.col(customer.rows).isNotNull()
    by_customer = [
        (0, "admitted_count", [F.count(orders.rows)]),
        (1, "numeric:o_totalprice", families.moments_terms(ORDERS, "o_totalprice", "o_totalprice")),
        (2, "pair:c_acctbal,o_totalprice", families.pair_terms(BOTH, "c_acctbal", "o_totalprice", "c_acctbal", "o_totalprice")),
        (3, "gaussian:o_totalprice", families.gaussian_terms(BOTH, "o_totalprice", ["c_acctbal"])),
        (4, "gaussian_cross:o_totalprice", families.gaussian_cross_terms(BOTH, "o_totalprice", ["c_acctbal"])),
        (5, "histogram:c_acctbal", families.histogram_terms(GRID, "c_acctbal", own)),
        (6, "categorical:c_mktsegment", families.marginals_terms(CUSTOMER, "c_mktsegment", "segment")),
    ]
    lines = capsule.Owner("lines", scan(spark, sf, "lineitem"), LINES).category("pair", "l_returnflag", "l_linestatus").category("status", "l_linestatus")
    order = capsule.Owner("order", scan(spark, sf, "orders"), ORDER).category("priority", "o_orderpriority")
    by_order = [
        (7, "categories:l_returnflag,l_linestatus", families.pairs_terms(LINES.levels["l_returnflag"], LINES.levels["l_linestatus"], "pair.l_returnflag", "pair.l_linestatus")),
        (8, "categories_cross:o_orderpriority,l_linestatus", families.pairs_terms(ORDER.levels["o_orderpriority"], LINES.levels["l_linestatus"], "priority", "status", ORDER.scale)),
    ]
    joined = capsule.capsule([([customer, orders], by_customer), ([order, lines], by_order)])
    return joined.unionByName(families.survival(survival_units(spark, sf), EVENTS, "outcome", "censored", DAYS).withColumn("at", F.lit(9)))


MEASURES = {"quantity": (0.0, 50.0), "extendedprice": (0.0, 120000.0), "discount": (0.0, 1.0), "tax": (0.0, 1.0)}
GROUPS = {"all": None, "A": "l_returnflag", "N": "l_returnflag", "R": "l_returnflag", "F": "l_linestatus", "O": "l_linestatus"}
WIDE = [(f"{m}_{g}", m, g) for m in MEASURES for g in GROUPS]
PARTS = Policy("l_partkey", 1 << 40, 1 << 20, {name: MEASURES[m] for name, m, _ in WIDE})


def _wide_sql() -> str:
    def value(m: str, g: str) -> str:
        x = f"least({MEASURES[m][1]}, greatest({MEASURES[m][0]}, l_{m}))"
        return x if GROUPS[g] is None else f"CASE WHEN {GROUPS[g]} = '{g}' THEN {x} END"

    means = ", ".join(f"sum(({value(m, g)})::DECIMAL(28,4))::DOUBLE / nullif(count({value(m, g)}), 0) / {MEASURES[m][1]} AS {name}" for name, m, g in WIDE)
    names, values = ", ".join(repr(n) for n, _, _ in WIDE), ", ".join(n for n, _, _ in WIDE)
    cells = "[n, x, xx]", "[n, x, y, xx, yy, xy]"
    return f"""WITH u AS (SELECT l_partkey AS unit, {means} FROM lineitem GROUP BY 1),
l AS (SELECT unit, unnest(range(0, {len(WIDE)})) AS k, unnest([{names}]) AS name, unnest([{values}]) AS z FROM u),
d AS (SELECT unnest(range(0, {len(WIDE)})) AS k, unnest([{names}]) AS name),
m AS (SELECT k, count(z) AS n, sum({rint('z')}) AS x, sum({rint('z * z')}) AS xx FROM l GROUP BY k),
q AS (SELECT a.k AS i, b.k AS j, count(*) AS n, sum({rint('a.z')}) AS x, sum({rint('b.z')}) AS y, sum({rint('a.z * a.z')}) AS xx, sum({rint('b.z * b.z')}) AS yy, sum({rint('a.z * b.z')}) AS xy FROM l a JOIN l b USING (unit) WHERE a.k < b.k AND a.z IS NOT NULL AND b.z IS NOT NULL GROUP BY 1, 2),
r AS (SELECT d.k AS "at", 'numeric:' || d.name AS block, {cells[0]} AS v FROM d LEFT JOIN m USING (k)
  UNION ALL SELECT row_number() OVER (ORDER BY a.k, b.k) - 1 + {len(WIDE)}, 'pair:' || a.name || ',' || b.name, {cells[1]} FROM d a JOIN d b ON a.k < b.k LEFT JOIN q ON q.i = a.k AND q.j = b.k)
SELECT "at"::INTEGER AS "at", block, unnest(range(1, len(v) + 1))::BIGINT AS coord, coalesce(unnest(v), 0)::BIGINT AS value FROM r"""


@query(_wide_sql())
def capsule_wide(spark, sf):
    """Moments of 24 columns and of their 276 pairs, over parts."""
    lines = scan(spark, sf, "lineitem")
    rows = lines.select("l_partkey", *[(F.col(f"l_{m}") if GROUPS[g] is None else F.when(F.col(GROUPS[g]) == g, F.col(f"l_{m}"))).alias(name) for name, m, g in WIDE])
    names = [name for name, _, _ in WIDE]
    return families.all_moments(bound.bounded_numerics(rows, PARTS, {n: n for n in names}, digits=4), PARTS, names)


BY_CATEGORY = cells("numeric_by_category:c_acctbal,c_mktsegment", "SELECT " + ", ".join(f"count(*) FILTER (WHERE g = '{s}') AS n{i}, sum({rint('z')}) FILTER (WHERE g = '{s}') AS s{i}, sum({rint('z * z')}) FILTER (WHERE g = '{s}') AS q{i}" for i, s in enumerate(SEGMENTS)) + f" FROM (SELECT (b.v + 1000.0) / 11000.0 AS z, c.level AS g FROM ({BALANCE}) b JOIN ({one_level('c_mktsegment', 'c_custkey', 'customer')}) c USING (unit))", [f"{x}{i}" for i in range(5) for x in "nsq"])


@query(BY_CATEGORY)
def numeric_by_category(spark, sf):
    c = scan(spark, sf, "customer")
    units = bound.bounded_numeric(c, CUSTOMER, "c_acctbal", digits=2).join(bound.bounded_category(c, CUSTOMER, "c_mktsegment"), "unit")
    return families.numeric_by_category(units, CUSTOMER, "c_acctbal", "c_mktsegment")


@query(cells("numeric_cross_moment:c_acctbal,o_totalprice", f"SELECT count(*) AS n, sum({rint('a * b')}) AS xy FROM ({JOINED})", ["n", "xy"]))
def numeric_cross_moment(spark, sf):
    return families.cross_moment(both_units(spark, sf), BOTH, "c_acctbal", "o_totalprice")


SHIFTED = {"admitted_count": [16], "numeric:o_totalprice": [16, 0, 0], "pair:c_acctbal,o_totalprice": [16, *[0] * 5], "gaussian:o_totalprice": [16, *[0] * 6], "gaussian_cross:o_totalprice": [0] * 7, "histogram:c_acctbal": [16] * 6, "categorical:c_mktsegment": [16] * 5, "categories:l_returnflag,l_linestatus": [16] * 6, "categories_cross:o_orderpriority,l_linestatus": [0] * 10, "survival": [16] * 13}
UPPER = 1 << 50
MOVED = " UNION ALL ".join(f"SELECT '{b}' AS block, {i}::BIGINT AS coord, {x}::INTEGER AS shift" for b, own in SHIFTED.items() for i, x in enumerate(own, 1))


@query(f"SELECT v.block, v.coord, v.value << shift AS value, {UPPER}::BIGINT AS upper FROM ({SQL['capsule_vector']}) v JOIN ({MOVED}) USING (block, coord)")
def lattice_vector(spark, sf):
    return release.on_lattice(capsule_vector(spark, sf), 16, SHIFTED, {b: [UPPER] * len(x) for b, x in SHIFTED.items()})


@query(f"SELECT d.coord, d.level, count(c_custkey) AS n FROM (SELECT unnest(range(1, 6))::BIGINT AS coord, unnest([{', '.join(repr(s) for s in SEGMENTS)}]) AS level) d LEFT JOIN (SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) ON c_mktsegment = level GROUP BY 1, 2")
def frequency(spark, sf):
    c = scan(spark, sf, "customer")
    ids = align.matched_ids([c, scan(spark, sf, "orders")], ["c_custkey", "o_custkey"])
    matched = c.join(ids, c.c_custkey == ids.id, "left_semi")
    return families.frequency(families.one_row_a_unit(matched, "c_custkey", 1 << 40), SEGMENTS, "c_mktsegment")


PLANNED = DescribeSpec({"o_totalprice": tuple(DGRID)})


@query("SELECT variable, unnest(range(1, 10))::INTEGER AS coord, 0.25::DOUBLE AS epsilon, unnest([1.0, 65536.0, 65536.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0])::DOUBLE AS sensitivity FROM (SELECT 'o_totalprice' AS variable)")
def describe_plan(spark, sf):
    return spark.createDataFrame(PLANNED.plan(ORDERS, 1.0), "variable string, coord int, epsilon double, sensitivity double")


@query("SELECT l_orderkey // 100 AS segment, sum(l_quantity) AS total FROM lineitem GROUP BY 1")
def segment_sums(spark, sf):
    return exact.segment_sums(scan(spark, sf, "lineitem"), "l_orderkey", "l_quantity", 100)


# ---- releases ------------------------------------------------------------------------------------


@query()
def count_noised(spark, sf):
    return release.noised(admitted_count(spark, sf), "count-1", SECRET, 1.0, 1.0)


@query()
def frequency_noised(spark, sf):
    blocks = frequency(spark, sf).select(F.lit("frequency").alias("block"), "coord", F.col("n").alias("value"))
    mechanism, _ = noise.frequency_backend(len(SEGMENTS), 1.0, 1e-6, "add_remove")
    return release.noised(blocks, "frequency-1", SECRET, 1.0, 1.0, mechanism=mechanism, sigma=noise.plan_gaussian(len(SEGMENTS), 1.0, 1e-6, 1.0).sigma2 ** 0.5)


@query()
def vector_noised(spark, sf):
    blocks = categorical_pairs_same_owner(spark, sf)
    return release.noised(blocks, "vector-1", SECRET, 1.0, 1.0, mechanism="gaussian", sigma=noise.gaussian_sigma(1.0, 1.0, 1e-6))


@query(f"SELECT block, coord, floor(abs(ln(0.05 / n)) + 0.5)::BIGINT AS radius_all, floor(abs(ln(0.05)) + 0.5)::BIGINT AS radius FROM ({PAIRS}), (SELECT count(*) AS n FROM ({PAIRS}))")
def release_radii(spark, sf):
    return release.noised(categorical_pairs_same_owner(spark, sf), "radii", SECRET, 1.0, 1.0).select("block", "coord", "radius_all", "radius")


@query("SELECT 0::BIGINT AS different, 6::BIGINT AS kept")
def release_replay(spark, sf):
    """A release stored once: a second caller with another secret gets the first one's values."""
    folder = tables.shared_folder(spark, "releases")
    ledger, blocks = release.Ledger(folder), categorical_pairs_same_owner(spark, sf)
    first = ledger.release("pairs", lambda: release.noised(blocks, "pairs-1", SECRET, 1.0, 0.01))
    again = ledger.release("pairs", lambda: release.noised(blocks, "pairs-1", b"another", 1.0, 0.01))
    same = first.join(again, ["block", "coord", "value"])
    return first.agg(F.count(F.lit(1)).alias("n")).crossJoin(same.agg(F.count(F.lit(1)).alias("kept"))).select((F.col("n") - F.col("kept")).alias("different"), "kept")  # one row each


@query()
def mechanism_gaussian(spark, sf):
    rows = [(*noise.capsule_mechanism([("count", 1), ("moments", 3), ("pair", 6), ("histogram", n)], 65536, 1, 1.0, 1e-6), n) for n in (6, 100, 10_000)]
    return spark.createDataFrame([(m, int(r), float(a), float(b), n) for m, r, a, b, n in rows], "mechanism string, radius long, l1 double, l2 double, bins int")


@query("SELECT 'laplace' AS mechanism, floor(abs(ln(0.05 / n)) * 6.0 / eps + 0.5)::BIGINT AS radius, n::INTEGER AS n, eps FROM (VALUES (1, 1.0::DOUBLE), (10, 0.5::DOUBLE), (100, 2.0::DOUBLE)) t(n, eps)")
def mechanism_choice(spark, sf):
    rows = [(*noise.choose(n, 6.0, 6.0, eps, 0.0), n, eps) for n, eps in ((1, 1.0), (10, 0.5), (100, 2.0))]
    return spark.createDataFrame(rows, "mechanism string, radius long, n int, eps double")


# ---- exact aggregates ----------------------------------------------------------------------------

CONTINGENCY = """WITH d AS (SELECT lang AS a, toxic::VARCHAR AS b FROM labels JOIN documents USING (doc_id)), c AS (SELECT a, b, count(*) AS n FROM d GROUP BY 1, 2),
r AS (SELECT a, count(*) AS na FROM d GROUP BY 1), k AS (SELECT b, count(*) AS nb FROM d GROUP BY 1),
x AS (SELECT r.a, k.b, coalesce(c.n, 0) AS n, na, nb, coalesce(c.n, 0) BETWEEN 1 AND 2 OR na < 3 OR nb < 3 AS suppressed FROM r CROSS JOIN k LEFT JOIN c ON c.a = r.a AND c.b = k.b),
y AS (SELECT *, bool_or(suppressed) OVER (PARTITION BY a) AS ra, bool_or(suppressed) OVER (PARTITION BY b) AS cb FROM x)
SELECT CASE WHEN na < 3 THEN '<suppressed>' ELSE a END AS a, CASE WHEN nb < 3 THEN '<suppressed>' ELSE b END AS b, CASE WHEN suppressed THEN 0 ELSE n END AS n, CASE WHEN NOT ra THEN na END::BIGINT AS row_total, CASE WHEN NOT cb THEN nb END::BIGINT AS col_total, suppressed FROM y"""


def language_table(spark, sf):
    return scan(spark, sf, "labels").join(scan(spark, sf, "documents").select("doc_id", "lang"), "doc_id").withColumn("toxic", F.col("toxic").cast("string"))


@query(CONTINGENCY)
def contingency_exact(spark, sf):
    return exact.contingency(language_table(spark, sf), "lang", "toxic", GUARD, suppress=True)


@query("SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n, sum(count(*)) OVER (PARTITION BY l_returnflag)::BIGINT AS row_total, sum(count(*)) OVER (PARTITION BY l_linestatus)::BIGINT AS col_total, false AS suppressed FROM lineitem GROUP BY 1, 2")
def contingency_open(spark, sf):
    return exact.contingency(scan(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", GUARD)


@query(f"SELECT count(*) FILTER (WHERE value IS NOT NULL AND event_type IS NOT NULL) AS n, count(*) FILTER (WHERE value IS NULL OR event_type IS NULL) AS n_na FROM ({GAPS})")
def contingency_totals(spark, sf):
    return exact.contingency_totals(with_gaps(spark, sf), "event_type", "value", GUARD)


@query("SELECT 0 AS item, l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 2, 3 UNION ALL SELECT 1, o_orderstatus, o_orderpriority, count(*) FROM orders GROUP BY 2, 3")
def joint_release(spark, sf):
    return exact.joint_release([(scan(spark, sf, "lineitem"), "l_returnflag", "l_linestatus"), (scan(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")], GUARD)


@query("WITH c AS (SELECT l_returnflag AS a, o_orderpriority AS b, count(*)::DOUBLE AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2), e AS (SELECT n, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS e FROM c) SELECT round(sum((n - e) * (n - e) / e), 6) AS chi2, ((SELECT count(DISTINCT a) - 1 FROM c) * (SELECT count(DISTINCT b) - 1 FROM c))::BIGINT AS df FROM e")
def cross_chi_square(spark, sf):
    d = scan(spark, sf, "lineitem").select("l_orderkey", "l_returnflag").join(scan(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    return rounded(exact.chi_square(exact.crosstab(d, "l_returnflag", "o_orderpriority")), 6, "chi2")


EDGES = [0.0, 0.02, 0.05, 0.08]


@query("SELECT unnest([-1, 0, 1, 2, 3, 4]) AS bin, unnest([count(*) FILTER (WHERE x IS NULL), count(*) FILTER (WHERE x < 0), count(*) FILTER (WHERE x >= 0 AND x < 0.02), count(*) FILTER (WHERE x >= 0.02 AND x < 0.05), count(*) FILTER (WHERE x >= 0.05 AND x <= 0.08), count(*) FILTER (WHERE x > 0.08)]) AS n FROM (SELECT l_discount AS x FROM lineitem)")
def histogram_exact(spark, sf):
    return exact.histogram(scan(spark, sf, "lineitem"), "l_discount", EDGES, GUARD)


@query("SELECT count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS sd, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer")
def local_moments(spark, sf):
    return rounded(exact.local_moments(scan(spark, sf, "customer"), "c_acctbal", GUARD, extrema=True), 6, "mean", "sd")


@query("SELECT count(l_quantity) AS n, sum(l_quantity) AS sum_y, sum(l_quantity * l_quantity) AS sum_y2, round(avg(l_quantity), 8) AS mean, round(var_samp(l_quantity), 6) AS variance FROM lineitem")
def nb_moments(spark, sf):
    return rounded(rounded(exact.nb_moments(scan(spark, sf, "lineitem"), "l_quantity"), 8, "mean"), 6, "variance")


@query("SELECT sum(n)::BIGINT AS n, round(sum(n * (psi + coalesce(list_sum(list_transform(range(0, y::BIGINT), lambda k: 1.0::DOUBLE / (2.5::DOUBLE + k))), 0))), 4) AS sum_psi, round(sum(n * (psi1 - coalesce(list_sum(list_transform(range(0, y::BIGINT), lambda k: 1.0::DOUBLE / ((2.5::DOUBLE + k) * (2.5::DOUBLE + k)))), 0))), 4) AS sum_psi1 FROM (SELECT l_quantity AS y, count(*) AS n FROM lineitem GROUP BY 1), (SELECT 0.7031566406452432::DOUBLE AS psi, 0.4903577561002348::DOUBLE AS psi1)")
def nb_profile_sums(spark, sf):
    return rounded(exact.nb_profile(scan(spark, sf, "lineitem"), "l_quantity", 2.5), 4, "sum_psi", "sum_psi1")


@query("SELECT l_suppkey AS cluster, count(*) AS n FROM lineitem GROUP BY 1")
def cluster_sizes(spark, sf):
    return exact.cluster_sizes(scan(spark, sf, "lineitem"), "l_suppkey", GUARD)


RES = f"(l_quantity - {ETA})"


@query(f"SELECT l_suppkey AS cluster, round(sum({RES}), 4) AS sum_r, round(sum({RES} * {RES}), 3) AS sum_r2, count(*) AS n FROM lineitem GROUP BY 1")
def cluster_residuals(spark, sf):
    return rounded(rounded(exact.cluster_residuals(scan(spark, sf, "lineitem"), "l_suppkey", F.col("l_quantity") - lines_eta(), GUARD), 4, "sum_r"), 3, "sum_r2")


@query("SELECT l_suppkey AS cluster, count(*)::DOUBLE AS z00, round(sum(l_discount), 6) AS z01, round(sum(l_discount * l_discount), 6) AS z11 FROM lineitem GROUP BY 1")
def cluster_ztz(spark, sf):
    return rounded(exact.cluster_ztz(scan(spark, sf, "lineitem"), "l_suppkey", [F.col("l_discount")], GUARD), 6, "z01", "z11")


@query("SELECT round(sum(l_quantity), 2) AS total FROM lineitem")
def guarded_sum(spark, sf):
    return rounded(exact.guarded_sum(scan(spark, sf, "lineitem"), F.col("l_quantity"), GUARD), 2, "total")


@query("SELECT 'quantity' AS key, 0 AS position, round(sum(l_quantity), 2) AS total FROM lineitem UNION ALL SELECT 'quantity', 1, round(sum(l_tax), 2) FROM lineitem UNION ALL SELECT 'price', 0, round(sum(o_totalprice), 2) FROM orders")
def stored_sums(spark, sf):
    lines, orders = scan(spark, sf, "lineitem"), scan(spark, sf, "orders")
    return rounded(exact.stored_sums([("quantity", lines, F.col("l_quantity")), ("quantity", lines, F.col("l_tax")), ("price", orders, F.col("o_totalprice"))], GUARD), 2, "total")


@query("SELECT count(*) AS k, sum(n)::BIGINT AS n, round(sum(s) / sum(n), 8) AS mean, round(sum(w), 3) AS ssw, round(sum(s * s / n) - sum(s) * sum(s) / sum(n), 3) AS ssb FROM (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS s, var_pop(l_quantity) * count(*) AS w FROM lineitem GROUP BY 1)")
def lmm_variance_components(spark, sf):
    return rounded(rounded(exact.variance_components(scan(spark, sf, "lineitem"), "l_quantity", "l_orderkey"), 8, "mean"), 3, "ssw", "ssb")


CENTRED = "SELECT l_quantity - avg(l_quantity) OVER w AS a, l_discount - avg(l_discount) OVER w AS b, count(*) OVER w AS n, l_orderkey FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)"


@query(f"SELECT unnest([0, 0, 1]) AS i, unnest([0, 1, 1]) AS j, unnest([round(sum(a * a), 3), round(sum(a * b), 3), round(sum(b * b), 3)]) AS value, (count(*) - count(DISTINCT l_orderkey))::BIGINT AS df FROM ({CENTRED}) WHERE n > 1")
def lmm_within_cov(spark, sf):
    return rounded(exact.within_covariance(scan(spark, sf, "lineitem"), ["l_quantity", "l_discount"], "l_orderkey"), 3, "value")


SHARES = "(SELECT DISTINCT l_suppkey AS cluster, (l_suppkey % 10) / 10.0::DOUBLE AS share FROM lineitem)"
GLS = f"(SELECT l_orderkey, l_linenumber, l_partkey, l_quantity - share * avg(l_quantity) OVER w AS q, l_discount - share * avg(l_discount) OVER w AS d, 1 - share AS i FROM lineitem JOIN {SHARES} ON l_suppkey = cluster WINDOW w AS (PARTITION BY l_suppkey))"


def shares(spark, sf):
    return scan(spark, sf, "lineitem").select(F.col("l_suppkey").alias("cluster")).distinct().withColumn("share", (F.col("cluster") % 10) / 10.0)


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, round(q, 8) AS l_quantity_t, round(i, 8) AS intercept_t FROM {GLS}")
def gls_transform(spark, sf):
    d = exact.gls_transform(scan(spark, sf, "lineitem"), ["l_quantity"], "l_suppkey", shares(spark, sf))
    return rounded(d.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity_t", "intercept_t"), 8, "l_quantity_t", "intercept_t")


@query(f"SELECT unnest([0, 0, 1, 0, 1, -1]) AS i, unnest([0, 1, 1, -1, -1, -1]) AS j, unnest([round(sum(d * d), 1), round(sum(d * i), 1), round(sum(i * i), 1), round(sum(d * q), 1), round(sum(i * q), 1), round(sum(q * q), 1)]) AS value FROM {GLS}")
def lmm_gram(spark, sf):
    got = exact.gls_gram(scan(spark, sf, "lineitem"), ["l_discount"], "l_quantity", "l_suppkey", shares(spark, sf), GUARD)
    return rounded(got, 1, "value")


@query(f"SELECT unnest([0, 0, 1, -2, -2]) AS i, unnest([0, 1, 1, 0, 1]) AS j, unnest([round(sum(d * d) / (a * a), 6), round(sum(d * i) / (a * b), 6), round(sum(i * i) / (b * b), 6), round(a, 4), round(b, 4)]) AS value FROM {GLS}, (SELECT sqrt(sum(d * d)) AS a, sqrt(sum(i * i)) AS b FROM {GLS}) GROUP BY a, b")
def lmm_gram_unit_length(spark, sf):
    got = exact.gls_gram(scan(spark, sf, "lineitem"), ["l_discount"], None, "l_suppkey", shares(spark, sf), GUARD, unit_length=True)
    return got.withColumn("value", F.when(F.col("i") == -2, F.round("value", 4)).otherwise(F.round("value", 6)))


@query("SELECT unnest([0, 0, 1, 0, 1, -1]) AS i, unnest([0, 1, 1, -1, -1, -1]) AS j, unnest([count(*)::DOUBLE, round(sum(l_discount), 4), round(sum(l_discount * l_discount), 4), round(sum(l_quantity), 4), round(sum(l_discount * l_quantity), 4), round(sum(l_quantity * l_quantity), 4)]) AS value FROM lineitem")
def single_cluster_gram(spark, sf):
    return rounded(exact.gram(scan(spark, sf, "lineitem"), [F.lit(1.0), F.col("l_discount")], F.col("l_quantity"), GUARD), 4, "value")


# ---- models --------------------------------------------------------------------------------------


def labelled(spark, sf):
    d = scan(spark, sf, "labels").join(scan(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return d.select(F.col("quality").cast("double").alias("q"), (F.col("n_chars") / 1000.0).alias("k"), F.col("toxic").cast("double").alias("y"))


LABELLED = "(SELECT quality::DOUBLE AS q, n_chars / 1000.0::DOUBLE AS k, toxic::DOUBLE AS y FROM labels JOIN documents USING (doc_id))"
LETA = "(-1.0 + 0.2 * q + 0.01 * k)"
MEANS = {"gaussian": LETA, "binomial": f"(1 / (1 + exp(-{LETA})))", "poisson": f"exp(least(8.0, greatest(-3.0, {LETA})))"}


def _gradient(family: str):
    m = MEANS[family]
    sql = f"SELECT unnest([0, 1, 2]) AS j, unnest([round(sum({m} - y), 5), round(sum(q * ({m} - y)), 5), round(sum(k * ({m} - y)), 5)]) AS value FROM {LABELLED}"

    def run(spark, sf):
        return rounded(models.gradient(labelled(spark, sf), [F.col("q"), F.col("k")], F.col("y"), family, [0.2, 0.01], -1.0), 5, "value")

    run.__name__ = f"glm_gradient_{family}"
    query(sql)(run)


for _family in MEANS:
    _gradient(_family)


@query(f"SELECT unnest([0, 1, 2]) AS j, unnest([round(sum(w * (m - y)), 4), round(sum(w * q * (m - y)), 4), round(sum(w * k * (m - y)), 4)]) AS value FROM (SELECT q, k, y, (1 + k) AS w, exp(least(8.0, greatest(-3.0, {LETA} + 0.01 * k))) AS m FROM {LABELLED})")
def glm_gradient_weighted(spark, sf):
    d = labelled(spark, sf).withColumn("w", F.lit(1.0) + F.col("k")).withColumn("o", F.lit(0.01) * F.least(F.col("k"), F.lit(1e6)))
    d = models.with_offset(models.with_weights(d, "w"), "o")
    return rounded(models.gradient(d, [F.col("q"), F.col("k")], F.col("y"), "poisson", [0.2, 0.01], -1.0, F.col("weight"), F.col("offset"), GUARD), 4, "value")


@query(f"SELECT unnest([0, 1, 2]) AS j, unnest([round(sum({MEANS['binomial']} - y), 5), round(sum(q * ({MEANS['binomial']} - y)), 5), round(sum(k * ({MEANS['binomial']} - y)), 5)]) AS value FROM {LABELLED}")
def glm_gradient_guarded(spark, sf):
    d = models.without_offset(models.with_offset(labelled(spark, sf).withColumn("o", F.lit(0.0)), "o"))
    return rounded(models.gradient(d, [F.col("q"), F.col("k")], F.col("y"), "binomial", [0.2, 0.01], -1.0, guard=GUARD), 5, "value")


@query("SELECT o_orderkey, round((CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) - exp(0.1 + 0.2 * o_totalprice / 500000.0) / (1 + exp(0.1 + 0.2 * o_totalprice / 500000.0) + exp(-0.3 + 0.1 * o_totalprice / 500000.0)), 10) AS r FROM orders")
def indicator_residuals(spark, sf):
    d = scan(spark, sf, "orders").withColumn("x", F.col("o_totalprice") / 500000.0)
    e = {k: F.exp(v) for k, v in models.multiple_eta([F.col("x")], {"F": [0.1, 0.2], "O": [-0.3, 0.1]}).items()}
    r = models.indicator_residual(F.col("o_orderstatus"), "F", e["F"] / (1 + e["F"] + e["O"]))
    return rounded(d.select("o_orderkey", r.alias("r")), 10, "r")


@query(f"SELECT event_id, round(least(5.0, greatest(-5.0, user_id / 100.0 - 3)) + least(5.0, greatest(-5.0, value / 50 - 2)), 8) AS eta, round(value + 2.5, 8) AS shifted FROM ({GAPS}) WHERE value IS NOT NULL")
def nb_predictor(spark, sf):
    d = models.nb_eta(with_gaps(spark, sf).select("event_id", "user_id", "value"), "value", F.col("user_id") / 100.0 - 3, F.col("value") / 50 - 2, GUARD)
    return rounded(d.select("event_id", "eta", models.nb_shifted(F.col("value"), 2.5).alias("shifted")), 8, "eta", "shifted")


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(l_quantity, 0) - 0.5 * l_discount - (1.0 + 0.2 * l_tax), 8) AS r, 1.0::DOUBLE AS intercept FROM lineitem")
def lmm_residuals(spark, sf):
    d = models.gee_intercept(scan(spark, sf, "lineitem"))
    r = models.lmm_residual(F.col("l_quantity"), 0.5 * F.col("l_discount"), F.col("intercept") + 0.2 * F.col("l_tax"))
    return rounded(d.select("l_orderkey", "l_linenumber", "l_partkey", r.alias("r"), "intercept"), 8, "r")


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_discount, 8) AS own, round(l_quantity + l_tax, 8) AS peer FROM lineitem")
def shaped_design(spark, sf):
    d = scan(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.array("l_discount", "l_quantity", "l_tax").alias("x"))
    d = models.shaped(d, 1, 2)
    return rounded(d.select("l_orderkey", "l_linenumber", "l_partkey", models.column("own", 0).alias("own"), (models.column("peer", 0) + models.column("peer", 1)).alias("peer")), 8, "own", "peer")


GLM = GlmSpec("poisson", "l_quantity", ("l_tax", "l_discount"), {"l_quantity": (0.0, 50.0), "l_tax": (0.0, 0.05), "l_discount": (0.0, 1.0)}, grid_bits=16, block_rows=1000)


@query("SELECT position // 1000 AS block, position, 65536::BIGINT AS weight, 65536 + round_even(l_discount * 65536.0, 0)::BIGINT + 3 * round_even(least(l_tax, 0.05) * 65536.0, 0)::BIGINT AS x, round_even(l_quantity * 65536.0, 0)::BIGINT AS y, 0::BIGINT AS offset FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate) - 1 AS position FROM lineitem)")
def glm_source_rows(spark, sf):
    rows = align.row_positions(scan(spark, sf, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate"], "position")
    d = models.glm_block(rows, GLM, "position")
    return d.withColumn("x", models.column("x", 0) + models.column("x", 1) + 3 * models.column("x", 2))


@query(f"SELECT round(sum(pow(y - {LETA}, 2)), 6) AS rss, round(sum(greatest({LETA}, 0.0) + ln(1 + exp(-abs({LETA})))), 6) AS sum_softplus, round(sum(y * {LETA}), 6) AS sum_y_eta, round(sum({MEANS['poisson']}), 6) AS sum_mu, round(sum(CASE WHEN y > 0 THEN y * ln(y) ELSE 0 END - y), 6) AS null_term FROM {LABELLED}")
def glm_deviance(spark, sf):
    d, y, eta = labelled(spark, sf), F.col("y"), scalar.linear([F.col("q"), F.col("k")], [0.2, 0.01], -1.0)
    parts = [models.deviance_sums(d, y, eta, f) for f in ("gaussian", "binomial", "poisson")]
    whole = parts[0].crossJoin(parts[1]).crossJoin(parts[2].drop("sum_y_eta"))  # single rows
    return rounded(whole, 6, *whole.columns)


@query("SELECT round(sum(l_discount * (25.5 - l_quantity)), 4) AS sum_wr, round(sum(sqrt(abs(l_discount)) * (25.5 - l_quantity)), 4) AS sum_rwr, round(sum(l_discount), 4) AS sum_w FROM lineitem")
def weighted_residual(spark, sf):
    d = models.weighted_sums(scan(spark, sf, "lineitem"), F.col("l_quantity"), F.lit(25.5), F.abs("l_discount"))
    return rounded(d, 4, *d.columns)


RISK_ROWS = f"SELECT t AS stop, outcome = 'error' AS died, (user_id % 2)::DOUBLE AS x FROM ({SURVIVAL})"
GRID_SQL = f"(SELECT unnest({[float(g) for g in DAYS]}) AS tick)"
LAST = "tick = (CASE " + " ".join(f"WHEN stop >= {g} THEN {g}" for g in reversed(DAYS)) + " END)"
RISK = f"SELECT tick::DOUBLE AS tick, count(stop) AS at_risk, count(*) FILTER (WHERE died AND {LAST}) AS events, coalesce(sum(CASE WHEN died AND {LAST} THEN x ELSE 0 END), 0) AS sum_x, coalesce(round(sum(exp(0.3 * x)), 8), 0) AS s0, coalesce(round(sum(exp(0.3 * x) * x), 8), 0) AS s1, coalesce(round(sum(exp(0.3 * x) * x * x), 8), 0) AS s2 FROM {GRID_SQL} LEFT JOIN ({RISK_ROWS}) ON stop >= tick GROUP BY 1"


def risk(spark, sf):
    u = survival_units(spark, sf).where("valid")
    return windows.risk_sums(u, F.lit(-1.0), F.col("time"), F.col("outcome") == "error", (F.col("unit") % 2).cast("double"), 0.3, DAYS)


@query(RISK)
def cox_risk_sets(spark, sf):
    return rounded(risk(spark, sf), 8, "s0", "s1", "s2")


@query(f"SELECT round(sum(0.3 * sum_x - events * ln(s0)), 5) AS loglik, round(sum(sum_x - events * s1 / s0), 5) AS score, round(sum(events * (s2 / s0 - (s1 / s0) * (s1 / s0))), 5) AS information FROM ({RISK}) WHERE events > 0")
def cox_score(spark, sf):
    got = models.cox_parts(risk(spark, sf), 0.3)
    return rounded(spark.createDataFrame([tuple(map(float, got))], "loglik double, score double, information double"), 5, "loglik", "score", "information")


COX = CoxSpec((1.0, 2.0, 3.0, 4.0, 5.0, 6.0), {"x1": (0.0, 1.0), "x2": (-1.0, 1.0)}, 1 << 20, 2.0, 3.0, ridge=1e-6)


def cox_table(spark, sf):
    """Users on the grid of their days: entry, stop, status and two covariates; every thirteenth is out of bounds."""
    u = survival_units(spark, sf).where("valid")
    stop = scalar.bin_right_closed(F.col("time"), DAYS[:-1])
    x2 = F.when(F.col("unit") % 13 == 0, F.lit(5.0)).otherwise((F.col("unit") % 5) / 4.0 - 0.5)
    rows = u.select("unit", F.lit(True).alias("valid"), F.lit(0).alias("entry_index"), stop.alias("stop_index"), (F.col("outcome") == "error").cast("int").alias("status"), (F.col("unit") % 2).cast("double").alias("x1"), x2.cast("double").alias("x2"))
    return models.cox_rows(rows, ["x1", "x2"], COX)


COX_ROWS = f"SELECT user_id AS unit, user_id % 13 <> 0 AS valid, CASE WHEN user_id % 13 <> 0 THEN {bins('t', DAYS)} ELSE 1 END AS stop_index, CASE WHEN user_id % 13 <> 0 AND outcome = 'error' THEN 1 ELSE 0 END AS status, CASE WHEN user_id % 13 <> 0 THEN (user_id % 2)::DOUBLE ELSE 0 END AS x1, CASE WHEN user_id % 13 <> 0 THEN (user_id % 5) / 4.0::DOUBLE - 0.5 ELSE 0 END AS x2 FROM ({SURVIVAL})"


@query(f"SELECT unit, valid, stop_index::INTEGER AS stop_index, status, x1, x2 FROM ({COX_ROWS})")
def cox_source_rows(spark, sf):
    return cox_table(spark, sf).select("unit", "valid", "stop_index", "status", "x1", "x2")


COX_SUMS = f"SELECT tick, count(*) FILTER (WHERE status = 1 AND stop_index = tick) AS d, sum(x1) FILTER (WHERE status = 1 AND stop_index = tick) AS e1, sum(x2) FILTER (WHERE status = 1 AND stop_index = tick) AS e2, sum(w) AS s0, sum(w * x1) AS a, sum(w * x2) AS b, sum(w * x1 * x1) AS aa, sum(w * x1 * x2) AS ab, sum(w * x2 * x2) AS bb FROM (SELECT unnest(range(1, 7)) AS tick) JOIN (SELECT *, exp(0.2 * x1 - 0.1 * x2) AS w FROM ({COX_ROWS}) WHERE valid) ON stop_index >= tick GROUP BY 1"


@query(f"SELECT round(sum(0.2 * e1 - 0.1 * e2 - d * ln(s0)) - 1048576 * 1e-6 * 0.025, 4) AS loglik, round(sum(e1 - d * a / s0) - 1048576 * 1e-6 * 0.2, 4) AS score1, round(sum(e2 - d * b / s0) + 1048576 * 1e-6 * 0.1, 4) AS score2, round(sum(d * (aa / s0 - a * a / s0 / s0)) + 1048576 * 1e-6, 4) AS i11, round(sum(d * (ab / s0 - a * b / s0 / s0)), 4) AS i12, round(sum(d * (bb / s0 - b * b / s0 / s0)) + 1048576 * 1e-6, 4) AS i22 FROM ({COX_SUMS}) WHERE d > 0")
def cox_vector_score(spark, sf):
    value, score, info = models.cox_at(cox_table(spark, sf), ["x1", "x2"], [0.2, -0.1], COX)
    row = (value, *score, info[0, 0], info[0, 1], info[1, 1])
    d = spark.createDataFrame([tuple(map(float, row))], "loglik double, score1 double, score2 double, i11 double, i12 double, i22 double")
    return rounded(d, 4, *d.columns)


@query("SELECT true AS stationary, false AS on_boundary, true AS curved")
def cox_bounded_fit(spark, sf):
    """Whether the fit is where the penalised score vanishes, within the bound, and identified."""
    d = cox_table(spark, sf)
    got = models.fit_cox_bounded(d, ["x1", "x2"], COX)
    score = models.cox_at(d, ["x1", "x2"], got["beta"].tolist(), COX)[1]
    return spark.createDataFrame([(bool(abs(score).max() < 1e-6), bool(got["on_boundary"]), bool(got["least_curvature"] > 1e-9))], "stationary boolean, on_boundary boolean, curved boolean")


@query()
def cox_private_fit(spark, sf):
    draws = [[noise.normal(noise.Stream(SECRET, "cox-1", 2 * i + j)) for j in range(2)] for i in range(COX.iterations)]
    beta = models.fit_cox_private(cox_table(spark, sf), ["x1", "x2"], COX, np.array(draws))
    return spark.createDataFrame([tuple(map(float, beta))], "b1 double, b2 double")


@query("SELECT unnest([false, true]) AS delayed, unnest([round(4 * 2.0 / n + exp(12.0) * 8.0 * ln(n + 1) / n, 8), round(4 * 2.0 / n + exp(12.0) * 8.0, 6)]) AS sensitivity FROM (SELECT 1048576.0::DOUBLE AS n)")
def cox_sensitivity(spark, sf):
    rows = [(delayed, round(models.cox_sensitivity(replace(COX, delayed=delayed))[0], 6 if delayed else 8)) for delayed in (False, True)]
    return spark.createDataFrame(rows, "delayed boolean, sensitivity double")


@query(f"SELECT unit, tick, (t = tick AND outcome = 'error')::INTEGER AS event FROM (SELECT user_id AS unit, outcome, floor(t) AS t FROM ({SURVIVAL})) JOIN (SELECT DISTINCT floor(t) AS tick FROM ({SURVIVAL}) WHERE outcome = 'error') ON t >= tick")
def event_time_mask(spark, sf):
    u = survival_units(spark, sf).where("valid").withColumn("time", F.floor("time").cast("double"))
    return windows.event_time_mask(u, "time", F.col("outcome") == "error").select("unit", "tick", "event")


@query(f"SELECT user_id AS unit, bin::INTEGER AS bin, (bin <= b)::INTEGER AS at_risk, (died AND bin = b)::INTEGER AS event FROM (SELECT user_id, outcome = 'error' AS died, {bins('t', DAYS)} AS b FROM ({SURVIVAL})), (SELECT unnest(range(1, 7)) AS bin)")
def person_period(spark, sf):
    d = windows.person_periods(survival_units(spark, sf).where("valid"), "time", F.col("outcome") == "error", DAYS)
    windows.check_risk_sets(d, GUARD)
    return d.select("unit", "bin", "at_risk", "event")


ORDERED = "l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice"


def _running(name: str, strata: str, reverse: bool, mask: str | None = None):
    frame = "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING" if reverse else "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    within = f"PARTITION BY {strata} " if strata else ""
    term = f"CASE WHEN {mask} THEN l_quantity ELSE 0 END" if mask else "l_quantity"
    sql = f"SELECT l_orderkey, l_partkey, l_linenumber, sum({term}) OVER ({within}ORDER BY {ORDERED}, l_orderkey {frame}) AS running FROM lineitem"

    def run(spark, sf):
        own = F.expr(f"CAST({mask} AS INT)") if mask else None
        d = windows.running_sum(scan(spark, sf, "lineitem"), F.col("l_quantity"), [*ORDERED.split(", "), "l_orderkey"], strata.split(", ") if strata else None, reverse, mask=own)
        return d.select("l_orderkey", "l_partkey", "l_linenumber", "running")

    run.__name__ = name
    query(sql)(run)


_running("cumsum_forward", "", False)
_running("cumsum_reverse", "", True)
_running("cumsum_stratified", "l_returnflag", False)
_running("cumsum_stratified_reverse", "l_returnflag, l_linestatus", True)
_running("cumsum_masked", "l_suppkey", False, "l_returnflag = 'R'")


@query("SELECT l_shipdate AS key, sum(sum(l_quantity)) OVER (ORDER BY l_shipdate DESC) AS quantity FROM lineitem GROUP BY 1")
def risk_set_totals(spark, sf):
    return windows.grouped_running_sum(scan(spark, sf, "lineitem"), "l_shipdate", {"quantity": F.col("l_quantity")}, reverse=True)


W = f"(PARTITION BY l_orderkey ORDER BY {ORDERED})"


@query(f"SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, coalesce(lag(l_quantity) OVER {W}, 0) AS lag, coalesce(lead(l_quantity) OVER {W}, 0) AS lead, CASE WHEN lag(1) OVER {W} IS NOT NULL THEN l_quantity ELSE 0 END AS nonfirst, CASE WHEN lead(1) OVER {W} IS NOT NULL THEN l_quantity ELSE 0 END AS nonlast, CASE WHEN lag(1) OVER {W} IS NOT NULL AND lead(1) OVER {W} IS NOT NULL THEN l_quantity ELSE 0 END AS interior FROM lineitem")
def ar1_lead_lag(spark, sf):
    d = scan(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", *[c for c in ORDERED.split(", ") if c != "l_linenumber"])
    windows.check_strict_order(d, "l_orderkey", ORDERED.split(", "))
    return windows.neighbours(d, "l_orderkey", ORDERED.split(", "), "l_quantity").drop("l_shipdate", "l_suppkey", "l_extendedprice")


BETAS = {"F": [0.1, 0.2], "O": [-0.3, 0.1]}
SM = {k: f"exp({b[0]} + {b[1]} * x)" for k, b in BETAS.items()}
SMD = f"(1 + {SM['F']} + {SM['O']})"


@query(f"SELECT unnest(['F', 'F', 'O', 'O']) AS level, unnest([0, 1, 0, 1]) AS j, unnest([{', '.join(f'''round(sum({x} * ({SM[k]} / {SMD} - CASE WHEN o_orderstatus = '{k}' THEN 1 ELSE 0 END)), 4)''' for k in BETAS for x in ('1', 'x'))}]) AS value FROM (SELECT o_orderstatus, o_totalprice / 500000.0 AS x FROM orders)")
def multinomial_gradient(spark, sf):
    d = scan(spark, sf, "orders").withColumn("x", F.col("o_totalprice") / 500000.0)
    return rounded(models.softmax_gradient(d, [F.col("x")], F.col("o_orderstatus"), ["F", "O"], BETAS), 4, "value")


@query("SELECT substr(o_orderpriority, 1, 1)::INTEGER AS class, count(*) AS n FROM orders GROUP BY 1")
def ordinal_classes(spark, sf):
    held = [F.col("o_orderpriority") <= p for p in PRIORITIES[:-1]]
    return scan(spark, sf, "orders").groupBy(models.ordinal_class(held).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM ({GAPS}))), 8) AS filled FROM ({GAPS})")
def impute_mean(spark, sf):
    return rounded(models.impute_mean(with_gaps(spark, sf), "value", "filled").select("event_id", "filled"), 8, "filled")


TYPED = "(SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type FROM events)"


@query(f"SELECT event_id, coalesce(event_type, (SELECT event_type FROM {TYPED} WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1)) AS filled FROM {TYPED}")
def impute_mode(spark, sf):
    d = scan(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("event_type"))
    return models.impute_mode(d, "event_type", "filled").select("event_id", "filled")


@query()
def impute_ridge(spark, sf):
    d = scan(spark, sf, "lineitem").withColumn("id", F.xxhash64("l_orderkey", "l_partkey", "l_linenumber")).withColumn("l_quantity", F.when(F.col("id") % 5 != 0, F.col("l_quantity")))
    return models.impute_ridge(d, "l_quantity", ["l_extendedprice", "l_discount"], "id", "filled").select("l_orderkey", "l_partkey", "l_linenumber", "filled")


HOLES = "(SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice / 1000 AS x, CASE WHEN l_partkey % 5 <> 0 THEN l_quantity END AS y FROM lineitem)"


@query(f"SELECT l_orderkey, l_partkey, l_linenumber, round(coalesce(y, b0 + b1 * x), 5) AS filled FROM {HOLES}, (SELECT (sy * (sxx + 1) - sx * sxy) / (n * (sxx + 1) - sx * sx) AS b0, (n * sxy - sx * sy) / (n * (sxx + 1) - sx * sx) AS b1 FROM (SELECT count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM {HOLES} WHERE y IS NOT NULL))")
def impute_ridge_mean(spark, sf):
    d = scan(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", (F.col("l_extendedprice") / 1000).alias("x"), F.when(F.col("l_partkey") % 5 != 0, F.col("l_quantity")).alias("y"))
    return rounded(models.impute_ridge(d, "y", ["x"], "l_orderkey", "filled", sigma=0.0).select("l_orderkey", "l_partkey", "l_linenumber", "filled"), 5, "filled")


@query()
def impute_classes(spark, sf):
    d = scan(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 100000).alias("x"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("level"))
    return models.impute_class(d, "level", ["x"], "o_orderkey", "filled").select("o_orderkey", "filled")


@query()
def impute_binary(spark, sf):
    d = scan(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", F.when(F.col("l_orderkey") % 4 != 0, F.col("l_linestatus")).alias("level"))
    return models.impute_class(d, "level", ["l_quantity"], "l_orderkey", "filled").select("l_orderkey", "l_partkey", "l_linenumber", "filled")


@query("SELECT round(regr_intercept(l_extendedprice, l_quantity), 4) AS b0, round(regr_slope(l_extendedprice, l_quantity), 6) AS b1 FROM lineitem")
def glm_fit_gaussian(spark, sf):
    b = models.fit_glm(scan(spark, sf, "lineitem"), [F.col("l_quantity")], F.col("l_extendedprice"))
    return rounded(rounded(spark.createDataFrame([tuple(map(float, b))], "b0 double, b1 double"), 4, "b0"), 6, "b1")


@query("WITH t AS (SELECT quality AS q, avg(toxic) AS p FROM labels GROUP BY 1), l AS (SELECT q, ln(p / (1 - p)) AS z FROM t) SELECT round((SELECT z FROM l WHERE q = 0), 6) AS b0, round((SELECT z FROM l WHERE q = 1) - (SELECT z FROM l WHERE q = 0), 6) AS b1")
def glm_fit_binomial(spark, sf):
    b = models.fit_glm(scan(spark, sf, "labels"), [F.col("quality").cast("double")], F.col("toxic").cast("double"), "binomial")
    return rounded(spark.createDataFrame([tuple(map(float, b))], "b0 double, b1 double"), 6, "b0", "b1")


@query()
def nb_fit_theta(spark, sf):
    d = scan(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame([(float(models.fit_nb_theta(d, F.pow(F.col("n"), 2).cast("double"))),)], "theta double")


@query()
def cox_fit(spark, sf):
    u = survival_units(spark, sf).where("valid")
    b = models.fit_cox(u, F.lit(-1.0), F.col("time"), F.col("outcome") == "error", (F.col("unit") % 2).cast("double"), DAYS)
    return spark.createDataFrame([(float(b),)], "beta double")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All exact blocks of a two-owner cohort as one vector of coordinates."""
    return capsule_vector(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


