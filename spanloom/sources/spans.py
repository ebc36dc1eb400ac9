"""The span relation: schema, reading, writing, and spans derived from the order tables.

Nanoseconds are longs (Spark's timestamps hold microseconds); ``date`` is the partition column. Attribute values are
strings, as in the data model that is queried; numbers are coerced where a query needs them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MAP = T.MapType(T.StringType(), T.StringType())

SPAN_SCHEMA = T.StructType(
    [
        T.StructField("trace_id", T.StringType(), False),
        T.StructField("span_id", T.StringType(), False),
        T.StructField("parent_span_id", T.StringType(), False),  # '' at the root
        T.StructField("trace_state", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("kind", T.StringType()),  # SPAN_KIND_*
        T.StructField("service", T.StringType()),
        T.StructField("resource_attributes", _MAP),
        T.StructField("scope_name", T.StringType()),
        T.StructField("scope_version", T.StringType()),
        T.StructField("span_attributes", _MAP),
        T.StructField("start_ns", T.LongType()),
        T.StructField("duration_ns", T.LongType()),
        T.StructField("status", T.StringType()),  # STATUS_CODE_*
        T.StructField("status_message", T.StringType()),
        T.StructField("events", T.ArrayType(T.StructType([T.StructField("time_ns", T.LongType()), T.StructField("name", T.StringType()), T.StructField("attributes", _MAP)]))),
        T.StructField("links", T.ArrayType(T.StructType([T.StructField("trace_id", T.StringType()), T.StructField("span_id", T.StringType()), T.StructField("trace_state", T.StringType()), T.StructField("attributes", _MAP)]))),
        T.StructField("date", T.DateType()),
    ]
)

NS_PER_DAY = 86_400_000_000_000


def date_of(ns: Column) -> Column:
    return F.date_from_unix_date(F.floor(ns / F.lit(NS_PER_DAY)).cast("int"))


def read_spans(spark: SparkSession, path: str, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """Spans from Parquet; the range is inclusive and prunes date partitions as well as row groups."""
    return in_range(spark.read.schema(SPAN_SCHEMA).parquet(path), start_ns, end_ns)


def in_range(spans: DataFrame, start_ns: int | None, end_ns: int | None) -> DataFrame:
    """Spans that start in the range, both ends included; an open end is None."""
    for bound, keep in ((start_ns, lambda c, d, v: (c >= v) & (d >= _day(v))), (end_ns, lambda c, d, v: (c <= v) & (d <= _day(v)))):
        if bound is not None:
            spans = spans.where(keep(F.col("start_ns"), F.col("date"), bound))
    return spans


def _day(ns: int) -> Column:
    return F.date_from_unix_date(F.lit(ns // NS_PER_DAY))


def write_spans(spans: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by date, sorted by service, name and start in each file, with a bloom filter on the trace id."""
    spans = spans.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in SPAN_SCHEMA])
    spread = spans.repartitionByRange("date", "service", "name", "start_ns").sortWithinPartitions("date", "service", "name", "start_ns")
    spread.write.mode(mode).partitionBy("date").option("parquet.bloom.filter.enabled#trace_id", "true").parquet(path)


def zip_nested(raw: DataFrame) -> DataFrame:
    """Parallel arrays (event_times, event_names, event_attributes; link_trace_ids, ...) to arrays of structs."""
    events = F.transform(F.arrays_zip("event_times", "event_names", "event_attributes"), lambda e: F.struct(e["event_times"].alias("time_ns"), e["event_names"].alias("name"), e["event_attributes"].alias("attributes")))
    links = F.transform(
        F.arrays_zip("link_trace_ids", "link_span_ids", "link_trace_states", "link_attributes"),
        lambda e: F.struct(e["link_trace_ids"].alias("trace_id"), e["link_span_ids"].alias("span_id"), e["link_trace_states"].alias("trace_state"), e["link_attributes"].alias("attributes")),
    )
    parts = [f"event_{x}" for x in ("times", "names", "attributes")] + [f"link_{x}" for x in ("trace_ids", "span_ids", "trace_states", "attributes")]
    return raw.withColumn("events", events).withColumn("links", links).drop(*parts)


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans from ``orders`` (roots) and ``lineitem`` (a heap-shaped tree below each root); see ``ORDER_SPANS_SQL``."""
    orders, lines = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key, none = F.col("o_orderkey"), F.array().cast(SPAN_SCHEMA["links"].dataType)
    http = F.element_at(F.array(*[F.lit(m) for m in ("GET", "POST", "PUT")]), (F.pmod(key, F.lit(3)) + 1).cast("int"))
    failed = F.col("o_orderstatus") == "F"
    begin = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(o_orderdate AS TIMESTAMP_NTZ))") * 1000

    def resource(service: Column, key: Column) -> Column:
        env = F.when(F.pmod(key, F.lit(4)) == 0, "staging").otherwise("production")
        return F.create_map(F.lit("service.name"), service, F.lit("deployment.environment"), env, F.lit("host.name"), F.format_string("host-%d", F.pmod(key, F.lit(16))))

    link = F.struct(F.format_string("%032x", key - 1).alias("trace_id"), F.format_string("%012x%04x", key - 1, F.lit(0)).alias("span_id"), F.lit("").alias("trace_state"), F.create_map(F.lit("link.reason"), F.lit("previous")).alias("attributes"))
    roots = orders.select(
        F.format_string("%032x", key).alias("trace_id"),
        F.format_string("%012x%04x", key, F.lit(0)).alias("span_id"),
        F.lit("").alias("parent_span_id"),
        F.lit("").alias("trace_state"),
        F.concat(http, F.lit(" /orders")).alias("name"),
        F.lit("SPAN_KIND_SERVER").alias("kind"),
        F.lit("gateway").alias("service"),
        resource(F.lit("gateway"), key).alias("resource_attributes"),
        F.lit("http").alias("scope_name"),
        F.lit("1.0").alias("scope_version"),
        F.create_map(F.lit("http.method"), http, F.lit("http.status_code"), F.when(failed, "500").otherwise("200"), F.lit("priority"), F.col("o_orderpriority")).alias("span_attributes"),
        begin.alias("start_ns"),
        (F.round(F.col("o_totalprice") * 100).cast("long") * 100).alias("duration_ns"),
        F.when(failed, "STATUS_CODE_ERROR").otherwise("STATUS_CODE_OK").alias("status"),
        F.when(failed, "order failed").otherwise("").alias("status_message"),
        F.array().cast(SPAN_SCHEMA["events"].dataType).alias("events"),
        F.when(F.pmod(key, F.lit(10)) == 0, F.array(link)).otherwise(none).alias("links"),
    )
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax")
    j = lines.withColumn("rn", F.row_number().over(order)).join(orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == key)
    service = F.format_string("svc-%d", F.pmod("l_suppkey", F.lit(8)))
    start, length = begin + F.col("rn") * 1_000_000, F.round(F.col("l_extendedprice") * 100).cast("long") * 100
    returned = F.col("l_returnflag") == "R"
    base = F.create_map(F.lit("quantity"), F.col("l_quantity").cast("long").cast("string"), F.lit("linenumber"), F.col("l_linenumber").cast("string"), F.lit("returnflag"), F.col("l_returnflag"))
    extra = F.map_concat(base, F.create_map(F.lit("discount"), F.format_string("%.2f", "l_discount")))
    event = F.struct((start + F.expr("1000 * (l_suppkey % 100)")).alias("time_ns"), F.lit("exception").alias("name"), F.create_map(F.lit("exception.type"), F.lit("Returned")).alias("attributes"))
    children = j.select(
        F.format_string("%032x", key).alias("trace_id"),
        F.format_string("%012x%04x", key, "rn").alias("span_id"),
        F.format_string("%012x%04x", key, F.floor(F.col("rn") / 2)).alias("parent_span_id"),
        F.lit("").alias("trace_state"),
        F.when(F.col("l_linestatus") == "O", "db.query").otherwise("process").alias("name"),
        F.when(F.col("l_linestatus") == "O", "SPAN_KIND_CLIENT").otherwise("SPAN_KIND_INTERNAL").alias("kind"),
        service.alias("service"),
        resource(service, key).alias("resource_attributes"),
        F.lit("db").alias("scope_name"),
        F.lit("2.0").alias("scope_version"),
        F.when(F.col("l_discount") > 0.05, extra).otherwise(base).alias("span_attributes"),
        start.alias("start_ns"),
        length.alias("duration_ns"),
        F.when(returned, "STATUS_CODE_ERROR").when(F.col("l_returnflag") == "A", "STATUS_CODE_OK").otherwise("STATUS_CODE_UNSET").alias("status"),
        F.when(returned, "returned").otherwise("").alias("status_message"),
        F.when(returned, F.array(event)).otherwise(F.array().cast(SPAN_SCHEMA["events"].dataType)).alias("events"),
        none.alias("links"),
    )
    return roots.unionByName(children).withColumn("date", date_of(F.col("start_ns")))


#: The same spans in DuckDB, with the attributes as columns (null where a span has none).
ORDER_SPANS_SQL = """
lines AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) AS rn
  FROM lineitem),
spans AS (
  SELECT printf('%032x', o_orderkey) AS trace_id, printf('%012x%04x', o_orderkey, 0) AS span_id, '' AS parent_span_id,
    ['GET', 'POST', 'PUT'][1 + o_orderkey % 3] || ' /orders' AS name, 'SPAN_KIND_SERVER' AS kind, 'gateway' AS service,
    CASE WHEN o_orderkey % 4 = 0 THEN 'staging' ELSE 'production' END AS env, 'host-' || (o_orderkey % 16) AS host,
    'http' AS scope_name, '1.0' AS scope_version, ['GET', 'POST', 'PUT'][1 + o_orderkey % 3] AS http_method,
    CASE WHEN o_orderstatus = 'F' THEN '500' ELSE '200' END AS http_status_code, o_orderpriority AS priority,
    NULL::VARCHAR AS quantity, NULL::VARCHAR AS linenumber, NULL::VARCHAR AS returnflag, NULL::VARCHAR AS discount,
    epoch_us(o_orderdate) * 1000 AS start_ns, CAST(round(o_totalprice * 100) AS BIGINT) * 100 AS duration_ns,
    CASE WHEN o_orderstatus = 'F' THEN 'STATUS_CODE_ERROR' ELSE 'STATUS_CODE_OK' END AS status,
    CASE WHEN o_orderstatus = 'F' THEN 'order failed' ELSE '' END AS status_message,
    NULL::BIGINT AS event_ns, CASE WHEN o_orderkey % 10 = 0 THEN printf('%032x', o_orderkey - 1) END AS link_trace_id
  FROM orders
  UNION ALL
  SELECT printf('%032x', o_orderkey), printf('%012x%04x', o_orderkey, rn), printf('%012x%04x', o_orderkey, rn // 2),
    CASE WHEN l_linestatus = 'O' THEN 'db.query' ELSE 'process' END, CASE WHEN l_linestatus = 'O' THEN 'SPAN_KIND_CLIENT' ELSE 'SPAN_KIND_INTERNAL' END,
    'svc-' || (l_suppkey % 8), CASE WHEN o_orderkey % 4 = 0 THEN 'staging' ELSE 'production' END, 'host-' || (o_orderkey % 16),
    'db', '2.0', NULL, NULL, NULL, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), CAST(l_linenumber AS VARCHAR), l_returnflag,
    CASE WHEN l_discount > 0.05 THEN printf('%.2f', l_discount) END,
    epoch_us(o_orderdate) * 1000 + rn * 1000000, CAST(round(l_extendedprice * 100) AS BIGINT) * 100,
    CASE l_returnflag WHEN 'R' THEN 'STATUS_CODE_ERROR' WHEN 'A' THEN 'STATUS_CODE_OK' ELSE 'STATUS_CODE_UNSET' END,
    CASE l_returnflag WHEN 'R' THEN 'returned' ELSE '' END,
    CASE WHEN l_returnflag = 'R' THEN epoch_us(o_orderdate) * 1000 + rn * 1000000 + 1000 * (l_suppkey % 100) END, NULL
  FROM lines JOIN orders ON o_orderkey = l_orderkey)
"""
