"""The driver's tables as the engine's: a graph of regions, nations, customers, suppliers, orders and parts; events as diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.adjacency import Stored, store
from ..storage import fresh_path


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def _node(df: DataFrame, kind: str, id_: Column, display: Column, path: Column, line: Column, documentation: Column, metadata: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    project = F.col("r_name") if "r_name" in df.columns else none
    owner = _id("project", "r_regionkey") if "r_regionkey" in df.columns else none
    return df.select(id_.alias("id"), F.lit(kind).alias("kind"), display.alias("display_name"), project.alias("project_name"), owner.alias("owning_project_id"), path.alias("file_path"), line.cast("int").alias("line"), documentation.alias("documentation_id"), metadata.alias("metadata_name"))


def build_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    none, no_line = F.lit(None).cast("string"), F.lit(None).cast("int")
    region, nation = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    customers = read(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    suppliers = read(spark, sf_dir, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    orders = read(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    folder = F.concat_ws("/", "r_name", "n_name")

    def file(name: str) -> Column:
        return F.concat(folder, F.lit("/"), F.col(name), F.lit(".src"))

    order_name = F.concat(F.lit("Order"), F.col("o_orderkey").cast("string"))
    parts = [
        _node(spark.range(1), "Solution", F.lit("solution:all"), F.lit("all"), F.lit("all.sln"), no_line, none, none),
        _node(region, "Project", _id("project", "r_regionkey"), F.col("r_name"), F.concat("r_name", F.lit("/"), "r_name", F.lit(".proj")), no_line, none, F.col("r_name")),
        _node(places, "Namespace", _id("namespace", "n_nationkey"), F.col("n_name"), none, no_line, F.concat(F.lit("N:"), "n_name"), F.col("n_name")),
        _node(customers, "Type", _id("type:c", "c_custkey"), F.col("c_name"), file("c_name"), F.lit(1), F.concat(F.lit("T:"), "n_name", F.lit("."), "c_name"), F.concat("n_name", F.lit("."), "c_name")),
        _node(suppliers, "Type", _id("type:s", "s_suppkey"), F.col("s_name"), file("s_name"), F.lit(1), F.concat(F.lit("T:"), "n_name", F.lit("."), "s_name"), F.concat("n_name", F.lit("."), "s_name")),
        _node(orders, "Method", _id("method", "o_orderkey"), order_name, file("c_name"), F.lit(10) + F.col("o_orderkey") % 1000, F.concat(F.lit("M:"), "n_name", F.lit("."), "c_name", F.lit("."), order_name), order_name),
        _node(read(spark, sf_dir, "part"), "Field", _id("field", "p_partkey"), F.col("p_name"), F.concat(F.lit("parts/"), "p_brand", F.lit(".src")), F.col("p_partkey") % 500, F.concat(F.lit("F:"), "p_name"), F.col("p_name")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def build_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def links(df: DataFrame, kind: str, source: Column, target: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), source.alias("source_id"), target.alias("target_id"))

    region, nation = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    customer, supplier, orders, lineitem = (read(spark, sf_dir, t) for t in ("customer", "supplier", "orders", "lineitem"))
    parts = [
        links(region, "contains", F.lit("solution:all"), _id("project", "r_regionkey")),
        links(nation, "contains", _id("project", "n_regionkey"), _id("namespace", "n_nationkey")),
        links(customer, "contains", _id("namespace", "c_nationkey"), _id("type:c", "c_custkey")),
        links(supplier, "contains", _id("namespace", "s_nationkey"), _id("type:s", "s_suppkey")),
        links(orders, "contains", _id("type:c", "o_custkey"), _id("method", "o_orderkey")),
        links(region.where("r_regionkey < 3"), "depends_on_project", _id("project", "r_regionkey"), F.concat(F.lit("project:"), ((F.col("r_regionkey") + 1) % 3).cast("string"))),
        links(region.where("r_regionkey = 3"), "depends_on_project", _id("project", "r_regionkey"), F.lit("project:0")),
        links(customer.where("c_custkey >= 10"), "inherits", _id("type:c", "c_custkey"), F.concat(F.lit("type:c"), F.lit(":"), F.floor(F.col("c_custkey") / 10).cast("string"))),
        links(customer.where("c_custkey % 7 = 0"), "implements", _id("type:c", "c_custkey"), F.concat(F.lit("type:s:"), (F.col("c_custkey") % 10 + 1).cast("string"))),
        links(lineitem.select("l_orderkey", "l_partkey").distinct(), "calls", _id("method", "l_orderkey"), _id("field", "l_partkey")),
        links(lineitem.select("l_partkey", "l_suppkey").distinct(), "registered_as", _id("field", "l_partkey"), _id("type:s", "l_suppkey")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_STORED: dict[tuple, DataFrame | Stored] = {}
GRAPH_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of the input files, by the file system that Spark reads them with."""
    hadoop, out = spark.sparkContext._jsc.hadoopConfiguration(), []
    for table in GRAPH_TABLES:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
        out += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in at.getFileSystem(hadoop).listStatus(at)]
    return tuple(out)


def _stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """The table as a snapshot in the shared folder, partitioned by kind; built once for each application and state of the input."""
    key = (spark.sparkContext.applicationId, sf_dir, name, _state(spark, sf_dir))
    if key not in _STORED:
        df, path = build(spark, sf_dir), fresh_path(spark, name)
        df.write.partitionBy("kind").parquet(path)
        _STORED[key] = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    return _STORED[key]


def forget(spark: SparkSession) -> None:
    """Drops the stored tables of this application, so that the next query builds them anew."""
    for key in [k for k in _STORED if k[0] == spark.sparkContext.applicationId]:
        del _STORED[key]


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "nodes", build_nodes)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "edges", build_edges)


def stored_edges(spark: SparkSession, sf_dir: str) -> Stored:
    """The edges stored by both ends; built once, as the tables are."""
    key = (spark.sparkContext.applicationId, sf_dir, "edges by end", _state(spark, sf_dir))
    if key not in _STORED:
        path = fresh_path(spark, "edges-by-end")
        store(edges(spark, sf_dir), path)
        _STORED[key] = Stored(spark, path)
    return _STORED[key]


#: The same two tables in SQL.
GRAPH_SQL = """
places AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey),
customers AS (SELECT * FROM customer JOIN places ON c_nationkey = n_nationkey),
suppliers AS (SELECT * FROM supplier JOIN places ON s_nationkey = n_nationkey),
nodes AS (
  SELECT 'solution:all' AS id, 'Solution' AS kind, 'all' AS display_name, NULL::VARCHAR AS project_name, NULL::VARCHAR AS owning_project_id, 'all.sln' AS file_path, NULL::INT AS line, NULL::VARCHAR AS documentation_id, NULL::VARCHAR AS metadata_name
  UNION ALL SELECT 'project:' || r_regionkey, 'Project', r_name, r_name, 'project:' || r_regionkey, r_name || '/' || r_name || '.proj', NULL, NULL, r_name FROM region
  UNION ALL SELECT 'namespace:' || n_nationkey, 'Namespace', n_name, r_name, 'project:' || r_regionkey, NULL, NULL, 'N:' || n_name, n_name FROM places
  UNION ALL SELECT 'type:c:' || c_custkey, 'Type', c_name, r_name, 'project:' || r_regionkey, r_name || '/' || n_name || '/' || c_name || '.src', 1, 'T:' || n_name || '.' || c_name, n_name || '.' || c_name FROM customers
  UNION ALL SELECT 'type:s:' || s_suppkey, 'Type', s_name, r_name, 'project:' || r_regionkey, r_name || '/' || n_name || '/' || s_name || '.src', 1, 'T:' || n_name || '.' || s_name, n_name || '.' || s_name FROM suppliers
  UNION ALL SELECT 'method:' || o_orderkey, 'Method', 'Order' || o_orderkey, r_name, 'project:' || r_regionkey, r_name || '/' || n_name || '/' || c_name || '.src', CAST(10 + o_orderkey % 1000 AS INT), 'M:' || n_name || '.' || c_name || '.Order' || o_orderkey, 'Order' || o_orderkey FROM orders JOIN customers ON o_custkey = c_custkey
  UNION ALL SELECT 'field:' || p_partkey, 'Field', p_name, NULL, NULL, 'parts/' || p_brand || '.src', CAST(p_partkey % 500 AS INT), 'F:' || p_name, p_name FROM part
),
edges AS (
  SELECT 'contains' AS kind, 'solution:all' AS source_id, 'project:' || r_regionkey AS target_id FROM region
  UNION ALL SELECT 'contains', 'project:' || n_regionkey, 'namespace:' || n_nationkey FROM nation
  UNION ALL SELECT 'contains', 'namespace:' || c_nationkey, 'type:c:' || c_custkey FROM customer
  UNION ALL SELECT 'contains', 'namespace:' || s_nationkey, 'type:s:' || s_suppkey FROM supplier
  UNION ALL SELECT 'contains', 'type:c:' || o_custkey, 'method:' || o_orderkey FROM orders
  UNION ALL SELECT 'depends_on_project', 'project:' || r_regionkey, 'project:' || ((r_regionkey + 1) % 3) FROM region WHERE r_regionkey < 3
  UNION ALL SELECT 'depends_on_project', 'project:3', 'project:0' FROM region WHERE r_regionkey = 3
  UNION ALL SELECT 'inherits', 'type:c:' || c_custkey, 'type:c:' || (c_custkey // 10) FROM customer WHERE c_custkey >= 10
  UNION ALL SELECT 'implements', 'type:c:' || c_custkey, 'type:s:' || (c_custkey % 10 + 1) FROM customer WHERE c_custkey % 7 = 0
  UNION ALL SELECT DISTINCT 'calls', 'method:' || l_orderkey, 'field:' || l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 'registered_as', 'field:' || l_partkey, 'type:s:' || l_suppkey FROM lineitem
)"""


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as diagnostics of a document for each user: severity by type, time as position."""
    e = read(spark, sf_dir, "events")
    severity = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 3).otherwise(4)
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    return e.select("event_id", F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("uri"), severity.alias("severity"), F.col("event_type").alias("code"), F.lit("events").alias("source"), at.alias("start_line"), F.lit(0).alias("start_char"), at.alias("end_line"), F.lit(0).alias("end_char"), F.coalesce("props", F.lit("")).alias("message"))


DIAGNOSTICS_SQL = """
diagnostics AS (
  SELECT event_id, 'user/' || user_id AS uri, CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS severity,
         event_type AS code, 'events' AS source, CAST(floor(epoch(ts)) AS BIGINT) AS start_line, 0 AS start_char
  FROM events
)"""
