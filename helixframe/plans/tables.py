"""The driver's tables seen as experiments: counts, expression, labels, annotations, hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse counts: orders as cells, brands as genes, quantities as values; dealt by cell, as most that follows needs it."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    entries = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("cell"), F.col("p_brand").alias("gene"), "l_quantity")
    return entries.repartition("cell").groupBy("cell", "gene").agg(F.sum("l_quantity").alias("value"))


def order_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with priority as perturbation, market segment as cell type, status as batch."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("cell"), F.col("o_orderpriority").alias("pert"), F.col("c_mktsegment").alias("cell_type"), F.col("o_orderstatus").alias("batch"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense signed expression: vectors as cells, dimensions as genes."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell"), "label", F.posexplode("embedding").alias("gene", "_v")).select("cell", "label", "gene", F.col("_v").cast("double").alias("value"))


def labelled(spark: SparkSession, sf_dir: str, label: int) -> DataFrame:
    return vectors(spark, sf_dir).filter(F.col("label") == label).select("cell", "gene", "value")


def user_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("cell"), F.col("event_type").alias("gene")).agg(F.count("*").cast("double").alias("value"))


def user_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("cell")).distinct()


def annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers annotated with the months and priorities of their orders."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_custkey").alias("source"), F.concat_ws("|", F.date_format("o_orderdate", "yyyy-MM"), "o_orderpriority").alias("target")).distinct()


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation, supplier and customer keys as parent and child."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("parent"), F.concat(F.lit("s"), "s_suppkey").alias("child"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.concat(F.lit("c"), "c_custkey").alias("child"))
    return n.union(s).union(c)


def ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector linked with the next and the one before."""
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    n = F.broadcast(e.agg((F.max("vec_id") + 1).alias("n")))
    both = e.crossJoin(n)
    forth = both.select(F.col("vec_id").alias("source"), F.pmod(F.col("vec_id") + 1, "n").alias("target"))
    return forth.union(forth.select("target", "source")).withColumn("weight", F.lit(1.0))


def aliases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customer names as aliases of nation names, which have one key each."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("alias"), F.col("n_name").alias("symbol")), n.select(F.col("n_name").alias("symbol"), F.col("n_nationkey").alias("id"))


def combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of one or two parts, some control."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("cell"),
        F.when(F.pmod("o_orderkey", F.lit(3)) == 0, F.col("o_orderpriority")).when(F.pmod("o_orderkey", F.lit(3)) == 1, F.concat("o_orderstatus", F.lit(" + "), "o_orderpriority")).otherwise(F.lit("control")).alias("label"),
    )


#: The same views for DuckDB, as common table expressions.
VIEWS = {
    "c1": "SELECT l_orderkey AS cell, p_brand AS gene, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "obs": "SELECT o_orderkey AS cell, o_orderpriority AS pert, c_mktsegment AS cell_type, o_orderstatus AS batch FROM orders JOIN customer ON o_custkey = c_custkey",
    "e1": "SELECT vec_id AS cell, label, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS gene, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings",
    "c2": "SELECT user_id AS cell, event_type AS gene, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1, 2",
    "ann": "SELECT DISTINCT o_custkey AS source, strftime(o_orderdate, '%Y-%m') || '|' || o_orderpriority AS target FROM orders",
    "dag": "SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer",
    "ring": "SELECT vec_id AS source, (vec_id + 1) % (SELECT max(vec_id) + 1 FROM embeddings) AS target, 1.0::DOUBLE AS weight FROM embeddings UNION ALL SELECT (vec_id + 1) % (SELECT max(vec_id) + 1 FROM embeddings), vec_id, 1.0 FROM embeddings",
    "combo": "SELECT o_orderkey AS cell, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderstatus || ' + ' || o_orderpriority ELSE 'control' END AS label FROM orders",
}


def sql(views: str, body: str, recursive: bool = False) -> str:
    """``body`` behind the named views, and behind its own WITH parts if it begins with a comma."""
    head = ", ".join(f"{v} AS MATERIALIZED ({VIEWS[v]})" for v in views.split())
    return f"WITH {'RECURSIVE ' if recursive else ''}{head} {body}"
