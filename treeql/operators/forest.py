"""Trees from parent/child tables: any hierarchy of keyed tables becomes `nodes`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..partitions import dealt


def customer_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree per customer: customer > orders > line items, in key order.

    Preorder numbers come from windows within a customer, so the whole forest takes one shuffle by customer after the join of orders with
    items. Types: customer (text: segment), order (text: status, field: priority's first digit as `p1` ..), item (text: return flag, field: line status). Every
    node takes two bytes before its subtree's end, so that spans nest.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    items = read("lineitem").select(F.col("l_orderkey").alias("okey"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_extendedprice")
    items = dealt(items, "okey")
    orders = read("orders").select(F.col("o_orderkey").alias("okey"), F.col("o_custkey").alias("doc_id"), "o_orderstatus", "o_orderpriority")
    per_order = items.groupBy("okey").agg(F.count("*").alias("n_items"))
    orders = orders.join(per_order, "okey", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)))
    earlier = Window.partitionBy("doc_id").orderBy("okey").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("doc_id")
    orders = orders.withColumns({
        "k": F.row_number().over(Window.partitionBy("doc_id").orderBy("okey")) - 1,
        "node_id": F.coalesce(F.sum(F.col("n_items") + 1).over(earlier), F.lit(0)) + 1,
        "total": F.sum(F.col("n_items") + 1).over(whole), "n_orders": F.count("*").over(whole),
    })
    at_item = Window.partitionBy("okey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    items = items.withColumn("k", F.row_number().over(at_item) - 1)
    items = items.join(orders.select("okey", "doc_id", F.col("node_id").alias("order_id")), "okey")
    customers = read("customer").select(F.col("c_custkey").alias("doc_id"), "c_mktsegment")
    counted = orders.groupBy("doc_id").agg(F.first("total").alias("total"), F.first("n_orders").alias("n_orders"))
    customers = customers.join(counted, "doc_id", "left").fillna(0, ["total", "n_orders"])

    def rows(df, node_id, parent, k, depth, last, kind, field, children, text):
        as_int = lambda c: F.lit(c).cast("int") if not isinstance(c, F.Column) else c.cast("int")
        return df.select(
            F.col("doc_id").cast("long").alias("doc_id"), as_int(node_id).alias("node_id"), as_int(parent).alias("parent_id"), as_int(k).alias("child_index"),
            (as_int(k) if depth else F.lit(None).cast("int")).alias("named_index"), F.lit(depth).alias("depth"), as_int(last).alias("last_desc"), F.lit(kind).alias("type"), F.lit(True).alias("is_named"),
            F.lit(False).alias("is_extra"), F.lit(False).alias("is_missing"), F.lit(False).alias("is_error"), F.lit(False).alias("has_error"),
            (field if isinstance(field, F.Column) else F.lit(field).cast("string")).alias("field"), (as_int(node_id) * 2).alias("start_byte"), (as_int(last) * 2 + 2).alias("end_byte"),
            F.lit(0).alias("start_row"), (as_int(node_id) * 2).alias("start_col"), F.lit(0).alias("end_row"), (as_int(last) * 2 + 2).alias("end_col"),
            as_int(children).alias("child_count"), as_int(children).alias("named_child_count"), text.alias("text"),
        )

    null = F.lit(None).cast("int")
    roots = rows(customers, F.lit(0), null, F.lit(0), 0, F.col("total"), "customer", None, F.col("n_orders"), F.col("c_mktsegment"))
    middle = rows(orders, F.col("node_id"), F.lit(0), F.col("k"), 1, F.col("node_id") + F.col("n_items"), "order", F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)), F.col("n_items"), F.col("o_orderstatus"))
    leaves = rows(items, F.col("order_id") + 1 + F.col("k"), F.col("order_id"), F.col("k"), 2, F.col("order_id") + 1 + F.col("k"), "item", F.concat(F.lit("s"), F.col("l_linestatus")), F.lit(0), F.col("l_returnflag"))
    return roots.unionByName(middle).unionByName(leaves)
