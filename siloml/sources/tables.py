"""Scanning input tables and preparing the sample risk table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

# The credit-default file's columns in file order.
CREDIT_INTS_BEFORE = ("SEX", "EDUCATION", "MARRIAGE", "AGE", "PAY_0", "PAY_2", "PAY_3", "PAY_4", "PAY_5", "PAY_6")
CREDIT_LABEL = "default.payment.next.month"
CREDIT_MONTHS = 6


def credit_schema() -> StructType:
    ints = [StructField(c, IntegerType()) for c in CREDIT_INTS_BEFORE]
    amounts = [StructField(f"{kind}{m}", DoubleType()) for kind in ("BILL_AMT", "PAY_AMT")
               for m in range(1, CREDIT_MONTHS + 1)]
    return StructType([
        StructField("ID", LongType()), StructField("LIMIT_BAL", DoubleType()), *ints, *amounts,
        StructField(CREDIT_LABEL, IntegerType()),
    ])


def scan_table(spark: SparkSession, path: str, fmt: str = "csv", schema: StructType | None = None) -> DataFrame:
    """A CSV with header or a parquet table. Give CSV a schema: inferring one reads the file twice."""
    reader = spark.read
    if fmt == "csv":
        reader = reader.option("header", True)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        return reader.csv(path)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format(fmt).load(path)


# The columns of the sample tables that the risk table reads. Given a schema, a scan starts
# without a job that reads file footers.
SAMPLE_SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string",
    "customer": "c_custkey bigint, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_regionkey int",
}

RISK_NUMERIC = ("o_totalprice", "c_acctbal", "sum_qty", "sum_price", "avg_disc", "avg_tax", "ret_qty")
RISK_CATEGORICAL = ("o_orderpriority", "o_orderstatus", "c_mktsegment")


def risk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: line sums, customer facts and the natural silo ``n_regionkey``.

    The line items are aggregated before the join, so only one row per order is shuffled on. Joins carry
    no hint: Spark broadcasts ``nation`` by its file size and picks the others by measured size.
    """
    def t(name):
        return spark.read.schema(SAMPLE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")

    returned = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("line_cnt"),
        F.sum("l_quantity").alias("sum_qty"),
        F.sum("l_extendedprice").alias("sum_price"),
        F.avg("l_discount").alias("avg_disc"),
        F.avg("l_tax").alias("avg_tax"),
        F.sum(returned).alias("ret_qty"),
    )
    customers = t("customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"), "c_acctbal", "c_mktsegment"
    ).join(t("nation").select("n_nationkey", "n_regionkey"), "n_nationkey")
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    joined = orders.join(customers, "o_custkey").join(lines, "o_orderkey", "left")
    return joined.select(
        "o_orderkey", "n_regionkey", "n_nationkey", "o_custkey",
        (F.coalesce("line_cnt", F.lit(0)) >= 6).cast("int").alias("many_lines"),
        "o_totalprice", "c_acctbal",
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("sum_qty", "sum_price", "avg_disc", "avg_tax", "ret_qty")],
        *RISK_CATEGORICAL,
    )
