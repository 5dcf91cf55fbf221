"""What the query modules share."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Line numbers repeat within an order, so lines get a position of their own; the SQL of lines().
LINES = "(select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as pos from lineitem)"


def lines(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """lineitem, or rows that have its columns and all its lines, with pos, the position of a line in its order, from 1."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return (table(spark, sf_dir, "lineitem") if rows is None else rows).withColumn("pos", F.row_number().over(w).cast("long"))


class Registry:
    """Queries by name with their SQL; `@registry(name, sql)` adds a function of (spark, sf_dir)."""

    def __init__(self):
        self.queries, self.oracles = {}, {}

    def __call__(self, name: str, oracle: str | None = None):
        def add(f):
            self.queries[name] = f
            if oracle:
                self.oracles[name] = oracle
            return f

        return add
