"""Findings derived from the ``orders`` table, for queries, tests and the bench."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from defectflow.session import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

# Read by Spark (STRING) and DuckDB (VARCHAR) alike. Every vector is used: the
# number of vectors, not a constant, spreads findings over them.
FINDINGS_SQL = """
SELECT o_orderkey AS finding_id,
       o_orderkey % (SELECT count(*) FROM embeddings) AS vec_id,
       concat(
         CASE o_orderkey % 10
           WHEN 0 THEN 'pump seal leak at flange'
           WHEN 1 THEN 'pump vibration high'
           WHEN 2 THEN 'valve stuck closed'
           WHEN 3 THEN 'valve seized, actuator failed'
           WHEN 4 THEN 'ubolt missing'
           WHEN 5 THEN 'thick scaling with severe corrosion'
           WHEN 6 THEN 'bolt and nuts depleted'
           WHEN 7 THEN 'transmitter signal erratic'
           WHEN 8 THEN 'pressure reading 150 psi (low)'
           WHEN 9 THEN 'scheduled overhaul due' END,
         ' ',
         CASE o_orderkey % 6
           WHEN 0 THEN concat('P-', cast(1000 + o_orderkey % 9000 AS {string}))
           WHEN 1 THEN concat('2V', cast(1000 + o_orderkey % 9000 AS {string}))
           WHEN 2 THEN concat('A', cast(o_orderkey % 900 AS {string}), 'B3')
           WHEN 3 THEN concat('ESDV', cast(1000 + o_orderkey % 9000 AS {string}))
           WHEN 4 THEN concat('AB', cast(1000000 + o_orderkey AS {string}), 'C')
           ELSE 'unit' END,
         ' area') AS description,
       substr(o_orderpriority, 1, 1) AS priority,
       CASE o_orderstatus WHEN 'F' THEN 'to be rectified'
                          WHEN 'O' THEN 'to be repaired/ replaced'
                          ELSE 'to be monitored' END AS initial_recommendation,
       o_orderdate AS ts
FROM {orders}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = FINDINGS_SQL.replace("FROM embeddings", "FROM {embeddings}").replace("{string}", "STRING")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate"
    )
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return spark.sql(sql, orders=spread(orders), embeddings=vectors)


def findings_sql() -> str:
    """The same rows for DuckDB, over registered views."""
    return FINDINGS_SQL.format(string="VARCHAR", orders="orders")
