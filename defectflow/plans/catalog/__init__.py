"""Registered queries over the given tables, with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from defectflow.functions.text import EQUIPMENT_CODE_PATTERNS, TRAINING_CODE_PATTERN, clean_serving
from defectflow.functions.vectors import to_matrix
from defectflow.operators.topics import Centroids, cluster_centroids, nearest_centroid
from defectflow.sources.demo import findings, findings_sql, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its SQL."""

    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


# Spark side -----------------------------------------------------------------

def embeddings(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def centroids(spark, sf_dir) -> DataFrame:
    return cluster_centroids(embeddings(spark, sf_dir), "label", "embedding")


def assigned(spark, sf_dir) -> DataFrame:
    """``vec_id, label, cluster_id, distance``: topics are found before any join."""
    vectors = embeddings(spark, sf_dir)
    return nearest_centroid(vectors, "embedding", Centroids.from_table(centroids(spark, sf_dir))).drop("embedding")


def labelled_findings(spark, sf_dir) -> DataFrame:
    """Findings with cleaned text and the topic of their vector."""
    rows = findings(spark, sf_dir).join(assigned(spark, sf_dir), "vec_id")
    return rows.withColumn("clean", clean_serving(F.col("description")))


def turn_pairs(spark, sf_dir) -> DataFrame:
    """Each conversation turn with the next one as its reference."""
    turns = table(spark, sf_dir, "conversations")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference"))
    return turns.select("conv_id", "turn", F.col("text").alias("prediction")).join(following, ["conv_id", "turn"])


def micro_text(vector: Column, sparse: bool = False) -> Column:
    """A vector as text, in whole millionths, so that engines can be compared.

    Sparse text names the zero-based place of each non-zero entry.
    """

    @F.arrow_udf("string")
    def show(v: pa.Array) -> pa.Array:
        cells, _ = to_matrix(v)
        whole = np.floor(np.abs(cells) * 1e6 + 0.5).astype("int64") * np.sign(cells).astype("int64")
        if sparse:
            return pa.array([",".join(f"{i}:{row[i]}" for i in np.flatnonzero(row)) for row in whole], pa.string())
        return pa.array([",".join(map(str, row)) for row in whole], pa.string())

    return show(vector)


# SQL side -------------------------------------------------------------------

def clean_serving_sql(text: str) -> str:
    out = f"lower(coalesce({text}, ''))"
    for pattern in EQUIPMENT_CODE_PATTERNS:
        out = f"regexp_replace({out}, '{pattern}', '', 'gi')"
    marks = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
    return rf"regexp_replace(translate({out}, '{marks}', ''), '^\s+|\s+$', '', 'g')"


def clean_training_sql(text: str) -> str:
    out = f"regexp_replace(coalesce({text}, ''), '{TRAINING_CODE_PATTERN}', '', 'g')"
    return rf"regexp_replace(regexp_replace({out}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


FINDINGS = f"findings AS ({findings_sql()})"
CENTROIDS = """
long_vectors AS (
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings
),
centroid_cells AS (SELECT label AS cluster_id, pos, avg(x) AS c FROM long_vectors GROUP BY ALL),
centroids AS (
  SELECT cluster_id, list(c ORDER BY pos) AS centroid FROM centroid_cells GROUP BY cluster_id
)"""
ASSIGNED = CENTROIDS + """,
gaps AS (
  SELECT vec_id, label, cluster_id, list_distance(embedding::DOUBLE[], centroid) AS distance
  FROM embeddings, centroids
),
assigned AS (
  SELECT vec_id, label, cluster_id, distance FROM gaps
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster_id) = 1
)"""
LABELLED = FINDINGS + "," + ASSIGNED + f""",
labelled AS (
  SELECT f.*, a.label, a.cluster_id, a.distance, {clean_serving_sql('f.description')} AS clean
  FROM findings f JOIN assigned a USING (vec_id)
)"""
PAIRS = """
pairs AS (
  SELECT a.conv_id, a.turn, a.text AS prediction, b.text AS reference
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn
)"""


def tag_sql(cluster: str, tags: dict[int, str]) -> str:
    cases = " ".join(f"WHEN {k} THEN '{v}'" for k, v in tags.items())
    return f"(CASE {cluster} {cases} ELSE concat('Unknown Cluster (', {cluster}, ')') END)"


def micro_sql(vector: str) -> str:
    return f"array_to_string(list_transform({vector}, lambda x: round(x * 1e6)::BIGINT::VARCHAR), ',')"


from defectflow.plans.catalog import evaluation, models, monitoring, tables, text, topics  # noqa: E402,F401
