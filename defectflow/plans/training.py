"""From raw findings to topics, centroids, actions and training rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from defectflow.functions.rules import RULE_TOPICS, default_workflow, topic_tag
from defectflow.functions.text import clean_serving, clean_training
from defectflow.functions.vectors import hash_embedding, l2_normalize
from defectflow.operators.clustering import topic_tree
from defectflow.operators.topics import cluster_centroids
from defectflow.session import write_and_reread

CLEANERS = {"serving": clean_serving, "training": clean_training}


@dataclass
class TrainedTopics:
    """Labelled rows, the centroids they give, and how their text was cleaned."""

    labelled: DataFrame
    centroids: DataFrame
    cleaner: str


def train_topics(findings: DataFrame, identifier: str, text: str = "description", k: int = 7, cleaner: str = "serving",
                 embed=hash_embedding, normalize: bool = True, method: str = "micro", cells: int | None = 512) -> TrainedTopics:
    """Clean, embed, cluster, tag.

    Findings whose text cleans to nothing teach no topic; they stay, with a null
    cluster. ``method`` and ``cells`` are those of ``topic_tree``.

    Topics are learned from the distinct cleaned texts, weighted by their
    copies and written once, so the passes of the clustering read vectors of
    distinct texts only. Every finding is then labelled by a narrow map.
    """
    def vector_of(column: str):
        return l2_normalize(embed(F.col(column))) if normalize else embed(F.col(column))

    cleaned = findings.withColumn("cleaned_description", CLEANERS[cleaner](F.col(text)))
    some = F.col("cleaned_description") != ""
    texts = cleaned.where(some).groupBy("cleaned_description").agg(
        F.count(F.lit(1)).alias("copies"), F.min(identifier).alias("first_id")
    )
    vectors = write_and_reread(
        texts.select("first_id", "copies", vector_of("cleaned_description").alias("vector")), "text-vectors"
    )
    tree = topic_tree(vectors, "first_id", "vector", method, cells, weight="copies")

    def labelled(rows: DataFrame) -> DataFrame:
        return tree.label(rows, "vector", [k], "cluster").withColumn("cluster", F.col("cluster")[0])

    means = cluster_centroids(labelled(vectors), "cluster", "vector", weight="copies")
    # Embedding and label are one step in Python; a condition between them would send every vector through the JVM.
    rows = labelled(cleaned.withColumn("vector", vector_of("cleaned_description")))
    return TrainedTopics(rows.withColumns({c: F.when(some, F.col(c)) for c in ("vector", "cluster")}), means, cleaner)


def training_rows(trained: TrainedTopics) -> DataFrame:
    """Labelled rows with rule topic and actions; empty texts have no topic and the general actions."""
    topic = F.when(F.col("cluster").isNotNull(), topic_tag(F.col("cluster"), RULE_TOPICS))
    return trained.labelled.withColumn("topic", topic).withColumn(
        "actions", default_workflow(F.col("topic"), F.col("cleaned_description"))
    )
