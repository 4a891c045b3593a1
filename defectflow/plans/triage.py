"""Finding in, triaged record out; the same plan serves batches and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, functions as F

from defectflow.functions.rules import (
    RULE_TOPICS, SERVING_TOPICS, default_workflow, numbered_steps, topic_tag,
)
from defectflow.functions.templates import classifier_text, summary_prompt
from defectflow.functions.text import clean_serving
from defectflow.functions.vectors import hash_embedding, l2_normalize
from defectflow.operators.models import predict_recommendation
from defectflow.operators.topics import Centroids, nearest_centroid

INPUT = ("description", "priority", "initial_recommendation")


def result_record(topic: Column, recommendation: Column, output: Column) -> list[Column]:
    """The nested result: original input struct and three strings."""
    return [
        F.struct(*[F.col(c) for c in INPUT]).alias("original_input"),
        recommendation.alias("predicted_recommendation"),
        topic.alias("topic_category"),
        output.alias("structured_output"),
    ]


def triage(
    findings: DataFrame,
    centroids: "DataFrame | Centroids",
    classifier: PipelineModel | None = None,
    embed: Callable[[Column], Column] = hash_embedding,
    generate: Callable[[Column], Column] | None = None,
    keep: tuple[str, ...] = (),
    topic_vector: str | None = None,
    normalize: bool = True,
    classifier_embed: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Triage every finding; ``keep`` carries further columns, such as an id.

    Two vectors are taken per finding: of the classifier text for the
    recommendation and of the cleaned text for the topic (``topic_vector``
    names a column that holds the latter already, ``classifier_embed`` the vectors
    that a classifier of its own was trained on); only the topic vector is
    normalised, as in training. Without a classifier the initial
    recommendation is passed on; without a generator the action rules write
    the output. All steps are narrow, so nothing is shuffled.
    """
    rows = findings.withColumn("_clean", clean_serving(F.col("description")))
    if classifier is not None:
        text = classifier_text(F.col("priority"), F.col("description"), F.col("initial_recommendation"))
        rows = predict_recommendation(rows.withColumn("_cv", (classifier_embed or embed)(text)), "_cv", classifier)
    else:
        rows = rows.withColumn("predicted_recommendation", F.col("initial_recommendation"))
    if topic_vector is None:
        vector = embed(F.col("_clean"))
        rows = rows.withColumn("_tv", l2_normalize(vector) if normalize else vector)
    rows = nearest_centroid(rows, topic_vector or "_tv", centroids)
    return finish(rows, generate, keep)


def finish(rows: DataFrame, generate: Callable[[Column], Column] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Tag, prompt, generate and nest rows that already have ``cluster_id``."""
    topic = topic_tag(F.col("cluster_id"), SERVING_TOPICS)
    if generate is None:
        output = numbered_steps(default_workflow(topic_tag(F.col("cluster_id"), RULE_TOPICS), F.col("_clean")))
    else:
        output = generate(summary_prompt(topic, F.col("_clean"), F.col("priority"), F.col("predicted_recommendation")))
    return rows.select(*keep, *result_record(topic, F.col("predicted_recommendation"), output))


def triage_assigned(findings: DataFrame, assigned: DataFrame, on: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Triage findings whose topics were assigned beforehand, in ``assigned(on, cluster_id)``.

    The join carries ids only; vectors stay where they are.
    """
    rows = findings.join(assigned.select(on, "cluster_id"), on).withColumns({
        "_clean": clean_serving(F.col("description")),
        "predicted_recommendation": F.col("initial_recommendation"),
    })
    return finish(rows, None, keep)


def triage_batch(findings: DataFrame, identifier: str, centroids, ordered: bool = False, **options) -> DataFrame:
    """One result per finding, with its id; sorted by it on request."""
    out = triage(findings, centroids, keep=(identifier,), **options)
    return out.orderBy(identifier) if ordered else out
