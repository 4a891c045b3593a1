"""Topic mix, drift, review flags, corrections, streams."""

from pyspark.sql import functions as F

from defectflow.operators import monitoring as mon
from defectflow.functions.rules import DEFAULT_ACTIONS, RULE_TOPICS, SERVING_TOPICS
from defectflow.functions.text import clean_serving
from defectflow.functions.vectors import hash_embedding, l2_normalize
from defectflow.operators.models import label_index
from defectflow.operators.topics import Centroids, cluster_centroids, nearest_centroid
from defectflow.plans.catalog import (
    ASSIGNED, FINDINGS, LABELLED, assigned, clean_serving_sql, labelled_findings, query, tag_sql,
)
from defectflow.plans.catalog.tables import _list_sql, actions_sql
from defectflow.plans.catalog.topics import _NEW_CASE, keyword_vector, taught_classifier
from defectflow.plans.triage import triage_batch
from defectflow.session import scratch_path
from defectflow.sources import stages
from defectflow.sources.demo import findings, table
from defectflow.sources.results import flatten_results
from defectflow.streaming import streams


def _day(column):
    return F.date_format(column, "yyyy-MM-dd").alias("window_start")


@query("topic_distribution", """
WITH counts AS (SELECT date_trunc('day', ts) AS d, event_type, count(*) AS count FROM events GROUP BY ALL)
SELECT strftime(d, '%Y-%m-%d') AS window_start, event_type, count, round(count / sum(count) OVER (PARTITION BY d), 6) AS share FROM counts""")
def topic_distribution(spark, sf_dir):
    out = mon.topic_distribution(table(spark, sf_dir, "events"), "ts", "event_type")
    return out.select(_day("window_start"), "event_type", "count", F.round("share", 6).alias("share"))


@query("centroid_drift", f"""WITH {LABELLED},
windows AS (SELECT time_bucket(INTERVAL 30 DAY, ts, TIMESTAMP '1970-01-01') AS d, cluster_id, count(*) AS rows, avg(distance) AS m,
                   quantile_cont(distance, 0.5) AS q FROM labelled GROUP BY ALL)
SELECT strftime(d, '%Y-%m-%d') AS window_start, cluster_id, rows, round(m, 6) AS mean_distance, round(q, 6) AS median_distance,
       round(m - first_value(m) OVER (PARTITION BY cluster_id ORDER BY d), 6) AS drift FROM windows""")
def centroid_drift(spark, sf_dir):
    rows = labelled_findings(spark, sf_dir).select("ts", "cluster_id", "distance")
    out = mon.centroid_drift(rows, "ts", "cluster_id", "distance")
    return out.select(_day("window_start"), "cluster_id", "rows", *[
        F.round(c, 6).alias(c) for c in ("mean_distance", "median_distance", "drift")])


@query("low_confidence", f"""WITH {ASSIGNED},
limits AS (SELECT cluster_id, quantile_cont(distance, 0.95) AS threshold FROM assigned GROUP BY cluster_id)
SELECT vec_id, cluster_id, round(distance, 6) AS distance, round(threshold, 6) AS threshold
FROM assigned JOIN limits USING (cluster_id) WHERE distance > threshold""")
def low_confidence(spark, sf_dir):
    rows = assigned(spark, sf_dir)
    limits = mon.confidence_thresholds(rows, "cluster_id", "distance")
    flagged = mon.flag_low_confidence(rows, "cluster_id", "distance", limits).where("needs_review")
    return flagged.select("vec_id", "cluster_id", *[F.round(c, 6).alias(c) for c in ("distance", "threshold")])


@query("apply_corrections", """
WITH latest AS (SELECT user_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS c FROM events GROUP BY user_id)
SELECT doc_id, coalesce(c, source) AS source, c IS NOT NULL AS was_corrected FROM documents LEFT JOIN latest ON user_id = doc_id""")
def apply_corrections(spark, sf_dir):
    latest = mon.latest_corrections(
        table(spark, sf_dir, "events").withColumnRenamed("user_id", "doc_id"), "doc_id", "event_type", F.col("ts"), F.col("event_id"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mon.apply_corrections(rows, "doc_id", "source", latest)


@query("stream_topic_distribution", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, event_type, count(*) AS count FROM events GROUP BY ALL""")
def stream_topic_distribution(spark, sf_dir):
    """Complete-mode counts over a file stream, through a table in the shared folder."""
    schema = table(spark, sf_dir, "events").schema
    stream = streams.read_stream(spark, sf_dir, schema, pattern="events.parquet")
    counts = streams.stream_topic_counts(stream, "ts", "event_type")
    path = scratch_path(spark, "topic-counts")
    streams.write_available_complete(counts, path, path + "-checkpoint").awaitTermination()
    return spark.read.parquet(path).select(_day("window_start"), "event_type", "count")


def _closed_sql(days: int) -> str:
    """Closed, late and open counts when a fifth of the events arrives after all others."""
    return f"""
WITH rows AS (SELECT event_type, ts, event_id % 5 = 0 AS second FROM events),
marks AS (SELECT max(ts) FILTER (NOT second) - INTERVAL 1 HOUR AS w1, max(ts) - INTERVAL 1 HOUR AS w2 FROM rows),
placed AS (
  SELECT *, date_trunc('day', ts) - to_days(unnest(range({days}))::INTEGER) AS ws FROM rows
),
ended AS (SELECT *, ws + INTERVAL {days} DAY AS we FROM placed)
SELECT strftime(ws, '%Y-%m-%d') AS window_start, event_type, we <= w2 AS closed,
  count(*) FILTER (NOT (second AND we <= w1)) AS count, count(*) FILTER (second AND we <= w1) AS late
FROM ended, marks GROUP BY ALL"""


def _closed_windows(spark, sf_dir, every, slide=None):
    """Append mode over two arrivals: closed windows from the stream, late rows counted, open windows flushed."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    incoming, out = scratch_path(spark, "arrivals"), scratch_path(spark, "closed")
    for part in (events.where("event_id % 5 <> 0"), events.where("event_id % 5 = 0")):
        part.write.mode("append").parquet(incoming)
        stream = streams.read_stream(spark, incoming, events.schema)
        run = streams.run_closed_counts(stream, "ts", "event_type", out, out + "-checkpoint", every, slide)
    closed = spark.read.parquet(out)
    rows = spark.read.parquet(incoming)
    late = streams.late_counts(rows, closed, run.watermark, "ts", "event_type", every, slide)
    opened = streams.open_counts(rows, run.watermark, "ts", "event_type", every, slide)
    parts = [
        closed.select("window_start", "event_type", F.lit(True).alias("closed"), "count", F.lit(0).cast("long").alias("late")),
        late.select("window_start", "event_type", F.lit(True).alias("closed"), F.lit(0).cast("long").alias("count"), "late"),
        opened.select("window_start", "event_type", F.lit(False).alias("closed"), "count", F.lit(0).cast("long").alias("late")),
    ]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.groupBy(_day("window_start"), "event_type", "closed").agg(F.sum("count").alias("count"), F.sum("late").alias("late"))


@query("stream_closed_windows", _closed_sql(1))
def stream_closed_windows(spark, sf_dir):
    return _closed_windows(spark, sf_dir, "1 day")


@query("stream_sliding_windows", _closed_sql(3))
def stream_sliding_windows(spark, sf_dir):
    return _closed_windows(spark, sf_dir, "3 days", "1 day")


@query("stream_drift", f"""WITH {LABELLED},
windows AS (SELECT time_bucket(INTERVAL 30 DAY, ts, TIMESTAMP '1970-01-01') AS d, cluster_id, count(*) AS rows, avg(distance) AS m,
  quantile_disc(distance, 0.48) AS low, quantile_disc(distance, 0.52) AS high FROM labelled GROUP BY ALL)
SELECT strftime(d, '%Y-%m-%d') AS window_start, cluster_id, rows, round(m, 6) AS mean_distance,
       round(m - first_value(m) OVER (PARTITION BY cluster_id ORDER BY d), 6) AS drift,
       round(low, 6) AS low, round(high, 6) AS high, low <= high AS median_between FROM windows""")
def stream_drift(spark, sf_dir):
    """Drift from sketches that a stream has left, each median next to the exact bounds of its rank error."""
    sketches, rows = _streamed_sketches(spark, sf_dir)
    drift = mon.sketched_drift(sketches, "cluster_id")
    exact = rows.groupBy(F.window("ts", "30 days")["start"].alias("window_start"), "cluster_id").agg(
        F.expr("percentile_disc(0.48) WITHIN GROUP (ORDER BY distance)").alias("low"),
        F.expr("percentile_disc(0.52) WITHIN GROUP (ORDER BY distance)").alias("high"),
    )
    both = drift.join(exact, ["window_start", "cluster_id"])
    return both.select(
        _day("window_start"), "cluster_id", "rows", *[F.round(c, 6).alias(c) for c in ("mean_distance", "drift", "low", "high")],
        F.col("median_distance").between(F.col("low"), F.col("high")).alias("median_between"),
    )


@query("stream_low_confidence", f"""WITH {LABELLED},
limits AS (SELECT cluster_id, quantile_disc(distance, 0.93) AS low, quantile_disc(distance, 0.97) AS high FROM labelled GROUP BY cluster_id)
SELECT finding_id, cluster_id, distance > high AS needs_review FROM labelled JOIN limits USING (cluster_id)
WHERE distance <= low OR distance > high""")
def stream_low_confidence(spark, sf_dir):
    """Review flags by sketched thresholds; rows within the rank error of a threshold may go either way and are left out."""
    sketches, rows = _streamed_sketches(spark, sf_dir)
    flagged = mon.flag_low_confidence(rows, "cluster_id", "distance", mon.sketched_thresholds(sketches, "cluster_id"))
    exact = rows.groupBy("cluster_id").agg(
        F.expr("percentile_disc(0.93) WITHIN GROUP (ORDER BY distance)").alias("low"),
        F.expr("percentile_disc(0.97) WITHIN GROUP (ORDER BY distance)").alias("high"),
    )
    sure = flagged.join(exact, "cluster_id").where("distance <= low or distance > high")
    return sure.select("finding_id", "cluster_id", "needs_review")


def _streamed_sketches(spark, sf_dir):
    """The state table of a stream over labelled findings in several files, and the findings."""
    rows = labelled_findings(spark, sf_dir).select("finding_id", F.col("ts").cast("timestamp").alias("ts"), "cluster_id", "distance")
    incoming, out = scratch_path(spark, "labelled"), scratch_path(spark, "sketches")
    rows.repartition(4).write.parquet(incoming)
    stream = streams.read_stream(spark, incoming, rows.schema, max_files=2)
    streams.write_distance_sketches(stream, "ts", "cluster_id", "distance", out, out + "-checkpoint").awaitTermination()
    return spark.read.parquet(out), spark.read.parquet(incoming)


@query("correction_loop", """
WITH latest AS (SELECT user_id AS vec_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS c FROM events GROUP BY user_id),
rows AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, coalesce(c, concat('class ', label)) AS label, c IS NOT NULL AS was_corrected
  FROM embeddings LEFT JOIN latest USING (vec_id)
),
coded AS (SELECT *, dense_rank() OVER (ORDER BY label) - 1 AS code FROM rows),
cells AS (SELECT code, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM coded),
centers AS (SELECT code AS cluster_id, list(m ORDER BY pos) AS center FROM (SELECT code, pos, avg(x) AS m FROM cells GROUP BY ALL) GROUP BY code),
served AS (
  SELECT vec_id, cluster_id, list_distance(v, center) AS distance FROM coded, centers
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster_id) = 1
)
SELECT vec_id, coded.label, was_corrected, names.label AS served, round(distance, 6) AS distance, 2 AS version
FROM served JOIN coded USING (vec_id) JOIN (SELECT DISTINCT code, label FROM coded) names ON names.code = cluster_id""")
def correction_loop(spark, sf_dir):
    """Corrections arrive as a stream, labels are put right in the stage table, topics trained again, published, loaded and served."""
    home = scratch_path(spark, "loop")
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", F.concat(F.lit("class "), F.col("label").cast("string")).alias("label"), F.lit(0).alias("revision"))
    stages.upsert_stage(rows, f"{home}/stage", "vec_id", ["revision"], buckets=16)
    _train_labels(spark, home)

    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("vec_id"), "event_type", "ts", "event_id")
    for part in (events.where("event_id % 3 <> 0"), events.where("event_id % 3 = 0")):
        part.write.mode("append").parquet(f"{home}/incoming")
        stream = streams.read_stream(spark, f"{home}/incoming", events.schema)
        streams.write_corrections(stream, "vec_id", ["ts", "event_id"], f"{home}/corrections", f"{home}/checkpoint", 16).awaitTermination()
    latest = spark.read.parquet(f"{home}/corrections").select("vec_id", F.col("event_type").alias("corrected_label"))
    stage = stages.read_stage(spark, f"{home}/stage").drop("bucket")
    corrected = mon.apply_corrections(stage, "vec_id", "label", latest).where("was_corrected").drop("was_corrected")
    stages.upsert_stage(corrected.withColumn("revision", F.lit(1)), f"{home}/stage", "vec_id", ["revision"], buckets=16)
    _train_labels(spark, home)

    model = spark.read.parquet(stages.published(spark, f"{home}/models", "labels"))
    stage = stages.read_stage(spark, f"{home}/stage")
    out = nearest_centroid(stage, "embedding", Centroids.from_table(model)).join(model.select("cluster_id", F.col("label").alias("served")), "cluster_id")
    version = spark.read.parquet(f"{home}/models/versions").agg(F.max("version").alias("version"))
    return out.select(
        "vec_id", "label", (F.col("revision") == 1).alias("was_corrected"), "served", F.round("distance", 6).alias("distance"),
        F.lit(version.first()["version"]).alias("version"))


def _train_labels(spark, home):
    """The mean vector of each label as a new version of the centroid table."""
    rows = label_index(stages.read_stage(spark, f"{home}/stage"), "label")
    means = cluster_centroids(rows, "label_index", "embedding")
    names = rows.select(F.col("label_index").alias("cluster_id"), "label").distinct()
    stages.publish(spark, f"{home}/models", "labels", lambda path: stages.save_centroids(means.join(names, "cluster_id"), path))


# Topics in text space: one centroid per priority, the mean unit vector of its
# findings' texts. SQL works on the non-zero cells only.
_TEXT_TRIAGE = rf"""WITH {FINDINGS},
cleaned AS (SELECT *, {clean_serving_sql('description')} AS clean FROM findings),
tokens AS (SELECT finding_id, priority, unnest(regexp_extract_all(clean, '\S+')) AS t FROM cleaned),
counted AS (SELECT finding_id, priority, ('0x' || substr(md5(t), 1, 8))::BIGINT % 384 AS b, count(*) AS c FROM tokens GROUP BY ALL),
cells AS (SELECT finding_id, priority, b, c / sqrt(sum(c * c) OVER (PARTITION BY finding_id)) AS x FROM counted),
sizes AS (SELECT priority, count(*) AS n FROM cleaned GROUP BY priority),
middle AS (SELECT priority::INTEGER AS cluster_id, b, sum(x) / any_value(n) AS m FROM cells JOIN sizes USING (priority) GROUP BY ALL),
norms AS (SELECT cluster_id, sum(m * m) AS mm FROM middle GROUP BY cluster_id),
products AS (SELECT finding_id, cluster_id, sum(x * m) AS xm FROM cells JOIN middle USING (b) GROUP BY ALL),
near AS (
  SELECT finding_id, cluster_id FROM cleaned CROSS JOIN norms LEFT JOIN products USING (finding_id, cluster_id)
  QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY mm - 2 * coalesce(xm, 0), cluster_id) = 1),
acted AS (SELECT *, CASE WHEN clean = '' THEN {_list_sql(DEFAULT_ACTIONS)} ELSE {actions_sql(tag_sql('cluster_id', RULE_TOPICS), 'clean')} END AS actions
          FROM cleaned JOIN near USING (finding_id))
SELECT finding_id, description AS DESCRIPTION, priority AS PRIORITY, initial_recommendation AS INITIAL_RECOMMENDATION,
       initial_recommendation AS PREDICTED_RECOMMENDATION, {tag_sql('cluster_id', SERVING_TOPICS)} AS TOPIC_CATEGORY,
       concat('[STEPS:', len(actions), '] Actions: ',
              array_to_string(list_transform(range(1, len(actions) + 1), lambda i: concat(i, '. ', actions[i])), ' ')) AS STRUCTURED_OUTPUT
FROM acted"""


def text_centroids(rows):
    """The mean vector of each priority's texts; equal cleaned texts are embedded once and weigh by their copies."""
    texts = rows.groupBy(F.col("priority").cast("int").alias("p"), clean_serving(F.col("description")).alias("clean")).agg(
        F.count("*").alias("copies"))
    vector = l2_normalize(hash_embedding(F.col("clean")))
    return cluster_centroids(texts.select("p", "copies", vector.alias("v")), "p", "v", weight="copies")


@query("text_triage", _TEXT_TRIAGE)
def text_triage(spark, sf_dir):
    """Findings triaged by the vectors of their own text."""
    rows = findings(spark, sf_dir)
    return flatten_results(triage_batch(rows, "finding_id", Centroids.from_table(text_centroids(rows))), ("finding_id",))


@query("triage_records", _TEXT_TRIAGE.replace(
    "initial_recommendation AS PREDICTED_RECOMMENDATION", f"{_NEW_CASE.format(d='description')} AS PREDICTED_RECOMMENDATION"))
def triage_records(spark, sf_dir):
    """The whole serving path as rows: classified, cleaned, matched to a topic of its own text, given its actions."""
    rows = findings(spark, sf_dir)
    model, topics = taught_classifier(rows), Centroids.from_table(text_centroids(rows))
    return flatten_results(triage_batch(rows, "finding_id", topics, classifier=model, classifier_embed=keyword_vector), ("finding_id",))


@query("stream_triage", _TEXT_TRIAGE)
def stream_triage(spark, sf_dir):
    """The same triage over a file stream, file source to file sink."""
    rows = findings(spark, sf_dir)
    model = Centroids.from_table(text_centroids(rows))
    source = scratch_path(spark, "incoming")
    rows.write.parquet(source)
    stream = streams.read_stream(spark, source, rows.schema)
    out = streams.stream_triage(stream, model, ("finding_id",))
    path = scratch_path(spark, "triaged")
    streams.write_available(out, path, path + "-checkpoint").awaitTermination()
    return flatten_results(spark.read.parquet(path), ("finding_id",))
