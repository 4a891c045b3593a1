import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from defectflow import session
from defectflow.operators.topics import Centroids
from defectflow.plans.training import train_topics, training_rows
from defectflow.plans.triage import triage, triage_batch
from defectflow.sources import findings as src, results, stages
from defectflow.streaming import streams

ROWS = [
    ("pump seal leak at P-1234", "1", "to be rectified"), ("valve stuck closed", "2", "to be monitored"),
    ("P-1234 V-5678", "3", "to be rectified"), ("severe corrosion on grating", "1", "to be repaired/ replaced"),
    ('odd "quote", comma\nand a line break', "4", "to be rectified"),
]


@pytest.fixture
def rows(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS * 4)], "id long, description string, priority string, initial_recommendation string")
    return df.repartition(3)


@pytest.fixture
def csv(spark, tmp_path):
    import csv as writer

    path = tmp_path / "batch.CSV"
    with open(path, "w", newline="") as out:
        w = writer.writer(out)
        w.writerow(src.REQUIRED_COLUMNS)
        w.writerows(ROWS)
    return str(path)


def test_read_and_validate(spark, csv, tmp_path):
    df = src.read_findings(spark, csv)
    assert {f.dataType.simpleString() for f in df.schema} == {"string"} and df.count() == len(ROWS)
    assert src.normalize_findings(df).orderBy(F.desc("priority")).first().description == ROWS[4][0]
    assert src.validate_columns(df, count_rows=True) == (True, "columns are valid, 5 rows")
    extra = df.withColumn("State", F.lit("x"))
    assert not src.validate_columns(extra)[0] and src.validate_columns(extra, mode="contains")[0]
    ok, message = src.validate_columns(df.drop("PRIORITY"))
    assert not ok and "PRIORITY" in message
    with pytest.raises(FileNotFoundError):
        src.read_findings(spark, str(tmp_path / "none.csv"))
    other = tmp_path / "x.txt"
    other.write_text("a\n")
    with pytest.raises(ValueError):
        src.read_findings(spark, str(other))
    assert src.preview(df, 2, ["DESCRIPTION"], "PRIORITY", "DESCRIPTION").columns == ["DESCRIPTION"]


def test_write_results(spark, tmp_path, rows):
    flat = results.flatten_results(triage(rows, topic_table(spark)))
    assert tuple(flat.columns) == src.RESULT_COLUMNS
    path = str(tmp_path / "out" / "results.csv")
    _, first = results.write_results(flat, path, "version")
    _, second = results.write_results(flat, path, "version")
    _, third = results.write_results(flat, path, "version")
    assert [first, second, third] == [path, path[:-4] + "_v1.csv", path[:-4] + "_v2.csv"]
    _, again = results.write_results(flat, path)
    back = src.read_findings(spark, path)
    assert again == path and sorted(map(tuple, back.collect())) == sorted(map(tuple, flat.collect()))
    with pytest.raises(Exception, match="(?i)exists"):
        results.write_results(flat, path, "error")
    empty = str(tmp_path / "empty.csv")
    results.write_results(flat.limit(0), empty)
    assert tuple(src.read_findings(spark, empty).columns) == src.RESULT_COLUMNS
    assert results.result_view(flat).columns == ["description", "initial_rec", "predicted_rec", "action_plan"]
    assert results.summary_view(flat).columns == ["DESCRIPTION", "PREDICTED_REC", "TOPIC"]


def topic_table(spark):
    from defectflow.functions.vectors import hash_embedding

    seeds = spark.createDataFrame([(0, "pump seal leak"), (1, "valve stuck closed"), (2, "severe corrosion")], "cluster_id int, t string")
    return seeds.select("cluster_id", hash_embedding(F.col("t")).alias("centroid"))


def test_triage_record(spark, rows, tmp_path):
    out = {r.id: r for r in triage_batch(rows, "id", topic_table(spark)).collect()}
    assert len(out) == 20
    first = out[0]
    assert first.original_input.asDict() == dict(description=ROWS[0][0], priority="1", initial_recommendation="to be rectified")
    assert first.topic_category == "valve leakage & insulation / alignment defects"
    assert first.structured_output == "[STEPS:4] Actions: 1. Isolate pump 2. Inspect mechanical seal 3. Replace seal if damaged 4. Pressure test"
    assert "Apply penetrating oil" in out[1].structured_output
    assert "Inspect equipment" in out[2].structured_output  # only codes: general actions
    ordered = triage_batch(rows, "id", topic_table(spark), ordered=True)
    assert [r.id for r in ordered.collect()] == list(range(20))
    stages.save_centroids(topic_table(spark), str(tmp_path / "c"))
    assert stages.load_centroids(spark, str(tmp_path / "c")).count() == 3
    with pytest.raises(FileNotFoundError):
        stages.load_centroids(spark, str(tmp_path / "absent"))


def test_triage_with_supplied_models(spark, rows):
    from defectflow.functions.vectors import hash_embedding
    from defectflow.functions.templates import classifier_text
    from defectflow.operators.models import train_classifier
    from defectflow.operators.providers import generate_column

    text = classifier_text(F.col("priority"), F.col("description"), F.col("initial_recommendation"))
    model = train_classifier(rows.withColumn("v", hash_embedding(text)), "v", "initial_recommendation", trees=5)
    echo = generate_column(lambda: (lambda prompts: [p.upper() for p in prompts]))
    out = triage(rows, topic_table(spark), classifier=model, generate=echo, keep=("id",)).where("id = 1").first()
    assert out.structured_output.startswith("[TOPIC: STRUCTURAL STEEL") and out.predicted_recommendation in {r[2] for r in ROWS}


def test_triage_is_narrow(spark, rows):
    plan = triage(rows.coalesce(2), topic_table(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1 and "BatchEvalPython" not in plan  # the one exchange is the fixture's own


def test_training_flow(spark, rows, tmp_path):
    trained = train_topics(rows, "id", k=3)
    assert trained.centroids.count() == 3 and trained.labelled.where("cluster is not null").count() == 16
    labelled = training_rows(trained).select("id", "cleaned_description", "cluster", "topic", "actions")
    bare = labelled.where("cluster is null").collect()  # texts of codes only stay, with the general actions
    assert len(bare) == rows.count() - 16 and all(r.cleaned_description == "" and r.topic is None and r.actions for r in bare)
    assert labelled.groupBy("cleaned_description").agg(F.count_distinct("cluster").alias("n")).where("n > 1").count() == 0
    stages.write_stage(labelled, str(tmp_path / "stage"))
    assert stages.read_stage(spark, str(tmp_path / "stage")).count() == rows.count()
    total = trained.centroids.agg(F.sum("size")).first()[0]
    assert total == 16


def test_streams(spark, rows, tmp_path):
    source = str(tmp_path / "in")
    rows.write.parquet(source)
    stream = streams.read_stream(spark, source, rows.schema, max_files=1)
    model = Centroids.from_table(topic_table(spark))
    out = str(tmp_path / "out")
    streams.write_available(streams.stream_triage(stream, model, ("id",)), out, str(tmp_path / "cp")).awaitTermination()
    batch = triage(rows, model, keep=("id",))
    assert sorted(map(str, spark.read.parquet(out).collect())) == sorted(map(str, batch.collect()))


def test_late_rows(spark, tmp_path):
    source = str(tmp_path / "events")
    schema = "ts timestamp_ntz, topic string"

    def add(name, *times):
        spark.createDataFrame([(t, "a") for t in times], "t string, topic string").select(
            F.col("t").cast("timestamp_ntz").alias("ts"), "topic").coalesce(1).write.mode("append").parquet(source)

    counts, closed, checkpoint = str(tmp_path / "counts"), str(tmp_path / "closed"), str(tmp_path / "cp")

    def run():
        stream = streams.read_stream(spark, source, spark.createDataFrame([], schema).schema)
        counted = streams.stream_topic_counts(stream, "ts", "topic", "1 day", delay="1 hour")
        streams.write_available(counted, closed, checkpoint).awaitTermination()
        streams.write_available_complete(counted, counts, checkpoint + "-complete").awaitTermination()

    add("first", "2024-01-01 10:00:00", "2024-01-03 10:00:00")
    run()
    add("late", "2024-01-01 11:00:00", "2024-01-05 00:00:00")
    run()
    whole = {str(r.window_start)[:10]: r["count"] for r in spark.read.parquet(counts).collect()}
    done = {str(r.window_start)[:10]: r["count"] for r in spark.read.parquet(closed).collect()}
    # Complete mode keeps every row; append mode emits closed windows once and leaves late rows out.
    assert whole == {"2024-01-01": 2, "2024-01-03": 1, "2024-01-05": 1}
    assert done == {"2024-01-01": 1, "2024-01-03": 1}


def test_shared_folder_setting(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert session.scratch_path(spark, "x").startswith(configured or session.shared_root(spark))
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")


def test_workers_need_no_installed_package(tmp_path):
    """Jobs run from any folder: helpers travel to the workers by value."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {root!r})
        import __spark_entry__ as contract
        from defectflow.session import local_session
        print("ROWS", contract.entry(local_session(2, memory="2g")).count())
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS 1500" in done.stdout, done.stderr[-2000:]
