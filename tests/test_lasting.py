"""State that outlives a job: model caches, stage tables with upserts, versions, streamed windows and sketches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from defectflow.operators import monitoring as mon
from defectflow.operators.centroid_index import CentroidIndex
from defectflow.operators.providers import embed_text, generate_text
from defectflow.plans.triage import triage
from defectflow.sources import stages
from defectflow.streaming import streams


def counting(folder):
    """A model that notes every text it sees."""

    def factory():
        import uuid

        def model(texts, **options):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
                out.write("\n".join(texts) + "\n")
            return [[float(len(t)), float(options.get("shift", 0))] for t in texts]

        return model

    return factory


def seen(folder):
    return sorted(line for f in folder.iterdir() for line in f.read_text().splitlines())


def test_cached_model_sees_new_texts_only(spark, tmp_path):
    calls, cache = tmp_path / "calls", str(tmp_path / "cache")
    calls.mkdir()
    texts = ["a", "bb", "a", None, "", "ccc"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    wanted = {i: None if t is None else [float(len(t)), 0.0] for i, t in enumerate(texts)}

    def run(rows, **more):
        out = embed_text(rows, "t", counting(str(calls)), cache=cache, model="m1", **more)
        return {r.id: r.embedding for r in out.collect()}

    assert run(df.where("id < 3")) == {i: wanted[i] for i in range(3)} and seen(calls) == ["a", "bb"]
    assert run(df) == wanted and seen(calls) == ["", "a", "bb", "ccc"]  # the rest only
    assert run(df) == wanted and len(seen(calls)) == 4
    assert run(df, shift=3)[0] == [1.0, 3.0] and len(seen(calls)) == 8  # other options: another address
    assert run(df.limit(0)) == {}
    with pytest.raises(ValueError, match="name of the model"):
        embed_text(df, "t", counting(str(calls)), cache=cache)
    # Rows that two runs added at the same time are read once; a folder of a run that broke off is not read.
    folder = next((tmp_path / "cache").iterdir())
    part = next(p for p in folder.iterdir() if any(p.glob("*.parquet")))
    spark.read.parquet(str(part)).write.parquet(f"{folder}/part-twice")
    spark.createDataFrame([("x", 1)], "hash string, value int").write.parquet(f"{folder}/part-broken")
    (folder / "part-broken" / "_SUCCESS").unlink()
    assert run(df) == wanted and run(df, shift=3)[0] == [1.0, 3.0] and len(seen(calls)) == 8


def test_cached_text_of_another_kind(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "yy")], "id int, t string")
    upper = lambda: (lambda texts: [t.upper() for t in texts])
    for _ in range(2):
        out = generate_text(df, "t", upper, cache=str(tmp_path), model="m")
        assert {r.id: r.structured_output for r in out.collect()} == {1: "X", 2: "YY"}


def stage_rows(spark, path):
    return {r.id: (r.label, r.at) for r in spark.read.parquet(path).collect()}


def test_upserts_keep_the_latest_row(spark, tmp_path):
    path, schema = str(tmp_path / "stage"), "id long, label string, at long"
    stages.upsert_stage(spark.createDataFrame([(i, "old", 5) for i in range(100)], schema), path, "id", ["at"], 8)
    changes = spark.createDataFrame([(3, "new", 9), (3, "mid", 7), (4, "stale", 1), (5, "tie", 5), (200, "more", 1), (None, "none", 1)], schema)
    before = {f.name: f.stat().st_mtime_ns for d in (tmp_path / "stage").iterdir() if d.is_dir() for f in d.iterdir()}
    for _ in range(2):  # the second time changes nothing
        stages.upsert_stage(changes, path, "id", ["at"], 8)
        rows = stage_rows(spark, path)
        assert rows == {i: ("old", 5) for i in range(100)} | {3: ("new", 9), 5: ("tie", 5), 200: ("more", 1), None: ("none", 1)}
    buckets = len(list((tmp_path / "stage").glob("bucket=*")))
    one = spark.createDataFrame([(3, "newer", 10)], schema)
    kept = {f.name for d in (tmp_path / "stage").glob("bucket=*") for f in d.iterdir()}
    stages.upsert_stage(one, path, "id", ["at"], 8)
    after = {f.name for d in (tmp_path / "stage").glob("bucket=*") for f in d.iterdir()}
    assert stage_rows(spark, path)[3] == ("newer", 10) and before
    changed = {d.name for d in (tmp_path / "stage").glob("bucket=*") if any(f.name not in kept for f in d.iterdir())}
    assert len(changed) == 1 and buckets == 8 and len(after & kept) > len(kept) / 2


def test_versions(spark, tmp_path):
    root = str(tmp_path / "models")
    with pytest.raises(FileNotFoundError):
        stages.published(spark, root, "topics")
    table = spark.createDataFrame([(0, [1.0])], "cluster_id int, centroid array<double>")
    first = stages.publish(spark, root, "topics", lambda path: stages.save_centroids(table, path))
    stages.publish(spark, root, "other", lambda path: stages.save_centroids(table, path))

    def broken(path):
        raise RuntimeError("no room")

    with pytest.raises(RuntimeError):
        stages.publish(spark, root, "topics", broken)
    assert stages.published(spark, root, "topics") == first  # a version that was not saved is not seen
    second = stages.publish(spark, root, "topics", lambda path: stages.save_centroids(table, path))
    assert first.endswith("/v1") and second.endswith("/v2") and stages.published(spark, root, "topics") == second
    assert stages.published(spark, root, "other").endswith("other/v1")


def test_corrections_as_a_stream(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "id long, label string, at long"
    state, checkpoint = str(tmp_path / "state"), str(tmp_path / "cp")

    def arrive(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = streams.read_stream(spark, source, spark.createDataFrame([], schema).schema)
        streams.write_corrections(stream, "id", ["at"], state, checkpoint, 4).awaitTermination()

    arrive((1, "a", 1), (2, "b", 5))
    arrive((1, "c", 3), (2, "late", 4), (3, "d", 1))
    assert stage_rows(spark, state) == {1: ("c", 3), 2: ("b", 5), 3: ("d", 1)}


def test_closed_windows_and_their_state(spark, tmp_path):
    source = str(tmp_path / "events")
    schema = "ts timestamp_ntz, topic string"
    days = [f"2024-01-{d:02d} 10:00:00" for d in range(1, 29)]
    out, checkpoint = str(tmp_path / "closed"), str(tmp_path / "cp")

    def arrive(times, **more):
        rows = spark.createDataFrame([(t, k) for t in times for k in "ab"], "t string, topic string")
        rows.select(F.col("t").cast("timestamp_ntz").alias("ts"), "topic").coalesce(1).write.mode("append").parquet(source)
        stream = streams.read_stream(spark, source, spark.createDataFrame([], schema).schema, max_files=1)
        return streams.run_closed_counts(stream, "ts", "topic", out, checkpoint, "1 day", delay="1 hour", **more)

    first = arrive(days[:14])
    assert first.state_rows == 2 and first.most_state_rows == 28  # of 28 groups only the open day is held
    second = arrive([days[2], days[3], *days[14:]])
    assert second.state_rows == 2 and second.dropped == 4 and second.watermark.startswith("2024-01-28T09")
    closed, rows = spark.read.parquet(out), spark.read.parquet(source)
    assert closed.count() == 54 and closed.agg(F.sum("count")).first()[0] == 54
    late = streams.late_counts(rows, closed, second.watermark, "ts", "topic").collect()
    assert sorted((str(r.window_start)[:10], r.topic, r.late) for r in late) == [
        (d, k, 1) for d in ("2024-01-03", "2024-01-04") for k in "ab"]
    opened = streams.open_counts(rows, second.watermark, "ts", "topic").collect()
    assert [(str(r.window_start)[:10], r["count"]) for r in opened] == [("2024-01-28", 1)] * 2


def test_sketches_merge_and_stay_within_their_error(spark, tmp_path):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=30_000), np.full(20_000, 0.25)])
    rows = [(i, "2024-01-01" if i % 3 else "2024-03-15", int(i % 2), float(x)) for i, x in enumerate(values)] + [(-1, "2024-01-01", 0, None)]
    df = spark.createDataFrame(rows, "id long, d string, topic int, x double").select("id", F.col("d").cast("timestamp").alias("ts"), "topic", "x")
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    df.repartition(5).write.parquet(source)
    stream = streams.read_stream(spark, source, df.schema, max_files=2)
    streams.write_distance_sketches(stream, "ts", "topic", "x", state, str(tmp_path / "cp")).awaitTermination()
    sketches = spark.read.parquet(state)
    assert sketches.select("epoch").distinct().count() == 3
    whole = {r.topic: r.threshold for r in mon.sketched_thresholds(sketches, "topic", 0.9).collect()}
    for topic in (0, 1):
        own = values[np.arange(len(values)) % 2 == topic]
        low, high = (own < whole[topic]).mean(), (own <= whole[topic]).mean()
        assert low - 0.02 <= 0.9 <= high + 0.02
    drift = {(r.topic, str(r.window_start)[:10]): r for r in mon.sketched_drift(sketches, "topic").collect()}
    exact = {(r.topic, str(r.window_start)[:10]): r for r in mon.centroid_drift(df.where("x is not null"), "ts", "topic", "x").collect()}
    assert set(drift) == set(exact)
    for key, r in drift.items():
        assert (r.rows, r.mean_distance, r.drift) == (exact[key].rows, pytest.approx(exact[key].mean_distance), pytest.approx(exact[key].drift))


def test_stream_against_many_centroids(spark, tmp_path):
    rng = np.random.default_rng(3)
    places = rng.normal(size=(2_500, 6))
    table = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(places)], "cluster_id int, centroid array<double>")
    points = rng.normal(size=(200, 6))
    rows = spark.createDataFrame([(i, "pump leak", "1", "x", [float(x) for x in p]) for i, p in enumerate(points)],
                                 "id long, description string, priority string, initial_recommendation string, v array<double>")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    index = CentroidIndex.write(table, f"file://{tmp_path}/index")
    stream = streams.read_stream(spark, str(tmp_path / "in"), rows.schema, max_files=1)
    out = streams.stream_triage(stream, index, ("id",), topic_vector="v")
    streams.write_available(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.id: r.topic_category for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    nearest = ((points[:, None] - places[None]) ** 2).sum(axis=2).argmin(axis=1)
    batch = {r.id: r.topic_category for r in triage(rows, index, keep=("id",), topic_vector="v").collect()}
    assert got == batch and all(str(n) in got[i] or n < 7 for i, n in enumerate(nearest))


def test_padded_batches(spark):
    from defectflow.operators.models import padded_batches, tokenize

    words = [" ".join(["w"] * (i * 7 % 13)) for i in range(70)]
    df = spark.createDataFrame([(i, None if i == 5 else w, "ab"[i % 3 == 0]) for i, w in enumerate(words)], "id int, t string, s string")
    ids = tokenize(df, "t", lambda: (lambda texts: [list(range(1, 1 + len(t.split()))) for t in texts]), 9)
    cut = {r.id: (r.ids, r.ids_cut) for r in ids.collect()}
    assert cut[5] == (None, None) and cut[11] == (list(range(1, 10)), False if 77 % 13 <= 9 else True)
    rows = padded_batches(ids, "id", ["ids"], "s", 16).collect()
    assert len(rows) == 70 and not any(c.startswith("_") for c in rows[0].asDict())
    for s in "ab":
        own = sorted((len(cut[r.id][0] or []), r.id) for r in rows if r.s == s)
        place = {i: k for k, (_, i) in enumerate(own)}
        for r in (r for r in rows if r.s == s):
            mine = own[place[r.id] // 16 * 16 :][:16]
            assert r.batch == place[r.id] // 16 and r.ids_width == max(n for n, _ in mine) == len(r.ids)
            assert [x for x in r.ids if x] == (cut[r.id][0] or [])
    assert padded_batches(ids.limit(0), "id", ["ids"], "s").count() == 0


def test_contextual_scores(spark):
    from defectflow.operators.metrics import contextual_scores, inverse_frequencies

    def model():  # a word and whether it stands first
        return lambda texts: [[(w, [float(len(w)), float(i == 0) * 9, 1.0]) for i, w in enumerate(t.split())] for t in texts]

    rows = [(0, "a bb ccc", "a bb ccc"), (1, "bb a", "a bb"), (2, "", "a"), (3, None, None), (4, "zz", "a zz zz")]
    df = spark.createDataFrame(rows, "id int, p string, r string")
    plain = {r.id: r for r in contextual_scores(df, ["id"], "p", "r", model).collect()}
    assert plain[0].f1 == pytest.approx(1) and plain[1].f1 < 0.99 and plain[2].f1 == plain[3].f1 == 0

    def by_hand(p, r, weight):
        vectors = [np.array([v for _, v in model()([t])[0]]) for t in (p, r)]
        words, others = p.split(), r.split()
        a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in vectors)
        s = a @ b.T
        return (np.average(s.max(axis=1), weights=[weight(w) for w in words]), np.average(s.max(axis=0), weights=[weight(w) for w in others]))

    assert (plain[1].precision, plain[1].recall) == pytest.approx(by_hand("bb a", "a bb", lambda w: 1))
    held = inverse_frequencies(df.select(F.split(F.coalesce("r", F.lit("")), " ").alias("t")), "t")
    table = {r.token: r.weight for r in held.collect()}
    assert table["a"] == pytest.approx(np.log(6 / 5)) and table["ccc"] == pytest.approx(np.log(6 / 2))
    weighed = {r.id: r for r in contextual_scores(df, ["id"], "p", "r", model, held).collect()}
    assert (weighed[1].precision, weighed[1].recall) == pytest.approx(by_hand("bb a", "a bb", table.get))
    unknown = contextual_scores(df, ["id"], "p", "r", model, held.where("token = 'none'"))
    assert {r.f1 for r in unknown.collect()} == {0.0}


def test_vectors_of_contextual_scores_travel_packed(spark, tmp_path):
    from defectflow.operators import metrics

    rng = np.random.default_rng(5)
    for shape in ((0, 0), (1, 3), (40, 34)):
        matrix = rng.normal(size=shape)
        assert (metrics._unpack(metrics._block(matrix), shape[0]) == matrix).all()
    digits = np.floor(rng.random((500, 34)) * 16) - 7.5
    assert len(metrics._block(digits)) < digits.nbytes / 8

    def model():
        return lambda texts: [[(w, [float(len(w)), float(i == 0) * 9, 1.0 / 3]) for i, w in enumerate(t.split())] for t in texts]

    rows = [(0, "a bb ccc", "a bb ccc dd"), (1, "bb a", "a bb"), (None, "x", None), (2, "bb a", "a bb"), (2, "bb a", "a bb")]
    df = spark.createDataFrame(rows, "id int, p string, r string")
    plain = metrics.contextual_scores(df, ["id"], "p", "r", model)
    assert {f.dataType.simpleString() for f in spark.read.parquet(plain.inputFiles()[0]).schema} == {"string", "struct<forms:array<string>,vectors:binary>"}
    kept = metrics.contextual_scores(df, ["id"], "p", "r", model, cache=str(tmp_path), model="m")
    assert sorted(map(str, plain.collect())) == sorted(map(str, kept.collect())) and plain.count() == 4
