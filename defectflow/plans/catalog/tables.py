"""Triage results, views, actions, counts, samples, splits, files."""

from pyspark.sql import functions as F

from defectflow.functions import rules, templates as tpl
from defectflow.functions.rules import ACTION_RULES, DEFAULT_ACTIONS, RULE_TOPICS, SERVING_TOPICS, topic_tag
from defectflow.functions.text import clean_serving
from defectflow.operators import stats
from defectflow.operators.models import seq2seq_dataset as build_seq2seq, seq2seq_pairs as build_pairs
from defectflow.plans.catalog import (
    FINDINGS, LABELLED, assigned, clean_serving_sql, embeddings, labelled_findings, query, tag_sql,
)
from defectflow.plans.triage import triage_assigned
from defectflow.session import scratch_path, write_and_reread
from defectflow.sources import findings as src, results
from defectflow.sources.demo import findings


def _list_sql(actions) -> str:
    return "[" + ", ".join(f"'{a}'" for a in actions) + "]"


def actions_sql(topic: str, text: str) -> str:
    cases = []
    for name, keywords, actions in ACTION_RULES:
        condition = f"{topic} = '{name}'"
        if keywords:
            condition += " AND (" + " OR ".join(f"contains(lower({text}), '{k}')" for k in keywords) + ")"
        cases.append(f"WHEN {condition} THEN {_list_sql(actions)}")
    return f"(CASE {' '.join(cases)} ELSE {_list_sql(DEFAULT_ACTIONS)} END)"


_RULE_TOPIC = tag_sql("cluster_id", RULE_TOPICS)
_TOPIC = tag_sql("cluster_id", SERVING_TOPICS)
ACTED = LABELLED + f""",
acted AS (SELECT *, CASE WHEN clean = '' THEN {_list_sql(DEFAULT_ACTIONS)} ELSE {actions_sql(_RULE_TOPIC, 'clean')} END AS actions FROM labelled)"""
TRIAGED = ACTED + f""",
triaged AS (
  SELECT finding_id, description AS DESCRIPTION, priority AS PRIORITY, initial_recommendation AS INITIAL_RECOMMENDATION,
         initial_recommendation AS PREDICTED_RECOMMENDATION, {_TOPIC} AS TOPIC_CATEGORY,
         concat('[STEPS:', len(actions), '] Actions: ',
                array_to_string(list_transform(range(1, len(actions) + 1), lambda i: concat(i, '. ', actions[i])), ' ')) AS STRUCTURED_OUTPUT
  FROM acted)"""


def triaged(spark, sf_dir):
    return triage_assigned(findings(spark, sf_dir), assigned(spark, sf_dir), "vec_id", ("finding_id",))


def acted(spark, sf_dir):
    rows = labelled_findings(spark, sf_dir)
    topic = topic_tag(F.col("cluster_id"), RULE_TOPICS)
    return rows.withColumn("rule_topic", topic).withColumn(
        "actions", rules.default_workflow(F.col("rule_topic"), F.col("clean")))


@query("triage", f"WITH {TRIAGED} SELECT * FROM triaged")
def triage(spark, sf_dir):
    return results.flatten_results(triaged(spark, sf_dir), ("finding_id",))


@query("triage_count", f"WITH {TRIAGED} SELECT count(*) AS results, count(DISTINCT finding_id) AS findings FROM triaged")
def triage_count(spark, sf_dir):
    return triaged(spark, sf_dir).agg(F.count(F.lit(1)).alias("results"), F.count_distinct("finding_id").alias("findings"))


@query("result_view", f"""WITH {TRIAGED} SELECT finding_id, DESCRIPTION AS description, INITIAL_RECOMMENDATION AS initial_rec,
PREDICTED_RECOMMENDATION AS predicted_rec, STRUCTURED_OUTPUT AS action_plan FROM triaged""")
def result_view(spark, sf_dir):
    return results.result_view(triage(spark, sf_dir), ("finding_id",))


@query("summary_view", f"""WITH {TRIAGED} SELECT finding_id, substr(DESCRIPTION, 1, 50) AS DESCRIPTION,
PREDICTED_RECOMMENDATION AS PREDICTED_REC, substr(TOPIC_CATEGORY, 1, 30) AS TOPIC FROM triaged""")
def summary_view(spark, sf_dir):
    return results.summary_view(triage(spark, sf_dir), ("finding_id",))


@query("summary_prompt", f"""WITH {LABELLED}
SELECT finding_id, concat('[TOPIC: ', {_TOPIC}, '] Finding: ', clean, ' | Priority: ', priority,
  ' | New recommendation: ', initial_recommendation, ' | ') AS prompt FROM labelled""")
def summary_prompt(spark, sf_dir):
    rows = labelled_findings(spark, sf_dir)
    return rows.select("finding_id", tpl.summary_prompt(
        topic_tag(F.col("cluster_id")), F.col("clean"), F.col("priority"), F.col("initial_recommendation")).alias("prompt"))


_PAIR_SQL = f"""concat('Topic: ', {_RULE_TOPIC}, '. Description: ', clean, '. Generate maintenance recommendation:') AS input_text,
concat('Actions: ', array_to_string(actions, ' → ')) AS target_text"""


@query("seq2seq_pairs", f"WITH {ACTED} SELECT finding_id, {_PAIR_SQL} FROM acted")
def seq2seq_pairs(spark, sf_dir):
    return build_pairs(acted(spark, sf_dir), "rule_topic", "clean", "actions").select("finding_id", "input_text", "target_text")


def split_sql(source: str, stratum: str, identifier: str) -> str:
    return f"""(SELECT *, CASE WHEN r <= round(n * 0.70) THEN 'train' WHEN r <= round(n * 0.85) THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY {stratum} ORDER BY md5('42:' || {identifier}), {identifier}) AS r,
             count(*) OVER (PARTITION BY {stratum}) AS n FROM {source}))"""


def _pad_sql(text: str, n: int) -> str:
    t = rf"regexp_extract_all({text}, '\S+')"
    return f"array_to_string(list_concat({t}[1:{n}], list_transform(range(greatest(0, {n} - len({t}))), lambda i: '<pad>')), ' ')"


@query("seq2seq_dataset", f"""WITH {ACTED}, texts AS (SELECT finding_id, split, {_PAIR_SQL} FROM {split_sql('acted', 'cluster_id', 'finding_id')})
SELECT finding_id, split, input_text, target_text, {_pad_sql('input_text', 128)} AS input_tokens,
       {_pad_sql('target_text', 64)} AS target_tokens FROM texts""")
def seq2seq_dataset(spark, sf_dir):
    out = build_seq2seq(acted(spark, sf_dir), "finding_id", "rule_topic", "clean", "actions", "cluster_id")
    return out.withColumns({c: F.array_join(c, " ") for c in ("input_tokens", "target_tokens")})


@query("action_sequence", f"""WITH {LABELLED}
SELECT finding_id, array_to_string({actions_sql(_RULE_TOPIC, 'description')}, ' → ') AS actions FROM labelled""")
def action_sequence(spark, sf_dir):
    topic = topic_tag(F.col("cluster_id"), RULE_TOPICS)
    return labelled_findings(spark, sf_dir).select(
        "finding_id", rules.join_actions(rules.action_sequence(topic, F.col("description"))).alias("actions"))


@query("default_workflow", f"""WITH routed AS (
  SELECT doc_id, {clean_serving_sql('text')} AS clean, CASE WHEN source IS NULL THEN NULL ELSE 'Leakage/Corrosion' END AS topic FROM documents)
SELECT doc_id, array_to_string(CASE WHEN clean = '' OR topic IS NULL THEN {_list_sql(DEFAULT_ACTIONS)}
  ELSE {actions_sql('topic', 'clean')} END, ' → ') AS actions FROM routed""")
def default_workflow(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", clean_serving(F.col("text")).alias("clean"),
        F.when(F.col("source").isNotNull(), "Leakage/Corrosion").alias("topic"))
    return rows.select("doc_id", rules.join_actions(rules.default_workflow(F.col("topic"), F.col("clean"))).alias("actions"))


@query("parse_steps", f"""WITH {ACTED}
SELECT finding_id, len(actions)::INTEGER AS declared, generate_subscripts(actions, 1)::INTEGER AS step, unnest(actions) AS action, true AS consistent FROM acted""")
def parse_steps(spark, sf_dir):
    parsed = triaged(spark, sf_dir).select("finding_id", rules.parse_steps(F.col("structured_output")).alias("p"))
    return parsed.select("finding_id", "p.declared", "p.consistent", F.explode("p.steps").alias("s")).select(
        "finding_id", "declared", "s.step", "s.action", "consistent")


@query("describe_steps", f"""WITH {ACTED}, sized AS (SELECT len(actions) AS n FROM acted)
SELECT count(n) AS count, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n)::DOUBLE AS min,
       quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.75) AS p75, max(n)::DOUBLE AS max FROM sized""")
def describe_steps(spark, sf_dir):
    joined = acted(spark, sf_dir).select(rules.join_actions(F.col("actions")).alias("text"))
    out = stats.describe(joined.select(F.size(rules.split_actions(F.col("text"))).alias("n")), "n")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("describe_values", """
SELECT count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min,
       round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
       round(quantile_cont(value, 0.75), 6) AS p75, max(value) AS max FROM events""")
def describe_values(spark, sf_dir):
    out = stats.describe(spark.read.parquet(f"{sf_dir}/events.parquet"), "value")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "p25", "p50", "p75")})


@query("priority_counts", f"WITH {FINDINGS} SELECT priority, count(*) AS count FROM findings WHERE priority IS NOT NULL GROUP BY priority")
def priority_counts(spark, sf_dir):
    return stats.value_counts(findings(spark, sf_dir), "priority", by="key")


@query("topic_counts", f"WITH {LABELLED} SELECT {_RULE_TOPIC} AS topic, count(*) AS count FROM labelled GROUP BY topic")
def topic_counts(spark, sf_dir):
    rows = labelled_findings(spark, sf_dir).select(topic_tag(F.col("cluster_id"), RULE_TOPICS).alias("topic"))
    return stats.value_counts(rows, "topic")


@query("preview", f"WITH {FINDINGS} SELECT description, priority FROM findings ORDER BY finding_id LIMIT 5")
def preview(spark, sf_dir):
    return src.preview(findings(spark, sf_dir), 5, ["description", "priority"], "finding_id")


@query("seeded_sample", f"WITH {FINDINGS} SELECT finding_id, description FROM findings ORDER BY md5('42:' || finding_id), finding_id LIMIT 5")
def seeded_sample(spark, sf_dir):
    return stats.seeded_sample(findings(spark, sf_dir).select("finding_id", "description"), "finding_id", 5)


@query("stratified_split", f"WITH {FINDINGS} SELECT finding_id, priority, split FROM {split_sql('findings', 'priority', 'finding_id')}")
def stratified_split(spark, sf_dir):
    rows = findings(spark, sf_dir).select("finding_id", "priority")
    return stats.stratified_split(rows, "priority", "finding_id")


@query("split_report", f"""WITH parts AS (SELECT * FROM {split_sql('embeddings', 'label', 'vec_id')})
SELECT split, label, count(*) AS rows, round(count(*) * 100.0 / (SELECT count(*) FROM parts), 4) AS percent FROM parts GROUP BY split, label""")
def split_report(spark, sf_dir):
    rows = embeddings(spark, sf_dir).select("vec_id", "label")
    return stats.split_report(stats.stratified_split(rows, "label", "vec_id"), "label")


@query("shape_report", f"""WITH {FINDINGS}
SELECT count(*) AS rows, 6::INTEGER AS columns, 'finding_id,vec_id,description,priority,initial_recommendation,ts' AS names FROM findings""")
def shape_report(spark, sf_dir):
    return stats.shape_report(findings(spark, sf_dir))


@query("csv_round_trip", f"""WITH {FINDINGS}
SELECT finding_id::VARCHAR AS finding_id, description || chr(10) || '"quoted", end' AS description, priority, initial_recommendation FROM findings""")
def csv_round_trip(spark, sf_dir):
    """Findings with line breaks and quotes written as CSV and read back."""
    rows = findings(spark, sf_dir).select(
        F.col("finding_id").cast("string").alias("finding_id"),
        F.concat("description", F.lit('\n"quoted", end')).alias("DESCRIPTION"), F.col("priority").alias("PRIORITY"),
        F.col("initial_recommendation").alias("INITIAL RECOMMENDATION"))
    path = scratch_path(spark, "findings") + ".csv"
    results.write_results(rows, path)
    return src.normalize_findings(src.read_findings(spark, path))


@query("stage_table", f"WITH {FINDINGS} SELECT finding_id, {clean_serving_sql('description')} AS cleaned_description FROM findings")
def stage_table(spark, sf_dir):
    rows = findings(spark, sf_dir).select("finding_id", clean_serving(F.col("description")).alias("cleaned_description"))
    return write_and_reread(rows, "stage")


_NAMES = "['DESCRIPTION', 'PRIORITY', 'INITIAL RECOMMENDATION']"


@query("schema_verdict", f"""WITH {FINDINGS}, n AS (SELECT count(*) AS n, count(*) FILTER (priority = '1') AS first FROM findings)
SELECT 'exact' AS case, true AS ok, concat('columns are valid, ', n, ' rows') AS message FROM n
UNION ALL SELECT 'contains', true, concat('columns are valid, ', first, ' rows') FROM n
UNION ALL SELECT 'extra', false, concat('expected columns ', $${_NAMES}$$, '; missing [], unexpected [''finding_id'']') FROM n
UNION ALL SELECT 'absent', false, concat('expected columns ', $${_NAMES}$$, '; missing [''PRIORITY''], unexpected []') FROM n""")
def schema_verdict(spark, sf_dir):
    """Findings written as CSV with all, more and fewer columns, read back and judged."""
    rows = findings(spark, sf_dir).select(
        "finding_id", F.col("description").alias("DESCRIPTION"), F.col("priority").alias("PRIORITY"),
        F.col("initial_recommendation").alias("INITIAL RECOMMENDATION"))
    cases = {
        "exact": (rows.drop("finding_id"), "exact"), "contains": (rows.where("PRIORITY = '1'"), "contains"),
        "extra": (rows, "exact"), "absent": (rows.drop("PRIORITY", "finding_id"), "contains"),
    }
    verdicts = []
    for name, (frame, mode) in cases.items():
        path = scratch_path(spark, name) + ".csv"
        results.write_results(frame, path)
        verdicts.append((name, *src.validate_columns(src.read_findings(spark, path), mode=mode, count_rows=True)))
    return spark.createDataFrame(verdicts, "case string, ok boolean, message string")
