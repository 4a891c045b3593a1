"""Scores of generated text."""

from pyspark.sql import functions as F

from defectflow.functions.rules import RULE_TOPICS, default_workflow, topic_tag
from defectflow.functions.vectors import TOKEN_DIMS
from defectflow.operators import metrics
from defectflow.operators.stats import stratified_split
from defectflow.plans.catalog import PAIRS, labelled_findings, query, tag_sql, turn_pairs
from defectflow.plans.catalog.tables import ACTED, _list_sql, actions_sql, acted, split_sql

KEY = ["conv_id", "turn"]
_LETTERS = r"[\p{L}\p{M}\p{N}]+"
# Steps whose omission is unsafe; used by the step score query.
CRITICAL_STEPS = ["Isolate pump", "Isolate affected area", "Pressure test", "Verify power supply", "Test operation",
                  "Inspect equipment", "Assess condition"]


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in (columns or ("precision", "recall", "f1"))})


_SCORES = """
scored AS (SELECT conv_id, turn, CASE WHEN pn > 0 THEN hit / pn ELSE 0 END AS precision,
                  CASE WHEN rn > 0 THEN hit / rn ELSE 0 END AS recall FROM sized),
final AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM scored)"""
_ROUND = "SELECT conv_id, turn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM final"


def _rouge_sql(n: int) -> str:
    def grams(column):
        parts = " || ' ' || ".join(f"t[i + {j}]" for j in range(n))
        return (f"SELECT conv_id, turn, unnest(list_transform(range(1, len(t) - {n - 2}), lambda i: {parts})) AS g "
                f"FROM (SELECT conv_id, turn, regexp_extract_all(lower({column}), '[a-z0-9]+') AS t FROM pairs)")

    return f"""{PAIRS},
p AS (SELECT conv_id, turn, g, count(*) AS c FROM ({grams('prediction')}) GROUP BY ALL),
r AS (SELECT conv_id, turn, g, count(*) AS c FROM ({grams('reference')}) GROUP BY ALL),
hits AS (SELECT conv_id, turn, sum(least(p.c, r.c)) AS hit FROM p JOIN r USING (conv_id, turn, g) GROUP BY ALL),
sized AS (
  SELECT conv_id, turn, coalesce(hit, 0) AS hit, coalesce(pn, 0) AS pn, coalesce(rn, 0) AS rn FROM pairs
  LEFT JOIN hits USING (conv_id, turn)
  LEFT JOIN (SELECT conv_id, turn, sum(c) AS pn FROM p GROUP BY ALL) USING (conv_id, turn)
  LEFT JOIN (SELECT conv_id, turn, sum(c) AS rn FROM r GROUP BY ALL) USING (conv_id, turn)),
{_SCORES}"""


@query("rouge_1", f"WITH {_rouge_sql(1)} {_ROUND}")
def rouge_1(spark, sf_dir):
    return _rounded(metrics.rouge_n(turn_pairs(spark, sf_dir), KEY, "prediction", "reference", 1, stemmer=False))


@query("rouge_2", f"WITH {_rouge_sql(2)} {_ROUND}")
def rouge_2(spark, sf_dir):
    return _rounded(metrics.rouge_n(turn_pairs(spark, sf_dir), KEY, "prediction", "reference", 2, stemmer=False))


@query("rouge_means", f"""WITH {_rouge_sql(1)} SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
round(avg(f1), 6) AS f1, count(*) AS pairs FROM final""")
def rouge_means(spark, sf_dir):
    scores = metrics.rouge_n(turn_pairs(spark, sf_dir), KEY, "prediction", "reference", 1, stemmer=False)
    return _rounded(metrics.mean_scores(scores))


# One dynamic-programming row per prediction token: best of the cell to the
# left (running maximum) and of the match or carry from the row above.
_LCS = """
tokens AS (SELECT conv_id, turn, regexp_extract_all(lower(prediction), '[a-z0-9]+') AS p,
                  regexp_extract_all(lower(reference), '[a-z0-9]+') AS r FROM pairs),
sized AS (
  SELECT conv_id, turn, len(p) AS pn, len(r) AS rn,
    CASE WHEN len(p) = 0 OR len(r) = 0 THEN 0 ELSE list_last(list_reduce(
      list_concat([list_transform(range(len(r) + 1), lambda z: 0)],
                  list_transform(p, lambda w: list_transform(r, lambda v: CASE WHEN v = w THEN 1 ELSE 0 END))),
      lambda above, hit: list_reduce(
        list_concat([[0]], list_transform(range(1, len(above)),
          lambda j: [CASE WHEN hit[j] = 1 THEN above[j] + 1 ELSE above[j + 1] END])),
        lambda row, cell: list_append(row, greatest(list_last(row), cell[1]))))) END AS hit
  FROM tokens)"""


@query("rouge_l", f"WITH {PAIRS}, {_LCS}, {_SCORES} {_ROUND}")
def rouge_l(spark, sf_dir):
    return _rounded(metrics.rouge_l(turn_pairs(spark, sf_dir), KEY, "prediction", "reference", stemmer=False))


@query("rouge_stemmed")
def rouge_stemmed(spark, sf_dir):
    """The three overlap scores with stemming, averaged: one row per score."""
    scores = metrics.rouge_scores(turn_pairs(spark, sf_dir), KEY, "prediction", "reference")
    return scores.groupBy("metric").agg(F.avg("f1").alias("f1"), F.count(F.lit(1)).alias("pairs"))


def _meteor_sql() -> str:
    def side(column):
        return (f"SELECT conv_id, turn, unnest(t) AS w, generate_subscripts(t, 1) AS pos FROM "
                f"(SELECT conv_id, turn, regexp_extract_all(lower({column}), '{_LETTERS}') AS t FROM pairs)")

    numbered = "row_number() OVER (PARTITION BY conv_id, turn, w ORDER BY pos DESC) AS k"
    return f"""WITH {PAIRS},
p AS (SELECT *, {numbered} FROM ({side('prediction')})),
r AS (SELECT *, {numbered} FROM ({side('reference')})),
m AS (SELECT conv_id, turn, p.pos AS a, r.pos AS b FROM p JOIN r USING (conv_id, turn, w, k)),
c AS (SELECT conv_id, turn, CASE WHEN a = lag(a) OVER w + 1 AND b = lag(b) OVER w + 1 THEN 0 ELSE 1 END AS fresh
      FROM m WINDOW w AS (PARTITION BY conv_id, turn ORDER BY a)),
g AS (SELECT conv_id, turn, count(*) AS matches, sum(fresh) AS chunks FROM c GROUP BY ALL),
n AS (SELECT conv_id, turn, coalesce(matches, 0)::BIGINT AS matches, coalesce(chunks, 0)::BIGINT AS chunks,
             len(regexp_extract_all(lower(prediction), '{_LETTERS}')) AS pn, len(regexp_extract_all(lower(reference), '{_LETTERS}')) AS rn
      FROM pairs LEFT JOIN g USING (conv_id, turn))
SELECT conv_id, turn, matches, chunks, round(CASE WHEN matches = 0 THEN 0 ELSE
  (matches / pn) * (matches / rn) / (0.9 * (matches / pn) + (1 - 0.9::DOUBLE) * (matches / rn)) * (1 - 0.5 * pow(chunks / matches, 3)) END, 6) AS score FROM n"""


@query("meteor", _meteor_sql())
def meteor(spark, sf_dir):
    scores = metrics.meteor(turn_pairs(spark, sf_dir), KEY, "prediction", "reference", stemmer=False)
    return _rounded(scores, "score")


@query("meteor_stemmed")
def meteor_stemmed(spark, sf_dir):
    scores = metrics.meteor(turn_pairs(spark, sf_dir), KEY, "prediction", "reference")
    return scores.agg(F.avg("score").alias("meteor"), F.count(F.lit(1)).alias("pairs"))


def _bertscore_sql() -> str:
    def side(column):
        return (f"SELECT conv_id, turn, w, count(*) AS c FROM (SELECT conv_id, turn, "
                f"unnest(regexp_extract_all(lower({column}), '{_LETTERS}')) AS w FROM pairs) GROUP BY ALL")

    vector = f"list_transform(range(1, {TOKEN_DIMS + 1}), lambda i: (strpos('0123456789abcdef', md5(w)[i]) - 1)::DOUBLE - 7.5)"
    return f"""{PAIRS},
pc AS ({side('prediction')}), rc AS ({side('reference')}),
vocabulary AS (SELECT w, {vector} AS v FROM (SELECT w FROM pc UNION SELECT w FROM rc)),
cosines AS (
  SELECT conv_id, turn, pc.w AS a, rc.w AS b, pc.c AS ac, rc.c AS bc, list_cosine_similarity(x.v, y.v) AS s
  FROM pc JOIN rc USING (conv_id, turn) JOIN vocabulary x ON x.w = pc.w JOIN vocabulary y ON y.w = rc.w),
pp AS (SELECT conv_id, turn, sum(ac * s) / sum(ac) AS precision FROM (SELECT conv_id, turn, a, any_value(ac) AS ac, max(s) AS s FROM cosines GROUP BY ALL) GROUP BY ALL),
rr AS (SELECT conv_id, turn, sum(bc * s) / sum(bc) AS recall FROM (SELECT conv_id, turn, b, any_value(bc) AS bc, max(s) AS s FROM cosines GROUP BY ALL) GROUP BY ALL),
scored AS (SELECT conv_id, turn, coalesce(precision, 0) AS precision, coalesce(recall, 0) AS recall
           FROM pairs LEFT JOIN pp USING (conv_id, turn) LEFT JOIN rr USING (conv_id, turn)),
final AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM scored)"""


@query("bertscore_static", f"WITH {_bertscore_sql()} {_ROUND}")
def bertscore_static(spark, sf_dir):
    return _rounded(metrics.bertscore(turn_pairs(spark, sf_dir), KEY, "prediction", "reference"))


@query("generalization_gap", f"""WITH {_rouge_sql(1)},
keyed AS (SELECT *, 'all' AS one, conv_id * 1000 + turn AS pair_id FROM final),
parts AS (SELECT * FROM {split_sql('keyed', 'one', 'pair_id')}),
means AS (SELECT avg(CASE WHEN split = 'val' THEN f1 END) AS vf, avg(CASE WHEN split = 'test' THEN f1 END) AS tf,
                 avg(CASE WHEN split = 'val' THEN recall END) AS vr, avg(CASE WHEN split = 'test' THEN recall END) AS tr FROM parts)
SELECT 'f1' AS metric, round(vf, 6) AS val, round(tf, 6) AS test, round(vf - tf, 6) AS gap FROM means
UNION ALL SELECT 'recall', round(vr, 6), round(tr, 6), round(vr - tr, 6) FROM means""")
def generalization_gap(spark, sf_dir):
    scores = metrics.rouge_n(turn_pairs(spark, sf_dir), KEY, "prediction", "reference", 1, stemmer=False)
    keyed = scores.select("f1", "recall", F.lit("all").alias("one"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"))
    split = stratified_split(keyed, "one", "pair_id")
    return _rounded(metrics.generalization_gap(split, "split", ["f1", "recall"]), "val", "test", "gap")


_TRUE_TOPIC, _FOUND_TOPIC = tag_sql("label", RULE_TOPICS), tag_sql("cluster_id", RULE_TOPICS)


@query("critical_step_scores", f"""WITH {ACTED},
steps AS (SELECT {_TRUE_TOPIC} AS topic, list_intersect(actions, {_list_sql(CRITICAL_STEPS)}) AS p,
                 list_intersect(CASE WHEN clean = '' THEN {_list_sql([])}::VARCHAR[] ELSE {actions_sql(_TRUE_TOPIC, 'clean')} END, {_list_sql(CRITICAL_STEPS)}) AS e FROM acted)
SELECT topic, round(avg(CASE WHEN len(p) > 0 THEN len(list_intersect(p, e)) / len(p) ELSE 0 END), 6) AS precision,
       round(avg(CASE WHEN len(e) > 0 THEN len(list_intersect(p, e)) / len(e) ELSE 0 END), 6) AS recall, count(*) AS rows
FROM steps GROUP BY topic""")
def critical_step_scores(spark, sf_dir):
    rows = acted(spark, sf_dir).withColumn("topic", topic_tag(F.col("label"), RULE_TOPICS))
    rows = rows.withColumn("expected", default_workflow(F.col("topic"), F.col("clean")))
    out = metrics.critical_step_scores(rows, "actions", "expected", "topic", CRITICAL_STEPS)
    return _rounded(out, "precision", "recall")


@query("qualitative_examples", f"""WITH {ACTED}, parts AS (SELECT * FROM {split_sql('acted', 'cluster_id', 'finding_id')})
SELECT finding_id, {_TRUE_TOPIC} AS topic, clean, array_to_string({actions_sql(_TRUE_TOPIC, 'clean')}, ' → ') AS reference,
       array_to_string(actions, ' → ') AS prediction FROM parts WHERE split = 'test' ORDER BY finding_id LIMIT 5""")
def qualitative_examples(spark, sf_dir):
    rows = stratified_split(acted(spark, sf_dir), "cluster_id", "finding_id")
    topic = topic_tag(F.col("label"), RULE_TOPICS)
    shown = rows.withColumns({
        "topic": topic, "reference": F.array_join(default_workflow(topic, F.col("clean")), " → "),
        "prediction": F.array_join("actions", " → ")})
    return metrics.qualitative_examples(shown, "finding_id", ["topic", "clean", "reference", "prediction"])
