"""Supplied models behind a lasting cache; stand-in models that SQL can compute as well."""

from pyspark.sql import functions as F

from defectflow.functions.rules import SERVING_TOPICS, topic_tag
from defectflow.functions.templates import summary_prompt
from defectflow.functions.text import clean_serving, letter_tokens
from defectflow.operators.metrics import contextual_scores, inverse_frequencies
from defectflow.operators.models import seq2seq_batches
from defectflow.operators.providers import embed_text, generate_text
from defectflow.plans.catalog import FINDINGS, PAIRS, clean_serving_sql, micro_sql, micro_text, query, tag_sql, turn_pairs
from defectflow.plans.catalog.evaluation import KEY, _LETTERS, _ROUND, _rounded
from defectflow.plans.catalog.tables import ACTED, _PAIR_SQL, acted, split_sql
from defectflow.session import scratch_path
from defectflow.sources import stages
from defectflow.sources.demo import findings, table


def letter_shares():
    """A stand-in for a sentence model: length, and the shares of some letters."""

    def model(texts, letters="etaoin"):
        return [[float(len(t)), *(t.count(c) / max(len(t), 1) for c in letters)] for t in texts]

    return model


def reversed_prompts():
    """A stand-in for a generator: the prompt backwards and in capitals, cut to a length."""

    def model(prompts, max_length=100):
        return [p[::-1].upper()[:max_length] for p in prompts]

    return model


_SHARES = ", ".join(f"(length(text) - length(replace(text, '{c}', ''))) / greatest(length(text), 1)" for c in "etaoin")


@query("embed_cached", f"""
SELECT doc_id, {micro_sql(f'[length(text)::DOUBLE, {_SHARES}]')} AS vector FROM documents""")
def embed_cached(spark, sf_dir):
    """Vectors of all documents through a cache that an earlier run on English ones has begun to fill."""
    docs, cache = table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), scratch_path(spark, "cache")
    embed_text(docs.where("lang = 'en'"), "text", letter_shares, cache=cache, model="letters-1")
    out = embed_text(docs, "text", letter_shares, cache=cache, model="letters-1")
    return out.select("doc_id", micro_text(F.col("embedding")).alias("vector"))


@query("generate_cached", f"""WITH {FINDINGS},
prompts AS (
  SELECT finding_id, concat('[TOPIC: ', {tag_sql('finding_id % 8', SERVING_TOPICS)}, '] Finding: ', {clean_serving_sql('description')},
    ' | Priority: ', priority, ' | New recommendation: ', initial_recommendation, ' | ') AS prompt FROM findings
)
SELECT finding_id, substr(upper(reverse(prompt)), 1, 80) AS structured_output FROM prompts""")
def generate_cached(spark, sf_dir):
    """Text for every finding's prompt through a cache; options of the model are part of its address."""
    rows, cache = findings(spark, sf_dir), scratch_path(spark, "cache")
    topic = topic_tag((F.col("finding_id") % 8).cast("int"), SERVING_TOPICS)
    prompts = rows.select("finding_id", summary_prompt(
        topic, clean_serving(F.col("description")), F.col("priority"), F.col("initial_recommendation")).alias("prompt"))
    generate_text(prompts.where("finding_id % 2 = 0"), "prompt", reversed_prompts, cache=cache, model="echo-1", max_length=80)
    out = generate_text(prompts, "prompt", reversed_prompts, cache=cache, model="echo-1", max_length=80)
    return out.select("finding_id", "structured_output")


def placed_digits():
    """A stand-in for a contextual model: the md5 digits of a word, its place, and the number of words of the text."""
    import hashlib

    import regex

    word = regex.compile(r"[\p{L}\p{M}\p{N}]+")

    def model(texts):
        out = []
        for text in texts:
            words = word.findall(text.lower())
            out.append([
                (w, [int(c, 16) - 7.5 for c in hashlib.md5(w.encode()).hexdigest()] + [5.0 * (i % 7), float(len(words) % 11)])
                for i, w in enumerate(words)])
        return out

    return model


def _contextual_sql(weight: str) -> str:
    def side(column):
        digits = "list_transform(range(1, 33), lambda i: (strpos('0123456789abcdef', md5(w)[i]) - 1)::DOUBLE - 7.5)"
        return f"""SELECT conv_id, turn, w, i, list_concat({digits}, [5.0 * ((i - 1) % 7), (n % 11)::DOUBLE]) AS v FROM (
  SELECT conv_id, turn, unnest(t) AS w, generate_subscripts(t, 1) AS i, len(t) AS n
  FROM (SELECT conv_id, turn, regexp_extract_all(lower({column}), '{_LETTERS}') AS t FROM pairs))"""

    return f"""{PAIRS},
p AS MATERIALIZED ({side('prediction')}), r AS MATERIALIZED ({side('reference')}),
weights AS (SELECT w, ln(((SELECT count(*) FROM pairs) + 1) / (count(*) + 1)) AS weight
            FROM (SELECT DISTINCT conv_id, turn, w FROM r) GROUP BY w),
cosines AS (
  SELECT p.conv_id, p.turn, p.w AS pw, p.i AS pi, r.w AS rw, r.i AS ri, list_cosine_similarity(p.v, r.v) AS s
  FROM p JOIN r ON p.conv_id = r.conv_id AND p.turn = r.turn),
best_p AS (SELECT conv_id, turn, pw AS w, max(s) AS s FROM cosines GROUP BY conv_id, turn, pw, pi),
best_r AS (SELECT conv_id, turn, rw AS w, max(s) AS s FROM cosines GROUP BY conv_id, turn, rw, ri),
pp AS (SELECT conv_id, turn, sum(s * {weight}) / nullif(sum({weight}), 0) AS x FROM best_p LEFT JOIN weights USING (w) GROUP BY ALL),
rr AS (SELECT conv_id, turn, sum(s * {weight}) / nullif(sum({weight}), 0) AS y FROM best_r LEFT JOIN weights USING (w) GROUP BY ALL),
scored AS (SELECT conv_id, turn, CASE WHEN x IS NULL OR y IS NULL THEN 0 ELSE x END AS precision,
                  CASE WHEN x IS NULL OR y IS NULL THEN 0 ELSE y END AS recall
           FROM pairs LEFT JOIN pp USING (conv_id, turn) LEFT JOIN rr USING (conv_id, turn)),
final AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM scored)"""


@query("bertscore_contextual", f"WITH {_contextual_sql('1')} {_ROUND}")
def bertscore_contextual(spark, sf_dir):
    return _rounded(contextual_scores(turn_pairs(spark, sf_dir), KEY, "prediction", "reference", placed_digits))


@query("bertscore_weighted", f"WITH {_contextual_sql('coalesce(weight, 0)')} {_ROUND}")
def bertscore_weighted(spark, sf_dir):
    """Contextual scores weighted by how rare a word is among the references."""
    pairs = turn_pairs(spark, sf_dir)
    weights = inverse_frequencies(pairs.select(letter_tokens(F.col("reference")).alias("t")), "t")
    return _rounded(contextual_scores(pairs, KEY, "prediction", "reference", placed_digits, weights))


def word_numbers():
    """A stand-in for a tokenizer: a number from the md5 of each word."""
    import hashlib

    return lambda texts: [[1 + int(hashlib.md5(w.encode()).hexdigest()[:6], 16) for w in t.split()] for t in texts]


def _ids_sql(text: str, n: int) -> str:
    return rf"list_transform(regexp_extract_all({text}, '\S+')[1:{n}], lambda w: 1 + ('0x' || substr(md5(w), 1, 6))::BIGINT)"


@query("seq2seq_files", rf"""WITH {ACTED}, texts AS (SELECT finding_id, split, {_PAIR_SQL} FROM {split_sql('acted', 'cluster_id', 'finding_id')}),
coded AS (SELECT finding_id, split, {_ids_sql('input_text', 12)} AS a, {_ids_sql('target_text', 64)} AS b,
                 len(regexp_extract_all(input_text, '\S+')) > 12 AS cut FROM texts),
placed AS (SELECT *, (row_number() OVER (PARTITION BY split ORDER BY len(a), finding_id) - 1) // 32 AS batch FROM coded),
wide AS (SELECT *, max(len(a)) OVER (PARTITION BY split, batch) AS aw, max(len(b)) OVER (PARTITION BY split, batch) AS bw FROM placed)
SELECT finding_id, split, batch::INTEGER AS batch, aw::INTEGER AS input_width, bw::INTEGER AS target_width, cut AS input_cut,
  array_to_string(list_concat(a, list_transform(range(aw - len(a)), lambda i: 0)), ' ') AS input_ids,
  array_to_string(list_concat(b, list_transform(range(bw - len(b)), lambda i: 0)), ' ') AS target_ids FROM wide""")
def seq2seq_files(spark, sf_dir):
    """Training batches by a supplied tokenizer, written by split and read back."""
    path = scratch_path(spark, "seq2seq")
    out = seq2seq_batches(
        acted(spark, sf_dir), "finding_id", "rule_topic", "clean", "actions", "cluster_id", word_numbers, input_length=12,
        cache=path + "-cache", model="words-1")
    stages.write_stage(out, path, partition_by=("split",))
    text = {c: F.array_join(F.transform(c, lambda i: i.cast("string")), " ") for c in ("input_ids", "target_ids")}
    return stages.read_stage(spark, path).withColumns(text).select(
        "finding_id", "split", "batch", F.col("input_ids_width").alias("input_width"), F.col("target_ids_width").alias("target_width"),
        F.col("input_ids_cut").alias("input_cut"), "input_ids", "target_ids")
