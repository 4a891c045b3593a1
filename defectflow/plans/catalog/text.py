"""Cleaning, templates, tokens and text statistics."""

from pyspark.sql import functions as F

from defectflow.functions import templates as tpl, text as tx
from defectflow.functions.vectors import hash_embedding
from defectflow.operators import stats
from defectflow.plans.catalog import FINDINGS, clean_serving_sql, clean_training_sql, micro_text, query
from defectflow.sources.demo import findings, table

BOTH = f"WITH {FINDINGS}, corpus AS (SELECT 'f' AS kind, finding_id AS id, description AS text FROM findings UNION ALL SELECT 'd', doc_id, text FROM documents)"


def corpus(spark, sf_dir):
    """All findings and all documents as ``kind, id, text``."""
    rows = findings(spark, sf_dir).select(F.lit("f").alias("kind"), F.col("finding_id").alias("id"), F.col("description").alias("text"))
    return rows.unionByName(table(spark, sf_dir, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), "text"))


@query("clean_serving", f"{BOTH} SELECT kind, id, {clean_serving_sql('text')} AS clean FROM corpus")
def clean_serving(spark, sf_dir):
    return corpus(spark, sf_dir).select("kind", "id", tx.clean_serving(F.col("text")).alias("clean"))


@query("clean_training", f"{BOTH} SELECT kind, id, {clean_training_sql('text')} AS clean FROM corpus")
def clean_training(spark, sf_dir):
    return corpus(spark, sf_dir).select("kind", "id", tx.clean_training(F.col("text")).alias("clean"))


@query("text_steps", rf"""
SELECT doc_id, lower(text) AS lowered,
       translate(text, '!"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', '') AS unpunctuated,
       regexp_replace(text, '\s+', ' ', 'g') AS collapsed,
       regexp_replace(text, '^\s+|\s+$', '', 'g') AS stripped,
       contains(lower(text), 'leak') AS has_leak, contains(lower(text), 'the') AS has_the
FROM documents""".replace("{{", "{").replace("}}", "}"))
def text_steps(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.lower(t).alias("lowered"), tx.strip_punctuation(t).alias("unpunctuated"),
        tx.collapse_whitespace(t).alias("collapsed"), tx.strip(t).alias("stripped"),
        F.lower(t).contains("leak").alias("has_leak"), F.lower(t).contains("the").alias("has_the"),
    )


@query("classifier_text", f"""WITH {FINDINGS}
SELECT finding_id, concat('Priority: ', priority, '. Description: ', description, '. Initial Rec: ',
  initial_recommendation, '. ') AS text FROM findings""")
def classifier_text(spark, sf_dir):
    return findings(spark, sf_dir).select("finding_id", tpl.classifier_text(
        F.col("priority"), F.col("description"), F.col("initial_recommendation")).alias("text"))


@query("word_stats", rf"""{BOTH}
SELECT kind, id, len(regexp_extract_all(text, '\S+'))::INTEGER AS before,
       len(regexp_extract_all({clean_training_sql('text')}, '\S+'))::INTEGER AS after FROM corpus""")
def word_stats(spark, sf_dir):
    t = F.col("text")
    return corpus(spark, sf_dir).select(
        "kind", "id", tx.word_count(t).alias("before"), tx.word_count(tx.clean_training(t)).alias("after"))


@query("clean_impact", rf"""{BOTH},
counts AS (SELECT kind, len(regexp_extract_all(text, '\S+')) AS b,
                  len(regexp_extract_all({clean_training_sql('text')}, '\S+')) AS a FROM corpus)
SELECT round(avg(b), 6) AS mean_before, round(avg(a), 6) AS mean_after, round(avg(b) - avg(a), 6) AS mean_removed FROM counts""")
def clean_impact(spark, sf_dir):
    t = F.col("text")
    out = stats.mean_difference(corpus(spark, sf_dir), tx.word_count(t), tx.word_count(tx.clean_training(t)))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


_WORD = r"[\p{L}\p{M}\p{N}\p{Pc}]"
_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in tx.ENGLISH_STOPWORDS)


@query("stopwords_removed", rf"""
WITH tokens AS (
  SELECT doc_id, regexp_extract_all(
    regexp_replace(lower(text), '({_WORD})(n''t|''s|''re|''ve|''ll|''d|''m)\b', '\1 \2', 'g'),
    'n''t|''{_WORD}+|{_WORD}+|[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}\s]') AS t FROM documents)
SELECT doc_id, array_to_string(list_filter(t, lambda x: x NOT IN ({_STOP})), ' ') AS kept FROM tokens""")
def stopwords_removed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.remove_stopwords(F.col("text")).alias("kept"))


@query("truncate_pad_tokens", r"""
WITH tokens AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS t FROM documents)
SELECT doc_id,
       array_to_string(list_concat(t[1:128], list_transform(range(greatest(0, 128 - len(t))), lambda i: '<pad>')), ' ') AS input_tokens,
       array_to_string(list_concat(t[1:64], list_transform(range(greatest(0, 64 - len(t))), lambda i: '<pad>')), ' ') AS target_tokens,
       len(t) > 128 AS truncated
FROM tokens""")
def truncate_pad_tokens(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select("doc_id", tx.words(F.col("text")).alias("t"))
    t = F.col("t")
    return tokens.select(
        "doc_id", F.array_join(tx.truncate_pad(t, 128), " ").alias("input_tokens"),
        F.array_join(tx.truncate_pad(t, 64), " ").alias("target_tokens"), tx.is_truncated(t, 128).alias("truncated"))


@query("truncated_display", """
SELECT doc_id, CASE WHEN length(text) > 120 THEN concat(substr(text, 1, 120), '...') ELSE text END AS shown FROM documents""")
def truncated_display(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.shorten(F.col("text")).alias("shown"))


@query("hash_embedding", rf"""{BOTH},
tokens AS (SELECT kind, id, unnest(regexp_extract_all({clean_serving_sql('text')}, '\S+')) AS t FROM corpus),
cells AS (SELECT kind, id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 384 AS b, count(*) AS c FROM tokens GROUP BY ALL),
sized AS (SELECT *, sum(c) OVER (PARTITION BY kind, id) AS n FROM cells),
vectors AS (SELECT kind, id, string_agg(concat(b, ':', round(c * 1e6 / n)::BIGINT), ',' ORDER BY b) AS v FROM sized GROUP BY kind, id)
SELECT kind, id, coalesce(v, '') AS vector FROM corpus LEFT JOIN vectors USING (kind, id)""")
def hash_embedding_cells(spark, sf_dir):
    vector = hash_embedding(tx.clean_serving(F.col("text")))
    return corpus(spark, sf_dir).select("kind", "id", micro_text(vector, sparse=True).alias("vector"))
