"""User-supplied models: text to vector, prompt to text.

A factory is called once per Python worker and returns a callable that maps a
list of strings to a list of results. Distinct texts are computed once and
joined back by a hash of the text. With a cache, a table of outputs by that hash
outlives the job, and a model only ever sees texts that the table lacks.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from defectflow.functions.rules import numbered_steps
from defectflow.session import write_and_reread


def _batched(factory: Callable, return_type: str, batch: int, options: dict):
    kind = pd.DataFrame if return_type.startswith("struct<") else pd.Series

    def run(parts):
        model = factory()
        for texts in parts:
            values = texts.tolist()
            # What the model gave for one call leaves the worker before the next call.
            for start in range(0, len(values), batch):
                found = model(values[start:start + batch], **options)
                yield found if isinstance(found, pd.DataFrame) else pd.Series(list(found))

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[kind]}
    return F.pandas_udf(run, return_type)


def apply_distinct(df: DataFrame, text: str, output: str, factory, return_type: str, batch: int, options: dict,
                   cache: str | None = None, model: str | None = None) -> DataFrame:
    """Add a column computed by a model from each distinct text; see ``embed_text``."""
    table = distinct_outputs(df, text, output, factory, return_type, batch, options, cache, model)
    return df.withColumn("_hash", F.sha2(text, 256)).join(table, "_hash", "left").drop("_hash")


def distinct_outputs(df: DataFrame, text: str, output: str, factory, return_type: str, batch: int, options: dict,
                     cache: str | None = None, model: str | None = None) -> DataFrame:
    """``_hash, output`` of each distinct text that is not null; a model whose return type is a struct gives tables."""
    texts = df.select(F.sha2(text, 256).alias("_hash"), F.col(text).alias("_text")).where(F.col(text).isNotNull())
    texts = texts.dropDuplicates(["_hash"])
    run = _batched(factory, return_type, batch, options)
    if cache is None:
        # Written once, so that a model is never run again for the join below.
        return write_and_reread(texts.select("_hash", run(F.col("_text")).alias(output)), "model-output")
    return _cached(texts, run, return_type, cache, model, options).withColumnRenamed("value", output)


def _cached(texts: DataFrame, run: Callable, return_type: str, cache: str, model: str | None, options: dict) -> DataFrame:
    """``_hash, value`` of all texts, from the cache table or from the model, whose outputs are added to the table.

    The table is addressed by content: a folder for the model's name and options, rows by
    the sha256 of the text. Runs at the same time may add a row twice; one of them is read.
    """
    if not model:
        raise ValueError("a cache needs the name of the model")
    spark = texts.sparkSession
    setting = json.dumps([model, return_type, options], sort_keys=True, default=str)
    path = f"{cache.rstrip('/')}/{hashlib.sha256(setting.encode()).hexdigest()[:32]}"
    schema = f"hash string, value {return_type}"
    held = _finished_parts(spark, path)
    if held:
        known = spark.read.schema(schema).parquet(*held).select("hash")
        texts = texts.join(known, F.col("_hash") == F.col("hash"), "left_anti")
    # Each run writes a folder of its own: Spark takes two listings of one folder for the same table.
    part = f"{path}/part-{uuid.uuid4().hex}"
    texts.select(F.col("_hash").alias("hash"), run(F.col("_text")).alias("value")).write.parquet(part)
    found = spark.read.schema(schema).parquet(*held, part)
    return found.dropDuplicates(["hash"]).withColumnRenamed("hash", "_hash")


def _finished_parts(spark, path: str) -> list[str]:
    """The folders of runs that ended well."""
    home = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = home.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(home):
        return []
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(s.getPath().toString() for s in files.listStatus(home) if files.exists(done(s.getPath(), "_SUCCESS")))


def embed_text(df: DataFrame, text: str, factory: Callable, output: str = "embedding", batch: int = 32,
               cache: str | None = None, model: str | None = None, **options) -> DataFrame:
    """Add a vector per text from a user-supplied model; null texts have none.

    ``cache`` is a folder that all executors see; it keeps what ``model`` (a name
    that changes with its weights) gave under these options.
    """
    return apply_distinct(df, text, output, factory, "array<double>", batch, options, cache, model)


def generate_text(df: DataFrame, prompt: str, factory: Callable, output: str = "structured_output", batch: int = 8,
                  cache: str | None = None, model: str | None = None, **options) -> DataFrame:
    """Add generated text per prompt; options such as beams go to the model. ``cache`` as in ``embed_text``."""
    return apply_distinct(df, prompt, output, factory, "string", batch, options, cache, model)


def embed_column(factory: Callable, batch: int = 32, **options) -> Callable[[Column], Column]:
    """Column form of ``embed_text`` for streams: no distinct, no join."""
    return _batched(factory, "array<double>", batch, options)


def generate_column(factory: Callable, batch: int = 8, **options) -> Callable[[Column], Column]:
    return _batched(factory, "string", batch, options)


def rule_text(actions: Column) -> Column:
    """The built-in generator: rule actions as numbered steps."""
    return numbered_steps(actions)


def embed_token_table(df: DataFrame, identifier: str, tokens: str, table: DataFrame, output: str = "embedding"):
    """Mean of token vectors from a table ``(token, vector)``.

    Tokens are counted per row before the join. Rows without a known token get a null vector.
    """
    counted = (
        df.select(F.col(identifier).alias("_id"), F.explode(F.col(tokens)).alias("token"))
        .groupBy("_id", "token").agg(F.count(F.lit(1)).cast("double").alias("_w"))
    )
    means = (
        counted.join(table.select("token", "vector"), "token")
        .groupBy("_id").agg(Summarizer.mean(array_to_vector("vector"), F.col("_w")).alias("_m"))
        .select(F.col("_id").alias(identifier), vector_to_array("_m").alias(output))
    )
    return df.join(means, identifier, "left")
