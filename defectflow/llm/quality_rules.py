"""Quality rules: text statistics, and robust multivariate outliers among them."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from defectflow.llm.common import SPACES
from defectflow.session import write_and_reread

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper")
#: Statistics of the outlier test and the least spread that each is given, so that a statistic which is
#: the same in nearly all clean texts does not make a text with one odd line an outlier.
#: Most clean texts repeat nothing, so ``x_lines`` and ``x_repeats`` are square roots, whose range can exceed the limit: about
#: 44 copied lines per 1,000 words or 25 % of repeated words reject alone. The texts labelled good on sf0.1 that pass the base
#: rules have 14 and 22.8 at their 99.9 % quantiles.
FEATURES = {"x_length": 0.1, "x_symbols": 0.6, "x_lines": 1.2, "x_repeats": 0.9, "x_upper": 0.5}
_WINDOW = 8
_PAIRS = list(combinations_with_replacement(range(len(FEATURES)), 2))


def text_counts(text: str | None) -> tuple[int, ...]:
    """The values of :data:`COUNTS` for one text; null is the empty text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at ASCII white space only
    chars = len(text) - sum(map(text.count, SPACES))
    seen, again = set(), 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.strip(SPACES):
            seen.add(line)
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return len(words), chars, sum(map(text.count, SYMBOLS)), again, _repeated_words(words), upper


def _repeated_words(words: list[bytes]) -> int:
    """Words inside windows of eight words that occur twice or more."""
    n = len(words) - _WINDOW + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), "int64", len(words)).view("uint64")
    keys = np.zeros(n, "uint64")
    for i in range(_WINDOW):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    repeated = np.zeros(n, bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, "int64")
    starts = np.flatnonzero(repeated)
    edges[starts] += 1
    edges[starts + _WINDOW] -= 1
    return int(np.count_nonzero(np.cumsum(edges)))


def text_statistics(docs: DataFrame, text_col: str, keep: Sequence[str]) -> DataFrame:
    """The ``keep`` columns and :data:`COUNTS` of every row."""
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([*rows.drop("_text").schema, *[T.StructField(c, T.LongType()) for c in COUNTS]])

    def count(batches):
        for batch in batches:
            found = [text_counts(t.as_py()) for t in batch.column("_text")]
            columns = np.array(found, "int64").reshape(len(found), len(COUNTS))
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*kept, *[pa.array(columns[:, i]) for i in range(len(COUNTS))]], [*keep, *COUNTS]
            )

    return rows.mapInArrow(count, schema)


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_words: int = 20,
    max_repeated_percent: int = 30,
    share: float = 0.75,
    reject_at: float = 0.99999,
    steps: int = 4,
    prior_rows: int = 30,
) -> DataFrame:
    """Text statistics, the base rules, and the verdict of the outlier test.

    Returns ``id_col``, the :data:`COUNTS`, ``base_failed``, ``distance`` and
    ``kept``. A row fails the base rules with fewer than ``min_words`` words or
    more than ``max_repeated_percent`` % of its words in repeated windows. Others
    are rejected when the squared Mahalanobis distance of their transformed
    statistics exceeds the ``reject_at`` quantile of chi-squared.

    Centre and covariance are minimum-covariance-determinant estimates for each
    (language, source), found by concentration steps over all rows that pass the
    base rules: take the ``share`` of rows nearest to the last estimate, estimate
    anew. A step is one pass over the narrow statistics: rows are counted and
    summed per fine band of distance with partial aggregates, and the nearest
    bands that hold the share make the next estimate, so no group is collected.
    Estimates start from medians and quartiles of the language and are drawn
    towards the language's with the weight of ``prior_rows`` rows, for sources
    with few. Null languages and sources form groups of their own; null and empty
    texts have no words and fail. Repeated rows each count. An empty table gives
    an empty result.
    """
    keyed = docs.select(
        F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"),
        F.col(text_col).alias("_body"),
    )
    rows = text_statistics(keyed, "_body", ["_id", "_lang", "_source"])
    n = F.greatest("n_words", F.lit(1))
    chars = F.greatest("word_chars", F.lit(1))
    rows = rows.withColumns({
        "base_failed": (F.col("n_words") < min_words)
        | (100 * F.col("n_repeat_words") > max_repeated_percent * F.col("n_words")),
        "x_length": F.log(chars / n), "x_symbols": F.log1p(1000 * F.col("n_symbols") / chars),
        "x_lines": F.sqrt(1000 * F.col("n_dup_lines") / n), "x_repeats": F.sqrt(100 * F.col("n_repeat_words") / n),
        "x_upper": F.log1p(100 * F.col("n_upper") / chars),
    })
    rows = write_and_reread(rows, "rules-statistics")
    good = rows.where("not base_failed")
    model = _start(good)
    for keys in (["_lang"], ["_lang", "_source"]):
        prior = model
        for _ in range(steps):
            model = _concentrate(good, model, prior, keys, share, prior_rows)
    judged = _with_distance(rows, model)
    limit = _chi2_quantile(reject_at, len(FEATURES))
    return judged.select(
        F.col("_id").alias(id_col), *COUNTS, "base_failed", "distance",
        (~F.col("base_failed") & ~F.coalesce(F.col("distance") > limit, F.lit(False))).alias("kept"),
    )


def _start(rows: DataFrame) -> DataFrame:
    """Per language: medians, and a diagonal covariance from the quartiles."""
    quartiles = rows.groupBy("_lang").agg(*[
        F.percentile_approx(c, [0.25, 0.5, 0.75], 2000).alias(c) for c in FEATURES
    ])
    size = len(FEATURES)
    spread = [F.pow(F.greatest((F.col(c)[2] - F.col(c)[0]) / 1.349, F.lit(least)), 2) for c, least in FEATURES.items()]
    zero = F.lit(0.0)
    model = quartiles.select(
        "_lang", F.array(*[F.col(c)[1] for c in FEATURES]).alias("_mean"),
        F.array(*[spread[i] if i == j else zero for i in range(size) for j in range(size)]).alias("_cov"),
        F.array(*[1 / spread[i] if i == j else zero for i in range(size) for j in range(size)]).alias("_inverse"),
    )
    return write_and_reread(model, "rules-model")


def _with_distance(rows: DataFrame, model: DataFrame) -> DataFrame:
    keys = [c for c in ("_lang", "_source") if c in model.columns]
    named = model.select(*[F.col(c).alias(f"_m{c}") for c in keys], "_mean", "_cov", "_inverse")
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_m{c}"))
    size = len(FEATURES)
    off = [F.col(c) - F.col("_mean")[i] for i, c in enumerate(FEATURES)]
    distance: Column = F.lit(0.0)
    for i, j in _PAIRS:
        distance = distance + off[i] * off[j] * F.col("_inverse")[i * size + j] * (1 if i == j else 2)
    return rows.join(named, same, "left").withColumn("distance", distance)


def _concentrate(rows, model, prior, keys, share, prior_rows) -> DataFrame:
    """One concentration step for all groups at once."""
    names = list(FEATURES)
    band = F.floor(64 * F.log1p(F.greatest("distance", F.lit(0.0)))).alias("_band")
    sums = _with_distance(rows, model).groupBy(*keys, band).agg(
        F.count("*").alias("_n"), *[F.sum(c).alias(f"_s{i}") for i, c in enumerate(names)],
        *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"_p{i}_{j}") for i, j in _PAIRS],
    )
    group = Window.partitionBy(*keys)
    nearer = group.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    near = sums.withColumns({
        "_before": F.coalesce(F.sum("_n").over(nearer), F.lit(0)), "_all": F.sum("_n").over(group),
    }).where(F.col("_before") < F.ceil(F.col("_all") * F.lit(share)))
    fields = ["_n", *[f"_s{i}" for i in range(len(names))], *[f"_p{i}_{j}" for i, j in _PAIRS]]
    total = near.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in fields])
    known = [c for c in keys if c in prior.columns]
    base = prior.select(*[F.col(c).alias(f"_b{c}") for c in known], F.col("_mean").alias("_bm"), F.col("_cov").alias("_bc"))
    same = F.lit(True)
    for c in known:
        same = same & F.col(c).eqNullSafe(F.col(f"_b{c}"))
    total = total.join(base, same)
    size, least = len(names), np.array(list(FEATURES.values()))
    factor = share / _chi2_cdf(_chi2_quantile(share, size), size + 2)

    @F.pandas_udf("mean array<double>, cov array<double>, inverse array<double>")
    def estimate(*columns: pd.Series) -> pd.DataFrame:
        out = []
        for *values, base_mean, base_cov in zip(*columns, strict=True):
            n, s, p = values[0], np.array(values[1 : 1 + size]), values[1 + size :]
            mean = s / n
            cov = np.zeros((size, size))
            for (i, j), v in zip(_PAIRS, p, strict=True):
                cov[i, j] = cov[j, i] = v / n - mean[i] * mean[j]
            own = n / (n + prior_rows)
            mean = own * mean + (1 - own) * np.array(base_mean)
            cov = own * factor * cov + (1 - own) * np.array(base_cov).reshape(size, size)
            cov += np.diag(np.maximum(least**2 - np.diag(cov), 1e-9))
            out.append((mean, cov.ravel(), np.linalg.inv(cov).ravel()))
        return pd.DataFrame(out, columns=["mean", "cov", "inverse"])

    fitted = total.select(*keys, estimate(*fields, "_bm", "_bc").alias("_e"))
    return write_and_reread(fitted.select(
        *keys, F.col("_e.mean").alias("_mean"), F.col("_e.cov").alias("_cov"), F.col("_e.inverse").alias("_inverse")
    ), "rules-model")


def _chi2_cdf(x: float, degrees: int) -> float:
    a, x = degrees / 2, x / 2
    term = total = 1 / a
    for k in range(1, 1000):
        term *= x / (a + k)
        total += term
        if term < total * 1e-15:
            break
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a))) if x > 0 else 0.0


def _chi2_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi2_cdf(middle, degrees) < p else (low, middle)
    return high
