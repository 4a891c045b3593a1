"""Scores of generated text against references.

A pair table has one row per pair: ``key`` columns, a prediction and a
reference. Scores come out as one row per pair; ``mean_scores`` averages them.
Tokens of a pair stay together in its row and are compared there.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from defectflow.functions.stemming import stem_tokens
from defectflow.functions.text import letter_tokens, ngrams, score_tokens
from defectflow.operators.lookups import keyed_join
from defectflow.operators.providers import distinct_outputs


def _f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2.0 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def _some_pairs(parts: Iterator[tuple[pa.Array, pa.Array]], size: int = 512) -> Iterator[list[tuple]]:
    """The values of two columns, some rows at a time: as Python objects they take many times their bytes."""
    for x, y in parts:
        for start in range(0, len(x), size):
            yield list(zip(x.slice(start, size).to_pylist(), y.slice(start, size).to_pylist(), strict=True))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _tokens(text: Column, stemmer: bool) -> Column:
    # Words of three letters and fewer are not stemmed in overlap scores.
    return stem_tokens(score_tokens(text), min_length=4) if stemmer else score_tokens(text)


def rouge_n(pairs: DataFrame, key: list[str], prediction: str, reference: str, n: int = 1,
            stemmer: bool = True) -> DataFrame:
    """N-gram overlap: ``key, precision, recall, f1``. No shuffle.

    The stemmer follows Porter's rules with the additions that scorers use.
    """
    # Tokens are a column of their own: array lambdas cannot hold the stemmer.
    tokens = pairs.select(
        *key, _tokens(F.col(prediction), stemmer).alias("pt"), _tokens(F.col(reference), stemmer).alias("rt")
    ).select(*key, ngrams(F.col("pt"), n).alias("pt"), ngrams(F.col("rt"), n).alias("rt"))
    scored = tokens.select(*key, common_items(F.col("pt"), F.col("rt")).alias("hit"),
                           F.size("pt").alias("p"), F.size("rt").alias("r"))
    out = scored.withColumns({
        "precision": _ratio(F.col("hit"), F.col("p")), "recall": _ratio(F.col("hit"), F.col("r")),
    })
    return out.select(*key, "precision", "recall", _f1(F.col("precision"), F.col("recall")).alias("f1"))


def common_items(a: Column, b: Column) -> Column:
    """Size of the intersection of two arrays as multisets."""

    @F.arrow_udf("int")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([(Counter(p) & Counter(r)).total() for p, r in zip(x.to_pylist(), y.to_pylist())], pa.int32())

    return run(a, b)


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two token arrays.

    Bit-parallel: one addition on a wide integer per token of ``a``.
    """

    @F.arrow_udf("int")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([_subsequence(left, right) for some in _some_pairs([(x, y)]) for left, right in some], pa.int32())

    return run(a, b)


def _subsequence(left: list[str], right: list[str]) -> int:
    places: dict[str, int] = {}
    for i, token in enumerate(right):
        places[token] = places.get(token, 0) | (1 << i)
    full = (1 << len(right)) - 1
    row = full
    for token in left:
        hit = row & places.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(right) - row.bit_count()


def rouge_scores(pairs: DataFrame, key: list[str], prediction: str, reference: str, stemmer: bool = True) -> DataFrame:
    """``rouge_n`` for words and word pairs and ``rouge_l`` from one pass: ``key, metric, precision, recall, f1``."""

    @F.arrow_udf("array<int>")
    def hits(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([
            [(Counter(p) & Counter(r)).total(), (Counter(zip(p, p[1:])) & Counter(zip(r, r[1:]))).total(), _subsequence(p, r)]
            for some in _some_pairs([(x, y)]) for p, r in some
        ], pa.list_(pa.int32()))

    tokens = pairs.select(
        *key, _tokens(F.col(prediction), stemmer).alias("p"), _tokens(F.col(reference), stemmer).alias("r"))
    counted = tokens.select(*key, hits("p", "r").alias("hit"), F.size("p").alias("p"), F.size("r").alias("r"))
    less = {"rouge1": 0, "rouge2": 1, "rougeL": 0}
    each = counted.select(*key, F.explode(F.array(*[F.struct(
        F.lit(name).alias("metric"), F.col("hit")[i].alias("hit"),
        *[F.greatest(F.col(c) - cut, F.lit(0)).alias(c) for c in "pr"]) for i, (name, cut) in enumerate(less.items())
    ])).alias("s")).select(*key, "s.*")
    out = each.withColumns({"precision": _ratio(F.col("hit"), F.col("p")), "recall": _ratio(F.col("hit"), F.col("r"))})
    return out.select(*key, "metric", "precision", "recall", _f1(F.col("precision"), F.col("recall")).alias("f1"))


def rouge_l(pairs: DataFrame, key: list[str], prediction: str, reference: str, stemmer: bool = True) -> DataFrame:
    """Longest-common-subsequence score: ``key, precision, recall, f1``. No shuffle."""
    tokens = pairs.select(
        *key, _tokens(F.col(prediction), stemmer).alias("p"), _tokens(F.col(reference), stemmer).alias("r")
    )
    common = tokens.select(*key, common_subsequence(F.col("p"), F.col("r")).alias("hit"),
                           F.size("p").alias("p"), F.size("r").alias("r"))
    out = common.withColumns({
        "precision": _ratio(F.col("hit"), F.col("p")), "recall": _ratio(F.col("hit"), F.col("r")),
    })
    return out.select(*key, "precision", "recall", _f1(F.col("precision"), F.col("recall")).alias("f1"))


def meteor(pairs: DataFrame, key: list[str], prediction: str, reference: str, stemmer: bool = True,
           synonyms: DataFrame | None = None, alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> DataFrame:
    """Alignment score with a word-order penalty: ``key, matches, chunks, score``.

    Stages: equal words, equal stems, then words sharing a group of the
    optional table ``synonyms(word, group)`` with one group per word. In each
    stage the last free occurrences of a form are aligned with each other, then
    the ones before them, and so on.
    """
    words = pairs.select(*key, letter_tokens(F.col(prediction)).alias("p"), letter_tokens(F.col(reference)).alias("r"))
    sides = [words.select(*key, "p", "r", *[(stem_tokens(F.col(c)) if stemmer else F.lit(None).cast("array<string>")).alias(f"{c}s") for c in "pr"])]
    known = F.lit(None).cast("map<string,string>")
    if synonyms is not None:
        # Only the words that a pair holds are joined with their groups.
        held = words.select(*key, F.explode(F.array_union("p", "r")).alias("word")).distinct()
        groups = synonyms.groupBy("word").agg(F.min(F.col("group").cast("string")).alias("_g")).where("word is not null and _g is not null")
        held = held.join(groups, "word").groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("word", "_g"))).alias("_groups"))
        sides = [keyed_join(sides[0], held, key)]
        known = F.first("_groups")
    # Rows of one key are scored as one pair; their tokens meet in one shuffle of whole arrays.
    grouped = sides[0].groupBy(*key).agg(
        F.collect_list(F.struct("p", "ps")).alias("hyp"), F.collect_list(F.struct("r", "rs")).alias("ref"),
        F.max(F.size("p")).alias("_p"), F.max(F.size("r")).alias("_r"), known.alias("groups"))
    aligned = grouped.select(*key, "_p", "_r", _aligned(F.col("hyp"), F.col("ref"), F.col("groups")).alias("a")).select(
        *key, "_p", "_r", "a.*")
    m, c = F.col("matches"), F.col("chunks")
    precision, recall = _ratio(m, F.col("_p")), _ratio(m, F.col("_r"))
    mean = F.when(m > 0, precision * recall / (alpha * precision + (1 - alpha) * recall)).otherwise(F.lit(0.0))
    penalty = F.when(m > 0, gamma * F.pow(c / m, F.lit(beta))).otherwise(F.lit(0.0))
    return aligned.select(*key, m, c, (mean * (1 - penalty)).alias("score"))


def _aligned(hyp: Column, ref: Column, groups: Column) -> Column:
    """``struct<matches, chunks>`` of the tokens (and stems) of two sides, pair by pair."""

    @F.arrow_udf("struct<matches:long,chunks:long>")
    def run(a: pa.Array, b: pa.Array, known: pa.Array) -> pa.Array:
        found = []
        for start in range(0, len(a), 256):
            some = (c.slice(start, 256).to_pylist(maps_as_pydicts="strict") for c in (a, b, known))
            found.extend(_alignment([_forms(x, k or {}) for x in h], [_forms(y, k or {}) for y in r]) for h, r, k in zip(*some, strict=True))
        return pa.array(found, pa.struct([("matches", pa.int64()), ("chunks", pa.int64())]))

    return run(hyp, ref, groups)


def _forms(side: dict, groups: dict) -> list[tuple]:
    """The forms of each token in the order of the stages: itself, its stem, its group."""
    tokens, stems = side.values()
    return list(zip(tokens, stems or [None] * len(tokens), [groups.get(t) for t in tokens], strict=True))


def _alignment(hyp: list[list[tuple]], ref: list[list[tuple]]) -> dict[str, int]:
    """Matches and chunks; in each stage the last free occurrences of a form meet, then the ones before them."""
    sides = [sorted(((pos, forms) for text in side for pos, forms in enumerate(text)), key=lambda t: t[0]) for side in (hyp, ref)]
    free, twins = sides, []
    for stage in range(3):
        open_places: dict[str, list[int]] = {}
        for at, (_, forms) in enumerate(free[1]):
            if forms[stage] is not None:
                open_places.setdefault(forms[stage], []).append(at)
        taken, left = set(), []
        for pos, forms in reversed(free[0]):
            places = open_places.get(forms[stage])
            if places:
                at = places.pop()
                taken.add(at)
                twins.append((pos, free[1][at][0]))
            else:
                left.append((pos, forms))
        free = [left[::-1], [t for at, t in enumerate(free[1]) if at not in taken]]
    twins.sort()
    goes_on = sum(x[0] == y[0] + 1 and x[1] == y[1] + 1 for x, y in zip(twins[1:], twins))
    return {"matches": len(twins), "chunks": len(twins) - goes_on}


def _matched(p: np.ndarray, pw: np.ndarray, r: np.ndarray, rw: np.ndarray) -> tuple[float, float]:
    """Precision and recall of two weighted sets of token vectors."""
    def unit(rows):
        return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-300)

    if not pw.sum() or not rw.sum():
        return 0.0, 0.0
    p, r = unit(p), unit(r)
    best_p, best_r = np.empty(len(p)), np.full(len(r), -np.inf)
    for start in range(0, len(p), 1_024):
        cosine = p[start:start + 1_024] @ r.T
        best_p[start:start + 1_024] = cosine.max(axis=1)
        best_r = np.maximum(best_r, cosine.max(axis=0))
    return np.average(best_p, weights=pw), np.average(best_r, weights=rw)


def _best_cosines(x: Column, wx: Column, y: Column, wy: Column) -> Column:
    """``struct<precision, recall>`` of two weighted sets of token vectors."""

    @F.arrow_udf("struct<precision:double,recall:double>")
    def run(a: pa.Array, wa: pa.Array, b: pa.Array, wb: pa.Array) -> pa.Array:
        def side(cells, weights):
            ends = np.concatenate([[0], np.cumsum(np.asarray(cells.value_lengths()))])
            inner = cells.flatten()
            rows = np.asarray(inner.flatten(), dtype=float).reshape(len(inner), -1) if len(inner) else np.zeros((0, 0))
            return ends, rows, np.asarray(weights.flatten(), dtype=float)

        p_ends, p_all, p_weight = side(a, wa)
        r_ends, r_all, r_weight = side(b, wb)
        found = np.zeros((len(a), 2))
        for i in range(len(a)):  # pair by pair: a copy of the whole batch could be large
            found[i] = _matched(
                p_all[p_ends[i]:p_ends[i + 1]], p_weight[p_ends[i]:p_ends[i + 1]],
                r_all[r_ends[i]:r_ends[i + 1]], r_weight[r_ends[i]:r_ends[i + 1]])
        return pa.StructArray.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["precision", "recall"])

    return run(x, wx, y, wy)


_PACKED = "struct<forms:array<string>,vectors:binary>"


def _block(vectors: np.ndarray) -> bytes:
    """The vectors of a text as one block, place by place and byte by byte, compressed."""
    planes = np.ascontiguousarray(vectors.T).view("uint8").reshape(-1, 8).T if vectors.size else np.zeros(0, "uint8")
    return zlib.compress(np.ascontiguousarray(planes), 1)


def _pack(tokens: list[tuple]) -> tuple[list[str], bytes]:
    return [t for t, _ in tokens], _block(np.array([v for _, v in tokens], "float64"))


def _unpack(block: bytes, tokens: int) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(block), "uint8")
    if not tokens or not len(planes):
        return np.zeros((tokens, 0))
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("float64").reshape(-1, tokens).T


def _packed(tokens: Column) -> Column:
    @F.arrow_udf(_PACKED)
    def run(cells: pa.Array) -> pa.Array:
        forms, blocks = [], []
        for cell in cells:
            inner = cell.values
            forms.append(inner.field("token").to_pylist())
            blocks.append(_block(np.asarray(inner.field("vector").flatten(), "float64").reshape(len(inner), -1) if len(inner) else np.zeros((0, 0))))
        return pa.StructArray.from_arrays([pa.array(forms, pa.list_(pa.string())), pa.array(blocks, pa.binary())], ["forms", "vectors"])

    return run(tokens)


def _packed_cosines(x: Column, wx: Column, y: Column, wy: Column) -> Column:
    """``_best_cosines`` of packed vectors, a pair at a time; null weights weigh all tokens alike."""

    @F.arrow_udf("struct<precision:double,recall:double>")
    def run(a: pa.Array, wa: pa.Array, b: pa.Array, wb: pa.Array) -> pa.Array:
        found = np.zeros((len(a), 2))
        for i in range(len(a)):
            sides = []
            for cell, weight in ((a[i], wa[i]), (b[i], wb[i])):
                n = cell["n"].as_py()
                own = np.ones(n) if weight.values is None else weight.values.to_numpy(zero_copy_only=False)
                sides += [_unpack(cell["vectors"].as_py(), n), own]
            found[i] = _matched(*sides)
        return pa.StructArray.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["precision", "recall"])

    return run(x, wx, y, wy)


def digest_vectors(tokens: list[str]) -> list[list[float]]:
    """The built-in token vectors: the md5 digits of the token, centred."""
    return [[int(c, 16) - 7.5 for c in hashlib.md5(t.encode()).hexdigest()] for t in tokens]


def bertscore(pairs: DataFrame, key: list[str], prediction: str, reference: str,
              token_table: DataFrame | None = None, factory: Callable | None = None) -> DataFrame:
    """Greedy cosine matching of token vectors: ``key, precision, recall, f1``.

    Each token takes its best match on the other side. Tokens are runs of
    letters, marks and digits of any script. ``factory()`` gives, once per Python
    worker, a model that maps a list of tokens to vectors; without it md5-derived
    vectors are used. Nothing is shuffled then. ``token_table(token, vector)``
    supplies static vectors by a join instead; tokens it lacks are left out.
    """
    sides = pairs.select(*key, letter_tokens(F.col(prediction)).alias("p"), letter_tokens(F.col(reference)).alias("r"))
    if token_table is None:
        make = factory or (lambda: digest_vectors)

        @F.arrow_udf("struct<precision:double,recall:double>")
        def match(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            model = make()
            for rows in _some_pairs(parts):
                every = sorted({t for pair in rows for side in pair for t in side})
                vectors = np.array(model(every) if every else [[0.0]], "float64")
                vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
                place = {t: i for i, t in enumerate(every)}
                yield pa.array([_greedy(p, r, place, vectors) for p, r in rows],
                               pa.struct([("precision", pa.float64()), ("recall", pa.float64())]))

        scored = sides.select(*key, match("p", "r").alias("s")).select(*key, "s.precision", "s.recall")
    else:
        sided = sides.select(*key, F.explode(F.array(
            F.struct(F.lit(True).alias("hyp"), F.col("p").alias("t")),
            F.struct(F.lit(False).alias("hyp"), F.col("r").alias("t")),
        )).alias("s")).select(*key, "s.hyp", F.explode_outer("s.t").alias("token"))
        known = F.col("token").isNotNull()
        counted = sided.groupBy(*key, "token").agg(
            F.count_if(F.col("hyp") & known).alias("p"), F.count_if(~F.col("hyp") & known).alias("r")
        )
        held = counted.join(token_table.select("token", "vector"), "token", "left")

        def side(weight: str):
            counts = (F.col(weight) > 0) & F.col("vector").isNotNull()
            return F.collect_list(F.when(counts, F.struct(F.col("vector"), F.col(weight).alias("w"))))

        grouped = held.groupBy(*key).agg(side("p").alias("p"), side("r").alias("r"))
        scored = grouped.select(*key, _best_cosines(
            F.col("p.vector"), F.col("p.w"), F.col("r.vector"), F.col("r.w")
        ).alias("s")).select(*key, "s.precision", "s.recall")
    return scored.select(*key, "precision", "recall", _f1(F.col("precision"), F.col("recall")).alias("f1"))


def inverse_frequencies(texts: DataFrame, tokens: str) -> DataFrame:
    """``token, weight``: ``log((N + 1) / (d + 1))`` for a token in ``d`` of ``N`` texts."""
    held = texts.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("_d"))
    total = texts.agg(F.count(F.lit(1)).alias("_n"))
    return held.join(total).select("token", F.log((F.col("_n") + 1) / (F.col("_d") + 1)).alias("weight"))


def contextual_scores(pairs: DataFrame, key: list[str], prediction: str, reference: str, factory: Callable,
                      weights: DataFrame | None = None, batch: int = 32, cache: str | None = None, model: str | None = None,
                      **options) -> DataFrame:
    """``bertscore`` with vectors that depend on the whole text: ``key, precision, recall, f1``.

    The model maps a list of texts to a list of token lists, each token a pair of
    its form and its vector, as many as the text has. It runs once for each distinct text
    (``cache`` and ``model`` as in ``embed_text``). ``weights(token, weight)`` weighs tokens, for
    instance by ``inverse_frequencies`` of the references; tokens it lacks weigh
    nothing. A side without tokens of any weight scores 0. ``key`` must name a pair.
    """
    kind = "array<struct<token:string,vector:array<double>>>"

    def make():
        inner = factory()
        return lambda values, **more: [[{"token": t, "vector": list(map(float, v))} for t, v in text] for text in inner(values, **more)]

    def make_packed():
        inner = factory()
        return lambda values, **more: pd.DataFrame([_pack(text) for text in inner(values, **more)], columns=["forms", "vectors"])

    texts = pairs.select(*key, *[F.coalesce(c, F.lit("")).alias(n) for c, n in ((prediction, "_p"), (reference, "_r"))])
    both = texts.select(F.explode(F.array("_p", "_r")).alias("text"))
    # Vectors are one compressed block a text from the model on; they are shuffled by text, and once more to the other side.
    if cache is None:
        coded = distinct_outputs(both, "text", "tokens", make_packed, _PACKED, batch, options)
    else:
        coded = distinct_outputs(both, "text", "tokens", make, kind, batch, options, cache, model).withColumn("tokens", _packed(F.col("tokens")))
    if weights is None:
        coded = coded.withColumn("w", F.lit(None).cast("array<double>"))
    else:
        # The vectors stay where they are; only forms are joined with their weights.
        forms = coded.select("_hash", F.explode(F.array_distinct("tokens.forms")).alias("token"))
        held = forms.join(weights.select("token", "weight"), "token").groupBy("_hash").agg(
            F.map_from_entries(F.collect_list(F.struct("token", F.col("weight").cast("double")))).alias("_weights"))
        coded = coded.join(held, "_hash", "left").select("_hash", "tokens", F.transform(
            "tokens.forms", lambda t: F.coalesce(F.try_element_at(F.col("_weights"), t), F.lit(0.0))).alias("w"))
    coded = coded.select("_hash", F.struct(F.size("tokens.forms").alias("n"), "tokens.vectors").alias("tokens"), "w")
    hashed = texts.select(*key, F.sha2("_p", 256).alias("_p"), F.sha2("_r", 256).alias("_r")).dropDuplicates(key)
    left, right = (coded.select(F.col("_hash").alias(c), F.col("tokens").alias(f"{c}_t"), F.col("w").alias(f"{c}_w")) for c in ("_p", "_r"))
    scored = hashed.join(left, "_p").join(right, "_r").select(
        *key, _packed_cosines(F.col("_p_t"), F.col("_p_w"), F.col("_r_t"), F.col("_r_w")).alias("s"))
    return scored.select(*key, "s.precision", "s.recall").select(
        *key, "precision", "recall", _f1(F.col("precision"), F.col("recall")).alias("f1"))


def _greedy(p: list[str], r: list[str], place: dict[str, int], vectors: np.ndarray) -> dict[str, float]:
    if not p or not r:
        return {"precision": 0.0, "recall": 0.0}
    left, right = Counter(p), Counter(r)
    gain = vectors[[place[t] for t in left]] @ vectors[[place[t] for t in right]].T
    return {
        "precision": float(np.average(gain.max(axis=1), weights=list(left.values()))),
        "recall": float(np.average(gain.max(axis=0), weights=list(right.values()))),
    }


def mean_scores(scores: DataFrame, *columns: str) -> DataFrame:
    """Corpus means of per-pair scores, as one row."""
    names = columns or ("precision", "recall", "f1")
    return scores.agg(*[F.avg(c).alias(c) for c in names], F.count(F.lit(1)).alias("pairs"))


def generalization_gap(scores: DataFrame, split: str, metrics: list[str], first: str = "val",
                       second: str = "test") -> DataFrame:
    """``metric, first, second, gap``: mean score per split and the difference."""
    def mean(metric, name):
        return F.avg(F.when(F.col(split) == name, F.col(metric)))

    one = scores.agg(F.array(*[
        F.struct(F.lit(m).alias("metric"), mean(m, first).alias(first), mean(m, second).alias(second)) for m in metrics
    ]).alias("rows"))
    return one.select(F.explode("rows").alias("r")).select("r.*").withColumn("gap", F.col(first) - F.col(second))


def qualitative_examples(df: DataFrame, identifier: str, columns: list[str], n: int = 5, split: str = "split",
                         name: str = "test") -> DataFrame:
    """The first ``n`` rows of a split, for reading side by side."""
    return df.where(F.col(split) == name).select(identifier, *columns).orderBy(identifier).limit(n)


def critical_step_scores(df: DataFrame, predicted: str, expected: str, topic: str,
                         critical: list[str] | None = None) -> DataFrame:
    """Mean precision and recall of steps per topic, duplicates ignored.

    With ``critical``, only those steps count. A side without steps scores 0.
    """
    def kept(name):
        steps = F.array_distinct(F.coalesce(F.col(name), F.array().cast("array<string>")))
        return F.array_intersect(steps, F.array(*[F.lit(c) for c in critical])) if critical is not None else steps

    sized = df.select(topic, kept(predicted).alias("p"), kept(expected).alias("e")).withColumn(
        "hit", F.size(F.array_intersect("p", "e"))
    )
    return sized.groupBy(topic).agg(
        F.avg(_ratio(F.col("hit"), F.size("p"))).alias("precision"),
        F.avg(_ratio(F.col("hit"), F.size("e"))).alias("recall"),
        F.count(F.lit(1)).alias("rows"),
    )
