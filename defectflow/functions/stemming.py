"""Porter stemming (M. F. Porter, 1980) of token arrays, plain or with the rules that text scorers add.

The additions: a list of irregular forms; four-letter words in ``ies`` and ``ied``
keep an ``ie``; ``y`` becomes ``i`` only after a consonant with a letter before it;
``bli``, ``fulli`` and ``logi`` as suffixes, and another round after ``alli``; a vowel
with a consonant counts as a short end. A batch is stemmed once per distinct token it holds, and
a worker remembers the latest stems up to a bound.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

# The suffix rules of steps 2, 3 and 4, longest match first
# within a step.
STEP2 = dict(
    ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent",
    eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful",
    ousness="ous", aliti="al", iviti="ive", biliti="ble",
)
STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
STEP4 = """al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize""".split()

# Forms that the scorers' rules do not reach.
IRREGULAR = dict(
    sky="sky", skies="sky", dying="die", lying="lie", tying="tie", news="news", innings="inning", inning="inning",
    outings="outing", outing="outing", cannings="canning", canning="canning", howe="howe", proceed="proceed",
    exceed="exceed", succeed="succeed",
)


def _shape(stem: str) -> str:
    """Letters as ``v`` or ``c``; ``y`` is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(stem):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short_end(stem: str, extended: bool) -> bool:
    shape = _shape(stem)
    return (shape[-3:] == "cvc" and stem[-1] not in "wxy") or (extended and shape == "vc")


def _double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def _swap(word: str, rules, least: int) -> str:
    for suffix in sorted(rules, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + rules[suffix] if _measure(stem) > least else word
    return word


def _plural(word: str, extended: bool) -> str:
    if extended and len(word) == 4 and word.endswith("ies"):
        return word[:-1]
    if word.endswith("sses") or word.endswith("ies"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str, extended: bool) -> str:
    if extended and word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        stem = word[: -len(suffix)]
        if word.endswith(suffix) and "v" in _shape(stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _double(stem):
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _short_end(stem, extended) else stem
    return word


def _long_suffix(word: str, extended: bool) -> str:
    if not extended:
        return _swap(word, STEP2, 0)
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _long_suffix(word[:-2], extended)
    if word.endswith("logi"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    rules = {k: v for k, v in STEP2.items() if k != "abli"} | {"bli": "ble", "fulli": "ful"}
    return _swap(word, rules, 0)


def porter_stem(word: str, extended: bool = False) -> str:
    """Stem of one lower-case word; words of one or two letters stay. ``extended`` adds the scorers' rules."""
    if extended and word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _past(_plural(word, extended), extended)
    if word.endswith("y"):
        stem = word[:-1]
        if (len(stem) > 1 and _shape(stem)[-1] == "c") if extended else "v" in _shape(stem):
            word = stem + "i"
    word = _swap(_long_suffix(word, extended), STEP3, 0)
    for suffix in sorted(STEP4, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short_end(stem, extended)):
            word = stem
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


@lru_cache(maxsize=1 << 17)
def _remembered(word: str, extended: bool) -> str:
    return porter_stem(word, extended)


def stem_tokens(tokens: Column, min_length: int = 1, extended: bool = True) -> Column:
    """Stem every token of an array that has at least ``min_length`` letters, by default as text scorers do."""

    @F.arrow_udf("array<string>")
    def stem(column: pa.Array) -> pa.Array:
        flat = column.flatten().dictionary_encode()
        known = [w if len(w) < min_length else _remembered(w, extended) for w in flat.dictionary.to_pylist()]
        values = pa.array(known, pa.string()).take(flat.indices)
        sizes = np.asarray(column.value_lengths().fill_null(0))
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype("int32"))
        mask = None if column.null_count == 0 else column.is_null()
        return pa.ListArray.from_arrays(offsets, values, mask=mask)

    return stem(tokens)
