"""String and token functions: native columns only, all usable on streams."""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F

# Equipment-code patterns of the serving cleaner, in order. The
# trailing space of the second one is part of the match.
EQUIPMENT_CODE_PATTERNS = (
    r"\b[a-z]-\d{4,}\b",
    r"\d{0,3}[a-z]{1,2}\d{1,10}[a-z]{0,3}\d{0,2}[a-z]{0,1}\d[0-2] ",
    r"\d{0,3}[a-z]{0,3}\d{7,10}[a-z]",
    r"\d{1,3}[a-z]{1,3}\d{2,4}",
    r"[a-z]\d{1,4}[a-z]\d{1}",
    r"[a-z]{1,2}\d{4}",
)
# Fixed value: the training cleaner's only pattern; upper case matters.
TRAINING_CODE_PATTERN = r"\b[A-Z]-\d{4,}\b"

# English stop words, the list Spark ML ships.
ENGLISH_STOPWORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him
his himself she her hers herself it its itself they them their theirs themselves
what which who whom this that these those am is are was were be been being have
has had having do does did doing a an the and but if or because as until while
of at by for with about against between into through during before after above
below to from up down in out on off over under again further then once here
there when where why how all any both each few more most other some such no nor
not only own same so than too very s t can will just don should now i'll you'll
he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's
she's it's we're they're i've we've you've they've isn't aren't wasn't weren't
haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't
mustn't can't couldn't cannot could here's how's let's ought that's there's
what's when's where's who's why's would
""".split()

# Unicode classes on, so that \d, \w and \s cover what the cleaning rules were
# written against; the four separators U+001C..U+001F count as white space.
_UNICODE = "(?U)"
_SPACE = r"[\s\x1c-\x1f]"
# The same white space as characters.
_SPACES = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove white space at both ends (plain ``trim`` only removes spaces)."""
    return F.trim(text, F.lit(_SPACES))


def collapse_whitespace(text: Column) -> Column:
    return F.regexp_replace(text, rf"{_UNICODE}{_SPACE}+", " ")


def strip_punctuation(text: Column) -> Column:
    """Delete the ASCII punctuation marks; nothing is put in their place."""
    return F.translate(text, string.punctuation, "")


def clean_serving(text: Column, collapse_ws: bool = False, null_token: str = "") -> Column:
    """Lower-case, delete equipment codes and punctuation, strip.

    Missing text becomes ``null_token``. Double spaces left by deleted codes
    stay unless ``collapse_ws`` is set.
    """
    lowered = F.lower(F.coalesce(text, F.lit(null_token)))
    coded = lowered
    for pattern in EQUIPMENT_CODE_PATTERNS:
        coded = F.regexp_replace(coded, "(?iU)" + pattern, "")
    # Every pattern needs a digit, so text without one skips all of them.
    out = strip_punctuation(F.when(lowered.rlike(_UNICODE + r"\d"), coded).otherwise(lowered))
    if collapse_ws:
        out = collapse_whitespace(out)
    return strip(out)


def clean_training(text: Column, null_token: str = "") -> Column:
    """Delete upper-case codes such as ``P-1234``, collapse white space, strip."""
    out = F.regexp_replace(F.coalesce(text, F.lit(null_token)), _UNICODE + TRAINING_CODE_PATTERN, "")
    return strip(collapse_whitespace(out))


def words(text: Column) -> Column:
    """White-space tokens; empty or missing text gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), rf"{_UNICODE}{_SPACE}+"), "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def language_tokens(text: Column) -> Column:
    """Lower-case words and punctuation marks, English contractions split off.

    ``don't`` gives ``do`` + ``n't``, ``pump's`` gives ``pump`` + ``'s``.
    """
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, r"(?U)(\w)(n't|'s|'re|'ve|'ll|'d|'m)\b", "$1 $2")
    return F.regexp_extract_all(out, F.lit(r"(?U)n't|'\w+|\w+|[^\w\s]"), F.lit(0))


def remove_stopwords(text: Column, stopwords=ENGLISH_STOPWORDS) -> Column:
    """Lower-case, tokenise, drop stop words, join by one space."""
    kept = F.filter(language_tokens(text), lambda token: ~token.isin(list(stopwords)))
    return F.array_join(kept, " ")


def truncate_pad(tokens: Column, length: int, pad: str = "<pad>") -> Column:
    """At most ``length`` tokens, padded to exactly that many."""
    kept = F.slice(tokens, 1, length)
    return F.concat(kept, F.array_repeat(F.lit(pad), length - F.size(kept)))


def is_truncated(tokens: Column, length: int) -> Column:
    return F.size(tokens) > length


def shorten(text: Column, length: int = 120, mark: str = "...") -> Column:
    """Cut to ``length`` characters and mark the cut."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit(mark))).otherwise(text)


def score_tokens(text: Column) -> Column:
    """Tokens of the overlap metrics: runs of ASCII letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")


def letter_tokens(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits of any script."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined n-grams of a token array."""
    if n == 1:
        return tokens
    count = F.size(tokens) - (n - 1)
    starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))
