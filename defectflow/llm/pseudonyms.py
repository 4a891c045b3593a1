"""Format-preserving pseudonyms for personal data, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from defectflow.llm.common import distinct_names, whole

_ROUNDS = 10
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_YEAR = r"(?:19|20)[0-9]{2}"
#: What each kind looks like. The first kind that fits at a place is taken.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "date": rf"(?<![0-9./-])(?:{_YEAR}([-/])[0-9]{{2}}\1[0-9]{{2}}|[0-9]{{2}}([./])[0-9]{{2}}\2{_YEAR})(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}([ -])[0-9]{4}\3[0-9]{4}\3[0-9]{4}|[0-9]{13,19})(?![0-9A-Za-z])",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_MAYBE = r"[0-9]|@|[0-9A-Fa-f]{32}"


def pseudonymize(
    docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()
) -> DataFrame:
    """Texts with personal data replaced by keyed pseudonyms of the same format.

    Returns ``id_col, text, n_found, found`` and the columns in ``carry``; ``found``
    lists ``(kind, pseudonym)`` in order of place. A value is permuted by a Feistel
    network over the exact set of values of its format, with ``key`` and its kind,
    so equal values get equal pseudonyms in all documents and different values
    different ones:

    * ``card``: 13 to 19 digits with a right check digit; all but the check digit
      are permuted, which is then made right again. Others stay as they are.
    * ``phone``: the last ten digits; ``ip``: all four octets.
    * ``ssn``: valid area, group and serial numbers among themselves.
    * ``date``: days of 1900 to 2099 among themselves, in the same layout; ``/``
      dates are read day first, or month first if only that is a date. Month-first
      dates keep month and, after the 28th, day, so that they stay apart.
    * ``email`` and ``secret`` (long hexadecimal words) have no numeric format; they
      get a keyed digest, the secret in its length and case.

    A narrow map of built-in functions; nothing is looked up or shuffled. Null
    texts are empty. Texts without such values come back unchanged. Repeated rows
    each give a row, an empty table an empty result.
    """
    distinct_names([id_col, "text", "n_found", "found", *carry])
    rows = docs.select(
        F.col(id_col).alias("_id"), F.struct(F.lit(0).alias("_"), *[F.col(c).alias(c) for c in carry]).alias("_carry"),
        whole(F.col(text_col)).alias("_text"),
    )
    values = F.when(F.col("_text").rlike(_MAYBE), F.regexp_extract_all("_text", F.lit(_ANY), F.lit(0)))
    rows = rows.withColumn("_values", F.coalesce(values, F.array().cast("array<string>")))
    rows = rows.withColumn("_new", F.transform("_values", lambda v: _replace(v, key)))
    gaps = F.split("_text", F.lit(_ANY), -1)
    written = F.zip_with("_values", "_new", lambda v, n: F.coalesce(n["pseudonym"], v))
    merged = F.array_join(
        F.zip_with(gaps, F.concat(written, F.array(F.lit(""))), lambda g, w: F.concat(g, w)), ""
    )
    found = F.filter("_new", lambda n: n["pseudonym"].isNotNull())
    return rows.select(
        F.col("_id").alias(id_col), F.when(F.size("_values") > 0, merged).otherwise(F.col("_text")).alias("text"),
        F.size(found).cast("long").alias("n_found"), found.alias("found"),
        *[F.col("_carry")[c].alias(c) for c in carry],
    )


def _replace(value: Column, key: str) -> Column:
    """``(kind, pseudonym)`` of one match; the pseudonym is null if the value is not valid."""
    makers: dict[str, Callable[[Column, str], Column]] = {
        "email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card, "secret": _secret,
    }
    kind = pseudonym = None
    for name, make in makers.items():
        fits = value.rlike(f"^(?:{_alone(PATTERNS[name])})$")
        made = make(value, f"{key}:{name}")
        kind = F.when(fits, F.lit(name)) if kind is None else kind.when(fits, F.lit(name))
        pseudonym = F.when(fits, made) if pseudonym is None else pseudonym.when(fits, made)
    return F.struct(kind.alias("kind"), pseudonym.alias("pseudonym"))


def _alone(pattern: str) -> str:
    """A pattern of the list above by itself: the group of ``card`` is then the first, not the third."""
    return pattern.replace(r"\3", r"\1")


def _feistel(x: Column, y: Column, x_size: Column | int, y_size: Column | int, key: str) -> Column:
    """A keyed permutation of the pairs ``x < x_size, y < y_size``, as a struct of two."""
    sizes = [s if isinstance(s, Column) else F.lit(s) for s in (x_size, y_size)]

    def noise(turn, half, size):
        text = F.concat_ws(":", F.lit(key), turn.cast("string"), half.cast("string"))
        return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long"), size.cast("long"))

    def turn(pair, i):
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(pair["x"] + noise(i, pair["y"], sizes[0]), sizes[0].cast("long")))
            .otherwise(pair["x"]).alias("x"),
            F.when(even, pair["y"]).otherwise(
                F.pmod(pair["y"] + noise(i, pair["x"], sizes[1]), sizes[1].cast("long"))
            ).alias("y"),
        )

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(_ROUNDS - 1)), start, turn)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _permute_digits(digits: Column, key: str) -> Column:
    size = F.length(digits)
    half = F.floor(size / 2).cast("int")

    def joined(pair):
        return F.concat(
            F.lpad(pair["x"].cast("string"), half, F.lit("0")),
            F.lpad(pair["y"].cast("string"), (size - half).cast("int"), F.lit("0")),
        )

    left, right = F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, size)
    ten = [F.pow(F.lit(10.0), n).cast("long") for n in (half, size - half)]
    return _with(_feistel(left, right, *ten, key), joined)


def _fill(mask: Column, digits: Column, skip: Column | int = 0) -> Column:
    """The mask with its digits, after the first ``skip`` of them, replaced in order."""
    skip = skip if isinstance(skip, Column) else F.lit(skip)

    def put(state, mark):
        digit = mark.between("0", "9")
        nth = state["n"] - skip
        return F.struct(
            (state["n"] + digit.cast("int")).alias("n"),
            F.concat(state["out"], F.when(digit & (nth >= 0), F.substring(digits, nth + 1, F.lit(1))).otherwise(mark))
            .alias("out"),
        )

    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"))
    return F.aggregate(F.split(mask, F.lit("")), start, put, lambda s: s["out"])


def _luhn(digits: Column) -> Column:
    """The sum of the check, with a check digit of 0 appended."""
    back = F.reverse(digits)

    def add(total, i):
        digit = F.substring(back, i, F.lit(1)).cast("int")
        double = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when(i % 2 == 1, double).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def _card(value: Column, key: str) -> Column:
    def make(digits):
        body = F.substring(digits, F.lit(1), F.length(digits) - 1)
        valid = F.pmod(_luhn(body) + F.substring(digits, -1, 1).cast("int"), F.lit(10)) == 0

        def checked(new):
            return F.concat(new, F.pmod(-_luhn(new), F.lit(10)).cast("string"))

        return F.when(valid, _fill(value, _with(_permute_digits(body, key), checked)))

    return _with(_digits(value), make)


def _phone(value: Column, key: str) -> Column:
    def make(digits):
        return _fill(value, _permute_digits(F.substring(digits, -10, 10), key), F.length(digits) - 10)

    return _with(_digits(value), make)


def _ip(value: Column, key: str) -> Column:
    def make(parts):
        x, y = parts[0] * 256 + parts[1], parts[2] * 256 + parts[3]
        return _with(_feistel(x, y, 65536, 65536, key), lambda p: F.concat_ws(
            ".", *[v.cast("int").cast("string") for v in (
                F.floor(p["x"] / 256), p["x"] % 256, F.floor(p["y"] / 256), p["y"] % 256)]
        ))

    return _with(F.transform(F.split(value, F.lit(r"\.")), lambda p: p.cast("int")), make)


def _ssn(value: Column, key: str) -> Column:
    def make(parts):
        area, group, serial = parts[0], parts[1], parts[2]
        valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
        place = area - 1 - (area > 666).cast("int")

        def written(p):
            new = p["x"] + 1 + (p["x"] >= 665).cast("int")
            return F.concat_ws(
                "-", F.lpad(new.cast("string"), 3, "0"),
                F.lpad((F.floor(p["y"] / 9999) + 1).cast("string"), 2, "0"),
                F.lpad((p["y"] % 9999 + 1).cast("string"), 4, "0"),
            )

        pair = _feistel(place, (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key)
        return F.when(valid, _with(pair, written))

    return _with(F.transform(F.split(value, F.lit("-")), lambda p: p.cast("int")), make)


def _date(value: Column, key: str) -> Column:
    mark = F.regexp_extract(value, "[./-]", 0)
    year_first = value.rlike("^[0-9]{4}")

    def make(parts):
        year = F.when(year_first, parts[0]).otherwise(parts[2])
        month, day = parts[1], F.when(year_first, parts[2]).otherwise(parts[0])
        date = F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date")
        # 73,049 days from 1900 to 2099 are 17 times 4,297.
        number = F.date_diff(date, F.lit("1900-01-01").cast("date"))
        pair = _feistel(F.floor(number / 4297), number % 4297, 17, 4297, key)

        def written(p):
            new = F.date_add(F.lit("1900-01-01").cast("date"), (p["x"] * 4297 + p["y"]).cast("int"))
            return F.when(
                year_first, F.concat_ws("", F.date_format(new, "yyyy"), mark, F.date_format(new, "MM"), mark,
                                        F.date_format(new, "dd"))
            ).otherwise(F.concat_ws("", F.date_format(new, "dd"), mark, F.date_format(new, "MM"), mark,
                                    F.date_format(new, "yyyy")))

        american = F.try_make_timestamp(parts[2], parts[0], parts[1], F.lit(0), F.lit(0), F.lit(0))
        leap = (parts[0] == 2) & (parts[1] == 29)
        place = parts[2] - 1900

        def month_first(p, late):
            new_year = F.when(leap, 1904 + 4 * (p["x"] * 7 + p["y"])).otherwise(1900 + p["x"] * 10 + p["y"]) if late else (
                1900 + p["x"])
            new_day = parts[1].cast("long") if late else p["y"] + 13
            return F.concat_ws(
                mark_text, F.lpad(parts[0].cast("string"), 2, "0"), F.lpad(new_day.cast("string"), 2, "0"),
                new_year.cast("string"),
            )

        mark_text = "/"
        early = _with(_feistel(place, parts[1] - 13, 200, 16, f"{key}:{mark_text}"), lambda p: month_first(p, False))
        fours = (parts[2] - 1904) / 4
        x = F.when(leap, F.floor(fours / 7)).otherwise(F.floor(place / 10))
        y = F.when(leap, fours % 7).otherwise(place % 10)
        sizes = [F.when(leap, F.lit(7)).otherwise(F.lit(n)) for n in (20, 10)]
        late = _with(_feistel(x, y, *sizes, f"{key}:{mark_text}"), lambda p: month_first(p, True))
        return F.when(date.isNotNull(), _with(pair, written)).when(
            ~year_first & (mark == "/") & american.isNotNull(), F.when(parts[1] <= 28, early).otherwise(late)
        )

    return _with(F.transform(F.split(value, F.lit("[./-]")), lambda p: p.cast("int")), make)


def _email(value: Column, key: str) -> Column:
    digest = F.sha2(F.concat(F.lit(key + ":"), F.lower(value)), 256)
    return F.concat(F.lit("person-"), F.substring(digest, 1, 16), F.lit("@pseudonym.invalid"))


def _secret(value: Column, key: str) -> Column:
    # Keeps being recognised as a secret; a digest of all digits would be one in 1e13.
    digest = F.substring(F.sha2(F.concat(F.lit(key + ":"), F.lower(value)), 256), F.lit(1), F.length(value))
    return F.when(value.rlike("[A-Z]"), F.upper(digest)).otherwise(digest)
