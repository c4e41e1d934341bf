"""Scalar text functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ascii_lower(x: str | Column) -> Column:
    """Lower case of A-Z alone; accented letters and the Kelvin sign stay."""
    return F.translate(_col(x), _UPPER, _LOWER)


def ascii_upper(x: str | Column) -> Column:
    return F.translate(_col(x), _LOWER, _UPPER)


def tokenize(x: str | Column) -> Column:
    """Maximal runs of ASCII letters, digits and underscores, in ASCII lower case."""
    # tokens are ASCII, so they can be lowered by the fast path; lowering A-Z alone in a whole text is slow
    return F.transform(F.regexp_extract_all(_col(x), F.lit("[A-Za-z0-9_]+"), F.lit(0)), F.lower)


def tokenize_unicode(x: str | Column) -> Column:
    """Runs of letters and digits of any script and underscores, in Unicode lower case."""
    return F.regexp_extract_all(F.lower(_col(x)), F.lit(r"([\p{L}\p{Nd}_]+)"), F.lit(1))


def tokenize_legacy(x: str | Column) -> Column:
    """Runs of letters and digits of any script; the underscore separates; only A-Z are lowered."""
    return F.regexp_extract_all(ascii_lower(x), F.lit(r"([\p{L}\p{Nd}]+)"), F.lit(1))


def _cut(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def _undouble(stem: Column) -> Column:
    last, before = F.substring(stem, -1, 1), F.substring(stem, -2, 1)
    return F.when((F.length(stem) > 2) & (last == before) & ~last.isin("l", "s", "z"), _cut(stem, 1)).otherwise(stem)


def stem(word: str | Column) -> Column:
    """Suffix stemmer; the first rule whose stem keeps two letters applies."""
    w = _col(word)
    size = F.length(w)
    return (
        F.when(size <= 3, w)
        .when(w.endswith("ying") & (size >= 6), _cut(w, 4))
        .when(w.endswith("ing") & (size >= 5), _undouble(_cut(w, 3)))
        .when(w.endswith("ly") & (size >= 5), _cut(w, 2))
        .when(w.endswith("ed"), _cut(w, 2))
        .when(w.endswith("ies"), F.concat(_cut(w, 3), F.lit("y")))
        .when(w.endswith("s"), _cut(w, 1))
        .otherwise(w)
    )


def stem_fast(word: str | Column) -> Column:
    """The lighter stemmer: the first suffix that fits decides, even if its guard then fails."""
    w = _col(word)
    size = F.length(w)

    def rule(long_enough: Column, short: Column) -> Column:
        return F.when(long_enough, short).otherwise(w)

    return (
        F.when(size <= 3, w)
        .when(w.endswith("ing"), rule(size > 4, _undouble(_cut(w, 3))))
        .when(w.endswith("ly"), rule(size > 4, _cut(w, 2)))
        .when(w.endswith("ed"), rule(size > 4, _cut(w, 2)))
        .when(w.endswith("ies"), rule(size > 4, F.concat(_cut(w, 3), F.lit("y"))))
        .when(w.endswith("s") & (F.substring(w, -2, 1) != "s"), _cut(w, 1))
        .otherwise(w)
    )


def tokenize_stemmed(x: str | Column) -> Column:
    return F.transform(tokenize(x), stem)


def tokenize_fast(x: str | Column) -> Column:
    """Plain tokens with the lighter stemmer; stop words stay."""
    return F.transform(tokenize(x), stem_fast)


def num_to_text(x: str | Column) -> Column:
    """Shortest plain decimal text of a number: 4.50 gives 4.5, 5.0 gives 5, never an exponent."""
    plain = _col(x).cast("decimal(38,10)").cast("string")
    return F.regexp_replace(F.regexp_replace(plain, "0+$", ""), "[.]$", "")


def to_text(x: str | Column, kind: T.DataType) -> Column:
    """Any value as the text that is indexed and compared; nested values as JSON."""
    c = _col(x)
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return num_to_text(c)
    if isinstance(kind, T.TimestampType):
        midnight = F.date_trunc("day", c) == c
        return F.when(midnight, F.date_format(c, "yyyy-MM-dd")).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSZ"))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def to_number(x: str | Column) -> Column:
    """A number, or null of what isn't one."""
    return _col(x).try_cast("double")


def record_text(schema: T.StructType, fields: list[str]) -> Column:
    """Texts of the fields in alphabetical order between single blanks; nulls leave no blank."""
    kinds = {f.name: f.dataType for f in schema.fields}
    return F.concat_ws(" ", *[to_text(F.col(f"`{f}`"), kinds[f]) for f in sorted(fields)])


def within(a: Column, b: Column, k: int) -> Column:
    """Whether the edit distance is at most k; the lengths decide most pairs before any matrix is filled."""
    return (F.abs(F.length(a) - F.length(b)) <= k) & (F.levenshtein(a, b, k) >= 0)
