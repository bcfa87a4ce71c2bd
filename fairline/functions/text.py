"""Name and token normalisation.

Pure-ASCII text, the bulk of any feed, stays in JVM expressions. Spark has no NFKC, NFKD or
case folding, so only the non-ASCII values travel (as Arrow batches) through a pandas UDF; the
ASCII rows reach Python as nulls.
"""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The UDFs travel with their helpers, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Token lists.
_PARTICIPANT_TYPES = ["team", "player", "pair", "other"]

_ASCII_ONLY = r"\A[\x00-\x7F]*\z"
_ASCII_SEPARATORS = r"[\p{Punct}\s\x1C-\x1F]+"

# The characters str.strip() removes.
_SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


class _Separators(dict):
    """Translation table that maps punctuation, symbols and spaces to a blank, filled on demand."""

    def __missing__(self, codepoint: int) -> str:
        char = chr(codepoint)
        separates = char.isspace() or unicodedata.category(char)[0] in "PSZ"
        self[codepoint] = " " if separates else char
        return self[codepoint]


class _WordChars(dict):
    """Translation table that keeps letters, digits and underscores and blanks the rest."""

    def __missing__(self, codepoint: int) -> str:
        char = chr(codepoint)
        self[codepoint] = char if char == "_" or char.isalnum() else " "
        return self[codepoint]


_SEPARATORS = _Separators()
_WORD_CHARS = _WordChars()


def strict_name(value: str) -> str:
    folded = unicodedata.normalize("NFKC", value.strip()).casefold()
    return " ".join(folded.translate(_SEPARATORS).split())


def folded_name(strict: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", strict) if unicodedata.category(c) != "Mn")


def token_text(value: str) -> str:
    blanked = unicodedata.normalize("NFKC", value).casefold().translate(_WORD_CHARS)
    return "_".join(blanked.split()).strip("_")


_NAME_FORMS = T.StructType([T.StructField("strict", T.StringType()), T.StructField("folded", T.StringType())])


@F.pandas_udf(_NAME_FORMS)
def _unicode_names(values: pd.Series) -> pd.DataFrame:
    strict = values.map(strict_name, na_action="ignore")
    return pd.DataFrame({"strict": strict, "folded": strict.map(folded_name, na_action="ignore")})


@F.pandas_udf(T.StringType())
def _unicode_tokens(values: pd.Series) -> pd.Series:
    return values.map(token_text, na_action="ignore")


def is_ascii(col: Column) -> Column:
    return col.rlike(_ASCII_ONLY)


def _plain_ends(col: Column) -> Column:
    """Whether the text starts and ends with a visible ASCII character, so that there is nothing to trim; null for null."""
    last = F.substring(col, -1, 1)
    return (col >= "!") & (col < "\x7f") & (last >= "!") & (last < "\x7f")


def strip(col: Column) -> Column:
    """Trim every kind of white space, not only blanks; ends are looked up in the list of spaces only where they may be one."""
    return F.when(_plain_ends(col), col).otherwise(F.btrim(col, F.lit(_SPACES)))


def blank_to_null(col: Column) -> Column:
    return F.when(_plain_ends(col), col).otherwise(F.nullif(F.btrim(col, F.lit(_SPACES)), F.lit("")))


def with_normalized_name(df: DataFrame, column: str, strict: str = "norm_name", folded: str | None = None) -> DataFrame:
    """Add the strict (and optionally the accent-folded) form of ``column``."""
    raw = F.col(column)
    ascii_form = F.btrim(F.regexp_replace(F.lower(raw), _ASCII_SEPARATORS, " "))
    out = df.withColumn("__unicode", _unicode_names(F.when(~is_ascii(raw), raw)))
    out = out.withColumn(strict, F.when(is_ascii(raw), ascii_form).otherwise(F.col("__unicode.strict")))
    if folded is not None:
        out = out.withColumn(folded, F.when(is_ascii(raw), F.col(strict)).otherwise(F.col("__unicode.folded")))
    return out.drop("__unicode")


def normalized_token(col: Column) -> Column:
    """Gender, role and semantic tokens: folded text, runs of non-word characters become ``_``."""
    ascii_form = F.btrim(F.regexp_replace(F.lower(col), "[^a-z0-9_]+", "_"), F.lit("_"))
    unicode_form = _unicode_tokens(F.when(~is_ascii(col), col))
    return F.nullif(F.when(is_ascii(col), ascii_form).otherwise(unicode_form), F.lit(""))


def ascii_token(col: Column) -> Column:
    """The same for controlled vocabularies, where only ASCII tokens can match; never enters Python."""
    folded = F.nullif(
        F.btrim(F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}_]+", "_"), F.lit("_")), F.lit("")
    )
    # Most values are tokens already.
    return F.when(col.rlike(r"\A[a-z0-9]+\z"), col).otherwise(folded)


def participant_type(col: Column) -> Column:
    token = ascii_token(col)
    return F.when(token.isin(*_PARTICIPANT_TYPES), token)


def country_code(col: Column) -> Column:
    code = F.upper(strip(col))
    return F.when(code.rlike(r"\A[A-Z]{2}\z"), code)


def season(col: Column) -> Column:
    """``2026/27`` and ``2026–2027`` become ``2026-2027``; other labels only lose odd spacing."""
    dashed = F.regexp_replace(strip(col), r"[/\p{Pd}]", "-")
    tidy = F.regexp_replace(F.regexp_replace(dashed, r"(?U)\s+", " "), r"\s*-\s*", "-")
    short = r"\A(\d{4})-(\d{2})\z"
    first = F.regexp_extract(tidy, short, 1).try_cast("int")
    second = F.floor(first / 100) * 100 + F.regexp_extract(tidy, short, 2).try_cast("int")
    second = F.when(second < first, second + 100).otherwise(second)
    expanded = F.concat_ws("-", F.lpad(first.cast("string"), 4, "0"), F.lpad(second.cast("string"), 4, "0"))
    return F.when(tidy.rlike(short), expanded).otherwise(F.nullif(tidy, F.lit("")))


def provider_token(col: Column) -> Column:
    """Lower case with dashes and blanks as single underscores; blank text is null."""
    return F.nullif(F.btrim(F.regexp_replace(F.lower(strip(col)), "[-_ ]+", "_"), F.lit("_")), F.lit(""))


def alphanumeric_token(col: Column) -> Column:
    return F.regexp_replace(F.lower(blank_to_null(col)), r"[^\p{L}\p{N}]", "")


def id_suffix(col: Column) -> Column:
    """Text after the last colon."""
    return F.substring_index(col, ":", -1)


def numeric_id_suffix(col: Column) -> Column:
    suffix = id_suffix(blank_to_null(col))
    return F.when(suffix.rlike(r"\A[0-9]+\z"), suffix)
