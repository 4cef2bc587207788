"""Title and token functions, Column to Column."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# White space of the page texts, title noise, filler words.
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"
NOISE = "pack of|pcs|pc|pack|combo|free|offer|new|hot|deal"
GENERIC = (
    "new hot deal offer free best original genuine authentic mini portable usb rechargeable wireless electric smart multi color colour pack combo pcs pc of "
    "and with high quality big large small digital led home kitchen use shop for the a in bd series model official"
).split()


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse(s: Column | str) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(_c(s), SPACE, " "))


def normalize_title(s: Column | str) -> Column:
    """Lower case, letters and digits only (combining marks go), without noise words."""
    t = F.regexp_replace(F.lower(_c(s)), r"[^\p{L}\p{N}\s]", " ")
    return collapse(F.regexp_replace(t, f"(?<![A-Za-z0-9_])(?:{NOISE})(?![A-Za-z0-9_])", " "))


def content_tokens(norm: Column | str) -> Column:
    """Distinct words of two characters or more, without filler."""
    return F.array_except(F.filter(F.split(_c(norm), " "), lambda w: F.length(w) >= 2), F.array(*map(F.lit, GENERIC)))


def model_tokens(tokens: Column | str) -> Column:
    """C4: letter-digit mixes and long numbers."""
    mixed = lambda t: (F.length(t) >= 3) & t.rlike("[a-z]") & t.rlike("[0-9]") & t.rlike("^[a-z0-9]+$")
    return F.filter(_c(tokens), lambda t: mixed(t) | t.rlike("^[0-9]{4,}$"))


def tokenize(s: Column | str) -> Column:
    """Words, camel case split, Bangla letters kept."""
    t = F.lower(F.regexp_replace(_c(s), "([a-z])([A-Z])", "$1 $2"))
    return F.filter(F.split(t, "[^a-z0-9ঀ-৿]+"), lambda w: w != "")


@F.pandas_udf(StringType())
def nfkd(s: pd.Series) -> pd.Series:
    """Compatibility decomposition, which Spark has no function for."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))


def fingerprint_title(s: Column | str, decomposed: bool = False) -> Column:
    """Decomposed, without Latin accents, ASCII words and Bangla only."""
    t = F.lower(_c(s)) if decomposed else nfkd(F.lower(_c(s)))
    return collapse(F.regexp_replace(F.regexp_replace(t, r"[\u0300-\u036f]", ""), "[^a-z0-9ঀ-৿ ]+", " "))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """shared share of two token sets; 0 if both are empty."""
    n = F.size(F.array_union(_c(a), _c(b)))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(_c(a), _c(b))) / n)


def bigrams(s: Column) -> Column:
    """Character pairs of a text without white space, with repeats."""
    t = F.regexp_replace(s, r"\s+", "")
    n = F.length(t)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2))))


def dice(a: Column | str, b: Column | str) -> Column:
    """F8: Sørensen-Dice over the multisets of bigrams; equal texts 1, texts of one character 0."""
    x, y = bigrams(_c(a)), bigrams(_c(b))
    common = F.aggregate(F.array_distinct(x), F.lit(0), lambda n, g: n + F.least(F.size(F.filter(x, lambda v: v == g)), F.size(F.filter(y, lambda v: v == g))))
    return F.when(F.regexp_replace(_c(a), r"\s+", "") == F.regexp_replace(_c(b), r"\s+", ""), F.lit(1.0)).when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(2.0 * common / (F.size(x) + F.size(y)))
