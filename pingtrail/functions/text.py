"""Text helpers: name cleaning (driver-side, on column names only) and
number/identifier extraction expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_name(name: str) -> str:
    """snake_case one column name: ASCII-fold, split camelCase, non-alphanumerics
    to single underscores, lower case; empty or digit-leading names get "x"."""
    s = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    s = s.replace("%", "_percent_").replace("#", "_number_")
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", s)
    s = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", s)
    s = re.sub(r"[^A-Za-z0-9]+", "_", s).strip("_").lower()
    if not s:
        s = "x"
    if s[0].isdigit():
        s = "x" + s
    return s


def clean_names(df: DataFrame) -> DataFrame:
    """Rename every column with :func:`clean_name`; repeated names get ``_2``, ``_3`` ..."""
    seen: dict[str, int] = {}
    out = []
    for c in df.columns:
        base = clean_name(c)
        k = seen.get(base, 0) + 1
        seen[base] = k
        out.append(base if k == 1 else f"{base}_{k}")
    return df.toDF(*out)


def trailing_digits(col, min_len: int = 4, max_len: int = 5) -> Column:
    """The 4-5 digits at the end of a string, NULL when there are none."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_substr(c, F.lit(f"[0-9]{{{min_len},{max_len}}}$"))


def parse_number(col) -> Column:
    """First number inside a text ("150 metros" -> 150.0, "1,250 m" -> 1250.0); NULL if none."""
    c = F.col(col) if isinstance(col, str) else col
    token = F.regexp_substr(c, F.lit(r"-?(?:[0-9][0-9,]*(?:[.][0-9]*)?|[.][0-9]+)"))
    return F.regexp_replace(token, ",", "").try_cast("double")
