"""Comma / semicolon delimited files with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from pingtrail.functions.text import clean_names as _clean_names


def read_delimited(spark: SparkSession, path: str, schema: StructType, *, sep: str = ",",
                   trim: bool = True, drop_first: bool = False, clean_names: bool = False,
                   na_values=("NA",), escape_double: bool = True) -> DataFrame:
    """Read a header CSV with a declared schema (no inference).

    A doubled quote inside a quoted cell is one quote (``escape_double=False``:
    two); a backslash is an ordinary character.  Empty cells and ``NA`` become NULL (quoted empty strings too); ``trim``
    strips blanks around string values (also inside quotes); ``drop_first``
    drops the first column by position (a row index); ``clean_names``
    snake-cases the column names.
    """
    reader = (
        spark.read.schema(schema)
        .option("header", "true")
        .option("sep", sep)
        .option("mode", "PERMISSIVE")
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", str(trim).lower())
        .option("ignoreTrailingWhiteSpace", str(trim).lower())
    )
    if na_values:
        reader = reader.option("nullValue", na_values[0])
    df = reader.csv(path)
    fixes = {}
    for field in schema.fields:
        if isinstance(field.dataType, StringType):
            c = F.trim(F.col(field.name)) if trim else F.col(field.name)
            c = c if escape_double else F.replace(c, F.lit('"'), F.lit('""'))
            c = F.when(c.isin(*na_values), None).otherwise(c) if na_values else c
            fixes[field.name] = F.nullif(c, F.lit(""))
    if fixes:
        df = df.withColumns(fixes)
    if drop_first:
        df = df.drop(df.columns[0])
    if clean_names:
        df = _clean_names(df)
    return df
