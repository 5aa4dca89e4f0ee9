"""Sources and sinks: CSV and JSON with the frame's conventions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Field values that mean null.
NULLS = ("", "null", "NA")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file or folder with a header: fields trimmed, ``""``, null and NA are null, types inferred."""
    if schema:
        return spark.read.csv(path, schema=schema, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, nullValue="NA", escape='"')
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, escape='"', inferSchema=False)
    rows = raw.select(*[F.when(~F.trim(f"`{c}`").isin(*NULLS), F.trim(f"`{c}`")).alias(c) for c in raw.columns])
    kinds = rows.agg(*[F.struct(F.count_if(F.expr(f"try_cast(`{c}` as double)").isNull() & F.col(f"`{c}`").isNotNull()), F.count_if(~F.lower(f"`{c}`").isin("true", "false"))).alias(f"k{i}") for i, c in enumerate(rows.columns)]).first()

    def typed(i: int, c: str):
        number, boolean = kinds[f"k{i}"]
        col = F.col(f"`{c}`")
        return (col.cast("double") if not number else col.cast("boolean") if not boolean else col).alias(c)

    return rows.select(*[typed(i, c) for i, c in enumerate(rows.columns)])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; null is empty, quotes only where needed."""
    df.write.csv(path, header=True, nullValue="", emptyValue="", escape='"')


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of objects in each file, or one object a line."""
    return spark.read.json(path, multiLine=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path, ignoreNullFields=False)


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row; NaN becomes null."""
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("json"))
