"""Dynamic JSON settings to long rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark.functions.text import number_text

NUMBERS = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def _scalar(value: Column, kind: Column) -> Column:
    """Text of a scalar; NULL for null, lists and objects."""
    return F.when(kind.isin("STRING", "BOOLEAN"), F.try_variant_get(value, "$", "string")).when(
        kind.rlike(NUMBERS), number_text(F.try_variant_get(value, "$", "double"))
    )


def ingest_settings(df: DataFrame, json_column: str) -> DataFrame:
    """One row per member of a JSON object.

    Scalars become text and lists become lists of scalar texts.  Nulls, nested
    objects and lists without a scalar give no row, nor does a text that is no
    JSON; ``malformed_settings`` returns those.
    """
    keys = [c for c in df.columns if c != json_column]
    members = df.select(*keys, F.try_parse_json(json_column).alias("_object")).lateralJoin(
        df.sparkSession.tvf.variant_explode(F.col("_object").outer())
    )
    kind = F.col("_kind")
    items = F.when(kind.startswith("ARRAY"), F.try_variant_get("value", "$", "array<variant>"))
    # A JSON value is costly to look into, so its kind is found once.
    typed = F.transform(items, lambda item: F.struct(item.alias("value"), F.schema_of_variant(item).alias("kind")))
    texts = F.transform(typed, lambda item: _scalar(item["value"], item["kind"]))
    rows = members.withColumn("_kind", F.schema_of_variant("value")).select(
        *keys,
        F.col("key").alias("path"),
        _scalar(F.col("value"), kind).alias("scalar"),
        F.filter(texts, lambda item: item.isNotNull()).alias("vector"),
    )
    return rows.filter(F.col("scalar").isNotNull() | (F.coalesce(F.size("vector"), F.lit(0)) > 0)).select(
        *keys, "path", F.col("scalar").isNotNull().alias("is_scalar"), "scalar", "vector"
    )


def malformed_settings(df: DataFrame, json_column: str) -> DataFrame:
    """The rows whose text is no JSON."""
    return df.filter(F.col(json_column).isNotNull() & F.try_parse_json(json_column).isNull())
