"""Record sources: JSON lines in, one matched string per record out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmark.functions.paths import compile_path

RECORD_COLUMNS = ["input_type", "value"]


def read_json_lines(spark: SparkSession, path: str, input_type: str = "file") -> DataFrame:
    """Every line of a text file or folder as one record; bad JSON stays in as text."""
    return spark.read.text(path).select(F.lit(input_type).alias("input_type"), "value")


def stream_json_lines(spark: SparkSession, path: str, input_type: str = "file",
                      max_files: int | None = None) -> DataFrame:
    """The same as a stream over a folder that receives files."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).select(F.lit(input_type).alias("input_type"), "value")


def union_inputs(inputs: list[DataFrame]) -> DataFrame:
    """All inputs as one; ``input_type`` says where a record came from, equal inputs count once."""
    kept: list[DataFrame] = []
    for df in inputs:
        # a streaming plan has no semantic comparison worth paying for: same object means same input
        if not any(df is k or (not df.isStreaming and not k.isStreaming and df.sameSemantics(k)) for k in kept):
            kept.append(df)
    return reduce(DataFrame.unionByName, [df.select(*RECORD_COLUMNS) for df in kept])


def parsed(value: Column) -> Column:
    """JSON text as a variant, NULL when it does not parse."""
    return F.try_parse_json(value)


def is_object(variant: Column) -> Column:
    return F.schema_of_variant(variant).startswith("OBJECT<")


def with_field(records: DataFrame, path: str, name: str = "name") -> DataFrame:
    """Add the string at ``path`` of each record; NULL when it is missing or is any other JSON type."""
    path = compile_path(path)
    # merged projections would parse the text again at every mention; what comes out of explode is there already, and the leaf is all of it.
    # a path begins with a name, which only an object has; is_object would work out the schema of the whole text
    found = records.withColumn("leaf_", F.explode(F.array(F.try_variant_get(parsed(F.col("value")), path, "variant"))))
    # the type is checked before the cast, which would also turn numbers and booleans into strings
    text = F.when(F.schema_of_variant("leaf_") == "STRING", F.try_variant_get("leaf_", "$", "string"))
    return found.withColumn(name, text).drop("leaf_")


def usable(records: DataFrame, path: str, name: str = "name") -> DataFrame:
    """Only records that are JSON objects with a string at ``path``."""
    return with_field(records, path, name).where(F.col(name).isNotNull())


def records_from(df: DataFrame, input_type: str, *columns: str | Column) -> DataFrame:
    """Turn table rows into JSON records."""
    return df.select(F.lit(input_type).alias("input_type"), F.to_json(F.struct(*columns)).alias("value"))
