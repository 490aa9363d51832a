"""What the queries read: words, host names, JSON records and catalogs derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmark.plans.match import distinct_values
from nearmark.session import dealt
from nearmark.sources.catalog import Catalog, catalog_from_targets
from nearmark.sources.records import records_from

WORD_BREAK = r'[ \t\r\n.,;:!?()"]+'


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table whose rows are long texts."""
    return dealt(table(spark, sf_dir, name).select(*columns))


def word_rows(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """Every word of every text."""
    return texts(spark, sf_dir, name, "text").select(F.explode(F.split("text", WORD_BREAK)).alias("word")).where("word <> ''")


def words(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """``value, n``: the distinct words."""
    return distinct_values(word_rows(spark, sf_dir, name), "word")


def targets(spark: SparkSession, sf_dir: str, ascii_only: bool = False) -> DataFrame:
    """Target strings: the words of the benchmark passages."""
    found = word_rows(spark, sf_dir, "benchmark").select(F.col("word").alias("target")).distinct()
    return found.where(F.octet_length("target") == F.char_length("target")) if ascii_only else found


def catalog(spark: SparkSession, sf_dir: str, *rules: dict, steps: list[dict] | None = None, **which) -> Catalog:
    return catalog_from_targets(targets(spark, sf_dir, **which), "target", list(rules), steps)


def rule(rule_type: str, exit_on_match: bool = False, **values) -> dict:
    return {"rule_type": rule_type, "exit_on_match": exit_on_match, "values": values}


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, host`` of every page."""
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1).alias("host"))


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``domain``: host names made of the distinct words of each language, and the page hosts."""
    made = (
        texts(spark, sf_dir, "documents", "lang", "text").select("lang", F.explode(F.split("text", WORD_BREAK)).alias("word"))
        .where("word <> ''").select(F.concat_ws(".", "word", "lang", F.lit("example.com")).alias("domain"))
    )
    return made.unionByName(hosts(spark, sf_dir).select(F.col("host").alias("domain"))).distinct()


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hosts(spark, sf_dir)
    return records_from(rows, "pages", "page_id", F.concat("host", F.lit(".")).alias("domain_name"))


def word_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per document and word, so that most strings repeat."""
    rows = texts(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", F.posexplode(F.split("text", WORD_BREAK)).alias("at", "word")).where("word <> ''")
    return records_from(rows, "documents", "doc_id", "at", F.col("word").alias("name"))


def mixed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good and bad records: objects with strings and numbers, arrays, bare values, and text that is not JSON."""
    def of(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("input_type"), F.col("value"))

    events = table(spark, sf_dir, "events")
    numbers = events.select(F.col("props").alias("value"))
    strings = events.select(F.to_json(F.struct(F.col("event_type").alias("k"), "event_id")).alias("value"))
    arrays = events.select(F.concat(F.lit("["), "props", F.lit("]")).alias("value"))
    bare = events.select(F.col("user_id").cast("string").alias("value"))
    text = table(spark, sf_dir, "conversations").select(F.concat(F.lit("text "), "text").alias("value"))
    out = of(numbers, "numbers")
    for df, name in ((strings, "strings"), (arrays, "arrays"), (bare, "bare"), (text, "text")):
        out = out.unionByName(of(df, name))
    return out
