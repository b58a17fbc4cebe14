"""Sources and sinks: whole texts, TSV with a free last field, JSON lines, term tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.functions import terms as T


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """source, text: one row for each file. Captured manual pages and help texts come in this way."""
    read = spark.read.text(path, wholetext=True)
    return read.select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("text"))


def whole_text_stream(spark: SparkSession, path: str) -> DataFrame:
    read = spark.readStream.text(path, wholetext=True)
    return read.select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("text"))


def solid(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents that are not blank."""
    return docs.where(F.regexp_replace(text, r"(?U)\s+", "") != "")


def tsv(spark: SparkSession, path: str, names: list[str], *, comments: bool = False) -> DataFrame:
    """Rows of TAB-separated fields; the last takes all further tabs. Blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if comments:
        lines = lines.where(~F.col("value").startswith("#"))
    parts = F.split("value", "\t", len(names))
    return lines.select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])


def coverage_sample(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, ["file", "line_no", "text"]).withColumn("line_no", F.col("line_no").cast("int"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    rows = tsv(spark, path, ["file", "line_no", "token"], comments=True)
    return rows.withColumn("line_no", F.col("line_no").cast("int"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    rows = tsv(spark, path, ["key", "ratio", "verdict", "excerpt"], comments=True)
    return rows.withColumn("ratio", F.col("ratio").cast("double"))


def chosen(manual: Column, help_text: Column, failure: Column, mode: str = "auto") -> Column:
    """The text of a program: of its help, of its manual, or of the manual and else the help.

    In auto mode the help counts only where the failure says that there is no manual entry.
    """
    if mode == "help":
        return help_text
    if mode == "manual":
        return manual
    absent = F.lower(failure).contains("no manual entry")
    return F.coalesce(manual, F.when(absent, help_text))


DUMP = "corpus string, kind string, source string, output string, translated boolean"


def write_dump(rows: DataFrame, path: str) -> None:
    rows.select("corpus", "kind", "source", "output", "translated").write.json(path)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DUMP).json(path)


def write_texts(docs: DataFrame, path: str, text: str = "text") -> None:
    docs.select(F.col(text).alias("value")).write.text(path)


def term_table(spark: SparkSession, path: str, kind: str) -> list[str] | dict[str, str]:
    """A table of terms (extensions, kept, function_words, glossary, headers) from a text file."""
    read = {"extensions": T.extensions, "kept": T.kept_terms, "function_words": T.function_words, "glossary": T.glossary, "headers": T.headers}[kind]
    return read(spark.read.text(path, wholetext=True).first()[0])
