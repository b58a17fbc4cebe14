"""Systematic samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkloom.operators.stage import settle

SYNTAX_CHARACTER = r"[-/$<>=~|`]"


def numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with __at, their place in their group from 0, and __n, the group's size.

    Rows are dealt by ranges of group and order, so a large group lies in many
    parts; each part is numbered by itself and shifted by the parts before it.
    """
    spark, names = rows.sparkSession, rows.columns
    dealt = rows.repartitionByRange(*[F.col(f"`{c}`") for c in (*by, *order)]).withColumn("__part", F.spark_partition_id())
    # Written, since where a row lies must not change between the two uses.
    dealt = settle(spark, dealt, "ranges")
    sizes = dealt.groupBy(*by, "__part").agg(F.count("*").alias("__k"))
    every = Window.partitionBy(*by)
    upto = F.sum("__k").over(every.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*by, "__part", F.coalesce(upto, F.lit(0)).alias("__before"), F.sum("__k").over(every).alias("__n"))
    own = F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order)) - 1
    left, right = dealt.withColumn("__own", own).alias("l"), sizes.alias("r")
    same = F.col("l.__part") == F.col("r.__part")
    for c in by:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    out = left.join(right, same)
    return out.select(*[F.col(f"l.{c}").alias(c) for c in names], (F.col("l.__own") + F.col("r.__before")).alias("__at"), F.col("r.__n").alias("__n"))


def spread(rows: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """The k evenly spaced rows of each group: places int(i * n / k), all rows if there are no more than k."""
    out = numbered(rows, by, order)
    # A place p is taken if some i has int(i * n / k) = p: the least i that reaches p.
    i = F.ceil(F.col("__at") * k / F.col("__n")).cast("long")
    taken = (F.col("__n") <= k) | ((i < k) & (F.floor(i * (F.col("__n") / k)) == F.col("__at")))
    return out.where(taken).drop("__at", "__n")


def coverage_sample(lines: DataFrame, syntax: int = 8, prose: int = 2) -> DataFrame:
    """file, line_no, text: lines with syntax characters and longer plain lines of each file, evenly spaced."""
    text = F.regexp_replace("text", r"(?U)\s+$", "")
    solid = F.regexp_replace(text, r"(?U)^\s+", "")
    rows = lines.withColumn("text", text).withColumn("size", F.length(solid)).where("size >= 8").withColumn("syntax", solid.rlike(SYNTAX_CHARACTER))
    a = spread(rows.where("syntax"), ["file"], ["line_no"], syntax)
    b = spread(rows.where("not syntax and size >= 30"), ["file"], ["line_no"], prose)
    return a.unionByName(b).select("file", "line_no", "text")


def every_nth(rows: DataFrame, order: list[str], wanted: int = 30, by: list[str] | None = None) -> DataFrame:
    """Rows at multiples of max(1, n // wanted) of each group, `wanted` of them at most."""
    out = numbered(rows, by or [], order)
    stride = F.greatest(F.floor(F.col("__n") / wanted), F.lit(1))
    return out.where((F.col("__at") % stride == 0) & (F.col("__at") < stride * wanted)).drop("__at", "__n")


def side_by_side(rows: DataFrame, wanted: int = 30) -> DataFrame:
    """value: a Markdown section for each of some evenly spaced rows (doc, seg_no, text, outcome), source beside output."""
    chosen = every_nth(rows.where("outcome is not null").select("doc", "seg_no", "text", "outcome"), ["doc", "seg_no"], wanted)
    quoted = lambda c: F.concat(F.lit("> "), F.replace(c, F.lit("\n"), F.lit("\n> ")))
    state = F.when(F.col("outcome.translated"), "translated").otherwise("kept")
    why = F.when(F.col("outcome.reason").isNotNull(), F.concat(F.lit(" ("), F.col("outcome.reason"), F.lit(")"))).otherwise("")
    head = F.concat(F.lit("## "), F.col("doc").cast("string"), F.lit(" / "), F.col("seg_no").cast("string"), F.lit(": "), state, why)
    return chosen.orderBy("doc", "seg_no").select(F.concat_ws("\n\n", head, quoted(F.col("text")), quoted(F.col("outcome.text"))).alias("value"))


def write_side_by_side(rows: DataFrame, path: str, wanted: int = 30) -> None:
    """The sections as one Markdown file below path: `wanted` of them at most, so one task holds them."""
    side_by_side(rows, wanted).coalesce(1).write.option("lineSep", "\n\n").text(path)
