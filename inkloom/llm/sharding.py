"""Hierarchical weighted hash tree: rows descend region, rack and shard levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkloom.llm._shared import settle

#: Shards of one rack and racks of one region in the standard layout.
RACK, REGION = 5, 4
#: Parts into which each shard is cut while its rows are numbered.
PARTS = 64


def layout(shards: int, weights: dict[int, float] | None = None) -> list[tuple[int, int, int, float]]:
    """(region, rack, shard, weight) of the standard layout, five shards a rack and four racks a region."""
    return [(s // (RACK * REGION), s // RACK, s, float((weights or {}).get(s, 1.0))) for s in range(shards)]


def _level(pairs: list[tuple[int, int, float]]) -> Column:
    """A literal map from parent to its children and their weights; pairs: parent, child, weight."""
    total: dict[int, dict[int, float]] = {}
    for parent, child, weight in pairs:
        below = total.setdefault(parent, {})
        below[child] = below.get(child, 0.0) + weight
    entries = []
    for parent, below in sorted(total.items()):
        kids = [F.struct(F.lit(c).cast("int").alias("node"), F.lit(w).alias("weight")) for c, w in sorted(below.items()) if w > 0]
        if kids:
            entries += [F.lit(parent).cast("int"), F.array(*kids)]
    return F.create_map(*entries)


def _draw(key: Column, level: int, children: Column) -> Column:
    """The child with the smallest exponential draw at its weight; ties go to the smaller node.

    A draw depends on the key and the node alone, so a changed weight moves rows
    only into or out of the subtree it belongs to.
    """

    def race(child: Column) -> Column:
        bits = F.xxhash64(key, F.lit(level), child["node"]).bitwiseAND(F.lit((1 << 53) - 1))
        u = (bits.cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.log(u) / child["weight"]).alias("draw"), child["node"].alias("node"))

    return F.array_min(F.transform(children, race))["node"]


def place(df: DataFrame, key: str, tree: list[tuple[int, int, int, float]], out: str) -> DataFrame:
    """Add the shard of each row, drawn level by level; a null key is a key like any other."""
    levels = [
        [(0, g, w) for g, _, _, w in tree],
        [(g, r, w) for g, r, _, w in tree],
        [(r, s, w) for _, r, s, w in tree],
    ]
    kept = [F.col(f"`{c}`") for c in df.columns]
    node = F.lit(0)
    for i, pairs in enumerate(levels):
        df = df.withColumn(f"__node{i}", _draw(F.col(f"`{key}`"), i, F.element_at(_level(pairs), node)))
        node = F.col(f"__node{i}")
    return df.select(*kept, node.alias(out))


def numbered(spark: SparkSession, df: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps.

    Each group is cut into PARTS by hash; rows are numbered within a part and
    shifted by the counts of the parts before it, so no task holds a group.
    Of rows equal in all of order, any may come first.
    """
    parts = settle(spark, df.withColumn("__part", F.pmod(F.xxhash64(*order, F.lit(1)), F.lit(PARTS)).cast("int")), "slots")
    counts = parts.groupBy(group, "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    # Groups times PARTS rows, whatever the input: small enough for every task.
    starts = F.broadcast(counts.select(group, "__part", F.coalesce(before, F.lit(0)).alias("__start")))
    row = F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order))
    return parts.withColumn("__row", row).join(starts, [group, "__part"]).select(*df.columns, (F.col("__start") + F.col("__row") - 1).cast("long").alias(out))


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row of docs.

    The law is `key`: doc_id and the number of shards alone decide. With the
    standard layout a 41st shard opens a region of its own, so it only takes
    rows into itself. Null text counts as no bytes (size 16, CRC 0); rows with
    a null doc_id share one shard; repeated rows get slots of their own; an
    empty table gives no rows. Other columns of docs play no part.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = place(rows, "doc_id", layout(shards), "shard")
    rows = place(rows, "doc_id", layout(shards + 1), "grown_shard")
    out = numbered(spark, rows, "shard", ["doc_id", "text_crc32", "size"], "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
