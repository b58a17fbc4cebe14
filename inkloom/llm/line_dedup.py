"""Line dedup by distinct-site spread: sketches first, exact counts near the threshold."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkloom.llm._shared import free, settle

#: Sites from which a line is boilerplate; sketches of 2^LG_K registers are trusted MARGIN away from it.
SITES, LG_K, MARGIN = 5, 12, 0.2


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def spread(spark: SparkSession, docs: DataFrame, site: str = "source", sites: int = SITES) -> DataFrame:
    """line (digest), n_sites, exact and keeper of each line on at least `sites` sites.

    Lines are compared without blanks at their ends; blank lines do not count.
    A null site counts as one site of its own. Lines with fewer rows than sites
    cannot reach the threshold and get no sketch. keeper: the smallest doc_id
    with the line. n_sites is the sketch's estimate unless exact.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(site).cast("string")), F.lit("")).alias("site"), F.explode(_lines(F.col("text"))).alias("line"))
    rows = rows.where(F.trim("line") != "").select("doc_id", "site", _digest(F.trim("line")).alias("line"))
    often = rows.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= sites).select("line")
    rows = settle(spark, rows.join(settle(spark, often, "often"), "line", "left_semi"), "lines")
    sketch = rows.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("n_sites"), F.min("doc_id").alias("keeper"))
    sketch = settle(spark, sketch.where(F.col("n_sites") >= sites * (1 - MARGIN)), "sketches")
    near = F.col("n_sites") < sites * (1 + MARGIN)
    exact = rows.join(sketch.where(near).select("line"), "line", "left_semi").select("line", "site").distinct()
    exact = exact.groupBy("line").agg(F.count("*").alias("n_sites"))
    exact = exact.join(sketch.where(near).select("line", "keeper"), "line").where(F.col("n_sites") >= sites)
    sure = sketch.where(~near).select("line", "n_sites", F.lit(False).alias("exact"), "keeper")
    return sure.unionByName(exact.select("line", "n_sites", F.lit(True).alias("exact"), "keeper"))


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_removed", T.LongType())]))
def _without(text, every, own):
    """Texts without the lines of the digests in every, but for the first of each in own; null texts stay null."""
    import pandas as pd

    out = []
    for t, gone, kept in zip(text, every, own):
        if t is None:
            out.append((None, 0))
            continue
        gone, kept = set(gone), set(kept)
        lines, left = t.split("\n"), []
        for line in lines:
            digest = hashlib.md5(line.strip(" ").encode()).digest()
            if digest in kept:
                kept.discard(digest)
            elif digest in gone:
                continue
            left.append(line)
        out.append(("\n".join(left), len(lines) - len(left)))
    return pd.DataFrame(out, columns=["text", "n_removed"])


def dedup_lines(spark: SparkSession, docs: DataFrame, site: str = "source", sites: int = SITES) -> DataFrame:
    """docs with boilerplate lines removed, plus n_lines and n_removed.

    A line on at least `sites` sites goes from every text but that of its keeper,
    where its first occurrence stays, so nothing is lost altogether. Null texts
    stay null with no lines; texts of boilerplate alone become empty; rows with
    equal doc_id are treated alike; rows without doc_id never keep a line that a
    doc_id has. n_chars, if there is one, follows the text. All rows stay. Other
    columns may have any names; n_lines and n_removed are replaced.
    """
    wide = settle(spark, spread(spark, docs, site, sites).select("line", "keeper"), "spread")
    key, every, own, done = free(docs.columns, "hit_id", "hit_lines", "hit_own", "hit_done")
    # Which documents are hit: a row for each of them and each of their boilerplate lines.
    pairs = docs.select(F.col("doc_id").cast("long").alias(key), F.explode(_lines(F.col("text"))).alias("each"))
    pairs = pairs.where(F.trim("each") != "").select(key, _digest(F.trim("each")).alias("line")).join(wide, "line")
    gone = pairs.groupBy(key).agg(F.collect_set("line").alias(every), F.collect_set(F.when(F.col("keeper").eqNullSafe(F.col(key)), F.col("line"))).alias(own))
    gone = settle(spark, gone, "gone")
    # Always merged: which documents are hit grows with the input, so no size of it is safe to broadcast.
    joined = docs.join(gone.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col(key)), "left")
    hit = F.col(every).isNotNull()
    # Only texts that are hit travel to the workers.
    joined = joined.withColumn(done, _without(F.when(hit, F.col("text")), every, own))
    text = F.when(hit, F.col(done)["text"]).otherwise(F.col("text"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1)
    changes = {"text": text.alias("text")}
    if "n_chars" in docs.columns:
        changes["n_chars"] = F.when(hit, F.length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    removed = F.when(hit, F.col(done)["n_removed"]).otherwise(F.lit(0))
    return joined.select(*[changes.get(c, F.col(f"`{c}`")) for c in names], n_lines.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))
