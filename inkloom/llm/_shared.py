"""Shared-folder tables, byte-level words and connected components."""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.operators.stage import settle, shared_dir, shared_path  # noqa: F401

#: Bytes to blanks except digits, letters (lower-cased) and everything from 0x80.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def byte_words(raw: bytes) -> list[bytes]:
    """Runs of ASCII digits, ASCII letters and non-ASCII characters, A-Z lower-cased."""
    # Only the blank survives as white space, so split() cuts at separators alone.
    return raw.translate(WORD_BYTES).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession, thing: object) -> Callable[[], object]:
    """Send thing to the executors once, by value; the result is called there for it."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(thing))
    cache: list[object] = []

    def get() -> object:
        if not cache:
            cache.append(pickle.loads(held.value))
        return cache[0]

    return get


def give_back() -> None:
    """Return memory that is free in this worker to the machine: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def free(columns: list[str], *names: str) -> list[str]:
    """The names, with marks after those that columns has already (in any case)."""
    held = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def components(spark: SparkSession, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of links as (node, root), root the smallest node.

    Alternates large-star and small-star rounds. Each takes the minimum of a
    node's neighbours by an aggregation that starts before the exchange, and
    joins it back, which Spark splits where a node has very many; no
    neighbourhood is collected. The number of rounds grows with the logarithm
    of the longest chain. Every round is written to the shared folder.
    Nodes without links are absent. Null ends and self links are ignored.
    """
    edges = settle(
        spark,
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct(),
        "links",
    )
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        small = small.where("u <> v").distinct()
        edges = settle(spark, small, "stars")
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
