"""Benchmark decontamination with a generalised suffix automaton over words."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm._shared import WORD_BYTES, byte_words, free, settle, ship

#: Words of a window, and test words that one automaton holds; more items make more automata and passes.
WINDOW, BLOCK_WORDS = 10, 200_000
#: A document is dropped when more than this share of its words is hit.
COVERAGE = 0.8


class Automaton:
    """All suffixes of all items of a block, as one automaton over word ids."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        texts: dict[tuple[int, ...], list[str]] = {}
        for name, words in items:
            if words:
                texts.setdefault(tuple(self.ids.setdefault(w, len(self.ids)) for w in words), []).append(name)
        for text in texts:
            last = 0
            for c in text:
                last = self._extend(last, c)
        #: Of a state: items whose window of full size it stands for; (length, items) of whole short items.
        self.full: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, list[str]]]] = {}
        self.least = min([window, *map(len, texts)], default=window)
        for text, names in texts.items():
            state = 0
            for i, c in enumerate(text):
                state = self.next[state][c]
                if i + 1 >= window:
                    self.full.setdefault(self._holder(state, window), set()).update(names)
            if len(text) < window:
                self.short.setdefault(self._holder(state, len(text)), []).append((len(text), names))
        # The nearest state up the suffix links, itself included, that has short items.
        self.up = [-1] * len(self.next)
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.up[v] = v if v in self.short else self.up[self.link[v]]

    def _holder(self, state: int, size: int) -> int:
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _new(self, length: int, like: int | None = None) -> int:
        self.next.append({} if like is None else dict(self.next[like]))
        self.link.append(-1 if like is None else self.link[like])
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state that c leads to from p, cut so that its longest string is p's and c."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._new(self.length[p] + 1, q)
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new, p = self._new(self.length[last] + 1), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, c)
        return new

    def scan(self, words: list[bytes], hit: np.ndarray) -> set[str]:
        """Mark hit words, and return the items with windows that occur."""
        get, found = self.ids.get, set()
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([0], ids >= 0, [0])).astype(np.int8)))
        for a, b in zip(known[::2].tolist(), known[1::2].tolist()):
            if b - a >= self.least:
                self._run(ids[a:b].tolist(), a, hit, found)
        return found

    def _run(self, ids: list[int], start: int, hit: np.ndarray, found: set[str]) -> None:
        nxt, link, length, window = self.next, self.link, self.length, self.window
        state = size = 0
        for i, c in enumerate(ids, start + 1):
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            if c not in nxt[state]:
                continue
            state, size = nxt[state][c], size + 1
            if size >= window:
                found |= self.full[self._holder(state, window)]
                hit[i - window : i] = True
            v = self.up[state]
            while v > 0:
                for k, names in self.short[v]:
                    if k <= size:
                        found.update(names)
                        hit[i - k : i] = True
                v = self.up[link[v]]


def _blocks(items: DataFrame, window: int) -> Iterator[Automaton]:
    """Automata over blocks of items; the driver holds one block at a time."""
    block, held = [], 0
    for name, raw in items.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).toLocalIterator():
        words = byte_words(bytes(raw or b""))
        if block and held + len(words) > BLOCK_WORDS:
            yield Automaton(block, window)
            block, held = [], 0
        if words:
            block.append((name, words))
            held += len(words)
    if block:
        yield Automaton(block, window)


def _cut(raw: bytes, hit: np.ndarray) -> tuple[bytes, list[list[int]]]:
    """The text without the runs of hit words, and those runs in bytes."""
    ends = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(WORD_BYTES))]
    spans = [[ends[a][0], ends[b - 1][1]] for a, b in _runs(hit)]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]]), spans


def _runs(hit: np.ndarray) -> list[list[int]]:
    """[start, end) of the runs of hit words."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit, [0])).astype(np.int8))).tolist()
    return [list(e) for e in zip(edges[::2], edges[1::2])]


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def found_in(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int) -> tuple[Automaton | None, DataFrame | None]:
    """The one automaton of few items, or a table of hits of many: text (digest), runs (words) and items.

    The table comes from a pass over the texts for each block, so that neither
    the driver nor a worker holds more than a block, however many items there are.
    """
    first, hits = None, None
    for block in _blocks(items, window):
        if first is None:
            first = block
            continue
        for b in [block] if hits is not None else [first, block]:
            more = settle(spark, _pass(spark, docs, b), "hits")
            hits = more if hits is None else hits.unionByName(more)
    if hits is None:
        return first, None
    # A text's hits by one block are few words' numbers; of all blocks, a text's words at most.
    whole = hits.groupBy("text").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return None, settle(spark, whole, "hits")


def _pass(spark: SparkSession, docs: DataFrame, block: Automaton) -> DataFrame:
    held = ship(spark, block)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("text", pa.binary()), ("runs", pa.list_(pa.list_(pa.int32()))), ("items", pa.list_(pa.string()))])
        for batch in batches:
            out = []
            for cell in batch.column(0):
                raw = cell.as_py()
                words = byte_words(raw or b"")
                hit = np.zeros(len(words), bool)
                found = held().scan(words, hit)
                if hit.any():
                    out.append({"text": hashlib.sha256(raw).digest(), "runs": _runs(hit), "items": sorted(x for x in found if x is not None)})
            yield pa.RecordBatch.from_pylist(out, schema)

    fields = "text binary, runs array<array<int>>, items array<string>"
    return docs.select(F.col("text").cast("binary")).mapInArrow(work, fields).dropDuplicates(["text"])


_CHECKED = "n_words long, n_hit long, n_items long, items_sha256 string, kept string, spans array<array<int>>"


def checked(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int, out: str) -> DataFrame:
    """docs with a column out: a struct of what is hit in the text, and of the text without it.

    n_words, n_hit, n_items, items_sha256, kept (the text without the hit spans,
    null if there are none) and spans, their [start, end) in bytes. Each text is scanned once for each
    block of items.
    """
    block, hits = found_in(spark, docs, items, window)
    held = ship(spark, block)
    runs, names, key = free([*docs.columns, out], "hit_runs", "hit_items", "hit_key")
    if hits is None:
        none = [F.lit(None).cast("array<array<int>>").alias(runs), F.lit(None).cast("array<string>").alias(names)]
        joined = docs.select("*", *none)
    else:
        # Which texts are hit grows with the input: always merged.
        found = hits.select(F.col("text").alias(key), F.col("runs").alias(runs), F.col("items").alias(names))
        joined = docs.join(found.hint("merge"), _digest(F.col("text")) == F.col(key), "left").drop(key)

    @F.pandas_udf(_CHECKED)
    def check(texts, runs_, items_):
        import pandas as pd

        rows = []
        for text, known, listed in zip(texts, runs_, items_):
            raw = None if text is None else bytes(text)
            words = byte_words(raw or b"")
            hit, found = np.zeros(len(words), bool), set()
            if held() is not None:
                found = held().scan(words, hit)
            for a, b in () if known is None else known:
                hit[a:b] = True
            found = sorted(x for x in found | set(() if listed is None else listed) if x is not None)
            n = int(hit.sum())
            kept, spans = _cut(raw, hit) if n else (b"", [])
            digest = hashlib.sha256(",".join(found).encode()).hexdigest()
            rows.append((len(words), n, len(found), digest, kept.decode() if n else None, spans))
        return pd.DataFrame(rows, columns=["n_words", "n_hit", "n_items", "items_sha256", "kept", "spans"])

    # Called nondeterministic, since Spark would scan each text again for a filter on the result.
    seen = check.asNondeterministic()(F.col("text").cast("binary"), runs, names)
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], seen.alias(out))


def scan(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW, *, cleaned: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    With cleaned, also text without the hit spans and spans, their [start, end)
    in bytes. Null texts and texts without words have no words and no hits; null
    items and items without words are no items; words in windows of an item
    without id are hit, but it is not listed or counted; equal items all count,
    items that share an id once; repeated rows each get a row; empty tables give
    no rows or no hits. Only doc_id, text and item_id are read, whatever other
    columns there are.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    done = checked(spark, rows, items, window, "seen")
    text = F.when(F.col("seen.n_hit") > 0, F.col("seen.kept")).otherwise(F.col("text"))
    more = [text.alias("text"), F.col("seen.spans").alias("spans")] if cleaned else []
    return done.select("doc_id", "seen.n_words", "seen.n_hit", "seen.n_items", "seen.items_sha256", (F.col("seen.n_hit") > 0).alias("contaminated"), *more)


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """docs without the spans of window or more words shared with an item, and without
    the rows of which more than the share coverage is hit. Clean rows stay as they are;
    all columns of docs stay, n_chars following the text if there is one.
    """
    if not {"doc_id", "text"} <= set(docs.columns):
        raise ValueError("docs needs doc_id and text")
    (name,) = free(docs.columns, "seen")
    done = checked(spark, docs, items, window, name)
    seen = F.col(name)
    done = done.where((seen["n_hit"] == 0) | (seen["n_hit"] <= coverage * seen["n_words"]))
    text = F.when(seen["n_hit"] > 0, seen["kept"]).otherwise(F.col("text"))
    changes = {"text": text}
    if "n_chars" in docs.columns:
        changes["n_chars"] = F.when(seen["n_hit"] > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return done.select(*[changes.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
