"""SimHash near-duplicates by a self-join of binary tries."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkloom.llm._shared import byte_words, components, free, give_back, settle, ship

#: Node pairs that are expanded together, and products of node sizes that are compared outright.
FRONT, LEAF = 1 << 19, 24
#: Distinct fingerprints of one subtree; larger ones are cut again. Smaller ones are walked in bunches.
TRIE_ROWS, BUNCH_ROWS = 40_000, 40_000
SPACE = bytes(32 if b in b"\x20\x09\x0a\x0b\x0c\x0d" else b + 32 if 65 <= b <= 90 else b for b in range(256))


def space_words(raw: bytes) -> list[bytes]:
    """Words between blanks, tabs and line ends, A-Z lower-cased."""
    return [w for w in raw.translate(SPACE).split(b" ") if w]


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Space-joined runs of size words; fewer words make one shingle, none make none."""
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are 1 in over half of the unsigned 64-bit hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


@dataclass(frozen=True)
class Scheme:
    """How texts become fingerprints and which of them link.

    words x 64 bits; each run of width bits is a trie that admits near differing
    bits, and all bits together admit far. size: words of a shingle; plain:
    words are runs of letters and digits rather than all between blanks.
    """

    words: int = 1
    width: int = 64
    near: int = 3
    far: int = 3
    size: int = 3
    plain: bool = False

    def split(self, raw: bytes) -> list[bytes]:
        return byte_words(raw) if self.plain else space_words(raw)

    def fingerprints(self, raw: bytes) -> list[int]:
        parts = shingles(self.split(raw), self.size)
        if self.plain:
            parts = list(dict.fromkeys(parts))
        base = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in parts), np.uint64, len(parts))
        out = [fingerprint(base)]
        for k in range(1, self.words):  # further bits of the same shingles
            x = base + np.uint64((0x9E3779B97F4A7C15 * k) & (2**64 - 1))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out.append(fingerprint(x ^ (x >> np.uint64(31))))
        return out


#: Three-word shingles, 64 bits, at most 3 bits apart.
CONTRACT = Scheme()
#: Five-word shingles; three tries of 64 bits, 4 errors each, and at most 42 of 192 bits apart, before the exact check.
#: Of random pairs one in 2.7e13 is near in a trie of 64 bits, so candidates do not grow with the square of the rows.
STAGE = Scheme(words=3, width=64, near=4, far=42, size=5, plain=True)
SIMILARITY = 0.8


def fingerprinted(docs: DataFrame, scheme: Scheme = CONTRACT) -> DataFrame:
    """doc_id and fp, an array of signed 64-bit words, of each row; null texts count as empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [[_signed(x) for x in scheme.fingerprints(cell.as_py() or b"")] for cell in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.list_(pa.int64()))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(work, "doc_id long, fp array<long>")


# ---------------------------------------------------------------- one trie, in one task


def _distance(bits: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1)


def _grid(frame: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j), i < j, of positions under the given pairs of nodes."""
    lo1, hi1, lo2, hi2 = frame[:4]
    across = hi2 - lo2
    n = (hi1 - lo1) * across
    of = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    i, j = lo1[of] + at // across[of], lo2[of] + at % across[of]
    keep = i < j
    return i[keep], j[keep]


def trie_pairs(codes: np.ndarray, width: int, budget: int, lead: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions of the sorted codes that agree in the lead bits and may differ in budget of the rest.

    Starts from each node at depth lead paired with itself and descends both nodes of a pair at
    once: equal turns keep the count of differing bits, unequal turns add one,
    and pairs over budget are pruned. Pairs of small nodes are given out whole,
    for the caller to compare. The front is cut into bounded pieces, depth first.
    """
    top = codes >> np.uint64(width - lead) if lead else np.zeros(len(codes), np.uint64)
    edges = np.concatenate(([0], np.flatnonzero(top[1:] != top[:-1]) + 1, [len(codes)])).astype(np.int64)
    lo, hi = edges[:-1], edges[1:]
    lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
    stack = [(width - 1 - lead, np.array([lo, hi, lo, hi, np.zeros(len(lo), np.int64)]))]
    while stack:
        bit, frame = stack.pop()
        small = (frame[1] - frame[0]) * (frame[3] - frame[2]) <= LEAF if bit >= 0 else np.ones(frame.shape[1], bool)
        if small.any():
            done = frame[:, small]
            if bit < 0:  # all bits are used: large nodes of equal codes, in pieces
                for k in range(done.shape[1]):
                    for lo in range(done[0, k], done[1, k], 512):
                        part = done[:, k : k + 1].copy()
                        part[0], part[1] = lo, min(lo + 512, done[1, k])
                        yield _grid(part)
            else:
                yield _grid(done)
            frame = frame[:, ~small]
        if not frame.shape[1]:
            continue
        one = np.uint64(1) << np.uint64(bit)
        lo1, hi1, lo2, hi2, off = frame

        def turn(lo: np.ndarray) -> np.ndarray:
            first = (codes[lo] & ~(one | (one - np.uint64(1)))) | one
            return np.searchsorted(codes, first)

        mid1, mid2 = np.clip(turn(lo1), lo1, hi1), np.clip(turn(lo2), lo2, hi2)
        own = lo1 == lo2
        below = np.concatenate(
            [
                [lo1, mid1, lo2, mid2, off],
                [mid1, hi1, mid2, hi2, off],
                [lo1, mid1, mid2, hi2, off + 1],
                np.array([mid1, hi1, lo2, mid2, off + 1])[:, ~own],
            ],
            axis=1,
        )
        below = below[:, (below[1] > below[0]) & (below[3] > below[2]) & (below[4] <= budget)]
        for at in range(0, below.shape[1], FRONT):
            stack.append((bit - 1, below[:, at : at + FRONT]))


def spanning(bits: np.ndarray, codes: np.ndarray, width: int, near: int, far: int, lead: int = 0) -> list[tuple[int, int]]:
    """A spanning forest of the links below each node at depth lead: row numbers, nearest pairs of a front first."""
    order = np.argsort(codes, kind="stable")
    codes, bits = codes[order], bits[order]
    mask = np.uint64((1 << width) - 1)
    root = np.arange(len(codes))
    forest: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = int(root[x])
        return x

    for i, j in trie_pairs(codes, width, near, lead):
        for at in range(0, len(i), 1 << 20):
            a, b = i[at : at + (1 << 20)], j[at : at + (1 << 20)]
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
            close = np.bitwise_count((codes[a] ^ codes[b]) & mask) <= near
            a, b = a[close], b[close]
            d = _distance(bits, a, b)
            keep = np.flatnonzero(d <= far)
            for k in keep[np.argsort(d[keep], kind="stable")].tolist():
                x, y = find(int(a[k])), find(int(b[k]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    forest.append((int(order[a[k]]), int(order[b[k]])))
            if len(keep):
                while (up := root[root]).tolist() != root.tolist():
                    root = up
    return forest


# ---------------------------------------------------------------- tries over the cluster


def _slice(fp: Column, start: int, width: int) -> Column:
    """Bits start .. start + width of fp, bit 0 the highest of its first word; within one or two words."""
    word, off = divmod(start, 64)
    have = min(width, 64 - off)
    one = F.shiftrightunsigned(F.element_at(fp, word + 1), 64 - off - have)
    one = one.bitwiseAND(F.lit((1 << have) - 1)) if have < 64 else one
    if have == width:
        return one
    return F.shiftleft(one, width - have).bitwiseOR(_slice(fp, (word + 1) * 64, width - have))


def _cut(bits: list[int], n: int) -> list[list[int]]:
    """The bits in n runs of about equal size."""
    return [bits[len(bits) * k // n : len(bits) * (k + 1) // n] for k in range(n)]


def _value(fp: Column, bits: list[int]) -> Column:
    """The bits of fp, by their places, as one number; neighbours are taken together."""
    out, at = None, 0
    while at < len(bits):
        end = at + 1
        while end < len(bits) and bits[end] == bits[end - 1] + 1:
            end += 1
        part = _slice(fp, bits[at], end - at)
        out = part if out is None else F.shiftleft(out, end - at).bitwiseOR(part)
        at = end
    return out


#: Times that a subtree is cut; after that few bits are left, and distinct fingerprints are few too.
CUTS = 6


def links(spark: SparkSession, fps: DataFrame, scheme: Scheme) -> DataFrame:
    """Links a, b between row ids of fps (id, fp), enough to connect all that link.

    Of any near + 1 pieces of a table, two fingerprints within the budget agree
    on one. So each piece heads a trie of its own, the subtrees below its values
    are the tasks, and the pair traversal starts there. A subtree with more
    than TRIE_ROWS fingerprints is cut again in the same way over the bits that
    remain, which is exact as well, until it is small.
    """
    places = [list(range(t * scheme.width, (t + 1) * scheme.width)) for t in range(scheme.words * 64 // scheme.width)]
    # Of a task: the table, and the bits that its subtrees agree on, in order.
    tasks = [(t, piece) for t, all_ in enumerate(places) for piece in _cut(all_, scheme.near + 1)]

    added = dict(enumerate(piece for _, piece in tasks))

    def heads(which: list[int], before: Column) -> Column:
        """Task and head of a fingerprint for each of the tasks; before: what it agreed on already."""
        return F.array(*[F.struct(F.lit(k).alias("task"), F.concat_ws(",", before, _value(F.col("fp"), added[k]).cast("string")).alias("head")) for k in which])

    parts = fps.select("id", "fp", F.explode(heads(list(added), F.lit(None).cast("string"))).alias("h")).select("id", "fp", "h.task", "h.head")
    for _ in range(CUTS):
        sizes = parts.groupBy("task", "head").count().where(F.col("count") > TRIE_ROWS).select("task", "head")
        large = settle(spark, sizes, "large")
        hot = [r.task for r in large.select("task").distinct().collect()]  # no more than there are tasks
        hot = [k for k in hot if scheme.width - len(tasks[k][1]) > scheme.near]
        if not hot:
            break
        again = None
        for k in sorted(hot):
            t, used = tasks[k]
            new = []
            for piece in _cut([b for b in places[t] if b not in set(used)], scheme.near + 1):
                added[len(tasks)] = piece
                new.append(len(tasks))
                tasks.append((t, [*used, *piece]))
            below = heads(new, F.col("head"))
            again = F.when(F.col("task") == k, below) if again is None else again.when(F.col("task") == k, below)
        large = large.where(F.col("task").isin(*hot))
        cut = parts.join(large, ["task", "head"], "left_semi").select("id", "fp", F.explode(again).alias("h")).select("id", "fp", "h.task", "h.head")
        parts = settle(spark, parts.join(large, ["task", "head"], "left_anti").select(*cut.columns).unionByName(cut), "subtrees")

    def work(task: int, group: pa.Table) -> pa.Table:
        t, used = tasks[task]
        ids = group.column("id").to_numpy()
        fp = group.column("fp").combine_chunks()
        bits = np.asarray(fp.flatten()).astype(np.int64).view(np.uint64).reshape(len(ids), scheme.words)
        codes = np.zeros(len(ids), np.uint64)
        for b in [*used, *(b for b in places[t] if b not in set(used))]:
            codes = (codes << np.uint64(1)) | ((bits[:, b // 64] >> np.uint64(63 - b % 64)) & np.uint64(1))
        forest = spanning(bits, codes, scheme.width, scheme.near, scheme.far, len(used))
        a, b = (ids[[e[k] for e in forest]] if forest else np.zeros(0, np.int64) for k in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def lone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The subtrees of a partition, whose rows come sorted by subtree; small ones of a task together."""
        held: list[pa.RecordBatch] = []
        key: tuple[int, str] | None = None
        rows = 0

        def flush() -> list[pa.RecordBatch]:
            group = pa.Table.from_batches(held)
            held.clear()
            return work(key[0], group).to_batches() if len(group) > 1 else []

        for batch in batches:
            if not len(batch):
                continue
            task, head = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("task", "head"))
            firsts = [0, *(np.flatnonzero((task[1:] != task[:-1]) | (head[1:] != head[:-1])) + 1).tolist()]
            begin = 0
            for lo in firsts:
                now = (int(task[lo]), head[lo])
                if key is not None and now != key and (now[0] != key[0] or rows + lo - begin >= BUNCH_ROWS):
                    held.append(batch.slice(begin, lo - begin))
                    yield from flush()
                    begin, rows = lo, 0
                key = now
            held.append(batch.slice(begin))
            rows += len(batch) - begin
        if held:
            yield from flush()
        give_back()

    grouped = parts.repartition("task", "head").sortWithinPartitions("task", "head")
    return grouped.mapInArrow(lone, "a long, b long").distinct()


def classes(spark: SparkSession, docs: DataFrame, scheme: Scheme = CONTRACT) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links reach, of each row.

    Equal fingerprints are one node of the trie join, so copies cost a row each
    and no pairs. Texts without words have fingerprint zero and link like any
    other; rows with a null doc_id form components too, and have a null
    component_id only if no doc_id is in them. Repeated rows stay.
    """
    rows = settle(spark, fingerprinted(docs, scheme), "fps")
    # A long that stands for each fingerprint: the smallest doc_id need not be unique, so the hash is the id.
    each = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    each = settle(spark, each.select(F.xxhash64("fp").alias("id") if scheme.words > 1 else F.element_at("fp", 1).alias("id"), "fp", "low"), "nodes")
    roots = components(spark, links(spark, each, scheme))
    merged = each.join(roots, each["id"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "id").alias("root"))
    lows = merged.groupBy("root").agg(F.min("low").alias("component_id"))
    known = merged.join(lows, "root").select("fp", "component_id")
    return rows.join(known, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row; see classes."""
    done = classes(spark, docs, CONTRACT)
    return done.select("doc_id", F.lpad(F.lower(F.hex(F.element_at("fp", 1))), 16, "0").alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- exact similarity


def _shingled(docs: DataFrame, scheme: Scheme) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_hashes(scheme, scheme.split(cell.as_py() or b"")).tobytes() for cell in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "set"])
        give_back()

    return docs.select("id", F.col("text").cast("binary")).mapInArrow(work, "id long, set binary")


@F.pandas_udf(T.DoubleType())
def _jaccard(a, b):
    import pandas as pd

    out = []
    for x, y in zip(a, b):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0)
    return pd.Series(out, dtype="float64")


#: One text in SAMPLE tells which shingles are frequent: those in SEEN of them or more, LATE at most.
SAMPLE, SEEN, LATE = 64, 4, 100_000
#: Texts of a shingle up to which their pairs are counted, and texts of a block of more frequent ones.
PAIRED, BLOCK_TEXTS = 64, 1_000


def _hashes(scheme: Scheme, words: list[bytes]) -> np.ndarray:
    parts = set(shingles(words, scheme.size))
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in parts), np.uint64, len(parts)))


def _mark(words: list[bytes]) -> int:
    return _signed(xxhash.xxh64_intdigest(b" ".join(words), 7))


def prefixes(spark: SparkSession, texts: DataFrame, scheme: Scheme, similarity: float) -> DataFrame:
    """token, id (the mark) and n (distinct shingles) for the first shingles of each text in one order of all shingles.

    Two sets of at least `similarity` share a shingle among the first
    n - ceil(similarity * n) + 1 of each, whatever the order is. Here it is by
    hash, but shingles that are frequent in a sample come last; so the sample
    decides on the cost and not on what is found.
    """

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_hashes(scheme, scheme.split(cell.as_py() or b"")) for cell in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))], names=["token"])

    texts = texts.select(F.col("text").cast("binary").alias("text"))
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).mapInArrow(every, "token long")
    often = sample.groupBy("token").count().where(F.col("count") >= SEEN).orderBy(F.desc("count"), "token").limit(LATE)
    late = ship(spark, np.sort(often.select("token").toPandas()["token"].to_numpy(np.int64).view(np.uint64)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = late()
        for batch in batches:
            heads, marks, sizes = [np.zeros(0, np.uint64)], [], []
            for cell in batch.column(0):
                words = scheme.split(cell.as_py() or b"")
                h = _hashes(scheme, words)
                if len(last):
                    there = last[np.minimum(np.searchsorted(last, h), len(last) - 1)] == h
                    h = np.concatenate([h[~there], h[there]])
                heads.append(h[: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1])
                marks.append(_mark(words))
                sizes.append(len(h))
            times = [len(h) for h in heads[1:]]
            arrays = [np.concatenate(heads).view(np.int64), np.repeat(np.array(marks, np.int64), times), np.repeat(np.array(sizes, np.int64), times)]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["token", "id", "n"])
        give_back()

    return texts.mapInArrow(work, "token long, id long, n long")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct rows, sorted by token and id, whose token several ids have."""
    held = np.zeros((3, 0), np.int64)

    def several(rows: np.ndarray) -> pa.RecordBatch:
        new = np.ones(rows.shape[1], bool)
        new[1:] = np.any(rows[:2, 1:] != rows[:2, :-1], axis=0)
        rows = rows[:, new]
        _, of, n = np.unique(rows[0], return_inverse=True, return_counts=True)
        rows = rows[:, n[of] > 1]
        return pa.RecordBatch.from_arrays([pa.array(r) for r in rows], names=["token", "id", "n"])

    for batch in batches:
        if len(batch):
            held = np.concatenate([held, np.array([c.to_numpy() for c in batch.columns])], axis=1)
            cut = int(np.searchsorted(held[0], held[0, -1]))
            if cut:
                yield several(held[:, :cut])
                held = held[:, cut:]
    yield several(held)


def matching(roots: list[int], sets: list[np.ndarray], similarity: float, sides: list[bool] | None = None) -> list[tuple[int, int]]:
    """Pairs of positions of at least `similarity` that join all roots which such pairs of these sets connect.

    With sides, only pairs of different sides count.
    """
    up = {r: r for r in roots}

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    sizes = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)[np.argsort(codes, kind="stable")]
    ends = np.cumsum(np.bincount(codes))
    starts = ends - np.bincount(codes)
    at = np.concatenate(([0], np.cumsum(sizes)))
    out = []
    for i in range(len(sets) - 1):
        mine = codes[at[i] : at[i + 1]]
        n = ends[mine] - starts[mine]
        where = np.repeat(starts[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(owner[where], minlength=len(sets))
        for j in (np.flatnonzero(both[i + 1 :] / (sizes[i] + sizes[i + 1 :] - both[i + 1 :]) >= similarity) + i + 1).tolist():
            if sides is not None and sides[i] == sides[j]:
                continue
            x, y = find(roots[i]), find(roots[j])
            if x != y:
                up[max(x, y)] = min(x, y)
                out.append((i, j))
    return out


def hopeful(token: int, sizes: np.ndarray, lists: list[np.ndarray], roots: np.ndarray, sides: np.ndarray, similarity: float) -> np.ndarray:
    """Which texts of a cell can have a partner of another root in it, going by their first shingles.

    lists: token, times and often (1 for frequent ones) of the first shingles of
    each text, as columns by rising token. A pair belongs to the cells of its
    smallest frequent token alone. With sides, only pairs of different sides count.
    """
    found = np.zeros(len(lists), bool)
    flat = np.concatenate(lists, axis=1)
    names, codes = np.unique(flat[0], return_inverse=True)
    own = int(np.searchsorted(names, token))
    owner = np.repeat(np.arange(len(lists)), [x.shape[1] for x in lists])[np.argsort(codes, kind="stable")]
    ends = np.cumsum(np.bincount(codes))
    starts = ends - np.bincount(codes)
    at = np.concatenate(([0], np.cumsum([x.shape[1] for x in lists])))
    for i in range(len(lists) - 1):
        mine, times, often = codes[at[i] : at[i + 1]], flat[1, at[i] : at[i + 1]], flat[2, at[i] : at[i + 1]] > 0
        n = ends[mine] - starts[mine]
        who = owner[np.repeat(starts[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        both = np.bincount(who, weights=np.repeat(times, n), minlength=len(lists))
        least = np.full(len(lists), -1)
        shared, named = who[np.repeat(often, n)], np.repeat(mine[often], n[often])
        least[shared[::-1]] = named[::-1]  # the smallest is written last
        more, less = np.maximum(sizes, sizes[i]), np.minimum(sizes, sizes[i])
        need = np.ceil(similarity / (1 + similarity) * (more + less) - 1e-6) - np.ceil(similarity * more + 1e-6) + 1
        fit = (both >= need) & (less >= similarity * more - 1e-6) & (roots != roots[i]) & (least == own)
        if sides.any():
            fit &= sides != sides[i]
        fit[: i + 1] = False
        if fit.any():
            found |= fit
            found[i] = True
    return found


def missing_links(spark: SparkSession, texts: DataFrame, known: DataFrame, sets_of: Callable[[DataFrame], DataFrame], scheme: Scheme, similarity: float) -> DataFrame:
    """Links a, b of at least `similarity` that join components of known (id, root), enough to connect all that have one.

    A prefix filter: exact, whatever the fingerprints are. Shingles whose texts
    are one component already need nothing, and of shingles with the same texts
    one is enough. Shingles of up to PAIRED texts give pairs; where two sets
    share c of their first shingles, they share at most c + ceil(similarity * n)
    - 1 in all, n the larger size. The texts of more frequent ones are compared
    in blocks of BLOCK_TEXTS, each pair of blocks in a task of its own, so no
    task holds a group; first by their first shingles, then, where these leave
    a pair possible, by whole sets. A pair is united only after it was checked.
    """
    first = prefixes(spark, texts, scheme, similarity).repartition("token").sortWithinPartitions("token", "id")
    shared = first.mapInArrow(_shared, "token long, id long, n long").join(known, "id")
    shared = settle(spark, shared.select("token", "id", "n", "root"), "shared")
    groups = shared.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("rows"), F.bit_xor(F.xxhash64("id")).alias("who"), F.min("n").alias("least"), F.max("n").alias("most"))
    groups = groups.where((F.col("low") != F.col("high")) & ((F.col("rows") > 2) | (F.col("least") >= similarity * F.col("most") - 1e-6)))
    groups = groups.groupBy("rows", "who").agg(F.min("token").alias("token"), F.count("*").alias("times")).select("token", "rows", "times")
    crossing = settle(spark, shared.join(groups, "token"), "crossing")
    # Texts that share no frequent shingle: pairs, if they share as many of the first shingles as the similarity needs.
    few = crossing.where(F.col("rows") <= PAIRED)
    one, two = (few.select("token", "times", *[F.col(c).alias(c + k) for c in ("id", "root", "n")]) for k in "12")
    pairs = one.join(two.drop("times"), "token").where((F.col("id1") < F.col("id2")) & (F.col("root1") != F.col("root2")))
    more, less = F.greatest("n1", "n2"), F.least("n1", "n2")
    pairs = pairs.where(less >= similarity * more - 1e-6).groupBy("id1", "id2", "n1", "n2").agg(F.sum("times").alias("both"))
    need = F.ceil(similarity / (1 + similarity) * (more + less) - 1e-6) - F.ceil(similarity * more + 1e-6) + 1
    pairs = settle(spark, pairs.where(F.col("both") >= need).select(F.col("id1").alias("a"), F.col("id2").alias("b")), "pairs")
    entry = F.struct("token", F.col("times").cast("long").alias("times"), (F.col("rows") > PAIRED).cast("long").alias("often"))
    cells = ["token", "low", "high"]
    blocks = F.ceil(F.col("rows") / BLOCK_TEXTS).cast("int")
    rows = crossing.where(F.col("rows") > PAIRED).withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    rows = rows.select("token", "id", "root", "n", "own", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    rows = rows.select("token", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "id", "root", "n", "own")
    # No more than the first shingles of a text.
    lists = crossing.groupBy("id").agg(F.sort_array(F.collect_list(entry)).alias("first"))
    lists = lists.select("id", *[F.col(f"first.{c}").alias(c) for c in ("times", "often")], F.col("first.token").alias("tokens"))
    rows = rows.join(lists, "id").select(*cells, "id", "root", "n", "own", "tokens", "times", "often")

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        cell = None

        def flush() -> pa.RecordBatch:
            token, low, high = cell or (0, 0, 0)
            ids, roots, sizes, own = (np.array([r[k] for r in held], np.int64) for k in range(4))
            found = hopeful(token, sizes, [r[4] for r in held], roots, (own == high) & (low != high), similarity) if len(held) > 1 else np.zeros(len(held), bool)
            held.clear()
            n = int(found.sum())
            out = [np.full(n, token, np.int64), np.full(n, low, np.int32), np.full(n, high, np.int32), ids[found], roots[found], own[found].astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=[*cells, "id", "root", "own"])

        for batch in batches:
            for t, low, high, i, r, n, own, *first in zip(*(c.to_pylist() for c in batch.columns)):
                if (t, low, high) != cell:
                    yield flush()
                    cell = (t, low, high)
                held.append([i, r, n, own, np.array(first, np.int64)])
        yield flush()
        give_back()

    rows = rows.repartition(*cells).sortWithinPartitions(*cells).mapInArrow(narrowed, "token long, low int, high int, id long, root long, own int")
    rows = settle(spark, rows, "hopeful")
    ids = rows.select("id").union(pairs.select("a")).union(pairs.select("b"))
    sets = settle(spark, sets_of(ids.distinct()), "crossing-sets")
    checked = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    checked = checked.where(_jaccard("x", "y") >= similarity).select("a", "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        roots: list[int] = []
        held: list[np.ndarray] = []
        sides: list[bool] = []
        cell = None

        def flush() -> pa.RecordBatch:
            found = matching(roots, held, similarity, sides if any(sides) else None) if len(ids) > 1 else []
            out = [pa.array([ids[e[k]] for e in found], pa.int64()) for k in (0, 1)]
            for x in (ids, roots, held, sides):
                x.clear()
            return pa.RecordBatch.from_arrays(out, names=["a", "b"])

        for batch in batches:
            for t, low, high, i, r, own, x in zip(*(c.to_pylist() for c in batch.columns)):
                if (t, low, high) != cell:
                    yield flush()
                    cell = (t, low, high)
                ids.append(i)
                roots.append(r)
                sides.append(low != high and own == high)
                held.append(np.frombuffer(x, np.uint64))
        yield flush()
        give_back()

    rows = rows.join(sets, "id")
    rows = rows.select(*cells, "id", "root", "own", "set").repartition(*cells).sortWithinPartitions(*cells)
    return rows.mapInArrow(work, "a long, b long").unionByName(checked).distinct()


def representatives(spark: SparkSession, docs: DataFrame, scheme: Scheme = STAGE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each near-duplicate group, that with the smallest doc_id.

    Rows link whose five-word shingle sets have a Jaccard similarity of at least
    `similarity`, checked exactly: those that the tries find, then all that
    still cross the components of these. Rows whose texts have
    the same words link too, and so do all rows without words. A row with a
    null doc_id stays only if its group has no doc_id; of equal doc_ids the one
    with the smallest text stays. All columns of docs stay as they are.
    """
    # 128 bits: rows equal in doc_id and text share a key, others do not.
    key = F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.col("text").isNull().cast("string"), F.col("text"))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, checks, fps = [], [], []
            for cell in batch.column(2):
                raw = cell.as_py() or b""
                words = scheme.split(raw)
                marks.append(_mark(words))
                checks.append(_signed(xxhash.xxh64_intdigest(b" ".join(words), 8)))
                fps.append([_signed(x) for x in scheme.fingerprints(raw)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.int64()), pa.array(checks, pa.int64()), pa.array(fps, pa.list_(pa.int64()))], names=["row", "doc_id", "mark", "check", "fp"])
        give_back()

    rows = docs.select(key.alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    rows = settle(spark, rows.mapInArrow(work, "row binary, doc_id long, mark long, check long, fp array<long>"), "rows")
    # One node for each word sequence, known by its mark; its first row stands for its text.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row"))
    texts = settle(spark, rows.groupBy("mark", "check").agg(first.alias("first"), F.first("fp").alias("fp")), "texts")
    # Of different texts with one mark, a chance of 64 bits, one is the node and the others stay as they are.
    one = F.min(F.struct("check", "first", "fp")).alias("n")
    nodes = settle(spark, texts.groupBy("mark").agg(one).select(F.col("mark").alias("id"), "n.fp", "n.first", "n.check"), "nodes")
    found = settle(spark, links(spark, nodes, scheme), "candidates")
    ends = found.select(F.col("a").alias("id")).union(found.select(F.col("b").alias("id"))).distinct()

    def sets_of(ids: DataFrame) -> DataFrame:
        ends = nodes.join(ids, "id", "left_semi").select("id", F.col("first.row").alias("row"))
        return _shingled(docs.select(key.alias("row"), "text").join(ends, "row").dropDuplicates(["id"]), scheme)

    sets = settle(spark, sets_of(ends), "sets")
    pairs = found.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    pairs = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    links_ = settle(spark, pairs.where(_jaccard("x", "y") >= similarity).select("a", "b"), "links")
    roots = components(spark, links_)
    # The tries miss some links, and their forest passes over pairs whose way round failed the check.
    known = nodes.join(roots, nodes["id"] == roots["node"], "left").select("id", F.coalesce("root", "id").alias("root"))
    more = settle(spark, missing_links(spark, docs, known, sets_of, scheme, similarity), "more")
    if more.limit(1).count():
        roots = components(spark, links_.unionByName(more))
    merged = nodes.join(roots, nodes["id"] == roots["node"], "left").select("first", F.coalesce("root", "id").alias("root"))
    (name,) = free(docs.columns, "near_row")
    keep = merged.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(name))
    if texts.count() != nodes.count():
        spare = texts.join(nodes.select(F.col("id").alias("mark"), F.col("check").alias("own")), "mark").where("check <> own")
        keep = keep.unionByName(spare.select(F.col("first.row").alias(name)))
    kept = docs.withColumn(name, key).join(keep, name, "left_semi")
    # Rows equal in doc_id and text share a key: one of them stays.
    twins = rows.groupBy("row").count().where("count > 1").select(F.col("row").alias(name))
    twins = settle(spark, twins.join(keep, name, "left_semi"), "twins")
    if not twins.limit(1).count():
        return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
    single = kept.join(twins, name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    several = kept.join(twins, name, "left_semi").dropDuplicates([name]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return single.unionByName(several)
