"""Quality classifier: Bradley-Terry scores learned from preference pairs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm._shared import settle

#: Rows of a label that a task holds (more rows make more tasks), and pairs drawn for each row of the commoner label.
CHUNK_ROWS, PAIRS = 20_000, 8
#: Bits of a score that one pass over the rows settles when the threshold is sought.
BITS = 12
#: Held-out folds: rows with this remainder of crc32(doc_id) are never learned from.
FOLDS, HELD = 5, 0
#: Scores from here on are predicted 1.
CUT = 0.3

_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_MARKS = np.array([33 <= b < 127 and not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122) for b in range(256)])
_PROSE = np.isin(np.arange(256), list(b".,;:'\"-()"))
FEATURES = 14


def features(raw: bytes) -> np.ndarray:
    """Shape of a text: shares of its bytes, words and lines; all 0 for an empty one."""
    out = np.zeros(FEATURES)
    if not raw:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, words, lines = len(raw), raw.split(), raw.split(b"\n")
    letters, marks = counts[_LETTER].sum(), counts[_MARKS].sum()
    odd = marks - counts[_PROSE].sum()
    w = max(1, len(words))
    out[0] = 1.0
    out[1] = math.log1p(n) / 10
    out[2] = letters / n
    out[3] = counts[_UPPER].sum() / max(1, letters)
    out[4] = counts[_DIGIT].sum() / n
    out[5] = min(1.0, 4 * odd / n)
    out[6] = min(1.0, counts[_PROSE].sum() / w)
    out[7] = min(1.0, counts[124] / w)
    out[8] = min(1.0, counts[33] / w)
    out[9] = min(2.0, n / w / 8)
    out[10] = len(set(words)) / w
    out[11] = len(set(lines)) / len(lines)
    out[12] = min(1.0, sum(not chr(x[-1]).isalnum() and x[-1] < 128 for x in words) / w)
    out[13] = min(2.0, n / len(lines) / 400)
    return out


def pairs(good: np.ndarray, bad: np.ndarray, seed: int) -> np.ndarray:
    """Differences x_i - x_j of drawn pairs of a good and a bad row; every row is in some."""
    if not len(good) or not len(bad):
        return np.zeros((0, FEATURES))
    rng = np.random.default_rng(seed)
    n = PAIRS * max(len(good), len(bad))
    return good[np.resize(rng.permutation(len(good)), n)] - bad[rng.permutation(np.resize(np.arange(len(bad)), n))]


#: A chunk: its number, its rows of label 1 and of label 0, and those of both that count here (chunks share rows of the rarer label).
Chunk = tuple[int, np.ndarray, np.ndarray, tuple[bool, bool]]
#: Runs a function on every chunk; results in the order of the chunks.
Each = Callable[[Callable[[Chunk], np.ndarray]], list[np.ndarray]]


def counted(chunk: Chunk) -> np.ndarray:
    """The rows that count in a chunk, so that each row counts once in all."""
    _, good, bad, counts = chunk
    return np.concatenate([x for x, here in zip((good, bad), counts) if here])


def moments(chunk: Chunk) -> np.ndarray:
    x = counted(chunk)
    return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])


def ascending(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the floats."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


class Model:
    """Standardised features, Bradley-Terry weights and a threshold at a score quantile, all from every row of all chunks."""

    def __init__(self, each: Each, n_bad: int):
        total = sum(each(moments), np.zeros(1 + 2 * FEATURES))
        n = int(total[0])
        self.mean = total[1 : 1 + FEATURES] / max(1, n)
        self.scale = np.sqrt(np.maximum(0, total[1 + FEATURES :] / max(1, n) - self.mean**2)) + 1e-6
        self.w, self.at = np.zeros(FEATURES), 1.0 if n and n_bad == n else -1.0
        if 0 < n_bad < n:
            self.w = self._weights(each)
            self.at = self._threshold(each, n_bad)

    def _weights(self, each: Each, seed: int = 7, decay: float = 1e-3) -> np.ndarray:
        """The w that maximises the likelihood of P(i beats j) = sigmoid(w (x_i - x_j)) over the pairs of good i and bad j."""
        w, scale = np.zeros(FEATURES), self.scale
        for _ in range(30):  # Newton's steps

            def slope(chunk: Chunk) -> np.ndarray:
                d = pairs(chunk[1], chunk[2], seed + chunk[0]) / scale
                p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # probability of the upset
                return np.concatenate([[len(d)], d.T @ p, ((d * (p * (1 - p))[:, None]).T @ d).ravel()])

            total = sum(each(slope), np.zeros(1 + FEATURES + FEATURES**2))
            n, up, curve = max(1.0, total[0]), total[1 : 1 + FEATURES], total[1 + FEATURES :].reshape(FEATURES, FEATURES)
            step = np.linalg.solve(curve / n + decay * np.eye(FEATURES), up / n - decay * w)
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
        return w

    def _threshold(self, each: Each, n_bad: int) -> float:
        """Midway between the scores of rank n_bad - 1 and n_bad: as many rows lie below as have label 0.

        The first is settled by its leading bits, BITS more with each pass, so no scores are gathered.
        """
        rank, head, known = n_bad - 1, 0, 0
        while known < 64:
            more = min(BITS, 64 - known)

            def bins(chunk: Chunk) -> np.ndarray:
                u = ascending(self.raw(counted(chunk)))
                if known:
                    u = u[u >> np.uint64(64 - known) == np.uint64(head)]
                return np.bincount((u >> np.uint64(64 - known - more)).astype(np.int64) & ((1 << more) - 1), minlength=1 << more)

            ends = np.cumsum(sum(each(bins), np.zeros(1 << more, np.int64)))
            at = int(np.searchsorted(ends, rank, side="right"))
            rank -= int(ends[at - 1]) if at else 0
            head, known = (head << more) | at, known + more
            same = int(ends[at] - (ends[at - 1] if at else 0))
        bits = np.uint64(head)
        low = float((bits & ~np.uint64(1 << 63) if bits >> np.uint64(63) else ~bits).reshape(1).view(np.float64)[0])
        if rank + 1 < same:
            return low

        def above(chunk: Chunk) -> np.ndarray:
            s = self.raw(counted(chunk))
            return np.append(s[ascending(s) > bits], np.inf).min(keepdims=True)

        return (low + float(min(x[0] for x in each(above)))) / 2

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, rising with the Bradley-Terry score, CUT at the threshold."""
        z = np.clip(self.raw(x) - self.at, -30, 30) + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-z))


def held_out(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD


def fit(docs: DataFrame, labels: DataFrame, rows: int = CHUNK_ROWS) -> Model:
    """A model of labels.quality, from every labelled row outside the held-out fold.

    rows: of a label, about so many are held by a task; more rows make more
    tasks. Of several texts of a doc_id the one with the smallest features
    counts. Null labels, labels other than 0 and 1 and null doc_ids are
    left out; without rows of both labels all scores are alike, and above CUT unless
    all labels are 0.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("y"))
    known = known.where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id"))).groupBy("id").agg(F.min("y").alias("y"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    texts = texts.where(F.col("id").isNotNull() & ~held_out(F.col("id")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(cell.as_py() or b"").tolist() for cell in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["id", "x"])

    # Features are a small part of a text: the exchange for the join carries them alone.
    shapes = texts.mapInArrow(work, "id long, x array<double>").groupBy("id").agg(F.min("x").alias("x"))
    learned = settle(spark, shapes.join(known, "id").select("id", "y", "x"), "labelled")
    n = {r.y: r["count"] for r in learned.groupBy("y").count().collect()}
    rare = int(n.get(1, 0) < n.get(0, 0))
    shared = max(1, math.ceil(n.get(rare, 0) / rows))
    count = max(shared, math.ceil(n.get(1 - rare, 0) / rows))
    # A chunk of the rarer label goes to each chunk of the commoner one with its number, modulo their number.
    lot = F.xxhash64("id")
    own = F.pmod(lot, F.lit(shared)).cast("int")
    where = F.when(F.col("y") == rare, F.sequence(own, F.lit(count - 1), F.lit(shared))).otherwise(F.array(F.pmod(lot, F.lit(count)).cast("int")))
    dealt = learned.select(F.explode(where).alias("chunk"), "id", "y", "x")

    def pack(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("id").to_numpy())
        y = group.column("y").to_numpy()[order]
        x = np.asarray(group.column("x").combine_chunks().flatten()).reshape(-1, FEATURES)[order]
        k = group.column("chunk")[0].as_py()
        return pa.table({"chunk": pa.array([k], pa.int32()), "good": [x[y == 1].tobytes()], "bad": [x[y == 0].tobytes()]})

    packed = settle(spark, dealt.groupBy("chunk").applyInArrow(pack, "chunk int, good binary, bad binary"), "chunks")

    def chunk_of(k: int, good: bytes, bad: bytes) -> Chunk:
        x1, x0 = (np.frombuffer(b).reshape(-1, FEATURES) for b in (good, bad))
        return k, x1, x0, (k < shared or rare == 0, k < shared or rare == 1)

    if count == 1:
        held = [chunk_of(r.chunk, bytes(r.good), bytes(r.bad)) for r in packed.collect()]
        return Model(lambda f: [f(c) for c in held], n.get(0, 0))

    def each(f: Callable[[Chunk], np.ndarray]) -> list[np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, good, bad in zip(*(c.to_pylist() for c in batch.columns)):
                    out = np.asarray(f(chunk_of(k, good, bad)))
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([out.tobytes()]), pa.array([out.dtype.str])], names=["chunk", "out", "kind"])

        return [np.frombuffer(bytes(r.out), r.kind) for r in sorted(packed.mapInArrow(run, "chunk int, out binary, kind string").collect(), key=lambda r: r.chunk)]

    return Model(each, n.get(0, 0))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score and predicted added; null texts count as empty. All rows and columns stay."""

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        return pd.Series(model.score(np.array([features(bytes(t or b"")) for t in texts]).reshape(-1, FEATURES)))

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    out = docs.select(*kept, scored(F.col("text").cast("binary")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs; repeated rows each get a row."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    done = score(rows, fit(rows, labels))
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def accept(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are predicted 1, with their columns as they are."""
    kept = score(docs, fit(docs, labels))
    return kept.where("predicted = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
