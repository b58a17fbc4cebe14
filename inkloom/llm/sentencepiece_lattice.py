"""SentencePiece encoding and decoding as a relational lattice."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkloom.llm._shared import give_back, settle, shared_path

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Classes of characters by which a text is cut into words, finest first: no piece may reach over a cut.
LETTERS, DIGITS = r"A-Za-z\xC0-῿⁰-▀▂-\U0010FFFF", "0-9"
CUTS = ((LETTERS, DIGITS), (f"{LETTERS}{DIGITS}",), ())
#: What a character without a piece costs below the least score, as in the library.
UNKNOWN = 10.0
#: Stops of a stretch of a long word, and words that workers hold; further words are joined.
BLOCK, HEAD = 32, 4_000_000
#: Characters up to which a word is its own key, edges up to which its paths are arrays, and words of a task of the lattice.
LONG, LONG_EDGES, TASK_WORDS = 48, 500, 60_000
#: Distinct words that a task gathers before it passes them on, chunks that it remembers, and rows that it takes at a time.
GATHER, SEEN, ROWS = 80_000, 250_000, 200
#: Rows of a batch between Spark and its workers, and files of the table that workers read.
BATCH, PARTS = 400, 16


@dataclass(frozen=True)
class Pieces:
    """The piece table of a model file."""

    names: tuple[str, ...]
    ids: tuple[int, ...]
    scores: tuple[float, ...]
    bytes_: tuple[int, ...]
    surface: tuple[bytes, ...]
    prefix: bool

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.names))

    @cached_property
    def cut(self) -> str:
        """A pattern for words: runs of one class, each with the blanks before it.

        A character that is in no longer piece is a word alone, so texts in
        scripts of which the model has single characters have short words.
        """
        joined = sorted({c for p in self.names if len(p) > 1 for c in p} - {SPACE})
        for classes in CUTS:
            rest = re.compile(f"[{''.join(classes)}]" if classes else r"(?!)")
            groups = [[c for c in joined if re.match(f"[{k}]", c)] for k in classes] + [[c for c in joined if not rest.match(c)]]
            runs = [f"[{''.join(map(re.escape, g))}]+" for g in groups if g]
            pattern = rf"(?s:{SPACE}*(?:{'|'.join([*runs, f'[^{SPACE}]'])})|{SPACE}+)"
            whole = re.compile(pattern)
            if all(whole.fullmatch(p) for p in self.names):
                return pattern
        raise ValueError("no cut fits the pieces")


def load(path: str = MODEL) -> Pieces:
    """The pieces of a model that normalises nothing but the blank; others are refused."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("the model rewrites characters or blanks")
    kinds = {"NORMAL": 1, "BYTE": 6}
    normal = [(p.piece, i, p.score) for i, p in enumerate(model.pieces) if p.type == kinds["NORMAL"]]
    as_bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds["BYTE"]}
    if len(as_bytes) != 256:
        raise ValueError("the model has no byte for every value")
    surface = [p.piece.replace(SPACE, " ").encode() if p.type == kinds["NORMAL"] else b"" for p in model.pieces]
    for value, i in as_bytes.items():
        surface[i] = bytes([value])
    names, ids, scores = zip(*normal)
    return Pieces(names, ids, scores, tuple(as_bytes[v] for v in range(256)), tuple(surface), model.normalizer_spec.add_dummy_prefix)


def escaped(text: str, pieces: Pieces) -> str:
    return (SPACE if pieces.prefix and text else "") + text.replace(" ", SPACE)


def decode(ids: list[int], pieces: Pieces) -> str:
    """The text of ids: pieces joined, byte pieces as UTF-8, blanks restored, the added one dropped."""
    raw = b"".join([pieces.surface[i] for i in ids])
    return (raw[1:] if pieces.prefix and raw.startswith(b" ") else raw).decode(errors="replace")


class Chunks:
    """Cuts texts into chunks that no piece reaches over, and chunks into words.

    At single blanks where that can be; chunks are then known without the escape
    before them. Other texts are cut into words at once.
    """

    def __init__(self, pieces: Pieces):
        self.find, self.prefix = re.compile(pieces.cut).findall, pieces.prefix

    def odd(self, text: str) -> bool:
        return not self.prefix or "  " in text or SPACE in text or text[:1] == " " or text[-1:] == " "

    def of(self, text: str) -> tuple[bool, list[str]]:
        """Whether the chunks are words already, and the chunks."""
        if not text:
            return False, []
        if not self.odd(text):
            return False, text.split(" ")
        return True, self.find((SPACE if self.prefix else "") + text.replace(" ", SPACE))

    def words(self, chunks: list[str]) -> list[str]:
        """The words of chunks between blanks, end to end; the first of each chunk begins with the escape, no other does."""
        return self.find(SPACE + SPACE.join(chunks)) if chunks else []


def word_key(word: str) -> str:
    """The word itself, or a digest of a long one: nothing that is grouped or joined is long."""
    return word if len(word) <= LONG else "sha256:" + hashlib.sha256(word.encode()).hexdigest()


def _key(word: Column) -> Column:
    return F.when(F.length(word) <= LONG, word).otherwise(F.concat(F.lit("sha256:"), F.sha2(word.cast("binary"), 256)))


def words(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """The distinct words of all texts with their keys; n: in how many gatherings they are.

    A task remembers the chunks that it has cut, so of frequent ones only the
    first is.
    """
    cut = Chunks(pieces)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[str] = set()
        seen: list[set[str]] = [set(), set()]
        for batch in _small(batches):
            new: list[set[str]] = [set(), set()]
            for text in batch.column(0).to_pylist():
                whole, chunks = cut.of(text or "")
                known = seen[whole]
                new[whole].update([c for c in chunks if c not in known])
            held.update(new[True], cut.words(list(new[False])))
            for s, more in zip(seen, new):
                s.clear() if len(s) > SEEN else None
                s |= more
            if len(held) > GATHER:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string())], names=["word"])
                held = set()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string())], names=["word"])
        del held, seen
        give_back()

    rows = docs.select(F.col("text").cast("string")).mapInArrow(work, "word string")
    return rows.groupBy("word").agg(F.count("*").alias("n")).select(_key(F.col("word")).alias("key"), "word", "n")


def useful(pieces: Pieces) -> dict[str, tuple[int, float]]:
    """The pieces, with id and score, that can be on a best path.

    A piece that other pieces spell with a higher score never is: wherever it
    stands, the others do better. Equals stay, since the widest edge counts.
    """
    score = dict(zip(pieces.names, pieces.scores))
    least = min(pieces.scores) - UNKNOWN
    out = {}
    for name, i in zip(pieces.names, pieces.ids):
        best = [0.0]
        for stop in range(1, len(name) + 1):
            ways = [best[at] + score.get(name[at:stop], least if stop - at == 1 else -math.inf) for at in range(stop) if stop - at < len(name)]
            best.append(max(ways, default=-math.inf))
        if best[-1] <= score[name] + 1e-6:
            out[name] = (i, score[name])
    return out


def widths(names: Iterable[str]) -> dict[str, list[int]]:
    """For each end of three characters that a piece has: the widths that a piece there can have, narrow first."""
    found: dict[str, set[int]] = {}
    for name in names:
        if len(name) >= 3:
            found.setdefault(name[-3:], {1, 2}).add(len(name))
    return {end: sorted(n) for end, n in found.items()}


def edges(spark: SparkSession, found: DataFrame, pieces: Pieces) -> DataFrame:
    """The lattice of each word: key, code, width, id, score of every substring that is a useful piece,
    and of every other single character, with the negative of its code point less one for an id.

    code is 64 times the stop and the width: by stop, narrow edges first. Long
    words are taken in stretches, so that a substring is cut from a short
    string. Substrings are exploded by stop, up to the longest piece, and only
    in widths that a piece with the same last three characters has.
    """
    longest, best = pieces.longest, useful(pieces)
    if longest >= 64:
        raise ValueError("pieces of 64 characters and more")
    stretch = found.select("key", "word", F.explode(F.sequence(F.lit(0), F.length("word") - 1, F.lit(BLOCK))).alias("at"))
    stretch = stretch.withColumn("lead", F.least("at", F.lit(longest - 1)))
    part = F.substring("word", F.col("at") - F.col("lead") + 1, F.col("lead") + BLOCK)
    stretch = stretch.select("key", (F.col("at") - F.col("lead")).alias("from"), "lead", part.alias("part"))
    stops = stretch.select("key", "from", "part", F.explode(F.sequence(F.col("lead") + 1, F.length("part"))).alias("p"))
    stops = stops.withColumn("end", F.substring("part", F.col("p") - 2, F.when(F.col("p") > 2, 3).otherwise(0)))
    ends = widths(best)
    # Both tables have the size of a model file's vocabulary, whatever the input.
    by_end = spark.createDataFrame(pa.table({"end": pa.array(list(ends), pa.string()), "widths": pa.array(list(ends.values()), pa.list_(pa.int32()))}))
    table = spark.createDataFrame(pa.table({"piece": pa.array(list(best), pa.string()), "id": pa.array([i for i, _ in best.values()], pa.int32()), "score": pa.array([s for _, s in best.values()], pa.float64())}))
    stops = stops.join(F.broadcast(by_end), "end", "left")
    subs = stops.select("key", "from", "part", "p", F.explode(F.coalesce("widths", F.array(F.lit(1), F.lit(2)))).alias("width")).where("width <= p")
    subs = subs.select("key", ((F.col("from") + F.col("p")) * 64 + F.col("width")).alias("code"), "width", F.substring("part", F.col("p") - F.col("width") + 1, F.col("width")).alias("piece"))
    met = subs.join(F.broadcast(table), "piece", "left").where("id is not null or width = 1")
    unknown = F.lit(min(pieces.scores) - UNKNOWN)
    return met.select("key", "code", "width", F.coalesce("id", -1 - F.ascii("piece")).alias("id"), F.coalesce("score", unknown).alias("score"))


def _fold(edges_: Column, longest: int, long: bool) -> Column:
    """Viterbi over a word's edges, sorted by code: the ids of its best path.

    The state holds score and path of the stops before, and of the stop at hand
    by its best edge so far. Each stop has an edge of one character, which comes
    first: it begins the stop. Of equal scores the widest edge stays. Spark runs
    this expression by expression, and copies the state in every step, nested
    arrays included, but not binary values. So each step has as few expressions
    as can be, and for long words the last `longest` stops alone are kept and a
    path is binary: a comma and an id for each edge.
    """

    def after(path: Column, e: Column) -> Column:
        return F.concat(path, F.concat(F.lit(","), e["id"].cast("string")).cast("binary") if long else F.array(e["id"]))

    def state_of(tail: Column, before: Column, e: Column) -> Column:
        return F.struct(tail.alias("tail"), (before["score"] + e["score"]).alias("score"), after(before["path"], e).alias("path"))

    def step(state: Column, e: Column) -> Column:
        tail = state["tail"]
        kept = F.when(F.size(tail) >= 2 * longest, F.slice(tail, longest + 1, longest)).otherwise(tail) if long else tail
        pushed = F.concat(kept, F.array(F.struct(state["score"].alias("score"), state["path"].alias("path"))))
        before = F.element_at(tail, -e["width"])
        better = F.when(before["score"] + e["score"] >= state["score"], state_of(tail, before, e)).otherwise(state)
        return F.when(e["width"] == 1, state_of(pushed, state, e)).otherwise(better)

    none = F.lit(b"") if long else F.array().cast("array<int>")
    kind = f"array<struct<score:double,path:{'binary' if long else 'array<int>'}>>"
    path = F.aggregate(edges_, F.struct(F.array().cast(kind).alias("tail"), F.lit(0.0).alias("score"), none.alias("path")), step, lambda s: s["path"])
    return F.split(F.substring(path.cast("string"), 2, 1 << 30), ",").cast("array<int>") if long else path


def _spelt(ids: Column, bytes_: tuple[int, ...]) -> Column:
    """ids with the UTF-8 bytes of the characters that have no piece in their places."""
    names = F.array(*[F.lit(b) for b in bytes_])

    def spell(c: Column) -> Column:
        last = lambda shift: F.shiftright(c, shift).bitwiseAND(63) + 128
        values = (
            F.when(c < 0x80, F.array(c))
            .when(c < 0x800, F.array(F.shiftright(c, 6) + 0xC0, last(0)))
            .when(c < 0x10000, F.array(F.shiftright(c, 12) + 0xE0, last(6), last(0)))
            .otherwise(F.array(F.shiftright(c, 18) + 0xF0, last(12), last(6), last(0)))
        )
        return F.transform(values, lambda v: F.element_at(names, v + 1))

    each = F.transform(ids, lambda i: F.when(i >= 0, F.array(i)).otherwise(spell(-1 - i)))
    return F.when(F.exists(ids, lambda i: i < 0), F.flatten(each)).otherwise(ids)


def encode_words(spark: SparkSession, found: DataFrame, pieces: Pieces, parts: int) -> DataFrame:
    """key, mark and check (hashes of it) and ids of each distinct, non-empty word: its edges grouped and folded in order.

    The grouping keeps the partitioning of the words, so no edge is shuffled. The
    fold takes each edge once, so a long word takes time in proportion.
    """
    # A number keeps Spark from merging small partitions: a word's edges are a hundred times its size.
    lattice = edges(spark, found.select("key", "word").repartition(parts, "key"), pieces)
    ordered = F.sort_array(F.collect_list(F.struct("code", "width", "id", "score")))
    whole = lattice.groupBy("key").agg(ordered.alias("edges"))
    long, short = (_fold(F.col("edges"), pieces.longest, k) for k in (True, False))
    done = whole.select("key", F.when(F.size("edges") > LONG_EDGES, long).otherwise(short).alias("ids"))
    return done.select("key", F.xxhash64("key").alias("mark"), F.crc32(F.col("key").cast("binary")).alias("check"), _spelt(F.col("ids"), pieces.bytes_).alias("ids"))


#: Spark's seed, so that its xxhash64 and ours agree.
SEED = 42


class Book:
    """The ids of known words: hashes in order, as they come, and the ids of all words end to end.

    About 24 bytes a word. A word is known by 96 bits, 64 to find it and 32 to
    check it; two with the same 64 are refused.
    """

    def __init__(self, path: str, small: bool):
        fs, base = pyarrow.fs.FileSystem.from_uri(path)
        names = sorted(f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(base)) if f.path.endswith(".parquet"))
        total = 0
        for name in names:
            with fs.open_input_file(name) as file:
                total += pyarrow.parquet.ParquetFile(file).metadata.num_rows
        marks, check, stop, ids, at = np.empty(total, np.int64), np.empty(total, np.uint32), np.zeros(total + 1, np.uint32), bytearray(), 0
        kind = np.uint16 if small else np.int32
        for name in names:
            with fs.open_input_file(name) as file:
                for batch in pyarrow.parquet.ParquetFile(file).iter_batches(65_536, columns=["mark", "check", "ids"]):
                    n, lists = len(batch), batch.column("ids")
                    marks[at : at + n] = batch.column("mark").to_numpy()
                    check[at : at + n] = batch.column("check").to_numpy()
                    stop[at + 1 : at + n + 1] = stop[at] + np.cumsum(np.diff(lists.offsets.to_numpy())).astype(np.uint32)
                    ids += lists.flatten().to_numpy().astype(kind).tobytes()
                    at += n
        self.marks, self.check, self.stop, self.flat = marks, check, stop, np.frombuffer(ids, kind)
        if (marks[1:] <= marks[:-1]).any():
            raise ValueError("words out of order, or two with one hash")

    def find(self, batch: list[str]) -> np.ndarray:
        """The place of each word, -1 for unknown ones."""
        if not len(self.marks):
            return np.full(len(batch), -1)
        raw = [word_key(w).encode() for w in batch]
        want = np.array(list(map(xxhash.xxh64_intdigest, raw, repeat(SEED))), np.uint64).view(np.int64)
        at = np.minimum(np.searchsorted(self.marks, want), len(self.marks) - 1)
        known = (self.marks[at] == want) & (self.check[at] == np.array(list(map(zlib.crc32, raw)), np.uint32))
        return np.where(known, at, -1)

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all places end to end, unknown ones passed over, and where those of each begin and end."""
        known = places >= 0
        size = np.zeros(len(places), np.int64)
        size[known] = self.stop[places[known] + 1].astype(np.int64) - self.stop[places[known]]
        upto = np.concatenate(([0], np.cumsum(size)))
        some, n = places[known], size[known]
        at = np.repeat(self.stop[some].astype(np.int64) - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return self.flat[at].astype(np.int32), upto


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.slice(at, ROWS)


class Reader:
    """Encodes texts by the book, remembering the chunks that it has met: SEEN at most."""

    def __init__(self, book: Book, pieces: Pieces):
        self.book, self.pieces, self.cut = book, pieces, Chunks(pieces)
        # Chunk to its ids as bytes, for chunks between blanks and for words.
        self.known: list[dict[str, bytes]] = [{}, {}]
        #: Chunks with unknown words, and those that their ids do not decode to.
        self.broken: list[set[str]] = [set(), set()]
        self.wrong: list[set[str]] = [set(), set()]

    def learn(self, texts: list[list[str]], whole: bool) -> None:
        """Ids of all chunks of the texts that are new."""
        if len(self.known[whole]) > SEEN:
            for held in (self.known, self.broken, self.wrong):
                held[whole].clear()
        known = self.known[whole]
        new = list({c for chunks in texts for c in chunks if c not in known})
        parts = new if whole else self.cut.words(new)
        places = self.book.find(parts)
        flat, upto = self.book.ids(places)
        first = np.arange(len(new)) if whole else np.flatnonzero([w[0] == SPACE for w in parts])
        last = np.concatenate((first[1:], [len(parts)])).astype(np.int64)[: len(new)]
        lost = np.concatenate(([0], np.cumsum(places < 0)))
        raw = flat.tobytes()
        start, stop = (4 * upto[first]).tolist(), (4 * upto[last]).tolist()
        self.known[whole].update(zip(new, [raw[a:b] for a, b in zip(start, stop)]))
        self.broken[whole].update(new[i] for i in np.flatnonzero(lost[last] > lost[first]).tolist())
        surface = self.pieces.surface
        # One comparison for all; each by itself only if it fails.
        if b"".join([surface[i] for i in flat.tolist()]) != "".join(parts).encode().replace(SPACE.encode(), b" "):
            for c, i, j, a, b in zip(new, first.tolist(), last.tolist(), start, stop):
                if b"".join([surface[i] for i in np.frombuffer(raw[a:b], np.int32).tolist()]) != "".join(parts[i:j]).encode().replace(SPACE.encode(), b" "):
                    self.wrong[whole].add(c)

    def gaps(self, chunks: list[str], whole: bool) -> tuple[bytes, list[dict]]:
        """Ids and gaps (after how many ids, key) of a text with unknown words."""
        parts = chunks if whole else self.cut.words(chunks)
        places = self.book.find(parts)
        flat, upto = self.book.ids(places)
        return flat.tobytes(), [{"at": int(upto[i]), "key": word_key(parts[i])} for i in np.flatnonzero(places < 0).tolist()]


def _encoded(docs: DataFrame, path: str, pieces: Pieces) -> DataFrame:
    """doc_id, ids, gaps, exact, row: the ids of known words, and where words are unknown (at, key), at counting ids."""
    gap_type = pa.list_(pa.struct([("at", pa.int32()), ("key", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        reader = Reader(Book(path, len(pieces.surface) < 1 << 16), pieces)
        for batch in _small(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            cut = [reader.cut.of(t) for t in texts]
            for whole in (False, True):
                reader.learn([c for w, c in cut if w == whole], whole)
            get = [k.__getitem__ for k in reader.known]
            raw = [b"".join(map(get[w], c)) for w, c in cut]
            gaps: list[list[dict]] = [[]] * len(batch)
            exact: list[bool | None] = [True] * len(batch)
            for i, (w, c) in enumerate(cut):
                if reader.broken[w] and not reader.broken[w].isdisjoint(c):
                    raw[i], gaps[i] = reader.gaps(c, w)
                    exact[i] = None
                elif w and SPACE in texts[i] or reader.wrong[w] and not reader.wrong[w].isdisjoint(c):
                    exact[i] = decode(np.frombuffer(raw[i], np.int32).tolist(), pieces) == texts[i]
            ends = np.concatenate(([0], np.cumsum([len(r) // 4 for r in raw]))).astype(np.int32)
            made = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), made, pa.array(gaps, gap_type), pa.array(exact, pa.bool_()), batch.column(2)], names=["doc_id", "ids", "gaps", "exact", "row"])
        # A worker lives on after its task: it gives the memory back.
        del reader
        give_back()

    return docs.mapInArrow(work, "doc_id long, ids array<int>, gaps array<struct<at:int,key:string>>, exact boolean, row binary")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _filled(ids, gaps):
    import pandas as pd

    out = []
    for known, holes in zip(ids, gaps):
        parts, at = [], 0
        for hole in holes:
            parts += [known[at : hole["at"]], hole["ids"]]
            at = hole["at"]
        out.append(np.concatenate([*parts, known[at:]]).astype(np.int32) if len(holes) else known)
    return pd.Series(out)


def encode(spark: SparkSession, docs: DataFrame, model: str = MODEL, head: int = HEAD) -> DataFrame:
    """doc_id, n_pieces, ids and exact (the ids decode to the text) of each row of docs.

    Words are encoded once for the whole corpus. Workers read the ids of `head`
    of them from the shared folder, those that most gatherings have, a bounded
    table; rows with further words get those by a join. The session's Arrow
    batches are made smaller if they are larger than BATCH rows. Null and empty
    texts have no ids; texts with the escape character itself decode to a blank
    there, so they are not exact; repeated rows each get a row; an empty table
    gives none.
    """
    pieces = load(model)
    # Texts can be long: batches of 10,000 rows, Spark's default, would fill a worker.
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    counts = settle(spark, words(docs, pieces).where("word <> ''"), "words")
    total = counts.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_WORDS))
    done = settle(spark, encode_words(spark, counts, pieces, parts), "ids")
    top, rare = done, None
    if total > head:
        top = counts.select("key", "n").join(done, "key").orderBy(F.desc("n"), "key").limit(head).select("key", "mark", "check", "ids")
    path = shared_path(spark, "head")
    # In the order of the hashes, from the first file to the last.
    top.repartitionByRange(PARTS, "mark").sortWithinPartitions("mark").write.parquet(path)
    if top is not done:
        rare = done.join(spark.read.parquet(path).select("key"), "key", "left_anti")
    # Rows with further words are known by the digest of their text.
    row = F.lit(None).cast("binary") if rare is None else _digest(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row.alias("row"))
    full = _encoded(rows, path, pieces)
    if rare is None:
        return full.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "exact")
    return _with_rare(spark, docs, settle(spark, full, "known"), rare, pieces)


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _with_rare(spark: SparkSession, docs: DataFrame, full: DataFrame, rare: DataFrame, pieces: Pieces) -> DataFrame:
    whole = full.where(F.size("gaps") == 0).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "exact")
    open_ = full.where(F.size("gaps") > 0)
    holes = open_.dropDuplicates(["row"]).select("row", F.posexplode("gaps").alias("k", "gap")).select("row", "k", "gap.at", "gap.key")
    holes = holes.join(rare, "key").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "at", "ids"))).alias("holes"))
    some = open_.join(holes, "row").select("row", "doc_id", _filled("ids", "holes").alias("ids"))
    texts = docs.select(_digest(F.col("text")).alias("row"), F.col("text").cast("string").alias("text")).dropDuplicates(["row"])

    @F.pandas_udf("boolean")
    def same(ids, text):
        import pandas as pd

        return pd.Series([decode(list(i), pieces) == (t or "") for i, t in zip(ids, text)], dtype=bool)

    some = some.join(texts, "row").select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", same("ids", "text").alias("exact"))
    return whole.unionByName(some)


def decoded(df: DataFrame, model: str = MODEL) -> DataFrame:
    """df (doc_id, ids, ...) with text added: the texts that the ids stand for; null ids give a null text."""
    pieces = load(model)

    @F.pandas_udf("string")
    def back(ids):
        import pandas as pd

        return pd.Series([None if i is None else decode(list(i), pieces) for i in ids], dtype=object)

    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != "text"], back("ids").alias("text"))
