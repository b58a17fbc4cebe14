"""Registered queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkloom.functions import checks, masking, prose
from inkloom.functions import layout
from inkloom.functions import terms as T
from inkloom.operators import guard, infer, memo, report, samples, segments
from inkloom.operators.backend import Faulty, TermTable
from inkloom.operators.stage import shared_path
from inkloom.plans.document import translate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_FUNCTION = f"[{_list(T.function_words())}]"
_HITS = f"len(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda x: list_contains({_FUNCTION}, lower(x))))"
_COUNTED = f"SELECT doc_id, lang, len(regexp_extract_all(text, '[A-Za-z]+')) AS words, {_HITS} AS hits FROM documents"
_PROSE = f"(words < {T.PROSE_WORDS} OR CASE WHEN words > 0 THEN hits::DOUBLE / words ELSE 0 END >= {T.PROSE_DENSITY})"


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.word_counts(_table(spark, sf_dir, "documents"), masked=False)


@query(f"SELECT doc_id, words, hits, CASE WHEN words > 0 THEN hits::DOUBLE / words ELSE 0 END AS density FROM ({_COUNTED})")
def prose_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRS1, PRS2: words and function words of each document."""
    return _counted(spark, sf_dir).select("doc_id", "words", "hits", prose.density(F.col("hits"), F.col("words")).alias("density"))


@query(f"SELECT doc_id, {_PROSE} AS prose FROM ({_COUNTED})")
def prose_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRS3: the verdict on each document."""
    return _counted(spark, sf_dir).select("doc_id", prose.is_prose(F.col("hits"), F.col("words")).alias("prose"))


@query(f"SELECT lang, count(*) AS n, count(*) FILTER (WHERE {_PROSE}) AS n_prose FROM ({_COUNTED}) GROUP BY lang")
def guard_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRS3 by language."""
    rows = _counted(spark, sf_dir)
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(prose.is_prose(F.col("hits"), F.col("words"))).alias("n_prose"))


@query(r"SELECT doc_id, 1 + len(regexp_extract_all(text, '[.!?]\s+\S')) AS n_sentences FROM documents WHERE text <> ''")
def sentence_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL10: sentences of each document."""
    docs = _table(spark, sf_dir, "documents").where("text <> ''")
    return docs.select("doc_id", F.size(checks.sentences(F.col("text"))).cast("long").alias("n_sentences"))


_KEY = f"sha256('{T.PIPELINE_VERSION}' || chr(0) || 'none' || chr(0) || '1' || chr(0) || text || chr(0))"


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text", prose.cache_key(F.col("text"), "none", 1).alias("key"))


@query(f"SELECT doc_id, {_KEY} AS key FROM documents")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CCH1: the key of each document."""
    return _keyed(spark, sf_dir).select("doc_id", "key")


@query(f"SELECT substr(key, 1, 2) AS shard, count(*) AS entries, sum(size)::BIGINT AS bytes FROM (SELECT {_KEY} AS key, min(strlen(text)) AS size FROM documents GROUP BY 1) GROUP BY 1")
def cache_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CCH6, CCH7: distinct entries and bytes of each shard."""
    once = _keyed(spark, sf_dir).groupBy("key").agg(F.min(F.octet_length("text")).alias("size"))
    return once.groupBy(memo.shard(F.col("key")).alias("shard")).agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"))


@query("SELECT count(*) AS n, count(DISTINCT text) AS n_distinct, count(*) - count(DISTINCT text) AS saved FROM documents")
def dedup_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INF6: inferences saved by taking each text once."""
    # Texts are counted by digest, so the exchange carries 32 bytes a row.
    once = _table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("k")).agg(F.count("*").alias("k_n"))
    return once.agg(F.sum("k_n").alias("n"), F.count("*").alias("n_distinct"), (F.sum("k_n") - F.count("*")).alias("saved"))


def _warm(spark: SparkSession, sf_dir: str) -> tuple[memo.Memo, DataFrame]:
    """A cache that holds the documents with even ids, and all documents."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = memo.Memo(spark, shared_path(spark, "memo"), "none", 1)
    outcome = F.struct(F.col("text"), F.lit(True).alias("translated"), F.lit(None).cast("string").alias("reason"))
    held.put(docs.where("doc_id % 2 = 0").select(held.key(F.col("text")).alias("key"), outcome.alias("outcome")))
    return held, docs


@query(f"""WITH k AS (SELECT doc_id, text, {_KEY} AS key FROM documents), warm AS (SELECT key, min(strlen(text)) AS size FROM k WHERE doc_id % 2 = 0 GROUP BY key)
SELECT (SELECT count(*) FROM warm) AS entries, (SELECT sum(size)::BIGINT FROM warm) AS bytes, count(warm.key) AS hits, count(*) - count(warm.key) AS misses, count(warm.key)::DOUBLE / count(*) AS hit_rate FROM k LEFT JOIN warm USING (key)""")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CCH2, CCH7, AGG22: all documents looked up in a cache of those with even ids."""
    held, docs = _warm(spark, sf_dir)
    return held.stats(docs)


@query(f"SELECT doc_id, {_KEY} AS key FROM documents WHERE {_KEY} NOT IN (SELECT {_KEY} FROM documents WHERE doc_id % 2 = 0)")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CCH3: documents that no even id has stored."""
    held, docs = _warm(spark, sf_dir)
    return held.misses(docs).select("doc_id", "key")


_O, _C = T.OPEN, T.CLOSE
#: Outputs of a source with two placeholders, by doc_id: as it is, swapped, one lost, one twice, a strange one, one broken.
_VARIANTS = (f"{_O}0{_C} # {_O}1{_C}", f"{_O}1{_C} # {_O}0{_C}", f"# {_O}1{_C}", f"{_O}0{_C} # {_O}0{_C} {_O}1{_C}", f"{_O}0{_C} # {_O}1{_C} {_O}7{_C}", f"{_O} 0{_C} # {_O}1{_C}")
_VARIANT = f"replace([{_list(_VARIANTS)}][doc_id % {len(_VARIANTS)} + 1], '#', text)"
_TIMES = {n: f"(length(output) - length(replace(output, '{_O}{n}{_C}', ''))) / 3" for n in (0, 1, 7)}


@query(f"""SELECT doc_id, CASE WHEN contains(output, '{_O} ') THEN 'malformed placeholder' WHEN {_TIMES[7]} > 0 THEN 'unexpected placeholder'
WHEN {_TIMES[0]} = 0 OR {_TIMES[1]} = 0 THEN 'missing placeholder' WHEN {_TIMES[0]} > 1 OR {_TIMES[1]} > 1 THEN 'duplicate placeholder' ELSE 'none recorded' END AS family
FROM (SELECT doc_id, {_VARIANT} AS output FROM documents WHERE length(text) > 20)""")
def placeholder_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL2-VAL4: documents between placeholders, with outputs that keep, swap, lose, repeat, add or break one."""
    docs = _table(spark, sf_dir, "documents").where("length(text) > 20")
    source = F.concat(F.lit(f"{_O}0{_C} "), F.col("text"), F.lit(f" {_O}1{_C}"))
    output = F.replace(F.get(F.array(*map(F.lit, _VARIANTS)), (F.col("doc_id") % len(_VARIANTS)).cast("int")), F.lit("#"), F.col("text"))
    reason = checks.placeholder_reason(source, output, F.array(F.lit(0), F.lit(1)))
    return docs.select("doc_id", checks.reason_family(reason).alias("family"))


_PAIRS = "SELECT conv_id, turn, text AS output, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS source FROM conversations"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the one before it, as source and output."""
    turns = _table(spark, sf_dir, "conversations")
    source = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return turns.select("conv_id", "turn", source.alias("source"), F.col("text").alias("output")).where("source is not null")


def _nothing() -> Column:
    return F.array().cast("array<int>")


_LENGTH = f"(length(source) > 0 AND length(output)::DOUBLE / length(source) NOT BETWEEN {T.MIN_LENGTH_RATIO} AND {T.MAX_LENGTH_RATIO})"
_BLANK = r"regexp_full_match(output, '\s*')"
_PLACEHOLDER_FAMILY = f"CASE WHEN {_BLANK} THEN 'blank output' WHEN {_LENGTH} THEN 'length ratio' ELSE 'none recorded' END"


@query(f"SELECT conv_id, turn, {_PLACEHOLDER_FAMILY} AS family FROM ({_PAIRS}) WHERE source IS NOT NULL")
def length_ratio_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL1-VAL5 on adjacent turns."""
    reason = checks.placeholder_reason(F.col("source"), F.col("output"), _nothing())
    return _pairs(spark, sf_dir).select("conv_id", "turn", checks.reason_family(reason).alias("family"))


def _trimmed(side: str) -> str:
    return rf"regexp_replace({side}, '^\s+|\s+$', '', 'g')"


def _sentences_sql(side: str) -> str:
    text = _trimmed(side)
    return rf"CASE WHEN {text} = '' THEN 0 ELSE 1 + len(regexp_extract_all({text}, '[.!?]\s+\S')) END"


def _list_sql(side: str) -> str:
    """Solid sentences of a text as a list: a mark is put at each cut first, twice for cuts that share a character."""
    put = rf"regexp_replace({_trimmed(side)}, '([.!?])\s+(\S)', '\1' || chr(1) || '\2', 'g')"
    return rf"list_filter(string_split({put}, chr(1)), lambda x: x <> '')"


_UNKNOWN = " OR ".join(f"contains(output, '{m}')" for m in T.UNKNOWN_MARKS)
_DELIMS = " OR ".join(f"length(source) - length(replace(source, '{d}', '')) <> length(output) - length(replace(output, '{d}', ''))" for d in T.DELIMITERS)
_REPEATED = (
    f"len(list_filter(list_distinct({_list_sql('output')}), lambda s: len(list_filter({_list_sql('output')}, lambda x: x = s)) > 1"
    f" AND len(list_filter({_list_sql('output')}, lambda x: x = s)) > len(list_filter({_list_sql('source')}, lambda x: x = s)))) > 0"
)
_STRUCTURE_FAMILY = (
    f"CASE WHEN {_UNKNOWN} THEN 'unknown token' WHEN {_sentences_sql('source')} <> {_sentences_sql('output')} THEN 'sentence count'"
    f" WHEN {_REPEATED} THEN 'repeated sentence' WHEN {_DELIMS} THEN 'delimiter' ELSE 'none recorded' END"
)


@query(f"SELECT conv_id, turn, {_STRUCTURE_FAMILY} AS family FROM ({_PAIRS}) WHERE source IS NOT NULL")
def structure_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL6-VAL9 on adjacent turns."""
    reason = checks.structure_reason(F.col("source"), F.col("output"))
    return _pairs(spark, sf_dir).select("conv_id", "turn", checks.reason_family(reason).alias("family"))


@query(f"""WITH f AS (SELECT CASE WHEN {_PLACEHOLDER_FAMILY} <> 'none recorded' THEN {_PLACEHOLDER_FAMILY} ELSE {_STRUCTURE_FAMILY} END AS family FROM ({_PAIRS}) WHERE source IS NOT NULL)
SELECT family, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM f) AS share FROM f WHERE family <> 'none recorded' GROUP BY family""")
def rejection_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL11, AGG2: families of the rejected among adjacent turns, with shares of all."""
    reason = checks.reason_of(F.col("source"), F.col("output"), _nothing())
    judged = _pairs(spark, sf_dir).withColumn("why", reason)
    outcome = F.struct(F.col("output").alias("text"), F.col("why").isNull().alias("translated"), F.col("why").alias("reason"))
    return report.rejections(judged.select(outcome.alias("outcome")))


@query(f"""WITH s AS (SELECT doc_id, unnest({_list_sql('text')}) AS s FROM documents)
SELECT doc_id, count(*) AS n_repeated, max(k) AS most FROM (SELECT doc_id, s, count(*) AS k FROM s GROUP BY ALL HAVING count(*) > 1) GROUP BY doc_id""")
def repeated_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL8 on one side: documents with sentences that occur more than once."""
    each = _table(spark, sf_dir, "documents").select("doc_id", F.explode(checks.solid_sentences(F.col("text"))).alias("s"))
    twice = each.groupBy("doc_id", F.xxhash64("s"), "s").agg(F.count("*").alias("k")).where("k > 1")
    return twice.groupBy("doc_id").agg(F.count("*").alias("n_repeated"), F.max("k").alias("most"))


_SIZE = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))"
_SIZED = f"SELECT doc_id, source, {_SIZE}::BIGINT AS size FROM documents"


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "source", report.token_size(F.col("text")).cast("long").alias("size"))


_BUCKET = "CASE " + " ".join(f"WHEN size >= {a} THEN '>{a - 1}'" if b is None else f"WHEN size BETWEEN {a} AND {b} THEN '{a}-{b}'" for a, b in T.SIZE_BUCKETS) + " END"


@query(f"SELECT {_BUCKET} AS bucket, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM ({_SIZED}) WHERE size >= 1 GROUP BY 1")
def size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG4: documents by size."""
    return report.size_histogram(_sized(spark, sf_dir))


@query(f"""SELECT source, n, median, most, mean FROM (
SELECT source, count(*) OVER w AS n, size AS median, max(size) OVER w AS most, avg(size) OVER w AS mean, row_number() OVER (PARTITION BY source ORDER BY size) AS rn
FROM ({_SIZED}) WINDOW w AS (PARTITION BY source)) WHERE rn = n // 2 + 1""")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG5: upper median, largest and mean size of each source."""
    return report.upper_median(_sized(spark, sf_dir), ["source"], "size")


@query(f"SELECT count(*) FILTER (WHERE size > 400) AS n, count(*) AS \"all\", count(*) FILTER (WHERE size > 400)::DOUBLE / count(*) AS share FROM ({_SIZED})")
def oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG6: documents above 400 tokens."""
    return report.oversized(_sized(spark, sf_dir))


@query(f"SELECT doc_id, size FROM ({_SIZED}) ORDER BY size DESC, doc_id LIMIT 5")
def top_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG7: the five largest documents."""
    return report.largest(_sized(spark, sf_dir).select("doc_id", "size"), "size", "doc_id")


_PARTS = {"p01": 0.01, "p05": 0.05, "p10": 0.1, "p50": 0.5, "p90": 0.9}


@query("SELECT source, max(n) AS n, " + ", ".join(f"max(size) FILTER (WHERE rn = floor({f} * (n - 1))::BIGINT + 1) AS {p}" for p, f in _PARTS.items()) + f""", max(size) AS most, avg(size) AS mean
FROM (SELECT source, size, row_number() OVER (PARTITION BY source ORDER BY size) AS rn, count(*) OVER (PARTITION BY source) AS n FROM ({_SIZED})) GROUP BY source""")
def lower_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG15: lower percentiles of size of each source."""
    return report.lower_percentiles(_sized(spark, sf_dir), ["source"], "size", _PARTS)


@query("""WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT DISTINCT source, doc_id FROM r, range(8) t(i) WHERE n <= 8 OR pos = floor(i * (n::DOUBLE / 8))""")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG12, AGG13: eight evenly spaced documents of each source."""
    return samples.spread(_table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], ["doc_id"], 8)


@query("""WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, doc_id FROM r WHERE pos % greatest(1, n // 30) = 0 AND pos < 30 * greatest(1, n // 30)""")
def output_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG21: every so-manieth document of each source, thirty at most."""
    return samples.every_nth(_table(spark, sf_dir, "documents").select("source", "doc_id"), ["doc_id"], by=["source"])


_RATIO = "round((d.doc_id * 37 % 100) / 200.0 + 0.5, 3)"


@query(f"""WITH r AS (SELECT substr(sha256(text), 1, 12) AS key, {_RATIO} AS ratio FROM documents d),
l AS (SELECT substr(sha256(text), 1, 12) AS key, max(CASE WHEN quality = 0 THEN 'omission' ELSE 'legitimate' END) AS verdict FROM labels JOIN documents USING (doc_id) GROUP BY 1),
t AS (SELECT unnest([{', '.join(map(str, T.THRESHOLDS))}])::DOUBLE AS threshold)
SELECT threshold, count(*) FILTER (WHERE ratio < threshold) AS rejected, count(*) FILTER (WHERE ratio < threshold AND verdict = 'omission') AS wanted,
count(*) FILTER (WHERE ratio < threshold) - count(*) FILTER (WHERE ratio < threshold AND verdict = 'omission') AS good,
CASE WHEN count(*) FILTER (WHERE ratio < threshold) > 0 THEN count(*) FILTER (WHERE ratio < threshold AND verdict = 'omission')::DOUBLE / count(*) FILTER (WHERE ratio < threshold) ELSE 0 END AS precision,
(count(*) FILTER (WHERE ratio < threshold) - count(*) FILTER (WHERE ratio < threshold AND verdict = 'omission'))::DOUBLE / count(*) AS cost
FROM r LEFT JOIN l USING (key), t GROUP BY threshold""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG16, AGG17: thresholds over ratios, labels joined by digest."""
    docs = _table(spark, sf_dir, "documents")
    rows = docs.select(report.label_key(F.col("text")).alias("key"), F.round((F.col("doc_id") * 37 % 100) / 200.0 + 0.5, 3).alias("ratio"))
    named = _table(spark, sf_dir, "labels").join(docs, "doc_id").select(report.label_key(F.col("text")).alias("key"), F.when(F.col("quality") == 0, "omission").otherwise("legitimate").alias("verdict"))
    return report.threshold_sweep(rows, named.groupBy("key").agg(F.max("verdict").alias("verdict")))


_TITLES = list(T.headers())[:12] + ["Usage", "NOWHERE"]
_TITLE = f"[{_list(_TITLES)}][doc_id % {len(_TITLES)} + 1]"
_HEADERS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.headers().items()) + "}"


@query(f"SELECT doc_id, {_TITLE} AS title, coalesce({_HEADERS}[{_TITLE}], {_TITLE}) AS shown FROM documents")
def header_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TBL3: a header for each document, looked up."""
    title = F.get(F.array(*map(F.lit, _TITLES)), (F.col("doc_id") % len(_TITLES)).cast("int"))
    return _table(spark, sf_dir, "documents").select("doc_id", title.alias("title"), prose.header(F.concat(F.lit(" "), title)).alias("h")).select("doc_id", "title", F.trim("h").alias("shown"))


_IPV4 = r"\b\d{1,3}(?:\.\d{1,3}){3}(?:/\d{1,2})?\b"


@query(rf"SELECT doc_id, len(regexp_extract_all(text, '{_IPV4}')) AS n, array_to_string(regexp_extract_all(text, '{_IPV4}'), ' ') AS found FROM documents WHERE regexp_matches(text, '{_IPV4}')")
def ipv4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MSK10, IPv4 alone: addresses of each document."""
    found = F.regexp_extract_all("text", F.lit(_IPV4), F.lit(0))
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n"), F.array_join(found, " ").alias("found")).where("n > 0")


@query("SELECT doc_id, text FROM documents")
def mask_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MSK1-MSK22: each document masked and restored."""
    masked = _table(spark, sf_dir, "documents").select("doc_id", masking.mask(F.col("text")).alias("m"))
    return masked.select("doc_id", masking.restore(F.col("m.text"), F.col("m.tokens")).alias("text"))


@query()
def mask_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MSK1-MSK20: protected literals of each page."""
    return _table(spark, sf_dir, "pages").select("page_id", masking.tokens(F.col("html")).alias("tokens"))


@query()
def syntax_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEG3: share of syntax in each page."""
    return _table(spark, sf_dir, "pages").select("page_id", masking.syntax_ratio(F.col("html")).alias("ratio"))


def _terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents given the layout of terminal pages, which they lack: a header, indents, a table, gaps, overstrike."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.split("text", "\n", -1)
    body = F.transform(lines, lambda x, i: F.concat(F.repeat(F.lit(" "), 7 + 4 * (i % 3 == 2).cast("int")), F.replace(x, F.lit(", "), F.lit(",  "))))
    rows = F.transform(F.slice(lines, 1, 4), lambda x, i: F.concat(F.rpad(F.concat(F.lit("  -"), F.chr(F.lit(97) + i), F.lit(", --opt"), i.cast("string")), 24, " "), F.substring(x, 1, 40)))
    bold = F.lit("N\bNA\bAM\bME\bE")
    text = F.concat_ws("\n", bold, F.array_join(body, "\n\n"), F.lit(""), F.lit("OPTIONS"), F.array_join(rows, "\n"), F.lit("\tends\r"))
    return docs.select("doc_id", text.alias("text"))


@query("SELECT doc_id, 1 + length(text) - length(replace(text, chr(10), '')) AS n_lines FROM documents WHERE text <> ''")
def line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC5, SEG1: lines of each document."""
    lines = segments.lines_of(_table(spark, sf_dir, "documents").where("text <> ''"))
    return lines.groupBy(F.col("doc").alias("doc_id")).agg(F.count("*").alias("n_lines"))


@query()
def normalize_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM1-NRM7 on documents laid out as terminal pages."""
    return _terminal(spark, sf_dir).select("doc_id", layout.normalize(F.col("text")).alias("text"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segments(normalize_layout(spark, sf_dir))


@query()
def segment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEG1-SEG19 on documents laid out as terminal pages."""
    return _segments(spark, sf_dir)


@query()
def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG3: segments and lines by kind."""
    return report.kind_counts(_segments(spark, sf_dir))


@query()
def masked_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG8: protected literals by kind of segment."""
    return report.masked_tokens(_segments(spark, sf_dir))


@query()
def reassembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OUT3: segments put together again; same: equal to what was cut."""
    clean = normalize_layout(spark, sf_dir)
    back = segments.reassemble(segments.segments(clean)).withColumnRenamed("text", "back")
    return clean.join(back, clean["doc_id"] == back["doc"]).select("doc_id", (F.col("text") == F.col("back")).alias("same"))


@query()
def rewrap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OUT1: turns filled to 60 columns."""
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", prose.rewrapped(F.col("text"), F.lit(60)).alias("text"))


def _inferred(spark: SparkSession, sf_dir: str, backend) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return infer.infer(docs, backend)


@query()
def translate_fake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INF1-INF9, TBL1: documents through a table of terms."""
    done = _inferred(spark, sf_dir, TermTable({"the": "bandeira", "and": "e"}, unknown=("$$",)))
    return done.select(F.col("id").alias("doc_id"), "outcome.translated", "outcome.reason", F.xxhash64("outcome.text").alias("text_hash"))


@query()
def sentence_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INF10, INF11: documents through a backend that damages a third of its texts."""
    done = _inferred(spark, sf_dir, Faulty())
    return done.select(F.col("id").alias("doc_id"), "outcome.translated", "outcome.reason")


@query()
def translate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OUT4: the whole pipeline over documents laid out as terminal pages."""
    return translate(_terminal(spark, sf_dir), TermTable({"the": "o"})).texts.withColumnRenamed("doc", "doc_id")
