"""Reports and measurements as aggregations."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.functions import checks, masking
from inkloom.functions import terms as T


def with_share(counts: DataFrame, of: str = "n", total: str | None = None) -> DataFrame:
    """counts with its share of the sum of the column, a small table by then."""
    whole = F.sum(of).over(Window.partitionBy(F.lit(0))) if total is None else F.col(total)
    return counts.withColumn("share", F.col(of) / whole)


def outcome_counts(segments: DataFrame) -> DataFrame:
    """One row: prose, literal, translated, english, partial, hits; segments has kind, text, outcome, hit.

    A partly recovered segment counts as translated; partial counts it besides.
    """
    live = F.col("outcome").isNotNull()
    done = F.col("outcome.translated")
    return segments.agg(
        F.count_if(live).alias("prose"),
        F.count_if(~live).alias("literal"),
        F.count_if(live & done).alias("translated"),
        F.count_if(live & ~done).alias("english"),
        F.count_if(live & done & F.col("outcome.reason").isNotNull()).alias("partial"),
        F.count_if(live & F.col("hit")).alias("hits"),
    )


def rejections(segments: DataFrame) -> DataFrame:
    """family, n, share of all prose; most frequent first, then by name."""
    live = segments.where(F.col("outcome").isNotNull())
    bad = live.where(~F.col("outcome.translated")).groupBy(checks.reason_family(F.col("outcome.reason")).alias("family")).agg(F.count("*").alias("n"))
    # One row of the total.
    return bad.crossJoin(live.agg(F.count("*").alias("all"))).select("family", "n", (F.col("n") / F.col("all")).alias("share")).orderBy(F.desc("n"), "family")


def kind_counts(segments: DataFrame) -> DataFrame:
    """kind, n, lines and their shares of segments that are not blank."""
    solid = segments.where(F.regexp_replace("text", r"(?U)\s+", "") != "")
    return with_share(solid.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.size(F.split("text", "\n", -1))).alias("lines")))


def token_size(text: Column) -> Column:
    """Tokens between white space."""
    return F.size(F.filter(F.split(text, r"(?U)\s+", -1), lambda w: w != ""))


def bucket(size: Column) -> Column:
    out = F.when(F.lit(False), "")
    for low, high in T.SIZE_BUCKETS:
        out = out.when(size >= low if high is None else size.between(low, high), f">{low - 1}" if high is None else f"{low}-{high}")
    return out


def size_histogram(rows: DataFrame, size: str = "size") -> DataFrame:
    return with_share(rows.where(F.col(size) >= 1).groupBy(bucket(F.col(size)).alias("bucket")).agg(F.count("*").alias("n")))


def ranked(rows: DataFrame, by: list[str], value: str, tie: str) -> DataFrame:
    """rows with rn and n of their group. Groups are sorted in one task each: use few-valued groups with care."""
    window = Window.partitionBy(*by).orderBy(value, tie)
    return rows.withColumn("rn", F.row_number().over(window)).withColumn("n", F.count("*").over(Window.partitionBy(*by)))


def order_statistics(rows: DataFrame, by: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """Values at given places (from 0, an expression over n) of each group's sorted values.

    Values are counted first, so what is sorted is a row for each distinct value.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy(*by).orderBy(value))
    sums = counts.withColumn("upto", upto).withColumn("n", F.sum("k").over(Window.partitionBy(*by)))
    at = lambda p: F.max(F.when((F.col("upto") > p) & (F.col("upto") - F.col("k") <= p), F.col(value)))
    return sums.groupBy(*by).agg(F.max("n").alias("n"), *[at(p).alias(name) for name, p in places.items()], F.max(value).alias("most"), (F.sum(F.col(value) * F.col("k")) / F.sum("k")).alias("mean"))


def upper_median(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, median (the upper of two), most and mean of each group."""
    return order_statistics(rows, by, value, {"median": F.floor(F.col("n") / 2)})


def lower_percentiles(rows: DataFrame, by: list[str], value: str, parts: dict[str, float]) -> DataFrame:
    return order_statistics(rows, by, value, {name: F.floor(F.lit(f) * (F.col("n") - 1)) for name, f in parts.items()})


def largest(rows: DataFrame, value: str, tie: str, k: int = 5) -> DataFrame:
    return rows.orderBy(F.desc(value), tie).limit(k)


def oversized(rows: DataFrame, size: str = "size", most: int = 400) -> DataFrame:
    """n above the limit, all, share."""
    return rows.agg(F.count_if(F.col(size) > most).alias("n"), F.count("*").alias("all")).withColumn("share", F.when(F.col("all") > 0, F.col("n") / F.col("all")).otherwise(0.0))


def masked_tokens(segments: DataFrame) -> DataFrame:
    """kind, n: protected literals by kind, with shares."""
    return with_share(segments.groupBy("kind").agg(F.coalesce(F.sum(F.size(masking.tokens(F.col("text")))), F.lit(0)).alias("n")))


def occurrences(line: Column, token: Column) -> Column:
    """array(start) where the token stands with no word character or hyphen on either side."""
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(line) - F.length(token) + 1, F.lit(1))), lambda i: F.substring(line, i, F.length(token)) == token)
    free = lambda c: ~F.coalesce(c, F.lit("")).rlike("[A-Za-z0-9_-]")
    bounded = F.filter(starts, lambda i: ((i == 1) | free(F.substring(line, i - 1, F.lit(1)))) & free(F.substring(line, i + F.length(token), F.lit(1))))
    return F.transform(bounded, lambda i: i - 1)


def recall(sample: DataFrame, annotations: DataFrame) -> DataFrame:
    """file, line_no, token, verdict of each annotation with a sample line: covered, partial or missing.

    Covered: every character of every occurrence is behind the mask. Partial:
    some are. Annotations without a sample line have verdict orphan.
    """
    lines = sample.select("file", "line_no", "text", masking.spans(F.col("text")).alias("spans"))
    both = annotations.join(lines, ["file", "line_no"], "left").withColumn("spots", occurrences(F.col("text"), F.col("token")))
    size = F.length("token")

    def covered(i: Column) -> Column:
        overlap = lambda s: F.greatest(F.least(s["stop"], i + size) - F.greatest(s["start"], i), F.lit(0))
        return F.aggregate("spans", F.lit(0), lambda n, s: n + overlap(s))

    hit = F.transform("spots", covered)
    verdict = (
        F.when(F.col("text").isNull(), "orphan")
        .when(F.size("spots") == 0, "missing")
        .when(F.forall(hit, lambda h: h == size), "covered")
        .when(F.exists(hit, lambda h: h > 0), "partial")
        .otherwise("missing")
    )
    return both.select("file", "line_no", "token", verdict.alias("verdict"), (F.size("spots") > 0).alias("present"))


def false_positives(sample: DataFrame, annotations: DataFrame) -> DataFrame:
    """file, line_no, literal: masked stretches of annotated files that touch no annotated character."""
    spans = sample.select("file", "line_no", "text", F.explode(masking.spans(F.col("text"))).alias("s"))
    marked = annotations.join(sample, ["file", "line_no"]).select("file", "line_no", F.explode(occurrences(F.col("text"), F.col("token"))).alias("a"), F.length("token").alias("k"))
    touch = (spans["file"] == marked["file"]) & (spans["line_no"] == marked["line_no"]) & (marked["a"] < spans["s.stop"]) & (marked["a"] + marked["k"] > spans["s.start"])
    alone = spans.join(marked, touch, "left_anti")
    return alone.select("file", "line_no", F.substring("text", F.col("s.start") + 1, F.col("s.stop") - F.col("s.start")).alias("literal"))


def threshold_sweep(rows: DataFrame, labels: DataFrame, ratio: str = "ratio", key: str = "key", wanted: str = "omission") -> DataFrame:
    """threshold, rejected, wanted, good, precision, cost for each threshold; seven of them."""
    spark = rows.sparkSession
    steps = spark.createDataFrame([(t,) for t in T.THRESHOLDS], "threshold double")
    known = rows.join(labels.select(F.col("key").alias(key), "verdict").dropDuplicates([key]), key, "left")
    crossed = known.crossJoin(F.broadcast(steps))  # seven rows
    below = F.col(ratio) < F.col("threshold")
    out = crossed.groupBy("threshold").agg(F.count_if(below).alias("rejected"), F.count_if(below & (F.col("verdict") == wanted)).alias("wanted"), F.count("*").alias("all"))
    out = out.withColumn("good", F.col("rejected") - F.col("wanted"))
    return out.select("threshold", "rejected", "wanted", "good", F.when(F.col("rejected") > 0, F.col("wanted") / F.col("rejected")).otherwise(0.0).alias("precision"), (F.col("good") / F.col("all")).alias("cost"))


def content_ratio(rows: DataFrame, least: int = 4) -> DataFrame:
    """rows (source, output, translated) with ratio: letter words of output and source behind their masks."""
    words = lambda c: F.size(F.regexp_extract_all(masking.mask(F.col(c))["text"], F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0)))
    return rows.where("translated").withColumn("n_source", words("source")).where(F.col("n_source") >= least).withColumn("ratio", words("output") / F.col("n_source"))


def label_key(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 12)


def rule_comparison(rows: DataFrame) -> DataFrame:
    """accepted by the placeholder rules, by all rules and the vocabulary, and newly rejected ones.

    rows: source, output, numbers, and unknown (array<string>) where a backend
    has told unknown pieces; see newly_rejected for the rules.
    """
    a, b = _both_rules(rows)
    return rows.agg(F.count_if(a.isNull()).alias("accepted_a"), F.count_if(a.isNull() & b.isNull()).alias("accepted_both"), F.count_if(a.isNull() & b.isNotNull()).alias("newly_rejected"))


def newly_rejected(rows: DataFrame) -> DataFrame:
    """rule, n: what rejects rows that pass the placeholder rules, most frequent first."""
    a, b = _both_rules(rows)
    return rows.where(a.isNull() & b.isNotNull()).groupBy(checks.reason_family(b).alias("rule")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule")


def _both_rules(rows: DataFrame) -> tuple[Column, Column]:
    structure = checks.structure_reason(F.col("source"), F.col("output"))
    unknown = F.when(F.size("unknown") > 0, "oov") if "unknown" in rows.columns else F.lit(None).cast("string")
    return checks.placeholder_reason(F.col("source"), F.col("output"), F.col("numbers")), F.coalesce(unknown, structure)


def sentence_drift(rows: DataFrame) -> DataFrame:
    """Translated rows of two and more sentences, and those whose number of sentences changed."""
    n, m = checks.sentence_count(F.col("source")), checks.sentence_count(F.col("output"))
    long = rows.where("translated").where(n >= 2)
    return long.agg(F.count("*").alias("n"), F.count_if(n != m).alias("drifted")).withColumn("share", F.when(F.col("n") > 0, F.col("drifted") / F.col("n")).otherwise(0.0))


def unknown_counts(rows: DataFrame) -> DataFrame:
    """Rows with unknown pieces by kind, over (unknown array<string>)."""
    from inkloom.operators.infer import unknown_kind

    return rows.groupBy(unknown_kind(F.col("unknown")).alias("kind")).agg(F.count("*").alias("n")).where("kind is not null")


def acceptance(rows: DataFrame) -> DataFrame:
    """One row over (text, outcome): n, accepted, rejected, recovered and lost, and the same for those with literals.

    Accepted: translated without a reason. Rejected: all others, of which those
    partly translated are recovered, and those that stay in English are lost.
    masked counts rows with a literal, masked_lost the lost ones of them; shares
    are of n, masked_share of masked.
    """
    done, reason = F.col("outcome.translated"), F.col("outcome.reason")
    live = rows.where("outcome is not null").withColumn("__literal", F.size(masking.tokens(F.col("text"))) > 0)
    counts = live.agg(
        F.count("*").alias("n"),
        F.count_if(done & reason.isNull()).alias("accepted"),
        F.count_if(~done | reason.isNotNull()).alias("rejected"),
        F.count_if(done & reason.isNotNull()).alias("recovered"),
        F.count_if(~done).alias("lost"),
        F.count_if("__literal").alias("masked"),
        F.count_if(F.col("__literal") & ~done).alias("masked_lost"),
    )
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)
    return counts.select("*", share("accepted", "n").alias("accepted_share"), share("lost", "n").alias("lost_share"), share("masked_lost", "masked").alias("masked_share"))


def top_reasons(rows: DataFrame, top: int = 8) -> DataFrame:
    """reason, n: the most frequent recorded reasons, ties by name."""
    return rows.where("outcome.reason is not null").groupBy(F.col("outcome.reason").alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(top)


def page_counts(segments: DataFrame) -> DataFrame:
    """doc, prose, hits: segments with an outcome of each document, and those that the cache had."""
    live = segments.where("outcome is not null")
    return live.groupBy("doc").agg(F.count("*").alias("prose"), F.count_if("hit").alias("hits"))


def cold_and_warm(docs: DataFrame, backend, memo, **options) -> DataFrame:
    """run (cold, warm), seconds, lookups, hits, rate, translated, english, literal and speedup of two runs over one cache."""
    from inkloom.plans.document import translate

    rows: list[tuple] = []
    for run in ("cold", "warm"):
        began = time.perf_counter()
        done = translate(docs, backend, memo=memo, **options)
        done.texts.write.format("noop").mode("overwrite").save()
        seconds = time.perf_counter() - began
        c = outcome_counts(done.segments).first()
        rate = c.hits / c.prose if c.prose else 0.0
        rows.append((run, seconds, c.prose, c.hits, rate, c.translated, c.english, c.literal, (rows[0][1] if rows else seconds) / seconds))
    fields = "run string, seconds double, lookups long, hits long, rate double, translated long, english long, literal long, speedup double"
    return docs.sparkSession.createDataFrame(rows, fields)
