"""URL filters: rules, then word segmentation and naive Bayes over host and path."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm._shared import settle

#: (verdict, host, path) of each rule; a rule fits its host, all subdomains, and paths that start with its own.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

#: Words with odds of PRIOR to one for either class before any URL counts, and log odds from which a URL is blocked:
#: most URLs are wanted, so what little counts say is not enough.
PRIOR, LEAST = 50.0, 3.0
UNWANTED = (
    "adult ads adware affiliate bet bets betting bingo bonus buy casino cheap click clicks coupon credit crypto dating deal deals diet discount drugs escort farm free gambling"
    " hack jackpot keygen loan loans lottery lucky malware money nude offer offers payday pharma pharmacy phish pills poker popup porn prize promo replica rich sex sexy slot slots"
    " spam spin sweepstakes torrent track tracker tracking traffic viagra warez weight win winner winning xxx"
).split()
WANTED = (
    "about academy article articles archive art blog book books city college community contact doc docs education en encyclopedia faq forum gov health help history home index"
    " journal kids library learn local map math mail museum music nature news org page pages paper people photo post press project public read research review school science"
    " society story study support team test tech travel university weather wiki world"
).split()
#: Hosts on which a name must occur before it counts as a word; characters of the shortest and longest word.
SPREAD, SHORTEST, LONGEST = 2, 3, 24
#: Starts of a stretch of a long name, and parts over which URLs with one token are dealt.
BLOCK, SALT = 32, 32
#: Bits of a hash by which one in FOLDS of the labelled URLs is held out when agreement is measured.
FOLDS = 5
GENERIC = set("www m mobile com net org edu gov io co uk example html htm php asp page ref utm source feed top".split())


def host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(where: Column, at: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; both null without one. Of equals the first wins."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((where == h) | where.endswith("." + h)) & at.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def best_split(name: str, edges: list[tuple[int, int, float]], unknown: float) -> tuple[list[str], bool]:
    """Unigram Viterbi: the cheapest split of name by its edges (stop, width, cost), and whether words cover it.

    A character of no word costs `unknown`; such characters stay together. Of
    equal costs the path with the longer last word counts.
    """
    by_stop: dict[int, list[tuple[int, float]]] = {}
    for stop, width, cost in edges:
        by_stop.setdefault(stop, []).append((width, cost))
    best, back = [0.0], [0]
    for stop in range(1, len(name) + 1):
        ways = [(best[stop - 1] + unknown, 0, stop - 1)]
        ways += [(best[stop - w] + c, -w, stop - w) for w, c in by_stop.get(stop, ())]
        cost, width, start = min(ways)
        best.append(cost)
        back.append(start if width else -start - 1)
    words, known, at = [], [], len(name)
    while at:
        known.append(back[at] >= 0)
        start = back[at] if back[at] >= 0 else -back[at] - 1
        words.append(name[start:at])
        at = start
    out: list[str] = []
    for i in range(len(words) - 1, -1, -1):
        if out and not known[i] and not known[i + 1]:
            out[-1] += words[i]
        else:
            out.append(words[i])
    return out, all(known)


def _urls(pages: DataFrame) -> DataFrame:
    url = F.col("url").cast("string")
    return pages.select(F.col("page_id").cast("long"), host(url).alias("host"), path(url).alias("path"))


def distinct_urls(spark: SparkSession, urls: DataFrame) -> DataFrame:
    """id, host, path and n, the rows, of each distinct host and path."""
    once = settle(spark, urls.groupBy("host", "path").agg(F.count("*").alias("n")), "urls")
    return settle(spark, once.withColumn("id", F.monotonically_increasing_id()), "ids")


def names(urls: DataFrame) -> DataFrame:
    """id, host, n, side and name of each run of letters or of digits, escapes of the path decoded.

    side is empty for the host and a slash for the path. Labels in punycode keep
    their xn prefix as a name.
    """
    runs = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\p{L}+|\p{N}+"), F.lit(0))
    plain = F.coalesce(F.try_url_decode("path"), F.col("path"))
    sides = F.concat(F.transform(runs(F.col("host")), lambda x: F.struct(F.lit("").alias("side"), x.alias("name"))), F.transform(runs(plain), lambda x: F.struct(F.lit("/").alias("side"), x.alias("name"))))
    return urls.select("id", "host", "n", F.explode(sides).alias("x")).select("id", "host", "n", "x.side", "x.name")


def _lettered() -> Column:
    return ~F.col("name").rlike(r"(?U)^\p{N}")


def segment(spark: SparkSession, found: DataFrame, words: DataFrame, *, others: bool = False) -> DataFrame:
    """name, words and whole (words cover it) of each distinct name, split by words (word, n).

    The lattice is a join: substrings of SHORTEST to LONGEST characters with the
    word table, however large that is. With others, a name is no word of its own
    split.
    """
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)) + F.count("*") + 1).first()[0]
    unknown = math.log(total) + 4
    found = settle(spark, settle(spark, found.select("name"), "found").withColumn("of", F.monotonically_increasing_id()), "numbered")
    # Stretches first, so that nothing that is exploded by character is long.
    stretch = found.select("of", "name", F.explode(F.sequence(F.lit(0), F.length("name") - 1, F.lit(BLOCK))).alias("from"))
    stretch = stretch.select("of", "from", F.substring("name", F.col("from") + 1, F.lit(BLOCK + LONGEST - 1)).alias("part"), F.length("name").alias("all"))
    starts = stretch.select("of", "from", "part", "all", F.explode(F.sequence(F.lit(1), F.least(F.lit(BLOCK), F.length("part")))).alias("at"))
    room = F.least(F.lit(LONGEST), F.length("part") - F.col("at") + 1)
    subs = starts.where(room >= SHORTEST).select("of", "from", "part", "all", "at", F.explode(F.sequence(F.lit(SHORTEST), room)).alias("width"))
    if others:
        subs = subs.where("width < all")
    subs = subs.select("of", (F.col("from") + F.col("at") + F.col("width") - 1).alias("stop"), "width", F.substring("part", F.col("at"), F.col("width")).alias("word"))
    met = subs.join(words.select("word", F.col("n").alias("k")), "word")
    cost = -F.log((F.col("k") + 1) / F.lit(float(total)))
    edges = met.groupBy("of").agg(F.collect_list(F.struct("stop", "width", cost.alias("cost"))).alias("edges"))

    @F.pandas_udf("struct<words:array<string>,whole:boolean>")
    def split(each, lattice):
        import pandas as pd

        rows = [best_split(x, [(e["stop"], e["width"], e["cost"]) for e in ([] if k is None else k)], unknown) for x, k in zip(each, lattice)]
        return pd.DataFrame(rows, columns=["words", "whole"])

    done = found.join(edges, "of", "left").select("name", split("name", "edges").alias("s"))
    return settle(spark, done.select("name", "s.words", "s.whole"), "segments")


def vocabulary(spark: SparkSession, each: DataFrame) -> DataFrame:
    """word and n: names that several hosts have, over all URLs, and the fixed lists.

    A name that words at least half as frequent spell is a compound and no word, so it does
    not hide from the split.
    """
    # Host and name are counted together first, so a hot host is a row for each of its names.
    pairs = each.where(_lettered()).groupBy("host", "name").agg(F.sum("n").alias("n"))
    counts = pairs.groupBy("name").agg(F.count("*").alias("hosts"), F.sum("n").alias("n"))
    fixed = spark.createDataFrame([(w,) for w in sorted({*UNWANTED, *WANTED, *GENERIC}) if len(w) >= SHORTEST], "word string").withColumn("n", F.lit(1).cast("long"))
    own = counts.where((F.col("hosts") >= SPREAD) & F.length("name").between(SHORTEST, LONGEST)).select(F.col("name").alias("word"), "n")
    words = settle(spark, own.unionByName(fixed).groupBy("word").agg(F.sum("n").alias("n")), "words")
    cut = segment(spark, words.select(F.col("word").alias("name")), words, others=True).where("whole and size(words) > 1")
    parts = cut.select("name", F.explode("words").alias("word")).join(words, "word").groupBy("name").agg(F.min("n").alias("least"))
    compound = parts.join(words, parts["name"] == words["word"]).where(2 * F.col("least") >= F.col("n")).select("name")
    return settle(spark, words.join(compound, words["word"] == compound["name"], "left_anti"), "vocabulary")


def tokens(spark: SparkSession, urls: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """id and token of each word of each distinct URL, those of the path with a slash before them.

    Digits count by their number, up to four. Words that every URL has are left
    out, and so are those that rules name: they tell what a rule says already.
    """
    each = settle(spark, names(urls), "names")
    split = segment(spark, each.where(_lettered()).select("name").distinct(), vocabulary(spark, each))
    digits = F.array(F.concat(F.lit("#"), F.least(F.length("name"), F.lit(4)).cast("string")))
    both = each.join(split.select("name", "words"), "name", "left").withColumn("words", F.when(_lettered(), F.col("words")).otherwise(digits))
    named = {w for _, h, p in rules for w in re.findall(r"\w+", f"{h} {p}".lower())}
    out = both.select("id", "side", F.explode("words").alias("word")).where(~F.col("word").isin(*sorted(GENERIC | named)))
    return settle(spark, out.select("id", F.concat("side", "word").alias("token")), "tokens")


def _labelled(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    verdict = rule(F.col("host"), F.col("path"), rules)[1]
    return urls.select("id", "host", "path", "n", verdict.alias("label")).where("label is not null")


def fit_bayes(spark: SparkSession, found: DataFrame, labelled: DataFrame) -> DataFrame:
    """token and odds (above 0: block): multinomial naive Bayes with add-one smoothing, both classes equally likely before.

    Counts are those of all labelled URLs. To what was learned words of the fixed
    lists add their prior odds; tokens of neither have no odds.
    """
    rows = found.join(labelled.select("id", "n", "label"), "id").select("token", *[F.when(F.col("label") == v, F.col("n")).otherwise(0).alias(v) for v in ("block", "allow")])
    counts = settle(spark, rows.groupBy("token").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")), "counts")
    block, allow, size = counts.agg(F.coalesce(F.sum("block"), F.lit(0)), F.coalesce(F.sum("allow"), F.lit(0)), F.count("*")).first()
    share = lambda c, whole: F.log((F.col(c) + 1) / float(whole + size + 1))
    learned = counts.select("token", (share("block", block) - share("allow", allow)).alias("odds"))
    prior = [(side + w, sign * math.log(PRIOR)) for sign, fixed in ((1, UNWANTED), (-1, WANTED)) for w in fixed for side in ("", "/")]
    return learned.unionByName(spark.createDataFrame(prior, "token string, odds double")).groupBy("token").agg(F.sum("odds").alias("odds"))


def scores(found: DataFrame, odds: DataFrame) -> DataFrame:
    """id, score and words of each distinct URL with words: the sum of its tokens' odds.

    Each token's odds are there SALT times, so a token that most URLs have is
    dealt over as many tasks.
    """
    spread = odds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    met = found.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")).join(spread, ["token", "salt"], "left")
    return met.groupBy("id").agg(F.coalesce(F.round(F.sum("odds"), 9), F.lit(0.0)).alias("score"), F.array_sort(F.collect_list("token")).alias("words"))


def judge(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score and words of each row of pages.

    The rule's verdict stands where one fits; elsewhere a score (log odds) of
    LEAST or more blocks. The odds are learned from the URLs that rules judge, the only
    labels there are. Null urls and urls without :// have an empty host and path,
    no words, score 0 and are allowed. Repeated rows each get a row; an empty
    table gives none; only page_id and url are read.
    """
    rows = _urls(pages)
    urls = distinct_urls(spark, rows)
    found = tokens(spark, urls, rules)
    known = scores(found, fit_bayes(spark, found, _labelled(urls, rules)))
    judged = settle(spark, urls.join(known, "id", "left").select("host", "path", "score", "words"), "judged")
    done = rows.join(judged, ["host", "path"])
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    score = F.coalesce("score", F.lit(0.0))
    own = F.when(score >= LEAST, "block").otherwise("allow")
    return done.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), score.alias("score"), F.coalesce("words", F.array().cast("array<string>")).alias("words"))


def agreement(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> tuple[int, int]:
    """How many distinct labelled URLs are held out, and for how many of them what was learned from the others agrees."""
    urls = distinct_urls(spark, _urls(pages))
    found = tokens(spark, urls, rules)
    held = F.pmod(F.xxhash64("host", "path"), F.lit(FOLDS)) == 0
    labelled = _labelled(urls, rules)
    known = scores(found, fit_bayes(spark, found, labelled.where(~held)))
    tested = labelled.where(held).join(known, "id", "left")
    says = F.when(F.coalesce("score", F.lit(0.0)) >= LEAST, "block").otherwise("allow")
    return tuple(tested.agg(F.count("*"), F.count_if(says == F.col("label"))).first())
