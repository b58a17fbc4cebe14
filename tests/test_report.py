import random

from pyspark.sql import functions as F

from inkloom.operators import report as R
from inkloom.operators import samples as S


def test_recall_and_false_positives(spark):
    sample = spark.createDataFrame([("f", 1, "use -f with --file and -f"), ("f", 2, "a script-file and x y|z"), ("g", 1, "plain")], "file string, line_no int, text string")
    notes = spark.createDataFrame([("f", 1, "-f"), ("f", 2, "x y|z"), ("g", 1, "plain"), ("g", 9, "gone"), ("f", 1, "absent")], "file string, line_no int, token string")
    got = {(r.file, r.line_no, r.token): r.verdict for r in R.recall(sample, notes).collect()}
    assert got == {("f", 1, "-f"): "covered", ("f", 2, "x y|z"): "partial", ("g", 1, "plain"): "missing", ("g", 9, "gone"): "orphan", ("f", 1, "absent"): "missing"}
    assert [tuple(r) for r in R.false_positives(sample, notes).collect()] == [("f", 1, "--file")]


def test_order_statistics(spark):
    rng = random.Random(1)
    rows = [(g, rng.randrange(20)) for g in "abc" for _ in range(rng.randrange(1, 60))]
    df = spark.createDataFrame(rows, "g string, v int")
    for r in R.upper_median(df, ["g"], "v").collect():
        values = sorted(v for g, v in rows if g == r.g)
        assert (r.n, r.median, r.most) == (len(values), values[len(values) // 2], values[-1])
    for r in R.lower_percentiles(df, ["g"], "v", {"p": 0.9}).collect():
        values = sorted(v for g, v in rows if g == r.g)
        assert r.p == values[int(0.9 * (len(values) - 1))]


def test_samples(spark):
    for n in (1, 3, 8, 9, 17, 100):
        df = spark.createDataFrame([("g", i) for i in range(n)], "g string, i int")
        got = sorted(r.i for r in S.spread(df, ["g"], ["i"], 8).collect())
        assert got == (list(range(n)) if n <= 8 else [int(k * n / 8) for k in range(8)])
    df = spark.createDataFrame([(i,) for i in range(95)], "i int")
    assert sorted(r.i for r in S.every_nth(df, ["i"]).collect()) == list(range(0, 90, 3))
    lines = spark.createDataFrame([("f", i, f"use --flag number {i}" if i % 2 else f"a long plain sentence of words {i}") for i in range(40)], "file string, line_no int, text string")
    assert S.coverage_sample(lines).count() == 10


def test_ratios_and_drift(spark):
    rows = spark.createDataFrame([("one two three four", "um dois tres", True), ("One. Two.", "Um dois.", True), ("a b c d", "x", False)], "source string, output string, translated boolean")
    assert [r.ratio for r in R.content_ratio(rows).collect()] == [0.75]
    assert tuple(R.sentence_drift(rows).first()) == (1, 1, 1.0)
    compared = rows.withColumn("numbers", F.array().cast("array<int>"))
    assert tuple(R.rule_comparison(compared).first()) == (2, 1, 1)
    assert R.size_histogram(spark.createDataFrame([(0,), (1,), (10,), (11,), (900,)], "size int")).count() == 3


def test_acceptance_and_reasons(spark):
    rows = [("a `x`", ("b `x`", True, None)), ("a", ("a", False, "oov")), ("c `y` d", ("c `y` d", False, "oov")), ("e. f", ("g. f", True, "1 of 2")), ("lit", None)]
    df = spark.createDataFrame(rows, "text string, outcome struct<text:string,translated:boolean,reason:string>")
    r = R.acceptance(df).first()
    assert (r.n, r.accepted, r.rejected, r.recovered, r.lost, r.masked, r.masked_lost) == (4, 1, 3, 1, 2, 2, 1)
    assert (r.accepted_share, r.lost_share, r.masked_share) == (0.25, 0.5, 0.5)
    assert [tuple(x) for x in R.top_reasons(df, 1).collect()] == [("oov", 2)]
    assert R.acceptance(df.limit(0)).first().masked_share == 0.0


def test_new_rules(spark):
    rows = [("One. Two.", "Um. Dois.", []), ("One. Two.", "Um e dois..", []), ("Pure one", "Puro um", ["%%"]), ("x", "", [])]
    df = spark.createDataFrame(rows, "source string, output string, unknown array<string>").withColumn("numbers", F.array().cast("array<int>"))
    assert tuple(R.rule_comparison(df).first()) == (3, 1, 2)
    assert sorted(tuple(x) for x in R.newly_rejected(df).collect()) == [("sentence count", 1), ("unknown vocabulary", 1)]


def test_side_by_side(spark):
    rows = [("d", i, f"line {i}\nmore", (f"linha {i}", True, None) if i % 2 else ("same", False, "oov")) for i in range(6)]
    df = spark.createDataFrame(rows, "doc string, seg_no int, text string, outcome struct<text:string,translated:boolean,reason:string>")
    out = [r.value for r in S.side_by_side(df, 3).collect()]
    assert len(out) == 3 and out[0] == "## d / 0: kept (oov)\n\n> line 0\n> more\n\n> same"


def test_hot_groups_are_numbered_in_parts(spark):
    rows = [("hot" if i % 3 else f"g{i % 7}", i) for i in range(900)] + [(None, -1)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(8)
    got = {(r.g, r.v): (r["__at"], r["__n"]) for r in S.numbered(df, ["g"], ["v"]).collect()}
    for g in {g for g, _ in rows}:
        values = sorted(v for x, v in rows if x == g)
        assert all(got[g, v] == (k, len(values)) for k, v in enumerate(values))


def test_cold_and_warm(spark, tmp_path):
    from inkloom import Memo
    from inkloom.operators.backend import Identity
    from inkloom.plans.document import chosen_width

    docs = spark.createDataFrame([(1, "This is the one of the things. It is what it is for them.")], "doc_id long, text string")
    cold, warm = R.cold_and_warm(docs, Identity(), Memo(spark, f"{tmp_path}/memo", "identity", 1)).collect()
    assert (cold.run, cold.hits, warm.rate, warm.lookups) == ("cold", 0, 1.0, cold.lookups) and cold.lookups > 0
    assert [chosen_width(w) for w in ("100", "39", "wide", None, 40)] == [100, 80, 80, 80, 40]
