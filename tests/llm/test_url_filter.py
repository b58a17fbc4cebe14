import itertools
import math

from inkloom.llm import url_filter as U


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")


def test_parts_and_rules(spark):
    cases = {
        "https://WWW.Example.NET/en/x?y#z": ("www.example.net", "/en/x", "example.net/en/", "allow"),
        "https://example.net/EN/x": ("example.net", "/EN/x", "net/", "block"),
        "http://anexample.net/en/": ("anexample.net", "/en/", "net/", "block"),
        "http://a.example.com/de/": ("a.example.com", "/de/", "example.com/de/", "block"),
        "http://x.org/fr/1": ("x.org", "/fr/1", "org/fr/", "allow"),
        "http://net": ("net", "", None, "allow"),
        "http://q.org?u=http://b.net/": ("q.org", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
        "no-scheme.net/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "https://ÄB.com/\nx": ("Äb.com", "/\nx", None, "allow"),
    }
    out = {r.page_id: r for r in U.judge(spark, pages(spark, list(cases))).collect()}
    for i, want in enumerate(cases.values()):
        assert (out[i].host, out[i].path, out[i].rule, out[i].verdict) == want
    assert U.judge(spark, pages(spark, [])).count() == 0


def test_method_blocks_joined_names(spark):
    urls = [f"http://{n}.com/en/{i}" for i in range(20) for n in ("freecasinobets", "m.cheap-pills", "citylibrary", "localnews", "casino-win")]
    out = U.judge(spark, pages(spark, urls)).collect()
    assert {(r.host, r.verdict) for r in out} == {("freecasinobets.com", "block"), ("m.cheap-pills.com", "block"), ("casino-win.com", "block"), ("citylibrary.com", "allow"), ("localnews.com", "allow")}
    assert all({"free", "casino", "bets"} <= set(r.words) for r in out if r.host.startswith("free"))


def test_a_listed_word_alone_does_not_decide(spark):
    urls = ["http://freelibrary.com/", "http://freebets.com/", "http://casino.edu/research/library"]
    assert [r.verdict for r in U.judge(spark, pages(spark, urls)).orderBy("page_id").collect()] == ["allow", "block", "allow"]


def learned(spark):
    """Names that only rules tell apart: zog and brim on hosts that a rule blocks, plum on allowed ones."""
    bad = [f"http://{w}{i}.net/{v}{i}" for i in range(40) for w, v in (("zogbrim", "zog"), ("brim", "brimzog"))]
    good = [f"http://plum{i}.org/fr/plumfig/{i}" for i in range(12)] + [f"http://fig.plum{i}.org/fr/x" for i in range(12)]
    return bad + good, ["http://zogfig.com/zogbrim", "http://brimzog.io/a", "http://plumfig.com/plum", "http://fig.io/plum"]


def test_verdicts_are_learned_from_rules(spark):
    known, new = learned(spark)
    out = {r.page_id - len(known): (r.verdict, r.rule) for r in U.judge(spark, pages(spark, known + new)).collect() if r.page_id >= len(known)}
    # None of these words is in a fixed list.
    assert [out[i] for i in range(4)] == [("block", None), ("block", None), ("allow", None), ("allow", None)]
    held, right = U.agreement(spark, pages(spark, known))
    assert held > 0 and right == held


def test_scores_equal_a_plain_model(spark):
    known, new = learned(spark)
    urls = U.distinct_urls(spark, U._urls(pages(spark, known + new + known[:5])))
    found = U.tokens(spark, urls)
    n = {r.id: r.n for r in urls.collect()}
    label = {r.id: r.label for r in U._labelled(urls, U.RULES).collect()}
    of = {}
    for r in found.collect():
        of.setdefault(r.id, []).append(r.token)
    counts = {}
    for i, words in of.items():
        for w in words:
            if i in label:
                counts.setdefault(w, [0, 0])[label[i] == "allow"] += n[i]
    size = len(counts) + 1
    whole = [sum(c[k] for c in counts.values()) + size for k in (0, 1)]
    odds = {w: math.log((b + 1) / whole[0]) - math.log((a + 1) / whole[1]) for w, (b, a) in counts.items()}
    for sign, fixed in ((1, U.UNWANTED), (-1, U.WANTED)):
        for w in fixed:
            for form in (w, "/" + w):
                odds[form] = odds.get(form, 0.0) + sign * math.log(U.PRIOR)
    got = {r.id: r.score for r in U.scores(found, U.fit_bayes(spark, found, U._labelled(urls, U.RULES))).collect()}
    assert set(got) == set(of)
    for i, words in of.items():
        assert math.isclose(got[i], sum(odds.get(w, 0.0) for w in words), abs_tol=1e-6)


def test_compounds_are_no_words(spark):
    urls = [f"http://{n}{i}.com/a" for i in range(4) for n in ("red", "blue", "red", "blue")] + [f"http://redblue.{t}/" for t in ("com", "io")]
    each = U.names(U.distinct_urls(spark, U._urls(pages(spark, urls))))
    words = {r.word for r in U.vocabulary(spark, each).collect()}
    assert {"red", "blue"} <= words and "redblue" not in words


def test_viterbi_equals_brute_force(spark, rng):
    counts = {w: rng.randrange(1, 90) for w in ("abc", "bca", "cabx", "abcabc", "xab", "aab")}
    names = sorted({"".join(rng.choice("abcx") for _ in range(rng.randrange(1, 11))) for _ in range(60)} | {"abc" * 40})
    total = sum(counts.values()) + len(counts) + 1
    unknown = math.log(total) + 4
    cost = {w: -math.log((n + 1) / total) for w, n in counts.items()}
    found = spark.createDataFrame([(n,) for n in names], "name string")
    out = {r.name: r for r in U.segment(spark, found, spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert set(out) == set(names)
    for name, r in out.items():
        assert "".join(r.words) == name and r.whole == all(w in cost for w in r.words)
        if len(name) <= 10:
            price = lambda parts: sum(cost.get(p, unknown if len(p) == 1 else math.inf) for p in parts)
            splits = [[name[i:j] for i, j in zip((0, *cut), (*cut, len(name)))] for k in range(len(name)) for cut in itertools.combinations(range(1, len(name)), k)]
            assert math.isclose(sum(cost.get(p, unknown * len(p)) for p in r.words), min(map(price, splits)))


def test_long_url(spark):
    url = "http://" + "ab" * 5000 + ".com/" + "%E4%BD%A0" * 2000
    r = U.judge(spark, pages(spark, [url, "http://xn--bcher-kva.example/casino"])).orderBy("page_id").collect()
    assert r[0].verdict == "allow" and r[1].verdict == "block" and "xn" in r[1].words
