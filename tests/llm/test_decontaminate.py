import hashlib
import re

from llm_texts import sentence
from inkloom.llm import decontaminate as D


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for name, item in items:
        v = words(item)
        if not v:
            continue
        k = min(window, len(v))
        grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)}
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in grams:
                found |= {str(name)} if name is not None else set()
                hit.update(range(i, i + k))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_equals_brute_force(spark, make, rng):
    few = ["a", "b", "Ünd", "c1", "d"]
    items = [(i, sentence(rng, n, few)) for i, n in enumerate([1, 3, 7, 9, 10, 11, 14, 30, 60, 9])] + [(77, ""), (78, None), (None, "a b"), (5, "a b c1 d a b c1 d a b c1 d")]
    docs = []
    for i in range(120):
        text = sentence(rng, rng.randrange(40), few if i % 2 else None)
        if i % 3 == 0:
            v = items[rng.randrange(10)][1].upper().split(" ")
            at = rng.randrange(len(v))
            text += ".\n" + "; ".join(v[at : at + rng.randrange(1, 20)]) + "! end"
        docs.append((i, text, "s"))
    docs += [(200, None, None), (201, "", None), (None, items[7][1], None), (202, items[7][1], "x"), (202, items[7][1], "x")]
    table = spark.createDataFrame(items, "item_id long, text string")
    out = D.scan(spark, make(docs), table).collect()
    want = sorted((repr(i), *brute(t, items)) for i, t, _ in docs)
    assert sorted((repr(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out) == want
    assert any(w[5] for w in want) and not all(w[5] for w in want)


def test_blocks_give_the_same(spark, make, rng, monkeypatch):
    items = [(i, sentence(rng, 30)) for i in range(12)]
    docs = make([(i, sentence(rng, 20) + " " + items[i][1], "s") for i in range(12)])
    table = spark.createDataFrame(items, "item_id long, text string")
    one = D.scan(spark, docs, table).orderBy("doc_id").collect()
    monkeypatch.setattr(D, "BLOCK_WORDS", 50)
    assert D.scan(spark, docs, table).orderBy("doc_id").collect() == one
    a = sorted(map(tuple, D.decontaminate(spark, docs, table, coverage=0.5).collect()))
    monkeypatch.setattr(D, "BLOCK_WORDS", 200_000)
    assert sorted(map(tuple, D.decontaminate(spark, docs, table, coverage=0.5).collect())) == a


def test_a_text_is_scanned_once(spark, make):
    table = spark.createDataFrame([(1, "q w e")], "item_id long, text string")
    plan = D.decontaminate(spark, make([(1, "a b", "s")]), table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_removal(spark, make, rng):
    passage = sentence(rng, 25)
    long = sentence(rng, 80)
    docs = make([(1, f"Start of some longer text here, as it were. {passage}. The end.", "s"), (2, long, "s"), (3, passage, "s"), (4, None, "s"), (5, "", "s")])
    table = spark.createDataFrame([(1, passage)], "item_id long, text string")
    out = {r.doc_id: r for r in D.decontaminate(spark, docs, table).collect()}
    assert out[1].text == "Start of some longer text here, as it were. . The end." and out[1].n_chars == len(out[1].text)
    assert out[2].text == long and 3 not in out and out[4].text is None and out[5].text == ""
    cleaned = D.scan(spark, docs, table, cleaned=True).where("doc_id = 1").first()
    (a, b), raw = cleaned.spans[0], f"Start of some longer text here, as it were. {passage}. The end.".encode()
    assert raw[a:b].decode() == passage and cleaned.text == "Start of some longer text here, as it were. . The end."


def test_empty_tables(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.scan(spark, make([(1, "a b", "s")]), none).first().n_hit == 0
    assert D.scan(spark, make([]), none).count() == 0


def test_very_long_text(spark, make):
    out = D.scan(spark, make([(1, "x " * 400_000 + "q w e", "s")]), spark.createDataFrame([(1, "q w e")], "item_id long, text string")).first()
    assert (out.n_words, out.n_hit) == (400_003, 3)
