import itertools
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from llm_texts import sentence
from inkloom.llm import simhash as S


def brute_fingerprint(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    parts = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            root[find(i)] = find(j)
    low = {}
    for i, (k, _, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(k, low.get(find(i), k))
    return sorted((repr(k), f"{fps[i]:016x}", low.get(find(i))) for i, (k, _, _) in enumerate(rows))


def corpus(rng):
    base = [sentence(rng, n) for n in (400, 60, 30, 9, 4, 2)]
    rows = []
    for k in range(150):
        w = base[k % len(base)].split(" ")
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice(["neu", "alt"])
        rows.append((k + 10, "\t ".join(w) if k % 4 else "\n".join(w).upper(), "s"))
    return rows + [(3, None, None), (4, "", None), (5, " \n", "s"), (None, base[0], "s"), (None, "lone words of nobody here", "s"), (10, rows[0][1], "s"), (7, "é É", "s")]


def test_equals_brute_force(spark, make, rng):
    rows = corpus(rng)
    out = S.near_duplicates(spark, make(rows)).collect()
    assert sorted((repr(r.doc_id), r.fingerprint, r.component_id) for r in out) == brute_components(rows)


def test_cut_tries_give_the_same(spark, make, rng, monkeypatch):
    rows = corpus(rng)
    monkeypatch.setattr(S, "TRIE_ROWS", 8)
    monkeypatch.setattr(S, "CUTS", 2)
    out = S.near_duplicates(spark, make(rows)).collect()
    assert sorted((repr(r.doc_id), r.fingerprint, r.component_id) for r in out) == brute_components(rows)


def test_trie_finds_every_pair():
    gen = np.random.default_rng(3)
    centre = gen.integers(0, 2**20, 12, dtype=np.uint64)
    codes = np.concatenate([centre ^ (np.uint64(1) << gen.integers(0, 20, 12, dtype=np.uint64)) for _ in range(40)] + [centre] * 3)
    codes = np.sort(codes)
    got = set()
    for i, j in S.trie_pairs(codes, 20, 2):
        got |= {(a, b) for a, b in zip(i.tolist(), j.tolist()) if int(codes[a] ^ codes[b]).bit_count() <= 2}
    want = {(a, b) for a, b in itertools.combinations(range(len(codes)), 2) if int(codes[a] ^ codes[b]).bit_count() <= 2}
    assert got == want


def test_chain_is_one_component(spark):
    from inkloom.llm._shared import components

    links = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(5, 5), (9, 200)], "a long, b long")
    out = {r.node: r.root for r in components(spark, links).collect()}
    assert all(out[i] == 100 for i in range(101, 161)) and out[200] == 9 and 5 not in out


def test_representatives(spark, make, rng):
    long = sentence(rng, 400, [f"w{i}" for i in range(3000)])
    w = long.split(" ")
    near = [" ".join(w[:k] + ["changed"] + w[k + 1 :]) for k in (50, 150, 250, 350)]
    far = [sentence(rng, 400, [f"v{i}" for i in range(3000)]) for _ in range(20)]
    rows = [(5, long, "s"), (3, long.upper(), "s"), *((10 + i, t, "s") for i, t in enumerate(near)), *((30 + i, t, "s") for i, t in enumerate(far))]
    rows += [(60, None, "s"), (61, "", "s"), (62, "...", "s"), (70, "a b", "s"), (70, "a b", "s"), (None, far[0], "s"), (None, "only this one", "s")]
    docs = make(rows)
    out = S.representatives(spark, docs)
    assert out.columns == docs.columns
    kept = sorted(repr(r.doc_id) for r in out.collect())
    assert kept == sorted(["3", "60", "70", "None", *(str(30 + i) for i in range(20))])
    assert S.representatives(spark, make([])).count() == 0


def brute_kept(texts):
    """Positions of the first texts of the components of Jaccard similarity 0.8 over five-word shingles."""
    sets = [set(S.shingles(S.STAGE.split(t.encode()), 5)) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return [i for i in range(len(texts)) if find(i) == i]


def edited(rng, words, count):
    w = list(words)
    for k in rng.sample(range(len(w)), count):
        w[k] = f"new{rng.randrange(10**9)}"
    return " ".join(w)


def test_dense_families_equal_brute_force(spark, make, rng):
    texts = []
    for low, high in ((3, 3), (1, 4)):
        base = sentence(rng, 200, [f"w{i}" for i in range(3000)]).split(" ")
        texts += [edited(rng, base, rng.randint(low, high)) for _ in range(100)]
    kept = S.representatives(spark, make([(i, t, "s") for i, t in enumerate(texts)])).collect()
    assert sorted(r.doc_id for r in kept) == brute_kept(texts)


def test_frequent_shingles_in_blocks_equal_brute_force(spark, make, rng, monkeypatch):
    monkeypatch.setattr(S, "PAIRED", 4)
    monkeypatch.setattr(S, "BLOCK_TEXTS", 7)
    base = sentence(rng, 60, [f"w{i}" for i in range(3000)]).split(" ")
    texts = [edited(rng, base, rng.randint(0, 3)) for _ in range(60)]
    docs = make([(i, t, "s") for i, t in enumerate(texts)]).withColumn("near_row", F.lit("mine"))
    kept = S.representatives(spark, docs).collect()
    assert sorted(r.doc_id for r in kept) == brute_kept(texts) and {r.near_row for r in kept} == {"mine"}


def test_recall_of_tries_at_known_similarity(spark, rng):
    """Most pairs of 0.95 come from the tries; what they miss is found exactly (tests above)."""
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for k in range(60):
        base = sentence(rng, 400, vocabulary).split(" ")
        rows += [(2 * k, " ".join(base)), (2 * k + 1, edited(rng, base, 2))]
    nodes = S.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string"), S.STAGE).select(F.col("doc_id").alias("id"), "fp")
    found = {(min(r.a, r.b), max(r.a, r.b)) for r in S.links(spark, nodes, S.STAGE).collect()}
    assert len(found & {(2 * k, 2 * k + 1) for k in range(60)}) >= 45


def test_short_texts_at_the_limit_are_all_found(spark, make, rng, monkeypatch):
    monkeypatch.setattr(S, "SAMPLE", 1)
    monkeypatch.setattr(S, "SEEN", 2)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [sentence(rng, 8, vocabulary) for _ in range(60)]
    texts += [f"{t} more" for t in texts]  # 4 of 5 shingles shared
    kept = S.representatives(spark, make([(i, t, "s") for i, t in enumerate(texts)])).collect()
    assert sorted(r.doc_id for r in kept) == brute_kept(texts) == list(range(60))


def test_texts_that_share_a_frequent_line_alone_bring_no_sets(spark, make, rng, monkeypatch):
    monkeypatch.setattr(S, "PAIRED", 4)
    vocabulary = [f"w{i}" for i in range(3000)]
    line = sentence(rng, 12, vocabulary)
    texts = [f"{line} {sentence(rng, 60, vocabulary)}" for _ in range(30)]
    asked, real = [], S._shingled
    monkeypatch.setattr(S, "_shingled", lambda docs, scheme: asked.append(docs.count()) or real(docs, scheme))
    kept = S.representatives(spark, make([(i, t, "s") for i, t in enumerate(texts)])).collect()
    assert sorted(r.doc_id for r in kept) == brute_kept(texts) and sum(asked) == 0
