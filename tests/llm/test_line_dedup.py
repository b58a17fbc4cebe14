from pyspark.sql import functions as F

from inkloom.llm import line_dedup as L


def brute(rows, sites):
    seen, keeper = {}, {}
    for i, t, s in rows:
        for x in (t or "").split("\n") if t is not None else []:
            k = x.strip(" ")
            if k:
                seen.setdefault(k, set()).add("" if s is None else "=" + s)
                if i is not None:
                    keeper[k] = min(i, keeper.get(k, i))
    wide = {k for k, v in seen.items() if len(v) >= sites}
    out = []
    for i, t, _ in rows:
        kept, had = [], set()
        for x in [] if t is None else t.split("\n"):
            k = x.strip(" ")
            if k not in wide or keeper.get(k) == i and k not in had:
                kept.append(x)
            had.add(k)
        n = 0 if t is None else len(t.split("\n"))
        out.append((repr(i), None if t is None else "\n".join(kept), n, n - len(kept)))
    return sorted(out, key=repr)


def test_equals_brute_force(spark, make, rng):
    pool = [f"line {k}" for k in range(30)]
    rows = []
    for i in range(300):
        lines = [rng.choice(pool[: 5 + 25 * (i % 2)]) for _ in range(rng.randrange(6))] + [f"own {i}"] * (i % 3)
        rows.append((i + 5, "\n".join(" " * (i % 2) + x for x in lines), f"src{i % (3 if i % 5 else 17)}"))
    rows += [(1, None, "a"), (2, "", "a"), (None, pool[0], None), (None, pool[29] + "\n\n" + pool[0], "z"), (7, pool[0] + "\n" + pool[0], "q"), (7, pool[0], "q")]
    for sites in (2, 5, 10, 17):
        out = L.dedup_lines(spark, make(rows), sites=sites)
        got = sorted(((repr(r.doc_id), r.text, r.n_lines, r.n_removed) for r in out.collect()), key=repr)
        assert got == brute(rows, sites)
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())


def test_near_threshold_is_exact(spark, make):
    rows = [(i, "common", f"s{i}") for i in range(9)] + [(100 + i, "wider", f"s{i}") for i in range(10)]
    found = L.spread(spark, make(rows), sites=10).collect()
    assert [(r.n_sites, r.exact, r.keeper) for r in found] == [(10, True, 100)]
    rows = [(i, "everywhere", f"s{i}") for i in range(60)]
    assert [(r.exact, r.keeper) for r in L.spread(spark, make(rows)).collect()] == [(False, 0)]


def test_passages_of_a_hot_source_go(spark, make, rng):
    passage = " ".join(f"word{k}" for k in range(60))
    rows = [(i, f"own line {i}\n{passage}", "hot" if i % 3 == 0 else f"s{i % 20}") for i in range(20)]
    left = {r.doc_id: r.text for r in L.dedup_lines(spark, make(rows)).collect()}
    assert sum(passage in t for t in left.values()) == 1 and all(t.startswith(f"own line {i}") for i, t in left.items())


def test_clashing_names_and_a_long_text(spark, make):
    lines = [f"shared {k}" for k in range(3000)]
    rows = [(i, "\n".join(lines + [f"own {i}"]), f"s{i}") for i in range(8)]
    docs = make(rows).withColumn("__id", F.lit(7)).withColumn("hit_id", F.lit("a")).withColumn("hit_lines", F.lit("b")).withColumn("__left", F.lit("c"))
    out = L.dedup_lines(spark, docs).collect()
    assert {(r["__id"], r.hit_id, r.hit_lines, r["__left"]) for r in out} == {(7, "a", "b", "c")}
    assert {r.doc_id: r.text for r in out} == {0: rows[0][1], **{i: f"own {i}" for i in range(1, 8)}}


def test_empty(spark, make):
    assert L.dedup_lines(spark, make([])).count() == 0
