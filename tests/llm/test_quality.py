import zlib

import numpy as np

from llm_texts import sentence
from inkloom.llm import quality as Q


def data(rng, n=400):
    rows, labels = [], []
    for i in range(n):
        text = sentence(rng, rng.randrange(5, 80)).capitalize() + "."
        if i % 5 == 0:
            text = " ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in text.split(" "))
        rows.append((i, text, "s"))
        labels.append((i, int(i % 5 != 0), 0))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark, make, rng):
    rows, labels = data(rng)
    out = Q.classify(spark, make(rows), spark.createDataFrame(labels, LABELS)).collect()
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == int(r.doc_id % 5 != 0) for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)


def test_held_out_labels_and_other_columns_play_no_part(spark, make, rng):
    rows, labels = data(rng, 200)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    a = Q.classify(spark, make(rows), spark.createDataFrame(labels, LABELS)).orderBy("doc_id").collect()
    b = Q.classify(spark, make([(i, t, "other") for i, t, _ in rows]), spark.createDataFrame(flipped, LABELS)).orderBy("doc_id").collect()
    assert a == b


def test_edges(spark, make, rng):
    rows, labels = data(rng, 100)
    odd = rows + [(None, None, None), (1000, "", "s"), (1001, "x " * 300_000, "s"), (1, rows[1][1], "s")]
    named = spark.createDataFrame([*labels, (None, 1, 0), (5, None, None), (6, 7, 0), (1, 1, 0)], LABELS)
    out = Q.classify(spark, make(odd), named)
    assert out.count() == 104 and out.where("score is null or predicted is null").count() == 0
    kept = Q.accept(spark, make(odd), named)
    assert kept.columns == make(odd).columns and kept.count() < 104
    none = spark.createDataFrame([], LABELS)
    assert {r.predicted for r in Q.classify(spark, make(rows), none).collect()} == {1}
    assert Q.classify(spark, make([]), named).count() == 0


def test_fit_bound(spark, make, rng):
    rows, labels = data(rng)
    docs, named = make(rows), spark.createDataFrame(labels, LABELS)
    a, b = Q.fit(docs, named, 60), Q.fit(docs, named, 60)
    assert (a.w == b.w).all()


def test_every_labelled_row_counts_in_any_number_of_chunks(spark, make, rng):
    rows, labels = data(rng, 300)
    docs, named = make(rows), spark.createDataFrame(labels, LABELS)
    learned = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5]
    x = np.array([Q.features(rows[i][1].encode()) for i in learned])
    bad = sum(labels[i][1] == 0 for i in learned)
    for size in (1000, 20):
        model = Q.fit(docs, named, size)
        assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, x.std(axis=0) + 1e-6)
        s = np.sort(model.raw(x))
        assert model.at == (s[bad - 1] + s[bad]) / 2 or np.isclose(model.at, (s[bad - 1] + s[bad]) / 2, atol=1e-12)
        assert [(v > model.at) for v in model.raw(x)] == [labels[i][1] == 1 for i in learned]
