import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", ".."))
import corpus_pipeline as P  # noqa: E402
from inkloom.llm import sentencepiece_lattice  # noqa: E402
from llm_texts import sentence  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.skipif(not os.path.exists(sentencepiece_lattice.MODEL), reason="the vocabulary is not here")
def test_stages(spark, tmp_path, rng):
    words = [f"w{i}a" for i in range(4000)]
    passage, copied = sentence(rng, 20, words), sentence(rng, 120, words)
    texts = {i: sentence(rng, 120, words).capitalize() + "." for i in range(60)}
    texts[100], texts[101] = copied, copied.upper().lower()
    texts[102] = copied.replace(copied.split(" ")[60], "swapped")
    texts[103] = sentence(rng, 60, words) + " " + passage + " " + sentence(rng, 60, words)
    for i in range(12):
        texts[i] += "\nshared line of all sites"
    bad = {200 + i: " ".join(w + "###" for w in sentence(rng, 50, words).split(" ")) for i in range(20)}
    rows = [(i, t, "en", f"src{i}", len(t)) for i, t in (texts | bad).items()]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i in texts | bad], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if k < len(P.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(seen["quality"]) == set(texts)
    lines = seen["line_dedup"]
    assert sum("shared line" in (r.text or "") for r in lines.values()) == 1 and "shared line" in lines[0].text
    assert set(seen["simhash"]) == set(texts) - {101, 102}
    assert passage not in seen["decontamination"][103].text and set(seen["decontamination"]) == set(seen["simhash"])
    assert all(r.exact for r in seen["sentencepiece"].values())
    ran = {r.doc_id: r.ids for r in P.run(spark, str(tmp_path)).collect()}
    assert ran == {i: r.ids for i, r in seen["sentencepiece"].items()}
