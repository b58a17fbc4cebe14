import hashlib
import tarfile
import zlib

from inkloom.llm import media as M


def test_columns_and_shards(spark, make, tmp_path):
    texts = ["abc", "é" * 300, "x" * 576, "x" * 577, "", None, "abc", "y\n" * 200_000]
    docs = make([(i, t, "s") for i, t in enumerate(texts)] + [(None, "abc", None)]).repartition(3)
    out = M.media_columns(spark, docs, f"file://{tmp_path}/media").collect()
    assert len(out) == len(texts) + 1
    by = {r.doc_id: r for r in out}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        data = raw + b"\xff" * ((-len(raw)) % 576 or (576 if not raw else 0))
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
        assert (r.width, r.height, r.depth) == (576, len(data) // 576, 8)
        assert r.media_bytes == r.length
    same = [tuple(r)[2:] for r in out if r.n_bytes == 3]
    assert len(same) == 3 and len(set(same)) == 1 and tuple(by[4])[2:] == tuple(by[5])[2:]
    members = {}
    for p in (tmp_path / "media").iterdir():
        with tarfile.open(p) as t:
            for m in t.getmembers():
                members[(p.name, m.offset_data)] = (m.name, t.extractfile(m).read())
    for r in out:
        name, body = members[(r.shard, r.offset)]
        assert name == f"{r.media_sha256}.png" and hashlib.sha256(body).hexdigest() == r.media_sha256
        assert hashlib.sha256(M.decode(body)).hexdigest() == r.payload_sha256


def test_header_alone_fills_metadata(spark, make, tmp_path):
    root = f"file://{tmp_path}/m"
    found = M.places(M.write_shards(spark, make([(1, "a" * 3000, "s")]), root))
    r = M.metadata(found, root).first()
    assert (r.width, r.height, r.depth) == (576, 6, 8)


def test_damage_is_found(spark, make, tmp_path):
    body = bytearray(M.encode(M.payload(b"text")))
    assert M.decode(bytes(body)) == M.payload(b"text")
    body[45] ^= 1
    try:
        M.decode(bytes(body))
    except ValueError:
        return
    raise AssertionError("damage went unseen")


def test_empty(spark, make, tmp_path):
    assert M.media_columns(spark, make([]), f"file://{tmp_path}/none").count() == 0
