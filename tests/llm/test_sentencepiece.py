import os

import pytest

from llm_texts import sentence
from inkloom.llm import sentencepiece_lattice as L

pytestmark = pytest.mark.skipif(not os.path.exists(L.MODEL), reason="the vocabulary is not here")


@pytest.fixture(scope="module")
def pieces():
    return L.load()


def best(text, pieces):
    """Score of the best path, and the ids of the path that our rule for ties picks."""
    score = dict(zip(pieces.names, zip(pieces.scores, pieces.ids)))
    least = min(pieces.scores) - L.UNKNOWN
    paths = [(0.0, [])]
    for stop in range(1, len(text) + 1):
        ways = []
        for width in range(min(stop, pieces.longest), 0, -1):
            part = text[stop - width : stop]
            if part in score:
                ways.append((paths[stop - width][0] + score[part][0], width, [score[part][1]]))
            elif width == 1:
                ways.append((paths[stop - 1][0] + least, 1, [pieces.bytes_[b] for b in part.encode()]))
        top = max(ways, key=lambda w: (w[0], w[1]))
        paths.append((top[0], paths[stop - top[1]][1] + top[2]))
    return paths[-1]


TEXTS = ["Hello world", "  two  blanks and  more ", "tab\tline\nend\r\n", "ünïcode “quotes” – 日本語テキスト 😀👍🏽", "a▁b", "1234567 3.14 x2y", "", None, "▁", " ", "\x00\x01", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "don't http://x.y/z?q=1&r=2 ###$$$"]


def test_equals_brute_force(spark, make, pieces, rng):
    texts = TEXTS + [sentence(rng, 30) for _ in range(20)] + ["".join(rng.choice("theand ▁é.\n") for _ in range(60)) for _ in range(30)]
    out = {r.doc_id: r for r in L.encode(spark, make([(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        assert out[i].ids == best(L.escaped(t or "", pieces), pieces)[1]
        assert out[i].n_pieces == len(out[i].ids)
        assert out[i].exact == (L.decode(out[i].ids, pieces) == (t or "")) == ("▁" not in (t or ""))


def test_library_finds_the_same_best_path(pieces, rng):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(L.MODEL, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    score = dict(zip(pieces.ids, pieces.scores))
    for _ in range(100):
        text = sentence(rng, 6)
        ids = library.nbest_encode_as_ids(text, 1)[0]
        assert sum(score[i] for i in ids) == best(L.escaped(text, pieces), pieces)[0]


def test_words_beyond_the_head_are_joined(spark, make, rng):
    docs = make([(i, sentence(rng, 12) + f" rare{i}word\n'q'", "s") for i in range(40)] + [(1, "x  y", "s"), (1, "x  y", "s"), (None, None, None)])
    a = sorted(map(repr, L.encode(spark, docs).collect()))
    assert sorted(map(repr, L.encode(spark, docs, head=7).collect())) == a


def test_decoding(spark, make):
    out = L.encode(spark, make([(i, t, "s") for i, t in enumerate(TEXTS)]))
    back = {r.doc_id: r.text for r in L.decoded(out).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(TEXTS) if t not in ("▁",))


def test_long_word_and_empty_table(spark, make, pieces):
    word = "abcdefghij" * 2000
    r = L.encode(spark, make([(1, word, "s")])).first()
    assert r.exact and r.ids == best(L.escaped(word, pieces), pieces)[1]
    assert L.encode(spark, make([])).count() == 0


def test_long_words_take_time_in_proportion(spark, make, pieces, rng):
    import time

    def seconds(n):
        word = "".join(rng.choice("etaoinshrdlu") for _ in range(n))
        began = time.time()
        assert L.encode(spark, make([(1, word, "s")])).first().exact
        return time.time() - began

    seconds(500)
    assert seconds(20_000) < 4 * seconds(5_000)


def test_dropped_pieces_are_on_no_best_path(pieces, rng):
    kept = L.useful(pieces)
    assert len(kept) < len(pieces.names) and all(n in kept for n in pieces.names if len(n) == 1)
    score = dict(zip(pieces.names, pieces.scores))
    for name in rng.sample(sorted(set(score) - set(kept)), 200):
        least = min(pieces.scores) - L.UNKNOWN
        top = [0.0]
        for stop in range(1, len(name) + 1):
            top.append(max(top[i] + score.get(name[i:stop], least if stop - i == 1 else float("-inf")) for i in range(stop) if stop - i < len(name)))
        assert top[-1] > score[name]
