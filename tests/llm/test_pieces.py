"""SentencePiece search against a whole-text search, the library's unigram search, and round trips."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.llm.pieces import (
    MARK, NONE, PieceModel, decode_documents, default_model, encode_documents, entry_vectors, exit_states, joined_origins, marked, max_plus, product, scored_model)
from tests.llm.conftest import BASE, LONG, documents


@pytest.fixture(scope="module")
def model():
    return PieceModel(scored_model(default_model()))


def whole(model, text):
    s = marked(text)
    best, back = model.search(s, len(s), [0])
    return best[-1], model.trace(s, back, len(s))[1]


def texts():
    r = random.Random(3)
    out = [x or "" for _, x, *_ in BASE] + ["a", " ", "   ", "a  b   c", "\n\n", "tab\there\r\n", "x" * 300, MARK, f"a{MARK}b", "----------------=====", "é漢\U0001f600"]
    for _ in range(60):
        out.append("".join(r.choice(["the ", "ing", " ", "  ", "\n", "q", "zz", "the", "ß", "漢", "  a", "=", "--"]) for _ in range(r.randrange(60))))
    return out


def encoded(model, texts):
    scores, ids = model.encode(texts)
    return [(s, x.tolist()) for s, x in zip(scores, ids, strict=True)]


def test_units_give_the_whole_texts_best_path(model):
    assert encoded(model, texts()) == [whole(model, t) for t in texts()]


def test_forgetting_units_changes_nothing(model, monkeypatch):
    monkeypatch.setattr("siftwork.llm.pieces._UNITS_KEPT", 50)
    small = PieceModel(scored_model(default_model()))
    assert [encoded(small, [t])[0] for t in texts()] == [whole(model, t) for t in texts()]


def test_same_ids_as_the_librarys_best_path(model):
    """The library's exact search (its n-best list) on whole short texts of the same scored model."""
    r = random.Random(4)
    for _ in range(300):
        t = " ".join("".join(r.choice(["the", "ing", "s", "qu", "er", "a", "on", "xy", "ß", "é"]) for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(1, 12)))
        assert encoded(model, [t])[0][1] == model.sp.nbest_encode_as_ids(marked(t), 1)[0]


def test_a_unigram_models_own_scores_are_used():
    from sentencepiece import sentencepiece_model_pb2 as pb
    proto = pb.ModelProto()
    proto.ParseFromString(default_model())
    proto.trainer_spec.model_type = 1
    for k, p in enumerate(proto.pieces):
        if p.type == 1:
            p.score = -5 - (k * 37 % 101) / 16
    model = PieceModel(scored_model(proto.SerializeToString()))
    assert model.score_of[300] == -1024 * 5 - 64 * (300 * 37 % 101)
    t = "whatever text there is"
    assert encoded(model, [t])[0] == whole(model, t)


def test_decoding_gives_the_text_back(model):
    for t, (_, ids) in zip(texts(), encoded(model, texts()), strict=True):
        assert model.decode(ids) == t.replace(MARK, " ")


def test_max_plus_product_is_associative():
    r = np.random.default_rng(1)
    a, b, c = (np.where(r.random((5, 5)) < 0.3, NONE, r.integers(-1000, 0, (5, 5))) for _ in range(3))
    assert (max_plus(max_plus(a, b), c) == max_plus(a, max_plus(b, c))).all()


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 200])
def test_scan_in_blocks_equals_the_scan_in_order(n):
    r = np.random.default_rng(n)
    m = np.where(r.random((n, 4, 4)) < 0.2, NONE, r.integers(-1000, 0, (n, 4, 4)))
    blocks = [m[k:k + 64] for k in range(0, n, 64)]
    starts = entry_vectors(np.stack([product(b) for b in blocks]))
    assert (np.concatenate([entry_vectors(b, s) for b, s in zip(blocks, starts, strict=True)]) == entry_vectors(m)).all()
    came = r.integers(0, 4, (n, 4))
    came[:, 3] = -1
    came[came == 3] = 0  # state 3 has no path, and no path comes from it
    blocks = [came[k:k + 64] for k in range(0, n, 64)]
    leaves = exit_states(np.stack([joined_origins(b) for b in blocks]))
    assert [x for b, leave in zip(blocks, leaves, strict=True) for x in exit_states(b, leave)] == exit_states(came)


def test_a_documents_chunks_are_combined_in_several_blocks(spark, model, monkeypatch):
    """Three chunks a block: a long text has many blocks, which meet as products only."""
    monkeypatch.setattr("siftwork.llm.pieces._BLOCK", 3)
    text = LONG[:3000]
    got = encode_documents(documents(spark, [(1, text, "en", "a"), (2, text[:150], "en", "a")]), giant_chars=100, chunk_chars=40).collect()
    assert sorted((r.doc_id, r.score, list(r.ids)) for r in got) == [(1, *whole(model, text)), (2, *whole(model, text[:150]))]


@pytest.mark.parametrize("chunk", [16, 17, 40, 1000])
def test_chunked_documents_equal_the_whole_search(spark, model, chunk):
    r = random.Random(chunk)
    giants = [LONG[:4000], "x" * 700, "ab" * 500 + "\n" + "the" * 400, " " * 333, "".join(r.choice(["the", "ing", " ", "q", "\n", "漢", "=="]) for _ in range(900)),
              "".join(r.choice("abcdefgh") for _ in range(1500))]
    docs = documents(spark, [(k, t, "en", "a") for k, t in enumerate(giants)] + [(90, "short", "en", "a"), (91, None, "en", "a"), (0, giants[0], "en", "a")])
    got = sorted((r.doc_id, r.score, list(r.ids)) for r in encode_documents(docs, giant_chars=100, chunk_chars=chunk).collect())
    want = sorted((k, *whole(model, t)) for k, t in [*enumerate(giants), (90, "short"), (91, ""), (0, giants[0])])
    assert got == want


def test_tables(edge, empty, model):
    encoded = encode_documents(edge, carry={"doc_id": edge["doc_id"], "score2": edge["score"]}, giant_chars=2000, chunk_chars=500)
    assert encoded.columns == ["doc_id", "score2", "score", "ids", "n_chunks"]
    got = decode_documents(encoded).select("doc_id", "decoded", "score2").collect()
    assert sorted(((r.doc_id, r.decoded) for r in got), key=str) == sorted(((r[0], r[1] or "") for r in BASE), key=str)
    assert {r.score2 for r in got} == {"clash"}
    assert encode_documents(empty).collect() == []
    assert encode_documents(edge, giant_chars=2000).filter(F.col("n_chunks") > 1).count() == 3


def test_digests_of_decoded_texts(spark, model, monkeypatch):
    """Every row's digest is that of its text, whether it was encoded whole or in chunks, in one slice of ids or many."""
    monkeypatch.setattr("siftwork.llm.pieces._DECODED_AT_ONCE", 7)
    texts = [None, "", " ", "  two  spaces ", LONG[:3000], "\u2581mark \u2581", "漢字\n\t🙂 é\u0000", "x" * 700]
    got = encode_documents(documents(spark, [(k, t, "en", "a") for k, t in enumerate(texts)]), giant_chars=100, chunk_chars=40, decode=True)
    assert got.columns == ["doc_id", "score", "ids", "n_chunks", "decoded_crc32"]
    want = {k: zlib.crc32((t or "").replace("\u2581", " ").encode()) for k, t in enumerate(texts)}
    assert {r.doc_id: r.decoded_crc32 for r in got.collect()} == want
    ids = np.array(model.encode(["some words here"])[1][0])
    assert model.decoded_crc32(ids[:-1]) != model.decoded_crc32(ids) == zlib.crc32(b"some words here")
