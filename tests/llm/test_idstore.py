"""Token store: ids against the tokenizer on whole texts, the hash, the files, keyed access."""

import json
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwork.llm import idstore
from siftwork.llm.common import work_dir
from siftwork.llm.idstore import (
    IdStore, IndexPart, _index_bytes, _Words, _fingerprint, _RECORD, build_mph, default_tokenizer, document_keys, encode_texts, find_keys, key_hashes, mph_slots, read_ids, write_store)
from tests.llm.conftest import BASE, documents


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_buffer(default_tokenizer())


@pytest.fixture(scope="module")
def known():
    return _Words(default_tokenizer(), 2)


def ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


PARTS = ["The", "the", "don't", "it's.", "X!", "!!", "a.b", "É", "é", "E\u0301.", "H\u0331", "\u0331.", "İ", "Σ", "ΑΣ", "ß", "漢字.", "12", "1.", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>.",
         "\xa0", "a\xa0b", "\u2028", " ", "\n", "\t", "  ", "\x1c", "'S", "'s", "..", "?", "a,", ",a", "\U0001f600", "ab\x00", "_", "A_.", "ǅ", "ﬁ", "①."]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12))
def test_word_by_word_equals_the_whole_text(tokenizer, known, parts):
    text = "".join(parts)
    assert np.frombuffer(encode_texts([text], known, 2)[0], "<u2").tolist() == ids(tokenizer, text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text(tokenizer, known, text):
    text = text.encode("utf-8", "ignore").decode("utf-8")
    assert np.frombuffer(encode_texts([text], known, 2)[0], "<u2").tolist() == ids(tokenizer, text)


def test_forgetting_words_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(idstore, "_WORDS_KEPT", 30)
    words = _Words(default_tokenizer(), 2)
    texts = [f"word{k} again {k % 7} and. more{k % 3}" for k in range(60)]
    out = [x for k in range(0, 60, 5) for x in encode_texts(texts[k:k + 5], words, 2)]
    assert [np.frombuffer(x, "<u2").tolist() for x in out] == [ids(tokenizer, t) for t in texts]


def test_the_word_table_is_packed():
    """No Python object stays for a remembered word: 60 bytes each are enough."""
    import tracemalloc
    words, n = _Words(default_tokenizer(), 2), 60_000
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    for k in range(0, n, 6_000):
        encode_texts([" ".join(f"word{j}x" for j in range(k, k + 6_000))], words, 2)
    kept = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert len(words) == n and kept < 60 * n


def test_long_words_are_forgotten_by_their_bytes(tokenizer, monkeypatch):
    monkeypatch.setattr(idstore, "_WORD_BYTES", 5_000)
    words, texts = _Words(default_tokenizer(), 2), [f"{'long' * 500}{k} and {k % 3} it's. {k % 5}" for k in range(20)]
    out, most = [], 0
    for text in texts:
        out += encode_texts([text], words, 2)
        most = max(most, words.known.nbytes)
    assert most < 3 * 5_000
    assert [np.frombuffer(x, "<u2").tolist() for x in out] == [ids(tokenizer, t) for t in texts]


@pytest.mark.parametrize("n", [0, 1, 2, 100, 20_000])
def test_hash_is_minimal_and_perfect(n):
    r = np.random.default_rng(n)
    h1, h2 = (r.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2))
    levels = build_mph(h1, h2)
    assert sorted(mph_slots(levels, h1, h2).tolist()) == list(range(n))


def test_equal_first_hashes_are_told_apart_and_equal_keys_refused():
    h1, h2 = np.zeros(50, np.uint64), np.arange(50, dtype=np.uint64)
    assert sorted(mph_slots(build_mph(h1, h2), h1, h2).tolist()) == list(range(50))
    with pytest.raises(ValueError):
        build_mph(h1[:2], h2[[0, 0]])


def test_absent_keys_are_refused_by_their_fingerprint():
    r = np.random.default_rng(9)
    h1, h2 = (r.integers(0, 1 << 63, 5000, dtype=np.uint64) for _ in range(2))
    levels, records = build_mph(h1, h2), np.zeros(5000, _RECORD)
    slot = mph_slots(levels, h1, h2)
    records["fingerprint"][slot], records["n"][slot] = _fingerprint(h1, h2), np.arange(5000)
    part = IndexPart(b"".join(_index_bytes(levels, records)))
    there, got = part.find(h1, h2)
    assert there.all() and (got["n"] == np.arange(5000)).all()
    there, _ = part.find(h1 ^ np.uint64(1), h2)
    assert not there.any()


def expected(tokenizer, rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    counts = [len(ids(tokenizer, r[1])) for r in ordered]
    return {r[0]: (start, n, zlib.crc32(np.array(ids(tokenizer, r[1]), "<u4").tobytes())) for r, start, n in zip(ordered, accumulate([0, *counts]), counts)}


@pytest.mark.parametrize("part_keys", [3, 100_000])
def test_store_round_trip(spark, tokenizer, part_keys):
    rows = [(k * 13 % 997, f"text {k} " * (k % 30), "en", "a") for k in range(300)] + [(5000, None, None, None), (5001, "", "en", "a"), (None, "null id", "en", "a")]
    docs = documents(spark, rows).repartition(5)
    folder = work_dir(spark, "test-store")
    write_store(docs, folder, part_keys=part_keys)
    got = read_ids(spark, folder, find_keys(spark, folder, document_keys(docs))).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == expected(tokenizer, rows) and len(got) == len(rows)
    # keys that are not there
    other = spark.createDataFrame([(100_000 + k, 0) for k in range(200)] + [(5000, 1)], "doc_id bigint, occ bigint")
    assert find_keys(spark, folder, other).count() == 0
    # constant-time access from one process
    store = IdStore(folder)
    for r in key_hashes(document_keys(docs.filter("doc_id in (13, 5000) or doc_id is null"))).collect():
        text = next(x[1] for x in rows if x[0] == r.doc_id)
        assert store.get(r.h1, r.h2).tolist() == ids(tokenizer, text)
    assert store.get(1, 2) is None


def test_repeated_ids_and_awkward_rows(spark, edge, tokenizer):
    folder = work_dir(spark, "test-store")
    write_store(edge, folder)
    got = read_ids(spark, folder, find_keys(spark, folder, document_keys(edge))).collect()
    want = sorted(zlib.crc32(np.array(ids(tokenizer, r[1]), "<u4").tobytes()) for r in BASE)
    assert sorted(r.ids_crc32 for r in got) == want
    assert sorted(((r.doc_id, r.occ) for r in got), key=str)[:3] == [(1, 0), (10, 0), (10, 1)]
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == list(accumulate([0, *(r.n_tokens for r in ordered)]))[:-1]


def test_empty_table(spark, empty):
    folder = work_dir(spark, "test-store")
    write_store(empty, folder)
    assert read_ids(spark, folder, find_keys(spark, folder, document_keys(empty))).collect() == []


def test_a_lookup_reads_the_same_bytes_whatever_the_number_of_keys(spark, monkeypatch, tmp_path):
    """Bytes read per lookup, and its time, from 1,000 to 1,000,000 keys."""
    import json
    import time
    cost, seconds = {}, {}
    for n in (1_000, 1_000_000):
        r = np.random.default_rng(n)
        h1, h2 = (r.integers(0, 1 << 62, n, dtype=np.uint64) for _ in range(2))
        levels, records = build_mph(h1, h2), np.zeros(n, _RECORD)
        slot = mph_slots(levels, h1, h2)
        records["fingerprint"][slot], records["n"][slot] = _fingerprint(h1, h2), 1
        records["at"][slot] = np.arange(n)
        folder = str(tmp_path / str(n))
        (tmp_path / str(n)).mkdir()
        (tmp_path / str(n) / "meta.json").write_text(json.dumps({"width": 4, "parts": 1, "keys": n}))
        (tmp_path / str(n) / "index-00000.bin").write_bytes(b"".join(_index_bytes(levels, records)))
        np.arange(n, dtype="<u4").tofile(tmp_path / str(n) / "ids-000000.bin")
        folder, sizes = "file:" + folder, []
        store, plain = IdStore(folder), idstore._read
        keys = r.integers(0, n, 300).tolist()
        store.get(int(h1[0]), int(h2[0]))  # the header
        monkeypatch.setattr(idstore, "_read", lambda f, name, at=0, size=None: sizes.append(size) or plain(f, name, at, size))
        begun = time.perf_counter()
        assert all(store.get(int(h1[k]), int(h2[k])).tolist() == [k] for k in keys)
        seconds[n], cost[n] = time.perf_counter() - begun, sum(sizes) / len(keys)
        monkeypatch.setattr(idstore, "_read", plain)
    assert cost[1_000_000] < 1.3 * cost[1_000] < 200
    assert seconds[1_000_000] < 4 * seconds[1_000]


def test_a_hot_id_is_many_shards_and_numbered_through(spark, tokenizer):
    rows = [(None if k % 3 else k, f"text {k} " * 9, "en", "a") for k in range(400)] + [(None, "", "en", "a")] * 50
    docs = documents(spark, rows).repartition(5)
    folder = work_dir(spark, "test-store")
    write_store(docs, folder, shard_bytes=2_000)
    got = read_ids(spark, folder, find_keys(spark, folder, document_keys(docs))).collect()
    n_null = sum(r[0] is None for r in rows)
    assert sorted(r.occ for r in got if r.doc_id is None) == list(range(n_null)) and len(got) == len(rows)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.occ for r in ordered[:n_null]] == list(range(n_null))
    assert [r.start for r in ordered] == list(accumulate([0, *(r.n_tokens for r in ordered)]))[:-1]
    assert sorted(r.ids_crc32 for r in got) == sorted(zlib.crc32(np.array(ids(tokenizer, r[1]), "<u4").tobytes()) for r in rows)
    hot = spark.read.parquet(f"{folder}/manifest").filter("doc_id is null").select("shard").distinct().count()
    assert hot > 3


def test_words_with_marks_and_special_tokens_are_learned_alone(tokenizer):
    from siftwork.llm.idstore import _Words, default_tokenizer
    words = [f"w{k}ö" for k in range(4500)] + ["a\x00b", "\x00", "<|endoftext|>", "x<|y", "\x00\x00"] + [f"v{k}" for k in range(30)]
    table = _Words(default_tokenizer(), 2)
    got = table.of(words)
    assert got == table.whole(words) and len(table) == len(set(words))
    assert _Words(default_tokenizer(), 2).of(["\x00"]) == table.whole(["\x00"])


def test_words_of_letters_are_cut_apart_without_marks():
    """Plain words are learned with nothing between them; words whose pieces do not add up, and all others, as they were."""
    words, seen = _Words(default_tokenizer(), 2), []
    encode = words._encode
    words._encode = lambda texts: seen.extend(texts) or encode(texts)
    plain = ["Émile", "word", "mots,", "end.'", "ÀÉÎ", "ẞ", "слово", "漢字", "ǅ", "a?!", "x" * 300, "été;"]
    words.learn(plain)
    assert seen and not any("\x00" in t for t in seen)
    awkward = ["İ", "İ.", "İa.", "İİ", "it's", "'s", "3.", "a1", "·a", "é", "ﬁ", " ", "a b", "\x00", "<|endoftext|>", "x<|", "ª", "ʼn", "ไทย", " ", "ΑΣ", "don't.", "'", "_a"]
    words.learn(awkward)
    assert {w: words[w] for w in plain + awkward} == dict(zip(plain + awkward, words.whole(plain + awkward), strict=True))


def test_an_added_token_inside_plain_words_keeps_the_marks():
    file = json.loads(default_tokenizer())
    file["added_tokens"].append(dict(file["added_tokens"][0], id=49408, content="unk"))
    words = _Words(json.dumps(file).encode(), 2)
    some = ["unk", "xunky", "unk.", "word", "xunk"]
    words.learn(some)
    assert words.closing is None and [words[w] for w in some] == words.whole(some)
