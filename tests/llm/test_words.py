"""Byte-level ids: the merge loop gives what the tokenizers library gives."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwork.llm.packing import default_tokenizer
from siftwork.llm.words import ByteLevel
from tests.llm.conftest import LONG

PARTS = ["word", " two", "  ", "\n", " \n x", "é", "É́", "漢字", "\U0001f600", "<|endoftext|>", "\x00", "\xa0", "\x85", "\x1c", "don't", "'S", "'ll", " 123", "½", "²", "ª", "....", "\t", "ß", "ſ", "ǅ", " ", "Ͱ", "_", "\xad"]


@pytest.fixture(scope="module", params=[False, True])
def known(request):
    return ByteLevel(default_tokenizer(), plain=request.param)


def whole(known, text):
    return known.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), st.text(st.characters(max_codepoint=0x24F), max_size=60), st.text(max_size=30)))
def test_any_text(known, text):
    text = text.encode("utf-8", "ignore").decode("utf-8")
    assert known.encode([text])[0].tolist() == whole(known, text)


def test_every_token_alone_and_every_latin_character(known):
    texts = []
    for raw in known.bytes:
        try:
            texts.append(raw.decode("utf-8"))
        except UnicodeDecodeError:
            continue
    texts += [f"a{chr(c)}b {chr(c)}\n{chr(c)} 1{chr(c)}" for c in range(0x250)]
    assert [x.tolist() for x in known.encode(texts)] == [e.ids for e in known.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_long_texts(known):
    text = "x" * 3000 + LONG * 3 + "  \n end"
    assert known._is_fast(text) and known.encode([text])[0].tolist() == whole(known, text)
    text += "漢"
    assert not known._is_fast(text) and known.encode([text])[0].tolist() == whole(known, text)


def test_other_kinds_of_files_use_the_library_alone():
    file = json.loads(default_tokenizer())
    file["pre_tokenizer"]["add_prefix_space"] = True
    other = ByteLevel(json.dumps(file).encode())
    assert other.fast is None and other.encode(["a b"])[0].tolist() == whole(other, "a b")
