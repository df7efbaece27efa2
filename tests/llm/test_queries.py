"""Registered queries on the smallest tables: names, columns, twins, whole results."""

import zlib
from itertools import accumulate

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from siftwork.llm.alignment import Pair, default_tokenizers
from siftwork.llm.packing import default_tokenizer
from siftwork.llm.sql import ORACLE
from tests.conftest import SF001
from tests.llm.test_alignment import brute as brute_alignment
from tests.llm.test_negatives import brute as brute_negatives
from tests.oracle_compare import compare

COLUMNS = {
    "op1_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op2_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op3_mix_sources": "doc_id tokens weight probability kept",
    "op4_sentencepiece": "doc_id n_tokens score round_trip",
    "op5_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op6_simhash_near_dedup": "doc_id fingerprint component_id",
    "op7_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op8_url_filter": "page_id host path rule verdict",
    "op9_line_dedup": "doc_id n_lines n_removed kept_sha256",
    "op10_token_store": "doc_id start n_tokens ids_crc32",
    "op12_token_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
}


def test_every_operator_and_the_pipeline_are_registered():
    assert {*COLUMNS, "op11_hard_negatives", "op13_packing", "pipeline"} <= set(entry.queries())
    assert set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", COLUMNS)
def test_one_row_per_document_or_page(spark, name):
    got = entry.queries()[name](spark, SF001)
    assert set(COLUMNS[name].split()) <= set(got.columns)
    key = got.columns[0]
    table = "pages" if key == "page_id" else "documents"
    want = sorted(r[0] for r in duckdb.sql(f"SELECT {key if key != 'page_id' else 'page_id'} FROM '{SF001}/{table}.parquet'").fetchall())
    rows = got.collect()
    assert sorted(r[key] for r in rows) == want
    if name == "op4_sentencepiece":
        assert all(r.round_trip for r in rows)


@pytest.mark.parametrize("name", ORACLE)
def test_twins(spark, name):
    assert compare(spark, SF001, [name], verbose=False)[name][0] == "MATCH"


def test_hard_negatives_against_brute_force(spark):
    rows = [(i, (label + 1) % 10 if i % 7 == 0 else label, v) for i, v, label in duckdb.sql(f"SELECT vec_id, embedding, label FROM '{SF001}/embeddings.parquet'").fetchall()]
    got = entry.queries()["op11_hard_negatives"](spark, SF001).collect()
    assert sorted(map(tuple, got), key=str) == brute_negatives(rows, lambda a: a % 100 == 0)


def test_alignment_against_brute_force(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF001}/documents.parquet'").fetchall()
    got = entry.queries()["op12_token_alignment"](spark, SF001).collect()
    assert sorted(map(tuple, got), key=str) == brute_alignment(Pair(*default_tokenizers()), rows)[0]


def test_packing_against_whole_texts(spark):
    from tokenizers import Tokenizer
    known = Tokenizer.from_buffer(default_tokenizer())
    pieces = entry.queries()["op13_packing"](spark, SF001).collect()
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, text in duckdb.sql(f"SELECT doc_id, text FROM '{SF001}/documents.parquet'").fetchall():
        ids, at = [*known.encode(text or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(by_doc.pop(doc), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert not by_doc
    for run in by_sequence.values():
        run.sort(key=lambda r: r.offset)
        total = sum(r.length for r in run)
        assert [r.offset for r in run] == [0, *accumulate(r.length for r in run[:-1])] and total <= 2048 and total & (total - 1) == 0
