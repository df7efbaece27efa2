"""The whole pipeline against its stages done by brute force on one machine."""

import hashlib
from itertools import combinations

import pytest

import corpus_pipeline
from siftwork.llm.mixing import LONG_WORDS, RATE, TARGETS
from siftwork.llm.pieces import PieceModel, default_model, scored_model
from tests.llm.conftest import BASE, WS, documents
from tests.llm.test_exact import brute as copies
from tests.llm.test_mixing import brute as raked
from tests.llm.test_quality import WORD, brute as judged
from tests.llm.test_simhash import brute_fingerprint, roots


def topic(text):
    if "icensed under" in text or "eleased under" in text:
        return "licence"
    if "@" in text or "+1 (" in text:
        return "contact"
    return "longform" if len(WORD.findall(text)) >= LONG_WORDS else "prose"


def brute(rows):
    """rows: (doc_id, text, lang, source) with different ids -> {doc_id: ids}."""
    rows = [r for r in rows if judged(r[1])[0][-1]]
    keep = {k for k, best, _ in copies(rows)[0] if k == best}
    rows = [r for r in rows if r[0] in keep]
    fps = {r[0]: brute_fingerprint(r[1]) for r in rows}
    links = [(a, b) for a, b in combinations(sorted(fps), 2) if bin(fps[a] ^ fps[b]).count("1") <= 2]
    root = roots(fps, links)
    rows = [r for r in rows if root[r[0]] == r[0]]
    tokens = {r[0]: len(WORD.findall(r[1])) for r in rows}
    weights, _, _ = raked([(tokens[r[0]], r[3], r[2], topic(r[1])) for r in rows], TARGETS, TARGETS)

    def cell(r):
        from siftwork.llm.mixing import OTHER, Flattened
        values = zip((r[3], r[2], topic(r[1])), TARGETS.values(), strict=True)
        return tuple(OTHER if v is None else v if v in ((t.values or (v,)) if isinstance(t, Flattened) else t) else OTHER for v, t in values)

    rows = [r for r in rows if int(hashlib.md5(f"mix{r[0]}".encode()).hexdigest()[:12], 16) / 2 ** 48 < min(1, weights[cell(r)] * RATE)]
    model = PieceModel(scored_model(default_model()))
    return {r[0]: model.encode([r[1]])[1][0].tolist() for r in rows}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [(r[0], r[1], r[2], r[3]) for r in BASE if r[0] is not None and r[0] != 10]
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows += [(1000 + r.doc_id, r.text, r.lang, r.source) for r in given]
    rows += [(5000 + r.doc_id, r.text.replace(" ", "  "), r.lang, r.source) for r in given[:20]]  # copies
    path = tmp_path_factory.mktemp("pipeline")
    documents(spark, rows).repartition(4).write.parquet(f"{path}/documents.parquet")
    return str(path), rows


def test_run_matches_brute_force(spark, folder):
    path, rows = folder
    got = corpus_pipeline.run(spark, path)
    assert {r.doc_id: list(r.ids) for r in got.collect()} == brute(rows)
    assert got.filter("not round_trip or round_trip is null").isEmpty()


def test_stages_return_the_columns_of_documents(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == columns
        counts.append(docs.count())
    assert all(a > b for a, b in zip(counts, counts[1:]))  # every stage's decision takes effect


def test_stages_accept_awkward_and_empty_tables(spark, edge, empty):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").collect() == []
        stage(spark, edge, "").collect()


def test_near_stage_keeps_one_row_of_repeated_ids_with_close_texts(spark):
    text = " ".join(f"w{k}" for k in range(300))
    docs = documents(spark, [(7, text, "en", "a"), (7, text + " tail", "en", "b"), (8, text, "en", "a"), (None, text, "en", "a"), (9, "quite another text", "en", "a")])
    kept = corpus_pipeline.near(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == [7, 9]
    alone = documents(spark, [(None, "a text without an id", "en", "a"), (1, "and one with an id that differs", "en", "a")])
    assert corpus_pipeline.near(spark, alone, "").count() == 2
