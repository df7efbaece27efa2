"""Steps whose memory or disk must not follow the product of two sizes."""

import os
import random

from siftwork.operators import llm as L

QUESTIONS = [(f"I{k}", f"question {k}") for k in range(29)]


def _papers(spark, n, text):
    return spark.createDataFrame([(k, f"t{k}", text(k)) for k in range(n)], "id bigint, title string, abstract string")


def test_a_completer_gets_a_bounded_number_of_characters(spark):
    papers = _papers(spark, 20, lambda k: "x" * (400 * (k % 5))).coalesce(1)

    def measuring(prompts, keys):
        out = L.rule_completer(prompts, keys)
        return out.assign(output_tokens=int(prompts.str.len().sum()) if len(prompts) > 1 else 0)

    plain = L.label_with(L.answer_requests(papers, QUESTIONS), measuring, "prompt", call_chars=3000)
    assert plain.agg({"output_tokens": "max"}).first()[0] <= 3000
    whole = L.label_with(L.paper_requests(papers, QUESTIONS).withColumn("key", L.F.col("paper_id").cast("string")), measuring, "prompt", "key", each="questions", call_chars=3000)
    rows = L.each_answer(whole).collect()
    assert len(rows) == 20 * 29 and max(r.output_tokens for r in rows) <= 3000


def test_each_question_is_answered_as_if_asked_alone(spark):
    papers = _papers(spark, 7, lambda k: None if k == 3 else "é" * k).unionAll(spark.createDataFrame([(None, None, "a"), (2, "again", "b")], "id bigint, title string, abstract string"))
    alone = L.answer_requests(papers, QUESTIONS).withColumn("key", L.F.concat_ws(":", L.F.col("paper_id").cast("string"), "question_id"))
    cols = ("paper_id", "question_id", "prompt", "response", "input_tokens", "output_tokens", "model")
    want = L.label_with(alone, L.rule_completer, "prompt", "key").select(*cols)
    whole = L.label_with(L.paper_requests(papers, QUESTIONS).withColumn("key", L.F.col("paper_id").cast("string")), L.rule_completer, "prompt", "key", each="questions")
    got = L.each_answer(whole).withColumn("prompt", L.with_question(L.F.col("prompt"), L.F.col("question"))).select(*cols)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_the_answer_store_holds_a_text_once(spark, tmp_path):
    papers = _papers(spark, 8, lambda k: "".join(chr(33 + (k * 7919 + j * j * 31 + j // 90) % 90) for j in range(20_000)))
    store = str(tmp_path / "answers")
    L.run_answer_job(papers.where("id % 3 = 0"), QUESTIONS, store)
    assert L.run_answer_job(papers, QUESTIONS, store) == {"processed": 5 * 29, "failed": 0, "skipped": 3 * 29, "stored": 8 * 29}
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(store) for f in names if f.endswith(".parquet"))
    assert size < 3 * 8 * 20_000
    kept = L.read_answers(spark, store)
    want = {(r.paper_id, r.question_id, r.prompt) for r in L.answer_requests(papers, QUESTIONS).collect()}
    assert {(r.paper_id, r.question_id, r.prompt) for r in kept.collect()} == want and kept.count() == len(want)


def test_containment_writes_one_gram_per_query(spark, monkeypatch):
    """Long queries: what is written between the steps follows the texts, not their grams."""
    from siftwork.operators import contain as C
    written = {}

    def saved(df, work, name):
        out = _saved(df, work, name)
        written[name] = out.count()
        return out

    _saved = C._saved
    monkeypatch.setattr(C, "_saved", saved)
    r = random.Random(5)
    rows = [(k, "".join(r.choices("abcdefgh é", k=400)).strip()) for k in range(30)]
    d = spark.createDataFrame(rows + [(100 + k, "before " + t + " after") for k, t in rows[:10]], "id bigint, text string")
    found = C.containing(d, d, slots=1 << 8)
    got = {(r.query_class, r.doc_class) for r in found.pairs.collect()}
    assert got == {(k, k) for k in range(30)} | {(100 + k, 100 + k) for k in range(10)} | {(k, 100 + k) for k in range(10)}
    assert written and all(n <= 50 for n in written.values())


def test_filing_in_cells_holds_a_bounded_block(spark):
    import numpy as np

    from siftwork.operators.vectors import _chunk_rows, _to_cells
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(4096, 4))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    rows = rnd.normal(size=(2000, 4))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "id bigint, embedding array<double>").coalesce(1)
    assert _chunk_rows(4096) * 4096 * 8 <= 16 << 20 and _chunk_rows(1 << 30) == 1
    want = (rows @ centres.T).argmax(axis=1)
    one = {r.id: r.cell for r in _to_cells(df, "id", "embedding", centres, 1).collect()}
    assert [one[k] for k in range(2000)] == want.tolist()
    three = _to_cells(df, "id", "embedding", centres, 3).groupBy("id").count().collect()
    assert len(three) == 2000 and {r["count"] for r in three} == {3}


def test_tiles_grow_with_the_table(spark, monkeypatch):
    """Vectors are sent to eight tiles of the other side, not to one per ``tile_rows`` rows, and the nearest stay exact."""
    import numpy as np

    from siftwork.operators import vectors as V
    counted, tiles = [], V._tiles
    monkeypatch.setattr(V, "_tiles", lambda n, rows: counted.append(tiles(n, rows)) or counted[-1])
    v = np.random.default_rng(4).normal(size=(1600, 3))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id bigint, embedding array<double>")
    found = V.nearest_neighbours(df, df, 2, tile_rows=32)
    assert counted == [8, 8]
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = 1 - unit @ unit.T
    np.fill_diagonal(d, np.inf)
    got = {(r.query_id, r["rank"]): r.neighbor_id for r in found.collect()}
    assert [[got[q, 1], got[q, 2]] for q in range(1600)] == np.argsort(d, axis=1, kind="stable")[:, :2].tolist()


def test_hashing_encoder_counts_every_token(spark):
    """Long texts are read in pieces; no token is cut or lost."""
    import hashlib
    import math
    import re

    from siftwork.operators import ml as M
    texts = [None, "", " .. ", "One ONE two", "é1é ümlaut Straße x²y", "a" * 70, "tok1 " * 9, "".join(f"w{k % 701}{'.é '[k % 3]}" for k in range(4000))]
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "text_sha1 string, text string")
    got = {int(r.text_sha1): r.embedding for r in M.hashing_encoder(64, piece_bytes=32)(df).collect()}
    for k, t in enumerate(texts):
        counts = [0.0] * 64
        for token in re.findall(r"[A-Za-z0-9]+", t or ""):
            counts[int(hashlib.md5(token.lower().encode()).hexdigest()[:8], 16) % 64] += 1
        norm = math.sqrt(sum(c * c for c in counts)) or 1.0
        assert max(abs(a - c / norm) for a, c in zip(got[k], counts, strict=True)) < 1e-12


def _plan_rows(df):
    """{operator: the most rows that one of its kind put out} of a plan that has run."""
    found, todo = {}, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        todo += [node.children().apply(k) for k in range(node.children().size())]
        n = node.metrics().get("numOutputRows")
        if n.isDefined():
            found[name] = max(found.get(name, 0), n.get().value())
    return found


def test_containment_joins_pairs_only(spark, monkeypatch):
    """Texts of two letters have few grams, and every document holds nearly all: what meets at the joins follows the pairs, not the queries times
    the documents."""
    from siftwork.operators import contain as C
    plans = {}

    def saved(df, work, name):
        plans[name] = df
        return _saved(df, work, name)

    _saved = C._saved
    monkeypatch.setattr(C, "_saved", saved)
    r = random.Random(9)
    docs = [(k, "".join(r.choices("ab", k=600))) for k in range(150)]
    asked = [(k, t[300:300 + r.randrange(20, 150)]) for k, t in docs] + [(1000, "a" * 40), (1001, docs[7][1]), (1002, docs[8][1][:64])]
    d, q = (spark.createDataFrame(x, "id bigint, text string") for x in (docs, asked))
    want = {(a, b) for a, t in asked for b, u in docs if t in u}
    assert {(x.query_class, x.doc_class) for x in C.containing(q, d).pairs.collect()} == want
    assert len(plans["pairs"].collect()) == len(want)
    rows = _plan_rows(plans["pairs"])
    joins = {name: n for name, n in rows.items() if "Join" in name}
    assert joins and max(joins.values()) <= len(want)
