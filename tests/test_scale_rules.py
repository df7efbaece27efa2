"""Results that must not depend on partition merging, exchange reuse, carried columns or errors."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.functions.text import html_to_text
from siftwork.operators import ml as M
from siftwork.operators import ranking as R
from siftwork.operators import split as SP
from siftwork.operators import store as ST
from siftwork.operators import vectors as V
from siftwork.session import read_if_any

N = 200_000


@pytest.fixture(params=["merged", "apart", "no reuse"])
def exchanges(request, spark):
    keys = {"apart": ("spark.sql.adaptive.coalescePartitions.enabled", "false"), "no reuse": ("spark.sql.exchange.reuse", "false")}
    if request.param in keys:
        spark.conf.set(*keys[request.param])
    yield request.param
    for key, _ in keys.values():
        spark.conf.unset(key)


def big(spark, n=N):
    """Rows over several input partitions with an array column that only one branch needs."""
    return spark.range(0, n, 1, 5).select("id", (F.col("id") % 7 < 2).alias("label"), F.array(F.rand(1), F.rand(2), F.rand(3)).alias("features"))


def ranks(n=N, seed=42):
    return duckdb.sql(f"""SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5(id || ':{seed}'), id) - 1 AS r,
        count(*) OVER (PARTITION BY label) AS n FROM (SELECT range AS id, range % 7 < 2 AS label FROM range({n}))""").df()


def test_folds_and_ranks_with_a_carried_column(spark, exchanges):
    want = ranks()
    got = SP.class_rank(big(spark)).drop("features").toPandas()
    m = want.merge(got, on="id")
    assert len(got) == N and (m["r"] == m["_rank"]).all() and (m["n"] == m["_class_n"]).all()
    folds = SP.stratified_folds(big(spark), 5).select("id", "fold", "features").select("id", "fold").toPandas().merge(want, on="id")
    assert (folds["fold"] == folds["r"] % 5).all()


def test_holdout_with_a_carried_column(spark, exchanges):
    got = SP.holdout_split(big(spark), 0.2, 0.2).select("id", "split", "features").groupBy("split").count().collect()
    n = [sum(k % 7 < 2 for k in range(N)), sum(k % 7 >= 2 for k in range(N))]
    part = sum(round(x * 0.2) for x in n)
    assert {r[0]: r[1] for r in got} == {"test": part, "val": part, "train": N - 2 * part}


@pytest.mark.parametrize("levels", [1, 2])
def test_work_saved_on_constant_and_binary_scores(spark, exchanges, levels):
    df = spark.range(0, N, 1, 4).select("id", (F.col("id") % 2).alias("fold"), (F.col("id") % 11 < 3).alias("label"),
                                        (F.col("id") % levels).cast("double").alias("score"), F.array(F.rand(1), F.rand(2)).alias("features"))
    got = {r.fold: r.k for r in R.wss_at_recall(df, ["fold"], 0.95).collect()}
    want = dict(duckdb.sql(f"""WITH s AS (SELECT range AS id, range % 2 AS fold, (range % 11 < 3)::INT AS y, (range % {levels}) AS score FROM range({N})),
        c AS (SELECT fold, row_number() OVER w AS k, sum(y) OVER w AS tp, sum(y) OVER (PARTITION BY fold) AS p FROM s WINDOW w AS (PARTITION BY fold ORDER BY score DESC, id))
        SELECT fold, min(k) FROM c WHERE tp >= ceil(0.95 * p) GROUP BY fold""").fetchall())
    assert got == want


def test_curve_on_distinct_scores(spark, exchanges):
    df = spark.range(0, N, 1, 4).select((F.col("id") % 2).alias("fold"), (F.xxhash64("id") % 3 == 0).alias("label"),
                                        ((F.xxhash64(F.col("id"), F.lit(1)) % 1_000_003) / 7.0).alias("score"))
    curve = R.pr_curve(df, ["fold"]).select("fold", "threshold", "tp", "fp").toPandas().sort_values(["fold", "threshold"], ascending=[True, False])
    rows = df.toPandas()  # noqa: F841 - read by the query below
    want = duckdb.sql("""SELECT fold, score, sum(sum(label::INT)) OVER w AS tp, sum(sum(1 - label::INT)) OVER w AS fp FROM rows GROUP BY fold, score
        WINDOW w AS (PARTITION BY fold ORDER BY score DESC) ORDER BY fold, score DESC""").df()
    assert (curve["tp"].to_numpy() == want["tp"].to_numpy()).all() and (curve["fp"].to_numpy() == want["fp"].to_numpy()).all()


def vectors(spark, n, dim=8, seed=3):
    x = np.random.default_rng(seed).standard_normal((n, dim))
    return x, spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id bigint, embedding array<double>").repartition(6)


def exact(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def test_every_vector_has_its_neighbours(spark, exchanges):
    x, df = vectors(spark, 2000)
    got = V.nearest_neighbours(df, df, 3, tile_rows=500).toPandas().sort_values(["query_id", "rank"])
    assert len(got) == 6000
    assert (got["neighbor_id"].to_numpy().reshape(-1, 3) == exact(x, 3)).all()


def test_many_vectors_over_many_partitions(spark, exchanges):
    _, df = vectors(spark, 20_000, 4)
    got = V.nearest_neighbours(df, df, 3, tile_rows=4096).groupBy("query_id").count().groupBy("count").count().collect()
    assert [(r[0], r[1]) for r in got] == [(3, 20_000)]


def test_zero_vectors_and_text_ids(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [1.0, 1.0]), ("d", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id string, embedding array<double>")
    got = {(r.query_id, r.rank): (r.neighbor_id, r.distance) for r in V.nearest_neighbours(df, df, 3).collect()}
    assert len(got) == 12
    assert [got["b", k] for k in (1, 2, 3)] == [("a", None), ("c", None), ("d", None)]
    assert [got["a", k][0] for k in (1, 2, 3)] == ["c", "d", "b"] and got["a", 3][1] is None


@pytest.mark.parametrize("tile_rows", [50, 4096])
def test_cells_find_most_neighbours_and_hot_cells_are_cut(spark, tile_rows):
    x, df = vectors(spark, 1500, 8)
    hot = spark.range(10_000, 10_400).select("id", F.array(*[F.lit(1.0 if k else 0.5) for k in range(8)]).alias("embedding"))
    both = df.unionByName(hot)
    got = V.approximate_neighbours(df, both, 3, V.fit_cells(both, 20), probes=8, tile_rows=tile_rows).toPandas()
    full = V.nearest_neighbours(df, both, 3).toPandas()
    hit = got.merge(full, on=["query_id", "neighbor_id"])
    assert len(hit) / len(full) >= 0.9
    assert np.allclose(hit["distance_x"], hit["distance_y"])


def test_smote_reaches_parity(spark, exchanges):
    df = spark.range(0, 6000, 1, 4).select("id", (F.col("id") % 3 == 0).alias("target"), F.array(F.rand(1), F.rand(2)).alias("embedding"), F.lit("x").alias("extra"))
    got = {(r.target, r.synthetic): r.n for r in V.smote(df, 3, tile_rows=700).groupBy("target", "synthetic").agg(F.count("*").alias("n")).collect()}
    assert got == {(True, False): 2000, (False, False): 4000, (True, True): 2000}


def test_smote_with_one_minority_row(spark):
    df = spark.range(20).select("id", (F.col("id") == 4).alias("target"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    made = V.smote(df, 3).where("synthetic").collect()
    assert len(made) == 18 and all(r.embedding == [4.0, 1.0] for r in made)


def test_a_save_touches_only_its_own_rows(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([("m", "c", 1, 0.5)], "embedding_model string, classifier string, fold int, f1 double")
    ST.save_results(rows, path, "d1", "c1")
    ST.save_results(rows.withColumn("f1", F.lit("text")), path, "d2", "c2")  # another type
    with pytest.raises(Exception, match="broken"):
        ST.save_results(rows.withColumn("f1", F.raise_error(F.lit("broken"))), path, "d3", "c3")
    assert [r.f1 for r in ST.load_results(spark, path, "d1", "c1").collect()] == [0.5]
    assert [r.f1 for r in ST.load_results(spark, path, "d2", "c2").collect()] == ["text"]
    assert ST.load_results(spark, path, "d3", "c3") is None
    assert ST.list_results(spark, path).count() == 2
    assert ST.load_results(spark, str(tmp_path / "none"), "d1", "c1") is None


def test_only_missing_files_count_as_nothing_stored(spark, tmp_path):
    assert read_if_any(lambda: spark.read.parquet(str(tmp_path / "missing"))) is None
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        read_if_any(lambda: spark.read.parquet(str(broken)))


def test_two_batches_store_the_same_vectors_as_one(spark, tmp_path):
    texts = ["one two two", "", None, "Three four", "one Two two!", "ünïcode wörds"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    enc = M.get_encoder("hashing-64")
    M.embed_with_store(df.where("id < 2"), str(tmp_path / "a"), "hashing-64", enc)
    two = {r.id: r.embedding for r in M.embed_with_store(df, str(tmp_path / "a"), "hashing-64", enc).collect()}
    one = {r.id: r.embedding for r in M.embed_with_store(df, str(tmp_path / "b"), "hashing-64", enc).collect()}
    assert one == two and set(one) == {0, 1, 3, 4, 5}
    assert one[0] == one[4] and sum(x * x for x in one[0]) == pytest.approx(1) and set(one[1]) == {0.0}


@pytest.mark.parametrize("markup, text", [
    ('<?xml version="1.0"?><p>a</p>', "a"),
    ("&copy 2020", "© 2020"),
    ('<a title="x>y">q</a>', "q"),
    ("<a title='x>y' b=\"z'>\">q</a> r", "q r"),
    ("a<script>var x = 1;", "a"),
    ("a<style>p{} b", "a"),
    ("a<!-- open b", "a"),
    ('a <b title="open> c', "a c"),
    ("1 < 2 &amp;&amp; 3 > 2", "1 < 2 && 3 > 2"),
    ("&lt;b&gt;x", "<b>x"),
    ("AT&T &#233;&#xe9;&eacute;", "AT&T ééé"),
    (None, None),
])
def test_html_to_text_by_hand(spark, markup, text):
    assert spark.range(1).select(html_to_text(F.lit(markup).cast("string"))).first()[0] == text


def test_conflicts_exist_in_the_fixture(spark):
    from siftwork.plans.registry import all_queries
    from tests.conftest import SF01
    q = all_queries()
    s = q["conflict_summary"](spark, SF01).first()
    left = [q[n](spark, SF01).count() for n in ("resolve_majority", "resolve_remove")]
    assert 0 < s.n_conflicting_patterns < s.n_conflicting_rows < s.n_rows
    assert left[1] == s.n_rows - s.n_conflicting_rows < left[0] < s.n_rows


def test_a_failing_prompt_does_not_end_the_job(spark, tmp_path):
    from siftwork.operators import llm as L
    papers = spark.createDataFrame([(k, f"t{k}", "a") for k in range(6)], "id bigint, title string, abstract string")
    questions = [("I1", "first"), ("I2", "second")]
    store = str(tmp_path / "answers")

    def flaky(prompts, keys):
        if prompts.str.contains("t3").any():
            raise RuntimeError("no answer for t3")
        return L.rule_completer(prompts, keys)

    assert L.run_answer_job(papers, questions, store, flaky) == {"processed": 10, "failed": 2, "skipped": 0, "stored": 10}
    failures = L.read_failures(spark, store).collect()
    assert {(r.paper_id, r.question_id) for r in failures} == {(3, "I1"), (3, "I2")} and all("no answer for t3" in r.error for r in failures)
    assert L.run_answer_job(papers, questions, store) == {"processed": 2, "failed": 0, "skipped": 10, "stored": 12}
    assert L.read_answers(spark, store).count() == 12
    with pytest.raises(Exception, match="no answer"):
        L.label_with(L.answer_requests(papers, questions), flaky, "prompt").collect()


def test_a_second_evaluation_fits_nothing(spark, tmp_path):
    x, df = vectors(spark, 120, 3)
    df = df.withColumn("label", F.element_at("embedding", 1) > 0)
    fits, path = [], str(tmp_path / "results")

    def make(n):
        fits.append(n)
        return M.logreg(max_iter=5)(n)

    first = M.evaluated(df, "logreg", make, path, {"max_iter": 5}, k=2)
    assert len(fits) == 2
    again = M.evaluated(df, "logreg", make, path, {"max_iter": 5}, k=2)
    assert len(fits) == 2 and sorted(map(str, first.collect())) == sorted(map(str, again.collect()))
    row = again.first()
    assert (row.n_samples, row.n_features, row.n_splits, row.random_state) == (120, 3, 2, 42)
    M.evaluated(df, "logreg", make, path, {"max_iter": 5}, k=2, target_recall=0.95)
    assert len(fits) == 4 and ST.list_results(spark, path).count() == 2
    M.evaluated(df.where("id > 0"), "logreg", make, path, {"max_iter": 5}, k=2)
    assert len(fits) == 6
    ST.clear_results(spark, path)


def test_daily_counts_over_several_batches_with_late_rows(spark, tmp_path):
    """One file per micro-batch: rows within the delay still count, rows behind the watermark of
    earlier batches do not, and a second run continues from the checkpoint."""
    import time

    from siftwork.streaming.streams import daily_counts_stream
    batches = [
        [("2024-01-01 10:00:00", "view"), ("2024-01-01 12:00:00", "view")],
        [("2024-01-02 09:00:00", "view"), ("2024-01-01 23:00:00", "view")],  # one late, within a day
        [("2024-01-06 00:00:00", "click")],
        [("2024-01-06 01:00:00", "click")],  # late rows are judged by the watermark of the batch before
        [("2024-01-01 08:00:00", "view"), ("2024-01-05 12:00:00", "click")],  # one behind the watermark, one within
    ]
    src = tmp_path / "src"
    schema = "ts timestamp_ntz, event_type string"

    def deliver(rows):
        spark.createDataFrame(rows, "t string, event_type string").selectExpr("cast(t as timestamp_ntz) ts", "event_type").coalesce(1).write.mode("append").parquet(str(src))
        time.sleep(1.1)  # file order follows modification times

    def run():
        out = daily_counts_stream(spark, str(src), schema, str(tmp_path / "out"), str(tmp_path / "ckpt"), files_per_batch=1)
        return {(str(r.day), r.event_type): r.n for r in out.collect()}

    for rows in batches[:2]:
        deliver(rows)
    assert run() == {("2024-01-01", "view"): 3, ("2024-01-02", "view"): 1}
    for rows in batches[2:]:
        deliver(rows)
    assert run() == {("2024-01-01", "view"): 3, ("2024-01-02", "view"): 1, ("2024-01-06", "click"): 2, ("2024-01-05", "click"): 1}
