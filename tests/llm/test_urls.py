"""URL parsing and rules against plain string code, the models against their formula."""

import re
from math import log

import pytest
from pyspark.sql import functions as F

from siftwork.llm.urls import RULES, UrlModel, judge_urls

URLS = [
    None, "", "no scheme", "http://", "http:///path", "HTTP://A.NET/x?y#z", "https://a.net", "https://a.net?x/", "https://net/", "https://xnet/", "https://a.net#/en/",
    "https://example.net/en/1", "https://m.example.net/en/1?x", "https://badexample.net/en/1", "https://example.net/en", "https://example.net/de/",
    "https://www.example.com/de/9", "https://www.example.com/en/9", "https://example.com/de", "https://x.org/fr/1", "https://org/fr/", "https://x.org/en/1",
    "a://b://example.com/de/", "https://ÜBER.org/fr/É", "https://EXAMPLE.NET/EN/1", "https://example.net:80/en/1", "https://x.org/fr/1", "https://x.org/fr/1",
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits, key=lambda f: len(f[0])) if fits else (None, None)))


def pages(spark, urls):
    return spark.createDataFrame([(k if k != 3 else None, u, "<p>") for k, u in enumerate(urls)], "page_id bigint, url string, html string").withColumns(
        {c: F.lit("clash") for c in ("host", "path", "rule", "verdict", "score", "text")})


def test_hosts_paths_and_rules(spark):
    got = judge_urls(pages(spark, URLS).repartition(3)).collect()
    want = [(k if k != 3 else None, *brute(u)) for k, u in enumerate(URLS)]
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=str) == sorted((w[:4] for w in want), key=str)
    ruled = {w[0]: w[4] for w in want if w[4]}
    assert all(r.verdict == ruled.get(r.page_id, r.verdict) and r.verdict in ("allow", "block") for r in got)
    assert all(r.verdict == "allow" and r.score == 0 for r in got if not r.host + r.path)


def test_without_labelled_rows_everything_is_allowed(spark):
    got = judge_urls(pages(spark, ["https://x.org/en/1", None, "https://a.com/"])).collect()
    assert [r.verdict for r in got] == ["allow"] * 3
    assert judge_urls(pages(spark, ["x"]).limit(0)).collect() == []


def test_probabilities_follow_the_formula_and_sum_to_one():
    grams = {"a": 3, "b": 1, "aa": 2, "ab": 1, "\x02a": 1}
    model = UrlModel({"allow": grams, "block": grams}, order=1)
    base = (3 + 2 / 256) / (4 + 2)
    assert model.probability("allow", "", "a") == pytest.approx(base)
    assert model.probability("allow", "a", "a") == pytest.approx((2 + 2 * base) / (3 + 2))
    assert model.probability("allow", "z", "a") == pytest.approx(base)  # unseen context: the shorter one
    chars = ["a", "b"] + [chr(300 + k) for k in range(254)]
    assert sum(model.probability("allow", "a", c) for c in chars) == pytest.approx(1)
    assert model.score("ab") == 0


def test_score_is_the_length_normalised_difference():
    model = UrlModel({"allow": {"a": 9, "b": 1}, "block": {"a": 1, "b": 9}}, order=0)
    p, q = model.probability("allow", "", "a"), model.probability("block", "", "a")
    assert model.score("aaa") == pytest.approx(log(p) - log(q))
    assert model.score("a" * 50) > 0 > model.score("b" * 50)


def test_held_out_accuracy(spark):
    """Hosts that no rule names but that look like the labelled ones."""
    rows = [f"https://{w}{k}.example.net/en/{k}" for k in range(150) for w in ("garden", "library")]
    rows += [f"https://{w}{k}.example.com/de/{k}" for k in range(150) for w in ("casino", "cheappills")]
    fresh = [(f"https://{w}{k}.example.info/x/{k}", v) for k in range(500, 540) for w, v in (("garden", "allow"), ("library", "allow"), ("casino", "block"), ("cheappills", "block"))]
    got = {r.host: r.verdict for r in judge_urls(pages(spark, rows + [u for u, _ in fresh])).filter("rule is null").collect()}
    right = sum(got[u.split("/")[2]] == v for u, v in fresh)
    assert right >= 0.9 * len(fresh)


def test_bounded_sample_is_the_same_on_any_partitioning(spark):
    rows = [f"https://h{k}.net/{k}" for k in range(300)] + [f"https://h{k}.org/fr/{k}" for k in range(300)] + ["https://h1.info/fr/5"]
    first, second = (sorted(map(tuple, judge_urls(pages(spark, rows).repartition(n), train_urls=50).collect()), key=str) for n in (2, 7))
    assert first == second


def plain_model(texts, order):
    """Witten-Bell probabilities straight from the definition, by counting in the texts themselves."""
    follow = {}
    for text in texts:
        padded = "\x02" * order + text
        for i in range(order, len(padded)):
            for k in range(order + 1):
                seen = follow.setdefault(padded[i - k:i], {})
                seen[padded[i]] = seen.get(padded[i], 0) + 1

    def probability(context, char):
        below = probability(context[1:], char) if context else 1 / 256
        seen = follow.get(context)
        return (seen.get(char, 0) + len(seen) * below) / (sum(seen.values()) + len(seen)) if seen else below
    return probability


def test_whole_query_against_brute_force(spark):
    """Sample, counts, threshold and verdict of every row, ruled or not, without the operator's code."""
    import xxhash
    order = 4
    urls = [r.url for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("url").collect()]
    urls += [u for u in URLS if u != "http://"] + [f"https://{w}{k}.example.{e}" for k in range(40) for w, e in (("garden", "net/en/a"), ("casino", "com/de/b"), ("garden", "info/x"), ("casino", "info/y"))]
    parsed = [brute(u) for u in urls]
    texts = {v: sorted({h + p for h, p, _, verdict in parsed if verdict == v}) for v in ("allow", "block")}

    def held_out(text):  # the two values are hashed in turn, each with the hash before as its seed
        first = xxhash.xxh64_intdigest(b"fold", 42)
        last = xxhash.xxh64_intdigest(text.encode(), first)
        return (last - (1 << 64) if last >> 63 else last) % 5 == 0

    models = {v: plain_model([t for t in texts[v] if t and not held_out(t)], order) for v in texts}

    def score(text):
        padded = "\x02" * order + text
        steps = [(padded[i - order:i], padded[i]) for i in range(order, len(padded))]
        return sum(log(models["allow"](c, x)) - log(models["block"](c, x)) for c, x in steps) / len(text) if text else 0.0

    accepted = sorted(score(t) for t in texts["allow"] if held_out(t))
    threshold = min(0.0, accepted[int(0.01 * len(accepted))])
    want = [(k, h, p, rule, verdict or ("block" if score(h + p) < threshold - 1e-12 else "allow")) for k, (h, p, rule, verdict) in enumerate(parsed)]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = sorted(judge_urls(rows.repartition(3)).collect())
    assert [tuple(r)[:5] for r in got] == want
    assert [r.score for r in got] == pytest.approx([score(h + p) for h, p, _, _ in parsed], abs=1e-9)
    assert {w[4] for w in want if w[3] is None} == {"allow", "block"}


def test_every_labelled_url_counts(spark, monkeypatch):
    """The fit sees all labelled URLs: its 1-gram counts are the characters of all that are not held out."""
    from siftwork.llm import urls as U
    rows = [f"https://h{k}.net/{k}" for k in range(21_000)] + [f"https://h{k}.org/fr/{k}" for k in range(21_000)] + ["https://h1.info/fr/5"]
    seen = {}
    kept = U.gram_ratios

    def watched(texts, order, work):
        fitted = texts.filter("labelled and not held_out").groupBy("verdict").count().collect()
        seen.update({r.verdict: r["count"] for r in fitted})
        return kept(texts, order, work)

    monkeypatch.setattr(U, "gram_ratios", watched)
    scored = judge_urls(spark.createDataFrame(list(enumerate(rows)), "page_id bigint, url string"))
    assert scored.count() == len(rows)
    assert all(16_400 < seen[kind] < 17_200 for kind in ("allow", "block"))


def test_threshold_is_the_exact_rank(spark):
    from siftwork.llm.urls import calibrated
    values = [-((k * 7919) % 30_011) / 1000 for k in range(30_011)] + [-29.5] * 50
    df = spark.createDataFrame([(v, True, True, "allow") for v in values], "score double, held_out boolean, labelled boolean, verdict string").repartition(7)
    for share in (0.0, 0.001, 0.01, 0.5, 0.99):
        assert calibrated(df, share) == min(0.0, sorted(values)[int(share * len(values))])
