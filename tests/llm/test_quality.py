import numpy as np
import pytest
from pyspark.sql import functions as F

from benchloom.llm import quality

D = "/root/testdata/sf0.1"


def strength(within, variance):
    return min(max(within / max(variance, 1e-9) - 1, 2.0), 1e4)


def brute_sites(sums, rate):
    """host, path -> posterior, from {(host, path): (n, s)}."""
    hosts = {}
    for (h, _), (n, s) in sums.items():
        a, b = hosts.get(h, (0, 0))
        hosts[h] = a + n, b + s
    total = sum(n for n, _ in hosts.values())
    w = rate * (1 - rate)
    k1 = strength(w, sum(n * (s / n - rate) ** 2 for n, s in hosts.values()) / total - len(hosts) * w / total)
    post = {h: (k1 * rate + s) / (k1 + n) for h, (n, s) in hosts.items()}
    w = sum(n * post[h] * (1 - post[h]) for (h, _), (n, _) in sums.items()) / total
    v = sum(n * (s / n - post[h]) ** 2 for (h, _), (n, s) in sums.items()) / total
    k2 = strength(w, v - len(sums) * w / total)
    return {key: (k2 * post[key[0]] + s) / (k2 + n) for key, (n, s) in sums.items()}


def test_site_posteriors_match_brute_force(spark):
    rng = np.random.default_rng(1)
    sums = {}
    for h in range(12):
        base = rng.beta(3, 5)
        for p in range(rng.integers(1, 6)):
            n = int(rng.integers(1, 200))
            sums[f"h{h}", f"p{p}"] = n, float(n * np.clip(base + rng.normal(0, 0.1), 0.01, 0.99))
    df = spark.createDataFrame([(h, p, n, s) for (h, p), (n, s) in sums.items()], "host string, path string, n long, s_good double")
    got = {(r.host, r.path): r.site_good for r in quality.site_rates(df, "good", 0.4)[0].collect()}
    assert got == pytest.approx(brute_sites(sums, 0.4), abs=1e-9)
    # A sparse path lies between its own rate and its host's.
    (key, (n, s)) = min(sums.items(), key=lambda x: x[1][0])
    assert abs(got[key] - s / n) > 1e-6


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    labels = spark.read.parquet(f"{D}/labels.parquet")
    rows = quality.classify(docs, labels.filter("doc_id % 2 = 0"), keep=["doc_id"]).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    good = [(r.quality, r.quality_probability >= 0.5) for r in rows]
    toxic = [(r.toxic, r.toxic_probability >= 0.5) for r in rows]
    assert sum(a == b for a, b in good) >= 0.99 * len(good)
    clean = [r for r in rows if r.quality and not r.toxic]
    assert sum(r.accepted for r in clean) >= 0.99 * len(clean)
    assert sum(b for a, b in toxic if a) >= 0.75 * sum(a for a, _ in toxic)


def test_broadcast_and_join_agree(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    key = lambda r: (r.doc_id, round(r.quality_probability, 9), round(r.toxic_probability, 9), r.accepted)
    one = sorted(map(key, quality.classify(docs, labels, keep=["doc_id"]).collect()))
    monkeypatch.setattr(quality, "BROADCAST_SITES", 0)
    assert sorted(map(key, quality.classify(docs, labels, keep=["doc_id"]).collect())) == one


def test_nulls_missing_labels_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, None, None, 5), (1, "", "a.org/x/y", "en", 6), (None, "text!", "https://a.org/x", "en", 7)], "doc_id long, text string, source string, lang string, accepted int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 3 and all(r.accepted for r in rows)
    assert quality.classify(docs.filter(F.lit(False)), labels).count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, 1)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, labels).count() == 3


def test_sites():
    from pyspark.sql import SparkSession

    s = SparkSession.getActiveSession()
    df = s.createDataFrame([("https://a.org:80/b/c?d", "en"), ("src1", None), (None, "de"), ("a.org/b", "fr")], "source string, lang string")
    got = [tuple(r) for r in df.select(quality.host_of(F.col("source")), quality.path_of(F.col("source"), F.col("lang"))).collect()]
    assert got == [("a.org:80", "b|en"), ("src1", "|"), ("", "|de"), ("a.org", "b|fr")]


def test_every_associated_word_counts(spark):
    rng = np.random.default_rng(4)
    name = lambda i: "w" + "".join(chr(97 + int(c)) for c in str(i))
    texts = [[name(j) for j in rng.integers(0, 300, 20)] for _ in range(1500)]
    for i in range(300):
        texts[i] += [name(1000 + j) for j in rng.integers(0, 600, 20)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i < 300)) for i in range(1500)], "doc_id long, quality int, toxic int")
    want = set()
    for w in {w for t in texts for w in t}:
        has = [i for i, t in enumerate(texts) if w in t]
        expected = len(has) * 0.2
        if len(has) >= 3 and (sum(i < 300 for i in has) - expected) / np.sqrt(expected * 0.8 + 0.5) > 3.5:
            want.add(w)
    assert len(want) > 450
    data = " ".join(sorted(want)).encode()
    hashes = quality.features(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[1]
    model = quality.fit(docs, labels)
    assert set(model.words.tolist()) == set(hashes.tolist())


def test_sparse_weights_are_a_minimum():
    rng = np.random.default_rng(5)
    x = (rng.random((300, 12)) < 0.2).astype(float)
    y = (x[:, 0] + x[:, 1] + rng.random(300) > 1.1).astype(int)
    row, column = np.nonzero(x)
    w = quality._sparse_logistic(row, column, 12, y, 0.5, 5000)
    cost = lambda w: np.logaddexp(0, x @ w[:-1] + w[-1]).sum() - y @ (x @ w[:-1] + w[-1]) + 0.5 * np.abs(w[:-1]).sum()
    assert all(cost(w) <= cost(w + rng.normal(0, s, 13)) + 1e-6 for s in (0.1, 0.01, 0.001) for _ in range(200))


def test_query_matches_brute_force(spark):
    from benchloom.llm import queries

    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.select("doc_id", "quality", "toxic"))
    rows, sums = docs.collect(), {}
    logit, clip = (lambda p: np.log(p / (1 - p))), (lambda z: 1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))
    odds, sites = [], []
    for r in rows:
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        odds.append([float(x[0]) for x in model.log_odds(data, np.array([0, len(data)]))])
        host, _, rest = (r.source or "").split("://")[-1].partition("/")
        sites.append((host.split("?")[0].split("#")[0], f"{rest.split('/')[0].split('?')[0].split('#')[0]}|{r.lang or ''}"))
    kept = []
    for kind in range(2):
        sums = {}
        for s, o in zip(sites, odds):
            n, t = sums.get(s, (0, 0.0))
            sums[s] = n + 1, t + clip(o[kind])
        rate = (sum(t for _, t in sums.values()) + 1) / (len(rows) + 2)
        post = brute_sites(sums, rate)
        kept.append([clip(o[kind] - logit(rate) + logit(post[s])) for s, o in zip(sites, odds)])
    want = {r.doc_id: (g, t) for r, g, t in zip(rows, *kept) if g >= 0.5 and t < 0.5}
    got = {r.doc_id: (r.quality_probability, r.toxic_probability) for r in queries.op10_quality(spark, d).collect()}
    assert got.keys() == want.keys()
    for k, v in got.items():
        assert v == pytest.approx(want[k], abs=1e-6)
