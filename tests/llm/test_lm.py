import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from benchloom.llm import lm, ppm, queries


def brute_base(rows):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    tokens = [(t or "").encode().lower().split() + [None] for _, t in rows]
    c = Counter(w for h, ts in zip(held, tokens) if not h for w in ts)
    n, v = sum(c.values()), len(c)
    return [(i, h, len(ts), sum(c[w] > 0 for w in ts), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ts)) for (i, _), h, ts in zip(rows, held, tokens)]


def brute_ppm(training, texts, order):
    """Method D with exclusion, byte by byte over dictionaries."""
    trie = defaultdict(Counter)
    for t in training:
        s = bytes(order) + t
        for i in range(order, len(s)):
            for k in range(order + 1):
                trie[s[i - k : i]][s[i]] += 1
    out = []
    for t in texts:
        s, total = bytes(order) + t, 0.0
        for i in range(order, len(s)):
            out_of, p = set(), 1.0
            for k in range(order, -1, -1):
                seen = {b: n for b, n in trie.get(s[i - k : i], {}).items() if b not in out_of}
                if s[i - k : i] not in trie or not trie[s[i - k : i]]:
                    continue
                if not seen:
                    continue
                n = sum(seen.values())
                if s[i] in seen:
                    p *= (seen[s[i]] - 0.5) / n
                    break
                p *= len(seen) / 2 / n
                out_of |= set(seen)
            else:
                p /= 256 - len(out_of)
            total += math.log10(p)
        end = (len(training) + 1) / (sum(map(len, training)) + len(training) + 2)
        out.append(total + len(t) * math.log10(1 - end) + math.log10(end))
    return out


def corpus(n=150, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    return [(i, " ".join(rng.choice(words) + rng.choice(["", "", "X", "\t"]) for _ in range(rng.randrange(30)))) for i in range(n)]


@pytest.mark.parametrize("word_share", [1.0, 0.01, 2.0**-20])
def test_scores_match_brute_force(spark, word_share):
    rows = corpus() + [(1000, None), (1001, ""), (None, "a b"), (7, "twice"), (7, "twice"), (1002, "unseen zzz " * 9)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, held_out int")
    got = sorted(lm.score(df, order=3, share=0.0, word_share=word_share).collect(), key=str)
    base = brute_base(rows)
    training = [(t or "").encode() for (_, t), b in zip(rows, base) if not b[1]]
    own = brute_ppm(training, [(t or "").encode() for _, t in rows], 3)
    want = sorted(zip(base, own), key=lambda x: str((x[0][0], x[0][2])))
    got = sorted(got, key=lambda r: str((r.doc_id, r.n_tokens)))
    for r, (b, s) in zip(got, want, strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == b[:5]
        assert r.base_score == pytest.approx(b[5], abs=1e-9) and r.score == pytest.approx(s, abs=1e-9)


@pytest.mark.parametrize("share", [0.0, 0.001, 0.02])
def test_probabilities_sum_to_one(share):
    data = "\n".join(t for _, t in corpus(300)).encode()
    a, offsets = np.frombuffer(data, np.uint8), np.array([0, len(data)])
    u, n = np.unique(ppm.grams(a, offsets, 4), return_counts=True)
    tables = []
    for k in range(5):
        keys, at = np.unique(u & ppm.mask(k + 1), return_inverse=True)
        m = np.bincount(at, n).astype(int)
        keep = (m >= share * len(data)) | (k < 2)
        tables.append((keys[keep], m[keep]))
    model = ppm.Model.build(tables)
    for g in [*u[:: len(u) // 30], 0, 0xFFFFFFFFFF]:
        context = (int(g) >> 8) << 8
        assert np.exp(model.log_probability(context | np.arange(256))).sum() == pytest.approx(1)


def test_longer_contexts_predict_held_out_rows_better(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sums = [lm.score(docs, order=k).filter("held_out").agg(F.sum("score")).first()[0] for k in (1, 3, 5)]
    assert sums[0] * 0.85 < sums[1] and sums[1] * 0.95 < sums[2]


def test_without_training_rows(spark):
    df = spark.createDataFrame([(i, "ab") for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    r = lm.score(df).first()
    assert (r.n_known, r.train_tokens) == (0, 0) and r.score == pytest.approx(-2 * math.log10(256) + 3 * math.log10(0.5))
    assert lm.score(df.filter(F.lit(False))).count() == 0


def assert_exact(spark, rows, own, order, **parameters):
    """Scores of the rows at ``own`` against brute force over all training rows."""
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score(df, order=order, **parameters).collect()}
    training = [t.encode() for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    want = brute_ppm(training, [rows[i][1].encode() for i in own], order)
    assert [got[rows[i][0]] for i in own] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("order", [2, 4, 5])
@pytest.mark.parametrize("share", [0.001, 1.0])
def test_share_changes_no_score(spark, monkeypatch, order, share):
    monkeypatch.setattr(lm, "BUCKET_NODES", 100)
    assert_exact(spark, corpus(), range(150), order, share=share)


def test_own_parameters_match_brute_force_on_megabytes(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(20_000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(500))) for i in range(1000)]
    assert sum(len(t) for _, t in rows) * 6 / 7 > 2**21
    assert_exact(spark, rows, range(0, 1000, 50), 5)
