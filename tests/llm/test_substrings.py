import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from benchloom.llm import induce, queries, substrings


def brute(rows, width):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if count[t[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    make = lambda k: "".join(rng.choice("abcé \n") for _ in range(k))
    passages = [make(rng.choice([40, 60, 70, 150])) for _ in range(6)]
    rows = []
    for i in range(n):
        t = "".join(rng.choice([make(rng.randrange(80)), rng.choice(passages)]) for _ in range(rng.randrange(6)))
        if rows and rng.random() < 0.3:
            t = rng.choice(rows)[1] or ""
            at = rng.randrange(len(t) + 1)
            t = t[:at] + rng.choice(["", "X", "YZ"]) + t[at:]
        rows.append((i, t))
    return rows + [(900, None), (901, ""), (None, "a" * 300), (902, "ab" * 200), (903, "x" * 59), (904, "x" * 60), (905, "x" * 61), (906, passages[0] * 4), (3, rows[3][1])]


@pytest.mark.parametrize(("seed", "k"), [(1, 16), (2, 30), (3, 60)])
def test_matches_brute_force(spark, seed, k):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, low int").repartition(3)
    got = sorted((tuple(r) for r in substrings.remove_repeats(df, 60, k=k).collect()), key=str)
    assert got == brute(rows, 60)


def test_joins_without_broadcast_and_small_shards(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BROADCAST", 0)
    monkeypatch.setattr(substrings, "SHARD", 500)
    rows = corpus(4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = substrings.remove_repeats(df, 60, k=20, with_text=True).collect()
    assert sorted((tuple(r)[:5] for r in out), key=str) == brute(rows, 60)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in out)


def test_common_anchors(spark, monkeypatch):
    monkeypatch.setattr(substrings, "COMMON", 0.0)
    monkeypatch.setattr(substrings, "LOCAL", 2)
    rng = random.Random(9)
    line = "a common line of words that many documents hold, again and again, as it stands. "
    rows = corpus(6) + [(2000 + i, line * rng.randrange(1, 5) + str(i) * rng.randrange(3) + line[rng.randrange(30) :]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in substrings.remove_repeats(df, 60, k=20).collect()), key=str) == brute(rows, 60)


@pytest.mark.parametrize(("split", "k"), [(400, 20), (1500, 37), (600, 30)])
def test_large_anchors_are_dealt_by_more_of_their_content(spark, monkeypatch, split, k):
    """One line in many surroundings: its anchors' spans all differ, and no task gets a group beyond the bound."""
    monkeypatch.setattr(substrings, "SPLIT", split)
    seen = {"sorted": [], "grown": 0}
    own_sorted, own_grown = substrings._sorted, substrings._grown

    def sort(pieces, width):
        groups = pieces.groupBy("anchor").agg(F.sum(F.octet_length("bytes")).alias("b"))
        seen["sorted"].append(groups.agg(F.max("b")).first()[0])
        return own_sorted(pieces, width)

    def grow(*args):
        seen["grown"] += 1
        return own_grown(*args)

    monkeypatch.setattr(substrings, "_sorted", sort)
    monkeypatch.setattr(substrings, "_grown", grow)
    rng = random.Random(12)
    make = lambda m: "".join(rng.choice("abcdé \n") for _ in range(m))
    short, long = make(45), make(75)
    rows = corpus(8, 30) + [(3000 + i, make(rng.randrange(50)) + rng.choice([short, long]) + make(rng.randrange(50))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in substrings.remove_repeats(df, 60, k=k).collect()), key=str) == brute(rows, 60)
    assert seen["grown"] > 2 and max(seen["sorted"]) <= split


def test_texts_with_one_hash_are_told_apart(spark, monkeypatch):
    rows = corpus(7)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    own = substrings.F.xxhash64
    few = lambda *c: own(*c) % 5 if [str(x) for x in c] == ["text"] else own(*c)
    monkeypatch.setattr(substrings.F, "xxhash64", few)
    assert sorted((tuple(r) for r in substrings.remove_repeats(df, 60, k=20).collect()), key=str) == brute(rows, 60)


def test_empty_table(spark):
    df = spark.createDataFrame(corpus(1), "doc_id long, text string")
    assert substrings.remove_repeats(df.filter(F.lit(False))).count() == 0


@pytest.mark.parametrize("text", [b"", b"a", b"ab", b"ba", b"banana", b"mississippi", b"a" * 500, b"ab" * 300, b"\0\0\1\0", bytes(range(256)) * 3, b"abcabcabdabc" * 40])
@pytest.mark.parametrize("memory", [1 << 20, 3])
def test_suffix_arrays(text, memory):
    a = np.frombuffer(text, np.uint8)
    order, shared = induce.suffix_array(a, memory, 50)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    assert shared.tolist() == [common(text, i, j, 50) for i, j in zip(order[:-1], order[1:])] == induce.common_prefixes(a, order, 50).tolist()


def common(text, i, j, limit):
    x, y = text[i : i + limit], text[j : j + limit]
    return next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))


def test_random_suffix_arrays():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a = rng.integers(0, rng.integers(1, 5), rng.integers(2, 300)).astype(np.uint8)
        text = a.tobytes()
        order, shared = induce.suffix_array(a, int(rng.integers(1, 400)), 30)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        assert shared.tolist() == [common(text, i, j, 30) for i, j in zip(order[:-1], order[1:])]


def test_a_shard_larger_than_memory(monkeypatch):
    """Queues of a thousand suffixes for a shard of 300,000 bytes."""
    monkeypatch.setattr(induce, "STEP", 500)
    rng = np.random.default_rng(2)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)) for _ in range(500)]
    parts = [b" ".join(words[i] for i in rng.integers(0, 500, 900)) for _ in range(50)]
    parts += [parts[3][100:900] + b"x" + parts[7][:500], parts[9][50:]]
    whole = b"".join(parts)
    order, shared = induce.suffix_array(np.frombuffer(whole, np.uint8), 1000, 60)
    assert (shared == induce.common_prefixes(np.frombuffer(whole, np.uint8), order, 60)).all()
    count = Counter(p[i : i + 60] for p in parts for i in range(len(p) - 59))
    want = np.concatenate([[count[p[i : i + 60]] > 1 if i + 60 <= len(p) else False for i in range(len(p))] for p in parts])
    assert (substrings.repeated_starts(parts, 60, 1000) == want).all()


def test_query_over_a_whole_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in queries.op5_substrings(spark, d).collect()), key=str) == brute(rows, 200)
