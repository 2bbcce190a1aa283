"""Quality classifier: evidence of a document's text, shrunk by hierarchical empirical Bayes over its site.

Two questions, good or junk and toxic or not, have a text model each, fitted on at most ``sample`` labelled rows (those
of smallest id hash; texts that repeat count once). Good: logistic regression on the text's shape. Toxic: on the presence
of words that the sample's labels are associated with, with an absolute-value penalty, so that few words carry it.

Sites: the probabilities of all documents are summed by host and by host and path (partial sums before the shuffle). A
host's rate is shrunk towards the global one, a path's towards its host's, by beta-binomial strengths estimated from the
variance between them; a sparse site stays near its prior. A document's log odds are those of its path plus what its text
adds to the global odds. Sites are sent to all tasks only up to ``BROADCAST_SITES`` rows, beyond that they are joined.

Defined results: a null or empty text has an empty shape, a null source is the site ''; a table without labels of both
kinds leaves everything at the prior: it is kept; repeated rows count as often as they appear; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from benchloom.llm.common import distinct_by_row, free_names, materialize, text_chunks, word_hashes

BROADCAST_SITES = 200_000
SHAPE = ("log_words", "upper", "bangs", "bars", "symbols", "digits", "top_word", "repeats", "word_length", "other")
_GAPS = np.ones(256, bool)
_GAPS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


_CLASSES = [_class(bytes(range(65, 91))), _class(b"!"), _class(b"|"), _class(b"#$%&*@^~<>{}\\=+_"), _class(b"0123456789"), _class(bytes([*range(97, 123), *range(128, 256)])), _class(b"\t\n\x0b\x0c\r ")]


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """SHAPE of each row of bytes, and the distinct words (letters only) as hashes with their rows."""
    rows = len(offsets) - 1
    words, start, end, before = word_hashes(data, offsets, _GAPS)
    n = np.diff(before).astype(float)
    row = np.repeat(np.arange(rows), np.diff(before))
    sums = [np.diff(np.concatenate([[0], np.cumsum(c[data])])[offsets]).astype(float) for c in _CLASSES]
    upper, bangs, bars, symbols, digits, lower, space = sums
    h, r = distinct_by_row(words, row)
    order = np.lexsort((words, row))
    sh, sr = words[order], row[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (sr[1:] != sr[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(sh)))
    top = np.zeros(rows)
    np.maximum.at(top, sr[first], times)
    distinct = np.bincount(r, minlength=rows)
    size = np.diff(offsets).astype(float)
    letters = np.bincount(row, end - start, rows)
    safe = n + 5
    shape = np.stack([
        np.log1p(n), upper / (upper + lower + 5), np.minimum(bangs / safe, 1), np.minimum(bars / safe, 1), np.minimum(symbols / safe, 3), digits / (size + 20),
        np.maximum(top - 3, 0) / (n + 10), np.maximum(n - distinct - 5, 0) / (n + 10), np.minimum(letters / np.maximum(n, 1), 20), np.maximum(size - upper - lower - digits - space, 0) / (size + 20)], 1)
    return shape, h, r


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights with the intercept last: Newton steps with a ridge."""
    x = np.column_stack([x, np.ones(len(x), x.dtype)])
    w = np.zeros(x.shape[1])
    rate = (y.mean() * len(y) + 0.5) / (len(y) + 1)
    w[-1] = np.log(rate / (1 - rate))
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
    return w


def _sparse_logistic(row: np.ndarray, column: np.ndarray, columns: int, y: np.ndarray, lasso: float, steps: int = 400) -> np.ndarray:
    """Weights with the intercept last, of a matrix with ones at (row, column): proximal gradient steps with a lasso."""
    times = lambda w: np.bincount(row, w[column], len(y)) + w[-1]
    back = lambda r: np.append(np.bincount(column, r[row], columns), r.sum())
    w = np.zeros(columns + 1)
    rate = (y.mean() * len(y) + 0.5) / (len(y) + 1)
    w[-1] = np.log(rate / (1 - rate))
    # Of a matrix without negative cells, max (A v) / v over any positive v bounds the largest eigenvalue.
    v = np.ones(columns + 1)
    for _ in range(50):
        new = back(times(v))
        bound, v = (new / v).max(), new / new.max() + 1e-9
    z, t, rate = w.copy(), 1.0, 4.0 / max(bound, 1e-9)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(times(z), -30, 30)))
        new = z - rate * back(p - y)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * lasso, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w


@dataclass
class TextModel:
    """Log odds of good from SHAPE (standardised, clipped), of toxic from words; each with its prior rate."""

    center: np.ndarray = field(default_factory=lambda: np.zeros(len(SHAPE)))
    scale: np.ndarray = field(default_factory=lambda: np.ones(len(SHAPE)))
    good: np.ndarray | None = None
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    toxic: np.ndarray | None = None
    good_rate: float = 0.99
    toxic_rate: float = 0.01

    def log_odds(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape, h, r = features(data, offsets)
        rows = len(offsets) - 1
        odds = lambda p: np.full(rows, np.log(p / (1 - p)))
        good = np.clip((shape - self.center) / self.scale, -8, 8) @ self.good[:-1] + self.good[-1] if self.good is not None else odds(self.good_rate)
        if self.toxic is None:
            return good, odds(self.toxic_rate)
        at = np.minimum(np.searchsorted(self.words, h), max(len(self.words) - 1, 0))
        hit = self.words[at] == h if len(self.words) else np.zeros(len(h), bool)
        return good, np.bincount(r[hit], self.toxic[at[hit]], rows) + self.toxic[-1]


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, doc_id: str = "doc_id", text: str = "text") -> TextModel:
    """The text models of at most ``sample`` labelled documents; what reaches the driver is bounded by that."""
    chosen = labels.select(F.col("doc_id").alias("__id"), "quality", "toxic").dropna().dropDuplicates(["__id"]).orderBy(F.xxhash64("__id"), "__id").limit(sample)
    rows = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).join(F.broadcast(chosen), "__id")
    rows = materialize(rows.dropDuplicates(["text"]).select("text", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")), "labelled")

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_chunks(batch, "text"):
                shape, h, r = features(data, offsets)
                bounds = np.searchsorted(r, np.arange(len(offsets)))
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.ListArray.from_arrays(pa.array(np.arange(len(offsets)) * len(SHAPE), pa.int32()), pa.array(shape.ravel())), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(h.view(np.int64)))], ["quality", "toxic", "shape", "words"])

    seen = materialize(rows.mapInArrow(shapes, "quality int, toxic int, shape array<double>, words array<bigint>"), "shapes")
    table = seen.select("quality", "toxic", "shape").toArrow()
    quality, toxic = table.column("quality").to_numpy(), table.column("toxic").to_numpy()
    model = TextModel()
    if len(quality) and 0 < quality.mean() < 1:
        shape = np.array(table.column("shape").to_pylist())
        model.center, model.scale = shape.mean(0), shape.std(0) + 1e-3
        model.good, model.good_rate = _logistic(np.clip((shape - model.center) / model.scale, -8, 8), quality), float(quality.mean())
    if len(toxic) and 0 < toxic.mean() < 1:
        # Words whose presence is associated with the label beyond 3.5 standard errors.
        n, total = int(toxic.sum()), len(toxic)
        expected = F.col("n") * (n / total)
        score = (F.col("a") - expected) / F.sqrt(expected * (1 - n / total) + 0.5)
        counts = seen.select("toxic", F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"), F.sum("toxic").alias("a")).filter("n >= 3")
        best = counts.withColumn("score", score).filter("score > 3.5").select("w").toArrow()
        words = np.sort(best.column("w").to_numpy().view(np.uint64))
        sent = docs.sparkSession.sparkContext.broadcast(words)

        def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = sent.value
            for batch in batches:
                lists = batch.column(1)
                own = lists.flatten().to_numpy().view(np.uint64)
                at = np.minimum(np.searchsorted(words, own), max(len(words) - 1, 0))
                hit = words[at] == own if len(words) else np.zeros(len(own), bool)
                ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(hit)])[ends], pa.int32()), pa.array(at[hit], pa.int32()))], ["toxic", "at"])

        # Positions of each row's words: as many as the rows have, not rows times words.
        held = seen.select("toxic", "words").mapInArrow(present, "toxic int, at array<int>").toArrow()
        y, lists = held.column("toxic").to_numpy(), held.column("at").combine_chunks()
        row = np.repeat(np.arange(len(y)), lists.value_lengths().to_numpy())
        model.words, model.toxic, model.toxic_rate = words, _sparse_logistic(row, lists.flatten().to_numpy(), len(words), y, 0.5), float(toxic.mean())
    return model


def _moments(sums: DataFrame, parent: str, own: str) -> float:
    """Beta-binomial prior size: the variance of groups' rates around their parents', less the noise of their counts, as one aggregate."""
    r = sums.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * (F.col(own) - F.col(parent)) ** 2).alias("v"), F.sum(F.col("n") * F.col(parent) * (1 - F.col(parent))).alias("w")).first()
    if not r.n or not r.w:
        return 100.0
    within = r.w / r.n
    return float(min(max(within / max(r.v / r.n - r.k * within / r.n, 1e-9) - 1, 2.0), 1e4))


def site_rates(sums: DataFrame, kind: str, rate: float) -> tuple[DataFrame, float, float]:
    """host, path, n, and the path's posterior rate of ``kind`` given sums ``s_<kind>`` by host and path; both strengths."""
    hosts = sums.groupBy("host").agg(F.sum("n").alias("n"), F.sum(f"s_{kind}").alias("s"))
    by_host = hosts.withColumn("own", F.col("s") / F.col("n")).withColumn("parent", F.lit(rate))
    k1 = _moments(by_host, "parent", "own")
    hosts = hosts.select("host", ((F.lit(k1 * rate) + F.col("s")) / (k1 + F.col("n"))).alias("host_rate"))
    paths = sums.join(hosts, "host").withColumn("own", F.col(f"s_{kind}") / F.col("n"))
    k2 = _moments(paths, "host_rate", "own")
    return paths.select("host", "path", ((k2 * F.col("host_rate") + F.col(f"s_{kind}")) / (k2 + F.col("n"))).alias(f"site_{kind}")), k1, k2


def host_of(source: Column) -> Column:
    return F.regexp_extract(F.coalesce(source, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)", 1)


def path_of(source: Column, lang: Column) -> Column:
    """First path segment and language, the level below the host."""
    return F.concat_ws("|", F.regexp_extract(F.coalesce(source, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]*/([^/?#]*)", 1), F.coalesce(lang, F.lit("")))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", keep: list[str] | None = None, sample: int = 20_000) -> DataFrame:
    """``docs`` (columns ``keep``, default all) with quality and toxicity (probabilities) and accepted.

    Accepted: good at 0.5 or more and toxic under 0.5. Result columns are called quality_probability, toxic_probability and
    accepted; input columns of these names are replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample, doc_id, text))
    new = ("quality_probability", "toxic_probability", "accepted")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    host, path, good, toxic, body = free_names([*kept, text, *new, "site_good", "site_toxic"], "host", "path", "good", "toxic", "body")
    own = text if text in kept else body
    site = [host_of(F.col(f"`{source}`")).alias(host), path_of(F.col(f"`{source}`"), F.col(f"`{lang}`")).alias(path)]
    passed = [*kept, host, path]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_chunks(batch, own):
                odds = model.value.log_odds(data, offsets)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in passed], *map(pa.array, odds)], [*passed, good, toxic])

    # Texts are scored once; sums over sites and the result read what is written here.
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], *site, *([] if own in kept else [F.col(f"`{text}`").alias(own)]))
    schema = StructType([*[rows.schema[c] for c in passed], StructField(good, DoubleType()), StructField(toxic, DoubleType())])
    scored = materialize(rows.mapInArrow(run, schema), "scored")
    prior = model.value
    p = lambda c: 1 / (1 + F.exp(-F.least(F.greatest(F.col(c), F.lit(-30.0)), F.lit(30.0))))
    sums = materialize(scored.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(F.count("*").alias("n"), F.sum(p(good)).alias("s_good"), F.sum(p(toxic)).alias("s_toxic")), "sites")
    total = sums.agg(F.sum("n").alias("n"), F.sum("s_good").alias("g"), F.sum("s_toxic").alias("t"), F.count("*").alias("sites")).first()
    n = total.n or 0
    rates = {"good": (total.g + 1) / (n + 2), "toxic": (total.t + 1) / (n + 2)} if n else {"good": prior.good_rate, "toxic": prior.toxic_rate}
    sites = site_rates(sums, "good", rates["good"])[0].join(site_rates(sums, "toxic", rates["toxic"])[0], ["host", "path"])
    sites = sites.select(F.col("host").alias(host), F.col("path").alias(path), "site_good", "site_toxic")
    small = (total.sites or 0) <= BROADCAST_SITES
    rows = scored.join(F.broadcast(sites) if small else sites, [host, path], "left")

    def posterior(evidence: str, site_rate: str, rate: float) -> Column:
        r = F.coalesce(F.col(site_rate), F.lit(rate))
        z = F.col(evidence) - float(np.log(rate / (1 - rate))) + F.log(r / (1 - r))
        return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))

    p_good, p_toxic = posterior(good, "site_good", rates["good"]), posterior(toxic, "site_toxic", rates["toxic"])
    return rows.select(*[F.col(f"`{c}`") for c in kept], p_good.alias(new[0]), p_toxic.alias(new[1]), ((p_good >= 0.5) & (p_toxic < 0.5)).alias(new[2]))
