"""Prediction by partial matching: a byte-context trie, escape estimation and symbol exclusion, as sorted arrays.

Contexts have up to ``order`` bytes; a text is preceded by ``order`` zero bytes, so every byte has a full context and the
counts of shorter contexts are sums of those of longer ones. A model may hold a part of the nodes, contexts and the bytes
after them; it is exact for a gram if it has all nodes of the gram's contexts.

At a byte, the longest known context predicts it with (n - 1/2)/n(c), n its count, n(c) the sum of the context's, or escapes
with the rest, half the number of the context's bytes (method D). Shorter contexts leave out the bytes that the longer one
had; below order 0 stands a uniform distribution over the bytes left. The probabilities of the 256 bytes sum to 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BYTE = np.int64(8)


def mask(k: int) -> np.int64:
    return np.int64((1 << (8 * k)) - 1)


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For each byte of each row the last ``order`` bytes before it, zeros before the row, and itself, as one number."""
    n = len(data)
    out = data.astype(np.int64)
    at = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, order + 1):
        shifted = np.zeros(n, np.int64)
        shifted[k:] = data[:-k] if k < n else 0
        shifted[at < k] = 0
        out |= shifted << np.int64(8 * k)
    return out


@dataclass
class Level:
    """Nodes of one order by key (context and byte), contexts by key, and what arriving there costs (natural logs)."""

    nodes: np.ndarray
    log_n: np.ndarray
    contexts: np.ndarray
    log_first: np.ndarray
    log_escape: np.ndarray
    #: Arriving at the next shorter context from this one by escape: denominator and escape there.
    log_below: np.ndarray
    log_below_escape: np.ndarray


def _log(x: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(x, 1e-300))


@dataclass
class Model:
    levels: list[Level]
    log_uniform: float

    @staticmethod
    def build(tables: list[tuple[np.ndarray, np.ndarray]]) -> "Model":
        """From the (keys, counts) of orders 0 and up, keys sorted."""
        parts = []
        for k, (keys, n) in enumerate(tables):
            n = n.astype(np.float64)
            contexts, first = np.unique(keys >> _BYTE, return_index=True) if k else (np.zeros(1, np.int64), np.zeros(1, np.int64))
            whole = np.add.reduceat(n, first) if len(n) else np.zeros(len(contexts))
            parts.append((keys, n, contexts, first, whole, np.diff(np.append(first, len(keys))).astype(np.float64)))
        levels = []
        for k, (keys, n, contexts, first, whole, distinct) in enumerate(parts):
            below, below_escape = np.zeros(len(contexts)), np.zeros(len(contexts))
            if k and len(keys):
                lower_keys, lower_n, lower_contexts, _, lower_whole, lower_distinct = parts[k - 1]
                excluded = np.add.reduceat(lower_n[np.searchsorted(lower_keys, keys & mask(k))], first)
                at = np.searchsorted(lower_contexts, contexts & mask(k - 1))
                below, below_escape = lower_whole[at] - excluded, (lower_distinct[at] - distinct) / 2
                stuck = below <= 0
                below, below_escape = np.where(stuck, 1.0, below), np.where(stuck, 1.0, below_escape)
            levels.append(Level(keys, _log(n - 0.5), contexts, _log(whole), _log(distinct / 2), _log(below), _log(below_escape)))
        used = len(tables[0][0])
        return Model(levels, -float(np.log(max(1, 256 - used))))

    def log_probability(self, g: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each gram's last byte after the bytes before it."""
        out = np.zeros(len(g))
        open_ = np.arange(len(g))
        came = np.full(len(g), -1)  # the context of the order above from which it escaped
        for k in range(len(self.levels) - 1, -1, -1):
            level, above = self.levels[k], self.levels[k + 1] if k + 1 < len(self.levels) else None
            if not len(open_):
                break
            own = g[open_]
            context = (own >> _BYTE) & mask(k)
            at = np.minimum(np.searchsorted(level.contexts, context), max(len(level.contexts) - 1, 0))
            there = level.contexts[at] == context if len(level.contexts) else np.zeros(len(own), bool)
            key = own & mask(k + 1)
            node = np.minimum(np.searchsorted(level.nodes, key), max(len(level.nodes) - 1, 0))
            hit = there & (level.nodes[node] == key) if len(level.nodes) else np.zeros(len(own), bool)
            escaped = came >= 0
            low, low_escape = level.log_first[at] if len(level.contexts) else 0, level.log_escape[at] if len(level.contexts) else 0
            if above is not None and len(above.contexts):
                low = np.where(escaped, above.log_below[came], low)
                low_escape = np.where(escaped, above.log_below_escape[came], low_escape)
            add = np.where(hit, (level.log_n[node] if len(level.nodes) else 0) - low, low_escape - low)
            out[open_] += np.where(there, add, 0.0)
            came = np.where(there, at, -1)[~hit]
            open_ = open_[~hit]
        out[open_] += self.log_uniform
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 of the probability of each row of bytes."""
        if not len(data):
            return np.zeros(len(offsets) - 1)
        coded = pa.array(grams(data, offsets, len(self.levels) - 1)).dictionary_encode()
        words = coded.dictionary.to_numpy()
        order = np.argsort(words)
        logs = np.empty(len(words))
        logs[order] = self.log_probability(words[order])
        total = np.concatenate([[0.0], np.cumsum(logs[coded.indices.to_numpy()])])
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.log(10)
