"""A hierarchical navigable small-world graph as flat neighbour arrays, built and searched for many points at once.

Vectors get one more component so that all have the same length; then the largest inner product is the nearest point. Each
step of a search expands the best unvisited candidates of all queries together, as array operations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BATCH = 256
_EXPAND = 4


@dataclass
class Graph:
    """vectors: n × d; layers: for each level from 0 an n × width array of neighbours, -1: none; node 0 is the entry."""

    vectors: np.ndarray
    layers: list[np.ndarray]


def _beam(vectors: np.ndarray, layer: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``ef`` best nodes found for each query from its entries, best first: ids (-1: none) and inner products."""
    b = len(queries)
    visited = np.zeros((b, len(vectors)), bool)
    rows = np.arange(b)[:, None]
    ids = np.full((b, ef), -1, np.int64)
    sims = np.full((b, ef), -np.inf, np.float32)
    m = min(entry.shape[1], ef)
    ids[:, :m] = entry[:, :m]
    have = ids >= 0
    sims[have] = np.einsum("ij,ij->i", vectors[ids[have]], queries[np.nonzero(have)[0]])
    visited[np.nonzero(have)[0], ids[have]] = True
    todo = have.copy()
    active = np.arange(b)
    while len(active):
        open_ = np.where(todo[active], sims[active], -np.inf)
        pick = np.argpartition(-open_, min(_EXPAND, ef) - 1, axis=1)[:, :_EXPAND] if ef > _EXPAND else np.argsort(-open_, axis=1)[:, :_EXPAND]
        worth = np.take_along_axis(open_, pick, 1) > -np.inf
        go = worth.any(1)
        active, pick, worth = active[go], pick[go], worth[go]
        if not len(active):
            break
        todo[active[:, None], pick] = False
        near = layer[np.where(worth, ids[active[:, None], pick], 0)]
        near[~worth] = -1
        near = near.reshape(len(active), -1)
        fresh = (near >= 0) & ~visited[active[:, None], near]
        # A node that several expanded ones share is taken once.
        order = np.argsort(near, axis=1, kind="stable")
        ordered = np.take_along_axis(near, order, 1)
        twice = np.zeros_like(fresh)
        twice[:, 1:] = ordered[:, 1:] == ordered[:, :-1]
        again = np.zeros_like(fresh)
        np.put_along_axis(again, order, twice, 1)
        fresh &= ~again
        r, c = np.nonzero(fresh)
        visited[active[r], near[r, c]] = True
        new = np.full(near.shape, -np.inf, np.float32)
        new[r, c] = np.einsum("ij,ij->i", vectors[near[r, c]], queries[active[r]])
        all_sims = np.concatenate([sims[active], new], 1)
        keep = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
        ids[active] = np.take_along_axis(np.concatenate([ids[active], near], 1), keep, 1)
        todo[active] = np.take_along_axis(np.concatenate([todo[active], fresh], 1), keep, 1)
        sims[active] = np.take_along_axis(all_sims, keep, 1)
        todo[active] &= sims[active] > -np.inf
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    ids[sims == -np.inf] = -1
    del rows
    return ids, sims


def _diverse(vectors: np.ndarray, candidates: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """Of each row's candidates (best first, -1: none) those closer to the point than to any chosen before; filled up with the rest."""
    b, c = candidates.shape
    among = vectors[np.maximum(candidates, 0)]
    between = among @ among.transpose(0, 2, 1)
    chosen = np.zeros((b, c), bool)
    count = np.zeros(b, int)
    for i in range(c):
        blocked = (chosen & (between[:, i] > sims[:, i : i + 1])).any(1)
        chosen[:, i] = ~blocked & (candidates[:, i] >= 0) & (count < m)
        count += chosen[:, i]
    rank = np.where(candidates < 0, 2 * c, np.where(chosen, 0, c)) + np.arange(c)
    order = np.argsort(rank, axis=1)[:, :m]
    out = np.take_along_axis(candidates, order, 1)
    if out.shape[1] < m:
        out = np.concatenate([out, np.full((b, m - out.shape[1]), -1)], 1)
    return out


def _link(vectors: np.ndarray, layer: np.ndarray, new: np.ndarray, neighbours: np.ndarray) -> None:
    """Stores the neighbours of new nodes, and the new nodes among their neighbours' own, which are chosen again if full."""
    width = layer.shape[1]
    layer[new, : neighbours.shape[1]] = neighbours
    source = np.repeat(new, neighbours.shape[1])
    target = neighbours.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    if not len(target):
        return
    nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
    for at in range(0, len(nodes), BATCH):
        own = nodes[at : at + BATCH]
        most = int(counts[at : at + BATCH].max())
        added = np.full((len(own), most), -1, np.int64)
        for k, (f, n) in enumerate(zip(first[at : at + BATCH], counts[at : at + BATCH], strict=True)):
            added[k, :n] = source[f : f + n]
        both = np.concatenate([layer[own], added], 1)
        sims = np.einsum("ijk,ik->ij", vectors[np.maximum(both, 0)], vectors[own]).astype(np.float32)
        sims[both < 0] = -np.inf
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * width]
        layer[own] = _diverse(vectors, np.take_along_axis(both, order, 1), np.take_along_axis(sims, order, 1), width)


def build(vectors: np.ndarray, m: int = 16, ef: int = 80, seed: int = 7) -> tuple[Graph, np.ndarray]:
    """The graph over rows of ``vectors`` and the row of each of its nodes."""
    n = len(vectors)
    v = vectors.astype(np.float32)
    squares = np.einsum("ij,ij->i", v.astype(np.float64), v.astype(np.float64))
    v = np.concatenate([v, np.sqrt(np.maximum(squares.max() - squares, 0)).astype(np.float32)[:, None]], 1)
    level = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(m)).astype(int), 6)
    row = np.lexsort((np.random.default_rng(seed + 1).random(n), np.where(np.arange(n) == np.argmax(level), 0, 1)))
    v, level = v[row], level[row]
    layers = [np.full((n, 2 * m if k == 0 else m), -1, np.int32) for k in range(int(level[0]) + 1)]
    done = 1
    while done < n:
        stop = min(n, done + min(BATCH, max(1, done)))
        new = np.arange(done, stop)
        entry = np.zeros((len(new), 1), np.int64)
        for k in range(len(layers) - 1, -1, -1):
            here = new[level[new] >= k]
            wide = level[new] >= k
            ids, _ = _beam(v, layers[k], v[new], entry, ef if wide.any() else 4)
            entry = ids[:, : max(4, m // 2)]
            if len(here):
                # Nodes of one batch do not find each other in the graph: their own nearest are added.
                among = v[here] @ v[here].T
                np.fill_diagonal(among, -np.inf)
                take = min(m, len(here) - 1)
                own = here[np.argpartition(-among, take - 1, axis=1)[:, :take]] if take else np.zeros((len(here), 0), np.int64)
                both = np.concatenate([ids[wide], own], 1)
                sims = np.einsum("ijk,ik->ij", v[np.maximum(both, 0)], v[here]).astype(np.float32)
                sims[both < 0] = -np.inf
                order = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * m]
                _link(v, layers[k], here, _diverse(v, np.take_along_axis(both, order, 1), np.take_along_axis(sims, order, 1), m))
        done = stop
    return Graph(v, layers), row


def search(graph: Graph, queries: np.ndarray, k: int, ef: int) -> np.ndarray:
    """The ids of up to ``k`` nodes of large inner product with each query, best first, -1 where fewer are found."""
    q = np.concatenate([queries.astype(np.float32), np.zeros((len(queries), 1), np.float32)], 1)
    out = np.full((len(q), k), -1, np.int64)
    for at in range(0, len(q), BATCH):
        part = q[at : at + BATCH]
        entry = np.zeros((len(part), 1), np.int64)
        for level in range(len(graph.layers) - 1, 0, -1):
            entry = _beam(graph.vectors, graph.layers[level], part, entry, 8)[0]
        ids = _beam(graph.vectors, graph.layers[0], part, entry, max(ef, k))[0][:, :k]
        out[at : at + len(part), : ids.shape[1]] = ids
    return out
