"""Search in flat proximity graphs, many queries at once; used inside tasks on bounded shards.

Vectors are unit rows, nearness is their inner product, and a graph is a table of neighbour
places padded with -1.
"""

import numpy as np

PRUNE_AT_ONCE = 256


def prune(vectors: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, alpha: float = 1.0, fill: bool = False) -> np.ndarray:
    """For each place in ``own`` at most ``degree`` of its candidates (-1: none), diverse ones.

    The nearest candidate is taken; those that are ``alpha`` times closer to it than to the node are
    dropped; and so on; with ``fill`` free slots go to the nearest dropped ones.  Distances are Euclidean, so squares are compared with alpha squared.
    """
    out = np.full((len(own), degree), -1, np.int32)
    for at in range(0, len(own), PRUNE_AT_ONCE):
        nodes, near = own[at : at + PRUNE_AT_ONCE], np.sort(candidates[at : at + PRUNE_AT_ONCE], axis=1)
        rows = np.arange(len(nodes))
        alive = (near >= 0) & (near != nodes[:, None])
        alive[:, 1:] &= near[:, 1:] != near[:, :-1]
        there = vectors[np.maximum(near, 0)]
        to_node = 1 - np.einsum("ncd,nd->nc", there, vectors[nodes])
        order = np.argsort(np.where(alive, to_node, np.inf), axis=1, kind="stable")
        near, to_node, alive = (np.take_along_axis(x, order, 1) for x in (near, to_node, alive))
        there = np.take_along_axis(there, order[:, :, None], 1)
        free = alive.copy()
        between = 1 - there @ there.transpose(0, 2, 1)
        for i in range(degree):
            first = alive.argmax(1)
            some = alive[rows, first]
            if not some.any():
                break
            out[at + rows[some], i] = near[rows[some], first[some]]
            free[rows[some], first[some]] = False
            alive &= alpha * alpha * between[rows, first] > to_node
            alive[rows, first] = False
        if fill:
            mine = out[at : at + len(nodes)]
            slots = np.argsort(mine < 0, axis=1, kind="stable")  # taken first
            taken = (mine >= 0).sum(1)
            column = taken[:, None] + np.cumsum(free, 1) - 1
            row, rank = np.nonzero(free & (column < degree))
            mine[row, slots[row, column[row, rank]]] = near[row, rank]
    return out


def search(
    vectors: np.ndarray, graph: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int, at_once: int = 2, within: float | None = None
) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Greedy search of a beam: ``(places, nearness)`` of the best ``width`` per query, -1 where fewer.

    ``entry`` has start places for all queries (1-d) or for each (2-d).  With ``within`` the search
    goes on from every place met that is at least that near, until such places are exhausted; the
    third result lists all of them as (query, place) pairs.
    """
    n, degree = len(queries), graph.shape[1]
    rows = np.arange(n)
    seen, done = np.zeros((n, len(vectors)), bool), np.zeros((n, len(vectors)), bool)
    start = np.broadcast_to(np.atleast_2d(entry), (n, np.atleast_2d(entry).shape[1]))
    met: list[tuple[np.ndarray, np.ndarray]] = []

    def look(row, place):
        """Nearness of places not seen before; repeats in a row count once."""
        fresh = ~seen[row, place]
        row, place = row[fresh], place[fresh]
        seen[row, place] = True
        key = np.unique(row.astype(np.int64) * len(vectors) + place)
        row, place = key // len(vectors), key % len(vectors)
        near = np.einsum("ij,ij->i", queries[row], vectors[place])
        if within is not None:
            hit = near >= within
            met.append((row[hit], place[hit]))
        return row, place, near

    def merged(ids, sims, row, place, near):
        count = np.bincount(row, minlength=n)
        wide = int(count.max(initial=0))
        if not wide:
            return ids, sims
        more, value = np.full((n, wide), -1, np.int32), np.full((n, wide), -np.inf, np.float32)
        column = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        more[row, column], value[row, column] = place, near
        ids, sims = np.concatenate([ids, more], 1), np.concatenate([sims, value], 1)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    ids, sims = np.full((n, width), -1, np.int32), np.full((n, width), -np.inf, np.float32)
    used = start >= 0
    ids, sims = merged(ids, sims, *look(np.nonzero(used)[0], start[used]))
    while True:
        todo = (ids >= 0) & ~done[rows[:, None], np.maximum(ids, 0)]
        todo &= np.cumsum(todo, 1) <= at_once
        row, column = np.nonzero(todo)
        if not len(row):
            break
        place = ids[row, column]
        done[row, place] = True
        near = graph[place]
        real = near >= 0
        ids, sims = merged(ids, sims, *look(np.repeat(row, degree)[real.ravel()], near[real]))
    front = met
    while front:
        todo_row, todo_place = (np.concatenate([f[i] for f in front]) for i in (0, 1))
        open_ = ~done[todo_row, todo_place]
        todo_row, todo_place = todo_row[open_], todo_place[open_]
        done[todo_row, todo_place] = True
        before = len(met)
        for at in range(0, len(todo_row), 50_000):
            row, near = todo_row[at : at + 50_000], graph[todo_place[at : at + 50_000]]
            real = near >= 0
            look(np.repeat(row, degree)[real.ravel()], near[real])
        front = [m for m in met[before:] if len(m[0])]
    return ids, sims, met


def entries(vectors: np.ndarray, graph: np.ndarray) -> np.ndarray:
    """The medoid, and a place in every part of the graph that is not reached from those before."""
    middle = vectors.mean(0)
    starts = [int((vectors @ middle).argmax())]
    reached = np.zeros(len(vectors), bool)
    front = np.array(starts)
    while True:
        reached[front] = True
        while len(front):
            near = np.unique(graph[front])
            front = near[(near >= 0) & ~reached[np.maximum(near, 0)]]
            reached[front] = True
        left = np.flatnonzero(~reached)
        if not len(left):
            return np.array(starts, np.int32)
        # of what is left, the place nearest to the middle
        front = left[[int((vectors[left] @ middle).argmax())]]
        starts.append(int(front[0]))


def with_reverse(vectors: np.ndarray, graph: np.ndarray, targets: np.ndarray, sources: np.ndarray, degree: int, alpha: float, fill: bool = False, most: int = 48) -> None:
    """Add the edges target -> source; lists that overflow are pruned.  Of very many new ones the nearest are weighed."""
    real = (targets >= 0) & (targets != sources)
    targets, sources = targets[real], sources[real]
    near = np.einsum("ij,ij->i", vectors[targets], vectors[sources])
    order = np.lexsort((-near, targets))
    targets, sources = targets[order], sources[order]
    nodes, first, count = np.unique(targets, return_index=True, return_counts=True)
    column = np.arange(len(targets)) - np.repeat(first, count)
    kept = column < most
    more = np.full((len(nodes), min(most, int(count.max(initial=0)))), -1, np.int32)
    more[np.repeat(np.arange(len(nodes)), count)[kept], column[kept]] = sources[kept]
    every = np.concatenate([graph[nodes], more], 1)
    graph[nodes] = prune(vectors, nodes, every, degree, alpha, fill)


def vamana(vectors: np.ndarray, degree: int = 24, candidates: int = 48, alpha: float = 1.2, seed: int = 3) -> np.ndarray:
    """A robust-pruned graph of one shard.

    Each node chooses among its nearest ones and some random ones, with the slack ``alpha`` that keeps
    long edges; then edges are made mutual and lists pruned again.
    """
    n = len(vectors)
    draw = np.random.default_rng(seed)
    near = np.empty((n, min(candidates, n)), np.int32)
    for at in range(0, n, 512):
        sims = vectors[at : at + 512] @ vectors.T
        near[at : at + 512] = np.argpartition(-sims, near.shape[1] - 1, axis=1)[:, : near.shape[1]]
    far = draw.integers(0, n, (n, min(16, n)), dtype=np.int32)
    own = np.arange(n)
    graph = prune(vectors, own, np.concatenate([near, far], 1), degree, alpha)
    with_reverse(vectors, graph, graph.ravel().copy(), np.repeat(own, degree), degree, alpha)
    return graph


def hnsw(vectors: np.ndarray, degree: int = 16, width: int = 96, seed: int = 9) -> list[np.ndarray]:
    """Layers of a navigable small world, the lowest first; each a neighbour table over all places.

    A node's top layer is drawn from a geometric law.  Layers are built from the top down: nodes come
    in batches that double, search from the layer above, choose diverse neighbours and are linked back.
    The lowest layer has twice the degree.
    """
    n = len(vectors)
    level = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(degree)).astype(int), 12)
    # the top layer has two nodes at least, so that its edges tell where a search begins
    level = np.minimum(level, np.sort(level)[-2] if n > 1 else 0)
    layers: list[np.ndarray] = [None] * (int(level.max(initial=0)) + 1)
    order = np.argsort(-level, kind="stable")
    top = order[:1]
    for layer in range(len(layers) - 1, -1, -1):
        most = degree * (2 if layer == 0 else 1)
        graph = np.full((n, most), -1, np.int32)
        nodes = order[level[order] >= layer]
        at = 1
        while at < len(nodes):
            new = nodes[at : at + min(at, 512)]
            start = descend(vectors, layers[layer + 1 :], vectors[new], top)
            if layer + 1 < len(layers):  # whoever lives above too is inserted already, here or in this batch
                start = np.where(level[start] >= layer, start, top[0])
            start = np.concatenate([np.where(np.isin(start, nodes[:at]), start, top[0]), np.broadcast_to(top, (len(new), 1))], 1)
            ids = search(vectors, graph, vectors[new], start, width)[0]
            beside = vectors[new] @ vectors[new].T
            k = min(8, len(new))
            peers = new[np.argpartition(-beside, k - 1, axis=1)[:, :k]]
            graph[new] = prune(vectors, new, np.concatenate([ids, peers.astype(np.int32)], 1), most, fill=True)
            with_reverse(vectors, graph, graph[new].ravel().copy(), np.repeat(new, most), most, 1.0, True)
            at += len(new)
        layers[layer] = graph
    return layers


def descend(vectors: np.ndarray, above: list[np.ndarray], queries: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The nearest place that greedy steps through the upper layers find, one column."""
    place = np.broadcast_to(top, (len(queries), 1))
    for graph in reversed(above):
        place = search(vectors, graph, queries, place, 1, 1)[0]
    return place
