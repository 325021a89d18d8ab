"""Shortest paths: heap searches on the arcs of a tile, and frontier relaxation by joins.

Requests over a whole graph go through `overlay`, which runs these searches tile by tile.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.sources.versions import checkpointed, dropped

#: Metres an hour of the straight-line bound.
TOP_SPEED = 6000.0


class Graph:
    """Arcs as adjacency arrays, both ways."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, cost: np.ndarray, lat: dict | None = None) -> None:
        self.out: dict[int, list[tuple[int, float]]] = {}
        self.into: dict[int, list[tuple[int, float]]] = {}
        for a, b, c in zip(src.tolist(), dst.tolist(), cost.tolist()):
            self.out.setdefault(a, []).append((b, c))
            self.into.setdefault(b, []).append((a, c))
        self.place = lat or {}

    def bound(self, a: int, b: int) -> float:
        """Hours from a to b in a straight line at top speed; 0 without positions."""
        if a not in self.place or b not in self.place:
            return 0.0
        (p, q), (r, s) = self.place[a], self.place[b]
        h = math.sin(math.radians(r - p) / 2) ** 2 + math.cos(math.radians(p)) * math.cos(math.radians(r)) * math.sin(math.radians(s - q) / 2) ** 2
        return 2 * 6378137.0 * math.asin(min(1.0, math.sqrt(h))) / TOP_SPEED


def _walk(parent: dict[int, int | None], node: int) -> list[int]:
    path = [node]
    while parent[path[-1]] is not None:
        path.append(parent[path[-1]])
    return path


def one_way(g: Graph, start: int, end: int, informed: bool, log: list | None = None) -> tuple[float | None, list[int]]:
    """Dijkstra, or A* with the straight-line bound; ends when the goal is popped."""
    best, parent, done = {start: 0.0}, {start: None}, set()
    queue = [(g.bound(start, end) if informed else 0.0, start)]
    while queue:
        _, a = heapq.heappop(queue)
        if a in done:
            continue
        done.add(a)
        opened = []
        if a == end:
            return best[a], _walk(parent, a)[::-1]
        for b, c in g.out.get(a, ()):
            if c < 0:
                raise ValueError("an arc has a negative cost")
            d = best[a] + c
            if b not in best or d < best[b]:
                best[b], parent[b] = d, a
                opened.append(b)
                heapq.heappush(queue, (d + (g.bound(b, end) if informed else 0.0), b))
        if log is not None:
            log.append((a, opened))
    return None, []


def two_way(g: Graph, start: int, end: int, informed: bool, log: list | None = None) -> tuple[float | None, list[int]]:
    """Searches from both ends, the smaller queue first; exact stop rules.

    Uninformed: the tops add up to the best meeting cost. Informed: either top reaches
    it, as a key is a lower bound of any path through its node.
    """
    if start == end:
        return 0.0, [start]
    best = ({start: 0.0}, {end: 0.0})
    parent = ({start: None}, {end: None})
    done: tuple[set, set] = (set(), set())
    ends = (end, start)
    key = lambda way, n: best[way][n] + (g.bound(n, ends[way]) if informed else 0.0)
    queue = ([(key(0, start), start)], [(key(1, end), end)])
    found, meet = float("inf"), None
    while queue[0] and queue[1]:
        top = (queue[0][0][0], queue[1][0][0])
        if (max(top) if informed else sum(top)) >= found:
            break
        way = 1 if len(queue[0]) > len(queue[1]) else 0
        _, a = heapq.heappop(queue[way])
        if a in done[way]:
            continue
        done[way].add(a)
        opened = []
        for b, c in (g.out if way == 0 else g.into).get(a, ()):
            if c < 0:
                raise ValueError("an arc has a negative cost")
            d = best[way][a] + c
            if b not in best[way] or d < best[way][b]:
                best[way][b], parent[way][b] = d, a
                opened.append(b)
                heapq.heappush(queue[way], (key(way, b), b))
                if b in best[1 - way] and d + best[1 - way][b] < found:
                    found, meet = d + best[1 - way][b], b
        if log is not None:
            log.append((a, opened))
    if meet is None:
        return None, []
    return found, _walk(parent[0], meet)[::-1] + _walk(parent[1], meet)[1:]


ALGORITHMS = {
    "dijkstra": lambda g, a, b, log: one_way(g, a, b, False, log),
    "astar": lambda g, a, b, log: one_way(g, a, b, True, log),
    "bidi_dijkstra": lambda g, a, b, log: two_way(g, a, b, False, log),
    "bidi_astar": lambda g, a, b, log: two_way(g, a, b, True, log),
}


def routes(requests: DataFrame, arcs: DataFrame, nodes: DataFrame | None = None, algorithm: str = "bidi_astar", preferred: bool = False, tile: float | None = None) -> DataFrame:
    """query_id, cost (null: no way), path and log of each request (query_id, src, dst).

    `nodes` (node_id, lat, lng) give the tiles of the search (`overlay`), and the bound of
    the informed ones. With `preferred`, arcs may cost nothing, so the bound is left out.
    """
    from waymark.operators.overlay import TILE, Overlay

    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown search algorithm {algorithm}")
    return Overlay(arcs, nodes, tile or TILE).routes(requests, algorithm, preferred)


def reach(sources: DataFrame, arcs: DataFrame, nodes: DataFrame | None = None, tile: float | None = None) -> DataFrame:
    """query_id, node, cost of all nodes that a source (query_id, node) reaches, through the overlay."""
    from waymark.operators.overlay import TILE, Overlay

    return Overlay(arcs, nodes, tile or TILE).reach(sources)


def frontier(sources: DataFrame, arcs: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """query_id, node, cost: least costs from each source (query_id, node), by relaxation."""
    return _tree(sources, arcs, max_rounds).select("query_id", "node", "cost")


def _tree(sources: DataFrame, arcs: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """query_id, node, cost, parent (null at a source) of the nodes that each source reaches.

    Only nodes whose cost fell go on to the next round; the state is checkpointed, so
    plans stay short and a lost executor costs one round. Costs that still fall after
    `max_rounds` raise.
    """
    if arcs.where("cost < 0").limit(1).count():
        raise ValueError("an arc has a negative cost")
    best = checkpointed(sources.select("query_id", "node", F.lit(0.0).alias("cost"), F.lit(None).cast("long").alias("parent"), F.lit(True).alias("open")))
    for _ in range(max_rounds):
        step = best.where("open").join(arcs, best["node"] == arcs["src"]).select("query_id", F.col("dst").alias("node"), (best["cost"] + arcs["cost"]).alias("cost"), F.col("src").alias("parent"), F.lit(True).alias("open"))
        if not step.limit(1).count():
            return best.select("query_id", "node", "cost", "parent")
        merged = best.withColumn("open", F.lit(False)).unionByName(step)
        # at equal costs the row that was there stays, so parents make no cycle
        least = merged.groupBy("query_id", "node").agg(F.min(F.struct("cost", "open", "parent")).alias("b"))
        before, best = best, checkpointed(least.select("query_id", "node", "b.cost", "b.parent", "b.open"))
        dropped(before)
    raise RuntimeError(f"costs still fall after {max_rounds} rounds")
