"""Shortest paths on a graph that no machine holds: tiles, and an overlay of their borders.

Nodes lie in square tiles. An arc within a tile is inner, another one crosses; nodes that
crossing arcs touch are borders. For each tile a grouped map, which holds that tile alone,
gives the costs between its borders. Requests then search the overlay: from the borders
that their start reaches within its tile, rounds of joins follow a crossing arc and the
way through the tile that it leads to, so there are about as many rounds as tiles on the
way. Open borders that cost as much as the best way known so far are not followed. Only
the tiles on the ways found are unpacked to nodes, by searches within each tile.

Neither the driver nor a broadcast holds arcs, nodes or requests; a task holds the arcs of
one tile, and once the overlay's state of one request. `tile` is chosen so that a tile's
arcs fit a task; nodes without a position share one tile.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.search import ALGORITHMS, Graph
from waymark.sources.tables import importable
from waymark.sources.versions import checkpointed, dropped

#: Degrees of a tile's side.
TILE = 0.125
#: Legs of one tile that one task unpacks.
LEGS = 5000
#: The tile of nodes without a position.
NOWHERE = "none"
LOG = "array<struct<closed:bigint,opened:array<bigint>>>"


def spread(out: dict[int, list[tuple[int, float]]], seeds: dict[int, float]) -> dict[int, float]:
    """Least costs of all nodes that the seeds (node: cost so far) reach."""
    best, done = dict(seeds), set()
    queue = [(c, n) for n, c in seeds.items()]
    heapq.heapify(queue)
    while queue:
        d, a = heapq.heappop(queue)
        if a in done:
            continue
        done.add(a)
        for b, c in out.get(a, ()):
            if b not in best or d + c < best[b]:
                best[b] = d + c
                heapq.heappush(queue, (d + c, b))
    return best


def _graph(inner: pa.Table, placed: bool = False) -> Graph:
    place = {}
    if placed:
        for n, lat, lng in (("src", "slat", "slng"), ("dst", "dlat", "dlng")):
            place |= {k: (p, q) for k, p, q in zip(*(inner.column(c).to_pylist() for c in (n, lat, lng))) if p is not None and q is not None}
    return Graph(*(inner.column(c).to_numpy() for c in ("src", "dst", "cost")), place)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _schema(*fields: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema(list(fields))


class Overlay:
    """A graph in tiles: its arcs (src, dst, cost), and nodes (node_id, lat, lng) for their places.

    A negative cost raises; of parallel arcs the cheapest counts.
    """

    def __init__(self, arcs: DataFrame, nodes: DataFrame | None = None, tile: float = TILE) -> None:
        self.spark = spark = arcs.sparkSession
        importable(spark)
        # tiles are dear by their work, not their bytes, so they keep all partitions
        self.tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        checked = F.when(F.col("cost") < 0, F.raise_error(F.lit("an arc has a negative cost")).cast("double")).otherwise(F.col("cost"))
        least = checkpointed(arcs.groupBy("src", "dst").agg(F.min(checked).alias("cost")))
        ids = least.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        if nodes is None:
            at = ids.select("node", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"))
        else:
            own = nodes.groupBy(F.col("node_id").alias("node")).agg(F.min(F.struct(F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"))).alias("p"))
            at = ids.join(own, "node", "left").select("node", "p.lat", "p.lng")
        name = F.concat_ws(":", F.floor(F.col("lng") / tile), F.floor(F.col("lat") / tile))
        known = F.col("lat").isNotNull() & F.col("lng").isNotNull()
        self.tiles = checkpointed(at.withColumn("tile", F.when(known, name).otherwise(F.lit(NOWHERE))))
        ends = [self.tiles.select(F.col("node").alias(n), F.col("lat").alias(f"{n[0]}lat"), F.col("lng").alias(f"{n[0]}lng"), F.col("tile").alias(f"{n[0]}tile")) for n in ("src", "dst")]
        told = checkpointed(least.join(ends[0], "src").join(ends[1], "dst"))
        dropped(least)
        same = F.col("stile") == F.col("dtile")
        self.inner = told.where(same).select(F.col("stile").alias("tile"), "src", "dst", "cost", "slat", "slng", "dlat", "dlng")
        self.cross = told.where(~same).select("src", "dst", "cost")
        touched = F.array(F.struct(F.col("stile").alias("tile"), F.col("src").alias("node")), F.struct(F.col("dtile").alias("tile"), F.col("dst").alias("node")))
        self.borders = checkpointed(told.where(~same).select(F.explode(touched).alias("b")).select("b.*").distinct())
        self.over = checkpointed(self._through())

    def _by_tile(self, points: DataFrame, run, schema: str) -> DataFrame:
        """`run` of each tile's arcs and of the rows of `points` in it."""
        return self._cogrouped(self.inner, points, ["tile"], run, schema)

    def _cogrouped(self, left: DataFrame, right: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
        a, b = (df.repartition(self.tasks, *keys).groupBy(*keys) for df in (left, right))
        return a.cogroup(b).applyInArrow(run, schema)

    def _through(self) -> DataFrame:
        """src, dst, cost of the ways between the borders of a tile."""
        schema = _schema(("src", pa.int64()), ("dst", pa.int64()), ("cost", pa.float64()))

        def run(inner: pa.Table, points: pa.Table) -> pa.Table:
            borders = sorted(points.column("node").to_pylist()) if points.num_rows else []
            g = _graph(inner) if borders and inner.num_rows else None
            rows = []
            for a in borders if g else ():
                best = spread(g.out, {a: 0.0})
                rows += [(a, b, best[b]) for b in borders if b != a and b in best]
            return _rows(rows, schema)

        return self._by_tile(self.borders, run, "src long, dst long, cost double")

    def _ends(self, pairs: DataFrame) -> DataFrame:
        """kind, a, b, cost: from starts to borders (out), from borders to ends (in), within a tile (pair)."""
        at = self.tiles.select("node", "tile")
        src = pairs.join(at.toDF("src", "stile"), "src").select("src", "dst", "stile")
        both = src.join(at.toDF("dst", "dtile"), "dst")
        end = lambda kind, tile, a, b: F.struct(F.lit(kind).alias("kind"), F.col(tile).alias("tile"), a.alias("a"), b.alias("b"))
        none = F.lit(None).cast("long")
        marks = F.array(
            end("out", "stile", F.col("src"), none), end("in", "dtile", F.col("dst"), none),
            F.when(F.col("stile") == F.col("dtile"), end("pair", "stile", F.col("src"), F.col("dst"))),
        )
        points = both.select(F.explode(F.array_compact(marks)).alias("m")).select("m.*").distinct()
        points = points.unionByName(self.borders.select(F.lit("border").alias("kind"), "tile", F.col("node").alias("a"), none.alias("b")))
        schema = _schema(("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("cost", pa.float64()))

        def run(inner: pa.Table, points: pa.Table) -> pa.Table:
            by: dict[str, list] = {"border": [], "out": [], "in": [], "pair": []}
            for kind, a, b in zip(*(points.column(c).to_pylist() for c in ("kind", "a", "b"))) if points.num_rows else ():
                by[kind].append((a, b))
            g = _graph(inner) if points.num_rows and inner.num_rows else None
            borders, goals, rows = [a for a, _ in by["border"]], {}, []
            for a, b in by["pair"]:
                goals.setdefault(a, []).append(b)
            for a, _ in by["out"]:
                best = spread(g.out, {a: 0.0}) if g else {a: 0.0}
                rows += [("out", a, b, best[b]) for b in borders if b in best]
                rows += [("pair", a, b, best[b]) for b in goals.get(a, ()) if b in best]
            for a, _ in by["in"]:
                best = spread(g.into, {a: 0.0}) if g else {a: 0.0}
                rows += [("in", b, a, best[b]) for b in borders if b in best]
            return _rows(rows, schema)

        return checkpointed(self._by_tile(points, run, "kind string, a long, b long, cost double"))

    def _relaxed(self, state: DataFrame, keys: list[str], bounds=None) -> DataFrame:
        """Least costs of borders, by rounds over crossing arcs and the ways through tiles.

        `state`: keys, node, cost, parent, kind (0 from the start, 1 by a crossing arc, 2
        through a tile), open. `bounds(state)` gives keys and the cost from which on a
        border is neither kept nor followed. At equal costs the row that was there stays,
        then the lesser kind, so parents make no cycle.
        """

        def hop(df: DataFrame, arcs: DataFrame, kind: int) -> DataFrame:
            onward = arcs.select(F.col("src").alias("node"), F.col("dst").alias("__to"), F.col("cost").alias("__c"))
            cost = F.col("cost") + F.col("__c")
            made = df.join(onward, "node").where(F.col("bound").isNull() | (cost < F.col("bound")))
            return made.select(*keys, F.col("__to").alias("node"), cost.alias("cost"), F.col("node").alias("parent"), F.lit(kind).alias("kind"), F.lit(True).alias("open"), "bound")

        state = checkpointed(state)
        while True:
            going = state.where("open")
            if bounds is None:
                going = going.withColumn("bound", F.lit(None).cast("double"))
            else:
                going = going.join(bounds(state), keys, "left").where(F.col("bound").isNull() | (F.col("cost") < F.col("bound")))
            entered = hop(going, self.cross, 1).groupBy(*keys, "node").agg(F.min(F.struct("cost", "kind", "parent")).alias("b"), F.first("bound").alias("bound"))
            entered = checkpointed(entered.select(*keys, "node", "b.cost", "b.parent", "b.kind", F.lit(True).alias("open"), "bound"))
            if entered.isEmpty():
                dropped(entered)
                return state
            # a border has many ways through its tile: few rows here are many after the join
            through = hop(entered.repartition(self.tasks), self.over, 2)
            every = state.withColumn("open", F.lit(False)).unionByName(entered.drop("bound")).unionByName(through.drop("bound"))
            least = every.groupBy(*keys, "node").agg(F.min(F.struct("cost", "open", "kind", "parent")).alias("b"))
            fresh = checkpointed(least.select(*keys, "node", "b.cost", "b.parent", "b.kind", "b.open"))
            dropped(state, entered)
            state = fresh

    def routes(self, requests: DataFrame, algorithm: str = "bidi_astar", preferred: bool = False) -> DataFrame:
        """query_id, cost (null: no way), path and log of each request (query_id, src, dst).

        The log has the expansions of the searches within the tiles on the way, in order.
        With `preferred`, arcs may cost nothing, so the straight-line bound is left out.
        """
        if algorithm not in ALGORITHMS:
            raise ValueError(f"unknown search algorithm {algorithm}")
        keys = ["src", "dst"]
        requests = checkpointed(requests.select(*(F.col(c).cast("long") for c in ("query_id", "src", "dst"))))
        pairs = requests.where("src <> dst").select("src", "dst").distinct()
        ends = self._ends(pairs)
        of = lambda kind, a, b: ends.where(F.col("kind") == kind).select(F.col("a").alias(a), F.col("b").alias(b), F.col("cost").alias(f"{kind}_cost"))
        direct, rest = of("pair", "src", "dst"), of("in", "node", "dst")

        def bounds(state: DataFrame) -> DataFrame:
            met = state.join(rest, ["dst", "node"]).select(*keys, (F.col("cost") + F.col("in_cost")).alias("bound"))
            return met.unionByName(direct.select(*keys, F.col("pair_cost").alias("bound"))).groupBy(*keys).agg(F.min("bound").alias("bound"))

        start = pairs.join(of("out", "src", "node"), "src").select(
            *keys, "node", F.col("out_cost").alias("cost"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("kind"), F.lit(True).alias("open")
        )
        state = self._relaxed(start, keys, bounds)
        met = state.join(rest, ["dst", "node"]).select(*keys, F.struct((F.col("cost") + F.col("in_cost")).alias("cost"), F.lit(1).alias("way"), F.col("node").alias("node")).alias("b"))
        alone = direct.select(*keys, F.struct(F.col("pair_cost").alias("cost"), F.lit(0).alias("way"), F.lit(None).cast("long").alias("node")).alias("b"))
        best = checkpointed(met.unionByName(alone).groupBy(*keys).agg(F.min("b").alias("b")).select(*keys, "b.*"))
        paths = checkpointed(self._unpacked(self._legs(best, state), algorithm, preferred))
        found = best.select(*keys, "cost").join(paths, keys)
        out = requests.join(found, keys, "left")
        here = F.col("src") == F.col("dst")
        done = out.select(
            "query_id",
            F.when(here, F.lit(0.0)).otherwise(F.col("cost")).alias("cost"),
            F.when(here, F.array("src")).otherwise(F.coalesce("path", F.array().cast("array<bigint>"))).alias("path"),
            F.coalesce("log", F.array().cast(LOG)).alias("log"),
        )
        done = checkpointed(done)
        dropped(state, best, paths, ends, requests)
        return done

    def _legs(self, best: DataFrame, state: DataFrame) -> DataFrame:
        """src, dst, k (from the end), inner, from, to: the hops of each way, walked back along its parents."""
        schema = _schema(("src", pa.int64()), ("dst", pa.int64()), ("k", pa.int32()), ("inner", pa.bool_()), ("a", pa.int64()), ("b", pa.int64()))

        def run(key, goal: pa.Table, reached: pa.Table) -> pa.Table:
            src, dst = (x.as_py() for x in key)
            if not goal.num_rows:
                return _rows([], schema)
            node = goal.column("node").to_pylist()[0]
            if node is None:
                return _rows([(src, dst, 0, True, src, dst)], schema)
            up = {n: (p, k) for n, p, k in zip(*(reached.column(c).to_pylist() for c in ("node", "parent", "kind")))}
            rows = [(src, dst, 0, True, node, dst)]
            while up[node][1]:
                p, kind = up[node]
                rows.append((src, dst, len(rows), kind == 2, p, node))
                node = p
            rows.append((src, dst, len(rows), True, src, node))
            return _rows(rows, schema)

        useful = state.join(best.select("src", "dst", F.col("cost").alias("most")), ["src", "dst"]).where(F.col("cost") <= F.col("most")).select("src", "dst", "node", "parent", "kind")
        return best.groupBy("src", "dst").cogroup(useful.groupBy("src", "dst")).applyInArrow(run, "src long, dst long, k int, inner boolean, a long, b long")

    def _unpacked(self, legs: DataFrame, algorithm: str, preferred: bool) -> DataFrame:
        """src, dst, path and log of ways given by their legs. A tile of many legs is dealt to several tasks."""
        legs = checkpointed(legs)
        inner = legs.where("inner").join(self.tiles.select(F.col("node").alias("a"), "tile"), "a")
        shares = inner.groupBy("tile").agg(F.ceil(F.count("*") / LEGS).cast("int").alias("__n"))
        dealt = inner.join(shares, "tile").withColumn("salt", F.pmod(F.xxhash64("src", "dst"), F.col("__n")).cast("int")).drop("__n")
        arcs = self.inner.join(shares, "tile").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n")
        step = pa.struct([("closed", pa.int64()), ("opened", pa.list_(pa.int64()))])
        schema = _schema(("src", pa.int64()), ("dst", pa.int64()), ("k", pa.int32()), ("path", pa.list_(pa.int64())), ("log", pa.list_(step)))
        placed = "astar" in algorithm and not preferred

        def run(inner: pa.Table, asked: pa.Table) -> pa.Table:
            g = _graph(inner, placed) if asked.num_rows and inner.num_rows else Graph(*(np.zeros(0, np.int64),) * 3)
            rows = []
            for s, d, k, a, b in zip(*(asked.column(c).to_pylist() for c in ("src", "dst", "k", "a", "b"))):
                log: list = []
                path = ALGORITHMS[algorithm](g, a, b, log)[1] if a != b else [a]
                rows.append((s, d, k, path, [{"closed": n, "opened": o} for n, o in log]))
            return _rows(rows, schema)

        kinds = f"src long, dst long, k int, path array<long>, log {LOG}"
        made = self._cogrouped(arcs, dealt, ["tile", "salt"], run, kinds)
        crossed = legs.where("not inner").select("src", "dst", "k", F.array("a", "b").alias("path"), F.array().cast(LOG).alias("log"))
        ordered = F.sort_array(F.collect_list(F.struct((-F.col("k")).alias("k"), "path", "log")))
        joined = made.unionByName(crossed).groupBy("src", "dst").agg(ordered.alias("legs"))
        rest = lambda l, i: F.when(i == 0, l["path"]).otherwise(F.slice(l["path"], F.lit(2), F.size(l["path"])))
        return joined.select("src", "dst", F.flatten(F.transform("legs", rest)).alias("path"), F.flatten(F.transform("legs", lambda l: l["log"])).alias("log"))

    def reach(self, sources: DataFrame) -> DataFrame:
        """query_id, node, cost of all nodes that a source (query_id, node) reaches.

        Border costs by rounds, then within each tile from its borders, request by request.
        """
        sources = checkpointed(sources.select(F.col("query_id").cast("long").alias("query_id"), F.col("node").cast("long").alias("node")))
        lone = sources.join(self.tiles.select("node"), "node", "left_anti").select("query_id", "node", F.lit(0.0).alias("cost"))
        starts = sources.select(F.col("node").alias("src")).distinct().select("src", F.col("src").alias("dst"))
        ends = self._ends(starts)
        out = ends.where("kind = 'out'").select(F.col("a").alias("src"), F.col("b").alias("node"), "cost")
        begin = out.select("src", "node", "cost", F.lit(None).cast("long").alias("parent"), F.lit(0).alias("kind"), F.lit(True).alias("open"))
        state = self._relaxed(begin, ["src"])
        at = self.tiles.select("node", "tile")
        seeds = state.select("src", "node", "cost").unionByName(starts.select("src", F.col("src").alias("node"), F.lit(0.0).alias("cost"))).join(at, "node")
        schema = _schema(("src", pa.int64()), ("node", pa.int64()), ("cost", pa.float64()))

        def run(inner: pa.Table, points: pa.Table) -> pa.Table:
            by: dict[int, dict[int, float]] = {}
            for s, n, c in zip(*(points.column(x).to_pylist() for x in ("src", "node", "cost"))) if points.num_rows else ():
                own = by.setdefault(s, {})
                own[n] = min(c, own.get(n, c))
            out = _graph(inner).out if by and inner.num_rows else {}
            parts = [(s, spread(out, own)) for s, own in sorted(by.items())]
            sizes = [len(best) for _, best in parts]
            columns = [np.repeat(np.array([s for s, _ in parts], np.int64), sizes), [n for _, best in parts for n in best], [c for _, best in parts for c in best.values()]]
            return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        found = self._by_tile(seeds, run, "src long, node long, cost double")
        met = sources.select("query_id", F.col("node").alias("src")).join(found, "src").select("query_id", "node", "cost")
        return met.unionByName(lone)
