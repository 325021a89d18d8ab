"""Linear referencing over vertex rows: measures, positions, parts of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from waymark.functions.geo import haversine, hours, planar
from waymark.operators.asof import last_before


def by_line() -> WindowSpec:
    return Window.partitionBy("line_id").orderBy("idx")


def segments(vertices: DataFrame) -> DataFrame:
    """Each vertex with the one before it (px, py, plat, plng, pele), lengths and times of the segment."""
    prior = vertices.withColumns({f"p{c}": F.lag(c).over(by_line()) for c in ("x", "y", "lat", "lng", "ele")})
    zero = F.lit(0.0)
    return prior.withColumns(
        {
            "len_merc": F.coalesce(planar(F.col("px"), F.col("py"), F.col("x"), F.col("y")), zero),
            "len_m": F.coalesce(haversine(F.col("plat"), F.col("plng"), F.col("lat"), F.col("lng")), zero),
        }
    ).withColumns(
        {
            "fwd_h": F.coalesce(hours(F.col("ele") - F.col("pele"), F.col("len_m")), zero),
            "rev_h": F.coalesce(hours(F.col("pele") - F.col("ele"), F.col("len_m")), zero),
        }
    )


def measured(vertices: DataFrame) -> DataFrame:
    """Segments with running sums (cum_merc, cum_m, cum_fwd, cum_rev), the total and the fraction."""
    so_far = by_line().rowsBetween(Window.unboundedPreceding, 0)
    sums = {"cum_merc": "len_merc", "cum_m": "len_m", "cum_fwd": "fwd_h", "cum_rev": "rev_h"}
    df = segments(vertices).withColumns({k: F.sum(v).over(so_far) for k, v in sums.items()})
    df = df.withColumn("total_merc", F.sum("len_merc").over(Window.partitionBy("line_id")))
    share = F.when(F.col("total_merc") > 0, F.col("cum_merc") / F.col("total_merc")).otherwise(F.lit(0.0))
    return df.withColumn("fraction", F.when(F.col("idx") == F.col("n"), F.lit(1.0)).otherwise(share))


def substring(measured_: DataFrame, cuts: DataFrame) -> DataFrame:
    """Parts of lines: `cuts` has line_id, f0, f1 (0 <= f0 < f1 <= 1) and keys of its own.

    Gives the interpolated ends and the vertices between, as vertex rows with `part`
    (0 start, 1 inside, 2 end), x, y, lat, lng, ele, fraction.
    """
    nxt = {f"n{c}": F.lead(c).over(by_line()) for c in ("x", "y", "lat", "lng", "ele", "fraction")}
    joined = measured_.select("line_id", "idx", "x", "y", "lat", "lng", "ele", "fraction", *(v.alias(k) for k, v in nxt.items())).join(cuts, "line_id")

    def between(f: str) -> Column:
        t = F.when(F.col("nfraction") > F.col("fraction"), (F.col(f) - F.col("fraction")) / (F.col("nfraction") - F.col("fraction"))).otherwise(F.lit(0.0))
        mixed = [(F.col(c) + t * (F.col(f"n{c}") - F.col(c))).alias(c) for c in ("x", "y", "lat", "lng", "ele")]
        return F.struct(*mixed, F.col(f).alias("fraction"))

    own = F.struct("x", "y", "lat", "lng", "ele", "fraction")
    holds = lambda f: (F.col("fraction") <= F.col(f)) & ((F.col("nfraction") > F.col(f)))
    last = (F.col("fraction") < F.col("f1")) & (F.col("nfraction") >= F.col("f1"))
    pieces = F.array(
        F.when(holds("f0"), F.struct(F.lit(0).alias("part"), between("f0").alias("p"))),
        F.when((F.col("fraction") > F.col("f0")) & (F.col("fraction") < F.col("f1")), F.struct(F.lit(1).alias("part"), own.alias("p"))),
        F.when(last, F.struct(F.lit(2).alias("part"), between("f1").alias("p"))),
    )
    keys = [c for c in cuts.columns if c != "line_id"]
    return joined.select("line_id", *keys, "idx", F.explode(F.array_compact(pieces)).alias("s")).select("line_id", *keys, "idx", "s.part", "s.p.*")


def cost_of(points: DataFrame, keys: list[str]) -> DataFrame:
    """Forward and reverse hours and metres along ordered points (part, idx) of each key."""
    w = Window.partitionBy(*keys).orderBy("part", "idx")
    step = points.withColumns({f"p{c}": F.lag(c).over(w) for c in ("lat", "lng", "ele")})
    run = haversine(F.col("plat"), F.col("plng"), F.col("lat"), F.col("lng"))
    step = step.withColumn("run", run)
    rise = F.col("ele") - F.col("pele")
    return step.groupBy(*keys).agg(
        F.coalesce(F.sum(hours(rise, F.col("run"))), F.lit(0.0)).alias("forward_h"),
        F.coalesce(F.sum(hours(-rise, F.col("run"))), F.lit(0.0)).alias("reverse_h"),
        F.coalesce(F.sum("run"), F.lit(0.0)).alias("metres"),
        F.count("*").alias("points"),
    )


def part_sums(measured_: DataFrame, cuts: DataFrame) -> DataFrame:
    """Costs of parts of lines from running sums: `cuts` has line_id, f0, f1 (f0 <= f1) and keys of its own.

    Both ends are located in one sort (`asof`); between the first vertex behind the start
    and the last one before the end, costs are differences of running sums, so the work
    does not depend on how many vertices a part has. Gives the columns of `cuts`, each row
    once, `inner` (vertices strictly inside) and, for metres, forward_h and reverse_h: the
    whole, `head_` (start to the first inner vertex), `mid_` (between inner vertices) and
    `tail_` (last inner vertex to the end); without inner vertices the whole alone counts.
    """
    place = ("lat", "lng", "ele")
    sums = {"metres": "cum_m", "forward_h": "cum_fwd", "reverse_h": "cum_rev"}
    held = ("idx", "fraction", *place, *sums.values())
    nxt = {f"n{c}": F.lead(c).over(by_line()) for c in ("fraction", *place, *sums.values())}
    rows = measured_.select("line_id", *held, *(v.alias(k) for k, v in nxt.items()))
    rows = rows.select("line_id", F.col("fraction").alias("f"), "idx", F.struct(*held, *nxt).alias("at"))
    own = F.struct(*cuts.columns)
    ends = cuts.distinct().select("line_id", own.alias("cut"), F.explode(F.array(F.struct(F.col("f0").alias("f"), F.lit(False).alias("strict")), F.struct(F.col("f1").alias("f"), F.lit(True).alias("strict")))).alias("e"))
    found = last_before(ends.select("line_id", "cut", "e.*"), rows, "line_id", "f", "at", "idx")
    both = found.groupBy("line_id", "cut").agg(F.max(F.when(~F.col("strict"), F.col("at"))).alias("a"), F.max(F.when(F.col("strict"), F.col("at"))).alias("b"))

    flat = both.select(
        "line_id",
        "cut",
        F.when(F.col("cut.f0") == F.col("cut.f1"), F.lit(0)).otherwise(F.greatest(F.col("b.idx") - F.col("a.idx"), F.lit(0))).alias("inner"),
        *((F.col(f"cut.{f}") - F.col(f"{at}.fraction")).alias(f"{at}_in") for at, f in (("a", "f0"), ("b", "f1"))),
        *((F.col(f"{at}.nfraction") - F.col(f"{at}.fraction")).alias(f"{at}_gap") for at in "ab"),
        *(F.col(f"{at}.{c}").alias(f"{at}_{c}") for at in "ab" for c in place),
        *(F.coalesce(f"{at}.n{c}", f"{at}.{c}").alias(f"{at}_n{c}") for at in "ab" for c in place),
        *((F.col(f"b.{c}") - F.col(f"a.n{c}")).alias(f"mid_{k}") for k, c in sums.items()),
    )
    # projections of their own, so that no generated method holds all of it
    shares = {f"{at}_t": F.when(F.col(f"{at}_gap") > 0, F.col(f"{at}_in") / F.col(f"{at}_gap")).otherwise(F.lit(0.0)) for at in "ab"}
    ends = {f"{at}_p{c}": F.col(f"{at}_{c}") + F.col(f"{at}_t") * (F.col(f"{at}_n{c}") - F.col(f"{at}_{c}")) for at in "ab" for c in place}
    pairs = {"head": ("a_p", "a_n"), "tail": ("b_", "b_p"), "whole": ("a_p", "b_p")}
    runs = {f"{k}_metres": haversine(*(F.col(f"{p}{c}") for p in pq for c in ("lat", "lng"))) for k, pq in pairs.items()}
    rises = {f"{k}_rise": F.col(f"{q}ele") - F.col(f"{p}ele") for k, (p, q) in pairs.items()}
    made = flat.withColumns(shares).withColumns(ends).withColumns(runs | rises)
    made = made.withColumns({f"{k}_{d}_h": hours(sign * F.col(f"{k}_rise"), F.col(f"{k}_metres")) for k in pairs for d, sign in (("forward", 1), ("reverse", -1))})
    none, same, zero = F.col("inner") == 0, F.col("cut.f0") == F.col("cut.f1"), F.lit(0.0)
    named = []
    for k in sums:
        pieces = [F.col(f"{p}_{k}") for p in ("head", "mid", "tail")]
        named += [F.when(none, zero).otherwise(v).alias(f"{p}_{k}") for p, v in zip(("head", "mid", "tail"), pieces)]
        named.append(F.when(same, zero).when(none, F.col(f"whole_{k}")).otherwise(pieces[0] + pieces[1] + pieces[2]).alias(k))
    return made.select(*("line_id" if c == "line_id" else f"cut.{c}" for c in cuts.columns), "inner", *named)


def reverse(measured_: DataFrame) -> DataFrame:
    """Lines in the other direction: order, fractions and directions swap."""
    total = lambda c: F.max(c).over(Window.partitionBy("line_id"))
    return measured_.select(
        "line_id",
        (F.col("n") + 1 - F.col("idx")).alias("idx"),
        "n",
        "gx",
        "gy",
        (1 - F.col("fraction")).alias("fraction"),
        (total("cum_rev") - F.col("cum_rev")).alias("cum_fwd"),
        (total("cum_fwd") - F.col("cum_fwd")).alias("cum_rev"),
    )


def clip(segments_: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """The parts of segments inside a closed box (Liang-Barsky): t0, t1 of each that has one."""
    x0, y0, x1, y1 = (F.col(c) for c in ("plng", "plat", "lng", "lat"))
    t0, t1, inside = F.lit(0.0), F.lit(1.0), F.lit(True)
    for p, q in ((x0 - x1, x0 - west), (x1 - x0, east - x0), (y0 - y1, y0 - south), (y1 - y0, north - y0)):
        r = F.when(p != 0, q / p)
        t0 = F.when(p < 0, F.greatest(t0, r)).otherwise(t0)
        t1 = F.when(p > 0, F.least(t1, r)).otherwise(t1)
        inside = inside & ~((p == 0) & (q < 0))
    return segments_.where(F.col("plat").isNotNull()).withColumns({"t0": t0, "t1": t1, "inside": inside}).where(F.col("inside") & (F.col("t0") <= F.col("t1"))).drop("inside")
