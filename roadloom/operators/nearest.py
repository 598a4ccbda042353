"""Nearest line segment of every point, however far: cells that widen for the points left, until what was found can't be beaten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadloom.functions.shared import materialize

#: Times the reach grows from round to round.
WIDER = 4


def _cut(segments: DataFrame, size: float) -> DataFrame:
    """segments in parts of at most `size` along either axis, with the part's box (_l, _b, _h, _t): a long segment enters cells along it only."""
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))) / size)).cast("int")
    s = segments.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = lambda a, b, k: F.col(a) + (F.col(b) - F.col(a)) * k / F.col("_n")
    ends = {c: (at(f"{c}1", f"{c}2", F.col("_k")), at(f"{c}1", f"{c}2", F.col("_k") + 1)) for c in ("x", "y")}
    box = {"_l": F.least(*ends["x"]), "_h": F.greatest(*ends["x"]), "_b": F.least(*ends["y"]), "_t": F.greatest(*ends["y"])}
    return s.withColumns({**box, "_px": ends["x"][0], "_py": ends["y"][0]}).drop("_n", "_k")


def _cells(df: DataFrame, size: float, around: float = 0.0) -> DataFrame:
    """df in every cell (_cx, _cy) that its box, widened by `around`, touches."""
    span = lambda lo, hi: F.explode(F.sequence(F.floor((F.col(lo) - around) / size), F.floor((F.col(hi) + around) / size)))
    return df.withColumn("_cx", span("_l", "_h")).withColumn("_cy", span("_b", "_t"))


def _distances(pairs: DataFrame, reach: float, point: list[str], order: list[str]) -> DataFrame:
    """(point .., best) of pairs (point .., _x, _y, segment): the least (distance, order ..), null where none is within reach."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = ((F.col("_x") - F.col("x1")) * dx + (F.col("_y") - F.col("y1")) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-300))
    d = pairs.withColumn("_s", F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))
    d = d.withColumn("distance_m", F.hypot(F.col("_x") - F.col("x1") - F.col("_s") * dx, F.col("_y") - F.col("y1") - F.col("_s") * dy))
    if "route_m" in order:
        d = d.withColumn("route_m", F.col("from_m") + F.col("_s") * F.hypot(dx, dy))
    return d.groupBy(*point).agg(F.min(F.when(F.col("distance_m") <= reach, F.struct("distance_m", *order))).alias("best"))


def _far_pairs(left: DataFrame, segments: DataFrame, reach: float, point: str, keys: list[str]) -> DataFrame:
    """Points with the segments that may be their nearest within reach. Cells that hold segments are far fewer than those: a point looks at
    the cells first, knows from one point on a segment of each how far the nearest is at most, and meets the segments of the cells
    that aren't further off."""
    size, block = reach / WIDER, 2 * reach
    held = _cells(_cut(segments, size), size)
    # Few points are left as a rule: only cells of areas that these reach are stored and dealt out.
    area = 4 * block
    reached = left.select(*keys, *[(F.col(c) + s * reach).alias(n) for c, n, s in (("_x", "_l", -1), ("_x", "_h", 1), ("_y", "_b", -1), ("_y", "_t", 1))])
    reached = _cells(reached, area, size).select(*keys, F.col("_cx").alias("_ax"), F.col("_cy").alias("_ay")).distinct()
    held = held.withColumns({"_ax": F.floor(F.col("_cx") * size / area), "_ay": F.floor(F.col("_cy") * size / area)}).join(reached, [*keys, "_ax", "_ay"], "left_semi")
    held = materialize(held.drop("_l", "_h", "_b", "_t", "_ax", "_ay"), "nearest-cells")
    cells = held.groupBy(*keys, "_cx", "_cy").agg(F.min(F.struct("_px", "_py")).alias("_p"))
    box = cells.withColumns({"_ox": F.col("_cx"), "_oy": F.col("_cy"), "_l": F.col("_cx") * size, "_h": (F.col("_cx") + 1) * size, "_b": F.col("_cy") * size, "_t": (F.col("_cy") + 1) * size})
    near = left.withColumn("_cx", F.floor(F.col("_x") / block)).withColumn("_cy", F.floor(F.col("_y") / block)).join(_cells(box, block, reach).hint("merge"), [*keys, "_cx", "_cy"])
    gap = lambda v, lo, hi: F.greatest(F.col(lo) - F.col(v), F.col(v) - F.col(hi), F.lit(0.0))
    # A hair more than the bound, so that rounding drops no cell.
    most = F.min(F.hypot(F.col("_x") - F.col("_p._px"), F.col("_y") - F.col("_p._py"))).over(W.partitionBy(point)) * (1 + 1e-9) + 1e-6
    near = near.withColumn("_most", most).where(F.hypot(gap("_x", "_l", "_h"), gap("_y", "_b", "_t")) <= F.least("_most", F.lit(reach)))
    # Stored cells are far smaller than the rows read from them, so these too would be broadcast.
    return near.select(point, "_x", "_y", *keys, F.col("_ox").alias("_cx"), F.col("_oy").alias("_cy")).join(held.hint("merge"), [*keys, "_cx", "_cy"])


def nearest_segment(points: DataFrame, segments: DataFrame, order: list[str], point: str = "point_id", keys: list[str] | None = None, reach_m: float = 50.0, within_m: float | None = None, carry: list[str] | None = None) -> DataFrame:
    """(point, distance_m, order ..): the nearest segment (keys .., x1, y1, x2, y2, order ..) of every point (point, keys .., x, y), ties
    by the columns `order`. `route_m` among them is the place along the segment, counted from its from_m.

    With keys a point meets segments of its own keys only. Without within_m there is no limit: points without a segment within
    reach look again WIDER times as far, and all that lie within a round's reach have been seen in it, so what is found is the
    nearest. Rounds grow with the logarithm of the largest distance. Points are told apart by `point`. Those without coordinates, or
    for whose keys there is no segment, are left out, as are those with none within within_m.

    With carry, columns of points that come along, (point, keys .., carry .., distance_m, order ..) has a row for each row of points, those
    that are alike in all of it and in place as one. A point is in one cell in the first round, so its rows stay where they are.
    """
    keys, whole = keys or [], carry is None
    number = lambda c: F.col(c).cast("double").isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(c) < 1e15)
    needed = [*dict.fromkeys([*keys, "x1", "y1", "x2", "y2", *[c for c in order if c != "route_m"], *(["from_m"] if "route_m" in order else [])])]
    segments = materialize(segments.select(*needed).where(number("x1") & number("y1") & number("x2") & number("y2")), "nearest-segments")
    told = [*dict.fromkeys([point, *keys, *(carry or [])])]
    left = points.where(number("x") & number("y")).select(*told, F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y"))
    if keys:
        left = left.join(segments.select(*keys).distinct(), keys, "left_semi")
    elif segments.isEmpty():
        left = left.where("false")
    reach = reach_m if within_m is None else within_m
    cells = _cells(_cut(segments, WIDER * reach), 2 * reach, reach).drop("_l", "_h", "_b", "_t", "_px", "_py")
    # The stored segments are small, their cells are not: without the hint Spark takes the size of the one for the other and broadcasts them.
    pairs = left.withColumn("_cx", F.floor(F.col("_x") / (2 * reach))).withColumn("_cy", F.floor(F.col("_y") / (2 * reach))).join(cells.hint("merge"), [*keys, "_cx", "_cy"], "left")
    seen = _distances(pairs, reach, [*keys, "_cx", "_cy", *[c for c in told if c not in keys], "_x", "_y"], order)
    none = F.col("best").isNull()
    place = [F.when(none, F.col(c)).alias(c) for c in ("_x", "_y")]  # only points that look again need theirs
    seen = materialize(seen.select(*told, *place, "best"), "nearest-round")
    found = seen.where(~none).select(*told, "best")
    if within_m is None:
        # Stored, so that the row numbers stay.
        rows = materialize(seen.where(none).select(F.monotonically_increasing_id().alias("_id"), *told, "_x", "_y"), "nearest-rows")
        left = rows.select("_id", *keys, "_x", "_y")
        while not left.isEmpty():
            reach *= WIDER
            hit = materialize(_distances(_far_pairs(left, segments, reach, "_id", keys), reach, ["_id"], order).where(~none), "nearest-hits")
            found = found.unionByName(rows.join(hit, "_id").select(*told, "best"))
            left = materialize(left.join(hit.select("_id"), "_id", "left_anti"), "nearest-left")
    if whole:
        found = found.groupBy(point).agg(F.min("best").alias("best"))
    return found.select(*found.columns[:-1], "best.*")


def shape_segments(vertices: DataFrame, key: str | list[str] = "object_id", closed: Column | None = None) -> DataFrame:
    """(key, part, hole, x1, y1, x2, y2, first): the segments of shapes (key, part, hole, seq, x, y) and whether one is the first of its ring. Where
    `closed` holds (areas), the last vertex of a ring is joined to its first; a part of one vertex is a segment without length."""
    ring = [*([key] if isinstance(key, str) else key), "part", "hole"]
    w = W.partitionBy(*ring).orderBy("seq")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    closed = F.lit(False) if closed is None else closed
    v = vertices.withColumns({"_nx": F.lead("x").over(w), "_ny": F.lead("y").over(w), "_fx": F.first("x").over(whole), "_fy": F.first("y").over(whole), "_n": F.count("*").over(whole), "first": F.row_number().over(w) == 1})
    last = F.col("_nx").isNull()
    v = v.where(~last | closed | (F.col("_n") == 1))
    back = lambda n, f: F.when(~last, F.col(n)).otherwise(F.col(f))
    return v.select(*ring, F.col("x").alias("x1"), F.col("y").alias("y1"), back("_nx", "_fx").alias("x2"), back("_ny", "_fy").alias("y2"), "first")
