"""Lines of several parts merged into chains by shared ends, so that an axis has one cumulative route."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadloom.functions.shared import materialize
from roadloom.operators.scans import BLOCK, along, deal, metres, nanometres, straight

#: Rounds of pointer doubling: chains of up to 2 ** ROUNDS parts.
ROUNDS = 40


def _follow(links: DataFrame, keys: list[str]) -> DataFrame:
    """links (keys, part, way, next_part, next_way) + (last_part, last_way, hops, least): where following the links ends, after how many
    steps, and the least part on the way; last_part is null where they run in a circle, and least is then the circle's. Pointer doubling:
    after each round a pointer spans twice as many links, so a chain of n parts takes log2(n) rounds and no task holds a chain."""
    here = [*keys, "part", "way"]
    at = links.select(*here, F.col("next_part").alias("p"), F.col("next_way").alias("w"), F.col("part").alias("last_part"), F.col("way").alias("last_way"), F.lit(0).cast("long").alias("hops"), F.col("part").alias("least"))
    # p, w: the first state that isn't covered yet; last_*: the last covered one; hops: to that one.
    at = materialize(at, "chains")
    n = at.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(min(ROUNDS, max(int(n).bit_length(), 1))):
        if at.where("p is not null").isEmpty():
            break
        to = at.select(*keys, F.col("part").alias("p"), F.col("way").alias("w"), F.col("p").alias("p2"), F.col("w").alias("w2"), F.col("last_part").alias("l2"), F.col("last_way").alias("lw2"), F.col("hops").alias("h2"), F.col("least").alias("m2"))
        j = at.join(to, [*keys, "p", "w"], "left")
        go = F.col("p").isNotNull()
        at = j.select(
            *here, F.when(go, F.col("p2")).alias("p"), F.when(go, F.col("w2")).alias("w"), F.when(go, F.col("l2")).otherwise(F.col("last_part")).alias("last_part"), F.when(go, F.col("lw2")).otherwise(F.col("last_way")).alias("last_way"),
            (F.col("hops") + F.when(go, F.col("h2") + 1).otherwise(0)).alias("hops"), F.least("least", F.when(go, F.col("m2"))).alias("least"),
        )
        at = materialize(at, "chains")
    return at.withColumn("last_part", F.when(F.col("p").isNull(), F.col("last_part"))).drop("p", "w")


def chain_parts(vertices: DataFrame, axis: str = "axis_id") -> DataFrame:
    """(axis, part, chain, rank, way): the parts of lines (axis, part, seq, x, y) chained where exactly two ends of parts meet.

    way is 1 where a part runs as it is and -1 where it is turned; a chain runs the way that most of its parts do, or as its least
    part. chain is its least part, rank the place from 0. Where three ends meet, or one is alone, chains end; a closed ring begins with
    its least part. Ends meet where their coordinates are equal. Parts without two different vertices are left out.
    """
    v = vertices.where("x is not null and y is not null")
    xy = lambda f, c: f(F.struct("x", "y"), "seq").alias(c)
    moved = v.groupBy(axis, "part").agg(xy(F.min_by, "a"), xy(F.max_by, "b"), F.min("x").alias("_x1"), F.max("x").alias("_x2"), F.min("y").alias("_y1"), F.max("y").alias("_y2"))
    ends = moved.where("_x1 < _x2 or _y1 < _y2").select(axis, "part", F.explode(F.array(F.struct(F.lit(-1).alias("end"), F.col("a.x").alias("x"), F.col("a.y").alias("y")), F.struct(F.lit(1).alias("end"), F.col("b.x").alias("x"), F.col("b.y").alias("y")))).alias("e")).select(axis, "part", "e.*")
    ends = materialize(ends, "chain-ends")
    # Both sums tell the other end: of two ends that meet, what isn't this one.
    meet = ends.groupBy(axis, "x", "y").agg(F.count("*").alias("n"), F.min(F.struct("part", "end")).alias("one"), F.max(F.struct("part", "end")).alias("two")).where("n = 2")
    own = F.struct("part", "end")
    j = ends.join(meet, [axis, "x", "y"], "left").withColumn("o", F.when(F.col("one") == own, F.col("two")).otherwise(F.col("one")))
    # A part that is left at its end 1 is run as it is; the next one is entered at the end that meets it.
    links = j.select(axis, "part", F.col("end").alias("way"), F.when(F.col("n") == 2, F.col("o.part")).alias("next_part"), F.when(F.col("n") == 2, -F.col("o.end")).alias("next_way"))
    links = materialize(links, "chain-links")
    found = _follow(links, [axis])
    rings = materialize(found.where("last_part is null").select(axis, "part", "way", "least"), "chain-rings")
    if not rings.isEmpty():
        # A ring is cut before its least part run as it is, and behind that part when turned.
        entry = links.join(rings, [axis, "part", "way"], "left").withColumn("cut", ((F.col("next_part") == F.col("least")) & (F.col("next_way") == 1)) | ((F.col("part") == F.col("least")) & (F.col("way") == -1)))
        links = entry.select(axis, "part", "way", *[F.when(~F.coalesce("cut", F.lit(False)), F.col(c)).alias(c) for c in ("next_part", "next_way")])
        found = _follow(materialize(links, "chain-links"), [axis])
    run = [axis, "last_part", "last_way"]
    runs = found.groupBy(*run).agg(F.min("part").alias("chain"), F.count("*").alias("parts"), F.sum("way").alias("straight"), F.min_by("way", "part").alias("first_way"))
    best = runs.withColumn("k", F.row_number().over(W.partitionBy(axis, "chain").orderBy(F.desc("straight"), F.desc("first_way"), "last_part", "last_way"))).where("k = 1")
    return found.join(best.select(*run, "chain", "parts"), run).select(axis, "part", "chain", (F.col("parts") - 1 - F.col("hops")).alias("rank"), "way")


def merged_segments(vertices: DataFrame, axis: str = "axis_id") -> DataFrame:
    """(axis, chain, seq, x1, y1, x2, y2, length, from_m): the segments of axes of several parts (axis, part, seq, x, y) along their merged
    chains. from_m runs on through the chains of an axis, in order of their least parts, and is summed in whole nanometres; no segment joins two chains."""
    chains = materialize(chain_parts(vertices, axis), "chains-ranked")
    v = vertices.where("x is not null and y is not null").join(chains, [axis, "part"]).withColumn("_o", F.col("way") * F.col("seq"))
    by = ["chain", "rank", "_o"]
    d, hot = deal(v.select(axis, "chain", "rank", "_o", "x", "y"), [axis], by, "merge-blocks")
    d = along(d, hot, [axis], by, lags={"_c": F.col("chain"), "x1": F.col("x"), "y1": F.col("y")})
    d = d.withColumn("length", F.when(F.col("_c") == F.col("chain"), straight(F.col("x") - F.col("x1"), F.col("y") - F.col("y1")))).where("length > 0")
    d = along(d, hot, [axis], by, sums={"_to": nanometres("length"), "seq": F.lit(1)})
    return d.select(axis, "chain", "seq", "x1", "y1", F.col("x").alias("x2"), F.col("y").alias("y2"), "length", metres(F.col("_to") - nanometres("length")).alias("from_m")).drop(BLOCK)
