"""Counting and summing over overlaps of intervals, and their pairs.

Every overlap predicate used here is a difference of two prefix sums over variants' starts or ends, so counts never list pairs.
Points are summed up by position first, with map-side combine, and indexed by an adaptive directory: a key's range is cut into equal buckets, some
FILL positions each on average and FAN at most; a bucket of more than MOST positions is cut again by its own range, until none is longer. So a row is bounded for any
positions, a far outlier or clusters included; each key has its own widths and no rows beyond its own range; and the running totals of a cut are at most FAN rows.
Regions find their row by equi-joins, one a level (mostly two), and their place in it by bisection: they are never
exploded, made distinct or grouped again, and are not shuffled at all where the directory is small enough to broadcast. Pairs come from an equi-join over bins of several widths.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType, VariantType

from ..functions.staging import written

#: The narrowest bins of the join that lists pairs; each level's are STEP times as wide.
BUCKET, STEP, LEVELS = 1 << 10, 8, 17
#: Positions that a bucket holds on average and at most, and into how many a range is cut at most.
FILL, MOST, FAN = 8, 64, 4096
#: A level of the directory is broadcast up to so many bytes (8 an entry, and 24 for each of its sums).
BROADCAST_BYTES = 32 << 20
#: A side of the join that lists pairs is broadcast up to so many bytes in memory.
PAIRS_BYTES = 16 << 20

#: predicate -> the two terms (side of variants, position below which to sum), taken as first less second.
#: count: v.start < end and v.end >= start; point: start < v.end <= end; up: start <= v.start <= end;
#: down: start <= v.end <= end; closed: v.start <= end and v.end >= start.
PREDICATES = {
    "count": (("start", "end"), ("end", "start")),
    "point": (("end", "end + 1"), ("end", "start + 1")),
    "up": (("start", "end + 1"), ("start", "start")),
    "down": (("end", "end + 1"), ("end", "start")),
    "closed": (("start", "end + 1"), ("end", "start")),
}


def condition(predicate: str, v_start: Column, v_end: Column, start: Column, end: Column) -> Column:
    """The same predicates as row conditions."""
    return {
        "count": (v_start < end) & (v_end >= start),
        "point": (start < v_end) & (v_end <= end),
        "up": (start <= v_start) & (v_start <= end),
        "down": (start <= v_end) & (v_end <= end),
        "closed": (v_start <= end) & (v_end >= start),
    }[predicate]


def fresh(columns: list[str], name: str) -> str:
    """A beginning of names that no column begins with (upper and lower case are the same to Spark)."""
    taken = [c.lower() for c in columns]
    while any(c.startswith(name) for c in taken):
        name += "_"
    return name


class Level(NamedTuple):
    """One level of a directory: rows (keys, origin, sub, xs, sums, lo, width, cut), one a bucket. A bucket has either its positions in xs or lo, width and cut, from where
    and by what width into how many it is cut again."""

    rows: DataFrame
    longest: int
    broadcast: bool


class Index(NamedTuple):
    """Prefix sums by position: root has (keys, lo, width, cut), a row a key."""

    root: DataFrame
    root_broadcast: bool
    levels: list[Level]


class Points(NamedTuple):
    """Prefix sums over variants' starts and ends, for several questions to the same variants: see variant_points."""

    index: Index
    by: list[str]
    weights: dict[str, DataType]


def prefix_index(points: DataFrame, keys: list[str], sums: list[str], most: int | None = None) -> Index:
    """The directory of points: keys (rows with a null among them or in x match nothing), x, a whole number, and sums, which add exactly.

    most: another bound on the positions of a row; it is no part of results.
    """
    most, fill = most or MOST, min(FILL, most or FILL)
    known = points.where(" AND ".join(f"`{k}` IS NOT NULL" for k in [*keys, "x"]))
    # Written, as each level asks for it several times, and what is before it may be long (files, a blacklist).
    at = written(known.groupBy(*keys, "x").agg(*(F.sum(c).alias(c) for c in sums)), "positions")
    stats = at.groupBy(*keys).agg(*_shape(F.min("x"), F.max("x"), F.count("*"), fill))
    here, levels = at.join(stats, keys), []
    while True:
        here = here.withColumn("sub", F.expr("(x - lo) div width")).withColumnRenamed("lo", "origin")
        rows = written(_buckets(here, keys, sums, most, fill), "prefix")
        size = F.size("xs") + 1
        found = rows.agg(F.max(F.size("xs")).alias("longest"), F.count("lo").alias("cut"), F.sum(size).alias("entries"), F.count_if(F.col("sub") == 0).alias("ranges")).first()
        small = (found.entries or 0) * (8 + 24 * len(sums)) <= BROADCAST_BYTES
        levels.append(Level(rows, found.longest or 0, small))
        if len(levels) == 1:
            root = rows.where("sub = 0").select(*keys, F.col("origin").alias("lo"), F.col("own_width").alias("width"), F.col("own_cut").alias("cut"))
            root_broadcast = found.ranges * 128 <= BROADCAST_BYTES
        if not found.cut:
            return Index(root, root_broadcast, levels)
        again = rows.where("lo IS NOT NULL").select(*keys, "origin", "sub", "lo", "width", "cut")
        here = written(here.drop("width", "cut").join(again, [*keys, "origin", "sub"]).select(*keys, "x", *sums, "lo", "width", "cut"), "points")


def _shape(lo: Column, hi: Column, n: Column, fill: int) -> tuple[Column, Column, Column]:
    """lo, width and cut of a range that holds n different positions from lo to hi."""
    parts = F.least(F.lit(FAN).cast("long"), F.ceil(n / fill))
    width = F.ceil((hi - lo + 1) / parts).cast("long")
    return lo.alias("lo"), width.alias("width"), F.floor((hi - lo) / width).alias("cut")


def _buckets(points: DataFrame, keys: list[str], sums: list[str], most: int, fill: int) -> DataFrame:
    """A row for each bucket of each range, empty ones too. points: keys, origin, width, cut, sub, x, sums."""
    own = [*keys, "origin"]
    totals = points.groupBy(*own, "sub").agg(F.first("width").alias("own_width"), F.first("cut").alias("own_cut"), F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), *(F.sum(c).alias(f"t_{c}") for c in sums))
    order = W.partitionBy(*own).orderBy("sub")  # FAN rows at most
    base = [F.coalesce(F.sum(f"t_{c}").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"b_{c}") for c in sums]
    known = totals.select("*", *base, F.lead("sub", 1).over(order).alias("next"))
    dense = known.select("*", F.col("sub").alias("full"), F.explode(F.sequence("sub", F.coalesce(F.col("next") - 1, "own_cut"))).alias("at")).drop("sub").withColumnRenamed("at", "sub")
    filled, whole = F.col("sub") == F.col("full"), F.col("n") <= most
    shape = _shape(F.col("least"), F.col("most"), F.col("n"), fill)
    dense = dense.select(*own, "sub", "own_width", "own_cut", *((F.col(f"b_{c}") + F.when(filled, 0).otherwise(F.col(f"t_{c}"))).alias(f"b_{c}") for c in sums), *(F.when(filled & ~whole, c).alias(n) for c, n in zip(shape, ("lo", "width", "cut"), strict=True)))
    upto = W.partitionBy(*own, "sub").orderBy("x").rowsBetween(W.unboundedPreceding, W.currentRow)
    kept = points.join(totals.where(whole).select(*own, "sub"), [*own, "sub"], "left_semi")
    local = kept.select(*own, "sub", F.struct("x", *(F.sum(c).over(upto).alias(c) for c in sums)).alias("p")).groupBy(*own, "sub").agg(F.sort_array(F.collect_list("p")).alias("p"))
    running = [F.concat(F.array(F.col(f"b_{c}")), F.coalesce(_plus(F.col(f"p.{c}"), F.col(f"b_{c}")), F.array())).alias(c) for c in sums]
    return dense.join(local.hint("merge"), [*own, "sub"], "left").select(*own, "sub", "own_width", "own_cut", F.coalesce("p.x", F.array()).alias("xs"), *running, "lo", "width", "cut")


def _plus(values: Column, base: Column) -> Column:
    return F.transform(values, lambda v: v + base)


def _smaller(xs: Column, x: Column, longest: int) -> Column:
    """How many of xs, which rise, are smaller than x: bisection by falling powers of two."""
    steps = F.array(*(F.lit(1 << i) for i in range(max(longest, 1).bit_length() - 1, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda p, step: F.when(F.get(xs, p + step - 1) < x, p + step).otherwise(p))


def prefix_sums(regions: DataFrame, index: Index, keys: dict[str, Column], asked: dict[str, Column], sums: list[str], name: str) -> DataFrame:
    """regions with, for each asked position, the totals over smaller ones: columns name + asked's name + "_" + a name of sums."""
    out, own = regions, [F.col(f"`{c}`") for c in regions.columns]
    done: list[Column] = []

    def joined(df: DataFrame, rows: DataFrame, hint: bool, more: dict[str, Column]) -> DataFrame:
        t, on = rows.select(*(F.col(c).alias(f"{name}t_{c}") for c in rows.columns)), F.lit(True)
        for k, v in (keys | more).items():
            on &= v == F.col(f"{name}t_{k}")
        return df.join(F.broadcast(t) if hint else t.hint("merge"), on, "left")

    shape = [F.col(f"{name}t_{c}").alias(f"{name}{c}") for c in ("lo", "width", "cut")]
    for ask, x in asked.items():
        totals = [F.col(f"{name}{ask}_{s}") for s in sums]
        out = joined(out, index.root, index.root_broadcast, {}).select(*own, *done, *shape)
        for depth, level in enumerate(index.levels):
            # At or before the least position of its range, nothing is smaller.
            sub = F.when(x > F.col(f"{name}lo"), F.least(F.floor((x - F.col(f"{name}lo")) / F.col(f"{name}width")), F.col(f"{name}cut")))
            rows = level.rows.drop("own_width", "own_cut")
            out = joined(out, rows, level.broadcast, {"origin": F.col(f"{name}lo"), "sub": sub}).withColumn(f"{name}place", _smaller(F.col(f"{name}t_xs"), x, level.longest))
            found = [F.coalesce(F.get(F.col(f"{name}t_{s}"), F.col(f"{name}place")), F.lit(0)) + (t if depth else 0) for s, t in zip(sums, totals, strict=True)]
            out = out.select(*own, *done, *(f.alias(f"{name}{ask}_{s}") for f, s in zip(found, sums, strict=True)), *shape)
        done += totals
    return out.select(*own, *done)


def variant_points(variants: DataFrame, weights: list[str] | None = None, by: list[str] | None = None, sides: tuple[str, ...] = ("end", "start"), bucket: int | None = None) -> Points:
    """Prefix sums of variants, made once, for overlap_sums: of their number and of weights, by further columns, over the sides that will be asked."""
    weights, by = weights or [], by or []
    sums = ["n", *(f"w{i}" for i in range(len(weights)))]
    dealt = F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"`{s}`").alias("x")) for s in sides))
    kinds = {w: variants.schema[w].dataType for w in weights}
    summed = [F.lit(1).cast("long").alias("n"), *(F.coalesce(F.col(f"`{w}`"), F.lit(0).cast(kind)).alias(f"w{i}") for i, (w, kind) in enumerate(kinds.items()))]
    points = variants.where("`start` IS NOT NULL AND `end` IS NOT NULL").select("chrom", *by, F.explode(dealt).alias("p"), *summed).select("chrom", *by, "p.side", "p.x", *sums)
    return Points(prefix_index(points, ["chrom", *by, "side"], sums, bucket), by, kinds)


def overlap_sums(regions: DataFrame, variants: DataFrame | Points, predicate: str = "count", weights: list[str] | None = None, by: list[str] | None = None, bucket: int | None = None, side: Column | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """regions with n, the number of overlapping variants, and sum_<w>, the total of each weight (null counts 0).

    regions and variants: chrom, start, end (start <= end); rows with a null among them are left out. weights: columns of variants that sum exactly (whole numbers, decimals);
    by: further columns that must be equal (a permutation's number). Other columns of regions may have any names but n and sum_<w>; names: other names for these two.
    variants may also be their points, made before with the same by and these weights among theirs. side: start or end, a region's own instead of the predicate's.
    """
    weights = weights or []
    terms = PREDICATES[predicate]
    points = variants if isinstance(variants, Points) else variant_points(variants, weights, by, ("end", "start") if side is not None else tuple(sorted({s for s, _ in terms})), bucket)
    if points.by != (by or []):
        raise ValueError("the points were made by other columns")
    keys, known_weights = ["chrom", *points.by], list(points.weights)
    asked = {"n": ("n", "long")} | {f"sum_{w}": (f"w{known_weights.index(w)}", points.weights[w]) for w in weights}
    sums = [s for s, _ in asked.values()]
    name = fresh(regions.columns, "__o")
    place = lambda x: F.expr(x.replace("end", "`end`"))
    out = regions.where(" AND ".join(f"`{k}` IS NOT NULL" for k in [*keys, "start", "end"]))
    for ask, (own, x) in zip("ab", terms, strict=True):
        out = prefix_sums(out, points.index, {k: F.col(f"`{k}`") for k in keys} | {"side": F.lit(own) if side is None else side}, {ask: place(x)}, sums, name)
    less = [(F.col(f"{name}a_{s}") - F.col(f"{name}b_{s}")).cast(kind).alias((names or {}).get(c, c)) for c, (s, kind) in asked.items()]
    return out.select(*(F.col(f"`{c}`") for c in regions.columns), *less)


def _level(start: Column, end: Column, bucket: int) -> Column:
    """The level whose bins are the first as wide as the interval."""
    return sum((F.when(end - start > bucket * STEP**i, 1).otherwise(0) for i in range(LEVELS - 1) if bucket * STEP**i < 1 << 62), F.lit(0))


def _lived(rows: DataFrame, level: Column) -> tuple[list[int], int, int]:
    """The levels that rows live on, their number, and about how many bytes they take in memory: 16 a field, and those of strings. Other kinds of columns may be of any size."""
    strings = [f.name for f in rows.schema if isinstance(f.dataType, StringType)]
    if any(isinstance(f.dataType, (ArrayType, BinaryType, MapType, StructType, VariantType)) for f in rows.schema):
        size = F.lit(PAIRS_BYTES + 1)
    else:
        size = sum((F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) for c in strings), F.lit(16 * len(rows.columns)))
    found = rows.groupBy(level.alias("l")).agg(F.count("*").alias("n"), F.sum(size.cast("long")).alias("bytes")).collect()
    return sorted(x.l for x in found), sum(x.n for x in found), sum(x.bytes for x in found)


def overlap_pairs(regions: DataFrame, variants: DataFrame, predicate: str = "closed", bucket: int = BUCKET, levels: tuple[list[int] | None, list[int] | None] = (None, None)) -> DataFrame:
    """Each overlapping pair once: regions' columns (none may be a column of variants with the prefix v_), then variants' with that prefix. Rows with a null chrom, start or end meet nothing.

    Bins have widths bucket, STEP * bucket, and so on. An interval is at home in one bin, that of its start, among the first bins as wide as itself, however long
    it is. Of a pair the longer (regions' of equals) is at home and the other visits: at each level that the other side lives on, from its own up, the
    two or three bins whose residents can reach it. Candidates are thus near in proportion to the longer one's length, and each pair meets once. levels: those that a side lives on, where they are known; else they are asked first.
    Predicates that ask for one side of variants take them as points there. A side that was asked and is small is broadcast; else both are sorted and merged, as the sizes of
    compressed files, by which Spark would choose, say little of the rows dealt to bins.
    """
    if clash := {c.lower() for c in regions.columns} & {f"v_{c}".lower() for c in variants.columns}:
        raise ValueError(f"regions have columns named as variants' would be: {', '.join(sorted(clash))}")
    r, v = (df.where("chrom IS NOT NULL AND start IS NOT NULL AND `end` IS NOT NULL") for df in (regions, variants))
    v = v.select(*(F.col(f"`{c}`").alias(f"v_{c}") for c in variants.columns))
    own = fresh([*r.columns, *v.columns], "__b")
    asked_sides = {s for s, _ in PREDICATES[predicate]}
    v_from, v_to = (F.col(f"v_{next(iter(asked_sides))}"),) * 2 if len(asked_sides) == 1 else (F.col("v_start"), F.col("v_end"))
    r_level, v_level = _level(F.col("start"), F.col("end"), bucket), _level(v_from, v_to, bucket)
    lived, sizes = [], []
    for df, level, known in ((r, r_level, levels[0]), (v, v_level, levels[1] or ([0] if len(asked_sides) == 1 else None))):
        found, rows, size = (known, None, None) if known else _lived(df, level)
        lived.append(found)
        sizes.append((rows, size))
    # At home only where the other side visits: from its own level up (variants) or above it (regions).
    homes = {"r": [i for i in lived[0] if i >= min(lived[1], default=LEVELS)], "v": [i for i in lived[1] if i > min(lived[0], default=LEVELS)]}

    def dealt(side: str, start: Column, end: Column, level: Column, least: Column) -> Column:
        none = F.array().cast("array<struct<home: string, l: int, b: bigint>>")
        home = none if not homes[side] else F.array(*(F.struct(F.lit(side).alias("home"), F.lit(i).alias("l"), F.floor(start / (bucket * STEP**i)).alias("b")) for i in homes[side]))
        other = "r" if side == "v" else "v"

        def visited(i: int) -> Column:
            first = F.floor(start / (bucket * STEP**i)) - 1
            return F.transform(F.sequence(first, F.greatest(F.floor(end / (bucket * STEP**i)), first)), lambda b: F.struct(F.lit(other).alias("home"), F.lit(i).alias("l"), b.alias("b")))

        asked = [F.when(F.lit(i) >= least, visited(i)).otherwise(none) for i in homes[other]]
        return F.explode(F.concat(F.filter(home, lambda h: h["l"] == level), *asked))

    left = r.withColumn(f"{own}r", dealt("r", F.col("start"), F.col("end"), r_level, r_level + 1))
    right = v.withColumn(f"{own}v", dealt("v", v_from, v_to, v_level, v_level))
    # A row goes to its home and to three bins a level; there its place takes some 64 bytes more.
    taken = [None if rows is None else (size + 64 * rows) * (1 + 3 * len(homes[other])) for (rows, size), other in zip(sizes, "vr", strict=True)]
    small = min((i for i in (0, 1) if taken[i] is not None and taken[i] <= PAIRS_BYTES), key=lambda i: taken[i], default=None)
    left, right = F.broadcast(left) if small == 0 else left, F.broadcast(right) if small == 1 else right if small == 0 else right.hint("merge")
    on = (F.col("chrom") == F.col("v_chrom")) & (F.col(f"{own}r") == F.col(f"{own}v")) & condition(predicate, F.col("v_start"), F.col("v_end"), F.col("start"), F.col("end"))
    return left.join(right, on).drop(f"{own}r", f"{own}v")


def without_blacklisted(rows: DataFrame, blacklist: DataFrame | Points) -> DataFrame:
    """rows that touch no blacklisted interval (closed predicate). blacklist: intervals or their points."""
    name = fresh(rows.columns, "__n")
    return overlap_sums(rows, blacklist, "closed", names={"n": name}).where(F.col(name) == 0).drop(name)


def interval_means(regions: DataFrame, signal: DataFrame, bucket: int | None = None, mean_name: str = "mean") -> DataFrame:
    """regions with mean (or mean_name): signal's average over the bases that it covers, weighted by overlap; 0 where it covers none.

    regions: an interval; signal: an interval and value (decimal). No pairs are listed: with V(x) and U(x) the sums of value and of value * position over signal's
    starts below x less those over its ends below x, the signal's sum from 0 to x is x * V(x) - U(x). Its covered bases are that of the value 1.
    """
    exact = "decimal(38,6)"
    value, start, end = F.col("value").cast(exact), F.col("start"), F.col("end")
    ends = [F.struct(x.alias("x"), (value * sign).cast(exact).alias("v"), (value * x.cast("decimal(12,0)") * sign).cast(exact).alias("u"), F.lit(sign).cast("long").alias("c"), (x * sign).alias("d")) for x, sign in ((start, 1), (end, -1))]
    points = signal.where("start IS NOT NULL AND `end` IS NOT NULL AND value IS NOT NULL").select("chrom", F.explode(F.array(*ends)).alias("p")).select("chrom", "p.*")
    sums, name = ["v", "u", "c", "d"], fresh(regions.columns, "__m")
    out = prefix_sums(regions, prefix_index(points, ["chrom"], sums, bucket), {"chrom": F.col("chrom")}, {"a": F.col("start"), "b": F.col("end")}, sums, name)
    upto = lambda at, x, v, u, kind: (F.col(f"{name}{at}_{v}") * x.cast("decimal(12,0)" if kind == exact else "long")).cast(kind) - F.col(f"{name}{at}_{u}")
    total = upto("b", F.col("end"), "v", "u", exact) - upto("a", F.col("start"), "v", "u", exact)
    bases = upto("b", F.col("end"), "c", "d", "long") - upto("a", F.col("start"), "c", "d", "long")
    mean = F.when(bases > 0, total.cast("double") / bases).otherwise(0.0)
    return out.select(*(F.col(f"`{c}`") for c in regions.columns), mean.alias(mean_name))
