"""Volumes as long tables: sample, y, x, z, val. Crops, slices, depth projections, thresholds, surfaces and zones.

Operators group by (sample, y, x) or finer and not by sample, so that one large sample is dealt over many tasks; a group of
a sample alone is an aggregate with partial sums. A depth column is never collected into a row unless the operator says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonegrain.functions.columns import above_line, range_threshold

AXES = ("y", "x", "z")
COLUMN = ["sample", "y", "x"]


def threshold(v: DataFrame, low: float, high: float, on: int = 255) -> DataFrame:
    return v.withColumn("val", range_threshold(F.col("val"), low, high, on))


def crop(v: DataFrame, extents: list[int], rebase: bool = True) -> DataFrame:
    """Inclusive extents (y1, y2, x1, x2, z1, z2), re-based to 0. The filter reaches the scan."""
    if len(extents) != 6:
        raise ValueError("extents are six numbers: y1, y2, x1, x2, z1, z2")
    at = dict(zip(AXES, zip(extents[::2], extents[1::2], strict=True), strict=True))
    kept = v.where(" and ".join(f"{a} between {lo} and {hi}" for a, (lo, hi) in at.items()))
    return kept.withColumns({a: F.col(a) - lo for a, (lo, _) in at.items()}) if rebase else kept


def slice_axis(v: DataFrame, n: int, axis: int) -> DataFrame:
    """One plane: axis 0 is y, 1 is x, 2 is z. The other two axes become row and col."""
    if axis not in (0, 1, 2):
        raise ValueError("Invalid axis given. Give axis as an integer between 0 and 2.")
    row, col = (a for i, a in enumerate(AXES) if i != axis)
    return v.where(F.col(AXES[axis]) == n).select("sample", F.col(row).alias("row"), F.col(col).alias("col"), "val")


def extent(v: DataFrame) -> DataFrame:
    """Smallest and largest index by axis."""
    return v.groupBy("sample").agg(*(f(a).alias(f"{a}_{n}") for a in AXES for n, f in (("min", F.min), ("max", F.max))))


def flip(v: DataFrame, axis: str = "z") -> DataFrame:
    """The axis turned round in each sample; its length comes from an aggregate, not from a window over the sample."""
    ends = v.groupBy("sample").agg((F.min(axis) + F.max(axis)).alias("ends"))
    return v.join(ends, "sample").withColumn(axis, F.col("ends") - F.col(axis)).drop("ends")


def permute(v: DataFrame, order: tuple[str, str, str]) -> DataFrame:
    """order: the axes that become y, x and z."""
    return v.select("sample", *(F.col(old).alias(new) for old, new in zip(order, AXES, strict=True)), "val")


def vector_to_volume(vectors: DataFrame, height: int, width: int) -> DataFrame:
    """(sample, pos, val) to voxels: pos = z * height * width + y * width + x."""
    plane = height * width
    pos = F.col("pos")
    return vectors.select("sample", F.floor(F.pmod(pos, F.lit(plane)) / width).cast("int").alias("y"), F.pmod(pos, F.lit(width)).cast("int").alias("x"), F.floor(pos / plane).cast("int").alias("z"), "val")


def volume_to_vector(v: DataFrame, height: int, width: int) -> DataFrame:
    return v.select("sample", (F.col("z") * (height * width) + F.col("y") * width + F.col("x")).cast("long").alias("pos"), "val")


def remove_artefacts(v: DataFrame, slope: float, offset: float, axis: str = "x") -> DataFrame:
    return v.withColumn("val", above_line(F.col(axis), F.col("z"), F.col("val"), slope, offset))


def minmax_to_byte(images: DataFrame, key: str = "image") -> DataFrame:
    """255 * (v - min) / (max - min) of the image, cut to a whole number; 0 for a flat image."""
    ends = images.groupBy(key).agg(F.min("val").alias("lo"), F.max("val").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("val") - F.col("lo")) * 255 / (F.col("hi") - F.col("lo")))).otherwise(0)
    return images.join(ends, key).withColumn("val", scaled.cast("int")).drop("lo", "hi")


def apply_mask(v: DataFrame, m: DataFrame, threshold: float | None = None) -> DataFrame:
    """val * p, or val where p is above the threshold; 0 elsewhere. m: sample, y, x, z, p, only where it isn't 0."""
    p = F.coalesce("p", F.lit(0.0))
    value = F.col("val") * p if threshold is None else F.when(p > threshold, F.col("val")).otherwise(0)
    return v.join(m.select(*COLUMN, "z", "p"), [*COLUMN, "z"], "left").withColumn("val", value).drop("p")


def mean_mask(a: DataFrame, b: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Voxels at which the mean of two masks reaches the threshold; a voxel that one mask lacks is 0 there."""
    both = a.select(*COLUMN, "z", "p").unionByName(b.select(*COLUMN, "z", "p"))
    return both.groupBy(*COLUMN, "z").agg((F.sum("p") / 2).alias("p")).where(F.col("p") >= threshold)


def place_mask(m: DataFrame, offset: int, depth: int) -> DataFrame:
    """A mask put into a volume of `depth` layers at a z offset, probabilities as bytes; what sticks out is cut."""
    moved = m.withColumn("z", F.col("z") + offset).where((F.col("z") >= 0) & (F.col("z") < depth))
    return moved.withColumn("val", F.floor(F.col("p") * 255).cast("int")).drop("p")


def mask_minus(v: DataFrame, m: DataFrame) -> DataFrame:
    return v.join(m.select(*COLUMN, "z"), [*COLUMN, "z"], "left_anti")


def mask_and(v: DataFrame, m: DataFrame) -> DataFrame:
    return v.join(m.select(*COLUMN, "z"), [*COLUMN, "z"], "left_semi")


# --- thresholds -------------------------------------------------------------------------------------------------------


def otsu(values: DataFrame, keys: list[str]) -> DataFrame:
    """The threshold of each group that parts its 256-bin histogram with the largest variance between classes; of ties the lowest. Whole-number sums; at most 256 rows a group after the count."""
    counts = values.groupBy(*keys, "val").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("val").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    sums = counts.select(*keys, "val", F.sum("n").over(upto).alias("n0"), F.sum(F.col("n") * F.col("val")).over(upto).alias("s0"), F.sum("n").over(whole).alias("n"), F.sum(F.col("n") * F.col("val")).over(whole).alias("s"))
    n0, s0, n, s = (F.col(c).cast("double") for c in ("n0", "s0", "n", "s"))
    between = F.when(n > n0, (s0 * n - s * n0) * (s0 * n - s * n0) / (n0 * (n - n0))).otherwise(-1.0)
    return sums.select(*keys, "val", between.alias("between")).groupBy(*keys).agg(F.max_by("val", F.struct("between", -F.col("val"))).alias("threshold"))


def otsu_volume(v: DataFrame) -> DataFrame:
    """floor of the mean of the mean thresholds of slices along x and along y."""
    along = [otsu(v.select("sample", F.col(a).alias("slice"), "val"), ["sample", "slice"]).groupBy("sample").agg(F.avg("threshold").alias(f"t_{a}")) for a in ("x", "y")]
    return along[0].join(along[1], "sample").select("sample", F.floor((F.col("t_x") + F.col("t_y")) / 2).cast("int").alias("threshold"))


# --- depth ------------------------------------------------------------------------------------------------------------


def projection(v: DataFrame, threshold: float) -> DataFrame:
    """Voxels above the threshold, and the sum of values, along z."""
    return v.groupBy(*COLUMN).agg(F.sum((F.col("val") > threshold).cast("long")).alias("n_above"), F.sum("val").cast("long").alias("total"))


def surface(v: DataFrame, threshold: float, last: bool = False) -> DataFrame:
    """First z above the threshold (last: last z > 0) of each column; 0 when there is none."""
    hit = F.when((F.col("val") > threshold) & ((F.col("z") > 0) if last else F.lit(True)), F.col("z"))
    return v.groupBy(*COLUMN).agg(F.coalesce((F.max if last else F.min)(hit), F.lit(0)).alias("surface"))


def first_below(v: DataFrame, thickness: int, threshold_table: DataFrame) -> DataFrame:
    """The first `thickness` voxels of each column above its sample's threshold, from the surface down, packed: new z = rank - 1."""
    t = v.join(threshold_table, "sample").where(F.col("val") > F.col("threshold")).drop("threshold")
    rank = F.row_number().over(Window.partitionBy(*COLUMN).orderBy("z"))
    return t.withColumn("rank", rank).where(F.col("rank") <= thickness).withColumn("z", F.col("rank") - 1).drop("rank")


def mean_std(v: DataFrame, above: float | None = None) -> DataFrame:
    """mean + std along z of voxels above the background: sum / (n + 1e-9) and sqrt(squares / (n - 1 + 1e-9))."""
    x = F.when(F.col("val") > above, F.col("val")) if above is not None else F.col("val")
    sums = v.groupBy(*COLUMN).agg(F.count(x).alias("n"), F.coalesce(F.sum(x), F.lit(0)).cast("double").alias("s"), F.coalesce(F.sum(x * x), F.lit(0)).cast("double").alias("ss"))
    mean = F.col("s") / (F.col("n") + 1e-9)
    spread = F.col("ss") - 2 * mean * F.col("s") + F.col("n") * mean * mean
    std = F.when(F.col("n") > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (F.col("n") - 1 + 1e-9))).otherwise(0.0)
    return sums.select(*COLUMN, "n", mean.alias("mean"), std.alias("std"), (mean + std).alias("val"))


def first_n_stats(v: DataFrame, depth: int = 0, margin: int = 0, size: int | None = None) -> DataFrame:
    """Mean and sd of the first `depth` (0: all) voxels that aren't zero, from the largest z down; columns without any give 0."""
    kept = v if not margin else v.where(F.col("y").between(margin, size - 1 - margin) & F.col("x").between(margin, size - 1 - margin))
    rank = F.row_number().over(Window.partitionBy(*COLUMN).orderBy(F.desc("z")))
    full = kept.where("val > 0").withColumn("rank", rank)
    some = full.where(F.col("rank") <= depth) if depth else full
    stats = some.groupBy(*COLUMN).agg(F.avg("val").alias("mean"), F.coalesce(F.stddev_samp("val"), F.lit(0.0)).alias("sd"))
    grid = kept.select(*COLUMN).distinct()
    return grid.join(stats, COLUMN, "left").select(*COLUMN, F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("sd", F.lit(0.0)).alias("sd"))


def slabs(v: DataFrame, surfaces: DataFrame, zones: dict[str, tuple[int, int]]) -> DataFrame:
    """Voxels of each zone: surface + from < z <= surface + to, as (zone, sample, y, x, z, val); z from the zone's top."""
    table = F.array(*(F.struct(F.lit(k).alias("zone"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in zones.items()))
    deep = F.col("z") - F.col("surface")
    return v.join(surfaces, COLUMN).withColumn("s", F.explode(table)).where((deep > F.col("s.a")) & (deep <= F.col("s.b"))).select(F.col("s.zone").alias("zone"), *COLUMN, (deep - F.col("s.a") - 1).alias("z"), "val")


def tissue_depth(v: DataFrame, threshold: float, share: float = 0.6) -> DataFrame:
    """Mean of (last - first) index above the threshold, and the deep depth int(share * mean)."""
    hit = F.when(F.col("val") > threshold, F.col("z"))
    ends = v.groupBy(*COLUMN).agg(F.coalesce(F.max(hit), F.lit(0)).alias("last"), F.coalesce(F.min(hit), F.lit(0)).alias("first"))
    return ends.groupBy("sample").agg(F.avg(F.col("last") - F.col("first")).alias("depth")).withColumn("deep_depth", F.floor(F.col("depth") * share).cast("int"))


def surface_range(v: DataFrame, threshold: float, pad: int = 50) -> DataFrame:
    """Smallest and largest surface of a sample, padded to a crop range."""
    return surface(v, threshold).groupBy("sample").agg((F.min("surface") - pad).alias("z1"), (F.max("surface") + pad).alias("z2"))


def centre(v: DataFrame, threshold: float) -> DataFrame:
    """Mean coordinates of columns with a voxel above the threshold (rounded), and the centre of mass by counts (cut)."""
    w = projection(v, threshold).where("n_above > 0")
    return w.groupBy("sample").agg(F.round(F.avg("y")).cast("int").alias("mean_y"), F.round(F.avg("x")).cast("int").alias("mean_x"), F.floor(F.sum(F.col("y") * F.col("n_above")) / F.sum("n_above")).cast("int").alias("mass_y"), F.floor(F.sum(F.col("x") * F.col("n_above")) / F.sum("n_above")).cast("int").alias("mass_x"))


def centre_crop(v: DataFrame, threshold: float, side: int) -> DataFrame:
    """A square of `side` around the sample's centre of mass, moved inside the extent, re-based to 0."""
    ends = extent(v).drop("z_min", "z_max")
    at = centre(v, threshold).select("sample", "mass_y", "mass_x").join(ends, "sample")
    low = lambda a: F.greatest(F.col(f"{a}_min"), F.least(F.col(f"mass_{a}") - side // 2, F.col(f"{a}_max") - side + 1))
    box = at.select("sample", low("y").alias("y1"), low("x").alias("x1"))
    return v.join(box, "sample").where((F.col("y") >= F.col("y1")) & (F.col("y") < F.col("y1") + side) & (F.col("x") >= F.col("x1")) & (F.col("x") < F.col("x1") + side)).select("sample", (F.col("y") - F.col("y1")).alias("y"), (F.col("x") - F.col("x1")).alias("x"), "z", "val")


def tile_means(v: DataFrame, height: int, width: int) -> DataFrame:
    """Means over tiles of height by width at each z."""
    return v.groupBy("sample", F.floor(F.col("y") / height).cast("int").alias("tile_y"), F.floor(F.col("x") / width).cast("int").alias("tile_x"), "z").agg(F.avg("val").alias("val"))


def slice_boxes(v: DataFrame, threshold: float) -> DataFrame:
    """Bounding box of the voxels above the threshold in each layer."""
    return v.where(F.col("val") > threshold).groupBy("sample", "z").agg(F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"))


def edge_angle(boxes: DataFrame, edge: str = "x1") -> DataFrame:
    """Angle in degrees of a box edge along z: total least squares, 0.5 * atan2(2 cov, var z - var edge); and the slope of plain least squares."""
    z, e = F.col("z").cast("double"), F.col(edge).cast("double")
    return boxes.groupBy("sample").agg(F.degrees(0.5 * F.atan2(2 * F.covar_pop(z, e), F.var_pop(z) - F.var_pop(e))).alias("angle"), F.regr_slope(e, z).alias("slope"), F.regr_intercept(e, z).alias("intercept"))


def plane_angle(points: DataFrame, a: str, b: str) -> DataFrame:
    """Direction of the first principal axis of points (a, b) in degrees."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    return points.groupBy("sample").agg(F.degrees(0.5 * F.atan2(2 * F.covar_pop(x, y), F.var_pop(x) - F.var_pop(y))).alias("angle"))


def void_zones(v: DataFrame, interface: DataFrame, deep: int, calcified: int, offset: int, threshold: float) -> DataFrame:
    """Deep and calcified zones at an interface, with a test for voids; z counts from the start of the zone.

    The base of a column lies `offset` above its interface; where the interface is nearer to the top than `deep` it is
    `deep`, where it is nearer to the end than `calcified` it is the last place that leaves room. A void is a value below threshold / 2
    among the `deep` voxels up to the base. A sound column has its calcified zone from the base on and its deep zone
    before it. On a void below `deep` the calcified zone starts at base + offset, if that leaves room, and the deep zone
    ends at the last voxel from base - offset (from the base where there is no room) upward that reaches the threshold, at
    `deep` at the latest. Indexes before the top or beyond the end are no voxels.
    """
    depth = v.groupBy("sample").agg((F.max("z") + 1).alias("depth"))  # one row a sample
    z, base = F.col("z"), F.col("base")
    place = F.when(F.col("surface") < deep, F.lit(deep)).when(F.col("depth") - F.col("surface") < calcified, F.col("depth") - calcified).otherwise(F.col("surface") - offset)
    t = v.join(interface, COLUMN).join(depth, "sample").withColumn("base", place)
    walk = F.when(base - deep > offset, base - offset).otherwise(base)
    found = t.groupBy(*COLUMN).agg(F.max(((z > base - deep) & (z <= base) & (F.col("val") < threshold / 2) & (base > deep)).cast("int")).alias("void"), F.max(F.when((z <= walk) & (z > deep) & (F.col("val") >= threshold), z)).alias("tissue"))
    void = F.col("void") == 1
    t = t.join(found, COLUMN).withColumns({"end": F.when(void, F.greatest(F.lit(deep), F.coalesce("tissue", F.lit(deep)))).otherwise(base), "start": F.when(void & (base < F.col("depth") - calcified), base + offset).otherwise(base)})
    zones = F.array(F.struct(F.lit("deep").alias("zone"), (z - F.col("end") + deep).alias("at"), F.lit(deep).alias("size")), F.struct(F.lit("calc").alias("zone"), (z - F.col("start")).alias("at"), F.lit(calcified).alias("size")))
    return t.select(*COLUMN, "val", "void", F.inline(F.filter(zones, lambda e: (e["at"] >= 0) & (e["at"] < e["size"])))).select("zone", *COLUMN, F.col("at").cast("int").alias("z"), "val", "void")


def drop_cut(v: DataFrame, extent: tuple[int, int, int, int], threshold: float, low: int = 0, high: int = 650, step: int = 4, window: int = 50, weight: float = 20.0, ones: float = 192.0, beyond: int = 20) -> DataFrame:
    """sample, ry, rx, cut: for each of 4 by 4 regions, an eighth of the extent (y1, y2, x1, x2, ends included) wide, the depth to keep.

    At every `step`-th z from low up to high a window is flagged if its values above the threshold sum to more than weight * ones^2.
    The windows end at the first drop from flagged to not flagged after the second one. The cut is the last flagged
    z + beyond, at most the depth of the sample; the whole depth if nothing, or only z = 0, is flagged.
    """
    y1, y2, x1, x2 = extent
    side = (y2 - y1 + 1) // 8, (x2 - x1 + 1) // 8
    region = [F.floor((F.col(c) - first) / s).cast("int").alias(f"r{c}") for c, first, s in zip("yx", (y1, x1), side, strict=True)]
    depth = v.groupBy("sample").agg((F.max("z") + 1).alias("depth"))
    inside = v.where((F.col("y") >= y1) & (F.col("y") < y1 + 4 * side[0]) & (F.col("x") >= x1) & (F.col("x") < x1 + 4 * side[1]))
    sums = inside.groupBy("sample", *region, "z").agg(F.sum(F.when(F.col("val") > threshold, F.col("val")).otherwise(0)).alias("n"))
    key = ["sample", "ry", "rx"]
    order = Window.partitionBy(*key).orderBy("z")
    seen = sums.withColumn("flag", F.sum("n").over(order.rangeBetween(0, window - 1)) / (ones * ones) > weight)
    seen = seen.where((F.col("z") >= low) & (F.col("z") < high) & (F.pmod(F.col("z") - low, F.lit(step)) == 0)).withColumn("was", F.lag("flag").over(order))
    ended = seen.withColumn("dropped", F.max((F.col("was") & ~F.col("flag") & (F.col("z") > low + step)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = ended.groupBy(*key).agg(F.max(F.when(F.col("flag") & (F.coalesce("dropped", F.lit(0)) == 0), F.col("z"))).alias("last"))
    return last.join(depth, "sample").select(*key, F.when(F.coalesce("last", F.lit(0)) == 0, F.col("depth")).otherwise(F.least(F.col("last") + beyond, "depth")).cast("int").alias("cut"))


def fill_below(m: DataFrame, edge: DataFrame) -> DataFrame:
    """A mask without what lies at or below the first edge row of its column (slice z, column x)."""
    first = edge.groupBy("sample", "z", "x").agg(F.min("y").alias("first"))
    return m.join(first, ["sample", "z", "x"], "left").where(F.col("first").isNull() | (F.col("y") < F.col("first"))).drop("first")


def region_cut(v: DataFrame, regions: DataFrame) -> DataFrame:
    """Voxels above the cut of their region. regions: sample, y1, y2, x1, x2, cut (bounds exclusive at the end); joined by sample, tested as ranges."""
    r = regions.select("sample", *(F.col(c).alias(f"_{c}") for c in ("y1", "y2", "x1", "x2", "cut")))
    return v.join(r, "sample").where((F.col("y") >= F.col("_y1")) & (F.col("y") < F.col("_y2")) & (F.col("x") >= F.col("_x1")) & (F.col("x") < F.col("_x2")) & (F.col("z") < F.col("_cut"))).select(*v.columns)


def running_median(s: DataFrame, key: str, order: str, value: str, size: int = 5) -> DataFrame:
    """Median of a sliding window of a series, with zeros beyond its ends."""
    h = size // 2
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-h, h)
    got = F.collect_list(value).over(w)
    return s.withColumn("median", F.element_at(F.array_sort(F.concat(got, F.array_repeat(F.lit(0.0), F.lit(size) - F.size(got)))), h + 1))


def scale_means(v: DataFrame, factor: int) -> DataFrame:
    """Rescaled down by a whole factor: block means."""
    return v.groupBy("sample", *(F.floor(F.col(a) / factor).cast("int").alias(a) for a in AXES)).agg(F.avg("val").alias("val"))


def resample(v: DataFrame, mapping: list[Column], grid: DataFrame) -> DataFrame:
    """Values of a volume at inverse-mapped points of an output grid (sample, y, x, z), linear between eight voxels; 0 outside.

    mapping: where (y, x, z) of the grid lie in the volume, as columns. Each output voxel reads the neighbours that have a
    weight, by an equi-join.
    """
    at = grid.select("sample", *AXES, *(m.cast("double").alias(f"f{a}") for a, m in zip(AXES, mapping, strict=True)))
    corners = at
    for a in AXES:
        low, part = F.floor(F.col(f"f{a}")), F.col(f"f{a}") - F.floor(F.col(f"f{a}"))
        corners = corners.withColumn(f"c{a}", F.explode(F.array(F.struct(low.alias("i"), (1 - part).alias("w")), F.struct((low + 1).alias("i"), part.alias("w"))))).where(f"c{a}.w > 0")
    near = corners.select("sample", *AXES, *(F.col(f"c{a}.i").alias(f"n{a}") for a in AXES), (F.col("cy.w") * F.col("cx.w") * F.col("cz.w")).alias("w"))
    source = v.select("sample", *(F.col(a).alias(f"n{a}") for a in AXES), "val")
    return near.join(source, ["sample", "ny", "nx", "nz"], "left").groupBy("sample", *AXES).agg(F.sum(F.col("w") * F.coalesce("val", F.lit(0))).alias("val"))


def rotated(v: DataFrame, degrees: Column, least: float = 0.0) -> DataFrame:
    """Each sample turned about z through its centre in the (y, x) plane, same extent; angles below `least` (absolute) leave it as it is."""
    import math

    ends = extent(v).select("sample", ((F.col("y_min") + F.col("y_max")) / 2).alias("cy"), ((F.col("x_min") + F.col("x_max")) / 2).alias("cx"))
    turn = F.when(F.abs(degrees) >= least, degrees).otherwise(0.0) * (math.pi / 180)
    grid = v.join(ends, "sample").withColumn("a", turn).select("sample", *AXES, "cy", "cx", "a")
    dy, dx = F.col("y") - F.col("cy"), F.col("x") - F.col("cx")
    # Rounded so that whole positions stay whole.
    back = [F.round(F.col("cy") + F.cos("a") * dy + F.sin("a") * dx, 9), F.round(F.col("cx") - F.sin("a") * dy + F.cos("a") * dx, 9), F.col("z")]
    return resample(v, back, grid)


def angle_search(v: DataFrame, angles: list[float], threshold: float) -> DataFrame:
    """sample, angle, loss: of the candidate turns that whose foreground columns fill the circle around their centre best.

    Loss 1 - dice of the columns above the threshold and the circle around their centroid through the farthest one. All
    angles are turned in one job; search on a volume that is scaled down.
    """
    table = F.explode(F.array(*map(F.lit, angles)))
    many = v.withColumn("angle", table).withColumn("name", F.col("sample"))
    turned = rotated(many.withColumn("sample", F.struct("name", "angle")).drop("name", "angle"), F.col("sample.angle"))
    cols = turned.where(F.col("val") > threshold).select("sample", "y", "x").distinct()
    mid = cols.groupBy("sample").agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.count("*").alias("n"))
    far = cols.join(mid, "sample").groupBy("sample").agg(F.max(F.hypot(F.col("y") - F.col("cy"), F.col("x") - F.col("cx"))).alias("r"), F.first("n").alias("n"))
    area = 3.141592653589793 * (F.col("r") + 0.5) * (F.col("r") + 0.5)
    loss = far.select(F.col("sample.name").alias("sample"), F.col("sample.angle").alias("angle"), (1 - 2 * F.least(F.col("n").cast("double"), area) / (F.col("n") + area)).alias("loss"))
    return loss.groupBy("sample").agg(F.min_by("angle", F.struct("loss", F.abs("angle"), "angle")).alias("angle"), F.min("loss").alias("loss"))
