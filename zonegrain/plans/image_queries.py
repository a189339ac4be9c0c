"""Queries of stencils, textures and noise, each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonegrain.functions.columns import tidy, uniform_code
from zonegrain.operators import stencil as S
from zonegrain.plans import views as T
from zonegrain.plans.views import sql

QUERIES, ORACLE = {}, {}


def _add(name: str, query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLE[name] = oracle


def _tidy(df, *cols):
    return df.withColumns({c: tidy(F.col(c)) for c in cols})


def _values(table) -> str:
    return "(VALUES " + ", ".join(f"({dy}, {dx}, {w!r}::DOUBLE)" for dy, dx, w in ((a, b, float(c)) for a, b, c in table)) + ") o(dy, dx, w)"


_EDGE = "H AS (SELECT max(y) AS hy FROM B)"


def _reflect(source: str, table, agg: str = "sum(w * s.val)") -> str:
    """Sums over neighbours of the one big image, 64 wide, reflected at its edges."""
    fold = lambda v, m: f"CASE WHEN {v} < 0 THEN -({v}) - 1 WHEN {v} > {m} THEN 2 * {m} + 1 - ({v}) ELSE {v} END"
    return f"(SELECT p.image, p.y, p.x, {agg} AS val FROM {source} p, H, {_values(table)} JOIN {source} s ON true WHERE s.y = {fold('p.y + dy', 'hy')} AND s.x = {fold('p.x + dx', '63')} GROUP BY ALL)".replace(f"{source} p, H, {_values(table)} JOIN {source} s ON true WHERE", f"(SELECT p.*, {fold('p.y + dy', 'hy')} AS sy, {fold('p.x + dx', '63')} AS sx, w FROM {source} p, H, {_values(table)}) p JOIN {source} s ON").replace(f"s.y = {fold('p.y + dy', 'hy')} AND s.x = {fold('p.x + dx', '63')}", "s.y = p.sy AND s.x = p.sx")


def _near(source: str, table, agg: str) -> str:
    """An aggregate over neighbours that exist."""
    return f"(SELECT p.image, p.y, p.x, {agg} AS val FROM (SELECT p.image, p.y, p.x, p.y + dy AS sy, p.x + dx AS sx, w FROM {source} p, {_values(table)}) p JOIN {source} s ON s.image = p.image AND s.y = p.sy AND s.x = p.sx GROUP BY ALL)"


_G1, _G2 = S.gauss(5, 1.5), S.gauss(3, 1.0)
_GY1, _GX1, _GY2, _GX2 = (S.box_1d(g, a) for g in (_G1, _G2) for a in "yx")
_add("gauss_standardise", lambda s, d: _tidy(S.standardise(T.big_image(s, d), 5, 1.5, 3, 1.0), "val"), sql("B", f", {_EDGE}, B1 AS {_reflect('B', _GY1)}, B2 AS {_reflect('B1', _GX1)}, C AS (SELECT B.image, B.y, B.x, B.val - B2.val AS val FROM B JOIN B2 USING (image, y, x)), Q AS (SELECT image, y, x, val * val AS val FROM C), Q1 AS {_reflect('Q', _GY2)}, Q2 AS {_reflect('Q1', _GX2)} SELECT C.image, C.y, C.x, round(C.val / (sqrt(greatest(Q2.val, 0)) + 1e-9), 6) + 0.0 AS val FROM C JOIN Q2 USING (image, y, x)"))
_MED = lambda k: f"list_sort(list(s.val) || [0 for z in range(0, {k * k} - count(*))])[{k * k // 2 + 1}]"
_add("median3", lambda s, d: S.median_filter(T.big_image(s, d), 3), sql("B", f" SELECT * FROM {_near('B', S.square(3), _MED(3))}"))
_add("dilate_erode", lambda s, d: S.dilate(T.big_image(s, d), 3).withColumnRenamed("val", "dilated").join(S.erode(T.big_image(s, d), 3).withColumnRenamed("val", "eroded"), S.PIXEL), sql("B", f" SELECT d.image, d.y, d.x, d.val AS dilated, e.val AS eroded FROM {_near('B', S.square(3), 'max(s.val)')} d JOIN {_near('B', S.square(3), 'min(s.val)')} e USING (image, y, x)"))
_add("close_gaps", lambda s, d: S.close(T.big_image(s, d), 3), sql("B", f", D AS {_near('B', S.square(3), 'max(s.val)')} SELECT * FROM {_near('D', S.square(3), 'min(s.val)')}"))
_add("sobel_mag", lambda s, d: _tidy(S.sobel(T.big_image(s, d)), "val"), sql("B", f", {_EDGE} SELECT a.image, a.y, a.x, round(sqrt(a.val * a.val + b.val * b.val), 6) + 0.0 AS val FROM {_reflect('B', S.SOBEL_X)} a JOIN {_reflect('B', S.SOBEL_Y)} b USING (image, y, x)"))


def _circle_sql(sources: list[tuple[str, str, float]], n: int = 8) -> str:
    """Neighbour columns of each pixel, by SQL."""
    rows = " UNION ALL ".join(f"SELECT p.image, p.y - dy AS y, p.x - dx AS x, k, w * val AS v FROM {src} p, (VALUES " + ", ".join(f"('{name}{k}', {dy}, {dx}, {w!r}::DOUBLE)" for k in range(n) for dy, dx, w in S.circle(k, n, radius)) + ") o(k, dy, dx, w)" for src, name, radius in sources)
    cols = ", ".join(f"sum(v) FILTER (k = '{name}{k}') AS {name}{k}" for _, name, _ in sources for k in range(n))
    return f"(SELECT image, y, x, {cols} FROM ({rows}) GROUP BY image, y, x)"


def _bits(values: list[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN round({v}, 9) >= 0 THEN {1 << k} ELSE 0 END" for k, v in enumerate(values)) + ")"


_RIU2 = lambda c: f"CASE WHEN bit_count(xor({c}, ({c} >> 1) | (({c} & 1) << 7))) <= 2 THEN bit_count({c}) ELSE 9 END"
_LBP = f", N AS {_circle_sql([('B', 'a', 1)])}, K AS (SELECT B.image, B.y, B.x, {_bits([f'a{k} - val' for k in range(8)])} AS code FROM B JOIN N USING (image, y, x), (SELECT max(y) AS hy FROM B) WHERE B.y BETWEEN 1 AND hy - 1 AND B.x BETWEEN 1 AND 62)"
_add("lbp_codes", lambda s, d: S.lbp(T.big_image(s, d)), sql("B", _LBP + " SELECT image, y, x, code FROM K"))
_add("riu2_map", lambda s, d: S.lbp(T.big_image(s, d)).groupBy(uniform_code(F.col("code")).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.countDistinct("code").alias("codes")), sql("B", _LBP + f" SELECT ({_RIU2('code')})::INT AS bin, count(*) AS n, count(DISTINCT code) AS codes FROM K GROUP BY ALL"))


def _mrelbp_sql(margin: int, tail: str) -> str:
    l, s = ([f"{p}{k}" for k in range(8)] for p in "ls")
    ml, ms = ("(" + " + ".join(x) + ") / 8" for x in (l, s))
    inside = f"y BETWEEN {margin} AND hy - {margin} AND x BETWEEN {margin} AND {63 - margin}"
    codes = f"C AS (SELECT D.y, D.x, (round(D.val - m, 9) < 0)::INT AS centre, {_bits([f'{x} - {ml}' for x in l])} AS large, {_bits([f'{x} - {ms}' for x in s])} AS small, {_bits([f'{a} - {b}' for a, b in zip(l, s, strict=True)])} AS radial FROM D JOIN N USING (image, y, x), (SELECT avg(val) AS m FROM D))"
    h = " UNION ALL ".join(["SELECT 0 AS part, centre AS bin FROM C", *(f"SELECT {i + 1}, {2 + 10 * i} + {_RIU2(p)} FROM C" for i, p in enumerate(("large", "small", "radial")))])
    return sql("B", f", M3 AS {_near('B', S.square(3), _MED(3))}, D AS (SELECT M3.* FROM M3, (SELECT max(y) AS hy FROM B) WHERE {inside}), N AS {_circle_sql([('M3', 'l', 2), ('M3', 's', 1)])}, {codes}, HI AS (SELECT part, bin::INT AS bin, count(*) AS c FROM ({h}) GROUP BY ALL), GR AS (SELECT i::INT AS bin, CASE WHEN i < 2 THEN 0 ELSE (i - 2) // 10 + 1 END AS part FROM range(0, 32) t(i)) {tail}")


_add("mrelbp_hist", lambda s, d: S.mrelbp(T.big_image(s, d)), _mrelbp_sql(3, "SELECT 0 AS image, bin, coalesce(c, 0)::DOUBLE AS val FROM GR LEFT JOIN HI USING (part, bin)"))
_add("conv_mrelbp_hist", lambda s, d: _tidy(S.conv_mrelbp(T.big_image(s, d)), "val"), _mrelbp_sql(3, "SELECT 0 AS image, bin, round(coalesce(c, 0) / sum(coalesce(c, 0)) OVER (PARTITION BY part), 6) + 0.0 AS val FROM GR LEFT JOIN HI USING (part, bin)"))
_add("noise_mse_psnr", lambda s, d: _tidy(S.noise(T.images(s, d), 3), "mse", "psnr"), sql("I", f", P AS (SELECT I.image, I.val, m.val AS m FROM I JOIN {_near('I', S.square(3), _MED(3))} m USING (image, y, x)), A AS (SELECT image, avg((val - m)::DOUBLE ** 2) AS mse, max(val) AS top FROM P GROUP BY image) SELECT image, round(mse, 6) + 0.0 AS mse, round(CASE WHEN mse > 0 THEN 20 * log10(top / sqrt(mse)) ELSE 'inf'::DOUBLE END, 6) + 0.0 AS psnr FROM A"))
_add("ssim", lambda s, d: _tidy(S.ssim(T.images(s, d), S.median_filter(T.images(s, d), 3)), "ssim"), sql("I", f", W AS (SELECT a.image, a.y - dy AS y, a.x - dx AS x, a.val::DOUBLE AS p, m.val::DOUBLE AS q FROM I a JOIN {_near('I', S.square(3), _MED(3))} m USING (image, y, x), {_values(S.square(7))}), K AS (SELECT image, y, x, avg(p) AS mp, avg(q) AS mq, sum(p * p) AS pp, sum(q * q) AS qq, sum(p * q) AS pq FROM W GROUP BY ALL HAVING count(*) = 49), J AS (SELECT image, mp, mq, (pp - 49 * mp * mp) / 48 AS vp, (qq - 49 * mq * mq) / 48 AS vq, (pq - 49 * mp * mq) / 48 AS c FROM K) SELECT image, round(avg((2 * mp * mq + 6.5025) * (2 * c + 58.5225) / ((mp * mp + mq * mq + 6.5025) * (vp + vq + 58.5225))), 6) + 0.0 AS ssim FROM J GROUP BY image"))
_add("noise_rollup", lambda s, d: S.noise(T.images(s, d), 3).join(T.grades(s, d).withColumnRenamed("sample", "image"), "image").rollup("grade", "group_id").agg(F.avg("mse").alias("mse"), F.count("*").alias("n")).withColumn("mse", tidy(F.col("mse"), 9)), sql("I G", f", P AS (SELECT I.image, I.val, m.val AS m FROM I JOIN {_near('I', S.square(3), _MED(3))} m USING (image, y, x)), A AS (SELECT image, avg((val - m)::DOUBLE ** 2) AS mse FROM P GROUP BY image) SELECT grade, group_id, round(avg(mse), 9) + 0.0 AS mse, count(*) AS n FROM A JOIN G ON A.image = G.sample GROUP BY ROLLUP (grade, group_id)"))
