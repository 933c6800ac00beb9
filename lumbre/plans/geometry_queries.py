"""Point and voxel operators over tables derived from line items, suppliers and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumbre.functions.numeric import rounded
from lumbre.operators import geometry as V
from lumbre.plans.base import table
from lumbre.plans.registry import query

# Points in space: one per line item, with the supplier as series.
POINT_SQL = """pts AS (SELECT l_suppkey AS series, l_orderkey, l_linenumber, l_partkey, l_returnflag, l_discount, l_quantity AS x, l_extendedprice / 1000.0 AS y, CAST(l_linenumber * 5 AS DOUBLE) AS z FROM lineitem),
ann AS (SELECT DISTINCT series, x, y, z FROM pts WHERE l_returnflag = 'R' AND l_discount >= 0.09 AND series % 10 <> 3),
neg AS (SELECT * FROM pts WHERE l_returnflag = 'N')"""


def _points(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("series"), "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_discount", F.col("l_quantity").alias("x"),
        (F.col("l_extendedprice") / 1000.0).alias("y"), (F.col("l_linenumber") * 5.0).alias("z"),
    )


def _split_points(spark, sf_dir):
    pts = _points(spark, sf_dir)
    ann = pts.filter("l_returnflag = 'R' AND l_discount >= 0.09D AND series % 10 <> 3").select("series", "x", "y", "z")
    return pts.filter("l_returnflag = 'N'"), ann


@query(
    "negatives_far_from_annotations",
    f"""WITH {POINT_SQL} SELECT series, l_orderkey, l_linenumber, l_partkey, x, y, z FROM neg n
WHERE NOT EXISTS (SELECT 1 FROM ann a WHERE a.series = n.series AND (a.x - n.x) * (a.x - n.x) + (a.y - n.y) * (a.y - n.y) + (a.z - n.z) * (a.z - n.z) < 15.0 * 15.0)""",
)
def negatives_far_from_annotations(spark, sf_dir):
    neg, ann = _split_points(spark, sf_dir)
    return V.far_from(neg, ann, ["series"], ["x", "y", "z"], 15.0).select("series", "l_orderkey", "l_linenumber", "l_partkey", "x", "y", "z")


@query(
    "nearest_annotation_distance",
    f"""WITH {POINT_SQL} SELECT n.series, n.l_orderkey, n.l_linenumber, n.l_partkey, round(min(sqrt((a.x - n.x) ** 2 + (a.y - n.y) ** 2 + (a.z - n.z) ** 2)), 6) AS distance
FROM (SELECT DISTINCT series, l_orderkey, l_linenumber, l_partkey, x, y, z FROM neg) n LEFT JOIN ann a ON a.series = n.series GROUP BY n.series, n.l_orderkey, n.l_linenumber, n.l_partkey""",
)
def nearest_annotation_distance(spark, sf_dir):
    neg, ann = _split_points(spark, sf_dir)
    one = neg.dropDuplicates(["series", "l_orderkey", "l_linenumber", "l_partkey"]).select("series", "l_orderkey", "l_linenumber", "l_partkey", "x", "y", "z")
    out = V.nearest_distance(one, ann, ["series"], ["l_orderkey", "l_linenumber", "l_partkey"], ["x", "y", "z"])
    return out.withColumn("distance", rounded(F.col("distance"), 6))


# Voxels: one per (supplier, line number, part cell, order cell) with intensity and two masks.
VOXEL_SQL = """vox AS (SELECT l_suppkey AS id, l_linenumber - 1 AS z, l_partkey % 12 AS y, l_orderkey % 12 AS x, max(l_extendedprice) AS hu,
  max(CASE WHEN l_quantity > 10 THEN 1 ELSE 0 END) AS lung, max(CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END) AS nodule FROM lineitem GROUP BY ALL),
geo AS (SELECT s_suppkey AS id, CAST(1.0 + 0.5 * (s_suppkey % 3) AS DOUBLE) AS sz, CAST(0.5 + 0.25 * (s_suppkey % 4) AS DOUBLE) AS sy, 0.75::DOUBLE AS sx, 7 AS dz, 12 AS dy, 12 AS dx FROM supplier)"""


def _voxels(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").alias("id"), (F.col("l_linenumber") - 1).alias("z"), (F.col("l_partkey") % 12).alias("y"), (F.col("l_orderkey") % 12).alias("x")
    ).agg(
        F.max("l_extendedprice").alias("hu"), F.max((F.col("l_quantity") > 10).cast("int")).alias("lung"), F.max((F.col("l_quantity") > 45).cast("int")).alias("nodule")
    )


def _volume_geometry(spark, sf_dir):
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        s.alias("id"), (1.0 + 0.5 * (s % 3)).alias("sz"), (0.5 + 0.25 * (s % 4)).alias("sy"), F.lit(0.75).alias("sx"), F.lit(7).alias("dz"), F.lit(12).alias("dy"), F.lit(12).alias("dx")
    )


@query(
    "intensity_stats",
    f"""WITH {VOXEL_SQL} SELECT id, count(hu) AS n, min(hu) AS min, {", ".join(f"round(quantile_cont(hu, {p}), 6) AS {n}" for p, n in
        ((0.01, 'p01'), (0.05, 'p05'), (0.25, 'p25'), (0.5, 'p50'), (0.75, 'p75'), (0.95, 'p95'), (0.99, 'p99')))}, max(hu) AS max, round(avg(hu), 6) AS mean, round(stddev_pop(hu), 6) AS sd
FROM vox WHERE lung = 1 GROUP BY id""",
)
def intensity_stats(spark, sf_dir):
    out = V.intensity_stats(_voxels(spark, sf_dir).filter("lung = 1"), ["id"], "hu")
    return out.select("id", "n", "min", "max", *[rounded(F.col(c), 6).alias(c) for c in ("p01", "p05", "p25", "p50", "p75", "p95", "p99", "mean", "sd")])


@query(
    "mask_geometry",
    f"""WITH {VOXEL_SQL}, v AS (SELECT vox.*, sz, sy, sx, dz, dy, dx FROM vox JOIN geo ON vox.id = geo.id),
g AS (SELECT id, count(CASE WHEN nodule = 1 THEN 1 END) AS n, count(CASE WHEN nodule = 1 AND lung = 1 THEN 1 END) AS o, max(sz) * max(sy) * max(sx) AS vv,
  {", ".join(f"min(CASE WHEN nodule = 1 THEN {a} END) AS min_{a}, max(CASE WHEN nodule = 1 THEN {a} END) AS max_{a}, avg(CASE WHEN nodule = 1 THEN {a} END) AS m_{a}, max(d{a}) AS d{a}" for a in "zyx")} FROM v GROUP BY id)
SELECT id, n AS n_voxels, CAST(0 AS BIGINT) AS n_not_binary, round(n * vv, 6) AS volume, round(CASE WHEN n > 0 THEN power(6 * n * vv / pi(), 1.0 / 3) END, 6) AS diameter,
  min_z, min_y, min_x, max_z, max_y, max_x, {", ".join(f"CAST(coalesce(round_even(m_{a}, 0), d{a} // 2) AS BIGINT) AS centre_{a}" for a in "zyx")},
  round(CASE WHEN n > 0 THEN CAST(o AS DOUBLE) / n END, 9) AS overlap,
  CASE WHEN min_z = 0 OR min_y = 0 OR min_x = 0 OR max_z = dz - 1 OR max_y = dy - 1 OR max_x = dx - 1 THEN 1 ELSE 0 END AS touches_border FROM g""",
)
def mask_geometry(spark, sf_dir):
    v = _voxels(spark, sf_dir).join(_volume_geometry(spark, sf_dir), "id")
    out = V.mask_geometry(v, ["id"], ["z", "y", "x"], "nodule", "lung", ["sz", "sy", "sx"], ["dz", "dy", "dx"])
    digits = {"volume": 6, "diameter": 6, "overlap": 9}
    return out.withColumns({c: rounded(F.col(c), d) for c, d in digits.items()})


@query(
    "mask_quality_checks",
    f"""WITH {VOXEL_SQL}, g AS (SELECT id, count(CASE WHEN nodule = 1 THEN 1 END) AS n, count(CASE WHEN nodule = 1 AND lung = 1 THEN 1 END) AS o, avg(CASE WHEN nodule = 1 THEN hu END) AS m FROM vox GROUP BY id)
SELECT id, 'binary' AS "check", 'PASS' AS status, 0.0::DOUBLE AS value FROM g
UNION ALL SELECT id, 'overlap', CASE WHEN n = 0 THEN 'SKIP' WHEN o >= 0.95 * n THEN 'PASS' ELSE 'FAIL' END, round(CAST(o AS DOUBLE) / nullif(n, 0), 9) FROM g
UNION ALL SELECT id, 'mean_inside', CASE WHEN m IS NULL THEN 'SKIP' WHEN m > 60000 THEN 'WARN' ELSE 'INFO' END, round(m, 6) FROM g""",
)
def mask_quality_checks(spark, sf_dir):
    on = F.col("nodule") == 1
    g = _voxels(spark, sf_dir).groupBy("id").agg(
        F.count_if(on).alias("n"), F.count_if(on & (F.col("lung") == 1)).alias("o"), F.avg(F.when(on, F.col("hu"))).alias("m"), F.count_if(~F.col("nodule").isin(0, 1)).alias("bad")
    )

    def check(name, status, value):
        return F.struct(F.lit(name).alias("check"), status.alias("status"), value.cast("double").alias("value"))

    rows = F.array(
        check("binary", F.when(F.col("bad") == 0, "PASS").otherwise("FAIL"), F.col("bad")),
        check("overlap", F.when(F.col("n") == 0, "SKIP").when(F.col("o") >= 0.95 * F.col("n"), "PASS").otherwise("FAIL"), rounded(F.col("o") / F.nullif(F.col("n"), F.lit(0)))),
        check("mean_inside", F.when(F.col("m").isNull(), "SKIP").when(F.col("m") > 60000, "WARN").otherwise("INFO"), rounded(F.col("m"), 6)),
    )
    return g.select("id", F.inline(rows))


@query(
    "mask_weight_share",
    f"""WITH {VOXEL_SQL} SELECT id, z, round(sum(CASE WHEN nodule = 1 THEN hu ELSE 0 END) / sum(hu), 9) AS share FROM vox GROUP BY id, z""",
)
def mask_weight_share(spark, sf_dir):
    return V.weight_share(_voxels(spark, sf_dir), ["id", "z"], "hu", "nodule").withColumn("share", rounded(F.col("share")))


@query(
    "depth_to_boundary",
    f"""WITH {VOXEL_SQL}, v AS (SELECT vox.*, z * sz AS pz, y * sy AS py, x * sx AS px FROM vox JOIN geo ON vox.id = geo.id)
SELECT n.id, n.z, n.y, n.x, round(min(sqrt((n.pz - o.pz) ** 2 + (n.py - o.py) ** 2 + (n.px - o.px) ** 2)), 6) AS depth
FROM (SELECT * FROM v WHERE nodule = 1) n LEFT JOIN (SELECT * FROM v WHERE lung = 0) o ON o.id = n.id GROUP BY n.id, n.z, n.y, n.x""",
)
def depth_to_boundary(spark, sf_dir):
    v = _voxels(spark, sf_dir).join(_volume_geometry(spark, sf_dir), "id")
    v = v.withColumns({"pz": F.col("z") * F.col("sz"), "py": F.col("y") * F.col("sy"), "px": F.col("x") * F.col("sx")})
    # The grid of line items has holes, so every outside voxel stays a candidate here.
    out = V.nearest_distance(v.filter("nodule = 1"), v.filter("lung = 0"), ["id"], ["z", "y", "x"], ["pz", "py", "px"], "depth")
    return out.withColumn("depth", rounded(F.col("depth"), 6))


@query(
    "boundary_voxels",
    f"""WITH {VOXEL_SQL} SELECT o.id, o.z, o.y, o.x FROM vox o WHERE lung = 0 AND EXISTS (SELECT 1 FROM vox i WHERE i.id = o.id AND i.lung = 1
  AND abs(i.z - o.z) + abs(i.y - o.y) + abs(i.x - o.x) = 1)""",
)
def boundary_voxels(spark, sf_dir):
    v = _voxels(spark, sf_dir)
    return V.boundary_voxels(v.filter("lung = 1"), v.filter("lung = 0"), ["id"], ["z", "y", "x"]).select("id", "z", "y", "x")


def _e(i: int) -> str:
    return f"CAST(embedding[{i + 1}] AS DOUBLE)"


_D = [f"d{i}" for i in range(9)]
_MAP_SQL = f"""m AS (SELECT vec_id AS series, {", ".join(f"{_e(i)} AS d{i}" for i in range(9))}, {", ".join(f"{_e(9 + i)} AS o{i}" for i in range(3))},
  {", ".join(f"abs({_e(12 + i)}) + 0.5 AS s{i}" for i in range(3))} FROM embeddings),
det AS (SELECT *, d0 * (d4 * d8 - d5 * d7) - d1 * (d3 * d8 - d5 * d6) + d2 * (d3 * d7 - d4 * d6) AS det FROM m),
p AS (SELECT event_id, user_id AS series, value / 100.0 AS px, event_id % 7 / 10.0 AS py, event_id % 11 / 10.0 AS pz FROM events),
j AS (SELECT p.*, det.*, px - o0 AS x, py - o1 AS y, pz - o2 AS z FROM p JOIN det ON p.series = det.series),
v AS (SELECT event_id, ((d4 * d8 - d5 * d7) * x - (d1 * d8 - d2 * d7) * y + (d1 * d5 - d2 * d4) * z) / det / s0 AS voxel_x,
  (-(d3 * d8 - d5 * d6) * x + (d0 * d8 - d2 * d6) * y - (d0 * d5 - d2 * d3) * z) / det / s1 AS voxel_y,
  ((d3 * d7 - d4 * d6) * x - (d0 * d7 - d1 * d6) * y + (d0 * d4 - d1 * d3) * z) / det / s2 AS voxel_z FROM j)"""


@query(
    "world_to_voxel",
    f"""WITH {_MAP_SQL} SELECT event_id, round(voxel_x, 4) AS voxel_x, round(voxel_y, 4) AS voxel_y, round(voxel_z, 4) AS voxel_z,
  CASE WHEN voxel_x >= 0 AND voxel_x < 20 AND voxel_y >= 0 AND voxel_y < 20 AND voxel_z >= 0 AND voxel_z < 20 THEN 1 ELSE 0 END AS inside FROM v""",
)
def world_to_voxel(spark, sf_dir):
    e = F.transform("embedding", lambda x: x.cast("double"))
    geometry = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("series"), F.slice(e, 1, 9).alias("direction"), F.slice(e, 10, 3).alias("origin"),
        F.transform(F.slice(e, 13, 3), lambda x: F.abs(x) + 0.5).alias("spacing"), F.array(F.lit(20), F.lit(20), F.lit(20)).alias("dim"),
    )
    points = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("series"), (F.col("value") / 100.0).alias("px"), (F.col("event_id") % 7 / 10.0).alias("py"), (F.col("event_id") % 11 / 10.0).alias("pz")
    )
    out = V.world_to_voxel(points, geometry, "series", ["px", "py", "pz"])
    return out.select("event_id", *[rounded(F.col(f"voxel_{a}"), 4).alias(f"voxel_{a}") for a in "xyz"], "inside")


@query(
    "neighbour_slices",
    f"""WITH {VOXEL_SQL}, c AS (SELECT id, CAST(coalesce(round_even(avg(CASE WHEN nodule = 1 THEN z END), 0), 3) AS BIGINT) AS centre FROM vox GROUP BY id)
SELECT id, CAST(o AS INT) AS "offset", CAST(least(greatest(centre + o, 0), 6) AS BIGINT) AS position FROM c, (SELECT unnest(range(-2, 3)) AS o)""",
)
def neighbour_slices(spark, sf_dir):
    centres = _voxels(spark, sf_dir).groupBy("id").agg(
        F.coalesce(F.bround(F.avg(F.when(F.col("nodule") == 1, F.col("z"))), 0).cast("bigint"), F.lit(3)).alias("centre"), F.lit(7).cast("bigint").alias("size")
    )
    return V.neighbour_rows(centres, ["id"], "centre", "size", 5)


@query(
    "representative_slices",
    f"""WITH {VOXEL_SQL}, s AS (SELECT id, z, sum(CASE WHEN id % 9 = 4 THEN 0 ELSE nodule END) AS area, max(hu) AS score FROM vox GROUP BY id, z), t AS (SELECT *, max(area) OVER (PARTITION BY id) AS top FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN top > 0 THEN area ELSE score END DESC, z) AS place FROM t)
SELECT id, z, CAST(area AS BIGINT) AS area, CAST(row_number() OVER (PARTITION BY id ORDER BY z) AS INT) AS slice_order FROM k WHERE place <= 4""",
)
def representative_slices(spark, sf_dir):
    nodule = F.when(F.col("id") % 9 == 4, 0).otherwise(F.col("nodule")).cast("bigint")
    slices = _voxels(spark, sf_dir).groupBy("id", "z").agg(F.sum(nodule).alias("area"), F.max("hu").alias("score"))
    return V.representative_slices(slices, ["id"], "z", "area", "score", 4).select("id", "z", "area", "slice_order")
