import numpy as np
import pytest
from pyspark.sql import functions as F

from limnoscope.functions import geometry
from limnoscope.operators import sizing, spatial

# A ring with a notch, so that some rows have two spans.
RING = [(3.0, 5.0), (190.0, 12.0), (100.0, 90.0), (195.0, 180.0), (20.0, 170.0), (60.0, 95.0), (3.0, 5.0)]


def inside(x, y, ring=RING):
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            hit = not hit
    return hit


def area(spark, ring=RING):
    points = [{"x": x, "y": y} for x, y in ring]
    return spark.createDataFrame([(1, "R", points)], "reservoir_id int, name string, ring array<struct<x:double,y:double>>")


@pytest.fixture(scope="module")
def grid(spark):
    return spark.range(40 * 40).select(
        F.col("id").alias("pixel_id"), F.lit(1).alias("reservoir_id"),
        (F.col("id") % 40 * 5.0).alias("x"), (F.floor(F.col("id") / 40) * 5.0).alias("y"),
    )


@pytest.mark.parametrize("max_rows", [sizing.BROADCAST_ROWS, 0])
def test_clip_equals_brute_force(spark, grid, max_rows):
    got = {(r.x, r.y) for r in spatial.clip_to_aoi(grid, area(spark), size=5.0, max_rows=max_rows).collect()}
    want = {(5.0 * i, 5.0 * j) for i in range(40) for j in range(40) if inside(5.0 * i, 5.0 * j)}
    assert got == want and 300 < len(want) < 1400


def test_random_points(spark):
    rng = np.random.default_rng(3)
    rows = [(1, float(x), float(y)) for x, y in rng.uniform(-10, 210, (500, 2))]
    points = spark.createDataFrame(rows, "reservoir_id int, x double, y double")
    got = {(r.x, r.y) for r in spatial.clip_points(points, area(spark)).collect()}
    assert got == {(x, y) for _, x, y in rows if inside(x, y)}


@pytest.mark.parametrize("max_rows", [sizing.BROADCAST_ROWS, 0])
def test_near_points(spark, grid, max_rows):
    points = [("a", 12.0, 13.0), ("b", 100.0, 100.0), ("c", 101.0, 99.0), ("far", 900.0, 900.0)]
    poi = spark.createDataFrame([(1, *p) for p in points], "reservoir_id int, point string, x double, y double")
    got = spatial.pixels_near_points(grid, poi, 30.0, max_rows=max_rows).groupBy("point").count().collect()
    cells = [(5.0 * i, 5.0 * j) for i in range(40) for j in range(40)]
    want = {n: sum((x - px) ** 2 + (y - py) ** 2 <= 900 for x, y in cells) for n, px, py in points}
    assert {r["point"]: r["count"] for r in got} == {k: v for k, v in want.items() if v}


def test_near_points_in_degrees(spark):
    metre = 1 / 111195.0
    pixels = spark.range(41 * 41).select(
        F.col("id").alias("pixel_id"), F.lit(1).alias("reservoir_id"),
        (-1.8 + (F.col("id") % 41 - 20) * 5 * metre / np.cos(np.radians(41.8))).alias("x"),
        (41.8 + (F.floor(F.col("id") / 41) - 20) * 5 * metre).alias("y"),
    )
    poi = spark.createDataFrame([(1, "p", -1.8, 41.8)], "reservoir_id int, point string, x double, y double")
    got = spatial.pixels_near_points(pixels, poi, 30.5, geographic=True).count()
    want = sum((5 * i) ** 2 + (5 * j) ** 2 <= 30.5**2 for i in range(-20, 21) for j in range(-20, 21))
    assert got == want


def test_bounds_and_centroid(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    assert tuple(spatial.mean_centroid(area(spark, square)).first()) == (2.0, 1.0)
    assert tuple(spatial.total_bounds(area(spark)).first()) == (3.0, 5.0, 195.0, 180.0)


def test_salted_join_equals_plain_join(spark):
    big = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 9).alias("k"))
    small = spark.createDataFrame([(i, i * 10) for i in range(5)], "k int, v int")
    for how in ("inner", "left"):
        a = sizing.salted_join(big, small, ["k"], ["id"], how=how)
        b = big.join(small, "k", how)
        assert sorted(map(tuple, a.select("id", "v").collect()), key=str) == sorted(map(tuple, b.select("id", "v").collect()), key=str)


def test_spread_rank_equals_row_number(spark):
    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") < 2500, "hot").otherwise("cold").alias("g"), (F.col("id") * 7919 % 3000).alias("v"))
    got = sizing.spread_row_number(rows, ["g"], F.floor(F.col("v") / 100), ["v", "id"], "rn", "n")
    plain = rows.selectExpr("id", "row_number() over (partition by g order by v, id) rn2", "count(*) over (partition by g) n2")
    assert got.join(plain, "id").where("rn <> rn2 or n <> n2").count() == 0 and got.count() == 3000


def clipped_area(ring, x, y, half):
    """Area of a ring cut by one side of the square after the other."""
    for axis, limit, keep in ((0, x - half, 1), (0, x + half, -1), (1, y - half, 1), (1, y + half, -1)):
        out = []
        for p, q in zip(ring, ring[1:] + ring[:1]):
            a, b = keep * (p[axis] - limit), keep * (q[axis] - limit)
            if a >= 0:
                out.append(p)
            if a * b < 0:
                out.append(tuple(u + (v - u) * a / (a - b) for u, v in zip(p, q)))
        ring = out
        if not ring:
            return 0.0
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1]))) / 2


CONCAVE = [(11.0, 7.0), (93.0, 18.0), (60.0, 40.0), (97.0, 88.0), (52.0, 61.0), (14.0, 95.0), (33.0, 47.0), (11.0, 7.0)]
SQUARE = [(110.0, 10.0), (150.0, 10.0), (150.0, 30.0), (110.0, 30.0), (110.0, 10.0)]


def rings(spark, *shapes):
    rows = [(1, [{"x": x, "y": y} for x, y in shape]) for shape in shapes]
    return spark.createDataFrame(rows, "reservoir_id int, ring array<struct<x: double, y: double>>")


@pytest.mark.parametrize("shift", [0.0, 3.5])
def test_shares_equal_clipping_side_by_side(spark, shift):
    """On the grid and beside it, for concave rings of either turn and several rings of one reservoir."""
    places = [(k, 1, 20.0 * (k % 9) + shift, 20.0 * (k // 9) + shift) for k in range(54)]
    pixels = spark.createDataFrame(places, "pixel_id long, reservoir_id int, x double, y double")
    for shapes in ([CONCAVE], [CONCAVE[::-1]], [CONCAVE, SQUARE]):
        got = {r.pixel_id: r.weight for r in spatial.weigh_by_aoi(pixels, rings(spark, *shapes)).collect()}
        want = {k: sum(clipped_area(s[:-1], x, y, 10.0) for s in shapes) / 400 for k, _, x, y in places}
        assert got == pytest.approx({k: w for k, w in want.items() if w > 1e-9})


def test_weights_without_areas_or_reservoirs(spark):
    pixels = spark.createDataFrame([(1, 1, 20.0, 20.0), (2, None, 20.0, 20.0), (3, 1, None, 20.0)], "pixel_id long, reservoir_id int, x double, y double")
    assert spatial.weigh_by_aoi(pixels, rings(spark)).count() == 0
    assert spatial.weigh_by_aoi(pixels, rings(spark, [(0.0, 0.0), (40.0, 0.0), (40.0, 40.0), (0.0, 0.0)])).count() == 1


def test_rings_meet(spark):
    box = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]
    cases = [
        (box(0, 0, 10), box(5, 5, 10), True), (box(0, 0, 10), box(2, 2, 3), True), (box(2, 2, 3), box(0, 0, 10), True),
        (box(0, 0, 10), box(10, 10, 5), True), (box(0, 0, 10), box(10.5, 0, 5), False),
        # Boxes overlap, the polygons do not.
        ([(0.0, 0.0), (10.0, 0.0), (0.0, 10.0), (0.0, 0.0)], box(8, 8, 4), False),
        ([(0.0, 0.0), (10.0, 0.0), (0.0, 10.0), (0.0, 0.0)], [(8.0, -5.0), (9.0, -5.0), (9.0, 20.0), (8.0, -5.0)], True),
    ]
    as_ring = lambda s: [{"x": float(x), "y": float(y)} for x, y in s]
    rows = spark.createDataFrame([(as_ring(a), as_ring(b), w) for a, b, w in cases], "a array<struct<x: double, y: double>>, b array<struct<x: double, y: double>>, w boolean")
    for r in rows.select(geometry.rings_meet(F.col("a"), F.col("b")).alias("got"), geometry.rings_meet(F.col("b"), F.col("a")).alias("turned"), "w").collect():
        assert r.got == r.turned == r.w


def test_regrid(spark):
    from limnoscope.operators import regrid

    rows = [(1, "2024-01-01", 0, 20.0 * (k % 4), 20.0 * (k // 4), 400.0, float(k) if k else None, 4 + k % 2) for k in range(16)]
    pixels = spark.createDataFrame(rows, "reservoir_id int, scene_date string, tile int, x double, y double, area_m2 double, v double, scl int")
    got = {(r.x, r.y): r for r in regrid.regrid(pixels, ["v"], 40, ["scl"]).collect()}
    assert set(got) == {(10.0, 10.0), (50.0, 10.0), (10.0, 50.0), (50.0, 50.0)}
    corner = got[(10.0, 10.0)]  # pixels 0, 1, 4, 5: one without a value; a tie of two classes goes to the smaller
    assert (corner.v, corner.scl, corner.n_pixels, corner.area_m2) == (pytest.approx(10 / 3), 4, 4, 1600.0)
    fine = regrid.regrid(pixels, ["v"], 10, ["scl"])
    assert fine.count() == 64 and fine.where("x = -5 and y = -5").first().scl == 4 and fine.agg(F.sum("area_m2")).first()[0] == 6400.0
    assert regrid.regrid(pixels, ["v"], 20, ["scl"]).select("x", "y", "v").exceptAll(pixels.select("x", "y", "v")).count() == 0
    with pytest.raises(ValueError):
        regrid.regrid(pixels, ["v"], 0)


def test_weighted_means_by_hand(spark):
    from limnoscope.operators import reduction

    rows = [(1, 6, 1.0, 0.5), (1, 6, 4.0, 1.0), (1, 6, None, 1.0), (1, 4, 9.0, 1.0), (1, 8, 9.0, 0.5)]
    pixels = spark.createDataFrame(
        [(r, "2024-01-01", 0, "2024-01-01 10:00:00", 5.0, 400.0, v, s, 50, w, v) for r, s, v, w in rows],
        "reservoir_id int, scene_date string, tile int, scene_ts string, cloud_meta double, area_m2 double, b4 double, scl int, cldprb int, weight double, seen double",
    ).withColumn("scene_date", F.col("scene_date").cast("date")).withColumn("scene_ts", F.col("scene_ts").cast("timestamp"))
    (row,) = reduction.scene_summary(pixels, ["seen"], {"seen": [0.0, 2.0, 10.0]}, weight="weight").collect()
    assert row.seen == pytest.approx((0.5 * 1 + 4) / 1.5)
    assert row.coverage_count_pct == pytest.approx(100 * 3.0 / 4.0)
    # Clouds: of 3 valid pixels' weight plus half a cloudy one; all are probable clouds.
    assert row.cloud_pct == pytest.approx(100 * (0.95 * 0.5 / 3.0 + 0.05))
    assert row._areas_0 == pytest.approx([200.0, 400.0]) and row._areas_0_total == pytest.approx(600.0)
