"""Hand-worked cases of scalar functions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tripweave import constants as K
from tripweave.functions import costs, dates, geo, numeric, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("raw,want", [("Bukit \nPanjang", "Bukit Panjang"), ("  a   b ", "a b"), ("\tx\n", "x")])
def test_clean_name(spark, raw, want):
    assert one(spark, text.clean_name(F.col("s")), s=raw) == want


def test_clean_name_null(spark):
    assert spark.sql("select cast(null as string) s").select(text.clean_name(F.col("s"))).first()[0] == ""


@pytest.mark.parametrize("raw,want", [("1,563", 1563.0), ("-", 0.0), ("1 200.5", 1200.5), ("abc", None), ("1d", None), ("NaN", None), ("-3", -3.0)])
def test_parse_number(spark, raw, want):
    assert one(spark, text.parse_number(F.col("s"), dash_is_zero=True), s=raw) == want


@pytest.mark.parametrize("raw,want", [("1.5,103.25", (1.5, 103.25)), ("(1.5, -3)", (1.5, -3.0)), ("x,2", (None, 2.0)), ("1.5", (1.5, None))])
def test_parse_latlon(spark, raw, want):
    assert tuple(one(spark, text.parse_latlon(F.col("s")), s=raw)) == want


def brute_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) for _ in range(2))
        assert text._common_subsequence(a, b) == brute_lcs(a, b)


@pytest.mark.parametrize("a,b,want", [("Great World City", "great world", 100.0), ("", "x", 0.0), ("park", "park", 100.0), ("abc", "xyz", 0.0)])
def test_token_set_score(a, b, want):
    assert text.token_set_score(a, b) == want


def test_token_set_score_partial():
    # shared "mall", different rest: best of the three pairings
    score = text.token_set_score("mall north", "mall south")
    assert score == pytest.approx(100 * max(1 - (5 + 5 - 2 * 3) / 20, 1 - 6 / 14))


def plain_common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_letters_against_the_plain_table():
    """Empty, one word of 64 letters, longer, wide alphabets and letters beyond 16 bits."""
    import random

    rng = random.Random(3)
    sizes = [0, 1, 5, 20, 63, 64, 65, 130, 300]
    pairs = [
        ("".join(rng.choices(alphabet, k=n)), "".join(rng.choices(alphabet, k=m)))
        for alphabet in ("ab", "abcdefgh ", "\0é中\U0001F600z") for n in sizes for m in sizes
    ]
    want = [plain_common(a, b) for a, b in pairs]
    assert text.common_letters(*zip(*pairs)).tolist() == want
    assert text.common_letters([], []).tolist() == []


def test_token_set_ratio_of_a_table(spark):
    """The column equals the plain score; a threshold only lowers scores that stay below it."""
    import random

    rng = random.Random(4)
    words = ["mall", "Park", "north", "South", "city", "centre", "x" * 70, "é", ""]
    pairs = [(" ".join(rng.choices(words, k=rng.randint(0, 4))), " ".join(rng.choices(words, k=rng.randint(0, 4)))) for _ in range(150)] + [(None, "park"), (None, None)]
    df = spark.createDataFrame(pairs, "a string, b string")
    out = df.select("a", "b", text.token_set_ratio(F.col("a"), F.col("b")).alias("s"), text.token_set_ratio(F.col("a"), F.col("b"), 80.0).alias("t")).collect()
    assert len(out) == len(pairs)
    for r in out:
        want = text.token_set_score(r.a, r.b)
        assert r.s == pytest.approx(want) and (r.t == pytest.approx(want) if want >= 80 else r.t < 80)


def test_padded_id_keeps_long_numbers(spark):
    assert one(spark, text.padded_id("P", F.col("n")), n=12) == "P_0000012"
    assert one(spark, text.padded_id("P", F.col("n")), n=123456789) == "P_123456789"


def test_dates(spark):
    assert str(one(spark, dates.iso_date(F.col("s")), s="2023-05-06T01:02:03")) == "2023-05-06"
    assert one(spark, dates.iso_date(F.col("s")), s="2023-13-06") is None
    assert one(spark, dates.iso_date(F.col("s")), s="06/05/2023") is None
    assert one(spark, dates.age_days(F.to_date(F.col("s")), "2024-01-02"), s="2024-01-01") == 1
    assert one(spark, dates.age_days(F.to_date(F.col("s")), "2024-01-02"), s="2024-01-03") is None
    assert one(spark, dates.decay_weight(F.col("n")), n=365) == pytest.approx(0.5)
    assert one(spark, dates.view_weight(F.col("b")), b=True) == 1.0
    assert one(spark, dates.view_weight(F.col("b")), b="false") == 0.75


def test_interpolation(spark):
    xp, fp = [0, 10, 20], [0, 5, 3]
    f = lambda x, **k: one(spark, numeric.piecewise_interpolate(F.col("x"), xp, fp, **k), x=x)
    assert [f(v) for v in (-1.0, 0.0, 5.0, 10.0, 15.0, 20.0, 99.0)] == [0, 0, 2.5, 5, 4, 3, 3]
    assert f(15.0, monotone=True) == 5
    assert f(-1.0, clip=False) is None
    with pytest.raises(ValueError):
        numeric.piecewise_interpolate(F.col("x"), [0, 0], [1, 2])


def test_buckets(spark):
    f = lambda x: one(spark, numeric.bucket_value(F.col("x"), K.VEHICLE_EDGES, K.VEHICLE_VALUES), x=x)
    assert [f(v) for v in (-5.0, 0.0, 19.9, 20.0, 80.0, 100.0)] == [276.9, 276.9, 276.9, 381.2, 1243.2, 1243.2]


def test_pivot_level(spark):
    assert one(spark, numeric.pivot_level(F.col("b"), F.col("l"), {0: -4, 1: 0}), b=10.005, l=0) == pytest.approx(6.0, abs=0.011)
    assert one(spark, numeric.pivot_level(F.col("b"), F.col("l"), {0: -4}), b=10.0, l=9) == 10.0


def test_flag_range(spark):
    limits = [F.lit(float(v)) for v in K.AREA_LIMITS["park"]]
    r = one(spark, numeric.flag_range(F.col("x"), limits, [F.lit(600.0), F.lit(1e9)]), x=400.0)
    assert (r["flags"], r["max_severity"], r["flag_count"]) == ("below minimum | low outlier", 3, 2)
    assert one(spark, numeric.flag_range(F.col("x"), limits), x=3000.0)["flag_count"] == 0


@pytest.mark.parametrize("fare,want", [(None, (0.0, "NULL")), ("Info Unavailable", (0.0, "INFO_UNAVAILABLE")), ("1.66", (1.66, "OK")), ("free", (0.0, "PARSE_ERROR_free"))])
def test_fares(spark, fare, want):
    df = spark.createDataFrame([(fare,)], "f string")
    assert tuple(df.select(costs.fare_amount(F.col("f")).alias("v")).first()["v"]) == want


def test_road_charge(spark):
    got = {(o, d): one(spark, costs.road_charge(F.col("o"), F.col("d")), o=o, d=d) for o in range(3) for d in range(3)}
    assert got == {**{(o, d): 0.0 for o in range(3) for d in range(3)}, **K.ROAD_CHARGE}
    assert [one(spark, costs.parking_fee(F.col("d")), d=d) for d in range(3)] == [1.5, 4.0, 6.0]


def test_bearing(spark):
    f = lambda *p: one(spark, geo.bearing(*[F.lit(v) for v in p]))
    assert f(1.0, 103.0, 2.0, 103.0) == pytest.approx(0.0)
    assert f(0.0, 103.0, 0.0, 104.0) == pytest.approx(90.0)
    assert f(1.0, 103.0, 0.0, 103.0) == pytest.approx(180.0)


def test_angle_gap(spark):
    assert one(spark, geo.angle_gap(F.col("a"), F.col("b")), a=350.0, b=20.0) == 30.0
    assert one(spark, geo.angle_gap(F.col("a"), F.col("b")), a=-1.0, b=20.0) == 0.0


def test_projection_round_trip(spark):
    # the grid's origin maps to its false coordinates
    m = one(spark, geo.to_metric(F.col("a"), F.col("b")), a=geo.ORIGIN_LAT, b=geo.ORIGIN_LON)
    assert m["x_m"] == pytest.approx(geo.FALSE_EASTING, abs=1e-6) and m["y_m"] == pytest.approx(geo.FALSE_NORTHING, abs=1e-6)
    rng = random.Random(3)
    pts = spark.createDataFrame([(1.2 + rng.random() * 0.3, 103.6 + rng.random() * 0.45) for _ in range(200)], "lat double, lon double")
    back = pts.withColumn("m", geo.to_metric(F.col("lat"), F.col("lon"))).withColumn("w", geo.to_wgs84(F.col("m.x_m"), F.col("m.y_m")))
    again = back.withColumn("n", geo.to_metric(F.col("w.lat"), F.col("w.lon")))
    worst = again.agg(F.max(F.hypot(F.col("m.x_m") - F.col("n.x_m"), F.col("m.y_m") - F.col("n.y_m")))).first()[0]
    assert worst < 1e-3


RINGS = "array<array<struct<x: double, y: double>>>"


def shape(spark, *rings):
    return spark.createDataFrame([([[(float(x), float(y)) for x, y in r] for r in rings],)], f"rings {RINGS}")


def test_l_shape(spark):
    df = shape(spark, [(0, 0), (4, 0), (4, 1), (1, 1), (1, 3), (0, 3), (0, 0)])
    r = df.select(
        geo.polygon_area(F.col("rings")).alias("a"), geo.contains(F.col("rings"), F.lit(0.5), F.lit(2.5)).alias("i"),
        geo.contains(F.col("rings"), F.lit(2.0), F.lit(2.0)).alias("o"), geo.contains(F.col("rings"), F.lit(0.0), F.lit(1.0)).alias("e"),
        geo.polygon_distance(F.col("rings"), F.lit(2.0), F.lit(3.0)).alias("d"), geo.interior_point(F.col("rings")).alias("p"),
    ).first()
    assert (r["a"], r["i"], r["o"], r["e"], r["d"]) == (6.0, True, False, False, 1.0)
    assert 0 < r["p"]["x"] < 1 and r["p"]["y"] == 1.5


def test_hole_and_orientation(spark):
    outer, hole = [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]
    df = shape(spark, outer, hole)
    turned = df.select(geo.orient(F.slice("rings", 1, 1), F.slice("rings", 2, 1)).alias("rings"))
    r = turned.select(geo.polygon_area(F.col("rings")).alias("a"), geo.contains(F.col("rings"), F.lit(1.5), F.lit(1.5)).alias("h"),
                      geo.polygon_centroid(F.col("rings")).alias("c")).first()
    assert r["a"] == 15.0 and r["h"] is False
    assert r["c"]["x"] == pytest.approx((16 * 2 - 1.5) / 15)


def test_disc_area(spark):
    df = spark.range(1).select(F.array(geo.regular_ring(F.lit(0.0), F.lit(0.0), 1.0, 64)).alias("rings"))
    assert df.select(geo.polygon_area(F.col("rings"))).first()[0] == pytest.approx(64 / 2 * math.sin(2 * math.pi / 64))
