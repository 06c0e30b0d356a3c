"""Readers, writers, streams and plans on small files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tripweave.functions import geo
from tripweave.plans import origins, skims
from tripweave.sources import geo_json, routes, sinks, text_tables
from tripweave.streaming import incremental


def transit(duration=600, fare="1.66", legs=(1000, 500)):
    trip = {"duration": duration, "transitTime": 300, "walkTime": 120, "waitingTime": None, "transfers": 1, "fare": fare, "legs": [{"distance": v} for v in legs]}
    return {"plan": {"itineraries": [trip, {"duration": 1}]}}


FILES = {
    "O_1/O_1_Area__to__1_ML_0001_PT.json": json.dumps(transit()),
    "O_1/O_1_Area__to__1_ML_0002_PT.json": json.dumps({"plan": {"itineraries": []}}),
    "O_1/ERROR_O_1_Area__to__1_ML_0003.json": json.dumps({"status": 404}),
    "O_2/O_2_Area__to__1_ML_0004_PT.json": json.dumps(transit(fare=None)),
    "O_2/O_2_Area__to__1_ML_0005_PT.json": json.dumps(transit(fare="info unavailable")),
    "O_2/O_2_Area__to__1_ML_0006_PT.json": '{"plan": {"itin',
    "O_2/readme.json": "{}",
}


def write(folder, files):
    for name, body in files.items():
        os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
        with open(f"{folder}/{name}", "w") as f:
            f.write(body)


def test_transit_files(spark, tmp_path):
    write(tmp_path, FILES)
    out = {r["dest_id"]: r for r in routes.parse_transit(routes.read_documents(spark, str(tmp_path))).collect()}
    assert len(out) == 6
    ok = out["1_ML_0001"]
    assert (ok["origin_id"], ok["total_time_min"], ok["wait_time_min"], ok["distance_km"], ok["pt_fare_proxy"], ok["error_code"]) == ("O_1", 10.0, 0.0, 1.5, 1.66, "OK")
    assert {k: v["error_code"] for k, v in out.items() if v["error_code"] != "OK"} == {"1_ML_0002": "NO_ITINERARY", "1_ML_0003": "HTTP_404", "1_ML_0006": "BAD_JSON"}
    assert (out["1_ML_0004"]["fare_status"], out["1_ML_0005"]["fare_status"], out["1_ML_0002"]["fare_status"]) == ("NULL", "INFO_UNAVAILABLE", None)
    report = skims.transit_report(routes.parse_transit(routes.read_documents(spark, str(tmp_path))))
    assert {r["category"]: r["count"] for r in report["overall"].collect()}["Successful Routes (OK)"] == 3


def test_drive_files(spark, tmp_path):
    write(tmp_path, {
        "O_1/O_1_a_9_PK_1_DRIVE.json": json.dumps({"status": 0, "route_summary": {"total_time": 300, "total_distance": 2500}}),
        "O_1/O_1_a_9_PK_2_DRIVE.json": json.dumps({"status": 0}), "O_1/O_1_a_9_PK_3_DRIVE.json": json.dumps({"status": 207, "status_message": "none"}),
        "O_1/ERROR_O_1_a_9_PK_4.json": json.dumps({"status": 400}), "O_1/O_1_a_9_PK_5_PT.json": "{}",
    })
    out = {r["dest_id"]: r for r in routes.parse_drive(routes.read_documents(spark, str(tmp_path))).collect()}
    assert {k: v["status"] for k, v in out.items()} == {"9_PK_1": "OK", "9_PK_2": "NO_ROUTE_SUMMARY", "9_PK_3": "ROUTING_ERROR_207", "9_PK_4": "HTTP_400"}
    assert (out["9_PK_1"]["travel_time_min"], out["9_PK_1"]["distance_km"]) == (5.0, 2.5)


def test_stream_in_two_runs_equals_one_batch(spark, tmp_path):
    src, target = str(tmp_path / "in"), str(tmp_path / "out")
    names = list(FILES)
    write(src, {n: FILES[n] for n in names[:3]})
    incremental.run_route_stream(spark, src, routes.parse_transit, "error_code", target, max_files=2)
    write(src, {n: FILES[n] for n in names[3:]})
    incremental.run_route_stream(spark, src, routes.parse_transit, "error_code", target)
    got = sorted(r["dest_id"] for part in ("clean", "errors") for r in incremental.read_rows(spark, target, part).collect())
    assert incremental.read_rows(spark, target, "clean").filter("error_code <> 'OK'").isEmpty()
    assert got == [f"1_ML_000{i}" for i in range(1, 7)]
    log = spark.read.parquet(f"{target}/log").groupBy("outcome").agg(F.sum("n").alias("n"))
    assert {r["outcome"]: r["n"] for r in log.collect()} == {"success": 3, "skipped": 1, "error": 1, "exception": 1}


def test_stream_dedup_over_runs(spark, tmp_path):
    """Replayed keys pass once, over restarts too; rows later than the delay are dropped; state is let go."""
    src, schema = str(tmp_path / "in"), "k string, ts timestamp"

    def run(*rows):
        spark.createDataFrame([(k, f"2024-01-{day:02d} 00:00:00") for k, day in rows], "k string, ts string").selectExpr("k", "timestamp(ts) ts").coalesce(1).write.mode("append").parquet(src)
        stream = incremental.stream_dedup(spark.readStream.schema(schema).parquet(src), ["k"], "ts", "2 days")
        query = incremental.append_stream(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        query.awaitTermination()
        return query.lastProgress["stateOperators"][0]["numRowsTotal"]

    assert run(("a", 1), ("b", 1), ("a", 1)) == 2
    run(("a", 2), ("c", 20))
    assert run(("a", 1), ("d", 20), ("c", 20)) == 2
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c", "d"]


def test_geojson_files(spark, tmp_path):
    def ring(*pts):
        return [list(p) for p in pts]

    doc = {"features": [
        {"properties": {"NAME": "a"}, "geometry": {"type": "MultiPolygon", "coordinates": [
            [ring((0, 0), (0, 4), (4, 4), (4, 0), (0, 0)), ring((1, 1), (2, 1), (2, 2), (1, 2), (1, 1))], [ring((10, 0), (12, 0), (12, 2), (10, 2), (10, 0))]]}},
    ]}
    (tmp_path / "z.geojson").write_text(json.dumps(doc, indent=1))
    df = geo_json.read_geojson(spark, str(tmp_path / "z.geojson"), "NAME: string", "MultiPolygon")
    assert df.select("NAME", geo.polygon_area(F.col("rings"))).first()[1] == 19.0
    pts = {"features": [{"properties": {"NAME": "h"}, "geometry": {"type": "Point", "coordinates": [103.8, 1.3]}}]}
    (tmp_path / "p.geojson").write_text(json.dumps(pts))
    assert tuple(geo_json.read_geojson(spark, str(tmp_path / "p.geojson"), "NAME: string", "Point").first()) == ("h", 103.8, 1.3)
    found = {"SrchResults": [{"FeatCount": 2}, {"NAME": "x", "LatLng": "1.3,103.8"}, {"NAME": "nopoint"}]}
    (tmp_path / "s.json").write_text(json.dumps(found))
    assert [tuple(r) for r in geo_json.read_search_results(spark, str(tmp_path / "s.json")).collect()] == [("x", 1.3, 103.8)]


def test_csv_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.1, None), (2, None, "a,\"b\"\nc")], "i int, x double, s string")
    sinks.write_fixed_csv(df, str(tmp_path / "f"), 15)
    back = {r["i"]: r for r in text_tables.read_csv(spark, str(tmp_path / "f"), multi_line=True).collect()}
    assert back["1"]["x"] == "0.100000000000000" and back["2"]["x"] is None
    sinks.write_csv(df, str(tmp_path / "g"))
    with pytest.raises(ValueError):
        text_tables.read_csv(spark, str(tmp_path / "g"), ["i", "zz"])


def test_lookup_document_keeps_nulls(spark):
    sectors = spark.createDataFrame([(1, "A"), (22, "B")], "postal_sector int, planning_area string")
    areas = spark.createDataFrame([("A", 1.5), ("B", None)], "planning_area string, car_time double")
    doc = json.loads(sinks.lookup_json(sectors, areas, ["car_time"]).first()["value"])
    assert doc == {"postal_to_planning_area": {"01": "A", "22": "B"}, "planning_area_accessibility": {"A": {"car_time": 1.5}, "B": {"car_time": None}}}


def test_origin_plan(spark):
    raw = spark.createDataFrame(
        [(" North ", "Total", "100"), ("Bukit \nTimah", "s1", "1,000"), ("Bukit Timah", "s2", "3,000"), ("Elsewhere", "s3", "-"), (None, None, None), ("Elsewhere", "s4", "50")],
        " Planning_Area string, Subzone string, pop_total string".replace(" Planning_Area", "Planning_Area"),
    )
    pop = origins.clean_population(raw)
    assert {r["subzone"]: r["pop_total"] for r in pop.collect()} == {"s1": 1000, "s2": 3000, "s3": 0, "s4": 50}
    table = spark.createDataFrame([("Bukit Timah", "4,000", "800"), ("Others", "100", "20")], "area string, Total string, `1 Person` string")
    out = {r["subzone"]: (r["Total"], r["1 Person"]) for r in origins.allocate_table(pop, table, ["Total", "1 Person"]).collect()}
    assert out == {"s1": (1000.0, 200.0), "s2": (3000.0, 600.0), "s3": (0.0, 0.0), "s4": (100.0, 20.0)}


def test_income_and_car_proxies(spark):
    labels = [c[0] for c in __import__("tripweave.constants", fromlist=["x"]).INCOME_CLASSES]
    def row(name, **counts):
        return (name, "s", *[float(counts.get(str(i), 0)) for i in range(len(labels))])
    data = [row("inner", **{"0": 10, "5": 20, "6": 20}), row("rich", **{"18": 9, "1": 1}), row("none")]
    df = spark.createDataFrame(data, "planning_area string, subzone string, " + ", ".join(f"`{c}` double" for c in labels))
    out = {r["planning_area"]: r for r in origins.income_statistics(df).collect()}
    assert out["inner"]["Mean_Monthly_Income"] == 5000.0 and out["inner"]["Median_Monthly_Income"] == 4750.0
    assert out["rich"]["Median_Monthly_Income"] is None and out["rich"]["median_open"]
    assert out["none"]["Mean_Monthly_Income"] is None and out["none"]["Median_Monthly_Income"] is None
    people = spark.createDataFrame([("a", 5744.422399), ("b", 0.0), ("c", 20000.0), ("d", 3000.0)], "planning_area string, Median_Monthly_Income double")
    cars = {r["planning_area"]: r for r in origins.combined_car_proxy(origins.car_proxies(people)).collect()}
    assert cars["a"]["Median_Monthly_Income_Percentile"] == pytest.approx(40.0) and cars["a"]["Interpolated_Expenditure"] == pytest.approx(5381.3)
    assert cars["b"]["car_proxy_1"] is None and cars["b"]["Ownership"] is None
    assert {cars[k]["PCA_Car_Proxy_01"] for k in "cd"} == {0.0, 1.0}


def test_origin_table_order(spark):
    zones = spark.createDataFrame([("Z1", " alpha", 2.0, 1.0, 1.0)], "subzone_id string, subzone_name string, area_sqm double, centroid_x double, centroid_y double")
    pop = spark.createDataFrame([("ALPHA ", "north", 10)], "subzone string, planning_area string, pop_total int")
    car = spark.createDataFrame([("North", 0.5)], "planning_area string, PCA_Car_Proxy double")
    hh = spark.createDataFrame([("NORTH", 3.0)], "planning_area string, avg_hh_size double")
    out = origins.origin_table(zones, pop, car, hh)
    assert out.columns == ["subzone_id", "subzone_name", "planning_area", "area_sqm", "centroid_x", "centroid_y", "pop_total", "population_density", "PCA_Car_Proxy", "avg_hh_size"]
    assert tuple(out.first())[6:] == (10, 5.0, 0.5, 3.0)


def test_stored_tables_go_to_the_configured_folder(spark):
    from tripweave.session import cut_lineage, shared_dir

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    stored = cut_lineage(spark.range(5))
    assert all(shared_dir(spark) in f for f in stored.inputFiles()) and stored.count() == 5


def test_lookup_lines_have_no_bound(spark):
    from pyspark.sql import functions as F

    sectors = spark.range(20_000).select(F.col("id").alias("postal_sector"), F.lit("A").alias("planning_area"))
    areas = spark.createDataFrame([("A", None)], "planning_area string, car_time double")
    lines = sinks.lookup_lines(sectors, areas, ["car_time"])
    assert lines.count() == 20_001
    assert lines.filter(F.col("value").contains("accessibility")).first()[0] == '{"planning_area":"A","accessibility":{"car_time":null}}'


def test_scratch_scope_leaves_nothing(spark, tmp_path):
    import os

    from tripweave.session import cut_lineage, scratch_scope, shared_dir

    before = set(os.listdir(shared_dir(spark)))
    with scratch_scope(spark):
        with scratch_scope(spark):
            assert cut_lineage(spark.range(5)).count() == 5
        assert cut_lineage(spark.range(7)).count() == 7
    assert set(os.listdir(shared_dir(spark))) == before


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_separator_is_found(spark, tmp_path, sep):
    """Other separators in quotes, in free text and in records over two lines do not mislead."""
    from tripweave.sources.text_tables import read_survey_csv, sniff_separator

    folder = tmp_path / "an export"
    folder.mkdir()
    rows = [["ResponseId", "Q1", "Q2"], ["Response ID", '"a, b; c|d"', "x"]] + [[f"R_{i}", '"1,2;3\t4|5"', "so; and, so" if sep == "|" and i == 3 else "z"] for i in range(9)]
    for part in range(2):
        (folder / f"part{part}.csv").write_text("\n".join(sep.join(r) for r in rows) + "\n\n")
    assert sniff_separator(spark, str(folder)) == sep
    out = read_survey_csv(spark, str(folder), "ResponseId")
    assert out.columns == ["ResponseId", "Q1", "Q2"] and out.count() == 18


def test_separator_of_odd_files(spark, tmp_path):
    from tripweave.sources.text_tables import sniff_separator

    (tmp_path / "one.csv").write_text("only\n1\n")
    (tmp_path / "empty.csv").write_text("")
    assert sniff_separator(spark, str(tmp_path / "one.csv")) == sniff_separator(spark, str(tmp_path / "empty.csv")) == ","


def test_bodies_are_parsed_once_whatever_is_filtered(spark):
    from tripweave.sources import routes

    docs = spark.createDataFrame([("O_1__to__2_ML_3_PT.json", '{"plan": {"itineraries": [{"fare": "1"}]}}'), ("O_1__to__2_ML_4_PT.json", None)], "file string, body string")
    ok = routes.parse_transit(docs).filter("error_code = 'OK'").select("origin_id", "dest_id")
    assert ok._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert [tuple(r) for r in ok.collect()] == [("O_1", "2_ML_3")]
    drive = routes.parse_drive(docs.selectExpr("replace(file, '_PT', '_DRIVE') AS file", "body")).filter("status = 'BAD_JSON'").select("dest_id")
    assert drive._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert [r[0] for r in drive.collect()] == ["2_ML_4"]
