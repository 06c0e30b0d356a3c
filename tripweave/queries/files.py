"""Readers, writers, route documents and incremental runs. Documents are derived from the tables."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.functions import geo
from tripweave.operators.ranking import keep_first
from tripweave.plans import skims
from tripweave.queries.registry import query
from tripweave.session import scratch_path
from tripweave.sources import geo_json, routes, sinks, text_tables
from tripweave.streaming import incremental
from tripweave.tables import table


@query("S1 S10", "SELECT c_custkey, c_acctbal, CASE WHEN c_nationkey <> 3 THEN c_mktsegment END AS c_mktsegment FROM customer")
def csv_round_trip(spark, d):
    path = scratch_path(spark, "csv")
    c = table(spark, d, "customer")
    sinks.write_csv(c.withColumn("c_mktsegment", F.when(F.col("c_nationkey") != 3, F.col("c_mktsegment"))), path)
    schema = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return text_tables.read_csv(spark, path, ["c_custkey", "c_acctbal", "c_mktsegment"], schema)


@query("S2 S3", "SELECT 'R_' || o_orderkey AS ResponseId, o_orderpriority AS Q1 FROM orders")
def survey_export(spark, d):
    """Exports with three separators, none of them named to the reader."""
    o = table(spark, d, "orders", F.concat(F.lit("R_"), F.col("o_orderkey")).alias("ResponseId"), F.col("o_orderpriority").alias("Q1"), "o_orderkey")
    labels = spark.createDataFrame([("Response ID", "What is your age?"), ('{"ImportId":"_recordId"}', '{"ImportId":"QID1"}')], "ResponseId string, Q1 string")
    parts = []
    for i, sep in enumerate([",", ";", "\t"]):
        path = scratch_path(spark, "survey")
        part = o.filter(F.pmod("o_orderkey", F.lit(3)) == i).drop("o_orderkey")
        part.unionByName(labels).write.option("header", True).option("sep", sep).option("escape", '"').csv(path)
        parts.append(text_tables.read_survey_csv(spark, path, "ResponseId"))
    return reduce(DataFrame.unionByName, parts)


@query("S4 S12", "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS balance FROM customer GROUP BY 1")
def report_tables(spark, d):
    base = scratch_path(spark, "report")
    c = table(spark, d, "customer", "c_mktsegment", "c_acctbal")
    sinks.write_report({
        "Counts": c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")), "Means": c.groupBy("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 4).alias("balance")),
    }, base)
    return text_tables.read_report_table(spark, base, "Counts").join(text_tables.read_report_table(spark, base, "Means"), "c_mktsegment")


@query("S11", "SELECT p_partkey, printf('%.15f', p_size / 64) AS price FROM part")
def fixed_precision_text(spark, d):
    p = table(spark, d, "part", "p_partkey", (F.col("p_size") / 64).alias("price"))
    return sinks.fixed_precision(p)


@query("S5 S13", """
SELECT s_suppkey, round(s_acctbal, 2) AS balance, 100.0::DOUBLE AS area, round(s_suppkey * 3.0 + 5, 6)::DOUBLE AS cx FROM supplier
""")
def geojson_features(spark, d):
    """Suppliers written as clockwise GeoJSON squares, one feature per line, and read back."""
    path = scratch_path(spark, "geojson")
    x = F.col("s_suppkey") * 3.0
    clockwise = F.reverse(geo.box_ring(x, F.lit(0.0), x + 10, F.lit(10.0)))
    s = table(spark, d, "supplier", "s_suppkey", F.col("s_acctbal").alias("balance")).withColumn("rings", F.array(clockwise))
    feature = sinks.feature_json(F.col("rings"), ["s_suppkey", "balance"])
    sinks.write_features(s, feature, path)
    parsed = geo_json.read_feature_lines(spark, path, "s_suppkey: bigint, balance: double")
    return parsed.select("s_suppkey", "balance", F.round(geo.polygon_area(F.col("rings")), 6).alias("area"), F.round(geo.polygon_centroid(F.col("rings"))["x"], 6).alias("cx"))


@query("S6 F4 F5", "SELECT s_name AS name, s_acctbal AS lat, s_suppkey::DOUBLE AS lon, 'leisure' AS category FROM supplier WHERE s_suppkey % 10 <> 0")
def search_result_pages(spark, d):
    point = F.concat(F.col("s_acctbal").cast("decimal(12,2)").cast("string"), F.lit(","), F.col("s_suppkey").cast("string"))
    entry = F.struct(F.when(F.col("s_suppkey") % 10 != 0, F.col("s_name")).alias("NAME"), point.alias("LatLng"))
    meta = F.struct(F.lit(None).cast("string").alias("NAME"), F.lit(None).cast("string").alias("LatLng"))
    pages = table(spark, d, "supplier").select(F.array(meta, entry).alias("SrchResults"))
    found = geo_json.parse_search_results(pages)
    return geo_json.labelled_places(found, "HS", {"category": "leisure"}).drop("poi_id")


@query("S7 G1", """
WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)
SELECT vec_id AS osm_id, CASE vec_id % 5 WHEN 0 THEN 'way' WHEN 2 THEN 'relation' ELSE 'node' END AS osm_type, 'Place ' || vec_id AS name,
  round(CASE vec_id % 5 WHEN 0 THEN 4 WHEN 2 THEN 8 ELSE 0.0002 * 0.0002 * 16 * sin(pi() / 16) * 1e6 END, 6) AS area_millis
FROM e WHERE vec_id % 5 IN (0, 2, 3)
""")
def map_elements(spark, d):
    """Closed ways, open ways, relations with two outer rings, nodes, and elements without tags."""
    e, k = F.col("embedding"), F.col("vec_id") % 5
    x, y = e[0].cast("double"), e[1].cast("double")

    def square(dx, closed=True):
        corners = [(0, 0), (0.002, 0), (0.002, 0.002), (0, 0.002)] + ([(0, 0)] if closed else [])
        return F.array(*[F.struct((y + b).alias("lat"), (x + dx + a).alias("lon")) for a, b in corners])

    member = [F.struct(F.lit(role).alias("role"), square(dx).alias("geometry")) for role, dx in (("outer", 0.0), ("outer", 0.01), ("inner", 0.001))]
    tags = F.when(k != 4, F.create_map(F.lit("name"), F.concat(F.lit("Place "), "vec_id"), F.lit("shop"), F.lit("mall")))
    elements = table(spark, d, "embeddings").select(
        F.when(k <= 1, "way").when(k == 2, "relation").otherwise("node").alias("type"), F.col("vec_id").alias("id"), tags.alias("tags"),
        F.when(k >= 3, y).alias("lat"), F.when(k >= 3, x).alias("lon"), F.when(k == 0, square(0.0)).when(k == 1, square(0.0, False)).alias("geometry"),
        F.when(k == 2, F.array(*member)).alias("members"),
    )
    parsed = geo_json.parse_elements(elements)
    return parsed.select("osm_id", "osm_type", "name", F.round(geo.polygon_area(F.col("rings")) * 1e6, 6).alias("area_millis"))


def transit_documents(spark, d):
    """One route file per order: its lines are the legs. Some are errors, empty or corrupt."""
    legs = table(spark, d, "lineitem", "l_orderkey", "l_extendedprice", "l_quantity").groupBy("l_orderkey").agg(
        F.collect_list(F.struct(F.col("l_extendedprice").alias("distance"))).alias("legs"), F.sum("l_quantity").alias("q")
    )
    o = table(spark, d, "orders", "o_orderkey", "o_custkey").join(legs, F.col("o_orderkey") == F.col("l_orderkey"))
    key = F.col("o_orderkey")
    fare = F.when(key % 7 == 1, F.lit("info unavailable")).when(key % 7 == 2, "free").when(key % 7 > 2, "1.66")
    trip = F.struct(
        (F.col("q") * 60).alias("duration"), (F.col("q") * 30).alias("transitTime"), (F.col("q") * 20).alias("walkTime"),
        F.when(key % 2 == 0, F.col("q") * 10).alias("waitingTime"), (key % 3).cast("int").alias("transfers"), fare.alias("fare"), "legs",
    )
    trips = F.when(key % 10 == 1, F.array().cast("array<string>"))
    good = F.to_json(F.struct(F.struct(F.array(trip, trip).alias("itineraries")).alias("plan")))
    empty = F.to_json(F.struct(F.struct(trips.alias("itineraries")).alias("plan")))
    body = F.when(key % 10 == 0, '{"status": 404, "message": "no"}').when(key % 10 == 1, empty).when(key % 10 == 2, '{"plan": {"itin').otherwise(good)
    pair = F.concat(F.lit("O_"), F.col("o_custkey"), F.lit("__to__1_ML_"), key)
    file = F.when(key % 10 == 0, F.concat(F.lit("ERROR_"), pair, F.lit(".json"))).when(key % 10 == 3, F.lit("notes.json")).otherwise(F.concat(pair, F.lit("_PT.json")))
    return o.select(file.alias("file"), body.alias("body"))


TRANSIT = """
WITH l AS (SELECT l_orderkey, sum(l_extendedprice) AS m, sum(l_quantity) AS q FROM lineitem GROUP BY 1),
k AS (SELECT o_orderkey, o_orderkey % 10 AS c, 'O_' || o_custkey AS origin_id, '1_ML_' || o_orderkey AS dest_id, m, q,
  CASE WHEN o_orderkey % 7 = 0 THEN 'NULL' WHEN o_orderkey % 7 = 1 THEN 'INFO_UNAVAILABLE' WHEN o_orderkey % 7 = 2 THEN 'PARSE_ERROR_free' ELSE 'OK' END AS fs FROM orders JOIN l ON o_orderkey = l_orderkey WHERE o_orderkey % 10 <> 3),
s AS (SELECT *, CASE c WHEN 0 THEN 'HTTP_404' WHEN 1 THEN 'NO_ITINERARY' WHEN 2 THEN 'BAD_JSON' ELSE 'OK' END AS error_code FROM k)
"""


@query("S8 S9 F31 F32 I3", TRANSIT + """
SELECT origin_id, dest_id, error_code, CASE WHEN c > 3 THEN q ELSE 0 END AS total_time_min, CASE WHEN c > 3 AND o_orderkey % 2 = 0 THEN round(q / 6, 6) ELSE 0 END AS wait_time_min,
  CASE WHEN c > 3 THEN o_orderkey % 3 ELSE 0 END::INTEGER AS transfers, CASE WHEN c > 3 THEN round(m / 1000, 6) ELSE 0 END AS distance_km, CASE WHEN c > 3 AND fs = 'OK' THEN 1.66 ELSE 0 END::DOUBLE AS pt_fare_proxy,
  CASE WHEN c > 3 THEN fs END AS fare_status FROM s
""")
def transit_skims(spark, d):
    rows = routes.parse_transit(transit_documents(spark, d))
    return rows.select("origin_id", "dest_id", "error_code", "total_time_min", F.round("wait_time_min", 6).alias("wait_time_min"), "transfers", F.round("distance_km", 6).alias("distance_km"), "pt_fare_proxy", "fare_status")


@query("I2 I3 I5 S9", TRANSIT + """
SELECT error_code, CASE WHEN c > 3 THEN 'success' WHEN c = 1 THEN 'skipped' WHEN c = 2 THEN 'exception' ELSE 'error' END AS outcome, count(*) AS n, round(sum(CASE WHEN c > 3 THEN q ELSE 0 END), 4) AS minutes,
  sum(count(*)) OVER (PARTITION BY CASE WHEN c > 3 THEN 'success' WHEN c = 1 THEN 'skipped' WHEN c = 2 THEN 'exception' ELSE 'error' END)::BIGINT AS logged FROM s GROUP BY 1, 2
""")
def streamed_skims(spark, d):
    """Route documents through a stream in several batches; its rows, and the log's counts beside them."""
    base = scratch_path(spark, "routes")
    transit_documents(spark, d).write.parquet(f"{base}/in")
    docs = spark.readStream.schema("file string, body string").option("maxFilesPerTrigger", 4).parquet(f"{base}/in")
    incremental.run_document_stream(docs, routes.parse_transit, "error_code", f"{base}/out")
    names = ["error_code", "total_time_min"]
    rows = incremental.read_rows(spark, f"{base}/out", "clean").select(names).unionByName(incremental.read_rows(spark, f"{base}/out", "errors").select(names))
    sums = rows.groupBy("error_code").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("total_time_min"), 4).alias("minutes"))
    sums = sums.withColumn("outcome", incremental.outcome(F.col("error_code")))
    log = spark.read.parquet(f"{base}/out/log").groupBy("outcome").agg(F.sum("n").alias("logged"))
    return sums.join(log, "outcome").select("error_code", "outcome", "n", "minutes", "logged")


@query("A1 A2 A3 A4", TRANSIT + """
SELECT 'Total Records' AS category, count(*) AS count FROM s UNION ALL SELECT 'Successful Routes (OK)', count(*) FILTER (error_code = 'OK') FROM s UNION ALL SELECT 'HTTP 404 Errors', count(*) FILTER (error_code = 'HTTP_404') FROM s
UNION ALL SELECT 'No Itinerary Found', count(*) FILTER (error_code = 'NO_ITINERARY') FROM s UNION ALL SELECT 'Exceptions', count(*) FILTER (error_code = 'BAD_JSON') FROM s
UNION ALL SELECT 'Fare Info Unavailable', count(*) FILTER (error_code = 'OK' AND fs = 'INFO_UNAVAILABLE') FROM s UNION ALL SELECT 'Fare Info Available', count(*) FILTER (error_code = 'OK' AND fs = 'OK') FROM s
""")
def transit_report(spark, d):
    return skims.transit_report(routes.parse_transit(transit_documents(spark, d)))["overall"]


@query("S8 I5", """
WITH o AS (SELECT o_orderkey, o_orderkey % 5 AS c, o_totalprice FROM orders)
SELECT 'O_' || o_orderkey AS origin_id, '9_PK_7' AS dest_id, CASE c WHEN 0 THEN 'HTTP_400' WHEN 1 THEN 'ROUTING_ERROR_207' WHEN 2 THEN 'NO_ROUTE_SUMMARY' ELSE 'OK' END AS status,
  CASE c WHEN 0 THEN 'HTTP_ERROR' WHEN 1 THEN 'ROUTING_ERROR: no path' WHEN 2 THEN 'INVALID_JSON' END AS error_type, CASE WHEN c > 2 THEN round(o_totalprice / 60, 6) ELSE 0 END AS travel_time_min, (c > 2)::INTEGER AS accessible_flag FROM o
""")
def drive_skims(spark, d):
    return routes.parse_drive(drive_documents(spark, d)).select("origin_id", "dest_id", "status", "error_type", F.round("travel_time_min", 6).alias("travel_time_min"), "accessible_flag")


def drive_documents(spark, d):
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    good = F.to_json(F.struct(F.lit(0).alias("status"), F.struct(price.alias("total_time"), price.alias("total_distance")).alias("route_summary")))
    body = F.when(key % 5 == 0, '{"status": 400}').when(key % 5 == 1, '{"status": 207, "status_message": "no path"}').when(key % 5 == 2, '{"status": 0}').otherwise(good)
    pair = F.concat(F.lit("O_"), key, F.lit("_9_PK_7"))
    file = F.when(key % 5 == 0, F.concat(F.lit("ERROR_"), pair, F.lit(".json"))).otherwise(F.concat(pair, F.lit("_DRIVE.json")))
    return table(spark, d, "orders", "o_orderkey", "o_totalprice").select(file.alias("file"), body.alias("body"))


@query("I5 A1", """
SELECT CASE o_orderkey % 5 WHEN 2 THEN 'skipped' WHEN 0 THEN 'error' WHEN 1 THEN 'error' ELSE 'success' END AS outcome, count(*) AS n FROM orders GROUP BY 1
""")
def outcome_classes(spark, d):
    rows = routes.parse_drive(drive_documents(spark, d))
    return incremental.outcome_counts(rows, "status").drop("batch_id")


@query("S14 O20", """
SELECT lpad(n_nationkey::VARCHAR, 2, '0') AS sector, n_name AS area, CASE WHEN n_nationkey % 4 <> 0 THEN n_regionkey * 1.5::DOUBLE END AS car_time FROM nation
""")
def lookup_document(spark, d):
    """The nested lookup written as one JSON document and read back as rows."""
    n = table(spark, d, "nation")
    sectors = n.select(F.col("n_nationkey").alias("postal_sector"), F.col("n_name").alias("planning_area"))
    areas = n.select(F.col("n_name").alias("planning_area"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_regionkey") * 1.5).alias("car_time"))
    doc = sinks.lookup_json(sectors, areas, ["car_time"])
    schema = "postal_to_planning_area map<string, string>, planning_area_accessibility map<string, struct<car_time: double>>"
    back = doc.select(F.from_json("value", schema).alias("j"))
    return back.select(F.explode("j.postal_to_planning_area").alias("sector", "area"), "j.planning_area_accessibility").select(
        "sector", "area", F.try_element_at("planning_area_accessibility", F.col("area"))["car_time"].alias("car_time")
    )


@query("S15 I1", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def appended_batches(spark, d):
    """Events appended in two runs; the second run adds only what the first did not."""
    path = scratch_path(spark, "append")
    ev = table(spark, d, "events", "event_id", "event_type", "value")
    sinks.append_rows(ev.filter("event_type <> 'click'"), path)
    schema = "event_id bigint, event_type string, value double"
    done = text_tables.read_csv(spark, path, schema=schema)
    sinks.append_rows(incremental.pending(ev, done, "event_id"), path)
    final = incremental.final_dedup(text_tables.read_csv(spark, path, schema=schema), ["event_id"], ["event_type"])
    return final.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


#: Files come in any order, so a key may come back as late as the events span.
SPAN = "1000 days"


@query("I2 I4", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def streamed_append(spark, d):
    """Events through the file source and sink of a stream, de-duplicated by key."""
    base = scratch_path(spark, "stream")
    ev = table(spark, d, "events", "event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    ev.unionByName(ev.filter("event_type = 'view'")).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(ev.schema).parquet(f"{base}/in")
    incremental.append_stream(incremental.stream_dedup(stream, ["event_id"], "ts", SPAN), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    out = spark.read.schema(ev.schema).parquet(f"{base}/out")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("A19 S8", TRANSIT + "SELECT origin_id, min(dest_id) AS dest_id FROM s WHERE error_code = 'OK' GROUP BY 1")
def first_route_per_origin(spark, d):
    ok = routes.parse_transit(transit_documents(spark, d)).filter("error_code = 'OK'").select("origin_id", "dest_id")
    return keep_first(ok, ["origin_id"], ["dest_id"])
