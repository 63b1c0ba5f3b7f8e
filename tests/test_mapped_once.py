"""Mapped objects are worked out once each."""

from tramline.operators import research


def test_a_record_is_written_and_read_once(spark):
    tags = {"tourism": "guest_house", "addr:street": "Dorf 1"}
    node = "struct<lon:double,lat:double>"
    df = spark.createDataFrame([("way", 1, "Ferienhof A", tags, [(10.0, 54.0), (10.2, 54.2), (999.0, 1.0)]), ("way", 2, "Ferienhof B", tags, [(999.0, 1.0)]), ("node", 3, "Ferienhof C", tags, None), ("node", 4, "Ferienhof D", {}, [(10.0, 1.0)])], f"osm_type string, osm_id long, name string, tags map<string,string>, nodes array<{node}>")
    out = research.from_mapped(research.mapped_objects(df.repartition(2)))
    (row,) = out.collect()
    assert (row.source_place_id, row.name, row.address, round(row.lon, 6), round(row.lat, 6), row.state_code) == ("way/1", "Ferienhof A", "Dorf 1", 10.1, 54.1, "SH")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StructsToJsonEvaluator") == 1 and "get_json_object" not in plan.lower(), plan
