import json

from test_graph import graph

from callweave.streaming.incoming import watch_builds


def test_builds_are_reported_once(spark, tmp_path):
    reference = graph(spark, ("k", ["x"], []), ("x", [], ["k"]))
    (tmp_path / "in").mkdir()
    build = [{"name": "k", "called_names": ["FUN_7"], "caller_names": []}, {"name": "FUN_7", "called_names": [], "caller_names": ["k"]}]
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps(build))
        for _ in range(2):
            watch_builds(spark, str(tmp_path / "in"), reference, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.build, r.address, r.known_name) for r in rows) == [("a.json", "7", "x"), ("b.json", "7", "x")]
