"""The command line over landed records."""

import json
import uuid

import pytest

from skylattice.__main__ import run


def test_runs(spark, tmp_path, capsys):
    name = lambda: f"t{uuid.uuid4().hex[:8]}"
    records = [{"id": "p1", "name": "school", "location": "113.6,34.7", "cityname": "郑州市", "typecode": "1"}, {"id": "p1", "name": "again", "location": "113.6,34.7"}, {"id": "far", "location": "10,10"}]
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, records)))
    points, zones, types = name(), name(), name()
    run(spark, ["points", str(tmp_path / "p.json"), points, "--lat-min", "34", "--lat-max", "36", "--lng-min", "113", "--lng-max", "115", "--cell-m", "50000"])
    assert [r["poi_id"] for r in spark.table(points).collect()] == ["p1"]
    areas = [{"area_id": 1, "level": 7, "lat": 34.5, "lng": 113.8, "radius": 6000}, {"area_id": 2, "level": 99, "lat": 34.5, "lng": 113.8, "radius": 6000}]
    (tmp_path / "z.json").write_text("\n".join(map(json.dumps, areas)))
    run(spark, ["zones", str(tmp_path / "z.json"), zones, "--region", "中国", "--cell-m", "1000000"])
    assert [r["area_id"] for r in spark.table(zones).collect()] == [1]
    run(spark, ["types", "b", "--table", types])
    assert spark.table(types).count() == 40 and "001001" in capsys.readouterr().out
    schema = name()
    run(spark, ["sync", "default", schema, "--tables", types])
    assert spark.table(f"{schema}.{types}").count() == 40
    run(spark, ["sync", schema, schema, "--list"])
    assert types in capsys.readouterr().out
    for bad in (["points", "x", "y"], ["zones", "x", "y", "--region", "nowhere"]):
        with pytest.raises(SystemExit):
            run(spark, bad)
