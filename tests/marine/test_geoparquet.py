from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pelagia.functions import geometry as g
from pelagia.sources import geoparquet


def written(path, corners, **told):
    """Two squares of a tenth of a degree to a row group."""
    squares = [np.array([[x, y], [x + 0.1, y], [x + 0.1, y + 0.1], [x, y + 0.1], [x, y]]) for x, y in corners]
    box = [{"xmin": s[:, 0].min(), "ymin": s[:, 1].min(), "xmax": s[:, 0].max(), "ymax": s[:, 1].max()} for s in squares]
    covering = {"bbox": {k: ["box", k] for k in ("xmin", "ymin", "xmax", "ymax")}}
    geo = {"version": "1.1.0", "primary_column": "geom", "columns": {"geom": {"encoding": "WKB", "geometry_types": ["Polygon"], "covering": covering} | told}}
    table = pa.table({"k": list(range(len(squares))), "geom": [g.to_wkb([s]) for s in squares], "box": box}).replace_schema_metadata({"geo": json.dumps(geo)})
    pq.write_table(table, path, row_group_size=2)
    return squares


def test_row_groups_by_bounding_boxes(spark, tmp_path):
    path = f"{tmp_path}/water.parquet"
    squares = written(path, [(-124.0, 48.0), (-123.5, 48.2), (10.0, 50.0), (11.0, 51.0)])
    assert pq.ParquetFile(path).num_row_groups == 2
    near = geoparquet.polygons(spark, path, (-125, 47, -123.95, 49))
    rows = near.collect()
    assert [r.k for r in rows] == [0] and g.rings(bytes(rows[0].wkb))[0].tolist() == squares[0].tolist()
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(box.xmin)" in plan
    scanned = near.select("k")
    scanned.collect()
    node = scanned._jdf.queryExecution().executedPlan()
    while node.children().size():
        node = node.children().head()
    assert node.metrics().apply("numOutputRows").value() <= 2  # of four rows: one group was read


def test_projection_of_a_file(spark, tmp_path):
    squares = written(f"{tmp_path}/water.parquet", [(-124.0, 48.0), (-123.5, 48.2)])
    for r in geoparquet.polygons(spark, f"{tmp_path}/water.parquet", zone=10).collect():
        ring = g.rings(bytes(r.wkb))[0]
        back = np.stack(g.from_utm(ring[:, 0], ring[:, 1], 10), 1)
        again = np.stack(g.to_utm(back[:, 0], back[:, 1], 10), 1)
        assert np.abs(back - squares[r.k]).max() < 1e-9 and np.abs(again - ring).max() < 1e-3
    assert geoparquet.polygons(spark, str(tmp_path)).count() == 2


def test_other_files_are_refused(spark, tmp_path):
    written(f"{tmp_path}/a.parquet", [(0, 0)], crs={"id": {"authority": "EPSG", "code": 32610}})
    written(f"{tmp_path}/b.parquet", [(0, 0)], encoding="point")
    pq.write_table(pa.table({"k": [1]}), f"{tmp_path}/c.parquet")
    for name, why in (("a", "longitudes"), ("b", "encoding"), ("c", "no GeoParquet")):
        with pytest.raises(ValueError, match=why):
            geoparquet.polygons(spark, f"{tmp_path}/{name}.parquet")
