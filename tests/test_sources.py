"""Files with odd headers, names and rows."""

import pytest

from millwatch.sources import readers

SCHEMA = "time_s double, ax double, az double"


def files(tmp_path, **texts):
    for name, text in texts.items():
        path = tmp_path / name.replace("__", "/")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.with_name(path.name + ".csv").write_bytes(text.encode() if isinstance(text, str) else text)
    return str(tmp_path)


def read(spark, root):
    return _grouped(readers.read_runs(spark, root, SCHEMA).collect())


def _grouped(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.run_id, r.i)):
        out.setdefault(r.run_id, []).append((r.i, r.time_s, r.ax, r.az))
    return out


def test_columns_are_told_by_name(spark, tmp_path):
    root = files(
        tmp_path, good__a="time_s,ax,ay,az\n0,1,2,3\n1,4,5,6\n", b="az,ax,time_s\n9,8,7\n", c="time_s,az\n0,5\n", d="AX,other,az,ax\n1,2,3,4\n", e='﻿"time_s","ax","a,z"\n1,2,3\n', f="az,az\n1,2\n", g="x,y\n1,2\n",
    )
    assert read(spark, root) == {
        "good/a.csv": [(0, 0.0, 1.0, 3.0), (1, 1.0, 4.0, 6.0)], "b.csv": [(0, 7.0, 8.0, 9.0)], "c.csv": [(0, 0.0, None, 5.0)], "d.csv": [(0, None, 4.0, 3.0)], "e.csv": [(0, 1.0, 2.0, None)], "f.csv": [(0, None, None, 1.0)], "g.csv": [(0, None, None, None)],
    }


def test_unfit_files_are_left_out_as_a_whole(spark, tmp_path):
    root = files(tmp_path, a="time_s,az\n0,1\n1,2,3\n", b=b"time_s,az\n0,1\n\xff\xfe,2\n", c="time_s,az\n", d="time_s,az\n0,x\n1\n\n2,3\n", empty="", **{"odd name [1]+{2}": "az\n1\n"})
    rows = readers.read_runs(spark, root, SCHEMA)
    assert _grouped(rows.collect()) == {"d.csv": [(0, 0.0, None, None), (1, 1.0, None, None), (2, 2.0, None, 3.0)], "odd name [1]+{2}.csv": [(0, None, None, 1.0)]}
    assert sorted(r.path for r in readers.unread_runs(spark, root, rows).collect()) == ["a.csv", "b.csv", "c.csv"]


def test_rows_of_a_file_in_blocks_keep_their_numbers(spark, tmp_path):
    root = files(tmp_path, a="az,n\n" + "".join(f"{k},x\n" for k in range(30_000)), b="n,az\n" + "".join(f"x,{k}\n" for k in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = readers.read_runs(spark, root, SCHEMA)
        assert rows.where("i <> az").count() == 0 and rows.groupBy("run_id").count().count() == 2 and rows.count() == 50_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_bounds(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert readers.read_runs(spark, str(tmp_path / "none"), SCHEMA).columns == ["time_s", "ax", "az", "i", "run_id", "quality"]
    root = files(tmp_path, a="az\n1\n", b="ax\n1\n")
    with pytest.raises(ValueError, match="different headers"):
        readers.read_runs(spark, root, SCHEMA, bound=1)
