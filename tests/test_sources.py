"""Sources and sinks on small files."""

import struct
import zlib

import pytest

from zonegrain.sources import files
from zonegrain.streaming import arrivals


def png(rows):
    """An 8-bit gray image file."""
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + bytes(r) for r in rows)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_stack_scan_and_write(spark, tmp_path):
    for s in ("s1", "s2"):
        (tmp_path / s).mkdir()
        for z in range(3):
            (tmp_path / s / f"{s}_{z:08d}.png").write_bytes(png([[z * 10 + y * 3 + x for x in range(3)] for y in range(2)]))
        (tmp_path / s / "notes.png").write_bytes(png([[1]]))
    v = files.voxels(files.stack(spark, str(tmp_path)))
    got = {(r.sample, r.z, r.y, r.x): r.val for r in v.collect()}
    assert got == {(s, z, y, x): z * 10 + y * 3 + x for s in ("s1", "s2") for z in range(3) for y in range(2) for x in range(3)}
    files.write_slices(files.slices(v), str(tmp_path / "out"))
    again = files.voxels(spark.read.parquet(str(tmp_path / "out")).select("sample", "z", "height", "width", "data"))
    assert {(r.sample, r.z, r.y, r.x): r.val for r in again.collect()} == got


def test_sheet_round_trip(spark, tmp_path):
    f = spark.createDataFrame([(s, b, float(b * 2 + len(s))) for s in ("a", "bb") for b in range(3)], "sample string, bin int, val double")
    files.write_sheet(f, str(tmp_path / "sheet"))
    assert sorted(map(tuple, files.sheet(spark, str(tmp_path / "sheet")).collect())) == sorted(map(tuple, f.collect()))


def test_names(spark):
    paths = spark.createDataFrame([(p,) for p in ("/r/x_01.png", "/r/x_02.png", "/r/y_01.png", "/r/x_03.bmp")], "path string")
    assert {r.path for r in files.siblings(paths, "/r/x_02.png").collect()} == {"/r/x_01.png", "/r/x_02.png"}
    pairs = spark.createDataFrame([(f"/d/{s}/{k}/1.png",) for s in ("p1_a", "p2_b") for k in ("imgs", "masks")], "path string")
    assert {r.subject_id for r in files.catalog(pairs, 2).collect()} == {"p1", "p2"}
    with pytest.raises(ValueError):
        files.catalog(pairs, 3)


def test_results_and_parameters(spark, tmp_path):
    r = spark.createDataFrame([("a", 1.5), ("b", 2.0)], "sample string, grade double")
    for _ in range(2):
        files.append_results(r, str(tmp_path / "log"))
    assert files.results(spark, str(tmp_path / "log")).count() == 4
    (tmp_path / "p.csv").write_text("zone,ks1,ks2,sigma1,sigma2,N,large,small,wc,wl,ws\nsurf,21,25,17,13,8,18,3,9,5,5\n")
    assert files.parameters(spark, str(tmp_path / "p.csv")).first().large == 18


def test_stream_goes_on_after_a_failure(spark, tmp_path):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "sample string, v int")
    t.repartition(2, "sample").write.parquet(str(tmp_path / "in"))

    def bad(df):
        raise RuntimeError("no such zone")

    arrivals.score_arrivals(spark, str(tmp_path / "in"), t.schema, bad, str(tmp_path / "out"), str(tmp_path / "failed"), str(tmp_path / "state"))
    assert "no such zone" in spark.read.parquet(str(tmp_path / "failed")).first().reason
