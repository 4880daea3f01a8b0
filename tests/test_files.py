"""Image and point files: what is written is read back, and what others write is read too."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_engine import GRID, field_of, values
from voxsieve.config import GridConfig
from voxsieve.sources import ranges, vtk


def image(dims, arrays, order="<", wide="UInt64", deflate=0, mark="raw", kind="ImageData", piece=None):
    """An image file as other programs write it: arrays are (name, values), deflated in blocks of so many bytes if asked."""
    size, data, xml = "<Q" if wide == "UInt64" else "<I", b"", ""
    size = order + size[1]
    for name, v in arrays:
        raw = v.astype(v.dtype.newbyteorder(order)).tobytes()
        xml += f'<DataArray type="{vtk.NAMES[v.dtype.str[1:]]}" Name="{name}" format="appended" offset="{len(data)}"/>\n'
        if deflate:
            blocks = [raw[k : k + deflate] for k in range(0, len(raw), deflate)]
            packed = [zlib.compress(b) for b in blocks]
            data += b"".join(struct.pack(size, n) for n in (len(blocks), deflate, len(raw) % deflate, *map(len, packed))) + b"".join(packed)
        else:
            data += struct.pack(size, len(raw)) + raw
    e = " ".join(f"5 {4 + n}" for n in dims)
    squeeze = ' compressor="vtkZLibDataCompressor"' if deflate else ""
    return f"""<?xml version="1.0"?>
<VTKFile type="{kind}" version="0.1" byte_order="{"LittleEndian" if order == "<" else "BigEndian"}" header_type="{wide}"{squeeze}>
  <ImageData WholeExtent="{e}" Origin="1 2 3" Spacing="0.5 1 2">
  <Piece Extent="{piece or e}">
    <CellData><DataArray type="Float32" Name="other" format="appended" offset="0"/></CellData>
    <PointData Scalars="b">{xml}</PointData>
  </Piece>
  </ImageData>
  <AppendedData encoding="{mark}">
   _""".encode() + data + b"\n  </AppendedData>\n</VTKFile>\n"


@pytest.mark.parametrize("layout", ["files", "parts"])
def test_image_files_round_trip(spark, tmp_path, layout):
    field = field_of(spark, [values(k) for k in range(3)]).repartition(5)
    folder = f"file://{tmp_path}/images"
    vtk.write_vti(field, folder, GRID, "Pf{t}.vti", per_task=10, layout=layout, spacing=(0.5, 1.0, 2.0))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["images"]
    back = vtk.read_vti(spark, folder, r"Pf([0-9]+)")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, field.collect()))
    some = vtk.read_vti(spark, folder, r"Pf([0-9]+)", times=(1, 9), cells=(5, 9))
    assert sorted(map(tuple, some.collect())) == sorted(tuple(r) for r in field.collect() if r.t >= 1 and 5 <= r.gid <= 9)
    info = vtk.vti_info(spark, folder, r"Pf([0-9]+)", times=(1, 1)).collect()
    assert [(r.t, r.x_dim, r.y_dim, r.z_dim, r.spacing, r.arrays) for r in info] == [(1, *GRID.dims, [0.5, 1.0, 2.0], ["values"])]
    with pytest.raises(Exception, match="missing"):
        vtk.write_vti(field.where("gid <> 7"), folder + "2", GRID)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["images"]


@pytest.mark.parametrize("order,wide,deflate", [("<", "UInt32", 0), (">", "UInt64", 0), ("<", "UInt64", 64), (">", "UInt32", 4096), ("<", "UInt32", 160)])
def test_files_of_other_programs(spark, tmp_path, monkeypatch, order, wide, deflate):
    dims = (5, 4, 3)
    a, b = np.arange(60).astype("f8") / 7, (np.arange(60) * 3).astype("i2")
    (tmp_path / "x12.vti").write_bytes(image(dims, [("a", a), ("b", b)], order, wide, deflate))
    folder = f"file://{tmp_path}"
    for name, want in (("", a), ("b", b), (1, b)):
        rows = vtk.read_vti(spark, folder, r"x([0-9]+)", name).collect()
        assert sorted(map(tuple, rows)) == [(12, k, float(v)) for k, v in enumerate(want)]
    assert vtk.vti_info(spark, folder, r"x([0-9]+)").first()[2:] == (5, 4, 3, [0.5, 1.0, 2.0], [1.0, 2.0, 3.0], [5, 9, 5, 8, 5, 7], ["a", "b"])
    # slices end within blocks, and every cell comes once
    monkeypatch.setattr(vtk, "CELLS_PER_TASK", 7)
    reader = vtk.ImageReader(folder, r"x([0-9]+)", "a", False, {})
    parts = reader.partitions()
    assert len(parts) == 9
    assert [v for p in parts for r in reader.read(p) for v in r.column(2).to_pylist()] == a.tolist()


def test_what_isnt_asked_for_isnt_read(spark, tmp_path, monkeypatch):
    n, folder = 40, f"file://{tmp_path}"
    for t in range(4):
        for deflate in (0, 512):
            (tmp_path / f"{'z' if deflate else 'x'}{t}.vti").write_bytes(image((n, n, 1), [("a", np.random.default_rng(t).random(n * n))], deflate=deflate))
    read = []
    plain = ranges.Stored.read
    monkeypatch.setattr(ranges.Stored, "read", lambda self, store, at, k: read.append(k) or plain(self, store, at, k))

    def cost(kind, **options):
        read.clear()
        reader = vtk.ImageReader(folder, kind + r"([0-9]+)", "", False, ranges.asked(**options) if options else {})
        rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
        return rows, sum(read)

    for kind in "xz":
        whole = cost(kind)
        some = cost(kind, times=(2, 2), cells=(100, 179))
        assert whole[0] == 4 * n * n and whole[1] > 4 * n * n * (8 if kind == "x" else 6)
        assert some[0] == 80 and some[1] <= 8192 + (80 * 8 if kind == "x" else 3 * 512 + 400)
    whole, some = vtk.read_vti(spark, folder, r"x([0-9]+)"), vtk.read_vti(spark, folder, r"x([0-9]+)", times=(3, 3), cells=(0, 8))
    assert (whole.rdd.getNumPartitions(), some.rdd.getNumPartitions()) == (4, 1)  # a task for each slice
    assert some.count() == 9
    # scans of one DataFrame keep apart
    assert whole.unionByName(whole.where("t = 1")).count() == 5 * n * n
    assert whole.where("t = 1").alias("a").join(whole.where("t = 2").alias("b"), F.expr("a.gid = b.gid")).count() == n * n


def test_files_that_arent_read(spark, tmp_path):
    v = np.zeros(8)
    for k, (raw, words) in enumerate([
        (image((2, 2, 2), [("a", v)], mark="base64"), "encoded as text"), (image((2, 2, 2), [("a", v)], piece="5 5 5 6 5 6"), "pieces"), (image((2, 2, 2), [("a", v)], kind="PolyData"), "PolyData"),
        (b"<VTKFile type='ImageData'></VTKFile>", "no appended data"), (image((2, 2, 2), [("a", v)]).replace(b'format="appended" offset="0"/>\n', b'format="ascii"/>\n'), "isn't appended"),
    ]):
        (tmp_path / f"{k}").mkdir()
        (tmp_path / f"{k}" / "x1.vti").write_bytes(raw)
        with pytest.raises(Exception, match=words):
            vtk.read_vti(spark, f"file://{tmp_path}/{k}", r"x([0-9]+)").collect()
    (tmp_path / "none").mkdir()
    assert vtk.read_vti(spark, f"file://{tmp_path}/none", r"x([0-9]+)").collect() == []


@pytest.mark.parametrize("layout", ["files", "parts"])
def test_point_files_round_trip(spark, tmp_path, layout):
    cfg = GridConfig((6, 4, 2), (3, 2, 1))
    rows = [(t, k, float(k % 6), float(t), 1.5, k / 8) for t in range(3) for k in range(5 + 40 * t)]
    points = spark.createDataFrame(rows, "t int, place long, x double, y double, z double, value double").repartition(4)
    folder = f"file://{tmp_path}/cloud"
    vtk.write_vtp(points, folder, per_task=16, layout=layout)
    assert sorted(map(tuple, vtk.read_vtp(spark, folder, r"cloud_([0-9]+)").collect())) == rows
    assert vtk.read_vtp(spark, folder, r"cloud_([0-9]+)", times=(2, 2)).agg(F.sum("value")).first()[0] == sum(r[5] for r in rows if r[0] == 2)
    with pytest.raises(Exception, match="missing"):
        vtk.write_vtp(points.where("place <> 2"), folder)
    assert cfg.cells == 48 and len(list(tmp_path.iterdir())) == 1
