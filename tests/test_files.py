"""Containers, codecs, image files, logs and streams, on files made here."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import analytics, chains
from tessera.sources import codecs, container, images, opcodes, tags
from tessera.streaming import tasks

N = tags.NUMBER


def sample_file(order):
    plane = np.arange(60).reshape(6, 10, 1) * 1000 % 65536
    more = {N["Orientation"]: (3, [6]), N["AsShotNeutral"]: (5, [(1, 2), (1, 1), (2, 3)]), N["BaselineExposureOffset"]: (10, [(-1, 4)]), N["DateTime"]: (2, list(b"2020:01:02 \0")), N["ProfileToneCurve"]: (11, [0.0, 0.0, 1.0, 1.0]), 65000: (3, [7, 8]), N["OpcodeList1"]: (7, list(struct.pack(">IIIIIIIII", 1, 6, 0x01030000, 1, 16, 1, 2, 3, 4)))}
    inner = container.image_directory(plane, order, tile=(4, 4))
    first = container.image_directory(plane[:2], order, photometric=2) | {N["NewSubfileType"]: (4, [1]), "sub": [inner], "exif": [{N["ISOSpeedRatings"]: (3, [200]), N["ExposureTime"]: (5, [(1, 250)])}]} | more
    return container.build(order, [first, {N["ImageWidth"]: (3, [3])}]), plane


@pytest.mark.parametrize("order", ["<", ">"])
def test_directories_and_tags(spark, tmp_path, order):
    data, plane = sample_file(order)
    assert [k for k, _ in container.directories(data)] == ["BASELINE", "BASELINE", "EXIF", "SUB"]
    assert (container.raw_image(data)[0] == plane).all()
    (tmp_path / "b").mkdir()
    for name in ("b/one.DNG", "a.dng", "c.txt"):
        (tmp_path / name).write_bytes(data)
    assert [r.path.rsplit("/", 1)[1] for r in container.listing(spark, str(tmp_path)).collect()] == ["a.dng", "one.DNG"]
    found = container.files(spark, str(tmp_path)).filter("path LIKE '%a.dng'")
    rows = container.read_tags(found)
    got = {r.ifd_type + str(r.ifd_no): r for r in tags.wide(rows, ["ImageWidth", "Orientation", "AsShotNeutral", "BaselineExposureOffset", "DateTime", "ProfileToneCurve", "ISOSpeedRatings", "ExposureTime", "PlanarConfiguration", "Compression"]).collect()}
    first = got["BASELINE0"]
    assert (first.ImageWidth, first.Orientation, first.BaselineExposureOffset, first.DateTime, first.ProfileToneCurve, first.PlanarConfiguration) == (10, 6, -0.25, "2020:01:02", [0, 0, 1, 1], 1)
    assert np.allclose(first.AsShotNeutral, [0.5, 1, 2 / 3]) and got["EXIF2"].ISOSpeedRatings == 200 and got["EXIF2"].ExposureTime == 0.004 and got["BASELINE1"].Compression == -1
    assert {(r.label, r.family) for r in tags.labelled(rows).filter("tag_id IN (256, 65000)").collect()} == {("ImageWidth", "TIFF"), ("65000", None)}
    assert tags.gates(rows).first()[1:] == (False, False, True, True)
    assert {r.ifd_no for r in tags.raw_directory(rows).collect()} == {3} and {r.ifd_no for r in tags.exif_directory(rows).collect()} == {2}
    assert tags.has(rows, "SubIFDs").filter("SubIFDs").first().ifd_no == 0
    assert tags.readable(tags.wide(rows, ["PhotometricInterpretation", "PlanarConfiguration"])).count() == 2
    parsed = opcodes.parse_opcodes(rows.filter(f"tag_id = {N['OpcodeList1']}").selectExpr("path", "1 AS list_no", "raw AS data")).collect()
    assert [(r.name, r.nbytes, json.loads(r.fields)) for r in parsed] == [("TrimBounds", 16, {"top": 1, "left": 2, "bottom": 3, "right": 4})]
    assert container.read_planes(found).agg(F.sum("s")).first()[0] == plane.sum()


def test_broken_containers():
    data, _ = sample_file("<")
    for broken in (b"", b"XX" + data[2:], data[:9], data[:4] + b"\xff\xff\xff\x00" + data[8:]):
        with pytest.raises((ValueError, struct.error)):
            container.directories(broken)
    plane = np.zeros((4, 4, 1), int)
    for wrong in ({N["Compression"]: (3, [5])}, {N["PhotometricInterpretation"]: (3, [6])}, {N["PlanarConfiguration"]: (3, [2])}, {N["StripByteCounts"]: (4, [3])}):
        with pytest.raises(ValueError):
            container.raw_image(container.build("<", [container.image_directory(plane, more=wrong)]))
    circle = bytearray(container.build("<", [{N["ImageWidth"]: (3, [3])}]))
    circle[-4:] = circle[4:8]
    with pytest.raises(ValueError):
        container.directories(bytes(circle))


def test_codecs():
    rng = np.random.default_rng(3)
    for parts, precision in ((1, 16), (2, 16), (1, 12), (3, 8)):
        s = rng.integers(0, 1 << precision, (9, 6 * parts))
        s[0, :2] = 0, (1 << precision) - 1
        assert (codecs.lossless_jpeg(codecs.to_lossless_jpeg(s, parts, precision)) == s).all()
    flat = np.full((4, 8), 32768)
    data = codecs.to_lossless_jpeg(flat)
    assert (codecs.lossless_jpeg(data) == flat).all()
    for broken in (data[:-8], b"\xff\xd8\xff\xd9", b"\xff\xd8" + data[2:].replace(b"\xff\xc3", b"\xff\xc0"), b"no"):
        with pytest.raises((ValueError, struct.error)):
            codecs.lossless_jpeg(broken)
    assert codecs.unpack_bits(bytes([0b10110011, 0b10000000]), 3, 3).tolist() == [5, 4, 7]
    assert codecs.plain(b"\x01\x02\x03\x04", 1, 2, 16, True).tolist() == [[513, 1027]] and codecs.plain(b"\x01\x02\x03\x04", 1, 2, 16, False).tolist() == [[258, 772]]


def test_large_lossless_frames(spark):
    """More lines, or samples in a line, than a frame's fields name, in one strip; and more samples than are coded at once."""
    rng = np.random.default_rng(8)
    for shape, parts in (((70001, 2), 1), ((70001, 2), 2), ((2, 65537), 1), ((3, 131074), 2), ((65535, 1), 1), ((1100, 1000), 1)):
        s = rng.integers(0, 1 << 16, shape)
        image = s.reshape(*shape, 1)
        data = codecs.to_lossless_jpeg(s, parts)
        lines, samples = struct.unpack_from(">HH", data, data.index(b"\xff\xc3") + 5)
        assert lines * samples * parts >= s.size
        block = container.image_directory(image, encode=lambda block, p=parts: codecs.to_lossless_jpeg(block.reshape(len(block), -1), p), compression=codecs.LOSSLESS_JPEG)
        assert (container.raw_image(container.build("<", [block]))[0] == image).all()
    plane = spark.range(70001).selectExpr("0 AS image_id", "CAST(id AS int) AS y", "0 AS x", "CAST(id * 7919 % 65536 AS int) AS s")
    back = container.read_planes(container.written(plane, "tall", components=1))
    assert back.count() == 70001 and back.filter("s <> y * 7919L % 65536").isEmpty()


def test_png_filters():
    rng = np.random.default_rng(5)
    image = rng.integers(0, 256, (5, 4, 3)).astype(np.uint8)
    raw, above = b"", np.zeros(12, int)
    for y, kind in enumerate((0, 1, 2, 3, 4)):
        row = image[y].reshape(-1).astype(int)
        left, corner = np.concatenate([[0] * 3, row[:-3]]), np.concatenate([[0] * 3, above[:-3]])
        paeth = [a if abs(b - c) <= abs(a - c) and abs(b - c) <= abs(a + b - 2 * c) else b if abs(a - c) <= abs(a + b - 2 * c) else c for a, b, c in zip(left, above, corner)]
        guess = [0 * row, left, above, (left + above) // 2, np.array(paeth)][kind]
        raw += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        above = row
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert (images.read_png(data)[0] == image).all()


def test_image_files(spark, tmp_path):
    """What is written here is read by Spark's own image source, and the other way by way of a sink."""
    yy, xx = np.mgrid[:24, :20]
    image = np.stack([xx * 3000, yy * 2500, (xx + yy) * 1000], 2).astype(np.int32)
    spark.dataSource.register(images.FileSink)
    rows = [(kind.lower(), bytearray(images.encoded(image, kind))) for kind in ("PNG8", "BMP", "JPEG")]
    files = [(f"{k}.{'jpg' if k == 'jpeg' else k[:3]}", v) for k, v in rows]
    spark.createDataFrame(files, "path string, content binary").write.format("image_files").mode("append").option("path", str(tmp_path)).save()
    eight = images.to_8_bits(image)
    got = {r.image.origin.rsplit("/", 1)[1]: np.frombuffer(bytes(r.image.data), np.uint8).reshape(24, 20, -1)[:, :, 2::-1] for r in spark.read.format("image").load(str(tmp_path)).collect()}
    assert (got["png8.png"] == eight).all() and (got["bmp.bmp"] == eight).all()
    assert np.abs(got["jpeg.jpg"].astype(int) - eight).mean() < 3
    assert [images.sniffed(bytes(v)) for _, v in rows] == ["png", "bmp", "jpeg"] and images.sniffed(b"") is None
    assert (images.read_png(images.write_png(image))[0] == image).all() and (images.read_tiff(images.write_tiff(image, 16, ">"))[0] == image).all()
    assert images.from_unit(np.array([-1, 0.5, 2.0])).tolist() == [0, 32767, 65535]


def test_lookups(spark):
    df = spark.createDataFrame([(21, [0, 1, 1, 2])], "i int, c array<int>")
    assert df.select(tags.temperature(F.col("i")), tags.pattern_name(F.col("c"))).first()[:] == (6504, "RGGB")
    for wrong in (tags.temperature(F.lit(99)), tags.pattern_name(F.array(F.lit(7)))):
        with pytest.raises(Exception, match="unknown"):
            df.select(wrong).collect()
    assert tags.illuminants(spark).count() == 21 and tags.tag_dictionary(spark).filter("family = 'DNG'").count() > 90


def test_chains(spark):
    df = spark.createDataFrame([(0, 0, 0, 40000), (0, 0, 1, 3)], "image_id int, y int, x int, s int")
    out = chains.Chain(chains.on_samples(lambda s: f"{s} * 2")).add(chains.on_samples(lambda s: f"{s} - x"))(df)
    assert [r.s for r in out.orderBy("x").collect()] == [65535, 5]
    rgb = df.selectExpr("image_id", "y", "x", "s AS r", "1 AS g", "2 AS b")
    assert chains.on_colors(lambda r, g, b: (f"{r} + {g}", b, g), whole=True)(rgb).orderBy("x").first()[3:] == (40001, 2, 1)
    assert chains.by_text("r - one_r AS d", one=rgb)(rgb).agg(F.sum("d")).first()[0] == 0
    memo, made = chains.Memo(), []
    for _ in range(2):
        memo.get(("RCD", 0), lambda: (made.append(1), rgb)[1])
    assert made == [1] and memo.missing([("RCD", 0), ("PPG", 0)]) == [("PPG", 0)]
    memo.clear()
    heard = []
    seen = chains.timed("step", lambda *a: heard.append(a))(rgb)
    seen.collect()
    seen.finished()
    assert heard[0][:2] == ("step", 2)
    assert df.select(chains.looked_up(F.col("s"), {3: "three"}, "other").alias("v")).distinct().count() == 2


def test_task_stream(spark, tmp_path):
    """Marks in two batches give what the batch form gives for tasks that have ended, and an open one stays in the state."""
    marks = [("u", "a", 1, "start"), ("u", "a", 5, "start"), ("u", "b", 6, "end"), ("u", "a", 9, "end"), ("u", "b", 10, "start"), ("v", "a", 11, "start")]
    ddl = "system_id string, task string, ts bigint, kind string"
    for k, part in enumerate((marks[:2], marks[2:])):
        spark.createDataFrame(part, ddl).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = tasks.append_log(tasks.pair_tasks(stream), str(tmp_path / "log"), str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    got = tasks.read_log(spark, str(tmp_path / "log"), tasks.PAIRED)
    assert sorted(map(tuple, got.collect())) == [("u", "a", False, 1, 5, 4), ("u", "a", True, 5, 9, 4)]
    batch = analytics.task_pairs(spark.createDataFrame(marks, ddl)).collect()
    assert sorted(map(tuple, batch)) == [("u", "a", False, 1, 5, 4), ("u", "a", True, 5, 9, 4), ("u", "b", False, 10, 10, 0), ("v", "a", False, 11, 11, 0)]


def test_logs(spark, tmp_path):
    header = "systemId, cpuVendor,cpuName\n"
    (tmp_path / "joined.csv").write_text(header + '"a","v","None"\n' + header + '"b","v","x"\n')
    assert sorted(map(tuple, tasks.read_log(spark, str(tmp_path), "systemId string, cpuVendor string, cpuName string").collect())) == [("a", "v", "None"), ("b", "v", "x")]
    row = spark.createDataFrame([("s", 1, "f", 2, 3, "MT", "t", "d", 10, 15, 5)], tasks.TIMING)
    for _ in range(2):
        tasks.log_rows(row, str(tmp_path / "timing"))
    assert tasks.read_log(spark, str(tmp_path / "timing")).count() == 2
