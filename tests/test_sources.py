"""Header scans by ranges, container records, frame tables, bulk samples, bands, folds and streams."""

import collections
import itertools
import math
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelquarry.operators import animation, automaton, bands, catalogue, events, pixels, resample, sequence
from pixelquarry.plans import fixtures, registry
from pixelquarry.sources import gif, headers, images, records, texts
from pixelquarry.streaming import live


def monkeypatch_conf(spark, key, value, request):
    """A setting for the rest of one test."""
    old = spark.conf.get(key)
    request.addfinalizer(lambda: spark.conf.set(key, old))
    spark.conf.set(key, value)


def be(v, n):
    return v.to_bytes(n, "big")


def le(v, n):
    return v.to_bytes(n, "little")


def png(*chunks, w=5, h=6, ctype=2):
    body = [(b"IHDR", be(w, 4) + be(h, 4) + bytes([8, ctype, 0, 0, 0])), *chunks]
    return b"\x89PNG\r\n\x1a\n" + b"".join(be(len(d), 4) + t + d + bytes(4) for t, d in body)


GIF = (
    b"GIF89a" + le(4, 2) + le(3, 2) + bytes([0x80 | 1, 2, 0]) + bytes(range(12))  # four shared colours, background 2
    + b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"
    + b"\x21\xf9\x04" + bytes([2 << 2 | 1]) + le(7, 2) + b"\x03\x00"  # dispose 2, 70 ms, index 3 is clear
    + b"\x2c" + le(0, 2) + le(0, 2) + le(4, 2) + le(3, 2) + b"\x00" + b"\x02\x02\x44\x01\x00"
    + b"\x2c" + le(1, 2) + le(1, 2) + le(2, 2) + le(2, 2) + b"\xc0" + bytes([90, 91, 92, 93, 94, 95]) + b"\x02\x02\x44\x01\x00"  # two colours of its own, interlaced
    + b"\x3b"
)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The fixture's headers as files, each with a payload of 300 KB behind it where the format allows one, and large files."""
    root = tmp_path_factory.mktemp("headers")
    rows = fixtures.view(spark, "/root/testdata/sf0.001", "v_headers").where("kind < 60").limit(120).collect()
    for r in rows:
        tail = b"" if r.path.endswith((".webp", ".bin", ".jpg")) or len(r.hx) < 40 else bytes(300_000)
        (root / r.path).write_bytes(bytes.fromhex(r.hx) + tail)
    (root / "sub").mkdir()
    (root / "sub" / "large.PNG").write_bytes(png((b"tEXt", bytes(2_000_000)), (b"tRNS", bytes(6)), (b"IDAT", bytes(3_000_000))))
    (root / "sub" / "empty.png").write_bytes(b"")
    (root / "sub" / "other.txt").write_bytes(b"text")
    return root


def test_header_scan_is_the_scan_of_whole_files(spark, folder):
    exts = (*images.EXTENSIONS, "bin", "hdr", "psd", "pic")
    scan = headers.header_files(spark, str(folder), exts, files_per_partition=16)
    assert scan.rdd.getNumPartitions() > 4
    fields = ["format", "width", "height", "channels", "bits", "reason"]

    def read(files):
        probed = catalogue.validate_header(catalogue.probe_header(catalogue.sniff_format(files)))
        return {r.path.rpartition("/")[2]: tuple(r[f] for f in fields) for r in probed.select("path", *fields).collect()}

    whole = images.read_image_files(spark, str(folder), exts)
    got = read(scan)
    assert got.pop("empty.png")[-1] == "unknown image type"  # Spark's own reader leaves files without bytes out
    assert got == read(whole.select("path", "length", "content")) and len(got) == 121
    assert got["large.PNG"][:4] == ("png", 5, 6, 4)
    sizes = scan.agg(F.sum("length").alias("all"), F.sum("bytes_read").alias("read"), F.max("bytes_read").alias("most"), F.max("reads").alias("reads")).first()
    assert sizes.read < 0.05 * sizes.all and sizes.most < 40_000
    assert headers.header_files(spark, str(folder)).where("path like '%other.txt'").count() == 0
    assert headers.header_files(spark, str(folder), None).where("path like '%other.txt'").count() == 1


def plain_records(content):
    """Records of PNG and RIFF files by slicing."""
    out, riff = [], content[:4] == b"RIFF"
    at = 12 if riff else 8
    while at + 8 <= len(content):
        kind, size = (content[at : at + 4], content[at + 4 : at + 8]) if riff else (content[at + 4 : at + 8], content[at : at + 4])
        n = int.from_bytes(size, "little" if riff else "big")
        out.append((kind.decode(), at, n, content[at + 8 : at + 8 + min(n, 32)]))
        at += 8 + n + n % 2 if riff else 12 + n
    return out


def test_list_chunks_of_four_containers(spark):
    jpeg = b"\xff\xd8\xff\xe0" + be(4, 2) + b"ab\xff\xff\xff\xc0" + be(11, 2) + b"\x08" + be(7, 2) + be(9, 2) + b"\x01xxx" + b"\xff\xda" + be(4, 2) + b"zz" + b"coded\xff\xd9"
    webp = b"RIFF" + bytes(4) + b"WEBP" + b"VP8X" + le(3, 4) + b"abc\0" + b"VP8L" + le(5, 4) + b"\x2f" + bytes(5)
    files = {1: png((b"PLTE", bytes(6)), (b"IDAT", bytes(50)), (b"IEND", b"")), 2: webp, 3: jpeg, 4: GIF, 5: b"none", 6: None, 7: png()[:20], 8: b""}
    df = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in files.items()], "file_id long, content binary")
    got = collections.defaultdict(list)
    for r in images.list_chunks(df).orderBy("file_id", "chunk_no").collect():
        assert r.chunk_no == len(got[r.file_id])
        got[r.file_id].append((r.type, r.offset, r.length, bytes(r.head)))
    assert got[1] == plain_records(files[1]) and got[2] == plain_records(webp) and got[7] == plain_records(files[7]) and set(got) == {1, 2, 3, 4, 7}
    assert [(t, n, head) for t, _, n, head in got[3]] == [("E0", 4, b"ab"), ("C0", 11, b"\x08\0\x07\0\x09\x01xxx"), ("DA", 4, b"zz")]
    assert [(t, GIF[at : at + n][:32] == head) for t, at, n, head in got[4][:-1]] == [("21", True), ("21", True), ("2C", True), ("2C", True)] and got[4][-1][0] == "3B"
    df.createOrReplaceTempView("some_files")
    by_sql = spark.sql("SELECT file_id, c.type FROM some_files, LATERAL list_chunks(content) c WHERE c.container = 'jpeg'").collect()
    assert sorted(r.type for r in by_sql) == ["C0", "DA", "E0"]
    assert [tuple(r) for r in catalogue.probe_jpeg(images.list_chunks(df)).collect()] == [(3, 9, 7, 1, 8)]


def test_window_reads_what_is_asked_for():
    content = png((b"tEXt", bytes(100_000)), (b"tRNS", bytes(6)), (b"IDAT", bytes(100_000)))
    window = records.Window(lambda at, n: content[at : at + n], len(content), 1000)
    assert records.facts("png", window) == records.facts("png", records.in_memory(content)) == {"clear": True}
    assert window.bytes_read <= 4000
    for form, lead in (("pnm", b"P6\n#" + b"x" * 9000 + b"\n3 4\n255\n"), ("hdr", b"#?RADIANCE\n" + b"a=b\n" * 3000 + b"\n-Y 4 +X 3\n")):
        assert records.text_end(records.in_memory(lead + bytes(50_000)), form) == len(lead)
        assert records.text_end(records.in_memory(lead[:-3]), form) == len(lead) - 3


def test_automaton_is_a_walk_whatever_the_blocks(spark):
    """A random table: states and places of faults of every key, with blocks of one, of a few and of all records."""
    rng = np.random.default_rng(2)
    table = rng.integers(0, 7, (5, 4)).tolist()
    words = {k: rng.integers(0, 4, n).tolist() for k, n in enumerate((1, 2, 3, 9, 50, 300, 1000))}
    table[0][0] = table[1][0] = table[2][0] = 1  # so that some run long
    words[6] = [0] * 999 + [1]

    def walk(word):
        state = 0
        for at, symbol in enumerate(word):
            state = table[state][symbol]
            if state >= len(table):
                return state, at
        return state, None

    df = spark.createDataFrame([(k, at, s) for k, word in words.items() for at, s in enumerate(word)], "key long, at_ long, sym int")
    for block in (1, 7, 2048):
        got = {r.key: (r.state, r.at) for r in automaton.run(df, "key", "at_", "sym", table, block=block).collect()}
        assert got == {k: walk(w) for k, w in words.items()}


def test_every_chunk_reason_occurs(spark):
    d = "/root/testdata/sf0.01"
    reasons = {r.reason for r in registry.QUERIES["check_chunk_order"](spark, d).select("reason").distinct().collect()}
    assert reasons == {None, "no IEND", *catalogue.PNG_FAULTS}
    assert {r.reason for r in registry.QUERIES["check_riff_order"](spark, d).select("reason").distinct().collect()} == {None, "no image record", *catalogue.RIFF_FAULTS}
    given = {x[7] for x in fixtures.HEADERS}
    assert {r.reason for r in registry.QUERIES["header_rules"](spark, "/root/testdata/sf0.001").select("reason").distinct().collect()} == given and len(given) > 35


def test_gif_frames_and_colours(spark):
    files = spark.createDataFrame([(1, bytearray(GIF)), (2, bytearray(b"GIF"))], "file_id long, content binary")
    frames = gif.gif_frames(files, images.list_chunks(files))
    got = [tuple(r)[:-1] for r in frames.orderBy("frame").collect()]
    assert got == [(1, 0, 0, 0, 4, 3, 70, 2, 3, False, 0, 2), (1, 1, 1, 1, 2, 2, 0, 0, None, True, 2, 2)]
    palettes = gif.gif_palettes(files, frames)
    assert sorted(map(tuple, palettes.collect())) == [*((1, 0, k, 3 * k, 3 * k + 1, 3 * k + 2) for k in range(4)), (1, 2, 0, 90, 91, 92), (1, 2, 1, 93, 94, 95)]
    colors = gif.frame_colors(frames, palettes)
    assert {(r.frame, r.idx): r.a for r in colors.collect()} == {(0, 0): 255, (0, 1): 255, (0, 2): 255, (0, 3): 0, (1, 0): 255, (1, 1): 255}
    indexes = spark.createDataFrame([(1, 0, 0, 0, 1), (1, 0, 0, 1, 3), (1, 1, 0, 1, 0), (1, 1, 1, 1, 9)], "image_id long, frame int, y int, x int, idx int")
    named = frames.withColumnRenamed("file_id", "image_id")
    canvas = animation.composite_frames(gif.draw_frames(indexes, colors), named)
    out = animation.background_fill(canvas, named, gif.backgrounds(frames, palettes))
    # frame 0 goes again before frame 1; where nothing is drawn, the background's colour
    assert {(r.frame, r.y, r.x): (r.r, r.g, r.b, r.a) for r in out.collect()} == {
        (0, 0, 0): (3, 4, 5, 255), (0, 0, 1): (6, 7, 8, 255), (1, 0, 0): (6, 7, 8, 255), (1, 0, 1): (90, 91, 92, 255),
    }


def test_bulk_samples_round_trip(spark):
    """All layouts with padded rows, some bands high; a cut payload gives its whole rows."""
    rng, rows, want = np.random.default_rng(4), [], {}
    for k, (order, planar, wide, up) in enumerate((o, p, w, u) for o in ("g", "ga", "rgb", "bgr", "bgra") for p in (False, True) for w in (False, True) for u in (False, True)):
        w, h = 7, 130
        image = rng.integers(0, 65536 if wide else 256, (h, w, len(order)))
        stored = image[::-1] if up else image
        kind = ">u2" if wide else "u1"
        parts = [stored[:, :, c : c + 1] for c in range(len(order))] if planar else [stored]
        lines = [line.astype(kind).tobytes() + b"pad" for part in parts for line in part]
        rows.append((k, w, h, 5, len(lines[0]), up, order, planar, wide, bytearray(b"lead!" + b"".join(lines))))
        names = dict(zip(order, np.moveaxis(image, 2, 0)))
        grey, full = names.get("g"), np.full((h, w), 65535 if wide else 255)
        want[k] = np.stack([*(names.get(c, grey) for c in "rgb"), names.get("a", full)], axis=2)
    schema = "file_id long, w int, h int, data_off int, stride int, bottom_up boolean, channels string, planar boolean, wide boolean, content binary"
    df = spark.createDataFrame(rows, schema)
    got = {k: np.full(v.shape, -1) for k, v in want.items()}
    pdf = pixels.explode_samples(df).toPandas()
    for k, part in pdf.groupby("file_id"):
        got[k][part.y, part.x] = part[list("rgba")].to_numpy()
        assert len(part) == 7 * 130
    assert all((got[k] == want[k]).all() for k in want)
    cut = df.where("file_id = 16").withColumn("content", F.expr("substring(content, 1, 5 + stride * 40 + 9)"))
    part = pixels.explode_samples(cut).toPandas()
    assert sorted(part.y.unique()) == list(range(40)) and (got[16][part.y, part.x] == part[list("rgba")].to_numpy()).all()


def test_packed_rows_bottom_up(spark):
    df = spark.createDataFrame([(1, 8, 3, 2, 1, True, bytearray(b"xx\x01\x02\x80")), (2, 8, 3, 2, 1, False, bytearray(b"xx\x01\x02\x80"))], "file_id long, w int, h int, data_off int, stride int, bottom_up boolean, content binary")
    on = {(r.file_id, r.y, r.x) for r in pixels.explode_packed_raster(df, 1).where("idx = 1").collect()}
    assert on == {(1, 0, 0), (1, 1, 6), (1, 2, 7), (2, 2, 0), (2, 1, 6), (2, 0, 7)}


def test_bands_give_the_same_as_whole_images(spark, request):
    """A tall image in many bands against numpy, and no task with all of it."""
    h, w = 400, 50
    v = np.random.default_rng(5).integers(0, 256, (h, w))
    df = spark.createDataFrame([(1, y, x, int(v[y, x])) for y in range(h) for x in range(w)], "image_id long, y int, x int, v int")
    n = sequence.neighbours(df, "v", w).toPandas().sort_values(["y", "x"])
    up = np.vstack([np.full((1, w), np.nan), v[:-1]])
    left, corner = np.hstack([np.full((h, 1), np.nan), v[:, :-1]]), np.hstack([np.full((h, 1), np.nan), up[:, :-1]])
    for name, want in (("_u", up), ("_l", left), ("_ul", corner)):
        assert np.array_equal(n[name].to_numpy(float).reshape(h, w), want, equal_nan=True)
    wide = resample.upsample_v2(df).toPandas().sort_values(["y", "x"]).v.to_numpy().reshape(2 * h, w)
    above, below = np.vstack([v[:1], v[:-1]]), np.vstack([v[1:], v[-1:]])
    assert (wide[::2] == (3 * v + above + 2) >> 2).all() and (wide[1::2] == (3 * v + below + 2) >> 2).all()
    monkeypatch_conf(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false", request)
    dealt = bands.in_bands(df, above=True, below=True)
    sizes = [len(p) for p in dealt.select("y").rdd.glom().collect()]
    assert dealt.where("_own").count() == h * w and max(sizes) < 0.7 * h * w
    residual = sequence.gradient_residual(df.withColumnRenamed("v", "a"), "a", w, 3)
    back = sequence.gradient_restore(residual, 3).toPandas().sort_values(["y", "x"]).v.to_numpy().reshape(h, w)
    assert (back == v).all()


def plain_fold(rows, lo, hi):
    pos, out = {}, {}
    for s, seq, step, goto in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        p = pos.get(s, lo)
        pos[s] = min(hi, max(lo, goto if goto is not None else p + (step or 0)))
        out[s, seq] = pos[s]
    return out, pos


def test_folds_of_sessions_that_span_files(spark, request):
    """One session holds most events and lies in many files; others are short, one has no name, deltas and gotos are missing."""
    monkeypatch_conf(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false", request)
    rng = np.random.default_rng(6)
    sizes = {"hot": 6000, "": 40, None: 30, "a": 1, **{f"s{k}": int(rng.integers(1, 60)) for k in range(40)}}
    rows = [(s, k, None if rng.random() < 0.02 else int(rng.integers(-40, 41)), int(rng.integers(-20, 130)) if rng.random() < 0.01 else None) for s, n in sizes.items() for k in range(n)]
    df = spark.createDataFrame(rows, "session string, seq long, step long, goto long").repartition(7)
    path, last = plain_fold(rows, 0, 100)
    for goto in ("goto", None):
        if goto is None:
            path, last = plain_fold([(*r[:3], None) for r in rows], 0, 100)
        got = events.clamped_fold(df, "session", ["seq"], "step", 0, 100, goto=goto).collect()
        assert len(got) == len(rows) and {(r.session, r.seq): r.pos for r in got} == path
        assert {r.session: r.pos for r in events.last_position(df, "session", ["seq"], "step", 0, 100, goto=goto).collect()} == last
    spread = events._maps(events._ordered(df, "session", ["seq"], "step", 0, 100, None)).where("key = '=hot'").count()
    assert spread > 1
    assert events.clamped_fold(df.limit(0), "session", ["seq"], "step", 0, 100).count() == 0


def test_positions_go_on_after_a_restart(spark, tmp_path, request):
    kinds = ["line", "page", "wheel", "top", "bottom", "track", "drag"]
    rng = np.random.default_rng(8)
    rows = [(s, k, kinds[int(rng.integers(0, 7))], int(rng.integers(-3, 4)) * 120 + 7) for k in range(60) for s in (1, 2, 3)]
    schema = "session_id long, seq long, kind string, delta long"

    def run(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = live.stream_position(stream, 0, 400, page=90).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
        query = out.outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(45) is not False and query.exception() is None

    monkeypatch_conf(spark, "spark.sql.streaming.noDataMicroBatches.enabled", "false", request)  # timers alone make no batches
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        run(rows[:90])
        run(rows[90:])
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = {(r.session_id, r.seq): r.pos for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    steps = events.position_steps(spark.createDataFrame(rows, schema), 0, 400, 90)
    want = events.clamped_fold(steps, "session_id", ["seq"], "step", 0, 400, goto="goto").collect()
    assert got == {(r.session_id, r.seq): r.pos for r in want} and len(got) == len(rows)


def test_stream_catalogue_takes_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"a{k}.png").write_bytes(png())
    (tmp_path / "in" / "bad.png").write_bytes(b"junk")

    def run():
        assert live.stream_catalogue(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120) is not False
        return spark.read.parquet(str(tmp_path / "out" / "headers")).count(), spark.read.parquet(str(tmp_path / "out" / "quarantine")).count()

    assert run() == (3, 1)
    (tmp_path / "in" / "b.gif").write_bytes(GIF)
    assert run() == (4, 1)
    assert run() == (4, 1)


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    bmp = b"BM" + le(78, 4) + bytes(4) + le(54, 4) + le(40, 4) + le(3, 4) + le(2, 4) + le(1, 2) + le(24, 2) + bytes(24) + b"".join(bytes(range(9 * y, 9 * y + 9)) + bytes(3) for y in range(2))
    (tmp_path / "in" / "a.bmp").write_bytes(bmp)
    (tmp_path / "in" / "b.txt").write_bytes(b"x")
    (tmp_path / "in" / "c.png").write_bytes(b"broken")
    files = images.read_image_files(spark, str(tmp_path / "in"))
    assert sorted(r.path.rpartition("/")[2] for r in files.collect()) == ["a.bmp", "c.png"] and images.read_image_files(spark, str(tmp_path / "in"), None).count() == 3
    assert [tuple(r)[1:4] for r in images.read_decoded_images(spark, str(tmp_path / "in"), drop_invalid=True).collect()] == [(3, 2, 3)]
    good, bad = images.map_decoder(files.withColumn("file_id", F.monotonically_increasing_id()), lambda c: (struct.unpack("<i", c[18:22])[0], 2, 3, c[54:]))
    assert [(r.width, bytes(r.pixels) == bmp[54:]) for r in good.collect()] == [(3, True)] and [r.reason[:5] for r in bad.collect()] == ["error"]
    out = str(tmp_path / "bmp")
    images.write_bmp_corpus(files.select("path", "content"), out)
    with pytest.raises(Exception, match="already exists"):
        images.write_bmp_corpus(files.select("path", "content"), out)


def test_runs_expand_with_overruns(spark):
    """Runs past the width are clipped or flagged."""
    runs = spark.createDataFrame([(1, 0, 5, 3), (1, 3, 6, 4), (1, 7, 7, 2), (2, 0, 9, 5)], "k long, start int, v int, length int")
    clipped = sequence.rle_expand(runs, ["k"], "v", width=5, on_overrun="clip")
    assert sorted(map(tuple, clipped.collect())) == [*((1, p, 5) for p in range(3)), (1, 3, 6), (1, 4, 6), *((2, p, 9) for p in range(5))]
    flagged = sequence.rle_expand(runs, ["k"], "v", width=5)
    assert {(r.k, r.pos): (r.v, r.overrun) for r in flagged.where("k = 1").collect()} == {
        **{(1, p): (5, False) for p in range(3)}, **{(1, p): (6, True) for p in range(3, 7)}, **{(1, p): (7, True) for p in (7, 8)},
    }
    assert {r.overrun for r in flagged.where("k = 2").collect()} == {False}


def test_runs_of_the_bytes_of_texts(spark, sf_dir):
    given = [(1, "aabbb"), (2, ""), (3, None), (4, "b" * 23), (5, "b"), (6, "\u00e9\u00e9 \u4e2d"), (7, ""), (7, "cc"), (7, "cc")]
    frame = spark.createDataFrame(given, "k long, text string").coalesce(1)
    want = []
    for k, text in given:
        at = 0
        for v, same in itertools.groupby((text or "").encode()):
            n = len(list(same))
            want.append((k, at, v, n))
            at += n
    for piece in (1, 2, 5, 7, 1 << 20):  # runs and texts over the cuts of pieces
        for least in (1, 2, 3):
            got = [tuple(r) for r in texts.text_runs(frame, "k", least=least, piece=piece).collect()]
            assert sorted(got) == sorted(r for r in want if r[3] >= least)
    plan = registry.QUERIES["rle_bytes"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan


def test_canvases_are_one_sort_and_any_number_of_tasks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    frames = [(i, k * (i + 1), int(rng.integers(0, 4)), i) for i in range(4) for k in range(9)]
    draws = sorted({(i, f + 50 * (rng.random() < 0.05), int(rng.integers(0, 2)), int(rng.integers(0, 3))) for i, f, _, _ in frames for _ in range(4)})
    draws = [(*d, *(int(v) for v in rng.integers(0, 256, 3)), 255 if rng.random() < 0.8 else 128) for d in draws]
    at = {d[:4]: d[4:] for d in draws if d[7] > 128}
    want = []
    for i, y, x in sorted({(d[0], d[2], d[3]) for d in draws}):
        below = (None,) * 4
        for _, f, dispose, _ in [r for r in frames if r[0] == i]:
            v = at.get((i, f, y, x), below)
            filled = (7, 8, 9, 255) if v[3] is None and i > 0 else v
            want.append((i, f, y, x, *filled))
            below = v if dispose <= 1 and (i, f, y, x) in at else below
    moments = spark.createDataFrame(frames, "image_id long, frame int, dispose int, bgindex int")
    painted = spark.createDataFrame(draws, "image_id long, frame int, y int, x int, r int, g int, b int, a int")
    colours = spark.createDataFrame([(i, i, 7, 8, 9) for i in range(4)], "image_id long, bgindex int, r int, g int, b int")
    for rows, few in ((1 << 20, 100), (20, 0)):
        monkeypatch.setattr(animation, "TASK_ROWS", rows)
        monkeypatch.setattr(animation, "BROADCAST_ROWS", few)
        canvas = animation.composite_frames(painted, moments)
        dealt = re.findall(r"hashpartitioning\(image_id#\d+L, y#\d+, x#\d+, (\d+)\), REPARTITION_BY_NUM", canvas._jdf.queryExecution().executedPlan().toString())
        assert [int(n) for n in dealt] == [math.ceil(len(want) / rows) + 1]
        got = [tuple(r) for r in animation.background_fill(canvas, moments, colours).select("image_id", "frame", "y", "x", *"rgba").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
