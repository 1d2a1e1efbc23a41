"""Registered image queries against their DuckDB twins, and rules on small tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from pixelquarry.operators import catalogue, dither, palette
from pixelquarry.plans import registry

NAMES = sorted(registry.ORACLES)


def _rows(df):
    cols = sorted(df.columns)
    return sorted(tuple("NULL" if pd.isna(v) else str(float(v)) if not isinstance(v, (str, list, np.ndarray)) else str(list(v)) if not isinstance(v, str) else v for v in r) for r in df[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.execute(f"create view {f[:-8]} as select * from read_parquet('{sf_dir}/{f}')")
    ours, theirs = registry.QUERIES[name](spark, sf_dir).toPandas(), con.execute(registry.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert _rows(ours) == _rows(theirs)


@pytest.mark.parametrize("name", ["validate_header", "quarantine_good", "quarantine_bad", "failure_report", "corpus_summary"])
def test_header_twins_on_a_broken_lossless_file(spark, sf_dir, tmp_path, name):
    # a height of 0 turns the packed size of a lossless file negative, and so its version bits on
    for t in ("orders", "customer", "events"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{sf_dir}/{t}.parquet")
    duckdb.execute(f"copy (select 10670::BIGINT as p_partkey, p_size from read_parquet('{sf_dir}/part.parquet') limit 1) to '{tmp_path}/part.parquet' (format parquet)")
    ours = registry.QUERIES[name](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"create view part as select * from read_parquet('{tmp_path}/part.parquet')")
    for t in ("orders", "customer", "events"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet')")
    theirs = con.execute(registry.ORACLES[name]).df()
    assert _rows(ours) == _rows(theirs)
    if name == "quarantine_bad":
        assert [tuple(r) for r in ours.itertuples(index=False)] == [(10670, "VP8L version")]


def test_pnm_header_rules(spark):
    texts = [b"P6\n12 7\n255\n", b"P5 12 7", b"P6\n# note\n3 4\n65535\n", b"P6\n0 4\n255\n", b"P6\n3 4\n70000\n"]
    files = spark.createDataFrame([(i, f"{i}.ppm", bytearray(t)) for i, t in enumerate(texts)], "file_id long, path string, content binary")
    out = catalogue.validate_header(catalogue.probe_header(catalogue.sniff_format(files))).orderBy("file_id").collect()
    assert [(r.width, r.height, r.bits, r.reason) for r in out] == [
        (12, 7, 8, None), (12, 7, 8, None), (3, 4, 16, None), (0, 4, 8, "invalid width"), (3, 4, 16, "max value > 65535"),
    ]


def test_headers_behind_other_records(spark):
    be, le = (lambda v, n: v.to_bytes(n, "big")), (lambda v, n: v.to_bytes(n, "little"))
    frame = b"\xff\xc0\x00\x11\x08" + be(480, 2) + be(640, 2) + b"\x03"
    app = b"\xff\xe0" + be(16, 2) + b"JFIF\0" + bytes(9)
    png = lambda kind, *more: b"\x89PNG\r\n\x1a\n" + be(13, 4) + b"IHDR" + be(5, 4) + be(6, 4) + bytes([8, kind, 0, 0, 0]) + bytes(4) + b"".join(be(len(d), 4) + t + d + bytes(4) for t, d in more)
    riff = lambda *parts: b"RIFF" + bytes(4) + b"WEBP" + b"".join(t + le(len(d), 4) + d + b"\0" * (len(d) % 2) for t, d in parts)
    lossy = bytes(3) + b"\x9d\x01\x2a" + le(640, 2) + le(480, 2)
    pic = b"\x53\x80\xf6\x34" + bytes(84) + b"PICT" + be(640, 2) + be(480, 2) + bytes(8)
    files = [
        ("a.jpg", b"\xff\xd8" + app + b"\xff\xff" + b"\xff\xe1" + be(900, 2) + bytes(898) + frame, (640, 480, 3, 8, None)),
        ("b.jpg", b"\xff\xd8" + app, (None, None, 1, None, "truncated header")),
        ("c.png", png(3, (b"PLTE", bytes(6)), (b"tRNS", b"\0"), (b"IDAT", b"")), (5, 6, 4, 8, None)),
        ("d.png", png(2, (b"IDAT", b""), (b"tRNS", b"\0")), (5, 6, 3, 8, None)),
        ("e.png", png(0, (b"tRNS", b"\0\0")), (5, 6, 2, 8, None)),
        ("f.bmp", b"BM" + bytes(8) + le(26, 4) + le(12, 4) + le(640, 2) + le(480, 2) + le(1, 2) + le(24, 2) + bytes(8), (640, 480, 3, 8, None)),
        ("g.webp", riff((b"VP8X", bytes(10)), (b"ALPH", b"abc"), (b"VP8 ", lossy)), (640, 480, 4, 8, None)),
        ("h.webp", riff((b"VP8X", bytes(10)), (b"VP8L", b"\x2f" + le(639 | 479 << 14, 4))), (640, 480, 4, 8, None)),
        ("i.pic", pic + bytes([1, 8, 0, 0xE0, 0, 8, 0, 0x10]), (640, 480, 4, 8, None)),
        ("j.hdr", b"#?RADIANCE\n# " + b"x" * 300 + b"\nFORMAT=32-bit_rle_rgbe\n\n-Y 48 +X 64\n", (64, 48, 3, 32, None)),
        ("k.ppm", b"P6\n#" + b"y" * 2000 + b"\n12 7\n255\n", (12, 7, 3, 8, None)),
    ]
    frame_ = spark.createDataFrame([(i, n, bytearray(c)) for i, (n, c, _) in enumerate(files)], "file_id long, path string, content binary")
    out = catalogue.validate_header(catalogue.probe_header(catalogue.sniff_format(frame_))).orderBy("file_id").collect()
    assert [(r.width, r.height, r.channels, r.bits, r.reason) for r in out] == [x for _, _, x in files]


def test_jpeg_frame_rules(spark):
    be = lambda v, n: v.to_bytes(n, "big")

    def frame(*parts, bits=8, h=480, w=640, n=None, length=None, kind=0xC0, cut=None):
        """A file with one frame record; parts are (sampling factors, table) by component, cut is how many of their bytes are there."""
        entries = b"".join(bytes([k + 1, *part]) for k, part in enumerate(parts))
        n = len(parts) if n is None else n
        tail = b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00coded" if cut is None else b""
        return b"\xff\xd8\xff\xdb" + be(4, 2) + b"ab" + bytes([0xFF, kind]) + be(8 + 3 * n if length is None else length, 2) + bytes([bits]) + be(h, 2) + be(w, 2) + bytes([n]) + entries[:cut] + tail

    full = ((0x22, 0), (0x11, 1), (0x11, 1))
    files = [
        (frame((0x11, 0)), None), (frame(*full), None), (frame(*full, (0x22, 3), kind=0xC2), None), (frame((0x44, 0), (0x12, 1), (0x21, 1), kind=0xC1), None),
        (frame((0x01, 0)), "bad H"), (frame((0x51, 0)), "bad H"), (frame((0x11, 0), (0xF1, 1), (0x11, 1)), "bad H"),
        (frame((0x10, 0)), "bad V"), (frame((0x15, 0)), "bad V"), (frame((0x11, 0), (0x11, 1), (0x10, 1)), "bad V"),
        (frame((0x11, 4)), "bad TQ"), (frame((0x11, 0), (0x11, 1), (0x11, 255)), "bad TQ"),
        (frame((0x11, 9), (0x00, 0), (0x11, 0)), "bad TQ"), (frame((0x10, 0), (0x01, 0), (0x11, 0)), "bad V"),  # component by component
        (frame((0x31, 0), (0x21, 1), (0x11, 1)), "bad H"), (frame((0x11, 0), (0x12, 1), (0x13, 1)), "bad V"), (frame((0x33, 0), (0x11, 1), (0x31, 1)), None),  # whole fractions of the largest
        (frame((0x32, 0), (0x23, 1), (0x11, 1)), "bad V"), (frame((0x31, 0), (0x21, 1), (0x11, 4)), "bad TQ"),  # of each in turn, after the rest
        (frame(*full, length=10), "bad SOF len"), (frame(*full, length=0), "bad SOF len"), (frame(*full, length=14), "bad SOF len"), (frame((0x11, 0), length=17), "bad SOF len"),
        (frame(*full, length=10, bits=12), "bad SOF len"), (frame((0x01, 0), length=12), "bad SOF len"), (frame((0x01, 0), bits=12), "only 8-bit"), (frame((0x01, 0), h=0, w=0), "no header height"),
        (frame((0x01, 0), w=0), "0 width"), (frame((0x01, 0), (0x11, 0)), "bad component count"), (frame((0x01, 0), n=2, length=17), "bad component count"),
        *[(frame(*full, cut=k), None) for k in range(10)], (frame((0x11, 0), (0x51, 1), (0x11, 1), cut=4), None), (frame((0x11, 0), (0x51, 1), (0x11, 1), cut=5), "bad H"), (frame((0x11, 0), length=17, cut=1), "bad SOF len"),
    ]
    frame_ = spark.createDataFrame([(i, f"{i}.jpg", bytearray(c)) for i, (c, _) in enumerate(files)], "file_id long, path string, content binary")
    out = catalogue.validate_header(catalogue.probe_header(catalogue.sniff_format(frame_))).orderBy("file_id").collect()
    assert [(r.file_id, r.reason) for r in out] == [(i, reason) for i, (_, reason) in enumerate(files)]


def _dithered(rows, choose):
    """Pixel by pixel in raster order: each share of the error is floored before it is added."""
    h, w = len(rows), len(rows[0])
    acc, out = [[[v * 16 for v in p] for p in row] for row in rows], [[None] * w for _ in range(h)]
    for y in range(h):
        for x in range(w):
            got = out[y][x] = choose([v >> 4 for v in acc[y][x]])
            for c, v in enumerate(acc[y][x]):
                err = v - got[c] * 16
                for dx, dy, n in ((1, 0, 4), (2, 0, 1), (-1, 1, 2), (0, 1, 4), (1, 1, 2), (0, 2, 1)):
                    if 0 <= x + dx < w and y + dy < h:
                        acc[y + dy][x + dx][c] += err * n >> 4
    return out


def test_dithering_matches_a_scalar_walk(spark):
    rng = np.random.default_rng(2)
    images = [rng.integers(0, 256, (h, w, 3)).tolist() for h, w in ((1, 9), (7, 1), (6, 11))]
    rows = [(i, 0, y, x, *p) for i, im in enumerate(images) for y, row in enumerate(im) for x, p in enumerate(row)]
    pixels = spark.createDataFrame(rows, "image_id long, frame int, y int, x int, r int, g int, b int")
    for name in ("vga16", "win256"):
        entries = palette.PALETTES[name]

        def nearest(v, entries=entries):
            key = [min(255, max(0, c)) >> 3 << 3 for c in v]
            return entries[min((i for i in range(len(entries)) if i != 246), key=lambda i: (sum(k * (a - b) ** 2 for k, a, b in zip((2, 4, 3), key, entries[i])), i))]

        want = {(i, y, x): tuple(p) for i, im in enumerate(images) for y, row in enumerate(_dithered(im, nearest)) for x, p in enumerate(row)}
        got = dither.dither_palette(pixels, name).collect()
        assert {(r.image_id, r.y, r.x): (r.r, r.g, r.b) for r in got} == want and all(tuple(entries[r.idx]) == (r.r, r.g, r.b) and r.idx != 246 for r in got)
    grey = [[[[77 * p[0] + 151 * p[1] + 28 * p[2] >> 8] for p in row] for row in im] for im in images]
    want = {(i, y, x): p[0] for i, im in enumerate(grey) for y, row in enumerate(_dithered(im, lambda v: [255 if v[0] > 127 else 0])) for x, p in enumerate(row)}
    assert {(r.image_id, r.y, r.x): r.v for r in dither.dither_mono(pixels).collect()} == want
    assert dither.dither_corpus(pixels, 1, 24).count() == dither.dither_corpus(pixels, 0).count() == len(rows)
    assert {r.r for r in dither.dither_corpus(pixels, 1, 1).collect()} <= {0, 255}
