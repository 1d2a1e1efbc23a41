"""Views derived from the given tables, in SQL that Spark and DuckDB read alike.

Each view takes all rows of its table. Image sizes and values follow from keys, so that both
engines build the same pixels, headers, frames and events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelquarry.session import table


def _le(v: str, n: int) -> str:
    """Little-endian hex of a number."""
    h = f"lpad(hex(cast({v} as bigint)), {2 * n}, '0')"
    return " || ".join(f"substr({h}, {2 * k + 1}, 2)" for k in reversed(range(n)))


def _be(v: str, n: int) -> str:
    return f"lpad(hex(cast({v} as bigint)), {2 * n}, '0')"


_HEADERS = {
    0: f"'89504E470D0A1A0A0000000D49484452' || {_be('w', 4)} || {_be('h', 4)} || '08' || {_be('CASE k % 5 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 6 END', 1)} || '000000'",
    1: f"'424D' || '00000000' || '00000000' || '36000000' || '28000000' || {_le('w', 4)} || {_le('h', 4)} || '0100' || {_le('CASE WHEN k % 2 = 0 THEN 24 ELSE 32 END', 2)} || '00000000' || '000000000000000000000000'",
    2: f"'474946383961' || {_le('w', 2)} || {_le('h', 2)} || 'F70000'",
    3: f"'384250530001' || '000000000000' || '0003' || {_be('h', 4)} || {_be('w', 4)} || '00080003'",
    4: f"'5380F634' || repeat('00', 84) || '50494354' || {_be('w', 2)} || {_be('h', 2)} || '0000000000000000' || '000800' || {_be('CASE WHEN k % 2 = 0 THEN 224 ELSE 240 END', 1)}",
    5: f"'FFD8FFC0001108' || {_be('h', 2)} || {_be('w', 2)} || '03'",
    6: "'50360A' || hex(cast(w as varchar(20))) || '20' || hex(cast(h as varchar(20))) || '0A' || '3235350A'",
    7: "hex('#?RADIANCE') || '0A' || hex('FORMAT=32-bit_rle_rgbe') || '0A0A' || hex('-Y ') || hex(cast(h as varchar(20))) || hex(' +X ') || hex(cast(w as varchar(20))) || '0A'",
    8: f"'000002' || '0000000000' || '00000000' || {_le('w', 2)} || {_le('h', 2)} || '1820'",
    9: f"'52494646000000005745425056503820' || '64000000' || '500600' || '9D012A' || {_le('w', 2)} || {_le('h', 2)}",
    10: f"'5249464600000000574542505650384C' || '64000000' || '2F' || {_le('(w - 1) + (h - 1) * 16384', 4)}",
    11: f"'716F6966' || {_be('w', 4)} || {_be('h', 4)} || '0400'",
    12: f"'0A050108' || '00000000' || {_le('w - 1', 2)} || {_le('h - 1', 2)} || repeat('00', 53) || '03'",
}
def _text(text: str) -> str:
    return "'" + text.encode().hex().upper() + "'"


def _digits(v: str) -> str:
    return f"hex(cast({v} as varchar(20)))"


def _png(tail: str = "", length: str = "0000000D", depth: str = "08", ctype: str = "02", rest: str = "000000", w: str = "w") -> str:
    return f"'89504E470D0A1A0A{length}49484452' || {_be(w, 4)} || {_be('h', 4)} || '{depth}{ctype}{rest}00000000{tail}'"


def _chunk(kind: str, data: str) -> str:
    return f"{len(data) // 2:08X}{kind.encode().hex().upper()}{data}00000000"


def _bmp(size: int = 40, offset: int = 54, planes: int = 1, bpp: int = 24, packing: int = 0, masks: str = "", h: str = "h") -> str:
    part = lambda v, n: v.to_bytes(n, "little").hex().upper()
    head = f"'424D0000000000000000{part(offset, 4)}{part(size, 4)}' || "
    if size == 12:
        return head + f"{_le('w', 2)} || {_le('h', 2)} || '{part(planes, 2)}{part(bpp, 2)}'"
    return head + f"{_le('w', 4)} || {_le(h, 4)} || '{part(planes, 2)}{part(bpp, 2)}{part(packing, 4)}{'00' * 20}{'00' * (16 if size == 56 else 0)}{masks}'"


def _psd(version: str = "0001", channels: str = "0003", depth: str = "0008", mode: str = "0003") -> str:
    return f"'38425053{version}000000000000{channels}' || {_be('h', 4)} || {_be('w', 4)} || '{depth}{mode}'"


def _pic(packets: str) -> str:
    return f"'5380F634{'00' * 84}50494354' || {_be('w', 2)} || {_be('h', 2)} || '0000000000000000{packets}'"


def _jpeg(before: str = "", bits: str = "08", h: str = "h", w: str = "w", components: str = "03", mark: str = "FFD8") -> str:
    return f"'{mark}{before}FFC00011{bits}' || {_be(h, 2)} || {_be(w, 2)} || '{components}'"


def _vp8(tag: str = "A00000", mark: str = "9D012A") -> str:
    return f"'565038200A000000{tag}{mark}' || {_le('w', 2)} || {_le('h', 2)}"


def _vp8l(mark: str = "2F", version: int = 0) -> str:
    return f"'5650384C05000000{mark}' || {_le(f'(w - 1) + (h - 1) * 16384 + {version << 29}', 4)} || '00'"


_RIFF, _X, _ALPH = "'524946460000000057454250'", "'565038580A00000000000000000000000000'", "'414C504803000000414141' || '00'"
_APP = "FFE000104A464946000000000000000000000000"[: 4 * 2 + 28] + "FF" * 20 + "FFE1000400AA"
#: Files whose header stands behind other records or breaks one rule: (name, hex, format, width, height, channels, bits, reason). w and h follow from the key.
HEADERS = [
    ("png", _png(_chunk("PLTE", "00" * 6) + _chunk("tRNS", "00") + _chunk("IDAT", ""), ctype="03"), "png", "w", "h", 4, 8, None),
    ("png", _png(_chunk("IDAT", "") + _chunk("tRNS", "00" * 6)), "png", "w", "h", 3, 8, None),
    ("png", _png(_chunk("tEXt", "00" * 700) + _chunk("tRNS", "0000"), ctype="00"), "png", "w", "h", 2, 8, None),
    ("png", _png(length="0000000E"), "png", "w", "h", 3, 8, "bad IHDR len"),
    ("png", _png(depth="03"), "png", "w", "h", 3, 3, "1/2/4/8/16-bit only"),
    ("png", _png(ctype="07"), "png", "w", "h", 4, 8, "bad ctype"),
    ("png", _png(rest="010000"), "png", "w", "h", 3, 8, "bad comp method"),
    ("png", _png(rest="000100"), "png", "w", "h", 3, 8, "bad filter method"),
    ("png", _png(rest="000002"), "png", "w", "h", 3, 8, "bad interlace method"),
    ("png", _png(w="0"), "png", "0", "h", 3, 8, "0-pixel image"),
    ("bmp", _bmp(size=12, offset=26), "bmp", "w", "h", 3, 8, None),
    ("bmp", _bmp(planes=2), "bmp", "w", "h", 3, 8, "bad BMP"),
    ("bmp", _bmp(packing=1), "bmp", "w", "h", 3, 8, "BMP RLE"),
    ("bmp", _bmp(packing=4), "bmp", "w", "h", 3, 8, "BMP JPEG/PNG"),
    ("bmp", _bmp(packing=3), "bmp", "w", "h", 3, 8, "bad BMP"),
    ("bmp", _bmp(bpp=32, packing=3, offset=66, masks="FF000000" * 3), "bmp", "w", "h", 4, 8, "bad BMP"),
    ("bmp", _bmp(bpp=7, offset=118), "bmp", "w", "h", 3, 8, "bad bpp"),
    ("bmp", _bmp(offset=10), "bmp", "w", "h", 3, 8, "bad offset"),
    ("bmp", _bmp(bpp=8), "bmp", "w", "h", 3, 8, "invalid palette"),
    ("bmp", _bmp(bpp=32, packing=3, offset=66, masks="0000FF0000FF000000000000"), "bmp", "w", "h", 4, 8, "bad masks"),
    ("bmp", _bmp(h="4294967296 - h"), "bmp", "w", "h", 3, 8, None),
    ("bmp", _bmp(size=56, bpp=32, packing=3, offset=82, masks="0000FF0000FF0000FF000000"), "bmp", "w", "h", 4, 8, None),
    ("gif", f"'474946383761' || {_le('w', 2)} || {_le('h', 2)} || '000000'", "gif", "w", "h", 4, 8, None),
    ("psd", _psd(version="0002"), "psd", "w", "h", 4, 8, "wrong version"),
    ("psd", _psd(channels="0011"), "psd", "w", "h", 4, 8, "wrong channel count"),
    ("psd", _psd(depth="0004"), "psd", "w", "h", 4, 4, "unsupported bit depth"),
    ("psd", _psd(mode="0004"), "psd", "w", "h", 4, 8, "wrong color format"),
    ("pic", _pic("010800E000080010"), "pic", "w", "h", 4, 8, None),
    ("pic", _pic("010800E0" * 10 + "000800E0"), "pic", "w", "h", 3, 8, "too many packets"),
    ("pic", _pic("001000E0"), "pic", "w", "h", 3, 8, "bad packet size"),
    ("jpg", _jpeg(_APP), "jpeg", "w", "h", 3, 8, None),
    ("jpg", _jpeg(bits="0C"), "jpeg", "w", "h", 3, 12, "only 8-bit"),
    ("jpg", _jpeg(h="0"), "jpeg", "w", "0", 3, 8, "no header height"),
    ("jpg", _jpeg(w="0"), "jpeg", "0", "h", 3, 8, "0 width"),
    ("jpg", _jpeg(components="02"), "jpeg", "w", "h", 1, 8, "bad component count"),
    ("jpg", _jpeg(mark="FF" * 20 + "FFD8", components="01"), "jpeg", "w", "h", 1, 8, None),
    ("ppm", f"'50360A23' || repeat('79', 5000) || '0A' || {_digits('w')} || '20' || {_digits('h')} || '0A3235350A'", "pnm", "w", "h", 3, 8, None),
    ("pgm", f"'50350A' || {_digits('w')} || '20' || {_digits('h')} || '0A37303030300A'", "pnm", "w", "h", 1, 16, "max value > 65535"),
    ("pgm", f"'50350A3020' || {_digits('h')} || '0A3235350A'", "pnm", "0", "h", 1, 8, "invalid width"),
    ("hdr", _text("#?RADIANCE\nEXPOSURE=1\n\n-Y ") + f" || {_digits('h')} || " + _text(" +X ") + f" || {_digits('w')} || '0A'", "hdr", "w", "h", 3, 32, "unsupported format"),
    ("hdr", _text("#?RGBE\nFORMAT=32-bit_rle_rgbe\n\n+Y 2 +X 3\n"), "hdr", None, None, 3, 32, "unsupported data layout"),
    ("hdr", _text("#?RADIANCE\n# " + "x" * 5000 + "\nFORMAT=32-bit_rle_rgbe\n\n-Y ") + f" || {_digits('h')} || " + _text(" +X ") + f" || {_digits('w')} || '0A'", "hdr", "w", "h", 3, 32, None),
    ("tga", f"'000101' || '0000000018' || '00000000' || {_le('w', 2)} || {_le('h', 2)} || '0820'", "tga", "w", "h", 3, 8, "bad palette"),
    ("webp", f"{_RIFF} || {_X} || {_ALPH} || {_vp8()}", "webp", "w", "h", 4, 8, None),
    ("webp", f"{_RIFF} || {_X} || {_vp8l()}", "webp", "w", "h", 4, 8, None),
    ("webp", f"{_RIFF} || {_vp8('A10000')}", "webp", "w", "h", 4, 8, "VP8 inter frame"),
    ("webp", f"{_RIFF} || {_vp8('A80000')}", "webp", "w", "h", 4, 8, "VP8 profile"),
    ("webp", f"{_RIFF} || {_vp8('E0FFFF')}", "webp", "w", "h", 4, 8, "VP8 partition size"),
    ("webp", f"{_RIFF} || {_vp8(mark='9D012B')}", "webp", "w", "h", 4, 8, "VP8 signature"),
    ("webp", f"{_RIFF} || {_vp8l('00')}", "webp", "w", "h", 4, 8, "VP8L signature"),
    ("webp", f"{_RIFF} || {_vp8l(version=1)}", "webp", "w", "h", 4, 8, "VP8L version"),
    ("webp", f"{_RIFF} || {_X}", "webp", None, None, 4, 8, "no image record"),
    ("pcx", f"'0A05010800000000' || {_le('w - 1', 2)} || {_le('h - 1', 2)} || repeat('00', 53) || '02'", "pcx", "w", "h", 3, 8, "bad planes"),
    ("xbm", _text("#define i_width ") + f" || {_digits('w')} || " + _text("\n#define i_height ") + f" || {_digits('h')} || " + _text("\nstatic char i_bits[] = {0x00};\n"), "xbm", "w", "h", 3, 8, None),
    ("xpm", _text('/* XPM */\nstatic char *i[] = {\n"') + f" || {_digits('w')} || '20' || {_digits('h')} || " + _text(' 1 1",\n"a c #000000",\n'), "xpm", "w", "h", 3, 8, None),
    ("xbm", _text("#define i_width 0\n#define i_height 4\n"), "xbm", "0", "4", 3, 8, "invalid width"),
    ("png", "'89504E470D0A1A0A0000'", "png", None, None, 1, None, "truncated header"),
    ("bin", "'0123456789AB'", "unknown", None, None, None, None, "unknown image type"),
]
_EXT = "CASE k % 15 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate("png bmp gif psd pic jpg ppm hdr tga webp WBP qoi pcx xbm xpm".split())) + " END"

VIEWS = {
    "v_pixels": """
        SELECT CAST(floor(o_orderkey / 256) AS BIGINT) AS image_id, 0 AS frame, CAST(floor((o_orderkey % 256) / 16) AS INT) AS y,
          CAST(o_orderkey % 16 AS INT) AS x, CAST(o_custkey % 256 AS INT) AS r, CAST(CAST(floor(o_totalprice) AS BIGINT) % 256 AS INT) AS g,
          CAST((o_custkey * 7 + o_orderkey * 3) % 256 AS INT) AS b, CAST(CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 256 ELSE 255 END AS INT) AS a
        FROM orders""",
    "v_smooth": """
        SELECT image_id, frame, y, x, CAST((image_id * 7 + floor(x / 4) * 3 + floor(y / 2)) % 256 AS INT) AS r,
          CAST((image_id * 5 + floor(x / 2) + y) % 256 AS INT) AS g, CAST((image_id + floor(y / 4) * 40) % 256 AS INT) AS b,
          CAST(CASE WHEN (image_id + floor(y / 8)) % 6 = 0 THEN 0 ELSE 255 END AS INT) AS a
        FROM v_pixels""",
    "v_idx": "SELECT image_id, y, x, (r * 3 + g) % 300 AS idx FROM v_pixels",
    "v_plane": "SELECT image_id, y, x, g AS v FROM v_pixels",
    "v_files": "SELECT k AS file_id, path, CASE WHEN k % 7 = 3 THEN '00' || substr(hx, 3) WHEN k % 7 = 5 THEN substr(hx, 1, 20) ELSE hx END AS hx FROM (SELECT k, concat('img', CAST(k AS varchar(20)), '.', "
    + _EXT + ") AS path, CASE k % 13 " + " ".join(f"WHEN {k} THEN {v}" for k, v in _HEADERS.items())
    + " END AS hx FROM (SELECT p_partkey AS k, p_size + 1 AS w, p_partkey % 97 + CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE 1 END AS h FROM part) z) q",
    "v_headers": f"""
        SELECT k AS file_id, w, h, k % {len(HEADERS)} AS kind, concat('img', CAST(k AS varchar(20)), '.', CASE k % {len(HEADERS)} """ + " ".join(f"WHEN {i} THEN '{x[0]}'" for i, x in enumerate(HEADERS)) + f""" END) AS path,
          CASE k % {len(HEADERS)} """ + " ".join(f"WHEN {i} THEN {x[1]}" for i, x in enumerate(HEADERS)) + """ END AS hx
        FROM (SELECT p_partkey AS k, p_size + 1 AS w, p_partkey % 97 + 1 AS h FROM part) q""",
    "v_chunk_images": "SELECT p_partkey AS image_id, CAST(CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 6 END AS INT) AS ctype FROM part",
    "v_chunks": """
        SELECT image_id, chunk_no, type, CAST(chunk_no * 100 AS BIGINT) AS offset_, CAST(CASE type
            WHEN 'IHDR' THEN CASE WHEN image_id % 23 = 0 THEN 12 ELSE 13 END
            WHEN 'PLTE' THEN CASE image_id % 11 WHEN 0 THEN 771 WHEN 1 THEN 0 WHEN 2 THEN 7 ELSE (image_id % 30 + 1) * 3 END
            WHEN 'tRNS' THEN CASE image_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 6 ELSE image_id % 40 END
            WHEN 'IDAT' THEN CASE WHEN image_id % 29 = 0 THEN 1073741825 ELSE 100 END ELSE 9 END AS BIGINT) AS length
        FROM (SELECT k AS image_id, CAST(n AS INT) AS chunk_no, CASE
            WHEN n = 0 THEN CASE WHEN k % 9 = 0 THEN 'IDAT' WHEN k % 13 = 0 THEN 'CgBI' ELSE 'IHDR' END
            WHEN n = 1 THEN CASE WHEN k % 13 = 0 THEN 'IHDR' WHEN k % 4 = 0 THEN 'PLTE' WHEN k % 4 = 1 THEN 'tRNS' WHEN k % 4 = 2 THEN 'gAMA' WHEN k % 3 = 0 THEN 'IHDR' ELSE 'PLTE' END
            WHEN n = 2 THEN CASE k % 7 WHEN 0 THEN 'tRNS' WHEN 1 THEN 'PLTE' WHEN 2 THEN 'QUIX' ELSE 'tEXt' END
            WHEN n = 3 THEN CASE WHEN k % 6 = 0 THEN 'tRNS' WHEN k % 17 = 0 THEN 'IEND' ELSE 'IDAT' END
            WHEN n = 4 THEN CASE WHEN k % 8 = 0 THEN 'tRNS' ELSE 'IDAT' END
            ELSE CASE WHEN k % 19 = 0 THEN 'IDAT' ELSE 'IEND' END END AS type
          FROM (SELECT p_partkey AS k FROM part) p, (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) s) c""",
    "v_riff": """
        SELECT k AS image_id, CAST(n AS INT) AS chunk_no, CASE
            WHEN n = 0 THEN 'VP8X' WHEN n = 1 THEN CASE k % 3 WHEN 0 THEN 'ALPH' WHEN 1 THEN 'ICCP' ELSE 'VP8 ' END
            WHEN n = 2 THEN CASE k % 4 WHEN 0 THEN 'VP8 ' WHEN 1 THEN 'VP8L' ELSE 'EXIF' END ELSE CASE k % 5 WHEN 0 THEN 'ALPH' WHEN 1 THEN 'VP8L' ELSE 'XMP ' END END AS type
        FROM (SELECT p_partkey AS k FROM part) p, (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) s""",
    "v_packets": """
        SELECT CAST(floor(c_custkey / 4) AS BIGINT) AS image_id, CAST(c_custkey % 4 AS INT) AS packet_no,
          CAST(CASE c_custkey % 5 WHEN 0 THEN 224 WHEN 1 THEN 16 WHEN 2 THEN 128 WHEN 3 THEN 96 ELSE 64 END AS INT) AS channel,
          CAST((c_custkey * 31 + c_nationkey) % 256 AS INT) AS value FROM customer""",
    "v_frames": """
        SELECT image_id, CAST(frame AS INT) AS frame, CAST(event_id % 4 AS INT) AS dispose, CAST(10 * (floor(value) % 50) AS INT) AS delay_ms,
          CAST(image_id % 3 AS INT) AS bgindex, event_id FROM (
          SELECT user_id AS image_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events) q""",
    "v_frame_draws": """
        SELECT f.image_id, f.frame, CAST(floor(c.n / 4) AS INT) AS y, CAST(c.n % 4 AS INT) AS x, CAST(f.event_id % 256 AS INT) AS r,
          CAST((f.event_id + c.n) % 256 AS INT) AS g, CAST(c.n * 16 AS INT) AS b, CAST(CASE WHEN (f.event_id + c.n) % 7 = 0 THEN 0 ELSE 255 END AS INT) AS a
        FROM v_frames f, (""" + " UNION ALL ".join(f"SELECT {n} AS n" for n in range(16)) + """) c
        WHERE (f.event_id + c.n) % 3 = 0""",
    "v_pass": "SELECT image_id, CAST((y * 16 + x) % 7 AS INT) AS pass, CAST(floor(x / 4) AS INT) AS i, CAST(floor(y / 4) AS INT) AS j, r AS v FROM v_pixels",
    "v_view_events": """
        SELECT user_id AS session_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'down' WHEN 'view' THEN 'move' WHEN 'signup' THEN 'wheel'
            WHEN 'error' THEN 'up' ELSE 'mode' END AS kind, CAST(floor(value) % 81 - 40 AS INT) AS delta, CAST(floor(value * 3) % 640 AS INT) AS px,
          CAST(floor(value * 7) % 480 AS INT) AS py FROM events""",
}
ORDER = list(VIEWS)
TABLES = ("orders", "part", "customer", "events")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame."""
    for t in TABLES:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    for v in ORDER:
        # Spark's own words for what DuckDB calls by the same name
        spark.sql(VIEWS[v].replace("varchar(20)", "string")).createOrReplaceTempView(v)
        if v == name:
            break
    return spark.table(name)


def with_views(name: str, sql: str) -> str:
    """DuckDB: the query after the definitions of the views up to ``name``."""
    return "WITH " + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in ORDER[: ORDER.index(name) + 1]) + "\n" + sql
