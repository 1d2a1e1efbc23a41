"""All registered queries and their DuckDB twins, by operator.

A query reads a derived view of the given tables (``fixtures``), applies one operator and returns
its full result. The SQL twins are written on their own, from the operator's meaning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelquarry.functions import color as C
from pixelquarry.operators import animation, catalogue, dither, events, palette, pixels, resample, sequence
from pixelquarry.plans import fixtures
from pixelquarry.session import table
from pixelquarry.sources import images, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AT = ["image_id", "y", "x"]
AT_SQL = "image_id, y, x"


def add(name: str, view: str, run: Callable[[DataFrame], DataFrame], sql: str | None = None, needs: str | None = None) -> None:
    """Register an operator over a view; ``needs`` is the last view that the SQL names, if another."""
    QUERIES[name] = lambda spark, sf_dir: run(fixtures.view(spark, sf_dir, view))
    if sql:
        ORACLES[name] = fixtures.with_views(needs or view, sql)


def scalar(name: str, view: str, columns: Callable[[], dict], sql: str) -> None:
    """Register column functions: one row per pixel."""
    add(name, view, lambda df: df.select(*AT, *[c.alias(n) for n, c in columns().items()]), f"SELECT {AT_SQL}, {sql} FROM {view}")


def pal_sql(name: str = "win256") -> str:
    return "(VALUES " + ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(palette.PALETTES[name])) + ") AS p(idx, pr, pg, pb)"


# column functions

scalar("luma8", "v_pixels", lambda: {"v": C.luma8("r", "g", "b")}, "(77 * r + 150 * g + 29 * b) >> 8 AS v")
scalar("luma16", "v_pixels", lambda: {"v": C.luma16(F.col("r") * 257, F.col("g") * 257, F.col("b") * 257)}, "(77 * 257 * r + 150 * 257 * g + 29 * 257 * b) >> 8 AS v")
scalar("luma_mono", "v_pixels", lambda: {"v": C.luma_mono("r", "g", "b")}, "(77 * r + 151 * g + 28 * b) >> 8 AS v")
scalar(
    "convert_channels", "v_pixels",
    lambda: {f"c{n}{m}_{k}": c for n, ch in ((1, "r"), (2, "ra"), (3, "rgb"), (4, "rgba")) for m in (1, 2, 3, 4) for k, c in enumerate(C.convert_channels(list(ch), n, m))},
    ", ".join(
        f"{v} AS c{n}{m}_{k}"
        for n in (1, 2, 3, 4) for m in (1, 2, 3, 4)
        for grey in ["r" if n <= 2 else "(77 * r + 150 * g + 29 * b) >> 8"] for alpha in ["a" if n in (2, 4) else "255"]
        for k, v in enumerate(([grey, alpha] if m <= 2 else (["r", "r", "r"] if n <= 2 else ["r", "g", "b"]) + [alpha])[:m])
    ),
)
scalar(
    "convert_channels16", "v_pixels",
    lambda: {f"c{n}{m}_{k}": c for n, ch in ((1, "r"), (2, "ra"), (3, "rgb"), (4, "rgba")) for m in (1, 2, 3, 4) for k, c in enumerate(C.convert_channels([F.col(x) * 257 for x in ch], n, m, 65535))},
    ", ".join(
        f"{v} AS c{n}{m}_{k}"
        for n in (1, 2, 3, 4) for m in (1, 2, 3, 4)
        for grey in ["r * 257" if n <= 2 else "(77 * 257 * r + 150 * 257 * g + 29 * 257 * b) >> 8"] for alpha in ["a * 257" if n in (2, 4) else "65535"]
        for k, v in enumerate(([grey, alpha] if m <= 2 else (["r * 257"] * 3 if n <= 2 else ["r * 257", "g * 257", "b * 257"]) + [alpha])[:m])
    ),
)
scalar("depth_8_16", "v_pixels", lambda: {"up": C.to_16bit("r"), "down": C.to_8bit(F.col("g") * 256 + F.col("b"))}, "(r << 8) + r AS up, (g * 256 + b) >> 8 AS down")
scalar("scale_bits", "v_pixels", lambda: {f"d{d}": C.scale_bits(F.col("r") % (1 << d), d) for d in (1, 2, 4, 8)}, "r % 2 * 255 AS d1, r % 4 * 85 AS d2, r % 16 * 17 AS d4, r % 256 AS d8")
scalar(
    "expand_bits", "v_pixels", lambda: {f"b{n}": C.expand_bits(F.col("r") % (1 << n), n) for n in range(1, 9)},
    ", ".join(f"((r % {1 << n}) * {m}) >> {s} AS b{n}" for n, m, s in ((1, 255, 0), (2, 85, 0), (3, 73, 1), (4, 17, 0), (5, 33, 2), (6, 65, 4), (7, 129, 6), (8, 1, 0))),
)
scalar(
    "rgb555", "v_pixels", lambda: dict(zip(("r5", "g5", "b5"), C.rgb555((F.col("r") % 128) * 256 + F.col("g")), strict=True)),
    ", ".join(f"((((r % 128) * 256 + g) >> {s}) & 31) * 255 // 31 AS {n}" for n, s in (("r5", 10), ("g5", 5), ("b5", 0))),
)
scalar(
    "mask_extract", "v_pixels", lambda: {f"m{m}": C.mask_extract(F.col("r") * 256 + F.col("g"), m) for m in (0x7C00, 0x3E0, 0x1F, 0xF0, 0)},
    "((((r * 256 + g) & 31744) >> 10) * 33) >> 2 AS m31744, ((((r * 256 + g) & 992) >> 5) * 33) >> 2 AS m992, (((r * 256 + g) & 31) * 33) >> 2 AS m31, ((g & 240) >> 4) * 17 AS m240, 0 AS m0",
)
scalar("ldr_to_hdr", "v_plane", lambda: {"f": F.round(C.ldr_to_hdr("v"), 6)}, "round(power(v / 255.0::DOUBLE, 2.2::DOUBLE), 6) AS f")
scalar("hdr_to_ldr", "v_plane", lambda: {"v8": C.hdr_to_ldr(F.col("v") / 200.0)}, "least(255, greatest(0, floor(power(v / 200.0::DOUBLE, 1 / 2.2::DOUBLE) * 255 + 0.5)))::INT AS v8")
scalar("rgbe_to_float", "v_pixels", lambda: {"f": F.round(C.rgbe_to_float("r", F.when(F.col("x") == 0, 0).otherwise(F.col("g") % 32 + 120)), 6)}, "round(CASE WHEN x = 0 THEN 0.0 ELSE r * power(2.0::DOUBLE, g % 32 + 120 - 136) END, 6) AS f")
_K = [int(k * 4096.0 + 0.5) << 8 for k in (1.402, 0.71414, 0.34414, 1.772)]
scalar(
    "ycbcr_to_rgb", "v_pixels", lambda: dict(zip(("jr", "jg", "jb"), C.ycbcr_to_rgb("r", "g", "b"), strict=True)),
    f"least(255, greatest(0, ((r::BIGINT << 20) + 524288 + (b - 128)::BIGINT * {_K[0]}) >> 20)) AS jr, least(255, greatest(0, ((r::BIGINT << 20) + 524288 - (b - 128)::BIGINT * {_K[1]} + (((g - 128)::BIGINT * -{_K[2]}) & -65536)) >> 20)) AS jg, least(255, greatest(0, ((r::BIGINT << 20) + 524288 + (g - 128)::BIGINT * {_K[3]}) >> 20)) AS jb",
)
scalar(
    "yuv_to_rgb", "v_pixels", lambda: dict(zip(("vr", "vg", "vb"), C.yuv_to_rgb("r", "g", "b"), strict=True)),
    "least(255, greatest(0, (((r * 19077) >> 8) + ((b * 26149) >> 8) - 14234) >> 6)) AS vr, least(255, greatest(0, (((r * 19077) >> 8) - ((g * 6419) >> 8) - ((b * 13320) >> 8) + 8708) >> 6)) AS vg, least(255, greatest(0, (((r * 19077) >> 8) + ((g * 33050) >> 8) - 17685) >> 6)) AS vb",
)
_prod = lambda x, k: f"((({x}) * {k} + 128) + ((({x}) * {k} + 128) >> 8)) >> 8"
scalar("cmyk_to_rgb", "v_pixels", lambda: dict(zip(("cr", "cg", "cb"), C.cmyk_to_rgb("r", "g", "b", "a"), strict=True)), ", ".join(f"{_prod(c, 'a')} AS c{c}" for c in "rgb"))
_ycc = [
    f"least(255, greatest(0, ((r::BIGINT << 20) + 524288 + (b - 128)::BIGINT * {_K[0]}) >> 20))",
    f"least(255, greatest(0, ((r::BIGINT << 20) + 524288 - (b - 128)::BIGINT * {_K[1]} + (((g - 128)::BIGINT * -{_K[2]}) & -65536)) >> 20))",
    f"least(255, greatest(0, ((r::BIGINT << 20) + 524288 + (g - 128)::BIGINT * {_K[3]}) >> 20))",
]
scalar("ycck_to_rgb", "v_pixels", lambda: dict(zip(("kr", "kg", "kb"), C.ycck_to_rgb("r", "g", "b", "a"), strict=True)), ", ".join(_prod(f"255 - {v}", "a") + f" AS k{c}" for c, v in zip("rgb", _ycc, strict=True)))
scalar(
    "jpeg_color_model", "v_pixels",
    lambda: {"model": C.jpeg_color_model(F.when(F.col("x") == 0, "RGB").otherwise("123"), F.col("y") % 5, F.col("x") % 4 - 1, F.col("x") > 8)},
    "CASE WHEN y % 5 = 3 AND (x = 0 OR (x % 4 - 1 = 0 AND NOT x > 8)) THEN 'rgb' WHEN y % 5 = 3 THEN 'ycbcr' WHEN y % 5 = 4 AND x % 4 - 1 = 0 THEN 'cmyk' WHEN y % 5 = 4 AND x % 4 - 1 = 2 THEN 'ycck' WHEN y % 5 = 4 THEN 'ycbcr' ELSE 'grey' END AS model",
)
scalar("unpremultiply", "v_pixels", lambda: {"u": C.unpremultiply("r", "a")}, "CASE WHEN a > 0 THEN ((r * 255 + a // 2) // a) % 256 ELSE r END AS u")
scalar("remove_white_matte", "v_pixels", lambda: {"m": C.remove_white_matte("r", "a")}, "CASE WHEN a <> 0 AND a <> 255 THEN trunc(r / (a / 255.0::DOUBLE) + 255 * (1 - 1 / (a / 255.0::DOUBLE)))::INT ELSE r END AS m")
scalar("color_key_alpha", "v_smooth", lambda: {"k": C.color_key_alpha(["r", "g"], [7, 5])}, "CASE WHEN r = 7 AND g = 5 THEN 0 ELSE 255 END AS k")
scalar("clamp_byte", "v_pixels", lambda: {"c": C.clamp_byte(F.col("r") * 2 - 100)}, "least(255, greatest(0, r * 2 - 100)) AS c")
scalar("bucket_distance", "v_pixels", lambda: {"k": C.bucket5("r"), "d": C.color_distance(["r", "g", "b"], [10, 20, 30])}, "r >> 3 AS k, 2 * (r - 10) * (r - 10) + 4 * (g - 20) * (g - 20) + 3 * (b - 30) * (b - 30) AS d")
scalar("slot_hash", "v_pixels", lambda: {"s": C.slot_hash("r", "g", "b", "a")}, "(3 * r + 5 * g + 7 * b + 11 * a) & 63 AS s")
scalar("cache_hash", "v_pixels", lambda: {"h": C.cache_hash(((F.col("a").cast("long") * 256 + F.col("r")) * 256 + F.col("g")) * 256 + F.col("b"), 8)}, "((506832829::HUGEINT * (((a::BIGINT * 256 + r) * 256 + g) * 256 + b)) % 4294967296)::BIGINT >> 24 AS h")
scalar("green_decorrelate", "v_pixels", lambda: dict(zip(("dr", "dg", "db"), C.green_decorrelate("r", "g", "b"), strict=True)), "(r - g + 256) % 256 AS dr, g AS dg, (b - g + 256) % 256 AS db")
scalar("green_correlate", "v_pixels", lambda: dict(zip(("dr", "dg", "db"), C.green_correlate("r", "g", "b"), strict=True)), "(r + g) % 256 AS dr, g AS dg, (b + g) % 256 AS db")
scalar("paeth", "v_pixels", lambda: {"p": C.paeth("r", "g", "b")}, "CASE WHEN abs(g - b) <= abs(r - b) AND abs(g - b) <= abs(r + g - 2 * b) THEN r WHEN abs(r - b) <= abs(r + g - 2 * b) THEN g ELSE b END AS p")
scalar("default_channel", "v_pixels", lambda: {"c": C.default_channel(F.when(F.col("x") > 3, F.col("r")), "color"), "al": C.default_channel(F.when(F.col("x") > 3, F.col("a")), "alpha")}, "CASE WHEN x > 3 THEN r ELSE 0 END AS c, CASE WHEN x > 3 THEN a ELSE 255 END AS al")
scalar("linear_pixels", "v_plane", lambda: {"f": F.round(C.linear_pixels(F.col("v") * 257, 16), 6)}, "round(power(v / 255.0::DOUBLE, 2.2::DOUBLE), 6) AS f")
# a corpus of 8-bit, 16-bit and shared-exponent images
_depth = lambda: F.when(F.col("image_id") % 3 == 0, 32).when(F.col("image_id") % 3 == 1, 16).otherwise(8)
_exponent = lambda: F.when(F.col("x") == 0, 0).otherwise(F.col("a") % 32 + 120)
scalar(
    "linear_corpus", "v_pixels",
    lambda: dict(zip(("lr", "lg", "lb"), [F.round(v, 6) for v in C.linear_rgb(*[F.when(_depth() == 16, F.col(c) * 257).otherwise(F.col(c)) for c in "rgb"], _exponent(), _depth())], strict=True)),
    ", ".join(f"round(CASE WHEN image_id % 3 = 0 THEN CASE WHEN x = 0 THEN 0.0 ELSE {c} * power(2.0::DOUBLE, a % 32 + 120 - 136) END ELSE power({c} / 255.0::DOUBLE, 2.2::DOUBLE) END, 6) AS l{c}" for c in "rgb"),
)
scalar("rgbe_grey", "v_pixels", lambda: {"f": F.round(C.rgbe_grey("r", "g", "b", _exponent()), 6)}, "round(CASE WHEN x = 0 THEN 0.0 ELSE (r + g + b) * power(2.0::DOUBLE, a % 32 + 120 - 136) END / 3, 6) AS f")
scalar(
    "masked_rgba", "v_pixels", lambda: dict(zip([f"{c}{n}" for n in (16, 32) for c in "rgba"], [*C.masked_rgba(F.col("r") * 256 + F.col("g"), 16), *C.masked_rgba(((F.col("a").cast("long") * 256 + F.col("r")) * 256 + F.col("g")) * 256 + F.col("b"), 32)], strict=True)),
    ", ".join(f"((((r * 256 + g) >> {k}) & 31) * 33) >> 2 AS {c}16" for c, k in (("r", 10), ("g", 5), ("b", 0))) + ", 255 AS a16, r AS r32, g AS g32, b AS b32, a AS a32",
)
scalar("raster_place", "v_pixels", lambda: dict(zip(("py", "px"), C.raster_place(C.raster_order("y", "x", F.lit(16)), 16), strict=True)), "y AS py, x AS px")
scalar("component_dims", "v_pixels", lambda: dict(zip(("cw", "ch"), pixels.component_dims("r", "g", (1, 2), (4, 3)), strict=True)), "(r + 3) // 4 AS cw, (g * 2 + 2) // 3 AS ch")
scalar("alpha_plane", "v_pixels", lambda: {"al": C.alpha_plane(F.when(F.col("x") == 1, F.col("g")), F.when(F.col("x") == 2, F.col("a")))}, "CASE WHEN x = 1 THEN g WHEN x = 2 THEN a ELSE 255 END AS al")
scalar("clamp_offset", "v_pixels", lambda: {"o": pixels.clamp_offset(F.col("r") - 50, F.col("g"), F.lit(100))}, "least(greatest(0, r - 50), greatest(0, g - 100)) AS o")
scalar("raster_order", "v_pixels", lambda: {"pos": C.raster_order("y", "x", F.lit(16))}, "y * 16 + x AS pos")
scalar("plane_dims", "v_pixels", lambda: dict(zip(("pw", "ph"), pixels.plane_dims("r", "g"), strict=True)), "(r + 1) // 2 AS pw, (g + 1) // 2 AS ph")

# palettes

LUT_SQL = f"""lut AS (SELECT kr, kg, kb, arg_min(idx, (2 * (kr * 8 - pr) ** 2 + 4 * (kg * 8 - pg) ** 2 + 3 * (kb * 8 - pb) ** 2) * 1000 + idx) AS idx
  FROM (SELECT range AS kr FROM range(32)), (SELECT range AS kg FROM range(32)), (SELECT range AS kb FROM range(32)), {pal_sql()}
  WHERE idx <> 246 GROUP BY ALL)"""
QUANT_SQL = f""", {LUT_SQL}, quant AS (
  SELECT v.*, p.idx, pr AS qr, pg AS qg, pb AS qb FROM v_pixels v JOIN lut ON r >> 3 = kr AND g >> 3 = kg AND b >> 3 = kb JOIN {pal_sql()} ON lut.idx = p.idx)"""
quantized = lambda df: palette.quantize_lut(df, "win256")
add("quantize_lut", "v_pixels", lambda df: quantized(df).select(*AT, "idx", "qr", "qg", "qb"), QUANT_SQL + f"SELECT {AT_SQL}, idx, qr, qg, qb FROM quant")
add("palette_usage", "v_pixels", lambda df: palette.palette_usage(quantized(df)), QUANT_SQL + "SELECT image_id, idx, count(*) AS pixels FROM quant GROUP BY ALL")
add(
    "quantization_error", "v_pixels", lambda df: palette.quantization_error(quantized(df)).select("image_id", *[f"sum_{c}" for c in "rgb"], F.round("avg_r", 6).alias("avg_r")),
    QUANT_SQL + "SELECT image_id, sum((r - qr) * 16)::BIGINT AS sum_r, sum((g - qg) * 16)::BIGINT AS sum_g, sum((b - qb) * 16)::BIGINT AS sum_b, round(avg((r - qr) * 16), 6) AS avg_r FROM quant GROUP BY image_id",
)
QUERIES["build_color_lut"] = lambda spark, sf_dir: palette.build_color_lut(spark, "win256").join(  # all cells, with the pixels that fall into each
    fixtures.view(spark, sf_dir, "v_pixels").groupBy(*[C.bucket5(c).alias(f"k{c}") for c in "rgb"]).agg(F.count(F.lit(1)).alias("pixels")), ["kr", "kg", "kb"], "left"
).fillna(0, ["pixels"])
ORACLES["build_color_lut"] = fixtures.with_views("v_pixels", f", {LUT_SQL}, n AS (SELECT r >> 3 AS kr, g >> 3 AS kg, b >> 3 AS kb, count(*) AS pixels FROM v_pixels GROUP BY 1, 2, 3) SELECT lut.*, coalesce(pixels, 0) AS pixels FROM lut LEFT JOIN n USING (kr, kg, kb)")
for _name in ("vga16", "win256"):
    add(
        f"nearest_{_name}", "v_pixels", lambda df, n=_name: palette.nearest_palette_color(df.select("r", "g", "b").distinct(), palette.PALETTES[n]),
        f"SELECT r, g, b, arg_min(idx, (2 * (r - pr) ** 2 + 4 * (g - pg) ** 2 + 3 * (b - pb) ** 2) * 1000 + idx) AS idx FROM (SELECT DISTINCT r, g, b FROM v_pixels), {pal_sql(_name)} WHERE idx <> 246 GROUP BY ALL",
    )
for _policy, _zero in (("zero", ("0", "0", "0", "255")), ("transparent", ("0", "0", "0", "0")), ("strict", ("NULL",) * 4)):
    add(
        f"palette_lookup_{_policy}", "v_idx", lambda df, p=_policy: palette.palette_lookup(df, palette.palette(df.sparkSession, "win256"), p).select(*AT, "idx", *"rgba"),
        f"SELECT {AT_SQL}, v.idx, " + ", ".join(f"coalesce({c}, {z}) AS {n}" for n, c, z in zip("rgba", ("pr", "pg", "pb", "CASE WHEN p.idx IS NOT NULL THEN 255 END"), _zero, strict=True)) + f" FROM v_idx v LEFT JOIN {pal_sql()} ON v.idx = p.idx",
    )
add("distinct_colors", "v_smooth", palette.distinct_colors, "SELECT *, CASE WHEN colors > 16 THEN 8 WHEN colors > 4 THEN 4 WHEN colors > 2 THEN 2 ELSE 1 END AS bits FROM (SELECT image_id, count(DISTINCT (r, g, b)) AS colors FROM v_smooth GROUP BY 1)")
add("color_bucket_histogram", "v_pixels", palette.color_bucket_histogram, "SELECT r >> 3 AS kr, g >> 3 AS kg, b >> 3 AS kb, count(*) AS pixels FROM v_pixels GROUP BY ALL")
_cells = lambda df: df.select(*AT, F.concat_ws("", F.char(65 + F.col("r") % 20), F.char(97 + F.col("g") % 3)).alias("key"))
_colors = lambda df: df.where("y < 4").select("image_id", F.concat_ws("", F.char(65 + F.col("r") % 20), F.char(97 + F.col("g") % 3)).alias("key"), C.raster_order("y", "x", F.lit(16)).alias("pos"), F.col("b").alias("color"))
XPM_SQL = ", cells AS (SELECT image_id, y, x, chr(65 + r % 20) || chr(97 + g % 3) AS key FROM v_pixels), colors AS (SELECT image_id, chr(65 + r % 20) || chr(97 + g % 3) AS key, y * 16 + x AS pos, b AS color FROM v_pixels WHERE y < 4)"
add("xpm_key_join", "v_pixels", lambda df: palette.xpm_key_join(_cells(df), _colors(df)), XPM_SQL + " SELECT c.*, k.color FROM cells c LEFT JOIN (SELECT image_id, key, arg_min(color, pos) AS color FROM colors GROUP BY 1, 2) k USING (image_id, key)")
add("unmatched_keys", "v_pixels", lambda df: palette.unmatched_keys(_cells(df), _colors(df)), XPM_SQL + " SELECT * FROM cells WHERE (image_id, key) NOT IN (SELECT (image_id, key) FROM colors)")
scalar("cga_index", "v_idx", lambda: {"i": palette.cga_index(F.col("idx") % 4, 0x50, 0x60)}, "CASE WHEN idx % 4 = 0 THEN 5 ELSE (idx % 4) * 2 + 1 + 8 END AS i")
add(
    "cga_lookup", "v_idx",
    lambda df: palette.cga_lookup(df.withColumn("idx", F.col("idx") % 4), df.select("image_id", (F.col("image_id") % 256).alias("background"), (F.col("image_id") * 37 % 256).alias("flags")).distinct()).select(*AT, "idx", *"rgba"),
    f", c AS (SELECT image_id, y, x, CASE WHEN idx % 4 = 0 THEN (image_id % 256) >> 4 ELSE (idx % 4) * 2 + ((image_id * 37 % 256 >> 6) & 1) + ((image_id * 37 % 256 >> 5) & 1) * 8 END::INT AS i FROM v_idx) "
    f"SELECT {AT_SQL}, i AS idx, pr AS r, pg AS g, pb AS b, 255 AS a FROM c JOIN {pal_sql('cga16')} ON p.idx = i",
)
add(
    "palette_alpha", "v_idx", lambda df: palette.palette_lookup(df, palette.palette(df.sparkSession, "win256").withColumn("a", F.col("idx") * 7 % 256)).select(*AT, "idx", *"rgba"),
    f"SELECT {AT_SQL}, v.idx, coalesce(pr, 0) AS r, coalesce(pg, 0) AS g, coalesce(pb, 0) AS b, CASE WHEN pr IS NULL THEN 0 ELSE v.idx * 7 % 256 END AS a FROM v_idx v LEFT JOIN {pal_sql()} ON p.idx = v.idx",
)

# pixels

add("alpha_presence", "v_smooth", lambda df: pixels.alpha_presence(df).select(*AT, "a"), f"SELECT {AT_SQL}, CASE WHEN max(a) OVER (PARTITION BY image_id) = 0 THEN 255 ELSE a END AS a FROM v_smooth")
add("channel_mask", "v_packets", pixels.channel_mask, "SELECT *, CASE WHEN mask & 16 <> 0 THEN 4 ELSE 3 END AS channels FROM (SELECT image_id, bit_or(channel) AS mask FROM v_packets GROUP BY 1)")
add(
    "composite_channels", "v_packets", lambda df: pixels.composite_channels(df).select("image_id", "packet_no", *"rgba"),
    "SELECT image_id, packet_no, " + ", ".join(f"coalesce(last_value(CASE WHEN channel & {bit} <> 0 THEN value END IGNORE NULLS) OVER w, 255) AS {c}" for c, bit in (("r", 128), ("g", 64), ("b", 32), ("a", 16)))
    + " FROM v_packets WINDOW w AS (PARTITION BY image_id ORDER BY packet_no ROWS UNBOUNDED PRECEDING)",
)
add("assemble_scanlines", "v_pixels", lambda df: pixels.assemble_scanlines(df).select("image_id", "frame", "y", *[F.array_join(c, ",").alias(c) for c in "rgba"]), "SELECT image_id, frame, y, " + ", ".join(f"string_agg({c}, ',' ORDER BY x) AS {c}" for c in "rgba") + " FROM v_pixels GROUP BY 1, 2, 3")
add("touched_extent", "v_frame_draws", pixels.touched_extent, "SELECT image_id, frame, count(*) AS touched, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM v_frame_draws GROUP BY 1, 2")
add(
    "canvas_check", "v_frame_draws", lambda df: pixels.touched_extent(df, df.select("image_id").distinct().select("image_id", F.lit(4).alias("w"), (F.col("image_id") % 5).alias("h"))),
    "SELECT image_id, frame, count(*) AS touched, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, max(y) < image_id % 5 AS fit FROM v_frame_draws GROUP BY 1, 2",
)
add("flip_vertical", "v_pixels", lambda df: pixels.flip_vertical(df, 16).select(*AT, "r"), "SELECT image_id, 15 - y AS y, x, r FROM v_pixels")
add("crop_viewport", "v_pixels", lambda df: pixels.crop_viewport(df, 3, 5, 8, 40).select(*AT, "r"), "SELECT image_id, y - 5 AS y, x - 3 AS x, r FROM v_pixels WHERE x BETWEEN 3 AND 10 AND y BETWEEN 5 AND 44")
add("deinterlace_adam7", "v_pass", lambda df: pixels.deinterlace_adam7(df).select("image_id", "pass", "x", "y", "v"), "SELECT image_id, pass, i * CASE WHEN pass < 2 THEN 8 WHEN pass < 4 THEN 4 WHEN pass < 6 THEN 2 ELSE 1 END + CASE pass WHEN 1 THEN 4 WHEN 3 THEN 2 WHEN 5 THEN 1 ELSE 0 END AS x, j * CASE WHEN pass < 3 THEN 8 WHEN pass < 5 THEN 4 ELSE 2 END + CASE pass WHEN 2 THEN 4 WHEN 4 THEN 2 WHEN 6 THEN 1 ELSE 0 END AS y, v FROM v_pass")
add("deinterlace_gif_rows", "v_pixels", lambda df: pixels.deinterlace_gif_rows(df.withColumnRenamed("y", "seq_row"), 16).select("image_id", "y", "x", "r"), "SELECT image_id, CASE WHEN y < 2 THEN y * 8 WHEN y < 4 THEN (y - 2) * 8 + 4 WHEN y < 8 THEN (y - 4) * 4 + 2 ELSE (y - 8) * 2 + 1 END AS y, x, r FROM v_pixels")
add("swap_rb", "v_pixels", lambda df: pixels.swap_rb(df).select(*AT, "r", "b"), f"SELECT {AT_SQL}, b AS r, r AS b FROM v_pixels")
add("tile_pixels", "v_pixels", lambda df: pixels.tile_pixels(df, 2).withColumn("mean", F.round("mean", 6)), "SELECT image_id, x >> 2 AS tx, y >> 2 AS ty, round(avg((77 * r + 150 * g + 29 * b) >> 8), 6) AS mean, min((77 * r + 150 * g + 29 * b) >> 8) AS low, max((77 * r + 150 * g + 29 * b) >> 8) AS high, count(*) AS pixels FROM v_pixels GROUP BY 1, 2, 3")
add(
    "tile_join", "v_pixels", lambda df: pixels.tile_join(df, df.where("y < 4 and x < 4").select("image_id", (F.col("y") * 4 + F.col("x")).alias("tile"), F.col("b").alias("attr")), 2, 16).select(*AT, "tile", "attr"),
    "SELECT v.image_id, v.y, v.x, t.tile, t.attr FROM v_pixels v JOIN (SELECT image_id, y * 4 + x AS tile, b AS attr FROM v_pixels WHERE y < 4 AND x < 4) t ON t.image_id = v.image_id AND t.tile = (v.y >> 2) * 4 + (v.x >> 2)",
)
FULL = "(SELECT image_id FROM v_pixels GROUP BY image_id HAVING count(*) = 256)"
_le = fixtures._le
add(
    "pack_bmp", "v_pixels", lambda df: pixels.pack_bmp(df).select("image_id", F.hex("bmp").alias("bmp")),
    ", lines AS (SELECT image_id, y, count(*) AS w, string_agg(lpad(hex(b), 2, '0') || lpad(hex(g), 2, '0') || lpad(hex(r), 2, '0'), '' ORDER BY x) AS s FROM v_pixels GROUP BY 1, 2), "
    "im AS (SELECT image_id, max(w) AS w, count(*) AS h, (max(w) * 24 + 31) // 32 * 4 AS stride FROM lines GROUP BY 1) "
    f"SELECT image_id, '424D' || {_le('stride * h + 54', 4)} || '000000003600000028000000' || {_le('im.w', 4)} || {_le('h', 4)} || '0100180000000000' || {_le('stride * h', 4)} || repeat('0', 32) || string_agg(rpad(s, (stride * 2)::INT, '0'), '' ORDER BY y DESC) AS bmp "
    "FROM im JOIN lines USING (image_id) GROUP BY image_id, im.w, h, stride",
)


def _rasters(df: DataFrame) -> DataFrame:
    whole = df.groupBy("image_id").count().where("count = 256").select("image_id")
    bmp = pixels.pack_bmp(df.join(whole, "image_id"))
    return bmp.select(
        F.col("image_id").alias("file_id"), F.col("bmp").alias("content"), F.lit(16).alias("w"), F.lit(16).alias("h"), F.lit(24).alias("bpp"),
        F.lit(54).alias("data_off"), F.lit(48).alias("stride"), F.lit(True).alias("bottom_up"),
    )


add("explode_raster", "v_pixels", lambda df: pixels.explode_raster(_rasters(df)), f"SELECT image_id AS file_id, y, x, r, g, b FROM v_pixels WHERE image_id IN {FULL}")
for _bits in (1, 2, 4, 8):
    _per = 8 // _bits
    add(
        f"explode_packed_{_bits}", "v_pixels",
        lambda df, n=_bits: pixels.explode_packed_raster(_rasters(df).withColumn("w", F.lit(48 * 8 // n)), n),
        f", full_ AS (SELECT * FROM v_pixels WHERE image_id IN {FULL}), cell AS (SELECT f.image_id AS file_id, ry.range::INT AS y, rx.range::INT AS x, ry.range AS sy, rx.range // {_per} AS byte "
        f"FROM (SELECT DISTINCT image_id FROM full_) f, range(16) ry, range({48 * _per}) rx) SELECT file_id, cell.y, cell.x, ((CASE byte % 3 WHEN 0 THEN b WHEN 1 THEN g ELSE r END) >> (8 - {_bits} - (cell.x * {_bits}) % 8)) & {(1 << _bits) - 1} AS idx "
        "FROM cell JOIN full_ ON full_.image_id = file_id AND full_.y = sy AND full_.x = byte // 3",
    )



def _sampled(df: DataFrame) -> DataFrame:
    """Payloads of whole images in eight layouts: planar, wide, or with alpha in blue-first order; every third bottom-up."""
    planar, wide, alpha, up = ((F.col("image_id").bitwiseAND(F.lit(1)) != 0), (F.col("image_id").bitwiseAND(F.lit(2)) != 0), (F.col("image_id").bitwiseAND(F.lit(4)) != 0), F.col("image_id") % 3 == 0)
    order = F.when(alpha, "bgra").otherwise("rgb")
    named = df.select("image_id", "y", "x", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in "rgba"])).alias("s")).where(F.instr(order, F.col("s.c")) > 0)
    two = F.lpad(F.hex("s.v"), 2, "0")
    place, row = F.instr(order, F.col("s.c")), F.when(up, 15 - F.col("y")).otherwise(F.col("y"))
    at = F.struct(F.when(planar, place).otherwise(0).alias("p"), row.alias("y"), "x", place.alias("c"), F.when(wide, F.concat(two, two)).otherwise(two).alias("hx"))
    whole = named.groupBy("image_id").agg(F.array_sort(F.collect_list(at)).alias("s"), F.countDistinct("y", "x").alias("n")).where("n = 256")
    return whole.select(
        F.col("image_id").alias("file_id"), F.lit(16).alias("w"), F.lit(16).alias("h"), F.lit(3).alias("data_off"), (F.when(planar, 1).otherwise(F.length(order)) * F.when(wide, 2).otherwise(1) * 16).alias("stride"),
        up.alias("bottom_up"), order.alias("channels"), planar.alias("planar"), wide.alias("wide"), F.unhex(F.concat(F.lit("AABBCC"), F.array_join(F.transform("s", lambda e: e["hx"]), ""))).alias("content"),
    )


add(
    "explode_samples", "v_pixels", lambda df: pixels.explode_samples(_sampled(df)),
    "SELECT image_id AS file_id, y, x, " + ", ".join(f"{c} * CASE WHEN image_id & 2 <> 0 THEN 257 ELSE 1 END AS {c}" for c in "rgb")
    + f", CASE WHEN image_id & 4 <> 0 THEN a ELSE 255 END * CASE WHEN image_id & 2 <> 0 THEN 257 ELSE 1 END AS a FROM v_pixels WHERE image_id IN {FULL}",
)

# sequences

RUNS_SQL = "f AS (SELECT *, CASE WHEN lag(r) OVER w IS NOT DISTINCT FROM r AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS fresh FROM v_smooth WINDOW w AS (PARTITION BY image_id, y ORDER BY x)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY image_id, y ORDER BY x) AS run FROM f)"
add("rle_runs", "v_smooth", lambda df: sequence.rle_runs(df, ["image_id", "y"], "x", "r"), f", {RUNS_SQL} SELECT image_id, y, min(x) AS start, first(r) AS r, count(*) AS length FROM g GROUP BY image_id, y, run")
add("rle_runs_capped", "v_smooth", lambda df: sequence.rle_runs(df, ["image_id", "y"], "x", "r", 3), f", {RUNS_SQL}, h AS (SELECT *, (row_number() OVER (PARTITION BY image_id, y, run ORDER BY x) - 1) // 3 AS part FROM g) SELECT image_id, y, min(x) AS start, first(r) AS r, count(*) AS length FROM h GROUP BY image_id, y, run, part")
QUERIES["rle_bytes"] = lambda spark, sf_dir: texts.text_runs(table(spark, sf_dir, "documents").where("doc_id is not null"), "doc_id", least=2)
ORACLES["rle_bytes"] = (
    "WITH b AS (SELECT doc_id, pos, ('0x' || h)::INT AS v FROM (SELECT doc_id, unnest(regexp_extract_all(hex(text), '..')) AS h, unnest(range(strlen(text))) AS pos FROM documents WHERE doc_id IS NOT NULL)), "
    "f AS (SELECT *, CASE WHEN lag(v) OVER w IS NOT DISTINCT FROM v AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS fresh FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), "
    "g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM f) SELECT doc_id, min(pos) AS start, any_value(v) AS v, count(*) AS length FROM g GROUP BY doc_id, run HAVING count(*) > 1"
)
add("rle_expand", "v_smooth", lambda df: sequence.rle_expand(sequence.rle_runs(df, ["image_id", "y"], "x", "r"), ["image_id", "y"], "r"), "SELECT image_id, y, x::BIGINT AS pos, r FROM v_smooth")
add("delta_left", "v_smooth", lambda df: sequence.delta_encode(df, ["image_id", "y"], "x", "g").select(*AT, "delta"), f"SELECT {AT_SQL}, (g - lag(g, 1, 0) OVER (PARTITION BY image_id, y ORDER BY x) + 256) % 256 AS delta FROM v_smooth")
add("delta_decode", "v_smooth", lambda df: sequence.delta_decode(sequence.delta_encode(df, ["image_id", "y"], "x", "g"), ["image_id", "y"], "x").select(*AT, "value"), f"SELECT {AT_SQL}, g AS value FROM v_smooth")
add("delta_up", "v_smooth", lambda df: sequence.delta_encode(df, ["image_id", "x"], "y", "g").select(*AT, "delta"), f"SELECT {AT_SQL}, (g - lag(g, 1, 0) OVER (PARTITION BY image_id, x ORDER BY y) + 256) % 256 AS delta FROM v_smooth")
add("delta_up_decode", "v_smooth", lambda df: sequence.delta_decode(sequence.delta_encode(df, ["image_id", "x"], "y", "g"), ["image_id", "x"], "y").select(*AT, "value"), f"SELECT {AT_SQL}, g AS value FROM v_smooth")
for _kind in (1, 2, 3):
    add(f"gradient_restore_{_kind}", "v_pixels", lambda df, k=_kind: sequence.gradient_restore(sequence.gradient_residual(df, "g", 16, k), k), f"SELECT {AT_SQL}, g AS v FROM v_pixels")
NEAR_SQL = ", n AS (SELECT v.*, l.g AS l, u.g AS u, d.g AS d, CASE WHEN v.x = 15 THEN t2.g ELSE t.g END AS t FROM {v} v LEFT JOIN {v} l ON l.image_id = v.image_id AND l.y = v.y AND l.x = v.x - 1 LEFT JOIN {v} u ON u.image_id = v.image_id AND u.y = v.y - 1 AND u.x = v.x LEFT JOIN {v} d ON d.image_id = v.image_id AND d.y = v.y - 1 AND d.x = v.x - 1 LEFT JOIN {v} t ON t.image_id = v.image_id AND t.y = v.y - 1 AND t.x = v.x + 1 LEFT JOIN {v} t2 ON t2.image_id = v.image_id AND t2.y = v.y AND t2.x = 0)"
_paeth = "CASE WHEN abs(zu - zd) <= abs(zl - zd) AND abs(zu - zd) <= abs(zl + zu - 2 * zd) THEN zl WHEN abs(zl - zd) <= abs(zl + zu - 2 * zd) THEN zu ELSE zd END"
add(
    "filter_residuals", "v_pixels", lambda df: sequence.filter_residuals(df, "g", 16),
    NEAR_SQL.format(v="v_pixels") + f", z AS (SELECT *, coalesce(l, 0) AS zl, coalesce(u, 0) AS zu, coalesce(d, 0) AS zd FROM n) SELECT {AT_SQL}, g AS none, (g - zl + 256) % 256 AS sub, (g - zu + 256) % 256 AS up, (g - (zl + zu) // 2 + 256) % 256 AS average, (g - ({_paeth}) + 256) % 256 AS paeth FROM z",
)
_avg = lambda a, b: f"(({a} + {b}) // 2)"
MODES_SQL = {
    0: "0", 1: "l", 2: "u", 3: "t", 4: "d", 5: _avg(_avg("l", "t"), "u"), 6: _avg("l", "d"), 7: _avg("l", "u"), 8: _avg("d", "u"), 9: _avg("u", "t"),
    10: _avg(_avg("l", "d"), _avg("u", "t")), 12: "least(255, greatest(0, l + u - d))", 13: f"least(255, greatest(0, {_avg('l', 'u')} + trunc(({_avg('l', 'u')} - d) / 2)))",
}
for _mode, _guess in MODES_SQL.items():
    add(
        f"predictor_{_mode}", "v_pixels", lambda df, m=_mode: sequence.predictor_residual(df, "g", 16, m),
        NEAR_SQL.format(v="v_pixels") + f" SELECT {AT_SQL}, ((g - CASE WHEN x = 0 AND y = 0 THEN 0 WHEN y = 0 THEN l WHEN x = 0 THEN u ELSE {_guess} END + 512) % 256)::INT AS residual FROM n",
    )
add(
    "predictor_11", "v_pixels", lambda df: sequence.select_residual(df, 16),
    ", n AS (SELECT v.*, " + ", ".join(f"lag({c}, {k}) OVER w AS {c}{s}" for c in "rgba" for s, k in (("l", 1), ("u", 16), ("d", 17))) + " FROM v_pixels v WINDOW w AS (PARTITION BY image_id ORDER BY y, x)) "
    + f"SELECT {AT_SQL}, " + ", ".join(
        f"({c} - CASE WHEN x = 0 AND y = 0 THEN 0 WHEN y = 0 THEN {c}l WHEN x = 0 THEN {c}u WHEN " + " + ".join(f"abs({k}u - {k}d)" for k in "rgba") + " < " + " + ".join(f"abs({k}l - {k}d)" for k in "rgba") + f" THEN {c}l ELSE {c}u END + 256) % 256 AS {c}" for c in "rgba"
    ) + " FROM n",
)
for _kind, _guess in ((1, "CASE WHEN x > 0 THEN l WHEN y > 0 THEN u ELSE 0 END"), (2, "CASE WHEN y > 0 THEN u WHEN x > 0 THEN l ELSE 0 END"), (3, "CASE WHEN x > 0 AND y > 0 THEN least(255, greatest(0, l + u - d)) WHEN x > 0 THEN l WHEN y > 0 THEN u ELSE 0 END")):
    add(f"gradient_{_kind}", "v_pixels", lambda df, k=_kind: sequence.gradient_residual(df, "g", 16, k), NEAR_SQL.format(v="v_pixels") + f" SELECT {AT_SQL}, (g - ({_guess}) + 256) % 256 AS residual FROM n")
SLOT_SQL = ", s AS (SELECT *, y * 16 + x AS pos, (3 * r + 5 * g + 7 * b + 11 * a) & 63 AS slot, ((r::BIGINT * 256 + g) * 256 + b) * 256 + a AS packed FROM v_smooth), q AS (SELECT *, lag(packed, 1, 0) OVER (PARTITION BY image_id, slot ORDER BY pos) AS prev_in_slot FROM s)"
add("slot_asof", "v_smooth", lambda df: sequence.slot_asof(df, 16).select(*AT, "slot", "prev_in_slot"), SLOT_SQL + f" SELECT {AT_SQL}, slot, prev_in_slot FROM q")
OPS_SQL = SLOT_SQL + (
    ", d AS (SELECT *, " + ", ".join(f"lag({c}, 1, {255 if c == 'a' else 0}) OVER w AS p{c}" for c in "rgba") + " FROM q WINDOW w AS (PARTITION BY image_id ORDER BY pos)), "
    "e AS (SELECT *, " + ", ".join(f"({c} - p{c} + 384) % 256 - 128 AS d{c}" for c in "rgb") + " FROM d), "
    "o AS (SELECT *, CASE WHEN dr = 0 AND dg = 0 AND db = 0 AND a = pa THEN 'run' WHEN packed = prev_in_slot THEN 'index' WHEN a <> pa THEN 'rgba' WHEN dr BETWEEN -2 AND 1 AND dg BETWEEN -2 AND 1 AND db BETWEEN -2 AND 1 THEN 'diff' "
    "WHEN dg BETWEEN -32 AND 31 AND dr - dg BETWEEN -8 AND 7 AND db - dg BETWEEN -8 AND 7 THEN 'luma' ELSE 'rgb' END AS op FROM e)"
)
add("op_profile", "v_smooth", lambda df: sequence.op_profile(df, 16), OPS_SQL + f" SELECT {AT_SQL}, op FROM o")
add("op_summary", "v_smooth", lambda df: sequence.op_summary(sequence.op_profile(df, 16)).withColumn("bytes", F.round("bytes", 4)), OPS_SQL + " SELECT op, count(*) AS pixels, round(count(*) * CASE op WHEN 'run' THEN 1 / 62 WHEN 'index' THEN 1.0 WHEN 'diff' THEN 1.0 WHEN 'luma' THEN 2.0 WHEN 'rgb' THEN 4.0 ELSE 5.0 END::DOUBLE, 4) AS bytes FROM o GROUP BY op")

# resampling

G = lambda dy, dx: f"coalesce((SELECT v FROM w{dy}{dx}), v)"
PLANE_SQL = ", e AS (SELECT *, " + ", ".join(
    f"coalesce({f}(v) OVER (PARTITION BY image_id, {p} ORDER BY {o}), v) AS {n}, {f}(v) OVER (PARTITION BY image_id, {p} ORDER BY {o}) AS {n}0" for n, f, p, o in (("l", "lag", "y", "x"), ("r", "lead", "y", "x"), ("u", "lag", "x", "y"), ("d", "lead", "x", "y"))
) + " FROM v_plane)"
add("upsample_h2", "v_plane", resample.upsample_h2, PLANE_SQL + " SELECT image_id, y, x * 2 AS x, CASE WHEN l0 IS NULL THEN v WHEN r0 IS NULL THEN (3 * l + v + 2) >> 2 ELSE (3 * v + l + 2) >> 2 END AS v FROM e UNION ALL SELECT image_id, y, x * 2 + 1, CASE WHEN r0 IS NULL THEN v ELSE (3 * v + r + 2) >> 2 END FROM e")
add("upsample_v2", "v_plane", resample.upsample_v2, PLANE_SQL + " SELECT image_id, y * 2 AS y, x, (3 * v + u + 2) >> 2 AS v FROM e UNION ALL SELECT image_id, y * 2 + 1, x, (3 * v + d + 2) >> 2 FROM e")
add(
    "upsample_hv2", "v_plane", resample.upsample_hv2,
    PLANE_SQL + ", t AS (SELECT image_id, y * 2 AS y, x, 3 * v + u AS t FROM e UNION ALL SELECT image_id, y * 2 + 1, x, 3 * v + d FROM e), s AS (SELECT *, lag(t) OVER w AS l, lead(t) OVER w AS r FROM t WINDOW w AS (PARTITION BY image_id, y ORDER BY x)) "
    "SELECT image_id, y, x * 2 AS x, CASE WHEN l IS NULL THEN (t + 2) >> 2 ELSE (3 * t + l + 8) >> 4 END AS v FROM s UNION ALL SELECT image_id, y, x * 2 + 1, CASE WHEN r IS NULL THEN (t + 2) >> 2 ELSE (3 * t + r + 8) >> 4 END FROM s",
)
add("upsample_nearest", "v_plane", lambda df: resample.upsample(df, 3, 2), "SELECT image_id, (y * 2 + j.range)::INT AS y, (x * 3 + i.range)::INT AS x, v FROM v_plane, range(3) i, range(2) j")
add(
    "upsample_center", "v_plane", resample.upsample_center,
    ", a AS (SELECT *, coalesce(lag(v) OVER w, v) AS u, coalesce(lead(v) OVER w, v) AS d FROM v_plane WINDOW w AS (PARTITION BY image_id, x ORDER BY y)), "
    "b AS (SELECT *, " + ", ".join(f"coalesce({f}({c}) OVER w, {c}) AS {n}{k}" for n, c in (("m", "v"), ("u", "u"), ("d", "d")) for k, f in (("l", "lag"), ("r", "lead"))) + " FROM a WINDOW w AS (PARTITION BY image_id, y ORDER BY x)) "
    + " UNION ALL ".join(f"SELECT image_id, y * 2 + {j} AS y, x * 2 + {i} AS x, (9 * v + 3 * {s} + 3 * {t} + {g} + 8) // 16 AS v FROM b" for j, i, s, t, g in ((0, 0, "ml", "u", "ul"), (0, 1, "mr", "u", "ur"), (1, 0, "ml", "d", "dl"), (1, 1, "mr", "d", "dr"))),
)

# animation

add("frame_timeline", "v_frames", lambda df: animation.frame_timeline(df).select("image_id", "frame", "start_ms", "end_ms", "duration_ms"), "SELECT image_id, frame, (sum(delay_ms) OVER w - delay_ms)::BIGINT AS start_ms, (sum(delay_ms) OVER w)::BIGINT AS end_ms, (sum(delay_ms) OVER (PARTITION BY image_id))::BIGINT AS duration_ms FROM v_frames WINDOW w AS (PARTITION BY image_id ORDER BY frame)")
_bare = lambda df: df.withColumns({c: F.when(F.col("event_id") % 3 != 0, F.col(c)) for c in ("dispose", "delay_ms")})
add("carry_controls", "v_frames", lambda df: animation.carry_controls(_bare(df)).select("image_id", "frame", "dispose", "delay_ms"), "SELECT image_id, frame, " + ", ".join(f"coalesce(last_value(CASE WHEN event_id % 3 <> 0 THEN {c} END IGNORE NULLS) OVER w, 0) AS {c}" for c in ("dispose", "delay_ms")) + " FROM v_frames WINDOW w AS (PARTITION BY image_id ORDER BY frame ROWS UNBOUNDED PRECEDING)")
CANVAS_SQL = (
    ", own AS (SELECT * FROM v_frame_draws WHERE a > 128), grid AS (SELECT p.image_id, f.frame, p.y, p.x, f.dispose, f.bgindex FROM (SELECT DISTINCT image_id, y, x FROM v_frame_draws) p JOIN v_frames f USING (image_id)), "
    "full_ AS (SELECT g.*, CASE WHEN o.a IS NOT NULL THEN {'r': o.r, 'g': o.g, 'b': o.b, 'a': o.a} END AS v FROM grid g LEFT JOIN own o USING (image_id, frame, y, x)), "
    "canvas AS (SELECT image_id, frame, y, x, coalesce(v, last_value(CASE WHEN dispose <= 1 THEN v END IGNORE NULLS) OVER (PARTITION BY image_id, y, x ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS v FROM full_)"
)


def _canvas(spark: SparkSession, sf_dir: str, fill: bool) -> DataFrame:
    draws, frames = fixtures.view(spark, sf_dir, "v_frame_draws"), fixtures.view(spark, sf_dir, "v_frames")
    canvas = animation.composite_frames(draws, frames)
    if not fill:
        return canvas
    # a colour table of its own for each image
    at = F.col("image_id") * 7 + F.col("bgindex")
    colors = frames.select("image_id", "bgindex").distinct().select("image_id", "bgindex", *[((at * k) % 256).cast("int").alias(c) for c, k in (("r", 3), ("g", 5), ("b", 11))])
    return animation.background_fill(canvas, frames, colors)


QUERIES["composite_frames"] = lambda spark, sf_dir: _canvas(spark, sf_dir, False)
ORACLES["composite_frames"] = fixtures.with_views("v_frame_draws", CANVAS_SQL + " SELECT image_id, frame, y, x, v.r AS r, v.g AS g, v.b AS b, v.a AS a FROM canvas")
QUERIES["background_fill"] = lambda spark, sf_dir: _canvas(spark, sf_dir, True)
ORACLES["background_fill"] = fixtures.with_views(
    "v_frame_draws", CANVAS_SQL + ", f AS (SELECT image_id, arg_min(bgindex, frame) AS bg FROM v_frames GROUP BY 1) SELECT image_id, frame, y, x, "
    + ", ".join(f"CASE WHEN v IS NULL AND bg > 0 THEN {k} ELSE v.{c} END AS {c}" for c, k in (("r", "(image_id * 7 + bg) * 3 % 256"), ("g", "(image_id * 7 + bg) * 5 % 256"), ("b", "(image_id * 7 + bg) * 11 % 256"), ("a", "255"))) + " FROM canvas JOIN f USING (image_id)"
)

# dithering: results are checked in the tests against a scalar walk

add("dither_mono", "v_pixels", dither.dither_mono)
add("dither_vga16", "v_pixels", lambda df: dither.dither_palette(df, "vga16"))
add("dither_win256", "v_pixels", lambda df: dither.dither_palette(df, "win256"))
add("dither_by_depth", "v_pixels", lambda df: dither.dither_corpus(df, 1, 1))
add("dither_none", "v_pixels", lambda df: dither.dither_corpus(df, 0), "SELECT image_id, frame, y, x, r, g, b FROM v_pixels")

# events

add("clamped_fold", "v_view_events", lambda df: events.last_position(df, "session_id", ["seq"], "delta", 0, 100), "SELECT session_id, list_reduce(list_prepend(0::BIGINT, list(delta::BIGINT ORDER BY seq)), lambda p, d: least(100, greatest(0, p + d)))::BIGINT AS pos FROM v_view_events GROUP BY 1")
add(
    "clamped_path", "v_view_events", lambda df: events.clamped_fold(df, "session_id", ["seq"], "delta", 0, 100),
    ", l AS (SELECT session_id, list(delta::BIGINT ORDER BY seq) AS d, list(seq ORDER BY seq) AS s FROM v_view_events GROUP BY 1), u AS (SELECT *, unnest(range(1, len(d) + 1)) AS i FROM l) "
    "SELECT session_id, s[i] AS seq, list_reduce(list_prepend(0::BIGINT, d[:i]), lambda p, x: least(100, greatest(0, p + x)))::BIGINT AS pos FROM u",
)
_scrolled = lambda df: df.withColumns({
    "kind": F.element_at(F.array(*[F.lit(k) for k in ("line", "page", "wheel", "top", "bottom", "track", "drag")]), (F.col("seq") % 7 + 1).cast("int")),
    "delta": F.when(F.col("seq") % 7 == 2, F.col("delta") * 10).when(F.col("seq") % 7 == 5, F.col("px")).otherwise(F.col("delta") % 4),
})
add(
    "scroll_path", "v_view_events", lambda df: events.clamped_fold(events.position_steps(_scrolled(df), 0, 300, 50), "session_id", ["seq"], "step", 0, 300, goto="goto"),
    ", k AS (SELECT session_id, seq, CASE seq % 7 WHEN 0 THEN delta % 4 * 20 WHEN 1 THEN delta % 4 * 50 WHEN 2 THEN -(trunc(delta * 10 / 120)) * 20 WHEN 6 THEN delta % 4 ELSE 0 END::BIGINT AS d, "
    "CASE seq % 7 WHEN 3 THEN 0 WHEN 4 THEN 300 WHEN 5 THEN px END::BIGINT AS g FROM v_view_events), "
    "l AS (SELECT session_id, list({'d': d, 'g': g} ORDER BY seq) AS e, list(seq ORDER BY seq) AS s FROM k GROUP BY 1), u AS (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM l) "
    "SELECT session_id, s[i] AS seq, list_reduce(list_prepend({'d': 0::BIGINT, 'g': 0::BIGINT}, e[:i]), lambda p, x: {'d': 0::BIGINT, 'g': least(300, greatest(0, coalesce(x.g, p.g + x.d)))}).g AS pos FROM u",
)
add(
    "drag_segments", "v_view_events", events.drag_segments,
    ", c AS (SELECT *, count(*) FILTER (kind = 'down') OVER w AS drag, max(CASE WHEN kind = 'down' THEN seq END) OVER w AS last_down, max(CASE WHEN kind = 'up' THEN seq END) OVER w AS last_up FROM v_view_events WINDOW w AS (PARTITION BY session_id ORDER BY seq)), "
    "d AS (SELECT * FROM c WHERE drag > 0 AND (last_up IS NULL OR last_up < last_down) AND kind IN ('down', 'move')), m AS (SELECT *, lag(px) OVER w - px AS dx, lag(py) OVER w - py AS dy FROM d WINDOW w AS (PARTITION BY session_id, drag ORDER BY seq)) "
    "SELECT session_id, drag, count(*) AS moves, sum(dx)::BIGINT AS net_x, sum(dy)::BIGINT AS net_y, sum(abs(dx) + abs(dy))::BIGINT AS path FROM m WHERE kind = 'move' GROUP BY 1, 2",
)
add("mode_cycle", "v_view_events", events.mode_cycle, "SELECT session_id, seq, ((1 + row_number() OVER (PARTITION BY session_id ORDER BY seq)) % 5)::INT AS mode FROM v_view_events WHERE kind = 'mode'")

# catalogue


def _num(at: int, n: int, little: bool) -> str:
    """DuckDB: an integer of the hex text, null if it is cut short."""
    piece = f"substr(hx, {2 * at + 1}, {2 * n})"
    turned = " || ".join(f"substr(hx, {2 * (at + k) + 1}, 2)" for k in (reversed(range(n)) if little else range(n)))
    return f"(CASE WHEN length({piece}) = {2 * n} THEN ('0x' || {turned})::BIGINT END)"


_L = lambda at, n: _num(at, n, True)
_B = lambda at, n=1: _num(at, n, False)
_has = lambda h, at=0: f"substr(hx, {2 * at + 1}, {len(h)}) = '{h}'"
MAGIC_SQL = {
    "png": _has("89504E470D0A1A0A"), "bmp": f"{_has('424D')} AND {_L(14, 4)} IN (12, 40, 56, 108, 124)", "gif": f"{_has('474946383761')} OR {_has('474946383961')}",
    "psd": _has("38425053"), "pic": f"{_has('5380F634')} AND {_has('50494354', 88)}", "jpeg": "regexp_matches(substr(hx, 1, 32), '^FF(FF)*D8')", "pnm": f"{_has('5035')} OR {_has('5036')}",
    "hdr": f"{_has('233F52414449414E43450A')} OR {_has('233F524742450A')}", "webp": f"{_has('52494646')} AND {_has('57454250', 8)}", "qoi": _has("716F6966"),
    "pcx": f"{_B(0)} = 10 AND {_B(2)} = 1 AND {_B(3)} IN (1, 2, 4, 8)",
    "tga": f"{_B(1)} <= 1 AND CASE WHEN {_B(1)} = 1 THEN {_B(2)} IN (1, 9) AND {_B(7)} IN (8, 15, 16, 24, 32) AND {_B(16)} IN (8, 16) ELSE {_B(2)} IN (2, 3, 10, 11) AND {_B(16)} IN (8, 15, 16, 24, 32) END AND {_L(12, 2)} >= 1 AND {_L(14, 2)} >= 1",
}


def _sniff_sql(order: list[str]) -> str:
    names = [*order[:-1], "webp", "qoi", "pcx", "tga"]
    return "CASE " + " ".join(f"WHEN {MAGIC_SQL[n]} THEN '{n}'" for n in names) + f" WHEN {_ext} IN ('xbm', 'xpm') THEN {_ext} ELSE 'unknown' END"


_ext = "lower(regexp_extract(path, '\\.([^.]*)$', 1))"
_digits = lambda rx, k: f"regexp_replace(nullif(regexp_extract(hx, '{rx}', {k}), ''), '3(.)', '\\1', 'g')::BIGINT"
_PNM, _HDR = "^503[56]0A((3[0-9])+)20((3[0-9])+)(0A((3[0-9])+))?", "0A0A2D5920((3[0-9])+)202B5820((3[0-9])+)0A"
_ll = _has("5650384C", 12)
HEAD_SQL = {
    "xbm": ("NULL", "NULL", "3", "8"), "xpm": ("NULL", "NULL", "3", "8"),
    "png": (_B(16, 4), _B(20, 4), f"CASE {_B(25)} WHEN 3 THEN 3 ELSE CASE WHEN {_B(25)} & 2 <> 0 THEN 3 ELSE 1 END + CASE WHEN {_B(25)} & 4 <> 0 THEN 1 ELSE 0 END END", _B(24)),
    "bmp": (_L(18, 4), _L(22, 4), f"CASE WHEN {_L(28, 2)} = 32 THEN 4 ELSE 3 END", "8"), "gif": (_L(6, 2), _L(8, 2), "4", "8"),
    "psd": (_B(18, 4), _B(14, 4), "4", _B(22, 2)), "pic": (_B(92, 2), _B(94, 2), f"CASE WHEN {_B(107)} & 16 <> 0 THEN 4 ELSE 3 END", "8"),
    "jpeg": (_B(9, 2), _B(7, 2), f"CASE WHEN {_B(11)} >= 3 THEN 3 ELSE 1 END", _B(6)),
    "pnm": (_digits(_PNM, 1), _digits(_PNM, 3), f"CASE WHEN {_B(1)} = 53 THEN 1 ELSE 3 END", f"CASE WHEN {_digits(_PNM, 6)} > 255 THEN 16 ELSE 8 END"),
    "hdr": (_digits(_HDR, 3), _digits(_HDR, 1), "3", "32"), "tga": (_L(12, 2), _L(14, 2), f"CASE WHEN {_B(16)} = 8 THEN 1 WHEN {_B(16)} = 16 AND {_B(2)} IN (3, 11) THEN 2 WHEN {_B(16)} IN (15, 16, 24) THEN 3 ELSE 4 END", "8"),
    "webp": (f"CASE WHEN {_ll} THEN ({_L(21, 4)} & 16383) + 1 ELSE {_L(26, 2)} & 16383 END", f"CASE WHEN {_ll} THEN (({_L(21, 4)} >> 14) & 16383) + 1 ELSE {_L(28, 2)} & 16383 END", "4", "8"),
    "qoi": (_B(4, 4), _B(8, 4), _B(12), "8"), "pcx": (f"abs({_L(8, 2)} - {_L(4, 2)}) + 1", f"abs({_L(10, 2)} - {_L(6, 2)}) + 1", f"CASE WHEN {_B(3)} = 8 AND {_B(65)} = 4 THEN 4 ELSE 3 END", "8"),
}
_field = lambda k: "(CASE format " + " ".join(f"WHEN '{n}' THEN {v[k]}" for n, v in HEAD_SQL.items()) + " END)::BIGINT"


def _rules_sql() -> str:
    """The rules of ``validate_header``, in its order within each format; image records of WebP files in v_files come first, at byte 12."""
    old, size, offset = f"{_L(14, 4)} = 12", _L(14, 4), _L(10, 4)
    bpp, packing = f"(CASE WHEN {old} THEN {_L(24, 2)} ELSE {_L(28, 2)} END)", _L(30, 4)
    packed = f"(NOT {old} AND {packing} = 3)"
    masks = [f"(CASE WHEN {size} = 56 THEN {_L(70 + 4 * k, 4)} ELSE {_L(54 + 4 * k, 4)} END)" for k in range(3)]
    header = f"(14 + {size} + CASE WHEN {packed} AND {size} IN (40, 56) THEN 12 ELSE 0 END)"
    entries = f"(CASE WHEN {bpp} >= CASE WHEN {old} THEN 24 ELSE 16 END THEN 0 WHEN {old} THEN trunc(({offset} - 38) / 3) ELSE floor(({offset} - 14 - {size}) / 4) END)"
    byte = lambda at: f"('0x' || substr(hx, {at} * 2 + 1, 2))::INT"
    packets = (
        f"nullif(list_filter(list_transform(range(11), lambda k: CASE WHEN length(hx) < 2 * (108 + 4 * k) THEN 'truncated packets' WHEN k = 10 THEN 'too many packets' WHEN {byte('(105 + 4 * k)')} <> 8 THEN 'bad packet size' "
        f"WHEN {byte('(104 + 4 * k)')} = 0 THEN '' END), lambda x: x IS NOT NULL)[1], '')"
    )
    lossy, lossless = f"{_has('56503820', 12)} AND length(hx) >= 60", f"{_ll} AND length(hx) >= 50"
    own = {
        "png": [
            (f"{_B(8, 4)} <> 13", "bad IHDR len"), (f"{_B(24)} NOT IN (1, 2, 4, 8, 16)", "1/2/4/8/16-bit only"), (f"{_B(25)} > 6 OR {_B(25)} IN (1, 5) OR ({_B(25)} = 3 AND {_B(24)} = 16)", "bad ctype"),
            (f"{_B(26)} <> 0", "bad comp method"), (f"{_B(27)} <> 0", "bad filter method"), (f"{_B(28)} > 1", "bad interlace method"), ("width <= 0 OR height <= 0", "0-pixel image"),
        ],
        "bmp": [
            (f"CASE WHEN {old} THEN {_L(22, 2)} ELSE {_L(26, 2)} END <> 1", "bad BMP"), (f"NOT {old} AND {packing} IN (1, 2)", "BMP RLE"), (f"NOT {old} AND {packing} >= 4", "BMP JPEG/PNG"),
            (f"{packed} AND {_L(28, 2)} NOT IN (16, 32)", "bad BMP"), (f"{packed} AND {size} IN (40, 56) AND {masks[0]} = {masks[1]} AND {masks[1]} = {masks[2]}", "bad BMP"),
            (f"{entries} = 0 AND ({offset} < {header} OR {offset} - {header} > 1024)", "bad offset"), (f"{bpp} < 16 AND ({entries} <= 0 OR {entries} > 256)", "invalid palette"), (f"{bpp} NOT IN (1, 4, 8, 16, 24, 32)", "bad bpp"),
            (f"{bpp} <> 24 AND {bpp} >= 16 AND ({old} OR ({packed} AND ({' OR '.join(f'{m} = 0 OR bit_count({m}) > 8' for m in masks)})))", "bad masks"),
        ],
        "psd": [(f"{_B(4, 2)} <> 1", "wrong version"), (f"{_B(12, 2)} > 16", "wrong channel count"), (f"{_B(22, 2)} NOT IN (8, 16)", "unsupported bit depth"), (f"{_B(24, 2)} <> 3", "wrong color format")],
        "jpeg": [(f"{_B(6)} <> 8", "only 8-bit"), ("height = 0", "no header height"), ("width = 0", "0 width"), (f"{_B(11)} NOT IN (1, 3, 4)", "bad component count")],
        "pnm": [("coalesce(width, 0) = 0 OR coalesce(height, 0) = 0", "invalid width"), (f"{_digits(_PNM, 6)} > 65535", "max value > 65535")],
        "hdr": [("NOT regexp_matches(hx, '^(([1-9A-F][0-9A-F]|0[0-9B-F])+0A)*464F524D41543D33322D6269745F726C655F726762650A')", "unsupported format"), ("width IS NULL", "unsupported data layout")],
        "tga": [(f"{_B(1)} = 1 AND {_L(5, 2)} = 0", "bad palette")],
        "webp": [
            (f"{lossy} AND {_L(20, 3)} & 1 <> 0", "VP8 inter frame"), (f"{lossy} AND ({_L(20, 3)} >> 1) & 7 > 3", "VP8 profile"), (f"{lossy} AND {_L(20, 3)} >> 5 >= {_L(16, 4)}", "VP8 partition size"),
            (f"{lossy} AND NOT {_has('9D012A', 23)}", "VP8 signature"), (f"{lossless} AND {_B(20)} <> 47", "VP8L signature"), (f"{lossless} AND {_L(21, 4)} >> 29 <> 0", "VP8L version"),
            (f"NOT {_has('56503820', 12)} AND NOT {_ll}", "no image record"),
        ],
        "pcx": [(f"CASE {_B(3)} WHEN 1 THEN {_B(65)} NOT IN (1, 2, 3, 4) WHEN 2 THEN {_B(65)} NOT IN (1, 4) WHEN 4 THEN {_B(65)} > 1 ELSE {_B(65)} NOT IN (1, 3, 4) END", "bad planes")],
        **{text: [("coalesce(width, 0) <= 0", "invalid width")] for text in ("xbm", "xpm")},
    }
    return (
        "CASE WHEN format = 'unknown' THEN 'unknown image type' " + " ".join(f"WHEN format = '{f}' AND ({rule}) THEN '{text}'" for f, rules in own.items() for rule, text in rules)
        + f" WHEN format = 'pic' AND {packets} IS NOT NULL THEN {packets} WHEN width IS NULL OR height IS NULL THEN 'truncated header' WHEN width <= 0 OR height <= 0 THEN '0-pixel image' END"
    )


HEADERS_SQL = (
    f", sn AS MATERIALIZED (SELECT *, {_sniff_sql(catalogue.LOAD_ORDER)} AS format FROM v_files), "
    f"hd AS MATERIALIZED (SELECT *, {_field(0)} AS width, {_field(1)} AS height, {_field(2)} AS channels, {_field(3)} AS bits FROM sn), "
    f"va AS MATERIALIZED (SELECT *, {_rules_sql()} AS reason FROM hd)"
)


def _files(df: DataFrame) -> DataFrame:
    return df.withColumn("content", F.unhex("hx")).drop("hx")


sniffed = lambda df: catalogue.sniff_format(_files(df))
headers = lambda df: catalogue.probe_header(sniffed(df))
valid = lambda df: catalogue.validate_header(headers(df))
add("route_by_extension", "v_files", lambda df: catalogue.route_by_extension(_files(df)).select("file_id", "route"), f"SELECT file_id, CASE WHEN {_ext} IN ('webp', 'wbp', 'web') AND {_has('52494646')} THEN 'webp' WHEN {_ext} IN ('pcx', 'qoi', 'xbm', 'xpm') THEN {_ext} ELSE 'sniff' END AS route FROM v_files")
add("sniff_format", "v_files", lambda df: sniffed(df).select("file_id", "format"), f"SELECT file_id, {_sniff_sql(catalogue.LOAD_ORDER)} AS format FROM v_files")
add("sniff_format_info", "v_files", lambda df: catalogue.sniff_format(_files(df), "info").select("file_id", "format"), f"SELECT file_id, {_sniff_sql(catalogue.INFO_ORDER)} AS format FROM v_files")
add("probe_header", "v_files", lambda df: headers(df).select("file_id", "format", "width", "height", "channels", "bits"), HEADERS_SQL + " SELECT file_id, format, width, height, channels, bits FROM hd")
add("header_flags", "v_files", lambda df: headers(df).select("file_id", catalogue.is_16_bit().alias("deep"), catalogue.is_hdr().alias("hdr"), catalogue.is_lossless_webp().alias("lossless")), HEADERS_SQL + f" SELECT file_id, coalesce(format IN ('png', 'psd', 'pnm') AND bits = 16, false) AS deep, {MAGIC_SQL['hdr']} AS hdr, ({MAGIC_SQL['webp']}) AND {_ll} AS lossless FROM hd")
_big = lambda df: headers(df).withColumns({"width": F.col("width") * 700, "height": F.col("height") * 500})
add(
    "size_guard", "v_files", lambda df: catalogue.size_guard(_big(df)).select("file_id", "size_reason"),
    HEADERS_SQL + " SELECT file_id, CASE WHEN w > 16777216 OR h > 16777216 OR (format = 'pic' AND w * h > 268435456) OR (format = 'png' AND w * h * channels > 1073741824) OR w * h * channels > 2147483647 THEN 'too large' END AS size_reason FROM (SELECT *, width * 700 AS w, height * 500 AS h FROM hd)",
)
add("validate_header", "v_files", lambda df: valid(df).select("file_id", "reason"), HEADERS_SQL + " SELECT file_id, reason FROM va")
add("quarantine_good", "v_files", lambda df: catalogue.quarantine_split(valid(df))[0].select("file_id", "format"), HEADERS_SQL + " SELECT file_id, format FROM va WHERE reason IS NULL")
add("quarantine_bad", "v_files", lambda df: catalogue.quarantine_split(valid(df))[1].select("file_id", "reason"), HEADERS_SQL + " SELECT file_id, reason FROM va WHERE reason IS NOT NULL")
add("failure_report", "v_files", lambda df: catalogue.failure_report(valid(df)).withColumn("share", F.round("share", 6)), HEADERS_SQL + " SELECT format, reason, count(*) AS files, round(count(*) / (SELECT count(*) FROM va), 6) AS share FROM va WHERE reason IS NOT NULL GROUP BY 1, 2")
add("decoded_size", "v_files", lambda df: catalogue.decoded_size(headers(df)).select("file_id", "decoded_bytes", "bitmap_bytes"), HEADERS_SQL + " SELECT file_id, width * height * channels * bits // 8 AS decoded_bytes, (width * 24 + 31) // 32 * 4 * height AS bitmap_bytes FROM hd")
add("extension_mismatch", "v_files", lambda df: catalogue.extension_mismatch(sniffed(df)).select("file_id", "named", "format"), HEADERS_SQL + f" SELECT * FROM (SELECT file_id, CASE {_ext} WHEN 'jpg' THEN 'jpeg' WHEN 'wbp' THEN 'webp' WHEN 'web' THEN 'webp' WHEN 'ppm' THEN 'pnm' WHEN 'pgm' THEN 'pnm' ELSE {_ext} END AS named, format FROM sn) WHERE named <> format")
add("corpus_summary", "v_files", lambda df: catalogue.corpus_summary(valid(df)), HEADERS_SQL + " SELECT format, count(*) AS files, count(*) FILTER (reason IS NULL) AS valid, coalesce(sum(width * height) FILTER (reason IS NULL), 0)::BIGINT AS pixels, max(width * height) FILTER (reason IS NULL) AS largest, min(width * height) FILTER (reason IS NULL) AS smallest, count(*) FILTER (format IN ('png', 'psd', 'pnm') AND bits = 16) AS deep, sum(length(hx) // 2)::BIGINT AS bytes, count(*) FILTER (bits = 8) AS bits_8, count(*) FILTER (bits = 16) AS bits_16, count(*) FILTER (bits = 32) AS bits_32 FROM va GROUP BY 1")
add("byte_integers", "v_files", lambda df: _files(df).select("file_id", C.be_int("content", 4, 2).alias("be16"), C.be_int("content", 8, 4).alias("be32"), C.le_int("content", 4, 2).alias("le16"), C.le_int("content", 5, 3).alias("le24"), C.le_int("content", 8, 4).alias("le32")), f"SELECT file_id, {_B(4, 2)} AS be16, {_B(8, 4)} AS be32, {_L(4, 2)} AS le16, {_L(5, 3)} AS le24, {_L(8, 4)} AS le32 FROM v_files")
# headers by meaning: the fixture says what each file is, the query reads it from the bytes
_given = lambda k: "CASE kind " + " ".join(f"WHEN {i} THEN {x[k]}" if not isinstance(x[k], str) else f"WHEN {i} THEN '{x[k]}'" for i, x in enumerate(fixtures.HEADERS) if x[k] is not None) + " END"
_side = lambda k: "CASE kind " + " ".join(f"WHEN {i} THEN {x[k]}" for i, x in enumerate(fixtures.HEADERS) if x[k] is not None) + " END"
add(
    "header_rules", "v_headers", lambda df: valid(df.select("file_id", "path", "hx")).select("file_id", "format", "width", "height", "channels", "bits", "reason"),
    f"SELECT file_id, {_given(2)} AS format, ({_side(3)})::BIGINT AS width, ({_side(4)})::BIGINT AS height, ({_given(5)})::BIGINT AS channels, ({_given(6)})::BIGINT AS bits, {_given(7)} AS reason FROM v_headers",
)
add("lossless_webp", "v_headers", lambda df: headers(df.select("file_id", "path", "hx")).where(catalogue.is_lossless_webp()).select("file_id"), "SELECT file_id FROM v_headers WHERE kind IN (" + ", ".join(str(i) for i, x in enumerate(fixtures.HEADERS) if "5650384C" in x[1]) + ")")
_seen = lambda kind, of="type": f"coalesce(bool_or({of} IN ({kind})) OVER w, false)"
CHUNK_SQL = (
    f", s AS (SELECT c.*, ctype = 3 AS paletted, CASE WHEN ctype & 2 <> 0 THEN 3 ELSE 1 END + CASE WHEN ctype & 4 <> 0 THEN 1 ELSE 0 END AS n, {_seen("'IHDR'")} AS head, {_seen("'IDAT'")} AS data, "
    "coalesce(last_value(CASE WHEN type = 'PLTE' THEN length // 3 END IGNORE NULLS) OVER w, 0) AS colours FROM v_chunks c JOIN v_chunk_images USING (image_id) "
    "WINDOW w AS (PARTITION BY image_id ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
    "e AS (SELECT image_id, chunk_no, CASE WHEN type = 'CgBI' THEN NULL WHEN type = 'IHDR' THEN CASE WHEN head THEN 'multiple IHDR' WHEN length <> 13 THEN 'bad IHDR len' END WHEN NOT head THEN 'first not IHDR' "
    "WHEN type = 'PLTE' THEN CASE WHEN length > 768 OR length % 3 <> 0 THEN 'invalid PLTE' END "
    "WHEN type = 'tRNS' THEN CASE WHEN data THEN 'tRNS after IDAT' WHEN paletted AND colours = 0 THEN 'tRNS before PLTE' WHEN paletted THEN CASE WHEN length > colours THEN 'bad tRNS len' END "
    "WHEN n % 2 = 0 THEN 'tRNS with alpha' WHEN length <> n * 2 THEN 'bad tRNS len' END "
    "WHEN type = 'IDAT' THEN CASE WHEN paletted AND colours = 0 THEN 'no PLTE' WHEN length > 1073741824 THEN 'IDAT size limit' END "
    "WHEN type = 'IEND' THEN CASE WHEN data THEN '' ELSE 'no IDAT' END WHEN type = 'QUIX' THEN 'unknown critical chunk' END AS event FROM s) "
    "SELECT image_id, nullif(coalesce(arg_min(event, chunk_no) FILTER (event IS NOT NULL), 'no IEND'), '') AS reason FROM e GROUP BY image_id"
)


def _chunk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.check_chunk_order(fixtures.view(spark, sf_dir, "v_chunks"), fixtures.view(spark, sf_dir, "v_chunk_images"))


QUERIES["check_chunk_order"] = _chunk_order
ORACLES["check_chunk_order"] = fixtures.with_views("v_chunks", CHUNK_SQL)
add(
    "check_riff_order", "v_riff", catalogue.check_riff_order,
    f", s AS (SELECT *, {_seen("'VP8 ', 'VP8L'")} AS image, {_seen("'VP8L'")} AS lossless, {_seen("'ALPH'")} AS alpha FROM v_riff WINDOW w AS (PARTITION BY image_id ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
    "e AS (SELECT *, CASE WHEN type IN ('VP8 ', 'VP8L') AND image THEN 'second image record' WHEN type = 'VP8L' AND alpha OR type = 'ALPH' AND lossless THEN 'VP8L with ALPH' END AS event FROM s) "
    "SELECT image_id, coalesce(arg_min(event, chunk_no) FILTER (event IS NOT NULL), CASE WHEN bool_or(type IN ('VP8 ', 'VP8L')) THEN NULL ELSE 'no image record' END) AS reason FROM e GROUP BY image_id",
)
add("list_chunks", "v_headers", lambda df: images.list_chunks(_files(df)).withColumn("head", F.hex("head")))
add("probe_jpeg", "v_files", lambda df: catalogue.probe_jpeg(images.list_chunks(_files(df))), HEADERS_SQL + " SELECT file_id, width, height, channels, bits FROM hd WHERE format = 'jpeg' AND width IS NOT NULL")

# text rasters


def _xbm(df: DataFrame) -> DataFrame:
    """16 columns by 16 rows of bits of each whole image, as text."""
    bit = F.when(F.col("r") % 2 == 1, F.shiftleft(F.lit(1), 0)).otherwise(0)
    whole = df.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", bit.alias("b")))).alias("p")).where("size(p) = 256")
    octet = lambda k: F.expr(f"aggregate(sequence(0, 7), 0, (s, i) -> s + get(p, {k} * 8 + i).b * cast(pow(2, i) as int))")
    return whole.select(
        F.col("image_id").alias("file_id"),
        F.encode(F.concat(F.lit("#define i_width 16\n#define i_height 16\nstatic unsigned char i_bits[] = {\n"), F.concat_ws(", ", *[F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(octet(k))), 2, "0")) for k in range(32)]), F.lit("};\n")), "UTF-8").alias("content"),
    )


def _xpm(df: DataFrame) -> DataFrame:
    """16 by 16 letters of each whole image, with four declared colours of which two share a key."""
    cell = F.char(97 + F.col("r") % 4)
    whole = df.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", cell.alias("c")))).alias("p")).where("size(p) = 256")
    rows = F.expr("array_join(transform(sequence(0, 15), j -> concat('\"', array_join(transform(slice(p, j * 16 + 1, 16), s -> s.c), ''), '\"')), ',\n')")
    head = '/* XPM */\nstatic char *i[] = {\n"16 16 4 1",\n"a c #010203",\n"b c #0a0b0c",\n"a c #ffffff",\n"c c red",\n'
    return whole.select(F.col("image_id").alias("file_id"), F.encode(F.concat(F.lit(head), rows, F.lit("};\n")), "UTF-8").alias("content"))


add("explode_xbm", "v_pixels", lambda df: images.explode_xbm(_xbm(df)), f"SELECT image_id AS file_id, y, x, CASE WHEN r % 2 = 1 THEN 0 ELSE 255 END AS v FROM v_pixels WHERE image_id IN {FULL}")
add(
    "explode_xpm", "v_pixels", lambda df: palette.xpm_key_join(*images.explode_xpm(_xpm(df))),
    f"SELECT {AT_SQL}, chr(97 + r % 4) AS key, CASE r % 4 WHEN 0 THEN 1 WHEN 1 THEN 10 END AS r, CASE r % 4 WHEN 0 THEN 2 WHEN 1 THEN 11 END AS g, CASE r % 4 WHEN 0 THEN 3 WHEN 1 THEN 12 END AS b FROM v_pixels WHERE image_id IN {FULL}",
)
