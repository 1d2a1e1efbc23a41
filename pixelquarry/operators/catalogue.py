"""File catalogue: routes, formats, headers, limits, reasons, quarantine and summaries.

All rules are column expressions on ``content``, but for a walk over the records of JPEG, PNG, WebP and
PIC files; nothing is decoded. Offsets and magics are the
public file formats'. A truncated field is null, and a null size is a failure with a reason.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelquarry.functions.color import be_int, byte_at, le_int
from pixelquarry.operators import automaton
from pixelquarry.session import ship
from pixelquarry.sources import headers, records

# Extensions by route.
ROUTES = {"webp": ["webp", "wbp", "web"], "pcx": ["pcx"], "qoi": ["qoi"], "xbm": ["xbm"], "xpm": ["xpm"]}
LOAD_ORDER = ["png", "bmp", "gif", "psd", "pic", "jpeg", "pnm", "hdr", "tga"]
INFO_ORDER = ["jpeg", "png", "gif", "bmp", "psd", "pic", "pnm", "hdr", "tga"]
MAX_DIM, INT_MAX = 1 << 24, (1 << 31) - 1


def _starts(hexed: str, at: int = 0) -> Column:
    return F.hex(F.col("content").substr(at + 1, len(hexed) // 2)) == hexed


def _filled(n: int) -> Column:
    return F.hex(F.col("content").substr(1, n)) == "FF" * n


def _after_fill(n: int) -> Column:
    """Whether the JPEG mark stands behind fill bytes among the first n bytes."""
    return F.hex(F.col("content").substr(1, n)).rlike("^(?:FF)++D8")


def magic(name: str) -> Column:
    """Whether the content has a format's mark."""
    b = lambda at: byte_at("content", at)
    rules = {
        "png": lambda: _starts("89504E470D0A1A0A"),
        "bmp": lambda: _starts("424D") & le_int("content", 14, 4).isin(12, 40, 56, 108, 124),
        "gif": lambda: _starts("474946383761") | _starts("474946383961"),
        "psd": lambda: _starts("38425053"),
        "pic": lambda: _starts("5380F634") & _starts("50494354", 88),
        "jpeg": lambda: F.when(~_filled(16), _after_fill(16)).when(~_filled(4096), _after_fill(4096)).otherwise(_after_fill(INT_MAX)),
        "pnm": lambda: _starts("5035") | _starts("5036"),
        "hdr": lambda: _starts("233F52414449414E43450A") | _starts("233F524742450A"),
        "tga": lambda: (b(1) <= 1)
        & F.when(b(1) == 1, b(2).isin(1, 9) & b(7).isin(8, 15, 16, 24, 32) & b(16).isin(8, 16)).otherwise(
            b(2).isin(2, 3, 10, 11) & b(16).isin(8, 15, 16, 24, 32)
        )
        & (le_int("content", 12, 2) >= 1) & (le_int("content", 14, 2) >= 1),
        "webp": lambda: _starts("52494646") & _starts("57454250", 8),
        "qoi": lambda: _starts("716F6966"),
        "pcx": lambda: (b(0) == 10) & (b(2) == 1) & b(3).isin(1, 2, 4, 8),
    }
    return F.coalesce(rules[name](), F.lit(False))


def route_by_extension(files: DataFrame) -> DataFrame:
    """``route`` from the text after the last dot; webp names without a RIFF mark are sniffed."""
    ext = F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1))
    route = F.lit("sniff")
    for name, exts in ROUTES.items():
        route = F.when(ext.isin(*exts), name).otherwise(route)
    return files.withColumn("route", F.when((route == "webp") & ~_starts("52494646"), "sniff").otherwise(route))


def sniff_format(files: DataFrame, order: str = "load") -> DataFrame:
    """``format``: first matching mark in load or info order, then the marks only a route names, then the names of text rasters; else unknown."""
    names = [*(LOAD_ORDER[:-1] if order == "load" else INFO_ORDER[:-1]), "webp", "qoi", "pcx", "tga"]
    out = F.lit("unknown")
    if "path" in files.columns:  # text rasters have no mark but their name
        ext = F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1))
        out = F.when(ext.isin("xbm", "xpm") & (F.octet_length("content") > 0), ext).otherwise(out)
    for name in reversed(names):
        out = F.when(magic(name), name).otherwise(out)
    # a one-row explode: the marks are looked at once, not again in every rule and filter on the format
    return files.withColumn("format", F.explode(F.array(out)))


#: First bytes in which a text header is looked for before the whole content is.
_TEXT_BYTES = 4096
_GAP = r"(?:\s|#[^\n\r]*)*+"
_PNM = rf"^P[56]{_GAP}(\d++)(?:{_GAP}(\d++))?(?:{_GAP}(\d++))?"
_HDR = r"\A(?:[^\n]++\n)++\n[^\n]*+\n"


def _text_header(name: str, ended: str) -> Column:
    """The text header of files of one format: the first bytes, if they match the pattern of a header that ends, else the whole content."""
    own = F.when(F.col("format") == name, F.col("content"))
    head = F.decode(F.substring(own, 1, _TEXT_BYTES), "ISO-8859-1")
    return F.when(head.rlike(ended), head).otherwise(F.decode(own, "ISO-8859-1"))


def _pnm_number(k: int) -> Column:
    """Width (1), height (2) or highest value (3) of a PNM header; null where the text ends before it."""
    text = _text_header("pnm", rf"^P[56](?:{_GAP}\d++){{3}}\s")
    return F.regexp_extract(text, _PNM, k).try_cast("long")


def _hdr_header() -> Column:
    return _text_header("hdr", _HDR)


def _records(sniffed: DataFrame) -> Column:
    """What a walk over the records of JPEG, PNG, WebP and PIC files finds; only their content goes to Python, and is not copied there."""
    ship(sniffed.sparkSession)
    kind = pa.struct([(k, pa.bool_() if k == "clear" else pa.string() if k in ("kind", "fault") else pa.int32()) for k in headers.FIELDS])

    @F.arrow_udf(headers.FACTS)
    def read(formats: pa.Array, contents: pa.Array) -> pa.Array:
        names = formats.to_pylist()
        return pa.array([records.facts(f, records.in_memory(c.as_buffer())) if c.is_valid else None for f, c in zip(names, contents, strict=True)], kind)

    return read.asNondeterministic()(F.col("format"), F.when(F.col("format").isin("jpeg", "png", "webp", "pic"), F.col("content")))


def probe_header(sniffed: DataFrame) -> DataFrame:
    """width, height, channels and bits by format, and ``records``, what a walk over the records of a file finds (null for other formats).

    Rows of ``header_files`` have their records already.
    """
    if "records" not in sniffed.columns:
        sniffed = sniffed.withColumn("records", _records(sniffed))
    be = lambda at, n: be_int("content", at, n)
    le = lambda at, n: le_int("content", at, n)
    b = lambda at: byte_at("content", at)
    hdr = lambda k: F.regexp_extract(_hdr_header(), r"\A(?:[^\n]++\n)++\n-Y (\d+) +\+X (\d+)\n", k).try_cast("long")
    xbm = lambda k: F.regexp_extract(_text_header("xbm", r"(?s)_width\s+\d+\s.*_height\s+\d+\s"), rf"#define\s+\S*_{k}\s+(\d+)", 1).try_cast("long")
    xpm = lambda k: F.regexp_extract(_text_header("xpm", r'(?s)^[^"]*"[^"]*"'), r'^[^"]*"\s*(\d+)\s+(\d+)\s+\d+\s+\d+', k).try_cast("long")
    signed = lambda v: F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v)
    old = le(14, 4) == 12  # the first kind of bitmap header: sizes of 16 bits
    clear = F.coalesce(F.col("records.clear"), F.lit(False))
    png_channels = F.when(b(25) == 3, F.when(clear, 4).otherwise(3)).otherwise(F.when(clear, 1).otherwise(0) + F.when(b(25).bitwiseAND(F.lit(2)) != 0, 3).otherwise(1) + F.when(b(25).bitwiseAND(F.lit(4)) != 0, 1).otherwise(0))
    tga_bits = F.when(b(1) == 1, b(7)).otherwise(b(16))
    tga_channels = F.when(tga_bits == 8, 1).when((tga_bits == 16) & (b(2).isin(3, 11)), 2).when(tga_bits.isin(15, 16, 24), 3).otherwise(4)
    # format: width, height, channels, bits
    rules = {
        "png": (be(16, 4), be(20, 4), png_channels, b(24)),
        "bmp": (F.when(old, le(18, 2)).otherwise(le(18, 4)), F.when(old, le(20, 2)).otherwise(F.abs(signed(le(22, 4)))), F.when(~old & (le(28, 2) == 32), 4).otherwise(3), F.lit(8)),
        "gif": (le(6, 2), le(8, 2), F.lit(4), F.lit(8)),
        "psd": (be(18, 4), be(14, 4), F.lit(4), be(22, 2)),
        "pic": (be(92, 2), be(94, 2), F.when(clear, 4).otherwise(3), F.lit(8)),
        "jpeg": (F.col("records.width"), F.col("records.height"), F.when(F.col("records.components") >= 3, 3).otherwise(1), F.col("records.bits")),
        "pnm": (_pnm_number(1), _pnm_number(2), F.when(b(1) == 0x35, 1).otherwise(3), F.when(_pnm_number(3) > 255, 16).otherwise(8)),
        "hdr": (hdr(2), hdr(1), F.lit(3), F.lit(32)),
        "tga": (le(12, 2), le(14, 2), tga_channels, F.lit(8)),
        "webp": (F.col("records.width"), F.col("records.height"), F.lit(4), F.lit(8)),
        "qoi": (be(4, 4), be(8, 4), b(12), F.lit(8)),
        "xbm": (xbm("width"), xbm("height"), F.lit(3), F.lit(8)),
        "xpm": (xpm(1), xpm(2), F.lit(3), F.lit(8)),
        "pcx": (
            F.abs(le(8, 2) - le(4, 2)) + 1, F.abs(le(10, 2) - le(6, 2)) + 1,
            F.when((b(3) == 8) & (b(65) == 4), 4).otherwise(3), F.lit(8),
        ),
    }
    pick = lambda k: F.coalesce(*[F.when(F.col("format") == name, v[k].cast("long")) for name, v in rules.items()])
    return sniffed.withColumns({"width": pick(0), "height": pick(1), "channels": pick(2), "bits": pick(3)})


def is_16_bit() -> Column:
    return F.coalesce(F.col("format").isin("png", "psd", "pnm") & (F.col("bits") == 16), F.lit(False))


def is_hdr() -> Column:
    return magic("hdr")


def is_lossless_webp() -> Column:
    """Of probed rows: the first image record is a lossless one, wherever it stands."""
    return F.coalesce((F.col("format") == "webp") & (F.col("records.kind") == "VP8L"), F.lit(False))


def size_guard(headers: DataFrame) -> DataFrame:
    """``size_reason``: why an image of this size is refused, null if it is not. To be used before any explode."""
    w, h, c = (F.col(x).cast("decimal(38,0)") for x in ("width", "height", "channels"))
    return headers.withColumn(
        "size_reason",
        F.when((F.col("width") > MAX_DIM) | (F.col("height") > MAX_DIM), "too large")
        .when((F.col("format") == "pic") & (w * h > 1 << 28), "too large")
        .when((F.col("format") == "png") & (w * h * c > 1 << 30), "too large")
        .when(w * h * c > INT_MAX, "too large"),
    )


def validate_header(headers: DataFrame) -> DataFrame:
    """``reason``: the first rule that a header breaks, null if none."""
    f, b = F.col("format"), lambda at: byte_at("content", at)
    le, be = (lambda at, n: le_int("content", at, n)), (lambda at, n: be_int("content", at, n))
    old = le(14, 4) == 12
    size, offset = le(14, 4), le(10, 4)
    bpp = F.when(old, le(24, 2)).otherwise(le(28, 2))
    packed = ~old & (le(30, 4) == 3)  # colours by masks, which follow the shorter headers and lie within the longer ones
    masks = [F.when(size == 56, le(70 + 4 * k, 4)).otherwise(le(54 + 4 * k, 4)) for k in range(3)]
    header = 14 + size + F.when(packed & size.isin(40, 56), 12).otherwise(0)
    # palette entries by what stands before the pixels
    entries = F.when(bpp >= F.when(old, 24).otherwise(16), 0).when(old, ((offset - 38) / 3).cast("long")).otherwise(F.floor((offset - 14 - size) / 4))
    zero = F.coalesce((F.col("width") <= 0) | (F.col("height") <= 0), F.lit(False))
    rules = [
        (f == "unknown", "unknown image type"),
        ((f == "png") & (be(8, 4) != 13), "bad IHDR len"),
        ((f == "png") & ~b(24).isin(1, 2, 4, 8, 16), "1/2/4/8/16-bit only"),
        ((f == "png") & ((b(25) > 6) | b(25).isin(1, 5) | ((b(25) == 3) & (b(24) == 16))), "bad ctype"),
        ((f == "png") & (b(26) != 0), "bad comp method"),
        ((f == "png") & (b(27) != 0), "bad filter method"),
        ((f == "png") & (b(28) > 1), "bad interlace method"),
        ((f == "png") & zero, "0-pixel image"),
        ((f == "bmp") & (F.when(old, le(22, 2)).otherwise(le(26, 2)) != 1), "bad BMP"),
        ((f == "bmp") & ~old & le(30, 4).isin(1, 2), "BMP RLE"),
        ((f == "bmp") & ~old & (le(30, 4) >= 4), "BMP JPEG/PNG"),
        ((f == "bmp") & ~old & (le(30, 4) == 3) & ~le(28, 2).isin(16, 32), "bad BMP"),
        ((f == "bmp") & packed & size.isin(40, 56) & (masks[0] == masks[1]) & (masks[1] == masks[2]), "bad BMP"),
        ((f == "bmp") & (entries == 0) & ((offset < header) | (offset - header > 1024)), "bad offset"),
        ((f == "bmp") & (bpp < 16) & ((entries <= 0) | (entries > 256)), "invalid palette"),
        ((f == "bmp") & ~bpp.isin(1, 4, 8, 16, 24, 32), "bad bpp"),
        ((f == "bmp") & (bpp != 24) & (bpp >= 16) & (old | (packed & F.exists(F.array(*masks), lambda m: (m == 0) | (F.bit_count(m) > 8)))), "bad masks"),
        ((f == "psd") & (be(4, 2) != 1), "wrong version"),
        ((f == "psd") & (be(12, 2) > 16), "wrong channel count"),
        ((f == "psd") & ~be(22, 2).isin(8, 16), "unsupported bit depth"),
        ((f == "psd") & (be(24, 2) != 3), "wrong color format"),
        ((f == "pnm") & ((F.coalesce("width", F.lit(0)) == 0) | (F.coalesce("height", F.lit(0)) == 0)), "invalid width"),
        ((f == "pnm") & (_pnm_number(3) > 65535), "max value > 65535"),
        ((f == "hdr") & ~F.coalesce(_hdr_header().rlike(r"\A(?:[^\n]++\n)*?FORMAT=32-bit_rle_rgbe\n"), F.lit(False)), "unsupported format"),
        ((f == "hdr") & F.col("width").isNull(), "unsupported data layout"),
        ((f == "tga") & (b(1) == 1) & (le(5, 2) == 0), "bad palette"),
        (f.isin("jpeg", "webp", "pic") & F.col("records.fault").isNotNull(), F.col("records.fault")),
        ((f == "webp") & F.col("records").isNotNull() & F.col("records.kind").isNull(), "no image record"),
        ((f == "pcx") & ~F.when(b(3) == 1, b(65).isin(1, 2, 3, 4)).when(b(3) == 2, b(65).isin(1, 4)).when(b(3) == 4, b(65) <= 1).otherwise(b(65).isin(1, 3, 4)), "bad planes"),
        (f.isin("xbm", "xpm") & (F.coalesce("width", F.lit(0)) <= 0), "invalid width"),
        (F.col("width").isNull() | F.col("height").isNull(), "truncated header"),
        (zero, "0-pixel image"),
    ]
    broken = F.array_compact(F.array(*[F.when(rule, text if isinstance(text, Column) else F.lit(text)) for rule, text in rules]))
    # a one-row explode keeps filters on the reason above it; pushed down they would be expanded into every rule
    return headers.withColumn("reason", F.explode(F.array(F.get(broken, F.lit(0)))))


def quarantine_split(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, failed rows)."""
    return validated.where("reason is null"), validated.where("reason is not null")


def failure_report(validated: DataFrame) -> DataFrame:
    """Failures by format and reason, with their share of all files."""
    total = validated.agg(F.count(F.lit(1)).alias("total"))
    failed = validated.where("reason is not null").groupBy("format", "reason").agg(F.count(F.lit(1)).alias("files"))
    return failed.join(F.broadcast(total), F.lit(True)).withColumn("share", F.col("files") / F.col("total")).drop("total")  # one row


def decoded_size(headers: DataFrame) -> DataFrame:
    """Bytes of the decoded image and of the 24-bit bitmap rows."""
    w, h = F.col("width"), F.col("height")
    return headers.withColumns(
        {"decoded_bytes": F.floor(w * h * F.col("channels") * F.col("bits") / 8), "bitmap_bytes": F.floor((w * 24 + 31) / 32) * 4 * h}
    )


def extension_mismatch(sniffed: DataFrame) -> DataFrame:
    """Files whose name and mark disagree."""
    ext = F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1))
    same = {"jpg": "jpeg", "jpeg": "jpeg", "wbp": "webp", "web": "webp", "ppm": "pnm", "pgm": "pnm"}
    named = ext
    for a, b in same.items():
        named = F.when(ext == a, b).otherwise(named)
    return sniffed.withColumn("named", named).where(F.col("named") != F.col("format"))


def corpus_summary(validated: DataFrame) -> DataFrame:
    """Files, valid files, pixels, size range, 16-bit count, bytes and the mix of depths by format."""
    ok = F.col("reason").isNull()
    area = F.when(ok, F.col("width") * F.col("height"))
    return validated.groupBy("format").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(ok).alias("valid"), F.coalesce(F.sum(area), F.lit(0)).alias("pixels"),
        F.max(area).alias("largest"), F.min(area).alias("smallest"), F.count_if(is_16_bit()).alias("deep"),
        F.sum(F.octet_length("content")).alias("bytes"), *[F.count_if(F.col("bits") == n).alias(f"bits_{n}") for n in (8, 16, 32)],
    )


# container grammar: one symbol a record, states before and after it, faults as final states

PNG_FAULTS = (
    "first not IHDR", "multiple IHDR", "bad IHDR len", "invalid PLTE", "tRNS after IDAT", "tRNS before PLTE", "tRNS with alpha", "bad tRNS len",
    "no PLTE", "IDAT size limit", "no IDAT", "unknown critical chunk",
)
RIFF_FAULTS = ("second image record", "VP8L with ALPH")
PNG_SYMBOLS = ("CgBI", "IHDR", "IHDR bad", "PLTE", "PLTE empty", "PLTE bad", "tRNS", "tRNS alpha", "tRNS length", "tRNS paletted", "IDAT", "IDAT paletted", "IDAT large", "IDAT large paletted", "IEND", "other", "critical")
RIFF_SYMBOLS = ("VP8 ", "VP8L", "ALPH", "other")
IDAT_LIMIT = 1 << 30


def _png_table() -> list[list[int]]:
    """States: (IHDR seen, palette seen, IDAT seen); then the end of the file and the faults."""
    states = [(False, False, False), *((True, p, d) for p in (False, True) for d in (False, True))]
    end, fault = len(states), {text: len(states) + 1 + k for k, text in enumerate(PNG_FAULTS)}

    def after(state: tuple, symbol: str) -> int:
        head, palette, data = state
        kind, _, detail = symbol.partition(" ")
        if kind == "CgBI":
            return states.index(state)
        if kind == "IHDR":
            return fault["multiple IHDR"] if head else fault["bad IHDR len"] if detail else states.index((True, False, False))
        if not head:
            return fault["first not IHDR"]
        if kind == "PLTE":
            return fault["invalid PLTE"] if detail == "bad" else states.index((True, not detail, data))
        if kind == "tRNS":
            if data:
                return fault["tRNS after IDAT"]
            if detail == "paletted" and not palette:
                return fault["tRNS before PLTE"]
            broken = {"alpha": "tRNS with alpha", "length": "bad tRNS len"}.get(detail)
            return fault[broken] if broken else states.index(state)
        if kind == "IDAT":
            if "paletted" in detail and not palette:
                return fault["no PLTE"]
            return fault["IDAT size limit"] if "large" in detail else states.index((True, palette, True))
        if kind == "IEND":
            return end if data else fault["no IDAT"]
        return fault["unknown critical chunk"] if kind == "critical" else states.index(state)

    return [[after(state, symbol) for symbol in PNG_SYMBOLS] for state in states]


def _riff_table() -> list[list[int]]:
    """States: nothing, ALPH, VP8 with or without ALPH, VP8L; then the faults."""
    second, mixed = 5, 6
    return [[2, 4, 1, 0], [3, mixed, 1, 1], [second, second, 3, 2], [second, second, 3, 3], [second, second, mixed, 4]]


def _png_symbol(paletted: Column, channels: Column) -> Column:
    kind, length = F.col("type"), F.col("length")
    number = lambda text: F.lit(PNG_SYMBOLS.index(text))
    large = length > IDAT_LIMIT
    return (
        F.when(kind == "CgBI", number("CgBI"))
        .when(kind == "IHDR", F.when(length == 13, number("IHDR")).otherwise(number("IHDR bad")))
        .when(kind == "PLTE", F.when((length > 768) | (length % 3 != 0), number("PLTE bad")).when(length == 0, number("PLTE empty")).otherwise(number("PLTE")))
        .when(kind == "tRNS", F.when(paletted, number("tRNS paletted")).when(channels % 2 == 0, number("tRNS alpha")).when(length != 2 * channels, number("tRNS length")).otherwise(number("tRNS")))
        .when(kind == "IDAT", F.when(large & paletted, number("IDAT large paletted")).when(large, number("IDAT large")).when(paletted, number("IDAT paletted")).otherwise(number("IDAT")))
        .when(kind == "IEND", number("IEND"))
        .when(kind.substr(1, 1).rlike("[A-Z]"), number("critical")).otherwise(number("other"))
    )


def check_chunk_order(chunks: DataFrame, images: DataFrame, block: int = automaton.BLOCK) -> DataFrame:
    """(image_id, reason): the first rule of sequence that the chunks of a PNG file break, in the order of the file; null if none.

    ``chunks`` is (image_id, chunk_no, type, length), ``images`` (image_id, ctype), the colour type of the header. The
    chunks run through a finite automaton; an image whose chunks end before IEND has the reason ``no IEND``. Only
    the length of a tRNS beside that of its palette is no matter of states: it is compared among these two kinds of chunks.
    """
    typed = chunks.join(images.select("image_id", "ctype"), "image_id", "left")
    paletted = F.coalesce(F.col("ctype") == 3, F.lit(False))
    channels = F.when(F.col("ctype").bitwiseAND(F.lit(2)) != 0, 3).otherwise(1) + F.when(F.col("ctype").bitwiseAND(F.lit(4)) != 0, 1).otherwise(0)
    symbols = typed.select("image_id", "chunk_no", _png_symbol(paletted, F.coalesce(channels, F.lit(1))).alias("symbol"))
    table = _png_table()
    ended = automaton.run(symbols, "image_id", "chunk_no", "symbol", table, block=block)
    before = Window.partitionBy("image_id").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    colours = F.last(F.when(F.col("type") == "PLTE", F.floor(F.col("length") / 3)), ignorenulls=True).over(before)
    short = typed.where(paletted & F.col("type").isin("PLTE", "tRNS")).withColumn("colours", colours).where("type = 'tRNS' and length > colours")
    wrong = short.groupBy("image_id").agg(F.min("chunk_no").cast("long").alias("wrong_at"))
    names = F.array(*[F.lit(text) for text in PNG_FAULTS])
    fault = F.get(names, F.col("state") - len(table) - 1)
    reason = F.when(F.col("wrong_at") < F.coalesce("at", F.lit(1 << 62)), "bad tRNS len").when(F.col("state") < len(table), "no IEND").otherwise(fault)
    return ended.join(wrong, "image_id", "left").select("image_id", reason.alias("reason"))


def check_riff_order(chunks: DataFrame, block: int = automaton.BLOCK) -> DataFrame:
    """(image_id, reason): as ``check_chunk_order`` for the records of WebP files; ``no image record`` if there is none."""
    kind = F.col("type")
    symbol = F.coalesce(*[F.when(kind == text, k) for k, text in enumerate(RIFF_SYMBOLS)], F.lit(len(RIFF_SYMBOLS) - 1))
    table = _riff_table()
    ended = automaton.run(chunks.select("image_id", "chunk_no", symbol.alias("symbol")), "image_id", "chunk_no", "symbol", table, block=block)
    names = F.array(*[F.lit(text) for text in RIFF_FAULTS])
    return ended.select("image_id", F.when(F.col("state") <= 1, "no image record").otherwise(F.get(names, F.col("state") - len(table))).alias("reason"))


def probe_jpeg(chunks: DataFrame) -> DataFrame:
    """Header of JPEG files from their first frame record, wherever it stands: (file_id, width, height, channels, bits).

    The fields are in the record's first bytes, so no content is joined. A record that is cut off before its sizes gives no row.
    """
    frame = chunks.where("container = 'jpeg' and type in ('C0', 'C1', 'C2')").groupBy("file_id").agg(F.min_by("head", "offset").alias("content"))
    return frame.select(
        "file_id", be_int("content", 3, 2).alias("width"), be_int("content", 1, 2).alias("height"),
        F.when(byte_at("content", 5) >= 3, 3).otherwise(1).alias("channels"), byte_at("content", 0).alias("bits"),
    ).where("width is not null")
