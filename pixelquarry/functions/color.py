"""Column functions over channel values: luma, channel counts, depths, colour models, hashes, byte integers.

Channels are int 0..255 unless a function says otherwise. Every function is plain Column to Column,
so all of it runs inside generated code. A null channel gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str | int | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def _asr(x: Column, bits: int) -> Column:
    return F.shiftright(x, bits)


def clamp_byte(x) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), _c(x)))


def luma8(r, g, b) -> Column:
    """Grey of 8-bit channels, weights 77, 150, 29 of 256; 16-bit channels alike."""
    return _asr(_c(r) * 77 + _c(g) * 150 + _c(b) * 29, 8)


luma16 = luma8


def luma_mono(r, g, b) -> Column:
    """Grey for mono dithering, weights 77, 151, 28 of 256."""
    return _asr(_c(r) * 77 + _c(g) * 151 + _c(b) * 28, 8)


def convert_channels(channels: list, n: int, m: int, full: int = 255) -> list[Column]:
    """n channels (1 grey, 2 grey and alpha, 3 colour, 4 colour and alpha) as m channels."""
    c = [_c(x) for x in channels[:n]]
    alpha = c[n - 1] if n in (2, 4) else F.lit(full)
    if m in (1, 2):
        return [c[0] if n <= 2 else luma8(*c[:3]), alpha][:m]
    return [*([c[0]] * 3 if n <= 2 else c[:3]), alpha][:m]


def to_8bit(v) -> Column:
    return _asr(_c(v), 8)


def to_16bit(v) -> Column:
    return _c(v) * 257


def scale_bits(v, depth: int) -> Column:
    """A 1, 2, 4 or 8-bit sample as 8 bits."""
    return _c(v) * (255 // ((1 << depth) - 1))


def expand_bits(v, bits: int) -> Column:
    """A 1 to 8-bit sample as 8 bits by repeating its bits; 0 bits give 0."""
    if bits == 0:
        return F.lit(0)
    value, filled = _c(v), bits
    out = F.shiftleft(value, 8 - bits)
    while filled < 8:  # the next copy of the bits stands below the last one
        shift = 8 - bits - filled
        out = out + (F.shiftleft(value, shift) if shift >= 0 else _asr(value, -shift))
        filled += bits
    return out


def rgb555(word) -> list[Column]:
    """Red, green and blue of a 15-bit word, each c * 255 / 31 in integers."""
    return [F.floor((_asr(_c(word), s).bitwiseAND(F.lit(31)) * 255) / 31).cast("int") for s in (10, 5, 0)]


# Channel masks of pixel words (r, g, b, a) that have none of their own.
DEFAULT_MASKS = {16: (0x7C00, 0x3E0, 0x1F, 0), 32: (0xFF0000, 0xFF00, 0xFF, 0xFF000000)}


def masked_rgba(word, bits: int, masks: tuple[int, int, int, int] | None = None) -> list[Column]:
    """The channels of a 16 or 32-bit pixel word; without masks those of its width. Without an alpha mask a is 255."""
    r, g, b, a = masks or DEFAULT_MASKS[bits]
    return [mask_extract(word, r), mask_extract(word, g), mask_extract(word, b), mask_extract(word, a) if a else F.lit(255)]


def mask_extract(word, mask: int) -> Column:
    """The bits of a mask as 8 bits; a mask of more than 8 bits is refused."""
    bits = bin(mask).count("1")
    if bits > 8:
        raise ValueError("a channel mask has at most 8 bits")
    if not mask:
        return F.lit(0)
    low = (mask & -mask).bit_length() - 1
    return expand_bits(_asr(_c(word).cast("long").bitwiseAND(F.lit(mask)), low).cast("int"), bits)


def ldr_to_hdr(v, gamma: float = 2.2, scale: float = 1.0) -> Column:
    return F.pow(_c(v) / 255.0, F.lit(gamma)) * scale


def hdr_to_ldr(v, gamma: float = 2.2, scale: float = 1.0) -> Column:
    """A linear float as 8 bits: inverse gamma, rounded, clamped."""
    x = F.pow(_c(v) / scale, F.lit(1 / gamma)) * 255 + 0.5
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x))).cast("int")


def rgbe_to_float(c, e) -> Column:
    """c * 2^(e - 136); a zero exponent is black."""
    return F.when(_c(e) == 0, F.lit(0.0)).otherwise(_c(c) * F.pow(F.lit(2.0), _c(e) - 136))


def ycbcr_to_rgb(y, cb, cr) -> list[Column]:
    """JPEG colours in 20-bit fixed point, coefficients of 12 bits shifted by 8, rounded."""
    fixed = lambda x: int(x * 4096.0 + 0.5) << 8
    base = F.shiftleft(_c(y), 20) + (1 << 19)
    u, v = _c(cb) - 128, _c(cr) - 128
    green = base - v * fixed(0.71414) + (u * -fixed(0.34414)).bitwiseAND(F.lit(-65536))
    return [clamp_byte(_asr(x, 20)) for x in (base + v * fixed(1.40200), green, base + u * fixed(1.77200))]


def yuv_to_rgb(y, u, v) -> list[Column]:
    """Video colours by 8-bit products and a 6-bit final shift."""
    hi = lambda x, k: _asr(_c(x) * k, 8)
    rows = (
        hi(y, 19077) + hi(v, 26149) - 14234,
        hi(y, 19077) - hi(u, 6419) - hi(v, 13320) + 8708,
        hi(y, 19077) + hi(u, 33050) - 17685,
    )
    return [clamp_byte(_asr(x, 6)) for x in rows]


def byte_product(x, y) -> Column:
    """Rounded x * y / 255 of two bytes."""
    t = _c(x) * _c(y) + 128
    return _asr(t + _asr(t, 8), 8)


def cmyk_to_rgb(c, m, y, k) -> list[Column]:
    """Inverted-ink CMYK: each ink times black."""
    return [byte_product(x, k) for x in (c, m, y)]


def ycck_to_rgb(y, cb, cr, k) -> list[Column]:
    return [byte_product(255 - x, k) for x in ycbcr_to_rgb(y, cb, cr)]


def jpeg_color_model(ids, components, adobe, jfif) -> Column:
    """Colour model from component ids (as text), component count, Adobe transform (-1 absent) and JFIF."""
    n, a = _c(components), _c(adobe)
    return (
        F.when((n == 3) & ((_c(ids) == "RGB") | ((a == 0) & ~_c(jfif))), "rgb")
        .when(n == 3, "ycbcr")
        .when((n == 4) & (a == 0), "cmyk")
        .when((n == 4) & (a == 2), "ycck")
        .when(n == 4, "ycbcr")
        .otherwise("grey")
    )


def unpremultiply(c, a) -> Column:
    """(c * 255 + a / 2) / a in integers, wrapped to a byte; untouched where alpha is 0."""
    c, a = _c(c), _c(a)
    return F.when(a > 0, F.floor((c * 255 + F.floor(a / 2)) / a).cast("int") % 256).otherwise(c)


def remove_white_matte(c, a, full: int = 255) -> Column:
    """Undo blending with white for partly transparent pixels, truncated."""
    c, a = _c(c), _c(a)
    share = a / float(full)
    out = (c / share + full * (1 - 1 / share)).cast("int")
    return F.when((a != 0) & (a != full), out).otherwise(c)


def color_key_alpha(channels: list, key: list, full: int = 255) -> Column:
    """Alpha 0 where the colour is the key, else full."""
    same = F.lit(True)
    for c, k in zip(channels, key, strict=True):
        same = same & (_c(c) == _c(k))
    return F.when(same, 0).otherwise(full)


def bucket5(v) -> Column:
    return _asr(_c(v), 3)


def color_distance(a: list, b: list) -> Column:
    dr, dg, db = (_c(x) - _c(y) for x, y in zip(a, b, strict=True))
    return dr * dr * 2 + dg * dg * 4 + db * db * 3


def slot_hash(r, g, b, a) -> Column:
    return (_c(r) * 3 + _c(g) * 5 + _c(b) * 7 + _c(a) * 11) % 64


def cache_hash(argb, bits: int) -> Column:
    """Top bits of a 32-bit multiplicative hash."""
    product = (_c(argb).cast("decimal(20,0)") * F.lit(0x1E35A7BD).cast("decimal(20,0)")) % F.lit(1 << 32).cast("decimal(20,0)")
    return F.shiftright(product.cast("long"), 32 - bits).cast("int")


def green_decorrelate(r, g, b) -> list[Column]:
    """Red and blue less green, modulo 256."""
    return [F.pmod(_c(r) - _c(g), F.lit(256)), _c(g), F.pmod(_c(b) - _c(g), F.lit(256))]


def green_correlate(r, g, b) -> list[Column]:
    return [F.pmod(_c(r) + _c(g), F.lit(256)), _c(g), F.pmod(_c(b) + _c(g), F.lit(256))]


def paeth(a, b, c) -> Column:
    """Left, up or upper left, whichever is nearest to left + up - upper left; ties in that order."""
    a, b, c = _c(a), _c(b), _c(c)
    p = a + b - c
    da, db, dc = F.abs(p - a), F.abs(p - b), F.abs(p - c)
    return F.when((da <= db) & (da <= dc), a).when(db <= dc, b).otherwise(c)


def default_channel(v, kind: str, full: int = 255) -> Column:
    """An absent channel: colour 0, alpha full."""
    return F.coalesce(_c(v), F.lit(full if kind == "alpha" else 0))


def rgbe_grey(r, g, b, e) -> Column:
    """One or two channels of a shared-exponent pixel: the mean of its three; a zero exponent is black."""
    return rgbe_to_float(_c(r) + _c(g) + _c(b), e) / 3


def linear_pixels(v, bits: int) -> Column:
    """An 8 or 16-bit sample as a linear float."""
    return ldr_to_hdr(to_8bit(v) if bits == 16 else v)


def linear_rgb(r, g, b, e, bits) -> list[Column]:
    """The colours of a pixel as linear floats: of 8 or 16-bit samples, or (bits 32) of a shared exponent ``e``."""
    return [F.when(_c(bits) == 32, rgbe_to_float(v, e)).when(_c(bits) == 16, linear_pixels(v, 16)).otherwise(linear_pixels(v, 8)) for v in (r, g, b)]


def alpha_plane(side_green=None, raw=None) -> Column:
    """Alpha from the green of a side image, else raw bytes, else opaque."""
    return F.coalesce(*[_c(x) for x in (side_green, raw) if x is not None], F.lit(255))


def raster_order(y, x, width) -> Column:
    """Linear position of a pixel."""
    return _c(y).cast("long") * _c(width) + _c(x)


def raster_place(pos, width: int) -> list[Column]:
    """Row and column of a linear position."""
    return [F.floor(_c(pos) / width).cast("int"), (_c(pos) % width).cast("int")]


def byte_at(content, at) -> Column:
    """Byte at an offset of a binary column (offset a number or column); null past the end."""
    content, at = _c(content), _c(at) if isinstance(at, (Column, str)) else F.lit(at)
    piece = F.hex(content.substr(at.cast("int") + 1, F.lit(1)))
    return F.when(piece != "", F.conv(piece, 16, 10).cast("long"))


def be_int(content, at, width: int) -> Column:
    """Unsigned big-endian integer of ``width`` bytes; null if it is cut short."""
    content, at = _c(content), _c(at) if isinstance(at, (Column, str)) else F.lit(at)
    piece = F.hex(content.substr(at.cast("int") + 1, F.lit(width)))
    return F.when(F.length(piece) == 2 * width, F.conv(piece, 16, 10).cast("long"))


def le_int(content, at, width: int) -> Column:
    """Unsigned little-endian integer of ``width`` bytes; null if it is cut short."""
    content, at = _c(content), _c(at) if isinstance(at, (Column, str)) else F.lit(at)
    piece = F.hex(content.substr(at.cast("int") + 1, F.lit(width)))
    turned = F.concat(*[F.substring(piece, 2 * k + 1, 2) for k in reversed(range(width))])
    return F.when(F.length(piece) == 2 * width, F.conv(turned, 16, 10).cast("long"))
