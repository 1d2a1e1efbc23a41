"""Image files as tables: raw and decoded readers, text rasters, container chunks, user decoders and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from pixelquarry.session import ship
from pixelquarry.sources import records

# Extensions that are taken as images.
EXTENSIONS = "jpg png gif bmp tga pnm ppm pgm webp web wbp pcx xbm xpm qoi".split()
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def _glob(exts) -> str:
    both = [e for x in exts for e in (x.lower(), x.upper())]
    return "*.{" + ",".join(both) + "}"


def read_image_files(spark: SparkSession, path: str, exts=EXTENSIONS) -> DataFrame:
    """(path, modificationTime, length, content) of all files below a path; ``exts=None`` takes every file."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", _glob(exts)) if exts else reader).load(path)


def read_decoded_images(spark: SparkSession, path: str, drop_invalid: bool = False) -> DataFrame:
    """(path, width, height, channels, bgr): pixels of the formats that Spark decodes; a failed file has width -1."""
    df = spark.read.format("image").option("dropInvalid", str(drop_invalid).lower()).load(path)
    return df.select(F.col("image.origin").alias("path"), *[F.col(f"image.{a}").alias(b) for a, b in (("width", "width"), ("height", "height"), ("nChannels", "channels"), ("data", "bgr"))])


def stream_image_files(spark: SparkSession, path: str, exts=EXTENSIONS) -> DataFrame:
    """New files below a path, as a stream."""
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", _glob(exts)) if exts else reader).load(path)


def write_bmp_corpus(packed: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Save packed bitmaps; an existing folder is an error unless another mode is given."""
    packed.write.mode(mode).parquet(path)


def _latin(content: str = "content"):
    return F.decode(F.col(content), "ISO-8859-1")


def explode_xbm(files: DataFrame) -> DataFrame:
    """(file_id, y, x, v): bits low first, each row from a new byte; a set bit is black (0), others 255.

    Both ``static char`` and ``static unsigned char`` arrays are read. Bytes that the text lacks give no rows.
    """
    text = _latin()
    size = lambda k: F.regexp_extract(text, rf"#define\s+\S*_{k}\s+(\d+)", 1).try_cast("int")
    body = F.regexp_extract(text, r"(?s)static\s+(?:unsigned\s+)?char[^{]*\{(.*)", 1)
    data = F.regexp_extract_all(body, F.lit("0[xX]([0-9a-fA-F]{1,2})"), F.lit(1))
    at = files.select("file_id", size("width").alias("w"), size("height").alias("h"), data.alias("d")).where("w > 0 and h > 0")
    bytes_ = at.select("file_id", "w", "h", F.floor((F.col("w") + 7) / 8).cast("int").alias("stride"), F.posexplode("d").alias("i", "hex"))
    bits = bytes_.select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    x = F.col("i") % F.col("stride") * 8 + F.col("bit")
    y = F.floor(F.col("i") / F.col("stride")).cast("int")
    on = F.call_function("shiftright", F.conv("hex", 16, 10).cast("int"), F.col("bit")).bitwiseAND(F.lit(1)) == 1
    return bits.withColumns({"x": x, "y": y, "v": F.when(on, 0).otherwise(255)}).where("x < w and y < h").select("file_id", "y", "x", "v")


def explode_xpm(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, colors): keys of all pixels, and each declared key with its ``#rrggbb`` colour and place.

    A colour without ``#`` is null. Join them with ``xpm_key_join``.
    """
    quoted = F.regexp_extract_all(_latin(), F.lit('"([^"]*)"'), F.lit(1))
    head = F.split(F.trim(F.get("q", F.lit(0))), r"\s+")
    num = lambda k: F.get(head, F.lit(k)).try_cast("int")
    at = files.select("file_id", quoted.alias("q")).withColumns({"w": num(0), "h": num(1), "n": num(2), "cpp": num(3)}).where("w > 0 and h > 0 and cpp > 0")
    lines = at.select("file_id", "w", "h", "n", "cpp", F.posexplode("q").alias("i", "s"))
    hexed = F.regexp_extract("s", r"#([0-9a-fA-F]{6})[^#]*$", 1)
    part = lambda k: F.when(hexed != "", F.conv(F.substring(hexed, k, 2), 16, 10).cast("int"))
    colors = lines.where("i between 1 and n").select(F.col("file_id").alias("image_id"), F.expr("substring(s, 1, cpp)").alias("key"), (F.col("i") - 1).alias("pos"), part(1).alias("r"), part(3).alias("g"), part(5).alias("b"))
    rows = lines.where("i > n and i <= n + h").withColumn("x", F.explode(F.expr("sequence(0, w - 1)")))
    cells = rows.select(F.col("file_id").alias("image_id"), (F.col("i") - F.col("n") - 1).alias("y"), "x", F.expr("substring(s, x * cpp + 1, cpp)").alias("key"))
    return cells, colors


CHUNKS = "chunk_no int, container string, type string, offset long, length long, head binary"


@udtf(returnType=CHUNKS)
class ListChunks:
    """A table function of a file's content: its records, yielded one at a time."""

    def eval(self, content: bytes):
        if content is not None:
            for k, r in enumerate(records.walk(records.in_memory(content))):
                if r.container != "pic":
                    yield k, *r


def list_chunks(files: DataFrame) -> DataFrame:
    """(file_id, chunk_no, container, type, offset, length, head): the records of PNG, RIFF, JPEG and GIF files; other files have none.

    ``head`` holds the first bytes of a record's payload. In SQL the table function is ``list_chunks(content)``,
    called through LATERAL.
    """
    spark = files.sparkSession
    ship(spark)
    spark.udtf.register("list_chunks", ListChunks)
    return files.lateralJoin(ListChunks(F.col("content").outer())).select("file_id", *[c.split()[0] for c in CHUNKS.split(", ")])


DECODED = "file_id long, width int, height int, channels int, pixels binary, reason string"


def map_decoder(files: DataFrame, decode: Callable[[bytes], tuple[int, int, int, bytes]]) -> tuple[DataFrame, DataFrame]:
    """(images, bad): a decoder of the user's run over the corpus; what it raises becomes the reason."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, content in zip(pdf["file_id"], pdf["content"], strict=True):
                try:
                    w, h, c, raw = decode(bytes(content))
                    rows.append((i, w, h, c, raw, None if w > 0 and h > 0 else "0-pixel image"))
                except Exception as e:  # noqa: BLE001  any failure of a foreign decoder is a reason
                    rows.append((i, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["file_id", "width", "height", "channels", "pixels", "reason"]).astype({c: "Int32" for c in ("width", "height", "channels")})

    out = files.select("file_id", "content").mapInPandas(run, DECODED)
    return out.where("reason is null"), out.where("reason is not null")


def as_files(rows: DataFrame) -> DataFrame:
    """A table with hex text ``hx`` as files with ``content``."""
    return rows.withColumn("content", F.unhex("hx")).drop("hx")
