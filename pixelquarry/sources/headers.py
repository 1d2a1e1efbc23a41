"""Headers of image files without their payloads: a data source that lists files as partitions and reads ranges.

``header_files`` gives one row a file: its path and length, as many first bytes as the header rules look at
(the whole text header of PNM and HDR files), what a walk over its records found, and how many bytes were fetched in how
many reads. So a folder of large files costs some kilobytes each, and ``catalogue.sniff_format``, ``probe_header`` and
``validate_header`` work on these rows as on whole files.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pixelquarry.session import ship
from pixelquarry.sources import records
from pixelquarry.sources.images import EXTENSIONS

FACTS = "struct<kind: string, bits: int, height: int, width: int, components: int, clear: boolean, fault: string>"
#: First bytes that are given out: more than any fixed offset of the header rules.
PREFIX = 512
FIELDS = ("kind", "bits", "height", "width", "components", "clear", "fault")


@dataclass
class Files(InputPartition):
    """Names and sizes of the files of one task."""

    files: tuple[tuple[str, int], ...]


def header_of(read: records.Read, size: int) -> tuple[bytes, dict | None]:
    """(first bytes, facts of the records) of one file."""
    head = read(0, PREFIX)
    end = len(head)
    if head[:2] in (b"P5", b"P6"):
        end = records.text_end(read, "pnm")
    elif head[:2] == b"#?":
        end = records.text_end(read, "hdr")
    elif head and not head.strip(b"\xff"):  # fill before the mark
        while end < size and read(end, 1) == b"\xff":
            end += 1
        end += 1
    kind = records.container(head[:12])
    form = "webp" if kind == "riff" and head[8:12] == b"WEBP" else kind
    return b"".join(read(at, min(4096, end - at)) for at in range(0, end, 4096)) if end > PREFIX else head, records.facts(form, read) if form else None


class HeaderReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.step = options["path"], int(options.get("readBytes", 4096))
        self.exts = set(options.get("extensions", ",".join(EXTENSIONS)).lower().split(","))
        self.per_task = int(options.get("filesPerPartition", 256))

    def partitions(self) -> list[InputPartition]:
        """The files below the path in slices of ``filesPerPartition``; names and sizes only, as Spark's own listing holds them."""
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and ("*" in self.exts or f.extension.lower() in self.exts))
        return [Files(tuple(files[k : k + self.per_task])) for k in range(0, len(files), self.per_task)]

    def read(self, partition: Files) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        for path, size in partition.files:
            with store.open_input_file(path) as f:
                window = records.Window(lambda at, n, f=f: f.read_at(n, at), size, self.step)
                content, facts = header_of(window, size)
            yield path, size, content, None if facts is None else tuple(facts.get(k) for k in FIELDS), window.bytes_read, window.reads


class HeaderSource(DataSource):
    """Options: ``path`` (any address of pyarrow's file systems), ``extensions`` (comma-separated, ``*`` for all), ``filesPerPartition``, ``readBytes``."""

    @classmethod
    def name(cls) -> str:
        return "image_headers"

    def schema(self) -> str:
        return f"path string, length long, content binary, records {FACTS}, bytes_read long, reads int"

    def reader(self, schema) -> DataSourceReader:
        return HeaderReader(self.options)


def header_files(spark: SparkSession, path: str, exts=EXTENSIONS, files_per_partition: int = 256, read_bytes: int = 4096) -> DataFrame:
    """(path, length, content, records, bytes_read, reads) of all files below a path; ``exts=None`` takes every file."""
    ship(spark)
    spark.dataSource.register(HeaderSource)
    reader = spark.read.format("image_headers").option("extensions", ",".join(exts) if exts else "*")
    return reader.option("filesPerPartition", files_per_partition).option("readBytes", read_bytes).load(path)
