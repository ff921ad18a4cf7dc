"""A Spark data source for concatenated zlib documents with a side index of their compressed sizes.

``x.pkz`` holds the blocks, ``x.pkz.idx`` their sizes as little-endian 32-bit integers. Splits take blocks until they reach
``bytespermap`` (32 MiB by default). A damaged block yields what can be read of it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 32 << 20


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class Split(InputPartition):
    """Blocks of one file: where the first begins, and the sizes of all."""

    def __init__(self, path: str, start: int, sizes: list[int]):
        self.path, self.start, self.sizes = path, start, sizes


def plan_splits(path: str, sizes: list[int], split_bytes: int = SPLIT_BYTES) -> list[Split]:
    out, at, held, total = [], 0, [], 0
    for size in sizes:
        held.append(size)
        total += size
        if total >= split_bytes:
            out.append(Split(path, at, held))
            at, held, total = at + total, [], 0
    return [*out, Split(path, at, held)] if held else out


def inflate(raw: bytes) -> str:
    """The text of a block, or of its readable part."""
    decoder, parts = zlib.decompressobj(), []
    try:
        parts.append(decoder.decompress(raw))
        parts.append(decoder.flush())
    except zlib.error:
        # Byte by byte up to the damage.
        decoder, parts = zlib.decompressobj(), []
        try:
            for i in range(len(raw)):
                parts.append(decoder.decompress(raw[i : i + 1]))
        except zlib.error:
            pass
    return b"".join(parts).decode("utf-8", "replace")


class _Reader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def partitions(self) -> list[Split]:
        from pyarrow import fs

        system, base = _system(self.path)
        info = system.get_file_info(base)
        names = [base] if info.type == fs.FileType.File else sorted(x.path for x in system.get_file_info(fs.FileSelector(base, recursive=True)) if x.path.endswith(".pkz"))
        out = []
        for name in names:
            with system.open_input_stream(f"{name}.idx") as f:
                raw = f.read()
            scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
            out += plan_splits(scheme + name, list(struct.unpack(f"<{len(raw) // 4}i", raw)), self.split_bytes)
        return out or [Split(self.path, 0, [])]

    def read(self, partition: Split) -> Iterator[tuple]:
        if not partition.sizes:
            return
        system, base = _system(partition.path)
        with system.open_input_file(base) as f:
            at = partition.start
            f.seek(at)
            for size in partition.sizes:
                yield partition.path, at, inflate(f.read(size))
                at += size


class IndexedDeflate(DataSource):
    """format("indexed_deflate"): path, offset of the block, document."""

    @classmethod
    def name(cls) -> str:
        return "indexed_deflate"

    def schema(self) -> str:
        return "path string, offset bigint, document string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("bytespermap", SPLIT_BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(IndexedDeflate)


def write_indexed_deflate(path: str, documents: list[str]) -> None:
    """Writes path and its index: for small files and tests."""
    blocks = [zlib.compress(d.encode()) for d in documents]
    system, base = _system(path)
    with system.open_output_stream(base, compression=None) as f:
        f.write(b"".join(blocks))
    with system.open_output_stream(f"{base}.idx", compression=None) as f:
        f.write(struct.pack(f"<{len(blocks)}i", *map(len, blocks)))
