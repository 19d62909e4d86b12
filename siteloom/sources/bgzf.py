"""Block-compressed gzip: reading in parallel by ranges of compressed bytes, and writing part files.

A member's extra field ``BC`` holds its size, so a range's first block is found by its beginning and that of the block after it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.sources.header import Header, parse_header

#: Text in a block; the format's limit is 64 KB compressed.
BLOCK = 0xFF00
#: Compressed bytes in a range that one task reads.
RANGE = 1 << 22
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


class BgzfError(ValueError):
    pass


def compress_block(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def compress(data: bytes, level: int = 6, end: bool = True) -> bytes:
    return b"".join(compress_block(data[i : i + BLOCK], level) for i in range(0, len(data), BLOCK)) + (END if end else b"")


def blocks(data: bytes) -> Iterator[tuple[int, int]]:
    """(offset, size) of each block."""
    at = 0
    while at < len(data):
        if data[at : at + 4] != b"\x1f\x8b\x08\x04":
            raise BgzfError(f"no block at {at}")
        extra = struct.unpack_from("<H", data, at + 10)[0]
        field, size = at + 12, None
        while field < at + 12 + extra:
            a, b, n = struct.unpack_from("<2BH", data, field)
            if (a, b) == (66, 67):
                size = struct.unpack_from("<H", data, field + 4)[0] + 1
            field += 4 + n
        if size is None:
            raise BgzfError(f"block at {at} has no size")
        yield at, size
        at += size


def decompress_block(data: bytes) -> bytes:
    extra = struct.unpack_from("<H", data, 10)[0]
    out = zlib.decompress(data[12 + extra : -8], -15)
    if zlib.crc32(out) != struct.unpack("<I", data[-8:-4])[0]:
        raise BgzfError("checksum of a block is wrong")
    return out


def open_file(path: str):  # noqa: ANN201
    """A file of any file system that pyarrow knows (local, hdfs, s3, ...), for reading at offsets."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


def _size_at(head: bytes) -> int | None:
    """The size of the block that begins with ``head``; None if none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    extra = struct.unpack_from("<H", head, 10)[0]
    at = 12
    while at + 6 <= min(12 + extra, len(head)):
        a, b, n = struct.unpack_from("<2BH", head, at)
        if (a, b, n) == (66, 67, 2):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + n
    return None


def find_block(f, at: int, size: int) -> int | None:  # noqa: ANN001
    """The first block at or after offset ``at``: a block's beginning after which another, or the file's end, follows."""
    held = f.read_at(min(1 << 17, size - at), at)
    i = held.find(b"\x1f\x8b\x08\x04")
    while i >= 0:
        n = _size_at(held[i : i + 64])
        if n is not None:
            after = at + i + n
            if after == size or (after < size and _size_at(f.read_at(min(64, size - after), after)) is not None):
                return at + i
        i = held.find(b"\x1f\x8b\x08\x04", i + 1)
    return None


def texts_from(f, at: int, size: int) -> Iterator[tuple[int, bytes]]:  # noqa: ANN001
    """(offset, text) of each block from the one at ``at`` to the file's end, read a few megabytes at a time."""
    held, base = b"", at
    while at < size:
        if at + (1 << 16) > base + len(held) < size:
            held, base = f.read_at(min(1 << 22, size - at), at), at
        n = _size_at(held[at - base : at - base + 64])
        if n is None:
            raise BgzfError(f"no block at {at}")
        yield at, decompress_block(held[at - base : at - base + n])
        at += n


def range_lines(f, start: int, end: int, size: int) -> Iterator[list[bytes]]:  # noqa: ANN001
    """Lines of the blocks that begin from ``start`` to before ``end``, in lots. A range but the first leaves out what comes before its first
    line end, and reads on to the first line end past its own blocks, so that ranges together give every line once."""
    at = find_block(f, start, size) if start else 0
    if at is None or at >= end:
        return
    held, skip = b"", start > 0
    for offset, text in texts_from(f, at, size):
        if offset >= end:
            cut = text.find(b"\n")
            if skip:
                return
            if cut < 0:
                held += text
                continue
            yield [held + text[:cut]]
            return
        if skip:
            cut = text.find(b"\n")
            if cut < 0:
                continue
            text, skip = text[cut + 1 :], False
        lines = (held + text).split(b"\n")
        held = lines.pop()
        if lines:
            yield lines
    if held and not skip:
        yield [held]


def file_ranges(spark: SparkSession, path: str, step: int = RANGE) -> DataFrame:
    """(path, nth, file, start, end, size): ranges of the files, a task's work each. Only names and sizes are gathered."""
    files = sorted((r["path"], r["length"]) for r in spark.read.format("binaryFile").load(path).select("path", "length").collect() if r["length"])
    rows = [(name, i, k, at, min(at + step, size), size) for k, (name, size) in enumerate(files) for i, at in enumerate(range(0, size, step))]
    made = spark.createDataFrame(rows, "path string, nth long, file long, start long, end long, size long")
    return made.repartitionByRange(max(1, min(len(rows), 100_000)), "file", "nth")


def read_lines(spark: SparkSession, path: str, step: int = RANGE) -> DataFrame:
    """(value, ord): whole lines in the files' order, read in parallel by ranges of compressed bytes; no file is held whole and nothing is shuffled but names."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for r in p.itertuples(index=False):
                n = (r.file << 50) + (r.nth << 27)
                with open_file(r.path) as f:
                    for lines in range_lines(f, r.start, r.end, r.size):
                        yield pd.DataFrame({"value": [x.decode() for x in lines], "ord": range(n, n + len(lines))})
                        n += len(lines)

    return file_ranges(spark, path, step).mapInPandas(run, "value string, ord long").where("value <> ''")


def read_vcf_gz(spark: SparkSession, path: str, step: int = RANGE) -> tuple[Header, DataFrame]:
    """Header and sites of block-compressed VCF files."""
    from siteloom.sources.vcf import parse_lines

    first = file_ranges(spark, path, step).orderBy("file", "nth").first()
    head: list[str] = []
    with open_file(first["path"]) as f:
        for lines in range_lines(f, 0, first["size"], first["size"]):
            head += [x.decode().rstrip("\r") for x in lines if x.startswith(b"#")]
            if any(not x.startswith(b"#") for x in lines):
                break
    header = parse_header(head)
    return header, parse_lines(read_lines(spark, path, step), header)


def write_parts(rows: DataFrame, encode: Callable[[list[str]], bytes], path: str, first: bytes, suffix: str, level: int = 6) -> None:
    """``rows`` (line) as one block-compressed file for each partition, and ``first`` before them in a file of its own; together in name order they are one file.

    A part is written under a name of its attempt and then moved to its own, so a task may run again after a lost executor.
    """
    spark = rows.sparkSession

    def put(name: str, data: Iterator[bytes]) -> None:
        from pyarrow import fs

        system, where = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        system.create_dir(where, recursive=True)
        attempt = f"{where}/_{uuid.uuid4().hex}"
        with system.open_output_stream(attempt, compression=None) as out:
            for x in data:
                out.write(x)
        system.move(attempt, f"{where}/{name}")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        nth = TaskContext.get().partitionId()
        count = 0

        def stream() -> Iterator[bytes]:
            nonlocal count
            held = b""
            for p in parts:
                held += encode(p["line"].tolist())
                count += len(p)
                cut = len(held) - len(held) % BLOCK
                for i in range(0, cut, BLOCK):
                    yield compress_block(held[i : i + BLOCK], level)
                held = held[cut:]
            if held:
                yield compress_block(held, level)

        put(f"part-{nth + 1:05d}{suffix}", stream())
        yield pd.DataFrame({"nth": [nth], "n": [count]})

    put(f"part-00000{suffix}", iter([compress(first, level, end=False)]))
    rows.mapInPandas(run, "nth long, n long").agg(F.sum("n")).collect()
    put(f"part-99999-end{suffix}", iter([END]))


def write_vcf_gz(sites: DataFrame, header: Header, path: str, level: int = 6) -> None:
    """Block-compressed part files under ``path`` in position order."""
    from siteloom.sources.vcf import ordered_lines

    text = ("\n".join(header.lines()) + "\n").encode()
    with ordered_lines(sites, header) as rows:
        write_parts(rows, lambda lines: "".join(x + "\n" for x in lines).encode(), path, text, ".vcf.gz", level)


def join_parts(path: str, out: str) -> None:
    """Part files in name order as one file, by copying bytes: nothing is decompressed. Runs on the driver, a few megabytes at a time."""
    from pyarrow import fs

    at = lambda x: fs.FileSystem.from_uri(x) if "://" in x or x.startswith("file:") else (fs.LocalFileSystem(), x)
    system, where = at(path)
    target, name = at(out)
    with target.open_output_stream(name, compression=None) as sink:
        for info in sorted(system.get_file_info(fs.FileSelector(where)), key=lambda i: i.base_name):
            if info.base_name.startswith("part-"):
                with system.open_input_stream(info.path, compression=None) as source:
                    while data := source.read(1 << 22):
                        sink.write(data)
