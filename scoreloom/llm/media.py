"""Operator 9, media columns: payloads stored as losslessly compressed 8-bit images in tar archives, read back by a
custom Spark data source.

Writing: each task appends members to archives of its own in a shared folder, with an index file beside each. Only
archives that a finished task has named in the manifest count; those of lost or repeated tasks are never read.
Reading: the data source plans byte ranges over the archives and streams payload batches through Arrow. A range is read
in few large requests; a member that is damaged or missing in what came is read again alone, by its offset."""

from __future__ import annotations

import hashlib
import struct
import sys
import tarfile
import time
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The planner's and the executors' Python processes get the data source's code with its class.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Samples in a row of the image; payloads are padded with 255 to whole rows.
WIDTH = 576
PAD = 255
ARCHIVE_BYTES = 128 << 20
RANGE_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
#: Ranges that a read is planned in at most (and one more); larger totals have larger ranges.
MOST_RANGES = 100_000
RETRIES = 4
PNG = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes) -> bytes:
    """data followed by bytes 255 up to a positive multiple of WIDTH."""
    rows = max(1, -(-len(data) // WIDTH))
    return data.ljust(rows * WIDTH, bytes([PAD]))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey image whose samples are the payload: WIDTH a row, no filter."""
    rows = len(payload) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image of to_png; ValueError if it is damaged."""
    if media[:8] != PNG:
        raise ValueError("not an image")
    at, rows, data = 8, None, []
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"damaged {kind!r}")
        if kind == b"IHDR":
            width, rows, depth, colour = struct.unpack_from(">IIBB", body)
            if (width, depth, colour) != (WIDTH, 8, 0):
                raise ValueError("other kind of image")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(rows, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Average hash of 64 parts (16 hex digits), then the counts of eight ranges of sample values."""
    samples = np.frombuffer(payload, np.uint8)
    parts = samples.reshape(64, -1).sum(axis=1, dtype=np.int64)
    bits = np.packbits(parts * 64 >= samples.sum(dtype=np.int64)).tobytes().hex()
    return bits + ":" + ".".join(map(str, np.bincount(samples >> 5, minlength=8)))


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Archive:
    """A tar archive being written, and the index of its members: id, offset and size of the data, checksum; a batch of
    the index for every RANGE_BYTES of the archive, so that a range's members are found without the others."""

    def __init__(self, folder: str):
        self.fs, base = _opened(folder)
        self.name = uuid.uuid4().hex
        self.base = f"{base}/{self.name}"
        self.out = self.fs.open_output_stream(f"{self.base}.tar")
        self.at, self.rows, self.cuts = 0, [], [(0, 0)]  # cuts: where ranges begin, in bytes and in members

    def add(self, key, media: bytes) -> None:
        info = tarfile.TarInfo(f"{len(self.rows):09d}.png")
        info.size = len(media)
        if self.at - self.cuts[-1][0] >= RANGE_BYTES:
            self.cuts.append((self.at, len(self.rows)))
        self.out.write(info.tobuf(tarfile.USTAR_FORMAT))
        self.rows.append((key, self.at + 512, len(media), zlib.crc32(media)))
        fill = -len(media) % 512
        self.out.write(media + bytes(fill))
        self.at += 512 + len(media) + fill

    def drop(self) -> None:
        """Takes away what a task that fails has begun."""
        self.out.close()
        self.fs.delete_file(f"{self.base}.tar")

    def close(self, kind: pa.DataType) -> tuple[str, list[int]]:
        """The archive's name, and where the parts of its index begin and the last one ends."""
        self.out.write(bytes(1024))
        self.out.close()
        keys, offsets, sizes, sums = zip(*self.rows)
        index = pa.table({"id": pa.array(keys, kind), "offset": pa.array(offsets, pa.int64()), "size": pa.array(sizes, pa.int64()), "crc": pa.array(sums, pa.int64())})
        with self.fs.open_output_stream(f"{self.base}.index") as out, pa.ipc.new_file(out, index.schema) as writer:
            for (_, first), (_, stop) in zip(self.cuts, [*self.cuts[1:], (0, len(self.rows))]):
                writer.write_batch(index.slice(first, stop - first).combine_chunks().to_batches()[0])
        return self.name, [*(at for at, _ in self.cuts), self.at]


def store(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Stores each row's text as a member of some archive in folder; the path of the manifest table, written last."""
    source = df.select(df[id_col].alias("id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now = [], None
        try:
            for b in batches:
                kind = b.column(0).type
                for key, text in zip(b.column(0), b.column(1)):
                    if now is None:
                        now = _Archive(folder)
                    now.add(key.as_py(), to_png(padded(text.as_py().encode("utf-8", "replace"))))
                    if now.at >= ARCHIVE_BYTES:
                        done.append(now.close(kind))
                        now = None
            if now is not None:
                done.append(now.close(kind))
                now = None
        finally:
            if now is not None:
                now.drop()
        if done:
            names, cuts = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(cuts, pa.list_(pa.int64()))], names=["name", "cuts"])

    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)
    manifest = f"{folder}/manifest"
    source.mapInArrow(put, "name string, cuts array<long>").write.parquet(manifest)
    return manifest


class ByteRange(InputPartition):
    """Members of archives: of each one named those whose data begin at low or later and before high, which parts first
    to stop (not included) of its index name."""

    def __init__(self, pieces: list[tuple[str, int, int, int, int]]):
        self.pieces = pieces  # (name, first, stop, low, high)


class MediaArchives(DataSource):
    """Format media_archives: rows (id, archive, offset, media) of all archives that a folder's manifest names.

    Options: path (the folder), id_type (Spark type of the ids), range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return f"id {self.options.get('id_type', 'bigint')}, archive string, offset bigint, media binary"

    def reader(self, schema) -> DataSourceReader:
        return MediaReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))


class MediaReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int):
        self.folder, self.range_bytes = folder, range_bytes

    def partitions(self) -> list[ByteRange]:
        import pyarrow.dataset as ds

        files, base = _opened(self.folder)
        # A row an archive. Ranges grow with the whole, so that their number doesn't, beyond MOST_RANGES.
        manifest = ds.dataset(f"{base}/manifest", format="parquet", filesystem=files, exclude_invalid_files=False).to_table().to_pylist()
        step = max(self.range_bytes, sum(m["cuts"][-1] for m in manifest) // MOST_RANGES)
        out, pieces, held = [], [], 0
        for m in manifest:
            cuts = m["cuts"]
            for low in range(0, cuts[-1], step):
                high = min(low + step, cuts[-1])
                pieces.append((m["name"], bisect_right(cuts, low) - 1, bisect_left(cuts, high), low, high))
                held += high - low
                if held >= step:
                    out.append(ByteRange(pieces))
                    pieces, held = [], 0
        return [*out, ByteRange(pieces)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        files, base = _opened(self.folder)
        for name, first, stop, low, high in part.pieces:
            for k in range(first, stop):
                yield from self.range(files, base, name, k, low, high)

    def range(self, files, base: str, name: str, k: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
        """Members of one part of an archive's index whose data begin from low to high."""
        index = again(lambda: self.index(files, f"{base}/{name}.index", k))
        first, stop = np.searchsorted(index.column(1).to_numpy(), (low, high))
        index = index.slice(first, stop - first)
        offsets, sizes, sums = (index.column(k).to_numpy() for k in (1, 2, 3))
        at = 0
        while at < len(sizes):
            n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), BATCH_BYTES, "right")))
            media = self.members(files, f"{base}/{name}.tar", offsets[at : at + n].tolist(), sizes[at : at + n].tolist(), sums[at : at + n].tolist())
            own = index.slice(at, n)
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array([name] * n), own.column(1), pa.array(media, pa.binary())], names=["id", "archive", "offset", "media"])
            at += n

    @staticmethod
    def index(files, path: str, part: int) -> pa.RecordBatch:
        with files.open_input_file(path) as source:
            return pa.ipc.open_file(source).get_batch(part)

    @staticmethod
    def members(files, path: str, offsets: list[int], sizes: list[int], sums: list[int]) -> list[bytes]:
        """The members' bytes, in one request for all; those that came damaged or not at all are asked for alone."""
        start = offsets[0]
        try:
            with files.open_input_file(path) as source:
                data = source.read_at(offsets[-1] + sizes[-1] - start, start)
        except OSError:
            data = b""
        out = []
        for offset, size, crc in zip(offsets, sizes, sums):
            one = data[offset - start : offset - start + size]
            out.append(one if len(one) == size and zlib.crc32(one) == crc else MediaReader.member(files, path, offset, size, crc))
        return out

    @staticmethod
    def member(files, path: str, offset: int, size: int, crc: int) -> bytes:
        """The member's bytes. A failed or damaged read is repeated for this member alone."""

        def one() -> bytes:
            with files.open_input_file(path) as source:
                data = source.read_at(size, offset)
            if len(data) != size or zlib.crc32(data) != crc:
                raise OSError(f"{path} at {offset}: damaged member")
            return data

        return again(one)


def again(read):
    """What read() gives; it is tried RETRIES times, with longer and longer pauses."""
    for attempt in range(RETRIES):
        try:
            return read()
        except OSError:
            if attempt + 1 == RETRIES:
                raise
            time.sleep(0.1 * 2**attempt)


def read_back(spark: SparkSession, folder: str, id_type: str = "bigint") -> DataFrame:
    """(id, archive, offset, media) of a folder that store() has filled."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").option("id_type", id_type).load(folder)


def described(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests and features of the payloads read back from the media column."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m in b.column(1):
                media = m.as_py()
                payload = from_png(media)
                rows.append((
                    len(payload.rstrip(bytes([PAD]))), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]),
                    len(media), hashlib.sha256(media).hexdigest(), feature(payload),
                ))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = stored.schema["id"].dataType.simpleString()
    out = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select("id", "media").mapInArrow(made, out).withColumnRenamed("id", id_col)


def media_columns(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every row's whole text in archives under folder, reads them back and describes what was read.

    A null or empty text is one row of samples 255. Equal texts have equal media. Every row is a member of its own,
    repeated rows and null ids too; an empty table gives an empty result. folder must be in a store that pyarrow can
    open (file, hdfs, s3, gs) and that all executors share."""
    store(df, folder, id_col, text_col)
    return described(read_back(df.sparkSession, folder, df.schema[id_col].dataType.simpleString()), id_col)
