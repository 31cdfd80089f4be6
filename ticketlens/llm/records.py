"""Token ids in record files: length-delimited binary records and an offset index.

A file is a row of records in ascending document order. Each record is framed by its length
(8 bytes, little-endian) and the masked CRC-32C of these 8 bytes in front, and the masked
CRC-32C of the payload behind, so any reader of such framed files can walk through it. A
payload is the document's id (8 bytes), a byte whose lowest bit says that the id is not
null, the bytes of one id (2 or 4), six zero bytes, and then the token ids. Beside each
file stands its index, of fixed-size entries (INDEX), so that single records can be read in any order.

Tasks write files under names of their own and return one row for each; only the rows of
tasks that succeeded are stored in the list of files, so a task that is lost or run twice
leaves at most a file nobody knows."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ticketlens.llm.common import give_back, shared_folder
from ticketlens.llm.crc import crc32c, masked
from ticketlens.llm.pieces import Encoder, check_supported
from ticketlens.llm.words import text_bytes

#: Bytes after which a file is closed, and bytes of records that are framed or checked at a time.
FILE_BYTES, SLAB_BYTES = 64_000_000, 2_000_000
#: An entry of the index: the document, whether its id is there, where its record starts,
#: its ids, and the ids before it in the file.
INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "<i8"), ("offset", "<i8"), ("n_tokens", "<i8"), ("start", "<i8")])
HEAD, FRAME = struct.Struct("<qBB6x"), 16
LIST = "part int, number int, file string, documents long, tokens long, bytes long"

_encoders: dict[int, Encoder] = {}


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def _sums(strings: list[bytes]) -> list[bytes]:
    return [s.to_bytes(4, "little") for s in masked(crc32c(strings)).tolist()]


def framed(payloads: list[bytes]) -> list[bytes]:
    """The records of some payloads."""
    lengths = [len(p).to_bytes(8, "little") for p in payloads]
    return [b"".join(r) for r in zip(lengths, _sums(lengths), payloads, _sums(payloads))]


class RecordWriter:
    """Writes records to files in `folder`, a new file after `FILE_BYTES`."""

    def __init__(self, folder: str, file_bytes: int):
        self.system, self.folder = file_system(folder)
        self.file_bytes, self.done = file_bytes, []
        self.sink, self.waiting, self.entries = None, [], []

    def add(self, doc_id: int | None, ids: bytes, width: int) -> None:
        if self.sink is None:
            self.name = uuid.uuid4().hex
            self.sink = self.system.open_output_stream(f"{self.folder}/{self.name}.rec")
            self.at = self.tokens = self.held = 0
        self.waiting.append(HEAD.pack(doc_id or 0, doc_id is not None, width) + ids)
        size = len(self.waiting[-1]) + FRAME
        self.entries.append((doc_id or 0, doc_id is not None, self.at, len(ids) // width, self.tokens))
        self.at, self.held, self.tokens = self.at + size, self.held + size, self.tokens + len(ids) // width
        if self.held >= SLAB_BYTES:
            self._flush()
        if self.at >= self.file_bytes:
            self.close()

    def _flush(self) -> None:
        for record in framed(self.waiting):
            self.sink.write(record)
        self.waiting, self.held = [], 0

    def close(self) -> None:
        """Ends the file: the index is written last."""
        if self.sink is None:
            return
        self._flush()
        self.sink.close()
        with self.system.open_output_stream(f"{self.folder}/{self.name}.idx") as index:
            data = np.array(self.entries, INDEX).tobytes()
            index.write(data + _sums([data])[0])
        self.done.append((self.name, len(self.entries), self.tokens, self.at))
        self.sink, self.entries = None, []


def write_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    folder: str | None = None,
    file_bytes: int = FILE_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> str:
    """Writes the ids of every text and `end_id` as one record for each row of `docs`, in
    ascending order of ids over all files, and returns the folder.

    A null or empty text is `end_id` alone. Rows without id come first; repeated ids stand one
    after another, ordered by a hash of the text (rows that are wholly alike need no
    order). An empty table gives a folder without records. Other columns are not read. A
    text is encoded in one piece, however long. Files are found by their list, a
    Parquet table in the folder: one row of a few bytes for each file of `file_bytes`."""
    spark: SparkSession = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer_json = file.read()
    check_supported(tokenizer_json)
    shared = spark.sparkContext.broadcast(tokenizer_json)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key = hash(shared.value)
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(shared.value)
        encoder = _encoders[key]
        end = np.array([end_id], encoder.dtype).tobytes()
        width = encoder.dtype.itemsize
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        writer = RecordWriter(folder, file_bytes)
        for batch in batches:
            ids = encoder.encode(*text_bytes(batch.column(1)))
            for doc_id, own in zip(batch.column(0).to_pylist(), ids):
                writer.add(doc_id, own.tobytes() + end, width)
            give_back()
        writer.close()
        part = TaskContext.get().partitionId()
        for number, row in enumerate(writer.done):
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("part", "number", "file", "documents", "tokens", "bytes"), (part, number, *row)))],
                schema=pa.schema(
                    [("part", pa.int32()), ("number", pa.int32()), ("file", pa.string())]
                    + [(n, pa.int64()) for n in ("documents", "tokens", "bytes")]
                ),
            )

    keyed = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).alias("body"),
        F.xxhash64(text_col).alias("h"),
        # Tells apart equal rows of different input tasks, should one row fill many of them.
        F.spark_partition_id().alias("p"),
    )
    placed = keyed.repartitionByRange("id", "h", "p").sortWithinPartitions("id", "h", "p")
    listed = placed.select("id", "body").mapInArrow(write, LIST)
    listed.write.parquet(f"{folder}/files")
    return folder


def file_list(spark: SparkSession, folder: str) -> DataFrame:
    """The files in order, with `first`: the ids in all files before. One row a file."""
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    files = spark.read.schema(LIST).parquet(f"{folder}/files")
    return files.withColumn("first", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _index(system: fs.FileSystem, path: str) -> np.ndarray:
    with system.open_input_stream(f"{path}.idx") as file:
        data = file.read()
    if _sums([data[:-4]])[0] != data[-4:]:
        raise ValueError(f"the index of {path} is damaged")
    return np.frombuffer(data[:-4], INDEX)


def _checked(records: list[bytes], what: str) -> list[bytes]:
    """The payloads of some records, or an error where a length or checksum is wrong."""
    payloads = [r[12:-4] for r in records]
    lengths = [r[:8] for r in records]
    right = (
        all(int.from_bytes(n, "little") == len(p) for n, p in zip(lengths, payloads))
        and all(a == r[8:12] for a, r in zip(_sums(lengths), records))
        and all(a == r[-4:] for a, r in zip(_sums(payloads), records))
    )
    if not right:
        raise ValueError(f"a record of {what} is damaged")
    return payloads


def _slabs(entries: np.ndarray, size: int) -> Iterator[tuple[int, int, int, int]]:
    """Runs of records of about SLAB_BYTES: first and last entry, start and end in the file."""
    ends = np.append(entries["offset"][1:], size)
    low = 0
    while low < len(entries):
        high = max(low + 1, int(np.searchsorted(ends, entries["offset"][low] + SLAB_BYTES)))
        yield low, high, int(entries["offset"][low]), int(ends[high - 1])
        low = high


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    """The document's id and its token ids, as unsigned numbers of four bytes."""
    doc_id, has_id, width = HEAD.unpack_from(payload)
    ids = np.frombuffer(payload, "<u2" if width == 2 else "<u4", offset=HEAD.size)
    return (doc_id if has_id & 1 else None), ids.astype("<u4")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the folder, in one row: doc_id, start (ids of all records before it),
    n_tokens, ids_crc32 (of its ids as little-endian unsigned 32-bit numbers). Each
    file is read from its start to its end, a few records at a time, all checksums are
    compared, and a damaged file raises an error."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{path}/{row['file']}"
                entries = _index(system, name)
                with system.open_input_stream(f"{name}.rec") as file:
                    for low, high, start, end in _slabs(entries, row["bytes"]):
                        data, own = file.read(end - start), entries[low:high]
                        cuts = np.append(own["offset"], end) - start
                        records = [data[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                        parsed = [parse(p) for p in _checked(records, name)]
                        sizes = np.array([len(ids) for _, ids in parsed], np.int64)
                        if (sizes != own["n_tokens"]).any():
                            raise ValueError(f"the index of {name} does not fit its records")
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([doc_id for doc_id, _ in parsed], pa.int64()),
                                pa.array(own["start"] + row["first"]),
                                pa.array(sizes),
                                pa.array([zlib.crc32(ids.tobytes()) for _, ids in parsed], pa.int64()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
            give_back()

    files = file_list(spark, folder)
    return (
        files.select("file", "bytes", "first")
        .repartition(max(1, files.count()), "file")
        .mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )


def read_shuffled(spark: SparkSession, folder: str, seed: int, partitions: int) -> DataFrame:
    """Every record in a pseudo-random order that `seed` names: place (a random 64-bit number,
    ascending over partitions and rows), doc_id, ids. The index alone is shuffled;
    each record is then read by itself, at its offset."""

    def entries_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                entries = _index(system, f"{path}/{row['file']}")
                if not len(entries):
                    continue
                ends = np.append(entries["offset"][1:], row["bytes"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["file"]] * len(entries), pa.string()),
                        pa.array(entries["offset"].astype(np.int64)),
                        pa.array((ends - entries["offset"]).astype(np.int64)),
                    ],
                    ["file", "offset", "bytes"],
                )

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(folder)
        opened: dict[str, pa.NativeFile] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] not in opened:
                    if len(opened) >= 64:
                        opened.pop(next(iter(opened))).close()
                    opened[row["file"]] = system.open_input_file(f"{path}/{row['file']}.rec")
                record = opened[row["file"]].read_at(row["bytes"], row["offset"])
                doc_id, ids = parse(_checked([record], row["file"])[0])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["place"]], pa.int64()),
                        pa.array([doc_id], pa.int64()),
                        pa.array([ids.astype(np.int64)], pa.list_(pa.int64())),
                    ],
                    ["place", "doc_id", "ids"],
                )

    files = file_list(spark, folder)
    entries = files.repartition(max(1, files.count()), "file").mapInArrow(
        entries_of, "file string, offset long, bytes long"
    )
    return (
        entries.withColumn("place", F.xxhash64("file", "offset", F.lit(seed)))
        .repartitionByRange(partitions, "place", "file", "offset")
        .sortWithinPartitions("place", "file", "offset")
        .mapInArrow(read, "place long, doc_id long, ids array<long>")
    )
