"""Token ids in binary files of patched frame-of-reference blocks, as a Spark data source.

A file holds the ids of a range of documents, one after another, in blocks of 256:

    file    MAGIC, block*, block starts (u64 each, and the end), documents
            (i64 id each, u8 "has an id" each, u64 number of ids each),
            u64 ids, u64 documents, u64 blocks, MAGIC
    block   u32 minimum, u8 width, u8 0, u16 exceptions, 32 * width bytes of packed
            differences, u8 place of each exception, u32 high part of each exception

A block keeps the differences to its minimum, packed at the width that a set share of
them fits (90 percent). The others are exceptions: their low bits are packed with the
rest, and what lies above is put back from the list. The last block is filled up with
its minimum. All numbers are little-endian; four groups of 64 differences fill
``width`` 64-bit words each, lowest bits first.

The block starts give any stretch of ids by reading its blocks alone. A folder's
``manifest.json`` names its files in order with their first id and numbers of ids and
documents. Only files of committed tasks are named there, so a task that ran twice or
broke off leaves nothing that is read.
"""

from __future__ import annotations

import json
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from docketlake.llm.common import text_slices
from docketlake.llm.subwords import chunk_encoder

BLOCK, GROUP = 256, 64
SHARE = 0.9  # of a block's differences that fit the packed width
HELD = 1 << 18  # ids that are packed or unpacked at once
MAGIC = b"PFORIDS1"
MANIFEST = "manifest.json"
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


# --- blocks -------------------------------------------------------------------


def _pack(d: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of rows of 256 differences as rows of bytes."""
    groups = d.reshape(-1, GROUP) & np.uint64((1 << width) - 1)
    words = np.zeros((len(groups), width), np.uint64)
    for k in range(GROUP):
        word, shift = divmod(k * width, 64)
        words[:, word] |= groups[:, k] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= groups[:, k] >> np.uint64(64 - shift)
    return words.astype("<u8", copy=False).view(np.uint8).reshape(len(d), -1)


def _unpack(data: np.ndarray, width: int) -> np.ndarray:
    """Rows of 256 values from rows of packed bytes."""
    words = np.ascontiguousarray(data).view("<u8").reshape(-1, width)
    out, mask = np.empty((len(words), GROUP), np.uint64), np.uint64((1 << width) - 1)
    for k in range(GROUP):
        word, shift = divmod(k * width, 64)
        v = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            v |= words[:, word + 1] << np.uint64(64 - shift)
        out[:, k] = v & mask
    return out.reshape(len(data), BLOCK)


def pack_blocks(ids: np.ndarray, share: float = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, sizes of the blocks) of ids, the last block filled up."""
    n = -(-len(ids) // BLOCK)
    rows = np.full(n * BLOCK, 0xFFFFFFFF, np.uint32)
    rows[: len(ids)] = ids
    rows = rows.reshape(n, BLOCK)
    low = rows.min(axis=1, initial=0xFFFFFFFF)
    if len(ids) % BLOCK:
        rows[-1, len(ids) % BLOCK :] = low[-1]
    d = (rows - low[:, None]).astype(np.uint64)
    place = min(BLOCK - 1, int(share * BLOCK))
    width = np.frexp(np.partition(d, place, axis=1)[:, place].astype(np.float64))[1]  # bits of that difference
    over = d >> width[:, None].astype(np.uint64)
    row, at = np.nonzero(over)
    exceptions = np.bincount(row, minlength=n)
    sizes = 8 + BLOCK // 8 * width + 5 * exceptions
    start = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    heads = np.zeros(n, [("low", "<u4"), ("width", "u1"), ("zero", "u1"), ("exceptions", "<u2")])
    heads["low"], heads["width"], heads["exceptions"] = low, width, exceptions
    out[start[:, None] + np.arange(8)] = heads.view(np.uint8).reshape(n, 8)
    for w in np.unique(width[width > 0]).tolist():
        some = np.flatnonzero(width == w)
        out[start[some, None] + np.arange(8, 8 + BLOCK // 8 * w)] = _pack(d[some], w)
    if len(row):
        nth = np.arange(len(row)) - (np.cumsum(exceptions) - exceptions)[row]
        list_at = (start + 8 + BLOCK // 8 * width)[row]
        out[list_at + nth] = at
        high = over[row, at].astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(list_at + exceptions[row] + 4 * nth)[:, None] + np.arange(4)] = high
    return out, sizes


def unpack_blocks(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The ids of whole blocks that begin at ``start`` in ``data``."""
    n = len(start)
    heads = data[start[:, None] + np.arange(8)].copy().view([("low", "<u4"), ("width", "u1"), ("zero", "u1"), ("exceptions", "<u2")]).reshape(n)
    width, exceptions = heads["width"].astype(np.int64), heads["exceptions"].astype(np.int64)
    out = np.zeros((n, BLOCK), np.uint64)
    for w in np.unique(width[width > 0]).tolist():
        some = np.flatnonzero(width == w)
        out[some] = _unpack(data[start[some, None] + np.arange(8, 8 + BLOCK // 8 * w)], w)
    if exceptions.any():
        row = np.repeat(np.arange(n), exceptions)
        nth = np.arange(len(row)) - (np.cumsum(exceptions) - exceptions)[row]
        list_at = (start + 8 + BLOCK // 8 * width)[row]
        high = data[(list_at + exceptions[row] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").reshape(-1).astype(np.uint64)
        out[row, data[list_at + nth]] |= high << width[row].astype(np.uint64)
    return (out + heads["low"][:, None]).astype(np.uint32).reshape(-1)


# --- files ----------------------------------------------------------------------


class TokenFileWriter:
    """Writes documents' ids to an open stream; holds the ids of some blocks and the indexes."""

    def __init__(self, stream):
        self.stream, self.at = stream, 0
        self.waiting: list[np.ndarray] = []
        self.held = self.ids = 0
        self.starts: list[np.ndarray] = []
        self.docs: list[tuple[list, list[int]]] = []
        self._put(MAGIC)

    def _put(self, data) -> None:
        self.stream.write(memoryview(data))
        self.at += memoryview(data).nbytes

    def add(self, keys: list, ids: list[bytes]) -> None:
        """Documents in order: their ids and their token ids as unsigned 32-bit bytes."""
        self.docs.append((keys, [len(x) // 4 for x in ids]))
        for x in ids:
            self.waiting.append(np.frombuffer(x, "<u4"))
            self.held += len(x) // 4
            if self.held >= HELD:
                self._blocks(self.held // BLOCK * BLOCK)

    def _blocks(self, n: int) -> None:
        every = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        self.waiting, self.held = [every[n:]], len(every) - n
        for k in range(0, n, HELD):
            data, sizes = pack_blocks(every[k : min(n, k + HELD)])
            self.starts.append(self.at + np.cumsum(sizes) - sizes)
            self._put(data)
        self.ids += n

    def close(self) -> tuple[int, int]:
        """Ends the file (not the stream): (ids, documents)."""
        self._blocks(self.held)
        starts = np.concatenate([*self.starts, [self.at]]).astype("<u8")
        keys = [k for some, _ in self.docs for k in some]
        self._put(starts)
        self._put(np.array([k or 0 for k in keys], "<i8"))
        self._put(np.array([k is not None for k in keys], np.uint8))
        self._put(np.array([n for _, some in self.docs for n in some], "<u8"))
        self._put(np.array([self.ids, len(keys), len(starts) - 1], "<u8"))
        self._put(MAGIC)
        return self.ids, len(keys)


class TokenFile:
    """Reads an open file by its indexes."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n_ids, n_docs, n_blocks = np.frombuffer(self._read(size - 32, 24), "<u8").tolist()
        if self._read(size - 8, 8) != MAGIC:
            raise ValueError("not a file of token ids, or cut short")
        index = np.frombuffer(self._read(size - 32 - 17 * n_docs - 8 * (n_blocks + 1), 17 * n_docs + 8 * (n_blocks + 1)), np.uint8)
        self.n_ids = n_ids
        parts = np.split(index, np.cumsum([8 * (n_blocks + 1), 8 * n_docs, n_docs]))
        self.starts, self.keys, self.lengths = parts[0].copy().view("<u8").astype(np.int64), parts[1].copy().view("<i8"), parts[3].copy().view("<u8").astype(np.int64)
        self.there = parts[2].astype(bool)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def ids(self, first: int, n: int) -> np.ndarray:
        """Ids ``first`` to before ``first + n``; only their blocks are read."""
        n = min(n, self.n_ids - first)
        if n <= 0:
            return np.empty(0, np.uint32)
        a, b = first // BLOCK, -(-(first + n) // BLOCK)
        out = [np.empty(0, np.uint32)]
        for k in range(a, b, HELD // BLOCK):
            to = min(b, k + HELD // BLOCK)
            begin, end = int(self.starts[k]), int(self.starts[to])
            out.append(unpack_blocks(np.frombuffer(self._read(begin, end - begin), np.uint8), self.starts[k:to] - begin))
        return np.concatenate(out)[first - a * BLOCK : first - a * BLOCK + n]

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first document, one after the last, their ids) of stretches of about ``HELD`` ids."""
        ends = np.cumsum(self.lengths)
        at = 0
        while at < len(ends):
            before = int(ends[at] - self.lengths[at])
            to = max(at + 1, min(at + 10_000, int(np.searchsorted(ends, before + HELD, "right"))))
            yield at, to, self.ids(before, int(ends[to - 1]) - before)
            at = to


# --- data source ------------------------------------------------------------------


@dataclass
class FileWritten(WriterCommitMessage):
    partition: int
    name: str | None
    ids: int
    docs: int
    first: int | None
    last: int | None


def _folder(path: str) -> tuple[pafs.FileSystem, str]:
    fs, at = pafs.FileSystem.from_uri(path)
    return fs, at.rstrip("/")


class TokenWriter(DataSourceArrowWriter):
    """One file a task; the commit names them in the manifest."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.tokenizer, self.end, self.memo = options.get("tokenizer"), int(options.get("end_id", -1)), int(options.get("memo", 800_000))
        names = schema.fieldNames()
        self.column = "text" if self.tokenizer else "ids"
        if not {"doc_id", self.column} <= set(names):
            raise ValueError("needs doc_id and ids, or doc_id and text with the option tokenizer")
        self.at = names.index("doc_id"), names.index(self.column)
        fs, folder = _folder(self.path)
        if not overwrite and fs.get_file_info(f"{folder}/{MANIFEST}").type != pafs.FileType.NotFound:
            raise ValueError(f"{self.path} holds token files; write with mode overwrite or to a new folder")

    def _ids(self, batches) -> Iterator[tuple[list, list[bytes]]]:
        end = array("I", [self.end]).tobytes() if self.end >= 0 else b""
        key, data = self.at
        if self.tokenizer:
            encoder = chunk_encoder(self.tokenizer, self.memo)
            for batch in batches:
                part = pa.RecordBatch.from_arrays([batch.column(key), batch.column(data)], names=["doc_id", "text"])
                for at, texts in text_slices(part, "text"):
                    yield part.column(0).slice(at, len(texts)).to_pylist(), [x + end for x in encoder.encode(texts)]
        else:
            for batch in batches:
                yield batch.column(key).to_pylist(), [(x or b"") + end for x in batch.column(data).to_pylist()]

    def write(self, iterator) -> FileWritten:
        part = TaskContext.get().partitionId()
        fs, folder = _folder(self.path)
        name, writer, first, last = f"{part:07d}-{self.job}-{uuid.uuid4().hex}.pfor", None, None, None
        try:
            for keys, ids in self._ids(iterator):
                if writer is None and keys:
                    fs.create_dir(folder, recursive=True)
                    stream = fs.open_output_stream(f"{folder}/{name}")
                    writer = TokenFileWriter(stream)
                known = [k for k in keys if k is not None]
                if known:
                    if last is not None and known[0] < last or known != sorted(known):
                        raise ValueError("rows must come in ascending doc_id order")
                    first, last = known[0] if first is None else first, known[-1]
                if writer:
                    writer.add(keys, ids)
            if writer is None:
                return FileWritten(part, None, 0, 0, None, None)
            n_ids, n_docs = writer.close()
            stream.close()
        except BaseException:
            if writer:
                stream.close()
                fs.delete_file(f"{folder}/{name}")
            raise
        return FileWritten(part, name, n_ids, n_docs, first, last)

    def _left(self, fs: pafs.FileSystem, folder: str, keep: set[str]) -> None:
        """Deletes this job's files that are not in ``keep``."""
        for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
            if self.job in f.base_name and f.base_name not in keep:
                fs.delete_file(f.path)

    def commit(self, messages) -> None:
        fs, folder = _folder(self.path)
        done = sorted((m for m in messages if m and m.name), key=lambda m: m.partition)
        known = [m for m in done if m.first is not None]
        if any(a.last > b.first for a, b in zip(known, known[1:])):
            self._left(fs, folder, set())
            raise ValueError("partitions must be ranges of doc_id in ascending order")
        fs.create_dir(folder, recursive=True)
        old = _manifest(self.path)["files"] if self.overwrite and fs.get_file_info(f"{folder}/{MANIFEST}").type != pafs.FileType.NotFound else []
        files, start = [], 0
        for m in done:
            files.append({"name": m.name, "start": start, "ids": m.ids, "docs": m.docs})
            start += m.ids
        new = f"{folder}/.{MANIFEST}-{self.job}"
        with fs.open_output_stream(new) as out:
            out.write(json.dumps({"block": BLOCK, "ids": start, "docs": sum(m.docs for m in done), "files": files}).encode())
        fs.move(new, f"{folder}/{MANIFEST}")
        self._left(fs, folder, {m.name for m in done})
        for f in old:
            fs.delete_file(f"{folder}/{f['name']}")

    def abort(self, messages) -> None:
        self._left(*_folder(self.path), set())


def _manifest(path: str) -> dict:
    fs, folder = _folder(path)
    with fs.open_input_stream(f"{folder}/{MANIFEST}") as f:
        return json.loads(f.read())


@dataclass
class OneFile(InputPartition):
    name: str | None
    start: int


class TokenReader(DataSourceReader):
    """One partition a file."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [OneFile(f["name"], f["start"]) for f in _manifest(self.path)["files"]] or [OneFile(None, 0)]

    def read(self, partition):
        if partition.name is None:
            return
        fs, folder = _folder(self.path)
        with fs.open_input_file(f"{folder}/{partition.name}") as source:
            file = TokenFile(source)
            begins = partition.start + np.cumsum(file.lengths) - file.lengths
            for a, b, ids in file.documents():
                ends = np.concatenate([[0], np.cumsum(4 * file.lengths[a:b])])
                data = ids.astype("<u4", copy=False).tobytes()
                cells = [data[x:y] for x, y in zip(ends.tolist(), ends[1:].tolist())]
                keys = pa.array(file.keys[a:b], pa.int64(), mask=~file.there[a:b])
                yield pa.RecordBatch.from_arrays([keys, pa.array(begins[a:b], pa.int64()), pa.array(file.lengths[a:b], pa.int64()), pa.array(cells, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])


class TokenFiles(DataSource):
    """``format("token_files")``: reads a folder, or writes rows sorted and parted by ranges of doc_id."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TokenReader:
        return TokenReader(self.options["path"])

    def writer(self, schema, overwrite) -> TokenWriter:
        return TokenWriter(dict(self.options), schema, overwrite)


# --- operator ---------------------------------------------------------------------


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = 256 << 20, least_bytes: int = 16 << 20) -> None:
    """Encodes whole texts and writes their ids to a new folder in ascending order of ids.

    Null and empty texts are their end id alone; rows with a null id come first; rows
    with one id follow each other in an order that their texts give. A file takes about
    ``file_bytes`` of text, or less where that would leave cores idle. Rows are dealt
    by ranges of id, text hash and row, so a frequent id is cut too. No rows give an
    empty folder. Ids must be integers; other columns play no part.
    """
    spark = docs.sparkSession
    spark.dataSource.register(TokenFiles)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    parts = max(1, -(-size // file_bytes), min(-(-size // least_bytes), 4 * spark.sparkContext.defaultParallelism))
    keys = ["doc_id", "_hash", "_row"]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    dealt.write.format("token_files").options(tokenizer=tokenizer_path, end_id=end_id).mode("append").save(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (unsigned 32-bit) of each document."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_files").load(path)


def ids_between(path: str, start: int, n: int) -> np.ndarray:
    """Ids ``start`` to before ``start + n`` of a folder's whole sequence, by its block starts."""
    fs, folder = _folder(path)
    out = [np.empty(0, np.uint32)]
    for f in _manifest(path)["files"]:
        a, b = max(start, f["start"]), min(start + n, f["start"] + f["ids"])
        if a < b:
            with fs.open_input_file(f"{folder}/{f['name']}") as source:
                out.append(TokenFile(source).ids(a - f["start"], b - a))
    return np.concatenate(out)
