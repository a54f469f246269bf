"""Stored files as a Spark data source: ``format("stored_files")``.

Reading lists the files under ``path`` and puts them into packs of about
``partition_bytes``, so that many small files share a task and large ones have one of
their own; of over ``most_partitions`` packs, neighbours share a task. Contents are read
in the tasks. Filters on ``file_type`` and ``length`` are applied to the listing, so files
that they exclude are never opened. A file over ``most_bytes`` (2 GB, the most a cell can
hold) gives a row with an error and no content. The same source is a stream: a batch has
the files changed since the last.

``stored_files`` lists the folders in tasks when it is called, a folder a row, and writes
the packs to a folder that all executors share; the driver gets counts. The format by
itself, and the stream, list on the driver when they are planned.

Writing takes rows (path, content). Tasks write under a hidden staging folder of the
job, with a list of their objects beside these; what a task sends to the driver is the
name of its folder. The commit moves what the committed tasks wrote to its place, and an
abort deletes the folder, so a failed task or job leaves no object; a task that is late
finds no folder to write to. ``upload`` compares and moves the objects in tasks. An
object that is there already is left as it is where the bytes are the same, and is an
error where they differ unless ``upsert`` is set; a job that runs again changes nothing.

Paths are those of any file system that pyarrow opens.
"""

from __future__ import annotations

import json
import os
import posixpath
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from docketlake.sources.folders import new_folder

SCHEMA = "path string, modificationTime timestamp, length long, content binary, file_type string, error string"
PARTITION_BYTES, OPEN_BYTES, MOST_BYTES, MOST_PARTITIONS = 64 << 20, 1 << 20, (1 << 31) - 1, 1000
PACKED = pa.schema([("path", pa.string()), ("size", pa.int64()), ("changed", pa.int64())])
STAGING = ".staging-"
_COMPARED = {LessThan: lambda x, y: x < y, LessThanOrEqual: lambda x, y: x <= y, GreaterThan: lambda x, y: x > y, GreaterThanOrEqual: lambda x, y: x >= y, EqualTo: lambda x, y: x == y}


@dataclass(frozen=True)
class Stored:
    path: str
    size: int
    changed: int  # nanoseconds


@dataclass
class Files(InputPartition):
    files: list[Stored] = field(default_factory=list)


@dataclass
class Packs(InputPartition):
    spans: list[tuple[str, int, int]]  # file of packs, first, end


def file_type(path: str) -> str:
    """The lower-cased part of a name behind its last dot; the name itself without one."""
    return posixpath.basename(path).rsplit(".", 1)[-1].lower()


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    at, folder = pafs.FileSystem.from_uri(path)
    return at, folder.rstrip("/")


def listed(path: str) -> list[Stored]:
    """The files under a folder by path; hidden ones (and those in hidden folders) are left out."""
    at, folder = opened(path)
    found = at.get_file_info(pafs.FileSelector(folder, recursive=True, allow_not_found=True))
    shown = (f for f in found if f.type == pafs.FileType.File and not any(p[:1] in "._" for p in f.path[len(folder) + 1 :].split("/")))
    return sorted((Stored(f.path[len(folder) + 1 :], f.size, f.mtime_ns) for f in shown), key=lambda f: f.path)


def packed(files: list[Stored], partition_bytes: int) -> list[Files]:
    """Files in order in partitions of about ``partition_bytes``; opening a file counts too."""
    out, room = [], 0
    for f in files:
        cost = f.size + OPEN_BYTES
        if not out or cost > room:
            out.append(Files())
            room = max(partition_bytes, cost)
        out[-1].files.append(f)
        room -= cost
    return out


def _in_folder(at: pafs.FileSystem, folder: str, below: str) -> Iterator[tuple[Stored, bool]]:
    """What is right in a folder, and whether it is a folder; without hidden ones. Local folders are not held."""
    start = f"{below}/" if below else ""
    if not isinstance(at, pafs.LocalFileSystem):
        for f in at.get_file_info(pafs.FileSelector(f"{folder}/{below}".rstrip("/"), allow_not_found=True)):
            if f.base_name[:1] not in "._" and f.type in (pafs.FileType.File, pafs.FileType.Directory):
                yield Stored(start + f.base_name, f.size or 0, f.mtime_ns or 0), f.type == pafs.FileType.Directory
        return
    try:
        entries = os.scandir(f"{folder}/{below}")
    except FileNotFoundError:
        return
    with entries:
        for e in entries:
            if e.name[:1] in "._":
                continue
            try:
                if e.is_dir():
                    yield Stored(start + e.name, 0, 0), True
                elif e.is_file():
                    yield Stored(start + e.name, (known := e.stat()).st_size, known.st_mtime_ns), False
            except FileNotFoundError:
                pass  # deleted since it was listed


def _pack_folders(path: str, out: str, partition_bytes: int, folders: Iterable[str]) -> tuple[str, int, int]:
    """Lists folders into a file of packs, one a batch, and their folders into another: name of both, packs, folders."""
    (at, folder), (to, held) = opened(path), opened(out)
    name, packs, inner, room = uuid.uuid4().hex, 0, 0, 0
    pack: list[Stored] = []
    deeper: list[str] = []

    def columns(files: list[Stored]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([getattr(f, n) for f in files], k) for n, k in zip(PACKED.names, PACKED.types)], schema=PACKED)

    def below(names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["folder"])

    with to.open_output_stream(f"{held}/{name}.packs") as a, pa.ipc.new_file(a, PACKED) as told, to.open_output_stream(f"{held}/{name}.folders") as b, pa.ipc.new_stream(b, below([]).schema) as next_:
        for from_ in folders:
            for f, is_folder in _in_folder(at, folder, from_):
                if is_folder:
                    deeper.append(f.path)
                    inner += 1
                    if len(deeper) >= 10_000:
                        next_.write_batch(below(deeper))
                        deeper = []
                    continue
                cost = f.size + OPEN_BYTES
                if pack and cost > room:
                    told.write_batch(columns(pack))
                    pack, packs = [], packs + 1
                room = (room if pack else max(partition_bytes, cost)) - cost
                pack.append(f)
        if pack:
            told.write_batch(columns(pack))
            packs += 1
        if deeper:
            next_.write_batch(below(deeper))
    return name, packs, inner


def listing(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> str:
    """Lists the files under a folder in tasks, level by level; the folder of their packs.

    The driver gets a name and two counts of each task. One folder is listed by one task.
    """
    out, tasks = new_folder(spark, "listing"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    at, held = opened(out)
    at.create_dir(held, recursive=True)

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = opened(out)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with at.open_input_stream(f"{held}/{name}.folders") as f, pa.ipc.open_stream(f) as told:
                    yield from told

    def list_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folders = (x for b in batches for x in b.column(0).to_pylist())
        first = next(folders, None)
        if first is not None:
            done = _pack_folders(path, out, partition_bytes, (x for some in ((first,), folders) for x in some))
            yield pa.RecordBatch.from_pylist([dict(zip(("name", "packs", "inner"), done))])

    found: list[tuple[str, int]] = []
    level, n = spark.createDataFrame([("",)], "folder string").coalesce(1), 1
    while n:
        made = level.mapInArrow(list_, "name string, packs long, inner long").collect()
        found += [(r["name"], r["packs"]) for r in made if r["packs"]]
        names, n = [(r["name"],) for r in made if r["inner"]], sum(r["inner"] for r in made)
        if n:
            level = spark.createDataFrame(names, "name string").mapInArrow(inner, "folder string").repartition(min(n, tasks))
    with at.open_output_stream(f"{held}/listed") as f:
        f.write(json.dumps(found).encode())
    return out


def _spans(found: list[tuple[str, int]], most: int) -> list[Packs]:
    """Packs in order in partitions of equal numbers, ``most`` at most."""
    total = sum(n for _, n in found)
    count, left = min(most, total), list(reversed(found))
    out, first = [], 0
    for k in range(count):
        want, spans = total * (k + 1) // count - total * k // count, []
        while want:
            name, n = left[-1]
            took = min(want, n - first)
            spans.append((name, first, first + took))
            want, first = want - took, first + took
            if first == n:
                left.pop()
                first = 0
        out.append(Packs(spans))
    return out


def _packed_files(listing: str, spans: list[tuple[str, int, int]]) -> Iterator[Stored]:
    """The files of packs, a pack held at a time."""
    at, held = opened(listing)
    for name, first, end in spans:
        with at.open_input_file(f"{held}/{name}.packs") as f, pa.ipc.open_file(f) as told:
            for k in range(first, end):
                for row in zip(*(c.to_pylist() for c in told.get_batch(k).columns)):
                    yield Stored(*row)


def _rows(path: str, files: Iterable[Stored], most_bytes: int, batch_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    at, folder = opened(path)
    held: list[tuple] = []
    size = 0
    for f in files:
        content, error = None, None
        if f.size > most_bytes:
            error = f"File too large: {f.size} bytes"
        else:
            try:
                with at.open_input_file(f"{folder}/{f.path}") as source:
                    content = source.read()
            except FileNotFoundError:
                error = f"Object not found: {f.path}"  # deleted since it was listed
        held.append((f.path, f.changed // 1000, f.size, content, file_type(f.path), error))
        size += len(content or b"")
        if size >= batch_bytes or len(held) >= 1000:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.timestamp("us", tz="UTC"), pa.int64(), pa.binary(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["path", "modificationTime", "length", "content", "file_type", "error"])


class FilesReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.partition_bytes, self.most_bytes = int(options.get("partition_bytes", PARTITION_BYTES)), int(options.get("most_bytes", MOST_BYTES))
        self.listing, self.most_partitions = options.get("listing"), int(options.get("most_partitions", MOST_PARTITIONS))
        self.kept: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name == "file_type" and isinstance(f, (EqualTo, In)) or name == "length" and type(f) in _COMPARED:
                self.kept.append(f)
            else:
                yield f

    def _keeps(self, file: Stored) -> bool:
        for f in self.kept:
            value = file_type(file.path) if f.attribute[0] == "file_type" else file.size
            if not (value in f.value if isinstance(f, In) else _COMPARED[type(f)](value, f.value)):
                return False
        return True

    def partitions(self):
        if self.listing:
            at, held = opened(self.listing)
            with at.open_input_stream(f"{held}/listed") as f:
                return _spans(json.loads(f.read()), self.most_partitions) or [Files()]
        packs = packed([f for f in listed(self.path) if self._keeps(f)], self.partition_bytes) or [Files()]
        share = -(-len(packs) // self.most_partitions)
        return [Files([f for p in packs[k : k + share] for f in p.files]) for k in range(0, len(packs), share)]

    def read(self, partition):
        files = partition.files if isinstance(partition, Files) else (f for f in _packed_files(self.listing, partition.spans) if self._keeps(f))
        return _rows(self.path, files, self.most_bytes)


class FilesStream(DataSourceStreamReader):
    """Batches by time of change; a file is taken once its time is ``settle_ms`` past."""

    def __init__(self, options):
        self.path = options["path"]
        self.partition_bytes, self.most_bytes = int(options.get("partition_bytes", PARTITION_BYTES)), int(options.get("most_bytes", MOST_BYTES))
        self.settle = int(options.get("settle_ms", 1000)) * 1_000_000

    def initialOffset(self) -> dict:
        return {"changed": -1}

    def latestOffset(self) -> dict:
        until = time.time_ns() - self.settle
        return {"changed": max((f.changed for f in listed(self.path) if f.changed <= until), default=-1)}

    def partitions(self, start: dict, end: dict):
        return packed([f for f in listed(self.path) if start["changed"] < f.changed <= end["changed"]], self.partition_bytes)

    def read(self, partition):
        return _rows(self.path, partition.files, self.most_bytes)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Staged(WriterCommitMessage):
    folder: str  # of a task's objects and of the list of them


def checked_path(path: str | None) -> str:
    """A path below the root; an error for one that is empty, absolute, hidden or leaves it."""
    clean = posixpath.normpath(path or "")
    if not path or clean.startswith(("/", "..")) or clean == "." or any(p[:1] in "._" for p in clean.split("/")):
        raise ValueError(f"not a path of an object: {path!r}")
    return clean


def _same(at: pafs.FileSystem, a: str, b: str) -> bool:
    x, y = at.get_file_info([a, b])
    if x.size != y.size:
        return False
    with at.open_input_stream(a) as s, at.open_input_stream(b) as t:
        while True:
            p, q = s.read(1 << 20), t.read(1 << 20)
            if p != q:
                return False
            if not p:
                return True


LISTED = pa.schema([("name", pa.string()), ("path", pa.string())])  # staged name, path


def _objects(at: pafs.FileSystem, own: str) -> Iterator[pa.RecordBatch]:
    """The objects of a task's folder, in batches."""
    with at.open_input_stream(f"{own}/objects") as f, pa.ipc.open_stream(f) as held:
        yield from held


def _publish(at: pafs.FileSystem, folder: str, name: str, path: str) -> None:
    """Moves a staged object to its place, unless its bytes are there; may run again."""
    to = f"{folder}/{path}"
    old, new = at.get_file_info([to, name])
    there = old.type != pafs.FileType.NotFound
    if there and (new.type == pafs.FileType.NotFound or _same(at, name, to)):
        return
    at.create_dir(posixpath.dirname(to), recursive=True)
    at.move(name, to)


def _differs(at: pafs.FileSystem, folder: str, name: str, path: str) -> bool:
    """Whether other bytes are at the object's place."""
    to = f"{folder}/{path}"
    return at.get_file_info(to).type != pafs.FileType.NotFound and not _same(at, name, to)


def _clear(at: pafs.FileSystem, staging: str) -> None:
    """Deletes a staging folder; a task that still writes may add to it meanwhile, so some tries."""
    for n in range(20):
        if at.get_file_info(staging).type != pafs.FileType.Directory:
            return
        try:
            at.delete_dir(staging)
        except OSError:
            if n == 19:
                raise
            time.sleep(0.05)


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, options, schema):
        self.path, self.upsert = options["path"], options.get("upsert", "false").lower() == "true"
        self.staging, self.later = options.get("staging") or f"{STAGING}{uuid.uuid4().hex}", "staging" in options
        names = schema.fieldNames()
        if not {"path", "content"} <= set(names):
            raise ValueError("needs the columns path and content")
        self.at = names.index("path"), names.index("content")
        at, folder = opened(self.path)
        at.create_dir(f"{folder}/{self.staging}", recursive=True)

    def write(self, iterator) -> Staged:
        at, folder = opened(self.path)
        own, n = f"{folder}/{self.staging}/{uuid.uuid4().hex}", 0
        at.create_dir(own, recursive=False)  # an error once the job has given up
        with at.open_output_stream(f"{own}/objects") as f, pa.ipc.new_stream(f, LISTED) as told:
            for batch in iterator:
                objects: list[tuple[str, str]] = []
                for path, content in zip(batch.column(self.at[0]), batch.column(self.at[1])):
                    to = checked_path(path.as_py())
                    name = f"{own}/{n}"
                    with at.open_output_stream(name) as out:
                        out.write(content.as_buffer() if content.is_valid else b"")
                    objects.append((name, to))
                    n += 1
                told.write_batch(pa.RecordBatch.from_arrays([pa.array([o[k] for o in objects], pa.string()) for k in (0, 1)], schema=LISTED))
        return Staged(own)

    def commit(self, messages) -> None:
        at, folder = opened(self.path)
        if self.later:  # upload goes on from here
            with at.open_output_stream(f"{folder}/{self.staging}/committed") as out:
                out.write("\n".join(m.folder for m in messages if m).encode())
            return
        try:
            seen: set[str] = set()
            staged = lambda: ((o["name"], o["path"]) for m in messages if m for b in _objects(at, m.folder) for o in b.to_pylist())
            for name, to in staged():
                if to in seen:
                    raise ValueError("a path is written twice")
                seen.add(to)
                if not self.upsert and _differs(at, folder, name, to):
                    raise FileExistsError(f"The resource already exists: {to}")
            for name, to in staged():
                _publish(at, folder, name, to)
        finally:
            _clear(at, f"{folder}/{self.staging}")

    def abort(self, messages) -> None:
        at, folder = opened(self.path)
        _clear(at, f"{folder}/{self.staging}")


class StoredFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stored_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FilesReader:
        return FilesReader(self.options)

    def streamReader(self, schema) -> FilesStream:
        return FilesStream(self.options)

    def writer(self, schema, overwrite) -> FilesWriter:
        return FilesWriter(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, with filters pushed to its listing."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoredFiles)


def stored_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """path (below the root), modificationTime, length, content, file_type, error of each file there now."""
    register(spark)
    packs = listing(spark, path, int(options.get("partition_bytes", PARTITION_BYTES)))
    return spark.read.format("stored_files").options(**options, listing=packs).load(path)


def upload(objects: DataFrame, path: str, upsert: bool = False) -> None:
    """Writes rows (path, content) as objects below ``path``, all of them or none.

    Objects are staged, compared and moved in tasks; the driver gets a folder's name of each task.
    """
    spark, staging = objects.sparkSession, f"{STAGING}{uuid.uuid4().hex}"
    register(spark)
    at, folder = opened(path)
    try:
        objects.select("path", "content").write.format("stored_files").option("staging", staging).mode("append").save(path)
        with at.open_input_stream(f"{folder}/{staging}/committed") as f:
            tasks = [(own,) for own in f.read().decode().split("\n") if own]
        if not tasks:
            return

        def staged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for own in batch.column(0).to_pylist():
                    yield from _objects(opened(path)[0], own)

        rows = spark.createDataFrame(tasks, "own string").repartitionByRange(len(tasks), "own").mapInArrow(staged, "name string, path string")
        if rows.groupBy("path").count().filter("count > 1").limit(1).collect():
            raise ValueError("a path is written twice")

        def clashing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, folder = opened(path)
            for batch in batches:
                yield batch.filter(pa.array([_differs(at, folder, o["name"], o["path"]) for o in batch.to_pylist()], pa.bool_()))

        if not upsert and (clash := rows.mapInArrow(clashing, rows.schema).limit(1).collect()):
            raise FileExistsError(f"The resource already exists: {clash[0]['path']}")

        def moving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, folder = opened(path)
            for batch in batches:
                for o in batch.to_pylist():
                    _publish(at, folder, o["name"], o["path"])
                yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], names=["n"])

        rows.mapInArrow(moving, "n long").agg(F.sum("n")).collect()
    finally:
        _clear(at, f"{folder}/{staging}")


def remove(path: str, wanted: DataFrame) -> DataFrame:
    """Deletes the wanted objects (path) in tasks: path, removed. One that is not there is not removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, folder = opened(path)
        for batch in batches:
            done = []
            for p in batch.column(0).to_pylist():
                info = at.get_file_info(f"{folder}/{checked_path(p)}")
                if info.type == pafs.FileType.File:
                    at.delete_file(info.path)
                done.append(info.type == pafs.FileType.File)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done)], names=["path", "removed"])

    return wanted.select("path").distinct().mapInArrow(run, "path string, removed boolean")


def remove_with_chunks(path: str, chunks: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks left, removed objects): the objects go, and all chunks whose metadata names them.

    The chunks left do not depend on the removal, so they may be written first; then write
    the second result, whose job deletes. Either may run again.
    """
    key = F.get_json_object("metadata", "$.storage_path")
    left = chunks.withColumn("_path", key).join(wanted.select(F.col("path").alias("_path")).distinct(), "_path", "left_anti").select(*chunks.columns)
    return left, remove(path, wanted)

