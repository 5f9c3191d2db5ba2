"""Packet archives: files of framed packets. A frame is an 8-byte header
(sequence u16, timestamp u32, size u16; little-endian) and the payload.

:func:`read_archives` reads files with Spark's own reader, from any store that it
knows. :class:`Archives` is a data source that writes them (and reads them too), in
stores that ``pyarrow.fs`` reaches: a shared mount, HDFS, or an object store.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Fixed value: the header's size (u16, u32, u16).
HEADER_SIZE = 8
HEADER_ERROR, PAYLOAD_ERROR = "Corrupted Opus packet header", "Corrupted Opus packet payload"
PACKET_SCHEMA = "path string, packet_no int, sequence int, timestamp long, payload binary, error string"
#: Bytes of files that one task reads, and file bytes of one batch of packets.
PARTITION_BYTES, BATCH_BYTES = 64 << 20, 8 << 20
#: Files of one batch, since small ones cost more than their bytes.
BATCH_FILES = 10_000
#: Files of which frames are looked for in step.
IN_STEP = 16
#: Files and folders that the driver lists itself; beyond, folders are dealt to about
#: FOLDER_TASKS tasks, which list them.
LISTED, FOLDER_TASKS = 10_000, 1_000


def _within(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places start, start+1, ... of all ranges in a row."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


def frames(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(file, place) of each frame of files, byte ranges of ``data``, in order; and for
    each file 0, or 1 for a broken header, 2 for a broken payload."""
    broken = np.zeros(len(begin), np.int8)
    file, at = np.flatnonzero(begin < end), begin[begin < end]
    files, places = [], []
    while len(file) > IN_STEP:  # a frame of every file that has one left
        short = at + HEADER_SIZE > end[file]
        broken[file[short]] = 1
        file, at = file[~short], at[~short]
        following = at + HEADER_SIZE + data[at + 6] + data[at + 7].astype(np.int64) * 256
        cut = following > end[file]
        broken[file[cut]] = 2
        files.append(file[~cut])
        places.append(at[~cut])
        more = ~cut & (following < end[file])
        file, at = file[more], following[more]
    view = memoryview(data)
    for f, place in zip(file.tolist(), at.tolist(), strict=True):
        last, found = int(end[f]), []
        while place < last:
            if place + HEADER_SIZE > last:
                broken[f] = 1
                break
            following = place + HEADER_SIZE + view[place + 6] + 256 * view[place + 7]
            if following > last:
                broken[f] = 2
                break
            found.append(place)
            place = following
        files.append(np.full(len(found), f))
        places.append(np.array(found, np.int64))
    file, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (files, places))
    order = np.lexsort((at, file))
    kept = order[broken[file[order]] == 0]
    return file[kept], at[kept], broken


def packet_batch(paths: pa.Array, contents: pa.Array) -> dict:
    """Columns of ``PACKET_SCHEMA`` for files; a broken one has one row, an error."""
    contents = contents.cast(pa.large_binary()).fill_null(b"")
    _, offsets, raw = contents.buffers()
    offs = np.frombuffer(offsets, np.int64)[contents.offset : contents.offset + len(contents) + 1] if len(contents) else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    file, at, broken = frames(data, offs[:-1], offs[1:])
    byte = lambda k: data[at + k].astype(np.int64)
    size = byte(6) + byte(7) * 256
    bad = np.flatnonzero(broken)
    order = np.argsort(np.concatenate((file, bad)), kind="stable")
    is_bad = np.concatenate((np.zeros(len(file), bool), np.ones(len(bad), bool)))[order]
    size_of = np.concatenate((size, np.zeros(len(bad), np.int64)))[order]
    payload = data[_within(at + HEADER_SIZE, size)]
    ends = np.concatenate(([0], np.cumsum(size_of)))
    payloads = pa.Array.from_buffers(pa.large_binary(), len(order), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(payload.tobytes())])
    masked = lambda x, kind: pa.array(np.concatenate((x, np.zeros(len(bad), np.int64)))[order], kind, mask=is_bad)
    number = np.arange(len(file)) - np.searchsorted(file, file)
    message = np.where(broken == 1, HEADER_ERROR, PAYLOAD_ERROR).astype(object)
    return {
        "path": paths.take(pa.array(np.concatenate((file, bad))[order])), "packet_no": masked(number, pa.int32()), "sequence": masked(byte(0) + byte(1) * 256, pa.int32()),
        "timestamp": masked(byte(2) + (byte(3) << 8) + (byte(4) << 16) + (byte(5) << 24), pa.int64()),
        "payload": pc.if_else(pa.array(is_bad), pa.scalar(None, pa.binary()), payloads.cast(pa.binary())),
        "error": pa.array(np.where(is_bad, message[np.concatenate((file, bad))[order]], None), pa.string()),
    }


_ARROW = pa.schema([("path", pa.string()), ("packet_no", pa.int32()), ("sequence", pa.int32()), ("timestamp", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])


def _batches(paths: pa.Array, contents: pa.Array) -> Iterator[pa.RecordBatch]:
    """Packets of some files at a time."""
    sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in contents], np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // BATCH_BYTES, prepend=-1))
    for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(sizes)], strict=True):
        found = packet_batch(paths[i:j].cast(pa.string()), contents[i:j])
        yield pa.RecordBatch.from_arrays([found[f.name] for f in _ARROW], schema=_ARROW)


def packets_of(archives: DataFrame) -> DataFrame:
    """One row per packet of archives (path, content). An empty file has no
    rows; a broken one has a single row with ``error`` and no packet, and
    other files are not touched by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches(batch.column("path"), batch.column("content"))

    return archives.select("path", "content").mapInArrow(run, PACKET_SCHEMA)


def read_archives(spark: SparkSession, folder: str, pattern: str = "*.skopus") -> DataFrame:
    """Packets of all archives in a folder and those below."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return packets_of(files)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the files in a folder and those below, as paths below it;
    no file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    # Spark gives whole addresses, whose form differs from store to store.
    name = F.concat(F.lit("/"), F.regexp_extract("path", r"^[A-Za-z0-9]+:/*(.*)$", 1))
    base = "/" + folder.split(":", 1)[-1].strip("/") + "/"
    return files.select(F.substr(name, F.instr(name, base) + len(base)).alias("path"), "length")


def framed(packets: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of packets (sequence, timestamp, payload) as frames in a row, and the
    place at which each one ends."""
    payload = packets.column("payload").cast(pa.large_binary()).fill_null(b"")
    _, offsets, raw = payload.buffers()
    offs = np.frombuffer(offsets, np.int64)[payload.offset : payload.offset + len(payload) + 1]
    size = np.diff(offs)
    if len(size) and size.max() > 0xFFFF:
        raise ValueError("a payload of over 65,535 bytes does not fit a frame")
    ends = np.cumsum(size + HEADER_SIZE)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    header = np.zeros(len(size), [("sequence", "<u2"), ("timestamp", "<u4"), ("size", "<u2")])
    header["sequence"], header["timestamp"], header["size"] = packets.column("sequence").to_numpy(), packets.column("timestamp").to_numpy(), size
    begin = ends - size - HEADER_SIZE
    out[(begin[:, None] + np.arange(HEADER_SIZE)).reshape(-1)] = header.view(np.uint8).reshape(-1)
    out[_within(begin + HEADER_SIZE, size)] = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None else 0
    return out, ends


def archives_of(packets: DataFrame) -> DataFrame:
    """(path, content) of packets (path, arrival_no, sequence, timestamp,
    payload), framed in arrival order. A segment's packets are one value, as
    they are one file; a segment ends at the first silence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("packets")
            every = lists.flatten()
            raw, ends = framed(pa.RecordBatch.from_struct_array(every))
            counts = np.array([len(x) for x in lists], np.int64)
            cuts = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
            content = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([batch.column("path"), content.cast(pa.binary())], ["path", "content"])

    fields = F.struct("arrival_no", "sequence", "timestamp", "payload")
    return packets.groupBy("path").agg(F.array_sort(F.collect_list(fields)).alias("packets")).mapInArrow(run, "path string, content binary")


# ---- files -------------------------------------------------------------------
def _store(folder: str):
    """A store and the folder's place in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)


def _checked(path: str) -> str:
    if path.startswith("/") or ":" in path or ".." in path.split("/") or not path.strip("/"):
        raise ValueError(f"not a path below the folder: {path}")
    return path


def _found(store, place: str) -> list:
    """What a folder holds, without folders of jobs that are not done."""
    from pyarrow import fs

    return [f for f in store.get_file_info(fs.FileSelector(place, allow_not_found=True)) if not f.base_name.startswith("_staged-")]


@dataclass
class Files(InputPartition):
    """Files, or folders with all that is below them."""

    paths: list[str]
    folders: bool = False


@dataclass
class Written(WriterCommitMessage):
    """A task's staged folder: files by their number, and beside it the text of their
    paths, so that no list of files passes the driver."""

    staged: str
    n_files: int


class Archives(DataSource):
    """``spark.read.format("skopus").load(folder)`` gives ``PACKET_SCHEMA``; its paths
    are below the folder. To be written are packets (path, sequence, timestamp,
    payload), those of a path in a row and in order, or whole files (path, content);
    :func:`write_archives` sorts packets so. Register it with :func:`register`."""

    @classmethod
    def name(cls) -> str:
        return "skopus"

    def schema(self) -> str:
        return PACKET_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(self.options["path"], self.options.get("suffix", ".skopus"), int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("archives are only added: use mode('append')")
        return ArchiveWriter(self.options["path"], self.options.get("job"))


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, suffix: str, partition_bytes: int):
        self.folder, self.suffix, self.partition_bytes = folder, suffix, partition_bytes

    def partitions(self) -> list[Files]:
        """Files in tasks of about as many bytes each; a larger file is one task. Once
        LISTED files and folders have been found, the folders of the next level are
        dealt to tasks."""
        store, base = _store(self.folder)
        found, level = [], [base.rstrip("/")]
        while level and len(found) + len(level) <= LISTED:
            every = [f for folder in level for f in _found(store, folder)]
            found += [f for f in every if f.is_file and f.path.lower().endswith(self.suffix)]
            level = [f.path for f in every if not f.is_file]
        found.sort(key=lambda f: f.path)
        below = len(base.rstrip("/")) + 1
        ends = np.cumsum([f.size or 0 for f in found])
        cuts = np.flatnonzero(np.diff(np.maximum(ends - 1, 0) // self.partition_bytes, prepend=-1)).tolist()
        size = -(-len(level) // FOLDER_TASKS)
        folders = [Files([p[below:] for p in level[i : i + size]], True) for i in range(0, len(level), max(1, size))]
        return [Files([f.path[below:] for f in found[i:j]]) for i, j in zip(cuts, [*cuts, len(found)][1:], strict=True)] + folders

    def _paths(self, partition: Files) -> Iterator[str]:
        if not partition.folders:
            yield from partition.paths
            return
        store, base = _store(self.folder)
        below, level = len(base.rstrip("/")) + 1, [f"{base.rstrip('/')}/{p}" for p in reversed(partition.paths)]
        while level:
            every = sorted(_found(store, level.pop()), key=lambda f: f.path)
            yield from (f.path[below:] for f in every if f.is_file and f.path.lower().endswith(self.suffix))
            level += [f.path for f in reversed(every) if not f.is_file]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, base = _store(self.folder)
        held, size = [], 0
        for path in self._paths(partition):
            with store.open_input_stream(f"{base}/{path}") as file:
                held.append((path, file.read()))
            size += len(held[-1][1])
            if size >= BATCH_BYTES or len(held) >= BATCH_FILES:
                yield from self._packets(held)
                held, size = [], 0
        yield from self._packets(held)

    def _packets(self, held: list[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
        if held:
            yield from _batches(pa.array([p for p, _ in held]), pa.array([c for _, c in held], pa.large_binary()))


def _put(folder: str, written: list[str]) -> int:
    """Moves what tasks have staged into place; files that an earlier try has moved stay there."""
    from pyarrow import fs

    store, base = _store(folder)
    n = 0
    for staged in written:
        with store.open_input_stream(f"{base}/{staged}.paths") as file:
            paths = json.loads(file.read())
        for k, path in enumerate(paths):
            source, target = f"{base}/{staged}/{k}", f"{base}/{path}"
            try:
                store.move(source, target)
            except OSError:
                if store.get_file_info(source).type == fs.FileType.NotFound:
                    if store.get_file_info(target).type == fs.FileType.NotFound:
                        raise
                    continue
                store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                store.move(source, target)
        n += len(paths)
    return n


class ArchiveWriter(DataSourceArrowWriter):
    """A task writes files of its own, in a staged folder; the commit of the job puts
    them in place. Files of failed tasks and jobs are never seen. With a ``job`` named,
    the commit only notes which tasks have succeeded, for :func:`_written`."""

    def __init__(self, folder: str, job: str | None = None):
        self.folder, self.apart = folder, job is not None
        self.job = job or f"_staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = _store(self.folder)
        staged, paths, file, current = f"{self.job}/{uuid.uuid4().hex}", [], None, None
        store.create_dir(f"{base}/{staged}", recursive=True)
        try:
            for batch in iterator:
                names = batch.column("path").to_pylist()
                if "content" in batch.schema.names:
                    content = batch.column("content").cast(pa.large_binary()).fill_null(b"")
                    pieces = [(p, c.as_buffer()) for p, c in zip(names, content, strict=True)]
                    whole = True
                else:
                    raw, ends = framed(batch)
                    cuts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
                    places = [0, *ends.tolist()]
                    pieces = [(names[i], raw[places[i] : places[j]]) for i, j in zip(cuts, [*cuts[1:], len(names)], strict=True)]
                    whole = False
                for path, piece in pieces:
                    if whole or path != current:
                        if file is not None:
                            file.close()
                        _checked(path)
                        file, current = store.open_output_stream(f"{base}/{staged}/{len(paths)}"), path
                        paths.append(path)
                    file.write(pa.py_buffer(piece))
        finally:
            if file is not None:
                file.close()
        with store.open_output_stream(f"{base}/{staged}.paths") as file:
            file.write(json.dumps(paths).encode())
        return Written(staged, len(paths))

    def commit(self, messages: list[Written | None]) -> None:
        written = [m.staged for m in messages if m and m.n_files]
        if self.apart:
            store, base = _store(self.folder)
            store.create_dir(f"{base}/{self.job}", recursive=True)
            with store.open_output_stream(f"{base}/{self.job}/written") as file:
                file.write(json.dumps(written).encode())
            return
        _put(self.folder, written)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, base = _store(self.folder)
        from pyarrow import fs

        if store.get_file_info(f"{base}/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{base}/{self.job}")


def _written(rows: DataFrame, folder: str) -> None:
    """Write rows to a staged folder; when that is done, tasks put each other's files in
    place, since moving them one by one takes the driver as long as there are files."""
    spark, writer = rows.sparkSession, ArchiveWriter(folder, f"_staged-{uuid.uuid4().hex}")
    register(spark)
    rows.write.format("skopus").option("job", writer.job).mode("append").save(folder)
    store, base = _store(folder)
    with store.open_input_stream(f"{base}/{writer.job}/written") as file:
        written = json.loads(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_put(folder, [written[i] for i in batch.column("id").to_pylist()])], pa.int64())], ["n"])

    if written:
        spark.range(0, len(written), 1, len(written)).mapInArrow(run, "n long").agg(F.sum("n")).first()
    writer.abort([])


def _tasks(spark: SparkSession) -> int:
    """Tasks for files: named, since small files cost more than Spark's sizes tell it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Archives)


def write_archives(packets: DataFrame, folder: str, partitions: int | None = None) -> None:
    """Write packets (path, arrival_no, sequence, timestamp, payload) to files below
    ``folder``, in order of arrival. A file is written as its packets come: no segment
    is held as a whole."""
    rows = packets.select("path", "arrival_no", F.col("sequence").cast("int").alias("sequence"), F.col("timestamp").cast("long").alias("timestamp"), "payload")
    dealt = rows.repartition(partitions or _tasks(packets.sparkSession), "path")
    _written(dealt.sortWithinPartitions("path", "arrival_no").drop("arrival_no"), folder)


def write_files(files: DataFrame, folder: str, partitions: int | None = None) -> None:
    """Write whole files (path, content)."""
    _written(files.select("path", "content").repartition(partitions or _tasks(files.sparkSession), "path"), folder)


def existing(paths: DataFrame, folder: str, partitions: int | None = None) -> DataFrame:
    """(path, length) of those (path) that are files below a folder. The task that has a
    path asks for it: no folder is listed, and no list passes the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        for batch in batches:
            names = [p for p in batch.column("path").to_pylist() if p and ".." not in p.split("/")]
            found = [(p, f.size) for p, f in zip(names, store.get_file_info([f"{base}/{p}" for p in names]), strict=True) if f.is_file]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["path", "length"])

    return paths.select("path").repartition(partitions or _tasks(paths.sparkSession), "path").distinct().mapInArrow(run, "path string, length long")


def listed(folders: DataFrame, folder: str) -> DataFrame:
    """(path, is_file) of what folders (path), below ``folder``, hold; each is listed by the
    task that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        below = len(base.rstrip("/")) + 1
        for batch in batches:
            for path in batch.column("path").to_pylist():
                found = _found(store, f"{base.rstrip('/')}/{path}".rstrip("/"))
                yield pa.RecordBatch.from_arrays([pa.array([f.path[below:] for f in found], pa.string()), pa.array([f.is_file for f in found], pa.bool_())], ["path", "is_file"])

    return folders.select("path").mapInArrow(run, "path string, is_file boolean")


def contents(files: DataFrame, folder: str) -> DataFrame:
    """(path, content) of files (path) below a folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)

        def batch_of(held: list[tuple[str, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in held], pa.string()), pa.array([c for _, c in held], pa.binary())], ["path", "content"])

        held, size = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_stream(f"{base}/{path}") as file:
                    held.append((path, file.read()))
                size += len(held[-1][1])
                if size >= BATCH_BYTES or len(held) >= BATCH_FILES:
                    yield batch_of(held)
                    held, size = [], 0
        if held:
            yield batch_of(held)

    return files.select("path").mapInArrow(run, "path string, content binary")
