"""Ink files as Spark data sources: InkML documents, and corpora of shards whose writing can be restarted.

``register(spark)`` makes the formats ``inkml`` and ``ink_shards`` known.  Files are
reached through Arrow's file systems (local, HDFS, S3, ..), from the driver to
list them and from the executors to read and write them.
"""

from __future__ import annotations

import uuid
import xml.etree.ElementTree as ElementTree
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of files that a task reads.
PARTITION_BYTES = 16 << 20
#: Points in a batch.
BATCH_ROWS = 10_000
POINTS = "file string, notes map<string,string>, leaf string, kind string, role string, element string, unit int, label string, trace_id string, brush string, seq int, x double, y double, t double"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    paths: list[str]


class InkmlSource(DataSource):
    """Reads InkML: a row for each point, with its trace, brush, labelled group and the document's notes; writes ``name, xml`` as files."""

    @classmethod
    def name(cls) -> str:
        return "inkml"

    def schema(self) -> str:
        return POINTS

    def reader(self, schema) -> DataSourceReader:
        return InkmlReader(self.options["path"], int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return FileWriter(self.options["path"])


class InkmlReader(DataSourceReader):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size

    def partitions(self) -> list[Files]:
        """Files in order of their names, so many bytes together; hidden files and those of other kinds go."""
        system, path = _opened(self.path)
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        out, held = [], self.size
        for f in sorted((f for f in found if f.type == fs.FileType.File and f.path.endswith(".inkml") and not f.base_name.startswith((".", "_"))), key=lambda f: f.path):
            if held >= self.size:
                out, held = [*out, Files([])], 0
            out[-1].paths.append(f.path)
            held += f.size
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.path)
        schema = pa.schema([("file", pa.string()), ("notes", pa.map_(pa.string(), pa.string())), *[(c, pa.string()) for c in ("leaf", "kind", "role", "element")], ("unit", pa.int32()), *[(c, pa.string()) for c in ("label", "trace_id", "brush")], ("seq", pa.int32()), *[(c, pa.float64()) for c in "xyt"]])
        rows: list[tuple] = []
        for path in partition.paths:
            with system.open_input_stream(path) as stream:
                for row in points(path.rsplit("/", 1)[-1], ElementTree.parse(stream).getroot()):
                    rows.append(row)
                    if len(rows) == BATCH_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _own(node: ElementTree.Element, tag: str) -> list[ElementTree.Element]:
    """Children by tag, whatever the namespace."""
    return [c for c in node if c.tag.rsplit("}", 1)[-1] == tag]


def _notes(node: ElementTree.Element) -> dict[str, str]:
    return {a.get("type", ""): (a.text or "").strip() for a in _own(node, "annotation")}


def points(file: str, ink: ElementTree.Element) -> Iterator[tuple]:
    """Rows of a document. Channels are read in the order that its format names, X and Y where it names none; others than X, Y and T are skipped.

    A trace that labelled units name has a row for each of these; a trace that none
    names has null in their columns.  Raises ValueError on difference encoding,
    points with too few values, and units that name unknown traces.
    """
    formats = [f for f in ink.iter() if f.tag.rsplit("}", 1)[-1] == "traceFormat"]
    channels = [c.get("name") for c in _own(formats[0], "channel")] if formats else ["X", "Y"]
    at = {c: channels.index(c) for c in "XYT" if c in channels}
    if "X" not in at or "Y" not in at:
        raise ValueError(f"{file}: the trace format has no X and Y")
    notes, used, names = _notes(ink), {}, set()
    for outer in _own(ink, "traceGroup"):
        for group in _own(outer, "traceGroup"):
            about = _notes(group)
            for k, unit in enumerate(_own(group, "traceGroup")):
                for view in _own(unit, "traceView"):
                    place = (about.get("element_id"), about.get("kind"), about.get("role", ""), about.get("element"), k, _notes(unit).get("label"))
                    used.setdefault((view.get("traceDataRef") or "").lstrip("#"), []).append(place)
    for trace in (n for n in ink.iter() if n.tag.rsplit("}", 1)[-1] == "trace"):
        name = trace.get("id") or trace.get("{http://www.w3.org/XML/1998/namespace}id")
        text = trace.text or ""
        if any(c in text for c in "'\"*!"):
            raise ValueError(f"{file}: difference encoding isn't supported")
        for seq, point in enumerate(p.split() for p in text.split(",") if p.strip()):
            if len(point) < len(channels):
                raise ValueError(f"{file}: a point of trace {name} has {len(point)} of {len(channels)} values")
            x, y, t = (float(point[at[c]]) if c in at else None for c in "XYT")
            for place in used.get(name, [(None,) * 6]):
                yield (file, list(notes.items()), *place, name, (trace.get("brushRef") or "").lstrip("#") or None, seq, x, y, t)
        names.add(name)
    if missing := set(used) - names:
        raise ValueError(f"{file}: units name unknown traces {sorted(missing)[:3]}")


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: (temporary, final)."""

    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    """Writes files under temporary names; all get their own once every task is done.

    A task that fails removes what it wrote; so does the driver when the job
    fails.  Files that are there already stay, and aren't written again.
    """

    def __init__(self, path: str) -> None:
        self.path = path

    def files(self, batches: Iterator[pa.RecordBatch], put) -> None:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _opened(self.path)
        system.create_dir(root, recursive=True)
        done: list[tuple[str, str]] = []

        def put(name: str) -> str | None:
            """Where to write a file, None if it is there."""
            final = f"{root}/{name}"
            if system.get_file_info(final).type == fs.FileType.File:
                return None
            done.append((f"{root}/.{uuid.uuid4().hex}-{name}", final))
            return done[-1][0]

        try:
            self.files(iterator, put)
        except BaseException:
            _removed(system, done)
            raise
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = _opened(self.path)
        for temporary, final in (f for m in messages if m for f in m.files):
            system.move(temporary, final)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _opened(self.path)
        _removed(system, [f for m in messages if m for f in m.files])


def _removed(system: fs.FileSystem, files: list[tuple[str, str]]) -> None:
    for temporary, _ in files:
        if system.get_file_info(temporary).type == fs.FileType.File:
            system.delete_file(temporary)


class FileWriter(_Writer):
    """Rows of ``name`` and ``xml`` as files, whole."""

    def files(self, batches: Iterator[pa.RecordBatch], put) -> None:
        system, _ = _opened(self.path)
        for batch in batches:
            for name, xml in zip(batch.column("name").to_pylist(), batch.column("xml").to_pylist()):
                if (at := put(f"{name}.inkml")) is not None:
                    with system.open_output_stream(at) as out:
                        out.write((xml or "").encode())


class ShardSource(DataSource):
    """Writes a corpus in shards, one Parquet file for each value of ``shard``; see ``write_shards``. Read it as Parquet."""

    @classmethod
    def name(cls) -> str:
        return "ink_shards"

    def schema(self) -> str:
        raise NotImplementedError("read shards with spark.read.parquet")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ShardWriter(self.options["path"])


class ShardWriter(_Writer):
    def files(self, batches: Iterator[pa.RecordBatch], put) -> None:
        """Rows come in order of their shard, as ``write_shards`` deals them."""
        system, _ = _opened(self.path)
        shard, out, seen = None, None, False
        try:
            for batch in batches:
                values = batch.column("shard").to_pylist()
                starts = [i for i in range(len(values)) if i == 0 or values[i] != values[i - 1]]
                for a, b in zip(starts, [*starts[1:], len(values)]):
                    if not seen or values[a] != shard:
                        if out is not None:
                            out.close()
                        shard, seen = values[a], True
                        at = put(f"shard-{shard:05d}.parquet")
                        out = None if at is None else pq.ParquetWriter(at, batch.schema, filesystem=system)
                    if out is not None:
                        out.write_batch(batch.slice(a, b - a))
        finally:
            if out is not None:
                out.close()


def register(spark: SparkSession) -> None:
    for source in (InkmlSource, ShardSource):
        spark.dataSource.register(source)


def read_ink_documents(spark: SparkSession, path: str) -> DataFrame:
    """Points of the InkML files at ``path``; see ``points``."""
    register(spark)
    return spark.read.format("inkml").load(path)


def write_ink_documents(documents: DataFrame, path: str) -> None:
    """``documents(name, xml)`` as files ``name.inkml``; those that are there stay."""
    register(documents.sparkSession)
    documents.select("name", "xml").write.format("inkml").mode("append").save(path)


def write_shards(lines: DataFrame, path: str) -> None:
    """``lines(.., shard int)`` as ``shard-NNNNN.parquet``: all new shards appear when every task is done, finished ones are skipped, so a failed run can be started again."""
    register(lines.sparkSession)
    lines.repartition("shard").sortWithinPartitions("shard").write.format("ink_shards").mode("append").save(path)
