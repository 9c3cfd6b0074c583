"""Binary vector files as a Spark data source named ``vecfile``.

Layouts (little endian): ``fvecs``/``ivecs`` hold one record per vector, an
int32 dimension and the values; ``fbin``/``ibin`` start with a uint32 count
and a uint32 dimension followed by all values. Values are float32 or int32.

Records have one fixed size, so a file is cut into row ranges that are read
independently. A directory is read as its files in name order, and ``vec_id``
is the row position over all of them.
"""

from __future__ import annotations

import os
import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

FLOAT_KINDS = ("fvecs", "fbin")
INT_KINDS = ("ivecs", "ibin")
KINDS = FLOAT_KINDS + INT_KINDS
PARTITION_BYTES = 64 * 1024 * 1024
BATCH_BYTES = 8 * 1024 * 1024
#: Fixed first bytes of an HDF5 file.
HDF5_SIGNATURE = b"\x89HDF\r\n\x1a\n"


def kind_of(path: str) -> str:
    """The file kind by its extension, whatever its case."""
    extension = os.path.splitext(path)[1].lower().lstrip(".")
    if extension not in KINDS:
        raise ValueError(f"unsupported vector file extension: .{extension}")
    return extension


def _open(path: str):
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def _files(path: str) -> list[tuple[pafs.FileSystem, str, int]]:
    """Data files under ``path`` with their sizes, in name order."""
    system, name = _open(path)
    info = system.get_file_info(name)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(f"cannot open {path}")
    if info.type == pafs.FileType.File:
        return [(system, name, info.size)]
    found = system.get_file_info(pafs.FileSelector(name))
    plain = [f for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "._"]
    return [(system, f.path, f.size) for f in sorted(plain, key=lambda f: f.path)]


@dataclass
class Layout:
    """Where the rows of one file are."""

    kind: str
    dim: int
    rows: int
    header: int
    prefix: int
    #: Rows whose bytes are there; fewer than ``rows`` where a counted file lost its tail.
    held: int

    @property
    def record(self) -> int:
        return self.prefix + 4 * self.dim


def _too_short(kind: str, rows: int, dim: int, size: int) -> ValueError:
    return ValueError(f"a {kind} file of {size} bytes is too short for {rows} rows of {dim} values")


def layout_of(kind: str, head: bytes, size: int, whole: bool = True) -> Layout:
    """Read a file's layout from its first bytes; ``whole`` checks it against its length."""
    if kind in ("fbin", "ibin"):
        if len(head) < 8:
            raise ValueError(f"a {kind} file needs 8 bytes of header, found {len(head)}")
        rows, dim = (int(x) for x in np.frombuffer(head[:8], "<u4"))
        if dim == 0:
            raise ValueError(f"a {kind} file states a dimension below 1")
        held = min(rows, (size - 8) // (4 * dim))
        if whole and held < rows:
            raise _too_short(kind, rows, dim, size)
        return Layout(kind, dim, rows, 8, 0, held)
    if size == 0:
        return Layout(kind, 0, 0, 0, 4, 0)
    if len(head) < 4:
        raise ValueError(f"a {kind} file needs 4 bytes of dimension, found {len(head)}")
    dim = int(np.frombuffer(head[:4], "<i4")[0])
    if dim <= 0:
        raise ValueError(f"a {kind} file states a dimension below 1")
    rows, rest = divmod(size, 4 + 4 * dim)
    rows += 1 if rest else 0
    return Layout(kind, dim, rows, 0, 4, rows)


@dataclass
class RowRange(InputPartition):
    path: str
    kind: str
    dim: int
    header: int
    prefix: int
    first: int
    count: int
    first_id: int


class VecFileReader(DataSourceReader):
    def __init__(self, path, kind, max_rows):
        self.path, self.kind, self.max_rows = path, kind, max_rows

    def pushFilters(self, filters):
        """Take upper bounds on ``vec_id``: later rows are not read at all."""
        for item in filters:
            bound = None
            if getattr(item, "attribute", None) == ("vec_id",):
                if isinstance(item, LessThan):
                    bound = item.value
                elif isinstance(item, (LessThanOrEqual, EqualTo)):
                    bound = item.value + 1
            if bound is not None:
                bound = max(0, int(bound))
                self.stop = bound if self.stop is None else min(self.stop, bound)
            yield item

    stop = None

    def partitions(self):
        parts, at = [], 0
        last = self.max_rows if self.max_rows > 0 else None
        if self.stop is not None:
            last = self.stop if last is None else min(last, self.stop)
        for name, size, layout in self._layouts(last):
            rows = layout.rows if last is None else min(layout.rows, last - at)
            if layout.held < rows:
                raise _too_short(layout.kind, layout.rows, layout.dim, size)
            step = max(1, PARTITION_BYTES // max(1, layout.record))
            for first in range(0, rows, step):
                count = min(step, rows - first)
                path = name if "://" not in self.path else _qualified(self.path, name)
                parts.append(
                    RowRange(path, layout.kind, layout.dim, layout.header, layout.prefix,
                             first, count, at + first)
                )
            at += layout.rows
        return parts or [RowRange(self.path, self.kind or "", 0, 0, 0, 0, 0, 0)]

    def _layouts(self, last):
        """Files and their layouts in order, until ``last`` rows are covered."""

        def look(entry):
            system, name, size = entry
            with system.open_input_file(name) as file:
                return name, size, layout_of(self.kind or kind_of(name), file.read(8), size, whole=False)

        files, rows = _files(self.path), 0
        with ThreadPoolExecutor(32) as pool:
            for start in range(0, len(files), 256):
                if last is not None and rows >= last:
                    return
                for name, size, layout in pool.map(look, files[start : start + 256]):
                    if last is not None and rows >= last:
                        return
                    rows += layout.rows
                    yield name, size, layout

    def read(self, part: RowRange):
        if part.count == 0:
            return
        system, name = _open(part.path)
        record = part.prefix + 4 * part.dim
        step = max(1, BATCH_BYTES // record)
        is_float = part.kind in FLOAT_KINDS
        with system.open_input_file(name) as file:
            for start in range(0, part.count, step):
                rows = min(step, part.count - start)
                data = file.read_at(rows * record, part.header + (part.first + start) * record)
                if len(data) < rows * record:
                    raise ValueError(f"{part.path} ends inside row {part.first + start + len(data) // record}")
                words = np.frombuffer(data, "<i4").reshape(rows, record // 4)
                if part.prefix:
                    if (words[:, 0] != part.dim).any():
                        raise ValueError(f"{part.path} has rows that are not of dimension {part.dim}")
                    words = words[:, 1:]
                flat = np.ascontiguousarray(words).ravel()
                if is_float:
                    flat = flat.view("<f4")
                offsets = np.arange(rows + 1, dtype=np.int32) * part.dim
                ids = np.arange(rows, dtype=np.int64) + part.first_id + start
                vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(ids), vectors], names=["vec_id", "v"])


def _qualified(root: str, name: str) -> str:
    scheme = root.split("://", 1)[0]
    return f"{scheme}://{name}"


@dataclass
class PartFile(WriterCommitMessage):
    #: Partition, and where its rows wait for the commit; empty without rows.
    part: int
    staged: str


class VecFileWriter(DataSourceArrowWriter):
    """Writes one file per partition; the rows keep the partition's order.

    Tasks write files that readers skip. The commit of the whole job names
    them, after the files that are there (append) or in their place
    (overwrite); a job that fails leaves the folder as it was.
    """

    def __init__(self, path, kind, overwrite):
        if kind not in KINDS:
            raise ValueError(f"option kind must be one of {KINDS}")
        self.path, self.kind, self.overwrite = path, kind, overwrite
        self.job = uuid.uuid4().hex

    def write(self, batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        system, folder = _open(self.path)
        system.create_dir(folder, recursive=True)
        part = context.partitionId()
        dtype = "<f4" if self.kind in FLOAT_KINDS else "<i4"
        counted = self.kind in ("fbin", "ibin")
        rows, dim = 0, 0
        # A retry of the task writes its own file; only the committed one is named.
        staged = f"{folder}/_{self.job}-{part}-{context.taskAttemptId()}"
        payload = f"{staged}-payload" if counted else staged
        with system.open_output_stream(payload) as out:
            for batch in batches:
                vectors = batch.column(batch.schema.get_field_index("v"))
                if len(vectors) == 0:
                    continue
                lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
                dim = dim or int(lengths[0])
                if (lengths != dim).any():
                    raise ValueError(f"vectors of partition {part} are not all of dimension {dim}")
                values = vectors.flatten().to_numpy(zero_copy_only=False).astype(dtype)
                values = values.reshape(len(vectors), dim)
                rows += len(vectors)
                if not counted:
                    lead = np.full((len(vectors), 1), dim, dtype="<i4")
                    values = np.hstack([lead, values.view("<i4")])
                out.write(values.tobytes())
        if rows == 0:
            return PartFile(part, "")
        if counted:
            # The count is known at the end and stands at the start.
            with system.open_input_stream(payload) as body, system.open_output_stream(staged) as out:
                out.write(np.array([rows, dim], dtype="<u4").tobytes())
                while chunk := body.read(BATCH_BYTES):
                    out.write(chunk)
        return PartFile(part, staged)

    def commit(self, messages):
        parts = sorted((m.part, m.staged) for m in messages if m is not None and m.staged)
        system, folder = _open(self.path)
        system.create_dir(folder, recursive=True)
        old = [name for _, name, _ in _files(self.path)]
        if self.overwrite:
            for name in old:
                system.delete_file(name)
            old = []
        numbers = [re.match(r"part-(\d+)\.", os.path.basename(name)) for name in old]
        start = max((int(n[1]) + 1 for n in numbers if n), default=0)
        for number, (_, staged) in enumerate(parts, start):
            system.move(staged, f"{folder}/part-{number:06d}.{self.kind}")
        self._clear(system, folder)

    def abort(self, messages):
        system, folder = _open(self.path)
        self._clear(system, folder)

    def _clear(self, system, folder):
        """Remove what this job's tasks left behind."""
        for info in system.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
            if info.base_name.startswith(f"_{self.job}-"):
                system.delete_file(info.path)


class VecFileSource(DataSource):
    @classmethod
    def name(cls):
        return "vecfile"

    def schema(self):
        kind = self.options.get("kind") or kind_of(self._first_file())
        return f"vec_id bigint, v array<{'float' if kind in FLOAT_KINDS else 'int'}>"

    def _first_file(self):
        files = _files(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no vector files under {self.options['path']}")
        return files[0][1]

    def reader(self, schema):
        return VecFileReader(
            self.options["path"], self.options.get("kind"), int(self.options.get("max_rows", 0))
        )

    def writer(self, schema, overwrite):
        return VecFileWriter(self.options["path"], self.options.get("kind"), overwrite)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` on the default file system of the cluster where it names none."""
    if "://" in path or path.startswith("file:"):
        return path
    context = spark.sparkContext
    found = context._jvm.org.apache.hadoop.fs.Path(path)
    full = found.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(found).toString()
    return path if full.startswith("file:") else full


def read_vectors(
    spark: SparkSession, path: str, kind: str | None = None, max_rows: int = 0
) -> DataFrame:
    """Points ``vec_id, v`` from a file or directory; the kind defaults to the extension."""
    spark.dataSource.register(VecFileSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("vecfile").option("max_rows", max_rows)
    if kind:
        reader = reader.option("kind", kind)
    return reader.load(qualified(spark, path))


def read_fvecs(spark, path, max_rows=0) -> DataFrame:
    return read_vectors(spark, path, "fvecs", max_rows)


def read_ivecs(spark, path, max_rows=0) -> DataFrame:
    return read_vectors(spark, path, "ivecs", max_rows)


def read_fbin(spark, path, max_rows=0) -> DataFrame:
    return read_vectors(spark, path, "fbin", max_rows)


def read_ibin(spark, path, max_rows=0) -> DataFrame:
    return read_vectors(spark, path, "ibin", max_rows)


def write_vectors(points: DataFrame, path: str, kind: str, mode: str = "append") -> None:
    """Write points in id order as a directory that ``read_vectors`` reads back.

    Range partitions keep the order over the files, so ids that run from 0
    come back as the row positions. Mode ``append`` puts the rows after those
    in the folder, ``overwrite`` in their place once all of them are written.
    """
    points.sparkSession.dataSource.register(VecFileSource)
    (
        points.select("vec_id", "v")
        .repartitionByRange("vec_id")
        .sortWithinPartitions("vec_id")
        .write.format("vecfile")
        .option("kind", kind)
        .mode(mode)
        .save(qualified(points.sparkSession, path))
    )


def truth_rows(lists: DataFrame) -> DataFrame:
    """Id lists read from ``ivecs``/``ibin`` as truth rows ``query_id, rank, vec_id``."""
    return lists.select(
        F.col("vec_id").alias("query_id"), F.posexplode("v").alias("_p", "_id")
    ).select("query_id", (F.col("_p") + 1).alias("rank"), F.col("_id").cast("bigint").alias("vec_id"))


def vector_file_inventory(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Vector files under the folders: path, size, first 32 bytes, and what they say.

    Result ``path, size, kind, head_hex, rows, dim, consistent``; a file whose
    length does not fit its header is listed as not consistent. HDF5 files are
    listed by their signature, without rows and dimension.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(paths)
        .select("path", "length")
        .filter(F.lower(F.col("path")).rlike(r"\.(fbin|ibin|fvecs|ivecs|hdf5)$"))
    )
    schema = (
        "path string, size bigint, kind string, head_hex string, "
        "rows bigint, dim bigint, consistent boolean"
    )

    def run(batches):
        for batch in batches:
            found = []
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, name = _open(path)
                with system.open_input_file(name) as file:
                    head = file.read(32)
                if path.lower().endswith(".hdf5"):
                    known = head.startswith(HDF5_SIGNATURE)
                    found.append((path, size, "hdf5", head.hex(), None, None, known))
                    continue
                kind = kind_of(path)
                try:
                    layout = layout_of(kind, head, size)
                    exact = layout.header + layout.rows * layout.record == size
                    found.append((path, size, kind, head.hex(), layout.rows, layout.dim, exact))
                except ValueError:
                    found.append((path, size, kind, head.hex(), None, None, False))
            names = ["path", "size", "kind", "head_hex", "rows", "dim", "consistent"]
            types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(),
                     pa.bool_()]
            columns = list(zip(*found)) if found else [[]] * 7
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return files.mapInArrow(run, schema)
