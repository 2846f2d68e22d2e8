"""Flow files as a data source: SRC-19. `spark.read.format("flo").load(root)`, or write_flo().

A flow file holds a tag, its width and height, and two floats for each pixel. A reader's
partition is a range of bytes of one file or many whole small files, of about
`partition_bytes` in all, so a file of any size is read by many tasks and none is held whole.
Only the columns of the schema that is asked for are made: path (below the root), y, x, dx, dy;
without dx and dy no pixel is read. Where spark.sql.python.filterPushdown.enabled is set,
filters on path leave files out before they are opened. Values above 1e9 are invalid, that is NULL.

A writer streams rows that come sorted by (path, y, x), with the flow's w and h. Pixels that
are missing are written as invalid. Files get their names when all tasks are done.

Files are opened through pyarrow's file systems: local paths, s3, gs and, with libhdfs, hdfs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

# The tag of flow files, and the value above which a flow is invalid.
FLO_TAG = b"PIEH"
INVALID = 1e9
HEAD = 12
SCHEMA = "path string, y long, x long, dx double, dy double"
PARTITION_BYTES = 32 << 20
#: Pixels of a batch.
BATCH = 1 << 17


def file_system(root: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


@dataclass
class FileRanges(InputPartition):
    """(path below the root, first pixel, pixels after the last one)."""

    ranges: list[tuple[str, int, int]]


class FlowReader(DataSourceReader):
    def __init__(self, root: str, columns: list[str], partition_bytes: int):
        self.root, self.columns, self.partition_bytes = root, columns, partition_bytes
        self.only: set[str] | None = None

    def partitions(self):
        from pyarrow import fs

        system, base = file_system(self.root)
        base = base.rstrip("/")
        found = sorted((i.path, i.size) for i in system.get_file_info(fs.FileSelector(base, recursive=True)) if i.is_file and i.path.endswith(".flo") and not i.base_name.startswith((".", "_")))
        most, out, held, size = max(1, self.partition_bytes // 8), [], [], 0
        for path, bytes_ in found:
            name = path[len(base) + 1 :]
            if self.only is not None and name not in self.only:
                continue
            pixels = max(0, bytes_ - HEAD) // 8
            for a in range(0, pixels, most) or (0,):
                b = min(a + most, pixels)
                if held and size + b - a > most:
                    out.append(FileRanges(held))
                    held, size = [], 0
                held.append((name, a, b))
                size += b - a
        return out + [FileRanges(held)] if held or not out else out

    def read(self, partition: FileRanges) -> Iterator[pa.RecordBatch]:
        system, base = file_system(self.root)
        for name, first, last in partition.ranges:
            with system.open_input_file(f"{base.rstrip('/')}/{name}") as f:
                head = f.read_at(HEAD, 0)
                if head[:4] != FLO_TAG:
                    raise ValueError(f"{name} is no flow file")
                w, h = np.frombuffer(head[4:], "<i4").tolist()
                if w * h != (f.size() - HEAD) // 8 or (f.size() - HEAD) % 8:
                    raise ValueError(f"{name} is cut off")
                for a in range(first, last, BATCH):
                    n = min(BATCH, last - a)
                    at, made = np.arange(a, a + n), {}
                    if {"dx", "dy"} & set(self.columns):
                        uv = np.frombuffer(f.read_at(8 * n, HEAD + 8 * a), "<f4").reshape(n, 2).astype(float)
                        bad = ~(np.abs(uv) <= INVALID).all(1)
                        made |= {"dx": pa.array(uv[:, 0], mask=bad), "dy": pa.array(uv[:, 1], mask=bad)}
                    if "path" in self.columns:
                        made["path"] = pa.DictionaryArray.from_arrays(np.zeros(n, np.int32), [name]).cast(pa.string())
                    made |= {"y": pa.array(at // w), "x": pa.array(at % w)}
                    yield pa.RecordBatch.from_arrays([made[c] for c in self.columns], self.columns)


class FilteringReader(FlowReader):
    """A reader that takes filters on path; Spark lets it be only where they may be pushed."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("path",):
                said = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = said if self.only is None else self.only & said
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class FlowWriter(DataSourceArrowWriter):
    """Rows: path, w, h, y, x, dx, dy in the order of (path, y, x)."""

    def __init__(self, root: str):
        self.root = root

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = file_system(self.root)
        files, out, name, due, size = [], None, None, 0, 0

        def blank(n: int) -> None:
            while n > 0:
                out.write(np.full((min(n, BATCH), 2), 2 * INVALID, "<f4").tobytes())
                n -= BATCH

        def close() -> None:
            if out is not None:
                blank(size - due)
                out.close()

        for batch in iterator:
            paths = batch.column(batch.schema.get_field_index("path")).to_pylist()
            cuts = [0, *(i for i in range(1, len(paths)) if paths[i] != paths[i - 1]), len(paths)]
            w, h, y, x = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("w", "h", "y", "x"))
            uv = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in ("dx", "dy")], 1)
            uv = np.where(np.isnan(uv).any(1, keepdims=True), 2 * INVALID, uv).astype("<f4")
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if paths[a] != name:
                    close()
                    name, due, size = paths[a], 0, int(w[a]) * int(h[a])
                    final = f"{base.rstrip('/')}/{name.lstrip('/')}"
                    folder, _, last = final.rpartition("/")
                    system.create_dir(folder, recursive=True)
                    files.append((f"{folder}/.{last}.{uuid.uuid4().hex}", final))
                    out = system.open_output_stream(files[-1][0])
                    out.write(FLO_TAG + np.array([w[a], h[a]], "<i4").tobytes())
                at = y[a:b].astype(np.int64) * int(w[a]) + x[a:b]
                if (np.diff(at, prepend=due - 1) <= 0).any():
                    raise ValueError(f"{name}: pixels must come in order and once")
                # the pixels up to the last one of the batch, those that are missing between as invalid
                for i in range(0, len(at), BATCH):
                    part = at[i : i + BATCH]
                    if part[0] > due:
                        blank(int(part[0]) - due)
                        due = int(part[0])
                    if part[-1] - part[0] + 1 == len(part):
                        out.write(uv[a + i : a + i + len(part)].tobytes())
                    else:
                        for p, v in zip(part.tolist(), uv[a + i : a + i + len(part)]):
                            blank(p - due)
                            out.write(v.tobytes())
                            due = p + 1
                    due = int(part[-1]) + 1
        close()
        return Written(files)

    def commit(self, messages) -> None:
        system, _ = file_system(self.root)
        for m in messages:
            for temporary, final in m.files if m else ():
                system.move(temporary, final)

    def abort(self, messages) -> None:
        system, _ = file_system(self.root)
        for m in messages:
            for temporary, _ in m.files if m else ():
                system.delete_file(temporary)


class FlowSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "flo"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FlowReader:
        kind = FilteringReader if self.options.get("push_filters") == "true" else FlowReader
        return kind(self.options["path"], schema.names, int(self.options.get("partition_bytes", PARTITION_BYTES)))

    def writer(self, schema, overwrite: bool) -> FlowWriter:
        return FlowWriter(self.options["path"])


def read_flo(spark: SparkSession, root: str, columns: str = SCHEMA, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """SRC-19: pixels of all .flo files below root; columns: those of SCHEMA that are wanted, with their types."""
    spark.dataSource.register(FlowSource)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("flo").schema(columns).option("partition_bytes", partition_bytes).option("push_filters", push.lower()).load(root)


def write_flo(pixels: DataFrame, root: str) -> None:
    """path, y, x, dx, dy as a flow file for each path below root; its size is that of its greatest y and x."""
    spark = pixels.sparkSession
    spark.dataSource.register(FlowSource)
    size = pixels.groupBy("path").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    rows = pixels.join(size, "path").select("path", "w", "h", "y", "x", "dx", "dy")
    rows.repartition("path").sortWithinPartitions("path", "y", "x").write.format("flo").mode("append").save(root)
