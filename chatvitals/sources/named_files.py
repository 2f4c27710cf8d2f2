"""A sink that writes files of given names: pages of a report, exports of chats.

Rows are (file, data): pieces of files in order, the rows of a file in one partition (`clustered` sees to both).  A task streams its files into a
folder of its attempt; the driver moves the files of the attempts that Spark kept to their names once all tasks are done, and removes the rest.  So
a killed or repeated task leaves nothing behind, and a job that fails shows no file.  `_SUCCESS` comes last: moving is not atomic over many files, and
a folder without it has to be written again.  Names are checked before the first file is moved to its own.  No task holds a file; the driver holds a
count for each task and the names of one attempt's or one shelf's files.

Null data is an empty piece, so a file may be empty; an empty table writes `_SUCCESS` alone.  A null name, one that is a path, or one that begins with
a dot or an underscore fails the job, as does a name that two partitions write or that is there already (unless it is to be replaced)."""

from __future__ import annotations

import uuid
import zlib
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

SCHEMA = "file string, data binary"
#: Moves that the driver has under way at a time.
MOVES = 16
#: Folders that files wait in until all names are known to be free; the driver lists one at a time.
SHELVES = 64


def uri(spark: SparkSession, path: str) -> str:
    """The path with its file system, as Arrow's file systems spell it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    scheme, _, rest = whole.partition(":")
    return f"{'s3' if scheme == 's3a' else scheme}:{rest if rest.startswith('//') else '//' + rest}"


def opened(folder: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder)


@dataclass
class Attempt(WriterCommitMessage):
    folder: str
    files: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, replace: bool):
        self.folder, self.replace = folder, replace
        self.pending = f"_pending-{uuid.uuid4().hex}"

    def write(self, iterator):
        from pyspark import TaskContext

        fs, root = opened(self.folder)
        task = TaskContext.get()
        place = f"{root}/{self.pending}/{task.partitionId()}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        fs.create_dir(place, recursive=True)
        out, current, seen = None, None, set()
        try:
            for batch in iterator:
                for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if name != current or out is None:
                        if not name or "/" in name or name[0] in "._":
                            raise ValueError(f"not a file's name: {name!r}")
                        if name in seen:
                            raise ValueError(f"the rows of {name!r} do not lie together")
                        if out is not None:
                            out.close()
                        out, current = fs.open_output_stream(f"{place}/{name}", compression=None), name
                        seen.add(name)
                    out.write(data or b"")
        finally:
            if out is not None:
                out.close()
        return Attempt(place, len(seen))

    def commit(self, messages):
        from pyarrow.fs import FileSelector, FileType

        fs, root = opened(self.folder)
        fs.create_dir(root, recursive=True)

        shelf = lambda i: f"{root}/{self.pending}/all/{i:02x}"

        def gather(info):
            place = f"{shelf(zlib.crc32(info.base_name.encode()) % SHELVES)}/{info.base_name}"
            if fs.get_file_info(place).type != FileType.NotFound:
                raise FileExistsError(f"two partitions write {info.base_name!r}")
            if not self.replace and fs.get_file_info(f"{root}/{info.base_name}").type != FileType.NotFound:
                raise FileExistsError(f"{info.base_name!r} is there already")
            fs.move(info.path, place)

        try:
            for i in range(SHELVES):
                fs.create_dir(shelf(i), recursive=True)
            with ThreadPoolExecutor(MOVES) as pool:
                for m in messages:
                    found = fs.get_file_info(FileSelector(m.folder)) if m is not None and m.files else []
                    if m is not None and len(found) != m.files:
                        raise FileNotFoundError(f"{m.folder} has {len(found)} of {m.files} files")
                    list(pool.map(gather, found))
                for i in range(SHELVES):
                    list(pool.map(lambda f: fs.move(f.path, f"{root}/{f.base_name}"), fs.get_file_info(FileSelector(shelf(i)))))
            with fs.open_output_stream(f"{root}/_SUCCESS", compression=None):
                pass
        finally:
            self._clear(fs, root)

    def abort(self, messages):
        fs, root = opened(self.folder)
        self._clear(fs, root)

    def _clear(self, fs, root):
        from pyarrow.fs import FileType

        if fs.get_file_info(f"{root}/{self.pending}").type != FileType.NotFound:
            fs.delete_dir(f"{root}/{self.pending}")


class NamedFiles(DataSource):
    @classmethod
    def name(cls):
        return "named_files"

    def schema(self):
        return SCHEMA

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"].rstrip("/"), overwrite)


def clustered(rows: DataFrame, *order: str | Column) -> DataFrame:
    """Rows of a file in one partition, in order; files of one partition after one another."""
    return rows.repartition("file").sortWithinPartitions("file", *order)


def write(rows: DataFrame, folder: str, replace: bool = False) -> str:
    """Writes clustered rows (file, data) into the folder; returns the folder with its file system."""
    spark = rows.sparkSession
    spark.dataSource.register(NamedFiles)
    where = uri(spark, folder)
    rows.select("file", F.col("data").cast("binary").alias("data")).write.format("named_files").mode("overwrite" if replace else "append").save(where)
    return where
