"""A Spark data source for text lines: files within a byte limit, one commit for the whole job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from corpusloom.sources.files import ROLL_BYTES

FORMAT = "rolled_lines"
PENDING = "_pending"


def rolled_lines() -> type[DataSource]:
    """The data source class, made here so that workers get it by value and need no install."""

    def opened(path: str):
        from pyarrow import fs

        if path.startswith("file:"):
            path = "/" + path.removeprefix("file:").lstrip("/")
        return fs.FileSystem.from_uri(path)

    class Written(WriterCommitMessage):
        def __init__(self, files: list[str]):
            self.files = files

    class Writer(DataSourceArrowWriter):
        def __init__(self, path: str, limit: int, extension: str, overwrite: bool):
            import uuid

            self.path, self.limit, self.extension, self.overwrite = path, limit, extension, overwrite
            self.job = uuid.uuid4().hex

        def write(self, iterator):
            """One task: its files, each begun when the next line would pass the limit."""
            from pyspark import TaskContext

            task = TaskContext.get()
            system, root = opened(self.path)
            folder = f"{root}/{PENDING}/{self.job}"
            system.create_dir(folder, recursive=True)
            files, out, size = [], None, 0
            try:
                for batch in iterator:
                    for line in batch.column(0).to_pylist():
                        data = ("" if line is None else line).encode() + b"\n"
                        if out is not None and size + len(data) > self.limit:
                            out.close()
                            out = None
                        if out is None:
                            name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(files):05d}-{self.job}"
                            files.append(f"{name}.{self.extension}")
                            out, size = system.open_output_stream(f"{folder}/{files[-1]}", buffer_size=1 << 20), 0
                        out.write(data)
                        size += len(data)
            finally:
                if out is not None:
                    out.close()
            return Written(files)

        def commit(self, messages):
            """All tasks are done: their files, and only these, come into sight."""
            from pyarrow import fs

            system, root = opened(self.path)
            system.create_dir(root, recursive=True)
            old = []
            if self.overwrite:
                found = system.get_file_info(fs.FileSelector(root))
                old = [f.path for f in found if f.is_file]
            for message in messages:
                for name in message.files if message is not None else []:
                    system.move(f"{root}/{PENDING}/{self.job}/{name}", f"{root}/{name}")
            for path in old:
                system.delete_file(path)
            self._clear(system, root)
            system.open_output_stream(f"{root}/_SUCCESS").close()

        def abort(self, messages):
            """A task failed for good: nothing of this job stays."""
            system, root = opened(self.path)
            self._clear(system, root)

        def _clear(self, system, root: str) -> None:
            from pyarrow import fs

            for folder in (f"{root}/{PENDING}/{self.job}", f"{root}/{PENDING}"):
                if system.get_file_info(folder).type != fs.FileType.Directory:
                    continue
                # another job may be writing below the common folder
                if folder.endswith(self.job) or not system.get_file_info(fs.FileSelector(folder)):
                    system.delete_dir(folder)

    class RolledLines(DataSource):
        @classmethod
        def name(cls) -> str:
            return FORMAT

        def writer(self, schema, overwrite: bool):
            if [f.dataType.simpleString() for f in schema.fields] != ["string"]:
                raise ValueError(f"one string column is written, not {schema.simpleString()}")
            limit = int(self.options.get("rollBytes", ROLL_BYTES))
            if limit < 1:
                raise ValueError("rollBytes must be positive")
            return Writer(self.options["path"], limit, self.options.get("extension", "txt"), overwrite)

    return RolledLines


def write_lines_rolled(
    lines: DataFrame, path: str, roll_bytes: int = ROLL_BYTES, extension: str = "txt", mode: str = "append"
) -> None:
    """Column ``line`` as text files of at most ``roll_bytes`` bytes each; a longer line has a
    file of its own, and a null is an empty line.

    The rows are read once. Tasks write below a folder that readers skip, and the job's commit
    moves the files of successful attempts into place; a job that fails leaves nothing. Jobs may
    append to one folder at the same time. ``mode="overwrite"`` deletes the older files once the
    new ones are in place, so a reader may see both for a moment. ``path`` is on a file system
    that pyarrow opens (local, HDFS, S3, GCS).
    """
    spark = lines.sparkSession
    spark.dataSource.register(rolled_lines())
    out = lines.select("line").write.format(FORMAT).mode(mode)
    out.option("rollBytes", roll_bytes).option("extension", extension).save(path)


def write_json_rolled(df: DataFrame, path: str, roll_bytes: int = ROLL_BYTES, mode: str = "append") -> None:
    """One JSON object per record, nulls included, in files of at most ``roll_bytes`` bytes; see
    :func:`write_lines_rolled`."""
    line = F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line")
    write_lines_rolled(df.select(line), path, roll_bytes, "json", mode)
