"""Files in any store that Spark writes to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import SparkSession


def work_folder(spark: SparkSession, name: str) -> str:
    """The name of a new folder below `spark.checkpoint.dir`, which all executors share.

    Only a local session may be without that setting; it gets a folder of its own.
    """
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="run-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class SharedFiles:
    """Moves and removes files through the Hadoop file system of their path."""

    def __init__(self, spark: SparkSession):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _system(self, path: str):
        return self._path(path).getFileSystem(self.conf)

    @contextmanager
    def beside(self, path: str) -> Iterator[str]:
        """A new folder next to ``path``, which is removed in the end."""
        folder = f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
        try:
            yield folder
        finally:
            self._system(folder).delete(self._path(folder), True)

    def names(self, folder: str) -> list[str]:
        """What stands in a folder, but for names that start with `_` or `.`."""
        system, path = self._system(folder), self._path(folder)
        found = [x.getPath().getName() for x in system.listStatus(path)] if system.exists(path) else []
        return sorted(n for n in found if not n.startswith(("_", ".")))

    def write(self, file: str, text: str) -> None:
        stream = self._system(file).create(self._path(file), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def publish(self, source: str, column: str, target: str, suffix: str) -> list[str]:
        """Moves the files of each ``column=value`` folder to ``target``, named after the value.

        A single file becomes `value` + suffix, several `value.1` + suffix and so on with a
        `value.manifest` that lists them. Either all files get their names or none does.
        """
        system = self._system(target)
        system.mkdirs(self._path(target))
        moves, lists = [], {}
        for folder in self.names(source):
            name = unquote(folder.removeprefix(f"{column}="))
            parts = self.names(f"{source}/{folder}")
            ends = [suffix] if len(parts) == 1 else [f".{k}{suffix}" for k in range(1, len(parts) + 1)]
            lists[name] = [name + end for end in ends]
            moves += [(f"{source}/{folder}/{part}", f"{target}/{name}{end}") for part, end in zip(parts, ends)]
        manifests = [f"{target}/{name}.manifest" for name, files in lists.items() if len(files) > 1]
        for file in [*(to for _, to in moves), *manifests]:
            if system.exists(self._path(file)):
                raise FileExistsError(file)
        done = []
        try:
            for at, to in moves:
                if not system.rename(self._path(at), self._path(to)):
                    raise OSError(f"could not move {at} to {to}")
                done.append(to)
            for name, files in lists.items():
                if len(files) > 1:
                    done.append(f"{target}/{name}.manifest")
                    self.write(done[-1], "".join(f"{file}\n" for file in files))
        except BaseException:
            for file in done:
                system.delete(self._path(file), False)
            raise
        return sorted(lists)
