"""Small JSON entries in a folder, numbered; each is written whole, and the last one holds."""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """Files of a path of any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm

    def place(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    @property
    def fs(self):
        return self.place().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def listing(self, name: str = "") -> list[tuple[str, float]]:
        """(name, modification time in seconds) of what lies in the folder or one of its folders; none where it is absent."""
        place = self.place(name)
        if not self.fs.exists(place):
            return []
        return sorted((f.getPath().getName(), f.getModificationTime() / 1000) for f in self.fs.listStatus(place))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.place(name))

    def rename(self, old: str, new: str) -> bool:
        return self.fs.rename(self.place(old), self.place(new))

    def delete(self, name: str = "") -> None:
        self.fs.delete(self.place(name), True)

    def put(self, name: str, text: str) -> None:
        """A file that is there whole or not at all; FileExistsError if it is there already.

        The whole text is written under another name, and one step that fails where the name is taken gives it its own: a
        link on local disks, the name node's rename without overwriting on HDFS and behind viewfs.  In other stores the
        file is created without overwriting, which keeps writers apart where the store itself makes creation conditional.
        """
        scheme = self.fs.getUri().getScheme()
        taken = FileExistsError(f"{self.path}/{name}: another writer was first")
        if scheme not in ("file", "hdfs", "viewfs"):
            self._create(name, text, taken)
            return
        part = f".{name}.{uuid.uuid4().hex[:8]}"
        self._create(part, text, taken)
        try:
            if scheme == "file":
                at = lambda n: self._jvm.java.nio.file.Paths.get(self.fs.makeQualified(self.place(n)).toUri())
                self._jvm.java.nio.file.Files.createLink(at(name), at(part))
            else:
                hadoop = self._jvm.org.apache.hadoop.fs
                never = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
                never[0] = getattr(hadoop.Options.Rename, "NONE")
                hadoop.FileContext.getFileContext(self.fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(self.place(part), self.place(name), never)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise taken from None
            raise
        finally:
            self.delete(part)

    def _create(self, name: str, text: str, taken: FileExistsError) -> None:
        try:
            out = self.fs.create(self.place(name), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise taken from None
            raise
        out.write(bytearray(text.encode("utf-8")))
        out.close()

    def get(self, name: str) -> str:
        data = self.fs.open(self.place(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(data, "UTF-8")
        finally:
            data.close()


class Journal:
    """Numbered entries `<n>.json`.  Putting one is the single step that makes a change hold."""

    def __init__(self, spark: SparkSession, path: str):
        self.folder = Folder(spark, path)

    def numbers(self) -> list[tuple[int, float]]:
        """(number, time) of the entries, oldest first."""
        return sorted((int(n[:-5]), t) for n, t in self.folder.listing() if re.fullmatch(r"\d+\.json", n))

    def entry(self, number: int) -> dict:
        return json.loads(self.folder.get(f"{number}.json"))

    def last(self) -> dict | None:
        numbers = self.numbers()
        return self.entry(numbers[-1][0]) if numbers else None

    def put(self, number: int, entry: dict) -> None:
        self.folder.put(f"{number}.json", json.dumps(entry, sort_keys=True))

    def drop(self, number: int) -> None:
        self.folder.delete(f"{number}.json")
