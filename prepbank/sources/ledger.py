"""One-step publishing in a shared folder: files that are created once, claims of numbers by several writers, folders moved into place."""

import hashlib
import json
import re
import uuid

from pyspark.sql import SparkSession


class Files:
    """Few calls on the file system of a folder (local or HDFS), all on the driver and about names, never about rows."""

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm = spark._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(folder)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._root, name)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.path(name))

    def read(self, name: str) -> dict:
        stream = self._fs.open(self.path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write(self, name: str, value: dict) -> None:
        stream = self._fs.create(self.path(name), True)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()

    def create_once(self, name: str, value: dict) -> bool:
        """Publish a file whole; False if it is there already. Of several writers one gets True."""
        draft = f"_draft-{uuid.uuid4().hex}"
        self.write(draft, value)
        try:
            self._fs.mkdirs(self.path(name).getParent())
            if self._fs.getUri().getScheme() != "file":
                # HDFS moves no file over another one.
                return not self.exists(name) and self._fs.rename(self.path(draft), self.path(name))
            # A local rename would replace the file; a link never does.
            nio, local = self._jvm.java.nio.file, [self._jvm.java.io.File(self.path(x).toUri().getPath()).toPath() for x in (name, draft)]
            try:
                nio.Files.createLink(*local)
            except Exception as error:
                if "FileAlreadyExists" not in str(error):
                    raise
                return False
            return True
        finally:
            self._fs.delete(self.path(draft), False)

    def move(self, draft: str, name: str) -> bool:
        """Move a folder into place in one step; False, and the draft gone, if there is one already."""
        if self.exists(name):
            self._fs.delete(self.path(draft), True)
            return False
        return self._fs.rename(self.path(draft), self.path(name))

    def drop(self, name: str) -> None:
        self._fs.delete(self.path(name), True)


class Ledger:
    """Consecutive numbers given out to batches, by any number of writers at a time.

    ``log/<n>`` is the n-th claim, with the last number given out up to it; a claim builds on the one before and is created once, so two
    writers never get the same numbers. ``batches/<key>`` holds what a batch got, and a batch that comes again gets that again. A
    writer that stops between the two leaves numbers unused. Finding the last claim takes a look at some names, not at any rows.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.files = Files(spark, folder)

    def claim(self, batch: str, count: int) -> int:
        """The first of ``count`` numbers of a batch, which follow the last ones given out."""
        mine = f"batches/{safe_name(batch)}"
        while not self.files.exists(mine):
            n, last = self._last()
            if self.files.create_once(f"log/{n + 1:012d}", {"batch": batch, "first": last + 1, "last": last + count}):
                self.files.create_once(mine, {"first": last + 1, "count": count})
        return self.files.read(mine)["first"]

    def last(self) -> int:
        """Last number given out; 0 before the first."""
        return self._last()[1]

    def _last(self) -> tuple[int, int]:
        """The last claim and its last number. Claims have no gaps, so it is found by doubling and halving: a look at some tens of names."""
        above = 1
        while self._claimed(above):
            above *= 2
        n = above // 2
        while above - n > 1:
            middle = (n + above) // 2
            n, above = (middle, above) if self._claimed(middle) else (n, middle)
        return n, self.files.read(f"log/{n:012d}")["last"] if n else 0

    def _claimed(self, n: int) -> bool:
        return self.files.exists(f"log/{n:012d}")


def safe_name(batch: str) -> str:
    """A batch key as a name for files and partitions: itself if plain and short, else its digest."""
    plain = re.fullmatch(r"[A-Za-z0-9.-]{1,100}", batch)
    return f"k{batch}" if plain else "h" + hashlib.sha256(batch.encode()).hexdigest()


def new_batch() -> str:
    """Key of a batch that will not come again."""
    return uuid.uuid4().hex
