"""Numbered commits: what several writes did becomes visible by one small file.

Data files are written first, each attempt to a folder of its own, and nobody reads them yet. Then one entry that names them is
renamed to its number. A reader takes the folders of the latest entry, so it sees all of a commit or nothing, and what a failed attempt
left behind is in no entry. A number is given once: who comes second is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

_DIGITS = 12


class CommitLog:
    """Entries (JSON objects) by number in one folder of any file system that Spark reaches. Entries are small: they name folders."""

    def __init__(self, spark: SparkSession, folder: str):
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._text = jvm.org.apache.commons.io.IOUtils
        self.folder = folder.rstrip("/")
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _file(self, number: int):
        return self._path(f"{self.folder}/{number:0{_DIGITS}d}.json")

    def numbers(self) -> list[int]:
        """Numbers of all entries, ascending."""
        at = self._path(self.folder)
        if not self._fs.exists(at):
            return []
        names = [status.getPath().getName() for status in self._fs.listStatus(at)]
        return sorted(int(n[: -len(".json")]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict:
        stream = self._fs.open(self._file(number))
        try:
            return json.loads(self._text.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self, upto: int | None = None) -> tuple[int, dict] | None:
        """The last entry (not beyond ``upto``), or nothing."""
        numbers = [n for n in self.numbers() if upto is None or n <= upto]
        return (numbers[-1], self.read(numbers[-1])) if numbers else None

    def add(self, number: int, entry: dict) -> None:
        """Write an entry as a whole; FileExistsError where the number is taken."""
        final = self._file(number)
        draft = self._path(f"{self.folder}/.{number}-{uuid.uuid4().hex}")
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
        finally:
            out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise FileExistsError(f"commit {number} is there already")
