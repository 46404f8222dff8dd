"""High-water marks by source, stored: a source is read only where it is newer than the mark that its last run left."""

from __future__ import annotations

import json
from collections.abc import Callable
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from pricewren.tables import hadoop_path


class Marks:
    """Marks in a folder: for each source a folder of numbered files, the last of which holds.

    A mark is advanced by creating the file with the next number, which fails where another run has created it meanwhile.
    Marks are texts, numbers or lists of these, compared as they are.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, source: str) -> str:
        return f"{self.path}/{quote(source, safe='')}"

    def _last(self, source: str) -> tuple[int, object]:
        folder, system = hadoop_path(self.spark, self._folder(source))
        if not system.exists(folder):
            return 0, None
        names = sorted((s.getPath().getName() for s in system.listStatus(folder) if s.getPath().getName().isdigit()), reverse=True)
        for name in names:
            path, _ = hadoop_path(self.spark, f"{self._folder(source)}/{name}")
            stream = system.open(path)
            try:
                text = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            try:
                return int(names[0]), json.loads(text)["mark"]
            except ValueError:
                continue  # its run was lost while it wrote: the one before holds
        return (int(names[0]) if names else 0), None

    def get(self, source: str):
        """The source's mark, or None before the first."""
        return self._last(source)[1]

    def advance(self, source: str, mark, number: int | None = None) -> bool:
        """Store a newer mark. False where the stored one is as new, or (number: the last file's when the run began) another run was faster."""
        last, stored = self._last(source)
        if (stored is not None and mark <= stored) or (number is not None and number != last):
            return False
        path, system = hadoop_path(self.spark, f"{self._folder(source)}/{last + 1:012d}")
        try:
            stream = system.create(path, False)
        except Py4JJavaError:
            return False
        try:
            stream.write(json.dumps({"mark": mark}).encode())
        finally:
            stream.close()
        return True

    def sync(self, source: str, remote, read: Callable[[object], object]) -> dict:
        """Run read(stored mark) where the source's remote mark is newer than the stored one, or isn't known, and then store it.

        Returns what a run of one source among several reports: skipped, ok with what read returned, or the error, which
        leaves the mark as it was.
        """
        number, stored = self._last(source)
        if remote is not None and stored is not None and remote <= stored:
            return {"source": source, "status": "skipped", "mark": stored}
        try:
            out = read(stored)
        except Exception as error:
            return {"source": source, "status": "error", "mark": stored, "error": f"{type(error).__name__}: {error}"}
        if remote is not None:
            self.advance(source, remote, number)
        return {"source": source, "status": "ok", "mark": remote if remote is not None else stored, "result": out}
