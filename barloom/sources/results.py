"""Results kept for a while: a table for each query and its arguments in the shared folder, with the time it was made.

Any driver that shares the folder finds them. A result is used for ``seconds``; then it's made anew and the old one goes. Two
drivers that make the same result at once write two tables, of which later readers take the younger.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from barloom.sources.folders import handle, shared

#: Fixed value: for how long a result counts as fresh.
SECONDS = 600


class Results:
    def __init__(self, spark: SparkSession, seconds: float = SECONDS, root: str | None = None, now: Callable[[], float] = time.time):
        self.spark, self.seconds, self.now = spark, seconds, now
        self.root = root or f"{shared(spark)}/results"

    def _folder(self, name: str, arguments: dict) -> str:
        told = json.dumps(arguments, sort_keys=True, default=str)
        return f"{self.root}/{name}/{hashlib.sha256(told.encode()).hexdigest()}"

    def _listed(self, folder: str) -> list[tuple[float, str]]:
        """Whole results below a folder, the youngest first. A name begins with the time in milliseconds."""
        files, path = handle(self.spark, folder)
        if not files.exists(path):
            return []
        names = [x.getPath().getName() for x in files.listStatus(path)]
        whole = [n for n in names if files.exists(handle(self.spark, f"{folder}/{n}/schema.json")[1])]
        return sorted(((int(n.split("-")[0]) / 1000, f"{folder}/{n}") for n in whole), reverse=True)

    def _read(self, path: str) -> DataFrame:
        files, where = handle(self.spark, f"{path}/schema.json")
        stream = files.open(where)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return self.spark.read.schema(StructType.fromJson(json.loads(text))).parquet(f"{path}/rows")

    def get(self, name: str, make: Callable[..., DataFrame], **arguments) -> DataFrame:
        """The kept result of ``make(**arguments)``, or a new one. A kept one costs no job."""
        folder = self._folder(name, arguments)
        kept = self._listed(folder)
        if kept and self.now() - kept[0][0] < self.seconds:
            return self._read(kept[0][1])
        path = f"{folder}/{int(self.now() * 1000)}-{uuid.uuid4().hex}"
        made = make(**arguments)
        made.write.parquet(f"{path}/rows")
        files, where = handle(self.spark, f"{path}/schema.json")  # written last: without it the result doesn't count
        out = files.create(where)
        out.write(bytearray(made.schema.json().encode()))
        out.close()
        for _, old in kept:
            files.delete(handle(self.spark, old)[1], True)
        return self._read(path)

    def clear(self, name: str | None = None) -> None:
        """Forgets the results of a query, or all."""
        files, where = handle(self.spark, f"{self.root}/{name}" if name else self.root)
        files.delete(where, True)
