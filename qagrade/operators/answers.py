"""A log of answers from outside code: each request is paid once and stored once.

Requests fall into batches by the first digits of their hash, so every run cuts them equally. A run
claims a batch before it asks, by creating a file that must not exist, and then asks for what the
log does not have yet; other runs leave the batch alone and look again later. The answers are
written by one Spark job, and count from the moment the batch's manifest is there, which is written
last: what a run leaves behind half-way is never read. A later run asks for the rest.

    <log>/_settings          digits of the hash that name a batch, fixed by the first run
    <log>/_claims/<batch>    somebody is asking for the batch
    <log>/batch=<batch>-<run>/   answers, parquet
    <log>/_manifest/<batch>-<run>  the folder of that name is whole
"""

from __future__ import annotations

import contextlib
import time
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "request_id string, metric string, score double"
DIGITS = 3


class AnswerLog:
    """The answers at ``path``, which may be absent at first.

    ``claim_seconds`` is when a claim counts as abandoned; it has to be longer than a batch takes.
    """

    def __init__(self, spark: SparkSession, path: str, claim_seconds: float = 24 * 3600.0):
        self.spark, self.path, self.claim_seconds = spark, path.rstrip("/"), claim_seconds
        self.run = uuid.uuid4().hex
        where = self._at()
        self._fs = where.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _create(self, content: str, *parts: str) -> bool:
        """Whether the file was not there before."""
        try:
            out = self._fs.create(self._at(*parts), False)
        except Py4JJavaError:
            if self._fs.exists(self._at(*parts)):
                return False
            raise
        out.write(content.encode())
        out.close()
        return True

    def _names(self, *parts: str) -> list[str]:
        where = self._at(*parts)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def digits(self, requests: int, batch_requests: int) -> int:
        """How many digits of the hash name a batch: the log's, or as many as so many requests need."""
        wanted = next((d for d in range(DIGITS) if requests <= batch_requests * 16**d), DIGITS)
        if self._create(str(wanted), "_settings"):
            return wanted
        stream = self._fs.open(self._at("_settings"))
        try:
            return int(chr(stream.read()))
        finally:
            stream.close()

    def answers(self, batch: str = "") -> DataFrame:
        """All answers, or those of one batch, by the manifests that are there; one row a request.

        A request can be stored twice only if a claim was given up while it was still worked on:
        then the answer of the first run by name counts.
        """
        folders = [f"{self.path}/batch={name}" for name in self._names("_manifest") if name.startswith(batch)]
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*folders).withColumn("_from", F.col("_metadata.file_path"))
        first = rows.groupBy("request_id").agg(F.min(F.struct("_from", "metric", "score")).alias("x"))
        return first.select("request_id", "x.metric", "x.score")

    @contextlib.contextmanager
    def claim(self, batch: str) -> Iterator[bool]:
        """Whether the batch is ours; it is given back at the end."""
        name = ("_claims", f"b{batch}")
        with contextlib.suppress(Py4JJavaError):  # another run may give its claim back meanwhile
            if self._fs.exists(self._at(*name)):
                age = time.time() - self._fs.getFileStatus(self._at(*name)).getModificationTime() / 1000
                if age > self.claim_seconds:
                    self._fs.delete(self._at(*name), False)
        ours = self._create(self.run, *name)
        try:
            yield ours
        finally:
            if ours:
                self._fs.delete(self._at(*name), False)

    def store(self, batch: str, answers: DataFrame) -> None:
        """Write the answers of a claimed batch, and its manifest when they are whole."""
        name = f"{batch}-{uuid.uuid4().hex}"
        answers.write.parquet(f"{self.path}/batch={name}")
        self._create(self.run, "_manifest", name)


def batch_of(request_id: Column, digits: int) -> Column:
    return F.left(request_id, F.lit(digits))
