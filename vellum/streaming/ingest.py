"""Streams of packages: files that arrive are read by the same stateless operators. Each file is in one batch, by the checkpoint; a
batch that was under way when a stream failed is given to the sink again, with the same number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from vellum.sources.docx import parse_packages

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_packages(spark: SparkSession, path: str, files_at_once: int = 1000) -> DataFrame:
    """Packages below a path as a stream, in the schema of the batch source."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_at_once).load(path)
    return parse_packages(files.selectExpr("path AS doc_id", "path", "content"))


def sink(packages: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run `write` on each batch of what has arrived, then stop; started anew with the same checkpoint, it goes on.

    A batch may come twice, so `write` should replace what it wrote under the batch's number before, as a table does that is
    overwritten partition by partition.
    """
    return packages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
