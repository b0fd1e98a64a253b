"""What the training-data operators share: folders, id buckets, tokens and samples."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these; as Java and as DuckDB (RE2) regular expression.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one serves if all run on one
    machine; a cluster must name it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='vellum-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the application's part of the shared folder, which goes with all it holds when the driver ends."""
    top = f"{shared_dir(spark)}/vellum/{spark.sparkContext.applicationId}"
    store, at = _hadoop(spark, top)
    store.mkdirs(at)
    store.deleteOnExit(at)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def filesystem(path: str):
    """(filesystem, path in it) of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends here, and Catalyst knows its true size."""
    return write_table(df, new_path(df.sparkSession, name), **options)


def write_table(df: DataFrame, path: str, **options: str) -> DataFrame:
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    store, at = _hadoop(spark, path)
    store.delete(at, True)


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that run in here drop their shuffle files when they end."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, in a session whose Arrow batches hold at most 8 MB: texts may be long, and a batch is held several times over."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return df


def id_bucket(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text (null: empty text) modulo `modulus`."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words of a text (null: 0), without building an array of them."""
    marks = F.regexp_replace(text, WORD, "x")
    return F.coalesce(F.length(F.translate(marks, SPACES, "")), F.lit(0)).cast("long")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text with A-Z lower-cased: bytes.split() splits at exactly the six spaces of SPACES."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def bounded_chunks(texts: list[str | None], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together hold about `limit` characters, one row at least."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def sample_rows(rows: DataFrame, id_col: str, n: int, seed: str) -> DataFrame:
    """The `n` rows with the smallest hash of their id, found on the ids alone so that no text is sorted."""
    salted = F.xxhash64(F.lit(seed), F.col(id_col))
    cut = rows.select(salted.alias("h")).orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return rows.filter(salted <= F.lit(cut)) if cut is not None else rows.limit(0)


_SPACED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Lower-case words (in any script), with ASCII punctuation as space."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_SPACED).split() if text else []


def collect_segments(rows: DataFrame, id_col: str, n: int, chars: int, seed: str) -> list[str]:
    """At most `n` segments of texts, those with the smallest hashes of id and number, by these: a text is cut every `chars`
    characters, so long texts take part with every segment. Rows of one id count once, with the last of their texts."""
    return [part for part, _ in collect_labelled(rows.withColumn("label", F.lit("")), id_col, "label", n, 0, chars, seed)]


def collect_labelled(rows: DataFrame, id_col: str, label: str, n: int, least: int, chars: int, seed: str) -> list[tuple[str, str]]:
    """The same with their labels, and of each label the `least` segments with the smallest hashes besides."""
    numbers = F.sequence(F.lit(0), F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / chars).cast("int"))
    salted = lambda k: F.xxhash64(F.lit(seed), F.col(id_col), k)
    known = rows.filter(F.col(id_col).isNotNull() & F.col("text").isNotNull()).select(id_col, "text", F.col(label).alias("label"))
    listed = known.select(id_col, "label", numbers.alias("numbers")).select(id_col, "label", F.explode("numbers").alias("k")).select("label", salted(F.col("k")).alias("h"))
    cut = listed.select("h").distinct().orderBy("h").limit(n).agg(F.max("h")).first()[0]
    if cut is None:
        return []
    most = F.lit(cut)
    if least:
        ranked = listed.distinct().withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("h"))).filter(F.col("n") <= least)
        own = [(r["label"], max(cut, r["h"])) for r in ranked.groupBy("label").agg(F.max("h").alias("h")).collect()]
        known = known.join(F.broadcast(rows.sparkSession.createDataFrame(own, "label string, most long")), "label")
        most = F.col("most")
    mine = F.filter(numbers, lambda k: salted(k) <= most)
    parts = F.transform(mine, lambda k: F.struct(k.alias("k"), F.substring(F.col("text"), k * chars + 1, F.lit(chars)).alias("part")))
    picked = known.select(id_col, "label", parts.alias("parts")).filter(F.size("parts") > 0).select(id_col, "label", F.inline("parts"))
    one = picked.groupBy(id_col, "k").agg(F.max(F.struct("part", "label")).alias("row"))
    return [(r["part"], r["label"]) for r in sorted(one.select(id_col, "k", "row.*").collect(), key=lambda r: (r[id_col], r["k"]))]


def _release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library, which keeps what is free
        pass


def tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task of mapInArrow that gives the memory it has freed back to the system: Python workers outlive their tasks."""

    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        _release()

    return run


def tidy_groups(task: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for functions of cogroups."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return task(left, right)
        finally:
            _release()

    return run


def tidy_table(task: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for functions of groups."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return task(table)
        finally:
            _release()

    return run
