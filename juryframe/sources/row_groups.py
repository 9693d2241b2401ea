"""Row groups of Parquet tables: footers read by tasks, copies in small groups, and tables laid out for access by key."""

from __future__ import annotations

import hashlib
import logging
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from juryframe.sources import places

GROUP_ROWS, RECHUNK_ABOVE, CACHED_GROUPS = 256, 1024, 4
#: Rows of a page in a table that is laid out for access by key.
PAGE_ROWS = 64
#: A copy is made only where so many times its source's bytes are free.
SPARE = 1.2
#: File systems that Arrow opens as well as Spark, so that a task reads no more than a file's tail.
DIRECT = ("file", "hdfs", "s3", "gs")
_GROUPS = "file string, length long, group int, first_row long, rows long, bytes long"
_log = logging.getLogger(__name__)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified) of all Parquet files of a table, in nested folders too; no file is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def _metadata(uri: str, content: bytes | None):
    import pyarrow.parquet as pq
    from pyarrow import fs

    if content is not None:
        return pq.ParquetFile(pa.BufferReader(content)).metadata
    if uri.startswith("file:"):
        return pq.ParquetFile(fs.LocalFileSystem().open_input_file("/" + uri.removeprefix("file:").lstrip("/"))).metadata
    system, at = fs.FileSystem.from_uri(uri)
    return pq.ParquetFile(system.open_input_file(at)).metadata


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            found, first, out = _metadata(row["path"], row.get("content")), 0, []
            for i in range(found.num_row_groups):
                group = found.row_group(i)
                out.append((row["path"], row["length"], i, first, group.num_rows, group.total_byte_size))
                first += group.num_rows
            if out:
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=_GROUPS.replace(",", "").split()[::2])


def _with_content(spark: SparkSession, path: str) -> DataFrame:
    """Files as Spark reads them, for stores that only Spark's readers open; a file is a row, so it must fit into one."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path", "length", "content")


def footers(spark: SparkSession, path: str) -> DataFrame:
    """(file, length, group, first_row, rows, bytes) of every row group, from the files' tails, which tasks read side by side."""
    direct = places.scheme(spark, path) in DIRECT
    rows = files(spark, path).select("path", "length") if direct else _with_content(spark, path)
    return rows.mapInArrow(_groups, _GROUPS)


def group_starts(spark: SparkSession, path: str) -> DataFrame:
    """``footers`` with start: how many rows of the table, files in order of their paths, lie before the group.

    What is ordered is a row a file, a list that Spark's driver holds anyway to plan a scan.
    """
    groups = footers(spark, path)
    sizes = groups.groupBy("file").agg(F.sum("rows").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return groups.join(sizes.select("file", before.alias("before")), "file").withColumn("start", F.col("before") + F.col("first_row")).drop("before")


def locate(groups: DataFrame, index: int) -> DataFrame:
    """(file, group, place) of row ``index`` of a table, from its ``group_starts``; no row where there is none."""
    return groups.filter((F.col("start") <= index) & (F.col("start") + F.col("rows") > index)).select("file", "group", (F.lit(index) - F.col("start")).alias("place"))


def write_groups(df: DataFrame, path: str, group_rows: int = GROUP_ROWS, mode: str = "error") -> None:
    """Parquet with row groups of at most ``group_rows`` rows."""
    df.write.mode(mode).option("parquet.block.row.count.limit", group_rows).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table whose folders may be nested: names like key=value are columns, other folders only hold files."""
    root = F.lit(places.place(spark, path)[1].makeQualified(*_qualifiers(spark, path)).toString().rstrip("/") + "/")
    inner = F.split(F.substr(F.col("path"), F.length(root) + 1), "/")
    folders = F.slice(inner, F.lit(1), F.greatest(F.size(inner) - 1, F.lit(0)))
    plain = files(spark, path).filter(F.startswith(F.col("path"), root) & F.exists(folders, lambda x: ~F.contains(x, F.lit("="))))
    return (spark.read.option("recursiveFileLookup", True) if not plain.isEmpty() else spark.read).parquet(path)


def _qualifiers(spark: SparkSession, path: str):
    fs, _ = places.place(spark, path)
    return fs.getUri(), fs.getWorkingDirectory()


def rechunk(spark: SparkSession, source: str, target: str, group_rows: int = GROUP_ROWS) -> None:
    """The same rows in row groups of another size; no row moves between tasks."""
    write_groups(read_table(spark, source), target, group_rows)


def cached_groups(asked: int, groups: int) -> int:
    """How many row groups to keep: at least one, at most all."""
    return max(1, min(asked, groups))


def cache_path(source: str, cache_dir: str, group_rows: int = GROUP_ROWS) -> str:
    parent, _, name = source.rstrip("/").rpartition("/")
    return f"{cache_dir.rstrip('/')}/{name.removesuffix('.parquet')}_rg{group_rows}_{hashlib.md5(parent.encode()).hexdigest()[:8]}.parquet"


def ensure_small_groups(spark: SparkSession, source: str, cache_dir: str, group_rows: int = GROUP_ROWS, ratio: int = RECHUNK_ABOVE // GROUP_ROWS, spare: float = SPARE) -> str:
    """``source`` if its row groups are small enough, else a copy that has small ones.

    A copy that is complete and no older than any of its source's files is used again. A new one is written beside its place and
    renamed when it is whole, so an interrupted run leaves the old copy. Where less than ``spare`` times the source's bytes are free, ``source`` itself is
    given back, with a warning.
    """
    largest = footers(spark, source).agg(F.max("rows")).first()[0] or 0
    if largest <= group_rows * ratio:
        return source
    size, newest = files(spark, source).agg(F.sum("length"), F.max(F.unix_millis("modified"))).first()
    target = cache_path(source, cache_dir, group_rows)
    if places.modified(spark, f"{target}/_SUCCESS") >= newest:
        return target
    if (free := places.free_bytes(spark, cache_dir)) < spare * size:
        _log.warning("no copy of %s in small row groups: %d bytes are free, %d are needed", source, free, int(spare * size))
        return source
    made = f"{target}.{uuid.uuid4().hex}.tmp"
    try:
        rechunk(spark, source, made, group_rows)
        places.put_in_place(spark, made, target)
    finally:
        places.remove(spark, made)
    return target


def write_clustered(df: DataFrame, path: str, key: str, *, files: int | None = None, group_rows: int = 1 << 14, page_rows: int = PAGE_ROWS, mode: str = "error") -> None:
    """``df`` laid out for access by ``key``: each file holds a range of keys, sorted, in small groups of small pages.

    A scan for a key then reads the pages that may hold it, by the limits in the footers and page indexes, and nothing else.
    """
    dealt = df.repartitionByRange(files, key) if files else df.repartitionByRange(key)
    write = dealt.sortWithinPartitions(key).write.mode(mode)
    write.option("parquet.block.row.count.limit", group_rows).option("parquet.page.row.count.limit", page_rows).parquet(path)


def rows_of(spark: SparkSession, path: str, key: str, values: Sequence[int | str], columns: Sequence[str] | None = None) -> DataFrame:
    """The rows with one of the given keys; the test is pushed down to groups and pages."""
    df = spark.read.parquet(path).filter(F.col(key).isin(*values))
    return df.select(*columns) if columns else df
