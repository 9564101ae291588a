"""What the operators share: the shared folder, tables written there, and tables read by name."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Collection, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Splits a normalised word from the next one: the six ASCII white-space characters.
WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table; only Spark's readers open the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset in a session of one machine,
    as in tests, a temporary folder is made and remembered in the session; elsewhere that's an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("barloom.shared.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="barloom-")
        spark.conf.set("barloom.shared.dir", named)
    return named.rstrip("/")


#: What this driver has written to the shared folder and not yet removed.
_made: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def made() -> set[str]:
    """The folders that ``shared_path`` has given out and ``sweep`` hasn't removed."""
    return set(_made)


def sweep(spark: SparkSession, keep: Collection[str] = ()) -> None:
    """Removes all intermediate tables but ``keep``. Results read some of them: call this when results have been read or written elsewhere."""
    for path in [p for p in _made if p not in keep]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _made.remove(path)


def sources_of(df: DataFrame) -> set[str]:
    """The folders that ``df`` reads when it runs."""
    leaves, found = df._jdf.queryExecution().analyzed().collectLeaves(), set()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            roots = leaf.relation().location().rootPaths()
            found |= {roots.apply(k).toUri().getPath() for k in range(roots.size())}
    return found


def sweep_before(docs: DataFrame) -> None:
    """Removes the intermediate tables of earlier work but those that ``docs`` reads: call this where one stage has been written and the next begins."""
    own = sources_of(docs)
    gc.collect()  # frames that nothing refers to any more, here and
    docs.sparkSession._jvm.System.gc()  # in the JVM, whose shuffle files Spark then removes
    sweep(docs.sparkSession, [p for p in _made if p.removeprefix("file://").removeprefix("file:") in own or p in own])


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives lost executors. ``sweep`` removes it."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys that are broadcast at most: some tens of MB, however wide the rows are that they choose.
BROADCAST_KEYS = 1 << 20


def chosen(rows: DataFrame, keys: DataFrame, column: str, how: str = "left_semi", most: int = BROADCAST_KEYS) -> DataFrame:
    """``rows`` that have (``left_semi``) or lack (``left_anti``) one of ``keys``, a table of short rows that is read from files.

    Where there are few keys they are broadcast, and rows that hold whole texts stay where they are read; where
    there are more than ``most``, both sides are shuffled.
    """
    few = keys.limit(most + 1).count() <= most
    return rows.join(F.broadcast(keys) if few else keys, column, how)


#: What a Python worker is sent at once: some MB of text, however long the texts are (one text at least).
ARROW_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Sets the session's limit for Arrow batches where it has none: plans read it only when they run, so it can't be put back here."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(ARROW_BYTES))


def slim(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Only the key and the text (null: empty), whatever other columns a table has; sent to Python workers in small batches."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text))


def normal(text):
    """Every run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def numbered(rows: DataFrame, group: str, order: Sequence[str], slot: str = "slot") -> DataFrame:
    """``rows`` with a gapless number from 0 within each group, in ``order``.

    No task holds a group: rows are dealt out by ranges of (group, order, row), each range is
    counted, and a row's number is its place in its range plus what lies in earlier ranges. The
    row itself is the last key, so that one key with very many rows spreads over ranges too.
    """
    keys = [F.col(group), *(F.col(c) for c in order)]
    spread = rows.withColumn("_row", F.monotonically_increasing_id())
    dealt = written(spread.repartitionByRange(*keys, F.col("_row")).withColumn("_range", F.spark_partition_id()).drop("_row"), "numbered")
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(group, "_range").agg(F.count("*").alias("_n")).select(group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(group, "_range").orderBy(*(F.col(c) for c in order))
    return dealt.withColumn("_place", F.row_number().over(within) - 1).join(counts, [group, "_range"]).withColumn(slot, (F.col("_before") + F.col("_place")).cast("long")).drop("_range", "_place", "_before")


def crc32_sql(hexadecimal: str) -> str:
    """DuckDB SQL for the CRC-32 of bytes, given as SQL for their hexadecimal digits; half a byte at a time."""

    def half(c: int) -> int:
        for _ in range(4):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        return c

    after = lambda c, four: f"xor({c} >> 4, {[half(x) for x in range(16)]}[1 + (xor({c}, {four}) & 15)])"
    numbers = f"list_transform(regexp_extract_all({hexadecimal}, '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce({numbers}, lambda c, b: {after(after('c', 'b'), '(b >> 4)')}, 4294967295), 4294967295)"
