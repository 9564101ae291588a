"""Exact deduplication as a stateful stream.

Facts about each text (digest of the normalised text, its length, the identifier, and where the
content lies) arrive as a stream. The state, one entry for each digest and without expiry, lives
in RocksDB on the executors' disks with its changes in the shared folder; it retains the smallest
identifier, that row's content locator, and the number of rows. A digest that holds more than one
row is a hit: then the full bytes of every such row, fetched by locator, are compared with those of
the row that stays. Rows that share a digest but not the bytes are grouped by the bytes themselves.

Null text counts as empty; null identifiers come after all others; of rows with the same smallest
identifier the first by locator stays; an empty table gives no rows; other columns are not read. A very
long text is a row of the JVM, and so is its normalised copy; only its digest and length enter the state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import chosen, normal, shared_path, table, written

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What the stream sets in the session while it runs. A store that preallocates files takes MB for each partition, however little it holds.
STATE = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
#: A micro-batch is half of the stream, so that later rows meet what earlier ones have left, but no more than this.
BATCH_BYTES = 8 << 30
#: Rows of one class that meet in one task when bytes are compared.
CLASS_ROWS = 4096


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def facts(docs: DataFrame, key: str = "doc_id", text: str = "text", digest=sha256) -> DataFrame:
    """What the stream carries for each row of ``docs``, a table read straight from files."""
    body = normal(F.col(text))
    return docs.select(
        F.col(key).alias("id"),
        sha256(body).alias("sha256"),
        digest(body).alias("digest"),
        F.octet_length(body).cast("long").alias("n_bytes"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )


def seen(stream: DataFrame) -> DataFrame:
    """The keyed state: one entry per digest and length. Works on a stream (update mode) and on a table."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "file", "row"))
    return stream.groupBy("digest", "n_bytes").agg(first.alias("first"), F.count("*").alias("n"))


def run_stream(spark, source: str, trigger_bytes: int | None = None) -> DataFrame:
    """Feeds the facts in folder ``source`` through the state in micro-batches; returns the last state of every digest.

    A batch writes the entries that it changed under its own number, so a batch that is run again
    after a failure replaces what it had written.
    """
    found = spark.read.parquet(source)
    if trigger_bytes is None:
        files = found.select("_metadata.file_path", "_metadata.file_size").distinct().agg(F.sum("file_size")).first()[0] or 1
        trigger_bytes = min(BATCH_BYTES, -(-files // 2))
    out, state = (shared_path(spark, f"dedup-{x}") for x in ("changes", "state"))
    before = {name: spark.conf.get(name, None) for name in STATE}
    for name, value in STATE.items():
        spark.conf.set(name, value)
    try:
        stream = spark.readStream.schema(found.schema).option("maxBytesPerTrigger", str(trigger_bytes)).parquet(source)
        query = (
            seen(stream)
            .writeStream.outputMode("update")
            .option("checkpointLocation", state)
            .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    if found.isEmpty():
        return seen(found)
    changes = spark.read.parquet(out)
    last = changes.groupBy("digest", "n_bytes").agg(F.max_by(F.struct("first", "n"), "batch").alias("x"))
    return last.select("digest", "n_bytes", "x.first", "x.n")


def spot() -> Column:
    return F.xxhash64("file", "row")


def compared(docs: DataFrame, members: DataFrame, text: str) -> DataFrame:
    """For rows of classes with hits: whether the full normalised bytes equal those of the row that stays."""
    located = docs.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), F.col(text).alias("_text")).withColumn("spot", spot())
    # by a hash of the locator first: only texts that it chooses are shuffled
    located = chosen(located, members.select(spot().alias("spot")), "spot").drop("spot")
    held = members.withColumn("salts", F.ceil(F.col("n") / CLASS_ROWS).cast("int"))
    bodies = located.join(held, ["file", "row"]).withColumn("_text", normal(F.col("_text")))
    bodies = written(bodies, "dedup-hits")
    stays = (F.col("file") == F.col("first.file")) & (F.col("row") == F.col("first.row"))
    kept = bodies.filter(stays).select("digest", "n_bytes", F.col("_text").alias("_kept"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    salted = bodies.withColumn("salt", F.pmod(F.xxhash64("file", "row"), F.col("salts")).cast("int"))
    return salted.join(kept, ["digest", "n_bytes", "salt"]).select("id", "sha256", "digest", "n_bytes", "file", "row", "first", "n", (F.col("_text") == F.col("_kept")).alias("same"), F.when(F.col("_text") != F.col("_kept"), F.col("_text")).alias("other"))


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", digest=sha256, trigger_bytes: int | None = None) -> DataFrame:
    """``id, keep_id, group_size, kept, sha256, file, row`` for every row of ``docs``."""
    spark = docs.sparkSession
    source = shared_path(spark, "dedup-facts")
    facts(docs, key, text, digest).write.option("compression", "zstd").parquet(source)
    state = run_stream(spark, source, trigger_bytes)
    rows = written(spark.read.parquet(source).join(state, ["digest", "n_bytes"]), "dedup-rows")
    alone = rows.filter(F.col("n") == 1)
    checked = written(compared(docs, rows.filter(F.col("n") > 1), text), "dedup-checked")
    differ = checked.filter(~F.col("same"))
    groups = [alone.withColumn("group_size", F.lit(1).cast("long"))]
    if differ.isEmpty():
        groups.append(checked.withColumn("group_size", F.col("n")))
    else:
        fewer = differ.groupBy("digest", "n_bytes").agg(F.count("*").alias("gone"))
        groups.append(checked.filter("same").join(fewer, ["digest", "n_bytes"], "left").withColumn("group_size", F.col("n") - F.coalesce("gone", F.lit(0))))
        own = differ.groupBy("digest", "n_bytes", "other").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "file", "row")).alias("first"), F.count("*").alias("group_size"))
        groups.append(differ.drop("first").join(own, ["digest", "n_bytes", "other"]))
    stays = (F.col("file") == F.col("first.file")) & (F.col("row") == F.col("first.row"))
    columns = ["id", F.col("first.id").alias("keep_id"), "group_size", stays.alias("kept"), "sha256", "file", "row"]
    out = groups[0].select(*columns)
    for g in groups[1:]:
        out = out.unionByName(g.select(*columns))
    return out


def survivors(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    gone = written(assign(docs, key, text, **options).filter("NOT kept").select(F.struct("file", "row").alias("_b_spot")), "dedup-gone")
    located = docs.withColumn("_b_spot", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))
    return chosen(located, gone, "_b_spot", "left_anti").select(docs.columns)


def op8_streaming_exact_dedup(spark, sf_dir) -> DataFrame:
    done = assign(table(spark, sf_dir, "documents"))
    return done.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM t JOIN g USING (body)
"""
