"""A table of scan points that streams append to: each batch writes only its own rows, readers merge, and compaction folds batches into buckets.

Below the folder: deltas/writer=.../batch=N (a batch's points), base/gen=G/bucket=K (folded points), manifest (one small file for each compaction, which says where each bucket
lies and which batches it holds). A manifest counts as soon as its only file is in place, and nothing that it or the one before it names is deleted.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.timeline import keep_last
from ..session import delete

BUCKETS = 64
_ORDER = ("_folded", "_writer", "_batch")


def _there(spark: SparkSession, read) -> DataFrame | None:
    """What a reader gives, or None if its folder does not exist. Any other trouble is an error, so that a store that cannot be read is never taken for an empty one."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _manifest(spark: SparkSession, folder: str) -> tuple[int, dict[int, int], dict[str, int]]:
    """(generation, generation of each bucket, last folded batch of each writer) of the newest compaction."""
    known = _there(spark, lambda: spark.read.schema("gen long, bucket int, at long, writer string, batch long").json(f"{folder}/manifest/*"))
    if known is None:
        return 0, {}, {}
    rows = known.join(known.agg(F.max("gen").alias("gen")), "gen").collect()  # a row for each bucket and each writer
    return max((r.gen for r in rows), default=0), {r.bucket: r.at for r in rows if r.bucket is not None}, {r.writer: r.batch for r in rows if r.writer is not None}


def _deltas(spark: SparkSession, folder: str, schema, folded: dict[str, int]) -> DataFrame | None:
    """Rows of batches that are not folded yet, with writer and batch."""
    rows = _there(spark, lambda: spark.read.schema(schema).option("basePath", f"{folder}/deltas").parquet(f"{folder}/deltas/writer=*"))
    if rows is None:
        return None
    names = [f for f in schema.fieldNames() if f not in ("writer", "batch")]
    done = F.lit(False)
    for writer, batch in folded.items():
        done |= (F.col("writer") == writer) & (F.col("batch") <= batch)
    return rows.filter(~done).select(*names, F.lit(1).alias("_folded"), F.col("writer").alias("_writer"), F.col("batch").cast("long").alias("_batch"))


def _with_parts(schema):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    return StructType([*schema.fields, StructField("writer", StringType()), StructField("batch", LongType())])


def _merged(rows: DataFrame, names: list[str]) -> DataFrame:
    """One point for each repository and time: the last that came with another score than the one before it, as a point that repeats the stored score changes nothing."""
    w = Window.partitionBy("repo_id", "scan_ts").orderBy(*_ORDER)
    changed = ~F.col("score").eqNullSafe(F.lag("score").over(w)) | (F.row_number().over(w) == 1)
    back = Window.partitionBy("repo_id", "scan_ts").orderBy(*(F.desc(c) for c in _ORDER))
    return rows.withColumn("_new", changed).filter("_new").withColumn("_r", F.row_number().over(back)).filter("_r = 1").select(*names)


def _base(spark: SparkSession, folder: str, schema, buckets: dict[int, int]) -> DataFrame | None:
    if not buckets:
        return None
    rows = spark.read.schema(schema).parquet(*(f"{folder}/base/gen={g}/bucket={k}" for k, g in sorted(buckets.items())))
    return rows.select(*schema.fieldNames(), F.lit(0).alias("_folded"), F.lit("").alias("_writer"), F.lit(0).cast("long").alias("_batch"))


def read_points(spark: SparkSession, folder: str, schema, keep: int | None = 50) -> DataFrame:
    """The store's points, merged in the order in which batches came: the last `keep` of each repository (None: all). A folder without a batch is an empty store."""
    _, buckets, folded = _manifest(spark, folder)
    parts = [p for p in (_base(spark, folder, schema, buckets), _deltas(spark, folder, _with_parts(schema), folded)) if p is not None]
    if not parts:
        return spark.createDataFrame([], schema)
    return keep_last(_merged(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), schema.fieldNames()), keep)


def append_batch(points: DataFrame, folder: str, writer: str, number: int) -> None:
    """Write a batch's points. The same batch again replaces itself; of points with one repository and time in a batch, the greatest row counts. Rows without either are left out."""
    rows = points.filter(F.col("repo_id").isNotNull() & F.col("scan_ts").isNotNull()).groupBy("repo_id", "scan_ts").agg(F.max(F.struct(*(c for c in points.columns if c not in ("repo_id", "scan_ts")))).alias("_x"))
    rows.select(*(c if c in ("repo_id", "scan_ts") else F.col(f"_x.{c}").alias(c) for c in points.columns)).write.mode("overwrite").parquet(f"{folder}/deltas/writer={writer}/batch={number}")


def compact(spark: SparkSession, folder: str, schema, buckets: int = BUCKETS, keep: int | None = 50) -> int:
    """Fold all batches that are there into their buckets; the generation it made, or the newest one if there was nothing to fold.

    Only buckets that a new batch touches are written anew. Batches and buckets that neither this generation nor the one before needs are deleted, so a reader that has begun can end.
    """
    gen, held, folded = _manifest(spark, folder)
    rows = _deltas(spark, folder, _with_parts(schema), folded)
    last = {} if rows is None else {r.writer: r.batch for r in rows.groupBy(F.col("_writer").alias("writer")).agg(F.max("_batch").alias("batch")).collect()}
    if not last:
        return gen
    rows = rows.filter(F.create_map(*(F.lit(x) for pair in last.items() for x in pair))[F.col("_writer")] >= F.col("_batch"))  # not what comes meanwhile
    bucket = F.pmod(F.xxhash64("repo_id"), F.lit(buckets)).cast("int")
    touched = [r.bucket for r in rows.select(bucket.alias("bucket")).distinct().collect()]
    stored = _base(spark, folder, schema, {k: g for k, g in held.items() if k in touched})
    merged = keep_last(_merged(rows if stored is None else rows.unionByName(stored), schema.fieldNames()), keep)
    merged.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/base/gen={gen + 1}")
    now = held | {k: gen + 1 for k in touched}
    lines = [(gen + 1, k, g, None, None) for k, g in now.items()] + [(gen + 1, None, None, w, b) for w, b in (folded | last).items()]
    spark.createDataFrame(lines, "gen long, bucket int, at long, writer string, batch long").coalesce(1).write.mode("error").json(f"{folder}/manifest/gen={gen + 1}")
    if gen:  # what the manifest before had folded, and buckets that it had replaced
        old = _there(spark, lambda: spark.read.option("basePath", f"{folder}/deltas").parquet(f"{folder}/deltas/writer=*").select("writer", "batch").distinct())
        gone = [f"{folder}/deltas/writer={r.writer}/batch={r.batch}" for r in (old.collect() if old is not None else []) if r.batch <= folded.get(r.writer, -1)]
        before = spark.read.schema("gen long, bucket int, at long").json(f"{folder}/manifest/*").filter(F.col("bucket").isNotNull() & (F.col("gen") < gen)).select("bucket", "at").distinct().collect()
        gone += [f"{folder}/base/gen={r.at}/bucket={r.bucket}" for r in before if r.at not in (held.get(r.bucket), now.get(r.bucket))]
        delete(spark, gone)
    return gen + 1


def upsert_points(points: DataFrame, folder: str, checkpoint: str, compact_every: int = 0, keep: int | None = 50) -> DataStreamWriter:
    """A query that appends each batch of scan points (repo_id, scan_ts, score, ...) to the store, and folds it after every so many batches (0: never).

    A writer is known by its checkpoint's id: a batch that runs again replaces its own rows, and a query with a new checkpoint folder is another writer, which comes after those that are there.
    """
    schema = points.schema
    named: list[str] = []

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not named:
            own = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
            there = _there(spark, lambda: spark.read.schema("writer string").option("basePath", f"{folder}/deltas").parquet(f"{folder}/deltas/writer=*"))
            known = {r.writer for r in there.select("writer").distinct().collect()} if there is not None else set()
            known |= set(_manifest(spark, folder)[2])
            named.append(next((w for w in known if w.endswith(own)), f"{len(known):06d}-{own}"))
        append_batch(batch, folder, named[0], number)
        if compact_every and (number + 1) % compact_every == 0:
            compact(spark, folder, schema, keep=keep)

    return points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
