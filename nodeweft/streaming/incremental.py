"""Incremental loading: the difference of two snapshots, and the same as a stream of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, status) of two manifests (file, sha1): unchanged, changed (new files too) or removed."""
    joined = old.select("file", F.col("sha1").alias("before")).join(new.select("file", F.col("sha1").alias("after")), "file", "full_outer")
    status = F.when(F.col("after").isNull(), "removed").when(F.col("before").eqNullSafe(F.col("after")), "unchanged").otherwise("changed")
    return joined.select("file", status.alias("status"))


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("status").agg(F.count("*").alias("n"))


def touched(diff: DataFrame) -> DataFrame:
    """Files whose part of the graph has to be made anew or taken away."""
    return diff.where(F.col("status") != "unchanged").select("file")


def has_changes(diff: DataFrame) -> bool:
    return bool(touched(diff).take(1))


def merged_facts(old_facts: DataFrame, old: DataFrame, files: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The facts of a new snapshot: those of unchanged files are kept, only changed files are parsed.

    Edges are resolved anew from all facts, so the graph equals one built from scratch: no edge, external, role, route or
    render of an earlier state stays behind.
    """
    from nodeweft.sources.tree import manifest

    diff = file_diff(old, manifest(files))
    changed = diff.where(F.col("status") == "changed").select("file")
    kept = old_facts.join(touched(diff), "file", "left_anti").select(*old_facts.columns)
    return kept.unionByName(extract(files.join(changed, "file", "left_semi")))


def watch(spark: SparkSession, folder: str, schema: str, on_batch: Callable[[DataFrame, int], None], checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Snapshots that arrive as parquet files in `folder`, each batch reduced to the latest row of a file and handed to
    `on_batch`; ends when what is there has been read. A batch that is run again has the same number and the same rows."""
    from nodeweft.operators.rows import latest_rows

    def batch(df: DataFrame, number: int) -> None:
        on_batch(latest_rows(df, ["file"], ["indexed_at"]), number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
