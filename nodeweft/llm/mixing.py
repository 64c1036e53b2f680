"""Problem 8: a mixture of sources by target weights.

The tokens of each source are counted, a repetition rate is derived for each, and every document is emitted floor(rate)
times plus one more time with a probability equal to the fraction, decided by a hash of its id and the seed: the same
documents come out whatever the partitioning or the order.

The size of the mixture is the largest at which every source that has tokens reaches its share, unless `total_tokens`
names another. Then rate = share x size / tokens, at most max_repeats. A source without tokens can't be met; its share is
missing from all sums, so the others reach a little more than their target, in the same proportions. With a size of the
caller's own, a source that its max_repeats holds back stays below its share, and the report says so.

Defined results: sources are compared without case and outer spaces; a target given twice under spellings of one source
has the sum of the shares and the smaller max_repeats; null or negative shares and max_repeats count as 0; documents of
a source without target, of a null source, and without tokens (null and empty texts) aren't emitted; an empty table gives
an empty mixture and a report of unmet targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeweft.operators.rows import broadcast_if_small
from nodeweft.session import stage

from .tokens import token_count

#: Targets up to this number are broadcast (a name and three numbers each); beyond it they are joined by shuffle.
BROADCAST_ROWS = 50_000


def source_key(source: Column) -> Column:
    return F.lower(F.trim(source))


def document_sizes(documents: DataFrame, **tokenizer: str) -> DataFrame:
    """(doc_id, source, tokens) of each document, written once as a table, since sums and emission both read it."""
    sized = documents.select("doc_id", source_key(F.col("source")).alias("source"), token_count(F.col("text"), **tokenizer).alias("tokens"))
    return stage(sized, "document-sizes")


def rates(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per target: source, target_share, max_repeats, tokens at hand, and the rate at which it is repeated."""
    wanted = (
        targets.select(
            source_key(F.col("source")).alias("source"),
            F.greatest(F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("target_share"),
            F.greatest(F.coalesce(F.col("max_repeats").cast("int"), F.lit(0)), F.lit(0)).alias("max_repeats"),
        )
        .where(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    )
    at_hand = sizes.groupBy("source").agg(F.sum("tokens").alias("available"))
    joined = stage(wanted.join(at_hand, "source", "left").withColumn("available", F.coalesce("available", F.lit(0))), "targets")
    able = (F.col("available") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    # One number, from a table of one row per target.
    size = F.lit(float(total_tokens)) if total_tokens is not None else joined.where(able).agg(F.min(F.col("max_repeats") * F.col("available") / F.col("target_share"))).scalar()
    rate = F.when(able, F.least(F.col("target_share") * size / F.col("available"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    # What floating point leaves next to a whole number isn't a fraction to draw by.
    whole = F.when(F.abs(F.col("rate") - F.round("rate")) < 1e-9, F.round("rate")).otherwise(F.col("rate"))
    # One row per target; as a table it is worked out once, however often it is read.
    return stage(joined.withColumn("rate", rate).withColumn("rate", whole), "rates")


def mixture(sizes: DataFrame, rated: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, source, tokens, copy): one row for each time that a document is used, copies numbered from 0."""
    unit = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    small = broadcast_if_small(rated.where("rate > 0").select("source", "rate"), BROADCAST_ROWS)
    times = F.floor("rate") + F.when(unit < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return (
        sizes.where("tokens > 0")
        .join(small, "source")
        .withColumn("times", times)
        .where("times > 0")
        .select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(0), (F.col("times") - 1).cast("int"))).alias("copy"))
    )


def shares(mixed: DataFrame, rated: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """The report: for each target the share reached and what stood against it.

    status: `met` within `tolerance` of the target, as a part of it; `no documents`; `max_repeats reached`; `off` for what the draw or a
    missing source leaves.
    """
    used = mixed.groupBy("source").agg(F.sum("tokens").alias("used"), F.count("*").alias("rows"))
    report = rated.join(used, "source", "left").withColumns({"used": F.coalesce("used", F.lit(0)), "rows": F.coalesce("rows", F.lit(0))})
    total = mixed.agg(F.sum("tokens")).scalar()
    reached = F.coalesce(F.col("used") / total, F.lit(0.0))
    status = (
        F.when(F.col("available") == 0, "no documents")
        .when(F.abs(reached - F.col("target_share")) <= tolerance * F.col("target_share"), "met")
        .when((F.col("rate") >= F.col("max_repeats")) & (reached < F.col("target_share")), "max_repeats reached")
        .otherwise("off")
    )
    return report.select("source", "target_share", "max_repeats", F.col("available").alias("available_tokens"), "rate", F.col("rows").alias("used_rows"), F.col("used").alias("used_tokens"), reached.alias("reached_share"), status.alias("status"))
