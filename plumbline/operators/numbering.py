"""Global row numbers without a one-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_RANGES = 512
SAMPLE_PER_RANGE = 32


def number_rows(df: DataFrame, *order: str, name: str = "row_no") -> DataFrame:
    """Add a dense 0-based BIGINT row number in the order of the given columns.

    The columns together must identify rows and hold no nulls. Rows are cut
    into ranges of the whole key (so one hot leading value is cut too), a count
    per range gives each range its offset, and rows are numbered inside their
    range. The only ungrouped window runs over the range counts, at most
    ``MAX_RANGES`` rows. The cut points are literals in the plan: a task that is
    run again after a lost executor numbers its rows as before.
    """
    ranges = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MAX_RANGES)
    key = F.struct(*order)
    # The keys with the smallest hashes are a uniform sample; its size is fixed.
    sample = (
        df.select(*order)
        .orderBy(F.xxhash64(*order))
        .limit(max(ranges, 2) * SAMPLE_PER_RANGE)
        .collect()
    )
    keys = sorted(tuple(r) for r in sample)
    cuts = sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []
    types = {f.name: f.dataType for f in df.schema.fields}
    bounds = [F.struct(*[F.lit(v).cast(types[c]).alias(c) for v, c in zip(b, order)]) for b in cuts]
    slot = sum(((key > b).cast("int") for b in bounds), F.lit(0))
    ranged = df.withColumn("_range", slot)
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(
        Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (
        ranged.join(F.broadcast(offsets), "_range")
        .withColumn(name, (F.col("_offset") + inside - 1).cast("bigint"))
        .drop("_range", "_offset")
    )
