"""Small inputs over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Below this many bytes a core, a table is dealt anew: it may sit in one file or row group, which is one task.
BYTES_A_CORE = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, dealt evenly over the cores if it is small by its files' size; a large one is left as it was scanned."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * BYTES_A_CORE else df
