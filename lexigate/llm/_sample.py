"""A bounded, repeatable choice of training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Steps of the share that is kept.
STEPS = 1 << 20


def bounded(rows: DataFrame, group: str, size: int, by: str = "text") -> DataFrame:
    """About ``size`` values of ``by`` of each group at most: (group, h), h the hash of the value.

    Distinct values are counted, and those kept whose hash lies in the share of all hashes that
    gives ``size``; a group with fewer values keeps all. The choice is the same at each run, no
    task gathers a group, and the result may be broadcast: it has about ``size`` rows a group.
    """
    values = rows.select(group, F.xxhash64(by).alias("h")).distinct()
    share = values.groupBy(group).agg((F.lit(size) / F.count("*")).alias("share"))
    kept = values.join(share, group).where(F.pmod("h", F.lit(STEPS)) < F.col("share") * STEPS)
    return kept.select(group, "h")
