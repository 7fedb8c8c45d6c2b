"""What the operators need of their tables besides reading and settling them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import read, scratch, settle, shared_dir

__all__ = ["bounded_keys", "read", "scratch", "settle", "shared_dir"]


def bounded_keys(ids: DataFrame, most: int) -> np.ndarray:
    """``xxhash64`` of the ids in the first column, sorted: all of them, or near ``most`` of the smallest, never more.

    Never empty, so that it can be searched: without ids it holds one key that no id is likely to have.
    """
    keys = ids.select(F.col(f"`{ids.columns[0]}`").alias("id")).where("id is not null").select(F.xxhash64("id").alias("key"))
    n = keys.count()
    if n > most:
        keys = keys.where(F.col("key") < int(-(2**63) + 2**64 * (most / n)))
    found = np.unique(np.array([r[0] for r in keys.collect()], dtype=np.int64))[:most]
    return found if len(found) else np.array([np.iinfo(np.int64).min + 1])
