"""F7_stable_id and the T4 sampling key: ids derived from keys and a seed,
identical under any partitioning or retry (unlike random uuids)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(seed: int, *keys: Column | str) -> Column:
    """``md5(seed|key1|key2...)`` as a 32-hex-digit id."""
    parts = [F.lit(str(seed))] + [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def sample_key(seed: int, key: Column | str) -> Column:
    """Order key for a reproducible sample without replacement."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}|"), k.cast("string")))
