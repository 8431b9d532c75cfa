"""Hash expressions whose values must agree between engines."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.LongType())
def blake64(texts: pd.Series) -> pd.Series:
    """BLAKE2b of 8 bytes over the UTF-8 bytes, read little end first as a signed number."""
    return texts.map(lambda s: int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "little", signed=True), na_action="ignore").astype("Int64")


def residue(group: Column, parts: int = 100) -> Column:
    """The MD5 of the group, read as a little-endian number, modulo ``parts``."""
    digest = F.md5(group)
    step = F.sequence(F.lit(0), F.lit(30), F.lit(2))
    return F.aggregate(step, F.lit(0).cast("long"), lambda a, i: (a * 256 + F.conv(F.substr(digest, F.lit(31) - i, F.lit(2)), 16, 10).cast("long")) % parts)


def draw(key: Column, seed: int) -> Column:
    """A deterministic sort key for sampling: SHA-1 of seed and key."""
    return F.sha1(F.concat(F.lit(f"{seed}:"), key.cast("string")))
