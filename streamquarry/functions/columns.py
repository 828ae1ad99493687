"""Column helpers shared by all operators."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attributes(sdb: DataFrame) -> list[str]:
    """Attribute columns ``a0, a1, ...`` of a stream database, in order."""
    found = [c for c in sdb.columns if re.fullmatch(r"a\d+", c)]
    return sorted(found, key=lambda c: int(c[1:]))


def cells(sdb: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Unpivot to ``stream_id, pos, attr, val``; unset values give no cell."""
    attrs = attributes(sdb)
    pairs = F.array(
        *[F.struct(F.lit(int(a[1:])).alias("attr"), F.col(a).alias("val")) for a in attrs]
    )
    return (
        sdb.select("stream_id", "pos", *(extra or []), F.inline(pairs))
        .filter(F.col("val").isNotNull())
    )


def threshold(n_streams: int, supp: float) -> int:
    """Number of streams a supported item needs."""
    return max(1, math.ceil(round(n_streams * supp, 9)))
