"""Column functions shared by the measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entropy(n: Column) -> Column:
    """Aggregate: entropy in nats of the distribution with counts ``n``, ln N - sum(n ln n) / N, so that no window has to find the shares first; null without counts, null ones don't count."""
    total = F.sum(n)
    spread = F.log(total) - F.sum(F.when(n > 0, n * F.log(n))) / total
    return F.when(total > F.max(n), F.greatest(spread, F.lit(0.0))).when(total.isNotNull(), 0.0)
