"""Text recoding as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def replace_sequence(col: Column | str, pairs: Sequence[tuple[str, str]]) -> Column:
    """Apply regex replacements one after the other.

    A later pair sees the output of the earlier ones, so overlapping labels can
    damage each other ("Polluted" inside "Heavily Polluted"). Use
    :func:`fieldstats.operators.recoding.recode_exact` for whole values.
    """
    start = F.col(col) if isinstance(col, str) else col
    return reduce(lambda c, p: F.regexp_replace(c, p[0], p[1]), pairs, start)
