"""Random numbers by hash: the same for the same parts, in every run, partition and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash01(*parts: Column) -> Column:
    """A number in [0, 1) from MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("double") / float(2**48)
