"""Small text helpers of the formats."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def reverse_complement(seq: str | Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def label_of(path: str) -> str:
    """File name without its last extension."""
    name = path.replace("\\", "/").rstrip("/").rpartition("/")[2]
    return name.rpartition(".")[0] or name


@pandas_udf(StringType())
def general_format(v: pd.Series) -> pd.Series:
    """Six significant digits, as C's %g (Java's differs); used by text sinks only."""
    return v.map(lambda x: None if pd.isna(x) else f"{x:g}")
