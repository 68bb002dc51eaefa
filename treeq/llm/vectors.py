"""What the vector operators share: which vectors count, classes of equal vectors, unit rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def usable(vec_id: str = "vec_id", embedding: str = "embedding") -> Column:
    """The id is there and the vector is neither null, zero nor empty, with finite components only."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col(vec_id).isNotNull() & F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def with_node(vectors: DataFrame) -> DataFrame:
    """Usable rows with `node`, the same for equal vectors only (a digest of the components as text; -0 counts as 0)."""
    zero = F.lit(0.0).cast("float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double")
    rows = vectors.where(usable()).withColumn("embedding", F.transform("embedding", lambda x: x + zero))
    return rows.withColumn("node", F.unhex(F.md5(F.col("embedding").cast("string").cast("binary"))))


def matrix(column: pd.Series) -> np.ndarray:
    """Rows as doubles of length 1. Vectors of one batch have one length; scaling first keeps squares in range."""
    x = np.stack(column.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))
