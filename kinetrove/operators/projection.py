"""A plane for many columns: principal axes, where the neighbour-graph embedding's library is not at hand."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def principal_plane(rows: DataFrame, columns: list[str], axes: int = 2, name: str = "axis") -> DataFrame:
    """Adds ``axis_1`` .. : the rows' places along the directions of greatest variance of ``columns``.

    Sums, squares and products come by one aggregate over rows without NULLs, a number of values that the columns alone decide; the axes are found
    on the driver and applied as expressions. An axis points to where its heaviest column grows. Rows with a NULL have none.
    """
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    d = len(columns)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    found = rows.where(whole).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    if not found["n"]:
        return rows.withColumns({f"{name}_{k + 1}": F.lit(None).cast("double") for k in range(axes)})
    spread = np.zeros((d, d))
    for i, j in pairs:
        spread[i, j] = spread[j, i] = found[f"c{i}_{j}"]
    _, vectors = np.linalg.eigh(spread)
    out = {}
    for k in range(axes):
        v = vectors[:, d - 1 - k]
        v = v * np.sign(v[np.abs(v).argmax()])
        out[f"{name}_{k + 1}"] = reduce(add, [(F.col(c) - float(found[f"m{i}"])) * float(v[i]) for i, c in enumerate(columns)])
    return rows.withColumns(out)
