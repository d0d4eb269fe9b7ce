"""Bitmaps of a fixed width, built by Spark's bitmap aggregates and small enough to broadcast whatever the input."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = 32768
#: Widest bitmap, as a power of two: 32 MB.
WIDEST = 28


def width_for(rows: int, spare: int = 4) -> int:
    """The power of two of a bitmap with `spare` bits a row, between one page and the widest."""
    return min(WIDEST, max(15, (max(1, rows) * spare - 1).bit_length()))


def bitmap(cells: DataFrame, cell: Column, width: int) -> np.ndarray:
    """The bits of cells (whole numbers below 2 ** width) as packed bytes: 2 ** width / 8 of them."""
    one = cell.cast("long") + 1
    paged = cells.select(F.bitmap_bucket_number(one).alias("page"), F.bitmap_bit_position(one).alias("bit"))
    out = np.zeros((1 << width) // 8, np.uint8)
    for row in paged.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        at = (row["page"] - 1) * (PAGE // 8)
        out[at : at + PAGE // 8] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out


def test(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bits[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1
