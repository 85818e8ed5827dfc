"""A set of integers in at most 8 MB: a bit for each, shared by those that fall on the same place.

It tells tasks which rows may be left where they are. Its size does not grow with the input; what it
holds beyond the set only makes rows travel in vain, so it decides about time and never about results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.params import SKETCH_WORDS


def build(values: DataFrame, column: str) -> np.ndarray:
    """The sketch of a column of spread 64-bit integers; combined in the tasks, SKETCH_WORDS rows at most."""
    bits = values.select(F.pmod(column, F.lit(SKETCH_WORDS)).alias("word"),
                         F.expr(f"shiftleft(1L, int(pmod(shiftrightunsigned({column}, 32), 64)))").alias("bit"))
    filled = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    sketch = np.zeros(SKETCH_WORDS, np.uint64)
    sketch[filled["word"].to_numpy()] = filled["bits"].to_numpy().view(np.uint64)
    return sketch


def may_hold(sketch: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value may be in the set; never wrong for one that is."""
    word = sketch[values % SKETCH_WORDS]
    return (word >> ((values.view(np.uint64) >> np.uint64(32)) % np.uint64(64))) & np.uint64(1) == 1
