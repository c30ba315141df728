"""Text similarity ratio for pairs that no built-in expression settles."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors get this module with the task, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@F.pandas_udf(T.DoubleType())
def _ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two texts; null pairs are skipped."""
    from difflib import SequenceMatcher

    return pd.Series(
        [
            None if a is None or b is None else SequenceMatcher(None, a, b).ratio()
            for a, b in zip(left, right)
        ],
        dtype="float64",
    )


# Never copied into a pushed-down filter or join condition: each pair is compared once.
text_ratio = _ratio.asNondeterministic()
