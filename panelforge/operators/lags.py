"""Features from earlier months."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.constants import LAGS
from panelforge.operators.panel import BLOCK, PAIR, Panel


def lags(panel: Panel, steps: Sequence[int] = LAGS) -> DataFrame:
    """Sales and row counts ``k`` months back, for months 1 to ``n_blocks``.

    The last month is the one to forecast. A month before the panel gives NULL. Looked up
    by month number in the pair's history, so a gap never shifts a lag.
    """
    block = F.col(BLOCK)
    columns = []
    for k in steps:
        suffix = "" if k == 1 else str(k)
        past = block - F.lit(k)
        columns += [
            F.when(past >= 0, panel.count(past)).alias(f"cnt_prev{suffix}"),
            F.when(past >= 0, panel.order(past)).alias(f"order_prev{suffix}"),
        ]
    return panel.rows(1, panel.n_blocks).select(BLOCK, *PAIR, *columns)
