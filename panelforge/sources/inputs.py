"""The five input tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Inputs:
    """``sales`` carries ``ord``, its position in the file, besides the file's columns."""

    sales: DataFrame
    targets: DataFrame
    items: DataFrame
    item_cats: DataFrame
    shops: DataFrame
    n_blocks: int
