"""Band joins by bins: pairs of equal keys whose numbers or dates lie within a reach of each other.

A value falls into the bin floor(value / reach); the other side is replicated to its bin and both neighbours, so that bins and keys together make an equi-join. Two bands make a grid of cells. A large key is thereby cut into cells,
and what a cell pairs beyond the band is bounded: with one band 3 bins stand for a window of 2 (1.5 times the pairs kept where values are even), with two bands 9 for 4.
"""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

EPOCH = dt.date(1970, 1, 1)


@dataclass(frozen=True)
class Band:
    """left and right: columns of the two sides (numbers or dates). reach: how far apart they may be, 0 or more; share: or this share of the left one, whichever is more (below 1)."""

    left: str
    right: str
    reach: float
    share: float = 0.0
    date: bool = False

    def number(self, column: str) -> Column:
        return F.datediff(F.col(column), F.lit(EPOCH)).cast("double") if self.date else F.col(column).cast("double")

    def scaled(self, column: str) -> Column:
        """The value on a scale where pairs of the band are less than 1 apart.

        With a share the scale is linear up to reach / share and logarithmic beyond. Its slope is never above 1 / reach nor above 1 / (share * |x|), so the largest step is log(1 / (1 - share)) / share.
        """
        x = self.number(column)
        if not self.share:
            return x / (max(self.reach, 1e-6) * (1 + 1e-9))  # float sums may pass the border by a trifle
        turn, step = self.reach / self.share, math.log(1 / (1 - self.share)) / self.share * (1 + 1e-9)
        log = F.signum(x) * (F.lit(turn / self.reach) + F.log(F.abs(x) / turn) / self.share)
        return F.when(F.abs(x) <= turn, x / self.reach).otherwise(log) / step

    def holds(self) -> Column:
        a, b = F.col(self.left), F.col(self.right)
        apart = F.abs(F.datediff(a, b)) if self.date else F.abs(a - b)
        return apart <= (F.greatest(F.lit(self.reach), F.abs(a) * self.share) if self.share else F.lit(self.reach))


def band_join(left: DataFrame, right: DataFrame, equal: list[str], bands: list[Band]) -> DataFrame:
    """Pairs with equal keys (never null) inside all bands; a null in a band has no pair. Apart from the keys, the sides' columns have different names. At most two bands make bins, the others are conditions."""
    binned, names = bands[:2], []
    for i, band in enumerate(binned):
        names.append(f"_bin{i}")
        left = left.where(F.col(band.left).isNotNull()).withColumn(f"_bin{i}", F.floor(band.scaled(band.left)))
        at = F.floor(band.scaled(band.right))
        right = right.where(F.col(band.right).isNotNull()).withColumn(f"_bin{i}", F.explode(F.sequence(at - 1, at + 1)))
    pairs = left.join(right, [*equal, *names])
    for band in bands:
        pairs = pairs.where(band.holds())
    return pairs.drop(*names)
