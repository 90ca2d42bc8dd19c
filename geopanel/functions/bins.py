"""Right-closed bins and their labels."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def breaks_by(start: int, stop: int, step: int, scale: int = 1, open_end: bool = False) -> list[float]:
    """``start/scale, (start+step)/scale, … stop/scale`` as exact literals.

    Working in integers and dividing once avoids accumulating steps such as 0.1.
    """
    out = [v / scale for v in range(start, stop + 1, step)]
    return [*out, math.inf] if open_end else out


# Pollution bins 0,5,…,70,Inf; coarse bins 0,10,…,100,Inf; score bins 0,0.1,…,1.
POLLUTION_BREAKS = breaks_by(0, 70, 5, open_end=True)
COARSE_BREAKS = breaks_by(0, 100, 10, open_end=True)
SCORE_BREAKS = breaks_by(0, 10, 1, scale=10)


def _text(value: float) -> str:
    if math.isinf(value):
        return "Inf"
    return f"{value:g}"


def bin_labels(breaks: list[float], include_lowest: bool = True) -> list[str]:
    """Interval labels: ``[0,5]``, ``(5,10]``, … ``(70,Inf]``."""
    labels = []
    for i, (lo, hi) in enumerate(zip(breaks, breaks[1:])):
        opening = "[" if include_lowest and i == 0 else "("
        labels.append(f"{opening}{_text(lo)},{_text(hi)}]")
    return labels


def bin_index(value: Column, breaks: list[float], include_lowest: bool = True) -> Column:
    """0-based bin number; NULL below the first or above the last break, and for NaN."""
    value = F.nanvl(value, F.lit(None).cast("double"))
    low = value >= breaks[0] if include_lowest else value > breaks[0]
    expr = F.when(~low, F.lit(None).cast("int"))
    for i, hi in enumerate(breaks[1:]):
        expr = expr.when(value <= F.lit(hi), F.lit(i))
    return expr


def cut_bins(value: Column, breaks: list[float], include_lowest: bool = True) -> Column:
    """Bin label of a value; every bin is closed on the right."""
    names = F.array(*[F.lit(b) for b in bin_labels(breaks, include_lowest)])
    return F.try_element_at(names, bin_index(value, breaks, include_lowest) + 1)


def interval_bounds(label: Column) -> tuple[Column, Column]:
    """Lower and upper bound of an interval label; ``Inf`` gives NULL."""
    number = r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    lo = F.regexp_extract(label, r"^[\[(]" + number + ",", 1).try_cast("double")
    hi = F.regexp_extract(label, "," + number + r"[\])]$", 1).try_cast("double")
    return lo, hi
