"""Charts of reduced frames, drawn where matplotlib is installed."""

from __future__ import annotations

import numpy as np
import pandas as pd


def _pyplot():
    try:
        import matplotlib.pyplot as plt
    except ImportError as e:
        raise RuntimeError("charts need matplotlib") from e
    return plt


def bars(found: pd.DataFrame, x: str, y: str) -> pd.DataFrame:
    """Bars of a histogram ``(low, high, n)``."""
    plt = _pyplot()
    plt.bar(found["low"], found["n"], width=found["high"] - found["low"], align="edge")
    plt.xlabel(x)
    plt.ylabel(y)
    return found


def line(found: pd.DataFrame, x: str, y: str) -> pd.DataFrame:
    """A line of ``(depth, mean_value)``."""
    plt = _pyplot()
    plt.plot(found["depth"], found["mean_value"])
    plt.xlabel(x)
    plt.ylabel(y)
    return found


def surface(parts: list, title: str) -> None:
    """Rasters ``(borders in x, borders in y, [array])`` in one picture, empty cells left blank."""
    plt = _pyplot()
    plt.figure()
    for x, y, (a, *_) in parts:
        plt.pcolormesh(x, y, np.ma.masked_invalid(a))
    plt.title(title)
