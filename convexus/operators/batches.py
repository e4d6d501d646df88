"""Batches whose size follows the memory there is."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd


def halving(function: Callable[[pd.DataFrame], Any], frame: pd.DataFrame, size: int) -> Iterator[tuple[int, Any]]:
    """(first row, result) of ``function`` on ``size`` rows at a time; when memory runs out, half as many from the same row on.

    A single row that does not fit raises.
    """
    at = 0
    while at < len(frame):
        try:
            found = function(frame.iloc[at : at + size])
        except MemoryError:
            if size == 1:
                raise
            size = max(1, size // 2)
            continue
        yield at, found
        at += size
