"""Streaming over sorted rows: what the first row of each row's run holds, across Arrow batches, in constant memory."""

from __future__ import annotations

import numpy as np


class RunFirsts:
    """Feed batches of rows sorted by their key columns; each call gives the values of the first row of every row's run."""

    def __init__(self):
        self._key: tuple | None = None
        self._values: tuple | None = None

    def __call__(self, keys: tuple[np.ndarray, ...], values: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        new = np.zeros(len(keys[0]), bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        new[0] = self._key != tuple(int(k[0]) for k in keys)
        run = np.cumsum(new)                                      # 0: goes on from the last batch
        carried = self._values or tuple(0 for _ in values)
        firsts = tuple(np.concatenate((np.array([c], v.dtype), v[new]))[run] for c, v in zip(carried, values, strict=True))
        self._key = tuple(int(k[-1]) for k in keys)
        self._values = tuple(int(f[-1]) for f in firsts)
        return firsts
