"""Signals of many windows at once: zero-phase band filters, spectra and linear recurrences over ragged rows.

A batch of windows is a flat array and the edges of its windows. Recurrences step through all windows together, so a
batch costs as many steps as its longest window has samples.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

#: Samples that a zero-phase filter of two second-order sections mirrors at each end; shorter windows stay unfiltered.
PAD = 15


@cache
def band_filter(low: float, high: float, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of the Butterworth band filter of order two between low and high Hz, by the bilinear transform."""
    w1, w2 = (2 * rate * np.tan(np.pi * f / rate) for f in (low, high))
    width, centre = w2 - w1, np.sqrt(w1 * w2)
    half = np.exp(1j * np.pi * np.array([3, 5]) / 4) * width / 2
    poles = np.concatenate([half + np.sqrt(half**2 - centre**2), half - np.sqrt(half**2 - centre**2)])
    gain = width**2 * np.real((2 * rate) ** 2 / np.prod(2 * rate - poles))
    return gain * np.poly([1, 1, -1, -1]), np.real(np.poly((2 * rate + poles) / (2 * rate - poles)))


def resting(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Delays of the transposed direct form that a constant input of one keeps."""
    n = len(a) - 1
    shift = np.eye(n, k=1)
    shift[:, 0] = -a[1:]
    return np.linalg.solve(np.eye(n) - shift, b[1:] - a[1:] * b[0])


def recurred(b: np.ndarray, a: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Each row filtered from rest at its first value."""
    delays = resting(b, a) * rows[:, :1]
    out = np.empty_like(rows)
    for k in range(rows.shape[1]):
        x = rows[:, k]
        y = b[0] * x + delays[:, 0]
        out[:, k] = y
        delays = np.concatenate([delays[:, 1:], np.zeros((len(rows), 1))], axis=1) + x[:, None] * b[1:] - y[:, None] * a[1:]
    return out


def zero_phase(values: np.ndarray, edges: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The windows of values filtered forth and back, their ends mirrored through the end points."""
    out = values.astype(float).copy()
    sizes = np.diff(edges)
    for first, last in alike(sizes):
        which = np.argsort(sizes, kind="stable")[first:last]
        n, start = sizes[which], edges[:-1][which]
        keep = n > PAD
        n, start = n[keep], start[keep]
        if not len(n):
            continue
        at = np.arange(n.max() + 2 * PAD)[None, :]
        pos, end = at - PAD, (n - 1)[:, None]
        inner = np.where(pos < 0, -pos, np.where(pos > end, 2 * end - pos, pos)).clip(0, end)
        pick = values[start[:, None] + inner]
        side = values[start[:, None] + np.where(pos < 0, 0, end)]
        rows = np.where((pos < 0) | (pos > end), 2 * side - pick, pick)
        whole = n + 2 * PAD
        back = (whole[:, None] - 1 - at).clip(0)
        rows = np.take_along_axis(recurred(b, a, rows), back, axis=1)
        rows = np.take_along_axis(recurred(b, a, rows), back, axis=1)
        inside = (pos >= 0) & (pos <= end)
        out[(start[:, None] + pos)[inside]] = rows[inside]
    return out


def alike(sizes: np.ndarray, cells: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Slices of the windows in order of size, so that their padded matrix has about ``cells`` cells and is at most twice what they hold."""
    ordered, at = np.sort(sizes), 0
    while at < len(ordered):
        to = at + 1
        most = max(1, min(int(np.searchsorted(ordered, 2 * max(ordered[at], PAD), side="right")), len(ordered)) - at)
        while to < at + most and (to - at + 1) * ordered[to] <= cells:
            to += 1
        yield at, to
        at = to


def spectra(values: np.ndarray, edges: np.ndarray, rate: float, segment: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(windows, frequencies, power densities) of windows whose segments have one length: Hann segments, half over each other, means removed, averaged."""
    sizes = np.diff(edges)
    lengths = np.minimum(sizes, segment)
    for n in np.unique(lengths[lengths > 1]).tolist():
        which = np.flatnonzero(lengths == n)
        step = n - n // 2
        each = (sizes[which] - n) // step + 1
        first = np.repeat(edges[:-1][which], each) + (np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)) * step
        hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
        rows = values[first[:, None] + np.arange(n)]
        power = np.abs(np.fft.rfft((rows - rows.mean(axis=1, keepdims=True)) * hann)) ** 2 / (rate * (hann**2).sum())
        power[:, 1 : (n + 1) // 2] *= 2
        yield which, np.arange(n // 2 + 1) * rate / n, np.add.reduceat(power, np.cumsum(each) - each) / each[:, None]


def by_window(function: np.ufunc, values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """function.reduceat over windows that all have values."""
    return function.reduceat(values, edges[:-1])


def mean(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return by_window(np.add, values, edges) / np.diff(edges)


def quantile(values: np.ndarray, edges: np.ndarray, share: float) -> np.ndarray:
    """Quantiles of windows, between neighbours in proportion."""
    sizes = np.diff(edges)
    ordered = values[np.lexsort((values, np.repeat(np.arange(len(sizes)), sizes)))]
    place = (sizes - 1) * share
    low = np.floor(place).astype(np.int64)
    a, b = ordered[edges[:-1] + low], ordered[edges[:-1] + np.minimum(low + 1, sizes - 1)]
    return a + (place - low) * (b - a)
