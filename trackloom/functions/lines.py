"""Line simplification of whole Arrow columns: all lines of a batch are split level by level, without a loop over lines.

A stretch between two kept points is split at the point farthest from the straight line between them, if that is farther than the
tolerance. All stretches of all lines that are open on a level are measured together on flattened coordinates; of equally far points the first
is taken. Memory is linear in the points of a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

KM_PER_DEGREE = 111.0


def kept_points(lat: np.ndarray, lon: np.ndarray, offsets: np.ndarray, tolerance_km: float) -> np.ndarray:
    """Which points of the lines [offsets[i], offsets[i + 1]) stay: their ends, and those that a split keeps."""
    size = np.diff(offsets)
    keep = np.zeros(len(lat), bool)
    some = size > 0
    keep[offsets[:-1][some]] = keep[offsets[1:][some] - 1] = True
    middle = np.zeros(len(size))
    middle[some] = np.add.reduceat(lat, offsets[:-1][some]) / size[some] if some.any() else 0
    x = lon * np.cos(np.radians(np.repeat(middle, size))) * KM_PER_DEGREE
    y = lat * KM_PER_DEGREE
    low, high = offsets[:-1][size > 2], offsets[1:][size > 2] - 1
    while len(low):
        inner = high - low - 1
        first = np.cumsum(inner) - inner
        at = np.arange(int(inner.sum())) + np.repeat(low + 1 - first, inner)
        a, b = np.repeat(low, inner), np.repeat(high, inner)
        dx, dy = x[b] - x[a], y[b] - y[a]
        ox, oy = x[at] - x[a], y[at] - y[a]
        length = np.hypot(dx, dy)
        off = np.where(length > 0, np.abs(dx * oy - dy * ox) / np.where(length > 0, length, 1), np.hypot(ox, oy))
        most = np.maximum.reduceat(off, first)
        split = np.minimum.reduceat(np.where(off == np.repeat(most, inner), at, len(lat)), first)
        far = most > tolerance_km
        low, high, split = low[far], high[far], split[far]
        keep[split] = True
        low, high = np.concatenate([low, split]), np.concatenate([split, high])
        open_ = high - low > 1
        low, high = low[open_], high[open_]
    return keep


def simplified(points: Column, tolerance_km: float) -> Column:
    """Arrays of (lat, lon) structs without the points that the tolerance spares. Null lines, and lines with a null coordinate, stay as they are."""

    @F.arrow_udf("array<struct<lat:double,lon:double>>")
    def simplify(lines: pa.Array) -> pa.Array:
        if isinstance(lines, pa.ChunkedArray):
            lines = lines.combine_chunks()
        kind = pa.list_(pa.struct([("lat", pa.float64()), ("lon", pa.float64())]))
        size = lines.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lines.flatten()
        lat, lon = (flat.field(k).cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False) for k in (0, 1))
        offsets = np.concatenate([[0], np.cumsum(size)])
        unknown = np.isnan(lat) | np.isnan(lon)
        whole = np.zeros(len(size), bool)
        whole[np.searchsorted(offsets, np.flatnonzero(unknown), "right") - 1] = True
        with np.errstate(invalid="ignore"):
            keep = kept_points(np.where(unknown, 0, lat), np.where(unknown, 0, lon), offsets, tolerance_km) | np.repeat(whole, size)
        ends = np.concatenate([[0], np.cumsum(keep)])[offsets]
        values = pa.StructArray.from_arrays([flat.field(k).cast(pa.float64()).filter(pa.array(keep)) for k in (0, 1)], ["lat", "lon"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, type=kind, mask=lines.is_null() if lines.null_count else None)

    return simplify(points)
