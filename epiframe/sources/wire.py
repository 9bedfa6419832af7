"""Arrays as (dtype, shape, bytes) rows."""

from __future__ import annotations

import numpy as np

SCHEMA = "struct<dtype:string,shape:array<int>,data:binary>"


def pack(x: np.ndarray) -> dict:
    """A numeric array for the wire; objects, structures and complex numbers are refused."""
    x = np.asarray(x)
    if x.dtype.kind in "OVc":
        raise ValueError(f"cannot send {x.dtype}")
    return {"dtype": x.dtype.str, "shape": list(x.shape), "data": np.ascontiguousarray(x).tobytes()}


def unpack(row: dict) -> np.ndarray:
    """The inverse of :func:`pack`."""
    return np.frombuffer(row["data"], np.dtype(row["dtype"])).reshape(row["shape"])
