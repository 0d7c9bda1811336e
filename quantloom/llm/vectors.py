"""What the operators over vectors share: whole-number components, and vectors as compact byte strings that compare by value."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_WIDTHS = ((1, 1 << 7), (2, 1 << 15), (4, 1 << 31), (8, 1 << 62))


def integers(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of lists of numbers: which rows are vectors (not null, all components finite); floor(scale * x) of their components one row behind the other; their lengths."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components are NaN
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype("i8")
    keep = np.asarray(column.is_valid())
    row, bad = np.repeat(np.arange(len(lengths)), lengths), ~np.isfinite(flat)
    keep = keep & (np.bincount(row[bad], minlength=len(lengths)) == 0)
    values = np.floor(flat[keep[row]] * scale)
    if len(values) and np.abs(values).max() >= 1 << 62:
        raise ValueError(f"components must stay below 2^62 / {scale}")
    return keep, values.astype("i8"), lengths[keep]


def pack(values: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """Each vector as bytes: how many bytes a component has, then the components without the zeros at the end. Equal vectors have equal bytes."""
    out, end = [], 0
    for n in lengths.tolist():
        x, end = values[end : end + n], end + n
        if n and not x[-1]:
            x = np.trim_zeros(x, "b")
        most = max(int(x.max()), -int(x.min()) - 1) if len(x) else 0
        width = next(w for w, top in _WIDTHS if most < top)
        out.append(bytes([width]) + x.astype(f"<i{width}").tobytes())
    return out


def unpack(codes: list[bytes], dim: int) -> np.ndarray:
    """Packed vectors as the rows of a matrix of `dim` columns: zeros behind the end of shorter ones; what longer ones have beyond is left out."""
    out = np.zeros((len(codes), dim), "i8")
    if codes and len({(len(c), c[0]) for c in codes}) == 1:
        width = codes[0][0]
        x = np.frombuffer(b"".join(c[1:] for c in codes), f"<i{width}").reshape(len(codes), -1)[:, :dim]
        out[:, : x.shape[1]] = x
        return out
    for row, c in zip(out, codes):
        x = np.frombuffer(c, f"<i{c[0]}", offset=1)[:dim]
        row[: len(x)] = x
    return out
