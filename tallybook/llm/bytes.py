"""Texts as byte arrays: slices of bounded size for numpy work inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about ``limit`` bytes with the place of the first; null is empty.

    One text longer than that is a slice of its own.
    """
    first, held, size = 0, [], 0
    for n, text in enumerate(texts):
        raw = (text.as_py() or "").encode()
        if held and size + len(raw) > limit:
            yield first, held
            first, held, size = n, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield first, held


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in a row, and for each part its start, with the total at the end."""
    starts = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=starts[1:])
    return np.frombuffer(b"".join(parts), dtype=np.uint8), starts


def scramble(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A well mixed 64-bit hash of each number."""
    x = values.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
