"""Hashed character n-grams of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Characters that one step of a task holds at most, unless one text alone has more.
STEP = 1_000_000


def steps(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts), cut so that a step stays small whatever the batch; null is empty text."""
    first, held, size = 0, [], 0
    for i in range(len(texts)):
        text = texts[i].as_py() or ""
        if held and size + len(text) > STEP:
            yield first, held
            first, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def hashed(texts: list[str], lengths: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length (number of the text, hash of ``bits`` bits) of all n-grams of code points within the texts."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(x) for x in texts])
    value = np.zeros(len(flat), np.uint32)
    for n in range(1, max(lengths) + 1):
        value = value[: len(flat) - n + 1] * np.uint32(0x01000193) + flat[n - 1 :] + np.uint32(1) if n <= len(flat) else value[:0]
        if n in lengths:
            inside = owner[: len(value)] == owner[n - 1 :] if len(value) else np.zeros(0, bool)
            mixed = (value ^ value >> np.uint32(15)) * np.uint32(0x2C1B3C6D) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
            yield owner[: len(value)][inside], (mixed >> np.uint32(32 - bits))[inside].astype(np.int64)


def counted(texts: list[str], lengths: tuple[int, ...], bits: int, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the distinct n-grams of each text, by text; only hashes that ``chosen`` marks, if given."""
    keys = []
    for owner, value in hashed(texts, lengths, bits):
        if chosen is not None:
            wanted = chosen[value]
            owner, value = owner[wanted], value[wanted]
        keys.append(owner.astype(np.int64) << bits | value)
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    return (key >> bits), key & ((1 << bits) - 1), count
