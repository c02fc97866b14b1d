"""Words of a batch of texts as arrays: UTF-8 bytes, places and 64-bit hashes, without a Python object per word."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np

#: White space outside ASCII (Unicode property White_Space); fixed values.
WIDE_SPACE = re.compile("[\u0085\u00a0\u1680\u2000-\u200a\u2028-\u2029\u202f\u205f\u3000]")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SLICE_BYTES = 1 << 20


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and of its inverse, for a power of two of places."""
    r = 0xD1342543DE82EF95
    up, down = np.full(n, r, np.uint64), np.full(n, pow(r, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


@cache
def byte_codes() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes (spans may overlap)."""
    up, down = powers(1 << max(21, int(len(data)).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_codes()[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * MULTIPLIER)


@dataclass
class Words:
    """Words of some texts: `data[starts[i]:ends[i]]` is word i, `first[d]:first[d + 1]` are those of text d, which begins at `begin[d]`."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    begin: np.ndarray


SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def split_words(texts: list[str], hashed: bool = True) -> Words:
    """Words between white space (Unicode White_Space) of each text."""
    joined = "\n".join(texts)
    if not joined.isascii() and WIDE_SPACE.search(joined):
        texts = [WIDE_SPACE.sub(" ", t) for t in texts]
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    gap = SPACES[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(data) and not gap[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    ends = ends[: len(starts)]
    begin = np.cumsum([0] + [len(p) + 1 for p in parts])
    hashes = span_hashes(data, starts, ends) if hashed else np.zeros(0, np.uint64)
    return Words(data, starts, ends, hashes, np.searchsorted(starts, begin), begin)


def slices(texts: list[str | None], limit: int = SLICE_BYTES) -> list[tuple[int, int]]:
    """Runs of consecutive texts of about `limit` characters (a longer text is a run of its own)."""
    out, start, size = [], 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > limit:
            out.append((start, i))
            start, size = i, 0
        size += n
    return out + [(start, len(texts))] if texts else []


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one run after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(before - starts, lengths)
