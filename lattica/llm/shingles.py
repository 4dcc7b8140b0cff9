"""Word shingles as 64-bit hashes, computed for many texts at once with array operations."""

from __future__ import annotations

import numpy as np

#: Any odd multiplier works; powers of its inverse shift a window's hash back to the origin.
BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_CHUNK = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_CHUNK, 1 << (n - 1).bit_length()) if n else _CHUNK
    if size not in _powers:
        up = np.full(size, np.uint64(BASE))
        up[0] = 1
        down = np.full(size, np.uint64(pow(BASE, -1, 1 << 64)))
        down[0] = 1
        if size == _CHUNK:
            _powers[size] = (np.cumprod(up), np.cumprod(down))
        else:
            return np.cumprod(up), np.cumprod(down)
    return _powers[size]


def _word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of ``data``, words parted by single spaces."""
    b = np.frombuffer(data, dtype=np.uint8)
    up, down = _power_tables(len(b))
    total = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=total[1:])
    gaps = np.flatnonzero(b == 32)
    start = np.concatenate([[0], gaps + 1])
    end = np.concatenate([gaps, [len(b)]])
    return mix((total[end] - total[start]) * down[start])


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``width``-word shingles of each text.

    Words are what white space parts, in lower case. A text of fewer than ``width`` words is one shingle of all its
    words; an empty or null text has none.
    """
    words = [[] if t is None else t.lower().split() for t in texts]
    out: list[np.ndarray] = [np.empty(0, dtype=np.uint64)] * len(texts)
    factors = mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    at = 0
    while at < len(words):
        group, size = [], 0
        while at < len(words) and (not group or size < _CHUNK // 4):
            if words[at]:
                group.append((at, " ".join(words[at])))
                size += len(group[-1][1])
            at += 1
        if not group:
            continue
        h = _word_hashes(" ".join(t for _, t in group).encode("utf-8", "surrogatepass"))
        pos = 0
        for i, _ in group:
            n = len(words[i])
            own = h[pos : pos + n]
            pos += n
            if n < width:
                s = np.array([np.add.reduce(own * factors[:n]) + np.uint64(n)], dtype=np.uint64)
            else:
                s = own[: n - width + 1] * factors[0]
                for k in range(1, width):
                    s = s + own[k : n - width + 1 + k] * factors[k]
            out[i] = np.unique(mix(s))
    return out


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed 64-bit numbers; no order dependence."""
    a = np.add.reduce(mix(s + np.uint64(0x632BE59BD9B4E019)))
    b = np.add.reduce(mix(s ^ np.uint64(0xD1B54A32D192ED03)))
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def hash_family(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 20)
    return mix(k) | np.uint64(1), mix(k + np.uint64(1 << 40))


def min_hashes(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each hash function the least value over the set; long sets go in slices so that memory stays bounded."""
    low = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(s), 2048):
        np.minimum(low, (s[at : at + 2048, None] * a[None, :] + b[None, :]).min(axis=0), out=low)
    return low
