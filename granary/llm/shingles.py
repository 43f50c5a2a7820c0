"""Hashes of word shingles, in NumPy over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

#: Word separators: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n of each at least."""
    while len(_powers[0]) < n:
        for k, b in ((0, _BASE), (1, _INVERSE)):
            _powers[k] = np.concatenate([_powers[k], _powers[k] * np.uint64(pow(b, len(_powers[k]), 1 << 64))])
    return _powers


def word_spans(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word of consecutive texts of ``sizes`` bytes, and how many words each text has."""
    solid = ~SPACE[data]
    ends = np.cumsum(sizes)
    cut = np.zeros(len(data) + 1, bool)
    cut[ends - sizes] = True
    first = solid & (cut[:-1] | ~np.concatenate([[False], solid[:-1]]))
    cut[:] = False
    cut[ends] = True
    last = solid & (cut[1:] | ~np.concatenate([solid[1:], [False]]))
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, stop, np.searchsorted(start, ends) - np.searchsorted(start, ends - sizes)


def span_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, letters: np.ndarray = _BYTE) -> np.ndarray:
    """64-bit hashes of stretches of bytes: polynomials in a fixed base, from prefix sums modulo 2^64, mixed at last."""
    power, inverse = _power(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters[data] * power[: len(data)], dtype=np.uint64)])
    return mix((total[stop] - total[start]) * inverse[start])


def _hashes(raw: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(sizes), np.int64)
    start, stop, counts = word_spans(data, sizes)
    return span_hashes(data, start, stop), counts


def word_hashes(raw: bytes, sizes: np.ndarray, most: int = 8 << 20) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of consecutive texts of ``sizes`` bytes, and how many words each text has.

    A single text of more than ``most`` bytes is hashed in stretches that end at white space.
    """
    if len(sizes) != 1 or len(raw) <= most:
        return _hashes(raw, sizes)
    found, at = [], 0
    while at < len(raw):
        stop = min(at + most, len(raw))
        if stop < len(raw):
            gaps = np.flatnonzero(SPACE[np.frombuffer(raw, np.uint8, stop - at, at)])
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
            else:  # a word longer than a stretch
                while stop < len(raw) and not SPACE[raw[stop]]:
                    stop += 1
        found.append(_hashes(raw[at:stop], np.array([stop - at]))[0])
        at = stop
    hashes = np.concatenate(found)
    return hashes, np.array([len(hashes)])


def shingle_hashes(raw: bytes, sizes: np.ndarray, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``words`` words of each text, in order, and how many each text has.

    A text of fewer words has one shingle of all its words; a text without words has none.
    """
    hashes, counts = word_hashes(raw, sizes)
    many = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(counts)])[:-1]
    at = np.repeat(begin, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    padded = np.concatenate([hashes, np.zeros(words, np.uint64)])
    limit = np.repeat(begin + counts, many)
    out = np.zeros(len(at), np.uint64)
    for k in range(words):
        value = padded[at + k]
        value[at + k >= limit] = 0  # a short text ends before
        out = (out ^ value) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return mix(out), many


EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


_named: dict[int, np.ndarray] = {}


def _targets(bins: int, attempts: int) -> np.ndarray:
    """The bin that each (attempt, bin) names, for ``attempts`` attempts at least."""
    known = _named.get(bins)
    if known is None or len(known) < attempts:
        step = np.arange(1, 2 * attempts + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        _named[bins] = known = (mix(np.arange(bins, dtype=np.uint64) * np.uint64(0x100000001B3) + step) % np.uint64(bins)).astype(np.int64)
    return known


def densify(bins: np.ndarray) -> np.ndarray:
    """Fill each empty bin with the value of the bin that a fixed hash of (bin, attempt) names first among the full ones.

    Rows without any full bin stay empty.
    """
    full, width = bins != EMPTY, bins.shape[1]
    out, flat, known = bins.copy().reshape(-1), bins.reshape(-1), full.reshape(-1)
    at = np.flatnonzero(~full & full.any(1)[:, None])
    first, place, attempt = at - at % width, at % width, 0
    while len(at):
        target = first + _targets(width, attempt + 1)[attempt][place]
        hit = known[target]
        out[at[hit]] = flat[target[hit]]
        miss = ~hit
        at, first, place, attempt = at[miss], first[miss], place[miss], attempt + 1
    return out.reshape(bins.shape)


def distinct(hashes: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each of consecutive sets, ascending, and how many each has; ``hashes`` is sorted in place."""
    cuts = np.concatenate([[0], np.cumsum(many)]).tolist()
    for a, b in zip(cuts, cuts[1:]):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[[a for a, b in zip(cuts, cuts[1:]) if b > a]] = True
    total = np.concatenate([[0], np.cumsum(new)])
    return hashes[new], np.diff(total[cuts])


def groups(texts: list[bytes], most: int = 1 << 20):
    """Slices of about ``most`` bytes; a longer text stands alone."""
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)
