"""Array helpers used inside tasks: hash the words or lines of whole texts without a Python object per word.

Bytes are hashed as ``sum(T[byte] * M[position])`` modulo 2**64 followed by a finaliser, with T and M fixed
pseudo-random tables, so that equal words get equal hashes on every executor and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: bytes handled at once; longer texts are cut at white space
CHUNK = 1 << 20
_POS = 1 << 12

_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = _rng.integers(1, 2**63, size=_POS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: white space of the contracts: \x20 and \x09-\x0D
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True

#: white space and ASCII punctuation
APART = SPACE.copy()
APART[[c for c in range(33, 127) if not chr(c).isalnum()]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_TABLE = _TABLE[_LOWER]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _spans(sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs where ``sep`` is False."""
    edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
    if len(sep) and not sep[0]:
        edge = np.concatenate(([0], edge))
    if len(sep) and not sep[-1]:
        edge = np.concatenate((edge, [len(sep)]))
    return edge[::2], edge[1::2]


def _hash_spans(table: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    keep = np.zeros(len(buf) + 1, np.int8)
    keep[starts] += 1
    keep[ends] -= 1
    idx = np.flatnonzero(np.cumsum(keep[:-1], dtype=np.int8))
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    pos = np.arange(len(idx)) - np.repeat(first, size)
    pos += (pos >> 12) * 7919  # beyond the table, positions are folded with a shift of their block
    out = np.add.reduceat(table[buf[idx]] * _MULT[pos & (_POS - 1)], first)
    return mix(out + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def hash_tiles(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the spans that tile ``buf``, each from its start to the next."""
    size = np.diff(np.append(starts, len(buf)))
    pos = np.arange(len(buf)) - np.repeat(starts, size)
    pos += (pos >> 12) * 7919
    out = np.add.reduceat(_TABLE[buf] * _MULT[pos & (_POS - 1)], starts)
    return mix(out + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _pieces(data: bytes) -> Iterator[bytes]:
    """A text in pieces of about CHUNK bytes, cut behind white space; a longer word stays whole."""
    at = 0
    while len(data) - at > CHUNK:
        cut = max(data.rfind(b" ", at, at + CHUNK), data.rfind(b"\n", at, at + CHUNK))
        if cut <= at:
            cut = min((x for x in (data.find(b" ", at + CHUNK), data.find(b"\n", at + CHUNK)) if x >= 0), default=len(data) - 1)
        yield data[at : cut + 1]
        at = cut + 1
    if at < len(data):
        yield data[at:]


def hash_words(data: bytes, lower: bool = False, apart: np.ndarray = SPACE) -> np.ndarray:
    """A 64-bit hash of each word of one text, in order; words are split at the bytes of ``apart``; ``lower`` folds A-Z."""
    table = _LOWER_TABLE if lower else _TABLE
    out = []
    for piece in _pieces(data):
        buf = np.frombuffer(piece, np.uint8)
        out.append(_hash_spans(table, buf, *_spans(apart[buf])))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def hash_prefixes(data: bytes, sizes: tuple[int, ...], apart: np.ndarray = SPACE) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Hashes of the words of one text with A-Z folded, and for each size those of the first so many bytes of each word (0 where it has no more)."""
    words, found = [], {k: [] for k in sizes}
    for piece in _pieces(data):
        buf = np.frombuffer(piece, np.uint8)
        starts, ends = _spans(apart[buf])
        words.append(_hash_spans(_LOWER_TABLE, buf, starts, ends))
        for k in sizes:
            at = np.flatnonzero(ends - starts > k)
            out = np.zeros(len(starts), np.uint64)
            out[at] = mix(_hash_spans(_LOWER_TABLE, buf, starts[at], starts[at] + k) + np.uint64(k))
            found[k].append(out)
    none = np.zeros(0, np.uint64)
    return np.concatenate(words) if words else none, {k: np.concatenate(v) if v else none for k, v in found.items()}


def batches(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK bytes together, at least one text each."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > CHUNK:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def hash_words_of(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of several texts one after the other, and how many words each has."""
    if len(texts) == 1:
        h = hash_words(texts[0], lower)
        return h, np.array([len(h)])
    sizes = np.array([len(t) + 1 for t in texts])
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    starts, ends = _spans(SPACE[buf])
    bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
    return _hash_spans(_LOWER_TABLE if lower else _TABLE, buf, starts, ends), np.diff(bounds)


def hash_lines_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For several texts: hashes of the \\n-split lines that have a word, and how many such lines each text has."""
    sizes = np.array([len(t) + 1 for t in texts])
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    starts, ends = _spans(NEWLINE[buf])
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    letters = np.concatenate(([0], np.cumsum(~SPACE[buf])))
    has = letters[ends] > letters[starts]
    starts, ends = starts[has], ends[has]
    bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
    return _hash_spans(_TABLE, buf, starts, ends), np.diff(bounds)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows of one text; of the whole sequence if it has fewer words; none without words."""
    if not len(words):
        return words
    k = min(k, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + len(out)])
    return mix(out + np.uint64(k))
