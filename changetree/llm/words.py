"""Word and shingle hashing over whole Arrow batches of text, in numpy.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D after lower-casing A-Z, which for
UTF-8 equals the words [^\\x20\\x09-\\x0D]+ of the text. A word's hash is a polynomial over its bytes'
64-bit random values, finished by a mixing function, so it needs no Python loop over words."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
#: Odd multiplier of the polynomial and the mixing constants (fixed values of the hash).
BASE, MIX_1, MIX_2, STEP = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0xD6E8FEB86659FD93)
#: Texts are hashed in slabs of about this many bytes; longer texts make slabs of their own.
SLAB = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * MIX_1
    h = (h ^ (h >> U(27))) * MIX_2
    return h ^ (h >> U(31))


@lru_cache(maxsize=1)
def byte_values() -> tuple[np.ndarray, np.ndarray]:
    """Per byte: its random value with A-Z folded to a-z, and whether it is white space."""
    values = mix(np.arange(1, 257, dtype=U) * BASE)
    values[65:91] = values[97:123]
    space = np.zeros(256, bool)
    space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return values, space


@lru_cache(maxsize=1)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < size."""
    inverse = U(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(size, BASE, U), np.full(size, inverse, U)
    up[:1] = down[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the words of one UTF-8 slab."""
    raw = np.frombuffer(data, np.uint8)
    values, space = byte_values()
    inside = ~space[raw]
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(max(2 * SLAB, 1 << len(raw).bit_length()))
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, U), np.cumsum(values[raw] * up[: len(raw)], dtype=U)))
        h = (total[ends] - total[starts]) * down[starts]
        return mix(h + (ends - starts).astype(U)), starts


def texts_words(texts):
    """For each text (None: empty) the hashes of its words in order; slab by slab, so that few are held at once."""
    slab: list[bytes] = []
    size = 0

    def hashed():
        h, starts = word_hashes(b"\n".join(slab))
        cuts = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in slab]))[:-1]
        return np.split(h, cuts)

    for t in texts:
        raw = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        if slab and size + len(raw) > SLAB:
            yield from hashed()
            slab, size = [], 0
        slab.append(raw)
        size += len(raw) + 1
    if slab:
        yield from hashed()


def column_texts(column, rows: int = 256):
    """The texts of an Arrow column, few at a time."""
    for k in range(0, len(column), rows):
        yield from column.slice(k, rows).to_pylist()


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of the word sequences of the given width, in order; with fewer words the whole
    sequence is the only one; without words there is none."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    with np.errstate(over="ignore"):
        h = np.full(n, U(width), U)
        for k in range(width):
            h = (h ^ words[k : k + n]) * STEP
            h ^= h >> U(29)
        return mix(h)


def shingle_set(words: np.ndarray, width: int = 5) -> np.ndarray:
    return np.unique(shingles(words, width))
