"""64-bit hashes of words and word shingles, computed over whole blocks of bytes at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import mix, numbers

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = numbers(11, 256)
_PLACE = numbers(13, 64)
_BLOCK = numbers(17, 1)[0] | np.uint64(1)
_TURN = numbers(19, 64)


def blocks(texts: list[str | None], size: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts as UTF-8 in blocks of about ``size`` bytes; a longer text is a block of its own."""
    where, block, n = [], [], 0
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass") if t else b""
        if block and n + len(raw) > size:
            yield where, block
            where, block, n = [], [], 0
        where.append(i)
        block.append(raw)
        n += len(raw)
    if block:
        yield where, block


def word_hashes(block: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of the texts in order, and where each text's words start (one bound more than texts).

    Words are runs of other than white space, with A-Z in lower case.  A hash is a sum
    of products over the word's bytes and places, mixed.
    """
    data = np.frombuffer(b" ".join([*block, b""]), dtype=np.uint8)
    ends = np.cumsum([len(x) + 1 for x in block])
    letter = ~_SPACE[data]
    edge = np.diff(letter.astype(np.int8), prepend=0, append=0)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bounds = np.concatenate([[0], np.searchsorted(starts, ends)])
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), bounds
    lengths = stops - starts
    at = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum(), dtype=np.int64) - np.repeat(at, lengths)
    term = _BYTE[_LOWER[data[letter]]] * _PLACE[place & 63]
    far = place >= 64
    if far.any():  # places of long words: another factor for each 64
        term[far] = mix(term[far] + (place[far] >> 6).astype(np.uint64) * _BLOCK)
    return mix(np.add.reduceat(term, at) + lengths.astype(np.uint64)), bounds


def shingle_sets(texts: list[str | None], width: int = 5, size: int = 1 << 19) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted distinct shingle hashes) of every text.

    A text with fewer words than ``width`` has its whole sequence as one shingle; one
    without words has none.
    """
    with np.errstate(over="ignore"):
        for where, block in blocks(texts, size):
            words, bounds = word_hashes(block)
            n = len(words)
            if n >= width:
                grams = np.zeros(n - width + 1, dtype=np.uint64)
                for k in range(width):
                    grams += words[k : n - width + 1 + k] * _TURN[k]
                grams = mix(grams)
            for k, i in enumerate(where):
                a, b = int(bounds[k]), int(bounds[k + 1])
                if b - a >= width:
                    yield i, np.unique(grams[a : b - width + 1])
                elif b > a:
                    yield i, mix(np.array([(words[a:b] * _TURN[8 : 8 + b - a]).sum() + np.uint64(b - a)], dtype=np.uint64))
                else:
                    yield i, np.zeros(0, dtype=np.uint64)
