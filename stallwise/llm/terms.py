"""Terms of whole blocks of texts as integers, found over the blocks' bytes at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .shingles import blocks

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# 0-9, A-Z, a-z and every byte of a character beyond ASCII.
_TERM = np.zeros(256, dtype=bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms(raws: list[bytes]) -> tuple[np.ndarray, pa.BinaryArray, np.ndarray]:
    """The texts' terms in order as places in the array of their distinct terms, that array, and each text's first place (one bound more than texts).

    A term is a run of digits, letters and characters beyond ASCII, with A-Z in lower case.
    """
    data = np.frombuffer(b"\n".join([*raws, b""]), dtype=np.uint8)
    letter = _TERM[data]
    edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    if len(letter) and letter[0]:
        edges = np.concatenate([[0], edges])
    starts, stops = edges[::2], edges[1::2]  # a text ends with a line break, so every run ends
    bounds = np.concatenate([[0], np.searchsorted(starts, np.cumsum([len(x) + 1 for x in raws], dtype=np.int64))])
    offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int32)
    runs = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[letter]])])
    found = runs.dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary, bounds


def text_blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """A task's ``id, text`` rows in blocks of about ``size`` bytes of text: ids, and texts as bytes; a null text is empty, a longer one is a block of its own."""
    held, raws, n = [], [], 0
    for batch in batches:
        for where, block in blocks(batch["text"].to_pylist(), size):
            some = sum(map(len, block))
            if held and n + some > size:
                yield pa.concat_arrays(held), raws
                held, raws, n = [], [], 0
            held.append(batch["id"].slice(where[0], len(where)))
            raws += block
            n += some
    if held:
        yield pa.concat_arrays(held), raws
