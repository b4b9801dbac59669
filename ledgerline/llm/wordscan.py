"""Words of many texts at once, as arrays."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE, BREAK = 0x20, 0x2E


@dataclass
class Words:
    """Words in order: their bytes, the number of their text, and a number that changes at every break."""

    words: pa.Array
    text: np.ndarray
    piece: np.ndarray

    def __len__(self) -> int:
        return len(self.words)


def scan(texts: Sequence[bytes | None], table: bytes) -> Words:
    """Words are the runs of bytes that ``table`` maps neither to a space nor to a full stop; a full stop and the end of a text break pieces."""
    texts = [t or b"" for t in texts]
    a = np.frombuffer(bytes([BREAK]).join(t.translate(table) for t in texts), dtype=np.uint8)
    word = (a != SPACE) & (a != BREAK)
    edges = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    offsets = np.zeros(len(starts) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(a[word])])
    text_start = np.cumsum([0, *(len(t) + 1 for t in texts)])
    counts = np.diff(np.searchsorted(starts, text_start))
    piece = np.cumsum(a == BREAK, dtype=np.int32)[starts] if len(starts) else np.zeros(0, np.int32)
    return Words(words, np.repeat(np.arange(len(texts)), counts), piece)
