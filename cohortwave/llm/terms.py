"""Lower-cased terms of whole Arrow batches: runs of digits, letters and of everything beyond ASCII."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import Words, buffers, split_words

# upper case to lower, every other ASCII byte that is neither digit nor letter to a space
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 32


def terms(column: pa.Array) -> tuple[np.ndarray, Words]:
    """The bytes with only A-Z lower-cased, and where the terms stand in them; a null text has none.

    The bytes of a character beyond ASCII all count as term bytes, so byte runs and character runs agree.
    """
    data, offsets = buffers(column)
    data = _PLAIN[data]
    return data, split_words(data, offsets)


def rows_of(words: Words) -> np.ndarray:
    """The row of each term."""
    return np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
