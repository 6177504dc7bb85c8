"""Word hashes of whole batches of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import WORD_BYTES, batch_bytes, hash_spans, spans


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and each word's text number."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    # a separator after each text keeps a word from running on into the next
    raw, offs = batch_bytes(pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())))
    starts, ends, row = spans(raw, offs, WORD_BYTES)
    return hash_spans(raw, starts, ends), row
