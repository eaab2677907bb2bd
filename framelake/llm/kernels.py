"""Words by Arrow kernels, shared by the operators on hashed n-grams and on ranked search (runs inside Arrow tasks)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What stands between words once A-Z are lower-cased: all of ASCII but 0-9 and a-z.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def arrow_words(column: pa.Array, apart: str = APART) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of a slice of texts, A-Z lower-cased: all words in order, the text each comes from, and how many each text has; null has none."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(column, "")), pattern=apart)
    words, home = pc.list_flatten(lists), pc.list_parent_indices(lists)
    whole = pc.greater(pc.binary_length(words), 0)  # a separator at either end leaves an empty piece
    home = home.filter(whole).to_numpy(zero_copy_only=False).astype(np.int64)
    return words.filter(whole), home, np.bincount(home, minlength=len(column))
