"""Quality trimming of derived reads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from strandweave.operators.scans import scan


def quality_trim(seqs: DataFrame, window: int, least: float) -> DataFrame:
    """doc_id, trim_start, trim_end: from the first to the last window whose mean derived quality is high enough; no row if none."""

    def find(s: str) -> Iterator[tuple]:
        q = np.frombuffer(s.translate(str.maketrans("ACGT", "\x0c\x14\x1c\x24")).encode(), np.uint8).astype(np.int64)
        c = np.concatenate([[0], np.cumsum(q)])
        good = np.flatnonzero(c[window:] - c[:-window] >= least * window) if len(q) >= window else []
        if len(good):
            yield int(good[0]), int(good[-1]) + window

    return scan(seqs, "doc_id", "seq", find, "trim_start int, trim_end int")
