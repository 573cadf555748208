"""Quality by compression: how much shorter a text gets under a dictionary of good than of bad labelled text.

Both dictionaries are trained by zstandard on whole labelled texts. A text's score is the difference of its compressed sizes
as a share of its bytes, calibrated by a logistic curve on labelled texts that the dictionaries have not seen.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import P, giving_back, text_of

#: Bound of the fit: labelled documents for each label, each with its whole text.
MOST_LABELLED = 1500
DICTIONARY_BYTES = 112 << 10
#: Bytes of the samples that labelled texts are cut into for training; a dictionary is made of strings far shorter.
SAMPLE_BYTES = 1024
#: Texts are compressed in parts of this many bytes, so that long ones depend on the dictionaries as short ones do.
PART_BYTES = 2048
#: Added to a text's bytes: about what a frame takes besides its content.
FRAME_BYTES = 50
LEVEL = 3
FOLDS = 5


def fold(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode()) % FOLDS


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, float]

    def __post_init__(self):
        self._made = None

    def __getstate__(self):
        return self.__dict__ | {"_made": None}

    def _compressors(self):
        if self._made is None:
            self._made = [
                zstandard.ZstdCompressor(
                    dict_data=zstandard.ZstdCompressionDict(d),
                    compression_params=zstandard.ZstdCompressionParameters.from_level(LEVEL, window_log=20, write_content_size=False, write_checksum=False),
                ) if d else zstandard.ZstdCompressor(level=LEVEL)
                for d in (self.good, self.bad)
            ]
        return self._made

    def difference(self, text: str | None) -> float:
        """Compressed-size difference, bad less good, as a share of the text's bytes."""
        raw = (text or "").encode("utf-8", "replace")
        good, bad = self._compressors()
        gain = 0
        for low in range(0, len(raw), PART_BYTES):
            part = raw[low : low + PART_BYTES]
            gain += len(bad.compress(part)) - len(good.compress(part))
        return gain / (len(raw) + FRAME_BYTES)

    def score(self, text: str | None) -> float:
        slope, base = self.weights
        return float(1.0 / (1.0 + np.exp(-np.clip(slope * self.difference(text) + base, -40, 40))))


def _dictionary(texts: list[str]) -> bytes:
    """Trained on all parts of the texts; where these are too few to train on, the texts themselves."""
    parts = []
    for t in texts:
        raw = t.encode("utf-8", "replace")
        parts += [raw[low : low + SAMPLE_BYTES] for low in range(0, len(raw), SAMPLE_BYTES)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b" ".join(parts)[-DICTIONARY_BYTES:]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method, with a small ridge on the scaled difference."""
    scale = np.array([x.std() or 1.0, 1.0])
    z = np.column_stack([x, np.ones(len(x))]) / scale
    w = np.zeros(2)
    ridge = np.array([1e-2, 1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge)
        step = np.clip(np.linalg.solve(hess, z.T @ (y - p) - ridge * w), -5, 5)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w / scale)


def fit(texts: list[str], labels: list[int]) -> Model:
    """Dictionaries from one half of each label's texts, calibration on the other half, then dictionaries from all.

    With one label only, or none, every score is near that label's share (0.5 without labels).
    """
    y = np.array(labels, int)
    good = [t for t, v in zip(texts, y, strict=True) if v == 1]
    bad = [t for t, v in zip(texts, y, strict=True) if v != 1]
    if len(good) < 2 or len(bad) < 2:
        share = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        return Model(b"", b"", (0.0, float(np.log(share / (1 - share)))))
    x, truth = [], []
    for half in (0, 1):
        model = Model(_dictionary(good[half::2]), _dictionary(bad[half::2]), (0.0, 0.0))
        for held, label in ((good[1 - half :: 2], 1), (bad[1 - half :: 2], 0)):
            x += [model.difference(t) for t in held]
            truth += [label] * len(held)
    return Model(_dictionary(good), _dictionary(bad), _logistic(np.array(x), np.array(truth, float)))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int = MOST_LABELLED) -> tuple[list[str], list[int]]:
    """At most `most` training documents of each label, chosen by a hash of the id, with their whole texts; the same at each run.

    Of several labels of a document the least counts, of several texts of an id the first in order; null ids and labels give none.
    """
    lab = labels.select(F.col(id_col).alias(f"{P}k"), F.col(label_col).cast("int").alias(f"{P}y")).filter(
        F.col(f"{P}k").isNotNull() & F.col(f"{P}y").isin(0, 1) & (F.pmod(F.crc32(F.col(f"{P}k").cast("string")), F.lit(FOLDS)) != 0)
    )
    lab = lab.groupBy(f"{P}k").agg(F.min(f"{P}y").alias(f"{P}y"))
    order = F.xxhash64(F.col(f"{P}k"), F.lit(7))
    picked = [lab.filter(F.col(f"{P}y") == label).orderBy(order, f"{P}k").limit(most) for label in (0, 1)]
    chosen = picked[0].unionByName(picked[1])
    rows = (
        docs.select(F.col(id_col).alias(f"{P}id"), text_of(text_col).alias(f"{P}t"))
        .join(F.broadcast(chosen), F.col(f"{P}id") == F.col(f"{P}k"))
        .groupBy(f"{P}id", f"{P}y")
        .agg(F.min(f"{P}t").alias(f"{P}t"))
        .collect()
    )
    rows = sorted(rows, key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
    return [r[2] for r in rows], [r[1] for r in rows]


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score (double, 0 to 1), which replaces a column of that name. Null and empty texts get the score of an even difference; long ones count whole."""

    @F.pandas_udf("double")
    @giving_back
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([model.score(t) for t in batch], dtype="float64")

    return docs.withColumn(score_col, scored(text_of(text_col)))
