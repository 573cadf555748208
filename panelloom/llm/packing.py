"""Vector bin packing of tokenised documents into sequences, within each partition and without a shuffle.

Sequences are limited in three dimensions at once: tokens, segments (pieces) and loss-bearing tokens. A sequence is
filled by the dot-product heuristic: of the pieces that fit, the one whose demand has the largest dot product with
what is left of the sequence, each dimension as a share of its limit. Where none fits and documents may be cut, the
head of a waiting document fills the rest. Only a partition's last sequences can stay short; with
cut_tail they are cut into lengths that are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import P, giving_back
from .encode import encoder, slices


@dataclass
class Limits:
    tokens: int = 2048
    segments: int = 512
    loss_tokens: int = 2048

    def array(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss_tokens], float)


@dataclass
class _Piece:
    key: object
    ids: np.ndarray
    loss_from: int
    start: int
    end: int

    def loss(self, end: int | None = None) -> int:
        return max(0, (self.end if end is None else end) - max(self.start, self.loss_from))


@dataclass
class Packer:
    """Takes documents one by one and gives closed sequences: lists of pieces."""

    limits: Limits
    waiting: int = 512
    cut_tail: bool = True
    pool: list[_Piece] = field(default_factory=list)

    def add(self, key, ids: np.ndarray, loss_from: int = 0) -> Iterator[list[_Piece]]:
        if not len(ids):
            return
        piece = _Piece(key, ids, loss_from, 0, len(ids))
        while piece.end - piece.start >= self.limits.tokens and (end := self._cut(piece, self.limits.tokens, self.limits.loss_tokens)) == piece.start + self.limits.tokens:
            yield [_Piece(key, ids, loss_from, piece.start, end)]
            piece.start = end
        if piece.start < piece.end:
            self.pool.append(piece)
        if len(self.pool) >= 2 * self.waiting:
            yield from self._fill(self.waiting)

    def close(self) -> Iterator[list[_Piece]]:
        yield from self._fill(0)

    @staticmethod
    def _cut(piece: _Piece, tokens: int, loss: int) -> int:
        """How far the piece may reach under what is left."""
        return min(piece.end, piece.start + tokens, max(piece.start, piece.loss_from) + loss)

    def _fill(self, leave: int) -> Iterator[list[_Piece]]:
        limits = self.limits.array()
        need = np.array([[p.end - p.start, 1, p.loss()] for p in self.pool], float).reshape(-1, 3) / limits
        there = np.ones(len(self.pool), bool)
        n_there = len(self.pool)
        while n_there > leave:
            left, chosen = np.ones(3), []
            while n_there and left[0] * limits[0] > 0.5 and left[1] * limits[1] > 0.5:
                fits = there & (need <= left + 1e-9).all(axis=1)
                if fits.any():
                    at = int(np.argmax(np.where(fits, need @ left, -1.0)))
                    chosen.append(self.pool[at])
                    left = left - need[at]
                    there[at] = False
                    n_there -= 1
                    continue
                at = int(np.argmax(np.where(there, need @ left, -1.0)))
                piece = self.pool[at]
                end = self._cut(piece, round(left[0] * limits[0]), round(left[2] * limits[2]))
                if end <= piece.start:
                    break
                head = _Piece(piece.key, piece.ids, piece.loss_from, piece.start, end)
                chosen.append(head)
                left = left - np.array([head.end - head.start, 1, head.loss()]) / limits
                piece.start = end
                need[at] = np.array([piece.end - piece.start, 1, piece.loss()]) / limits
            yield from self._closed(chosen)
        self.pool = [p for p, t in zip(self.pool, there, strict=True) if t]

    def _closed(self, pieces: list[_Piece]) -> Iterator[list[_Piece]]:
        total = sum(p.end - p.start for p in pieces)
        if not self.cut_tail or total == self.limits.tokens:
            yield pieces
            return
        for bit in reversed(range(total.bit_length())):
            room, out = total & (1 << bit), []
            while room:
                piece = pieces[0]
                end = min(piece.end, piece.start + room)
                out.append(_Piece(piece.key, piece.ids, piece.loss_from, piece.start, end))
                room -= end - piece.start
                piece.start = end
                if piece.start == piece.end:
                    pieces.pop(0)
            if out:
                yield out


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    limits: Limits | None = None,
    with_ids: bool = False,
    prompt_tokens_col: str | None = None,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    A document is its ids and end_id; a null or empty text is end_id alone. Each id lies in exactly one piece. The
    first prompt_tokens_col ids of a document bear no loss, by default none. Repeated rows are packed each on its
    own. sequence_id is unique over the table: the partition's number times 2**32, plus a count. An empty table
    gives no pieces.
    """
    limits = limits or Limits()
    kind = dict(docs.dtypes)[id_col]
    prompts = F.col(prompt_tokens_col) if prompt_tokens_col else F.lit(0)
    rows = docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(f"{P}t"), F.coalesce(prompts.cast("long"), F.lit(0)).alias(f"{P}p"))
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = ", ".join([f"`{id_col}` {kind}", *(f"{n} long" for n in names), *(["ids array<int>"] if with_ids else [])])

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer_path).encode_flat
        packer, keys, values, out_ids = Packer(limits), [], [], []
        number = TaskContext.get().partitionId() << 32
        key_type = None

        def take(sequences):
            nonlocal number
            for pieces in sequences:
                offset = 0
                for p in pieces:
                    ids = p.ids[p.start : p.end]
                    keys.append(p.key)
                    values.append((p.start, len(ids), zlib.crc32(ids.astype("<u4", copy=False)), len(p.ids), number, offset))
                    if with_ids:
                        out_ids.append(ids.astype(np.int32))
                    offset += len(ids)
                number += 1

        def flush():
            columns = np.array(values, np.int64).reshape(-1, len(names)).T
            arrays = [pa.array(keys, key_type), *(pa.array(np.ascontiguousarray(c)) for c in columns)]
            if with_ids:
                arrays.append(pa.array(out_ids, pa.list_(pa.int32())))
            out = pa.RecordBatch.from_arrays(arrays, names=[id_col, *names, *(["ids"] if with_ids else [])])
            for held in (keys, values, out_ids):
                held.clear()
            return out

        for batch in batches:
            key_type, low = batch.schema.field(0).type, 0
            for texts in slices(batch.column(1)):
                own_keys, own_prompts = (batch.column(c).slice(low, len(texts)).to_pylist() for c in (0, 2))
                low += len(texts)
                flat, ends = encode(texts)
                flat = np.insert(flat, ends[1:], np.uint32(end_id))
                # A document that waits holds a copy of its own ids, not those of its whole slice.
                for i, (key, prompt) in enumerate(zip(own_keys, own_prompts, strict=True)):
                    take(packer.add(key, flat[ends[i] + i : ends[i + 1] + i + 1].copy(), int(prompt)))
                yield flush()
        take(packer.close())
        if keys:
            yield flush()

    return rows.mapInArrow(run, schema)
