"""Two Bloom filters, once seen and twice seen, over 64-bit hashes that all tasks mark.

A task's marks are cut into segments; the parts of a segment are folded with ``twice |= twice' | (once & once')``,
``once |= once'``. Any order of parts gives the same bits, and a hash that occurs twice anywhere always has all its
bits in the folded twice-seen filter (no false negative). The number of bits is fixed, so what is collected and
broadcast is bounded at any input size; a filter that gets too full only lets more through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from anomalytics.llm.common import free_worker

SEGMENTS = 64


def _positions(hashes: np.ndarray, segment_bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The segment of each hash and its two bit positions in that segment."""
    segment = (hashes >> np.uint64(58)).astype(np.int64)
    mask = np.uint64(segment_bits - 1)
    return segment, [(hashes & mask).astype(np.int64), ((hashes >> np.uint64(29)) & mask).astype(np.int64)]


def _pack(positions: np.ndarray, segment_bits: int) -> bytes:
    """Sorted positions while they are shorter than the bitmap, else the bitmap."""
    positions = np.unique(positions)
    if positions.size * 4 < segment_bits // 8:
        return positions.astype("<u4").tobytes()
    bits = np.zeros(segment_bits, dtype=np.uint8)
    bits[positions] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _unpack(data: bytes, segment_bits: int) -> np.ndarray:
    if len(data) == segment_bits // 8:
        return np.frombuffer(data, dtype=np.uint8)
    bits = np.zeros(segment_bits, dtype=np.uint8)
    bits[np.frombuffer(data, dtype="<u4")] = 1
    return np.packbits(bits, bitorder="little")


def marks(hashes: np.ndarray, filter_bits: int):
    """A task's part of each segment (record batches of seg, once, twice) for the hashes that it has seen."""
    segment_bits = filter_bits // SEGMENTS
    if not len(hashes):
        return
    hashes, counts = np.unique(hashes, return_counts=True)
    segment, bits = _positions(hashes, segment_bits)
    cut = np.searchsorted(segment, np.arange(SEGMENTS + 1))            # sorted hashes: segments are in order
    for s in range(SEGMENTS):
        here = slice(cut[s], cut[s + 1])
        if cut[s] < cut[s + 1]:
            again = counts[here] > 1
            yield pa.RecordBatch.from_pydict({
                "seg": pa.array([s], pa.int32()),
                "once": pa.array([_pack(np.concatenate([b[here] for b in bits]), segment_bits)], pa.binary()),
                "twice": pa.array([_pack(np.concatenate([b[here][again] for b in bits]), segment_bits)], pa.binary())})


def fold(rows: DataFrame, mark, filter_bits: int) -> DataFrame:
    """(seg, twice): the folded twice-seen filter of what ``mark`` yields over the batches of ``rows``."""
    segment_bits = filter_bits // SEGMENTS

    def run(batches):
        free_worker()
        once, twice = {}, {}
        for batch in batches:
            for s, o, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                o, t = _unpack(o, segment_bits), _unpack(t, segment_bits)
                if s in once:
                    twice[s] |= t | (once[s] & o)
                    once[s] |= o
                else:
                    once[s], twice[s] = o.copy(), t.copy()
        for s in once:
            yield pa.RecordBatch.from_pydict({"seg": pa.array([s], pa.int32()),
                                              "twice": pa.array([twice[s].tobytes()], pa.binary())})

    return rows.mapInArrow(mark, "seg int, once binary, twice binary").repartition(SEGMENTS, "seg").mapInArrow(
        run, "seg int, twice binary")


def collect_bits(folded: DataFrame, filter_bits: int) -> bytes:
    """The whole filter, ``filter_bits / 8`` bytes."""
    size = filter_bits // SEGMENTS // 8
    bits = bytearray(filter_bits // 8)
    for row in folded.collect():
        bits[row.seg * size:(row.seg + 1) * size] = bytes(row.twice)
    return bytes(bits)


def hits(hashes: np.ndarray, seen: np.ndarray, filter_bits: int) -> np.ndarray:
    """Which hashes may have been seen twice."""
    segment_bits = filter_bits // SEGMENTS
    segment, bits = _positions(hashes, segment_bits)
    hit = np.ones(len(hashes), dtype=bool)
    for b in bits:
        at = segment * segment_bits + b
        hit &= (seen[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return hit
