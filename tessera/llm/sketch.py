"""Count-min sketches of values in texts that are never in one place.

Texts move once, into *buckets* of documents of bounded size, where every later step finds them. Buckets emit the cells that their
values hit, a row for each slice of cells; slices, as many as the input needs, are merged on their own and tell each
bucket the *levels* of its cells there: 0 for one hit at most (which isn't told), then one more for each bound that the hits pass. A cell's
count, and so its level, is never below that of any of its values; a value has the least level of its cells.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import mix

BUCKET_BYTES = 8 << 20  # text of a bucket of documents


def bucketed(documents: DataFrame) -> tuple[DataFrame, int, int]:
    """doc_id, id (a long), text and bucket, dealt by bucket; how many partitions; bytes of text."""
    size = int(documents.select(F.sum(F.octet_length("text")).alias("n")).first().n or 0)
    parts = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), size >> 25)
    number = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(2 * parts, size // BUCKET_BYTES))).cast("int")
    return documents.select("doc_id", F.col("doc_id").cast("long").alias("id"), "text", number.alias("bucket")).repartition(parts, "bucket"), parts, size


def log2_cells(values: float, per_value: float = 8) -> int:
    return max(16, math.ceil(math.log2(max(1.0, values * per_value))))


def slice_log2(log2: int) -> int:
    """Cells of a slice: those of some MB of text, and no more slices than a bucket has much to say to."""
    return min(log2, max(22, min(27, log2 - 12)))


def cells(values: np.ndarray, row: int, log2: int) -> np.ndarray:
    return (mix(values + np.uint64(0x51ED270B * (row + 1))) >> np.uint64(64 - log2)).astype(np.int64)


def planes(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers by their byte planes, compressed."""
    return zlib.compress(b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays), 1)


def from_planes(data: bytes, n: int, kinds: list[str]) -> list[np.ndarray]:
    raw, out, at = np.frombuffer(zlib.decompress(data), dtype=np.uint8), [], 0
    for k in kinds:
        size = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(k).ravel())
        at += n * size
    return out


def pack_sorted(x: np.ndarray) -> bytes:
    """Sorted unsigned 32-bit numbers, by their differences' byte planes."""
    return planes(np.diff(x.astype(np.int64), prepend=0).astype("<u4"))


def unpack_sorted(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view("<u4").ravel().astype(np.int64))


def counted(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different cells, sorted, and how often each is hit."""
    c = np.sort(c)
    new = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, dtype=np.int64)
    return c[new], np.diff(new, append=len(c))


HITS = "bucket int, slice long, cells binary, n int, more binary"
TOLD = "bucket int, slice long, cells binary, levels binary"


def _hits(values_of: Callable, rows: int, log2: int, cut: int):
    def run(table: pa.Table) -> pa.Table:
        v, out = values_of(table), []
        bucket = table.column("bucket")[0].as_py() if table.num_rows else 0
        for r in range(rows):
            c, n = counted(cells(v, r, log2))
            there = np.unique(c >> cut)
            for s, a, b in zip(there.tolist(), np.searchsorted(c, there << cut).tolist(), np.searchsorted(c, (there + 1) << cut).tolist()):
                own, hits = c[a:b] - (s << cut), n[a:b]
                more = np.flatnonzero(hits > 1)
                out.append((bucket, r << 48 | s, pack_sorted(own), len(more), planes(own[more].astype("<u4"), hits[more].astype("<u4"))))
        names, kinds = [c.split()[0] for c in HITS.split(", ")], (pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary())
        return pa.table({name: pa.array([x[i] for x in out], kind) for i, (name, kind) in enumerate(zip(names, kinds))})

    return run


def _merged(cut: int, bounds: tuple[int, ...]):
    """Partitions hold whole slices, in order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, count = None, [], np.zeros(1 << cut, dtype=np.int32)
        edges = np.array(bounds)

        def told() -> pd.DataFrame:
            out = []
            for bucket, packed in held:
                own = unpack_sorted(packed)
                level = np.searchsorted(edges, count[own]).astype(np.uint8)
                some = level > 0
                if some.any():
                    out.append((bucket, now, pack_sorted(own[some]), planes(level[some])))
            for _, packed in held:
                count[unpack_sorted(packed)] = 0
            return pd.DataFrame(out, columns=["bucket", "slice", "cells", "levels"])

        for f in frames:
            for bucket, s, packed, n, more in zip(f["bucket"].tolist(), f["slice"].tolist(), f["cells"], f["n"].tolist(), f["more"]):
                if s != now:
                    if held:
                        yield told()
                    now, held = s, []
                held.append((bucket, packed))
                count[unpack_sorted(packed)] += 1
                if n:
                    at, hits = from_planes(more, n, ["<u4", "<u4"])
                    count[at] = np.minimum(count[at] + (hits.astype(np.int64) - 1), 1 << 30)
        if held:
            yield told()

    return run


def levels(moved: DataFrame, parts: int, values_of: Callable, rows: int, log2: int, bounds: tuple[int, ...]) -> DataFrame:
    """TOLD: what each bucket of ``moved`` is told of the cells of ``values_of(table)``, in ``rows`` rows of 2**log2 cells."""
    cut = slice_log2(log2)
    hits = moved.groupBy("bucket").applyInArrow(_hits(values_of, rows, log2, cut), HITS)
    return hits.repartition(parts, "slice").sortWithinPartitions("slice").mapInPandas(_merged(cut, bounds), TOLD)


class Told:
    """The levels that a bucket was told."""

    def __init__(self, table: pa.Table, rows: int, log2: int, cut: int):
        self.log2 = log2
        of = [([np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint8)]) for _ in range(rows)]
        for s, packed, level in sorted(zip(*(table.column(c).to_pylist() for c in ("slice", "cells", "levels")))):
            own = unpack_sorted(packed)
            of[s >> 48][0].append(own + ((s & (1 << 48) - 1) << cut))
            of[s >> 48][1].append(from_planes(level, len(own), ["u1"])[0])
        self.rows = [(np.concatenate(c), np.concatenate(level)) for c, level in of]

    def level_of(self, values: np.ndarray) -> np.ndarray:
        out = np.full(len(values), 255, dtype=np.uint8)
        for r, (own, level) in enumerate(self.rows):
            if not len(own):
                return np.zeros(len(values), dtype=np.uint8)
            c = cells(values, r, self.log2)
            k = np.minimum(np.searchsorted(own, c), len(own) - 1)
            out = np.minimum(out, np.where(own[k] == c, level[k], 0))
        return out
