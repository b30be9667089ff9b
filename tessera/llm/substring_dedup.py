"""Removal of repeated word windows, with a count-min prefilter.

Each window of 13 words is stood for by the smallest hash of its word 6-grams; some windows in a row mostly share one, so they are
a *run*. Texts move once, into buckets of documents, and every later step finds them there. First pass: buckets emit the sketch
cells that their runs hit; slices of cells, as many as the input needs, are merged on their own and tell each bucket which of
its cells were hit twice. Equal windows have equal smallest hashes, so this is never below a window's number of documents, and windows
estimated single are done. No sketch is ever in one place, so the prefilter is as sharp for any input.

Second pass: runs of windows that are left go, as words, to the task of their smallest hash, where equal windows meet. Windows are
grouped by a hash and each is compared with its group's first, word by word. A bucket settles what repeats
within it the same way and sends on one document per window, so the rows of a window grow with buckets and not with copies.

Nulls: a null text has no words; a row with a null doc_id neither removes nor is removed from. Repeated
rows don't remove each other, since their doc_ids are equal, and each keeps its result row. Shorter texts than a window stay whole;
long ones are read whole and need memory of some times their size. Ties: of equal windows the one in the smallest doc_id stays. An
empty table gives an empty result. Columns besides doc_id and text aren't read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from . import sketch
from .shared import ship
from .sketch import from_planes, planes
from .text import Words, ngram_hashes, pieces, text_buffers, within, words_of

WINDOW = 13
GRAM = 6
ROWS = 2  # of the sketch
HOLD = 1 << 19  # windows that are grouped at once in a bucket
COMPARED = 1 << 16  # windows whose words are compared at once


def _smallest(word_hash: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each place, the smallest gram hash of the window that starts there."""
    g = ngram_hashes(word_hash, gram)
    span, have = window - gram + 1, 1
    while have < span:
        step = min(have, span - have)
        g = np.minimum(g[:-step], g[step:]) if len(g) > step else g[:0]
        have += step
    return g


def _runs(doc: np.ndarray, place: np.ndarray, smallest: np.ndarray) -> np.ndarray:
    """First of each run of windows: of one document, at places in a row, with one smallest hash."""
    new = np.ones(len(place), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1) | (smallest[1:] != smallest[:-1])
    return np.flatnonzero(new)


class Parts:
    """A bucket's documents, in an order that its rows' order doesn't change, some bytes at a time: words, smallest hashes, places of windows and their documents."""

    def __init__(self, table: pa.Table, window: int, gram: int):
        self.window, self.gram = window, gram
        ids = table.column("id").fill_null(0).to_numpy()
        buffer, offsets = text_buffers(table.column("text"))
        data = memoryview(np.ascontiguousarray(buffer))
        sums = np.array([zlib.crc32(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], dtype=np.uint32)
        order = np.lexsort((sums, ids))
        self.rows = table.select(["id", "text"]).take(pa.array(order)).combine_chunks()
        self.sums = sums[order]

    def __iter__(self):
        base = 0
        for batch in self.rows.to_batches():
            for part, buffer, offsets in pieces(batch):
                w = words_of(buffer, offsets)
                smallest = _smallest(w.hashes(), self.window, self.gram)
                at = np.flatnonzero(within(w.first, self.window, len(w.start)))
                doc = np.searchsorted(w.first, at, side="right") - 1
                ids = part.column("id")
                known = ids.is_valid().to_numpy(zero_copy_only=False)[doc]
                at, doc = at[known], doc[known]
                yield w, smallest[at], at, doc, ids.fill_null(0).to_numpy()[doc], self.sums[base : base + part.num_rows][doc]
                base += part.num_rows


def _values(window: int, gram: int):
    """The smallest hashes of a bucket's runs."""

    def values(table: pa.Table) -> np.ndarray:
        return np.concatenate([np.zeros(0, dtype=np.uint64), *(smallest[_runs(doc, at, smallest)] for _, smallest, at, doc, _, _ in Parts(table, window, gram))])

    return values


def same_windows(words: Words, at: np.ndarray, window: int) -> np.ndarray:
    """A number for each window of words that starts ``at`` a place, equal exactly where the windows' words are equal."""
    number, unique = pd.factorize(ngram_hashes(words.hashes(), window, 1)[at])
    code = words.codes()[0].astype(np.int32)
    first = np.zeros(len(unique), dtype=np.int64)
    first[number[::-1]] = at[::-1]
    span = np.arange(window)
    for low in range(0, len(at), COMPARED):
        part = slice(low, low + COMPARED)
        if (code[at[part, None] + span] != code[first[number[part], None] + span]).any():
            return np.unique(code[at[:, None] + span], axis=0, return_inverse=True)[1].ravel()
    return number


def _repeated(words: Words, at: np.ndarray, doc_id: np.ndarray, window: int) -> np.ndarray:
    """Windows that also start in a document with a smaller id."""
    number = same_windows(words, at, window)
    least = np.full(int(number.max()) + 1 if len(number) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, number, doc_id)
    return doc_id > least[number]


#: Rows to a task ``key``: runs of windows as words, or (settled) places to remove in documents of a bucket.
SENT = "key int, bucket int, settled boolean, n int, data binary, words binary"
_SENT = [("key", pa.int32()), ("bucket", pa.int32()), ("settled", pa.bool_()), ("n", pa.int32()), ("data", pa.binary()), ("words", pa.binary())]
_RUN = ["<i8", "<u4", "<u4", "<u4"]  # document, check sum of its text, place, windows
_PLACE = ["<i8", "<u4", "<u4"]


def _candidates(log2: int, window: int, gram: int, keys: int):
    cut = sketch.slice_log2(log2)

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        told, bucket = sketch.Told(replies, ROWS, log2, cut), table.column("bucket")[0].as_py() if table.num_rows else 0
        for w, smallest, at, doc, ids, sums in Parts(table, window, gram) if replies.num_rows else ():
            own = told.level_of(smallest) > 0
            smallest, at, doc, ids, sums = (x[own] for x in (smallest, at, doc, ids, sums))
            kept = []
            for low in range(0, len(at), HOLD):
                part = slice(low, low + HOLD)
                gone = _repeated(w, at[part], ids[part], window)
                if gone.any():
                    g = low + np.flatnonzero(gone)
                    rows.append((bucket % keys, bucket, True, len(g), planes(ids[g], sums[g], (at[g] - w.first[doc[g]]).astype("<u4")), None))
                kept.append(low + np.flatnonzero(~gone))
            if not kept:
                continue
            own = np.concatenate(kept)
            smallest, at, doc, ids, sums = (x[own] for x in (smallest, at, doc, ids, sums))
            first = _runs(doc, at, smallest)
            n = np.diff(first, append=len(at))
            to = ((smallest[first] >> np.uint64(32)) * np.uint64(keys) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            first, n, to = first[order], n[order], to[order]
            text = _joined(w, at[first], n + window - 1)
            ends = np.concatenate([[0], np.cumsum([len(x) + 1 for x in text])])
            whole = b"\n".join(text) + b"\n"
            ends_of = np.concatenate([[0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)]])
            for a, b in zip(ends_of[:-1].tolist(), ends_of[1:].tolist()):
                if a < b:
                    f = first[a:b]
                    data = planes(ids[f], sums[f], (at[f] - w.first[doc[f]]).astype("<u4"), n[a:b].astype("<u4"))
                    rows.append((int(to[a]), bucket, False, b - a, data, zlib.compress(whole[ends[a] : ends[b]], 1)))
        return pa.table({k: pa.array([r[i] for r in rows], kind) for i, (k, kind) in enumerate(_SENT)})

    return run


def _joined(w: Words, first: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Some words from each place on, joined by single spaces."""
    data = w.buffer.tobytes()
    return [b" ".join(data[w.start[a] : w.end[a + k - 1]].split()) for a, k in zip(first.tolist(), n.tolist())]


FOUND = "bucket int, n int, data binary"


def _judge(window: int):
    """Partitions hold whole keys, in order: windows that a smaller document has too give places to remove, by bucket of documents."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, found, n_found = None, [], {}, 0

        def judged() -> int:
            """Runs of one key, all of them: equal windows are among them."""
            doc_id, crc, place, n = (np.concatenate(x) for x in zip(*(from_planes(d, k, _RUN) for _, k, d, _ in held)))
            n, bucket = n.astype(np.int64), np.repeat([b for b, _, _, _ in held], [k for _, k, _, _ in held])
            data = b"".join(zlib.decompress(x) for _, _, _, x in held)
            buffer = np.frombuffer(data, dtype=np.uint8)
            w = words_of(buffer, np.concatenate([[0], np.flatnonzero(buffer == 0x0A) + 1]))
            each = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            gone = np.flatnonzero(_repeated(w, w.first[each] + step, doc_id[each], window))
            each, step = each[gone], step[gone].astype("<u4")
            order = np.argsort(bucket[each], kind="stable")
            each, step = each[order], step[order]
            to = bucket[each]
            cut = np.concatenate([[0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)]]) if len(to) else [0]
            for a, b in zip(cut[:-1], cut[1:]):
                e = each[a:b]
                found.setdefault(int(to[a]), []).append((doc_id[e], crc[e], place[e] + step[a:b]))
            return len(gone)

        def out() -> pd.DataFrame:
            rows = []
            for b, own in found.items():
                x = [np.concatenate(y) for y in zip(*own)]
                order = np.lexsort((x[2], x[1], x[0]))
                rows.append((b, len(order), planes(*(y[order] for y in x))))
            return pd.DataFrame(rows, columns=["bucket", "n", "data"])

        for f in frames:
            for key, bucket, settled, n, data, text in zip(f["key"].tolist(), f["bucket"].tolist(), f["settled"].tolist(), f["n"].tolist(), f["data"], f["words"]):
                if key != now:
                    n_found += judged() if held else 0
                    now, held = key, []
                if n_found >= HOLD:
                    yield out()
                    found, n_found = {}, 0
                if settled:
                    found.setdefault(bucket, []).append(tuple(from_planes(data, n, _PLACE)))
                    n_found += n
                else:
                    held.append((bucket, n, data, text))
        if held:
            judged()
        if found:
            yield out()

    return run


def _cut(window: int, with_text: bool):
    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        gone: dict[tuple, list] = {}
        held = [from_planes(d, n, _PLACE) for n, d in zip(found.column("n").to_pylist(), found.column("data").to_pylist())]
        if held:
            doc_id, crc, place = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((crc, doc_id))
            doc_id, crc, place = doc_id[order], crc[order], place[order].astype(np.int64)
            cut = np.concatenate([[0], np.flatnonzero((doc_id[1:] != doc_id[:-1]) | (crc[1:] != crc[:-1])) + 1, [len(place)]]).tolist()
            gone = {(int(doc_id[a]), int(crc[a])): place[a:b] for a, b in zip(cut[:-1], cut[1:])}
        n_words, n_removed, sums, kept_text = [], [], [], []
        for i, text in zip(table.column("id").to_pylist(), table.column("text").to_pylist()):
            data = (text or "").encode()
            words = data.split()
            n_words.append(len(words))
            own = gone.get((i, zlib.crc32(data))) if gone and i is not None else None
            if own is not None:
                delta = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(delta, own, 1)
                np.add.at(delta, own + window, -1)
                words = [words[k] for k in np.flatnonzero(np.cumsum(delta[:-1]) == 0).tolist()]
            n_removed.append(n_words[-1] - len(words))
            joined = b" ".join(words)
            sums.append(hashlib.sha256(joined).hexdigest())
            if with_text:
                kept_text.append(joined.decode())
        out = {"doc_id": table.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(sums, pa.string())}
        return pa.table(out | ({"kept_text": pa.array(kept_text, pa.string())} if with_text else {}))

    return run


def candidates(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame, int]:
    """The documents in their buckets, the runs and settled places that are left of them, and the partitions of both."""
    ship(documents.sparkSession)
    moved, parts, size = sketch.bucketed(documents)
    log2 = sketch.log2_cells(size / 6 * 2 / (window - gram + 2))
    told = sketch.levels(moved, parts, _values(window, gram), ROWS, log2, (1,))
    run = _candidates(log2, window, gram, min(1 << 30, 4 * parts))
    return moved, moved.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(run, SENT), parts


def remove_repeats(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text), one row per row of ``documents``."""
    moved, left, parts = candidates(documents, window, gram)
    found = left.repartition(parts, "key").sortWithinPartitions("key").mapInPandas(_judge(window), FOUND)
    key = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return moved.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(_cut(window, with_text), schema)
