"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Piece lengths lie in 1..capacity, so a histogram of bounded size says everything that the packing
needs: the driver plans on counts, never on documents. It opens a bin with the longest length left,
fills it greedily with the longest that fits, then replaces the bin's smallest document
with two unpacked ones as long as those fill its expanded gap more tightly. A plan's bin
*pattern* stands for as many equal bins as the counts allow, so planning takes a few thousand steps for
any number of documents. Pieces find their bin by their rank among pieces of the same length;
ranks are counted in buckets that grow in number with a length's pieces, so a common length isn't one task.

Nulls: a null text is empty (one piece, the end token); a null doc_id is kept. Long texts are encoded whole and cut only then; a text
of over 200,000 bytes, or with a word of over 4,000, takes the tokenizers library's path instead of the faster one, with equal ids. Ties: of
pieces of one length, the smaller doc_id, piece and checksum comes first within its bucket. Repeated rows are
packed as documents of their own. Empty tables give empty results. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from .shared import SharedTable, ship
from .text import Words, pieces as text_parts, words_of

END = 2
CAPACITY = 1024
MIN_BUCKETS, BUCKET_ROWS = 16, 50_000  # pieces of one length are ranked in so many buckets at least, of so many rows
PART_BYTES = 1 << 20  # text that is encoded at once: a worker needs some hundred bytes for each byte of it

#: How a byte-level tokenizer file writes the 256 bytes: fixed values of the format.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: How such a tokenizer splits a text before merging: fixed value of the format.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Ids of a byte-level BPE tokenizer file, a batch of texts at a time.

    The split pattern never reaches over the start of a run of white space. Where all runs are
    of one character, a text is therefore the sum of its words, each with the character before it; a batch's
    different words (told apart by their bytes) are encoded once, together, and their ids are put in place by array
    operations. tiktoken merges them under the file's own vocabulary, where an id is a merge's
    rank. Other texts are encoded whole; so are those with special tokens in them, and all texts of
    a file where ids aren't ranks, by the tokenizers library itself.
    """

    def __init__(self, content: str):
        self.content = content
        self.fast, self.special = None, ()
        spec = json.loads(content)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges]
        split = spec.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and not spec.get("normalizer")
        if plain and all(vocab.get(m) == 256 + i for i, m in enumerate(joined)):
            import tiktoken

            shown = {chr(b): b for b in _SHOWN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}
            self.special = tuple(t["content"].encode() for t in spec.get("added_tokens", []))
            ranks = {bytes(shown[c] for c in token): i for token, i in vocab.items() if token.encode() not in self.special}
            self.size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
            for token, i in ranks.items():
                self.size[i] = len(token)
            self.fast = tiktoken.Encoding("file", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def exact(self):
        """The tokenizers library's own encoder, loaded where a text needs it: it takes as much memory as the fast one."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.content)

    def text(self, data: bytes) -> np.ndarray:
        if self.fast is not None and len(data) < 200_000 and not any(s in data for s in self.special):
            return self.fast.encode_to_numpy(data.decode())
        return np.array(self.exact.encode(data.decode(), add_special_tokens=False).ids, dtype=np.uint32)

    def _plain(self, w: Words, offsets: np.ndarray) -> np.ndarray:
        """Documents whose runs of white space are all of one ASCII character, between words."""
        b, n = w.buffer, len(offsets) - 1
        doc = w.documents()
        before = np.concatenate([[0], w.end[:-1]])
        low = np.maximum(before, offsets[doc])
        bad = np.zeros(n, dtype=bool)
        bad[doc[w.start - low > 1]] = True
        last = np.where(np.diff(w.first) > 0, w.end[np.maximum(w.first[1:] - 1, 0)] if len(w.end) else 0, offsets[:-1])
        bad |= last != offsets[1:]
        one, two, three = (b[np.maximum(w.end - k, 0)] for k in (1, 2, 3)) if len(w.end) else (b[:0],) * 3
        white = (two == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (three == 0xE2) & ((two == 0x80) | (two == 0x81)) | (three == 0xE1) & (two == 0x9A) | (three == 0xE3) & (two == 0x80)
        bad[doc[white | (w.end - w.start > 4000)]] = True
        return ~bad

    def batch(self, buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and their bounds."""
        n = len(offsets) - 1
        whole = buffer.tobytes()
        if self.fast is None:
            plain = np.zeros(n, dtype=bool)
        else:
            w = words_of(buffer, offsets)
            plain = self._plain(w, offsets)
            for s in self.special:
                at = whole.find(s)
                while at >= 0:
                    plain[np.searchsorted(offsets, at, side="right") - 1] = False
                    at = whole.find(s, at + 1)
        table, sizes, codes, first = [], [], np.zeros(0, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
        others = np.flatnonzero(~plain)
        if plain.any():
            doc = w.documents()
            spaced = plain[doc] & (w.start > offsets[doc])
            use = np.flatnonzero(spaced)
            code, unique = pd.factorize(w.codes()[0][use] * 256 + buffer[w.start[use] - 1])
            at = np.zeros(len(unique), dtype=np.int64)
            at[code[::-1]] = use[::-1]
            size = w.end[at] - w.start[at] + 1
            ends = np.cumsum(size)
            data = buffer[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(w.start[at] - 1 - ends + size, size)].tobytes()
            ids = self.fast.encode_to_numpy(data.decode()) if len(at) else np.zeros(0, dtype=np.uint32)
            stops = np.cumsum(self.size[ids])
            cut = np.searchsorted(stops, ends)
            if len(at) and (cut[-1] >= len(stops) or (stops[cut] != ends).any()):
                own = [self.text(data[b - a : b]) for a, b in zip(size.tolist(), ends.tolist())]
                ids, cut = np.concatenate(own), np.cumsum([len(x) for x in own]) - 1
            table, sizes = [ids], [np.diff(cut + 1, prepend=0)]
            bare = np.flatnonzero(plain[doc] & ~spaced)
            heads = [self.text(whole[a:b]) for a, b in zip(w.start[bare].tolist(), w.end[bare].tolist())]
            all_codes = np.full(len(w.start), -1, dtype=np.int64)
            all_codes[use] = code
            all_codes[bare] = len(unique) + np.arange(len(bare))
            kept = plain[doc]
            codes, owner = all_codes[kept], doc[kept]
            table += heads
            sizes.append(np.array([len(h) for h in heads], dtype=np.int64))
            n_codes = len(unique) + len(bare)
        else:
            owner, n_codes = np.zeros(0, dtype=np.int64), 0
        if len(others):
            rest = [self.text(whole[offsets[d] : offsets[d + 1]]) for d in others.tolist()]
            table += rest
            sizes.append(np.array([len(r) for r in rest], dtype=np.int64))
            codes = np.concatenate([codes, n_codes + np.arange(len(others))])
            owner = np.concatenate([owner, others])
            order = np.argsort(owner, kind="stable")
            codes, owner = codes[order], owner[order]
        flat = np.concatenate(table).astype("<u4") if table else np.zeros(0, dtype="<u4")
        size = np.concatenate(sizes) if sizes else np.zeros(0, dtype=np.int64)
        start = np.cumsum(size) - size
        count = size[codes]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        out = flat[np.arange(total) + np.repeat(start[codes] - ends + count, count)]
        first[1:] = np.cumsum(np.bincount(owner, weights=count, minlength=n)).astype(np.int64)
        return out, first


def _encode(content: Broadcast, capacity: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, stop = Encoder(content.value), np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            for part, buffer, offsets in text_parts(batch, limit=PART_BYTES):
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                flat, first = encoder.batch(buffer, offsets)
                flat, first = flat.tobytes(), first.tolist()
                for d in range(part.num_rows):
                    data = flat[4 * first[d] : 4 * first[d + 1]] + stop
                    n = len(data) // 4
                    at, k = 0, 0
                    while at < n:
                        to = at + ((n - at - 1) % capacity + 1 if k == 0 else capacity)
                        own = data[4 * at : 4 * to]
                        row.append(d), piece.append(k), start.append(at), length.append(to - at), crc.append(zlib.crc32(own))
                        if with_ids:
                            ids.append(own)
                        at, k = to, k + 1
                columns = [part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.record_batch(columns + [pa.array(ids, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    return run


def token_pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids; of a longer document the first piece takes what is over. ``with_ids`` adds the ids as bytes.

    tokenizer: path of the file, which the driver reads and sends to the executors (it has the size of a vocabulary).
    """
    with open(tokenizer, encoding="utf-8") as f:
        content = ship(documents.sparkSession).sparkContext.broadcast(f.read())
    key = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return documents.select("doc_id", "text").mapInArrow(_encode(content, capacity, end, with_ids), schema)


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """counts[n]: pieces of length n. Patterns and how many bins each stands for, using every piece once."""
    left = np.asarray(counts, dtype=np.int64).copy()
    out = []
    places = np.arange(capacity + 1)
    while left.any():
        free = left.copy()
        pattern: list[int] = []
        gap = capacity
        while gap:
            fit = np.flatnonzero(free[1 : gap + 1])
            if not len(fit):
                break
            n = int(fit[-1]) + 1
            pattern.append(n)
            free[n] -= 1
            gap -= n
        while gap and len(pattern) > 1:
            small = min(pattern)
            room = gap + small
            best = np.maximum.accumulate(np.where(free > 0, places, 0))
            a = np.flatnonzero(free[: room + 1])
            a = a[a > 0]
            b = best[room - a]
            same = (a == b) & (free[a] < 2)
            b = np.where(same, best[np.maximum(a - 1, 0)], b)
            total = np.where(b > 0, a + b, 0)
            if not len(total) or total.max() <= small:
                break
            k = int(total.argmax())
            pattern.remove(small)
            pattern += [int(a[k]), int(b[k])]
            free[small] += 1
            free[a[k]] -= 1
            free[b[k]] -= 1
            gap = room - int(total[k])
        need = np.bincount(pattern, minlength=capacity + 1)
        used = need > 0
        times = int((left[used] // need[used]).min())
        left -= times * need
        out.append((sorted(pattern, reverse=True), times))
    return out


def _slots(plan: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length, first rank), and the first bin and the offset of each."""
    rows, seen, first = [], {}, 0
    for pattern, times in plan:
        at = 0
        for n in pattern:
            rank = seen.get(n, 0)
            rows.append(((n << 44) | rank, first, at))
            seen[n] = rank + times
            at += n
        first += times
    rows.sort()
    return tuple(np.array([r[i] for r in rows], dtype=np.int64) for i in range(3))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a written table with doc_id, piece, start, length, ids_crc32) and their sequence_id and offset."""
    lengths = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for n, k in lengths.items():
        counts[n] = k
    keys, bins, offsets = _slots(best_two_fit(counts, capacity))
    buckets = F.element_at(F.array(*[F.lit(max(MIN_BUCKETS, int(k) // BUCKET_ROWS)) for k in counts.tolist()]), F.col("length").cast("int") + 1)
    dealt = pieces.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), buckets))
    before = W.partitionBy("length").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    base = dealt.groupBy("length", "__bucket").count().withColumn("__base", F.coalesce(F.sum("count").over(before), F.lit(0)))
    base = base.select(F.col("length").alias("__length"), F.col("__bucket").alias("__of"), "__base")
    own = F.row_number().over(W.partitionBy("length", "__bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("__row", own).join(base, (F.col("length") == F.col("__length")) & (F.col("__bucket") == F.col("__of")))
    ranked = ranked.select(*pieces.columns, (F.col("__base") + F.col("__row")).alias("rank"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            key = (f["length"].to_numpy(dtype=np.int64) << 44) | f["rank"].to_numpy(dtype=np.int64)
            at = np.searchsorted(keys, key, side="right") - 1
            yield f.drop(columns="rank").assign(sequence_id=bins[at] + key - keys[at], offset=offsets[at])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInPandas(place, schema)


def pack_documents(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    return pack(SharedTable(token_pieces(documents, tokenizer, capacity), "pieces").read(), capacity)


def sequences(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, ids (bytes of little-endian unsigned 32-bit ids)."""
    placed = pack(SharedTable(token_pieces(documents, tokenizer, capacity, with_ids=True), "pieces").read(), capacity)
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids", "length")))
    return placed.groupBy("sequence_id").agg(ordered.alias("x")).select(
        "sequence_id", F.aggregate("x", F.lit(0).cast("long"), lambda a, r: a + r["length"]).alias("n_tokens"),
        F.aggregate("x", F.lit(b"").cast("binary"), lambda a, r: F.concat(a, r["ids"])).alias("ids"),
    )
