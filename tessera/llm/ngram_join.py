"""Self-join of documents by the Jaccard similarity of their word n-gram sets, size-aware.

A sketch tells each shingle's level: one document's alone at most, light, heavy, heaviest. What stands in one document alone can't be
shared, so a set is its *core*, the other shingles, with its declared size n; cores that are too small to link with
anything end here. Documents of equal core and size are one *class*: all of them link or none does, and with other documents
all do or none does.

A set of size n can only reach the threshold with another if they share ceil(0.85 n) shingles, so in any order of shingles the first
two shared ones stand in its first n - ceil(0.85 n) + 2 places (the *prefix*). The order is by level, rare ones first. Small sets
publish 2-subsets of that prefix as keys; large sets, and small ones that can still meet a large one, publish its shingles as
inverted lists. The boundary between small and large is the one with the least cost by the histogram of text sizes.
Keys hold a light shingle, so the sketch bounds their lists. Two sets that share heavy shingles only
link just by those, whatever else they hold: sets whose heavy part alone is large enough are also classes by that part and n, and
the classes publish their heavy shingles. Boilerplate thus makes no lists of documents, but of different heavy parts.

In a list, sets are compared by parity bitmaps, whose Hamming distance never exceeds the symmetric difference, so no pair
that links is passed over; a list yields a spanning forest of the pairs that may link, at most one edge a set. A list of heavy parts
above a bounded length isn't compared: its sets are taken together as they are, one edge a set.
What these connect is a *group* of candidates. A group's sets then move once and are verified
where they meet, pair by pair, but only while a pair isn't yet known to be connected, so that copies
yield a spanning forest of verified links and never their pairs. A group above a bounded size is cut into
blocks, each of which also gets a few common sets (*hubs*); only if that leaves it in more than one component
are the sets outside its largest component compared with all blocks. So a group costs time with the square of the sets that no hub reaches,
and rows with their product by the blocks.

Nulls: a null text has no words; texts without words have n_shingles 0 and are linked with nothing. A
text with fewer words than n is one shingle. Whole texts of any length are read, and hold memory of some times their size. Ties:
a similarity of exactly the threshold links. Rows that share a doc_id count as one document when
links are followed; each keeps its row. A null doc_id takes no part and is its own component (null). An
empty table gives an empty result. Columns besides doc_id and text aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import sketch
from .components import components
from .shared import SharedTable, ship
from .text import mix, ngram_hashes, pieces, within, words_of

SUBSET = 2
SCAN_COST = 3.0  # entries read in an inverted list for each one published
LIST_BLOCK = 256  # sets of one list that are compared by bitmaps; a longer list is a group as it is
BLOCK, BLOCK_BYTES = 256, 8 << 20  # sets, and bytes of sets, of one block of a group
HUBS = 16
BROADCAST_NODES = 500_000  # sets in groups up to which their numbers (24 bytes each) are broadcast
SHORT_BITS, LONG_BITS, SHORT_SIZE = 512, 2048, 1024  # bitmaps in lists: for sets up to a size, and for larger ones
MIN_BITS, MAX_BITS = 512, 1 << 16
LEVELS = (1, 64, 4096)  # hits above which a shingle isn't one document's alone, is heavy, is the heaviest
HEAVY = 2  # level from which a shingle is heavy


@dataclass(frozen=True)
class Threshold:
    """100 * intersection >= percent * union."""

    percent: int = 85

    def shared(self, n):
        """Shingles that a set of n has to share at least."""
        return (self.percent * n + 99) // 100

    def prefix(self, n, subset: int = 1):
        return n - self.shared(n) + subset

    def differ(self, held, total):
        """100 + percent times the largest symmetric difference of two sets that hold ``held`` shingles and are of ``total`` together."""
        return (100 + self.percent) * held - 2 * self.percent * total

    def links(self, shared, total):
        return 100 * shared >= self.percent * (total - shared)


def boundary(histogram: dict[int, int], t: Threshold, scan: float = SCAN_COST) -> int:
    """The set size up to which enumerating subsets costs less than scanning lists. histogram: sets by size."""
    sizes = np.array(sorted(histogram), dtype=np.int64)
    count = np.array([histogram[s] for s in sizes.tolist()], dtype=float)
    p = t.prefix(sizes, SUBSET)
    subsets, lists = count * p * (p - 1) / 2, count * (p - 1) * scan
    best, least = 0, lists.sum()
    for b in range(7, 513):
        cost = subsets[sizes <= b].sum() + lists[sizes >= t.shared(b + 1)].sum()
        if cost < least:
            best, least = b, cost
    return best


def shingle_sets(buffer: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingles, document by document (with repeats), and their bounds."""
    w = words_of(buffer, offsets)
    word = w.hashes(lower=True)
    count = np.diff(w.first)
    m = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(m)])
    out = np.zeros(int(first[-1]), dtype=np.uint64)
    full = np.repeat(count >= n, m)
    out[full] = ngram_hashes(word, n)[within(w.first, n, len(word))] if full.any() else 0
    for d in np.flatnonzero((count > 0) & (count < n)):
        own = word[w.first[d] : w.first[d + 1]]
        out[first[d]] = ngram_hashes(own, len(own), 7)[0]
    return out, first


def _values(n: int):
    """All shingles of a bucket's documents."""

    def values(table: pa.Table) -> np.ndarray:
        parts = (shingle_sets(buffer, offsets, n)[0] for batch in table.combine_chunks().to_batches() for _, buffer, offsets in pieces(batch))
        return np.concatenate([np.zeros(0, dtype=np.uint64), *parts])

    return values


def _bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    out = np.empty((len(sets), bits // 64), dtype=np.uint64)
    for i, x in enumerate(sets):
        at = (mix(x ^ np.uint64(0xA5A5)) & np.uint64(bits - 1)).astype(np.int64)
        out[i] = np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.uint64)
    return out


def keys_of(s: np.ndarray, level: np.ndarray, t: Threshold, small: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that a set publishes, and those of its heavy part. s: sorted shingles; level: of each, 0 if no other document can have it."""
    n, none = len(s), s[:0]
    if t.shared(n) == n and 100 * n < t.percent * (n + 1):
        return none, none  # links with equal sets only
    order = np.argsort(level, kind="stable")
    out = []
    if n <= small:
        own = order[: t.prefix(n, SUBSET)]
        own = own[level[own] > 0]
        i, j = np.triu_indices(len(own), 1)
        some = level[own[i]] < HEAVY  # i stands before j in the order: if that one is heavy, both are
        x, y = s[own[i[some]]], s[own[j[some]]]
        out.append(mix(np.minimum(x, y) * np.uint64(0x9E3779B97F4A7C15) + np.maximum(x, y)))
    if n >= t.shared(small + 1):
        own = order[: t.prefix(n)]
        out.append(s[own[(level[own] > 0) & (level[own] < HEAVY)]])
    heavy = order[level[order] >= HEAVY]
    most = len(heavy) - t.shared(n) + 1
    return (np.concatenate(out) if out else none), mix(s[heavy[: max(0, most)]] ^ np.uint64(0x5DEECE66D))


def _signature(s: np.ndarray, n: int, kind: int) -> bytes:
    """128 bits of a set, its declared size, and whether it is a core (0) or a heavy part (1)."""
    last = np.array([2 * n + kind], dtype=np.uint64)
    one = mix(s ^ np.uint64(0x1234567)).sum(dtype=np.uint64, keepdims=True) + mix(last ^ np.uint64(0xBADC0FFEE))
    two = mix(s ^ np.uint64(0x89ABCDEF)).sum(dtype=np.uint64, keepdims=True) + mix(last ^ np.uint64(0xFEEDFACE))
    return one.tobytes() + two.tobytes()


def _packed(s: np.ndarray) -> bytes:
    """A sorted set, by the byte planes of its differences: the higher ones are mostly zero."""
    return sketch.planes(np.diff(s, prepend=s.dtype.type(0)).astype("<u8"))


def _unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view("<u8").ravel(), dtype=np.uint64)


#: Rows of documents (node null) and of sets (node not null: the signature of a core or a heavy part).
PROFILE = "doc_id long, n long, sig binary, core long, heavy_sig binary, heavy long, node binary, by_heavy boolean, keys array<long>, shingles binary, head binary"
_TYPES = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.bool_(), pa.list_(pa.int64()), pa.binary(), pa.binary())
_NAMES = [c.split()[0] for c in PROFILE.split(", ")]


def _profiles(log2: int, n: int, t: Threshold, small: int):
    cut = sketch.slice_log2(log2)

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        told, published, rows = sketch.Told(replies, 1, log2, cut), set(), []
        for batch in table.combine_chunks().to_batches():
            for part, buffer, offsets in pieces(batch):
                values, first = shingle_sets(buffer, offsets, n)
                levels = told.level_of(values)
                for doc_id, a, b in zip(part.column("id").to_pylist(), first[:-1].tolist(), first[1:].tolist()):
                    s, at = np.unique(values[a:b], return_index=True)
                    level = levels[a:b][at]
                    size, sig, core, heavy_sig, heavy = len(s), None, None, None, None
                    own = s[level > 0]
                    if size and doc_id is not None and 100 * len(own) >= t.percent * size:
                        keys, heavy_keys = keys_of(s, level, t, small)
                        sig, core = _signature(own, size, 0), len(own)
                        sets = [(sig, own, keys)]
                        if len(heavy_keys):
                            rare = s[level >= HEAVY]
                            heavy_sig, heavy = _signature(rare, size, 1), len(rare)
                            sets.append((heavy_sig, rare, heavy_keys))
                        for node, x, k in sets:
                            if len(k) and node not in published:
                                published.add(node)
                                head = node + np.array([size, len(x)], dtype="<i8").tobytes() + _bitmaps([x], SHORT_BITS if size <= SHORT_SIZE else LONG_BITS).tobytes()
                                rows.append((None, size, None, None, None, None, node, node == heavy_sig, k.view(np.int64), _packed(x), head))
                    rows.append((doc_id, size, sig, core, heavy_sig, heavy, None, None, None, None, None))
        return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(zip(_NAMES, _TYPES))})

    return run


def forest(n: np.ndarray, held: np.ndarray, maps: np.ndarray, t: Threshold) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that may link: none that does link is in two of its trees. n: declared sizes; held: shingles in the sets."""
    left, out = np.arange(len(n)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            m = n[left]
            at = left[100 * np.minimum(m, n[i]) >= t.percent * np.maximum(m, n[i])]
            far = np.bitwise_count(maps[at] ^ maps[i]).sum(axis=1, dtype=np.int64)
            found = at[(100 + t.percent) * far <= t.differ(held[at] + held[i], n[at] + n[i])]
            if len(found):
                out += [(i, int(j)) for j in found]
                queue += found.tolist()
                left = np.setdiff1d(left, found, assume_unique=True)
    return out


def _fold(maps: list[bytes], short: bool) -> np.ndarray:
    rows = [np.frombuffer(m, dtype=np.uint64) for m in maps]
    if short:  # a position modulo the shorter length is that of the longer one, folded
        rows = [r if len(r) * 64 == SHORT_BITS else np.bitwise_xor.reduce(r.reshape(-1, SHORT_BITS // 64), axis=0) for r in rows]
    return np.stack(rows)


def _runs(frames: Iterator[pd.DataFrame], by: list[str], columns: list[str]) -> Iterator[list[tuple]]:
    """Rows of a partition that is sorted by ``by``, one list for each value of it."""
    now, held = None, []
    for f in frames:
        for key, row in zip(zip(*(f[c].tolist() for c in by)), zip(*(f[c].tolist() for c in columns))):
            if key != now:
                if held:
                    yield held
                now, held = key, []
            held.append(row)
    if held:
        yield held


def _maybe(t: Threshold):
    """Partitions hold whole lists, in order of their keys. A head: node, declared size and shingles held, bitmap."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: set[tuple[bytes, bytes]] = set()
        out: list[tuple[bytes, bytes]] = []
        for held in _runs(frames, ["key"], ["head"]):
            if len(held) > 1:
                node, size = [h[:16] for (h,) in held], np.frombuffer(b"".join(h[16:32] for (h,) in held), dtype="<i8").reshape(-1, 2)
                order = sorted(range(len(held)), key=lambda i: (size[i, 0], node[i]))
                n, maps = size[order, 0], _fold([held[i][0][32:] for i in order], bool(size[order[0], 0] <= SHORT_SIZE))
                for i, j in forest(n, size[order, 1], maps, t):
                    pair = (node[order[i]], node[order[j]])
                    if pair not in done:
                        if len(done) > 500_000:
                            done.clear()
                        done.add(pair)
                        out.append(pair)
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["u", "v"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["u", "v"])

    return run


def links_within(sets: list[np.ndarray], n: np.ndarray, known: np.ndarray, t: Threshold, own: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Verified links that connect what is connected; sets with equal ``known`` are connected already. With ``own``, only pairs of which one is such."""
    held = np.array([len(x) for x in sets], dtype=np.int64)
    order = np.argsort(n, kind="stable")
    n, held, sets = n[order], held[order], [sets[i] for i in order]
    label = pd.factorize(known)[0][order]
    own = np.ones(len(sets), dtype=bool) if own is None else own[order]
    maps = None
    if len(sets) > 4:
        maps = _bitmaps(sets, int(min(MAX_BITS, max(MIN_BITS, 1 << int(4 * held.max()).bit_length()))))
    high = np.searchsorted(100 * n, 10000 * n // t.percent, side="right")  # larger sets can't link
    out = []
    for i in range(len(sets) - 1):
        rest = slice(i + 1, high[i])
        at = i + 1 + np.flatnonzero((label[rest] != label[i]) & (own[rest] | own[i]))
        if maps is not None and len(at):
            far = np.bitwise_count(maps[at] ^ maps[i]).sum(axis=1, dtype=np.int64)
            at = at[(100 + t.percent) * far <= t.differ(held[at] + held[i], n[at] + n[i])]
        for j in at.tolist():
            if label[j] == label[i]:
                continue
            both = np.concatenate([sets[i], sets[j]])
            both.sort()
            if t.links(int((both[1:] == both[:-1]).sum()), n[i] + n[j]):
                out.append((int(order[i]), int(order[j])))
                label[label == label[j]] = label[i]
    return out


def _compared(t: Threshold):
    """Partitions hold whole tasks (grp, block), in order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for held in _runs(frames, ["grp", "block"], ["node", "n", "known", "own", "shingles"]):
            if len(held) > 1:
                node, n, known, own, data = zip(*held)
                found = links_within([_unpacked(x) for x in data], np.array(n, dtype=np.int64), np.array(known, dtype=object), t, np.array(own, dtype=bool))
                if found:
                    yield pd.DataFrame([(node[i], node[j]) for i, j in found], columns=["u", "v"])

    return run


class NgramJoin:
    """The join of one table. ``links``: (u, v), verified, of classes, that connect what is connected; ``classes``: (sig, component_id) of classes that aren't alone."""

    def __init__(self, documents: DataFrame, n: int = 4, threshold: Threshold = Threshold(), block: int = BLOCK, list_block: int = LIST_BLOCK):
        self.spark, self.t, self.block, self.list_block = ship(documents.sparkSession), threshold, block, list_block
        rows = documents.select("doc_id", "text")
        bytes_ = F.coalesce(F.octet_length("text"), F.lit(0))
        sizes = rows.groupBy(F.least(F.floor(bytes_ / 6), F.lit(1024)).cast("long").alias("n")).agg(F.count("*").alias("c")).collect()
        moved, self.parts, total = sketch.bucketed(rows)
        self.small = boundary({max(1, r.n): r.c for r in sizes}, threshold) if sizes and threshold.percent > 50 else 0  # else two shared shingles aren't sure
        log2 = sketch.log2_cells(total / 6)
        told = sketch.levels(moved, self.parts, _values(n), 1, log2, LEVELS)
        made = moved.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(_profiles(log2, n, threshold, self.small), PROFILE)
        self.profiles = SharedTable(made, "profiles").read()
        self.rows = self.profiles.where("node IS NULL")
        self.sets = self.profiles.where("node IS NOT NULL")
        known = self.rows.where("sig IS NOT NULL")
        by_class = known.groupBy("sig", "n", "core", "heavy_sig", "heavy").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"))
        self.reps = SharedTable(by_class, "classes").read()
        self.links = self._links(self._groups())
        self.classes = SharedTable(self._labelled(), "components").read()

    def _all_link(self, held: str) -> Column:
        """Whether sets that share ``held`` shingles and no other, of one declared size, link with each other."""
        return F.lit(100) * F.col(held) >= F.lit(self.t.percent) * (2 * F.col("n") - F.col(held))

    def _labelled(self) -> DataFrame:
        """sig, component_id of the classes whose documents are linked with any other."""
        met = self.links.select(F.col("u").alias("node")).unionByName(self.links.select(F.col("v").alias("node"))).distinct()
        parts = self.reps.where("heavy_sig IS NOT NULL")
        live = parts.where(self._all_link("heavy")).unionByName(parts.where(~self._all_link("heavy")).join(met, parts["heavy_sig"] == met["node"], "left_semi"))
        found = components(self.links.unionByName(live.select(F.col("sig").alias("u"), F.col("heavy_sig").alias("v"))))
        label = self.reps.join(found, self.reps["sig"] == found["node"], "left")
        label = label.where(F.col("component").isNotNull() | ((F.col("rows") > 1) & self._all_link("core"))).select("sig", "rep", F.coalesce("component", "sig").alias("component"))
        least = label.groupBy("component").agg(F.min("rep").alias("component_id"))
        return label.join(least, "component").select("sig", "component_id")

    def _groups(self) -> DataFrame:
        """node, grp: sets that pairs which may link connect. A group's number is a hash: two groups that shared one would be compared, and no more."""
        heads = SharedTable(self.sets.groupBy("node").agg(*[F.first(c).alias(c) for c in ("by_heavy", "keys", "head")]), "heads").read()
        light = heads.where("NOT by_heavy").select(F.explode("keys").alias("key"), "head")  # lists of bounded length
        heavy = heads.where("by_heavy").select("node", F.explode("keys").alias("key"), "head")
        count = SharedTable(heavy.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("least")).where(F.col("c") > self.list_block), "lengths").read()
        dealt = light.unionByName(heavy.join(count, "key", "left_anti").select("key", "head")).repartition(self.parts, "key").sortWithinPartitions("key")
        pairs = dealt.mapInPandas(_maybe(self.t), "u binary, v binary")
        long = heavy.join(count, "key").where("node != least").select(F.col("node").alias("u"), F.col("least").alias("v"))
        return SharedTable(components(pairs.unionByName(long)).select("node", F.xxhash64("component").alias("grp")), "groups").read()

    def _compare(self, rows: DataFrame, name: str) -> DataFrame:
        """rows: grp, block, node, n, known, own, shingles."""
        dealt = rows.repartition(self.parts, "grp", "block").sortWithinPartitions("grp", "block")
        return SharedTable(dealt.mapInPandas(_compared(self.t), "u binary, v binary").distinct(), name).read()

    def _links(self, groups: DataFrame) -> DataFrame:
        first = [F.first(c).alias(c) for c in ("grp", "n", "shingles")]
        few = F.broadcast(groups) if groups.count() <= BROADCAST_NODES else groups  # else both sides are dealt by node
        sets = SharedTable(self.sets.select("node", "n", "shingles").join(few, "node").groupBy("node").agg(*first), "sets").read()
        hashed = [F.min(F.struct(F.xxhash64(F.lit(k), "node").alias("h"), "node")).alias(f"h{k}") for k in range(HUBS)]
        size = sets.groupBy("grp").agg(F.count("*").alias("c"), F.sum(F.octet_length("shingles")).alias("b"), *hashed)
        blocks = F.ceil(F.greatest(F.col("c") / self.block, F.col("b") / BLOCK_BYTES)).cast("int")
        hubs = F.array_distinct(F.array(*[F.col(f"h{k}.node") for k in range(HUBS)]))
        cut = SharedTable(size.select("grp", blocks.alias("blocks"), hubs.alias("hubs")).where("blocks > 1"), "blocks").read()
        own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        task = ["grp", "block", "node", "n", F.col("node").alias("known"), F.lit(True).alias("own"), "shingles"]
        inside = sets.join(cut.select("grp", "blocks"), "grp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", own).select(*task)
        hub = sets.join(cut.select(F.explode("hubs").alias("node"), "blocks"), "node").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where(F.col("block") != own).select(*task)
        links = self._compare(inside.unionByName(hub), "links")
        if cut.isEmpty():
            return links
        found = components(links)
        label = sets.select("node", "grp").join(cut.select("grp", "blocks"), "grp").join(found, "node", "left").select("node", "grp", "blocks", F.coalesce("component", "node").alias("known"))
        label = SharedTable(label, "known").read()
        main = label.groupBy("grp", "known").count().groupBy("grp").agg(F.max_by("known", F.struct("count", "known")).alias("main"), F.count("*").alias("trees")).where("trees > 1")
        rest = sets.select("node", "n", "shingles").join(label.join(main.select("grp", "main"), "grp"), "node").withColumn("at", own).withColumn("own", F.col("known") != F.col("main"))
        block = F.explode(F.when(F.col("own"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("at")))
        return links.unionByName(self._compare(rest.withColumn("block", block).select("grp", "block", "node", "n", "known", "own", "shingles"), "more"))

    def documents(self) -> DataFrame:
        """doc_id, n_shingles, component_id: one row per document. Documents alone in their class stay out of the join."""
        out = self.rows.select("doc_id", "n", "sig").join(self.classes, "sig", "left")
        out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
        several = out.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("u"), F.max("component_id").alias("v")).where("u != v").select("doc_id")
        several = SharedTable(several, "several").read()
        if several.isEmpty():
            return out
        # rows that share a doc_id join the components that they are in
        of = out.join(several, "doc_id", "left_semi").select("doc_id", F.col("component_id").alias("v")).distinct()
        least = of.groupBy("doc_id").agg(F.min("v").alias("u"))
        joined = components(of.join(least, "doc_id").select("u", "v")).withColumnRenamed("component", "joined")
        return out.join(joined, out["component_id"] == joined["node"], "left").select("doc_id", "n_shingles", F.coalesce("joined", "component_id").alias("component_id"))


def near_duplicates(documents: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    return NgramJoin(documents, n, Threshold(percent)).documents()


def deduplicate(documents: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """One document of each component stays (its smallest doc_id), with all columns."""
    gone = near_duplicates(documents, n, percent).where("doc_id != component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return documents.join(gone, documents["doc_id"] == gone["__gone"], "left_anti")
