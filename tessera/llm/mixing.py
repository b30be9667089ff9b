"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The documents of a source are dealt by a hash into blocks. A source's target is met by whole
copies of all its blocks, then whole blocks, then one *cut* block of which documents are taken while
they fit. The vector of block quotas by source is split between the two halves of the output
shards by one multivariate-hypergeometric draw, and so on down to single shards, so that quotas
add up exactly at every node. Shards then draw disjoint runs of each source's permuted blocks, and
rows are ordered in a shard by a hash (``shuffle_key``).

Only totals by source and by block (and by part of a cut block) reach the driver: at most ``MAX_BLOCKS`` plus one block a source, and as
many parts of each source's cut block. Sources are the named kinds that a mix has weights for, so there are few.

Nulls: a null text has size 0, a null source is a source of its own (last in the order of weights),
a null doc_id is hashed like any value. Repeated rows are documents of their own: a mix may take some of them and leave
others. Ties in the order of documents are broken by doc_id and size. Long texts count in full; one may be more than what is left of a target, which
the last exchange then comes as near to as whole documents can. An empty table gives an empty mix. Columns besides doc_id, text
and source are carried by ``mixture``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window as W

from .shared import SharedTable, ship

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
MAX_BLOCKS = 16384
BLOCK_ROWS = 500
SEED = 20240817

WORD = r"[^\x20\x09-\x0D]+"


def _size():
    """Words of the text."""
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[float], weights: list[float], most: float = MAX_REPEATS, total: float | None = None) -> list[float]:
    """Shares of ``total`` (the sum of sizes) by weight; what is above ``most`` times a size is shared again among the others."""
    total = float(sum(sizes)) if total is None else float(total)
    out, free, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0 and weights[i] > 0], total
    while free:
        unit = left / sum(weights[i] for i in free)
        full = [i for i in free if unit * weights[i] > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in set(full)]
    return out


def splitting_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Block quotas by shard and source: row sums are even to one block, column sums are the quotas."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def split(low: int, high: int, left: np.ndarray) -> None:
        if high - low == 1:
            out[low] = left
            return
        mid = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        take = int(left.sum()) * (mid - low) // (high - low)
        part = rng.multivariate_hypergeometric(left, take, method="marginals") if take else np.zeros_like(left)
        split(low, mid, part)
        split(mid, high, left - part)

    split(0, shards, np.asarray(quotas, dtype=np.int64))
    return out


@dataclass
class Plan:
    sources: DataFrame  # source, source_size, target
    blocks: DataFrame  # source, block, n_blocks, copies array<struct<epoch, shard>>, cut boolean
    chosen: DataFrame  # doc_key of documents taken from cut blocks
    n_blocks: list[tuple]  # source, number of blocks


def _key(seed: int):
    return F.xxhash64(F.lit(seed), F.coalesce(F.col("source"), F.lit("\0null")), F.col("doc_id"))


def _block(counts: list[tuple]):
    """The block of a row: its hash modulo the number of blocks of its source."""
    n = F.lit(1)
    if counts:
        known = F.create_map(*[F.lit(x) for s, k in counts if s is not None and k > 1 for x in (s, k)]) if any(s is not None and k > 1 for s, k in counts) else None
        null = next((k for s, k in counts if s is None), 1)
        n = F.when(F.col("source").isNull(), F.lit(null)).otherwise(F.coalesce(known[F.col("source")], F.lit(1)) if known is not None else F.lit(1))
    return F.pmod(_key(SEED), n).cast("int")


def plan(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, shards: int = 16, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> tuple[Plan, DataFrame]:
    """The mix of ``documents``, and the table (doc_id, source, size) that it was made from."""
    spark = ship(documents.sparkSession)
    sized = SharedTable(
        documents.select("doc_id", "source", _size().alias("size")), "mix-sizes"
    ).read()
    rows = sorted(sized.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect(), key=lambda r: (r.source is None, r.source or ""))
    names, sizes, counts = [r.source for r in rows], [r.s for r in rows], [r.n for r in rows]
    want = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))])
    all_rows = sum(counts)
    n_blocks = [(s, int(max(1, min(n // block_rows, MAX_BLOCKS * n // all_rows)))) for s, n in zip(names, counts)]
    by_block = sized.withColumn("block", _block(n_blocks)).groupBy("source", "block").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    of: dict = {s: {} for s in names}
    parts: dict = {}
    for r in by_block:
        of[r.source][r.block] = r.s
        parts[r.source, r.block] = int(max(1, min(MAX_BLOCKS, r.n // block_rows)))

    quotas, instances, cuts = [], [], {}
    for i, s in enumerate(names):
        rng = np.random.default_rng([seed, i])
        blocks = [int(b) for b in rng.permutation(sorted(of[s]))]
        whole = int(want[i] // sizes[i]) if sizes[i] else 0
        rest, own = want[i] - whole * sizes[i] if sizes[i] else 0.0, [(e, b, False) for e in range(whole) for b in blocks]
        if rest > 0:
            for b in blocks:
                if of[s][b] <= rest:
                    own.append((whole, b, False))
                    rest -= of[s][b]
                else:
                    own.append((whole, b, True))
                    cuts[s] = (b, rest)
                    break
        instances.append([own[k] for k in rng.permutation(len(own))] if own else [])
        quotas.append(len(own))
    by_shard = splitting_tree(np.array(quotas), shards, seed) if names else np.zeros((shards, 0), dtype=np.int64)
    plans: dict = {}
    for i, s in enumerate(names):
        at = 0
        for shard in range(shards):
            for e, b, cut in instances[i][at : at + int(by_shard[shard, i])]:
                plans.setdefault((s, b), []).append((int(e), int(shard), bool(cut)))
            at += int(by_shard[shard, i])
    schema = "source string, block int, copies array<struct<epoch:int, shard:int, cut:boolean>>"
    blocks = spark.createDataFrame([(s, b, sorted(c)) for (s, b), c in plans.items()], schema)
    sources = spark.createDataFrame([(s, int(z), float(t)) for s, z, t in zip(names, sizes, want)], "source string, source_size long, target double")

    cut = spark.createDataFrame([(s, b, parts[s, b]) for s, (b, _) in cuts.items()], "source string, block int, parts int")
    cut = cut.withColumnsRenamed({"source": "__source", "block": "__block"})
    in_cut = sized.join(F.broadcast(cut), F.col("source").eqNullSafe(F.col("__source")) & (_block(n_blocks) == F.col("__block")))
    order = F.xxhash64(F.lit(seed + 1), "doc_id", "size")
    in_cut = in_cut.groupBy("source", "doc_id", "size", "parts").agg(F.count("*").alias("n"), F.first(order).alias("order"))  # equal rows are one with a count
    in_cut = SharedTable(in_cut.withColumn("part", F.pmod("order", "parts").cast("int")), "mix-cut").read()
    # parts of a cut block are taken whole while they fit; then rows of the next part, as many as have a bounded share of the block
    upto: dict = {}
    for r in sorted(in_cut.groupBy("source", "part").agg(F.sum(F.col("size") * F.col("n")).alias("s")).collect(), key=lambda r: r.part):
        at, left, ended = upto.get(r.source, (-1, cuts[r.source][1], False))
        upto[r.source] = (r.part, left - r.s, False) if not ended and r.s <= left else (at, left, True)
    bound = spark.createDataFrame([(s, at, float(left)) for s, (at, left, _) in upto.items()], "__s string, whole int, left double")
    cut_rows = in_cut.join(F.broadcast(bound), F.col("source").eqNullSafe(F.col("__s")))
    key = ["source", "doc_id", "size"]
    taken = cut_rows.where("part <= whole").select(*key, F.col("n").alias("n_chosen"))
    next_part = cut_rows.where("part > whole").groupBy("source").agg(F.min("part").alias("__next")).withColumnRenamed("source", "__of")
    edge = cut_rows.join(F.broadcast(next_part), F.col("source").eqNullSafe(F.col("__of")) & (F.col("part") == F.col("__next"))).select(*key, "n", "order", "left")
    chosen = edge.groupBy("source").applyInPandas(_fill, T.StructType([*[sized.schema[c] for c in key], T.StructField("n_chosen", T.LongType())]))
    return Plan(sources, blocks, SharedTable(taken.unionByName(chosen), "mix-chosen").read(), n_blocks), sized


def fill(sizes: list[int], room: float, counts: list[int] | None = None) -> list[int]:
    """How often to take each of ``sizes`` (at most as often as ``counts`` has it) to come near ``room``: in order, as many as fit, then the one exchange or addition that comes nearest."""
    counts = [1] * len(sizes) if counts is None else counts
    taken = []
    for size, n in zip(sizes, counts):
        k = n if size == 0 else int(min(n, max(0, room // size)))
        taken.append(k)
        room -= k * size
    rest = sorted((z, i) for i, z in enumerate(sizes) if taken[i] < counts[i])
    if not rest or room <= 0:
        return taken
    bigger = np.array([z for z, _ in rest])
    best, change = room, None
    for i in [None, *{z: i for i, z in enumerate(sizes) if taken[i]}.values()]:  # give one back (or none), take another
        want = room + (0 if i is None else sizes[i])
        at = int(np.searchsorted(bigger, want))
        for k in (at - 1, at):
            if 0 <= k < len(rest) and abs(want - rest[k][0]) < best:
                best, change = abs(want - rest[k][0]), (i, rest[k][1])
    if change:
        if change[0] is not None:
            taken[change[0]] -= 1
        taken[change[1]] += 1
    return taken


def _fill(pdf):
    """What the edge of a cut block gives, in hash order: a bounded share of all rows, equal ones as one with a count."""
    pdf = pdf.sort_values(["order", "size"], kind="stable").reset_index(drop=True)
    out = pdf[["source", "doc_id", "size"]].assign(n_chosen=fill(pdf["size"].tolist(), float(pdf["left"].iloc[0]), pdf["n"].tolist()))
    return out[out.n_chosen > 0]


def dealt(rows: DataFrame, p: Plan, seed: int = SEED) -> DataFrame:
    """``rows`` (with doc_id, source and size) and ``copies``: array<struct<epoch, shard>>, one for each time that the mix takes the row.

    The plan is bounded, so it is broadcast and texts aren't shuffled; only rows of cut blocks
    are joined with the documents chosen there. Of rows with one doc_id, source and size, as many are taken as were chosen.
    """
    names = rows.columns
    with_block = rows.withColumn("__block", _block(p.n_blocks))
    b = p.blocks.select(F.col("source").alias("__source"), F.col("block").alias("__of"), F.col("copies").alias("__copies"))
    joined = with_block.join(F.broadcast(b), F.col("source").eqNullSafe(F.col("__source")) & (F.col("__block") == F.col("__of")), "left")
    has_cut = F.coalesce(F.exists("__copies", lambda c: c["cut"]), F.lit(False))
    plain = joined.where(~has_cut).select(*names, F.coalesce(F.transform("__copies", _epoch_shard), F.array().cast("array<struct<epoch:int,shard:int>>")).alias("copies"))
    c = p.chosen.select(F.col("source").alias("__s"), F.col("doc_id").alias("__d"), F.col("size").alias("__z"), F.col("n_chosen").alias("__n"))
    same = F.col("source").eqNullSafe(F.col("__s")) & F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("size") == F.col("__z"))
    at = F.row_number().over(W.partitionBy("source", "doc_id", "size").orderBy(F.lit(0)))
    cut = joined.where(has_cut).withColumn("__at", at).join(c, same, "left")
    kept = F.filter("__copies", lambda x: ~x["cut"] | (F.col("__at") <= F.coalesce("__n", F.lit(0))))
    return plain.unionByName(cut.select(*names, F.transform(kept, _epoch_shard).alias("copies")))


def _epoch_shard(c):
    return F.struct(c["epoch"].alias("epoch"), c["shard"].alias("shard"))


PLACE = ("mix_epoch", "mix_shard", "mix_order")


def mixture(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, shards: int = 16, seed: int = SEED, with_place: bool = False) -> DataFrame:
    """The mix itself: every column of ``documents``, once for each time a row is taken.

    ``with_place`` adds PLACE (which pass over the source, output shard, order within it); columns of
    the documents with these names are then left out.
    """
    p, _ = plan(documents, weights, shards, seed)
    kept = [c for c in documents.columns if not (with_place and c in PLACE)]
    rows = documents.select("doc_id", "source", _size().alias("size"), F.struct(*kept).alias("__row"))
    out = dealt(rows, p, seed).select("doc_id", "__row", F.inline("copies"))
    order = F.xxhash64(F.lit(seed + 2), "shard", "epoch", "doc_id")
    place = [F.col("epoch").alias(PLACE[0]), F.col("shard").alias(PLACE[1]), order.alias(PLACE[2])] if with_place else []
    return out.select("__row.*", *place)


def write_shards(mixed: DataFrame, path: str) -> None:
    """One folder a shard, rows shuffled locally. mixed: with its place."""
    mixed.repartition(PLACE[1]).sortWithinPartitions(PLACE[1], PLACE[2]).write.partitionBy(PLACE[1]).parquet(path)


def mix_report(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, shards: int = 16, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken, and its copies by epoch and shard."""
    p, sized = plan(documents, weights, shards, seed)
    s = p.sources.withColumnRenamed("source", "__source")
    out = dealt(sized, p, seed).join(F.broadcast(s), F.col("source").eqNullSafe(F.col("__source")), "left")
    return out.select("doc_id", "size", "source_size", "target", (F.size("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies")
