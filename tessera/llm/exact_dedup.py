"""Exact deduplication by content-defined chunk recipes.

A text is normalised (the bytes of ``[\\x20\\x09-\\x0D]`` go), and cut where a rolling hash of the last
32 bytes says so; a document is then its *recipe*, the ordered identifiers of its chunks. Chunk
contents move once, to be verified: contents are grouped with their 16-byte digest, and a digest
that stands for more than one content makes the documents that hold it use identifiers made
of the digest and the rank of the content. Documents are compared by recipe, so long texts
don't move again.

Nulls: a null text is empty. Empty texts (and those of white space alone) are equal to each other.
Repeated rows with one doc_id are rows of one group, and each keeps its own result row. Ties:
most code points in the original text stay, then the smallest doc_id (null first). An empty table
gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window as W

from .shared import SharedTable, ship
from .text import WHITE, pieces

ROLL = 32
MIN_CHUNK, MAX_CHUNK, MASK_BITS = 2048, 32768, 13
DIGEST = 16
ROLL_BYTES = 1 << 20  # bytes whose rolling hashes are made at once
_GEAR = np.random.default_rng(977).integers(0, 1 << 32, 256, dtype=np.uint32)
_STEP = np.array([0xC2B2AE35, 0x85EBCA6B, 0x27D4EB2F, 0x165667B1, 0x9E3779B9], dtype=np.uint32)


def cut_points(buffer: np.ndarray, least: int = MIN_CHUNK, most: int = MAX_CHUNK, bits: int = MASK_BITS) -> np.ndarray:
    """Places after which the rolling hash asks for a cut, anywhere in the buffer. Where to cut never decides what is equal."""
    out = [np.zeros(0, dtype=np.int64)]
    for low in range(0, len(buffer), ROLL_BYTES):
        h = _GEAR[buffer[max(0, low - ROLL + 1) : low + ROLL_BYTES]]
        span = 1
        for odd in _STEP:  # the hash of 2, 4, ... 32 bytes from that of half as many
            h = h[:-span] * odd + h[span:]
            span *= 2
        out.append(np.flatnonzero((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits) == 0) + max(0, low - ROLL + 1) + ROLL)
    return np.concatenate(out)


def chunk_ends(length: int, cuts: np.ndarray, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> list[int]:
    """Ends of the chunks of one text, whose cut points are ``cuts``: depends on the text alone."""
    out, at = [], 0
    for c in [*cuts.tolist(), length]:
        while c - at > most:
            at += most
            out.append(at)
        if c - at >= least and c < length or c == length and c > at:
            at = c
            out.append(at)
    return out or [0]


def chunks(text: bytes, **limits: int) -> list[bytes]:
    """The chunks of a normalised text; one empty chunk if it is empty."""
    buffer = np.frombuffer(text, dtype=np.uint8)
    ends = chunk_ends(len(text), cut_points(buffer, **limits) if len(text) > limits.get("least", MIN_CHUNK) else np.zeros(0, dtype=np.int64), **{k: v for k, v in limits.items() if k != "bits"})
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def _normalised(buffer: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    inside = ~WHITE[buffer]
    before = np.zeros(len(buffer) + 1, dtype=np.int64)
    np.cumsum(inside, out=before[1:])
    data, at = buffer[inside].tobytes(), before[offsets]
    return [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _digest(chunk: bytes, size: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=size).digest()


def _recipes(size: int, limits: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buffer, offsets in pieces(batch):
                sums, recipes = [], []
                for text in _normalised(buffer, offsets):
                    sums.append(hashlib.sha256(text).hexdigest())
                    recipes.append(b"".join(_digest(c, size) for c in chunks(text, **limits)))
                yield pa.record_batch([part.column("doc_id"), part.column("n_points"), pa.array(sums), pa.array(recipes, pa.binary())], ["doc_id", "n_points", "text_sha256", "recipe"])

    return run


def _contents(size: int, limits: dict, with_place: bool = False):
    """Digest and content of chunks; without places, each content once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buffer, offsets in pieces(batch):
                rows: dict | list = {} if not with_place else []
                for d, text in enumerate(_normalised(buffer, offsets)):
                    for k, c in enumerate(chunks(text, **limits)):
                        if with_place:
                            rows.append((d, k, _digest(c, size), c))
                        else:
                            rows[c] = None
                if with_place:
                    d, k, g, c = zip(*rows) if rows else ((), (), (), ())
                    yield pa.record_batch([part.column("row").take(pa.array(d, pa.int64())), pa.array(k, pa.int32()), pa.array(g, pa.binary()), pa.array(c, pa.binary())], ["row", "place", "digest", "content"])
                else:
                    own = list(rows)
                    yield pa.record_batch([pa.array([_digest(c, size) for c in own], pa.binary()), pa.array(own, pa.binary())], ["digest", "content"])

    return run


def recipes(documents: DataFrame, digest_size: int = DIGEST, **limits: int) -> DataFrame:
    """doc_id, n_points (code points of the original text), text_sha256 of the normalised text, recipe (binary: verified identifiers in order)."""
    ship(documents.sparkSession)
    key = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", "text", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_points"))
    made = SharedTable(rows.mapInArrow(_recipes(digest_size, limits), f"doc_id {key}, n_points long, text_sha256 string, recipe binary"), "recipes").read()
    contents = rows.select("text").mapInArrow(_contents(digest_size, limits), "digest binary, content binary").groupBy("digest", "content").agg(F.lit(1).alias("one"))
    # A digest with one content is an identifier as it is. A good digest never has more; that path serves short ones.
    unclear = SharedTable(contents.groupBy("digest").count().where("count > 1").select("digest"), "unclear").read()
    if unclear.isEmpty():
        return made
    texts = documents.select("text").distinct().withColumn("row", F.col("text"))
    places = texts.mapInArrow(_contents(digest_size, limits, True), "row string, place int, digest binary, content binary")
    rank = contents.join(unclear, "digest", "left_semi").select("digest", "content", F.row_number().over(W.partitionBy("digest").orderBy("content")).alias("rank"))
    named = places.join(rank, ["digest", "content"], "left").select(
        "row", F.struct("place", F.concat("digest", F.to_binary(F.lpad(F.hex(F.coalesce("rank", F.lit(0))), 8, "0"), F.lit("hex"))).alias("id")).alias("x")
    )
    exact = named.groupBy("row").agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list("x")), lambda x: F.hex(x["id"]))).cast("binary"), 256).alias("recipe"))
    again = documents.select("doc_id", F.col("text"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_points"))
    full = again.join(exact, again["text"].eqNullSafe(exact["row"]), "left")
    sums = full.select("doc_id", "text", "n_points", "recipe").mapInArrow(_only_sums, f"doc_id {key}, n_points long, text_sha256 string, recipe string")
    return sums.withColumn("recipe", F.col("recipe").cast("binary"))


def _only_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, buffer, offsets in pieces(batch):
            yield pa.record_batch([part.column("doc_id"), part.column("n_points"), pa.array([hashlib.sha256(t).hexdigest() for t in _normalised(buffer, offsets)]), part.column("recipe")], ["doc_id", "n_points", "text_sha256", "recipe"])


def exact_groups(documents: DataFrame, digest_size: int = DIGEST, **limits: int) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Groups of one stay out of the join. The table of groups is written, so that both sides of the
    join are plain exchanges, which adaptive execution splits where one recipe is very common.
    """
    made = recipes(documents, digest_size, **limits)
    grouped = made.groupBy("recipe").agg(F.count("*").alias("group_size"), F.min(F.struct((-F.col("n_points")).alias("n"), "doc_id")).alias("first"))
    groups = SharedTable(grouped.where("group_size > 1").select(F.col("recipe"), "group_size", F.col("first.doc_id").alias("keep_id")), "groups").read()
    out = made.join(groups, "recipe", "left")
    single = F.col("group_size").isNull()
    keep = F.when(single, F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def _with_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, buffer, offsets in pieces(batch):
            yield part.append_column("__sum", pa.array([hashlib.sha256(t).hexdigest() for t in _normalised(buffer, offsets)], pa.string()))


def deduplicate(documents: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns. A row goes if its own text's group keeps another doc_id, whatever
    other rows have its doc_id or null. Of repeated rows (equal doc_id, or null, and equal text) that stay, all stay."""
    gone = exact_groups(documents).where(~F.col("kept")).select(F.col("doc_id").alias("__gone"), F.col("text_sha256").alias("__text")).distinct()
    rows = documents.mapInArrow(_with_sums, StructType([*documents.schema.fields, StructField("__sum", StringType())]))
    return rows.join(gone, rows["doc_id"].eqNullSafe(gone["__gone"]) & (rows["__sum"] == gone["__text"]), "left_anti").drop("__sum")
