"""From raw documents to packed training sequences: five stages, each one operator of ``tessera.llm``.

Each stage takes the documents that its predecessor kept and returns documents with the same
columns; the last one returns the packed pieces. Toxic documents go; of equal texts one stays; of each
group of near duplicates one stays; sources are mixed to their target weights, so a document
may be left out or repeated; what is left is packed. The score of toxicity and the weights are those
of the operators' own queries.

In every stage: a null text is empty (it isn't toxic, equals other empty texts, links with nothing near, has size 0 and packs as one
end token); a null doc_id is no copy of another row's, and a null source is a source of its own; texts are read whole, however long; ties
go to the smaller doc_id; repeated rows are copies of each other only where the stage removes copies and their ids differ, and
documents of their own to mixing and packing; columns besides those that a stage reads are carried, whatever their names; an empty table
gives an empty one with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from tessera.llm.shared import SharedTable, ship


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; labels are learnt from the whole table of labels and the documents."""
    ship(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without their white space one stays: the one with most code points, then the smallest doc_id."""
    ship(spark)
    return exact_dedup.deduplicate(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of at least 0.8 by shingles of five words connect the one with the smallest doc_id stays; those without words or id stay."""
    ship(spark)
    return ngram_join.deduplicate(docs, 5, 80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: from never to three times."""
    ship(spark)
    return mixing.mixture(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in the sequences; columns besides doc_id and text end here."""
    import public_tokenizers

    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_copies),
    ("ngram_jaccard_join", remove_near_copies),
    ("mixing", mix_sources),
    ("best_fit_packing", pack),
]

#: Tokens, hashes by a classifier and draws can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = SharedTable(docs, f"stage-{name}").read()
    return docs
