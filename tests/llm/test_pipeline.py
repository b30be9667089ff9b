import collections
import random

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import mixing
from tests.llm.test_dedup import brute_exact, brute_jaccard
from tests.llm.test_operators import corpus_of


def test_stages_act_on_what_is_left(spark, tmp_path):
    """Each stage against brute force on its own input."""
    pytest.importorskip("public_tokenizers")
    texts, toxic = corpus_of(250, 11)
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    rows += [(1000 + i, texts[i].replace(" ", "\n", 3), "en", "s1", 1) for i in range(0, 40, 2)]
    rows += [(2000 + i, texts[i] + " more", "en", "s2", 1) for i in range(1, 40, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept[-1], str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        kept.append(spark.read.parquet(f"{tmp_path}/{k}"))
        if k < 4:
            assert kept[-1].columns == docs.columns
    ids = [sorted(r.doc_id for r in d.select("doc_id").collect()) for d in kept]
    bad = {i for i, y in enumerate(toxic) if y}
    assert not bad & set(ids[1]) and len(ids[1]) > 0.9 * len([i for i in ids[0] if i % 1000 not in bad])
    own = lambda d: [tuple(r) for r in d.collect()]
    assert ids[2] == sorted(r[0] for r in brute_exact(own(kept[1])) if r[3])
    assert ids[3] == sorted({r[2] for r in brute_jaccard(own(kept[2]), 5, 80)})
    size = {r[0]: len(r[1].split()) for r in own(kept[3])}
    source = {r[0]: r[3] for r in own(kept[3])}
    taken = collections.Counter()
    for i, n in collections.Counter(ids[4]).items():
        assert n <= 3
        taken[source[i]] += n * size[i]
    names = sorted(set(source.values()))
    want = mixing.targets([sum(size[i] for i in size if source[i] == s) for s in names], [mixing.WEIGHTS[k % 3] for k in range(len(names))])
    assert [taken[s] for s in names] == pytest.approx(want, rel=0.02)
    pieces = kept[5].collect()
    assert collections.Counter(r.doc_id for r in pieces if r.piece == 0) == collections.Counter(ids[4])
    full = collections.Counter()
    for r in pieces:
        full[r.sequence_id] += r.length
    assert max(full.values()) <= 1024 and np.mean(list(full.values())) > 900


def test_near_copies_by_five_words_and_four_fifths(spark, tmp_path):
    rnd = random.Random(8)
    text = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    base = [text(500) for _ in range(4)]
    spread = list(base[1])
    for i in range(12, 500, 46):  # 11 of 500 words, 2.2 %
        spread[i] = "other"
    rows = [*base, base[0] + text(110), spread, base[2] + text(140), text(30)]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.remove_near_copies(spark, docs, str(tmp_path))
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == sorted({r[2] for r in brute_jaccard([tuple(r) for r in docs.collect()], 5, 80)}) == [0, 1, 2, 3, 6, 7]


def test_stages_of_messy_and_empty_tables(spark, messy, nothing, tmp_path):
    """Nulls in any column, empty, long and repeated rows, clashing names, no rows at all: every stage keeps the columns and what it has no reason to drop."""
    pytest.importorskip("public_tokenizers")
    df, rows = messy
    spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs, n in ((df, len(rows)), (nothing, 0)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            out.write.parquet(f"{tmp_path}/{n}-{name}")
            out = spark.read.schema(out.schema).parquet(f"{tmp_path}/{n}-{name}")
            if k == 4:
                assert (out.count() > 0) == (n > 0)
                break
            assert out.columns == docs.columns and out.count() <= 3 * max(1, docs.count())
            if name == "toxicity":
                assert out.count() == n
            if name in ("toxicity", "exact_dedup", "ngram_jaccard_join") and n:
                assert out.where("doc_id IS NULL").count() == 1  # a row without an id is no copy of another
            docs = out
