import itertools
import math
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, html_extract, mixing, packing, preferences, token_counts, toxicity
from tessera.llm.text import text_buffers, words_of

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")


# -- nearest neighbours


def brute_nearest(rows, asked, k):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = []
    for i, v in sorted(good):
        if asked(i):
            found = sorted(((-sum(np.float32(a).astype(float) * np.float32(b).astype(float) for a, b in zip(v, w)), j) for j, w in good if j != i))[:k]
            out += [(i, r + 1, j, pytest.approx(-s)) for r, (s, j) in enumerate(found)]
    return out


def test_nearest_with_all_lists_is_exact(spark):
    rnd = random.Random(1)
    rows = [(i, [round(rnd.uniform(-1, 1), 2) * (1 + i % 3) for _ in range(4)]) for i in range(160)]
    rows += [(200 + i, [0.5, -0.25, 1.0, 0.0]) for i in range(40)]  # one common vector
    rows += [(300, None), (301, []), (302, [0.0] * 4), (303, [1.0, None, 0.0, 0.0]), (304, [float("nan"), 1.0, 0.0, 0.0]), (305, [float("inf"), 1.0, 0.0, 0.0]), (306, [1.0, 2.0]), (None, [1.0] * 4), rows[5]]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, list string, node int").repartition(3)
    got = [tuple(r) for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 7).orderBy("query_id", "rank").collect()]
    assert got == brute_nearest(rows, lambda i: i % 20 == 0, 7)


def test_few_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.1])], "vec_id long, embedding array<double>")
    assert [tuple(r)[:3] for r in ann.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 2), (0, 2, 1)]
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0
    assert ann.nearest(df.limit(1), F.lit(True)).count() == 0


def test_recall_and_balance():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 4000)] + 0.6 * rng.normal(size=(4000, 16))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    c = ann.Centroids(None, None, 1.0)
    c.points = ann.balanced_kmeans(c.augmented(x), 40)
    c.neighbours = ann.build_graph(c.points)
    d, at = c.search(c.augmented(x[:300]), 8)
    exact = ((c.augmented(x[:300])[:, None] - c.points) ** 2).sum(axis=2)
    assert (at[:, 0] == exact.argmin(axis=1)).mean() > 0.95 and np.allclose(d[:, 0], exact.min(axis=1), atol=1e-4)
    size = np.bincount(c.search(c.augmented(x), 1)[1][:, 0], minlength=40)
    assert size.max() < 4 * size.mean()


def test_no_list_within_the_ratio_is_lost(spark):
    """Over 512 lists, of which the ratio takes more than the walk's beam holds: all of them are read, so that a wide ratio is exact."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(5200, 24)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    index = ann.PostingIndex(df, 20, list_size=8)
    assert len(index.sizes) > 512
    c, v, ratio = index.shared.value, x[:40], 1.2
    probed = pd.concat(ann._probe(index.shared, index.sizes, ratio, 256, 600)(iter([pd.DataFrame({"node": range(40), "embedding": list(v)})])))
    d = ((c.as_query(v)[:, None] - c.points) ** 2).sum(axis=2)
    within = d < 0.999 * d.min(axis=1, keepdims=True) * (1 + ratio) ** 2
    assert (within.sum(axis=1) > 256).any()
    for i in range(40):
        assert set(np.flatnonzero(within[i])) <= set(probed["list"][probed["query"] == i])
    found = index.search(F.col("vec_id") % 52 == 0, ratio=20.0).groupBy("query_id").agg(F.collect_set("vec_id").alias("ids")).collect()
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    assert len(found) == 100 and all(set(r.ids) == set(np.argsort(-score[r.query_id])[:20].tolist()) for r in found)


@pytest.mark.parametrize("spread, share", [(0.35, 0.2), (3.0, 0.8)])
def test_pruned_search_finds_the_neighbours(spark, spread, share):
    """The whole search against brute force: on clustered vectors it scores few of the points, and on vectors without structure it reads more rather than lose them."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(60, 24))
    x = centres[rng.integers(0, 60, 6000)] + spread * rng.normal(size=(6000, 24))
    x = (x / np.sqrt((x * x).sum(axis=1))[:, None]).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    index = ann.PostingIndex(df, 20, list_size=32)
    found = index.search(F.col("vec_id") % 20 == 0).groupBy("query_id").agg(F.collect_set("vec_id").alias("ids")).collect()
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    assert len(found) == 300
    assert np.mean([len(set(r.ids) & set(np.argsort(-score[r.query_id])[:20].tolist())) / 20 for r in found]) >= 0.9
    lists = index.probes.select("query", "list").distinct().join(index.postings.select("list", "node"), "list")
    assert lists.select("query", "node").distinct().count() <= share * 300 * 6000


def test_search_writes_in_proportion_to_the_points(spark, monkeypatch):
    """Queries and lists both grow with the table; their pairs are neither written nor shuffled, and several batches of queries give what one gives."""
    written, plain = [], ann.SharedTable
    monkeypatch.setattr(ann, "SharedTable", lambda df, name: (t := plain(df, name), written.append(t.read().count()))[0])
    monkeypatch.setattr(ann, "BATCH", 50)
    rows = {}
    for n in (1000, 4000):
        x = np.random.default_rng(9).normal(size=(n, 16)).astype(np.float32).astype(float)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
        written.clear()
        found = ann.PostingIndex(df, 5, list_size=8).search(F.col("vec_id") % 20 == 0, ratio=20.0).orderBy("query_id", "rank").collect()
        rows[n] = sum(written)
        score = x @ x.T
        np.fill_diagonal(score, -np.inf)
        assert [(r.query_id, r.vec_id) for r in found] == [(q, int(i)) for q in range(0, n, 20) for i in np.argsort(-score[q])[:5]]
    assert rows[4000] <= 5 * rows[1000]


# -- token counts


def test_token_counts_are_the_tokenizers(spark, messy, nothing):
    from tokenizers import Tokenizer, models, pre_tokenizers

    rnd = random.Random(2)
    split = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    pieces = token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    exact = Tokenizer(models.Unigram(pieces, 0, True))
    exact.pre_tokenizer = split
    counter = token_counts.Counter(pieces)
    texts = ["", " ", "  a", "a  b", "日本語 😀😀", "<s> <0x41>", "\n\nfoo\tbar", "▁ ▁▁a", "a" * 400]
    texts += ["".join(rnd.choice("ab e▁tй😀ก\nlo") for _ in range(rnd.randrange(20))) for _ in range(500)]
    for t in texts:
        assert counter.text(t) == len(exact.encode(t, add_special_tokens=False).ids), t
    for _ in range(100):  # small vocabularies with ties, without byte pieces
        own = [("<unk>", 0.0), *{"".join(rnd.choice("▁abc") for _ in range(rnd.randrange(1, 4))): float(rnd.randrange(-3, 0)) for _ in range(8)}.items()]
        t2 = Tokenizer(models.Unigram(own, 0, False))
        t2.pre_tokenizer = split
        c2 = token_counts.Counter(own)
        for _ in range(10):
            t = "".join(rnd.choice("abcd  ") for _ in range(rnd.randrange(12)))
            assert c2.text(t) == len(t2.encode(t, add_special_tokens=False).ids)
    df, rows = messy
    got = sorted((r.doc_id or -1, r.n_tokens) for r in token_counts.count_tokens(df, pieces).collect())
    assert got == sorted((r[0] or -1, len(exact.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert token_counts.count_tokens(nothing, pieces).count() == 0


# -- preferences


def brute_pair(chosen, rejected):
    text = lambda ts: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in ts)

    def mask(ts):
        at, out = 0, []
        for r, t in ts:
            head, whole = len(f"<|{r}|>\n"), len(f"<|{r}|>\n{t}<|end|>\n")
            if r == "assistant":
                out.append(f"{at + head}:{at + whole}")
            at += whole
        return ",".join(out)

    k = 0
    while chosen and rejected and k < min(len(chosen), len(rejected)) and chosen[k] == rejected[k]:
        k += 1
    side = lambda ts: (text(ts[k:]), mask(ts[k:])) if ts else (None, None)
    (a, b), (c, d) = side(chosen), side(rejected)
    return (k, text(chosen[:k]), a, c, b, d)


def test_preferences(spark):
    rnd = random.Random(3)
    convs = {}
    for p in range(30):
        base = [(rnd.choice(["user", "assistant", "system"]), rnd.choice(["hi", "ho", "", "déjà"])) for _ in range(rnd.randrange(5))]
        for s in (0, 1):
            convs[2 * p + s] = base[: rnd.randrange(len(base) + 1)] + [(rnd.choice(["user", "assistant"]), rnd.choice("abc")) for _ in range(rnd.randrange(3))]
    convs[5] = [(None, None), ("assistant", "x")]
    rows = [(c, i, r, t, 1) for c, ts in convs.items() for i, (r, t) in enumerate(ts)] + [(None, 0, "user", "lost", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, k int").repartition(3)
    got = {r.pair_id: tuple(r)[1:] for r in preferences.format_pairs(preferences.neighbours_as_pairs(df)).collect()}
    clean = {c: [(r or "unknown", t or "") for r, t in ts] for c, ts in convs.items()}
    want = {p: brute_pair(clean[2 * p], clean[2 * p + 1]) for p in range(30) if clean[2 * p] or clean[2 * p + 1]}
    assert got == want
    assert preferences.format_pairs(preferences.neighbours_as_pairs(df.limit(0))).count() == 0
    # repeated rows and tied turn numbers are turns of their own, in the order of role and text; texts may be long
    long = "word " * 40_000
    tied = [(0, 0, "user", "hi"), (0, 0, "assistant", "b"), (0, 0, "assistant", "a"), (0, 0, "user", "hi"), (1, 0, "assistant", "a"), (1, 1, "assistant", long), (1, 1, "assistant", long)]
    got = preferences.format_pairs(preferences.neighbours_as_pairs(spark.createDataFrame(tied, "conv_id long, turn long, role string, text string").repartition(3))).collect()
    assert [tuple(r)[1:] for r in got] == [brute_pair([("assistant", "a"), ("assistant", "b"), ("user", "hi"), ("user", "hi")], [("assistant", "a"), ("assistant", long), ("assistant", long)])]


# -- packing


def test_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer

    exact, rnd = Tokenizer.from_file(BPE), random.Random(4)
    texts = ["", "  ", " a  b   c\n\n d \n e\t f", "<|endoftext|> hi a<|endoftext|>", "\n\n", "a \n\nb", "é" * 3000, "don't  we'll\r\n ok", "\x1c \x85 a", "123 4567abc $$$ 　x", "a b\n", "\na\nb c", "a\x85\nb", "x" * 9000 + " y", None]
    from tests.llm.test_dedup import twins

    x, y = twins()
    texts += [f"x {x} y", f"x {y} y", f"{y} {x}"]
    texts += ["".join(rnd.choice("ab \n\t é'1s.") for _ in range(rnd.randrange(12))) for _ in range(800)]
    texts += [" ".join("".join(rnd.choice("abé'1s.") for _ in range(rnd.randrange(1, 5))) for _ in range(rnd.randrange(12))) for _ in range(800)]
    from tessera.llm.text import text_buffers

    ids, first = packing.Encoder(open(BPE, encoding="utf-8").read()).batch(*text_buffers(pa.array(texts)))
    for i, t in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == exact.encode(t or "", add_special_tokens=False).ids, t


@pytest.mark.parametrize("capacity", [7, 32])
def test_plans_use_every_piece_once_and_few_bins(capacity):
    rnd = np.random.default_rng(capacity)
    for _ in range(60):
        counts = np.zeros(capacity + 1, dtype=np.int64)
        counts[1:] = rnd.integers(0, rnd.integers(1, 30), capacity)
        plan = packing.best_two_fit(counts, capacity)
        used = np.zeros_like(counts)
        for pattern, times in plan:
            assert sum(pattern) <= capacity and times > 0
            np.add.at(used, pattern, times)
        assert (used == counts).all()
        bins, ideal = sum(t for _, t in plan), -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)
        left, first_fit = [n for n in range(capacity, 0, -1) for _ in range(counts[n])], []
        for n in left:
            b = next((i for i, x in enumerate(first_fit) if x + n <= capacity), None)
            if b is None:
                first_fit.append(n)
            else:
                first_fit[b] += n
        assert ideal <= bins <= len(first_fit) + 1


def plain_best_two_fit(lengths, capacity):
    """One bin at a time, piece by piece: the longest that fits, then two for the smallest as long as they fill more of its gap."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        own, gap = [], capacity
        while fit := next((n for n in left if n <= gap), None):
            own.append(fit), left.remove(fit)
            gap -= fit
        while gap and len(own) > 1:
            small = min(own)
            room = gap + small
            kinds = sorted(set(left))
            pairs = [(a + b, -a, a, b) for a in kinds for b in kinds if a <= room and a + b <= room and (a != b or left.count(a) > 1)]
            if not pairs or max(pairs)[0] <= small:
                break
            _, _, a, b = max(pairs)
            own.remove(small), left.remove(a), left.remove(b)
            own += [a, b]
            left = sorted([*left, small], reverse=True)
            gap = room - a - b
        bins.append(tuple(sorted(own, reverse=True)))
    return sorted(bins)


@pytest.mark.parametrize("capacity", [9, 24])
def test_plans_are_those_of_plain_best_two_fit(capacity):
    rnd = np.random.default_rng(capacity)
    for _ in range(60):
        counts = np.zeros(capacity + 1, dtype=np.int64)
        counts[1:] = rnd.integers(0, rnd.integers(1, 7), capacity)
        lengths = [n for n in range(capacity + 1) for _ in range(counts[n])]
        bins = sorted(tuple(p) for p, times in packing.best_two_fit(counts, capacity) for _ in range(times))
        assert bins == plain_best_two_fit(lengths, capacity)


def test_packing(spark, messy, nothing):
    from tokenizers import Tokenizer

    df, rows = messy
    exact = Tokenizer.from_file(BPE)
    seqs = {r.sequence_id: np.frombuffer(r.ids, dtype="<u4").tolist() for r in packing.sequences(df, BPE, 64).collect()}
    placed = packing.pack_documents(df, BPE, 64).collect()
    for s, own in itertools.groupby(sorted(placed, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in own:
            assert r.offset == at and zlib.crc32(np.array(seqs[s][at : at + r.length], dtype="<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(seqs[s]) <= 64
    want = sorted((r[0] is None, r[0] or 0, i, c) for r in rows for ids in [exact.encode(r[1] or "", add_special_tokens=False).ids + [2]] for i, c in enumerate(cut(ids, 64)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.ids_crc32) for r in placed) == want
    assert len(seqs) <= 1.1 * sum(len(x) for x in seqs.values()) / 64 + 1
    assert packing.pack_documents(nothing, BPE).count() == 0


def cut(ids, capacity):
    first = (len(ids) - 1) % capacity + 1
    bounds = [0, *range(first, len(ids) + 1, capacity)]
    return [zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes()) for a, b in zip(bounds, bounds[1:])]


# -- mixing


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    got = mixing.targets([10, 1000, 1000, 0], [5, 2, 1, 5])
    assert got[0] == 30 and got[3] == 0 and sum(got) == pytest.approx(2010) and got[1] / got[2] == pytest.approx(2)
    assert mixing.targets([], []) == []


def test_filling_comes_near():
    rnd = random.Random(9)
    for _ in range(200):
        sizes = [rnd.randrange(0, 50) for _ in range(rnd.randrange(1, 40))]
        room = rnd.uniform(0, sum(sizes))
        got = mixing.fill(sizes, room)
        assert set(got) <= {0, 1}
        assert abs(sum(z * k for z, k in zip(sizes, got)) - room) <= (50 if len(sizes) < 12 else 5)
    for _ in range(200):  # sizes that stand for several rows
        sizes = [rnd.randrange(0, 50) for _ in range(rnd.randrange(1, 40))]
        counts = [rnd.randrange(1, 5) for _ in sizes]
        room = rnd.uniform(0, sum(z * n for z, n in zip(sizes, counts)))
        got = mixing.fill(sizes, room, counts)
        assert all(0 <= k <= n for k, n in zip(got, counts)) and abs(sum(z * k for z, k in zip(sizes, got)) - room) <= 50


@pytest.mark.parametrize("block_rows", [500, 1 << 40])
def test_mixing_of_repeated_rows(spark, monkeypatch, block_rows):
    """One doc_id in many rows, some equal, some not: as many are taken as come near the target."""
    rows = [(7, " ".join("w" * 20), "a")] * 100 + [(7, " ".join("v" * (5 + i % 3)), "a") for i in range(30)] + [(i, " ".join("x" * 10), "b") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    totals = [sum(len(t.split()) for _, t, s in rows if s == x) for x in "ab"]
    want = mixing.targets(totals, [0.2, 1])
    p, sized = mixing.plan(df, (0.2, 1), block_rows=block_rows)
    got = mixing.dealt(sized, p).select("doc_id", "source", "size", F.size("copies").alias("n")).collect()
    assert len(got) == len(rows) and any(0 < r.n for r in got if r.doc_id == 7) and any(r.n == 0 for r in got if r.doc_id == 7)
    for x, target in zip("ab", want):
        assert abs(sum(r.size * r.n for r in got if r.source == x) - target) <= 5
    mixed = [r.text.split() for r in mixing.mixture(df, (0.2, 1)).collect()]
    assert abs(sum(len(t) for t in mixed if t[0] != "x") - want[0]) <= 5
    rows = [(7, "w " * 25, "a")] * 100 + [(8, "w " * 25, "b")] * 100
    hundred = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = [r.taken for r in mixing.mix_report(hundred, (3, 5)).collect() if r.doc_id == 7]
    assert len(taken) == 100 and abs(sum(taken) - 1875) <= 25


def test_splitting_tree_keeps_quotas():
    q = np.array([7, 0, 130, 41])
    t = mixing.splitting_tree(q, 6, 3)
    assert (t.sum(axis=0) == q).all() and (t >= 0).all() and t.sum(axis=1).max() - t.sum(axis=1).min() <= 3
    assert (t == mixing.splitting_tree(q, 6, 3)).all()


def test_mixing(spark, messy, nothing):
    rnd = random.Random(5)
    rows = [(i, " ".join("w" * rnd.randrange(1, 4) for _ in range(rnd.randrange(0, 40))), "s%d" % min(3, rnd.randrange(9)) if i % 11 else None, "keep", 7) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_shard string, epoch int").repartition(4)
    got = {r.doc_id: r for r in mixing.mix_report(df).collect()}
    size = {r[0]: len(r[1].split()) for r in rows}
    names = sorted({r[2] for r in rows if r[2]}) + [None]
    totals = [sum(size[r[0]] for r in rows if r[2] == s) for s in names]
    want = mixing.targets(totals, [mixing.WEIGHTS[i % 3] for i in range(len(names))])
    for s, total, target in zip(names, totals, want):
        own = [got[r[0]] for r in rows if r[2] == s]
        assert {r.source_size for r in own} == {total} and own[0].target == pytest.approx(target)
        assert abs(sum(r.taken for r in own) - target) <= 2
        assert all(r.taken <= 3 * r.size and r.size == size[r.doc_id] and r.taken == len(r.copies) * r.size for r in own)
    again = {r.doc_id: r.taken for r in mixing.mix_report(df.repartition(3)).collect()}
    assert again == {i: r.taken for i, r in got.items()}
    mixed = mixing.mixture(df, with_place=True)
    assert mixed.columns == ["doc_id", "text", "source", "epoch", "mix_epoch", "mix_shard", "mix_order"]
    assert mixed.count() == sum(len(r.copies) for r in got.values())
    assert mixing.mixture(df).columns == df.columns
    mess, own = messy
    assert mixing.mix_report(mess).count() == len(own)
    assert mixing.mix_report(nothing).count() == 0 and mixing.mixture(nothing).count() == 0


# -- html


def test_extraction_on_held_out_layouts():
    model = html_extract.trained()
    pages = [html_extract.parse(t) for t in html_extract.labelled_pages(60, seed=77)]
    good = wrong = missed = 0
    for p, m in zip(pages, html_extract.content_marginals(pages, model)):
        gold = []
        for i, y in enumerate(p.label):
            gold.append(y if y is not None else gold[p.parent[i]] if p.parent[i] >= 0 else 0)
        for k, block in p.blocks:
            good += len(block) * (gold[k] and m[k] >= 0.5)
            wrong += len(block) * (not gold[k] and m[k] >= 0.5)
            missed += len(block) * (gold[k] and m[k] < 0.5)
    assert good / (good + wrong) > 0.97 and good / (good + missed) > 0.97


def test_sum_product_is_exact():
    rng = np.random.default_rng(1)
    parents = [-1, 0, 0, 1, 1, 2, 3]
    unary, pair = rng.normal(size=7), rng.normal(size=(2, 2))
    total = np.zeros((7, 2))
    for y in itertools.product((0, 1), repeat=7):
        p = math.exp(sum(u * b for u, b in zip(unary, y)) + sum(pair[y[q], y[i]] for i, q in enumerate(parents) if q >= 0))
        for i in range(7):
            total[i, y[i]] += p
    got, both = html_extract.sum_product(html_extract._forest([parents]), unary, pair)
    assert got == pytest.approx(total / total.sum(axis=1, keepdims=True)) and both[3].sum(axis=0) == pytest.approx(got[3])


def test_markup(spark):
    page = (
        '<!DOCTYPE html><title>no</title><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav><script>var a="<p>no</p>";</script>'
        '<article><h1>A &amp; B&nbsp;&copy;</h1><p>One  <b>two</b>\n three<br>four<p>Five &lt;p&gt; six<!-- no --><ul><li>seven<li>eight</ul></article><footer>&copy; nobody</footer>'
    )
    want = "A & B ©\n\nOne two three four\n\nFive <p> six\n\nseven\n\neight"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "< a > b <<p>"), (5, "u", "<script>never closed"), (6, "u", "<div " * 50), (None, "u", page), (1, "u", page), (7, "u", "<p>" * 400 + "deep")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = html_extract.main_text(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (1, None)] == [want] * 3
    assert [r.text for r in got if r.page_id in (2, 3)] == ["", ""]
    assert html_extract.main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>no</title><meta charset=x><script>'<p>no</p>'</script><h1>one</h1><p>two",
        *(f"<h1>one</h1><{t} class=a><g><style>'<p>no'</style>no<p>two" for t in ("svg", "math", "object", "canvas", "audio", "video", "noscript", "template")),
        "<h1>one</h1><svg><g></svg><p>two<script>'<p>no'",
        "<h1>one</h1><p>two" + "<svg>no<div>" * 20000,
    ],
)
def test_only_raw_text_without_an_end_lasts_to_the_end_of_the_page(page):
    assert [t for _, t in html_extract.parse(page).blocks] == ["one", "two"]


def test_extraction_is_that_of_all_labellings(spark):
    """The whole query on small pages against an enumeration of every labelling of their trees."""
    model = html_extract.trained()
    pages = [
        "<nav><a href=x>Home</a></nav><article><h1>Title</h1><p>" + "words and more " * 12 + "<p>short</article><footer>&copy; us</footer>",
        "<div class=sidebar><ul><li><a href=q>one</a></ul></div><div id=content><p>" + "some text here " * 9 + "</div>",
        "<section class=comments><p>nice post</p></section><main><p>" + "the main part " * 20 + "</main>", "<p>alone", "",
    ]
    want = []
    for t in pages:
        page = html_extract.parse(t)
        unary = [sum(model.weight[model.index[x]] for x in f if x in model.index) for f in html_extract.page_features(page)]
        mass = np.zeros((len(unary), 2))
        for y in itertools.product((0, 1), repeat=len(unary)):
            p = math.exp(sum(u * b for u, b in zip(unary, y)) + sum(model.pair[y[q], y[i]] for i, q in enumerate(page.parent) if q >= 0))
            for i, b in enumerate(y):
                mass[i, b] += p
        want.append("\n\n".join(text for k, text in page.blocks if mass[k, 1] >= mass[k, 0]))
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").withColumn("url", F.lit("u"))
    assert [r.text for r in html_extract.main_text(df).orderBy("page_id").collect()] == want and sum(map(bool, want)) >= 3


@pytest.mark.parametrize("shape", ["unclosed", "odd", "nested", "chains", "ends", "paragraphs"])
def test_long_pages_take_time_in_proportion(shape):
    """Unclosed quotes, deep trees, stray end tags: the times that a page four times as long takes stay near four."""
    import time

    def page(n):
        return {
            "unclosed": "<a " * n + '"',
            "odd": '<p>x</p><a "' * n + '"' * (1 - n % 2),
            "nested": "<div>" * n + "deep" + "</div>" * n,
            "chains": "<p><button>" + "<div><ul><li>x" * n,
            "ends": "<div><section>" * n + "</article></td>" * n,
            "paragraphs": "<table><tr><td>" * (n // 8) + "<p>y" * n,
        }[shape]

    model = html_extract.trained()
    html_extract.extract([page(500)], model)
    took = []
    for n in (10_000, 40_000):
        text = page(n)
        began = time.process_time()
        html_extract.extract([text], model)
        took.append(time.process_time() - began)
    assert took[1] < 12 * max(took[0], 0.05) and took[1] < 15


def test_quotes_that_do_not_close_are_characters():
    blocks = lambda t: [b for _, b in html_extract.parse(t).blocks]
    assert blocks('<p class="a>one</p><p>two') == ["one", "two"]
    assert blocks("""<p title='x > y'>one</p><p title="it's">two</p>""") == ["one", "two"]
    assert blocks('<p>5 < 6 "and" <b>more</b>') == ['5 < 6 "and" more']


# -- toxicity


def corpus_of(n, seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["an", "er", "st", "ou", "li", "th"]) for _ in range(rnd.randrange(1, 4)))
    texts, toxic = [], []
    for _ in range(n):
        w = [word() for _ in range(rnd.randrange(20, 120))]
        bad = rnd.random() < 0.2
        for _ in range(rnd.randrange(1, 4) if bad else 0):
            w[rnd.randrange(len(w))] = rnd.choice(["grumble", "Blotch", "zorgon" + word(), "zorgel" + word()])
        texts.append(" ".join(w) + rnd.choice([".", "!", "\n"]))
        toxic.append(int(bad))
    return texts, toxic


def test_toxicity_held_out(spark):
    texts, toxic = corpus_of(900, 1)
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([*enumerate(toxic), (3, None), (None, 1), (10**6, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(df, labels, with_spans=True).collect()
    assert len(got) == 900 and {r.held_out for r in got} == {True, False}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    out = [r for r in got if r.held_out]
    assert sum(r.predicted == toxic[r.doc_id] for r in out) / len(out) > 0.97
    words = {texts[r.doc_id][s.start : s.end].lower()[:4] for r in got if toxic[r.doc_id] for s in r.spans}
    assert words <= {"grum", "blot", "zorg"} and len(words) == 3


def test_features_of_late_windows_are_learnt():
    """Over 3,000 windows with a common feature come before those of a rare one."""
    rnd = random.Random(3)
    plain = lambda n: [f"{rnd.choice('bcdfg')}{rnd.choice('aeiou')}{rnd.choice('lmnrt')}{rnd.choice('aeiou')}" for _ in range(n)]
    common = [" ".join(w for _ in range(110) for w in [*plain(31), "zzcommon"]) for _ in range(30)]
    rare = [" ".join([*plain(20), "qqlater", *plain(20)]) for _ in range(20)]
    clean = [" ".join(plain(60)) for _ in range(300)]
    model = toxicity.fit([*common, *rare, *clean], [1] * 50 + [0] * 300)
    buffer, offsets = text_buffers(pa.array(["qqlater"]))
    kinds = toxicity.features(words_of(buffer, offsets, toxicity._LETTERS))[:, 0]
    weights = model.weights[np.isin(model.keys, kinds)]
    assert len(weights) and weights.max() > 2
    buffer, offsets = text_buffers(pa.array([" ".join([*plain(30), "qqlater", *plain(30)])]))
    place, p = model.spans(words_of(buffer, offsets, toxicity._LETTERS))
    assert p[place == 30].max() > toxicity.SPAN


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(2)
    m = toxicity.Model(np.zeros(0, dtype=np.uint64), np.zeros(0), -1.3, rng.normal(size=(2, 2)))
    first, place = np.array([0, 6, 6, 13]), np.array([1, 4, 6, 9, 12])
    emission = rng.normal(size=5)
    got = m.marginals(first, place, emission)
    for a, b in ((0, 6), (6, 13)):
        own = [emission[list(place).index(t)] if t in place else -1.3 for t in range(a, b)]
        total = np.zeros((b - a, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            p = math.exp(sum(e * v for e, v in zip(own, y)) + sum(m.transition[u, v] for u, v in zip((0, *y), y)))
            for i, v in enumerate(y):
                total[i, v] += p
        for t in place[(place >= a) & (place < b)]:
            assert got[list(place).index(t)] == pytest.approx(total[t - a, 1] / total[t - a].sum())


def test_scores_are_those_of_a_plain_chain(spark):
    """The whole query against forward-backward over every token, one by one, with a dictionary of weights."""
    texts, toxic = corpus_of(400, 6)
    texts += ["", None, "grumble " * 40, "x" * 5000 + " blotch"]
    toxic += [0, 0, 1, 1]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    weight, a = dict(zip(model.keys.tolist(), model.weights.tolist())), np.exp(model.transition)
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    for i, t in list(enumerate(texts))[-60:]:
        words = words_of(*text_buffers(pa.array([t], pa.string())), toxicity._LETTERS)
        kinds = toxicity.features(words)
        local = [np.array([1.0, math.exp(np.clip(model.background + sum(weight.get(int(f), 0.0) for f in kinds[:, k]), -50, 50))]) for k in range(kinds.shape[1])]
        known = [any(int(f) in weight for f in kinds[:, k]) for k in range(kinds.shape[1])]
        alpha, s = [], np.array([1.0, 0.0])
        for e in local:
            s = (s @ a) * e
            s = s / s.sum()
            alpha.append(s)
        b, p = np.ones(2), [0.0] * len(local)
        for k in range(len(local) - 1, -1, -1):
            p[k] = alpha[k][1] * b[1] / (alpha[k] @ b)
            b = a @ (local[k] * b)
            b = b / b.sum()
        own = [x for x, y in zip(p, known) if y]
        evidence = np.array([1.0, math.log1p(sum(x for x in own if x > 0.05)), max(own, default=0.0)])
        assert got[i] == pytest.approx(1 / (1 + math.exp(-np.clip(evidence @ model.calibration, -500, 500))), abs=1e-6)


def test_toxicity_of_messy_and_empty_tables(spark, messy, nothing):
    df, rows = messy
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    got = toxicity.toxicity(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    none = toxicity.toxicity(df, labels.limit(0)).collect()
    assert all(r.predicted == 0 for r in none)
    assert toxicity.toxicity(nothing, labels).count() == 0
    texts, toxic = corpus_of(300, 3)
    model = toxicity.fit(texts, toxic)
    kept = toxicity.keep_clean(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string"), model)
    assert kept.columns == ["doc_id", "text", "lang"] and {r.doc_id for r in kept.collect()} <= {i for i, y in enumerate(toxic) if not y} | set()
