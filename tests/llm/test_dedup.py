import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, ngram_join, sketch, substring_dedup
from tessera.llm.components import components
from tessera.llm.text import ngram_hashes, pieces, within, words_of

SPACE = re.compile(r"[\x20\x09-\x0D]+")
split = lambda t: [w for w in SPACE.split(t or "") if w]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_words_and_ngrams_are_those_of_a_regular_expression():
    rnd = random.Random(1)
    docs = ["".join(rnd.choice("ab \n\tcé\x1c ") for _ in range(rnd.randrange(30))) for _ in range(300)] + [None, ""]
    seen, grams = {}, {}
    for part, buffer, offsets in pieces(pa.record_batch({"text": pa.array(docs)}), limit=500):
        w = words_of(buffer, offsets)
        h = w.hashes()
        g, ok = ngram_hashes(h, 3), within(w.first, 3, len(h))
        for d in range(part.num_rows):
            own = [x.encode() for x in split(part.column(0)[d].as_py())]
            s = slice(w.first[d], w.first[d + 1])
            assert [bytes(buffer[a:b]) for a, b in zip(w.start[s], w.end[s])] == own
            for x, y in zip(own, h[s]):
                assert seen.setdefault(x, y) == y
            at = [i for i in range(w.first[d], min(w.first[d + 1], len(g))) if ok[i]]
            assert len(at) == max(0, len(own) - 2)
            for i in at:
                k = tuple(own[i - w.first[d] : i - w.first[d] + 3])
                assert grams.setdefault(k, g[i]) == g[i]
    assert len(set(seen.values())) == len(seen) and len(set(grams.values())) == len(grams)


def twins(n=2048):
    """Two different words of one length that every polynomial hash modulo a power of two takes for one (Thue and Morse)."""
    a = "a"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_are_told_apart_by_their_bytes(spark, monkeypatch):
    x, y = twins()
    z = "".join(f"w{i} " for i in range(12)).strip()
    rows = [(1, f"{x} {z}"), (2, f"{y} {z}"), (3, f"k l m {x}"), (4, f"k l m {y}"), (5, f"{x} {y} {x}"), (6, f"{x} {x} {x}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(substring_dedup.remove_repeats(df)) == brute_windows(rows, 13)
    assert {r.n_removed for r in substring_dedup.remove_repeats(df).collect()} == {0}
    assert rows_of(ngram_join.near_duplicates(df)) == brute_jaccard(rows, 4, 85)
    data = " ".join(t for _, t in rows).encode() + b" a aa A a\0 a\0\0 aaaaaaaa aaaaaaaaa aaaaaaaaaaaaaaaa aaaaaaaaaaaaaaaaa a"
    words = lambda: words_of(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]))
    own = data.split()
    for weak in (False, True):
        if weak:  # all words have one of two hashes: codes still are those of the bytes
            monkeypatch.setattr("tessera.llm.text.Words.hashes", lambda w, *a, **k: (w.end - w.start).astype(np.uint64) % np.uint64(2))
        code, first = words().codes()
        assert [own[first[c]] for c in code] == own and len(first) == len(set(own))
    assert len(set(words().hashes().tolist())) <= 2


def brute_exact(rows):
    groups = {}
    for r in rows:
        groups.setdefault(SPACE.sub("", r[1] or ""), []).append(r)
    out = []
    for t, own in groups.items():
        keep = min(own, key=lambda r: (-len(r[1] or ""), (r[0] is not None, r[0] or 0)))[0]
        out += [(r[0], keep, len(own), r[0] == keep, hashlib.sha256(t.encode()).hexdigest()) for r in own]
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [16, 1])
def test_exact_groups(messy, size):
    """Also with digests of one byte, where contents share digests and get identifiers of their own."""
    df, rows = messy
    assert rows_of(exact_dedup.exact_groups(df, size)) == brute_exact(rows)


def test_only_copies_go_where_ids_are_null_or_clash(spark):
    rows = [(7, "A"), (7, "B"), (3, "B"), (None, "one of a kind"), (None, "more  of it"), (9, "more   of it"), (None, None), (8, " \n"), (4, "also alone")]
    df = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    kept = [(*r, "en") for r in rows if r not in [(7, "B"), (None, "more  of it"), (None, None)]]
    out = exact_dedup.deduplicate(df)
    assert out.columns == df.columns and rows_of(out) == sorted(kept, key=repr)


def test_exact_groups_of_many_chunks(spark):
    rnd = random.Random(2)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(20000))
    rows = [(1, long), (2, long[:9000] + " " + long[9000:]), (3, long[:9000] + "z" + long[9000:]), (4, long[1:]), (5, "q" * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    limits = {"least": 64, "most": 1024, "bits": 7}
    assert len(exact_dedup.chunks(long.replace(" ", "").encode(), **limits)) > 20
    assert rows_of(exact_dedup.exact_groups(df, **limits)) == brute_exact(rows)
    shared = set(exact_dedup.chunks(long.encode(), **limits)) & set(exact_dedup.chunks((long[:9000] + "z" + long[9000:]).encode(), **limits))
    assert len(shared) > 20  # an insertion leaves the other chunks as they were
    assert sorted(r.doc_id for r in exact_dedup.deduplicate(df).collect()) == [2, 3, 4, 5]


def brute_windows(rows, window):
    first = {}
    for r in rows:
        w = split(r[1])
        if r[0] is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                first[k] = min(first.get(k, r[0]), r[0])
    out = []
    for r in rows:
        w = split(r[1])
        gone = {j for i in range(len(w) - window + 1) if r[0] is not None and first[tuple(w[i : i + window])] < r[0] for j in range(i, i + window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window, gram", [(13, 6), (5, 3)])
def test_repeated_windows(messy, window, gram):
    df, rows = messy
    assert rows_of(substring_dedup.remove_repeats(df, window, gram)) == brute_windows(rows, window)


def test_repeated_windows_settle_within_and_across_tasks(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOLD", 50)
    rnd = random.Random(5)
    passages = [" ".join(rnd.choice("abcdefghij") * 2 for _ in range(30)) for _ in range(3)]
    rows = [(i, " ".join([*(rnd.choice("klmnop") * 3 for _ in range(10)), passages[i % 3], *(rnd.choice("klmnop") * 3 for _ in range(10))])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = substring_dedup.remove_repeats(df, with_text=True)
    assert rows_of(got.drop("kept_text")) == brute_windows(rows, 13)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got.collect())


@pytest.mark.parametrize("rows, log2", [(1, 16), (2, 12), (1, 5)])
def test_a_sketch_never_says_less_than_there_is(spark, monkeypatch, rows, log2):
    """Levels of words that stand in few and in many texts, also with fewer cells than words and over many slices."""
    monkeypatch.setattr(sketch, "slice_log2", lambda log2: min(4, log2))
    monkeypatch.setattr(sketch, "BUCKET_BYTES", 300)
    texts = [" ".join([*(str(i) for i in range(a, a + 40)), *["common"] * 30]) for a in range(0, 400, 20)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    moved, parts, size = sketch.bucketed(df)
    assert size == sum(len(t or "") for t in texts)
    hash_of = lambda t: words_of(np.frombuffer(t.encode(), dtype=np.uint8), np.array([0, len(t.encode())])).hashes()
    values = lambda table: np.concatenate([hash_of(t or "") for t in table.column("text").to_pylist()])
    told = sketch.levels(moved, parts, values, rows, log2, (1, 64)).toArrow()
    of = {r.doc_id: r.bucket for r in moved.collect()}
    for i, t in enumerate(texts):
        own = sketch.Told(told.filter(pa.compute.equal(told["bucket"], of[i])), rows, log2, min(4, log2))
        level = own.level_of(hash_of(t or ""))
        want = [2 if w == "common" else int(20 <= int(w) < 400) for w in split(t)]
        assert (level >= want).all() and (log2 < 12 or (level == want).mean() > 0.9 if t else True)
    assert (sketch.unpack_sorted(sketch.pack_sorted(np.array([0, 3, 3, 2**31]))) == [0, 3, 3, 2**31]).all()


@pytest.mark.parametrize("docs, slice_log2", [(150, 22), (600, 9)])
def test_windows_that_pass_the_prefilter_are_in_proportion_to_repeated_ones(spark, monkeypatch, docs, slice_log2):
    """Also with many small slices: no part of the sketch is bounded by the input."""
    monkeypatch.setattr(sketch, "slice_log2", lambda log2: min(log2, slice_log2))
    monkeypatch.setattr(sketch, "BUCKET_BYTES", 20_000)
    rnd = random.Random(docs)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5))
    rows = [(i, " ".join(word() for _ in range(200))) for i in range(docs)]
    rows += [(docs + i, " ".join([*(word() for _ in range(50)), *rows[i][1].split()[20:70], *(word() for _ in range(50))])) for i in range(0, docs, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    _, left, _ = substring_dedup.candidates(df)
    sent = left.collect()
    windows = sum(int(sketch.from_planes(bytes(r.data), r.n, substring_dedup._RUN)[3].sum()) if not r.settled else r.n for r in sent)
    repeated = 2 * 38 * (docs // 10)
    assert repeated <= windows < 1.5 * repeated + 0.03 * 200 * docs
    assert rows_of(substring_dedup.remove_repeats(df)) == brute_windows(rows, 13)


def test_windows_are_compared_word_by_word(spark, monkeypatch):
    """With a hash that takes all windows for one, equal ones are still told from others."""
    monkeypatch.setattr(substring_dedup, "ngram_hashes", lambda w, n, salt=0: np.zeros(max(0, len(w) - n + 1), dtype=np.uint64))
    rnd = random.Random(1)
    text = " ".join(rnd.choice("abc") for _ in range(400)).encode()
    w = words_of(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))
    at = np.arange(388)
    number, own = substring_dedup.same_windows(w, at, 5), text.split()
    seen = {}
    assert [seen.setdefault(tuple(own[i : i + 5]), number[i]) == number[i] for i in at] == [True] * 388 and len(seen) == len(set(number.tolist()))


def brute_jaccard(rows, n, percent):
    sets = []
    for r in rows:
        w = split("".join(c.lower() if c.isascii() else c for c in r[1] or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    ids = sorted({r[0] for r in rows if r[0] is not None})
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and None not in (rows[a][0], rows[b][0]) and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(rows[a][0]), root(rows[b][0])
                up[max(p, q)] = min(p, q)
    return sorted(((r[0], len(s), None if r[0] is None else root(r[0])) for r, s in zip(rows, sets)), key=repr)


def test_near_duplicates_of_a_messy_table(messy):
    df, rows = messy
    assert rows_of(ngram_join.near_duplicates(df)) == brute_jaccard(rows, 4, 85)


@pytest.mark.parametrize("percent, block, small", [(85, 8192, None), (60, 4, None), (85, 3, 0), (85, 8192, 200)])
def test_near_duplicates_near_the_threshold(spark, monkeypatch, percent, block, small):
    """Small and large sets, blocks of few sets, all lists and all subsets."""
    if small is not None:
        monkeypatch.setattr(ngram_join, "boundary", lambda *a: small)
    rnd = random.Random(6)
    rows = []
    for g in range(14):
        base = [f"{g}w{i}" for i in range(rnd.choice([3, 5, 8, 12, 20, 30, 60, 150]))]
        for _ in range(rnd.randrange(1, 9)):
            own = list(base)
            for _ in range(rnd.randrange(0, max(2, len(own) // 12))):
                own[rnd.randrange(len(own))] = f"e{rnd.randrange(999)}"
            rows.append((rnd.randrange(10**6), " ".join(own) + rnd.choice(["", " The", "\n"])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    join = ngram_join.NgramJoin(df, 4, ngram_join.Threshold(percent), block, block)
    want = brute_jaccard(rows, 4, percent)
    assert rows_of(join.documents()) == want
    assert sorted(r.doc_id for r in df.join(join.documents().where("doc_id = component_id").select("doc_id"), "doc_id").distinct().collect()) == sorted({c for _, _, c in want})


def test_keys_always_meet():
    """Sets that link share a key, at every boundary and with any levels: of light shingles, or else by heavy ones alone."""
    rnd = np.random.default_rng(0)
    met = [0, 0]
    for t in (ngram_join.Threshold(85), ngram_join.Threshold(60)):
        for _ in range(1500):
            n = int(rnd.integers(2, 90))
            x = rnd.integers(0, 1 << 63, n, dtype=np.uint64)
            y = np.concatenate([x[: int(n * rnd.uniform(0.6, 1))], rnd.integers(0, 1 << 63, int(rnd.integers(0, 8)), dtype=np.uint64)])
            x, y = np.unique(x), np.unique(y)
            both = np.intersect1d(x, y)
            if len(y) and t.links(len(both), len(x) + len(y)) and len(both) < max(len(x), len(y)):
                light = np.uint64(rnd.choice([1, 2, 5, 50, 1000]))
                level = lambda s: np.where(np.isin(s, both) | (s % np.uint64(3) == 0), 1 + (s % light > 0) + (s % light > 20), 0)
                for small in (0, 10, 40, 500):
                    (a, p), (b, q) = ngram_join.keys_of(x, level(x), t, small), ngram_join.keys_of(y, level(y), t, small)
                    heavy = both[level(both) >= ngram_join.HEAVY]
                    alone = t.links(len(heavy), len(x) + len(y))
                    assert len(np.intersect1d(a, b)) or alone and len(np.intersect1d(p, q))
                    met[int(not len(np.intersect1d(a, b)))] += 1
    assert min(met) > 50


def test_boilerplate_makes_no_long_lists(spark, monkeypatch):
    """A passage that all documents share, with tails of their own: rows of the join stay in proportion to the documents, and links are right."""
    monkeypatch.setattr(ngram_join, "LEVELS", (1, 8, 100))
    rnd = random.Random(3)
    word = lambda: f"w{rnd.randrange(10**9)}"
    plate = [word() for _ in range(120)]
    shapes = [(120, rnd.randrange(0, 30)) for _ in range(150)] + [(rnd.randrange(60, 120), rnd.randrange(0, 12)) for _ in range(60)]
    rows = [(i, " ".join([*plate[:k], *(word() for _ in range(n))])) for i, (k, n) in enumerate(shapes)]
    rows += [(300 + i, " ".join([*plate[:40], *(word() for _ in range(100))])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    join = ngram_join.NgramJoin(df)
    assert rows_of(join.documents()) == brute_jaccard(rows, 4, 85)
    longest = join.sets.select("node", F.explode("keys").alias("key")).distinct().groupBy("key").count().agg(F.max("count")).first()[0]
    assert longest <= len({(k, k + n) for k, n in shapes}) < 120  # classes, not documents
    assert join.rows.where("doc_id >= 300 AND sig IS NOT NULL").count() == 0  # too little in common with any other


def test_boundary_is_the_cheapest():
    t = ngram_join.Threshold()
    assert ngram_join.boundary({}, t) == 0 and ngram_join.boundary({1000: 5}, t) == 0
    assert 7 <= ngram_join.boundary({8: 100, 12: 100, 400: 3}, t) <= 40


def test_components(spark):
    rnd = random.Random(8)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rnd.randrange(40), 100 + rnd.randrange(40)) for _ in range(30)] + [(300, 301 + i) for i in range(20)]
    up = {x: x for e in edges for x in e}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        p, q = root(a), root(b)
        up[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


def test_empty_tables(nothing):
    assert exact_dedup.exact_groups(nothing).count() == 0
    assert substring_dedup.remove_repeats(nothing).count() == 0
    assert ngram_join.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("kind", ["long", "binary"])
def test_components_of_few_edges_are_those_of_many(spark, monkeypatch, kind):
    """Few edges are joined at once, without the steps; both ways name each component by its smallest node."""
    from tessera.llm import components as c

    rnd, steps, plain = random.Random(4), [], c._is_star
    monkeypatch.setattr(c, "_is_star", lambda edges: steps.append(1) or plain(edges))
    pairs = [(i, i + 1) for i in range(40)] + [(100 + rnd.randrange(40), 100 + rnd.randrange(40)) for _ in range(25)] + [(7, 7), (-5, 200), (-5, -128)]
    node = (lambda i: i) if kind == "long" else (lambda i: (i & 255).to_bytes(1, "big") * 16)
    edges = spark.createDataFrame([(node(a), node(b)) for a, b in pairs], f"u {kind}, v {kind}")
    cell = lambda x: bytes(x) if kind == "binary" else x
    found = lambda: sorted((cell(r.node), cell(r.component)) for r in c.components(edges).collect())
    few = found()
    assert not steps and c.components(edges.limit(0)).count() == 0
    monkeypatch.setattr(c, "COLLECT_EDGES", 0)
    assert few == found() and steps
