import datetime as dt
import re

import pytest

from tessera import contract
from tessera.corpus import corpus, fingerprint
from tessera.sources import external, files, registry, synthetic  # noqa: F401


def test_roles_are_by_name_in_order():
    r = contract.classify(["record_id", "_x", "_blob_a_compressed_bytes", "blob_a_compressed_bytes", "blob_a_decompressed_bytes", "a_compressed_bytes", "brand_id"])
    assert r.identity == ("record_id",) and r.hidden == ("_x", "_blob_a_compressed_bytes")
    assert r.compressed == ("blob_a_compressed_bytes",) and r.decompressed == ("blob_a_decompressed_bytes",)
    assert r.feature == ("a_compressed_bytes", "brand_id")


def events(spark, ids=(0, 1, 2), extra=""):
    return spark.createDataFrame([(i, "b", 10 + i, 20 + i) for i in ids], f"record_id {'string' if isinstance(ids[0], str) else 'long'}, brand_id string, blob{extra}_a_compressed_bytes long, blob_a_decompressed_bytes long")


def queries(spark, names=("training", "validation")):
    return spark.createDataFrame([(i, dt.date(2023, 1, 1 + i), n) for i, n in enumerate(names)], "query_id long, query_time date, set_name string")


def log(spark, rows=((0, 0), (0, 0), (1, 1))):
    return spark.createDataFrame(list(rows), "record_id long, query_id long")


def test_a_corpus_sums_sizes_and_makes_the_log_a_set(spark):
    c = corpus(events(spark), queries(spark), log(spark))
    assert c.selections.count() == 2
    assert [r.compressed for r in c.events.orderBy("record_id").collect()] == [10, 11, 12]
    assert c.visible("training").count() == 1 and c.query_sets("all").count() == 2
    assert {r.query_id: r.compressed for r in files.selected_bytes(c).collect()} == {0: 10, 1: 11}
    with pytest.raises(ValueError):
        c.query_sets("other")


@pytest.mark.parametrize("ids", [(0, 0, 1), (1, 2, 3), (0, 1, 3), (None, 0, 1)])
def test_record_ids_have_to_be_a_sequence(spark, ids):
    with pytest.raises(contract.ContractViolation, match="record_id"):
        contract.check_arrival(spark.createDataFrame([(i,) for i in ids], "record_id long"))


def test_bad_tables_are_named(spark):
    with pytest.raises(contract.ContractViolation, match="blob_"):
        corpus(events(spark, extra="x"), queries(spark), log(spark))
    with pytest.raises(contract.ContractViolation, match="set_name"):
        corpus(events(spark), queries(spark, ("training", "test")), log(spark))
    with pytest.raises(contract.ContractViolation, match="query_id"):
        corpus(events(spark), queries(spark).drop("query_id"), log(spark))


def test_profile(spark):
    df = spark.createDataFrame([(1, "b", 1.5, dt.date(2023, 1, 2), True), (2, "a", float("nan"), dt.date(2023, 1, 1), None), (3, None, 10.0, None, False)], "n int, s string, d double, t date, f boolean")
    p = {r.name: r for r in contract.profile(df, ("n", "s", "d", "t", "f")).collect()}
    assert (p["s"].family, p["s"].cardinality, p["s"].minimum, p["s"]["values"]) == ("text", 2, None, ["a", "b"])
    assert (p["d"].cardinality, p["d"].minimum, p["d"].maximum, p["d"]["values"]) == (2, "1.5", "10.0", ["1.5", "10.0"])
    assert (p["t"].family, p["t"].minimum, p["t"].maximum) == ("temporal", "2023-01-01", "2023-01-02")
    assert (p["f"].family, p["f"].cardinality) == ("numeric", 2)
    many = spark.range(60).selectExpr("id as n")
    assert contract.profile(many, ("n",)).first()["values"] is None


def test_arrival_order(spark):
    rows = spark.createDataFrame([(i, i // 2) for i in range(20)], "record_id long, t int")
    contract.check_monotone(rows, "t")
    with pytest.raises(contract.ContractViolation):
        contract.check_monotone(rows.selectExpr("record_id", "case when record_id = 7 then 0 else t end as t"), "t")


def foreign(spark, tmp_path, form="csv", **change):
    e = [(f"vase-{i:03d}", f"fam{i % 3}", i % 5, 10 + i, 40 + 4 * i) for i in range(40)]
    q = [(f"visit-{i:03d}", f"2024-01-{1 + i:02d}", "training" if i < 6 else "validation") for i in range(12)]
    s = [(f"vase-{(7 * i + 3 * j) % 40:03d}", f"visit-{j:03d}") for j in range(12) for i in range(10)]
    tables = {
        "events": (["record_id", "cabinet", "shelf_row", "blob_img_compressed_bytes", "blob_img_decompressed_bytes"], e),
        "queries": (["query_id", "query_time", "set_name"], q), "selections": (["record_id", "query_id"], s),
    }
    for name, f in change.items():
        tables[name] = f(*tables[name])
    for name, (cols, rows) in tables.items():
        if rows is not None:
            (tmp_path / f"{name}.csv").write_text("\n".join([",".join(cols), *(",".join(map(str, r)) for r in rows)]) + "\n")
    return str(tmp_path)


def test_external_corpora_are_rekeyed_in_table_order(spark, tmp_path):
    src = foreign(spark, tmp_path)
    c = registry.provide(spark, "external", {"source": src, "out_dir": f"{src}/out"})
    rows = c.events.orderBy("record_id").collect()
    assert [r._source_record_key for r in rows] == [f"vase-{i:03d}" for i in range(40)] and [r.record_id for r in rows] == list(range(40))
    assert c.selections.count() == 120 and {f["name"] for f in c.feature_summary} == {"cabinet", "shelf_row"}
    again = registry.provide(spark, "external", {"source": src})
    assert fingerprint(again) == fingerprint(c)
    assert sum(r.compressed for r in files.selected_bytes_of(spark, f"{src}/out", c).collect()) == sum(r.compressed for r in files.selected_bytes(again).collect())


@pytest.mark.parametrize(
    "change",
    [
        {"events": lambda c, r: ([x.replace("blob_", "") for x in c], r)}, {"events": lambda c, r: (c[:-1], [x[:-1] for x in r])}, {"events": lambda c, r: (c, [*r, r[0]])},
        {"queries": lambda c, r: (c, None)}, {"selections": lambda c, r: (c, [*r, ("vase-999", "visit-000")])},
    ],
)
def test_external_corpora_that_break_the_contract_are_rejected(spark, tmp_path, change):
    with pytest.raises(contract.ContractViolation):
        registry.provide(spark, "external", {"source": foreign(spark, tmp_path, **change)})


def test_registry():
    assert {"curated", "external", "synthetic"} <= set(registry.Provider.kinds)
    with pytest.raises(KeyError, match="synthetic"):
        registry.provide(None, "nothing")


def test_synthetic_corpus(spark, tmp_path):
    cfg = {"events": 600, "days": 60, "query_days": 10, "half_life_days": 5.0, "seed": 808}
    c = registry.provide(spark, "synthetic", {**cfg, "out_dir": str(tmp_path / "a")})
    d = registry.provide(spark, "synthetic", {**cfg, "out_dir": str(tmp_path / "b")})
    assert fingerprint(c) == fingerprint(d) and c.dataset_id == d.dataset_id and len(c.dataset_id) == 16
    contract.check_monotone(c.events, "feature_transaction_date")
    per = c.queries.join(c.selections.groupBy("query_id").count(), "query_id", "left").collect()
    assert len(per) == 20 and all(r["count"] for r in per)
    late = c.selections.join(c.events, "record_id").join(c.queries, "query_id").where("feature_transaction_date > query_time").count()
    assert late == 0
    sets = {(r._query_type, r.set_name) for r in c.queries.collect()}
    assert len(sets) == 4
    assert c.events.where("compressed < 32 OR decompressed < 64 OR compressed >= decompressed").count() == 0
    assert not any(f["name"].startswith("_") for f in c.feature_summary)


def test_no_core_module_names_a_providers_column():
    import pathlib

    import tessera

    top = pathlib.Path(tessera.__file__).parent
    for p in [top / "contract.py", top / "corpus.py", *sorted((top / "operators").glob("*.py"))]:
        text = p.read_text()
        assert not re.search(r"[\"'](feature_|brand)|\bbrand_id\b", text), p
