"""Versions of a database, and genes among ranges of very different widths."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cladeloom.operators import build, index
from cladeloom.plans import engine


def small(spark, n):
    taxa = spark.createDataFrame([("all", None, 0, ["all"]), ("a", "all", 1, ["all", "a"]), ("b", "all", 1, ["all", "b"])], "name string, parent string, level int, path array<string>")
    levels = spark.createDataFrame([(1, "G1", "all", 1.0, 6, 1)], "fam long, id string, level string, completeness double, n_genes long, ord long")
    entries = spark.createDataFrame([(f"p{i}", "ab"[i % 2], "G1") for i in range(n)], "prot_id string, species string, group string")
    records = spark.createDataFrame([(f"p{i}", f"p{i}", "ACDEFGHIKLMNPQRSTVWY"[i:] + "ACDEFG") for i in range(n)], "header string, id string, seq string")
    return levels, entries, records, taxa


def test_versions(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "db")
    old = engine.create(spark, path, *small(spark, 4))
    assert old.members.count() == 4 and engine.snapshots(spark, path) == [1]
    with pytest.raises(FileExistsError):
        engine.create(spark, path, *small(spark, 5))
    for step in ("store", "write"):  # the build dies before the postings, and before the metadata
        with monkeypatch.context() as m:
            m.setattr(*((index, "store") if step == "store" else (engine, "table_hash")), lambda *a, **k: 1 / 0)
            with pytest.raises(ZeroDivisionError), pytest.warns(UserWarning):
                engine.create(spark, path, *small(spark, 5), overwrite=True)
        again = engine.Database.open(spark, path)
        assert again.members.count() == 4 and again.postings.count() == old.postings.count()
    with pytest.warns(UserWarning):
        new = engine.create(spark, path, *small(spark, 5), overwrite=True)
    assert engine.snapshots(spark, path) == [1, 2] and engine.Database.open(spark, path).members.count() == new.members.count() == 5
    assert old.members.count() == 4 and old.postings.count() > 0  # a reader of the old version


def test_wide_and_narrow_ranges(spark):
    rng = random.Random(2)
    ranges = [(f"s{i}", 3 * i, 3 * i) for i in range(2000)] + [("wide", 10_000, 10_000 + 10**9), ("last", 10**9 + 20_000, 10**9 + 20_001)]
    genes = [rng.randrange(-5, 7000) for _ in range(3000)] + [rng.randrange(9_000, 10**9 + 30_000) for _ in range(500)] + [10**9 + 20_001] + [9] * 2000
    got = build.species_of_genes(spark.createDataFrame([(g, str(g)) for g in genes], "gene long, note string").repartition(5), spark.createDataFrame(ranges, "species string, min_id long, max_id long"))
    inside = lambda g: f"s{g // 3}" if 0 <= g < 6000 and g % 3 == 0 else "wide" if 10_000 <= g <= 10_000 + 10**9 else "last" if g in (10**9 + 20_000, 10**9 + 20_001) else None
    assert sorted(map(tuple, got.collect())) == sorted((g, str(g), inside(g)) for g in genes if inside(g))
    crossed = spark.createDataFrame([("a", 1, 5), ("b", 5, 9)], "species string, min_id long, max_id long")
    with pytest.raises(ValueError, match="overlap"):
        build.species_of_genes(spark.range(3).select(F.col("id").alias("gene")), crossed)
