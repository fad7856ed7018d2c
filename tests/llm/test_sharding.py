import pytest

from sieveline.llm import sharding

SMALL = {"target": 40_000, "runs": 3, "tier_bytes": 2_000}


def rows(spark, a, b):
    return spark.range(a, b).selectExpr("id as doc_id", "if(id % 7 = 0, null, repeat(sha2(cast(id as string), 256), 1)) as text", "id as c0").repartition(2)


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_plan_merges_similar_sizes():
    shards = [{"path": f"p{i}", "bytes": b} for i, b in enumerate([100, 90, 110, 1000, 90_000, 5000, 80, 5100])]
    due = sharding.plan(shards, 50_000, runs=4, ratio=4, tier_bytes=500)
    assert [sorted(g) for g in due] == [["p0", "p1", "p2", "p6"]]
    assert sharding.plan(shards, 250, runs=3, ratio=4, tier_bytes=500) and all(len(g) > 1 for g in sharding.plan(shards, 250, 3, 4, 500))
    assert sharding.plan([], 100) == []


def test_append_compact_read(spark):
    d = sharding.create(spark)
    for k in range(6):
        assert d.append(rows(spark, k * 100, k * 100 + 100)) == k + 1
    small = d.shards()
    assert len(small) == 12 and ids(d.read()) == list(range(600))
    first = {s["path"] for s in small}
    version = d.compact(**SMALL, keep=None)
    assert version > 6 and len(d.shards()) < 12 and sum(s["rows"] for s in d.shards()) == 600
    assert not sharding.plan(d.shards(), SMALL["target"], SMALL["runs"], sharding.RATIO, SMALL["tier_bytes"])
    assert ids(d.read()) == list(range(600)) and ids(d.read(3)) == list(range(300))
    before = sorted(map(str, rows(spark, 0, 600).collect()))
    assert sorted(map(str, d.read().collect())) == before
    assert d.compact(**SMALL) == version
    gone = d.vacuum(1)
    assert first & set(gone) and d.versions() == [version] and ids(d.read()) == list(range(600))


def test_commit_conflicts(spark):
    d = sharding.create(spark)
    d.append(rows(spark, 0, 50))
    version, manifest = d.current()
    assert not d._publish(version, manifest)
    other = sharding.Dataset(spark, d.folder)
    assert other.append(rows(spark, 50, 60)) == 2 and d.append(rows(spark, 60, 70)) == 3
    assert ids(d.read()) == list(range(70)) and ids(other.read()) == list(range(70))
    with pytest.raises(sharding.Conflict):
        d.commit([], {"not there"})


def test_odd_tables(spark):
    d = sharding.create(spark)
    with pytest.raises(ValueError):
        d.read()
    odd = spark.createDataFrame([(None, None, 1, 2), (1, "", 3, 4), (1, "", 3, 4), (2, "x" * 3_000_000, None, 5)], "doc_id long, text string, a int, b int").toDF("doc_id", "text", "A", "a")
    empty = odd.limit(0)
    d.append(empty)
    assert d.read().count() == 0 and d.compact() == 1
    for _ in range(5):
        d.append(odd, arrival_bytes=10)
    d.compact()
    got = d.read()
    assert got.columns == odd.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, odd.collect() * 5))
    with pytest.raises(ValueError):
        d.append(rows(spark, 0, 5))


def test_arrivals_are_all_rows_and_are_merged(spark):
    table = rows(spark, 0, 400).unionAll(spark.createDataFrame([(None, "x", 1), (7, "again", 2)], "doc_id long, text string, c0 long"))
    d = sharding.create(spark)
    parts = sharding.arrivals(table, "doc_id", 4)
    assert len(parts) == 4
    for part in parts:
        d.append(part)
    assert len(d.shards()) >= 4 and d.versions() == [1, 2, 3, 4]
    before, old = len(d.shards()), sorted(map(str, d.read(2).collect()))
    version = d.compact()
    assert len(d.shards()) < before and version > 4
    assert sorted(map(str, d.read().collect())) == sorted(map(str, table.collect()))
    assert sorted(map(str, d.read(2).collect())) == old  # older versions stay readable
    assert sharding.arrivals(table.limit(0), "doc_id", 4)[0].count() == 0


def test_two_compactions_at_once(spark, monkeypatch):
    d = sharding.create(spark)
    for k in range(4):
        d.append(rows(spark, k * 10, k * 10 + 10))
    other, commit = sharding.Dataset(spark, d.folder), d.commit

    def late(added, removed, **more):
        monkeypatch.setattr(d, "commit", commit)
        other.compact()
        return commit(added, removed, **more)

    monkeypatch.setattr(d, "commit", late)
    d.compact()
    assert ids(d.read()) == list(range(40))
    # what the loser wrote is gone, and so is a file that nobody listed
    from sieveline.llm import files

    with files.create(f"{d.folder}/shards/lost.parquet") as f:
        f.write(b"x")
    assert d.vacuum(1) and "lost.parquet" in dict(files.ages(f"{d.folder}/shards"))
    d.vacuum(1, 0)
    assert {n for n, _ in files.ages(f"{d.folder}/shards")} == {s["path"].rpartition("/")[2] for s in d.shards()}
