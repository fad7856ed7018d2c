import io
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from sieveline.llm import files, sstable

needs_vocabulary = pytest.mark.skipif(not os.path.exists(sstable.VOCABULARY), reason="needs the vocabulary file")


def write_one(tmp_path, entries, block_bytes=64):
    import zstandard

    path = str(tmp_path / "one.sst")
    w = sstable.Writer(files.create(path), 2, block_bytes)
    zip_ = zstandard.ZstdCompressor()
    for doc_id, ids in entries:
        w.add(sstable.key_of(doc_id), b"" if ids is None else zip_.compress(np.array(ids, np.uint16).tobytes()), len(ids or ()))
    assert w.close() == os.path.getsize(path)
    return sstable.Shard(files.read_at(path))


def listed(found):
    return [None if x is None else x.tolist() for x in found]


def test_shard(tmp_path):
    rnd = random.Random(1)
    ids = sorted(rnd.sample(range(-(10**6), 10**6), 500)) + [2**63 - 1]
    entries = [(-(2**63), [1])] + [(i, [i & 0xFFFF, 7]) for i in ids[:-1]] + [(ids[-1], None)]
    shard = write_one(tmp_path, entries)
    assert len(shard.index) > 10 and shard.entries == len(entries)
    assert [(i, None if v is None else v.tolist()) for i, v in shard.scan()] == entries
    for i, v in entries:
        assert listed(shard.get(i)) == [v]
    others = [i for i in range(-(10**6), 10**6, 997) if i not in set(ids)]
    assert all(shard.get(i) == [] for i in others)
    assert sum(map(shard.may_have, others)) < len(others) * 0.05


def test_repeated_keys_over_blocks(tmp_path):
    entries = [(1, [1])] + [(5, [k]) for k in range(100)] + [(9, [])]
    shard = write_one(tmp_path, entries)
    assert listed(shard.get(5)) == [[k] for k in range(100)] and listed(shard.get(9)) == [[]] and shard.get(6) == []


def test_keys_share_prefixes(tmp_path):
    shard = write_one(tmp_path, [(i, []) for i in range(256)], 1 << 20)
    assert int(shard.index["length"][0]) < 256 * (2 + 8 + 1 + 9)


def test_damage_is_seen(tmp_path):
    write_one(tmp_path, [(i, [i]) for i in range(50)])
    raw = bytearray((tmp_path / "one.sst").read_bytes())
    raw[5] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(sstable.Shard(pa.PythonFile(io.BytesIO(raw), "r")).scan())
    with pytest.raises(ValueError, match="not a shard"):
        sstable.Shard(pa.PythonFile(io.BytesIO(bytes(200)), "r"))
    with pytest.raises(ValueError, match="order"):
        write_one(tmp_path, [(2, []), (1, [])])


@needs_vocabulary
def test_round_trip(spark):
    with open(sstable.VOCABULARY, "rb") as f:
        encoding, _ = sstable.tokenizer(f.read(), sstable.PATTERN)
    rnd = random.Random(2)
    rows = [(rnd.randint(-50, 10**9), " ".join(rnd.choice(["hello", "wörld", "漢字", "<|endoftext|>", "x1\n"]) for _ in range(rnd.randint(0, 300)))) for _ in range(300)]
    rows += [(3, None), (4, ""), (5, "same"), (5, "same"), (5, "other"), (None, "no key"), (6, "long text " * 100_000)]
    df = spark.createDataFrame([(d, t, "s", 1) for d, t in rows], "doc_id long, text string, path string, shard int").repartition(3)
    store = sstable.write(df, shard_bytes=1 << 18, block_bytes=512, least_bytes=1 << 12)
    assert store.shards.count() > 3
    want = sorted((d, None if t is None else encoding.encode_ordinary(t)) for d, t in rows if d is not None and t is not None)
    got = store.scan().collect()
    assert sorted((r.doc_id, r.tokens) for r in got if r.tokens is not None) == want
    assert [(r.doc_id, r.n_tokens) for r in got if r.tokens is None] == [(3, None)]
    assert all(encoding.decode(r.tokens) in {t for d, t in rows if d == r.doc_id} for r in got if r.tokens is not None)
    wanted = [5, 3, 4, 77777777777, rows[0][0], 5, None]
    found = store.lookup(spark.createDataFrame([(i,) for i in wanted], "doc_id long")).collect()
    expect = [(d, t) for d, t in rows if d in {5, 3, 4, rows[0][0]}]
    assert sorted((r.doc_id, str(r.tokens)) for r in found) == sorted((d, str(None if t is None else encoding.encode_ordinary(t))) for d, t in expect)
    ranges = sorted((r.first_id, r.last_id) for r in store.shards.collect())
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))


@needs_vocabulary
def test_very_long_runs(spark):
    with open(sstable.VOCABULARY, "rb") as f:
        encoding, _ = sstable.tokenizer(f.read(), sstable.PATTERN)
    short = "a" + " " * 60_000 + "b \n\n c" * 9000
    assert sstable.encode(encoding, short) == encoding.encode_ordinary(short)
    rows = [(1, "a" + " " * 10_000_000 + "b"), (2, "\n\t " * 1_000_000), (3, "x" * 1_000_000), (4, "!" * 300_000 + "7" * 300_000)]
    store = sstable.write(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: encoding.decode(r.tokens) for r in store.lookup(spark.range(9).toDF("doc_id")).collect()} == dict(rows)


@needs_vocabulary
def test_empty(spark):
    store = sstable.write(spark.createDataFrame([], "doc_id long, text string"))
    assert store.scan().count() == 0 and store.lookup(spark.range(3).toDF("doc_id")).count() == 0
