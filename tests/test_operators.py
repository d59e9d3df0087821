"""Golden cases of single operators."""

import pytest
from pyspark.sql import functions as F

from moraine.operators import bloom, maintain, merge, read, wal


def run(spark, rows):
    return spark.createDataFrame(rows, "key string, value string, is_tombstone boolean")


def test_compaction_cases(spark):
    live = lambda k, v: (k, v, False)
    dead = lambda k: (k, None, True)
    cases = [
        ([live("1", "a"), live("2", "b")], [live("3", "c"), live("4", "d")], [("1", "a", False), ("2", "b", False), ("3", "c", False), ("4", "d", False)]),
        ([live("1", "a"), live("2", "b")], [live("1", "c"), live("2", "d")], [("1", "c", False), ("2", "d", False)]),
        ([live("1", "a"), live("2", "b")], [dead("1"), dead("2")], [("1", None, True), ("2", None, True)]),
        ([live("1", "a"), live("3", "a"), live("5", "a")], [live("2", "b"), live("4", "b"), live("6", "b")], [(str(k), "ab"[k % 2 == 0], False) for k in range(1, 7)]),
    ]
    for older, newer, want in cases:
        both = merge.union_runs(run(spark, newer), run(spark, older))
        assert [tuple(r) for r in maintain.compacted(both).orderBy("key").collect()] == want


def test_put_delete_put_and_limit(spark):
    runs = merge.union_runs(run(spark, [("k", "last", False)]), run(spark, [("k", None, True), ("a", None, True)]), run(spark, [("k", "first", False), ("a", "old", False), ("z", "z", False)]))
    assert [tuple(r) for r in read.scan(runs, limit=1).collect()] == [("k", "last")]
    assert read.get(runs, "a").count() == 0
    assert read.lookup(runs.where("src = 1"), "a").first()["is_tombstone"]


def test_bloom_parameters():
    assert bloom.parameters(1) == (10, 7)
    assert bloom.parameters(10_000) == (95_851, 7)
    assert bloom.parameters(1, 0.5) == (2, 2)
    assert bloom.parameters(0) == bloom.parameters(1)


def test_memtable_bytes(spark):
    log = spark.createDataFrame([(0, "key1", "value1", False)], "seq long, key string, value string, is_tombstone boolean")
    assert maintain.memtable_bytes(maintain.memtable(log)).first()["n_bytes"] == 10
    assert maintain.memtable_bytes(maintain.memtable(log.limit(0))).first()["n_bytes"] == 0


def test_replay_stops_at_damage(spark):
    log = spark.createDataFrame([(0, "key1", "value1", False), (1, "key2", "value2", False), (2, "key1", None, True)], "seq long, key string, value string, is_tombstone boolean")
    state = lambda f: {r["key"]: r["value"] for r in merge.live(f).collect()}
    assert state(wal.replayed(log)) == {"key2": "value2"}
    assert state(wal.replayed(log, F.col("seq") == 2)) == {"key1": "value1", "key2": "value2"}
    assert state(wal.replayed(log, F.col("seq") == 0)) == {}


@pytest.mark.parametrize("n", [0, 1, 37])
def test_numbered(spark, n):
    rows = spark.range(n).selectExpr("lpad(string(id), 4, '0') AS key")
    assert [(r["pos"], r["key"]) for r in read.numbered(rows).orderBy("pos").collect()] == [(k + 1, f"{k:04d}") for k in range(n)]


def test_numbered_many_keys(spark):
    """More rows than range bounds are sampled from, with a payload that is used."""
    n = 1_200_000
    rows = spark.range(n).selectExpr("format_string('key_%012d', id * 7919 % 1200007) AS key", "repeat('v', cast(id % 9 as int)) AS value")
    got = read.numbered(rows).selectExpr("count(*)", "count(DISTINCT pos)", "min(pos)", "max(pos)", "sum(length(value))").first()
    assert tuple(got) == (n, n, 1, n, sum(k % 9 for k in range(n)))
    assert read.numbered(rows).selectExpr("pos", "lead(key) OVER (PARTITION BY pos div 1000 ORDER BY pos) > key AS up").where("not up").count() == 0


def test_running_sums_by_group(spark):
    from moraine.operators.running import running

    rows = spark.range(5000).selectExpr("if(id % 5 = 0, NULL, id % 3) AS g", "id AS o", "id % 7 AS x")
    got = running(rows, F.col("x"), "o", ("g",)).collect()
    sums: dict = {}
    for r in sorted(got, key=lambda r: r["o"]):
        assert r["before"] == sums.get(r["g"], 0)
        sums[r["g"]] = r["before"] + r["x"]
    assert len(got) == 5000 and running(rows.limit(0), F.col("x"), "o").count() == 0


def test_bloom_forms(spark, monkeypatch):
    keys = spark.range(3000).selectExpr("concat('key', id) AS key")
    asked = spark.range(1500, 6000).selectExpr("concat('key', id) AS key")
    for n in (1, 3000):
        bits, hashes = bloom.parameters(n)
        filled = bloom.bits_of(keys.limit(n), bits, hashes)
        near = {tuple(r) for r in bloom.might_contain(asked, filled, bits, hashes).collect()}
        with monkeypatch.context() as m:
            m.setattr(bloom, "PACKED_BITS", 0)
            assert near == {tuple(r) for r in bloom.might_contain(asked, filled, bits, hashes).collect()}
        data = bytes(bloom.packed(filled, bits).select(bloom.serialised(F.col("words"), bits, hashes).alias("d")).first()["d"])
        assert int.from_bytes(data[:8], "little") == bits and int.from_bytes(data[8:16], "little") == hashes and len(data) == 16 + -(-bits // 8)
        assert {b for b in range(bits) if data[16 + b // 8] >> b % 8 & 1} == {r["bit"] for r in filled.collect()}
        again = spark.createDataFrame([(bytearray(data),)], "d binary").select(bloom.deserialised(F.col("d")).alias("f")).first()["f"]
        assert (again["bits"], again["hashes"]) == (bits, hashes) and again["words"] == bloom.packed(filled, bits).first()["words"]
    for cut in (data[:15], data[:-1]):
        with pytest.raises(Exception, match="cut off"):
            spark.createDataFrame([(bytearray(cut),)], "d binary").select(bloom.deserialised(F.col("d")).alias("f")).collect()


def test_bloom_filter_of_many_words(spark):
    """Time grows with the words of a filter, not with their square; blocks without a bit have their words."""
    import random
    import time

    words = 32 * bloom.BLOCK_WORDS
    bits = 64 * words - 13
    on = sorted({*random.Random(7).sample(range(bits // 2), 5000), bits - 1})
    filled = spark.createDataFrame([(b,) for b in on], "bit long")
    want = [0] * words
    for b in on:
        want[b // 64] |= 1 << b % 64
    raw = b"".join(x.to_bytes(8, "little") for x in [bits, 7, *want])[: 16 + -(-bits // 8)]
    assert bytes(bloom.packed(filled, bits).select(bloom.serialised(F.col("words"), bits, 7).alias("d")).first()["d"]) == raw
    started = time.monotonic()
    for data in (raw, raw + b"more"):
        f = spark.createDataFrame([(bytearray(data),)], "d binary").select(bloom.deserialised(F.col("d")).alias("f")).first()["f"]
        assert (f["bits"], f["hashes"]) == (bits, 7) and [w % 2**64 for w in f["words"]][:-1] == want[:-1]
    assert time.monotonic() - started < 15
