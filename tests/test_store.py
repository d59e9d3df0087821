"""The store over several lifetimes, its isolation, and get == scan on random histories."""

import random

import pytest

from moraine.schemas import KEY_LIMIT, VALUE_LIMIT
from moraine.sources.service import Client, RequestError, Service
from moraine.sources.store import Conflict, Store


def pairs(frame):
    return [(bytes(r["key"]), bytes(r["value"])) for r in frame.collect()]


def test_memory_and_reopen(spark, tmp_path):
    store = Store.open(spark, str(tmp_path))
    store.put(b"banana", b"1")
    store.put(b"apple", b"2")
    store.put(b"doomed", b"3")
    store.remove(b"doomed")
    store.remove(b"never written")
    store.put(b"empty", b"")
    store.put(b"\x80", b"high")
    wanted = [(b"apple", b"2"), (b"banana", b"1"), (b"empty", b""), (b"\x80", b"high")]
    assert store.get(b"banana") == b"1" and store.get(b"doomed") is None and store.get(b"empty") == b""
    assert pairs(store.scan()) == wanted
    store.close()
    again = Store.open(spark, str(tmp_path))
    assert pairs(again.scan()) == wanted and again.get(b"empty") == b"" and again.get(b"absent") is None


def test_ranges_and_limits(spark, tmp_path):
    store = Store.open(spark, str(tmp_path))
    for k in b"abcdef":
        store.put(bytes([k]), b"x")
    store.remove(b"b")
    keys = lambda *a: [k for k, _ in pairs(store.scan(*a))]
    assert keys(b"b", b"d") == [b"c"]
    assert keys(b"", b"c") == [b"a"]
    assert keys(b"e", b"") == [b"e", b"f"]
    assert keys(b"a", b"a") == [] and keys(b"d", b"b") == []
    assert keys(b"", b"", 2) == [b"a", b"c"]  # live rows only


def test_flush_compaction_and_tombstones(spark, tmp_path):
    store = Store.open(spark, str(tmp_path), memtable_bytes=1)
    for k in (b"doomed", b"a", b"b", b"c"):
        store.put(k, b"ghost")
    assert not store.segments(0) and len(store.segments(1)) == 1
    store.remove(b"doomed")
    assert store.get(b"doomed") is None  # an older run holds a value
    for k in (b"d", b"e", b"f"):
        store.put(k, b"new")
    assert len(store.segments(1)) == 2
    assert store.get(b"doomed") is None and b"doomed" not in dict(pairs(store.scan()))
    store.major_compact()
    assert len(store.manifest["segments"]) == 1 and store.manifest["segments"][0]["n_entries"] == 6
    assert store.vacuum()
    assert len(pairs(Store.open(spark, str(tmp_path)).scan())) == 6


def test_scans_are_isolated(spark, tmp_path):
    store = Store.open(spark, str(tmp_path))
    for k in range(5):
        store.put(b"key%d" % k, b"old")
    view = store.view()
    frame = view.scan()
    for k in range(5):
        store.put(b"key%d" % k, b"new")
    store.put(b"key9", b"new")
    store.flush()
    store.compact()
    assert pairs(frame) == [(b"key%d" % k, b"old") for k in range(5)]
    assert dict(pairs(store.scan()))[b"key0"] == b"new"


def test_second_writer_conflicts(spark, tmp_path):
    one, two = Store.open(spark, str(tmp_path)), Store.open(spark, str(tmp_path))
    one.put(b"k", b"1")
    with pytest.raises(Conflict):
        two.put(b"k", b"2")
    assert Store.open(spark, str(tmp_path)).get(b"k") == b"1"


def test_racing_writers(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from moraine.sources.files import Files

    for k in range(12):
        files = [Files(spark, str(tmp_path)) for _ in range(6)]
        with ThreadPoolExecutor(6) as pool:
            won = list(pool.map(lambda n: files[n].publish(f"version-{k}", str(n)), range(6)))
        assert sum(won) == 1 and files[0].read(f"version-{k}") == str(won.index(True))
    assert files[0].names() == sorted(f"version-{k}" for k in range(12))
    files[0]._local = False  # the way of other file systems
    assert files[0].publish("other", "a") and not files[0].publish("other", "b") and files[0].read("other") == "a"


def test_single_puts_are_durable(spark, tmp_path):
    store = Store.open(spark, str(tmp_path))
    for k in range(30):
        store.put(b"k%02d" % k, b"v" * k)
    store.remove(b"k03")  # neither synced nor closed
    again = Store.open(spark, str(tmp_path))
    assert again.get(b"k29") == b"v" * 29 and again.get(b"k03") is None and len(pairs(again.scan())) == 29
    again.put(b"new", b"x")
    third = Store.open(spark, str(tmp_path))
    assert third.get(b"new") == b"x" and len(pairs(third.scan())) == 30


def test_torn_and_foreign_logs():
    from moraine.sources.logfile import framed
    from moraine.sources.wal import record, records

    rows = [(1, b"key1", b"value1"), (1, b"key2", b""), (2, b"key1", None)]
    data = b"".join(record(*r) for r in rows)
    assert list(records(data)) == rows and list(records(b"")) == []
    for cut in range(1, len(record(*rows[2])) + 1):
        assert list(records(data[: len(data) - cut])) == rows[:2]
    damaged = bytearray(data)
    damaged[len(record(*rows[0])) + 6] ^= 1
    assert list(records(bytes(damaged))) == rows[:1]
    with pytest.raises(ValueError):
        list(records(data + b"\x07"))
    frames = b"".join(len(x).to_bytes(4, "little") + x for x in (b"entry1", b"", b"entry3"))
    assert list(framed(frames)) == list(framed(frames + b"\x01\x00")) == [b"entry1", b"", b"entry3"]
    with pytest.raises(EOFError):
        list(framed(frames[:-1]))


def test_log_file(spark, tmp_path):
    from moraine.sources.logfile import LogFile

    log = LogFile(spark, str(tmp_path), "log")
    assert log.read() == []
    for k in (1, 2, 3):
        log.append(b"entry%d" % k)
        assert log.read()[-1] == b"entry%d" % k
    log.close()
    assert LogFile(spark, str(tmp_path), "log").read() == [b"entry1", b"entry2", b"entry3"]


def batch(spark, rows):
    return spark.createDataFrame([(s, op, bytearray(k), None if v is None else bytearray(v)) for s, op, k, v in rows], "seq long, op int, key binary, value binary")


def test_batches_that_are_no_mutations(spark, tmp_path):
    store = Store.open(spark, str(tmp_path))
    for op, key in ((7, b"k"), (None, b"k")):
        with pytest.raises(ValueError):
            store.write(batch(spark, [(0, 1, b"a", b"1"), (1, op, key, b"2")]))
    with pytest.raises(ValueError):
        store.write(spark.createDataFrame([(0, 1, None, None)], "seq long, op int, key binary, value binary"))
    store.write(batch(spark, []))
    assert pairs(store.scan()) == [] and store.manifest["version"] == 0


def test_overwrites_are_bounded(spark, tmp_path):
    store = Store.open(spark, str(tmp_path), memtable_bytes=2000)
    for k in range(500):
        store.put(b"key", b"%05d" % k)
        assert store._held < 2000 and len(store._buffer) < 300
    assert store.get(b"key") == b"00499" and not store.manifest["segments"]  # one key never fills a memtable
    assert pairs(Store.open(spark, str(tmp_path)).scan()) == [(b"key", b"00499")]


def test_random_histories(spark, tmp_path):
    dice = random.Random(5)
    store, model = Store.open(spark, str(tmp_path), memtable_bytes=400), {}
    for step in range(90):
        key = b"k%02d" % dice.randrange(12)
        if dice.random() < 0.3:
            store.remove(key)
            model.pop(key, None)
        elif step % 11 == 10:  # a batch, over keys that were put before
            rows = [(k, dice.choice([1, 1, 2]), b"k%02d" % dice.randrange(12), b"b%d-%d" % (step, k)) for k in range(6)]
            store.write(batch(spark, rows))
            for _, op, k, v in rows:
                model.pop(k, None)
                if op == 1:
                    model[k] = v
        else:
            model[key] = b"v%d" % step
            store.put(key, model[key])
        if step % 11 in (4, 10):
            for k in range(0, 12, 3):
                assert store.get(b"k%02d" % k) == model.get(b"k%02d" % k)
        if step % 23 == 16:
            store.flush()
        if step in (50, 80):
            store.compact()
        if step == 60:
            store.major_compact()
        if step == 70:
            store = Store.open(spark, str(tmp_path), memtable_bytes=400)
            store.maintain()
    assert dict(pairs(store.scan())) == model
    for k in range(12):
        assert store.get(b"k%02d" % k) == model.get(b"k%02d" % k)
    asked = spark.createDataFrame([(bytearray(b"k%02d" % k),) for k in range(0, 12, 2)], "key binary")
    assert dict(pairs(store.multi_get(asked))) == {k: v for k, v in model.items() if int(k[1:]) % 2 == 0}


def test_requests(spark, tmp_path):
    client = Client(Service(Store.open(spark, str(tmp_path))))
    client.put(b"key", b"")
    client.put(b"x" * KEY_LIMIT, b"v")
    assert client.get(b"key") == b"" and client.get(b"other") is None
    client.remove(b"other")
    for bad in (lambda: client.put(b"", b"v"), lambda: client.put(b"x" * (KEY_LIMIT + 1), b"v"), lambda: client.put(b"k", b"x" * (VALUE_LIMIT + 1)), lambda: client.scan(b"x" * (KEY_LIMIT + 1))):
        with pytest.raises(RequestError) as error:
            bad()
        assert error.value.code == "INVALID_ARGUMENT"
    assert [k for k, _ in client.scan(b"", b"l")] == [b"key"]


def test_stream_into_store(spark, tmp_path):
    from pyspark.sql import functions as F

    from moraine.streaming.ingest import ingest

    rows = spark.range(200).select(F.col("id").alias("seq"), F.when(F.col("id") % 7 == 0, 2).otherwise(1).cast("byte").alias("op"), F.concat(F.lit("k"), (F.col("id") % 20).cast("string")).cast("binary").alias("key"), F.col("id").cast("string").cast("binary").alias("value"))
    rows.repartition(3, "seq").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = Store.open(spark, str(tmp_path / "store"))
    ingest(source, store, str(tmp_path / "progress")).awaitTermination()
    last = {b"k%d" % (i % 20): (i % 7 == 0, b"%d" % i) for i in range(200)}
    assert dict(pairs(Store.open(spark, str(tmp_path / "store")).scan())) == {k: v for k, (dead, v) in last.items() if not dead}
