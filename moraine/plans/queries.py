"""Every operator as a query over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.functions import encoding
from moraine.operators import bloom, maintain, merge, read, stats, wal
from moraine.plans.inputs import events_log, orders_log, runs, tiers
from moraine.schemas import MEMTABLE_BYTES, PUT, REMOVE
from moraine.sources.files import shared_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The inputs of plans.inputs in SQL.
_LOG = """log AS (
  SELECT event_id AS seq, printf('user_%012d', user_id) AS key, event_type = 'error' AS is_tombstone,
         CASE WHEN event_type <> 'error' THEN event_type || '|' || props END AS value,
         event_id * 10 // (SELECT count(*) FROM events) AS slice
  FROM events)"""
_RUNS = _LOG + """, placed AS (
  SELECT *, CASE WHEN slice >= 5 THEN 9 - slice WHEN slice >= 1 THEN 5 ELSE 6 END::INT AS src FROM log), runs AS (
  SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY src, key ORDER BY seq DESC) = 1)"""
_LIVE = _RUNS + """, merged AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY key ORDER BY src) = 1), live AS (
  SELECT key, value FROM merged WHERE NOT is_tombstone)"""
_ORDERS = """orders_log AS (
  SELECT o_orderkey AS seq, printf('key_%012d', o_orderkey) AS key, o_orderstatus || '|' || o_orderpriority AS value FROM orders)"""


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


# scans


@query(f"WITH {_LIVE} SELECT key, value FROM live ORDER BY key LIMIT 10")
def scan_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.scan(runs(spark, sf_dir), limit=10)


@query(f"WITH {_LIVE} SELECT key, value FROM live")
def scan_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.scan(runs(spark, sf_dir))


_A, _B = "user_000000000010", "user_000000000060"


@query(f"WITH {_LIVE} SELECT key, value FROM live WHERE key >= '{_A}' AND key < '{_B}'")
def scan_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.scan(runs(spark, sf_dir), _A, _B)


@query(f"WITH {_LIVE} SELECT key, value FROM live WHERE key < '{_B}'")
def scan_open_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.scan(runs(spark, sf_dir), "", _B)


@query(f"WITH {_LIVE} SELECT key, value FROM live WHERE key >= '{_A}'")
def scan_open_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.scan(runs(spark, sf_dir), _A, "")


@query(f"WITH {_LIVE} SELECT key, value FROM live WHERE key >= '{_A}' AND key < '{_A}'")
def scan_empty_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.scan(runs(spark, sf_dir), _A, _A)


@query(f"WITH {_LIVE} SELECT key, src::INT AS src FROM merged WHERE is_tombstone")
def scan_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys that a scan hides, and the run whose tombstone hides each."""
    return merge.merged(runs(spark, sf_dir)).where("is_tombstone").select("key", "src")


@query(f"WITH {_LIVE} SELECT row_number() OVER (ORDER BY key) AS pos, key, value FROM live")
def scan_ordered_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.numbered(merge.live(merge.merged(runs(spark, sf_dir))).select("key", "value")).select("pos", "key", "value")


@query(f"WITH {_LIVE} SELECT key, src::INT AS src, is_tombstone, value FROM merged")
def scan_merge_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merged(runs(spark, sf_dir)).select("key", "src", "is_tombstone", "value")


_KEYED = _ORDERS + """, runs AS (
  SELECT key, value, false AS is_tombstone, 2 AS src FROM orders_log UNION ALL SELECT key, NULL, true, 1 FROM orders_log WHERE seq % 7 = 0
  UNION ALL SELECT key, 'again|' || value, false, 0 FROM orders_log WHERE seq % 11 = 0), merged AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY key ORDER BY src) = 1)"""


def _keyed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of unique keys, one of deletions of some of them, and one that writes some again."""
    log = orders_log(spark, sf_dir)
    gone = log.where("seq % 7 = 0").select("key", F.lit(None).cast("string").alias("value"), F.lit(True).alias("is_tombstone"))
    again = log.where("seq % 11 = 0").select("key", F.concat(F.lit("again|"), "value").alias("value"), F.lit(False).alias("is_tombstone"))
    return merge.union_runs(again, gone, log.select("key", "value", "is_tombstone"))


@query(f"WITH {_KEYED} SELECT row_number() OVER (ORDER BY key) AS pos, key, value FROM merged WHERE NOT is_tombstone")
def scan_many_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.numbered(read.scan(_keyed_runs(spark, sf_dir))).select("pos", "key", "value")


@query(f"WITH {_KEYED} SELECT key, value, is_tombstone FROM merged")
def compact_many_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.compacted(_keyed_runs(spark, sf_dir))


# point reads


def _get(name: str, key: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return read.get(runs(spark, sf_dir), key)

    run.__name__ = name
    query(f"WITH {_LIVE} SELECT key, value FROM live WHERE key = '{key}'")(run)


_get("point_get_hit", "user_000000000007")
_get("point_get_miss", "user_999999999999")


@query(f"WITH {_LIVE} SELECT key, count(*) OVER () AS n_hidden FROM merged WHERE is_tombstone AND key NOT IN (SELECT key FROM live) ORDER BY key LIMIT 1")
def point_get_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first deleted key; its lookup must give no row although older runs hold values."""
    hidden = merge.merged(runs(spark, sf_dir)).where("is_tombstone").select("key")
    found = read.multi_get(runs(spark, sf_dir), hidden).select(F.col("key").alias("_found"))
    absent = hidden.join(found, hidden.key == F.col("_found"), "left_anti")
    total = absent.agg(F.count("*").alias("n_hidden"))
    first = absent.orderBy("key").limit(1)
    return first.join(F.broadcast(total), F.lit(True))  # a single row


@query(f"WITH {_RUNS} SELECT key, src::INT AS src, is_tombstone, value FROM runs WHERE src >= 1 QUALIFY row_number() OVER (PARTITION BY key ORDER BY src) = 1")
def multi_level_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the levels answer, below the memtable: the newest run of level 0 first, level 1 last."""
    return merge.merged(runs(spark, sf_dir).where("src >= 1")).select("key", "src", "is_tombstone", "value")


@query(f"WITH {_LIVE} SELECT key, value FROM live WHERE key IN (SELECT printf('user_%012d', c_custkey * 3) FROM customer)")
def multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.format_string("user_%012d", F.col("c_custkey") * 3).alias("key"))
    return read.multi_get(runs(spark, sf_dir), keys)


@query(f"WITH {_RUNS} SELECT key, is_tombstone, value FROM runs WHERE src = 0 AND key < '{_A}'")
def memtable_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the memtable knows of some keys: absent keys have no row, deleted ones a tombstone."""
    tail = maintain.memtable(tiers(events_log(spark, sf_dir)).where("src = 0"))
    return merge.in_range(tail, "", _A).select("key", "is_tombstone", "value")


@query(f"WITH {_RUNS} SELECT key, is_tombstone, value FROM runs WHERE src = 2 AND key = 'user_000000000012'")
def segment_get_trivalued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.lookup(runs(spark, sf_dir).where("src = 2"), "user_000000000012")


# writes, memtable, snapshots


@query(f"WITH {_LOG} SELECT key, seq, value FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1 AND NOT is_tombstone")
def put_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.live(merge.latest(events_log(spark, sf_dir))).select("key", "seq", "value")


@query(f"WITH {_LOG}, twice AS (SELECT key, seq, is_tombstone, value FROM log UNION ALL SELECT key, seq + 1000000000, true, NULL FROM log WHERE is_tombstone) SELECT key, count(*) FILTER (WHERE is_tombstone) AS n_deletes, arg_max(is_tombstone, seq) AS deleted FROM twice GROUP BY key")
def delete_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleting deleted keys again leaves them deleted."""
    log = events_log(spark, sf_dir).select("key", "seq", "is_tombstone", "value")
    again = log.where("is_tombstone").select("key", (F.col("seq") + 1_000_000_000).alias("seq"), "is_tombstone", "value")
    both = log.unionByName(again)
    counted = both.groupBy("key").agg(F.count_if("is_tombstone").alias("n_deletes"))
    state = merge.latest(both).select(F.col("key").alias("_key"), F.col("is_tombstone").alias("deleted"))
    return counted.join(state, F.col("key") == F.col("_key")).select("key", "n_deletes", "deleted")


@query(f"WITH {_RUNS} SELECT key, is_tombstone, value, seq FROM runs WHERE src = 0")
def memtable_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.memtable(tiers(events_log(spark, sf_dir)).where("src = 0"))


@query(f"WITH {_RUNS} SELECT count(*) AS n_keys, (sum(strlen(key)) + sum(coalesce(strlen(value), 0)))::BIGINT AS n_bytes FROM runs WHERE src = 0")
def memtable_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.memtable_bytes(maintain.memtable(tiers(events_log(spark, sf_dir)).where("src = 0")))


@query(f"WITH {_RUNS} SELECT row_number() OVER (ORDER BY key) AS pos, key, is_tombstone FROM runs WHERE src = 0")
def memtable_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = maintain.memtable(tiers(events_log(spark, sf_dir)).where("src = 0"))
    return read.numbered(tail.select("key", "is_tombstone")).select("pos", "key", "is_tombstone")


@query(f"WITH {_LOG} SELECT key, seq, value FROM (SELECT * FROM log WHERE slice < 6) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1 AND NOT is_tombstone")
def snapshot_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after six tenths of the log; later writes do not show."""
    return merge.live(merge.latest(events_log(spark, sf_dir).where("slice < 6"))).select("key", "seq", "value")


# flush and compaction


@query(f"WITH {_LOG} SELECT slice, key, is_tombstone, value, seq FROM log QUALIFY row_number() OVER (PARTITION BY slice, key ORDER BY seq DESC) = 1")
def flush_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.flushed(events_log(spark, sf_dir), "slice").select("slice", "key", "is_tombstone", "value", "seq")


@query("SELECT flush_no, count(*) AS n_entries, flush_no % 4 = 3 AS compacts FROM (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 565 AS flush_no FROM orders) GROUP BY flush_no")
def flush_trigger_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flushes of a 64 KiB memtable under appends of 116 bytes; every fourth triggers a compaction."""
    rows = read.numbered(orders_log(spark, sf_dir).select("key")).withColumn("i", F.col("pos") - 1)
    flushes = maintain.flush_numbers(rows, "i", 116, 64 * 1024).groupBy("flush_no").agg(F.count("*").alias("n_entries"))
    return flushes.withColumn("compacts", F.col("flush_no") % 4 == 3)


@query(f"WITH {_RUNS} SELECT key, is_tombstone, value FROM runs WHERE src = 1")
def segment_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).where("src = 1").select("key", "is_tombstone", "value").orderBy("key")


@query(f"WITH {_RUNS} SELECT src, count(*) AS n_entries, sum(is_tombstone::INT)::BIGINT AS n_tombstones, min(key) AS min_key, max(key) AS max_key FROM runs GROUP BY src")
def segment_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.bounds(runs(spark, sf_dir), "src")


_ENTRY = "(8 + strlen(key) + coalesce(strlen(value), 0))"


@query(f"WITH {_RUNS} SELECT src, key, {_ENTRY}::BIGINT AS entry_bytes, coalesce(sum({_ENTRY}) OVER (PARTITION BY src ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS entry_offset FROM runs")
def sstable_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.offsets(runs(spark, sf_dir), "src").select("src", "key", "entry_bytes", "entry_offset")


@query(f"WITH {_RUNS}, s AS (SELECT src, sum({_ENTRY})::BIGINT AS data_bytes, sum(12 + strlen(key))::BIGINT AS index_bytes, (16 + ceil(ceil(-count(*) * ln(0.01) / (ln(2) * ln(2))) / 8))::BIGINT AS filter_bytes FROM runs GROUP BY src) SELECT *, data_bytes + index_bytes + filter_bytes + 24 AS file_bytes FROM s")
def sstable_file_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.file_size(runs(spark, sf_dir), "src")


def _compact(name: str, where: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return maintain.compacted(runs(spark, sf_dir).where(where))

    run.__name__ = name
    query(f"WITH {_RUNS} SELECT key, value, is_tombstone FROM (SELECT * FROM runs WHERE {where}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY src) = 1")(run)


_compact("compact_pair", "src IN (3, 4)")
_compact("compact_l0_to_l1", "src BETWEEN 1 AND 4")
_compact("compact_tombstones_only", "src BETWEEN 1 AND 4 AND is_tombstone")


@query(f"WITH {_LIVE} SELECT key, value FROM live")
def major_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.major_compacted(runs(spark, sf_dir))


# log


@query(f"WITH {_LOG} SELECT seq, (CASE WHEN is_tombstone THEN 9 + strlen(key) ELSE 13 + strlen(key) + strlen(value) END)::BIGINT AS record_bytes FROM log")
def wal_record_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events_log(spark, sf_dir)
    return log.select("seq", encoding.log_record_size(F.col("is_tombstone"), F.col("key"), F.col("value")).alias("record_bytes"))


@query()
def wal_crc32(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events_log(spark, sf_dir)
    return log.select("seq", encoding.record_checksum(F.col("is_tombstone"), F.col("key").cast("binary"), F.col("value").cast("binary")).alias("crc"))


_NEWEST = "QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1"


@query(f"WITH {_LOG} SELECT key, value, is_tombstone, seq FROM log {_NEWEST}")
def wal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wal.replayed(events_log(spark, sf_dir))


@query(f"WITH {_LOG}, bad AS (SELECT min(seq) AS first FROM log WHERE seq % 997 = 996) SELECT key, value, is_tombstone, seq FROM (SELECT log.* FROM log, bad WHERE first IS NULL OR seq < first) {_NEWEST}")
def wal_replay_corrupt_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose stored checksum does not match end the replay; here some have been damaged."""
    log = events_log(spark, sf_dir)
    true = encoding.record_checksum(F.col("is_tombstone"), F.col("key").cast("binary"), F.col("value").cast("binary"))
    log = log.withColumn("crc", F.when(F.col("seq") % 997 == 996, true + 1).otherwise(true))
    return wal.replayed(log, F.col("crc") != true)


@query(f"WITH {_LOG} SELECT seq, key, value, 4 + strlen(key)::BIGINT AS framed_bytes FROM log")
def log_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A length-prefixed log: written, and read back in order."""
    from moraine.sources.logfile import append, entries

    log = events_log(spark, sf_dir).select("seq", "key", "value")
    folder = f"{shared_folder(spark)}/logfile-{uuid.uuid4().hex}"
    append(log, folder)
    return entries(spark, folder).select("seq", "key", "value", (F.octet_length("key") + F.lit(4)).cast("long").alias("framed_bytes"))


# pruning


@query(f"WITH {_RUNS} SELECT src, min_key, max_key FROM (SELECT src, min(key) AS min_key, max(key) AS max_key FROM runs GROUP BY src) WHERE min_key <= '{_A}' AND max_key >= '{_A}'")
def range_prune_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = maintain.bounds(runs(spark, sf_dir), "src")
    return known.where((F.col("min_key") <= _A) & (F.col("max_key") >= _A)).select("src", "min_key", "max_key")


@query("""WITH p AS (SELECT unnest([1, 10, 100, 1000, 10000, 100000])::BIGINT AS n, 0.01 AS rate UNION ALL SELECT 1, 0.5),
m AS (SELECT n, rate::DOUBLE AS rate, ceil(-n * ln(rate) / (ln(2) * ln(2)))::BIGINT AS bits FROM p)
SELECT n, rate, bits, greatest(1, ceil(bits / n * ln(2)))::BIGINT AS hashes FROM m""")
def bloom_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(n, 0.01) for n in (1, 10, 100, 1000, 10000, 100000)] + [(1, 0.5)], "n long, rate double")
    bits, hashes = bloom.parameter_columns(F.col("n"), F.col("rate"))
    return rows.withColumn("bits", bits).withColumn("hashes", hashes)


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_name").alias("key"))


_BITS = """m AS (SELECT ceil(-count(*) * ln(0.01) / (ln(2) * ln(2)))::BIGINT AS bits, count(*) AS n FROM customer),
k AS (SELECT bits, greatest(1, ceil(bits / n * ln(2)))::BIGINT AS hashes FROM m),
asked AS (SELECT c_name AS key, true AS member FROM customer UNION ALL SELECT 'Other#' || c_custkey, false FROM customer),
probes AS (SELECT key, member, (h1 + i * h2) % bits AS bit FROM (
  SELECT key, member, ('0x' || substr(md5(key), 1, 8))::BIGINT AS h1, ('0x' || substr(md5(key), 9, 8))::BIGINT AS h2 FROM asked), k, range(0, 7) r(i)),
filled AS (SELECT DISTINCT bit FROM probes WHERE member)"""


def _filter(spark: SparkSession, sf_dir: str):
    keys = _customers(spark, sf_dir)
    bits, hashes = bloom.parameters(keys.count())
    return keys, bits, hashes, bloom.bits_of(keys, bits, hashes)


@query(f"WITH {_BITS} SELECT bit::BIGINT AS bit FROM filled")
def bloom_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filter(spark, sf_dir)[3]


@query(f"""WITH {_BITS}, w AS (SELECT bit // 8 AS at, sum(1 << (bit % 8)) AS b FROM filled GROUP BY 1)
SELECT bits, hashes, (16 + ceil(bits / 8))::BIGINT AS n_bytes, upper(string_agg(printf('%02x', coalesce(b, 0)::INT), '' ORDER BY r.at)) AS body
FROM m, (SELECT greatest(1, ceil(bits / n * ln(2)))::BIGINT AS hashes FROM m), (SELECT unnest(range((ceil((SELECT bits FROM m) / 8))::BIGINT)) AS at) r LEFT JOIN w ON w.at = r.at GROUP BY ALL""")
def bloom_serialised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter written as binary and read again: its header, size and bits."""
    _, bits, hashes, filled = _filter(spark, sf_dir)
    binary = bloom.packed(filled, bits).select(bloom.serialised(F.col("words"), bits, hashes).alias("data"))
    again = binary.select("data", bloom.deserialised(F.col("data")).alias("f"))
    body = F.array_join(F.transform("f.words", bloom._bytes), "")
    return again.select("f.bits", "f.hashes", F.octet_length("data").cast("long").alias("n_bytes"), F.substring(body, F.lit(1), (2 * F.ceil(F.col("f.bits") / 8)).cast("int")).alias("body"))


_PROBED = _BITS + ", answer AS (SELECT key, member, count(*) = count(f.bit) AS maybe FROM probes LEFT JOIN filled f USING (bit) GROUP BY key, member)"


@query(f"WITH {_PROBED} SELECT key, maybe FROM answer")
def bloom_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, bits, hashes, filled = _filter(spark, sf_dir)
    others = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("Other#"), F.col("c_custkey").cast("string")).alias("key"))
    return bloom.might_contain(keys.unionByName(others), filled, bits, hashes)


@query(f"WITH {_PROBED} SELECT count(*) AS n, count(*) FILTER (WHERE NOT maybe) AS n_missed FROM answer WHERE member")
def bloom_no_false_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, bits, hashes, filled = _filter(spark, sf_dir)
    return bloom.might_contain(keys, filled, bits, hashes).agg(F.count("*").alias("n"), F.count_if(~F.col("maybe")).alias("n_missed"))


@query(f"WITH {_PROBED} SELECT count(*) AS n, count(*) FILTER (WHERE maybe) AS n_false, count(*) FILTER (WHERE maybe) < 0.03 * count(*) AS good FROM answer WHERE NOT member")
def bloom_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, bits, hashes, filled = _filter(spark, sf_dir)
    others = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("Other#"), F.col("c_custkey").cast("string")).alias("key"))
    answer = bloom.might_contain(others, filled, bits, hashes).agg(F.count("*").alias("n"), F.count_if("maybe").alias("n_false"))
    return answer.withColumn("good", F.col("n_false") < 0.03 * F.col("n"))


# requests



@query("""WITH c AS (SELECT doc_id, printf('doc_%012d', doc_id) AS key, text AS value FROM documents
  UNION ALL SELECT -1, '', 'v' UNION ALL SELECT -2, 'k', '' UNION ALL SELECT -3, repeat('x', 65536), 'v' UNION ALL SELECT -4, repeat('x', 65537), 'v'
  UNION ALL SELECT -5, 'k', repeat('y', 1048576) UNION ALL SELECT -6, 'k', repeat('y', 1048577))
SELECT doc_id, CASE WHEN strlen(key) = 0 OR strlen(key) > 65536 OR coalesce(strlen(value), 0) > 1048576 THEN 'INVALID_ARGUMENT' ELSE 'OK' END AS status FROM c""")
def validate_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.format_string("doc_%012d", "doc_id").alias("key"), F.col("text").alias("value"))
    edge = spark.range(1, 7).select(
        (-F.col("id")).alias("doc_id"),
        F.expr("CASE id WHEN 1 THEN '' WHEN 3 THEN repeat('x', 65536) WHEN 4 THEN repeat('x', 65537) ELSE 'k' END").alias("key"),
        F.expr("CASE id WHEN 2 THEN '' WHEN 5 THEN repeat('y', 1048576) WHEN 6 THEN repeat('y', 1048577) ELSE 'v' END").alias("value"),
    )
    return rows.unionByName(edge).select("doc_id", encoding.put_status(F.col("key"), F.col("value")).alias("status"))


@query("""WITH n AS (SELECT unnest([0, 1, 65536, 65537])::BIGINT AS n), c AS (SELECT a.n AS start_bytes, b.n AS end_bytes FROM n a, n b)
SELECT start_bytes, end_bytes, CASE WHEN start_bytes <= 65536 AND end_bytes <= 65536 THEN 'OK' ELSE 'INVALID_ARGUMENT' END AS status FROM c""")
def validate_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = [0, 1, 65536, 65537]
    rows = spark.createDataFrame([(a, b) for a in sizes for b in sizes], "start_bytes long, end_bytes long")
    bound = lambda c: F.expr(f"repeat('k', cast({c} as int))")
    return rows.withColumn("status", encoding.scan_status(bound("start_bytes"), bound("end_bytes")))


@query(f"WITH {_LIVE}, asked AS (SELECT printf('user_%012d', c_custkey) AS key FROM customer UNION ALL SELECT '') SELECT a.key, CASE WHEN a.key = '' THEN 'INVALID_ARGUMENT' WHEN l.key IS NULL THEN 'NOT_FOUND' ELSE 'OK' END AS status, l.value FROM asked a LEFT JOIN live l ON a.key = l.key")
def rpc_get_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.format_string("user_%012d", "c_custkey").alias("key"))
    return read.get_status(runs(spark, sf_dir), keys.unionByName(spark.range(1).select(F.lit("").alias("key"))))


# store and stream


def _mutations(log: DataFrame) -> DataFrame:
    return log.select("seq", F.when(F.col("is_tombstone"), REMOVE).otherwise(PUT).cast("byte").alias("op"), F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))


@query(f"WITH {_LOG}, live AS (SELECT * FROM log {_NEWEST}) SELECT key, value FROM live WHERE NOT is_tombstone")
def open_discover_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves of the log written and flushed, a third part left in the log; reopened and scanned."""
    from moraine.sources.store import Store

    path, log = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", events_log(spark, sf_dir)
    store = Store.open(spark, path, MEMTABLE_BYTES)
    for part in ("slice < 4", "slice >= 4 and slice < 8"):
        store.write(_mutations(log.where(part)))
        store.flush()
    store.write(_mutations(log.where("slice >= 8")))
    store.close()
    return Store.open(spark, path).scan().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query(f"WITH {_LOG}, live AS (SELECT * FROM log {_NEWEST}) SELECT key, seq, value FROM live WHERE NOT is_tombstone")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log read as a stream of files, appended by micro-batches, merged by ``seq``."""
    from moraine.streaming.ingest import ingest_files

    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    log = events_log(spark, sf_dir)
    log.select("seq", "key", "is_tombstone", "value").repartition(4, "seq").write.parquet(f"{base}/in")
    source = spark.readStream.schema("seq long, key string, is_tombstone boolean, value string").option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    ingest_files(source, f"{base}/log", f"{base}/progress").awaitTermination()
    return merge.live(merge.latest(spark.read.parquet(f"{base}/log"))).select("key", "seq", "value")


# statistics


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, any_value(n) AS n, max(value) FILTER (WHERE k = n * 50 // 100) AS p50, max(value) FILTER (WHERE k = n * 99 // 100) AS p99 FROM r GROUP BY event_type""")
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.latency_stats(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", "event_type")


@query("SELECT o_orderkey AS i, printf('key_%012d', o_orderkey) AS key FROM orders")
def make_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("i"), encoding.make_key(F.col("o_orderkey")).alias("key"))
