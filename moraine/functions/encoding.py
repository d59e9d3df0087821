"""Column expressions: sizes, checksums, keys, validation codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from moraine.schemas import KEY_LIMIT, VALUE_LIMIT


def make_key(number: Column) -> Column:
    """Zero-padded keys, so that byte order is numeric order."""
    return F.format_string("key_%012d", number)


def size_of(data: Column) -> Column:
    """Bytes of a string or binary column; a null has none."""
    return F.coalesce(F.octet_length(data), F.lit(0)).cast("long")


def log_record_size(is_tombstone: Column, key: Column, value: Column) -> Column:
    """Bytes of a log record: op, key length, key, (value length, value,) checksum."""
    return F.when(is_tombstone, F.lit(1 + 4 + 4) + size_of(key)).otherwise(F.lit(1 + 4 + 4 + 4) + size_of(key) + size_of(value)).cast("long")


def run_entry_size(is_tombstone: Column, key: Column, value: Column) -> Column:
    """Bytes of an entry of a sorted run: two lengths, key and value."""
    return (F.lit(8) + size_of(key) + F.when(is_tombstone, 0).otherwise(size_of(value))).cast("long")


def index_entry_size(key: Column) -> Column:
    """Bytes of an entry of a run's dense index: key length, key, offset."""
    return (F.lit(12) + size_of(key)).cast("long")


def _little(number: Column) -> Column:
    """A 32-bit little-endian integer as binary."""
    byte = lambda k: F.shiftleft(F.shiftright(number.cast("long"), 8 * k).bitwiseAND(F.lit(255)), 24 - 8 * k)
    return F.unhex(F.lpad(F.hex(byte(0) + byte(1) + byte(2) + byte(3)), 8, "0"))


def record_checksum(is_tombstone: Column, key: Column, value: Column) -> Column:
    """CRC-32 of a log record's fields."""
    put = F.concat(F.unhex(F.lit("01")), _little(size_of(key)), key, _little(size_of(value)), F.coalesce(value, F.unhex(F.lit(""))))
    return F.crc32(F.when(is_tombstone, F.concat(F.unhex(F.lit("02")), _little(size_of(key)), key)).otherwise(put))


def key_status(key: Column) -> Column:
    """``OK`` or ``INVALID_ARGUMENT`` for the key of a put, get or delete."""
    return F.when(key.isNull() | (F.octet_length(key) == 0) | (F.octet_length(key) > KEY_LIMIT), "INVALID_ARGUMENT").otherwise("OK")


def put_status(key: Column, value: Column) -> Column:
    return F.when((key_status(key) == "OK") & (size_of(value) <= VALUE_LIMIT), "OK").otherwise("INVALID_ARGUMENT")


def scan_status(start: Column, end: Column) -> Column:
    """Bounds may be empty, and are limited like keys."""
    return F.when((size_of(start) <= KEY_LIMIT) & (size_of(end) <= KEY_LIMIT), "OK").otherwise("INVALID_ARGUMENT")
