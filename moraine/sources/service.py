"""The request interface: validation, status codes, and a client that raises.

Spark Connect carries DataFrames between processes; this facade keeps the request semantics.
"""

from __future__ import annotations

from collections.abc import Iterator

from moraine.schemas import KEY_LIMIT, VALUE_LIMIT
from moraine.sources.store import Store


class RequestError(RuntimeError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def _check(key: bytes, what: str = "key", empty: bool = False) -> None:
    if not key and not empty:
        raise RequestError("INVALID_ARGUMENT", f"{what} is empty")
    if len(key) > KEY_LIMIT:
        raise RequestError("INVALID_ARGUMENT", f"{what} has more than {KEY_LIMIT} bytes")


class Service:
    """Requests against a store.  ``Get`` of an absent key is NOT_FOUND; deletes always succeed."""

    def __init__(self, store: Store):
        self._store = store

    def Put(self, key: bytes, value: bytes) -> None:
        _check(key)
        if len(value) > VALUE_LIMIT:
            raise RequestError("INVALID_ARGUMENT", f"value has more than {VALUE_LIMIT} bytes")
        self._store.put(key, value)

    def Get(self, key: bytes) -> bytes:
        _check(key)
        value = self._store.get(key)
        if value is None:
            raise RequestError("NOT_FOUND", "no such key")
        return value

    def Delete(self, key: bytes) -> None:
        _check(key)
        self._store.remove(key)

    def Scan(self, start_key: bytes = b"", end_key: bytes = b"", limit: int = 0) -> Iterator[tuple[bytes, bytes]]:
        _check(start_key, "start_key", empty=True)
        _check(end_key, "end_key", empty=True)
        rows = self._store.scan(start_key, end_key, limit)
        return ((bytes(r["key"]), bytes(r["value"] or b"")) for r in rows.toLocalIterator())


class Client:
    def __init__(self, service: Service):
        self._service = service

    def put(self, key: bytes, value: bytes) -> None:
        self._service.Put(key, value)

    def get(self, key: bytes) -> bytes | None:
        try:
            return self._service.Get(key)
        except RequestError as error:
            if error.code == "NOT_FOUND":
                return None
            raise

    def remove(self, key: bytes) -> None:
        self._service.Delete(key)

    def scan(self, start: bytes = b"", end: bytes = b"", limit: int = 0) -> list[tuple[bytes, bytes]]:
        return list(self._service.Scan(start, end, limit))
