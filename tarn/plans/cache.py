"""Result cache: least-recently-used rows on the driver over a durable SQLite table, both per index version."""

from __future__ import annotations

import json
import sqlite3
import threading
from collections import OrderedDict
from contextlib import closing, suppress
from datetime import UTC, datetime

from tarn.operators.query import parse


def cache_key(query: str, mode: str, k: int, use_mmr: bool, version: str) -> tuple:
    """Queries that parse to the same tree share an entry; operators' case matters, white space doesn't."""
    parsed = parse(query)
    return (repr(parsed.root) if parsed.root is not None else f"none:{parsed.error}:{' '.join(query.lower().split())}", mode, k, use_mmr, version)


class LRUCache:
    def __init__(self, capacity: int):
        if capacity <= 0:
            raise ValueError("the capacity must be positive")
        self.capacity, self._rows, self._lock = capacity, OrderedDict(), threading.Lock()

    def get(self, key):
        with self._lock:
            if key not in self._rows:
                return None
            self._rows.move_to_end(key)
            return self._rows[key]

    def put(self, key, value) -> None:
        with self._lock:
            self._rows[key] = value
            self._rows.move_to_end(key)
            while len(self._rows) > self.capacity:
                self._rows.popitem(last=False)

    def remove(self, key) -> bool:
        with self._lock:
            return self._rows.pop(key, None) is not None

    def clear(self) -> None:
        with self._lock:
            self._rows.clear()

    def __len__(self) -> int:
        return len(self._rows)

    def __contains__(self, key) -> bool:
        return key in self._rows


class SQLiteCache:
    """Never raises: whatever goes wrong with the file is a miss."""

    def __init__(self, path: str, version: str):
        self.path, self.version = path, version

    def _run(self, sql: str, values: tuple = ()):
        with closing(sqlite3.connect(self.path, timeout=5)) as db, db:
            db.execute("CREATE TABLE IF NOT EXISTS answers (asked TEXT PRIMARY KEY, of_index TEXT NOT NULL, rows TEXT NOT NULL, stored TEXT NOT NULL)")
            cursor = db.execute(sql, values)
            return cursor.fetchone() if cursor.description else cursor.rowcount

    def get(self, key):
        with suppress(sqlite3.Error, ValueError, TypeError):
            row = self._run("SELECT of_index, rows FROM answers WHERE asked = ?", (json.dumps(key),))
            if row and row[0] == self.version and isinstance(found := json.loads(row[1]), list):
                return found
        return None

    def put(self, key, value: list) -> None:
        with suppress(sqlite3.Error, ValueError, TypeError):
            self._run("INSERT OR REPLACE INTO answers VALUES (?, ?, ?, ?)", (json.dumps(key), self.version, json.dumps(value), datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")))

    def remove(self, key) -> bool:
        with suppress(sqlite3.Error, ValueError, TypeError):
            return self._run("DELETE FROM answers WHERE asked = ?", (json.dumps(key),)) > 0
        return False

    def clear(self) -> None:
        with suppress(sqlite3.Error):
            self._run("DELETE FROM answers")


class CacheManager:
    def __init__(self, capacity: int, path: str | None, version: str):
        self.near, self.far = LRUCache(capacity), SQLiteCache(path, version) if path else None

    def get(self, key):
        if (found := self.near.get(key)) is None and self.far and (found := self.far.get(key)) is not None:
            self.near.put(key, found)
        return found

    def put(self, key, value: list) -> None:
        self.near.put(key, value)
        if self.far:
            self.far.put(key, value)

    def remove(self, key) -> bool:
        near, far = self.near.remove(key), self.far.remove(key) if self.far else False
        return near or far

    def clear(self) -> None:
        self.near.clear()
        if self.far:
            self.far.clear()

    def __len__(self) -> int:
        return len(self.near)
