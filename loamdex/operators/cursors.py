"""Positions in a result: self-contained tokens, or short handles kept beside the index."""

from __future__ import annotations

import base64
import hashlib
import json
import secrets
import time
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamdex.errors import CursorError
from loamdex.operators.ranking import Rank
from loamdex.sources.files import Files

# Life of a short handle, and tries for a free one.
TTL_MS, TRIES = 3_600_000, 3


def query_hash(schema_json: str, query: str, rank: Rank) -> str:
    """What a cursor is bound to; limit and shown fields are not part of it."""
    return hashlib.sha256("\n".join([schema_json, query, json.dumps(rank.key(), separators=(",", ":"))]).encode()).hexdigest()


def encode(payload: dict[str, Any], digest: str) -> str:
    body = json.dumps({"payload": payload, "hash": digest}, separators=(",", ":"), ensure_ascii=False)
    return base64.urlsafe_b64encode(body.encode()).decode().rstrip("=")


def encoded(payload: Column, digest: str) -> Column:
    """encode of a position in columns; numbers may be written otherwise, and are read as the same."""
    body = F.base64(F.to_json(F.struct(payload.alias("payload"), F.lit(digest).alias("hash"))).cast("binary"))
    return F.translate(body, "+/=\r\n", "-_")


def decode(token: str) -> dict[str, Any]:
    try:
        body = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
        if not isinstance(body["payload"], dict) or not isinstance(body["hash"], str):
            raise ValueError("not a position")
        return body
    except (ValueError, KeyError, TypeError) as e:
        raise CursorError(f"not a cursor: {e}") from e


class ShortCursors:
    """Handles c:<24 hex digits> in a small file beside the index; expired ones go at every use. Without a file they live in memory."""

    def __init__(self, files: Files | None = None, path: str | None = None):
        self.files, self.path, self.memory = files, path, {}

    def _load(self, now: int) -> dict[str, Any]:
        held = self.memory
        if self.path and self.files.exists(self.path):
            held = json.loads(self.files.read(self.path))
        return {k: v for k, v in held.items() if v["expires"] > now}

    def _save(self, held: dict[str, Any]) -> None:
        self.memory = held
        if self.path:
            self.files.replace(self.path, json.dumps(held))

    def put(self, position: dict[str, Any], now: int | None = None) -> str:
        now = int(time.time() * 1000) if now is None else now
        held = self._load(now)
        for _ in range(TRIES):
            handle = secrets.token_hex(12)
            if handle not in held:
                held[handle] = {"position": position, "expires": now + TTL_MS}
                self._save(held)
                return f"c:{handle}"
        raise CursorError("no free handle")

    def get(self, token: str, now: int | None = None) -> dict[str, Any]:
        held = self._load(int(time.time() * 1000) if now is None else now)
        self._save(held)
        found = held.get(token.removeprefix("c:"))
        if found is None:
            raise CursorError("the cursor is unknown or has expired")
        return found["position"]
