"""Answers of a data provider kept by content, the requests that led to them, and run folders: all written once.

Paths are folders of a file system that every process of a deployment mounts; nothing here is a table, and nothing is read
by executors. No credential is ever written: headers are kept by an allow-list.
"""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from pathlib import Path

#: Headers of an answer that are kept.
KEPT_HEADERS = ("content-type", "date", "etag", "last-modified", "x-request-id")
VERSION = 1


class ArchiveError(RuntimeError):
    """A record that contradicts what is stored, or can't be trusted."""


def digest(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


def canonical(value) -> bytes:
    return (json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n").encode()


def write_once(path: Path, content: bytes) -> None:
    """Writes a file that must not exist; the same content again is fine, another is an error."""
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.{os.getpid()}")
    part.write_bytes(content)
    try:
        os.link(part, path)  # fails where the file is there: two writers can't both win
    except FileExistsError:
        if path.read_bytes() != content:
            raise ArchiveError(f"another content at {path}") from None
    finally:
        part.unlink()


@dataclass(frozen=True)
class Answer:
    url: str
    status: int
    headers: dict
    body: bytes
    received_at: datetime


class Archive:
    """Bodies under their SHA-256, and per request a folder of the answers it had.

    A request is identified by the provider, the adapter's version, the licence, the timeframe and the address; only
    answers of status 200 serve a request again, newest first, up to an age.
    """

    def __init__(self, root: str, provider: str, licence: str, adapter: str = "1"):
        self.root, self.identity = Path(root), {"provider": provider, "licence": licence, "adapter": adapter}

    def key(self, url: str, timeframe: str) -> str:
        return digest(canonical(self.identity | {"url": url, "timeframe": timeframe}))

    def keep(self, a: Answer, timeframe: str) -> str:
        """Stores an answer and what it answered; gives the digest of its body."""
        body = digest(a.body)
        write_once(self.root / "bodies" / body[:2] / body, a.body)
        stamp = a.received_at.astimezone(UTC).strftime("%Y%m%dT%H%M%S%fZ")
        kept = {k.lower(): v for k, v in sorted(a.headers.items()) if k.lower() in KEPT_HEADERS}
        record = self.identity | {"version": VERSION, "url": a.url, "timeframe": timeframe, "status": a.status, "headers": kept, "received_at": stamp, "body": body}
        folder = "requests" if a.status == 200 else "failures"
        write_once(self.root / folder / self.key(a.url, timeframe) / f"{stamp}-{body}.json", canonical(record))
        return body

    def cached(self, url: str, timeframe: str, now: datetime, max_age: timedelta) -> Answer | None:
        """The newest answer to a request that isn't older than max_age; None without one.

        A record from the future, of another request or version, or whose body is lost, changed or outside the archive is
        an error, not a miss: whoever reads must not go on as if nothing were stored.
        """
        key = self.key(url, timeframe)
        for path in sorted((self.root / "requests" / key).glob("*.json"), reverse=True):
            try:
                r = json.loads(path.read_bytes())
                at = datetime.strptime(r["received_at"], "%Y%m%dT%H%M%S%fZ").replace(tzinfo=UTC)
                same = r["version"] == VERSION and r["status"] == 200 and self.key(r["url"], r["timeframe"]) == key and all(r[k] == v for k, v in self.identity.items())
                name = r["body"]
            except (ValueError, KeyError, TypeError) as e:
                raise ArchiveError(f"no record of an answer: {path}") from e
            if not same or at > now:
                raise ArchiveError(f"not an answer to this request: {path}")
            if now - at > max_age:
                return None  # all others are older
            if len(name) != 64 or any(c not in "0123456789abcdef" for c in name):
                raise ArchiveError(f"a body outside the archive: {path}")
            file = self.root / "bodies" / name[:2] / name
            if not file.is_file() or digest(content := file.read_bytes()) != name:
                raise ArchiveError(f"the body is lost or changed: {path}")
            return Answer(r["url"], 200, r["headers"], content, at)
        return None

    def transport(self, live, timeframe: str, max_age: timedelta, clock, only_cached: bool = False):
        """A transport (see rest.Transport) that asks the archive first and keeps what live answers."""

        def get(url: str) -> tuple[int, dict, str]:
            hit = self.cached(url, timeframe, clock(), max_age)
            if hit is None and only_cached:
                raise ArchiveError(f"not in the archive: {url}")
            if hit is None:
                status, headers, body = live(url)
                hit = Answer(url, status, headers, body.encode(), clock())
                self.keep(hit, timeframe)
            return hit.status, hit.headers, hit.body.decode()

        return get


class RunFolder:
    """A folder of one run's artifacts, named by its time, each with its SHA-256 in the manifest that closes it."""

    def __init__(self, root: str, at: datetime, config: Path | None = None):
        self.path = Path(root) / at.astimezone(UTC).strftime("%Y%m%dT%H%M%S%fZ")
        self.config, self.files = config, {}
        self.config_hash = digest(config.read_bytes()) if config else None
        if self.path.exists():
            raise ArchiveError(f"there is a run at {self.path}")

    def write(self, name: str, content: bytes) -> None:
        write_once(self.path / name, content)
        self.files[name] = digest(content)

    def close(self, **more) -> dict:
        """Writes the manifest; a configuration that changed during the run is an error."""
        if self.config and digest(self.config.read_bytes()) != self.config_hash:
            raise ArchiveError("the configuration changed during the run")
        manifest = {"files": self.files, "config": self.config_hash, **more}
        write_once(self.path / "manifest.json", canonical(manifest))
        return manifest
