"""Replication feeds: sequence numbers, states and files below a base URI."""

from __future__ import annotations

import datetime as dt
import gzip
import io
import os
import re
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from typing import BinaryIO, TypeVar

BASE_URI, BATCH_SIZE, DB_URI, PARTITION_COUNT = "base_uri", "batch_size", "db_uri", "partition_count"
PROC_NAME, START_SEQUENCE, END_SEQUENCE, ERROR_HANDLER = "proc_name", "start_sequence", "end_sequence", "error_handler"
#: Attempts for a file that isn't there yet, and seconds between them.
RETRIES, RETRY_DELAY = "retries", "retry_delay"
STATE_TTL = 30.0


class Missing(Exception):
    """What was asked for isn't there (or may not be read)."""


def read_uri(uri: str) -> bytes:
    """Content of a file, http(s) or s3 URI; Missing where it isn't there."""
    parsed = urllib.parse.urlparse(uri)
    if parsed.scheme in ("", "file"):
        try:
            with open(parsed.path or uri, "rb") as f:
                return f.read()
        except FileNotFoundError as e:
            raise Missing(uri) from e
    if parsed.scheme in ("http", "https"):
        try:
            with urllib.request.urlopen(uri, timeout=60) as r:
                return r.read()
        except urllib.error.HTTPError as e:
            if e.code in (403, 404):
                raise Missing(uri) from e
            raise OSError(f"{uri}: {e}") from e
    if parsed.scheme in ("s3", "s3a"):
        import boto3
        from botocore.exceptions import ClientError

        try:
            return boto3.client("s3").get_object(Bucket=parsed.netloc, Key=parsed.path.lstrip("/"))["Body"].read()
        except ClientError as e:
            if e.response.get("Error", {}).get("Code") in ("NoSuchKey", "404", "403", "AccessDenied"):
                raise Missing(uri) from e
            raise OSError(f"{uri}: {e}") from e
    raise ValueError(f"no reader for {uri}")


def join_uri(base: str, name: str) -> str:
    return base.rstrip("/") + "/" + name


def sequence_path(sequence: int, suffix: str) -> str:
    """AAA/BBB/CCC and suffix of a sequence number."""
    s = f"{sequence:09d}"
    return f"{s[:3]}/{s[3:6]}/{s[6:]}{suffix}"


T = TypeVar("T")


def retried(read: Callable[[], T], retries: int, delay: float, until: Callable[[], bool] | None = None) -> T:
    """What ``read`` gives, tried again where it is missing or broken off; Missing in the end, or once ``until`` holds."""
    for attempt in range(retries + 1):
        try:
            return read()
        except (Missing, OSError):
            if attempt == retries or until is not None and until():
                raise
            time.sleep(delay)
    raise AssertionError


def opened_uri(uri: str) -> BinaryIO:
    """A stream of the unzipped content of a URI, of which only a file on a disk is never in memory as a whole."""
    parsed = urllib.parse.urlparse(uri)
    if parsed.scheme in ("", "file"):
        try:
            f: BinaryIO = open(parsed.path or uri, "rb")  # noqa: SIM115
        except FileNotFoundError as e:
            raise Missing(uri) from e
    else:
        f = io.BytesIO(read_uri(uri))
    zipped = f.read(2) == b"\x1f\x8b"
    f.seek(0)
    return gzip.GzipFile(fileobj=f) if zipped else f


# --------------------------------------------------------------------------- state

_memo: dict[str, tuple[float, object]] = {}
_memo_lock = threading.Lock()


def memoised(key: str, make: Callable[[], object], ttl: float = STATE_TTL) -> object:
    """A value made at most once in ``ttl`` seconds."""
    with _memo_lock:
        if key in _memo and time.monotonic() - _memo[key][0] < ttl:
            return _memo[key][1]
    value = make()
    with _memo_lock:
        _memo[key] = (time.monotonic(), value)
    return value


def parse_properties(text: str) -> dict[str, str]:
    """Java properties: comments, and escaped colons."""
    out = {}
    for line in text.splitlines():
        if line.strip() and line.lstrip()[0] not in "#!":
            k, _, v = line.partition("=")
            out[k.strip()] = v.strip().replace("\\:", ":")
    return out


def parse_yaml(text: str) -> dict[str, str]:
    """A flat YAML mapping of scalars."""
    out = {}
    for line in text.splitlines():
        if line.strip() not in ("", "---", "...") and not line.lstrip().startswith("#"):
            k, _, v = line.partition(":")
            out[k.strip().lstrip(":")] = v.strip().strip("'\"")
    return out


def parse_time(s: str) -> dt.datetime:
    """Times as feeds write them: ISO 8601, or with spaces, any number of decimals and an offset."""
    m = re.match(r"(\d+)-(\d+)-(\d+)[T ](\d+):(\d+):(\d+)(?:\.(\d+))?\s*(Z|[+-]\d\d:?\d\d)?", s)
    if not m:
        raise ValueError(f"not a time: {s}")
    micro = int((m[7] or "0")[:6].ljust(6, "0"))
    zone = dt.timezone.utc
    if m[8] and m[8] != "Z":
        sign, digits = (-1 if m[8][0] == "-" else 1), m[8][1:].replace(":", "")
        zone = dt.timezone(sign * dt.timedelta(hours=int(digits[:2]), minutes=int(digits[2:])))
    return dt.datetime(*(int(m[k]) for k in range(1, 7)), micro, tzinfo=zone).astimezone(dt.timezone.utc)


def state_sequence(base: str, name: str, key: str, attempts: int = 1, delay: float = 5.0) -> int | None:
    """The feed's latest sequence by its state file; None where it can't be read."""

    def make() -> int | None:
        for attempt in range(attempts):
            try:
                text = read_uri(join_uri(base, name)).decode()
                return int((parse_yaml if name.endswith(".yaml") else parse_properties)(text)[key])
            except (Missing, OSError, KeyError, ValueError):
                if attempt + 1 < attempts:
                    time.sleep(delay)
        return None

    return memoised(join_uri(base, name), make)  # type: ignore[return-value]


# --------------------------------------------------------------------------- checkpoints


class Checkpoints:
    """Sequences by process name, in a JSON file, an SQLite or a PostgreSQL table ``checkpoints``."""

    def __init__(self, uri: str) -> None:
        self.uri = urllib.parse.urlparse(uri)

    def _connect(self):
        if self.uri.scheme == "sqlite":
            import sqlite3

            return sqlite3.connect(self.uri.path), "?"
        import psycopg2

        return psycopg2.connect(**connection_arguments(self.uri.geturl())), "%s"

    def get(self, name: str) -> int | None:
        """The last sequence done; None if there is none (a 0 too)."""
        if self.uri.scheme == "file":
            import json

            try:
                with open(self.uri.path) as f:
                    return json.load(f).get(name) or None
            except FileNotFoundError:
                return None
        db, mark = self._connect()
        try:
            cursor = db.cursor()
            cursor.execute("CREATE TABLE IF NOT EXISTS checkpoints (proc_name VARCHAR(255) UNIQUE, sequence INT)")
            cursor.execute(f"SELECT sequence FROM checkpoints WHERE proc_name = {mark}", (name,))
            row = cursor.fetchone()
            db.commit()
            return row[0] or None if row else None
        finally:
            db.close()

    def put(self, name: str, sequence: int) -> None:
        if self.uri.scheme == "file":
            import json

            try:
                with open(self.uri.path) as f:
                    known = json.load(f)
            except FileNotFoundError:
                known = {}
            with open(self.uri.path + ".part", "w") as f:
                json.dump(known | {name: sequence}, f)
            os.replace(self.uri.path + ".part", self.uri.path)
            return
        db, mark = self._connect()
        try:
            cursor = db.cursor()
            cursor.execute("CREATE TABLE IF NOT EXISTS checkpoints (proc_name VARCHAR(255) UNIQUE, sequence INT)")
            cursor.execute(
                f"INSERT INTO checkpoints (proc_name, sequence) VALUES ({mark}, {mark}) "
                "ON CONFLICT (proc_name) DO UPDATE SET sequence = excluded.sequence",
                (name, sequence),
            )
            db.commit()
        finally:
            db.close()


def connection_arguments(uri: str) -> dict[str, object]:
    """Host, port, database and login of a database URI; the login may be in the query too."""
    u = urllib.parse.urlparse(uri.removeprefix("jdbc:"))
    query = urllib.parse.parse_qs(u.query)
    out: dict[str, object] = {"host": u.hostname or "localhost", "dbname": u.path.lstrip("/")}
    if u.port:
        out["port"] = u.port
    for key, value in (("user", u.username), ("password", u.password)):
        value = urllib.parse.unquote(value) if value else query.get(key, [None])[0]
        if value is not None:
            out[key] = value
    return out
