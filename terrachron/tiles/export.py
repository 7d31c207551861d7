"""Tiles as files: {base}/{zoom}/{col}/{row}.mvt."""

from __future__ import annotations

import gzip
import os
import urllib.parse
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row


def tile_key(prefix: str, zoom: int, col: int, row: int) -> str:
    """Key of a tile in an object store."""
    return "/".join([*([p] if (p := prefix.strip("/")) else []), str(zoom), str(col), f"{row}.mvt"])


def object_of(prefix: str, zoom: int, col: int, row: int, body: bytes, public: bool = False) -> dict:
    """What is put to an object store: a gzipped body and its headers."""
    out = {"Key": tile_key(prefix, zoom, col, row), "Body": gzip.compress(body, mtime=0), "ContentEncoding": "gzip", "ContentType": "application/vnd.mapbox-vector-tile"}
    return out | ({"ACL": "public-read"} if public else {})


def _opened(base_uri: str) -> tuple[object, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(base_uri)


def save_tiles(
    tiles: DataFrame, base_uri: str, client: Callable[[], object] | None = None, public: bool = False, opened: Callable[[str], tuple[object, str]] = _opened
) -> None:
    """Write tiles (zoom, col, row, mvt) below a URI: ``s3://bucket/prefix`` gzipped, any other file system raw.

    ``client`` makes the object store's client on each executor (put_object). Other schemes
    (hdfs, gs, abfs and what else Arrow knows) are opened by ``opened`` on each executor; a
    plain path or ``file:`` must be a folder that all executors share. A tile is written
    under another name first and moved then, so that a retried task leaves whole files.
    """
    uri = urllib.parse.urlparse(base_uri)
    if uri.scheme in ("s3", "s3a", "s3n"):
        bucket, prefix = uri.netloc, uri.path

        def put(rows: Iterator[Row]) -> None:
            if client is not None:
                store = client()
            else:
                import boto3

                store = boto3.client("s3")
            for r in rows:
                store.put_object(Bucket=bucket, **object_of(prefix, r["zoom"], r["col"], r["row"], bytes(r["mvt"]), public))

        tiles.foreachPartition(put)
        return
    target = base_uri if uri.scheme else f"file://{os.path.abspath(base_uri)}"

    def save(rows: Iterator[Row]) -> None:
        store, base, known = None, "", set()
        for r in rows:
            if store is None:
                store, base = opened(target)
            folder = f"{base.rstrip('/')}/{r['zoom']}/{r['col']}"
            if folder not in known:
                store.create_dir(folder, recursive=True)
                known.add(folder)
            path = f"{folder}/{r['row']}.mvt"
            part = f"{path}.{uuid.uuid4().hex}.part"
            with store.open_output_stream(part) as f:
                f.write(bytes(r["mvt"]))
            store.move(part, path)

    tiles.foreachPartition(save)
