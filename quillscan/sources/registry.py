"""The package registry: documents of packages and archives of versions, fetched by the tasks that hold the names, or joined from
tables of what was fetched before. A name or archive that can't be had is a row with an error, never a failed job."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscan.sources.files import registry_url

Fetch = Callable[[str], bytes]
Documents = Callable[[DataFrame], DataFrame]
MAX_ARCHIVE = 256 << 20


def http(url: str) -> bytes:
    """The body at a URL, at most MAX_ARCHIVE bytes of it."""
    with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": "application/json, */*"}), timeout=30) as r:
        body = r.read(MAX_ARCHIVE + 1)
    if len(body) > MAX_ARCHIVE:
        raise ValueError(f"over {MAX_ARCHIVE} bytes")
    return body


def tried(fetch: Fetch, url: str, attempts: int = 3, pause: float = 0.5) -> tuple[bytes | None, str | None]:
    """(body, None) or (None, the last error). What a client did wrong (status 4xx but 408 and 429) isn't asked again."""
    error = None
    for k in range(attempts):
        try:
            return fetch(url), None
        except Exception as e:  # noqa: BLE001  the transport's own errors are results
            error = f"{type(e).__name__}: {e}"
            code = getattr(e, "code", None)
            if isinstance(code, int) and 400 <= code < 500 and code not in (408, 429):
                break
            if k + 1 < attempts:
                time.sleep(pause * 2**k)
    return None, error


def fetched(base: str, fetch: Fetch = http, attempts: int = 3, pause: float = 0.5) -> Documents:
    """Asks the registry for asked(poll, name), batch or stream: poll, name, json, error. Each task asks for its own rows, a few at a time in memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for poll, name in zip(b["poll"], b["name"], strict=True):
                body, error = tried(fetch, registry_url(base, name), attempts, pause)
                yield pd.DataFrame({"poll": [poll], "name": [name], "json": [None if body is None else body.decode("utf-8", "replace")], "error": [error]})

    return lambda asked: asked.select("poll", "name").mapInPandas(run, "poll long, name string, json string, error string")


def landed(documents: DataFrame) -> Documents:
    """The same from a table documents(poll, name, json) of what the registry said at each poll."""

    def join(asked: DataFrame) -> DataFrame:
        found = documents.select("poll", "name", "json")
        return asked.join(found, ["poll", "name"]).select("poll", "name", "json", F.lit(None).cast("string").alias("error"))

    return join


def archives(versions: DataFrame, fetch: Fetch = http, attempts: int = 3, pause: float = 0.5) -> DataFrame:
    """subject (name@version), content, error of versions(name, version, tarball): each archive is fetched by the task that holds its row and leaves it
    before the next is fetched."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for subject, url in zip(b["subject"], b["tarball"], strict=True):
                body, error = tried(fetch, url, attempts, pause)
                yield pd.DataFrame({"subject": [subject], "content": [body], "error": [error]})

    return named(versions).mapInPandas(run, "subject string, content binary, error string")


def landed_archives(versions: DataFrame, blobs: DataFrame) -> DataFrame:
    """The same from a table blobs(tarball, content) of fetched archives; one that isn't there has an error."""
    error = F.when(F.col("content").isNull(), "not landed")
    return named(versions).join(blobs.select("tarball", "content"), "tarball", "left").select("subject", "content", error.alias("error"))


def named(versions: DataFrame) -> DataFrame:
    return versions.select(F.concat_ws("@", "name", "version").alias("subject"), "tarball")
