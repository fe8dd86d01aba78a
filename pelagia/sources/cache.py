"""Verified files of requests, and Spark's view of them.

Acquisition is the only step that touches a network and runs on the driver; files then are ordinary
Spark input. A request's file and manifest are found by the SHA-256 of its URL.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RETRIED, RETRIES, TIMEOUT = (429, 500, 502, 503, 504), 2, 90
MAGIC = {".nc": (b"CDF", b"\x89HDF")}


def canonical(url: str, params: dict[str, str] | None = None) -> str:
    return f"{url}?{urllib.parse.urlencode(params)}" if params else url


def publish(path: Path, content: bytes) -> None:
    """Other readers see the old file or the whole new one."""
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.{os.getpid()}.part")
    part.write_bytes(content)
    os.replace(part, path)


def write_json(path: Path, value) -> None:
    """K4: sorted, and NaN is an error."""
    publish(path, (json.dumps(value, indent=2, sort_keys=True, allow_nan=False) + "\n").encode())


def fetch(url: str) -> bytes:
    """Again after 1, 2, ... seconds where the server says that it may help, or where it can't be reached."""
    for attempt in range(RETRIES + 1):
        try:
            with urllib.request.urlopen(url, timeout=TIMEOUT) as answer:
                return answer.read()
        except urllib.error.HTTPError as e:
            if e.code not in RETRIED or attempt == RETRIES:
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if attempt == RETRIES:
                raise
        time.sleep(2**attempt)
    raise AssertionError


class RequestCache:
    def __init__(self, root: str | Path, offline: bool = False, get: Callable[[str], bytes] = fetch):
        self.root, self.offline, self.fetch = Path(root), offline, get

    def get(self, url: str, params: dict[str, str] | None = None, suffix: str = ".json") -> Path:
        """The file of a request. Both it and its manifest must agree with the URL and the digest."""
        whole = canonical(url, params)
        path = self.root / f"{hashlib.sha256(whole.encode()).hexdigest()}{suffix}"
        manifest = path.with_name(path.stem + ".manifest.json")
        if path.exists() and manifest.exists():
            told = json.loads(manifest.read_text())
            if told["url"] != whole or told["sha256"] != hashlib.sha256(path.read_bytes()).hexdigest():
                raise ValueError(f"{path} is not what was published")
            return path
        if self.offline:
            raise FileNotFoundError(whole)
        content = self.fetch(whole)
        if suffix == ".json":
            json.loads(content)
        elif suffix in MAGIC and not content.startswith(MAGIC[suffix]):
            raise ValueError(f"{whole} is no {suffix} file")
        publish(path, content)
        write_json(manifest, {"url": whole, "sha256": hashlib.sha256(content).hexdigest(), "bytes": len(content), "retrieved_at": datetime.now(UTC).isoformat()})
        return path

    def json(self, url: str, params: dict[str, str] | None = None):
        return json.loads(self.get(url, params).read_text())

    def pages(self, url: str, params: dict[str, str] | None = None) -> list[Path]:
        """The files of a feature collection, following its next links."""
        out, seen, at = [], set(), canonical(url, params)
        while at:
            if at in seen:
                raise ValueError(f"{at} leads to itself")
            seen.add(at)
            path = self.get(at)
            page = json.loads(path.read_text())
            if "features" not in page:
                raise ValueError(f"{at} has no features")
            out.append(path)
            at = next((x["href"] for x in page.get("links", []) if x.get("rel") == "next"), None)
        return out


def verified_files(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """S17, V6 at scale: files joined with their manifests; a digest that differs is an error when the row is read."""
    key = F.regexp_extract("path", r"([0-9a-f]{64})", 1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(root).where(~F.col("path").endswith(".manifest.json")).select(key.alias("key"), "path", "content")
    told = spark.read.option("multiLine", True).schema("url string, sha256 string").json(f"{root}/*.manifest.json").withColumn("key", F.sha2("url", 256))
    digest = F.sha2("content", 256)
    checked = F.when(digest == F.col("sha256"), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("digest differs: "), F.col("path"))).cast("binary"))
    return files.join(told, "key").select("key", "url", "path", checked.alias("content"))
