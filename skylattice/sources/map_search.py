"""A batch source for paged map searches over HTTP: one input partition per request, pages read in the task. searched() takes its requests
from a DataFrame instead, so that a million of them need not pass the driver.

Options: `url`, `kind` ("a", "b", "zones", "types" or "drones"), `method` (GET unless said, or POST with the parameters as a form), `headers` (a JSON
object), `requests` (a JSON list of objects with idx, kw and params), `page_size`, `pause_s` (between pages),
`paging` (names of provider A's page parameters, "page_num,page_size" unless said; version 3 has "page,offset"), `timeout_s`, `key_env` (the environment variable with the key), `wait_s` (first wait after a rate limit). A request that fails gives a row
with status `failed` and the reason, and one without records a row `empty`; the others go on. TLS is always verified.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skylattice.operators.schedule import FIRST_WAIT, TRIES

SCHEMA = "idx long, kw int, page int, pos int, status string, record string"
FIELDS = pa.schema([("idx", pa.int64()), ("kw", pa.int32()), ("page", pa.int32()), ("pos", pa.int32()), ("status", pa.string()), ("record", pa.string())])
#: Fixed value: what provider A says beyond its rate.
LIMIT = "CUQPS_HAS_EXCEEDED_THE_LIMIT"
PAGE_SIZE = {"a": 25, "b": 100, "zones": 1, "types": 1, "drones": 1}
#: Rows of a batch that searched() hands on.
BATCH = 1_000


class Refused(Exception):
    """The provider answers, but with an error."""


@dataclass
class Request(InputPartition):
    idx: int
    kw: int
    params: dict[str, Any]


def error_text(body: str) -> str:
    """The code and message of an error body, else its first 300 letters."""
    try:
        data = json.loads(body)
        code = next((data[k] for k in ("code", "infocode", "status") if k in data), None)
        said = next((data[k] for k in ("msg", "message", "cndesc", "info") if k in data), None)
        return f"{code}: {said}" if said is not None or code is not None else body[:300]
    except (ValueError, TypeError, AttributeError):
        return body[:300]


class MapSearchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.url, self.kind = options["url"], options.get("kind", "a")
        if self.kind not in PAGE_SIZE:
            raise ValueError(f"kind is one of {', '.join(PAGE_SIZE)}")
        self.size = int(options.get("page_size", PAGE_SIZE[self.kind]))
        self.pause, self.timeout, self.wait = (float(options.get(k, d)) for k, d in (("pause_s", 0.2), ("timeout_s", 30), ("wait_s", FIRST_WAIT)))
        self.key_env = options.get("key_env")
        self.paging = options.get("paging", "page_num,page_size").split(",")
        self.method, self.headers = options.get("method", "GET").upper(), json.loads(options.get("headers", "{}"))
        if self.method not in ("GET", "POST"):
            raise ValueError("method is GET or POST")
        self.requests = json.loads(options.get("requests", "[]"))

    def check_key(self) -> None:
        if self.key_env and not os.environ.get(self.key_env):
            raise ValueError(f"the environment variable {self.key_env} holds no key")

    def partitions(self) -> list[Request]:
        self.check_key()
        return [Request(int(r["idx"]), int(r.get("kw", 0)), r.get("params", {})) for r in self.requests]

    def get(self, params: dict[str, Any]) -> dict[str, Any]:
        if self.key_env:
            params = params | {"tk" if self.kind == "b" else "key": os.environ.get(self.key_env, "")}
        form, posts = urllib.parse.urlencode(params), self.method == "POST"
        request = urllib.request.Request(self.url if posts else f"{self.url}?{form}", form.encode() if posts else None, self.headers, method=self.method)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            raise Refused(error_text(e.read().decode("utf-8", "replace"))) from e

    def page(self, request: Request, page: int, start: int) -> tuple[list[Any], int | None]:
        """Records of one page and the total, if it is said."""
        if self.kind == "a":
            for n in range(TRIES):
                data = self.get(request.params | dict(zip(self.paging, (page, self.size))))
                if str(data.get("status")) == "1":
                    return data.get("pois") or [], int(data.get("count") or 0)
                if data.get("info") != LIMIT:
                    break
                time.sleep(self.wait * 2**n)
            raise Refused(str(data.get("info", "unknown error")))
        if self.kind == "b":
            post = {k: v for k, v in request.params.items() if v is not None} | {"start": str(start), "count": str(self.size)}
            data = self.get({"type": "query", "postStr": json.dumps(post, ensure_ascii=False, separators=(",", ":"))})
            status = data.get("status") or {}
            if status.get("infocode") not in (0, 1000) or data.get("code", 0) not in (0, 1000):
                raise Refused(error_text(json.dumps(data)))
            return (data.get("pois") or [] if data.get("resultType") == 1 else []), int(data.get("count") or 0)
        data = self.get(request.params)
        if self.kind == "types":
            if str(data.get("status")) != "1":
                raise Refused(str(data.get("info", "unknown error")))
            return data.get("types") or [], None
        if self.kind == "drones":
            return data.get("drones") or [], None
        if data.get("code") != 0:
            raise Refused(error_text(json.dumps(data)))
        return (data.get("data") or {}).get("areas") or [], None

    def read(self, partition: Request) -> Iterator[tuple]:
        page, start = 1, 0
        try:
            while True:
                records, total = self.page(partition, page, start)
                for pos, record in enumerate(records):
                    yield partition.idx, partition.kw, page, pos, "ok", json.dumps(record, ensure_ascii=False)
                start += len(records)
                if not start:
                    yield partition.idx, partition.kw, page, 0, "empty", None
                # provider B also ends with a page that isn't full
                if total is None or not records or page * self.size >= total or self.kind == "b" and len(records) < self.size:
                    return
                page += 1
                time.sleep(self.pause)
        except (Refused, OSError, ValueError) as e:
            yield partition.idx, partition.kw, page, 0, "failed", str(e)[:300]


class MapSearch(DataSource):
    """`spark.read.format("map_search")`, after register()."""

    @classmethod
    def name(cls) -> str:
        return "map_search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return MapSearchReader(dict(self.options))


def searched(requests: DataFrame, options: dict[str, str]) -> DataFrame:
    """The pages of requests(idx, kw, params as a JSON object or null), read in the tasks that hold the requests; columns and options of the source.

    Deal the requests over as many partitions as may ask at once. A lost task asks its requests again. The key is read on the executors.
    """
    reader = MapSearchReader(options)

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader.check_key()
        for batch in batches:
            asked = (Request(r["idx"], r["kw"] or 0, json.loads(r["params"] or "{}")) for r in batch.to_pylist())
            rows = chain.from_iterable(map(reader.read, asked))
            while some := list(islice(rows, BATCH)):
                yield pa.RecordBatch.from_pylist([dict(zip(FIELDS.names, r)) for r in some], FIELDS)

    return requests.select(F.col("idx").cast("long"), F.col("kw").cast("int"), F.col("params").cast("string")).mapInArrow(pages, SCHEMA)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MapSearch)
