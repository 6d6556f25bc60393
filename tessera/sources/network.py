"""Data sources behind a network or a folder of small files: ``spark.read.format("tessera_fetch")`` and its like, after ``register``.

Options name a client (``package.module:factory``, whose product workers build for themselves, with ``settings``, a JSON object, as its arguments), a list of what to ask (a
text file, an item on each line), and a cache. What a client brings is put into the cache under the hash of what was asked,
whole or not at all, so neither a restart nor a second reader asks twice; what fails is a row with an error, and is asked
again by the next read. Conditions on the asked column reach the source: only what they name is asked, also without a list.

As a stream, lines that are appended to the list are new rows; the offset is the number of lines that have been taken.
"""

from __future__ import annotations

import base64
import hashlib
import importlib
import json
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from tessera.functions import text as T
from tessera.sources.fetch import FETCHED, FIGURE_BYTES, RESULTS

#: What is asked in one task.
PER_TASK = 16
ANNOTATIONS = "paper_id string, pos int, annotation string, error string"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _files(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _lines(path: str | None) -> list[str]:
    if not path:
        return []
    files, at = _files(path)
    with files.open_input_stream(at) as f:
        return [x for x in f.read().decode().splitlines() if x.strip()]


def _client(options: dict):
    module, _, factory = options["client"].partition(":")
    return getattr(importlib.import_module(module), factory)(**json.loads(options.get("settings", "{}")))


class Cache:
    """Answers by the hash of what was asked; an answer appears by a rename."""

    def __init__(self, path: str | None):
        self.path = path

    def _at(self, asked: str) -> str:
        return f"{self.path.rstrip('/')}/{hashlib.sha256(asked.encode()).hexdigest()}.json"

    def get(self, asked: str):
        if not self.path:
            return None
        from pyarrow import fs

        files, at = _files(self._at(asked))
        if files.get_file_info(at).type != fs.FileType.File:
            return None
        with files.open_input_stream(at) as f:
            return json.loads(f.read())

    def put(self, asked: str, answer) -> None:
        if not self.path:
            return
        import uuid

        files, at = _files(self._at(asked))
        files.create_dir(at.rpartition("/")[0], recursive=True)
        draft = f"{at}.{uuid.uuid4().hex}"
        with files.open_output_stream(draft) as f:
            f.write(json.dumps(answer).encode())
        files.move(draft, at)


class Asked(InputPartition):
    def __init__(self, items: list[str]):
        super().__init__(items)
        self.items = items


def _parted(items: list[str]) -> list[InputPartition]:
    return [Asked(items[i : i + PER_TASK]) for i in range(0, len(items), PER_TASK)]


class _Reader(DataSourceReader):
    """Asks for the listed items; conditions ``column = x`` and ``column IN (...)`` say which, and need no list."""

    def __init__(self, source: _Source):
        self.source, self.named = source, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == (self.source.column,):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.named = values if self.named is None else self.named & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        listed = self.source.listed()
        wanted = listed if self.named is None else [x for x in listed if x in self.named] if listed is not None else sorted(x for x in self.named if x is not None)
        return _parted(list(dict.fromkeys(wanted or []))) or [Asked([])]

    def read(self, partition: Asked) -> Iterator[tuple]:
        return self.source.rows(partition.items)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, source: _Source):
        self.source = source

    def initialOffset(self) -> dict:  # noqa: N802
        return {"lines": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"lines": len(self.source.listed() or [])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _parted(list(dict.fromkeys(self.source.listed()[start["lines"] : end["lines"]])))

    def read(self, partition: Asked) -> Iterator[tuple]:
        return self.source.rows(partition.items)

    def commit(self, end: dict) -> None:
        pass


class _Source(DataSource):
    column = ""

    def listed(self) -> list[str] | None:
        at = self.options.get("list")
        return _lines(at) if at else None

    def rows(self, items: list[str]) -> Iterator[tuple]:
        raise NotImplementedError

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        if not self.options.get("list"):
            raise ValueError(f"{self.name()}: a stream needs a list")
        return _StreamReader(self)


class Fetch(_Source):
    """(url, body, content_type, error) of addresses; options client, list, cache, types, hosts, most.

    The client takes an address and gives a body and its content type. Addresses that aren't safe, other hosts and types
    than those named (comma-joined), and bodies of more than ``most`` bytes are errors. PDFs, say, are ``types=application/pdf``.
    """

    column = "url"

    @classmethod
    def name(cls) -> str:
        return "tessera_fetch"

    def schema(self) -> str:
        return FETCHED

    def rows(self, items: list[str]) -> Iterator[tuple]:
        named = lambda key: tuple(x for x in self.options.get(key, "").lower().split(",") if x)
        types, hosts, most = named("types"), named("hosts"), int(self.options.get("most", FIGURE_BYTES))
        cache, client = Cache(self.options.get("cache")), None
        for url in items:
            host = (urlsplit(url).hostname or "") if re.search(T.SAFE_URL, url) and not re.search(r"[\x00-\x1f]", url) else ""
            if not host or hosts and not any(host == h or host.endswith(f".{h}") for h in hosts):
                yield url, None, None, "address not allowed"
                continue
            known = cache.get(url)
            if known is None:
                try:
                    client = client or _client(self.options)
                    body, kind = client(url)
                except Exception as e:
                    yield url, None, None, f"{type(e).__name__}: {e}"[:300]
                    continue
                known = {"body": base64.b64encode(body).decode(), "type": kind}
                if len(body) <= most:
                    cache.put(url, known)
            body, kind = base64.b64decode(known["body"]), known["type"]
            wrong = f"not {' or '.join(types)}" if types and kind.split(";", 1)[0].strip().lower() not in types else f"more than {most} bytes" if len(body) > most else None
            yield url, None if wrong else body, kind, wrong


class Search(_Source):
    """(query, pos, url, title, body): safe results of a web search; options client, list, cache, k. A search that fails has none.

    The client takes a query and a number, and gives dicts with href (or url), title and body.
    """

    column = "query"

    @classmethod
    def name(cls) -> str:
        return "tessera_search"

    def schema(self) -> str:
        return RESULTS

    def rows(self, items: list[str]) -> Iterator[tuple]:
        k, cache, client = int(self.options.get("k", 5)), Cache(self.options.get("cache")), None
        for query in items:
            key = f"{k}|{query}"
            hits = cache.get(key)
            if hits is None:
                try:
                    client = client or _client(self.options)
                    hits = [{"url": h.get("href") or h.get("url") or "", "title": h.get("title") or "", "body": h.get("body") or ""} for h in client(query, k)[:k]]
                except Exception:
                    continue
                cache.put(key, hits)
            for pos, h in enumerate(hits):
                if re.search(T.SAFE_URL, h["url"]) and not re.search(r"[\x00-\x1f]", h["url"]):
                    yield query, pos, h["url"], h["title"], h["body"]


class Annotations(_Source):
    """(paper_id, pos, annotation, error) of a folder with a JSON array for each paper, the annotation as JSON text; option path.

    A condition on paper_id opens that paper's file alone; a paper without a file has no rows, and a file that can't be
    read is one row with an error beside the others.
    """

    column = "paper_id"

    @classmethod
    def name(cls) -> str:
        return "tessera_annotations"

    def schema(self) -> str:
        return ANNOTATIONS

    def listed(self) -> list[str] | None:
        from pyarrow import fs

        files, at = _files(self.options["path"])
        found = files.get_file_info(fs.FileSelector(at, allow_not_found=True))
        return sorted(f.base_name[:-5] for f in found if f.is_file and f.base_name.endswith(".json"))

    def rows(self, items: list[str]) -> Iterator[tuple]:
        files, at = _files(self.options["path"])
        for paper in items:
            try:
                with files.open_input_stream(f"{at.rstrip('/')}/{paper}.json") as f:
                    said = json.loads(f.read())
                if not isinstance(said, list):
                    raise ValueError("no array")
            except Exception as e:
                yield paper, None, None, f"{type(e).__name__}: {e}"[:300]
                continue
            for pos, x in enumerate(said):
                yield paper, pos, json.dumps(x), None

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        raise NotImplementedError("annotations are read as a batch")


def register(spark: SparkSession) -> None:
    """The sources by their names; conditions are pushed to them."""
    spark.conf.set(PUSHDOWN, "true")
    for source in (Fetch, Search, Annotations):
        spark.dataSource.register(source)
