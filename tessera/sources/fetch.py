"""Sources behind a network, with the client left to the caller: pages, figures, PDFs and web results.

A client is a plain function that workers unpickle. What it brings is kept in a table, so nothing is fetched twice, and
what fails is a row with an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

FETCHED = "url string, body binary, content_type string, error string"
#: Hosts that figures may come from, and the most bytes of one.
FIGURE_HOSTS, FIGURE_BYTES = ("arxiv.org",), 25 << 20
RESULTS = "query string, pos int, url string, title string, body string"


def fetched(urls: DataFrame, fetch: Callable[[str], tuple[bytes, str]], known: DataFrame | None = None, types: tuple[str, ...] = (), hosts: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """(url, body, content_type, error) of each distinct url, those of ``known`` as they were.

    ``fetch`` gives a body and its content type. Other types and hosts than those named are errors, and so are bodies of
    more than ``most`` bytes and addresses that aren't safe.
    """
    asked = urls.select("url").where("url IS NOT NULL").distinct()
    new = asked if known is None else asked.join(known.filter("error IS NULL").select("url"), "url", "left_anti")
    new = new.withColumn("safe", T.is_safe_url(F.col("url")))

    def one(url: str, safe: bool) -> tuple:
        host = urlsplit(url).hostname if safe else None
        if not safe or hosts and not any(host == h or host.endswith(f".{h}") for h in hosts):
            return url, None, None, "address not allowed"
        try:
            body, kind = fetch(url)
        except Exception as e:
            return url, None, None, f"{type(e).__name__}: {e}"[:300]
        if types and kind.split(";", 1)[0].strip().lower() not in types:
            return url, None, kind, f"not {' or '.join(types)}"
        if most is not None and len(body) > most:
            return url, None, kind, f"more than {most} bytes"
        return url, body, kind, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([one(u, s) for u, s in zip(b["url"], b["safe"])], columns=["url", "body", "content_type", "error"])

    found = new.mapInPandas(run, FETCHED)
    return found if known is None else found.unionByName(known.filter("error IS NULL").join(asked, "url", "left_semi").select("url", "body", "content_type", "error"))


def papers(ids: DataFrame, fetch: Callable[[str], tuple[bytes, str]], known: DataFrame | None = None, base: str = "https://arxiv.org/html/") -> DataFrame:
    """(paper_id, html, url, version, error) for (paper_id, arxiv_id): the pages of papers, with the version they name."""
    rows = ids.withColumn("url", F.concat(F.lit(base), "arxiv_id"))
    got = fetched(rows, fetch, known, types=("text/html", "application/xhtml+xml"))
    j = rows.join(got, "url", "left").withColumn("html", F.decode("body", "utf-8"))
    return j.select("paper_id", "html", "url", T.page_version(F.col("html"), F.col("arxiv_id")).alias("version"), "error")


def figures(urls: DataFrame, fetch: Callable[[str], tuple[bytes, str]], hosts: tuple[str, ...] = FIGURE_HOSTS, most: int = FIGURE_BYTES) -> DataFrame:
    """(url, name, body, error): each figure once, from allowed hosts and of bounded size, named by its content and kind."""
    got = fetched(urls, fetch, hosts=hosts, most=most)
    name = F.concat(F.substring(F.sha2("body", 256), 1, 16), T.extension(F.col("url"), F.col("content_type")))
    return got.select("url", F.when(F.col("error").isNull(), name).alias("name"), "body", "error")


def converted(files: DataFrame, convert: Callable[[bytes], str], path: str = "path", content: str = "content") -> DataFrame:
    """(path, markdown, error) of files as ``spark.read.format("binaryFile")`` has them, by a converter of PDFs, say."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, data in zip(b["p"], b["c"]):
                try:
                    rows.append((p, convert(bytes(data)), None))
                except Exception as e:
                    rows.append((p, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=["path", "markdown", "error"])

    return files.select(F.col(path).alias("p"), F.col(content).alias("c")).mapInPandas(run, "path string, markdown string, error string")


def web_results(queries: DataFrame, search: Callable[[str, int], list[dict]], k: int = 5) -> DataFrame:
    """(query, pos, url, title, body): up to k safe results of each query; a search that fails has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for q in b["query"]:
                try:
                    hits = search(q, k)
                except Exception:
                    hits = []
                rows += [(q, i, h.get("href") or h.get("url"), h.get("title") or "", h.get("body") or "") for i, h in enumerate(hits[:k])]
            yield pd.DataFrame(rows, columns=["query", "pos", "url", "title", "body"])

    return queries.select("query").distinct().mapInPandas(run, RESULTS).filter(T.is_safe_url(F.col("url")))


