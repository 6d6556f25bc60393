"""Table functions over one document: a text goes in once, and comes out as its sections or as its chunks.

``split_document(markdown)`` and ``chunk_document(paper_id, markdown, ...)`` are callable from SQL after ``register``; a
document is parsed in one pass, so a plan over a pool has one scan and no exchange. The column expressions of ``chunking``
say the same with Spark's own functions, and the two are held against each other.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking as C

#: What ends a line for ``^`` and ``.`` of the column expressions' patterns.
BREAKS = "\n\r\x85\u2028\u2029"
SPACES = T.BLANK
HEADING = re.compile(rf"(?:\A|(?<=[{BREAKS}]))(##[ \t]+)")
COMMENT = re.compile(T.COMMENT)
WORD = re.compile(f"[^{T.WHITE}]+")
NUMBERED = re.compile(C.NUMBERED.replace(".*", f"[^{BREAKS}]*"), re.ASCII)
ROW = re.compile(C.TABLE_ROW, re.ASCII)
CAPTIONS = re.compile(C.CAPTION, re.ASCII), re.compile(C.CAPTION_INLINE, re.ASCII)
NUMERIC = re.compile(C.NUMERIC_TOKEN, re.ASCII)

SECTION = "section_index int, heading string, number string, title string, body string, start int, breadcrumb string, paper_title string"
CHUNK = "chunk_id string, text string, body string, paper_title string, section_number string, section_title string, section_index int, breadcrumb string, part int, n_parts int, approx_tokens int"


def n_tokens(text: str) -> int:
    return math.floor(len(WORD.findall(text)) * 1.33) + 1


def sections(markdown: str) -> Iterator[tuple]:
    """Rows of SECTION: parts between headings that aren't blank, comments left out.

    ``start`` is where the body stands in the text without comments. The breadcrumb is the first heading, the latest
    section of each ancestor's number, and the section itself.
    """
    said, at = HEADING.split(COMMENT.sub("", markdown)), 0
    latest: dict[str, str] = {}
    first, index = None, 0
    for k, part in enumerate(said):
        begin, at = at, at + len(part)
        if k % 2 or not part.strip(SPACES):
            continue
        line, _, rest = part.partition("\n")
        heading, body = line.strip(SPACES), rest.strip(SPACES)
        start = begin + len(part) - len(rest.lstrip(SPACES)) if body else begin + len(part)
        found = NUMBERED.search(heading)
        number, title = found.groups() if found else (None, heading)
        first = heading if first is None else first
        if number is None:
            path = [title]
        else:
            latest[number] = f"{number} {title}"
            levels = number.split(".")
            path = [latest[a] for n in range(len(levels)) if (a := ".".join(levels[: n + 1])) in latest]
        yield index, heading, number, title, body, start, " > ".join([first, *path]), first
        index += 1


def blocks(body: str) -> list[str]:
    """Paragraphs at blank lines; rows of a table stay together, over blank lines too."""
    lines, opens, before = body.split("\n"), [], None
    for i, line in enumerate(lines):
        if line.strip(SPACES):
            row = bool(ROW.match(line))
            if before is None or row != before[1] or (not row and i > before[0] + 1):
                opens.append(i)
            before = i, row
    cut = ("\n".join(lines[a:b]).strip(SPACES) for a, b in zip(opens, [*opens[1:], len(lines)]))
    return [b for b in cut if b]


def packed(parts: list[str], max_tokens: int, overlap_tokens: int, sizes: list[int] | None = None) -> list[str]:
    """Greedy packing; a new chunk starts with the trailing blocks of the last that fit the overlap. ``sizes``: tokens of the parts, where known."""
    sums, out, a = [0], [], 0
    for i, size in enumerate(sizes or map(n_tokens, parts)):
        sums.append(sums[-1] + size)
        if a < i and sums[i + 1] - sums[a] > max_tokens:
            out.append("\n\n".join(parts[a:i]))
            a = next((j for j in range(a, i) if sums[i] - sums[j] <= overlap_tokens), i)
    return [*out, "\n\n".join(parts[a:])] if parts else []


def is_noise(body: str, ratio: float) -> bool:
    if sum(1 for line in body.split("\n") if ROW.match(line)) >= 2:
        return False
    words = WORD.findall(body)
    dump = bool(words) and sum(1 for w in words if NUMERIC.match(w)) / len(words) > ratio
    return dump or any(c.search(body) for c in CAPTIONS)


@cache
def _skip(extra: tuple[str, ...]) -> list[re.Pattern]:
    own = [C.SKIP_TITLES, *[rf"(?i)^{re.escape(p)}\s*$" for p in C.PUBLISHERS], *[f"(?i)^(?:{p})" for p in extra]]
    return [re.compile(p, re.ASCII) for p in own]


class SplitDocument:
    def eval(self, markdown: str) -> Iterator[tuple]:
        yield from sections(markdown or "")


class _Parsed:
    """A document's sections, their blocks and what is noise, each found once for any number of settings."""

    def __init__(self, markdown: str):
        self.sections = [(s, n_tokens(s[4])) for s in sections(markdown) if s[4]]
        self.blocks: dict[int, tuple[list[str], list[int]]] = {}

    def chunks(self, paper_id: str, max_tokens: int, overlap_tokens: int, min_tokens: int, noise_ratio: float, extra_skip: tuple[str, ...]) -> Iterator[tuple]:
        """Rows of CHUNK."""
        for row in self.bare(paper_id, max_tokens, overlap_tokens, min_tokens, noise_ratio, extra_skip):
            yield *row, n_tokens(row[1])

    def bare(self, paper_id: str, max_tokens: int, overlap_tokens: int, min_tokens: int, noise_ratio: float, extra_skip: tuple[str, ...]) -> Iterator[tuple]:
        """Rows of CHUNK without the last column."""
        skip = _skip(extra_skip)
        for (index, _, number, title, body, _, crumb, paper_title), size in self.sections:
            if size < min_tokens or any(p.search(title) for p in skip) or (number is None and is_noise(body, noise_ratio)):
                continue
            if index not in self.blocks:
                parts = blocks(body)
                self.blocks[index] = parts, [n_tokens(p) for p in parts]
            parts, sizes = self.blocks[index]
            subs = packed(parts, max_tokens, overlap_tokens, sizes)
            for part, sub in enumerate(subs):
                text = f"{crumb}\n\n{sub}"
                key = "|".join([*([] if paper_id is None else [paper_id]), str(index), number or "", title, str(part)])
                yield hashlib.md5(key.encode()).hexdigest(), text, sub, paper_title, number or "", title, index, crumb, part, len(subs)


class ChunkDocument:
    def eval(self, paper_id: str, markdown: str, max_tokens: int, overlap_tokens: int, min_tokens: int, noise_ratio: float, extra_skip: list[str]) -> Iterator[tuple]:
        yield from _Parsed(markdown or "").chunks(paper_id, max_tokens, overlap_tokens, min_tokens, noise_ratio, tuple(extra_skip or ()))


class ChunkCells:
    """The chunks of a document under several settings, from one parse of it; ``cells`` are structs of CELL."""

    def eval(self, paper_id: str, markdown: str, cells: list) -> Iterator[tuple]:
        parsed = _Parsed(markdown or "")
        for arm, max_tokens, overlap_tokens, min_tokens, noise_ratio, extra_skip in cells:
            for row in parsed.chunks(paper_id, max_tokens, overlap_tokens, min_tokens, noise_ratio, tuple(extra_skip or ())):
                yield arm, *row


split_document = F.udtf(SplitDocument, returnType=SECTION)
chunk_document = F.udtf(ChunkDocument, returnType=CHUNK)
chunk_cells = F.udtf(ChunkCells, returnType=f"arm string, {CHUNK}")


def register(spark: SparkSession) -> None:
    """``split_document`` and ``chunk_document`` in SQL: ``SELECT c.* FROM pool, LATERAL chunk_document(paper_id, markdown, 512, 64, 24, 0.4D, array()) c``."""
    spark.udtf.register("split_document", split_document)
    spark.udtf.register("chunk_document", chunk_document)
    spark.udtf.register("chunk_cells", chunk_cells)


def _beside(pool: DataFrame, columns: list[str], called) -> DataFrame:
    """The pool's columns beside the rows that its text gives: the text goes to Python and isn't carried along."""
    return pool.lateralJoin(called).select(*columns)


def split(pool: DataFrame) -> DataFrame:
    """paper_id and the columns of SECTION."""
    names = [c.split()[0] for c in SECTION.split(", ")]
    return _beside(pool.select("paper_id", "markdown"), ["paper_id", *names], split_document(F.col("markdown").outer()))


def chunks(
    pool: DataFrame, max_tokens: int = C.MAX_TOKENS, overlap_tokens: int = C.OVERLAP_TOKENS, min_tokens: int = C.MIN_TOKENS, noise_ratio: float = C.NOISE_RATIO, extra_skip: tuple[str, ...] = ()
) -> DataFrame:
    """The chunk table of (paper_id, markdown): breadcrumb and body, with identity and position."""
    extra = F.array(*[F.lit(x) for x in extra_skip]).cast("array<string>")
    settings: list[Column] = [F.lit(max_tokens), F.lit(overlap_tokens), F.lit(min_tokens), F.lit(float(noise_ratio)), extra]
    p = pool.select("paper_id", "markdown", F.col("paper_id").cast("string").alias("__key"))
    called = chunk_document(F.col("__key").outer(), F.col("markdown").outer(), *settings)
    names = [c.split()[0] for c in CHUNK.split(", ")]
    return _beside(p, [*names[:3], "paper_id", *names[3:]], called)


def cells(pool: DataFrame, settings: dict[str, dict]) -> DataFrame:
    """The chunk tables of several settings (arguments of ``chunks``), with an ``arm`` column: a document is read and parsed once for all of them."""
    extra = lambda k: F.array(*[F.lit(x) for x in k.get("extra_skip", ())]).cast("array<string>")
    default = {"max_tokens": C.MAX_TOKENS, "overlap_tokens": C.OVERLAP_TOKENS, "min_tokens": C.MIN_TOKENS}
    cell = lambda arm, k: F.struct(F.lit(arm).alias("arm"), *[F.lit(k.get(n, v)).alias(n) for n, v in default.items()], F.lit(float(k.get("noise_ratio", C.NOISE_RATIO))).alias("noise_ratio"), extra(k).alias("extra_skip"))
    p = pool.select("paper_id", "markdown", F.col("paper_id").cast("string").alias("__key"))
    called = chunk_cells(F.col("__key").outer(), F.col("markdown").outer(), F.array(*[cell(arm, k) for arm, k in settings.items()]))
    names = [c.split()[0] for c in CHUNK.split(", ")]
    return _beside(p, [*names[:3], "paper_id", *names[3:], "arm"], called)


#: What stands between the names of the settings that share a chunk.
BETWEEN = "\x1f"


def embedded_cells(pool: DataFrame, settings: dict[str, dict], embedder, batch: int = 32) -> DataFrame:
    """(arms, chunk_id, paper_id, section_number, section_title, embedding): the chunks of ``cells`` with their vectors.

    A chunk that several settings cut alike is one row, with all their names; texts are parsed, cut and embedded in one pass
    and don't leave it.
    """
    default = (C.MAX_TOKENS, C.OVERLAP_TOKENS, C.MIN_TOKENS, C.NOISE_RATIO, ())
    knobs = [(arm, [k.get(n, v) for n, v in zip(("max_tokens", "overlap_tokens", "min_tokens", "noise_ratio", "extra_skip"), default)]) for arm, k in settings.items()]
    p = pool.select("paper_id", "markdown", F.col("paper_id").cast("string").alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, batch) for b in batches for i in range(0, b.num_rows, batch)):
            found: dict[tuple, list[str]] = {}
            for i, (key, markdown) in enumerate(zip(b.column("key").to_pylist(), b.column("markdown").to_pylist())):
                parsed = _Parsed(markdown or "")
                for arm, (*sizes, extra) in knobs:
                    for chunk_id, text, _, _, number, title, *_ in parsed.bare(key, *sizes, tuple(extra)):
                        found.setdefault((i, chunk_id, number, title, text), []).append(arm)
            texts = list(dict.fromkeys(k[4] for k in found))
            vectors = dict(zip(texts, (v for i in range(0, len(texts), batch) for v in embedder.documents(texts[i : i + batch]))))
            rows, ids, numbers, titles, said = zip(*found) if found else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array([BETWEEN.join(a) for a in found.values()], pa.string()), pa.array(ids, pa.string()), b.column("paper_id").take(pa.array(rows, pa.int64())), pa.array(numbers, pa.string()), pa.array(titles, pa.string()), pa.array([vectors[t] for t in said], pa.list_(pa.float32()))],
                ["arms", "chunk_id", "paper_id", "section_number", "section_title", "embedding"],
            )

    return p.mapInArrow(run, f"arms string, chunk_id string, paper_id {dict(p.dtypes)['paper_id']}, section_number string, section_title string, embedding array<float>")
