"""Column functions over text: the scalar vocabulary of the engine, all built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as text functions mean it: ASCII's, the four separators, and Unicode's.
WHITE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
STRIP = rf"^[{WHITE}]+|[{WHITE}]+$"
#: The same one by one: trimming them needs no pattern.
BLANK = "".join(chr(i) for i in range(0x3001) if re.match(f"[{WHITE}]", chr(i)))
SENTENCE_END = rf"(?<=[.!?])[{WHITE}]+"
COMMENT = r"(?s)<!--.*?-->"
#: An identifier's form, and where a sentence ends (above).
ARXIV_ID = r"^\d{4}\.\d{4,5}$"
#: Fixed value: a citation mark, one bracket for one or several refs.
MARK = r"[\[【](r\d+(?:\s*,\s*r\d+)*)[\]】]"
#: A port that exists, and a web address with a host and without credentials.
PORT = r"0*(?:[0-9]{1,4}|[0-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5])"
SAFE_URL = rf"^ *(?i:https?)://(?:\[[0-9A-Fa-f:.]+\]|[^/?#@:\[\]]+)(?::(?:{PORT})?)?(?:[/?#].*)?$"
PUNCTUATION = r"[!-/:-@\[-`{-~]+$"


def tokens(text: Column) -> Column:
    """Lower-case Unicode words."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), F.lit(1))


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, f"[{WHITE}]+"), lambda w: w != ""))


def approx_tokens(text: Column) -> Column:
    """Words times 1.33, rounded down, plus one."""
    return (F.floor(n_words(text) * F.lit(1.33)) + 1).cast("int")


def sentences(text: Column) -> Column:
    parts = F.split(F.regexp_replace(text, STRIP, ""), SENTENCE_END)
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, STRIP, "")), lambda s: s != "")


def without_comments(md: Column) -> Column:
    return F.regexp_replace(md, COMMENT, "")


def title(md: Column) -> Column:
    """The first second-level heading, or an empty string."""
    return F.trim(F.regexp_extract(without_comments(md), r"(?m)^## (.*)$", 1))


def kebab(tag: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(tag), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug(name: Column, most: int = 80) -> Column:
    return F.substring(kebab(name), 1, most)


def citation_refs(text: Column) -> Column:
    """Distinct refs of [r1, r2] and 【r1】 marks, in order."""
    marks = F.regexp_extract_all(text, F.lit(MARK), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(marks, lambda m: F.split(m, r"\s*,\s*"))))


def arxiv_id(value: Column) -> Column:
    """The bare identifier of an id, or of the address of an abstract or a PDF; null where there is none."""
    bare = F.regexp_replace(F.regexp_replace(value, STRIP, ""), r"^https?://arxiv\.org/(abs|pdf)/", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\.pdf$", ""), r"v\d+$", "")
    return F.when(bare.rlike(ARXIV_ID), bare)


def is_safe_url(url: Column) -> Column:
    """http or https, a host, a port that exists if any, no credentials, no control characters."""
    return url.rlike(SAFE_URL) & ~url.rlike(r"[\x00-\x1f]")


def first_json_object(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def first_json_array(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?s)\[.*?\]", 0)
    return F.when(found != "", found)


def sanitised_error(text: Column, most: int = 300) -> Column:
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), f"[{WHITE}]+", " "))
    return F.when(F.char_length(plain) > most, F.concat(F.rtrim(F.substring(plain, 1, most)), F.lit("…"))).otherwise(plain)


def mode(answer: Column) -> Column:
    """COMPARE where the first word says so, else ASK."""
    first = F.regexp_replace(F.upper(F.regexp_extract(answer, rf"^[{WHITE}]*([^{WHITE}]+)", 1)), PUNCTUATION, "")
    return F.when(first == "COMPARE", "COMPARE").otherwise("ASK")


def bibtex_escape(text: Column) -> Column:
    """Characters that would break an entry's braces or fields."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\textbackslash "), "([{}&%])", r"\\$1")


def year_of(arxiv: Column) -> Column:
    return F.when(arxiv.rlike(ARXIV_ID), F.concat(F.lit("20"), F.substring(arxiv, 1, 2)).cast("int"))


def extension(url: Column, content_type: Column) -> Column:
    """The URL's suffix if it is one of an image, else the content type's, else .img."""
    suffix = F.lower(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"(?i)[^/](\.(?:png|jpe?g|gif|svg|webp))$", 1))
    known = F.create_map(*[F.lit(x) for pair in IMAGE_TYPES.items() for x in pair])
    return F.when(suffix != "", suffix).otherwise(F.coalesce(known[F.regexp_extract(F.lower(F.coalesce(content_type, F.lit(""))), "^([^;]*)", 1)], F.lit(".img")))


def hashed_int(*key: Column) -> Column:
    """A 32-bit number from an md5 of the parts: the base of all seeded sampling, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *key)), 1, 8), 16, 10).cast("long")


def label_of(score: Column, contradiction: float = 0.05, entailment: float = 0.3) -> Column:
    return F.when(score <= contradiction, "contradiction").when(score >= entailment, "entailment").otherwise("neutral")


#: Extensions of image types, and words that no answer is told by.
IMAGE_TYPES = {"image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif", "image/webp": ".webp", "image/svg+xml": ".svg"}
STOPWORDS = ("a", "an", "the")


def answer_tokens(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in STOPWORDS]))


def answer_f1(predicted: Column, gold: Column) -> Column:
    """F1 of two token sets; 0 where either is empty."""
    p, g = answer_tokens(predicted), answer_tokens(gold)
    shared = F.size(F.array_intersect(p, g))
    return F.when(shared == 0, 0.0).otherwise(2.0 * shared / (F.size(p) + F.size(g)))


def page_version(html: Column, arxiv: Column) -> Column:
    """The paper's id with the version that its page names, else the id alone."""
    pattern = F.concat(F.lit("arXiv:"), F.replace(arxiv, F.lit("."), F.lit("\\.")), F.lit("(v[0-9]+)"))
    return F.concat(arxiv, F.call_function("regexp_extract", html, pattern, F.lit(1)))


def tagging_excerpt(md: Column, lines: int = 24, most: int = 6000) -> Column:
    """Title, the lines after the first heading that says abstract, and all headings: what a paper is tagged by."""
    said = F.split(without_comments(md), "\n")
    headings = F.transform(F.filter(said, lambda x: x.rlike(r"^##[ \t]")), lambda x: F.regexp_replace(x, r"^##[ \t]+", ""))
    at = F.array_position(F.transform(said, lambda x: x.rlike(r"(?i)^##[ \t].*abstract")), True).cast("int")
    abstract = F.when(at > 0, F.array_join(F.slice(said, at + 1, lines), "\n")).otherwise("")
    return F.substring(F.concat_ws("\n", title(md), abstract, F.array_join(headings, "\n")), 1, most)


#: Elements whose running sums are taken at a time.
RUN = 256


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once: inside a lambda every other expression is worked out for each element."""
    return F.transform(F.array(value), body)[0]


def sums_before(xs: Column) -> Column:
    """The sum of the numbers before each element of an array, in blocks, so that no long array is copied for each element."""
    add = lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x))

    def joined(blocks: Column) -> Column:
        totals = F.aggregate(F.transform(blocks, lambda b: F.element_at(b, -1)), F.array(F.lit(0)), add)
        return _let(totals, lambda t: F.flatten(F.transform(blocks, lambda b, i: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda x: x + t[i]))))

    def cut(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / RUN).cast("int")), lambda i: F.aggregate(F.slice(x, i * RUN + 1, F.lit(RUN)), F.array(F.lit(0)), add))

    return _let(xs, lambda x: F.when(F.size(x) > 0, _let(cut(x), joined)).otherwise(F.array().cast("array<int>")))


def sentence_spans(text: Column) -> Column:
    """The sentences with where they stand: an array of (sentence, start, end), in code points, end exclusive."""
    marks = F.regexp_extract_all(text, F.lit(f"({SENTENCE_END})"), F.lit(1))
    parts = F.split(text, SENTENCE_END)

    def measured(z: Column) -> Column:
        return F.transform(z["parts"], lambda p, i: F.char_length(p) + F.coalesce(F.char_length(F.get(z["marks"], i)), F.lit(0)))

    def placed(z: Column) -> Column:
        bare = F.transform(z["parts"], lambda p, i: F.struct(F.regexp_replace(p, f"^[{WHITE}]+", "").alias("tail"), F.char_length(p).alias("n"), z["starts"][i].alias("at")))
        trimmed = F.transform(bare, lambda e: F.struct(F.regexp_replace(e["tail"], f"[{WHITE}]+$", "").alias("sentence"), (e["at"] + e["n"] - F.char_length(e["tail"])).alias("start")))
        each = F.transform(trimmed, lambda e: F.struct(e["sentence"].alias("sentence"), e["start"].alias("start"), (e["start"] + F.char_length(e["sentence"])).alias("end")))
        return F.filter(each, lambda s: s["sentence"] != "")

    return _let(F.struct(parts.alias("parts"), marks.alias("marks")), lambda z: _let(F.struct(z["parts"].alias("parts"), sums_before(measured(z)).alias("starts")), placed))


def relative_time(then: Column, now: Column) -> Column:
    """just now, 5m ago, 3h ago, 2d ago, 7mo ago, 1y ago: months of 30 days, years of 12 such months."""
    minutes = F.floor((now.cast("timestamp").cast("long") - then.cast("timestamp").cast("long")) / 60)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    months = F.floor(days / 30)
    said = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return (
        F.when(minutes < 1, "just now").when(minutes < 60, said(minutes, "m")).when(hours < 24, said(hours, "h"))
        .when(days < 30, said(days, "d")).when(months < 12, said(months, "mo")).otherwise(said(F.floor(months / 12), "y"))
    )


def usage_line(input_tokens: Column, output_tokens: Column, latency_ms: Column) -> Column:
    """Tokens, where both numbers are known, and seconds, in small print; empty without a latency."""
    total = input_tokens + output_tokens
    tokens_said = F.when(total.isNotNull(), F.concat(F.format_number(total, 0), F.when(total == 1, " token").otherwise(" tokens")))
    seconds = F.concat(F.format_string("%.1f", latency_ms / F.lit(1000.0)), F.lit("s"))
    return F.when(latency_ms.isNull(), "").otherwise(F.concat(F.lit("_"), F.concat_ws(" · ", tokens_said, seconds), F.lit("_")))


#: How much of a snippet is looked for, the longest first, and the least that is worth it.
ANCHORS, SHORTEST = (220, 160, 110, 70, 40), 20


def reanchored(text: Column, snippet: Column) -> Column:
    """Where a snippet stands in a text whose white space may have changed since: (start, length), null where it doesn't.

    The longest beginning of the snippet that is there counts; blanks match any white space.
    """
    plain = F.regexp_replace(F.regexp_replace(snippet, STRIP, ""), f"[{WHITE}]+", " ")
    out = F.lit(None).cast("struct<start:int,length:int>")
    for n in reversed(ANCHORS):
        needle = F.substring(plain, 1, n)
        pattern = F.concat(F.lit("(?s)("), F.regexp_replace(F.regexp_replace(needle, r"([.*+?^${}()|\[\]\\])", r"\\$1"), " +", rf"[{WHITE}]+".replace("\\", "\\\\")), F.lit(")"))
        found = F.regexp_extract_all(text, pattern, F.lit(1))[0]
        out = F.when((F.char_length(needle) >= SHORTEST) & F.regexp_like(text, pattern), F.struct((F.position(found, text) - 1).cast("int").alias("start"), F.char_length(found).alias("length"))).otherwise(out)
    return out


def reanchored_in(text: Column, snippet: Column, start: Column, end: Column) -> Column:
    """The same inside a section only, from ``start`` to ``end`` (exclusive) in code points; anywhere where the section isn't known (null)."""
    here = reanchored(F.substring(text, start + 1, end - start), snippet)
    inside = F.when(here.isNotNull(), F.struct((here["start"] + start).cast("int").alias("start"), here["length"].alias("length")))
    return F.when(start.isNull() | end.isNull(), reanchored(text, snippet)).otherwise(inside)


def heading_slug(heading: Column) -> Column:
    """The anchor of a heading in rendered markdown: lower case, no marks, blanks as hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(heading, STRIP, "")), r"[^\p{L}\p{N}_ -]", ""), " ", "-")


def first_numbers(reply: Column, n: Column) -> Column:
    """The first JSON array of a model's reply as n numbers: what is no number is 0, so is what is missing; the rest goes."""
    found = F.from_json(F.regexp_extract(reply, r"\[[^\]]*\]", 0), "array<string>")
    numbers = F.transform(found, lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0)))
    padded = F.concat(F.coalesce(numbers, F.array().cast("array<double>")), F.array_repeat(F.lit(0.0), n))
    return F.slice(padded, F.lit(1), n)
