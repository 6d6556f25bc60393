import random

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(PATH)


def samples():
    random.seed(1)
    signs = "ab \n\t'lst😀é<|endoftext|>12_- "
    fixed = ["", "a  b   c\n\n  d", "   ", "<|endoftext|>x<|endoftext|> <|endof", "don't 'll we'll 1234567890", "a" * 500, "日本語 😀😀   x", " " * 300 + "x", "a\x1cb\x1f c\x85d e　 f​ ̀ ½"]
    return fixed + ["".join(random.choice(signs) for _ in range(random.randrange(1, 50))) for _ in range(300)]


def test_counts_are_the_librarys(counter):
    library = Tokenizer.from_file(PATH)
    texts = samples() + [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    assert [counter.count(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_prefix(counter):
    library = Tokenizer.from_file(PATH)
    odd = ["I'll we're you've 'll'r don't're x", "a \n\n b\t\t<|endoftext|>  <|endoftext|><|endo", "!!<|endoftext|>!! 're<|endoftext|>", "日本語　　x 😀 😀", "\x85\x85x  y \x1c\x1cz"]
    for text in samples()[:120] + odd:
        stored = counter.table(text)
        for n in range(min(len(text), 60) + 1):
            assert token_counts.at_prefix(stored, len(text), n) == len(library.encode(text[:n], add_special_tokens=False).ids)


def test_query_shape(spark):
    df = spark.createDataFrame([(1, None, 9), (2, "hello world", 9), (None, "x " * 3000, 9)], "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: r for r in token_counts.token_counts(df, PATH).collect()}
    assert got[1]["n_tokens"] == 0 and got[2]["n_tokens"] == 2 and got[None]["over_limit"] and got[None]["fits_chars"] < 6000


def test_a_long_piece_is_cut_inside(counter):
    library = Tokenizer.from_file(PATH)
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for text in ("日本語漢字仮名" * 30, "#*~^" * 60, "zqxj" * 60, "some words, then " + "zqxj" * 60):
        n = token_counts.fits(counter.table(text), len(text), 50)
        assert n == max(k for k in range(len(text)) if size(text[:k]) <= 50)
    random.seed(4)
    letters = "".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6000))
    n = token_counts.fits(counter.table(letters), 6000, 1024)
    assert size(letters[:n]) <= 1024 and all(size(letters[:k]) > 1024 for k in range(n + 1, n + 40)) and n > 1024


def test_wide_steps(counter):
    """A step of more than a byte makes the whole table wide."""
    counter.steps["zqxj"] = b""
    wide, length = counter.table("some zqxj zqxj"), 14
    assert token_counts.at_prefix(wide, length, 14) == counter.count("some zqxj zqxj")
    counter.steps.clear()


def test_query_on_whole_documents(spark):
    """n_bytes, n_tokens and over_limit of the query are the library's, on every document, and fits_chars fits."""
    from tessera.llm import queries

    library = Tokenizer.from_file(PATH)
    texts = dict(duckdb.sql("SELECT doc_id, coalesce(text, '') FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    sizes = dict(zip(texts, (len(e.ids) for e in library.encode_batch(list(texts.values()), add_special_tokens=False))))
    rows = queries.op10_token_counts(spark, "/root/testdata/sf0.01").collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows} == {d: (len(t.encode()), sizes[d], sizes[d] > 1024) for d, t in texts.items()}
    for r in rows:
        if r["over_limit"]:
            assert len(library.encode(texts[r["doc_id"]][: r["fits_chars"]], add_special_tokens=False).ids) <= 1024


def test_empty_table(spark):
    assert token_counts.token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
