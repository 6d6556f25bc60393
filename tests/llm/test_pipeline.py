"""The pipeline's stages and its whole run against brute force, on real documents with every odd row among them."""

import re

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mixing, pii, quality_rules
from tessera.llm.common import DOC_COLUMNS
from tessera.llm.queries import KEY, ORACLES
from tests.llm.test_operators import jaccard_classes

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    (_, quality), (_, near), (_, leaks), (_, hidden), (_, mixed) = corpus_pipeline.STAGES
    good = quality(spark, docs, SF).cache()
    want = {r["doc_id"] for r in quality_rules.ledger(docs).filter(quality_rules.kept_by("v1")).collect()}
    assert {r["doc_id"] for r in good.collect()} == want and good.columns == list(DOC_COLUMNS)
    one = near(spark, good, SF).cache()
    assert {r["doc_id"] for r in one.collect()} == set(jaccard_classes([(r["doc_id"], r["text"]) for r in good.collect()]).values())
    clean = leaks(spark, one, SF).cache()
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r["doc_id"] for r in one.collect()} - {r["doc_id"] for r in clean.collect()} >= {r["doc_id"] for r in one.collect() if any(i in r["text"] for i in items)}
    private = hidden(spark, clean, SF).cache()
    assert private.count() == clean.count() and all(r["n_chars"] == len(r["text"]) for r in private.collect())
    assert mixed(spark, private, SF).count() == private.count()


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def leaks_by_brute_force(texts, items, rare):
    """Whether a text leaks any item: every part of every item against every window of the text, without any bound first."""
    out = set()
    for text in texts:
        doc = re.findall(r"\w+", (text or "").lower())
        for number, item in items:
            told, wide = rare[number], (-(-len(item) // 16) + 1) * 16
            for k in range(0, max(1, len(doc) - wide + 16), 16):
                window = doc[k : k + wide]
                if 2 * len(told & set(window)) >= len(told) and subsequence(item, window) >= 0.6 * len(item):
                    out.add(text)
                    break
            if text in out:
                break
    return out


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    """Tables with nulls in any column, empty and long texts, repeated ids and rows, copies, leaks, and columns that clash."""
    at = tmp_path_factory.mktemp("odd")
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("__key", F.lit("x")).withColumn("rate", F.lit(1)).withColumn("n_tokens", F.lit("t"))
    real = [r.asDict() for r in docs.filter(F.char_length("text") < 4000).orderBy("doc_id").limit(90).collect()]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    row = lambda i, text, **more: {**real[0], "doc_id": i, "text": text, "n_chars": 1, **more}
    turned = lambda t: " ".join(reversed(t.split()))
    fine = [r["text"] for r in real if r["text"] and len(r["text"].split()) > 60][:8]
    odd = [
        row(None, fine[0]), row(None, None), row(5000, None), row(5001, ""), row(5002, " \n\t "), row(5003, fine[1], lang=None, source=None, n_chars=None),
        row(5004, turned(fine[2]) + " " + items[0]), row(5008, turned(fine[7]) + " such a word here"), row(5004, fine[3]), row(5004, fine[3]), row(5005, " ".join(f"{w}{i}" for i, w in enumerate(fine[4].split() * 300))),
        row(5006, fine[5] + " reach me at someone@mail.example or 4111111111111111"), row(5007, fine[6]), row(5007, fine[6] + " and one word more"),
    ]
    spark.createDataFrame(real + odd, docs.schema).coalesce(2).write.parquet(str(at / "documents.parquet"))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").limit(12)
    bench.unionByName(spark.createDataFrame([(None, None), (900, ""), (901, "a word")], bench.schema)).coalesce(1).write.parquet(str(at / "benchmark.parquet"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.unionByName(spark.createDataFrame([(None, 1, 0), (5004, None, 1)], labels.schema)).coalesce(1).write.parquet(str(at / "labels.parquet"))
    return str(at)


def test_whole_run_against_brute_force(spark, odd_dir):
    got = corpus_pipeline.run(spark, odd_dir).collect()
    # Quality by the query's SQL, near copies by all pairs, leaks by every window, pseudonyms text by text.
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{odd_dir}/documents.parquet/*.parquet'")
    rows = [(d, t) for d, t in duck.execute("SELECT doc_id, text FROM documents").fetchall()]
    good = {t for t, k in zip([r[1] for r in rows], judged(spark, [t for _, t in rows])) if k}
    rows = [(d, t) for d, t in rows if t in good]
    names = jaccard_classes([(i, t) for i, (_, t) in enumerate(rows)])
    best = {}
    for i, (d, t) in enumerate(rows):
        key = (d is None, d or 0, normal(t))
        if names[i] not in best or key < best[names[i]][0]:
            best[names[i]] = (key, d, t)
    one = [(d, t) for _, d, t in best.values()]
    items = [(r["item_id"], r["text"], None) for r in spark.read.parquet(f"{odd_dir}/benchmark.parquet").collect()]
    docs = spark.createDataFrame(one, "doc_id long, text string")
    index = decontaminate.build(docs, [(i, t, a) for i, (_, t, a) in enumerate(items)])
    words = {v: k for k, v in index.vocabulary.items()}
    parts = [(k, [words[x] for x in p[1].tolist()]) for k, p in enumerate(index.parts) if len(p[1]) >= decontaminate.LEAST]
    rare = {k: {words[x] for x in p[3][p[5] == 1].tolist()} for k, p in enumerate(index.parts)}
    dirty = leaks_by_brute_force([t for _, t in one], parts, rare) | {t for _, t in one if re.search(r"(?<!\w)a word(?!\w)", t.lower())}
    clean = [(d, t) for d, t in one if t not in dirty]
    assert dirty and len(clean) < len(one) < len(rows)
    both = spark.createDataFrame([(t, t) for _, t in clean], "text string, old string")
    hidden = {r["old"]: r["text"] for r in pii.pseudonymise(both, KEY, ("text", "old")).collect()}
    want = sorted((d is None, d or 0, hidden[t]) for d, t in clean)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in got) == want
    assert all(r["n_chars"] == len(r["text"]) and r["rate"] >= 0 and abs(sum(r[f"p_{d}"] for d in mixing.DOMAINS) - 1) < 1e-9 for r in got)
    assert all(r["n_tokens"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in got)
    assert not any("4111111111111111" in r["text"] or "someone@mail" in r["text"] for r in got)


def normal(text):
    return " ".join(re.findall(r"[^\x20\x09-\x0D]+", text.lower()))


def judged(spark, texts):
    """Whether the quality SQL keeps each text, by a table of the texts alone."""
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    kept = dict(duck.execute(f"SELECT doc_id, kept FROM ({ORACLES['op6_quality_ledger']})").fetchall())
    return [kept[i] for i in range(len(texts))]


def test_empty_tables_run_through(spark, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns[: len(DOC_COLUMNS)] == list(DOC_COLUMNS)
