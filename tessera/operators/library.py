"""Operations on a paper library: tags, scopes, upserts, citations, chats and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import bibtex_escape, kebab, year_of


def tag_counts(manifest: DataFrame) -> DataFrame:
    """tag, n, most frequent first; a tag twice in one record counts twice."""
    return manifest.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag")


def discriminating_tags(manifest: DataFrame) -> DataFrame:
    """Tags that not every paper has; of a single paper, all."""
    n = manifest.agg(F.count(F.lit(1)).alias("papers"))
    return tag_counts(manifest).join(F.broadcast(n)).filter((F.col("n") < F.col("papers")) | (F.col("papers") <= 1)).drop("papers")


def tagged(manifest: DataFrame, wanted: list[str]) -> DataFrame:
    """Papers with any of the tags."""
    return manifest.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in wanted])))


def scope(manifest: DataFrame, tags: list[str] | None = None, papers: DataFrame | None = None) -> DataFrame:
    """paper_id of what both filters allow; None is no filter, an empty list allows nothing."""
    out = manifest if tags is None else (tagged(manifest, tags) if tags else manifest.limit(0))
    return (out if papers is None else out.join(papers, "paper_id", "left_semi")).select("paper_id")


def rarest_tags(manifest: DataFrame, most: int = 3) -> DataFrame:
    """Up to three tags of each paper, those with the fewest papers first, else in the paper's order."""
    counts = tag_counts(manifest)
    each = manifest.select("paper_id", F.posexplode("tags").alias("pos", "tag")).join(counts, "tag")
    w = Window.partitionBy("paper_id").orderBy("n", "pos")
    return each.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("paper_id", "tag", "rank")


def remap_tags(manifest: DataFrame, mapping: DataFrame) -> DataFrame:
    """Tags replaced by (src, dst) where there is one; first occurrences stay, in order."""
    each = manifest.select("paper_id", F.posexplode("tags").alias("pos", "tag")).join(mapping, F.col("tag") == F.col("src"), "left")
    each = each.select("paper_id", "pos", F.coalesce("dst", "tag").alias("tag"))
    first = each.groupBy("paper_id", "tag").agg(F.min("pos").alias("pos"))
    return first.groupBy("paper_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "tag"))), lambda x: x["tag"]).alias("tags"))


def valid_mapping(proposed: DataFrame, known: DataFrame) -> DataFrame:
    """Proposed (src, dst) whose source is a known tag and whose target, made canonical, differs from it."""
    m = proposed.select("src", kebab(F.col("dst")).alias("dst")).join(known.select(F.col("tag").alias("src")).distinct(), "src", "left_semi")
    return m.filter((F.col("dst") != "") & (F.col("src") != F.col("dst")))


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key isn't there."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def replace_groups(old: DataFrame, new: DataFrame, group: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Re-index whole groups: the table afterwards, and the stale keys that went."""
    touched = new.select(group).distinct()
    stale = old.join(touched, group, "left_semi").select(group, key).join(new.select(group, key), [group, key], "left_anti")
    return old.join(touched, group, "left_anti").unionByName(new), stale


def pending(config: DataFrame, manifest: DataFrame, attempted: DataFrame | None = None) -> DataFrame:
    left = config.join(manifest.select("paper_id"), "paper_id", "left_anti")
    return left if attempted is None else left.join(attempted.select("paper_id"), "paper_id", "left_anti")


def remove_everywhere(paper_ids: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """The same papers out of every table, the first one first."""
    return [t.join(paper_ids, "paper_id", "left_anti") for t in tables]


def cited_by(edges: DataFrame, pooled: DataFrame) -> DataFrame:
    """Cited ids that are not in the pool: one vote for each citing paper, and the first label in order."""
    votes = edges.join(pooled, "arxiv_id", "left_anti").groupBy("arxiv_id").agg(F.countDistinct("paper_id").alias("cited_by"), F.min_by("label", F.struct("paper_id", "pos")).alias("label"))
    return votes.orderBy(F.desc("cited_by"), "arxiv_id")


def usage(rounds: DataFrame, *by: str, strict: bool = True) -> DataFrame:
    """Token sums; strict: unknown as soon as one round's is unknown."""
    total = lambda c: F.when(F.count(c) == F.count(F.lit(1)), F.sum(c)) if strict else F.sum(c)
    return rounds.groupBy(*by).agg(total("input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens"))


def ref_offsets(turns: DataFrame) -> DataFrame:
    """Where a turn's references start, when numbering runs through the chat: (chat_id, turn, n_refs)."""
    w = Window.partitionBy("chat_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("offset", F.coalesce(F.sum("n_refs").over(w), F.lit(0)))


def truncate_before(turns: DataFrame, n: int) -> DataFrame:
    return turns.filter(F.col("turn") < n)


def notes(annotations: DataFrame, manifest: DataFrame, query: str = "") -> DataFrame:
    """Notes with their paper's title, by title and newest first; the query is looked for in snippet and note."""
    q = F.lit(query.lower())
    hit = F.lower("snippet").contains(q) | F.lower("note").contains(q)
    return annotations.filter(hit).join(manifest.select("paper_id", "title"), "paper_id").orderBy("title", F.desc("created_at"))


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the first in order."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def bibtex(cited: DataFrame) -> DataFrame:
    """paper_id, entry, pos: one BibTeX entry for each paper, in order of its first citation (paper_id, title, arxiv_id, pos).

    A paper without an arXiv id has none of the lines that come from it.
    """
    known = F.col("arxiv_id").isNotNull() & (F.col("arxiv_id") != "")
    fields = [
        F.concat(F.lit("  title = {"), bibtex_escape(F.col("title")), F.lit("}")),
        F.when(known, F.concat(F.lit("  eprint = {"), F.col("arxiv_id"), F.lit("}"))),
        F.when(known, F.lit("  archivePrefix = {arXiv}")),
        F.concat(F.lit("  year = {"), year_of(F.col("arxiv_id")).cast("string"), F.lit("}")),
    ]
    entry = F.concat(F.lit("@misc{"), F.col("paper_id"), F.lit(",\n"), F.array_join(F.array_compact(F.array(*fields)), ",\n"), F.lit(",\n}"))
    return first_seen(cited, "paper_id", "pos").select("paper_id", entry.alias("entry"), "pos")


def markdown_notes(joined: DataFrame) -> DataFrame:
    """title, markdown: the notes of each paper, newest first; a paper's notes are few."""
    line = F.concat(F.lit("> "), F.col("snippet"), F.lit("\n\n"), F.col("note"))
    rows = joined.select("title", F.struct(F.col("created_at"), line.alias("text")).alias("x"))
    listed = F.transform(F.sort_array(F.collect_list("x"), asc=False), lambda x: x["text"])
    return rows.groupBy("title").agg(listed.alias("x")).select("title", F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), F.array_join("x", "\n\n")).alias("markdown"))


def support(scored: DataFrame) -> DataFrame:
    """The best supported verdict for each (ref, sentence): label and score of the passage with the highest score."""
    return scored.groupBy("ref", "sentence").agg(F.max_by("label", F.struct("score", "label")).alias("label"), F.max("score").alias("score"))


def severity(label: Column) -> Column:
    return F.when(label == "contradiction", 2).when(label == "neutral", 1).otherwise(0)


def with_titles(citations: DataFrame, manifest: DataFrame) -> DataFrame:
    """Citations with title and arxiv_id of their paper; one that the manifest hasn't got is called by its id."""
    known = manifest.select("paper_id", F.col("title").alias("__t"), F.col("arxiv_id").alias("__a"))
    j = citations.join(known, "paper_id", "left")
    return j.withColumns({"title": F.coalesce("__t", "paper_id"), "arxiv_id": F.col("__a")}).drop("__t", "__a")


def valid_groups(groups: DataFrame, sections: DataFrame) -> DataFrame:
    """group_id of the match groups (group_id, paper_id, section_number, section_title) that can be compared.

    Two papers at least, none twice, and every entry a section that exists.
    """
    known = sections.select("paper_id", F.coalesce("number", F.lit("")).alias("section_number"), F.col("title").alias("section_title")).distinct().withColumn("__known", F.lit(True))
    g = groups.withColumn("section_number", F.coalesce("section_number", F.lit(""))).join(known, ["paper_id", "section_number", "section_title"], "left")
    whole = g.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("paper_id").alias("papers"), F.count("__known").alias("there"))
    return whole.filter((F.col("n") >= 2) & (F.col("papers") == F.col("n")) & (F.col("there") == F.col("n"))).select("group_id")


def feedback(turns: DataFrame, chat_id: Column, turn: Column, vote: str | None, note: str = "") -> DataFrame:
    """One turn's vote set, or cleared with None; other votes than up and down are an error."""
    if vote not in (None, "up", "down"):
        raise ValueError(f"a vote is up, down or None, not {vote!r}")
    here = (F.col("chat_id") == chat_id) & (F.col("turn") == turn)
    return turns.withColumns({
        "vote": F.when(here, F.lit(vote).cast("string")).otherwise(F.col("vote")),
        "note": F.when(here, F.lit(note if vote else None).cast("string")).otherwise(F.col("note")),
    })


def append_turns(turns: DataFrame, new: DataFrame) -> DataFrame:
    """New (chat_id, seq, ...) rows behind the chats' turns, numbered on from each chat's last."""
    last = turns.groupBy("chat_id").agg(F.max("turn").alias("__last"))
    numbered = new.join(last, "chat_id", "left").withColumn("turn", (F.coalesce("__last", F.lit(-1)) + F.row_number().over(Window.partitionBy("chat_id").orderBy("seq"))).cast("long"))
    return turns.unionByName(numbered.drop("__last", "seq"), allowMissingColumns=True)


def sessions(turns: DataFrame, most: int = 60) -> DataFrame:
    """chat_id, title, scope, n_turns, updated_at, the latest first: title and scope are those of the first turn."""
    s = turns.groupBy("chat_id").agg(
        F.substring(F.min_by("question", "turn"), 1, most).alias("title"), F.min_by("scope", "turn").alias("scope"), F.count(F.lit(1)).alias("n_turns"), F.max("created_at").alias("updated_at")
    )
    return s.orderBy(F.desc("updated_at"), "chat_id")


def without_chat(turns: DataFrame, chat_ids: DataFrame) -> DataFrame:
    return turns.join(chat_ids, "chat_id", "left_anti")


def annotate(annotations: DataFrame, new: DataFrame) -> DataFrame:
    """Notes created or changed: a changed one keeps when it was created, what it stands at, and its snippet."""
    changed = annotations.select("id", F.col("created_at").alias("__c"), F.col("snippet").alias("__s"))
    n = new.join(changed, "id", "left").withColumns({"created_at": F.coalesce("__c", "created_at"), "snippet": F.coalesce("__s", "snippet")}).drop("__c", "__s")
    return upsert(annotations, n.select(*annotations.columns), "id")


def grouped_sources(citations: DataFrame) -> DataFrame:
    """kind, source, refs, pos: papers and web pages that are cited, each with its refs in order, first seen first."""
    web = F.col("paper_id").isNull()
    c = citations.select(F.when(web, "web").otherwise("paper").alias("kind"), F.coalesce("paper_id", "url").alias("source"), "ref", "pos")
    g = c.groupBy("kind", "source").agg(F.min("pos").alias("pos"), F.sort_array(F.collect_list(F.struct("pos", "ref"))).alias("x"))
    return g.select("kind", "source", "pos", F.array_join(F.transform("x", lambda r: r["ref"]), ",").alias("refs"))


def merged_config(config: DataFrame, added: DataFrame) -> DataFrame:
    """Papers added to a configuration: (name, arxiv_id, status), queued, or a duplicate, or invalid.

    An id that is there under whatever name is a duplicate; of repeated additions the first counts.
    """
    from tessera.functions.text import arxiv_id

    new = added.select("pos", F.col("raw"), arxiv_id(F.col("raw")).alias("arxiv_id"))
    known = config.select("arxiv_id", F.col("name").alias("known")).dropDuplicates(["arxiv_id"])
    first = F.row_number().over(Window.partitionBy("arxiv_id").orderBy("pos"))
    j = new.join(known, "arxiv_id", "left").withColumn("__n", first)
    status = F.when(F.col("arxiv_id").isNull(), "invalid").when(F.col("known").isNotNull() | (F.col("__n") > 1), "duplicate").otherwise("queued")
    return j.select("pos", "raw", "arxiv_id", F.coalesce("known", "arxiv_id").alias("name"), status.alias("status"))


def fallback(html: DataFrame, pdf: DataFrame) -> DataFrame:
    """(paper_id, markdown, source, warnings): the page's text, else the PDF's, with a warning that says why; null where both fail."""
    j = html.select("paper_id", F.col("markdown").alias("h"), F.col("error").alias("why")).join(pdf.select("paper_id", F.col("markdown").alias("p")), "paper_id", "full")
    used = F.when(F.col("h").isNotNull(), "html").when(F.col("p").isNotNull(), "pdf")
    warned = F.when(F.col("h").isNull(), F.array(F.concat(F.lit("html: "), F.coalesce("why", F.lit("not there"))))).otherwise(F.array().cast("array<string>"))
    return j.select("paper_id", F.coalesce("h", "p").alias("markdown"), used.alias("source"), warned.alias("warnings"))


def claims(marks: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Which verdict each citation mark shows: marks (ref, sentence, start) in order, verdicts (ref, sentence, pos, label).

    The n-th place where a ref is cited in a sentence of the same wording takes the n-th verdict; marks of one place share it.
    """
    places = marks.select("ref", "sentence", "start").distinct()
    n = places.withColumn("n", F.row_number().over(Window.partitionBy("ref", "sentence").orderBy("start")))
    v = verdicts.withColumn("n", F.row_number().over(Window.partitionBy("ref", "sentence").orderBy("pos"))).drop("pos")
    return n.join(v, ["ref", "sentence", "n"], "left").drop("n")
