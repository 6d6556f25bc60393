import json

import pytest

from tessera.sources import files, html


def test_markdown_rules():
    page = '<title>x</title><nav>n</nav><h1>A &amp; B</h1><p>a <b>b</b> <a href="/y">l</a> <a href="#z">m</a> x<sup>2</sup> <math alttext="e=1">e</math></p><ul><li>i</li></ul><ol><li>j</li><li>k</li></ol><table><tr><th>h|</th></tr><tr><td>1</td><td>2</td></tr></table><script>s</script>'
    text, errors, error = html.to_markdown(page, "http://h/p")
    assert text == "## A & B\n\na **b** [l](http://h/y) m x^(2) e=1\n\n- i\n\n1. j\n2. k\n\n| h\\| |  |\n| --- | --- |\n| 1 | 2 |"
    assert (errors, error) == (0, None)
    assert html.to_markdown("")[2] == "no title"


PAPER = """<html><nav>menu</nav><article class="ltx_document"><h1 class="ltx_title ltx_title_document">On <em>Tides</em></h1>
<div class="ltx_abstract"><h6>Abstract</h6><p>We look at tides.</p></div>
<section><h2>1 Start</h2><p>See<span class="ltx_note"><sup class="ltx_note_mark">1</sup><span class="ltx_note_content"><span class="ltx_note_type">note</span> a side word</span></span>
 <math display="inline"><mi>x</mi><annotation encoding="application/x-tex">x^2</annotation></math> and <math alttext="y"><mi>y</mi></math>.</p>
<div><h3>Inner</h3><p>deep</p><span class="ltx_ERROR">oops</span></div>
<table class="ltx_equation"><tr><td><math display="block"><annotation encoding="application/x-tex">a=b</annotation></math></td><td>(1)</td></tr></table>
<table><tr><th>h</th></tr><tr><td>1</td><td>p|q</td></tr></table>
<ol><li><span class="ltx_tag">1.</span>first</li><li>second <b>bold</b></li></ol>
<figure><img src="f.png" alt="A [map]"><figcaption>Figure 1 | a map</figcaption></figure><pre>raw
 text</pre>
<section><h3>1.1 Below</h3><p>more<br>lines <code>k v</code></p></section></section></article></html>"""


def test_papers_are_rendered_by_their_parts():
    text, errors, error = html.to_markdown(PAPER, "https://h/p/", paper=True)
    assert (errors, error) == (1, None)
    assert text == (
        "## On *Tides*\n\n## Abstract\n\nWe look at tides.\n\n## 1 Start\n\nSee (a side word) $x^2$ and y.\n\n**Inner**\n\ndeep\n\n$$a=b$$ (1)\n\n"
        "| h |  |\n| --- | --- |\n| 1 | p\\|q |\n\n1. first\n2. second **bold**\n\nFigure 1 | a map\n\n```\nraw\n text\n```\n\n## 1.1 Below\n\nmore lines `k v`"
    )
    shown = html.to_markdown(PAPER, "https://h/p/", {"https://h/p/f.png": "assets/f.png"}, paper=True)[0]
    assert "![A map](assets/f.png)\n\nFigure 1" in shown


def test_what_is_no_paper_is_an_error():
    article = lambda inside: html.to_markdown(f'<article class="ltx_document">{inside}</article>', paper=True)
    title = '<h1 class="ltx_title_document">T</h1>'
    assert html.to_markdown("<p>x</p>", paper=True) == ("", 0, "no article")
    assert article("<p>x</p>")[2] == "no title" and article('<h1 class="ltx_title_document"> </h1>')[2] == "empty title"
    assert article(title)[2] == "no sections" and article(title + "<section><h2>A</h2></section>")[2] == "no body"


def test_pool_skips_display_copies(spark, tmp_path):
    for name in ("a", "b_display", "c d"):
        (tmp_path / f"{name}.md").write_text("## T\nbody")
    assert {r["paper_id"] for r in files.load_pool(spark, str(tmp_path)).collect()} == {"a", "c d"}


def test_pairs_reject_unknown_labels(spark, tmp_path):
    path = tmp_path / "p.jsonl"
    path.write_text(json.dumps({"premise": "a", "hypothesis": "b", "label": "maybe"}))
    with pytest.raises(ValueError, match="maybe"):
        files.read_pairs(spark, str(path))


def test_units_of_another_header_are_discarded(spark, tmp_path):
    path = str(tmp_path / "units")
    assert files.finished_units(spark, path, "v1").count() == 0
    files.record_units(spark.createDataFrame([("u1", "{}")], "unit string, record string"), path, "v1")
    assert files.finished_units(spark, path, "v1").count() == 1 and files.finished_units(spark, path, "v2").count() == 0
