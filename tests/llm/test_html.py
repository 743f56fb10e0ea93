"""Main text of hand-labelled pages of several kinds, with their class names and without."""

import re
import time
from collections import Counter

import pytest

from ledgerbrook.llm import html_text

#: Pages and their main text. The words are plain; what is main text was decided by reading.
PAGES = [
    (
        """<!DOCTYPE html><html><head><title>Bridge closed - The Valley Post</title></head><body><header class="masthead"><a href="/">The Valley Post</a><p>News since 1890</p></header>
<nav class="main-nav"><ul><li><a href="/a">Home</a></li><li><a href="/b">Local news</a></li><li><a href="/c">Sport</a></li><li><a href="/d">Weather</a></li></ul></nav>
<div class="ad-slot">Winter tyres at half the price, this week only</div>
<main><article class="story"><h1>Old bridge closed for repairs</h1><p>The stone bridge over the mill stream will stay closed until the end of spring, the council said on Monday, after divers found cracks in two of its piers.</p>
<p>Buses use the <a href="/route">northern road</a> meanwhile. Walkers may take the wooden footbridge next to the old tannery, which has been open since last autumn.</p>
<h2>Costs</h2><p>The work is expected to cost two million, most of which the county pays.</p><ul><li>Piers: one million</li><li>Roadway: half a million</li><li>Lamps and railings</li></ul>
<p>Short.</p><blockquote>We should have looked ten years ago, said the mayor, who was not in office then.</blockquote></article></main>
<aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Bakery wins prize again</a></li><li><a href="/2">School gets new roof</a></li><li><a href="/3">Ten walks for the summer</a></li></ul></aside>
<section class="comments"><h2>3 comments</h2><p>Hanna, yesterday</p><p>About time that somebody looked at those piers, I have said so for years and nobody listened.</p><a href="#">Reply</a></section>
<footer class="page-footer"><p>Copyright The Valley Post. All rights reserved.</p><a href="/imprint">Imprint</a> <a href="/privacy">Privacy</a></footer></body></html>""",
        """Old bridge closed for repairs The stone bridge over the mill stream will stay closed until the end of spring, the council said on Monday, after divers found cracks in two of its piers.
Buses use the northern road meanwhile. Walkers may take the wooden footbridge next to the old tannery, which has been open since last autumn. Costs The work is expected to cost two million, most of which
the county pays. Piers: one million Roadway: half a million Lamps and railings Short. We should have looked ten years ago, said the mayor, who was not in office then.""",
    ),
    (
        """<html><body><div id="header"><a href="/">My garden notes</a></div><div id="menu"><ul><li><a href=1>About</a><li><a href=2>Archive</a><li><a href=3>Plants</a><li><a href=4>Contact</a></ul></div>
<div id="cookie-notice"><p>This site uses cookies to count its visitors.</p><button>Fine</button></div>
<div id="content"><h2>Sowing beans in June</h2><p>It is not too late. Beans sown in the first week of June catch up with those of May, since the soil is warm and slugs have fewer weeks to find them, at least where I live.</p>
<p>Soak the beans over night, lay five in a ring around each pole, and cover them with two fingers of soil. Water once, then leave them alone until they show.</p><p>If they do not show after ten days, dig one up and look.</p>
<p>Those who want more can read <a href="/x">last year's notes</a>, which have drawings too.</p></div>
<div class="share"><ul><li><a href=f>Share</a><li><a href=t>Tweet</a><li><a href=m>Mail</a></ul></div>
<div class="related-posts"><h3>Read on</h3><ul><li><a href=5>Why compost heats up</a><li><a href=6>Peas and what eats them</a><li><a href=7>A shed for tools</a></ul></div>
<div id="footer">Written by hand. <a href="/rss">Feed</a></div></body></html>""",
        """Sowing beans in June It is not too late. Beans sown in the first week of June catch up with those of May, since the soil is warm and slugs have fewer weeks to find them, at least where I live.
Soak the beans over night, lay five in a ring around each pole, and cover them with two fingers of soil. Water once, then leave them alone until they show. If they do not show after ten days, dig one up and look.
Those who want more can read last year's notes, which have drawings too.""",
    ),
    (
        """<html><body><table><tr><td><a href=a>Index</a><td><a href=b>Volume one</a><td><a href=c>Volume two</a><td><a href=d>Letters</a></table>
<h1>Chapter three, in which the travellers reach the coast</h1>
<p>They had walked for nine days when the road turned and there was the sea, grey and quite still, with one sail on it that did not seem to move at all.</p>
<p>Nobody spoke. Then the youngest laughed and ran ahead, and the others followed more slowly, since they carried the tent and the pots and what was left of the flour.</p>
<p>In the evening they made a fire of driftwood, which burns blue, and the old man told them about the island where he was born and about the ferry that went there once a year.</p>
<p>It was late when they slept.</p>
<table><tr><td><a href=e>Previous chapter</a><td><a href=f>Contents</a><td><a href=g>Next chapter</a></table></body></html>""",
        """Chapter three, in which the travellers reach the coast They had walked for nine days when the road turned and there was the sea, grey and quite still, with one sail on it that did not seem to move at all.
Nobody spoke. Then the youngest laughed and ran ahead, and the others followed more slowly, since they carried the tent and the pots and what was left of the flour.
In the evening they made a fire of driftwood, which burns blue, and the old man told them about the island where he was born and about the ferry that went there once a year. It was late when they slept.""",
    ),
    (
        """<html><body><header><nav><a href=1>Docs</a> <a href=2>Blog</a> <a href=3>Help</a></nav></header><main><article><header><h1>Release notes</h1></header>
<p>This release makes the importer twice as fast and mends the sorting of names with accents, which had been wrong on one platform for as long as anybody can remember.</p><pre>import --all --quiet</pre>
<p>Those who wrote filters of their own must rename one option; see the table.</p><table><tr><th>Old<th>New</tr><tr><td>strict<td>exact</tr></table>
<article><p>Kim says: thank you for the fix, I had given up hoping that it would ever be mended and wrote my own tool.</p></article></article></main>
<aside><p>Sponsored by a company that makes keyboards for people who type a lot.</p></aside><form><p>Get these notes by mail every month, free of charge.</p><label>Your address</label><input></form>
<footer><p>The project is run by volunteers. <a href=4>Join</a></p></footer></body></html>""",
        """Release notes This release makes the importer twice as fast and mends the sorting of names with accents, which had been wrong on one platform for as long as anybody can remember. import --all --quiet
Those who wrote filters of their own must rename one option; see the table. Old New strict exact""",
    ),
]


@pytest.mark.parametrize("named", [True, False])
def test_labelled_pages(named):
    """Words found against words wanted, with all class and id names and with none."""
    hit = found = wanted = 0
    for html, text in PAGES:
        html = html if named else re.sub(r'\s(?:class|id)="[^"]*"', "", html)
        got, want = Counter(html_text.main_text(html).split()), Counter(text.split())
        hit += (got & want).total()
        found += got.total()
        wanted += want.total()
        if named and "<article" in html or 'id="content"' in html:  # markup tells all
            assert html_text.main_text(html) == " ".join(text.split())
    assert hit / found >= 0.95 and hit / wanted >= 0.95, (hit / found, hit / wanted)


def test_rule_made_pages():
    """Pages that weren't learnt from, in all manners of markup: precision and recall by words."""
    for manner in range(3):
        hit = found = wanted = 0
        for k in range(60):
            blocks = html_text.blocks(html_text.Lesson(html_text.np.random.default_rng([5, k]), manner).page())
            for row, b in zip(html_text.features(blocks), blocks, strict=True):
                kept, main = html_text.tree().predict(row) >= 0.5, b.text.startswith("m")
                hit, found, wanted = hit + b.words * (kept and main), found + b.words * kept, wanted + b.words * main
        assert hit / found >= 0.95 and hit / wanted >= 0.95, manner


def test_neighbours_decide():
    """The tree splits on neighbours' words and links, and with the same block other neighbours change the outcome."""
    used, todo = Counter(), [html_text.tree()]
    while todo:
        node = todo.pop()
        if node.at is not None:
            used[html_text.FEATURES[node.at]] += 1
            todo += [node.low, node.high]
    assert all(used[x] for x in ("words", "links", "words_before", "links_before", "words_after", "links_after"))
    names = used["away"] + used["content"] + used["outside"]
    assert sum(used.values()) - names > 2 * names
    item, text = "<div>see this as well</div>", "<div>" + "word " * 60 + "</div>"
    link = "<div><a href=x>one two</a></div>"
    assert "see this" in html_text.main_text(f"<div>{text * 2}{item}{text * 2}</div>")
    assert "see this" not in html_text.main_text(f"<div>{link * 4}{item}{link * 4}{text * 3}</div>")


def test_deep_and_long_pages():
    """Nesting of any depth and very long texts take time in proportion."""
    deep = "<article>" + "<div>" * 20_000 + "<p>a text that stands very deep in the page</p>" * 50 + "</div>" * 20_000
    long = "<article>" + "<p>" + "word " * 200_000 + "</p>" + "<i>x</i>" * 50_000 + "</article>"
    began = time.perf_counter()
    assert html_text.main_text(deep).count("very deep") == 50
    assert len(html_text.main_text(long)) > 1_000_000
    assert time.perf_counter() - began < 20


def test_repeated_rows(spark):
    rows = [(1, "u", PAGES[0][0])] * 3 + [(1, None, PAGES[1][0]), (None, "v", PAGES[0][0])]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    texts = Counter((r.page_id, r.text) for r in got)
    one, two = (" ".join(t.split()) for _, t in PAGES[:2])
    assert texts == {(1, one): 3, (1, two): 1, (None, one): 1} and all(r.n_chars == len(r.text) for r in got)
