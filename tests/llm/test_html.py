import html as entities
import re
import time

import numpy as np

from kinstrand.llm import html
from kinstrand.llm.boosting import fit


def test_boosted_trees_learn_a_rule():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    model = fit(x[:1500], y[:1500])
    assert ((model.log_odds(x[1500:]) > 0) == y[1500:]).mean() > 0.95


def test_held_out_pages():
    model, right, exact = html.classifier(), [], 0
    for seed in range(90_000, 90_200):
        source, labels = html.synthetic_page(seed)
        page = html.Page(source)
        odds = model.log_odds(page.features())
        right += ((odds > 0) == np.array(labels)).tolist()
        exact += page.main_blocks(odds) == [t for k, t in page.blocks if labels[k]]
    assert np.mean(right) > 0.98 and exact / 200 > 0.85, (np.mean(right), exact)


def test_choice_is_consistent():
    """No node inside the article has a cut or outside node between it and where the article began."""
    rng = np.random.default_rng(0)
    for seed in range(40):
        page = html.Page(html.synthetic_page(seed)[0])
        odds = rng.normal(0, 3, len(page.nodes))
        parent, best = page.parents(), None
        n = len(odds)
        if n > 9:
            continue
        for code in range(3**n):
            state = [code // 3**k % 3 for k in range(n)]  # 0 outside, 1 inside, 2 cut
            ok = state[0] != 2 and all((state[parent[k]], state[k]) in {(0, 0), (0, 1), (1, 1), (1, 2), (2, 2)} for k in range(1, n))
            if ok:
                total = sum(odds[k] * (state[k] == 1) for k in range(n))
                total -= sum(html.BEGIN_COST for k in range(n) if state[k] == 1 and (k == 0 or state[parent[k]] == 0))
                total -= sum(html.CUT_COST for k in range(1, n) if state[k] == 2 and state[parent[k]] == 1)
                if best is None or total > best[0] + 1e-9:
                    best = (total, state)
        want = [t for k, t in page.blocks if best[1][k] == 1]
        assert page.main_blocks(odds) == want


def test_pages(spark, sf_dir):
    rows = {r["page_id"]: r for r in html.extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()}
    good = 0
    for p in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", p["html"] or "", re.S)
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article[1])] if article else []
        got = rows[p["page_id"]]
        assert got["n_chars"] == len(got["text"]) and got["url"] == p["url"]
        good += got["text"] == "\n".join(b for b in blocks if b)
    assert good / len(rows) > 0.98


def test_blocks():
    page = html.Page("<div>a &amp; b<br>c<script>x<p>y</script><p>one<b> two<p>three &lt;3  </div>tail <!-- no --> <ul><li>i<li>j</ul><a href='>'>k</a> < l <i")
    assert [t for _, t in page.blocks] == ["a & b c", "one two", "three <3", "tail", "i", "j", "k < l"]


def test_attribute_values_have_no_bound():
    for n in (3000, 5000, 1 << 20):
        page = html.Page(f'<div data-x="{"A" * n} > leak me">Inner</div><p title=\'{"b>" * n}\'>two')
        assert [t for _, t in page.blocks] == ["Inner", "two"]
    assert [t for _, t in html.Page('<p title="it"s">one</p><p x=">two</p><p>three').blocks] == ["one", "two", "three"]
    assert [t for _, t in html.Page("<!-->a<!--->b<!-- <p>x</p> -->c</>d</ x>e<?x y?>f").blocks] == ["abcdef"]
    assert html.decode_references("&#" + "0" * 9000 + "65;&#x0041;&#" + "9" * 9000 + "; &amp;&#65") == "AA\ufffd &A"


def test_time_is_linear_in_the_page():
    """Pages of a megabyte of what a scanner may read again and again."""
    for unit in ("<a ", "<b>", "<h1>", "<p><x>", "</i>", "<svg/>", "<script>", "<p x='", '<p x="\'', "<", "&#", "<li>", "<!--", "<p><button><x>", "=\"", "<td><p><h1>", "<title"):
        source = "<p>" + unit * ((1 << 20) // len(unit)) + "<p>"
        began = time.perf_counter()
        html.Page(source)
        assert time.perf_counter() - began < 12, unit
    began = time.perf_counter()
    html.Page("<b>" * 150_000 + "<div>" + "</b>" * 100_000)
    html.Page("<p>" + "<x>" * 150_000 + "</y>" * 100_000)
    assert time.perf_counter() - began < 12


def test_hidden_nodes():
    hidden = lambda tag: html.Page(tag + "x").nodes[1].hidden
    assert all(map(hidden, ("<div hidden>", "<p style='display: none'>", '<p aria-hidden="true">', "<p class='a hidden b'>", "<p id=k hidden class=c>")))
    assert not any(map(hidden, ('<p title="the hidden truth">', "<p class=hiddenness>", "<p data-hidden=1>")))


def test_edges(spark):
    long = "<html><body><nav><a href=/>x</a></nav><article>" + "<p>some words of text, and more.</p>" * 30000 + "</article></body></html>"
    rows = [(1, "u", None), (2, "u", ""), (3, None, "plain words only, nothing else."), (None, "u", "<article><p>Text here, of some length.</p></article>"), (4, "u", long), (4, "u", long), (5, "u", "<" * 5000), (6, "u", "<div class='" * 300), (7, "u", "<p" + " a=\"b" * 2000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = html.extract_main_text(df).collect()
    assert len(got) == len(rows)
    by = {(r["page_id"]): r for r in got}
    assert by[1]["text"] == by[2]["text"] == "" and by[1]["n_chars"] == 0
    assert by[4]["text"].count("\n") == 29999 and by[3]["text"] == "plain words only, nothing else."
    assert html.extract_main_text(df.limit(0)).count() == 0
