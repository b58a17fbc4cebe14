import os
import time

import pyarrow.parquet as pq
import pytest

from inkloom.llm import html_extract as H

DATA = "/root/testdata/sf0.01"

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="page">
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- note <p>no</p> --><div class="ad">Buy now, friends.</div>
<article><h1>The &amp; head</h1><p><b>First para.<br><p>Second   one,\n with &quot;quotes&quot; and &eacute;.</p><p>The.</p>
<div class="share-links">Share it.</div><form>Your name.</form><section class="comments"><p>Great text, thanks.</p></section></article>
<footer>&copy; us &middot; all.</footer>"""


def test_article():
    assert H.extract(PAGE) == 'The & head\n\nFirst para.\n\nSecond one, with "quotes" and é.\n\nThe.'


def test_page_without_article_is_judged_by_tag_paths():
    text = "This is a sentence, and it goes on. It has marks; it is prose! "
    page = f"<body><div><table><tr><td><a href=/>Home</a></td><td><a href=/>News</a></td></tr></table></div><div><h2>Head</h2><p>{text * 3}</p><p>{text * 2}</p></div><div><span>12 | 13 | 14</span></div></body>"
    assert H.extract(page) == "\n\n".join(["Head", (text * 3).strip(), (text * 2).strip()])


def test_edges(spark):
    pages = [(1, "u", None, "t"), (2, None, "", "t"), (3, "u", "plain words, no tags.", "t"), (4, "u", "<p>open <b>cut &am", "t"), (5, "u", "<div" + "<p>x</p>" * 3, "t"), (None, "u", "<article>" + "<p>word, </p>" * 50_000, "t"), (3, "u", "plain words, no tags.", "t")]
    out = H.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string, text string")).collect()
    rows = {r.page_id: r for r in out}
    assert len(out) == 7 and rows[1].text == rows[2].text == ""
    assert rows[3].text == "plain words, no tags." and rows[4].text == "open cut &am"
    assert rows[None].text.count("word,") == 50_000 and all(r.n_chars == len(r.text) for r in out)
    assert H.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrapper_names_do_not_hide_the_page():
    assert H.extract('<body><div class="with sidebar"><article><p>Body, text.</p></article></div></body>') == "Body, text."


def test_deep_nesting():
    assert H.extract("<div>" * 3000 + "<p>Deep, text.</p>" + "</div>" * 3000) == "Deep, text."


PROSE = "This is a sentence, and it goes on. It has marks; it is prose! "


def test_pages_with_article_are_judged_by_tag_paths(monkeypatch):
    seen = []
    scores = H.path_scores
    monkeypatch.setattr(H, "path_scores", lambda found, texts: seen.append(scores(found, texts)) or seen[-1])
    assert "First para." in H.extract(PAGE)
    paths = H.blocks(PAGE)[1]
    assert len(seen) == 1 and any(paths.text(p).endswith("/article/p") for p in seen[0])


def test_teaser_article_does_not_hide_the_body():
    page = f"<body><article><p>Read this too.</p></article><div><div>{PROSE * 3}</div><div>{PROSE * 2}</div></div></body>"
    out = H.extract(page)
    assert (PROSE * 3).strip() in out and (PROSE * 2).strip() in out


def test_short_parts_of_the_article_stay():
    page = f"<body><div>By us</div><article><h1>Head</h1><p>{PROSE * 4}</p><div>Lead</div><p>{PROSE * 4}</p><h2>List</h2><ul><li>one</li><li>two</li></ul></article></body>"
    assert H.extract(page).endswith("List\n\none\n\ntwo") and "Lead" in H.extract(page)


def test_names_do_not_exclude_what_holds_most_text():
    for name in ("layout no-sidebar", "has-sidebar", "legal", "search-page"):
        page = f'<body><div class="{name}"><article><p>{PROSE * 3}</p><p>{PROSE}</p></article><div class="comments"><p>Nice, thanks.</p></div></div><p>Elsewhere, a note.</p></body>'
        out = H.extract(page)
        assert (PROSE * 3).strip() in out and "Nice" not in out


def test_lists_and_tables_beside_content_stay():
    page = f"<body><div><h1>{'Head ' * 8}</h1><p>{PROSE * 6}</p><h2>Steps to do</h2><ul><li>Take one.</li><li>two</li></ul><table><tr><td>cell</td></tr></table><ul><li><a href=/>More</a></li></ul></div><div><ul><li>far</li></ul></div></body>"
    assert H.extract(page).endswith("Steps to do\n\nTake one.\n\ntwo\n\ncell")


def test_quoted_values_are_no_attributes():
    page = f'<body><div title="see class=menu now"><p>{PROSE * 3}</p></div><p>{PROSE}</p></body>'
    assert H.extract(page) == f"{PROSE * 3}".strip() + "\n\n" + PROSE.strip()


def test_comments_in_other_languages_go():
    for name in ("kommentare", "commentaires", "comentarios"):
        page = f'<body><main><p>{PROSE * 3}</p><section id="{name}"><p>{PROSE}</p></section></main></body>'
        assert H.extract(page) == (PROSE * 3).strip()


def test_hostile_markup_takes_time_in_proportion():
    def seconds(n):
        pages = ["</p>" * n + "<div>" * n + "</p>" * n, "<div class=menu>" * n + "x", '<a title="' * n, "<li>" * n + "<td>" * n, "<!--" * n]
        began = time.perf_counter()
        for page in pages:
            H.extract(page)
        return time.perf_counter() - began

    seconds(500)
    assert seconds(40_000) < 16 * seconds(5_000) + 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_ratios_decide_every_page_of_the_tables(monkeypatch):
    seen = []
    scores = H.path_scores
    monkeypatch.setattr(H, "path_scores", lambda *a: seen.append(1) or scores(*a))
    pages = pq.read_table(f"{DATA}/pages.parquet").column("html").to_pylist()
    for page in pages:
        assert H.extract(page)
    assert len(seen) == len(pages)
