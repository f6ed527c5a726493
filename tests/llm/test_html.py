"""Main text of pages in layouts of different make, broken pages, and the table operator on odd rows."""

import time

import pytest

from careledger.llm import html

A = "The river rose in the night, and by morning, as the older people had said, the lower fields were under water."
B = "Nobody was hurt; the cattle, though, had to be led up the hill, one by one, before the bridge went."
C = "It took two weeks, some patience, and a good deal of digging until the road could be used again."
STORY = f"{A}\n{B}\n{C}"
P = f"<p>{A}</p><p>{B}</p><p>{C}</p>"
MENU = "<ul class=menu><li><a href=/>Home</a></li><li><a href=/a>About</a></li><li><a href=/n>News</a></li></ul>"

LAYOUTS = {
    "article with nav and footer": (f"<nav>{MENU}</nav><article><h1>Flood</h1>{P}</article><footer>All rights reserved.</footer>", f"Flood\n{STORY}"),
    "divs only": (f"<div id=nav>{MENU}</div><div id=content><h2>Flood</h2>{P}</div><div id=footer>Made with care.</div>", f"Flood\n{STORY}"),
    "tables": (f"<table><tr><td width=120>{MENU}</td><td><h1>Flood</h1>{P}</td></tr></table>", f"Flood\n{STORY}"),
    "comments after the story": (f"<main><h1>Flood</h1>{P}<div class=comments><h3>3 comments</h3><p>I was there, and it was cold, wet and loud.</p></div></main>", f"Flood\n{STORY}"),
    "comments as nested articles": (f"<article>{P}<article class=comment><p>I was there, and it was cold.</p></article><article class=comment><p>So was I, sadly.</p></article></article>", STORY),
    "comments longer than the story": (f"<article><p>{A}</p><section id=comments>{P}{P}</section></article>", A),
    "sidebar beside": (f"<div class=wrap><div class=sidebar><h4>Popular</h4><p>Ten things to know, they say.</p>{MENU}</div><div class=post>{P}</div></div>", STORY),
    "advert between paragraphs": (f"<article><p>{A}</p><div class='ad-slot'>Buy now, pay later, be glad.</div><p>{B}</p><p>{C}</p></article>", STORY),
    "cookie notice": (f"<div id=cookie-banner><p>We use cookies, as all do. Accept?</p><button>Yes</button></div><div class=text>{P}</div>", STORY),
    "forms and scripts": (f"<div>{P}<form><p>Your mail address, please.</p><input></form><script>var x = '<p>no</p>';</script><style>p {{}}</style></div>", STORY),
    "quote and list": (f"<article><p>{A}</p><blockquote><p>{B}</p></blockquote><ul><li>Ropes</li><li>Boots</li></ul><p>{C}</p></article>", f"{A}\n{B}\nRopes\nBoots\n{C}"),
    "unclosed paragraphs": (f"<body><h1>Flood<p>{A}<p>{B}<p>{C}", None),
    "line breaks": (f"<article><p>{A}<br>{B}</p><p>{C}</p></article>", f"{A} {B}\n{C}"),
    "references": ("<article><p>" + A.replace("and", "&amp;").replace(",", "&#44;") + f"</p><p>{B}</p><p>{C}</p></article>", STORY.replace("and by", "& by")),
    "links in prose": (f"<article><p>{A} See <a href=/x>the map</a>, too.</p><p>{B}</p><p>{C}</p><p class=tags><a href=/t>flood</a> <a href=/u>river</a></p></article>", f"{A} See the map, too.\n{B}\n{C}"),
    "header of the article": (f"<header><p>The Daily</p></header><article><header class=entry-header><h1>Flood</h1></header>{P}</article>", f"Flood\n{STORY}"),
}


@pytest.mark.parametrize("name", list(LAYOUTS))
def test_layouts(name):
    page, text = LAYOUTS[name]
    found = html.main_text(f"<!doctype html><html><head><title>Flood</title></head><body>{page}</body></html>")
    assert found == text if text else all(x in found for x in (A, B, C))


@pytest.mark.parametrize(
    "page",
    ["<div>" * 20_000, "<div class='sidebar ad'>" * 20_000, "<b" * 500_000, "<p>" + "<b" * 500, "<a href='" * 3200, "<title>" * 20_000, "<b>" * 10_000 + "<p>x</p>" * 10_000, "<li><ul>" + "<h1>" * 10_000 + "<li>y</li>" * 10_000, "<a x='\">" * 10_000 + "<a x=\"'>" * 10_000, "<!--" * 100_000, "< " * 100_000, "<div class=header><h1>x</h1>" * 10_000],
    ids=range(12),
)
def test_broken_pages_take_linear_time(page):
    began = time.process_time()
    html.main_text(page)
    assert time.process_time() - began < 1.5


def test_ratios_decide_inside_an_article():
    assert html.main_text(f"<article>{P}<div class=x>Share</div><div class=x>Print</div></article>") == STORY


def test_table_of_pages(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", f"<p>{A}</p>", "x", 1), (1, "u", f"<p>{A}</p>", "x", 1), (2, None, None, None, None), (None, "v", "", "y", 2), (3, "w", f"<div>{f'<p>{A}</p>' * 20_000}</div>", "", 0)]
    found = html.extract_main_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.page_id), r.url or "", r.n_chars) for r in found) == [("1", "u", len(A)), ("1", "u", len(A)), ("2", "", 0), ("3", "w", 20_000 * (len(A) + 1) - 1), ("None", "v", 0)]
    assert html.extract_main_text(spark.createDataFrame([], schema)).count() == 0
