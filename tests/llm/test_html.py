import time

import pytest

from ticketveil.llm import html as H

ARTICLE = "<article><h1>A title</h1><p><b>First <i>para</i>&amp;graph&nbsp;here.<br><p>Second\n  one with <a href='x'>a link</a>.</p><p>End.</p></article>"
MAIN = "A title\n\nFirst para&graph here.\n\nSecond one with a link.\n\nEnd."


def text(html):
    return H.main_text(html, H.tree())


def test_article_without_the_rest():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>"
        "<header>Site name and slogan of it</header><nav><ul><li><a href='/a'>Home</a></li><li><a>News</a></li></ul></nav>"
        "<!-- ad > 1 --><div class='ad'>Buy this long and wordy thing now, it is really worth its money for all of you.</div>"
        "<div id=cookie-notice>We use cookies to make this site better for you and all.</div>" + ARTICLE +
        "<section class='comments'><p>A reader says a lot of words here about the article and more.</p></section>"
        "<aside>Also read these other long articles of ours about things</aside><form><label>Mail</label><input><button>Go</button></form>"
        "<footer>&copy; x &middot; All of it</footer>"
    )
    assert text(page) == MAIN


def test_inside_the_article():
    inner = ARTICLE.replace("<p>Second", "<div class='advert big'>Buy now</div><script>if (a<b) x('</div>')</script><p>Second")
    assert text(inner) == MAIN
    assert text(ARTICLE.replace("</article>", "<p hidden>secret</p></article>")) == MAIN


def test_headers_and_captions_of_the_article_stay():
    page = "<div class='site-header'>Some site</div><article><div class='entry-header'><h1>A title</h1></div><figure><img src=x><figcaption>What it shows</figcaption></figure><p>Text.</p><ol class=commentlist><li>Nice!</li></ol></article>"
    assert text(page) == "A title\n\nWhat it shows\n\nText."


def test_open_head():
    for head in ("<head><title>T</title><meta charset=utf-8><link rel=x>", "<title>T</title>", "<head><style>p{}</style>"):
        assert text(f"<html>{head}<body>{ARTICLE}") == text(f"<html>{head}{ARTICLE}") == MAIN


def test_page_without_an_article():
    words = "many words of plain prose that go on and on for quite a while so that it is clear what this is "
    page = f"<div><a>Home</a> <a>About</a></div><div>{words * 2}</div><div>{words * 3}</div><div><a>Imprint</a></div>"
    assert text(page) == f"{(words * 2).strip()}\n\n{(words * 3).strip()}"


def test_odd_markup():
    assert text("") == ""
    assert text("<p>") == text("<!-- open") == text("<script>x") == text("< <> </ >" * 0) == ""
    assert "5 < 6" in text("<main><p>5 < 6 and 7 &lt; 8 &#x41;&#66;</p></main>")
    assert text("<main><p title='a > b' class=\"x\">yes</p></main>") == "yes"
    assert text("<article>" + "<p>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert len(text("<article><p>" + "word " * 100_000 + "</p></article>")) == 499_999


def test_tables(spark):
    rows = [(1, "u", ARTICLE, "x"), (2, None, None, None), (3, "", "", "y"), (1, "u", ARTICLE, "x"), (None, "v", "<p>" * 3, "z")]
    out = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, h string"))
    assert out.columns == ["page_id", "url", "h", "text"]
    assert sorted(r.text for r in out.collect()) == ["", "", "", MAIN, MAIN]
    assert H.extract(out.limit(0).withColumnRenamed("text", "html")).count() == 0


def test_tree_knows_its_table():
    rows = H.labelled_rows()
    wrong = [row for row in rows if H._judge(H.tree(), row[:-1]) != bool(row[-1])]
    assert len(wrong) < len(rows) * 0.05 and not [row for row in wrong if row[-2]]


PROSE = "Many words of plain prose that go on and on for quite a while so that it is clear what this is about. "


def test_article_tags_around_other_things_only():
    body = f"<div><h2>A title</h2><p>{PROSE * 2}</p><p>{PROSE * 3}</p></div>"
    teasers = "<aside><article><h3><a href=x>Read this</a></h3><p>And more of it here.</p></article></aside>"
    replies = "<div class='comments'><article class=comment><p>I read it and liked it.</p></article></div>"
    for rest in (teasers, replies, teasers + replies):
        kept = text(f"<body>{body}{rest}</body>")
        assert (PROSE * 2).strip() in kept and (PROSE * 3).strip() in kept and "Read this" not in kept and "liked" not in kept


def test_names_of_layout():
    rest = "<div class='sidebar'><p>Buy this now.</p></div><section class='comments'><p>Nice one!</p></section>"
    for name in ("class='site-content has-sidebar'", "id='page' class='sticky-header'", "class=no-comments", "class='left-sidebar grid'"):
        assert text(f"<body><div {name}>{ARTICLE}{rest}</div></body>") == MAIN
        plain = text(f"<body><div {name}><div><p>{PROSE * 2}</p><p>{PROSE * 3}</p></div>{rest}</div></body>")
        assert plain == f"{(PROSE * 2).strip()}\n\n{(PROSE * 3).strip()}"


def test_layout_names_of_small_parts():
    parts = "<div class='sticky-header'><p>Our site has this slogan</p></div><div class='left-sidebar'><p>Links and things to see</p></div>"
    assert text(f"<body><div class='has-sidebar'>{parts}{ARTICLE}</div></body>") == MAIN


def test_article_within_a_named_part():
    assert text(f"<body><div class='banner page'>{ARTICLE}<p>An advert.</p></div></body>") == MAIN
    assert text(f"<body><div class='banner'>{ARTICLE}</div><section class='comments'><p>{PROSE * 9}</p></section></body>") == MAIN
    assert text(f"<body><article><p>{PROSE * 3}</p></article><div class='promo'>{ARTICLE}</div></body>") == (PROSE * 3).strip()
    assert text(f"<body><div class='comments'>{ARTICLE}</div></body>") == ""
    assert text("<div class='has-sidebar'>" * 5000 + ARTICLE) == MAIN


@pytest.mark.parametrize(
    "page",
    ["<script" * 150_000, "<p x=\"" * 180_000, "</div>" * 180_000, "<div>" * 90_000 + "</p>" * 180_000, "<!" * 500_000, "<title " * 150_000, "<a href='" * 120_000],
    ids=["raw", "quotes", "ends", "deep ends", "declarations", "titles", "single quotes"],
)
def test_broken_markup_takes_linear_time(page):
    start = time.process_time()
    H.blocks(page)
    H.blocks(f"<p>x</p>{page}>")
    assert time.process_time() - start < 4  # two pages of a megabyte


def test_parts_that_are_left_open():
    assert text(f"{ARTICLE}<!-- never closed <p>{PROSE}</p> and more") == MAIN
    assert text(f"{ARTICLE}<script>var a = '<p>{PROSE}</p>' and more") == MAIN
    assert text(f"{ARTICLE}<!-- closed --> <!-- open") == MAIN
    assert [b.text for b in H.blocks("a <p>b</p> c < d <!-- e")] == ["a", "b", "c < d"]
    assert [b.text for b in H.blocks("a <div b")] == ["a <div b"]


LINKS = "<ul><li><a href=a>One</a></li><li><a href=b>Two of them</a></li><li><a href=c>Three</a></li></ul>"


def labelled(pages):
    """(row of features, in the article by the page's own marks) of each block."""
    for page in pages:
        found = H.blocks(page)
        yield from ((row, b.main and not b.other) for b, row in zip(found, H.features(found)))


def test_sizes_and_densities_split_first():
    assert H.FEATURES[H.tree()[0]] == "density"
    assert all(H._judge(H.tree(), (40, 0.1, 60, 0.0, 3, 0.0, tag)) == H._judge(H.tree(tags=False), (40, 0.1, 60, 0.0, 3, 0.0, 0)) for tag in (0, 1))


def test_sizes_alone_on_the_given_pages(spark, data_dir):
    pages = [r.html or "" for r in spark.read.parquet(f"{data_dir}/pages.parquet").select("html").collect()]
    sizes, whole = H.tree(tags=False), H.tree()
    free = [len({H._judge(whole, (*row[:-1], tag)) for tag in (-1, 0, 1)}) == 1 for row, _ in labelled(pages)]
    assert sum(free) > 0.25 * len(free)  # whatever the tags say
    judged = [(H._judge(sizes, (*row[:-1], 0)), H._judge(whole, row), main) for row, main in labelled(pages)]
    right = sum(a and m for a, _, m in judged)
    assert right / sum(a for a, _, _ in judged) > 0.92 and right / sum(m for _, _, m in judged) > 0.96
    assert all(b == m for _, b, m in judged)


HAND = [  # blocks with their labels, of pages that mark nothing
    ([("<div>%s</div>" % LINKS, 0), (f"<h1>A title of it</h1>{''}", 1), (f"<p>{PROSE * 2}</p>", 1), (f"<p>{PROSE}</p>", 1), ("<p>So it was.</p>", 1), (f"<p>{PROSE * 3}</p>", 1), ("<div>(c) a site, all rights</div>", 0)]),
    ([("<div><a>Home</a></div>", 0), ("<div>Our slogan is here</div>", 0), (f"<div>{PROSE * 4}</div>", 1), (f"<div>{PROSE * 2}</div>", 1), ("<div><a>Next</a> <a>Back</a></div>", 0)]),
    ([("<div><a>Home</a> | <a>About us</a></div>", 0), (f"<td>{PROSE * 2}</td>", 1), ("<td>See <a>the other</a> one for more of this and that, please do.</td>", 1), (f"<td>{PROSE * 2}</td>", 1), ("<td><a>Imprint</a></td>", 0)]),
]


def test_hand_labelled_pages_without_marks():
    got = want = both = 0
    for page in HAND:
        found = H.blocks("".join(html for html, _ in page))
        labels = [y for html, y in page for _ in H.blocks(html)]
        judged = [H._judge(H.tree(), row) for row in H.features(found)]
        got, want, both = got + sum(judged), want + sum(labels), both + sum(a and b for a, b in zip(judged, labels))
    assert both / got >= 0.9 and both / want >= 0.9


def test_sizes_overrule_the_article_tag():
    body = ARTICLE.replace("</article>", f"{LINKS}</article>")
    assert "Two of them" not in text(body) and text(body).startswith("A title")
    assert text(f"{ARTICLE}<div>{PROSE}</div>".replace("End.", PROSE * 2)).endswith((PROSE * 2).strip())  # prose after it goes
    linked = ARTICLE.replace("<h1>A title</h1>", "<h1><a href=x>A title</a></h1>")
    assert text(f"<nav>{LINKS}</nav>{linked}") == text(f"<nav><a>Home</a></nav>{linked}") == MAIN  # but not a title that is a link
    teaser = "<article><p>Read more of it here.</p></article>"
    assert text(f"{teaser}<div><p>{PROSE * 3}</p><p>{PROSE * 4}</p></div>").endswith((PROSE * 4).strip())


def test_features_by_brute_force():
    for page in (f"<nav>{LINKS}</nav>{ARTICLE}<footer>x</footer>", f"<p>{PROSE}</p>{LINKS}", ""):
        found = H.blocks(page)
        for i, row in enumerate(H.features(found)):
            near = [found[j] if 0 <= j < len(found) else None for j in (i, i - 1, i + 1)]
            assert row[:6] == tuple(x for b in near for x in ((len(b.text.split()), b.linked / b.words) if b else (0, 0.0)))
