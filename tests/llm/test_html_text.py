"""Main text of pages: block rules, references, broken markup, edge cases."""

import time

from gradeloom.llm.html_text import extract_main_text, main_text

PROSE = "The river runs past the mill and it is the oldest part of the town that we have seen."
MORE = "In the morning the boats are on the water and there is a market by the bridge for all."

PAGE = f"""<!DOCTYPE html><html><head><title>Mill</title><style>p{{margin:0}}</style></head><body>
<header class="top"><a href="/">Start</a> Our site</header>
<div id="cookieNotice">{PROSE}</div>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<main><header><h1>The   mill &amp;
 the river</h1></header>
<p>{PROSE}<p>Short.<ul><li>First<li>Second</ul><p>{MORE} &lt;b&gt;</p><p>End.</p>
<div class="ad">{PROSE}</div></main>
<aside>{MORE}</aside><section class="comments"><p>{PROSE}</p></section>
<form><p>{MORE}</p></form><footer>&copy; {PROSE}</footer>
<script>if (a < b) document.write("<p>no</p>")</script><!-- {PROSE} --></body></html>"""


def test_article_without_its_margins():
    assert main_text(PAGE).split("\n") == [
        "The mill & the river", PROSE, "Short.", "First", "Second", f"{MORE} <b>", "End.",
    ]


def test_ambiguous_blocks_inherit_from_their_neighbours():
    inside = f"<div><p>{PROSE}</p><p>Near prose.</p></div>"
    links = "<div><p><a href='#'>Many links in a row here</a></p><p>Near links.</p></div>"
    assert main_text(inside + links) == f"{PROSE}\nNear prose."
    assert main_text("<div><h2>Head</h2><p>" + PROSE + "</p></div>") == f"Head\n{PROSE}"


def test_small_and_broken_pages():
    assert main_text(None) == "" and main_text("") == "" and main_text(" \n ") == ""
    assert main_text("plain &eacute; text") == "plain é text"
    assert main_text("<p>a<b>b</b>c&nbsp;d<br>e") == "abc d e"
    assert main_text("<article><p>x<div>y</article>z") == "x\ny\nz"
    assert main_text("<p title='a > b'>kept</p><!-- open") == "kept"
    assert main_text("<p>one<script>var x = '<p>';") == "one"


def test_long_broken_pages_take_linear_time():
    began = time.time()
    for page in ("<p>" * 50_000, "<" * 100_000, '<a "' * 20_000, "<b>" * 20_000 + "<p>x" * 2_000,
                 "<div>" * 3_000 + "x</span>" * 3_000, "<!" * 50_000):
        main_text(page)
    assert time.time() - began < 30


def test_rows_of_pages(spark):
    data = [(1, "u", PAGE, "a"), (1, "u", PAGE, "b"), (None, None, None, "c"), (2, "v", "", None)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, extract_main_text(pages).collect()), key=repr)
    text = main_text(PAGE)
    assert got == sorted(
        [(1, "u", text, len(text))] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=repr
    )
    assert extract_main_text(pages.limit(0)).count() == 0


def test_pages_in_other_languages_without_article():
    frame = "<nav><a href='/'>A</a></nav><div><h1>{}</h1><p>{}</p><p>{}</p></div><footer>F 2024</footer>"
    for head, one, two in (
        ("Река", "Река течёт мимо мельницы, и это самая старая часть города, которую мы видели.",
         "Утром лодки стоят на воде, а возле моста открывается рынок для всех жителей города."),
        ("Rzeka", "Rzeka płynie obok młyna, który jest najstarszą częścią miasta, jaką widzieliśmy dotąd.",
         "Rano łodzie stoją przy brzegu, obok mostu otwiera swoje stragany targ dla mieszkańców."),
        ("河流", "这条河流经过古老的磨坊，那里是我们见过的这座城市最古老的地方。", "早晨船只停在水面上，桥边有一个向所有居民开放的市场。"),
    ):
        assert main_text(frame.format(head, one, two)) == f"{head}\n{one}\n{two}"


def test_boilerplate_alone_does_not_decide_long_blocks():
    table = "Mill 1843, bridge 1851, market hall 1872, station 1890, harbour 1903, museum 1954"
    page = f"<div><p>{PROSE}</p></div><nav>N</nav><div><p>{table}</p></div><footer>F</footer>"
    assert main_text(page) == f"{PROSE}\n{table}"


def test_a_class_word_does_not_mark_the_whole_page():
    article = f"<article><p>{PROSE}</p><div class='comments'><p>{MORE}</p></div></article>"
    assert main_text(f"<div class='page has-sidebar'>{article}<div class='sidebar'>{MORE}</div></div>") == PROSE
    assert main_text(f"<div class='comments-open'><p>{PROSE}</p><p>{MORE}</p></div><p>x</p>") == f"{PROSE}\n{MORE}\nx"
    assert main_text(f"<div style='display:none'>{article}</div><p>{MORE}</p>") == MORE
    comments = f"<section class='comments'><article class='comment'>{MORE}</article></section>"
    assert main_text(f"<div><p>{PROSE} {PROSE}</p></div>{comments}") == f"{PROSE} {PROSE}"


LINE = "This is the text of the article and it is long enough for the rules to see that it is prose."


def in_article(part):
    return main_text(
        f"<body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{LINE}</p>{part}<p>{LINE}</p></article></body>"
    ).split("\n")[2:-1]


def test_short_text_and_titles_inside_an_article_stay():
    advert = '<div class="ad">Buy now</div>'
    assert in_article(f"{advert}<p>Short line.</p>{advert}") == ["Short line."]
    for head in ('header class="entry-header"', 'div class="article-header"', 'section class="legal-analysis"'):
        assert in_article(f"<{head}><h2>Inner</h2></{head.split()[0]}>") == ["Inner"]
    assert in_article("<p>So <math><mi>x</mi> = 2</math> holds</p>") == ["So x = 2 holds"]


def test_margins_inside_an_article_go():
    for name in ("ad", "related-posts", "comments", "share-buttons", "legal-notice", "notice", "header", "cookieBanner"):
        assert in_article(f'<div class="{name}"><p>Other</p></div>') == []


def test_time_in_proportion_to_the_length_of_a_tag():
    for inside in ("a" * 1_000_000, "a " * 500_000, "a =" * 300_000, 'class="' + "ad " * 300_000):
        begun = time.perf_counter()
        main_text(f"<div {inside}>x</div>")
        assert time.perf_counter() - begun < 2
