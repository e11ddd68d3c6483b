import pytest

from srcframe.llm.html_text import extract, main_text

LONG = "A paragraph of running text that is long enough to be the body of some article, with commas."


@pytest.mark.parametrize("page, text", [
    ("", ""), ("<p></p>", ""), ("plain < text", "plain < text"), ("<p>a&amp;b &#233;&nbsp;c", "a&b é c"),
    (f"<nav><a href=x>Home</a></nav><article><h1>T</h1><p>{LONG}</p><p>End.</p></article><footer>f</footer>", f"T\n\n{LONG}\n\nEnd."),
    (f"<main><h1>T</h1><article><header>By me</header><p>{LONG}<aside>no</aside></article></main>", f"T\n\nBy me\n\n{LONG}"),
    (f"<header>Site</header><div class='top-menu'>m</div><div><p>{LONG}</p><div class=ad>buy</div><p>z</p></div>", f"{LONG}\n\nz"),
    (f"<ul><li><a>one</a><li><a>two</a></ul><p>{LONG}<ul><li>in</ul><div id=comments><p>{LONG}</div>", f"one\n\ntwo\n\n{LONG}\n\nin"),
    (f"<script>if (a<b) '</p>'</script><style>p{{}}</style><!-- {LONG} --><p title='a>b'>{LONG}", LONG),
    (f"<article><p>{LONG}<br>more\n <b>bold</b></p><form>f<input></form><div hidden>h</div></article>", f"{LONG} more bold"),
    (f"<nav><a>never closed<article><p>{LONG}</article>", LONG),
    (f"<article><p>{LONG}</p><section class='comments'>{LONG}</section></article>", LONG),
])
def test_pages(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("page, text", [
    (f"<div class='content has-sidebar'><p>{LONG}</div>", LONG),
    (f"<article class='post no-comments'><p>{LONG}</article>", LONG),
    (f"<article><p>{LONG}</p><section id='discussion'><h2 id='side-effects'>Side</h2><p>a</p></section><h2 id='related-work'>R</h2></article>", f"{LONG}\n\nSide\n\na\n\nR"),
    (f"<body><form><p>{LONG}</p><p>{LONG}<select><option>x</select></form>", f"{LONG}\n\n{LONG}"),
    (f"<p>{LONG}</p><form>Name <input></form><div class='comments-list'>{LONG}</div>", LONG),
])
def test_text_is_not_taken_for_a_part(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("page, text", [
    (f"<article class='overflow-hidden'><p>{LONG}</article>", LONG),
    (f"<div class='post overflow-hidden'><p>{LONG}</div>", LONG),
    (f"<div class='flip-side text-search'><p>{LONG}</div>", LONG),
    (f"<article><p>{LONG}</p><h2 id='search'>A</h2><section id='cookies'><p>b</p></section><p id='related'>c</p></article>", f"{LONG}\n\nA\n\nb\n\nc"),
    (f"<p title='the hidden cost'>{LONG}</p>", LONG),
    ("<div>" + f"<p>{LONG}</p>" * 10 + f"</div><article><p>{LONG}</p></article>", "\n\n".join([LONG] * 11)),
    (f"<p>{LONG}</p><nav>x</nav><p>short tail</p>", f"{LONG}\n\nshort tail"),
    (f"<h1>Head</h1><aside>x</aside><p>{LONG}</p>", f"Head\n\n{LONG}"),
    (f"<p>{LONG}</p><nav>x</nav><div>Copyright</div>", LONG),
    (f"<article><p>{LONG}</p><ul><li><a>r1</a><li><a>r2</a><li><a>r3</a><li><a>r4</a></ul></article>", f"{LONG}\n\nr1\n\nr2\n\nr3\n\nr4"),
    (f"<p hidden>{LONG}</p><p style='color:red; display : none'>{LONG}</p><p aria-hidden=true>{LONG}</p><p>{LONG}", LONG),
    (f"<div class='site-footer'>{LONG}</div><div class=cookie-notice>{LONG}</div><div id=related-posts>{LONG}</div><p>{LONG}", LONG),
    (f"<body class='content-sidebar'><p>{LONG}", LONG),
    (f"<p>{LONG} a < b <c d='e", f"{LONG} a < b <c d='e"),
    (f"<p>{LONG} <i q='x>y</i> z", f"{LONG} y z"),
])
def test_what_is_text_and_what_is_not(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("unit", ["<p a='", "<a ", "<p a=\"'", "<!", "</", "<a '<b \"", "<p '>", "<a\t= ", "<x y='>' ", "<p class='a\"b "])
def test_time_grows_with_the_page(unit):
    import time

    for end in ("", ">", "'>", "\"", "'\">"):
        began = time.perf_counter()
        main_text(unit * (1_000_000 // len(unit)) + end)
        assert time.perf_counter() - began < 8  # seconds for 1 MB; a quadratic search takes minutes


def plain_text(page):
    """A plain extractor by the standard parser, for pages that name their article and mark their parts."""
    from html.parser import HTMLParser

    from srcframe.llm import html_text as H

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.stack, self.blocks, self.words = [], [], []

        def flush(self):
            text = " ".join("".join(self.words).split())
            self.blocks += [text] if text else []
            self.words = []

        def handle_starttag(self, name, attributes):
            if name in H.BLOCKS:
                self.flush()
            if name == "br":
                self.words.append(" ")
            inside = any(n == "article" for n, _ in self.stack)
            names = " ".join(v or "" for k, v in attributes if k in ("class", "id", "role")).lower().split()
            part = name in H.DROPPED or name in H.RAW or any(H.is_part(n) for n in names) or name == "header" and not inside
            if name not in H.VOID:
                self.stack.append((name, part))

        def handle_endtag(self, name):
            if name in H.BLOCKS:
                self.flush()
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == name:
                    del self.stack[i:]
                    break

        def handle_data(self, data):
            if any(n == "article" for n, _ in self.stack) and not any(part for _, part in self.stack):
                self.words.append(data)

    reader = Reader()
    reader.feed(page)
    reader.flush()
    return "\n\n".join(reader.blocks)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_the_given_pages_against_a_plain_extractor(spark, folder):
    pages = spark.read.parquet(f"/root/testdata/{folder}/pages.parquet").select("page_id", "url", "html").collect()
    named = [(p.html, main_text(p.html)) for p in pages if p.html and "<article" in p.html]
    assert len(named) > 40
    equal = sum(text == plain_text(page) for page, text in named)
    assert equal == len(named)


def test_odd_pages(spark):
    pages = spark.createDataFrame(
        [(1, "u", None, "t"), (2, None, "", "t"), (3, "u", "<p>" * 20_000 + "deep é", "t"), (3, "u", "x<" * 50_000, "t")],
        "page_id bigint, url string, html string, text string")
    rows = extract(pages).orderBy("page_id", "n_chars").collect()
    assert [(r.text, r.n_chars) for r in rows[:3]] == [("", 0), ("", 0), ("deep é", 6)]
    assert rows[3].text == "x<" * 50_000
    assert extract(pages.limit(0)).count() == 0
