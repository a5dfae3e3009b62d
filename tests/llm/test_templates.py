import pytest

from tidebars.llm import templates


@pytest.mark.parametrize(("page", "text"), [
    ("", ""), ("<p>x", "x"), ("plain  text", "plain text"), ("<div", "<div"), ("<!-- x", ""), ("<script>if(a<b)</script><p>ok", "ok"),
    ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"), ("<p>a&amp;b &eacute; &#233;</p><p></p><p>c</p>", "a&b é é\nc"),
    ("<body><div class='sidebar'>no</div><div id=main><h2>T</h2><p>a<p>d   e\n f</div><section class='comments'><p>bad</p></section>", "T\na\nd e f"),
    ("<article><header><h1>H</h1></header><p>t<form>f</form><div class=\"ad\">x</div>u</article><footer>z</footer>", "H\nt\nu"),
    ("<nav>n</nav><main><p>one<br>two <b>bold</b></main><div class='cookie-notice'>c</div>", "one\ntwo bold"),
    ("<p title='a>b'>x</p>", "x"), ("<style>p{}</style><noscript>n</noscript><title>t</title><p>x</p>", "x"),
])
def test_single_pages(page, text):
    assert templates.main_text(page, None) == text


@pytest.mark.parametrize("page", [
    "<body class='has-sidebar'><p>the text<div class='site-footer'>f</div>", "<body class='with-nav sidebar'><p>the text</body>",
    "<body><article class='post no-comments'><p>the text</article><div class='cookie-notice'>c</div>",
    "<body><div class='content-header'><p>the text</div><div class='sidebar-left'>s</div>", "<div class='widget'><p>the text</div><p class=x></p><div class=ad>ad</div>",
])
def test_names_that_only_mention_something_unwanted(page):
    assert templates.main_text(page, None) == "the text"


def test_template_of_a_host(spark):
    """Without telling names, the element that holds most slot text on the host is found, also where a page has more text elsewhere."""
    def page(i, body, side="short"):
        return (i, f"http://h.example/{i}", f"<html><body><div class=x1>{side}</div><div class=x2>{'<p>'.join(body)}</div><div class=x3>foot</div></body></html>")

    rows = [page(i, [f"para {i} " * 30, "more " * i]) for i in range(1, 9)] + [page(20, ["tiny"], "long side " * 50)]
    rows += [(30, None, None), (31, "http://other/1", "<p>alone"), (32, "bad url", "")]
    got = {r.page_id: (r.text, r.n_chars) for r in templates.report(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got[20] == ("tiny", 4) and got[3][0] == ("para 3 " * 30).strip() + "\nmore more more"
    assert got[30] == ("", 0) and got[31] == ("alone", 5) and got[32] == ("", 0)


def test_repeated_texts_are_template(spark):
    """A text repeated on the pages of a layout is no main text; ids of pages don't split the template, other layouts have their own."""
    def page(i):
        return (i, f"http://h/{i}", f"<body class='post-{i} x'><div id=top{1000 + i}><p>Read our notice</div><div class='c e-{i}'><p>word {i} here<p>Read our notice"
                                    f"<p>more of {i}</div><div class=z>tail {'long ' * 40}</div></body>")

    def listing(i):
        return (i, f"http://h/{i}", f"<body><section><p>entry {i} {'text ' * 30}<p>All entries are checked</section><div class=q><p>side {i}</div></body>")

    rows = [page(i) for i in range(1, 7)] + [listing(i) for i in range(20, 24)] + [page(1)] * 2
    rows += [(40 + i, "http://copies/", "<div><p>the same page</div>") for i in range(5)]
    got = {r.page_id: r.text for r in templates.report(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(got[i] == f"word {i} here\nmore of {i}" for i in range(1, 7))
    assert all(got[i] == f"entry {i} {'text ' * 30}".strip() for i in range(20, 24))
    assert all(got[40 + i] == "the same page" for i in range(5))


def test_order_and_general_paths():
    def token(n, low, high):
        return {"token": n, "mean": (low + high) / 2, "low": low, "high": high}
    assert [t["token"] for t in templates.in_order([token(1, 1, 3), token(2, 2, 9), token(3, 1, 12), token(4, 5, 20)])] == [1, 2, 4]
    assert templates.general(("body.a.post-7", "div.c.e-12", "div.x1", "p")) == ("body", "div.c", "div.x1", "p")


def test_odd_and_empty_tables(spark):
    schema = "page_id long, url string, html string, host string, chosen string, text string"
    rows = [(1, None, "<p>x", "h", "c", "t"), (1, None, "<p>x", "h", "c", "t"), (None, None, None, None, None, None), (2, "http://a/", "<div>" * 200 + "deep", "h", "c", "t")]
    got = templates.report(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.page_id), r.text) for r in got) == [("1", "x"), ("1", "x"), ("2", "deep"), ("None", "")]
    assert templates.report(spark.createDataFrame([], schema)).count() == 0


def test_long_broken_pages_take_linear_time():
    import time

    for page in ("<script " * 125_000, '<script "' * 110_000, "<div>" * 200_000 + "text" + "</div>" * 200_000, "<!-- " * 200_000, '<a "' * 250_000 + ">",
                 "<script>" * 125_000, "<" * 1_000_000):
        started = time.time()
        list(templates.blocks(page))
        assert time.time() - started < 8


def test_what_is_open_at_the_end():
    text = [t for _, t in templates.blocks("<p>one</p> two <script>x = 1; if (a > b) {") if t]
    assert text == ["one", "two"]
    assert [t for _, t in templates.blocks("<p>one</p><!-- gone > and this") if t] == ["one"]
    assert [t for _, t in templates.blocks("<p>one</p> a < b <!-- gone") if t] == ["one", "a < b"]
    deep = "<div>" * 600 + "<p>in</p>" + "</div>" * 600 + "<p>out</p>"
    assert [(len(p), t) for p, t in templates.blocks(deep) if t] == [(513, "in"), (1, "out")]
