from lobwright.llm.html_density import extract_main_text, main_text

ARTICLE = "<p>A first paragraph with <b>bold</b>ed words, long enough to count.</p><p>A second one &amp; more&nbsp;text, it goes on for a while.<p>Third\n\n one."
TEXT = "A first paragraph with bolded words, long enough to count. A second one & more text, it goes on for a while. Third one."
NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'


def page(body):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>{body}</body></html>'


def test_article_among_boilerplate():
    body = (f'{NAV}<div class="ad">Buy this now, a very long advert text that goes on and on and on.</div><article><h1>Head</h1>{ARTICLE}'
            '<aside>Aside.</aside><form><input><label>Mail</label></form></article><div id="comments"><p>A reader comment that is quite long as well.</p></div>'
            '<div class="cookie-notice">We use cookies.</div><footer>&copy; x</footer><!-- gone <p>x</p> -->')
    assert main_text(page(body)) == "Head " + TEXT


def test_density_without_an_article_element():
    links = "".join(f'<li><a href="/{k}">Link number {k}</a></li>' for k in range(30))
    body = f'<div><ul>{links}</ul></div><div><div><h2>Head</h2>{ARTICLE}</div></div><div><a href="/">top</a></div>'
    assert main_text(page(body)) == "Head " + TEXT


def test_article_in_sections():
    body = f"{NAV}<div><section><h2>One</h2>{ARTICLE}</section><section><h2>Two</h2>{ARTICLE}</section></div>"
    assert main_text(page(body)) == f"One {TEXT} Two {TEXT}"


def test_malformed_pages():
    assert main_text("<p><b>Open <br>text<p>next") == "Open text next"
    assert main_text("a < b and c > d &lt;p&gt;") == "a < b and c > d <p>"
    assert main_text('<p class="x>unclosed quote and <b>more</b> text') != None  # noqa: E711
    assert main_text("<!-- open comment <p>x</p>") == "" and main_text("<script>var x") == "" and main_text("</p></div>") == ""
    assert main_text("<p>" * 3000 + "deep" + "<div>" * 3000) == "deep"
    assert main_text('<p title="a>b">kept</p>' + '<a "' * 2000) .startswith("kept")


def test_rows(spark):
    rows = [(1, "u", page(f"<article>{ARTICLE}</article>")), (1, "u", page(f"<article>{ARTICLE}</article>")), (2, None, None), (None, "v", ""), (3, "w", page("<article><p>" + "long word " * 50_000 + "</article>"))]
    pages = spark.createDataFrame([(*r, "x", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted((tuple(r) for r in extract_main_text(pages).collect()), key=str)
    want = [(i, u, main_text(h), len(main_text(h))) for i, u, h in rows]
    assert got == sorted(want, key=str) and want[0][2] == TEXT and want[4][3] == 499_999
    assert extract_main_text(pages.limit(0)).count() == 0
