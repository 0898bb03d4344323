import pytest

from lobwright.llm.html_density import main_text
from test_html import ARTICLE, NAV, TEXT, page

LONG = "A sentence of the article that is long enough to fill this paragraph. " * 4


@pytest.mark.parametrize("wrapper", ['class="content-sidebar-wrap"', 'class="layout has-sidebar"', 'class="entry-content no-comments"', 'id="page" class="sidebar"', 'id=header'])
@pytest.mark.parametrize("name", ["article", "main", "div"])
def test_wrapper_stays(wrapper, name):
    assert main_text(page(f'{NAV}<div {wrapper}><{name}><h1>Head</h1>{ARTICLE}</{name}></div><div class="ad">Buy this.</div>')) == "Head " + TEXT


@pytest.mark.parametrize("word", ["side-effects", "related-work", "search-engines", "header-files", "search", "comments"])
def test_ids_of_headings_and_sections(word):
    assert main_text(page(f'<article><h2 id="{word}">Head</h2><section id="{word}">{ARTICLE}</section></article>')) == "Head " + TEXT


@pytest.mark.parametrize("given", ['data-id="ads"', 'title="the hidden valley"', "data-class='comments'", 'title="display:none"', 'data-x="aria-hidden=true"'])
def test_attribute_names(given):
    assert main_text(page(f"<article><div {given}>{ARTICLE}</div></article>")) == TEXT


@pytest.mark.parametrize("given", ["hidden", 'hidden=""', 'aria-hidden="true"', 'style="color:red;display: none"', 'class="x comments-area"', 'class="ad-container"', "id=comments", 'role="search"', 'class="related-posts"', 'id="ad-slot-3"'])
def test_blocks_still_left_out(given):
    assert main_text(page(f"<article>{ARTICLE}</article><div {given}><p>{LONG}</p></div>")) == TEXT
    assert main_text(page(f"<article>{ARTICLE}<div {given}><p>Not this.</p></div></article>")) == TEXT


def test_unequal_sections():
    first = "<h2>One</h2>" + f"<p>{LONG}</p>" * 6
    text = " ".join(["One", *[LONG.strip()] * 6, "Two", LONG.strip()])
    assert main_text(page(f"{NAV}<div><section>{first}</section><section><h2>Two</h2><p>{LONG}</p></section></div>")) == text


def test_heading_beside_the_block():
    links = "".join(f'<li><a href="/{k}">Link number {k} of a long list</a></li>' for k in range(30))
    for title in ("<h1>Title</h1>", '<h1><a href="/">Title</a></h1>'):
        assert main_text(page(f"<div>{title}<div>{ARTICLE}</div></div>")) == "Title " + TEXT
        assert main_text(page(f"<div>{title}<ul>{links}</ul><div>{ARTICLE}</div></div>")) == "Title " + TEXT


def test_forms_around_the_article():
    """Server-side frameworks wrap whole pages in a form; a form, button, menu or dialog beside the article stays out."""
    prose = "".join(f"<p>Paragraph {i} of the article with enough words to count as text.</p>" for i in range(5))
    text = " ".join(f"Paragraph {i} of the article with enough words to count as text." for i in range(5))
    for page in (f'<form id="aspnetForm"><div>{prose}</div></form>', f"<form><article>{prose}</article><button>Send</button></form>",
                 f"<dialog><div>{prose}</div></dialog>", f"<div>{prose}</div><form><label>Your name</label><input></form>",
                 f'<form><div>{prose}</div><select><option>One</option></select><textarea>Say</textarea></form>'):
        assert main_text(page) == text, page


def test_long_pages_of_nested_and_unclosed_tags():
    """A tag costs the same however deep it stands."""
    import time

    n = 60_000
    pages = ["<i>" * n + "<p>x" * n, "<b>" * n + "</x>" * n + "<p>y", "<div>" * n + "z" + "</div>" * n, "<ul>" + "<li>a<p>b" * n, "<b><p>" * n + "q", "</p>" * n + "r"]
    for page in pages:
        began = time.process_time()
        assert main_text(page)
        assert time.process_time() - began < 20, page[:20]
