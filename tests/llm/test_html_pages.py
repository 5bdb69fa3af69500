"""Pages whose markup has cost text or time."""

import time

import pytest

from quire.llm import html

ARTICLE = "<article><h1>Head</h1>%s<p>Text of the article goes on.</p></article>"
WHOLE = "Head\nText of the article goes on."


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (ARTICLE % "<svg-icon></svg-icon>", WHOLE),
        (ARTICLE % '<svg class="i"/>', WHOLE),
        (ARTICLE % "<svg><title>no</title><path/></svg>", WHOLE),
        (ARTICLE % "<select><option>no</select>", WHOLE),
        (ARTICLE % "<TEMPLATE>no</Template >", WHOLE),
        (ARTICLE % "<iframe src=x>", WHOLE),
        (ARTICLE % "<script>no</scripty></script>", WHOLE),
        (ARTICLE % "<title-bar>", WHOLE),
        ("<title-bar></title-bar>" + ARTICLE % "", WHOLE),
        ('<body><form runat="server">' + ARTICLE % "" + "</form></body>", WHOLE),
        ('<body><form id="f"><div><h1>Head</h1><p>Text of the article goes on.</p></div><input></form></body>', WHOLE),
        (ARTICLE % "<form>Your name <input><button>Send</button></form>", WHOLE),
        ("<body><form>Find <input></form><h1>Head</h1><p>Text of the article goes on.</p></body>", WHOLE),
        (ARTICLE % "<p>Press <button>OK</button> to go on</p><div><button>Share</button></div>", "Head\nPress OK to go on\nText of the article goes on."),
        (ARTICLE % "<script>", "Head"),
        (ARTICLE % "<!-- no", "Head"),
    ],
)
def test_no_text_is_lost_to_markup(spark, source, want):
    page = html.Page(source)
    assert page.text([]) == want


@pytest.mark.parametrize(
    "source",
    [
        "<b>" * 100_000 + "text" + "</i>" * 100_000,
        "<b>x</i>" * 100_000,
        '<div class="a1">' * 100_000 + "text",
        '<div class="share">' * 100_000 + "text",
        "<select>" * 100_000 + "text</svg>",
        "<p>x" + "<b>" * 50_000 + "<div>y</div>" * 50_000,
    ],
)
def test_pages_of_any_depth_take_linear_time(source):
    began = time.perf_counter()
    page = html.Page(source)
    assert page.text([]) and time.perf_counter() - began < 20
    assert max(len(c.path) for c in page.containers) < 2 * html.MOST_PATH
