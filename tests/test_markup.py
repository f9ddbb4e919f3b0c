"""Page reading: junk removal, titles, selectors, item lists."""

import random
import time
from urllib.parse import urljoin

import pytest

from tidings.fixed_values import IR_DATE_CLASS, IR_ITEM_SELECTORS, JUNK_SELECTORS
from tidings.functions import markup


def text_of(html, junk=JUNK_SELECTORS):
    return markup.Page(html).visible_text(markup.selectors(junk))


def test_nested_junk_goes_as_a_whole():
    assert text_of("<div class='ad'>a<div>b</div>c</div>d<nav>x<nav>y</nav>z</nav>e") == "d e"


def test_unclosed_and_stray_tags():
    assert text_of("<html><body><p><b>one<br><p>two</i></div> three") == "one two three"
    assert text_of("<p>a<form>hidden<p>b</p>") == "a"


def test_script_is_raw_text():
    assert text_of('<script>var t="</p><nav>";</script><p>kept</p>') == "kept"


def test_script_text_never_shows():
    assert text_of("<script>x</script><style>y</style>z", junk=()) == "z"


def test_comments_and_entities():
    assert text_of("a<!-- b --><p>fish &amp; chips &lt;3 &amp;lt;</p>") == "a fish & chips <3 &lt;"


def test_class_fragment_and_id():
    assert text_of("<p class='read-more'>x</p><p id=comments>y</p><p class='bad'>z</p>") == "z"


def test_unreadable_selector_is_skipped_alone():
    assert text_of("<nav>a</nav><i>b</i>c", junk=("p > q + r", ":::", "nav")) == "b c"


def test_title_before_cleaning():
    page = markup.Page("<head><title> A &amp; <b>B </b></title></head>x")
    assert page.title() == "A &B"
    assert markup.Page("<p>x").title() is None


def test_selectors():
    page = markup.Page("<article><p><a class='news__link big' data-k=v>x</a></p></article>")
    a = page.tags.index("a")
    for good in ("a", ".big", "a.news__link", "article a", "[class*='news']", "[data-k=v]", "article .big", "*"):
        assert markup.Selector(good).matches(page, a), good
    for bad in ("p", ".new", "li a", "#big", "[class=big]"):
        assert not markup.Selector(bad).matches(page, a), bad


def test_rns_items_near_dates():
    html = """<ul><li><a href="/news-article/ABC/1">One</a><time datetime="2025-01-02">x</time></li>
      <li><div><a href="https://h/news-article/abc/2"> Two <b>b</b></a></div><span class="item-date">3 Jan 2025</span></li>
      <li><a href="/news-article/ABC/3"></a></li><li><a href="/news-article/XYZ/4">Other</a></li></ul>"""
    assert markup.rns_items(html, "Abc") == {"texts": ["2025-01-02", "3 Jan 2025"], "items": [
        {"href": "/news-article/ABC/1", "title": "One", "date": 0}, {"href": "https://h/news-article/abc/2", "title": "Twob", "date": 1}]}


def test_rns_date_texts_stand_once_on_a_page():
    html = "<div class='update-list'>" + "".join(f"<p><a href='/news-article/ABC/{i}'>Results number {i}</a></p>" for i in range(2_000)) + "</div>"
    page = markup.rns_items(html, "ABC")
    assert len(page["items"]) == 2_000 and sum(map(len, page["texts"])) < len(html)


@pytest.mark.parametrize("html", ["<b>" * 100_000 + "</i>" * 100_000, "<i><table>" + "<b>" * 100_000 + "</i>" * 100_000, "<p>" * 100_000 + "</div>" * 100_000,
                                  "<i><b>" * 60_000 + "</i></b>" * 60_000, "<table><i>" * 50_000 + "</i></p></td>" * 50_000])
def test_stray_tags_take_seconds(html):
    began = time.process_time()
    markup.Page(html)
    assert time.process_time() - began < 4


def test_end_tags_reach_as_far_as_before():
    """Against a search down the stack of open elements."""
    r = random.Random(7)
    for _ in range(400):
        tags = [(r.choice(["b", "i", "div", "td", "tr", "table", "body"]), r.random() < 0.55) for _ in range(40)]
        page = markup.Page("".join(f"<{t}>" if opens else f"</{t}>" for t, opens in tags))
        parents, stack, names = [], [], []
        for tag, opens in tags:
            if opens:
                while stack and names[stack[-1]] in markup._ENDED_BY.get(tag, ()):
                    stack.pop()
                parents.append(stack[-1] if stack else -1)
                stack.append(len(names))
                names.append(tag)
                continue
            for depth in range(len(stack) - 1, -1, -1):
                if names[stack[depth]] == tag:
                    del stack[depth:]
                    break
                if markup._RANK.get(names[stack[depth]], 0) > markup._RANK.get(tag, 0):
                    break
        assert page.parents == parents and page.tags == names


def ir(html, item=None, date=None):
    page = markup.ir_items(html, "https://h.com/ir/", ((item,) if item else ()) + IR_ITEM_SELECTORS, date, IR_DATE_CLASS, urljoin)
    return [{**i, "date_texts": [page["texts"][d] for d in i["dates"]]} for i in page["items"]]


def test_ir_items_first_selector_wins():
    html = "<ul><li><a href='a'>A in list</a></li></ul><article><a href='a'>A</a><a href='b'>B</a></article>"
    assert [(i["selector_rank"], i["url"], i["title"]) for i in ir(html)] == [
        (0, "https://h.com/ir/a", "A"), (0, "https://h.com/ir/b", "B")]
    assert [i["title"] for i in ir(html, item="li a")] == ["A in list", "B"]


def test_ir_date_candidates_in_order():
    html = """<meta property="article:published_time" content="2025-05-05">
      <article><a href="a">A</a><p class="when">1 May 2025</p><div class="posted">2 May 2025</div><time>3 May 2025</time></article>"""
    assert ir(html, date=".when")[0]["date_texts"][0] == "1 May 2025"
    assert ir(html)[0]["date_texts"] == ["3 May 2025", "2 May 2025", "2025-05-05"]


def test_what_cannot_be_read_does_not_end_the_page():
    html = "<p>a<![foo bar]>b</p><article><a href='http://[bad/x'>Bad</a><a href='c'>C</a></article>"
    assert "<![foo bar]>b" in markup.Page(html).visible_text([])
    assert [(i["url"], i["resolved"]) for i in ir(html)] == [("http://[bad/x", False), ("https://h.com/ir/c", True)]
    assert markup.rns_items("<a href='/news-article/x/1'>T</a>", None)["items"] == []


def test_date_texts_stand_once_on_a_page():
    html = "<div class='updates'>" + "".join(f"<a href='{i}'>A{i}</a> " for i in range(1_500)) + "</div>"
    page = markup.ir_items(html, "https://h.com/", ("a",), None, IR_DATE_CLASS, urljoin)
    assert len(page["items"]) == 1_500 and sum(map(len, page["texts"])) < 2 * len(html)


def test_descendant_step_takes_one_pass():
    html = "<b>" * 4_000 + "<main>" + "<a href='x'>y</a>" * 500 + "</main>"
    page = markup.Page(html)
    chosen = markup.Selector("main a")
    assert len(page.where(chosen.matches)) == 500 and len(page._inside) == 1
    assert not page.where(markup.Selector(".none a").matches)


def test_detail_date():
    assert markup.detail_date_text("<time>1 May 2025</time><meta property='article:published_time' content='x'>") == "1 May 2025"
    assert markup.detail_date_text("<meta property='article:published_time' content='2025-05-01'>") == "2025-05-01"
    assert markup.detail_date_text("<p>none") is None
