"""Layout that stays in proportion to the page, and what style sheets hide, against plain definitions of both."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakewarden.llm import render, styles


@pytest.mark.parametrize(
    "page",
    [
        "<table>" + "<tr><td rowspan=65534 colspan=1000>a</td>" * 25, "<table>" + "<tr><td rowspan=65534 colspan=1000>a</td>" * 5_000, "<table>" + ("<tr>" + "<td>x" * 1_000) * 20,
        "<table><tr><td>" + "y" * 20_000 + "<td>b" + "<tr><td>a<td>b" * 2_000, "<table><tr><td>x<td>" * 3_000, ("<table><tr><td>" + "z" * 50 + "<tr><td>a<td>") * 500, "<ul>" * 20_000 + "<li>x" * 20_000, "<blockquote>" * 20_000 + "x<br>" * 20_000,
        "<i><table>" + "<b>" * 20_000 + "</i>" * 20_000, "<table><tr>" + "<td>x" * 5_000 + "<td><pre>" + "q\n" * 5_000, "<style>" + "".join("* " * k + "{display:block}" for k in range(1, 200)) + "</style>" + "<b>x" * 20_000,
    ],
)
def test_time_and_output_follow_the_page(page):
    began = time.process_time()
    text = render.rendered(page)
    assert time.process_time() - began < 0.1 + 60e-6 * len(page)
    assert len(text) <= (1 + render.MOST_PADDING) * len(page) + render.MOST_INDENT * (text.count("\n") + 1)


def test_columns_line_up_while_there_is_room():
    page = "<table><tr><td>" + "y" * 300 + "<td>one" + "<tr><td>a<td>b" * 3 + "</table>"
    assert render.rendered(page).split("\n") == ["y" * 300 + "  one", *(["a" + " " * 301 + "b"] * 3)]
    wider = "<table><tr><td>" + "y" * 30_000 + "<td>one" + "<tr><td>a<td>b" * 300 + "</table><table><tr><td>long<td>c<tr><td>d<td>e</table>"
    lines = render.rendered(wider).split("\n")
    assert lines[0] == "y" * 30_000 + "  one" and lines[1] == "a  b" and lines[-1].split() == ["d", "e"]
    spans = "<table><tr><td colspan=2>wide and long<td>c<tr><td>a<td>b<td>d<tr><td rowspan=2>e<td>f<td>g<tr><td>h</table>"
    assert render.rendered(spans).split("\n") == ["wide and long  c", "a  b  d", "e  f  g", "   h"]


CASES = [
    (".m{display:none} .m{display:block}", "<div class=m>x</div>", "x"), (".m{display:none}", "<div class=m style='display:block'>x</div>", "x"), ("", "<div hidden style='display:block'>x</div>", "x"), ("", "<p hidden>x</p>y", "y"),
    ("div.m{display:none}", "<div class=m>x</div><p class=m>y", "y"), (".a .m{display:none}", "<div class=a><p><b class=m>x</b></p></div><b class=m>y</b>", "y"), ("a>b{display:none}", "<a><b>x</b><i><b>y</b></i></a>", "y"),
    (".m{display:none!important}", "<b class=m style='display:inline'>x</b>y", "y"), (".m{display:none!important}", "<b class=m style='display:inline !important'>x</b>", "x"), ("#i{display:block}.m{display:none}", "<b id=i class=m>x</b>", "x"),
    ("[data-x=h]{display:none}", "<b data-x=h>x</b>y", "y"), ("b:hover{display:none}", "<b>x</b>", "x"), ("b + i{display:none}", "<b>x</b><i>y</i>", "xy"), (".m{display:bogus}", "<b class=m hidden>x</b>y", "y"), ("p , .q{display:none}", "<p>x</p><i class=q>y</i>z", "z"),
    ("p{visibility:hidden}", "<p>x<b style='visibility:inherit'>y</b></p>z", "z"), ("p{visibility:hidden}", "<p>x<b style='visibility:visible'>y</b></p>z", "y\n\nz"), ("", "<details><summary>s</summary>t<p>u</details>v", "s\nv"), ("", "<details open><summary>s</summary>t</details>", "s\nt"),
    ("", "<details>t<div>u</div></details>v", "v"), ("", "<details><details open>t</details></details>v", "v"), ("DIV.M{DISPLAY:NONE}", "<div class=m>x</div>y", "y"), ("@media print{p{display:none}}", "<p>x", "x"), (".a\\:b{display:none}", "<b class='a:b'>x</b>y", "y"),
    ("x{display:none} x{color:red}", "<x>a</x>b", "b"), ("p{display:none;display:block}", "<p>x", "x"), ("p{display:none !important;display:block}", "<p>x</p>y", "y"),
]


@pytest.mark.parametrize(("css", "body", "text"), CASES)
def test_cascade(css, body, text):
    assert render.rendered(f"{body}<style>{css}</style>") == render.rendered(f"<style>{css}</style>{body}") == text


def test_sheets_that_do_not_hold():
    for head in ("<style media=print>", "<template><style>", "<noscript><style>"):
        assert render.rendered(f"{head}p{{display:none}}</style></template></noscript><p>x") == "x"
    assert render.rendered("<style media='screen'>p{display:none}</style><p>x</p>y") == "y"
    assert render.rendered("<p>İ<script>İİ</SCRIPT>a") == "İa"


TAGS, CLASSES, IDS = ("p", "b", "i"), ("m", "n"), ("u", "v")
compounds = st.tuples(st.sampled_from(["", "*", *TAGS]), st.lists(st.sampled_from([f".{c}" for c in CLASSES] + [f"#{i}" for i in IDS]), max_size=2, unique=True)).map(lambda x: "".join([x[0], *x[1]]) or "*")
selectors = st.tuples(compounds, st.lists(st.tuples(st.sampled_from([" ", " > "]), compounds), max_size=2)).map(lambda x: x[0] + "".join(c + s for c, s in x[1]))
sheets = st.lists(st.tuples(selectors, st.sampled_from(["display:none", "display:block", "display:none!important", "visibility:hidden"])), max_size=6)
elements = st.recursive(st.tuples(st.sampled_from(("b", "i")), st.sampled_from(["", *CLASSES]), st.sampled_from(["", *IDS]), st.just([])), lambda inner: st.tuples(st.sampled_from(("b", "i")), st.sampled_from(["", *CLASSES]), st.sampled_from(["", *IDS]), st.lists(inner, max_size=3)), max_leaves=8)


def fits(compound, element):
    tag, own, ident = element[:3]
    return compound.keys <= {tag, f".{own}", f"#{ident}"}


def matches(chain, path):
    """Whether a chain of compounds matches the last element of a path, by its definition."""
    if not fits(chain[-1], path[-1]):
        return False
    if len(chain) == 1:
        return True
    above = range(len(path) - 1, 0, -1)
    return any(matches(chain[:-1], path[:k]) for k in (list(above)[:1] if chain[-1].child else above))


def shown(rules_, path):
    """What the cascade says of display and visibility of an element."""
    won = {}
    for order, (selector, said) in enumerate(rules_):
        chain, weight = styles.parsed(selector)
        if matches(chain, path):
            for name, (value, important) in styles.declared(said).items():
                won.setdefault(name, []).append((important, weight, order, value))
    return tuple(max(won[n])[3] if n in won else "" for n in ("display", "visibility"))


@settings(max_examples=150, deadline=None)
@given(sheets, elements)
def test_states_equal_the_definition(rules_, tree):
    sheet = styles.Sheet("".join(f"{s}{{{d}}}" for s, d in rules_))

    def walk(element, parent, path):
        tag, own, ident, inner = element
        state, display, visibility = sheet.entered(parent, tag, {"class": own, "id": ident})
        assert (display, visibility) == shown(rules_, [*path, element])
        for e in inner:
            walk(e, state, [*path, element])

    walk(tree, sheet.start, [])


def test_columns_of_any_name_are_kept(spark):
    pages = spark.createDataFrame([(1, "m", "<p>a", "old")], "page_id long, __markup string, html string, text string")
    assert [r.asDict() for r in render.render(pages).collect()] == [{"page_id": 1, "__markup": "m", "text": "a"}]
