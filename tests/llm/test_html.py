import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tagloom.llm.html_layout import extract_pages, visible_text

CASES = {
    "<p>one<p>two": "one\n\ntwo",
    "<h1>T &amp; u</h1>x<br>y": "T & u\n\nx\ny",
    "<ul><li>a<li>b<ol start=3><li>c</li><li>d</ol><li>e</ul>": "- a\n- b\n  3. c\n  4. d\n- e",
    "<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td>s<td>22</table>": "Name      | N\nlong name | 1\ns         | 22",
    "<style>.ad, #z { display : none }</style><div class='x ad'>no</div><div id=z>no</div><div class=add>yes</div>": "yes",
    "<p hidden>a</p><p style='visibility: hidden'>b</p><input type=hidden value=q><dialog>d</dialog><script>var x='<p>s</p>'</script>c": "c",
    "<pre>\n a  b\n\n  c</pre>": "\n a  b\n\n  c".lstrip("\n"),
    "<div>a</div><div>b</div>": "a\nb",
    "a <b>b</b>\n  c": "a b c",
    "<dl><dt>t<dd>d1<dd>d2</dl>": "t\n  d1\n  d2",
    "<blockquote>q</blockquote>r": "  q\n\nr",
    "<select><option>1<option>2</select>": "1\n2",
    "x</p>y": "x\n\ny",
    "<title>t</title><textarea>&lt;b></textarea>": "<b>",
    "<!-- c --><!DOCTYPE html>z<!-- open": "z",
    "a < b & c": "a < b & c",
    "<div": "",
    "": "",
    "<table><tr><td><table><tr><td>in</table><td>out</table>": "in | out",
}


@pytest.mark.parametrize("page", CASES)
def test_layout(page):
    assert visible_text(page) == CASES[page]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<ul>", "<li>", "</ul>", "<table><tr><td>", "</td></tr></table>", "<b>", "</b>", "w1 ", "w2 ", "<br>", "<pre>", "</pre>", "<div>", "</div>"]), max_size=30))
def test_no_word_is_lost(parts):
    words = sum(p.startswith("w") for p in parts)
    assert sum(visible_text("".join(parts)).count(w) for w in ("w1", "w2")) == words


def test_deep_and_broken_pages():
    assert visible_text("<div>" * 50_000 + "x") == "x"
    assert "x" in visible_text("<table><tr><td>" * 500 + "x")
    visible_text("<" * 5000 + '<a b="' * 500)


def test_pages(spark):
    rows = [(1, "<p>a", "u"), (1, "<p>a", "u"), (2, None, None), (3, "", ""), (None, "é😀", "")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in extract_pages(df).collect())
    assert got == [("1", "a", 1), ("1", "a", 1), ("2", "", 0), ("3", "", 0), ("None", "é😀", 2)]
    assert extract_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize("depth", [510, 600, 20_000])
@pytest.mark.parametrize("tag", ["div", "b"])
def test_below_many_open_elements(depth, tag):
    deep = f"<{tag}>" * depth
    assert visible_text(deep + "<table><tr><td>cell<td>2</td></tr></table>") == "cell | 2"
    assert visible_text(deep + "<div hidden>x<div>y</div>z</div>w") == "w"
    assert visible_text(f"<div hidden>{deep}<div>x</div></div>" + f"</{tag}>" * depth + "</div>y") == "y"


def test_items_without_end_tags_in_nested_lists():
    assert visible_text("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>") == "- a\n  - b\n  - c\n- d"
    assert visible_text("<table><tr><td><table><tr><td>a<tr><td>b</table></table>") == "a\nb"


TABLE_CASES = {
    "<table><tr><td>a</td></tr><p>rest<p>of the page": "rest\n\nof the page\n\na",
    "x<table>intro<tr>text<td>a<td>b</table>y": "xintrotext\n\na | b\n\ny",
    "<table><tbody><b>bold</b> <tr><td>a</tr>mid<tr><td>b</table>": "boldmid\n\na\nb",
    "<table><tr><td>a<table><table><tr><td>b</table>c</table>d": "a\nb\nc\n\nd",
    "<table>1<table>2<tr><td>3</table>4": "1\n\n2\n\n3\n\n4",
    "<table><colgroup><col>c<tr><td>a</table>": "c\n\na",
    "<table><form><tr><td>a</form><td>b</table>": "a | b",
    "<table><div>d<tr><td>a<tr><div>e<td>b</table>": "d\ne\n\na\nb",
    "<table><caption>c<tr><td>a<td>b</table>": "c\na | b",
    "<table><template><tr>x<td>y</td></tr></template><noscript><tr><td>n</td></tr></noscript><svg><tr>s</svg><tr><td>a</table>": "s\n\na",
    "<table><input type=submit value=Go><tr><td>a</table>": "Go\n\na",
}


@pytest.mark.parametrize("page", TABLE_CASES)
def test_content_in_tables_but_in_no_cell(page):
    assert visible_text(page) == TABLE_CASES[page]


PARTS = "<table> <tr> <td> <tbody> <thead> <caption> <colgroup> <col> </td> </tr> </tbody> </table> <b> </b> <div> </div> <p> <form> </form> <br> <li> <ul> </ul> <button> </p>".split()


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from([*PARTS, "w1 ", "w2 "]), max_size=30))
def test_no_word_is_lost_in_parts_of_tables(parts):
    words = sum(p.startswith("w") for p in parts)
    assert sum(visible_text("".join(parts)).count(w) for w in ("w1", "w2")) == words


@pytest.mark.parametrize(
    ("style", "hides"),
    [
        ("<style>@media print{nav,.menu{display:none}}</style>", False),
        ("<style>@media (max-width:600px){p{color:red}.menu{display:none}}</style>", False),
        ("<style>@media screen and (max-width:600px){@layer a{.menu{display:none}}}</style>", False),
        ("<style>@supports (display:grid){.menu{display:none}}</style>", False),
        ("<style media=print>.menu{display:none}</style>", False),
        ("<style media='(max-width: 9px)'>.menu{display:none}</style>", False),
        ("<style>.a{color:red;.menu{display:none}}</style>", False),
        ("<style>@media print{nav{color:red}}.menu{display:none}</style>", True),
        ("<style>@media print{/* } */a:after{content:'}'}.menu{display:none}}</style>", False),
        ("<style>@media print, screen{nav{color:red}.menu{display:none}}</style>", True),
        ("<style>@media only screen{.menu{display:none;color:red}}</style>", True),
        ("<style>@layer x{@media not print{.menu{color:red;display:none}}}</style>", True),
        ("<style media='ALL'>@import 'x.css';.a,.menu{background:url(data:x;y);display:none}</style>", True),
        ("<style media=screen>.menu{visibility:hidden}</style>", True),
    ],
)
def test_rules_under_a_condition_hide_nothing(style, hides):
    assert visible_text(style + "<nav class=menu>m</nav>t") == ("t" if hides else "m\nt")


SEEN = {
    "<style>.a{display:none}.a{display:block}</style><p class=a>x": "x",
    "<style>#i{display:block}.a{display:none}p{display:none}</style><p class=a id=i>x": "x",
    "<style>.a{display:none!important}</style><p class=a style='display:block'>x</p>y": "y",
    "<style>.a{display:none}</style><p class=a style='display:block'>x": "x",
    "<div style='visibility:hidden'>a<b style='visibility:visible'>b</b>c</div>": "b",
    "<style>.v{visibility:visible}</style><div style='visibility:hidden'>a<ul><li class=v>b</ul></div>": "- b",
    "<div style='display:none'>a<b style='display:block;visibility:visible'>b</b></div>c": "c",
    "<style>[hidden]{color:red}.s{display:block}</style><p hidden class=s>x</p><p hidden>y": "x",
    "<style>div.x{display:none}</style><div class='x y'>a</div><p class=x>b": "b",
    "<style>.a .b{display:none}</style><p class=b>x</p><div class=a><p><i class=b>y</i>z": "x\n\nz",
    "<style>.a>.b{display:none}</style><div class=a><p><i class=b>y</i></p><i class=b>w</i></div>": "y",
    "<style>.a .c>.b{display:none}</style><div class=a><div class=c><div><i class=b>k</i></div><i class=b>n</i></div></div>": "k",
    "<style>.a:hover,.b::before,a[href]{display:none}</style><a href=x class='a b'>x</a>": "x",
    "<style>*{color:red}</style><p>x": "x",
    "a<!-->b<!--->c<!-- d --!>e": "abce",
    "<svg><text>axis</text><title>no</title><desc>no</desc></svg><math><mi>x</mi><mo>+</mo></math>": "axisx+",
    "<table><tr><td>a|<td>b |</table>": "a| | b |",
    "<table><tr><td colspan=2>ab<td>c<tr><td>1<td>2<td>3</table>": "ab    | c\n1 | 2 | 3",
    "<table><tr><td rowspan=2>r<td>1<tr><td>2<tr><td>s<td>3</table>": "r | 1\n  | 2\ns | 3",
    "<table><tr><td colspan=3>a wide heading<tr><td>1<td>2<td>3</table>": "a wide heading\n1      | 2 | 3",
    "<table><tr><td style='visibility:hidden'>q<td>w</table>": " | w",
}


SEEN |= {
    "<details>a<summary>s</summary>b<p>c</details>d": "s\n\nd",
    "<details open>a<summary>s</summary>b</details>d": "a\ns\nb\n\nd",
    "<details><p>a</details>d": "d",
    "<details><details open><summary>in</summary>x</details><summary>s</summary><summary>t</details>": "s",
    "<ruby>k<rp>(</rp><rt>r</rt><rp>)</rp></ruby>": "kr",
    "a<plaintext>b</plaintext> <b>c\n d": "a\nb</plaintext> <b>c\n d",
}


@pytest.mark.parametrize("page", SEEN)
def test_cascade_selectors_and_spans(page):
    assert visible_text(page).strip() == SEEN[page].strip()


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_words_show_where_their_ancestors_do(data):
    """Nested elements with styles of all sorts against a walk over the same tree by the plain rules of CSS."""
    styles = {"": None, "display:none": ("display", "none"), "display:block": ("display", "block"), "visibility:hidden": ("visibility", "hidden"), "visibility:visible": ("visibility", "visible")}
    words, page = [], []

    def grow(depth, displayed, visible):
        for _ in range(data.draw(st.integers(0, 3))):
            if depth == 0 or data.draw(st.booleans()):
                page.append(f"w{len(words)}w ")
                words.append(displayed and visible)
                continue
            tag, style, name = data.draw(st.sampled_from(["div", "b", "section"])), data.draw(st.sampled_from(list(styles))), data.draw(st.sampled_from(["", "gone", "ghost"]))
            page.append(f"<{tag} class='{name}' style='{style}'>")
            kind, value = styles[style] or ("", "")
            box = value if kind == "display" else "none" if name == "gone" else ""
            show = value if kind == "visibility" else "hidden" if name == "ghost" else ""
            grow(depth - 1, displayed and box != "none", visible if not show else show == "visible")
            page.append(f"</{tag}>")

    grow(4, True, True)
    text = visible_text("<style>div.gone,b.gone,section.gone{display:none}.ghost{visibility:hidden}</style>" + "".join(page))
    assert [f"w{i}w" in text for i in range(len(words))] == words


def test_tables_in_tables_are_aligned_at_any_depth():
    text, page = "a  | b\ncc | d", "<table><tr><td>a<td>b<tr><td>cc<td>d</table>"
    for depth in range(40):
        page = f"<table><tr><td>{page}<td>{depth}</table>"
        first, *rest = text.split("\n")
        width = max(map(len, [first, *rest]))
        text = "\n".join([f"{first.ljust(width)} | {depth}", *rest])
        assert visible_text(page) == text, depth
    assert [visible_text("<blockquote>" * 9 + "x", most_indent=n) for n in (4, 1024)] == [" " * 4 + "x", " " * 18 + "x"]


def test_a_page_of_megabytes():
    rows = "".join(f"<tr><td>{i}<td>{'é' * (i % 50)}<td><p>x<p>y</tr>" for i in range(20_000))
    text = visible_text(f"<div>{'word ' * 400_000}</div><table>{rows}</table>")
    assert text.count("word") == 400_000 and text.count("y") == 20_000


NAMES = st.text("abcde", min_size=1, max_size=9)
LISTS = st.recursive(NAMES, lambda x: st.tuples(st.booleans(), st.lists(st.tuples(NAMES, st.one_of(st.none(), x.filter(lambda v: not isinstance(v, str)))), min_size=1, max_size=4)), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(LISTS.filter(lambda x: not isinstance(x, str)))
def test_lists_against_a_plain_renderer(tree):
    def page(t):
        tag = "ol" if t[0] else "ul"
        return f"<{tag}>" + "".join(f"<li>{name}{page(inner) if inner else ''}</li>" for name, inner in t[1]) + f"</{tag}>"

    def lines(t, indent):
        for i, (name, inner) in enumerate(t[1]):
            marker = f"{i + 1}. " if t[0] else "- "
            yield " " * indent + marker + name
            if inner:
                yield from lines(inner, indent + len(marker))

    assert visible_text(page(tree)) == "\n".join(lines(tree, 0))


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 5).flatmap(lambda n: st.lists(st.lists(NAMES, min_size=n, max_size=n), min_size=1, max_size=6)))
def test_tables_against_a_plain_renderer(rows):
    page = "<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in r) for r in rows) + "</table>"
    widths = [max(len(r[i]) for r in rows) for i in range(len(rows[0]))]
    assert visible_text(page) == "\n".join(" | ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in rows)
