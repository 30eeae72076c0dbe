"""Rendering of small pages."""

from __future__ import annotations

import random
import time

import pytest

from rollcall.llm.html_render import extract_text, render

CASES = {
    "<title>T</title><p>Hello <b>bold</b> world<br>next<p>Second &amp; last": "Hello bold world\nnext\n\nSecond & last",
    "<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>": "- a\n- b\n  3. x\n  4. y\n- c",
    "<table><tr><td>a<td>bbbb<tr><th>ccc<td>d</table>": "a    bbbb\nccc  d",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c</table>": "a  b\n   c",
    "<table><tr><td>日本<td>b<tr><td>x<td>c</table>": "日本  b\nx     c",
    "<div hidden>no</div><div style='color:red; display: none'>no</div><script>var x='</p>'</script>yes<!-- no -->": "yes",
    "<pre>  x\n   y</pre>z": "  x\n   y\n\nz",
    "a<div>b</div>c": "a\nb\nc",
    "x < y & z &lt;b&gt; <notatag": "x < y & z <b> <notatag",
    "<img alt='A cat'><input type=submit value=Go><input type=hidden value=no>": "A cat Go",
    "": "",
    "</p></div>text</li>": "text",
    "<dl><dt>a<dd>b<dt>c<dd>d</dl>": "a\nb\nc\nd",
    "<head><style>x</style>body text": "body text",
    "<select><option>a<option>b</select><textarea>t</textarea>": "a t",
    "<select><option>a<option selected>b</select><select multiple><optgroup><option>c<option>d</select>": "b c d",
    "<div style='visibility: hidden'>no<p style='visibility:visible'>yes<b>too</b></p><img alt=no></div>": "yestoo",
    "<ul style='visibility:hidden'><li>no<li style='visibility:visible'>b</ul>": "- b",
    "<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>": "s\nt\nyes",
    "a<b title='x>y'>b</b><i don't>c</i>": "abc",
    "<table><tr><td rowspan=3 colspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>": "a  b\n   c\n   d  e",
}


@pytest.mark.parametrize("page", CASES)
def test_render(page):
    assert render(page) == CASES[page]


def test_deep_and_long_pages():
    assert render("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert render("<b>" * 5000 + "deep").endswith("deep")
    assert len(render("<p>word</p>" * 20_000).split()) == 20_000


def test_table_of_pages(spark):
    df = spark.createDataFrame([(1, "<p>a", "old"), (2, None, "x"), (2, "", "x")], "page_id int, html string, text string")
    assert sorted((r.page_id, r.text) for r in extract_text(df).where("text is not null").collect()) == [(1, "a"), (2, "")]
    assert extract_text(df).where("text is null").count() == 1
    assert extract_text(df.where("false")).collect() == []
    assert extract_text(df.select("page_id", "html"), text="html").columns == ["page_id", "html"]


def test_all_that_a_browser_shows():
    pages = {
        "<table><tbody><form><tr><td>a<td>b</tr><tr><td>c<td>d</tr></form></tbody></table>": "a  b\nc  d",
        "<table><tbody>stray<div>box</div><tr><td>a</table>": "stray\nbox\na",
        "<table><thead><form>f<td>a<td>b</table>end": "f\na  b\n\nend",
        "<table><tr><td><table><tbody><form><tr><td>in</table>out<td>b</table>": "in   b\nout",
        "<p>x <svg><title>t</title><defs><text>no</text></defs><g><text>one</text><text display='none'>no</text><text>two</text></g></svg> y": "x one two y",
        "<math><semantics><mrow><mi>a</mi><mo>+</mo><mn>1</mn></mrow><annotation>no</annotation></semantics></math>": "a+1",
        "<p>p<xmp><b>&amp;</b>\n  k</xmp>q": "p\n\n<b>&amp;</b>\n  k\n\nq",
        "a<plaintext><i>b</plaintext>\n c": "a\n\n<i>b</plaintext>\n c",
    }
    assert {p: render(p) for p in pages} == pages


MALFORMED = {
    "quotes": '<p title="' * 100_000, "names": "<div " * 200_000, "no end": "<a" * 500_000, "both quotes": "<a '\"" * 200_000 + ">",
    "ends inside quotes": '<a "<a "> ' * 100_000, "comments": "<!-" * 300_000, "deep": "<b>" * 100_000 + "<div>" * 1000 + "x",
    "items": "<ul><li><ul>" + "<b>" * 50_000 + "<li></li>" * 50_000, "spans": "<table><tr>" + "<td rowspan=1000 colspan=1000>x" * 1000,
}


@pytest.mark.parametrize("name", MALFORMED)
def test_time_is_in_proportion_to_the_page(name):
    began = time.process_time()
    render(MALFORMED[name])
    assert time.process_time() - began < 20  # quadratic work would take minutes


def _made(r: random.Random, depth: int, seen: bool, words: list[str], shown: bool = True) -> str:
    """A random element; appends the words of it that can be seen, in their order."""

    def word() -> str:
        value = f"w{r.randrange(10**9)}"
        if seen and shown:
            words.append(value)
        return value

    out = []
    for _ in range(r.randint(1, 4)):
        kind = r.randrange(11) if depth else 0
        if kind == 0:
            out.append(f" {word()} " + r.choice(["", "&amp; ", "<!-- no> -->", "<br>"]))
            if seen and shown and out[-1].endswith("&amp; "):
                words.append("&")
        elif kind in (1, 2):
            tag = r.choice("div p section b span em h2 pre blockquote".split())
            end = "" if tag == "p" and r.random() < 0.5 else f"</{tag}>"
            out.append(f"<{tag} class='a>b'>{_made(r, depth - 1, seen, words, shown)}{end}" if tag not in ("p", "h2", "pre") else f"<{tag}> {word()} {end}")
        elif kind == 3:
            out.append(f"<div {r.choice(['hidden', 'style=\'color:red;display:none\''])}>{_made(r, depth - 1, seen, words, False)}</div>")
        elif kind == 4:
            out.append(f"<div style='visibility:hidden'>{_made(r, depth - 1, False, words, shown)}<span style='visibility:visible'>{_made(r, 0, True, words, shown)}</span></div>")
        elif kind == 5:
            out.append(r.choice(["<script>var a='<p>no</p>'</script>", "<style>no</style>", "<template><p>no</template>", "<noscript>no</noscript>"]))
        elif kind == 6:
            items = []
            for _ in range(r.randint(1, 3)):
                if seen and shown:
                    words.append("-")
                items.append(f"<li> {word()} {_made(r, depth - 1, seen, words, shown)}" + r.choice(["", "</li>"]))
            out.append(f"<ul>{''.join(items)}</ul>")
        elif kind == 7:
            cells = [[f"<td> {word()} " for _ in range(2)] for _ in range(r.randint(1, 3))]
            out.append("<table>" + "".join("<tr>" + "".join(x) for x in cells) + "</table>")
        elif kind == 8:
            out.append(f"<details><summary> {word()} </summary>no</details>")
        elif kind == 9:
            out.append(f"<img alt='{word()}'>")
        else:
            out.append(f"<input type=submit value='{word()}'>")
    return " ".join(out)


def test_every_visible_word_of_random_pages_and_no_other():
    for seed in range(300):
        words: list[str] = []
        page = _made(random.Random(seed), 4, True, words)
        assert render(page).split() == words, (seed, page)


def test_tables_with_clashing_columns_nulls_and_repeated_rows(spark):
    rows = [(1, "<p>a<p>b", "old", 5), (1, "<p>a<p>b", "old", 5), (None, None, None, None), (3, "<b>" * 3000 + "x", "", 1)]
    df = spark.createDataFrame(rows, "page_id int, html string, text string, _html int")
    out = extract_text(df)
    assert out.columns == ["page_id", "html", "_html", "text"]
    assert sorted(map(str, (tuple(r)[-1] for r in out.collect()))) == ["None", "a\n\nb", "a\n\nb", "x"]
