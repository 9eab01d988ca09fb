import random

from editloom.llm.html import extract_text, render

CASES = {
    "<p>One<p>Two <b>bold</b>,<i> it</i><br>next": "One\n\nTwo bold, it\nnext",
    "<title>t</title><style>p{}</style><script>if (a < b) {}</script>seen<!-- not --> too": "seen too",
    "a<span hidden>x</span><span style='color:red; DISPLAY : none'>y</span><template>z</template>b": "ab",
    "<ul><li>a<li>b<ul><li>c</ul><li><p>d<p>e</ul>": "- a\n- b\n  - c\n- d\n\n  e",
    "<ol start=3><li>x<li value=9>y</ol><ol type=a><li>p<li>q</ol>": "3. x\n9. y\n\na. p\nb. q",
    "<ol reversed><li>x<li>y</ol>": "2. x\n1. y",
    "<table><tr><th>Name<th>Qty<tr><td>apple &amp; pear<td>3</table>": "Name          Qty\napple & pear  3",
    "<table><tfoot><tr><td>f</tfoot><tbody><tr><td>b</table>": "b\nf",
    "<table><tr><td rowspan=2>s<td>1<tr><td>2</table>": "s  1\n   2",
    "<table><tr><td colspan=2>wide cell<tr><td>a<td>b</table>": "wide cell\na  b",
    "<table><td>a<td>b<br>c</table>": "a  b\n   c",
    "<table><tr><td>日本<td>x<tr><td>ab<td>y</table>": "日本  x\nab    y",
    "<pre>\n keep   this\n\n  x</pre>y": " keep   this\n\n  x\n\ny",
    "<blockquote>q<p>r</blockquote>s": "  q\n\n  r\n\ns",
    "&copy; &lt;b&gt; 3 < 4 &amp": "© <b> 3 < 4 &",
    "<div>a<div>b</div>c</div><div>d": "a\nb\nc\nd",
    "a </b>b</p>c <unfinished": "a b\n\nc",
    "<h1>x</h2><h2>y": "x\n\ny",
    "<textarea> a &lt; b </textarea>": " a < b ",
    "<table>lost<tr>too<td>cell</table>": "losttoo\n\ncell",
    "<p title=it's>hello</p><p>bye</p>": "hello\n\nbye", "<a b='x>y' c = \"p'q>\" d=/>in</a>": "in", "<p a='unclosed>text</p>": "text",
    "<div style='visibility:hidden'>a<p style='visibility: visible'>b</p>c</div>d": "b\n\nd",
    "<table style='visibility:hidden'><tr><td>a<td style='visibility:visible'>b</table>": "b",
    "<ul style='visibility:hidden'><li>a<li style='visibility:visible'>b</ul>": "- b",
    "<style>.x{display:none} #k, em {visibility:hidden}</style><p class='y x'>a</p><p id=k>b</p>c <em>d</em>": "c",
    "<style>.x p{display:none} div>b{display:none !important} /* p{display:none} */</style><div class=x><i><p>a</p></i></div><p>b</p><div><b style='display:inline'>c</b><i><b>d</b></i></div>": "b\n\nd",
    "<style>@media print{p{display:none}} @media screen{b{display:none}} p:hover{display:none}</style><p>a</p><b>c</b>": "a",
    "<style>p{display:none}.s{display:block}</style><p>a</p><p class=s>b</p><p style='display:block'>c</p>": "b\n\nc",
    "<style>p{visibility:visible}</style><p style='visibility:hidden'>a</p><p style=display:none style=x>b</p>c": "c",
    "<table><tr><td colspan=300>a<td>b<tr><td rowspan=70000>c<td>d</table>": "a     b\nc  d",
    "": "", " \n ": "", "<p></p><p> </p>": "",
}


def test_cases():
    for source, text in CASES.items():
        assert render(source) == text, source


def test_deep_and_long():
    assert render("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert render("<ul><li>" * 3000 + "x").endswith("x")
    assert len(render("<p>word " * 50_000).split("\n\n")) == 50_000


def test_every_word_survives():
    r = random.Random(8)
    tags = ["p", "div", "b", "i", "ul", "li", "table", "tr", "td", "h1", "pre", "blockquote", "span", "ol", "dl", "dd", "section"]
    for _ in range(300):
        source, words = "", []
        for k in range(r.randint(1, 40)):
            source += r.choice([f"<{r.choice(tags)}>", f"</{r.choice(tags)}>", f" w{k} ", "<br>", "<!-- no -->"])
            if source.endswith(f" w{k} "):
                words.append(f"w{k}")
        assert sorted(x for x in render(source).split() if x.startswith("w")) == sorted(words), source


def tree(r, depth, seen, out):
    """A random page, as source; what a reader sees of it goes to ``out`` word by word."""
    source = ""
    for _ in range(r.randint(1, 4)):
        kind = r.choice(["word", "word", "block", "inline", "hide", "invisible", "shown", "class", "skip"]) if depth else "word"
        if kind == "word":
            word = f"w{r.randint(0, 10**9)}"
            source += f" {word} "
            if seen is True:
                out.append(word)
            continue
        if kind == "skip":
            source += r.choice(["<!-- <p>no</p> -->", "<script>if (a<b) document.write('<p>no')</script>", "<template><p>no</p></template>", "<br>"])
            continue
        mark = {"block": "", "inline": "", "hide": r.choice([" hidden", " style='display:none'", ' class="a gone"']), "invisible": " style='VISIBILITY : hidden'", "shown": " style='visibility:visible'", "class": " class='dim'"}[kind]
        tag = r.choice(["div", "section", "article", "blockquote"] if kind in ("block", "hide") else ["span", "b", "i", "q"])
        now = None if kind == "hide" or seen is None else {"invisible": False, "shown": True, "class": False}.get(kind, seen)
        source += f"<{tag}{mark}>{tree(r, depth - 1, now, out)}</{tag}>"
    return source


def test_what_is_seen_of_random_pages():
    """Against the plain rule, element by element: not displayed takes all within, visibility is inherited."""
    r = random.Random(12)
    for _ in range(400):
        words: list[str] = []
        source = "<style>.gone{display:none}.dim{visibility:hidden}</style>" + tree(r, 5, True, words)
        assert render(source).split() == words, source


def test_table(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None), (2, "v", "")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, extract_text(pages).collect()), key=str) == sorted([(1, "u", "a"), (1, "u", "a"), (None, None, ""), (2, "v", "")], key=str)
    assert extract_text(pages.limit(0)).count() == 0
