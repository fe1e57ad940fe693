import random
from html.parser import HTMLParser

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from weftline.functions import dom, markup
from weftline.functions.markup import is_html, payload_lines
from weftline.functions.text import normalized_tokens, read_path, split_bytes


def lines(payload):
    return [x.text for x in payload_lines(payload)[1]]


def test_lines_break_at_blocks_and_br_only():
    page = "<html><head><title>T &amp; U</title></head><body><p>one <b>two</b><!-- x --> three<br>four<table><tr><td>a<td>b</table><script>no</script><noscript>use scripts</noscript><em>x</em>&nbsp;y</body></html>"
    assert lines(page) == ["one two three", "four", "a", "b", "x y"]
    title, _, notice, html = payload_lines(page)
    assert (title, notice, html) == ("T & U", "use scripts", True)


def test_odd_markup():
    assert lines("<P ALIGN=left>a > b <IMG src='x>y'>c<BR/>d</P ><p>unclosed <a href=\"q\">link") == ["a > b c", "d", "unclosed link"]
    assert lines("<div>5 < 6 and <%= x %></div>") == ["5 < 6 and <%= x %>"]
    assert lines(None) == lines("") == lines(" \n ") == []


def test_code_is_marked():
    got = payload_lines("<pre>{{ a }}</pre><p><code>b</code></p><p>use <code>{{c}}</code> here {{d}}</p>")[1]
    assert [(x.code, x.plain) for x in got] == [(True, None), (True, None), (False, "use here {{d}}")]


def test_markdown_lines():
    got = payload_lines("# Head\n\n- item [x](http://a)\n```\ncode\n```\n&lt;b&gt;")[1]
    assert [(x.text, x.block, x.code) for x in got] == [("Head", "h1", False), ("item x", "li", False), ("code", "pre", True), ("<b>", "p", False)]


def test_is_html():
    assert is_html("<!DOCTYPE html>") and is_html("a <br> b") and not is_html("a <first_name> b") and not is_html("1 < 2") and not is_html(None)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/pabdiv&;! =\"'-x\n", max_size=80))
def test_any_text_can_be_read(text):
    payload_lines(text)
    dom.html_blocks(text)
    dom.inventory(text)
    dom.blocks_markdown(dom.text_blocks(text))


def test_blocks():
    blocks = dom.html_blocks("<body><nav>menu</nav><h1>Top</h1><ol start=3><li>one<ul><li>two</ul></ol><blockquote><p>q</p></blockquote><pre><code class='language-sql'>SELECT 1</code></pre><img alt='pic'><hr><dl><dt>t<dd>d</dl>loose <b>text</b></body>", "https://a.test/x")
    kinds = [b["block_type"] for b in blocks]
    assert kinds[:5] == ["heading", "list", "list_item", "list", "list_item"] and "quote" in kinds and "code" in kinds and "definition_term" in kinds
    assert next(b for b in blocks if b["block_type"] == "code")["language"] == "sql"
    assert next(b for b in blocks if b["block_type"] == "list")["start"] == 3
    assert "menu" not in " ".join(b["text"] for b in blocks)


def test_table_grid():
    cells = dom.table_cells(next(dom.tree("<table><tr><th rowspan=2>a</th><th colspan=2>b</th></tr><tr><td>c</td><td>d</td></tr></table>").all("table")))
    assert [(c["row"], c["column"], c["text"]) for c in cells] == [(0, 0, "a"), (0, 1, "b"), (1, 1, "c"), (1, 2, "d")]


def test_inline_markdown():
    p = next(dom.tree('<p>a <strong>b</strong> <em>c</em> <code>d`e</code> <a href="/f">g</a> <del>h</del></p>').all("p"))
    assert dom.inline_markdown(p, "https://x.test/") == "a **b** *c* `` d`e `` [g](https://x.test/f) ~~h~~"


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab é字\n", max_size=60), st.integers(4, 20))
def test_byte_chunks_lose_nothing(text, ceiling):
    chunks = split_bytes(text, ceiling)
    assert "".join(text[a:b] for a, b in chunks) == text
    assert all(len(text[a:b].encode()) <= ceiling for a, b in chunks)


def test_paths():
    ready = {"https://stride.example/journal/running-shoes?a=secret#x": "journal / running shoes", "https://x.example/a%2Fb/c_d": "a/b / c d", "https://x.example/a+b/%E9%9E%8B": "a+b / 鞋", "https://x.example//12/": "12", "https://a.test/post.html": "post.html"}
    for href, path in ready.items():
        assert read_path(href)[:3] == (path, "ready", None)
    assert read_path("https://x.example/a%2Fb/12")[3] == ["encoded_slash_in_segment", "numeric_segment"] and read_path(f"https://x.example/{'k' * 24}")[3] == ["possibly_opaque_segment"]
    for bad in ("https://x.example/", "javascript:alert(1)", "https://x.example/%FF", "https://x.example/%G0", "https://x.example/%00", "https://x.example:bad/a", "https://x.example/a b", None, ""):
        assert read_path(bad)[:2] == ("", "unavailable")
    assert read_path("https://x.example/%G0")[2] == "invalid_percent_escape" and read_path("https://x.example")[2] == "root_only_path"


def test_normal_tokens(spark):
    cases = {
        "Shoes policies boxes 1,000.00 kilograms 10% e-mail": ["shoe", "policy", "box", "1000", "kg", "10", "percent", "email"], "news analysis status species": ["news", "analysis", "status", "species"],
        "centimetres hours dollars": ["cm", "h", "usd"], "10.50": ["10.5"], "1,000,000": ["1000000"], "1,200.50 kilometres, 5% of boxes and stories": ["1200.5", "km", "5", "percent", "of", "box", "and", "story"],
        "007 0 0.0 $5 €7": ["7", "0", "0", "usd", "5", "eur", "7"], "glasses bus ties gas": ["glass", "bus", "tie", "gas"], "": [],
    }
    df = spark.createDataFrame([(k,) for k in cases], "t STRING").select("t", normalized_tokens(F.col("t")).alias("n"))
    got = {r.t: r.n for r in df.collect()}
    assert {k: v for k, v in got.items() if v != cases[k]} == {}
    assert spark.createDataFrame([(None,)], "t STRING").select(normalized_tokens(F.col("t"))).collect()[0][0] == []


def test_one_loop_reads_as_the_library_does(monkeypatch):
    """Odd and broken markup gives what the library's own loop gives; of plain markup nothing is left to it."""
    parts = [
        "<p>", "</p>", "<br/>", "<a href='x>y'>", "</a>", "<h1 class=a>", "</h1 >", "<!-- c -->", "<!-- c", "<!--", "<!doctype html>", "<!x>", "<![CDATA[q]]>", "<?pi?>", "<", "</", "</ >", "< p>", "&amp;", "&am", "&#65;", "&",
        "<script>", "</script>", "<script/>", "if (a<b) </p>", "<style>", "</style >", "<title>", "</title>", "<head>", "</head>", "<noscript>", "</noscript>", "<pre>", "</pre>", "<code>", "</code>", " ", "\n", "word", "two words", "<td", "<b x=\"",
    ]

    class Plain(markup._LineReader):
        goahead = HTMLParser.goahead

    def read(kind, text):
        reader = kind()
        reader.feed(text)
        reader.finish()
        return reader.title, reader.lines, reader.notice

    rng = random.Random(4)
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert read(markup._LineReader, text) == read(Plain, text), text
    left = []
    library = HTMLParser.goahead
    monkeypatch.setattr(HTMLParser, "goahead", lambda self, end: (left.append(self.rawdata), library(self, end))[1])
    read(markup._LineReader, "<!doctype html><html><head><title>T</title><script>a<b</script></head><body><!-- c --><p class=x>One <b>two</b> &amp; three</p></body></html>")
    assert left == ["", ""]
