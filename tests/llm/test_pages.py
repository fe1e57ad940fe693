import random

from weftline.llm import main_body, pages
from weftline.session import Scratch


def judged(spark, raw, page):
    table = Scratch(spark, "t").put(pages.page_lines(raw))
    r = pages.with_marks(table).where(f"page_id = {page}").collect()[0]
    return pages.page_of(r["lines"], r["meta"], r["keys"], r["leads"], r["marks"])


def test_evidence_counts_headlines(spark, make_raw):
    foot = "<footer><p>© 2024 Alpha. All rights reserved.</p><p>A long text that this site shows on all its pages, whatever they are about.</p></footer>"
    rows = [(i, "alpha.test", f"<body><h1>Head {chr(97 + i)}</h1><p>Own words of the page {chr(97 + i) * 9} that nobody else has at all.</p>{foot}</body>") for i in range(6)]
    rows += [(10 + i, "alpha.test", rows[0][2] + f"<i>{i}</i>") for i in range(4)]  # versions of one page
    rows += [(30, None, None), (31, "alpha.test", " "), (32, None, "<p>x</p>"), (None, "alpha.test", "<p>y</p>")]
    raw = make_raw(rows)
    assert pages.page_lines(raw).count() == 11
    for i in range(6):
        assert pages.line_weights(judged(spark, raw, i)) == [1.0, 1.0, 0.0, 0.0]


def test_leads_count_though_the_rest_differs(spark, make_raw):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    text = lambda n: " ".join(word() for _ in range(n)) + "."
    rows = [(i, f"s{i}.test", f"<h1>Report: {word()}</h1><p>{text(40)}</p><p>{word()}{i} wrote: {text(8)}</p><p>Store › {word()} {word()}</p>") for i in range(8)]
    page = judged(spark, make_raw(rows), 3)
    assert pages.line_weights(page) == [1.0, 1.0, pages.LEAD_WEIGHT, pages.LEAD_WEIGHT]


def test_a_hot_site_is_judged_like_others(spark, make_raw):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    page = lambda i: f"<h1>{word()} {word()}</h1><p>{' '.join(word() for _ in range(30))}.</p><p>Follow the paper for weekly notes</p><p>line {word()}</p>"
    rows = [(i, "hot.test" if i % 3 else f"s{i % 30}.test", page(i)) for i in range(600)]
    out = {r.raw_id for r in main_body.outside_body(spark, make_raw(rows)).where("line like 'Follow%'").collect()}
    assert out == set(range(600))


def test_empty(spark, make_raw):
    table = pages.page_lines(make_raw([]))
    assert table.isEmpty() and pages.repetition(table).isEmpty() and pages.with_marks(table).isEmpty()


def test_forms_and_leads():
    m = pages.Masker()
    assert m.form("© 2024 Ostcal Droulm", "ostcal-droulm.example") == "© # @ @"
    assert m.form("7", None) == "#" and m.form("7 kg", None, "td") == "7 kg"
    assert m.form("x" * 200 + "1", None).endswith("#")
    assert pages.lead_of("Ann12 wrote: yes") == "wrote:" and pages.lead_of("Home › Shoes") == "home›" and pages.lead_of("no lead") is None and pages.lead_of(": x") is None
