import random
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.functions.markup import payload_lines
from weftline.llm import main_body, pages, repeated_lines
from weftline.llm.repeated_lines import SPAN, cardinality, contains, pack, unite, unpack


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, SPAN - 1), max_size=300), st.lists(st.integers(0, SPAN - 1), max_size=300), st.booleans())
def test_bitmaps(a, b, dense):
    if dense:
        a = a + list(range(0, SPAN, 7))
    x, y = pack(np.array(a)), pack(np.array(b))
    assert list(unpack(x)) == sorted(set(a)) and cardinality(x) == len(set(a))
    both = unite([x, y])
    assert list(unpack(both)) == sorted(set(a) | set(b))
    for p in [*a[:20], *b[:20], 0, SPAN - 1]:
        assert contains(both, p) == (p in set(a) | set(b))
    assert len(x) <= SPAN // 8


def rows_of_sites(seed=3):
    rng = random.Random(seed)
    rows = []
    for s in range(5):
        for i in range(25):
            lines = [f"Own line {s} {i} {rng.random()}"] + [f"Line {k} of site {s}" for k in range(8) if rng.random() < k / 8]
            host = rng.choice([f"s{s}.test", f"WWW.S{s}.Test.", f" s{s}.test:80"])
            rows.append((len(rows), host, "<body>" + "".join(f"<p>{x.replace(' ', chr(160), 1)}</p>" for x in lines) + "</body>"))
    rows += [(1000, "s0.test", rows[0][2]), (1001, "s0.test", rows[0][2]), (1002, "s0.test", None), (1003, "s0.test", ""), (1004, None, "<p>x"), (1005, "s1.test", "plain Line 7 of site 1")]
    return rows


def test_repeated_lines_equal_brute_force(spark, make_raw):
    rows = rows_of_sites()
    numbered = repeated_lines.numbered_pages(spark, make_raw(rows))
    found = repeated_lines.RepeatedLines(spark, numbered, 8, 0.4)
    got = {(r.site, r.line, r.pages, r.total) for r in found.texts().collect()}
    have, total = defaultdict(set), defaultdict(set)
    for _, host, payload in rows:
        _, lines, _, html = payload_lines(payload)
        site = (host or "b.test").strip().lower().removeprefix("www.").split(":")[0].rstrip(".")
        if html:
            total[site].add(payload)
            for x in lines:
                have[site, x.text].add(payload)
    want = {(s, x, len(p), len(total[s])) for (s, x), p in have.items() if len(p) >= 8 and len(p) >= 0.4 * len(total[s])}
    assert got == want and want
    # Every page loses exactly those lines.
    drop = {(s, x) for s, x, _, _ in want}
    stripped = {r.raw_id: r for r in found.stripped().collect()}
    for i, host, payload in rows[:30]:
        site = host.strip().lower().removeprefix("www.").split(":")[0].rstrip(".")
        own = [x.text for x in payload_lines(payload)[1] if (site, x.text) not in drop]
        assert stripped[i].text == "\n".join(own)


def test_a_hot_site_over_several_containers(spark, make_raw):
    rows = [(i, "hot.test" if i % 3 else f"s{i % 4}.test", f"<p>own {i}</p>" + ("<p>on most</p>" if i % 5 else "")) for i in range(700)]
    found = repeated_lines.RepeatedLines(spark, repeated_lines.numbered_pages(spark, make_raw(rows)), 8, 0.4, span=64)
    assert found.containers.where("site = 'hot.test'").select("bucket").distinct().count() >= 7
    assert {(r.raw_id, r.text, r.removed) for r in found.stripped().collect()} == {(i, f"own {i}", int(i % 5 > 0)) for i in range(700)}


def test_variants_are_united(spark, make_raw):
    from pyspark.sql import functions as F

    rows = [(i, "v.test", f"<p>page {i} alone</p><p>{'Seen' if i % 2 else 'SEEN'} {i % 3} times</p>") for i in range(12)]
    numbered = repeated_lines.numbered_pages(spark, make_raw(rows))
    assert repeated_lines.RepeatedLines(spark, numbered, 8, 0.4).found.isEmpty()
    form = lambda c: F.regexp_replace(F.lower(c), r"\d+", "#")
    found = repeated_lines.RepeatedLines(spark, numbered, 8, 0.4, form).texts().collect()
    assert {r.pages for r in found if r.line.lower().startswith("seen")} == {12} and len({r.line for r in found if r.line.lower().startswith("seen")}) == 6


def test_no_pages(spark, make_raw):
    numbered = repeated_lines.numbered_pages(spark, make_raw([]))
    none = repeated_lines.RepeatedLines(spark, numbered, 8, 0.4)
    assert none.texts().isEmpty() and none.stripped().isEmpty()
    assert main_body.page_bodies(spark, make_raw([])).isEmpty()


def page(lines, marks=None):
    """A page of (text, block, linked, tags) lines, each its own form."""
    n = len(lines)
    return pages.Page([x[0] for x in lines], [x[1] for x in lines], [x[2] for x in lines], [x[3] for x in lines], [False] * n, list(range(16, 16 * n + 16, 16)), [0] * n, marks or {})


TEXT = "The keepers note the tide in a book that lies on the table by the door, and the boats leave at six when the harbour opens for the day. "
MENU = [("Home", "li", 4, 4), ("Store finder", "li", 12, 4), ("Careers", "li", 7, 4)]


def test_regions_of_content():
    lines = MENU + [("Tides and boats", "h1", 0, 3)] + [(TEXT * 2, "p", 0, 2)] * 3 + [("Another tide table for sailors", "li", 30, 6)] * 4 + [("Imprint", "p", 7, 4)]
    assert main_body.body_flags(page(lines)) == [False] * 3 + [True] * 4 + [False] * 5
    # A linked sentence is text; a linked title isn't.
    assert main_body.body_flags(page([*lines[3:6], ("They leave at six in summer and at eight in winter.", "li", 51, 4), *lines[6:]]))[3]
    assert main_body.body_flags(page([])) == [] and main_body.body_flags(page(MENU)) == [False] * 3


def test_cells_share_their_ratio():
    cells = [(x, "td", 0, 2) for x in ("Oak", "20 kg", "Beech", "31 kg", "Ash", "27 kg")]
    assert all(main_body.body_flags(page([("Woods", "h1", 0, 2), (TEXT, "p", 0, 2), *cells]))[2:])


def test_regions_decide(spark, data):
    """Without the regions, on evidence alone, much of what surrounds the body would stay."""
    from weftline.session import Scratch, table

    rows = pages.with_marks(Scratch(spark, "t").put(pages.page_lines(table(spark, data.replace("0.001", "0.01"), "raw")).where("html"))).collect()
    out = changed = 0
    for r in rows:
        p = pages.page_of(r["lines"], r["meta"], r["keys"], r["leads"], r["marks"])
        for body, weight in zip(main_body.body_flags(p), pages.line_weights(p)):
            out += not body
            changed += not body and weight > 0
    assert changed > 0.1 * out


def test_split_point_parts_clusters():
    edge = main_body.split_point([0.0, 1.0, 1.5, 100.0, 130.0])
    assert 1.5 < edge < 100.0 and 0 < main_body.split_point([4.0, 4.0]) < 4.0


def test_bodies(spark, make_raw):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    body = lambda: " ".join(word() for _ in range(40)) + "."
    rows = []
    for i in range(12):
        rows.append((i, "alpha.test", f"<body><nav><a href=1>Home</a><a href=2>Shop</a></nav><p>Home › Item {i}</p><h1>About {word()}</h1><p>{body()}</p><p>{body()}</p><p>Share this page with a friend</p><ul><li><a href=3>Related: {word()} {word()}</a></ul><footer><p>© 2020 Alpha</p></footer>"))
    rows += [(50, "alpha.test", None), (51, "alpha.test", " "), (52, "alpha.test", "no tags"), (53, "alpha.test", "<p></p>"), (54, None, "<p>only</p>"), (0, "alpha.test", rows[0][2])]
    raw = make_raw(rows)
    assert main_body.page_bodies(spark, raw).where('raw_id = 1').count() == 8
    out = defaultdict(set)
    for r in main_body.outside_body(spark, raw).collect():
        out[r.raw_id].add(r.line)
    for i in range(12):
        assert {x for x in out[i] if not x.startswith("Related")} == {"HomeShop", f"Home › Item {i}", "Share this page with a friend", "© 2020 Alpha"}
    bodies = {r.raw_id: r.body for r in main_body.body_texts(spark, raw).collect()}
    assert bodies[3].startswith("About") and "Share" not in bodies[3] and set(bodies) == {*range(12), 53, 54} and bodies[53] == ''
