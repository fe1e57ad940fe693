import numpy as np
import pytest

from weftline.llm.failures import PLACEHOLDER, STUB, FailurePages, Logistic, agreed, describe, is_filler, numbered, shape, votes


@pytest.mark.parametrize(
    "text",
    ["{{name}}", "{{ name }}", "${city}", "#{x}", "<%= a.b %>", "{% year %}", "[[x]]", "[%x.y%]", "%DATE%", "*|NAME|*", "__email__", "@Model.title", "TODO: price", "[Insert company here]", "[Your name]", "<<cta>>", "<first_name>", "{YEAR}", "{0} a {1}"],
)
def test_placeholders(text):
    assert PLACEHOLDER.search(f"The {text} lamp")


@pytest.mark.parametrize("text", ["10% of 20% off", "a < b and c > d", "f(x) = {1, 2}", "see [1] and [note]", "snake_case_name", "5 * 4 * 3", "mail@model.test", "100%"])
def test_no_placeholders(text):
    assert not PLACEHOLDER.search(text)


def test_stubs_and_filler():
    assert all(STUB.fullmatch(t) for t in ("null", "[object Object]", "NaN", "TBD", "not-implemented", " None ")) and not STUB.fullmatch("none of these")
    assert is_filler("Lorem ipsum dolor sit amet consectetur adipiscing elit") and not is_filler("The quick brown fox jumps over the lazy dog today") and not is_filler("")


def test_logistic_separates_and_abstains():
    rng = np.random.default_rng(0)
    rows = [sorted({int(x) for x in rng.integers(10, 500, 8)} | ({3} if i % 4 == 0 else set())) for i in range(400)]
    y = np.array([float(i % 4 == 0) for i in range(400)])
    m = Logistic().fit(rows, y)
    assert all((m.score(r) >= 0.5) == bool(t) for r, t in zip(rows, y))
    assert Logistic().fit(rows, np.zeros(400)).score(rows[0]) < 0.01 and Logistic().fit([], np.zeros(0)).score([]) < 0.01


def test_soft_labels():
    rows = [[1, 5], [2, 5], [1, 6], [2, 6]] * 30
    m = Logistic().fit(rows, np.array([0.95, 0.02, 0.9, 0.05] * 30))
    assert m.score([1, 7]) > 0.5 > m.score([2, 7])


def test_voters_agree_to_probabilities():
    flag = np.array([True, False, True, False] + [False] * 96)
    said = np.zeros((100, 5), bool)
    said[:2, 0] = True
    p = agreed(flag, np.ones(100, bool), said)
    assert p[0] > p[1] > 0.9 and 0.9 > p[2] > p[3] and p[3] < 0.05
    assert agreed(flag[:0], flag[:0], said[:0]).shape == (0,)


def test_numbers_that_vary_between_the_same_words_are_filled_in():
    filled = [votes([f"Figures in braces {{{n}}} are estimates"])[1] for n in (3, 88, 17, 9)]
    open_ = [votes(["about {0} days in {1} towns"])[1]]
    assert numbered(filled) == [False] * 4 and numbered(open_) == [True] and numbered([[]]) == [False]


def test_shapes():
    assert [shape(t) for t in ("{{First_Name}}.", "{88}", "[Your", "@Model.item.title", "$45")] == ["{{a}}", "{#}", "[a", "@a", "$#"]


def test_votes_of_short_and_long_pages():
    long = "A long true sentence about garden tools that goes on and on without any message at all in it, for as long as it takes to be prose."
    assert votes(["Page not found"])[0] == [False, False, False, False, True]
    assert not any(votes(["A visitor who reads page not found", *[long] * 4])[0])
    assert votes(["null"])[0][3] and votes(["Dear {{name}},"])[0][0] and not any(votes([])[0])


def test_describe_reads_whole_texts():
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    one, two = describe("", [" ".join(words)]), describe("", [" ".join([*words[:-1], "{{x}}"])])
    assert set(two) - set(one) and describe("", []) and describe("T", ["T"]) != describe("T", ["U"])


def corpus(n=480, seed=4):
    """Rows of n pages, and the ids of those that fail."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghijk"), 6))
    prose = lambda: " ".join(word() for _ in range(60)) + "."
    messages = ["Page not found", "Access denied", "Please enable JavaScript to view this page.", "Error 503", "Content coming soon", "Service is down for maintenance until 9:00"]
    rows, bad = [], set()
    for i in range(n):
        kind, head = i % 6, f"<h1>{word()} {word()}</h1>"
        if kind == 0:
            m = messages[i // 6 % len(messages)]
            rows.append((i, f"s{i % 40}.test", f"<title>{m}</title><h1>{m}</h1>"))
        elif kind == 1:
            rows.append((i, f"s{i % 40}.test", f"{head}<p>{prose()} Dear {{{{first_name}}}}, {prose()}</p>"))
        elif kind == 2:
            rows.append((i, f"s{i % 40}.test", f"{head}<p>A visitor who sees page not found has an old link {word()}. {prose()}</p><pre>{{{{x}}}}</pre><noscript>Please enable JavaScript</noscript>"))
        elif kind == 3:
            rows.append((i, f"s{i % 40}.test", f"{head}<p>Figures in braces {{{int(rng.integers(100))}}} are estimates [see table 3] and cost $7 more. {prose()}</p>"))
        elif kind == 4:
            rows.append((i, f"s{i % 40}.test", f"{head}<p>{prose()} about {{0}} {word()} {{1}} {prose()}</p>" if i % 4 == 0 else f"{head}<p>{prose()}</p>"))
        else:
            rows.append((i, f"s{i % 40}.test", f"<p>{word()} {word()} {word()}</p>"))
        if kind < 2 or kind == 4 and i % 4 == 0:
            bad.add(i)
    return rows, bad


def test_pages_on_unseen_sites(spark, make_raw):
    rows, bad = corpus()
    rows += [(900, "a.test", None), (901, "a.test", " "), (902, "a.test", "null"), (903, None, "<div></div><noscript>JavaScript is required, please enable JavaScript</noscript>"), (None, "a.test", "Page not found")]
    flags = spark.createDataFrame([(i, i in bad and i % 4 == 0, "x") for i in range(480)] + [(0, True, "x"), (None, None, "x")], "raw_id BIGINT, clear_failure_union BOOLEAN, site STRING")
    model = FailurePages(spark, make_raw(rows), flags)
    got = {r.raw_id for r in model.scored().where("failed").collect()}
    assert len(got & bad) >= 0.98 * len(bad) and len(got - bad - {902, 903}) <= 0.02 * len(got) and 903 in got
    assert model.validation["recall"] > 0.9 and model.validation["precision"] > 0.9


def test_context_decides_on_the_same_braces(spark, make_raw):
    """A number in braces that an author wrote passes, the same sign as residue fails, on sites the fit hasn't seen."""
    rows, _ = corpus()
    model = FailurePages(spark, make_raw(rows), spark.createDataFrame([], "raw_id BIGINT, clear_failure_union BOOLEAN")).model
    prose = "The harbour opens at six and the boats leave with the tide, which the keepers note in a book that lies on the long table by the door. " * 4
    assert model.score(describe("", ["Quiet harbour", f"Figures in braces {{1}} are estimates [see table 9] and cost $4 more. {prose}"])) < 0.5
    assert model.score(describe("", ["Quiet harbour", f"{prose} about {{0}} noon {{1}} {prose}"])) > 0.5


def test_no_pages(spark, make_raw):
    flags = spark.createDataFrame([], "raw_id BIGINT, clear_failure_union BOOLEAN")
    assert FailurePages(spark, make_raw([]), flags).scored().isEmpty()
