from weftline.operators import blocks

SOURCES = "snapshot_id STRING, format STRING, payload STRING, body_text STRING, quality_flags ARRAY<STRING>"
RESULTS = "snapshot_id STRING, method STRING, status STRING, text STRING, runtime_ms DOUBLE"


def test_policies(spark):
    html, flagged = ("html", "<p>useful content</p>", "useful content", []), ("html", "<p>x y</p>", "x y", ["possible_error_response"])
    sources = {"agree": html, "differ": html, "stub": ("text", "not-implemented", "not-implemented", []), "text": ("text", "Useful details", "Useful details", []), "odd": ("unknown", "%PDF", "%PDF", []), "flag": flagged, "none": html, "null": (None, None, None, []), "code": ("html", "<pre>a b</pre>", "a b", [])}
    results = [("agree", "trafilatura", "one two"), ("agree", "readability", "one two"), ("agree", "conservative_dom", "one two three"), ("differ", "trafilatura", "one two three"), ("differ", "readability", "four five six"), ("text", "markdown_text", "Useful details"), ("flag", "trafilatura", "x y"), ("flag", "readability", "x y"), ("flag", "conservative_dom", "x y"), ("code", "trafilatura", "a b"), ("code", "readability", "a b")]
    s = spark.createDataFrame([(k, *v) for k, v in sources.items()], SOURCES)
    r = spark.createDataFrame([(k, m, "ok", t, 1.0) for k, m, t in results] + [("none", "conservative_dom", "error", "text", 1.0), ("none", "readability", "ok", "  ", 1.0)], RESULTS)
    kept = {x.snapshot_id: (x.status, x.method) for x in blocks.select_candidates(s, r).collect()}
    assert kept == {
        "agree": ("selected", "conservative_dom"), "differ": ("needs_review", None), "stub": ("source_insufficient", None), "text": ("selected", "markdown_text"), "odd": ("unsupported_format", None),
        "flag": ("needs_review", "conservative_dom"), "none": ("needs_review", None), "null": ("unsupported_format", None), "code": ("needs_review", None),
    }
    precise = {x.snapshot_id: (x.status, x.method, x.agreement) for x in blocks.select_by_agreement(s, r).collect()}
    assert precise["agree"] == ("selected", "trafilatura", 1.0) and precise["code"] == ("selected", "readability", 1.0) and precise["differ"] == ("needs_review", None, 0.0)
    assert precise["text"] == ("selected", "markdown_text", None) and precise["flag"][0] == "needs_review" and precise["none"] == ("needs_review", None, None)
    assert precise["stub"][0] == "source_insufficient" and precise["odd"][0] == "unsupported_format"
