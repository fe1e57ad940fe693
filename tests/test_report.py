import pytest

from weftline.operators.quality import probe, probe_flags, prompt_style_flags
from weftline.sources import report


def test_report_escapes(spark, monkeypatch):
    df = spark.createDataFrame([("<b>", None)], "a STRING, b STRING")
    page = report.html_report("A & B", {"t": df})
    assert "&lt;b&gt;" in page and "<b>" not in page and "A &amp; B" in page
    monkeypatch.setattr(report, "ROWS_MOST", 0)
    with pytest.raises(ValueError):
        report.html_report("x", {"t": df})
    assert report.preview("é" * 10, 3) == "é…" and report.preview(None) == ""


def test_probe_flags(spark, make_raw):
    raw = make_raw([(1, "a", None), (2, "a", "not-implemented"), (3, "a", "<title>Access denied</title><p>x"), (4, "a", "<p>" + "word " * 200), (5, "a", "<p>Please enable JavaScript</p><script>x</script>"), (6, "a", "# Head")])
    got = {r.raw_id: r for r in probe_flags(probe(raw)).collect()}
    assert [got[i].clear_failure_union for i in range(1, 7)] == [True, True, True, False, True, False]
    assert got[5].sparse_script_shell_candidate and got[6].markdown_like_without_html and not got[4].sparse_body_candidate
    assert prompt_style_flags(raw).where("missing_or_blank").count() == 6
    assert probe_flags(probe(raw.limit(0))).isEmpty()
