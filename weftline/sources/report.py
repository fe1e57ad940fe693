"""Self-contained HTML reports of small results."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame

ROWS_MOST = 10_000  # rows of one table; a larger result is an error, not a cut


def html_report(title: str, tables: dict[str, DataFrame]) -> str:
    """A page with a table for each result; everything from the data is escaped. Meant for aggregates: a result above ROWS_MOST rows raises."""
    parts = [f"<!doctype html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>"]
    for name, df in tables.items():
        rows = df.limit(ROWS_MOST + 1).collect()
        if len(rows) > ROWS_MOST:
            raise ValueError(f"{name} has more than {ROWS_MOST} rows")
        head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows)
        parts.append(f"<h2>{escape(name)}</h2><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>")
    return "".join(parts) + "</body></html>"


def preview(text: str | None, limit: int = 200) -> str:
    """The first `limit` UTF-8 bytes of a text, cut between characters."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw[:limit].decode("utf-8", "ignore") + ("…" if len(raw) > limit else "")
