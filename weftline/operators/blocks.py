"""Block trees of documents: order, parents, sections, chunks, and the checks that they hold together.

A document is the blocks of one snapshot and method. Blocks stored twice under another block_uid count
once. Documents are bounded by their page, so a document's blocks may meet in one row; a table's never do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.text import stable_hash

DOCUMENT = ["snapshot_id", "method"]
ORDER = ["block_order", "block_id"]


def distinct_blocks(blocks: DataFrame) -> DataFrame:
    """One row for each block_id of a document, the one with the least block_uid."""
    rest = [c for c in blocks.columns if c not in (*DOCUMENT, "block_id")]
    best = blocks.groupBy(*DOCUMENT, "block_id").agg(F.min_by(F.struct(*rest), F.col("block_uid")).alias("b"))
    return best.select(*DOCUMENT, "block_id", "b.*")


def sections(blocks: DataFrame) -> DataFrame:
    """Adds section: how many headings stand up to here. 0 is the part before the first heading."""
    return blocks.withColumn("section", F.sum((F.col("block_type") == "heading").cast("int")).over(W.partitionBy(*DOCUMENT).orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0)))


def section_sizes(blocks: DataFrame) -> DataFrame:
    """(snapshot_id, method, section, n_blocks, chars, heading): the sections of each document; an empty part before the first heading is left out."""
    own = F.when(F.col("block_type") != "heading", F.length(F.trim("text"))).otherwise(0)
    g = sections(blocks).groupBy(*DOCUMENT, "section").agg(F.count(F.lit(1)).alias("n_blocks"), F.coalesce(F.sum(own), F.lit(0)).alias("chars"), F.max(F.when(F.col("block_type") == "heading", F.col("text"))).alias("heading"))
    return g.where("section > 0 OR chars > 0")


def supported_headings(blocks: DataFrame, least_words: int = 5) -> DataFrame:
    """(snapshot_id, method, block_id): headings with `least_words` words before the next heading, first of their text among such."""
    n = F.when(F.col("block_type") != "heading", F.size(F.filter(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != ""))).otherwise(0)
    s = sections(blocks).withColumn("support", F.sum(n).over(W.partitionBy(*DOCUMENT, "section")))
    h = s.where((F.col("block_type") == "heading") & (F.col("support") >= least_words)).withColumn("key", F.lower(F.trim("text")))
    first = F.row_number().over(W.partitionBy(*DOCUMENT, "key").orderBy("block_order", "block_id"))
    return h.withColumn("n", first).where("n = 1").select(*DOCUMENT, "block_id")


def chains(ups: dict[str, str | None], quotes: dict[str, bool]) -> dict[str, tuple[int, str, bool]]:
    """(levels above, topmost block, whether a quote is in the chain) of each block, each followed once."""
    done: dict[str, tuple[int, str, bool]] = {}
    for x in ups:
        path: list[str] = []
        at: dict[str, int] = {}
        while x not in done and x not in at:
            if ups[x] not in ups:
                done[x] = (0, x, quotes[x])
                break
            at[x] = len(path)
            path.append(x)
            x = ups[x]
        if x not in done:
            ring = path[at[x] :]
            quoted = any(quotes[y] for y in ring)
            done |= {y: (len(ring), y, quoted) for y in ring}
            del path[at[x] :]
        for y in reversed(path):
            depth, root, quoted = done[ups[y]]
            done[y] = (depth + 1, root, quoted or quotes[y])
    return done


def _depth_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("snapshot_id", pa.string()), ("method", pa.string()), ("block_id", pa.string()), ("depth", pa.int32()), ("root", pa.string()), ("quoted", pa.bool_())])
    for batch in batches:
        out: list[tuple] = []
        for snapshot, method, blocks in zip(*(batch.column(i).to_pylist() for i in range(3))):
            whole = snapshot is not None and method is not None  # blocks of no document have no parents
            ups = {b["id"]: b["up"] if whole else None for b in blocks if b["id"] is not None}
            found = chains(ups, {b["id"]: b["kind"] == "quote" for b in blocks})
            for b in blocks:
                depth, root, quoted = found.get(b["id"], (0, None, b["kind"] == "quote"))
                out.append((snapshot, method, b["id"], depth, root, quoted or (None if b["kind"] is None else False)))
        columns = list(zip(*out)) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def depths(blocks: DataFrame) -> DataFrame:
    """(snapshot_id, method, block_id, depth, root, quoted): levels above a block, its topmost block and whether a quote holds it.

    Parents are followed inside the document, however deep; a parent that is missing ends the chain, as does
    a circle after as many levels as it has blocks. Block ids are distinct in a document.
    """
    b = F.struct(F.col("block_id").alias("id"), F.col("parent_id").alias("up"), F.col("block_type").alias("kind"))
    whole = blocks.groupBy(*DOCUMENT).agg(F.collect_list(b).alias("blocks"))
    return whole.mapInArrow(_depth_batches, "snapshot_id STRING, method STRING, block_id STRING, depth INT, root STRING, quoted BOOLEAN")


def tree_faults(blocks: DataFrame) -> DataFrame:
    """(fault, n): block ids that repeat, parents that are missing, and parents that come after their child."""
    ids = blocks.groupBy(*DOCUMENT, "block_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("repeated_id").alias("fault"), "n")
    own = distinct_blocks(blocks)
    parent = own.select(*DOCUMENT, F.col("block_id").alias("parent_id"), F.col("block_order").alias("at"))
    j = own.where("parent_id IS NOT NULL").select(*DOCUMENT, "parent_id", "block_order").join(parent, [*DOCUMENT, "parent_id"], "left")
    lost = j.agg(F.count_if(F.col("at").isNull()).alias("n")).select(F.lit("missing_parent").alias("fault"), "n")
    late = j.agg(F.count_if(F.col("at") >= F.col("block_order")).alias("n")).select(F.lit("late_parent").alias("fault"), "n")
    return ids.unionAll(lost).unionAll(late)


def gathered(blocks: DataFrame) -> DataFrame:
    """(snapshot_id, method, blocks): each document's blocks in order, texts trimmed."""
    b = F.struct(F.col("block_order").alias("o"), F.col("block_id").alias("id"), F.col("parent_id").alias("up"), F.col("block_type").alias("kind"), F.trim(F.coalesce("text", F.lit(""))).alias("text"), F.col("heading_level").alias("level"))
    return distinct_blocks(blocks).groupBy(*DOCUMENT).agg(F.array_sort(F.collect_list(b)).alias("blocks"))


def heading_paths(blocks: list[dict]) -> list[list[int]]:
    """For each block the positions of the headings above it, outermost first; a heading stands in its own path."""
    stack: list[tuple[int, int]] = []
    out = []
    for i, b in enumerate(blocks):
        if b["kind"] == "heading":
            level = b["level"] or 1
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, i))
        out.append([i for _, i in stack])
    return out


def chunk_document(blocks: list[dict], target: int) -> list[tuple[int, int]]:
    """Ranges of neighbouring blocks. A range ends where the heading path changes or the next group would pass `target` characters.

    A group is a top-level block with all that it holds, and is never divided; one above the target is a
    chunk by itself. Every block is in exactly one range.
    """
    place = {b["id"]: i for i, b in enumerate(blocks)}
    roots = []
    for i, b in enumerate(blocks):
        up = place.get(b["up"]) if b["up"] else None
        roots.append(roots[up] if up is not None and up < i else i)
    groups: list[list[int]] = []
    for i, r in enumerate(roots):
        if groups and roots[groups[-1][0]] == r:
            groups[-1].append(i)
        else:
            groups.append([i])
    paths = heading_paths(blocks)
    out: list[tuple[int, int]] = []
    start, used = 0, 0
    for g in groups:
        size = sum(len(blocks[i]["text"]) for i in g) + 2 * len(g)
        fresh = paths[g[0]] != paths[g[0] - 1] if g[0] else False
        if g[0] > start and (fresh or used + size > target):
            out.append((start, g[0]))
            start, used = g[0], 0
        used += size
    if blocks:
        out.append((start, len(blocks)))
    return out


_CHUNK = "snapshot_id STRING, method STRING, chunk INT, chunk_id STRING, block_ids ARRAY<STRING>, heading_path ARRAY<STRING>, text STRING, characters INT, oversized BOOLEAN"


def structure_chunks(blocks: DataFrame, target: int = 6000) -> DataFrame:
    """Lossless chunks of each document, with the headings above them; see `chunk_document`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                bs = row["blocks"]
                paths = heading_paths(bs)
                for n, (a, b) in enumerate(chunk_document(bs, target)):
                    ids = [x["id"] for x in bs[a:b]]
                    text = "\n\n".join(x["text"] for x in bs[a:b] if x["text"])
                    out.append((row["snapshot_id"], row["method"], n, stable_hash([row["snapshot_id"], row["method"], target, ids]), ids, [bs[i]["text"] for i in paths[a]], text, len(text), len(text) > target))
            cols = list(zip(*out)) if out else [[]] * 9
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.int32(), pa.bool_())
            names = ["snapshot_id", "method", "chunk", "chunk_id", "block_ids", "heading_path", "text", "characters", "oversized"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return gathered(blocks).mapInArrow(run, _CHUNK)


def chunk_faults(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, and those whose chunks don't give back their blocks in order."""
    ids = gathered(blocks).select(*DOCUMENT, F.transform("blocks", lambda b: b["id"]).alias("want"))
    got = chunks.groupBy(*DOCUMENT).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "block_ids"))), lambda c: c["block_ids"])).alias("got"))
    return ids.join(got, DOCUMENT, "left").agg(F.count(F.lit(1)).alias("documents"), F.count_if(~F.col("want").eqNullSafe(F.col("got"))).alias("faults"))


def anchor_metrics(results: DataFrame, anchors: DataFrame, methods: list[str]) -> DataFrame:
    """Retention and leakage of anchors for each method over all annotated snapshots; a missing or failed result retains nothing.

    anchors: (snapshot_id, kind required|unwanted, anchor). One method's several results of a snapshot count
    by the longest text. Micro rates are over anchors, macro rates over snapshots; a snapshot without anchors
    of a kind has no rate of it.
    """
    spark = results.sparkSession
    best = results.where("status = 'ok'").groupBy("snapshot_id", "method").agg(F.max_by("text", F.length("text")).alias("text"), F.min("runtime_ms").alias("ms"))
    grid = anchors.select("snapshot_id").distinct().crossJoin(F.broadcast(spark.createDataFrame([(m,) for m in methods], "method STRING")))  # a few methods
    norm = lambda c: F.lower(F.regexp_replace(F.trim(F.col(c)), r"\s+", " "))
    x = grid.join(anchors.distinct(), "snapshot_id").join(best, ["snapshot_id", "method"], "left").withColumn("hit", F.coalesce(F.contains(norm("text"), norm("anchor")), F.lit(False)))
    each = x.groupBy("snapshot_id", "method", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"), F.max(F.col("text").isNotNull()).alias("there"))
    is_ = lambda k, v: F.sum(F.when(F.col("kind") == k, F.col(v)))
    macro = lambda k: F.avg(F.when(F.col("kind") == k, F.col("hits") / F.col("n")))
    return each.groupBy("method").agg(
        F.countDistinct("snapshot_id").alias("snapshots"), F.countDistinct(F.when(~F.col("there"), F.col("snapshot_id"))).alias("failures"),
        is_("required", "hits").alias("retained"), is_("required", "n").alias("required"), is_("unwanted", "hits").alias("leaked"), is_("unwanted", "n").alias("unwanted"),
        F.round(macro("required"), 6).alias("macro_retention"), F.round(macro("unwanted"), 6).alias("macro_leakage"),
    )


def latency(results: DataFrame) -> DataFrame:
    """(method, status, n, median_ms, p95_ms)."""
    q = F.percentile("runtime_ms", F.array(F.lit(0.5), F.lit(0.95)))
    return results.groupBy("method", "status").agg(F.count(F.lit(1)).alias("n"), q.alias("q")).select("method", "status", "n", F.round(F.col("q")[0], 6).alias("median_ms"), F.round(F.col("q")[1], 6).alias("p95_ms"))


def agreement(results: DataFrame) -> DataFrame:
    """(snapshot_id, method_a, method_b, agreement): words two candidates share over words either has, as multisets."""
    best = results.where("text IS NOT NULL").groupBy("snapshot_id", "method").agg(F.max_by("text", F.length("text")).alias("text"))
    counted = best.select("snapshot_id", "method", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), 0)).alias("w")).groupBy("snapshot_id", "method", "w").agg(F.count(F.lit(1)).alias("n"))
    sizes = counted.groupBy("snapshot_id", "method").agg(F.sum("n").alias("size"))
    a, b = counted.select("snapshot_id", F.col("method").alias("method_a"), "w", F.col("n").alias("na")), counted.select("snapshot_id", F.col("method").alias("method_b"), "w", F.col("n").alias("nb"))
    both = a.join(b, ["snapshot_id", "w"]).where("method_a < method_b").groupBy("snapshot_id", "method_a", "method_b").agg(F.sum(F.least("na", "nb")).alias("common"))
    sa, sb = sizes.select("snapshot_id", F.col("method").alias("method_a"), F.col("size").alias("sa")), sizes.select("snapshot_id", F.col("method").alias("method_b"), F.col("size").alias("sb"))
    pairs = sa.join(sb, "snapshot_id").where("method_a < method_b").join(both, ["snapshot_id", "method_a", "method_b"], "left").withColumn("common", F.coalesce("common", F.lit(0)))
    return pairs.select("snapshot_id", "method_a", "method_b", F.round(F.col("common") / (F.col("sa") + F.col("sb") - F.col("common")), 6).alias("agreement"))


RETENTION = {"html": "conservative_dom", "markdown": "markdown_text", "text": "markdown_text"}
AGREE = 0.65  # of the words of two independent candidates, from which one may be proposed


def _usable(results: DataFrame, method: str) -> DataFrame:
    """(snapshot_id, text) of a method's successful results that aren't blank, the longest of each snapshot."""
    good = results.where((F.col("method") == method) & (F.col("status") == "ok") & F.col("text").rlike(r"(?U)\S"))
    return good.groupBy("snapshot_id").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text"))


def _no_source() -> Column:
    payload, body = (F.coalesce(c, F.lit("")) for c in ("payload", "body_text"))
    return (F.lower(F.trim(payload)) == "not-implemented") | ~body.rlike(r"(?U)\S")


def select_candidates(sources: DataFrame, results: DataFrame) -> DataFrame:
    """(snapshot_id, status, method): retention first.

    sources: (snapshot_id, format, payload, body_text, quality_flags). The one preferred method of a format is taken or
    none: without its text a snapshot needs review, as does one with flags. Nothing else stands in for it.
    """
    preferred = F.create_map(*[F.lit(x) for pair in RETENTION.items() for x in pair])[F.col("format")]
    ready = _usable(results, "conservative_dom").select("snapshot_id", F.lit("conservative_dom").alias("method"))
    ready = ready.unionAll(_usable(results, "markdown_text").select("snapshot_id", F.lit("markdown_text").alias("method")))
    x = sources.withColumn("preferred", preferred).join(ready.withColumnRenamed("method", "preferred").withColumn("there", F.lit(True)), ["snapshot_id", "preferred"], "left")
    status = F.when(F.col("preferred").isNull(), "unsupported_format").when(_no_source(), "source_insufficient").when(F.col("there").isNull() | (F.size("quality_flags") > 0), "needs_review").otherwise("selected")
    return x.withColumn("status", status).select("snapshot_id", "status", F.when(F.col("there") & F.col("status").isin("selected", "needs_review"), F.col("preferred")).alias("method"))


def select_by_agreement(sources: DataFrame, results: DataFrame, least: float = AGREE) -> DataFrame:
    """(snapshot_id, status, method, agreement): precision first, by the agreement of two independent candidates.

    Native formats keep their own text. A page that may report an error, or whose candidates differ too much, needs review.
    Readability's text is taken for code and spanning tables, otherwise trafilatura's.
    """
    agreed = agreement(results.where("method IN ('readability', 'trafilatura') AND status = 'ok'")).where("method_a = 'readability' AND method_b = 'trafilatura'").select("snapshot_id", "agreement")
    native = _usable(results, "markdown_text").select("snapshot_id", F.lit(True).alias("native"))
    both = _usable(results, "readability").select("snapshot_id").join(_usable(results, "trafilatura").select("snapshot_id"), "snapshot_id").withColumn("both", F.lit(True))
    x = sources.join(native, "snapshot_id", "left").join(both, "snapshot_id", "left").join(agreed, "snapshot_id", "left")
    complex_ = F.coalesce("payload", F.lit("")).rlike(r"(?i)<pre\b|<(?:th|td)\b[^>]*(?:rowspan|colspan)\s*=")
    is_native, html = F.col("format").isin("markdown", "text"), F.col("format") == "html"
    share = F.when(F.col("both"), F.coalesce("agreement", F.lit(0.0)))
    open_ = html & F.col("both") & ~F.array_contains("quality_flags", "possible_error_response")
    method = F.when(is_native & F.col("native"), "markdown_text").when(open_ & (share >= least), F.when(complex_, "readability").otherwise("trafilatura"))
    x = x.withColumn("method", F.when(~_no_source(), method))
    status = F.when(_no_source(), "source_insufficient").when(F.col("method").isNotNull(), "selected").when(is_native | html, "needs_review").otherwise("unsupported_format")
    return x.select("snapshot_id", status.alias("status"), "method", F.when(~_no_source() & open_, share).alias("agreement"))
