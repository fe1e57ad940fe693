"""Feature families of a record: its prompt against its document, as column expressions over one row a record.

A document is profiled once: token arrays for its regions, sections, sentences, table rows and steps. The
profile is joined to its records, and every feature is an expression; nothing is fitted here. A ratio
without a denominator is null, as is coverage of a prompt without content words; features that the later
families define as 0 in that case say so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as x

KINDS = ("heading", "paragraph", "list_item", "table", "code")
PROSE = ("paragraph", "list_item")
# Cues in sentences, and wording of prompts that ask for numbers or definitions.
NUMBER = r"\b\d+(?:[.,]\d+)?\b"
UNIT = r"(?i)(?:\d\s*(?:%|\$|€|£|kg\b|km\b|cm\b|mm\b|hours?\b|minutes?\b|seconds?\b|days?\b|years?\b|mb\b|gb\b|hz\b|watts?\b))|(?:[$€£]\s*\d)"
DEFINITION = r"(?i)\b(?:is|are|means|refers to|defined as|because|therefore)\b"
NUMERIC_INTENT = r"(?i)\b(?:how much|how many|cost|price|percent|size|weight|speed|duration)\b"
DEFINITION_INTENT = r"(?i)\b(?:what is|what are|define|meaning|why)\b"
ARTICLE_TYPES = ("Article", "NewsArticle", "BlogPosting", "TechArticle", "ScholarlyArticle", "Report")
REGIONS = ("body", "title", "description", "path", "headings")
WIDTHS = (10, 25, 50)


def _texts(kind: str) -> Column:
    return F.transform(F.filter("blocks", lambda b: b["block_type"] == kind), lambda b: F.coalesce(b["text"], F.lit("")))


def _joined(texts: Column) -> Column:
    return x.words(F.array_join(texts, " "))


def _sections(blocks: Column) -> Column:
    """Texts of each section: a heading with what follows it, or what stands before the first heading."""
    start = F.array().cast("array<struct<head:string,texts:array<string>>>")

    def step(acc: Column, b: Column) -> Column:
        text = F.coalesce(b["text"], F.lit(""))
        fresh = F.array(F.struct(F.when(b["block_type"] == "heading", text).otherwise("").alias("head"), F.array(text).alias("texts")))
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["head"].alias("head"), F.concat(last["texts"], F.array(text)).alias("texts"))))
        return F.when(b["block_type"] == "heading", F.concat(acc, fresh)).when(text == "", acc).when(F.size(acc) == 0, fresh).otherwise(grown)

    return F.aggregate(blocks, start, step)


def document_profile(documents: DataFrame) -> DataFrame:
    """One row for each document with text: counts, tokens of its regions, sections, prose sentences with marks, long segments, table rows and steps."""
    d = documents.where("status = 'ok'")
    prose = F.filter("blocks", lambda b: b["block_type"].isin(*PROSE))
    parts = F.flatten(F.transform(prose, lambda b: F.transform(F.split(F.coalesce(b["text"], F.lit("")), r"(?<=[.!?。！？])\s+|\n+"), lambda t: F.struct(t.alias("text"), x.words(t).alias("tokens"), (F.size(b["links"]) > 0).alias("linked")))))
    cells = F.flatten(F.transform(F.filter("blocks", lambda b: b["block_type"] == "table"), lambda b: F.transform(b["cells"], lambda c: F.struct(b["block_id"].alias("t"), c["row"].alias("r"), c["text"].alias("x"), c["is_header"].alias("h")))))
    ordered = F.transform(F.filter("blocks", lambda b: b["ordered"]), lambda b: b["block_id"])
    d = d.withColumn("parts", parts).withColumn("cells_", cells).withColumn("lists", ordered)
    rows = F.array_distinct(F.transform(F.filter("cells_", lambda c: ~c["h"]), lambda c: F.struct(c["t"], c["r"])))
    row_texts = F.transform(rows, lambda k: F.array_join(F.transform(F.filter("cells_", lambda c: ~c["h"] & (c["t"] == k["t"]) & (c["r"] == k["r"])), lambda c: c["x"]), " "))
    size = lambda kind: F.size(_texts(kind))
    inv = F.col("inventory")
    return d.select(
        "snapshot_id", "href", "format", F.coalesce(inv["title"], F.lit("")).alias("title"), F.coalesce(inv["description"], F.lit("")).alias("description_text"), inv["json_ld"].alias("json_ld"), F.coalesce(inv["scripts"], F.lit(0)).alias("scripts"),
        F.coalesce(inv["visible_words"], F.lit(0)).alias("source_words"), x.normalized_tokens(F.array_join(F.transform("blocks", lambda b: F.coalesce(b["text"], F.lit(""))), " ")).alias("body_normal"), x.normalized_tokens(F.coalesce(inv["title"], F.lit(""))).alias("title_normal"), _joined(F.transform("blocks", lambda b: F.coalesce(b["text"], F.lit("")))).alias("body"), _joined(_texts("heading")).alias("headings"), _texts("heading").alias("heading_texts"),
        _joined(F.transform(F.filter("blocks", lambda b: (b["block_type"] == "heading") & (b["heading_level"] == 1)), lambda b: b["text"])).alias("h1"), F.size(F.filter("blocks", lambda b: b["heading_level"] == 1)).alias("h1_count"),
        _joined(F.transform(F.filter("cells_", lambda c: c["h"]), lambda c: c["x"])).alias("table_headers"), F.transform(_sections(F.col("blocks")), lambda s: F.struct(x.words(s["head"]).alias("head"), _joined(s["texts"]).alias("tokens"))).alias("sections"),
        F.transform(_texts("paragraph"), lambda t: F.size(x.words(t))).alias("paragraph_words"), *[size(k).alias(f"n_{k}") for k in (*KINDS, "list")],
        *[F.size(_joined(_texts(k))).alias(f"w_{k}") for k in KINDS], F.aggregate("blocks", F.lit(0), lambda n, b: n + F.size(b["links"])).alias("n_links"),
        F.filter("parts", lambda p: F.size(p["tokens"]).between(6, 80)).alias("prose"), F.array_distinct(F.transform(F.filter("parts", lambda p: F.size(p["tokens"]) > 80), lambda p: p["tokens"])).alias("long_prose"),
        F.transform(F.filter(F.array_distinct(row_texts), lambda t: F.size(x.words(t)) > 0), lambda t: F.struct(x.words(t).alias("tokens"), t.rlike(NUMBER).alias("number"))).alias("rows_"),
        F.filter(F.array_distinct(F.transform(F.filter("blocks", lambda b: (b["block_type"] == "list_item") & F.array_contains("lists", b["parent_id"])), lambda b: x.words(F.coalesce(b["text"], F.lit(""))))), lambda t: F.size(t) > 0).alias("steps"),
        F.size(F.filter("blocks", lambda b: (b["block_type"] == "list_item") & F.array_contains("lists", b["parent_id"]))).alias("ordered_steps"),
    )


def _says(pattern: str):
    return lambda p: p["text"].rlike(pattern)


def _count_in(tokens: Column):
    return lambda w: F.size(F.filter(tokens, lambda v: v == w))


def _at_least(limit: float):
    return lambda s: s >= limit


def _window(query: Column, width: int):
    return lambda tokens: x.window_coverage(query, tokens, width)


def _most(array: Column) -> Column:
    return F.coalesce(F.array_max(array), F.lit(0.0))


def _mean(array: Column) -> Column:
    """Mean of an array; null without elements."""
    return F.when(F.size(array) > 0, F.aggregate(array, F.lit(0.0), lambda s, v: s + v) / F.size(array))


def _top3(array: Column) -> Column:
    return F.coalesce(_mean(F.slice(F.sort_array(array, asc=False), 1, 3)), F.lit(0.0))


def _share(array: Column, test) -> Column:
    return F.size(F.filter(array, test)) / F.greatest(F.lit(1), F.size(array))


def _quantile(ints: Column, p: float) -> Column:
    """Quantile of an array with linear interpolation; null without elements."""
    o = F.sort_array(ints)
    at = (F.size(ints) - 1) * F.lit(p)
    low = F.floor(at).cast("int")
    a, b = F.element_at(o, low + 1), F.element_at(o, F.least(low + 2, F.size(ints)))
    return F.when(F.size(ints) > 0, a + (at - low) * (b - a))


def feature_table(records: DataFrame, profiles: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """raw_id and its features, for `records` (raw_id, snapshot_id, prompt) that have a document and a prompt."""
    path = F.regexp_replace(F.lower(x.url_path(F.col("href"))), r"[-_]", " ")
    r = records.where("prompt IS NOT NULL").join(profiles, "snapshot_id")
    r = r.withColumn("q_all", F.array_distinct(x.words(F.col("prompt")))).withColumn("q_list", x.words(F.col("prompt"))).withColumn("q", x.content_words(F.col("prompt")))
    r = r.withColumn("title_tokens", x.words(F.col("title"))).withColumn("path_tokens", x.words(path)).withColumn("description_tokens", x.words(F.col("description_text"))).withColumn("n_words", F.size("body"))
    q, qa, body = F.col("q"), F.col("q_all"), F.col("body")
    cov = lambda t: x.coverage(q, t)
    cov0 = lambda t: x.coverage_or_zero(q, t)
    covq = lambda t: F.size(F.array_intersect(qa, t)) / F.greatest(F.lit(1), F.size(qa))
    int_ = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    log = lambda c: F.log1p(c.cast("double"))
    r = r.withColumn("scores", F.transform("sections", lambda s: covq(s["tokens"]))).withColumn("section_cov", F.transform("sections", lambda s: cov(s["tokens"])))
    r = r.withColumn("sent_scores", F.transform("prose", lambda p: cov0(p["tokens"]))).withColumn("relevant", F.filter("prose", lambda p: (F.size(q) > 0) & (cov0(p["tokens"]) >= 0.5)))
    r = r.withColumn("row_scores", F.transform("rows_", lambda t: cov0(t["tokens"]))).withColumn("number_scores", F.transform(F.filter("rows_", lambda t: t["number"]), lambda t: cov0(t["tokens"]))).withColumn("step_scores", F.transform("steps", cov0))
    kept = F.zip_with("section_cov", F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("section_cov") - 1)), lambda c, i: F.struct(c.alias("c"), (-i).alias("i")))
    r = r.withColumn("best", F.array_max(F.filter(kept, lambda k: k["c"].isNotNull())))
    prompt, hrefp = F.col("prompt"), F.lower(x.url_path(F.col("href")))
    out: dict[str, Column] = {
        # prompt and address
        "log_prompt_words": log(F.size("q_list")), "prompt_question": int_(x.prompt_is_question(prompt)), "prompt_comparison": int_(x.prompt_is_comparison(prompt)), "prompt_how_to": int_(x.prompt_is_how_to(prompt)),
        "path_depth": x.path_depth(F.col("href")), "path_homepage": int_(hrefp.isin("", "/")), **{f"path_{n}": int_(hrefp.rlike(x.PATH_CLASSES[n])) for n in ("editorial", "commerce", "support_docs")},
        # alignment of the whole document
        "coverage_title": cov(F.col("title_tokens")), "coverage_headings": cov(F.col("headings")), "coverage_body": cov(body), "coverage_intro": cov(F.slice(body, 1, 200)), "coverage_url_path": cov(F.col("path_tokens")),
        # sizes and structure
        "log_word_count": log(F.col("n_words")), "log_title_words": log(F.size("title_tokens")), "log_heading_count": log(F.col("n_heading")), "log_h1_count": log(F.col("h1_count")), "log_list_items": log(F.col("n_list_item")), "log_table_count": log(F.col("n_table")),
        "log_paragraph_count": log(F.col("n_paragraph")), "log_code_count": log(F.col("n_code")), "log_ordered_steps": log(F.col("ordered_steps")),
        "headings_per_1000_words": x.ratio(F.col("n_heading"), F.col("n_words"), 1000.0), "list_items_per_1000_words": x.ratio(F.col("n_list_item"), F.col("n_words"), 1000.0), "has_table": int_(F.col("n_table") > 0), "has_list": int_(F.col("n_list") > 0),
        "has_jsonld": int_(F.size("json_ld") > 0), "has_article_schema": int_(F.exists("json_ld", lambda t: F.substring_index(t, "/", -1).isin(*ARTICLE_TYPES))), "log_source_script_count": log(F.col("scripts")), "empty_title": int_(F.trim("title") == ""),
        "retained_text_fraction": F.least(F.lit(1.0), x.ratio(F.col("n_words"), F.col("source_words"))), "sparse_body": int_(F.col("n_words") <= 30), "format_html": int_(F.col("format") == "html"),
        # sections
        "coverage_h1": cov(F.col("h1")), "coverage_table_headers": cov(F.col("table_headers")), "best_section_coverage": F.col("best")["c"], "mean_section_coverage": _mean(F.filter("section_cov", lambda c: c.isNotNull())),
        "matching_section_fraction": F.when(F.size(q) > 0, x.ratio(F.size(F.filter("section_cov", lambda c: c > 0)), F.size("section_cov"))), "best_section_heading_coverage": F.when(F.col("best").isNotNull(), cov(F.get(F.col("sections"), -F.col("best")["i"])["head"])),
        "best_section_position": -F.col("best")["i"] / F.greatest(F.lit(1), F.size("section_cov") - 1), "comparison_x_table_header_coverage": int_(x.prompt_is_comparison(prompt)) * cov(F.col("table_headers")), "how_to_x_ordered_steps": int_(x.prompt_is_how_to(prompt)) * log(F.col("ordered_steps")),
    }
    tokens = dict(zip(REGIONS, (body, F.col("title_tokens"), F.col("description_tokens"), F.col("path_tokens"), F.col("headings"))))
    qb = F.array_distinct(x.bigrams(F.col("q_list")))
    for region, t in tokens.items():
        distinct = F.array_distinct(t)
        hits = F.size(F.array_intersect(qa, distinct))
        out[f"{region}_query_precision"] = hits / F.greatest(F.lit(1), F.size(distinct))
        out[f"{region}_query_dice"] = x.dice(qa, distinct)
        tf = F.transform(qa, _count_in(t))
        out[f"{region}_query_saturated_tf"] = F.aggregate(tf, F.lit(0.0), lambda s, c: s + c / (c + 2)) / F.greatest(F.lit(1), F.size(qa))
        out[f"{region}_query_bigram"] = F.size(F.array_intersect(qb, x.bigrams(t))) / F.greatest(F.lit(1), F.size(qb))
    for t in (0.5, 0.8, 1.0):
        out[f"section_coverage_fraction_{str(t).replace('.', '_')}"] = _share(F.col("scores"), _at_least(t))
    mean = F.coalesce(_mean(F.col("scores")), F.lit(0.0))
    first = F.array_min(F.transform(qa, lambda w: F.nullif(F.array_position(body, w), F.lit(0))))
    argbest = F.array_position(F.col("scores"), F.array_max("scores"))
    matches = F.size(F.filter(body, lambda w: F.array_contains(qa, w)))
    out |= {
        "section_coverage_std": F.sqrt(F.coalesce(_mean(F.transform("scores", lambda s: (s - mean) * (s - mean))), F.lit(0.0))), "top_three_section_coverage": _top3(F.col("scores")),
        "best_section_log_words": F.coalesce(log(F.size(F.get(F.col("sections"), (argbest - 1).cast("int"))["tokens"])), F.lit(0.0)), "first_query_match_position": F.coalesce((first - 1) / F.greatest(F.lit(1), F.col("n_words")), F.lit(1.0)),
        "query_match_density": matches / F.greatest(F.lit(1), F.col("n_words")), "paragraph_log_median_words": F.coalesce(F.log1p(_quantile(F.col("paragraph_words"), 0.5)), F.lit(0.0)), "paragraph_log_p90_words": F.coalesce(F.log1p(_quantile(F.col("paragraph_words"), 0.9)), F.lit(0.0)),
        "short_paragraph_fraction": _share(F.col("paragraph_words"), lambda n: n.between(10, 60)), "unique_word_fraction": F.size(F.array_distinct(body)) / F.greatest(F.lit(1), F.col("n_words")), "numeric_word_fraction": _share(body, lambda w: w.rlike(r"\p{Nd}")),
        "question_heading_fraction": _share(F.col("heading_texts"), lambda h: h.contains("?")), "duplicate_heading_fraction": F.when(F.size("heading_texts") > 0, 1 - F.size(F.array_distinct(F.transform("heading_texts", F.lower))) / F.size("heading_texts")).otherwise(0.0),
        "log_link_count": log(F.col("n_links")), "links_per_1000_words": 1000 * F.col("n_links") / F.greatest(F.lit(1), F.col("n_words")), **{f"{k}_word_fraction": F.least(F.lit(1.0), F.col(f"w_{k}") / F.greatest(F.lit(1), F.col("n_words"))) for k in KINDS},
    }
    rel = F.col("relevant")
    # Answers and evidence in prose.
    out |= {
        "answer_best_sentence_coverage": _most(F.col("sent_scores")), "answer_top3_sentence_coverage": _top3(F.col("sent_scores")), "answer_relevant_sentence_fraction": F.size(rel) / F.greatest(F.lit(1), F.size("prose")), "answer_log_relevant_sentences": log(F.size(rel)),
        "answer_best_sentence_precision": _most(F.transform("prose", lambda p: F.size(F.array_intersect(q, p["tokens"])) / F.size(F.array_distinct(p["tokens"])))), "answer_relevant_median_words": F.coalesce(F.log1p(_quantile(F.transform(rel, lambda p: F.size(p["tokens"])), 0.5)), F.lit(0.0)),
        **{f"answer_window_{w}_coverage": _most(F.transform(F.transform("prose", lambda p: p["tokens"]), _window(q, w))) for w in WIDTHS}, "answer_relevant_union_coverage": cov0(F.array_distinct(F.flatten(F.transform(rel, lambda p: p["tokens"])))),
    }
    for name, pattern in (("number", NUMBER), ("unit", UNIT), ("definition", DEFINITION)):
        marked = F.filter(rel, _says(pattern))
        out[f"evidence_{name}_fraction"] = F.size(marked) / F.greatest(F.lit(1), F.size(rel))
        out[f"evidence_{name}_coverage"] = _most(F.transform(marked, lambda p: cov0(p["tokens"])))
    numeric, define = int_(prompt.rlike(NUMERIC_INTENT)), int_(prompt.rlike(DEFINITION_INTENT))
    out |= {
        "evidence_linked_fraction": _share(rel, lambda p: p["linked"]), "evidence_numeric_intent_alignment": numeric * out["evidence_number_coverage"], "evidence_definition_intent_alignment": define * out["evidence_definition_coverage"],
        "table_best_value_row_coverage": _most(F.col("row_scores")), "table_top3_value_row_coverage": _top3(F.col("row_scores")), "table_relevant_row_fraction": F.when(F.size(q) > 0, _share(F.col("row_scores"), lambda s: s >= 0.5)).otherwise(0.0), "table_numeric_row_coverage": _most(F.col("number_scores")),
        "table_header_best_coverage": cov0(F.col("table_headers")), "table_numeric_intent_alignment": numeric * _most(F.col("number_scores")), "steps_best_coverage": _most(F.col("step_scores")), "steps_relevant_fraction": F.when(F.size(q) > 0, _share(F.col("step_scores"), lambda s: s >= 0.5)).otherwise(0.0),
        "steps_howto_alignment": int_(x.prompt_is_how_to(prompt)) * _most(F.col("step_scores")),
        **{f"long_window_{w}_best": _most(F.transform("long_prose", _window(q, w))) for w in WIDTHS}, **{f"long_window_{w}_mean": F.coalesce(_mean(F.transform("long_prose", _window(q, w))), F.lit(0.0)) for w in WIDTHS},
    }
    support = out["answer_best_sentence_coverage"]
    for name in ("coverage_title", *[f"{g}_query_{m}" for g in ("title", "path") for m in ("precision", "dice", "saturated_tf", "bigram")]):
        out[f"supported_{name}"] = out[name] * support
    # The same after numbers, units, currencies and plurals are brought to one form.
    stop = F.array(*[F.lit(w) for w in x.STOPWORDS])
    r = r.withColumn("nq", F.array_except(F.array_distinct(x.normalized_tokens(prompt)), stop)).withColumn("path_normal", x.normalized_tokens(path))
    for region, literal in (("title", "title_tokens"), ("path", "path_tokens"), ("body", "body")):
        out[f"normalized_{region}_coverage"] = x.coverage_or_zero(F.col("nq"), F.col(f"{region}_normal"))
        out[f"normalized_{region}_gain"] = out[f"normalized_{region}_coverage"] - cov0(F.col(literal))
    numbers = F.filter("nq", lambda w: w.rlike(r"^\d+(?:\.\d+)?$"))
    out["normalized_number_coverage"] = x.coverage_or_zero(numbers, F.col("body_normal"))
    for name in ("normalized_title_coverage", "normalized_title_gain", "normalized_path_coverage", "normalized_path_gain"):
        out[f"supported_{name}"] = out[name] * support
    return r.select("raw_id", *[F.round(c.cast("double"), 9).alias(n) for n, c in out.items()])


FAMILIES = {
    "prompt": ("log_prompt_words", "prompt_question", "prompt_comparison", "prompt_how_to"),
    "url": ("path_depth", "path_homepage", "path_editorial", "path_commerce", "path_support_docs"),
    "alignment": ("coverage_title", "coverage_headings", "coverage_body", "coverage_intro", "coverage_url_path"),
    "sections": ("coverage_h1", "coverage_table_headers", "best_section_coverage", "mean_section_coverage", "matching_section_fraction", "best_section_heading_coverage", "best_section_position"),
    "structure": ("headings_per_1000_words", "list_items_per_1000_words", "has_table", "has_list"),
}


def dependency(name: str) -> str:
    """What a feature depends on: prompt, doc or promptXdoc."""
    if name.startswith(("prompt_", "log_prompt")):
        return "prompt"
    crossed = ("coverage", "_query_", "answer_", "evidence_", "steps_", "table_best", "table_top3", "table_rel", "table_num", "query_match", "best_section", "matching_section", "top_three", "comparison_x", "how_to_x", "supported_", "window")
    return "promptXdoc" if any(c in name for c in crossed) else "doc"


def context_features(features: DataFrame) -> DataFrame:
    """The features that need no match of prompt and document, in a fixed order."""
    names = [c for c in features.columns if c != "raw_id" and dependency(c) in ("prompt", "doc")]
    return features.select("raw_id", *names)
