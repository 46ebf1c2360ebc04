"""Pages: merging deliveries, planning the vision calls and putting the replies in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions.text import clean_text, figure_lines, grade, trim_unicode

# What makes an image a figure and a page visual.
FIGURE_AREA, REPEATED_PAGES, FIGURE_CONTRAST, VISUAL_PATHS, MOST_VISION_PAGES = 0.08, 3, 18.0, 50, 60


def merge_pages(pages: DataFrame, tie: str = "row_id") -> DataFrame:
    """One row per source and page: the texts in order of ``ord``, joined by an empty line; null texts are left out.

    A page that only has null texts gives an empty text. The deliveries of one page are
    gathered, never those of a source.
    """
    texts = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("ord", F.lit(0)).alias("ord"), F.col(tie).alias("tie"), "text"))), lambda x: x["text"])
    first = F.struct(F.coalesce("ord", F.lit(0)), F.col(tie))
    return pages.groupBy("source_id", "page").agg(F.min_by("notebook_id", first).alias("notebook_id"), F.min_by("source", first).alias("source"), F.array_join(F.filter(texts, lambda t: t.isNotNull()), "\n\n").alias("text"))


def filled(c: Column) -> Column:
    return trim_unicode(F.coalesce(c, F.lit(""))) != ""


def figures(images: DataFrame, paths: DataFrame, group: str = "source_id") -> DataFrame:
    """(group, page, figures, visual) for every page of ``paths`` (group, page, paths).

    ``images``: group, page, image_key, area, contrast (null counts as full). An image on
    three pages or more is decoration; equal images of a page count each.
    """
    large = images.where(F.col("area") >= FIGURE_AREA)
    spread = large.select(group, "page", "image_key").distinct().groupBy(group, "image_key").agg(F.count("*").alias("on_pages"))
    shown = large.join(spread, [group, "image_key"]).where((F.col("on_pages") < REPEATED_PAGES) & (F.coalesce("contrast", F.lit(255.0)) >= FIGURE_CONTRAST))
    by = shown.groupBy(group, "page").agg(F.count("*").cast("int").alias("figures"))
    out = paths.join(by, [group, "page"], "left").withColumn("figures", F.coalesce("figures", F.lit(0)))
    return out.select(group, "page", "figures", ((F.col("figures") > 0) | (F.coalesce("paths", F.lit(0)) >= VISUAL_PATHS)).alias("visual"))


def plan_vision(pages: DataFrame, budget: int = MOST_VISION_PAGES, group: str = "source_id") -> DataFrame:
    """(group, page, status, kind, truncated): which pages get a call within the budget, worst first.

    ``pages``: group, page, status, figures, visual. Unreadable pages and empty ones that
    show something come first, then damaged ones (both read anew), then readable ones with
    figures (described). truncated tells for the whole group whether the budget left some out.
    """
    budget = max(0, min(budget, MOST_VISION_PAGES))
    status = F.col("status")
    tier = F.when((status == "junk") | (status == "empty") & F.coalesce("visual", F.lit(False)), 0).when(status == "degraded", 1).when((status == "ok") & (F.coalesce("figures", F.lit(0)) > 0), 2)
    rows = pages.withColumn("tier", tier)
    planned = rows.where("tier is not null")
    over = planned.groupBy(group).agg((F.count("*") > budget).alias("truncated"))
    order = F.row_number().over(Window.partitionBy(group).orderBy("tier", "page"))
    taken = planned.withColumn("n", order).where(F.col("n") <= budget).select(group, "page", F.when(F.col("tier") < 2, "ocr").otherwise("describe").alias("kind"))
    out = rows.join(taken, [group, "page"], "left").join(over, group, "left")
    return out.select(group, "page", "status", "kind", F.coalesce("truncated", F.lit(False)).alias("truncated"))


def assemble(pages: DataFrame, prefix: str = "[Figure]", sentinel: str = "no figures") -> DataFrame:
    """Pages (text, kind, reply) with their replies put in: text and method; a missing reply leaves the text alone."""
    lines = figure_lines(F.col("reply"), prefix, sentinel)
    text = F.coalesce("text", F.lit(""))
    read = (F.col("kind") == "ocr") & F.col("reply").isNotNull()
    shown = (F.col("kind") == "describe") & F.col("reply").isNotNull() & (lines != "")
    out = F.when(F.coalesce(read, F.lit(False)), clean_text(F.col("reply"))).when(F.coalesce(shown, F.lit(False)), trim_unicode(F.concat(text, F.lit("\n\n"), lines))).otherwise(text)
    method = F.when(F.coalesce(read, F.lit(False)), "ocr").when(F.coalesce(shown, F.lit(False)), "text+vision").otherwise("text")
    return pages.withColumn("method", method).withColumn("text", out).drop("reply")


def extract(pages: DataFrame, layout: DataFrame, replies: DataFrame, budget: int = MOST_VISION_PAGES, group: str = "source_id") -> DataFrame:
    """Page-wise extraction: texts graded, vision calls planned, replies put in.

    ``pages``: group, page, text; one row a page. ``layout``: group, page, figures, visual
    (a page without a row shows nothing). ``replies``: group, page, reply, one row for a
    page at most; only replies to planned calls count. Gives group, page, status, kind,
    truncated, text, method, images, failed (a planned call without a reply). Unusable
    text layers, junk and empty ones, leave a page without text unless it was read anew.
    """
    keys = [group, "page"]
    graded = grade(pages.select(*keys, "text"), "text", "g").select(*keys, F.when(F.col("g.status").isin("ok", "degraded"), clean_text(F.col("text"))).otherwise("").alias("text"), F.col("g.status").alias("status"))
    rows = graded.join(layout.select(*keys, "figures", "visual"), keys, "left")
    planned = plan_vision(rows.select(*keys, "status", "figures", "visual"), budget, group)
    rows = rows.select(*keys, "text", F.coalesce("figures", F.lit(0)).alias("images")).join(planned, keys).join(replies.select(*keys, "reply"), keys, "left")
    rows = rows.withColumn("reply", F.when(F.col("kind").isNotNull(), F.col("reply")))
    return assemble(rows.withColumn("failed", F.col("kind").isNotNull() & F.col("reply").isNull()))


def extraction_report(extracted: DataFrame, group: str = "source_id") -> DataFrame:
    """(group, pages, method, vision_pages, failed_pages, truncated, all_failed) of extracted pages.

    all_failed: calls were planned, none succeeded and no page has text, so the extraction
    is an error.
    """
    by = extracted.groupBy(group).agg(
        F.count("*").alias("pages"),
        F.count_if(F.col("kind").isNotNull() & ~F.col("failed")).alias("vision_pages"),
        F.count_if("failed").alias("failed_pages"),
        F.bool_or("truncated").alias("truncated"),
        F.count_if(filled(F.col("text"))).alias("with_text"),
    )
    by = by.withColumn("all_failed", (F.col("failed_pages") > 0) & (F.col("vision_pages") == 0) & (F.col("with_text") == 0)).drop("with_text")
    return by.join(document_method(extracted, group), group)


def document_method(pages: DataFrame, group: str = "source_id") -> DataFrame:
    """(group, method): text, ocr or mixed, by the methods of the pages that hold text; none counts as text."""
    rows = pages.withColumn("m", F.when(filled(F.col("text")), F.coalesce("method", F.lit("text"))))
    other = F.count_if(F.col("m") != "text")
    method = F.when(other == 0, "text").when(F.count_if(F.col("m") != "ocr") == 0, "ocr").otherwise("mixed")
    return rows.groupBy(group).agg(method.alias("method"))


def all_failed(pages: DataFrame, group: str = "source_id") -> DataFrame:
    """Groups in which calls were planned, none succeeded and no page has text; their extraction is an error."""
    by = pages.groupBy(group).agg(F.count_if(F.col("kind").isNotNull()).alias("planned"), F.count_if(F.col("kind").isNotNull() & F.col("reply").isNotNull()).alias("done"), F.count_if(filled(F.col("text"))).alias("with_text"))
    return by.where("planned > 0 and done = 0 and with_text = 0").select(group)
