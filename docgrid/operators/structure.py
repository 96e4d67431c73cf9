"""Lines to sections, paragraph blocks and section runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrid.config import DEFAULT


def page_texts(raw: DataFrame) -> DataFrame:
    """(document_id, page, page_text) of raw texts with a form feed between pages; one blank last page is dropped."""
    pages = F.split("text", "\f", -1)
    blank = F.trim(F.regexp_replace(F.element_at("_p", -1), r"(?U)\s", "")) == ""
    kept = F.when(blank, F.slice("_p", 1, F.size("_p") - 1)).otherwise(F.col("_p"))
    cut = raw.withColumn("_p", pages).select("document_id", F.posexplode(kept).alias("page", "page_text"))
    return cut.withColumn("page", F.col("page") + 1)


def page_lines(pages: DataFrame) -> DataFrame:
    """(document_id, page, ln, line) of page texts."""
    return pages.select("document_id", "page", F.posexplode(F.split("page_text", "\n", -1)).alias("ln", "line"))


def section_header(line: Column, header: str = DEFAULT.header) -> Column:
    """The label of a header line, white space collapsed; null for any other line."""
    found = F.regexp_extract(line, header, 1)
    return F.when(found != "", F.trim(F.regexp_replace(found, r"(?U)\s+", " ")))


def _order(df: DataFrame) -> Window:
    return Window.partitionBy("document_id").orderBy("page", "ln")


def line_sections(lines: DataFrame, header: str = DEFAULT.header) -> DataFrame:
    """``lines`` with ``section``: the label of the latest header up to the line, null before the first."""
    w = _order(lines).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("_h", section_header(F.col("line"), header)).withColumn("section", F.last("_h", ignorenulls=True).over(w)).drop("_h")


def blocks(lines: DataFrame, header: str = DEFAULT.header) -> DataFrame:
    """(document_id, block, page, section, text): paragraphs of lines between blank lines, pages and changes of section."""
    s = line_sections(lines, header).filter(F.length(F.regexp_replace("line", r"(?U)\s", "")) > 0)
    w = _order(s)
    new = (
        F.lag("page").over(w).isNull()
        | (F.lag("page").over(w) != F.col("page"))
        | (F.lag("ln").over(w) != F.col("ln") - 1)
        | ~F.lag("section").over(w).eqNullSafe(F.col("section"))
    )
    s = s.withColumn("_new", new.cast("int")).withColumn("block", (F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", "line"))), lambda x: x["line"]), "\n")
    return s.groupBy("document_id", "block", "page", "section").agg(F.regexp_replace(joined, r"(?U)^\s+|\s+$", "").alias("text"))


def paragraph_blocks(paragraphs: DataFrame, header: str = DEFAULT.header) -> DataFrame:
    """The same of documents without pages: each (document_id, ln, line) that is not blank is a block with a null page."""
    s = line_sections(paragraphs.withColumn("page", F.lit(None).cast("int")), header)
    s = s.withColumn("line", F.regexp_replace("line", r"(?U)^\s+|\s+$", "")).filter("line <> ''")
    w = Window.partitionBy("document_id").orderBy("ln")
    return s.select("document_id", (F.row_number().over(w) - 1).cast("int").alias("block"), "page", "section", F.col("line").alias("text"))


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("document_id").agg(F.max("page").cast("int").alias("page_count"))


def section_runs(block_rows: DataFrame) -> DataFrame:
    """Blocks with ``run``: the number of the stretch of equal sections; a section that comes back is a new run."""
    w = Window.partitionBy("document_id").orderBy("block")
    change = (F.row_number().over(w) > 1) & ~F.lag("section").over(w).eqNullSafe(F.col("section"))
    marked = block_rows.withColumn("_c", change.cast("int"))
    return marked.withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_c")
