"""Lines of plain texts and of web pages, with the structure labels that a page declares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lines as ln

#: blocks of a page and the label their lines get
BLOCKS = (("title|h[1-6]", ln.HEADING), ("li", ln.CONTENTS), ("td|th", ln.TABLE), ("figcaption|caption", ln.CAPTION), ("div|footer|aside|header", ln.TEXT_BOX))
#: fixed values: named characters
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))


def html_lines(html: Column) -> Column:
    """Array of lines: a line for each block, labelled where the block says what it is; scripts, styles and comments go."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"\s+", " ")
    for names, label in BLOCKS:
        text = F.regexp_replace(text, rf"(?i)<(?:{names})(?:\s[^>]*)?>", f"\n{ln.OPEN}{label}{ln.CLOSE}")
    text = F.regexp_replace(text, r"(?i)<(?:p|br|tr|ul|ol|table|article|section|main|nav|body)(?:\s[^>]*)?/?>|</(?:title|h[1-6]|li|td|th|div|footer|aside|header|p|tr|article|section|nav)\s*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.filter(F.split(text, "\n"), lambda x: F.trim(ln.without_labels(x)) != "")


def text_lines(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def report_lines(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """kind (document or page), id, lines: the lines of both tables, in the row; a null text has none."""
    none = F.array().cast("array<string>")
    of_documents = documents.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.coalesce(text_lines(F.col("text")), none).alias("lines"))
    return of_documents.union(pages.select(F.lit("page"), "page_id", F.coalesce(html_lines(F.col("html")), none)))
