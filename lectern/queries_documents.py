"""Registered queries: documents, chunks, contents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.catalog import register
from lectern.operators import alignment, documents
from lectern.session import ship
from lectern.sources.tables import read_table as t


def books(spark, sf_dir):
    """Pages grouped to books of five."""
    ship(spark)
    p = t(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 5).cast("long").alias("book"), (F.col("page_id") % 5 + 1).cast("int").alias("page"), "html")
    return documents.assemble_pages(p, "book", "page")


@register("""SELECT CAST(page_id // 5 AS BIGINT) AS book, string_agg('<section data-page="' || CAST(page_id % 5 + 1 AS VARCHAR) || '">' || html || '</section>', '' ORDER BY page_id) AS html, CAST(count(*) AS INT) AS pages FROM pages GROUP BY 1""")
def assembled_pages(spark, sf_dir):
    return books(spark, sf_dir).select("book", "html", "pages")


@register()
def html_chunks(spark, sf_dir):
    return documents.chunk_documents(books(spark, sf_dir), "book", "html", 60)


@register()
def html_toc(spark, sf_dir):
    b = books(spark, sf_dir).withColumn("html", F.regexp_replace(F.regexp_replace("html", "<ul>", '<ul class="toc">'), "</li>", " 12</li>\n"))
    return documents.extract_toc(b, "book")


@register()
def toc_alignment(spark, sf_dir):
    """Contents made of the pages' headings, aligned with the chunks they come from."""
    chunks = documents.chunk_documents(books(spark, sf_dir), "book", "html", 60).where("chapter is not null")
    first = chunks.groupBy("book", "chapter").agg(F.min("ordinal").alias("at"), F.min("page_start").alias("printed_page"))
    from pyspark.sql import Window

    toc = first.select("book", F.row_number().over(Window.partitionBy("book").orderBy("at")).alias("ordinal"), F.col("chapter").alias("title"), F.lit(1).alias("level"), "printed_page")
    none = toc.select("book", "printed_page", F.lit(0).alias("document_page")).limit(0)
    return alignment.align_revisions(toc, chunks, none, "book")


@register("""SELECT doc_id, document_page, printed_page FROM (SELECT doc_id, CAST(doc_id % 40 + 1 AS INT) AS document_page, CAST(n_chars % 400 + 1 AS INT) AS printed_page FROM documents)""")
def printed_pages(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    e = d.select("doc_id", (F.col("doc_id") % 40 + 1).cast("int").alias("document_page"), F.lit("Footer").alias("category"), F.concat(F.lit("Book of things "), (F.col("n_chars") % 400 + 1).cast("string")).alias("text"), F.lit(0.9).alias("center_x"))
    return documents.printed_pages(e, "doc_id")


@register("""SELECT doc_id, string_agg('<p>' || trim(line) || '</p>', '' ORDER BY i) AS html FROM (SELECT doc_id, unnest(string_split(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
WHERE trim(line) <> '' AND NOT regexp_matches(trim(line), '^(#{1,6}|[-*])\\s') GROUP BY 1""".replace("\\\\", "\\"))
def markdown_paragraphs(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "text")
    plain = F.array_join(F.filter(F.split("text", "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(r"^(#{1,6}|[-*])\s")), "\n")
    return d.select("doc_id", documents.markdown_as_html(plain).alias("html")).where("html <> ''")


@register("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' END AS mime FROM documents""")
def sniffed_files(spark, sf_dir):
    from lectern.functions.scalars import mime_of

    head = F.when(F.col("doc_id") % 3 == 0, F.lit("%PDF-1.7").cast("binary")).when(F.col("doc_id") % 3 == 1, F.unhex(F.lit("89504E470D0A1A0A0000"))).otherwise(F.col("text").cast("binary"))
    return t(spark, sf_dir, "documents").select("doc_id", mime_of(head).alias("mime"))


@register("""WITH c AS (SELECT user_id AS book, event_id AS ordinal, CASE event_id % 5 WHEN 0 THEN '1. Heat' WHEN 1 THEN 'HEAT' WHEN 2 THEN 'Light' END AS chapter, CASE event_id % 5 WHEN 0 THEN 'heat' WHEN 1 THEN 'heat' WHEN 2 THEN 'light' END AS k,
  CASE WHEN event_id % 3 = 0 THEN 'u' || CAST(event_id % 7 AS VARCHAR) END AS unit FROM events),
a AS (SELECT *, last_value(chapter IGNORE NULLS) OVER w AS carried, CASE WHEN k <> coalesce(last_value(k IGNORE NULLS) OVER (PARTITION BY book ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') THEN 1 ELSE 0 END AS new
  FROM c WINDOW w AS (PARTITION BY book ORDER BY ordinal ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, sum(new) OVER (PARTITION BY book ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS run FROM a)
SELECT book, ordinal, carried AS chapter, last_value(unit IGNORE NULLS) OVER (PARTITION BY book, run ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS unit FROM r""")
def carried_toc_headings(spark, sf_dir):
    ship(spark)
    k = F.col("event_id")
    chapter = F.when(k % 5 == 0, " 1. Heat ").when(k % 5 == 1, "HEAT").when(k % 5 == 2, "Light").when(k % 5 == 3, "  ")
    unit = F.when(k % 3 == 0, F.concat(F.lit(" u"), (k % 7).cast("string")))
    e = t(spark, sf_dir, "events").select(F.col("user_id").alias("book"), k.alias("ordinal"), chapter.alias("chapter"), unit.alias("unit"))
    return alignment.carried_headings(e, "book")
