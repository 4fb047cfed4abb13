"""Chunking, contents and alignment on literal inputs."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import alignment as al
from lectern.operators import documents as doc


def page(n, body):
    return f'<section data-page="{n}">{body}</section>'


def chunks_of(spark, html, max_tokens):
    return doc.chunk_documents(spark.createDataFrame([("b", html)], "book string, html string"), "book", "html", max_tokens).orderBy("ordinal").collect()


def toc_of(spark, html):
    return [(r.ordinal, r.title, r.level, r.printed_page) for r in doc.extract_toc(spark.createDataFrame([("b", html)], "book string, html string"), "book").orderBy("ordinal").collect()]


def test_long_section_keeps_page_and_kind(spark):
    text = " ".join(f"This is sentence number {k} of the example." for k in range(12))
    out = chunks_of(spark, page(35, f'<div data-kind="example"><p>{text}</p></div>'), 45)
    assert len(out) > 2
    assert {(c["page_start"], c["page_end"], c["kind"]) for c in out} == {(35, 35, "example")}
    assert [c["ordinal"] for c in out] == list(range(1, len(out) + 1))
    assert all(len(c["content"]) <= 135 for c in out)


def test_empty_markup_and_bad_limit(spark):
    assert chunks_of(spark, "", 20) == [] and chunks_of(spark, None, 20) == []
    with pytest.raises(ValueError):
        chunks_of(spark, "<p>x</p>", 9)


def test_chapter_and_unit_carry_over_pages(spark):
    html = page(1, "<h1>A</h1><h2>one</h2><p>p1</p>") + page(2, "<p>p2</p>") + page(3, "<h2>two</h2><p>p3</p>") + page(4, "<h1>B</h1><p>p4</p>")
    assert [(c["chapter"], c["unit"]) for c in chunks_of(spark, html, 40)] == [("A", "one"), ("A", "one"), ("A", "two"), ("B", None)]


def test_list_items_tables_and_unclosed_paragraphs(spark):
    out = chunks_of(spark, page(1, "<p>one<p>two<ul><li>x<li>y</ul><table><tr><td>a<td>b</table>"), 40)
    assert [(c["kind"], c["content"]) for c in out] == [("paragraph", "one"), ("paragraph", "two"), ("list-item", "x"), ("list-item", "y"), ("table", "ab")]


def test_deeply_nested_pages(spark):
    out = chunks_of(spark, page(1, "<div>" * 3000 + '<p data-kind="k">x</p>' + "</div>" * 3000), 40)
    assert [(c["kind"], c["content"], c["html"]) for c in out] == [("k", "x", '<p data-kind="k">x</p>')]


def test_sentences_end_also_after_korean_da(spark):
    d = spark.createDataFrame([("물이 끓는다. 빛이 난다. 끝", 9), ("x" * 25, 10), ("a. " + "y" * 12 + " b. c.", 5), ("short", 5)], "t string, n int")
    got = {r.t: r.p for n in (9, 10, 5) for r in d.where(F.col("n") == n).select("t", doc.sentence_packs(F.col("t"), n).alias("p")).collect()}
    assert got == {"물이 끓는다. 빛이 난다. 끝": ["물이 끓는다.", "빛이 난다. 끝"], "x" * 25: ["x" * 10, "x" * 10, "x" * 5], "a. " + "y" * 12 + " b. c.": ["a.", "y" * 5, "y" * 5, "yy b.", "c."], "short": ["short"]}


def test_contents_with_levels_and_page_limit(spark):
    first = page(2, '<h1>Part one</h1><div class="toc">Heat 10<br>Light .... 24<br>Sound 31<br>LIGHT 40</div>')
    assert toc_of(spark, first + page(11, '<div class="toc">Late 99</div>')) == [(1, "Part one", 1, 10), (2, "Heat", 2, 10), (3, "Light", 2, 24), (4, "Sound", 2, 31)]


def test_wrapped_contents_lines(spark):
    assert toc_of(spark, page(1, '<p data-category="index">A title that goes\non here 288\nx 5\nChapter 7 .... 12\nends 13</p>')) == [(1, "A title that goes on here", 2, 288), (2, "Chapter 7 12 ends", 2, 13)]


def aligned(spark, entries, chunks, locations=()):
    e = spark.createDataFrame([("b", *x) for x in entries], "book string, ordinal int, title string, level int, printed_page int")
    c = spark.createDataFrame([("b", *x) for x in chunks], "book string, ordinal int, page_start int, chapter string, unit string")
    at = spark.createDataFrame([("b", *x) for x in locations], "book string, printed_page int, document_page int")
    out = al.align_revisions(e, c, at, "book").collect()
    return sorted(((r.chunk_ordinal, r.toc_ordinal, r.relation, r.confidence) for r in out), key=lambda x: (x[0], x[2] != "DIRECT", x[1]))


def test_heading_keys(spark):
    d = spark.createDataFrame([("Ⅱ.  힘과 운동 (Force & Motion)", "x"), ("2-1. 속도와 가속도", "2"), ("Heat", "1. heat"), ("Heat and light", "Heat"), ("Heat", None), ("ab", "abc")], "a string, b string")
    a, b = al.heading_key(F.col("a")), al.heading_key(F.col("b"))
    got = [tuple(r) for r in d.select(a, al.match_score(a, b)).collect()]
    assert [k for k, _ in got[:2]] == ["힘과운동forcemotion", "속도와가속도"]
    assert [s for _, s in got[2:]] == [1.0, 0.9, 0.0, 0.0]


def test_alignment_by_headings_adds_ancestors(spark):
    entries = [(1, "Physics", 1, None), (2, "Heat", 2, None), (3, "Light", 2, None)]
    chunks = [(1, 1, "Physics", None), (2, 2, "Physics", "Heat"), (3, 3, "Physics", "Light")]
    assert aligned(spark, entries, chunks) == [(1, 1, "DIRECT", 1.0), (2, 2, "DIRECT", 1.0), (2, 1, "ANCESTOR", 1.0), (3, 3, "DIRECT", 1.0), (3, 1, "ANCESTOR", 1.0)]


def test_entries_between_headings_follow_the_median_offset(spark):
    entries = [(1, "Heat", 1, 10), (2, "Nothing", 1, 12), (3, "Light", 1, 14)]
    chunks = [(1, 20, "Heat", None), (2, 21, "Heat", None), (3, 22, "Heat", None), (4, 24, "Light", None)]
    assert aligned(spark, entries, chunks) == [(1, 1, "DIRECT", 1.0), (2, 1, "DIRECT", 1.0), (3, 2, "DIRECT", al.OFFSET), (4, 3, "DIRECT", 1.0)]


def test_printed_pages_alone_map_nothing(spark):
    assert aligned(spark, [(1, "Heat", 1, 10)], [(1, 1, None, None)]) == []


def test_page_line_is_robust(spark):
    books = {"a": [(p, p + 4) for p in (10, 12, 15, 20, 24)] + [(18, 90)], "b": [(1, 1), (2, 2)], "c": [(10, 30), (10, 31), (12, 32), (14, 34)]}
    d = spark.createDataFrame([(b, *x) for b, xs in books.items() for x in xs], "book string, printed_page int, document_page int")
    lines, on = al.page_lines(d, "book")
    (line,) = lines.collect()
    assert (line.book, round(line.slope, 6), round(line.intercept, 6), on.count()) == ("a", 1.0, 4.0, 5)


def test_alignment_by_printed_pages(spark):
    got = aligned(spark, [(1, "X", 1, 10), (2, "Y", 1, 14)], [(k, 13 + k, None, None) for k in range(1, 8)], [(p, p + 4) for p in (10, 12, 14, 16)])
    assert [(c, t) for c, t, *_ in got] == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 2), (6, 2), (7, 2)]
    assert {s for *_, s in got} == {al.SEEN}


def test_two_printed_pages_to_a_sheet(spark):
    got = aligned(spark, [(1, "X", 1, 11), (2, "Y", 1, 15)], [(k, k, None, None) for k in range(4, 10)], [(p, p // 2) for p in (8, 9, 10, 12, 13, 16, 17)])
    assert [(c, t) for c, t, *_ in got] == [(5, 1), (6, 1), (7, 2), (8, 2), (9, 2)]


def test_chunks_and_alignment_as_dataframes(spark, rows):
    html = page(1, "<h1>A</h1><p>first</p>") + page(2, "<h1>B</h1><p>second</p>")
    d = spark.createDataFrame([("b1", html), ("b2", None)], "book string, html string")
    chunks = doc.chunk_documents(d, "book", "html", 20)
    assert rows(chunks.select("book", "ordinal", "chapter", "content"), "ordinal") == [("b1", 1, "A", "first"), ("b1", 2, "B", "second")]
    toc = spark.createDataFrame([("b1", 1, "A", 1, None), ("b1", 2, "B", 1, None)], "book string, ordinal int, title string, level int, printed_page int")
    none = spark.createDataFrame([], "book string, printed_page int, document_page int")
    m = al.align_revisions(toc, chunks, none, "book")
    assert rows(m.select("chunk_ordinal", "toc_ordinal", "relation"), "chunk_ordinal") == [(1, 1, "DIRECT"), (2, 2, "DIRECT")]
    more = toc.union(spark.createDataFrame([("b1", 3, "C", 1, None)], toc.schema))
    summary = al.mapping_summary(more, m, "book")
    assert rows(summary.select("ordinal", "mapping_status", "chunks", "chunk_ordinals"), "ordinal") == [(1, "MAPPED", 1, [1]), (2, "MAPPED", 1, [2]), (3, "UNMAPPED", 0, None)]
    assert rows(al.mapping_counts(summary, "book")) == [("b1", 2, 1)]


def test_printed_pages_place_contents(spark):
    """Entries whose printed page a footer shows are mapped to the chunks of that page, directly and with the highest confidence."""
    from lectern.plans import pipelines
    from lectern.session import ship

    ship(spark)
    toc = "<ul class='toc'>" + "".join(f"<li>Chapter {k} of this {10 + 2 * k}</li>\n" for k in range(1, 5)) + "</ul>"
    pages = [("b", 1, toc)] + [("b", k, f"<p>Text of page {k}, which says a few words about nothing.</p>") for k in range(2, 10)]
    p = spark.createDataFrame(pages, "book string, page int, html string")
    layout = spark.createDataFrame([("b", k, "footer", f"The book {k + 9}", 0.9) for k in range(1, 10)], "book string, document_page int, category string, text string, center_x double")
    out = pipelines.process_documents(p, "book", "page", 60, layout=layout)
    at = {r.ordinal: r.page_start for r in out["chunks"].collect()}
    printed = {r.ordinal: r.printed_page for r in out["toc"].select("ordinal", "printed_page").collect()}
    got = [(printed[r.toc_ordinal], at[r.chunk_ordinal], r.confidence) for r in out["mappings"].where("relation = 'DIRECT'").collect()]
    assert {x[0] for x in got} == {12, 14, 16, 18} and {x[2] for x in got} == {0.98}
    assert all(start - 9 <= page < start - 7 or start == 18 for start, page, _ in got)


def test_markdown_lines_keep_their_digits(spark):
    """the places of lines were taken as characters to trim."""
    md = spark.createDataFrame([("0 zero\n 1 one\n22 two\n\n- 3 three",)], "md string")
    assert md.select(doc.markdown_as_html(F.col("md"))).first()[0] == "<p>0 zero</p><p>1 one</p><p>22 two</p><li>3 three</li>"


def test_parsed_rows_leave_in_small_batches():
    """all rows of an Arrow batch were held at once."""
    import pyarrow as pa

    html = "<section>" + "x" * 300_000 + "</section>"
    given = pa.RecordBatch.from_pydict({"book": list(range(20)), "html": [html] * 20})
    out = list(doc.row_batches(iter([given]), lambda h: [{"size": len(h)}] * 2, pa.schema([("book", pa.int64()), ("seq", pa.int32()), ("size", pa.int64())])))
    assert [(r["book"], r["seq"]) for b in out for r in b.to_pylist()] == [(k, n) for k in range(20) for n in range(2)]
    assert max(b.num_rows for b in out) <= 8
