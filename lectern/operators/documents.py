"""Documents: page assembly, chunking, tables of contents, printed pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StructField, StructType

from lectern.operators.relational import carry_forward

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: An open element that the start of another one ends.
CLOSES = {
    "p": {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"},
    "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
}


class Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        """Elements below this one, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def above(self) -> Iterator[Node]:
        n = self.parent
        while n is not None:
            yield n
            n = n.parent

    def text(self) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack += reversed(n.children)
        return "".join(out)

    def html(self) -> str:
        """Markup of the element; a stack instead of recursion, as pages may be nested deeply."""
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
                continue
            out.append("<" + n.tag + "".join(f' {k}="{escape(v)}"' for k, v in n.attrs.items()) + ">")
            if n.tag not in VOID:
                stack.append(f"</{n.tag}>")
                stack += [escape(c, quote=False) if isinstance(c, str) else c for c in reversed(n.children)]
        return "".join(out)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        n = self.at
        while n.parent is not None and n.tag not in ("table", "ul", "ol", "section", "div"):
            if tag in CLOSES.get(n.tag, ()):
                self.at = n.parent
                break
            n = n.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None:
            if n.tag == tag:
                self.at = n.parent
                return
            n = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse_html(html: str) -> Node:
    t = _Tree()
    t.feed(html)
    t.close()
    return t.root


def flat(s: str) -> str:
    return " ".join(s.split())


def _int(s: str | None) -> int | None:
    m = re.match(r"\s*([+-]?\d+)", s or "")
    return int(m[1]) if m else None


def page_elements(html: str) -> Iterator[Node]:
    """Outermost elements with data-page."""
    for n in parse_html(html).walk():
        if "data-page" in n.attrs and not any("data-page" in a.attrs for a in n.above()):
            yield n


def page_blocks(html: str) -> Iterator[dict]:
    """One row per page: its numbers, headings, and its blocks (kind, html, content) in order."""
    for at, page in enumerate(page_elements(html)):
        inside = list(page.walk())
        named = lambda attr, tag: flat(page.attrs.get(attr, "")) or flat(next((n.text() for n in inside if n.tag == tag), ""))  # noqa: B023, E731
        blocks = []
        for n in inside:
            given = n.attrs.get("data-kind")
            if given or (n.tag in ("p", "li", "table") and not any("data-kind" in a.attrs for a in n.above())):
                content = flat(n.text())
                kind = given if given is not None else {"table": "table", "li": "list-item"}.get(n.tag, "paragraph")
                if content:
                    blocks.append({"kind": kind, "html": n.html(), "content": content})
        first, last = _int(page.attrs.get("data-page")), _int(page.attrs.get("data-page-end"))
        yield {"at": at, "page_start": first, "page_end": first if last is None else last, "chapter": named("data-chapter", "h1") or None, "unit": named("data-unit", "h2") or None, "blocks": blocks}


def index_blocks(html: str, max_pages: int) -> Iterator[dict]:
    """One row per index block of the first pages: place, the page's heading, and the text with its line breaks."""
    at = 0
    for page in parse_html(re.sub(r"(?i)<br\s*/?\s*>", "\n", html)).walk():
        number = page.attrs.get("data-page", "x").strip()
        if re.fullmatch(r"\d+(\.\d+)?", number) and float(number) <= max_pages:
            inside = list(page.walk())
            heading = next((n.text() for n in inside if n.tag in ("h1", "h2")), None)
            for n in inside:
                if n.attrs.get("data-category") == "index" or {"toc", "table-of-contents"} & set(n.attrs.get("class", "").split()):
                    yield {"page_at": at, "heading": heading, "text": n.text()}
            at += 1


#: Characters of documents whose rows a task has in memory at once (and one document at least).
PARSED_CHARS = 1 << 20


def row_batches(batches: Iterator[pa.RecordBatch], rows_of, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches (key, html) to batches of the rows that ``rows_of(html)`` gives, with key and place, PARSED_CHARS of documents at a time."""
    key, rows, size = schema.names[0], [], 0
    for batch in batches:
        for k, h in zip(batch.column(0), batch.column(1)):
            text = h.as_py() or ""
            rows += [{key: k.as_py(), "seq": n, **r} for n, r in enumerate(rows_of(text))]
            size += len(text)
            if size >= PARSED_CHARS:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, size = [], 0
    yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _parsed(df: DataFrame, key: str, html: str, rows_of, schema: str) -> DataFrame:
    """The rows that ``rows_of(html)`` gives, with the document's key and their place."""
    out = StructType.fromDDL(schema)
    fields = [df.schema[key], StructField("seq", IntegerType()), *out.fields]
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in fields])
    return df.select(key, html).mapInArrow(lambda batches: row_batches(batches, rows_of, arrow), StructType(fields))


#: Fixed value: where a sentence ends (also after Korean "da.").
SENTENCE_END = r"(?<=[.!?。])\s+|(?<=다\.)\s+"


def sentence_packs(content: Column, limit: int) -> Column:
    """Packs of whole sentences up to ``limit`` characters; a longer sentence is cut into pieces of its own.

    A fold over the pieces: each joins the last pack if that is open and stays within the limit.
    """
    sentences = F.filter(F.split(content, SENTENCE_END, -1), lambda x: x != "")
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / limit).cast("int")), lambda k: F.struct(F.trim(F.substr(x, k * limit + 1, F.lit(limit))).alias("text"), F.lit(False).alias("open")))
    pieces = F.flatten(F.transform(sentences, lambda x: F.when(F.length(x) > limit, cut(x)).otherwise(F.array(F.struct(x.alias("text"), F.lit(True).alias("open"))))))

    def add(packs: Column, piece: Column) -> Column:
        last = F.element_at(packs, -1)
        joins = (F.size(packs) > 0) & piece["open"] & F.when(F.size(packs) > 0, last["open"] & (F.length(last["text"]) + 1 + F.length(piece["text"]) <= limit))
        longer = F.struct(F.concat(last["text"], F.lit(" "), piece["text"]).alias("text"), F.lit(True).alias("open"))
        return F.when(joins, F.concat(F.slice(packs, 1, F.size(packs) - 1), F.array(longer))).otherwise(F.concat(packs, F.array(piece)))

    packed = F.aggregate(pieces, F.array().cast("array<struct<text:string,open:boolean>>"), add)
    texts = F.filter(F.transform(packed, lambda p: p.text), lambda x: x != "")
    return F.when(F.length(content) <= limit, F.array(content)).otherwise(texts)


_PAGE = "at int, page_start int, page_end int, chapter string, unit string, blocks array<struct<kind:string,html:string,content:string>>"


def chunk_documents(docs: DataFrame, key: str, html: str = "html", max_tokens: int = 400) -> DataFrame:
    """Chunks of documents whose pages are elements with data-page: key, ordinal, page_start, page_end,
    chapter, unit, kind, html, content, estimated_tokens.

    Only the parsing is Python; chapters and units are carried by windows, blocks are cut into
    packs of sentences of three characters a token.
    """
    if max_tokens < 10:
        raise ValueError("max_tokens must be at least 10")
    pages = carry_forward(_parsed(docs, key, html, page_blocks, _PAGE), key, "at")
    blocks = pages.select(key, "at", "page_start", "page_end", "chapter", "unit", F.posexplode("blocks").alias("block", "b"))
    parts = blocks.select("*", F.posexplode(sentence_packs(F.col("b.content"), 3 * max_tokens)).alias("part", "content"))
    place = Window.partitionBy(key).orderBy("at", "block", "part")
    return parts.select(
        key, F.row_number().over(place).alias("ordinal"), "page_start", "page_end", "chapter", "unit", "b.kind", "b.html", "content", F.ceil(F.length("content") / 3).cast("int").alias("estimated_tokens")
    )


def clean_title(c: Column) -> Column:
    """White space and dotted leaders as one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"[.…·]{2,}", " "))


#: A title, which may run over several lines, and the page number that ends its last line;
#: the shortest and longest title.
INDEX_LINE = r"(?s)\s*(.*?\D)\s+(\d{1,3})(?:\n|$)"
TITLE_CHARS = (2, 180)


def index_lines(text: Column) -> Column:
    """array<struct<title, page>> of an index block; a line without a page number goes on in the next."""
    # twice, as leaders leave blanks of their own
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: clean_title(clean_title(x))), lambda x: x != "")
    joined = F.array_join(lines, "\n")
    titles, pages = (F.regexp_extract_all(joined, F.lit(INDEX_LINE), F.lit(k)) for k in (1, 2))
    found = F.zip_with(titles, pages, lambda t, p: F.struct(clean_title(t).alias("title"), p.cast("int").alias("page")))
    return F.filter(found, lambda x: F.length(x.title).between(*TITLE_CHARS))


def extract_toc(docs: DataFrame, key: str, html: str = "html", max_pages: int = 10) -> DataFrame:
    """key, ordinal, title, level, printed_page: contents from index blocks of the first pages.

    A page's heading is an entry of level 1 with the page of its first line, its lines are of
    level 2; of titles that differ in case only the first counts.
    """
    blocks = _parsed(docs, key, html, lambda h: index_blocks(h, max_pages), "page_at int, heading string, text string")
    lines = blocks.select(key, "seq", "page_at", clean_title(F.col("heading")).alias("heading"), F.posexplode(index_lines(F.col("text"))).alias("line", "x"))
    lines = lines.select(key, "page_at", "heading", "seq", "line", "x.*")
    first = lines.groupBy(key, "page_at", "heading").agg(F.min(F.struct("seq", "line", "page")).alias("f")).where(F.coalesce(F.col("heading"), F.lit("")) != "")
    heads = first.select(key, "page_at", F.lit(-1).alias("seq"), F.lit(0).alias("line"), F.col("heading").alias("title"), F.lit(1).alias("level"), F.col("f.page").alias("printed_page"))
    rows = heads.unionByName(lines.select(key, "page_at", "seq", "line", "title", F.lit(2).alias("level"), F.col("page").alias("printed_page")))
    order = ("page_at", "seq", "line")
    once = rows.withColumn("again", F.row_number().over(Window.partitionBy(key, F.lower("title")).orderBy(*order))).where("again = 1")
    return once.select(key, F.row_number().over(Window.partitionBy(key).orderBy(*order)).alias("ordinal"), "title", "level", "printed_page")


def markdown_as_html(markdown: Column) -> Column:
    """Plain HTML of a page that came as Markdown: headings, list items, paragraphs."""
    line = lambda x: (
        F.when(x.rlike(r"^#{1,6}\s"), F.concat(F.lit("<h"), F.length(F.regexp_extract(x, "^(#+)", 1)).cast("string"), F.lit(">"), F.regexp_replace(x, r"^#+\s+", ""), F.lit("</h"), F.length(F.regexp_extract(x, "^(#+)", 1)).cast("string"), F.lit(">")))
        .when(x.rlike(r"^[-*]\s"), F.concat(F.lit("<li>"), F.regexp_replace(x, r"^[-*]\s+", ""), F.lit("</li>")))
        .otherwise(F.concat(F.lit("<p>"), x, F.lit("</p>")))
    )
    safe = F.replace(F.replace(F.replace(markdown, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.array_join(F.transform(F.filter(F.transform(F.split(safe, r"\n+"), lambda x: F.trim(x)), lambda x: x != ""), line), "")


def assemble_pages(pages: DataFrame, doc: str, page: str, html: str = "html", markdown: str | None = None) -> DataFrame:
    """One document per key from its pages in order, each in a section of its own.

    All pages of a document meet in one row, as the document itself does.
    """
    md = F.col(markdown) if markdown else F.lit(None).cast("string")
    parts = F.array_sort(F.collect_list(F.struct(F.col(page).alias("page"), F.col(html).alias("html"), md.alias("markdown"))))
    section = lambda p: F.concat(F.lit('<section data-page="'), p.page.cast("string"), F.lit('">'), F.coalesce(p.html, F.lit("")), F.lit("</section>"))
    note = lambda p: F.concat(F.lit("<!-- page "), p.page.cast("string"), F.lit(" -->\n"), p.markdown)
    return pages.groupBy(doc).agg(parts.alias("__p")).select(
        doc, F.array_join(F.transform("__p", section), "").alias("html"), F.array_join(F.transform("__p", note), "\n\n").alias("markdown"), F.size("__p").alias("pages")
    )


def printed_pages(elements: DataFrame, doc: str) -> DataFrame:
    """Printed page numbers from footers, one per document page and side if it is unambiguous.

    elements: doc, document_page, category, text, center_x (0..1 or NULL).
    """
    numbers = F.filter(F.transform(F.expr(r"regexp_extract_all(text, '(?<!\\d)(\\d{1,4})(?!\\d)', 1)"), lambda x: x.cast("int")), lambda n: n > 0)
    left = F.col("center_x") < 0.5
    e = (
        elements.where((F.lower("category") == "footer") & (F.col("document_page") >= 1))
        .withColumn("numbers", numbers)
        .where((F.size("numbers") > 0) & (F.col("center_x").isNotNull() | (F.size("numbers") == 1)))
        .withColumn("side", F.when(F.col("center_x").isNull(), "unknown").when(left, "left").otherwise("right"))
        .withColumn("printed_page", F.when(left, F.element_at("numbers", 1)).otherwise(F.element_at("numbers", -1)))
    )
    one = e.groupBy(doc, "document_page", "side").agg(F.count_distinct("printed_page").alias("k"), F.min("printed_page").alias("printed_page"))
    return one.where("k = 1").select(doc, "document_page", "printed_page")
