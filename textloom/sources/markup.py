"""HTML, EPUB and JSON books: small parsers per row inside Arrow batches, everything around them relational."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tags that are skipped with their content, that end a block, that have no content, and that emphasise.
SKIPPED = {"script", "style", "head", "title", "noscript", "template", "svg", "sup"}
BLOCKS = set(
    "p div h1 h2 h3 h4 h5 h6 li blockquote pre section article header footer main body ul ol table tr td th dd dt dl figure figcaption aside nav center".split()
)
VOID = {"br", "hr", "img", "meta", "link", "input", "wbr", "area", "base", "col", "source", "track"}
EMPHASIS = {"i": "em", "em": "em", "cite": "em", "b": "strong", "strong": "strong"}
#: Class names that give a block its kind, those that may be followed by a digit apart.
CLASS_WORDS = {
    "heading": ("title chaptertitle chapter-title heading", "mt h s ms"), "verse": ("poetry verse", "q"), "quote": ("blockquote quote epigraph", ""), "note": ("footnote note f x xt", ""), "letter": ("letter", ""),
}
#: Class names, font weights and words of references to notes.
EMPHASIS_WORDS = {"em": "it italic i em bdit wj", "strong": "bold b strong"}
HEAVY = ("bold", "600", "700", "800", "900")
NOTE_TYPES, NOTE_LINKS = "footnote endnote noteref rearnote".split(), "noteref footnote".split()
#: Tags that end those of the same group which are still open, as their end tags are optional.
ENDED_BY = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}}
BLOCK_SCHEMA = "kind string, level int, text string, emphasis array<struct<start:int,end:int,kind:string>>"


def detect_format(path: Column, head: Column) -> Column:
    """epub, html, json, txt or a refusal (drm, unsupported), by extension, then by first characters."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    start = F.ltrim(head)
    return (
        F.when(ext == "acsm", "drm").when(ext == "pdf", "unsupported").when(ext == "epub", "epub").when(ext.isin("html", "htm", "xhtml"), "html").when(ext == "json", "json").when(ext.isin("txt", "text", "md"), "txt")
        .when(start.startswith("PK"), "epub").when(start.startswith("<"), "html").when(start.startswith("{"), "json").otherwise("txt")
    )


def kind_of_class(names: list[str]) -> str | None:
    """The kind of a block with these class names: the first kind of the table that one of them is a word of."""
    bare = set(names)
    stems = {n[:-1] for n in names if n[-1:].isdigit()}
    for kind, (plain, numbered) in CLASS_WORDS.items():
        if bare & {*plain.split(), *numbered.split()} or stems & set(numbered.split()):
            return kind
    return None


def emphasis_of(names: list[str], style: str) -> str | None:
    """em or strong by class names, else by the declarations of a style attribute."""
    by_class = next((k for k, words in EMPHASIS_WORDS.items() if set(words.split()) & set(names)), None)
    if by_class:
        return by_class
    declared = {k.strip(): v.strip() for k, _, v in (d.partition(":") for d in style.split(";"))}
    if declared.get("font-style", "").startswith("italic"):
        return "em"
    return "strong" if declared.get("font-weight", "").startswith(HEAVY) else None


class _Blocks(HTMLParser):
    """Collects blocks of text with emphasis ranges; offsets count in the collapsed text. End tags may be missing."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple] = []
        self.open: list[dict] = []  # elements that are open
        self.skip, self.depth = "", 0  # the tag whose content is skipped, and how deep
        self.text, self.marks = "", []

    def flush(self) -> None:
        text = self.text.rstrip()
        if text:
            block = next((e for e in reversed(self.open) if e["kind"]), {"kind": "para", "level": 0})
            marks = self.marks + [(e["start"], len(text), e["emphasis"]) for e in self.open if e["emphasis"]]
            ranges = sorted({(s, min(t, len(text)), k) for s, t, k in marks if s < min(t, len(text))})
            self.out.append((block["kind"], block["level"], text, [{"start": s, "end": t, "kind": k} for s, t, k in ranges]))
        self.text, self.marks = "", []
        for e in self.open:
            e["start"] = 0

    def close_element(self) -> None:
        e = self.open[-1]
        if e["kind"]:
            self.flush()
        elif e["emphasis"]:
            self.marks.append((e["start"], len(self.text), e["emphasis"]))
        self.open.pop()

    def close_upto(self, tags: set[str], within: set[str]) -> None:
        """Closes the innermost open element of `tags`, with all in it, unless one of `within` lies between."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] in tags:
                while len(self.open) > i:
                    self.close_element()
                return
            if self.open[i]["tag"] in within:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = {k: (v or "").lower() for k, v in attrs}
        if self.skip:
            if not (self.skip == "head" and tag in BLOCKS):  # a block ends a head that was left open
                self.depth += tag == self.skip
                return
            self.skip = ""
        if tag in VOID:
            if tag == "br" and self.text:
                self.handle_data(" ")
            elif tag == "hr":
                self.flush()
            return
        names = given.get("class", "").split()
        says = lambda words, name: any(w in given.get(name, "") for w in words)
        note = says(NOTE_TYPES, "epub:type") or tag == "a" and says(NOTE_LINKS, "class")
        if tag in SKIPPED or note:
            self.skip, self.depth = tag, 1
            return
        emphasis = EMPHASIS.get(tag) or emphasis_of(names, given.get("style", ""))
        kind, level = None, 0
        if tag in BLOCKS:
            self.close_upto({"p"}, {"table", "td", "th", "li", "blockquote", "aside", "div", "section", "article", "body"})
            if tag in ENDED_BY:
                self.close_upto(ENDED_BY[tag], {"table", "ul", "ol", "dl"})
            self.flush()
            above = next((e["kind"] for e in reversed(self.open) if e["kind"]), "para")
            kind = "para" if above == "heading" else above
            if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
                kind, level = "heading", int(tag[1])
            kind = {"blockquote": "quote", "aside": "note"}.get(tag, kind)
            kind = kind_of_class(names) or kind
        self.open.append({"tag": tag, "kind": kind, "level": level, "emphasis": emphasis, "start": len(self.text)})

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            self.depth -= tag == self.skip
            if not self.depth:
                self.skip = ""
        elif any(e["tag"] == tag for e in self.open):
            self.close_upto({tag}, set())

    def handle_data(self, data: str) -> None:
        if not self.skip:
            words = " ".join(data.replace("\xad", "").split())
            lead = " " if data[:1].isspace() and self.text and not self.text.endswith(" ") else ""
            tail = " " if data[-1:].isspace() and words else ""
            self.text += lead + words + tail if words or self.text else ""


def blocks_of(markup: str | None) -> list[tuple]:
    parser = _Blocks()
    parser.feed(markup or "")
    parser.close()
    while parser.open:
        parser.close_element()
    parser.flush()
    return parser.out


#: Blocks that a worker gathers before it gives them back, so that its memory doesn't follow the pages of an Arrow batch.
FRAME_BLOCKS = 4096


def block_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of pages (k, h), each page's whole, in frames that close at FRAME_BLOCKS."""
    framed = lambda rows: pd.DataFrame(rows, columns=["k", "block", "kind", "level", "text", "emphasis"])
    for pdf in frames:
        rows: list[tuple] = []
        for k, h in zip(pdf["k"], pdf["h"], strict=True):
            rows += [(k, i, *b) for i, b in enumerate(blocks_of(h))]
            if len(rows) >= FRAME_BLOCKS:
                yield framed(rows)
                rows = []
        yield framed(rows)


def html_blocks(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, block, kind, level, text, emphasis) of each page, in order."""

    kind = pages.schema[key].dataType.simpleString()
    out = pages.select(F.col(key).alias("k"), F.col(html).alias("h")).mapInPandas(block_frames, f"k {kind}, block int, {BLOCK_SCHEMA}")
    return out.withColumnRenamed("k", key)


def chapters(blocks: DataFrame, key: str, front_words: int = 40) -> DataFrame:
    """Blocks with chapter and title: headings of the highest level in the document open chapters; a short front
    matter before the first is folded into it."""
    top = blocks.where("kind = 'heading'").groupBy(key).agg(F.min("level").alias("top"), F.min("block").alias("first"))
    w = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.coalesce((F.col("kind") == "heading") & (F.col("level") == F.col("top")), F.lit(False))
    cut = blocks.join(top, key, "left").withColumn("opens", opens)
    cut = cut.withColumn("chapter", F.sum(F.col("opens").cast("int")).over(w)).withColumn("title", F.last(F.when(F.col("opens"), F.col("text")), ignorenulls=True).over(w))
    front = cut.where("chapter = 0").groupBy(key).agg((F.sum(F.size(F.split("text", " "))) < front_words).alias("fold"))
    out = cut.join(front, key, "left").withColumn("chapter", F.greatest(F.col("chapter") - 1, F.lit(0))).where("not opens")
    return out.withColumn("front", F.col("title").isNull() & ~F.coalesce("fold", F.lit(True))).select(key, "chapter", "title", "front", "block", "kind", "text", "emphasis")


BOOK = "title string, author string, chapters array<struct<title:string,part:string,paragraphs:array<string>>>"


def json_books(docs: DataFrame, key: str, raw: str = "text") -> DataFrame:
    """(key, reason, chapter, title, part, paragraph, kind, text) of JSON books; paragraphs are strings or objects.

    What is not a book is a row with reason 'malformed' or 'empty'."""
    book = docs.select(key, F.from_json(raw, BOOK).alias("b"))
    reason = F.when(F.col("b.chapters").isNull(), "malformed").when(F.size("b.chapters") == 0, "empty")
    flat = book.select(key, reason.alias("reason"), F.posexplode_outer("b.chapters").alias("chapter", "c"))
    flat = flat.select(key, "reason", "chapter", "c.title", "c.part", F.posexplode_outer("c.paragraphs").alias("paragraph", "p"))
    obj = F.from_json(F.when(F.col("p").startswith("{"), F.col("p")), "kind string, text string")
    return flat.select(key, "reason", "chapter", "title", "part", "paragraph", F.coalesce(obj["kind"], F.lit("para")).alias("kind"), F.coalesce(obj["text"], F.col("p")).alias("text"))


#: Encryption algorithms of embedded fonts, which are no copy protection.
FONT_ALGORITHMS = ("http://www.idpf.org/2008/embedding", "http://ns.adobe.com/pdf/enc#RC")


def _epub(data: bytes) -> tuple[str | None, list[tuple]]:
    """(reason, [(spine index, block...)]) of one EPUB; protected files are refused."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        names = set(z.namelist())
        if "META-INF/rights.xml" in names:
            return "drm", []
        if "META-INF/encryption.xml" in names:
            used = {e.get("Algorithm") for e in ElementTree.fromstring(z.read("META-INF/encryption.xml")).iter() if e.tag.endswith("EncryptionMethod")}
            if used - set(FONT_ALGORITHMS):
                return "drm", []
        root = next(e.get("full-path") for e in ElementTree.fromstring(z.read("META-INF/container.xml")).iter() if e.tag.endswith("rootfile"))
        package = ElementTree.fromstring(z.read(root))
        items = {e.get("id"): e.get("href") for e in package.iter() if e.tag.endswith("}item")}
        out = []
        for i, ref in enumerate(e.get("idref") for e in package.iter() if e.tag.endswith("}itemref")):
            name = posixpath.normpath(posixpath.join(posixpath.dirname(root), items.get(ref) or ""))
            if name in names:
                out += [(i, *b) for b in blocks_of(z.read(name).decode("utf-8", "replace"))]
        return (None if out else "empty"), out
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, StopIteration):
        return "malformed", []


def epub_blocks(files: DataFrame) -> DataFrame:
    """(path, reason, spine, block, kind, level, text) of EPUB files read as binaryFile."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                reason, blocks = _epub(bytes(data))
                rows += [(path, reason, s, n, kind, level, text) for n, (s, kind, level, text, _) in enumerate(blocks)] or [(path, reason, None, None, None, None, None)]
            out = pd.DataFrame(rows, columns=["path", "reason", "spine", "block", "kind", "level", "text"])
            yield out.astype({"spine": "Int64", "block": "Int64", "level": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, reason string, spine long, block long, kind string, level long, text string")


def frequency_list(lines: DataFrame) -> DataFrame:
    """word and rank from (no, line): rank is the number of the line among those not blank, a word's first counts.

    The running number is taken per block of 10000 lines plus the counts of the blocks before, so no task sees all lines."""
    full = lines.where("trim(line) <> ''").withColumn("part", F.floor(F.col("no") / 10_000))
    before = full.groupBy("part").count().withColumn("base", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    rank = F.row_number().over(Window.partitionBy("part").orderBy("no")) + F.col("base")
    return full.join(before, "part").select(F.element_at(F.split(F.trim("line"), r"\s+"), 1).alias("word"), rank.alias("rank")).groupBy("word").agg(F.min("rank").alias("rank"))


def tsv(spark, path: str) -> DataFrame:
    """A table with a header, tabs, no quoting; missing cells are empty."""
    return spark.read.csv(path, sep="\t", header=True, quote="", escape="").na.fill("")

