"""Token-bounded chunks of HTML pages that follow the structure of the page.

The parser is the standard library's, with implied end tags and an html/body frame
added; it is lenient, but no browser: where markup is broken, trees may differ from
other parsers'. The tokenizer is a parameter (``count`` and ``pieces``).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.functions.tokens import PatternTokenizer

LIMIT = 512
#: Subtrees without readable content; elements without end tag; tags that an ablation may remove.
DROPPED = frozenset({"script", "style", "svg"})
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ABLATIONS = ("form", "input", "a", "iframe", "meta")
#: Attributes that are lists of words, written with one blank between two.
LISTS = frozenset("class rel rev accept-charset headers accesskey dropzone".split())
#: Open elements that the start of another ends.
ENDS = {
    "li": {"li"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    **dict.fromkeys("p div ul ol dl table form h1 h2 h3 h4 h5 h6 hr pre section article header footer nav blockquote".split(), {"p"}),
}
#: Elements that implied ends don't reach beyond.
SCOPES = frozenset({"html", "body", "table", "ul", "ol", "dl", "select", "div", "form", "section"})


@dataclass
class Element:
    """A tag with attributes and children; children are elements or strings."""

    name: str
    attrs: list[tuple[str, str]] = field(default_factory=list)
    children: list = field(default_factory=list)


def start_tag(name: str, attrs: list[tuple[str, str]]) -> str:
    """The start tag as written out."""
    out = [name]
    for key, value in attrs:
        text = escape(value, quote=False)
        out.append(f"{key}='{text}'" if '"' in text and "'" not in text else f'{key}="{text.replace(chr(34), "&quot;")}"')
    return f"<{' '.join(out)}{'/' if name in VOID else ''}>"


def _leaf(name: str, attrs: list[tuple[str, str]]) -> str:
    return start_tag(name, attrs) + ("" if name in VOID else f"</{name}>")


class _Builder(HTMLParser):
    """Builds the tree without dropped subtrees, comments and doctype."""

    def __init__(self, dropped: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.dropped, self.skipping = dropped, []
        self.body = Element("body")
        self.root = Element("html", [], [self.body])
        self.open = [self.body]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.skipping:
            if tag == self.skipping[-1] and tag not in VOID:
                self.skipping.append(tag)
            return
        pairs = list({k: " ".join((v or "").split()) if k in LISTS else v or "" for k, v in attrs}.items())
        if tag in ("html", "body"):
            (self.root if tag == "html" else self.body).attrs = pairs
            return
        ended = ENDS.get(tag, ())
        while len(self.open) > 1 and self.open[-1].name in ended:
            self.open.pop()
        if tag in self.dropped:
            if tag not in VOID:
                self.skipping.append(tag)
            return
        node = Element(tag, pairs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        before = len(self.skipping)
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            if len(self.skipping) > before:
                self.skipping.pop()
            elif self.open[-1].name == tag:
                self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        if self.skipping:
            if tag == self.skipping[-1]:
                self.skipping.pop()
            return
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].name == tag:
                del self.open[at:]
                return
            if self.open[at].name in SCOPES and tag not in SCOPES:
                return

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.open[-1].children.append(data)


def parse(html: str, ablate: str | None = None) -> Element | None:
    """The tree of a page; None for one without content."""
    if ablate is not None and ablate not in ABLATIONS:
        raise ValueError(f"no ablation of <{ablate}>")
    builder = _Builder(DROPPED | ({ablate} if ablate else frozenset()))
    builder.feed(html)
    builder.close()
    return builder.root if builder.body.children else None


class Chunker:
    """Cuts trees into chunks (text, tokens) of at most ``limit`` tokens."""

    def __init__(self, limit: int = LIMIT, tokenizer=None):
        self.limit, self.tokenizer = limit, tokenizer or PatternTokenizer()

    def chunks(self, html: str | None, ablate: str | None = None) -> list[tuple[str, int]]:
        root = parse(html or "", ablate)
        return self._visit(root)[0] if root else []

    def _sized(self, text: str) -> tuple[str, int]:
        return text, self.tokenizer.count(text)

    def _visit(self, root: Element) -> tuple[list[tuple[str, int]], bool, str]:
        """(chunks, whether a part was over the limit, markup), children before parents, without recursion."""
        results: dict[int, tuple[list, bool, str]] = {}
        todo: list[tuple[object, bool]] = [(root, False)]
        while todo:
            node, ready = todo.pop()
            if isinstance(node, str):
                results[id(node)] = self._text(node)
            elif ready:
                # strings of equal text may be one object, so only elements are forgotten
                results[id(node)] = self._element(node, [results[id(c)] if isinstance(c, str) else results.pop(id(c)) for c in node.children])
            else:
                todo.append((node, True))
                todo.extend((c, False) for c in node.children)
        return results[id(root)]

    def _text(self, raw: str) -> tuple[list, bool, str]:
        text, markup = raw.strip(), escape(raw, quote=False)
        if not text:
            return [], False, markup
        one = self._sized(text)
        if one[1] <= self.limit:
            return [one], False, markup
        return self._pieces(text), True, markup

    def _pieces(self, text: str) -> list[tuple[str, int]]:
        """A text in pieces, each counted again and shortened while it doesn't fit; what is cut off goes to the next one."""
        size = self.limit - self.tokenizer.special
        if size <= 0:
            raise ValueError("the limit leaves no room for text")
        out, todo = [], deque(self.tokenizer.pieces(text, size))
        while todo:
            part = todo.popleft()
            one, less = self._sized(part), size
            while one[1] > self.limit:
                less -= 1
                if less <= 0:
                    raise ValueError("a text can't be divided within the limit")
                one = self._sized(self.tokenizer.pieces(part, less)[0])
            out.append(one)
            rest = part[part.index(one[0]) + len(one[0]) :]
            if rest.strip():
                todo.extendleft(reversed(self.tokenizer.pieces(rest + (todo.popleft() if todo else ""), size)))
        return out

    def _element(self, node: Element, parts: list[tuple[list, bool, str]]) -> tuple[list, bool, str]:
        inner = "".join(p[2] for p in parts)
        markup = start_tag(node.name, node.attrs) + ("" if node.name in VOID else f"{inner}</{node.name}>")
        if any(p[1] for p in parts):
            return self._around(parts), True, markup
        one = self._sized(markup.strip())
        if one[1] <= self.limit:
            return [one], False, markup
        inside = [c for p in parts for c in p[0]]
        return (self.merge(inside) if inside else self._attributes(node)), True, markup

    def _around(self, parts: list[tuple[list, bool, str]]) -> list[tuple[str, int]]:
        """Chunks of parts that fit are merged between those that didn't, which stay as they are."""
        out, run = [], []
        for chunks, over, _ in parts:
            if over:
                out += self.merge(run) + chunks
                run = []
            else:
                run += chunks
        return out + self.merge(run)

    def merge(self, chunks: list[tuple[str, int]]) -> list[tuple[str, int]]:
        """Neighbours joined as long as the joined text, counted again, fits."""
        out: list[tuple[str, int]] = []
        for chunk in chunks:
            joined = self._sized(out[-1][0] + chunk[0]) if out else None
            if joined and joined[1] <= self.limit:
                out[-1] = joined
            else:
                out.append(chunk)
        return out

    def _attributes(self, node: Element) -> list[tuple[str, int]]:
        """An element without content, in several tags that share out its attributes."""
        out, held = [], []
        for key, value in node.attrs:
            if self._sized(_leaf(node.name, [(key, value)]))[1] > self.limit:
                if held:
                    out.append(self._sized(_leaf(node.name, held)))
                out += self._value(node.name, key, value)
                held = []
            elif held and self._sized(_leaf(node.name, [*held, (key, value)]))[1] > self.limit:
                out.append(self._sized(_leaf(node.name, held)))
                held = [(key, value)]
            else:
                held.append((key, value))
        return out + ([self._sized(_leaf(node.name, held))] if held else [])

    def _value(self, name: str, key: str, value: str) -> list[tuple[str, int]]:
        """One long attribute value in parts, each in a tag of its own."""
        room = self.limit - self._sized(_leaf(name, [(key, "")]))[1]
        if room <= 0:
            raise ValueError(f"no room for attribute {key} of <{name}>")
        out, rest = [], self.tokenizer.pieces(value, room)
        while rest:
            part = rest.pop(0)
            chunk = self._sized(_leaf(name, [(key, part)]))
            if chunk[1] > self.limit and len(part) > 1:  # escapes take tokens too
                rest[:0] = [part[: len(part) // 2], part[len(part) // 2 :]]
            else:
                out.append(chunk)
        return out


def chunk_pages(pages: DataFrame, limit: int = LIMIT, ablate: str | None = None, tokenizer=None) -> DataFrame:
    """(source_file, chunk_index, token_count, document) of pages (source_file, html); pages without content have none.

    Pages are cut one by one in Arrow batches, without an exchange. ``tokenizer``: an
    object with ``count``, ``pieces`` and ``special`` that is sent to the tasks.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunker = Chunker(limit, tokenizer)
        for batch in batches:
            files, index, tokens, texts = [], [], [], []
            for name, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, (text, count) in enumerate(chunker.chunks(html, ablate)):
                    files.append(name)
                    index.append(i)
                    tokens.append(count)
                    texts.append(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(files, pa.string()), pa.array(index, pa.int32()), pa.array(tokens, pa.int32()), pa.array(texts, pa.string())],
                ["source_file", "chunk_index", "token_count", "document"],
            )

    rows = pages.select(F.col("source_file").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "source_file string, chunk_index int, token_count int, document string")


def chunk_counts(pages: DataFrame, ablations: tuple, limit: int = LIMIT, tokenizer=None) -> DataFrame:
    """(source_file, removed, chunks, tokens) of every page without each of ``ablations`` (None removes nothing); a page is read once for all."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunker = Chunker(limit, tokenizer)
        for batch in batches:
            rows = []
            for name, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for tag in ablations:
                    sizes = [n for _, n in chunker.chunks(html, tag)]
                    rows.append({"source_file": name, "removed": tag, "chunks": len(sizes), "tokens": sum(sizes)})
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("source_file", pa.string()), ("removed", pa.string()), ("chunks", pa.int64()), ("tokens", pa.int64())])
    rows = pages.select(F.col("source_file").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "source_file string, removed string, chunks long, tokens long")


def strip_markup(html):
    """Column: the page without scripts, styles, drawings, comments and doctype, by patterns."""
    for name in sorted(DROPPED):
        html = F.regexp_replace(html, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", "")
    html = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    return F.regexp_replace(html, r"(?i)<!doctype[^>]*>", "")
