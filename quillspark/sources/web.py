"""Web pages: text of chosen elements only, by a lenient parser, cut into chunks."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame

from ..operators.markdown import recursive_chunks, rows_of_chunks

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Chosen(HTMLParser):
    """Collects the text inside elements of given tags or classes."""

    def __init__(self, tags: tuple[str, ...], classes: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.tags, self.classes, self.stack, self.inside, self.parts = tags, classes, [], 0, []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        names = (dict(attrs).get("class") or "").split()
        hit = tag in self.tags or any(c in names for c in self.classes)
        self.stack.append((tag, hit))
        self.inside += hit

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.inside -= sum(h for _, h in self.stack[i:])
                del self.stack[i:]
                return

    def handle_data(self, data):
        if self.inside and not (self.stack and self.stack[-1][0] in ("script", "style")):
            self.parts.append(data)


def chosen_text(html: str | None, tags: tuple[str, ...] = (), classes: tuple[str, ...] = ("post-content", "post-title", "post-header")) -> str:
    p = Chosen(tags, classes)
    p.feed(html or "")
    p.close()
    return " ".join("\n".join(p.parts).split(" ")).strip()


def page_chunks(pages: DataFrame, tags: tuple[str, ...] = (), classes: tuple[str, ...] = ("post-content", "post-title", "post-header"), size: int = 1000, overlap: int = 200) -> DataFrame:
    """(page_id, pos, chunk) of pages (page_id, html)."""
    return rows_of_chunks(pages, "page_id", "html", lambda h: recursive_chunks(chosen_text(h, tags, classes), size, overlap))
