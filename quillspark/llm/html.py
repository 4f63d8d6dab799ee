"""Operator 3, HTML extraction: two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides a block by its length, its share of link
characters and of stop words (by length and sentences alone in scripts that the stop words don't cover), and by
where it stands (menus, footers, and what a class says); short blocks and long prose with many links stay open.
What a class or a form around it says doesn't count where it stands on the page's main text, nor does an article
beside which most of the good text stands. In the second pass an open block takes the label of the nearest decided
neighbours.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Tags by what they do to the text around them.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
DROPPED = frozenset("script style noscript template svg math iframe object canvas audio video head select textarea button datalist".split())
BAD = frozenset("nav header footer aside menu dialog search".split())
#: Some pages stand in a form as a whole.
WEAK = frozenset("form fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role that mark what isn't the article; a word counts whole, between marks.
BAD_WORDS = frozenset("ad ads advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus footer form gdpr masthead menu menubar modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget widgets complementary contentinfo".split())
#: Of these, words of what may be long and well written and yet isn't the article.
FOREIGN = frozenset("ad ads advert advertisement advertising adsense comment comments commentlist consent cookie cookies copyright disclaimer disqus gdpr newsletter promoted related replies reply respond sponsor sponsored".split())
#: Words that make a name with a bad word one of a state (has-sidebar, comments-open, tag-social), not of what is inside.
STATE = frozenset("category closed disabled enabled format has hide is layout left no not off on open right show status tag type with without".split())
#: The article's own header may hold its title.
ARTICLE = frozenset("article main".split())
#: Frequent function words of the languages of the corpus: English, German, French, Spanish.
STOP = frozenset("""the of and to in is that it for was on with as be by this are from at or an not but have has had which their they his her its were been will would can a i you we he she
der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach bei um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch
le la les de des du et est un une en que qui dans pour pas sur au aux par plus ne se ce il elle sont avec son sa ses mais comme ou nous vous leur
el los las del y es una por con para como no más pero sus al lo se su ha este esta son entre cuando muy sin sobre también me hasta hay donde""".split())
#: First pass: lengths in characters and shares.
LONG, SHORT, MAX_LINKS, STOP_HIGH, STOP_LOW = 200, 70, 0.2, 0.12, 0.08
#: In an article links may be up to this share of prose; letters of scripts without spaces count so often towards a length.
MOST_LINKS, DENSE = 0.5, 3

#: Comments, sections and declarations; a tag without angle brackets inside and with all quotes closed, as nearly all are.
DECLARED = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)", re.DOTALL)
PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+)>")
STARTS = re.compile(r"</?[a-zA-Z]")
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.IGNORECASE)
MARKS = re.compile(r"[^a-z0-9]+")
WORDS = re.compile(r"[^\W\d_]+")
#: Letters of the stop words' script; letters of scripts that put no spaces between words; what ends a sentence.
LATIN = re.compile(r"[a-zA-Z\u00AA-\u024F\u1E00-\u1EFF]")
UNSPACED = re.compile(r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\U00020000-\U0003FFFF]")
ENDS = re.compile(r"[.!?…。！？؟।]")


class Ends:
    """Where tags of a page end: made once, in time that grows with its length, for pages with tags that aren't PLAIN.

    What stands in quotes is taken whole where they close before the tag does; else the tag ends at the next >.
    """

    def __init__(self, page: str):
        self.marks = [m.start() for m in re.finditer("[>\"']", page)]
        # from each mark on: the next > at all, and the next one that isn't in quotes that begin here or later
        self.next, self.free = [-1] * (len(self.marks) + 1), [-1] * (len(self.marks) + 1)
        closing: dict[str, int] = {}
        for i in range(len(self.marks) - 1, -1, -1):
            c = page[self.marks[i]]
            if c == ">":
                self.next[i] = self.free[i] = self.marks[i]
                continue
            self.next[i], self.free[i] = self.next[i + 1], self.free[closing.get(c, i) + 1]
            closing[c] = i

    def any_after(self, at: int) -> int:
        return self.next[bisect_left(self.marks, at)]

    def of(self, at: int) -> int:
        """The end of a tag whose attributes begin at a place; -1 if there is none."""
        i = bisect_left(self.marks, at)
        return self.next[i] if self.free[i] < 0 else self.free[i]


class Tags:
    """The tags of a page, from any place on."""

    def __init__(self, page: str):
        self.page, self.ends = page, None

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, slash, name, attributes) of the first tag from a place on; of what is declared the name is empty."""
        page = self.page
        while (p := page.find("<", at)) >= 0:
            if m := PLAIN.match(page, p):
                return p, m.end(), *m.groups()
            if m := DECLARED.match(page, p):
                return p, m.end(), "", "", ""
            if STARTS.match(page, p):
                self.ends = self.ends or Ends(page)
                if self.ends.any_after(p) >= 0:
                    m = NAME.match(page, p)
                    end = self.ends.of(m.end())
                    return p, end + 1, m[1], m[2], page[m.end() : end]
            at = p + 1
        return None


def off(attrs: str, article: bool = False) -> str:
    """What a tag's class, id, role or style says: "hidden", that it holds no article text; "strong" or "weak", that it may hold none; or nothing.

    A bad word is strong if what it names may pass for article text by its words. A name that is only partly
    of bad words, or that is of a state, says nothing of an article or main.
    """
    found = ""
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return "hidden"
        if name in ("class", "id", "role") and not BAD_WORDS.isdisjoint(MARKS.split(value)):
            for token in value.split():
                words = {w for w in MARKS.split(token) if w}
                if words.isdisjoint(BAD_WORDS):
                    continue
                if not words.isdisjoint(FOREIGN) and words.isdisjoint(STATE):
                    found = "strong"
                elif not article or words <= BAD_WORDS:
                    found = found or "weak"
    return found


def lifted(marks: list[list], found: list[tuple[str, int, bool, int, bool, int]]) -> list[bool]:
    """Of each mark (the mark around it or -1, strong or weak, whether an article or main opens in it) whether it counts no more, as it stands on the page's main text.

    found has of each block text, link characters, bad place by tag, inside article or main, heading, and
    its innermost mark or -1. Weak marks go if they hold most of the long text with many stop words, or
    the article where no other stands free; strong ones only if they hold both.
    """
    n = len(marks)
    up = [m[0] for m in marks]
    holds = [m[2] for m in marks]
    strong = [m[1] == "strong" for m in marks]
    under = strong[:]  # whether the mark or one around it is strong
    for i in range(n):
        if up[i] >= 0:
            under[i] |= under[up[i]]
    every, plain = [0] * n, [0] * n  # long text in each mark, and such without strong marks
    total = total_plain = clean = 0
    for text, links, bad, article, heading, mark in found:
        if bad:
            continue
        long = len(text) if first_pass((text, links, False, article, heading)) else 0
        total += long
        if mark < 0:
            clean += long
        else:
            every[mark] += long
        if mark < 0 or not under[mark]:
            total_plain += long
            if mark >= 0:
                plain[mark] += long
    for i in range(n - 1, -1, -1):
        if up[i] >= 0:
            every[up[i]] += every[i]
            if not under[i]:
                plain[up[i]] += plain[i]
            holds[up[i]] |= holds[i]

    gone = [False] * n

    def free() -> bool:
        """Whether text of an article or main stands in no mark that counts."""
        counts = [False] * n
        for i in range(n):
            counts[i] = not gone[i] or up[i] >= 0 and counts[up[i]]
        return any(b[3] and not b[2] and (b[5] < 0 or not counts[b[5]]) for b in found)

    lone = not free()
    for i in range(n):
        if not strong[i]:
            most = 2 * plain[i] > total_plain
            gone[i] = most or lone and holds[i] and 4 * plain[i] >= clean
    if any(strong) and not free():
        for i in range(n):
            if strong[i] and holds[i]:
                gone[i] = 2 * every[i] > total
    return gone


def blocks(page: str) -> list[tuple[str, int, bool, bool, bool]]:
    """(text, characters in links, bad place, inside article or main, heading) of each block, in page order."""
    out, text, links = [], [], 0
    stack: list[tuple[str, bool, int]] = []  # (tag, bad, the mark that it made or -1)
    marks: list[list] = []  # [the mark around it or -1, strong or weak, whether an article or main opens in it]
    mark = -1
    opened: Counter[str] = Counter()  # how often each tag stands in the stack
    bad = in_article = link = 0
    heading = False
    at, n = 0, len(page)
    known, unclosed = Tags(page), False  # unclosed: no closing </head> is ahead

    def close():
        nonlocal text, links
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                out.append((whole, links, bad > 0, in_article > 0, heading, mark))
            text, links = [], 0

    while at < n:
        found = known.next(at)
        piece = page[at : found[0]] if found else page[at:]
        if piece:
            if "&" in piece:  # a reference ends where a tag begins
                piece = entities.unescape(piece)
            text.append(piece)
            if link:
                links += len(piece)
        if not found:
            break
        start, at, slash, tag, attrs = found
        tag = tag.lower()
        if not tag:
            if page.startswith("<![CDATA[", start):
                text.append(page[start + 9 : at - 3])
            continue
        if slash:
            if tag in BLOCK:
                close()
            if tag == "a":
                link = 0
            # what stands open above a closed tag ends with it; a close tag that opened nothing is passed over
            for i in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[i][0] == tag:
                    for name, was, made in reversed(stack[i:]):
                        opened[name] -= 1
                        bad -= was
                        in_article -= name in ARTICLE
                        if made >= 0:
                            mark = marks[made][0]
                    del stack[i:]
                    break
            if tag in HEADINGS:
                heading = False
            continue
        if tag in DROPPED:
            if attrs.endswith("/") or tag == "head" and unclosed:
                continue
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
            if end:
                at = end.end()
            elif tag == "head":
                unclosed = True
                continue
            else:
                at = n
            text.append(" ")
            continue
        if tag in BLOCK:
            close()
        elif tag == "br":
            text.append(" ")
        if tag == "a":
            link = 1
        if tag in VOID or attrs.endswith("/"):
            continue
        if tag in ("p", "li") and stack and stack[-1][0] == tag:
            opened[tag] -= 1
            _, was, made = stack.pop()
            bad -= was
            if made >= 0:
                mark = marks[made][0]
        heading = tag in HEADINGS or heading and tag not in BLOCK
        # a header inside an article may hold its title: there only what the class says counts
        says = off(attrs, tag in ARTICLE) if tag not in ("html", "body") else ""
        if tag in WEAK:
            says = says or "weak"
        was = says == "hidden" or tag in BAD and not (tag == "header" and in_article)
        made = -1
        if says and not was:
            marks.append([mark, says, False])
            made = mark = len(marks) - 1
        bad += was
        if tag in ARTICLE and not bad and mark >= 0:
            marks[mark][2] = True
        in_article += tag in ARTICLE
        stack.append((tag, was, made))
        opened[tag] += 1
    close()
    counts = []  # whether a mark, or one around it, counts
    for (around, _, _), gone in zip(marks, lifted(marks, out) if marks else (), strict=True):
        counts.append(not gone or around >= 0 and counts[around])
    return [(*b[:2], b[2] or b[5] >= 0 and counts[b[5]], *b[3:5]) for b in out]


def stop_share(text: str) -> float | None:
    """The share of stop words among a block's words; None for a text of another script, which has none of them."""
    words = WORDS.findall(text.lower())
    if not words:
        return 0.0
    share = sum(w in STOP for w in words) / len(words)
    if share < STOP_LOW and 2 * len(LATIN.findall(text)) < sum(map(len, words)):
        return None
    return share


def first_pass(block: tuple[str, int, bool, bool, bool]) -> bool | None:
    """True: article text; False: not; None: open."""
    text, links, bad, article, heading = block
    if bad:
        return False
    n = len(text)
    linked = links > MAX_LINKS * n and links > 0
    if linked and article and heading:
        return None
    prose = article and n >= SHORT and links <= MOST_LINKS * n
    if linked and n < LONG and not prose:
        return False
    share = stop_share(text)
    if share is None:  # no stop words to go by: length and sentences
        if linked:
            return None if prose and ENDS.search(text) else False
        return True if n + (DENSE - 1) * len(UNSPACED.findall(text)) >= LONG and ENDS.search(text) else None
    if linked:  # prose with many links stays open
        return None if share >= STOP_HIGH else False
    if n >= LONG:
        return share >= STOP_LOW or None
    if n >= SHORT:
        return True if share >= STOP_HIGH else None
    return None


def extract(page: str | None) -> list[str]:
    """The blocks of the main text of a page, in order."""
    found = blocks(page or "")
    labels = [first_pass(b) for b in found]
    if True not in labels:  # no stop words anywhere: in a language without any that are known, length and sentences decide
        labels = [True if x is None and len(b[0]) >= LONG and b[1] <= MAX_LINKS * len(b[0]) and ENDS.search(b[0]) else x for x, b in zip(labels, found, strict=True)]
    if True not in labels and not any(b[3] and not b[2] for b in found):  # nothing is long, and no article is named: whole sentences decide
        whole = lambda b: not b[1] and not b[4] and ENDS.search(b[0][-2:]) and ((share := stop_share(b[0])) is None or share >= STOP_HIGH)
        labels = [True if x is None and whole(b) else x for x, b in zip(labels, found, strict=True)]
    # where a page names its article, the text is in it, unless most of the good text stands outside, as beside a teaser
    inside, outside = (sum(len(b[0]) for x, b in zip(labels, found, strict=True) if x and b[3] == here) for here in (True, False))
    named = any(b[3] and not b[2] for b in found) and 2 * inside >= outside
    if named:
        labels = [x if b[3] else False for x, b in zip(labels, found, strict=True)]
    n = len(found)
    before, after = [None] * n, [None] * n
    # what stands in a bad place inside the article says nothing about the text around it
    speaks = [x is not None and not (b[2] and b[3]) for x, b in zip(labels, found, strict=True)]
    last = None
    for i in range(n):
        before[i] = last
        if speaks[i]:
            last = i
    last = None
    for i in range(n - 1, -1, -1):
        after[i] = last
        if speaks[i]:
            last = i
    out = []
    for i, b in enumerate(found):
        label = labels[i]
        if label is None:
            near = [j for j in (before[i], after[i]) if j is not None and found[j][3] == b[3]]
            if b[4]:  # a heading belongs to what follows it
                near = [j for j in near if j > i] or near
            if near:
                least = min(abs(j - i) for j in near)
                label = any(labels[j] for j in near if abs(j - i) == least) or b[3] and any(labels[j] for j in near)
            else:
                label = named and b[3]  # an article of short blocks alone is kept, short text outside one isn't
        if label:
            out.append(b[0])
    return out


def extract_pages(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), page: str = "html") -> DataFrame:
    """The columns `keep`, string text (blocks joined by an empty line) and long n_chars, for each page.

    A null page is an empty one: its text is the empty string. Pages are read whole, one by one. An empty
    table gives no rows. The columns made replace kept ones of their names.
    """
    names = [c for c in keep if c not in ("text", "n_chars")]
    rows = pages.select(*names, pages[page].alias("__page"))
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in rows.schema.fields[:-1]], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for b in batches:
            texts = ["\n\n".join(extract(x.as_py())) for x in b.column(b.num_columns - 1)]
            arrays = [*[b.column(i) for i in range(len(names))], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "text", "n_chars"])

    return rows.mapInArrow(run, schema)


def op3(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
