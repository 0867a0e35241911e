"""Main text of web pages by equivalence-class template deduction.

Pages of a host are compared in blocks of some ``block_pages`` pages. A page is a
sequence of tokens: tags with their attributes that name a kind, and the words, each
with the path of structural elements above it.
Tokens that occur equally often on every page of a block have the same occurrence
vector and form an equivalence class. A class is valid if it has support on most
pages and its tokens come in one order everywhere. The classes that occur once a
page are merged to the template, of which a page's slots are the stretches between
two template tokens; valid classes that lie within one slot throughout are nested in
it as lists or optional parts. As a word of the template may occur in a page's own
text too, pairs of neighbouring words with one occurrence vector are the template's
as well. The ends of slots are moved to those of blocks of text. A slot is
boilerplate if the path above it names a role (``nav``, ``footer``, class ``advert``
and the like), if the words that the template has in it are most of its text, or if
the element begins with a short text of the template that names boilerplate
("Comments"); the remaining slots are the main text: those in article elements where
a page has them, else those in main elements, else all. Where nothing would remain,
or where articles or main elements are the template's for NEAR_COPY of a page's words
in them (near copies of one page), all of it stays.

The template decides about blocks of text and never about single words in them:
nothing of the text of a kept block is dropped. Copies of a page count once. Pages of
blocks too small for a template are cut into slots by their own structural elements.

A host's pages are spread over blocks by a hash of the page and of its place in the input, so that a hot host,
or one page that is repeated, is many blocks; html is shuffled once, and a task holds one block.

Text: character references are decoded, white space (Unicode's, so no-break spaces
and line breaks too) within a block element becomes one space, blocks are joined in
page order by two line feeds. Names in class, id and role mean boilerplate as wholes.

Defined results: null html is empty and gives an empty text; unclosed elements end
with the element above them; a document that is cut short counts up to its end, and
a tag that nothing closes is text; a page takes time, and memory for its tags, in proportion to its length; a
null url has the empty host; repeated pages are extracted alike, row by row; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat
from sys import intern
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import checkpoint
from tessera.llm.url_reputation import host_of

OPEN = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
#: What follows a tag's name; no part of it is tried twice.
REST = re.compile(r"""(?:"[^"]*+"|'[^']*+'|[^>"'])*+>""")
#: Elements whose content is no text of the page.
RAW = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in "script style textarea title template iframe select".split()}
NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+")
NAME = re.compile(r"[^\s]+")
#: Elements that open a path.
STRUCTURE = frozenset("html body head main article section header footer nav aside div form table tbody thead tfoot tr td th ul ol dl figure fieldset details dialog menu button label".split())
#: Elements that end a block of text.
BLOCKS = STRUCTURE | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre hr address figcaption caption summary legend option".split())
#: Elements and roles of boilerplate.
BOILERPLATE = frozenset("head nav header footer aside form button label menu dialog fieldset navigation banner contentinfo complementary search".split())
#: Words in a class or id that name boilerplate.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside related recommended cookie cookies consent gdpr notice banner popup modal overlay newsletter subscribe signup login social share sharing comment comments disqus replies widget pagination pager search skip toolbar".split()
)
#: Words that say nothing beside one of these ("share-box" is boilerplate, "share-price" is not).
PLAIN = frozenset("area bar block bottom box button buttons container content form group icon icons inner left link links list main module outer page panel right section site slot small text title top unit wrap wrapper".split())
#: Of these the ones that still mean boilerplate on an article element, and the ones that do not within one.
ARTICLE_NAMES = frozenset("ad ads advert adverts advertisement sponsored related recommended comment comments disqus replies".split())
ARTICLE_HEADS = frozenset("header masthead banner".split())
LEAST_PAGES, MOST_HOSTS = 3, 100_000
#: Up to how many words a label of the template has.
LABEL_WORDS = 4
#: From this share of an article's or main element's words on the template's words do not decide within it.
NEAR_COPY = 0.8
CONTENT = ("article", "main")


class Slot:
    """A stretch of a page below one path with text: its blocks. ``key`` tells the path, ``depth`` is its length, ``low`` the least length since the slot before, and ``last`` its last tag."""

    __slots__ = ("key", "depth", "low", "last", "role", "blocks")

    def __init__(self, key: int, depth: int, low: int, last: str, role: str):
        self.key, self.depth, self.low, self.last, self.role, self.blocks = key, depth, low, last, role, []


class Open(NamedTuple):
    """An open element: its tag, the path's key, and what it and those above it say."""

    name: str
    tag: str
    key: int
    boilerplate: bool
    article: bool
    main: bool

    @property
    def role(self) -> str:
        return "boilerplate" if self.boilerplate else "article" if self.article else "main" if self.main else ""


TOP = Open("", "", 0, False, False, False)


def markup(source: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Begin, end, name, whether it closes, and attributes of each tag; without a name for comments, declarations and elements whose content is no text.

    One pass: after the first tag that its quotes leave open, tags end at the next
    ``>``, and where none follows the rest is text.
    """
    at, quotes = 0, True
    while (begin := source.find("<", at)) >= 0:
        at = begin + 1
        if source.startswith("<!--", begin):
            end = source.find("-->", begin + 2)
            at = end + 3 if end >= 0 else len(source)
            yield begin, at, "", False, ""
        elif source.startswith(("<!", "<?"), begin):
            at = source.find(">", begin) + 1
            if not at:
                return
            yield begin, at, "", False, ""
        elif m := OPEN.match(source, begin):
            rest = REST.match(source, m.end()) if quotes else None
            quotes = rest is not None
            at = rest.end() if rest else source.find(">", m.end()) + 1
            if not at:
                return
            name, closing = m[1].lower(), source[begin + 1] == "/"
            if name in RAW and not closing:
                close = RAW[name].search(source, at)
                at = close.end() if close else len(source)
                yield begin, at, "", False, ""
            else:
                yield begin, at, name, closing, source[m.end() : at - 1]


def named(name: str, attributes: str, in_article: bool) -> tuple[str, bool]:
    """A tag's token, with the words of its class, id and role, and whether these or its name mean boilerplate."""
    values = [(m[2] or m[3] or m[4] or "").lower() for m in NAMED.finditer(attributes)] if attributes.strip() else []
    words = sorted({w for v in values for w in WORD.findall(v)})
    if name in ("html", "body", "main"):
        names: frozenset = frozenset()
    elif name == "article":
        names = ARTICLE_NAMES
    else:
        names = NAMES | BOILERPLATE
    if in_article:
        names = names - ARTICLE_HEADS
    own = name in BOILERPLATE and not (in_article and name in ARTICLE_HEADS)
    # a name counts as a whole: all its words are boilerplate's or say nothing, one at least the former
    parts = [set(WORD.findall(n)) for v in values for n in NAME.findall(v)]
    meant = any(not names.isdisjoint(p) and p <= names | PLAIN for p in parts)
    return f"{name}.{'.'.join(words)}" if words else name, own or meant


def parsed(source: str) -> tuple[list[tuple], list[Slot]]:
    """A page's tokens (path and tag, or path and word) and its slots. A path's key is a hash of the path above and the tag, which holds within a process."""
    stack, open_names = [TOP], Counter()
    slot: Slot | None = None
    slots, tokens, part, low = [], [], [], 0
    known: dict[tuple, tuple] = {}  # what a tag without class and the like says is worked out once

    def end_block() -> None:
        nonlocal slot, part, low
        if not part:
            return
        text, part = "".join(part), []
        if not text or text.isspace():
            return
        if slot is None:
            top = stack[-1]
            slot = Slot(top.key, len(stack) - 1, low, top.tag, top.role)
            slots.append(slot)
            low = slot.depth
        slot.blocks.append(text)
        tokens.extend(zip(repeat(slot.key), text.split()))

    at, skipped = 0, False
    for begin, end, name, closing, attributes in markup(source):
        if not skipped and at < begin:
            piece = source[at:begin]
            part.append(" " if piece.isspace() else piece)
        at = end
        if not name:
            continue
        if name == "br" and not skipped:
            part.append(" ")
        if name in BLOCKS:
            end_block()
            skipped = False
        if name not in STRUCTURE:  # a paragraph or list item that is named as boilerplate goes up to the next block
            if name in BLOCKS and not closing and attributes.strip():
                skipped = named(name, attributes, stack[-1].article and not stack[-1].boilerplate)[1]
            continue
        if closing:
            if not open_names[name]:
                continue
            while (last := stack.pop()).name != name:
                open_names[last.name] -= 1
            open_names[name] -= 1
            tokens.append((stack[-1].key, intern(f"</{last.tag}>")))
            low = min(low, len(stack) - 1)
        else:
            top = stack[-1]
            said = (name, attributes, top.article)
            if said not in known:
                if len(known) > 1000:
                    known.clear()
                known[said] = named(*said)
            tag, boilerplate = known[said]
            tokens.append((top.key, intern(f"<{tag}>")))
            if not attributes.endswith("/"):
                stack.append(Open(name, intern(tag), hash((top.key, tag)), top.boilerplate or boilerplate, top.article or name == "article", top.main or name == "main"))
                open_names[name] += 1
        slot = None
    if not skipped and at < len(source):
        piece = source[at:]
        part.append(" " if piece.isspace() else piece)
    end_block()
    return tokens, slots


def classes(pages: list[list[tuple]], least: int = 1) -> dict[tuple, list[tuple]]:
    """Occurrence vector (as pairs of page and count) to the tokens (path, token) that share it; of tokens on ``least`` pages or more."""
    counts = [Counter(tokens) for tokens in pages]
    support: Counter = Counter()
    for c in counts:
        support.update(c.keys())
    vectors: dict[tuple, list] = {token: [] for token, n in support.items() if n >= least}
    for i, c in enumerate(counts):
        for token in vectors.keys() & c.keys():
            vectors[token].append((i, c[token]))
    found: dict[tuple, list[tuple]] = defaultdict(list)
    for token, vector in vectors.items():
        found[tuple(vector)].append(token)
    return found


def ordered(members: set, pages: list[list[tuple]], support: list[int]) -> bool:
    """Whether the members come in the same order on all pages that have them."""
    first = None
    for i in support:
        order = [t for t in pages[i] if t in members]
        first = order if first is None else first
        if order != first:
            return False
    return True


def in_order(members: set, pages: list[list[tuple]], support: list[int]) -> set:
    """Of members that occur once a page those that come in one order everywhere: page by page the longest run in the first one's order stays."""
    place, members = None, set(members)
    for i in support:
        order = [t for t in pages[i] if t in members]
        if place is None:
            place = {t: n for n, t in enumerate(order)}
            continue
        ends, last, before = [], [], []
        for n, t in enumerate(order):
            k = bisect_left(ends, place[t])
            before.append(last[k - 1] if k else -1)
            ends[k : k + 1], last[k : k + 1] = [place[t]], [n]
        n, members = (last[-1] if last else -1), set()
        while n >= 0:
            members.add(order[n])
            n = before[n]
    return members


def template(pages: list[list[tuple]]) -> tuple[set, list[set]]:
    """The template's tokens, and the valid classes that are nested within one slot throughout."""
    most = len(pages) / 2
    once, nested = set(), []
    for vector, members in classes(pages, int(most) + 1).items():
        if len(vector) <= most or any(n != vector[0][1] for _, n in vector):  # unequal numbers never come in one order
            continue
        support = [i for i, _ in vector]
        own = set(members)
        if vector[0][1] == 1:
            once |= in_order(own, pages, support)
        elif ordered(own, pages, support):
            nested.append(own)
    kept = []
    for own in nested:  # within one slot: between the same template tokens on a page
        within = True
        for tokens in pages:
            last, places = None, set()
            for token in tokens:
                if token in once:
                    last = token
                elif token in own:
                    places.add(last)
            within &= len(places) <= 1
        if within:
            kept.append(own)
    return once, kept


def pairs(block: str) -> list[tuple[str, str]]:
    """A block's pairs of neighbouring words, its ends included."""
    words = ["", *block.split(), ""]
    return list(zip(words, words[1:]))


def repeated(pages: list[list[Slot]]) -> dict[int, set]:
    """By path the pairs of words that occur equally often, and in one order, on most of the pages, LEAST_PAGES at least."""
    least = max(LEAST_PAGES, len(pages) // 2 + 1)
    read = [[(s.key, pairs(b)) for s in slots for b in s.blocks] for slots in pages]
    support: dict[int, Counter] = defaultdict(Counter)
    for blocks in read:
        by_path: dict[int, set] = defaultdict(set)
        for path, words in blocks:
            by_path[path].update(words)
        for path, words in by_path.items():
            support[path].update(words)
    often = {path: {w for w, n in c.items() if n >= least} for path, c in support.items()}
    found: dict[int, set] = defaultdict(set)
    tokens = [[(path, w) for path, words in blocks if often[path] for w in words if w in often[path]] for blocks in read]
    for vector, members in classes(tokens, least).items():
        if any(n != vector[0][1] for _, n in vector):
            continue
        on, own = [i for i, _ in vector], set(members)
        for path, w in in_order(own, tokens, on) if vector[0][1] == 1 else own if ordered(own, tokens, on) else ():
            found[path].add(w)
    return found


def fixed_words(read: list[tuple[list[tuple], list[Slot]]]) -> list[list[list[int]]]:
    """Per page, slot and block how many of the block's words are the template's: tokens of it, or in pairs of words that repeat."""
    distinct = {tuple([t[1] for t in tokens]): (tokens, slots) for tokens, slots in read if tokens}  # tags make up the paths
    if len(distinct) < LEAST_PAGES:  # copies of one page say nothing about what varies
        return [[[0] * len(s.blocks) for s in slots] for _, slots in read]
    once, nested = template([tokens for tokens, _ in distinct.values()])
    single: dict[int, set] = defaultdict(set)
    for path, word in once.union(*nested):
        single[path].add(word)
    double = repeated([slots for _, slots in distinct.values()])

    def count(slot: Slot, block: str) -> int:
        # in an article a single word that occurs once a page is no evidence without its neighbours
        alone = single.get(slot.key, ()) if slot.role != "article" else ()
        both = double.get(slot.key, ())
        if not alone and not both:
            return 0
        known = [pair in both for pair in pairs(block)]
        return sum(before or after or word in alone for word, before, after in zip(block.split(), known, known[1:]))

    return [[[count(s, b) for b in s.blocks] for s in slots] for _, slots in read]


def labelled(slots: list[Slot], fixed: list[list[int]]) -> set[int]:
    """The slots within elements that begin with a short block of the template that names boilerplate, such as a heading above readers' comments."""
    found, depth = set(), None
    for i, (slot, counts) in enumerate(zip(slots, fixed)):
        if depth is not None and slot.low < depth:
            depth = None
        if depth is None and slot.blocks and slot.depth and slot.last.split(".")[0] not in ("html", "body", *CONTENT):
            words = slot.blocks[0].split()
            if len(words) <= LABEL_WORDS and 2 * counts[0] > len(words) and not ARTICLE_NAMES.isdisjoint(WORD.findall(slot.blocks[0].lower())):
                depth = slot.depth
        if depth is not None:
            found.add(i)
    return found


def main_text(slots: list[Slot], fixed: list[list[int]]) -> str:
    role = next((r for r in CONTENT if any(s.role == r and s.blocks for s in slots)), None)
    below = labelled(slots, fixed)
    kept = [(s, f, i in below) for i, (s, f) in enumerate(zip(slots, fixed)) if s.role != "boilerplate" and s.blocks]
    judged = [(b, n, len(b.split()), label) for s, f, label in kept if role in (None, s.role) for b, n in zip(s.blocks, f)]
    chosen = [b for b, n, words, label in judged if 2 * n <= words and not label]
    # all of it is the template's, or the page's main element is all but a copy of others: what is left is not the text
    if not chosen or role and sum(n for _, n, *_ in judged) >= NEAR_COPY * sum(words for _, _, words, _ in judged):
        chosen = [b for b, *_ in judged]
    blocks = (" ".join(html.unescape(b).split()) for b in chosen)
    return "\n\n".join(b for b in blocks if b)


def extract(sources: list[str]) -> list[str]:
    """The main texts of pages of one host."""
    read = [parsed(s) for s in sources]
    return [main_text(slots, fixed) for (_, slots), fixed in zip(read, fixed_words(read))]


def extracted(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", block_pages: int = 32) -> DataFrame:
    """Per row: the id column, the url, text and n_chars."""
    pages = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    host = host_of(F.col("url"))
    sizes = checkpoint(pages.select(host.alias("h")).groupBy("h").agg(F.ceil(F.count(F.lit(1)) / block_pages).alias("blocks")).where("blocks > 1"))
    if sizes.count() <= MOST_HOSTS:  # some 4 MB; beyond that a join that adaptive execution can split
        sizes = F.broadcast(sizes)
    spread = pages.withColumn("host", host).join(sizes, F.col("host") == F.col("h"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    spread = spread.select("id", "url", "html", "host", F.pmod(F.xxhash64("id", "url", F.monotonically_increasing_id()), F.col("blocks")).alias("block"))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(i, u, h) for b in batches for i, u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())]
        texts = extract([h for *_, h in rows])
        yield pa.RecordBatch.from_arrays([pa.array([i for i, *_ in rows], id_type), pa.array([u for _, u, _ in rows], pa.string()), pa.array(texts, pa.string())], names=["id", "url", "text"])

    id_type = to_arrow_type(df.schema[id_col].dataType)
    found = spread.groupBy("host", "block").applyInArrow(lambda t: pa.Table.from_batches(list(run(t.to_batches()))), f"id {kind}, url string, text string")
    return found.select(F.col("id").alias(id_col), "url", "text", F.char_length("text").cast("long").alias("n_chars"))
