"""Main text of web pages by deducing each host's template from equivalence classes of tokens.

Every page is cut into tokens: structural elements, told apart by the path of elements (with class
and id words) that enclose them, and text blocks at their path. A token's occurrence vector says how
often it occurs on each page of its host; pages of equal text are one page, as copies are no evidence
of a template. Tokens with one vector form an equivalence class; vectors are compared by their sum of
page hashes, so Spark aggregates them without gathering a host's pages anywhere. Only tokens on SUPPORT
of a host's pages, and on two at least, are template candidates: a host has no more of them than
1 / SUPPORT times the tokens of its mean page.

A class is valid if it is ordered and nests:

    ordered   on every page its tokens come in one order, as often as they repeat: t1 .. tk, t1 .. tk
    nested    each such run lies in one occurrence of the nearest enclosing token of another class, and on
              every page in the same gap between that class's tokens

A class that is not valid is taken apart: its elements are classes of their own, as an element alone is
ordered and nests by its path; its texts are no template. The nested classes are the host's template.
Their texts are template text, what else stands under their elements fills slots. The content token is
the outermost `article` or `main` that holds CONTENT_SHARE of the host's slot text, else the deepest
element that holds NEARLY all of it: element names are only a prior, the text in the slots decides.

From each page the slots under the content token are taken, whole, with the template text among them.
Where no `article` or `main` bounds the content, its core is the deepest element that holds CONTENT_SHARE
of the slot text: elements beside the core that no page fills with text of its own (a site's name, its
lines of links and of copyright, whatever they are called) go; template text in elements that pages do
fill, and directly in the content token, stays.
On a page without the content token (or on a host without one) all slots are taken, but no template
text unless the page has no other. Furniture is left out by element, role and `hidden`, or by a class
or id that names nothing else ("comments", "ad-box", but not "share-price"); an element whose name
only hints at furniture goes if all its text is template text. A page that would be left empty shows
what a class, id or `form` alone has hidden, if most of its text is there. A host of one text is its
own template, of its elements alone.

Scripts, styles, templates, titles, `noscript` and `iframe` markup, and the fields of forms hold no text.
Character references are decoded, white space inside a block becomes one space (a line break too),
blocks are trimmed and joined in page order by one line feed.

Defined results. A null html is empty and gives the empty text. Pages without a host share the host
"". Rows that repeat a page each get its text; markup that never closes ends with its page. Of content
tokens that tie in depth the first path by code point counts. A very long page is parsed as a whole, by
itself; it weighs as one page. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import BROADCAST_BYTES, written
from .url_filter import host

#: Share of a host's pages that a template token stands on.
SUPPORT = 0.5
#: Share of the slot text that an `article` or `main` must hold to be the content token, and any other element.
CONTENT_SHARE, NEARLY = 0.6, 0.95
#: Parts in which a hot host's pages meet its template where templates are too large to be broadcast.
SALTS = 16

# Elements whose text is never shown, elements that break lines, elements that build the page.
RAW = "script|style|noscript|template|iframe|textarea|title|select"
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
STRUCTURE = frozenset("article aside body details dialog div dl fieldset figure footer form head header html main menu nav ol section table td ul".split())
# Furniture by element, by role, and by word of class or id; words that only say what kind of box it is.
FURNITURE_TAGS = frozenset("aside button dialog footer head menu nav".split())
FURNITURE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login menu modal nav navbar navigation newsletter notice notification notifications pager pagination paywall popup promo promoted promotion recommended related replies reply share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
BOX_WORDS = frozenset("area articles bar block bottom box button buttons container content form group header icons inner item items left link links list main mobile outer overlay panel post posts right section site slot stories thread top unit wrap wrapper".split())
#: Headers are furniture outside the content, and part of it inside.
HEADER_TAGS, HEADER_WORDS = frozenset(["header"]), frozenset(["header", "masthead"])
CONTENT_TAGS = ("article", "main")
#: Never furniture by a class or id word; tags that do not end an open head.
WHOLE_TAGS = frozenset(["html", "body", *CONTENT_TAGS])
HEAD_PARTS = frozenset("html head base basefont bgsound link meta".split())

ATTRIBUTES = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b{ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({ATTRIBUTES})>|<[!?/][^>]*>", re.S | re.I)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
WORD = re.compile(r"[a-z0-9]+")


def described(tag: str, attributes: str) -> tuple[str, bool, bool, int]:
    """(name with class and id words, furniture, header, hint) of an element. hint: 2 named as furniture and nothing else, 1 in part, 3 as a header."""
    names, role, hidden = [], "", False
    for name, *values in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), "".join(values)
        if name == "role":
            role = value.strip().lower()
        elif name in ("class", "id"):
            names += [WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", x).lower()) for x in value.split()]
        else:
            hidden = hidden or name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true")
    furniture = hidden or tag in FURNITURE_TAGS or role in FURNITURE_ROLES
    words = {w for x in names for w in x if not w.isdigit()}  # numbers vary from page to page
    hint = 2 if tag == "form" else 0
    if tag not in WHOLE_TAGS and not hint:
        named = [{w for w in x if not w.isdigit()} for x in names]
        if any(not FURNITURE_WORDS.isdisjoint(x) and x <= FURNITURE_WORDS | BOX_WORDS for x in named):
            hint = 2
        elif any(not HEADER_WORDS.isdisjoint(x) and x <= HEADER_WORDS | BOX_WORDS for x in named):
            hint = 3
        elif not FURNITURE_WORDS.isdisjoint(words):
            hint = 1
    return ".".join([tag, *sorted(words)]), furniture, tag in HEADER_TAGS, hint


#: What is known where a token stands: its path, whether that is furniture, and the enclosing paths named as furniture, and only in part.
Place = tuple[str, bool, tuple[str, ...], tuple[str, ...]]


def parsed(page: str) -> Iterator[tuple[str, str, Place]]:
    """("tag", element) where structure opens and ("text", block), in page order."""
    stack: list[tuple[str, Place]] = []
    block: list[str] = []
    inside_content = 0
    at = 0

    def top() -> Place:
        return stack[-1][1] if stack else ("", False, (), ())

    def flush():
        text = " ".join(html.unescape("".join(block)).split())
        block.clear()
        if text and stack and stack[-1][0] == "head":
            stack.pop()  # text ends a head whose end is left out
        return [("text", text, top())] if text else []

    for m in TOKEN.finditer(page):
        block.append(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag == "br":
            block.append(" ")
            continue
        if tag in BLOCKS:
            yield from flush()
        if stack and stack[-1][0] == "head" and not m[2] and tag not in HEAD_PARTS:
            stack.pop()  # so does any other element
        if tag == "button" and not m[2]:
            path, _, named, hinted = top()
            stack.append((tag, (f"{path}/button", True, named, hinted)))
        elif tag in STRUCTURE and not m[2]:
            name, furniture, header, hint = described(tag, m[4])
            above, out, named, hinted = top()
            path = f"{above}/{name}"
            if hint == 2 or (hint == 3 and not inside_content):
                named = (*named, path)
            elif hint == 1:
                hinted = (*hinted, path)
            stack.append((tag, (path, out or furniture or (header and not inside_content), named, hinted)))
            inside_content += tag in CONTENT_TAGS
            yield "tag", tag, stack[-1][1]
        elif m[2] and any(s[0] == tag for s in stack):
            while True:
                last = stack.pop()[0]
                inside_content -= last in CONTENT_TAGS
                if last == tag:
                    break
    block.append(page[at:])
    yield from flush()


def above(path: str) -> Iterator[str]:
    """A path and those that enclose it."""
    while path:
        yield path
        path = path.rpartition("/")[0]


def key(kind: str, path: str, value: str = "") -> int:
    """A token's number: of an element its path, of a text its path and words."""
    import xxhash

    number = xxhash.xxh64_intdigest(f"{kind}\x00{path}\x00{value if kind == 'text' else ''}")
    return number - (1 << 64) if number >> 63 else number


#: The token that stands for a page itself.
PAGE = 0
TOKENS = "host string, page long, token long, is_text boolean, path string, places array<int>, chars long"


@kernels.tidy
def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) -> a row for each page and token: the places where it stands, and the characters of text that it holds. A page is named by its text."""
    names = [x.split()[0] for x in TOKENS.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.int32()), pa.int64()]
    for batch in batches:
        rows: list[tuple] = []
        for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own: dict[int, list] = {PAGE: [False, "", [0], 0]}
            shown = []
            for place, (kind, value, (path, out, named, _)) in enumerate(parsed(page or "")):
                if out and (kind == "text" or own.get(key("tag", path.rpartition("/")[0]), (0, 0, 0, 0, True))[-1]):
                    continue  # of furniture only the outermost element is a token
                entry = own.setdefault(key(kind, path, value), [kind == "text", path, [], 0, out])
                entry[2].append(place)
                if kind == "text":
                    shown.append(value)
                    for upper in above(path) if not named else ():  # every enclosing element holds the text
                        if (held := own.get(key("tag", upper))) is not None:
                            held[3] += len(value)
                    entry[3] += 0 if named else len(value)
            number = key("page", "\n".join(shown))
            rows += [(name, number, token, *entry[:4]) for token, entry in own.items()]
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def runs(stood: list[tuple[int, int]]) -> tuple[int, list[list[int]]]:
    """(place, token) in order of place -> the hash of the order in which the class's tokens repeat, 0 if they do not, and the places of each run."""
    sequence = [token for _, token in stood]
    k = len(set(sequence))
    if len(sequence) % k or any(t != sequence[i % k] for i, t in enumerate(sequence)):
        return 0, []
    places = [place for place, _ in stood]
    return hash(tuple(sequence[:k])) or 1, [places[i : i + k] for i in range(0, len(places), k)]


RELATED = "host string, vector long, sequence long, gap int, parent long"
#: Where a class stands that has no other class above it.
OUTERMOST = 0


def related(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, tokens: vector, token, path, is_text, places of a page) -> a row a class: its order, and where in which class it stands."""
    for batch in batches:
        rows = []
        for name, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            element = {t["path"]: t for t in tokens if not t["is_text"]}
            by: dict[int, list[dict]] = defaultdict(list)
            for t in tokens:
                by[t["vector"]].append(t)
            order = {v: runs(sorted((p, t["token"]) for t in own for p in t["places"])) for v, own in by.items()}
            for v, own in by.items():
                sequence, each = order[v]
                # The nearest element of another class that encloses all tokens of this one.
                shared = set.intersection(*(set(above(t["path"] if t["is_text"] else t["path"].rpartition("/")[0])) for t in own))
                around = next((element[p] for p in sorted(shared, key=len, reverse=True) if p in element and element[p]["vector"] != v), None)
                gap, parent = 0, OUTERMOST
                if around is not None and sequence:
                    parent = around["vector"]
                    within = {bisect_right(around["places"], place) for run in each for place in (run[0], run[-1])}
                    inside = all(bisect_right(around["places"], run[0]) == bisect_right(around["places"], run[-1]) for run in each)
                    whole = [p for run in order[parent][1] for p in run]
                    k = len(by[parent])
                    gaps = {bisect_right(whole, place) % k for run in each for place in (run[0], run[-1])}
                    gap = gaps.pop() if inside and len(gaps) == 1 and 0 not in within else -1
                rows.append((name, v, sequence, gap, parent))
        names = [x.split()[0] for x in RELATED.split(", ")]
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64()], strict=True)], names)


def deduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, tokens: token, path, is_text, chars, valid) of a host -> host, content, texts, still: its template."""
    for batch in batches:
        contents, listed, still = [], [], []
        for tokens in batch.column(1).to_pylist():
            own = [t for t in tokens if t["token"] != PAGE and (t["valid"] or not t["is_text"])]
            held: Counter[str] = Counter({t["path"]: t["chars"] for t in own if not t["is_text"]})
            for t in own:  # template text fills no slot
                if t["is_text"]:
                    for p in above(t["path"]):
                        held[p] -= t["chars"]
            elements = [(t["path"], t["path"].count("/"), t["path"].rpartition("/")[2].partition(".")[0]) for t in own if not t["is_text"] and held[t["path"]] > 0]
            most = max((held[p] for p, _, _ in elements), default=0)
            named = [(depth, p) for p, depth, tag in elements if tag in CONTENT_TAGS and held[p] >= CONTENT_SHARE * most]
            nearly = [(-depth, p) for p, depth, _ in elements if held[p] >= NEARLY * most]
            content = min(named or nearly, default=(0, None))[1]
            core = None if named or not nearly else min((-depth, p) for p, depth, _ in elements if held[p] >= CONTENT_SHARE * most)[1]
            contents.append(content)
            listed.append(sorted(t["token"] for t in own if t["is_text"]))
            still.append(beside([t["path"] for t in own if not t["is_text"] and held[t["path"]] <= 0], content, core))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(contents, pa.string()), pa.array(listed, pa.list_(pa.int64())), pa.array(still, pa.list_(pa.string()))], ["host", "content", "texts", "still"])


def beside(unfilled: list[str], content: str | None, core: str | None) -> list[str]:
    """The outermost of the unfilled elements under the content token that are neither in its core nor around it."""
    if core is None:
        return []
    found = {p for p in unfilled if p.startswith(f"{content}/") and not core.startswith(f"{p}/") and not f"{p}/".startswith(f"{core}/")}
    return sorted(p for p in found if found.isdisjoint(list(above(p))[1:]))


def templates(pages: DataFrame) -> DataFrame:
    """pages (host, html) -> host, content string, texts array<long>, still array<string>: each host's template, written."""
    rows = pages.select("host", "html").mapInArrow(tokenized, TOKENS)
    # Pages of equal text are one page.
    each = rows.groupBy("host", "page", "token").agg(F.max("is_text").alias("is_text"), F.max("path").alias("path"), F.min("places").alias("places"), F.max("chars").alias("chars"))
    each = written(each, "page-tokens")
    by = each.groupBy("host", "token").agg(
        F.max("is_text").alias("is_text"), F.max("path").alias("path"), F.count(F.lit(1)).alias("n_pages"), F.sum("chars").alias("chars"),
        F.sum(F.pmod(F.xxhash64("page", F.size("places")), F.lit(1 << 32))).alias("vector"),
    )
    sizes = by.where(F.col("token") == PAGE).select("host", F.col("n_pages").alias("pages"))
    enough = (F.col("n_pages") >= F.lit(SUPPORT) * F.col("pages")) & (F.col("n_pages") >= F.least(F.lit(2), F.col("pages")))
    # Of one text nothing tells a template's blocks from its own.
    by = written(by.join(sizes, "host").where(enough & (~F.col("is_text") | (F.col("pages") > 1))).drop("pages", "n_pages"), "host-tokens")
    marked = each.select("host", "page", "token", "places").join(by.select("host", "token", "vector", "path", "is_text"), ["host", "token"]).where(F.col("token") != PAGE)
    laid = marked.groupBy("host", "page").agg(F.collect_list(F.struct("vector", "token", "path", "is_text", "places")).alias("tokens"))
    found = laid.select("host", "tokens").mapInArrow(related, RELATED)
    classes = found.groupBy("host", "vector").agg(*(f(c).alias(f"{n}_{c}") for c in ("sequence", "gap", "parent") for n, f in (("least", F.min), ("most", F.max))))
    ordered = (F.col("least_sequence") == F.col("most_sequence")) & (F.col("least_sequence") != 0) & (F.col("least_gap") == F.col("most_gap")) & (F.col("least_gap") >= 0) & (F.col("least_parent") == F.col("most_parent"))
    by = by.join(classes.select("host", "vector", ordered.alias("valid")), ["host", "vector"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))
    hosts = by.groupBy("host").agg(F.collect_list(F.struct("token", "path", "is_text", "chars", "valid")).alias("tokens"))
    return written(hosts.mapInArrow(deduced, "host string, content string, texts array<long>, still array<string>"), "templates")


def taken(page: str, content: str | None, texts: set[int], still: set[str]) -> list[str]:
    """The blocks of a page that fill its host's slots."""
    found = [(value, *place) for kind, value, place in parsed(page) if kind == "text" and not place[1]]
    standing = [key("text", path, value) in texts for value, path, *_ in found] if texts else [False] * len(found)
    varied = {p for (_, _, _, _, hinted), still in zip(found, standing, strict=True) if not still for p in hinted}
    # An element that only hints at furniture goes if all of its text is the template's.
    blocks = [(value, path, still, named) for (value, path, _, named, hinted), still in zip(found, standing, strict=True) if not texts or varied.issuperset(hinted)]
    shown = [b for b in blocks if not b[3]]
    if blocks and not shown:
        least, held = CONTENT_SHARE * sum(len(b[0]) for b in blocks), Counter()
        for value, _, _, named in blocks:
            for p in {*named}:
                held[p] += len(value)
        shown = [b for b in blocks if all(held[p] >= least for p in b[3])]
    inside = [b for b in shown if content and (b[1] == content or b[1].startswith(f"{content}/"))]
    # Of elements beside the core that no page fills the template text goes.
    filled = [b for b in inside if not (b[2] and any(p in still for p in above(b[1])))] if still else inside
    kept = filled or inside or [b for b in shown if not b[2]] or shown
    return [b[0] for b in kept]


def extractor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, html, content, texts, still) -> (page_id, url, text): the blocks in kept slots."""
    for batch in batches:
        result = ["\n".join(taken(page or "", content, set(texts or ()), set(still or ()))) for page, content, texts, still in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(result, pa.string())], ["page_id", "url", "text"])


def extracted(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars."""
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    known = templates(rows.select("host", "html")).withColumnRenamed("host", "of")
    taken_bytes = known.agg(F.sum(F.octet_length("of") + F.coalesce(F.octet_length("content"), F.lit(0)) + 8 * F.size("texts") + F.octet_length(F.array_join("still", " ")) + 64)).first()[0] or 0
    if taken_bytes <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(known), F.col("host") == F.col("of"), "left")
    else:  # a hot host's pages are dealt to SALTS tasks
        salted = known.withColumn("part", F.explode(F.array(*map(F.lit, range(SALTS)))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        rows = rows.join(salted, (F.col("host") == F.col("of")) & (F.col("salt") == F.col("part")), "left")
    types = {f.name: f.dataType.simpleString() for f in pages.schema}
    found = rows.select("page_id", "url", "html", "content", "texts", "still").mapInArrow(extractor, f"page_id {types['page_id']}, url string, text string")
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
