"""Main text of HTML pages by equivalence-class template deduction.

A page is read into tokens: container tags by their path, and pieces of text by
path and hash. Two tokens of a host belong to one equivalence class when they
have the same occurrence vector (how often they occur on each of the host's
pages). The vector is never built: its hash, an exclusive-or of hashes of
(page, count), is a plain aggregate, so a host with a third of all pages costs
no more than any other. Equal pages of a host count once.

A class is valid when its tokens occur on at least ``SUPPORT`` of the host's
pages (``LEAST_PAGES`` at least) and when it nests: the parent of each of its
containers is in the class or in a valid class that encloses it. Valid classes
make the host's template; what the template leaves open are its slots. Frequent
tokens of a host are few (their occurrences fill half its pages), so its
template is built in one small group.

The template's main container, the one that holds most of the host's slot text,
decides where a page's main text is. An ``article`` or ``main`` element is a hint
for its bounds: one that lies in that container or around it is the main text as a
whole (repeated passages in it are prose), one elsewhere is not. Without such an
element the main text is the slots in the container. A page that lacks the container
has the blocks of its ``article`` or ``main``, or else its slots; a host without a
template has no template texts, so there that is all blocks.
Menus, headers, footers, sidebars, notices, adverts, forms, comments by
readers, scripts and styles are left out by element, role and class name
(a header inside the article belongs to it). Inside an article names and ``aside``
are only a suspicion: see ``left_out``.

Text is decoded and its white space made single; blocks are joined by an empty
line in page order.

Defined cases: a null or empty page gives an empty text. A null or odd address
makes one host of its own. Unclosed tags end with their parents; unclosed
comments and scripts run to the end of the page. Any depth of nesting is read in
linear time; containers below a path of ``LONG_PATH`` characters are told apart by
hashes and nest in the last one above. Repeated rows give equal texts. An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdikt.llm.common import arrow_udf, col, prepare, salted_lookup, saved, table, utf8

# Characters of a path and of a class in it; beyond, hashes stand for them.
LONG_PATH = 2048
LONG_CLASS = 40
TOKEN_BATCH = 1 << 15

SUPPORT = 0.5
LEAST_PAGES = 4
MAIN_SHARE = 0.6

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
LEAVES = {"p", "li", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "tr", "hr", "caption", "legend", "option", "figcaption", "summary", "pre", "br"}
# Elements that another start of the same kind closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
LEFT_OUT = {"nav", "footer", "aside", "form", "menu", "dialog", "select", "button", "head", "template", "svg", "canvas", "object", "fieldset", "search", "audio", "video"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "form", "menu", "menubar", "toolbar", "note"}
NAMES = set(
    "ad ads adbox adslot adunit advert adverts advertisement advertising adsense alert alerts announcement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer gdpr masthead menu menus modal nav navbar navigation newsletter notice notices notification outbrain overlay pagination pager popup promo promoted promotion related replies share sharing sidebar social sponsor sponsored subscribe subscription taboola teaser toast toolbar widget widgets".split()
)

OTHER_ARTICLES = set("ad ads advert adverts advertisement comment comments promo promoted related replies sponsor sponsored teaser".split())
READERS = {"comment", "comments", "replies"}


def attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)} if rest.strip() else {}


def left_out(tag: str, attrs: dict[str, str], inside: bool) -> str:
    """Is this element no part of the main text? "" (it may be), "out", or a
    suspicion for elements inside the article: "named" (``aside``, ``fieldset``, or a
    whole class or id is a known name) is left out unless the host's template
    shows that it doesn't repeat; "like" (a word of a class is one) is left out
    only if its text belongs to the template."""
    if tag in LEFT_OUT and not (inside and tag in ("aside", "fieldset")) or (tag == "header" and not inside):
        return "out"
    if attrs and ("hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in ROLES):
        return "out"
    if tag in LEFT_OUT:
        return "named"
    if not attrs or tag in ("html", "body", "main"):
        return ""
    # An article is an article unless it is named as somebody else's.
    names = OTHER_ARTICLES if tag == "article" else NAMES
    words = lambda x: re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", x).lower())
    classes, own = attrs.get("class", ""), attrs.get("id", "")
    if not inside:
        return "out" if any(w in names for w in words(f"{classes} {own}")) else ""
    # Ids of headings, paragraphs and sections name their subject.
    known = READERS if tag == "section" else set() if tag in LEAVES else names
    if names.intersection(classes.lower().split()) or own.lower() in known:
        return "named"
    return "like" if any(w in names for w in words(classes)) else ""


class Block(NamedTuple):
    path: str  # of its containers
    text: str  # empty: a container
    out: bool  # left out
    article: str | None  # path of the article or main it is in
    doubt: tuple[str, str] | None  # (path, suspicion) of the outermost suspect element inside the article


def below(path: str, tag: str, classes: str) -> str:
    """The path of a container in the one at ``path``. A path is as long as the
    nesting is deep, so beyond ``LONG_PATH`` a hash chain takes the place of its
    further containers: it names one path still, as a part of the last container
    that is written out."""
    if len(classes) > LONG_CLASS:
        classes = xxhash.xxh64_hexdigest(classes)
    part = f"/{tag}.{classes}" if classes else f"/{tag}"
    folded = path[-18:-16] == "/~"
    if not folded and len(path) + len(part) <= LONG_PATH:
        return path + part
    return f"{path[:-18] if folded else path}/~{xxhash.xxh64_hexdigest(path[-16:] + part if folded else part)}"


def blocks(page: str) -> Iterator[Block]:
    """The page's blocks, in page order; containers come as blocks without text."""
    stack: list[tuple] = []  # tag, then path, out, article, doubt
    spots: dict[str, list[int]] = defaultdict(list)  # tag -> where it is on the stack
    text: list[str] = []
    top = ("", False, None, None)
    path, out, article, doubt = top

    def closed() -> Iterator[Block]:
        if text:
            s = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if s:
                yield Block(path, s, out, article, doubt)

    def cut(size: int) -> None:
        while len(stack) > size:
            spots[stack.pop()[0]].pop()

    def nearest(tags: set[str]) -> int:
        return max((spots[t][-1] for t in tags if spots[t]), default=-1)

    at = 0
    while True:
        m = TOKEN.search(page, at)
        if m is None:
            text.append(page[at:])
            yield from closed()
            return
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["end"] or m["end2"]:
            if tag in BLOCKS:
                yield from closed()
            if spots[tag]:
                cut(spots[tag][-1])
                path, out, article, doubt = stack[-1][1:] if stack else top
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID:
            if tag in BLOCKS:
                yield from closed()
            continue
        if tag not in BLOCKS and tag not in LEFT_OUT:
            continue  # inline mark-up
        yield from closed()
        if stack and stack[-1][0] == "p":
            cut(len(stack) - 1)
        if tag in CLOSES and nearest(CLOSES[tag]) > nearest(SCOPE[tag]):
            cut(nearest(CLOSES[tag]))
        path, out, article, doubt = stack[-1][1:] if stack else top
        attrs = attributes(m["rest"] or m["rest2"] or "")
        verdict = left_out(tag, attrs, article is not None)
        out = out or verdict == "out"
        if tag not in LEAVES:
            path = below(path, tag, attrs.get("class", ""))
        if verdict in ("named", "like") and (doubt is None or doubt[1] == "like" and verdict == "named"):
            doubt = (path if tag not in LEAVES else "", verdict)
        if article is None and (tag in ("article", "main") or attrs.get("role") == "main") and not out:
            article = path
        if tag not in LEAVES:
            yield Block(path, "", out, article, doubt)
        spots[tag].append(len(stack))
        stack.append((tag, path, out, article, doubt))


def text_token(path: str, text: str) -> str:
    return f"{path}#{xxhash.xxh64_hexdigest(text)}"


def page_tokens(page: str) -> dict[str, list]:
    """token -> [count, first place, characters of the text below a container]."""
    found: dict[str, list] = {}
    for place, (path, text, out, _, doubt) in enumerate(blocks(page)):
        token = text_token(path, text) if text else path
        found.setdefault(token, [0, place, 0])[0] += 1
        if text and not out and not doubt and path in found:
            found[path][2] += len(text)
    return found


TOKENS = "host string, page long, token string, times long, place long, chars long"


def token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, html) -> the page's tokens."""
    names = [x.split()[0] for x in TOKENS.split(", ")]
    batch = lambda cols: pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("host", "token") else pa.int64()) for c, n in zip(cols, names)], names=names)
    for b in batches:
        cols: list[list] = [[] for _ in names]
        for host, page, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2))):
            for token, (times, place, chars) in page_tokens(html.decode("utf-8", "replace")).items():
                for c, v in zip(cols, (host, page, token, times, place, chars)):
                    c.append(v)
                if len(cols[0]) >= TOKEN_BATCH:
                    yield batch(cols)
                    cols = [[] for _ in names]
        yield batch(cols)


def deduce(tokens: list[tuple[str, int, int, float, int]]) -> tuple[str | None, list[str]]:
    """(main container, template texts) from a host's frequent tokens: (token,
    vector hash, pages, mean place, characters)."""
    valid = valid_tokens(tokens)
    return main_container(tokens, valid), sorted(t for t in valid if "#" in t)


def valid_tokens(tokens: list[tuple[str, int, int, float, int]]) -> set[str]:
    """The tokens of the valid classes."""
    classes: dict[tuple[int, int], list] = defaultdict(list)
    for t in sorted(tokens, key=lambda t: (t[3], t[0])):
        classes[t[1], t[2]].append(t)
    valid: set[str] = set()
    # Classes on more pages enclose those on fewer.
    for (_, _), members in sorted(classes.items(), key=lambda c: (-c[0][1], c[1][0][3])):
        own = {t[0] for t in members if "#" not in t[0]}
        parents = [p.rpartition("/")[0] for p in own] + [t[0].partition("#")[0] for t in members if "#" in t[0]]
        if all(p == "" or p in own or p in valid for p in parents):
            valid |= {t[0] for t in members}
    return valid


def main_container(tokens: list[tuple[str, int, int, float, int]], valid: set[str]) -> str | None:
    containers = {t[0]: t[4] for t in tokens if t[0] in valid and "#" not in t[0]}
    # Characters below a container's path, itself included.
    held: Counter = Counter()
    for p, n in containers.items():
        while p:
            held[p] += n
            p = p.rpartition("/")[0]
    total = sum(containers.values())
    good = [p for p in containers if total and held[p] >= MAIN_SHARE * total]
    return max(good, key=lambda p: (p.count("/"), p), default=None)


def host_template(group: pd.DataFrame) -> pd.DataFrame:
    rows = list(group[["token", "vector", "pages", "place", "chars"]].itertuples(index=False, name=None))
    main, texts = deduce(rows)
    frames = sorted(t for t in valid_tokens(rows) if "#" not in t)
    return pd.DataFrame({"host": [group["host"].iloc[0]], "main": [main], "texts": [texts], "frames": [frames]})


def templates(pages: DataFrame) -> DataFrame:
    """(host, main, texts, frames) per host, from rows (host, html); frames are
    the containers of the template."""
    distinct = pages.where("html != ''").select("host", F.xxhash64("html").alias("page"), "html")
    tokens = saved(distinct.mapInArrow(token_rows, TOKENS), "tokens")
    # Equal pages count once: their rows are equal too.
    once = tokens.groupBy("host", "token", "page").agg(F.max("times").alias("times"), F.max("place").alias("place"), F.max("chars").alias("chars"))
    seen = once.groupBy("host", "token").agg(
        F.bit_xor(F.xxhash64("page", "times")).alias("vector"), F.count("*").alias("pages"), F.avg("place").alias("place"), F.sum("chars").alias("chars")
    )
    # Each page has one token that all its pages share or it has no container at all.
    whole = tokens.where("place = 0").groupBy("host", "page").agg(F.lit(1).alias("x")).groupBy("host").agg(F.count("*").alias("whole"))
    seen = seen.where(F.col("pages") >= LEAST_PAGES)
    frequent = seen.join(whole, "host").where(F.col("pages") >= F.col("whole") * SUPPORT)
    return frequent.groupBy("host").applyInPandas(host_template, "host string, main string, texts array<string>, frames array<string>")


def dropped(b: Block, texts: set[str], frames: set[str] | None) -> bool:
    """Is a block left out? A suspicion inside the article needs a template
    that confirms it; a host without one has only the whole names."""
    if b.out or not b.doubt:
        return b.out
    path, kind = b.doubt
    if frames is None:
        return kind == "named"
    return text_token(b.path, b.text) in texts or (kind == "named" and path in frames)


def main_text(page: str, main: str | None, texts: set[str], frames: set[str] | None = None) -> str:
    """``frames`` is None for a host without a template."""
    found = [b for b in blocks(page) if b.text and not dropped(b, texts, frames)]
    within = lambda a, b: a == b or a.startswith(b + "/")
    slots = [b for b in found if text_token(b.path, b.text) not in texts]
    kept = []
    if main is not None:
        kept = [b for b in found if b.article is not None and (within(b.article, main) or within(main, b.article))]
        kept = kept or [b for b in slots if within(b.path, main)]
    kept = kept or [b for b in found if b.article is not None] or slots
    return "\n\n".join(b.text for b in kept)


def text_udf():
    def extract(pages: pa.Array, mains: pa.Array, texts: pa.Array, frames: pa.Array) -> pa.Array:
        known: dict[tuple, set[str]] = {}
        as_set = lambda x: x if x is None else known.setdefault(tuple(x), set(x))
        out = []
        for page, main, t, f in zip(utf8(pages), mains.to_pylist(), texts.to_pylist(), frames.to_pylist()):
            out.append(main_text((page or b"").decode("utf-8", "replace"), main, as_set(t or []), as_set(f or None)))
        return pa.array(out, pa.string())

    return arrow_udf(extract, "string")


def host_of(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def extract_text(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``_row`` (the input row) and its main text."""
    prepare(pages.sparkSession)
    plain = F.coalesce(col(html).cast("string"), F.lit(""))
    known = saved(templates(pages.select(host_of(col(url)).alias("host"), plain.alias("html"))), "templates")
    rows = pages.select(F.struct(*[col(c) for c in pages.columns]).alias("_row"), host_of(col(url)).alias("host"), plain.alias("html"))
    # A small template table is broadcast by the planner's size check, a large one joined with salts.
    x = salted_lookup(rows, known, ["host"])
    return x.select("_row", text_udf()("html", "main", "texts", "frames").alias("text"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return x.select("_row.page_id", "_row.url", "text", F.length("text").cast("long").alias("n_chars"))
