"""Main text of web pages: wrappers inferred from pages of the same host say where the article stands."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, shuffle_partitions
from tidemark.llm.url_filters import url_parts

#: Pages of a host that its wrapper is inferred from.
SAMPLE = 12
#: Wrappers of this many characters in all are broadcast; more are joined by a shuffle. Both give the same rows.
BROADCAST_CHARS = 4_000_000

_RAW = "script|style|noscript|template|textarea|svg|iframe|title"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>{_RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_NAME = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that an open paragraph doesn't outlive.
_ENDS_P = _BLOCK - frozenset("html body td th".split())
_APART = frozenset("nav footer aside form button select head dialog menu".split())
_APART_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo sponsor sponsored cookie cookies consent notice newsletter subscribe"
    " popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar footer comment comments reply replies respond disqus"
    " share sharing social related recommended widget login signup search pagination toolbar".split()
)


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, data): start, end and text tokens. Comments, scripts and the like, and a tag cut off by the end of
    the page, are left out; names of a start tag's class, id and role are its data."""
    for m in _TOKEN.finditer(html):
        if m["text"]:
            yield "text", "", m["text"]
        elif m["tag"]:
            if m[0][-1] != ">":
                continue
            tag = m["tag"].lower()
            names = " ".join("".join(x) for x in _NAME.findall(m["attrs"])).lower() if m["attrs"] else ""
            yield ("end" if m["end"] else "start"), tag, names


def is_apart(tag: str, names: str, stack: list[str]) -> bool:
    """Whether an element holds no article text: by its tag, or by a word of its class, id or role."""
    if tag in _APART or tag == "header" and not any(x.startswith(("article", "main")) for x in stack):
        return True
    return bool(names) and tag not in ("html", "body", "article", "main") and not _APART_NAMES.isdisjoint(re.split(r"[^a-z]+", names))


def walk(html: str, trusted: tuple[str, ...] = ()) -> Iterator[tuple[str, tuple[str, ...], bool, str]]:
    """(kind, path, apart, data) in page order: kind text or break; path: the open elements, each with its names; apart:
    an element above holds no article text. Unclosed elements end where an outer one does. What lies on the path `trusted`
    isn't apart, whatever its names."""
    stack: list[str] = []
    tags: list[str] = []
    apart: list[bool] = []
    for kind, tag, data in tokens(html):
        if kind == "text":
            yield "text", tuple(stack), bool(apart) and apart[-1], data
            continue
        if tag in _BLOCK:
            yield "break", tuple(stack), bool(apart) and apart[-1], ""
        if kind == "start":
            if tag in _ENDS_P and "p" in tags:
                at = len(tags) - 1 - tags[::-1].index("p")
                if not any(t in ("div", "td", "table", "section", "article", "li") for t in tags[at:]):
                    del stack[at:], tags[at:], apart[at:]
            if tag not in _VOID:
                stack.append(f"{tag}.{data}" if data else tag)
                tags.append(tag)
                known = len(stack) <= len(trusted) and trusted[: len(stack)] == tuple(stack)
                apart.append(not known and (bool(apart) and apart[-1] or is_apart(tag, data, stack[:-1])))
        elif tag in tags:
            at = len(tags) - 1 - tags[::-1].index(tag)
            del stack[at:], tags[at:], apart[at:]


# The union-free expression: a list of ("tag", name), ("text", constant or None for a slot), ("rep", tuple), ("opt", tuple).


Spans = list[tuple[int, ...]]


def _placed(html: str) -> tuple[list[tuple], Spans]:
    """One page as an expression, and for each node the numbers of the page's text tokens that it holds."""
    nodes: list[tuple] = []
    spans: Spans = []
    number = 0
    for kind, tag, data in tokens(html):
        if kind == "text":
            if data.strip():
                nodes.append(("text", " ".join(data.split())))
                spans.append((number,))
            number += 1
        else:
            nodes.append(("tag", ("/" if kind == "end" else "") + tag + ("." + data if data else "")))
            spans.append(())
    return _folded(nodes, spans)


def stream(html: str) -> list[tuple]:
    """One page as an expression: its tags and texts, with runs of equal groups folded into repeated ones."""
    return _placed(html)[0]


def _shape(node: tuple) -> tuple:
    """What two nodes must share to be aligned: texts always match, as a slot."""
    if node[0] == "text":
        return ("text",)
    return (node[0], tuple(map(_shape, node[1]))) if node[0] in ("rep", "opt") else node


def _slots(nodes: list[tuple]) -> tuple:
    return tuple(("text", None) if n[0] == "text" else n for n in nodes)


def _distance(shapes: list[tuple], beyond: int) -> int:
    """The least distance above `beyond` at which a start tag comes again; 0 if there is none."""
    last: dict[tuple, int] = {}
    best = 0
    for i, x in enumerate(shapes):
        if x[0] != "text" and not (x[0] == "tag" and x[1][0] == "/"):
            d = i - last.get(x, i)
            if d > beyond and (not best or d < best):
                best = d
            last[x] = i
    return best


def _folded(nodes: list[tuple], spans: Spans) -> tuple[list[tuple], Spans]:
    """nodes with each group that follows itself made a repeated group, shorter groups first; groups have any length."""
    shapes, size = [_shape(n) for n in nodes], 0
    while size := _distance(shapes, size):
        out, held, i = [], [], 0
        while i < len(nodes):
            j = i + size
            while j + size <= len(nodes) and shapes[j : j + size] == shapes[i : i + size]:
                j += size
            if j > i + size and any(n[0] != "text" for n in nodes[i : i + size]):
                out.append(("rep", _slots(nodes[i : i + size])))
                held.append(tuple(x for span in spans[i:j] for x in span))
                i = j
            else:
                out.append(nodes[i])
                held.append(spans[i])
                i += 1
        if len(out) < len(nodes):
            nodes, spans, shapes, size = out, held, [_shape(n) for n in out], 0  # groups may now follow each other
    return nodes, spans


def fold(nodes: list[tuple]) -> list[tuple]:
    return _folded(nodes, [()] * len(nodes))[0]


def align(wrapper: list[tuple], page: list[tuple]) -> list[tuple]:
    """The expression that fits both: differing texts become slots, a repeated group absorbs a single one of its kind,
    and what only one side has becomes optional."""

    def bare(node: tuple) -> tuple:
        return _shape(node[1][0]) if node[0] == "opt" and len(node[1]) == 1 else _shape(node)

    out: list[tuple] = []
    matcher = SequenceMatcher(None, [bare(n) for n in wrapper], [bare(n) for n in page], autojunk=False)
    for op, a, b, c, d in matcher.get_opcodes():
        left, right = wrapper[a:b], page[c:d]
        if op == "equal":
            for x, y in zip(left, right, strict=True):
                out.append(("text", None) if x[0] == "text" and x != y else x)
            continue
        reps = [n for n in [*left, *right] if n[0] == "rep"]
        for nodes, other in ((left, right), (right, left)):
            for group in reps:
                if group in other and tuple(map(_shape, nodes)) == tuple(map(_shape, group[1])):
                    out.append(group)  # one occurrence on this side, several on the other
                    left = right = []
        for nodes in (left, right):
            if nodes:
                same = len(nodes) == 1 and nodes[0][0] == "opt"
                out.append(nodes[0] if same else ("opt", tuple(x for n in nodes for x in (n[1] if n[0] == "opt" else (n,)))))
    return fold(out)


def render(nodes) -> str:
    """The expression as text: tags as they are, # for a slot, (...)+ for repeated and (...)? for optional groups."""
    shown = {"tag": lambda x: f"<{x}>", "text": lambda x: "#" if x is None else re.escape(x), "rep": lambda x: f"({render(x)})+", "opt": lambda x: f"({render(x)})?"}
    return "".join(shown[kind](data) for kind, data in nodes)


def _in_line(nodes) -> list[tuple]:
    """The expression with what is optional put in line."""
    return [x for n in nodes for x in (_in_line(n[1]) if n[0] == "opt" else [n])]


@dataclass(frozen=True)
class Wrapper:
    """A host's expression, and the texts that repeated groups hold on all of its pages."""

    nodes: list[tuple]
    common: frozenset[str] = frozenset()


def _repeated_texts(html: str) -> set[str]:
    texts = [" ".join(data.split()) for kind, _, data in tokens(html) if kind == "text"]
    nodes, spans = _placed(html)
    return {texts[x] for node, span in zip(nodes, spans, strict=True) if node[0] == "rep" for x in span}


def fixed_texts(wrapper: Wrapper, html: str) -> set[int]:
    """The numbers of a page's text tokens that the wrapper's constant texts match: the page is aligned with the wrapper,
    and what falls into its slots and repeated groups, or isn't in it, is the page's own, but for the groups' common texts."""
    plain = _in_line(wrapper.nodes)
    texts = [" ".join(data.split()) for kind, _, data in tokens(html) if kind == "text"]
    nodes, spans = _placed(html)
    matcher = SequenceMatcher(None, [_shape(n) for n in plain], [_shape(n) for n in nodes], autojunk=False)
    found = {x for node, span in zip(nodes, spans, strict=True) if node[0] == "rep" for x in span if texts[x] in wrapper.common}
    for i, j, n in matcher.get_matching_blocks():
        for x, y, span in zip(plain[i : i + n], nodes[j : j + n], spans[j : j + n], strict=True):
            if x[0] == "text" and x == y:
                found.update(span)
    return found


def _bare(path: tuple[str, ...]) -> list[str]:
    return [p.partition(".")[0] for p in path]


def infer_wrapper(htmls: list[str]) -> tuple[str, Wrapper]:
    """(path of the article's container, wrapper) from pages of one host.

    Pages are aligned one after another. The container is the innermost element that holds all texts which fill the
    wrapper's slots and repeated groups, outside of menus, adverts and the like and of links that are in no heading; if
    any are in an article or main element, those of them. An article or main element is never cut. Names count for
    little: where they would set apart nine tenths of what differs from page to page, they are passed over. Empty if
    there are no such texts."""
    nodes = stream(htmls[0])
    for html in htmls[1:]:
        nodes = align(nodes, stream(html))
    wrapper = Wrapper(nodes, frozenset.intersection(*(frozenset(_repeated_texts(x)) for x in htmls)))
    found: list[tuple[tuple[str, ...], bool, int]] = []
    for html in htmls:
        fixed = fixed_texts(wrapper, html) if len(htmls) > 1 else set()
        for number, (_, path, apart, data) in enumerate(x for x in walk(html) if x[0] == "text"):
            text, names = " ".join(data.split()), _bare(path)
            if text and number not in fixed and ("a" not in names or not _HEADINGS.isdisjoint(names)):
                # no deeper than an article or main element
                depth = next((k for k, x in enumerate(names, 1) if x in ("article", "main")), 0)
                found.append((path[:depth] if depth else path, apart, len(text)))
    own = [x for x in found if not x[1]]
    if len(htmls) > 1 and 10 * sum(x[2] for x in own) < sum(x[2] for x in found):
        own = found
    paths = {x[0] for x in own}
    within = {p for p in paths if p and _bare(p[-1:])[0] in ("article", "main")}
    shared = os.path.commonprefix(sorted(within or paths))
    while shared and _bare(shared[-1:])[0] not in ("body", "main", "article", "section", "div", "td", "center"):
        shared = shared[:-1]
    return "/".join(shared), wrapper


def constants_go(container: str, wrapper: Wrapper, htmls: list[str]) -> bool:
    """Whether constant texts in the container aren't the article's: not in an article or main element, nor if they are
    half of its text outside of links, as in pages that are copies of each other."""
    wanted = tuple(container.split("/")) if container else ()
    if len(htmls) < 3 or not wanted or not {"article", "main"}.isdisjoint(_bare(wanted)):
        return False
    same = every = 0
    for html in htmls:
        fixed = fixed_texts(wrapper, html)
        for number, (_, path, apart, data) in enumerate(x for x in walk(html, wanted) if x[0] == "text"):
            if path[: len(wanted)] == wanted and not apart and "a" not in _bare(path):
                every += len(data.strip())
                same += len(data.strip()) if number in fixed else 0
    return 2 * same < every


def main_text(html: str | None, container: str | None, wrapper: Wrapper | None = None) -> str:
    """The blocks of the article, white space in each made single, joined by blank lines.

    The article is what stands in the wrapper's container; without a container, or on a page without it, in article or
    main elements, and without those on the whole page. The page is aligned with the wrapper, if one is given, and blocks
    of nothing but its constant texts go. Menus, adverts and the like within never count."""
    if not html:
        return ""
    wanted = tuple(container.split("/")) if container else ()
    found = list(walk(html, wanted))
    inside = (lambda path: path[: len(wanted)] == wanted) if wanted else None
    fixed: set[int] = set()
    if inside is None or not any(inside(path) for kind, path, apart, _ in found if kind == "text" and not apart):
        found = list(walk(html))
        within = lambda path: any(x in ("article", "main") for x in _bare(path))
        inside = within if any(within(path) for kind, path, _, _ in found if kind == "text") else (lambda path: True)
    elif wrapper:
        fixed = fixed_texts(wrapper, html)
    blocks, now, own, number = [], [], False, 0
    for kind, path, apart, data in [*found, ("break", (), False, "")]:
        if kind == "break":
            blocks.append("".join(now) if own else "")
            now, own = [], False
            continue
        if not apart and inside(path):
            now.append(data)
            own = own or number not in fixed and bool(data.strip())
        number += 1
        # an element like br parts words
    cleaned = (" ".join(unescape(b).split()) for b in blocks)
    return "\n\n".join(b for b in cleaned if b)


def _tuples(nodes) -> list[tuple]:
    return [(kind, tuple(_tuples(data)) if isinstance(data, list) else data) for kind, data in nodes]


@lru_cache(maxsize=256)
def _parsed(text: str) -> Wrapper:
    nodes, common = json.loads(text)
    return Wrapper(_tuples(nodes), frozenset(common))


def infer_wrappers(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(host, container, shown, wrapper) from (page_id, host, html): each host's wrapper from at most `sample` of its pages,
    as text, and as JSON if pages are to be aligned with it.

    The pages with the least hash are taken, first within parts of a host, so that a host with very many pages is
    ranked by many tasks; only then the pages' text is fetched."""
    parts = shuffle_partitions(pages.sparkSession)
    ranked = pages.where("html is not null and page_id is not null").select("page_id", "host", F.xxhash64("page_id").alias("h"))
    for key in (["host", F.pmod(F.col("h"), F.lit(parts))], ["host"]):
        order = Window.partitionBy(*key).orderBy("h", "page_id")
        ranked = ranked.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample).drop("n")
    chosen = materialise(ranked.select("page_id").distinct(), "sample")
    fetched = pages.join(chosen, "page_id", "left_semi").dropDuplicates(["page_id"]).select("host", "page_id", "html")

    def infer(pdf: pd.DataFrame) -> pd.DataFrame:
        htmls = pdf.sort_values("page_id")["html"].tolist()
        container, wrapper = infer_wrapper(htmls)
        told = json.dumps([wrapper.nodes, sorted(wrapper.common)]) if constants_go(container, wrapper, htmls) else None
        return pd.DataFrame({"host": pdf["host"][:1], "container": container, "shown": render(wrapper.nodes), "wrapper": told})

    return fetched.groupBy("host").applyInPandas(infer, "host string, container string, shown string, wrapper string")


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample: int = SAMPLE
) -> DataFrame:
    """(id, url, text, n_chars) of every row: its article's text, empty if there is none, and its code points.

    Pages without a host in their url share one wrapper. Null html counts as empty. The whole html is read, in any
    length. Repeated rows stay; other columns are ignored; an empty table gives no rows."""
    host, _ = url_parts(F.col(url_col))
    named = pages.select(F.col(id_col).cast("string").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    wrappers = materialise(infer_wrappers(named, sample), "wrappers").select("host", "container", "wrapper")
    size = wrappers.agg(F.sum(F.length("container") + F.coalesce(F.length("wrapper"), F.lit(0)) + 100)).first()[0] or 0
    if size <= BROADCAST_CHARS:
        wrappers = F.broadcast(wrappers)
    joined = named.join(wrappers, "host", "left").select("page_id", "url", "html", "container", "wrapper")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = zip(pdf["html"], pdf["container"], pdf["wrapper"], strict=True)
            texts = [main_text(h, c, _parsed(w) if w else None) for h, c, w in rows]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    found = joined.mapInPandas(extract, "page_id string, url string, text string, n_chars long")
    # ids travel as text: pandas would make nullable whole numbers doubles
    return found.withColumn("page_id", F.col("page_id").cast(pages.schema[id_col].dataType)).withColumnsRenamed({"page_id": id_col, "url": url_col})
