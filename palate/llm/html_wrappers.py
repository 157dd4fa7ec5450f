"""HTML extraction with wrappers: union-free regular expressions inferred from pages of the same host.

A page is a stream of tokens: tags and text. A wrapper is a sequence of nodes: a tag, a text slot, an optional group or a
repeated group. Pages are folded into the wrapper of their host one by one: equal tokens stay; a text mismatch becomes a slot;
for a tag mismatch the shortest skip on either side that finds the other's next token again becomes a repeated group if it
repeats what stands before it, else an optional group. Tasks fold their own pages; the wrappers of a host, one per task, are
folded in turn. Nothing is cut: streams are collapsed (runs of equal blocks count once), and where two unmatched nodes differ
in marks only, one node with ANY for these marks takes both, so marks that change from page to page add no nodes.

Text is told from template by host: a block whose text stands at the same path (names without marks) on more than half of
the host's different pages, and on CONSTANT pages at least, is constant; all other text is a slot. In a container, constant
blocks are left out, unless nothing else is there. An article or main is taken whole.

The main region is the wrapper's article, or else main, or else the container with most slots outside of navigation,
headers, footers, sidebars, notices, adverts, forms and comments; a page's text is that of its blocks in the region. An
article or main of the page itself goes before a container of the wrapper. A page without the region of its wrapper, or of
a host without one, has its own region by the same rule.

Defined results: null and empty pages give an empty text; pages without url are one host; broken markup is read as far as it
goes, an unclosed element ends with its parent; repeated rows are extracted each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palate.llm.common import bound_batches
from palate.session import stage

ANY = "*"
CONSTANT = 3
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<(?=[/a-zA-Z])[^>]*\Z", re.S)
_MARK = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
# Elements without content, raw text, blocks, and what is no main text.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea noscript template svg iframe title".split())
BLOCKS = set(
    "address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
ASIDE = set("nav aside footer form header button select dialog menu head".split())
ASIDE_WORDS = set(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies footer header menu nav navbar navigation newsletter notice popup promo related share sidebar social sponsor sponsored subscribe".split()
)
# An open element of the left kind ends where one of the right kind begins.
_ENDS = {"p": BLOCKS - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, marks): kinds are open, close, text."""
    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            yield "text", page[at:], ""
            return
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            yield "close", name, ""
            continue
        yield "open", name, " ".join(x.strip("\"'").lower() for x in _MARK.findall(m[3] or ""))
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            yield "close", name, ""


def blocks(page: str) -> list[tuple[tuple[str, ...], bool, str]]:
    """(path, aside, text) of each text block, in page order; a path holds names with their marks."""
    stack: list[tuple[str, str, bool]] = []
    out: list[tuple[tuple[str, ...], bool, str]] = []
    held: list[str] = []
    where: tuple = ((), False)

    def flush():
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((*where, text))

    def enter():
        nonlocal where
        where = (tuple(f"{n}.{m}" if m else n for n, m, _ in stack if n in BLOCKS or n in RAW or n in ASIDE), bool(stack) and stack[-1][2])

    for kind, name, marks in tokens(page):
        if kind == "text":
            held.append(name)
            continue
        if kind == "open":
            if name == "br":
                held.append(" ")
            if name in VOID:
                if name == "hr":
                    flush()
                continue
            if name in BLOCKS or name in RAW or name in ASIDE:
                flush()
                deep = [i for i, (n, _, _) in enumerate(stack) if n in _ENDS]
                if deep and name in _ENDS[stack[deep[-1]][0]] and not any(n in ("div", "table", "ul", "ol") for n, _, _ in stack[deep[-1] + 1 :]):
                    del stack[deep[-1] :]
                words = set(re.split(r"[^a-z0-9]+", marks))
                out_of = name in ASIDE and not (name == "header" and any(n == "article" for n, _, _ in stack)) or name in RAW or bool(words & ASIDE_WORDS)
                stack.append((name, marks, out_of or bool(stack) and stack[-1][2]))
                enter()
            continue
        if name in BLOCKS or name in RAW or name in ASIDE:
            flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            enter()
    flush()
    return out


def stream(page: str) -> list[str]:
    """The tokens that wrappers are made of, runs of equal blocks counted once."""
    out: list[str] = []
    for path, aside, _ in blocks(page):
        item = ("-" if aside else "+") + "/".join(path)
        if not out or out[-1] != item:
            out.append(item)
    return out


def align(wrapper: list, other: list) -> list:
    """The wrapper that takes both. A node is [item, kind]: kinds are one, optional, repeated."""
    out: list = []
    i = j = 0
    a_items, b_items = [n[0] for n in wrapper], [n[0] for n in other]
    while i < len(wrapper) and j < len(other):
        if a_items[i] == b_items[j]:
            out.append([a_items[i], max(wrapper[i][1], other[j][1])])
            i, j = i + 1, j + 1
            continue
        skip_a = a_items.index(b_items[j], i) - i if b_items[j] in a_items[i:] else None
        skip_b = b_items.index(a_items[i], j) - j if a_items[i] in b_items[j:] else None
        if skip_a is not None and (skip_b is None or skip_a <= skip_b):
            out += _group(out, wrapper[i : i + skip_a])
            i += skip_a
        elif skip_b is not None:
            out += _group(out, other[j : j + skip_b])
            j += skip_b
        elif (both := _joined(a_items[i], b_items[j])) is not None:
            out.append([both, max(wrapper[i][1], other[j][1])])
            i, j = i + 1, j + 1
        else:
            out += [[a_items[i], max(wrapper[i][1], 1)], [b_items[j], max(other[j][1], 1)]]
            i, j = i + 1, j + 1
    for rest in (wrapper[i:], other[j:]):
        out += _group(out, rest)
    return out


def _joined(a: str, b: str) -> str | None:
    """The item that takes both, if they differ in marks only."""
    if a[0] != b[0]:
        return None
    x, y = a[1:].split("/"), b[1:].split("/")
    if [p.split(".")[0] for p in x] != [p.split(".")[0] for p in y]:
        return None
    return a[0] + "/".join(p if p == q else f"{p.split('.')[0]}.{ANY}" for p, q in zip(x, y))


def _inside(path: tuple[str, ...], at: str) -> bool:
    parts = at.split("/")
    return len(path) >= len(parts) and all(a == p or a.endswith(f".{ANY}") and a.split(".")[0] == p.split(".")[0] for a, p in zip(parts, path))


def _group(before: list, group: list) -> list:
    """A skipped group: a repetition of what stands before it folds into that, else it is optional."""
    items = [n[0] for n in group]
    if items and items == [n[0] for n in before[-len(items) :]]:
        for node in before[-len(items) :]:
            node[1] = 2
        return []
    return [[item, max(kind, 1)] for item, kind in group]


def region(wrapper: list) -> str | None:
    """The path of the main region."""
    inside = [n[0][1:].split("/") for n in wrapper if n[0][0] == "+" and n[0] != "+"]
    for name in ("article", "main"):
        for path in inside:
            for k, part in enumerate(path):
                if part.split(".")[0] == name:
                    return "/".join(path[: k + 1])
    counts: dict[str, int] = {}
    for path in inside:
        for k in range(len(path)):
            if path[k].split(".")[0] in ("div", "section", "td", "body"):
                counts["/".join(path[: k + 1])] = counts.get("/".join(path[: k + 1]), 0) + 1
    # The deepest container that holds most of the slots.
    return max(counts, key=lambda c: (counts[c] * 2 > len(inside), c.count("/") if counts[c] * 2 > len(inside) else counts[c])) if counts else None


def _key(path: tuple[str, ...], text: str) -> int:
    """A block by its path without marks and its text."""
    said = "/".join(p.split(".")[0] for p in path) + "\n" + text
    return int.from_bytes(hashlib.blake2b(said.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def main_text(page: str, wrapper: list | None, constant: frozenset[int] = frozenset()) -> str:
    found = blocks(page)
    regions = [region(wrapper) if wrapper else None, region([[("-" if a else "+") + "/".join(p), 0] for p, a, _ in found])]
    is_main = lambda at: at is not None and at.split("/")[-1].split(".")[0] in ("article", "main")
    for at in sorted(regions, key=lambda at: not is_main(at)):
        if at is None:
            continue
        inside = [(p, t) for p, aside, t in found if not aside and _inside(p, at)]
        if inside:
            slots = [] if is_main(at) else [t for p, t in inside if _key(p, t) not in constant]
            return "\n".join(slots or [t for _, t in inside])
    rest = [(p, t) for p, aside, t in found if not aside]
    return "\n".join([t for p, t in rest if _key(p, t) not in constant] or [t for _, t in rest])


def _host(url: str):
    return F.coalesce(F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[list, set]] = {}
    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            items = stream(page)
            wrapper, seen = held.setdefault(host, ([], set()))
            # A stream that was folded before changes nothing.
            if (key := hash(tuple(items))) in seen:
                continue
            seen.add(key)
            held[host] = (align(wrapper, [[x, 0] for x in items]) if wrapper else [[x, 0] for x in items], seen)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.string()), pa.array([json.dumps(w) for w, _ in held.values()], pa.string())], ["host", "wrapper"]
    )


def _fold(table: pa.Table) -> pa.Table:
    wrappers = [json.loads(w) for w in sorted(set(table.column("wrapper").to_pylist()))]
    whole = wrappers[0]
    for w in wrappers[1:]:
        whole = align(whole, w)
    return pa.table({"host": table.column("host").slice(0, 1), "wrapper": pa.array([json.dumps(whole)], pa.string())})


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper as JSON), one row per host."""
    bound_batches(pages.sparkSession)
    named = pages.select(_host(url_col).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return named.mapInArrow(_infer, "host string, wrapper string").groupBy("host").applyInArrow(_fold, "host string, wrapper string")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [sorted({_key(p, t) for p, aside, t in blocks(page) if not aside}) for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("page"), pa.array(keys, pa.list_(pa.int64()))], ["host", "page", "keys"])


def constants(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, constant): the keys of the host's constant blocks; equal pages count once."""
    bound_batches(pages.sparkSession)
    named = pages.select(_host(url_col).alias("host"), F.xxhash64(html_col).alias("page"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    each = stage(named.mapInArrow(_keys, "host string, page bigint, keys array<bigint>").where("size(keys) > 0").dropDuplicates(["host", "page"]), "blocks")
    n_pages = each.groupBy("host").agg(F.count("*").alias("n_pages"))
    met = each.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= CONSTANT)
    # More than half of the pages: a host has at most twice as many constant blocks as a page has blocks.
    return met.join(n_pages, "host").where("2 * n > n_pages").groupBy("host").agg(F.collect_list("key").alias("constant"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, list] = {}
        for batch in batches:
            text = []
            for page, wrapper, constant in zip(*(batch.column(c).to_pylist() for c in ("html", "wrapper", "constant"))):
                if wrapper is not None and wrapper not in parsed:
                    if len(parsed) > 1000:
                        parsed.clear()
                    parsed[wrapper] = json.loads(wrapper)
                text.append(main_text(page, parsed.get(wrapper), frozenset(constant or ())))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(text, pa.string())], ["id", "url", "text"])

    kind = dict(pages.dtypes)[id_col]
    named = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), _host(url_col).alias("host"))
    found = named.join(wrappers(pages, url_col, html_col), "host", "left")
    found = found.join(constants(pages, url_col, html_col), "host", "left").select("id", "url", "html", "wrapper", "constant")
    out = found.mapInArrow(run, f"id {kind}, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
