"""Main text of web pages by equivalence classes of template tokens.

1. Every page is tokenised. A token is a structural tag with its path (class and id included), or a block
   of text with its path. Its occurrence vector holds its counts on the pages of a host; a sum of page
   hashes times counts identifies the vector, so it is found for all pages of a host, however many, by one
   mergeable sum per token.
2. Tokens of a host with the same vector form an equivalence class. Classes that hold a structural token,
   occur on a tenth of the host's pages or more and on three different pages at least are valid. They nest
   by the spans of their elements, which are those of the paths: a text belongs to the template if one of
   the elements around it is of its own class, so that each such element holds it. Such texts are removed;
   the other blocks are the slots. The order of tokens inside an element is not tested.
3. Slots below menus, headers, footers, sidebars, notices, adverts, forms and comments are closed. Of the
   rest, the slots inside an article or main element are the content; a page without text there takes
   all its open slots, whatever the other layouts of its host.
4. Pages meet their host's template in a join and give the text of their content slots, block by block. A
   block that holds any varying text is given whole.

Defined results: null or blank html gives an empty text; a url without a host forms one group with the
others of its kind; a host with less than three different pages has no template, and a page whose open
texts all belong to the template (as in a group of near copies) is read by the tag rules of step 3 alone;
repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

#: Elements by role.
SKIPPED = ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "title")
CLOSED = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "label"}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Void elements that part the words before and after them.
PARTING = {"br", "hr", "img"}
BLOCKS = {"html", "body", "div", "section", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd",
          "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption",
          "address", "details", "summary", "fieldset", "hgroup"} | CLOSED | MAIN
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BOILERPLATE = re.compile(
    r"(?:^|[-_ ])(?:ad|ads|advert|advertisement|banner|sponsor|sponsored|promo|nav|navbar|menu|breadcrumb|breadcrumbs|sidebar|"
    r"footer|header|masthead|cookie|cookies|consent|gdpr|notice|popup|modal|newsletter|subscribe|signup|social|share|sharing|"
    r"comment|comments|respond|replies|disqus|related|recommended|pagination|pager|skip|login|search)(?:$|[-_ 0-9])")

#: A class name with one of these parts says how the page is laid out around such a block ("has-sidebar").
LAYOUT = re.compile(r"(?:^|[-_])(?:has|have|no|non|not|with|without|hide|hides|show|shows|enable|enabled|disable|disabled|"
                    r"layout|fixed|sticky)(?:$|[-_])")
#: What stands in a tag after its name. Quotes count after an equals sign; nothing is given back, so a tag is read once.
_ATTRIBUTES = r"(?:[^>=]|=\s*+\"[^\"]*\"|=\s*+'[^']*'|=)*+"
_PIECES = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:svg|template)(?:[\s/]" + _ATTRIBUTES + r")?(?<=/)>"
    r"|<(?P<skip>" + "|".join(SKIPPED) + r")(?=[\s/>])[^>]*>.*?(?:</(?P=skip)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<rest>" + _ATTRIBUTES + r")(?:>|\Z)|<[!?/][^>]*>|(?P<text>[^<]+|<)",
    re.S | re.I)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def walk(page: str | None) -> Iterator[tuple[str, str | None]]:
    """(path, None) for each structural element that opens, (path, raw text) for text; a path lists
    structural elements only, joined by slashes, and a change of it ends a block. A path that ends in
    ``!`` marks the end of an element."""
    stack: list[str] = []
    path, page = "", page or ""
    tail = page.rfind(">") + 1  # no tag ends after it
    for piece in _PIECES.finditer(page[:tail]):
        if (text := piece["text"]) is not None:
            yield path, text
            continue
        tag = piece["tag"] and piece["tag"].lower()
        if tag in PARTING:
            yield path, " "
        if not tag or tag not in BLOCKS:
            continue
        if piece["close"]:
            if any(s.split(".")[0] == tag for s in stack):
                while stack.pop().split(".")[0] != tag:
                    pass
        elif tag not in VOID:
            if tag == "p" or tag in HEADINGS or tag in ("div", "ul", "ol", "table", "section", "article", "blockquote", "pre", "footer"):
                if stack and stack[-1].split(".")[0] == "p":
                    stack.pop()
            if tag in ("li", "dt", "dd", "tr", "td", "th") and stack and stack[-1].split(".")[0] == tag:
                stack.pop()
            rest = piece["rest"]
            named = ".".join((m[2] or m[3] or m[4] or "").strip().lower().replace("/", " ") for m in _NAMED.finditer(rest)) if rest else ""
            stack.append(f"{tag}.{named}" if named else tag)
        path = "/".join(stack)
        yield path if not piece["close"] else path + "!", None
    if tail < len(page):
        yield path, page[tail:]


def is_boilerplate(tag: str, named: str) -> bool:
    """Do the element's names tell of a closed slot? Those of the page and of the main element, and names
    that only qualify a layout, do not."""
    if tag in ("html", "body") or tag in MAIN:
        return False
    return any(BOILERPLATE.search(name) and not LAYOUT.search(name) for name in named.replace(".", " ").split())


@lru_cache(maxsize=100_000)
def is_closed(path: str) -> bool:
    for element in path.split("/"):
        tag, _, named = element.partition(".")
        if tag in CLOSED or named and is_boilerplate(tag, named):
            return True
    return False


@lru_cache(maxsize=100_000)
def is_main(path: str) -> bool:
    return any(e.partition(".")[0] in MAIN or e.endswith(".main") for e in path.split("/"))


def text_blocks(pieces: Iterable[tuple[str, str | None]]) -> Iterator[tuple[str, str]]:
    """(path, text) of each block of text of a walk, blanks folded, character references as they are."""
    own: list[str] = []
    place = ""
    for path, text in pieces:
        if text is not None:
            own.append(text)
            place = path
        elif own:
            if said := " ".join("".join(own).split()):
                yield place, said
            own = []
    if said := " ".join("".join(own).split()):
        yield place, said


def number(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def literal_number(path: str, said: str) -> int:
    return number(f"{path}\n{said}")


def page_tokens(page: str | None) -> Counter:
    """Counts of the page's tokens: (path, -1, -1) for an element, (None, number of the path, number of
    path and text) for a block of text. The empty path stands for the page."""
    out: Counter = Counter({("", -1, -1): 1})
    pieces = list(walk(page))
    for path, text in pieces:
        if text is None and not path.endswith("!"):
            out[path, -1, -1] += 1
    for path, said in text_blocks(pieces):
        out[None, number(path), literal_number(path, said)] += 1
    return out


def token_vectors(pages: DataFrame) -> DataFrame:
    """host, path, place, literal, pages, times, first, last, vector: one row per token of a host.
    ``vector`` identifies the occurrence vector over all pages of the host, ``first`` and ``last`` are the
    smallest and the largest hash of its pages."""
    names = ["host", "path", "place", "literal", "pages", "times", "first", "last", "high", "low"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums: dict[tuple, list[int]] = {}
            for name, page in zip(batch["host"], batch["html"]):
                key = number(page or "") >> 3
                for token, n in page_tokens(page).items():
                    own = sums.get((name, *token))
                    if own is None:
                        sums[name, *token] = [1, n, key, key, key * n]
                    else:
                        own[0] += 1
                        own[1] += n
                        own[2] = min(own[2], key)
                        own[3] = max(own[3], key)
                        own[4] += key * n
            yield pd.DataFrame([(*token, *rest, v >> 40, v & 0xFFFFFFFFFF) for token, (*rest, v) in sums.items()], columns=names)

    rows = pages.select(host(F.col("url")).alias("host"), "html").mapInPandas(
        work, "host string, path string, place long, literal long, pages long, times long, first long, last long, high long, low long")
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    return rows.groupBy(*names[:4]).agg(
        F.sum("pages").alias("pages"), F.sum("times").alias("times"), F.min("first").alias("first"), F.max("last").alias("last"),
        (total("high") * 1099511627776 + total("low")).cast("decimal(38,0)").alias("vector"))


def host_templates(tokens: DataFrame, support: float = 0.1) -> DataFrame:
    """host, literals (numbers of the template's texts) and classes (number of valid classes). Only tokens on
    a tenth of the pages or more are gathered per host: at most ten times the tokens of a mean page."""
    sizes = tokens.filter("path = ''").select("host", F.col("pages").alias("host_pages"))
    frequent = tokens.join(sizes, "host").filter(F.col("pages") >= F.col("host_pages") * support)

    def nest(hosts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in hosts:
            yield pd.DataFrame([(name, *template(tuples)) for name, tuples in zip(rows["host"], rows["tokens"])],
                               columns=["host", "literals", "classes"])

    listed = frequent.groupBy("host").agg(F.collect_list(F.struct(
        "path", "place", "literal", "times", "first", "last", F.col("vector").cast("string").alias("vector"))).alias("tokens"))
    return listed.mapInPandas(nest, "host string, literals array<long>, classes int")


def is_repeated(token: dict) -> bool:
    """Does the token occur on three different pages or more? If there are but two, with hashes ``first`` and
    ``last``, the vector is a sum of these two."""
    first, last = int(token["first"]), int(token["last"])
    return first != last and (int(token["vector"]) - first * int(token["times"])) % (last - first) != 0


def template(tokens: list[dict]) -> tuple[list[int], int]:
    """The texts of one host's template, and the number of its valid classes."""
    classes: dict[str, list[dict]] = defaultdict(list)
    for token in tokens:
        classes[token["vector"]].append(token)
    valid = {v: ts for v, ts in classes.items() if any(t["path"] is not None for t in ts) and is_repeated(ts[0])}
    owner = {t["path"]: v for v, ts in valid.items() for t in ts if t["path"] is not None}
    places = {number(t["path"]): t["path"] for t in tokens if t["path"] is not None}
    literals = []
    for vector, members in valid.items():
        for token in members:
            if token["path"] is not None:
                continue
            # nested: one of the containers around the text is of the text's own class
            elements = places[token["place"]].split("/")
            if any(owner.get("/".join(elements[:depth])) == vector for depth in range(len(elements) + 1)):
                literals.append(token["literal"])
    return sorted(literals), len(valid)


def main_text(page: str | None, literals: Iterable[int] | None) -> str:
    """The page's content, a line per block, without the blocks that are texts of the template."""
    known = frozenset(() if literals is None else literals)
    blocks = [(path, said) for path, said in text_blocks(walk(page)) if not is_closed(path)]
    varying = [(path, said) for path, said in blocks if not known or literal_number(path, said) not in known]
    for found in (varying, blocks):
        for chosen in ([said for path, said in found if is_main(path)], [said for _, said in found]):
            if lines := [line for said in chosen if (line := " ".join(entities.unescape(said).split()))]:
                return "\n".join(lines)
    return ""


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every page."""
    templates = host_templates(token_vectors(pages))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(p, c) for p, c in zip(batch["html"], batch["literals"])]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts,
                                "n_chars": np.array([len(t) for t in texts], np.int64)})

    met = pages.select("page_id", "url", "html", host(F.col("url")).alias("host")).join(templates, "host", "left")
    kind = pages.schema["page_id"].dataType.simpleString()
    return met.select("page_id", "url", "html", "literals").mapInPandas(
        work, f"page_id {kind}, url string, text string, n_chars long")
