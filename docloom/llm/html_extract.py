"""Main text of web pages by equivalence-class template deduction.

The pages of one host share a template. Tokens are the elements of a page, by
their path (tags with their classes, from the root), and its text blocks, by
path and text; all blocks take part, menus and footers too. Over the pages of
its host a token has an occurrence vector, the number of times it comes on each
page. Tokens with equal vectors form an equivalence class; the class of the page
itself (once on every page) is the root. A class is valid if enough pages have
it, and if its elements lie in elements of valid classes: so classes nest, and a
layout that only some pages of a host have is a class below the root. Text
blocks of a class of elements that come once a page are constant text.

What is left between the tokens of the template are slots. `deduce` follows the
slots from the root to those that hold the main text. The page as a whole, and an
element without text of its own beside its containers, are followed into every
container that holds a fair share; what is mostly links is a menu, and constant
text counts for nothing. An element with varying text of its own is a main slot,
and all that it holds is kept: headings, leads, small parts, lists of links, lines
that recur. Only constant text goes that stands in an element of a class of its
own which never holds anything else, or in the page outside of all containers.
Layouts are compared on their own pages, so each is followed. Elements whose tag,
role or class declares a menu, header, footer, sidebar, notice, advert, form,
script or comment are never main text. Declared content (article, main) is main
text wherever it stands, and no plan drops anything in it; where a page has
neither a main slot nor declared content, all that is not declared noise is kept.

Vectors are never built: the fingerprint of a vector is the sum of a hash of
(page, count) over pages, where the page is the hash of its html and not an id;
a host of any size is summed in parts. Only tokens of at least two pages and one
in a hundred of the host's pages leave that sum, so a host's table is at most a
hundred times the elements of an average page. Plans are broadcast only if their
measured size is small; else pages meet them by host and a salt.

Nulls and odd rows: a null html is an empty page, a null url has the host ''.
Unclosed and misnested tags, cut-off markup and unknown elements are read as far
as they go, at any depth in linear time. Pages that repeat count each time, and
page ids play no part. An empty table gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.batches import map_rows, parts, strings
from docloom.llm.common import materialize, table

# Elements by kind.
SKIPPED = frozenset("nav footer aside form button select textarea script style noscript template iframe svg canvas object audio video dialog menu head title".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent notice notices popup modal newsletter subscribe "
    "share sharing social related recommended comment comments reply replies footer pagination pager toolbar login signup skip".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# A start of the key closes open elements of the value, up to the next scope.
CLOSES = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table div article section main body".split())
CONTENT = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that hold others, and may be a slot of their own.
CONTAINERS = frozenset("html body main article section div center table tbody tr td header footer nav aside ul ol dl form fieldset".split())

NAME = re.compile(r"[a-z0-9]+")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"

# Possessive throughout: nothing is read twice.
TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|))*+""")
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|$)", re.I) for tag in RAW}

#: A token counts from so many pages, and such a share of its host's pages, on.
LEAST_PAGES = 2
SUPPORT = 0.01
#: Containers with a smaller share of what surrounds them are side slots.
SIDE = 0.1
CONTAINER, DECLARED_NOISE, TOP, HEADING, CLASSED = 1, 2, 4, 8, 16


@dataclass
class Page:
    """Elements in order of their start (0: the page), and blocks of text."""

    parent: list[int] = field(default_factory=lambda: [-1])
    token: list[int] = field(default_factory=lambda: [0])
    flags: list[int] = field(default_factory=lambda: [CONTAINER | TOP])
    #: Declared noise, itself or by an element around it; inside article or main.
    noise: list[bool] = field(default_factory=lambda: [False])
    inside: list[bool] = field(default_factory=lambda: [False])
    #: (element, text, characters in links)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


class Tokens(dict):
    """64-bit token of (token of the parent, label), bounded."""

    def __missing__(self, key: tuple[int, str]) -> int:
        found = int.from_bytes(hashlib.blake2b(f"{key[0]}\0{key[1]}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) | 1
        if len(self) < 200_000:
            self[key] = found
        return found


_tokens = Tokens()


def text_token(element: int, text: str) -> int:
    """Odd for elements, even for texts."""
    return int.from_bytes(hashlib.blake2b(f"{element}\0{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) & ~1


def parse(source: str) -> Page:
    """Elements and blocks in page order, in time linear in the source."""
    page = Page()
    stack: list[tuple[str, int]] = []  # (tag, element): of inline tags the element around them
    opened: Counter[str] = Counter()
    # For each open scope, where in the stack its open closable tags are.
    scopes: list[dict[str, list[int]]] = [defaultdict(list)]
    text: list[str] = []
    linked = 0
    at, end = 0, len(source)

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined:
                page.blocks.append((stack[-1][1] if stack else 0, joined, min(linked, len(joined))))
            text.clear()
            linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        text.append(piece)
        if opened["a"]:
            linked += len(piece.strip())

    def pop(k: int) -> None:
        if any(tag not in INLINE for tag, _ in stack[k:]):
            flush()
        for tag, _ in reversed(stack[k:]):
            opened[tag] -= 1
            if tag in SCOPES:
                scopes.pop()
            elif scopes[-1].get(tag):
                scopes[-1][tag].pop()
        del stack[k:]

    while at < end:
        begin = source.find("<", at)
        if begin < 0:
            add(source[at:])
            break
        if begin > at:
            add(source[at:begin])
        if source.startswith("<!--", begin):
            close = source.find("-->", begin + 4)
            at = close + 3 if close >= 0 else end
            continue
        m = TAG.match(source, begin + 1)
        if m is None:
            if source[begin + 1 : begin + 2] in ("!", "?"):
                close = source.find(">", begin)
                at = close + 1 if close >= 0 else end
            else:
                add("<")
                at = begin + 1
            continue
        rest = REST.match(source, m.end())
        at = min(rest.end() + 1, end)
        tag = m[2].lower()
        if m[1]:
            if opened[tag]:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                pop(k)
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in RAW:
            close = RAW_END[tag].search(source, at)
            close = source.find(">", close.end()) if close else -1
            at = close + 1 if close >= 0 else end
            continue
        if tag in INLINE:
            stack.append((tag, stack[-1][1] if stack else 0))
            opened[tag] += 1
            continue
        flush()
        if opened["head"]:
            pop(next(k for k, (t, _) in enumerate(stack) if t == "head"))
        if tag in CLOSES:
            where = [places[0] for t in CLOSES[tag] if (places := scopes[-1].get(t))]
            if where:
                pop(min(where))
        around = stack[-1][1] if stack else 0
        noisy, inside, label = page.noise[around], page.inside[around], tag
        declared = tag in SKIPPED or (tag == "header" and not inside)
        if rest.end() - rest.start() > 1:
            attributes = {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(rest[0])}
            # Within declared content a word of an id or of a longer class may
            # be the subject: id='related-work'.
            names = attributes.get("class", "").split() if inside else NAME.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}")
            if tag not in ("html", "body", "article", "main"):
                declared = declared or not HINTS.isdisjoint(names) or attributes.get("role") in ROLES or ("header" in names and not inside)
            if attributes.get("class"):
                label = f"{tag}.{'.'.join(attributes['class'].split())}"
        if declared:
            label += "!"  # a role or an id may declare it: a path of its own
        page.parent.append(around)
        page.token.append(_tokens[page.token[around], label])
        page.flags.append(CONTAINER * (tag in CONTAINERS) | DECLARED_NOISE * declared | TOP * (tag in ("html", "body")) | HEADING * (tag in HEADINGS) | CLASSED * ("." in label))
        page.noise.append(noisy or declared)
        page.inside.append(inside or tag in CONTENT)
        stack.append((tag, len(page.parent) - 1))
        opened[tag] += 1
        if tag in SCOPES:
            scopes.append(defaultdict(list))
        else:
            scopes[-1][tag].append(len(stack) - 1)
    flush()
    return page


def page_tokens(page: Page) -> dict[int, list[int]]:
    """token -> [count, token of the element around it, flags, characters inside,
    of these in links, and outside of links and declared noise]. Text tokens
    have flags -1."""
    n = len(page.parent)
    chars, links, weight = [0] * n, [0] * n, [0] * n
    out: dict[int, list[int]] = {}
    for element, text, linked in page.blocks:
        chars[element] += len(text)
        links[element] += linked
        free = 0 if page.noise[element] else len(text) - linked
        weight[element] += free
        own = out.setdefault(text_token(page.token[element], text), [0, page.token[element], -1, 0, 0, 0])
        own[0] += 1
        own[3] += len(text)
        own[4] += linked
        own[5] += free
    for i in range(n - 1, 0, -1):
        for sums in (chars, links, weight):
            sums[page.parent[i]] += sums[i]
    for i in range(n):
        own = out.setdefault(page.token[i], [0, page.token[page.parent[i]] if i else 0, page.flags[i], 0, 0, 0])
        own[0] += 1
        own[3] += chars[i]
        own[4] += links[i]
        own[5] += weight[i]
    return out


STATISTICS = "host string, token long, around long, flags int, f1 long, f2 long, pages long, n long, chars long, links long, weight long"
SUMS = ("f1", "f2", "pages", "n", "chars", "links", "weight")


def token_statistics(pages: DataFrame) -> DataFrame:
    """One row for each (host, token), as in STATISTICS: f1 and f2 are the
    fingerprint of the occurrence vector, pages those that have it, n how often
    it comes in all. pages: host, html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sums: dict[tuple[str, int], list[int]] = {}
            for host, source in zip(strings(batch, "host"), strings(batch, "html"), strict=True):
                key = hashlib.blake2b(source.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                marks: dict[int, tuple[int, int]] = {}
                for token, (n, around, flags, *chars) in page_tokens(parse(source)).items():
                    if n not in marks:
                        digest = hashlib.blake2b(key + n.to_bytes(8, "little"), digest_size=8).digest()
                        # 31 bits each: sums stay below 2**63 for 2**32 pages.
                        marks[n] = (int.from_bytes(digest[:4], "little") >> 1, int.from_bytes(digest[4:], "little") >> 1)
                    own = sums.setdefault((host, token), [around, flags, 0, 0, 0, 0, 0, 0, 0])
                    for k, x in enumerate((*marks[n], 1, n, *chars), 2):
                        own[k] += x
            rows = list(sums.items())
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 7]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int64()), *(pa.array([v[i] for _, v in rows], kind) for i, kind in enumerate(kinds))],
                ["host", "token", "around", "flags", *SUMS],
            )

    found = pages.mapInArrow(run, STATISTICS)
    return found.groupBy("host", "token").agg(F.max("around").alias("around"), F.max("flags").alias("flags"), *[F.sum(c).alias(c) for c in SUMS])


def valid_tokens(statistics: DataFrame, support: float = SUPPORT, least_pages: int = LEAST_PAGES, salts: int = 16) -> DataFrame:
    """Elements that enough pages of their host have, and constant texts: those
    of the class of an element that comes once on each page that has it."""
    some = materialize(statistics.where(F.col("pages") >= least_pages), "page-tokens")
    roots = some.where("token = 0").select("host", F.col("pages").alias("host_pages"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    elements = some.where("flags >= 0").withColumn("salt", F.pmod("token", F.lit(salts)).cast("int"))
    # Salted, since a host may have a third of all tokens.
    elements = materialize(elements.join(roots, ["host", "salt"]).where(F.col("pages") >= F.col("host_pages") * support).drop("salt", "host_pages"), "page-elements")
    layouts = elements.where("n = pages").select("host", "f1", "f2").distinct()
    texts = some.where("flags < 0 and n = pages").join(layouts, ["host", "f1", "f2"], "left_semi")
    return elements.unionByName(texts)


@dataclass
class Token:
    token: int
    around: int
    flags: int
    vector: tuple[int, int]
    pages: int
    n: int
    chars: int
    links: int
    weight: int


def nest(tokens: Iterable[Token]) -> tuple[dict[int, Token], dict[int, list[Token]], dict[tuple[int, int], set[tuple[int, int]]]]:
    """The elements of the template by token, their children, and for each class
    (by its vector) the classes that it is nested in. An element belongs if it
    lies in one that does; what hangs in the air is no template."""
    by_parent: dict[int, list[Token]] = defaultdict(list)
    template: dict[int, Token] = {}
    for t in sorted(tokens, key=lambda t: t.token):
        if t.flags >= 0 and t.token == 0:
            template[0] = t
        elif t.flags >= 0:
            by_parent[t.around].append(t)
    classes: dict[tuple[int, int], set[tuple[int, int]]] = defaultdict(set)
    todo = list(template.values())
    while todo:
        e = todo.pop()
        for k in by_parent[e.token]:
            template[k.token] = k
            if k.vector != e.vector:
                classes[k.vector].add(e.vector)
            todo.append(k)
    return template, by_parent, classes


def deduce(tokens: list[Token]) -> tuple[list[int], list[int], list[int]]:
    """(main, noise, constant): elements whose slots hold the main text, nested
    elements that do not, and constant texts of the host."""
    template, children, _ = nest(tokens)
    if 0 not in template:
        return [], [], []
    # Constant text is template: it weighs nothing in the elements around it.
    constant = [t for t in tokens if t.flags < 0]
    fixed: Counter[int] = Counter()
    for t in constant:
        fixed[t.around] += t.weight
    for k in reversed(template):  # inner elements come after those around them
        if k:
            fixed[template[k].around] += fixed[k]
    weight = {k: max(0, e.weight - fixed[k]) for k, e in template.items()}
    main, noise = [], []

    def average(e: Token) -> float:
        return weight[e.token] / e.pages

    def menu(e: Token) -> bool:
        return bool(e.flags & DECLARED_NOISE) or 2 * e.links >= e.chars

    todo = [template[0]]
    while todo:
        e = todo.pop()
        parts_ = [k for k in children[e.token] if k.flags & CONTAINER and k.n == k.pages and k.chars]
        slots = [k for k in parts_ if not menu(k) and weight[k.token]]
        large = [k for k in slots if average(k) >= SIDE * average(e)]
        own, top = weight[e.token] - sum(weight[k.token] for k in parts_), bool(e.flags & TOP)
        if not large or (own >= SIDE * weight[e.token] if top else own > 0):
            # It has text of its own beside its containers, so all that it holds
            # is main text, small parts and lists of links too; only the page as
            # a whole holds side slots.
            if weight[e.token]:
                main.append(e.token)
            noise += [k.token for k in parts_ if top and k not in large]
        else:
            main += [k.token for k in children[e.token] if k.flags & HEADING]
            todo += large

    chosen = set(main)

    def template_text(t: Token) -> bool:
        """Whether a constant text stands in an element of a class of its own
        that never holds anything else, or in no main slot but the page itself.
        A plain paragraph of a main slot that recurs is text."""
        at = t.around
        if at in template and template[at].flags & CLASSED and not weight[at] and at not in chosen:
            return True
        while at in template and at not in chosen and at:
            at = template[at].around
        return at in chosen and bool(template[at].flags & TOP)

    return sorted(main), sorted(noise), sorted(t.token for t in constant if template_text(t)) if main else []


PLANS = "host string, main array<long>, noise array<long>, constant array<long>"


def host_plans(valid: DataFrame) -> DataFrame:
    """One row per host with more than one page, as in PLANS. A host's rows are
    bounded (see valid_tokens), so one task takes them."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        tokens = [Token(r["token"], r["around"], r["flags"], (r["f1"], r["f2"]), r["pages"], r["n"], r["chars"], r["links"], r["weight"]) for r in rows.to_pylist()]
        plan = deduce(tokens)
        return pa.table({"host": pa.array([key[0].as_py()], pa.string()), **{name: pa.array([x], pa.list_(pa.int64())) for name, x in zip(("main", "noise", "constant"), plan, strict=True)}})

    return valid.groupBy("host").applyInArrow(run, PLANS)


def extract_text(source: str, main: Iterable[int] | None = None, noise: Iterable[int] | None = None, constant: Iterable[int] | None = None) -> str:
    """The text of the main slots of a page and of its declared content, in
    which no plan drops anything; all text that is not noise where a page has
    neither."""
    page = parse(source)
    main, noise, constant = set(main or ()), set(noise or ()), set(constant or ())
    state = [False] * len(page.parent)  # in a main slot
    dropped = [False] * len(page.parent)
    for i, (parent, token) in enumerate(zip(page.parent, page.token, strict=True)):
        dropped[i] = page.noise[i] or not page.inside[i] and (token in noise or (i > 0 and dropped[parent]))
        state[i] = not dropped[i] and (page.inside[i] or token in main or (i > 0 and state[parent]))
    kept = [text for element, text, _ in page.blocks if state[element] and (page.inside[element] or not constant or text_token(page.token[element], text) not in constant)]
    if not kept:
        kept = [text for element, text, _ in page.blocks if not page.noise[element]]
    return " ".join(kept)


BROADCAST_BYTES = 32_000_000
SALTS = 32


def extract_main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of df: page_id, url, text, n_chars."""
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), HOST, 1), F.lit("")))
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    plans = materialize(host_plans(valid_tokens(token_statistics(pages.select("host", "html")))), "host-plans")
    size = plans.agg(F.sum(F.length("host") + 8 * (F.size("main") + F.size("noise") + F.size("constant")) + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        joined = pages.join(F.broadcast(plans), "host", "left")
    else:
        salted = plans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = pages.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(salted.hint("shuffle_merge"), ["host", "salt"], "left")
    joined = joined.select("page_id", "url", "html", "main", "noise", "constant")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [extract_text(*row) for row in zip(*(strings(batch, c) for c in ("html", "main", "noise", "constant")), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = joined.schema["page_id"].dataType.simpleString()
    return map_rows(joined, run, f"page_id {kind}, url string, text string, n_chars long")


def op7_page_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
