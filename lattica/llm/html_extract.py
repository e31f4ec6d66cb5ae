"""HTML main text by equivalence-class template deduction across the pages of a host.

Each page is read into elements and text blocks with their paths (tag and class names from the root). Over the pages of
a host, every path and every block of text (as a hash of path and text) is a token with an occurrence vector: how often it
comes in each page. Tokens of equal vectors form an equivalence class (vectors are compared by a hash that adds up over
pages with map-side combine). A class is valid if it has at least two tokens and is found in most pages; classes nest
where the paths of one extend those of another. The nested valid classes are the host's template:

* its paths with their slots give the main container: from the root down, the template path that holds most of the slot
  text outside links. ``article`` and ``main`` are a prior: such a path needs HALF of it, any other MOST of it, and the way
  down ends there. If what is below such names is less than half (teasers, cards), it counts as no slot at all;
* its text tokens are fixed text (menus, notices, imprints). Below the container only those are that come just as often as
  the container itself, in FIXED_PAGES pages or more, and only while they are the lesser part of the container's text (else the pages are
  copies of one another);
* slots that are mostly links are menus.

A page's main text is then what its slots below the container hold, without elements that are by name or class
menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or reader comments. Pages without the container, and
hosts of one or two pages, which have no valid classes, go by names alone.

Templates are one row a host. They are broadcast if they have at most MAX_TEMPLATES rows, which is counted first; else pages
are joined with them by host, in a join that can be split under skew.

Cases: null or empty html gives an empty text; a null or odd url is a host of its own name ``''``; unclosed tags end
where HTML says; an unended comment or script runs to the end; repeated rows get a row each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as _html
import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm._text import limits
from lattica.session import ensure_checkpoint_dir, ship, table

#: Hosts whose templates are broadcast, and bytes of all templates.
MAX_TEMPLATES, MAX_TEMPLATE_BYTES = 50_000, 16 << 20
#: A class is valid from so many pages, and such a share of the host's pages; fixed text in the container from so many.
MIN_PAGES, MIN_SHARE, FIXED_PAGES = 3, 0.5, 4
#: The share of the slot text that the way down to the container needs: for article or main, and for other paths.
HALF, MOST = 0.5, 0.8
MAIN = {"article", "main"}
DROP = set("nav footer aside form script style noscript template iframe svg math button select textarea dialog menu head title object canvas audio video map".split())
RAW = set("script style textarea title noscript iframe template".split())
VOID = set("area base br col embed hr img input link meta source track wbr param".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre section summary table tbody td tfoot th thead tr ul".split())
_HINT = re.compile(
    r"(?<![a-z])(?:ads?|advert\w*|sponsor\w*|promo\w*|banners?|cookies?|consent|notices?|alerts?|menus?|nav|navbar|navigation|breadcrumbs?|sidebars?|footer|header|masthead|comments?|commentlist|disqus|repl(?:y|ies)|responses?|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|popup|modal|widgets?|toolbar|pagination|pager|skip-link)(?![a-z])"
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WS = re.compile(r"\s+")


class Page:
    """Elements and blocks of a page. A block is (path, text, characters in links, below main (1) or article (2), dropped by name)."""

    def __init__(self, html: str | None):
        self.paths: list[str] = []
        self.blocks: list[tuple[str, str, int, int, bool]] = []
        self._buf: list[str] = []
        self._links = 0
        stack: list[tuple[str, str, int, bool]] = [("", "", 0, False)]  # tag, path, below main, dropped
        s, at, in_link, n = html or "", 0, 0, len(html or "")
        while at < n:
            m = _TOKEN.search(s, at)
            text = s[at : m.start() if m else n]
            if text and not stack[-1][3]:
                text = _html.unescape(text)
                self._buf.append(text)
                self._links += len(text.strip()) if in_link else 0
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            tag, closing = m[2].lower(), m[1]
            if tag == "a":
                in_link = 0 if closing else 1
            elif tag == "br" or tag == "hr":
                self._buf.append(" ")
            if tag not in BLOCK and tag not in DROP:
                continue
            self._end(stack)
            if closing:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
                continue
            if tag in VOID:
                continue
            if tag in BLOCK and stack[-1][0] == "p":
                stack.pop()
            elif tag in ("li", "dd", "dt", "td", "th", "tr", "option") and stack[-1][0] in (tag, *(("dd", "dt") if tag in ("dd", "dt") else ()), *(("td", "th") if tag in ("td", "th") else ())):
                stack.pop()
            above = stack[-1]
            hints = " ".join(x[1] or x[2] or x[3] for x in _ATTR.findall(m[3])).lower() if m[3] else ""
            name = f"{tag}.{'.'.join(sorted(hints.split()))}" if hints else tag
            main = 2 if tag == "article" else above[2] or int(tag in MAIN or "main" in hints.split())
            drop = above[3] or tag in DROP or (tag == "header" and not above[2]) or bool(hints and tag not in ("html", "body", "article", "main") and _HINT.search(hints))
            path = f"{above[1]}/{re.sub(r'[0-9]+', '0', name)}"
            self.paths.append(path)
            if tag in RAW:
                e = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(s, at)
                at = e.end() if e else n
                continue
            stack.append((tag, path, main, drop))
        self._end(stack)

    def _end(self, stack: list) -> None:
        if self._buf:
            text = _WS.sub(" ", "".join(self._buf)).strip()
            if text:
                tag, path, main, drop = stack[-1]
                self.blocks.append((path, text, self._links, main, drop))
            self._buf, self._links = [], 0


def text_token(path: str, text: str) -> str:
    """The token of a block: its path, and a hash of its text."""
    return f"{path}\n{hashlib.blake2b(text.encode('utf-8', 'replace'), digest_size=9).hexdigest()}"


def main_text(page: Page, template: dict | None) -> str:
    """The main text of a page under its host's template."""
    t = template or {}
    fixed, links, root = set(t.get("text", ())), set(t.get("links", ())), t.get("main") or ""
    free = [b for b in page.blocks if not b[4] and not (fixed and text_token(b[0], b[1]) in fixed)]
    inside = [b for b in free if root and (b[0] == root or b[0].startswith(root + "/"))]
    if inside:
        return "\n\n".join(b[1] for b in inside)
    rows = [b for b in free if b[3] == 2 or b[0] not in links]
    named = [b for b in rows if b[3]]
    if named and (t.get("named", True) or 2 * sum(len(b[1]) for b in named) >= sum(len(b[1]) for b in rows)):
        rows = named
    return "\n\n".join(b[1] for b in rows)


def _mix(page: int, n: int) -> int:
    x = (page * 0x9E3779B97F4A7C15 + n * 0xD6E8FEB86659FD93 + 0x1234567) & (2**64 - 1)
    x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    x = ((x ^ (x >> 29)) * 0x94D049BB133111EB) & (2**64 - 1)
    return x ^ (x >> 32)


def _tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, token, pages, vector hash, characters, link characters) of each batch, added up over its pages.

    Characters of text tokens are those outside links; of the token '' they are the page's, and its last are those below main.
    """
    for batch in batches:
        seen: dict[tuple[str, str], list] = {}
        for host, page_id, html in zip(batch.column("host").to_pylist(), batch.column("h").to_pylist(), batch.column("html").to_pylist()):
            page = Page(html)
            own: dict[str, list] = {"": [1, 0, 0]}
            for path in page.paths:
                own.setdefault(path, [0, 0, 0])[0] += 1
            for path, text, links, main, drop in page.blocks:
                if drop:
                    continue
                told = max(0, len(text) - links)
                if path in own and path:
                    own[path][1] += len(text)
                    own[path][2] += links
                own[""][1] += told
                own[""][2] += told if main else 0
                x = own.setdefault(text_token(path, text), [0, 0, 0])
                x[0] += 1
                x[1] += told
            for token, (n, chars, links) in own.items():
                x = seen.setdefault((host, token), [0, 0, 0, 0])
                x[0] += 1
                x[1] = (x[1] + _mix(page_id, n)) & (2**64 - 1)
                x[2] += chars
                x[3] += links
        keys, vals = list(seen), list(seen.values())
        # The vector hash travels as two halves, so that their sums don't overflow.
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), *(pa.array(x, pa.int64()) for x in ([v[0] for v in vals], [v[1] >> 32 for v in vals], [v[1] & 0xFFFFFFFF for v in vals], [v[2] for v in vals], [v[3] for v in vals]))],
            names=["host", "token", "pages", "hi", "lo", "chars", "links"],
        )


def _named(path: str) -> bool:
    """Whether a path lies below an article or main."""
    return any(x[0] in MAIN or "main" in x[1:] for x in (e.split(".") for e in path.split("/")))


def valid_classes(rows: list[tuple[str, int, object, int, int]]) -> list[list[tuple]]:
    """The tokens that share a vector, where there are two at least; those of the most pages first."""
    classes: dict = {}
    for r in rows:
        classes.setdefault((r[1], r[2]), []).append(r)
    return [c for _, c in sorted(classes.items(), key=lambda x: (-x[0][0], str(x[0][1]))) if len(c) >= 2]


def deduce(rows: list[tuple[str, int, object, int, int]]) -> dict:
    """A template from the frequent tokens of a host: (token, pages, vector, characters, link characters)."""
    valid = valid_classes(rows)
    # Nesting: a class joins the template if each of its tokens lies below a path that is already in it.
    paths, text = {""}, []
    for c in valid:
        tokens = sorted((r[0] for r in c), key=lambda t: ("\n" in t, t.count("/"), t))
        inside, new = set(paths), []
        for t in tokens:
            path, _, fixed = t.partition("\n")
            if fixed:  # a block may stand below the path of a block that comes several times
                if path in inside or path.rpartition("/")[0] in inside:
                    new.append(t)
            elif path.rpartition("/")[0] in inside:
                inside.add(path)
                new.append(t)
            else:
                new = None
                break
        if new is not None:
            paths = inside
            text += [t for t in new if "\n" in t]
    slots = {r[0]: (r[3], r[4]) for r in rows if r[0] and "\n" not in r[0]}
    links = sorted(p for p, (chars, inside) in slots.items() if chars and inside > 0.6 * chars and p in paths)
    total, under = next(((r[3], r[4]) for r in rows if not r[0]), (0, 0))
    told = {r[0]: r[3] for r in rows if "\n" in r[0]}
    outside = [t for t in text if not _named(t.partition("\n")[0])]
    free = {p: chars - inside for p, (chars, inside) in slots.items()}
    for t in outside:
        path = t.partition("\n")[0]
        total -= told[t]
        free[path] = free.get(path, 0) - told[t]
    named, main = under > 0 and 2 * under >= total, ""
    if not named:
        total -= under
        free = {p: c for p, c in free.items() if not _named(p)}
    free = {p: c for p, c in free.items() if p not in links or _named(p)}
    while total > 0 and not _named(main):
        below = {p: sum(c for q, c in free.items() if q == p or q.startswith(p + "/")) for p in paths if p.rpartition("/")[0] == main and p != main}
        best = max(sorted(below), key=below.get, default=None)
        if best is None or below[best] < (HALF if _named(best) else MOST) * total or best.rpartition("/")[2].split(".")[0] in ("p", "li", "td", "h0"):
            break
        main = best
    # Text below the container is fixed only if it comes just as often as the container, and is the lesser part of its text.
    vector = {r[0]: (r[1], r[2]) for r in rows}
    inside = [t for t in text if main and (t.partition("\n")[0] + "/").startswith(main + "/")]
    always = [t for t in inside if vector[t] == vector.get(main) and vector[t][0] >= FIXED_PAGES]
    if 2 * sum(told[t] for t in always) >= sum(chars for p, (chars, _) in slots.items() if (p + "/").startswith(main + "/")):
        always = []
    if not _named(main):  # outside names, what repeats is a menu or a box even where the container isn't told from them
        always = inside
    kept = {*inside} - {*always}
    return {"main": main, "named": named or under <= 0, "text": sorted(t for t in text if t not in kept and (t in always or not _named(t.partition("\n")[0]))), "links": links}


def _deduce_host(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = sorted(zip(pdf["token"], pdf["pages"], zip(pdf["hi"], pdf["lo"]), pdf["chars"], pdf["links"]), key=lambda r: r[0])
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "template": [json.dumps(deduce(rows), ensure_ascii=False)]})


def _rows(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    return pages.select(F.col("page_id").alias("id"), "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))


def templates(pages: DataFrame) -> DataFrame:
    """(host, template as JSON) of each host that has valid classes."""
    spark = pages.sparkSession
    ship(spark)
    limits(spark)
    half = 1 << 32
    tokens = (
        _rows(pages).select("host", F.xxhash64("id", "url").alias("h"), "html").mapInArrow(_tokens, "host string, token string, pages long, hi long, lo long, chars long, links long")
        .groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.sum("hi").alias("hi"), F.sum("lo").alias("lo"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
        .where((F.col("pages") >= MIN_PAGES) | (F.col("token") == ""))  # what a page or two have is in no valid class
        .select("host", "token", "pages", (F.col("hi") % half).alias("hi"), (F.col("lo") % half).alias("lo"), "chars", "links").checkpoint()
    )
    hosts = tokens.where("token = ''").where(F.col("pages") >= MIN_PAGES).select(F.col("host").alias("host2"), F.col("pages").alias("of")).checkpoint()
    frequent = tokens.join(hosts, F.col("host") == F.col("host2")).where(F.col("pages") >= F.greatest(F.lit(MIN_PAGES), F.ceil(F.col("of") * MIN_SHARE)))
    return frequent.select("host", "token", "pages", "hi", "lo", "chars", "links").groupBy("host").applyInPandas(_deduce_host, "host string, template string")


def _extract(batches: Iterable[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    known = {h: json.loads(t) for h, t in sent.value.items()} if sent is not None else {}
    for batch in batches:
        own = batch.column("template").to_pylist() if sent is None else [None] * batch.num_rows
        text = [main_text(Page(s), json.loads(t) if t else known.get(host)) for s, host, t in zip(batch.column("html").to_pylist(), batch.column("host").to_pylist(), own)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, max_templates: int = MAX_TEMPLATES) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    spark = pages.sparkSession
    ensure_checkpoint_dir(spark)
    by_host = templates(pages).checkpoint()
    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string, n_chars long"
    n, size = by_host.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("template")), F.lit(0))).first()
    rows = _rows(pages)
    if n <= max_templates and size <= MAX_TEMPLATE_BYTES:
        sent = spark.sparkContext.broadcast({r["host"]: r["template"] for r in by_host.toLocalIterator()})
        return rows.mapInArrow(lambda it: _extract(it, sent), schema)
    joined = rows.join(by_host.select(F.col("host").alias("host2"), "template"), F.col("host") == F.col("host2"), "left").drop("host2")
    return joined.mapInArrow(lambda it: _extract(it, None), schema)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
