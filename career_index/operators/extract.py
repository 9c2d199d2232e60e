"""Extraction jobs over the page table.

HTML is not parsed into a DOM: each job pulls the needed markup with ``regexp_extract_all``, or ``elements`` where elements can be nested,
+ ``posexplode`` and immediately projects ``html`` away, so no later shuffle carries page bodies.
Tag boundaries become spaces before whitespace is collapsed, which equals joining text nodes
with a single space as the scrapers did.
"""

from __future__ import annotations

import json
from functools import reduce
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from career_index.constants import ENCYCLOPEDIA_BASE, ENCYCLOPEDIA_HOST
from career_index.functions import predicates as P
from career_index.functions.text import _c, clean_cell, collapse_ws, collapsed, let, settled, stripped, ustrip
from career_index.functions.urls import canonical_origin, netloc, normalize_url, resolve_url, with_absolute
from career_index.storage import stored

# The rest of an opening tag; a quoted value may hold ">".
TAG_REST = r"(?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>=]++|=)*+"
# One step through an opening tag, never ending inside a quoted value.
TAG_STEP = r"(?>=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=|[^>=\s]++|\s)"
ANCHOR_RE = rf"(?is)<a\s{TAG_REST}>.*?</a>"
# A character reference behind its "&": a number, or up to 32 characters of a name.
NUMBER_RE = r"^#([0-9]+);?"
HEX_RE = r"^#[xX]([0-9a-fA-F]+);?"
NAME_RE = r"^([^\t\n\f <&#;]{1,32};?)"
# Names that also count without a semicolon, and with other characters behind them; the longest is taken.
SHORT_NAME_RE = "^(" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))) + ")"
TAG_RE = r"<[^>]*>"
HIDDEN_RE = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
# A JSON-LD script's content is group 1; comments and other scripts are stepped over.
SCRIPT_LD_RE = (r"(?is)<script\b[^>]*type\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script>"
                r"|<script\b.*?</script>|<!--.*?-->")


def class_value(token: str) -> str:
    """Pattern of a ``class`` attribute that holds ``token`` as a whole word between blanks or quotes."""
    return rf"class\s*=\s*[\"'](?:[^\"']*\s)?{token}(?:\s[^\"']*)?[\"']"


def _names() -> Column:
    """Characters of the named references of HTML 5, by first letter and name; two short lookups in place of one long one."""
    by_letter: dict[str, dict[str, str]] = {}
    for name, chars in html5.items():
        by_letter.setdefault(name[0], {})[name] = chars
    return F.from_json(F.lit(json.dumps(by_letter)), "map<string,map<string,string>>")


def _numbered(digits: Column, base: int) -> Column:
    """The text of a numeric reference: U+FFFD where there is no such character, nothing for controls and non-characters, and Windows-1252 from 128 to 159."""
    bare = F.ltrim(digits, F.lit("0"))
    code = F.when(F.length(bare) > 9, F.lit(1 << 30)).when(bare == "", F.lit(0)).otherwise(
        (F.conv(bare, 16, 10) if base == 16 else bare).try_cast("bigint"))

    def char(n: Column) -> Column:
        none = (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
        silent = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
        old = F.substr(F.lit("".join(bytes([k]).decode("cp1252", "replace").replace("\ufffd", chr(k)) for k in range(128, 160))), (n - 127).cast("int"), F.lit(1))
        utf = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        return F.when(none, F.lit("\ufffd")).when(silent, F.lit("")).when(n.between(128, 159), old).otherwise(utf)

    return let(code, char)


def decode_entities(c) -> Column:
    """Character references replaced once, as HTML 5 has them: numbers, names, and the longest name in front where a semicolon is missing."""
    def piece(t: Column, names: Column) -> Column:
        def named(name: Column) -> Column:
            return F.element_at(F.element_at(names, F.left(name, F.lit(1))), name)

        def with_name(name: Column) -> Column:
            short = let(F.regexp_extract(t, SHORT_NAME_RE, 1), lambda n: F.when(n != "", F.concat(named(n), F.substr(t, F.length(n) + F.lit(1)))))
            return let(named(name), lambda w: F.when(w.isNotNull(), F.concat(w, F.substr(t, F.length(name) + F.lit(1)))).otherwise(short))

        def number(pattern: str, base: int) -> Column:
            return F.concat(_numbered(F.regexp_extract(t, pattern, 1), base), F.regexp_replace(t, pattern, ""))

        known = (F.when(t.rlike(HEX_RE), number(HEX_RE, 16)).when(t.rlike(NUMBER_RE), number(NUMBER_RE, 10))
                 .when(t.rlike("^[A-Za-z]"), let(F.regexp_extract(t, NAME_RE, 1), with_name)))
        return F.coalesce(known, F.concat(F.lit("&"), t))

    # The table stands in the plan once per call. A column is read again at no cost, and texts without "&" meet no lambda.
    def decoded(x: Column) -> Column:
        return F.when(x.contains("&"), let(_names(), lambda names: F.array_join(F.transform(
            F.split(x, "&"), lambda t, i: F.when(i == 0, t).otherwise(piece(t, names))), ""))).otherwise(x)
    return decoded(F.col(c)) if isinstance(c, str) else let(c, decoded)


def tag_text(inner) -> Column:
    """Visible text of a markup fragment: tags -> spaces, entities decoded, whitespace collapsed, stripped."""
    return ustrip(collapse_ws(decode_entities(F.regexp_replace(_c(inner), TAG_RE, " "))))


# Elements without an end tag.
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
OPEN_TAG_RE = rf"(?is)^<[a-z][a-z0-9]*(?:\s{TAG_REST}|/)?>"
ANY_TAG = "[a-z][a-z0-9]*"


def elements(markup, wanted: str, tags: str = ANY_TAG, kinds: dict[str, str] | None = None) -> Column:
    """Elements whose start tag matches ``wanted``, in document order, nested ones too: an array of (open, inner), and whether the start tag matches
    each pattern of ``kinds``.

    One fold over the tags keeps the stack of open elements. An end tag closes the last open element of its name and all that are open within it; elements
    left open end with the markup. ``tags``: the names that are looked at. A "<" within an attribute value is read as a tag.
    """
    mark = "struct<n:string,s:int,w:boolean>"

    def close(acc: Column, m: Column) -> Column:
        stack = acc["stack"]

        def closed(back: Column) -> Column:
            at = F.size(stack) - back + 1
            ended = F.transform(F.filter(F.slice(stack, at, F.greatest(back, F.lit(0))), lambda o: o["w"]), lambda o: F.struct(o["s"].alias("s"), m["s"].alias("e")))
            return F.when(back > 0, F.struct(F.slice(stack, 1, at - 1).alias("stack"), F.concat(acc["spans"], ended).alias("spans"))).otherwise(acc)

        return let(F.array_position(F.reverse(F.transform(stack, lambda o: o["n"])), m["n"]).cast("int"), closed)

    def step(acc: Column, m: Column) -> Column:
        opened = F.struct(F.array_append(acc["stack"], m["o"]).alias("stack"), acc["spans"].alias("spans"))
        return F.when(m["shut"], close(acc, m["o"])).when(m["o"]["n"] != "", opened).otherwise(acc)

    def of_pieces(pieces: Column) -> Column:
        def marked(p: Column, i: Column) -> Column:
            def opened(name: Column) -> Column:
                empty = name.isin(*VOID_TAGS) | p.rlike("(?s)^<[^>]*/>")
                return F.struct(p.startswith("</").alias("shut"), F.struct(F.when(empty, F.lit("")).otherwise(name).alias("n"), i.alias("s"), p.rlike(wanted).alias("w")).alias("o"))
            return let(F.lower(F.regexp_extract(p, f"(?i)^</?({tags})(?=[\\s/>])", 1)), opened)

        start = F.struct(F.array().cast(f"array<{mark}>").alias("stack"), F.array().cast("array<struct<s:int,e:int>>").alias("spans"))
        left = lambda acc: F.transform(F.filter(acc["stack"], lambda o: o["w"]), lambda o: F.struct(o["s"].alias("s"), F.size(pieces).alias("e")))
        spans = F.aggregate(F.transform(pieces, marked), start, step, lambda acc: F.array_sort(F.concat(acc["spans"], left(acc))))

        def element(x: Column) -> Column:
            return let(F.get(pieces, x["s"]), lambda p: let(F.regexp_extract(p, OPEN_TAG_RE, 0), lambda t: F.struct(
                t.alias("open"), F.concat(F.substr(p, F.length(t) + F.lit(1)), F.array_join(F.slice(pieces, x["s"] + 2, x["e"] - x["s"] - 1), "")).alias("inner"),
                *[p.rlike(pattern).alias(kind) for kind, pattern in (kinds or {}).items()])))
        return F.transform(spans, element)

    return let(F.split(_c(markup), f"(?i)(?=</?(?:{tags})[\\s/>])"), of_pieces)


def with_class(token: str, tag: str = ANY_TAG) -> str:
    """Pattern of a start tag with ``token`` among its classes."""
    return rf"(?is)^<{tag}\s(?:[^>]*\s)?{class_value(token)}"


def _attr_value(t: Column, name: str) -> Column:
    """Value of attribute ``name`` as written, with its quotes."""
    pat = rf"(?is)^<\w+{TAG_STEP}*?\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
    return F.when(~F.lower(t).contains(name), F.lit("")).otherwise(F.regexp_extract(t, pat, 1))


def _unquoted(v: Column) -> Column:
    return F.when(v.startswith('"') | v.startswith("'"), F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v)


def attr(tag, name: str) -> Column:
    """Value of attribute ``name`` in an opening tag ('' when absent); entities decoded."""
    return decode_entities(let(let(_c(tag), lambda t: _attr_value(t, name)), _unquoted))


def has_attr(tag, name: str) -> Column:
    return _c(tag).rlike(rf"(?is)^<\w+{TAG_STEP}*?\s{name}\s*=")


def _open_tag(a) -> Column:
    """The start tag of an anchor that ``ANCHOR_RE`` has found."""
    return F.regexp_extract(_c(a), rf"(?is)^(<a\s{TAG_REST}>)", 1)


def _inner(a, open_tag) -> Column:
    """What stands between ``open_tag`` and the end tag of an anchor that ``ANCHOR_RE`` has found."""
    return F.substr(_c(a), F.length(open_tag) + F.lit(1), F.length(a) - F.length(open_tag) - len("</a>"))


def shown(html) -> Column:
    """Markup without comments, scripts and styles."""
    return F.regexp_replace(_c(html), HIDDEN_RE, " ")


def anchor_tags(markup) -> Column:
    """Every ``<a ...>...</a>`` of shown markup (see ``shown``), as written."""
    return F.regexp_extract_all(_c(markup), F.lit(ANCHOR_RE), 0)


def parse_anchors(df: DataFrame, tags, keep: list[str]) -> DataFrame:
    """Explode anchor tags -> keep + (pos, href, text, title, aria_label); anchors without ``href`` go."""
    ex = df.select(*keep, F.posexplode(_c(tags)).alias("pos", "_a"))
    ex = settled(ex, _open=_open_tag("_a"))
    ex = ex.where(has_attr("_open", "href"))
    # One step behind the other, as columns: lambdas would be interpreted for every anchor, and what is read twice would be computed twice.
    names = ("href", "title", "aria_label")
    ex = settled(ex, text=F.regexp_replace(_inner("_a", "_open"), TAG_RE, " "), **{n: _attr_value(F.col("_open"), n.replace("_", "-")) for n in names})
    ex = settled(ex.drop("_a", "_open"), **{n: _unquoted(F.col(n)) for n in names})
    ex = ex.withColumns({n: decode_entities(n) for n in ("text", *names)})
    ex = ex.withColumns({"text": collapsed(F.col("text"))})
    ex = ex.withColumns({n: stripped(F.col(n)) for n in ("text", *names)})
    # Behind a generator again, so that filters stay above all of it.
    ex = settled(ex, **{n: F.col(n) for n in ("text", *names)})
    return ex.select(*keep, "pos", "href", "text", "title", "aria_label")


def anchors(df: DataFrame, html_col: str, keep: list[str]) -> DataFrame:
    """Every ``<a href=...>`` of ``html_col``: keep + (pos, href, text, title, aria_label)."""
    return parse_anchors(df, anchor_tags(shown(html_col)), keep)


def links(pages: DataFrame, base: Column | None = None) -> DataFrame:
    """One row per anchor: (page_id, page_url, pos, href, text, title, aria_label, absolute)."""
    df = pages.select("page_id", F.col("url").alias("page_url"), "html")
    a = anchors(df, "html", ["page_id", "page_url"])
    b = base if base is not None else F.col("page_url")
    return with_absolute(a, "absolute", b, F.col("href"))


def page_text(pages: DataFrame, *extra, has_content: bool = False) -> DataFrame:
    """(page_id, title, h1, body): ``<title>`` string, first ``<h1>`` text, visible body text.

    ``extra`` columns are added, and may read the markup without comments, scripts and styles as ``_shown``; ``has_content`` drops pages without content."""
    pages = pages.where(F.length(F.btrim("html")) > 0) if has_content else pages
    pages = settled(pages, _shown=shown("html"))
    h = F.col("_shown")
    title = let(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1), lambda t: F.when(t.contains("<"), F.lit("")).otherwise(decode_entities(t)))
    h1 = tag_text(F.regexp_extract(h, r"(?is)<h1(?:\s[^>]*)?>(.*?)</h1>", 1))
    body = F.regexp_replace(h, r"(?is)<template\b.*?</template>", " ")
    return pages.select("page_id", title.alias("title"), h1.alias("h1"), tag_text(body).alias("body"), *extra)


def career_links(pages: DataFrame) -> DataFrame:
    """Anchors whose text / title / aria-label / href mention a career keyword; distinct
    absolute URL per page, first occurrence wins."""
    ln = links(pages).where(F.col("href") != "")
    blob = F.lower(F.concat_ws(" ", "text", "title", "aria_label", "href"))
    ln = ln.where(P.has_career_keyword(blob))
    first = ln.groupBy("page_id", "absolute").agg(F.min("pos").alias("pos"))
    return first.select("page_id", "pos", "absolute")


# ---------------------------------------------------------------------------- JSON-LD


def ld_scripts(html) -> Column:
    """Contents of the JSON-LD scripts of a page, as written."""
    found = F.filter(F.regexp_extract_all(_c(html), F.lit(SCRIPT_LD_RE), 1), lambda x: x != "")
    return F.when(~F.lower(_c(html)).contains("ld+json"), F.array().cast("array<string>")).otherwise(found)


def parse_ld(df: DataFrame, scripts) -> DataFrame:
    """Valid JSON payloads: (page_id, script_pos, raw). Repeated keys are valid; the last value counts."""
    ex = df.select("page_id", F.posexplode(_c(scripts)).alias("script_pos", "raw"))
    ex = ex.withColumn("raw", ustrip("raw"))
    repeated = (F.col("raw").rlike(r"(?s)^\{.*\}\z") & F.from_json("raw", "map<string,string>").isNotNull()) \
        | (F.col("raw").rlike(r"(?s)^\[.*\]\z") & F.from_json("raw", "array<string>").isNotNull())
    return ex.where((F.col("raw") != "") & (F.try_parse_json("raw").isNotNull() | repeated))


def json_ld(pages: DataFrame) -> DataFrame:
    """JSON-LD payloads per page: (page_id, script_pos, raw); invalid JSON is skipped."""
    return parse_ld(pages, ld_scripts("html"))


# ``from_json`` into string values drops the quotes, so a quoted "{" would pass for an object. A
# letter put before every string (keys too) keeps strings, objects, arrays and numbers apart.
_STRING = "s"


def _marked(raw) -> Column:
    return F.regexp_replace(_c(raw), r'"((?:[^"\\]++|\\.)*+)"', f'"{_STRING}$1"')


def _kind(j: Column) -> Column:
    t = F.ltrim(j)
    return F.when(t.startswith("{"), F.lit("o")).when(t.startswith("["), F.lit("a")).otherwise(F.lit("s"))


def _entries(j: Column) -> Column:
    """Key / value pairs of a marked object in document order; of repeated keys the last stays."""
    def last(obj: Column) -> Column:
        pairs = F.map_entries(obj)
        of_keys = lambda keys: F.when(F.size(F.array_distinct(keys)) == F.size(keys), pairs).otherwise(
            F.filter(pairs, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"])))
        return let(F.map_keys(obj), of_keys)
    return let(F.from_json(j, "map<string,string>"), last)


def _value(j: Column, key: str) -> Column:
    """Marked value of ``key`` in a marked object, null where absent."""
    found = F.filter(F.map_entries(F.from_json(j, "map<string,string>")), lambda e: e["key"] == _STRING + key)
    return F.try_element_at(found, F.lit(-1))["value"]


def _text(v: Column) -> Column:
    """A marked value as text: strings without the mark, others as written."""
    return F.when(v.startswith(_STRING), F.substr(v, F.lit(2))).otherwise(v)


def job_postings(payloads: DataFrame, max_depth: int = 200) -> DataFrame:
    """JobPosting objects at any depth in document order, level by level until none is left.

    Raises if there are more than ``max_depth`` levels; it never returns short.

    Objects are read with ``from_json`` as marked key / value pairs, which keep key order, so
    nested postings come out in document (pre-)order. Returns (page_id, path, title, url)
    where ``path`` sorts in walk order.
    """
    level = payloads.select("page_id", F.array(F.col("script_pos")).alias("path"), _marked("raw").alias("j"))
    found = []
    for depth in range(max_depth + 2):
        # The entries and the type become columns, so that each is read once.
        k = _kind(F.col("j"))
        read = level.select("page_id", "path", k.alias("k"), "j", F.when(k == "o", _entries(F.col("j"))).alias("e"))

        def field(name):
            return F.get(F.filter("e", lambda e: e["key"] == _STRING + name), F.lit(0))["value"]
        typ = field("@type")
        is_post = (typ == _STRING + "JobPosting") | (typ.startswith("[") & F.coalesce(
            F.array_contains(F.from_json(typ, "array<string>"), _STRING + "JobPosting"), F.lit(False)))
        text = lambda name: F.when(is_post, ustrip(F.coalesce(_text(field(name)), F.lit(""))))
        kids = F.when(F.col("k") == "o", F.transform("e", lambda e: e["value"])) \
            .when(F.col("k") == "a", F.from_json(F.col("j"), "array<string>"))
        inner = F.filter(F.transform(kids, lambda x, i: F.struct(i.alias("p"), x.alias("j"))), lambda x: _kind(x["j"]) != "s")
        # Written once: the postings of a level and the next level are read from the same rows, and no level runs again.
        read = stored(read.select("page_id", "path", text("title").alias("title"), text("url").alias("url"), inner.alias("inner")), "json-level")
        found.append(read.where("title <> '' AND url <> ''").select("page_id", "path", "title", "url"))
        rest = read.where("size(inner) > 0")
        if rest.isEmpty():
            break
        if depth == max_depth:
            raise ValueError(f"JSON is nested deeper than {max_depth} levels")
        level = rest.select("page_id", "path", F.explode("inner").alias("x")).select("page_id", F.array_append("path", F.col("x.p")).alias("path"), "x.j")
    out = reduce(lambda a, b: a.unionByName(b), found)
    return out.withColumn("url", normalize_url("url"))


def json_ld_country(payloads: DataFrame) -> DataFrame:
    """First non-blank ``address.addressCountry`` of a top-level object or list item."""
    objs = _top_objects(payloads)
    addr = _value(F.col("j"), "address")
    objs = objs.select("page_id", "script_pos", "item", addr.alias("addr")).where(_kind(F.col("addr")) == "o")
    raw = _value(F.col("addr"), "addressCountry")
    cands = objs.select("page_id", "script_pos", "item",
                        F.when(raw.startswith(_STRING), ustrip(_text(raw))).alias("country"))
    cands = cands.where(F.col("country") != "")
    return cands.groupBy("page_id").agg(F.min_by("country", F.struct("script_pos", "item")).alias("country"))


def _top_objects(payloads: DataFrame) -> DataFrame:
    """Marked objects at the top of a payload or directly in its list: (page_id, script_pos, item, j)."""
    m = payloads.select("page_id", "script_pos", _marked("raw").alias("j"))
    one = F.array(F.col("j"))
    items = F.when(_kind(F.col("j")) == "a", F.from_json("j", "array<string>")).otherwise(one)
    return m.select("page_id", "script_pos", F.posexplode(items).alias("item", "j")).where(_kind(F.col("j")) == "o")


# ---------------------------------------------------------------------------- list tables


def list_rows(pages: DataFrame) -> DataFrame:
    """Candidate rows of ``table.wikitable`` tables.

    Header cells of the first row locate the name / website / country columns by token; data
    rows (not all ``th``) with a non-empty name emit (page_id, table_pos, row_pos, name,
    website, country, company_wiki_url). Website: first ``http`` link of the website column,
    else the first off-encyclopedia ``http`` link of any cell (X5). Detail link: first
    ``/wiki/`` link without ``:`` in the name cell (X6).
    """
    from career_index.constants import COUNTRY_HEADER_TOKENS, NAME_HEADER_TOKENS, WEBSITE_HEADER_TOKENS
    tables = pages.select("page_id", F.posexplode(elements(shown("html"), with_class("wikitable", "table"), "table")).alias("table_pos", "t"))
    rows = tables.select("page_id", "table_pos", F.posexplode(elements("t.inner", "(?i)^<tr", "tr")).alias("row_pos", "r"))
    cells = rows.select("page_id", "table_pos", "row_pos", F.posexplode(elements("r.inner", "(?i)^<t[hd]", "th|td")).alias("cell_pos", "c"))
    cells = cells.select("page_id", "table_pos", "row_pos", "cell_pos", F.lower(F.substring("c.open", 3, 1)).alias("kind"), F.col("c.inner").alias("inner"))
    cells = settled(cells, text=clean_cell(tag_text("inner")))

    head = cells.where((F.col("row_pos") == 0) & (F.col("kind") == "h"))
    hw = head.select("page_id", "table_pos", "cell_pos", F.lower("text").alias("h"))
    # header index = position among th cells of the first row
    from pyspark.sql import Window
    hw = hw.withColumn("hidx", F.row_number().over(Window.partitionBy("page_id", "table_pos").orderBy("cell_pos")) - 1)

    def idx(tokens):
        hit = F.exists(F.array(*[F.lit(t) for t in tokens]), lambda x: F.col("h").contains(x))
        return F.min(F.when(hit, F.col("hidx")))
    hdr = hw.groupBy("page_id", "table_pos").agg(idx(NAME_HEADER_TOKENS).alias("name_idx"),
                                                 idx(WEBSITE_HEADER_TOKENS).alias("web_idx"),
                                                 idx(COUNTRY_HEADER_TOKENS).alias("country_idx"))
    hdr = hdr.where(F.col("name_idx").isNotNull())

    data = cells.where(F.col("row_pos") > 0).join(hdr, ["page_id", "table_pos"])
    lk = data.select("page_id", "table_pos", "row_pos", "cell_pos", "name_idx", "web_idx",
                     F.posexplode(F.regexp_extract_all("inner", F.lit(ANCHOR_RE), 0)).alias("link_pos", "_a"))
    lk = settled(lk, _open=_open_tag("_a"))
    lk = settled(lk.where(has_attr("_open", "href")), href=ustrip(attr("_open", "href")))
    is_http = F.col("href").startswith("http")
    at = F.struct("cell_pos", "link_pos")
    web = lk.groupBy("page_id", "table_pos", "row_pos").agg(
        F.min_by(F.when(is_http & (F.col("cell_pos") == F.col("web_idx")), F.col("href")),
                 F.when(is_http & (F.col("cell_pos") == F.col("web_idx")), at)).alias("w1"),
        F.min_by(F.when(is_http & ~F.col("href").contains(ENCYCLOPEDIA_HOST), F.col("href")),
                 F.when(is_http & ~F.col("href").contains(ENCYCLOPEDIA_HOST), at)).alias("w2"),
        F.min_by(F.when((F.col("cell_pos") == F.col("name_idx")) & F.col("href").startswith("/wiki/")
                        & ~F.col("href").contains(":"), F.col("href")),
                 F.when((F.col("cell_pos") == F.col("name_idx")) & F.col("href").startswith("/wiki/")
                        & ~F.col("href").contains(":"), at)).alias("wiki"))

    agg = data.groupBy("page_id", "table_pos", "row_pos").agg(
        F.max(F.when(F.col("kind") == "d", 1).otherwise(0)).alias("has_td"),
        F.max(F.when(F.col("cell_pos") == F.col("name_idx"), F.col("text"))).alias("name"),
        F.max(F.when(F.col("cell_pos") == F.col("country_idx"), F.col("text"))).alias("country"))
    out = agg.where((F.col("has_td") == 1) & F.col("name").isNotNull() & (F.col("name") != "")) \
        .join(web, ["page_id", "table_pos", "row_pos"], "left")
    return out.select(
        "page_id", "table_pos", "row_pos", "name",
        F.coalesce(normalize_url(F.coalesce(F.col("w1"), F.col("w2"))), F.lit("")).alias("website"),
        F.when(F.coalesce(F.col("country"), F.lit("")) == "", F.lit("Unknown")).otherwise(F.col("country")).alias("country"),
        F.when(F.col("wiki").isNotNull(), F.concat(F.lit(ENCYCLOPEDIA_BASE), F.col("wiki"))).otherwise(F.lit(""))
        .alias("company_wiki_url"))


def infobox_website(pages: DataFrame) -> DataFrame:
    """Website from an article page: rows of ``table.infobox`` whose header mentions
    "website" -> first off-encyclopedia ``http`` link in the row's data cells; else the first
    such link of the official-website / homepage list items. Returns (page_id, website)."""
    boxes = pages.select("page_id", F.posexplode(elements(shown("html"), with_class("infobox", "table"), "table")).alias("box_pos", "t"))
    rows = boxes.select("page_id", "box_pos", F.posexplode(elements("t.inner", "(?i)^<tr", "tr")).alias("row_pos", "r"))
    rows = rows.select("page_id", "box_pos", "row_pos", elements("r.inner", "(?i)^<t[hd]", "th|td").alias("cells"))
    of_kind = lambda kind: F.filter("cells", lambda c: F.lower(F.substring(c["open"], 3, 1)) == kind)
    rows = rows.where(F.lower(tag_text(F.coalesce(F.get(of_kind("h"), F.lit(0))["inner"], F.lit("")))).contains("website"))
    tds = F.array_join(F.transform(of_kind("d"), lambda c: c["inner"]), " ")
    lk = rows.select("page_id", "box_pos", "row_pos", F.lit(0).alias("stage"),
                     F.posexplode(F.regexp_extract_all(tds, F.lit(ANCHOR_RE), 0)).alias("link_pos", "_a"))
    li = pages.select("page_id", F.lit(0).alias("box_pos"), F.lit(0).alias("row_pos"), F.lit(1).alias("stage"),
                      F.posexplode(F.regexp_extract_all(shown("html"), F.lit(
                          r"(?is)<li\s[^>]*id\s*=\s*[\"']t-(?:officialwebsite|homepage)[\"'][^>]*>.*?</li>"), 0)).alias("li_pos", "li"))
    li = li.select("page_id", "box_pos", "row_pos", "stage", "li_pos",
                   F.posexplode(F.regexp_extract_all("li", F.lit(ANCHOR_RE), 0)).alias("lp", "_a"))
    li = li.select("page_id", "box_pos", F.col("li_pos").alias("row_pos"), "stage", F.col("lp").alias("link_pos"), "_a")
    allk = lk.unionByName(li)
    allk = settled(allk, href=ustrip(attr(_open_tag("_a"), "href")))
    allk = allk.where(F.col("href").startswith("http") & ~F.col("href").contains(ENCYCLOPEDIA_HOST))
    return allk.groupBy("page_id").agg(
        normalize_url(F.min_by("href", F.struct("stage", "box_pos", "row_pos", "link_pos"))).alias("website"))


# ---------------------------------------------------------------------------- directories


def category_urls(pages: DataFrame, base: str) -> DataFrame:
    """Category links (href contains ``/directory/wpbdp_category/``), resolved against the
    directory root, distinct per page in first-seen order: (page_id, pos, url)."""
    a = anchors(pages.select("page_id", "html"), "html", ["page_id"])
    a = a.where(F.col("href").contains("/directory/wpbdp_category/") & (F.col("href") != ""))
    a = with_absolute(a, "url", F.lit(base), F.col("href"))
    return a.groupBy("page_id", "url").agg(F.min("pos").alias("pos"))


def listing_urls(pages: DataFrame, base: str) -> DataFrame:
    """Links inside ``.listing-title`` elements pointing under ``/directory/``, excluding
    category and view URLs; distinct per page in first-seen order: (page_id, pos, url)."""
    blocks = pages.select("page_id", F.posexplode(F.transform(elements(shown("html"), with_class("listing-title")), lambda e: e["inner"])).alias("block_pos", "b"))
    a = blocks.select("page_id", "block_pos", F.posexplode(F.regexp_extract_all("b", F.lit(ANCHOR_RE), 0)).alias("lp", "_a"))
    a = settled(a, _open=_open_tag("_a"))
    a = settled(a.where(has_attr("_open", "href")), href=ustrip(attr("_open", "href")))
    a = a.where(F.col("href").contains("/directory/") & (F.col("href") != ""))
    a = with_absolute(a, "url", F.lit(base), F.col("href"))
    a = a.where(~F.col("url").contains("/wpbdp_category/") & ~F.col("url").contains("wpbdp_view="))
    return a.groupBy("page_id", "url").agg(F.min(F.struct("block_pos", "lp")).alias("pos"))


_FIELDS = {field: with_class("wpbdp-field-" + field) for field in ("business_name", "website", "category")}


def _fields(html: Column) -> Column:
    """The elements of all fields, found by one fold."""
    return elements(html, "|".join(_FIELDS.values()), kinds=_FIELDS)


def _field(html: Column, field: str) -> Column:
    """Text of the first ``.value`` (else ``.wpbdp-field-value``) element inside ``.wpbdp-field-<field>``."""
    return let(_fields(html), lambda fields: _field_of(fields, field))


def _field_of(fields: Column, field: str) -> Column:
    inside = F.array_join(F.transform(F.filter(fields, lambda e: e[field]), lambda e: e["inner"]), " ")

    def first(cls: str):
        return lambda x: F.get(elements(x, with_class(cls)), F.lit(0))["inner"]
    return tag_text(let(inside, lambda x: F.coalesce(first("value")(x), first("wpbdp-field-value")(x), F.lit(""))))


def listing_records(pages: DataFrame, source: str = "eu_startups") -> DataFrame:
    """One record per listing page: name from ``h1`` (business-name field when the h1
    looks like a URL), website via P5 from the website field, country from the category field."""
    def record(h: Column) -> Column:
        return let(_fields(h), lambda fields: read(h, fields))

    def read(h: Column, fields: Column) -> Column:
        h1 = F.when(h.rlike(r"(?is)<h1(?:\s[^>]*)?>"), tag_text(F.regexp_extract(h, r"(?is)<h1(?:\s[^>]*)?>(.*?)</h1>", 1)))
        name = let(h1, lambda n: F.when(P.looks_like_url(n), let(_field_of(fields, "business_name"), lambda b: F.when(b != "", b).otherwise(n))).otherwise(n))
        return F.struct(name.alias("name"), canonical_origin(_field_of(fields, "website")).alias("website"), _field_of(fields, "category").alias("country"))

    def whole(r: Column) -> Column:
        return r["name"].isNotNull() & (r["name"] != "") & ~P.looks_like_url(r["name"]) & (r["website"] != "")
    # Filtered within the row: a filter behind the projection would be pushed below it with all its expressions written out again.
    out = pages.select("page_id", F.col("url").alias("source_url"), F.explode(F.filter(F.array(let(shown("html"), record)), whole)).alias("r"))
    return out.select(
        "page_id", "r.name", "r.website",
        F.when(F.col("r.country") == "", F.lit("Unknown")).otherwise(F.col("r.country")).alias("country_of_origin"),
        F.lit(source).alias("source"), "source_url")


def profile_urls(pages: DataFrame, host_token: str, marker: str) -> DataFrame:
    """X11: profile URLs of a list page: JSON-LD top-level ``url`` values first, then anchors;
    kept when F15 holds; distinct per page in (stage, pos) order: (page_id, stage, pos, url)."""
    objs = _top_objects(json_ld(pages))
    u = ustrip(F.coalesce(_text(_value(F.col("j"), "url")), F.lit("")))
    s0 = objs.select("page_id", F.lit(0).alias("stage"), F.struct("script_pos", "item").alias("p"), u.alias("raw_url"))
    # Narrow rows, written once: the tests below would each repeat the parsing otherwise.
    s0 = stored(s0, "profile-payloads")
    s0 = s0.where(P.is_profile_url(F.col("raw_url"), host_token, marker)).withColumn("url", normalize_url("raw_url"))
    ln = stored(links(pages).select("page_id", "pos", "absolute"), "profile-links")
    s1 = ln.select("page_id", F.lit(1).alias("stage"), F.struct(F.col("pos").alias("script_pos"), F.lit(0).alias("item")).alias("p"),
                   F.col("absolute").alias("url"))
    s1 = s1.where(P.is_profile_url(F.col("url"), host_token, marker))
    allp = s0.select("page_id", "stage", "p", "url").unionByName(s1)
    return allp.groupBy("page_id", "url").agg(F.min(F.struct("stage", "p")).alias("o")).select(
        "page_id", F.col("o.stage").alias("stage"), F.col("o.p").alias("pos"), "url")


def profile_records(pages: DataFrame, source: str, exclude_hosts=("clutch.co", "themanifest.com")) -> DataFrame:
    """name = ``h1`` text; website = first outbound ``http`` link labelled as a website,
    else the first outbound ``http`` link; country from JSON-LD (X14) or ``Unknown``."""
    from career_index.constants import WEBSITE_LINK_LABELS
    h1 = tag_text(F.regexp_extract(shown("html"), r"(?is)<h1(?:\s[^>]*)?>(.*?)</h1>", 1))
    pt = pages.select("page_id", F.col("url").alias("source_url"), F.explode(F.filter(F.array(h1), lambda n: n != "")).alias("name"))
    a = anchors(pages.select("page_id", "html"), "html", ["page_id"])
    host = F.lower(netloc("href"))
    outbound = F.col("href").startswith("http")
    for hx in exclude_hosts:
        outbound = outbound & ~host.contains(hx)
    a = a.where(outbound)
    label = F.concat_ws(" ", F.lower("text"), F.lower("title"), F.lower("aria_label"))
    labelled = F.exists(F.array(*[F.lit(x) for x in WEBSITE_LINK_LABELS]), lambda t: label.contains(t))
    web = a.groupBy("page_id").agg(
        F.coalesce(F.min_by(F.when(labelled, F.col("href")), F.when(labelled, F.col("pos"))),
                   F.min_by("href", "pos")).alias("href"))
    country = json_ld_country(json_ld(pages))
    out = pt.join(web, "page_id", "left").join(country, "page_id", "left")
    out = out.select("page_id", "name", normalize_url(F.coalesce("href", F.lit(""))).alias("website"),
                     F.coalesce("country", F.lit("Unknown")).alias("country_of_origin"),
                     F.lit(source).alias("source"), "source_url")
    return out.where(F.col("website") != "")
