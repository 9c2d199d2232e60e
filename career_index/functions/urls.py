"""URL canonicalisation as native Column expressions.

The parsing follows the generic URL syntax split used by the standard library:
``scheme:`` (letter then letters/digits/``+-.``), ``//netloc`` up to ``/?#``, path, ``?query``,
``#fragment`` (fragment split first, then query).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from career_index.constants import ENCYCLOPEDIA_WIKI, ORIGIN_MAX_LEN, URL_MAX_LEN
from career_index.functions.text import _c, let, settled, stripped, ustrip

SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
NETLOC_RE = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
HAS_NETLOC_RE = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//"
PATH_RE = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
QUERY_RE = r"^[^?#]*\?([^#]*)"
FRAGMENT_RE = r"^[^#]*#(.*)\z"


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def scheme(c) -> Column:
    """Lower-cased scheme, or ``""``."""
    return F.lower(F.regexp_extract(_c(c), SCHEME_RE, 1))


def netloc(c) -> Column:
    """Network location (host, optional userinfo and port) as written; ``""`` if none."""
    return F.regexp_extract(_c(c), NETLOC_RE, 1)


def url_path(c) -> Column:
    return F.regexp_extract(_c(c), PATH_RE, 1)


def _in_row(steps, **start: Column) -> Column:
    """The last step's ``out``. A step is a function from the columns so far (by name) to new ones; each is computed once per row."""
    def after(names: list[str], k: int):
        def body(row: Column) -> Column:
            have = {n: row[n] for n in names}
            new = steps[k](have)
            if k == len(steps) - 1:
                return new["out"]
            have |= new
            return let(F.struct(*[c.alias(n) for n, c in have.items()]), after(list(have), k + 1))
        return body
    return let(F.struct(*[c.alias(n) for n, c in start.items()]), after(list(start), 0))


def with_absolute(df, out: str, base, href):
    """``out`` = P1(P4(base, href)), computed once per row however often it is filtered on.

    The steps are columns, one behind the other: lambdas would be interpreted for every row."""
    name = lambda n: f"_url_{n}"
    kept = [c for c in df.columns if c != out]
    have = {"b": _c(base), "h": _c(href)}
    steps = [*_RESOLVE, lambda v: {"u": v["out"]}, *_NORMALIZE]
    df = settled(df, **{name(n): c for n, c in have.items()})
    names = list(have)
    for step in steps:
        new = step({n: F.col(name(n)) for n in names})
        # Steps with a lambda for rare texts are projections: a generator with one would be interpreted for every row.
        plain = not (new.keys() & {"joined", "bare"})
        df = settled(df, **{name(n): c for n, c in new.items()}) if plain else df.withColumns({name(n): c for n, c in new.items()})
        names += [n for n in new if n not in names]
    return df.select(*[F.col(c) for c in kept], F.col(name("out")).alias(out))


def _normalized(v: dict[str, Column]) -> dict[str, Column]:
    return {"s": F.substring_index(F.translate(v["bare"], "\t\r\n", ""), "#", 1)}


def _without_empty_query(v: dict[str, Column]) -> dict[str, Column]:
    s = v["s"]
    return {"s": F.when(s.endswith("?") & (F.instr(s, "?") == F.length(s)), F.left(s, F.length(s) - 1)).otherwise(s)}


def _lower_scheme(v: dict[str, Column]) -> dict[str, Column]:
    s = v["s"]
    rest = F.regexp_extract(s, r"^[A-Za-z][A-Za-z0-9+.\-]*(:[\s\S]*)\z", 1)
    usual = s.startswith("https:") | s.startswith("http:")
    return {"s": F.when(~usual & s.rlike(SCHEME_RE), F.concat(scheme(s), rest)).otherwise(s)}


def _without_slash(v: dict[str, Column]) -> dict[str, Column]:
    s = v["s"]
    return {"out": F.when(s.endswith("/"), F.left(s, F.length(s) - 1)).otherwise(s)}


#: Steps of P1 from ``u`` to ``out``.
_NORMALIZE = (lambda v: {"bare": stripped(v["u"])}, _normalized, _without_empty_query, _lower_scheme, _without_slash)


def normalize_url(c) -> Column:
    """Strip, drop the fragment and an empty ``?``, lower-case the scheme, drop ONE trailing ``/``."""
    return _in_row(_NORMALIZE, u=_c(c))


def ensure_scheme(c) -> Column:
    """Prepend ``https://`` unless the text starts (case-sensitively) with http:// or https://."""
    s = _c(c)
    return F.when(s.startswith("http://") | s.startswith("https://"), s).otherwise(F.concat(F.lit("https://"), s))


def final_url(c) -> Column:
    """Final-record URL. Strip; add https:// when missing; host must contain a dot;
    at most 220 characters (measured before slash removal); drop one trailing ``/``. Else ``""``.
    The fragment is kept."""
    return let(ustrip(_c(c)), final_url_of_stripped)


def final_url_of_stripped(s: Column) -> Column:
    """P2 of a text without whitespace at its ends. With a scheme in front the host is what stands before the first ``/``, ``?`` or ``#`` behind ``://``."""
    def judged(u: Column) -> Column:
        host = F.substring_index(F.translate(F.substr(u, F.instr(u, "//") + F.lit(2)), "?#", "//"), "/", 1)
        ok = (s != "") & host.contains(".") & (F.length(u) <= URL_MAX_LEN)
        return F.when(ok, F.when(u.endswith("/"), F.left(u, F.length(u) - 1)).otherwise(u)).otherwise(F.lit(""))
    return let(ensure_scheme(s), judged)


def domain_key(c) -> Column:
    """Lower-cased netloc without a leading ``www.`` (port and userinfo stay)."""
    return F.regexp_replace(F.lower(netloc(c)), r"^www\.", "")


def resolve_url(base, href) -> Column:
    """Resolve ``href`` against ``base`` (RFC 3986 style, as the standard library's join).

    Absolute and other-scheme references pass through; ``//host`` takes the base scheme;
    ``?q`` / ``#f`` keep the base path; other paths merge with the base directory and
    resolve ``.`` / ``..`` segments.
    """
    return _in_row(_RESOLVE, b=_c(base), h=_c(href))


def _after(u: Column, mark: str, pattern: str) -> Column:
    """Group 1 of a pattern that needs ``mark``, tried only where that stands."""
    return F.when(~u.contains(mark), F.lit("")).otherwise(F.regexp_extract(u, pattern, 1))


def _schemes(v: dict[str, Column]) -> dict[str, Column]:
    return {"b_scheme": F.lower(_after(v["b"], ":", SCHEME_RE)), "found": _after(v["h"], ":", SCHEME_RE)}


def _reference(v: dict[str, Column]) -> dict[str, Column]:
    """``eff``: the scheme that holds; ``rest``: the reference without its scheme."""
    h, found = v["h"], v["found"]
    return {"eff": F.when(found != "", F.lower(found)).otherwise(v["b_scheme"]),
            "rest": F.when(found != "", F.substr(h, F.length(found) + F.lit(2))).otherwise(h)}


def _reference_parts(v: dict[str, Column]) -> dict[str, Column]:
    return {"path": F.regexp_extract(v["rest"], r"^([^?#]*)", 1), "query": _after(v["rest"], "?", QUERY_RE), "fragment": _after(v["rest"], "#", FRAGMENT_RE)}


def _whole_path(v: dict[str, Column]) -> dict[str, Column]:
    """Base directory + relative path; runs of "/" collapse (empty middle segments are dropped); a root path is taken as is."""
    base_dir = F.regexp_replace(url_path(v["b"]), r"[^/]*\z", "")
    rel = F.regexp_replace(F.concat(base_dir, v["path"]), r"/{2,}", "/")
    return {"whole": F.when(v["path"].startswith("/"), v["path"]).otherwise(rel)}


def _without_dots(v: dict[str, Column]) -> dict[str, Column]:
    """One fold resolves "." / ".."; a path without a segment that starts with "." stays as it is."""
    def step(acc, x):
        arr = acc["a"]
        nxt = (F.when(x == "..", F.when(F.size(arr) > 0, F.slice(arr, 1, F.size(arr) - 1)).otherwise(arr))
               .when(x == ".", arr).otherwise(F.array_append(arr, x)))
        return F.struct(nxt.alias("a"), x.alias("last"))

    def finish(acc):
        arr = F.when(acc["last"].isin(".", ".."), F.array_append(acc["a"], F.lit(""))).otherwise(acc["a"])
        return F.array_join(arr, "/")

    whole = v["whole"]
    init = F.struct(F.array().cast("array<string>").alias("a"), F.lit("").alias("last"))
    dotted = whole.startswith(".") | whole.contains("/.")
    return {"joined": F.when(dotted, F.aggregate(F.split(whole, "/", -1), init, step, finish)).otherwise(whole)}


def _resolved(v: dict[str, Column]) -> dict[str, Column]:
    def tail(q: Column, f: Column) -> Column:
        return F.concat(F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")),
                        F.when(f != "", F.concat(F.lit("#"), f)).otherwise(F.lit("")))

    b, h, eff, rest, joined = v["b"], v["h"], v["eff"], v["rest"], v["joined"]
    scheme_part = F.when(eff != "", F.concat(eff, F.lit(":"))).otherwise(F.lit(""))
    prefix = F.concat(scheme_part, F.when(b.rlike(HAS_NETLOC_RE), F.concat(F.lit("//"), netloc(b))).otherwise(F.lit("")))
    other_scheme = (v["found"] != "") & (F.lower(v["found"]) != v["b_scheme"])
    rooted = F.when(joined == "", F.lit("/")).when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))
    query = F.when(v["query"] != "", v["query"]).otherwise(_after(b, "?", QUERY_RE))
    return {"out": (
        F.when(b == "", h)
        .when(h == "", b)
        .when(other_scheme | ~eff.isin("http", "https", ""), h)
        .when(rest.startswith("//"), F.concat(scheme_part, rest))
        .when(v["path"] == "", F.concat(prefix, url_path(b), tail(query, v["fragment"])))
        .otherwise(F.concat(prefix, rooted, tail(v["query"], v["fragment"])))
    )}


#: Steps of P4 from ``b`` and ``h`` to ``out``.
_RESOLVE = (_schemes, _reference, _reference_parts, _whole_path, _without_dots, _resolved)


def canonical_origin(text) -> Column:
    """P5: first ``https?://...`` or ``www....`` token in free text -> ``scheme://netloc``.

    Trailing ``.,;)`` are removed, https:// is added when missing, the host must contain a dot
    and the token must be at most 200 characters; otherwise ``""``.
    """
    def origin(u: Column) -> Column:
        host = netloc(u)
        return F.when(host.contains(".") & (F.length(u) <= ORIGIN_MAX_LEN), F.concat(scheme(u), F.lit("://"), host)).otherwise(F.lit(""))

    def found(m: Column) -> Column:
        return F.when(m != "", let(ensure_scheme(F.regexp_replace(ustrip(m), r"[.,;)]+\z", "")), origin)).otherwise(F.lit(""))
    return let(F.regexp_extract(_c(text), r"(?iU)(https?://[^\s]+|www\.[^\s]+)", 1), found)


def page_url(title, base: str = ENCYCLOPEDIA_WIKI) -> Column:
    """P10: article URL from a title: strip, spaces -> ``_``, percent-encode (``/`` and ``~`` kept)."""
    t = F.replace(ustrip(_c(title)), F.lit(" "), F.lit("_"))
    enc = F.url_encode(t)
    enc = F.replace(F.replace(F.replace(enc, F.lit("%2F"), F.lit("/")), F.lit("%7E"), F.lit("~")),
                    F.lit("*"), F.lit("%2A"))
    return F.concat(F.lit(base), enc)


def apply_url(url, career) -> Column:
    """The job URL, else the company's career page."""
    u = _c(url)
    return F.when(u.isNull() | (u == ""), _c(career)).otherwise(u)
