"""Column expressions over text, names and URLs."""

from __future__ import annotations

import html as entities
import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import DROPPED_TAGS, LEGAL_SUFFIX

NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"  # RFC 4122


def canonical_url(url: Column) -> Column:
    """Lower-cased scheme and authority, tracking parameters and fragment dropped, parameters sorted; null for other than http(s) with a host and no user."""
    part = lambda what: F.try_parse_url(url, F.lit(what))
    scheme, authority = F.lower(part("PROTOCOL")), F.lower(part("AUTHORITY"))
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)
    pairs = F.transform(
        F.filter(F.split(F.coalesce(part("QUERY"), F.lit("")), "&"), lambda p: p != ""),
        lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("k"), F.when(p.contains("="), decoded(F.regexp_replace(p, "^[^=]*=", ""))).otherwise("").alias("v")),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~(F.lower(p["k"]).startswith("utm_") | F.lower(p["k"]).isin("fbclid", "gclid"))))
    query = F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")
    path = F.coalesce(F.nullif(part("PATH"), F.lit("")), F.lit("/"))
    whole = F.concat(scheme, F.lit("://"), authority, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(scheme.isin("http", "https") & (F.coalesce(part("HOST"), F.lit("")) != "") & part("USERINFO").isNull(), whole)


def normalize_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9 ]", " "), " +", " "))


def short_name(name: Column) -> Column:
    """Without legal suffixes at the end."""
    return F.trim(F.regexp_replace(name, LEGAL_SUFFIX, ""))


#: What follows the & of a character reference; names that HTML 5 reads without a semicolon, the longest first; all names, the frequent first; the first 160 numbers, as characters.
REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
BARE = tuple(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
NAMED = dict(sorted(html5.items(), key=lambda n: n[0] not in ("amp;", "nbsp;", "lt;", "gt;", "quot;")))
NUMBERED = [entities.unescape(f"&#{n};") for n in range(160)]


def once(value: Column, make) -> Column:
    """make(value), with value worked out once however often it is mentioned."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def numbered(reference: Column) -> Column:
    """The character of #38; or #x26; by the rules of HTML 5."""
    hexadecimal = F.lower(reference.substr(2, 1)) == "x"
    digits = F.regexp_extract(reference, "^#[xX]?0*([0-9a-fA-F]*)", 1)
    number = F.when(F.length(digits) > 7, 0x110000).when(digits == "", 0).otherwise(F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits).cast("int"))
    wide = lambda n: F.decode(F.unhex(F.concat(F.lit("00000041"), F.lpad(F.hex(n), 8, "0"))), "UTF-32").substr(2, 1)  # noqa: E731 (a letter first, as FEFF would be a byte order mark)
    return once(
        number,
        lambda n: F.when(n < 160, F.get(F.array(*map(F.lit, NUMBERED)), n))
        .when(n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "\ufffd")
        .when(n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE), "")
        .otherwise(wide(n)),
    )


def named(reference: Column, bare: tuple[str, ...] = BARE) -> Column:
    """The characters of amp; or, without a known name, of the longest of `bare` that it begins with; else the text as it was."""
    known = F.from_json(F.lit(json.dumps({n: c for n, c in NAMED.items() if n.endswith(";") or n in bare})), "map<string,string>")
    begins = lambda r: once(F.regexp_extract(r, f"^({'|'.join(bare)})", 1), lambda b: F.when(b == "", F.concat(F.lit("&"), r)).otherwise(F.concat(F.try_element_at(known, b), F.substr(r, F.length(b) + 1))))
    return F.coalesce(F.try_element_at(known, reference), begins(reference))


def unescaped(html: Column, bare: tuple[str, ...] = BARE) -> Column:
    """Numeric and named character references as characters, as Python's html.unescape has them: no reference goes past the next &.

    With fewer names in `bare`, only those are read without a semicolon, and no numbers are.
    """
    cut = lambda r: F.lit(bare != BARE) & ~r.endswith(";")
    read = lambda p: once(
        F.regexp_extract(p, REFERENCE, 1),
        lambda r: F.concat(F.when(r == "", "&").when(r.startswith("#"), F.when(cut(r), F.concat(F.lit("&"), r)).otherwise(numbered(r))).otherwise(named(r, bare)), F.substr(p, F.length(r) + 1)),
    )
    return F.array_join(F.transform(F.split(html, "&"), lambda p, i: F.when(i == 0, p).otherwise(read(p))), "")


def clean_html(html: Column, bare: tuple[str, ...] = BARE) -> Column:
    """Visible text of a page: scripts and the like removed, tags stripped, entities decoded (without a semicolon those of `bare`), white space squeezed."""
    for tag in DROPPED_TAGS:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    html = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    html = F.regexp_replace(html, r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(unescaped(html, bare), r"(?U)\s+", " "))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def sanitize_phrase(phrase: Column) -> Column:
    """Null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(phrase, r"(?U)[^\w &.-]", " ")), F.lit(""))


def excerpt(text: Column, mention: Column, before: int = 500, size: int = 1200) -> Column:
    """Up to `size` characters from `before` ahead of the first mention, in any case and with anything but letters and digits between its words; from the start without one."""
    words = F.transform(F.filter(F.split(mention, r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E")))
    pattern = F.concat(F.lit("(?iU)"), F.array_join(words, r"\W+"))
    return F.substr(text, F.greatest(F.regexp_instr(text, pattern) - before, F.lit(1)), F.lit(size))


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(h.substr(17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), F.concat(F.lit("5"), h.substr(14, 3)), F.concat(variant, h.substr(18, 3)), h.substr(21, 12))


def ticker_list(tickers: Column) -> Column:
    """Trimmed, upper-cased, distinct in order; null unless one to five valid ones."""
    clean = F.array_distinct(F.filter(F.transform(tickers, lambda t: F.upper(F.trim(t))), lambda t: t != ""))
    return F.when(F.size(clean).between(1, 5) & F.forall(clean, lambda t: t.rlike(r"^[A-Z0-9.\-]{1,10}$")), clean)


def archive_url(cik: Column, accession: Column, document: Column, base: str = "https://www.sec.gov/Archives/edgar/data") -> Column:
    return F.concat_ws("/", F.lit(base), cik.cast("long").cast("string"), F.replace(accession, F.lit("-"), F.lit("")), document)
