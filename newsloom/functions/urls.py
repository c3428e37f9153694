"""URL normalisation and content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import strip

# Query parameters that only track.
TRACKING = ["fbclid", "gclid", "ref", "redirect", "source", "rss", "from", "zarsrc", "catename"]


def normalize_url(url: Column) -> Column:
    """Without fragment, tracking parameters and trailing slashes (but a root's), the scheme in lower case.

    Parameters are decoded and encoded again, and one without a value gets an empty one. A percent sign that begins no escape stands
    for itself, and bytes that are no UTF-8 become U+FFFD.
    """
    u = F.regexp_replace(F.regexp_replace(F.translate(strip(url), "\t\r\n", ""), r"^[\x00-\x20]+", ""), r"(?s)#.*$", "")
    scheme = F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    u = F.concat(F.lower(scheme), F.substr(u, F.length(scheme) + 1))
    base, query = F.regexp_extract(u, r"(?s)^([^?]*)", 1), F.regexp_extract(u, r"(?s)\?(.*)$", 1)
    name = lambda p: F.regexp_extract(p, r"(?s)^([^=]*)", 1)
    value = lambda p: F.regexp_extract(p, r"(?s)=(.*)$", 1)
    decoded = lambda x: F.url_decode(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25"))
    again = lambda x: F.replace(F.replace(F.url_encode(decoded(x)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    plain = lambda p: F.lower(decoded(name(p)))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~plain(p).startswith("utm_") & ~plain(p).isin(*TRACKING))
    params = F.array_join(F.transform(kept, lambda p: F.concat(again(name(p)), F.lit("="), again(value(p)))), "&")
    whole = F.concat(base, F.when(params != "", F.concat(F.lit("?"), params)).otherwise(F.lit("")))
    root = F.length(F.regexp_extract(base, r"^([a-z][a-z0-9+.-]*://[^/?]*/?)", 1))
    return F.when(strip(url) == "", F.lit("")).otherwise(F.when(whole.endswith("/") & (F.length(whole) > root), F.regexp_replace(whole, "/+$", "")).otherwise(whole))


def content_hash(title: Column, content: Column) -> Column:
    """SHA-256 of title and content, each without white space at its ends, null as empty."""
    part = lambda c: strip(F.coalesce(c, F.lit("")))
    return F.sha2(F.concat(part(title), F.lit("\n"), part(content)), 256)
