"""URL functions as columns."""

from __future__ import annotations

import posixpath
from urllib.parse import urlsplit, urlunsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Schemes whose URLs have a host here.
SCHEMES = ("http", "https", "ftp", "file", "jar")
#: The target of an anchor, on one line.
ANCHOR = r'(<a.*?href=")(.*?)(")'


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def url_host(url: str | Column) -> Column:
    """The host as written, without port and user; null for URLs without a known scheme."""
    known = "|".join(SCHEMES)
    host = F.regexp_extract(_col(url), rf"^\s*(?i:{known})://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.when(_col(url).rlike(rf"^\s*(?i:{known})://"), host)


def split_host_path(url: str | Column) -> tuple[Column, Column]:
    """What follows the first :// up to the first slash (port included), and from there on (query included; may be empty)."""
    rest = F.when(_col(url).contains("://"), F.regexp_extract(_col(url), r"(?s)^.*?://(.*)$", 1)).otherwise(_col(url))
    host = F.regexp_extract(rest, r"(?s)^([^/]*)", 1)
    return host, F.substr(rest, F.length(host) + 1)


def row_key(text: str | Column) -> Column:
    """Lower-case hex MD5."""
    return F.md5(_col(text))


def normalize_url(base: str | Column, link: str | Column) -> Column:
    """link resolved against base: https as http, no www. and spaces, no final slash, lower case."""

    def tidy(u: Column) -> Column:
        return F.replace(F.replace(F.replace(u, F.lit("https:"), F.lit("http:")), F.lit("www."), F.lit("")), F.lit(" "), F.lit(""))

    b, u = tidy(_col(base)), tidy(_col(link))
    root = F.regexp_extract(b, r"^([^/]*//[^/]*)", 1)
    full = (
        F.when(u.startswith("//"), F.concat(F.lit("http:"), u))
        .when(u.startswith("/"), F.concat(root, u))
        .when(u.contains("://"), u)
        .otherwise(F.concat(F.regexp_replace(b, "/$", ""), F.lit("/"), u))
    )
    return F.lower(F.regexp_replace(full, "/$", ""))


def remove_dot_segments(url: str | Column) -> Column:
    """. and .. segments worked out, by an Arrow function."""
    import pyarrow as pa

    def one(u: str | None) -> str | None:
        if not u or "/." not in u:
            return u
        s = urlsplit(u)
        path = posixpath.normpath(s.path).lstrip("/") if s.path else ""
        return urlunsplit((s.scheme, s.netloc, f"/{path}" if path not in ("", ".") else "", s.query, s.fragment))

    return F.arrow_udf(lambda a: pa.array([one(u) for u in a.to_pylist()], pa.string()), "string")(_col(url))


def anchors(html: str | Column) -> Column:
    """href of each anchor of the page in order, without mail links."""
    whole = F.regexp_extract_all(_col(html), F.lit(ANCHOR), F.lit(0))
    link = F.regexp_extract_all(_col(html), F.lit(ANCHOR), F.lit(2))
    pairs = F.filter(F.arrays_zip(whole.alias("whole"), link.alias("link")), lambda x: ~x["whole"].contains("mailto:"))
    return F.transform(pairs, lambda x: x["link"])


def in_site(host: str | Column, site: str, *others: str) -> Column:
    """host holds site, but not as a subdomain (.site), and none of others."""
    h = _col(host)
    out = h.contains(site) & ~h.contains("." + site)
    for x in others:
        out = out & ~h.contains(x)
    return out
