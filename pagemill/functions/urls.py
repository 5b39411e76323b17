"""URL expressions after RFC 3986.  ``parse_url`` is too strict for links found in the wild."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip_ws

SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"

MARK = "\x01"

# Schemes whose references may be relative.
RELATIVE_SCHEMES = [
    "", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms",
    "prospero", "rtsp", "rtsps", "sftp", "svn", "svn+ssh", "ws", "wss",
]
PARAM_SCHEMES = [
    "", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps", "sip", "sips",
    "mms", "sftp", "tel",
]


def _tidy(u: Column) -> Column:
    return F.regexp_replace(u, r"^[\x00-\x20]+|[\t\r\n]", "")


def _part(u: Column, group: int) -> Column:
    return F.regexp_extract(u, SPLIT, group)


def url_scheme(u: Column) -> Column:
    return F.lower(_part(_tidy(u), 1))


def url_netloc(u: Column) -> Column:
    """Host with port and user info, case kept."""
    return F.substring(_part(_tidy(u), 2), 3, 1 << 30)


def url_path(u: Column) -> Column:
    """Path without the ``;params`` of its last segment."""
    path = _part(_tidy(u), 3)
    return F.when(
        url_scheme(u).isin(PARAM_SCHEMES), F.regexp_replace(path, r";[^/]*$", "")
    ).otherwise(path)


def url_defrag(u: Column) -> Column:
    return F.regexp_replace(u, r"(?s)\??#.*$", "")


def url_norm(u: Column) -> Column:
    """Fragment and trailing slashes dropped, query kept."""
    return F.regexp_replace(url_defrag(u), r"/+$", "")


def is_http(u: Column) -> Column:
    return u.startswith("http://") | u.startswith("https://")


def is_single_document(u: Column) -> Column:
    """Local files and anything ending .html/.htm are read as one document."""
    return u.rlike(r"\.html?$") | ~u.contains("://")


def host_label(u: Column) -> Column:
    host = F.regexp_replace(url_netloc(u), r"[^A-Za-z0-9.\-]", "_")
    return F.when(host == "", "local").otherwise(host)


def host_or_local(u: Column) -> Column:
    return F.when(url_netloc(u) == "", "local").otherwise(url_netloc(u))


def _remove_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments; the split keeps the leading empty segment."""

    def step(acc: Column, seg: Column) -> Column:
        up = F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
        return (
            F.when(seg == "..", up)
            .when(seg == ".", acc)
            .otherwise(F.concat(acc, F.array(seg)))
        )

    segments = F.split(path, "/")
    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    kept = F.when(
        F.element_at(segments, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))
    ).otherwise(kept)
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(kept, "/")).otherwise(path)


def url_parts(u: Column) -> Column:
    """``array[scheme, //netloc, path, ?query, #fragment]`` by a single regular expression."""
    u = F.replace(_tidy(u), F.lit(MARK), F.lit("%01"))
    parts = F.split(F.regexp_replace(u, SPLIT, MARK.join(f"${n}" for n in range(1, 6))), MARK)
    return F.transform(parts, lambda p, i: F.when(i == 0, F.lower(p)).otherwise(p))


def url_resolve(base: Column, ref: Column) -> Column:
    """Resolve ``ref`` against ``url_parts`` of the base."""
    b_scheme, b_net, b_path, b_query = (F.get(base, F.lit(n)) for n in range(4))

    def resolve(p: Column) -> Column:
        scheme, net, path, query, frag = (F.get(p, F.lit(n)) for n in range(5))
        merged = F.when(path.startswith("/"), path).otherwise(
            F.regexp_replace(
                F.concat(F.regexp_replace(b_path, "[^/]*$", ""), path), "(?<!^)//+", "/"
            )
        )

        def rooted(path: Column) -> Column:
            bare = (path == "") | ((b_net != "") & ~path.startswith("/"))
            return F.when(bare, F.concat(F.lit("/"), path)).otherwise(path)

        query = F.when(F.length(query) > 1, query).otherwise("")
        frag = F.when(F.length(frag) > 1, frag).otherwise("")
        head = F.when(b_scheme == "", "").otherwise(F.concat(b_scheme, F.lit(":")))
        foreign = (scheme != "") & (scheme != b_scheme)
        return (
            F.when(foreign | ~b_scheme.isin(RELATIVE_SCHEMES), ref)
            .when(net != "", F.concat(head, net, path, query, frag))
            .when(
                path == "",
                F.concat(
                    head, b_net, b_path, F.when(query == "", b_query).otherwise(query), frag
                ),
            )
            .otherwise(F.concat(head, b_net, let(let(merged, _remove_dots), rooted), query, frag))
        )

    bare_base = F.array_join(base, "") == ""
    base_url = F.concat(b_scheme, F.when(b_scheme == "", "").otherwise(":"), b_net, b_path, b_query)
    return (
        F.when(bare_base, ref).when(ref == "", base_url).otherwise(let(url_parts(ref), resolve))
    )


def url_join(base: Column, ref: Column) -> Column:
    """Resolve ``ref`` against ``base``."""
    joined = let(url_parts(base), lambda b: url_resolve(b, ref))
    return F.when(ref == "", base).otherwise(joined)


def link_type(href: Column, page_url: Column) -> Column:
    """anchor, javascript, mailto, tel, internal or external."""
    raw = strip_ws(href)
    low = F.lower(raw)
    return (
        F.when(raw.startswith("#"), "anchor")
        .when(low.startswith("javascript:"), "javascript")
        .when(low.startswith("mailto:"), "mailto")
        .when(low.startswith("tel:"), "tel")
        .when(url_netloc(url_join(page_url, raw)) == url_netloc(page_url), "internal")
        .otherwise("external")
    )
