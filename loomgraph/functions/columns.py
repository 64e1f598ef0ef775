"""Column functions over ids, paths, names and calls; all stay within generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CALLBACK = r"^callback_L\d+_C\d+$"


def normalize_path(path: Column, workspace: str | None = None) -> Column:
    """A path relative to the workspace: forward slashes, no leading ./ and no slash at the end; '' is '.'."""
    p = F.translate(F.trim(path), "\\", "/")
    if workspace:
        root = workspace.replace("\\", "/").rstrip("/")
        p = F.when(p == root, F.lit(".")).when(F.startswith(p, F.lit(root + "/")), F.substring(p, len(root) + 2, 1 << 30)).otherwise(p)
    p = F.regexp_replace(F.regexp_replace(p, r"^(\./)+", ""), r"/+$", "")
    return F.when(p == "", F.lit(".")).otherwise(p)


def is_under(path: Column, prefix: Column | str) -> Column:
    """Whether path is prefix or lies below it, by whole components; all is under '.'."""
    pre = F.lit(prefix) if isinstance(prefix, str) else prefix
    return (pre == ".") | (path == pre) | F.startswith(path, F.concat(pre, F.lit("/")))


def ancestors(path: Column) -> Column:
    """The folders above a path, the outermost first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def suffixes(path: Column) -> Column:
    """All component suffixes of a path, the whole of it first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, 1 << 20), "/"))


def qualified_name(node_id: Column, file_path: Column) -> Column:
    """What follows the file and a colon in an id; the id itself where it doesn't start so."""
    return F.when(F.startswith(node_id, F.concat(file_path, F.lit(":"))), F.substr(node_id, F.length(file_path) + 2)).otherwise(node_id)


def display_name(qualified: Column) -> Column:
    """A qualified name without the segments of inline callbacks."""
    kept = F.filter(F.split(qualified, r"\."), lambda s: ~s.rlike(CALLBACK))
    return F.when(F.size(kept) > 0, F.array_join(kept, ".")).otherwise(qualified)


def is_callback(name: Column) -> Column:
    return name.rlike(CALLBACK)


def last_segment(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def lines_span(start: Column, end: Column) -> Column:
    """'3-9', or '3' where it starts and ends in one line or no end is known; null without a start."""
    return F.when(start.isNull(), F.lit(None).cast("string")).when(end.isNull() | (end == start), start.cast("string")).otherwise(F.concat_ws("-", start.cast("string"), end.cast("string")))


def truncated(text: Column, limit: int) -> Column:
    """At most limit characters; a cut text ends in three dots."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def compact_entry(name: Column, kind: Column, start: Column, end: Column, depth: Column | None = None) -> Column:
    """'name [Kind] L3-9 depth=2', without the parts that are null."""
    span = lines_span(start, end)
    parts = [name, F.concat(F.lit("["), kind, F.lit("]")), F.concat(F.lit("L"), span)]
    if depth is not None:
        parts.append(F.concat(F.lit("depth="), depth.cast("string")))
    return F.concat_ws(" ", *parts)


def bounded(items: Column, limit: int) -> tuple[Column, Column]:
    """The first items of an array, and how many are left out."""
    return F.slice(items, 1, limit), F.greatest(F.size(items) - limit, F.lit(0))


def normalize_url(url: Column, fold_numbers: bool = False) -> Column:
    """A URL path in the form that routes and calls are compared in.

    Without white space around and slashes at the end, with one in front, without one leading /api;
    <x>, :x and {x} become {id}, and, if asked for, segments of digits as well.
    """
    u = F.regexp_replace(F.trim(url), r"/+$", "")
    u = F.when(F.startswith(u, F.lit("/")), u).otherwise(F.concat(F.lit("/"), u))
    u = F.regexp_replace(u, r"^/api(?=/|$)", "")
    u = F.regexp_replace(F.regexp_replace(F.regexp_replace(u, r"<[^>]+>", "{id}"), r":[A-Za-z_]\w*", "{id}"), r"\{[^}]*\}", "{id}")
    u = F.regexp_replace(u, r"/\d+(?=/|$)", "/{id}") if fold_numbers else u
    return F.when(u == "", F.lit("/")).otherwise(u)


def joined_url(prefix: Column, url: Column) -> Column:
    """url behind prefix; segments that the prefix ends with and the url begins with count once."""
    clean = lambda c: F.filter(F.split(c, "/"), lambda x: x != "")
    a, b = clean(prefix), clean(url)
    shared = F.filter(F.sequence(F.lit(0), F.least(F.size(a), F.size(b))), lambda n: (n == 0) | (F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n) == F.slice(b, 1, n)))
    rest = F.slice(b, F.array_max(shared) + 1, 1 << 20)
    return F.concat(F.lit("/"), F.array_join(F.concat(a, rest), "/"), F.when(F.endswith(url, F.lit("/")), "/").otherwise(""))


def href_values(html: Column) -> Column:
    """The values of all href attributes of an HTML text, in order."""
    value = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?i)^href\s*=\s*", ""), "^[\"']|[\"']$", "")
    return F.transform(F.regexp_extract_all(html, F.lit(r"""(?i)\bhref\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""), 0), value)


def module_url(url: Column, file: Column) -> Column:
    """The URL of an endpoint in a file below src/modules/<name>/: behind that name, core being auth."""
    module = F.regexp_extract(file, r"(?:^|/)src/modules/([^/]+)/", 1)
    module = F.when(module == "core", "auth").otherwise(module)
    head = F.concat(F.lit("/"), module)
    inside = (url == head) | F.startswith(url, F.concat(head, F.lit("/")))
    return F.when((module == "") | inside, url).otherwise(F.concat(head, F.when(url == "/", "").otherwise(url)))


def url_score(call: Column, folded: Column, route: Column) -> Column:
    """How well a call's URL fits a route's: 100 equal, 95 equal with numbers folded, 50 and 40 a leading
    part, 35 and 30 a trailing part of the other, by whole segments; null if not at all. '/' only equals."""
    a, b = F.concat(call, F.lit("/")), F.concat(route, F.lit("/"))
    root = (call == "/") | (route == "/")
    return (
        F.when(call == route, 100)
        .when(F.contains(route, F.lit("{id}")) & (folded == route), 95)
        .when(root, F.lit(None).cast("int"))
        .when(F.startswith(a, b), 50)
        .when(F.startswith(b, a), 40)
        .when(F.endswith(call, route), 35)
        .when(F.endswith(route, call), 30)
    )
