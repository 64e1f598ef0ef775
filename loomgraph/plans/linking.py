"""Linking the files of a state, and linking again only what a change touches.

A state keeps, beside facts and nodes, what each stage of linking has found, by the file (owner) whose facts
it comes from, and a table of the keys with which each file was resolved: names in other files, classes and
their members, models, handlers, URLs. A change goes through the stages once. Each stage works out anew the
rows of the owners that are touched so far, compares them with those of the state before, and hands on the
keys that mean something else now, or nothing, or something for the first time; the owners that were
resolved with one of them are touched as well. So an ambiguity that appears or goes takes away or brings
back edges in files that haven't changed, and files that nothing touches aren't looked at.

Names that are passed on may depend on each other in cycles, so of those, all that could rest on a changed
one is forgotten first and then derived again from what is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.columns import suffixes
from loomgraph.operators import resolve, traverse, urls
from loomgraph.plans import code_graph as G
from loomgraph.storage import cut

#: What a state keeps for linking.
TABLES = ("asked", "where", "offers", "meanings", "bases", "above", "links", "wanted", "targets", "stubs")
KEY = ["kind", "key"]


def _key(*parts):
    return F.concat_ws("\x00", *parts)


def _keys(rows: DataFrame, kind: str, key) -> DataFrame:
    return rows.select(F.lit(kind).alias("kind"), key.alias("key"))


def differing(before: DataFrame, after: DataFrame) -> DataFrame:
    """The rows that only one of two tables of the same columns has."""
    both = before.withColumn("__side", F.lit(1)).unionByName(after.withColumn("__side", F.lit(2)))
    return both.groupBy(*after.columns).agg(F.min("__side").alias("a"), F.max("__side").alias("b")).filter("a = b").drop("a", "b")


def module_keys(paths: DataFrame) -> DataFrame:
    """module: the modules that files (path) could be meant by, as far as their paths tell."""
    p = F.col("path")
    stem = F.regexp_replace(F.regexp_replace(p, r"\.py$", ""), r"(^|/)__init__$", "")
    python = paths.filter(F.endswith("path", F.lit(".py"))).select(F.explode(F.concat(suffixes(stem), F.array(F.concat(F.lit("./"), stem)))).alias("module"))
    bare = F.regexp_replace(p, r"\.(tsx?|jsx?)$", "")
    guesses = [p, bare, F.regexp_replace(bare, r"/index$", ""), F.concat(bare, F.lit(".js")), F.concat(bare, F.lit(".jsx"))]
    script = paths.select(F.explode(F.array(*[F.concat(F.lit("script:"), g) for g in guesses])).alias("module"))
    return python.union(script).distinct()


def wanted_of(found: DataFrame, nodes: DataFrame, where: DataFrame, calls: DataFrame, asking: DataFrame, open_: DataFrame) -> DataFrame:
    """owner, kind, key: what the links of files were resolved with."""
    refs = [found.select("path", F.explode(c).alias("x")).select("path", "x.module", "x.symbol") for c in ("references", "base_refs")]
    named = refs[0].union(refs[1]).join(where, "module", "left")
    file = F.when(F.col("module").isNull(), F.col("path")).otherwise(F.col("module_file"))
    row = lambda df, owner, kind, key: df.select(F.col(owner).alias("owner"), F.lit(kind).alias("kind"), key.alias("key"))
    out = row(named.withColumn("file", file).filter("file IS NOT NULL"), "path", "name", _key("file", "symbol"))
    members = calls.filter("kind IN ('member', 'super') AND ref_kind = 'Class'")
    out = out.union(row(members, "path", "line", F.col("ref"))).union(row(members, "path", "member", _key("ref", "member")))
    for kind, asked in (("model", G.relations_of(found)), ("handler", G.handlers_of(nodes))):
        out = out.union(row(G.variants_of(asked, found).select("path", F.explode("variants").alias("v")), "path", kind, F.col("v")))
    url = urls.asked_keys(asking.select("owner", "call", "folded").distinct())
    out = out.union(row(url, "owner", "url", _key("kind", "key"))).union(row(open_, "owner", "named", F.lit("")))
    return out.filter("key IS NOT NULL").distinct()


def stubs_of(found: DataFrame, where: DataFrame, there: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """owner, path: files that Python files import and that exist (there), but aren't in the workspace, such as those of left-out folders.

    A module is looked for from the workspace's root only, as a file and as a package.
    """
    python = found.filter(F.endswith("path", F.lit(".py"))).select(F.col("path").alias("owner"), F.explode("imports.module").alias("module"))
    open_ = python.filter("module <> ''").distinct().join(where, "module", "left_anti")
    base = F.regexp_replace(F.regexp_replace("module", r"^\./", ""), "/$", "")
    tried = open_.select("owner", F.explode(F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))).alias("path"))
    if there is None:
        return tried.limit(0)
    tried = cut(tried)
    return tried.join(there(tried.select("path").distinct()), "path").select("owner", "path").join(found.select("path"), "path", "left_anti").select("owner", "path")


class _Stages:
    """One pass through the stages; old(name) gives a table of the state before, keep(name, rows) writes one of this state."""

    def __init__(self, old: Callable[[str], DataFrame] | None, keep: Callable[[str, DataFrame], DataFrame], found: DataFrame, nodes: DataFrame):
        self.old, self.keep, self.found, self.nodes = old, keep, found, nodes

    def kept(self, name: str, touched: DataFrame | None, fresh: DataFrame) -> DataFrame:
        """A table by owner: that of the state before with the rows of touched owners in place of theirs."""
        if self.old is None or touched is None:
            return self.keep(name, fresh)
        return self.keep(name, self.old(name).join(touched, "owner", "left_anti").unionByName(fresh))

    def of(self, touched: DataFrame | None, rows: DataFrame, column: str = "path") -> DataFrame:
        return rows if touched is None else rows.join(touched.select(F.col("owner").alias(column)), column, "left_semi")

    def owners(self, *keys: DataFrame) -> DataFrame:
        """The owners that were resolved with one of the keys (kind, key) in the state before."""
        every = keys[0]
        for k in keys[1:]:
            every = every.union(k)
        return self.old("wanted").join(every.distinct(), KEY, "left_semi").select("owner")


def where_of(asked: DataFrame, found: DataFrame, old: Callable[[str], DataFrame] | None, moved: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """module, module_file; and the modules that mean another file than before. moved: paths that came or went."""
    if old is None:
        return G.modules(asked, found), None
    every = asked.select("module").distinct()
    new = every.join(old("asked").select("module").distinct(), "module", "left_anti")
    again = cut(new.union(module_keys(moved).join(every, "module", "left_semi")).distinct())
    if again.isEmpty():
        return old("where"), again
    fresh = cut(G.modules(again, found))
    kept = old("where").join(again, "module", "left_anti")
    return kept.unionByName(fresh), differing(old("where").join(again, "module", "left_semi"), fresh).select("module").distinct()


def _forgotten(offers: DataFrame, known: DataFrame, seeds: DataFrame) -> DataFrame:
    """file, name: all that could rest on seeds (file, name), through what is passed on; seeds included."""
    passed = offers.filter("how = 'pass'").select("owner", F.col("name").alias("as"), F.col("module_file").alias("file"), F.col("imported").alias("name"))
    stars = offers.filter("how = 'star'").select("owner", F.col("module_file").alias("file"))
    out, new = seeds, seeds
    while not new.isEmpty():
        above = passed.join(new, ["file", "name"]).select(F.col("owner").alias("file"), F.col("as").alias("name"))
        above = above.union(stars.join(new, "file").select(F.col("owner").alias("file"), "name"))
        new = cut(above.distinct().join(out, ["file", "name"], "left_anti"))
        out = out.unionByName(new)
    return out


def meanings_again(old: DataFrame, offers: DataFrame, offers_before: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What names mean now, from what they meant (old: file, name, node), and the keys whose one meaning changed.

    changed: the offers that only one of the two states has.
    """
    owners = cut(changed.select(F.col("owner").alias("file")).distinct())
    loose = changed.filter("how IN ('star', 'explicit')").select(F.col("owner").alias("file")).distinct()
    seeds = changed.filter("how IN ('own', 'pass')").select(F.col("owner").alias("file"), "name").union(old.join(loose, "file", "left_semi").select("file", "name"))
    gone = cut(_forgotten(offers_before, old, cut(seeds.distinct())))
    left = old.join(gone, ["file", "name"], "left_anti")
    again = cut(gone.select("file").union(owners).distinct().withColumnRenamed("file", "owner"))
    own = offers.join(again, "owner", "left_semi")
    start = cut(left.unionByName(G.own_of(own).join(left, ["file", "name", "node"], "left_anti")))
    new = cut(G.one_step(own, start).distinct().join(start, ["file", "name", "node"], "left_anti"))
    now = G.followed(offers, start, new)
    one = lambda rows: resolve.unique_target(rows, ["file", "name"], "node").select("file", "name", "node")
    return now, differing(one(old), one(now)).select("file", "name").distinct()


#: What other files can be resolved with of a node.
NODE = ["id", "kind", "name", "qualified", "file"]


def link(found: DataFrame, nodes: DataFrame, keep: Callable[[str, DataFrame], DataFrame], old: Callable[[str], DataFrame] | None = None, changed: DataFrame | None = None, moved: DataFrame | None = None, there: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, int | None]:
    """The edges of a state, and how many files were linked again (None: all).

    found, nodes: facts and nodes of the state; nodes don't know the prefixes of their routes yet.
    keep(name, rows) writes nodes, with them, and each of TABLES, and returns the table. With the state before: old(name), which has nodes too, changed, the
    files (owner) whose facts are others or gone, and moved, those (path) that came or went. there: which of some
    paths exist; of those that are imported and not in the workspace, stubs keep the owner and the path.
    """
    s = _Stages(old, keep, found, nodes)
    asked = s.kept("asked", changed, G.asked_of(s.of(changed, found)))
    where, other = where_of(asked, found, old, moved)
    where = keep("where", where)
    nodes = keep("nodes", G.mounted(nodes, G.prefixes(found, where)))
    if old is None:
        touched = None
    else:
        touched = cut(changed.union(asked.join(other, "module", "left_semi").select("owner")).distinct())

    # names that files offer
    offers = s.kept("offers", touched, G.offers_of(s.of(touched, found), where, nodes))
    if old is None:
        meanings, other_names = keep("meanings", G.meanings(offers)), None
    else:
        diff = cut(differing(s.of(touched, old("offers"), "owner"), s.of(touched, offers, "owner")))
        if diff.isEmpty():
            meanings, other_names = keep("meanings", old("meanings")), diff.select(F.col("owner").alias("file"), "name").limit(0)
        else:
            now, other_names = meanings_again(old("meanings"), offers, old("offers"), diff)
            meanings, other_names = keep("meanings", now), cut(other_names)
    out = resolve.unique_target(meanings, ["file", "name"], "node")
    out = cut(out)

    # nodes that aren't what they were
    if old is not None:
        of_changed = lambda rows: rows.select(*NODE).join(changed.select(F.col("owner").alias("file")), "file", "left_semi").select(*NODE)
        symbols = cut(differing(of_changed(old("nodes")), of_changed(nodes)).filter("kind NOT IN ('File', 'Folder')"))
        by_id = symbols.filter("kind IN ('Class', 'Function', 'Declaration')").select(_key("file", F.expr("substring(id, length(file) + 2)")).alias("key"))
        names = _keys(other_names, "name", _key("file", "name")).union(_keys(by_id, "name", F.col("key")))
        touched = cut(touched.union(s.owners(names)).distinct())

    # bases
    bases = s.kept("bases", touched, G.bases_of(s.of(touched, found), where, nodes, out))
    if old is None:
        above, others = keep("above", traverse.closure(bases.select("child", "parent"))), []
    else:
        if differing(s.of(touched, old("bases"), "owner"), s.of(touched, bases, "owner")).isEmpty():
            above = keep("above", old("above"))
            lines = above.select("node").limit(0)
        else:
            above = keep("above", traverse.closure(bases.select("child", "parent")))
            lines = cut(differing(old("above"), above).select("node").distinct())
        method = symbols.filter("kind = 'Function' AND contains(qualified, '.')").select(F.regexp_extract("id", r"^(.*)\.[^.]*$", 1).alias("ancestor"), F.regexp_extract("id", r"([^.]*)$", 1).alias("member"))
        at = above.union(old("above")).select("node", "ancestor").distinct()
        members = method.join(at, "ancestor").select(_key("node", "member").alias("key")).union(method.select(_key("ancestor", "member")))
        others = [_keys(lines, "line", F.col("node")), _keys(members, "member", F.col("key"))]
        others += [_keys(symbols.filter("kind = 'Class'"), "model", F.col("name")), _keys(symbols.filter("kind IN ('Class', 'Function')"), "handler", F.col("name"))]

    # URLs
    targets = keep("targets", G.url_targets(nodes))
    if old is not None:
        moved_urls = cut(differing(old("targets"), targets))
        others.append(_keys(moved_urls.select(F.explode(urls.held_keys(F.col("url"))).alias("k")), "url", _key("k.kind", "k.key")))
        # names of functions, and what is known of them, count for all calls that no URL fits
        named = symbols.filter("kind IN ('Class', 'Function')").select("id").union(moved_urls.filter("tier = 2").select("target"))
        others.append(_keys(named.limit(1), "named", F.lit("")))
        touched = cut(touched.union(s.owners(*others)).distinct())

    again = s.of(touched, found)
    again = cut(again) if touched is not None else again
    calls = cut(G.calls_of(again, where, nodes, out))
    own_nodes = s.of(touched, nodes, "file")
    links = G.links_of(again, nodes, where, calls, above).unionByName(G.as_links(G.containment(own_nodes.filter("kind <> 'Folder'")), "within", "structural"))
    asking = cut(G.http_calls(again, own_nodes))
    open_ = asking.select("owner").limit(0)
    if not asking.isEmpty():
        answered, open_ = G.requests(asking, nodes, targets)
        links = links.unionByName(G.as_links(answered, "request", "generated"))
    stubs = s.kept("stubs", touched, stubs_of(again, where, there))
    imported = s.of(touched, stubs, "owner").select("owner", F.col("path").alias("src"), F.col("owner").alias("dst"))
    links = links.unionByName(G.as_links(imported, "stub", "structural"))
    folders = G.as_links(G.containment(nodes.filter("kind = 'Folder'")), "within", "structural")
    of_folders = found.sparkSession.range(1).select(F.lit("").alias("owner"))
    links = s.kept("links", None if touched is None else touched.union(of_folders), links.unionByName(folders))
    s.kept("wanted", touched, wanted_of(again, own_nodes, where, calls, asking, open_))
    return G.edges_from(links), None if touched is None else touched.count()
