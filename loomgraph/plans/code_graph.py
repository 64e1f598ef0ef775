"""From files to a graph: one pass extracts the facts of each file, joins turn them into nodes and edges.

nodes: id, kind, name, qualified, file, parent, start, end and what a record shows. edges: src, dst,
edge_class and seq. A child points to what holds it, an imported file to the file that imports it, a
related model to the class that declares the relation, a caller to what it calls, a route to its handler.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.columns import ancestors, joined_url, last_segment, module_url, normalize_url
from loomgraph.operators import resolve, rollup, traverse, urls
from loomgraph.operators.adjacency import Steps
from loomgraph.sources.languages import Languages
from loomgraph.sources.python_facts import facts_of
from loomgraph.storage import cut, reachable

SCRIPTS = (".ts", ".tsx", ".js", ".jsx")
DEFINITION = "struct<qualified:string,name:string,kind:string,parent:string,start:int,end:int,signature:string,docstring:string,decorators:array<string>,base_classes:array<string>,calls:array<string>,returns:array<string>,preview:string,is_async:boolean,is_generator:boolean,is_exported:boolean,param_count:int>"
FACTS = (
    "path string, lines int, error string, "
    f"definitions array<{DEFINITION}>, "
    "imports array<struct<module:string,symbol:string,text:string,line:int,alias:string>>, "
    "references array<struct<caller:string,call:string,seq:int,kind:string,module:string,symbol:string,member:string>>, "
    "base_refs array<struct<child:string,ord:int,module:string,symbol:string>>, "
    "routes array<struct<url:string,methods:array<string>,handler:string,line:int,kind:string,var:string,framework:string>>, "
    "relations array<struct<owner:string,type:string,model:string>>, "
    "exports array<struct<exported:string,kind:string,local:string,module:string,imported:string,source:string>>, "
    "http array<struct<url:string,method:string,lib:string,line:int>>, "
    "mounts array<struct<prefix:string,module:string,symbol:string,parent:string>>, "
    "middleware array<struct<name:string,var:string,kind:string,line:int>>, "
    "frameworks array<string>"
)


def facts(files: DataFrame, languages: Sequence[dict] = ()) -> DataFrame:
    """A row of FACTS for each file (columns path and content); the only pass over the sources.

    languages: settings of further ones, see sources.languages.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(T.StructType.fromDDL(FACTS))

    def run(batches):
        known = Languages(languages)
        for batch in batches:
            rows = [facts_of(p.as_py(), c.as_py() or b"", known) for p, c in zip(batch.column(0), batch.column(1))]
            yield pa.RecordBatch.from_pylist(rows, schema=shape)

    reachable(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, FACTS)


def modules(requested: DataFrame, files: DataFrame) -> DataFrame:
    """module, module_file: the file of each requested module; a whole path first, else the one path that ends so.

    A module that starts with ./ is taken from the workspace's root only, and so are those of scripts, marked
    script:, which stand for a file, for one with an extension, or for a folder's index file. What several
    files could be is left out.
    """
    every = requested.filter("module IS NOT NULL AND module <> ''").select("module").distinct()
    script = every.filter(F.startswith("module", F.lit("script:"))).withColumn("base", F.expr("substring(module, 8)"))
    bare = F.regexp_replace("base", r"\.jsx?$", "")
    guesses = [F.concat(c, F.lit(e)) for c in (F.col("base"), F.concat("base", F.lit("/index"))) for e in SCRIPTS]
    swapped = [F.when(F.col("base").rlike(r"\.jsx?$"), F.concat(bare, F.lit(e))) for e in (".ts", ".tsx")]
    tried = script.select("module", F.posexplode(F.array_distinct(F.array_compact(F.array(F.col("base"), *guesses, *swapped)))).alias("nth", "as"))
    there = tried.join(files.select(F.col("path").alias("as")), "as").withColumn("tier", F.least("nth", F.lit(1)))
    scripts = resolve.unique_target(resolve.lowest_tier(there, ["module"], "tier").select("module", F.col("as").alias("module_file")), ["module"], "module_file")
    own = files.filter(F.endswith("path", F.lit(".py"))).select(F.col("path").alias("module_file"), F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), r"(^|/)__init__$", "").alias("as"))
    wanted = every.filter(~F.startswith("module", F.lit("script:")))
    fixed = wanted.filter(F.startswith("module", F.lit("./"))).join(own, F.expr("substring(module, 3)") == F.col("as"))
    open_ = resolve.suffix_match(wanted.filter(~F.startswith("module", F.lit("./"))), "module", own.filter("as <> ''"), "as")
    named = open_.withColumnRenamed("file", "as").join(own, "as").withColumn("tier", resolve.unless(F.col("exact")))
    best = resolve.lowest_tier(named.select("module", "module_file", "tier"), ["module"], "tier").select("module", "module_file")
    return resolve.unique_target(best.union(fixed.select("module", "module_file")), ["module"], "module_file").union(scripts)


def nodes_of(found: DataFrame) -> DataFrame:
    """The nodes of files but their folders; each file has its own, from its facts alone."""
    text = lambda c: F.lit(None).cast(c)
    shown = ["signature", "docstring", "decorators", "base_classes", "calls", "returns", "preview", "is_async", "is_generator", "is_exported", "param_count"]
    kinds = {"signature": "string", "docstring": "string", "decorators": "array<string>", "base_classes": "array<string>", "calls": "array<string>", "returns": "array<string>", "preview": "string", "is_async": "boolean", "is_generator": "boolean", "is_exported": "boolean", "param_count": "int"}
    empty = [text(kinds[c]).alias(c) for c in shown]
    route_columns = [text("string").alias("url"), text("array<string>").alias("methods"), text("array<string>").alias("handlers"), text("string").alias("var")]
    folder_of = lambda c: F.when(F.contains(c, F.lit("/")), F.regexp_replace(c, "/[^/]*$", ""))
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    p = F.col("path")
    lists = [text("array<string>").alias("imports"), text("array<string>").alias("exports"), text("array<string>").alias("frameworks")]
    brought = F.array_distinct(F.transform(F.array_sort(F.transform("imports", lambda i: F.struct(i["line"].alias("line"), i["text"].alias("text")))), lambda i: F.trim(F.regexp_replace(i["text"], r"\s+", " "))))

    def offer(e):
        local = F.when(e["local"].rlike("^anonymous_L") | (e["local"] == e["exported"]), e["exported"]).otherwise(F.concat_ws(" as ", e["local"], e["exported"]))
        again = F.when(e["imported"] == e["exported"], e["exported"]).otherwise(F.concat_ws(" as ", e["imported"], e["exported"]))
        return F.when(e["kind"] == "star", F.concat(F.lit("* from "), e["source"])).when(e["kind"] == "reexport", F.concat(again, F.lit(" from "), e["source"])).otherwise(local)

    own_lists = [brought.alias("imports"), F.array_distinct(F.transform("exports", offer)).alias("exports"), F.col("frameworks")]
    files = found.select(p.alias("id"), F.lit("File").alias("kind"), last(p).alias("name"), p.alias("qualified"), p.alias("file"), folder_of(p).alias("parent"), F.lit(1).alias("start"), F.col("lines").alias("end"), *empty, *route_columns, *own_lists)
    d = found.select("path", F.posexplode("definitions").alias("nth", "d")).select("path", "nth", "d.*")
    d = resolve.latest(d.withColumn("id", F.concat("path", F.lit(":"), "qualified")), ["id"], ["nth"])
    parent = F.when(F.col("parent").isNull(), p).otherwise(F.concat(p, F.lit(":"), "parent"))
    definitions = d.select("id", "kind", "name", "qualified", p.alias("file"), parent.alias("parent"), "start", "end", *shown, *route_columns, *lists)
    r = found.select("path", F.posexplode("routes").alias("nth", "r")).select("path", "nth", "r.*").filter(~F.startswith(F.coalesce("handler", F.lit("")), F.lit("include:")) & F.col("url").isNotNull())
    grouped = rollup.merged(r.withColumn("handlers", F.array("handler")), ["path", "url"], "nth", ["methods", "handlers"], [F.min("line").alias("start"), F.min("var").alias("var"), F.collect_set("framework").alias("frameworks")])
    routes = grouped.select(F.concat("path", F.lit(":"), "url").alias("id"), F.lit("Route").alias("kind"), F.col("url").alias("name"), F.col("url").alias("qualified"), p.alias("file"), p.alias("parent"), "start", F.col("start").alias("end"), *empty, "url", "methods", F.array_compact("handlers").alias("handlers"), "var", *lists[:2], F.array_sort("frameworks").alias("frameworks"))
    m = found.select("path", F.explode("middleware").alias("m")).select("path", "m.*")
    m = m.groupBy("path", "name").agg(F.max(F.struct("line", "var", "kind")).alias("last"))  # of one name the last counts
    blank = [text("string").alias("url"), F.array(F.col("last.kind")).alias("methods"), text("array<string>").alias("handlers"), F.col("last.var").alias("var")]
    around = m.select(F.concat("path", F.lit(":mw:"), "name").alias("id"), F.lit("Middleware").alias("kind"), "name", F.col("name").alias("qualified"), p.alias("file"), p.alias("parent"), F.col("last.line").alias("start"), F.col("last.line").alias("end"), *empty, *blank, *lists)
    return files.unionByName(definitions).unionByName(routes).unionByName(around)


def folders_of(found: DataFrame) -> DataFrame:
    """id, kind, name, qualified, file, parent of the folders that files (path) lie in."""
    last = F.element_at(F.split("f", "/"), -1)
    folder = found.select(F.explode(ancestors(F.col("path"))).alias("f")).distinct()
    parent = F.when(F.contains("f", F.lit("/")), F.regexp_replace("f", "/[^/]*$", ""))
    return folder.select(F.col("f").alias("id"), F.lit("Folder").alias("kind"), last.alias("name"), F.col("f").alias("qualified"), F.col("f").alias("file"), parent.alias("parent"))


def with_folders(nodes: DataFrame, found: DataFrame) -> DataFrame:
    return nodes.unionByName(folders_of(found), allowMissingColumns=True)


def offers_of(found: DataFrame, where: DataFrame, nodes: DataFrame) -> DataFrame:
    """owner, how, name, module_file, imported, node: what files offer to others, and how.

    own: a name with its node, which scripts export and Python files define at their top level; pass: a name
    that stands for another one of another file, which scripts export again and Python files import; star: all
    names of another file but its default; explicit: a name that goes before those of stars.
    """
    none = lambda c: F.lit(None).cast("string").alias(c)
    row = lambda df, how, name, file=None, imported=None, node=None: df.select(F.col("path").alias("owner"), F.lit(how).alias("how"), name.alias("name"), file if file is not None else none("module_file"), imported if imported is not None else none("imported"), node if node is not None else none("node"))
    e = found.select("path", F.explode("exports").alias("e")).select("path", "e.*")
    local = e.filter("kind = 'local'").withColumn("node", F.concat("path", F.lit(":"), "local"))
    own = row(local.join(nodes.select(F.col("id").alias("node")), "node"), "own", F.col("exported"), node=F.col("node"))
    python = nodes.filter(F.endswith("file", F.lit(".py")) & F.col("kind").isin("Class", "Function") & ~F.contains("qualified", F.lit("."))).withColumn("path", F.col("file"))
    python = python.join(found.select("path"), "path", "left_semi")
    own = own.union(row(python, "own", F.col("qualified"), node=F.col("id")))
    again = e.filter("kind IN ('reexport', 'star')").join(where, "module")
    file = F.col("module_file")
    passed = row(again.filter("kind = 'reexport'"), "pass", F.col("exported"), file, F.col("imported"))
    stars = row(again.filter("kind = 'star'"), "star", F.lit(""), file)
    brought = found.select("path", F.explode("imports").alias("i")).select("path", "i.*").filter("alias IS NOT NULL").join(where, "module")
    taken = python.select("path", F.col("qualified").alias("alias"))
    brought = row(brought.join(taken, ["path", "alias"], "left_anti"), "pass", F.col("alias"), file, F.col("symbol").alias("imported"))
    explicit = row(e.filter("kind <> 'star'"), "explicit", F.col("exported"))
    return own.union(passed).union(brought).union(stars).union(explicit).distinct()


def one_step(offers: DataFrame, known: DataFrame) -> DataFrame:
    """file, name, node of what offers pass on of known (file, name, node)."""
    passed = offers.filter("how = 'pass'").select("owner", F.col("name").alias("as"), F.col("module_file").alias("file"), F.col("imported").alias("name"))
    one = passed.join(known, ["file", "name"]).select(F.col("owner").alias("file"), F.col("as").alias("name"), "node")
    stars = offers.filter("how = 'star'").select("owner", F.col("module_file").alias("file")).distinct()
    explicit = offers.filter("how = 'explicit'").select(F.col("owner").alias("file"), "name")
    every = stars.join(known, "file").filter("name <> 'default'").select(F.col("owner").alias("file"), "name", "node")
    return one.union(every.join(explicit, ["file", "name"], "left_anti"))


def followed(offers: DataFrame, known: DataFrame, new: DataFrame) -> DataFrame:
    """known and all that follows from new, which isn't in it: file, name, node. Ends on cycles, as it only adds."""
    rounds = 0
    while not new.isEmpty():
        known, rounds = known.unionByName(new), rounds + 1
        known = cut(known) if rounds % 20 == 0 else known
        new = cut(one_step(offers, new).distinct().join(known, ["file", "name", "node"], "left_anti"))
    return known


def own_of(offers: DataFrame) -> DataFrame:
    return offers.filter("how = 'own'").select(F.col("owner").alias("file"), "name", "node").distinct()


def exported(found: DataFrame, where: DataFrame, nodes: DataFrame) -> DataFrame:
    """file, name, node: what the names that files offer to others mean, through re-exports and stars.

    A round follows each re-export by one file, until a round finds nothing new. A name that several stars
    give different meanings has none; a name of the file's own goes before stars, and stars don't pass on
    the default.
    """
    offers = cut(offers_of(found, where, nodes))
    return resolve.unique_target(meanings(offers), ["file", "name"], "node")


def meanings(offers: DataFrame) -> DataFrame:
    """file, name, node: every meaning that a name has."""
    own = own_of(offers)
    return own if offers.filter("how IN ('pass', 'star')").isEmpty() else followed(offers, own.limit(0), cut(own))


def _refs(rows: DataFrame, where: DataFrame, nodes: DataFrame, out: DataFrame) -> DataFrame:
    """rows (path, module, symbol) with ref, the node that they name; those that name none are left out."""
    script = F.coalesce(F.startswith("module", F.lit("script:")), F.lit(False))
    named = rows.join(where, "module", "left").join(out.select(F.col("file").alias("module_file"), F.col("name").alias("symbol"), F.col("node").alias("meant")), ["module_file", "symbol"], "left")
    file = F.when(F.col("module").isNull(), F.col("path")).otherwise(F.col("module_file"))
    named = named.withColumn("ref", F.coalesce("meant", F.when(~script, F.concat(file, F.lit(":"), "symbol")))).drop("module_file", "meant")
    return named.join(nodes.filter(F.col("kind").isin("Class", "Function", "Declaration")).select(F.col("id").alias("ref"), F.col("kind").alias("ref_kind")), "ref")


def prefixes(found: DataFrame, where: DataFrame) -> DataFrame:
    """file, var, full: the prefix that a router is mounted at, if that is one.

    A router can be mounted on one that is mounted itself, in any number of steps and with prefixes of any
    length. Each router has no prefix yet, one, or several, and each round passes that on by one step; as
    it can only ever go up in this order, the rounds end, on cycles too. Routers with several prefixes have
    none, nor have those behind them; a cycle whose turns make a prefix longer gives several, and routers
    that only mount each other have none from the start. Segments that a prefix ends with and what follows
    begins with count once. A script's name for a router is that in the file that exports it.
    """
    m = found.select("path", F.explode("mounts").alias("m")).select("path", "m.*").join(where, "module", "left")
    local = found.select("path", F.explode("exports").alias("e")).filter("e.kind = 'local'").select(F.col("path").alias("module_file"), F.col("e.exported").alias("symbol"), F.col("e.local").alias("local"))
    m = m.join(local.distinct(), ["module_file", "symbol"], "left")
    at = F.when(F.col("module").isNull(), F.col("path")).otherwise(F.col("module_file"))
    of = m.select(at.alias("file"), F.coalesce("local", "symbol").alias("var"), "prefix", F.col("path").alias("up_file"), F.col("parent").alias("up_var")).filter("file IS NOT NULL")
    of = cut(of.filter("NOT (file = up_file AND var = up_var)").distinct())
    if of.isEmpty():
        return of.select("file", "var", F.col("prefix").alias("full"))
    inner = of.select(F.col("file").alias("up_file"), F.col("var").alias("up_var")).distinct()
    one, several = F.min("full"), F.max("several") | (F.min("full") != F.max("full"))
    first = of.join(inner, ["up_file", "up_var"], "left_anti").select("file", "var", F.col("prefix").alias("full"), F.lit(False).alias("several"))
    merge = lambda rows: rows.groupBy("file", "var").agg(one.alias("full"), F.coalesce(several, F.lit(True)).alias("several"))
    known, state = cut(merge(first)), None
    while True:
        before, state = state, known.agg(F.count(F.lit(1)), F.count_if("several")).first()
        if state == before:
            break
        up = known.select(F.col("file").alias("up_file"), F.col("var").alias("up_var"), F.col("full").alias("above"), "several")
        passed = of.join(up, ["up_file", "up_var"]).select("file", "var", F.when(~F.col("several"), joined_url(F.col("above"), F.col("prefix"))).alias("full"), "several")
        known = cut(merge(first.unionByName(passed)))
    return known.filter("NOT several").select("file", "var", "full")


def mounted(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """nodes with full_url: a route's URL under the prefix (file, var, full) of its router."""
    both = nodes.join(above, ["file", "var"], "left")
    return both.withColumn("full_url", F.when(F.col("full").isNotNull() & (F.col("kind") == "Route"), joined_url(F.col("full"), F.col("url")))).drop("full")


def asked_of(found: DataFrame) -> DataFrame:
    """owner, module: every module that any fact of a file names."""
    asked = None
    for c in ("imports", "references", "base_refs", "exports", "mounts"):
        one = found.select("path", F.explode(c).alias("x")).select("path", "x.module")
        asked = one if asked is None else asked.union(one)
    deeper = found.select("path", F.explode("imports").alias("x")).filter("x.symbol IS NOT NULL").select("path", F.concat(F.regexp_replace("x.module", "/$", ""), F.lit("/"), "x.symbol").alias("module"))
    return asked.union(deeper).filter("module IS NOT NULL AND module <> ''").select(F.col("path").alias("owner"), "module").distinct()


def modules_of(found: DataFrame) -> DataFrame:
    """module, module_file for every module that any fact of the files names."""
    return modules(asked_of(found), found)


def http_calls(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """owner, src, seq, method, call, folded: a call belongs to its file and to every function whose lines hold it."""
    http = found.select(F.col("path").alias("file"), F.posexplode("http").alias("seq", "h")).select("file", "seq", "h.*")
    inside = resolve.in_intervals(http, nodes.filter("kind IN ('Function', 'File')").select("file", F.col("id").alias("src"), "start", "end"), ["file"], "line", "start", "end")
    return inside.select(F.col("file").alias("owner"), "src", "seq", "method", normalize_url(F.col("url")).alias("call"), normalize_url(F.col("url"), True).alias("folded"))


def url_targets(nodes: DataFrame) -> DataFrame:
    """tier, url, method, target: routes, and functions with an endpoint of their own."""
    methods = F.explode(F.when(F.size("methods") > 0, F.col("methods")).otherwise(F.array(F.lit("GET")))).alias("method")
    first = nodes.filter("kind = 'Route'").select(F.lit(1).alias("tier"), normalize_url(F.coalesce("full_url", "url")).alias("url"), methods, F.col("id").alias("target"))
    second = endpoints(nodes).select(F.lit(2).alias("tier"), module_url(normalize_url(F.col("url")), F.col("file")).alias("url"), methods, "target")
    return first.unionByName(second)


def requests(calls: DataFrame, nodes: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """owner, src, dst, seq: HTTP calls to what answers them; and owner of the calls that no URL fits.

    Routes are asked first, then functions with an endpoint of their own, then, for URLs that fit none of
    either, functions by their names. See operators.urls.
    """
    asked = calls.select("method", "call", "folded").distinct()
    met, seen = urls.answers(asked, targets)
    open_ = asked.join(seen, ["call", "folded"], "left_anti")
    methods = F.explode(F.when(F.size("methods") > 0, F.col("methods")).otherwise(F.array(F.lit("GET")))).alias("method")
    names = nodes.filter("kind IN ('Function', 'Class')").select(F.col("id").alias("target"), "name", "file", "kind")
    named = urls.named_answers(open_, names, endpoints(nodes).select("target", methods))
    best = met.select("method", "call", "target").union(named.select("method", "call", "target"))
    found = calls.join(best, ["method", "call"]).filter("src <> target").groupBy("owner", "src", F.col("target").alias("dst")).agg(F.min("seq").cast("long").alias("seq"))
    return found, calls.join(open_.select("call", "folded").distinct(), ["call", "folded"], "left_semi").select("owner").distinct()


def endpoints(nodes: DataFrame) -> DataFrame:
    """target, file, url, methods: the functions of a file that have the name of a route's handler there, by its last route."""
    routes = nodes.filter("kind = 'Route'").select("file", F.col("url").alias("route"), "methods", "start", F.explode("handlers").alias("handler"))
    last = routes.groupBy("file", F.element_at(F.split("handler", r"\."), -1).alias("name")).agg(F.max(F.struct("start", "route", "methods")).alias("last"))
    own = nodes.filter("kind = 'Function'").select("file", "name", F.col("id").alias("target"))
    return own.join(last, ["file", "name"]).select("target", "file", F.col("last.route").alias("url"), F.col("last.methods").alias("methods"))


def containment(nodes: DataFrame) -> DataFrame:
    """owner, src, dst: what lies in what; definitions within a function lie in its file as well."""
    owner = F.when(F.col("kind") != "Folder", F.col("file")).otherwise("").alias("owner")
    inside = nodes.filter("parent IS NOT NULL").select(owner, F.col("id").alias("src"), F.col("parent").alias("dst"))
    of_function = nodes.join(nodes.filter("kind = 'Function'").select(F.col("id").alias("parent")), "parent", "left_semi").select(F.col("file").alias("owner"), F.col("id").alias("src"), F.col("file").alias("dst"))
    return inside.union(of_function).distinct()


def bases_of(found: DataFrame, where: DataFrame, nodes: DataFrame, out: DataFrame) -> DataFrame:
    """owner, child, parent: classes and their bases, where these are known."""
    bases = found.select("path", F.explode("base_refs").alias("b")).select("path", "b.*")
    known = _refs(bases, where, nodes, out).filter("ref_kind = 'Class'")
    return known.select(F.col("path").alias("owner"), F.concat("path", F.lit(":"), "child").alias("child"), F.col("ref").alias("parent")).distinct()


def calls_of(found: DataFrame, where: DataFrame, nodes: DataFrame, out: DataFrame) -> DataFrame:
    """References of files with ref, the node that they name, and its kind."""
    references = found.select("path", F.explode("references").alias("r")).select("path", "r.*")
    return _refs(references, where, nodes, out).withColumn("caller", F.concat("path", F.lit(":"), "caller"))


#: A link is an edge with the file whose facts make it, and how: edges that several make are one.
LINK = ["owner", "how", "src", "dst", "edge_class", "seq"]


def links_of(found: DataFrame, nodes: DataFrame, where: DataFrame, calls: DataFrame, above: DataFrame) -> DataFrame:
    """The links (LINK) of files but those of HTTP calls and of what lies in what.

    found: facts of the files; nodes, where, above: of the whole workspace; calls: see calls_of().
    """
    imports = found.select("path", F.explode("imports").alias("i")).select("path", "i.*")
    owner, seq = F.col("path").alias("owner"), F.lit(0).cast("long").alias("seq")

    whole = imports.select("path", "module").union(imports.filter("symbol IS NOT NULL").select("path", F.concat(F.regexp_replace("module", "/$", ""), F.lit("/"), "symbol")))
    imported = whole.join(where, "module").filter("module_file <> path").select(owner, F.col("module_file").alias("src"), F.col("path").alias("dst"), seq).distinct()

    classes = nodes.filter("kind = 'Class'")
    related = named_targets(variants_of(relations_of(found), found), classes, where).filter("target <> source").select(owner, F.col("target").alias("src"), F.col("source").alias("dst"), seq).distinct()

    line = nodes.filter("kind = 'Class'").select(F.col("id").alias("node"), F.col("id").alias("ancestor"), F.lit(0).alias("distance")).unionByName(above)
    members = calls.filter("kind IN ('member', 'super') AND ref_kind = 'Class'").join(line, F.col("ref") == F.col("node")).filter("kind = 'member' OR distance > 0")
    methods = nodes.filter("kind = 'Function'").select(F.col("id").alias("callee"))
    held = members.withColumn("callee", F.concat("ancestor", F.lit("."), "member")).join(methods, "callee")
    by = ["path", "caller", "call", "seq"]
    near = resolve.unique_target(resolve.lowest_tier(held, by, "distance"), by, "callee")
    plain = calls.filter("kind = 'name'").select(*by, F.col("ref").alias("callee"))
    called = plain.unionByName(near).filter("caller <> callee").groupBy(owner, F.col("caller").alias("src"), F.col("callee").alias("dst")).agg(F.min("seq").cast("long").alias("seq"))

    own = nodes.join(found.select(F.col("path").alias("file")), "file", "left_semi").filter("kind IN ('Route', 'Middleware')")
    views = nodes.filter("kind IN ('Function', 'Class')")
    handled = named_targets(variants_of(handlers_of(own), found), views, where).select(owner, F.col("source").alias("src"), F.col("target").alias("dst"), seq).distinct()

    wrapping = own.filter("kind = 'Middleware' AND var IS NOT NULL").select(F.col("id").alias("src"), "file", "var")
    wrapped = resolve.or_fallback(wrapping, own.filter("kind = 'Route' AND var <> ''").select(F.col("id").alias("dst"), "file", "var"), ["file"], "var", F.col("var") == "app")
    wrapped = wrapped.select(F.col("file").alias("owner"), "src", "dst", seq)
    python = F.when(F.contains("src", F.lit(".py:")), "executable").otherwise("generated")
    parts = {"import": (imported, F.lit("structural")), "relation": (related, F.lit("structural")), "call": (called, python), "handler": (handled, F.lit("generated")), "middleware": (wrapped, F.lit("generated"))}
    out = None
    for how, (df, kind) in parts.items():
        one = df.select("owner", F.lit(how).alias("how"), "src", "dst", kind.alias("edge_class"), "seq")
        out = one if out is None else out.unionByName(one)
    return out


def relations_of(found: DataFrame) -> DataFrame:
    """path, source, name: the classes that declare a relation, and what they say of the other side."""
    return found.select("path", F.explode("relations").alias("r")).select("path", F.concat("path", F.lit(":"), "r.owner").alias("source"), F.col("r.model").alias("name"))


def handlers_of(nodes: DataFrame) -> DataFrame:
    """path, source, name: routes and what they say of their handlers."""
    return nodes.filter("kind = 'Route'").select(F.col("file").alias("path"), F.col("id").alias("source"), F.explode("handlers").alias("name"))


def variants_of(asked: DataFrame, found: DataFrame) -> DataFrame:
    """asked (path, source, name) with the names that each could have elsewhere, in order, and the module that it is imported from.

    A name is tried as it stands, then by its last part and by its first one, where a view that a class makes is its
    class; a name that the file imports is tried by what it is called there before its parts.
    """
    imports = found.select("path", F.explode("imports").alias("i")).select("path", "i.*").filter("alias IS NOT NULL")
    bound = imports.groupBy("path", F.col("alias").alias("head")).agg(F.min(F.struct("line", "module", "symbol")).alias("b")).select("path", "head", F.col("b.module").alias("module"), F.col("b.symbol").alias("symbol"))
    parts = F.split("name", r"\.")
    head, tail, several = parts[0], F.element_at(parts, -1), F.size(parts) > 1
    rows = asked.filter("name IS NOT NULL AND name <> ''").withColumn("head", head).join(bound, ["path", "head"], "left")
    plain = F.array(F.col("name"), F.when(~several, F.col("symbol")), tail, F.when(several, head))
    names = F.when(several & (tail == "as_view"), F.array(F.col("name"), head, tail)).otherwise(plain)
    deeper = F.when(several & F.col("symbol").isNotNull(), F.concat_ws("/", F.regexp_replace("module", "/$", ""), "symbol")).otherwise(F.col("module"))
    return rows.select("path", "source", "name", F.array_distinct(F.array_compact(names)).alias("variants"), deeper.alias("module"), F.when(several, head).alias("hint"))


#: What a candidate's place tells, that it is in the imported module, in the same folder, in a file of the name before the dot.
IN_MODULE, IN_FOLDER, IN_HINT = 10, 4, 3


def named_targets(asked: DataFrame, nodes: DataFrame, where: DataFrame) -> DataFrame:
    """path, source, name, target: the one node that each row of variants_of() means, where that is clear.

    A definition of that very name in the file itself goes first. Else the candidates of the first variant that has
    any count; of several, the one whose place tells most, if it tells anything and no other tells as much.
    """
    key = ["path", "source", "name"]
    index = nodes.select(F.col("id").alias("target"), F.col("name").alias("as"), "qualified", "file")
    tried = asked.select(*key, "module", "hint", F.posexplode("variants").alias("nth", "as")).join(index, "as")
    here = tried.filter((F.col("file") == F.col("path")) & (F.col("qualified") == F.col("name")) & (F.col("nth") == 0)).select(*key, "target")
    rest = resolve.lowest_tier(tried.join(here.select(*key), key, "left_anti"), key, "nth")
    rest = rest.join(where.withColumnRenamed("module_file", "expected"), "module", "left")
    folder = lambda c: F.regexp_replace(c, "[^/]*$", "")
    plus = lambda test, n: F.when(F.coalesce(test, F.lit(False)), n).otherwise(0)
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.\w+$", "")
    score = plus(F.col("file") == F.col("expected"), IN_MODULE) + plus(folder(F.col("file")) == folder(F.col("path")), IN_FOLDER) + plus(stem == F.col("hint"), IN_HINT)
    scored = rest.select(*key, "target", score.alias("score"))
    alone = resolve.unique_target(scored, key, "target").select(*key, "target")
    best = resolve.best_scored(scored.join(alone.select(*key), key, "left_anti"), key, "score", "target").filter("target IS NOT NULL").select(*key, "target")
    return here.union(alone).union(best)


def as_links(rows: DataFrame, how: str, edge_class: str) -> DataFrame:
    seq = F.col("seq") if "seq" in rows.columns else F.lit(0).cast("long").alias("seq")
    return rows.select("owner", F.lit(how).alias("how"), "src", "dst", F.lit(edge_class).alias("edge_class"), seq)


def edges_from(links: DataFrame) -> DataFrame:
    """src, dst, edge_class, seq: each edge once, with the place where it occurs first."""
    return links.groupBy("src", "dst", "edge_class").agg(F.min("seq").alias("seq"))


def edges_of(found: DataFrame, nodes: DataFrame, where: DataFrame) -> DataFrame:
    """All edges, from the facts, the nodes and the modules of the same files."""
    out = cut(exported(found, where, nodes))
    calls = cut(calls_of(found, where, nodes, out))
    above = traverse.closure(bases_of(found, where, nodes, out).select("child", "parent"))
    links = links_of(found, nodes, where, calls, above).unionByName(as_links(containment(nodes), "within", "structural"))
    asking = cut(http_calls(found, nodes))
    if not asking.isEmpty():
        links = links.unionByName(as_links(requests(asking, nodes, cut(url_targets(nodes)))[0], "request", "generated"))
    return edges_from(links)


@dataclass
class Graph:
    """nodes and edges of one state of a workspace, and the files that couldn't be read as they should."""

    nodes: DataFrame
    edges: DataFrame
    errors: DataFrame
    #: nodes and steps without inline callbacks, and keys of nodes, if they are kept; see questions.
    named: tuple[DataFrame, Steps, DataFrame] | None = None


def view_patterns(graph: Graph) -> DataFrame:
    """id, url_patterns: the URLs, in order, whose patterns name a view, for each view that has any."""
    routes = graph.nodes.filter("kind = 'Route'").select(F.col("id").alias("src"), "url")
    own = graph.edges.filter("edge_class = 'generated'").join(routes, "src")
    return own.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("url")).alias("url_patterns"))


def calls_by_name(nodes: DataFrame) -> DataFrame:
    """src, dst: each call with every function and class of its name, however many; what resolution never does."""
    calls = nodes.select(F.col("id").alias("src"), F.explode("calls").alias("call")).select("src", last_segment(F.col("call")).alias("name")).distinct()
    named = nodes.filter("kind IN ('Function', 'Class')").select("name", F.col("id").alias("dst")).distinct()  # each has one name, so no pair comes twice
    return resolve.all_pairs(calls, named, ["name"]).filter("src <> dst").select("src", "dst")


def build(files: DataFrame, languages: Sequence[dict] = ()) -> Graph:
    """The graph of files (path, content). Facts, nodes and edges are each written once."""
    found = cut(facts(files, languages))
    where = cut(modules_of(found))
    nodes = cut(mounted(with_folders(nodes_of(found), found), prefixes(found, where)))
    return Graph(nodes, cut(edges_of(found, nodes, where)), found.filter("error IS NOT NULL").select("path", "error"))


def build_from(spark: SparkSession, sources: dict[str, str]) -> Graph:
    return build(spark.createDataFrame([(p, bytearray(s.encode())) for p, s in sources.items()], "path string, content binary"))
