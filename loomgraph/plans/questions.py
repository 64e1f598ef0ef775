"""The three questions: what is in here, where is a symbol and what touches it, what breaks if it changes.

Each is a handful of filters, joins and walks over nodes and edges; only what an answer may show, which is
bounded, comes to the driver. Answers are dictionaries in a fixed order; as_yaml() renders them.
"""

from __future__ import annotations

import builtins
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.columns import CALLBACK, display_name, is_callback, is_under, last_segment
from loomgraph.operators import resolve, traverse
from loomgraph.operators.adjacency import Steps
from loomgraph.plans.code_graph import Graph
from loomgraph.storage import cut

MAP_ENTRIES, MAP_DEPTH, PREVIEW, IMPORTS = 300, 4, 8, 40
RELATED, UNRESOLVED, POSSIBLE, REACHED, DEPTH = 50, 30, 30, 300, 25
FEW = 500  # nodes that are fetched by value
RESOLVED = (".py", ".js", ".jsx", ".ts", ".tsx")  # of these, calls are followed through imports and types
DOTTED = ("Class", "Function", "Declaration")
SYMBOLS = (*DOTTED, "Route", "Middleware")

# The texts of answers.
STALE = "Index is stale or a graph update was interrupted; allow pending retries or restart to rescan."
FIND_HINT = "Try the bare name (create_sale), a qualified name (SalesAPI.create_sale), or <file>:<name> (api.py:create_sale). Unindexed files are excluded."
CHOOSE_HINT = "Several definitions match; call again with the exact `id` (or restrict with `path`)."
STOPPED = "Traversal stopped after {} nodes; lower depth or start from a narrower symbol."
BEYOND = "Nodes at depth {} still have unexplored {}; raise depth to continue."
BY_NAME = "{} possible_callers reach '{}' through a receiver the resolver could not type (see 'via'); they are matched by name only, are not in 'affected', and must be verified by reading the call site."
OPEN_CALLS = "{} calls made by the target could not be resolved to a symbol (unresolved_callees); their dependencies are not in 'affected'."
HEURISTIC = "Route/File/Middleware entries come from framework and HTTP-call linking, which is heuristic."
NAMED_CALLS = "Call edges for non-Python files are matched by name and may include false positives."
CAPPED = "Listing capped at {} entries; map a sub-folder or lower depth."

# Calls that tell nothing about dependencies.
BUILTINS = frozenset(name for name in dir(builtins) if not name.startswith("_"))
JS_GLOBALS = frozenset("require setTimeout setInterval clearTimeout clearInterval parseInt parseFloat isNaN encodeURIComponent decodeURIComponent String Number Boolean Array Object Error Promise Date Map Set".split())
RECEIVERS = frozenset("console JSON Math Object Array Promise Number String Date logger logging process window document navigator globalThis".split())
COMMON = frozenset(
    "strip rstrip lstrip split rsplit join replace startswith endswith lower upper format encode decode append extend pop items keys values "
    "setdefault sort reverse push map filter forEach reduce then catch finally toString includes indexOf slice splice concat trim toLowerCase "
    "toUpperCase stringify entries isArray".split()
)


def is_noise(call):
    """Whether a call is a builtin, or goes to a platform object or a common method of one; a column."""
    head = F.split(call, r"\.")[0]
    return F.when(~F.contains(call, F.lit(".")), call.isin(*BUILTINS | JS_GLOBALS)).otherwise(head.isin(*RECEIVERS) | last_segment(call).isin(*COMMON))


def _cut(text, limit: int) -> str | None:
    text = str(text).strip() if text is not None else ""
    return (text if len(text) <= limit else text[: limit - 3] + "...") or None


def _span(r) -> str | None:
    return None if r["start"] is None else f"{r['start']}-{r['end']}" if r["end"] and r["end"] != r["start"] else str(r["start"])


def _bounded(key: str, items: list, limit: int) -> dict:
    return {key: items[:limit]} | ({f"{key}_omitted": len(items) - limit} if len(items) > limit else {})


def transparent(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """nodes and edges without inline callbacks: what one calls or holds belongs to the definition around it."""
    around = lambda c: F.regexp_replace(F.regexp_replace(c, r"(\.callback_L\d+_C\d+)+$", ""), r":callback_L\d+_C\d+$", "")
    rows = graph.nodes.withColumn("owner", around("id"))
    calls = rows.filter("calls IS NOT NULL").groupBy(F.col("owner").alias("id")).agg(F.array_sort(F.collect_list(F.struct("start", F.col("id").alias("of"), "calls"))).alias("c"))
    calls = calls.select("id", F.filter(F.array_distinct(F.flatten(F.transform("c", lambda x: x["calls"]))), lambda x: ~x.rlike(CALLBACK)).alias("calls"))
    named = rows.filter("owner = id").drop("owner", "calls").join(calls, "id", "left")
    named = named.withColumn("parent", around("parent")).withColumn("qualified", F.when(F.col("kind").isin(*DOTTED), display_name(F.col("qualified"))).otherwise(F.col("qualified")))
    edges = graph.edges.select(around("src").alias("src"), around("dst").alias("dst"), "edge_class", "seq").filter("src <> dst")
    return named, edges.groupBy("src", "dst", "edge_class").agg(F.min("seq").alias("seq"))


def kept(graph: Graph) -> Graph:
    """graph with its nodes and edges without inline callbacks, written once: no question works them out anew."""
    nodes, edges = transparent(graph)
    return replace(graph, named=(cut(nodes), Steps(cut(edges)), None))


def lookup_keys(nodes: DataFrame) -> DataFrame:
    """key, id, file: every text that a node can be asked for by, behind a mark of how it answers to it.

    i: id, n: name, q: qualified name, s: what stands behind a dot of it, l and m: name and qualified name in
    lower case, f and d: a file's or folder's path and what stands behind a slash of it. In order of key, so
    that of a table that is kept only the parts are read that can hold the keys that are asked for.
    """
    q, name, dots, symbol = F.col("qualified"), F.col("name"), F.col("kind").isin(*DOTTED), F.col("kind").isin(*SYMBOLS)
    marked = lambda mark, text, test=None: F.when(F.lit(True) if test is None else test, F.concat(F.lit(mark), text))
    behind = lambda text, sep: F.transform(F.sequence(F.lit(2), F.greatest(F.size(F.split(text, sep)), F.lit(2))), lambda i: F.array_join(F.slice(F.split(text, sep), i, 1 << 20), sep.replace("\\", "")))
    tails = F.when(dots, F.transform(F.filter(behind(q, "\\."), lambda x: x != ""), lambda x: F.concat(F.lit("s"), x)))
    path = F.when(F.col("kind").isin("File", "Folder"), F.transform(F.concat(F.array("id"), F.filter(behind(F.col("id"), "/"), lambda x: x != "")), lambda x: F.concat(F.when(F.col("kind") == "File", "f").otherwise("d"), x)))
    own = F.array(marked("i", F.col("id")), marked("n", name, symbol), marked("q", q, symbol), marked("l", F.lower(name), symbol), marked("m", F.lower(q), symbol))
    none = F.array().cast("array<string>")
    every = F.array_distinct(F.array_compact(F.concat(own, F.coalesce(tails, none), F.coalesce(path, none))))
    return nodes.select(F.explode(every).alias("key"), "id", "file")


class CodeStructure:
    """Answers over one graph. stale: whether its files have changed since; health: further warnings."""

    def __init__(self, graph: Graph, workspace: str = "", stale: bool = False, health: tuple[str, ...] = ()):
        self.workspace, self.stale, self.health, self.raw = workspace, stale, health, graph.nodes
        self.keys = None
        if graph.named:  # kept with the state, so that no question works it out anew
            self.nodes, self.steps, self.keys = graph.named
            self.edges = self.steps.edges
        else:
            self.nodes, self.edges = transparent(graph)
            self.steps = Steps(self.edges)

    # shared

    def _meta(self) -> dict:
        warnings = [STALE] * self.stale + list(self.health)
        return {"workspace": self.workspace, "index_stale": self.stale, "graph_built": True} | ({"warnings": warnings} if warnings else {})

    def _clean(self, text: str | None) -> str:
        text = (text or "").strip().replace("\\", "/")
        root = self.workspace.rstrip("/") + "/"
        text = text[len(root) :] if self.workspace and text.startswith(root) else text
        while text.startswith("./"):
            text = text[2:]
        return "" if text == "." else text

    def _rows(self, df: DataFrame, limit: int | None = None) -> list:
        df = df.orderBy("file", F.coalesce("start", F.lit(0)), "id")
        return (df.limit(limit) if limit else df).collect()

    @staticmethod
    def _brief(r) -> dict:
        out = {"id": r["id"], "kind": r["kind"], "name": r["qualified"], "file": r["file"]}
        out |= {"lines": s} if (s := _span(r)) else {}
        return out | ({"signature": s} if (s := _cut(r["signature"], 200)) else {})

    @staticmethod
    def _entry(r, depth: int | None = None) -> str:
        span = _span(r) if r["kind"] not in ("File", "Folder") else None
        return " ".join([r["qualified"], f"[{r['kind']}]", *([f"L{span}"] if span else []), *([f"depth={depth}"] if depth is not None else [])])

    # resolution

    def _by_keys(self, text: str, scope: str) -> DataFrame:
        """matches() by the keys that are kept with the state: of keys and nodes only what can be meant is read."""
        if ":" in text:
            file, _, name = text.partition(":")
            file = file.strip("/")
            here = (F.col("file") == file) | F.endswith("file", F.lit("/" + file))
            tiers = {"i" + text: 0, "q" + name: 1, "s" + name: 2, "m" + name.lower(): 3}
        else:
            bare, here = text.rstrip("/"), F.lit(True)
            tiers = {"i" + text: 0, "q" + text: 1, "n" + text: 1, "s" + text: 2, "l" + text.lower(): 3, "f" + bare: 4, "d" + bare: 5}
        tier = F.coalesce(*[F.when(F.col("key") == k, n) for k, n in tiers.items()])
        found = self.keys.filter(F.col("key").isin(*tiers)).withColumn("tier", tier).filter((F.col("tier") == 0) | here)
        found = (found.filter(is_under(F.col("file"), scope)) if scope else found).select("id", "file", "tier").distinct()
        few = found.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.slice(F.collect_list(F.struct("file", "id")), 1, FEW + 1).alias("some")).orderBy("tier").first() if text else None
        if few is None:
            return self.nodes.limit(0)
        if few["n"] > FEW:
            return self.nodes.join(found.filter(F.col("tier") == few["tier"]).select("id"), "id", "left_semi").select(*self.nodes.columns)
        return self.nodes.filter(F.col("file").isin(*{r["file"] for r in few["some"]}) & F.col("id").isin(*(r["id"] for r in few["some"])))

    def matches(self, symbol: str, path: str | None = None) -> DataFrame:
        """The nodes that a text names, those of its best tier only: id, file and name, bare name, path."""
        text, scope = self._clean(symbol), self._clean(path).rstrip("/")
        if self.keys is not None:
            return self._by_keys(text, scope)
        n = self.nodes.filter(is_under(F.col("file"), scope)) if scope else self.nodes
        q, kind, dots = F.col("qualified"), F.col("kind"), F.col("kind").isin(*DOTTED)
        none = F.lit(None).cast("int")
        if ":" in text:
            file, _, name = text.partition(":")
            file = file.strip("/")
            here = kind.isin(*SYMBOLS) & ((F.col("file") == file) | F.endswith("file", F.lit("/" + file)))
            tier = F.when(here & (q == name), 1).when(here & dots & F.endswith(q, F.lit("." + name)), 2).when(here & (F.lower(q) == name.lower()), 3).otherwise(none)
        else:
            s, bare = kind.isin(*SYMBOLS), text.rstrip("/")
            tier = F.when(s & ((q == text) | (F.col("name") == text)), 1).when(s & dots & F.endswith(q, F.lit("." + text)), 2).when(s & (F.lower("name") == text.lower()), 3)
            for i, k in enumerate(("File", "Folder")):
                tier = tier.when((kind == k) & ((F.col("id") == bare) | F.endswith("id", F.lit("/" + bare))), 4 + i)
        tiered = n.withColumn("tier", F.when(F.col("id") == text, 0).otherwise(tier)).filter("tier IS NOT NULL")
        return tiered.filter(F.col("tier") == (tiered.agg(F.min("tier")).first()[0] if text else -1) if text else F.lit(False)).drop("tier")

    def _resolve(self, tool: str, symbol: str, path: str | None = None):
        found = self.matches(symbol, path)
        rows = self._rows(found, RELATED + 1)
        if len(rows) == 1:
            return rows[0], None
        if not rows:
            out = {"ok": False, "tool": tool, "error": f"No indexed symbol matches '{(symbol or '').strip()}'", "meta": self._meta()}
            close = self._suggest(self._clean(symbol))
            return None, out | ({"suggestions": close} if close else {}) | {"status": "not_found", "hint": FIND_HINT}
        total = found.count()
        out = {"ok": True, "tool": tool, "status": "ambiguous", "meta": self._meta() | {"candidates": total}, "candidates": [self._brief(r) for r in rows[:RELATED]]}
        out["hint"] = CHOOSE_HINT
        return None, out | ({"candidates_omitted": total - RELATED} if total > RELATED else {})

    def _suggest(self, text: str) -> list[str]:
        probe = text.split(":", 1)[1] if ":" in text else text
        probe = probe.rsplit(".", 1)[-1] if "." in probe and "/" not in probe else probe
        own = self.nodes.filter(F.col("kind").isin(*SYMBOLS))
        names = own.select(F.explode(F.array_distinct(F.array("qualified", "name"))).alias("text"), "id").groupBy("text").agg(F.min("id").alias("id"))
        close = resolve.most_alike(names, "text", probe, 0.6, 5).collect() or resolve.most_alike(self.nodes.select(F.col("id").alias("text"), "id"), "text", text, 0.5, 5).collect()
        return [r["id"] for r in close]

    # the graph by id

    def callers(self, node: str) -> list[str]:
        return self._all(self._ends(node, "callers"))

    def callees(self, node: str) -> list[str]:
        return self._all(self._ends(node, "callees"))

    def dependents(self, node: str) -> list[str]:
        """Sources of edges of any class into a node; dependencies() are the other ends of those out of it."""
        return self._all(self._ends(node, "callers", None))

    def dependencies(self, node: str) -> list[str]:
        return self._all(self._ends(node, "callees", None))

    def numbered_callers(self, node: str) -> DataFrame:
        """nth, node: all direct callers in the order of answers, however many; they don't pass through the driver."""
        rows = self._ends(node, "callers").orderBy("s", "n").rdd.zipWithIndex().map(lambda x: (x[1], x[0]["n"]))
        return rows.toDF("nth long, node string")

    def contains(self, node: str) -> bool:
        return not self.nodes.filter(F.col("id") == node).isEmpty()

    @staticmethod
    def _all(ends: DataFrame) -> list[str]:
        return [r["n"] for r in ends.orderBy("s", "n").collect()]

    def blast_radius(self, node: str, max_depth: int = 0) -> DataFrame:
        """node, hop of everything that reaches a node in so many steps, 0: in any number."""
        return traverse.bfs(self.steps, self.nodes.sparkSession.createDataFrame([(node,)], "node string"), max_depth, "callers")

    def recursive_callees(self, node: str, max_depth: int = 0) -> DataFrame:
        return traverse.bfs(self.steps, self.nodes.sparkSession.createDataFrame([(node,)], "node string"), max_depth, "callees")

    def search(self, keyword: str) -> DataFrame:
        """Nodes whose name holds a keyword in any case, whole matches first, then by file and line."""
        return resolve.with_keyword(self.nodes, "name", keyword).orderBy("rank", "file", F.coalesce("start", F.lit(0)), "id")

    def stats(self) -> dict:
        by_class = {r["edge_class"]: r["count"] for r in self.edges.groupBy("edge_class").count().orderBy("edge_class").collect()}
        return {"nodes": self.nodes.count(), "edges": sum(by_class.values()), "by_class": by_class}

    # views

    def node(self, id_: str) -> dict | None:
        """All that is known of one node."""
        row = self.raw.filter(F.col("id") == id_).first()
        return row.asDict(True) if row else None

    def files_under(self, prefix: str = "") -> DataFrame:
        rel = self._clean(prefix).rstrip("/")
        own = self.nodes.filter("kind = 'File'")
        return (own.filter(is_under(F.col("file"), rel)) if rel else own).select("file").orderBy("file")

    def symbols_in_file(self, file: str, callbacks: bool = True) -> DataFrame:
        """id of the symbols of a file in order, inline callbacks included or left out."""
        own = self.raw.filter((F.col("file") == file) & F.col("kind").isin(*SYMBOLS))
        own = own if callbacks else own.filter(~is_callback(F.col("name")))
        return own.orderBy(F.coalesce("start", F.lit(0)), "id").select("id")

    def symbols(self) -> DataFrame:
        """file and ids of all symbols but inline callbacks."""
        return self.nodes.filter(F.col("kind").isin(*SYMBOLS)).select("file", "id")

    def callbacks_under(self, node: str) -> DataFrame:
        """id of the inline callbacks of a definition, nested ones down to the next named definition."""
        tail = F.substr("id", F.lit(len(node) + 1))
        own = self.raw.filter(F.startswith("id", F.lit(node)) & tail.rlike(r"^([.:]callback_L\d+_C\d+)+$"))
        return own.select("id")

    def answer(self, tool: str, *given, **named) -> str:
        """An answer as YAML; whatever goes wrong becomes one as well."""
        try:
            return as_yaml({"code_map": self.code_map, "lookup_symbol": self.lookup_symbol, "impact": self.impact}[tool](*given, **named))
        except Exception as e:
            return as_yaml({"ok": False, "tool": tool, "meta": {"workspace": self.workspace, "index_stale": None, "graph_built": None}, "error": str(e)})

    # questions

    def lookup_symbol(self, symbol: str, path: str | None = None) -> dict:
        node, failed = self._resolve("lookup_symbol", symbol, path)
        if failed:
            return failed
        out = {"ok": True, "tool": "lookup_symbol", "status": "resolved", "meta": self._meta(), "symbol": self._record(node)}
        if node["kind"] == "Folder":
            return out | {"hint": f"'{node['id']}' is a folder; use code_map(path='{node['id']}') for its contents."}
        return out | {"relationships": self._of_file(node) if node["kind"] == "File" else self._of_symbol(node)}

    def _record(self, r) -> dict:
        out = self._brief(r)
        if r["parent"] and r["parent"] != r["file"] and r["kind"] in SYMBOLS:
            out["container"] = r["parent"]
        out |= {"docstring": d} if (d := _cut(r["docstring"], 240)) else {}
        for key in ("decorators", "base_classes"):
            out |= _bounded(key, [_cut(x, 240) or "" for x in r[key]], 20) if r[key] else {}
        out |= {k: True for k in ("is_async", "is_generator", "is_exported") if r[k]}
        if r["kind"] == "Function" and r["param_count"] is not None:
            out["param_count"] = r["param_count"]
        if r["kind"] == "Route":
            out["url"] = r["full_url"] or r["url"]
            for key in ("methods", "handlers"):
                out |= _bounded(key, list(r[key]), 20) if r[key] else {}
        if r["kind"] == "File":
            out.pop("lines", None)
            out |= {"line_count": r["end"]} if r["end"] else {}
            out |= _bounded("frameworks", list(r["frameworks"]), 20) if r["frameworks"] else {}
        return out

    def _ends(self, node: str, direction: str, classes=traverse.EXECUTABLE) -> DataFrame:
        """n, s: direct neighbours and where their edges first occur."""
        own = self.steps.of([node], direction, classes).filter(F.col("next") != node)
        return own.groupBy(F.col("next").alias("n")).agg(F.min("seq").alias("s"))

    @staticmethod
    def _shown(key: str, rows: DataFrame, order: list, limit: int, show=lambda r: r["n"], always: bool = False) -> dict:
        """The first rows in order under a key, and how many are left out; no more than are shown come to the driver."""
        found = rows.orderBy(*order).limit(limit + 1).collect()
        if not found and not always:
            return {}
        return {key: [show(r) for r in found[:limit]]} | ({f"{key}_omitted": rows.count() - limit} if len(found) > limit else {})

    def _of_symbol(self, r) -> dict:
        by_seq, by_place = ["s", "n"], ["file", F.coalesce("start", F.lit(0)), "id"]
        callers, callees = self._ends(r["id"], "callers"), self._ends(r["id"], "callees")
        members = traverse.members(self.nodes.filter(F.col("kind").isin(*SYMBOLS)), [r["id"]], by_place)
        out = self._shown("callers", callers, by_seq, RELATED, always=True) | self._shown("callees", callees, by_seq, RELATED, always=True)
        out |= self._possible_shown(self._possible(r, callers.select(F.col("n").alias("id"))), POSSIBLE, "possible_callers")[0]
        out |= self._shown("members", members, ["nth"], RELATED, lambda x: x["id"])
        into = self._ends(r["id"], "callers", None).join(callers.select("n"), "n", "left_anti").join(members.select(F.col("id").alias("n")), "n", "left_anti")
        from_ = self._ends(r["id"], "callees", None).join(callees.select("n"), "n", "left_anti").filter(~F.col("n").isin(*filter(None, (r["parent"], r["file"]))))
        both = into.withColumn("of", F.lit(0)).unionByName(from_.withColumn("of", F.lit(1))).groupBy("n").agg(F.min(F.struct("of", "s")).alias("first"))
        out |= self._shown("related", both, ["first", "n"], RELATED)
        return out | self._shown("unresolved_calls", self._unresolved(r), ["nth"], UNRESOLVED, lambda x: x["call"])

    def _of_file(self, r) -> dict:
        """What a file defines, imports and is imported by, and the callers and callees of it and its symbols elsewhere."""
        own = self.nodes.filter(F.col("file") == r["id"])
        top = own.filter(F.col("kind").isin(*SYMBOLS) & (~F.col("kind").isin(*DOTTED) | ~F.contains("qualified", F.lit("."))))
        out = self._shown("defines", top, ["file", F.coalesce("start", F.lit(0)), "id"], RELATED, self._entry, True)
        files = self.nodes.filter(F.col("kind") == "File").select(F.col("id").alias("n"))
        for key, direction in (("imports", "callers"), ("imported_by", "callees")):
            out |= self._shown(key, self._ends(r["id"], direction, ("structural",)).join(files, "n", "left_semi"), ["s", "n"], RELATED, always=True)
        inside = own.select("id")
        calls = self.edges.filter(F.col("edge_class").isin(*traverse.EXECUTABLE))
        for key, a, b in (("callers", "dst", "src"), ("callees", "src", "dst")):
            met = calls.join(inside.withColumnRenamed("id", a), a, "left_semi").select(F.col(b).alias("n")).distinct()
            out |= self._shown(key, met.join(inside.withColumnRenamed("id", "n"), "n", "left_anti"), ["n"], RELATED)
        return out | {"hint": f"code_map(path='{r['id']}') returns the full definition tree."}

    def _unresolved(self, r) -> DataFrame:
        """call, nth: calls of a node that no callee's name answers to and that aren't noise."""
        forms = F.array_distinct(F.array("text", last_segment(F.col("text"))))
        own = self.nodes.filter(F.col("id") == r["id"]).select(F.posexplode("calls").alias("nth", "text")).withColumn("forms", F.size(forms))
        ends = self.steps.of([r["id"]], "callees").select(F.col("next").alias("id"))
        known = self.nodes.join(ends, "id", "left_semi").select(F.explode(F.array("name", "qualified")).alias("call"))
        left = resolve.unresolved_calls(own.withColumn("call", F.explode(forms)), known, "call", is_noise(F.col("text")))
        counted = left.groupBy(F.col("text").alias("call"), "forms").agg(F.min("nth").alias("nth"), F.count(F.lit(1)).alias("open"))
        return counted.filter(F.col("open") == F.col("forms")).select("call", "nth")

    def _possible(self, target, confirmed: DataFrame) -> DataFrame:
        """id, file, start, via: nodes with a call that ends in the target's name and leads nowhere of that name."""
        name = target["name"]
        wanted = (last_segment(F.col("call")) == name) & ~is_noise(F.col("call")) & ~is_noise(F.lit(name)) if target["kind"] in SYMBOLS else F.lit(False)
        calls = self.nodes.filter(F.col("id") != target["id"]).select("id", "file", "start", F.explode("calls").alias("call")).filter(wanted)
        linked = self.edges.filter(F.col("edge_class").isin(*traverse.EXECUTABLE)).join(self.nodes.filter(F.col("name") == name).select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"))
        left = resolve.possible_callers(calls, confirmed.union(linked), "id")
        return left.groupBy("id", "file", "start").agg(F.array_sort(F.collect_set("call")).alias("via"))

    def _possible_shown(self, rows: DataFrame, limit: int, key: str) -> tuple[dict, int]:
        show = lambda x: {"id": x["id"], "via": x["via"][0] if len(x["via"]) == 1 else list(x["via"])}
        out = self._shown(key, rows, ["file", F.coalesce("start", F.lit(0)), "id"], limit, show)
        return out, len(out.get(key, ())) + out.get(f"{key}_omitted", 0)

    def impact(self, symbol: str, depth: int | None = 2, direction: str = "callers") -> dict:
        direction = (direction or "callers").lower()
        if direction not in ("callers", "callees"):
            return {"ok": False, "tool": "impact", "error": f"direction must be 'callers' or 'callees', got '{direction}'", "meta": self._meta()}
        depth = 2 if depth is None else max(1, min(int(depth), DEPTH))
        target, failed = self._resolve("impact", symbol)
        if failed:
            return failed
        spark = self.nodes.sparkSession
        found, truncated = traverse.first_reached(self.steps, target["id"], depth, REACHED, direction)
        reached = spark.createDataFrame(found, "node string, hop int")
        shown = self._rows(F.broadcast(reached).join(self.nodes, F.col("node") == F.col("id")))
        last = [n for n, hop in found if hop == depth]
        ahead = self.steps.of(last, direction).filter(~F.col("next").isin(target["id"], *(n for n, _ in found))) if last else None
        beyond = truncated or ahead is not None and not ahead.isEmpty()
        possible, n_possible, open_, n_open = {}, 0, {}, 0
        if direction == "callers":
            possible, n_possible = self._possible_shown(self._possible(target, reached.select(F.col("node").alias("id"))), POSSIBLE, "possible_callers")
        else:
            open_ = self._shown("unresolved_callees", self._unresolved(target), ["nth"], UNRESOLVED, lambda x: x["call"])
            n_open = len(open_.get("unresolved_callees", ())) + open_.get("unresolved_callees_omitted", 0)
        cut_at_once = truncated and found[-1][1] == 1  # then more than the found ones are neighbours
        direct = self._ends(target["id"], direction).count() if cut_at_once else sum(hop == 1 for _, hop in found)
        meta = self._meta() | {"direction": direction, "depth": depth, "direct": direct, "total": len(found), "files": len({r["file"] for r in shown}), "truncated": truncated, "more_beyond_depth": beyond}
        meta |= {"possible": n_possible} if direction == "callers" else {}
        warnings = meta.pop("warnings", [])
        if truncated:
            warnings.append(STOPPED.format(REACHED))
        if beyond:
            warnings.append(BEYOND.format(depth, direction))
        if n_possible:
            warnings.append(BY_NAME.format(n_possible, target["name"]))
        if n_open:
            warnings.append(OPEN_CALLS.format(n_open))
        if any(r["kind"] in ("Route", "File", "Middleware") for r in shown):
            warnings.append(HEURISTIC)
        if any(r["kind"] == "Function" and not r["file"].lower().endswith(RESOLVED) for r in (target, *shown)):
            warnings.append(NAMED_CALLS)
        grouped: dict[str, list[str]] = {}
        for r in shown:
            grouped.setdefault(r["file"], []).append(self._entry(r, r["hop"]))
        out = {"ok": True, "tool": "impact", "target": self._brief(target), "meta": meta | ({"warnings": warnings} if warnings else {}), "affected": grouped}
        return out | possible | open_

    def code_map(self, path: str = ".", depth: int = 1) -> dict:
        rel, depth = self._clean(path).rstrip("/"), max(1, min(int(depth or 1), MAP_DEPTH))
        inside = self.nodes.filter(is_under(F.col("file"), rel)) if rel else self.nodes
        files = inside.filter("kind = 'File'")
        if rel and not files.filter(F.col("id") == rel).isEmpty():
            return self._map_file(rel)
        if files.isEmpty():
            tails = self.nodes.filter(F.col("kind").isin("File", "Folder")).select(F.col("name").alias("text"), "id").groupBy("text").agg(F.min("id").alias("id"))
            close = [r["id"] for r in resolve.most_alike(tails, "text", rel.rsplit("/", 1)[-1], 0.6, 5).collect()] if rel else []
            out = {"ok": False, "tool": "code_map", "error": f"'{path}' is not an indexed file or directory", "meta": self._meta()}
            return out | ({"suggestions": close} if close else {})
        return self._map_folder(rel, inside, files, depth)

    def _map_folder(self, rel: str, inside: DataFrame, files: DataFrame, depth: int) -> dict:
        """Folders down to depth, and the files beside them, in the order of a walk; the first 300 entries."""
        symbols = inside.filter(F.col("kind").isin(*SYMBOLS))
        per_file = symbols.groupBy("file", "kind").agg(F.count(F.lit(1)).alias("n"))
        counts = per_file.groupBy("file").agg(F.sum("n").alias("symbols"), F.array_sort(F.collect_list(F.struct("kind", "n"))).alias("kinds"))
        top = symbols.filter(~F.col("kind").isin(*DOTTED) | ~F.contains("qualified", F.lit(".")))
        nth = F.row_number().over(Window.partitionBy("file").orderBy(F.coalesce("start", F.lit(0)), "id"))
        head = top.withColumn("nth", nth).groupBy("file").agg(F.array_sort(F.collect_list(F.when(F.col("nth") <= PREVIEW, F.struct("nth", "qualified")))).alias("top"), F.greatest(F.count(F.lit(1)) - PREVIEW, F.lit(0)).alias("more"))
        base = rel.count("/") + 1 if rel else 0
        listed = files.select("id", "end").join(counts, F.col("id") == F.col("file"), "left").drop("file").join(head, F.col("id") == F.col("file"), "left").drop("file")
        parts = F.split("id", "/")
        level = F.size(parts) - base  # 1: directly here
        folders = listed.withColumn("folder", F.explode(F.transform(F.sequence(F.lit(base + 1), F.lit(base + depth)), lambda n: F.when(F.size(parts) > n, F.array_join(F.slice(parts, 1, n), "/")))))
        folders = folders.filter("folder IS NOT NULL").groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("symbols"), F.lit(0)).alias("symbols"))
        shown = listed.filter(level <= depth)
        key = lambda c, mark: F.array_join(F.transform(F.split(c, "/"), lambda s, i: F.concat(F.when(i == F.size(F.split(c, "/")) - 1, F.lit(mark)).otherwise(F.lit("0")), s)), "/")
        rows = folders.select(F.col("folder").alias("id"), F.lit(True).alias("folder"), key(F.col("folder"), "0").alias("key"), "files", "symbols").unionByName(
            shown.select("id", F.lit(False).alias("folder"), key(F.col("id"), "1").alias("key"), F.col("end").alias("files"), F.lit(None).cast("long").alias("symbols"), "kinds", "top", "more"), allowMissingColumns=True
        )
        found = rows.orderBy("key").limit(MAP_ENTRIES + 1).collect()
        totals = {"folders": folders.count(), "files": files.count(), "symbols": symbols.count()}
        tree: dict = {"path": rel or "."}
        at = {rel: tree}
        for r in found[:MAP_ENTRIES]:
            up = at.get(r["id"].rpartition("/")[0], tree)
            if r["folder"]:
                at[r["id"]] = own = {"path": r["id"], "files_count": r["files"], "symbols_count": r["symbols"]}
                up.setdefault("folders", []).append(own)
            else:
                own = {"path": r["id"]} | ({"line_count": r["files"]} if r["files"] else {})
                if r["kinds"]:
                    own["symbols"] = {k["kind"]: k["n"] for k in r["kinds"]}
                    names = ", ".join(x["qualified"] for x in r["top"] or ())
                    own |= {"top_level": names + (f" (+{r['more']})" if r["more"] else "")} if names else {}
                up.setdefault("files", []).append(own)
        tree.pop("path")
        meta = self._meta() | {"path": rel or ".", "kind": "directory"} | totals | {"truncated": len(found) > MAP_ENTRIES}
        if meta["truncated"]:
            meta["warnings"] = meta.get("warnings", []) + [CAPPED.format(MAP_ENTRIES)]
        return {"ok": True, "tool": "code_map", "meta": meta} | tree

    def _map_file(self, rel: str) -> dict:
        own = self.nodes.filter(F.col("file") == rel)
        symbols = own.filter(F.col("kind").isin(*SYMBOLS))
        total = symbols.count()
        rows = self._rows(symbols, MAP_ENTRIES)
        file = own.filter("kind = 'File'").first()
        made, tree = {}, []
        for r in rows:
            name = r["qualified"].rsplit(".", 1)[-1] if r["kind"] in DOTTED else r["qualified"]
            item = {"name": name, "kind": r["kind"]} | ({"lines": s} if (s := _span(r)) else {}) | ({"signature": r["signature"][:160]} if r["signature"] else {})
            if r["kind"] == "Route":
                item |= {"url": r["full_url"] or r["url"]} | (_bounded("methods", list(r["methods"]), 20) if r["methods"] else {}) | (_bounded("handlers", list(r["handlers"]), 20) if r["handlers"] else {})
            for k in ("decorators", "base_classes"):
                item |= _bounded(k, list(r[k]), 20) if r[k] else {}
            item |= {"is_async": True} if r["is_async"] else {}
            made[r["id"]] = item
            (made[r["parent"]].setdefault("members", []) if r["parent"] in made else tree).append(item)
        meta = self._meta() | {"path": rel, "kind": "file", "line_count": file["end"], "symbols": total}
        callbacks = self.raw.filter((F.col("file") == rel) & is_callback(F.col("name"))).count()
        meta |= ({"inline_callbacks": callbacks} if callbacks else {}) | {"truncated": total > MAP_ENTRIES}
        shown = {}
        for k in ("imports", "exports"):
            shown |= _bounded(k, [_cut(x, 240) or "" for x in file[k]], IMPORTS) if file[k] else {}
        return {"ok": True, "tool": "code_map", "meta": meta} | shown | {"symbols": tree}


def as_yaml(answer: dict) -> str:
    import yaml

    return yaml.safe_dump(answer, sort_keys=False, allow_unicode=True, default_flow_style=False)
