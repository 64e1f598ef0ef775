"""A small query language over a graph: each statement becomes one DataFrame plan.

    GET [DISTINCT] [columns] <kind> [WHERE <expr>] [WITH callers, callees] [ORDER BY c [DESC]] [LIMIT n] [OFFSET n]
    SEARCH "text" | /regex/i IN <kind> [WHERE ...] [ORDER BY ...]      GLOB "src/**/*.{py,ts}" [WHERE ...] [ORDER BY ...] [LIMIT n]
    METADATA FOR 'id'                IMPACT OF 'id' [DIRECTION callers|callees] [DEPTH n]
    PATH FROM 'id' TO 'id'           FLOW FOR 'id' [DEPTH n]          STACK FOR '/url'        STATS [FOR 'path']
    CHECK LAYERS 'path' AGAINST 'path'      LAYERS OF 'path'          ENFORCE "a MUST_NOT_IMPORT b" [IN 'path']
    FIND IMPLEMENTS 'base'           FIND DECORATED WITH 'name'       AUDIT TENANT 'parameter' [IN 'path']

Expressions have == != >= <= > <, LIKE (with * and ?), CONTAINS, =~ (a regular expression), each but the
ordering ones with NOT or ! as well, AND, OR, NOT and brackets. A list fits if one of its values does.
Columns that a kind doesn't have are null; a null fits nothing. Unknown statements, kinds and columns raise QueryError.
"""

from __future__ import annotations

import re
import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.columns import is_under, last_segment, normalize_url
from loomgraph.operators import traverse
from loomgraph.plans.questions import REACHED, RELATED, SYMBOLS, CodeStructure
from loomgraph.storage import cut

KINDS = {k.lower(): k for k in ("Function", "Class", "Declaration", "Route", "Middleware", "File", "Folder")}
COLUMNS = {"type": "kind", "file_path": "file", "body_preview": "preview", "line": "start", "node_id": "id"}
LISTS = ("decorators", "base_classes", "calls", "returns", "methods", "handlers", "imports", "exports", "frameworks")
PLAIN = ["id", "kind", "name", "file", "start", "end"]
TOKEN = re.compile(r"""\s*(?:(?P<text>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<number>-?\d+(?:\.\d+)?)|(?P<op>==|!=|>=|<=|!=~|=~|!=|>|<|\(|\)|,)|(?P<regex>/(?:\\.|[^/\\])+/[a-z]*)|(?P<word>[A-Za-z_][\w.]*))""")


class QueryError(ValueError):
    """A statement that can't be understood."""


def glob_regex(pattern: str, across: bool = False) -> str:
    """A path pattern as a regular expression: ** crosses folders, * and ? don't, unless across is set."""
    out, i = "", 0
    any_ = "." if across else "[^/]"
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + any_ + "*", i + 1
        elif c == "?":
            out, i = out + any_, i + 1
        elif c == "{" and "}" in pattern[i:]:
            end = pattern.index("}", i)
            out, i = out + "(?:" + "|".join(glob_regex(p, across)[1:-1] for p in pattern[i + 1 : end].split(",")) + ")", end + 1
        elif c == "[" and "]" in pattern[i:]:
            end = pattern.index("]", i)
            out, i = out + "[" + pattern[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return f"^{out}$"


class _Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text.rstrip()):
            m = TOKEN.match(text, at)
            if not m:
                raise QueryError(f"what is {text[at : at + 20]!r}?")
            value = m[m.lastgroup]
            self.tokens.append((m.lastgroup, re.sub(r"\\([\\'\"])", r"\1", value[1:-1]) if m.lastgroup == "text" else value))
            at = m.end()
        self.at = 0

    def peek(self, *words: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("word", "op") and self.tokens[self.at][1].upper() in words

    def take(self, *words: str) -> bool:
        found = self.peek(*words)
        self.at += found
        return found

    def need(self, *words: str) -> str:
        if not self.peek(*words):
            raise QueryError(f"{' or '.join(words)} is missing")
        self.at += 1
        return self.tokens[self.at - 1][1].upper()

    def value(self, *kinds: str) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] not in kinds:
            raise QueryError(f"a {' or a '.join(kinds)} is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def kind(self) -> str:
        word = self.value("word").lower()
        for k in (word, word.removesuffix("s"), word.removesuffix("es")):
            if k in KINDS:
                return KINDS[k]
        if word in ("nodes", "symbols"):
            return word
        raise QueryError(f"no kind {word}")

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise QueryError(f"what is {self.tokens[self.at][1]!r}?")

    # expressions

    def any_of(self, nodes: DataFrame) -> Column:
        out = self.all_of(nodes)
        while self.take("OR"):
            out = out | self.all_of(nodes)
        return out

    def all_of(self, nodes: DataFrame) -> Column:
        out = self.one(nodes)
        while self.take("AND"):
            out = out & self.one(nodes)
        return out

    def one(self, nodes: DataFrame) -> Column:
        if self.take("NOT"):
            return ~F.coalesce(self.one(nodes), F.lit(False))
        if self.take("("):
            out = self.any_of(nodes)
            self.need(")")
            return out
        name = COLUMNS.get(word := self.value("word"), word)
        column = column_of(nodes, name)
        not_ = self.take("NOT")
        if self.at >= len(self.tokens):
            raise QueryError("an operator is missing")
        op = self.tokens[self.at][1].upper()
        self.at += 1
        if op == "!=" and self.at < len(self.tokens) and self.tokens[self.at][1] == "~":
            self.at += 1
            op = "!=~"
        kind, raw = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        self.at += 1
        if kind not in ("text", "number", "word", "regex"):
            raise QueryError("a value is missing")
        literal = {"true": True, "false": False}.get(raw.lower(), raw) if kind == "word" else float(raw) if kind == "number" else raw
        tests = {
            "==": lambda c: c == literal, "!=": lambda c: c != literal, ">=": lambda c: c >= literal, "<=": lambda c: c <= literal, ">": lambda c: c > literal, "<": lambda c: c < literal,
            "LIKE": lambda c: c.rlike(glob_regex(str(literal), True)), "CONTAINS": lambda c: F.contains(c, F.lit(str(literal))), "=~": lambda c: c.rlike(_pattern(raw)), "!=~": lambda c: ~c.rlike(_pattern(raw)),
        }
        if op not in tests:
            raise QueryError(f"no operator {op}")
        test = F.exists(column, tests[op]) if name in LISTS else tests[op](column)
        return ~F.coalesce(test, F.lit(False)) if not_ else F.coalesce(test, F.lit(False))


def _pattern(raw: str) -> str:
    m = re.fullmatch(r"/(.*)/([a-z]*)", raw, re.S)
    return ("(?i)" if "i" in m[2] else "") + m[1] if m else raw


def column_of(nodes: DataFrame, name: str) -> Column:
    if name == "lines_count":
        return F.col("end") - F.col("start") + 1
    if name not in nodes.columns:
        raise QueryError(f"no column {name}")
    return F.col(name)


def _of_kind(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes if kind == "nodes" else nodes.filter(F.col("kind").isin(*SYMBOLS)) if kind == "symbols" else nodes.filter(F.col("kind") == kind)


def _tail(p: _Parser, rows: DataFrame, chosen: list[str], distinct: bool, edges: DataFrame) -> DataFrame:
    """WHERE, WITH, ORDER BY, LIMIT and OFFSET, in any order behind the kind."""
    order, limit, offset, with_ = [], None, 0, []
    while p.at < len(p.tokens):
        word = p.need("WHERE", "WITH", "ORDER", "LIMIT", "OFFSET")
        if word == "WHERE":
            rows = rows.filter(p.any_of(rows))
        elif word == "WITH":
            with_ = [p.need("CALLERS", "CALLEES").lower()]
            while p.take(","):
                with_.append(p.need("CALLERS", "CALLEES").lower())
        elif word == "ORDER":
            p.need("BY")
            while True:
                c = column_of(rows, COLUMNS.get(w := p.value("word"), w))
                order.append(c.desc() if p.take("DESC") else c.asc() if p.take("ASC") or True else c)
                if not p.take(","):
                    break
        elif word == "LIMIT":
            limit = int(p.value("number"))
        else:
            offset = int(p.value("number"))
    columns = [column_of(rows, c).alias(c) for c in chosen]
    rows = rows.orderBy(*order, "id") if order or limit is not None or offset else rows
    if distinct:
        rows = rows.select(*columns).distinct()
    rows = rows.offset(offset) if offset else rows
    rows = rows.limit(limit) if limit is not None else rows
    if distinct:
        return rows
    for name in with_:
        a, b = ("dst", "src") if name == "callers" else ("src", "dst")
        own = edges.filter(F.col("edge_class").isin(*traverse.EXECUTABLE)).groupBy(F.col(a).alias("id"), F.col(b).alias("end_")).agg(F.min("seq").alias("s"))
        first = own.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("s", "end_"))).filter(F.col("nth") <= RELATED)
        lists = first.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "end_"))), lambda x: x["end_"]).alias(name))
        rows = rows.join(lists, "id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return rows.select(*columns, *with_)


def run(s: CodeStructure, text: str) -> DataFrame:
    """The rows that a statement asks for."""
    p = _Parser(text)
    nodes, edges = s.nodes, s.edges
    verb = p.need("GET", "SEARCH", "GLOB", "METADATA", "IMPACT", "PATH", "FLOW", "STACK", "STATS", "CHECK", "LAYERS", "ENFORCE", "FIND", "AUDIT")
    if verb == "GET":
        distinct, chosen = p.take("DISTINCT"), []
        while p.at + 1 < len(p.tokens) and (p.tokens[p.at + 1][1] == "," or chosen and p.tokens[p.at - 1][1] == ","):
            chosen.append(COLUMNS.get(w := p.value("word"), w))
            p.take(",")
        if p.at + 1 < len(p.tokens) and p.tokens[p.at][0] == p.tokens[p.at + 1][0] == "word" and not {p.tokens[p.at + 1][1].upper()} & {"WHERE", "WITH", "ORDER", "LIMIT", "OFFSET"}:
            chosen.append(COLUMNS.get(w := p.value("word"), w))
        return _tail(p, _of_kind(nodes, p.kind()), chosen or PLAIN, distinct, edges)
    if verb == "SEARCH":
        what = p.tokens[p.at][0] if p.at < len(p.tokens) else ""
        given = p.value("text", "regex", "word")
        p.need("IN")
        rows = _of_kind(nodes, p.kind())
        near = F.concat_ws("\n", "name", "signature", "preview")
        found = near.rlike(_pattern(given)) if what == "regex" else F.contains(F.lower("name"), F.lit(given.lower()))
        return _tail(p, rows.filter(found), PLAIN, False, edges)
    if verb == "GLOB":
        pattern = glob_regex(p.value("text"))
        return _tail(p, nodes.filter((F.col("kind") == "File") & F.col("file").rlike(pattern)), ["file", "end"], False, edges)
    if verb == "METADATA":
        p.need("FOR")
        id_ = p.value("text")
        p.end()
        own = nodes.filter(F.col("id") == id_)
        every = [F.struct(F.lit(c).alias("key"), (F.array_join(c, ",") if c in LISTS else F.col(c).cast("string")).alias("value")) for c in own.columns]
        return own.select(F.explode(F.array(*every)).alias("m")).select("m.*").filter("value IS NOT NULL AND value <> ''")
    if verb == "IMPACT":
        p.need("OF")
        id_, direction, depth = p.value("text"), "callers", 2
        if p.take("DIRECTION"):
            direction = p.need("CALLERS", "CALLEES").lower()
        if p.take("DEPTH"):
            depth = int(p.value("number"))
        p.end()
        return traverse.bfs(s.steps, nodes.sparkSession.createDataFrame([(id_,)], "node string"), max(1, depth), direction)
    if verb == "PATH":
        p.need("FROM")
        a = p.value("text")
        p.need("TO")
        b = p.value("text")
        p.end()
        way = traverse.shortest_path(s.steps, a, b)
        return nodes.sparkSession.createDataFrame(list(enumerate(way)), "nth int, node string")
    if verb == "FLOW":
        p.need("FOR")
        id_, depth = p.value("text"), int(p.value("number")) if p.take("DEPTH") else 3
        p.end()
        return flow(edges, id_, depth)
    if verb == "STACK":
        p.need("FOR")
        url = p.value("text")
        p.end()
        return stack(nodes, edges, url)
    if verb == "STATS":
        path = p.value("text") if p.take("FOR") else "."
        p.end()
        inside = nodes.filter(is_under(F.col("file"), path.rstrip("/") or "."))
        ends = inside.select("id")
        links = edges.join(ends.withColumnRenamed("id", "src"), "src", "left_semi")
        counted = inside.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("nodes "), "kind").alias("what"), "n")
        return counted.union(links.groupBy("edge_class").count().select(F.concat(F.lit("edges "), "edge_class"), "count"))
    if verb == "CHECK":
        p.need("LAYERS")
        a = p.value("text")
        p.need("AGAINST")
        b = p.value("text")
        p.end()
        return crossings(nodes, edges, is_under(F.col("file"), a), is_under(F.col("file"), b))
    if verb == "LAYERS":
        p.need("OF")
        path = p.value("text")
        p.end()
        return dependencies_of(nodes, edges, path)
    if verb == "ENFORCE":
        rule, scope = p.value("text"), p.value("text") if p.take("IN") else "."
        p.end()
        m = re.fullmatch(r"\s*(\S+)\s+MUST_NOT_(IMPORT|CALL)\s+(\S+)\s*", rule)
        if not m:
            raise QueryError(f"no rule {rule!r}")
        part = lambda name: F.array_contains(F.split(F.regexp_replace("file", r"\.\w+$", ""), "/"), name)
        found = crossings(nodes, edges, part(m[1]) & is_under(F.col("file"), scope), part(m[3]))
        return found.filter(F.col("how") == m[2].lower())
    if verb == "FIND":
        how = p.need("IMPLEMENTS", "DECORATED")
        p.take("WITH")
        name = p.value("text")
        p.end()
        lists, kind = ("base_classes", nodes.filter("kind = 'Class'")) if how == "IMPLEMENTS" else ("decorators", nodes)
        return kind.filter(F.exists(lists, lambda x: (x == name) | (last_segment(x) == name))).select(*PLAIN)
    p.need("TENANT")
    parameter, scope = p.value("text"), p.value("text") if p.take("IN") else "."
    p.end()
    own = nodes.filter((F.col("kind") == "Function") & is_under(F.col("file"), scope) & F.exists("calls", lambda x: F.contains(x, F.lit(".objects."))))
    return own.filter(~F.coalesce(F.col("signature").rlike(rf"\b{re.escape(parameter)}\b"), F.lit(False))).select(*PLAIN)


def flow(edges: DataFrame, start: str, depth: int) -> DataFrame:
    """nth, depth, node: the calls below a node as a tree, depth first, in the order of the calls.

    A node that lies above itself isn't entered again. The first REACHED rows are given; a walk ends where a level has none.
    """
    steps = edges.filter(F.col("edge_class").isin(*traverse.EXECUTABLE)).groupBy("src", "dst").agg(F.min("seq").alias("seq"))
    steps = steps.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy("seq", "dst"))).filter(F.col("place") <= REACHED).drop("seq")
    steps = cut(steps)
    level = edges.sparkSession.createDataFrame([(start, [start], [])], "node string, above array<string>, key array<int>")
    every = level
    for _ in range(depth):
        level = level.join(steps, F.col("node") == F.col("src")).filter(~F.array_contains("above", F.col("dst")))
        level = level.select(F.col("dst").alias("node"), F.concat("above", F.array("dst")).alias("above"), F.concat("key", F.array("place")).alias("key")).orderBy("key").limit(REACHED)
        level = cut(level)
        if level.isEmpty():
            break
        every = cut(every.unionByName(level).orderBy("key").limit(REACHED))
    first = every.orderBy("key").limit(REACHED)
    return first.select((F.row_number().over(Window.orderBy("key")) - 1).alias("nth"), F.size("key").alias("depth"), "node")


def stack(nodes: DataFrame, edges: DataFrame, url: str) -> DataFrame:
    """layer, node: who calls a URL, its routes, what handles them, and what that calls."""
    wanted = normalize_url(F.lit(url))
    routes = nodes.filter("kind = 'Route'").filter(normalize_url(F.coalesce("full_url", "url")) == wanted).select(F.col("id").alias("node"))
    calls = edges.filter(F.col("edge_class").isin(*traverse.EXECUTABLE))
    middleware = nodes.filter("kind = 'Middleware'").select(F.col("id").alias("node"))
    into = calls.join(routes.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
    handlers = calls.join(routes.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
    below = calls.join(handlers.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
    layers = [("caller", into.join(middleware, "node", "left_anti")), ("middleware", into.join(middleware, "node", "left_semi")), ("route", routes), ("handler", handlers), ("callee", below)]
    out = None
    for name, rows in layers:
        one = rows.select(F.lit(name).alias("layer"), "node")
        out = one if out is None else out.union(one)
    return out


def crossings(nodes: DataFrame, edges: DataFrame, here: Column, there: Column) -> DataFrame:
    """how (import or call), src, dst: where files or symbols of one side use those of the other."""
    a = nodes.filter(here).select("id", F.col("kind").alias("kind"))
    b = nodes.filter(there).select("id", F.col("kind").alias("kind"))
    calls = edges.filter(F.col("edge_class").isin(*traverse.EXECUTABLE)).select("src", "dst")
    imports = edges.filter("edge_class = 'structural'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))  # an imported file points to its importer
    one = calls.join(a.select(F.col("id").alias("src")), "src", "left_semi").join(b.select(F.col("id").alias("dst")), "dst", "left_semi")
    files = lambda x, name: x.filter("kind = 'File'").select(F.col("id").alias(name))
    two = imports.join(files(a, "src"), "src", "left_semi").join(files(b, "dst"), "dst", "left_semi")
    return two.select(F.lit("import").alias("how"), "src", "dst").union(one.select(F.lit("call"), "src", "dst")).distinct()


def dependencies_of(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """file, module, category: what the files below a path import: project, stdlib or third-party."""
    text = nodes.filter((F.col("kind") == "File") & is_under(F.col("file"), path)).select("file", F.explode("imports").alias("text"))
    python = F.endswith("file", F.lit(".py"))
    module = F.when(python, F.regexp_extract("text", r"^(?:from|import)\s+([\w.]+)", 1)).otherwise(F.col("text"))
    rows = text.select("file", module.alias("module"), python.alias("python")).distinct()
    root = F.split("module", r"\.")[0]
    roots = nodes.filter("kind IN ('File', 'Folder')").select(F.regexp_replace(F.element_at(F.split("id", "/"), -1), r"\.py$", "").alias("root")).distinct().withColumn("own", F.lit(True))
    known = rows.withColumn("root", root).join(roots, "root", "left")
    mine = F.startswith("module", F.lit(".")) | (F.col("python") & F.coalesce("own", F.lit(False)))
    standard = F.col("python") & F.col("root").isin(*sorted(sys.stdlib_module_names))
    return known.select("file", "module", F.when(mine, "project").when(standard, "stdlib").otherwise("third-party").alias("category"))
