"""Facts of one Python file: definitions, imports, routes, and what each call refers to.

Names are looked up as far as one file can tell: a call becomes a reference to a definition of the file,
to a symbol of a module, or to a method of a class that is one of those. What stays open (which file a
module is, which class of a chain has the method) is settled later by joins over all files. A name whose
meaning isn't certain gives no reference.
"""

from __future__ import annotations

import ast
import os
import re
from dataclasses import dataclass, field

from loomgraph.sources.frameworks import frameworks_of, of_route
from loomgraph.sources.languages import Languages
from loomgraph.sources.script_facts import PREVIEW, anonymous, script_facts, shown_return

METHODS = ("get", "post", "put", "patch", "delete", "head", "options")
WRAPPED_BY = ("middleware", "before_request", "after_request")
RELATIONS = ("ForeignKey", "OneToOneField", "ManyToManyField")


@dataclass
class Scope:
    """A function, class or the module: what its names are bound to. None: bound to something unknown."""

    kind: str
    qualified: str
    up: "Scope | None"
    names: dict[str, object] = field(default_factory=dict)  # ('def', qualified) | ('class', qualified) | ('import', [bindings]) | ('type', ref) | None
    free: set[str] = field(default_factory=set)  # global and nonlocal
    attributes: dict[str, object] = field(default_factory=dict)  # of a class: self.x to a type reference or None
    bases: list = field(default_factory=list)


def dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and (head := dotted(node.value)):
        return f"{head}.{node.attr}"
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "super" and not node.args:
        return "super"
    return None


def literal(node: ast.AST | None) -> str | None:
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return node.value
    if isinstance(node, ast.JoinedStr):
        return next((v.value for v in node.values if isinstance(v, ast.Constant)), "")
    return None


def module_path(module: str | None, level: int, file: str) -> str:
    """A module as a path; a leading ./ marks one that is relative to the workspace, not to be searched for."""
    tail = (module or "").replace(".", "/")
    if not level:
        return tail
    folder = file.split("/")[:-1]
    folder = folder[: len(folder) - (level - 1)] if level > 1 else folder
    return "./" + "/".join([*folder, *filter(None, [tail])])


class Extractor:
    def __init__(self, source: str, file: str):
        self.source, self.file, self.lines = source, file, source.split("\n")
        self.definitions, self.imports, self.references, self.routes, self.relations, self.base_refs = [], [], [], [], [], []
        self.prefixes: dict[str, str] = {}
        self.tree = ast.parse(source)
        self.module = Scope("module", "", None)
        self._bind(self.tree.body, self.module)
        self._visit(self.tree.body, self.module, None)
        self.mounts: list[dict] = []
        self.middleware: list[dict] = []
        for statement in self.tree.body:
            self._url_patterns(statement)
        self._mounts()
        self._middleware()
        self._calls_of(self.tree, self.module, None, [s for s in self.tree.body if not isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))])

    # names

    def _own(self, body, kinds):
        """Nodes of a scope in source order, without the bodies of definitions within it."""
        stack = list(body)[::-1]
        while stack:
            node = stack.pop()
            if isinstance(node, kinds):
                yield node
            if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
                stack += list(ast.iter_child_nodes(node))[::-1]

    def _set(self, scope: Scope, name: str, value: object) -> None:
        """Binds a name; a second, different binding leaves its meaning open, unless both are imports."""
        if name in scope.free:
            return
        old = scope.names.get(name, value)
        if isinstance(old, tuple) and isinstance(value, tuple) and old[0] == value[0] == "import" and old is not value:
            value = ("import", old[1] + [b for b in value[1] if b not in old[1]])
        elif name in scope.names and old != value:
            value = None if not (isinstance(value, tuple) and isinstance(old, tuple) and old[0] in ("def", "class") and value[0] == old[0]) else value
        scope.names[name] = value

    def _targets(self, node):
        for n in ast.walk(node):
            if isinstance(n, ast.Name) and isinstance(n.ctx, (ast.Store, ast.Del)):
                yield n.id

    def _bind(self, body, scope: Scope) -> None:
        for node in self._own(body, (ast.Global, ast.Nonlocal)):
            scope.free |= set(node.names)
        kinds = (ast.Import, ast.ImportFrom, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Assign, ast.AnnAssign, ast.AugAssign, ast.For, ast.AsyncFor, ast.withitem, ast.ExceptHandler, ast.NamedExpr, ast.Delete, ast.MatchAs)
        path = lambda name: f"{scope.qualified}.{name}" if scope.qualified else name
        for node in self._own(body, kinds):
            if isinstance(node, ast.Import):
                for a in node.names:
                    if a.asname:
                        self._set(scope, a.asname, ("import", [{"module": module_path(a.name, 0, self.file), "symbol": None, "qualifier": None}]))
                    else:
                        self._set(scope, a.name.split(".")[0], ("import", [{"module": module_path(a.name, 0, self.file), "symbol": None, "qualifier": a.name}]))
            elif isinstance(node, ast.ImportFrom):
                for a in node.names:
                    self._set(scope, a.asname or a.name, ("import", [{"module": module_path(node.module, node.level, self.file), "symbol": a.name, "qualifier": None}]))
            elif isinstance(node, ast.ClassDef):
                self._set(scope, node.name, ("class", path(node.name)))
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self._set(scope, node.name, ("def", path(node.name)))
            elif isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name):
                if scope.kind != "class":
                    self._set(scope, node.target.id, ("type", ("annotation", node.annotation)))
            elif isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
                if scope.kind != "class":
                    self._set(scope, node.targets[0].id, ("type", ("value", node.value)) if self._constructs(node.value) else None)
            elif isinstance(node, ast.ExceptHandler):
                if node.name:
                    self._set(scope, node.name, None)
            elif isinstance(node, ast.MatchAs):
                if node.name:
                    self._set(scope, node.name, None)
            elif scope.kind != "class":
                target = node.optional_vars if isinstance(node, ast.withitem) else getattr(node, "target", node)
                for name in self._targets(target) if target is not None else ():
                    self._set(scope, name, None)

    @staticmethod
    def _constructs(value) -> bool:
        name = dotted(value.func) if isinstance(value, ast.Call) else None
        return bool(name) and name.rsplit(".", 1)[-1][:1].isupper()

    def _parameters(self, node, scope: Scope, cls: Scope | None) -> None:
        a = node.args
        decorators = {dotted(d) for d in node.decorator_list}
        every = [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]
        for i, p in enumerate(every):
            if p.annotation is not None and p not in (a.vararg, a.kwarg):
                scope.names[p.arg] = ("type", ("annotation", p.annotation))
            elif cls is not None and i == 0 and "staticmethod" not in decorators:
                scope.names[p.arg] = ("self", cls)
            else:
                scope.names[p.arg] = None

    def _find(self, scope: Scope, name: str) -> tuple[object, Scope] | None:
        """The binding that a name has in a scope; names of classes are seen from within the class body only."""
        at, first = scope, True
        while at is not None:
            if name in at.names and (first or at.kind != "class"):
                return at.names[name], at
            at, first = at.up, False
        return None

    # references: ('local', qualified) | ('symbol', module, symbol) | None

    def _module_symbol(self, bindings: list[dict], name: str) -> tuple | None:
        """What a dotted name means under import bindings of its first part; None unless exactly one fits."""
        found = set()
        for b in bindings:
            if b["symbol"] is not None:
                rest = name.split(".")[1:]
                found.add(("symbol", b["module"], ".".join([b["symbol"], *rest])))
            elif b["qualifier"]:
                if name.startswith(b["qualifier"] + "."):
                    found.add(("symbol", b["module"], name[len(b["qualifier"]) + 1 :]))
            else:
                rest = name.split(".", 1)
                if len(rest) == 2:
                    found.add(("symbol", b["module"], rest[1]))
        return found.pop() if len(found) == 1 else None

    def _class_ref(self, node, scope: Scope) -> tuple | None:
        """The class that an expression names."""
        name = dotted(node)
        got = self._find(scope, name.split(".")[0]) if name else None
        if not got or not isinstance(got[0], tuple):
            return None
        kind, value = got[0][0], got[0][1]
        if kind == "class":
            return ("local", ".".join([value, *name.split(".")[1:]]))
        return self._module_symbol(value, name) if kind == "import" else None

    def _annotated(self, node, scope: Scope) -> tuple | None:
        """The one class that an annotation allows, besides None."""
        if isinstance(node, ast.Constant) and isinstance(node.value, str):
            try:
                return self._annotated(ast.parse(node.value, mode="eval").body, scope)
            except SyntaxError:
                return None
        if isinstance(node, ast.Subscript):
            head = (dotted(node.value) or "").rsplit(".", 1)[-1]
            inner = node.slice.elts if isinstance(node.slice, ast.Tuple) else [node.slice]
            if head in ("Optional", "ClassVar", "Final", "Annotated"):
                return self._annotated(inner[0], scope)
            if head == "Union":
                return self._one([x for x in inner if not self._none(x)], scope)
            return None
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):
            return self._one([x for x in (node.left, node.right) if not self._none(x)], scope)
        return self._class_ref(node, scope)

    def _one(self, nodes, scope: Scope) -> tuple | None:
        return self._annotated(nodes[0], scope) if len(nodes) == 1 else None

    @staticmethod
    def _none(node) -> bool:
        return isinstance(node, ast.Constant) and node.value is None

    def _type(self, binding: object, scope: Scope) -> tuple | None:
        if not isinstance(binding, tuple):
            return None
        if binding[0] == "self":
            return ("local", binding[1].qualified)
        if binding[0] == "type":
            how, node = binding[1]
            return self._annotated(node, scope) if how == "annotation" else self._class_ref(node.func, scope)
        return None

    def _enclosing_class(self, scope: Scope) -> Scope | None:
        while scope is not None and scope.kind != "class":
            scope = scope.up
        return scope

    def resolve(self, call: str, scope: Scope) -> dict | None:
        """A call's text to a reference, or None if its meaning isn't certain."""
        parts = call.split(".")
        make = lambda kind, ref=None, member=None: {"kind": kind, "module": ref[1] if ref and ref[0] == "symbol" else None, "symbol": ref[-1] if ref else None, "member": member}
        if parts[0] == "super":
            cls = self._enclosing_class(scope)
            return make("super", ("local", cls.qualified), parts[1]) if cls is not None and len(parts) == 2 else None
        got = self._find(scope, parts[0])
        if got is None or got[0] is None:
            return None
        binding, owner = got
        kind = binding[0]
        if kind in ("def", "class"):
            if len(parts) == 1:
                return make("name", ("local", binding[1]))
            return make("member", ("local", binding[1]), parts[1]) if kind == "class" and len(parts) == 2 else None
        if kind == "import":
            ref = self._module_symbol(binding[1], call)
            return make("name", ref) if ref else None
        if kind == "self" and len(parts) == 3:
            ref = binding[1].attributes.get(parts[1])
            return make("member", ref, parts[2]) if ref else None
        ref = self._type(binding, owner)
        return make("member", ref, parts[1]) if ref and len(parts) == 2 else None

    # definitions

    def _visit(self, body, scope: Scope, cls: Scope | None, nested: bool = False) -> None:
        """Definitions directly in a body; within functions also those under if, for, with and try."""
        found = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
        for node in self._own(body, found) if nested else [n for n in body if isinstance(n, found)]:
            qualified = f"{scope.qualified}.{node.name}" if scope.qualified else node.name
            if isinstance(node, ast.ClassDef):
                self._class(node, scope, qualified)
            else:
                self._function(node, scope, qualified, cls)

    def _common(self, node, scope: Scope, qualified: str, kind: str) -> dict:
        start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        head = "\n".join(self.lines[node.lineno - 1 : node.body[0].lineno])
        first = node.body[0]
        stop = (first.lineno, first.col_offset) if first.lineno != node.lineno else None
        text = "\n".join(self.lines[node.lineno - 1 : first.lineno - 1]) if stop else head[: first.col_offset]
        signature = re.sub(r"\s+", " ", re.sub(r"#[^\n]*", "", text)).strip().rstrip(" :\n")
        doc = ast.get_docstring(node) or ""
        decorators = [d for d in (dotted(x.func if isinstance(x, ast.Call) else x) for x in node.decorator_list) if d]
        return {
            "qualified": qualified, "name": node.name, "kind": kind, "parent": scope.qualified or None, "start": start, "end": node.end_lineno, "signature": signature,
            "docstring": next((x.strip() for x in doc.splitlines() if x.strip()), None), "decorators": decorators, "base_classes": [], "calls": [], "returns": [],
            "preview": "\n".join(self.lines[start - 1 : node.end_lineno])[:PREVIEW],
            "is_async": False, "is_generator": False, "is_exported": not node.name.startswith("_") or (node.name.startswith("__") and node.name.endswith("__")), "param_count": None,
        }

    def _class(self, node: ast.ClassDef, scope: Scope, qualified: str) -> None:
        fact, own = self._common(node, scope, qualified, "Class"), Scope("class", qualified, scope)
        fact["base_classes"] = [b for b in (dotted(x) for x in node.bases) if b and b != "object"]
        self.definitions.append(fact)
        for i, base in enumerate(node.bases):
            ref = self._class_ref(base, scope)
            if ref:
                self.base_refs.append({"child": qualified, "ord": i, "module": ref[1] if ref[0] == "symbol" else None, "symbol": ref[-1]})
        self._bind(node.body, own)
        self._attributes(node, own)
        for s in node.body:
            value = getattr(s, "value", None)
            if isinstance(value, ast.Call) and (name := dotted(value.func)) and name.rsplit(".", 1)[-1] in RELATIONS and value.args:
                model = literal(value.args[0]) or dotted(value.args[0])
                if model:
                    self.relations.append({"owner": qualified, "type": name.rsplit(".", 1)[-1], "model": model.rsplit(".", 1)[-1]})
        self._visit(node.body, own, own)

    def _attributes(self, node: ast.ClassDef, own: Scope) -> None:
        """Types of self.x, from annotations of the class and assignments in its methods; conflicts stay open."""
        found: dict[str, set] = {}
        for s in node.body:
            if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name):
                found.setdefault(s.target.id, set()).add(self._annotated(s.annotation, own))
        for method in (m for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)) and m.args.args):
            inner = Scope("function", own.qualified + "." + method.name, own)
            self._parameters(method, inner, own)
            me = method.args.args[0].arg
            for s in self._own(method.body, (ast.Assign, ast.AnnAssign)):
                for t in s.targets if isinstance(s, ast.Assign) else [s.target]:
                    if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == me:
                        if isinstance(s, ast.AnnAssign):
                            ref = self._annotated(s.annotation, inner)
                        elif self._constructs(s.value):
                            ref = self._class_ref(s.value.func, inner)
                        else:
                            ref = self._type(inner.names.get(s.value.id), inner) if isinstance(s.value, ast.Name) else None
                        found.setdefault(t.attr, set()).add(ref)
        own.attributes = {k: next(iter(v)) if len(v) == 1 else None for k, v in found.items()}

    def _function(self, node, scope: Scope, qualified: str, cls: Scope | None) -> None:
        fact, own = self._common(node, scope, qualified, "Function"), Scope("function", qualified, scope)
        a = node.args
        names = [p.arg for p in (*a.posonlyargs, *a.args, *a.kwonlyargs)]
        stars = bool(a.vararg) + bool(a.kwarg) + (bool(a.kwonlyargs) and not a.vararg) + bool(a.posonlyargs)
        fact["param_count"] = len([n for n in names if n not in ("self", "cls")]) + stars
        fact["is_async"] = isinstance(node, ast.AsyncFunctionDef)
        fact["is_generator"] = any(True for _ in self._own(node.body, (ast.Yield, ast.YieldFrom)))
        fact["returns"] = list(dict.fromkeys(shown_return(self._source(r)) for r in self._own(node.body, ast.Return)))
        self.definitions.append(fact)
        self._parameters(node, own, cls)
        parameters = dict(own.names)
        self._bind(node.body, own)
        for name, value in parameters.items():  # assigned parameters have no certain type any more
            if own.names.get(name) is not value and own.names.get(name) != value:
                own.names[name] = None
        self._calls_of(node, own, fact, node.body)
        self._routes_of(node, qualified)
        self._visit(node.body, own, None, nested=True)

    def _calls_of(self, node, scope: Scope, fact: dict | None, body) -> None:
        seen = []
        for call in self._in_order(body):
            name = dotted(call.func)
            if not name or name == "super" or name in seen:
                continue
            seen.append(name)
            ref = self.resolve(name, scope)
            if ref and fact is not None:
                self.references.append({"caller": fact["qualified"], "call": name, "seq": len(seen), **ref})
        if fact is not None:
            fact["calls"] = seen

    def _in_order(self, body):
        stack = list(body)[::-1]
        while stack:
            node = stack.pop()
            if isinstance(node, ast.Call):
                yield node
            if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                stack += list(ast.iter_child_nodes(node))[::-1]

    def _source(self, node) -> str:
        """The text of a node; columns count bytes."""
        part = [x.encode() for x in self.lines[node.lineno - 1 : node.end_lineno]]
        part[-1] = part[-1][: node.end_col_offset]
        part[0] = part[0][node.col_offset :]
        return b"\n".join(part).decode("utf-8", "replace")

    # routes and imports

    def _middleware(self) -> None:
        """Functions around requests: registered by a call, by a decorator, or named in a list of settings."""
        add = lambda name, var, kind, line: self.middleware.append({"name": name, "var": var, "kind": kind, "line": line})
        used = {id(s.value) for s in ast.walk(self.tree) if isinstance(s, (ast.Assign, ast.AnnAssign, ast.AugAssign))}
        for node in ast.walk(self.tree):
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                for d in node.decorator_list:
                    used.add(id(d))
                    name = dotted(d.func) if isinstance(d, ast.Call) else None
                    if name and name.count(".") == 1 and name.split(".")[1].lower() in WRAPPED_BY:
                        add(node.name, name.split(".")[0], "decorator", min(x.lineno for x in node.decorator_list))
            elif isinstance(node, ast.Call) and id(node) not in used:
                name = dotted(node.func)
                if name and name.count(".") == 1 and name.split(".")[1].lower() == "add_middleware":
                    given = next((a for a in node.args if isinstance(a, (ast.Name, ast.Lambda, ast.Call))), None)
                    handler = given.id if isinstance(given, ast.Name) else dotted(given.func) if isinstance(given, ast.Call) else anonymous("middleware", self.file, given.lineno) if given else None
                    if handler:
                        add(handler, name.split(".")[0], "call", node.lineno)
            elif isinstance(node, ast.Assign) and isinstance(node.targets[0], ast.Name) and node.targets[0].id.upper().startswith("MIDDLEWARE") and isinstance(node.value, ast.List):
                for item in node.value.elts:
                    if literal(item):
                        add(literal(item), "MIDDLEWARE", "declarative", item.lineno)

    def _routes_of(self, node, qualified: str) -> None:
        for d in node.decorator_list:
            name = dotted(d.func) if isinstance(d, ast.Call) else None
            if not name or "." not in name:
                continue
            var, verb = name.rsplit(".", 1)
            url = literal(d.args[0]) if d.args else next((literal(k.value) for k in d.keywords if k.arg in ("path", "rule")), None)
            if url is None or verb not in (*METHODS, "route", "api_route"):
                continue
            methods = [verb.upper()] if verb in METHODS else [m for k in d.keywords if k.arg == "methods" and isinstance(k.value, (ast.List, ast.Tuple)) for m in map(literal, k.value.elts) if m]
            self.routes.append({"url": self._prefix(var) + url, "methods": methods or ["GET"], "handler": qualified, "line": node.lineno, "kind": "decorator", "var": var})

    def _prefix(self, var: str) -> str:
        if not self.prefixes:
            self.prefixes[""] = ""
            for s in self.tree.body:
                if isinstance(s, ast.Assign) and isinstance(s.value, ast.Call) and (dotted(s.value.func) or "").rsplit(".", 1)[-1] in ("APIRouter", "Router", "DefaultRouter", "Blueprint"):
                    for k in s.value.keywords:
                        if k.arg in ("prefix", "url_prefix") and literal(k.value):
                            self.prefixes |= {t.id: literal(k.value) for t in s.targets if isinstance(t, ast.Name)}
        return self.prefixes.get(var, "")

    def _url_patterns(self, statement) -> None:
        if not isinstance(statement, (ast.Assign, ast.AugAssign)):
            return
        targets = statement.targets if isinstance(statement, ast.Assign) else [statement.target]
        if not any(isinstance(t, ast.Name) and t.id == "urlpatterns" for t in targets):
            return
        for call in (n for n in ast.walk(statement.value) if isinstance(n, ast.Call)):
            if dotted(call.func) in ("path", "re_path", "url") and len(call.args) >= 2 and literal(call.args[0]) is not None:
                view = call.args[1]
                if isinstance(view, ast.Call) and dotted(view.func) == "include":
                    handler = "include:" + (literal(view.args[0]) or dotted(view.args[0]) or "") if view.args else "include:"
                else:
                    handler = dotted(view.func.value) if isinstance(view, ast.Call) and isinstance(view.func, ast.Attribute) and view.func.attr == "as_view" else dotted(view)
                self.routes.append({"url": literal(call.args[0]) or "/", "methods": [], "handler": handler, "line": call.lineno, "kind": "pattern", "var": "urlpatterns"})
                if handler and handler.startswith("include:"):
                    self.mounts.append({"prefix": literal(call.args[0]) or "/", "module": module_path(handler[8:], 0, self.file), "symbol": "urlpatterns", "parent": "urlpatterns"})

    def _mounts(self) -> None:
        """Routers that are mounted under a prefix: by a call on an application or another router."""
        for call in (n for n in ast.walk(self.tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr in ("include_router", "register_blueprint")):
            prefix = next((literal(k.value) for k in call.keywords if k.arg in ("prefix", "url_prefix")), None)
            name = dotted(call.args[0]) if call.args else None
            got = self._find(self.module, name.split(".")[0]) if name else None
            if not prefix or not name:
                continue
            ref = self._module_symbol(got[0][1], name) if got and isinstance(got[0], tuple) and got[0][0] == "import" else None
            if ref:
                self.mounts.append({"prefix": prefix, "module": ref[1], "symbol": ref[2], "parent": dotted(call.func.value)})
            elif "." not in name:
                self.mounts.append({"prefix": prefix, "module": None, "symbol": name, "parent": dotted(call.func.value)})

    def import_facts(self) -> list[dict]:
        out = []
        for node in ast.walk(self.tree):
            if isinstance(node, ast.Import):
                for a in node.names:
                    out.append({"module": module_path(a.name, 0, self.file), "symbol": None, "text": ast.unparse(node), "line": node.lineno, "alias": None})
            elif isinstance(node, ast.ImportFrom):
                for a in node.names:
                    out.append({"module": module_path(node.module, node.level, self.file), "symbol": a.name, "text": ast.unparse(node), "line": node.lineno, "alias": (a.asname or a.name) if node in self.tree.body else None})
        return out


def outline(source: str) -> list[dict]:
    """Definitions of a file that Python can't parse, by line and indentation; no calls, no scopes."""
    out, lines = [], source.split("\n")
    stack: list[tuple[int, str]] = []
    for i, line in enumerate(lines):
        m = re.match(r"(\s*)(async\s+def|def|class)\s+(\w+)", line)
        if not m:
            continue
        depth = len(m[1].expandtabs())
        stack = [s for s in stack if s[0] < depth]
        qualified = ".".join([*(s[1] for s in stack), m[3]])
        end = next((j for j in range(i + 1, len(lines)) if lines[j].strip() and len(lines[j].expandtabs()) - len(lines[j].expandtabs().lstrip()) <= depth), len(lines))
        while end > i + 1 and not lines[end - 1].strip():
            end -= 1
        out.append({"qualified": qualified, "name": m[3], "kind": "Class" if m[2] == "class" else "Function", "parent": qualified.rpartition(".")[0] or None, "start": i + 1, "end": end, "signature": line.strip().rstrip(" :"), "docstring": None, "decorators": [], "base_classes": [], "calls": [], "returns": [], "preview": "\n".join(lines[i:end])[:PREVIEW], "is_async": m[2].startswith("async"), "is_generator": False, "is_exported": not m[3].startswith("_"), "param_count": None})
        stack.append((depth, m[3]))
    return out


def parse_file(path: str, languages: Languages | None = None) -> dict:
    """The facts of one file on disk; FileNotFoundError and ValueError tell why there are none."""
    from loomgraph.sources.workspace import CODE, TEXT

    if not os.path.isfile(path):
        raise FileNotFoundError(path)
    if not path.endswith((*CODE, *TEXT, *(languages.extensions if languages else ()))):
        raise ValueError(f"Unsupported file extension: {os.path.splitext(path)[1]}")
    with open(path, "rb") as f:
        return facts_of(path, f.read(), languages)


def facts_of(path: str, content: bytes, languages: Languages | None = None) -> dict:
    """All facts of one file; for files that hold no code only its lines. error tells what went wrong."""
    empty = {"path": path, "lines": 0, "error": None, "definitions": [], "imports": [], "references": [], "base_refs": [], "routes": [], "relations": [], "exports": [], "http": [], "mounts": [], "frameworks": [], "middleware": []}
    further = languages.reader(path) if languages else None
    if further:
        try:
            text = content.decode("utf-8")
            return empty | {"lines": text.count("\n") + bool(text and not text.endswith("\n"))} | further(path, text)
        except Exception as e:  # a reader's fault is that of one file
            return empty | {"error": f"{type(e).__name__}: {e}"}
    if path.endswith((".js", ".jsx", ".ts", ".tsx")):
        try:
            text = content.decode("utf-8")
        except UnicodeDecodeError as e:
            return empty | {"error": f"not UTF-8: {e.reason}"}
        return empty | {"lines": text.count("\n") + bool(text and not text.endswith("\n"))} | {"frameworks": frameworks_of(path, text)} | script_facts(path, text, frameworks_of(path, text))
    if not path.endswith(".py"):
        text = content.decode("utf-8", "ignore")
        return empty | {"lines": text.count("\n") + bool(text and not text.endswith("\n"))}
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError as e:
        return empty | {"error": f"not UTF-8: {e.reason}"}
    empty["lines"] = text.count("\n") + bool(text and not text.endswith("\n"))
    empty["frameworks"] = frameworks_of(path, text)
    try:
        x = Extractor(text, path)
    except (SyntaxError, ValueError, RecursionError) as e:
        return empty | {"error": f"{type(e).__name__}: {e}", "definitions": outline(text)}
    return empty | {"definitions": x.definitions, "imports": x.import_facts(), "references": x.references, "base_refs": x.base_refs, "routes": [r | {"framework": of_route(r["var"], r["url"], r["methods"], empty["frameworks"])} for r in x.routes], "relations": x.relations, "mounts": x.mounts, "middleware": x.middleware}
