"""Facts of one JavaScript or TypeScript file, with or without JSX: what python_facts gives for Python.

A tolerant reader: the text becomes tokens, brackets are paired, and only the constructs that carry facts
are recognised; anything else is stepped over to its closing bracket. Lines and columns of function
literals are exact, because ids contain them.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from loomgraph.sources.frameworks import of_route

TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)
    |(?P<word>[^\W\d][\w$]*|[$#@][\w$]*)
    |(?P<number>(?:0[xXbBoO][\da-fA-F_]+|\d[\d_]*\.?[\d_]*(?:[eE][+-]?\d+)?|\.\d+)n?)
    |(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')
    |(?P<mark>=>|\.\.\.|\?\.(?!\d)|[-+*/%&|^!=<>?~]+=?|[{}()\[\];,:.@#`\\"'])""",
    re.S | re.X,
)
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
PAIRS = {"(": ")", "[": "]", "{": "}"}
KEYWORDS = frozenset(
    "if for while switch catch return typeof await async new delete void throw case in of instanceof function class extends else do try finally "
    "const let var import export default yield super this with static get set public private protected readonly abstract declare enum interface type namespace".split()
)
WRAPPERS = ("memo", "forwardRef", "observer", "useCallback")
MODIFIERS = frozenset("public private protected readonly static override abstract async declare accessor get set".split())
HTTP_MARKS = ("Get", "Post", "Put", "Delete", "Patch", "Head", "Options")
#: Parts of the names of functions that send requests.
SENDERS = ("api", "fetch", "request", "http")
HTTP_NAMES = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")
BUILDER = re.compile(r"get\w*(?:[Uu]rl|[Pp]ath)")
PREVIEW = 150  # characters of a definition's own text that are kept
PRUNED = "return <JSX.Element /> (pruned)"
VERBS = ("get", "post", "put", "patch", "delete", "head", "options", "all")


def shown_return(text: str) -> str:
    """A return statement in one line; long ones are cut, and long ones with markup become a mark."""
    text = " ".join(text.split())
    return text if len(text) <= 120 else PRUNED if "<" in text and ">" in text else text[:117] + "..."


def anonymous(kind: str, file: str, line: int) -> str:
    """The name of an unnamed function in a file's last path component."""
    stem = file.rpartition("/")[2].replace(".", "_")
    return f"__anon__{kind}__{stem}__L{line}"


@dataclass
class Token:
    kind: str
    text: str
    line: int
    column: int


def tokens(text: str) -> list[Token]:
    out: list[Token] = []
    line, start = 1, 0

    def scan(at: int, end: int, closing: bool) -> int:
        """Reads from at; within a template's hole, up to its closing brace."""
        nonlocal line, start
        depth = 0
        while at < end:
            c, column = text[at], at - start
            last = out[-1] if out else None
            if c == "`":
                own, literal, at = Token("template", "", line, column), [], at + 1
                out.append(own)
                while at < end and text[at] != "`":
                    if text[at] == "\\":
                        literal.append(text[at : at + 2])
                        at += 2
                    elif text.startswith("${", at):
                        literal.append("${}")
                        out.append(Token("mark", ",", line, at - start))
                        out.append(Token("mark", "(", line, at - start))
                        at = scan(at + 2, end, True)
                        out.append(Token("mark", ")", line, at - start))
                    else:
                        if text[at] == "\n":
                            line, start = line + 1, at + 1
                        literal.append(text[at])
                        at += 1
                own.text, at = "".join(literal), at + 1
                continue
            if closing and c == "}" and not depth:
                return at + 1
            if c == "/" and text[at + 1 : at + 2] not in ("/", "*") and (last is None or last.kind == "mark" and last.text not in (")", "]", "}") or last.kind == "word" and last.text in KEYWORDS):
                m = REGEX.match(text, at, end)
                if m:
                    out.append(Token("regex", m[0], line, column))
                    at = m.end()
                    continue
            m = TOKEN.match(text, at, end)
            if not m:
                at += 1
                continue
            if m.lastgroup != "skip":
                depth += (m[0] == "{") - (m[0] == "}")
                out.append(Token(m.lastgroup, m[0], line, column))
            breaks = m[0].count("\n")
            if breaks:
                line, start = line + breaks, m.start() + m[0].rfind("\n") + 1
            at = m.end()
        return at

    scan(0, len(text), False)
    return out


@dataclass
class Scope:
    kind: str  # module, class, function
    qualified: str
    up: "Scope | None"
    names: dict[str, object] = field(default_factory=dict)
    attributes: dict[str, object] = field(default_factory=dict)
    lexical: bool = True  # whether `this` is that of the scope around it
    controller: str = ""  # the URL prefix of a class's routes


class Reader:
    def __init__(self, text: str, file: str):
        self.file, self.t, self.raw = file, tokens(text), text
        self.n = len(self.t)
        self.starts = [0]
        for line in text.split("\n"):
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.close: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.t):
            if t.kind == "mark" and t.text in PAIRS:
                stack.append(i)
            elif t.kind == "mark" and t.text in PAIRS.values():
                while stack and PAIRS[self.t[stack[-1]].text] != t.text:
                    self.close[stack.pop()] = i
                if stack:
                    self.close[stack.pop()] = i
        self.close |= {i: self.n for i in stack}
        self.definitions, self.imports, self.references, self.base_refs = [], [], [], []
        self.exports: list[dict] = []
        self.routes, self.http, self.mounts, self.middleware = [], [], [], []
        self.module = Scope("module", "", None)
        self.later: list = []
        self._statements(0, self.n, self.module, "")
        self._web()
        while self.later:  # bodies are read when all names of the scopes around them are known
            self.later.pop(0)()
        self._pages()
        exported = {e["local"] for e in self.exports if e["kind"] == "local"}
        for d in self.definitions:
            d["is_exported"] = d["qualified"] in exported

    # small steps

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < self.n and self.t[i].text in texts and self.t[i].kind in ("mark", "word")

    def word(self, i: int) -> str | None:
        return self.t[i].text if i < self.n and self.t[i].kind == "word" else None

    def string(self, i: int) -> str | None:
        if i < self.n and self.t[i].kind == "string":
            return self.t[i].text[1:-1]
        return self.t[i].text if i < self.n and self.t[i].kind == "template" else None

    def source(self, i: int, j: int) -> str:
        """The text of the tokens from i up to j, as it stands in the file."""
        at = lambda k: self.starts[self.t[k].line - 1] + self.t[k].column if k < self.n else len(self.raw)
        return self.raw[at(i) : at(j)].rstrip() if i < self.n else ""

    def marks(self, i: int) -> tuple[list[tuple[str, str | None]], int]:
        """Decorators from i on, with their names and first text, and where they end."""
        out = []
        while (self.word(i) or "").startswith("@"):
            name, k = self.t[i].text[1:], i + 1
            while self.is_(k, ".") and self.word(k + 1):
                name, k = f"{name}.{self.word(k + 1)}", k + 2
            text = self.string(k + 1) if self.is_(k, "(") else None
            out.append((name, text))
            i = self.after(k) if self.is_(k, "(") else k
        return out, i

    def after(self, i: int) -> int:
        return self.close.get(i, i) + 1

    def parts(self, i: int, j: int, by: str = ",") -> list[tuple[int, int]]:
        """The stretches between separators of the outermost level."""
        out, first = [], i
        while i < j:
            if self.is_(i, by):
                out.append((first, i))
                first = i + 1
            i = self.after(i) if i in self.close else i + 1
        return [*out, (first, j)] if first < j else out

    def base(self, source: str) -> str | None:
        """A relative module as a path of the workspace; None for packages."""
        if not source.startswith("."):
            return None
        path = posixpath.normpath(posixpath.join(posixpath.dirname(self.file), source))
        return None if path.startswith("..") else "script:" + path

    # function literals

    def literal(self, i: int) -> tuple[int, int, int, int, bool, bool] | None:
        """A function literal at i: where its parameters are, where its body is, whether it is an arrow, async."""
        asynchronous = self.is_(i, "async") and (self.is_(i + 1, "(", "function") or self.word(i + 1) is not None and self.is_(i + 2, "=>"))
        i += asynchronous
        if self.is_(i, "function"):
            i += 1
            while i < self.n and not self.is_(i, "("):
                i += 1
            return self._function_rest(i, asynchronous)
        if self.word(i) and self.word(i) not in KEYWORDS and self.is_(i + 1, "=>"):
            return (i, i + 1, *self._arrow_body(i + 2), True, asynchronous)
        if self.is_(i, "<"):  # type parameters
            i = self._angles(i)
        if self.is_(i, "("):
            end = self.after(i)
            k = end
            if self.is_(k, ":"):
                k = self._type_end(k + 1, "=>")
            if self.is_(k, "=>"):
                return (i + 1, end - 1, *self._arrow_body(k + 1), True, asynchronous)
        return None

    def _angles(self, i: int) -> int:
        depth = 0
        while i < self.n:
            if self.t[i].kind == "mark" and set(self.t[i].text) <= set("<>"):
                depth += self.t[i].text.count("<") - self.t[i].text.count(">")
            elif self.is_(i, ";", "{", ")"):
                return i
            i += 1
            if depth <= 0:
                return i
        return i

    def _type_end(self, i: int, *stops: str) -> int:
        """Behind a type annotation: at a stop of this level, or where no type can go on."""
        first = True
        while i < self.n and not (self.is_(i, *stops) and not (first and self.is_(i, "{"))):
            if self.is_(i, ";", ")", "]", "}") or self.is_(i, ",", "=") and "=>" not in stops:
                return i
            first = self.is_(i, "|", "&")
            i = self._type_arguments(i) if self.is_(i, "<") else self.after(i) if i in self.close else i + 1
        return i

    def _type_arguments(self, i: int) -> int:
        """Behind <...> in a type, where brackets of any kind may stand."""
        depth = 0
        while i < self.n and not self.is_(i, ";"):
            if self.t[i].kind == "mark" and set(self.t[i].text) <= {"<", ">"}:
                depth += self.t[i].text.count("<") - self.t[i].text.count(">")
                if depth <= 0:
                    return i + 1
            i = self.after(i) if i in self.close else i + 1
        return i

    def _arrow_body(self, i: int) -> tuple[int, int]:
        if self.is_(i, "{"):
            return i + 1, self.close.get(i, self.n)
        j = i
        while j < self.n and not self.is_(j, ",", ";", ")", "]", "}"):
            if j > i and self.t[j].line > self.t[j - 1].line and self.word(j) in ("const", "let", "var", "function", "class", "export", "import", "return", "if"):
                break
            j = self.after(j) if j in self.close else j + 1
        return i, j

    def _function_rest(self, i: int, asynchronous: bool):
        end = self.after(i)
        k = self._type_end(end + 1, "{", ";") if self.is_(end, ":") else end
        if not self.is_(k, "{"):
            return None
        return i + 1, end - 1, k + 1, self.close.get(k, self.n), False, asynchronous

    # statements

    def _statements(self, i: int, j: int, scope: Scope, prefix: str) -> None:
        exported = default = False
        marks: list = []
        while i < j:
            start, w = i, self.word(i)
            if w and w[0] == "@":
                marks, i = self.marks(i)
                continue
            if w == "import" and scope.kind == "module":
                i = self._import(i)
            elif w == "export" and scope.kind == "module" and not self.is_(i + 1, "="):
                got = self._export(i)
                if got is None:
                    exported, default, i = True, self.is_(i + 1, "default"), i + 1 + self.is_(i + 1, "default")
                    continue
                i = got
            elif w in ("declare", "abstract") and self.word(i + 1):
                i += 1
                continue
            elif w == "function" or w == "async" and self.is_(i + 1, "function"):
                i = self._declared_function(i, scope, prefix, exported, default)
            elif w == "class":
                i = self._class(i, scope, prefix, exported, default, marks)
            elif w in ("namespace", "module") and self.word(i + 1) and self.is_(i + 2, "{"):
                self._statements(i + 3, self.close.get(i + 2, j), scope, prefix + self.word(i + 1) + ".")
                i = self.after(i + 2)
            elif w in ("const", "let", "var") and not self.is_(i + 1, "enum"):
                i = self._variables(i, j, scope, prefix, exported)
            elif w in ("interface", "enum") or w == "type" and self.word(i + 1) and self.is_(i + 2, "=", "<"):
                i = self._skip(i, j)
            elif exported and default:
                i = self._default(i, j, scope)
            elif w == "module" and self.is_(i + 1, ".") and self.is_(i + 2, "exports") and self.is_(i + 3, "=") or w == "exports" and self.is_(i + 1, ".") and self.is_(i + 3, "="):
                i = self._commonjs(i, j)
            elif i in self.close and scope.kind == "function":
                self._statements(i + 1, self.close[i], scope, prefix)
                i = self.after(i)
            else:
                i = self.after(i) if i in self.close else i + 1
            exported, default, marks = False, False, []
            i = max(i, start + 1)

    def _skip(self, i: int, j: int) -> int:
        while i < j and not self.is_(i, ";"):
            if self.is_(i, "{"):
                return self.after(i)
            i = self.after(i) if i in self.close else i + 1
            if i < j and self.t[i].line > self.t[i - 1].line and self.word(i) in ("export", "const", "function", "class", "import", "let", "type", "interface"):
                return i
        return i + 1

    def _bind_import(self, local: str, source: str, imported: str, type_only: bool = False) -> None:
        self.module.names[local] = ("import", self.base(source), imported, type_only)

    def _import(self, i: int) -> int:
        line, k, types = self.t[i].line, i + 1, False
        if self.is_(k, "(", "."):
            return k
        if self.is_(k, "type") and not self.is_(k + 1, "from", ","):
            types, k = True, k + 1
        names: list[tuple[str, str, bool]] = []
        if self.string(k) is not None:
            self._imported(self.string(k), line)
            return k + 1
        while k < self.n and not self.is_(k, "from", "="):
            if self.is_(k, "{"):
                for a, b in self.parts(k + 1, self.close.get(k, self.n)):
                    only = self.is_(a, "type") and b - a > 1 and not self.is_(a + 1, "as")
                    a += only
                    names.append((self.t[b - 1].text, self.t[a].text, types or only))
                k = self.after(k)
            elif self.is_(k, "*"):
                names.append((self.word(k + 2) or "", "*", types))
                k += 3
            elif self.word(k):
                names.append((self.word(k), "default", types))
                k += 1
            else:
                k += 1
            if k < self.n and self.is_(k, ";"):
                return k
        if self.is_(k, "=") and self.is_(k + 1, "require"):
            source, end = self.string(k + 3), k + 5
            names = [(names[0][0], "*", types)] if names else []
        else:
            source, end = self.string(k + 1), k + 2
        if source is not None:
            self._imported(source, line)
            for local, name, only in names:
                self._bind_import(local, source, name, only)
        return end

    def _imported(self, source: str, line: int) -> None:
        base = self.base(source)
        self.imports.append({"module": base, "symbol": None, "text": source, "line": line, "alias": None})

    def _add_export(self, exported: str, kind: str, local=None, source=None, imported=None) -> None:
        self.exports.append({"exported": exported, "kind": kind, "local": local, "module": self.base(source) if source else None, "imported": imported, "source": source})

    def _export(self, i: int) -> int | None:
        k = i + 1 + (self.is_(i + 1, "type") and self.is_(i + 2, "{", "*"))
        if self.is_(k, "*"):
            name = self.word(k + 2) if self.is_(k + 1, "as") else None
            f = k + 3 if name else k + 1
            source = self.string(f + 1)
            if source is not None:
                self._imported(source, self.t[i].line)
                self._add_export(name or "*", "reexport" if name else "star", source=source, imported="*" if name else None)
            return f + 2
        if self.is_(k, "{"):
            end = self.after(k)
            source = self.string(end + 1) if self.is_(end, "from") else None
            if source is not None:
                self._imported(source, self.t[i].line)
            for a, b in self.parts(k + 1, end - 1):
                a += self.is_(a, "type") and b - a > 1 and not self.is_(a + 1, "as")
                name, out = self.t[a].text, self.t[b - 1].text
                if source is not None:
                    self._add_export(out, "reexport", source=source, imported=name)
                else:
                    self._add_export(out, "local", local=name)
            return end + 2 if source is not None else end
        return None

    def _default(self, i: int, j: int, scope: Scope) -> int:
        found = self._wrapped(i)
        if found:
            name = f"anonymous_L{self.t[i].line}"
            self._function(name, i, found, scope, name)
            self._add_export("default", "local", local=name)
            return found[3] + 1
        if self.word(i) and (self.is_(i + 1, ";") or i + 1 >= j or self.t[i + 1].line > self.t[i].line):
            self._add_export("default", "local", local=self.word(i))
        return i + 1

    def _commonjs(self, i: int, j: int) -> int:
        if self.is_(i, "exports"):
            if self.word(i + 4):
                self._add_export(self.word(i + 2), "local", local=self.word(i + 4))
            return i + 4
        k = i + 4
        self.exports = [e for e in self.exports if e["kind"] != "local" or e["exported"] == "default"]
        if self.is_(k, "{"):
            for a, b in self.parts(k + 1, self.close.get(k, j)):
                if self.word(a) and (b - a == 1 or self.is_(a + 1, ":") and b - a == 3 and self.word(a + 2)):
                    self._add_export(self.word(a), "local", local=self.word(b - 1))
            return self.after(k)
        if self.word(k):
            self._add_export("default", "local", local=self.word(k))
        return k + 1

    def _wrapped(self, i: int):
        """A function literal at i, or one that is the first argument of a known wrapper there."""
        found = self.literal(i)
        if found:
            return found
        k = i
        while self.word(k) and self.is_(k + 1, "."):
            k += 2
        if self.word(k) in WRAPPERS:
            k += 1
            k = self._angles(k) if self.is_(k, "<") else k
            if self.is_(k, "("):
                return self._wrapped(k + 1)
        return None

    def _type_name(self, i: int, j: int) -> str | None:
        """The one class that a type annotation names."""
        if i >= j or any(self.is_(k, "|", "&", "=>") for k in range(i, j)) or not self.word(i):
            return None
        name, k = self.word(i), i + 1
        while self.is_(k, ".") and k + 1 < j:
            name, k = f"{name}.{self.word(k + 1)}", k + 2
        return name if name[:1].isupper() or "." in name else None

    def _pattern(self, i: int, j: int) -> list[str]:
        """Names that a parameter or a destructuring binds."""
        if self.is_(i, "..."):
            i += 1
        if self.is_(i, "{", "["):
            end, out = self.close.get(i, j), []
            for a, b in self.parts(i + 1, end):
                cut = next((k for k in range(a, b) if self.is_(k, "=")), b)
                colon = next((k for k in range(a, cut) if self.is_(k, ":")), None) if self.is_(i, "{") else None
                out += self._pattern(a if colon is None else colon + 1, cut)
            return out
        return [self.word(i)] if self.word(i) else []

    def _parameters(self, i: int, j: int, own: Scope, cls: Scope | None = None) -> int:
        parts = self.parts(i, j)
        for a, b in parts:
            while self.is_(a, "@"):
                a = self.after(a + 2) if self.is_(a + 2, "(") else a + 2
            property_ = False
            while self.word(a) in MODIFIERS and self.word(a + 1):
                property_, a = True, a + 1
            end = next((k for k in range(a, b) if self.is_(k, "=")), b)
            colon = next((k for k in range(a, end) if self.is_(k, ":") and not (self.is_(a, "{", "[") and k < self.after(a))), None)
            kind = ("type", self._type_name(colon + 1, end)) if colon is not None else None
            for name in self._pattern(a, colon if colon is not None else end):
                own.names[name] = kind if kind and kind[1] and not self.is_(a, "{", "[") else None
                if property_ and cls is not None:
                    cls.attributes[name] = own.names[name]
        return len(parts)

    # definitions

    def _fact(self, name: str, qualified: str, kind: str, parent: str | None, i: int, j: int) -> dict:
        out = {"qualified": qualified, "name": name, "kind": kind, "parent": parent or None, "start": self.t[i].line, "end": self.t[min(max(j, i), self.n - 1)].line, "signature": None, "docstring": None, "decorators": [], "base_classes": [], "calls": [], "returns": [], "preview": self.source(i, j + 1)[:PREVIEW], "is_async": False, "is_generator": False, "is_exported": False, "param_count": None}
        self.definitions.append(out)
        return out

    def _text(self, i: int, j: int) -> str:
        out = ""
        for k in range(i, j):
            gap = k > i and not (self.t[k].text in (")", ",", ";", ":", ".", "]", "(", "?.") or self.t[k - 1].text in ("(", ".", "[", "...", "?."))
            out += " " * bool(gap) + self.t[k].text
        return out

    def _function(self, name: str, i: int, found, scope: Scope, qualified: str, cls: Scope | None = None, parent: str | None = None) -> Scope:
        a, b, body, end, arrow, asynchronous = found
        own = Scope("function", qualified, scope, lexical=arrow or cls is not None)
        braced = self.is_(body - 1, "{") and self.is_(end, "}")
        fact = self._fact(name, qualified, "Function", parent if parent is not None else (scope.qualified or None), i, end if braced else end - 1)
        fact |= {"is_async": asynchronous, "signature": self._text(i, body - (0 if arrow and not self.is_(body - 1, "{") else 1))}
        fact["is_generator"] = any(self.is_(k, "*") for k in range(i, a - 1)) and not arrow
        self.definitions[-1] = fact
        fact["param_count"] = self._parameters(a, b, own, cls)

        def later():
            self._statements(body, end, own, "")
            self._calls(body, end, own, fact)

        self.later.append(later)
        return own

    def _declared_function(self, i: int, scope: Scope, prefix: str, exported: bool, default: bool) -> int:
        k = i + self.is_(i, "async") + 1
        k += self.is_(k, "*")
        found, name = self.literal(i), self.word(k)
        if not found:
            return k + 1
        name = name or f"anonymous_L{self.t[i].line}"
        qualified = f"{scope.qualified}.{name}" if scope.qualified else prefix + name
        scope.names[name] = ("def", qualified)
        self._function(name, i, found, scope, qualified)
        if exported:
            self._add_export("default" if default else name, "local", local=qualified)
        return found[3] + 1

    def _class(self, i: int, scope: Scope, prefix: str, exported: bool, default: bool, marks: list) -> int:
        name = self.word(i + 1) if self.word(i + 1) not in ("extends", "implements", None) else f"anonymous_L{self.t[i].line}"
        body = i + 1
        while body < self.n and not self.is_(body, "{"):
            body += 1
        end = self.close.get(body, self.n)
        qualified = f"{scope.qualified}.{name}" if scope.qualified else prefix + name
        fact, own = self._fact(name, qualified, "Class", scope.qualified, i, end), Scope("class", qualified, scope)
        fact["signature"], fact["decorators"] = self._text(i, body), [m for m, _ in marks]
        own.controller = next((text for m, text in marks if m == "Controller" and text), "")
        scope.names[name] = ("class", qualified)
        if exported:
            self._add_export("default" if default else name, "local", local=qualified)
        for k in range(i, body):
            if self.is_(k, "extends") and (base := self._type_name(k + 1, min(body, self._chain_end(k + 1)))):
                fact["base_classes"].append(base)
                self.later.insert(0, lambda base=base: self._base(qualified, base, scope))
        self._members(body + 1, end, own, scope)
        return end + 1

    def _base(self, child: str, base: str, scope: Scope) -> None:
        ref = self._class_ref(base, scope)
        if ref:
            self.base_refs.append({"child": child, "ord": 0, "module": ref[0], "symbol": ref[1]})

    def _chain_end(self, i: int) -> int:
        while self.word(i) and self.is_(i + 1, "."):
            i += 2
        return i + 1

    def _members(self, i: int, j: int, own: Scope, outer: Scope) -> None:
        found: dict[str, set] = {}
        while i < j:
            start = i
            marks, i = self.marks(i)
            first = i
            while self.word(i) in MODIFIERS and (self.word(i + 1) or self.is_(i + 1, "*", "[")):
                i += 1
            i += self.is_(i, "*")
            name = self.word(i)
            k = self._angles(i + 1) if name and self.is_(i + 1, "<") else i + 1
            if name and self.is_(k, "("):
                rest = self._function_rest(k, any(self.is_(x, "async") for x in range(first, i)))
                if rest:
                    inner = self._function(name, first, rest, own, f"{own.qualified}.{name}", own)
                    self.definitions[-1]["decorators"] = [m for m, _ in marks]
                    for mark, text in marks:
                        if mark in HTTP_MARKS:
                            url = "/" + "/".join(filter(None, (own.controller.strip("/"), (text or "").strip("/"))))
                            self._route(url, [mark.upper()], name, self.t[first].line, "decorator", "")
                    self._this_types(rest[2], rest[3], inner, found)
                    i = rest[3] + 1
                    continue
                i = self.after(k)
            elif name:
                k += self.is_(k, "?", "!")
                stop = k
                while stop < j and not self.is_(stop, ";"):
                    if stop > k and self.t[stop].line > self.t[stop - 1].line and (self.word(stop) or self.t[stop].text[:1] in "@#") and not self.is_(stop - 1, "=", ":", "=>", ",", "|"):
                        break
                    stop = self.after(stop) if stop in self.close else stop + 1
                value = next((x for x in range(k, stop) if self.is_(x, "=")), None)
                literal = self._wrapped(value + 1) if value is not None else None
                if literal:
                    self._function(name, first, literal, own, f"{own.qualified}.{name}", own)
                elif self.is_(k, ":"):
                    found.setdefault(name, set()).add(("type", self._type_name(k + 1, value if value is not None else stop)))
                elif value is not None:
                    found.setdefault(name, set()).add(self._new_type(value + 1))
                i = stop
            else:
                i = self.after(i) if i in self.close else i + 1
            i = max(i, start + 1)
        for name, kinds in found.items():
            one = next(iter(kinds)) if len(kinds) == 1 and name not in own.attributes else None
            own.attributes[name] = one

    def _new_type(self, i: int):
        if self.is_(i, "new"):
            end = self._chain_end(i + 1)
            return ("type", self._type_name(i + 1, end))
        return None

    def _this_types(self, i: int, j: int, inner: Scope, found: dict[str, set]) -> None:
        for k in range(i, j - 3):
            if self.is_(k, "this") and self.is_(k + 1, ".") and self.word(k + 2) and self.is_(k + 3, "="):
                value = self._new_type(k + 4)
                if value is None and self.word(k + 4) and self.is_(k + 5, ";", "}"):
                    value = inner.names.get(self.word(k + 4))
                found.setdefault(self.word(k + 2), set()).add(value)

    def _variables(self, i: int, j: int, scope: Scope, prefix: str, exported: bool) -> int:
        k = i + 1
        while k < j:
            first = k
            names = self._pattern(k, j)
            k = self.after(k) if k in self.close else k + 1
            kind = None
            if self.is_(k, ":"):
                stop = self._type_end(k + 1, "=", ";", ",")
                kind, k = ("type", self._type_name(k + 1, stop)), stop
            if self.is_(k, "="):
                literal = self._wrapped(k + 1) if len(names) == 1 and not self.is_(first, "{", "[") else None
                if literal:
                    name = names[0]
                    qualified = f"{scope.qualified}.{name}" if scope.qualified else prefix + name
                    scope.names[name] = ("def", qualified)
                    self._function(name, first, literal, scope, qualified)
                    if exported:
                        self._add_export(name, "local", local=qualified)
                    names, k = [], literal[3]
                elif self.is_(k + 1, "require") and self.string(k + 3) is not None and scope.kind == "module":
                    source = self.string(k + 3)
                    self._imported(source, self.t[k].line)
                    if self.is_(first, "{"):
                        for a, b in self.parts(first + 1, self.close.get(first, j)):
                            self._bind_import(self.t[b - 1].text, source, self.t[a].text)
                    elif names:
                        self._bind_import(names[0], source, "*")
                    names, k = [], k + 5
                else:
                    kind = kind or self._new_type(k + 1)
                    if scope.kind == "module" and len(names) == 1 and self.word(k + 1) and not self.is_(k + 1, "new") and self.is_(self._chain_end(k + 1), "("):
                        self._fact(names[0], prefix + names[0], "Declaration", None, first, self.after(self._chain_end(k + 1)) - 1)
                        if exported:
                            self._add_export(names[0], "local", local=prefix + names[0])
                    k += 1
            for name in names:
                old = scope.names.get(name, kind)
                scope.names[name] = kind if kind and kind[1] and old == kind else None
            line = self.t[min(k, self.n) - 1].line
            while k < j and not self.is_(k, ",", ";"):
                if self.t[k].line > line and self.word(k) in ("const", "let", "var", "function", "class", "export", "import", "return", "if", "for", "async", "module"):
                    return k
                line = self.t[k].line
                k = self.after(k) if k in self.close else k + 1
            if not self.is_(k, ","):
                return k
            k += 1
        return k

    # calls

    def _calls(self, i: int, j: int, scope: Scope, fact: dict) -> None:
        seen: list[str] = []
        returns: list[str] = []

        def walk(i: int, j: int) -> None:
            while i < j:
                t = self.t[i]
                if t.kind == "word" and t.text == "return" and not self.is_(i - 1, ".", "?."):
                    returns.append(shown_return(self.source(i, self._statement_end(i, j))))
                if t.kind == "word" and t.text in ("function", "async") or self.is_(i, "(") or t.kind == "word" and self.is_(i + 1, "=>"):
                    found = self.literal(i)
                    if found:
                        named = self._known(i, found)
                        if not named:
                            name = f"callback_L{t.line}_C{t.column + 1}"
                            qualified = f"{scope.qualified}.{name}"
                            scope.names[name] = ("def", qualified)
                            self._function(name, i, found, scope, qualified)
                            seen.append(name)
                        i = found[3] + (1 if self.is_(found[3], "}") and self.is_(found[2] - 1, "{") else 0)
                        continue
                if t.kind == "word" and t.text == "class" and not self.is_(i - 1, "."):
                    body = next((k for k in range(i, j) if self.is_(k, "{")), i)
                    i = self.after(body)
                    continue
                if self.is_(i, "<") and self.word(i + 1) and (self.word(i + 1)[:1].isupper()) and not (self.t[i - 1].kind == "word" and self.t[i - 1].text not in KEYWORDS or self.is_(i - 1, ")", "]")) and self.file.endswith("x"):
                    end = self._chain_end(i + 1)
                    seen.append(self._text(i + 1, end).replace(" ", ""))
                    i = end
                    continue
                if t.kind == "word" and (t.text not in KEYWORDS or t.text in ("this", "super")) and not self.is_(i - 1, ".", "?.", "function"):
                    k, parts = i, [t.text]
                    while self.is_(k + 1, ".", "?.") and self.word(k + 2):
                        parts.append(self.word(k + 2))
                        k += 2
                    at = k + 1 + self.is_(k + 1, "?.")
                    if self.is_(at, "<") and self.is_(g := self._angles(at), "("):
                        at = g
                    if self.is_(at, "(") and not self.is_(i - 1, "new") and parts != ["super"] and parts != ["this"]:
                        seen.append(".".join(parts))
                    i = k + 1
                    continue
                i += 1

        walk(i, j)
        calls = list(dict.fromkeys(seen))
        fact["calls"], fact["returns"] = calls, list(dict.fromkeys(returns))
        for n, call in enumerate(calls):
            ref = self.resolve(call, scope)
            if ref:
                self.references.append({"caller": fact["qualified"], "call": call, "seq": n, **ref})

    def _statement_end(self, i: int, j: int) -> int:
        """Where a statement ends: behind its semicolon, or at a line that doesn't go on with it."""
        k = i + 1
        while k < j and not self.is_(k, ";"):
            goes_on = self.t[k - 1].kind == "mark" and self.t[k - 1].text not in (")", "]", "}") or self.t[k].kind == "mark" and self.t[k].text not in ("{", "[", "}")
            if self.t[k].line > self.t[k - 1].line and not goes_on:
                return k
            k = self.after(k) if k in self.close else k + 1
        return min(k + 1, j) if self.is_(k, ";") else k

    def _known(self, i: int, found) -> bool:
        """Whether the literal at i is a definition with a name, read elsewhere."""
        k = i
        while self.is_(k - 1, "(") and self.word(k - 2) in WRAPPERS:
            k -= 2
            while self.is_(k - 1, "."):
                k -= 2
        if self.is_(i, "function") and self.word(i + 1) or self.is_(i, "async") and self.is_(i + 1, "function") and self.word(i + 2):
            return not self.is_(i - 1, "(", ",", "=", ":") or self.is_(k - 1, "=")
        if not self.is_(k - 1, "="):
            return False
        return any(self.is_(x, "const", "let", "var") for x in range(max(0, k - 12), k))

    # routes and requests

    def _route(self, url: str, methods: list[str], handler: str | None, line: int, kind: str, var: str, framework: str | None = None) -> None:
        self.routes.append({"url": url, "methods": methods, "handler": handler, "line": line, "kind": kind, "var": var, "framework": framework})

    def _web(self) -> None:
        """Calls like fetch('/x'), axios.post('/x'), app.get('/x', handler) and app.use(handler), by line.

        With a handler behind the URL it is a route, without one a request; results of routes aren't assigned.
        """
        builders = {self.t[i].text: url for i in range(self.n) if (url := self._built(i))}
        clean = lambda url: re.sub(r"^https?://[^/]+", "", re.sub(r"^\$\{\}(?=/)", "", url)).replace("${}", "{id}")
        jsx = self.file.endswith("x")
        for i in range(self.n):
            if jsx and self.is_(i, "<") and self.is_(i + 1, "Route"):
                self._element(i + 2)
            if self.t[i].kind != "word" or self.is_(i - 1, ".", "?.") or self.t[i].text in KEYWORDS and self.t[i].text != "this":
                continue
            end = self._chain_end(i)
            name = self._text(i, end).replace(" ", "").split(".")
            at = self._angles(end) if self.is_(end, "<") else end
            if not self.is_(at, "("):
                continue
            close = self.close.get(at, self.n)
            args, verb, line = self.parts(at + 1, close), name[-1], self.t[i].line
            assigned = self.is_(i - 1, "=")
            if jsx and name == ["createBrowserRouter"] and args:
                self._configured(*args[0], "")
            if len(name) == 2 and verb == "router" and args and self.is_(args[0][0], "{"):
                self._procedures(args[0][0])
            if not args or i and (self.word(i - 1) or "").startswith("@"):
                continue
            first = self.string(args[0][0])
            if len(name) == 2 and verb in ("use", "add_middleware", "route") and not assigned:
                self._around(name, args, line)
                continue
            if name == ["fetch"] or name == ["axios"] or len(name) > 1 and verb in VERBS:
                url, method = first, verb.upper() if verb in VERBS else "GET"
                if name in (["fetch"], ["axios"]):
                    keys = self._options(args)
                    url, method = url or keys.get("url"), (keys.get("method") or method).upper()
                url = clean(url) if url else ""
                handlers = [x for x in args[1:] if self.word(x[0]) or self.literal(x[0])]
                if url.startswith("/") and len(name) > 1 and name[0] != "axios" and handlers and not self.is_(i - 1, "=", "await", "return"):
                    inline = self.literal(args[1][0])
                    handler = self._handler(verb, args[1][0], inline) if inline else None if self.literal(handlers[-1][0]) else self._text(*handlers[-1]).replace(" ", "")
                    self._route(url, [] if verb == "all" else [method], handler, line, "endpoint_call", name[0])
                    continue
                if url.startswith("/"):
                    self.http.append({"url": re.sub(r"\?.*$", "", url), "method": method, "lib": name[0], "line": line})
                    continue
            sender = ".".join(name)
            if any(x in sender.lower() for x in SENDERS) and name[0] not in ("fetch", "axios"):
                called = self.word(args[0][0]) if self.is_(args[0][0] + 1, "(") else None
                url = clean(first if first is not None else builders.get(called, ""))
                if url.startswith("/"):
                    own = {"del": "DELETE"}.get(verb.lower(), verb.upper() if verb.lower() in ("post", "put", "patch", "delete") else None)
                    method = own or (self._options(args).get("method") or "GET").upper()
                    self.http.append({"url": re.sub(r"\?.*$", "", url), "method": method, "lib": sender, "line": line})

    def _options(self, args: list[tuple[int, int]]) -> dict[str, str | None]:
        return {self.word(k): self.string(k + 2) for k in range(args[0][0], args[-1][1]) if self.word(k) in ("method", "url") and self.is_(k + 1, ":")}

    def _built(self, i: int) -> str | None:
        """The URL that a function named like getXUrl gives, if it is defined at i."""
        if not (self.word(i) and BUILDER.fullmatch(self.t[i].text) and self.is_(i - 1, "const") and self.is_(i + 1, "=")):
            return None
        found = self.literal(i + 2)
        return self.string(found[2] + self.is_(found[2], "return")) if found else None

    def _handler(self, verb: str, i: int, found) -> str:
        """A function without a name behind a route's URL becomes one of the file, with the names of its module."""
        name = f"handler_{verb}_L{self.t[i].line}"
        self._function(name, i, found, self.module, name, parent="")
        return name

    def _around(self, name: list[str], args: list[tuple[int, int]], line: int) -> None:
        """What an application uses: with a URL in front a mounted router, without one middleware; route('/x') is a route."""
        texts = [t for a, _ in args if (t := self.string(a)) is not None]
        if name[1] == "route":
            if texts and texts[0].startswith("/"):
                self._route(texts[0], ["GET"], None, line, "endpoint_call", name[0])
            return
        if name[1] == "use" and texts and texts[0].startswith("/"):
            target = self._text(*args[1]).replace(" ", "") if len(args) > 1 and self.word(args[1][0]) else ""
            got = self.module.names.get(target.split(".")[0])
            if isinstance(got, tuple) and got[0] == "import" and got[1]:
                self.mounts.append({"prefix": texts[0], "module": got[1], "symbol": target.split(".")[1] if "." in target else got[2].replace("*", "default"), "parent": name[0]})
            elif target and "." not in target:
                self.mounts.append({"prefix": texts[0], "module": None, "symbol": target, "parent": name[0]})
            return
        for a, b in args:
            handler = anonymous("middleware", self.file, self.t[a].line) if self.literal(a) else None
            if handler is None and self.word(a):
                end = self._chain_end(a)
                handler = self.word(a) if end == a + 1 and b == end else self._text(a, end).replace(" ", "") if self.is_(end, "(") else None
            if handler:
                self.middleware.append({"name": handler, "var": name[0], "kind": "call", "line": line})
                return

    def _element(self, i: int) -> None:
        """A <Route path=... element={<View />}>, from behind its name."""
        path = view = None
        while i < self.n and not self.is_(i, ">", "/>", "/"):
            if self.is_(i + 1, "=") and self.word(i) in ("path", "element"):
                if self.word(i) == "path":
                    path = self.string(i + 2 + self.is_(i + 2, "{"))
                elif self.is_(i + 2, "{") and self.is_(i + 3, "<"):
                    view = self.word(i + 4)
                i = self.after(i + 2) if i + 2 in self.close else i + 3
            else:
                i = self.after(i) if i in self.close else i + 1
        if path:
            self._route(path if path.startswith("/") else "/" + path, ["GET"], view, self.t[min(i, self.n - 1)].line, "jsx_route", "", "react-router")

    def _configured(self, i: int, j: int, above: str) -> None:
        """Routes from objects with a path, one level of children included."""
        for a, _ in self.parts(i + 1, self.close.get(i, j)) if self.is_(i, "[") else ():
            if not self.is_(a, "{"):
                continue
            pairs = {self.word(x): x + 2 for x, _ in self.parts(a + 1, self.close.get(a, j)) if self.word(x) and self.is_(x + 1, ":")}
            path = self.string(pairs["path"]) if "path" in pairs else None
            if path is not None:
                self._route((above + "/" + path).rstrip("/") if above is not None and self.nested else path, ["GET"], None, self.t[a].line, "jsx_route", "", "react-router")
            if "children" in pairs and not self.nested:
                self.nested = True
                self._configured(pairs["children"], j, path or "")
                self.nested = False

    nested = False

    def _procedures(self, i: int) -> None:
        """A route for each procedure of a router object: mutations are posted, queries got."""
        for a, b in self.parts(i + 1, self.close.get(i, self.n)):
            key = self.word(a) or self.string(a)
            if key and self.is_(a + 1, ":") and self.is_(b - 1, ")"):
                text = self._text(a + 2, b).replace(" ", "")
                self._route("/" + key, ["POST" if ".mutation" in text else "GET"], key, self.t[a].line, "jsx_route", "", "react-router")

    def _pages(self) -> None:
        """Routes that follow from where a file lies."""
        path, app, pages = "/" + self.file, ("/" + self.file).find("/app/"), ("/" + self.file).find("/pages/")
        verbs = [d["name"] for d in self.definitions if d["kind"] == "Function" and d["name"].upper() in HTTP_NAMES]
        add = lambda url, methods, handler, framework: self._route(url, methods, handler, 1, "file", "", framework)
        if app >= 0:
            url = page_url(path[app + 5 :], "page|route|layout|loading|error|not-found")
            for v in verbs:
                add(url, [v.upper()], v, "nextjs")
            if not verbs and "page" in path:
                add(url, ["GET"], None, "nextjs")
        elif pages >= 0:
            url = page_url(path[pages + 7 :], "index")
            default = any(e["exported"] == "default" for e in self.exports) or any(d["name"] == "handler" and d["qualified"] in {e["local"] for e in self.exports} for d in self.definitions)
            for v in verbs:
                add(url, [v.upper()], v, "nextjs")
            if default:
                add(url, ["GET", "POST", "PUT", "DELETE", "PATCH"], "handler", "nextjs")
            if not verbs and not default:
                add(url, ["GET"], None, "nuxt")

    # references

    def _find(self, scope: Scope | None, name: str):
        first = scope
        while scope is not None:
            if name in scope.names and (scope.kind != "class" or scope is first):
                return scope.names[name]
            scope = scope.up
        return "unknown"

    def _this(self, scope: Scope) -> Scope | None:
        while scope is not None and scope.kind != "class":
            if not scope.lexical:
                return None
            scope = scope.up
        return scope

    def _class_ref(self, name: str, scope: Scope) -> tuple | None:
        got = self._find(scope, name.split(".")[0])
        rest = name.split(".")[1:]
        if isinstance(got, tuple) and got[0] == "class" and not rest:
            return None, got[1]
        if isinstance(got, tuple) and got[0] == "import" and got[1]:
            if got[2] == "*":
                return (got[1], rest[0]) if len(rest) == 1 else None
            return (got[1], got[2]) if not rest else None
        return None

    def resolve(self, call: str, scope: Scope) -> dict | None:
        make = lambda kind, ref, member=None: {"kind": kind, "module": ref[0], "symbol": ref[1], "member": member}
        parts = call.split(".")
        if parts[0] in ("this", "super"):
            cls = self._this(scope)
            if cls is None:
                return None
            if len(parts) == 2:
                return make("member" if parts[0] == "this" else "super", (None, cls.qualified), parts[1])
            kind = cls.attributes.get(parts[1]) if parts[0] == "this" and len(parts) == 3 else None
            ref = self._class_ref(kind[1], cls) if isinstance(kind, tuple) and kind[0] == "type" and kind[1] else None
            return make("member", ref, parts[2]) if ref else None
        got = self._find(scope, parts[0])
        if not isinstance(got, tuple):
            return None
        if got[0] == "def":
            return make("name", (None, got[1])) if len(parts) == 1 else None
        if got[0] == "class":
            return make("name", (None, got[1])) if len(parts) == 1 else make("member", (None, got[1]), parts[1]) if len(parts) == 2 else None
        if got[0] == "import":
            if not got[1] or got[3]:
                return None
            names = parts[1:] if got[2] == "*" else [got[2], *parts[1:]]
            if not names:
                return make("name", (got[1], "default"))
            return make("name", (got[1], names[0])) if len(names) == 1 else make("member", (got[1], names[0]), names[1]) if len(names) == 2 else None
        ref = self._class_ref(got[1], scope) if got[0] == "type" and got[1] else None
        return make("member", ref, parts[1]) if ref and len(parts) == 2 else None


def page_url(path: str, dropped: str) -> str:
    """The URL of a file in a folder of pages: [x] is a parameter, (x) a group without a name of its own."""
    p = re.sub(r"\[([^\]]+)\]", r":\1", re.sub(r"/\([^/]+\)", "", re.sub(r"\.[^/.]+$", "", path)))
    return "/" + re.sub(rf"/?(?:{dropped})(?:$|(?=/))", "", p).strip("/")


def script_facts(path: str, text: str, frameworks: Sequence[str] = ()) -> dict:
    r = Reader(text, path)
    for route in r.routes:
        if route["framework"] is None:
            route["framework"] = of_route(route["var"], route["url"], route["methods"], frameworks)
    return {"mounts": r.mounts, "middleware": r.middleware, "definitions": r.definitions, "imports": r.imports, "references": r.references, "base_refs": r.base_refs, "exports": r.exports, "routes": r.routes, "http": r.http}
