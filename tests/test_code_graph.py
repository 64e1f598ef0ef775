import pytest

from loomgraph.plans.code_graph import build_from
from loomgraph.plans.questions import CodeStructure, as_yaml

SOURCES = {
    "shop/__init__.py": "",
    "shop/stock.py": "def reserve():\n    return 1\n",
    "shop/mail.py": "def reserve():\n    return 2\n",
    "shop/store.py": "class Store:\n    def put(self):\n        return True\n",
    "shop/root.py": "class Root:\n    def start(self):\n        return True\n",
    "use.py": """
from shop.stock import reserve as take
from shop.stock import reserve
import shop.mail as post
import shop.stock
import shop.mail

def by_alias():
    return take()

def by_module():
    return post.reserve()

def untyped(x):
    return x.reserve()

def missing():
    return far_away()

def dotted_stock():
    return shop.stock.reserve()

def dotted_mail():
    return shop.mail.reserve()

def shadowed(reserve):
    return reserve()
""",
    "forms.py": """
class First:
    def go(self):
        return self.keep()

    def keep(self):
        return 1

class Second:
    def keep(self):
        return 2

class Parent:
    def act(self):
        return 1

    def check(self):
        return True

class Kid(Parent):
    def act(self):
        return super().act()

    def ask(self):
        def later():
            return self.check()
        return self.check()
""",
    "inner.py": "def goal():\n    return 1\n\ndef outer():\n    def deep():\n        return goal()\n    return deep()\n",
    "far.py": "def far_away():\n    return 0\n",
    "types.py": """
from typing import Optional
from shop.store import Store as Box
import shop.root

box = Box()

class Other:
    def put(self):
        return False

class Base:
    def put(self):
        return True

class Derived(Base):
    pass

def annotated(box: Box):
    return box.put()

def optional(box: "Optional[Box]"):
    return box.put()

def constructed():
    b = Box()
    return b.put()

class Service:
    def __init__(self):
        self.box = Box()

    def save(self):
        return self.box.put()

class Holder:
    box: Other

    def save(self):
        return box.put()

class Static:
    @staticmethod
    def save(self: Box):
        return self.put()

class Leaf(shop.root.Root):
    def go(self):
        return super().start()

def inherited(d: Derived):
    return d.put()

def either(x: Box | Other):
    return x.put()

def rebound(x: Box):
    x = other()
    return x.put()

def hidden(x: Box):
    def again(x):
        return x.put()
    return again(x)
""",
    "top.py": "from use import by_alias\n\ndef main():\n    by_alias()\n\nif True:\n    def not_indexed():\n        pass\n",
    "api.py": """
from fastapi import APIRouter
router = APIRouter(prefix="/v1")

@router.get("/items")
async def items():
    \"\"\"All items.

    More.\"\"\"
    return []

@router.post("/items")
def create(item, *, force=False):
    return helper(item).run()
""",
    "broken.py": "def fine():\n    return 1\n\nclass Half:\n    def m(self):\n        return (\n",
    "docs/readme.md": "# x\n",
}


@pytest.fixture(scope="module")
def graph(spark):
    return build_from(spark, SOURCES)


@pytest.fixture(scope="module")
def calls(graph):
    out = {}
    for r in graph.edges.filter("edge_class = 'executable'").collect():
        out.setdefault(r["src"], set()).add(r["dst"])
    functions = {r["id"] for r in graph.nodes.filter("kind = 'Function'").collect()}
    return lambda node: {c for c in out.get(node, ()) if c in functions}


@pytest.mark.parametrize(
    ("caller", "callees"),
    [
        ("use.py:by_alias", {"shop/stock.py:reserve"}),
        ("use.py:by_module", {"shop/mail.py:reserve"}),
        ("use.py:untyped", set()),
        ("use.py:missing", set()),
        ("use.py:dotted_stock", {"shop/stock.py:reserve"}),
        ("use.py:dotted_mail", {"shop/mail.py:reserve"}),
        ("use.py:shadowed", set()),
        ("forms.py:First.go", {"forms.py:First.keep"}),
        ("forms.py:Kid.act", {"forms.py:Parent.act"}),
        ("forms.py:Kid.ask", {"forms.py:Parent.check"}),
        ("forms.py:Kid.ask.later", {"forms.py:Parent.check"}),
        ("inner.py:outer", {"inner.py:outer.deep"}),
        ("inner.py:outer.deep", {"inner.py:goal"}),
        ("types.py:annotated", {"shop/store.py:Store.put"}),
        ("types.py:optional", {"shop/store.py:Store.put"}),
        ("types.py:constructed", {"shop/store.py:Store.put"}),
        ("types.py:Service.save", {"shop/store.py:Store.put"}),
        ("types.py:Holder.save", {"shop/store.py:Store.put"}),
        ("types.py:Static.save", {"shop/store.py:Store.put"}),
        ("types.py:Leaf.go", {"shop/root.py:Root.start"}),
        ("types.py:inherited", {"types.py:Base.put"}),
        ("types.py:either", set()),
        ("types.py:rebound", set()),
        ("types.py:hidden.again", set()),
    ],
)
def test_calls_lead_where_they_certainly_lead(calls, caller, callees):
    assert calls(caller) == callees


def test_nodes_and_containment(graph):
    nodes = {r["id"]: r for r in graph.nodes.collect()}
    assert nodes["shop"]["kind"] == "Folder" and nodes["docs/readme.md"]["kind"] == "File"
    assert "top.py:not_indexed" not in nodes
    assert nodes["api.py:items"]["is_async"] and nodes["api.py:items"]["docstring"] == "All items."
    assert nodes["api.py:create"]["param_count"] == 3 and nodes["api.py:create"]["calls"] == ["helper"]
    assert nodes["api.py:create"]["signature"] == "def create(item, *, force=False)"
    assert nodes["api.py:/v1/items"]["methods"] == ["GET", "POST"] and nodes["api.py:/v1/items"]["handlers"] == ["items", "create"]
    assert nodes["broken.py:Half.m"]["parent"] == "broken.py:Half"
    edges = {(r["src"], r["dst"], r["edge_class"]) for r in graph.edges.collect()}
    for e in (("inner.py:outer.deep", "inner.py:outer"), ("inner.py:outer.deep", "inner.py"), ("forms.py:Kid.act", "forms.py:Kid"), ("use.py", "top.py"), ("shop/stock.py", "use.py"), ("shop/stock.py", "shop")):
        assert (*e, "structural") in edges
    assert ("forms.py:Kid.act", "forms.py", "structural") not in edges
    assert ("api.py:/v1/items", "api.py:create", "generated") in edges
    assert [r["path"] for r in graph.errors.collect()] == ["broken.py"]


@pytest.fixture(scope="module")
def ask(graph):
    return CodeStructure(graph, "/ws")


def test_lookup(ask):
    two = ask.lookup_symbol("reserve")
    assert two["status"] == "ambiguous" and [c["id"] for c in two["candidates"]] == ["shop/mail.py:reserve", "shop/stock.py:reserve"]
    assert ask.lookup_symbol("reserve", "shop/mail.py")["symbol"]["id"] == "shop/mail.py:reserve"
    one = ask.lookup_symbol("stock.py:reserve")
    assert one["symbol"]["lines"] == "1-2" and one["relationships"]["callers"] == ["use.py:by_alias", "use.py:dotted_stock"]
    assert ask.lookup_symbol("Store.put")["symbol"]["container"] == "shop/store.py:Store"
    assert ask.lookup_symbol("STORE")["symbol"]["id"] == "shop/store.py:Store"
    gone = ask.lookup_symbol("reserv")
    assert gone["status"] == "not_found" and not gone["ok"] and "shop/mail.py:reserve" in gone["suggestions"]
    file = ask.lookup_symbol("use.py")["relationships"]
    assert file["imports"] == ["shop/mail.py", "shop/stock.py"] and file["imported_by"] == ["top.py"]
    assert ask.lookup_symbol("shop")["hint"].startswith("'shop' is a folder")
    assert ask.lookup_symbol("untyped")["relationships"]["unresolved_calls"] == ["x.reserve"]
    assert ask.lookup_symbol("api.py")["symbol"]["frameworks"] == ["fastapi"]
    assert ask.lookup_symbol("")["status"] == "not_found"


def test_impact(ask):
    got = ask.impact("shop/stock.py:reserve", depth=5)
    assert got["meta"]["direct"] == 2 and got["meta"]["total"] == 3 and not got["meta"]["more_beyond_depth"]
    assert got["affected"] == {"top.py": ["main [Function] L3-4 depth=2"], "use.py": ["by_alias [Function] L8-9 depth=1", "dotted_stock [Function] L20-21 depth=1"]}
    assert [p["id"] for p in got["possible_callers"]] == ["use.py:untyped", "use.py:shadowed"]
    assert ask.impact("shop/stock.py:reserve", depth=1)["meta"]["more_beyond_depth"]
    down = ask.impact("top.py:main", depth=99, direction="callees")
    assert down["meta"]["depth"] == 25 and down["meta"]["total"] == 2
    assert not ask.impact("main", direction="sideways")["ok"]


def test_code_map(ask):
    whole = ask.code_map(".", 2)
    assert whole["meta"]["files"] == len(SOURCES) and [f["path"] for f in whole["folders"]] == ["docs", "shop"]
    assert whole["folders"][1]["files_count"] == 5 and [f["path"] for f in whole["folders"][1]["files"]][0] == "shop/__init__.py"
    inner = next(f for f in whole["files"] if f["path"] == "inner.py")
    assert inner["symbols"] == {"Function": 3} and inner["top_level"] == "goal, outer" and inner["line_count"] == 7
    file = ask.code_map("inner.py")
    assert [s["name"] for s in file["symbols"]] == ["goal", "outer"] and file["symbols"][1]["members"][0]["name"] == "deep"
    assert ask.code_map("shop/stok.py")["suggestions"][0] == "shop/stock.py"
    assert "tool: code_map" in as_yaml(whole)


def test_graph_by_id(ask):
    assert ask.callers("shop/stock.py:reserve") == ["use.py:by_alias", "use.py:dotted_stock"]
    assert ask.callees("top.py:main") == ["use.py:by_alias"]
    assert "shop/stock.py" in ask.dependents("shop") and "inner.py:outer" in ask.dependencies("inner.py:outer.deep")
    assert {r["node"]: r["hop"] for r in ask.blast_radius("shop/stock.py:reserve").collect()} == {"use.py:by_alias": 1, "use.py:dotted_stock": 1, "top.py:main": 2}
    assert [r["node"] for r in ask.recursive_callees("top.py:main", 1).collect()] == ["use.py:by_alias"]
    assert [r["id"] for r in ask.search("STORE").collect()] == ["shop/store.py:Store", "shop/store.py"]
    assert ask.stats()["nodes"] > 50


def test_mounts_and_package_files(spark):
    graph = build_from(
        spark,
        {
            "app.py": "from api.users import router\nimport api.items as items\n\napp = make()\napp.include_router(router, prefix='/v1')\napp.include_router(items.router, prefix='/v1/items')\n",
            "api/__init__.py": "from .users import who as name_of\n",
            "api/users.py": "router = APIRouter()\n\n@router.get('/users')\ndef who():\n    return 1\n",
            "api/items.py": "router = APIRouter()\n\n@router.get('/items/all')\ndef all_items():\n    return 1\n",
            "site/urls.py": "urlpatterns = [path('shop/', include('site.shop'))]\n",
            "site/shop.py": "urlpatterns = [path('cart/<int:pk>/', cart)]\n\ndef cart(request, pk):\n    return 1\n",
            "use.py": "from api import name_of\n\ndef ask():\n    return name_of()\n",
            "web.ts": "export const a = () => fetch('/v1/users')\nexport const b = () => fetch('/shop/cart/5')\n",
        },
    )
    urls = {r["id"]: r["full_url"] for r in graph.nodes.filter("kind = 'Route'").collect()}
    assert urls == {"api/users.py:/users": "/v1/users", "api/items.py:/items/all": "/v1/items/all", "site/shop.py:cart/<int:pk>/": "/shop/cart/<int:pk>/"}
    edges = {(r["src"], r["dst"]) for r in graph.edges.filter("edge_class <> 'structural'").collect()}
    assert ("use.py:ask", "api/users.py:who") in edges
    assert ("web.ts:a", "api/users.py:/users") in edges and ("web.ts:b", "site/shop.py:cart/<int:pk>/") in edges
    assert ("site/shop.py:cart/<int:pk>/", "site/shop.py:cart") in edges


def test_maps_stop_at_their_limit(spark):
    """300 entries of a folder, in the order of a walk; 300 symbols of a file, whatever holds them."""
    many = {f"pkg/f{i:03}.py": "x = 1\n" for i in range(305)} | {"pkg/sub/g.py": "y = 1\n"}
    many["big.py"] = "".join(f"class C{i}:\n    def m(self):\n        return 1\n" for i in range(160))
    s = CodeStructure(build_from(spark, many))
    answer = s.code_map("pkg", 2)
    assert answer["meta"]["truncated"] and answer["meta"]["files"] == 306 and "capped at 300" in answer["meta"]["warnings"][-1]
    assert len(answer["files"]) + len(answer["folders"]) + len(answer["folders"][0]["files"]) == 300 and answer["files"][-1]["path"] == "pkg/f297.py"
    answer = s.code_map("big.py")
    assert answer["meta"]["symbols"] == 320 and answer["meta"]["truncated"]
    assert sum(1 + len(x.get("members", ())) for x in answer["symbols"]) == 300


def test_the_place_of_a_candidate_decides_among_several(spark):
    """A model is looked for in the imported module, then in the same folder; where that tells nothing, it stays open."""
    model = "from django.db import models\nclass Item(models.Model):\n    pass\n"
    use = "from django.db import models\n{}class Order(models.Model):\n    item = models.ForeignKey({}, on_delete=1)\n"
    sources = {"shop/items.py": model, "stock/items.py": model, "stock/order.py": use.format("", "'Item'"), "far/order.py": use.format("from shop.items import Item\n", "Item"), "other/order.py": use.format("", "'Item'")}
    edges = {(r["src"], r["dst"]) for r in build_from(spark, sources).edges.filter("src LIKE '%:Item'").collect()}
    assert ("stock/items.py:Item", "stock/order.py:Order") in edges
    assert ("shop/items.py:Item", "far/order.py:Order") in edges
    assert not {e for e in edges if e[1] == "other/order.py:Order"}
