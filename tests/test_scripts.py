import pytest

from loomgraph.plans.code_graph import build_from
from loomgraph.plans.questions import CodeStructure
from loomgraph.sources.script_facts import script_facts, tokens

SOURCES = {
    "src/util.ts": "export function load(id: string): Promise<{ a: number }> {\n  return fetch(`/api/${encode(id)}`)\n}\nfunction encode(x) { return x }\nexport default class Cache { get(k) { return k } }\n",
    "src/other.ts": "export function load() {}\nexport const unused = 1\n",
    "src/repo.ts": "export class Base { check() { return true } }\nexport class Repo extends Base {\n  private log = new Log()\n  save(x: number) { this.check(); return this.hide() }\n  private hide() { return this.log.write() }\n}\nclass Log { write() {} }\n",
    "src/index.ts": "export { load as fetchIt } from './util'\nexport * from './repo'\nexport * as others from './other'\n",
    "src/use.ts": """
import Cache, { load } from './util'
import * as other from './other.js'
import { fetchIt, Repo } from '.'
import type { Log } from './repo'
import { gone } from 'package'

export const direct = async (id: string) => { await load(id); gone() }
export const spaced = () => other.load()
export function through() { return fetchIt('x') }
export function typed(r: Repo) { return r.save(1) }
export function made() { const r = new Repo(); return r.check() }
export function shadowed(load) { return load() }
export function either(r: Repo | Cache) { return r.save(1) }
export function untyped(r) { return r.save(2) }
export function cached(c: Cache) { return c.get('k') }
function outer() {
  const inner = () => load('y')
  return inner()
}
""",
    "web/App.jsx": """
const { helper: h } = require('./lib')
const lib = require('./lib')
const App = memo(function App(props) {
  useEffect(() => { refresh() }, [])
  function refresh() { h(); lib.second() }
  return <Panel onClick={() => refresh()}><div>it is</div></Panel>
})
function Panel() { return null }
module.exports = App
""",
    "web/lib.js": "function helper() { return /a'[/]b/.test('x') ? 1 : 2 }\nfunction second() { return helper() }\nmodule.exports = { helper, second: second }\n",
}


@pytest.fixture(scope="module")
def graph(spark):
    return build_from(spark, SOURCES)


@pytest.fixture(scope="module")
def calls(graph):
    out = {}
    for r in graph.edges.filter("edge_class = 'generated'").collect():
        out.setdefault(r["src"], set()).add(r["dst"])
    return lambda node: out.get(node, set())


@pytest.mark.parametrize(
    ("caller", "callees"),
    [
        ("src/util.ts:load", {"src/util.ts:encode"}),
        ("src/use.ts:direct", {"src/util.ts:load"}),
        ("src/use.ts:spaced", {"src/other.ts:load"}),
        ("src/use.ts:through", {"src/util.ts:load"}),
        ("src/use.ts:typed", {"src/repo.ts:Repo.save"}),
        ("src/use.ts:made", {"src/repo.ts:Base.check"}),
        ("src/use.ts:shadowed", set()),
        ("src/use.ts:either", set()),
        ("src/use.ts:untyped", set()),
        ("src/use.ts:cached", {"src/util.ts:Cache.get"}),
        ("src/use.ts:outer", {"src/use.ts:outer.inner"}),
        ("src/use.ts:outer.inner", {"src/util.ts:load"}),
        ("src/repo.ts:Repo.save", {"src/repo.ts:Base.check", "src/repo.ts:Repo.hide"}),
        ("src/repo.ts:Repo.hide", {"src/repo.ts:Log.write"}),
        ("web/App.jsx:App.refresh", {"web/lib.js:helper", "web/lib.js:second"}),
        ("web/lib.js:second", {"web/lib.js:helper"}),
    ],
)
def test_calls_of_scripts(calls, caller, callees):
    assert calls(caller) == callees


def test_callbacks_are_transparent(graph, calls):
    assert any(".callback_L5_C13" in c for c in calls("web/App.jsx:App"))
    ask = CodeStructure(graph)
    assert set(ask.lookup_symbol("refresh")["relationships"]["callers"]) == {"web/App.jsx:App"}
    assert ask.lookup_symbol("App.jsx:App")["relationships"]["callees"] == ["web/App.jsx:Panel", "web/App.jsx:App.refresh"] or set(ask.lookup_symbol("App.jsx:App")["relationships"]["callees"]) == {"web/App.jsx:Panel", "web/App.jsx:App.refresh"}
    assert ask.impact("web/lib.js:helper", depth=3)["meta"]["total"] == 3
    assert ask.code_map("src/index.ts")["exports"] == ["load as fetchIt from ./util", "* from ./repo", "* as others from ./other"]
    assert ask.code_map("src/use.ts")["imports"] == ["./util", "./other.js", ".", "./repo", "package"]
    assert set(ask.lookup_symbol("src/use.ts")["relationships"]["imports"]) == {"src/util.ts", "src/other.ts", "src/index.ts", "src/repo.ts"}


def test_ambiguous_module_has_no_meaning(spark):
    graph = build_from(spark, {"a.ts": "export function f() {}", "a/index.ts": "export function f() {}", "u.ts": "import { f } from './a'\nexport function g() { f() }"})
    assert graph.edges.filter("edge_class = 'generated'").isEmpty()


def test_names_are_followed_through_any_number_of_files(spark):
    chain = {f"m{i}.ts": f"export {{ f }} from './m{i + 1}'\nexport * from './m{(i + 1) % 13}'\n" for i in range(13)}
    graph = build_from(spark, chain | {"m13.ts": "export function f() {}\n", "u.ts": "import { f } from './m0'\nexport function g() { f() }"})
    assert {(r["src"], r["dst"]) for r in graph.edges.filter("edge_class = 'generated'").collect()} == {("u.ts:g", "m13.ts:f")}


def test_reader_takes_anything():
    for text in ("", "}", "{[(", "`${`${a}`}`", "class", "export default", "import", "const {", "a => ", "x = /[/]/g; 'open\n", "function (", "<A", "async", "@d() class X { @p() m() {} }"):
        script_facts("x.tsx", text)
    assert [t.text for t in tokens("a?.b ?? /x/ // c\n+ 1.5")] == ["a", "?.", "b", "??", "/x/", "+", "1.5"]
    d = {x["qualified"]: x for x in script_facts("n.ts", "namespace N { export function f(a, {b}, ...c) {} }\nexport const client = axios.create({})\n")["definitions"]}
    assert d["N.f"]["param_count"] == 3 and d["client"]["kind"] == "Declaration"


def test_requests_meet_the_one_route_that_fits(spark):
    graph = build_from(
        spark,
        {
            "back/api.py": "from fastapi import APIRouter\nrouter = APIRouter(prefix='/api/items')\n\n@router.get('/{item_id}')\ndef one(item_id):\n    return 1\n\n@router.post('/')\ndef add():\n    return 1\n\n@router.get('/static/7')\ndef seven():\n    return 7\n",
            "back/twice.py": "from fastapi import APIRouter\nrouter = APIRouter()\n\n@router.get('/twice')\ndef a():\n    return 1\n",
            "back/again.py": "from fastapi import APIRouter\nrouter = APIRouter()\n\n@router.get('/twice')\ndef b():\n    return 1\n",
            "back/server.js": "app.get('/health', check)\nfunction check() {}\napp.use('/x', other)\n",
            "front/client.ts": "export function load(id) { return fetch(`/api/items/${id}`) }\nexport const save = () => axios.post('/api/items', {})\nexport function seven() { return fetch('/api/items/static/7', { method: 'GET' }) }\nexport function wrong() { return fetch('/api/items/static/7', { method: 'DELETE' }) }\nexport function twice() { return fetch('/twice') }\nexport async function health() { const r = await http.get('http://host/health'); return r }\n",
        },
    )
    got = {(r["src"], r["dst"]) for r in graph.edges.filter("edge_class = 'generated' AND contains(src, 'client.ts:')").collect()}
    assert got == {
        ("front/client.ts:load", "back/api.py:/api/items/{item_id}"),
        ("front/client.ts:save", "back/api.py:/api/items/"),
        ("front/client.ts:seven", "back/api.py:/api/items/static/7"),
        ("front/client.ts:health", "back/server.js:/health"),
    }
    assert CodeStructure(graph).impact("back/api.py:one", depth=3)["meta"]["total"] == 3
    assert {r["dst"] for r in graph.edges.filter("src = 'back/server.js:/health' AND edge_class = 'generated'").collect()} == {"back/server.js:check"}
