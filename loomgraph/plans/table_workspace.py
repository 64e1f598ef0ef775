"""A workspace of source files made from the tables, so that extraction and linking run over them.

Every supplier has a Python module, a router and a script; its class extends that of its nation, and that
the one of its region. What the engine finds in the files is known beforehand from the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import storage
from loomgraph.plans.code_graph import Graph, build
from loomgraph.plans.questions import CodeStructure, kept
from loomgraph.plans.star_graph import table

#: Templates by path; %S, %P, %N and %R are the keys of a supplier, the one behind it, its nation and its region.
SUPPLIER = {
    "src/suppliers/s%S.py": '''"""Supplier %S."""
import os
from src.nations.n%N import Nation%N
from src.shared import audit as log
from src.suppliers.s%P import make_%P

LIMIT = 10


class Supplier%S(Nation%N):
    """Supplies %S."""

    def ship(self, order, *args):
        log(order)
        self.stamp()
        return self.rank()

    async def rank(self):
        return len(self.label())

    def _hidden(self):
        return None


@cached
def make_%S(item: Supplier%S, other):
    item.ship(other)
    other.ship(item)

    def inner(x):
        return make_%P(x)

    return inner
''',
    "src/api/s%S.py": '''from fastapi import APIRouter
from src.shared import audit as log
from src.suppliers.s%S import make_%S

router = APIRouter(prefix="/suppliers")


@router.get("/%S/{item}")
def read_%S(item):
    return make_%S(item, None)


@router.post("/%S/{item}")
def write_%S(item, log):
    log(item)
    return make_%S(item, log)
''',
    "web/src/s%S.ts": '''import { helper as run } from './lib';
import { Panel } from './lib';

export class View%S extends Panel {
  private box: Panel;

  load(id: string) {
    this.draw(id);
    this.box.draw(id);
    return run(id);
  }
}

export const open%S = async (id: string) => {
  const view = new View%S();
  view.load(id);
  return fetch(`/api/suppliers/%S/${id}`);
};
''',
}
NATION = {
    "src/nations/n%N.py": '''from src.regions.r%R import Region%R as Parent


class Nation%N(Parent):
    region = models.ForeignKey(Region%R, on_delete=1)

    def label(self):
        return self.stamp()
''',
}
REGION = {
    "src/regions/r%R.py": '''class Region%R:
    def stamp(self):
        return audit(self)

    def label(self):
        return None
''',
}
FIXED = {
    "src/shared/__init__.py": "from src.shared.audit import audit\n",
    "src/shared/audit.py": "def audit(x):\n    return x\n",
    "web/src/lib/index.ts": "export { helper } from './helper';\nexport * from './panel';\n",
    "web/src/lib/helper.ts": "export function helper(id) {\n  return id;\n}\n",
    "web/src/lib/panel.ts": "export class Panel {\n  draw(id) {\n    return id;\n  }\n}\n",
    "README.md": "# Suppliers\n\nNo code.\n",
    "src/broken.py": "def (:\n",
}

#: A second workspace, of applications: routes and middleware of all kinds, and requests to them.
WEB = {
    "src/apps/s%S.py": '''from fastapi import FastAPI

app = FastAPI()


@app.middleware("http")
async def timing_%S(request, call_next):
    return await call_next(request)


@app.get("/health/%S")
def health_%S():
    return 1
''',
    "src/modules/m%S/api.py": '''@router.get("/list")
def list_%S():
    return 1
''',
    "src/names/s%S.py": '''def get_refunds%S():
    return 1
''',
    "web/src/c%S.ts": '''const getPingUrl = (id) => `/api/ping/%S`;
export const byModule%S = () => fetch('/api/m%S/list');
export const byName%S = () => apiFetch('/api/refunds%S');
export const byBuilder%S = () => customFetch<Ping>(getPingUrl(1), { method: 'GET' });
export const wrongMethod%S = () => fetch('/api/health/%S', { method: 'DELETE' });
''',
    "web/app/api/parts/%S/[id]/route.ts": '''export async function GET(request) {
  return load%S(request);
}
function load%S(request) {
  return request;
}
''',
    "srv/s%S.js": '''const inner = require('./inner%S');
const app = express();
app.use(cors());
app.use('/v%S', inner);
app.get('/ping/%S', (req, res) => {
  return log%S(req);
});
function log%S(x) {
  return x;
}
''',
    "srv/inner%S.js": '''const sub = express.Router();
const last = require('./last%S');
sub.use('/in', last);
sub.get('/top', (a) => 1);
module.exports = sub;
''',
    "srv/last%S.js": '''const end = express.Router();
end.get('/deep', (a) => 1);
module.exports = end;
''',
    "web/nest/s%S.ts": '''@Controller('cats/%S')
export class Cats%S {
  @Get(':id')
  find%S(id: string) {
    return id;
  }
}
''',
    "web/views/s%S.tsx": '''export const routes%S = t.router({ list%S: p.query(() => 1), add%S: p.input(z).mutation(() => 2) });
export function App%S() {
  return <Route path="/app/%S" element={<Home%S />} />;
}
function Home%S() {
  return 1;
}
''',
}

#: The tables that the templates are filled from, for SQL.
KEYS_SQL = """
  s AS (
    SELECT s_suppkey::VARCHAR AS s, n_nationkey::VARCHAR AS n, n_regionkey::VARCHAR AS r, (s_suppkey + 1)::VARCHAR AS p,
           s_suppkey + 1 IN (SELECT s_suppkey FROM supplier) AS has_p
    FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  n AS (SELECT n_nationkey::VARCHAR AS n, n_regionkey::VARCHAR AS r FROM nation),
  r AS (SELECT r_regionkey::VARCHAR AS r FROM region)"""


def files(spark: SparkSession, sf_dir: str, web: bool = False) -> DataFrame:
    """path, content of every file of the first workspace, or of the second."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    keys = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").alias("S"), F.col("n_nationkey").alias("N"), F.col("n_regionkey").alias("R"), (F.col("s_suppkey") + 1).alias("P"))

    keys = dealt(keys)

    def filled(rows: DataFrame, templates: dict[str, str]) -> DataFrame:
        def fill(text: str):
            out = F.lit(text)
            for c in rows.columns:
                out = F.replace(out, F.lit(f"%{c}"), F.col(c).cast("string"))
            return out

        each = F.explode(F.array(*(F.struct(fill(p).alias("path"), fill(t).cast("binary").alias("content")) for p, t in templates.items())))
        return rows.select(each.alias("f")).select("f.*")

    if web:
        return filled(keys, WEB)
    fixed = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in FIXED.items()], "path string, content binary")
    nations = n.select(F.col("n_nationkey").alias("N"), F.col("n_regionkey").alias("R"))
    return filled(keys, SUPPLIER).union(filled(nations, NATION)).union(filled(r.select(F.col("r_regionkey").alias("R")), REGION)).union(fixed)


#: Rows of keys whose files are made, and read, in one task.
KEYS = 256


def dealt(keys: DataFrame) -> DataFrame:
    """keys in tasks of about KEYS rows: the few bytes of a key don't tell what work its files are."""
    tasks = -(-keys.count() // KEYS)
    return keys.repartition(tasks, "S") if tasks > 1 else keys


_BUILT: dict[tuple, Graph] = {}


def graph(spark: SparkSession, sf_dir: str, web: bool = False) -> Graph:
    """The graph of files(), built once in a session for each state of the tables, as an index is."""
    key = (spark.sparkContext.applicationId, sf_dir, web, *(storage.signature(spark, f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation", "region")))
    if key not in _BUILT:
        _BUILT[key] = build(files(spark, sf_dir, web))
    return _BUILT[key]


_NAMED: dict[int, tuple[Graph, Graph]] = {}


def structure(spark: SparkSession, sf_dir: str, web: bool = False) -> CodeStructure:
    """Questions over graph(); its nodes and edges without inline callbacks are written once as well, as an index keeps them."""
    own = graph(spark, sf_dir, web)
    if id(own) not in _NAMED:
        _NAMED[id(own)] = own, kept(own)
    return CodeStructure(_NAMED[id(own)][1], "/work")


def expected(columns: str, supplier=(), linked=(), nation=(), region=(), fixed=()) -> str:
    """SQL for rows that follow from the templates: for each supplier, each with one behind it, and so on.

    columns: names and types. In the rows' texts %S, %P, %N and %R stand for keys, as in the templates.
    """
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = [c.split()[1] for c in columns.split(", ")]

    def one(rows, source, keys):
        value = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
        body = ", ".join("(" + ", ".join(f"CAST({value(v)} AS {k})" for v, k in zip(row, kinds)) + ")" for row in rows)

        def fill(name, kind):
            out = f"t.{name}"
            for k in keys if kind == "VARCHAR" else "":
                out = f"replace({out}, '%{k}', {source.split()[0]}.{k.lower()})"
            return f"{out} AS {name}"

        return f"SELECT {', '.join(map(fill, names, kinds))} FROM (VALUES {body}) AS t({', '.join(names)})" + (f", {source}" if keys else "")

    given = [(supplier, "s", "SPNR"), (linked, "s WHERE has_p", "SPNR"), (nation, "n", "NR"), (region, "r", "R"), (fixed, "", "")]
    return f"WITH {KEYS_SQL} " + " UNION ALL ".join(one(rows, source, keys) for rows, source, keys in given if rows)
