import json

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Row, functions as F

from quarry.functions.spans import SPAN
from quarry.operators import graph, model, nesting, resolve, retrieve, search, validate, vectors
from quarry.operators.answers import Tools, classify_intent
from quarry.operators.components import connected_components
from quarry.pipeline import index_repository
from quarry.sources import repository
from quarry.sources.store import Store, canonical_json, table_digest
from quarry.syntax.engine import parse_files, parse_one


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 8)), max_size=12))
def test_innermost_equals_brute_force(spark, raw):
    rows = [("k", f"{i:02}", s, s + n) for i, (s, n) in enumerate(raw)]
    df = spark.createDataFrame(rows, "key string, id string, start bigint, end bigint")
    got = {r.id: r.parent for r in nesting.innermost(df).collect()}
    for _, i, s, e in rows:
        around = [(s2, -e2, j) for _, j, s2, e2 in rows if s2 <= s and e2 >= e and (s2, -e2, j) < (s, -e, i)]
        assert got[i] == (max(around)[2] if around else None)


def test_enclosing_points(spark):
    df = spark.createDataFrame([("k", "m", 0, 100), ("k", "c", 10, 50), (None, "n", 0, 5)], "key string, id string, start bigint, end bigint")
    p = spark.createDataFrame([("k", "p", 20, 20), ("k", "q", 60, 60), ("z", "r", 1, 1)], "key string, id string, start bigint, end bigint")
    assert {r.id: r.parent for r in nesting.innermost(df, p).collect()} == {"p": "c", "q": "m", "r": None}


def test_overloads_and_ordinals(spark):
    df = spark.createDataFrame([("f", "METHOD", "a:b", "x", 1), ("f", "METHOD", "a:b", "y", 2), ("f", "METHOD", "a:b", "y", 3), ("f", "CLASS", "a:b", None, 4)], "path string, symbol_type string, qualified_name string, signature string, n int")
    named = model.overload_names(df, "path").withColumn("id", F.concat_ws("|", "symbol_type", "id_name"))
    got = {r.n: r.id for r in model.ordinal_suffix(named, "id", "n").collect()}
    assert got[4] == "CLASS|a:b" and got[3] == got[2] + "~1" and got[1] != got[2] and "#" in got[1]


def test_python_backend_golden():
    f = parse_one(b"import a, b as c\nfrom .d import e\nclass A(B):\n    def m(self, x: T):\n        self.y = x\n        self.y.run(f(1))\n", "python", "p/q.py")
    assert [s["qualified_name"] for s in f.symbols] == ["p.q", "p.q:A", "p.q:A.m"] and f.symbols[2]["symbol_type"] == "METHOD"
    assert [i["module"] for i in f.imports] == ["a", "b", ".d"] and f.inherits[0]["base"] == "B"
    assert {(c["receiver"], c["callee"]) for c in f.calls} == {("self.y", "run"), (None, "f")}
    assert {(b["scope"], b["name"], b["type_name"]) for b in f.bindings} == {("PARAMETER", "x", "T"), ("INSTANCE", "y", "x")}


@pytest.mark.parametrize(
    "language, source, names",
    [
        ("javascript", "export class A extends B {\n  run(x) {\n    f(x);\n  }\n}\nconst g = (a) => {\n  return a;\n};\n", {"A": "CLASS", "run": "METHOD", "g": "FUNCTION"}),
        ("typescript", "interface I {\n  a: string;\n}\nexport type T = I;\nenum E { A }\nfunction f<T>(x: T): T {\n  return x;\n}\n", {"I": "INTERFACE", "T": "TYPE_ALIAS", "E": "ENUM", "f": "FUNCTION"}),
        ("java", "import a.B;\npublic class C extends D {\n  public C(int x) {\n  }\n  int m() {\n    return n();\n  }\n}\n", {"C": "CLASS", "m": "METHOD"}),
        ("go", 'package a\nimport "x/y"\ntype S struct {\n}\nfunc (s *S) M() {\n\tF()\n}\nfunc F() {\n}\n', {"S": "CLASS", "M": "METHOD", "F": "FUNCTION"}),
        ("rust", "struct S {}\ntrait T {}\nfn f() {\n}\nimpl T for S {\n    fn m(&self) {\n    }\n}\n", {"S": "CLASS", "T": "INTERFACE", "f": "FUNCTION", "m": "METHOD"}),
        ("ruby", "class A\n  def m\n  end\nend\n", {"A": "CLASS", "m": "METHOD"}),
        ("php", "<?php\nclass A extends B {\n  public function m() {\n  }\n}\n", {"A": "CLASS", "m": "METHOD"}),
        ("kotlin", "class A {\n  fun m() {\n  }\n}\n", {"A": "CLASS", "m": "METHOD"}),
        ("swift", "protocol P {\n}\nstruct S {\n  func m() {\n  }\n}\n", {"P": "INTERFACE", "S": "CLASS", "m": "METHOD"}),
        ("scala", "trait T {\n}\nobject O {\n  def m(x: Int) = {\n  }\n}\n", {"T": "INTERFACE", "O": "MODULE", "m": "METHOD"}),
        ("c", "struct s {\n  int a;\n};\nint f(int x) {\n  return g(x);\n}\n", {"s": "CLASS", "f": "FUNCTION"}),
        ("cpp", "namespace n {\nclass A {\n};\n}\n", {"n": "MODULE", "A": "CLASS"}),
        ("csharp", "namespace N {\n  class A : B {\n    public void M(int x) {\n    }\n  }\n}\n", {"N": "MODULE", "A": "CLASS", "M": "METHOD"}),
        ("lua", "function f(x)\nend\n", {"f": "FUNCTION"}),
        ("bash", "f() {\n  g\n}\n", {"f": "FUNCTION"}),
        ("dart", "class A {\n  void m() {\n  }\n}\n", {"A": "CLASS", "m": "METHOD"}),
    ],
)
def test_rule_backends(language, source, names):
    f = parse_one(source.encode(), language, "x")
    got = {(s["name"], s["symbol_type"]) for s in f.symbols[1:]}
    assert set(names.items()) <= got and f.parse_status == "OK"


def test_backends_never_raise():
    for source in (b"", b"\xff\xfe\0", b"(" * 3000, "def é(".encode(), b"class A {" * 500):
        for language in ("python", "javascript", "go", "cobol", None):
            parse_one(source, language, "x")
    assert parse_one(b"", "python", "x").parse_status == "EMPTY" and parse_one(b"x", "cobol", "x").parse_status == "UNSUPPORTED"
    assert parse_one(b"def f(:\n", "python", "x").parse_status == "FAILED"


def test_model_of_a_repository(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg/store.py").write_text("class Store:\n    def save(self, x):\n        return x\n")
    (tmp_path / "pkg/service.py").write_text("from pkg.store import Store\n\n\nclass Service:\n    def __init__(self, store: Store):\n        self.store = store\n\n    def run(self):\n        return self.store.save(1)\n")
    (tmp_path / "broken.py").write_text("class Broken:\n    def f(self\n")
    (tmp_path / "x.png").write_bytes(b"\0")
    root = str(tmp_path)
    a = index_repository(spark, root)
    assert a.is_valid() and a.published and (a.stats.parsed, a.stats.reused, a.stats.degraded) == (3, 0, 1)
    b = index_repository(spark, root)
    assert b.model_version == a.model_version and (b.stats.parsed, b.stats.reused) == (0, 3)
    (tmp_path / "pkg/store.py").write_text("class Store:\n    def save(self, x):\n        return x + 1\n")
    c = index_repository(spark, root)
    assert c.parent_version == a.model_version and (c.stats.parsed, c.stats.reused) == (1, 2)
    clean = index_repository(spark, root, index_dir=str(tmp_path.parent / "other"), persist=False)
    for t in ("files", "symbols", "relationships", "evidence", "chunks", "calls", "imports", "bindings", "resolutions"):
        assert table_digest(c.tables[t]).first() == table_digest(clean.tables[t]).first(), t
    home = Store(str(tmp_path / ".quarry"))
    assert home.active() == c.model_version and len(home.versions()) == 2
    home.rollback(a.model_version)
    assert home.active() == a.model_version and home.read(spark, "symbols").count() == a.tables["symbols"].count()

    parsed = parse_files(spark.createDataFrame([(p, bytearray((tmp_path / p).read_bytes())) for p in ("pkg/store.py", "pkg/service.py")], "path string, content binary"))
    files = spark.createDataFrame([("pkg/store.py", "1", None, ""), ("pkg/service.py", "2", None, "")], "path string, id string, language string, text string")
    symbols = model.symbol_table(parsed, files, F.lit("v"))
    calls = parsed.select("path", F.explode("calls").alias("c")).select("path", "c.enclosing", "c.receiver", "c.callee", F.col("c.callee").alias("call_id"))
    bindings = parsed.select("path", F.explode("bindings").alias("b")).select("path", "b.enclosing", "b.name", "b.type_name", "b.scope")
    imports = parsed.select("path", F.explode("imports").alias("i")).select("path", "i.module", F.explode("i.names").alias("name"))
    r = resolve.resolve_calls(calls, symbols, imports, bindings).first()
    target = symbols.where("qualified_name = 'pkg.store:Store.save'").first().id
    assert (r.call_id, r.target_id, r.rung, r.resolution_status) == ("save", target, 1, "RESOLVED_EXACT")


@pytest.mark.parametrize(
    "language, source, status",
    [
        ("go", "package a\n\nfunc f( {\n}\n", "PARTIAL"), ("go", "package a\n", "OK"), ("rust", "pub fn f( -> u8 {\n}\n", "FAILED"), ("c", "int f( {\n  return 0;\n}\n", "FAILED"), ("c", "int g(int x) {\n  return x;\n}\nint f( {\n", "PARTIAL"),
        ("java", "class A {\n  void f( {\n}\n", "FAILED"), ("java", "import a.B;\nclass A {\n  void f( {\n}\n", "PARTIAL"), ("javascript", "class A {\n  f( {\n  }\n", "FAILED"), ("typescript", "const a = 1;\nclass A {\n  f( {\n  }\n", "PARTIAL"),
        ("ruby", "class A\n  def f(\nend\n", "FAILED"), ("ruby", "class A\n  def f\n    g if h\n    x.each do |y|\n    end\n    while a do\n    end\n  end\nend\n", "OK"), ("lua", "if a then\n  b()\nelseif c then\n  d()\nend\nrepeat\n  e()\nuntil f\n", "OK"), ("lua", "function f()\n", "FAILED"),
        ("haskell", "main = putStrLn (\n", "OK"), ("bash", "", "EMPTY"), ("cobol", "x", "UNSUPPORTED"), ("python", "import a\n\ndef f(:\n    pass\n", "PARTIAL"),
    ],
)
def test_status_ladder(language, source, status):
    f = parse_one(source.encode(), language, "x")
    assert f.parse_status == status
    assert (f.parse_error is not None) == (status in ("PARTIAL", "FAILED"))
    assert any(d["code"] == "parse.no_clean_statements" for d in f.diagnostics) == (status == "FAILED")
    assert any(d["code"] == "extract.no_query" for d in f.diagnostics) == (language == "haskell")


def test_diagnostics_of_one_file_are_bounded_and_say_how_many_there_were():
    row = parse_one(b"x ] y\n" * 250, "c", "x").row("x")
    codes = [d["code"] for d in row["diagnostics"]]
    assert codes.count("parse.error_node") == 100 and codes[100:] == ["parse.truncated", "parse.no_clean_statements"] and row["diagnostics"][100]["message"].startswith("151 ")


def test_deep_nesting_of_python():
    source = "".join(" " * i + "if x:\n" for i in range(300)) + " " * 300 + "f(1)\nclass A:\n    def m(self):\n        pass\n"
    f = parse_one(source.encode(), "python", "x.py")
    assert f.parse_status == "OK" and f.max_depth > 300 and [c["callee"] for c in f.calls] == ["f"] and [s["name"] for s in f.symbols] == ["x", "A", "m"]


@pytest.mark.parametrize(
    "language, source, fields",
    [
        ("javascript", "class A {\n  x = 1;\n  static y;\n  m() {\n    z = 2;\n  }\n}\n", {"x", "y"}), ("typescript", "class A {\n  private readonly x: string;\n  m(): void {\n    let y = 1;\n  }\n}\n", {"x"}), ("java", "class A {\n  private final List<String> x = f();\n  int y;\n  void m() {\n    int z = 1;\n  }\n}\n", {"x", "y"}),
        ("go", "package a\n\ntype S struct {\n\tName string\n\tMap map[string]int\n}\n", {"Name", "Map"}), ("rust", "struct S {\n    pub a: u8,\n    b: Vec<u8>,\n}\n", {"a", "b"}), ("c", "struct s {\n  int a;\n  char b[4];\n};\n", {"a", "b"}), ("csharp", "class A {\n  private int x;\n}\n", {"x"}), ("php", "<?php\nclass A {\n  private $x = 1;\n}\n", {"x"}),
        ("kotlin", "class A {\n  val x = 1\n}\n", {"x"}), ("kotlin", "class A(val y: Int, z: List<Int>) {\n}\n", {"y", "z"}), ("swift", "struct A {\n  let x: Int\n}\n", {"x"}), ("dart", "class A {\n  final int x;\n}\n", {"x"}), ("bash", "X=1\nf() {\n  local y=2\n}\n", {"X", "y"}), ("cpp", "class A {\n  int x_;\n};\n", {"x_"}),
    ],
)
def test_fields(language, source, fields):
    f = parse_one(source.encode(), language, "x")
    assert {s["name"] for s in f.symbols if s["symbol_type"] == "FIELD"} == fields


@pytest.mark.parametrize(
    "language, source, symbols",
    [
        ("java", "package a.b;\ninterface I {\n  boolean f(String x) throws E;\n  default void g() {\n    h(1);\n  }\n}\n", [("a.b", "MODULE"), ("I", "INTERFACE"), ("f", "METHOD"), ("g", "METHOD")]),
        ("typescript", "interface I {\n  f(x: string): boolean;\n}\nabstract class A {\n  abstract g(): void;\n  m(): void {\n    this.n(1);\n  }\n}\n", [("I", "INTERFACE"), ("f", "METHOD"), ("A", "CLASS"), ("g", "METHOD"), ("m", "METHOD")]),
        ("dart", "abstract class A {\n  A(this.x);\n  bool f(String y);\n}\nString g(String v) => v;\n", [("A", "CLASS"), ("A", "CONSTRUCTOR"), ("f", "METHOD"), ("g", "FUNCTION")]),
        ("csharp", "interface I {\n  bool F(string x);\n}\n", [("I", "INTERFACE"), ("F", "METHOD")]), ("go", "package a\n", [("a", "MODULE")]), ("php", "<?php\nnamespace A\\B;\n", [("A\\B", "MODULE")]), ("swift", "class A {\n  init(x: Int) {\n  }\n}\n", [("A", "CLASS"), ("init", "CONSTRUCTOR")]),
        ("c", "typedef struct s s_t;\nint f(int x) {\n  return g(x);\n}\n", [("s_t", "TYPE_ALIAS"), ("f", "FUNCTION")]), ("cpp", "class A {\n  virtual int f(int x) const = 0;\n};\n", [("A", "CLASS"), ("f", "METHOD")]), ("kotlin", "package a.b\n\nclass A(val x: Int)\n", [("a.b", "MODULE"), ("A", "CLASS"), ("(val x: Int)", "CONSTRUCTOR"), ("x", "FIELD")]),
    ],
)
def test_statements_and_members_without_a_body(language, source, symbols):
    assert [(s["name"], s["symbol_type"]) for s in parse_one(source.encode(), language, "m").symbols[1:]] == symbols


@pytest.mark.parametrize(
    "language, source, docs",
    [
        ("java", "/** The class. */\nclass A {\n  // first\n  // second\n  void m() {\n    // inside\n  }\n}\n", {"x": "The class. */", "A": "first", "m": "inside"}), ("go", "// Package a.\npackage a\n", {"x": "Package a."}), ("ruby", "class A\n  # of A\n  def m\n  end\nend\n", {"A": "of A"}),
        ("python", '"""Module."""\n\nclass A:\n    """Class."""\n\n    def m(self):\n        # note\n        return "# no"\n', {"x": "Module.", "A": "Class.", "m": "note"}), ("python", "# head\nx = 1\n", {"x": "head"}), ("javascript", "const s = '// no';\n", {}),
    ],
)
def test_documentation_is_the_earliest_comment_directly_inside(language, source, docs):
    f = parse_one(source.encode(), language, "x")
    assert {s["name"]: s["documentation"] for s in f.symbols if s["documentation"]} == docs


@pytest.mark.parametrize(
    "language, source, bases",
    [
        ("java", "class A extends B implements C, D<E> {\n}\n", ["B", "C"]), ("typescript", "class A extends B implements C {\n}\ninterface I extends J {\n}\n", ["B", "C", "J"]), ("javascript", "class A extends B {\n}\n", ["B"]), ("cpp", "class A : public B, private C {\n};\n", ["B", "C"]), ("csharp", "class A : B, C {\n}\n", ["B", "C"]),
        ("ruby", "class A < B\nend\n", ["B"]), ("php", "<?php\nclass A extends B implements C {\n}\n", ["B", "C"]), ("kotlin", "class A : B(), C {\n}\n", ["B", "C"]), ("swift", "class A: B, C {\n}\n", ["B", "C"]), ("scala", "class A extends B with C {\n}\n", ["B", "C"]), ("dart", "class A extends B implements C {\n}\n", ["B", "C"]), ("rust", "impl T for S {\n}\n", ["T"]), ("python", "class A(B, c.D):\n    pass\n", ["B"]),
    ],
)
def test_inheritance(language, source, bases):
    assert [i["base"] for i in parse_one(source.encode(), language, "x").inherits] == bases


def test_scan_opens_no_ignored_directory_and_reads_hidden_names(spark, tmp_path):
    for path, content in {"_edge/__init__.py": b"x", ".hidden.py": b"y", "node_modules/a/b.js": b"z", "Node_Modules/c.js": b"z", "a.png": b"w", "sub/.git/config": b"", "empty.py": b"", "r.lock": b""}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(content)
    rows = {r.path: r for r in repository.classify(repository.read_files(spark, str(tmp_path))).collect()}
    assert {p for p, r in rows.items() if r.decision == "KEPT"} == {"_edge/__init__.py", ".hidden.py", "empty.py"}
    assert {p: r.pruned for p, r in rows.items() if r.decision == "PRUNED"} == {"node_modules/": "node_modules", "Node_Modules/": "Node_Modules", "sub/.git/": "sub/.git"}
    assert rows["a.png"].decision == "IGNORED" and rows["a.png"].content is None and bytes(rows[".hidden.py"].content) == b"y" and rows["empty.py"].parse_status == "EMPTY"
    assert {(r.path, r.reason) for r in repository.exclusion_ledger(repository.classify(repository.read_files(spark, str(tmp_path)))).collect()} == {(x, "IGNORED") for x in ("node_modules", "Node_Modules", "sub/.git", "a.png", "r.lock")}
    with pytest.raises(NotADirectoryError):
        repository.read_files(spark, str(tmp_path / "a.png"))


def test_a_broken_pointer_makes_everything_new(spark, tmp_path):
    (tmp_path / "a.py").write_text("def f():\n    return g()\n")
    first = index_repository(spark, str(tmp_path))
    home = Store(str(tmp_path / ".quarry"))
    (tmp_path / ".quarry/_pointers/999999999999.json").write_text("{")
    assert home.active() is None
    again = index_repository(spark, str(tmp_path), persist=False)
    assert again.model_version == first.model_version and (again.stats.parsed, again.stats.reused) == (1, 0)


def test_every_injected_fault_is_found(spark):
    loc = Row(start_line=1, start_col=0, end_line=2, end_col=0)
    bad = Row(start_line=3, start_col=-1, end_line=2, end_col=0)
    s = spark.createDataFrame([("ok", "f", "n", "m:n", "CLASS", loc, "v"), ("bad", "f", "", "m", "CLASS", bad, None)], f"id string, file_id string, name string, qualified_name string, symbol_type string, location {SPAN}, model_version string")
    got = {(r.entity_id, r.rule) for r in validate.symbol_problems(s).collect()}
    assert got == {("bad", x) for x in ("symbol.name.missing", "symbol.qualified_name.no_module", "version.missing", "span.start_col", "span.order")}
    good, rejected = validate.valid_and_rejected(s)
    assert [r.id for r in good.collect()] == ["ok"] and rejected.count() == 5
    claims = spark.createDataFrame([("a", "x", "CALLS", "y"), ("a", "x", "CALLS", "z"), ("b", "x", "CALLS", "y"), ("c", None, None, None)], "answer_id string, source string, kind string, target string")
    edges = spark.createDataFrame([("x", "CALLS", "y")], "source string, kind string, target string")
    assert {r.answer_id: r.verdict for r in validate.claim_verdicts(claims, edges).collect()} == {"a": "FAIL", "b": "PASS", "c": "INSUFFICIENT"}


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "source string, target string")


def nodes_of(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_graph(spark):
    e = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", None), ("a", "b")])
    assert {(r.node, r.distance) for r in graph.reachable(e, nodes_of(spark, "a"), 9).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3), ("e", 4)}
    assert {(r.node, r.distance) for r in graph.impacted(e, nodes_of(spark, "e"), 2).collect()} == {("e", 0), ("d", 1), ("c", 2)}
    assert {(r.node, r.length) for r in graph.cyclic_nodes(e, 5).collect()} == {("a", 3), ("b", 3), ("c", 3)}
    p = graph.trace_paths(e, nodes_of(spark, "a"), nodes_of(spark, "e"), 6).first()
    assert p.path == ["a", "b", "c", "d", "e"] and p.hops == 4
    assert graph.callers(e, nodes_of(spark, "b")).count() == 1 and graph.callees(e, nodes_of(spark, "c")).count() == 2


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=12))
def test_components(spark, pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in parent}


def test_search_and_budget(spark):
    d = spark.createDataFrame([(1, "the cat sat"), (2, "cat cat dog"), (3, None), (4, ""), (5, "Cat!")], "id bigint, text string")
    best = search.bm25(d, ["cat"], 10).collect()
    assert {r.id for r in best} == {1, 2, 5} and [r.position for r in best] == [1, 2, 3]
    assert search.bm25(d.limit(0), ["cat"], 5).count() == 0
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "vec_id bigint, embedding array<float>")
    got = [(r.vec_id, r.position) for r in search.nearest(v, v.where("vec_id = 1"), 2).orderBy("position").collect()]
    assert got == [(2, 1), (3, 2)]
    r = spark.createDataFrame([("g", 1, 5), ("g", 2, 4), ("g", 3, 9), ("h", 1, 9), (None, 1, 3), ("h", 2, None)], "repo string, rank int, tokens int")
    assert {(x.repo, x.position, x.running) for x in search.within_budget(r, 9, "repo", ["rank"]).collect()} == {("g", 1, 5), ("g", 2, 9), ("h", 1, 9), ("h", 2, 9), (None, 1, 3)}
    f = search.fuse([spark.createDataFrame([("a", 1), ("b", 2)], "id string, position int"), spark.createDataFrame([("b", 1)], "id string, position int")], 5).collect()
    assert [x.id for x in f] == ["b", "a"]


def test_index_ranks_as_the_scan(spark):
    d = spark.createDataFrame([(i, " ".join(w for j, w in enumerate(("cat", "dog", "sat", "mat")) if (i * 7 + j * j) % (j + 2))) for i in range(60)] + [(60, None), (61, ""), (62, "!?")], "id bigint, text string")
    for words in (["cat"], ["dog", "mat", "cat"], ["none"]):
        assert [tuple(r) for r in search.bm25_indexed(search.inverted_index(d), search.text_sizes(d), words, 9).orderBy("position").collect()] == [tuple(r) for r in search.bm25(d, words, 9).orderBy("position").collect()]
    assert search.inverted_index(d.limit(0)).count() == 0


def test_vector_index_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in centres[i % 12] + 0.6 * rng.normal(size=16)]) for i in range(1500)] + [(1500, None), (None, [1.0] * 16), (1501, [0.0] * 16)]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    queries = v.where("vec_id % 20 = 0 and vec_id < 1500")
    centroids = vectors.fit(v)
    index = vectors.build(v, centroids)
    assert index.count() == 1500
    got = {(r.query_id, r.vec_id) for r in vectors.search(index, centroids, queries, 5, 10).collect()}
    want = {(r.query_id, r.vec_id) for r in search.nearest(v, queries, 5).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got) == len(want)
    exact = {(r.query_id, r.vec_id, r.score) for r in vectors.search(index, centroids, queries, 5, len(centroids)).collect()}
    assert exact == {(r.query_id, r.vec_id, r.score) for r in search.nearest(v, queries, 5).collect()}
    blocks = vectors.BLOCK, vectors.QUERY_BLOCK
    try:
        vectors.BLOCK, vectors.QUERY_BLOCK = 7, 2  # blocks of a hot list
        assert exact == {(r.query_id, r.vec_id, r.score) for r in vectors.search(index, centroids, queries, 5, len(centroids)).collect()}
    finally:
        vectors.BLOCK, vectors.QUERY_BLOCK = blocks
    assert vectors.search(vectors.build(v.limit(0), vectors.fit(v.limit(0))), vectors.fit(v.limit(0)), queries.limit(0), 5, 3).count() == 0


def test_hybrid(spark):
    rank = lambda *i: spark.createDataFrame([(x, n + 1) for n, x in enumerate(i)], "id bigint, position int")
    texts = spark.createDataFrame([(1, "a" * 40), (2, "b" * 40), (3, "a" * 40), (4, "c" * 40), (5, None), (6, "d" * 400)], "id bigint, text string")
    edges = spark.createDataFrame([(1, 4), (6, 2), (None, 1), (9, 8)], "source bigint, target bigint")
    got = [(r.id, r.position, r.running) for r in retrieve.hybrid([rank(1, 2, 5), rank(3, 1)], edges, texts, 3, 35).orderBy("position").collect()]
    assert [g[0] for g in got] == [1, 4, 2] and [g[2] for g in got] == [10, 20, 30]  # 3 is a copy of 1, 5 has no text, 6 is beyond the budget


def test_context_of_a_question(spark):
    symbols = spark.createDataFrame([("s1", "save"), ("s2", "run"), ("s3", "other")], "id string, name string")
    chunks = spark.createDataFrame([("c1", "s1", "def save(): pass"), ("c2", "s2", "def run(): store()"), ("c3", "s3", "nothing of interest"), ("c4", None, None)], "id string, symbol_id string, text string")
    edges = edges_of(spark, [("s2", "s1"), ("s3", None)])
    assert [r.id for r in retrieve.context("Who calls save?", symbols, chunks, edges).orderBy("position").collect()] == ["c1", "c2"]
    assert retrieve.context("?!", symbols, chunks, edges).count() == 0


def test_command_line(spark, tmp_path, capsys):
    from quarry.cli import main

    (tmp_path / "a.py").write_text("def run():\n    return helper()\n\n\ndef helper():\n    return 1\n")
    (tmp_path / "bad.py").write_text("def f(:\n")
    root = str(tmp_path)
    assert main(["status", root, "--json"]) == 1 and main(["index", root]) == 0
    capsys.readouterr()
    assert main(["status", root, "--json"]) == 0
    status = json.loads(capsys.readouterr().out)
    assert [d["path"] for d in status["degraded"]] == ["bad.py"] and status["statuses"] == {"OK": 1, "FAILED": 1}
    assert main(["ask", root, "what does helper do", "--json"]) == 0 and json.loads(capsys.readouterr().out)["rows"]
    assert main(["inspect", root, "helper", "--json", "--limit", "5"]) == 0 and json.loads(capsys.readouterr().out)["symbols"][0]["name"] == "helper"
    assert main(["export", root, str(tmp_path / "out"), "--json"]) == 0
    names = [x["qualified_name"] for x in json.loads((tmp_path / "out/symbols.json").read_text())]
    assert names == sorted(names) and "a:helper" in names
    assert {x["path"] for x in json.loads((tmp_path / "out/manifest.json").read_text())} == {"a.py", "bad.py"}


def test_hops_have_their_edges_and_evidence(spark):
    e = edges_of(spark, [("a", "b"), ("b", "c")]).withColumn("id", F.concat("source", "target"))
    shown = spark.createDataFrame([("ab", "e2"), ("ab", "e1")], "entity_id string, evidence_id string")
    paths = graph.trace_paths(e, nodes_of(spark, "a"), nodes_of(spark, "c"), 3)
    assert [tuple(r) for r in graph.path_evidence(paths, e, shown).orderBy("hop").collect()] == [("a", "c", 1, "a", "b", "ab", "e1"), ("a", "c", 2, "b", "c", "bc", None)]


def test_incremental_resolution_sees_names_that_come_and_go(spark, tmp_path):
    (tmp_path / "a.py").write_text("def run():\n    return helper()\n")
    (tmp_path / "b.py").write_text("x = 1\n")
    root = str(tmp_path)
    status = lambda r: [x.resolution_status for x in r.tables["resolutions"].collect()]
    assert status(index_repository(spark, root)) == ["UNRESOLVED"]
    (tmp_path / "b.py").write_text("def helper():\n    return 1\n")
    assert status(index_repository(spark, root)) == ["RESOLVED_LIKELY"]
    (tmp_path / "b.py").unlink()
    assert status(index_repository(spark, root)) == ["UNRESOLVED"]


def test_intents_and_tools(spark):
    q = spark.createDataFrame([("who calls save?",), ("what breaks if I change it",), ("hello",), (None,)], "q string")
    assert [r.i.intent for r in q.select(classify_intent(F.col("q")).alias("i")).collect()] == ["FIND_CALLERS", "IMPACT", "UNKNOWN", "UNKNOWN"]
    s = spark.createDataFrame([("1", "save", "m:save", None), ("2", "run", "m:run", "saves things")], "id string, name string, qualified_name string, documentation string")
    tools = Tools(spark.createDataFrame([("a.py",)], "path string"), s, spark.createDataFrame([("c", "save it")], "id string, text string"), edges_of(spark, [("2", "1")]))
    assert [r.rung for r in tools.search_symbol("save").collect()] == [1, 5]
    assert [r.node for r in tools.find_callers("save").collect()] == ["2"] and tools.search_code(" ") == {"error": "empty query"}
    assert tools.get_file("a.py").count() == 1 and tools.find_callers("nobody").count() == 0


def test_canonical_json():
    assert canonical_json({"b": 1, "a": "é"}) == json.dumps({"a": "é", "b": 1}, indent=2, ensure_ascii=False)
