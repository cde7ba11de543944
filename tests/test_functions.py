import hashlib

from pyspark.sql import Row, functions as F

from quarry.functions import ids, languages, spans, text
from quarry.sources import repository


def one(spark, **columns):
    return spark.createDataFrame([Row(**columns)])


def test_ids_keep_null_slots(spark):
    df = spark.createDataFrame([("a", None, 3)], "a string, b string, c int")
    got = df.select(ids.digest_id("x_", "a", "b", "c").alias("i")).first().i
    assert got == "x_" + hashlib.sha1(b"a\x1f\x1f3").hexdigest()[:16]


def test_version_is_order_free_and_counts_repeats(spark):
    rows = [("a",), ("b",), ("a",)]
    a = ids.version_id(spark.createDataFrame(rows, "content_hash string")).first()[0]
    b = ids.version_id(spark.createDataFrame(rows[::-1], "content_hash string").repartition(3)).first()[0]
    c = ids.version_id(spark.createDataFrame(rows[:2], "content_hash string")).first()[0]
    assert a == b != c
    want = hashlib.sha1(hashlib.sha256(b"a\na\nb").hexdigest().encode()).hexdigest()[:16]
    assert a == "mv_" + want
    t = ids.tree_version_id(spark.createDataFrame(rows, "content_hash string")).first()[0]
    assert t == ids.tree_version_id(spark.createDataFrame(rows[::-1], "content_hash string")).first()[0]
    assert t != ids.tree_version_id(spark.createDataFrame(rows[:2], "content_hash string")).first()[0]


def test_line_and_token_counts(spark):
    rows = [("",), ("a",), ("a\n",), ("a\nb",), ("\n\n",), (None,)]
    df = spark.createDataFrame(rows, "t string").select(text.line_count("t").alias("n"), text.estimate_tokens("t").alias("k"))
    assert [(r.n, r.k) for r in df.collect()] == [(0, 0), (1, 1), (1, 1), (2, 1), (2, 1), (None, None)]


def test_module_paths(spark):
    cases = {"services/payment_service.py": "services.payment_service", "pkg/__init__.py": "pkg", "src/api/index.ts": "src.api.index"[:7], "a.b/c": "a.b.c", "__init__.py": "__init__", "mod.rs": "mod", "x.tar.gz": "x.tar"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    got = {r.p: r.m for r in df.select("p", text.module_path("p").alias("m")).collect()}
    assert got == cases


def test_signature_and_doc(spark):
    df = one(spark, s="@deco\n# c\n\n  def f(x):\n    pass", d="/** Hello\n * world\n */", q='"""one line"""', m='"""first\nlast"""')
    r = df.select(text.signature_of("s").alias("s"), text.clean_doc("d").alias("d"), text.clean_doc("q").alias("q"), text.clean_doc("m").alias("m")).first()
    assert (r.s, r.d, r.q) == ("def f(x):", "Hello\nworld\n/", "one line")
    assert r.m == '"""first\nlast"""'


def test_slices(spark):
    r = one(spark, t="a\r\nb\nc\n").select(text.slice_lines("t", F.lit(2), F.lit(3)).alias("a"), text.slice_lines("t", F.lit(0), F.lit(1)).alias("b"), text.slice_lines("t", F.lit(5), F.lit(9)).alias("c")).first()
    assert (r.a, r.b, r.c) == ("b\nc", "a", "")


def test_invalid_bytes_become_replacement(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb"),)], "c binary")
    assert df.select(text.decoded("c")).first()[0] == "a�b"


def test_languages(spark):
    paths = {"a/b.PY": "python", "Makefile": "make", "x/Dockerfile": "dockerfile", ".gitignore": "gitignore", ".py": None, "a.unknown": None, "CMakeLists.txt": "cmake", "b.d.ts": "typescript", "noext": None}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.l for r in df.select("p", languages.detect(F.col("p")).alias("l")).collect()} == paths
    assert languages.summary(spark).first().asDict()["registered"] == 61


def test_spans(spark):
    df = spark.createDataFrame([Row(s=Row(start_line=2, start_col=5, end_line=2, end_col=1)), Row(s=Row(start_line=1, start_col=0, end_line=3, end_col=0))], f"s {spans.SPAN}")
    rows = df.select(*(v.alias(k) for k, v in spans.rules(F.col("s")).items()), spans.text(F.col("s")).alias("t"), spans.line_count(F.col("s")).alias("n")).collect()
    assert rows[0].order and not rows[1].order and rows[1].t == "1:0-3:0" and rows[1].n == 3


def test_classification_order(spark):
    files = [
        ("a/node_modules/x.js", b"x"), ("yarn.lock", b"\0"), ("a.png", b"x"), ("bin.py", b"a\0b"), ("gen_pb2.py", b"x"), ("n.py", b"# DO NOT EDIT"), ("e.py", b""), ("r.md", b"x"), ("u.xyz", b"x"), ("s.go", b"package a\n"), ("z.py", None),
    ]
    df = spark.createDataFrame([(p, None if c is None else bytearray(c), 0 if c is None else len(c)) for p, c in files], "path string, content binary, length bigint")
    c = repository.classify(df)
    got = {r.path: (r.decision, r.parse_status) for r in c.collect()}
    assert got == {
        "a/node_modules/x.js": ("PRUNED", None), "yarn.lock": ("IGNORED", None), "a.png": ("IGNORED", None), "bin.py": ("BINARY", None), "gen_pb2.py": ("GENERATED", None), "n.py": ("GENERATED", None),
        "e.py": ("KEPT", "EMPTY"), "r.md": ("KEPT", "UNSUPPORTED"), "u.xyz": ("KEPT", "UNSUPPORTED"), "s.go": ("KEPT", "OK"), "z.py": ("UNREADABLE", "FAILED"),
    }
    ledger = {r.path: (r.reason, r.size) for r in repository.exclusion_ledger(c).collect()}
    assert ledger["a/node_modules"] == ("IGNORED", 0) and ledger["bin.py"] == ("BINARY", 3) and len(ledger) == 6
    assert repository.classify(df.limit(0)).count() == 0
