import pytest

from quarryloom.operators import chunking as C
from quarryloom.operators import symbols as S


def files(spark, **texts):
    return spark.createDataFrame([("r", k.replace("__", "."), t) for k, t in texts.items()], "repo_root string, path string, text string")


def spans(df, *more):
    return sorted((r["start_line"], r["end_line"], *[r[c] for c in more]) for r in df.collect())


@pytest.mark.parametrize(("n", "want"), [(5, [(1, 5)]), (50, [(1, 50)]), (51, [(1, 50), (41, 51)]), (100, [(1, 50), (41, 90), (81, 100)])])
def test_fallback(spark, n, want):
    text = "\n".join(f"línea {i}" for i in range(n))
    rows = C.fixed_chunks(files(spark, x__xyz=text)).orderBy("start_line").collect()
    assert [(r["start_line"], r["end_line"]) for r in rows] == want
    for r in rows:
        assert text.encode()[r["start_byte"] : r["end_byte"]].decode().removesuffix("\n") == r["content"]
        assert r["node_type"] == "block" and r["language"] == "unknown" and len(r["content_hash"]) == 64


def test_fallback_edges(spark):
    assert spans(C.fixed_chunks(files(spark, a=""))) == [(1, 1)]
    assert C.fixed_chunks(files(spark, a=None)).count() == 0


@pytest.mark.parametrize("n", [8, 30, 3])
def test_line_chunks(spark, n):
    got = spans(C.line_chunks(files(spark, a="\n".join("x" * n)), 10, 2))
    assert got[0][0] == 1 and got[-1][1] == n and all(b - a < 10 for a, b in got)
    assert (len(got) == 1) == (n <= 10)
    assert set(range(1, n + 1)) == {i for a, b in got for i in range(a, b + 1)}


def test_symbol_chunks(spark):
    lines = ["x"] * 60
    f = files(spark, a="\n".join(lines))
    sym = spark.createDataFrame([("r", "a", 3, "function"), ("r", "a", 5, "class"), ("r", "a", 12, "function"), ("r", "a", 55, "variable")], "repo_root string, path string, line int, kind string")
    got = spans(C.symbol_chunks(f, sym), "kind")
    # Line 3 to 4 is too short for a chunk, 12 to 60 is split.
    assert got == [(1, 4, "fixed"), (5, 11, "class"), (12, 41, "function"), (27, 56, "function"), (42, 60, "function")]
    assert (46, 60, "function") in spans(C.symbol_chunks(f, sym, tail="reference"), "kind")
    assert spans(C.symbol_chunks(f, sym.limit(0))) == spans(C.line_chunks(f))


def test_uncovered(spark):
    f = files(spark, a="\n" * 9)
    cov = spark.createDataFrame([("r", "a", 2, 3), ("r", "a", 3, 5), ("r", "a", 9, 9)], "repo_root string, path string, start_line int, end_line int")
    assert spans(C.uncovered_runs(f, cov)) == [(1, 1), (6, 8), (10, 10)]
    assert spans(C.uncovered_runs(f, cov, least=3)) == [(6, 8)]
    assert spans(C.uncovered_runs(f, cov.limit(0))) == [(1, 10)]


GO = "package main\n\nfunc hello() {\n\tprintln(\"}\")\n}\n\nfunc world() int {\n\treturn 1\n}\n"
PY = "import os\n\n@wrap\ndef a(x):\n    return x\n\nclass B:\n    def m(self):\n        pass\n"


def test_structure(spark):
    rows = C.structural_chunks(files(spark, m__go=GO, p__py=PY, bad__py="def (", c__txt="one\ntwo")).collect()
    got = {(r["path"], r["node_type"], r["node_name"], r["start_line"], r["end_line"]) for r in rows}
    assert ("m.go", "function_declaration", "hello", 3, 5) in got and ("m.go", "function_declaration", "world", 7, 9) in got
    assert ("p.py", "decorated_definition", "a", 3, 5) in got and ("p.py", "class_definition", "B", 7, 9) in got
    assert ("bad.py", "block", None, 1, 1) in got and ("c.txt", "block", None, 1, 2) in got
    for r in rows:
        text = {"m.go": GO, "p.py": PY, "bad.py": "def (", "c.txt": "one\ntwo"}[r["path"]]
        assert text.encode()[r["start_byte"] : r["end_byte"]].decode() == r["content"]


def test_large_nodes_are_split():
    inner = "\n".join(f"    def m{i}(self):\n        return '{'x' * 300}'" for i in range(10))
    got = C.chunk_text("class Big:\n" + inner, "python")
    assert [r[6] for r in got][:2] == ["Big", "m0"] and len(got) == 11


@pytest.mark.parametrize(("lang", "text", "names"), [
    ("rust", "pub struct A {\n  x: i32,\n}\n\nimpl A {\n  fn new() -> A {\n  }\n}\n", {"A"}),
    ("java", "public class A {\n  void f() {\n  }\n}\n", {"A"}),
    ("ruby", "class A\n  def f\n    1\n  end\nend\n", {"A"}),
    ("c", "int main(void) {\n  return 0;\n}\n\nstruct s {\n  int x;\n};\n", {"main", "s"}),
    ("typescript", "export function f(a: string) {\n  return a;\n}\n\ninterface I {\n  x: number;\n}\n", {"f", "I"}),
])
def test_scanner(lang, text, names):
    assert names <= {r[6] for r in C.chunk_text(text, lang)}


def test_symbols_of_a_mixed_tree(spark):
    f = files(spark, main__go="func Run() {\n}\ntype T struct {\n}\n", script__js="function go() {}\nclass K {}\n", util__py="def helper():\n  pass\nclass U:\n  pass\n")
    found = S.extract_symbols(f)
    assert {(r["path"], r["name"], r["kind"], r["line"]) for r in found.collect()} == {("main.go", "Run", "function", 1), ("main.go", "T", "struct", 3), ("script.js", "go", "function", 1), ("script.js", "K", "class", 2), ("util.py", "helper", "function", 1), ("util.py", "U", "class", 3)}
    assert [r["name"] for r in S.list_definitions(found, "r", "util.py").collect()] == ["helper", "U"]


def test_find(spark):
    sym = spark.createDataFrame([(n, "function", "p", i) for i, n in enumerate(["xget", "Get", "getter", "a%b", "get"])], "name string, kind string, path string, line int")
    assert [r["name"] for r in S.find_symbols(sym, "get").collect()] == ["Get", "get", "getter", "xget"]
    assert [r["name"] for r in S.find_symbols(sym, "%").collect()] == ["a%b"]
    assert S.find_symbols(sym, "%", raw_pattern=True).count() == 5
    assert [r["name"] for r in S.find_symbols(sym, "get", case_sensitive=True, limit=1).collect()] == ["get"]


def test_tags(spark):
    tags = spark.createDataFrame([("f", "/w/r/a.py", 3, "m", "Python", "/x/", "B", "class", "(x)"), ("f", "/w/r/a.py", 3, "m", "Python", "/x/", "B", "class", "(x)")], "name string, path string, line int, kind string, language string, pattern string, scope string, scopeKind string, signature string")
    (r,) = S.from_tags(tags, "/w/r").collect()
    assert (r["path"], r["kind"], r["scope"], r["language"], r["signature"]) == ("a.py", "field", "class:B", "python", "(x)")


def test_scanning_takes_time_by_length_only():
    """Each character is looked at once, however deep or long a class is."""
    import time

    def took(n):
        text = "class A {\n" + "".join(f"  m{i}() {{\n    call({i});\n  }}\n" for i in range(n)) + "}\n"
        begun = time.perf_counter()
        assert len(C.chunk_text(text, "javascript")) == n + 1
        return time.perf_counter() - begun

    took(1000)
    assert took(40_000) < 16 * took(5000) + 0.5


def test_comments_and_strings_hide_braces():
    text = "func A() {\n\ts := \"{\"\n\t/* {\n\tfunc X() {\n\t*/\n\tr := `\n{`\n}\n\nfunc B() {\n}\n"
    assert [(r[0], r[1], r[6]) for r in C.chunk_text(text, "go") if r[5] != "gap"] == [(1, 8, "A"), (10, 11, "B")]
