"""The code scanner against Python's own parser and hand cases."""

import ast
import json
import os
from textwrap import dedent

import pyarrow as pa
import pytest

from siltstone.operators import code, graph

FILES = [os.path.join(os.path.dirname(m), f) for m in (json.__file__, ast.__file__) for f in sorted(os.listdir(os.path.dirname(m))) if f.endswith(".py")][:120]


def by_parser(text):
    out = []

    def walk(node, trail, kind_above):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if kind_above == "class" else "function"
                out.append((kind, ".".join([*trail, child.name]), child.lineno, child.end_lineno, [ast.unparse(b).replace(" ", "") for b in child.bases if not isinstance(b, ast.Starred)] if kind == "class" else []))
                walk(child, [*trail, child.name], "class" if kind == "class" else "function")
            else:
                walk(child, trail, kind_above)

    walk(ast.parse(text), [], None)
    return sorted(out, key=lambda x: x[2])


@pytest.mark.parametrize("path", FILES, ids=os.path.basename)
def test_python_equals_the_parser(path):
    with open(path, encoding="utf-8") as f:
        text = f.read()
    got = sorted(((e.kind, e.qualified, e.start, e.end, [b.replace(" ", "") for b in e.bases]) for e in code.python_entities(text)), key=lambda x: x[2])
    want = by_parser(text)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == [w[3] for w in want]


def shown(text, language):
    return [(e.kind, e.qualified, e.start, e.end, e.bases, e.calls) for e in code.entities(dedent(text).strip("\n"), language)]


def test_python_calls_and_bases():
    text = '''
    import os
    class A(Base, mixins.M, metaclass=Meta):
        """def fake(): pass"""
        x = make()
        async def run(self, a=(1, 2),
                      b={"def no": 3}):
            def inner():
                return self.load(a)  # def not_this():
            return inner() + os.path.join("class B:")
    def alone(): return helper(1)
    '''
    assert shown(text, "python") == [
        ("class", "A", 2, 9, ["Base", "mixins.M"], ["make"]),
        ("method", "A.run", 5, 9, [], ["inner", "os.path.join"]),
        ("function", "A.run.inner", 7, 8, [], ["self.load"]),
        ("function", "alone", 10, 10, [], ["helper"]),
    ]


def test_java():
    text = '''
    package p; import java.util.List;
    /* class Fake { } */
    public class Shop<T> extends Base<T> implements Seller, java.io.Closeable {
        private String s = "class X {";
        public Shop(int a) { super(a); }
        @Override public <R> List<R> sell(Map<String, R> m) throws IOException {
            if (m.isEmpty()) { return none(); }
            Runnable r = new Runnable() { public void run() { go(); } };
            for (int i = 0; i < 3; i++) { add(i); }
            return m.get("}");
        }
        interface Seller { void sell(int a); int count(); }
        enum Kind { A, B }
    }
    '''
    got = shown(text, "java")
    sell = got.pop(2)
    assert got == [
        ("class", "Shop", 3, 14, ["Base", "Seller", "java.io.Closeable"], []),
        ("method", "Shop.Shop", 5, 5, [], []),
        ("interface", "Shop.Seller", 12, 12, [], []),
        ("method", "Shop.Seller.sell", 12, 12, [], []),
        ("method", "Shop.Seller.count", 12, 12, [], []),
        ("enum", "Shop.Kind", 13, 13, [], []),
    ]
    assert sell[:4] == ("method", "Shop.sell", 6, 11) and {"m.isEmpty", "none", "add", "m.get"} <= set(sell[5])


def test_go():
    text = '''
    package main
    import (
        "fmt"
    )
    type Store struct {
        rows map[string]int // func no() {
    }
    type Reader interface {
        Read(p []byte) (int, error)
    }
    func (s *Store) Get(key string) (int, error) {
        if v, ok := s.rows[key]; ok { return v, nil }
        return fmt.Sprint(`func x() {`), load(key)
    }
    func main() {
        f := func(a int) int { return twice(a) }
        f(3)
    }
    '''
    assert shown(text, "go") == [
        ("struct", "Store", 5, 7, [], []),
        ("interface", "Reader", 8, 10, [], []),
        ("method", "Store.Get", 11, 14, [], ["fmt.Sprint", "load"]),
        ("function", "main", 15, 18, [], ["twice", "f"]),
    ]


def test_typescript():
    text = '''
    import { x } from "y";
    export interface Props extends Base { name: string; }
    export class View<T> extends Component<Props> implements A, B {
      private load(id: number): Promise<T> { return fetchIt(`/x/${id}{`); }
      get size() { return 1 }
    }
    export const Panel = ({ name }: Props) => {
      const [a, setA] = useState(0);
      const add = (n: number) => { setA(a + n); };
      return render(name);
    };
    async function main(a: number): Promise<void> {
      if (a) { await run(a) } else { stop() }
    }
    enum Color { Red }
    '''
    got = shown(text, "typescript")
    assert [g[:4] for g in got] == [
        ("interface", "Props", 2, 2),
        ("class", "View", 3, 6),
        ("method", "View.load", 4, 4),
        ("method", "View.size", 5, 5),
        ("function", "Panel", 7, 11),
        ("function", "Panel.add", 9, 9),
        ("function", "main", 12, 14),
        ("enum", "Color", 15, 15),
    ]
    assert got[0][4] == ["Base"] and got[1][4] == ["Component", "A", "B"]
    assert got[2][5] == ["fetchIt"] and "useState" in got[4][5] and got[5][5] == ["setA"] and {"run", "stop"} <= set(got[6][5])


def test_rust_kotlin_csharp():
    rust = '''
    pub struct Point { x: i32 }
    pub trait Shape { fn area(&self) -> f64; }
    impl Shape for Point {
        fn area(&self) -> f64 { helper(self.x) }
    }
    fn main() { let c = 'a'; run(); }
    '''
    got = shown(rust, "rust")
    assert [g[:4] for g in got] == [("struct", "Point", 1, 1), ("trait", "Shape", 2, 2), ("method", "Shape.area", 2, 2), ("impl", "Point", 3, 5), ("method", "Point.area", 4, 4), ("function", "main", 6, 6)]
    assert got[3][4] == ["Shape"] and got[4][5] == ["helper"] and got[5][5] == ["run"]
    kotlin = '''
    class Car(val n: Int) : Base(n), Drives {
        fun go(to: String): Int { return drive(to) }
        object Keys { }
    }
    fun <T> top(a: T) { call(a) }
    '''
    got = shown(kotlin, "kotlin")
    assert [g[:4] for g in got] == [("class", "Car", 1, 4), ("method", "Car.go", 2, 2), ("object", "Car.Keys", 3, 3), ("function", "top", 5, 5)]
    assert got[0][4] == ["Base", "Drives"]
    csharp = '''
    namespace N {
      public class C : Base, IThing {
        public C(int a) : base(a) { Init(); }
        public async Task<int> Run(int a) { return await Do(a); }
      }
    }
    '''
    got = shown(csharp, "csharp")
    assert [g[:4] for g in got] == [("class", "C", 2, 5), ("method", "C.C", 3, 3), ("method", "C.Run", 4, 4)]
    assert got[0][4] == ["Base", "IThing"] and got[1][5] == ["Init"] and got[2][5] == ["Do"]


def test_broken_texts():
    for language in ("python", *code.BRACES):
        for text in ("", "{", "}", "}}}{{", "class", "class A {", "def f(", "'", '"""', "/*", "x" * 100_000, "(" * 1000 + "{", "é{ü}"):
            code.entities(text, language)


def test_graph_of_code(spark):
    files = [("a.py", "import os\nclass A(B):\n    def f(self):\n        return g(self) + h()\ndef g(x):\n    return os.getcwd()\n"), ("b.py", "class B:\n    def h(self):\n        pass\ndef g(x):\n    return x\n"), ("c.txt", "def no(): pass"), ("d.py", None)]
    found = code.structure(spark.createDataFrame(files, "path string, content string"))
    nodes, edges = code.code_graph(found)
    assert {tuple(r) for r in edges.collect()} == {
        ("file:a.py", "module:os", "IMPORTS"),
        ("file:a.py", "a.py::A", "CONTAINS"),
        ("a.py::A", "a.py::A.f", "CONTAINS"),
        ("file:a.py", "a.py::g", "CONTAINS"),
        ("file:b.py", "b.py::B", "CONTAINS"),
        ("b.py::B", "b.py::B.h", "CONTAINS"),
        ("file:b.py", "b.py::g", "CONTAINS"),
        ("a.py::A.f", "a.py::g", "CALLS"),
        ("a.py::A.f", "b.py::B.h", "CALLS"),
        ("a.py::A", "b.py::B", "INHERITS"),
    }
    assert nodes.count() == 9 and {r["type"] for r in nodes.collect()} == {"class", "method", "function", "file", "module"}
    callers = graph.match_edges(edges, ["CALLS"], dst="a.py::g").collect()
    assert [r["src"] for r in callers] == ["a.py::A.f"]
    rows = {tuple(r) for r in code.entity_edges(found).collect()}
    assert ("file:a.py", "A.f", "CONTAINS") in rows and ("A.f", "g", "CALLS") in rows and ("A", "B", "INHERITS") in rows and ("g", "os", "IMPORTS") in rows


def large_file(k, n=300):
    return f"src/f{k}.py", "import shop\n" + "".join(f"class C{k}_{i}(Base):\n    def one(self):\n        return load(self.rows())\n\n" for i in range(n))


def test_declarations_of_large_files_leave_in_parts(monkeypatch):
    files = [(*large_file(k), "python") for k in range(8)] + [("a.py", None, "python"), ("b.txt", "x", None)]
    batch = pa.RecordBatch.from_pydict({"path": [f[0] for f in files], "language": [f[2] for f in files], "content": [f[1] for f in files]})
    begun, plain = [], code.entities
    monkeypatch.setattr(code, "entities", lambda text, language: begun.append(1) or plain(text, language))
    monkeypatch.setattr(code, "ROWS", 500)
    n, paths = 0, []
    for part in code.scanned(iter([batch])):
        n += len(part)
        paths += part.column(0).to_pylist()
        assert len(part) <= 500 and len(begun) <= n // 601 + 1  # the files behind are not scanned yet
    assert n == 8 * 601 and sorted(paths) == paths


def test_code_graph_scans_the_files_once(spark, tmp_path):
    log = str(tmp_path / "seen")

    def seen(batches):
        for b in batches:
            with open(log, "a") as f:
                f.write("\n" * len(b))
            yield b

    found = code.structure(spark.createDataFrame([large_file(k, 3) for k in range(4)], "path string, content string"))
    nodes, edges = code.code_graph(found.mapInArrow(seen, found.schema))
    assert nodes.count() == 4 * (1 + 3 * 2) + 1 and edges.where("type = 'CONTAINS'").count() == 24 and edges.where("type = 'IMPORTS'").count() == 4
    assert len(open(log).read()) == found.count()
