"""Extraction, parents and symbol queries."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from repoloom.functions.scan import CONTAINERS, definitions, enclosing
from repoloom.operators import symbols as ops

PY = '''class Animal:
    def __init__(self, name):
        self.name = name

    def describe(self):
        return self.name

def free_function(x):
    return x + 1
'''
GO = '''package main

type Dog struct{ name string }
type (
\tAge int
\tWalker interface {
\t\tWalk() error
\t}
)
type Set[T comparable] map[T]struct{}

func (d *Dog) Bark() string { return "woof }" }
func (d Dog)  Name() string { return d.name }
func (Dog) Quiet(x interface{}) map[string]interface{} {
\treturn nil /* } */
}

func free(x int) int { return x + 1 }
func external(x int) int
'''
JAVA = '''package a;
@Service(name = "x{")
public class Zoo<T extends Animal> extends Base implements Runnable {
    private final Map<String, List<T>> cages = new HashMap<>();
    enum Size { SMALL, LARGE("}"); Size() {} Size(String s) { this(); } }
    public Zoo(int n) { super(n); init(n); }
    @Override
    public void run() throws Exception {
        for (int i = 0; i < 3; i++) { feed(i); }
        new Thread(new Runnable() { public void run() { stop(); } }).start();
    }
    abstract <R> List<R> list(Map<String, R> in);
    interface Feeder { void feed(int n); default int twice() { return 2; } }
    record Point(int x, int y) { Point { check(x); } int sum() { return x + y; } }
}
'''
TS = '''import { a } from "b";
export interface Shape { area(): number; name: string; }
export type Alias<T> = { x: T } | null;
enum Color { Red, Green }
export abstract class Base<T> implements Shape {
  private re = /[{]/;
  constructor(private x: number) { if (x) { call(x); } }
  get size(): number { return 1; }
  static async load<T>(url: string): Promise<T> { return fetch(`${url}{`); }
  area() { return this.items.map((i) => { return i; }); }
  abstract later(): void;
}
export function main(a: string): void { helper(a); }
function* gen() { yield 1; }
export const arrow = async (x: number) => { return x; };
const short = x => x + 1
const value = call(3);
'''


def found(spark, path, source):
    files = spark.createDataFrame([("p", path, bytearray(source.encode()))], "project string, path string, content binary")
    return {(r.name, r.kind, r.parent) for r in ops.build_index(files).collect()}


def test_python(spark):
    assert found(spark, "a.py", PY) == {
        ("Animal", "class", None), ("__init__", "method", "Animal"), ("describe", "method", "Animal"), ("free_function", "function", None)}


def test_python_that_does_not_parse(spark):
    """Old syntax is read by indentation; the ranges still nest."""
    assert found(spark, "a.py", PY + "print 'old'\n") == found(spark, "a.py", PY)


def test_go(spark):
    got = found(spark, "main.go", GO)
    assert {("Bark", "method", "Dog"), ("Name", "method", "Dog"), ("free", "function", None), ("external", "function", None),
            ("Dog", "struct", None), ("Age", "type", None), ("Walker", "interface", None), ("Set", "type", None),
            ("Quiet", "method", None)} == got


def test_java(spark):
    got = found(spark, "Zoo.java", JAVA)
    assert got == {
        ("Zoo", "class", None), ("Zoo", "constructor", "Zoo"), ("run", "method", "Zoo"), ("list", "method", "Zoo"),
        ("Size", "enum", "Zoo"), ("Size", "constructor", "Size"), ("Feeder", "interface", "Zoo"), ("feed", "method", "Feeder"),
        ("twice", "method", "Feeder"), ("Point", "class", "Zoo"), ("sum", "method", "Point")}


@pytest.mark.parametrize("path", ["a.ts", "a.tsx"])
def test_typescript(spark, path):
    assert found(spark, path, TS) == {
        ("Shape", "interface", None), ("area", "method", "Shape"), ("Alias", "type", None), ("Color", "enum", None), ("Base", "class", None),
        ("constructor", "constructor", "Base"), ("size", "method", "Base"), ("load", "method", "Base"), ("area", "method", "Base"),
        ("later", "method", "Base"), ("main", "function", None), ("gen", "function", None), ("arrow", "function", None), ("short", "function", None)}


def test_lines_and_names_are_exact():
    source = "# é\nclass Größe:\n    def über(self):\n        pass\n".encode()
    got = [(d.name, source[: d.start].count(b"\n") + 1) for d in definitions(source, "python")]
    assert got == [("Größe", 2), ("über", 3)]


def test_unsupported_and_skipped(spark, make_files):
    files = make_files({"x.rs": "fn main() {}\n", "a.go": "package x\nfunc Foo() {}\n", "sub/b.py": "def bar():\n    return 1\n",
                        "vendor/c.py": "def no(): pass\n", "a/node_modules/d.ts": "function no() {}\n", "vendor.py": "def yes(): pass\n"})
    assert sorted((r.path, r.name) for r in ops.build_index(files).collect()) == [("a.go", "Foo"), ("sub/b.py", "bar"), ("vendor.py", "yes")]
    assert ops.extract_totals(files).first()[1:] == (3, 3)


def slow_enclosing(starts, ends, kinds):
    out = []
    for i in range(len(starts)):
        best, span = -1, None
        for j in range(len(starts)):
            inside = j != i and kinds[j] in CONTAINERS and starts[j] <= starts[i] and ends[j] >= ends[i]
            if inside and (span is None or ends[j] - starts[j] < span):
                best, span = j, ends[j] - starts[j]
        out.append(best)
    return out


@pytest.mark.parametrize("nested", [True, False])
def test_enclosing_against_brute_force(nested):
    random.seed(3)
    for _ in range(300):
        ranges = []

        def split(a, b, depth):
            ranges.append((a, b))
            if random.random() < 0.2:
                ranges.append((a, b))
            if depth and b - a > 3:
                m = random.randint(a, b)
                split(a, m, depth - 1)
                if random.random() < 0.7 and m + 1 < b:
                    split(m + 1, b, depth - 1)

        if nested:
            split(0, 40, 4)
        else:
            ranges = [tuple(sorted(random.sample(range(20), 2))) for _ in range(random.randint(1, 12))]
        random.shuffle(ranges)
        starts, ends = [r[0] for r in ranges], [r[1] for r in ranges]
        kinds = [random.choice(["class", "function", "struct"]) for _ in ranges]
        assert enclosing(starts, ends, kinds) == slow_enclosing(starts, ends, kinds)


def test_parents_of_rows(spark, make_files):
    defs = ops.extract_definitions(make_files({"Zoo.java": JAVA, "main.go": GO}))
    want = {(r.path, r.def_ix, r.container) for r in defs.collect()}
    assert {(r.path, r.def_ix, r.container) for r in ops.enclosing_parents(defs).collect()} == want


def test_parents_by_windows_against_brute_force(spark):
    """Nested, equal, touching, empty and crossing ranges, many files at a time."""
    random.seed(8)
    rows, want = [], set()
    for n in range(120):
        if n % 3:
            todo, ranges = [(0, 60, 4)], []
            while todo:
                a, b, depth = todo.pop()
                ranges += [(a, b)] * random.choice([1, 1, 1, 2, 3])
                if depth and b - a > 3:
                    m = random.randint(a + 1, b - 1)
                    todo += [(a, m, depth - 1)] + ([(m + random.randint(0, 1), b, depth - 1)] if m + 1 < b else [])
        else:
            ranges = [tuple(sorted(random.choices(range(20), k=2))) for _ in range(random.randint(1, 12))]
        random.shuffle(ranges)
        kinds = [random.choice(["class", "function", "struct"]) for _ in ranges]
        up = slow_enclosing([r[0] for r in ranges], [r[1] for r in ranges], kinds)
        for i, ((a, b), kind) in enumerate(zip(ranges, kinds)):
            rows.append(("p", f"f{n}", i, f"n{i}", kind, 1, 1, a, b, "java", None, None))
            want.add((f"f{n}", i, f"n{up[i]}" if up[i] >= 0 else None))
    got = ops.enclosing_parents(spark.createDataFrame(rows, ops.DEFINITIONS))
    assert {(r.path, r.def_ix, r.container) for r in got.collect()} == want and got.count() == len(rows)
    assert "Pandas" not in got._jdf.queryExecution().executedPlan().toString()
    assert ops.enclosing_parents(got.where("false")).count() == 0


def test_receivers_and_kinds(spark):
    heads = [("func (d *Dog) Walk() error { return nil }", "Dog"), ("func (a Animal) Name() string", "Animal"), ("func (d   *  Dog  ) X()", "Dog"),
             ("func (d *Dog[T]) Fetch()", "Dog"), ("func Plain() {}", None), ("// some comment", None)]
    df = spark.createDataFrame([(h,) for h, _ in heads], "h string")
    assert [r[0] for r in df.select(ops.go_receiver(F.col("h"))).collect()] == [w for _, w in heads]
    tags = [("definition.function", "function"), ("definition.method", "method"), ("reference.call", None), ("", None), ("definition.", None), ("unknown", None)]
    df = spark.createDataFrame([(t,) for t, _ in tags], "t string")
    assert [r[0] for r in df.select(ops.normalize_kind(F.col("t"))).collect()] == [w for _, w in tags]


def test_queries(spark, make_files):
    index = ops.build_index(make_files({"a.py": PY, "main.go": GO}, "p").unionByName(make_files({"b.py": PY}, "q")))
    one = ops.symbols_in_project(index, "p", limit=2).collect()
    assert [r.name for r in one] == ["Animal", "__init__"] and all(r.truncated for r in one)
    across = ops.symbols_across(index, "desc*").collect()
    assert [(r.project, r.path, r.truncated) for r in across] == [("p", "a.py", False), ("q", "b.py", False)]
    assert {r.lang for r in ops.filter_symbols(index, langs=["go"]).collect()} == {"go"}
    with pytest.raises(ValueError):
        ops.symbols_across(index)
    with pytest.raises(ValueError):
        ops.filter_symbols(index, langs=["cobol"])
    fresh = ops.symbols_in_file(make_files({"vendor/a.py": PY}), "p", "vendor/a.py", kinds=["method"])
    assert [r.name for r in fresh.collect()] == ["__init__", "describe"]


def test_versions_meet_in_tasks_of_their_own(spark):
    """Symbols of both versions are dealt by path before they are counted, so no task counts what one reading task made."""
    rows = [(p, f"{i % 3}.py", f"n{i}", "function", i, i, None, "python") for p in ("a", "b") for i in range(9) if (p, i) != ("b", 4)]
    table = spark.createDataFrame(rows, "project string, path string, name string, kind string, line int, end_line int, parent string, lang string")
    found = ops.compare_versions(table, spark.createDataFrame([("a", "b")], "old string, new string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    first_count = plan[:plan.index("REPARTITION_BY_COL")]
    assert first_count.count("HashAggregate") == 2 and "Exchange hashpartitioning" not in first_count.split("HashAggregate")[1]
    assert [(r.path, r.name, r.status, r.old_line) for r in found.collect()] == [("1.py", "n4", "removed", 4)]
