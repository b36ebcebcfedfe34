import time

import pytest

from findling.operators import code
from findling.operators.graph import code_edges

SCRIPT = r'''
import React, { useState } from "react";
import './side.css'
const fs = require('fs'); // class Hidden {
export default class Cat extends zoo.Animal implements Pet<Map<string, number>> {
  #age = 0;
  static /* } */ kind = "brace } in a text";
  constructor(name: string, { loud = true } = {}) { super(name); this.say(`${name} says ${loud ? shout(`x${up(1)}`) : "}"} {`); }
  async say(what: string): Promise<{ done: boolean }> { if (/[/}]{2}/.test(what)) { return await log.write(what); } }
  get old() { return old(this.#age) / 2 / three(); }
  later = async (x) => { wait(x); };
  abstract gone(): void;
}
interface Pet { stroke(): void }
function* walk(steps = () => { return skip(); }) { yield next?.step(steps); function inner() { deep(); } }
const run = async (cat) => { cat.say("hi"); new Cat(); };
const short = x => x + 1;
exports.fly = function () { up(); };
'''
GO = '''
package main
import f "fmt"
import (
  "os"
  _ "net/http"
)
type (
  Small struct { n int }
)
type Stack[T any] struct {
  items []T
  *Base
  sync.Mutex
  note string `json:"}"`
}
type Base struct{}
type Reader interface {
  Read(p []byte) (n int, err error)
}
func (s *Stack[T]) Push(v T, o struct{ a int }) interface{} { s.items = append(s.items, v); r := '}'; return helper(r) }
func main() {
  go func() { os.Exit(1) }()
  if x := f.Sprint("{"); x != "" { defer done() }
}
'''
RUST = r'''
use std::collections::{HashMap, HashSet};
use crate::shape::Shape as S;
pub trait Area: Shape + fmt::Debug { fn area(&self) -> f64; fn twice(&self) -> f64 { double(self.area()) } }
struct Point(f64, f64);
pub struct Circle<'a, T: Clone> where T: Copy { name: &'a str, r: T }
enum Kind { A { x: i32 }, B }
impl<'a, T: Clone> Area for Circle<'a, T> where T: Copy {
  fn area(&self) -> f64 { let c = '{'; let s = r#"}" }"#; /* } /* nested } */ } */ println!("{}", c); std::f64::consts::pi() * self.r.get() }
}
impl Circle<'_, i32> { fn new(r: [u8; 4]) -> Self { Self::build(r) } }
fn make() -> impl Area { Circle::new([0; 4]) }
'''


@pytest.fixture(scope="module")
def found(spark):
    files = [("a/cat.ts", SCRIPT), ("b/main.go", GO), ("c/shape.rs", RUST), ("d/x.py", "import os\nclass A(B):\n    def f(self): g()\n"), ("e/none.js", None), ("f/notes.txt", "class A {"), ("g/open.js", "class A { f() { g(")]
    files += [("h/shut.go", "func a() { b() } }\nfunc c() { d() }"), ("i/mixed.js", "function a() { (b( } function c() { d() }")]
    return code.code_chunks(spark.createDataFrame(files, "file_path string, text string"))


@pytest.fixture(scope="module")
def rows(found):
    return {r["id"]: r for r in found.collect()}


def names(rows, path):
    return {k.removeprefix(f"{path}::") for k, r in rows.items() if r["file_path"] == path and r["node_type"] != "file"}


def test_script(rows):
    p = "a/cat.ts"
    assert names(rows, p) == {"Cat", "Cat::constructor", "Cat::say", "Cat::old", "Cat::later", "Pet", "steps", "walk", "walk::inner", "run", "fly"}
    cat, say = rows[f"{p}::Cat"], rows[f"{p}::Cat::say"]
    assert cat["bases"] == ["zoo.Animal", "Pet"] and (cat["start_line"], cat["end_line"]) == (5, 13) and cat["imports"] == ["react", "./side.css", "fs"]
    assert cat["signature"] == "class Cat extends zoo.Animal implements Pet<Map<string, number>>" and cat["parent_id"] is None
    assert say["calls"] == ["log.write", "test"] and say["parent_id"] == cat["id"] and say["signature"] == "say(what: string): Promise<{ done: boolean }>"
    assert rows[f"{p}::Cat::constructor"]["calls"] == ["shout", "super", "this.say", "up"]
    assert rows[f"{p}::Cat::old"]["calls"] == ["old", "three"] and rows[f"{p}::Cat::later"]["calls"] == ["wait"]
    assert rows[f"{p}::walk"]["calls"] == ["deep", "next?.step"] and rows[f"{p}::walk::inner"]["parent_id"] == f"{p}::walk"
    assert rows[f"{p}::run"]["calls"] == ["Cat", "cat.say"] and rows[f"{p}::fly"]["calls"] == ["up"]
    assert p not in rows


def test_go(rows):
    p = "b/main.go"
    assert names(rows, p) == {"Small", "Stack", "Base", "Reader", "Stack::Push", "main"}
    assert rows[f"{p}::Stack"]["bases"] == ["Base", "sync.Mutex"] and rows[f"{p}::main"]["imports"] == ["fmt", "os", "net/http"]
    assert rows[f"{p}::Stack::Push"]["calls"] == ["append", "helper"] and rows[f"{p}::Stack::Push"]["parent_id"] == f"{p}::Stack"
    assert rows[f"{p}::main"]["calls"] == ["done", "f.Sprint", "os.Exit"] and p not in rows


def test_rust(rows):
    p = "c/shape.rs"
    assert names(rows, p) == {"Area", "Area::twice", "Point", "Circle", "Kind", "Circle::area", "Circle::new", "make"}
    assert rows[f"{p}::Area"]["bases"] == ["Shape", "fmt::Debug"] and rows[f"{p}::Circle"]["bases"] == ["Area"]
    assert rows[f"{p}::Circle::area"]["calls"] == ["self.r.get", "std::f64::consts::pi"] and rows[f"{p}::Circle::new"]["calls"] == ["Self::build"]
    assert rows[f"{p}::make"]["imports"] == ["std::collections", "crate::shape::Shape"] and rows[f"{p}::Area::twice"]["calls"] == ["double", "self.area"] and p not in rows


def test_broken_and_other_files(rows):
    assert rows["d/x.py::A::f"]["calls"] == ["g"] and not any(r["file_path"] in ("e/none.js", "f/notes.txt") for r in rows.values())
    assert names(rows, "g/open.js") == {"A", "A::f"} and "never closed" in rows["g/open.js"]["error"] and rows["g/open.js::A::f"]["calls"] == ["g"]
    assert names(rows, "h/shut.go") == {"a", "c"} and "closes nothing" in rows["h/shut.go"]["error"] and rows["h/shut.go::c"]["calls"] == ["d"]
    assert names(rows, "i/mixed.js") == {"a", "c"} and "closes (" in rows["i/mixed.js"]["error"]


def test_edges(found):
    got = {tuple(r) for r in code_edges(found.filter("node_type <> 'file'")).collect()}
    p = "b/main.go"
    assert {(p, f"{p}::Stack", "CONTAINS"), (f"{p}::Stack", f"{p}::Stack::Push", "HAS_METHOD"), (p, "os", "IMPORTS"), (f"{p}::Stack", "Base", "INHERITS"), (f"{p}::main", "os.Exit", "CALLS")} <= got


@pytest.mark.parametrize("text", ["`${" * 100_000, "/*" * 100_000, "{(" * 100_000, "a" * 1_000_000, '"' + "\\a" * 300_000, "/[" * 100_000, "class A extends " * 20_000, "r#" * 100_000, "x = (" * 20_000, "function a((" * 20_000, "(" * 100_000 + "}" * 100_000, "impl A { " * 20_000, "type A struct { " * 20_000])
@pytest.mark.parametrize("language", ["js", "go", "rust"])
def test_hard_texts_take_linear_time(text, language):
    began = time.perf_counter()
    code._File("f", text, language).parse()
    assert time.perf_counter() - began < 10


def test_files_are_parsed_once_by_all_cores(spark):
    """Edges of all kinds come from one pass over the files, which one partition of input doesn't keep to one task."""
    files = spark.createDataFrame([(f"f{i}.{'py' if i % 2 else 'js'}", "import a\nclass A(B):\n    def f(x):\n        return g(x)\n" if i % 2 else "class A extends B { f(x) { return g(x); } }\n") for i in range(64)], "file_path string, text string").coalesce(1)
    chunks = code.code_chunks(files)
    assert chunks.rdd.getNumPartitions() >= 2 * 8
    edges = code_edges(chunks)
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 2
    assert edges.count() == 64 * 4 + 32
