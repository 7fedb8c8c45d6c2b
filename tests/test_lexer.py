"""Declarations among strings, comments, templates and heredocs, nested generics, one-line blocks and open headers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.sources import files, lexer

CASES = {
    "a.ts": (
        "typescript",
        """\
// function inComment() {
/* class InBlock {
   method() { } */
const text = "function inString() {";
const page = `
class InTemplate {
  ${render(`function inner() { ${deep("x")} }`)} function still() {
`;
const re = x.replace(/"\\/function inRegex() {/g, '"');
export class Store<T extends Map<string, List<Set<T>>>> {
  private items: Map<string, Array<T>> = new Map();
  get(key: string): Map<string, List<T>> | null { return this.items.get(key); }
  async load<K, V extends Record<string, Array<K>>>(
    first: K,
    second: V,
  ): Promise<Map<K, V>> {
    if (first) {
      call(first);
    }
    return helper(`${convert(second)} function no() {`);
  }
  abstractOne(a: string): void;
}
function tiny() { return 1 } // }
type Pair = { a: string }
interface Shape {
  area(): number;
}
""",
        {("Store", "class", 10, 23), ("Store.get", "method", 12, 12), ("Store.load", "method", 13, 21), ("tiny", "function", 24, 24), ("Pair", "type", 25, 25), ("Shape", "interface", 26, 28)},
    ),
    "a.py": (
        "python",
        '''\
"""
def in_docstring():
class AlsoNot:
"""
TEXT = 'def in_string(): pass'  # def in_comment():
QUERY = r\'\'\'
class InRaw:
    def no(self):
\'\'\'
class Tool(Base):
    def run(self, x="def y():"):
        return """
def unindented():
"""
    def last(self): return 1

def main():
    pass
''',
        {("Tool", "class", 10, 16), ("Tool.run", "function", 11, 14), ("Tool.last", "function", 15, 16), ("main", "function", 17, 19)},
    ),
    "a.go": (
        "go",
        """\
package main

const usage = `
func inRaw() {
type InRaw struct {
`
// func inComment() {
type Pair[K comparable, V any] struct {
	Key K
}
func (p *Pair[K, V]) String() string { return "func x() {" + string('"') }
func main() {
	f := func() { run("}") }
	f()
}
""",
        {("Pair", "type", 8, 10), ("String", "function", 11, 11), ("main", "function", 12, 15)},
    ),
    "a.java": (
        "java",
        """\
package a;
/** class InDoc { } */
public class Service<T extends Comparable<Map<String, T>>>
{
    private static final String Q = \"""
        class InText {
            void no() {
        \""";
    private char quote = '"';
    @Override(x = 1) public Map<String, List<T>> find(String name, int n) throws Exception
    {
        for (int i = 0; i < n; i++) { log("void no() {"); }
        return helper(name);
    }
    public Service() { }
    enum Kind { A, B }
    abstract void open(Map<String, List<T>> all);
}
""",
        {("Service", "class", 3, 18), ("Service.find", "method", 10, 14), ("Service.Service", "method", 15, 15), ("Service.Kind", "function", 16, 16)},
    ),
    "a.rb": (
        "ruby",
        """\
=begin
class InBlock
  def no
=end
TEXT = <<~EOS
  class InHeredoc
    def no
  EOS
class Tool
  # def commented
  def run
    puts "def no #{x}"
  end
end
""",
        {("Tool", "class", 9, 14), ("Tool.run", "function", 11, 13)},
    ),
    "a.rs": (
        "rust",
        """\
/* outer /* fn nested() { */ fn still() { */
pub struct Keep<'a> { text: &'a str }
fn raw<'a>(x: &'a str) -> char { let s = r#"fn in_raw() { " }"#; '}' }
pub fn last() -> String {
    String::from("}
fn in_string() {")
}
""",
        {("Keep", "function", 2, 2), ("raw", "function", 3, 3), ("last", "function", 4, 7)},
    ),
    "a.c": (
        "c",
        """\
#include "x.h"
static int count(const char *text, struct pair *p);
/* int no(void) { */
static int count(const char *text, struct pair *p) {
    if (text[0] == '{') { return 1; }
    return other(p);
}
struct pair { int a; };
int
""",
        {("count", "function", 4, 7), ("pair", "function", 8, 8)},
    ),
    "a.php": (
        "php",
        """\
<?php
$x = <<<EOT
function inHeredoc() {
class InHeredoc {
EOT;
# function inComment() {
#[Pure]
class Shop {
  public function total(array $a = []): int { return sum("}{"); }
}
""",
        {("Shop", "class", 8, 10), ("Shop.total", "function", 9, 9)},
    ),
}


@pytest.fixture(scope="module")
def found(spark):
    table = spark.createDataFrame([(p, "r", lang, content) for p, (lang, content, _) in CASES.items()], "path string, repository_id string, language string, content string")
    nodes = files.symbols(table)
    called = files.calls(files.bodies(nodes, table)).join(nodes.select(F.col("id").alias("caller_id"), "qualified_name", "file_path"), "caller_id")
    return nodes.collect(), called.collect()


@pytest.mark.parametrize("path", CASES)
def test_declarations_are_those_of_the_code(found, path):
    got = {(r["qualified_name"], r["kind"], r["line_start"], r["line_end"]) for r in found[0] if r["file_path"] == path}
    assert got == CASES[path][2]


def test_calls_are_those_of_the_code(found):
    of = lambda path, name: {r["callee_name"] for r in found[1] if (r["file_path"], r["qualified_name"]) == (path, name)}
    assert of("a.ts", "Store.load") == {"call", "helper", "convert"}
    assert of("a.java", "Service.find") == {"Override", "find", "log", "helper"}
    assert of("a.go", "main") == {"main", "func", "run", "f"}  # keywords of calls are a fixed list


def test_masking_keeps_every_place(spark):
    rows = spark.createDataFrame([(p, lang, content) for p, (lang, content, _) in CASES.items()], "path string, language string, content string")
    for r in rows.withColumn("code", lexer.code_only(F.col("content"), F.col("language"))).collect():
        assert len(r["code"]) == len(r["content"]) and [i for i, c in enumerate(r["code"]) if c == "\n"] == [i for i, c in enumerate(r["content"]) if c == "\n"]
        assert all(a in (b, " ") for a, b in zip(r["code"], r["content"], strict=True)) and "inString" not in r["code"] and "InTemplate" not in r["code"]


@pytest.mark.parametrize("content", ["", "\n\n", '"', "`", "/*", "'''", "}}}} function f() {", "class A {", "`${`${`${x}`}`}`", '"' * 7, "a'b\"c`d"])
def test_broken_texts_are_taken_as_they_are(spark, content):
    for language in ("typescript", "python", "ruby", "rust", "unknown"):
        row = spark.range(1).select(lexer.code_only(F.lit(content), F.lit(language)).alias("c")).first()
        assert len(row["c"]) == len(content)


def test_long_literals_need_no_stack(spark):
    long = "/*" + "x * " * 200_000 + "*/\nconst a = \"" + "\\\\\\\"y" * 100_000 + "\";\nconst b = `" + "z$ \\` ${f('}')}" * 20_000 + "`;\nfunction f() { }\n"
    table = spark.createDataFrame([("a.ts", "r", "typescript", long)], "path string, repository_id string, language string, content string")
    assert [(r["name"], r["line_start"]) for r in files.symbols(table).collect()] == [("f", 4)]
