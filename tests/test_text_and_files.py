"""Text operators, ignore rules, source trees from scan to edges, and compact payloads."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import compact, ignore, stem, text
from tessera.operators import graph, lookup, resolve, search, text_index
from tessera.sources import files, graphs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("source", "categories"),
    [
        ("key = AKIA" + "A1" * 8, ["aws_key"]),
        ("x ghp_" + "a" * 36, ["github_token"]),
        ("-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", ["private_key"]),
        ("eyJhbGciOi.eyJzdWIi.c2ln", ["jwt"]),
        ("postgres://user:pass@host/db", ["connection_string"]),
        ("api_key = 'abcdefghijklmnopqrstu'", ["api_key"]),
        ("// api_key = 'abcdefghijklmnopqrstu'", []),
        ("example password = 'hunter2hunter2'", []),
        ("A" * 37, []),
        ("nothing here", []),
        ("a sk_live_" + "b" * 24 + "\nb AKIA" + "B2" * 8 + "\nglpat-" + "c" * 20, ["aws_key", "gitlab_token", "stripe_key"]),
        (None, []),
    ],
)
def test_scrubbing(spark, source, categories):
    row = one(spark, text.scrub(F.lit(source).cast("string")))
    assert sorted(d["category"] for d in row["detected"]) == categories
    assert row["scrubbed"] == source if not categories else all(f"[REDACTED:{c}]" in row["scrubbed"] for c in categories)
    assert bool(one(spark, text.has_secrets(F.lit(source or "")))) == any(c not in ("api_key", "jwt") for c in categories)


def test_chunks_are_packed_like_lines_in_order(spark):
    for content in ("", "short", "\n".join(["x" * 900] * 5), "y" * 4500 + "\nz", "\n".join(str(i) for i in range(900))):
        got = one(spark, text.pack_lines(F.lit(content)))
        expected, held = [], ""
        if len(content) <= 2000:
            expected = [content] if content else []
        else:
            for line in content.split("\n"):
                if len(held) + len(line) + 1 > 2000:
                    expected += [held] if held else []
                    held = ""
                    if len(line) > 2000:
                        expected.append(line[:2000])
                    else:
                        held = line
                else:
                    held += ("\n" if held else "") + line
            expected += [held] if held else []
        assert got == expected and all(len(c) <= 2000 for c in got)
        whole = one(spark, text.pack_lines(F.lit(content), keep_tail=True))
        assert "".join(whole).replace("\n", "") == content.replace("\n", "") and all(0 < len(c) <= 2000 for c in whole)


@pytest.mark.parametrize(
    ("patterns", "path", "expected"),
    [
        (None, "node_modules/a.js", True), (None, "src/a.ts", False), (None, "x/server.pem", True), (None, ".env.local", True),
        (("secrets/",), "secrets/a.txt", True), (("secrets/",), "a/secrets/b", True), (("*.log", "!important.log"), "important.log", False),
        (("*.log", "!important.log"), "x/debug.log", True), (("dist/",), "src/dist.ts", False), (("/top.txt",), "a/top.txt", False),
        (("a/**/z",), "a/b/c/z", True), (("a/**/z",), "a/z", True), (("# note", "", "f?o"), "x/foo", True), (("[ab].c",), "b.c", True),
    ],
)
def test_ignore(spark, patterns, path, expected):
    assert one(spark, ignore.ignored(F.lit(path), patterns)) is expected


def test_names_kinds_and_lint(spark):
    assert [one(spark, files.node_kind(F.lit(k))) for k in ("FunctionDecl", "constructor", "struct", "type_alias", "variable")] == ["function", "constant", "function", "type", "variable"]
    assert one(spark, files.visibility(F.lit("Public"))) == "public" and one(spark, files.visibility(F.lit("odd"))) is None
    assert one(spark, text.parent_symbol(F.lit("a.b.c"))) == "a.b" and one(spark, text.parent_symbol(F.lit("a"))) is None and one(spark, text.last_segment(F.lit("a.b"))) == "b"
    rules = one(spark, text.lint(F.lit("let x: ANY // TODO console.log"), F.lit("typescript")))
    assert [r["rule"] for r in rules] == ["no_explicit_any", "no_debug_statements", "no_todos"]
    assert one(spark, text.cyclomatic(F.lit("if (a && b) { for (;;) {} }"))) == 4
    assert one(spark, files.called_names(F.lit("if (x) { foo(1); a.bar(2); foo(3); obj.if (4) }"))) == ["foo", "bar", "if"]
    long = "\n".join(f"l{i}" for i in range(1, 31))
    assert one(spark, text.snippet(F.lit(long), F.lit(5), F.lit(6))) == "l3\nl4\nl5\nl6\nl7\nl8"
    assert one(spark, text.snippet(F.lit(long), F.lit(5), F.lit(20))).split("\n") == ["l3", "l4", "l5", "l6", "l7", "...", "l18", "l19", "l20", "l21", "l22"]


TREE = {
    "src/auth.ts": "import { check } from './util';\nexport class Auth extends Base {\n  login(name: string) {\n    return check(name);\n  }\n}\n\nexport function start() {\n  new Auth().login('x');\n}\n",
    "src/util.ts": "export function check(name) {\n  return helper(name);\n}\nfunction helper(x) {\n  return x;\n}\nfunction unused() {\n  return 1;\n}\n",
    "lib/tool.py": "class Tool(Base):\n    def run(self):\n        return self.run()\n\ndef main():\n    Tool().run()\n",
    "src/base.ts": "export class Base {}\n",
    "node_modules/x.ts": "function no() {}\n",
    ".hidden/y.ts": "function no() {}\n",
    "notes.txt": "function no() {}\n",
}


def test_a_source_tree_end_to_end(spark, tmp_path):
    for path, content in TREE.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(content)
    found = files.discover(spark, str(tmp_path))
    assert {(r["path"], r["language"]) for r in found.collect()} == {("src/auth.ts", "typescript"), ("src/util.ts", "typescript"), ("lib/tool.py", "python"), ("src/base.ts", "typescript")}
    nodes = files.symbols(found)
    spans = {(r["qualified_name"], r["kind"], r["line_start"], r["line_end"], r["is_exported"]) for r in nodes.collect()}
    assert spans >= {("Auth", "class", 2, 6, True), ("Auth.login", "method", 3, 5, False), ("start", "function", 8, 10, True), ("check", "function", 1, 3, True), ("Tool.run", "function", 2, 4, False), ("main", "function", 5, 7, False)}
    bodies = files.bodies(nodes, found)
    edges = resolve.resolve(nodes, files.calls(bodies), files.imports(found), files.parents(bodies))
    names = {r["id"]: r["qualified_name"] for r in nodes.collect()}
    pairs = {(names[r["source_id"]], names[r["target_id"]], r["kind"]) for r in edges.collect()}
    assert pairs >= {("Auth.login", "check", "calls"), ("check", "helper", "calls"), ("start", "Auth", "calls"), ("Auth", "Base", "extends"), ("Tool", "Base", "extends"), ("Auth", "check", "imports"), ("Tool.run", "Tool.run", "calls")}
    assert "unused" not in {names[r["id"]] for r in graph.dead_code(nodes, edges).collect()}  # its own header is a call of itself
    assert {r["name"] for r in lookup.find_callers(nodes, edges.withColumn("seq", F.lit(0)), "check").collect()} == {"login", "check"}
    graphs.save(nodes, edges.withColumn("seq", F.lit(0).cast("long")), str(tmp_path / "graph"))
    again = graphs.load(spark, str(tmp_path / "graph"))
    assert again[0].count() == nodes.count() and again[1].count() == edges.count()
    parts = search.embed(text.chunks(bodies))
    assert parts.count() == nodes.count() and {len(r["embedding"]) for r in parts.collect()} == {64}


WIDE = {
    "a.ts": "/**\n * Says hello.\n * Twice.\n */\n@Injectable()\nexport class Hello\n  extends Base\n  implements Runs, Stops\n{\n  // no doc\n  say(\n    name: string,\n  ): void {\n    call(\n      name,\n    );\n  }\n}\n\nfunction wide(\n  a,\n  b,\n) {\n  return a;\n}\n",
    "b.py": "class Tool(\n    Base,\n    Other,\n):\n    \"\"\"A tool.\n\n    For work.\n    \"\"\"\n\n    def run(self, x: int = f(1)) -> int:  # note\n        'no doc'\n        return x\n\n    def go(\n        self,\n    ):\n        r\"\"\"Goes.\"\"\"\n        if self.run(1):\n            \"\"\"no doc\"\"\"\n",
    "c.go": "// Run runs.\n// Again.\nfunc Run() {\n}\n\n// apart\n\nfunc Other() {\n}\n",
    "d.rs": "/// Adds.\n#[inline]\npub fn add(a: i32) -> i32 {\n    a\n}\n// plain\nfn sub() {\n}\n",
    "e.cs": "public class Box\n{\n    /// Opens it.\n    public int Open(int by)\n    {\n        foreach (var x in y)\n        {\n        }\n        return by;\n    }\n}\n",
}


def test_headers_of_several_lines_and_docstrings(spark):
    rows = [(p, "r", p.rsplit(".", 1)[1], c) for p, c in WIDE.items()]
    found = spark.createDataFrame(rows, "path string, repository_id string, ext string, content string").withColumn("language", files.language(F.col("path"))).drop("ext")
    nodes = files.symbols(found)
    out = {(r["file_path"], r["qualified_name"]): (r["kind"], r["line_start"], r["line_end"], r["docstring"]) for r in nodes.collect()}
    assert out == {
        ("a.ts", "Hello"): ("class", 6, 18, "Says hello.\nTwice."),
        ("a.ts", "Hello.say"): ("method", 11, 17, None),
        ("a.ts", "wide"): ("function", 20, 25, None),
        ("b.py", "Tool"): ("class", 1, 20, "A tool.\n\nFor work."),
        ("b.py", "Tool.run"): ("function", 10, 13, None),
        ("b.py", "Tool.go"): ("function", 14, 20, "Goes."),
        ("c.go", "Run"): ("function", 3, 4, "Run runs.\nAgain."),
        ("c.go", "Other"): ("function", 8, 9, None),
        ("d.rs", "add"): ("function", 3, 5, "Adds."),
        ("d.rs", "sub"): ("function", 7, 8, None),
        ("e.cs", "Box"): ("class", 1, 11, None),
        ("e.cs", "Box.Open"): ("method", 4, 10, "Opens it."),
    }
    above = {(r["parent_name"], r["kind"]) for r in files.parents(files.bodies(nodes, found)).collect()}
    assert above == {("Base", "extends"), ("Runs", "implements"), ("Stops", "implements"), ("Other", "extends")}


def test_compact_payload(spark):
    rows = spark.createDataFrame([("1", "a", "function", None, "r", "go", 1), ("2", "b", "class", 3, "r", "go", 2)], "id string, name string, kind string, complexity int, repository_id string, language string, seq int")
    payload = json.loads(compact.compact_page(rows, 2, False).first()["payload"])
    assert payload == {"r": [{"n": "a", "k": "function"}, {"n": "b", "k": "class", "cx": 3}], "rid": "r", "lang": "go", "t": 2, "m": False}
    mixed = rows.withColumn("language", F.col("name"))
    assert "lang" in json.loads(compact.compact_page(mixed, 2, False).first()["payload"])["r"][0]


def test_full_payload_and_rows_by_key(spark):
    rows = spark.createDataFrame([("2", "b", None, 2), ("1", "a", "go", 1)], "id string, qualified_name string, language string, seq int")
    full = compact.full_page(rows, 5, 2, 0)
    assert json.loads(full) == {"results": [{"id": "1", "qualifiedName": "a", "language": "go"}, {"id": "2", "qualifiedName": "b", "language": None}], "total": 5, "limit": 2, "offset": 0, "hasMore": True}
    assert full.startswith('{\n  "results": [\n    {\n      "id": "1",')
    assert [r["id"] for r in lookup.by_key(rows, id="2").collect()] == ["2"] and [r["id"] for r in lookup.by_key(rows, language=None, seq=2).collect()] == ["2"]
    for broken in (lambda: compact.full_page(rows, 1, 0, 0), lambda: lookup.by_key(rows)):
        with pytest.raises(ValueError):
            broken()


def test_accents_make_no_difference(spark):
    docs = spark.createDataFrame([(1, "un café noir"), (2, "UN CAFE\u0301 NOIR"), (3, "cafe noir"), (4, "smørrebrød"), (5, "Straße"), (6, None)], "id long, text string")
    ids = lambda phrase, **more: {r["id"] for r in search.exact_search(docs, "id", ["text"], phrase, stem=False, **more).collect()}
    assert ids("cafe noir") == ids("CAFÉ noir") == {1, 2, 3} and ids("café", fold=False) == {1}
    assert ids("smorrebrod") == set() and ids("smørrebrød") == {4} and ids("strasse") == set()


def test_fusion(spark):
    leg = lambda *rows: spark.createDataFrame(list(rows), "id string, place int")
    out = {r["id"]: r["score"] for r in search.reciprocal_ranks(leg(("n1", 1), ("n2", 2)), leg(("n3", 1), ("n1", 2))).collect()}
    assert out == pytest.approx({"n1": 1 / 61 + 1 / 62, "n3": 1 / 61, "n2": 1 / 62})
    assert [r["id"] for r in search.reciprocal_ranks(None, leg(("a", 1), ("b", 2), ("b", 3))).collect()] == ["b", "a"]
    with pytest.raises(ValueError):
        search.reciprocal_ranks(None, None)
    docs = spark.createDataFrame([(1, "user_login of the day"), (2, "userLogin"), (3, None)], "id long, text string")
    assert [r["id"] for r in search.exact_search(docs, "id", ["text"], "user-login").collect()] == [1]
    assert search.exact_search(docs, "id", ["text"], " - ").count() == 0


# pairs of word and stem that the algorithm's paper prints, and what stays as it is
STEMS = (
    "caresses caress|ponies poni|ties ti|caress caress|cats cat|feed feed|agreed agre|plastered plaster|bled bled|motoring motor|sing sing|conflated conflat|troubled troubl|sized size|hopping hop|tanned tan|falling fall|hissing hiss|"
    "fizzed fizz|failing fail|filing file|happy happi|sky sky|relational relat|conditional condit|rational ration|digitizer digit|vietnamization vietnam|predication predic|operator oper|feudalism feudal|decisiveness decis|"
    "hopefulness hope|triplicate triplic|formative form|formalize formal|electrical electr|goodness good|revival reviv|allowance allow|airliner airlin|adjustable adjust|replacement replac|adjustment adjust|adoption adopt|"
    "communism commun|activate activ|homologous homolog|effective effect|probate probat|rate rate|cease ceas|controll control|roll roll|running run|visibility visibl|is is|a a|12s 12|\u00e9t\u00e9s \u00e9t\u00e9"
)


def test_stems(spark):
    words, expected = zip(*[pair.split() for pair in STEMS.split("|")], strict=True)
    long = "x" * 64 + "s"
    got = spark.createDataFrame([(list(words) + [long],), ([],), (None,)], "w array<string>").select(stem.stems(F.col("w")).alias("s")).collect()
    assert got[0]["s"] == [*expected, long] and got[1]["s"] == [] and got[2]["s"] is None


def test_words_of_a_stem_match_its_forms(spark):
    ends = ["", "s", "es", "ed", "ing", "y", "ies", "e", "er", "ational", "ization", "ability", "ibility", "fulness", "iveness", "icate", "ement", "ll", "lly", "logy", "bled", "tted", "tion"]
    words = sorted({a + b + c for a in ("run", "troubl", "vis", "hop", "at", "siz", "happ", "the", "bab", "geolog") for b in ends for c in ends})
    row = spark.createDataFrame([(words,)], "w array<string>").select(F.arrays_zip("w", stem.stems(F.col("w")).alias("s")).alias("z")).first()["z"]
    import re

    assert [p for p in row if not re.fullmatch(stem.forms(p["s"]).replace(r"[\p{L}\p{N}]", r"\w"), p["w"])] == []


def test_stemmed_search_and_the_stored_index(spark, tmp_path):
    schema = "id long, title string, body string"
    docs = spark.createDataFrame([(1, "Run", "he runs running running fast"), (2, None, "a runner"), (3, "fast runs", "run fastly"), (4, "", ""), (5, None, None)], schema)
    both = ["title", "body"]
    ids = lambda df: [(r["id"], round(r["rank"], 9)) for r in df.collect()]
    scan = lambda table, phrase, **more: ids(search.exact_search(table, "id", both, phrase, **more))
    assert {i for i, _ in scan(docs, "runs")} == {1, 3} and {i for i, _ in scan(docs, "runs", fields=["title"])} == {1, 3}
    assert [i for i, _ in scan(docs, "RUNNING fast", fields=["body"])] == [1]
    assert {i for i, _ in scan(docs, "running running")} == {1} and {i for i, _ in scan(docs, "runs", stem=False)} == {1, 3} and scan(docs, "runs fastest", stem=False) == []
    path = str(tmp_path / "index")
    for _ in range(2):  # a batch that is tried again changes nothing
        text_index.add_batch(docs, "id", both, path, 0)
    stored = lambda phrase, **more: ids(text_index.phrase_search(spark, path, phrase, **more))
    for phrase in ("runs", "running fast", "run", "nobody", " - ", "a"):
        assert stored(phrase) == scan(docs, phrase) and stored(phrase, fields=["body"], stem=False) == scan(docs, phrase, fields=["body"], stem=False)
    text_index.add_batch(spark.createDataFrame([(2, None, "run"), (6, "runs", None)], schema), "id", both, path, 1, spark.createDataFrame([(3,), (2,)], "id long"))
    now = spark.createDataFrame([(1, "Run", "he runs running running fast"), (2, None, "run"), (4, "", ""), (5, None, None), (6, "runs", None)], schema)
    assert stored("runs") == scan(now, "runs") and stored("runner") == []
    before = {phrase: stored(phrase) for phrase in ("runs", "running fast", "run")}
    merged = str(tmp_path / "merged")
    assert text_index.compact(spark, path, merged) == 1
    path = merged
    assert {phrase: stored(phrase) for phrase in before} == before
    assert spark.read.parquet(f"{path}/postings").where("id = 3").isEmpty() and spark.read.parquet(f"{path}/words").where("word = 'fastly'").isEmpty()
    text_index.add_batch(docs.limit(0), "id", both, path, 2, docs.select("id"))
    assert {i for i, _ in stored("runs")} == {6}


def test_export_lists_and_constants(spark):
    content = "class A {\n}\nfunction b() {\n}\nfunction c() {\n}\nexport {\n  A,\n  b as bee,\n}\nexport { c } from './c'\nexport const K = 1, L = 2\nexport type T = string\n"
    assert sorted(one(spark, files.exported_names(F.lit(content)))) == ["A", "K", "T", "b"] and [x for x in one(spark, files.exported_names(F.lit("let x"))) if x] == []
    found = spark.createDataFrame([("a.ts", "r", "typescript", content)], "path string, repository_id string, language string, content string")
    assert {(r["name"], r["is_exported"]) for r in files.symbols(found).collect()} >= {("A", True), ("b", True), ("c", False)}


def test_texts_that_scrubbing_passes_over(spark):
    texts = ["PA\u017fSWORD = hunter2hunter2", "password\x1c=\x1fhunter2hunter2", "password\u00a0= hunter2hunter2", "plain", "", None, "token: " + "a" * 20 + "\nx token: " + "a" * 20]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", text.scrub(F.col("t")).alias("s")).orderBy("k").collect()
    assert [len(r["s"]["detected"]) for r in rows] == [1, 1, 1, 0, 0, 0, 2]
    assert [r["s"]["scrubbed"] for r in rows[3:6]] == ["plain", "", None] and rows[6]["s"]["scrubbed"] == "[REDACTED:token]\nx [REDACTED:token]"
    assert [d["line"] for d in rows[6]["s"]["detected"]] == [1, 2]


def _sample(rnd, parsed):
    """A string that a parsed pattern matches."""
    from re import _constants as op

    out = ""
    for kind, arg in parsed:
        if kind is op.LITERAL:
            out += chr(arg)
        elif kind is op.NOT_LITERAL or kind is op.ANY:
            out += "z"
        elif kind is op.IN:
            name, value = rnd.choice(arg)
            out += "z" if name is op.NEGATE or arg[0][0] is op.NEGATE else chr(rnd.randint(*value)) if name is op.RANGE else chr(value) if name is op.LITERAL else " "
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            out += "".join(_sample(rnd, arg[2]) for _ in range(rnd.randint(arg[0], min(arg[1], arg[0] + 3))))
        elif kind is op.SUBPATTERN:
            out += _sample(rnd, arg[3])
        elif kind is op.BRANCH:
            out += _sample(rnd, rnd.choice(arg[1]))
    return out


def test_every_match_of_a_pattern_passes_the_first_test(spark):
    import random
    import re

    rnd, rows = random.Random(11), []
    for category, confidence, ignore_case, pattern in text.PATTERNS:
        if confidence < text.COUNTS_FROM:
            continue
        for _ in range(25):
            sample = _sample(rnd, re._parser.parse(pattern))
            if ignore_case:
                sample = "".join(rnd.choice([c, c.upper(), c.lower(), {"s": "\u017f", "k": "\u212a", "i": "\u0131"}.get(c, c)]) for c in sample)
            if re.search(pattern, sample, re.I if ignore_case else 0):
                rows.append((category, f"x {sample} y"))
                assert text._needle(pattern) and any(c in sample for c in text._OTHER_CASES) or text._needle(pattern).lower() in sample.lower()
    table = spark.createDataFrame(rows, "category string, t string")
    assert [tuple(r) for r in table.where(~text.may_hold_secrets(F.col("t"))).collect()] == [] and len({c for c, _ in rows}) > 25


def test_scratch_is_cleared(spark, tmp_path):
    import os

    from tessera import storage

    kept = list(storage._PATHS)
    storage._PATHS.clear()  # what other tests settled stays
    try:
        storage.settle(spark.range(3), "mine")
        where = storage._PATHS[0].removeprefix("file:")
        assert os.path.isdir(where) and storage.clear_scratch(spark) == 1 and not os.path.exists(where)
    finally:
        storage._PATHS.extend(kept)
