"""Source trees as tables: files, symbols and references, by built-in functions.

A file is read once as binary. Comments and literals are blanked (:mod:`tessera.sources.lexer`), declarations are found
by regex in what is left, and a declaration's end and parent follow from the brackets of its block, or from indentation
where blocks have none, all within the file's row, so nothing is shuffled. This covers the common declaration forms of
the listed languages, not full grammars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.ignore import ignored
from tessera.schema import node_id, short_hash
from tessera.sources.lexer import BRACES, braces, code_only, extents

# What a walk skips, what it takes, and what each extension means.
SKIP_DIRS = (
    "node_modules", ".git", ".svn", ".hg", "vendor", "__pycache__", ".venv", "venv", "dist", "build", "out", "target",
    ".next", ".nuxt", ".cache", ".parcel-cache", "coverage", ".nyc_output", ".tox", ".eggs", "bower_components", "jspm_packages",
)
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "rs": "rust", "go": "go",
    "java": "java", "c": "c", "cpp": "cpp", "cc": "cpp", "h": "c", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php",
    "swift": "swift", "kt": "kotlin", "dart": "dart",
}
MOST_BYTES = 1024 * 1024
CALL_KEYWORDS = ("if", "for", "while", "switch", "catch", "return", "throw", "new", "typeof", "instanceof", "function", "class", "import", "export", "const", "let", "var", "await", "async", "yield")
MOST_CALL_LINES = 500

_DECLARATION = (
    r"^\s*(?:(?:export|default|public|private|protected|internal|static|abstract|final|async|pub|override|open|suspend)\s+)*"
    r"(function\*?|def|fn|func|fun|class|interface|struct|enum|trait|type|namespace|module)\s+(?:\([^)]*\)\s*)?([A-Za-z_$][\w$]*)"
)
_METHOD = r"^\s+(?:(?:public|private|protected|internal|static|async|final|override)\s+)*(?:[\w<>\[\],.?]+\s+)?([A-Za-z_$][\w$]*)\s*\([^;]*\)\s*(?::\s*[^{;]+)?\{\s*$"

#: A method whose header goes on in further lines, or whose block opens on a line of its own.
_OPEN_METHOD = r"^\s+(?:(?:public|private|protected|internal|static|async|final|override)\s+)*(?:[\w<>\[\],.?]+\s+)?([A-Za-z_$][\w$]*)\s*\([^;{}=]*$"
#: A line that closes a header of several lines, or only opens the block.
_HEAD_END = r"^\s*(?:[)}\]][^;]*[{:]|\{)\s*$"
_NO_METHODS = (*CALL_KEYWORDS, "foreach", "using", "lock", "synchronized", "with", "elif", "match", "guard", "unless", "until")

# generic arguments, three deep
_GENERIC = r"<[^<>(){};]*(?:<[^<>(){};]*(?:<[^<>(){};]*>[^<>(){};]*)*>[^<>(){};]*)*>"
_MODIFIERS = r"(?:@[\w.]+(?:\([^()]*\))?\s+)*(?:(?:public|private|protected|internal|static|async|final|override|abstract|virtual|synchronized|readonly|sealed|inline|unsafe|get|set)\s+)*"
_TYPED = rf"(?:{_GENERIC}\s*)?(?:[\w$.]+(?:{_GENERIC})?[?\[\]*&]*\s+[*&]*)"
#: A header that may be a method's if it stands in a type and opens a block, and one of a function outside of blocks.
_IN_TYPE = rf"^\s*{_MODIFIERS}{_TYPED}?([A-Za-z_$][\w$]*)\s*(?:{_GENERIC})?\s*\("
_OUTSIDE = rf"^(?:(?:static|inline|extern|const|unsigned|signed|struct)\s+)*{_TYPED}+([A-Za-z_]\w*)\s*\("
_TYPES = ("class", "interface", "struct", "enum", "trait", "namespace", "module")
_PLAIN_FUNCTIONS = ("c", "cpp", "dart")

_DOC_IN_PYTHON = r"(?s)\A[^\n(:]*(?:\((?:[^()]++|\([^()]*+\))*+\))?[^\n:(]*:[ \t]*(?:#[^\n]*)?\n\s*[rRuU]?(?:\"{3}(.*?)\"{3}|'{3}(.*?)'{3})"
_DOC_BLOCK = r"(?s)/\*\*(?!/)((?:[^*]++|\*(?!/))*+)\*/\s*(?:[@#\[][^\n]*\n\s*)*+\z"
_DOC_LINES = r"(?m)((?:^[ \t]*{mark}[^\n]*\n)++)(?:[ \t]*[@#\[][^\n]*\n)*+\z"


def extension(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, r"\."), -1))


def language(path: Column) -> Column:
    """By extension; an unknown extension stands for itself."""
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, extension(path)), extension(path))


def supported_languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in sorted(set(LANGUAGES.values()))], "language string")


def is_source(path: Column, length: Column) -> Column:
    """Known extension, no hidden or skipped directory, and not too large."""
    parts = F.split(path, "/")
    skipped = F.exists(parts, lambda p: p.startswith(".") | p.isin(*SKIP_DIRS))
    return extension(path).isin(*LANGUAGES) & ~skipped & (length <= MOST_BYTES)


def discover(spark: SparkSession, root: str, patterns: tuple[str, ...] | None = None) -> DataFrame:
    """(path, repository_id, hash, mtime, size, language, content) of the source files below ``root``; paths relative."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    clean = root.removeprefix("file://").rstrip("/")
    path = F.regexp_replace(F.col("path"), rf"^(file:)?/*(?=/).*?\Q{clean}\E/", "")
    own = raw.withColumn("path", path)
    own = own.where(is_source(F.col("path"), F.col("length")) & ~ignored(F.col("path"), patterns))
    return own.select("path", short_hash(F.lit(clean)).alias("repository_id"), F.sha2("content", 256).alias("hash"), (F.unix_millis("modificationTime")).alias("mtime"), F.col("length").alias("size"), language(F.col("path")).alias("language"), F.decode("content", "utf-8").alias("content"))


def node_kind(kind: Column) -> Column:
    """The first of these that the grammar's word contains; what contains none is a function."""
    low = F.lower(kind)
    # The words in the order they are tried, and what each means.
    order = (("function", "function"), ("method", "method"), ("class", "class"), ("interface", "interface"), ("type", "type"), ("variable", "variable"), ("var", "variable"), ("const", "constant"), ("import", "import"), ("export", "export"), ("module", "module"), ("namespace", "namespace"))
    out = F.when(low.contains(order[0][0]), order[0][1])
    for word, means in order[1:]:
        out = out.when(low.contains(word), means)
    return out.otherwise("function")


def visibility(word: Column) -> Column:
    low = F.lower(word)
    return F.when(low.isin("public", "private", "protected", "internal"), low)


def lines(files: DataFrame) -> DataFrame:
    """(path, repository_id, language, line, text, indent): one row a line, counted from 1; indent of blank lines is null."""
    split = files.select("path", "repository_id", "language", F.posexplode(F.split("content", "\n")).alias("at", "text"))
    blank = F.trim("text") == ""
    return split.select("path", "repository_id", "language", (F.col("at") + 1).alias("line"), "text", F.when(~blank, F.length("text") - F.length(F.ltrim("text"))).alias("indent"))


def line_range(content: Column, first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last``, counted from 1, as one text."""
    return F.array_join(F.slice(F.split(content, "\n"), F.greatest(first, F.lit(1)), F.greatest(last - first + 1, F.lit(0))), "\n")


def _outline(content: Column) -> Column:
    """For each line: its number and indent, whether it closes a block, and what it declares, if anything."""

    def entry(text: Column, at: Column) -> Column:
        word, name, method = F.regexp_extract(text, _DECLARATION, 1), F.regexp_extract(text, _DECLARATION, 2), F.regexp_extract(text, _METHOD, 1)
        open_method = F.regexp_extract(text, _OPEN_METHOD, 1)
        is_method = (name == "") & (method != "") & ~method.isin(*_NO_METHODS)
        return F.struct(
            (at + 1).alias("line"),
            (F.length(text) - F.length(F.ltrim(text))).alias("indent"),
            text.rlike(r"^\s*(?:[})\]]|end\s*$)").alias("closing"),
            text.rlike(_HEAD_END).alias("head_end"),
            F.when((name == "") & ~is_method & (open_method != "") & ~open_method.isin(*_NO_METHODS), open_method).alias("open_method"),
            F.when(is_method, "method").when(word.isin("def", "fn", "func", "fun"), "function").otherwise(word).alias("word"),
            F.when(is_method, method).otherwise(name).alias("name"),
            F.regexp_extract(text, r"^\s*(public|private|protected|internal)\b", 1).alias("visibility"),
            text.rlike(r"^\s*(export|pub)\b").alias("exported"),
            (F.trim(text) == "").alias("blank"),
        )

    return F.filter(F.transform(F.split(content, "\n"), entry), lambda x: ~x["blank"])


def _after(x: Column, d: Column) -> Column:
    """Whether a line stands behind a declaration and is indented no deeper."""
    return (x["line"] > d["line"]) & (x["indent"] <= d["indent"])


def _with_open_methods(outline: Column) -> Column:
    """The outline, in which methods are declared too whose header ends on a later line."""

    def entry(d: Column) -> Column:
        ends = F.get(F.filter(outline, lambda x: _after(x, d)), F.lit(0))
        # looked up only for lines that may be such a header
        holds = F.when(d["open_method"].isNotNull(), F.coalesce(ends["head_end"] & (ends["indent"] == d["indent"]), F.lit(False))).otherwise(False)
        return d.withField("word", F.when(holds, "method").otherwise(d["word"])).withField("name", F.when(holds, d["open_method"]).otherwise(d["name"]))

    return F.transform(outline, entry)


def _docstring(rows: Column, language: Column, above: Column, line: Column, end: Column) -> Column:
    """What documents a declaration: a string that its block begins with, or the comment right above it. ``above`` is
    the line of the declaration before, so that no comment is looked for twice."""
    own = F.array_join(F.slice(rows, line, F.greatest(end - line + 1, F.lit(1))), "\n")
    inside = F.concat(F.regexp_extract(own, _DOC_IN_PYTHON, 1), F.regexp_extract(own, _DOC_IN_PYTHON, 2))
    before = F.concat(F.array_join(F.slice(rows, above + 1, F.greatest(line - 1 - above, F.lit(0))), "\n"), F.lit("\n"))
    block = F.regexp_replace(F.regexp_extract(before, _DOC_BLOCK, 1), r"(?m)^[ \t]*\*[ \t]?", "")
    slashes = F.when(language == "go", F.regexp_extract(before, _DOC_LINES.format(mark="//"), 1)).otherwise(F.regexp_extract(before, _DOC_LINES.format(mark="///"), 1))
    found = F.when(language == "python", inside).when(block != "", block).otherwise(F.regexp_replace(slashes, r"(?m)^[ \t]*/{2,}!?[ \t]?", ""))
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(found, r"(?m)^[ \t]+|[ \t\r]+$", ""), r"\A\n+|\n+\z", "")), F.lit(""))


def _by_brackets(code: Column, language: Column) -> Column:
    """Declarations (d), their last lines and their parents' names, by the brackets of blocks."""

    def entry(text: Column, at: Column) -> Column:
        word, name = F.regexp_extract(text, _DECLARATION, 1), F.regexp_extract(text, _DECLARATION, 2)
        taken = lambda pattern: F.regexp_extract(text, pattern, 1)
        only = lambda found: F.when(found.isin(*_NO_METHODS), "").otherwise(found)
        counts = braces(text)
        return F.struct(
            (at + 1).alias("line"), counts["delta"].alias("delta"), counts["low"].alias("low"), counts["high"].alias("high"), text.rlike(r";\s*$").alias("stops"),
            F.when(word.isin("def", "fn", "func", "fun"), "function").otherwise(word).alias("word"), name.alias("name"), word.isin(*_TYPES).alias("holds"),
            F.when(name == "", only(taken(_IN_TYPE))).otherwise("").alias("method"), F.when((name == "") & language.isin(*_PLAIN_FUNCTIONS), only(taken(_OUTSIDE))).otherwise("").alias("plain"),
            F.regexp_extract(text, r"^\s*(public|private|protected|internal)\b", 1).alias("visibility"), text.rlike(r"^\s*(export|pub)\b").alias("exported"), (F.trim(text) == "").alias("blank"),
        )

    def placed(outline: Column) -> Column:
        named = lambda x, inner: F.when(x["name"] != "", x["name"]).when(inner, x["method"]).otherwise(x["plain"])

        def one(e: Column) -> Column:
            x, outer = F.get(outline, e["k"]), F.get(outline, F.when(e["parent"] >= 0, e["parent"]))
            inner = e["parent"] >= 0
            word = F.when(x["name"] != "", x["word"]).when(inner, "method").otherwise("function")
            d = F.struct(x["line"].alias("line"), word.alias("word"), named(x, inner).alias("name"), x["visibility"].alias("visibility"), x["exported"].alias("exported"))
            return F.struct(d.alias("d"), e["end"].alias("end"), named(outer, F.lit(True)).alias("parent"))

        return F.transform(extents(outline), one)

    outline = F.filter(F.transform(F.split(code, "\n"), entry), lambda x: ~x["blank"])
    # bound by the lambda, so that the outline is made once
    return F.get(F.transform(F.array(outline), placed), F.lit(0))


def exported_names(content: Column) -> Column:
    """Names that a file exports: of its exported declarations, and of its export lists by their local name."""
    declared = F.regexp_extract_all(content, F.lit(r"(?m)^\s*export\s+(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\*?|class|interface|const|let|var|type|enum)\s+([\w$]+)"), F.lit(1))
    # a list that is followed by ``from`` names another file's symbols
    listed = F.regexp_extract_all(content, F.lit(r"(?m)^\s*export\s*(?:type\s*)?\{([^}]*)\}(?!\s*from\b)"), F.lit(1))
    local = F.transform(F.split(F.array_join(listed, ","), ","), lambda x: F.regexp_extract(x, r"([\w$]+)", 1))
    return F.array_distinct(F.filter(F.concat(declared, local), lambda x: x != ""))


def symbols(files: DataFrame) -> DataFrame:
    """Nodes of every file, found within the file's row.

    A declaration ends with the block it opens, or with its statement; its parent is the innermost declaration that is
    open where it stands. In languages without braces it ends before the next line that is indented no deeper, or with
    it if it closes a block; its parent is the nearest declaration before it that is indented less.
    """
    code = code_only(F.col("content"), F.col("language"))
    masked = files.select("path", "repository_id", "language", F.split("content", "\n").alias("rows"), code.alias("code"))
    indented = F.when(~F.col("language").isin(*BRACES), _with_open_methods(_outline(F.col("code"))))
    outlined = masked.withColumns({"outline": indented, "exported_names": exported_names(F.col("code"))}).withColumn("declared", F.filter("outline", lambda x: x["name"] != ""))

    def place(d: Column) -> Column:
        # the line that closes the header does not end the declaration
        end_at = F.get(F.filter("outline", lambda x: _after(x, d) & ~(x["head_end"] & (x["indent"] == d["indent"]))), F.lit(0))
        outer = F.filter("declared", lambda x: (x["line"] < d["line"]) & (x["indent"] < d["indent"]))
        end = F.when(end_at.isNull(), F.size("rows")).otherwise(end_at["line"] - F.when(end_at["closing"], 0).otherwise(1))
        return F.struct(F.struct(*[d[c].alias(c) for c in ("line", "word", "name", "visibility", "exported")]).alias("d"), end.alias("end"), F.get(outer, F.size(outer) - 1)["name"].alias("parent"))

    # places are found before the rows are dealt out, so that no declaration carries its whole file
    placed = outlined.withColumn("placed", F.when(F.col("language").isin(*BRACES), _by_brackets(F.col("code"), F.col("language"))).otherwise(F.transform("declared", place)))
    above = lambda k: F.when(k > 0, F.get("placed", k - 1)["d"]["line"]).otherwise(0)
    full = F.transform("placed", lambda p, k: F.struct(p["d"].alias("d"), p["end"].alias("end"), p["parent"].alias("parent"), _docstring(F.col("rows"), F.col("language"), above(k), p["d"]["line"], p["end"]).alias("docstring"), F.array_contains("exported_names", p["d"]["name"]).alias("by_name")))
    own = placed.select("path", "repository_id", "language", F.explode(full).alias("p")).select("path", "repository_id", "language", "p.*")
    end = F.col("end")
    qualified = F.concat_ws(".", "parent", "d.name")
    line = F.col("d.line")
    seq = F.shiftleft(F.pmod(F.xxhash64("path"), F.lit(1 << 40)), 20) + line
    return own.select(
        node_id(F.col("path"), qualified, line).alias("id"), F.col("d.name").alias("name"), qualified.alias("qualified_name"), node_kind(F.col("d.word")).alias("kind"), F.col("path").alias("file_path"),
        line.alias("line_start"), end.cast("int").alias("line_end"), visibility(F.col("d.visibility")).alias("visibility"), (F.col("d.exported") | F.col("by_name")).alias("is_exported"), "docstring",
        F.lit(None).cast("int").alias("complexity"), "repository_id", "language", seq.alias("seq"),
    )


def bodies(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """``nodes`` with the text of their lines in ``body``."""
    text = files.select(F.col("path").alias("b_path"), F.col("repository_id").alias("b_repo"), "content")
    joined = nodes.join(text, (F.col("file_path") == F.col("b_path")) & (F.col("repository_id") == F.col("b_repo")))
    return joined.withColumn("body", line_range(F.col("content"), F.col("line_start"), F.col("line_end"))).drop("b_path", "b_repo", "content")


def called_names(body: Column) -> Column:
    """Names before an opening bracket, but for keywords, then names after a dot and before a bracket, each once."""
    plain = F.filter(F.regexp_extract_all(body, F.lit(r"\b([a-zA-Z_$][\w$]*)\s*\("), F.lit(1)), lambda x: ~x.isin(*CALL_KEYWORDS))
    return F.array_distinct(F.concat(plain, F.regexp_extract_all(body, F.lit(r"\.([a-zA-Z_$][\w$]*)\s*\("), F.lit(1))))


def calls(with_bodies: DataFrame) -> DataFrame:
    """(caller_id, callee_name, line, repository_id) of functions and methods of fewer than MOST_CALL_LINES lines."""
    short = with_bodies.where(F.col("kind").isin("function", "method") & (F.col("line_end") - F.col("line_start") < MOST_CALL_LINES))
    return short.select(F.col("id").alias("caller_id"), F.explode(called_names(code_only(F.col("body"), F.col("language")))).alias("callee_name"), F.col("line_start").alias("line"), "repository_id")


def parents(with_bodies: DataFrame) -> DataFrame:
    """(child_id, parent_name, kind, repository_id) from the header of the declaration."""
    # a header ends with its block's opening; in Python only its brackets go over lines
    head = F.when(F.col("language") == "python", F.substring_index("body", "\n", 1)).otherwise(F.regexp_extract("body", r"^[^{;]*", 0))
    python = F.split(F.regexp_extract("body", r"^\s*class\s+\w+\s*\(([^)]*)\)", 1), ",")
    extends = F.concat(F.array(F.regexp_extract(head, r"\bextends\s+(\w+)", 1)), python)
    implements = F.split(F.regexp_extract(head, r"\bimplements\s+([\w\s,]+)", 1), ",")
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "").alias("n")
    both = F.concat(F.transform(extends, lambda x: F.struct(bare(x), F.lit("extends").alias("k"))), F.transform(implements, lambda x: F.struct(bare(x), F.lit("implements").alias("k"))))
    own = with_bodies.where(F.col("kind").isin("class", "interface"))
    return own.select(F.col("id").alias("child_id"), F.explode(F.filter(both, lambda x: x["n"] != "")).alias("x"), "repository_id").select("child_id", F.col("x.n").alias("parent_name"), F.col("x.k").alias("kind"), "repository_id")


def imports(files: DataFrame) -> DataFrame:
    """(file_path, source, imported, is_default, line, repository_id): each imported name of each import line."""
    rows = lines(files).where(F.col("text").rlike(r"^\s*(import|export)\b.*\bfrom\b|^\s*import\b|\brequire\s*\("))
    text = F.col("text")
    source = F.coalesce(F.nullif(F.regexp_extract(text, r"from\s+['\"]([^'\"]+)['\"]", 1), F.lit("")), F.regexp_extract(text, r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", 1))
    braces = F.filter(F.transform(F.split(F.regexp_extract(text, r"\{\s*([^}]+)\s*\}", 1), ","), lambda p: F.trim(p)), lambda p: p != "")
    named = F.transform(braces, lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r"\w+\s+as\s+(\w+)", 1), F.lit("")), p))
    default = F.regexp_extract(text, r"import\s+(\w+)\s+from", 1)
    star = F.regexp_extract(text, r"\*\s+as\s+(\w+)", 1)
    names = F.filter(F.concat(F.transform(named, lambda n: F.struct(n.alias("name"), F.lit(False).alias("d"))), F.array(F.struct(default.alias("name"), F.lit(True).alias("d")), F.struct(star.alias("name"), F.lit(False).alias("d")))), lambda x: x["name"] != "")
    return rows.select(F.col("path").alias("file_path"), source.alias("source"), F.explode(names).alias("x"), "line", "repository_id").where("source <> ''").select("file_path", "source", F.col("x.name").alias("imported"), F.col("x.d").alias("is_default"), "line", "repository_id")
