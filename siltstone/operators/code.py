"""Structure of source code: what is declared where, inside what, and what it calls.

A scanner blanks out strings and comments and then walks through the text with a stack: of
indents for Python, of braces for other languages. Each declaration gets its parent, the
lines from its own to its last, its bases and the names that it calls itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltstone.operators import graph
from siltstone.operators.extract import CODE, language_of
from siltstone.storage import cut

SCHEMA = "path string, language string, kind string, name string, parent string, qualified string, start_line int, end_line int, bases array<string>, calls array<string>"
#: Words before a bracket that are no calls and no names, in all languages and in some (fixed values).
KEYWORDS = ["if", "for", "while", "switch", "catch", "return", "new", "try", "do", "else", "super"]
MORE = {
    "python": ["elif", "with", "and", "or", "not", "in", "is", "lambda", "yield", "await", "assert", "except", "del", "raise", "import", "from", "async", "def", "class"],
    "java": ["synchronized", "this"],
    "csharp": ["using", "lock", "foreach", "fixed", "when", "sizeof", "typeof", "nameof", "base", "this", "await"],
    "kotlin": ["when", "constructor"],
    "go": ["func"],
    "rust": ["match", "fn", "in", "loop"],
    "typescript": ["function", "await", "typeof", "async"],
    "javascript": ["function", "await", "typeof", "async"],
}
#: Declarations that leave a worker at a time.
ROWS = 2000
_calls = re.compile(r"(?<![\w.])((?:\w+\.)*\w+)\s*\(").findall


@dataclass(slots=True)
class Entity:
    kind: str
    name: str
    parent: "Entity | None"
    start: int
    end: int = 0
    bases: list[str] = field(default_factory=list)
    calls: list[str] = field(default_factory=list)
    owner: str | None = None  # a parent that is named apart, as Go's receivers are

    @property
    def within(self) -> str | None:
        return self.parent.qualified if self.parent else self.owner

    @property
    def qualified(self) -> str:
        return f"{self.within}.{self.name}" if self.within else self.name


def blanked(text: str, language: str) -> str:
    """The text with strings and comments as spaces; lines stay where they are."""
    python = language == "python"
    quotes = {"python": r"'''|\"\"\"|'|\"", "rust": "\"", "go": "\"|`|'", "java": "\"\"\"|\"|'", "kotlin": "\"\"\"|\"|'"}.get(language, "\"|'|`")
    start = re.compile(("#|" if python else r"//|/\*|") + quotes)
    out, at = [], 0
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    while found := start.search(text, at):
        out.append(text[at : found.start()])
        mark, a = found[0], found.start()
        if mark in ("#", "//"):
            end = text.find("\n", a)
            end = len(text) if end < 0 else end
        elif mark == "/*":
            end = text.find("*/", a + 2)
            end = len(text) if end < 0 else end + 2
        else:
            end, long = a + len(mark), len(mark) == 3 or mark == "`"
            raw = mark == "`" and language == "go"
            while end < len(text) and not text.startswith(mark, end) and (long or text[end] != "\n"):
                end += 2 if text[end] == "\\" and not raw else 1
            end = min(end + len(mark), len(text)) if text.startswith(mark, end) else min(end, len(text))
        out.append(blank(text[a:end]))
        at = end
    return "".join(out) + text[at:]


def called_in(code: str, language: str) -> list[str]:
    return [c for c in _calls(code) if c not in KEYWORDS and c not in MORE[language]]


def split_outside(text: str) -> list[str]:
    """Parts between commas that stand in no brackets."""
    parts, depth = [""], 0
    for c in text:
        depth += (c in "([{<") - (c in ")]}>")
        if c == "," and depth == 0:
            parts.append("")
        else:
            parts[-1] += c
    return [p.strip() for p in parts if p.strip()]


def python_entities(text: str) -> list[Entity]:
    """Classes, functions and methods by indents; a declaration ends with the last line that is indented more."""
    out: list[Entity] = []
    stack: list[tuple[int, Entity]] = []
    held, first, depth, last = "", 0, 0, 0
    code, given = blanked(text, "python").split("\n"), text.split("\n")
    for n, line in enumerate(code, 1):
        if not held:
            if not line.strip():
                if given[n - 1].strip() and not given[n - 1].lstrip().startswith("#") and len(given[n - 1]) - len(given[n - 1].lstrip()) > (stack[-1][0] if stack else 1 << 30):
                    last = n  # a string that stands alone
                    for _, e in stack:
                        e.end = n
                continue
            first = n
        held += line.rstrip("\\") + " "
        depth += sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}")
        if depth > 0 or line.endswith("\\"):
            continue
        whole, held, depth = held, "", 0
        indent = len(whole.expandtabs()) - len(whole.expandtabs().lstrip())
        while stack and stack[-1][0] >= indent:
            stack.pop()
        found = re.match(r"\s*(?:(async)\s+)?(def|class)\s+(\w+)", whole)
        inside = stack[-1][1] if stack else None
        if found:
            kind = "class" if found[2] == "class" else "method" if inside and inside.kind == "class" else "function"
            e = Entity(kind, found[3], inside, first)
            if kind == "class" and (m := re.match(r"\s*class\s+\w+\s*(?:\[[^\]]*\]\s*)?\((.*)\)\s*:", whole)):
                e.bases = [b for b in split_outside(m[1]) if "=" not in b and not b.startswith("*")]
            stack.append((indent, e))
            out.append(e)
            rest = whole[whole.rindex(":") + 1 :] if kind != "class" and ":" in whole else ""
            e.calls += called_in(rest, "python")
        elif inside and not whole.lstrip().startswith("@"):
            inside.calls += called_in(whole, "python")
        last = n
        for _, e in stack:
            e.end = last
    return out


#: Declarations that open a brace, by language: kind, pattern of what stands before the brace (fixed forms of the languages).
_TYPE = r"\b(?P<kind>{kinds})\s+(?P<name>\w+)(?P<bases>[^{{}};=]*)$"
_SIGNATURE = r"(?P<name>~?\w+)\s*(?:<[^<>()]*>\s*)?\((?:[^()]|\([^()]*\))*\)\s*{tail}$"
BRACES: dict[str, list[tuple[str | None, re.Pattern[str]]]] = {
    "java": [(None, re.compile(_TYPE.format(kinds="class|interface|enum|record"))), ("method", re.compile(_SIGNATURE.format(tail=r"(?:throws\s+[\w.,\s]+)?")))],
    "csharp": [(None, re.compile(_TYPE.format(kinds="class|interface|enum|struct|record"))), ("method", re.compile(_SIGNATURE.format(tail=r"(?::\s*(?:base|this)\s*\([^()]*\)\s*)?(?:where[^{}]*)?")))],
    "kotlin": [(None, re.compile(r"\b(?P<kind>class|interface|object)\s+(?P<name>\w+)(?P<bases>[^{};=]*)$")), ("function", re.compile(r"\bfun\s+(?:<[^>]*>\s*)?(?:[\w<>?]+\.)?(?P<name>\w+)\s*\((?:[^()]|\([^()]*\))*\)\s*(?::\s*[^{}=\n]+)?$"))],
    "go": [(None, re.compile(r"\btype\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+(?P<kind>struct|interface)\s*$")), ("function", re.compile(r"\bfunc\s+(?:\(\s*(?:\w+\s+)?\*?(?P<owner>\w+)[^)]*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\((?:[^()]|\([^()]*\))*\)[^{};]*$"))],
    "rust": [(None, re.compile(r"\b(?P<kind>struct|enum|trait|mod)\s+(?P<name>\w+)(?P<bases>[^{};]*)$")), ("impl", re.compile(r"\bimpl(?:<[^>]*>)?\s+(?:(?P<of>[\w:]+)(?:<[^>]*>)?\s+for\s+)?(?P<name>\w+)[^{};]*$")), ("function", re.compile(r"\bfn\s+(?P<name>\w+)\s*(?:<[^>]*>)?\([^{};]*$"))],
    "typescript": [(None, re.compile(_TYPE.format(kinds="class|interface|enum|namespace"))), ("function", re.compile(r"\bfunction\s*\*?\s*(?P<name>\w+)\s*(?:<[^>]*>)?\([^{};]*$")), ("function", re.compile(r"\b(?:const|let|var)\s+(?P<name>\w+)\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:function\s*\w*\s*)?(?:\((?:[^()]|\([^()]*\))*\)|\w+)\s*(?::[^={};]+)?(?:=>)?\s*$")), ("method", re.compile(r"(?:^|[\s;}])(?P<name>#?\w+)\s*(?:<[^>]*>)?\((?:[^()]|\([^()]*\))*\)\s*(?::\s*[^{}=;]+)?$"))],
}
BRACES["javascript"] = BRACES["typescript"]
_TYPES = ("class", "interface", "enum", "record", "struct", "object", "trait", "impl")


def bases_of(text: str, language: str) -> list[str]:
    """Names after extends, implements or a colon, without their parameters."""
    text = re.sub(r"\([^()]*\)", "", text) if language == "kotlin" else text
    found = re.split(r"\b(?:extends|implements|permits)\b|:", text)[1:]
    parts = [p for f in found for p in split_outside(re.split(r"\bwhere\b", f)[0])]
    return [m[0] for p in parts if (m := re.match(r"[\w.]+", p))]


def brace_entities(text: str, language: str) -> list[Entity]:
    """Types, functions and methods by braces; a declaration lasts from its name to its closing brace."""
    rules, out, words = BRACES[language], [], {*KEYWORDS, *MORE[language]}
    code = blanked(text, language)
    stack: list[tuple[Entity | None, int, int]] = []  # with the brackets that are open and where the header begins
    since, depth, line, body = 0, 0, 1, 0

    def inside() -> Entity | None:
        return next((e for e, _, _ in reversed(stack) if e), None)

    def called(upto: int) -> None:
        if (e := inside()) and e.kind not in _TYPES:
            e.calls += called_in(code[body:upto], language)

    def declared(header: str, at: int, bodied: bool) -> Entity | None:
        parent = inside()
        for kind, pattern in rules:
            found = pattern.search(header)
            if not found or found["name"] in words:
                continue
            known = found.groupdict()
            kind = known.get("kind") or kind
            in_type = parent is not None and parent.kind in _TYPES
            if kind == "method" and (not in_type or re.search(r"(?:\bnew|=|->|\.)\s*$", header[: found.start("name")]) or stack and stack[-1][0] is not parent):
                continue
            kind = "method" if kind == "function" and (in_type or known.get("owner")) else kind
            number = line - header[found.start("name") :].count("\n")
            e = Entity(kind, found["name"], parent, number, number, owner=known.get("owner"))
            e.bases = [known["of"]] if known.get("of") else bases_of(known.get("bases") or "", language) if kind in _TYPES else []
            return e
        return None

    for at, c in enumerate(code):
        if c == "\n":
            line += 1
        elif c in "()":
            depth = max(0, depth + (1 if c == "(" else -1))
        elif c == "{":
            e = declared(code[since:at], at, True) if depth == 0 else None
            called(since if e else at)
            if e:
                out.append(e)
            stack.append((e, depth, since))
            since = body = at + 1
            depth = 0
        elif c == "}":
            called(at)
            body, begun = at + 1, at + 1
            if stack:
                e, depth, begun = stack.pop()
                begun = begun if depth else at + 1  # braces in brackets are part of a header
                if e:
                    e.end = line
            since = begun
        elif c == ";" and depth == 0:
            if (p := inside()) and p.kind in ("interface", "trait") and stack[-1][0] is p and (e := declared(code[since:at], at, False)):
                out.append(e)
            since = at + 1
    return out


def entities(text: str, language: str) -> list[Entity]:
    if language == "python":
        return python_entities(text)
    return brace_entities(text, language) if language in BRACES else []


def declared(where: str, language: str, text: str) -> Iterator[tuple]:
    """Rows of one file, imports first."""
    for name in re.findall(CODE[language]["import"], text) if "import" in CODE.get(language, {}) else ():
        yield where, language, "import", name, None, name, None, None, [], []
    for e in entities(text, language):
        yield where, language, e.kind, e.name, e.within, e.qualified, e.start, e.end, list(dict.fromkeys(e.bases)), list(dict.fromkeys(e.calls))


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of files (path, language, content), one file at a time and in parts: files can be large, and a task can have all of them."""
    kinds = [pa.string()] * 6 + [pa.int32()] * 2 + [pa.list_(pa.string())] * 2
    packed = lambda out: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 10, kinds)], names=[x.split(" ")[0] for x in SCHEMA.split(", ")])
    for whole in batches:
        out: list[tuple] = []
        for a in range(len(whole)):
            where, language, text = (c[a].as_py() for c in whole.columns)
            for row in declared(where, language, text) if text is not None else ():
                out.append(row)
                if len(out) == ROWS:
                    yield packed(out)
                    out = []
        yield packed(out)


def structure(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One row a declaration of each file: kind, name, parent (qualified), lines, bases and calls; imports are rows of kind ``import``.

    The language comes from the file's ending; other files and null texts have no rows. A type
    that is implemented elsewhere (``impl`` and receivers) is a parent by its name. Unclosed
    braces end with the text as it is; repeated rows give their rows again. Narrow: texts do
    not leave their partitions, and a worker holds the declarations of one file at a time.
    """
    return files.select(F.col(path).alias("path"), language_of(F.col(path)).alias("language"), F.col(content).alias("content")).mapInArrow(scanned, SCHEMA)


def code_graph(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, name) and edges (src, dst, type) of ``structure`` rows, as the graph operators take them.

    A declaration's id is path::qualified name, a file's is ``file:`` and its path. Files and
    types contain their declarations; calls and bases lead to declarations of that last name
    in the same file, or in all files if that one has none; imports lead to ``module:`` nodes.
    The rows are written first, as they are read some ten times.
    """
    found = cut(found)
    own = F.concat_ws("::", "path", "qualified")
    d = found.where("kind <> 'import'").withColumn("id", own)
    imports = found.where("kind = 'import'").select(F.concat(F.lit("file:"), "path").alias("src"), F.concat(F.lit("module:"), "name").alias("dst"), F.lit("IMPORTS").alias("type"))
    nodes = d.select("id", F.col("kind").alias("type"), "name").distinct()
    files = found.select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("file").alias("type"), F.col("path").alias("name")).distinct()
    modules = imports.select(F.col("dst").alias("id"), F.lit("module").alias("type"), F.substring_index("dst", ":", -1).alias("name")).distinct()
    parents = d.select("path", F.col("qualified").alias("parent")).distinct().withColumn("_known", F.lit(True))
    contains = d.join(parents, ["path", "parent"], "left").select(F.when(F.col("_known"), F.concat_ws("::", "path", "parent")).otherwise(F.concat(F.lit("file:"), "path")).alias("src"), F.col("id").alias("dst"), F.lit("CONTAINS").alias("type"))
    said = d.select("id", "path", F.explode(F.concat(F.transform("calls", lambda c: F.struct(F.lit("CALLS").alias("t"), F.substring_index(c, ".", -1).alias("n"))), F.transform("bases", lambda c: F.struct(F.lit("INHERITS").alias("t"), F.substring_index(c, ".", -1).alias("n"))))).alias("x")).select("id", "path", "x.t", "x.n").distinct()
    named = d.select(F.col("id").alias("dst"), F.col("path").alias("_path"), F.col("name").alias("n")).distinct()
    met = said.join(named, "n")
    here = met.where(F.col("path") == F.col("_path"))
    there = met.join(here.select("id", "n", "t").distinct(), ["id", "n", "t"], "left_anti")
    uses = here.unionByName(there).select(F.col("id").alias("src"), "dst", F.col("t").alias("type"))
    return nodes.unionByName(files).unionByName(modules), contains.unionByName(uses).unionByName(imports).distinct()


def entity_rows(found: DataFrame) -> DataFrame:
    """Rows (name, file, calls, imports, inherits) that ``graph.code_entities_to_edges`` takes."""
    imports = found.where("kind = 'import'").groupBy("path").agg(F.collect_set("name").alias("imports"))
    none = F.array().cast("array<string>")
    return found.where("kind <> 'import'").join(imports, "path", "left").select(F.col("qualified").alias("name"), F.col("path").alias("file"), "calls", F.coalesce("imports", none).alias("imports"), F.col("bases").alias("inherits"))


def entity_edges(found: DataFrame) -> DataFrame:
    return graph.code_entities_to_edges(entity_rows(found))
