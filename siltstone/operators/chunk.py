"""Chunkers: one text in, chunk rows out.

Chunkers whose next place depends on the last chunk run in ``mapInArrow`` over whole texts;
those of regular texts (Dockerfile, Kubernetes, Istio, GraphQL) are array expressions. Every
chunker advances by one character a step at least and keeps the tail of the text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siltstone.operators.embedding import Hashing, Model

SCHEMA = "source_id string, chunk_index int, chunk_id string, content string, start_char int, end_char int, heading string, path string"
NAMES = [part.split(" ")[0] for part in SCHEMA.split(", ")]
Chunk = tuple[int, str, int, int, str | None, str | None]

_sentence = re.compile(r"[.!?]+\s+").split
_heading = re.compile(r"(#{1,6})\s+(.+)$").match
_python = re.compile(r"(class|async def|def) (\w+)").match
_braced = re.compile(r"(?:function|func) +(\w*)").match


def document(text: str, size: int = 1000, overlap: int = 200, least: int = 100) -> Iterator[Chunk]:
    """Windows of ``size`` characters without their last, unfinished sentence."""
    at = k = 0
    while at < len(text) and (at > 0 or text.strip()):
        end = min(at + size, len(text))
        piece = text[at:end]
        if end < len(text):
            whole = [s.strip() for s in _sentence(piece) if s.strip()]
            piece = " ".join(whole[:-1]) or piece
        if k and end == len(text) and len(piece) < least:
            return
        yield k, piece, at, at + len(piece), None, None
        if at + len(piece) >= len(text):
            return
        at = max(at + len(piece) - overlap, at + 1)
        k += 1


def markdown(text: str, size: int = 1500, overlap: int = 200, least: int = 100) -> Iterator[Chunk]:
    """Whole lines up to ``size`` characters, the last ones of a chunk again in the next."""
    held: list[str] = []
    total = k = 0
    for line in [*text.split("\n"), None]:
        if line is None or (held and total + len(line) > size):
            piece = "\n".join(held)
            if len(piece) >= least:
                yield k, piece, 0, len(piece), None, None
                k += 1
            tail, room = [], 0
            while held and room < overlap:
                tail.append(held.pop())
                room += len(tail[-1])
            held, total = tail[::-1], room
        if line is not None:
            held.append(line)
            total += len(line) + 1


def sections(text: str) -> Iterator[tuple[list[str], str]]:
    """(headings from the outermost, content) of each part under an ATX heading."""
    trail: list[str] = []
    held: list[str] = []
    some = False
    for line in text.split("\n"):
        if found := _heading(line):
            if held:
                some = True
                yield list(trail), "\n".join(held)
            held = []
            trail = [*trail[: len(found[1]) - 1], found[2].strip()]
        else:
            held.append(line)
    if held or not some:
        yield list(trail), "\n".join(held) if held else text


def pieces(content: str, size: int, overlap: int) -> Iterator[str]:
    """Parts of a long section, cut at line breaks where there are any."""
    at = 0
    while at < len(content):
        end = min(at + size, len(content))
        if end < len(content) and (cut := content.rfind("\n", at, end)) > at:
            end = cut
        if part := content[at:end].strip():
            yield part
        if end == len(content):
            return
        at = max(end - overlap, at + 1)


def structural(text: str, size: int = 1500, overlap: int = 200) -> Iterator[Chunk]:
    for k, (trail, content) in enumerate(sections(text)):
        heading, path = trail[-1] if trail else "Document", " > ".join(trail or ["Document"])
        if len(content) <= size:
            shown = f"{'#' * min(len(trail) + 1, 6)} {heading}\n\n{content}" if trail and heading != "Document" else content
            yield k, shown, 0, len(content), heading, path
        else:
            for j, part in enumerate(pieces(content, size, overlap)):
                yield k * 100 + j, part, 0, len(part), heading, path


def hierarchical(text: str, size: int = 1500, overlap: int = 200, deepest: int = 3) -> Iterator[Chunk]:
    k = 0
    for trail, content in sections(text):
        if len(trail) > deepest:
            continue
        heading, path = trail[-1] if trail else "Document", "|".join([trail[-1], *trail[:-1]] if trail else ["Document"])
        whole = len(content) <= size
        shown = f"{'#' * min(len(trail) + 1, 6)} {heading}\n\n{content}" if whole and heading != "Document" else content
        for part in [shown] if whole else pieces(content, size, overlap):
            yield k, part, 0, len(content) if whole else len(part), heading, path
            k += 1


def python_code(text: str, most_lines: int = 200) -> Iterator[Chunk]:
    """A chunk for each class and function, from its line to the next one's."""
    now: tuple[str, str, int] | None = None
    held: list[str] = []
    k, lines = 0, text.split("\n")
    for n, line in enumerate([*lines, None]):
        found = _python(line.strip()) if line is not None else None
        full = line is not None and not line.strip() and len(held) >= most_lines
        if now and (line is None or found or full):
            if len(content := "\n".join(held)) > 20:
                yield k, content, now[2], n - 1, now[1], now[0]
                k += 1
            now, held = None, []
        if found:
            now, held = ({"class": "class", "def": "function", "async def": "async_function"}[found[1]], found[2], n), [line]
        elif now and line is not None:
            held.append(line)


def braced_code(text: str, block: int = 100) -> Iterator[Chunk]:
    """A chunk for each function up to its closing brace, or blocks of lines if there is none."""
    lines, n, k = text.split("\n"), 0, 0
    while n < len(lines):
        if found := _braced(lines[n].strip()):
            start, depth, n = n, 0, n + 1
            while n < len(lines):
                depth += lines[n].count("{") - lines[n].count("}")
                if depth == 0 or (depth < 0 and "{" in lines[start]):
                    break
                n += 1
            yield k, "\n".join(lines[start : n + 1]), start, min(n, len(lines)), found[1] or "unknown", "function"
            k += 1
        n += 1
    if not k:
        for a in range(0, len(lines), block):
            yield a // block, "\n".join(lines[a : a + block]), a, min(a + block, len(lines)), f"chunk_{a // block}", "block"


def helm(text: str) -> Iterator[Chunk]:
    """A row of the chart's name and version, and one of its values, nested ones by dotted names."""
    found = dict(re.findall(r"(?m)^\s*(name|version|apiVersion):(.*)$", text))
    if found:
        meta = f"Chart: {found.get('name', 'unknown').strip()}\nVersion: {found.get('version', 'unknown').strip()}"
        yield 0, meta, 0, 0, found.get("name", "unknown").strip(), "chart_metadata"
    values, parent = [], None
    for line in text.split("\n"):
        if m := re.match(r"(\s*)([\w.-]+):\s*(.*)$", line):
            if not m[1]:
                parent = m[2]
                if m[3]:
                    values.append(f"{m[2]}: {m[3]}")
            elif parent and m[3]:
                values.append(f"{parent}.{m[2]}: {m[3]}")
    if values:
        yield 1, "\n".join(values), 0, 0, None, "values"


#: Sentences that are embedded at a time.
STRETCH = 1024
#: A sentence with its terminator and the space after it; sentences of a text make up the text.
SENTENCE = r"(?s).+?(?:[.!?]+\s+|\z)"
_whole_sentence = re.compile(r"(?s).+?(?:[.!?]+\s+|\Z)").findall


def sentence(text: str, size: int = 1024, overlap: int = 200) -> Iterator[Chunk]:
    """Whole sentences up to ``size`` characters, the last ones of a chunk (up to ``overlap``) again in the next; a longer sentence is cut."""
    parts: list[tuple[int, str]] = []
    at = 0
    for s in _whole_sentence(text):
        parts += [(at + a, s[a : a + size]) for a in range(0, len(s), size)]
        at += len(s)
    first = k = 0
    while first < len(parts):
        last, n = first, 0
        while last < len(parts) and (last == first or n + len(parts[last][1]) <= size):
            n += len(parts[last][1])
            last += 1
        piece, start = "".join(s for _, s in parts[first:last]), parts[first][0]
        if piece.strip():
            yield k, piece.strip(), start, start + len(piece), None, None
            k += 1
        if last == len(parts):
            return
        back, kept = last, 0
        while back - 1 > first and kept + len(parts[back - 1][1]) <= overlap:
            back -= 1
            kept += len(parts[back][1])
        room = kept + len(parts[last][1]) <= size
        first = back if room else last


class _Tags(HTMLParser):
    """Collects, in document order, the text right under each of the wanted tags."""

    def __init__(self, tags: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.tags, self.open, self.parts, self.hidden = tags, [], [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in self.tags:
            if tag == "p" and self.open and self.open[-1][0] == "p":
                self.open.pop()  # a paragraph ends where the next begins
            part = (tag, [])
            self.open.append(part)
            self.parts.append(part)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.open and not self.hidden:
            self.open[-1][1].append(data)


def html(text: str, tags: tuple[str, ...] = ("p", "div", "section", "article")) -> Iterator[Chunk]:
    """The text under each of the tags, what stands in an inner one belongs to that; neighbours under one kind of tag are one chunk."""
    parser = _Tags(tags)
    parser.feed(text)
    parser.close()
    held: list[tuple[str, list[str]]] = []
    for tag, parts in parser.parts:
        if words := " ".join("".join(parts).split()):
            if held and held[-1][0] == tag:
                held[-1][1].append(words)
            else:
                held.append((tag, [words]))
    for k, (tag, parts) in enumerate(held):
        piece = "\n".join(parts)
        yield k, piece, 0, len(piece), tag, None


def json_parts(text: str, depth: int = 2) -> Iterator[Chunk]:
    """A chunk for each value ``depth`` names deep, or less deep where nothing is inside; ``path`` has the names. Texts that are no JSON have none."""
    try:
        stack = [((), json.loads(text))]
    except ValueError:
        return
    k = 0
    while stack:
        path, value = stack.pop()
        inner = list(value.items()) if isinstance(value, dict) else list(enumerate(value)) if isinstance(value, list) else []
        if inner and len(path) < depth:
            stack += [((*path, str(name)), v) for name, v in reversed(inner)]
            continue
        piece = " ".join([*path, json.dumps(value, ensure_ascii=False) if isinstance(value, (dict, list)) or value is None or isinstance(value, bool) else str(value)])
        yield k, piece, 0, len(piece), path[-1] if path else None, ".".join(path)
        k += 1


def distances_of(texts: Iterable[list[str] | None], buffer: int = 1, model: Model | None = None) -> list[list[float]]:
    """1 - cosine of each sentence of a text and the next, each with ``buffer`` sentences on both sides."""
    model = model or Hashing()

    def far(v: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Distances of the windows around each sentence and the next; first and last: of the text that it stands in."""
        at, near = np.arange(len(v)), v.copy()
        for k in range(1, min(buffer, len(v) - 1) + 1):  # neighbours at k, and away with those of other texts
            near[k:] += v[:-k]
            near[:-k] += v[k:]
            low, high = at[k:][at[k:] - k < first[k:]], at[:-k][at[:-k] + k >= last[:-k]]
            near[low] -= v[low - k]
            near[high] -= v[high + k]
        near = near.astype(np.float64)
        square = np.sqrt(np.einsum("ij,ij->i", near, near))
        length, dot = square[:-1] * square[1:], np.einsum("ij,ij->i", near[:-1], near[1:])
        return np.where(length > 0, 1 - dot / np.where(length > 0, length, 1), 1.0)

    def long(parts: list[str]) -> list[float]:
        out: list[float] = []
        for a in range(0, len(parts) - 1, STRETCH):  # pairs from (a, a + 1) on
            b = min(a + STRETCH, len(parts) - 1)
            low, high = max(0, a - buffer), min(len(parts), b + buffer + 1)
            out += far(model(parts[low:high]), np.zeros(high - low, int), np.full(high - low, high - low))[a - low : b - low].tolist()
        return out

    def short(texts: list[list[str]]) -> list[list[float]]:
        """Many texts at once."""
        size = np.array([len(t) for t in texts])
        ends = np.cumsum(size)
        if not len(ends) or not ends[-1]:
            return [[] for _ in texts]
        found = far(model([p for t in texts for p in t]), np.repeat(ends - size, size), np.repeat(ends, size)).tolist()
        return [found[e - n : e - 1] if n > 1 else [] for e, n in zip(ends.tolist(), size.tolist())]

    out, held, total = [], [], 0
    for parts in texts:
        parts = [] if parts is None else list(parts)
        if len(parts) > STRETCH or total + len(parts) > STRETCH:
            out += short(held)
            held, total = [], 0
        if len(parts) > STRETCH:
            out.append(long(parts))
        else:
            held.append(parts)
            total += len(parts)
    return [*out, *short(held)]


def adjacent_distances(sentences: Column, buffer: int = 1, make: Callable[[], Model] = Hashing) -> Column:
    """1 - cosine of each sentence and the next, each with ``buffer`` sentences on both sides; 1 if a vector has no length.

    Sentences are embedded about a thousand at a time, of many texts or of a part of a long
    one, and summed in a sliding window, so memory does not grow with the text; the model's
    vectors must add up as counts do.
    """

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            yield pd.Series(distances_of(texts, buffer, model), dtype=object)

    return run(sentences)


def percentile(values: Column, share: float) -> Column:
    """The percentile of an array by linear interpolation; null for an empty one."""
    ordered = F.array_sort(values)
    at = (F.size(values) - 1) * F.lit(share)
    low = F.floor(at).cast("int")
    a, b = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(values) - 1))
    return a + (b - a) * (at - low)


def cuts(sentences: Column, share: float = 0.95, buffer: int = 1, make: Callable[[], Model] = Hashing) -> Column:
    """How many sentences of a text stand before each cut: where ``adjacent_distances`` is over its own ``percentile``.

    Both are taken where the vectors are made, so that of the distances only the cuts go back.
    """

    def over(far: list[float]) -> np.ndarray:
        if not far:
            return np.zeros(0, np.int32)
        values, at = np.array(far), (len(far) - 1) * share
        ordered, low = np.sort(values), int(at // 1)
        a, b = ordered[low], ordered[min(low + 1, len(far) - 1)]
        return np.flatnonzero(values > a + (b - a) * (at - low)).astype(np.int32) + 1

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            yield pd.Series([over(far) for far in distances_of(texts, buffer, model)], dtype=object)

    return run(sentences)


def semantic(rows: DataFrame, share: float = 0.95, buffer: int = 1, key: str = "id", text: str = "content", make: Callable[[], Model] = Hashing) -> DataFrame:
    """(key, chunk_index, n_sentences, content): texts cut where neighbouring sentences are farther apart than the ``share`` percentile of the text's own distances.

    Chunks of a text make up the text, spaces included. A text of one sentence is one chunk,
    a null, empty or blank one has none; distances that tie with the percentile do not cut.
    Narrow: texts do not leave their partitions.
    """
    given = F.coalesce(F.col(text), F.lit(""))
    parts = F.when(F.rlike(given, F.lit(r"\S")), F.regexp_extract_all(given, F.lit(SENTENCE), F.lit(0))).otherwise(F.array().cast("array<string>"))
    d = rows.select(F.col(key), parts.alias("_s")).withColumn("_c", cuts(F.col("_s"), share, buffer, make))
    n = F.size("_s")
    spans = F.arrays_zip(F.concat(F.array(F.lit(0)), "_c").alias("a"), F.concat("_c", F.array(n)).alias("b"))
    d = d.select(key, F.posexplode(F.when(n > 0, F.transform(spans, lambda x: F.slice("_s", x["a"] + 1, x["b"] - x["a"])))).alias("chunk_index", "_p"))
    return d.select(key, "chunk_index", F.size("_p").alias("n_sentences"), F.array_join("_p", "").alias("content"))


CHUNKERS: dict[str, Callable[[str], Iterator[Chunk]]] = {"document": document, "markdown": markdown, "structural": structural, "hierarchical": hierarchical, "python": python_code, "code": braced_code, "helm": helm, "sentence": sentence, "html": html, "json": json_parts}


def chunks(rows: DataFrame, kind: str = "document", key: str = "id", text: str = "content") -> DataFrame:
    """Chunk rows of every text; a null text has none. Narrow: texts do not leave their partitions."""
    if kind not in CHUNKERS:
        raise ValueError(f"kind must be one of {', '.join(CHUNKERS)}")
    cut = CHUNKERS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 500):
                out = []
                for source, content in zip(*(c.to_pylist() for c in whole.slice(a, 500).columns)):
                    for k, piece, start, end, heading, path in cut(content) if content is not None else ():
                        out.append((source, k, hashlib.sha256(f"{source}:{k}".encode()).hexdigest()[:16], piece, start, end, heading, path))
                types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 8, types)], names=NAMES)

    return rows.select(F.col(key).cast("string"), F.col(text)).mapInArrow(run, SCHEMA)


def yaml_documents(text: Column) -> Column:
    """Parts of a YAML text between lines of three dashes, blank ones left out."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?m)^[ \t]*---[ \t]*$\n?"), lambda d: F.rlike(d, F.lit(r"\S")))


def kubernetes(rows: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """(key, chunk_index, kind, name, namespace, content) of each YAML document."""
    d = rows.select(F.col(key), F.posexplode(yaml_documents(F.col(text))).alias("chunk_index", "content"))
    meta = F.regexp_extract("content", r"(?m)^metadata:[^\n]*\n((?:[ \t]+[^\n]*\n?)*)", 1)
    of = lambda c, p, default: F.coalesce(F.nullif(F.trim(F.regexp_extract(c, p, 1), F.lit(" \"'")), F.lit("")), F.lit(default))
    return d.select(key, "chunk_index", of(F.col("content"), r"(?m)^kind:\s*(\S+)", "Unknown").alias("kind"), of(meta, r"(?m)^\s{1,4}name:\s*(\S+)", "unknown").alias("name"), of(meta, r"(?m)^\s{1,4}namespace:\s*(\S+)", "default").alias("namespace"), "content")


ISTIO_KINDS = ["VirtualService", "DestinationRule", "Gateway", "ServiceEntry", "Sidecar", "EnvoyFilter", "AuthorizationPolicy", "PeerAuthentication"]


def istio(rows: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """Kubernetes chunks of Istio kinds with their first host and gateway."""
    first = lambda name: F.regexp_extract("content", rf"(?m)^\s*{name}:\s*\n\s*-\s*[\"']?([^\s\"']+)", 1)
    return kubernetes(rows, key, text).where(F.col("kind").isin(ISTIO_KINDS)).withColumns({"host": first("hosts"), "gateway": first("gateways")})


def dockerfile(rows: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """(key, instruction, count, first_line, arguments in order): instructions grouped; continuation lines stand alone."""
    lines = rows.select(F.col(key), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line", "l")).withColumn("l", F.regexp_replace("l", r"^\s+|\s+$", ""))
    found = lines.where(F.rlike("l", F.lit(r"^\w+\s+.+$")) & ~F.startswith("l", F.lit("#")))
    parts = found.select(key, "line", F.upper(F.regexp_extract("l", r"^(\w+)\s+(.+)$", 1)).alias("instruction"), F.regexp_extract("l", r"^(\w+)\s+(.+)$", 2).alias("argument"))
    g = parts.groupBy(key, "instruction").agg(F.count("*").alias("count"), F.min("line").alias("first_line"), F.array_sort(F.collect_list(F.struct("line", "argument"))).alias("a"))
    return g.select(key, "instruction", "count", "first_line", F.transform("a", lambda x: x["argument"]).alias("arguments"))


def graphql(rows: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """(key, kind, name, content) of types, operations and the schema."""
    t = F.coalesce(F.col(text), F.lit(""))
    typed, op, schema = r"(?:type|interface|input|enum)\s+(\w+)\s*\{([^}]+)\}", r"(?:query|mutation|subscription)\s*(?:\w+)?\s*(?:\([^)]*\))?\s*\{([^}]+)\}", r"schema\s*\{([^}]+)\}"
    every = lambda p, g: F.regexp_extract_all(t, F.lit(p), F.lit(g))
    made = lambda kind, name, p: F.transform(every(p, 0), lambda c: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), c.alias("content")))
    types = F.transform(F.arrays_zip(every(typed, 1).alias("n"), every(typed, 0).alias("c")), lambda x: F.struct(F.lit("type").alias("kind"), x["n"].alias("name"), x["c"].alias("content")))
    return rows.select(F.col(key), F.explode(F.concat(types, made("operation", "anonymous", op), made("schema", "schema", schema))).alias("d")).select(key, "d.*")
