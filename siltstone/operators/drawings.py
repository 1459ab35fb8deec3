"""Entities and relations of drawings that are written as text, by kind of diagram.

Every kind has rules for a line: what it names and what it relates. Classes have bodies with
attributes and methods. All of it is column expressions over the lines of a text; rows keep
their place in ``ord``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

#: How sure an extraction is, by kind, if anything was found (fixed values); else ``UNSURE``.
CONFIDENCE = {"class": 0.8, "sequence": 0.7, "c4": 0.75, "component": 0.7, "deployment": 0.6, "activity": 0.6, "state": 0.6, "package": 0.6, "object": 0.6, "use_case": 0.6, "erd": 0.7}
UNSURE = 0.3
#: Signs of visibility; others are protected. Arrows between classes and what they mean (fixed values).
VISIBLE = ["+", "-", "#"]
ARROWS = {"--": "dependency", "->": "dependency", "<-": "dependency", "<--": "dependency", ">|": "composition", "<|": "aggregation", "<|>": "association"}
ENTITY = "struct<type: string, name: string, detail: string>"
RELATION = "struct<a: string, b: string, type: string, label: string>"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def before(c: Column, mark: str) -> Column:
    return strip(F.substring_index(c, mark, 1))


def between(c: Column, a: str, b: str) -> Column:
    """What stands behind the first ``a``, up to the next ``a`` or ``b``."""
    return strip(F.substring_index(F.get(F.split(c, f"\\Q{a}\\E"), F.lit(1)), b, 1))


def has(c: Column, *marks: str) -> Column:
    """Whether one of the marks stands in it."""
    found = [F.contains(c, F.lit(m)) for m in marks]
    out = found[0]
    for f in found[1:]:
        out = out | f
    return out


def entity(when: Column, kind: Column | str, name: Column, detail: Column | str = "") -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(when & (name != ""), F.struct(as_column(kind).alias("type"), name.alias("name"), as_column(detail).alias("detail"))).otherwise(F.lit(None).cast(ENTITY))


def relation(when: Column, a: Column, b: Column, kind: str, label: Column | str = "") -> Column:
    return F.when(when, F.struct(a.alias("a"), b.alias("b"), F.lit(kind).alias("type"), (F.lit(label) if isinstance(label, str) else label).alias("label"))).otherwise(F.lit(None).cast(RELATION))


def ends(line: Column) -> tuple[Column, Column, Column]:
    """(whether there are two, first, last) of what lines of two dashes or more part; an arrow's head is dropped."""
    parts = F.split(line, r"-{2,}")
    return F.size(parts) >= 2, strip(F.get(parts, F.lit(0))), strip(F.regexp_replace(F.element_at(parts, -1), r"^\s*>", ""))


def _component(line: Column) -> tuple[Column, Column | None]:
    return entity(has(line, "<<") & has(line, ">>"), "component", before(F.get(F.split(line, ">>"), F.lit(1)), "{")), None


def _deployment(line: Column) -> tuple[Column, Column | None]:
    return entity(F.contains(F.lower(line), F.lit("node")), "node", before(line, "[")), None


def _c4(line: Column) -> tuple[Column, Column | None]:
    tech = F.when(has(line, "("), between(line, "(", ")")).otherwise("")
    return entity(has(line, "[") & has(line, "]"), "container", between(line, "[", "]"), tech), None


def _activity(line: Column) -> tuple[Column, Column | None]:
    parts = F.split(line, "->")
    flow = relation(F.size(parts) == 2, strip(F.get(parts, F.lit(0))), strip(F.get(parts, F.lit(1))), "flow")
    return entity(~has(line, "->") & F.rlike(line, F.lit(r"^\p{Lu}")), "action", F.regexp_replace(line, r"\s*\([^)]*\)", "")), flow


def _state(line: Column) -> tuple[Column, Column | None]:
    two, a, b = ends(line)
    label = F.when(has(line, "["), F.substring_index(F.get(F.split(line, r"\["), F.lit(1)), "]", 1)).otherwise("")
    return entity(~has(line, "->") & F.rlike(line, F.lit(r"^\p{Lu}")), "state", line), relation(has(line, "->") & two, a, b, "transition", label)


def _package(line: Column) -> tuple[Column, Column | None]:
    low, parts = F.lower(line), F.split(line, "::")
    named = has(low, "package", "folder")
    name = strip(F.replace(F.replace(line, F.lit("package"), F.lit("")), F.lit("Folder"), F.lit("")))
    return entity(named, "package", name), relation(~named & (F.size(parts) == 2), strip(F.get(parts, F.lit(0))), strip(F.get(parts, F.lit(1))), "import")


def _object(line: Column) -> tuple[Column, Column | None]:
    two, a, b = ends(line)
    named = has(line, ":") & ~has(line, "->")
    return entity(named, strip(F.substring_index(line, ":", -1)), before(line, ":"), "instance"), relation(~named & two, a, b, "link")


def _use_case(line: Column) -> tuple[Column, Column | None]:
    low = F.lower(line)
    actor = has(low, "actor") | (~has(line, "->") & has(line, ":") & ~has(low, "use"))
    case = ~actor & has(low, "use case", "ellipse")
    name = strip(F.replace(F.replace(line, F.lit("use case"), F.lit("")), F.lit("ellipse"), F.lit("")))
    sides, included = F.split(line, "[<>]"), F.split(line, "include")
    extends = ~actor & ~case & has(line, "<") & has(line, ">")
    rel = F.coalesce(
        relation(extends & (F.size(sides) >= 3), strip(F.get(sides, F.lit(0))), strip(F.get(sides, F.lit(2))), "extends"),
        relation(~actor & ~case & ~extends & (F.size(included) == 2), strip(F.get(included, F.lit(0))), strip(F.get(included, F.lit(1))), "include"),
    )
    return F.coalesce(entity(actor, "actor", before(line, ":")), entity(case, "use_case", name)), rel


def _erd(line: Column) -> tuple[Column, Column | None]:
    two, a, b = ends(line)
    many = F.when(F.rlike(line, F.lit(r"[NM*]")), "1:N").otherwise("1:1")
    return F.lit(None).cast(ENTITY), relation(two, a, b, "foreign_key", many)


def _sequence(line: Column) -> tuple[Column, Column | None]:
    return entity(has(line, ":") & ~has(line, "->"), "object", before(line, ":")), None


LINES: dict[str, Callable[[Column], tuple[Column, Column | None]]] = {"component": _component, "deployment": _deployment, "c4": _c4, "activity": _activity, "state": _state, "package": _package, "object": _object, "use_case": _use_case, "erd": _erd, "sequence": _sequence}
#: Kinds whose entities are named once, by their first line.
ONCE = ("sequence", "use_case", "erd")


def _known(kind: str) -> None:
    if kind not in CONFIDENCE:
        raise ValueError(f"kind must be one of {', '.join(CONFIDENCE)}")


def _lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    return rows.select(F.col(key), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("ord", "line")).withColumn("line", strip(F.col("line")))


def _groups(text: Column, pattern: str, n: int) -> Column:
    """Structs g1 to gn of all matches in a text."""
    return F.arrays_zip(*(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(k)).alias(f"g{k}") for k in range(1, n + 1)))


def entities(rows: DataFrame, kind: str, key: str = "id", text: str = "content") -> DataFrame:
    """(key, ord, type, name, detail) of what a drawing of that kind names; a null text names nothing, repeated rows name it again but for kinds that name once."""
    _known(kind)
    if kind == "class":
        found = rows.select(F.col(key), F.posexplode(_groups(F.col(text), r"(\w+)\s*\{([^}]+)\}", 2)).alias("ord", "m"))
        return found.select(key, "ord", F.lit("class").alias("type"), F.col("m.g1").alias("name"), F.lit("").alias("detail"))
    if kind == "erd":
        found = rows.select(F.col(key), F.posexplode(_groups(F.col(text), r"(\w+)\s*\(([^)]+)\)", 2)).alias("ord", "m"))
        out = found.select(key, "ord", strip(F.col("m.g2")).alias("type"), F.col("m.g1").alias("name"), F.concat_ws(",", F.when(F.contains(F.upper("m.g2"), F.lit("PK")), "primary"), F.when(F.contains(F.upper("m.g2"), F.lit("FK")), "foreign")).alias("detail"))
    else:
        out = _lines(rows, key, text).select(key, "ord", LINES[kind](F.col("line"))[0].alias("e")).where("e is not null").select(key, "ord", "e.type", "e.name", "e.detail")
    if kind in ONCE:
        first = Window.partitionBy(key, "name").orderBy("ord")
        out = out.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return out


def members(rows: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """(key, class, ord, member, name, visibility, type, params) of the lines of class bodies; those with a bracket are methods."""
    bodies = rows.select(F.col(key), F.explode(_groups(F.col(text), r"(\w+)\s*\{([^}]+)\}", 2)).alias("m"))
    lines = bodies.select(key, F.col("m.g1").alias("class"), F.posexplode(F.split("m.g2", "\n")).alias("ord", "line")).withColumn("line", strip(F.col("line"))).where("line <> ''")
    bare, first = F.regexp_replace("line", r"^[+\-#]\s*", ""), F.left("line", F.lit(1))
    method = F.contains("line", F.lit("("))
    name = F.when(method, before(bare, "(")).otherwise(before(bare, ":"))
    kind = F.when(F.contains("line", F.lit(":")), strip(F.substring_index("line", ":", -1))).otherwise(F.when(method, "void").otherwise("unknown"))
    return lines.select(key, "class", "ord", F.when(method, "method").otherwise("attribute").alias("member"), name.alias("name"), F.when(first.isin("+", "-"), first).otherwise("#").alias("visibility"), kind.alias("type"), F.when(method, F.substring_index(F.get(F.split(bare, r"\("), F.lit(1)), ")", 1)).alias("params"))


def relations(rows: DataFrame, kind: str, key: str = "id", text: str = "content") -> DataFrame:
    """(key, ord, a, b, type, label) of what a drawing of that kind relates.

    An arrow between classes must be there (two words beside each other are no relation), and
    arrow heads are no part of a name.
    """
    _known(kind)
    c = F.col(text)
    if kind == "class":
        arrow = "|".join(sorted((a.replace("|", "\\|") for a in ARROWS), key=len, reverse=True))
        found = rows.select(F.col(key), F.posexplode(_groups(c, rf"(\w+)\s*({arrow})\s*(\w+)", 3)).alias("ord", "m"))
        means = F.create_map(*(F.lit(x) for kv in ARROWS.items() for x in kv))
        return found.select(key, "ord", F.col("m.g1").alias("a"), F.col("m.g3").alias("b"), means[F.col("m.g2")].alias("type"), F.lit("").alias("label"))
    if kind == "sequence":
        found = rows.select(F.col(key), F.posexplode(_groups(c, r"(\w+)\s*(->>|-->|->)\s*(\w+):?\s*([^\n]+)", 4)).alias("ord", "m"))
        return found.select(key, "ord", F.col("m.g1").alias("a"), F.col("m.g3").alias("b"), F.when(F.col("m.g2") == "-->", "async").otherwise("sync").alias("type"), strip(F.col("m.g4")).alias("label"))
    if kind == "c4":
        both = F.concat(_groups(c, r"(\w+)\s*->\s*(\w+)", 2), _groups(c, r"(\w+)\s*--\s*(\w+)", 2))
        found = rows.select(F.col(key), F.posexplode(F.filter(both, lambda m: m["g1"] != m["g2"])).alias("ord", "m"))
        return found.select(key, "ord", F.col("m.g1").alias("a"), F.col("m.g2").alias("b"), F.lit("uses").alias("type"), F.lit("").alias("label"))
    rule = LINES[kind](F.col("line"))[1]
    if rule is None:
        rule = F.lit(None).cast(RELATION)
    return _lines(rows, key, text).select(key, "ord", rule.alias("r")).where("r is not null").select(key, "ord", "r.a", "r.b", "r.type", "r.label")


def confidence(rows: DataFrame, kind: str, key: str = "id", text: str = "content") -> DataFrame:
    """(key, confidence): the kind's constant where something was found: entities, for sequences messages, for use cases not only actors."""
    _known(kind)
    found = relations(rows, kind, key, text) if kind == "sequence" else entities(rows, kind, key, text)
    found = found.where("type = 'use_case'") if kind == "use_case" else found
    hit = found.select(key).distinct().withColumn("_hit", F.lit(True))
    return rows.select(key).join(hit, key, "left").select(key, F.when(F.col("_hit"), CONFIDENCE[kind]).otherwise(UNSURE).alias("confidence"))
