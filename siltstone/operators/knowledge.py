"""Curated knowledge: what a question is about, matching patterns, and lookups of platforms and decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from siltstone.operators.planner import PLATFORMS, holds, named
from siltstone.operators.rules import holds as holds_condition

#: Words that tell what a question wants, in order of precedence (fixed values).
INTENT_WORDS = {
    "design": ["create", "build", "design", "new", "implement"],
    "troubleshoot": ["fix", "error", "broken", "issue", "problem"],
    "migrate": ["migrate", "move", "convert", "upgrade"],
    "optimize": ["optimize", "improve", "performance", "faster"],
    "explain": ["explain", "understand", "how does", "what is"],
}
OTHER_INTENT = "analyze"
#: Platforms and technologies that a question can name (fixed values).
PLATFORM_WORDS = {
    "sap": ["xsuaa", "hana", "btp", "cap", "cloudfoundry", "kyma"],
    "tanzu": ["tanzu", "pivotal", "spring", "kubernetes", "knative"],
    "powerplatform": ["powerapps", "powerautomate", "dataverse", "copilot"],
}
TECHNOLOGIES = ["rest", "graphql", "api", "database", "auth", "oauth", "jwt"]
#: Tenths that a named platform and a technology of the pattern add to a score (fixed values).
PLATFORM_TENTHS, TECHNOLOGY_TENTHS = 3, 2
#: Words that ask for a kind of knowledge (fixed values).
ASKS_FOR = {
    "use_case": ["use case", "scenario", "integration", "automation"],
    "adr": ["decision", "adr"],
    "reference_architecture": ["reference", "architecture", "pattern", "serverless", "microservices"],
}


def resolve(rows: DataFrame, query: str = "query") -> DataFrame:
    """Adds ``intent``, the ``platforms`` and ``technologies`` named, and ``platform``, the first of them or null."""
    q = F.col(query)
    intent = F.lit(OTHER_INTENT)
    for name in reversed(INTENT_WORDS):
        intent = F.when(holds(q, INTENT_WORDS[name]), name).otherwise(intent)
    platforms = named(q, PLATFORM_WORDS)
    return rows.withColumns({"intent": intent, "platforms": platforms, "technologies": named(q, {t: [t] for t in TECHNOLOGIES}), "platform": F.get(platforms, F.lit(0))})


def match_patterns(resolved: DataFrame, patterns: dict[str, list[str]], most: int = 5) -> DataFrame:
    """Adds ``matches``: the ``most`` best of a library of patterns (name: what it touches), ties in its order.

    The library is a fixed list, so scores are one array expression and no join.
    """
    named_platforms = PLATFORM_TENTHS * F.size("platforms")
    scored = []
    for k, (name, touches) in enumerate(patterns.items()):
        shared = F.size(F.array_intersect("technologies", F.array(*map(F.lit, touches)).cast("array<string>")))
        tenths = F.least(F.lit(10), named_platforms + TECHNOLOGY_TENTHS * shared)
        scored.append(F.struct((-tenths).alias("rank"), F.lit(k).alias("ord"), F.lit(name).alias("pattern"), (tenths / 10.0).alias("score")))
    best = F.slice(F.array_sort(F.filter(F.array(*scored), lambda m: m["rank"] < 0)), 1, most)
    return resolved.withColumn("matches", F.transform(best, lambda m: F.struct(m["pattern"].alias("pattern"), m["score"].alias("score"))))


def verdicts(matched: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``violations`` (rule ids in order), ``errors``, ``can_proceed`` and ``reasoning`` to ``match_patterns``.

    rules: (rule, platform, severity, feature, operator, expected), a row a condition; a rule
    holds if all its conditions do. Features of a question are ``platform``, ``technology``
    ("true" if one is named), ``technologies`` and ``intent``. Rules of other platforms than
    the question's are left out, so a question without a platform violates none. Rules are a
    small curated table; questions meet those of their platform, and equal questions with null
    or repeated ids are judged together by all that they show.
    """
    rows = matched.withColumn("_id", F.xxhash64(F.col("platform"), F.col("intent"), F.col("technologies")))
    shown = F.create_map(F.lit("platform"), F.col("platform"), F.lit("technology"), (F.size("technologies") > 0).cast("string"), F.lit("technologies"), F.array_join("technologies", ","), F.lit("intent"), F.col("intent"))
    kinds = rows.where("platform is not null").select("_id", "platform", F.explode(shown).alias("feature", "value")).distinct()
    needed = rules.groupBy("rule", "platform", "severity").agg(F.count("*").alias("n"))
    met = kinds.join(rules, ["platform", "feature"]).where(holds_condition(F.col("operator"), F.col("value"), F.col("expected")))
    found = met.groupBy("_id", "rule", "platform", "severity").agg(F.count("*").alias("m")).join(needed, ["rule", "platform", "severity"]).where("m = n")
    told = found.groupBy("_id").agg(F.array_sort(F.collect_list("rule")).alias("violations"), F.count_if(F.col("severity") == "error").alias("errors"))
    out = rows.join(told, "_id", "left").drop("_id").withColumns({"violations": F.coalesce("violations", F.array().cast("array<string>")), "errors": F.coalesce("errors", F.lit(0))})
    best = F.get("matches", F.lit(0))
    parts = F.array_compact(F.array(F.concat(F.lit("Intent: "), F.col("intent")), F.when(F.size("matches") > 0, F.concat(F.lit("Recommended: "), best["pattern"], F.lit(" ("), F.round(best["score"] * 100).cast("int").cast("string"), F.lit("%)"))), F.when(F.col("errors") > 0, F.concat(F.lit("Blocking: "), F.col("errors").cast("string"), F.lit(" issues")))))
    return out.withColumns({"can_proceed": F.col("errors") == 0, "reasoning": F.array_join(parts, " | ")})


def scan(query: str, nodes: DataFrame, kinds: dict[str, DataFrame], limit: int = 10) -> DataFrame:
    """(branch, type, id, name): platforms named in the query with their services, then use cases, decisions and references if it asks for them.

    nodes: type, id, name, platform, seq; kinds: a name of ``ASKS_FOR`` to rows of id, name, seq.
    """
    q = query.lower()
    parts = []
    for platform, words in PLATFORMS.items():
        if any(w in q for w in words):
            own = nodes.where(((F.col("type") == "platform") & (F.col("id") == platform)) | ((F.col("type") == "service") & (F.col("platform") == platform)))
            parts.append(own.select("type", "id", "name", (F.col("type") == "service").cast("int").alias("part"), "seq").orderBy("part", "seq").limit(limit))
    for kind, words in ASKS_FOR.items():
        if kind in kinds and any(w in q for w in words):
            parts.append(kinds[kind].select(F.lit(kind).alias("type"), "id", "name", F.lit(0).alias("part"), "seq").orderBy("seq").limit(limit))
    if not parts:
        parts = [nodes.select("type", "id", "name", F.lit(0).alias("part"), "seq").limit(0)]
    rows = reduce(DataFrame.unionByName, (p.withColumn("branch", F.lit(b)) for b, p in enumerate(parts)))
    return rows.orderBy("branch", "part", "seq").limit(limit).select("branch", "type", "id", "name")


def lookup(rows: DataFrame, platform: str | None = None, platforms: str = "platforms", **equal: object) -> DataFrame:
    """Entries for a platform, and with the values given in other columns."""
    out = rows if platform is None else rows.where(F.array_contains(platforms, platform))
    for name, value in equal.items():
        out = out if value is None else out.where(F.col(name) == value)
    return out
