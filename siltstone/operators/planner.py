"""Plans of questions: intent, sources, tools and platforms by keywords, and scores of designs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siltstone.operators.classify import any_word, classify

#: Words that name an intent, and what the classifier's intents mean for a plan (fixed values).
INTENT_WORDS = {
    "design": ["design", "create", "build", "architect", "propose"],
    "troubleshoot": ["debug", "troubleshoot", "diagnose", "root cause"],
    "optimize": ["improve", "optimize", "performance", "faster", "better", "scale"],
}
SKETCH_WORDS = ["ui", "sketch", "wireframe", "implement ui", "screen layout", "mockup"]
CLASSIFIED_AS = {"causal": "troubleshoot", "complex": "design"}
#: Words that choose sources and tools (fixed values).
SOURCE_WORDS = {
    "docs": ["doc", "document", "readme", "guide", "how to"],
    "code": ["code", "function", "class", "implement", "api"],
    "graph": ["architecture", "component", "service", "deploy"],
    "tickets": ["issue", "bug", "ticket", "problem"],
    "telemetry": ["metric", "log", "performance", "monitor"],
    "ui_sketch": ["ui", "sketch", "wireframe", "screen", "layout", "mockup"],
}
ALL_SOURCES = ["docs", "code", "graph", "tickets", "telemetry", "diagram", "ui_sketch"]
TOOL_WORDS = {
    "architecture_evaluate": ["evaluate", "assess", "review"],
    "security_validate": ["security", "vulnerability", "secure"],
    "cost_estimate": ["cost", "estimate", "price"],
}
#: Platforms and the words that tell them (fixed values).
PLATFORMS = {
    "aws": ["aws", "lambda", "s3", "dynamodb", "ec2", "ecs", "eks", "iam"],
    "azure": ["azure", "function", "cosmos", "aks", "app service"],
    "gcp": ["gcp", "cloud", "gke", "firestore", "cloudfunctions"],
    "sap": ["sap", "btp", "hana", "xsuaa", "kyma", "cap"],
    "tanzu": ["tanzu", "vmware", "kubernetes", "spring", "pivotal"],
    "powerplatform": ["powerapps", "powerautomate", "dataverse", "power platform"],
}
#: Scores of design patterns, in order of precedence (fixed values).
CRITERIA = ["correctness", "consistency", "best_practices"]
PATTERN_SCORES = {
    "microservices": [0.85, 0.9, 0.88],
    "serverless": [0.9, 0.85, 0.92],
    "monolith": [0.95, 0.95, 0.7],
    "event-driven": [0.82, 0.88, 0.85],
    "cqrs": [0.88, 0.82, 0.9],
}
OTHER_SCORE = 0.8
#: What a low score says (fixed values).
ISSUES = ["Architecture may not follow current best practices", "Architecture consistency could be improved", "Overall architecture score below threshold"]
#: Words of error messages, and commands that write (fixed values).
ERROR_WORDS = ["error", "exception", "fail", "critical"]
WRITES = ["DELETE", "DROP", "ALTER", "CREATE", "SET", "REMOVE"]


def holds(text: Column, words: list[str]) -> Column:
    """Whether any of the words stands in the text, also inside other words."""
    return any_word(F.coalesce(text, F.lit("")), words)


def named(text: Column, words: dict[str, list[str]]) -> Column:
    """The names whose words stand in the text, in order."""
    return F.array_compact(F.array(*(F.when(holds(text, w), F.lit(name)) for name, w in words.items())))


def plans(rows: DataFrame, query: str = "query") -> DataFrame:
    """Adds ``intent``, ``plan_sources``, ``tools`` and ``platforms`` to questions; all sources if none is named."""
    q = F.col(query)
    known = classify(rows, query)
    intent = F.lit("explain")
    for name, plan in CLASSIFIED_AS.items():
        intent = F.when(F.col("primary_intent") == name, plan).otherwise(intent)
    intent = F.when(holds(q, SKETCH_WORDS), "design").otherwise(intent)
    for name in reversed(INTENT_WORDS):
        intent = F.when(holds(q, INTENT_WORDS[name]), name).otherwise(intent)
    sources = named(q, SOURCE_WORDS)
    sources = F.when(F.size(sources) > 0, sources).otherwise(F.array(*map(F.lit, ALL_SOURCES)))
    return known.select(*rows.columns, intent.alias("intent"), sources.alias("plan_sources"), named(q, TOOL_WORDS).alias("tools"), named(q, PLATFORMS).alias("platforms"))


STEP = "struct<step_type: string, action: string, source: string, limit: int, tools: array<string>>"


def step(kind: str, action: str, source: Column | str | None = None, limit: int | None = None, tools: Column | None = None) -> Column:
    of = F.lit(source) if source is None or isinstance(source, str) else source
    return F.struct(F.lit(kind).alias("step_type"), F.lit(action).alias("action"), of.cast("string").alias("source"), F.lit(limit).cast("int").alias("limit"), (F.array().cast("array<string>") if tools is None else tools).alias("tools"))


def steps(planned: DataFrame) -> DataFrame:
    """Adds ``steps`` to ``plans``: what is done for the question, in order.

    A design is analysed, looked up in documents and code, and drawn up; trouble is looked up
    in tickets and telemetry, and diagnosed; other questions are searched in each of their
    sources. Tools come after that, and an answer at the end.
    """
    design = F.array(step("analyze", "analyze_ir", "ir"), step("retrieve", "search", "docs"), step("retrieve", "search", "code"), step("reason", "generate_architecture"))
    trouble = F.array(step("retrieve", "search", "tickets"), step("retrieve", "search", "telemetry"), step("analyze", "analyze_logs"), step("reason", "diagnose"))
    others = F.transform(F.array_distinct("plan_sources"), lambda s: step("retrieve", "search", s, 10))
    first = F.when(F.col("intent") == "design", design).when(F.col("intent") == "troubleshoot", trouble).otherwise(others)
    used = F.when(F.size("tools") > 0, F.array(step("tool", "execute_tools", tools=F.col("tools")))).otherwise(F.array().cast(f"array<{STEP}>"))
    return planned.withColumn("steps", F.concat(first, used, F.array(step("reason", "generate_answer"))))


#: What a source is asked besides the question itself (fixed forms).
ALSO_ASKED = {"docs": "SAP BTP {}", "code": "{} implementation", "tickets": "{} known issues", "telemetry": "{} logs metrics"}


def source_queries(planned: DataFrame, query: str = "query") -> DataFrame:
    """One row for each text that a source of ``plans`` is asked: adds ``source``, ``k`` (0 is the question itself) and ``asked``."""
    pairs = F.array(*(F.struct(F.lit(s).alias("source"), F.lit(form).alias("form")) for s, form in ALSO_ASKED.items()))
    both = planned.withColumn("_p", F.explode(pairs)).where(F.array_contains("plan_sources", F.col("_p.source")))
    q = F.coalesce(F.col(query), F.lit(""))
    asked = F.array(q, F.replace(F.col("_p.form"), F.lit("{}"), q))
    return both.select(*planned.columns, F.col("_p.source").alias("source"), F.posexplode(asked).alias("k", "asked"))


def design_scores(designs: DataFrame, name: str = "id") -> DataFrame:
    """Adds the score of each criterion by the first pattern in the design's name, their mean and the issues."""
    n = F.lower(F.coalesce(F.col(name).cast("string"), F.lit("")))
    of = {}
    for k, c in enumerate(CRITERIA):
        score = F.lit(OTHER_SCORE)
        for p in reversed(PATTERN_SCORES):
            score = F.when(F.contains(n, F.lit(p)), PATTERN_SCORES[p][k]).otherwise(score)
        of[c] = score
    out = designs.withColumns(of)
    mean = (F.col(CRITERIA[0]) + F.col(CRITERIA[1]) + F.col(CRITERIA[2])) / 3
    checks = [(F.col("best_practices") < 0.85, ISSUES[0]), (F.col("consistency") < 0.85, ISSUES[1]), (mean < 0.75, ISSUES[2])]
    return out.withColumns({"mean": mean, "issues": F.array_compact(F.array(*(F.when(c, F.lit(t)) for c, t in checks)))})


def completeness(components: Column, relationships: Column, flows: Column) -> Column:
    """How complete a design is, by which of its arrays hold anything."""
    any_of = lambda c, share: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, share).otherwise(0)
    return (any_of(components, 4) + any_of(relationships, 3) + any_of(flows, 3)) / 10


def error_patterns(rows: DataFrame, content: str = "content", order: str = "seq", n: int = 10) -> DataFrame:
    """The beginnings of the first ``n`` contents that tell of an error."""
    found = rows.where(holds(F.col(content), ERROR_WORDS))
    return found.orderBy(order).limit(n).select(order, F.substring(content, 1, 200).alias("pattern"))


def writes(command: Column) -> Column:
    """Whether a command would write, by its words."""
    return holds(command, [w.lower() for w in WRITES])


def evidence(elements: DataFrame, key: str, confidence: str, least: float = 0.6) -> DataFrame:
    """Mean confidence of each key's elements, with a warning if it is low."""
    mean = F.avg(F.coalesce(F.col(confidence), F.lit(0.0)))
    return elements.groupBy(key).agg(F.count("*").alias("elements"), mean.alias("confidence")).withColumn("low", F.col("confidence") < least)
