"""Classification of queries: intents, strategy, complexity, sources. One pass over a table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Patterns of each intent in order (fixed values).
INTENTS = {
    "fact": ["^what is", "^what does", "^what is the", "^define", "^how do i use", "^how to use", "^find the"],
    "relationship": ["who calls", "who uses", "who imports", "what calls", "what uses", "what imports", "depends on", "related to", "connected to", "relationship between", "trace"],
    "code_relationship": ["find callers", "find callees", "all callers", "all callees", "functions that call", "functions called by", "who implements", "overrides", "parent class", "class hierarchy", "imports from", "modules that import", "dead code", "unused function", "unused method", "never called", "complexity of", "cyclomatic", "most complex", "highest complexity", "module dependencies", "depends on module", "call chain", "execution trace", "go to definition", "find definition"],
    "causal": ["^why", "^how did", "reason for", "cause of", "leads to", "results in", "triggered by", "fails because", "error when"],
    "list": ["^list", "^show all", "^get all", "^find all", "^enumerate", "all functions", "all classes", "all endpoints", "all methods"],
    "code": [r"function\s+\w+", r"class\s+\w+", r"method\s+\w+", r"def\s+\w+", r"import\s+", r"from\s+\w+\s+import", r"api\s+endpoint", r"route\s+", r"controller\s+", r"\(\)\s*\{"],
    "documentation": ["documentation", "docs", "readme", "guide", "tutorial", "example", "how-to"],
    "tooling": ["kubernetes", "k8s", "deployment", "service", "configmap", "secret", "ingress", "helm", "chart", r"values\.yaml", "dockerfile", r"from\s+\w+", r"docker\s+build", "graphql", "schema", "query", "mutation", r"type\s+\w+", "istio", "virtualservice", "destinationrule", "gateway"],
}
#: Words that raise the complexity of a query (fixed values).
COMPARISON, NEGATION, AGGREGATION = ["vs", "versus", "compared", "difference"], ["not", "without", "except"], ["all", "every", "total", "sum"]
#: Words that choose tooling sources, and code graph methods with their patterns (fixed values).
TOOLING = {"kubernetes": ["kubernetes", "k8s", "deployment", "service", "configmap", "ingress"], "helm": ["helm", "chart"], "dockerfile": ["dockerfile", "docker"], "graphql": ["graphql", "schema"], "istio": ["istio", "virtualservice", "destinationrule", "gateway"]}
CODE_METHODS = {"find_callers": ["find callers", "who calls", "functions that call"], "find_callees": ["find callees", "called by", "callees"], "dead_code": ["dead code", "unused function", "unused method", "never called"], "complexity": ["complexity of", "cyclomatic"], "class_hierarchy": ["class hierarchy", "inheritance", "parent class"], "module_deps": ["module dependencies", "depends on module"], "call_chain": ["call chain", "execution trace"]}
#: Features that a query asks for, by words in it (fixed values).
FEATURES = {"has_async": ["event", "kafka", "async", "message"], "has_auth": ["auth", "login", "security"], "has_database": ["database", "storage", "hana", "sql"], "has_api": ["api", "rest", "graphql", "endpoint"], "has_ui": ["ui", "web", "frontend", "screen"], "has_microservices": ["service", "microservice"], "has_serverless": ["lambda", "function", "serverless"], "has_container": ["container", "docker", "kubernetes", "k8s"], "scalability_required": ["scale", "performance", "high availability"], "multi_tenant": ["multi", "tenant", "saas"]}


def any_pattern(text: Column, patterns: list[str]) -> Column:
    return F.rlike(text, F.lit("(?i)(?:" + "|".join(patterns) + ")"))


def any_word(text: Column, found: list[str]) -> Column:
    """Whether the lower-cased text holds one of the strings."""
    t = F.lower(text)
    out = F.contains(t, F.lit(found[0]))
    for w in found[1:]:
        out = out | F.contains(t, F.lit(w))
    return out


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def intents(query: Column) -> Column:
    """Intents in order; ``complex`` for over ten words, ``fact`` if there is none."""
    found = [F.when(any_pattern(query, p), F.lit(name)) for name, p in INTENTS.items()]
    found.append(F.when(word_count(query) > 10, F.lit("complex")))
    given = F.filter(F.array(*found), lambda x: x.isNotNull())
    return F.when(F.size(given) > 0, given).otherwise(F.array(F.lit("fact")))


def complexity_score(query: Column) -> Column:
    return word_count(query) / 10.0 + any_word(query, COMPARISON).cast("int") + 0.5 * any_word(query, NEGATION).cast("int") + 0.5 * any_word(query, AGGREGATION).cast("int")


def complexity(query: Column) -> Column:
    s = complexity_score(query)
    return F.when(s >= 2, "high").when(s >= 1, "medium").otherwise("low")


def strategy(found: Column) -> Column:
    has, first = (lambda x: F.array_contains(found, x)), F.get(found, F.lit(0))
    return (
        F.when(has("relationship") | has("causal"), "multi_hop")
        .when(has("code_relationship") | (F.size(found) > 1), "hybrid")
        .when(first.isin("code", "list"), "cascade")
        .when(first == "fact", "iterative")
        .otherwise("vector_only")
    )


def tooling_sources(query: Column) -> Column:
    given = F.filter(F.array(*(F.when(any_word(query, w), F.lit(name)) for name, w in TOOLING.items())), lambda x: x.isNotNull())
    some = F.when(F.size(given) > 0, given).otherwise(F.array(F.lit("kubernetes")))
    return F.when(any_pattern(query, INTENTS["tooling"]), some).otherwise(F.array().cast("array<string>"))


def code_method(query: Column) -> Column:
    return F.coalesce(*(F.when(any_word(query, p), F.lit(name)) for name, p in CODE_METHODS.items()))


def sources(found: Column, plan: Column, tools: Column) -> Column:
    """Sources to read, in order and once each."""
    first = F.get(found, F.lit(0))
    names = lambda *x: F.array(*map(F.lit, x))
    vector = first.isin("fact", "list", "documentation")
    graph = first.isin("relationship", "causal", "code_relationship")
    none = F.array().cast("array<string>")
    own = F.concat(F.when(vector, names("code", "docs")).otherwise(none), F.when(graph, names("graph")).otherwise(none))
    base = F.when(plan == "hybrid", names("code", "graph", "docs")).when(plan == "multi_hop", names("graph", "code")).when(plan == "vector_only", names("code", "docs")).otherwise(own)
    return F.array_distinct(F.concat(base, F.when(first == "tooling", tools).otherwise(none)))


def classify(rows: DataFrame, query: str = "query") -> DataFrame:
    """Adds intents, primary_intent, strategy, complexity, tooling_sources, codegraph_method and sources."""
    q = F.coalesce(F.col(query), F.lit(""))
    out = rows.withColumns({"intents": intents(q), "complexity": complexity(q), "tooling_sources": tooling_sources(q)})
    out = out.withColumns({"primary_intent": F.get("intents", F.lit(0)), "strategy": strategy(F.col("intents")), "codegraph_method": F.when(F.array_contains("intents", "code_relationship"), code_method(q))})
    return out.withColumn("sources", sources(F.col("intents"), F.col("strategy"), F.col("tooling_sources")))


def features(rows: DataFrame, query: str = "query") -> DataFrame:
    """Adds a flag for each feature that the query asks for."""
    return rows.withColumns({name: any_word(F.coalesce(F.col(query), F.lit("")), w) for name, w in FEATURES.items()})
