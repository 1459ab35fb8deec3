"""Extractive reasoning over ranked facts, validation of responses, citations, evaluation.

Facts are (qid, content, source, score, rank), a bounded number a question; everything is a
column expression over a question's array of facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siltstone.operators import graph
from siltstone.operators.classify import any_word
from siltstone.storage import cut

#: Answers where there is nothing to say (fixed values).
NOTHING, TOO_LITTLE, NO_ANSWER = "No relevant information found.", "Insufficient information to answer the query.", "No answer found."
#: Topics, question words, and destructive commands (fixed values).
TOPICS = ["api", "service", "config", "auth", "user", "data", "query", "system", "code", "document", "error", "file", "server", "database", "endpoint"]
QUESTIONS = ["what", "how", "why", "when", "where", "who", "which"]
DESTRUCTIVE = [r"sudo\s+rm", r"DELETE\s+FROM", r"drop\s+table", r"rm\s+-rf"]
#: Patterns of risky code, with what each says (fixed values).
VULNERABILITIES = [
    (r"password\s*=\s*['\"][^'\"]{0,8}['\"]", "Hardcoded password detected"),
    (r"api[_-]?key\s*=\s*['\"][A-Za-z0-9]{20,}['\"]", "Potential hardcoded API key"),
    (r"eval\s*\(", "Use of eval() is a security risk"),
    (r"exec\s*\(", "Use of exec() is a security risk"),
    (r"__import__\s*\(", "Dynamic imports can be a security risk"),
    (r"os\.system\s*\(", "Shell commands via os.system are risky"),
    (r"subprocess\.run\s*\([^,]+shell\s*=\s*True", "Shell injection vulnerability"),
    (r"SELECT\s+\*\s+FROM", "SELECT * may expose sensitive data"),
    (r"GRANT\s+ALL", "Overly permissive database grant"),
    (r"\.\.\/", "Potential path traversal"),
]


def gathered(facts: DataFrame) -> DataFrame:
    """(qid, facts): each question's facts in order of rank."""
    one = F.array_sort(F.collect_list(F.struct("rank", "content", "source", "score")))
    return facts.groupBy("qid").agg(one.alias("facts"))


def mean_score(facts: Column) -> Column:
    return F.aggregate(facts, F.lit(0.0), lambda a, f: a + F.coalesce(f["score"], F.lit(0.0))) / F.greatest(F.size(facts), F.lit(1))


def chain_answer(facts: Column) -> Column:
    """The first two contents that are not empty among the best three facts."""
    given = F.filter(F.transform(F.slice(facts, 1, 3), lambda f: F.coalesce(f["content"], F.lit(""))), lambda c: c != "")
    return F.when(F.size(facts) == 0, TOO_LITTLE).when(F.size(facts) == 1, F.get(facts, F.lit(0))["content"]).when(F.size(given) == 0, NO_ANSWER).otherwise(F.array_join(F.slice(given, 1, 2), " | "))


def best_fact(facts: Column) -> Column:
    """The first fact of the highest score."""
    return F.aggregate(facts, F.get(facts, F.lit(0)), lambda a, f: F.when(F.coalesce(f["score"], F.lit(0.0)) > F.coalesce(a["score"], F.lit(0.0)), f).otherwise(a))


def reason(questions: DataFrame, mode: str = "direct", branches: int = 3) -> DataFrame:
    """Adds ``answer`` and ``confidence`` to (qid, facts); modes: direct, chain, tree, reflect, critique."""
    facts = F.col("facts")
    if mode == "direct":
        top = F.get(facts, F.lit(0))
        answer, confidence = F.when(F.size(facts) == 0, NOTHING).otherwise(top["content"]), F.when(F.size(facts) == 0, 0.0).otherwise(F.coalesce(top["score"], F.lit(0.5)))
    elif mode == "chain":
        answer, confidence = chain_answer(facts), mean_score(facts)
    elif mode == "tree":  # branch b has every branches-th fact from b on; its length says how many facts of the list count
        lengths = [1 + F.floor((F.size(facts) - 1 - b) / branches).cast("int") + 1 for b in range(branches)]
        means = [F.when(F.size(facts) > b, mean_score(F.slice(facts, 1, n))) for b, n in enumerate(lengths)]
        answer, confidence = F.when(F.size(facts) == 0, TOO_LITTLE).otherwise(best_fact(facts)["content"]), F.coalesce(F.greatest(*means), F.lit(0.0))
    elif mode == "reflect":
        good = F.filter(facts, lambda f: f["score"] > 0.3)
        answer, confidence = chain_answer(F.when(F.size(good) > 0, good).otherwise(facts)), mean_score(good)
    elif mode == "critique":
        strong = F.filter(facts, lambda f: f["score"] > 0.7)
        used = F.when(F.size(strong) > 0, strong).otherwise(F.slice(facts, 1, 2))
        answer, confidence = chain_answer(used), mean_score(used)
    else:
        raise ValueError("mode must be direct, chain, tree, reflect or critique")
    return questions.withColumns({"answer": answer, "confidence": confidence})


def facts_about(facts: Column, names: Column, most: int = 10) -> Column:
    """Facts that hold one of the names; all facts if none does."""
    about = F.filter(facts, lambda f: F.exists(names, lambda n: F.contains(F.lower(f["content"]), F.lower(n))))
    return F.slice(F.when((F.size(names) > 0) & (F.size(about) > 0), about).otherwise(facts), 1, most)


def named_in(query: Column) -> Column:
    """Distinct words of a query that begin with a capital and have two letters or more, without the punctuation that ends them, in order."""
    words = F.transform(F.split(F.coalesce(query, F.lit("")), r"\s+"), lambda w: F.regexp_replace(w, r"[.,!?;:()\[\]{}\"']+$", ""))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: F.rlike(w, F.lit(r"^\p{Lu}.")))))


def entity_aware(questions: DataFrame, edges: DataFrame, hops: int = 3, fan: int = 3, order: str | None = None) -> DataFrame:
    """Reasoning along the graph: one row a question (qid, query, facts) with entities, paths, steps, answer, confidence and sources.

    Entities are the capitalised words of the query; those with an edge (src, dst, type: names)
    have a path, ``graph.traversals`` that only the query's own entities lead on. Facts that
    name an entity are kept, all if none does, ten at most. The confidence is the mean score
    of the facts plus 0.2 for each node of a mean path, 1 at most. Null scores count 0; a null
    query has no entity. qid must be unique; other columns are dropped.
    """
    named = cut(questions.select("qid", "query", "facts", named_in(F.col("query")).alias("entities")))
    pairs = named.select("qid", F.explode("entities").alias("id"))
    # a question's entities lead on within that question alone
    own = F.concat_ws(chr(0xE000), F.col("qid").cast("string"), F.col("id"))
    near = graph.first_neighbours(edges, fan, order)
    mine = pairs.join(near, pairs["id"] == near["a"]).select(own.alias("src"), F.concat_ws(chr(0xE000), F.col("qid").cast("string"), F.col("b")).alias("dst"), F.lit("").alias("type"), "place")
    mine = cut(mine)
    seeds = mine.select(F.col("src").alias("id")).distinct()
    walked = graph.traversals(seeds, mine, hops, fan, "place")
    bare = lambda c: F.substring_index(c, chr(0xE000), -1)
    paths = walked.select(F.substring_index("start", chr(0xE000), 1).alias("_q"), F.struct(bare(F.col("start")).alias("entity"), F.transform("nodes", bare).alias("nodes")).alias("p"))
    paths = paths.groupBy("_q").agg(F.array_sort(F.collect_list("p")).alias("paths"))
    rows = named.join(paths, F.col("qid").cast("string") == F.col("_q"), "left").withColumn("paths", F.coalesce("paths", F.array().cast("array<struct<entity:string,nodes:array<string>>>")))
    rows = rows.withColumn("facts", facts_about(F.coalesce("facts", F.array().cast("array<struct<rank:int,content:string,source:string,score:double>>")), F.col("entities")))
    given = F.filter(F.transform(F.slice("facts", 1, 3), lambda f: F.coalesce(f["content"], F.lit(""))), lambda c: c != "")
    answer = F.when(F.size("facts") == 0, NOTHING).when(F.size(given) == 0, TOO_LITTLE).otherwise(F.array_join(F.slice(given, 1, 2), " | "))
    length = F.aggregate("paths", F.lit(0), lambda a, p: a + F.size(p["nodes"])) / F.greatest(F.size("paths"), F.lit(1))
    step = lambda n, thought, action, seen, parent: F.struct(n.cast("string").alias("step_id"), thought.alias("thought"), F.lit(action).alias("action"), seen.alias("observation"), parent.alias("parent_id"))
    first = step(F.lit(0), F.concat(F.lit("Analyzing query: "), F.coalesce("query", F.lit(""))), "analyze", F.concat(F.lit("Identified "), F.size("paths").cast("string"), F.lit(" graph paths")), F.lit(None).cast("string"))
    more = F.transform("paths", lambda p, k: step(k + 1, F.concat(F.lit("Entity: "), p["entity"]), "traverse", F.concat(F.lit("Path length: "), F.size(p["nodes"]).cast("string")), F.lit("0")))
    return rows.select("qid", "query", "entities", "paths", F.concat(F.array(first), more).alias("steps"), answer.alias("answer"), F.least(mean_score(F.col("facts")) + length * 0.2, F.lit(1.0)).alias("confidence"), F.transform(F.slice("facts", 1, 3), lambda f: f["source"]).alias("sources"))


def iteration_confidence(new: Column, total: Column, iteration: Column) -> Column:
    """Confidence of a round of iterative retrieval."""
    raw = mean_score(new) + F.least(total / 10.0, F.lit(0.3)) - F.least(iteration * 0.1, F.lit(0.3))
    return F.when(F.size(new) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def topics(text: Column) -> Column:
    w = F.split(F.lower(text), r"\s+")
    return F.array_intersect(F.filter(w, lambda x: F.length(x) > 4), F.array(*map(F.lit, TOPICS)))


def validate(rows: DataFrame) -> DataFrame:
    """Adds issue counts of four checks, ``valid``, ``score`` and ``confidence`` to (query, response, contexts array of strings, relevant array of booleans)."""
    q, r = F.lower("query"), F.lower("response")
    terms = F.filter(F.array_distinct(F.split(q, r"\s+")), lambda w: F.length(w) >= 4)
    missing_terms = F.size(F.filter(terms, lambda w: ~F.contains(r, w)))
    far = F.size(F.filter(F.slice(F.coalesce("contexts", F.array().cast("array<string>")), 1, 3), lambda c: (c != "") & (F.substring(F.lower(c), 1, 100) != F.substring(r, 1, 100)) & (F.abs(F.length(c) - F.length(r)) > 500)))
    empty = F.size(F.coalesce("contexts", F.array().cast("array<string>"))) == 0
    accuracy = F.when(empty, 1).otherwise(missing_terms + (far > 2).cast("int"))
    short = any_word(F.col("query"), QUESTIONS) & (F.length("response") < 50)
    open_end = F.contains("query", F.lit("?")) & ~F.rlike("response", F.lit(r"[?.!]$"))
    wanted = topics(F.col("query"))
    lost = F.size(F.array_except(wanted, topics(F.col("response"))))
    completeness = short.cast("int") + open_end.cast("int") + ((lost > 0) & (lost > F.floor(F.size(wanted) / 2))).cast("int")
    safety = sum((F.rlike("response", F.lit(f"(?i){p}")).cast("int") for p in DESTRUCTIVE[1:]), F.rlike("response", F.lit(f"(?i){DESTRUCTIVE[0]}")).cast("int"))
    out = rows.withColumns({"accuracy_issues": accuracy.cast("long"), "completeness_issues": completeness.cast("long"), "safety_issues": safety.cast("long")})
    passed = sum(((F.col(c) == 0).cast("int") for c in ("completeness_issues", "safety_issues")), (F.col("accuracy_issues") == 0).cast("int")) + 1  # a response without a trace is coherent
    share = F.size(F.filter("relevant", lambda x: x)) / F.size("relevant")
    out = out.withColumn("score", passed / 4.0)
    return out.withColumns({"valid": (F.col("safety_issues") == 0) & ~((far > 2) & ~empty), "confidence": F.when(empty, F.col("score")).otherwise((F.col("score") + F.coalesce(share, F.lit(0.0))) / 2)})


def cite(answer: Column, count: Column, style: str = "parenthetical") -> Column:
    """The answer with marks of its sources 1..count."""
    ids = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: i.cast("string"))
    if style == "parenthetical":
        marked = F.concat(answer, F.lit(" (see ["), F.array_join(ids, ", "), F.lit("])"))
    elif style == "footnote":
        marked = F.concat(answer, F.lit(" "), F.array_join(F.transform(ids, lambda i: F.concat(F.lit("["), i, F.lit("]"))), " "))
    elif style in ("verbatim", "highlight", "structured"):
        return answer
    else:
        raise ValueError(f"unknown style {style!r}")
    return F.when(count > 0, marked).otherwise(answer)


def correctness(answer: Column, truth: Column) -> Column:
    """1 if the answer holds the truth, else the share of its words that it holds; 1/2 without a truth."""
    a, t = F.lower(answer), F.lower(truth)
    keys = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    share = F.size(F.filter(keys, lambda k: F.contains(a, k))) / F.greatest(F.size(keys), F.lit(1))
    return F.when(F.coalesce(truth, F.lit("")) == "", 0.5).when(F.contains(a, t), 1.0).otherwise(share)


def relevance(answer: Column, aspects: Column) -> Column:
    a = F.lower(answer)
    return F.size(F.filter(aspects, lambda x: F.contains(a, x))) / F.greatest(F.size(aspects), F.lit(1))


def architecture_quality(answer: Column, query: Column) -> Column:
    about = any_word(query, ["architecture"]) & any_word(answer, ["component", "service", "api"])
    return 0.5 + 0.25 * about.cast("int") + 0.25 * any_word(answer, ["database", "cache", "queue"]).cast("int")


def summary(scores: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """By key: the number of evaluated rows, the mean of each measure, and ``overall``, the mean of rows' means; null measures count 0."""
    given = {m: F.coalesce(F.col(m), F.lit(0.0)) for m in measures}
    mean = sum(list(given.values())[1:], given[measures[0]]) / len(measures)
    return scores.groupBy(key).agg(F.count("*").alias("n"), *(F.avg(c).alias(m) for m, c in given.items()), F.avg(mean).alias("overall"))


def vulnerabilities(rows: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``findings`` (descriptions in order), ``n_medium`` and ``passed``."""
    c = F.coalesce(F.col(content), F.lit(""))
    found = F.filter(F.array(*(F.when(F.rlike(c, F.lit(f"(?i){p}")), F.lit(d)) for p, d in VULNERABILITIES)), lambda x: x.isNotNull())
    return rows.withColumn("findings", found).withColumns({"n_medium": F.size(F.filter("findings", lambda x: F.contains(F.lower(x), F.lit("sql")))), "passed": F.size("findings") == 0})
