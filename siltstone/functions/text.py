"""Text functions as Column expressions; all run inside the JVM unless they say otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Stop words (fixed values).
STOP_RU = ["и", "в", "во", "не", "что", "он", "на", "я", "с", "со", "как", "а", "то", "все", "она", "так", "его", "но", "да", "ты", "у", "же", "вы", "за", "бы", "по", "только", "ее", "мне", "было", "вот", "от", "меня", "еще", "нет", "о", "из", "ему", "теперь", "когда", "уже", "вам", "ни", "быть", "был", "него", "до", "нас", "для"]
STOP_EN = ["the", "is", "at", "which", "on", "and", "a", "an", "to", "in", "of", "for", "that", "by", "with", "from", "as", "it", "be", "are", "was", "or", "have", "has", "had", "were", "been", "being", "this", "these", "those", "can", "will", "just", "should", "would", "could"]
#: Names of languages, characters a token by provider, and punctuation that ends names (fixed values).
LANGUAGE_NAMES = {"ru": "Russian", "en": "English", "unknown": "Unknown"}
CHARS_PER_TOKEN = {"openai": 4, "qwen": 4, "ollama": 3}
TRAILING = ".,!?;:()[]{}\"'"
#: Words of feelings (fixed values).
POSITIVE = ["love", "great", "amazing", "excellent", "good", "best", "awesome"]
NEGATIVE = ["hate", "bad", "terrible", "awful", "worst", "poor", "broken", "slow"]


def words(text: Column) -> Column:
    """Runs of characters other than white space; none for an empty text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def count_of(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def script_language(text: Column) -> Column:
    """``ru`` or ``en`` if one script has over twice the letters of the other, else ``unknown``."""
    t = F.coalesce(text, F.lit(""))
    cyrillic, latin = count_of(t, "[Ѐ-ԯ]"), count_of(t, "[A-Za-z]")
    return F.when(cyrillic > 2 * latin, "ru").when(latin > 2 * cyrillic, "en").otherwise("unknown")


def language_name(code: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv))[code], F.lit("Unknown"))


def is_cyrillic(text: Column) -> Column:
    return F.rlike(text, F.lit("[Ѐ-ӿ]"))


def is_latin(text: Column) -> Column:
    return F.rlike(text, F.lit("[A-Za-z]"))


def clean_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\t\n\r]+", " "), " {2,}", " "))


def split_sentences(text: Column) -> Column:
    """Sentences without their terminators, but for one at the end of the text."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?]+\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def remove_stop_words(text: Column, language: Column | str) -> Column:
    russian = (F.lit(language) if isinstance(language, str) else language) == "ru"
    stops = F.when(russian, F.array(*map(F.lit, STOP_RU))).otherwise(F.array(*map(F.lit, STOP_EN)))
    return F.array_join(F.filter(words(text), lambda w: ~F.array_contains(stops, F.lower(w))), " ")


def truncate_for_embedding(text: Column, max_tokens: int = 8000, provider: str = "openai") -> Column:
    return F.substring(text, 1, max_tokens * CHARS_PER_TOKEN.get(provider, 4))


@F.pandas_udf(T.StringType())
def _fold(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def fold(t: str | None) -> str | None:
        if t is None or t.isascii():
            return t
        plain = "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")
        return unicodedata.normalize("NFKC", unicodedata.normalize("NFC", plain))

    for p in parts:
        yield p.map(fold)


def normalize_text(text: Column, language: str | None = None) -> Column:
    """Lower case, folded accents and compatibility forms, single spaces. Folding is an Arrow UDF: Spark has no normaliser."""
    t = F.lower(F.coalesce(text, F.lit("")))
    if language == "ru":
        t = F.translate(t, "ё", "е")
    return F.regexp_replace(F.regexp_replace(_fold(t), r"(?U)\s+", " "), "^ | $", "")


def capitalised(text: Column) -> Column:
    """Words that start with a capital and have over one letter, without punctuation after them."""
    stripped = F.transform(words(text), lambda w: F.regexp_replace(w, r"""[.,!?;:()\[\]{}"']+$""", ""))
    return F.filter(stripped, lambda w: F.rlike(w, F.lit(r"^\p{Lu}")) & (F.length(w) > 1))


def query_entity(query: Column) -> Column:
    """The entity that a question is about: four patterns in order, else the last of at most three words."""
    patterns = [
        r"(?i)(?:find|get|show)\s+(?:all\s+)?(?:callers?|callees?)\s+of\s+(\w+)",
        r"(?i)(?:who|what)\s+(?:calls?|uses?|imports?)\s+(\w+)",
        r"(?i)(\w+)\s+(?:function|method|class|module)",
        r"(?i)entities?\s+(?:for|related to)\s+(\w+)",
    ]
    w = words(query)
    found = [F.nullif(F.regexp_extract(query, p, 1), F.lit("")) for p in patterns]
    return F.coalesce(*found, F.when((F.size(w) <= 3) & (F.size(w) > 0), F.element_at(w, -1)))


def hash_id(*parts: Column, length: int = 16) -> Column:
    """The first digits of the SHA-256 of the parts, joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, length)


def link_target(url: Column) -> Column:
    """Normalised target of a link; null for anchors and empty links."""
    return (
        F.when((url == "") | F.startswith(url, F.lit("#")), None)
        .when(F.startswith(url, F.lit("http")), url)
        .when(F.startswith(url, F.lit("/")), F.regexp_replace(url, "^/+", ""))
        .otherwise(F.regexp_replace(url, r"\.(md|html)$", ""))
    )


def context_window(text: Column, position: Column, size: int = 50) -> Column:
    """Characters around a 0-based position, in one line."""
    start = F.greatest(F.lit(0), position - size)
    return F.regexp_replace(F.substr(text, start + 1, position + size - start), "\n", " ")


def sentiment(text: Column) -> tuple[Column, Column]:
    """(label, score) from words of feelings that occur in the text."""
    t = F.lower(F.coalesce(text, F.lit("")))
    hits = lambda ws: sum((F.contains(t, F.lit(w)).cast("int") for w in ws[1:]), F.contains(t, F.lit(ws[0])).cast("int"))
    up, down = hits(POSITIVE), hits(NEGATIVE)
    label = F.when(up > down, "positive").when(down > up, "negative").otherwise("neutral")
    score = F.when(up > down, F.least(0.5 + up * 0.15, F.lit(0.95))).when(down > up, F.greatest(0.5 - down * 0.15, F.lit(0.05))).otherwise(0.5)
    return label, score.cast("double")


def refine_terms(content: Column, count: int = 10) -> tuple[Column, Column]:
    """(names, keywords) in order of first occurrence, at most ``count`` of each."""
    w = words(content)
    names = F.filter(w, lambda x: F.rlike(x, F.lit(r"^\p{Lu}")) & (F.length(x) > 2))
    keys = F.filter(w, lambda x: F.length(x) > 5)
    return F.slice(F.array_distinct(names), 1, count), F.slice(F.array_distinct(keys), 1, count)


def refined_query(query: Column, contents: Column) -> Column:
    """The query and the beginnings of the best two contents, at most 500 characters."""
    heads = F.transform(F.slice(contents, 1, 2), lambda c: F.substring(c, 1, 100))
    return F.substring(F.trim(F.concat(query, F.lit(" "), F.array_join(heads, " "))), 1, 500)


def expand_query(query: Column, contents: Column) -> Column:
    """Sorted terms of the query with up to two new long terms from each of the best three contents."""
    terms = F.array_distinct(words(F.lower(query)))
    grown = F.aggregate(
        F.slice(contents, 1, 3),
        terms,
        lambda t, c: F.array_distinct(F.concat(t, F.slice(F.filter(words(F.lower(c)), lambda w: (F.length(w) > 4) & ~F.array_contains(t, w)), 1, 2))),
    )
    joined = F.array_join(F.array_sort(grown), " ")
    return F.when((joined != "") & (joined != query), joined)


def focus_query(contents: Column) -> Column:
    head = F.slice(words(F.get(contents, F.lit(0))), 1, 10)
    return F.when(F.size(head) > 0, F.array_join(head, " "))


def decompose_query(query: Column) -> Column:
    """The second half of a query of over five words."""
    w = words(query)
    half = F.floor(F.size(w) / 2).cast("int")
    return F.when(F.size(w) > 5, F.array_join(F.slice(w, half + 1, F.size(w) - half), " "))


def sanitize_input(text: Column, max_length: int = 10_000) -> Column:
    return F.substring(F.regexp_replace(text, r"^\s+|\s+$", ""), 1, max_length)


#: Prompt injections (fixed values).
INJECTIONS = [
    r"ignore\s+(all\s+)?previous\s+instructions",
    r"ignore\s+(all\s+)?(your\s+)?(system\s+)?(instructions?|directives?)",
    r"system:\s*",
    r"you\s+are\s+(now\s+)?",
    r"act\s+as\s+",
    r"pretend\s+(to\s+be|you\s+are)",
    r"forget\s+(everything|all|your)",
    r"new\s+instructions",
    r"override\s+(your\s+)?instructions",
    r"disregard\s+(your\s+)?(previous\s+)?(instructions?|rules?)",
    r"\[INST\]|\[/INST\]",
    r"<<SYS>>|<<\/SYS>>",
    r"<\|system\|>|<\|user\|>|<\|assistant\|>",
]


def sanitize_prompt(text: Column) -> Column:
    for p in INJECTIONS:
        text = F.regexp_replace(text, f"(?i){p}", "[FILTERED]")
    return text


def progress(status: Column) -> Column:
    """How far a job of the given status has come."""
    steps = {"pending": 0.0, "chunking": 0.25, "embedding": 0.5, "indexing": 0.75, "completed": 1.0, "failed": 0.0}
    return F.coalesce(F.create_map(*(F.lit(x) for kv in steps.items() for x in kv))[status], F.lit(0.0))
