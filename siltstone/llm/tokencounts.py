"""Token counts of sections from one encoding of the whole document.

A document is encoded once. Its tokens' character spans are joined to the spans of its
sections (an interval join inside the row, by binary search), so counts add up to the
document's. A token that crosses a border between sections goes to one of them by ``rule``:

``start``    the section that holds the token's first character (the default);
``end``      the section that holds its last character;
``largest``  the section with most of its characters, the earlier of equal ones.

Rows are independent: one narrow pass, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from siltstone.llm.bpe import CACHE_ENTRIES, Encoder, VOCABULARY, encoder
from siltstone.llm.shared import require, text_or_empty

RULES = ("start", "end", "largest")
#: Where a section ends: after each line break (a fixed value).
LINES = r"\n"


def encoded(enc: Encoder, text: str, known: dict[str, int]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Pre-tokens of the whole text in order (special tokens too), their lengths in characters and their numbers of tokens."""
    words: list[str] = []
    for part in enc.parts(text):
        words += [part] if part in enc.special else enc.words(part)
    if len(known) > CACHE_ENTRIES:
        enc.seen.clear()
        known.clear()
        known.update(dict.fromkeys(enc.special, 1))
    if new := list(set(words).difference(known)):
        enc.learn(new)
        for w in new:
            known[w] = enc.seen[w][0].count(",") + 1
    n = len(words)
    return words, np.fromiter(map(len, words), np.int64, n), np.fromiter(map(known.__getitem__, words), np.int64, n)


def token_ends(enc: Encoder, word: str) -> np.ndarray:
    """Ends in characters of a pre-token's tokens. A token that ends inside a character ends after it."""
    if word in enc.special:
        return np.array([len(word)])
    if word not in enc.seen:
        enc.learn([word])
    sizes = np.cumsum([len(enc.bytes_of[int(i)]) for i in enc.seen[word][0].split(",")])
    raw = np.frombuffer(word.encode(), np.uint8)
    return np.cumsum((raw & 0xC0) != 0x80)[sizes - 1]  # characters begun by the token's last byte


def allocate(ends: np.ndarray, start: int, borders: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token of a pre-token that starts at ``start``, and which tokens cross a border.

    A token that begins inside a character, which it shares with the token before, begins there.
    """
    starts = np.minimum(np.concatenate([[start], ends[:-1]]), ends - 1)
    first, last = np.searchsorted(borders, starts, "right"), np.searchsorted(borders, ends - 1, "right")
    to = first.copy() if rule != "end" else last
    crossing = np.flatnonzero(first != last)
    if rule == "largest":
        for k in crossing:
            inner = np.concatenate([[starts[k]], borders[first[k] : last[k]], [ends[k]]])
            to[k] = first[k] + int(np.diff(inner).argmax())
    return to, crossing


def counts(enc: Encoder, text: str, borders: np.ndarray, rule: str, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens, and among them tokens that cross a border, for each section; borders: the sections' ends.

    Pre-tokens are joined to the sections as intervals. Those inside one section bring all
    their tokens; the tokens of the others are joined one by one.
    """
    words, lengths, numbers = encoded(enc, text, known)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    first, last = np.searchsorted(borders, starts, "right"), np.searchsorted(borders, ends - 1, "right")
    inside = first == last
    total = np.bincount(first[inside], numbers[inside], len(borders)).astype(np.int64)
    crossed = np.zeros(len(borders), np.int64)
    for k in np.flatnonzero(~inside):
        to, over = allocate(token_ends(enc, words[k]) + starts[k], int(starts[k]), borders, rule)
        np.add.at(total, to, 1)
        np.add.at(crossed, to[over], 1)
    return total, crossed


def section_counts(docs: DataFrame, rule: str = "start", ends: str = LINES, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing), a row for each section of each row.

    Sections end after each match of the regular expression ``ends`` and at the end of the
    text; ``start`` and ``end`` are characters, ``section`` counts from 0. A null or empty
    text has one empty section without tokens. Repeated rows give repeated sections; an empty
    table none; extra columns are ignored, whatever their names. The counts of a document's
    sections add up to its tokens.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    require(docs, ["doc_id", "text"])
    rows = docs.select(F.col("doc_id"), text_or_empty().alias("text"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, find = encoder(path), regex.compile(ends).finditer
        known = dict.fromkeys(enc.special, 1)
        for whole in batches:
            for a in range(0, len(whole), 500):
                batch, out = whole.slice(a, 500), [[] for _ in range(6)]
                for k, text in enumerate(batch.column(1).to_pylist()):
                    borders = np.array([m.end() for m in find(text) if m.end() < len(text)] + [len(text)])
                    total, crossing = counts(enc, text, borders, rule, known) if text else (np.zeros(1, np.int64),) * 2
                    for col, v in zip(out, (np.full(len(borders), k), np.arange(len(borders)), np.concatenate([[0], borders[:-1]]), borders, total, crossing)):
                        col.append(v)
                k, section, start, end, n, c = (np.concatenate(col) for col in out)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(k)), *(pa.array(x.astype(t)) for x, t in ((section, np.int32), (start, np.int32), (end, np.int32), (n, np.int64), (c, np.int64)))], names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    return rows.mapInArrow(run, f"doc_id {kind}, section int, start int, end int, n_tokens long, n_crossing long")


def field_counts(rows: DataFrame, fields: list[str], separator: str = "\n", rule: str = "start", id_col: str = "doc_id", path: str = VOCABULARY) -> DataFrame:
    """(id, field, n_tokens): string columns joined by ``separator`` and encoded once, each field with the separator after it.

    A null field is empty and still has its separator; null and repeated ids are rows of their
    own, and a row gives one row a field. An empty table gives an empty one; extra columns are
    ignored. The counts of a row's fields add up to the tokens of the joined text.
    """
    require(rows, [id_col, *fields])
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    kind = rows.select(id_col).schema[0].dataType.simpleString()
    source = rows.select(F.col(id_col), *(F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"_{k}") for k, f in enumerate(fields)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        known = dict.fromkeys(enc.special, 1)
        for batch in batches:
            ids, names, numbers = [], [], []
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                parts = [v + separator for v in values[1:-1]] + [values[-1]]
                borders = np.cumsum([len(p) for p in parts])
                n = counts(enc, "".join(parts), borders, rule, known)[0]
                ids += [values[0]] * len(parts)
                names += fields
                numbers += n.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema[0].type), pa.array(names, pa.string()), pa.array(numbers, pa.int64())], names=[id_col, "field", "n_tokens"])

    return source.mapInArrow(run, f"`{id_col}` {kind}, field string, n_tokens long")
