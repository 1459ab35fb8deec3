"""BPE encoding and decoding with forced boundaries.

A byte pair that occurs inside no token of the vocabulary can never be joined by a merge,
so a token always ends between its two bytes. Each pre-token is cut at those pairs, the
fragments are encoded on their own and the ids concatenated. The cuts are applied inside
pre-tokens only: the pre-tokeniser looks ahead over white space, so a cut of the raw text
would change what it sees.

Rows are independent: one narrow pass, no shuffle, and a lost executor costs only its
tasks. A worker keeps the encodings of pre-tokens it has seen, up to a fixed number.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltstone.llm.shared import give_back, require, text_or_empty

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: The public byte-level pre-tokeniser pattern (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII and Latin letters alone, where the standard library's faster engine agrees with it.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
ONLY_LATIN = re.compile(rf"[\t-\r -~{LATIN}]*")
LATIN_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\s0-9{LATIN}]+|\s+(?!\S)|\s+")
#: A worker forgets its pre-tokens before a text that finds more than this many.
CACHE_ENTRIES = 150_000
_LOADED: dict[str, "Encoder"] = {}


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Encoder:
    """Encodes and decodes with one byte-level BPE vocabulary file."""

    def __init__(self, path: str = VOCABULARY):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of_letter = {c: b for b, c in enumerate(byte_letters())}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(of_letter[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        merged = ["".join(pair if isinstance(pair, list) else pair.split(" ")) for pair in spec["model"]["merges"]]
        if [spec["model"]["vocab"][s] for s in merged] != sorted({spec["model"]["vocab"][s] for s in merged}):
            raise ValueError("the ids of this vocabulary do not follow its merges")
        self.bytes_of = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in self.special.items()}
        self.joined = np.zeros((256, 256), bool)  # byte pairs inside some token
        for token in ranks:
            for pair in zip(token, token[1:]):
                self.joined[pair] = True
        self.encode_fragment = tiktoken.Encoding("fragments", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.split_any = regex.compile(PATTERN).findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.seen: dict[str, tuple[str, bytes]] = {}

    def parts(self, text: str) -> list[str]:
        """The text, cut around the strings of special tokens."""
        if self.split_special and any(s in text for s in self.special):
            return [p for p in self.split_special(text) if p]
        return [text] if text else []

    def words(self, text: str) -> list[str]:
        return (LATIN_PATTERN.findall if ONLY_LATIN.fullmatch(text) else self.split_any)(text)

    def learn(self, words: list[str]) -> None:
        """Encode pre-tokens: cut at the forced boundaries, encode the fragments, concatenate.

        The byte pairs of all the words are looked up in one vectorised pass.
        """
        raw = [w.encode() for w in words]
        data = np.frombuffer(b"".join(raw), np.uint8)
        forced = (np.flatnonzero(~self.joined[data[:-1], data[1:]]) + 1).tolist()
        forced.append(len(data))
        piece, bytes_of, start, k = self.encode_fragment, self.bytes_of, 0, 0
        for word, b in zip(words, raw):
            end, ids, at = start + len(b), [], start
            while forced[k] < end:
                if forced[k] > at:
                    ids += piece(b[at - start : forced[k] - start])
                    at = forced[k]
                k += 1
            ids += piece(b[at - start :])
            self.seen[word] = (",".join(map(str, ids)), b"".join([bytes_of[i] for i in ids]))
            start = end

    def round_trip(self, text: str) -> tuple[str, bytes]:
        """The ids as decimals joined by commas, and the bytes that they decode to."""
        found: list[tuple[str, bytes]] = []
        for part in self.parts(text):
            if part in self.special:
                found.append((str(self.special[part]), part.encode()))
                continue
            words = self.words(part)
            if len(self.seen) > CACHE_ENTRIES:
                self.seen.clear()
            if new := list(set(words).difference(self.seen)):
                self.learn(new)
            found += [self.seen[w] for w in words]
        return ",".join([f[0] for f in found]), b"".join([f[1] for f in found])

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; the strings of special tokens become their ids."""
        joined = self.round_trip(text)[0]
        return list(map(int, joined.split(","))) if joined else []

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every whole text, decode the ids again, and digest both.

    Returns the id column, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``, and with
    ``with_ids`` also ``ids array<int>`` and ``decoded string``. A null text counts as
    empty: 0 tokens and the digests of the empty string. Repeated rows are encoded each;
    an empty table gives no rows; other columns are ignored.
    """
    require(docs, [id_col, text_col])
    source = docs.select(F.col(id_col), text_or_empty(text_col).alias("text"))
    kind = source.schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            n, ids_sha, text_sha, ids, texts = [], [], [], [], []
            for a in range(0, len(batch), 500):
                for text in batch.column(1).slice(a, 500).to_pylist():
                    joined, decoded = enc.round_trip(text)
                    n.append(joined.count(",") + 1 if joined else 0)
                    ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                    text_sha.append(hashlib.sha256(decoded).hexdigest())
                    if with_ids:
                        ids.append(list(map(int, joined.split(","))) if joined else [])
                        texts.append(decoded.decode("utf-8", "replace"))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            if with_ids:
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])
        enc.seen.clear()
        give_back()

    return source.mapInArrow(run, schema)
