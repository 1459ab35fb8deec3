"""Language identification with segmentation-marginalised unigrams.

The vocabulary is fixed and public: the pieces of a SentencePiece model. Each language has
a probability for every piece, fitted by expectation maximisation. A text's likelihood in a
language is the product over its words of the sum, over all segmentations of the word into
pieces, of the product of the pieces' probabilities; a forward pass adds them up. Words end
at white space, so pieces never cross them and every distinct word is scored once.

Long words, as a script without spaces writes its sentences, are summed letter by letter with
the last sixteen sums at hand, in logarithms, so memory does not grow with them.

Fitting reads a bounded sample of labelled rows (``per_lang`` whole texts a language are
expected, chosen by a hash of the id, of at most ``most_langs`` languages). Scoring is one
narrow pass over all rows: no shuffle, no state between tasks but a cache of word scores of a
fixed size.

A posterior tells languages apart but not a text in none of them, so the model also knows how
likely a letter is in each language: from the sample, the mean of the words' log-likelihood a
letter and how much it varies. ``predict`` gives each text's distance from that mean. Only
words of letters count there: numbers, addresses and keys are strange in every language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from siltstone.llm.shared import give_back, materialise, require

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
#: Words of up to this many letters are summed many at a time; 1e-7 to this power is within a double.
SHORT = 40
#: Positions of a long word that are looked up at a time.
STRETCH = 1 << 16
#: Letters of the longest piece that a vocabulary may hold, and the least probability of a character that no piece covers.
PIECE_CHARS, FLOOR = 16, 1e-7
#: Distinct words whose scores a worker keeps.
CACHE_WORDS = 200_000
#: Steps of an expected count; whole numbers add up alike in every order.
SCALE = 2.0**24
UNKNOWN = "und"
PUNCTUATION = ".,;:!?\"'()[]«»„“”‘’¿¡-"
MARK = "▁"


def plain_size(word: str) -> int:
    """Letters of a word with its mark, 0 for one that is not made of letters between marks of punctuation."""
    return len(word) + 1 if word.strip(PUNCTUATION).isalpha() else 0


class Pieces:
    """The vocabulary, found by a rolling hash of code points."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    SLOTS = 18  # bits: at 32,000 pieces one slot in eight is taken
    SPREAD = 0xD6E8FEB86659FD93

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.keys, self.index = np.zeros(1 << self.SLOTS, np.uint64), np.full(1 << self.SLOTS, -1, np.int32)
        if len(pieces) > len(self.keys) // 2:
            raise ValueError(f"a vocabulary of {len(pieces)} pieces")
        for k, piece in enumerate(pieces):
            h = self._hash(piece)
            at = (h * self.SPREAD & 0xFFFFFFFFFFFFFFFF) >> (64 - self.SLOTS)
            while self.index[at] >= 0 and int(self.keys[at]) != h:
                at = (at + 1) % len(self.keys)
            if self.index[at] < 0:
                self.keys[at], self.index[at] = h, k

    def _hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(self.BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece with each hash, or -1: one look at a table, a few more where slots collide."""
        at = (hashes * np.uint64(self.SPREAD) >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        out = self.index[at]
        other = np.flatnonzero((out >= 0).ravel() & (self.keys[at] != hashes).ravel())
        if len(other):
            flat, at, wanted = out.reshape(-1), at.reshape(-1)[other], hashes.reshape(-1)[other]
            while len(other):
                at = (at + 1) % len(self.keys)
                now = self.index[at]
                right = (now >= 0) & (self.keys[at] == wanted)
                done = right | (now < 0)
                flat[other[done]] = np.where(right[done], now[done], -1)
                other, at, wanted = other[~done], at[~done], wanted[~done]
        return out

    @classmethod
    def load(cls, path: str) -> "Pieces":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
        pieces = list(found)
        if max(map(len, pieces), default=0) > PIECE_CHARS:
            raise ValueError(f"a piece has more than {PIECE_CHARS} letters")
        return cls(pieces)


def pieces_at(word: str, pieces: Pieces, start: int, end: int) -> np.ndarray:
    """For n from 1 to 16 and each position of [start, end) the piece of n letters that ends there, or -1."""
    first = max(0, start - PIECE_CHARS + 1)
    points = np.frombuffer(word[first:end].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    out = np.full((PIECE_CHARS, end - start), -1, np.int32)
    run = np.zeros(len(points), np.uint64)
    for n in range(1, min(PIECE_CHARS, len(points)) + 1):
        run = run[: len(points) - n + 1] * Pieces.BASE + points[n - 1 :]  # hashes of the n letters from each place on
        found = pieces.find(run)[max(0, start - first - n + 1) :]
        out[n - 1, end - start - len(found) :] = found
    return out


def summed(word: str, pieces: Pieces, logs: np.ndarray, back: bool = False) -> np.ndarray:
    """Log sums over all segmentations of a word of any length, a column a language; ``back``: of all its beginnings.

    logs: the table's logarithms; its last row is for a letter without a piece.
    """
    last, every = np.zeros((1, logs.shape[1])), []  # sums up to the last sixteen positions, latest first
    for a in range(0, len(word), STRETCH):
        found = pieces_at(word, pieces, a, min(a + STRETCH, len(word)))
        found[0][found[0] < 0] = len(logs) - 1
        for column in found.T:
            n = np.flatnonzero(column[: len(last)] >= 0)
            terms = last[n] + logs[column[n]]
            top = terms.max(axis=0)
            now = top + np.log(np.exp(terms - top).sum(axis=0))
            last = np.concatenate([now[None], last[: PIECE_CHARS - 1]])
            if back:
                every.append(now)
    return np.array(every) if back else last[0]


def lattices(words: list[str], pieces: Pieces, block: int = 4096) -> Iterator[tuple[np.ndarray, list[list[tuple[np.ndarray, np.ndarray]]], np.ndarray]]:
    """For blocks of words of like length: their places, by end position and piece length
    the rows that have such a piece there with the pieces, and the lengths."""
    lengths = np.array([len(w) for w in words])
    order = np.argsort(lengths, kind="stable")
    for a in range(0, len(words), block):
        rows = order[a : a + block]
        size = lengths[rows]
        top = int(size[-1])
        points = np.zeros((top, len(rows)), np.uint64)  # a row a position
        for k, r in enumerate(rows):
            points[: size[k], k] = np.frombuffer(words[r].encode("utf-32-le", "surrogatepass"), np.uint32)
        points += np.uint64(1)
        ends: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(top + 1)]
        run = np.zeros_like(points)
        for n in range(1, min(PIECE_CHARS, top) + 1):
            run = run[: top - n + 1] * Pieces.BASE + points[n - 1 :]  # hashes of the n letters from each place on
            found = pieces.find(run)
            for start in range(top - n + 1):
                inside = np.flatnonzero((found[start] >= 0) & (size >= start + n)) if n > 1 else np.flatnonzero(size >= start + 1)
                if len(inside):
                    ends[start + n].append((inside, found[start, inside], n))
        yield rows, ends, size


def forward(ends: list, count: int, table: np.ndarray) -> np.ndarray:
    """Sums over all segmentations up to each position; table's last row is for letters without a piece."""
    alpha = np.zeros((len(ends), count, table.shape[1]))
    alpha[0] = 1
    for t in range(1, len(ends)):
        for rows, found, n in ends[t]:
            alpha[t, rows] += alpha[t - n, rows] * table[found]
    return alpha


def score_words(words: list[str], pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """Log of each word's summed probability in each language."""
    marked = [MARK + w for w in words]
    out = np.empty((len(words), table.shape[1]))
    short = [k for k, w in enumerate(marked) if len(w) <= SHORT]
    for rows, ends, size in lattices([marked[k] for k in short], pieces):
        out[np.array(short)[rows]] = np.log(forward(ends, len(rows), table)[size, np.arange(len(rows))])
    logs = np.log(table) if len(short) < len(words) else None
    for k, w in enumerate(marked):
        if len(w) > SHORT:
            out[k] = summed(w, pieces, logs)
    return out


def expected_long(word: str, weight: float, pieces: Pieces, logs: np.ndarray) -> np.ndarray:
    """As ``expected`` for one word of any length; logs: one column."""
    total = np.zeros(len(logs))
    ahead = np.concatenate([[0.0], summed(word, pieces, logs, True)[:, 0]])
    behind = np.zeros(PIECE_CHARS)  # sums from the next positions to the end, nearest first
    found = pieces_at(word, pieces, 0, len(word))
    found[0][found[0] < 0] = len(logs) - 1
    size = np.arange(1, PIECE_CHARS + 1)
    for at in range(len(word) - 1, -1, -1):
        n = size[: len(word) - at]
        of = found[n - 1, at + n - 1]
        n, of = n[of >= 0], of[of >= 0]
        terms = behind[n - 1] + logs[of, 0]
        np.add.at(total, of, weight * np.exp(ahead[at] + terms - ahead[-1]))
        top = terms.max()
        behind = np.concatenate([[top + np.log(np.exp(terms - top).sum())], behind[:-1]])
    return total


def expected(words: list[str], weights: np.ndarray, pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """Expected uses of each piece (last: letters without a piece) over all segmentations; one language."""
    total = np.zeros(len(table))
    long = [k for k, w in enumerate(words) if len(w) > SHORT]
    if long:
        logs = np.log(table)
        for k in long:
            total += expected_long(words[k], weights[k], pieces, logs)
        short = [k for k, w in enumerate(words) if len(w) <= SHORT]
        words, weights = [words[k] for k in short], weights[short]
    for rows, ends, size in lattices(words, pieces):
        alpha = forward(ends, len(rows), table)[:, :, 0]
        beta = np.zeros_like(alpha)
        beta[size, np.arange(len(rows))] = 1
        for t in range(len(ends) - 1, 0, -1):
            for at, found, n in ends[t]:
                beta[t - n, at] += table[found, 0] * beta[t, at]
        share = weights[rows] / alpha[size, np.arange(len(rows))]
        for t in range(1, len(ends)):
            for at, found, n in ends[t]:
                np.add.at(total, found, alpha[t - n, at] * table[found, 0] * beta[t, at] * share[at])
    return total


class Model:
    """Languages, their priors, the vocabulary, a probability for each piece and language, and
    the usual log-likelihood a letter and the variance of a word around it, by language."""

    def __init__(self, langs: list[str], priors: np.ndarray, pieces: Pieces, table: np.ndarray, usual: np.ndarray | None = None, spread: np.ndarray | None = None):
        self.langs, self.priors, self.pieces, self.table = langs, priors, pieces, table
        self.usual = np.zeros(len(langs)) if usual is None else usual
        self.spread = np.ones(len(langs)) if spread is None else spread


def learning_rows(docs: DataFrame) -> Column:
    """Rows that may be learnt from: those outside the held-out fifth, with text and lang."""
    return ~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull()


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, vocabulary: str = VOCABULARY, per_lang: int = 1000, rounds: int = 3, where: Column | None = None, most_langs: int = 256) -> Model:
    """Fit on about ``per_lang`` labelled rows a language, drawn by a hash of doc_id.

    Only ``text`` and ``lang`` of rows that ``where`` admits (default: outside the held-out
    fifth) are used. Of more than ``most_langs`` values of ``lang`` the most frequent are
    learnt, ties by name. Counting words and the expectation steps run on the executors; what
    reaches the driver is one number a piece and language, bounded by vocabulary and languages.
    """
    require(docs, ["doc_id", "text", "lang"])
    spark = docs.sparkSession
    rows = docs.where(learning_rows(docs) if where is None else where).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()}
    langs = sorted(sizes)
    pieces = Pieces.load(vocabulary)
    if not langs:
        return Model([], np.zeros(0), pieces, np.zeros((len(pieces.pieces) + 1, 0)))
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, min(1.0, per_lang / sizes[lang])).otherwise(share)
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < share * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.setdefault(lang, Counter()).update(MARK + w for w in text.split())
            for lang, words in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array(list(words)), pa.array(list(words.values()), pa.int64())], names=["lang", "word", "n"])

    words = materialise(drawn.select("text", "lang").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).repartition("word"), "langid-words")
    table = np.full((len(pieces.pieces) + 1, len(langs)), 1.0 / len(pieces.pieces))
    shared = spark.sparkContext.broadcast(pieces)
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(table)

        def step(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            sums = np.zeros_like(now.value)
            for batch in batches:
                of = np.array(batch.column(0).to_pylist())
                for k, lang in enumerate(langs):
                    mine = np.flatnonzero(of == lang)
                    if len(mine):
                        sums[:, k] += expected(batch.column(1).take(pa.array(mine)).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)[mine].astype(float), shared.value, now.value[:, k : k + 1])
            piece, lang = np.nonzero(sums)
            scaled = np.rint(sums[piece, lang] * SCALE).astype(np.int64)
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(scaled)], names=["piece", "lang", "n"])

        sums = np.zeros_like(table)
        for r in words.mapInArrow(step, "piece int, lang int, n long").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toLocalIterator():
            sums[r["piece"], r["lang"]] = r["n"] / SCALE
        table = np.maximum((sums + 0.01) / (sums.sum(axis=0) + 0.01 * len(sums)), FLOOR)
        table[-1] = np.minimum(table[-1], 1e-5)
    final = spark.sparkContext.broadcast(table)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums by language over its words: uses, letters, log-likelihood, and products of the last two."""
        sums = np.zeros((len(langs), 6))
        for batch in batches:
            of, n = np.array(batch.column(0).to_pylist()), batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            for k, lang in enumerate(langs):
                mine = np.flatnonzero(of == lang)
                if len(mine):
                    words = [w[len(MARK) :] for w in batch.column(1).take(pa.array(mine)).to_pylist()]
                    size = np.array([plain_size(w) for w in words])
                    uses, words, size = n[mine][size > 0], [w for w, m in zip(words, size) if m], size[size > 0]
                    logs = score_words(words, shared.value, final.value[:, k : k + 1])[:, 0]
                    sums[k] += [(uses * x).sum() for x in (np.ones(len(uses)), size, logs, size * size, size * logs, logs * logs)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(langs)), pa.int32()), *(pa.array(c) for c in sums.T)], names=["lang", *"abcdef"])

    usual, around = np.zeros(len(langs)), np.ones(len(langs))
    for r in words.mapInArrow(spread, "lang int, a double, b double, c double, d double, e double, f double").groupBy("lang").agg(*(F.sum(c).alias(c) for c in "abcdef")).collect():
        if r["a"]:
            usual[r["lang"]] = m = r["c"] / r["b"]
            around[r["lang"]] = max((r["f"] - 2 * m * r["e"] + m * m * r["d"]) / r["a"], 1e-6)
    total = sum(sizes.values())
    return Model(langs, np.log([sizes[lang] / total for lang in langs]), pieces, table, usual, around)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``lang_pred``, ``score`` (the posterior, 0 to 1) and ``strange`` to all rows of ``docs``.

    ``strange`` is how much less likely a letter of the text's words of letters is than one of
    ``lang_pred`` usually is, in natural logarithms, less four standard errors for as many
    words; null where there are none.
    Only ``text`` is looked at. A text that is null or has no letter gets ``und``, 0 and null,
    and so does every row if nothing was learnt. Ties go to the language first in the
    alphabet; equal texts get equal results. Columns of these three names are replaced.
    """
    require(docs, ["text"])
    docs = docs.drop("lang_pred", "score", "strange")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, strange double")
    def identify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        letter, index = regex.compile(r"\p{L}").search, _Index()
        scores, plain = np.zeros((0, len(model.langs))), np.zeros(0, np.int64)
        for texts in batches:
            langs, best, strange = [], [], []
            for a in range(0, len(texts), 500):
                held = []
                for t in texts.slice(a, 500).to_pylist():
                    words = t.split() if model.langs and t is not None and letter(t) is not None else None
                    held.append(None if words is None else np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
                if index.new:
                    scores = np.concatenate([scores, score_words(index.new, model.pieces, model.table)])
                    plain = np.concatenate([plain, [plain_size(w) for w in index.new]])
                    index.new = []
                for own in held:
                    if own is None:
                        langs.append(UNKNOWN)
                        best.append(0.0)
                        strange.append(None)
                        continue
                    mine = scores[own]
                    logs = mine.sum(axis=0) + model.priors
                    k = int(logs.argmax())
                    langs.append(model.langs[k])
                    best.append(float(1 / np.exp(logs - logs[k]).sum()))
                    size = plain[own]
                    letters, n = int(size.sum()), int(np.count_nonzero(size))
                    strange.append(float(model.usual[k] - (mine[size > 0, k].sum() + 4 * np.sqrt(model.spread[k] * n)) / letters) if n else None)
                if len(index) > CACHE_WORDS:
                    index, scores, plain = _Index(), scores[:0], plain[:0]
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(best, pa.float64()), pa.array(strange, pa.float64())], names=["lang_pred", "score", "strange"])
        index, scores, plain = None, None, None
        give_back()

    found = docs.withColumn("_found", identify(F.col("text").cast("string")))
    return found.select(*docs.columns, "_found.lang_pred", "_found.score", "_found.strange")


class _Index(dict):
    """Numbers words in order of appearance; ``new`` has those not yet scored."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n
