"""Language identification by unigram pieces, summed over all segmentations.

Every language has a probability for each piece of a fixed public vocabulary and for each single byte. A word's probability is the sum
over all ways to cut it into pieces, found by a forward pass; a text's is the product over its words. The probabilities are
fitted by expectation maximisation (forward and backward over distinct words of the training texts).

Training texts are a fraction of each language's, by hash of the id, of ``SAMPLE`` texts on average. Their distinct words with counts stay
in a table; each round reads it in parallel and returns expected counts, as many numbers as pieces times languages. Prediction is
one pass over the texts; a task works out each distinct word once, many words side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailspark.llm.common import BASE, NOT_BLANK, SPREAD, mixed, remainder, split_words, stored, text_blocks

SAMPLE = 1_000
ROUNDS = 3
LONGEST = 16
ADDED = 0.05
WORDS_AT_ONCE = 20_000
MARK = "▁"


def piece_keys(model_path: str) -> np.ndarray:
    """Sorted distinct hashes of the vocabulary's pieces of at most LONGEST bytes, a word's beginning marked by a blank, and of all bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = {bytes([b]) for b in range(256)}
    for k in range(model.get_piece_size()):
        if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)):
            pieces.add(model.id_to_piece(k).translate(LOWER_CASE).replace(MARK, " ").encode())
    data = [p for p in pieces if 0 < len(p) <= LONGEST]
    return np.unique(np.array([span_hash(np.frombuffer(p, dtype=np.uint8)[None, :])[0] for p in data], dtype=np.uint64))


LOWER_CASE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def span_hash(rows: np.ndarray) -> np.ndarray:
    """Hash of each row of bytes."""
    total = np.zeros(len(rows), dtype=np.uint64)
    for k in range(rows.shape[1]):
        total = total * BASE + SPREAD[rows[:, k]]
    return mixed(total + np.uint64(rows.shape[1]))


class Lookup:
    """Piece number of a hash, -1 for none, by open addressing in a table four times as large as the vocabulary."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = int(np.ceil(np.log2(max(16, 4 * len(keys)))))
        self.size = 1 << self.bits
        self.held = np.zeros(self.size, dtype=np.uint64)
        self.number = np.full(self.size, -1, dtype=np.int32)
        self.most = 1
        for k, h in enumerate(keys.tolist()):
            at, tries = h & (self.size - 1), 1
            while self.number[at] >= 0:
                at, tries = (at + 1) & (self.size - 1), tries + 1
            self.held[at], self.number[at] = h, k
            self.most = max(self.most, tries)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes & np.uint64(self.size - 1)).astype(np.int64)
        out = np.where(self.held[at] == hashes, self.number[at], -1)
        left = np.flatnonzero((out < 0) & (self.number[at] >= 0))
        for step in range(1, self.most):
            if not len(left):
                break
            slot = (at[left] + step) & (self.size - 1)
            same = self.held[slot] == hashes[left]
            out[left[same]] = self.number[slot[same]]
            left = left[~same & (self.number[slot] >= 0)]
        return out


def lattice(words: list[bytes], lookup: Lookup) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, pieces): for the words, longest first, pieces[size - 1][j] has the piece of ``size`` bytes that ends at byte j, or -1."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    width = int(lengths[0])
    grid = np.zeros((len(words), width), dtype=np.uint8)
    flat = np.frombuffer(b"".join(words), dtype=np.uint8)
    grid[np.arange(width)[None, :] < lengths[:, None]] = flat
    spread = SPREAD[grid]
    pieces = np.full((LONGEST, width, len(words)), -1, dtype=np.int32)
    rolling = np.zeros((len(words), width), dtype=np.uint64)
    for size in range(1, min(LONGEST, width) + 1):
        # hash of the span of this size that begins at each byte
        rolling = rolling[:, : width - size + 1] * BASE + spread[:, size - 1 :]
        inside = np.arange(size - 1, width)[None, :] < lengths[:, None]
        found = np.full(inside.shape, -1, dtype=np.int32)
        found[inside] = lookup.of(mixed(rolling[inside] + np.uint64(size)))
        pieces[size - 1, size - 1 :] = found.T
    return lengths, pieces


@dataclass
class Model:
    """chance: piece probabilities of each language, one row per piece and a last row of zeros; prior: log share of texts."""

    langs: list[str]
    keys: np.ndarray
    chance: np.ndarray
    prior: np.ndarray


def forward(lengths: np.ndarray, pieces: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log probability per word and language, forward values, log of the scale of each) of words sorted longest first."""
    n, langs = len(lengths), chance.shape[1]
    width = int(lengths[0])
    value = np.zeros((width + 1, n, langs))
    value[0] = 1
    scale = np.zeros((n, langs))
    result = np.zeros((n, langs))
    kept, scales = value.copy(), np.zeros((width + 1, n, langs))
    for j in range(1, width + 1):
        active = int(np.searchsorted(-lengths, -j, side="right"))
        total = np.zeros((active, langs))
        for size in range(1, min(j, LONGEST) + 1):
            piece = pieces[size - 1, j - 1, :active]
            some = np.flatnonzero(piece >= 0)
            if len(some):
                total[some] += value[j - size, some] * chance[piece[some]]
        value[j, :active] = total
        if j % 8 == 0:
            # the last values are divided by the newest, so that long words don't vanish
            low = max(0, j - LONGEST + 1)
            value[low : j + 1, :active] /= total
            scale[:active] += np.log(total)
        kept[j, :active], scales[j, :active] = value[j, :active], scale[:active]
        done = np.flatnonzero(lengths[:active] == j)
        result[done] = np.log(value[j, done]) + scale[done]
    return result, kept, scales


def word_scores(words: list[bytes], lookup: Lookup, chance: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language."""
    order = sorted(range(len(words)), key=lambda k: -len(words[k]))
    out = np.zeros((len(words), chance.shape[1]))
    first = 0
    while first < len(order):
        # long words take fewer at once, so that a group's tables stay of one size
        most = max(1, min(WORDS_AT_ONCE, 400_000 // len(words[order[first]])))
        some = order[first : first + most]
        lengths, pieces = lattice([words[k] for k in some], lookup)
        out[some] = forward(lengths, pieces, chance)[0]
        first += most
    return out


def marked_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(text of each word, number of its distinct word, the distinct words with a blank before)."""
    words = split_words(data, bounds, NOT_BLANK)
    hashes = words.hashes(words.start, words.end)
    _, place, which = np.unique(hashes, return_index=True, return_inverse=True)
    raw = words.data.tobytes()
    return words.doc, which, [b" " + raw[words.start[k] : words.end[k]] for k in place]


def has_letter(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether each text has a letter: ASCII letters by byte, others by Unicode category."""
    ascii_letter = np.zeros(256, dtype=np.int64)
    ascii_letter[[*range(65, 91), *range(97, 123)]] = 1
    total = np.concatenate([[0], np.cumsum(ascii_letter[data])])
    found = total[bounds[1:]] > total[bounds[:-1]]
    for k in np.flatnonzero(~found):
        found[k] = any(c.isalpha() for c in data[bounds[k] : bounds[k + 1]].tobytes().decode("utf-8"))
    return found


def predict_task(model: Model) -> Callable:
    """(doc_id, held_out, lang_pred, score) of rows (doc_id, held_out, text)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, known = Lookup(model.keys), {}
        for batch in batches:
            for first, rows, data, bounds in text_blocks(batch.column(2)):
                doc, which, words = marked_words(data, bounds)
                missing = [w for w in words if w not in known]
                if len(known) + len(missing) > 400_000:
                    known.clear()
                    missing = words
                known.update(zip(missing, word_scores(missing, lookup, model.chance)))
                each = np.array([known[w] for w in words]).reshape(len(words), len(model.langs))
                total = np.tile(model.prior, (rows, 1))
                for k in range(len(model.langs)):
                    total[:, k] += np.bincount(doc, weights=each[which, k], minlength=rows)
                letters = has_letter(data, bounds)
                if model.langs:
                    best = total.argmax(axis=1)
                    share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                    names = [model.langs[b] if ok else "und" for b, ok in zip(best, letters)]
                    share = np.where(letters, share, 0.0)
                else:
                    names, share = ["und"] * rows, np.zeros(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, rows), batch.column(1).slice(first, rows), pa.array(names, pa.string()), pa.array(share)],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    return task


# --- training


def words_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of rows (lang, text), counted within a block."""
    for batch in batches:
        for first, rows, data, bounds in text_blocks(batch.column(1)):
            lang = np.asarray(batch.column(0).slice(first, rows).to_pylist(), dtype=object)
            doc, which, words = marked_words(data, bounds)
            for name in sorted(set(lang.tolist())):
                n = np.bincount(which[lang[doc] == name], minlength=len(words))
                found = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array([words[k] for k in found], pa.binary()), pa.array(n[found])], names=["lang", "word", "n"])


def expected_task(model: Model) -> Callable:
    """(piece, lang_no, n): expected piece counts over rows (word, counts) of one task; counts has one number per language."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, langs = Lookup(model.keys), len(model.langs)
        total = np.zeros((len(model.keys) + 1, langs))
        for batch in batches:
            words = [bytes(w) for w in batch.column(0).to_pylist()]
            counts = np.array(batch.column(1).to_pylist(), dtype=float).reshape(-1, langs)
            order = sorted(range(len(words)), key=lambda k: -len(words[k]))
            first = 0
            while first < len(order):
                most = max(1, min(WORDS_AT_ONCE, 400_000 // len(words[order[first]])))
                some = order[first : first + most]
                lengths, pieces = lattice([words[k] for k in some], lookup)
                _add_expected(total, lengths, pieces, model.chance, counts[some])
                first += most
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(total[piece, lang])], names=["piece", "lang_no", "n"])

    return task


def _add_expected(total: np.ndarray, lengths: np.ndarray, pieces: np.ndarray, chance: np.ndarray, counts: np.ndarray) -> None:
    """Share each word's counts among its pieces, going back from its end in proportion to the forward values."""
    _, value, scales = forward(lengths, pieces, chance)
    width = int(lengths[0])
    owed = np.zeros((width + 1, len(lengths), chance.shape[1]))
    owed[lengths, np.arange(len(lengths))] = counts
    for j in range(width, 0, -1):
        active = int(np.searchsorted(-lengths, -j, side="right"))
        for size in range(1, min(j, LONGEST) + 1):
            piece = pieces[size - 1, j - 1, :active]
            some = np.flatnonzero(piece >= 0)
            if not len(some):
                continue
            # the value where the piece begins is brought to the scale of that where it ends
            rise = np.exp(scales[j - size, some] - scales[j, some])
            part = owed[j, some] * value[j - size, some] * chance[piece[some]] * rise / value[j, some]
            owed[j - size, some] += part
            for k in range(chance.shape[1]):
                total[:, k] += np.bincount(piece[some], weights=part[:, k], minlength=len(total))


def train(spark: SparkSession, docs: DataFrame, model_path: str, sample: int = SAMPLE) -> Model:
    """Fitted on rows of ``docs`` with text and lang whose crc32(doc_id) mod 5 is not 0, about ``sample`` of each language."""
    usable = docs.filter((remainder(F.col("doc_id"), 5) != 0) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {row["lang"]: row["n"] for row in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()}
    langs = sorted(sizes)
    keys = piece_keys(model_path)
    if not langs:
        return Model([], keys, np.zeros((len(keys) + 1, 0)), np.zeros(0))
    # a fraction by hash keeps the expected number; it is picked before any ranking, so no language is gathered in one task
    share = F.lit(1.0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, sample / n))).otherwise(share)
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)).select("lang", "text")
    counted = chosen.mapInArrow(words_task, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    wide = counted.groupBy("word").agg(*(F.sum(F.when(F.col("lang") == name, F.col("n")).otherwise(0)).cast("double").alias(f"n{k}") for k, name in enumerate(langs)))
    table = stored(spark, wide.select("word", F.array(*(F.col(f"n{k}") for k in range(len(langs)))).alias("counts")), "language-words")
    rows = np.array([sizes[name] for name in langs], dtype=float)
    chance = np.full((len(keys) + 1, len(langs)), 1.0 / len(keys))
    chance[-1] = 0
    model = Model(langs, keys, chance, np.log(rows / rows.sum()))
    for _ in range(ROUNDS):
        counts = table.mapInArrow(expected_task(model), "piece bigint, lang_no bigint, n double").groupBy("piece", "lang_no").agg(F.sum("n").alias("n")).toPandas()
        fresh = np.full((len(keys) + 1, len(langs)), ADDED)
        np.add.at(fresh, (counts["piece"].to_numpy(), counts["lang_no"].to_numpy()), counts["n"].to_numpy())
        fresh[-1] = 0
        model = Model(langs, keys, fresh / fresh.sum(axis=0), model.prior)
    return model


def languages(spark: SparkSession, docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs`` (doc_id, text, lang).

    Predictions use the text alone. ``und`` with score 0: null text, no letter, or nothing to learn from. Repeated rows are scored alike; null
    ids and languages are allowed (rows without language aren't learnt from). An empty table gives no rows.
    """
    model = train(spark, docs, model_path)
    rows = docs.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(predict_task(model), f"doc_id {id_type}, held_out boolean, lang_pred string, score double")
