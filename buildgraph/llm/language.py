"""Language identification by error-correcting output codes.

Every language has a codeword.  For each bit, a binary classifier over hashed byte
trigrams tells the languages with a one from those with a zero.  Decoding adds the
logistic loss of each bit's margin, weighted by how well the bit separates, and takes the
codeword of least loss; a small lead over the second marks the text as ambiguous.

Training counts trigrams of all learnable rows with one distributed aggregate of
(language, bucket) sums; its size is bounded by languages times buckets.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildgraph.llm.arrow_words import chunks, lower_table

BUCKET_BITS = 14
#: All dichotomies up to so many languages; beyond, random codewords.
EXHAUSTIVE = 7
SMOOTHING = 0.5
#: Nats of mean log ratio per trigram that make a margin of one.
MARGIN = 0.3
#: Bytes of a long text that are scored at once.
PIECE = 1 << 18
#: A best score below this marks ambiguity.
CLEAR = 0.6


def letter_table() -> np.ndarray:
    """ASCII letters in lower case and bytes beyond ASCII stay; all else becomes a space."""
    table = lower_table()
    table[:0x61] = np.where((table[:0x61] >= 0x61) & (table[:0x61] <= 0x7A), table[:0x61], 0x20)
    table[0x7B:0x80] = 0x20
    return table


def trigram_buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of the trigram that starts at each byte but the last two."""
    d = letter_table()[data].astype(np.uint32)
    packed = (d[:-2] << 16) | (d[1:-1] << 8) | d[2:]
    return ((packed * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def trigram_counts(rows: DataFrame) -> DataFrame:
    """(lang, bucket, n) of ``rows`` (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, np.ndarray] = {}
            langs = batch.column(0).to_pylist()
            for lo, hi, data, offsets in chunks(batch.column(1)):
                if len(data) < 3:
                    continue
                buckets = trigram_buckets(data)
                for row in range(hi - lo):
                    own = buckets[offsets[row] : max(offsets[row + 1] - 2, offsets[row])]
                    if langs[lo + row] not in sums:
                        sums[langs[lo + row]] = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
                    sums[langs[lo + row]] += np.bincount(own, minlength=1 << BUCKET_BITS)
            for lang, n in sums.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

    counted = rows.select("lang", "text").mapInArrow(run, "lang string, bucket long, n long")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def codebook(languages: int) -> np.ndarray:
    """Codewords of +1 and -1, one row per language.

    Random codewords are drawn again until any two differ in a quarter of the bits and every bit tells some
    languages apart.
    """
    if languages <= EXHAUSTIVE:
        bits = range(1, 1 << (languages - 1)) if languages > 1 else range(1)
        return np.array([[1 if (b << 1) >> lang & 1 else -1 for b in bits] for lang in range(languages)], dtype=np.int8)
    width = 15 * int(np.ceil(np.log2(languages)))
    rng = np.random.default_rng(11)
    while True:
        codes = rng.choice(np.array([-1, 1], dtype=np.int8), (languages, width))
        alike = codes.astype(np.int32) @ codes.T - 2 * width * np.eye(languages, dtype=np.int32)
        if alike.max() <= width / 2 and (abs(codes.sum(axis=0)) < languages).all():
            return codes


@dataclass
class LanguageModel:
    """Languages, codewords, log-ratio weights by bucket and bit, and bit weights."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    trust: np.ndarray


def train(rows: DataFrame) -> LanguageModel:
    """Fit on ``rows`` (lang, text); rows without a language or text are ignored."""
    table = trigram_counts(rows.where("lang is not null and text is not null")).toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    if not langs:
        return LanguageModel([], np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0))
    counts = np.zeros((len(langs), 1 << BUCKET_BITS))
    index = {x: i for i, x in enumerate(langs)}
    counts[[index[x] for x in table.column("lang").to_pylist()], table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    shares = (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=1, keepdims=True)
    codes = codebook(len(langs))
    weights = np.zeros((1 << BUCKET_BITS, codes.shape[1]), dtype=np.float32)
    trust = np.ones(codes.shape[1])
    for bit in range(codes.shape[1]):
        ones, zeros = codes[:, bit] > 0, codes[:, bit] < 0
        if ones.any() and zeros.any():
            weights[:, bit] = np.log(shares[ones].mean(axis=0)) - np.log(shares[zeros].mean(axis=0))
            expected = shares @ weights[:, bit]  # the mean margin of each language's own text
            trust[bit] = max(float((expected * codes[:, bit]).min()), 0.01)
    return LanguageModel(langs, codes, weights, trust / trust.mean())


def decode(model: LanguageModel, margins: np.ndarray) -> tuple[int, float]:
    """(language, score) of the codeword with the least weighted loss."""
    losses = (np.logaddexp(0.0, -model.codes * margins) * model.trust).sum(axis=1)
    chances = np.exp(losses.min() - losses)
    best = int(np.argmin(losses))
    return best, float(chances[best] / chances.sum())


def has_letter(data: np.ndarray) -> bool:
    """Whether a text has a letter: an ASCII one, or any other by Unicode's definition."""
    if ((data >= 0x61) & (data <= 0x7A) | (data >= 0x41) & (data <= 0x5A)).any():
        return True
    if not (data >= 0x80).any():
        return False
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    return any(c.isalpha() for at in range(0, len(data), PIECE) for c in decoder.decode(data[at : at + PIECE].tobytes()))


def mean_margins(model: LanguageModel, data: np.ndarray) -> np.ndarray:
    """The mean weight of the trigrams of one text, taken piece by piece, so that a long text needs no more memory."""
    total, n = np.zeros(model.codes.shape[1]), max(len(data) - 2, 0)
    for at in range(0, n, PIECE):
        total += model.weights[trigram_buckets(data[at : min(at + PIECE, n) + 2])].sum(axis=0, dtype=np.float64)
    return total / max(n, 1) / MARGIN


def predictions(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous.

    Null texts, texts without a letter, and all texts if nothing was learned, are ``und`` with
    score 0.  Texts of fewer than three bytes have no trigram: the first language, scored by chance.
    A long text is read whole, in pieces.  Repeated rows get equal predictions.  Columns of ``docs`` named like the
    three added ones are replaced; others, whatever their names, pass through.
    """
    docs = docs.drop("lang_pred", "score", "ambiguous")
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous")).schema
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for lo, hi, data, offsets in chunks(batch.column(place)):
                short = len(data) <= 4 * PIECE
                buckets = trigram_buckets(data) if short and len(data) > 2 else np.zeros(0, np.int64)
                for row in range(hi - lo):
                    a, b = offsets[row], offsets[row + 1]
                    if not model.languages or not has_letter(data[a:b]):
                        names.append("und")
                        scores.append(0.0)
                        continue
                    if short:
                        own = model.weights[buckets[a : max(b - 2, a)]]
                        margins = own.mean(axis=0, dtype=np.float64) / MARGIN if len(own) else np.zeros(model.codes.shape[1])
                    else:
                        margins = mean_margins(model, data[a:b])
                    best, score = decode(model, margins)
                    names.append(model.languages[best])
                    scores.append(score)
            arrays = [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array([s < CLEAR for s in scores], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training; a null id is not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def op6(docs: DataFrame) -> DataFrame:
    """The contract's digest columns, and the ambiguity mark."""
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = train(rows.where("not held_out"))
    return predictions(rows.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
