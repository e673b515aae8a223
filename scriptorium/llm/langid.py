"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MANY_BLOCKS, slices, table_written

#: Orders of the n-grams, and buckets that they are hashed to (a power of 2).
ORDERS, BUCKETS = (1, 2, 3), 1 << 15
#: Languages of one broadcast matrix: with BUCKETS this bounds it to 128 MB; more languages take several, one after the other.
BLOCK_LANGUAGES = 512
SMOOTHING = 0.5
#: Grams whose log-probabilities are gathered at once.
GRAM_STEP = 1 << 16
#: A text is in no learned language if its grams are less likely, by so many nats on average and standard deviations of
#: such an average, than grams of the language are. Grams overlap, so fewer than all count as independent.
STRANGE_NATS, STRANGE_DEVIATIONS, OVERLAP = 2.0, 6.0, 6
_WORD = re.compile(r"[^\W\d_]+")
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    """Whether a text has a character of a letter category; numerals such as a half or a Roman eight are none."""
    return bool(text) and any(c.isalpha() for m in _WORD.finditer(text) for c in m[0])


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Of each code point, whether it is part of a word: letters, and marks on them."""
    return np.fromiter((c.isalpha() or unicodedata.category(c)[0] == "M" for c in map(chr, range(0x110000))), bool, 0x110000)


def grams(texts: list[str], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of all texts' lower-cased character n-grams, an order at a time; whatever is no letter counts as one space, edges too."""
    plain = [f" {t.lower()} " for t in texts]
    code = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(plain), dtype=np.int32), [len(t) for t in plain])
    word = _letters()[code]
    keep = word.copy()
    # of a run of other characters of one text the first stays, as a space
    keep[:1] = True
    keep[1:] |= word[:-1] | (owner[1:] != owner[:-1])
    chars, owner = np.where(word, code, np.uint32(32))[keep].astype(np.uint64), owner[keep]
    shift, sums = np.uint64(64 - (buckets.bit_length() - 1)), None
    for n in ORDERS:
        m = len(chars) - n + 1
        if m < 1:
            break
        own = chars[n - 1 :] * _MULTIPLIERS[n - 1]
        sums = own if sums is None else sums[:m] + own
        whole = owner[:m] == owner[n - 1 :]
        yield owner[:m][whole], ((sums[whole] ^ (sums[whole] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> shift).astype(np.int64)


@dataclass
class Block:
    """Some of the learned languages: log-probabilities of (languages, buckets), log-priors, and the mean and variance of a gram's log-probability in each language."""

    langs: list[str]
    logs: np.ndarray
    priors: np.ndarray
    mean: np.ndarray
    variance: np.ndarray


def fit(labelled: DataFrame, buckets: int = BUCKETS) -> list[Broadcast]:
    """Learn from all of ``labelled(text, lang)``: broadcast ``Block``s of languages in order.

    Rows without a language or a letter are left out.  Counts are added up in
    tasks and then by bucket; the driver gets one row for each language of a
    block, and the languages' names.
    """
    spark = labelled.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for part in slices(batches):
            by: dict[str, list[str]] = {}
            for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if lang is not None and has_letter(text):
                    by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                own = held.setdefault(lang, np.zeros(buckets + 1, np.int64))
                own[-1] += len(texts)
                for _, at in grams(texts, buckets):
                    own[:-1] += np.bincount(at, minlength=buckets)
            if len(held) > BLOCK_LANGUAGES:
                yield from out(held)
                held = {}
        yield from out(held)

    def out(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, own in held.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], ["lang", "bucket", "n"])

    parts = labelled.select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(count, "lang string, bucket int, n long")
    sums = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = sums.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts"), F.sum(F.when(F.col("bucket") == buckets, F.col("n"))).alias("docs"))
    rows = table_written(rows.select("lang", "docs", F.col("counts.bucket").alias("b"), F.col("counts.n").alias("n")), "languages")
    known = sorted(rows.select("lang", "docs").collect())
    total = sum(docs for _, docs in known)
    blocks = []
    for at in range(0, len(known), BLOCK_LANGUAGES):
        langs = [lang for lang, _ in known[at : at + BLOCK_LANGUAGES]]
        found = rows.filter(F.col("lang").isin(langs)).toArrow()
        counts = np.full((buckets + 1, len(langs)), SMOOTHING)
        for lang, b, n in zip(found["lang"].to_pylist(), found["b"], found["n"]):
            counts[b.values.to_numpy(), langs.index(lang)] += n.values.to_numpy()
        p = counts[:-1] / counts[:-1].sum(0)
        logs = np.log(p)
        mean = (p * logs).sum(0)
        priors = np.log([docs / total for _, docs in known[at : at + BLOCK_LANGUAGES]])
        blocks.append(spark.sparkContext.broadcast(Block(langs, np.ascontiguousarray(logs.T), priors, mean, (p * logs**2).sum(0) - mean**2)))
    return blocks


def scores(texts: list[str], block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods, (texts, languages), of texts with a letter, and how many grams each has."""
    out, sizes = np.zeros((len(block.langs), len(texts))), np.zeros(len(texts), np.int64)
    for owner, bucket in grams(texts, block.logs.shape[1]):
        sizes += np.bincount(owner, minlength=len(texts))
        for at in range(0, len(owner), GRAM_STEP):
            own, places = owner[at : at + GRAM_STEP], bucket[at : at + GRAM_STEP]
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            for k, logs in enumerate(block.logs):
                out[k, own[starts]] += np.add.reduceat(logs[places], starts)
    return out.T, sizes


def predict(texts: list[str | None], blocks: list[Broadcast]) -> list[tuple[str, float, bool]]:
    """The likeliest language of each text, its posterior, and whether the text is strange to that language."""
    result = [(UNKNOWN, 0.0, True)] * len(texts)
    known = [i for i, t in enumerate(texts) if has_letter(t)]
    if not known or not blocks:
        return result
    own = [texts[i] for i in known]
    best, total = np.full(len(own), -np.inf), np.full(len(own), -np.inf)
    name, strange = np.empty(len(own), object), np.zeros(len(own), bool)
    for model in blocks:
        block = model.value
        if len(blocks) > 1:
            model.__dict__.pop("_value", None)  # a worker holds one block; the next use reads it from its disk again
        likely, sizes = scores(own, block)
        joint = likely + block.priors
        at = joint.argmax(1)
        top = joint[np.arange(len(own)), at]
        total = np.logaddexp(total, top + np.log(np.exp(np.maximum(joint - top[:, None], -700)).sum(1)))
        ahead = top > best
        gap = block.mean[at] - likely[np.arange(len(own)), at] / sizes
        far = gap > STRANGE_NATS + STRANGE_DEVIATIONS * np.sqrt(block.variance[at] * OVERLAP / sizes)
        best[ahead], strange[ahead] = top[ahead], far[ahead]
        name[ahead] = [block.langs[i] for i in at[ahead]]
    for i, lang, score, far in zip(known, name, np.exp(best - total), strange):
        result[i] = (lang, float(min(score, 1.0)), bool(far))
    return result


def identify(docs: DataFrame, blocks: list[Broadcast]) -> DataFrame:
    """Add ``lang_pred string``, ``score double`` and ``strange boolean`` to ``docs(.., text, ..)``; columns of these names are replaced.

    ``und`` with score 0, and strange, if the text is null or has no letter, or
    nothing was learned.  Ties go to the first language in order.  Texts are
    scored whole, some at a time; rows stay as they are.
    """
    docs = docs.drop("lang_pred", "score", "strange")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, *(MANY_BLOCKS if len(blocks) > 1 else ())):
            got = predict(part.column(at).to_pylist(), blocks)
            new = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, "lang_pred", "score", "strange"])

    more = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("strange", T.BooleanType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))


def held_out(doc_id: str = "doc_id"):
    """Whether a document is in the fifth that nothing is learned from; a null id is."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def language_of(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, lang)`` -> ``doc_id, held_out, lang_pred, score``, a row for each row.

    Learns from text and non-null lang of the documents that aren't held out,
    all of them; predicts from the text alone.  A null doc_id is held out;
    other columns are ignored; an empty table gives an empty one.
    """
    blocks = fit(docs.filter(~held_out() & F.col("lang").isNotNull()))
    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return identify(rows, blocks).select("doc_id", "held_out", "lang_pred", "score")


def known_language(docs: DataFrame) -> DataFrame:
    """The rows and columns of ``docs(doc_id, text, lang, ..)`` whose text is in a learned language; ``lang`` is the predicted one.

    Null texts and texts without a letter go, and texts strange to their
    likeliest language: those in other languages, and noise.  Where nothing was
    learned, nothing can be judged, and every text with a letter stays as it is.
    """
    blocks = fit(docs.filter(~held_out() & F.col("lang").isNotNull()))
    at, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, *(MANY_BLOCKS if len(blocks) > 1 else ())):
            texts = part.column(at).to_pylist()
            if not blocks:
                yield part.filter(pa.array([has_letter(t) for t in texts], pa.bool_()))
                continue
            got = predict(texts, blocks)
            named = part.set_column(lang, part.schema.field(lang), pa.array([x for x, _, _ in got], part.schema.field(lang).type))
            yield named.filter(pa.array([x != UNKNOWN and not far for x, _, far in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
