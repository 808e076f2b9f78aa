"""Language ID: language-bitmask n-gram filters.

Training counts the character trigrams of each language (letters in lower case, every
other character a space, a space before and after the text; trigrams with a space in the
middle left out). A trigram belongs to a language if it makes up at least NEAR of the share
there that it has in the language where it is most usual; none is left out for being rare.

The filter is a Bloom filter per language, bit-sliced: slot s holds a word with one bit
for each language, and the AND of the words at a trigram's HASHES slots has the bits of
all languages that contain it. There are at least FILL slots for each trigram, up to MAX_WORDS words in
all (128 MB); with more trigrams than that the filter is fuller, and the correction takes it into account.
For a text, each language's bits are counted over all its
trigrams and corrected by the rate of false positives that the language's filled slots
imply: (hits - n * f) / (1 - f) with f = filled ** HASHES. The greatest count decides;
score is its share of all languages' counts, coverage its share of the text's trigrams.

Only text and lang of the rows of learn are learnt from; prediction reads text alone.

Defined results. Null text, and text without a letter: lang_pred `und`, score 0. Nothing
learnt (no row with both text and lang): `und`, score 0. A text none of whose trigrams is
known: the language with most training trigrams, score 0. Equal counts: the lesser name. An empty table gives an empty
result; repeated rows get a row each; very long texts are read whole, one at a time. More than MAX_LANGUAGES
values of lang are an error. Extra columns of the input are not read and can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from entwine.functions.session import ship, stored
from entwine.llm import kernels as k

N = 3
HASHES, FILL, LEAST_SLOTS, MAX_WORDS, MAX_LANGUAGES = 3, 8, 1 << 16, 1 << 24, 4096
NEAR = 0.25
#: Trigrams of languages that a task holds before it gives them out.
HELD = 300_000
UNKNOWN = "und"


@lru_cache(1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    out = np.zeros(0x110000, bool)
    out[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return out


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, text index, whether each text has a letter) of a piece; a key holds three code points of 21 bits."""
    points, at = k.code_points(data, offsets)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    letter = np.zeros(len(points) + 2 * (len(at) - 1), bool)
    padded = np.full(len(letter), 32, np.uint64)
    place = np.arange(len(points)) + 2 * doc + 1
    is_letter = letters()[points]
    letter[place] = is_letter
    padded[place] = np.where(is_letter, points, 32)
    of = np.repeat(np.arange(len(at) - 1), np.diff(at) + 2)
    if len(padded) < N:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(at) - 1, bool)
    keys = (padded[:-2] << np.uint64(42)) | (padded[1:-1] << np.uint64(21)) | padded[2:]
    keep = letter[1:-1] & (of[:-2] == of[2:])
    has = k.per_doc(is_letter.astype(np.int64), at) > 0
    return keys[keep], of[:-2][keep], has


def slots(keys: np.ndarray, size: int) -> list[np.ndarray]:
    """HASHES of size places (a power of two, at most 2**24) for each key."""
    h = [k.mix(keys, 7), k.mix(keys, 8)]
    return [((h[i // 2] >> np.uint64(32 * (i % 2))) & np.uint64(size - 1)).astype(np.int64) for i in range(HASHES)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n), summed over HELD trigrams of languages or more at a time."""
    names: dict[str, int] = {}
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        of, keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((keys, of))
        of, keys, n = of[order], keys[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])]))
        return of[first], keys[first], np.add.reduceat(n, first)

    def out() -> pa.RecordBatch:
        of, keys, n = parts[0]
        langs = pa.DictionaryArray.from_arrays(pa.array(of.astype(np.int32)), pa.array(list(names), pa.string())).cast(pa.string())
        return pa.RecordBatch.from_arrays([langs, pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    held = 0
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        number = np.array([names.setdefault(x, len(names)) for x in langs.dictionary.to_pylist()], np.int64)
        codes = number[langs.indices.to_numpy(zero_copy_only=False)] if len(number) else np.zeros(0, np.int64)
        for i, j, data, offsets in k.pieces(batch.column("text"), True):
            keys, doc, _ = trigrams(data, offsets)
            if len(keys):
                parts.append((codes[i:j][doc], keys, np.ones(len(keys), np.int64)))
                held += len(keys)
            if held > 4 * HELD:
                parts[:] = [merged()]
                held = len(parts[0][0])
                if held > HELD:
                    yield out()
                    parts.clear()
                    held = 0
    if parts:
        parts[:] = [merged()]
        yield out()


@dataclass
class Filters:
    """langs in order; masks[word, slot] with bit i of word w for language 64 * w + i; usual: the language with most trigrams."""

    langs: list[str]
    usual: int
    masks: np.ndarray

    def __post_init__(self) -> None:
        bits = [(self.masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1) for i in range(len(self.langs))]
        self.false_rate = np.array([float(b.mean()) ** HASHES for b in bits])

    def containing(self, keys: np.ndarray) -> np.ndarray:
        """For each key the words of bits of the languages that contain it."""
        first, *rest = slots(keys, self.masks.shape[1])
        out = self.masks[:, first]
        for s in rest:
            out = out & self.masks[:, s]
        return out

    def counts(self, keys: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        """Corrected counts, one row per text and one column per language."""
        words = self.containing(keys)
        total = np.bincount(doc, minlength=n_docs)
        out = np.zeros((n_docs, len(self.langs)))
        for i, f in enumerate(self.false_rate):
            bit = (words[i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            hits = np.bincount(doc, weights=bit.astype(np.float64), minlength=n_docs)
            out[:, i] = np.maximum(0, (hits - total * f) / max(1e-9, 1 - f))
        return out


def learn(docs: DataFrame) -> Filters | None:
    """Filters from text and lang of every row of docs that has both; None without such rows or without letters."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select("text", F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = stored(rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "lang-grams")
    found = counts.groupBy("lang").agg(F.sum("n").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if not found:
        return None
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    totals = {r["lang"]: r["n"] for r in found}
    langs = sorted(totals)
    number = F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)])
    total = F.create_map(*[F.lit(x) for lang in langs for x in (lang, float(totals[lang]))])
    shares = counts.select(F.try_element_at(number, F.col("lang")).alias("lang"), "gram", (F.col("n") / F.try_element_at(total, F.col("lang"))).alias("share"))
    most = shares.groupBy("gram").agg(F.max("share").alias("most"), F.collect_list(F.struct("lang", "share")).alias("each"))  # a struct a language
    member = stored(most.select("gram", F.explode("each").alias("e"), "most").where(F.col("e.share") >= NEAR * F.col("most")).select("gram", "e.lang"), "lang-members")
    words = (len(langs) + 63) // 64
    size = LEAST_SLOTS
    while size < FILL * member.select("gram").distinct().count() and size * 2 * words <= MAX_WORDS:
        size *= 2

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, bit = batch.column(1).to_numpy().astype(np.int64), np.int64(1)
            for s in slots(batch.column(0).to_numpy().view(np.uint64), size):
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(of // 64), pa.array(bit << (of % 64))], ["slot", "word", "bits"])

    filled = member.mapInArrow(place, "slot long, word long, bits long").groupBy("slot", "word").agg(F.bit_or("bits").alias("bits"))
    masks = np.zeros((words, size), np.uint64)
    table = filled.toArrow()  # at most MAX_WORDS rows
    masks[table["word"].to_numpy(), table["slot"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return Filters(langs, langs.index(max(langs, key=lambda x: (totals[x], x))), masks)


def predict(docs: DataFrame, filters: Filters | None, *keep: Column | str, into: tuple[str, str, str] = ("lang_pred", "score", "coverage")) -> DataFrame:
    """The columns keep of docs with the language, the score and the coverage of the column text, under the names into."""
    spark = docs.sparkSession
    ship(spark)
    kept = docs.select(*keep)
    names = kept.columns
    schema = StructType([*kept.schema.fields, StructField(into[0], StringType()), StructField(into[1], DoubleType()), StructField(into[2], DoubleType())])
    sent, text = spark.sparkContext.broadcast(filters), k.unused(names, "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for i, j, data, offsets in k.pieces(batch.column(len(names)), True):
                keys, doc, has = trigrams(data, offsets)
                best, score, coverage, langs = np.zeros(j - i, int), np.zeros(j - i), np.zeros(j - i), [UNKNOWN]
                if model is not None:
                    counts, langs = model.counts(keys, doc, j - i), model.langs
                    sums, n = counts.sum(1), np.bincount(doc, minlength=j - i)
                    best = np.where(sums > 0, counts.argmax(1), model.usual)
                    score = np.where(has & (sums > 0), counts.max(1) / np.maximum(sums, 1e-12), 0.0)
                    coverage = np.where(has, np.minimum(1.0, counts.max(1) / np.maximum(n, 1)), 0.0)
                pred = [langs[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
                part = batch.slice(i, j - i)
                columns = [part.column(c) for c in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(pred, pa.string()), pa.array(score), pa.array(coverage)], [*names, *into])

    return docs.select(*keep, F.col("text").alias(text)).mapInArrow(run, schema)


def remainder(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, coverage for every row of docs (doc_id, text, lang); learns where held_out is false."""
    held = (remainder(3) == 1).alias("held_out")
    filters = learn(docs.where(remainder(3) != 1))
    return predict(docs, filters, "doc_id", held)
