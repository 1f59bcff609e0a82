"""Language identification by language-bitmask n-gram filters.

Fitting: from a bounded sample of labelled texts (about PER_LANGUAGE texts of a language, CHARS characters of each), the n-grams that are frequent in a language are counted, and its TOP most telling ones are put into a Bloom
filter.  The filters are bit-sliced: a slot has one bit for each language, in words of 64, so one look at HASHES slots, and-ed, returns all
languages that contain an n-gram.

Predicting: over all n-grams of a whole text, the bits of each language are counted (per-language popcounts).  A
filter of known fill answers a foreign n-gram by chance at a known rate r, so a count c of n is corrected to
(c - r n) / (1 - r).  The language with the largest corrected count wins; the score is its share of all
languages' corrected counts.  Ties go to the language that sorts first.

Defined results: a null text, or one without a letter, is `und` with score 0, and so is every text when nothing was
learned; a text whose n-grams no filter knows is the language that sorts first, with score 0.  Labels that are null are not
learned.  Columns lang, source and id take no part in a prediction.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plaitwork.llm.common import whole_text

N = 4
SLOTS = 1 << 18
HASHES = 2
TOP = 4000
PER_LANGUAGE = 400
CHARS = 20_000
#: Languages of a word of a mask, and the most that are learned (more labels are an error, as they can't be languages).
WORD, LANGUAGES = 64, 1024
UNKNOWN = "und"
_BLOCK, _ROWS = 1 << 20, 100_000
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def grams(text: str, n: int = N) -> np.ndarray:
    """64-bit codes of the n-grams of a text: lower case, each run of other characters than letters one space (none at the
    start), and a space before and after all."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter(points)
    points = np.where(letter, points, 32).astype(np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others stands for it
    points = np.concatenate(([np.uint64(32)], points[keep], [np.uint64(32)]))
    if len(points) < n:
        return np.zeros(0, np.uint64)
    code = np.zeros(len(points) - n + 1, np.uint64)
    for k in range(n):
        code = code * np.uint64(0x110000 + 1) + points[k : len(points) - n + 1 + k]
    return code


_LETTERS = np.array([chr(c).isalpha() for c in range(0x3000)])


def _is_letter(points: np.ndarray) -> np.ndarray:
    low = points < len(_LETTERS)
    out = _LETTERS[np.where(low, points, 0)]
    if not low.all():
        far = np.flatnonzero(~low)
        out[far] = [chr(c).isalpha() for c in points[far].tolist()]
    return out


def slots(codes: np.ndarray, size: int = SLOTS, hashes: int = HASHES) -> list[np.ndarray]:
    shift = np.uint64(64 - (size.bit_length() - 1))
    mixed = codes ^ (codes >> np.uint64(29))
    return [((mixed * m) >> shift).astype(np.int64) for m in _MULTIPLIERS[:hashes]]


class Filters:
    """Bit-sliced Bloom filters of up to LANGUAGES languages."""

    def __init__(self, languages: list[str], ngrams: dict[str, np.ndarray], size: int = SLOTS, hashes: int = HASHES):
        if len(languages) > LANGUAGES:
            raise ValueError(f"{LANGUAGES} languages can be told apart, not {len(languages)}")
        self.languages, self.size, self.hashes = languages, size, hashes
        self.tables = np.zeros((-(-len(languages) // WORD), size), np.uint64)
        for number, name in enumerate(languages):
            for at in slots(ngrams[name], size, hashes):
                self.tables[number // WORD][at] |= np.uint64(1 << number % WORD)
        fill = np.array([np.count_nonzero(self.tables[b // WORD] & np.uint64(1 << b % WORD)) / size for b in range(len(languages))])
        self.chance = fill**hashes

    def masks(self, codes: np.ndarray, word: int = 0) -> np.ndarray:
        """For each n-gram, the mask of all languages of a word whose filter has it."""
        first, *others = slots(codes, self.size, self.hashes)
        out = self.tables[word][first]
        for at in others:
            out = out & self.tables[word][at]
        return out

    def counts(self, codes: np.ndarray) -> np.ndarray:
        """For each language, the n-grams that its filter has."""
        out: list[int] = []
        for word in range(len(self.tables)):
            masks = self.masks(codes, word)
            out += [np.count_nonzero(masks & np.uint64(1 << b)) for b in range(min(WORD, len(self.languages) - WORD * word))]
        return np.array(out)

    def predict(self, text: str | None, n: int = N) -> tuple[str, float]:
        if not text or not self.languages:
            return UNKNOWN, 0.0
        counts, total, seen = np.zeros(len(self.languages)), 0, False
        for at in range(0, len(text), _BLOCK):
            block = text[max(0, at - n + 1) : at + _BLOCK]
            seen = seen or any(map(str.isalpha, block[:64])) or any(map(str.isalpha, block))
            codes = grams(block, n)
            counts += self.counts(codes)
            total += len(codes)
        if not seen:
            return UNKNOWN, 0.0
        fair = np.maximum(0.0, (counts - self.chance * total) / (1 - self.chance))
        best = int(np.argmax(fair))
        return self.languages[best], float(fair[best] / fair.sum()) if fair.sum() > 0 else 0.0


def held_out(id_col: str = "doc_id") -> Column:
    """True for the rows that nothing is learned from: crc32 of the id as text is 2 modulo 4."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, top: int = TOP, n: int = N, chars: int = CHARS) -> Filters:
    """Filters learned from about per_language labelled texts of each language, `chars` characters of each at most.

    The sample is the rows whose hash lies below a threshold that follows from the language's row count, so what tasks count is
    bounded by these parameters; the driver gets top n-grams of each of at most LANGUAGES languages.  More labels are an error."""
    labelled = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    # a threshold of the hash for each language from its row count: about per_language rows lie below it
    sizes = {r["lang"]: r["n"] for r in labelled.select(F.col(lang_col).alias("lang")).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} labels in {lang_col}")
    if not sizes:
        return Filters([], {})
    share = F.create_map(*[c for name, size in sizes.items() for c in (F.lit(name), F.lit(min(1.0, per_language / size)))])
    chance = F.xxhash64(F.col(id_col), F.substring(F.col(text_col), 1, 200), F.lit("language"))  # rows without an id differ by text
    below = (F.shiftrightunsigned(chance, 1) / F.lit(float(1 << 63))) < share[F.col(lang_col)]
    sample = labelled.where(below).select(F.col(lang_col).alias("lang"), F.substring(F.col(text_col), 1, chars).alias("text"))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in it:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(np.unique(grams(text, n)).view(np.int64).tolist())
        for lang, counter in found.items():
            every = list(counter.items())
            for at in range(0, len(every), _ROWS):
                some = every[at : at + _ROWS]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array([g for g, _ in some], pa.int64()), pa.array([c for _, c in some], pa.int64())], ["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counted.withColumn("k", F.row_number().over(order)).where(F.col("k") <= top).select("lang", "gram").collect()
    languages = sorted(sizes)
    ngrams = {name: np.array([r["gram"] for r in best if r["lang"] == name], np.int64).view(np.uint64) for name in languages}
    return Filters(languages, ngrams)


def predictions(df: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of df, from its whole text; no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(filters)  # SLOTS words, whatever the data

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in it:
            out = [known.predict(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(batches, "doc_id long, held_out boolean, lang_pred string, score double")


def predicted_column(df: DataFrame, filters: Filters, name: str, text_col: str = "text") -> DataFrame:
    """df with the predicted language of each row in a new column."""
    shared = df.sparkSession.sparkContext.broadcast(filters)

    @F.pandas_udf("string")
    def language(texts):
        return texts.map(lambda t: shared.value.predict(t)[0])

    return df.withColumn(name, language(F.col(text_col)))
