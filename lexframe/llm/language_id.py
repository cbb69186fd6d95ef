"""Language identification with n-gram filters that answer with language bitmasks.

Learning counts the character trigrams of every labelled text by language. A language's trigrams are those with at
least ``min_share`` of all its trigrams, so at most ``1 / min_share`` of them, whatever the size of the corpus.
All languages share one bit-sliced Bloom filter: a slot holds one bit per language, a trigram sets its
language's bit in ``HASHES`` slots, and the conjunction of a trigram's slots is the mask of all languages
that hold it. A text is decided by counting, per language, the trigrams whose mask has its bit. A false
positive adds to every language by that language's own filled share, which is known, so counts are
corrected by it before they are compared.

How much of an unseen text a language's trigrams cover depends on its script and on how much of it was learned: of a
script with thousands of characters far less than of an alphabet. That reach is estimated per language from
the learning counts, leaving one occurrence out at a time (a trigram that is held only through the occurrence itself
covers nothing), and shares are taken relative to it, but to no less than ``MIN_REACH``.

Trigrams are taken from words of letters, lower-cased, with one blank on either side.

Defined results: ``und`` with score 0 for a null text or one without a letter; a text with letters whose trigrams no
language holds gets the language with most learning text, score 0; ties go to the language earlier in
code point order; with nothing to learn from every text is ``und``; null languages teach nothing; repeated
rows count as often as they appear. Added columns replace input columns of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.llm.common import add_columns, held_out

MIN_SHARE = 2e-5
MIN_REACH = 0.05
HASHES = 3
SLOTS_PER_ENTRY = 16
UNDECIDED = "und"
_PIECE = 1 << 19
_KEEP = 1 << 20
_NO_LETTER = re.compile(r"[\W\d_]+")
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)]


def letters(text: bytes | None) -> str:
    """Lower-cased words of letters between single blanks; empty without a letter."""
    plain = _NO_LETTER.sub(" ", text.decode("utf-8", "replace")).strip().lower() if text else ""
    return f" {plain} " if any(map(str.isalpha, plain)) else ""  # numerals such as ² are no letters


def trigrams(plain: str) -> Iterator[np.ndarray]:
    """Code point trigrams packed into 63 bits, a long text in pieces."""
    for at in range(0, max(0, len(plain) - 2), _PIECE):
        points = np.frombuffer(
            plain[at:at + _PIECE + 2].encode("utf-32-le", "surrogatepass"), np.uint32
        ).astype(np.uint64)
        yield points[:-2] << np.uint64(42) | points[1:-1] << np.uint64(21) | points[2:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, gram, n), summed as far as memory allows."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    fresh: dict[str, list[np.ndarray]] = {}

    def fold(lang):
        grams, n = np.unique(np.concatenate(fresh.pop(lang)), return_counts=True)
        if lang in held:
            grams = np.r_[held[lang][0], grams]
            grams, where = np.unique(grams, return_inverse=True)
            n = np.bincount(where, np.r_[held[lang][1], n]).astype(np.int64)
        held[lang] = grams, n

    def rows():
        for lang, (grams, n) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams)), pa.array(grams.view(np.int64)), pa.array(n, pa.int64())],
                names=["lang", "gram", "n"],
            )

    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for grams in trigrams(letters(text)):
                fresh.setdefault(lang, []).append(grams)
                size += len(grams)
                if size > _KEEP:
                    for name in list(fresh):
                        fold(name)
                    size = 0
        if sum(len(g) for g, _ in held.values()) > _KEEP:
            yield from rows()
            held.clear()
    for name in list(fresh):
        fold(name)
    yield from rows()


@dataclass
class LanguageFilter:
    """Slots by words of 64 languages, with what is needed to correct their counts."""

    languages: list[str]
    slots: np.ndarray  # (number of slots, words of 64 languages)
    false_positive: np.ndarray  # per language
    default: int
    reach: np.ndarray  # per language, share of an unseen text's trigrams it is expected to hold

    def _places(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        size = np.uint64(len(self.slots))
        for mix in _MIX[:HASHES]:
            x = (grams ^ (grams >> np.uint64(31))) * mix
            x = (x ^ (x >> np.uint64(29))) * _MIX[0]
            yield ((x ^ (x >> np.uint64(32))) % size).astype(np.int64)

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """All languages that hold each trigram, as bits."""
        out = None
        for place in self._places(grams):
            found = self.slots[place]
            out = found if out is None else out & found
        return out

    def decide(self, text: bytes | None) -> tuple[str, float]:
        plain = letters(text)
        if not plain or not self.languages:
            return UNDECIDED, 0.0
        hits, total = np.zeros(len(self.languages)), 0
        for grams in trigrams(plain):
            total += len(grams)
            masks = self.masks(grams)
            hits += [
                np.count_nonzero(masks[:, k >> 6] & np.uint64(1 << (k & 63))) for k in range(len(self.languages))
            ]
        share = (hits / total - self.false_positive) / (1 - self.false_positive) / self.reach
        best = int(np.argmax(share))
        if share[best] <= 0:
            return self.languages[self.default], 0.0
        return self.languages[best], float(min(1.0, share[best]))


def build_filter(
    grams: list[tuple[str, int, int]], sizes: dict[str, int], reach: dict[str, float] | None = None
) -> LanguageFilter:
    """From (lang, gram, n) rows, the number of learning trigrams by language, and the reach of each (else 1)."""
    languages = sorted(sizes)
    number = {lang: k for k, lang in enumerate(languages)}
    slots = np.zeros((max(64, SLOTS_PER_ENTRY * max(1, len(grams))), max(1, -(-len(languages) // 64))), np.uint64)
    reaches = np.array([1.0 if reach is None else max(MIN_REACH, reach.get(lang, 0.0)) for lang in languages])
    made = LanguageFilter(languages, slots, np.zeros(len(languages)), 0, reaches)
    by_language: dict[int, list[int]] = {}
    for lang, gram, _ in grams:
        by_language.setdefault(number[lang], []).append(gram)
    for k, own in by_language.items():
        for place in made._places(np.array(own, np.int64).view(np.uint64)):
            slots[place, k >> 6] |= np.uint64(1 << (k & 63))
    for k in range(len(languages)):
        filled = np.count_nonzero(slots[:, k >> 6] & np.uint64(1 << (k & 63))) / len(slots)
        made.false_positive[k] = filled ** HASHES
    if languages:
        made.default = max(range(len(languages)), key=lambda k: (sizes[languages[k]], -k))
    return made


def learn(
    docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", min_share: float = MIN_SHARE
) -> LanguageFilter:
    """The filter of all labelled rows outside the held-out third. Counting is spread over the rows; what comes
    to the driver is at most ``1 / min_share`` trigrams per language."""
    taught = docs.where(F.col(lang).isNotNull() & ~held_out(F.col(doc_id))).select(
        F.col(lang).alias("lang"), F.col(text).cast("binary").alias("text")
    )
    counted = taught.mapInArrow(_count, "lang string, gram bigint, n bigint")
    sums = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    from lexframe.session import pin

    sums = pin(sums, "language-grams")
    sizes = sums.groupBy("lang").agg(F.sum("n").alias("total"))
    least = F.greatest(F.lit(1.0), F.col("total") * min_share)
    common = sums.join(sizes, "lang").where(F.col("n") >= least)
    covered = common.where(F.col("n") - 1 >= least).groupBy("lang").agg(F.sum(F.col("n") / F.col("total")).alias("reach"))
    return build_filter(
        [(r["lang"], r["gram"], r["n"]) for r in common.select("lang", "gram", "n").collect()],
        {r["lang"]: r["total"] for r in sizes.collect()},
        {r["lang"]: r["reach"] for r in covered.collect()},
    )


def identify(docs: DataFrame, model: LanguageFilter, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the corrected share of trigrams the language holds, relative to its reach."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        decide = shared.value.decide
        return lambda texts: list(zip(*map(decide, texts))) or [[], []]

    return add_columns(docs, [text], "lang_pred string, score double", make)
