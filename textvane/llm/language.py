"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A letter n-gram is the product of its letters'
vectors, each rotated by its place (binding); a text is the sum of its n-grams (bundling); a
language is the sum of its learning texts.  A text is given the language of largest cosine.
The prototypes' common part is taken out before comparing, so that n-grams which all languages
share do not decide.

Text is lower-cased; runs of other characters count as one space, also at both ends.  The score is
the cosine, cut to 0..1.  Texts that are null or have no letter are ``und`` with score 0, as is
every text when nothing was learnt.  Ties go to the first language in sorted order.  Repeated
rows are learnt as often as they stand and predicted each; empty tables give no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from textvane.llm.common import columns_as, under_plain_names

DIMENSIONS = 1024
GRAM = 3
MERGE_WIDTH = 64
CACHED_GRAMS = 30_000
BLOCK = 1024
JOINED_CHARS = 1 << 19
POINT_BITS = 21
BREAK = "\ud800"  # between texts that are counted together; no text holds a surrogate
BROKEN = 1
#: Four standard deviations of the cosine of unrelated texts; below it nothing is known of the language.
LEAST_COSINE = 4 / DIMENSIONS**0.5


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> itself if it is a letter, else the space; the break stays apart."""
    table = np.full(sys.maxunicode + 1, 32, np.uint64)
    table[ord(BREAK)] = BROKEN
    for point in range(sys.maxunicode + 1):
        if chr(point).isalpha():
            table[point] = point
    return table


def grams(text: str, n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letter n-grams (packed code points) and their counts."""
    points = _letters()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = points == 32
    points = points[~(blank & np.append(False, blank[:-1]))]
    if points.size < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    packed = np.zeros(points.size - n + 1, np.uint64)
    for place in range(n):
        packed = (packed << np.uint64(POINT_BITS)) | points[place : points.size - n + 1 + place]
    breaks = np.flatnonzero(points == BROKEN)
    if breaks.size:
        across = (breaks[:, None] - np.arange(n)).ravel()
        packed = np.delete(packed, across[(across >= 0) & (across < packed.size)])
    return np.unique(packed, return_counts=True)


def letter_vector(point: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng([20480, point]).integers(0, 2, dimensions, np.int8) * 2 - 1


class GramVectors:
    """Vectors of n-grams, made when first met; forgotten when more than a fixed number are held."""

    def __init__(self, dimensions: int = DIMENSIONS, n: int = GRAM, held: int = CACHED_GRAMS):
        self.dimensions, self.n, self.held = dimensions, n, held
        self.letters: dict[int, np.ndarray] = {}
        self.buffer = np.empty((BLOCK, dimensions), np.float32)
        self._forget()

    def _forget(self) -> None:
        self.known = np.empty(0, np.uint64)  # sorted, with the row of each
        self.rows = np.empty(0, np.int64)
        self.matrix = np.empty((0, self.dimensions), np.float32)

    def _letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            if len(self.letters) >= self.held:
                self.letters.clear()
            self.letters[point] = letter_vector(point, self.dimensions)
        return self.letters[point]

    def bound(self, gram: int) -> np.ndarray:
        vector = np.ones(self.dimensions, np.int8)
        for place in range(self.n):
            point = (gram >> (POINT_BITS * (self.n - 1 - place))) & ((1 << POINT_BITS) - 1)
            vector *= np.roll(self._letter(point), place)
        return vector

    def _learn(self, missing: np.ndarray) -> None:
        first = len(self.known)
        if first + missing.size > len(self.matrix):
            grown = np.empty((max(2 * len(self.matrix), first + missing.size, 2048), self.dimensions), np.float32)
            grown[:first] = self.matrix[:first]
            self.matrix = grown
        for row, gram in enumerate(missing.tolist(), first):
            self.matrix[row] = self.bound(gram)
        known = np.append(self.known, missing)
        order = np.argsort(known)
        self.known = known[order]
        self.rows = np.append(self.rows, np.arange(first, first + missing.size))[order]

    def bundle(self, packed: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the n-grams' vectors (``packed`` sorted and distinct), in blocks so that any text fits."""
        total = np.zeros(self.dimensions, np.float64)
        for at in range(0, packed.size, BLOCK):
            wanted = packed[at : at + BLOCK]
            missing = self._unknown(wanted)
            if len(self.known) + missing.size > self.held:
                self._forget()
                missing = wanted
            if missing.size:
                self._learn(missing)
            chosen = self.buffer[: wanted.size]  # kept, as fresh memory would cost more than the product
            np.take(self.matrix, self.rows[np.searchsorted(self.known, wanted)], axis=0, out=chosen, mode="clip")
            total += counts[at : at + BLOCK].astype(np.float32) @ chosen
        return total

    def _unknown(self, wanted: np.ndarray) -> np.ndarray:
        if not self.known.size:
            return wanted
        at = np.minimum(np.searchsorted(self.known, wanted), self.known.size - 1)
        return wanted[self.known[at] != wanted]


class GramCounts:
    """Counts of one language: texts are gathered, then counted together."""

    def __init__(self, vectors: GramVectors):
        self.vectors, self.total = vectors, np.zeros(vectors.dimensions)
        self.texts: list[str] = []
        self.size = 0

    def add(self, text: str) -> None:
        self.texts.append(text)
        self.size += len(text)
        if self.size >= JOINED_CHARS:
            self.flush()

    def flush(self) -> np.ndarray:
        if self.texts:
            self.total += self.vectors.bundle(*grams(f" {BREAK} ".join(self.texts), self.vectors.n))
            self.texts, self.size = [], 0
        return self.total


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, np.ndarray]:
    """Language -> prototype vector, from all rows with a language.

    Each task bundles its rows into one vector per language; the vectors are summed in two steps.
    What reaches the driver is one vector per distinct language, whatever the number of rows.
    """
    own = columns_as(docs, lang=lang_col, text=text_col).where("lang is not null and text is not null")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = GramVectors()
        counts: dict[str, GramCounts] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts.setdefault(lang, GramCounts(vectors)).add(text.as_py())
        totals = {lang: seen.flush() for lang, seen in counts.items()}
        salt = TaskContext.get().partitionId() % MERGE_WIDTH
        if totals:
            yield pa.RecordBatch.from_pydict(
                {"lang": list(totals), "salt": [salt] * len(totals), "sums": [v.tolist() for v in totals.values()]},
                pa.schema([("lang", pa.string()), ("salt", pa.int32()), ("sums", pa.list_(pa.float64()))]),
            )

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.asarray(x.as_py()) for x in table.column("sums")], axis=0)
        first = table.slice(0, 1).select(["lang", "salt"])
        return first.append_column("sums", pa.array([total.tolist()], pa.list_(pa.float64())))

    schema = "lang string, salt int, sums array<double>"
    partial = own.mapInArrow(bundle, schema).groupBy("lang", "salt").applyInArrow(add, schema)
    sums = partial.groupBy("lang").applyInArrow(add, schema).select("lang", "sums").collect()
    return {row.lang: np.asarray(row.sums) for row in sums}


class Profiles:
    """Prototypes ready to compare: unit length, common part removed, unit length again."""

    def __init__(self, prototypes: dict[str, np.ndarray]):
        self.langs = sorted(x for x, v in prototypes.items() if np.linalg.norm(v) > 0)
        self.vectors = GramVectors()
        if self.langs:
            unit = np.array([prototypes[x] / np.linalg.norm(prototypes[x]) for x in self.langs])
            self.plain = unit
            self.centre = unit.mean(axis=0) if len(self.langs) > 1 else np.zeros(unit.shape[1])
            own = unit - self.centre
            self.own = own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float]:
        packed, counts = grams(text or "")
        if not self.langs or not packed.size:
            return "und", 0.0
        bundle = self.vectors.bundle(packed, counts)
        size = np.linalg.norm(bundle)
        if size == 0:
            return self.langs[0], 0.0
        bundle /= size
        best = int(np.argmax(self.own @ (bundle - self.centre)))
        return self.langs[best], float(min(1.0, max(0.0, self.plain[best] @ bundle)))


def predicted(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` with the columns ``lang_pred`` and ``lang_score`` added."""

    @F.pandas_udf("lang_pred string, lang_score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        profiles = Profiles(prototypes)
        for some in texts:
            yield pd.DataFrame([profiles.predict(x) for x in some], columns=["lang_pred", "lang_score"])

    found = docs.select("*", predict(F.col(f"`{text_col}`")).alias("_language"))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], "_language.lang_pred", "_language.lang_score")


def in_fold(id_col: str, folds: int, fold: int) -> Column:
    """Whether the remainder of crc32(id as text) is ``fold``; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


#: Letters are told apart by code blocks of this many bits; a block with fewer of the labelled letters
#: than one in ``RARE`` belongs to no learnt script.
SCRIPT_BITS = 7
RARE = 1000
STRETCH = 1 << 18  # characters counted at once
LONG = 400
IN_SCRIPT = 0.9


def letter_blocks(texts: Iterable[str]) -> np.ndarray:
    """Letters of the texts per code block, counted in stretches of bounded size."""
    total = np.zeros((sys.maxunicode >> SCRIPT_BITS) + 1, np.int64)

    def add(stretch: str) -> None:
        points = _letters()[np.frombuffer(stretch.encode("utf-32-le", "surrogatepass"), np.uint32)]
        found = np.bincount((points[points > 32] >> np.uint64(SCRIPT_BITS)).astype(np.int64))
        total[: found.size] += found

    held, size = [], 0
    for text in texts:
        for at in range(0, len(text), STRETCH):
            held.append(text[at : at + STRETCH])
            size += len(held[-1])
            if size >= STRETCH:
                add(" ".join(held).lower())
                held, size = [], 0
    if held:
        add(" ".join(held).lower())
    return total


def learnt_scripts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> list[int]:
    """Code blocks that hold the letters of the labelled texts; at most ``RARE`` of them."""
    own = columns_as(docs, lang=lang_col, text=text_col).where("lang is not null and text is not null").select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = letter_blocks(x.as_py() for x in batch.column(0))
            block = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(total[block])], ["block", "n"])

    sums = own.mapInArrow(count, "block long, n long").groupBy("block").agg(F.sum("n").alias("n"))
    sums = sums.withColumn("total", F.sum("n").over(Window.partitionBy()))  # a row per code block
    return sorted(r.block for r in sums.where(F.col("n") * RARE >= F.col("total")).collect())


@under_plain_names
def keep_known_language(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: float = LEAST_COSINE, keep_unsure: bool = True,
    long: int = LONG, in_script: float = IN_SCRIPT,
) -> DataFrame:
    """``docs`` without the rows that have no letter, and without long ones in no language that was learnt.

    A cosine below ``least`` cannot be told from that of unrelated text.  In a text of at least ``long``
    letters, ``in_script`` of them of the scripts that labelled texts use, that means it is no text of a
    language, and the row goes.  A shorter text, and one in a script which no labelled row has, says
    too little and stays (or all go if not ``keep_unsure``); the sign of a cosine never decides.  Where
    nothing was learnt every row with a letter stays.
    """
    prototypes = learn(docs, lang_col, text_col)
    learnt = any(v.any() for v in prototypes.values())
    scripts = learnt_scripts(docs, lang_col, text_col) if learnt else []

    @F.pandas_udf("boolean")
    def stays(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        profiles = Profiles(prototypes)

        def judged(text: str | None) -> bool:
            if not learnt:
                return bool(grams(text or "")[0].size)
            lang, score = profiles.predict(text)
            if lang == "und" or score >= least or not keep_unsure:
                return lang != "und" and score >= least
            blocks = letter_blocks([text])
            known = int(blocks[scripts].sum())
            return blocks.sum() < long or known < in_script * blocks.sum()

        for some in texts:
            yield pd.Series([judged(x) for x in some], dtype=bool)

    return docs.where(stays(F.col(f"`{text_col}`")))
