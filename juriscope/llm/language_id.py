"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  An n-gram's vector binds (by
multiplication) its letters' vectors, each permuted (rolled) by its place; a
text's vector bundles (adds) its n-grams'; a language's prototype bundles all of
its training texts.  A text gets the language whose prototype has the greatest
cosine with its vector.  Word boundaries count as a letter.

Bundling is a sum, so a prototype is made from n-gram counts: tasks add up counts
by language, and the sums of a language's vector are a row of a table.  Prototypes are
compared ``block`` languages at a time, however many there are: the driver and a task
hold one block, and a document carries its best cosine from block to block.

Defined results: texts that are null or without a letter are ``und`` with score
0, as are all texts where nothing was learned; rows with a null language are not
learned from; of equal cosines the language that sorts first wins; rows that repeat an
id each get their row; an empty table gives an empty table; other columns pass whatever
their names, but for lang_pred and score, which are replaced.  The score is the cosine,
mapped from [-1, 1] to [0, 1].
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from juriscope.llm.common import carried, quoted, restored, schema_of, written

#: Symbols: 0 a boundary, 1 to 26 the letters of ASCII, the rest shared by all other letters.
SYMBOLS = 64
GRAM = 3
_CODES = SYMBOLS**GRAM


@lru_cache
def _symbol_table() -> np.ndarray:
    """Symbol of every code point; 0 for all that is no letter."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            out[cp] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 7) % (SYMBOLS - 27)
    return out


def symbols(text: str) -> np.ndarray:
    """The text's letters as symbols, every run of others as one boundary, one at both ends."""
    s = _symbol_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    s = np.concatenate([[0], s, [0]]).astype(np.int64)
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    return s[keep]


def lettered(text: str) -> bool:
    return bool(_symbol_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any())


def grams(text: str) -> np.ndarray:
    s = symbols(text)
    if len(s) < GRAM:
        return np.zeros(0, np.int64)
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]


@lru_cache
def letter_vectors(dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (SYMBOLS, dims))


def gram_vectors(codes: np.ndarray, dims: int, seed: int) -> np.ndarray:
    letters = letter_vectors(dims, seed)
    first, second, third = codes // SYMBOLS**2, codes // SYMBOLS % SYMBOLS, codes % SYMBOLS
    return np.roll(letters, 2, axis=1)[first] * np.roll(letters, 1, axis=1)[second] * letters[third]


def summed(counts: np.ndarray, codes: np.ndarray, dims: int, seed: int, chunk: int = 4096) -> np.ndarray:
    """Counts (texts by codes) times the codes' vectors, ``chunk`` codes at a time."""
    out = np.zeros((len(counts), dims))
    for i in range(0, len(codes), chunk):
        out += counts[:, i : i + chunk].astype(np.float32) @ gram_vectors(codes[i : i + chunk], dims, seed).astype(np.float32)
    return out


def bundle(texts: list[str], dims: int, seed: int, most: int = 1 << 22) -> np.ndarray:
    """The vectors of texts, as many of them at once as ``most`` counts allow."""
    each = [grams(t) for t in texts]
    out, i = np.zeros((len(texts), dims), np.float32), 0
    while i < len(texts):
        size, j = len(each[i]), i + 1
        # Codes of a group are at most its n-grams, and counts its texts times those.
        while j < len(texts) and (j + 1 - i) * min(_CODES, size + len(each[j])) <= most:
            size, j = size + len(each[j]), j + 1
        codes, at = np.unique(np.concatenate(each[i:j]), return_inverse=True)
        row = np.repeat(np.arange(j - i), [len(g) for g in each[i:j]])
        if len(codes):
            counts = np.bincount(row * len(codes) + at, minlength=(j - i) * len(codes)).reshape(j - i, -1)
            out[i:j] = summed(counts, codes, dims, seed)
        i = j
    return out


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dims: int = 1024, seed: int = 7) -> DataFrame:
    """(lang, v): the prototype of every language in ``docs``, written to the shared folder."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                g = grams(text)
                if len(g) > 1:
                    if lang not in held:
                        held[lang] = np.zeros(_CODES, np.int64)
                    np.add.at(held[lang], g, 1) if len(g) < 4096 else np.add(held[lang], np.bincount(g, minlength=_CODES), out=held[lang])
                if len(held) > 64:
                    yield from flush(held)
        yield from flush(held)

    def flush(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            codes, vector = np.flatnonzero(counts), np.zeros(dims)
            for i in range(0, len(codes), 4096):
                vector += counts[codes[i : i + 4096]].astype(np.float64) @ gram_vectors(codes[i : i + 4096], dims, seed).astype(np.float64)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * dims, "at": np.arange(dims, dtype=np.int32), "x": vector})
        held.clear()

    rows = docs.select(F.col(quoted(text_col)).cast("string").alias("text"), F.col(quoted(lang_col)).cast("string").alias("lang")).filter("text is not null and lang is not null")
    sums = rows.mapInArrow(count, "lang string, at int, x double").groupBy("lang", "at").agg(F.sum("x").alias("x"))
    return written(sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v")).select("lang", F.col("v.x").alias("v")), "prototypes")


def identify(docs: DataFrame, prototypes: DataFrame, text_col: str = "text", dims: int = 1024, seed: int = 7, batch_rows: int = 128, block: int = 512) -> DataFrame:
    """``docs`` with lang_pred and score added (or replaced)."""
    rest = docs.withColumn(text_col, F.lit(None).cast("string")) if text_col in ("lang_pred", "score") else docs
    rows = docs.select(carried(rest).alias("_row"), F.col(quoted(text_col)).cast("string").alias("_text"), F.lit(None).cast("string").alias("_lang"), F.lit(-2.0).alias("_cosine"))
    schema = rows.schema

    def compared(names: list[str], unit: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                langs, best = batch.column(2).to_pylist(), batch.column(3).to_numpy().copy()
                for i in range(0, len(batch), batch_rows):
                    texts = [t or "" for t in batch.column(1).slice(i, batch_rows).to_pylist()]
                    vectors = bundle(texts, dims, seed)
                    cosines = (vectors @ unit.T) / np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)[:, None]
                    for j, (at, cosine) in enumerate(zip(cosines.argmax(axis=1).tolist(), cosines.max(axis=1).tolist(), strict=True), i):
                        if not lettered(texts[j - i]):
                            continue
                        if cosine > best[j] or cosine == best[j] and names[at] < langs[j]:
                            langs[j], best[j] = names[at], cosine
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(best)], ["_row", "_text", "_lang", "_cosine"])

        return run

    blocks = -(-prototypes.count() // block)
    for k in range(blocks):
        some = prototypes.filter(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == k).orderBy("lang").collect()
        if some:
            vectors = np.array([r.v for r in some])
            unit = (vectors / np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)[:, None]).astype(np.float32)
            rows = rows.mapInArrow(compared([r.lang for r in some], unit), schema)
    known = F.col("_lang").isNotNull()
    rows = rows.select("_row", F.coalesce("_lang", F.lit("und")).alias("_lang"), F.when(known, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("_cosine") + 1) / 2))).otherwise(0.0).alias("_score"))
    return rows.select(*restored(docs.columns, "_row", lang_pred="_lang", score="_score"))
