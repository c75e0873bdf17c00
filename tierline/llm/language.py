"""Language identification by cross-parsing entropy.

For each language the suffix automaton of a bounded sample of labelled text is built. A text is parsed
greedily into the longest phrases that occur in the sample; the language that needs the fewest phrases per
letter wins. Automata are tables (state, letter) -> state, each over the letters of its own language, so that
languages of other scripts take nothing from each other. A text runs through them in pieces side by side, one
letter of all pieces at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierline.llm.common import chunks, held_out, small_batches

#: Documents of a language and letters of them that its automaton is built of, at most.
DOCS_PER_LANGUAGE = 80
LETTERS_PER_LANGUAGE = 24_000
#: Characters of a document that it can bring to the sample, from a place that a hash of its id gives.
CHARACTERS_PER_DOC = 3_000
#: Letters of one language that have a column of their own, the most frequent ones; the others are in no phrase.
ALPHABET = 250
#: Letters of a piece: a phrase ends with it.
PIECE = 512
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[: 0x3FFFF] = [chr(i).isalpha() for i in range(0x3FFFF)]
    return table


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


class Letters:
    """Code points to columns: 0 for a run of anything but letters, 1.. for known letters, the last for others."""

    def __init__(self, known: Sequence[int]):
        self.known = list(known)
        self.size = len(self.known) + 2
        self._table: np.ndarray | None = None

    def __reduce__(self):
        return Letters, (self.known,)

    def codes(self, text: str) -> np.ndarray:
        if self._table is None:
            self._table = np.where(_is_letter(), self.size - 1, 0).astype(np.uint8)
            self._table[self.known] = np.arange(1, len(self.known) + 1)
        got = self._table[_points(text)]
        keep = got > 0
        keep[1:] |= got[:-1] > 0
        return got[keep] if len(got) else got


def automaton(codes: Sequence[int], size: int) -> np.ndarray:
    """Transitions of the suffix automaton: row 0 is the start, -1 no transition."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes:
        now = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = now
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[now] = clone
        last = now
    out = np.full((len(moves), size), -1, np.int32)
    for state, row in enumerate(moves):
        for c, to in row.items():
            out[state, c] = to
    return out


Model = tuple[str, Letters, np.ndarray]


def learn(samples: dict[str, list[str]]) -> list[Model]:
    """Each language's alphabet and automaton, languages in order of code point."""
    models = []
    for lang in sorted(samples):
        texts = samples[lang]
        seen: Counter[int] = Counter()
        for text in texts:
            seen.update(p for p in _points(text).tolist() if _is_letter()[p])
        letters = Letters(sorted(p for p, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:ALPHABET]))
        codes = [letters.codes(text) for text in texts]
        share = max(1, LETTERS_PER_LANGUAGE // max(1, len(texts)))
        parts, room = [], LETTERS_PER_LANGUAGE
        for taken in [c[:share] for c in codes] + [c[share:] for c in codes]:  # an even share of each, then what room is left
            if room > 0 and len(taken):
                parts += [*taken[:room].tolist(), 0]
                room -= len(taken[:room])
        models.append((lang, letters, automaton(parts, letters.size)))
    return models


def phrases(pieces: np.ndarray, lengths: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Phrases of each piece. pieces: a row per letter; pieces run side by side, the longest first."""
    size = table.shape[1]
    flat = table.reshape(-1)
    count = np.zeros(len(lengths), np.int64)
    state = np.zeros(len(lengths), np.int64)
    alive = len(lengths)
    for step in range(len(pieces)):
        while alive and lengths[alive - 1] <= step:
            alive -= 1
        c = pieces[step, :alive]
        to = flat[state[:alive] * size + c]
        at = np.flatnonzero((to < 0) | (state[:alive] == 0))  # a phrase starts: with a letter unknown, of one letter
        count[at] += 1
        to[at] = np.maximum(flat[c[at].astype(np.int64)], 0)
        state[:alive] = to
    return count


def rates(texts: Sequence[str], models: Sequence[Model]) -> tuple[np.ndarray, np.ndarray]:
    """Phrases per letter of each text and language, and whether the text has a letter."""
    total, has = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
    out = np.zeros((len(texts), len(models)))
    for m, (_, letters, table) in enumerate(models):
        codes = [letters.codes(t) for t in texts]
        if m == 0:  # what is a letter does not hang on the language, so that lengths and pieces are those of all
            total = np.array([len(c) for c in codes], np.int64)
            has = np.array([bool(c.any()) for c in codes], bool)
            cuts = [range(0, n, PIECE) for n in total.tolist()]
            owner = np.repeat(np.arange(len(texts)), [len(c) for c in cuts])
            starts = np.array([at for c in cuts for at in c], np.int64)
            lengths = np.minimum(PIECE, total[owner] - starts)
            order = np.argsort(-lengths, kind="stable")
            owner, starts, lengths = owner[order], starts[order], lengths[order]
            places = list(enumerate(zip(owner.tolist(), starts.tolist(), lengths.tolist())))
        pieces = np.zeros((int(lengths.max(initial=0)), len(lengths)), np.uint8)
        for k, (i, a, n) in places:
            pieces[:n, k] = codes[i][a : a + n]
        out[:, m] = np.bincount(owner, phrases(pieces, lengths, table), len(texts))
    return out / np.maximum(total, 1)[:, None], has


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = model.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            langs: list[str] = []
            scores: list[float] = []
            for first, raws in chunks(texts):
                part = texts[first : first + len(raws)]
                rate, has = rates(part, models)
                for row, known in zip(rate, has.tolist()):
                    if not known or not models:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    best = int(np.argmin(row))
                    others = np.delete(row, best)
                    langs.append(models[best][0])
                    scores.append(float(1 - row[best] / others.min()) if len(others) else 1.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def training_texts(docs: DataFrame) -> dict[str, list[str]]:
    """Up to DOCS_PER_LANGUAGE different rows of each language by a hash of doc_id, never held-out ones. They are
    chosen by id and a hash of the text first, a repeated row once. Of each chosen text the CHARACTERS_PER_DOC from a
    place that a hash of the id gives come to the driver: at most DOCS_PER_LANGUAGE pieces for each language."""
    known = docs.select(
        F.col("doc_id").cast("long").alias("_id"),
        F.col("lang").cast("string").alias("lang"),
        F.col("text").cast("string").alias("text"),
    ).where(F.col("_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("_id")))
    hashed = known.withColumn("_hash", F.xxhash64("text"))
    place = F.dense_rank().over(Window.partitionBy("lang").orderBy(F.xxhash64("_id"), "_id", "_hash"))
    chosen = hashed.select("lang", "_id", "_hash").withColumn("_place", place).where(F.col("_place") <= DOCS_PER_LANGUAGE)
    room = F.greatest(F.length("text") - CHARACTERS_PER_DOC, F.lit(0)) + 1
    start = (F.pmod(F.xxhash64("_id"), room) + 1).cast("int")
    rows = (
        hashed.join(F.broadcast(chosen.select("lang", "_id", "_hash").distinct()), ["lang", "_id", "_hash"])
        .select("lang", "_id", F.substring("text", start, F.lit(CHARACTERS_PER_DOC)).alias("text"))
        .distinct()
        .collect()
    )
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["_id"], r["text"])):
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of `docs` (doc_id, text, lang).

    `score` is how much fewer phrases the winner needs than the next language: 0 (no difference) to 1. Of
    equals the first by code point wins. A text that is null or has no letter is `und` with score 0, and so
    is every text if no language is known. A null doc_id counts as held out. No documents give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(learn(training_texts(docs)))
    key = F.col("doc_id").cast("long")
    texts = docs.select(key.alias("doc_id"), held_out(key).alias("held_out"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")
