"""Language identification: known words first, then ever shorter character n-grams.

A word of the vocabulary is scored by its log frequency in each language. Any other word
falls back to its character 5-grams (with word borders) if the model knows one of them,
else to 4-grams, and so on down to single characters; known n-grams of that length are
averaged. A document's score in a language is the sum over its words, and the posterior
with even priors is its confidence.

The model is fitted on a sample bounded by ``SAMPLE_DOCS`` documents a language (in
expectation, by hash of the id), counted on the executors; rare entries are left out, so
the tables that reach the driver and the tasks are bounded by the sample. Scoring is one
pass over whole texts without a shuffle. Scores of distinct tokens are kept in a bounded
cache of each worker, as most tokens of a text have been seen before.

Defined cases: null texts and texts without a letter (digits, fractions, numerals and marks are
none) are ``und`` with score 0; a word that
no table knows counts for nothing, and if no word counts, all languages are even and the
first in order is given; an empty sample makes every text ``und``; repeated rows get equal
answers; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinloom.llm.slices import slices
from clinloom.session import ship

#: Documents of each language that the model is fitted on, in expectation.
SAMPLE_DOCS = 600
LONGEST = 5
#: Least count of a word, or of an n-gram, in the sample.
MIN_WORD, MIN_GRAM = 2, 3
#: More languages than this are refused: the model is held in every task.
MAX_LANGUAGES = 256
UNKNOWN = "und"
#: Tokens whose scores a worker keeps.
CACHE = 400_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased. Letters are what ``str.isalpha`` says: no numerals, fractions or circled digits."""
    found = _WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


def grams_of(word: str, n: int) -> list[str]:
    bordered = f"<{word}>" if n > 1 else word
    return [bordered[i : i + n] for i in range(len(bordered) - n + 1)]


def count_sample(rows: Iterator[tuple[str, str]]) -> Counter:
    """Counts of (language, length, entry); words have length 0."""
    words: dict[str, Counter] = {}
    for lang, text in rows:
        words.setdefault(lang, Counter()).update(words_of(text))
    out: Counter = Counter()
    for lang, counted in words.items():
        for word, n in counted.items():
            out[lang, 0, word] += n
            for k in range(1, LONGEST + 1):
                for g in grams_of(word, k):
                    out[lang, k, g] += n
    return out


@dataclass
class Model:
    languages: list[str]
    tables: list[dict[str, np.ndarray]]  # by length: entry -> log frequency per language
    _rows: dict[str, int] = field(default_factory=dict)
    _scores: np.ndarray | None = None

    def word_score(self, word: str) -> np.ndarray | None:
        known = self.tables[0].get(word)
        if known is not None:
            return known
        for n in range(LONGEST, 0, -1):
            table = self.tables[n]
            found = [table[g] for g in grams_of(word, n) if g in table]
            if found:
                return sum(found) / len(found)
        return None

    def token_scores(self, token: str) -> np.ndarray:
        """Sum over the words of a token; the last entry counts its words."""
        out = np.zeros(len(self.languages) + 1)
        for word in words_of(token):
            out[-1] += 1
            found = self.word_score(word)
            if found is not None:
                out[:-1] += found
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        labels, scores = [], []
        cut = [t.split() if t else [] for t in texts]
        if self._scores is None or len(self._rows) > CACHE:
            self._rows, self._scores = {}, np.zeros((1024, len(self.languages) + 1))
        rows = self._rows
        new = list(set().union(*cut).difference(rows))
        need = len(rows) + len(new)
        if need > len(self._scores):
            grown = np.zeros((need + need // 2, self._scores.shape[1]))
            grown[: len(rows)] = self._scores[: len(rows)]
            self._scores = grown
        for token in new:
            self._scores[len(rows)] = self.token_scores(token)
            rows[token] = len(rows)
        for tokens in cut:
            total = self._scores[np.fromiter(map(rows.__getitem__, tokens), np.int64, len(tokens))].sum(0)
            if not total[-1] or not self.languages:
                labels.append(UNKNOWN)
                scores.append(0.0)
                continue
            best = int(total[:-1].argmax())
            labels.append(self.languages[best])
            scores.append(float(1 / np.exp(np.maximum(total[:-1] - total[best], -700)).sum()))
        return labels, scores


def build(counts: dict[tuple[str, int, str], int]) -> Model:
    """Log frequencies with add-half smoothing, by language and length."""
    languages = sorted({k[0] for k in counts})
    where = {lang: i for i, lang in enumerate(languages)}
    tables: list[dict[str, np.ndarray]] = [{} for _ in range(LONGEST + 1)]
    for (lang, n, entry), c in counts.items():
        tables[n].setdefault(entry, np.zeros(len(languages)))[where[lang]] += c
    for table in tables:
        if table:
            total = np.sum(list(table.values()), axis=0) + 0.5 * len(table)
            for entry, c in table.items():
                table[entry] = np.log((c + 0.5) / total)
    return Model(languages, tables)


def train(docs: DataFrame, allowed: Column | None = None, rows: int = SAMPLE_DOCS, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on a sample of the rows of ``docs`` that ``allowed`` admits and whose language is not null."""
    ship(docs.sparkSession)
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    if allowed is not None:
        known = known.where(allowed)
    sizes = {r["l"]: r["n"] for r in known.groupBy(F.col(lang).alias("l")).agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return build({})
    slots = 1 << 30
    rate = F.lit(0)
    for value, n in sizes.items():
        rate = F.when(F.col(lang) == value, F.lit(min(slots, int(slots * rows / n)))).otherwise(rate)
    sample = known.where(F.pmod(F.xxhash64(F.lit("language"), F.col(key)), F.lit(slots)) < rate).select(F.col(lang), F.col(text))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = count_sample(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            yield pa.RecordBatch.from_pydict(
                {"lang": [k[0] for k in found], "size": pa.array([k[1] for k in found], pa.int32()), "entry": [k[2] for k in found], "n": pa.array(list(found.values()), pa.int64())},
                schema=pa.schema([("lang", pa.string()), ("size", pa.int32()), ("entry", pa.string()), ("n", pa.int64())]),
            )

    counted = sample.mapInArrow(count, "lang string, size int, entry string, n long").groupBy("lang", "size", "entry").agg(F.sum("n").alias("n"))
    kept = counted.where(F.col("n") >= F.when(F.col("size") == 0, MIN_WORD).otherwise(MIN_GRAM))
    table = kept.toArrow()
    columns = [table.column(c).to_pylist() for c in ("lang", "size", "entry", "n")]
    return build({(a, b, c): n for a, b, c, n in sorted(zip(*columns, strict=True))})


_models: dict[str, Model] = {}


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, which replace columns of these names; all others are kept."""
    docs = docs.drop("lang_pred", "score")
    ship(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _models.get(str(shared._path))
        if own is None:
            _models.clear()
            own = _models[str(shared._path)] = Model(*shared.value)
        for batch in slices(batches, at):
            labels, scores = own.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)
