"""Token counts: a count-only Viterbi pass over a unigram vocabulary.

An Aho-Corasick automaton gives all vocabulary pieces that end at each character, longest
first. Dynamic programming keeps, for the ends that a piece can reach back to, the best score of the text
so far and the number of pieces on that path; no path and no piece is stored. The rules are those of the
unigram tokenizers: a later candidate must be strictly better, so of equal paths the one
whose last piece begins first stays; where no piece of one character fits, the character
may be unknown, at the least score of the vocabulary less 10; an unknown character counts
as one piece for each byte of its UTF-8 form (byte fallback). Spaces become U+2581, and
one is put before the text.

A text may be cut where no piece can cross: before a space after another character, and around
line feeds, which are in no piece. The stretches between are counted once and kept in a
bounded cache of each worker. Where all scores are whole numbers, sums are exact, a
stretch's result is the same wherever it stands, and nothing else is kept of it. Log probabilities are not: a tokenizer adds
them up from the text's start, and rounding may decide between equal paths. So with each
stretch the scores on its path are kept, to be added one by one, and the least gap between two
candidates that were compared; only where that is within the rounding error of the sum so far,
the stretch is walked again from that sum. A
vocabulary with pieces that cross such cuts is taken as it is, and texts are then not cut.
One pass without a shuffle.

Defined cases: null and empty texts have 0 pieces and score 0; a text of any length is cut into its stretches (some
ten bytes a character, as they are held at once), and a stretch of any length takes the memory of its characters only, or
with fractional scores some 200 bytes for each; repeated rows get equal
counts; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from clinloom.llm.slices import slices
from clinloom.session import ship

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHE, CACHED_CHARS = 500_000, 64
#: Twice the relative error of an addition, and of what it is compared with.
ROUNDING = 2.0**-50
_STRETCH = re.compile(r"\n| *[^ \n]+| +")


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces and scores of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size()) if not special(i)]


class Counter:
    """Counts pieces of texts over one vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self._automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self._automaton.add_word(piece, (len(piece), float(score)))
        self._automaton.make_automaton()
        self._cuts = not any("\n" in piece or SPACE in piece.lstrip(SPACE) for piece, _ in pieces)
        self._longest = max(len(piece) for piece, _ in pieces)
        self._exact = all(score == int(score) for _, score in pieces)
        self._unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self._pieces: dict[str, int] = {}
        self._scores: dict[str, float] = {}
        self._sums: dict[str, list] = {}  # least gap and steps, where scores are no whole numbers

    def viterbi(self, text: str, start: float = 0.0) -> tuple[int, float, float, list[float]]:
        """(pieces, score, least gap, steps) of one stretch in which spaces are U+2581 already.

        The score goes on from ``start``; the steps are the scores that were added to it.
        """
        n = len(text)
        best, count, gap, back = [start] * (n + 1), [0] * (n + 1), float("inf"), [(0, 0.0)] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, found in self._automaton.iter(text):
            ends[end].append(found)
        for end, found in enumerate(ends):
            top, pieces, came = None, 0, (0, 0.0)
            if not any(length == 1 for length, _ in found):
                found.append((0, self._unknown))
            for length, score in found:
                at = end + 1 - (length or 1)
                candidate = best[at] + score
                if top is None or candidate > top:
                    gap = gap if top is None else min(gap, candidate - top)
                    top, came = candidate, (at, score)
                    pieces = count[at] + (1 if length else len(text[end].encode("utf-8", "surrogatepass")))
                else:
                    gap = min(gap, top - candidate)
            best[end + 1], count[end + 1], back[end + 1] = top, pieces, came
        steps, at = [], n
        while at:
            at, score = back[at]
            steps.append(score)
        return count[n], best[n], gap, steps[::-1]

    def count_only(self, text: str) -> tuple[int, float]:
        """(pieces, score) of one stretch where sums are exact: scores and counts of the last few ends, and nothing else."""
        size = self._longest + 1
        best, count = [0.0] * size, [0] * size
        matches = self._automaton.iter(text)
        at, found = next(matches, (-1, None))
        for end, character in enumerate(text):
            top, pieces, single = None, 0, False
            while at == end:
                length, score = found
                single = single or length == 1
                before = (end + 1 - length) % size
                candidate = best[before] + score
                if top is None or candidate > top:
                    top, pieces = candidate, count[before] + 1
                at, found = next(matches, (-1, None))
            if not single:
                candidate = best[end % size] + self._unknown
                if top is None or candidate > top:
                    top, pieces = candidate, count[end % size] + len(character.encode("utf-8", "surrogatepass"))
            best[(end + 1) % size], count[(end + 1) % size] = top, pieces
        return count[len(text) % size], best[len(text) % size]

    def _cut(self, text: str) -> list[str]:
        text = " " + text.replace(SPACE, " ")
        if not self._cuts:
            return [text]
        if "  " in text or " \n" in text or "\n\n" in text or "\x01" in text:
            return _STRETCH.findall(text)
        return text.replace(" ", "\x01 ").replace("\n", "\x01\n").split("\x01")

    def _new(self, stretch: str, start: float = 0.0) -> tuple[int, float, float, list[float]]:
        pieces, score, gap, steps = 0, start, float("inf"), []
        for part in re.split("(\n)", stretch) if self._cuts else [stretch]:
            if part and self._exact:
                n, more = self.count_only(part.replace(" ", SPACE))
                pieces, score = pieces + n, score + more
            elif part:
                n, score, least, more = self.viterbi(part.replace(" ", SPACE), score)
                pieces, gap, steps = pieces + n, min(gap, least), steps + more
        return pieces, score, gap, steps

    def count(self, text: str | None) -> tuple[int, float]:
        """(pieces, score) of a whole text."""
        if not text:
            return 0, 0.0
        cut, pieces, scores, sums = self._cut(text), self._pieces, self._scores, self._sums
        extra = {}
        for s in set(cut).difference(pieces):
            if len(s) <= CACHED_CHARS:
                pieces[s], scores[s], *rest = self._new(s)
                if not self._exact:
                    sums[s] = rest
            else:
                extra[s] = self._new(s)
        if not self._exact:
            out = self._from_the_start([(s, *(extra.get(s) or (pieces[s], scores[s], *sums[s]))) for s in cut])
        elif extra:
            both = [extra.get(s) or (pieces[s], scores[s]) for s in cut]
            out = sum(x[0] for x in both), sum(x[1] for x in both)
        else:
            out = sum(map(pieces.__getitem__, cut)), sum(map(scores.__getitem__, cut))
        if len(pieces) > CACHE:
            pieces.clear()
            scores.clear()
            sums.clear()
        return out

    def _from_the_start(self, stretches: list[tuple[str, int, float, float, list[float]]]) -> tuple[int, float]:
        """(pieces, score) as a walk over the whole text adds them up and decides."""
        pieces, total = 0, 0.0
        for s, n, score, gap, steps in stretches:
            if gap <= ROUNDING * (len(s) + 2) * (abs(total) + abs(score)):
                n, total, _, _ = self._new(s, total)
            else:
                for x in steps:
                    total += x
            pieces += n
        return pieces, total


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(vocabulary(path))
    return _counters[path]


def count_tokens(df: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``df`` with n_pieces and best_score, which replace columns of these names.

    ``model`` is the path of a file that every executor has.
    """
    df = df.drop("n_pieces", "best_score")
    ship(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField("n_pieces", T.LongType()), T.StructField("best_score", T.DoubleType())])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(model)
        for part in slices(batches, at):
            found = [tool.count(t) for t in part.column(at).to_pylist()]
            extra = [pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=[*part.schema.names, "n_pieces", "best_score"])

    return df.mapInArrow(run, schema)
