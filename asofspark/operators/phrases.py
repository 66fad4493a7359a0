"""Phrases of several lists found in texts by one Aho-Corasick automaton, in one pass over each text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz")


class Phrases:
    """Lists of phrases (anywhere in a text) and strengths of words (whole words only), in lower case."""

    def __init__(self, lists: Mapping[str, Iterable[str]], strengths: Mapping[str, float]):
        import ahocorasick

        self.lists = {name: set(phrases) for name, phrases in lists.items()}
        self.strengths = dict(strengths)
        self.automaton = ahocorasick.Automaton()
        for phrase in {*self.strengths, *(p for ps in self.lists.values() for p in ps)}:
            self.automaton.add_word(phrase, phrase)
        if len(self.automaton):
            self.automaton.make_automaton()

    def found(self, text: str) -> tuple[dict[str, int], float]:
        """How often phrases of each list occur in a text in lower case, and the sum of its words' strengths.

        A word is a run of a to z; words joined by single hyphens are one compound. A compound that has a strength
        counts as such, else its words do."""
        counts, total, compounds, words = dict.fromkeys(self.lists, 0), 0.0, [], []
        for last, phrase in self.automaton.iter(text) if len(self.automaton) else ():
            for name, phrases in self.lists.items():
                counts[name] += phrase in phrases
            if phrase not in self.strengths:
                continue
            a, b = last - len(phrase) + 1, last + 1
            if (a and text[a - 1] in LETTERS) or (b < len(text) and text[b] in LETTERS):
                continue
            joined = a > 1 and text[a - 1] == "-" and text[a - 2] in LETTERS, b + 1 < len(text) and text[b] == "-" and text[b + 1] in LETTERS
            if "-" not in phrase:
                words.append((a, b, phrase))
            elif not any(joined):
                compounds.append((a, b))
                total += self.strengths[phrase]
        ends = iter(compounds)
        a = b = -1
        for begin, end, word in words:  # both are in the order of their ends, and compounds do not overlap
            while b < end and (now := next(ends, None)):
                a, b = now
            if not (a <= begin and end <= b):
                total += self.strengths[word]
        return counts, total


def with_phrases(df: DataFrame, text: str, lists: Mapping[str, Iterable[str]], strengths: Mapping[str, float] | None = None, score: str = "strength") -> DataFrame:
    """df with, for each list, how often its phrases occur in text, and in `score` the sum of the words' strengths.

    Texts are put in lower case; a null text holds nothing. Overlapping phrases count each. The lists go to the tasks
    with the function: they are parameters, not data that grows.
    """
    strengths = dict(strengths or {})
    lists = {name: list(phrases) for name, phrases in lists.items()}
    new = [StructField(name, LongType()) for name in lists] + [StructField(score, DoubleType())]
    kept, names = df.schema.fields, [*df.columns, *lists, score]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(lists, strengths)
        for b in batches:
            found = [phrases.found(t or "") for t in b.column("_low").to_pylist()]
            counts = [pa.array([c[name] for c, _ in found], pa.int64()) for name in lists]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *counts, pa.array([x for _, x in found], pa.float64())], names=names)

    return df.withColumn("_low", F.lower(text)).mapInArrow(run, StructType([*kept, *new]))
