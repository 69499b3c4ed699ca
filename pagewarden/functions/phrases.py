"""Listed names and places, found inside the row.

A text is taken as words. Only where a word begins some phrase are the runs of words
from there compared with the phrases, in the lengths that phrases have, so a text
without such a word costs one look at each word, and nothing is exploded or joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden.functions.text import tokens
from pagewarden.schema import ENTITY

# A list travels with the plan. Longer ones go to `operators.screening.find_phrases`,
# which joins, and its findings to `gate_pages`.
PHRASE_LIMIT = 100_000


@dataclass(frozen=True)
class PhraseList:
    """Phrases by group and score, each as its lower-case words joined by blanks.

    Stands among the rules of a gate; a finding's word is the phrase in this form.
    """

    phrases: tuple[tuple[str, float, frozenset[str]], ...]

    @staticmethod
    def read(gazetteer: DataFrame, limit: int = PHRASE_LIMIT) -> "PhraseList":
        """From rows (entity_group, phrase, score)."""
        rows = phrase_runs(gazetteer).select("entity_group", "_run", "score").distinct().limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"more than {limit} phrases: find_phrases and gate_pages take lists of any length")
        kinds: dict[tuple[str, float], set[str]] = {}
        for group, run, score in rows:
            kinds.setdefault((group, score), set()).add(run)
        return PhraseList(tuple((*kind, frozenset(kinds[kind])) for kind in sorted(kinds)))

    def within(self, threshold: float, groups: Iterable[str]) -> "PhraseList":
        """The phrases of these groups that reach the threshold."""
        wanted = set(groups)
        return PhraseList(tuple(p for p in self.phrases if p[0] in wanted and p[1] >= threshold))

    def _at_starts(self, words: Column, look: Callable[[Column, list], Column]) -> Column:
        """For every word that begins a phrase what `look` makes of the runs from there."""
        runs = {run for _, _, some in self.phrases for run in some}
        firsts = sorted({run.split(" ")[0] for run in runs})
        starts = F.array_compact(F.transform(words, lambda word, i: F.when(word.isin(firsts), i)))
        lengths = sorted({run.count(" ") + 1 for run in runs})

        def at(i: Column) -> Column:
            return look(i, [(n, F.array_join(F.slice(words, i + 1, F.lit(n)), " ")) for n in lengths])

        return F.transform(starts, at)

    def _of_words(self, text: Column, work: Callable[[Column], Column]) -> Column:
        # Bound once: as an expression the words would be worked out at every use.
        return F.get(F.transform(F.array(tokens(text)), work), F.lit(0))

    def runs(self, text: Column) -> Column:
        """Array of the phrases a text holds, one for each place."""

        def look(i: Column, runs: list) -> Column:
            found = [
                F.when(run.isin(sorted({r for _, _, some in self.phrases for r in some if r.count(" ") == n - 1})), run)
                for n, run in runs
            ]
            return F.array_compact(F.array(*found))

        if not self.phrases:
            return F.array().cast("array<string>")
        found = self._of_words(text, lambda words: F.flatten(self._at_starts(words, look)))
        return F.coalesce(found, F.array().cast("array<string>"))

    def found(self, text: Column) -> Column:
        """All findings of a text, by place."""
        kind = f"array<{ENTITY.simpleString()}>"

        def look(i: Column, runs: list) -> Column:
            found = []
            for n, run in runs:
                for group, score, some in self.phrases:
                    listed = sorted(r for r in some if r.count(" ") == n - 1)
                    if listed:
                        entity = F.struct(F.lit(group).alias("entity_group"), run.alias("word"), F.lit(score).alias("score"))
                        found.append(F.when(run.isin(listed), entity))
            return F.array_compact(F.array(*found))

        if not self.phrases:
            return F.array().cast(kind)
        found = self._of_words(text, lambda words: F.flatten(self._at_starts(words, look)))
        return F.coalesce(found.cast(kind), F.array().cast(kind))

    def hit(self, text: Column, threshold: float, groups: Iterable[str]) -> Column | None:
        """Whether a text holds a phrase of these groups; none if no phrase counts."""
        counted = self.within(threshold, groups)
        return F.size(counted.runs(text)) > 0 if counted.phrases else None


def phrase_runs(gazetteer: DataFrame) -> DataFrame:
    """(entity_group, word, score, _run): listed phrases and their words; none of them empty."""
    return gazetteer.select(
        "entity_group",
        F.col("phrase").alias("word"),
        F.col("score").cast("double").alias("score"),
        F.array_join(tokens(F.col("phrase")), " ").alias("_run"),
    ).where("_run <> ''")
