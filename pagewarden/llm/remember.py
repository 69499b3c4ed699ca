"""Results by string that a Python worker remembers from one batch to the next."""

from __future__ import annotations

from collections.abc import Callable

# Strings remembered with their results, twice so many at most for each Python worker.
REMEMBERED = 200_000
# Longer strings are rare and are not remembered.
LONGEST = 64


class Remembered:
    """`work` of strings, many at a time. Of what is forgotten, the lately used half stays."""

    def __init__(self, work: Callable[[list[str]], list[bytes]], most: int = REMEMBERED):
        self.work, self.most = work, most
        self.lately: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def look(self, strings: list[str]) -> list[bytes]:
        """The results of all these strings, in order."""
        found = list(map(self.lately.get, strings))
        missing = [i for i, result in enumerate(found) if result is None]
        if missing:
            result_of = self.learn({strings[i] for i in missing})
            for i in missing:
                found[i] = result_of(strings[i])
        return found

    def learn(self, wanted: set[str]) -> Callable[[str], bytes]:
        """What looks up the results of all these strings, until the next call."""
        if len(self.lately) >= self.most:
            self.lately, self.older = {}, self.lately
        unknown, older = [], self.older
        for string in wanted.difference(self.lately):
            if string in older:
                self.lately[string] = older[string]
            else:
                unknown.append(string)
        found = dict(zip(unknown, self.work(unknown)))
        long = {string: found.pop(string) for string in unknown if len(string) > LONGEST}
        self.lately.update(found)
        if not long:
            return self.lately.__getitem__
        lately = self.lately
        return lambda string: long[string] if string in long else lately[string]
