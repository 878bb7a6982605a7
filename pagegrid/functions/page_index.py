"""Look-ups inside one page: which lines hold a text, and which tokens a row text lacks.

Plain Python over the values of one page, run by Arrow batches inside Spark's tasks. It has no
state beyond a page.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable
from itertools import accumulate

#: Characters of an index entry; texts that are looked up have as many or more.
GRAM = 4
#: Lines up to which looking at each is cheaper than an index.
FEW = 128
#: Characters of a text up to which searching it is cheaper than a set of its substrings.
SHORT = 256


def grams(text: str) -> set[str]:
    return {text[k : k + GRAM] for k in range(len(text) - GRAM + 1)}


class LineIndex:
    """Lines of a page by the 4-grams of the texts that will be asked for.

    Building it passes over every line once. A text is looked up by intersecting the postings of
    its grams, shortest first, and verified on the lines that are left.
    """

    def __init__(self, lines: list[str], asked: Iterable[str]) -> None:
        self.lines = lines
        self.found: dict[str, list[int]] = {}
        self.postings: dict[str, list[int]] = {}
        self.few = len(lines) <= FEW
        if self.few:
            self.text = "\n".join(lines)
            self.starts = list(accumulate((len(line) + 1 for line in lines), initial=0))
        else:
            self.postings = {g: [] for text in set(asked) for g in grams(text)}
            needed = self.postings.keys()
            for number, line in enumerate(lines):
                for gram in grams(line) & needed:
                    self.postings[gram].append(number)

    def holding(self, text: str) -> list[int]:
        """Numbers of the lines that contain a text of ``GRAM`` characters or more, ascending."""
        known = self.found.get(text)
        if known is not None:
            return known
        if self.few:
            self.found[text] = self._searched(text)
        else:
            lists = sorted((self.postings[g] for g in grams(text)), key=len)
            left = lists[0]
            for more in lists[1:]:
                if len(left) * 4 < len(more):
                    break
                left = sorted(set(left).intersection(more))
            self.found[text] = [k for k in left if text in self.lines[k]]
        return self.found[text]

    def _searched(self, text: str) -> list[int]:
        """The lines that hold a text, sought in all lines at once."""
        if "\n" in text:
            return [k for k, line in enumerate(self.lines) if text in line]
        found = []
        find, starts = self.text.find, self.starts
        at = find(text)
        while at >= 0:
            after = bisect_right(starts, at)
            found.append(after - 1)
            at = find(text, starts[after])
        return found

    def related(self, signature: list[str]) -> list[int]:
        """Lines with more than half of one to three parts: the only one, or any two."""
        if len(signature) == 1:
            return self.holding(signature[0])
        if self.few:
            # A third part counts on lines that hold just one of the first two.
            one, two = self.holding(signature[0]), self.holding(signature[1])
            if one == two:
                return one
            both = [k for k in two if k in one]
            for third in signature[2:]:
                lines = self.lines
                both += [k for k in {*one}.symmetric_difference(two) if third in lines[k]]
                both.sort()
            return both
        seen: set[int] = set()
        twice: set[int] = set()
        for part in signature:
            lines = set(self.holding(part))
            twice |= seen & lines
            seen |= lines
        return sorted(twice)


class Substrings:
    """The substrings of a text, by length, made when a length is first asked for."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.by_length: dict[int, set[str]] = {}

    def __contains__(self, token: str) -> bool:
        text = self.text
        if len(text) <= SHORT:
            return token in text
        size = len(token)
        known = self.by_length.get(size)
        if known is None:
            known = {text[k : k + size] for k in range(len(text) - size + 1)}
            self.by_length[size] = known
        return token in known

    def without(self, tokens: Iterable[str]) -> list[str]:
        """The tokens that do not occur in the text, in their order."""
        text = self.text
        if len(text) <= SHORT:
            return [t for t in tokens if t not in text]
        return [t for t in tokens if t not in self]
