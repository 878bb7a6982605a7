"""A trie of terms, and Levenshtein automata that walk it (no Spark)."""

from __future__ import annotations

import string

#: Edits allowed, and least length of the terms they are allowed in.
LEAST_LENGTH = ((1, 5), (2, 9))
STRIPPED = string.punctuation + "«»“”„‘’…¡¿"


def _trie(terms: dict[str, str]) -> dict:
    """Nested letters; the empty letter holds the term that ends there."""
    root: dict = {}
    for spelling, term in terms.items():
        node = root
        for letter in spelling:
            node = node.setdefault(letter, {})
        node[""] = term
    return root


class Lexicon:
    """Terms with weights, found in text exactly or within a few edits.

    One edit leaves the first or the last half of a word as it is, so the automaton starts
    where the intact part leads in the trie, or in the trie of the reversed terms. Two edits
    are allowed in long terms whose first or last third is intact. ``ordinary`` words are
    known to be harmless and never count as misspellings.
    """

    def __init__(self, terms: dict[str, float], ordinary: frozenset[str] = frozenset()) -> None:
        self.terms, self.ordinary = terms, ordinary
        self.forward = _trie({t: t for t in terms})
        self.backward = _trie({t[::-1]: t for t in terms})

    def nearest(self, word: str) -> tuple[str, int] | None:
        """The term with the fewest edits to the word, and that number; None if none is near."""
        if word in self.terms:
            return word, 0
        if word in self.ordinary:
            return None
        for edits, least in LEAST_LENGTH:
            intact = (len(word) - edits) // (edits + 1)
            if len(word) < least - edits or intact < 1:
                return None
            found = [
                term
                for trie, letters in ((self.forward, word), (self.backward, word[::-1]))
                if (node := self._follow(trie, letters[:intact])) is not None
                for term in self._walk(node, letters[intact:], edits)
                if len(term) >= least
            ]
            if found:
                return min(found), edits
        return None

    @staticmethod
    def _follow(node: dict | None, letters: str) -> dict | None:
        for letter in letters:
            node = node.get(letter) if node else None
        return node

    @staticmethod
    def _walk(root: dict, word: str, edits: int) -> list[str]:
        """Terms below a node whose remaining letters are within some edits of the word.

        State k of the automaton is a set of places of the word, as bits, that k edits can
        have reached; a branch of the trie is left when all sets are empty.
        """
        size = len(word)
        full, found = (1 << size + 1) - 1, []
        letters: dict[str, int] = {}
        for k, letter in enumerate(word):
            letters[letter] = letters.get(letter, 0) | 1 << k
        # Up to k letters of the word may be dropped at once.
        stack = [(root, tuple((1 << k + 1) - 1 & full for k in range(edits + 1)))]
        while stack:
            node, states = stack.pop()
            for letter, child in node.items():
                if not letter:
                    if any(s >> size & 1 for s in states):
                        found.append(child)
                    continue
                mask, after = letters.get(letter, 0), []
                for k, state in enumerate(states):
                    new = (state & mask) << 1
                    if k:  # a letter of the term too many, another letter, or one too few
                        new |= states[k - 1] | states[k - 1] << 1 | after[k - 1] << 1
                    after.append(new & full)
                if any(after):
                    stack.append((child, tuple(after)))
        return found

    def look_up(self, token: str) -> tuple[str, int] | None:
        """``nearest`` of a token without the punctuation around it."""
        word = token.strip(STRIPPED)
        return self.nearest(word) if word else None
