"""Many terms in one walk over a text.

Terms and texts are cut at word boundaries into pieces, and a trie over pieces with failure links
finds all terms of a text, with their places, in one pass whose time does not depend on the number of
terms. It is sent to the workers as the list of terms and built once in each of them.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa

# Runs of word and of other characters in turn; letters, digits and the underscore make words.
_PIECES = re.compile(r"\w+|\W+")


def is_word(piece: str) -> bool:
    return piece[0] == "_" or piece[0].isalnum()


class Patterns:
    """Terms of a table with columns ``term``, ``ord`` and what else is needed with a hit."""

    def __init__(self, table: pa.Table, start: str, end: str):
        self.table, self.start, self.end = table, start, end
        self.trie = None

    def __getstate__(self):
        return {**self.__dict__, "trie": None}

    def build(self) -> None:
        self.terms = self.table["term"].to_pylist()
        cut = [_PIECES.findall(t) for t in self.terms]
        after: list[dict[str, int]] = [{}]
        ends: list[list[int]] = [[]]
        for term, pieces in enumerate(cut):
            state = 0
            for piece in pieces:
                if piece not in after[state]:
                    after[state][piece] = len(after)
                    after.append({})
                    ends.append([])
                state = after[state][piece]
            ends[state].append(term)
        # A failure link leads to the longest other state whose pieces end the same way, `more` to the
        # next one on that way at which a term ends.
        fail, more = [0] * len(after), [0] * len(after)
        queue = deque(after[0].values())
        while queue:
            state = queue.popleft()
            for piece, below in after[state].items():
                back = fail[state]
                while back and piece not in after[back]:
                    back = fail[back]
                fail[below] = after[back].get(piece, 0)
                more[below] = fail[below] if ends[fail[below]] else more[fail[below]]
                queue.append(below)
        self.sizes = [len(p) for p in cut]
        self.opens, self.closes = [is_word(p[0]) for p in cut], [is_word(p[-1]) for p in cut]
        orders = self.table["ord"].to_pylist()
        self.rank = {t: i for i, t in enumerate(sorted(range(len(cut)), key=lambda t: (-len(self.terms[t]), orders[t], self.terms[t])))}
        # Terms with a sign or the word of the mark occur once something is marked, beside the first
        # other word that they have.
        mark = _PIECES.findall(self.start.lower())
        signs, (name,) = set("".join(p for p in mark if not is_word(p))), [p for p in mark if is_word(p)]
        self.special = {
            t: next((p for p in cut[t] if is_word(p) and p != name), None)
            for t in range(len(cut))
            if name in cut[t] or signs & set(self.terms[t])
        }
        self.trie = after, ends, fail, more

    def hits(self, pieces: list[str], first: int, last: int) -> Iterator[tuple[int, int]]:
        """(term, number of the piece behind it) of all terms within pieces first to last."""
        if self.trie is None:
            self.build()
        after, ends, fail, more = self.trie
        begin = after[0].get
        state = 0
        for at in range(first, last):
            piece = pieces[at]
            while state and piece not in after[state]:
                state = fail[state]
            state = after[state][piece] if state else begin(piece, 0)
            if not state:
                continue
            here = state if ends[state] else more[state]
            while here:
                for term in ends[here]:
                    yield term, at + 1
                here = more[here]

    @staticmethod
    def inner(pieces: list[str]) -> tuple[int, int]:
        """The pieces without other characters at the ends of the text, where no term can stand."""
        first, last = 0, len(pieces)
        if first < last and not is_word(pieces[0]):
            first += 1
        if first < last and not is_word(pieces[-1]):
            last -= 1
        return first, last

    def found(self, texts: pa.Array) -> pa.Array:
        """For each text the rows of the table whose terms it has."""
        offsets, rows = [0], []
        for text in texts:
            rows += self.terms_of(text.as_py())
            offsets.append(len(rows))
        table = self.table.combine_chunks().to_struct_array().combine_chunks()
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), table.take(pa.array(rows, pa.int64())))

    def terms_of(self, text: str | None) -> dict[int, None]:
        """The different terms of a text in the order of their ends."""
        pieces = _PIECES.findall((text or "").lower())
        return dict.fromkeys(t for t, _ in self.hits(pieces, *self.inner(pieces)))

    def marked(self, text: str | None, nested: bool) -> tuple[str | None, list[int]]:
        """The text with its terms marked; or terms that have to be marked one after the other, as
        some of them can occur in a mark."""
        if text is None:
            return None, []
        lower = text.lower()
        if len(lower) == len(text):
            own = pieces = _PIECES.findall(lower)
        else:
            own = _PIECES.findall(text)
            pieces = [p.lower() for p in own]
        places: dict[int, list[int]] = {}
        for term, behind in self.hits(pieces, *self.inner(pieces)):
            places.setdefault(term, []).append(behind - self.sizes[term])
        if not places:
            return text, []
        if nested and self.special:
            there = set(pieces)
            tried = [t for t, word in self.special.items() if word is None or word in there]
            if tried:
                return text, sorted({*places, *tried}, key=self.rank.get)
        spans = self.nested(places) if nested else self.leftmost(places)
        return self.spliced(text, own, pieces, spans, nested), []

    def nested(self, places: dict[int, list[int]]) -> list[tuple[int, int]]:
        """Spans in the order in which they are marked: long terms first. A mark that is there cuts a
        term that reaches over its end, and one with other characters at that end."""
        spans, cuts = [], set()
        for term in sorted(places, key=self.rank.get):
            size, free, mine = self.sizes[term], 0, []
            for at in places[term]:
                behind = at + size
                if at < free or any(i in cuts for i in range(at + 1, behind)):
                    continue
                if at in cuts and not self.opens[term] or behind in cuts and not self.closes[term]:
                    continue
                mine.append((at, behind))
                free = behind
            spans += mine
            for span in mine:
                cuts.update(span)
        return spans

    def leftmost(self, places: dict[int, list[int]]) -> list[tuple[int, int]]:
        spans, free = [], 0
        order = sorted((at, self.rank[t], at + self.sizes[t]) for t, ats in places.items() for at in ats)
        for at, _, behind in order:
            if at >= free:
                spans.append((at, behind))
                free = behind
        return spans

    def spliced(self, text: str, own: list[str], pieces: list[str], spans: list, lower: bool) -> str:
        """The text with marks around the spans; later spans lie within earlier ones or beside them."""
        before, behind = {}, {}
        inside = set()
        for first, last in spans:
            before[first] = before.get(first, 0) + 1
            behind[last] = behind.get(last, 0) + 1
            if lower:
                inside.update(range(first, last))
        out, at = [], 0
        for i, piece in enumerate(own):
            out.append(self.end * behind.get(i, 0) + self.start * before.get(i, 0))
            out.append(pieces[i] if i in inside else text[at : at + len(piece)])
            at += len(piece)
        out.append(self.end * behind.get(len(own), 0))
        return "".join(out)
