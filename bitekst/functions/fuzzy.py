"""Best partial similarity of a short string inside a longer one.

Similarity is the normalised indel ratio ``2 * LCS / (len a + len b)``, taken over all windows of
the longer string that are as long as the shorter one, and over the shorter windows at both ends.
Built-in ``levenshtein`` is another measure, hence an Arrow UDF; it runs only for terms that an
exact whole-word check has not found.

Where only a threshold matters, most windows are ruled out beforehand: the common subsequence is no
longer than the characters that both have, each counted as often as in the poorer one. Alone, a term has
these counts slide over the text. The terms of many texts are rated together: the windows that hold a
character are bits of machine words, which all terms of these texts share, and the characters that
windows lack are counted in bits for all terms of one length at once.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Bits of a state word: half of the machine word, so that a sum cannot overflow.
WORD = 32


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def _lcs_of_windows(short: np.ndarray, padded: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Longest common subsequence of ``short`` with every window of its length, or those that begin
    at the places ``at``, all at once.

    Bit-parallel recurrence, one bit per character of ``short`` in words of 32 bits; the sum of a
    step carries from word to word. Memory grows with (length / 32) times the length of the text.
    """
    m, count = len(short), len(padded) - len(short) + 1
    if at is not None:
        count = len(at)
    words = -(-m // WORD)
    masks = np.zeros((words, len(padded)), dtype=np.uint64)
    for i, code in enumerate(short):
        masks[i // WORD, padded == code] |= np.uint64(1 << (i % WORD))
    full, shift = np.uint64((1 << WORD) - 1), np.uint64(WORD)
    state = np.full((words, count), full)
    for j in range(m):
        carry = np.uint64(0)
        for w in range(words):
            hit = state[w] & (masks[w, j : j + count] if at is None else masks[w, at + j])
            total = state[w] + hit + carry
            carry = total >> shift
            state[w] = (total | (state[w] - hit)) & full
    state[-1] |= full & ~np.uint64((1 << (m - (words - 1) * WORD)) - 1)
    return np.bitwise_count(~state & full).sum(axis=0).astype(np.int64)


def _best_ratio(short: np.ndarray, long: np.ndarray) -> float:
    m = len(short)
    # Cut-off windows at the ends are full windows over a text padded with a code no text has.
    pad = np.full(m - 1, 0xFFFFFFFF, dtype=np.uint32)
    common = _lcs_of_windows(short, np.concatenate([pad, long, pad]))
    sizes = np.minimum(np.arange(1, len(common) + 1), m)
    sizes = np.minimum(sizes, sizes[::-1])
    return float((2.0 * common / (m + sizes)).max())


def _shared(short: np.ndarray, padded: np.ndarray) -> np.ndarray:
    """Characters that ``short`` shares with every window of its length, as multisets."""
    m = len(short)
    total = np.zeros(len(padded) - m + 1, dtype=np.int64)
    for code, count in zip(*np.unique(short, return_counts=True)):
        running = np.concatenate([[0], np.cumsum(padded == code)])
        total += np.minimum(running[m:] - running[:-m], count)
    return total


def _reaches(short: np.ndarray, long: np.ndarray, threshold: float) -> tuple[bool, int, int]:
    m = len(short)
    pad = np.full(m - 1, 0xFFFFFFFF, dtype=np.uint32)
    padded = np.concatenate([pad, long, pad])
    shared = _shared(short, padded)
    sizes = np.minimum(np.arange(1, len(shared) + 1), m)
    sizes = np.minimum(sizes, sizes[::-1])
    (at,) = np.nonzero(2.0 * shared / (m + sizes) >= threshold)
    if not len(at):
        return False, len(shared), 0
    common = _lcs_of_windows(short, padded, at)
    return bool((2.0 * common / (m + sizes[at]) >= threshold).any()), len(shared), len(at)


def reaches(a: str, b: str, threshold: float) -> tuple[bool, int, int]:
    """Whether ``partial_ratio(a, b)`` reaches the threshold; the number of windows, and of those that
    shared characters did not rule out."""
    if not a or not b:
        return float(a == b) >= threshold, 0, 0
    short, long = (_codes(x) for x in sorted((a, b), key=len))
    found, windows, left = _reaches(short, long, threshold)
    if len(short) == len(long):
        again = _reaches(long, short, threshold)
        found, windows, left = found or again[0], windows + again[1], left + again[2]
    return found, windows, left


# Longest term that is rated with the others of its text: the state of a comparison is one machine word.
TOGETHER = 64
# Windows that are compared at once.
WINDOWS = 1 << 15
# Places of a machine word, and words held at a time: of a character's places, and of pairs of term and text.
PLACES, HELD, ASKED = 64, 1 << 18, 1 << 16
# Texts that are rated at once, and rows that are Python objects at a time.
TEXTS, ROWS = 256, 1024


def _least(m: int, threshold: float) -> np.ndarray:
    """Characters that a window of 0 to ``m`` characters has to share with a term of ``m``."""
    size, every = np.arange(m + 1), np.arange(m + 1)
    enough = 2.0 * every[None] / (m + size[:, None]) >= threshold
    return np.where(enough.any(axis=1), enough.argmax(axis=1), m + 1)


def _common(short: np.ndarray, windows: np.ndarray, band: int) -> np.ndarray:
    """Longest common subsequences of pairs of equal length (a column each), one bit per character. Those that
    lack up to ``band`` characters are exact, as no character of theirs moves further; others may come out shorter."""
    m, count = short.shape
    word = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if m <= 8 * np.dtype(t).itemsize)
    bits = [word(1 << i) for i in range(m)]
    state = np.full(count, np.iinfo(word).max, word)
    for j in range(m):
        near = range(max(j - band, 0), min(j + band + 1, m))
        same = short[near.start : near.stop] == windows[j]
        hit = np.zeros(count, word)
        for i in near:
            hit |= same[i - near.start] * bits[i]
        hit &= state
        state = (state + hit) | (state - hit)
    return np.bitwise_count(~state & word((1 << m) - 1)).astype(np.int64)


class _Terms:
    """The different terms of one length in a group of texts, and the pairs of term and text."""

    def __init__(self, m: int, terms: list[str], letter: np.ndarray):
        self.m = m
        codes = letter[_codes("".join(terms))].reshape(-1, m)
        self.codes = np.ascontiguousarray(codes.T)
        # Every character of a term with the number of its equals before it: so often a window has to have it.
        self.chars = np.sort(codes, axis=1).astype(np.int64)
        self.level = np.zeros_like(self.chars)
        for j in range(1, m):
            again = self.chars[:, j] == self.chars[:, j - 1]
            self.level[:, j] = np.where(again, self.level[:, j - 1] + 1, 0)


def _ends(texts: list[np.ndarray], most: int, letters: int) -> tuple[np.ndarray, np.ndarray]:
    """First ``most`` codes of every text, and how often every character is among the first 1, 2, ..."""
    head = np.zeros((len(texts), most), np.int64)
    for i, t in enumerate(texts):
        head[i, : min(most, len(t))] = t[:most]
    seen = np.zeros((len(texts), most, letters + 1), np.uint8)
    np.put_along_axis(seen, head[:, :, None], 1, axis=2)
    return head, np.cumsum(seen, axis=1, dtype=np.uint8)


def _rate_group(jobs: list[tuple[list[str], str]], threshold: float, least: dict, out: list[list]) -> None:
    """What :func:`reaches` says of every term of every text, for texts whose bits are held at once.

    A character's places are the bits of machine words, and a text begins a word. The places at which a
    window of m has a character once, twice and so on follow from those of m - 1 and the character's
    places, moved by one bit for every m; all characters take part in one operation. The characters that
    a window lacks are then counted in bits, too, up to the number that the threshold allows, for all
    pairs of term and text of one length together.
    """
    wanted: dict[int, dict[str, list[tuple[int, int]]]] = {}
    for d, (terms, text) in enumerate(jobs):
        for i, t in enumerate(terms):
            wanted.setdefault(len(t), {}).setdefault(t, []).append((d, i))
    alphabet = sorted({c for same in wanted.values() for t in same for c in t})
    code = np.uint8 if len(alphabet) < 256 else np.uint16 if len(alphabet) < 65536 else np.uint32
    points = _codes("".join(alphabet))
    letter = np.zeros(0x110000, code)
    letter[points] = np.arange(1, len(alphabet) + 1)
    groups = {m: _Terms(m, list(same), letter) for m, same in sorted(wanted.items())}
    often = np.zeros(len(alphabet) + 1, np.int64)
    for g in groups.values():
        np.maximum.at(often, g.chars.ravel(), g.level.ravel() + 1)
    # Characters are numbered anew by how often a term has them, so that those it has twice come first.
    number = np.zeros(len(alphabet) + 1, np.int64)
    number[1 + np.argsort(-often[1:], kind="stable")] = np.arange(1, len(alphabet) + 1)
    letter[points] = number[1:]
    for g in groups.values():
        g.codes, g.chars = number.astype(code)[g.codes], number[g.chars]
    counts = [int((often > k).sum()) for k in range(int(often.max()))]
    begins = np.cumsum([0, *counts])

    texts = [letter[_codes(text)] for _, text in jobs]
    size = np.array([len(t) for t in texts])
    words = -(-size // PLACES)
    first = np.cumsum(words) - words
    total = int(words.sum())
    padded = np.zeros(total * PLACES + max(groups), code)
    for t, at in zip(texts, first.tolist()):
        padded[at * PLACES : at * PLACES + len(t)] = t
    places = np.empty((len(alphabet), total), np.uint64)
    for c in range(len(alphabet)):
        places[c] = np.packbits(padded[: total * PLACES] == c + 1, bitorder="little").view("<u8")
    inside = np.zeros((int(begins[-1]), total), np.uint64)
    ends = [_ends(x, max(groups) - 1, len(alphabet)) for x in (texts, [t[::-1] for t in texts])]

    for m in range(1, max(groups) + 1):
        for k in range(len(counts) - 1, 0, -1):
            n = counts[k]
            inside[begins[k] : begins[k] + n] |= inside[begins[k - 1] : begins[k - 1] + n] & places[:n]
        inside[: counts[0]] |= places
        if m in groups:
            if m not in least:
                least[m] = _least(m, threshold)
            asked = [(k, d, i) for k, same in enumerate(wanted[m].values()) for d, i in same]
            term, text, where = (np.array(x) for x in zip(*asked))
            found, compared = _inner(groups[m], term, first[text], size[text], inside, begins, padded, least[m])
            for (head, seen), back in zip(ends, (False, True)):
                _outer(groups[m], term, text, head, seen, back, least[m], found, compared)
            for d, i, f, w, c in zip(text.tolist(), where.tolist(), found.tolist(), (size[text] + m - 1).tolist(), compared.tolist()):
                out[d][i] = f, w, c
        carried = places[:, 1:] << np.uint64(PLACES - 1)
        places >>= np.uint64(1)
        places[:, :-1] |= carried


def _inner(
    group: _Terms, term: np.ndarray, first: np.ndarray, size: np.ndarray, inside: np.ndarray, begins: np.ndarray,
    padded: np.ndarray, least: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """(found, compared) of the pairs of term and text by the windows that lie within the text."""
    m, total = group.m, inside.shape[1]
    found, compared = np.zeros(len(term), bool), np.zeros(len(term), np.int64)
    lacks = m - int(least[m])
    if lacks < 0:
        return found, compared
    rows = (begins[group.level] + group.chars - 1) * total
    flat = inside.reshape(-1)
    windows = size - m + 1
    held = -(-windows // PLACES)
    behind = np.cumsum(held)
    start = 0
    while start < len(term):
        stop = max(start + 1, int(np.searchsorted(behind, behind[start] - held[start] + ASKED, "right")))
        some = slice(start, stop)
        n = held[some]
        begin = np.cumsum(n) - n
        word = np.repeat(first[some] - begin, n) + np.arange(int(n.sum()))
        # at[k]: places whose windows lack k characters at most of those looked at
        at = [np.full(len(word), np.uint64(0xFFFFFFFFFFFFFFFF)) for _ in range(lacks + 1)]
        for j in range(m):
            there = flat[np.repeat(rows[term[some], j], n) + word]
            for k in range(min(j, lacks), 0, -1):
                at[k] &= there
                at[k] |= at[k - 1]
            at[0] &= there
        left = at[lacks]
        over = (n * PLACES - windows[some]).astype(np.uint64)
        left[begin + n - 1] &= np.uint64(0xFFFFFFFFFFFFFFFF) >> over
        compared[some] = np.add.reduceat(np.bitwise_count(left), begin, dtype=np.int64)

        (full,) = np.nonzero(left)
        eights = left[full].astype("<u8").view(np.uint8)
        (some8,) = np.nonzero(eights)
        row, place = np.divmod(np.flatnonzero(np.unpackbits(eights[some8], bitorder="little")), 8)
        row, place = some8[row] // 8, some8[row] % 8 * 8 + place
        pair = np.repeat(np.arange(start, stop), n)[full][row]
        at_ = word[full][row] * PLACES + place
        same = np.ones(len(pair), bool)
        for j in range(m):
            same &= padded[at_ + j] == group.codes[j, term[pair]]
        found[pair[same]] = True
        if lacks:
            open_ = ~found[pair]
            pair, at_ = pair[open_], at_[open_]
            for k in range(0, len(pair), WINDOWS):
                cut = slice(k, k + WINDOWS)
                text = padded[at_[cut] + np.arange(m)[:, None]]
                good = _common(group.codes[:, term[pair[cut]]], text, lacks) >= least[m]
                found[pair[cut][good]] = True
        start = stop
    return found, compared


def _outer(
    group: _Terms, term: np.ndarray, text: np.ndarray, head: np.ndarray, seen: np.ndarray, back: bool,
    least: np.ndarray, found: np.ndarray, compared: np.ndarray,
) -> None:
    """The same by the shorter windows at one end of the texts; from the end on, if ``back``."""
    m = group.m
    for size in range(1, m):
        if least[size] > size:
            continue
        shared = (seen[text[:, None], size - 1, group.chars[term]] > group.level[term]).sum(axis=1)
        likely = shared >= least[size]
        compared += likely
        (open_,) = np.nonzero(likely & ~found)
        for k in range(0, len(open_), WINDOWS):
            pair = open_[k : k + WINDOWS]
            window = np.zeros((m, len(pair)), group.codes.dtype)
            window[:size] = head[text[pair], :size][:, ::-1].T if back else head[text[pair], :size].T
            found[pair] = _common(group.codes[:, term[pair]], window, m) >= least[size]


def rate_texts(jobs: list[tuple[list[str], str]], threshold: float, least: dict) -> list[list[tuple[bool, int, int]]]:
    """What :func:`reaches` says of all terms of every text; ``least`` keeps what holds for any text."""
    out: list[list] = []
    held: list[tuple[list[str], str]] = []
    mine: list[list] = []
    letters: set[str] = set()
    words = 0

    def rate() -> None:
        if held:
            _rate_group([job for job, _ in held], threshold, least, [found for _, found in held])

    for terms, text in jobs:
        found: list = [None] * len(terms)
        out.append(found)
        together = []
        for i, t in enumerate(terms):
            if 0 < len(t) <= TOGETHER and len(t) < len(text):
                together.append(i)
            else:
                found[i] = reaches(t, text, threshold)
        if not together:
            continue
        these, n = letters.union(*(terms[i] for i in together)), -(-len(text) // PLACES)
        if held and (len(held) == TEXTS or len(these) * (words + n) > HELD):
            rate()
            held, words, these = [], 0, set().union(*(terms[i] for i in together))
        letters, words = these, words + n
        held.append((([terms[i] for i in together], text), mine_ := [None] * len(together)))
        mine.append((found, together, mine_))
    rate()
    for found, together, mine_ in mine:
        for i, r in zip(together, mine_):
            found[i] = r
    return out


def _rate(terms: list[str], text: str, threshold: float, least: dict) -> list[tuple[bool, int, int]]:
    return rate_texts([(terms, text)], threshold, least)[0]


def rate_rows(terms: pa.ListArray, text: pa.Array, threshold: float) -> list[list[tuple[bool, int, int]]]:
    """What :func:`reaches` says of the terms of every row; the rows of a batch become Python objects a
    part at a time."""
    least: dict = {}
    rated: list = []
    for start in range(0, len(text), ROWS):
        part = slice(start, start + ROWS)
        jobs = [(ts or [], x or "") for ts, x in zip(terms[part].to_pylist(), text[part].to_pylist())]
        rated += rate_texts(jobs, threshold, least)
    return rated


def similar_terms(terms: Column, text: Column, threshold: float) -> Column:
    """Struct of three arrays for the terms of a row: whether the row's text has a similar enough
    passage, its windows, and how many of them had to be compared."""
    kind = T.StructType().add("found", T.ArrayType(T.BooleanType()))
    kind = kind.add("windows", T.ArrayType(T.LongType())).add("compared", T.ArrayType(T.LongType()))

    @F.arrow_udf(kind)
    def rate(terms: pa.Array, text: pa.Array) -> pa.Array:
        return as_lists(rate_rows(terms, text, threshold), kind.names, [pa.bool_(), pa.int64(), pa.int64()])

    return rate(terms, text)


def as_lists(rows: list[list[tuple]], names: list[str], kinds: list[pa.DataType]) -> pa.StructArray:
    """A list of tuples in each row as a struct of lists."""
    offsets = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
    columns = list(zip(*chain.from_iterable(rows))) or [[]] * len(names)
    lists = [pa.ListArray.from_arrays(offsets, pa.array(c, kind)) for c, kind in zip(columns, kinds)]
    return pa.StructArray.from_arrays(lists, names)


def partial_ratio(a: str, b: str) -> float:
    """0..1; 1 when the shorter string occurs in the longer one."""
    if not a or not b:
        return float(a == b)
    short, long = sorted((a, b), key=len)
    if short in long:
        return 1.0
    best = _best_ratio(_codes(short), _codes(long))
    if len(short) == len(long):
        best = max(best, _best_ratio(_codes(long), _codes(short)))
    return best
