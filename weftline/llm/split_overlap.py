"""Records of the evaluation splits that also occur, exactly or nearly, in the training split.

Bodies are normalised to words. Records of one payload, and bodies equal word for word, are one text, so copies cost
nothing. Each evaluation text is held against each training text whose length allows a pair: bitmaps of the words, then
their bags, then the bags of their parts, are bounds that hold for all texts, and the longest common subsequence of words decides. Up to there
a word is a number of 16 bits, which can only make texts more alike; the pairs that are left are decided again on
their words. For them an Aho-Corasick automaton over the passages of a shard of evaluation
texts scans the training texts, and the matched intervals are merged into the coverage of each evaluation text.
Nothing is sampled and no passage in common is asked for.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.names import site as site_of
from weftline.functions.names import split_name
from weftline.llm.hashing import mixed
from weftline.llm.main_body import body_flags
from weftline.llm.pages import key_of, page_lines, page_of, with_marks
from weftline.session import Scratch

SHORTEST, LONGEST = 2, 10  # words of a passage
COMMON = 3  # of the texts given, in which and more a run is common
RELATED = 0.2  # of two texts' runs of LONGEST words, if in both, make them variants
TABLE_BITS = 23  # of the table of common runs, 1 MB; runs that meet there by chance count as common, in all texts alike
PASSAGES = 64  # of a text, those of least hash, if no other number is asked for
BITS = 4096  # of the bitmap of a text's words
HELD_PASSAGES = 40_000  # about so many stand in one automaton
HELD = 8_192  # training texts whose coverage waits for one automaton
HELD_WORDS = 10_000_000  # of evaluation texts that a task holds at once, about; each takes some 7 bytes
WORK = 500_000_000  # pairs of texts for one task, about; four tenths or so are within the length bound
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+")
_PLAIN = re.compile(r"[^\W_]+")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿]")


def body_words(text: str) -> list[str]:
    """Words in lower case without punctuation; a character of a script without blanks is a word."""
    folded = text.casefold()
    return _WORD.findall(folded) if _WIDE.search(folded) else _PLAIN.findall(folded)


def _word_hashes(words: list[str]) -> np.ndarray:
    return _runs([" ".join(words)])[0]


def _runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts on end, the number of each word's text, and how many words of it are left from there. Words stand between single blanks."""
    data = np.frombuffer("\n".join(texts).encode("utf-8", "surrogatepass"), np.uint8)
    inside = (data != 32) & (data != 10)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    start = np.flatnonzero(first)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(inside)
    begin = np.searchsorted(at, start)
    place = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    power = np.cumprod(np.full(int(place.max()) + 1, _BASE, np.uint64))
    words = mixed(np.add.reduceat((data[at].astype(np.uint64) + np.uint64(1)) * power[place], begin))
    owner = np.searchsorted(np.flatnonzero(data == 10), start)
    sizes = np.bincount(owner, minlength=len(texts))
    return words, owner, np.cumsum(sizes)[owner] - np.arange(len(words))


def _distinct(runs: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs in order, each once for each owner."""
    order = np.lexsort((owner, runs))
    runs, owner = runs[order], owner[order]
    once = np.ones(len(runs), bool)
    once[1:] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
    return runs[once], owner[once]


def _unrelated(runs: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """A label for each of n texts; texts with a good part (RELATED) of their long runs in common have one."""
    runs, owner = _distinct(runs, owner)
    own = np.bincount(owner, minlength=n)
    same = np.flatnonzero(runs[1:] == runs[:-1])
    pairs, count = np.unique(owner[same] * n + owner[same + 1], return_counts=True)
    label = np.arange(n)
    for pair, c in zip(pairs.tolist(), count.tolist()):
        a, b = divmod(pair, n)
        if c >= RELATED * min(own[a], own[b]):
            while label[a] != a:
                a = label[a]
            while label[b] != b:
                b = label[b]
            label[max(a, b)] = min(a, b)
    for i in range(n):  # labels point to smaller ones
        label[i] = label[label[i]]
    return label


def common_table(texts: list[str]) -> np.ndarray:
    """Bits of the runs that stand in COMMON texts and more which aren't variants of each other; for no texts, none."""
    words, owner, left = _runs(texts)
    table = np.zeros(1 << TABLE_BITS, bool)
    runs = [np.zeros(0, np.uint64)] * LONGEST
    run = np.zeros(len(words), np.uint64)
    for size in range(1, LONGEST + 1):
        runs[size - 1] = run = run[: max(0, len(words) - size + 1)] * _BASE + words[size - 1 :]
    whole = np.flatnonzero(left[: len(run)] >= LONGEST)
    label = _unrelated(run[whole], owner[whole], len(texts))
    for size, run in enumerate(runs, 1):
        fits = np.flatnonzero(left[: len(run)] >= size)
        found, count = np.unique(_distinct(run[fits], label[owner[fits]])[0], return_counts=True)
        table[(mixed(found[count >= COMMON] + np.uint64(size)) & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)] = True
    return np.packbits(table, bitorder="little")


def passages(texts: list[str], table: np.ndarray, most: int = PASSAGES, runs: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Passages of texts (number of the text, hash, first word, words), at most `most` of a text, those of least hash.

    A passage is the shortest run from a place that isn't common; a place where even a run of LONGEST words is
    has none. A text all of whose runs are common has its runs of LONGEST words, a shorter one its whole words.
    """
    words, owner, left = runs or _runs(texts)
    out_hash, out_at, out_size = [], [], []
    at, run = np.arange(len(words)), np.zeros(len(words), np.uint64)
    covered = np.zeros(len(texts), bool)
    for size in range(1, LONGEST + 1):
        fits = left[at] >= size
        at = at[fits]
        run = run[fits] * _BASE + words[at + size - 1]
        if size < SHORTEST:
            continue
        hashes = mixed(run + np.uint64(size))
        slot = hashes & np.uint64((1 << TABLE_BITS) - 1)
        common = (table[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        out_hash.append(hashes[~common])
        out_at.append(at[~common])
        out_size.append(np.full(int((~common).sum()), size))
        covered[owner[at[~common]]] = True
        if size == LONGEST:
            rest = ~covered[owner[at]]
            out_hash.append(hashes[rest])
            out_at.append(at[rest])
            out_size.append(np.full(int(rest.sum()), size))
            covered[owner[at[rest]]] = True
        at, run = at[common], run[common]
    hashes, starts, sizes = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_hash, out_at, out_size))
    owners = owner[starts] if len(starts) else starts
    # Most hashes are too large to be among the least of their text; which, depends on the text alone.
    count = np.bincount(owners, minlength=len(texts))
    low = hashes <= (np.minimum(1.0, 2.0 * most / np.maximum(1, count)) * float((1 << 64) - 2048)).astype(np.uint64)[owners] if len(hashes) else np.zeros(0, bool)
    hashes, starts, sizes, owners = hashes[low], starts[low], sizes[low], owners[low]
    order = np.lexsort((hashes, owners))
    hashes, starts, sizes, owners = hashes[order], starts[order], sizes[order], owners[order]
    once = np.ones(len(hashes), bool)
    once[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    hashes, starts, sizes, owners = hashes[once], starts[once], sizes[once], owners[once]
    begin = np.searchsorted(owners, np.arange(len(texts)))
    kept = np.arange(len(hashes)) - begin[owners] < most if len(hashes) else once
    first = np.searchsorted(owner, np.arange(len(texts)))
    hashes, starts, sizes, owners = hashes[kept], (starts - first[owners])[kept] if len(hashes) else starts, sizes[kept], owners[kept]
    rest = [t for t in range(len(texts)) if texts[t] and not covered[t]]
    if rest:
        hashes = np.append(hashes, np.array([key_of(texts[t]) for t in rest], np.int64).view(np.uint64))
        starts, sizes = np.append(starts, np.zeros(len(rest), np.int64)), np.append(sizes, [texts[t].count(" ") + 1 for t in rest])
        owners = np.append(owners, rest)
    return owners, hashes, starts, sizes


def common_words(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    at: dict[str, int] = defaultdict(int)
    for i, w in enumerate(a):
        at[w] |= 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & at.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def word_tokens(words: list[str]) -> np.ndarray:
    """Hashes of the words, each with the number of its occurrence: texts have as many in common as their bags of words."""
    return _numbered(_word_hashes(words), np.zeros(len(words), np.int64))[0]


def _numbered(ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the words of several texts, and the text of each."""
    order = np.lexsort((ids, owner))
    ids, owner = ids[order], owner[order]
    place = np.arange(len(ids))
    first = np.ones(len(ids), bool)
    first[1:] = (ids[1:] != ids[:-1]) | (owner[1:] != owner[:-1])
    nth = place - np.maximum.accumulate(np.where(first, place, 0))
    return mixed(ids + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), owner


def bitmaps(texts: list[str]) -> list[bytes]:
    """The bitmap of each text's words, of BITS bits."""
    return _bitmaps(*_runs(texts)[:2], len(texts))


def _bitmaps(words: np.ndarray, owner: np.ndarray, texts: int) -> list[bytes]:
    tokens, owner = _numbered(words, owner)
    bits = np.zeros((texts, BITS), bool)
    bits[owner, (tokens & np.uint64(BITS - 1)).astype(np.int64)] = True
    return [row.tobytes() for row in np.packbits(bits, axis=1, bitorder="little")]


def bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    """A set of tokens in `bits` bits, a power of two from 64. Two sets differ in at least as many tokens as their bitmaps in bits."""
    b = np.zeros(bits, np.uint8)
    b[tokens & np.uint64(bits - 1)] = 1
    return np.packbits(b, bitorder="little").view(np.uint64)


def folded(bitmaps: np.ndarray, times: int) -> np.ndarray:
    """Bitmaps of a `times`-th of the bits; what holds for bitmaps holds for them."""
    return np.bitwise_or.reduce(bitmaps.reshape(*bitmaps.shape[:-1], times, -1), axis=-2)


def places(words: list[str]) -> dict[str, int]:
    """The positions of each word, as bits."""
    at: dict[str, int] = defaultdict(int)
    for i, w in enumerate(words):
        at[w] |= 1 << i
    return at


def common_if(at: dict[str, int], n: int, words: list[str], least: int) -> int | None:
    """Length of the longest common subsequence of `words` and the n words at `at`; None as soon as it can't reach `least`."""
    full = row = (1 << n) - 1
    for start in range(0, len(words), 16):
        if n - row.bit_count() + len(words) - start < least:
            return None
        for w in words[start : start + 16]:
            if w in at:
                hit = row & at[w]
                row = ((row + hit) | (row - hit)) & full
    same = n - row.bit_count()
    return same if same >= least else None


class Automaton:
    """Aho-Corasick over the passages of a shard of evaluation texts."""

    def __init__(self, texts: dict[int, str], table: np.ndarray) -> None:
        marks = list(texts)
        owners: dict[str, list[tuple[int, int]]] = defaultdict(list)
        split = [texts[m].split(" ") for m in marks]
        self.sizes = {m: len(words) for m, words in zip(marks, split)}
        number, _, first, count = passages([texts[m] for m in marks], table, max(self.sizes.values(), default=1))
        for t, start, size in zip(number.tolist(), first.tolist(), count.tolist()):
            owners[" " + " ".join(split[t][start : start + size]) + " "].append((marks[t], start))
        self.search = ahocorasick.Automaton()
        for text, where in owners.items():
            self.search.add_word(text, (text.count(" ") - 1, where))
        if owners:
            self.search.make_automaton()
        self.empty = not owners

    def coverage(self, text: str) -> dict[int, float]:
        """For each evaluation text with a passage in `text`, the share of its words in the matched intervals, merged."""
        spans: dict[int, set[tuple[int, int]]] = defaultdict(set)
        if not self.empty:
            for _, (size, where) in self.search.iter(f" {text} "):
                for mark, start in where:
                    spans[mark].add((start, start + size))
        out = {}
        for mark, found in spans.items():
            covered = end = 0
            for lo, hi in sorted(found):
                covered += max(0, hi - max(lo, end))
                end = max(end, hi)
            out[mark] = covered / self.sizes[mark]
        return out


_BODY_ARROW = pa.schema([("raw_id", pa.int64()), ("site", pa.string()), ("size", pa.int32()), ("mark", pa.int64()), ("text", pa.string()), ("words", pa.int32())])
_BODY_DDL = "raw_id BIGINT, site STRING, size INT, mark BIGINT, text STRING, words INT"


def _body_batches(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                out: list[tuple] = []
                for raw_id, site, *record in zip(*(part.column(i).to_pylist() for i in range(7))):
                    page = page_of(*record)
                    body = " ".join(t for t, b in zip(page.texts, body_flags(page)) if b)
                    if len(body) >= least:
                        words = body_words(body)
                        text = " ".join(words)
                        out.append((raw_id, site, len(body), key_of(text), text, len(words)))
                columns = list(zip(*out)) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BODY_ARROW)], schema=_BODY_ARROW)

    return run


def normal_bodies(spark: SparkSession, raw: DataFrame, least: int) -> DataFrame:
    """(raw_id, site, size, mark, text, words) of the records whose body has at least `least` characters."""
    keep = Scratch(spark, "normal")
    pages = keep.put(page_lines(raw))
    # A body is part of its page's lines: a shorter page can't have one.
    out = keep.put(with_marks(pages, "site").where(F.length("lines") >= least).mapInArrow(_body_batches(least), _BODY_DDL))
    keep.drop(pages)
    return out


def most_apart(a: np.ndarray | int, b: np.ndarray | int, least_same: float) -> np.ndarray:
    """So many words of two texts of a and b words, at most, are not in the other, if the wanted share is."""
    return a + b - 2 * least_common(a, b, least_same)


def least_common(a: np.ndarray | int, b: np.ndarray | int, least_same: float) -> np.ndarray:
    """So many words at least must two texts of a and b words have in common."""
    return np.ceil(least_same * np.maximum(a, b) - 1e-9).astype(np.int64)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of stretches on end, and where each begins among them."""
    begin = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - begin, sizes), begin


def word_numbers(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number of 16 bits for each word of all texts on end, and the number of each word's text."""
    words, owner, _ = _runs(texts)
    return words.astype(np.uint16), owner


def _occurrences(numbers: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each word of texts of these sizes stands in its text before it, and after it."""
    before, after = np.empty(len(numbers), np.int32), np.empty(len(numbers), np.int32)
    ends = np.cumsum(sizes)
    for lo in range(0, len(sizes), 4096):  # keys of 16 bits are sorted by their digits
        part = slice(int(ends[lo] - sizes[lo]), int(ends[min(lo + 4096, len(sizes)) - 1]))
        own, owner = numbers[part], np.repeat(np.arange(len(sizes[lo : lo + 4096]), dtype=np.uint16), sizes[lo : lo + 4096])
        order = np.lexsort((own, owner))
        own, owner = own[order], owner[order]
        first = np.ones(len(own), bool)
        first[1:] = (own[1:] != own[:-1]) | (owner[1:] != owner[:-1])
        start = np.flatnonzero(first)
        times = np.diff(np.append(start, len(own)))
        place = np.arange(len(own)) - np.repeat(start, times)
        before[part][order] = place
        after[part][order] = np.repeat(times, times) - 1 - place
    return before, after


def _bags(numbers: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Tokens, of 16 bits, of words with the number of their occurrence: what texts have in common of them is no less than what they have of their words."""
    return mixed(numbers.astype(np.uint64) + before.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).astype(np.uint16)


class _Band:
    """Bitmaps of the evaluation texts of so many binary digits of words, shortest first."""

    def __init__(self, digits: int, first: int, sizes: np.ndarray, tokens: list[np.ndarray]) -> None:
        self.first, self.sizes = first, sizes
        self.bits = min(1 << 16, max(256, 1 << (digits + 3)))
        self.fine = np.stack([bitmap(t, self.bits) for t in tokens])
        self.coarse = np.ascontiguousarray(folded(self.fine, 4).T)

    def near(self, n: int, tokens: np.ndarray, least_same: float) -> np.ndarray:
        """Positions of the texts that a text of n words can match as far as bitmaps tell."""
        lo, hi = np.searchsorted(self.sizes, [math.ceil(least_same * n - 1e-9), math.floor(n / least_same + 1e-6) + 1])
        if lo >= hi:
            return np.zeros(0, np.int64)
        room = most_apart(self.sizes[lo:hi], n, least_same)
        mine = bitmap(tokens, self.bits)
        off = np.zeros(hi - lo, np.uint16)
        differ, few = np.empty(hi - lo, np.uint64), np.empty(hi - lo, np.uint8)
        coarse = folded(mine, 4)
        for start in range(0, len(coarse), 3):  # counts of three words fit 8 bits
            part = None
            for row, word in zip(self.coarse[start : start + 3], coarse[start : start + 3]):
                np.bitwise_xor(row[lo:hi], word, out=differ)
                if part is None:
                    part = np.bitwise_count(differ)
                else:
                    part += np.bitwise_count(differ, out=few)
            off += part
        near = np.flatnonzero(off <= room)
        if len(near):
            near = near[np.bitwise_count(self.fine[lo + near] ^ mine).sum(axis=1, dtype=np.int64) <= room[near]]
        return self.first + lo + near


class Held:
    """Evaluation texts (mark, text or the bytes of its word numbers) against which training texts are held."""

    def __init__(self, texts: list[tuple[int, str | bytes]], least_same: float) -> None:
        split = [(mark, word_numbers([t])[0] if isinstance(t, str) else np.frombuffer(t, np.uint16)) for mark, t in texts]
        split.sort(key=lambda e: (len(e[1]), e[0]))
        self.least_same = least_same
        self.marks, self.numbers = [e[0] for e in split], [e[1] for e in split]
        self.sizes = np.array([len(e) for e in self.numbers], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate(self.numbers)
        self.before, self.after = _occurrences(self.flat, self.sizes)
        self.tokens = _bags(self.flat, self.before)
        digits = np.array([int(n).bit_length() for n in self.sizes])
        each = np.split(self.tokens, self.starts[1:])
        self.bands = [_Band(int(d), int(at[0]), self.sizes[at], [each[i] for i in at]) for d in np.unique(digits) for at in [np.flatnonzero(digits == d)]]
        self.seen = np.zeros(1 << 16, bool)
        self.halves = np.zeros((2, 1 << 16), np.int32)

    def candidates(self, n: int, tokens: np.ndarray) -> np.ndarray:
        """Positions of all texts that can have enough words in common with a text of n words, and few more."""
        at = np.concatenate([band.near(n, tokens, self.least_same) for band in self.bands])
        if not len(at):
            return at
        least = least_common(self.sizes[at], n, self.least_same)
        self.seen[tokens] = True
        where, begin = _ragged(self.starts[at], self.sizes[at])
        both = np.add.reduceat(self.seen[self.tokens[where]], begin, dtype=np.int64)
        self.seen[tokens] = False
        return at[both >= least]

    def ordered(self, at: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Those of the texts that can have enough words in the same order as `numbers`.

        Where the subsequence leaves the first half of `numbers` the other text is cut too, and the bags of the first parts, and
        of the second ones, bound it; the best cut counts.
        """
        if not len(at):
            return at
        half = len(numbers) // 2
        for counts, part in zip(self.halves, (numbers[:half], numbers[half:])):
            found, times = np.unique(part, return_counts=True)
            counts[found] = times
        where, begin = _ragged(self.starts[at], self.sizes[at])
        words = self.flat[where]
        first, second = (self.before[where] < self.halves[0][words]), (self.after[where] < self.halves[1][words])
        self.halves[:, numbers] = 0
        gain = np.cumsum(first.astype(np.int64) - second)
        ahead = gain[begin] - (first[begin].astype(np.int64) - second[begin])  # before the text's first word
        best = np.maximum(0, np.maximum.reduceat(gain, begin) - ahead)
        return at[best + np.add.reduceat(second, begin, dtype=np.int64) >= least_common(self.sizes[at], len(numbers), self.least_same)]

    def pairs(self, mark: int, numbers: np.ndarray, tokens: np.ndarray) -> Iterator[tuple[int, float]]:
        """(eval_mark, same) of the texts that overlap with a training text, as far as word numbers tell; equal ones are linked elsewhere."""
        at = None
        for e in self.ordered(self.candidates(len(numbers), tokens), numbers).tolist():
            if self.marks[e] == mark:
                continue
            at = at or places(numbers.tolist())
            longer = max(len(numbers), len(self.numbers[e]))
            same = common_if(at, len(numbers), self.numbers[e].tolist(), math.ceil(self.least_same * longer - 1e-9))
            if same is not None:
                yield self.marks[e], same / longer

    def matches(self, mark: int, text: str) -> Iterator[tuple[int, int, float, float]]:
        """(eval_mark, train_mark, covered, same) of the texts that overlap with one."""
        numbers, _ = word_numbers([text])
        for e, same in self.pairs(mark, numbers, _bags(numbers, _occurrences(numbers, np.array([len(numbers)]))[0])):
            yield e, mark, same, same


def _number_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mark, train, eval, text) to the same with the bytes of the word numbers for the text."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            numbers, owner = word_numbers(part.column(3).to_pylist())
            ends = np.searchsorted(owner, np.arange(part.num_rows + 1))
            column = pa.array([numbers[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:3], column], names=["mark", "train", "eval", "numbers"])


def _near_batches(least_same: float):
    """(number, train, mark, numbers): a task's evaluation texts, then training texts, to the pairs that overlap as far as word numbers tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: int | None = None
        texts: list[tuple[int, bytes]] = []
        held: Held | None = None
        for batch in batches:
            ev, tr = [], []
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                numbers = [np.frombuffer(b, np.uint16) for b in part.column(3).to_pylist()]
                sizes, flat = np.array([len(x) for x in numbers]), np.concatenate(numbers)
                bags = np.split(_bags(flat, _occurrences(flat, sizes)[0]), np.cumsum(sizes)[:-1])
                for number, train, mark, own, bag in zip(*(part.column(i).to_pylist() for i in range(3)), numbers, bags):
                    if number != group:
                        group, texts, held = number, [], None
                    if not train:
                        texts.append((mark, own.tobytes()))
                    elif texts:
                        held = held or Held(texts, least_same)
                        found = [e for e, _ in held.pairs(mark, own, bag)]
                        ev += found
                        tr += [mark] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(ev, pa.int64()), pa.array(tr, pa.int64())], names=["eval_mark", "train_mark"])

    return run


def _decide_batches(least_same: float, table: np.ndarray):
    """(shard, train, mark, text, near): a shard's evaluation texts, then training texts, to (eval_mark, train_mark, covered, same)."""

    def close(texts: dict[int, str], same: dict[int, list[tuple[int, float]]], others: dict[int, str]) -> list[tuple]:
        search = Automaton({e: texts[e] for found in same.values() for e, _ in found}, table)
        covered = {t: search.coverage(text) for t, text in others.items()}
        return [(e, t, covered[t].get(e, 0.0), share) for t, found in same.items() for e, share in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, texts, same, others = None, {}, {}, {}
        out: list[tuple] = []
        types = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        for batch in batches:
            for number, train, mark, text, near in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if number != shard or len(others) >= HELD:
                    out += close(texts, same, others)
                    same, others = {}, {}
                    if number != shard:
                        shard, texts = number, {}
                if not train:
                    texts[mark] = text
                    continue
                words = text.split(" ")
                at = places(words)
                found = []
                for e in near:
                    mine = texts[e].split(" ")
                    longer = max(len(words), len(mine))
                    common = common_if(at, len(words), mine, math.ceil(least_same * longer - 1e-9))
                    if common is not None:
                        found.append((e, common / longer))
                if found:
                    same[mark], others[mark] = found, text
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["eval_mark", "train_mark", "covered", "same"])
            out = []
        columns = list(zip(*close(texts, same, others))) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["eval_mark", "train_mark", "covered", "same"])

    return run


class SplitOverlap:
    """Overlaps between the evaluation splits and train.

    Records without a split, and those whose body has fewer than `least` characters, take no part. Bodies are
    those `llm.main_body` leaves. With `snapshots` (snapshot_id, payload_hash), records of one payload have one
    body, that of the least raw_id. members: (raw_id, split, mark). sites: (raw_id, site). links: (eval_mark, train_mark, covered,
    same), pairs of different or equal texts, where `same` of the longer one's words stand in the other in the
    same order, and `covered` of the evaluation text's words in runs of two words and more that the other has. All pairs
    within the length bound are compared, with or without `exact`.
    """

    def __init__(
        self, spark: SparkSession, raw: DataFrame, stress: DataFrame, flags: DataFrame, least: int, least_same: float, snapshots: DataFrame | None = None, exact: bool = False
    ) -> None:
        self.keep = keep = Scratch(spark, "overlap")
        self.least_same = least_same
        bodies = normal_bodies(spark, raw, least)
        splits = stress.where("raw_id IS NOT NULL").select("raw_id", split_name(F.col("split")).alias("split")).where("split IS NOT NULL").distinct()
        sites = flags.where("raw_id IS NOT NULL").select("raw_id", site_of(F.col("hostname"), F.col("href")).alias("site")).groupBy("raw_id").agg(F.min("site").alias("site"))
        self.sites = sites
        members = bodies.select("raw_id", "mark").join(splits, "raw_id")
        if snapshots is not None:
            hashes = snapshots.where("snapshot_id IS NOT NULL AND payload_hash IS NOT NULL").groupBy("snapshot_id").agg(F.min("payload_hash").alias("payload"))
            payloads = stress.where("raw_id IS NOT NULL").select("raw_id", "snapshot_id").join(hashes, "snapshot_id").groupBy("raw_id").agg(F.min("payload").alias("payload"))
            members = keep.put(members.join(payloads, "raw_id", "left"))
            first = members.where("payload IS NOT NULL").groupBy("payload").agg(F.min(F.struct("raw_id", "mark"))["mark"].alias("first"))
            members = members.join(first, "payload", "left").select("raw_id", "split", F.coalesce("first", "mark").alias("mark"))
        self.members = keep.put(members)
        train = F.col("split") == "train"
        kinds = self.members.groupBy("mark").agg(F.max(train).alias("train"), F.max(~train).alias("eval"))
        one = bodies.groupBy("mark").agg(F.min("raw_id").alias("raw_id")).join(kinds, "mark")
        self.texts = keep.put(bodies.drop("mark").join(one, "raw_id").where("words > 0").select("mark", "words", "text", "train", "eval"))
        keep.drop(bodies)
        near = self._near(spark)
        equal = self.texts.where("eval AND train").selectExpr("mark AS eval_mark", "mark AS train_mark", "1.0D AS covered", "1.0D AS same")
        self.links = keep.put(near.unionAll(equal))

    def _near(self, spark: SparkSession) -> DataFrame:
        """Links between different texts: every evaluation text meets every training text of like length."""
        texts, keep, least_same = self.texts, self.keep, self.least_same
        words, evaluated, trained = texts.agg(F.coalesce(F.sum(F.when(F.col("eval"), F.col("words"))), F.lit(0)), F.count_if("eval"), F.count_if("train")).collect()[0]
        # Evaluation texts lie in slots; a slot's training texts are spread over lanes, each of which has all of the slot's evaluation texts.
        slots = max(1, -(-words // HELD_WORDS))
        lanes = max(1, -(-spark.sparkContext.defaultParallelism // slots), -(-evaluated * trained // (slots * WORK)))
        spread = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "mark"), F.lit(n)).cast("int")
        every = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
        to = lambda number, train: F.struct(number.cast("int").alias("number"), F.lit(train).alias("train"))
        none = F.array().cast("array<struct<number:int,train:boolean>>")
        held = F.when(F.col("eval"), F.transform(every(lanes), lambda lane: to(spread("slot", slots) * lanes + lane, False))).otherwise(none)
        scanned = F.when(F.col("train"), F.transform(every(slots), lambda slot: to(slot * lanes + spread("lane", lanes), True))).otherwise(none)
        numbers = texts.select("mark", "train", "eval", "text").mapInArrow(_number_batches, "mark BIGINT, train BOOLEAN, eval BOOLEAN, numbers BINARY")
        placed = numbers.select(F.explode(F.concat(held, scanned)).alias("to"), "mark", "numbers").select("to.number", "to.train", "mark", "numbers")
        ordered = placed.repartitionById(slots * lanes, "number").sortWithinPartitions("number", "train")
        pairs = keep.put(ordered.mapInArrow(_near_batches(least_same), "eval_mark BIGINT, train_mark BIGINT"))
        met_evals = pairs.select("eval_mark").distinct().join(texts.select("mark", "words", "text"), F.col("eval_mark") == F.col("mark"))
        shards = max(1, -(-met_evals.agg(F.coalesce(F.sum("words"), F.lit(0))).collect()[0][0] // HELD_PASSAGES))
        shard = lambda c: F.pmod(F.xxhash64(F.lit("shard"), c), F.lit(shards)).cast("int").alias("shard")
        ones = met_evals.select(shard(F.col("mark")), F.lit(False).alias("train"), "mark", "text", F.array().cast("array<bigint>").alias("near"))
        others = pairs.groupBy(shard(F.col("eval_mark")), "train_mark").agg(F.collect_list("eval_mark").alias("near"))
        others = others.join(texts.select("mark", "text"), F.col("train_mark") == F.col("mark")).select("shard", F.lit(True).alias("train"), "mark", "text", "near")
        ordered = ones.unionAll(others).repartitionById(shards, "shard").sortWithinPartitions("shard", "train")
        return ordered.mapInArrow(_decide_batches(least_same, common_table([])), "eval_mark BIGINT, train_mark BIGINT, covered DOUBLE, same DOUBLE")

    def linked(self) -> DataFrame:
        """(eval_id, train_id, split, covered, same) of all records that overlap."""
        ev = self.members.where("split <> 'train'").selectExpr("mark AS eval_mark", "raw_id AS eval_id", "split")
        tr = self.members.where("split = 'train'").selectExpr("mark AS train_mark", "raw_id AS train_id")
        return self.links.join(ev, "eval_mark").join(tr, "train_mark").select("eval_id", "train_id", "split", "covered", "same")

    def pairs(self) -> DataFrame:
        """(eval_id, train_id, split, eval_site, train_site, covered, same) of all records that overlap."""
        of = lambda side: self.sites.selectExpr(f"raw_id AS {side}_id", f"site AS {side}_site")
        return self.linked().join(of("eval"), "eval_id", "left").join(of("train"), "train_id", "left").select("eval_id", "train_id", "split", "eval_site", "train_site", "covered", "same")

    def report(self) -> DataFrame:
        """(split, site, records, pairs, same_site): evaluation records with an overlap, and their pairs, for each split and site.

        Training records are counted per text and site before they meet the evaluation records.
        """
        members = self.members.join(self.sites, "raw_id", "left")
        tr = members.where("split = 'train'").groupBy(F.col("mark").alias("train_mark"), F.col("site").alias("train_site")).agg(F.count(F.lit(1)).alias("n"))
        ev = members.where("split <> 'train'").selectExpr("mark AS eval_mark", "raw_id", "split", "site")
        met = self.links.join(tr, "train_mark").groupBy("eval_mark", "train_site").agg(F.sum("n").alias("n"))
        each = ev.join(met, "eval_mark").groupBy("split", "site", "raw_id").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("train_site") == F.col("site"), F.col("n")).otherwise(0)).alias("own"))
        return each.groupBy("split", "site").agg(F.count(F.lit(1)).alias("records"), F.sum("n").alias("pairs"), F.sum("own").alias("same_site"))
