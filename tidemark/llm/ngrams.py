"""Tables of n-grams in parts, which partitions of texts ask for the n-grams that they hold.

Words are keys of 64 bits (hashes); a bigram is a pair of numbers that the table of words gives, a trigram the number of a
bigram and that of a word. Partitions of texts are worked off in groups of chunks. A group sends each part of a table the
distinct keys that it has there, sorted, as differences of two or three bytes; the part answers with the numbers of those it
knows and what it says of them, in the same order. So an n-gram goes by shuffle once a group, without the places where it
stands, and one with a part that no table knows is not asked for at all. Texts are read again for each length of n-grams
and meet the answers partition by partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidemark.llm.text import whole_text

#: Bytes of text of a chunk, about; a text is never parted. Chunks that ask together.
CHUNK, GROUP = 1 << 20, 10
#: Keys of the two places before a text and of the one after it.
START, END = 1, 2
#: Words, bigrams and trigrams.
LENGTHS = 3
#: What a table says of an n-gram: how often, and of those that it is the context of, how many stand once, twice, more often, and how often above three times.
VALUES = ("n", "once", "twice", "more", "rest")
#: The number of an n-gram that no table knows.
NONE = np.uint32(0xFFFFFFFF)
_LOW32 = np.uint64(0xFFFFFFFF)
_MASKS = np.array([2 ** (8 * n) - 1 for n in range(9)], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin, which has a space at both ends, and hashes of them with A-Z lower-cased."""
    low = np.frombuffer(text + b" " * 8, dtype=np.uint8)
    inside = (low != 32) & (low - np.uint8(9) > 4)
    low = low | (low - np.uint8(65) < 26).view(np.uint8) << np.uint8(5)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray((len(low) - 7,), dtype="<u8", buffer=low, strides=(1,))
    hashes = _mix((eight[starts] & _MASKS[np.minimum(sizes, 8)]) + _mix(sizes.astype(np.uint64)))
    far, at = np.flatnonzero(sizes > 8), 8
    while len(far):
        more = eight[starts[far] + at] & _MASKS[np.minimum(sizes[far] - at, 8)]
        hashes[far] = _mix((hashes[far] ^ more) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(at))
        at += 8
        far = far[sizes[far] > at]
    return starts, hashes


Small = tuple[int, int, bytes]


def squeezed(values: np.ndarray) -> Small:
    """Numbers from 0, as planes of bytes, compressed."""
    values = np.ascontiguousarray(values, dtype="<u8")
    width = (int(values.max(initial=0)).bit_length() + 7) // 8
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(values), width, pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if width else b""


def loosened(small: Small) -> np.ndarray:
    n, width, data = small
    out = np.zeros((n, 8), dtype=np.uint8)
    if width and n:
        out[:, :width] = np.frombuffer(pa.decompress(data, decompressed_size=n * width, codec="zstd", asbytes=True), dtype=np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def steps(rising: np.ndarray) -> Small:
    return squeezed(np.diff(rising, prepend=np.uint64(0)))


def climbed(small: Small) -> np.ndarray:
    return np.cumsum(loosened(small), dtype=np.uint64)


def coded(level: int, called: np.ndarray) -> tuple[int, Small]:
    """What a part calls keys, in their order; pairs as if no second number were greater than the greatest of these."""
    size = int((called & _LOW32).max(initial=0)) + 1 if level else 0
    return size, steps((called >> np.uint64(32)) * np.uint64(size) + (called & _LOW32) if level else called)


def decoded(small: tuple[int, Small]) -> np.ndarray:
    keys, size = climbed(small[1]), np.uint64(small[0])
    return (keys // size << np.uint64(32)) | keys % size if size else keys


def dealt(level: int, keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted keys: their order by parts, where each part begins, and what a part calls each. Bigrams and trigrams of one word go to all parts."""
    high, n = keys >> np.uint64(32), np.uint64(parts)
    part = (high * n >> np.uint64(32)) if level == 0 else (high + (keys & _LOW32)) % n
    order = np.argsort(part.astype(np.uint16) if parts < 65536 else part, kind="stable")
    called = keys if level == 0 else (high << np.uint64(32)) | ((keys & _LOW32) // n)
    return order, np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64)), called


def right_of(called: np.ndarray, part: int, parts: int) -> np.ndarray:
    """The second number of the pairs that a part calls so."""
    n = np.uint64(parts)
    return (called & _LOW32) * n + (np.uint64(part) + n - (called >> np.uint64(32)) % n) % n


class Chunk:
    """Some texts; its places are those of their tokens, two starts and an end a text with them."""

    def __init__(self, texts: tuple[list[tuple], list[int], bytes]):
        self.rows, sizes, text = texts
        starts, found = words(pa.decompress(text, decompressed_size=sum(sizes) + 1, codec="zstd", asbytes=True))
        self.counts = np.diff(np.searchsorted(starts, np.cumsum([0, *sizes])))
        ends = np.cumsum(self.counts + 3)
        self.begins = ends - self.counts - 3
        tokens = np.full(ends[-1], START, dtype=np.uint64)
        tokens[np.arange(len(found)) + np.repeat(3 * np.arange(len(self.counts)) + 2, self.counts)] = found
        tokens[ends - 1] = END
        coded = pa.array(tokens).dictionary_encode()
        #: The n-grams of the length that is asked for, and which of them ends at each place, one behind the last if none.
        self.keys, self.at = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        #: Of each length, where in the group's tables the n-gram is that ends at a place; -1 if it is not asked for.
        self.places: list[np.ndarray] = []

    def pair(self, left: np.ndarray, right: np.ndarray, placed: bool) -> None:
        """Goes on to n-grams of what ends before a place and the word there; where they stand is found if that is to be known."""
        paired = (left != NONE) & (right != NONE)
        pairs = left[paired].astype(np.uint64) << np.uint64(32) | right[paired]
        if not placed:
            self.keys, self.at = np.unique(pairs), None
            return
        self.keys, inverse = np.unique(pairs, return_inverse=True)
        self.at = np.full(len(left), len(self.keys), dtype=np.int32)
        self.at[paired] = inverse


class Group:
    """Chunks that ask together, with what they were answered so far."""

    def __init__(self, texts: list[tuple], parts: int, valued: bool):
        self.chunks, self.parts, self.valued = [Chunk(x) for x in texts], parts, valued
        #: Of each length, a number and values for each n-gram asked for, and for none at the end.
        self.numbers: list[np.ndarray] = []
        self.values: list[list[np.ndarray]] = []
        self.keys = self._keys()

    def _keys(self) -> np.ndarray:
        return np.unique(np.concatenate([c.keys for c in self.chunks]))

    def asked(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """part, which of keys, and what the part calls them."""
        order, begins, called = dealt(len(self.numbers), self.keys, self.parts)
        for part in np.flatnonzero(np.diff(begins)):
            own = order[begins[part] : begins[part + 1]]
            yield int(part), own, called[own]

    def answered(self, answers: dict[int, tuple], placed: bool = True) -> None:
        """Takes the answers to asked(), and goes on to n-grams one longer."""
        level, size = len(self.numbers), len(self.keys) + 1
        numbers = np.full(size, NONE)
        # Of trigrams there is a count alone.
        names = () if not self.valued else VALUES if level + 1 < LENGTHS else VALUES[:1]
        # The middle ones count n-grams, which are fewer than 2^32.
        values = [np.zeros(size, dtype=np.float64 if name in ("n", "rest") else np.uint32) for name in names]
        for part, own, called in self.asked():
            n, total, known, ranks, found = answers[part]
            if (n, total) != (len(called), int(called.sum(dtype=np.uint64))):
                raise RuntimeError("the texts of a partition were others when they were read again")
            hit = own[np.unpackbits(np.frombuffer(known, dtype=np.uint8), count=n).view(bool)]
            which = climbed(ranks) * np.uint64(self.parts) + np.uint64(part)
            if which.max(initial=0) >= NONE:
                raise RuntimeError("more than 2^32 n-grams of one length")
            numbers[hit] = which
            for row, column in zip(values, found, strict=self.valued):
                row[hit] = loosened(column)
        self.numbers.append(numbers)
        self.values.append(values)
        for c in self.chunks:
            c.places.append(np.append(np.searchsorted(self.keys, c.keys).astype(np.int32), np.int32(-1))[c.at])
            if level + 1 < LENGTHS:
                left, right = numbers[c.places[level]], self.numbers[0][c.places[0]]
                # A trigram has two bigrams that are known.
                right[left == NONE] = NONE
                left = np.concatenate([[NONE], left[:-1]])
                left[c.begins] = NONE
                c.pair(left, right, placed)
            else:
                c.keys = c.at = None
        if level + 1 < LENGTHS:
            self.keys = self._keys()


class Chunks:
    """The texts of a table in chunks: an RDD with one list a partition."""

    def __init__(self, docs: DataFrame, keep: Iterable[str] = ()):
        def cut(rows: Iterator[Row]) -> Iterator[tuple]:
            packed = lambda: (own, [len(x) + 1 for x in texts], pa.compress(b" ".join([b"", *texts, b""]), codec="zstd", asbytes=True))
            own, texts, size = [], [], 0
            for *kept, text in rows:
                own.append(tuple(kept))
                texts.append(text)
                size += len(text)
                if size >= CHUNK:
                    yield packed()
                    own, texts, size = [], [], 0
            if own:
                yield packed()

        self.rdd = docs.select(*keep, whole_text(F.col("text")).cast("binary")).rdd.mapPartitions(cut).glom()
        self.parts = max(1, self.rdd.getNumPartitions())

    def each(self, parts: int, answers: list[RDD], f: Callable[[int, int, Group], Iterable], placed: bool = False) -> RDD:
        """f of number of partition, number in it and group, for all groups, which have got the answers so far; values only if these are all.

        placed: f asks where the n-grams stand that were not answered yet.
        """

        lengths = len(answers)

        def work(p: int, pairs: Iterator) -> Iterator:
            for texts, found in pairs:
                by: dict[tuple, dict] = {}
                for _, (level, i, part, *answer) in found:
                    by.setdefault((level, i), {})[part] = answer
                for i in range(0, len(texts), GROUP):
                    group = Group(texts[i : i + GROUP], parts, lengths == LENGTHS)
                    texts[i : i + GROUP] = [None] * len(group.chunks)
                    for level in range(lengths):
                        group.answered(by.pop((level, i), {}), placed or level + 1 < lengths)
                    yield from f(p, i, group)

        if not answers:
            return self.rdd.map(lambda texts: (texts, ())).mapPartitionsWithIndex(work)
        together = beside(*answers).glom()
        # What the answers were dealt over may be more partitions.
        short = together.getNumPartitions() - self.rdd.getNumPartitions()
        texts = self.rdd.union(self.rdd.context.parallelize([[]] * short, short)) if short else self.rdd
        return texts.zip(together).mapPartitionsWithIndex(work)


def gathered(rows: RDD, parts: int) -> RDD:
    """Pairs of a part and something, in the partition of their part."""
    return rows.partitionBy(parts, int)


def beside(*rows: RDD) -> RDD:
    """RDDs that were gathered by the same parts, partition by partition; nothing goes by shuffle again."""
    found = rows[0]
    for more in rows[1:]:
        found = found.union(more)
    if found.getNumPartitions() != rows[0].getNumPartitions():
        raise RuntimeError("rows of the same parts are not in the same partitions")
    return found


#: What is sent to a part of a table: keys that make it up, what longer n-grams tell of them, trigrams with counts, questions.
HOLD, TELL, COUNT, ASK = range(4)


def questions(p: int, i: int, group: Group, kind: int = ASK) -> Iterator[tuple]:
    level = len(group.numbers)
    for part, _, called in group.asked():
        yield part, (kind, (p, level, i, coded(level, called)))


def answer(question: tuple, part: int, keys: np.ndarray, values: Iterable[np.ndarray]) -> tuple:
    p, level, i, small = question
    called = decoded(small)
    at = np.searchsorted(keys, called)
    known = np.zeros(len(called), dtype=bool)
    known[at < len(keys)] = keys[at[at < len(keys)]] == called[at < len(keys)]
    ranks = at[known].astype(np.uint64)
    return p, (level, i, part, len(called), int(called.sum(dtype=np.uint64)), np.packbits(known).tobytes(), steps(ranks), [squeezed(column[ranks]) for column in values])


def _answers(part: int, rows: Iterator) -> Iterator[tuple]:
    sent = list(rows)
    keys, values, _ = table(sent)
    for _, (kind, question) in sent:
        if kind == ASK:
            yield answer(question, part, keys, values)


def _numbered(part: int, rows: Iterator) -> Iterator[tuple]:
    """Answers to those whose keys are to make up the table: numbers alone."""
    sent = list(rows)
    keys, _, _ = table(sent)
    for _, (_, question) in sent:
        yield answer(question, part, keys, ())


def _counted(_p: int, _i: int, group: Group) -> Iterator[tuple]:
    """Trigrams to their parts: how often they stand, and the number of the bigram they end with."""
    times, ends = np.zeros(len(group.keys), dtype=np.int64), np.zeros(len(group.keys), dtype=np.uint32)
    for c in group.chunks:
        asked = c.at < len(c.keys)
        at = np.searchsorted(group.keys, c.keys)
        times[at] += np.bincount(c.at[asked], minlength=len(c.keys))
        ends[at[c.at[asked]]] = group.numbers[1][c.places[1][asked]]
    for part, own, called in group.asked():
        yield part, (COUNT, (coded(2, called), squeezed(times[own]), squeezed(ends[own])))


def table(sent: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a part: its keys, sorted, a row of values for each of VALUES (for trigrams n alone), and the bigrams that trigrams end with."""
    none = np.zeros(0, dtype=np.uint64)
    counted = [x for _, (kind, x) in sent if kind == COUNT]
    if counted:
        keys, times, ends = (np.concatenate([f(x[k]) for x in counted]) for k, f in ((0, decoded), (1, loosened), (2, loosened)))
        order = np.argsort(keys)
        keys, times, ends = keys[order], times[order], ends[order]
        first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        return keys[first], np.add.reduceat(times, first)[None], ends[first]
    keys = np.unique(np.concatenate([none, *[decoded(x[-1]) for _, (kind, x) in sent if kind == HOLD]]))
    values = np.zeros((len(VALUES), len(keys)), dtype=np.uint64)
    for _, (kind, x) in sent:
        if kind == TELL:
            rows, ranks, columns = x
            at = climbed(ranks)
            for row, column in zip(rows, columns, strict=True):
                values[VALUES.index(row), at] += loosened(column)
    return keys, values, none


class Tables:
    """Words, bigrams and trigrams of texts: of each, an RDD of what makes up its parts."""

    def __init__(self, texts: Chunks):
        self.parts = parts = texts.parts
        held, answers = [], []
        for _ in range(LENGTHS - 1):
            held.append(gathered(texts.each(parts, list(answers), partial(questions, kind=HOLD)), parts))
            answers.append(gathered(held[-1].mapPartitionsWithIndex(_numbered), parts))
        counted = gathered(texts.each(parts, answers, _counted, placed=True), parts)

        def of_trigrams(part: int, sent: Iterator) -> Iterator[tuple]:
            keys, values, ends = table(list(sent))
            return _told(ends, keys >> np.uint64(32), values[0], parts)

        def of_bigrams(part: int, sent: Iterator) -> Iterator[tuple]:
            keys, values, _ = table(list(sent))
            keys, n = keys[values[0] > 0], values[0][values[0] > 0]
            return _told(right_of(keys, part, parts), keys >> np.uint64(32), n, parts)

        bigrams = beside(held[1], gathered(counted.mapPartitionsWithIndex(of_trigrams), parts))
        self.levels = [beside(held[0], gathered(bigrams.mapPartitionsWithIndex(of_bigrams), parts)), bigrams, counted]

    def answers(self, level: int, asked: RDD, partitions: int) -> RDD:
        """Answers to questions(), by the partitions that asked."""
        return gathered(beside(self.levels[level], gathered(asked, self.parts)).mapPartitionsWithIndex(_answers), partitions)


def occurrences(once: np.ndarray, twice: np.ndarray, more: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Of all n-grams with a context."""
    return rest + once + 2.0 * twice + 3.0 * more


def _told(ends: np.ndarray, contexts: np.ndarray, times: np.ndarray, parts: int) -> Iterator[tuple]:
    """What n-grams (sorted by contexts) tell of the shorter ones: each is one more that ends with its own, and counts for its context."""
    own, n = np.unique(ends, return_counts=True)
    first = np.flatnonzero(np.diff(contexts, prepend=~contexts[:1]))
    held = [np.add.reduceat(x.astype(np.uint64), first) if len(first) else x[:0] for x in (times == 1, times == 2, times > 2, np.maximum(times, 3) - 3)]
    for rows, numbers, columns in ((VALUES[:1], own, [n]), (VALUES[1:], contexts[first], held)):
        by = numbers % np.uint64(parts)
        order = np.argsort(by, kind="stable")
        begins = np.searchsorted(by[order], np.arange(parts + 1, dtype=np.uint64))
        for part in np.flatnonzero(np.diff(begins)):
            which = order[begins[part] : begins[part + 1]]
            yield int(part), (TELL, (rows, steps(numbers[which] // np.uint64(parts)), [squeezed(c[which]) for c in columns]))
