"""Suffix-array removal of repeated byte strings: longest previous factors over the suffixes that can repeat.

The suffix order is cut at L bytes: suffixes that share their first L bytes form a run, and ties in
a run go by position. So the previous smaller position of a suffix in that order is its predecessor
where both are in one run, no position after it in the run is smaller, and its longest previous
factor reaches L exactly when it has a predecessor in its run. `keep="first"` removes those suffixes'
first L bytes; `keep="none"` also those of the earliest suffix of each run of two or more.

The order is never made over all bytes. It is refined in three levels, each of which settles most of
what the level before left open:

1. Texts. Equal texts are one text with a count.
2. Sparse suffixes. Each window of L bytes names its minimiser, the place of the smallest hash of
   GRAM bytes in it. Equal windows have equal minimisers, so a minimiser that occurs once starts no
   run. Windows in a row with one minimiser make an interval; intervals of equal bytes are sorted
   side by side, and all but the first have a predecessor. What stays open is the first interval of
   each kind, where one minimiser has intervals of several kinds: around the ends of copies.
3. Windows. Open intervals are cut into blocks of BLOCK windows at fixed distances from the
   minimiser. The windows of a block share a core, so only blocks of one core can hold equal windows;
   a block carries the few bytes on both sides of it. Blocks of a core are met in one task, which puts
   their windows in suffix order, takes from neighbours how many bytes they share, and finds the
   longest previous factor of each (at most L) at the nearest smaller place before or after it. One
   of L bytes is a repeat, and what it was found at is repeated.

Minimisers and cores that very many rows share are known from a fixed share of the texts (HOT_SHARE).
They are not grouped whole: their rows are dealt over SALTS parts, where all but the first of a part
are settled, and the firsts of the parts are met in a second step. That choice never changes a result.

Defined results: a null text is empty; texts under L bytes keep everything; rows of equal text are
copies of one another; with keep="first" the copy with the smallest doc_id stays, with all rows that
repeat both its id and its text; a null doc_id comes last; a text of any length is taken whole, in
one task; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import cut, dealt_join
from tidemark.llm.groups import whole_groups
from tidemark.llm.text import whole_text

LENGTH = 200
#: Bytes of a minimiser.
GRAM = 48
#: Windows of a block.
BLOCK = 16
#: Bytes that are hashed at a time; a longer text is hashed alone.
CHUNK = 1 << 20
#: One of so many texts is looked at to find hot minimisers and cores.
HOT_SHARE = 16
#: No more keys than this are hot; their list is broadcast.
HOT_KEYS = 1_000_000
#: A hot key has more sampled rows than this.
HOT_ROWS = 512
#: Parts that the rows of a hot key are dealt over.
SALTS = 64

_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(7).integers(1, 2**64 - 1, 256, dtype=np.uint64)
_power = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The powers of the base and of its inverse modulo 2**64."""
    if len(_power[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _power[i] = np.cumprod(steps, dtype=np.uint64)
    return _power


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every `gram` bytes."""
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    count = len(data) - gram + 1
    return _mix((sums[gram:] - sums[:count]) * inverse[:count])


def intervals(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: text, first window (in data), number of windows, bytes to the minimiser, its hash."""
    begins = np.concatenate(([0], ends[:-1]))
    nothing = (np.zeros(0, dtype=np.int64),) * 4 + (np.zeros(0, dtype=np.uint64),)
    if len(data) < length:
        return nothing
    grams = gram_hashes(data, gram)
    # The upper half of the hash, then the place: equal windows choose alike wherever they stand.
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    width, reach = length - gram + 1, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if width > reach:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    whole = np.zeros(len(data) + 1, dtype=np.int32)  # windows inside one text
    long = ends - begins >= length
    np.add.at(whole, begins[long], 1)
    np.add.at(whole, ends[long] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(whole[: len(least)]))
    if not len(start):
        return nothing
    at = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner = np.searchsorted(ends, start, side="right")
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]))))
    first, n = start[new], np.diff(np.concatenate((new, [len(start)])))
    return owner[new], first, n, at[new] - first, grams[at[new]]


def _digests(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests as two signed numbers each."""
    flat = np.frombuffer(b"".join(parts), dtype="<i8").reshape(-1, 2)
    return flat[:, 0], flat[:, 1]


def _chunks(texts: pa.Array) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """First row, bytes and ends of texts laid end to end, about CHUNK bytes at a time."""
    held, size, first = [], 0, 0
    for i, text in enumerate(texts):
        held.append(text.as_py().encode())
        size += len(held[-1])
        if size >= CHUNK or i == len(texts) - 1:
            yield first, b"".join(held), np.cumsum([len(x) for x in held])
            held, size, first = [], 0, i + 1


def _numbers(batch: pa.RecordBatch | pa.Table, *names: str) -> list[np.ndarray]:
    return [batch.column(c).to_numpy().astype(np.int64, copy=False) for c in names]


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before it."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def removable(run_starts: np.ndarray, keep: str) -> np.ndarray:
    """Which rows that are known to be equal or not, side by side and by position, are removed.

    One that starts no run has the row before it as previous smaller position, equal to its end. With
    keep="none" it also gives its run's first row a later match.
    """
    has_earlier = ~run_starts
    if keep == "first":
        return has_earlier
    has_later = np.concatenate((has_earlier[1:], [False])) if len(run_starts) else has_earlier
    return has_earlier | has_later


def _previous_smaller(place: np.ndarray, common: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the nearest one before it with a smaller place, and the least of common between the two.

    Rows of a group stand together and common is 0 where a group begins. A row without a smaller one
    in its group gets length 0. Both are read off tables of the least values of 1, 2, 4, ... rows, as
    many as the largest group asks for, so that no order of places makes it slow.
    """
    n = len(place)
    longest = int(np.bincount(group).max()) if n else 0
    # Row 0 stands for what is before the first one: smaller than all.
    least = [np.concatenate(([-1], place))]
    shared = [np.concatenate(([0], common))]
    while (width := 1 << len(least)) <= longest:
        half, (a, b) = width // 2, (least[-1], shared[-1])
        back = np.maximum(np.arange(n + 1) - half, 0)
        least.append(np.minimum(a, a[back]))
        shared.append(np.minimum(b, b[back]))
    at = np.arange(n)  # the row before, counted from 1
    length = common.copy()
    for k in reversed(range(len(least))):
        step = np.nonzero(least[k][at] > place)[0]
        length[step] = np.minimum(length[step], shared[k][at[step]])
        at[step] = np.maximum(at[step] - (1 << k), 0)
    return at - 1, length


def longest_previous(place: np.ndarray, common: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest previous factor of suffixes in suffix order, and the row it is found at (-1: none).

    place is where a suffix starts among all; common how many bytes it shares with the suffix before
    it in this order (0 where a group of suffixes begins). The nearest suffixes with smaller places,
    before and after it in this order, share most with it of all that start earlier.
    """
    source, before = _previous_smaller(place, common, group)
    mirrored, after = _previous_smaller(place[::-1], np.concatenate(([0], common[1:][::-1]))[: len(common)], group[::-1])
    mirrored, after = len(place) - 1 - mirrored[::-1], after[::-1]
    found = np.maximum(before, after)
    return found, np.where(found == 0, -1, np.where(before >= after, source, mirrored))


#: The text's place among all: its smallest doc_id, and 128 bits of the text.
PLACE = ("f", "t0", "t1")
_KIND = "g long, part int, a long, b long, f long, t0 long, t1 long, s int, n int, o int"
_SPAN = "f long, t0 long, t1 long, s int, n int"


def text_key(text: Column) -> list[Column]:
    """128 bits that tell texts apart."""
    return [F.xxhash64(text).alias("t0"), F.xxhash64(F.lit(1), text).alias("t1")]


def texts_of(docs: DataFrame) -> DataFrame:
    """t0, t1, f, m (rows of the text) and text of the distinct texts."""
    text = whole_text(F.col("text"))
    # Copies are combined before the shuffle, so one text of very many rows is no hot key.
    return docs.select(*text_key(text), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("f"), text.alias("text")).groupBy("t0", "t1").agg(F.min("f").alias("f"), F.count("*").alias("m"), F.first("text").alias("text"))


def sparse(texts: DataFrame, length: int, gram: int, hot: np.ndarray) -> DataFrame:
    """The intervals of every text: minimiser g, part (-1 if g is not hot), digest a, b of the interval, place, windows (s, n) and bytes to g."""
    shared = texts.sparkSession.sparkContext.broadcast(hot)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _numbers(batch, *PLACE)
            for row, data, ends in _chunks(batch.column("text")):
                owner, first, n, o, g = intervals(np.frombuffer(data, dtype=np.uint8), ends, length, gram)
                seen = memoryview(data)
                a, b = _digests([xxhash.xxh3_128_digest(seen[s : s + k + length - 1], k * 65536 + at) for s, k, at in zip(first.tolist(), n.tolist(), o.tolist(), strict=True)])
                begins = np.concatenate(([0], ends[:-1]))
                small = [np.asarray(x, dtype=np.int32) for x in (first - begins[owner], n, o)]
                place, name = {c: k[owner + row] for c, k in zip(PLACE, keys, strict=True)}, g.view(np.int64)
                part = np.where(_is_hot(name, shared.value), _salt(place["t0"], small[0]), np.int32(-1)).astype(np.int32)
                yield _batch(g=name, part=part, a=a, b=b, **place, s=small[0], n=small[1], o=small[2])

    return texts.mapInArrow(found, _KIND)


def blocks(open_texts: DataFrame, length: int, hot: np.ndarray) -> DataFrame:
    """The blocks of the open intervals: digest a, b of the core, whether it is hot, place, first window s, windows lo to hi, and the bytes beside the core."""
    side, shared = BLOCK - 1, open_texts.sparkSession.sparkContext.broadcast(hot)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows, cores, starts, lows, highs, sides = _numbers(batch, *PLACE), [], [], [], [], [], []
            for row, (text, spans) in enumerate(zip(batch.column("text"), batch.column("spans"), strict=True)):
                data = text.as_py().encode()
                for s, n, o in sorted({(x["s"], x["n"], x["o"]) for x in spans.as_py()}):
                    gram_at = s + o
                    for block in range((o - n + 1) // BLOCK, o // BLOCK + 1):
                        start = gram_at - block * BLOCK - side
                        low, high = max(0, s - start), min(side, s + n - 1 - start)
                        left, right = data[start + low : start + side], data[start + length : start + length + high]
                        cores.append(xxhash.xxh3_128_digest(data[start + side : start + length], block))
                        sides.append(left.rjust(side, b"\0") + right.ljust(side, b"\0"))
                        starts.append(start)
                        lows.append(low)
                        highs.append(high)
                        rows.append(row)
            a, b = _digests(cores)
            own = np.array(rows, dtype=np.int64)
            yield _batch(a=a, b=b, hot=_is_hot(a, shared.value), **{c: k[own] for c, k in zip(PLACE, keys, strict=True)}, s=pa.array(starts, pa.int32()), lo=pa.array(lows, pa.int32()), hi=pa.array(highs, pa.int32()), sides=pa.array(sides, pa.binary()))

    return open_texts.mapInArrow(found, "a long, b long, hot boolean, f long, t0 long, t1 long, s int, lo int, hi int, sides binary")


def _windows(sides: list[bytes], lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of some blocks as 16 bytes each, j and the bytes beside the core in their order; and which exist."""
    side = BLOCK - 1
    flat = np.frombuffer(b"".join(sides), dtype=np.uint8).reshape(-1, 2 * side)
    key = np.zeros((len(sides), BLOCK, BLOCK), dtype=np.uint8)
    for j in range(BLOCK):
        key[:, j, 0] = j
        key[:, j, 1:] = flat[:, j : j + side]
    place = np.arange(BLOCK)
    return key, (place >= lo[:, None]) & (place <= hi[:, None])


def _runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first column and number of each run of set flags in a row."""
    edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    _, after = np.nonzero(edge == -1)
    return row, first, after - first


def _hot(sampled: DataFrame, key: str) -> np.ndarray:
    """The keys that very many of the sampled rows have, sorted: at most HOT_KEYS, which is what reaches the driver."""
    counted = cut(sampled.groupBy(key).agg(F.count("*").alias("rows")))
    total = counted.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return np.sort(counted.where(F.col("rows") > max(HOT_ROWS, total // HOT_KEYS)).select(key).toArrow().column(key).to_numpy())


def _is_hot(keys: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(keys), dtype=bool)
    return hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys


def _salt(t0: np.ndarray, s: np.ndarray) -> np.ndarray:
    return (_mix(t0.view(np.uint64) + s.astype(np.uint64)) % np.uint64(SALTS)).astype(np.int32)


def _runs(rows: DataFrame, keep: str, dealt: bool) -> DataFrame:
    """Of intervals: those in a run (gone), and those whose windows are still open.

    All intervals of a minimiser meet, or all of one of its parts. A part of a hot minimiser settles
    all but the first of each kind; these meet the firsts of the other parts if dealt is set.
    """

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "g", "part"):
            g, part, a, b = _numbers(group, "g", "part", "a", "b")
            hot = part >= 0
            run = _starts(g, part, a, b)
            number = np.cumsum(_starts(g, part))  # the minimiser
            kinds = np.bincount(number[run])
            is_open = run & ~hot & (kinds[number] > 1)
            gone = np.where(hot, ~run, removable(run, keep))
            rows_of = np.bincount(np.cumsum(run))[np.cumsum(run)]
            size = np.where(hot & run, rows_of, 0)
            shown = group.append_column("gone", pa.array(gone)).append_column("open", pa.array(is_open)).append_column("size", pa.array(size)).filter(pa.array(gone | is_open | (size > 0)))
            yield from shown.drop_columns(["g", "part"]).combine_chunks().to_batches()

    found = rows.repartition("g", "part").sortWithinPartitions("g", "part", "a", "b", *PLACE, "s").mapInArrow(settle, f"a long, b long, {_SPAN}, o int, gone boolean, open boolean, size long")
    columns = [*PLACE, "s", "n", "o", "gone", "open"]
    if not dealt:
        return found.select(columns)
    kind = Window.partitionBy("a", "b")  # at most SALTS rows
    at = F.row_number().over(kind.orderBy(*PLACE, "s"))
    met = found.where("size > 0").withColumns({"at": at, "run": F.sum("size").over(kind)})
    gone = F.col("at") > 1 if keep == "first" else F.col("run") > 1
    return found.where("size = 0").select(columns).unionByName(met.withColumns({"gone": gone, "open": F.col("at") == 1}).select(columns))


def window_factors(keys: np.ndarray, core: np.ndarray, row: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows in suffix order, their longest previous factors up to length, and where in this order each is found.

    keys has 16 bytes a window (its place j in the block, then its bytes beside the core). Only windows
    of one core and one j are compared: no others can be equal. Their places are their rows' order.
    """
    high, low = keys.view(">u8").reshape(-1, 2).T.astype(np.uint64)
    order = np.lexsort((row, low, high, core))
    keys, core = keys[order], core[order]
    begins = _starts(core, keys[:, 0])
    differs = np.ones((len(keys), BLOCK), dtype=bool)  # the last column: all is equal
    differs[1:, :-1] = keys[1:, 1:] != keys[:-1, 1:]
    at = differs.argmax(axis=1)
    # The core stands between the BLOCK - 1 - j bytes on its left and the j on its right.
    common = np.where(at < BLOCK - 1 - keys[:, 0], at, at + length - (BLOCK - 1)) * ~begins
    return order, *longest_previous(row[order], common, np.cumsum(begins) - 1)


def _window_runs(rows: DataFrame, length: int, keep: str) -> DataFrame:
    """The removed windows of blocks, as spans; all blocks of a core meet in a task."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "a", "b"):
            core = np.cumsum(_starts(*_numbers(group, "a", "b")))
            several = np.bincount(core)[core] > 1
            group, core = group.filter(pa.array(several)), core[several]
            if not group.num_rows:
                continue
            windows, held = _windows(group.column("sides").to_pylist(), *_numbers(group, "lo", "hi"))
            row, j = np.nonzero(held)
            order, factor, source = window_factors(windows[row, j], core[row], row, length)  # rows are in order of their places
            row, j, repeats = row[order], j[order], factor >= length
            gone = np.zeros(held.shape, dtype=bool)
            gone[row[repeats], j[repeats]] = True
            if keep == "none":  # what was matched goes as well
                gone[row[source[repeats]], j[source[repeats]]] = True
            at, first, n = _runs_of(gone)
            start = _numbers(group, "s")[0][at] + first
            yield _batch(**{c: _numbers(group, c)[0][at] for c in PLACE}, s=start.astype(np.int32), n=n.astype(np.int32))

    return rows.repartition("a", "b").sortWithinPartitions("a", "b", *PLACE, "s").mapInArrow(settle, _SPAN)


def _single_windows(rows: DataFrame) -> DataFrame:
    """Each window of blocks as an interval of its own, dealt over parts, by a digest of its core and what stands beside it."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows, held = _windows(batch.column("sides").to_pylist(), *_numbers(batch, "lo", "hi"))
            row, j = np.nonzero(held)
            core = np.stack(_numbers(batch, "a", "b"), axis=1)[row]
            a, b = _digests([xxhash.xxh3_128_digest(x.tobytes()) for x in np.concatenate((core.view(np.uint8), windows[row, j]), axis=1)])
            place, s = {c: k[row] for c, k in zip(PLACE, _numbers(batch, *PLACE), strict=True)}, (_numbers(batch, "s")[0][row] + j).astype(np.int32)
            ones = np.ones(len(row), dtype=np.int32)
            yield _batch(g=a, part=_salt(place["t0"], s), a=a, b=b, **place, s=s, n=ones, o=0 * ones)

    return rows.mapInArrow(split, _KIND)


def repeated(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: str = "none") -> DataFrame:
    """t0, t1 and spans (s, n): the windows that are removed from distinct texts, as n windows from byte s on."""
    span = [*PLACE, "s", "n"]
    sample = texts.where(F.pmod("t0", F.lit(HOT_SHARE)) == 0)
    nothing = np.zeros(0, dtype=np.int64)

    def levels(own: DataFrame, hot_grams: np.ndarray, hot_cores: np.ndarray) -> tuple[DataFrame, DataFrame]:
        """The settled intervals, and the blocks of the open ones."""
        found = _runs(sparse(own, length, gram, hot_grams), keep, len(hot_grams) > 0)
        spans = found.where("open").groupBy("t0", "t1").agg(F.collect_list(F.struct("s", "n", "o")).alias("spans"))
        opened = own.join(spans, ["t0", "t1"]).select("t0", "t1", "f", "m", "text", "spans")
        return found.where("gone").select(span), blocks(opened, length, hot_cores)

    hot_grams = _hot(sparse(sample, length, gram, nothing), "g")
    hot_cores = _hot(levels(sample, hot_grams, nothing)[1], "a")
    found, open_blocks = levels(texts, hot_grams, hot_cores)
    found = found.unionByName(_window_runs(open_blocks.where("not hot"), length, keep))
    if len(hot_cores):
        found = found.unionByName(_runs(_single_windows(open_blocks.where("hot")), keep, True).where("gone").select(span))
    return found.groupBy("t0", "t1").agg(F.collect_list(F.struct("s", "n")).alias("spans"))


def clean(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: str = "none") -> DataFrame:
    """t0, t1, f, n_bytes, n_removed, n_spans, kept (the bytes that remain) and kept_sha256 of every distinct text.

    kept is what stays of a text's first copy; with keep="first" nothing stays of the others.
    """

    def dropped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, runs, kept = [], [], [], []
            for text, m, spans in zip(batch.column("text"), batch.column("m").to_pylist(), batch.column("spans"), strict=True):
                data = text.as_py().encode()
                n, gone_bytes, n_runs = len(data), 0, 0
                if n >= length and m > 1 and keep == "none":
                    data, gone_bytes, n_runs = b"", n, 1
                elif spans.is_valid and len(spans):
                    s, k = (spans.values.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("s", "n"))
                    edges = np.zeros(n + 1, dtype=np.int32)
                    np.add.at(edges, s, 1)
                    np.add.at(edges, s + k - 1 + length, -1)
                    gone = np.cumsum(edges[:-1]) > 0
                    gone_bytes = int(gone.sum())
                    n_runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    data = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
                sizes.append(n)
                removed.append(gone_bytes)
                runs.append(n_runs)
                kept.append(data)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("t0", "t1", "f")], pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["t0", "t1", "f", "n_bytes", "n_removed", "n_spans", "kept"])

    # All readers of the texts take all their columns, so that Spark shuffles them once and reuses it.
    texts = texts_of(docs)
    rows = texts.join(repeated(texts, length, gram, keep), ["t0", "t1"], "left").select("t0", "t1", "f", "m", "text", "spans")
    return rows.mapInArrow(dropped, "t0 long, t1 long, f long, n_bytes long, n_removed long, n_spans long, kept binary")


def per_row(docs: DataFrame, found: DataFrame, length: int = LENGTH, keep: str = "none") -> DataFrame:
    """doc_id of every row, with the columns of its text (t0, t1, f, n_bytes, ...)."""
    rows = docs.select("doc_id", *text_key(whole_text(F.col("text"))), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("own"))
    joined = dealt_join(rows, found, ["t0", "t1"])
    if keep == "none":
        return joined
    later = (F.col("own") > F.col("f")) & (F.col("n_bytes") >= length)
    empty = {"n_removed": F.col("n_bytes"), "n_spans": F.lit(1), "kept": F.lit("").cast("binary")}
    return joined.withColumns({c: F.when(later, v).otherwise(F.col(c)) for c, v in empty.items()})


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: str = "none") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that remain) of every row."""
    return per_row(docs, clean(docs, length, gram, keep), length, keep).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept")


def digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """remove() with the hash kept_sha256 in place of the bytes, which then need not go with each copy."""
    found = clean(docs, length, gram).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept", "f")
    return per_row(docs, found, length).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
