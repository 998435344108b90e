"""SimHash near-duplicates: exact pairs within a Hamming radius from vantage-point trees over shards.

Shards come from the pigeonhole rule: codes at most r bits apart agree in at least b - r of b blocks,
so every link lies in some shard of codes that share the same b - r blocks. (A vantage-point split
alone would not do as the outer level: codes of unlike texts stand 32 +- 4 bits from any vantage
point, so with r = 4 two thirds of them overlap each boundary and go to both sides.) A shard of more
than CHUNK codes is cut into chunks, and each pair of chunks is a task of its own. Inside a task a
vantage-point tree finds the links: codes within r of the vantage point form one component at once,
and by the triangle inequality only codes up to 2r away can touch it; the rest is split at the
median distance, and across the split only codes within r of the boundary are compared.

Links are kept as spanning forests, never as all pairs of a group. Components are found by stars.

Defined results: a null or empty text has no shingle and fingerprint zero, which links like any
other; repeated rows each get a result; a null doc_id never names a component; a bit that is set in
exactly half the shingles is 0; a text of any length is hashed whole, 8 bytes a shingle; other columns
of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import jaccard
from tidemark.llm.components import components, cut, dealt_join
from tidemark.llm.groups import whole_groups
from tidemark.llm.jaccard import hashes

#: Codes of a shard that one task holds; larger shards are cut into chunks of about half of it.
CHUNK = 8192
#: Codes that are compared without a tree.
LEAF = 64
#: Bits that the codes of a shard share at least, so that small and large tables are sharded alike.
SHARED_BITS = 16

def fingerprint(text: str | None, words: int) -> int:
    """The 64-bit SimHash of the word shingles of A-Z lower-cased text, repeats included."""
    return of_hashes(hashes(text, words))


def of_hashes(hashes: np.ndarray) -> int:
    """The bits that are set in over half of some hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        counts += np.unpackbits(hashes[at : at + 8192].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([fingerprint(x.as_py(), words) for x in batch.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(codes.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(coded, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


class Forest:
    """Union-find over the codes of one task; keeps only the links that join two trees."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        ra, rb = self.root[a], self.root[b]
        apart = np.flatnonzero(ra != rb)
        if not len(apart):
            return
        _, first = np.unique(np.minimum(ra[apart], rb[apart]) * len(self.root) + np.maximum(ra[apart], rb[apart]), return_index=True)
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while x in above:
                x = above[x]
            return x

        for i in apart[first].tolist():
            x, y = top(int(ra[i])), top(int(rb[i]))
            if x != y:
                above[max(x, y)] = min(x, y)
                self.links.append((int(a[i]), int(b[i])))
        if above:
            old = np.array(list(above))
            new = np.array([top(int(x)) for x in old])
            to = np.arange(len(self.root))
            to[old] = new
            self.root = to[self.root]


def _cross(codes: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, forest: Forest) -> None:
    step = max(1, 1_000_000 // max(1, len(b)))
    for at in range(0, len(a), step):
        part = a[at : at + step]
        x, y = np.nonzero((np.bitwise_count(codes[part][:, None] ^ codes[b][None, :]) <= radius) & (forest.root[part][:, None] != forest.root[b][None, :]))
        if len(x):
            forest.join(part[x], b[y])


def vantage_links(codes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links (places of codes at most radius bits apart)."""
    forest = Forest(len(codes))
    todo = [np.arange(len(codes))]
    while todo:
        own = todo.pop()
        if len(own) <= LEAF:
            if len(own) > 1:
                _cross(codes, own, own, radius, forest)
            continue
        distance = np.bitwise_count(codes[own] ^ codes[own[0]])
        near, rest = own[distance <= radius], own[distance > radius]
        forest.join(np.full(len(near), own[0]), near)
        d = distance[distance > radius]
        _cross(codes, rest[d <= 2 * radius], near, radius, forest)
        if len(rest) <= LEAF:
            todo.append(rest)
            continue
        middle = np.sort(d)[(len(d) - 1) // 2]
        inside, outside = rest[d <= middle], rest[d > middle]
        todo.append(inside)
        if len(outside):
            todo.append(outside)
            _cross(codes, inside[d[d <= middle] > middle - radius], outside[d[d > middle] <= middle + radius], radius, forest)
    return forest.links


def _plan(radius: int, n: int) -> list[list[tuple[int, int]]]:
    """The blocks (offset, bits) that each kind of shard shares: the fewest kinds that keep shards of unlike codes small."""
    for blocks in range(radius + 1, 2 * radius + 3):
        edges = [64 * i // blocks for i in range(blocks + 1)]
        bits = 64 * (blocks - radius) // blocks
        if SHARED_BITS <= bits and n <= 2**bits * 256 or blocks == 2 * radius + 2:
            return [[(edges[i], edges[i + 1] - edges[i]) for i in kept] for kept in combinations(range(blocks), blocks - radius)]
    raise AssertionError


def links(codes: DataFrame, radius: int) -> DataFrame:
    """Spanning links (a, b) of a table of distinct codes fp."""
    kinds = _plan(radius, codes.count())
    bits = lambda at, n: F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << n) - 1))
    keys = F.array(*[F.struct(F.lit(i).alias("kind"), F.xxhash64(*[bits(*x) for x in kind]).alias("shard")) for i, kind in enumerate(kinds)])
    keyed = codes.select("fp", F.explode(keys).alias("key")).select("fp", "key.kind", "key.shard")
    large = keyed.groupBy("kind", "shard").agg(F.count("*").alias("n"))
    # Shards of one code hold no link; large ones are cut into chunks.
    sized = keyed.join(large.where("n > 1"), ["kind", "shard"])
    chunks = F.greatest(F.lit(1), F.ceil(F.col("n") * 2 / CHUNK)).cast("int")
    dealt = sized.withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    # A chunk meets every other one once; a single chunk meets itself.
    other = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: x != F.col("own")))
    met = dealt.select("fp", "kind", "shard", "own", F.explode(other).alias("other"))
    rows = met.select(F.xxhash64("kind", "shard", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "fp")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(codes: np.ndarray) -> pa.RecordBatch:
            pairs = vantage_links(codes, radius)
            a, b = (np.array([p[i] for p in pairs], dtype=np.int64) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(codes[a].view(np.int64)), pa.array(codes[b].view(np.int64))], ["a", "b"])

        task, held = None, []
        for batch in batches:
            tasks, codes = batch.column("task").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            cuts = np.concatenate(([0], np.flatnonzero(tasks[1:] != tasks[:-1]) + 1, [len(tasks)]))
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                if tasks[s] != task:
                    if held:
                        yield found(np.concatenate(held))
                    task, held = tasks[s], []
                held.append(codes[s:e].copy())
        if held:
            yield found(np.concatenate(held))

    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(search, "a long, b long")


def classes(docs: DataFrame, words: int, radius: int) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    coded = cut(fingerprints(docs, words))
    own = cut(coded.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(own.select("fp"), radius))
    rooted = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return dealt_join(coded, rooted.join(smallest, "root").select("fp", "component_id"), ["fp"]).select("doc_id", "fp", "component_id")


#: Growing radii of the trees of large shards, in bits of a SimHash of 64.
RADII = (4, 10, 20)
#: Texts of a shard that are compared all with all at once; larger shards are searched by trees first.
PAIRS = 48
#: Texts of a component that one task holds to compare others with.
MEMBERS = 2048
#: Rows whose places are broadcast.
BROADCAST_ROWS = 500_000
#: Rows that a task makes at a time, and pairs that it looks at.
FLUSH, LOOKED_AT = 32_768, 250_000
#: Words of the signatures of a set (see jaccard.signatures).
SIGNED = ("p0", "p1", "f0", "f1")


def _profiles(rows: DataFrame, row: str, words: int, known: jaccard.Frequent) -> DataFrame:
    """doc_id, row, the code of the shingle set, its size, its share of frequent shingles, and those of its prefix whose shards are cut."""
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, n, common, cut_up = [], [], [], []
            for text in batch.column("text"):
                own = np.unique(hashes(text.as_py(), words))
                x, parts, often = jaccard.prefix(own, shared.value)
                code.append(jaccard.code_of(own))
                n.append(len(own))
                common.append(often)
                cut_up.append(x[parts > 1].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column(row), pa.array(np.array(code, dtype=np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(common, pa.int32()), pa.array(cut_up, pa.list_(pa.int64()))], ["doc_id", "row", "code", "n", "common", "cut_up"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", row, F.col("text").cast("string").alias("text")).mapInArrow(made, f"doc_id {kind}, row long, code long, n int, common int, cut_up array<long>")


SHARD = "x long, part int, parts int, code long, n int, common int, p0 long, p1 long, f0 long, f1 long"
_SHARD_NAMES = [f.split(" ")[0] for f in SHARD.split(", ")]


def _shards(rows: DataFrame, words: int, known: jaccard.Frequent) -> DataFrame:
    """A row for each shard (x, part) that a text is in: those of the prefix of its shingle set."""
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: list[tuple[np.ndarray, ...]] = []
        texts: list[tuple] = []
        rows = 0

        def flush() -> pa.RecordBatch:
            lengths = [len(x) for x, _, _ in shards]
            own = [np.repeat(np.array(c), lengths) for c in zip(*texts, strict=True)]
            columns = [*(np.concatenate(c) for c in zip(*shards, strict=True)), *own]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * len(SIGNED)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _SHARD_NAMES)

        for batch in batches:
            for text in batch.column("text"):
                own = np.unique(hashes(text.as_py(), words))
                code = np.uint64(jaccard.code_of(own))
                x, parts, common = jaccard.prefix(own, shared.value)
                # A text meets other texts in the parts of other shards.
                part = (((code ^ x) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % parts.astype(np.uint64)).astype(np.int32)
                shards.append((x.view(np.int64), part, parts.astype(np.int32)))
                texts.append((code.view(np.int64), len(own), common, *jaccard.signatures(own).view(np.int64)))
                rows += len(x)
                if rows >= FLUSH:
                    yield flush()
                    shards, texts, rows = [], [], 0
        if shards:
            yield flush()

    return rows.select(F.col("text").cast("string").alias("text")).mapInArrow(dealt, SHARD)


def shard_pairs(code: np.ndarray, n: np.ndarray, common: np.ndarray, signed: tuple[np.ndarray, ...], group: np.ndarray, pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of candidate pairs, of rows in the order of their shards (group).

    Shards of at most `pairs` texts give all pairs that may be alike. Larger ones give a star around
    the text with most frequent shingles (the one that others were made from, if it is there), and
    for growing radii the spanning links of a vantage-point tree: a number of links in proportion.
    """
    sizes = np.bincount(group)[group]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    small = np.flatnonzero((sizes > 1) & (sizes <= pairs))
    for step in range(1, pairs):
        small = small[small + step < len(group)]
        small = small[group[small] == group[small + step]]
        if not len(small):
            break
        near = jaccard.may_be_alike(signed, n, small, small + step)
        found.append((small[near], small[near] + step))
    large = np.flatnonzero(sizes > pairs)
    for own in np.split(large, np.flatnonzero(np.diff(group[large])) + 1) if len(large) else []:
        centre = own[np.lexsort((code[own], -common[own]))[0]]
        found.append((np.full(len(own), centre), own))
        for radius in RADII:
            links = np.array(vantage_links(signed[2][own].view(np.uint64), radius), dtype=np.int64).reshape(-1, 2)
            found.append((own[links[:, 0]], own[links[:, 1]]))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    near = (code[a] != code[b]) & jaccard.may_be_alike(signed, n, a, b)
    return a[near], b[near]


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, ...], np.ndarray]:
    """code, n, common, signatures and shard number of rows in the order of their shards."""
    code, n, common, x, part, *signed = (table.column(c).to_numpy() for c in ("code", "n", "common", "x", "part", *SIGNED))
    new = np.ones(len(code), dtype=bool)
    new[1:] = (x[1:] != x[:-1]) | (part[1:] != part[:-1])
    return code, n.astype(np.int64), common, tuple(signed), np.cumsum(new)


def candidates(shards: DataFrame, pairs: int) -> DataFrame:
    """Pairs (code, other) to be compared, in rows without x; and the rows of large shards (and cut ones), in which not all pairs are among them."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "x", "part"):
            code, n, common, signed, group = _columns(table)
            a, b = shard_pairs(code, n, common, signed, group, pairs)
            both = np.unique(np.sort(np.stack((code[a], code[b]), axis=1), axis=1), axis=0)
            nothing = {f.name: pa.nulls(len(both), f.type) for f in table.schema}
            yield pa.RecordBatch.from_arrays([*(nothing | {"code": pa.array(both[:, 0])}).values(), pa.array(both[:, 1])], [*table.column_names, "other"])
            sizes = np.bincount(group)[group]
            large = table.filter(pa.array((sizes > pairs) | (table.column("parts").to_numpy() > 1)))
            yield from large.append_column("other", pa.nulls(large.num_rows, pa.int64())).to_batches()

    return shards.repartition("x", "part").sortWithinPartitions("x", "part", "code").mapInArrow(search, SHARD + ", other long")


def _apart(large: DataFrame, comps: DataFrame) -> DataFrame:
    """(home, code, own) of the texts of large shards that may be alike to one of another component: home is the component that has more of the shard's texts, own whether the text is of it.

    The parts of a cut shard are searched one by one; texts that are not of its main component are in all of them.
    """
    marked = large.join(comps.withColumnRenamed("node", "code"), "code", "left").withColumn("comp", F.coalesce("root", "code")).drop("root", "other")
    # A shard of one component needs no search.
    held = marked.groupBy("x", "comp").agg(F.count("*").alias("m"))
    mains = held.groupBy("x").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1")
    met = dealt_join(marked, mains.select("x", "main"), ["x"])
    own = F.struct("part", F.lit(False).alias("guest"))
    others = F.transform(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p != F.col("part")), lambda p: F.struct(p.cast("int").alias("part"), F.lit(True).alias("guest")))
    places = F.when((F.col("parts") > 1) & (F.col("comp") != F.col("main")), F.concat(F.array(own), others)).otherwise(F.array(own))
    dealt = met.withColumn("place", F.explode(places)).withColumns({"part": F.col("place.part"), "guest": F.col("place.guest")}).drop("place", "main")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "x", "part"):
            code, n, _, signed, group = _columns(table)
            comp, guest = table.column("comp").to_numpy(), table.column("guest").to_numpy(zero_copy_only=False)
            for rows in np.split(np.arange(len(code)), np.flatnonzero(np.diff(group)) + 1):
                found, count = [], dict(zip(*(v.tolist() for v in np.unique(comp[rows], return_counts=True)), strict=True))
                if len(count) < 2:
                    continue
                step = max(1, LOOKED_AT // len(rows))
                for at in range(0, len(rows), step):
                    i, j = (v.ravel() for v in np.meshgrid(rows[at : at + step], rows, indexing="ij"))
                    cross = (comp[i] != comp[j]) & (i < j) & ~(guest[i] & guest[j])
                    i, j = i[cross], j[cross]
                    near = jaccard.may_be_alike(signed, n, i, j)
                    found.append(np.stack((i[near], j[near])))
                i, j = np.concatenate(found, axis=1)
                if not len(i):
                    continue
                size = np.array([count[c] for c in comp[rows].tolist()])
                first, second = size[i - rows[0]], size[j - rows[0]]
                home = np.where((first > second) | (first == second) & (comp[i] < comp[j]), comp[i], comp[j])
                each = np.unique(np.concatenate((np.stack((home, code[i])), np.stack((home, code[j]))), axis=1), axis=1)
                own = dict(zip(code[rows].tolist(), comp[rows].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(each[0]), pa.array(each[1]), pa.array([own[c] == h for h, c in each.T.tolist()], pa.bool_())], ["home", "code", "own"])

    kept = dealt.select(*_SHARD_NAMES, "comp", "guest").repartition("x", "part").sortWithinPartitions("x", "part", "code")
    return kept.mapInArrow(search, "home long, code long, own boolean").distinct()


def _links_across(apart: DataFrame, sets: DataFrame, members: int) -> DataFrame:
    """Links (a, b) between components: for each text and each component that it may belong to, one that is exactly 4/5 or more alike, if there is any."""
    sizes = apart.where("own").groupBy("home").agg(F.ceil(F.count("*") / members).cast("int").alias("parts"))
    dealt = dealt_join(apart, sizes, ["home"])
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    part = F.explode(F.when(F.col("own"), F.array(F.pmod(F.xxhash64("code"), F.col("parts")).cast("int"))).otherwise(every))
    rows = dealt_join(dealt.withColumn("part", part).select("home", "part", "own", "code"), sets, ["code"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, start, index = None, 0, None
        codes: list[int] = []
        held: list[np.ndarray] = []
        for batch in batches:
            found = []
            for home, part, own, code, shingles in zip(*(batch.column(c).to_pylist() for c in ("home", "part", "own", "code")), batch.column("shingles"), strict=True):
                if (home, part) != key:
                    key, codes, held, index = (home, part), [], [], None
                values = shingles.values.to_numpy()
                if own:
                    codes.append(code)
                    held.append(values)
                    continue
                if not held:
                    continue
                if index is None:
                    sizes = np.array([len(h) for h in held])
                    flat, owner = np.concatenate(held), np.repeat(np.arange(len(held)), sizes)
                    order = np.argsort(flat, kind="stable")
                    index = (flat[order], owner[order], sizes)
                flat, owner, sizes = index
                lo, hi = np.searchsorted(flat, values, "left"), np.searchsorted(flat, values, "right")
                start = np.repeat(lo - np.concatenate(([0], np.cumsum(hi - lo)[:-1])), hi - lo)
                common = np.bincount(owner[start + np.arange(len(start))], minlength=len(sizes))
                alike = np.flatnonzero(9 * common >= 4 * (sizes + len(values)))
                if len(alike):
                    found.append((code, codes[alike[0]]))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    ordered = rows.repartition("home", "part").sortWithinPartitions("home", "part", F.desc("own"))
    return ordered.select("home", "part", "own", "code", "shingles").mapInArrow(search, "a long, b long")


def keep_one(docs: DataFrame, words: int = 5, pairs: int = PAIRS, members: int = MEMBERS, shard_texts: int = jaccard.SHARD_TEXTS) -> DataFrame:
    """One row of each component of near copies, the one with the smallest doc_id (the first such row), with all columns.

    Near copies have a Jaccard similarity of their shingle sets of 4/5 or more, which is compared exactly.
    Shards hold the texts with a common shingle among the first of their sets (see jaccard), so that no pair
    of that similarity is parted. In a shard of at most `pairs` texts all pairs that may be alike
    (jaccard.may_be_alike) are compared. In a larger one a star and the links of vantage-point trees by
    SimHash are compared first; then every text that may be alike to one of another component is compared
    with all such texts of that component, in tasks of `members` of them, so that no link between
    components is lost and no pair becomes a row. Frequent shingles' shards are cut in parts of about shard_texts.

    Rows are told apart by their place in the input, so docs must be a table that reads alike twice.
    """
    row = "row"
    while row in docs.columns:
        row += "_"
    placed = docs.withColumn(row, F.monotonically_increasing_id())
    known = jaccard.frequent(docs, words, shard_texts)
    coded = cut(_profiles(placed, row, words, known))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    own = cut(coded.groupBy("code").agg(F.min(place).alias("first"), *[F.first(c).alias(c) for c in ("n", "common", "cut_up")]))

    def of_codes(codes: DataFrame) -> DataFrame:
        """The first rows of some codes."""
        firsts = codes.select(F.col("first.row").alias(row))
        return placed.join(F.broadcast(firsts) if firsts.count() <= BROADCAST_ROWS else firsts, row, "left_semi")

    def sets_of(codes: DataFrame) -> DataFrame:
        return cut(jaccard.sets(of_codes(own.join(codes, "code", "left_semi")), words))

    searched = cut(candidates(_shards(of_codes(own), words, known), pairs))
    large = searched.where("x is not null")
    found = searched.where("x is null").select(F.col("code").alias("a"), F.col("other").alias("b")).distinct()
    if (known.parts > 1).any():
        # The parts of a shard meet through its centre, the text with most frequent shingles.
        whole = own.select("code", "n", "common", F.explode("cut_up").alias("x"))
        centres = whole.groupBy("x").agg(F.min_by(F.struct("code", "n"), F.struct(-F.col("common"), "code")).alias("c"))
        met = whole.join(F.broadcast(centres), "x").where("code <> c.code and 5 * least(n, c.n) >= 4 * greatest(n, c.n)")
        found = found.unionByName(met.select(F.least("code", "c.code").alias("a"), F.greatest("code", "c.code").alias("b"))).distinct()
    found = cut(found)
    sets = sets_of(found.select(F.explode(F.array("a", "b")).alias("code")).distinct())
    compared = found
    for side in "ab":
        compared = dealt_join(compared, sets.select(F.col("code").alias(side), F.col("shingles").alias("s" + side)), [side])
    near = cut(jaccard.alike(compared))
    roots = components(near)
    if not large.isEmpty():
        apart = cut(_apart(large, roots))
        if not apart.isEmpty():
            across = _links_across(apart, sets_of(apart.select("code").distinct()), members)
            roots = components(near.unionByName(across))
    rooted = own.join(roots.withColumnRenamed("node", "code"), "code", "left").select("first", F.coalesce("root", "code").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.row")
    dropped = cut(coded.join(kept, "row", "left_anti").select(F.col("row").alias(row)))
    return placed.join(F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS else dropped, row, "left_anti").select(*docs.columns)
