"""Near-duplicate removal over ordered signatures.

The greedy rules look at what was kept before. The rows of a job go through one task in order and stream
by, as long as the job has at most BLOCK rows. Longer jobs are cut in blocks of idx, which are worked on side by
side: consecutive rules ask of each block what it would leave behind for every state that it may be entered in,
and chain these answers; leaders() settles a block of each job at a time and thins all later rows of the job by
what it kept. near_pairs() is the way for signature sets that no order ties together.

idx tells the rows of a job apart; signatures are not null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import hamming, strip
from tidemark.functions.store import stored

#: Rows of a job that one task walks through.
BLOCK = 65_536


def _walk(frames: DataFrame, columns: list[str], rule: Callable[[], Callable[..., bool]], jobs: int) -> DataFrame:
    """job_id and idx of the rows that a rule keeps; each job gets a rule of its own, which sees its rows in order."""
    kind = frames.schema["job_id"].dataType.simpleString()

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, keep = object(), None
        for batch in batches:
            chosen = []
            for own, *values in zip(*(batch.column(c).to_pylist() for c in ("job_id", *columns)), strict=True):
                if own != job:
                    job, keep = own, rule()
                chosen.append(keep(*values))
            yield batch.select(["job_id", "idx"]).filter(pa.array(chosen, pa.bool_()))

    # A number of its own, as jobs are few bytes and much work: by size they would all be put in one task.
    tasks = max(1, min(3 * jobs, int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ordered = frames.select("job_id", F.col("idx").cast("long").alias("idx"), *columns).repartition(tasks, "job_id").sortWithinPartitions("job_id", "idx")
    return ordered.mapInArrow(kept, f"job_id {kind}, idx long")


def _far(a: int, b: int, threshold: int) -> bool:
    return ((a ^ b) & (2**64 - 1)).bit_count() >= threshold


def _long_jobs(rows: DataFrame, block: int) -> tuple[int, DataFrame | None]:
    """How many jobs there are, and those of more than block rows, if there are any."""
    sizes = rows.groupBy("job_id").agg(F.count("*").alias("n"))
    jobs, most = sizes.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    return jobs, stored(sizes.where(F.col("n") > block).select("job_id")) if most > block else None


def consecutive(frames: DataFrame, threshold: int, block: int = BLOCK) -> DataFrame:
    """Keeps a frame at least threshold bits from the last one kept. Returns job_id and idx."""
    return consecutive_with_zones(frames.withColumn("in_zone", F.lit(False)), threshold, block)


def consecutive_with_zones(frames: DataFrame, threshold: int, block: int = BLOCK) -> DataFrame:
    """As consecutive(), but a frame with in_zone set is kept and clears what was kept last."""

    def rule() -> Callable[[int, bool], bool]:
        last: list[int] = []

        def keep(sig: int, in_zone: bool) -> bool:
            if not in_zone and last and not _far(last[0], sig, threshold):
                return False
            last[:] = [] if in_zone else [sig]
            return True

        return keep

    rows = frames.select("job_id", F.col("idx").cast("long").alias("idx"), "sig", "in_zone")
    jobs, long = _long_jobs(rows, block)
    if long is None:
        return _walk(rows, ["sig", "in_zone"], rule, jobs)
    short = rows.join(long, "job_id", "left_anti")
    return _walk(short, ["sig", "in_zone"], rule, jobs).unionByName(_chained(stored(rows.join(long, "job_id")), threshold, block))


class _Chain:
    """Rows of a block in order: from each to the next that is kept after it, and to the last one so."""

    def __init__(self, table: pa.Table, threshold: int):
        order = np.argsort(table.column("idx").to_numpy())
        self.idx, self.sig = (table.column(c).to_numpy()[order] for c in ("idx", "sig"))
        self.zone, self.threshold = table.column("in_zone").to_numpy(zero_copy_only=False)[order], threshold
        n = len(self.idx)
        self.next = np.full(n, n)
        self.last = np.arange(n)
        for i in range(n - 1, -1, -1):
            j = i + 1 if self.zone[i] else self.first(int(self.sig[i]), i + 1)
            self.next[i] = j
            if j < n:
                self.last[i] = self.last[j]

    def first(self, sig: int, start: int) -> int:
        """The first row from start that is kept after sig was kept last."""
        step = 64
        while start < len(self.sig):
            part = slice(start, start + step)
            far = self.zone[part] | (np.bitwise_count((self.sig[part] ^ sig).view(np.uint64)) >= self.threshold)
            if far.any():
                return start + int(far.argmax())
            start, step = start + step, 2 * step
        return len(self.sig)

    def entered(self, has: bool, sig: int) -> int:
        return self.first(sig, 0) if has else 0

    def state(self, i: int) -> tuple[bool, int]:
        """What row i leaves behind: whether there is a signature that was kept last, and which."""
        return (False, 0) if self.zone[i] else (True, int(self.sig[i]))


def _chained(rows: DataFrame, threshold: int, block: int) -> DataFrame:
    """job_id and idx of what consecutive_with_zones() keeps, by blocks of idx."""
    kind = rows.schema["job_id"].dataType.simpleString()
    cut = rows.withColumn("chunk", F.floor(F.col("idx") / block).cast("long"))
    # A row for each block, numbered by job.
    places = cut.select("job_id", "chunk").distinct().withColumn("k", F.row_number().over(Window.partitionBy("job_id").orderBy("chunk")).cast("long"))
    cut = stored(cut.join(places, ["job_id", "chunk"]).select("job_id", "k", "idx", "sig", "in_zone"))
    last = cut.groupBy("job_id").agg(F.max("k").alias("last"))

    def table(key: tuple, states: list[tuple], names: list[str]) -> pa.Table:
        columns = [pa.array([k.as_py()] * len(states), k.type) for k in key] + [pa.array([s[i] for s in states], pa.bool_() if n.startswith(("has", "through")) else pa.int64()) for i, n in enumerate(names)]
        return pa.Table.from_arrays(columns, ["job_id", "k", *names])

    def ends(key, group):
        chain = _Chain(group, threshold)
        return table(key, sorted({chain.state(i) for i in np.unique(chain.last)}), ["has", "sig"])

    def answers(key, group, states):
        found = []
        if group.num_rows:
            chain = _Chain(group, threshold)
            for has, sig in zip(states.column("has").to_pylist(), states.column("sig").to_pylist(), strict=True):
                i = chain.entered(has, sig)
                through = i == len(chain.idx)
                found.append((has, sig, *((has, sig) if through else chain.state(int(chain.last[i]))), through))
        return table(key, found, ["has", "sig", "has_out", "sig_out", "through"])

    asked = cut.groupBy("job_id", "k").applyInArrow(ends, f"job_id {kind}, k long, has boolean, sig long")
    first = last.select("job_id", F.lit(1).cast("long").alias("k"), F.lit(False).alias("has"), F.lit(0).cast("long").alias("sig"))
    asked = stored(first.unionByName(asked.withColumn("k", F.col("k") + 1)).distinct())
    told: DataFrame | None = None
    # A state that a whole block leaves as it is goes on to the next; so often as the longest scene at rest has blocks.
    while not asked.isEmpty():
        found = cut.groupBy("job_id", "k").cogroup(asked.groupBy("job_id", "k")).applyInArrow(answers, f"job_id {kind}, k long, has boolean, sig long, has_out boolean, sig_out long, through boolean")
        told = stored(found if told is None else told.unionByName(found))
        onward = told.where("through").select("job_id", (F.col("k") + 1).alias("k"), "has", "sig").distinct()
        asked = stored(onward.join(told, ["job_id", "k", "has", "sig"], "left_anti").join(last, "job_id").where("k <= last").drop("last"))
    # Per job a fold over its blocks' answers, a few numbers each.
    state = lambda has, sig: F.struct(F.col(has).alias("has"), F.col(sig).alias("sig"))
    each = told.groupBy("job_id", "k").agg(F.collect_set(F.struct(state("has", "sig").alias("from"), state("has_out", "sig_out").alias("to"))).alias("ways"))
    listed = each.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("k", "ways"))).alias("blocks"))
    start = F.struct(F.lit(False).alias("has"), F.lit(0).cast("long").alias("sig"))
    path = F.aggregate("blocks", F.struct(start.alias("now"), F.array().cast("array<struct<has:boolean,sig:bigint>>").alias("path")), lambda acc, b: F.struct(F.filter(b["ways"], lambda w: w["from"] == acc["now"])[0]["to"].alias("now"), F.array_append(acc["path"], acc["now"]).alias("path")), lambda acc: acc["path"])
    entered = listed.select("job_id", F.posexplode(path).alias("place", "state")).select("job_id", (F.col("place") + 1).cast("long").alias("k"), "state.has", "state.sig")

    def walked(key, group, states):
        chain = _Chain(group, threshold)
        i, kept = chain.entered(states.column("has")[0].as_py(), states.column("sig")[0].as_py()), []
        while i < len(chain.idx):
            kept.append(int(chain.idx[i]))
            i = int(chain.next[i])
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(kept), key[0].type), pa.array(kept, pa.int64())], ["job_id", "idx"])

    return cut.groupBy("job_id", "k").cogroup(entered.groupBy("job_id", "k")).applyInArrow(walked, f"job_id {kind}, idx long")


#: Bits up to which blocks of signatures that agree are a good key.
BY_BLOCKS = 8
#: Signatures that agree in a block, up to which they are compared one by one.
FEW = 48


class _Held:
    """Signatures that were kept, and whether one of them is under threshold bits from another signature.

    Signatures that differ in fewer than t bits agree in one of t blocks at least, so up to BY_BLOCKS bits only those
    that agree in a block are compared, and the work does not grow with rows times leaders. Where more than
    FEW agree, and above that threshold, all are compared, in vectors.
    """

    def __init__(self, threshold: int):
        edges = [64 * i // max(1, threshold) for i in range(threshold + 1)] if threshold <= BY_BLOCKS else []
        self.threshold, self.n, self.all = threshold, 0, np.zeros(64, dtype=np.int64)
        self.blocks: list[tuple[int, int, dict[int, list[int]]]] = [(a, (1 << (b - a)) - 1, {}) for a, b in zip(edges, edges[1:], strict=False)]

    def near(self, sig: int) -> bool:
        met: list[int] = []
        for shift, mask, found in self.blocks:
            met += found.get(sig >> shift & mask, ())
            if len(met) > FEW:
                break
        else:
            if self.blocks:
                return any(((sig ^ s) & (2**64 - 1)).bit_count() < self.threshold for s in met)
        return bool((np.bitwise_count((self.all[: self.n] ^ sig).view(np.uint64)) < self.threshold).any())

    def add(self, sig: int) -> None:
        if self.n == len(self.all):
            self.all = np.concatenate((self.all, np.zeros(self.n, dtype=np.int64)))
        self.all[self.n] = sig
        self.n += 1
        for shift, mask, found in self.blocks:
            like = found.setdefault(sig >> shift & mask, [])
            # One more than FEW tells that all are to be compared.
            if len(like) <= FEW:
                like.append(sig)

    def taken(self, sig: int) -> bool:
        """Adds a signature that is near none; whether it was."""
        if self.near(sig):
            return False
        self.add(sig)
        return True


def _led(sigs: np.ndarray, threshold: int) -> np.ndarray:
    """Places of the leaders of some signatures in order."""
    if threshold <= BY_BLOCKS:
        held = _Held(threshold)
        return np.array([i for i, sig in enumerate(sigs.tolist()) if held.taken(sig)], dtype=np.int64)
    alive, kept = np.ones(len(sigs), dtype=bool), []
    i = 0
    while i < len(sigs):
        kept.append(i)
        alive[i:] &= np.bitwise_count((sigs[i:] ^ sigs[i]).view(np.uint64)) >= threshold
        alive[i] = False
        later = alive[i + 1 :].argmax() if i + 1 < len(sigs) else 0
        if i + 1 >= len(sigs) or not alive[i + 1 + later]:
            break
        i += 1 + int(later)
    return np.array(kept, dtype=np.int64)


def leaders(frames: DataFrame, threshold: int, block: int = BLOCK) -> DataFrame:
    """Keeps a frame at least threshold bits from every frame kept before. Returns job_id and idx."""
    rows = frames.select("job_id", F.col("idx").cast("long").alias("idx"), "sig")
    rule = lambda: _Held(threshold).taken
    jobs, long = _long_jobs(rows, block)
    if long is None:
        return _walk(rows, ["sig"], rule, jobs)
    short = _walk(rows.join(long, "job_id", "left_anti"), ["sig"], rule, jobs)
    return short.unionByName(_settled(stored(rows.join(long, "job_id")), threshold, block))


def _settled(todo: DataFrame, threshold: int, block: int) -> DataFrame:
    """job_id and idx of the leaders of long jobs: in rounds, the first block of what is left of each job, which then thins the rest."""
    kind = todo.schema["job_id"].dataType.simpleString()
    width = max(1, block // 16)
    todo = todo.withColumn("span", F.floor(F.col("idx") / width).cast("long"))
    kept: DataFrame | None = None

    def lead(key, group):
        group = group.sort_by("idx")
        return group.select(["job_id", "idx", "sig"]).take(pa.array(_led(group.column("sig").to_numpy(), threshold)))

    def thin(key, group, by):
        far = np.ones(group.num_rows, dtype=bool)
        sigs = group.column("sig").to_numpy()
        if threshold <= BY_BLOCKS:
            held = _Held(threshold)
            for sig in by.column("sig").to_pylist():
                held.add(sig)
            return group.filter(pa.array([not held.near(sig) for sig in sigs.tolist()], pa.bool_()))
        for sig in by.column("sig").to_numpy():
            far &= np.bitwise_count((sigs ^ sig).view(np.uint64)) >= threshold
        return group.filter(pa.array(far))

    while not todo.isEmpty():
        counted = todo.groupBy("job_id", "span").agg(F.count("*").alias("n"))
        so_far = F.sum("n").over(Window.partitionBy("job_id").orderBy("span"))
        spans = stored(counted.withColumns({"first": F.min("span").over(Window.partitionBy("job_id")), "so_far": so_far}).select("job_id", "span", ((F.col("so_far") <= block) | (F.col("span") == F.col("first"))).alias("now")))
        marked = todo.join(spans, ["job_id", "span"])
        new = stored(marked.where("now").groupBy("job_id").applyInArrow(lead, f"job_id {kind}, idx long, sig long"))
        kept = new if kept is None else kept.unionByName(new)
        later = spans.where("not now").select(F.col("job_id").alias("job_id"), F.col("span").alias("span"))
        rest = marked.where("not now").select("job_id", "idx", "sig", "span")
        by = new.select("job_id", "sig").join(later, "job_id")
        todo = stored(rest.groupBy("job_id", "span").cogroup(by.groupBy("job_id", "span")).applyInArrow(thin, f"job_id {kind}, idx long, sig long, span long"))
    return kept.select("job_id", "idx")


#: Signatures of a job that one task compares with as many others.
CHUNK = 4096


def near_pairs(frames: DataFrame, threshold: int, chunk: int = CHUNK) -> DataFrame:
    """Pairs of one job under threshold bits apart: job_id, a < b (idx) and distance.

    Signatures that differ in fewer than t bits agree in at least b - t + 1 of b blocks. Up to BY_BLOCKS bits the
    join is on all choices of two agreeing blocks of t + 1, so that unlike signatures seldom meet; a pair
    is kept where its first agreeing choice is met, which needs no distinct. Above, blocks tell
    too little (at 16 bits a choice is met by most pairs): a job's signatures are dealt to chunks,
    and each two chunks are compared in a task, in vectors; only near pairs become rows.
    """
    if threshold > BY_BLOCKS:
        return _compared(frames, threshold, chunk)
    edges = [64 * i // (threshold + 1) for i in range(threshold + 2)]
    spans = list(zip(edges, edges[1:], strict=False))
    bits = lambda sig, a, b: F.shiftrightunsigned(sig, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
    choices = [(i, j) for i in range(threshold + 1) for j in range(i)]
    keys = F.array(*[F.struct(F.lit(n).alias("choice"), F.xxhash64(bits(F.col("sig"), *spans[i]), bits(F.col("sig"), *spans[j])).alias("bits")) for n, (i, j) in enumerate(choices)])
    keyed = frames.select("job_id", "idx", "sig", F.explode(keys).alias("x")).select("job_id", "idx", "sig", "x.*")
    left = keyed.select("job_id", "choice", "bits", F.col("idx").alias("a"), F.col("sig").alias("sig_a"))
    right = keyed.select("job_id", "choice", "bits", F.col("idx").alias("b"), F.col("sig").alias("sig_b"))
    distance = hamming(F.col("sig_a"), F.col("sig_b"))
    same = [bits(F.col("sig_a"), *s) == bits(F.col("sig_b"), *s) for s in spans]
    first = F.coalesce(*[F.when(same[i] & same[j], F.lit(n)) for n, (i, j) in enumerate(choices)])
    met = left.join(right, ["job_id", "choice", "bits"]).where("a < b").withColumn("distance", distance).where(F.col("distance") < threshold)
    return met.where(F.col("choice") == first).select("job_id", "a", "b", "distance")


def _compared(frames: DataFrame, threshold: int, chunk: int) -> DataFrame:
    rows = frames.select("job_id", F.col("idx").cast("long").alias("idx"), "sig")
    sizes = rows.groupBy("job_id").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("idx"), F.col("chunks")).cast("int")
    dealt = rows.join(sizes, "job_id").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    # Each two chunks are one task.
    tasks = dealt.select("job_id", "idx", "sig", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    kind = rows.schema["job_id"].dataType.simpleString()

    def compare(key, group):
        job, x, y = (k.as_py() for k in key)
        idx, sig, part = (group.column(c).to_numpy() for c in ("idx", "sig", "own"))
        left, right = np.flatnonzero(part == x), np.flatnonzero(part == y)
        found, step = [], max(1, 4_000_000 // max(1, len(right)))
        for at in range(0, len(left), step):
            own = left[at : at + step]
            distance = np.bitwise_count((sig[own][:, None] ^ sig[right][None, :]).view(np.uint64))
            i, j = np.nonzero(distance < threshold)
            a, b, d = idx[own[i]], idx[right[j]], distance[i, j]
            # Inside one chunk each pair is met from both sides.
            once = a < b if x == y else a != b
            found.append(np.stack((np.minimum(a, b)[once], np.maximum(a, b)[once], d[once].astype(np.int64))))
        a, b, d = np.concatenate(found, axis=1) if found else np.zeros((3, 0), dtype=np.int64)
        return pa.Table.from_arrays([pa.array([job] * len(a), group.schema.field("job_id").type), pa.array(a), pa.array(b), pa.array(d.astype(np.int32))], ["job_id", "a", "b", "distance"])

    return tasks.groupBy("job_id", "x", "y").applyInArrow(compare, f"job_id {kind}, a long, b long, distance int")


def first_of_meaning(screens: DataFrame) -> DataFrame:
    """The first screen of each label with the same text, components and state; without text or components, each path's first."""
    blank = F.lit("")
    text, state = F.lower(strip(F.coalesce("key_text", blank))), F.coalesce("state", blank)
    parts = F.array_sort(F.coalesce("components", F.array().cast("array<string>")))
    path = F.col("path").cast("string") if "path" in screens.columns else F.col("idx").cast("string")
    key = F.when(text != "", F.struct(F.lit("text").alias("by"), "label", text.alias("text"), parts.alias("parts"), state.alias("state"))).when(
        F.size(parts) > 0, F.struct(F.lit("parts").alias("by"), "label", blank.alias("text"), parts.alias("parts"), state.alias("state"))
    ).otherwise(F.struct(F.lit("path").alias("by"), blank.alias("label"), path.alias("text"), parts.alias("parts"), blank.alias("state")))
    first = F.row_number().over(Window.partitionBy("job_id", "__key").orderBy("idx"))
    return screens.withColumn("__key", key).withColumn("__n", first).where("__n = 1").drop("__n", "__key")
