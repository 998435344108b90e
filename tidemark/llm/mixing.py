"""Language-model scores: online logistic mixing of byte-context bit predictors, and a word-count base.

The model predicts the bytes of a text, bit by bit from the highest, then an end byte (0). Predictor
o (1 to ORDERS) looks up how often bit 0 and 1 followed in training after the last o bytes and the
bits of this byte so far. The predictors' log odds are combined by weights that a gate picks (how many
predictors have met the context, and the bits so far), and the mix is refined by an adaptive table
over the bits so far and the mixed odds. The probability of a text is the product over its bits, so
score / log10(2) / bytes is its (negative) bits per byte. Text is lower-cased (A-Z) for the model and
for the words alike.

What a byte costs depends on it and the ORDERS bytes before it alone, its gram. So all is done on the
table of distinct grams, which grows with the corpus and stays in Spark:

1. Counts of every gram: in training rows that count, in training rows held apart for the mixer (one
   of APART, by a hash of the text), and in all rows.
2. Mixing. Grams are grouped by the last three context bytes, so that a task has all counts of its
   contexts of three bytes and more; those of one and two bytes are tables that every task has (at most 2^16 and
   2^24 rows, whatever the corpus; some hundred thousand in text). All grams are dealt by a hash of their context
   to SHARDS parts for each LEARN_GRAMS of them, which learn online from the rows held apart, against counts of the
   others, in a fixed order and fixed steps from the same start; the weights are averaged in order of the parts.
   No step depends on partitions, and no task of it grows with the corpus.
3. Costs of every gram with the counts of all training rows.
4. Scores. The most frequent grams and words (at most HOT_GRAMS and HOT) are broadcast and looked up
   where the text is read; the rest are joined in Spark, so nothing is left out.

Defined results: a null text is empty and has only the end token and the end byte; repeated rows are
counted and scored one by one; a null doc_id counts as an empty id; a very long text is hashed alone,
whole; other columns are ignored; an empty table gives an empty result. Without any training row all
counts are zero. Any partitioning gives the same scores, up to the rounding of sums.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import cut, least_count
from tidemark.llm.groups import whole_groups

ORDERS = 5
#: Frequent words and grams that are broadcast.
HOT = 1 << 18
HOT_GRAMS = 1 << 21
#: One of so many training texts is held apart for the mixer.
APART = 8
#: Parts that learn on their own, and distinct grams that so many parts learn from: more grams make more parts.
SHARDS = 8
LEARN_GRAMS = 8_000_000
#: Grams of an online step.
STEP = 128
#: Orders whose counts every task has.
SHARED = 2
RATE = 0.1
#: Parts whose weights the driver sums at a time.
AT_ONCE = 64
#: Cells of the adaptive table a gate, and the largest mixed odds.
CELLS, LIMIT = 24, 12.0
#: Bytes counted or scored at a time.
CHUNK = 1 << 22

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


def grams(texts: list[bytes]) -> np.ndarray:
    """ORDERS bytes of context (zeros before the start) and the byte itself, for every byte and the end byte."""
    gap = b"\0" * ORDERS
    data = np.frombuffer(b"".join(gap + t + b"\0" for t in texts), dtype=np.uint8).astype(np.uint64)
    n = len(data) - ORDERS
    gram = data[:n].copy()
    for k in range(1, ORDERS + 1):
        gram = (gram << np.uint64(8)) | data[k : k + n]
    # A text has len + 1 grams; the ORDERS after them reach into the next text.
    ends = np.cumsum([len(t) + 1 + ORDERS for t in texts])
    keep = np.ones(len(data), dtype=bool)
    for k in range(1, ORDERS + 1):
        keep[ends - k] = False
    return gram[keep[:n]]


def bits(gram: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each of the eight bits: its place, the node (1 and the bits so far), and the bit."""
    byte = (gram & np.uint64(255)).astype(np.int64)
    for at in range(8):
        yield at, (256 | byte) >> (8 - at), (byte >> (7 - at)) & 1


@dataclass
class Known:
    """Grams of one order, sorted, with the log odds of each of their bits and whether any was met."""

    key: np.ndarray
    odds: np.ndarray
    met: np.ndarray

    @classmethod
    def of(cls, seen: np.ndarray, counts: np.ndarray) -> Known:
        """From grams (that may repeat) and their counts."""
        own = np.argsort(seen, kind="stable")
        key, counts = seen[own], counts[own].astype(np.float64)
        found = cls(key, np.zeros((8, len(key)), dtype=np.float32), np.zeros((8, len(key)), dtype=bool))
        for at, _, bit in bits(key):
            node = key >> np.uint64(8 - at)
            first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
            if not len(first):
                continue
            group = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(key)]))))
            whole, ones = np.add.reduceat(counts, first)[group], np.add.reduceat(counts * bit, first)[group]
            found.odds[at], found.met[at] = np.log((ones + 0.4) / (whole - ones + 0.4)), whole > 0
        return found


def odds(gram: np.ndarray, n: np.ndarray, shared: list[Known]) -> tuple[np.ndarray, np.ndarray]:
    """Log odds by bit, gram and order, and by bit and gram how many orders have met the context and the bits so far.

    gram holds all grams of each of its contexts of SHARED + 1 bytes, once each, and n their counts; shared has
    those of the shorter contexts, by order.
    """
    x = np.zeros((8, len(gram), ORDERS), dtype=np.float32)
    level = np.zeros((8, len(gram)), dtype=np.int64)
    for order in range(1, ORDERS + 1):
        mask = np.uint64((1 << (8 * order + 8)) - 1)
        own = shared[order - 1] if order <= SHARED else Known.of(gram & mask, n)
        if not len(own.key):
            continue
        # Where each gram stands among the sorted ones.
        place = np.minimum(np.searchsorted(own.key, gram & mask), len(own.key) - 1)
        known = own.key[place] == gram & mask
        x[:, :, order - 1] = np.where(known, own.odds[:, place], 0)
        level += known & own.met[:, place]
    return x, level


@dataclass
class Mixer:
    """Weights by gate (level and node) and order; adaptive table by node and cell."""

    weights: np.ndarray
    table: np.ndarray

    @classmethod
    def new(cls) -> Mixer:
        return cls(np.tile(2.0 ** np.arange(ORDERS) / (2**ORDERS - 1), ((ORDERS + 1) * 256, 1)), np.zeros((256, CELLS + 1)))

    def mix(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip((x * self.weights[gate]).sum(axis=1), 0.01 - LIMIT, LIMIT - 0.01)

    def refine(self, node: np.ndarray, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The final odds, and the lower cell of the adaptive table with the share of the upper one."""
        place = (mixed + LIMIT) * (CELLS / 2 / LIMIT)
        low = place.astype(np.int64)
        share = place - low
        return mixed + self.table[node, low] * (1 - share) + self.table[node, low + 1] * share, low, share

    def cost(self, gram: np.ndarray, x: np.ndarray, level: np.ndarray) -> np.ndarray:
        """The log10 probability of each gram's byte after its context."""
        total = np.zeros(len(gram))
        for at, node, bit in bits(gram):
            final, _, _ = self.refine(node, self.mix(x[at], level[at] * 256 + node))
            total -= np.logaddexp(0, np.where(bit == 1, -final, final))
        return total / math.log(10)

    def learn(self, gram: np.ndarray, n: np.ndarray, x: np.ndarray, level: np.ndarray) -> None:
        """One online step over grams that occur n times: weights, then the adaptive table, by the error of each prediction."""
        share = n / n.sum()
        for at, node, bit in bits(gram):
            gate = level[at] * 256 + node
            mixed = self.mix(x[at], gate)
            error = (bit - 1 / (1 + np.exp(-mixed))) * share
            gates, own = np.unique(gate, return_inverse=True)
            mass = np.bincount(own, weights=share)
            for order in range(ORDERS):
                self.weights[gates, order] += RATE * np.bincount(own, weights=error * x[at, :, order]) / (mass + 0.02)
            final, low, part = self.refine(node, self.mix(x[at], gate))
            error = (bit - 1 / (1 + np.exp(-final))) * share
            for cell, weight in ((low, 1 - part), (low + 1, part)):
                cells, own = np.unique(node * (CELLS + 1) + cell, return_inverse=True)
                mass, step = (np.bincount(own, weights=w * weight) for w in (share, error))
                self.table.ravel()[cells] += 0.3 * step / (mass + 0.02)


def _texts(batch: pa.RecordBatch, chunk: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """First row and folded bytes of some rows, about `chunk` bytes at a time."""
    held, size, first = [], 0, 0
    for i, text in enumerate(batch.column("text")):
        held.append((text.as_py() or "").encode().translate(_FOLD))
        size += len(held[-1])
        if size >= chunk or i == batch.num_rows - 1:
            yield first, held
            held, size, first = [], 0, i + 1


def gram_counts(rows: DataFrame) -> DataFrame:
    """gram, n (in all rows), n_count (in training rows that count) and n_apart (in those held apart), of rows with text and held_out."""
    kinds = ("n", "n_count", "n_apart")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {0: [], 1: [], 2: []}
        sizes = dict.fromkeys(held, 0)

        def flush(kind: int) -> pa.RecordBatch:
            gram, n = np.unique(grams(held[kind]), return_counts=True)
            held[kind], sizes[kind] = [], 0
            return pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n), *(pa.array(n if kind == k else 0 * n) for k in (1, 2))], ["gram", *kinds])

        for batch in batches:
            for text, kind in zip(batch.column("text"), batch.column("kind").to_pylist(), strict=True):
                held[kind].append((text.as_py() or "").encode().translate(_FOLD))
                sizes[kind] += len(held[kind][-1])
                if sizes[kind] >= CHUNK:
                    yield flush(kind)
        for kind in held:
            if held[kind]:
                yield flush(kind)

    kind = F.when(F.col("held_out"), 0).when(F.pmod(F.xxhash64("text"), F.lit(APART)) == 0, 2).otherwise(1)
    found = rows.select("text", kind.alias("kind")).mapInArrow(counted, "gram long, n long, n_count long, n_apart long")
    return found.groupBy("gram").agg(*[F.sum(c).alias(c) for c in kinds])


def _shared(counts: DataFrame, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The grams of an order of at most SHARED, and how often they stand in counted rows and in rows held apart."""
    mask = (1 << (8 * order + 8)) - 1
    found = counts.groupBy(F.col("gram").bitwiseAND(F.lit(mask)).alias("g")).agg(F.sum("n_count").alias("n_count"), F.sum("n_apart").alias("n_apart")).orderBy("g").toArrow()
    return found["g"].to_numpy().view(np.uint64), found["n_count"].to_numpy(), found["n_apart"].to_numpy()


def fit(counts: DataFrame, learn_grams: int | None = None) -> DataFrame:
    """gram, n and cost (log10 of the probability of its byte) of every gram of a stored table of gram_counts().

    The mixer learns from all grams; given learn_grams, from a sample of that size.
    """
    context = F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit((1 << (8 * SHARED + 8)) - 1))
    n_grams = counts.count()
    shards, share = (SHARDS * max(1, -(-n_grams // LEARN_GRAMS)), 1) if learn_grams is None else (SHARDS, max(1, -(-n_grams // learn_grams)))
    grouped = counts.select("*", context.alias("context"), F.xxhash64(context).alias("mixed")).withColumn("shard", F.pmod("mixed", F.lit(shards)).cast("int"))
    shared = counts.sparkSession.sparkContext.broadcast([_shared(counts, order) for order in range(1, SHARED + 1)])

    def columns(table: pa.Table) -> list[np.ndarray]:
        gram, *rest = (table.column(c).to_numpy() for c in ("gram", "n", "n_count", "n_apart"))
        return [gram.view(np.uint64), *rest]

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard, size = Mixer.new(), None, 0
        held: list[tuple[np.ndarray, ...]] = []

        def steps(last: bool) -> None:
            """Learns from full steps of what is held; at the end of a shard from the rest too."""
            nonlocal held
            if not held:
                return
            gram, n, x, level = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), *(np.concatenate([h[i] for h in held], axis=1) for i in (2, 3))
            end = len(gram) if last else len(gram) // STEP * STEP
            for at in range(0, end, STEP):
                part = slice(at, min(at + STEP, end))
                own.learn(gram[part], n[part], x[:, part], level[:, part])
            held = [(gram[end:], n[end:], x[:, end:], level[:, end:])] if end < len(gram) else []

        def done() -> pa.RecordBatch:
            steps(True)
            flat = np.concatenate((own.weights.ravel(), own.table.ravel()))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([size], pa.int64()), pa.array([flat], pa.list_(pa.float64()))], ["shard", "size", "v"])

        known = [Known.of(seen, n_count) for seen, n_count, _ in shared.value]
        for table in whole_groups(batches, "shard", "context"):
            parts = table.column("shard").to_numpy()
            gram, _, n_count, n_apart = columns(table)
            for s, e in zip(*_runs(parts), strict=True):
                if parts[s] != shard:
                    if shard is not None:
                        yield done()
                    own, shard, size, held = Mixer.new(), int(parts[s]), 0, []
                x, level = odds(gram[s:e], n_count[s:e], known)
                used = np.flatnonzero(n_apart[s:e])
                held.append((gram[s:e][used], n_apart[s:e][used], x[:, used], level[:, used]))
                size += int(n_apart[s:e].sum())
                steps(False)
        if shard is not None:
            yield done()

    used = grouped.where(F.pmod(F.shiftrightunsigned("mixed", 8), F.lit(share)) == 0)
    parts = used.repartition(shards, "shard").sortWithinPartitions("shard", "mixed", "context", "gram").mapInArrow(learned, "shard int, size long, v array<double>")
    # Sums in order of the parts, a slice of them at a time, so that the driver holds few vectors at once.
    learnt = cut(parts)
    mixer, flat, total = Mixer.new(), 0.0, 0
    for first in range(0, shards, AT_ONCE):
        found = learnt.where(F.col("shard").between(first, first + AT_ONCE - 1)).toArrow().sort_by("shard")
        for n, v in zip(found["size"].to_pylist(), found["v"], strict=True):
            flat, total = flat + v.values.to_numpy() * n, total + n
    if total:
        flat = flat / total
        mixer = Mixer(flat[: mixer.weights.size].reshape(mixer.weights.shape), flat[mixer.weights.size :].reshape(mixer.table.shape))
    fitted = counts.sparkSession.sparkContext.broadcast(mixer)

    def costed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Known.of(seen, n_count + n_apart) for seen, n_count, n_apart in shared.value]
        for table in whole_groups(batches, "context"):
            gram, n, n_count, n_apart = columns(table)
            cost = fitted.value.cost(gram, *odds(gram, n_count + n_apart, known))
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n), pa.array(cost)], ["gram", "n", "cost"])

    return grouped.repartition("context").sortWithinPartitions("context").mapInArrow(costed, "gram long, n long, cost double")


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of equal neighbours."""
    cuts = np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]))
    return cuts[:-1], cuts[1:]


def words(rows: DataFrame) -> DataFrame:
    """(word, n) over the texts; each task sums what it has read before the shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for batch in batches:
            for _, texts in _texts(batch):
                for text in texts:
                    found.update(text.split())
                if len(found) > 500_000:
                    yield _counts(found)
                    found.clear()
        yield _counts(found)

    return rows.mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counts(found: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes of every row; learns from rows not held out."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    costs = cut(fit(cut(gram_counts(rows))))
    training = rows.where(~F.col("held_out")).select("text")
    counts = cut(words(training))
    ends = training.count()
    summary = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, kinds = summary["n"] + ends, summary["v"] + (ends > 0)
    divisor = math.log10(total + 0.5 * (kinds + 1))
    least_word, least_gram = least_count(counts, HOT), least_count(costs, HOT_GRAMS)
    top = counts.where(F.col("n") >= least_word).toArrow()
    known_grams = costs.where(F.col("n") >= least_gram).select("gram", "cost").toArrow().sort_by("gram")
    shared = docs.sparkSession.sparkContext.broadcast((dict(zip(top["word"].to_pylist(), top["n"].to_pylist(), strict=True)), known_grams["gram"].to_numpy(), known_grams["cost"].to_numpy()))
    fields = f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double, n_bytes long"
    names = [f.split()[0] for f in fields.split(", ")]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, hot_grams, hot_costs = shared.value
        logs = {w: math.log10(n + 0.5) - divisor for w, n in hot.items()}

        def rest(row: list[int], key: list[bytes], n: list[int], columns: list[pa.Array]) -> pa.RecordBatch:
            empty = pa.nulls(len(row), pa.struct([pa.field(c, x.type) for c, x in zip(names, columns, strict=True)]))
            return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(key, pa.binary()), pa.array(n, pa.int64()), empty], ["row", "key", "tf", "own"])

        for batch in batches:
            for first, texts in _texts(batch, CHUNK // 2):
                part = batch.slice(first, len(texts))
                row_ids = part.column("row").to_pylist()
                gram, where = np.unique(grams(texts), return_inverse=True)
                gram = gram.view(np.int64)
                place = np.minimum(np.searchsorted(hot_grams, gram), max(0, len(hot_grams) - 1))
                known_gram = hot_grams[place] == gram if len(hot_grams) else np.zeros(len(gram), dtype=bool)
                cost = np.where(known_gram, hot_costs[place], 0.0) if len(hot_grams) else np.zeros(len(gram))
                starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
                sums = np.add.reduceat(cost[where], starts)
                n_tokens, known, base, rare_row, rare_key, rare_n = [], [], [], [], [], []
                for row, text in zip(row_ids, texts, strict=True):
                    tokens = Counter(text.split())
                    n_tokens.append(tokens.total() + 1)
                    seen, log = int(ends > 0), math.log10(ends + 0.5) - divisor
                    for word, n in tokens.items():
                        if word in logs:
                            seen += n
                            log += n * logs[word]
                        else:
                            rare_row.append(row)
                            rare_key.append(word)
                            rare_n.append(n)
                    known.append(seen)
                    base.append(log)
                if not known_gram.all():
                    at = np.flatnonzero(~known_gram[where])
                    owner = np.searchsorted(starts, at, side="right") - 1
                    pairs, n = np.unique(np.stack((owner, where[at])), axis=1, return_counts=True)
                    rare_row += [row_ids[o] for o in pairs[0].tolist()]
                    rare_key += [b" g" + g.to_bytes(8, "big") for g in gram[pairs[1]].tolist()]
                    rare_n += n.tolist()
                columns = [part.column("doc_id"), part.column("held_out"), pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(sums, pa.float64()), pa.array([len(t) for t in texts], pa.int64())]
                # No word has a space, so a text's own row meets nothing; its key is spread by the row.
                own = pa.StructArray.from_arrays([c.cast(c.type) for c in columns], names)
                yield pa.RecordBatch.from_arrays([pa.array(row_ids), pa.array([b" r%d" % r for r in row_ids], pa.binary()), pa.nulls(len(texts), pa.int64()), own], ["row", "key", "tf", "own"])
                if rare_row:
                    yield rest(rare_row, rare_key, rare_n, columns)

    each = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(scored, f"row long, key binary, tf long, own struct<{fields.replace(' ', ':').replace(',:', ',')}>")
    gram_key = F.concat(F.lit(b" g"), F.unhex(F.lpad(F.hex("gram"), 16, "0")))
    cold_words = counts.where(F.col("n") < least_word).select(F.col("word").alias("key"), "n", F.lit(None).cast("double").alias("cost"))
    cold_grams = costs.where(F.col("n") < least_gram).select(gram_key.alias("key"), F.lit(None).cast("long").alias("n"), "cost")
    seen, is_word = F.coalesce("n", F.lit(0)), F.col("cost").isNull() & F.col("tf").isNotNull()
    joined = each.join(cold_words.unionByName(cold_grams), "key", "left").select(
        "row",
        "own",
        F.when(is_word & (seen > 0), F.col("tf")).alias("known"),
        F.when(is_word, F.col("tf") * (F.log10(seen + 0.5) - divisor)).alias("base"),
        (F.col("tf") * F.col("cost")).alias("score"),
    )
    # max picks a text's own row, the only one that is not null.
    summed = joined.groupBy("row").agg(F.max("own").alias("own"), *[F.sum(c).alias(c) for c in ("known", "base", "score")])
    return summed.select(
        "own.doc_id",
        "own.held_out",
        "own.n_tokens",
        (F.col("own.known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("own.base") + F.coalesce("base", F.lit(0.0))).alias("base_score"),
        (F.col("own.score") + F.coalesce("score", F.lit(0.0))).alias("score"),
        "own.n_bytes",
    )
