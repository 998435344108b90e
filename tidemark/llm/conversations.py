"""Repair of the structure of conversations: the cheapest edits that leave an optional system turn and pairs of user and assistant.

Windows flag faulty turns; sorted structs of a conversation's turns are folded by aggregate(), which
carries four (cost, plan) structs, one for what the kept turns end in so far: nothing, a system turn, a
user turn, an assistant turn. Each step is a least() over keeping, giving another role, deleting and
inserting. A plan has a letter an edit: D deletes, I and J insert a user and an assistant turn, K keeps,
R and S make it a user and an assistant turn; its audit says I for J and R for S. Plans of the same
cost and start that agree so far do so in their letters too, so the least plan has the least audit.

Conversations are folded in blocks of BLOCK turn numbers. One that has several blocks, however long,
is folded block by block from each of the four states it may be entered in, and these folds are chained;
copies of one turn in a crowded block are one struct with a number. What has to be in one place is the
audit, which is a cell of the result; the repaired text is hashed as it streams by.

Defined results: null role or text is one space; turns are taken by number, nulls first, then by the
digest of role and text (turns of one number that differ have no other order); repeated rows are
duplicates of the first; a null conv_id is a conversation like others; a role counts by its first
character; texts of any length are read whole; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import cut

#: Turn numbers of a block.
BLOCK = 256
#: Rows of a block from which it is split further, by turn and digest.
CROWD = 1024
#: The cost of what cannot be.
NEVER = 10**12
STATES = "esua"
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
BLANKS = " \t\n\x0b\x0c\r"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _bind(value: Column, use) -> Column:
    """use(value), with value evaluated once: a lambda binds it."""
    return F.transform(F.array(value), use)[0]


def _more(state: Column, cost: Column | int, letters: Column | str) -> Column:
    letters = F.lit(letters) if isinstance(letters, str) else letters
    return F.struct((state["cost"] + cost).alias("cost"), F.concat(state["plan"], letters).alias("plan"))


def _closed(s: Column) -> Column:
    """States after inserting a user turn, an assistant turn or both where that is cheaper."""

    def with_assistant(s: Column) -> Column:
        return F.struct(s["e"].alias("e"), s["s"].alias("s"), s["u"].alias("u"), F.least(s["a"], _more(s["u"], INSERT, "J")).alias("a"))

    user = F.least(s["u"], *[_more(s[p], INSERT, "I") for p in "esa"])
    return _bind(F.struct(s["e"].alias("e"), s["s"].alias("s"), user.alias("u"), s["a"].alias("a")), with_assistant)


def _start(entered: Column) -> Column:
    return _bind(F.struct(*[F.struct(F.when(entered == q, 0).otherwise(NEVER).cast("long").alias("cost"), F.lit("").alias("plan")).alias(q) for q in STATES]), _closed)


def _step(s: Column, x: Column) -> Column:
    """States after one more turn, of which copies may follow."""
    kept = F.when(x["fault"].isin("blank", "duplicate"), NEVER).when(x["fault"] == "truncated", TRUNCATED).otherwise(0).cast("long")
    own = lambda initial: x["initial"] == initial
    to_user = lambda p: _more(s[p], kept + F.when(own("u"), 0).otherwise(REROLE), F.when(own("u"), "K").otherwise("R"))
    to_assistant = _more(s["u"], kept + F.when(own("a"), 0).otherwise(REROLE), F.when(own("a"), "K").otherwise("S"))
    to_system = _more(s["e"], kept + F.when(own("s"), 0).otherwise(NEVER), "K")
    deleted = {p: _more(s[p], DELETE, "D") for p in STATES}
    moved = F.struct(
        deleted["e"].alias("e"),
        F.least(deleted["s"], to_system).alias("s"),
        F.least(deleted["u"], *[to_user(p) for p in "esa"]).alias("u"),
        F.least(deleted["a"], to_assistant).alias("a"),
    )
    copies = x["n"] - 1
    without_copies = lambda s: F.when(copies > 0, F.struct(*[_more(s[p], DELETE * copies, F.repeat(F.lit("D"), copies)).alias(p) for p in STATES])).otherwise(s)
    return _bind(_bind(moved, without_copies), _closed)


def _turns(entries: Column, plan: Column) -> Column:
    """The repaired turns (role, text) of a block, whose edits are the plan."""
    turn = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    inserted = lambda letters: F.transform(F.filter(F.split(letters, ""), lambda c: c != ""), lambda c: turn(F.when(c == "I", "user").otherwise("assistant"), F.lit("")))
    lead = lambda rest: F.regexp_extract(rest, "^[IJ]*", 0)
    none = F.array().cast("array<struct<role:string,text:string>>")

    def taken(acc: Column, x: Column) -> Column:
        def apply(before: Column) -> Column:
            letter = F.substr(acc["rest"], F.length(before) + 1, F.lit(1))
            role = F.when(letter == "K", x["role"]).when(letter == "R", "user").otherwise("assistant")
            own = F.when(letter == "D", none).otherwise(F.array(turn(role, x["text"])))
            return F.struct(F.substr(acc["rest"], F.length(before) + 1 + x["n"].cast("int")).alias("rest"), F.concat(acc["out"], inserted(before), own).alias("out"))

        return _bind(lead(acc["rest"]), apply)

    return F.aggregate(entries, F.struct(plan.alias("rest"), none.alias("out")), taken, lambda acc: F.concat(acc["out"], inserted(acc["rest"])))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


def _rows(turns: DataFrame, copies: str | None) -> DataFrame:
    """conv_id, block, turn, role, text, digest and n (copies, or one) of every turn; equal ones of crowded blocks are one row."""
    blank = F.lit(" ")
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"), (F.col(copies) if copies else F.lit(1)).cast("long").alias("n"))
    part = F.floor(F.col("turn") / BLOCK).cast("long")
    rows = rows.where("n > 0").withColumns({"part": part, "digest": F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))})
    whole = F.struct("part", F.lit(None).cast("long").alias("turn"), F.lit("").alias("digits"))
    crowded = cut(rows.groupBy("conv_id", "part").agg(F.count("*").alias("rows")).where(F.col("rows") > CROWD))
    if crowded.isEmpty():
        return rows.withColumn("block", whole).drop("part")
    digits = F.ceil(F.log(16.0, F.col("rows") / CROWD)).cast("int")
    known = crowded.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), digits.alias("digits"))
    marked = rows.join(known, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("part").eqNullSafe(F.col("p")), "left").drop("c", "p")
    calm = marked.where("digits is null").withColumn("block", whole)
    block = F.struct("part", F.col("turn").cast("long").alias("turn"), F.substr("digest", F.lit(1), F.col("digits")).alias("digits"))
    merged = marked.where("digits is not null").withColumn("block", block).groupBy("conv_id", "block", "turn", "digest").agg(F.first("role").alias("role"), F.first("text").alias("text"), F.sum("n").alias("n"))
    keep = ["conv_id", "block", "turn", "role", "text", "n", "digest"]
    return calm.select(keep).unionByName(merged.select(keep))


def _blocks(turns: DataFrame, copies: str | None) -> tuple[DataFrame, bool]:
    """Blocks of conversations: entries in order, `alone` (the conversation has no other), illegal pairs inside, ends; and whether any is not alone."""
    rows = _rows(turns, copies)
    spread = Window.partitionBy("conv_id")
    places = rows.select("conv_id", "block").distinct().withColumn("blocks", F.count("*").over(spread)).where("blocks > 1")
    earlier = Window.partitionBy("conv_id", "digest").orderBy("block")
    seen = rows.select("conv_id", "block", "digest").distinct().withColumn("place", F.row_number().over(earlier)).where("place > 1")
    # Markers meet the rows of their block in one exchange: which conversations are long, and which turns an earlier block has.
    marks = cut(places.select("conv_id", "block", F.lit("").alias("digest")).unionByName(seen.select("conv_id", "block", "digest")))
    long = not marks.isEmpty()
    if long:
        rows = rows.unionByName(marks.withColumn("n", F.lit(0).cast("long")), allowMissingColumns=True)
    by = Window.partitionBy("conv_id", "block")
    kept = F.rtrim("text", F.lit(BLANKS))
    repeated = F.row_number().over(Window.partitionBy("conv_id", "block", "digest").orderBy(F.col("n") > 0, "turn")) > 1
    flagged = rows.repartition("conv_id", "block").withColumns({"alone": F.count_if(F.col("digest") == "").over(by) == 0, "repeated": repeated}).where("n > 0")
    fault = F.when(kept == "", "blank").when(F.col("repeated"), "duplicate").when(~F.right(kept, F.lit(1)).isin(".", "!", "?"), "truncated")
    staged = flagged.withColumns({"fault": fault, "initial": F.left("role", F.lit(1))})
    before = F.lag("initial").over(by.orderBy("turn", "digest", "repeated"))
    staged = staged.withColumn("illegal", F.col("n") - 1 + _illegal(before, F.col("initial")))
    count = lambda which, of: F.sum(F.when(which, of).otherwise(0)).cast("long")
    is_fault = lambda name: F.coalesce(F.col("fault") == name, F.lit(False))
    found = staged.groupBy("conv_id", "block", "alone").agg(
        F.array_sort(F.collect_list(F.struct("turn", "digest", "repeated", "role", "text", "n", "fault", "initial"))).alias("entries"),
        F.sum("illegal").cast("long").alias("illegal"),
        count(is_fault("blank"), F.col("n")).alias("blank"),
        F.sum(F.when(is_fault("blank"), 0).when(is_fault("duplicate"), F.col("n")).otherwise(F.col("n") - 1)).cast("long").alias("duplicate"),
        count(is_fault("truncated"), F.lit(1)).alias("truncated"),
        F.min("turn").alias("first_turn"),
        F.max("turn").alias("last_turn"),
    )
    distinct = F.size(F.array_distinct(F.transform(F.filter("entries", lambda x: x["turn"].isNotNull()), lambda x: x["turn"])))
    return found.withColumns({"n_turns": distinct.cast("long"), "first_initial": F.col("entries")[0]["initial"], "last_initial": F.element_at("entries", -1)["initial"]}), long


def _illegal(before: Column, after: Column) -> Column:
    return F.when(F.concat(before, after).isin("su", "ua", "au"), 0).otherwise(F.when(before.isNotNull(), 1).otherwise(0)).cast("long")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def _gaps(first: Column, last: Column, distinct: Column) -> Column:
    return F.coalesce(last - first + 1 - distinct, F.lit(0)).cast("long")


def _folded(blocks: DataFrame, starts: Column) -> DataFrame:
    return blocks.withColumn("folds", F.transform(starts, lambda q: F.aggregate("entries", _start(q), _step)))


def _short(blocks: DataFrame) -> DataFrame:
    """Conversations of one block: counts, cost, plan and turns."""
    folded = _folded(blocks.where("alone"), F.array(F.lit("e")))
    best = F.least(F.col("folds")[0]["e"], F.col("folds")[0]["a"])
    staged = folded.withColumns({"best": best, "gaps": _gaps(F.col("first_turn"), F.col("last_turn"), F.col("n_turns"))})
    return staged.select("conv_id", *COUNTS, "best.cost", "best.plan", _turns(F.col("entries"), F.col("best.plan")).alias("turns"))


def _chained(parts: DataFrame) -> DataFrame:
    """Conversations of several blocks: counts, cost, plan, and for each block the states it is entered and left in."""
    sums = {c: F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal")}
    listed = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "folds", "first_turn", "last_turn", "n_turns", "first_initial", "last_initial"))).alias("b"), *sums.values())
    number = lambda place: F.element_at("b", place)
    # Blocks that split a crowded one by digest may share a turn, and neighbours may not go together.
    both = F.transform(F.sequence(F.lit(2), F.size("b")), lambda i: F.struct(number(i - 1).alias("x"), number(i).alias("y")))
    shared = F.size(F.filter(both, lambda z: z["x"]["last_turn"] == z["y"]["first_turn"]))
    met = F.aggregate(both, F.lit(0).cast("long"), lambda n, z: n + _illegal(z["x"]["last_initial"], z["y"]["first_initial"]))
    first, last = F.array_min(F.transform("b", lambda z: z["first_turn"])), F.array_max(F.transform("b", lambda z: z["last_turn"]))
    distinct = F.aggregate("b", F.lit(0).cast("long"), lambda n, z: n + z["n_turns"]) - shared
    start = F.struct(*[F.struct(F.lit(0 if q == "e" else NEVER).cast("long").alias("cost"), F.lit("").alias("plan"), F.lit("").alias("path")).alias(q) for q in STATES])

    def through(acc: Column, block: Column) -> Column:
        way = lambda i, p, q: F.struct((acc[p]["cost"] + block["folds"][i][q]["cost"]).alias("cost"), F.concat(acc[p]["plan"], block["folds"][i][q]["plan"]).alias("plan"), F.concat(acc[p]["path"], F.lit(q)).alias("path"))
        return F.struct(*[F.least(*[way(i, p, q) for i, p in enumerate(STATES)]).alias(q) for q in STATES])

    staged = listed.withColumns({"best": F.aggregate("b", start, through, lambda acc: F.least(acc["e"], acc["a"])), "illegal": F.col("illegal") + met, "gaps": _gaps(first, last, distinct)})
    states = F.transform("b", lambda z, i: F.struct(z["block"].alias("block"), F.substr(F.concat(F.lit("e"), "best.path"), i + 1, F.lit(1)).alias("entered"), F.substr("best.path", i + 1, F.lit(1)).alias("left")))
    return staged.select("conv_id", *COUNTS, "best.cost", "best.plan", states.alias("states"))


def _pieces(parts: DataFrame, chained: DataFrame) -> DataFrame:
    """conv_id, block and turns of long conversations."""
    each = chained.select(F.col("conv_id").alias("c"), F.explode("states").alias("x")).select("c", "x.*").withColumnRenamed("block", "b")
    met = parts.join(each, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b")))
    fold = reduce(lambda otherwise, i: F.when(F.col("entered") == STATES[i], F.col("folds")[i]).otherwise(otherwise), range(3), F.col("folds")[3])
    entered = met.withColumn("fold", fold)
    plan = reduce(lambda otherwise, q: F.when(F.col("left") == q, F.col("fold")[q]["plan"]).otherwise(otherwise), "esu", F.col("fold")["a"]["plan"])
    return entered.select("conv_id", "block", _turns(F.col("entries"), plan).alias("turns"))


def _streamed_sha(pieces: DataFrame) -> DataFrame:
    """conv_id and the hash of the repaired text of long conversations, a piece at a time."""
    kind = pieces.schema["conv_id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        done: list[tuple] = []
        for batch in batches:
            for conv, text in zip(batch.column("conv_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = conv, hashlib.sha256(text.encode())
                else:
                    state.update(b"\n" + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], batch.schema.field("conv_id").type), pa.array([d[1] for d in done], pa.string())], ["conv_id", "sha"])
            done = []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], batch.schema.field("conv_id").type), pa.array([state.hexdigest()])], ["conv_id", "sha"])

    texts = pieces.where(F.size("turns") > 0).select("conv_id", "block", _text(F.col("turns")).alias("text"))
    return texts.repartition("conv_id").sortWithinPartitions("conv_id", "block").select("conv_id", "text").mapInArrow(hashed, f"conv_id {kind}, sha string")


def _parts(blocks: DataFrame) -> DataFrame:
    return cut(_folded(blocks.where(~F.col("alone")), F.array(*[F.lit(q) for q in STATES])))


def repaired(turns: DataFrame, copies: str | None = None) -> DataFrame:
    """conv_id, block and turns (role, text): the repaired turns, in order of block and place."""
    blocks, long = _blocks(turns, copies)
    whole = F.struct(F.lit(None).cast("long").alias("part"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("digits"))
    short = _short(blocks).select("conv_id", whole.alias("block"), "turns")
    if not long:
        return short
    parts = _parts(blocks)
    return short.unionByName(_pieces(parts, _chained(parts)))


def report(turns: DataFrame, copies: str | None = None) -> DataFrame:
    """One row a conversation: gaps in its numbers, faulty turns by kind, illegal neighbours, cost and audit of the edits, and the hash of the repaired text.

    copies names a column that says how many times each turn stands there, one after the other.
    """
    blocks, long = _blocks(turns, copies)
    audit = F.translate("plan", "JS", "IR").alias("audit")
    found = _short(blocks).select("conv_id", *COUNTS, "cost", audit, F.sha2(_text(F.col("turns")), 256).alias("repaired_sha256"))
    if not long:
        return found
    parts = _parts(blocks)
    chained = cut(_chained(parts))
    shas = _streamed_sha(_pieces(parts, chained)).withColumnRenamed("conv_id", "c")
    met = chained.join(shas, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return found.unionByName(met.select("conv_id", *COUNTS, "cost", audit, F.coalesce("sha", F.lit(EMPTY_SHA)).alias("repaired_sha256")))


def report_all(turns: DataFrame, conversations: DataFrame, copies: str | None = None) -> DataFrame:
    """report(), with a row of zeros for each of the conversations that has no turn."""
    found = report(turns, copies).withColumnRenamed("conv_id", "c")
    joined = conversations.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*COUNTS, "cost")]
    return joined.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_SHA)).alias("repaired_sha256"))
