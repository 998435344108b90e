"""Fingerprints, conversation repair and clustering against plain versions."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tidemark.llm import conversations, kmeans, registry, sql, winnow

DATA = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Winnowing.
def plain_winnow(text, k=16, w=32):
    """The least hash of every window, the last of equal ones; and the hash of every run."""
    hashes = winnow.rolling(winnow.code_points(text), k)
    if not len(hashes):
        return [], []
    windows = np.lib.stride_tricks.sliding_window_view(hashes, min(w, len(hashes)))
    last = windows.shape[1] - 1 - windows[:, ::-1].argmin(axis=1)
    return sorted(set((np.arange(len(windows)) + last).tolist())), hashes.tolist()


def test_hash_of_a_run_is_its_own():
    text = "é漢😀 some text, with some more of some text" * 3
    hashes = winnow.rolling(winnow.code_points(text))
    each = [int(winnow.rolling(winnow.code_points(text[i : i + winnow.K]))[0]) for i in range(len(text) - winnow.K + 1)]
    assert hashes.tolist() == each
    runs = [text[i : i + winnow.K] for i in range(len(each))]
    assert len(set(runs)) == len(set(each))


def plain_compared(rows):
    """(doc_id, text) rows in descending order of ids, nulls last."""
    out = []
    for i, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        prints = []
        for t in (text, changed, following):
            places, hashes = plain_winnow(t)
            prints.append((",".join(f"{hashes[p]:08x}@{p}" for p in places), {hashes[p] for p in places}))
        like = lambda a, b: 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0
        out.append((doc_id, len(text), sha(changed), prints[0][0], prints[1][0], round(like(prints[0][1], prints[1][1]), 9), round(like(prints[0][1], prints[2][1]), 9)))
    return out


def rounded(rows):
    return sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows], key=repr)


def test_winnow_is_the_rule():
    rng = random.Random(5)
    for n in [0, 1, 5, 15, 16, 17, 30, 46, 47, 48, 100, 700]:
        for letters in ("ab", "abcdefgh é漢😀", "a"):
            text = "".join(rng.choice(letters) for _ in range(n))
            places, hashes = plain_winnow(text)
            found = winnow.winnow(text)
            assert found.places.tolist() == places and found.hashes.tolist() == [hashes[p] for p in places]


def test_shared_passages_are_found():
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    for _ in range(100):
        passage = word(winnow.K + winnow.WINDOW - 1)
        a, b = (winnow.winnow(word(rng.randrange(200)) + passage + word(rng.randrange(200))) for _ in range(2))
        assert set(a.hashes.tolist()) & set(b.hashes.tolist())


def test_compared_equals_plain(spark):
    rng = random.Random(7)
    ids = rng.sample(range(-500, 500), 120)
    texts = ["", None, "x", "short text", "é漢😀" * 40] + ["".join(rng.choice("abcde f") for _ in range(rng.randrange(400))) for _ in range(110)]
    rows = [(i, rng.choice(texts)) for i in ids] + [(1000, "long " * 60_000)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, range string, guest int").repartition(7)
    expected = plain_compared(sorted(rows, key=lambda r: -r[0]))
    assert rounded(winnow.compared(docs).collect()) == rounded(expected)


def test_compared_with_null_and_repeated_ids(spark):
    rows = [(None, "no id here at all, but a text"), (3, "aaaa bbbb cccc dddd eeee"), (3, "aaaa bbbb cccc dddd eeee"), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = plain_compared([rows[1], rows[2], rows[3], rows[0]])
    assert rounded(winnow.compared(docs).collect()) == rounded(expected)
    assert winnow.compared(docs.limit(0)).count() == 0
    alone = winnow.compared(docs.where("doc_id = 1")).first()
    assert (alone.n_chars, alone.fingerprint, alone.near_edited, alone.near_next) == (0, "", 1.0, 1.0)


def test_hot_id_is_cut_by_text(spark):
    rows = [(5, f"text number {i} of one id") for i in range(400)] + [(i, f"other {i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = winnow.neighbours(docs).where("not guest and id = 5").select("range").distinct().count()
    assert found > 1
    # All documents are in one cycle: each is the next of one.
    assert winnow.compared(docs).count() == len(rows)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    short = [r for r in sorted(rows, key=lambda r: -r[0])]
    expected = {r[0]: r for r in plain_compared([(i, t) for i, t in short])}
    for r in rounded(registry.op11_winnowing(spark, DATA).collect()):
        assert r == rounded([expected[r[0]]])[0]


def test_shared_passages_table(spark):
    passage = "this very passage stands in two of the three texts here"
    rows = [(1, "aa " * 30 + passage), (2, passage + " bb" * 40), (3, "nothing of that kind is in this one, as far as one can see")]
    found = winnow.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} == {1, 2}
    texts = dict(rows)
    assert {texts[r.doc_id][r.place : r.place + winnow.K] for r in found if r.doc_id == 1} & {texts[r.doc_id][r.place : r.place + winnow.K] for r in found if r.doc_id == 2}


# Conversations.
SPACES = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_repair(turns):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, hash) of sorted (turn, role, text), by a search over all prefixes."""
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    seen, faults = set(), []
    for _, role, text in turns:
        kept = text.rstrip(SPACES)
        faults.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else None)
        seen.add((role, text))
    count = Counter(faults)
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    best = {("", 0): (0, "", ())}
    order = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def offer(table, key, value):
        if key not in table or value < table[key]:
            table[key] = value

    names = {"u": "user", "a": "assistant"}
    for i in range(len(turns) + 1):
        for _ in range(3):
            for (state, at), (cost, audit, out) in list(best.items()):
                for to in order[state]:
                    if at == i and to in names:
                        offer(best, (to, i), (cost + 5, audit + "I", (*out, f"{names[to]}:")))
        if i == len(turns):
            break
        _, role, text = turns[i]
        for (state, at), (cost, audit, out) in list(best.items()):
            if at != i:
                continue
            offer(best, (state, i + 1), (cost + 2, audit + "D", out))
            if faults[i] in ("blank", "duplicate"):
                continue
            extra = 5 if faults[i] == "truncated" else 0
            for to in order[state]:
                if role[:1] == to:
                    offer(best, (to, i + 1), (cost + extra, audit + "K", (*out, f"{role}:{text}")))
                if to in names:
                    offer(best, (to, i + 1), (cost + extra + 1, audit + "R", (*out, f"{names[to]}:{text}")))
    cost, audit, out = min(best[k] for k in (("", len(turns)), ("a", len(turns))) if k in best)
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha("\n".join(out)))


def plain_report(rows):
    by = defaultdict(list)
    for conv, *turn in rows:
        by[conv].append(tuple(turn))
    key = lambda t: (t[0] is not None, t[0] or 0, hashlib.md5(f"{len(t[1])}:{t[1]}{t[2]}".encode()).hexdigest())
    return {conv: plain_repair(sorted(turns, key=key)) for conv, turns in by.items()}


def shown(frame):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in frame.collect()}


def some_turns(rng, n):
    texts = ["Yes.", "No!", "", "  \t", "cut", "Who?", "cut ", "é。", "a.b"]
    return [(rng.choice([i, i, i, i + 1, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "unknown"]), rng.choice(texts) if rng.random() < 0.4 else f"text {i}.") for i in range(n)]


def test_repair_equals_plain(spark):
    rng = random.Random(11)
    rows = [(c, *t) for c in range(400) for t in some_turns(rng, rng.randrange(1, 12))]
    frame = spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, blocks int, digest string").repartition(5)
    assert shown(conversations.report(frame)) == plain_report(rows)


def test_long_conversations(spark):
    """Several blocks, one crowded: all turns of one number, and many copies of one turn."""
    rng = random.Random(12)
    rows = [(1, *t) for t in some_turns(rng, 700)]
    rows += [(2, 7, rng.choice(["user", "assistant"]), f"text {i}.") for i in range(1100)] + [(2, 8, "user", "The same.")] * 200
    rows += [(None, i, ("user", "assistant")[i % 2], f"text {i}.") for i in range(300)]
    rows += [(3, None, "assistant", "No number."), (4, -600, "user", "Far."), (4, 600, "assistant", "Apart.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    expected = plain_report(rows)
    found = shown(conversations.report(frame))
    assert found.keys() == expected.keys()
    for c in expected:
        assert found[c] == expected[c], c
    pieces = [(r.conv_id, r.turns) for r in conversations.repaired(frame).orderBy("conv_id", "block").collect()]
    text = defaultdict(list)
    for c, turns in pieces:
        text[c] += [f"{t.role}:{t.text}" for t in turns]
    assert {c: sha("\n".join(t)) for c, t in text.items()} == {c: e[-1] for c, e in expected.items()}


def test_damaged_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    expected = plain_report(damaged(rows))
    found = shown(registry.op12_conversation_repair(spark, "/root/testdata/sf0.01"))
    nothing = (0, 0, 0, 0, 0, 0, "", sha(""))
    assert found == {c: expected.get(c, nothing) for c in {r[0] for r in rows}}


def test_damage_of_nulls_and_empty(spark):
    rows = [(1, None, "user", "A."), (None, 0, None, None), (2, 1, "user", None)] + [(9, t, "user", "x.") for t in range(60) if zlib.crc32(f"9:{t}".encode()) % 20 == 0]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = shown(conversations.report_all(registry._damaged(frame), frame, "copies"))
    expected = plain_report(damaged(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", sha(""))
    assert found == {c: expected.get(c, nothing) for c in {r[0] for r in rows}} and found[9] == nothing
    assert conversations.report(frame.limit(0)).count() == 0


def test_repaired_roles_are_legal(spark):
    rng = random.Random(13)
    rows = [(c, *t) for c in range(50) for t in some_turns(rng, 9)]
    frame = conversations.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    roles = defaultdict(str)
    for r in frame.orderBy("conv_id", "block").collect():
        roles[r.conv_id] += "".join(t.role[:1] for t in r.turns)
    assert any(roles.values())
    for r in roles.values():
        assert r.removeprefix("s") == "ua" * (len(r) // 2)


# Clustering.
def plain_clusters(rows, clusters=16, rounds=3):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(64 * float(x)) for x in v]))
    centroids = [v for _, v in sorted(kept, key=lambda r: sha(f"1:{'' if r[0] is None else r[0]}"))[:clusters]]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    place = lambda v: min(range(len(centroids)), key=lambda c: (away(v, centroids[c]), c))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[place(v)].append(v)
        centroids = [[sum(x) // len(own[c]) for x in zip(*own[c], strict=True)] if own[c] else old for c, old in enumerate(centroids)]
    found = [(i, place(v), v) for i, v in kept]
    out = [(i, c, away(v, centroids[c])) for i, c, v in found]
    total = Counter()
    for _, c, d in out:
        total[c] += d
    return sorted([(i, c, d, total[c], sum(total.values()), sha(",".join(map(str, centroids[c])))) for i, c, d in out], key=repr)


def test_clusters_equal_plain(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(0, 1, (5, 64))
    rows = [(i, (centers[i % 5] + rng.normal(0, 0.2, 64)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # one vector many times: ties and equal centroids
    rows += [(2000, None), (2001, [0.5] * 63), (2002, [0.5] * 63 + [None]), (2003, [float("nan")] * 64), (2004, [float("inf")] + [0.0] * 63), (None, [0.25] * 64), (7, [3000.0] * 64)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, cluster int").repartition(6)
    found = sorted([tuple(r) for r in kmeans.report(frame).collect()], key=repr)
    assert found == plain_clusters(rows)


def test_few_and_no_vectors(spark):
    rows = [(1, [0.1] * 64), (2, [-0.1] * 64)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted([tuple(r) for r in kmeans.report(frame).collect()], key=repr) == plain_clusters(rows)
    assert kmeans.report(frame.limit(0)).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        kmeans.report(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")).count()


def test_bounds_save_scans_and_change_nothing():
    rng = np.random.default_rng(4)
    centers = rng.integers(-300, 300, (16, 64))
    x = centers[rng.integers(0, 16, 4000)] + rng.integers(-20, 20, (4000, 64))
    old = x[:16].copy()
    state, scanned = kmeans.scan(x, old), []
    for _ in range(5):
        new = np.stack([x[state[0] == c].sum(axis=0) // max(1, (state[0] == c).sum()) if (state[0] == c).any() else old[c] for c in range(16)])
        *state, n = kmeans.step(x, state[0], state[2], state[3], old, new)
        exact = kmeans.squares(x, new)
        assert (state[0] == exact.argmin(axis=1)).all() and (state[1] == exact.min(axis=1)).all()
        assert (state[2] ** 2 >= exact.min(axis=1)).all() and (state[3] ** 2 <= np.partition(exact, 1)[:, 1]).all()
        scanned.append(n)
        old = new
    assert scanned[-1] < len(x) / 10


def test_clusters_equal_sql(spark):
    theirs = duckdb.connect().execute(sql.clustering().replace("FROM embeddings", f"FROM '{DATA}/embeddings.parquet'")).fetchall()
    assert sorted([tuple(r) for r in registry.op13_hamerly(spark, DATA).collect()]) == sorted(theirs)
