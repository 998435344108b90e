"""Near copies against brute-force Jaccard of five-word shingles."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import jaccard, simhash
from tests.llm.test_operators import SPACE_WORD, groups, lower

DATA = "/root/testdata/sf0.01"


def plain(rows):
    """The ids that stay."""

    def shingled(text):
        words = SPACE_WORD.findall(lower(text))
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    ids, sets, holders, pairs = [i for i, _ in rows], [shingled(t) for _, t in rows], {}, set()
    for i, own in enumerate(sets):
        for x in own or {()}:
            pairs |= {(j, i) for j in holders.setdefault(x, [])}
            holders[x].append(i)
    near = [(a, b) for a, b in pairs if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    least = {}
    for i, g in zip(ids, groups(len(ids), near), strict=True):
        least[g] = min(least.get(g, i), i)
    return sorted(least.values())


def made():
    """Copies with a few words replaced, some over a common passage, a chain, and short texts."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage, texts = [word() for _ in range(60)], []
    for i in range(60):
        base = [word() for _ in range(rng.randrange(20, 300))] + passage * (i % 2)
        texts.append(base)
        for _ in range(rng.randrange(4)):
            other = list(base)
            for at in rng.sample(range(len(other)), rng.randrange(1, 2 + len(other) // 35)):
                other[at] = word()
            texts.append(other)
    link = [word() for _ in range(120)]
    for _ in range(12):
        link = link[6:] + [word() for _ in range(6)]
        texts.append(link)
    texts += [list(passage) for _ in range(3)] + [["a"], ["a"], ["A", "b"], ["a", "b", "c", "d", "e"], [], []]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("source", ["made", "table"])
def test_near_duplicates_by_similarity(spark, source):
    docs = spark.createDataFrame(made(), "doc_id long, text string") if source == "made" else spark.read.parquet(f"{DATA}/documents.parquet")
    expected = plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    kept = corpus_pipeline.near_duplicates(spark, docs, DATA)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == expected
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), DATA).count() == 0


@pytest.mark.parametrize("pairs, members, shard", [(2, 2048, 8192), (8, 16, 4)])
def test_large_shards(spark, pairs, members, shard):
    """Every shard counts as large, or is cut in parts: no near copy of a text is lost, and none is made up."""
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 300):
        other = list(base)
        for at in rng.sample(range(200), rng.randrange(1, 5)):
            other[at] = f"x{i}y{at}"
        rows.append((i, " ".join(other)))
    rows += [(1000 + i, f"own{i} " + " ".join(base[:60]) + " " + " ".join(f"z{i}w{k}" for k in range(100))) for i in range(60)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), 5, pairs, members, shard)
    assert sorted(r.doc_id for r in kept.collect()) == plain(rows) == [0, *range(1000, 1060)]


@pytest.mark.parametrize("pairs, members, shard", [(48, 2048, 8192), (4, 8, 20)])
def test_families_of_copies(spark, pairs, members, shard):
    """Families of 60 texts: 30 bases and their copies, about as unlike as near copies may be, over one passage."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for f in range(12):
        base = [word() for _ in range(200)]
        for i in range(30):
            one = list(base)
            for at in rng.sample(range(200), 12):
                one[at] = word()
            other = list(one)
            for at in rng.sample(range(200), rng.randrange(2, 5)):
                other[at] = word()
            rows += [(len(rows), " ".join(one)), (len(rows) + 1, " ".join(other))]
    # Short texts, where a signature of few shingles is rough.
    for i in range(40):
        one = [word() for _ in range(rng.randrange(8, 14))]
        rows += [(len(rows), " ".join(one)), (len(rows) + 1, " ".join([*one, word()]))]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(6).checkpoint(), 5, pairs, members, shard)
    assert sorted(r.doc_id for r in kept.collect()) == plain(rows)


def test_signatures_lose_no_near_pair():
    """Sets of similarity 4/5 and a little more, of all sizes."""
    rng = np.random.default_rng(4)
    for n in (4, 5, 9, 30, 64, 120, 128, 140, 300, 2000):
        for _ in range(60):
            both = rng.integers(0, 2**64, n, dtype=np.uint64)
            spare = n // 9
            a, b = both[: n - (n - spare * 8) // 2] if n < 18 else both[spare:], both if n < 18 else both[: n - spare]
            if 5 * len(np.intersect1d(a, b)) < 4 * len(np.union1d(a, b)):
                continue
            signed = tuple(np.array(v) for v in zip(*(jaccard.signatures(np.unique(v)) for v in (a, b)), strict=True))
            assert jaccard.may_be_alike(signed, np.array([len(a), len(b)]), np.array([0]), np.array([1])).all()


@pytest.mark.parametrize("choice", ["none", "half"])
def test_any_frequent_shingles_give_the_same_rows(spark, monkeypatch, choice):
    """The sample that frequent shingles are estimated from decides where texts meet, not which are alike."""
    rows = made()
    every = np.unique(np.concatenate([jaccard.hashes(t, 5) for _, t in rows]))
    half = every[::2] if choice == "half" else every[:0]
    monkeypatch.setattr(jaccard, "frequent", lambda *_: jaccard.Frequent(half, 1 + np.arange(len(half)) % 3))
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == plain(rows)
