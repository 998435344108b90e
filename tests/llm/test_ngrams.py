"""The quality model in parts: its counts and scores, and what goes by shuffle for them."""

import math
import pickle
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import kneser_ney, ngrams
from tidemark.llm.ship import ship


def made(n, seed=4):
    rng = random.Random(seed)
    return [" ".join(f"w{min(rng.randrange(1, 80), rng.randrange(1, 80))}" for _ in range(rng.randrange(0, 120))) for _ in range(n)]


def in_order(spark, texts, parts=3):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts, "doc_id").sortWithinPartitions("doc_id").localCheckpoint()


def test_words_are_told_apart_at_white_space_and_lower_cased():
    hashes = lambda text: ngrams.words(b" " + text.encode() + b" ")[1].tolist()
    a, bc, long, rest = hashes(" A\tbc\r\n\x0b World_of_many_CharactersÉ  x")
    assert hashes("a") == [a] and hashes("Bc") == [bc] and hashes("wORLD_of_many_charactersÉ") == [long]
    assert len({a, bc, long, rest, *hashes("world_of_many_charactersé world_of_many_characters bc\x0e b c d @ [ `")}) == 12
    assert hashes("") == hashes(" \n ") == []


@pytest.mark.parametrize("values", [[], [0], [0, 0], [5, 5, 700, 2**63], list(range(0, 10**7, 997))])
def test_keys_are_small_and_come_back(values):
    values = np.array(values, dtype=np.uint64)
    assert ngrams.climbed(ngrams.steps(values)).tolist() == values.tolist() == ngrams.loosened(ngrams.squeezed(values)).tolist()


def test_a_part_names_a_pair_so_that_it_comes_back():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2**32 - 1, 5000, dtype=np.uint64) << np.uint64(32) | rng.integers(0, 2**32 - 1, 5000, dtype=np.uint64))
    order, begins, called = ngrams.dealt(1, keys, 7)
    for part in range(7):
        own = order[begins[part] : begins[part + 1]]
        assert (np.diff(called[own].astype(float)) > 0).all()
        right = ngrams.right_of(called[own], part, 7)
        assert ((called[own] >> np.uint64(32) << np.uint64(32) | right) == keys[own]).all()


def test_model_in_parts_scores_as_brute_force(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(ngrams, "CHUNK", 400)
    monkeypatch.setattr(ngrams, "GROUP", 2)
    texts = made(60)
    model = kneser_ney.fit(in_order(spark, texts), 0)
    pad = lambda t: ["<s>", "<s>", *t.split(), "</s>"]
    c3 = Counter(tuple(pad(t)[i - 2 : i + 1]) for t in texts for i in range(2, len(pad(t))))
    c2 = Counter(k[1:] for k in c3)
    c1 = Counter(k[1:] for k in c2)
    counts = {1: c1, 2: c2, 3: c3}
    assert sorted(r.n for r in model.cold.where("not context").collect()) == sorted(n for c in counts.values() for n in c.values())
    contexts = {n: {} for n in counts}
    for n, c in counts.items():
        for k, v in c.items():
            contexts[n].setdefault(k[:-1], []).append(v)
    discounts = {n: kneser_ney._discounts([sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]) for n, c in counts.items()}

    def p(gram):
        n = len(gram)
        if not gram:
            return 1 / kneser_ney.UNSEEN
        same = contexts[n].get(gram[:-1])
        if not same:
            return p(gram[1:])
        off = lambda v: discounts[n][min(v, 3) - 1]
        own = counts[n].get(gram, 0)
        return (own and own - off(own)) / sum(same) + sum(map(off, same)) / sum(same) * p(gram[1:])

    tested = [*texts[:20], *made(20, 5), None, "", "new words only", "w1 new w1 w2", "W1 w2  w3\n"]
    found = {r.doc_id: r for r in kneser_ney.score(in_order(spark, tested), model, "doc_id").collect()}
    assert len(found) == len(tested)
    for i, t in enumerate(tested):
        own = pad((t or "").lower())
        logs = [math.log10(p(tuple(own[j - 2 : j + 1]))) for j in range(2, len(own))]
        blocks = [logs[j : j + kneser_ney.BLOCK] for j in range(0, len(logs), kneser_ney.BLOCK)]
        windows = [a + b for a, b in zip(blocks, blocks[1:])] or blocks
        assert found[i].n_tokens == len(logs) and found[i].log10_prob == pytest.approx(sum(logs))
        assert found[i].worst == pytest.approx(max(10 ** (-sum(w) / len(w)) for w in windows))


def test_an_n_gram_is_sent_once_a_group_and_unknown_words_not_at_all(spark):
    """Not a row a token: a question for each group and part, of a few bytes for each distinct n-gram."""
    ship(spark)
    docs = in_order(spark, [*made(300), *["only new words here " * 50] * 20], 2)
    tables = ngrams.Tables(ngrams.Chunks(in_order(spark, made(300))))
    chunks, answers = ngrams.Chunks(docs), []
    for level in range(ngrams.LENGTHS):
        asked = chunks.each(tables.parts, list(answers), ngrams.questions)
        rows = asked.collect()
        keys = sum(len(ngrams.decoded(q[-1])) for _, (_, q) in rows)
        assert len(rows) <= 2 * tables.parts
        assert sum(len(pickle.dumps(x)) for x in rows) <= 11 * keys + 200 * len(rows)
        if level:
            words = docs.where("doc_id < 300").select(F.size(F.split("text", " "))).groupBy().sum().first()[0]
            assert keys < words + 600 and all(len(ngrams.decoded(q[-1])) for _, (_, q) in rows)
        answers.append(tables.answers(level, asked, chunks.parts))


def test_texts_that_change_between_readings_are_an_error():
    group = lambda text: ngrams.Group([([()], [len(text) + 1], ngrams.pa.compress(b" " + text + b" ", codec="zstd", asbytes=True))], 1, False)
    keys = group(b"a b c").keys
    (part, (_, question)), = ngrams.questions(0, 0, group(b"a b c"))
    reply = list(ngrams.answer(question, part, keys, ())[1][3:])
    group(b"a b c").answered({0: reply})
    with pytest.raises(RuntimeError, match="others"):
        group(b"a b d").answered({0: reply})
