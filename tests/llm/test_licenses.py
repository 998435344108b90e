"""Licenses among stray matches, and the operator against its SQL on made texts."""

import random

import duckdb

from tidemark.llm import licenses, sql

BSD = next(t for label, t in licenses.TEMPLATES if label == "bsd").split()
WORDS = sorted({w for _, t in licenses.TEMPLATES for w in t.split()})


def labels(spark, texts):
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r.labels for r in licenses.scan(table).orderBy("doc_id").collect()]


def test_stray_words_do_not_move_a_span(spark):
    two_in = [*BSD[:6], "extra", *BSD[6:15], "words", *BSD[15:]]
    before = ["redistribution", "and", "x"]
    after = ["y", "the", "following", "conditions", "z"]
    cases = [two_in, before + two_in, two_in + after, before * 3 + two_in + after, BSD[:4] + ["x"] + BSD[:2], ["all", "rights", "x", "reserved"]]
    assert labels(spark, cases) == ["bsd", "bsd", "bsd", "bsd", "", ""]


def test_random_strays(spark):
    rng = random.Random(9)
    texts, expected = [], []
    for label, text in licenses.TEMPLATES:
        words = text.split()
        if len(words) < 15:
            continue
        one = list(words)
        one.insert(rng.randrange(3, len(one) - 3), "inserted")
        del one[rng.randrange(3, len(one) - 3)]
        strays = [w for at in rng.sample(range(len(words) - 1), 4) for w in (*words[at : at + 2], "between", "them")]
        texts.append([*strays, "some", "other", *one, "more", *reversed(strays)])
        expected.append(label)
    for found, label in zip(labels(spark, texts), expected, strict=True):
        assert label in found.split(",")


def test_operator_equals_sql_on_made_texts(spark):
    """Pieces of templates with words put in, left out, repeated and mixed."""
    rng = random.Random(10)
    rows = []
    for i in range(150):
        text = []
        for _ in range(rng.randrange(4)):
            words = rng.choice(licenses.TEMPLATES)[1].split()
            cut = words[rng.randrange(max(1, len(words) // 6)) : len(words) - rng.randrange(max(1, len(words) // 6))]
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(cut) + 1)
                cut = cut[:at] + ([rng.choice(WORDS)] if rng.random() < 0.5 else []) + cut[at + (rng.random() < 0.3) :]
            text += [rng.choice(WORDS) for _ in range(rng.randrange(5))] + cut
        rows.append((i, " ".join(text)))
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    names = found.columns
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", rows)
    theirs = db.execute(f"select {', '.join(names)} from ({sql.license_scan()})").fetchall()
    plain = lambda rs: sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rs])
    assert plain([tuple(r) for r in found.collect()]) == plain(theirs)
    assert sum(1 for r in theirs if r[names.index("labels")]) > 50
