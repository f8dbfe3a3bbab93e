import random
import re

from quarryline.llm.license_scan import BASE, LEAST_AGREEING, TEMPLATES, license_scan

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at = {k: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()] for k, p in BASE.items()}
    every = [x for v in at.values() for x in v]
    return len(w), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(k for k in at if at[k]))


def brute_labels(text, templates=TEMPLATES):
    """Labels and score from every start of every template."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    labels, best = {k for k, p in BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()}, 0.0
    if labels:
        best = 1.0
    for label, body, phrases in templates:
        body = body.split()
        must = []
        for p in (p.split() for p in phrases):
            must.append((next(k for k in range(len(body)) if body[k : k + len(p)] == p), p))
        for i in range(len(w)):
            share = sum(a == b for a, b in zip(w[i : i + len(body)], body, strict=False)) / len(body)
            if share >= LEAST_AGREEING and all(w[i + k : i + k + len(p)] == p for k, p in must):
                labels.add(label)
                best = max(best, share)
    return ",".join(sorted(labels)), best


def check(df):
    texts = {}
    for r in df.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    rows = license_scan(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert any((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t) for t in texts[r.doc_id])
        assert 0 <= r.score <= 1
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_documents(documents):
    check(documents)


def test_edge_cases(edge, empty):
    check(edge)
    assert license_scan(empty).collect() == []


def test_labels_of_the_index(spark):
    rows = [
        (1, "x y. Licensed under CC BY-NC 4.0."),
        (2, "Redistribution and use in source and binary forms, with or without\nmodification, are permitted"),
        (3, "x " * 50 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        (4, "permission is granted and the software is free of charge"),
        (5, "This work is licensed under the GNU General Public License, version 3."),
        (6, "license license license cc nc by under licensed"),
        (7, "Licensed under CC BY 4.0"),
        (8, ("mit license " * 3000).strip()),
    ]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {i: got[i].labels for i in got} == {1: "cc-by-nc", 2: "bsd", 3: "mit", 4: "", 5: "gpl", 6: "", 7: "cc-by", 8: "mit"}
    assert got[8].n_base == 3000 and got[8].last_word == 5998 and got[5].score == 1.0 and got[4].score == 0.0


def test_main_path_is_native(spark, documents):
    plan = license_scan(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_labels_and_score_equal_brute_force(spark, documents):
    draw = random.Random(5)
    every = sorted({x for _, b, _ in TEMPLATES for x in b.split()})
    rows = []
    for i in range(240):
        text = draw.choices(every, k=draw.randrange(30))
        for _, body, _ in draw.sample(TEMPLATES, draw.randrange(1, 4)):
            body = body.split()
            for k in draw.sample(range(len(body)), draw.randrange(len(body) // 3 + 1)):
                body[k] = draw.choice(every)  # words that the file holds elsewhere count as well
            text += body * draw.randrange(1, 3) + draw.choices(every, k=draw.randrange(9))
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").union(documents.select("doc_id", "text").where("doc_id > 300"))
    texts = {r.doc_id: r.text for r in df.collect()}
    got = license_scan(df).collect()
    assert len(got) == len(texts)
    assert {r.doc_id: (r.labels, r.score) for r in got} == {i: brute_labels(t) for i, t in texts.items()}
    assert sum(bool(r.labels) for r in got) > 100


def test_every_place_of_a_repeated_rare_word_is_tried(spark):
    body = "zebra licence of the zebra act"
    rows = [(1, "zebra licence of a zebra act"), (2, "zebra " * 40 + body), (3, "zebra licence")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.labels, round(r.score, 6)) for r in license_scan(df, templates=[("z", body, ["zebra act"])]).collect()}
    assert got == {1: ("z", round(5 / 6, 6)), 2: ("z", 1.0), 3: ("", 0.0)}
