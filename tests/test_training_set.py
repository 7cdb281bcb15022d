"""Building training sets against brute force and hand-made cases."""

import random

from pyspark.sql import functions as F

from medlark.operators import evaluation
from medlark.operators import training_set as ts
from medlark.sources.storage import durable


def test_representatives_walk_documents_in_order(spark):
    random.seed(6)
    n = 60
    copies = {i: random.choice([i, i, max(0, i - 7)]) for i in range(n)}
    root = lambda i: i if copies[i] == i else root(copies[i])
    classes = sorted({root(i) for i in range(n)})
    edges = {tuple(sorted(random.sample(classes, 2))) for _ in range(len(classes))}
    rate = {i: random.choice([0.5, 0.8, 1.0]) for i in range(n)}
    alone = [100, 101]
    near = {c: {b for a, b in edges if a == c} | {a for a, b in edges if b == c} | {c} for c in classes}
    seen, want = set(), set(alone)
    for i in range(n):
        if i in seen:
            continue
        cluster = [j for j in range(n) if root(j) in near[root(i)] and j not in seen]
        want.add(max(cluster, key=lambda j: (rate[j], -j)))
        seen.update(cluster)
    pairs = spark.createDataFrame(sorted(edges), "a long, b long")
    members = spark.createDataFrame([(i, root(i)) for i in range(n)], "doc_id long, representative long")
    rates = spark.createDataFrame([*rate.items(), *[(i, 0.0) for i in alone]], "doc_id long, rate double")
    got = [r.doc_id for r in ts.representatives(pairs, members, rates, durable).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_near_copies_leave_one_document(spark):
    base = " ".join(f"mot{i}" for i in range(60))
    rows = [(1, base), (2, base), (3, base + " fin"), (4, "tout autre texte que voici"), (5, None), (6, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rate = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.7), (4, 0.1), (5, 0.1), (6, 0.1)], "doc_id long, rate double")
    assert {(r.a, r.b) for r in ts.near_duplicates(docs).collect()} == {(1, 3)}
    assert {(r.doc_id, r.representative, r.copies) for r in ts.membership(docs).collect()} == {(1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 4, 1)}
    assert sorted(r.doc_id for r in ts.representatives(ts.near_duplicates(docs), ts.membership(docs), rate, durable).collect()) == [2, 4, 5, 6]


def test_confusion_of_alike_values(spark):
    cases = [
        ("diag_integre", "gliolastome", "glioblastome", "tp"), ("num_labo", "123457", "123456", "alteration"), ("mol_tert", "mute (C228T)", "mute (c228t)", "tp"), ("mol_tert", "mute (C228T)", "mute (G34R)", "alteration"),
        ("mol_tert", "mute", "mute (x)", "tp"), ("chimios", "temozolomide", "bevacizumab", "alteration"), ("diag_integre", None, "x", "hallucination"), ("diag_integre", "x", None, "omission"), ("diag_integre", "NA", "", "tn"),
        ("val", "avr-10", "01/04/2010", "tp"), ("val", "12.03.2021", "12 mars 2021", "tp"), ("val", "4", "4.0", "tp"), ("chimios", "a + b", "b + a", "tp"),
    ]
    rows = [(str(i), *c) for i, c in enumerate(cases)]
    frame = spark.createDataFrame(rows, "doc_id string, field string, gold string, predicted string, kind string")
    gold, predicted = frame.select("doc_id", "field", F.col("gold").alias("value")), frame.select("doc_id", "field", F.col("predicted").alias("value"))
    got = {r.doc_id: next(c for c in evaluation.COUNTS if r[c]) for r in evaluation.confusion(gold, predicted).collect()}
    assert got == {r[0]: r[4] for r in rows}


def test_macro_f1_by_mode(spark):
    gold = spark.createDataFrame([("1", "grade", "4"), ("1", "diag_integre", "gliolastome"), ("2", "grade", "3"), ("2", "sexe", "NA")], "doc_id string, field string, value string")
    predicted = spark.createDataFrame([("rule", "1", "grade", "4"), ("rule", "1", "diag_integre", "glioblastome"), ("rule", "2", "sexe", "F"), ("ml", "2", "grade", "4")], "mode string, doc_id string, field string, value string")
    got = {r["mode"]: (r.fields, r.exact, r.relaxed) for r in evaluation.macro_by_mode(gold, predicted).collect()}
    # rule: grade 2/3, diag_integre 0 or 1, sexe 0; ml: grade 0, diag_integre 0
    assert got == {"rule": (3, 0.222222, 0.555556), "ml": (2, 0.0, 0.0)}


def test_near_duplicates_equal_brute_force(spark):
    """Sets of near copies against all pairs; the walk writes down only classes that have a neighbour."""
    random.seed(11)
    word = lambda: random.choice(["Tumeur", "é", "grade", "de", "la", "x1", "IDH1", "perte", "oui", "non"])
    texts = []
    for _ in range(12):
        base = [word() for _ in range(random.choice([3, 5, 6, 150, 200]))]
        for _ in range(random.choice([1, 3, 5])):
            copy = [*base]
            for i in random.sample(range(len(base)), random.choice([0, 1, 2, 3])):
                copy[i] = word()
            texts.append(random.choice([" ", "\n", " \t"]).join(copy) + random.choice(["", " "]))
    texts += ["", None, " \n", "un", "UN ", "un deux"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def runs(text):
        w = (text or "").lower().split()
        return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    least = {}
    for i, t in enumerate(texts):
        if runs(t):
            least.setdefault(runs(t), i)
    want = {(i, j, round(len(s & t) / len(s | t), 6)) for s, i in least.items() for t, j in least.items() if i < j and len(s & t) / len(s | t) >= 0.85}
    signed = durable(ts.signatures(docs))
    for pairs in (ts.near_duplicates(docs), ts.near_duplicates(docs, signed=signed)):
        assert {(r.a, r.b, round(r.jaccard, 6)) for r in pairs.collect()} == want and len(want) > 5
    assert {(r.doc_id, r.representative) for r in ts.membership(docs, signed=signed).collect()} == {(i, least[runs(t)]) for i, t in enumerate(texts) if runs(t)}
    sizes, linked = [], {i for a, b, _ in want for i in (a, b)}
    store = lambda df: sizes.append((df.columns, df.count())) or durable(df)
    ts.representatives(ts.near_duplicates(docs, signed=signed), ts.membership(docs, signed=signed), docs.selectExpr("doc_id", "1.0D AS rate"), store).count()
    assert len(linked) < len(least) and {n for c, n in sizes if c == ["node", "leader"]} == {len(linked)}
