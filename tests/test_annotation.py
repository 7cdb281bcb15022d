"""Annotated documents and controlled vocabularies against brute force and hand-made cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from medlark.functions import similarity
from medlark.operators import annotation, training_set, vocabulary

ENTITIES = "array<struct<start:int,end:int,label:string>>"


def test_chunks_equal_brute_force(spark):
    random.seed(8)
    rows = []
    for i in range(12):
        text = "".join(random.choice(["mot ", "un  ", "deux\n", "é "]) for _ in range(random.choice([0, 3, 9, 40, 230]))) + random.choice(["", "fin"])
        spots = sorted(random.sample(range(len(text) + 1), min(len(text) + 1, 12)))
        rows.append((i, text, [(a, b, "x") for a, b in zip(spots[::2], spots[1::2])]))
    rows.append((99, None, []))

    def chunks(text, entities, size, overlap):
        text = text or ""
        starts = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        if len(starts) <= size:
            return [(0, text, entities)]
        out, i = [], 0
        while True:
            end = min(i + size, len(starts))
            a, b = starts[i], starts[end] if end < len(starts) else len(text)
            own = starts[i + overlap] if i else 0
            out.append((a, text[a:b], [(s - a, e - a, n) for s, e, n in entities if s >= a and e <= b and s >= own]))
            if end >= len(starts):
                return out
            i += size - overlap

    got = annotation.token_chunks(spark.createDataFrame(rows, f"doc_id int, text string, entities {ENTITIES}"), 10, 3).collect()
    have = {(r.doc_id, r.chunk): (r.start, r.text, [tuple(e) for e in r.entities]) for r in got}
    want = {(i, k): c for i, t, e in rows for k, c in enumerate(chunks(t, e, 10, 3))}
    assert have == want


def test_augmentation_moves_entities(spark):
    text = "Le patient présente une tumeur frontale évolutive étendue, opérée hier à la clinique, sans épilepsie récente ni déficit"
    rows = [(i, text, [(text.index("tumeur"), text.index("tumeur") + 15, "a"), (text.index("sans"), text.index("sans") + 14, "b")]) for i in range(40)] + [(90, "", []), (91, None, [])]
    docs = spark.createDataFrame(rows, f"doc_id int, text string, entities {ENTITIES}")
    got = {r.doc_id: r for r in annotation.augmented(docs, share=0.6).collect()}
    assert got[90].text == got[91].text == "" and len({got[i].text for i in range(40)}) > 20
    for i in range(40):
        assert [got[i].text[e.start : e.end] for e in got[i].entities] == ["tumeur frontale", "sans épilepsie"]
    assert [r.text for r in annotation.augmented(docs, share=0.6).orderBy("doc_id").collect()] == [got[k].text for k in sorted(got)]


def test_cipher_keeps_the_order(spark):
    got = spark.range(0, 3001).select("id", annotation.ordered_cipher(F.col("id"), "k").alias("c"), annotation.ordered_cipher(F.col("id"), "other").alias("o")).orderBy("id").collect()
    values = [r.c for r in got[:3000]]
    assert values == sorted(set(values)) and got[3000].c is None and values != [r.o for r in got[:3000]]


def test_columns_must_agree(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    annotation.same_columns(a, a.select("y", "x"))
    with pytest.raises(ValueError, match="y, z"):
        annotation.same_columns(a, a.withColumnRenamed("y", "z"))


@pytest.mark.parametrize(
    "text, field, value",
    [
        ("fish : deletion du bras 1p, absence de perte 19q.", "ch1p", "perte"), ("chromosome 19q : gain de signal.", "ch19q", "gain"), ("10q : perte partielle heterozygote.", "ch10q", "perte partielle"),
        ("7p : normal, pas d'alteration.", "ch7p", "gain"), ("ihc : idh1 positive, p53 surexprime.", "ihc_idh1", "positif"), ("atrx conserve", "ihc_atrx", "maintenu"), ("rien a signaler", "ch1p", None),
    ],
)
def test_controlled_vocabulary(text, field, value):
    assert vocabulary.controlled_values(text).get(field, (None,))[0] == value


def test_results_table_and_salt(tmp_path):
    out = training_set.latex([{"field_a": "x_y", "f1": 0.51234}], ["field_a", "f1"])
    assert r"x\_y & 0.512 \\" in out and out.startswith(r"\begin{tabular}{ll}")
    path = f"{tmp_path}/salt"
    first = training_set.salt(path)
    assert len(first) >= 40 and training_set.salt(path) == first


def test_surroundings_of_all_texts_are_scored_together(monkeypatch):
    """As by partial_of, word by word and hit by hit, which is not called for them any more."""
    random.seed(5)
    fields = {f: vocabulary.FIELDS[f] for f in ("ihc_idh1", "ihc_atrx", "ch10q", "mol_mgmt", "ampli_met")}
    terms = [w for t, c in fields.values() for w in [*t, *(x for y in c.values() for x in y)]]
    texts = [" ".join(random.choice([*terms, "idh", "postif", "negtif d'", "é", "et de la"]) for _ in range(random.choice([0, 1, 4, 30]))) for _ in range(40)]

    def one(text):
        out = {}
        for field, (names, categories) in fields.items():
            for m in [m for t in names for m in (re.finditer(rf"(?<!\w){t}(?!\w)" if len(t) <= 3 else t, text))]:
                around = text[max(0, m.start() - 80) : m.start()] + " " + text[m.end() : m.end() + 80]
                scored = [(c, 100.0 if w in around else similarity.partial_of(w, around), min(15.0, len(w) / 3)) for c, words in categories.items() for w in words]
                value, raw, _ = max([s for s in scored if s[1] >= 75] or [(None, 0.0, 0.0)], key=lambda s: s[1] + s[2])
                if value and (field not in out or 30 + 0.7 * raw > out[field][3]):
                    out[field] = (value, m.start(), m.end(), 0.3 * 100 + 0.7 * raw)
        return out

    want, plain = [one(t) for t in texts], similarity.partial_of
    assert sum(map(len, want)) > 30
    for w in ("absence d'expression", "perte", "x", "a" * 70):
        assert list(similarity.partials_of(w, [*texts, w, "", w[1:]], 500)) == [plain(w, t) for t in (*texts, w, "", w[1:])]
    calls = []
    monkeypatch.setattr(vocabulary, "partial_of", lambda a, b: calls.append(b) or plain(a, b))
    assert vocabulary.values_of(texts, fields, False) == want
    assert not calls


def test_chunks_of_long_texts_are_linear(spark):
    """Borders of words in texts of 400,000 and of one word, with characters of several bytes, in runs of any size."""
    import time

    import pyarrow as pa

    texts = ["mot é 😀\t" * 133_333 + "fin", "", " ", "é", " deux mots "]
    for most in (1, 1 << 23):
        long, *rest = annotation._borders(pa.array(texts).slice(0), 1800, 200, most).to_pylist()
        assert len(long) == 250 and long[1] == {"start": 1600 // 3 * 8 + 4, "end": (3400 // 3) * 8 + 4, "own": 1800 // 3 * 8} and long[-1]["end"] == len(texts[0])
        assert rest == [[{"start": 0, "end": len(t), "own": 0}] for t in texts[1:]] == annotation._borders(pa.array(texts).slice(1), 1800, 200, most).to_pylist()
    docs = spark.createDataFrame([(1, texts[0])], "doc_id int, text string").withColumn("entities", F.array().cast(ENTITIES))
    began = time.time()
    assert annotation.token_chunks(docs).select("chunk").count() == 250 and time.time() - began < 20
