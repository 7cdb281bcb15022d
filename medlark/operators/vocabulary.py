"""Controlled vocabularies: find a field's terms in a text, check which category its surroundings speak of.

A term of up to three letters must stand alone; a longer one is found as it is written or, if the text never has it so,
in windows that come close. Each hit is scored for every category of its field over 80 characters on both sides, the
longer terms with a bonus; 30 % of the hit's score and 70 % of the category's give the candidate's, and the best
candidate of a field (the first found on ties) gives its value. Runs on Arrow batches: fuzzy windows have no built-in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medlark.functions.similarity import partial_of, partials_of
from medlark.functions.text import match_form

FIND, CHECK, AROUND, SHORT = 80.0, 75.0, 80, 3
_CHROMOSOME = {"perte partielle": ["perte partielle", "deletion partielle"], "perte": ["perte", "deletion", "delete", "monosomie"], "gain": ["gain", "polysomie", "trisomie", "normal"]}
_STAIN = {"positif": ["positif", "positive", "exprime", "surexprime", "marquage present"], "negatif": ["negatif", "negative", "absence d'expression", "non exprime"]}
_GENE = {"mute": ["mute", "mutation retrouvee", "mutation presente", "variant pathogene"], "wt": ["sauvage", "non mute", "wild type", "absence de mutation"]}
_COPIES = {"oui": ["amplifie", "amplification retrouvee", "amplification presente"], "non": ["non amplifie", "absence d'amplification", "pas d'amplification"]}
#: field -> (terms, category -> terms), in match form.
FIELDS: dict[str, tuple[list[str], dict[str, list[str]]]] = {
    **{f"ch{c}": ([c, f"chromosome {c}"], _CHROMOSOME) for c in ("1p", "19q", "7p", "7q", "9p", "9q", "10p", "10q", "1q", "19p")},
    **{f"ihc_{m}": (terms, _STAIN) for m, terms in {"idh1": ["idh1", "idh1 r132h"], "p53": ["p53"], "gfap": ["gfap"], "olig2": ["olig2"], "egfr_hirsch": ["egfr"]}.items()},
    "ihc_atrx": (["atrx"], {"maintenu": ["maintenu", "conserve", "positif"], "perte": ["perte", "perdu", "negatif"]}),
    **{f"mol_{g}": ([g], _GENE) for g in ("idh1", "idh2", "tert", "braf", "cdkn2a", "pten", "h3f3a")},
    "mol_mgmt": (["mgmt", "promoteur mgmt"], {"non methyle": ["non methyle", "absence de methylation"], "methyle": ["methyle", "methylation presente"]}),
    **{f"ampli_{g}": ([f"amplification {g}", f"{g} amplifie", g], _COPIES) for g in ("egfr", "mdm2", "cdk4", "met", "mdm4")},
}


def _hits(text: str, term: str) -> list[tuple[int, int, float]]:
    if len(term) <= SHORT:
        return [(m.start(), m.end(), 100.0) for m in re.finditer(rf"(?<!\w){re.escape(term)}(?!\w)", text)]
    exact = [(m.start(), m.end(), 100.0) for m in re.finditer(re.escape(term), text)]
    if exact:
        return exact
    size, step, at, out = int(len(term) * 1.5) + 1, max(1, len(term) // 2), 0, []
    letters = set(term)
    starts = []
    while at + size <= len(text):
        window = text[at : at + size]
        # a window without most of the term's letters can't come close
        score = partial_of(term, window) if len(letters & set(window)) * 100 >= FIND * len(letters) * 0.8 else 0.0
        if score >= FIND:
            out.append((at, at + size, score))
            at += size
        else:
            at += step
        starts.append(at)
    if len(text) > size and (score := partial_of(term, text[-size:])) >= FIND:
        out.append((len(text) - size, len(text), score))
    return out


def values_of(texts: list[str], fields: dict = FIELDS, fuzzy: bool = True) -> list[dict[str, tuple[str, int, int, float]]]:
    """Texts in match form -> for each, field: (value, start, end, score). The surroundings of all hits of a field are
    held against a category's word at once."""
    out: list[dict[str, tuple[str, int, int, float]]] = [{} for _ in texts]
    for field, (terms, categories) in fields.items():
        hits: list[tuple[int, int, int, float, int]] = []
        places: dict[str, int] = {}
        for i, text in enumerate(texts):
            for term in terms:
                # a term that the text doesn't have as written can only come close
                for start, end, found in _hits(text, term) if term in text or fuzzy and len(term) > SHORT else ():
                    around = text[max(0, start - AROUND) : start] + " " + text[end : end + AROUND]
                    hits.append((i, start, end, found, places.setdefault(around, len(places))))
        if not hits:
            continue
        judged = _judged(list(places), categories)
        for i, start, end, found, k in hits:
            value, raw = judged[k]
            score = 0.3 * found + 0.7 * raw
            if value and (field not in out[i] or score > out[i][field][3]):
                out[i][field] = (value, start, end, score)
    return out


def _judged(arounds: list[str], categories: dict[str, list[str]]) -> list[tuple[str | None, float]]:
    """The category that each of the surroundings speaks of, and its score without the bonus; the first word wins ties."""
    best, raw, value = np.zeros(len(arounds)), np.zeros(len(arounds)), np.full(len(arounds), -1)
    names = list(categories)
    for c, words in enumerate(categories.values()):
        for w in words:
            score = np.full(len(arounds), 100.0)
            if rest := [k for k, a in enumerate(arounds) if w not in a]:
                score[rest] = partials_of(w, [arounds[k] for k in rest])
            total = score + min(15.0, len(w) / 3)
            better = (score >= CHECK) & (total > best)
            best[better], raw[better], value[better] = total[better], score[better], c
    return [(names[v] if v >= 0 else None, r) for v, r in zip(value.tolist(), raw.tolist())]


def controlled_values(text: str, fields: dict = FIELDS, fuzzy: bool = True) -> dict[str, tuple[str, int, int, float]]:
    """A text in match form -> field: (value, start, end, score)."""
    return values_of([text], fields, fuzzy)[0]


def _slices(texts: list[str], most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most so many characters together; a longer text is a run of its own."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    if texts:
        yield at, len(texts)


def controlled(docs: DataFrame, fields: dict = FIELDS, fuzzy: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, field, value, start, end, confidence; positions are those in the match form. With
    `fuzzy`, windows of the whole text are compared with every long term, which costs a pass over it for each."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids, forms = f["doc_id"].tolist(), f["form"].tolist()
            for at, to in _slices(forms):
                rows = [(i, k, v, a, b, round(s / 100, 2)) for i, found in zip(ids[at:to], values_of(forms[at:to], fields, fuzzy)) for k, (v, a, b, s) in found.items()]
                yield pd.DataFrame(rows, columns=["doc_id", "field", "value", "start", "end", "confidence"])

    return docs.select("doc_id", match_form(F.coalesce("text", F.lit(""))).alias("form")).mapInPandas(run, f"doc_id {kind}, field string, value string, start int, end int, confidence double")
