"""Document types by weighted keywords, and sections by header lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlark.functions.text import folded

_KEYWORDS = {
    "anapath": ("immunohistochimie|anapath|IHC|histologie|pièce opératoire|anatomie pathologique|anatomopathologique|examen microscopique|examen macroscopique|biopsie stéréotaxique|compte-rendu anatomopathologique|compte rendu anatomopathologique", "mitoses|nécrose|necrose|Olig2|GFAP|Ki67|coloration HES|fixation formolée|inclusion en paraffine|prolifération endothéliocapillaire"),
    "molecular_report": ("panel NGS|séquençage|CGH array|CGH-array|profil génomique|profil moléculaire|analyse génomique|analyse moléculaire|biologie moléculaire|altérations chromosomiques", "mutation|méthylation|codélétion|CDKN2A|1p/19q|MGMT|TERT|IDH2|IDH1|amplification EGFR"),
    "consultation": ("karnofsky|interrogatoire|examen clinique|consultation du|consultation de suivi|vu en consultation|vue en consultation|vu(e) en consultation|compte rendu de consultation|compte-rendu de consultation", "chimio|plainte|avastin|autonomie|irradiation|antécédents|témozolomide|traitement en cours|examen neurologique"),
    "rcp": ("staff|RCP|avis RCP|discussion en RCP|réunion pluridisciplinaire|décision thérapeutique collégiale|réunion de concertation pluridisciplinaire", "décision collégiale|discussion collégiale|protocole thérapeutique|proposition thérapeutique"),
    "radiology": ("imagerie|T1 gadolinium|séquences FLAIR|prise de contraste|IRM de contrôle|IRM cérébrale|IRM encéphalique|scanner cérébral|compte rendu radiologique|compte-rendu radiologique", "lésion|diffusion|perfusion|rehaussement|spectroscopie|effet de masse|œdème péri-lésionnel|oedème péri-lésionnel"),
}
STRONG, MODERATE, AMBIGUOUS = 3, 1, 2


def keywords() -> list[tuple[str, int, str, int]]:
    """(doc_type, type_order, keyword, weight). Karnofsky counts twice, once for each spelling it is listed under."""
    rows = [(t, i, k, w) for i, (t, lists) in enumerate(_KEYWORDS.items()) for w, words in zip((STRONG, MODERATE), lists) for k in words.split("|")]
    return [*rows, ("consultation", 2, "Karnofsky", STRONG)]


def scores(docs: DataFrame, words: list[tuple[str, int, str, int]] | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, doc_type, type_order, score, matched: a row for every type of every document. One
    projection tests all keywords; nothing is joined."""
    words = words or keywords()
    lower = F.lower(F.coalesce("text", F.lit("")))
    by_type: dict[tuple[int, str], list] = {}
    for kind, order, keyword, weight in words:
        by_type.setdefault((order, kind), []).append((keyword, weight))
    one = lambda k, w: F.when(F.col("_t").contains(k.lower()), F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")))
    typed = [F.struct(F.lit(kind).alias("doc_type"), F.lit(order).alias("type_order"), F.array_compact(F.array(*[one(*x) for x in hits])).alias("hits")) for (order, kind), hits in sorted(by_type.items())]
    each = docs.select("doc_id", lower.alias("_t")).select("doc_id", F.explode(F.array(*typed)).alias("_")).select("doc_id", "_.*")
    return each.select("doc_id", "doc_type", "type_order", F.aggregate("hits", F.lit(0), lambda s, x: s + x.w).alias("score"), F.array_sort(F.transform("hits", lambda x: x.k)).alias("matched"))


def classify(docs: DataFrame, words: list[tuple[str, int, str, int]] | None = None, ambiguous: int = AMBIGUOUS) -> DataFrame:
    """doc_id, doc_type, score, confidence, is_ambiguous: the type of the highest score, the first in order on ties;
    a blank text is a consultation. Scores stay within the document's row."""
    words = words or keywords()
    types = sorted({(order, kind) for kind, order, _, _ in words})
    total = lambda kind: sum((F.when(F.col("_t").contains(k.lower()), w).otherwise(0) for t, _, k, w in words if t == kind), F.lit(0))
    ranked = F.array_sort(F.array(*[F.struct((-total(kind)).alias("s"), F.lit(order).alias("o"), F.lit(kind).alias("doc_type")) for order, kind in types]))
    rows = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("_t")).withColumn("_r", ranked)
    score, second = -F.col("_r")[0]["s"], -F.get("_r", F.lit(1))["s"]
    rows = rows.select("doc_id", F.when(F.trim("_t") == "", "consultation").otherwise(F.col("_r")[0]["doc_type"]).alias("doc_type"), score.alias("score"), second.alias("_second"))
    sure = F.when(F.col("score") > 0, (F.col("score") - F.col("_second")) / F.col("score")).otherwise(0.0)
    return rows.select("doc_id", "doc_type", "score", sure.alias("confidence"), ((F.col("score") == 0) | (F.col("score") - F.col("_second") <= ambiguous)).alias("is_ambiguous"))


#: name -> headers in folded form
HEADERS = {
    "ihc": r"immunohistochimie|ihc|marqueurs?\s+immuno(?:histochim(?:iques?|ie))?", "molecular": r"(?:biologie|analyse)\s+moleculaire|panel\s+ngs|sequencage|resultats?\s+moleculaire", "chromosomal": r"cgh[\s-]?array|alterations?\s+chromosomiques?|profil\s+genomique|analyse\s+chromosomique",
    "macroscopy": r"(?:examen\s+|description\s+)macroscopique|macroscopie", "microscopy": r"(?:examen\s+|description\s+)microscopique|microscopie|histologie", "conclusion": r"conclusion|diagnostic(?:\s+integre)?|synthese\s+diagnostique",
    "history": r"antecedents?|histoire\s+de\s+la\s+maladie|anamnese|(?:resume\s+de\s+l')?historique", "treatment": r"traitements?|(?:proposition\s+|protocole\s+|decision\s+)?therapeutique", "clinical_exam": r"examen\s+(?:clinique|neurologique|physique)|interrogatoire",
    "radiology": r"imagerie|irm(?:\s+cerebrale)?|scanner(?:\s+cerebral)?|radiologie|bilan\s+radiologique|compte[\s-]rendu\s+radiologique", "equipe_soignante": r"equipe\s+soignante|(?:medecins?\s+)?referents?|intervenants?", "demographics": r"renseignements?\s+cliniques?|donnees?\s+patient|identite",
    "summary": r"synthese|resume|bilan\s+actuel|discussion", "rcp_decision": r"decision\s+rcp|proposition\s+therapeutique\s+rcp|avis\s+de\s+la\s+rcp",
}
LEAST_BODY = 10


def _found(norm: Column, strict: bool) -> Column:
    end = r"[ \t]*[:.—–-]*[ \t]*$" if strict else ""
    spans = []
    for name, p in HEADERS.items():
        pattern = rf"(?m)^[ \t]*(?:{p})\b{end}"
        at = F.regexp_instr(norm, F.lit(pattern))
        spans.append(F.when(at > 0, F.struct((at - 1).alias("start"), F.lit(name).alias("name"), (at - 1 + F.length(F.regexp_extract(norm, pattern, 0))).alias("body"))))
    return F.array_sort(F.filter(F.array(*spans), lambda s: s.isNotNull()))


def sections(docs: DataFrame, least: int = LEAST_BODY, whole: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, section, position, start, text: bodies between header lines, the preamble before
    the first; headers within a line where no line is one; the whole text where there are none. Bodies shorter than
    `least` are left out. With `whole`, texts that have sections also come uncut, as a last section named `*`."""
    rows = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_n", folded(F.col("text")))
    rows = rows.withColumn("_strict", _found(F.col("_n"), True)).withColumn("_s", F.when(F.size("_strict") > 0, F.col("_strict")).otherwise(_found(F.col("_n"), False)))
    size = F.length("text")
    cut = lambda a, b: F.substring(F.col("text"), a + 1, b - a)
    made = F.transform("_s", lambda s, i: F.struct(s["name"].alias("section"), s["body"].alias("start"), F.trim(F.translate(cut(s["body"], F.coalesce(F.get(F.col("_s"), i + 1)["start"], size)), "\n\t", "\n ")).alias("text")))
    lead = F.struct(F.lit("preamble").alias("section"), F.lit(0).alias("start"), cut(F.lit(0), F.get(F.col("_s"), F.lit(0))["start"]).alias("text"))
    uncut = lambda name: F.array(F.struct(F.lit(name).alias("section"), F.lit(0).alias("start"), F.col("text").alias("text")))
    kept = F.filter(F.concat(F.array(lead), made), lambda s: F.length(F.regexp_replace(s["text"], r"^\s+|\s+$", "")) >= least)
    rows = rows.withColumn("_kept", kept)
    parts = F.when((F.size("_s") > 0) & (F.size("_kept") > 0), F.concat("_kept", uncut("*")) if whole else F.col("_kept")).otherwise(uncut("full_text"))
    # never empty; the outer form infers no filter on the parts, which would be pushed below the folding and computed again for every header
    out = rows.select("doc_id", F.posexplode_outer(parts).alias("position", "_"))
    trimmed = F.when(F.col("_.section") == "*", F.col("_.text")).otherwise(F.regexp_replace("_.text", r"^\s+|\s+$", ""))
    return out.select("doc_id", "_.section", "position", "_.start", trimmed.alias("text"))
