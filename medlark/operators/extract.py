"""Rule extractors: every rule is a row, a pattern over the folded text (lower case, no accents, same length).

An extractor is one projection: the first match of each of its rules as struct(field, value, span, start, ord,
confidence), exploded once. The first rule in order, then the earliest match, gives a field its value.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlark.functions.text import dates, folded, positions
from medlark.operators import classify
from medlark.operators.merge import best


@dataclass(frozen=True)
class Rule:
    extractor: str
    field: str
    pattern: str
    value: str | None = None  # a constant, or None: the group's text through `spelled`
    group: int = 1
    confidence: float = 0.9
    spelled: tuple = ()


def _spell(table: dict[str, str]) -> tuple:
    return tuple((form, value) for value, forms in table.items() for form in forms.split("|"))


_SEP = r"\s*[:=\s-]\s*"
_LOST = "negatif|negative|neg|-|perte d'expression|perte|perdu|absent|absence d'expression|non exprime|non detecte|non retrouve"
_KEPT = "maintenu|maintenue|conserve|conservee|expression conservee|expression maintenue|preserve|normal"
_SEEN = "positifs|positif|positive|+|present|exprime|surexprime|surexpression"
_IHC_SPELLED = _spell({"negatif": _LOST, "maintenu": _KEPT, "positif": _SEEN})


def _one_of(*lists: str) -> str:
    forms = sorted({f for x in lists for f in x.split("|")}, key=lambda f: (-len(f), f))
    return "|".join(f.replace("+", r"\+").replace(" ", r"\s+") for f in forms)


_MARKERS = {
    "ihc_idh1": "idh-?1", "ihc_p53": "p53", "ihc_atrx": "atrx", "ihc_fgfr3": "fgfr3", "ihc_braf": "braf", "ihc_hist_h3k27m": r"h3(?:\.3)?\s?k27m\b", "ihc_hist_h3k27me3": r"h3\s?k27me3",
    "ihc_egfr_hirsch": r"egfr\s+hirsch|score\s+hirsch|egfr", "ihc_gfap": "gfap", "ihc_olig2": "olig2", "ihc_ki67": "ki-?67", "ihc_mmr": r"deficit\s+mmr|[dp]?mmr|mlh1|msh[26]|pms2",
}
_GENES = {
    "mol_idh1": "idh-?1", "mol_idh2": "idh-?2", "mol_tert": "tert", "mol_CDKN2A": "cdkn2a", "mol_h3f3a": "h3f3a", "mol_hist1h3b": "hist1h3b", "mol_braf": "braf", "mol_mgmt": "mgmt", "mol_fgfr1": "fgfr1",
    "mol_egfr_mut": "egfr", "mol_prkca": "prkca", "mol_p53": "t?p53", "mol_pten": "pten", "mol_cic": "cic", "mol_fubp1": "fubp1", "mol_atrx": "atrx",
}
_WILD = "wt|wild type|wild-type|sauvage|type sauvage|sequence sauvage|statut wt|non mute|non mutee|absence de mutation|pas de mutation"
_MUTANT = "mute|mutee|mutation|variant pathogene|altere|alteree|presence de mutation"
_METHYL = "methyle|hypermethyle|promoteur methyle|methylation du promoteur|methylation positive"
_UNMETHYL = "non methyle|non hypermethyle|promoteur non methyle|methylation negative|methylation absente|absence de methylation"
_MOL_SPELLED = _spell({"wt": _WILD, "mute": _MUTANT, "methyle": _METHYL, "non methyle": _UNMETHYL})
_PART = "perte partielle|perte heterozygote|perte focale|perte hemizygote|deletion focale|deletion partielle"
_GAIN, _LOSS = "gain de signal|gain|polysomie|trisomie|normale|normal", "perte de signal|perte d'heterozygotie|perte allelique|perte homozygote|perte|deletion|deleted|del|monosomie|loh"
_ARM_SPELLED = _spell({"gain": _GAIN, "perte": _LOSS, "perte partielle": _PART})
_NO = r"(?:pas|absence)\s+d(?:e\s+|')\s*"
_OF = r"\s+(?:de\s+|du\s+gene\s+)?"

#: field -> words; a first-symptom twin takes over where a marker precedes.
_PRESENT = {
    "epilepsie": r"epilepsie|comitialite|crises?\s+(?:convulsives?|comitiales?|epileptiques?)", "ceph_hic": r"cephalees?|htic|hypertension\s+intracranienne", "deficit": r"deficit(?:aire)?|hemiplegie|hemiparesie|paresie|paralysie",
    "cognitif": r"troubles?\s+(?:cognitifs?|mnesiques?)|confusion|ralentissement", "histo_necrose": "necroses?", "histo_pec": r"(?:proliferation|hyperplasie)\s+(?:endothelio-?capillaire|vasculaire)|pec|neovascularisation",
    "corticoides": r"corticoides|corticotherapie|dexamethasone|(?:solu)?medrol|predniso(?:lo)?ne|cortancyl", "optune": r"optune|tt-?fields|tumor\s+treating\s+fields|champs\s+electriques",
    "anti_epileptiques": r"anti-?epileptique|keppra|levetiracetam|valproate|depakine|lacosamide|vimpat|lamotrigine", "essai_therapeutique": r"essai\s+therapeutique|protocole\s+de\s+recherche|inclusion\s+dans\s+un\s+essai|etude\s+clinique",
    "contraste_1er_symptome": r"prise\s+de\s+contraste|rehaussement|enhancement", "oedeme_1er_symptome": r"oe?deme", "calcif_1er_symptome": r"calcifi(?:cations?|e)", "progress_clinique": r"(?:progression|aggravation)\s+clinique",
    "progress_radiologique": r"progression\s+(?:radiologique|a\s+l'imagerie)|augmentation\s+de\s+taille|croissance\s+tumorale", "antecedent_tumoral": r"antecedents?\s+(?:tumora(?:l|ux)|de\s+tumeur)|(?:tumeur|neoplasie)\s+anterieure|cancer\s+anterieur|tumeur\s+preexistante",
    "epilepsie_1er_symptome": r"crise\s+(?:inaugurale|revelatrice)|epilepsie\s+inaugurale",
}
_TWINS = ("epilepsie", "ceph_hic", "deficit", "cognitif")
_FIRST = r"(?s)\b(?:premier|initial|inaugural|revelateur|decouverte|motif de consultation|1er symptome).{0,200}?"
_DENIED = r"\b(?:pas\s+(?:de|d')|absence\s+(?:de|d')|sans|aucune?|ni)\s*"
_DRUGS = {
    "bevacizumab": "bevacizumab|avastin", "carboplatin": "carboplatine?", "carmustine": "carmustine|bcnu|gliadel", "cisplatin": "cisplatine?", "etoposide": "etoposide|vepesid", "irinotecan": "irinotecan|campto",
    "lomustine": "lomustine|ccnu|belustine", "marizomib": "marizomib", "nilotinib": "nilotinib|tasigna", "paxalisib": "paxalisib", "regorafenib": "regorafenib|stivarga", "temozolomide": "temozolomide|tmz|temodar|temodal", "vincristine": "vincristine|oncovin",
}
_PLACES = {
    "frontal": "frontal", "temporal": "temporal", "pariétal": "parietal", "occipital": "occipital", "insulaire": "insulaire", "cingulaire": "cingulaire", "thalamus": "thalam(?:us|ique)", "cervelet": "cervelet", "corps calleux": r"corps\s+calleux",
    "tronc cérébral": r"tronc\s+cerebral", "ganglions de la base": r"ganglions\s+de\s+la\s+base|noyaux\s+gris\s+centraux", "ventricule": "ventricul(?:e|aire)", "épendyme": "ependym(?:e|aire)", "bulbe": "bulbe", "hypothalamus": "hypothalamus",
}
_DIAGNOSES = {
    "oligoastrocytome": "oligoastrocytom[ea]", "oligodendrogliome": "oligodendrogliom[ea]|oligo", "medulloblastome": "medulloblastome|pnet", "glioblastome": r"gli[ao](?:bl|l)as[at]*tom[ea]|gbm", "astrocytome": "astrocytom[ea]", "ependymome": "ependymom[ea]",
    "meningiome": "meningiom[ea]", "schwannome": "schwannom[ea]|neurinome", "metastase": r"metastase|localisation\s+secondaire|carcinose", "lymphome": "lymphome|dlbcl|pcnsl", "gliome": "gliom(?:es?|a)",
}
_SIDE = _spell({"droite": "droit|droite", "gauche": "gauche", "bilateral": "bilateral|bilaterale", "median": "median|mediane"})
_SIDES = "gauche|droite?|bilaterale?|mediane?"


def _rules() -> list[Rule]:
    r: list[Rule] = []
    for f, m in _MARKERS.items():
        seen = _spell({"maintenu": _SEEN}) if f == "ihc_atrx" else ()  # expressed ATRX is retained
        r.append(Rule("ihc", f, rf"(?:{m}){_SEP}({_one_of(_LOST, _KEPT, _SEEN)})", spelled=seen + tuple(s for s in _IHC_SPELLED if s[0] not in dict(seen))))
        r.append(Rule("ihc", f, rf"(?:{m}){_SEP}((?:score\s+(?:de\s+)?)?<?\s*\d+(?:\s*a\s*\d+)?\s*%?)"))
    for f, g in _GENES.items():
        forms = _one_of(_WILD, _MUTANT, _METHYL, _UNMETHYL)
        r += [
            Rule("molecular", f, rf"\b(?:{g})\b{_SEP}({forms})\b", spelled=_MOL_SPELLED), Rule("molecular", f, rf"\b(?:{g})\b{_SEP}((?:p\.)?[a-z]\d+[a-z])\b", "mute"),
            Rule("molecular", f, rf"{_NO}mutation(?:\s+detectee)?\s+(?:du?\s+gene\s+)?(?:{g})\b", "wt"), Rule("molecular", f, rf"\bstatut?s?\s+wt\s+(?:du?\s+gene\s+)?(?:{g})\b", "wt"),
            Rule("molecular", f, rf"\bgene\s+(?:{g})\s+sauvage", "wt"), Rule("molecular", f, rf"\bmutation(?:\s+(?:detectee|identifiee))?\s+(?:du\s+)?(?:gene\s+)?(?:promoteur\s+)?(?:du\s+)?(?:{g})\b", "mute"),
        ]
    for arm in ("1p", "19q", "10p", "10q", "7p", "7q", "9p", "9q"):
        r += [Rule("chromosomal", f"ch{arm}", rf"\b{arm}{_SEP}({_one_of(_GAIN, _LOSS, _PART)})\b", spelled=_ARM_SPELLED), Rule("chromosomal", f"ch{arm}", rf"\b({_one_of(_GAIN, _LOSS, _PART)})\s+(?:du\s+|de\s+)?(?:bras\s+)?{arm}\b", spelled=_ARM_SPELLED)]
        r += [Rule("chromosomal", f"ch{arm}", rf"\b{arm}\s*\+\s", "gain"), Rule("chromosomal", f"ch{arm}", rf"\b{arm}\s*-\s", "perte")]
    for f in ("ch1p", "ch19q"):
        r += [Rule("chromosomal", f, r"co-?deletion\s+(?:des?\s+)?(?:bras\s+)?1p[/\s]+(?:et\s+)?19q", "perte"), Rule("chromosomal", f, r"1p[/\s]*19q\s+co-?delet", "perte")]
    for f, v in (("mol_CDKN2A", "mute"), ("ch9p", "perte")):
        r.append(Rule("chromosomal", f, r"deletion\s+(?:homo(?:zygote)?|bi[- ]?allelique)\s+(?:de\s+)?cdkn2a", v))
    for f, words in _PRESENT.items():
        if f in _TWINS:
            r += [Rule("binary", f"{f}_1er_symptome", rf"{_FIRST}{_DENIED}(?:{words})\b", "non", confidence=0.8), Rule("binary", f"{f}_1er_symptome", rf"{_FIRST}\b(?:{words})\b", "oui", confidence=0.8)]
        r += [Rule("binary", f, rf"{_DENIED}(?:{words})\b", "non", confidence=0.8), Rule("binary", f, rf"\b(?:{words})\b", "oui", confidence=0.8)]
    r += [
        Rule("numerical", "ihc_ki67", r"(?:ki[- ]?67|index\s+de\s+proliferation)" + _SEP + r"(?:environ\s+|~|entre\s+)?(\d+(?:\s*(?:a|-|et)\s*\d+)?)\s*%"), Rule("numerical", "ik_clinique", r"\b(?:ik|karnofsky|kps)\s*[:=a\s-]\s*(\d{2,3})\b"),
        Rule("numerical", "histo_mitoses", r"\b(\d+)\s*mitoses?"), Rule("numerical", "grade", r"\bgrade\s*[:=\s-]?\s*([1-4]|iv|i{1,3})\b", spelled=_spell({"1": "i", "2": "ii", "3": "iii", "4": "iv"})),
        Rule("numerical", "rx_dose", r"\b(\d+(?:[.,]\d+)?)\s*gy", confidence=0.8), Rule("numerical", "chm_cycles", r"\b(\d+)\s*(?:cycles?|cures?)", confidence=0.8),
    ]
    for g in ("mdm2", "mdm4", "cdk4", "egfr", "met"):
        r += [Rule("amplification", f"ampli_{g}", rf"{_NO}amplification{_OF}{g}\b", "non"), Rule("amplification", f"ampli_{g}", rf"amplification{_OF}{g}\b|\b{g}\s+amplifiee?", "oui")]
    for f, g in (("fusion_fgfr", "fgfr"), ("fusion_ntrk", "ntrk"), ("fusion_autre", "alk|ros1|met|braf")):
        r += [Rule("fusion", f, rf"{_NO}(?:fusion|rearrangement){_OF}(?:{g})", "non"), Rule("fusion", f, rf"(?:fusion|rearrangement|translocation){_OF}(?:{g})", "oui")]
    sexes = (("M", r"\|\s*m\s*\|", r"\bmonsieur\b|\bne\s+le\b", r"\bvu\s+en\b", r"\bhomme\b|\bmasculin\b"), ("F", r"\|\s*f\s*\|", r"\b(?:madame|mme)\b|\bnee\s+le\b", r"\bvue\s+en\b", r"\bfemme\b|\bfeminin\b"))
    r += [Rule("sexe", "sexe", p[i], p[0], confidence=c) for i, c in ((1, 0.95), (2, 0.8), (3, 0.65), (4, 0.7)) for p in sexes]
    r += [
        Rule("tumeur_lateralite", "tumeur_lateralite", rf"(?:lateralite|cote)\s*[:-]?\s*({_SIDES})\b", confidence=0.95, spelled=_SIDE),
        Rule("tumeur_lateralite", "tumeur_lateralite", rf"(?:hemisphere|lobe|frontale?|temporale?|parietale?|occipitale?|thalamus|insula|cervelet)\s+({_SIDES})\b", spelled=_SIDE),
        Rule("tumeur_lateralite", "tumeur_lateralite", rf"(?s)\b(?:tumeur|lesion|processus|masse)\b.{{0,200}}?\b({_SIDES})\b", confidence=0.75, spelled=_SIDE),
        Rule("evol_clinique", "evol_clinique", r"(?:evolution|etape|timepoint|dn\s+n|point)\s*[:-]?\s*(initial|p\d+|terminal)\b", confidence=0.95, spelled=_spell({f"P{i}": f"p{i}" for i in range(1, 10)})),
    ]
    for i, ordinal in enumerate(("premiere|1ere|1re", "deuxieme|2eme|2e", "troisieme|3eme|3e", "quatrieme|4eme|4e", "cinquieme|5eme|5e"), 1):
        r.append(Rule("evol_clinique", "evol_clinique", rf"\b(?:{ordinal})\s+(?:progression|recidive)", f"P{i}", confidence=0.85))
    r += [
        Rule("evol_clinique", "evol_clinique", r"\b(?:premiere\s+consultation|bilan\s+initial|diagnostique?\s+initial)\b", "initial", confidence=0.85), Rule("evol_clinique", "evol_clinique", r"\brecidive\b", "P1", confidence=0.6),
        Rule("type_chirurgie", "type_chirurgie", r"(?:exerese|resection)\s+(?:macroscopiquement\s+)?(?:complete|totale|en\s+totalite)|\bgtr\b", "exerese complete"), Rule("type_chirurgie", "type_chirurgie", r"(?:exerese|resection)\s+(?:partielle|sub-?totale|incomplete)|\bstr\b", "exerese partielle"),
        Rule("type_chirurgie", "type_chirurgie", r"\b(?:biopsie|bst)\b", "biopsie", confidence=0.85), Rule("type_chirurgie", "type_chirurgie", r"\b(?:exerese|resection)\b", "exerese", confidence=0.7),
        Rule("type_chirurgie", "type_chirurgie", r"en\s+attente\s+de\s+chirurgie|chirurgie\s+(?:a\s+planifier|prevue|non\s+realisee)", "en attente", confidence=0.8),
        Rule("classification_oms", "classification_oms", r"(?s)conclusion.*?\b(?:oms|who|classification)\s+(?:de\s+)?(2007|2016|2021)\b", confidence=0.95), Rule("classification_oms", "classification_oms", r"\b(?:oms|who|classification)\s+(?:de\s+)?(2007|2016|2021)\b", confidence=0.95),
    ]
    r += [Rule("diag_histologique", "diag_histologique", rf"\b(?:{words})\b", canonical, confidence=0.85) for canonical, words in _DIAGNOSES.items()]
    r.append(Rule("diag_histologique", "diag_histologique", r"diagnostic\s*[:-]?\s*([^\n\r.]{5,80})", confidence=0.5))
    return r


RULES = _rules()
#: extractors whose value is a list of all that occur, joined by " + "
LISTS = {"chimios": (_DRUGS, 0.85), "tumeur_position": (_PLACES, 0.8)}
#: section -> extractors; text under any other name is read by all
SECTIONS = {
    "ihc": "ihc numerical", "molecular": "molecular amplification fusion", "chromosomal": "chromosomal amplification", "macroscopy": "binary numerical", "microscopy": "binary numerical ihc diag_histologique",
    "conclusion": "ihc molecular chromosomal numerical amplification fusion evol_clinique classification_oms diag_histologique", "history": "date binary type_chirurgie evol_clinique", "treatment": "date binary numerical type_chirurgie chimios",
    "clinical_exam": "date binary numerical", "radiology": "date binary", "equipe_soignante": "", "demographics": "date sexe", "summary": "date binary numerical evol_clinique type_chirurgie chimios diag_histologique", "rcp_decision": "date binary numerical type_chirurgie chimios",
    "full_text": " ".join(dict.fromkeys(["date", *[x.extractor for x in RULES], *LISTS])),
}


_NONE = "array<struct<field:string,value:string,span:string,start:int,ord:int,confidence:double>>"


@lru_cache(maxsize=None)
def _needs(pattern: str, least: int) -> tuple[tuple[str, ...], ...]:
    """Sets of texts of `least` characters or more: every match of a pattern holds one of each set. The smallest first."""
    size = lambda x: (len(x), -min(map(len, x)))

    def of(items) -> list[set[str]]:
        found, run = [], ""
        for op, value in [*items, (None, None)]:
            if op is parser.LITERAL:
                run += chr(value)
                continue
            if len(run) >= least:
                found.append({run})
            before, run = [(parser.LITERAL, ord(c)) for c in run], ""
            if op is parser.SUBPATTERN:
                found += of([*before, *value[-1]])
            elif op is parser.BRANCH:  # the parser has taken what all branches begin with out of them
                each = [of([*before, *b]) for b in value[1]]
                found += [set().union(*[min(x, key=size) for x in each])] if all(each) else []
            elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT, parser.POSSESSIVE_REPEAT) and value[0] > 0:
                found += of(value[2])
        return found

    return tuple(tuple(sorted(x)) for x in sorted(of(parser.parse(pattern)), key=size))


def required(pattern: str, least: int = 3) -> tuple[str, ...]:
    """Texts of `least` characters or more one of which every match of a pattern holds; none if that can't be said."""
    return next(iter(_needs(pattern, least)), ())


def _holds(norm: Column, needs: tuple[tuple[str, ...], ...]) -> Column:
    out = F.lit(True)
    for words in needs:
        hit = norm.contains(words[0])
        for w in words[1:]:
            hit = hit | norm.contains(w)
        out = out & hit
    return out


def may_match(norm: Column, pattern: str) -> Column:
    """A quick test that every match of a pattern passes: plain searches in place of a regular expression."""
    return _holds(norm, _needs(pattern, 2))


def _match(norm: Column, rule: Rule, order: int) -> Column:
    at = F.regexp_instr(norm, F.lit(rule.pattern))
    span = F.regexp_extract(norm, rule.pattern, 0)
    if rule.value is not None:
        value = F.lit(rule.value)
    else:
        raw = F.regexp_replace(F.trim(F.regexp_extract(norm, rule.pattern, rule.group)), r"\s+", " ")
        value = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in rule.spelled for x in kv]), raw), raw) if rule.spelled else raw
    return F.when(
        span != "", F.struct(F.lit(rule.field).alias("field"), value.alias("value"), span.alias("span"), (at - 1).alias("start"), F.lit(order).alias("ord"), F.lit(rule.confidence).alias("confidence"))
    )


def matches(norm: Column, extractor: str) -> Column:
    """Array of the first matches of an extractor's rules, in any order. Rules that need the same texts stand behind one
    search for them, and each behind searches for whatever else it needs."""
    if extractor in LISTS:
        table, confidence = LISTS[extractor]
        word = {v: rf"\b(?:{p})\b" for v, p in table.items()}
        found = F.array_compact(F.array(*[F.when(may_match(norm, p) & (F.regexp_instr(norm, F.lit(p)) > 0), F.struct((F.regexp_instr(norm, F.lit(p)) - 1).alias("start"), F.lit(v).alias("value"), F.regexp_extract(norm, p, 0).alias("span"))) for v, p in word.items()]))
        ordered = F.array_sort(F.transform(found, lambda x: x["value"])) if extractor == "chimios" else F.transform(F.array_sort(found), lambda x: x["value"])
        first = F.array_min(found)
        whole = F.struct(F.lit(extractor).alias("field"), F.array_join(ordered, " + ").alias("value"), first["span"].alias("span"), first["start"].cast("int").alias("start"), F.lit(0).alias("ord"), F.lit(confidence).alias("confidence"))
        return F.when(F.size(found) > 0, F.array(whole))
    behind: dict[tuple[str, ...], list[Column]] = {}
    for i, r in enumerate(RULES):
        if r.extractor == extractor:
            first, more = _needs(r.pattern, 2)[:1], _needs(r.pattern, 2)[1:]
            behind.setdefault(first, []).append(F.when(_holds(norm, more), _match(norm, r, i)) if more else _match(norm, r, i))
    none = F.array().cast(_NONE)
    return F.concat(*[F.when(_holds(norm, words), F.array_compact(F.array(*rules))).otherwise(none) for words, rules in behind.items()])


def extract(docs: DataFrame, extractors: list[str]) -> DataFrame:
    """docs(doc_id, text) -> doc_id, field, extractor, value, span, start, confidence: one row a field and extractor."""
    rows = docs.withColumn("_norm", folded(F.coalesce("text", F.lit(""))))
    none = F.array().cast("array<struct<field:string,value:string,span:string,start:int,ord:int,confidence:double>>")
    each = F.concat(*[F.transform(F.coalesce(matches(F.col("_norm"), e), none), lambda m: F.struct(F.lit(e).alias("extractor"), m.alias("m"))) for e in extractors])  # noqa: B023
    # explode_outer infers no filter on the matches, which would be pushed below the folding and computed twice
    long = rows.select("doc_id", F.explode_outer(each).alias("_")).select("doc_id", "_.extractor", "_.m.*").filter("extractor is not null")
    return best(long, ["doc_id", "extractor", "field"], F.col("ord"), F.col("start")).drop("ord")


#: A birth date under a pseudonym keeps its year.
_BIRTH = r"(?i)\bn[ée]e?\s+le\s+\[?(?:DATE)_[A-F0-9]+_((?:19|20)\d{2})\]?"


def run_rules(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """docs(doc_id, text), sections(doc_id, section, position, text) -> doc_id, field, extractor, section, value, span,
    start, confidence: the value of each field from the first section whose extractors find it, in the extractors'
    order; fields that no section gives are looked for in the whole text of documents that have sections.

    All rules stand in one projection, guarded by the section's list of extractors; one explode and one window follow."""
    own = sections.select("doc_id", "section", "position", F.coalesce("text", F.lit("")).alias("text"))
    parted = own.filter(F.col("section") != "full_text").select("doc_id").distinct()
    rest = docs.join(parted, "doc_id", "left_semi").select("doc_id", F.lit("*").alias("section"), F.lit(1 << 20).alias("position"), F.coalesce("text", F.lit("")).alias("text"))
    return _read(own.unionByName(rest))


def rule_facts(docs: DataFrame) -> DataFrame:
    """run_rules over the documents' own sections. Texts move once, by document, which spreads the work over all tasks
    however few files hold them; sections and whole texts are then rows of one explode, and nothing is joined."""
    return _read(classify.sections(docs.select("doc_id", "text").repartition("doc_id"), whole=True).withColumn("position", F.when(F.col("section") == "*", 1 << 20).otherwise(F.col("position"))))


def _read(rows: DataFrame) -> DataFrame:
    """rows(doc_id, section, position, text), whole texts as section `*`."""
    names = SECTIONS["full_text"].split()
    none = F.array().cast(_NONE)
    known = F.col("section").isin(list(SECTIONS))

    def reads(e: str) -> Column:
        if e == "date":  # not part of the second look
            return F.col("section").isin([s for s, x in SECTIONS.items() if "date" in x.split()]) | (~known & (F.col("section") != "*"))
        return F.col("section").isin([s for s, x in SECTIONS.items() if e in x.split()]) | ~known

    rows = rows.withColumn("_norm", folded(F.col("text"))).withColumn("_dates", F.when(reads("date"), dates(F.col("text"))))

    def found(i: int, e: str) -> Column:
        hits = F.transform(_dated(), lambda d: F.struct(d["field"], d["value"], d["raw"].alias("span"), d["start"], F.lit(0).alias("ord"), F.lit(0.5).cast("double").alias("confidence"))) if e == "date" else matches(F.col("_norm"), e)
        got = F.when(reads(e), F.coalesce(hits.cast(_NONE), none)).otherwise(none)
        return F.transform(got, lambda m: F.struct(F.lit(i).alias("turn"), F.lit(e).alias("extractor"), m.alias("m")))

    birth = F.regexp_extract("text", _BIRTH, 1)
    token = F.when(birth != "", F.array(F.struct(F.lit(-1).alias("turn"), F.lit("date").alias("extractor"), F.struct(
        F.lit("annee_de_naissance").alias("field"), birth.alias("value"), F.regexp_extract("text", _BIRTH, 0).alias("span"), (F.regexp_instr("text", F.lit(_BIRTH)) - 1).alias("start"), F.lit(0).alias("ord"), F.lit(0.5).cast("double").alias("confidence"),
    ).alias("m")))).otherwise(F.array().cast(f"array<struct<turn:int,extractor:string,m:{_NONE[6:-1]}>>"))
    each = rows.select("doc_id", "section", "position", F.explode_outer(F.concat(token, *[found(i, e) for i, e in enumerate(names)])).alias("_"))
    long = each.select("doc_id", F.when(F.col("section") == "*", "full_text").otherwise(F.col("section")).alias("section"), "position", "_.turn", "_.extractor", "_.m.*").filter("extractor is not null")
    first = F.when(F.col("turn") < 0, -1).otherwise(F.col("position"))
    return best(long, ["doc_id", "field"], first, F.col("turn"), F.col("ord"), F.col("start")).drop("position", "turn", "ord")


_DATE_CUES = {
    "date_chir": "chirurgie|exerese|opere|biopsie|prelevement", "chm_date_debut": "debut chimio|chimiotherapie|temozolomide", "rx_date_debut": "radiotherapie|irradiation", "date_rcp": "rcp|concertation", "date_deces": "deces|decede",
    "date_progression": "progression|recidive", "annee_de_naissance": "nee? le|naissance", "exam_radio_date_decouverte": "irm|scanner", "dn_date": "derniere nouvelle|consultation du",
}
_WIDE = ("date_deces", "dn_date", "exam_radio_date_decouverte", "date_progression", "annee_de_naissance")


def _dated() -> Column:
    """array of struct(field, value, raw, start, gap): for each date field the date nearest to any of its cues."""
    found, norm = F.col("_dates"), "_norm"
    out = []
    for f, p in _DATE_CUES.items():
        pattern = rf"\b(?:{p})\b"
        value = lambda d: F.right(d["date"], F.lit(4)) if f == "annee_de_naissance" else d["date"]  # noqa: B023, E731
        near = lambda d, at: F.struct(F.abs(d["start"] - at).alias("gap"), d["start"].alias("start"), value(d).alias("value"), d["raw"].alias("raw"))  # noqa: B023, E731
        # cues are searched once, as the outer list, and the nearest pair is named once
        pairs = F.flatten(F.transform(positions(F.col(norm), pattern), lambda at: F.transform(found, lambda d: near(d, at))))  # noqa: B023
        best_of = F.array(F.array_min(F.filter(pairs, lambda x: x["gap"] <= (300 if f in _WIDE else 200))))  # noqa: B023
        named = F.transform(best_of, lambda x: F.when(x.isNotNull(), F.struct(F.lit(f).alias("field"), x["value"].alias("value"), x["raw"].alias("raw"), x["start"].alias("start"), x["gap"].alias("gap"))))  # noqa: B023
        out.append(F.when((F.size(found) > 0) & may_match(F.col(norm), pattern), named[0]))
    return F.array_compact(F.array(*out))


def keyword_dates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, field, value: for each date field the date nearest to one of its cues, within
    200 characters (300 for a few fields); the year alone for the birth."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_norm", folded(F.col("text"))).withColumn("_dates", dates(F.col("text")))
    return rows.select("doc_id", F.explode_outer(_dated()).alias("_")).select("doc_id", "_.field", "_.value").filter("field is not null")
