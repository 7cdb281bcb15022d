"""Inputs of the registered queries: clinical views of the relational tables and a few sample reports.

Every view exists twice, as a DataFrame and as DuckDB SQL, so that a query and its oracle start from one thing.
Patients are customers, documents orders, facts lineitems.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame as op_<name>, with its DuckDB SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[f"op_{name}"] = f
        if sql:
            ORACLE_SQL[f"op_{name}"] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_PRIORITIES = {"1-URGENT": "anapath", "2-HIGH": "molecular_report", "3-MEDIUM": "consultation", "4-NOT SPECIFIED": "rcp", "5-LOW": "radiology"}
_LINE_FIELDS = {1: "tumeur_lateralite", 2: "ik_clinique", 3: "ihc_idh1", 4: "date_chir", 5: "grade", 6: "epilepsie", 7: "champ_inconnu"}


def documents(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Orders as reports: doc_id, patient_id, doc_type, doc_date (a text, null for a few), and the columns to keep."""
    o = table(spark, sf_dir, "orders")
    kind = F.lit("other")
    for p, t in _PRIORITIES.items():
        kind = F.when(F.col("o_orderpriority") == p, t).otherwise(kind)
    date = F.when(F.col("o_orderkey") % 11 == 0, F.lit(None)).when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy/M/d"))
    return o.select(F.col("o_orderkey").cast("string").alias("doc_id"), F.col("o_custkey").cast("string").alias("patient_id"), kind.alias("doc_type"), date.alias("doc_date"), *keep)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as facts, each of them: DOC columns, field, value (null for some), other_value, score, seq. Lines of an
    order that share a number go to its second, third and further reports, `<order>.2` and so on. One shuffle on the order's
    number serves both the turns and the join."""
    slot = F.least("l_linenumber", F.lit(7))
    turn = Window.partitionBy("l_orderkey", slot).orderBy(F.desc("l_extendedprice"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    line = table(spark, sf_dir, "lineitem").repartition("l_orderkey").withColumn("_turn", F.row_number().over(turn))
    field = F.element_at(F.array(*[F.lit(_LINE_FIELDS[i]) for i in range(1, 8)]), slot)
    value = F.when(F.col("l_discount") < 0.02, F.lit(None)).when(field == "date_chir", F.when(F.col("l_quantity") > 35, F.date_format("l_shipdate", "dd/MM/yyyy"))).otherwise(F.concat("l_returnflag", "l_linestatus"))
    other = F.when(F.col("l_tax") < 0.02, F.lit(None)).when(F.col("l_tax") < 0.05, value).otherwise(F.concat("l_linestatus", "l_returnflag"))
    rows = line.select(F.col("l_orderkey").alias("_line_order"), "_turn", field.alias("field"), value.alias("value"), other.alias("other_value"), F.col("l_extendedprice").alias("score"), F.col("l_linenumber").alias("seq"), F.col("l_suppkey").alias("supplier"))
    orders = documents(spark, sf_dir, "o_orderkey").withColumnsRenamed({"doc_id": "_order", "o_orderkey": "_own_order"})
    found = rows.join(orders, F.col("_line_order") == F.col("_own_order"))
    doc = F.when(F.col("_turn") == 1, F.col("_order")).otherwise(F.concat_ws(".", "_order", F.col("_turn").cast("string")))
    return found.select(doc.alias("doc_id"), *[c for c in found.columns if c[0] != "_"])


def _case(column: str, table: dict, other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in table.items()) + f" ELSE {other} END"


DOCUMENTS_SQL = f"""docs AS (
  SELECT o_orderkey::VARCHAR AS doc_id, o_custkey::VARCHAR AS patient_id, {_case("o_orderpriority", _PRIORITIES, "'other'")} AS doc_type,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d/%m/%Y')
      ELSE year(o_orderdate) || '/' || month(o_orderdate) || '/' || day(o_orderdate) END AS doc_date FROM orders)"""
FACTS_SQL = f"""{DOCUMENTS_SQL}, turns AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, least(l_linenumber, 7)
    ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS turn FROM lineitem
), lines AS (
  SELECT l_orderkey::VARCHAR AS ord_id, turn, {_case("least(l_linenumber, 7)", _LINE_FIELDS, "NULL")} AS field, l_linenumber AS seq, l_extendedprice AS score, l_suppkey AS supplier, l_tax, l_linestatus, l_returnflag,
    CASE WHEN l_discount < 0.02 THEN NULL WHEN least(l_linenumber, 7) = 4 THEN CASE WHEN l_quantity > 35 THEN strftime(l_shipdate, '%d/%m/%Y') END ELSE l_returnflag || l_linestatus END AS value
  FROM turns
), facts AS (
  SELECT CASE WHEN turn = 1 THEN ord_id ELSE ord_id || '.' || turn END AS doc_id, field, value, CASE WHEN l_tax < 0.02 THEN NULL WHEN l_tax < 0.05 THEN value ELSE l_linestatus || l_returnflag END AS other_value, score, seq, supplier,
    patient_id, doc_type, doc_date FROM lines JOIN docs ON docs.doc_id = lines.ord_id)"""

#: (doc_id, patient_id, doc_date, text): invented reports.
REPORTS = [
    ("r1", "8000000001", "10/02/2024", "Compte rendu anatomopathologique\nIPP: 8000000001\nPrélèvement du 05/02/2024.\n\nExamen microscopique\nProlifération gliale avec foyers de nécrose. On compte 4 mitoses.\nProlifération endothéliocapillaire nette.\n\nImmunohistochimie\nIDH1 : positif\nATRX : maintenu\np53 négatif\nGFAP positive, Olig2 positif.\nKi67 : 10 à 15 %\n\nConclusion\nAstrocytome, OMS 2021, grade 3."),
    ("r2", "8000000001", "05/03/2024", "Compte rendu de consultation. Patiente vue en consultation du 05/03/2024 pour une tumeur frontale gauche. IK : 80. Pas de céphalées. Keppra poursuivi, sans corticoïdes. Née le 03/09/1961, droitière."),
    ("r3", "8000000002", "12 avril 2023", "RCP de neuro-oncologie. Homme de 62 ans. Glioblastome temporal droit, progression radiologique probable. Proposition thérapeutique : 6 cycles de témozolomide après 60 Gy. Antécédent tumoral : aucun."),
    ("r4", "8000000002", "01/06/2023", "Biologie moléculaire\nPanel NGS : IDH1 sauvage, IDH2 wt. TERT muté C228T. MGMT méthylé.\nPas d'amplification EGFR. Amplification du gène CDK4.\nPas de fusion FGFR, fusion NTRK retrouvée.\n\nCGH-array\nGain du 7p, perte 10q, perte 10p. Codélétion 1p/19q absente."),
    ("r5", "8000000003", "2022/11/30", "IRM cérébrale de contrôle du 30/11/2022. Séquences FLAIR et T1 gadolinium : prise de contraste frontale droite, œdème péri-lésionnel, effet de masse. Pas de calcification."),
    ("r6", "8000000003", None, "Exérèse partielle le 14/12/2022, puis radiothérapie en janvier-23. Suspicion de récidive. Traitement par bévacizumab et lomustine, 2ème progression."),
    ("r7", "8000000004", "en 2020", "Texte libre sans titre, sans mention utile."),
    ("r8", "8000000004", None, ""),
]


def sql_text(value: str | None) -> str:
    if value is None:
        return "NULL::VARCHAR"
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in value.split("\n"))


def values(rows: list[tuple], names: str) -> str:
    """A DuckDB SELECT over literal texts."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(sql_text(v) if v is None or isinstance(v, str) else repr(v) for v in r) + ')' for r in rows)}) AS v({names})"


REPORTS_SQL = f"reports AS ({values(REPORTS, 'doc_id, patient_id, doc_date, text')})"


def reports(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REPORTS, "doc_id string, patient_id string, doc_date string, text string")


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, each behind one of the sample reports (number doc_id mod 8): doc_id, text. The invented prose has
    no clinical facts of its own."""
    texts = F.array(*[F.lit(r[3]) for r in REPORTS])
    pick = F.element_at(texts, (F.pmod("doc_id", F.lit(len(REPORTS))) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(pick, F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("text"))


def expected(facts: dict[int, dict], names: str = "field, value, confidence") -> str:
    """DuckDB SQL of what `seeded` documents hold, from hand-made facts by report (from 0)."""
    rows = [(i, f, *(v if isinstance(v, tuple) else (v,))) for i, found in facts.items() for f, v in found.items()]
    columns = ", ".join(f"e.{c.strip()}" for c in names.split(","))
    return f"SELECT d.doc_id, {columns} FROM documents d JOIN ({values(rows, 'report, ' + names)}) e ON e.report = d.doc_id % {len(REPORTS)}"
