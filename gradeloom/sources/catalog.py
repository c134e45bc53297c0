"""The module catalogue: programme -> list of modules, flattened to one name per code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CATALOG_JSON

# The bundled catalogue.
CATALOG_TEXT = """
{
  "CFGS Administració i Finances": [
    {"codi": "0647", "nom": "Gestió de la documentació jurídica i empresarial"},
    {"codi": "0648", "nom": "Recursos humans i responsabilitat social corporativa"},
    {"codi": "0649", "nom": "Ofimàtica i procés de la informació"},
    {"codi": "0650", "nom": "Procés integral de l'activitat comercial"},
    {"codi": "0651", "nom": "Comunicació i atenció al client"},
    {"codi": "0652", "nom": "Gestió de recursos humans"},
    {"codi": "0653", "nom": "Gestió financera"},
    {"codi": "0654", "nom": "Comptabilitat i fiscalitat"},
    {"codi": "0655", "nom": "Gestió logística i comercial"},
    {"codi": "0656", "nom": "Simulació empresarial"},
    {"codi": "C076", "nom": "Català / Aranès professional"},
    {"codi": "0179", "nom": "Anglès professional"},
    {"codi": "1665", "nom": "Digitalització aplicada als sectors productius"},
    {"codi": "1708", "nom": "Sostenibilitat aplicada al sistema productiu"},
    {"codi": "1709", "nom": "Itinerari personal per a l'ocupabilitat I"},
    {"codi": "1710", "nom": "Itinerari personal per a l'ocupabilitat II"},
    {"codi": "0657", "nom": "Projecte intermodular"},
    {"codi": null, "nom": "Mòdul professional optatiu"}
  ],
  "CFGM Gestió Administrativa": [
    {"codi": "0437", "nom": "Comunicació empresarial i atenció al client"},
    {"codi": "0438", "nom": "Operacions administratives de compravenda"},
    {"codi": "0439", "nom": "Empresa i administració"},
    {"codi": "0440", "nom": "Tractament informàtic de la informació"},
    {"codi": "0441", "nom": "Tècnica comptable"},
    {"codi": "0442", "nom": "Operacions administratives de recursos humans"},
    {"codi": "0443", "nom": "Tractament de la documentació comptable"},
    {"codi": "0446", "nom": "Empresa a l'aula"},
    {"codi": "0448", "nom": "Operacions auxiliars de gestió de tresoreria"},
    {"codi": "C056", "nom": "Català / Aranès professional"},
    {"codi": "0156", "nom": "Anglès professional"},
    {"codi": "1664", "nom": "Digitalització aplicada als sectors productius"},
    {"codi": "1708", "nom": "Sostenibilitat aplicada al sistema productiu"},
    {"codi": "1709", "nom": "Itinerari personal per a l'ocupabilitat I"},
    {"codi": "1710", "nom": "Itinerari personal per a l'ocupabilitat II"},
    {"codi": "1713", "nom": "Projecte intermodular"},
    {"codi": null, "nom": "Mòdul professional optatiu"}
  ],
  "CFGM Gestió Administrativa d'àmbit jurídic": [
    {"codi": "0437", "nom": "Comunicació empresarial i atenció al client"},
    {"codi": "0438", "nom": "Operacions administratives de compravenda"},
    {"codi": "0439", "nom": "Empresa i administració"},
    {"codi": "0440", "nom": "Tractament informàtic de la informació"},
    {"codi": "0441", "nom": "Tècnica comptable"},
    {"codi": "0442", "nom": "Operacions administratives de recursos humans"},
    {"codi": "0443", "nom": "Tractament de la documentació comptable"},
    {"codi": "0446", "nom": "Empresa a l'aula"},
    {"codi": "0448", "nom": "Operacions auxiliars de gestió de tresoreria"},
    {"codi": "C056", "nom": "Català / Aranès professional"},
    {"codi": "0156", "nom": "Anglès professional"},
    {"codi": "1664", "nom": "Digitalització aplicada als sectors productius"},
    {"codi": "1708", "nom": "Sostenibilitat aplicada al sistema productiu"},
    {"codi": "1709", "nom": "Itinerari personal per a l'ocupabilitat I"},
    {"codi": "1710", "nom": "Itinerari personal per a l'ocupabilitat II"},
    {"codi": "1713", "nom": "Projecte intermodular"},
    {"codi": "C004", "nom": "Organització i estructura de l'àmbit judicial"},
    {"codi": "C005", "nom": "Tramitació processal i auxili judicial"}
  ]
}
"""


def parse_catalog(texts: DataFrame, column: str = "text") -> DataFrame:
    """Catalogue JSON to ``(programme, programme_pos, item_pos, mp_code, mp_name)``."""
    entries = texts.select(
        F.posexplode(F.map_entries(F.from_json(column, CATALOG_JSON))).alias("programme_pos", "p")
    )
    return entries.select(
        F.col("p.key").alias("programme"),
        "programme_pos",
        F.posexplode("p.value").alias("item_pos", "m"),
    ).select(
        "programme", "programme_pos", "item_pos",
        F.col("m.codi").alias("mp_code"), F.col("m.nom").alias("mp_name"),
    )


def first_names(catalog: DataFrame) -> DataFrame:
    """One name per code: the first programme that lists it wins."""
    usable = catalog.filter((F.col("mp_code") != "") & (F.col("mp_name") != ""))
    return usable.groupBy("mp_code").agg(
        F.min_by("mp_name", F.struct("programme_pos", "item_pos")).alias("mp_name")
    )


def bundled_names(spark: SparkSession) -> DataFrame:
    """The bundled catalogue as ``(mp_code, mp_name)``: 32 rows, so it is broadcast."""
    texts = spark.range(1).select(F.lit(CATALOG_TEXT).alias("text"))
    return F.broadcast(first_names(parse_catalog(texts)))


def with_module_label(df: DataFrame, names: DataFrame, code: str = "mp") -> DataFrame:
    """Adds ``mp_label``: ``code. name`` when the catalogue knows the code, else the code.

    Spark broadcasts ``names`` when it measures it as small; any size works.
    """
    joined = df.join(names, df[code] == names["mp_code"], "left")
    label = F.coalesce(F.concat(code, F.lit(". "), "mp_name"), F.col(code))
    return joined.withColumn("mp_label", label).drop("mp_code", "mp_name")
