"""Holiday dimension: one row per holiday date, with its category and calendar parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callstrata.schema import HOLIDAY_KEYWORDS, HOLIDAY_OTHER

# The national holidays of Chile 2023-2025 (dd-MM-yyyy, description).
NATIONAL_HOLIDAYS = [
    ("01-01-2023", "Año Nuevo"),
    ("02-01-2023", "Feriado Adicional por Año Nuevo"),
    ("07-04-2023", "Viernes Santo"),
    ("08-04-2023", "Sábado Santo"),
    ("01-05-2023", "Día Nacional del Trabajo"),
    ("21-05-2023", "Día de las Glorias Navales"),
    ("21-06-2023", "Día Nacional de los Pueblos Indígenas"),
    ("26-06-2023", "San Pedro y San Pablo"),
    ("16-07-2023", "Día de la Virgen del Carmen"),
    ("15-08-2023", "Asunción de la Virgen"),
    ("18-09-2023", "Independencia Nacional"),
    ("19-09-2023", "Día de las Glorias del Ejército"),
    ("09-10-2023", "Encuentro de Dos Mundos"),
    ("27-10-2023", "Día de las Iglesias Evangélicas y Protestantes"),
    ("01-11-2023", "Día de Todos los Santos"),
    ("08-12-2023", "Inmaculada Concepción"),
    ("17-12-2023", "Plebiscito Constitucional"),
    ("25-12-2023", "Navidad"),
    ("01-01-2024", "Año Nuevo"),
    ("29-03-2024", "Viernes Santo"),
    ("30-03-2024", "Sábado Santo"),
    ("01-05-2024", "Día Nacional del Trabajo"),
    ("21-05-2024", "Día de las Glorias Navales"),
    ("09-06-2024", "Elecciones Primarias de Alcaldes y Gobernadores"),
    ("20-06-2024", "Día Nacional de los Pueblos Indígenas"),
    ("29-06-2024", "San Pedro y San Pablo"),
    ("16-07-2024", "Día de la Virgen del Carmen"),
    ("15-08-2024", "Asunción de la Virgen"),
    ("18-09-2024", "Independencia Nacional"),
    ("19-09-2024", "Día de las Glorias del Ejército"),
    ("20-09-2024", "Feriado Adicional por Fiestas Patrias"),
    ("12-10-2024", "Encuentro de Dos Mundos"),
    ("27-10-2024", "Elecciones Municipales, de Consejeros Regionales y Gobernadores Regionales"),
    ("31-10-2024", "Día de las Iglesias Evangélicas y Protestantes"),
    ("01-11-2024", "Día de Todos los Santos"),
    ("08-12-2024", "Inmaculada Concepción"),
    ("25-12-2024", "Navidad"),
    ("01-01-2025", "Año Nuevo"),
    ("18-04-2025", "Viernes Santo"),
    ("19-04-2025", "Sábado Santo"),
    ("01-05-2025", "Día Nacional del Trabajo"),
    ("21-05-2025", "Día de las Glorias Navales"),
    ("20-06-2025", "Día Nacional de los Pueblos Indígenas"),
    ("29-06-2025", "San Pedro y San Pablo"),
    ("16-07-2025", "Día de la Virgen del Carmen"),
    ("15-08-2025", "Asunción de la Virgen"),
    ("18-09-2025", "Independencia Nacional"),
    ("19-09-2025", "Día de las Glorias del Ejército"),
    ("12-10-2025", "Encuentro de Dos Mundos"),
    ("31-10-2025", "Día de las Iglesias Evangélicas y Protestantes"),
    ("01-11-2025", "Día de Todos los Santos"),
    ("08-12-2025", "Inmaculada Concepción"),
    ("25-12-2025", "Navidad"),
]


def category(description: Column) -> Column:
    """Category of a holiday description; the first keyword group that occurs wins."""
    out = None
    for label, words in HOLIDAY_KEYWORDS:
        hit = F.lower(description).rlike("|".join(words))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(HOLIDAY_OTHER)


def enrich(raw: DataFrame) -> DataFrame:
    """(fecha date, descripcion) -> one row per date with year, month, day and category."""
    one = raw.where(F.col("fecha").isNotNull()).groupBy("fecha").agg(F.min("descripcion").alias("descripcion"))
    return one.select(
        "fecha",
        "descripcion",
        F.year("fecha").alias("anio"),
        F.month("fecha").alias("mes"),
        F.dayofyear("fecha").alias("dia_anio"),
        F.date_format("fecha", "EEEE").alias("dia_semana"),
        category(F.col("descripcion")).alias("categoria"),
    )


def holiday_dim(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Holiday dimension from a two-column CSV, or from the built-in national list."""
    if path is None:
        raw = spark.createDataFrame(NATIONAL_HOLIDAYS, "f string, d string").coalesce(1)
    else:
        raw = spark.read.option("header", True).schema("f string, d string").csv(path)
    parsed = raw.select(
        F.to_date(F.try_to_timestamp(F.trim("f"), F.lit("dd-MM-yyyy"))).alias("fecha"),
        F.trim("d").alias("descripcion"),
    )
    return enrich(parsed)
