"""Readers for call logs and user lists in delimited text and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callstrata.functions.dates import parse_call_time

# Separators tried in order.
SEPARATORS = [";", ",", "\t"]
#: Files of a folder whose table may be broadcast.
FILES_BROADCAST = 100_000


def read_calls(spark: SparkSession, path: str, sep: str = ";", encoding: str = "UTF-8") -> DataFrame:
    """Delimited log with a header: every column as text, names trimmed.

    Only the header line is looked at to name the columns; values are typed
    later by the mapping, so no pass over the data infers anything.
    """
    raw = (spark.read.option("sep", sep).option("header", True).option("encoding", encoding)
           .option("inferSchema", False).csv(path))
    return raw.toDF(*[c.strip() for c in raw.columns])


def typed_calls(raw: DataFrame) -> DataFrame:
    """Canonical types for a log whose columns carry the canonical names."""
    cast = {"FECHA": parse_call_time(F.col("FECHA"))}
    if "DURACION" in raw.columns:
        cast["DURACION"] = F.col("DURACION").try_cast("int")
    return raw.withColumns(cast)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(archivo, inicio, orden, bytes, linea): the raw lines of every file under a folder.

    The text source splits large files and keeps the bytes as they are.
    """
    return spark.read.option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("archivo"), F.col("_metadata.file_block_start").alias("inicio"),
        F.col("_metadata.file_size").alias("bytes"), F.monotonically_increasing_id().alias("orden"),
        F.col("value").alias("linea"))


def detect_charset(spark: SparkSession, path: str) -> DataFrame:
    """(archivo, charset): UTF-8 when every line is valid UTF-8, else ISO-8859-1.

    Line breaks never fall inside a UTF-8 character, so the lines of a file can
    be judged apart and in parallel.
    """
    good = F.is_valid_utf8("linea")
    return text_lines(spark, path).groupBy("archivo").agg(
        F.when(F.bool_and(good), "UTF-8").otherwise("ISO-8859-1").alias("charset"))


def _header(lines: DataFrame) -> DataFrame:
    """(archivo, cabecera, primera): first line of each file and its number, from the split that starts the file."""
    first = F.col("inicio") == 0
    at = F.when(first, F.col("orden"))
    return lines.groupBy("archivo").agg(F.min_by(F.when(first, F.col("linea")), at).alias("cabecera"), F.min(at).alias("primera"))


def _separator(head) -> Column:
    """The first separator a header holds; a header of one column holds none and counts as the first."""
    found = F.lit(SEPARATORS[0])
    for s in reversed(SEPARATORS):
        found = F.when(F.contains(head, F.lit(s)), s).otherwise(found)
    return found


def sniff_sep(spark: SparkSession, path: str) -> DataFrame:
    """(archivo, cabecera, sep): the first separator that gives the header more than one column."""
    return _header(text_lines(spark, path)).select("archivo", "cabecera", _separator(F.col("cabecera")).alias("sep"))


def _fields(line, width: int, sep: str) -> Column:
    """The fields of a delimited line as an array of ``width``; quotes are honoured."""
    names = [f"c{i}" for i in range(width)]
    row = F.from_csv(line, ", ".join(f"{n} STRING" for n in names), {"sep": sep})
    return F.array(*[row[n] for n in names])


def read_mixed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Text records of a folder whose files differ in charset, separator and columns.

    One pass over the lines finds charset, header and separator of each file, a
    second decodes and splits them. Columns are taken by the names in each
    file's header, so a file may have fewer, and a file of one column has no
    separator at all. Only the first line of a file is its header; an equal line
    further down is data. The file table is as long as the folder's file list
    and is broadcast while that is short.
    """
    lines = text_lines(spark, path)
    first = F.col("inicio") == 0
    at = F.when(first, F.col("orden"))
    files = lines.groupBy("archivo").agg(
        F.bool_and(F.is_valid_utf8("linea")).alias("utf8"), F.min_by(F.when(first, F.col("linea")), at).alias("cabecera"), F.min(at).alias("primera"))
    decoded = lambda c: F.when(F.col("utf8"), c).otherwise(F.decode(c.cast("binary"), "ISO-8859-1"))
    files = files.withColumn("cabecera", decoded(F.col("cabecera"))).withColumn("sep", _separator(F.col("cabecera")))
    total, width = files.agg(F.count(F.lit(1)), F.max(F.size(F.split("cabecera", "[;,\t]")))).first()
    files = F.broadcast(files) if total <= FILES_BROADCAST else files
    body = lines.join(files, "archivo").where(F.col("orden") != F.col("primera")).withColumn("linea", decoded(F.col("linea")))

    def split(c) -> Column:
        out = _fields(c, max(width or 1, 1), SEPARATORS[0])
        for s in SEPARATORS[1:]:
            out = F.when(F.col("sep") == s, _fields(c, max(width or 1, 1), s)).otherwise(out)
        return out

    rows = body.select(F.transform(split(F.col("cabecera")), lambda x: F.trim(x)).alias("nombres"), split(F.col("linea")).alias("valores"))
    place = lambda name: F.array_position("nombres", name)
    return rows.select(*[F.when(place(f.name) > 0, F.try_element_at("valores", place(f.name).cast("int"))).alias(f.name) for f in schema])


def read_json_records(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON records: a list of objects, objects holding the list in their first array field, or single objects.

    Where the first line of every file is a whole object, the files hold an
    object per line and are read in splits; else a file is one document, whose
    list or object may run over many lines.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    head = F.trim("cabecera")
    whole = F.startswith(head, F.lit("{")) & F.try_parse_json(head).isNotNull()
    by_line = _header(text_lines(spark, path)).where(F.col("cabecera").isNotNull()).agg(F.bool_and(whole)).first()[0]
    df = reader.option("multiLine", not by_line).json(path)
    for f in df.schema:
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            return df.select(F.inline(F.col(f"`{f.name}`")))
    return df


def measure_files(spark: SparkSession, path: str) -> DataFrame:
    """(nombre, bytes, lineas, cabecera) of every file under a folder, for the acceptance rules."""
    lines = text_lines(spark, path)
    size = lines.groupBy("archivo").agg(F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("lineas"))
    return size.join(_header(lines).select("archivo", "cabecera"), "archivo", "left").select(
        F.element_at(F.split("archivo", "/"), -1).alias("nombre"), "bytes", "lineas", "cabecera")


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and time of every file under a folder; the content column is never read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("nombre"), "path", F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modificado"))


def latest_result(spark: SparkSession, path: str, tipo: str) -> DataFrame:
    """Predictions of the newest result of a call type; results sort by name.

    A result is a file, or a folder of part files, whose own name holds the
    type; results of all types and dates may share one folder. The newest is one
    value found from the file list alone; no other result is read.
    """
    mark, parts = F.lit(f"_{tipo}_"), F.split("path", "/")
    named = file_inventory(spark, path).where(F.col("path").endswith(".json")).withColumn("carpeta", F.element_at(parts, -2))
    own, folder = F.contains("nombre", mark), F.contains("carpeta", mark)
    newest = named.where(own | folder).agg(F.max(F.struct(
        F.when(own, F.col("nombre")).otherwise(F.col("carpeta")).alias("resultado"), own.alias("suelto"), "path"))).first()[0]
    if newest is None:
        raise FileNotFoundError(f"no result of type {tipo} under {path}")
    return read_json_records(spark, newest["path"] if newest["suelto"] else newest["path"].rsplit("/", 1)[0])
