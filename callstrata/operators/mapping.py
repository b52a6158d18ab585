"""Column mapping: aliases, automatic field detection, renaming and standardising."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callstrata.functions.dates import parse_call_time
from callstrata.functions.numbering import number_rows
from callstrata.schema import (
    CALL_ALIASES, DEFAULT_ROLE, DEFAULT_USER, DETECT_THRESHOLD, DIRECTION_WORDS, FIELD_RULES,
    NAME_WEIGHT, PATTERN_WEIGHT, USER_ALIASES, USER_COLUMN_HINTS, VALUE_WEIGHT,
)
from callstrata.session import checkpointed


def map_aliases(columns: list[str], aliases: Mapping[str, list[str]]) -> dict[str, str | None]:
    """Field -> column for the first alias present, ignoring case (schema only)."""
    by_lower: dict[str, str] = {}
    for c in columns:
        by_lower.setdefault(c.lower(), c)
    return {
        field: next((by_lower[a] for a in names if a in by_lower), None)
        for field, names in aliases.items()
    }


def alias_report(df: DataFrame, aliases: Mapping[str, list[str]] = CALL_ALIASES) -> DataFrame:
    """One row per field: mapped column or null, whether every field was found, and the row count."""
    found = map_aliases(df.columns, aliases)
    valid = all(found.values())
    rows = F.array(*[
        F.struct(F.lit(f).alias("campo"), F.lit(c).cast("string").alias("columna")) for f, c in found.items()
    ])
    return df.agg(F.count(F.lit(1)).alias("total_registros")).select(
        F.inline(rows), F.lit(valid).alias("valido"), "total_registros")


def user_mapping_report(df: DataFrame) -> DataFrame:
    """Counts of users with and without the second system, and distinct roles."""
    found = map_aliases(df.columns, USER_ALIASES)
    second, role = found["username_alodesk"], found["cargo"]
    with_second = F.count(second) if second else F.lit(0).cast("long")
    return df.agg(
        F.lit(bool(found["username_reservo"] and role)).alias("valido"),
        F.count(F.lit(1)).alias("total_registros"),
        with_second.alias("usuarios_con_alodesk"),
        (F.count(F.lit(1)) - with_second).alias("usuarios_solo_reservo"),
        (F.countDistinct(role) if role else F.lit(0).cast("long")).alias("cargos_unicos"),
    )


def _cells(df: DataFrame) -> DataFrame:
    """(orden, valor): the lower-case text of every value that is not null, with the number of its column."""
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("orden"), F.lower(F.col(c).cast("string")).alias("valor"))
        for i, c in enumerate(df.columns)
    ]))).where(F.col("valor").isNotNull())


def _word_hit(rule: Mapping) -> Column:
    hit = F.lit(False)
    for v in rule["values"]:
        hit = hit | F.col("valor").contains(v)
    return hit


def pattern_counts(df: DataFrame) -> tuple[DataFrame, dict[str, list[str]]]:
    """Per column its values, how many match each pattern, and whether any holds a word of a field; and the names of these counts by field.

    The counts are taken where the rows are: what is shuffled is a row per task and column, however many values a column has.
    """
    aggs, names = [F.count(F.lit(1)).alias("_n")], {}
    for field, rule in FIELD_RULES.items():
        for j, pattern in enumerate(rule.get("patterns", [])):
            names.setdefault(field, []).append(f"{field}_{j}")
            aggs.append(F.count_if(F.col("valor").rlike(f"^(?:{pattern})")).alias(f"{field}_{j}"))
        if "values" in rule:
            aggs.append(F.bool_or(_word_hit(rule)).alias(f"{field}_w"))
    return _cells(df).groupBy("orden").agg(*aggs), names


def field_scores(df: DataFrame) -> DataFrame:
    """(orden, columna, campo, prioridad, puntaje) for every column and canonical field.

    One pass counts matches without moving values. Shares of different values that hold a field's words need the different
    values; a second pass finds these, for columns that hold such a word at all.
    """
    cols = df.columns
    counts, names = pattern_counts(df)
    counts = checkpointed(counts)
    ratios_of = [(F.col(c) / F.col("_n")).alias(c) for own in names.values() for c in own]
    measured = counts.select("orden", *ratios_of)
    for field, rule in FIELD_RULES.items():
        if "values" not in rule:
            continue
        held = [r[0] for r in counts.where(F.col(f"{field}_w")).select("orden").collect()]  # column numbers
        own = df.select(*[F.col(f"`{cols[i]}`").alias(str(i)) if i in held else F.lit(None).cast("string").alias(str(i)) for i in range(len(cols))])
        share = _cells(own).distinct().groupBy("orden").agg(F.avg(_word_hit(rule).cast("double")).alias(f"{field}_v"))
        measured = measured.join(F.broadcast(share), "orden", "left")  # a row per column

    # Columns without any value still score by name.
    names_df = df.sparkSession.createDataFrame(list(enumerate(cols)), "orden int, columna string").coalesce(1)
    joined = F.broadcast(names_df).join(measured, "orden", "left")
    name = F.lower(F.trim("columna"))
    rows = []
    for prio, (field, rule) in enumerate(FIELD_RULES.items(), start=1):
        by_name = F.when(name.rlike("|".join(rule["keywords"])), F.lit(NAME_WEIGHT)).otherwise(F.lit(0.0))
        ratios = [F.coalesce(F.col(c), F.lit(0.0)) for c in names.get(field, [])] + [F.lit(0.0), F.lit(0.0)]
        by_pattern = F.greatest(*ratios) * PATTERN_WEIGHT
        by_value = F.coalesce(F.col(f"{field}_v"), F.lit(0.0)) * VALUE_WEIGHT if "values" in rule else F.lit(0.0)
        rows.append(F.struct(
            F.lit(field).alias("campo"), F.lit(prio).alias("prioridad"),
            F.least(by_name + by_pattern + by_value, F.lit(1.0)).alias("puntaje")))
    return joined.select("orden", "columna", F.inline(F.array(*rows)))


def detect_fields(df: DataFrame, keep: str = "best") -> DataFrame:
    """(campo, columna, prioridad, confianza): the canonical field each column stands for.

    A column goes to its best field, the earlier field on a tie, when the score
    passes the threshold. Where several columns claim a field, ``keep='best'``
    takes the highest score and ``keep='last'`` the last column.
    """
    scores = field_scores(df)
    per_col = Window.partitionBy("orden").orderBy(F.desc("puntaje"), "prioridad")
    best = scores.withColumn("_r", F.row_number().over(per_col)).where(
        (F.col("_r") == 1) & (F.col("puntaje") > DETECT_THRESHOLD))
    order = [F.desc("puntaje"), F.asc("orden")] if keep == "best" else [F.desc("orden")]
    per_field = Window.partitionBy("campo").orderBy(*order)
    return best.withColumn("_f", F.row_number().over(per_field)).where("_f = 1").select(
        "campo", "columna", "prioridad", F.col("puntaje").alias("confianza"))


def confidence_bands(detected: DataFrame) -> DataFrame:
    """Number of mapped fields with high, middle and low confidence."""
    c = F.col("confianza")
    return detected.agg(
        F.count_if(c > 0.7).alias("alta"),
        F.count_if((c >= 0.4) & (c <= 0.7)).alias("media"),
        F.count_if(c < 0.4).alias("baja"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prioridad", "campo"))),
                                 lambda x: x["campo"]), ",").alias("campos"),
    )


def validate_mapping(mapping: Mapping[str, str], columns: list[str]) -> list[str]:
    """Problems of a mapping: required field unmapped, column absent, column used twice."""
    problems = [f"falta {f}" for f, r in FIELD_RULES.items() if r.get("required") and not mapping.get(f)]
    problems += [f"columna inexistente {c}" for c in mapping.values() if c and c not in columns]
    used = [c for c in mapping.values() if c]
    problems += [f"columna repetida {c}" for c in sorted({c for c in used if used.count(c) > 1})]
    return problems


def require_columns(columns: list[str], required=("FECHA", "TELEFONO")) -> list[str]:
    """Required columns a table lacks, in the order asked for."""
    return [c for c in required if c not in columns]


def apply_mapping(df: DataFrame, mapping: Mapping[str, str], required=("FECHA", "TELEFONO")) -> DataFrame:
    """Rename mapped columns to their canonical names."""
    out = df.withColumnsRenamed({c: f for f, c in mapping.items() if c})
    lacking = require_columns(out.columns, required)
    if lacking:
        raise ValueError(f"required columns missing: {lacking}")
    return out


def standardize_calls(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Project the mapped call fields; coerce the date, direction words and duration."""
    words = F.create_map(*[F.lit(x) for pair in DIRECTION_WORDS.items() for x in pair])
    out: list[Column] = []
    for field, col in mapping.items():
        if not col or col not in df.columns:
            continue
        c = F.col(col)
        if field == "fecha":
            c = parse_call_time(c.cast("string"))
        elif field == "tipo":
            low = F.lower(c)
            c = F.coalesce(F.try_element_at(words, low), low)
        elif field == "duracion":
            c = c.cast("string").try_cast("double")
        out.append(c.alias(field))
    return df.select(*out)


def standardize_users(df: DataFrame, mapping: Mapping[str, str], default_user: str = DEFAULT_USER) -> DataFrame:
    """Project the mapped user fields; clean role and names; add display name and second-system flag."""
    out = {f: F.col(c) for f, c in mapping.items() if c and c in df.columns}
    if "cargo" in out:
        out["cargo"] = F.trim(F.upper(out["cargo"]))
    first, second = out.get("username_reservo"), out.get("username_alodesk")
    if first is not None:
        out["username_reservo"] = F.trim(first)
    shown = F.coalesce(*[c for c in (second, first) if c is not None], F.lit(default_user))
    out["usuario_display"] = F.when(F.trim(shown) == "", default_user).otherwise(shown)
    if second is not None:
        out["tiene_alodesk"] = second.isNotNull()
    return df.select(*[c.alias(n) for n, c in out.items()])


def map_user_columns(columns: list[str]) -> dict[str, str]:
    """Column -> canonical user column by substring; the first column that fits is taken."""
    out: dict[str, str] = {}
    for target, hints in USER_COLUMN_HINTS.items():
        hit = next((c for c in columns if any(h in c.upper() for h in hints)), None)
        if hit is not None:
            out[hit] = target
    return out


def clean_users(df: DataFrame, key: str, default_user: str = DEFAULT_USER) -> DataFrame:
    """(TELEFONO, USUARIO, CARGO) with fallbacks for absent columns, defaults for blanks, short phones dropped."""
    cols = df.columns
    if "TELEFONO" in cols:
        phone = F.col("TELEFONO")
    elif "anexo" in cols:
        phone = F.col("anexo")
    elif "id_usuario_alodesk" in cols:
        phone = F.col("id_usuario_alodesk")
    else:
        df = number_rows(df, key, "_num")
        phone = F.concat(F.lit("EXT_"), (F.col("_num") + 999).cast("string"))
    names = [F.col(c) for c in ("username_alodesk", "username_reservo") if c in cols]
    user = F.col("USUARIO") if "USUARIO" in cols else F.coalesce(*names, F.lit(default_user))
    role = next((F.col(c) for c in ("CARGO", "Permiso", "cargo") if c in cols), F.lit(DEFAULT_ROLE))
    blank = user.isNull() | (F.trim(user) == "") | user.isin("None", "nan")
    return df.select(
        F.trim(phone.cast("string")).alias("TELEFONO"),
        F.trim(F.when(blank, default_user).otherwise(user)).alias("USUARIO"),
        F.trim(role.cast("string")).alias("CARGO"),
    ).where(F.length("TELEFONO") > 5)
