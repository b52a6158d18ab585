"""Canonical record shapes and the fixed values the operators share."""

from __future__ import annotations

from pyspark.sql import types as T

CALLS_TEXT = T.StructType([
    T.StructField(c, T.StringType()) for c in
    ("FECHA", "TELEFONO", "SENTIDO", "ATENDIDA", "STATUS", "DURACION", "USUARIO", "CARGO")
])

CALLS = T.StructType([
    T.StructField("FECHA", T.TimestampNTZType()),
    T.StructField("TELEFONO", T.StringType()),
    T.StructField("SENTIDO", T.StringType()),
    T.StructField("ATENDIDA", T.StringType()),
    T.StructField("STATUS", T.StringType()),
    T.StructField("DURACION", T.IntegerType()),
    T.StructField("USUARIO", T.StringType()),
    T.StructField("CARGO", T.StringType()),
])

# Column aliases accepted for the five standard call fields.
CALL_ALIASES = {
    "fecha": ["fecha", "date", "fecha_llamada", "call_date"],
    "hora": ["hora", "time", "hora_llamada", "call_time"],
    "tipo": ["tipo", "type", "tipo_llamada", "call_type", "direccion", "sentido"],
    "duracion": ["duracion", "duration", "duracion_segundos", "call_duration"],
    "agente": ["agente", "agent", "usuario", "user", "operador", "telefono"],
}

# Column aliases accepted for the six user-mapping fields.
USER_ALIASES = {
    "username_reservo": ["username_reservo", "usuario_reservo", "reservo_user"],
    "cargo": ["cargo", "position", "role", "puesto"],
    "uuid_reservo": ["uuid_reservo", "reservo_id", "id_reservo"],
    "id_usuario_alodesk": ["id_usuario_alodesk", "alodesk_id", "user_id_alodesk"],
    "username_alodesk": ["username_alodesk", "usuario_alodesk", "alodesk_user"],
    "anexo": ["anexo", "extension", "phone_ext"],
}

# Substrings that name the three user-list columns.
USER_COLUMN_HINTS = {
    "TELEFONO": ["TELEFONO", "TEL", "PHONE", "NUMERO", "ANEXO"],
    "USUARIO": ["USUARIO", "USER", "NAME", "NOMBRE", "AGENTE", "USERNAME_ALODESK", "USERNAME_RESERVO"],
    "CARGO": ["CARGO", "ROL", "ROLE", "PUESTO", "POSITION", "PERMISO"],
}

# Spellings of the call direction.
DIRECTION_WORDS = {
    "incoming": "entrante",
    "outgoing": "saliente",
    "inbound": "entrante",
    "outbound": "saliente",
    "entrada": "entrante",
    "salida": "saliente",
}

# What the field detector looks for, in priority order.
FIELD_RULES = {
    "FECHA": {
        "keywords": ["fecha", "date", "time", "timestamp", "hora", "datetime", "created", "updated"],
        "patterns": [r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}", r"\d{4}[-/]\d{1,2}[-/]\d{1,2}", r"\d{1,2}:\d{2}:\d{2}"],
        "required": True,
    },
    "TELEFONO": {
        "keywords": ["telefono", "phone", "tel", "numero", "extension", "ext", "anexo", "caller", "number"],
        "patterns": [r"^\+?[0-9]{7,15}$", r"^[0-9]{7,10}$", r"^\d{3,4}$"],
        "required": True,
    },
    "SENTIDO": {
        "keywords": ["sentido", "direction", "tipo", "type", "call_type", "inbound", "outbound"],
        "values": ["in", "out", "inbound", "outbound", "entrada", "salida", "entrante", "saliente"],
        "required": True,
    },
    "ATENDIDA": {
        "keywords": ["atendida", "answered", "status", "estado", "result", "outcome"],
        "values": ["si", "no", "yes", "answered", "missed", "busy", "failed"],
    },
    "DURACION": {
        "keywords": ["duracion", "duration", "tiempo", "length", "call_time"],
        "patterns": [r"^\d+:\d{2}:\d{2}$", r"^\d+$"],
    },
    "USUARIO": {"keywords": ["usuario", "user", "agent", "agente", "operator", "name", "nombre"]},
    "CARGO": {"keywords": ["cargo", "role", "position", "puesto", "job", "title"]},
}
NAME_WEIGHT, PATTERN_WEIGHT, VALUE_WEIGHT, DETECT_THRESHOLD = 0.40, 0.35, 0.25, 0.3

# Keywords of the holiday categories; the first category that matches wins.
HOLIDAY_KEYWORDS = [
    ("Religioso", ["navidad", "año nuevo", "santo", "virgen", "inmaculada", "santos"]),
    ("Cívico", ["independencia", "glorias", "trabajo", "patrias"]),
    ("Electoral", ["elecciones", "plebiscito"]),
    ("Cultural", ["pueblos indígenas", "evangélicas"]),
]
HOLIDAY_OTHER = "Otro"

# Day-type labels by precedence.
DAY_LABOUR, DAY_WEEKEND, DAY_LONG = "Día Laboral", "Fin de Semana", "Fin de Semana Largo"
DAY_PRE, DAY_POST = "Pre-Feriado", "Post-Feriado"

# Text fragments that mark an uploaded body as suspicious.
SUSPICIOUS = [
    "<script", "javascript:", "vbscript:", "onload=", "onerror=", "eval(", "exec(", "system(",
    "shell_exec", "<?php", "<%", "select * from", "drop table", "delete from", "insert into", "update set",
]

# What is removed from error texts, in order of application, with the fragments a match must hold.
SENSITIVE = [
    (r'password["\s]*[:=]["\s]*[^"\s]+', ("password",)),
    (r'token["\s]*[:=]["\s]*[^"\s]+', ("token",)),
    (r'key["\s]*[:=]["\s]*[^"\s]+', ("key",)),
    (r'secret["\s]*[:=]["\s]*[^"\s]+', ("secret",)),
    (r'postgresql://[^"\s]+', ("postgresql://",)),
    (r'mysql://[^"\s]+', ("mysql://",)),
    (r'mongodb://[^"\s]+', ("mongodb://",)),
    (r'[C-Z]:\\[^"\s]+', (":\\",)),
    (r'/home/[^"\s]+', ("/home/",)),
    (r'/var/[^"\s]+', ("/var/",)),
    (r'/usr/[^"\s]+', ("/usr/",)),
    (r'File "[^"]+", line \d+', ('file "', '", line ')),
    (r'at [^\s]+ \([^)]+\)', ("at ", " (")),
    (r'Python \d+\.\d+\.\d+', ("python ",)),
    (r'FastAPI \d+\.\d+\.\d+', ("fastapi ",)),
    (r'uvicorn \d+\.\d+\.\d+', ("uvicorn ",)),
]
SENSITIVE_MARK = "[SENSITIVE_DATA_REMOVED]"
LONG_PATH, LONG_PATH_MARK = r"[/\\][a-zA-Z0-9_\\/-]{20,}", "[PATH_REMOVED]"
TRACE_MARK = " [Stack trace removed in production]"

# File acceptance rules.
FILE_MIN_BYTES, FILE_MAX_BYTES, FILE_NAME_MAX = 100, 50 * 1024 * 1024, 255
FILE_EXTENSIONS = [".csv", ".xlsx", ".xls"]
FILE_BAD_CHARS = r'\.\.|[/\\:*?"<>|\x00]'
FILE_RESERVED = r"^(con|prn|aux|nul|com[1-9]|lpt[1-9])$"

# Request limits per key and per endpoint, and the block escalation.
BURST_SECONDS, BURST_LIMIT, MINUTE_LIMIT, HOUR_LIMIT = 10, 10, 60, 300
USER_MINUTE_LIMIT, USER_HOUR_LIMIT = 100, 500
GLOBAL_MINUTE_LIMIT, GLOBAL_HOUR_LIMIT = 1000, 5000
BLOCK_AFTER, BLOCK_MINUTES, BLOCK_FACTOR, BLOCK_MAX_STEPS = 3, 15, 2, 5

# Ensemble weight bounds and interval factor.
WEIGHT_MIN, WEIGHT_MAX, Z95, Z80 = 0.1, 0.5, 1.96, 1.2816

# System goals, alert thresholds and the error level before the project.
GOAL_MAE, MAE_CRITICAL, DEGRADATION_PCT, BASE_MAE, BASE_RMSE = 10.0, 25.0, 20.0, 32.81, 41.11

DEFAULT_USER = "WEB"
DEFAULT_ROLE = "Agente"
