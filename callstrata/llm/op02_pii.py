"""Personal data by weak supervision.

Base patterns and looser ones give candidate spans. Labelers vote on every candidate: its strict form, a gazetteer of its kind, the
words before it for and against, and its shape. The votes of the whole corpus, counted by pattern, go into an expectation
maximisation that estimates each labeler's reliability and a posterior per pattern. On these posteriors a logistic regression is trained
over votes and span features; it decides which looser candidates become spans. Base spans always stay. Near misses
of the base patterns (a failed check digit, an address part over 255) take part in the training only.

Only DataFrame functions and ``pyspark.ml`` are used. What reaches the driver are vote patterns, at most ``3 ** 5`` per kind, and
the coefficients of the model.

Defined results: a null or empty text has no spans; repeated rows give repeated result rows; a corpus without candidates trains nothing
and adds nothing; a looser candidate that overlaps a base span of its kind is that span.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callstrata.llm.text import staged

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "person", "ssn", "iban")
VOTES = ("strict", "gazetteer", "for", "against", "shape")

#: Base patterns. A run is entered at its start or where the last match ended, and never given back; the matches are those of the plain patterns.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match that stays.
GATE = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
#: Looser candidates: kind, pattern, gate.
LOOSE = [
    ("email", r"[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,64}\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z]{2,12}\b", r"\(dot\)|\[dot\]|\x20dot\x20"),
    ("phone", r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"),
    ("person", r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]{1,30}(?:\x20[A-Z][a-z]{1,30})?", r"(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z]"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]{4}"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?\b", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
]
#: Gazetteers as patterns over the value: members vote for, others against.
GAZETTEER = {
    "email": r"(?i)(?:\.|dot[)\]]?\x20?)(?:com|org|net|edu|gov|info|biz|io|eu|uk|de|fr|es|it|nl|be|ch|at|pl|pt|se|no|dk|fi|us|ca|mx|br|ar|cl|in|cn|jp|kr|au|nz|za|ru)$",
    "ip": r"^(?!0\.|10\.|127\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|2(?:2[4-9]|[345][0-9])\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[4-8]|30|6011|6[45])",
    "phone": r"^(?:\+(?:1|7|2[07]|2[1-6][0-9]|29[0-9]|3[0-469]|3[578][0-9]|4[013-9]|42[0-9]|5[1-8]|5[09][0-9]|6[0-6]|6[789][0-9]|8[1246]|8[58][0-9]|9[0-58]|9[679][0-9])|\(?[2-9])",
    "person": r"(?i)\b(?:james|john|robert|michael|william|david|richard|joseph|thomas|mary|patricia|jennifer|linda|elizabeth|barbara|susan|jessica|sarah|karen|anna|maria|peter|paul|hans|pierre|marie|jean|carlos|juan|jose|luis|ana|sofia|martin|anton|emma|laura)\b",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "iban": r"^(?:AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IT|LT|LU|LV|MT|NL|NO|PL|PT|RO|SE|SI|SK|TR)",
}
#: Words shortly before a span that speak for its kind.
FOR = {
    "email": r"(?i)(?:e-?mail|mailto|contact|write|reach|correo|courriel|kontakt)[^.!?\n]{0,30}$",
    "ip": r"(?i)(?:\bip\b|address|host|server|client|login|dirección|adresse)[^.!?\n]{0,30}$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|debit|payment|tarjeta|carte|karte)[^.!?\n]{0,30}$",
    "phone": r"(?i)(?:phone|\btel\b|tel\.|call|mobile|cell|fax|whatsapp|teléfono|téléphone|telefon|handy)[^.!?\n]{0,30}$",
    "person": r"(?i)(?:dear|by|from|name|signed|regards|patient|customer)[^.!?\n]{0,20}$",
    "ssn": r"(?i)(?:ssn|social|security|tax)[^.!?\n]{0,30}$",
    "iban": r"(?i)(?:iban|account|bank|konto|cuenta|compte)[^.!?\n]{0,30}$",
}
AGAINST = r"(?i)(?:version|\bv\.?|order|invoice|isbn|issn|serial|build|ticket|article|section|release|sku|doi|example|sample|dummy)[^A-Za-z]{0,6}$"
ODD_SHAPE = r"(?i)([0-9])\1{6,}|1234567|0000000|@(?:test|example)\.|noreply|no-reply"
CONTEXT = 48


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True if a string of digits passes the Luhn test."""
    n = F.length(number)
    def add(total, i):
        x = F.substring(number, n - i + 1, F.lit(1)).cast("int")
        twice = x * 2
        return total + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(x)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def stays(kind: str) -> Callable[[Column], Column]:
    """The test a base match has to pass."""
    return lambda c: _stays(kind, c["value"])


def misses(kind: str) -> Callable[[Column], Column]:
    """Near misses: base matches of the right length that fail the test. They vote against themselves, which shows the model false spans."""
    def one(c: Column) -> Column:
        long_enough = F.length(digits(c["value"])).between(13, 19) if kind == "card" else F.lit(True)
        return long_enough & ~_stays(kind, c["value"])
    return one


def _stays(kind: str, value: Column) -> Column:
    if kind == "ip":
        def part(p):
            bare = F.ltrim(p, F.lit("0"))
            return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(value, r"\."), part)
    if kind == "card":
        d = digits(value)
        return F.length(d).between(13, 19) & luhn(d)
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


SPAN = "array<struct<start:long,end:long,value:string,context:string>>"


def spans(text: Column, pattern: str, gate: str) -> Column:
    """All matches: start and end in code points, value and the characters before it. Texts that fail the gate are not searched."""
    rx = F.lit(pattern)
    hits, gaps = F.regexp_extract_all(text, rx, 0), F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value"), F.right(x["gap"], F.lit(CONTEXT)).alias("context"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    pairs = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    return F.when(F.rlike(text, F.lit(gate)), F.aggregate(pairs, zero, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPAN))


def judged(kind: str, strict: int) -> Callable[[Column], Column]:
    """Votes and features of a candidate."""
    def one(c: Column) -> Column:
        value, context = c["value"], c["context"]
        size = F.length(value)
        vote = lambda test, yes, no: F.when(F.coalesce(test, F.lit(False)), F.lit(yes)).otherwise(F.lit(no))
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), c["start"].alias("start"), c["end"].alias("end"),
            F.lit(strict).alias("strict"), vote(F.rlike(value, F.lit(GAZETTEER[kind])), 1, 0 if kind == "person" else -1).alias("gazetteer"),
            vote(F.rlike(context, F.lit(FOR[kind])), 1, 0).alias("for"), vote(F.rlike(context, F.lit(AGAINST)), -1, 0).alias("against"),
            vote(F.rlike(value, F.lit(ODD_SHAPE)), -1, 0).alias("shape"),
            F.floor(F.log2(size)).cast("int").alias("log_size"), F.round(F.length(digits(value)) * 4 / size).cast("int").alias("digit_share"),
            vote(F.rlike(context, F.lit(r"[:=#]\x20?$")), 1, 0).alias("led"))
    return one


def apart(kind: str) -> Callable[[Column], Column]:
    """True for candidates that overlap no base span of the kind."""
    return lambda c: ~F.exists(F.col(kind), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))


def of_kind(i: int) -> Callable[[Column], Column]:
    return lambda c: c["kind"] == i


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, the base spans of each kind, and the judged candidates: base (``sure``) and looser ones (``maybe``)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id", *[spans(F.col("text"), BASE[k], GATE[k]).alias(f"all_{k}") for k in BASE_KINDS],
        *[spans(F.col("text"), rx, gate).alias(f"loose{i}") for i, (_, rx, gate) in enumerate(LOOSE)])
    rows = rows.select("*", *[F.filter(f"all_{k}", stays(k)).alias(k) for k in BASE_KINDS])
    sure = F.concat(*[F.transform(k, judged(k, 1)) for k in BASE_KINDS])
    maybe = [F.transform(F.filter(f"all_{k}", misses(k)), judged(k, -1)) for k in ("ip", "card")]
    for i, (kind, _, _) in enumerate(LOOSE):
        own = F.filter(f"loose{i}", apart(kind)) if kind in BASE_KINDS else F.col(f"loose{i}")
        maybe.append(F.transform(own, judged(kind, 0)))
    return rows.select("doc_id", sure.alias("sure"), F.concat(*maybe).alias("maybe"))


def reliabilities(patterns: list[tuple], rounds: int = 50) -> dict[tuple, float]:
    """Posterior of every (kind, votes) pattern by expectation maximisation over their counts.

    Each labeler has its own odds of voting for, against or not at all on true and on false candidates; each kind its own share of true ones.
    """
    post = {p[:-1]: min(0.95, max(0.05, 0.5 + 0.2 * sum(p[1:-1]))) for p in patterns}
    for _ in range(rounds):
        share = {k: [1.0, 1.0] for k in {p[0] for p in patterns}}
        votes = {(j, v): [1.0 + (v > 0), 1.0 + (v < 0)] for j in range(len(VOTES)) for v in (-1, 0, 1)}
        for *key, n in patterns:
            y = post[tuple(key)]
            for cell in (share[key[0]], *(votes[j, v] for j, v in enumerate(key[1:]))):
                cell[0] += n * y
                cell[1] += n * (1 - y)
        total = [[sum(votes[j, v][y] for v in (-1, 0, 1)) for y in (0, 1)] for j in range(len(VOTES))]
        moved = 0.0
        for *key, _ in patterns:
            yes, no = share[key[0]]
            for j, v in enumerate(key[1:]):
                yes *= votes[j, v][0] / total[j][0]
                no *= votes[j, v][1] / total[j][1]
            new = min(0.99, max(0.01, yes / (yes + no)))
            moved = max(moved, abs(new - post[tuple(key)]))
            post[tuple(key)] = new
        if moved < 1e-6:
            break
    return post


FEATURES = (*VOTES, "log_size", "digit_share", "led", *(f"is_{k}" for k in KINDS))


def features(c) -> dict[str, Column]:
    plain = {f: c[f].cast("double") for f in (*VOTES, "log_size", "digit_share", "led")}
    return plain | {f"is_{k}": (c["kind"] == i).cast("double") for i, k in enumerate(KINDS)}


def train(scanned: DataFrame) -> tuple[list[float], float] | None:
    """Coefficients and intercept of the span classifier; None without candidates."""
    cands = scanned.select(F.explode(F.concat("sure", "maybe")).alias("c")).select("c.*").drop("start", "end")
    cells = staged(cands.groupBy(*cands.columns).agg(F.count("*").alias("n")))
    told = cells.groupBy("kind", *VOTES).agg(F.sum("n").alias("n")).orderBy("kind", *VOTES).collect()
    if not told:
        return None
    post = reliabilities([tuple(r) for r in told])
    told = json.dumps([dict(zip(("kind", *VOTES, "chance"), (*key, p), strict=True)) for key, p in post.items()])
    kinds = "array<struct<" + ",".join(f"`{c}`:int" for c in ("kind", *VOTES)) + ",chance:double>>"
    chances = scanned.sparkSession.range(1).select(F.inline(F.from_json(F.lit(told), kinds)))
    joined = cells.join(F.broadcast(chances), ["kind", *VOTES])
    rows = joined.select("n", "chance", *[x.alias(f) for f, x in features(joined).items()])
    rows = rows.select(*FEATURES, F.inline(F.array(
        F.struct(F.lit(1.0).alias("label"), (F.col("n") * F.col("chance")).alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("chance"))).alias("weight")))))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.coalesce(1).sortWithinPartitions(*FEATURES, "label"))
    model = LogisticRegression(weightCol="weight", regParam=0.001, maxIter=50).fit(rows.select("features", "label", "weight"))
    return [float(x) for x in model.coefficients], float(model.intercept)


def find_pii(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added (looser spans that the classifier accepts)."""
    scanned = staged(scan(docs))
    model = train(scanned)

    def accepted(c: Column) -> Column:
        if model is None:
            return F.lit(False)
        logit = F.lit(model[1])
        for w, x in zip(model[0], features(c).values(), strict=True):
            logit = logit + F.lit(w) * x
        return (c["strict"] == 0) & (1 / (1 + F.exp(-logit)) >= least)

    def told(found: Column) -> Column:
        names = F.array(*map(F.lit, KINDS))
        ordered = F.array_sort(F.transform(found, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))
        return F.array_join(F.transform(ordered, lambda c: F.concat_ws(":", F.element_at(names, c["kind"] + 1), c["start"].cast("string"), c["end"].cast("string"))), ",")

    rows = scanned.withColumn("added", F.filter("maybe", accepted))
    counts = [F.size(F.filter("sure", of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)]
    return rows.select(
        "doc_id", *counts, F.sha2(told(F.col("sure")), 256).alias("base_sha256"), told(F.concat("sure", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def op2_weak_supervision(spark, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
