"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score.

Everything is SQL functions on the column.  Base kinds (email, ip, card, phone) are kept
whenever their own check holds; the further kinds (iban, national_id, local_phone) need a
checksum or the words around them to reach ACCEPT, and never overlap a base span.

Patterns are written so that a failing start is not tried again from inside the same run
of characters: a lookbehind ties a match to the start of its run (or to the end of the
previous match), which leaves the leftmost matches unchanged and the time linear.

Defined results: null texts have no spans and stay null when masked; empty texts have no
spans; rows are judged one by one, so repeated rows get equal spans and no row is lost;
other columns pass through, except that ``name`` replaces one of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, table, unused
from .registry import query

#: What the base kinds match, leftmost and without overlap.
EMAIL = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){12}(?:[\x20-]?[0-9])*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)"
        r"(?![A-Za-z0-9])")
NATIONAL_ID = r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])"
LOCAL_PHONE = r"(?<![A-Za-z0-9+().-])\(?[0-9]{2,4}\)?[\x20./-]?[0-9]{3,4}[\x20./-][0-9]{3,4}(?![A-Za-z0-9-])"

#: Words that make a kind likelier or less likely when they stand shortly before it.
FOR = {
    "email": "mail|e-mail|email|contact|write|kontakt|correo|courriel",
    "ip": "ip|host|server|address|login|client",
    "card": "card|visa|mastercard|credit|debit|karte|carte|tarjeta|payment|pay",
    "phone": "phone|tel|call|mobile|cell|fax|telefon|handy|llame|appel",
    "iban": "iban|account|bank|konto|compte|cuenta|transfer",
    "national_id": "ssn|social security|tax id|national id|insurance",
    "local_phone": "phone|tel|call|mobile|cell|fax|telefon|handy|llame|appel",
}
AGAINST = "version|order|invoice|isbn|serial|part|section|figure|page|port"
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "national_id": 0.4, "local_phone": 0.4}
BASE, ADDED = ["email", "ip", "card", "phone"], ["iban", "national_id", "local_phone"]
STEP, ACCEPT, REACH = 0.2, 0.6, 40

_SPAN = "struct<kind:string,start:int,end:int,score:double>"


def _luhn(digits: Column) -> Column:
    """Luhn sum divisible by ten."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda acc, i: acc + F.when((n - i) % 2 == 0, _digit(digits, i)).otherwise(
            2 * _digit(digits, i) - F.when(_digit(digits, i) > 4, 9).otherwise(0)))
    return total % 10 == 0


def _digit(digits: Column, i: Column) -> Column:
    return F.ascii(F.substring(digits, i, F.lit(1))) - 48


def _mod97(iban: Column) -> Column:
    """Remainder 1 after the first four characters move to the end and letters count 10 to 35."""
    plain = F.regexp_replace(iban, r"\x20", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4)))
    code = lambda i: F.ascii(F.substring(turned, i, F.lit(1)))
    rest = F.aggregate(
        F.sequence(F.lit(1), F.length(turned)), F.lit(0),
        lambda acc, i: F.when(code(i) < 58, acc * 10 + code(i) - 48).otherwise(acc * 100 + code(i) - 55) % 97)
    return (rest == 1) & F.length(plain).between(15, 34)


def _n_digits(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]", ""))


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        digits = F.regexp_replace(m, r"[\x20-]", "")
        return F.length(digits).between(13, 19) & _luhn(digits)
    if kind == "phone":
        return _n_digits(m).between(9, 15)
    if kind == "iban":
        return _mod97(m)
    if kind == "national_id":
        return ~m.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "local_phone":
        return _n_digits(m).between(9, 12)
    return F.lit(True)


def _located(text: Column, pattern: str) -> Column:
    """Matches with their code-point ranges: the lengths of what lies between and of the matches add up."""
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(F.slice(between, 1, F.size(found)), found,
                       lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"),
                     F.expr("cast(array() as array<struct<start:int,end:int,m:string>>)").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        low = acc["at"] + x["gap"]
        high = low + F.length(x["m"])
        return F.struct(high.alias("at"), F.concat(acc["out"], F.array(F.struct(
            low.alias("start"), high.alias("end"), x["m"].alias("m")))).alias("out"))

    return F.aggregate(steps, start, add, lambda acc: acc["out"])


def _scored(kind: str, text: Column, found: Column) -> Column:
    """Confirmed matches as spans with their score."""
    def span(x: Column) -> Column:
        low = F.greatest(x["start"] - REACH, F.lit(0))
        before = F.translate(F.substring(text, low + 1, x["start"] - low), UPPER, LOWER)
        near = lambda words: before.rlike(rf"(?<![a-z])(?:{words})(?![a-z])").cast("double")
        score = F.least(F.lit(1.0), PRIOR[kind] + STEP * near(FOR[kind]) - STEP * near(AGAINST))
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
                        F.round(score, 3).alias("score"))

    return F.transform(F.filter(found, lambda x: _valid(kind, x["m"])), span)


PATTERN = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN,
           "national_id": NATIONAL_ID, "local_phone": LOCAL_PHONE}
#: A cheap test that every match of the kind passes; most texts are done with it.
NEEDS = {"email": lambda t: t.contains("@"), "phone": lambda t: t.rlike(r"\+[0-9]"),
         "iban": lambda t: t.rlike("[A-Z]{2}[0-9]{2}")}


def with_spans(docs: DataFrame, text: str = "text", name: str = "pii") -> DataFrame:
    """``docs`` with ``name``: array of (kind, start, end, score), by kind as listed, then start.

    Starts and ends are code points, the end exclusive.
    """
    t = F.col(f"`{text}`")
    empty = F.expr(f"cast(array() as array<{_SPAN}>)")
    kinds = [*BASE, *ADDED]
    own = unused(docs)
    hit, good, base = (lambda k: f"{own}hit_{k}"), (lambda k: f"{own}{k}"), f"{own}base"
    # Separate projections keep every pattern search from being repeated where it is used twice.
    out = docs.withColumns({hit(k): F.when(NEEDS.get(k, lambda c: c.rlike("[0-9]"))(t), _located(t, PATTERN[k]))
                            for k in kinds})
    out = out.withColumns({good(k): F.coalesce(
        F.when(F.size(hit(k)) > 0, _scored(k, t, F.col(hit(k)))), empty) for k in kinds})
    out = out.withColumn(base, F.concat(*(F.col(good(k)) for k in BASE)))
    apart = lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    more = [F.filter(good(k), lambda x: (x["score"] >= ACCEPT) & apart(x)) for k in ADDED]
    return (out.withColumn(name, F.concat(base, *more))
            .drop(base, *(hit(k) for k in kinds), *(good(k) for k in kinds)))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first names it."""
    order = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"])
                         .otherwise(b["end"] - a["end"]))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        piece = F.substring(text, acc["at"] + 1, x["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(
            x["start"] >= acc["at"], F.concat(acc["out"], F.array(piece, F.concat(F.lit("["), x["kind"], F.lit("]")))))
            .otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(order, start, add, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(
        text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` masked; columns stay as they are."""
    names, spans = docs.columns, unused(docs) + "pii"
    return (with_spans(docs, text, spans).withColumn(text, masked(F.col(f"`{text}`"), F.col(spans)))
            .select(*(F.col(f"`{c}`") for c in names)))


def listed(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


@query()
def op6_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda k: F.filter("pii", lambda x: x["kind"] == k)
    base = F.filter("pii", lambda x: x["kind"].isin(BASE))
    return found.select(
        "doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(F.encode(listed(base), "UTF-8"), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda x: x["score"].cast("string")), ",").alias("scores"))
