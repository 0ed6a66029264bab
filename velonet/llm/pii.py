"""Operator 3, personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Native: every step is a DataFrame expression; there is no Python on the executors and no shuffle. Matches are found
twice by the JVM's engine, as the matches and as the pieces between them, so that running lengths give the offsets in
code points. Repetitions are possessive and starts are anchored to the beginning of a run (or the end of the previous
match), which changes no match and keeps long runs linear.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Spans are gathered in blocks of this many matches, so that long texts do not copy ever longer arrays.
STEP = 256
#: Code points before a span in which context words count.
CONTEXT = 48
SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


@dataclass(frozen=True)
class Kind:
    """One kind of span: ``needs`` is a literal the text must contain (a cheap test), ``valid`` confirms a match."""

    name: str
    pattern: str
    needs: str
    valid: Callable[[Column], Column]
    score: float
    context: str
    tag: str


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Checksum of a string of digits: every second digit from the right counts twice, less 9 above 9."""
    n = F.length(number)
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        F.lit(0),
        lambda acc, i: acc + F.when((n - i) % 2 == 1, F.ascii(F.substring(number, i, F.lit(1))) * 2 - 96 - F.when(F.ascii(F.substring(number, i, F.lit(1))) > 52, 9).otherwise(0)).otherwise(F.ascii(F.substring(number, i, F.lit(1))) - 48),
    )
    return (n > 0) & (total % 10 == 0)


def mod97(code: Column) -> Column:
    """ISO 7064 check of an account number: first four characters last, letters as 10 to 35, remainder 1."""
    plain = F.regexp_replace(code, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _octets(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _card(m: Column) -> Column:
    return F.length(digits(m)).between(13, 19) & luhn(digits(m))


LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Kinds that are reported whatever their context.
BASE = (
    Kind("email", rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++", "@", lambda m: F.lit(True), 0.9, "mail|contact|courriel|correo|kontakt", "[EMAIL]"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", _octets, 0.7, r"\bip\b|server|host|address|login|adresse", "[IP]"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){12,}+", "", _card, 0.8, "card|visa|credit|debit|pay|karte|carte|tarjeta", "[CARD]"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", lambda m: F.length(digits(m)).between(9, 15), 0.7, r"\btel|phone|call|mobile|fax|whatsapp|telefon", "[PHONE]"),
)
#: Kinds that the method adds: a checksum confirms an account number; the other two need a context word.
ADDED = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", "", mod97, 0.8, "iban|bank|account|konto|compte|cuenta", "[IBAN]"),
    Kind("local_phone", r"(?<![+0-9.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9.-])", "", lambda m: F.lit(True), 0.3, r"\btel|phone|call|mobile|fax|whatsapp|telefon", "[PHONE]"),
    Kind("national_id", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "-", lambda m: F.lit(True), 0.3, r"\bssn\b|social|security|passport|identity", "[ID]"),
)
CONTEXT_GAIN, ACCEPT = 0.3, 0.5


#: Code points in a block of text, from which the pieces between tags are taken.
CUT = 4096


def find(found: Column, between: Column, kind: Kind) -> Column:
    """Confirmed spans of one kind in order: array of (kind, start, end, score), offsets in code points, end exclusive.

    ``found`` and ``between`` hold the matches and the pieces between them; null without a match. The context of a match
    is the end of what was passed so far, so a text is gone through once, however many matches it has.
    """
    none = F.array().cast(SPAN)
    acc_type = f"struct<at:int,tail:string,out:{SPAN}>"
    last = lambda c: F.substring(c, -CONTEXT, CONTEXT)

    def one(acc: Column, i: Column) -> Column:
        m, piece = F.element_at(found, i), F.element_at(between, i)
        start = acc["at"] + F.length(piece)
        end = start + F.length(m)
        ahead = last(F.concat(acc["tail"], last(piece)))
        score = F.lit(kind.score) + F.when(F.lower(ahead).rlike(kind.context), CONTEXT_GAIN).otherwise(0.0)
        span = F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), F.least(score, F.lit(1.0)).alias("score"))
        keep = kind.valid(m) if kind in BASE else kind.valid(m) & (score >= ACCEPT)
        tail = last(F.concat(ahead, last(m)))
        return F.struct(end.alias("at"), tail.alias("tail"), F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out")).cast(acc_type)

    def block(acc: Column, b: Column) -> Column:
        first = b * STEP + 1
        inner = F.aggregate(F.sequence(first, F.least(first + STEP - 1, F.size(found))), F.struct(acc["at"].alias("at"), acc["tail"].alias("tail"), none.alias("out")).cast(acc_type), one)
        # the inner result is used twice: bind it with a one-element transform
        return F.element_at(F.transform(F.array(inner), lambda r: F.struct(r["at"].alias("at"), r["tail"].alias("tail"), F.concat(acc["out"], F.array(r["out"])).alias("out"))), 1)

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast(f"array<{SPAN}>").alias("out"))
    blocks = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / STEP).cast("int")), start, block)
    return F.when(F.coalesce(F.size(found), F.lit(0)) > 0, F.flatten(blocks["out"])).otherwise(none)


def detect(docs: DataFrame, kinds: tuple[Kind, ...] = BASE + ADDED) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with one more column for each kind, its spans in each text (null: empty), and the names of these columns.

    Rows and other columns stay; the new columns' names are none of theirs.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    name = {(x, k.name): common.fresh(f"_{x}_{k.name}", docs.columns) for k in kinds for x in "mps"}
    out = docs
    for kind in kinds:
        found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
        out = out.withColumn(name["m", kind.name], F.when(text.contains(kind.needs), found) if kind.needs else found)
    for kind in kinds:
        out = out.withColumn(name["p", kind.name], F.when(F.size(name["m", kind.name]) > 0, F.split(text, kind.pattern, -1)))
    for kind in kinds:
        out = out.withColumn(name["s", kind.name], find(F.col(name["m", kind.name]), F.col(name["p", kind.name]), kind))
    return out.drop(*[name[x, k.name] for k in kinds for x in "mp"]), {k.name: name["s", k.name] for k in kinds}


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scored), one for each row of ``docs``.

    Null and empty texts have no spans; repeated rows and null ids are reported like others; an empty table gives no
    rows; further columns are ignored.
    """
    seen, name = detect(docs.select("doc_id", "text"))
    base = F.concat(*[F.col(name[k.name]) for k in BASE])
    every = F.concat(*[F.col(name[k.name]) for k in BASE + ADDED])
    return seen.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.size(name[k.name]).cast("long").alias(f"n_{k.name}") for k in BASE],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(every).alias("spans"),
        F.transform(every, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["score"].alias("score"))).alias("scored"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind's tag; overlapping spans become one tag, the first's.

    Null texts stay null, empty ones empty; repeated rows and null ids are treated like others; an empty table stays
    empty; other columns stay, but ``n_chars``, where there is one, follows the new text.
    """
    names = docs.columns
    kinds = BASE + ADDED
    found, name = detect(docs, kinds)
    spans, cut = common.fresh("_spans", found.columns), common.fresh("_cut", found.columns)
    tags = F.create_map(*[x for k in kinds for x in (F.lit(k.name), F.lit(k.tag))])
    ordered = F.array_sort(
        F.flatten(F.array(*[F.transform(F.col(name[k.name]), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["kind"].alias("kind"))) for k in kinds]))
    )
    text = F.col("text")

    def between(a: Column, b: Column) -> Column:
        """The text from a to b, taken from the blocks that hold it."""
        k = F.floor(a / CUT).cast("int")
        return F.substring(F.array_join(F.slice(cut, k + 1, F.floor(b / CUT).cast("int") - k + 1), ""), a - k * CUT + 1, b - a)

    def put(acc: Column, s: Column) -> Column:
        start, end = s["start"], -s["less"]
        return F.when(start >= acc["at"], F.struct(end.alias("at"), F.concat(acc["out"], F.array(between(acc["at"], start), tags[s["kind"]])).alias("out"))).otherwise(
            F.struct(F.greatest(end, acc["at"]).alias("at"), acc["out"].alias("out"))
        )

    acc_type = "struct<at:int,done:array<array<string>>,out:array<string>>"
    some = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def block(acc: Column, b: Column) -> Column:
        inner = F.aggregate(F.slice(spans, b * STEP + 1, STEP), F.struct(acc["at"].alias("at"), some["out"].alias("out")), put)
        return F.element_at(F.transform(F.array(inner), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["done"], F.array(r["out"])).alias("done"), acc["out"].alias("out")).cast(acc_type)), 1)

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("out")).cast(acc_type)
    joined = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / STEP).cast("int")), begin, block)
    rest = F.element_at(F.transform(F.array(joined), lambda r: F.concat(F.array_join(F.flatten(r["done"]), ""), between(r["at"], F.length(text)))), 1)
    out = found.withColumn(spans, ordered)
    out = out.withColumn(cut, F.when(F.size(spans) > 0, F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CUT), F.lit(0))))
    out = out.withColumn("text", F.when(F.size(spans) > 0, rest).otherwise(text))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*names)
