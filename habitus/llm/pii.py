"""Personal data: patterns propose spans, checksums confirm them, context words score them.

Four base kinds follow fixed patterns, leftmost and without overlap within a kind: email, ip
(parts up to 255), card (13 to 19 digits that pass Luhn), phone (9 to 15 digits). The method adds
iban (letters and digits that pass mod-97). Every confirmed span has a score: the prior of its
kind, plus ``CONTEXT_BONUS`` if a context word of the kind is among the ``CONTEXT_CHARS``
characters before it. Scores rank spans for review; a confirmed span is never dropped for one.

Native: a text is split at its matches, so that the lengths of the pieces give the places of the
matches in code points. The patterns are written so that a scan is linear in the text and never
recurses over it: runs are taken whole, and numbers of the wrong length are skipped as runs.

Cases: a null text is empty and has no spans; each row is looked at by itself, so that repeated
rows and null ids change nothing; an empty table gives no rows; other columns are not looked at
by ``find`` and kept by ``masked``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitus.llm.store import empty_text

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban")

# Linear forms of the patterns: a match begins where a run begins, or where the last one ended.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9_])",
}
#: A text without such a sign has no match.
_NEEDS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+", "iban": "[0-9]"}

PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.1
# Words that announce a kind, in the languages of the corpus.
CONTEXT = {
    "email": "mail|e-mail|contact|contacto|kontakt|write to",
    "ip": "ip|address|host|server|adresse|login",
    "card": "card|credit|visa|mastercard|amex|karte|carte|tarjeta|payment",
    "phone": "phone|call|tel|mobile|fax|telefon|teléfono|téléphone",
    "iban": "iban|account|bank|konto|compte|cuenta",
}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    signs = F.reverse(F.split(number, "(?<=.)(?=.)"))
    def weighed(d: Column, i: Column) -> Column:
        twice = d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(twice > 9, twice - 9).otherwise(twice)
    return F.aggregate(F.transform(signs, weighed), F.lit(0), lambda s, d: s + d) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether letters and digits, the first four moved to the end, leave 1 by 97 (letters from 10)."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)
    return F.aggregate(F.split(moved, "(?<=.)(?=.)"), F.lit(0), step) == 1


def _part_fits(part: Column) -> Column:
    plain = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(plain) <= 3) & (F.lpad(plain, 3, "0") <= "255")


def _confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, "\\."), _part_fits)
    if kind == "card":
        return luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        return F.length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34) & mod97(value)
    return F.lit(True)


def _spans(kind: str) -> Column:
    """Confirmed spans of a kind in ``text``: array of (start, end, value, context)."""
    pattern = F.lit(PATTERNS[kind])
    text = F.col("text")
    values = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, PATTERNS[kind], -1)
    none = F.expr("array()").cast("array<struct<start:int,end:int,value:string,context:string>>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def place(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["0"])
        end = start + F.coalesce(F.length(pair["1"]), F.lit(0))
        before = F.lower(F.right(pair["0"], F.lit(CONTEXT_CHARS)))
        span = F.struct(start.alias("start"), end.alias("end"), pair["1"].alias("value"), before.alias("context"))
        kept = F.when(
            pair["1"].isNotNull(), F.concat(state["spans"], F.array(span))
        ).otherwise(state["spans"])
        return F.struct(end.alias("at"), kept.alias("spans"))

    placed = F.aggregate(F.arrays_zip(between, values), zero, place, lambda s: s["spans"])
    return F.filter(placed, lambda s: _confirmed(kind, s["value"]))


def _score(kind: str, span: Column) -> Column:
    announced = span["context"].rlike(rf"(?<![a-z])(?:{CONTEXT[kind]})(?![a-z])")
    return F.round(F.lit(PRIOR[kind]) + F.when(announced, CONTEXT_BONUS).otherwise(0.0), 2)


_NONE = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"


def _found(kind: str) -> Column:
    spans = F.transform(
        _spans(kind),
        lambda s: F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            s["value"].alias("value"), _score(kind, s).alias("score"),
        ),
    )
    text = F.col("text")
    there = text.rlike(_NEEDS[kind]) & text.rlike(PATTERNS[kind])
    return F.when(there, spans).otherwise(F.expr("array()").cast(_NONE))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): all confirmed spans of each row by kind, then start.

    A span has kind, start, end (code points, end exclusive), value and score.
    """
    each = docs.select("doc_id", empty_text()).select("doc_id", *[_found(k).alias(k) for k in KINDS])
    return each.select("doc_id", F.concat(*KINDS).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of ``find``: counts, hash of the base spans, all spans and their scores."""
    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    spans = F.col("spans")
    of_kind = lambda kind: F.filter(spans, lambda s: s["kind"] == kind)
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *[F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
        F.array_join(F.transform(spans, lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with each confirmed span of the text replaced by its kind in brackets.

    Where spans of several kinds overlap, the one that begins first holds, then the longer one,
    then the earlier kind. Texts without spans, nulls included, stay as they are. ``n_chars``, if
    there is such a column with a value, tells the new length.
    """
    text = F.col("text")
    ranked = [
        F.transform(
            _found(kind),
            lambda s, k=k: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(k).alias("rank"), s["kind"].alias("kind")),
        )
        for k, kind in enumerate(KINDS)
    ]
    none = F.expr("array()").cast("array<string>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("parts"))

    def step(state: Column, s: Column) -> Column:
        piece = F.substr(text, state["at"] + 1, s["start"] - state["at"])
        sign = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(
            s["start"] >= state["at"],
            F.struct((-s["back"]).alias("at"), F.concat(state["parts"], F.array(piece, sign)).alias("parts")),
        ).otherwise(state)

    def done(state: Column) -> Column:
        return F.concat(F.array_join(state["parts"], ""), F.substr(text, state["at"] + 1))

    any_sign = text.rlike("[0-9@]")
    new = F.when(any_sign, F.aggregate(F.array_sort(F.concat(*ranked)), zero, step, done)).otherwise(text)
    out = docs.withColumn("text", new)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull() & F.col("text").isNotNull(), length).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
