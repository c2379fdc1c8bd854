"""Personal data in texts: expressions propose spans, checksums confirm them, nearby words adjust the score.

Spark's functions give the matches of an expression but not where they are. The places
follow from the stretches between matches, which a split by the same expression gives:
both go from left to right over the same matches, so lengths add up to positions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobvigil.llm.arrays import let, running_max, running_sum
from jobvigil.llm.common import with_temporary

#: Code points on each side of a span in which its context words are looked for.
CONTEXT = 40
#: Spans of the kinds that are not always kept need this score.
LEAST_SCORE = 0.5
#: What a word nearby adds.
CONTEXT_SCORE = 0.2


@dataclass(frozen=True)
class Kind:
    """``guard`` is a cheap test every text with a match passes. ``always``: kept whatever the score."""

    name: str
    expression: str
    guard: str
    score: float
    words: str
    always: bool = True


# A run of one class can only match from its first character on, or from where the last match ended, so the
# look-behind keeps a long run from being tried at each place. Possessive groups keep Java from recursing.
#: Fixed: the expressions of the first four kinds.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++", "@", 0.8, "mail|contact|write|schreib|courriel|correo"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", r"[0-9]\.[0-9]", 0.6, "ip|host|server|address|adresse|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9]", 0.7, "card|credit|visa|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.6, "phone|call|tel|mobil|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", 0.7, "iban|account|konto|compte|cuenta", always=False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"-[0-9]{2}-", 0.4, "ssn|social security", always=False),
    Kind("local_phone", r"(?<![0-9+(.-])(?<!\+[0-9]{1,3}\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])", r"[0-9]{3}[.-][0-9]{4}", 0.4, "phone|call|tel|mobil|fax", always=False),
)
BASE_KINDS = tuple(k.name for k in KINDS if k.always)
SPANS = "array<struct<start:bigint,end:bigint,kind:int,score:double>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _mod_97(match: Column) -> Column:
    """The remainder of an account number with its first four characters put last and letters as 10 to 35."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))
    step = lambda rest, c: F.when(c.between("0", "9"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(step(rest, c)))


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return F.rlike(match, F.lit(rf"^{part}\.{part}\.{part}\.{part}$"))
    if kind == "card":
        return let(_digits(match), lambda d: F.length(d).between(12, 19) & F.call_function("luhn_check", d))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return _mod_97(match) == 1
    return F.lit(True)


def _spans_of(text: Column, number: int, kind: Kind) -> Column:
    none = F.array().cast(SPANS)
    expression = F.lit(kind.expression)

    def placed(matches: Column, between: Column) -> Column:
        lengths = F.transform(matches, lambda m, i: (F.length(F.get(between, i)) + F.length(m)).cast("long"))

        def span(ends: Column, m: Column, i: Column) -> Column:
            # the running sum is of what lies before this stretch
            start = F.get(ends, i) + F.length(F.get(between, i))
            near = F.concat_ws(" ", F.right(F.get(between, i), F.lit(CONTEXT)), F.left(F.get(between, i + 1), F.lit(CONTEXT)))
            score = F.lit(kind.score) + F.when(F.lower(near).rlike(rf"\b(?:{kind.words})"), CONTEXT_SCORE).otherwise(0.0)
            return F.struct(
                start.alias("start"), (start + F.length(m)).alias("end"), F.lit(number).alias("kind"),
                F.when(_confirmed(kind.name, m), F.round(score, 3)).alias("score"),
            )

        spans = let(running_sum(lengths), lambda ends: F.transform(matches, lambda m, i: span(ends, m, i)))
        kept = F.filter(spans, lambda s: s["score"].isNotNull() if kind.always else s["score"] >= LEAST_SCORE)
        return kept.cast(SPANS)

    found = let(F.regexp_extract_all(text, expression, 0), lambda matches: F.when(F.size(matches) == 0, none).otherwise(
        let(F.split(text, kind.expression, -1), lambda between: placed(matches, between))))
    guard = F.contains(text, F.lit("@")) if kind.guard == "@" else F.rlike(text, F.lit(kind.guard))
    return F.when(guard, found).otherwise(none)


def find_pii(documents: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """The rows with ``into``: their spans (start, end, kind, score) by start, then kind.

    ``start`` and ``end`` count code points of the whole text, the end exclusive;
    ``kind`` is the place in ``KINDS``. Spans of one kind never overlap, those of two
    may. A null or empty text has none. Repeated rows are searched each, an empty table
    gives an empty one, a column named ``into`` is replaced.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return documents.withColumn(into, F.array_sort(F.concat(*(_spans_of(whole, i, k) for i, k in enumerate(KINDS)))))


def redact_pii(documents: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns, each span in ``text`` replaced by its kind in brackets; of overlapping spans the first names it.

    A text without spans, null ones too, stays as it is.
    """
    spans = with_temporary(documents, "spans")
    found = find_pii(documents, text, spans)
    whole, names = F.col(f"`{text}`"), F.array(*(F.lit(f"[{k.name.upper()}]") for k in KINDS))
    cut = lambda a, b: F.substring(whole, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    masked = let(F.col(f"`{spans}`"), lambda s: let(running_max(F.transform(s, lambda x: x["end"])), lambda done: F.concat(
        F.array_join(F.transform(s, lambda x, i: F.concat(
            cut(F.get(done, i), x["start"]), F.when(x["start"] >= F.get(done, i), F.get(names, x["kind"])).otherwise(F.lit("")))), ""),
        F.substr(whole, (F.array_max(F.transform(s, lambda x: x["end"])) + 1).cast("int")),
    )))
    return found.withColumn(text, F.when(F.size(f"`{spans}`") > 0, masked).otherwise(whole)).drop(spans)


def written(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the spans, comma-joined; ``kinds``: only those."""
    names = F.array(*(F.lit(k.name) for k in KINDS))
    some = spans if kinds is None else F.filter(spans, lambda s: F.get(names, s["kind"]).isin(*kinds))
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
