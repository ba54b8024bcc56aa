"""Personal data and secrets: regular expressions propose, checksums confirm, context adjusts (DataFrame functions only).

A span's score is its kind's prior, raised by a context word shortly before it.  Kinds whose pattern and check alone say little ask for
a least score: a long run of letters and digits is a secret only where a word such as ``token`` or ``password`` stands before it.

Spark has no function that tells where a pattern matches.  Splitting at the pattern gives the text between the
matches, so running sums of the lengths of the pieces and of the matches give the places, in code points.

The patterns are written so that a match attempt never runs twice over the same characters: possessive
repeats, and a start only where a run begins or where the last match ended (elsewhere a run's beginning would have matched
first).  Time is linear in the text, however long its runs are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds in the order in which spans at one place are listed, their patterns and a character without which none matches.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])"
SECRET = r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+={0,2}+"

_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = F.array(*[F.lit(x) for x in _DOUBLED])
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(doubled[d.cast("int")]))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an IBAN passes the mod-97 check."""
    s = F.regexp_replace(account, " ", "")
    moved = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))
    codes = F.transform(F.split(moved, ""), lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(codes, F.lit(0), lambda a, x: F.when(x < 10, (a * 10 + x) % 97).otherwise((a * 100 + x) % 97)) == 1


def _always(_: Column) -> Column:
    return F.lit(True)


def _ip_ok(m: Column) -> Column:
    return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")


def _card_ok(m: Column) -> Column:
    d = _digits(m)
    return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False))


def _phone_ok(m: Column) -> Column:
    return F.length(_digits(m)).between(9, 15)


def _mixed(m: Column) -> Column:
    """Letters and digits, of ten different characters or more: what a drawn key has and a word, a number or a rule of dashes lacks."""
    return m.rlike("[A-Za-z]") & m.rlike("[0-9]") & (F.size(F.array_remove(F.array_distinct(F.split(m, "")), "")) >= 10)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str
    valid: object
    base: bool
    prior: float
    context: str
    least: float = 0.0


#: Context words within CONTEXT characters before a span raise its score by CONTEXT_GAIN.
CONTEXT, CONTEXT_GAIN = 40, 0.3
KINDS = (
    Kind("email", EMAIL, "@", _always, True, 0.7, "(?i)mail|contact|write"),
    Kind("ip", IP, r"[0-9]\.[0-9]", _ip_ok, True, 0.5, r"(?i)\bip\b|address|server|host"),
    Kind("card", CARD, "[0-9][ -]?[0-9]", _card_ok, True, 0.6, "(?i)card|visa|credit|payment"),
    Kind("phone", PHONE, r"\+[0-9]", _phone_ok, True, 0.5, "(?i)phone|tel|call|mobile|fax"),
    Kind("iban", IBAN, "[A-Z]{2}[0-9]{2}", mod97, False, 0.7, "(?i)iban|account|bank"),
    Kind("secret", SECRET, "(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20}", _mixed, False, 0.4, "(?i)token|secret|passw|api.?key|access.?key|private.?key|credential|bearer|auth", 0.6),
)

_EMPTY = "cast(array() as array<struct<start:int,rank:int,kind:string,end:int,found:string,score:double>>)"
#: Matches are placed in blocks of this size, so that a text of n matches costs n * BLOCK steps.
BLOCK = 256


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once: names stand for expressions, lambda variables for values."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0), lambda a, x: a + x)


def _spans(text: Column, rank: int, kind: Kind) -> Column:
    """The valid matches of one kind: array of (start, rank, kind, end, found, score)."""

    def near(start: Column) -> Column:
        return F.substring(text, F.greatest(F.lit(1), start + 1 - CONTEXT), F.least(F.lit(CONTEXT), start))

    def span(m: Column, start: Column) -> Column:
        score = F.lit(kind.prior) + F.when(near(start).rlike(kind.context), CONTEXT_GAIN).otherwise(0.0)
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), (start + F.length(m)).alias("end"), m.alias("found"), score.alias("score"))

    def place(pairs: Column) -> Column:
        """pairs: (match, length of the gap before it). A match begins after the gaps and matches before it and its own gap."""
        widths = F.transform(pairs, lambda p: p["gap"] + F.length(p["m"]))

        def by_block(widths: Column) -> Column:
            blocks = F.sequence(F.lit(0), F.floor((F.size(widths) - 1) / BLOCK).cast("int"))
            sums = F.transform(blocks, lambda b: _sum(F.slice(widths, b * BLOCK + 1, F.lit(BLOCK))))
            before = F.aggregate(sums, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
            numbered = F.transform(pairs, lambda p, i: F.struct(p["m"].alias("m"), p["gap"].alias("gap"), i.alias("i")))

            def start(x: Column, before: Column) -> Column:
                block = F.floor(x["i"] / BLOCK).cast("int")
                return before[block] + _sum(F.slice(widths, block * BLOCK + 1, x["i"] - block * BLOCK)) + x["gap"]

            return _let(before, lambda before: F.transform(F.filter(numbered, lambda x: kind.valid(x["m"])), lambda x: _let(start(x, before), lambda s: span(x["m"], s))))

        return _let(widths, by_block)

    gaps = F.transform(F.split(text, kind.pattern, -1), lambda p: F.length(p))
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), gaps, lambda m, gap: F.struct(m.alias("m"), gap.alias("gap")))
    found = _let(F.filter(pairs, lambda p: p["m"].isNotNull()), lambda pairs: F.when(F.size(pairs) > 0, place(pairs)).otherwise(F.expr(_EMPTY)))
    if kind.least > 0:
        found = F.filter(found, lambda s: s["score"] >= kind.least)
    return F.when(text.rlike(kind.needs), found).otherwise(F.expr(_EMPTY))


def find_pii(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Each row of ``docs`` as the struct ``row``, and ``spans``: its personal data in order of place and kind.

    docs needs text.  A span is (start, rank, kind, end, found, score): code points, the end exclusive; the score is the kind's
    prior, raised by CONTEXT_GAIN by a context word within the CONTEXT characters before it.  Matches of a kind do not overlap; failing ones are
    dropped without another try, and so are those below the least score of their kind (the base kinds have none).

    Null and empty texts have no spans.  Rows that repeat are rows of their own.  An empty table gives an empty table.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.concat(*[_spans(F.col("t"), i, k) for i, k in enumerate(kinds)])
    return docs.select(F.struct("*").alias("row"), text.alias("t")).select("row", F.array_sort(found).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scores(spans: Column) -> Column:
    """The scores of ``spans`` in hundredths, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.round(100 * s["score"]).cast("int").cast("string")), ",")
