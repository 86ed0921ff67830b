r"""Personal data in texts, with DataFrame functions only: patterns propose, checksums confirm, words decide.

Every kind has a pattern whose matches (leftmost, not overlapping) are its proposals, a validator
that drops some of them (digit counts, Luhn, mod-97, number ranges, no letter or digit beside the
span), a prior score, and words that raise (``near``) or lower (``far``) the score by 0.3 if they
stand beside the span: in the 48 characters on each side, as far as they lie between the span and
the neighbouring proposals of its kind. A span counts if its score reaches 0.5; the spans of the
base kinds (email, ip, card, phone) always count, their score is information.

Base kinds: ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+``; ``[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)``
with parts of at most 255; ``[0-9]([\x20-]?[0-9])+`` with 16 to 19 digits and Luhn's checksum;
``\+[0-9][\x20().0-9-]+[0-9]`` with 8 to 15 digits. The patterns below match the same spans, but
begin only where a run of their characters begins and never step back into one, so that a long run
costs time in proportion to its length and no stack. Further kinds: iban (mod-97), short_card (13
to 15 digits, Luhn, card words), local_phone (7 to 12 digits, telephone words), national_id (three,
two and four digits, identity words).

Places come from the lengths of matches and of the texts between them, summed up in chunks, so a
text with many spans costs time in proportion to their number.

Edge cases: null, empty and blank texts have no spans; rows that repeat an id are treated one by
one; a null id stays null; an empty table gives an empty result; other columns are ignored,
whatever their names. Places are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BESIDE = 48  # characters on each side in which context words count
LEAST_SCORE, STEP = 0.5, 0.3
CHUNK = 256  # proposals whose places are summed up together

SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double,text:string>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _code(x: Column, place: Column) -> Column:
    return F.ascii(F.substring(x, place, F.lit(1)))


def _places(x: Column) -> Column:
    return F.sequence(F.lit(1), F.length(x))


def luhn(digits: Column) -> Column:
    """Does a string of digits (not empty) pass Luhn's checksum?"""
    def doubled(i: Column) -> Column:
        twice = 2 * (_code(digits, i) - 48)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(_places(digits), F.lit(0), lambda acc, i: acc + F.when(
        (F.length(digits) - i) % 2 == 1, doubled(i)).otherwise(_code(digits, i) - 48))
    return total % 10 == 0


def mod97(code: Column) -> Column:
    """Is the number that capital letters and digits spell, its first four moved to the end, 1 modulo 97?"""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        c = _code(turned, i)
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)

    return F.aggregate(_places(turned), F.lit(0), step) == 1


def _parts_at_most_255(x: Column) -> Column:
    def fits(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(x, r"\."), fits)


def _stands_alone(p: Column, beside: str = "A-Za-z0-9") -> Column:
    return ~F.rlike(p["before"], F.lit(rf"[{beside}]\z")) & ~F.rlike(p["after"], F.lit(rf"^[{beside}]"))


def _card(least: int, most: int) -> str:
    """Runs of digits, single spaces or hyphens between them, with so many digits."""
    return rf"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){{{least - 1},{most - 1}}}+(?![\x20-]?[0-9])"


_TELEPHONE = ("call", "fax", "mobile", "phone", "tel", "telephone", "handy", "telefon", "rufnummer",
              "teléfono", "telefono", "móvil", "téléphone", "portable")
_CARD = ("amex", "card", "credit", "debit", "visa", "karte", "kreditkarte", "tarjeta", "carte")
_IDENTITY = ("identity", "social", "security", "ssn", "ausweis", "sozialversicherung", "identidad", "identité")


@dataclass(frozen=True)
class Kind:
    """``hint``: a string that every text with a proposal contains."""

    name: str
    pattern: str
    holds: Callable[[Column], Column]
    prior: float
    near: tuple[str, ...] = ()
    far: tuple[str, ...] = ()
    hint: str = ""
    base: bool = False


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda p: F.lit(True), 0.9, ("email", "mail", "contact", "kontakt", "correo", "courriel"), (), "@", True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         lambda p: _parts_at_most_255(p["text"]), 0.6, ("address", "host", "ip", "server"), ("release", "section", "version"), ".", True),
    Kind("card", _card(16, 19), lambda p: luhn(_digits(p["text"])), 0.7, _CARD, ("isbn", "order", "sku"), "", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]",
         lambda p: F.length(_digits(p["text"])).between(8, 15), 0.6, _TELEPHONE, (), "+", True),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
         lambda p: F.length(F.replace(p["text"], F.lit(" "), F.lit(""))).between(15, 34) & _stands_alone(p)
         & mod97(F.replace(p["text"], F.lit(" "), F.lit(""))), 0.6, ("account", "bank", "iban", "konto", "cuenta", "compte"), ("sku",)),
    Kind("short_card", _card(13, 15), lambda p: luhn(_digits(p["text"])) & _stands_alone(p, "A-Za-z0-9+."),
         0.3, _CARD, ("isbn", "order", "sku")),
    Kind("local_phone", r"[0-9(][0-9()\x20/-]{5,17}[0-9]",
         lambda p: F.length(_digits(p["text"])).between(7, 12) & _stands_alone(p, "A-Za-z0-9+.()/-"),
         0.3, _TELEPHONE, ("isbn", "order", "sku")),
    Kind("national_id", r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
         lambda p: ~F.rlike(p["text"], F.lit("^(000|666|9)|-00-|0000")) & _stands_alone(p, "A-Za-z0-9+.-"),
         0.3, _IDENTITY, ("order", "sku")),
)
BASE = tuple(k.name for k in KINDS if k.base)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _proposals(text: Column, pattern: str) -> Column:
    """All matches: ``text, start, end`` and the characters ``before`` and ``after`` them."""
    def chunks(pieces: Column) -> Column:
        def part(c: Column) -> Column:
            return F.slice(pieces, c * CHUNK + 1, F.lit(CHUNK))

        def placed(c: Column, totals: Column) -> Column:
            begin = F.aggregate(F.slice(totals, F.lit(1), c), F.lit(0).cast("bigint"), lambda acc, x: acc + x)
            none = F.expr("cast(array() as array<struct<text:string,start:bigint,end:bigint,before:string,after:string>>)")

            def step(acc: Column, p: Column) -> Column:
                start = acc["at"] + p["gap"]
                end = start + p["size"]
                return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(
                    p["text"].alias("text"), start.alias("start"), end.alias("end"), p["before"].alias("before"),
                    p["after"].alias("after")))).alias("out"))

            return F.aggregate(part(c), F.struct(begin.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

        numbers = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / CHUNK).cast("int"))
        totals = F.transform(numbers, lambda c: F.aggregate(
            part(c), F.lit(0).cast("bigint"), lambda acc, p: acc + p["gap"] + p["size"]))
        return _let(totals, lambda sums: F.flatten(F.transform(numbers, lambda c: placed(c, sums))))

    def with_gaps(hits: Column) -> Column:
        def pieces(gaps: Column) -> Column:
            first = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(
                h.alias("text"), F.length(h).cast("bigint").alias("size"), F.length(g).cast("bigint").alias("gap"),
                F.right(g, F.lit(BESIDE)).alias("before")))
            return F.zip_with(first, F.slice(gaps, F.lit(2), F.size(hits)), lambda p, g: F.struct(
                p["text"].alias("text"), p["size"].alias("size"), p["gap"].alias("gap"), p["before"].alias("before"),
                F.left(g, F.lit(BESIDE)).alias("after")))

        return F.when(F.size(hits) > 0, _let(F.split(text, pattern, -1), lambda gaps: _let(pieces(gaps), chunks)))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), with_gaps)


_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _says(p: Column, words: tuple[str, ...]) -> Column:
    if not words:
        return F.lit(False)
    any_of = F.lit(rf"(^|[^a-z])({'|'.join(words)})([^a-z]|\z)")
    return (F.rlike(F.translate(p["before"], _CAPITALS, _SMALL), any_of)
            | F.rlike(F.translate(p["after"], _CAPITALS, _SMALL), any_of))


def _spans(text: Column, kind: Kind) -> Column:
    def scored(p: Column) -> Column:
        score = (F.lit(kind.prior) + F.when(_says(p, kind.near), STEP).otherwise(0.0)
                 - F.when(_says(p, kind.far), STEP).otherwise(0.0))
        return F.struct(F.lit(kind.name).alias("kind"), p["start"].alias("start"), p["end"].alias("end"),
                        F.least(F.round(score, 3), F.lit(1.0)).alias("score"), p["text"].alias("text"))

    found = F.transform(F.filter(_proposals(text, kind.pattern), kind.holds), scored)
    if not kind.base:
        found = F.filter(found, lambda s: s["score"] >= LEAST_SCORE)
    found = F.coalesce(found, F.expr(f"cast(array() as {SPANS})")).cast(SPANS)
    return F.when(F.contains(text, F.lit(kind.hint)), found).otherwise(F.expr(f"cast(array() as {SPANS})")) if kind.hint else found


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Per row ``id_col`` and ``spans`` (kind, start, end, score, text), by kind as listed, then start."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col), F.concat(*[_spans(text, k) for k in kinds]).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as one string."""
    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        *[c for c in found.columns if c != "spans"], *[count(k) for k in BASE],
        F.sha2(F.encode(listed(F.filter("spans", lambda s: s["kind"].isin(*BASE))), "UTF-8"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"))
