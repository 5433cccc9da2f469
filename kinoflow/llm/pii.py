"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinoflow.llm.common import let


def zero() -> Column:
    return F.lit(0).cast("long")


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(number), ""), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    total = F.aggregate(
        F.transform(each, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)),
        F.lit(0),
        lambda a, d: a + d,
    )
    return total % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number such as an IBAN (letters and digits, no blanks) leaves 1 when divided by 97."""
    turned = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))
    value = lambda c: F.ascii(c) - F.when(c < "A", 48).otherwise(55)
    left = F.aggregate(
        F.filter(F.split(turned, ""), lambda c: c != ""),
        F.lit(0),
        lambda a, c: F.when(c < "A", a * 10 + value(c)).otherwise(a * 100 + value(c)) % 97,
    )
    return left == 1


def routing(number: Column) -> Column:
    """Whether nine digits pass the check of bank routing numbers (weights 3, 7, 1)."""
    each = F.transform(F.split(digits(number), ""), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    weighted = F.transform(each, lambda d, i: d * F.when(i % 3 == 0, 3).when(i % 3 == 1, 7).otherwise(1))
    return F.aggregate(weighted, F.lit(0), lambda a, d: a + d) % 10 == 0


def dni(code: Column) -> Column:
    """Whether the letter of a Spanish identity number is that of its digits modulo 23."""
    letter = F.substr(F.lit("TRWAGMYFPDXBNJZSQVHLCKE"), (digits(code).try_cast("int") % 23) + 1, F.lit(1))
    return F.upper(F.substr(code, F.length(code), F.lit(1))) == letter


def nir(code: Column) -> Column:
    """Whether the two key digits of a French insurance number are 97 less the rest modulo 97."""
    number = digits(code)
    return 97 - F.substr(number, F.lit(1), F.lit(13)).try_cast("long") % 97 == F.substr(number, F.lit(14)).try_cast("long")


def mixed(token: Column) -> Column:
    """Whether a token has at least ten different characters, digits and letters among them."""
    signs = F.size(F.array_distinct(F.split(token, "")))
    return F.regexp_like(token, F.lit("[0-9]")) & F.regexp_like(token, F.lit("[A-Za-z]")) & (signs >= 10)


@dataclass(frozen=True)
class Kind:
    """``pattern`` must match what its base pattern matches; possessive parts and look-behinds only keep it linear.

    A span's score is ``score``, plus ``up`` if one of the words ``raises`` is near, less ``down`` if one of ``lowers`` is.
    """

    name: str
    pattern: str
    needs: str  # a character without which nothing can match, or "" for none
    valid: object
    score: float
    raises: str
    lowers: str
    up: float = 0.1
    down: float = 0.2
    base: bool = True


def _always(match: Column) -> Column:
    return F.lit(True)


_LOCAL = "[A-Za-z0-9._%+-]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"

#: The length of an account number by country.
IBAN_LENGTHS = """
AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27
GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27
MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23
TN24 TR26 UA29 VA22 VG24 XK20
""".split()


def _iban_pattern() -> str:
    """Exactly as many letters and digits as the country has, so a word that follows after a blank stays outside."""
    by_length: dict[int, list[str]] = {}
    for x in IBAN_LENGTHS:
        by_length.setdefault(int(x[2:]), []).append(x[:2])
    parts = [rf"(?:{'|'.join(names)})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, names in sorted(by_length.items())]
    return rf"(?<![A-Za-z0-9])(?:{'|'.join(parts)})(?![A-Za-z0-9])"


#: In the order in which spans of one start are listed.
KINDS = [
    Kind(
        "email",
        rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@",
        _always,
        0.9,
        "mail|contact|write|schreib|correo|courriel",
        "noreply|no-reply",
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        ".",
        lambda m: F.regexp_like(m, F.lit(rf"^{_PART}(?:\.{_PART}){{3}}$")),
        0.6,
        r"\bip\b|server|host|address|login|adresse|direcci",
        "version|release|section|kapitel|chapitre",
    ),
    Kind(
        "card",
        r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
        "",
        lambda m: F.length(digits(m)).between(14, 19) & luhn(digits(m)),
        0.7,
        "card|visa|credit|payment|karte|carte|tarjeta|pago",
        "isbn|serial|order|tracking|imei",
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        "+",
        lambda m: F.length(digits(m)).between(10, 15),
        0.6,
        "phone|call|tel|mobile|fax|anruf|appel|llam",
        "score|degrees|total",
    ),
    Kind(
        "iban",
        _iban_pattern(),
        "",
        lambda m: mod97(F.regexp_replace(m, " ", "")),
        0.6,
        "iban|account|bank|konto|compte|cuenta",
        "serial|part|order|sku|model|invoice",
        up=0.3,
        base=False,
    ),
    Kind(
        "secret",
        r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+-]{20,}+={0,2}",
        "",
        mixed,
        0.4,
        "key|secret|token|passw|credential|auth|bearer|schl.ssel|kennwort|contrase|mot de passe",
        r"sha-?[0-9]|md5|commit|checksum|digest|uuid|etag|https?:",
        up=0.3,
        down=0.3,
        base=False,
    ),
    Kind(
        "routing",
        r"(?<![0-9A-Za-z.-])[0-9]{9}(?![0-9A-Za-z]|[.-][0-9])",
        "",
        routing,
        0.3,
        r"routing|\baba\b|\brtn\b",
        "phone|order|serial",
        up=0.4,
        base=False,
    ),
    Kind(
        "dni",
        r"(?<![0-9A-Za-z])[0-9]{8}-?[A-Za-z](?![0-9A-Za-z])",
        "",
        dni,
        0.4,
        r"\bdni\b|\bnif\b|identidad|documento",
        "serial|order|ref",
        up=0.4,
        base=False,
    ),
    Kind(
        "nir",
        r"(?<![0-9A-Za-z])[12](?:\x20?[0-9]){14}(?!\x20?[0-9]|[A-Za-z])",
        "",
        nir,
        0.4,
        r"s.curit. sociale|\bnir\b|insee|assur|immatricul",
        "serial|order|ref",
        up=0.4,
        base=False,
    ),
]
BLOCK = 256


def _sum(values: Column) -> Column:
    return F.aggregate(values, zero(), lambda a, x: a + x)


def _running(values: Column) -> Column:
    """Sums of all values before each, in two levels, so the work for n values is about n * BLOCK."""

    def block(values: Column, b: Column) -> Column:
        return F.slice(values, b * BLOCK + 1, F.lit(BLOCK))

    def within(values: Column, b: Column, start: Column) -> Column:
        n = F.least(F.lit(BLOCK), F.size(values) - b * BLOCK)
        own = block(values, b)
        return let(own, lambda own: F.transform(F.sequence(F.lit(0), n - 1), lambda j: start + _sum(F.slice(own, 1, j))))

    def starts(sums: Column) -> Column:
        return F.transform(sums, lambda _, b: _sum(F.slice(sums, 1, b)))

    blocks = F.sequence(F.lit(0), ((F.size(values) - 1) / BLOCK).cast("int"))
    begun = let(F.transform(blocks, lambda b: _sum(block(values, b))), starts)
    return F.flatten(F.transform(begun, lambda start, b: within(values, b, start)))


SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint,score:double,base:boolean>>"


def spans_of(kind: Kind, rank: int, text: Column, window: int) -> Column:
    """All confirmed spans of a kind in a text, as an array of structs in order; offsets are code points from 0."""

    def span(step: Column, before: Column) -> Column:
        match = step["match"]
        start = before + step["gap"]
        end = start + F.length(match)
        near = F.concat(
            F.substr(text, F.greatest(start - window, zero()).cast("int") + 1, F.least(start, F.lit(window)).cast("int")),
            F.lit("\n"),
            F.substr(text, end.cast("int") + 1, F.lit(window)),
        )

        def said(near: Column, words: str, weight: float) -> Column:
            return F.when(F.regexp_like(near, F.lit(f"(?i)(?:{words})")), weight).otherwise(0.0)

        score = let(near, lambda c: F.round(kind.score + said(c, kind.raises, kind.up) - said(c, kind.lowers, kind.down), 3))
        return F.when(
            match.isNotNull() & kind.valid(match),
            F.struct(
                start.alias("start"),
                F.lit(rank).alias("rank"),
                F.lit(kind.name).alias("kind"),
                end.alias("end"),
                score.alias("score"),
                F.lit(kind.base).alias("base"),
            ),
        )

    def spans(steps: Column) -> Column:
        lengths = F.transform(steps, lambda s: s["gap"] + F.coalesce(F.length(s["match"]), F.lit(0)))
        before = let(lengths, _running)
        return F.filter(F.zip_with(steps, before, span), lambda s: s.isNotNull())

    steps = F.zip_with(
        F.split(text, kind.pattern, -1),
        F.regexp_extract_all(text, F.lit(kind.pattern), 0),
        lambda gap, match: F.struct(F.length(gap).cast("long").alias("gap"), match.alias("match")),
    )
    some = F.regexp_like(text, F.lit(kind.pattern))
    if kind.needs:
        some = F.contains(text, F.lit(kind.needs)) & some
    return F.when(some, let(steps, spans)).otherwise(F.array().cast(SPAN))


def find_pii(docs: DataFrame, text_col: str = "text", window: int = 32, min_score: float = 0.5) -> DataFrame:
    """Adds ``pii``: all spans found in the text, by start, then kind as KINDS lists them.

    A span has kind, start, end (code points, end exclusive), score, and base (whether it is of a kind whose spans are
    fixed by contract; those stay whatever their score). A kind's score rises if one of the words that speak for it is
    within ``window`` characters, and falls if one that speaks against it is; other kinds' spans under ``min_score`` go:
    a token of digits and letters is a secret only beside a word such as key, a valid account number none beside a word
    such as serial. Matches of a kind don't overlap and are leftmost; one that fails its check is dropped, and its
    characters aren't tried again. Spans of different kinds may overlap.

    Null text: as empty, no spans. All other columns stay as they are; a column named ``pii`` is replaced. Every row is
    worked on alone, by built-in expressions in one pass without a shuffle; patterns are linear, so a text's length is
    bounded only by Spark's row size.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = [spans_of(kind, rank, text, window) for rank, kind in enumerate(KINDS)]
    every = F.array_sort(F.flatten(F.array(*parts)))
    return docs.withColumn("pii", F.filter(every, lambda s: s["base"] | (s["score"] >= min_score)))


def spans_text(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def pii_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans, after :func:`find_pii`; beside them
    n_other, the spans of all other kinds, and scores, in the order of spans."""
    found = find_pii(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    pii = F.col("pii")
    base = F.filter(pii, lambda s: s["base"])

    def count(name: str) -> Column:
        return F.size(F.filter(pii, lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    counts = [count(k.name) for k in KINDS if k.base]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(pii).alias("spans"),
        F.size(F.filter(pii, lambda s: ~s["base"])).cast("long").alias("n_other"),
        F.array_join(F.transform(pii, lambda s: s["score"].cast("string")), ",").alias("scores"),
    )
