"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What the patterns of each kind match, leftmost and without overlap.
# Possessive quantifiers and the look-behinds give the same matches in linear time: a match can only begin
# where a run of its first characters begins, or where the match before it ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])"
SSN = r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])"
IP_VALID = r"^0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"
SECRET = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}"
SSN_VALID = r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"

#: Of each kind: the score without context, words that raise it, words that lower it.
CONTEXT = {
    "email": (0.8, "mail|contact|write|kontakt|correo|courriel", "example|sample|noreply"),
    "ip": (0.7, "ip|address|host|server|adresse|direcci", "version|release|section|chapter"),
    "card": (0.7, "card|visa|mastercard|amex|karte|carte|tarjeta", "order|invoice|isbn|serial"),
    "phone": (0.7, "tel|phone|call|fax|mobile|telefon|llamar|appel", "part|serial|article"),
    "iban": (0.9, "iban|account|bank|konto|compte|cuenta", "example|sample|test"),
    "ssn": (0.4, "ssn|social|security|taxpayer", "order|invoice|part|serial"),
    "secret": (0.4, "token|secret|passw|api|key|auth|credential|bearer", "sha|commit|checksum|digest|md5|hash"),
}
RAISE, LOWER, ACCEPT = 0.3, 0.3, 0.6
#: Code points looked at before and after a span for words of context, across as many earlier matches at most.
BEFORE, AFTER, ACROSS = 48, 24, 4


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True where the digits pass: from the right, every second one doubled and its digits summed."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(code: Column) -> Column:
    """True where an international account number leaves 1: its first four characters moved to the end,
    letters as 10 to 35, taken digit by digit."""
    plain = F.replace(code, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        value = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.when(c == "", rest).otherwise(F.when(value < 10, rest * 10 + value).otherwise(rest * 100 + value) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def in_range(low: int, high: int, n: Column) -> Column:
    return (n >= low) & (n <= high)


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(IP_VALID),
    "card": lambda m: in_range(13, 19, F.length(digits_of(m))) & luhn(digits_of(m)),
    "phone": lambda m: in_range(9, 15, F.length(digits_of(m))),
    "iban": lambda m: in_range(15, 34, F.length(F.replace(m, F.lit(" "), F.lit("")))) & mod97(m),
    "ssn": lambda m: m.rlike(SSN_VALID),
    "secret": lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"),
}
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "ssn": SSN, "secret": SECRET}
#: Found in every text that has a match, and much cheaper to look for.
HINT = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
BASE = ("email", "ip", "card", "phone")


def matches_of(text: Column, kind: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    if kind in HINT:
        found = F.when(F.contains(text, F.lit(HINT[kind])), found)
    return F.coalesce(found, F.array().cast("array<string>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body looks at it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(numbers: Column) -> Column:
    """Of an array of integers, the sums up to each element. Each round adds to every element the one that stands 1, 2, 4 ... places before it,
    so that the work is n log n; rounds beyond the array's size do nothing."""
    def add(sums: Column, step: Column) -> Column:
        shifted = F.transform(sums, lambda x, i: x + F.when(i >= step, F.get(sums, i - step)).otherwise(0))
        return F.when(F.size(sums) > step, shifted).otherwise(sums)

    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(31)]), numbers, add)


def context_score(kind: str, pieces: Column, tails: Column, found: Column, i: Column) -> Column:
    """What the words around match i make of its score: up to BEFORE code points before it, also across earlier matches, raise or lower it; up to AFTER
    after it raise it only, for what is said of the next span often stands there."""
    plain, up, down = CONTEXT[kind]
    earlier = [x for k in range(ACROSS, 0, -1) for x in (F.get(tails, i - k), F.get(found, i - k))]
    before = F.right(F.concat(*[F.coalesce(x, F.lit("")) for x in (*earlier, F.get(tails, i))]), F.lit(BEFORE))
    near = F.lower(F.concat(before, F.lit("\n"), F.left(F.coalesce(F.get(pieces, i + 1), F.lit("")), F.lit(AFTER))))
    raised = F.when(near.rlike(rf"\b(?:{up})"), RAISE).otherwise(0.0)
    return F.least(F.lit(1.0), F.lit(plain) + raised - F.when(F.lower(before).rlike(rf"\b(?:{down})"), LOWER).otherwise(0.0))


def spans_of(text: Column, found: Column, kind: str) -> Column:
    """An array of (start, end, score), in code points with the end exclusive, of the confirmed spans of a kind.

    The pieces between matches and the matches themselves, laid end to end, give the positions: split and
    extract_all find the same matches, and both are part of Spark's expressions.
    """
    none = F.array().cast("array<struct<start:int,end:int,score:double>>")

    def spans(s: Column) -> Column:
        pieces, matches, tails = s["pieces"], s["found"], s["tails"]

        def span(ends: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                end = F.get(ends, i)
                score = F.when(VALID[kind](m), context_score(kind, pieces, tails, matches, i))
                return F.struct((end - F.length(m)).alias("start"), end.alias("end"), score.alias("score"))

            return F.transform(matches, one)

        lengths = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: F.length(p) + F.length(m))
        return let(running_sums(lengths), span)

    parts = let(F.split(text, PATTERNS[kind], -1), lambda p: F.struct(p.alias("pieces"), F.transform(p, lambda x: F.right(x, F.lit(BEFORE))).alias("tails"), found.alias("found")))
    accepted = (lambda s: s["score"].isNotNull()) if kind in BASE else (lambda s: s["score"] >= ACCEPT)
    return F.when(F.size(found) > 0, F.filter(let(parts, spans), accepted)).otherwise(none)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id`` and, for each kind, an array of its spans (start, end, score).

    No row is moved: all of it is one projection, and its work grows with a text's length and its matches, n log n at most. Kinds are looked for independently,
    so spans of different kinds may overlap. Card numbers must pass Luhn, account numbers mod-97. Every span carries a score that words
    around it raise or lower. Account numbers, social security numbers and secrets (runs of 20 and more letters and digits) stay from
    0.6 on; emails, addresses, cards and phone numbers always.

    Nulls: a null text is empty and has no spans; a null identifier is passed through. Repeated rows give
    repeated results; an empty table gives no rows. Texts of any length are read whole. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"))
    matched = rows.select("doc_id", "_text", *[matches_of(F.col("_text"), kind).alias(f"_{kind}") for kind in PATTERNS])
    return matched.select("doc_id", *[spans_of(F.col("_text"), F.col(f"_{kind}"), kind).alias(kind) for kind in PATTERNS])


def joined(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans, by kind, then start, comma-joined."""
    def named(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*[named(kind) for kind in kinds]), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n_all = F.lit(0).cast("long")
    for kind in PATTERNS:
        n_all = n_all + F.size(kind)
    return found.select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in PATTERNS],
        F.sha2(joined(BASE), 256).alias("base_sha256"),
        joined(tuple(PATTERNS)).alias("spans"),
        n_all.alias("n_spans"),
        (n_all > 0).alias("has_pii"),
    )


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op4_pii that SQL states: the base kinds."""
    return op4_pii(spark, sf_dir).select("doc_id", *[f"n_{kind}" for kind in BASE], "base_sha256")


PII_BASE_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (
  SELECT doc_id, 1 AS k, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS m, regexp_split_to_array(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS p FROM texts
  UNION ALL SELECT doc_id, 2, regexp_extract_all(t, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'), regexp_split_to_array(t, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') FROM texts
  UNION ALL SELECT doc_id, 3, regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+'), regexp_split_to_array(t, '[0-9](?:[\x20-]?[0-9])+') FROM texts
  UNION ALL SELECT doc_id, 4, regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), regexp_split_to_array(t, '\+[0-9][\x20().0-9-]+[0-9]') FROM texts),
matches AS (SELECT doc_id, k, unnest(m) AS s, unnest(p[1:len(m)]) AS before, unnest(range(1, len(m) + 1)) AS i FROM found WHERE len(m) > 0),
placed AS (SELECT doc_id, k, s, sum(length(before) + length(s)) OVER (PARTITION BY doc_id, k ORDER BY i) AS e, regexp_replace(s, '[^0-9]', '', 'g') AS d FROM matches),
valid AS (
  SELECT doc_id, k, e - length(s) AS b, e FROM placed
  WHERE k = 1
     OR (k = 2 AND len(list_filter(string_split(s, '.'), lambda q: length(ltrim(q, '0')) > 3 OR coalesce(try_cast(right(q, 3) AS INTEGER), 0) > 255)) = 0)
     OR (k = 3 AND length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(0, length(d)), lambda j: CASE WHEN j % 2 = 0 THEN d[length(d) - j]::INTEGER ELSE 2 * d[length(d) - j]::INTEGER - CASE WHEN d[length(d) - j]::INTEGER > 4 THEN 9 ELSE 0 END END)) % 10 = 0)
     OR (k = 4 AND length(d) BETWEEN 9 AND 15))
SELECT t.doc_id, count(*) FILTER (v.k = 1) AS n_email, count(*) FILTER (v.k = 2) AS n_ip, count(*) FILTER (v.k = 3) AS n_card, count(*) FILTER (v.k = 4) AS n_phone,
       sha256(coalesce(string_agg(['email', 'ip', 'card', 'phone'][v.k] || ':' || v.b || ':' || v.e, ',' ORDER BY v.k, v.b), '')) AS base_sha256
FROM texts t LEFT JOIN valid v ON v.doc_id = t.doc_id GROUP BY t.doc_id
"""
