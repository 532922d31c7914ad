"""Personal data: expressions propose spans, validators confirm them, context words adjust the score.

DataFrame functions only.  Each kind's matches are fenced by two control
characters and split apart; a running sum of the stretches' lengths gives
places in code points.  Those two characters are in no expression, so a text
that holds them is searched with a third one in their place.

email, ip, card and phone are always reported.  iban (as long as its country's
are, so that what follows is never part of it, and confirmed by mod 97), ssn and
secret (weak patterns, which need a context word; a secret is a long run of
letters with several digits, and well-known prefixes do without context) and key
(the head of a private key) are added by score.  Edge cases: null and empty
texts have no spans; every row is returned once, repeated
ones too; a run of any length of digits or letters is one match at most, as
the expressions never backtrack over it; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret", "key")
BASE = KINDS[:4]
_OPEN, _CLOSE, _OTHER = "\x01", "\x02", "\x03"
_OCTET = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|(?<=0))"

#: Countries of the IBAN registry by the length of their IBANs.
IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK|FI|FK|FO|GL|NL|SD",
    19: "MK|SI",
    20: "AT|BA|EE|KZ|LT|LU|MN|XK",
    21: "CH|HR|LI|LV",
    22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA",
    23: "AE|GI|IL|IQ|OM|SO|TL",
    24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG",
    25: "LY|PT|ST",
    26: "IS|TR",
    27: "BI|DJ|FR|GR|IT|MC|MR|SM",
    28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV",
    29: "BR|EG|PS|QA|UA",
    30: "JO|KW|MU|YE",
    31: "MT|SC",
    32: "LC",
    33: "RU",
}
_IBAN = "|".join(rf"(?:{codes})[0-9]{{2}}(?:\x20?+[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items())

#: Possessive forms of the plain expressions.  A match that begins inside a run of its first class would also begin at the
#: run's start, so only that place, or where the match before ended (\G), is tried.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+={0,2}+",
    "key": r"-----BEGIN [A-Z0-9 ]{0,30}PRIVATE KEY-----",
}
#: Words near a span that raise the score of its kind.
CONTEXT = {
    "email": "mail|e-mail|email|contact|write",
    "ip": "ip|address|host|server",
    "card": "card|visa|credit|debit|payment|karte|tarjeta|carte",
    "phone": "phone|call|tel|mobile|fax|telefon",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "ssn": "ssn|social security|tax id",
    "secret": "token|secret|password|passwd|pwd|key|apikey|api_key|bearer|credential|credentials",
    "key": "key",
}
#: Score of a confirmed match without context; the bonus of a context word; what an added kind needs.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "secret": 0.3, "key": 0.9}
#: How keys of well-known services begin.
PREFIXED = r"^(?:AKIA|ASIA|gh[pousr]_|sk-|xox[baprs]-|AIza)"
BONUS, NEEDED, REACH = 0.3, 0.5, 48


def _digit_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits, the last one counted plainly."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, n - i, F.lit(1))) - 48
        return total + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def _mod97(iban: Column) -> Column:
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 58, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add)


def _valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    letters = F.regexp_replace(match, " ", "")
    return (
        F.when(kind == "ip", match.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"))
        .when(kind == "card", F.when(F.length(digits).between(14, 19), _digit_sum(digits) % 10 == 0).otherwise(False))
        .when(kind == "phone", F.length(digits).between(10, 15))
        .when(kind == "secret", match.rlike("^(?=(?:[^0-9]*+[0-9]){5})(?=(?:[^A-Za-z]*+[A-Za-z]){2})"))
        .when(kind == "iban", F.when(F.length(letters).between(15, 34), _mod97(letters) == 1).otherwise(False))
        .otherwise(True)
    )


def _matches(kind: str, text: Column, parts: str) -> Column:
    """For each match: its number, the text from the end of the one before (its length counts), and what stands around."""
    s = F.col(parts)

    def one(i: Column) -> Column:
        before, own = F.element_at(s, i), F.element_at(s, i + 1)
        passed = F.length(before) - F.when(i > 1, 1).otherwise(0)
        match = F.substring_index(own, _CLOSE, 1)
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), passed.cast("long").alias("passed"), match.alias("match"), F.right(before, F.lit(REACH)).alias("before"), F.substring(own, F.length(match) + 2, F.lit(REACH)).alias("after"))

    return F.when(F.size(s) > 1, F.transform(F.sequence(F.lit(1), F.size(s) - 1), one))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and spans (start, rank of its kind, kind, end, score, match), in order, for each row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    text = F.when(text.contains(_OPEN) | text.contains(_CLOSE), F.translate(text, _OPEN + _CLOSE, _OTHER + _OTHER)).otherwise(text)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    split = rows.select("rid", "doc_id", *(F.split(F.regexp_replace("text", p, f"{_OPEN}$0{_CLOSE}"), _OPEN).alias(f"p_{k}") for k, p in PATTERNS.items()))
    none = F.array().cast("array<struct<kind:string,i:int,passed:bigint,match:string,before:string,after:string>>")
    lists = split.select("rid", "doc_id", F.concat(*(F.coalesce(_matches(k, F.col("rid"), f"p_{k}"), none) for k in PATTERNS)).alias("found"))
    each = lists.select("rid", "doc_id", F.explode_outer("found").alias("f")).select("rid", "doc_id", "f.*")
    start = F.sum("passed").over(Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    each = each.withColumn("start", start)
    near = F.lower(F.concat_ws(" ", "before", "after"))
    context = F.coalesce(*(F.when(F.col("kind") == k, near.rlike(rf"\b(?:{words})\b")) for k, words in CONTEXT.items()), F.lit(False))
    prior = F.coalesce(*(F.when(F.col("kind") == k, p) for k, p in PRIOR.items()))
    prior = F.when((F.col("kind") == "secret") & F.col("match").rlike(PREFIXED), 0.8).otherwise(prior)
    score = F.least(F.lit(1.0), prior + F.when(context, BONUS).otherwise(0.0))
    each = each.withColumn("score", F.when(F.col("kind").isNotNull() & _valid(F.col("kind"), F.col("match")), score))
    rank = F.coalesce(*(F.when(F.col("kind") == k, i) for i, k in enumerate(KINDS)))
    sure = F.col("score").isNotNull() & (F.col("kind").isin(*BASE) | (F.col("score") >= NEEDED))
    span = F.when(sure, F.struct("start", rank.alias("rank"), "kind", (F.col("start") + F.length("match")).alias("end"), "score", "match"))
    return each.groupBy("rid", "doc_id").agg(F.sort_array(F.collect_list(span)).alias("spans")).drop("rid")
