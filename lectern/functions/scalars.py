"""Column expressions shared by the operators. Everything here stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.json_schema import SPACE
from lectern.functions.text_udfs import nfc


def half_up6(x: Column) -> Column:
    """A double rounded half up to 6 places, as DECIMAL(12,6)."""
    return (F.floor(x * 1e6 + 0.5).cast("double") / 1e6).cast("decimal(12,6)")


def exact_mean(value: Column) -> Column:
    """Mean of a decimal column: exact sum, one division in double."""
    return F.sum(value).cast("double") / F.count(value)


def histogram_bin(value: Column, bins: int = 5) -> Column:
    """Bin of a score in 0..1; 1.0 falls in the last bin, negatives in the first, NULL, NaN and infinities in none."""
    v = value.cast("double")
    odd = v.isNull() | F.isnan(v) | (v == float("inf")) | (v == float("-inf"))
    return F.when(odd, None).otherwise(F.least(F.lit(bins - 1), F.floor(F.greatest(F.lit(0.0), v) * bins).cast("int")))


def metric_weight(weights: Column, metric: Column) -> Column:
    """Weight of a metric under a JSON object of weights.

    A JSON number counts as itself; a key with anything else has no weight (NULL); an absent
    key counts 1, but response_present counts 0.
    """
    given = F.from_json(weights, "map<string,string>")
    present = F.coalesce(F.map_contains_key(given, metric), F.lit(False))
    return F.when(present, F.try_element_at(given, metric).try_cast("double")).when(metric == "response_present", 0.0).otherwise(1.0)


def json_text(json: Column, key: str) -> Column:
    """Value of a key of a JSON object if it is a text, else NULL."""
    v = F.try_variant_get(F.try_parse_json(json), f"$.{key}", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", v.cast("string"))


def token_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Cost in the price's currency; NULL when a token count is missing. Prices are per million."""
    return (tokens_in * price_in + tokens_out * price_out) / 1_000_000


def converted(native: Column, rate: Column) -> Column:
    """Native cost at an exchange rate; NULL when the rate is missing or zero."""
    return F.when(rate.isNotNull() & (rate != 0), native * rate)


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 3).cast("long")


def lines_normalised(text: Column) -> Column:
    """Line ends as LF, outer white space gone. NFC is applied by ``text_udfs.nfc``."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"^\s+", ""), r"\s+$", "")


def answer_flat(text: Column) -> Column:
    """Single blanks for white space of any kind, and no closing marks."""
    flat = F.trim(F.regexp_replace(text, f"{SPACE}+", " "))
    return F.trim(F.regexp_replace(flat, r"[.!?。]+\z", ""))


def answer_normalised(text: Column) -> Column:
    """Lower-cased answer in NFC with single blanks and without closing marks."""
    return F.lower(answer_flat(nfc(text)))


def is_sha256(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{64}$")


#: Digits to which a number inside a name is filled up; longer numbers sort behind it.
NUMBER_DIGITS = 40


def natural_key(c: Column, locale: str = "ko") -> Column:
    """Sort key in the collation of a locale, in which every number inside a name counts by its value: 2장 10절 before 10장 2절."""
    digits = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    filled = lambda x: F.when(F.length(digits(x)) <= NUMBER_DIGITS, F.lpad(digits(x), NUMBER_DIGITS, "0")).otherwise(digits(x))
    parts = F.transform(F.regexp_extract_all(c, F.lit("(\\d+|\\D+)"), F.lit(1)), lambda x: F.when(x.rlike("^\\d"), filled(x)).otherwise(x))
    return F.collate(F.array_join(parts, ""), locale)


def mime_of(content: Column) -> Column:
    """MIME type by the first bytes; NULL if none of the known kinds."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("255044462D"), "application/pdf")
        .when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    )


def backoff_ms(attempt: Column, base: int = 2000, most: int = 30_000) -> Column:
    """Exponential wait before an attempt (1, 2, ...), without its random part."""
    return F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), attempt - 1)).cast("long")


#: What is blotted out of error texts besides the key itself, and how long they may be.
SECRETS = [r"""(?i)(authorization)["':= ]+(?:bearer\s+)?[^\s,"}]+""", r"""(?i)(api[-_ ]?key)["':= ]+[^\s,"}]+"""]
ERROR_CHARS = 500


def redacted(text: Column, secret: Column | None = None) -> Column:
    """Error text without the secret and what stands behind names of keys, cut to its first 500 characters."""
    if secret is not None:
        text = F.when(F.coalesce(secret, F.lit("")) == "", text).otherwise(F.replace(text, secret, F.lit("[REDACTED]")))
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, "$1 [REDACTED]")
    return F.substring(text, 1, ERROR_CHARS)


def shared_snapshot_key(run: Column, question: Column, revision: Column, mode: Column) -> Column:
    return F.sha2(F.concat_ws(":", run, question, revision.cast("string"), mode), 256)


def percent_done(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(done * 100.0 / total + 0.5).cast("int")).otherwise(F.lit(0))


def l2_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
