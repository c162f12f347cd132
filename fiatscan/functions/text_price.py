"""Prices in text, with column expressions only.

`detect` adds amount and currency of the first price of a text. Intermediate texts are columns of their
own, so that no expression repeats another. A pattern is tried only on texts with the marks that it needs: what
has no digit, or nothing but digits, cannot hold a price and meets none of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiatscan.schemas import FIATS, SYMBOLS, WHITELIST

# The number notation, the currency marks, and blanks that count as white space.
NUMBER = r"\d{1,3}(?:[.,]\d{3})+(?:[.,]\d{1,2})?|\d+(?:[.,]\d{1,2})?"
SYMBOL = "[€$£¥₹]"
CODES = "|".join(FIATS)
BLANKS = "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))

# Word edges of ASCII words, whatever the engine's own idea of a word is.
_START, _END = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
_NOT_AFTER_DIGIT = r"(?<!\d\s)"

#: (pattern, replacement), in order: gaps round separators, whole-amount dashes, then lost decimals.
REPAIRS = (
    (r"(\d)\s*([.,])\s*(\d)", "$1$2$3"),
    (r"(\d+)\s*[.,]\s*-+", "$1,00"),
    (rf"({SYMBOL}\s*)0(\d{{2}}){_END}", "$10,$2"),
    (rf"({SYMBOL}\s*)(\d{{1,3}})\s+(\d{{2}}){_END}", "$1$2,$3"),
    (rf"(?i){_START}({CODES})\s*0(\d{{2}}){_END}", "$1 0,$2"),
    (rf"(?i){_START}({CODES})\s+(\d{{1,3}})\s+(\d{{2}}){_END}", "$1 $2,$3"),
    (rf"(?i){_START}0(\d{{2}})\s*({CODES}){_END}", "0,$1 $2"),
    (rf"(?i){_NOT_AFTER_DIGIT}{_START}(\d{{1,3}})\s+(\d{{2}})\s*({CODES}){_END}", "$1,$2 $3"),
)
BY_SYMBOL = rf"({SYMBOL})\s?({NUMBER})"
BY_FRANC = rf"(?i)(?:CHF|Fr\.?)\s?({NUMBER})"
BY_CODE_AFTER = rf"(?i)({NUMBER})\s?({CODES})"
BY_CODE_BEFORE = rf"(?i)({CODES})\s?({NUMBER})"
BARE_DECIMAL = rf"{_START}(\d+[.,]\d{{2}}){_END}"
SPACED_CENTS = rf"{_NOT_AFTER_DIGIT}{_START}(\d{{1,3}})\s+(\d{{2}}){_END}"


def plain_blanks(text: Column) -> Column:
    """The text with plain blanks; one of ASCII characters alone (as many characters as bytes) has no others."""
    return F.when(F.length(text) == F.octet_length(text), text).otherwise(F.translate(text, BLANKS, " " * len(BLANKS)))


def may_hold(text: Column) -> Column:
    """False for what cannot hold a price: every notation has a digit, and a letter, currency symbol, separator or blank beside it."""
    return text.rlike("[0-9]") & text.rlike("[^0-9]")


def whitelisted(text: Column) -> Column:
    """The text without characters that price labels do not use."""
    return F.regexp_replace(text, f"[^{WHITELIST.replace('-', chr(92) + '-')}]", "")


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(plain_blanks(text), r"\s+", " "))


#: what a text must have for some of the repairs to change it, and those repairs
REPAIRED_IF = (("[.,]", REPAIRS[:2]), (SYMBOL, REPAIRS[2:4]), ("[A-Za-z]", REPAIRS[4:]))


def repaired(df: DataFrame, text: str) -> DataFrame:
    """Column `text` with gaps closed, dashes and lost decimals written out."""
    for marks, repairs in REPAIRED_IF:
        changed = F.col(text)
        for pattern, replacement in repairs:
            changed = F.regexp_replace(changed, pattern, replacement)
        df = df.withColumn(text, F.when(F.col(text).rlike(marks), changed).otherwise(F.col(text)))
    return df


def parse_amount(raw: Column) -> Column:
    """Number of an amount in any notation.

    Of two kinds of separator the later is the decimal one. A separator of one kind is decimal only if it
    stands once, before exactly two digits; otherwise all are dropped. Reading stops at the first odd character.
    """
    comma, dot = raw.contains(","), raw.contains(".")
    comma_last = F.length(F.substring_index(raw, ",", -1)) < F.length(F.substring_index(raw, ".", -1))
    both = F.when(comma_last, F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(raw, F.lit(","), F.lit("")))
    single = F.when(raw.rlike(r"^[^.,]*[.,][^.,]{2}$"), F.translate(raw, ",", ".")).otherwise(F.translate(raw, ",.", ""))
    return F.regexp_extract(F.when(comma & dot, both).otherwise(single), r"^\d+(?:\.\d*)?", 0).try_cast("double")


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns behind a generator: later filters stay above them instead of repeating them, and code is generated for each side apart."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _empty_to_null(column: Column) -> Column:
    return F.when(column != "", column)


def detect(df: DataFrame, text: str, currency: Column | None = None, amount_name: str = "amount", currency_name: str = "currency") -> DataFrame:
    """df with the price of column `text`. `currency` is the scan's currency, null for none.

    The first kind of notation that matches wins: symbol, franc, then with a scan currency bare decimals and spaced cents,
    then codes. A symbol or franc of another currency than the scan's gives no price. A null text gives none.
    """
    wanted = F.lit(None).cast("string") if currency is None else currency
    symbol_of = F.create_map(*[F.lit(x) for pair in SYMBOLS.items() for x in pair])
    out = repaired(df.withColumn("_t", F.when(may_hold(F.col(text)), plain_blanks(F.col(text)))), "_t")
    symbol = _empty_to_null(F.regexp_extract("_t", BY_SYMBOL, 1))
    out = out.withColumns({"_symbol": symbol, "_symbol_raw": F.regexp_extract("_t", BY_SYMBOL, 2), "_letters": F.col("_t").rlike("[A-Za-z]")})
    out = out.withColumn("_franc_raw", F.when(F.col("_letters") & F.col("_symbol").isNull(), _empty_to_null(F.regexp_extract("_t", BY_FRANC, 1))))
    explicit = F.coalesce(symbol_of[F.col("_symbol")], F.when(F.col("_franc_raw").isNotNull(), "CHF"))
    out = held(out, _want=wanted, _explicit=explicit, _explicit_raw=F.when(F.col("_symbol").isNotNull(), F.col("_symbol_raw")).otherwise(F.col("_franc_raw")))
    other = F.col("_explicit").isNull()
    cents = F.concat_ws(".", _empty_to_null(F.regexp_extract("_t", SPACED_CENTS, 1)), _empty_to_null(F.regexp_extract("_t", SPACED_CENTS, 2)))
    bare = F.coalesce(_empty_to_null(F.regexp_extract("_t", BARE_DECIMAL, 1)), _empty_to_null(cents))
    out = out.withColumn("_bare", F.when(other & F.col("_want").isNotNull(), bare))
    by_code = F.col("_letters") & other & F.col("_bare").isNull()
    out = out.withColumn("_after", F.when(by_code, _empty_to_null(F.regexp_extract("_t", BY_CODE_AFTER, 2))))
    out = out.withColumn("_before", F.when(by_code & F.col("_after").isNull(), _empty_to_null(F.regexp_extract("_t", BY_CODE_BEFORE, 1))))
    code_raw = F.when(F.col("_after").isNotNull(), F.regexp_extract("_t", BY_CODE_AFTER, 1)).when(F.col("_before").isNotNull(), F.regexp_extract("_t", BY_CODE_BEFORE, 2))
    clash = F.col("_explicit").isNotNull() & F.col("_want").isNotNull() & (F.col("_explicit") != F.col("_want"))
    out = out.withColumn("_raw", F.when(clash, None).otherwise(F.coalesce("_explicit_raw", "_bare", code_raw)))
    found = F.coalesce("_explicit", F.when(F.col("_bare").isNotNull(), F.col("_want")), F.upper(F.coalesce("_after", "_before")))
    out = out.withColumns({"_amount": parse_amount(F.col("_raw")), "_found": found})
    price = F.struct(F.col("_amount").alias(amount_name), F.when(F.col("_amount").isNotNull(), F.col("_found")).alias(currency_name))
    # A generator keeps later filters on the price above it; pushed below, they would repeat every pattern.
    return out.select(*df.columns, F.inline(F.array(price)))


def fragment_class(text: Column) -> dict[str, Column]:
    """What a squeezed fragment text looks like. A single digit is an integer and a cent digit; two digits are cents only."""
    cents = text.rlike(r"^\d{2}$")
    return {
        "is_symbol": text.rlike(SYMBOL) & ~text.rlike(r"\d"),
        "is_integer": ~cents & (text.rlike(r"^\$?\d{1,4}$") | text.rlike(r"^\d+$")),
        "is_cents": cents,
        "is_cent_digit": text.rlike(r"^\d$"),
        "is_atomic": text.rlike(rf"{SYMBOL}\s*\d{{2,}}"),
        "symbol": _empty_to_null(F.regexp_extract(text, SYMBOL, 0)),
    }
