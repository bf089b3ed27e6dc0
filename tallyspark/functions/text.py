"""Text rules: product categories, campaign copy, recipient fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



#: Every character that counts as white space.
BLANKS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
          + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000")


def strip(text: Column) -> Column:
    """Text without white space of any kind at both ends."""
    return F.btrim(text, F.lit(BLANKS))


# Words that never name a category.
STOP_WORDS = ["a", "an", "the", "and", "or", "for", "of", "in", "with", "to",
              "na", "pro", "ke", "ve", "ze", "se", "do", "od", "po"]
# Separators between words, and characters stripped from both ends of one.
_GAP = r"\s\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\-_/|,"
_RIM = r"().\[\]{}\"'"
# A word of three or more characters that is neither a stop word nor all digits, in
# lower-case text.
TELLING_WORD = (
    rf"(?<![^{_GAP}])[{_RIM}]*"
    rf"(?!(?:{'|'.join(STOP_WORDS)}|\p{{Nd}}+)[{_RIM}]*(?![^{_GAP}]))"
    rf"([^{_GAP}{_RIM}][^{_GAP}]+[^{_GAP}{_RIM}])"
    rf"[{_RIM}]*(?![^{_GAP}])")


def _capitalised(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)),
                    F.lower(F.substring(word, F.lit(2), F.length(word))))


def telling_word(name: Column) -> Column:
    """The first word that tells something, in lower case; '' without one."""
    return F.regexp_extract(F.lower(name), TELLING_WORD, 1)


def category_from_word(name: Column, word: Column) -> Column:
    return (F.when(word != "", _capitalised(word))
             .when(name.rlike(r"(?U)\S"), _capitalised(F.substring(name, 1, 20)))
             .otherwise("Other"))


def category_from_text(name: Column) -> Column:
    """First telling word of a product name, capitalised.

    A word tells something when it has three letters or more, is no stop word and is not
    all digits. Without one the first 20 characters serve; blank text gives 'Other'.
    """
    return category_from_word(name, telling_word(name))


def category_label(cell: Column) -> Column:
    """A ready-made category; blank or 'nan' means 'Other'."""
    text = F.coalesce(cell.cast("string"), F.lit(""))
    return F.when(text.isin("", "nan"), "Other").otherwise(text)


# Letters allowed in a voucher code besides A-Z.
_CODE_LETTERS = "ÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ"
# A word announcing a voucher code, followed by the code.
CODE_PHRASE = (
    r"(?iuU)(?=[\skvcuws])\s*(?:s\s+)?(?:kódem|kódu|kód|kupónem|kupón|voucher|coupon|(?:use\s+|with\s+)?code)"
    r"\s*[:\"'„]?\s*[A-Z0-9" + _CODE_LETTERS + r"_-]{3,}[\"'“]?")
# Fixed value: a capital word of four or more characters holding a digit.
BARE_CODE = (
    r"(?=[A-Z" + _CODE_LETTERS + r"])(?<![\p{L}\p{N}_])(?=[A-Z0-9" + _CODE_LETTERS
    + r"-]*\p{Nd})[A-Z" + _CODE_LETTERS + r"][A-Z0-9" + _CODE_LETTERS + r"-]{3,}(?U:\b)")
# Fixed value: a concrete discount: a percentage, or an amount with its currency.
CONCRETE_DISCOUNT = (
    r"(?iuU)(?=[\d€$£kce])(?:\d+\s*%"
    r"|(?:kč|czk|eur|€|\$|£)\s*\d+"
    r"|\d+\s*(?:kč|czk|eur)\b"
    r"|\d+\s*[€$£])")

_PLACEHOLDER = "\ue000"


def strip_voucher_codes(text: Column, keep: str | None = None) -> Column:
    """Campaign text without voucher codes nobody issued; ``keep`` is the owner's own."""
    work = F.replace(text, F.lit(keep), F.lit(_PLACEHOLDER)) if keep else text
    work = F.regexp_replace(work, CODE_PHRASE, "")
    work = F.regexp_replace(work, BARE_CODE, "")
    work = F.btrim(F.regexp_replace(work, r"(?U)\s{2,}", " "), F.lit(" ,;:–-"))
    return F.replace(work, F.lit(_PLACEHOLDER), F.lit(keep)) if keep else work


def promises_discount(*texts: Column) -> Column:
    """True when one of the texts names a concrete discount; each is searched by itself."""
    return F.coalesce(F.greatest(*[F.coalesce(t.rlike(CONCRETE_DISCOUNT), F.lit(False))
                                   for t in texts], F.lit(False)), F.lit(False))


def one_line(text: Column) -> Column:
    """Recipient field without line breaks and outer blanks."""
    return strip(F.translate(F.coalesce(text, F.lit("")), "\r\n", "  "))


# Fixed value: what counts as an e-mail address.
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def looks_like_email(text: Column) -> Column:
    return text.rlike(EMAIL)


# Currency codes and their symbols.
CURRENCY_SYMBOLS = {"CZK": "Kč", "EUR": "€", "USD": "$", "GBP": "£"}


def currency_symbol(code: Column) -> Column:
    """ISO code -> symbol; anything else is kept, trimmed."""
    bare = strip(code)
    rule = F.when(F.lit(False), F.lit(None).cast("string"))
    for iso, symbol in CURRENCY_SYMBOLS.items():
        rule = rule.when(F.upper(bare) == iso, symbol)
    return rule.otherwise(bare)


def content_language(symbol: Column, source: Column | None = None) -> Column:
    """'cs' for Czech money or the partner-shop source, else 'en'."""
    czech = symbol == "Kč"
    if source is not None:
        czech = czech | source.isin("eshop", "partner")
    return F.when(czech, "cs").otherwise("en")


def formula_safe(cell: Column) -> Column:
    """CSV cell that no spreadsheet runs as a formula."""
    return F.when(cell.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), cell)).otherwise(cell)
