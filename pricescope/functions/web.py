"""Rules for prices, addresses and answers found on web pages, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricescope.functions import lexicon

#: Currency codes, and symbols in the order in which they are tried.
CODES = "USD EUR GBP AED SAR EGP KWD QAR BHD OMR JOD CAD AUD NZD INR JPY CNY TRY CHF SEK NOK DKK PLN MAD ZAR SGD HKD MXN BRL KRW".split()
SYMBOLS = [
    ("US$", "USD"), ("CA$", "CAD"), ("C$", "CAD"), ("AU$", "AUD"), ("A$", "AUD"), ("NZ$", "NZD"), ("HK$", "HKD"), ("S$", "SGD"), ("R$", "BRL"), ("E£", "EGP"),
    ("د.إ", "AED"), ("ر.س", "SAR"), ("ج.م", "EGP"), ("د.ك", "KWD"), ("ر.ق", "QAR"), ("Dhs", "AED"), ("DHS", "AED"), ("Dh", "AED"), ("SR", "SAR"), ("LE", "EGP"),
    ("€", "EUR"), ("£", "GBP"), ("¥", "JPY"), ("₹", "INR"), ("₺", "TRY"), ("₩", "KRW"), ("zł", "PLN"), ("$", "USD"),
]
AMOUNT = r"\d{1,3}(?:[.,' ]\d{3})+(?:[.,]\d{1,3})?|\d+(?:[.,]\d{1,3})?"
#: Words of markup for stock, phrases of challenge and not-found pages, and hosts that aren't public.
AVAILABILITY = {
    "in_stock": ["instock", "instoreonly", "onlineonly", "available"],
    "limited": ["limitedavailability", "lowstock"],
    "preorder": ["preorder", "presale", "backorder"],
    "out_of_stock": ["outofstock", "soldout", "discontinued", "unavailable"],
}
BLOCK_TITLE = r"(?i)just a moment|attention required|access denied|robot check|are you a robot|security check|pardon our interruption|request blocked"
BLOCK_TEXT = r"(?i)verify you are (?:a )?human|unusual traffic|enable cookies to continue|captcha|press (?:and|&) hold|bot detection"
BLOCK_HTML = r"(?i)action=\"[^\"]*validateCaptcha|opfcaptcha\.amazon"
NOT_FOUND_TITLE = r"(?i)\bnot found\b|\b404\b|no longer available|لم يتم العثور|غير موجود"
PRIVATE_HOST = r"(?i)^(localhost|.*\.local|.*\.internal|127\.\d+\.\d+\.\d+|10\.\d+\.\d+\.\d+|192\.168\.\d+\.\d+|172\.(1[6-9]|2\d|3[01])\.\d+\.\d+|0\.0\.0\.0|\[?::1\]?|169\.254\.\d+\.\d+)$"
#: Pattern of an error's message, and the code it stands for; the first that fits.
ERRORS = [
    (r"(?i)timeout \d+ms exceeded|timed out", "TIMEOUT"),
    (r"(?i)executable doesn't exist|browsertype\.launch", "RENDER_FAILURE"),
    (r"(?i)err_name_not_resolved|enotfound|eai_again", "UNAVAILABLE"),
    (r"(?i)err_connection_(refused|reset|closed|timed_out)|err_address_unreachable|err_internet_disconnected|econnrefused|econnreset", "UNAVAILABLE"),
    (r"(?i)err_http2_protocol_error|err_blocked_by_response", "BLOCKED"),
    (r"(?i)err_cert|ssl|certificate", "UNAVAILABLE"),
    (r"(?i)err_too_many_redirects", "UNAVAILABLE"),
    (r"(?i)crash|target (page, context or browser )?closed|has been closed|navigation failed", "RENDER_FAILURE"),
]
#: Second-level labels of country domains.
SECOND_LEVEL = ["co", "com", "net", "org", "gov", "ac", "edu"]


def parse_amount(text: Column) -> Column:
    """The first amount in a text. Of two kinds of separators the last is the decimal one; a lone comma is one unless three digits follow."""
    raw = F.regexp_replace(F.regexp_extract(F.translate(text, "   ", "   "), f"({AMOUNT})", 1), "[ ']", "")
    commas, dots = F.length(raw) - F.length(F.replace(raw, F.lit(","), F.lit(""))), F.length(raw) - F.length(F.replace(raw, F.lit("."), F.lit("")))
    dot_last = F.instr(F.reverse(raw), ".") < F.instr(F.reverse(raw), ",")
    plain = lambda c: F.replace(raw, F.lit(c), F.lit(""))
    both = F.when(dot_last, plain(",")).otherwise(F.replace(plain("."), F.lit(","), F.lit(".")))
    comma = F.when((commas == 1) & ~raw.rlike(r",\d{3}$"), F.replace(raw, F.lit(","), F.lit("."))).otherwise(plain(","))
    value = F.when((commas > 0) & (dots > 0), both).when(commas > 0, comma).when(dots > 1, plain(".")).otherwise(raw).try_cast("double")
    return F.when(value > 0, value)


def _word(symbol: str) -> str:
    return rf"(?<![A-Za-z0-9_]){symbol}(?![A-Za-z0-9_])"


def tagged_amount() -> str:
    """A pattern of an amount with a currency before or after it."""
    token = "|".join([_word(c) for c in CODES] + [_word(s) if s.isascii() and s.isalpha() else re.escape(s) for s, _ in SYMBOLS])
    return rf"(?:{token})\s*(?:{AMOUNT})|(?:{AMOUNT})\s*(?:{token})"


def detect_currency(text: Column) -> Column:
    """The first currency code in a text, or else the first symbol of the list that occurs."""
    code = F.regexp_extract(text, _word(f"({'|'.join(CODES)})"), 1)
    found = F.when(code != "", code)
    for symbol, name in SYMBOLS:
        hit = text.rlike(_word(symbol)) if symbol.isascii() and symbol.isalpha() else F.contains(text, F.lit(symbol))
        found = found.when(hit, name)
    return found


def normalize_currency(value: Column) -> Column:
    """The code of a code or symbol that stands alone."""
    alone = F.trim(value)
    found = F.when(F.upper(alone).isin(CODES), F.upper(alone))
    for symbol, name in SYMBOLS:
        found = found.when(alone == symbol, name)
    return found


def normalize_availability(value: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(value), r"^https?://schema\.org/", ""), r"[\s_-]", "")
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, words in AVAILABILITY.items():
        found = found.when(bare.isin(words), name)
    return found.otherwise("unknown")


def page_problem(status: Column, title: Column, text: Column, html: Column) -> Column:
    """Why a page can't be used: BLOCKED, UNAVAILABLE or EMPTY_PAGE; null if it can."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    challenge = title.rlike(BLOCK_TITLE) | F.substring(plain, 1, 2000).rlike(BLOCK_TEXT)
    blocked = title.rlike(BLOCK_TITLE) | ((F.length(plain) < 1500) & plain.rlike(BLOCK_TEXT)) | html.rlike(BLOCK_HTML)
    return (
        F.when(status.isin(401, 403, 429), "BLOCKED")
        .when(status.isin(404, 410), "UNAVAILABLE")
        .when(status >= 500, F.when(challenge, "BLOCKED").otherwise("UNAVAILABLE"))
        .when(blocked, "BLOCKED")
        .when((F.length(plain) < 10) & ~html.rlike(r"(?i)application/ld\+json|itemprop=|product:price"), "EMPTY_PAGE")
    )


def classify_error(message: Column) -> Column:
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, code in ERRORS:
        found = found.when(message.rlike(pattern), code)
    return found.otherwise("UNKNOWN")


def is_scrapable(url: Column) -> Column:
    """A public http(s) address."""
    scheme, host = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.try_parse_url(url, F.lit("HOST"))
    return F.coalesce(scheme.isin("http", "https") & (host != "") & ~host.rlike(PRIVATE_HOST), F.lit(False))


def store_name(domain: Column) -> Column:
    """A name made of a domain: its first telling label, in words with capitals."""
    labels = F.filter(F.split(domain, r"\."), lambda x: x != "")
    n = F.size(labels)
    two = (n >= 3) & (F.length(F.get(labels, n - 1)) == 2) & F.get(labels, n - 2).isin(SECOND_LEVEL)
    host = F.slice(labels, F.lit(1), F.greatest(n - F.when(two, 2).otherwise(1), F.lit(1)))
    telling = F.filter(host, lambda x: ~x.isin(lexicon.GENERIC_SUBDOMAINS))
    core = F.coalesce(F.get(telling, F.lit(0)), F.try_element_at(host, F.lit(-1)))
    parts = F.filter(F.split(core, "[-_]+"), lambda x: x != "")
    named = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 2**31 - 1))), " ")
    return F.when(n == 0, domain).otherwise(named)


def robots_pattern(pattern: Column) -> Column:
    """A robots.txt path pattern as a regular expression: ``*`` is any run, a closing ``$`` anchors the end."""
    body = F.regexp_replace(F.regexp_replace(pattern, r"\$$", ""), r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(body, F.lit("*"), F.lit(".*")), F.when(pattern.endswith("$"), "$").otherwise(""))
