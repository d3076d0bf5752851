"""Text normalisation, search and masking as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from cowrie.functions.numbers import let

# Words that do not name an item.
NOISE = (
    "tas kg seau seaux cageot cageots regime regimes sac sacs botte bottes paquet paquets pcs pc piece pieces litre litres "
    "bidon bidons verre verres cuvette cuvettes boite boites pack packs carton cartons unit units bunch bunches heap heaps "
    "basket baskets bag bags tin tins cup cups doz dozen douzaine plate plates assiette assiettes bol bols tasse tasses "
    "demi half gros grosse petit petite petits grand grande grands big small "
    "de du des la le les of the et and pour for au aux "
    "vente ventes vendu sold sale sales cash momo om credit client customer"
).split()
# Words that a label leaves out.
UNIT_WORDS = (
    "tas kg seau seaux cageot cageots regime regimes sac sacs botte bottes paquet paquets pcs pc piece pieces litre litres "
    "bidon bidons verre verres cuvette cuvettes boite boites pack packs carton cartons unit units bunch bunches heap heaps "
    "basket baskets bag bags tin tins cup cups packet packets bar bars bol bols assiette assiettes x f fcfa frs fr"
).split()
# Patterns of phone numbers in texts.
PHONE_IN_TEXT = r"\(?\+?237\)?[\s.]?6\d{8}\b\)?|\b6\d{8}\b"


# Latin, Greek and Cyrillic blocks of Unicode, with the letterlike signs that decompose.
_BLOCKS = ((0xC0, 0x300), (0x370, 0x530), (0x1E00, 0x2000), (0x2126, 0x212C), (0x2C60, 0x2C80), (0x2DE0, 0x2E00), (0xA640, 0xA6A0), (0xA720, 0xA800), (0xAB30, 0xAB70))
_MARKS = "\u0300-\u036f"


def _accented() -> tuple[str, str]:
    """Letters that decompose into a sign and marks, and that sign: each leaves exactly one."""
    bare = lambda x: "".join(y for y in unicodedata.normalize("NFD", x) if not "\u0300" <= y <= "\u036f")
    pairs = [(x, bare(x)) for a, b in _BLOCKS for x in map(chr, range(a, b)) if bare(x) != x]
    return "".join(x for x, _ in pairs), "".join(y for _, y in pairs)


_FROM, _TO = _accented()


def strip_accents(c: Column) -> Column:
    """Latin, Greek and Cyrillic letters without their marks, as after full decomposition; loose combining marks go. ASCII texts, told by their length, have none."""
    bare = lambda s: F.when(F.octet_length(s) == F.char_length(s), s).otherwise(F.regexp_replace(F.translate(s, _FROM, _TO), f"[{_MARKS}]", ""))
    return let(c, bare)


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_item(description: Column) -> Column:
    """Up to three words that tell items apart, for grouping: plain lower-case letters, plural s dropped; "other" for null or if none is left."""
    plain = F.regexp_replace(strip_accents(F.lower(description)), r"[^a-z\s]", " ")
    words = F.filter(F.split(plain, r"\s+"), lambda w: (F.length(w) > 1) & ~w.isin(NOISE))
    words = F.transform(words, lambda w: F.when(F.length(w) > 3, F.regexp_replace(w, "s$", "")).otherwise(w))
    return F.coalesce(F.nullif(F.array_join(F.slice(words, 1, 3), " "), F.lit("")), F.lit("other"))


def clean_label(description: Column) -> Column:
    """What a screen calls an item: the description's own words but for amounts and measures, capitalised; all of it if none is left."""
    parts = F.split(F.regexp_replace(description, r"(?i)[×x]?\d+([.,]\d+)?[a-z]?\b", " "), r"(?U)\s+")
    word = lambda w: F.regexp_replace(strip_accents(F.lower(w)), "[^a-z]", "")
    kept = F.filter(parts, lambda w: (w != "") & ~word(w).isin(UNIT_WORDS))
    label = F.coalesce(F.nullif(F.trim(F.array_join(kept, " ")), F.lit("")), F.trim(description))
    return F.concat(F.upper(F.substring(label, 1, 1)), F.substring(label, F.lit(2), F.length(label)))


def mask_phone(phone: Column) -> Column:
    """First and last two of the last nine digits; null unless there are nine."""
    d = F.regexp_extract(F.regexp_replace(phone, r"\D", ""), r"(\d{9})$", 1)
    return F.when(d != "", F.concat(F.left(d, F.lit(1)), F.lit("•• ••• •"), F.right(d, F.lit(2))))


def mask_phones_in_text(c: Column) -> Column:
    """Phone numbers inside a text, masked."""
    return F.regexp_replace(c, r"(?:\(?\+?237\)?[\s.]?(6)\d{6}(\d{2})\b\)?)|(?:\b(6)\d{6}(\d{2})\b)", "$1$3•• ••• •$2$4")


def normalize_phone(phone: Column) -> Column:
    """The digits of a number, without a leading 237 if nine digits follow it."""
    d = F.regexp_replace(phone, r"\D", "")
    return F.when((F.length(d) == 12) & d.startswith("237"), F.right(d, F.lit(9))).otherwise(d)


def is_phone(phone: Column) -> Column:
    """Whether the normalised number has nine digits and begins with 6 or 2."""
    return F.coalesce(normalize_phone(phone).rlike(r"^[62]\d{8}$"), F.lit(False))


def short_name(name: Column) -> Column:
    """First name and the initial of the next; null for null and empty names."""
    parts = F.split(F.trim(name), r"\s+")
    many = F.concat(F.get(parts, F.lit(0)), F.lit(" "), F.left(F.get(parts, F.lit(1)), F.lit(1)), F.lit("."))
    return F.when(F.coalesce(name, F.lit("")) != "", F.when(F.size(parts) > 1, many).otherwise(F.get(parts, F.lit(0))))


def normalize_share_code(c: Column) -> Column:
    """Upper-case code with the prefix and separators in place; null unless eight signs are left."""
    bare = F.regexp_replace(F.regexp_replace(F.upper(c), "[^A-Z0-9]", ""), "^TR(?=.{8}$)", "")
    return F.when(F.length(bare) == 8, F.concat(F.lit("TR-"), F.left(bare, F.lit(4)), F.lit("-"), F.right(bare, F.lit(4))))


def is_id(c: Column, prefix: str | None = None) -> Column:
    """Whether an id has the prefix (or any of two or three letters), an underscore and 6 to 24 small letters and digits; false for null."""
    return F.coalesce(c.rlike(rf"^{prefix or '[a-z]{2,3}'}_[0-9a-z]{{6,24}}\z"), F.lit(False))


def matches_search(columns: list[Column], query: str) -> Column:
    """Whether the columns, joined by spaces, contain the query regardless of case and accents; an empty query matches all."""
    if not query.strip():
        return F.lit(True)
    plain = lambda c: strip_accents(F.lower(c))
    return plain(F.concat_ws(" ", *columns)).contains(plain(F.lit(query.strip())))
