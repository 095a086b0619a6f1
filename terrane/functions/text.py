"""Folding, tokens and the text rules of the call log."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

AI_COLLATION = "UNICODE_CI_AI"

#: Letters that fold to more than one character.
_EXPANSIONS = {"ß": "ss", "ĳ": "ij", "ŉ": "ʼn", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl"}


def _fold_table() -> tuple[str, str]:
    """Lower-case letters of the basic plane with marks or a wide form -> bare letter; combining marks -> nothing."""
    source, target, marks = [], [], []
    for code in (c for c in range(0x00AA, 0x10000) if not 0xD800 <= c < 0xE000):
        char = chr(code)
        if unicodedata.combining(char):
            marks.append(char)
            continue
        bare = "".join(ch for ch in unicodedata.normalize("NFKD", char) if not unicodedata.combining(ch)).casefold()
        if len(bare) == 1 and bare != char and bare.isalnum():
            source.append(char)
            target.append(bare)
    return "".join(source + marks), "".join(target)


_FROM, _TO = _fold_table()


def fold(text: Column) -> Column:
    """Lower case without accents. Text of ASCII alone has none, so it is not searched for them."""
    folded = F.lower(text)
    for letter, plain in _EXPANSIONS.items():
        folded = F.replace(folded, F.lit(letter), F.lit(plain))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(folded, _FROM, _TO))


def contains_folded(text: Column, needle: str) -> Column:
    """Accent- and case-insensitive substring test."""
    return F.contains(F.collate(text, AI_COLLATION), F.collate(F.lit(needle), AI_COLLATION))


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits."""
    return F.array_remove(F.split(fold(text), r"[^\p{L}\p{N}]+"), "")


def stem(term: Column) -> Column:
    """Drop a final `s` from terms longer than three letters."""
    plural = (F.length(term) > 3) & term.endswith("s")
    return F.when(plural, F.left(term, F.length(term) - 1)).otherwise(term)


def shorten(text: Column, size: int = 300) -> Column:
    return F.when(F.char_length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("…"))).otherwise(text)


# How a reply text begins for each call status.
REPLY_PREFIXES = {
    "quota": ("Erreur : quota",),
    "burst": ("Erreur : trop d'appels",),
    "empty": ("Aucun", "Erreur"),
}


def call_status(reply: Column, error_type: Column | None = None) -> Column:
    """Status class of a call from the beginning of its reply."""
    status = F.when(error_type.isNotNull(), F.concat(F.lit("error:"), error_type)) if error_type is not None else None
    for name, prefixes in REPLY_PREFIXES.items():
        for prefix in prefixes:
            test = reply.startswith(prefix)
            status = F.when(test, name) if status is None else status.when(test, name)
    return status.otherwise("ok")


def client_label(kind: Column, ident: Column) -> Column:
    """Pseudonym of a client: its kind and ten hex digits of a SHA-256."""
    return F.concat(kind, F.lit(":"), F.substring(F.sha2(ident, 256), 1, 10))


def forwarded_address(peer: Column, forwarded: Column, hops: int) -> Column:
    """The `hops`-th address from the right of the forwarded chain, else the peer."""
    chain = F.filter(F.transform(F.split(F.coalesce(forwarded, F.lit("")), ","), lambda t: F.trim(t)), lambda a: a != "")
    if hops <= 0:
        return F.coalesce(peer, F.lit("unknown"))
    picked = F.element_at(chain, -F.least(F.lit(hops), F.size(chain)))
    return F.when(F.size(chain) > 0, picked).otherwise(F.coalesce(peer, F.lit("unknown")))
