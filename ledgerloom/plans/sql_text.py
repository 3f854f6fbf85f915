"""Text functions as SQL, for the queries' SQL: made from the Unicode data, not from the engine's own functions."""

from __future__ import annotations

import sys
import unicodedata

_WS = "[\\x09-\\x0d\\x20\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Entities that the SQL decodes, the ampersand last.
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&apos;": "'", "&nbsp;": "\u00a0", "&amp;": "&"}


def _compatible() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters with one compatible character, those characters, and characters with several."""
    one, to, several = [], [], []
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp < 0xE000 or 0xAC00 <= cp < 0xD7A4:
            continue
        ch = chr(cp)
        form = unicodedata.ucd_3_2_0.normalize("NFKC", ch)
        if form != ch and len(form) == 1:
            one.append(ch)
            to.append(form)
        elif form != ch and "LATIN" in unicodedata.name(ch, "") or form != ch and cp in (0x2026, 0x2122, 0x2116, 0xBC, 0xBD, 0xBE, 0xE33, 0xEB3):
            several.append((ch, form))
    return "".join(one), "".join(to), several


_ONE, _TO, _SEVERAL = _compatible()


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def nfkc(x: str) -> str:
    """Compatibility normal form of letters and signs of one character, of Latin ligatures, two vowels and some signs."""
    out = f"translate({x}, {literal(_ONE)}, {literal(_TO)})"
    for ch, form in _SEVERAL:
        out = f"replace({out}, {literal(ch)}, {literal(form)})"
    return f"CASE WHEN regexp_matches({x}, '[^\\x00-\\x7f]') THEN nfc_normalize({out}) ELSE {x} END"


def flat(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}', ' ', 'g'))"


def unescaped(x: str) -> str:
    out = x
    for entity, ch in _ENTITIES.items():
        out = f"replace({out}, {literal(entity)}, {literal(ch)})"
    return out


def ascii_lower(x: str) -> str:
    return f"translate({x}, '{_UPPER}', '{_UPPER.lower()}')"


def duplicate_key(x: str) -> str:
    """What texts.duplicate_text_key() is."""
    return ascii_lower(unescaped(flat(nfkc(x))))


def words(x: str) -> str:
    return f"CASE WHEN {flat(x)} = '' THEN 0 ELSE len(string_split({flat(x)}, ' ')) END"
