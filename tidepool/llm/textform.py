"""Consistent form of a text: visible characters, one width, one composition, ordinary spaces, one letter per look-alike.

Letter case, accents and punctuation marks are kept. ``consistent`` is the one definition of the mapping.
"""

from __future__ import annotations

import unicodedata

# Cyrillic, Greek and Armenian letters that can't be told from a Latin letter in print, with their Latin twins.
LOOKALIKES = {
    "\u0430": "a", "\u0435": "e", "\u043e": "o", "\u0440": "p", "\u0441": "c", "\u0443": "y", "\u0445": "x", "\u0456": "i", "\u0458": "j", "\u0455": "s", "\u0475": "v",
    "\u04bb": "h", "\u0501": "d", "\u051b": "q", "\u051d": "w", "\u04cf": "l", "\u0410": "A", "\u0412": "B", "\u0415": "E", "\u041a": "K", "\u041c": "M", "\u041d": "H",
    "\u041e": "O", "\u0420": "P", "\u0421": "C", "\u0422": "T", "\u0423": "Y", "\u0425": "X", "\u0406": "I", "\u0408": "J", "\u0405": "S", "\u04ba": "H", "\u051a": "Q",
    "\u051c": "W", "\u04c0": "I",
    "\u0391": "A", "\u0392": "B", "\u0395": "E", "\u0396": "Z", "\u0397": "H", "\u0399": "I", "\u039a": "K", "\u039c": "M", "\u039d": "N", "\u039f": "O", "\u03a1": "P",
    "\u03a4": "T", "\u03a5": "Y", "\u03a7": "X", "\u03bf": "o", "\u03f2": "c", "\u03f3": "j",
    "\u0585": "o", "\u0570": "h", "\u057d": "u", "\u0581": "g", "\u0555": "O", "\u054f": "S",
}
# Hyphens that only differ in how a line may break, and the minus sign.
HYPHENS = dict.fromkeys(map(chr, (0x2010, 0x2011, 0xFE63, 0x2212)), "-")
# Blank characters other than the ordinary space; tab and line ends are kept as they are.
SPACES = "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))
# Ranges of what isn't seen: controls, format characters, fillers, variation selectors, tags.
UNSEEN = (
    (0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x9F), (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5),
    (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0xE0000, 0xE007F), (0xE0100, 0xE01EF),
)
DROPPED = frozenset(c for a, b in UNSEEN for c in range(a, b + 1))
#: Letters with accents (Greek and Cyrillic blocks) whose base has a Latin twin, by rule.
ACCENTED = {chr(c): LOOKALIKES[d[0]] + d[1:] for c in range(0x370, 0x530) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0] in LOOKALIKES}
_TABLE: dict[int, str | None] = {
    **{ord(a): b for a, b in ACCENTED.items()},
    **{ord(a): b for a, b in (LOOKALIKES | HYPHENS).items()},
    **{ord(a): " " for a in SPACES},
    **dict.fromkeys(DROPPED),
}


def consistent(text: str | None) -> str | None:
    """The consistent form; null stays null, an invisible text becomes empty."""
    if text is None:
        return None
    if text.isascii():
        return text if text.isprintable() else text.translate(_TABLE)
    text = unicodedata.normalize("NFKC", text).translate(_TABLE)
    return unicodedata.normalize("NFC", text)
