"""One form for texts that look the same: the confusables skeleton, and words taken from it."""

from __future__ import annotations

import re
import unicodedata
from functools import cache, lru_cache

# Letters of other scripts with the shape of a Latin letter, then kana and kanji of one shape.
LOOKALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s",
    "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y", "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I",
    "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "Ү": "Y", "Ӏ": "I",
    "α": "a", "ι": "i", "ϳ": "j", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "γ": "y", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z",
    "Η": "H", "Ι": "I", "Ϳ": "J", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Օ": "O", "Ս": "U", "Տ": "S", "Լ": "L",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ꞌ": "'",
    "ヘ": "へ", "エ": "工", "カ": "力", "タ": "夕", "ト": "卜", "ニ": "二", "ハ": "八", "ロ": "口", "ー": "一", "ノ": "丿",
}
# Characters drawn as a hyphen, and as nothing at all (besides the category Cf).
HYPHENS = "‐‑‒–⁃˗−﹣－"
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠎ㅤﾠ"


@cache
def prototypes() -> dict[int, str | None]:
    """Code point to what stands for it: look-alikes by the table above, width forms, ligatures, blanks and invisible
    characters by their Unicode properties."""
    table: dict[int, str | None] = {}
    for cp in range(0xA0, 0x20000):
        ch = chr(cp)
        kind, parts = unicodedata.category(ch), unicodedata.decomposition(ch).split()
        if kind == "Cf" or 0xFE00 <= cp <= 0xFE0F:
            table[cp] = None
        elif kind == "Zs":
            table[cp] = " "
        elif parts and parts[0] in ("<wide>", "<narrow>"):
            table[cp] = chr(int(parts[1], 16))
        elif len(parts) > 2 and parts[0] == "<compat>":
            letters = unicodedata.normalize("NFKD", ch)
            if letters.isalpha() and kind[0] == "L":
                table[cp] = letters
    table |= {cp: None for cp in [*map(ord, INVISIBLE), *range(0xE0000, 0xE0080), *range(0xE0100, 0xE01F0)]}
    table |= {ord(ch): "-" for ch in HYPHENS}
    table |= {ord(ch): to for ch, to in LOOKALIKES.items()}
    for cp, to in list(table.items()):  # a width form of a look-alike, a ligature of one
        if to and any(ord(x) in table for x in to):
            table[cp] = "".join(table.get(ord(x), x) or "" for x in to)
    return table | {cp: None for cp in [*range(9), *range(14, 32), 11, 12, 13, 127]} | {9: " "}


_foreign = re.compile(r"[^ -~\n]+")


def _replaced(run: str) -> str:
    table = prototypes()
    return "".join([table.get(ord(ch), ch) or "" for ch in unicodedata.normalize("NFD", run)])


_short = lru_cache(maxsize=50_000)(_replaced)


def _mapped(found: re.Match) -> str:
    run = found[0]
    return _short(run) if len(run) < 4 else _replaced(run)


def skeleton_sql(text: str) -> str:
    """The skeleton, accents composed, as an SQL expression for reference queries."""
    table = {chr(cp): to for cp, to in prototypes().items() if cp != 10 and chr(cp) != to}
    singles = {ch: to for ch, to in table.items() if to and len(to) == 1}
    several = {ch: to for ch, to in table.items() if to and len(to) > 1}
    # letters composed of a look-alike and accents
    composed = {chr(cp): unicodedata.normalize("NFD", chr(cp)) for cp in range(0xA0, 0x20000) if chr(cp) not in table}
    several |= {ch: "".join(table.get(x, x) or "" for x in parts) for ch, parts in composed.items() if len(parts) > 1 and any(x in table for x in parts)}
    gone = [ch for ch, to in table.items() if not to]
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    plain = lambda chars: quoted("".join(c for c in chars if ord(c) > 31 and ord(c) != 127))
    special = [c for c in gone if 0 < ord(c) < 32 or ord(c) == 127]
    out = f"translate({text}, {plain([*singles, *gone])}, {plain(singles.values())})"
    for ch in special:
        out = f"replace({out}, chr({ord(ch)}), '')"
    out = f"replace({out}, chr(9), ' ')"
    for ch, to in several.items():
        out = f"replace({out}, {quoted(ch)}, {quoted(to)})"
    return f"nfc_normalize({out})"


def skeleton(text: str) -> str:
    """Decompose, replace every character by its prototype, decompose again.

    Runs of printable ASCII stand for themselves and are their own decomposition, so only the runs between them are
    looked at; the last decomposition puts marks that meet over a removed character in order.
    """
    once = _foreign.sub(_mapped, text)
    return once if once.isascii() else unicodedata.normalize("NFD", once)


def folded(text: str) -> str:
    """The skeleton with accents composed: a key by whose words texts are compared, not a text to give out."""
    once = _foreign.sub(_mapped, text)
    return once if once.isascii() else unicodedata.normalize("NFC", once)


# Kana with the kanji of one shape; of these the numerals, and marks that only kana carry.
TWINS = dict(zip("エカタトニハロー" + "ノ", "工力夕卜二八口一" + "丿"))
NUMERALS, VOICED = "ニ二ハ八ー一", "\u3099\u309a"
_kanji_twins = {v: k for k, v in TWINS.items()}
_twin = re.compile("[" + "".join(TWINS) + "".join(_kanji_twins) + "]")
_he = re.compile("[ヘへ]")
_cross = re.compile("[" + "".join(k for k in LOOKALIKES if k not in TWINS and k != "ヘ") + "]")
_letters = re.compile(r"(?:[^\W\d_]|[\u0300-\u036f])+")
_turkish = re.compile("g\u0306|s\u0327|I\u0307", re.IGNORECASE)


@cache
def _plain() -> dict[int, str | None]:
    """The prototypes without those that change a letter's script."""
    wide = {cp for cp, to in prototypes().items() if unicodedata.normalize("NFKC", chr(cp)) in LOOKALIKES}
    return {cp: to for cp, to in prototypes().items() if chr(cp) not in LOOKALIKES and cp not in wide} | {cp: unicodedata.normalize("NFKC", chr(cp)) for cp in wide if chr(cp) not in LOOKALIKES}


@cache
def script_of(ch: str) -> str:
    name = unicodedata.name(ch, "").split(" ")[0]
    return name if name in ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN") else ""


@cache
def _letters_of(script: str) -> dict[str, str]:
    """Latin letters with the letter of the script that has their shape, the commonest if there are several."""
    return {to: ch for ch, to in reversed(LOOKALIKES.items()) if script_of(ch) == script}


def _anchors(letters: str) -> dict[str, int]:
    """Letters by script, of those that no other script has: a look-alike put in their place would be seen."""
    found: dict[str, int] = {}
    for ch in letters:
        script = script_of(ch)
        if script and (ch not in LOOKALIKES if script != "LATIN" else ch not in _letters_of("CYRILLIC") and ch not in _letters_of("GREEK")):
            found[script] = found.get(script, 0) + 1
    return found


def _one_script(text: str) -> str:
    whole: dict[str, int] = {}

    def word(found: re.Match) -> str:
        letters = found[0]
        if not _cross.search(letters) and (letters.isascii() or not any(script_of(x) not in ("LATIN", "") for x in letters)):
            return letters
        mine = _anchors(letters)
        if not mine and not whole:
            whole.update(_anchors(text) or {"LATIN": 1})
        target = max(mine or whole, key=(mine or whole).get)
        scripts = {script_of(x) for x in letters} - {""}
        if scripts == {target} and target != "LATIN":
            return letters
        back = _letters_of(target) if target != "LATIN" else {}
        return "".join(x if script_of(x) == target and target != "LATIN" else back.get(to := LOOKALIKES.get(x, x), to if target == "LATIN" else x) for x in letters)

    dotless = bool(_turkish.search(text))
    out = _letters.sub(word, text.replace("ı", "\0") if dotless else text)
    return out.replace("\0", "ı")


def _katakana(ch: str) -> bool:
    return "\u30a1" <= ch <= "\u30fe" and ch != "・"


def _twins(text: str) -> str:
    """Kana and kanji of one shape, as the nearest letters that have no twin show; unchanged if these don't agree."""

    def beside(at: int, step: int) -> str:
        at += step
        while 0 <= at < len(text) and (text[at] in VOICED or text[at] in TWINS or text[at] in _kanji_twins):
            at += step
        return text[at] if 0 <= at < len(text) else ""

    def one(found: re.Match) -> str:
        ch, at = found[0], found.start()
        kana = ch if ch in TWINS else _kanji_twins[ch]
        if text[at + 1 : at + 2] and text[at + 1] in VOICED:
            return kana
        left, right = beside(at, -1), beside(at, 1)
        kanas, kanjis = _katakana(left) + _katakana(right), ("\u4e00" <= left <= "\u9fff") + ("\u4e00" <= right <= "\u9fff")
        if kanas and not kanjis and (ch not in NUMERALS or kanas == 2 or not right.isalnum()):
            return kana
        return TWINS[kana] if kanjis and not kanas else ch

    def he(found: re.Match) -> str:
        after = text[found.end() :].lstrip(VOICED)[:1] if found.end() < len(text) and text[found.end()] in VOICED else text[found.end() : found.end() + 1]
        if _katakana(after):
            return "ヘ"
        before = text[: found.start()].rstrip(VOICED)[-1:] if text[found.start() - 1 : found.start()] in VOICED else text[max(0, found.start() - 1) : found.start()]
        return found[0] if _katakana(before) and not "\u3041" <= after <= "\u309f" else "へ"

    text = _twin.sub(one, text)
    return _he.sub(he, text)


def canonical(text: str) -> str:
    """The one form in which texts are given out: width forms, ligatures, blanks, hyphens and invisible characters as in
    the skeleton, accents composed, and each word in one script.

    A word takes the script of its letters that no other script has, a word without such letters that of the text's; so
    words of one script stay as they are, and a look-alike among them is replaced. Kana and kanji of one shape follow
    their neighbours. The skeleton of the result is that of the text.
    """
    if text.isascii():
        return _foreign.sub(_mapped, text)
    table = _plain()
    once = _foreign.sub(lambda m: "".join([table.get(ord(ch), ch) or "" for ch in unicodedata.normalize("NFD", m[0])]), text)
    if once.isascii():
        return once
    if _cross.search(once) or any(script_of(x) not in ("LATIN", "") for x in set(once)):
        once = _one_script(once)
    if _twin.search(once) or _he.search(once):
        once = _twins(once)
    return unicodedata.normalize("NFC", once)


_word = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits, in lower case."""
    return _word.findall(text.lower())
