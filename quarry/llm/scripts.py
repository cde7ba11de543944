"""Lines of a script beyond Latin and Cyrillic whose single-byte or double-byte encoding was read as another one.

Such a line shows runs that no word of correct text looks like.  It is encoded back with each wrong encoding
and decoded with each true one; a reading counts if it decodes without a fault and nearly all its characters
beyond ASCII are common ones of the script.  What is common comes from the standards themselves: national
double-byte sets keep frequent characters on their first level, in rows of their own.
"""

from __future__ import annotations

import re
from functools import lru_cache

# Of each script its encodings and the letters that make up nearly all of its texts, most frequent first.
ALPHABETS = {
    "hebrew": (("cp1255", "iso8859-8"), "יוהלאתמרבשנכעדחפקגסצטזםןךץף־"),
    "arabic": (("cp1256", "iso8859-6"), "اليمنترودبعسفهكقحجشصخطزضذثغظةىأإآءئؤ،؟؛"),
    "greek": (("cp1253", "iso8859-7"), "αοιετσνηυρπκμλςωδγχθφβξζψάέήίόύώΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ«»·"),
    "thai": (("cp874", "tis-620"), "".join(map(chr, range(0xE01, 0xE3B))) + "".join(map(chr, range(0xE40, 0xE4F)))),
}
# Double-byte encodings with the lead bytes of their first level and of their punctuation.
DOUBLE = {
    "euc_kr": ((0xB0, 0xC8), (0xA1, 0xA3)),
    "euc_jp": ((0xB0, 0xCF), (0xA1, 0xA5)),
    "shift_jis": ((0x88, 0x98), (0x81, 0x83)),
    "gbk": ((0xB0, 0xD7), (0xA1, 0xA3)),
    "big5": ((0xA4, 0xC6), (0xA1, 0xA3)),
}
#: Characters beyond ASCII that a reading needs, and the share of them that has to be common.
LEAST, SHARE = 6, 0.95
_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_KANA = re.compile("[ぁ-ヿ]")
_BEYOND = re.compile(r"[^\x00-\x7f]")
_LONG = re.compile(r"[^\x00-\x7f]{3,}|[^\x00-\x7f](?:[A-Za-z@-~]?[^\x00-\x7f]){2,}")


@lru_cache(1)
def _common() -> dict[str, frozenset[str]]:
    return {e: frozenset(letters) for encodings, letters in ALPHABETS.values() for e in encodings}


def _first_level(data: bytes, encoding: str, text: str) -> float:
    """Of the characters beyond ASCII the share that is first-level or punctuation; 0 where the script's own are missing."""
    (low, high), (mark_low, mark_high) = DOUBLE[encoding]
    total = good = own = 0
    for c in text:
        if c < "\x80":
            continue
        total += 1
        lead = c.encode(encoding)[0]
        first = low <= lead <= high
        good += first or mark_low <= lead <= mark_high
        own += bool(_KANA.match(c)) if encoding in ("euc_jp", "shift_jis") else first
    least = 0.2 if encoding in ("euc_jp", "shift_jis") else 0.6
    return good / total if total >= LEAST // 2 and own >= least * total else 0.0


def _reading(line: str, encoders: dict[str, dict[str, int]], wrongs: list[str]) -> tuple[str, str] | None:
    best: tuple[float, str, str] | None = None
    for wrong in wrongs:
        table = encoders[wrong]
        try:
            data = bytes(ord(c) if c < "\x80" else table[c] for c in line)
        except KeyError:
            continue
        if sum(map(len, _UTF8.findall(data))) >= 0.6 * sum(b >= 0x80 for b in data):
            return None  # UTF-8 read as another encoding, perhaps with bytes lost
        for order, encoding in enumerate([*_common(), *DOUBLE]):
            try:
                text = data.decode(encoding)
                beyond = _BEYOND.findall(text)
                if encoding in DOUBLE:
                    share = _first_level(data, encoding, text)
                else:
                    known = _common()[encoding]
                    share = sum(c in known for c in beyond) / len(beyond) if len(beyond) >= LEAST else 0.0
            except (UnicodeDecodeError, UnicodeEncodeError):
                continue
            value = share - 0.001 * order - 0.0001 * wrongs.index(wrong)
            if share >= SHARE and (best is None or value > best[0]):
                best = (value, text, f"{encoding}>{wrong}")
    return best and best[1:]


def restore_lines(text: str, encoders: dict[str, dict[str, int]], wrongs: list[str], plausible) -> tuple[str, int, set[str]]:
    """``text`` with its garbled lines of other scripts restored, how many there were, and the encodings."""
    odd = sorted({text.rfind("\n", 0, m.start()) + 1 for m in _LONG.finditer(text) if not plausible(m[0])})
    if not odd:
        return text, 0, set()
    out, at, used, n = [], 0, set(), 0
    for start in odd:
        end = text.find("\n", start)
        line = text[start : end if end >= 0 else len(text)]
        runs = _LONG.findall(line)
        total = sum(map(len, runs))
        if total >= LEAST and sum(len(r) for r in runs if not plausible(r)) * 2 > total:
            found = _reading(line, encoders, wrongs)
            if found:
                out += [text[at:start], found[0]]
                at = start + len(line)
                n += 1
                used.add(found[1])
    return "".join([*out, text[at:]]), n, used
