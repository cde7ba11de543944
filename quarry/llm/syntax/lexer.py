"""Shapes: source text with identifiers, numbers and strings reduced to their kind, line by line.

Two passes of compiled patterns do it: the first replaces comments and literals, the second words and
numbers.  Line breaks inside comments and strings are kept, so shapes keep the line numbers.
"""

from __future__ import annotations

import re

# The reserved and contextual words of the languages.
PYTHON_WORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type"
ECMA_WORDS = "async await break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new return super switch this throw try typeof var void while with yield of get set static as from null true false enum"
TS_WORDS = ECMA_WORDS + " abstract accessor asserts declare implements infer interface is keyof module namespace override private protected public readonly satisfies type unique require global"
JAVA_WORDS = "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null var record sealed non permits yield when module"
GO_WORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"

DQ, SQ = r'"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*"', r"'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*'"
TRIPLE = r'"""[^"\\]*(?:(?:\\[\s\S]|"(?!""))[^"\\]*)*"""' + r"|'{3}[^'\\]*(?:(?:\\[\s\S]|'(?!''))[^'\\]*)*'{3}"
BLOCK = r"/\*[^*]*(?:\*(?!/)[^*]*)*\*/"
JAVA_TEXT = r'"""[ \t]*\n[^"\\]*(?:(?:\\[\s\S]|"(?!""))[^"\\]*)*"""'
FLAT_DQ = r'"[^"\\\n]*(?:\\.[^"\\\n]*)*"'
# Not the beginning of an unclosed triple quote.
PY_DQ, PY_SQ = '"(?!"")' + DQ[1:], "'(?!'')" + SQ[1:]
FIRST = {
    "python": re.compile(rf"#[^\n]*|\\\n|{TRIPLE}|{PY_DQ}|{PY_SQ}"),
    "ecma": re.compile(rf"//[^\n]*|{BLOCK}|{DQ}|{SQ}"),
    "java": re.compile(rf"//[^\n]*|{BLOCK}|{JAVA_TEXT}|{FLAT_DQ}" + r"|'(?:[^'\\\n]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\.)'"),
    "go": re.compile(rf"//[^\n]*|{BLOCK}|`[^`]*`|{FLAT_DQ}" + r"|'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|.))'"),
}
#: Runs of word characters.  Most texts have no number with a point or a signed exponent; for those that
#: have one, the second, slower pattern is used.
PLAIN_WORD = {"python": re.compile(r"([\w\x01]+)"), "ecma": re.compile(r"([\w$#\x01]+)"), "java": re.compile(r"([\w$\x01]+)"), "go": re.compile(r"([\w\x01]+)")}
DOTTED = re.compile(r"\.(?:\d|(?<=\d\.))")
EXPONENTS = ("e-", "e+", "E-", "E+", "p-", "p+", "P-", "P+")
WORD = {
    "python": re.compile(r"([.]?\d(?:[eE][+-]|[\w.])*|[\w\x01]+)"),
    "ecma": re.compile(r"([.]?\d(?:[eE][+-]|[\w.])*|[\w$#\x01]+)"),
    "java": re.compile(r"([.]?\d(?:(?:(?<![xX][0-9a-fA-F])[eE]|[pP])[+-](?=\d)|[\w.])*|[\w$\x01]+)"),
    "go": re.compile(r"([.]?\d(?:(?:(?<![xX][0-9a-fA-F])[eE]|[pP])[+-](?=\d)|[\w.])*|[\w\x01]+)"),
}
#: A long run of list elements is as valid as a short one.
RUN = re.compile(r"(?:[NS]\s*,\s*){8,}")
STRING_PREFIX = re.compile(r"[rR][bBfFtT]?|[bBfFtT][rR]?|[uU]")
_D, _H = r"\d(?:_?\d)*", r"[0-9a-fA-F](?:_?[0-9a-fA-F])*"
NUMBER = {
    "python": re.compile(rf"0[xX]_?{_H}|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:(?:{_D})?\.{_D}|{_D}\.?)(?:[eE][+-]?{_D})?[jJ]?"),
    "ecma": re.compile(rf"0[xX]{_H}n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|(?:0|[1-9](?:_?\d)*)n|(?:\.{_D}|(?:0|[1-9](?:_?\d)*)(?:\.(?:{_D})?)?)(?:[eE][+-]?{_D})?"),
    "java": re.compile(rf"0[xX][0-9a-fA-F](?:_*[0-9a-fA-F])*[lL]?|0[bB][01](?:_*[01])*[lL]?|0[xX][0-9a-fA-F.]*[pP][+-]?\d+[fFdD]?|0(?:_*[0-7])*[lL]?|[1-9](?:_*\d)*[lL]?|(?:\d(?:_*\d)*\.?(?:\d(?:_*\d)*)?|\.\d(?:_*\d)*)(?:[eE][+-]?\d+)?[fFdD]?"),
    "go": re.compile(rf"(?:0[xX]_?{_H}|0[oO]?(?:_?[0-7])+|0[bB](?:_?[01])+|(?:{_D}\.?(?:{_D})?|\.{_D})(?:[eE][+-]?{_D})?|0[xX][0-9a-fA-F_.]*[pP][+-]?\d+)i?"),
}
PY_ZEROS = re.compile(r"0[0_]*[1-9][\d_]*")
LANGUAGES = {"python": ("python", PYTHON_WORDS), "javascript": ("ecma", ECMA_WORDS), "typescript": ("ecma", TS_WORDS), "java": ("java", JAVA_WORDS), "go": ("go", GO_WORDS)}


class _Words(dict):
    """word -> its kind; remembers at most 200,000 words, then starts again."""

    def __init__(self, family: str, words: str):
        super().__init__()
        self.keep, self.number, self.family = frozenset(words.split()), NUMBER[family], family

    def __missing__(self, word: str) -> str:
        if len(self) > 200_000:
            self.clear()
        if word[-1] == "\x01":
            rest = word[:-1]
            kind = "\x01" if not rest or (self.family == "python" and STRING_PREFIX.fullmatch(rest)) else f"{self[rest]} \x01"
        elif word[0].isdigit() or (word[0] == "." and len(word) > 1):
            if self.family == "ecma" and word.endswith("..") or not self.number.fullmatch(word) or (self.family == "python" and PY_ZEROS.fullmatch(word)):
                kind = "X "
            else:
                kind = "N "
        elif "#" in word[1:]:
            kind = "X "
        else:
            kind = word if word in self.keep else "a"
        self[word] = kind
        return kind


_CACHE: dict[str, _Words] = {}


def _literal(m: re.Match) -> str:
    t = m[0]
    c = t[0]
    if c == "#" or (c == "/" and t[1] == "/"):
        return ""
    if c == "/":
        return " " if "\n" not in t else "\n" * t.count("\n")
    if c == "\\":
        return " \x02"
    return "\x01 " if "\n" not in t else "\x01 " + "\x02" * t.count("\n")


def shape(text: str, language: str) -> str:
    """The shape of ``text``.  Until words are replaced, ``\\x01`` stands for a string and ``\\x03`` for a bad lexeme.  ``\\x02`` marks a line break that lies inside a token (it ends no line)."""
    family, words = LANGUAGES[language]
    cached = _CACHE.get(language)
    if cached is None:
        cached = _CACHE[language] = _Words(family, words)
    if text[:1] == "﻿":
        text = text[1:]
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if family == "ecma":
        if text.startswith("#!"):
            text = "//" + text
        plain = "" if "`" in text else FIRST[family].sub(_literal, text)
        text = _ecma_literals(text) if "`" in text or "/" in plain else plain
    else:
        text = FIRST[family].sub(_literal, text)
    parts = (WORD if DOTTED.search(text) or any(x in text for x in EXPONENTS) else PLAIN_WORD)[family].split(text)
    parts[1::2] = map(cached.__getitem__, parts[1::2])
    text = "".join(parts).replace("\x01", "S").replace("\x03", "X")
    return RUN.sub(_run, text) if "N ," in text or "S ," in text or "S," in text or "N," in text else text


def _run(m: re.Match) -> str:
    """A shorter run with the same line breaks."""
    breaks = m[0].count("\n") + m[0].count("\x02")
    return "N , N ," + "\n" * breaks if breaks else "N , N ,"


_ECMA_PIECE = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|" + DQ + "|" + SQ + r"|`|/|[{}]|[^\W\d][\w$]*|\$[\w$]*|[.]?\d(?:[eE][+-]|[\w.])*|\s+|.")
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; + - * % < > ~ ^ return typeof case in of delete void throw new else do await yield".split())


def _ecma_literals(text: str) -> str:
    """Comments, strings, templates and regular expressions of a text that has slashes or backquotes.

    A template becomes ``S`` for its text and ``T( expression )T`` for each substitution.
    """
    out, i, before, depth = [], 0, "", []
    n = len(text)

    def template(i: int) -> int:
        m = _TEMPLATE.match(text, i)
        i = m.end()
        out.append("\x02" * m[0].count("\n"))
        if i >= n:
            out.append(" \x03 ")
            return n
        if text[i] == "`":
            out.append(" \x01 ")
            return i + 1
        out.append(" \x01 + ( ")
        depth.append(0)
        return i + 2

    while i < n:
        m = _ECMA_PIECE.match(text, i)
        t = m[0]
        c = t[0]
        if c == "`":
            tagged = before and (before[-1].isalnum() or before in ")]") and before not in _BEFORE_REGEX
            if tagged:
                out.append(".a")
            i = template(i + 1)
            before = "S"
            continue
        if c == "/" and len(t) == 1:
            r = _REGEX.match(text, i) if before == "" or before in _BEFORE_REGEX else None
            if r:
                out.append(" \x01 ")
                i, before = r.end(), "S"
                continue
        if depth and c in "{}" and len(t) == 1:
            if c == "{":
                depth[-1] += 1
            elif depth[-1]:
                depth[-1] -= 1
            else:
                depth.pop()
                out.append(" ) + ")
                i = template(i + 1)
                before = "S"
                continue
        i = m.end()
        if t.isspace():
            out.append(t)
        elif c in "\"'" and len(t) > 1 or (c == "/" and len(t) > 1):
            out.append(_literal(m))
            if c != "/":
                before = "S"
        else:
            out.append(t)
            before = t
    return "".join(out)
