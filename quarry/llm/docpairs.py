"""Functions paired with their documentation, by island grammars.

Of each file only islands are parsed: comments and strings (one scan of the language's lexical grammar,
so that a comment mark inside a string is none), the annotations and tool directives above a declaration,
the declaration's signature up to its balanced end, and in Python the docstring behind it.  All other
code is water and skipped.  Symbols say where declarations begin; their own documentation and signature
columns are not used.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.syntax import lexer

EXTENSIONS = {"py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go"}
_LITERALS = {**lexer.FIRST, "ecma": re.compile(lexer.FIRST["ecma"].pattern + r"|`(?:[^`\\]|\\[\s\S])*`")}
#: Line continuations are no island; only the Python pattern has them.
_NEWLINES = re.compile(r"\r\n|\r|\n")

_STOP = re.compile(r"[()\[\]{}\"'`/#:;=\r\n]")
_BRACKET = re.compile(r"[()\[\]{}\"'`/#]")

# What directives for tools begin with.
DIRECTIVE = re.compile(
    r"(?:eslint\b|eslint-|tslint:|jshint\b|jslint\b|prettier-ignore|istanbul ignore|c8 ignore|v8 ignore|@ts-\w+|ts-ignore|biome-ignore|stylelint-|webpackIgnore|flow\b\s*$|@flow\b|noqa\b|type:\s*ignore|pylint:|pragma\b|mypy:|ruff:|flake8|isort:|fmt:|yapf:|black:|pyright:|nosec\b|coverage:|"
    r"nolint\b|go:\w+|\+build\b|lint:|revive:|CHECKSTYLE|NOPMD|NOSONAR|noinspection\b|@formatter|formatter:|spotless:|SuppressWarnings|SPDX-|sourceMappingURL|language=|region\b|endregion\b|#region|#endregion|line \d|cspell:|codespell|spell-checker|skipcq|deepcode|NOLINT|clang-format|export \w+$)",
    re.I,
)
# Texts that stand for documentation yet to be written.
PLACEHOLDER = re.compile(
    r"(?:to ?do|fixme|xxx|tbd|tba|tbc|n/?a|wip|none|undocumented|no (?:docs?|documentation|description|comment)s?(?: (?:yet|available|provided|here))?|(?:missing|empty|no) (?:docs?|docstring|javadoc|description)|"
    r"(?:add|write|insert|put|your|enter) (?:a |some |the )?(?:docs?|docstring|documentation|description|comment|javadoc|summary|text)s?(?: here)?|(?:docs?|documentation|description|docstring|comment|summary|placeholder)(?: (?:here|goes here|to follow|pending|missing|needed|tbd))?|"
    r"auto-?generated (?:method|function|constructor|class) stub|\{?@?inherit ?doc\}?|see (?:above|below)|lorem ipsum.*|stub|document(?: me| this)?|to be (?:documented|done|written|defined|added)|needs? (?:docs?|documentation))",
    re.I,
)
_TODO = re.compile(r"(?:todo|fixme|xxx|hack)\b\s*(?:\([^)]*\))?\s*[:\-]?\s*(.*)", re.I | re.S)
_TAG = re.compile(r"(?:[@:\\](?:param|parameter|arg|argument|type|keyword|return|returns|rtype|raise|raises|throws|exception|yield|yields|since|author|version|see|deprecated|async|public|private|protected|static|override|template|typedef|property|prop|access|function|method|name|memberof|class)\b|[-*]\s+`?[\w.]+`?\s*(?:\([^)]*\))?:)", re.I)
#: Where a further tag begins on the same line.
_NEXT_TAG = re.compile(r"\s+(?=[@:](?:param|arg|type|returns?|rtype|raises?|throws|exception)\b)", re.I)
_SECTION = re.compile(r"(?:args|arguments|parameters|params|returns?|raises|yields|throws|notes?|examples?)\s*:?\s*", re.I)
_WORDS = re.compile(r"[^\W\d_]+")
# Words that say nothing beside the name.
EMPTY_WORDS = frozenset("a an the this that is are of to for and function method procedure routine constructor helper operation call class member handler implementation def func it its".split())


def cleaned(raw: str) -> list[str]:
    """The lines of a comment or docstring without comment marks and surrounding blanks."""
    out = []
    for line in _NEWLINES.split(raw):
        line = line.strip()
        if line.startswith("/*"):
            line = line[2:].lstrip("*!")
        if line.endswith("*/"):
            line = line[:-2].rstrip("*")
        line = re.sub(r"^(?:///?!?|#+!?|\*+(?!\w*\*))\s?", "", line.strip()).strip()
        out.append(line)
    return out


def name_words(name: str) -> list[str]:
    """The lower-cased words of an identifier."""
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)] or [name.lower()]


def _stem(word: str) -> str:
    """A crude stem: enough to equate inflections of one word."""
    for _ in range(3):  # "expands" and "expand" both lose "s" and "d"
        for end in ("ations", "ation", "ings", "ing", "iest", "ies", "ied", "ier", "ers", "er", "ors", "or", "ed", "es", "s", "ly", "d"):
            if word.endswith(end) and len(word) - len(end) >= 3:
                word = word[: -len(end)]
                break
        else:
            break
    if len(word) > 3 and word[-1] == word[-2]:
        word = word[:-1]
    return word.rstrip("eyi") or word


def only_name(text: str, name: str) -> bool:
    """Does ``text`` only repeat the words of ``name``, inflected or with empty words?"""
    words = [w for part in _WORDS.findall(text) for w in name_words(part)]
    own = {_stem(w) for w in name_words(name)} | {name.lower(), _stem(name.lower())}
    rest = [w for w in words if w not in EMPTY_WORDS]
    return bool(words) and all(w in own or _stem(w) in own for w in rest)


_CODE = [
    re.compile(r"[\w.\[\]]+\s*(?::=|[-+*/%|&^]?=(?![=>]))\s*\S.*"),
    re.compile(r"(?:(?:return|await|throw|raise|yield|delete|del|import|assert)\s+)?[\w.]+\([^()]*(?:\([^()]*\)[^()]*)*\)(?:\.\w+\(.*\))*\s*[;:{]?"),
    re.compile(r"(?:if|for|while|switch|elif|else if|catch|except|with)\b\s*\(?.*[\w)\]\"']\)?\s*[{:]"),
    re.compile(r"(?:return|throw|raise|break|continue|pass|yield)(?:\s+[\w.\"'()\[\]+\-*/, ]+)?;?"),
    re.compile(r"(?:const|let|var|final|int|long|float|double|boolean|bool|string|String|static|private|public)\s+[\w<>\[\], ]+\s*(?:=.*|;)"),
    re.compile(r"(?:def|func|function|class)\s+\w+.*[:{(]"),
    re.compile(r"(?:import|from)\s+[\w.]+(?:\s+import\s+.*)?;?|import\s+.*[\"'].*"),
    re.compile(r"[{}()\[\];,\s]+|(?:else|try|finally|do)\s*[{:]|\}\s*else\s*\{?"),
    re.compile(r".*[;{]\s*$"),
]


def is_code(line: str) -> bool:
    """Does a comment's line look like a statement that was commented out?"""
    if not line:
        return False
    if line.endswith((".", "!", "?")) and not line.endswith(("().", "...")):
        return False
    return any(p.fullmatch(line) for p in _CODE)


def is_trivial(lines: list[str], name: str) -> bool:
    """Is a documentation, given as cleaned lines, without content?

    It is if what remains is blank, punctuation or a heading, a placeholder, directives, commented-out
    code, tags without words, or no more than the words of the function's name.
    """
    kept = [x for x in lines if x and _WORDS.search(x) and not DIRECTIVE.match(x)]
    if not kept:
        return True
    text = []
    code = 0
    for line in [part for x in kept for part in _NEXT_TAG.split(x)]:
        m = _TAG.match(line)
        if m:
            # a tag's own words count if they say more than the parameter's name
            rest = line[m.end() :].strip()
            rest = re.sub(r"^(?:\{[^}]*\}\s*)?", "", rest)
            m = re.match(r"`?\[?(\w+)\]?`?\s*:?\s*[-–]?\s*(.*)", rest) if line[0] in "@:\\" and re.match(r".(?:param|arg|type|keyword|raise|throw|exc|prop|parameter)", line, re.I) else None
            if m:
                words = m[2]
                if words and not only_name(words, m[1]):
                    text.append(words)
            elif line[0] in "-*":
                own = re.match(r"[-*]\s+`?([\w.]+)`?\s*(?:\([^)]*\))?:\s*(.*)", line)
                if own[2] and not only_name(own[2], own[1]):
                    text.append(own[2])
            elif _WORDS.search(rest):
                text.append(rest)
            continue
        if _SECTION.fullmatch(line):
            continue
        if re.fullmatch(r"[-=*#~_+<>/\s]{2,}[^-=*#~_]*[-=*#~_+<>/\s]{2,}", line):
            continue  # a heading between rules
        if is_code(line):
            code += 1
            continue
        text.append(line)
    whole = " ".join(text).strip()
    if not _WORDS.search(whole):
        return True
    bare = re.sub(r"[\s.!…:;,\-–_*=#~<>{}]+$", "", re.sub(r"^[\s.!…:;,\-–_*=#~<>]+", "", whole))
    if PLACEHOLDER.fullmatch(bare):
        return True
    m = _TODO.fullmatch(bare)
    if m and (not m[1].strip() or PLACEHOLDER.fullmatch(m[1].strip(" .")) or len(_WORDS.findall(m[1])) <= 4):
        return True
    return only_name(whole, name)


class Islands:
    """The comments, strings and lines of one file."""

    def __init__(self, text: str, language: str):
        if text[:1] == "﻿":
            text = " " + text[1:]
        self.text, self.language = text, language
        self.starts = [0, *(m.end() for m in _NEWLINES.finditer(text))]
        family = lexer.LANGUAGES[language][0]
        #: last line of a comment that begins its line -> (first line, text)
        self.comments: dict[int, tuple[int, str]] = {}
        #: first offset -> end of each literal or comment
        self.spans: dict[int, int] = {}
        #: line -> the line on which the bracket that closes there opens, made when an annotation of several lines is met
        self._openers: dict[int, int] | None = None
        #: offset of each opening bracket -> offset of its partner, made at the same time
        self.partner: dict[int, int] = {}
        starts = self.starts
        for m in _LITERALS[family].finditer(text):
            t = m[0]
            at = m.start()
            if t[0] == "\\":
                continue
            self.spans[at] = m.end()
            if t[0] == "#" or t[:2] in ("//", "/*"):
                first = bisect_right(starts, at)
                if not text[starts[first - 1] : at].strip():
                    last = first if t[0] == "#" or t[1] == "/" else bisect_right(starts, m.end() - 1)
                    self.comments[last] = (first, t)

    def line(self, no: int) -> str:
        """Line ``no``, counted from 1."""
        lo = self.starts[no - 1]
        hi = self.starts[no] if no < len(self.starts) else len(self.text)
        return self.text[lo:hi].rstrip("\r\n")

    def above(self, no: int) -> list[str]:
        """The raw comments, in order, of the block that ends above line ``no``: annotations and
        directives may lie between, a blank line may not."""
        out: list[str] = []
        no -= 1
        while no >= 1:
            if no in self.comments:
                first, raw = self.comments[no]
                body = [x for x in cleaned(raw) if x]
                if out and raw[:2] == "/*" and not all(DIRECTIVE.match(x) for x in body):
                    if not all(DIRECTIVE.match(y) for r in out for y in cleaned(r) if y):
                        break  # a second block ends where the first begins
                if out and out[-1][:2] == "/*" and raw[:2] != "/*" and not all(DIRECTIVE.match(x) for x in [y for y in cleaned(out[-1]) if y]):
                    break
                out.append(raw)
                no = first - 1
                continue
            if any(not all(DIRECTIVE.match(x) for x in cleaned(r) if x) for r in out):
                break  # the documentation is complete
            line = self.line(no).strip()
            if line.startswith("@"):
                no -= 1
                continue
            opened = self._annotation(no) if line.endswith(")") or line.endswith("}") or line.startswith(")") else 0
            if opened:
                no = opened - 1
                continue
            break
        return out[::-1]

    def _annotation(self, last: int) -> int:
        """The first line of an annotation of several lines that ends on line ``last``; 0 if there is none."""
        self._match()
        no = self._openers.get(last, 0)
        return no if no and self.line(no).strip().startswith("@") else 0

    def _match(self) -> None:
        """Make the tables of brackets, once; brackets in literals and comments don't count.

        A line that closes several groups gets the line on which the first of them opens, or the one before it in a chain of lines."""
        if self._openers is not None:
            return
        openers = self._openers = {}
        stack: list[int] = []
        at = 0
        for m in _BRACKET.finditer(self.text):
            i = m.start()
            if i < at:
                continue
            if i in self.spans:
                at = self.spans[i]
                continue
            c = self.text[i]
            if c in "([{":
                stack.append(i)
            elif c in ")]}" and stack:
                j = stack.pop()
                if self.text[j] + c in ("()", "[]", "{}"):
                    self.partner[j] = i
                first, line = bisect_right(self.starts, j), bisect_right(self.starts, i)
                if first < line:
                    openers[line] = min(openers.get(line, first), openers.get(first, first))

    def signature_end(self, at: int) -> int:
        """Where the signature that begins at offset ``at`` ends: before the body, or at the statement's end."""
        text, spans, python = self.text, self.spans, self.language == "python"
        depth, i, n = 0, at, len(text)
        while m := _STOP.search(text, i):
            i = m.start()
            if i in spans:
                i = spans[i]
                continue
            c = text[i]
            if c in "([":
                if i - at > 2_000:  # a long signature: most end before the tables would pay
                    self._match()
                    if i in self.partner:
                        i = self.partner[i] + 1
                        continue
                depth += 1
            elif c in ")]":
                depth -= 1
            elif depth <= 0:
                if python:
                    if c == ":":
                        return i + 1
                    if c in "\r\n" and text[i - 1] != "\\":
                        return i
                elif c == "{":
                    if not (self.language == "typescript" and re.search(r"[:|&<,]\s*$", text[at:i])) and not (self.language == "go" and re.search(r"(?:interface|struct)\s*$", text[at:i])):
                        return i
                    depth += 1
                elif c in ";" or (c == "}" and depth < 0):
                    return i
                elif c == "=" and text[i : i + 2] == "=>":
                    return i + 2
            elif c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
            i += 1
        return n

    def body_end(self, at: int, start_line: int) -> int | None:
        """The last line of the body behind a signature that begins on ``start_line`` and ends at offset ``at``: that of
        the bracket that closes it, or of the indented block; the signature's own where there is no body (an abstract
        method), None where brackets or block are not complete."""
        text = self.text
        here = bisect_right(self.starts, max(0, at - 1))
        if self.language != "python":
            while text[at : at + 1] and (text[at] in " \t\r\n" or at in self.spans and text[at] == "/"):
                at = self.spans[at] if at in self.spans else at + 1
            if text[at : at + 1] == "{":
                self._match()
                close = self.partner.get(at)
                return None if close is None else bisect_right(self.starts, close)
            if text[max(0, at - 2) : at].strip().endswith("=>") or text[:at].rstrip().endswith("=>"):
                end = at
                self._match()
                while end < len(text) and text[end] not in ";\n":
                    end = self.spans[end] if end in self.spans else self.partner[end] + 1 if end in self.partner else end + 1
                return bisect_right(self.starts, max(at, min(end, len(text) - 1)))
            return here
        if text[at - 1 : at] != ":":
            return None
        rest = text[at : self.starts[here] if here < len(self.starts) else len(text)]
        if rest.strip() and not rest.strip().startswith("#"):
            return here
        if self._long is None:
            self._long = sorted((a, e) for a, e in self.spans.items() if "\n" in text[a:e])
        indent = len(self.line(start_line)) - len(self.line(start_line).lstrip())
        last = None
        for no in range(here + 1, len(self.starts) + 1):
            lo = self.starts[no - 1]
            k = bisect_right(self._long, (lo, 0)) - 1
            line = self.line(no)
            if k >= 0 and self._long[k][0] < lo < self._long[k][1]:
                last = no
            elif line.strip() and not line.lstrip().startswith("#"):
                if len(line) - len(line.lstrip()) <= indent and line.lstrip()[0] not in ")]}":
                    break
                last = no
        return last

    #: Literals of several lines, in order, made when a body is met that ends by indentation.
    _long: list[tuple[int, int]] | None = None

    def docstring(self, at: int) -> str | None:
        """The raw docstring behind a Python signature that ends at offset ``at``."""
        text, n = self.text, len(self.text)
        while at < n:
            if text[at] in " \t\r\n\f":
                at += 1
            elif text[at] == "#" and at in self.spans:
                at = self.spans[at]
            else:
                break
        m = re.compile(r"[rRuU]?(?=[\"'])").match(text, at)
        if not m or m.end() not in self.spans:
            return None
        end = self.spans[m.end()]
        after = re.compile(r"[ \t]*(?:#|;|\r|\n|$)").match(text, end)
        if not after:
            return None
        body = text[m.end() : end]
        quote = 3 if body[:3] in ('"""', "'''") else 1
        return body[quote:-quote]


def documentation(islands: Islands, start_line: int, name: str) -> tuple[str, str, int | None] | None:
    """(signature, documentation, last line of the body) of the function declared on ``start_line``; None if its
    documentation is missing or trivial.  A docstring is preferred to the comment above."""
    if not 1 <= start_line <= len(islands.starts):
        return None
    lo = islands.starts[start_line - 1]
    end = islands.signature_end(lo)
    signature = " ".join(islands.text[lo:end].split())
    if islands.language == "python":
        raw = islands.docstring(end) if signature.endswith(":") else None
        if raw is not None:
            lines = [x.strip() for x in _NEWLINES.split(raw)]
            if not is_trivial(lines, name):
                return signature, "\n".join(lines).strip(), islands.body_end(end, start_line)
    above = islands.above(start_line)
    lines = [x for raw in above for x in cleaned(raw)]
    if lines and not is_trivial(lines, name):
        return signature, "\n".join(x for x in lines if not DIRECTIVE.match(x)).strip(), islands.body_end(end, start_line)
    return None


PAIRS = "symbol_id string, file_id string, name string, symbol_type string, signature string, documentation string, end_line int"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            rows = []
            for file_id, path, text, symbols in zip(*(batch.column(c).to_pylist() for c in ("file_id", "path", "content", "symbols"))):
                m = re.search(r"\.(\w+)$", path or "")
                language = EXTENSIONS.get(m[1].lower()) if m else None
                if not language or not text or not symbols:
                    continue
                islands = Islands(text, language)
                for s in symbols:
                    found = documentation(islands, s["start_line"], s["name"] or "")
                    if found:
                        rows.append((s["id"], file_id, s["name"], s["symbol_type"], *found))
            columns = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32() if i == 6 else pa.string()) for i, c in enumerate(columns)], names=[x.split()[0] for x in PAIRS.split(", ")])


def function_pairs(symbols: DataFrame, corpus: DataFrame) -> DataFrame:
    """symbol_id, file_id, name, symbol_type, signature, documentation, end_line of every function and method with
    documentation that isn't missing or trivial, each symbol once.  ``end_line`` is the last line of the body, null
    where its brackets or block are not complete.

    Symbol types are compared without case and padding.  A symbol without id, file or line, or whose file
    has no content or an unknown language, has no documentation.  The symbols of a file (only their id,
    name, type and line) are made distinct, grouped and joined to the file's text, which moves once; a group
    is never longer than its file.
    """
    kind = F.upper(F.trim("symbol_type"))
    wanted = symbols.where(kind.isin("FUNCTION", "METHOD") & F.col("id").isNotNull() & F.col("file_id").isNotNull() & F.col("location.start_line").isNotNull())
    slim = wanted.select("file_id", F.struct("id", "name", kind.alias("symbol_type"), F.col("location.start_line").alias("start_line")).alias("s")).distinct()
    grouped = slim.groupBy("file_id").agg(F.collect_list("s").alias("symbols"))
    texts = corpus.where("content is not null and file_id is not null").select("file_id", "path", "content")
    found = texts.join(grouped, "file_id").select("file_id", "path", "content", "symbols").mapInArrow(_pairs, PAIRS)
    return found.dropDuplicates(["symbol_id"])
