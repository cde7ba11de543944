"""Whole files of languages with braces, by composition of remembered lines.

A file's shape consists of few distinct lines.  A logical line (physical lines joined until ``(`` and
``[`` balance) is parsed once by the language's parser and remembered: whether it is a complete
statement, or opens a body of a certain kind behind its last ``{``.  A line that closes a body is judged
together with its opener, with an empty body between them.  As the grammars are context-free in their
bodies, a file whose lines all compose is valid.  Any other file goes through the whole parser, whose
answer, with all its faults, holds.
"""

from __future__ import annotations

import re

from quarry.llm.syntax.base import Fault
from quarry.llm.syntax.ecma import EcmaParser, TypeScriptParser
from quarry.llm.syntax.golang import GoParser
from quarry.llm.syntax.java import JavaParser

PARSERS = {"javascript": EcmaParser, "typescript": TypeScriptParser, "java": JavaParser, "go": GoParser}
#: A program that holds a line in the place of ``@`` for each kind of body; ``outside`` is a block outside of functions.
FRAMES = {
    "javascript": {"top": "@", "outside": "if (a) {@\n}", "body": "function a(){@\n}", "function": "function a(){@\n}", "class": "class a{@\n}"},
    "typescript": {"top": "@", "outside": "if (a) {@\n}", "body": "function a(){@\n}", "function": "function a(){@\n}", "class": "class a{@\n}"},
    "java": {"top": "@", "body": "class a{a(){@\n}}", "function": "class a{a(){@\n}}", "class": "class a{@\n}"},
    "go": {"top": "package a\n@", "function": "package a\nfunc a(){\n@\n}", "struct": "package a\ntype a struct{\n@\n}"},
}
_PAIRS = re.compile(r"[()\[\]]")
#: A line that begins so may continue the line before it.
_CONTINUES = frozenset("([`+-*/,.?:&|<>=^%!")
MEMO: dict[tuple, tuple] = {}
#: The first lines of a Go file have to come in order, so its top is one kind of body per stage.
FAIL, SIMPLE, OPENS, JOIN = 0, 1, 2, 3


def judge(language: str, kind: str, opener: str, line: str) -> tuple:
    """What ``line`` is in a body of ``kind``, or behind ``opener`` and its empty body."""
    frame = FRAMES[language].get(kind)
    if frame is None:
        return (FAIL,)
    depth = 0
    for c in _PAIRS.findall(line):
        depth += 1 if c in "([" else -1
    text = (opener + line).replace("\x02", " ")
    if depth > 0:
        return (JOIN,)
    if not text.strip():
        return (SIMPLE,)
    before, after = frame.split("@")
    opens = line.endswith("{")
    p = PARSERS[language](before + text + ("\n}" if opens else "") + after)
    p.quick = True
    try:
        p.program()
    except (Fault, RecursionError):
        # `try {` alone lacks its catch, and an annotation its declaration
        if opens:
            for rest in (" catch (a) {}", " catch (a a) {}", " while (a);"):
                q = PARSERS[language](before + text + "\n}" + rest + after)
                q.quick = True
                try:
                    q.program()
                except (Fault, RecursionError):
                    continue
                p = q
                break
            else:
                return (FAIL,)
        else:
            return (JOIN,) if line.startswith("@") and "\n" not in line else (FAIL,)
    if not opens:
        return (SIMPLE,)
    # the innermost body that is empty and stands behind the line's last brace
    at = len(PARSERS[language].TOKEN.findall((before + text).replace("\n", " ")))
    if language == "go":
        at = len(_go_tokens(before + text))
    for i, body in p.blocks:
        if i == at:
            return (OPENS, body, text)
    return (FAIL,)


def _go_tokens(text: str) -> list[str]:
    return GoParser(text).toks[:-1]


def composes(shape: str, language: str) -> bool:
    """True if all lines compose; False if the whole parser has to decide."""
    memo = MEMO
    if len(memo) > 300_000:
        memo.clear()
    kind, opener = "top", ""
    stack: list[tuple[str, str]] = []
    pend = ""
    open_end = False
    ecma = language in ("javascript", "typescript")
    if language == "go":
        lead = shape.lstrip()
        if not lead:
            return True
        head = re.match(r"package a[ \t;]*(?:\n|$)", lead)
        if not head:
            return False
        shape = lead[head.end() :]
    imports_over = False
    for raw in shape.split("\n"):
        line = raw.strip(" \t\f\x02")
        if not line:
            continue
        if pend:
            line = pend + "\n" + line
            pend = ""
        if open_end and line[0] in _CONTINUES:
            return False
        if line[0] == "}":
            if not stack:
                return False
            outer, before = stack[-1][0], opener
            known = memo.get((language, outer, before, line))
            if known is None:
                known = memo[language, outer, before, line] = judge(language, outer, before + "\n", line)
            if known[0] == SIMPLE:
                kind, opener = stack.pop()
                open_end = False
            elif known[0] == OPENS:
                kind, opener = known[1], known[2]
                if len(opener) > 400:
                    return False
            elif known[0] == JOIN:
                pend = line
            else:
                return False
            continue
        known = memo.get((language, kind, line))
        if known is None:
            known = memo[language, kind, line] = judge(language, kind, "", line)
        k = known[0]
        if k == SIMPLE:
            open_end = ecma and line[-1] not in ";}"
        elif k == OPENS:
            stack.append((kind, opener))
            kind, opener = known[1], known[2]
            open_end = False
        elif k == JOIN:
            pend = line
            continue
        else:
            return False
        if language == "go" and kind == "top" or len(stack) == 1:
            if language == "go":
                if not line.startswith("import"):
                    imports_over = True
                elif imports_over:
                    return False
    return not stack and not pend


def check(shape: str, language: str) -> tuple[list[tuple[int, str]], int]:
    """All faults of a file: (line, message) and their number."""
    if composes(shape, language):
        return [], 0
    parser = PARSERS[language](shape.replace("\x02", "\n"))
    parser.run()
    return parser.faults, parser.fault_count
