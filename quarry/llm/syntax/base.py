"""What the parsers of all languages share: the cursor, faults, and panic-mode recovery.

A source text is first reduced to its *shape* (``lexer``): identifiers become ``a``, numbers ``N``,
strings ``S``, bad lexemes ``X``; keywords and punctuation stay.  The parsers read shapes only.
"""

from __future__ import annotations

import re
import sys
import threading


class Fault(Exception):
    def __init__(self, at: int, message: str):
        super().__init__(message)
        self.at, self.message = at, message


def deeply(rule, tokens: int):
    """What ``rule`` returns or raises, run in a thread with a stack for nesting of so many tokens."""
    result: list = []

    def run() -> None:
        try:
            result.append((rule(), None))
        except BaseException as e:
            result.append((None, e))

    limit, size = sys.getrecursionlimit(), threading.stack_size(512 << 20)
    try:
        sys.setrecursionlimit(max(limit, 10_000 + 40 * tokens))
        thread = threading.Thread(target=run)
        thread.start()
        thread.join()
    finally:
        sys.setrecursionlimit(limit)
        threading.stack_size(size)
    value, error = result[0]
    if error is not None:
        raise error
    return value


OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}


class Parser:
    """A cursor over tokens.  ``end`` is the sentinel token behind the last one."""

    TOKEN = re.compile(r"[A-Za-z]+|\S")
    #: Binary operators and how tightly they bind.
    BINARY: dict[str, int] = {}
    #: Words that can begin a statement: panic mode stops before them.
    STARTERS: frozenset[str] = frozenset()

    def __init__(self, shape: str):
        self.shape = shape
        self.toks: list[str] = []
        self.line: list[int] = []
        self.faults: list[tuple[int, str]] = []
        self.fault_count = 0
        self.i = 0
        #: The body kind of the block whose ``}`` is the last token but ``tail`` others (see ``compose``).
        self.blocks: list[tuple[int, str]] = []
        self.tokenise(shape)
        self.toks.append("")
        self.line.append(self.line[-1] if self.line else 1)
        self.match = self._match()

    def tokenise(self, shape: str) -> None:
        for no, text in enumerate(shape.split("\n"), 1):
            if text:
                found = self.TOKEN.findall(text)
                self.toks += found
                self.line += [no] * len(found)

    def _match(self) -> list[int]:
        """The index of each bracket's partner; 0 where it has none."""
        match, stack = [0] * len(self.toks), []
        for k, t in enumerate(self.toks):
            if t in OPEN:
                stack.append(k)
            elif t in CLOSE and stack:
                if self.toks[stack[-1]] == CLOSE[t]:
                    j = stack.pop()
                    match[j] = k
                    match[k] = j
        return match

    # the cursor -------------------------------------------------------------------------------------
    def fail(self, message: str = "") -> None:
        t = self.toks[self.i]
        raise Fault(self.i, message or ("unexpected end of file" if not t else f"unexpected {t!r}"))

    def eat(self, t: str) -> None:
        if self.toks[self.i] != t:
            got = self.toks[self.i]
            raise Fault(self.i, f"expected {t!r}, found {got!r}" if got else f"expected {t!r} before the end of file")
        self.i += 1

    def opt(self, t: str) -> bool:
        if self.toks[self.i] == t:
            self.i += 1
            return True
        return False

    def speculate(self, rule) -> bool:
        """Run ``rule``; on a fault (or a false result) go back and report False."""
        at, kept = self.i, len(self.blocks)
        try:
            if rule() is not False:
                return True
        except Fault:
            pass
        self.i = at
        del self.blocks[kept:]
        return False

    # panic mode -------------------------------------------------------------------------------------
    def report(self, fault: Fault) -> None:
        self.fault_count += 1
        self.faults.append((self.line[min(fault.at, len(self.line) - 1)], fault.message))

    def recover(self, start: int, inside: bool) -> None:
        """Skip to a place where a statement may begin: behind ``;``, before a starter word on a new line, or,
        inside a block, before its ``}``.  Always moves on by at least one token."""
        i = max(self.i, start)
        depth = 0
        while t := self.toks[i]:
            if t in OPEN:
                depth += 1
            elif t in CLOSE:
                if depth == 0:
                    if t == "}" and inside and i > start:
                        break
                    if t == "}" and inside:
                        break
                else:
                    depth -= 1
            elif t == ";" and depth == 0:
                i += 1
                break
            elif i > start and t in self.STARTERS and self.line[i] != self.line[i - 1]:
                break
            i += 1
        self.i = i if i > start or (inside and self.toks[i] == "}") else start + 1

    def statements(self, rule, close: str, kind: str) -> None:
        """``rule`` until ``close``; faults are reported and skipped."""
        first = self.i
        while (t := self.toks[self.i]) != close:
            if not t:
                self.fail(f"expected {close!r} before the end of file")
            start = self.i
            try:
                rule()
                if self.i == start:
                    self.fail()
            except Fault as fault:
                if self.quick:
                    raise
                self.report(fault)
                self.recover(start, bool(close))
        if close:
            if self.i == first:
                self.blocks.append((self.i, kind))
            self.i += 1

    quick = False

    def run(self) -> bool:
        """Parse everything; True if there was no fault."""
        try:
            self.program()
        except Fault as fault:
            self.report(fault)
        except RecursionError:
            self.__init__(self.shape)
            try:
                deeply(self.program, len(self.toks))
            except Fault as fault:
                self.report(fault)
        return not self.fault_count

    def program(self) -> None:
        raise NotImplementedError

    # precedence climbing ------------------------------------------------------------------------------
    def binary(self, least: int = 1):
        """``unary (op unary)*`` with operators that bind at least as tightly as ``least``."""
        kind = self.unary()
        table = self.BINARY
        while (p := table.get(self.toks[self.i], 0)) >= least:
            self.i += 1
            self.binary(p + 1)
            kind = "x"
        return kind

    def unary(self):
        raise NotImplementedError
