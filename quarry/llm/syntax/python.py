"""Python: logical lines by brackets and indentation, statements by recursive descent."""

from __future__ import annotations

import re

from quarry.llm.syntax.base import Fault, Parser, deeply

SIMPLE_END = frozenset([";", "", "\n"])


class PythonLine(Parser):
    """One logical line: simple statements, or the header of a compound statement."""

    TOKEN = re.compile(r"[A-Za-z]+|\*\*=|//=|>>=|<<=|\.\.\.|\*\*|//|>>|<<|<=|>=|==|!=|->|:=|[-+*/%@&|^]=|\S")
    BINARY = {"|": 1, "^": 2, "&": 3, "<<": 4, ">>": 4, "+": 5, "-": 5, "*": 6, "/": 6, "//": 6, "%": 6, "@": 6}
    COMPARE = frozenset(["<", ">", "<=", ">=", "==", "!=", "in", "is", "not"])
    AUGMENT = frozenset(["+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**="])
    SOFT = frozenset(["match", "case", "type"])
    quick = True

    def is_name(self) -> bool:
        return self.toks[self.i] == "a" or self.toks[self.i] in self.SOFT

    def name(self) -> None:
        if not self.is_name():
            self.fail()
        self.i += 1

    def header_or_simple(self) -> str:
        """Parse the whole line.  Returns ``simple``, or the kind of the header whose suite follows."""
        t = self.toks[0]
        kind = "simple"
        if t == "@":
            self.i += 1
            self.named()
            kind = "decorator"
        elif t == "async":
            self.i += 1
            if self.toks[1] not in ("def", "with", "for"):
                self.fail()
            kind = getattr(self, "h_" + self.toks[1])()
        elif t in ("if", "elif", "else", "while", "for", "try", "except", "finally", "with", "def", "class"):
            kind = getattr(self, "h_" + t)()
        elif t in ("match", "case") and self.toks[-2] == ":" and self.speculate(getattr(self, "h_" + t)):
            kind = t
        if kind not in ("simple", "decorator"):
            if not self.toks[self.i]:
                return kind
            self.simple_line()  # the suite stands on the same line
            return kind + "+"
        if kind == "decorator":
            if self.toks[self.i]:
                self.fail()
            return kind
        self.simple_line()
        return kind

    def simple_line(self) -> None:
        while True:
            self.simple()
            if not self.opt(";"):
                break
            if not self.toks[self.i]:
                break
        if self.toks[self.i]:
            self.fail()

    # headers ----------------------------------------------------------------------------------------
    def h_if(self):
        self.i += 1
        self.named()
        self.eat(":")
        return "if"

    def h_elif(self):
        self.h_if()
        return "elif"

    def h_while(self):
        self.h_if()
        return "while"

    def h_else(self):
        self.i += 1
        self.eat(":")
        return "else"

    def h_try(self):
        self.h_else()
        return "try"

    def h_finally(self):
        self.h_else()
        return "finally"

    def h_except(self):
        self.i += 1
        star = self.opt("*")
        if self.toks[self.i] != ":":
            self.test()
            while self.opt(","):
                self.test()
            if self.opt("as"):
                self.name()
        elif star:
            self.fail()
        self.eat(":")
        return "except"

    def h_for(self):
        self.i += 1
        self.target_list()
        self.eat("in")
        self.star_list()
        self.eat(":")
        return "for"

    def h_with(self):
        self.i += 1
        def bracketed():
            self.eat("(")
            while True:
                self.item()
                if not self.opt(","):
                    break
                if self.toks[self.i] == ")":
                    break
            self.eat(")")
            self.eat(":")
        if not (self.toks[self.i] == "(" and self.speculate(bracketed)):
            self.item()
            while self.opt(","):
                self.item()
            self.eat(":")
        return "with"

    def item(self):
        self.test()
        if self.opt("as"):
            self.need_target(self.star_target())

    def type_params(self):
        if self.opt("["):
            while self.toks[self.i] != "]":
                self.opt("*") or self.opt("**")
                self.name()
                if self.opt(":"):
                    self.test()
                if self.opt("="):
                    self.test()
                if not self.opt(","):
                    break
            self.eat("]")

    def h_def(self):
        self.i += 1
        self.name()
        self.type_params()
        self.eat("(")
        self.params(")", True)
        self.eat(")")
        if self.opt("->"):
            self.star_list()
        self.eat(":")
        return "def"

    def params(self, close: str, typed: bool):
        default = star = slash = False
        bare = False
        any_ = False
        while self.toks[self.i] != close:
            if self.opt("**"):
                self.name()
                if typed and self.opt(":"):
                    self.test()
                self.opt(",")
                if self.toks[self.i] != close:
                    self.fail("parameter after **")
                break
            if self.opt("*"):
                if star:
                    self.fail("second * in parameters")
                star = True
                if self.is_name():
                    self.i += 1
                    if typed and self.opt(":"):
                        self.star_test()
                    bare = False
                else:
                    bare = True
            elif self.opt("/"):
                if slash or star or not any_:
                    self.fail()
                slash = True
            else:
                self.name()
                any_ = True
                bare = False
                if typed and self.opt(":"):
                    self.test()
                if self.opt("="):
                    self.test()
                    default = True
                elif default and not star:
                    self.fail("parameter without a default follows one with a default")
            if not self.opt(","):
                break
        if bare:
            self.fail("named parameters must follow bare *")

    def h_class(self):
        self.i += 1
        self.name()
        self.type_params()
        if self.opt("("):
            self.arguments()
        self.eat(":")
        return "class"

    def h_match(self):
        self.i += 1
        self.star_list()
        self.eat(":")
        if self.toks[self.i]:
            return False

    def h_case(self):
        self.i += 1
        self.pattern_list()
        if self.opt("if"):
            self.named()
        self.eat(":")

    def pattern_list(self, close: str = ""):
        while True:
            self.opt("*")
            self.pattern()
            if not self.opt(",") or self.toks[self.i] in (":", "if", close):
                break

    def pattern(self):
        while True:
            self.opt("-")
            t = self.toks[self.i]
            if t in ("N", "S", "None", "True", "False"):
                self.i += 1
                while self.toks[self.i] in ("+", "-", "N", "S"):
                    self.i += 1
            elif t in "([" and t:
                self.i += 1
                close = ")" if t == "(" else "]"
                if self.toks[self.i] != close:
                    self.pattern_list(close)
                self.eat(close)
            elif t == "{":
                self.i += 1
                while self.toks[self.i] != "}":
                    if self.opt("**"):
                        self.name()
                    else:
                        self.pattern()
                        self.eat(":")
                        self.pattern()
                    if not self.opt(","):
                        break
                self.eat("}")
            else:
                self.name()
                while self.opt("."):
                    self.name()
                if self.opt("("):
                    while self.toks[self.i] != ")":
                        if self.is_name() and self.toks[self.i + 1] == "=":
                            self.i += 2
                        self.pattern()
                        if not self.opt(","):
                            break
                    self.eat(")")
            if not self.opt("|"):
                break
        if self.opt("as"):
            self.name()

    # simple statements ------------------------------------------------------------------------------
    def simple(self):
        t = self.toks[self.i]
        rule = getattr(self, "s_" + t, None) if t.isalpha() else None
        if rule and not (t == "type" and not (self.toks[self.i + 1] == "a" or self.toks[self.i + 1] in self.SOFT)):
            self.i += 1
            return rule()
        kind = self.star_list()
        t = self.toks[self.i]
        if t == "=":
            while self.opt("="):
                self.need_target(kind)
                kind = self.yield_or_list()
        elif t in self.AUGMENT:
            if kind not in ("n", "t"):
                self.fail("cannot assign to this expression")
            self.i += 1
            self.yield_or_list()
        elif t == ":":
            if kind not in ("n", "t", "(n"):
                self.fail()
            self.i += 1
            self.test()
            if self.opt("="):
                self.yield_or_list()

    def s_pass(self):
        pass

    s_break = s_continue = s_pass

    def s_return(self):
        if self.toks[self.i] not in SIMPLE_END:
            self.star_list()

    def s_yield(self):
        self.i -= 1
        self.yield_or_list()
        while self.opt("="):
            self.fail("cannot assign to yield")

    def s_raise(self):
        if self.toks[self.i] not in SIMPLE_END:
            self.test()
            if self.opt("from"):
                self.test()

    def s_global(self):
        self.name()
        while self.opt(","):
            self.name()

    s_nonlocal = s_global

    def s_del(self):
        kind = self.star_list()
        self.need_target(kind, True)

    def s_assert(self):
        self.test()
        if self.opt(","):
            self.test()

    def s_type(self):
        self.name()
        self.type_params()
        self.eat("=")
        self.test()

    def dotted(self):
        self.name()
        while self.opt("."):
            self.name()

    def s_import(self):
        while True:
            self.dotted()
            if self.opt("as"):
                self.name()
            if not self.opt(","):
                break

    def s_from(self):
        dots = 0
        while self.toks[self.i] in (".", "..."):
            self.i += 1
            dots += 1
        if not dots or self.toks[self.i] != "import":
            self.dotted()
        self.eat("import")
        if self.opt("*"):
            return
        bracket = self.opt("(")
        while True:
            self.name()
            if self.opt("as"):
                self.name()
            if not self.opt(","):
                break
            if bracket and self.toks[self.i] == ")":
                break
            if not bracket and self.toks[self.i] in SIMPLE_END:
                self.fail("trailing comma")
        if bracket:
            self.eat(")")

    # expressions: the result tells what can be assigned to: n name, t attribute or item, l list of targets,
    # * starred, x nothing -------------------------------------------------------------------------------
    def need_target(self, kind: str, delete: bool = False):
        if kind not in ("n", "t", "l", "(n", "*t") or (delete and kind == "*t"):
            self.fail("cannot assign to this expression")

    def yield_or_list(self):
        if self.opt("yield"):
            if self.opt("from"):
                self.test()
            elif self.toks[self.i] not in (";", "", ")", "]", "}", "="):
                self.star_list()
            return "x"
        return self.star_list()

    ENDS = frozenset(["", ")", "]", "}", "=", ":", ";", "in"]) | AUGMENT

    def star_list(self):
        kind = self.star_named()
        if self.toks[self.i] == ",":
            ok = kind in ("n", "t", "l", "*t", "(n")
            while self.opt(","):
                if self.toks[self.i] in self.ENDS:
                    break
                ok &= self.star_named() in ("n", "t", "l", "*t", "(n")
            return "l" if ok else "x"
        return kind

    def star_test(self):
        if self.opt("*"):
            k = self.binary()
            return "*t" if k in ("n", "t", "l", "(n") else "*"
        return self.test()

    def star_named(self):
        if self.toks[self.i] == "*":
            return self.star_test()
        return self.named()

    def star_target(self):
        self.opt("*")
        return self.postfix()

    def target_list(self):
        def one():
            k = self.star_target()
            self.need_target(k)
        one()
        while self.opt(","):
            if self.toks[self.i] == "in":
                break
            one()

    def named(self):
        k = self.test()
        if self.toks[self.i] == ":=":
            if k != "n":
                self.fail()
            self.i += 1
            self.test()
            return "x"
        return k

    def test(self):
        if self.toks[self.i] == "lambda":
            self.i += 1
            self.params(":", False)
            self.eat(":")
            self.test()
            return "x"
        k = self.or_test()
        if self.toks[self.i] == "if":
            self.i += 1
            self.or_test()
            self.eat("else")
            self.test()
            return "x"
        return k

    def or_test(self):
        k = self.not_test()
        while self.toks[self.i] in ("or", "and"):
            self.i += 1
            self.not_test()
            k = "x"
        return k

    def not_test(self):
        if self.opt("not"):
            self.not_test()
            return "x"
        k = self.binary()
        while (t := self.toks[self.i]) in self.COMPARE:
            if t == "in" and self.no_in:
                break
            self.i += 1
            if t == "not":
                self.eat("in")
            elif t == "is":
                self.opt("not")
            self.binary()
            k = "x"
        return k

    no_in = False

    def unary(self):
        if self.toks[self.i] in ("-", "+", "~"):
            self.i += 1
            self.unary()
            return "x"
        aw = self.opt("await")
        k = self.postfix()
        if self.opt("**"):
            self.unary()
            return "x"
        return "x" if aw else k

    def postfix(self):
        k = self.atom()
        while True:
            t = self.toks[self.i]
            if t == ".":
                self.i += 1
                self.name()
                k = "t"
            elif t == "(":
                self.i += 1
                self.arguments()
                k = "x"
            elif t == "[":
                self.i += 1
                self.subscripts()
                k = "t"
            else:
                return k

    def arguments(self):
        named = False
        while self.toks[self.i] != ")":
            if self.opt("**"):
                self.test()
                named = True
            elif self.opt("*"):
                self.test()
            elif self.is_name() and self.toks[self.i + 1] == "=":
                self.i += 2
                self.test()
                named = True
            else:
                self.named()
                if self.toks[self.i] in ("for", "async"):
                    self.comprehension()
                elif named:
                    self.fail("positional argument follows keyword argument")
            if not self.opt(","):
                break
        self.eat(")")

    def subscripts(self):
        while True:
            if self.toks[self.i] == "]":
                self.fail()
            if self.toks[self.i] != ":":
                self.star_named()
            if self.opt(":"):
                if self.toks[self.i] not in (":", "]", ","):
                    self.test()
                if self.opt(":") and self.toks[self.i] not in ("]", ","):
                    self.test()
            if not self.opt(","):
                break
            if self.toks[self.i] == "]":
                break
        self.eat("]")

    def comprehension(self):
        while self.toks[self.i] in ("for", "async"):
            if self.opt("async") and self.toks[self.i] != "for":
                self.fail()
            self.i += 1
            self.target_list()
            self.eat("in")
            self.or_test_ternary_free()
            while self.opt("if"):
                self.or_test_named()

    def or_test_ternary_free(self):
        if self.toks[self.i] == "lambda":
            self.test()
        else:
            self.or_test()

    def or_test_named(self):
        k = self.or_test()
        if self.toks[self.i] == ":=" and k == "n":
            self.i += 1
            self.or_test()

    def atom(self):
        t = self.toks[self.i]
        if t == "a" or t in self.SOFT:
            self.i += 1
            return "n"
        if t == "S":
            while self.toks[self.i] == "S":
                self.i += 1
            return "x"
        if t in ("N", "True", "False", "None", "..."):
            self.i += 1
            return "x"
        if t == "(":
            self.i += 1
            if self.opt(")"):
                return "l"
            if self.toks[self.i] == "yield":
                self.yield_or_list()
                self.eat(")")
                return "x"
            k = self.star_named()
            if self.toks[self.i] in ("for", "async"):
                self.comprehension()
                self.eat(")")
                return "x"
            if self.toks[self.i] != ",":
                if k[0] == "*":
                    self.fail("cannot use starred expression here")
                self.eat(")")
                return "(n" if k in ("n", "(n") else k
            ok = k in ("n", "t", "l", "*t", "(n")
            while self.opt(","):
                if self.toks[self.i] == ")":
                    break
                ok &= self.star_named() in ("n", "t", "l", "*t", "(n")
            self.eat(")")
            return "l" if ok else "x"
        if t == "[":
            self.i += 1
            ok = True
            if self.toks[self.i] != "]":
                ok = self.star_named() in ("n", "t", "l", "*t", "(n")
                if self.toks[self.i] in ("for", "async"):
                    self.comprehension()
                    ok = False
                else:
                    while self.opt(","):
                        if self.toks[self.i] == "]":
                            break
                        ok &= self.star_named() in ("n", "t", "l", "*t", "(n")
            self.eat("]")
            return "l" if ok else "x"
        if t == "{":
            self.i += 1
            first = True
            while self.toks[self.i] != "}":
                if self.opt("**"):
                    self.binary()
                elif self.opt("*"):
                    self.binary()
                else:
                    self.named()
                    if self.opt(":"):
                        self.test()
                    if first and self.toks[self.i] in ("for", "async"):
                        self.comprehension()
                        break
                first = False
                if not self.opt(","):
                    break
            self.eat("}")
            return "x"
        self.fail()


_BALANCE = re.compile(r"[()\[\]{}]")


def balance(line: str) -> int:
    """Open brackets at the end of ``line``; -1 if one closes that isn't open."""
    depth = 0
    for c in _BALANCE.findall(line):
        depth += 1 if c in "([{" else -1
        if depth < 0:
            return -1
    return depth


MEMO: dict[str, tuple] = {}
FOLLOWS = {"elif": {"if", "elif"}, "else": {"if", "elif", "for", "while", "except"}, "except": {"try", "except"}, "finally": {"try", "except", "else"}}
SUITES = frozenset(["if", "elif", "else", "while", "for", "try", "except", "finally", "with", "def", "class", "match", "case"])


def line_kind(line: str, whole: bool = False) -> tuple:
    """(kind, fault or None, open brackets) of one line's shape; remembered, since shapes recur.

    A line that leaves brackets open is judged with the lines that close them, unless it is the ``whole``.
    """
    known = MEMO.get(line)
    if known is None:
        if len(MEMO) > 200_000:
            MEMO.clear()
        depth = balance(line)
        if depth > 0 and not whole:
            known = MEMO[line] = ("", None, depth)
            return known
        p = PythonLine(line.replace("\n", " "))
        try:
            try:
                kind = p.header_or_simple()
            except RecursionError:
                p = PythonLine(line.replace("\n", " "))
                kind = deeply(p.header_or_simple, len(p.toks))
            known = (kind, None, 0)
        except Fault as fault:
            known = ("simple", fault.message, 0)
        if depth <= 0:
            MEMO[line] = known
    return known


def width(indent: str) -> int:
    n = 0
    for c in indent:
        n = (n // 8 + 1) * 8 if c == "\t" else 0 if c == "\f" else n + 1
    return n


def check(shape: str) -> tuple[list[tuple[int, str]], int]:
    """All faults of a file: (line, message) and their number."""
    faults: list[tuple[int, str]] = []
    levels, alts = [0], [0]
    #: The last statement at each level: what else, except and finally may follow.
    last = [""]
    expects = ""  # header that still needs its suite
    decorated = False
    pend, pend_depth, no = "", 0, 0
    start = 0
    memo = MEMO
    pend_indent = ""
    for raw in shape.split("\n"):
        no += 1 + raw.count("\x02")
        if pend:
            part = raw
            depth = pend_depth
            for c in _BALANCE.findall(part):
                depth += 1 if c in "([{" else -1
                if depth < 0:
                    break
            pend += " " + part.strip()
            if depth > 0:
                pend_depth = depth
                continue
            line, at = pend, start
            pend = ""
        else:
            text = raw.replace("\x02", " ") if "\x02" in raw else raw
            line = text.strip(" \t\f")
            if not line:
                continue
            at = no
            pend_indent = text[: text.index(line[0])]
            known = memo.get(line) or line_kind(line)
            if known[2] > 0:
                pend, pend_depth, start = line, known[2], no
                continue
        plain = "\t" not in pend_indent and "\f" not in pend_indent
        w = len(pend_indent) if plain else width(pend_indent)
        # tabs as one column: the order of two indentations must not depend on the width of tabs
        alt = w if plain else len(pend_indent[pend_indent.rfind("\f") + 1 :])
        kind, fault, _ = memo.get(line) or line_kind(line, True)
        # indentation
        if w > levels[-1]:
            if not expects:
                faults.append((at, "unexpected indent"))
            if alt <= alts[-1]:
                faults.append((at, "inconsistent use of tabs and spaces"))
            levels.append(w)
            alts.append(alt)
            last.append("")
        else:
            if expects:
                faults.append((at, f"expected an indented block after {expects!r}"))
            while w < levels[-1]:
                levels.pop()
                alts.pop()
                if last.pop() == "try":
                    faults.append((at, "expected 'except' or 'finally'"))
            if w != levels[-1]:
                faults.append((at, "unindent matches no outer level"))
                levels.append(w)
                alts.append(alt)
                last.append("")
            elif alt != alts[-1]:
                faults.append((at, "inconsistent use of tabs and spaces"))
        expects = ""
        if fault:
            faults.append((at, fault))
        one_line = kind.endswith("+")
        if one_line:
            kind = kind[:-1]
        if kind in FOLLOWS and last[-1] not in FOLLOWS[kind]:
            faults.append((at, f"{kind!r} without its statement"))
        elif last[-1] == "try" and kind not in ("except", "finally"):
            faults.append((at, "expected 'except' or 'finally'"))
        if decorated and kind not in ("def", "class", "decorator"):
            faults.append((at, "a decorator needs a function or class"))
        decorated = kind == "decorator"
        # `else` after a loop or try ends what may follow; after a plain `if` as well
        last[-1] = "else" if kind == "else" and last[-1] == "except" else "done" if kind == "else" else kind
        if kind in SUITES and not one_line:
            expects = kind
    if pend:
        faults.append((start, "a bracket was never closed"))
    elif expects:
        faults.append((no, f"expected an indented block after {expects!r}"))
    elif "try" in last:
        faults.append((no, "expected 'except' or 'finally'"))
    if decorated:
        faults.append((no, "a decorator needs a function or class"))
    return faults, len(faults)
