"""Go: recursive descent over tokens with the semicolons that line ends imply."""

from __future__ import annotations

import re

from quarry.llm.syntax.base import Fault, Parser

ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())
ENDS_LINE = frozenset("a N S break continue fallthrough return ++ -- ) ] }".split())


class GoParser(Parser):
    TOKEN = re.compile(r"\.\.\.|[A-Za-z]+|<<=|>>=|&\^=|:=|\+\+|--|&&|\|\||&\^|<-|==|!=|<=|>=|<<|>>|[-+*/%&|^]=|\S")
    BINARY = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5}
    STARTERS = frozenset("func type var const if for switch select return go defer import".split())
    #: Inside the header of if, for and switch, a ``{`` behind a name begins the block.
    header = False

    def tokenise(self, shape: str) -> None:
        for no, text in enumerate(shape.split("\n"), 1):
            found = self.TOKEN.findall(text)
            if found:
                self.toks += found
                self.line += [no] * len(found)
                if found[-1] in ENDS_LINE:
                    self.toks.append(";")
                    self.line.append(no)
                    self.implied.add(len(self.toks) - 1)

    def __init__(self, shape: str):
        self.implied: set[int] = set()
        super().__init__(shape)

    def name(self) -> None:
        self.eat("a")

    def end(self) -> None:
        if self.toks[self.i] not in (")", "}"):
            self.eat(";")

    def names(self) -> None:
        self.name()
        while self.opt(","):
            self.name()

    # declarations ----------------------------------------------------------------------------------------------
    def program(self) -> None:
        if len(self.toks) == 1:
            return
        try:
            self.eat("package")
            self.name()
            self.eat(";")
        except Fault as fault:
            self.report(fault)
            if self.quick:
                raise
            self.recover(self.i, False)
        self.late_import = False
        self.statements(self.top, "", "top")

    late_import = False

    def top(self) -> None:
        t = self.toks[self.i]
        if t == "import":
            if self.late_import:
                self.fail("imports must appear before other declarations")
            self.i += 1
            self.group(self.import_spec)
        elif t == "func":
            self.late_import = True
            self.function_declaration()
        elif t in ("type", "var", "const"):
            self.late_import = True
            self.declaration()
        else:
            self.fail("non-declaration statement outside a function")
        self.eat(";")

    def group(self, rule) -> None:
        if self.opt("("):
            while self.toks[self.i] != ")":
                rule()
                self.end()
            self.i += 1
        else:
            rule()

    def import_spec(self) -> None:
        if self.toks[self.i] in ("a", "."):
            self.i += 1
        self.eat("S")

    def declaration(self) -> None:
        t = self.toks[self.i]
        self.i += 1
        self.group({"type": self.type_spec, "var": self.var_spec, "const": self.const_spec}[t])

    def var_spec(self) -> None:
        self.names()
        if self.toks[self.i] != "=":
            self.type()
        if self.opt("="):
            self.expressions()

    def const_spec(self) -> None:
        self.names()
        if self.toks[self.i] not in ("=", ";", ")"):
            self.type()
            self.eat("=")
            return self.expressions()
        if self.opt("="):
            self.expressions()

    def type_spec(self) -> None:
        self.name()
        if self.toks[self.i] == "[" and self.toks[self.i + 1] == "a" and self.toks[self.i + 2] != "]":
            self.speculate(self.type_parameters)
        self.opt("=")
        self.type()

    def type_parameters(self) -> None:
        self.eat("[")
        while self.toks[self.i] != "]":
            self.names()
            self.constraint()
            if not self.opt(","):
                break
        self.eat("]")

    def constraint(self) -> None:
        while True:
            self.opt("~")
            self.type()
            if not self.opt("|"):
                return

    def function_declaration(self) -> None:
        self.i += 1
        if self.toks[self.i] == "(":
            self.parameters()
        self.name()
        if self.toks[self.i] == "[":
            self.type_parameters()
        self.signature()
        if self.toks[self.i] == "{":
            self.body()

    def body(self, kind: str = "function") -> None:
        saved, self.header = self.header, False
        try:
            self.eat("{")
            self.statements(self.listed, "}", kind)
        finally:
            self.header = saved

    def listed(self) -> None:
        self.statement()
        if self.toks[self.i] != "}":
            self.eat(";")

    def signature(self) -> None:
        self.parameters()
        t = self.toks[self.i]
        if t == "(":
            self.parameters()
        elif t in ("a", "*", "[", "map", "chan", "func", "interface", "struct", "<-"):
            self.type()

    def parameters(self) -> None:
        """Either all parameters have names, or none has."""
        saved, self.header = self.header, False
        self.eat("(")
        named = plain = 0
        while self.toks[self.i] != ")":
            if self.toks[self.i] == "a" and self.toks[self.i + 1] not in (",", ")", ".", "[") or (self.toks[self.i] == "a" and self.toks[self.i + 1] == "[" and self.array_follows()):
                self.i += 1
                self.opt("...")
                self.type()
                named += 1
            else:
                alone = self.toks[self.i] == "a" and self.toks[self.i + 1] in (",", ")")
                self.opt("...")
                self.type()
                plain += not alone
            if not self.opt(","):
                break
        self.eat(")")
        self.header = saved
        if named and plain:
            self.fail("mixed named and unnamed parameters")

    def array_follows(self) -> bool:
        """``a [`` : a name and a slice or array type, rather than an instance of a generic type?"""
        j = self.match[self.i + 1]
        return bool(j) and self.toks[j + 1] not in (",", ")", ".")

    def type(self) -> None:
        t = self.toks[self.i]
        self.i += 1
        if t == "a":
            if self.opt("."):
                self.name()
            if self.toks[self.i] == "[" and self.toks[self.i + 1] != "]":
                self.i += 1
                self.type()
                while self.opt(","):
                    self.type()
                self.eat("]")
        elif t == "*":
            self.type()
        elif t == "(":
            self.type()
            self.eat(")")
        elif t == "[":
            if not self.opt("]"):
                saved, self.header = self.header, False
                if not self.opt("..."):
                    self.expression()
                self.eat("]")
                self.header = saved
            self.type()
        elif t == "map":
            self.eat("[")
            self.type()
            self.eat("]")
            self.type()
        elif t == "chan":
            self.opt("<-")
            self.type()
        elif t == "<-":
            self.eat("chan")
            self.type()
        elif t == "func":
            self.signature()
        elif t == "struct":
            self.eat("{")
            self.statements(self.field, "}", "struct")
        elif t == "interface":
            self.eat("{")
            self.statements(self.method, "}", "interface")
        else:
            self.i -= 1
            self.fail()

    def field(self) -> None:
        if self.toks[self.i] == "*" or (self.toks[self.i] == "a" and self.toks[self.i + 1] in (";", "}", ".", "S")):
            self.type()
        else:
            self.names()
            self.type()
        self.opt("S")
        if self.toks[self.i] != "}":
            self.eat(";")

    def method(self) -> None:
        if self.toks[self.i] == "a" and self.toks[self.i + 1] == "(":
            self.i += 1
            self.signature()
        else:
            self.constraint()
        if self.toks[self.i] != "}":
            self.eat(";")

    # statements --------------------------------------------------------------------------------------------------
    def statement(self) -> None:
        t = self.toks[self.i]
        rule = getattr(self, "s_" + t, None) if t.isalpha() else None
        if rule is not None:
            return rule()
        if t in ("type", "var", "const"):
            return self.declaration()
        if t == "{":
            return self.body("function")
        if t in (";", "}"):
            return
        if t == "a" and self.toks[self.i + 1] == ":":
            self.i += 2
            if self.toks[self.i] not in ("}",):
                self.statement()
            return
        self.simple()

    def simple(self, ranged: bool = False) -> str:
        """A simple statement; with ``ranged`` also ``x, y := range z``.  Returns what it was."""
        if ranged and self.opt("range"):
            self.expression()
            return "range"
        self.expression()
        n = 1
        while self.opt(","):
            self.expression()
            n += 1
        t = self.toks[self.i]
        if t in ASSIGN:
            self.i += 1
            if ranged and t in ("=", ":=") and self.opt("range"):
                self.expression()
                return "range"
            self.expressions()
            return "assign"
        if n > 1:
            self.fail()
        if t in ("++", "--"):
            self.i += 1
            return "assign"
        if t == "<-":
            self.i += 1
            self.expression()
            return "send"
        return "expression"

    def s_return(self):
        self.i += 1
        if self.toks[self.i] not in (";", "}"):
            self.expressions()

    def s_break(self):
        self.i += 1
        self.opt("a")

    s_continue = s_break

    def s_goto(self):
        self.i += 1
        self.name()

    def s_fallthrough(self):
        self.i += 1

    def s_go(self):
        self.i += 1
        if self.expression() != "c":
            self.fail("go and defer need a call")

    s_defer = s_go

    def s_if(self):
        self.i += 1
        saved, self.header = self.header, True
        if self.toks[self.i] == "{":
            self.fail("missing condition")
        kind = self.simple() if self.toks[self.i] != ";" else ""
        if self.opt(";"):
            kind = self.simple()
        if kind != "expression":
            self.fail("a condition must be an expression")
        self.header = saved
        self.body()
        if self.opt("else"):
            if self.toks[self.i] == "if":
                self.s_if()
            else:
                self.body()

    def s_for(self):
        self.i += 1
        saved, self.header = self.header, True
        if self.toks[self.i] != "{":
            kind = self.simple(True) if self.toks[self.i] != ";" else ""
            if kind != "range" and self.toks[self.i] == ";":
                self.i += 1
                if self.toks[self.i] != ";":
                    self.expression()
                self.eat(";")
                if self.toks[self.i] != "{":
                    self.simple()
            elif kind not in ("range", "expression"):
                self.fail()
        self.header = saved
        self.body()

    def s_switch(self):
        self.i += 1
        saved, self.header = self.header, True
        if self.toks[self.i] != "{":
            if self.toks[self.i] != ";":
                self.simple()
            if self.opt(";") and self.toks[self.i] != "{":
                self.simple()
        self.header = saved
        self.eat("{")
        self.statements(self.case, "}", "switch")

    def case(self) -> None:
        if not self.opt("default"):
            self.eat("case")
            self.type_or_expression()
            while self.opt(","):
                self.type_or_expression()
        self.eat(":")
        self.case_body()

    def case_body(self) -> None:
        while self.toks[self.i] not in ("case", "default", "}", ""):
            self.listed()

    def type_or_expression(self) -> None:
        if not self.speculate(lambda: (self.expression(), self.toks[self.i] in (",", ":") or self.fail())):
            self.type()

    def s_select(self):
        self.i += 1
        self.eat("{")
        self.statements(self.communication, "}", "switch")

    def communication(self) -> None:
        if not self.opt("default"):
            self.eat("case")
            self.simple()
        self.eat(":")
        self.case_body()

    # expressions: c call, x other --------------------------------------------------------------------------------
    def expressions(self) -> None:
        self.expression()
        while self.opt(","):
            self.expression()

    def expression(self) -> str:
        return self.binary()

    def unary(self) -> str:
        t = self.toks[self.i]
        if t in ("+", "-", "!", "^", "*", "&", "<-"):
            self.i += 1
            if t == "<-" and self.toks[self.i] == "chan":
                self.i -= 1
                self.type()
                return self.postfix("T")
            self.unary()
            return "x"
        return self.primary()

    def primary(self) -> str:
        t = self.toks[self.i]
        if t == "a":
            self.i += 1
            return self.postfix("n")
        if t in ("N", "S"):
            self.i += 1
            return self.postfix("x")
        if t == "(":
            saved, self.header = self.header, False
            self.i += 1
            self.type_or_paren()
            self.eat(")")
            self.header = saved
            return self.postfix("x")
        if t == "func":
            self.i += 1
            self.signature()
            if self.toks[self.i] == "{":
                self.body()
            return self.postfix("x")
        if t in ("[", "map", "struct", "chan", "interface"):
            self.type()
            return self.postfix("T")
        self.fail()

    def type_or_paren(self) -> None:
        if not self.speculate(lambda: (self.expression(), self.toks[self.i] == ")" or self.fail())):
            self.type()

    def postfix(self, k: str) -> str:
        while True:
            t = self.toks[self.i]
            if t == ".":
                self.i += 1
                if self.opt("("):
                    if not self.opt("type"):
                        self.type()
                    self.eat(")")
                    k = "x"
                else:
                    self.name()
                    k = "n" if k == "n" else "x"
            elif t == "(":
                saved, self.header = self.header, False
                self.i += 1
                while self.toks[self.i] != ")":
                    self.argument()
                    self.opt("...")
                    if not self.opt(","):
                        break
                self.eat(")")
                self.header = saved
                k = "c"
            elif t == "[":
                saved, self.header = self.header, False
                self.i += 1
                if self.toks[self.i] != ":":
                    self.argument()
                    while self.opt(","):
                        if self.toks[self.i] == "]":
                            break
                        self.argument()
                while self.opt(":"):
                    if self.toks[self.i] not in ("]", ":"):
                        self.expression()
                self.eat("]")
                self.header = saved
                k = "n" if k == "n" else "x"
            elif t == "{" and (k == "T" or (k == "n" and not self.header)):
                self.composite()
                k = "x"
            else:
                return k

    def argument(self) -> None:
        if self.toks[self.i] in ("[", "map", "chan", "struct", "interface", "func", "*") and self.speculate(lambda: (self.type(), self.toks[self.i] in (",", ")", "]") or self.fail())):
            return
        self.expression()

    def composite(self) -> None:
        saved, self.header = self.header, False
        self.eat("{")
        while self.toks[self.i] != "}":
            self.value()
            if self.opt(":"):
                self.value()
            if not self.opt(","):
                break
        self.eat("}")
        self.header = saved

    def value(self) -> None:
        if self.toks[self.i] == "{":
            self.composite()
        else:
            self.expression()
