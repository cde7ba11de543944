"""Java: recursive descent; declarations and expressions are told apart by speculation."""

from __future__ import annotations

import re

from quarry.llm.syntax.base import Fault, Parser

PRIMITIVES = frozenset("boolean byte char double float int long short".split())
MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default sealed".split())
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>=".split())
CONTEXTUAL = frozenset("var record sealed permits yield when module".split())


class JavaParser(Parser):
    TOKEN = re.compile(r"\.\.\.|[A-Za-z]+|->|::|<<=|\+\+|--|&&|\|\||==|!=|<=|[-+*/%&|^]=|<<|\S")
    BINARY = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, "instanceof": 7, "<<": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}
    STARTERS = frozenset("public private protected class interface enum import if for while return try throw switch".split())

    def is_name(self, k: int = 0) -> bool:
        t = self.toks[self.i + k]
        return t == "a" or t in CONTEXTUAL

    def name(self) -> None:
        if not self.is_name():
            self.fail()
        self.i += 1

    def qualified(self) -> None:
        self.name()
        while self.toks[self.i] == "." and self.is_name(1):
            self.i += 2

    # declarations ------------------------------------------------------------------------------------------
    def program(self) -> None:
        self.statements(self.top, "", "top")

    def top(self) -> None:
        t = self.toks[self.i]
        if t == ";":
            self.i += 1
        elif t == "import":
            self.i += 1
            self.opt("static")
            self.name()
            while self.opt("."):
                if self.opt("*"):
                    break
                self.name()
            self.eat(";")
        elif t == "package":
            self.i += 1
            self.qualified()
            self.eat(";")
        else:
            self.modifiers()
            if self.toks[self.i] == "package":
                return self.top()
            if not self.type_declaration():
                self.fail()

    def modifiers(self) -> None:
        while True:
            t = self.toks[self.i]
            if t == "@" and self.toks[self.i + 1] != "interface":
                self.annotation()
            elif t in MODIFIERS and not (t == "default" and self.toks[self.i + 1] in (":", "->")) and not (t == "synchronized" and self.toks[self.i + 1] == "("):
                self.i += 1
            elif t == "non" and self.toks[self.i + 1] == "-":
                self.i += 2
                self.eat("sealed")
            else:
                return

    def annotation(self) -> None:
        self.eat("@")
        self.qualified()
        if self.opt("("):
            while self.toks[self.i] != ")":
                if self.is_name() and self.toks[self.i + 1] == "=":
                    self.i += 2
                self.element()
                if self.toks[self.i] != ")":
                    self.eat(",")
            self.i += 1

    def element(self) -> None:
        if self.toks[self.i] == "@":
            self.annotation()
        elif self.opt("{"):
            while self.toks[self.i] != "}":
                self.element()
                if self.toks[self.i] != "}":
                    self.eat(",")
            self.i += 1
        else:
            self.ternary()

    def type_declaration(self) -> bool:
        t = self.toks[self.i]
        if t == "class":
            self.i += 1
            self.name()
            self.opt_type_parameters()
            if self.opt("extends"):
                self.type()
            self.type_list("implements")
            self.type_list("permits")
            self.body("class")
        elif t == "interface":
            self.i += 1
            self.name()
            self.opt_type_parameters()
            self.type_list("extends")
            self.type_list("permits")
            self.body("class")
        elif t == "@" and self.toks[self.i + 1] == "interface":
            self.i += 2
            self.name()
            self.body("class")
        elif t == "enum":
            self.i += 1
            self.name()
            self.type_list("implements")
            self.enum_body()
        elif t == "record" and self.is_name(1) and self.toks[self.i + 2] in ("(", "<"):
            self.i += 2
            self.opt_type_parameters()
            self.parameters()
            self.type_list("implements")
            self.body("class")
        else:
            return False
        return True

    def type_list(self, word: str) -> None:
        if self.opt(word):
            self.type()
            while self.opt(","):
                self.type()

    def body(self, kind: str) -> None:
        self.eat("{")
        self.statements(self.member, "}", kind)

    def enum_body(self) -> None:
        self.eat("{")
        while self.toks[self.i] not in (";", "}"):
            self.modifiers()
            self.name()
            if self.toks[self.i] == "(":
                self.arguments()
            if self.toks[self.i] == "{":
                self.body("class")
            if not self.opt(","):
                break
        if self.opt(";"):
            self.statements(self.member, "}", "class")
        else:
            self.eat("}")

    def member(self) -> None:
        if self.opt(";"):
            return
        if self.toks[self.i] == "static" and self.toks[self.i + 1] == "{":
            self.i += 1
            return self.block()
        if self.toks[self.i] == "{":
            return self.block()
        self.modifiers()
        if self.type_declaration():
            return
        self.opt_type_parameters()
        self.modifiers()
        if self.is_name() and self.toks[self.i + 1] in ("(", "{"):  # constructor
            self.i += 1
            if self.toks[self.i] == "(":
                self.parameters()
            self.throws()
            return self.block("function")
        if not self.opt("void"):
            self.type()
        self.name()
        if self.toks[self.i] == "(":
            self.parameters()
            self.dims()
            self.throws()
            if self.opt("default"):
                self.element()
            if not self.opt(";"):
                self.block("function")
            return
        self.declarators()
        self.eat(";")

    def throws(self) -> None:
        self.type_list("throws")

    def dims(self) -> None:
        while self.toks[self.i] == "[" and self.toks[self.i + 1] == "]":
            self.i += 2

    def declarators(self) -> None:
        while True:
            self.dims()
            if self.opt("="):
                self.initializer()
            if not self.opt(","):
                return
            self.name()

    def initializer(self) -> None:
        if self.opt("{"):
            while self.toks[self.i] != "}":
                self.initializer()
                if self.toks[self.i] != "}":
                    self.eat(",")
            self.i += 1
        else:
            self.expression()

    def parameters(self) -> None:
        self.eat("(")
        if not self.opt(")"):
            while True:
                self.modifiers()
                self.type()
                self.opt("...")
                if not self.opt("this"):
                    self.name()
                    if self.toks[self.i] == "." and self.toks[self.i + 1] == "this":
                        self.i += 2
                self.dims()
                if not self.opt(","):
                    break
            self.eat(")")

    def opt_type_parameters(self) -> None:
        if self.opt("<"):
            while True:
                self.modifiers()
                self.name()
                if self.opt("extends"):
                    self.type()
                    while self.opt("&"):
                        self.type()
                if not self.opt(","):
                    break
            self.eat(">")

    def type(self) -> None:
        while self.toks[self.i] == "@":
            self.annotation()
        if self.toks[self.i] in PRIMITIVES:
            self.i += 1
        else:
            while True:
                self.name()
                if self.toks[self.i] == "<":
                    self.type_arguments()
                if self.toks[self.i] == "." and (self.is_name(1) or self.toks[self.i + 1] == "@"):
                    self.i += 1
                    while self.toks[self.i] == "@":
                        self.annotation()
                else:
                    break
        self.dims()

    def type_arguments(self) -> None:
        self.eat("<")
        if self.opt(">"):
            return
        while True:
            while self.toks[self.i] == "@":
                self.annotation()
            if self.opt("?"):
                if self.opt("extends") or self.opt("super"):
                    self.type()
            else:
                self.type()
            if not self.opt(","):
                break
        self.eat(">")

    # statements ---------------------------------------------------------------------------------------------
    def block(self, kind: str = "body") -> None:
        self.eat("{")
        self.statements(self.statement, "}", kind)

    def statement(self) -> None:
        t = self.toks[self.i]
        rule = getattr(self, "s_" + t, None) if t.isalpha() else None
        if rule is not None and rule() is not False:
            return
        if t == "{":
            return self.block()
        if self.opt(";"):
            return
        if t == "@" or t in MODIFIERS:
            self.modifiers()
            if self.type_declaration():
                return
            self.type()
            self.name()
            self.declarators()
            return self.eat(";")
        if t in ("class", "interface", "enum", "record") and self.type_declaration():
            return
        if self.is_name() and self.toks[self.i + 1] == ":":
            self.i += 2
            return self.statement()
        if (t in PRIMITIVES or self.is_name()) and self.speculate(self.local_head):
            self.declarators()
            return self.eat(";")
        k = self.expression()
        if k != "s":
            self.fail("not a statement")
        self.eat(";")

    def local_head(self) -> None:
        self.type()
        self.name()
        if self.toks[self.i] not in ("=", ";", ",", "[", ":"):
            self.fail()

    def s_if(self):
        self.i += 1
        self.bracketed()
        self.sub_statement()
        if self.opt("else"):
            self.sub_statement()

    def sub_statement(self) -> None:
        if (self.toks[self.i] in PRIMITIVES or self.is_name()) and self.toks[self.i + 1] != ":":
            at = self.i
            if self.speculate(self.local_head):
                self.i = at
                self.fail("a declaration can't stand here")
        self.statement()

    def bracketed(self) -> None:
        self.eat("(")
        self.expression()
        self.eat(")")

    def s_while(self):
        self.i += 1
        self.bracketed()
        self.sub_statement()

    def s_do(self):
        self.i += 1
        self.sub_statement()
        self.eat("while")
        self.bracketed()
        self.eat(";")

    def s_for(self):
        self.i += 1
        self.eat("(")
        if self.toks[self.i] != ";":
            self.modifiers()
            if self.speculate(self.local_head):
                if self.opt(":"):
                    self.expression()
                    self.eat(")")
                    return self.sub_statement()
                self.declarators()
            else:
                self.expressions()
        self.eat(";")
        if self.toks[self.i] != ";":
            self.expression()
        self.eat(";")
        if self.toks[self.i] != ")":
            self.expressions()
        self.eat(")")
        self.sub_statement()

    def expressions(self) -> None:
        self.expression()
        while self.opt(","):
            self.expression()

    def s_break(self):
        self.i += 1
        if self.is_name():
            self.i += 1
        self.eat(";")

    s_continue = s_break

    def s_return(self):
        self.i += 1
        if self.toks[self.i] != ";":
            self.expression()
        self.eat(";")

    def s_yield(self):
        if self.toks[self.i + 1] in ("=", ".", "[", "++", "--", "("):
            return False
        self.i += 1
        self.expression()
        self.eat(";")

    def s_throw(self):
        self.i += 1
        self.expression()
        self.eat(";")

    def s_assert(self):
        self.i += 1
        self.expression()
        if self.opt(":"):
            self.expression()
        self.eat(";")

    def s_synchronized(self):
        self.i += 1
        self.bracketed()
        self.block()

    def s_try(self):
        self.i += 1
        resources = self.opt("(")
        if resources:
            while self.toks[self.i] != ")":
                self.modifiers()
                if self.speculate(self.local_head):
                    self.eat("=")
                    self.expression()
                else:
                    self.expression()
                if self.toks[self.i] != ")":
                    self.eat(";")
            self.i += 1
        self.block()
        caught = resources
        while self.opt("catch"):
            caught = True
            self.eat("(")
            self.modifiers()
            self.type()
            while self.opt("|"):
                self.type()
            self.name()
            self.eat(")")
            self.block()
        if self.opt("finally"):
            self.block()
        elif not caught:
            self.fail("expected 'catch' or 'finally'")

    def s_switch(self):
        self.switch()

    def switch(self) -> None:
        self.i += 1
        self.bracketed()
        self.eat("{")
        self.statements(self.case, "}", "switch")

    def case(self) -> None:
        if self.opt("default"):
            pass
        elif self.opt("case"):
            while True:
                if self.toks[self.i] == "default":
                    self.i += 1
                elif not self.speculate(self.pattern):
                    self.ternary()
                if not self.opt(","):
                    break
            if self.opt("when"):
                self.expression()
        else:
            self.fail()
        if self.opt("->"):
            if self.toks[self.i] == "{":
                self.block()
            elif self.toks[self.i] == "throw":
                self.s_throw()
            else:
                self.expression()
                self.eat(";")
            return
        self.eat(":")
        while self.toks[self.i] not in ("case", "default", "}", ""):
            self.statement()

    def pattern(self) -> None:
        self.modifiers()
        self.type()
        if self.opt("("):
            while self.toks[self.i] != ")":
                self.pattern()
                if self.toks[self.i] != ")":
                    self.eat(",")
            self.i += 1
            if self.is_name() and self.toks[self.i] != "when":
                self.i += 1
        else:
            self.name()

    # expressions: t can be assigned to, s can be a statement, x neither ----------------------------------------
    def expression(self) -> str:
        if self.lambda_ahead():
            return "x"
        k = self.ternary()
        t = self.toks[self.i]
        if t == ">" and self.toks[self.i + 1] == ">" and self.assign_shift():
            t = "="
        if t in ASSIGN:
            if k != "t":
                self.fail("invalid assignment target")
            self.i += 1
            self.expression()
            return "s"
        return k

    def assign_shift(self) -> bool:
        n = 2 if self.toks[self.i + 2] != ">" else 3
        if self.toks[self.i + n] == "=":
            self.i += n
            return True
        return False

    def lambda_ahead(self) -> bool:
        if self.is_name() and self.toks[self.i + 1] == "->":
            self.i += 2
        elif self.toks[self.i] == "(" and (j := self.match[self.i]) and self.toks[j + 1] == "->":
            if self.toks[self.i + 1] == ")" or (self.is_name(1) and self.toks[self.i + 2] in (",", ")")):
                self.i += 1
                while self.toks[self.i] != ")":
                    self.name()
                    if self.toks[self.i] != ")":
                        self.eat(",")
                self.i += 1
            else:
                self.parameters()
            self.eat("->")
        else:
            return False
        if self.toks[self.i] == "{":
            self.block("function")
        else:
            self.expression()
        return True

    def ternary(self) -> str:
        k = self.binary()
        if self.opt("?"):
            self.expression()
            self.eat(":")
            self.expression() if not self.lambda_ahead() else None
            return "x"
        return k

    def binary(self, least: int = 1) -> str:
        k = self.unary()
        while True:
            t = self.toks[self.i]
            if t == ">":
                n = 1
                while n < 3 and self.toks[self.i + n] == ">":
                    n += 1
                if self.toks[self.i + n] == "=":
                    if n > 1:
                        return k
                    n += 1  # >=
                    p = 7
                else:
                    p = 7 if n == 1 else 8
                if p < least:
                    return k
                self.i += n
                self.binary(p + 1)
                k = "x"
                continue
            p = self.BINARY.get(t, 0)
            if not p or p < least:
                return k
            self.i += 1
            if t == "instanceof":
                if not self.speculate(self.pattern):
                    self.type()
            else:
                self.binary(p + 1)
            k = "x"

    def unary(self) -> str:
        t = self.toks[self.i]
        if t in ("++", "--"):
            self.i += 1
            self.unary()
            return "s"
        if t in ("+", "-", "!", "~"):
            self.i += 1
            self.unary()
            return "x"
        if t == "(" and self.cast():
            return "x"
        k = self.postfix(self.primary())
        while self.toks[self.i] in ("++", "--"):
            self.i += 1
            k = "s"
        return k

    def cast(self) -> bool:
        j = self.match[self.i]
        if not j:
            return False
        primitive = self.toks[self.i + 1] in PRIMITIVES
        after = self.toks[j + 1]
        if not (primitive or after in ("a", "S", "N", "(", "!", "~", "this", "super", "new", "true", "false", "null", "switch") or after in CONTEXTUAL or after in PRIMITIVES):
            return False

        def head():
            self.eat("(")
            self.type()
            while self.opt("&"):
                self.type()
            self.eat(")")

        if not self.speculate(head):
            return False
        if not self.lambda_ahead():
            self.unary()
        return True

    def primary(self) -> str:
        t = self.toks[self.i]
        if t == "(":
            self.i += 1
            k = self.expression()
            self.eat(")")
            return "t" if k == "t" else "x"
        if t in ("S", "N", "true", "false", "null"):
            self.i += 1
            return "x"
        if t in ("this", "super"):
            self.i += 1
            if self.toks[self.i] == "(":
                self.arguments()
                return "s"
            if t == "super" and self.toks[self.i] not in (".", "::"):
                self.fail()
            return "x"
        if t == "new":
            return self.new()
        if t == "switch":
            self.switch()
            return "x"
        if t in PRIMITIVES or t == "void":
            self.i += 1
            self.dims()
            if self.toks[self.i] not in (".", "::"):
                self.fail()
            if self.toks[self.i] == ".":
                self.i += 1
                self.eat("class")
            return "x"
        if self.is_name():
            if self.toks[self.i + 1] == "<" and self.speculate(lambda: (self.type(), self.toks[self.i] == "::" or self.fail())):
                return "x"
            if self.toks[self.i + 1] == "[" and self.toks[self.i + 2] == "]":
                self.type()
                if self.opt("."):
                    self.eat("class")
                elif self.toks[self.i] != "::":
                    self.fail()
                return "x"
            self.i += 1
            if self.toks[self.i] == "(":
                self.arguments()
                return "s"
            return "t"
        self.fail()

    def new(self) -> str:
        self.i += 1
        while self.toks[self.i] == "@":
            self.annotation()
        if self.toks[self.i] in PRIMITIVES:
            self.i += 1
        else:
            while True:
                self.name()
                if self.toks[self.i] == "<":
                    self.type_arguments()
                if not (self.toks[self.i] == "." and self.is_name(1)):
                    break
                self.i += 1
        if self.toks[self.i] == "[":
            if self.toks[self.i + 1] == "]":
                self.dims()
                if self.toks[self.i] != "{":
                    self.fail()
                self.initializer()
                return "x"
            while self.toks[self.i] == "[" and self.toks[self.i + 1] != "]":
                self.i += 1
                self.expression()
                self.eat("]")
            self.dims()
            return "x"
        if self.toks[self.i] != "(":
            self.fail()
        self.arguments()
        if self.toks[self.i] == "{":
            self.body("class")
        return "s"

    def postfix(self, k: str) -> str:
        while True:
            t = self.toks[self.i]
            if t == ".":
                self.i += 1
                if self.toks[self.i] == "new":
                    k = self.new()
                    continue
                if self.toks[self.i] == "<":
                    self.type_arguments()
                if self.toks[self.i] in ("class", "this", "super"):
                    self.i += 1
                    k = "x"
                    if self.toks[self.i] == "(":
                        self.arguments()
                        k = "s"
                    continue
                self.name()
                if self.toks[self.i] == "(":
                    self.arguments()
                    k = "s"
                else:
                    k = "t"
            elif t == "[":
                self.i += 1
                self.expression()
                self.eat("]")
                k = "t"
            elif t == "::":
                self.i += 1
                if not self.opt("new"):
                    self.name()
                k = "x"
            else:
                return k

    def arguments(self) -> None:
        self.eat("(")
        if not self.opt(")"):
            self.expressions()
            self.eat(")")
