"""JavaScript (as modules) and TypeScript: recursive descent with automatic semicolons."""

from __future__ import annotations

import re

from quarry.llm.syntax.base import Fault, Parser

ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
#: Reserved words of modules: never names.
RESERVED = frozenset("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum yield await let static implements interface package private protected public".split())
CONTEXTUAL_STRICT = frozenset("implements interface package private protected public let static yield".split())


class EcmaParser(Parser):
    TOKEN = re.compile(r"\.\.\.|#?[A-Za-z]+|>>>=|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!N)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\*\*|\S")
    BINARY = {"??": 1, "||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "===": 6, "!==": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7, "in": 7, "<<": 8, ">>": 8, ">>>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10, "**": 11}
    STARTERS = frozenset("const let var function class if for while return try throw switch import export interface enum".split())
    ts = False
    function = 0

    # names --------------------------------------------------------------------------------------------
    def is_name(self, k: int = 0) -> bool:
        t = self.toks[self.i + k]
        return t == "a" or (t.isalpha() and t not in "NSX" and t not in RESERVED) or (self.script and t in CONTEXTUAL_STRICT and t in ("let", "static"))

    script = False

    def name(self) -> None:
        if not self.is_name():
            self.fail()
        self.i += 1

    def any_word(self) -> None:
        t = self.toks[self.i]
        if not t.isalpha() or t in ("N", "S", "X"):
            self.fail()
        self.i += 1

    def newline(self) -> bool:
        """Is there a line break before the current token?"""
        return self.i > 0 and self.line[self.i] != self.line[self.i - 1]

    def semicolon(self) -> None:
        t = self.toks[self.i]
        if t == ";":
            self.i += 1
        elif t not in ("}", "") and not self.newline():
            self.fail()

    # statements ---------------------------------------------------------------------------------------
    def program(self) -> None:
        self.statements(self.module_item, "", "top")

    def module_item(self) -> None:
        t = self.toks[self.i]
        if t == "import" and self.toks[self.i + 1] not in ("(", "."):
            self.import_()
        elif t == "export":
            self.export()
        else:
            self.statement(True)

    def block(self, kind: str = "body") -> None:
        self.eat("{")
        self.statements(lambda: self.statement(True), "}", "outside" if kind == "body" and not self.function else kind)

    def statement(self, declaration: bool = False) -> None:
        t = self.toks[self.i]
        if t == "a" or not t.isalpha():
            if t == "{":
                return self.block()
            if t == ";":
                self.i += 1
                return
            if t == "@":
                self.decorators()
                if self.toks[self.i] == "export":
                    return self.export()
                self.opt("abstract")
                return self.class_(True)
            if t == "a" and self.toks[self.i + 1] == ":":
                self.i += 2
                return self.statement()
            self.expression()
            return self.semicolon()
        rule = getattr(self, "s_" + t, None)
        if rule is not None and rule(declaration) is not False:
            return
        if self.ts and self.ts_statement(t):
            return
        if self.is_name() and self.toks[self.i + 1] == ":":
            self.i += 2
            return self.statement()
        self.expression()
        self.semicolon()

    def s_const(self, declaration):
        if self.ts and self.toks[self.i + 1] == "enum":
            self.i += 1
            return self.enum()
        if not declaration:
            self.fail("a declaration can't stand here")
        self.var()
        self.semicolon()

    def s_let(self, declaration):
        t = self.toks[self.i + 1]
        if not (t in ("[", "{") or self.is_name(1) or t in ("yield", "await", "let")):
            return False
        return self.s_const(declaration)

    def s_var(self, declaration):
        self.var()
        self.semicolon()

    def var(self, loop: bool = False) -> None:
        const = self.toks[self.i] == "const"
        self.i += 1
        while True:
            pattern = self.toks[self.i] in ("[", "{")
            self.binding()
            if self.ts:
                self.opt("!")
                if self.opt(":"):
                    self.type()
            if self.opt("="):
                self.assignment(not loop)
            elif loop and self.toks[self.i] in ("of", "in"):
                return
            elif (pattern or const) and not self.ambient and not loop:
                self.fail("missing initializer")
            if not self.opt(","):
                return

    ambient = False

    def binding(self) -> None:
        t = self.toks[self.i]
        if t == "[":
            self.i += 1
            while self.toks[self.i] != "]":
                if self.opt(","):
                    continue
                self.opt("...")
                self.binding()
                if self.opt("="):
                    self.assignment()
                if self.toks[self.i] != "]":
                    self.eat(",")
            self.i += 1
        elif t == "{":
            self.i += 1
            while self.toks[self.i] != "}":
                if self.opt("..."):
                    self.name()
                else:
                    named = self.is_name()
                    self.property_name()
                    if self.opt(":"):
                        self.binding()
                    elif not named:
                        self.fail()
                    if self.opt("="):
                        self.assignment()
                if self.toks[self.i] != "}":
                    self.eat(",")
            self.i += 1
        else:
            self.name()

    def s_function(self, declaration):
        self.i += 1
        self.opt("*")
        self.name()
        self.function_rest(True)

    def s_async(self, declaration):
        if self.toks[self.i + 1] != "function" or self.line[self.i] != self.line[self.i + 1]:
            return False
        self.i += 1
        return self.s_function(declaration)

    def function_rest(self, may_lack_body: bool = False) -> None:
        if self.ts and self.toks[self.i] == "<":
            self.type_parameters()
        self.parameters()
        if self.ts and self.opt(":"):
            self.return_type()
        if self.ts and may_lack_body and self.toks[self.i] != "{":
            return self.semicolon()
        self.function_body()

    def function_body(self) -> None:
        self.function += 1
        try:
            self.block("function")
        finally:
            self.function -= 1

    def parameters(self) -> None:
        self.eat("(")
        while self.toks[self.i] != ")":
            if self.toks[self.i] == "@":
                self.decorators()
            rest = self.opt("...")
            if self.ts:
                while self.toks[self.i] in ("public", "private", "protected", "readonly", "override") and (self.is_name(1) or self.toks[self.i + 1] in ("public", "private", "protected", "readonly", "override", "{", "[")):
                    self.i += 1
                if self.opt("this"):
                    self.eat(":")
                    self.type()
                    if self.toks[self.i] != ")":
                        self.eat(",")
                    continue
            self.binding()
            if self.ts:
                self.opt("?")
                if self.opt(":"):
                    self.type()
            if not rest and self.opt("="):
                self.assignment()
            if self.toks[self.i] != ")":
                self.eat(",")
                if rest and not self.ts:
                    self.fail("parameter after rest")
        self.i += 1

    def s_class(self, declaration):
        self.class_(True)

    def class_(self, named: bool) -> None:
        self.eat("class")
        if named or (self.is_name() and self.toks[self.i] != "extends" and not (self.toks[self.i] == "implements")):
            self.name()
        if self.ts and self.toks[self.i] == "<":
            self.type_parameters()
        if self.opt("extends"):
            self.left_hand()
            if self.ts and self.toks[self.i] == "<":
                self.type_arguments()
        if self.ts and self.opt("implements"):
            self.type()
            while self.opt(","):
                self.type()
        self.eat("{")
        self.statements(self.member, "}", "class")

    MODIFIERS = frozenset("public private protected readonly abstract override declare static async get set accessor".split())

    def member(self) -> None:
        if self.opt(";"):
            return
        if self.toks[self.i] == "@":
            self.decorators()
        mine = self.MODIFIERS if self.ts else frozenset(["static", "async", "get", "set", "accessor"])
        abstract = False
        while (t := self.toks[self.i]) in mine:
            after = self.toks[self.i + 1]
            if t == "static" and after == "{":
                self.i += 1
                return self.block("function")
            if after in ("(", "=", ";", "}", ":", "?", "!", "<", ",") or (after == "" and False):
                break
            if t in ("get", "set", "async") and self.line[self.i + 1] != self.line[self.i] and after != "[":
                break
            abstract |= t in ("abstract", "declare")
            self.i += 1
        self.opt("*")
        if self.ts and self.toks[self.i] == "[" and self.toks[self.i + 1].isalpha() and self.toks[self.i + 2] == ":":
            self.i += 2
            self.i += 1
            self.type()
            self.eat("]")
            if self.opt(":"):
                self.type()
            return self.member_end()
        self.property_name(True)
        if self.ts:
            self.opt("?") or self.opt("!")
        if self.toks[self.i] in ("(", "<"):
            return self.function_rest(True)
        if self.ts and self.opt(":"):
            self.type()
        if self.opt("="):
            self.assignment()
        self.member_end()

    def member_end(self) -> None:
        if not self.opt(";") and self.toks[self.i] != "}" and not self.newline():
            self.fail()

    def property_name(self, private: bool = False) -> None:
        t = self.toks[self.i]
        if t == "[":
            self.i += 1
            self.assignment()
            self.eat("]")
        elif t in ("N", "S"):
            self.i += 1
        else:
            self.any_word()

    def s_if(self, declaration):
        self.i += 1
        self.bracketed()
        self.statement()
        if self.opt("else"):
            self.statement()

    def bracketed(self) -> None:
        self.eat("(")
        self.expression()
        self.eat(")")

    def s_while(self, declaration):
        self.i += 1
        self.bracketed()
        self.statement()

    def s_do(self, declaration):
        self.i += 1
        self.statement()
        self.eat("while")
        self.bracketed()
        self.opt(";")

    def s_for(self, declaration):
        self.i += 1
        self.opt("await")
        self.eat("(")
        t = self.toks[self.i]
        if t in ("var", "const") or (t == "let" and self.toks[self.i + 1] not in ("=", ";", "of", "in")):
            self.var(True)
        elif t != ";":
            self.expression(False)
        if self.toks[self.i] in ("of", "in"):
            self.i += 1
            self.expression()
        else:
            self.eat(";")
            if self.toks[self.i] != ";":
                self.expression()
            self.eat(";")
            if self.toks[self.i] != ")":
                self.expression()
        self.eat(")")
        self.statement()

    def s_continue(self, declaration):
        self.i += 1
        if self.is_name() and not self.newline():
            self.i += 1
        self.semicolon()

    s_break = s_continue

    def s_debugger(self, declaration):
        self.i += 1
        self.semicolon()

    def s_return(self, declaration):
        if not self.function:
            self.fail("return outside a function")
        self.i += 1
        if self.toks[self.i] not in (";", "}", "") and not self.newline():
            self.expression()
        self.semicolon()

    def s_throw(self, declaration):
        self.i += 1
        if self.newline():
            self.fail()
        self.expression()
        self.semicolon()

    def s_try(self, declaration):
        self.i += 1
        self.block()
        caught = self.opt("catch")
        if caught:
            if self.opt("("):
                self.binding()
                if self.ts and self.opt(":"):
                    self.type()
                self.eat(")")
            self.block()
        if self.opt("finally"):
            self.block()
        elif not caught:
            self.fail("expected 'catch' or 'finally'")

    def s_switch(self, declaration):
        self.i += 1
        self.bracketed()
        self.eat("{")
        self.statements(self.case, "}", "switch")

    def case(self) -> None:
        if self.opt("default"):
            self.eat(":")
        elif self.toks[self.i] == "case":
            self.i += 1
            self.expression()
            self.eat(":")
        else:
            self.fail()
        while self.toks[self.i] not in ("case", "default", "}", ""):
            self.statement(True)

    def import_(self) -> None:
        self.i += 1
        if self.opt("S"):
            return self.import_end()
        if self.ts and self.toks[self.i] == "type" and (self.toks[self.i + 1] in ("{", "*") or (self.is_name(1) and self.toks[self.i + 1] != "from")):
            self.i += 1
        if self.is_name():
            self.i += 1
            if self.ts and self.opt("="):
                if self.opt("require"):
                    self.eat("(")
                    self.eat("S")
                    self.eat(")")
                else:
                    self.name()
                    while self.opt("."):
                        self.any_word()
                return self.semicolon()
            if not self.opt(","):
                self.eat("from")
                self.eat("S")
                return self.import_end()
        if self.opt("*"):
            self.eat("as")
            self.name()
        else:
            self.specifiers(True)
        self.eat("from")
        self.eat("S")
        self.import_end()

    def import_end(self) -> None:
        if self.toks[self.i] in ("with", "assert") and not self.newline():
            self.i += 1
            self.object()
        self.semicolon()

    def specifiers(self, importing: bool) -> None:
        self.eat("{")
        while self.toks[self.i] != "}":
            if self.ts and self.toks[self.i] == "type" and self.toks[self.i + 1] not in (",", "}", "as"):
                self.i += 1
            if not self.opt("S"):
                if importing and self.toks[self.i + 1] != "as" and not self.is_name():
                    self.fail()
                self.any_word()
            if self.opt("as"):
                if not self.opt("S"):
                    self.name() if importing else self.any_word()
            if self.toks[self.i] != "}":
                self.eat(",")
        self.i += 1

    def export(self) -> None:
        self.i += 1
        t = self.toks[self.i]
        if t == "default":
            self.i += 1
            t = self.toks[self.i]
            if t == "function" or (t == "async" and self.toks[self.i + 1] == "function"):
                self.opt("async")
                self.i += 1
                self.opt("*")
                if self.is_name():
                    self.i += 1
                return self.function_rest(True)
            if t == "@":
                self.decorators()
            if self.ts and self.opt("abstract") or self.toks[self.i] == "class":
                return self.class_(False)
            if self.ts and t == "interface":
                return self.interface()
            self.assignment()
            return self.semicolon()
        if t == "*":
            self.i += 1
            if self.opt("as"):
                if not self.opt("S"):
                    self.any_word()
            self.eat("from")
            self.eat("S")
            return self.import_end()
        if t == "{" or (self.ts and t == "type" and self.toks[self.i + 1] in ("{", "*")):
            self.opt("type")
            if self.opt("*"):
                if self.opt("as"):
                    self.name()
                self.eat("from")
                self.eat("S")
                return self.import_end()
            self.specifiers(False)
            if self.opt("from"):
                self.eat("S")
                return self.import_end()
            return self.semicolon()
        if self.ts and t == "=":
            self.i += 1
            self.expression()
            return self.semicolon()
        if self.ts and t == "as":
            self.i += 1
            self.eat("namespace")
            self.name()
            return self.semicolon()
        if self.ts and t == "import":
            return self.import_()
        if t == "@":
            self.decorators()
            self.opt("abstract")
            return self.class_(True)
        if t in ("var", "let", "const", "function", "class") or (t == "async" and self.toks[self.i + 1] == "function"):
            return self.statement(True)
        if not (self.ts and self.ts_statement(t)):
            self.fail()

    def decorators(self) -> None:
        while self.opt("@"):
            if self.toks[self.i] == "(":
                self.bracketed()
                continue
            self.any_word()
            while self.opt("."):
                self.any_word()
            if self.toks[self.i] == "(":
                self.arguments()

    # expressions: n name, t member, p pattern, x other ---------------------------------------------------
    def expression(self, in_ok: bool = True) -> str:
        k = self.assignment(in_ok)
        while self.opt(","):
            self.assignment(in_ok)
            k = "x"
        return k

    no_in = False

    def assignment(self, in_ok: bool = True) -> str:
        t = self.toks[self.i]
        if self.arrow_ahead(t):
            return "x"
        if t == "yield" and self.function:
            self.i += 1
            if self.toks[self.i] not in (")", "]", "}", ",", ";", ":", "") and not self.newline():
                self.opt("*")
                self.assignment(in_ok)
            return "x"
        if not in_ok and not self.no_in:
            self.no_in = True
            saved, self.BINARY = self.BINARY, {k: v for k, v in self.BINARY.items() if k != "in"}
            try:
                k = self.binary()
            finally:
                self.no_in, self.BINARY = False, saved
        else:
            k = self.binary()
        t = self.toks[self.i]
        if t == "?":
            self.i += 1
            self.assignment()
            self.eat(":")
            self.assignment(in_ok)
            return "x"
        if t in ASSIGN:
            if k not in ("n", "t", "p") or (k == "p" and t != "="):
                self.fail("invalid assignment target")
            self.i += 1
            self.assignment(in_ok)
            return "x"
        return k

    def arrow_ahead(self, t: str) -> bool:
        """Parse an arrow function if one begins here."""
        i = self.i
        a = i
        if t == "async" and self.line[i] == self.line[i + 1] and (self.toks[i + 1] == "(" or self.is_name(1) or self.toks[i + 1] == "<"):
            a = i + 1
            t = self.toks[a]
        if t == "(":
            j = self.match[a]
            if not j:
                return False
            after = self.toks[j + 1]
            if after == "=>" or (self.ts and after == ":"):
                self.i = a
                if after == "=>":
                    self.parameters()
                elif not self.speculate(self.typed_arrow):
                    self.i = i
                    return False
                return self.arrow_rest()
            return False
        if self.ts and t == "<":
            self.i = a
            if self.speculate(lambda: (self.type_parameters(), self.parameters(), self.opt(":") and self.return_type(), self.peek("=>"))):
                return self.arrow_rest()
            self.i = i
            return False
        if (t == "a" or (t.isalpha() and t not in RESERVED and t not in "NSX")) and self.toks[a + 1] == "=>":
            self.i = a + 1
            return self.arrow_rest()
        return False

    def peek(self, t: str) -> None:
        if self.toks[self.i] != t:
            self.fail()

    def typed_arrow(self) -> None:
        self.parameters()
        self.eat(":")
        self.return_type()
        self.peek("=>")

    def arrow_rest(self) -> bool:
        if self.newline():
            self.fail()
        self.eat("=>")
        if self.toks[self.i] == "{":
            self.function_body()
        else:
            self.function += 1
            self.assignment()
            self.function -= 1
        return True

    UNARY = frozenset(["!", "~", "+", "-", "typeof", "void", "delete"])

    def binary(self, least: int = 1) -> str:
        k = self.unary()
        while True:
            t = self.toks[self.i]
            if t == ">" and self.toks[self.i + 1] == ">":
                n = 2 + (self.toks[self.i + 2] == ">")
                if self.toks[self.i + n] in (">=", "="):
                    return k
                if 8 < least:
                    return k
                self.i += n
                self.binary(9)
                k = "x"
                continue
            p = self.BINARY.get(t, 0)
            if p < least or not p:
                if self.ts and t in ("as", "satisfies") and not self.newline() and least <= 7:
                    self.i += 1
                    if not self.opt("const"):
                        self.type()
                    k = "x" if k not in ("n", "t") else "t"
                    continue
                return k
            self.i += 1
            self.binary(p if t == "**" else p + 1)
            k = "x"

    def unary(self) -> str:
        t = self.toks[self.i]
        if t in self.UNARY:
            self.i += 1
            self.unary()
            return "x"
        if t in ("++", "--"):
            self.i += 1
            if self.unary() not in ("n", "t"):
                self.fail("invalid operand")
            return "x"
        if t == "await":
            self.i += 1
            self.unary()
            return "x"
        if self.ts and t == "<":
            self.i += 1
            self.type()
            self.close_angle()
            self.unary()
            return "x"
        k = self.left_hand()
        if self.toks[self.i] in ("++", "--") and not self.newline():
            if k not in ("n", "t"):
                self.fail("invalid operand")
            self.i += 1
            return "x"
        return k

    def left_hand(self) -> str:
        t = self.toks[self.i]
        if t == "new":
            self.i += 1
            if self.opt("."):
                self.any_word()
                k = "x"
            else:
                self.new_target()
                k = "x"
        elif t == "import":
            self.i += 1
            if self.opt("."):
                self.any_word()
            else:
                self.arguments()
            k = "x"
        elif t == "super":
            self.i += 1
            if self.toks[self.i] not in ("(", ".", "["):
                self.fail()
            k = "x"
        else:
            k = self.primary()
        return self.postfix(k, True)

    def new_target(self) -> None:
        if self.toks[self.i] == "new":
            self.i += 1
            self.new_target()
        else:
            self.postfix(self.primary(), False)
        if self.ts and self.toks[self.i] == "<":
            self.speculate(lambda: (self.type_arguments(), self.peek("(")))
        if self.toks[self.i] == "(":
            self.arguments()

    def postfix(self, k: str, calls: bool) -> str:
        while True:
            t = self.toks[self.i]
            if t == ".":
                self.i += 1
                if self.toks[self.i].startswith("#"):
                    self.i += 1
                else:
                    self.any_word()
                k = "t"
            elif t == "?." and calls:
                self.i += 1
                if self.toks[self.i] == "(":
                    self.arguments()
                elif self.opt("["):
                    self.expression()
                    self.eat("]")
                else:
                    self.any_word()
                k = "x"
            elif t == "[":
                self.i += 1
                self.expression()
                self.eat("]")
                k = "t"
            elif t == "(" and calls:
                self.arguments()
                k = "x"
            elif self.ts and t == "!" and not self.newline():
                self.i += 1
            elif self.ts and t == "<" and calls and self.speculate(lambda: (self.type_arguments(), self.peek("("))):
                self.arguments()
                k = "x"
            else:
                return k

    def arguments(self) -> None:
        self.eat("(")
        while self.toks[self.i] != ")":
            self.opt("...")
            self.assignment()
            if self.toks[self.i] != ")":
                self.eat(",")
        self.i += 1

    def primary(self) -> str:
        t = self.toks[self.i]
        if t == "a":
            self.i += 1
            return "n"
        if t in ("S", "N", "this", "null", "true", "false"):
            self.i += 1
            return "x"
        if t == "(":
            self.i += 1
            k = self.expression()
            self.eat(")")
            return k if k != "p" else "x"
        if t == "[":
            self.i += 1
            while self.toks[self.i] != "]":
                if self.opt(","):
                    continue
                self.opt("...")
                self.assignment()
                if self.toks[self.i] != "]":
                    self.eat(",")
            self.i += 1
            return "p"
        if t == "{":
            self.object()
            return "p"
        if t == "function" or (t == "async" and self.toks[self.i + 1] == "function"):
            self.opt("async")
            self.i += 1
            self.opt("*")
            if self.is_name():
                self.i += 1
            self.function_rest()
            return "x"
        if t == "class":
            self.class_(False)
            return "x"
        if t == "@":
            self.decorators()
            self.class_(False)
            return "x"
        if t.startswith("#") and self.toks[self.i + 1] == "in":
            self.i += 1
            return "x"
        self.name()
        return "n"

    def object(self) -> None:
        self.eat("{")
        self.statements(self.property, "}", "object")

    def property(self) -> None:
        if self.opt("..."):
            self.assignment()
        else:
            method = False
            while self.toks[self.i] in ("get", "set", "async") and self.toks[self.i + 1] not in (",", "}", ":", "(", "=", "<"):
                self.i += 1
                method = True
            method |= self.opt("*")
            named = self.is_name() or self.toks[self.i] in ("await", "yield")
            self.property_name()
            if self.toks[self.i] in ("(", "<"):
                self.function_rest()
            elif method:
                self.fail()
            elif self.opt(":"):
                self.assignment()
            elif not named:
                self.fail()
            elif self.opt("="):
                self.assignment()
        if self.toks[self.i] != "}":
            self.eat(",")

    # TypeScript: overridden below -------------------------------------------------------------------------
    def ts_statement(self, t: str) -> bool:
        return False


class TypeScriptParser(EcmaParser):
    ts = True

    def ts_statement(self, t: str) -> bool:
        after = self.toks[self.i + 1]
        same_line = self.line[self.i] == self.line[self.i + 1]
        if t == "interface" and self.is_name(1):
            self.interface()
        elif t == "type" and self.is_name(1) and same_line:
            self.i += 2
            if self.toks[self.i] == "<":
                self.type_parameters()
            self.eat("=")
            self.type()
            self.semicolon()
        elif t == "enum":
            self.enum()
        elif t == "abstract" and after == "class":
            self.i += 1
            self.class_(True)
        elif t in ("namespace", "module") and (self.is_name(1) or after == "S") and same_line:
            self.i += 1
            if not self.opt("S"):
                self.name()
                while self.opt("."):
                    self.any_word()
            if self.toks[self.i] == "{":
                self.eat("{")
                self.statements(self.module_item, "}", "top")
            else:
                self.semicolon()
        elif t == "global" and after == "{":
            self.i += 1
            self.eat("{")
            self.statements(self.module_item, "}", "top")
        elif t == "declare" and after.isalpha() and same_line:
            self.i += 1
            saved, self.ambient = self.ambient, True
            try:
                self.module_item()
            finally:
                self.ambient = saved
        else:
            return False
        return True

    def interface(self) -> None:
        self.i += 1
        self.name()
        if self.toks[self.i] == "<":
            self.type_parameters()
        if self.opt("extends"):
            self.type()
            while self.opt(","):
                self.type()
        self.object_type()

    def enum(self) -> None:
        self.eat("enum")
        self.name()
        self.eat("{")
        self.statements(self.enumerator, "}", "enum")

    def enumerator(self) -> None:
        self.property_name()
        if self.opt("="):
            self.assignment()
        if self.toks[self.i] != "}":
            self.eat(",")

    # types --------------------------------------------------------------------------------------------------
    def close_angle(self) -> None:
        t = self.toks[self.i]
        if t == ">":
            self.i += 1
        elif t in (">=", ">>=", ">>>="):
            self.toks[self.i] = t[1:]
        else:
            self.fail()

    def type_parameters(self) -> None:
        self.eat("<")
        while True:
            while self.toks[self.i] in ("const", "in", "out") and self.toks[self.i + 1] not in (",", ">", "="):
                self.i += 1
            self.name()
            if self.opt("extends"):
                self.type()
            if self.opt("="):
                self.type()
            if not self.opt(",") or self.toks[self.i] == ">":
                break
        self.close_angle()

    def type_arguments(self) -> None:
        self.eat("<")
        self.type()
        while self.opt(","):
            self.type()
        self.close_angle()

    def return_type(self) -> None:
        if self.toks[self.i] == "asserts" and (self.is_name(1) or self.toks[self.i + 1] == "this") and self.line[self.i] == self.line[self.i + 1]:
            self.i += 2
            if self.opt("is"):
                self.type()
            return
        if (self.is_name() or self.toks[self.i] == "this") and self.toks[self.i + 1] == "is":
            self.i += 2
        self.type()

    def type(self) -> None:
        if self.toks[self.i] == "<":
            self.type_parameters()
            return self.function_type()
        if self.toks[self.i] == "new" or (self.toks[self.i] == "abstract" and self.toks[self.i + 1] == "new"):
            self.opt("abstract")
            self.i += 1
            if self.toks[self.i] == "<":
                self.type_parameters()
            return self.function_type()
        if self.toks[self.i] == "(" and (j := self.match[self.i]) and self.toks[j + 1] == "=>":
            return self.function_type()
        self.union()
        if self.toks[self.i] == "extends" and not self.newline():
            self.i += 1
            self.union()
            self.eat("?")
            self.type()
            self.eat(":")
            self.type()

    def function_type(self) -> None:
        self.parameters()
        self.eat("=>")
        self.return_type()

    def union(self) -> None:
        self.opt("|") or self.opt("&")
        while True:
            while self.toks[self.i] in ("keyof", "unique", "readonly", "infer") and self.toks[self.i + 1] not in (",", ">", ")", ";", "=", "|", "]", "}"):
                self.i += 1
            self.postfix_type()
            if self.toks[self.i] not in ("|", "&"):
                return
            self.i += 1

    def postfix_type(self) -> None:
        self.primary_type()
        while self.toks[self.i] == "[" and not self.newline():
            self.i += 1
            if not self.opt("]"):
                self.type()
                self.eat("]")

    def primary_type(self) -> None:
        t = self.toks[self.i]
        if t == "(":
            if (j := self.match[self.i]) and self.toks[j + 1] == "=>":
                return self.function_type()
            self.i += 1
            self.type()
            self.eat(")")
        elif t == "[":
            self.i += 1
            while self.toks[self.i] != "]":
                self.opt("...")
                if self.toks[self.i].isalpha() and self.toks[self.i + 1] == ":":
                    self.i += 2
                elif self.toks[self.i].isalpha() and self.toks[self.i + 1] == "?" and self.toks[self.i + 2] == ":":
                    self.i += 3
                self.type()
                self.opt("?")
                if self.toks[self.i] != "]":
                    self.eat(",")
            self.i += 1
        elif t == "{":
            self.object_type()
        elif t in ("S", "N", "null", "true", "false", "this", "void"):
            self.i += 1
            while t == "S" and self.opt("+"):  # a template
                self.eat("(")
                self.type()
                self.eat(")")
                self.eat("+")
                self.eat("S")
        elif t == "-":
            self.i += 1
            self.eat("N")
        elif t == "typeof":
            self.i += 1
            self.opt("import") and self.arguments()
            self.any_word() if self.toks[self.i].isalpha() else None
            while self.opt("."):
                self.any_word()
            if self.toks[self.i] == "<" and not self.newline():
                self.type_arguments()
        elif t == "import":
            self.i += 1
            self.arguments()
            while self.opt("."):
                self.any_word()
            if self.toks[self.i] == "<":
                self.type_arguments()
        else:
            self.name()
            while self.opt("."):
                self.any_word()
            if self.toks[self.i] == "<" and not self.newline():
                self.type_arguments()

    def object_type(self) -> None:
        self.eat("{")
        self.statements(self.type_member, "}", "type")

    def type_member(self) -> None:
        if self.toks[self.i] in ("+", "-"):
            self.i += 1
        while self.toks[self.i] in ("readonly", "get", "set", "static") and self.toks[self.i + 1] not in (":", "?", "(", "<", ";", ",", "}"):
            self.i += 1
        t = self.toks[self.i]
        if t == "new" and self.toks[self.i + 1] in ("(", "<"):
            self.i += 1
            t = self.toks[self.i]
        if t in ("(", "<"):
            self.signature()
        elif t == "[" and self.toks[self.i + 1].isalpha() and self.toks[self.i + 2] in (":", "in"):
            self.i += 3
            self.type()
            if self.opt("as"):
                self.type()
            self.eat("]")
            if self.toks[self.i] in ("+", "-"):
                self.i += 1
            self.opt("?")
            if self.opt(":"):
                self.type()
        else:
            self.property_name()
            self.opt("?")
            if self.toks[self.i] in ("(", "<"):
                self.signature()
            elif self.opt(":"):
                self.type()
        if not (self.opt(";") or self.opt(",")) and self.toks[self.i] != "}" and not self.newline():
            self.fail()

    def signature(self) -> None:
        if self.toks[self.i] == "<":
            self.type_parameters()
        self.parameters()
        if self.opt(":"):
            self.return_type()
