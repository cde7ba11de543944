"""The declarative backend: declarations, imports, inheritance and calls of 17 languages by rules.

Comments and strings are blanked first, so rules see code only.  A rule is a pattern with named groups;
the extent of a declaration is its balanced braces, or up to the ``end`` of its indentation.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from quarry.syntax.facts import METHOD_CONTAINERS, Facts, attach_docs, first_wins, span
from quarry.syntax.python_ast import module_path, module_symbol

_C_LITERALS = r"//[^\n]*|/\*[\s\S]*?(?:\*/|$)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
_HASH_LITERALS = r"#[^\n]*|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'"
LITERALS = {"lua": r"--\[\[[\s\S]*?\]\]|--[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", "ruby": _HASH_LITERALS, "bash": _HASH_LITERALS, "php": r"#[^\n]*|" + _C_LITERALS, "javascript": _C_LITERALS + r"|`(?:[^`\\]|\\.)*`", "go": _C_LITERALS + r"|`[^`]*`"}
LITERALS["typescript"] = LITERALS["tsx"] = LITERALS["javascript"]
END_BLOCKS = frozenset(["ruby", "lua"])

_MOD = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|override|virtual|async|export|default|declare|data|inline|suspend|partial|readonly|synchronized|native|implicit|case|lazy|pub(?:\([^)]*\))?|unsafe|extern|const|fileprivate|mutating|required|convenience|external|factory|covariant|late)\s+)*"
_PAREN = r"\([^;{}]*?\)"
_JS = [("class", rf"^[ \t]*{_MOD}class\s+(?P<name>[\w$]+)"), ("function", rf"^[ \t]*{_MOD}function\s*\*?\s*(?P<name>[\w$]+)\s*(?:<[^>]*>)?\s*\("), ("function", r"^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^;{}]*?\)|[\w$]+)\s*(?::[^={]+)?=>"), ("member", rf"^[ \t]+{_MOD}(?:get\s+|set\s+)?\*?(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b|new\b)(?P<name>[\w$#]+)\s*(?:<[^>]*>)?{_PAREN}\s*(?::[^={{;\n]+)?\{{")]
_TS = [*_JS, ("interface", rf"^[ \t]*{_MOD}interface\s+(?P<name>[\w$]+)"), ("enum", rf"^[ \t]*{_MOD}enum\s+(?P<name>[\w$]+)"), ("type", rf"^[ \t]*{_MOD}type\s+(?P<name>[\w$]+)[^=\n]*=")]
_CURLY_FN = rf"^[ \t]*(?=[^\n;=({{}}]*[\s*&]~?\w+\s*\(){_MOD}(?!return\b|else\b|new\b|throw\b|if\b|for\b|while\b|switch\b|using\b|namespace\b|package\b|import\b)(?:<[^>]+>\s*)?[\w:<>\[\],.?*&~ ]+?[\s*&](?P<name>~?\w+)\s*{_PAREN}[^;{{}}()=]*\{{"
#: language -> (kind of declaration, pattern)
DEFINITIONS: dict[str, list[tuple[str, str]]] = {
    "javascript": _JS,
    "typescript": _TS,
    "tsx": _TS,
    "java": [("class", rf"^[ \t]*{_MOD}(?:class|record)\s+(?P<name>\w+)"), ("interface", rf"^[ \t]*{_MOD}@?interface\s+(?P<name>\w+)"), ("enum", rf"^[ \t]*{_MOD}enum\s+(?P<name>\w+)"), ("constructor", rf"^[ \t]+(?:public|private|protected)\s+(?P<name>[A-Z]\w*)\s*{_PAREN}[^;{{}}]*\{{"), ("member", _CURLY_FN)],
    "go": [("method", r"^func\s+\([^)]*\)\s*(?P<name>\w+)\s*(?:\[[^\]]*\])?\("), ("function", r"^func\s+(?P<name>\w+)\s*(?:\[[^\]]*\])?\("), ("class", r"^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+struct\b"), ("interface", r"^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+interface\b"), ("type", r"^type\s+(?P<name>\w+)\s+(?!struct\b|interface\b)[\w\[\]*.]+")],
    "rust": [("class", rf"^[ \t]*{_MOD}struct\s+(?P<name>\w+)"), ("enum", rf"^[ \t]*{_MOD}enum\s+(?P<name>\w+)"), ("interface", rf"^[ \t]*{_MOD}trait\s+(?P<name>\w+)"), ("impl", r"^[ \t]*(?:unsafe\s+)?impl\b(?P<name>)"), ("type", rf"^[ \t]*{_MOD}type\s+(?P<name>\w+)"), ("module", rf"^[ \t]*{_MOD}mod\s+(?P<name>\w+)\s*\{{"), ("function", rf"^[ \t]*{_MOD}fn\s+(?P<name>\w+)")],
    "c": [("class", r"^[ \t]*(?:typedef\s+)?(?:struct|union)\s+(?P<name>\w+)\s*\{"), ("enum", r"^[ \t]*(?:typedef\s+)?enum\s+(?P<name>\w+)\s*\{"), ("function", _CURLY_FN)],
    "cpp": [("class", r"^[ \t]*(?:class|struct)\s+(?P<name>\w+)[^;{]*\{"), ("enum", r"^[ \t]*enum\s+(?:class\s+)?(?P<name>\w+)"), ("module", r"^[ \t]*namespace\s+(?P<name>\w+)"), ("type", r"^[ \t]*using\s+(?P<name>\w+)\s*="), ("member", _CURLY_FN)],
    "csharp": [("class", rf"^[ \t]*{_MOD}(?:class|struct|record)\s+(?P<name>\w+)"), ("interface", rf"^[ \t]*{_MOD}interface\s+(?P<name>\w+)"), ("enum", rf"^[ \t]*{_MOD}enum\s+(?P<name>\w+)"), ("module", r"^[ \t]*namespace\s+(?P<name>[\w.]+)"), ("member", _CURLY_FN)],
    "ruby": [("class", r"^[ \t]*class\s+(?P<name>\w+)"), ("module", r"^[ \t]*module\s+(?P<name>\w+)"), ("method", r"^[ \t]*def\s+(?:self\.)?(?P<name>\w+[?!=]?)")],
    "php": [("class", rf"^[ \t]*{_MOD}(?:class|trait)\s+(?P<name>\w+)"), ("interface", r"^[ \t]*interface\s+(?P<name>\w+)"), ("enum", r"^[ \t]*enum\s+(?P<name>\w+)"), ("function", rf"^[ \t]*{_MOD}function\s+&?(?P<name>\w+)")],
    "kotlin": [("interface", rf"^[ \t]*{_MOD}interface\s+(?P<name>\w+)"), ("enum", rf"^[ \t]*{_MOD}enum\s+class\s+(?P<name>\w+)"), ("class", rf"^[ \t]*{_MOD}(?:class|object)\s+(?P<name>\w+)"), ("function", rf"^[ \t]*{_MOD}fun\s+(?:<[^>]*>\s*)?(?:[\w<>]+\.)?(?P<name>\w+)"), ("constructor", rf"^[ \t]*{_MOD}class\s+\w+(?:<[^>]*>)?\s*(?:{_MOD}constructor\s*)?(?P<name>\([^()]*(?:\([^()]*\)[^()]*)*\))"), ("constructor", r"^[ \t]+(?:(?:private|protected|public|internal)\s+)?(?P<name>constructor\([^()]*\))")],
    "swift": [("class", rf"^[ \t]*{_MOD}(?:class|struct|actor|extension)\s+(?P<name>\w+)"), ("enum", rf"^[ \t]*{_MOD}enum\s+(?P<name>\w+)"), ("interface", rf"^[ \t]*{_MOD}protocol\s+(?P<name>\w+)"), ("function", rf"^[ \t]*{_MOD}func\s+(?P<name>\w+)"), ("constructor", rf"^[ \t]+{_MOD}(?P<name>init)\b[?!]?\s*(?:<[^>]*>)?\(")],
    "scala": [("interface", rf"^[ \t]*{_MOD}trait\s+(?P<name>\w+)"), ("class", rf"^[ \t]*{_MOD}class\s+(?P<name>\w+)"), ("module", rf"^[ \t]*{_MOD}object\s+(?P<name>\w+)"), ("type", rf"^[ \t]*{_MOD}type\s+(?P<name>\w+)"), ("method", rf"^[ \t]*{_MOD}def\s+(?P<name>\w+)")],
    "lua": [("method", r"^[ \t]*function\s+\w+[.:](?P<name>\w+)"), ("function", r"^[ \t]*(?:local\s+)?function\s+(?P<name>\w+)\s*\(")],
    "bash": [("function", r"^[ \t]*function\s+(?P<name>[\w-]+)"), ("function", r"^[ \t]*(?P<name>[\w-]+)\s*\(\)")],
    "dart": [("enum", r"^[ \t]*enum\s+(?P<name>\w+)"), ("class", rf"^[ \t]*{_MOD}(?:class|mixin|extension)\s+(?P<name>\w+)"), ("member", _CURLY_FN)],
}
_ARGS = r"\([^;{}=]*\)"
#: Declarations that end with their statement: packages and namespaces of a file, and members without a body, which count
#: only directly inside of a class or interface.
STATEMENTS: dict[str, list[tuple[str, str]]] = {
    "java": [("package", r"^package\s+(?P<name>[\w.]+)\s*;"), ("member", rf"^[ \t]+(?=[^\n;=({{}}]*[\w>\]]\s+\w+\s*\(){_MOD}(?!return\b|new\b|throw\b|else\b)(?:<[^>]+>\s*)?[\w<>\[\],.? ]+?\s(?P<name>\w+)\s*{_ARGS}\s*(?:throws\s+[\w., ]+)?;")],
    "csharp": [("member", rf"^[ \t]+(?=[^\n;=({{}}]*[\w>\]?]\s+\w+\s*(?:<[^>]*>)?\(){_MOD}(?!return\b|new\b|throw\b|else\b|await\b)[\w<>\[\],.? ]+?\s(?P<name>\w+)\s*(?:<[^>]*>)?{_ARGS}\s*;")],
    "cpp": [("member", rf"^[ \t]+(?:virtual\s+|static\s+|explicit\s+|inline\s+)*(?!return\b|new\b|throw\b|delete\b|else\b)[\w:<>*&, ]+?[\s*&](?P<name>~?\w+)\s*{_ARGS}\s*(?:const\b|override\b|noexcept\b|=\s*(?:0|default|delete)|\s)*;"), ("type", r"^[ \t]*typedef\s+[^;{}]*?(?P<name>\w+)\s*;")],
    "c": [("type", r"^[ \t]*typedef\s+[^;{}]*?(?P<name>\w+)\s*;")],
    "dart": [("member", rf"^[ \t]+{_MOD}(?!return\b|new\b|throw\b|else\b|await\b|super\b|this\b)(?:[\w<>\[\],.? ]+?\s)?(?P<name>\w+)\s*\([^;{{}}]*?\)\s*(?::[^;{{]*)?;"), ("function", rf"^(?:[\w<>\[\],.? ]+\s)?(?P<name>\w+)\s*\([^;{{}}]*?\)\s*(?:async\s*)?=>")],
    "typescript": [("member", rf"^[ \t]+{_MOD}(?:get\s+|set\s+)?(?!return\b|if\b|for\b|while\b|switch\b|await\b|throw\b|new\b|super\b)(?P<name>[\w$#]+)\??\s*(?:<[^>]*>)?\([^;{{}}]*?\)\s*:[^;{{=\n]+;")],
    "go": [("package", r"^package\s+(?P<name>\w+)")], "kotlin": [("package", r"^package\s+(?P<name>[\w.]+)")], "php": [("package", r"^namespace\s+(?P<name>[\w\\]+)\s*;")], "scala": [("package", r"^package\s+(?P<name>[\w.]+)")],
}
STATEMENTS["tsx"] = STATEMENTS["typescript"]
#: The parameters of a class, which are its fields.
_CLASS_PARAMETER = re.compile(r"(?:(?<=\()|,)\s*(?:(?:private|protected|public|internal|override|vararg|val|var)\s+)*(?P<name>\w+)\s*:")
_ACCESS = r"(?:(?:public|private|protected|internal|static|final|readonly|const|volatile|transient|declare|abstract|override|late|external|covariant|open|lateinit|weak|lazy|required|fileprivate|unowned|mutable|var|abstract)\s+)*"
_TYPED = rf"^[ \t]+{_ACCESS}(?!return\b|throw\b|else\b|new\b|using\b|import\b|package\b|typedef\b|goto\b|delete\b|case\b|break\b|continue\b)[\w:<>\[\],.?*& ]+?[\s*&>\]](?P<name>\w+)(?:\[[^\]\n]*\])?\s*(?:=[^;\n]*)?;"
_ES_FIELD = rf"^[ \t]+{_ACCESS}(?!return\b|throw\b|break\b|continue\b|await\b|yield\b|delete\b)(?P<name>#?[\w$]+)\s*[?!]?\s*(?::[^=;\n(]+)?(?:=(?![=>])[^;\n]*)?;[ \t]*$"
#: Fields, which count only directly inside of a class, interface, struct or object (in Bash anywhere).
FIELDS: dict[str, str] = {
    "javascript": _ES_FIELD, "typescript": _ES_FIELD, "tsx": _ES_FIELD, "java": _TYPED, "csharp": _TYPED, "c": _TYPED, "cpp": _TYPED, "dart": _TYPED,
    "go": r"^[ \t]+(?P<name>\w+)(?:\s*,\s*\w+)*[ \t]+(?:\*|\[|map\b|chan\b|func\b|interface\b|struct\b|[A-Za-z_])[^\n(){]*$",
    "rust": r"^[ \t]+(?:pub(?:\([^)]*\))?\s+)?(?P<name>\w+)\s*:\s*[^,\n;({]+(?:,|$)",
    "php": r"^[ \t]+(?:(?:public|private|protected|static|readonly|var)\s+)+(?:\??[\w\\|]+\s+)?\$(?P<name>\w+)",
    "kotlin": rf"^[ \t]*{_ACCESS}(?:val|var)\s+(?P<name>\w+)", "swift": rf"^[ \t]*{_ACCESS}(?:let|var)\s+(?P<name>\w+)",
    "bash": r"^[ \t]*(?:(?:local|export|readonly|declare(?:[ \t]+-\w+)*)[ \t]+)?(?P<name>[A-Za-z_]\w*)=",
}
_ES_IMPORTS = [r"^[ \t]*import\s+(?:type\s+)?(?:(?P<names>[^'\"\n;]*?)\s+from\s+)?['\"](?P<module>[^'\"]+)['\"]", r"\brequire\(\s*['\"](?P<module>[^'\"]+)['\"]\s*\)"]
IMPORTS: dict[str, list[str]] = {
    "javascript": _ES_IMPORTS, "typescript": _ES_IMPORTS, "tsx": _ES_IMPORTS,
    "java": [r"^[ \t]*import\s+(?:static\s+)?(?P<module>[\w.]+(?:\.\*)?)"],
    "go": [r"^[ \t]*import\s+(?:[\w.]+\s+)?\"(?P<module>[^\"]+)\"", r"^[ \t]+(?:[\w.]+\s+)?\"(?P<module>[^\"\s]+)\"[ \t]*$"],
    "rust": [r"^[ \t]*(?:pub\s+)?use\s+(?P<module>[\w:]+)(?:::\{(?P<names>[^}]*)\})?"],
    "c": [r"^[ \t]*#\s*include\s*[<\"](?P<module>[^>\"]+)[>\"]"], "cpp": [r"^[ \t]*#\s*include\s*[<\"](?P<module>[^>\"]+)[>\"]"],
    "csharp": [r"^[ \t]*using\s+(?:static\s+)?(?P<module>[\w.]+)\s*;"],
    "ruby": [r"^[ \t]*require(?:_relative)?\s+['\"](?P<module>[^'\"]+)['\"]"],
    "php": [r"^[ \t]*use\s+(?P<module>[\w\\]+)", r"\b(?:require|include)(?:_once)?\s*\(?\s*['\"](?P<module>[^'\"]+)['\"]"],
    "kotlin": [r"^[ \t]*import\s+(?P<module>[\w.]+)"], "swift": [r"^[ \t]*import\s+(?P<module>[\w.]+)"], "scala": [r"^[ \t]*import\s+(?P<module>[\w.]+)"],
    "lua": [r"\brequire\s*\(?\s*['\"](?P<module>[^'\"]+)['\"]"], "bash": [r"^[ \t]*(?:source|\.)\s+(?P<module>[^\s;]+)"], "dart": [r"^[ \t]*import\s+['\"](?P<module>[^'\"]+)['\"]"],
}
#: Words that introduce bases, and languages that name them behind a colon.
_BASE_WORDS = re.compile(r"\b(?:extends|implements|with|mixin)\b")
_COLON_BASES = frozenset(["cpp", "csharp", "kotlin", "swift"])
_NESTED = re.compile(r"\([^()]*\)|\[[^\[\]]*\]")
_GENERIC = re.compile(r"<[^<>]*>")
_BASE = re.compile(r"(?:(?:public|private|protected|virtual)\s+)*(?P<base>[A-Za-z_$][\w$]*)\s*")


def bases(head: str, language: str) -> list[str]:
    """The plain names of the bases in a declaration's head, the text between its name and its body."""
    while (shorter := _NESTED.sub("", head)) != head:
        head = shorter
    if language == "ruby":
        m = re.match(r"\s*<\s*([A-Z]\w*)\s*(?:$|[\n;])", head)
        return [m[1]] if m else []
    if language != "java":  # there, a base with type arguments is no plain name
        while (shorter := _GENERIC.sub("", head)) != head:
            head = shorter
    if language in _COLON_BASES:
        clauses = re.split(r"\bwhere\b", head)[0].partition(":")[2:]
    else:
        clauses = _BASE_WORDS.split(head)[1:]
    out = [m["base"] for clause in clauses for item in clause.split(",") if (m := _BASE.fullmatch(item.strip() + " "))]
    return list(dict.fromkeys(out))


_CALL = re.compile(r"(?P<chain>[\w$]+(?:(?:\.|->|::|\?\.)[\w$]+)*)\s*\(")
_NOT_CALLS = frozenset("import package if for while switch catch return function func fn def class new sizeof typeof elif when match super await yield throw".split())
KINDS = {"class": "CLASS", "interface": "INTERFACE", "enum": "ENUM", "function": "FUNCTION", "method": "METHOD", "constructor": "CONSTRUCTOR", "type": "TYPE_ALIAS", "module": "MODULE", "field": "FIELD", "package": "MODULE"}


class RulesBackend:
    """Facts of the languages of ``DEFINITIONS``.  Unbalanced brackets make a file PARTIAL, or FAILED if no
    declaration or import is found."""

    def facts(self, source: bytes, language: str, path: str) -> Facts:
        f = Facts()
        text = source.decode("utf-8", "replace").removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
        f.symbols.append(module_symbol(path, text, None))
        if not text.strip():
            f.parse_status = "EMPTY"
            f.say("INFO", "parse.empty", "the file has no statements")
            return f
        if language not in DEFINITIONS:  # a registered language whose declarations nobody described
            f.say("WARNING", "extract.no_query", f"no extraction rules for {language}")
            return f
        self.ascii = text.isascii()
        literals = re.compile(LITERALS.get(language, _C_LITERALS))
        starts = [0, *(m.end() for m in re.finditer("\n", text))]
        docs = []

        def blanked(m: re.Match) -> str:
            if m[0][0] not in "\"'`":
                docs.append((self.position(starts, text, m.start()), self.position(starts, text, m.end()), m[0]))
            return re.sub(r"[^\n]", " ", m[0])

        blank = literals.sub(blanked, text)
        self.closing = self.braces(blank)
        self.balance(f, blank, language)
        self.declarations(f, text, blank, starts, language, path)
        self.references(f, text, blank, starts, language)
        attach_docs(f.symbols, docs)
        return f

    ascii = False

    def position(self, starts: list[int], text: str, at: int) -> tuple[int, int]:
        line = bisect_right(starts, at)
        first = starts[line - 1]
        return line, at - first if self.ascii else len(text[first:at].encode())

    def extent(self, blank: str, at: int, language: str) -> int:
        """Where the declaration that begins at ``at`` ends."""
        if language in END_BLOCKS:
            indent = _INDENT.match(blank, blank.rfind("\n", 0, at) + 1)[0]
            m = re.compile(rf"^{indent}end\b", re.M).search(blank, at)
            return m.end() if m else len(blank)
        m = _HEAD_END.search(blank, at)
        if m is None:
            return len(blank)
        if m[0] == "{":
            return self.closing.get(m.start(), len(blank) - 1) + 1
        return m.end() if m[0] == ";" else m.start()

    def braces(self, blank: str) -> dict[int, int]:
        """The offset of each opening brace's partner."""
        closing, stack = {}, []
        for m in _BRACE.finditer(blank):
            if m[0] == "{":
                stack.append(m.start())
            elif stack:
                closing[stack.pop()] = m.start()
        return closing

    def extent_by_indentation(self, blank: str, at: int, language: str) -> int:
        """The end of the last line before one that is indented no deeper, or of that line if it closes a bracket."""
        begin = blank.rfind("\n", 0, at) + 1
        indent = len(_INDENT.match(blank, begin)[0])
        line_end = blank.find("\n", at)
        end = len(blank) if line_end < 0 else line_end
        while 0 <= line_end < len(blank):
            first = line_end + 1
            line_end = blank.find("\n", first)
            line_end = len(blank) if line_end < 0 else line_end
            line = blank[first:line_end]
            bare = line.strip()
            if not bare:
                if line_end == len(blank):
                    break
                continue
            if len(line) - len(line.lstrip(" \t")) <= indent:
                return line_end if bare[0] in "})]" or bare.startswith("end") else end
            end = line_end
        return end

    def declarations(self, f: Facts, text: str, blank: str, starts: list[int], language: str, path: str) -> None:
        found = {}
        extent = self.extent if f.parse_status == "OK" else self.extent_by_indentation  # where brackets don't match, they don't tell
        statements = STATEMENTS.get(language, [])
        for kind, pattern in [*DEFINITIONS[language], *statements, *([("field", FIELDS[language])] if language in FIELDS else [])]:
            for m in re.compile(pattern, re.M).finditer(blank):
                at = m.start() + len(m[0]) - len(m[0].lstrip())
                if language == "kotlin" and kind == "constructor" and m["name"][0] == "(":
                    at = m.start("name")  # within the class that it constructs
                    for x in _CLASS_PARAMETER.finditer(blank, at, m.end("name")):
                        found[x.start("name"), x["name"]] = (x.start("name"), x.end("name"), "field", x["name"], x.end("name"))
                if (m.start("name"), m["name"]) not in found:
                    end = m.end() if kind == "field" or (kind, pattern) in statements or m["name"][:1] == "(" else extent(blank, m.end() - 1 if m[0].endswith("{") else m.end(), language)
                    found[m.start("name"), m["name"]] = (at, end, kind, m["name"], m.end("name"))
        module = module_path(path)
        stack: list[tuple[int, str, str]] = []
        for at, end, kind, name, name_end in sorted(found.values(), key=lambda x: (x[0], -x[1])):
            while stack and stack[-1][0] < end:
                stack.pop()
            parent = stack[-1] if stack else None
            if kind == "impl":  # no declaration of its own: its functions are methods of the module
                base = re.match(r"[ \t]*impl(?:<[^{]*?>)?\s+([A-Za-z_]\w*)(?:<[^{]*?>)?\s+for\b", blank[at:end])
                if base:
                    line, col = self.position(starts, text, at)
                    f.inherits.append({"base": base[1], "enclosing": None, "span": span(line, col, line, col)})
                stack.append((end, module, "IMPL"))
                continue
            within_impl = parent is not None and parent[2] == "IMPL"
            if within_impl:
                parent = None
            inside = parent is not None and parent[2] in METHOD_CONTAINERS
            if kind == "field" and not inside and language != "bash" and not (parent is None and language in ("kotlin", "swift")):
                continue
            if kind == "member":
                if parent is None and language not in ("c", "cpp", "dart", "csharp"):
                    continue
                if parent and not inside and parent[2] != "MODULE":
                    continue
                symbol = ("CONSTRUCTOR" if name in (parent[1].rsplit(".", 1)[-1].rsplit(":", 1)[-1], "constructor") else "METHOD") if inside else "FUNCTION"
            else:
                symbol = KINDS[kind]
                if symbol == "FUNCTION" and (inside or within_impl):
                    symbol = "METHOD"
            qualified = f"{parent[1]}.{name}" if parent else f"{module}:{name}"
            line, col = self.position(starts, text, at)
            end_line, end_col = self.position(starts, text, end)
            line_end = text.find("\n", at)
            head = text[at : line_end if line_end >= 0 else len(text)].strip()[:200]
            f.symbols.append({"ordinal": len(f.symbols), "name": name, "qualified_name": qualified, "symbol_type": symbol, "signature": head, "documentation": None, "parent": parent[1] if parent else module, "span": span(line, col, end_line, end_col)})
            if symbol in METHOD_CONTAINERS:
                brace = blank.find("{", name_end, end)
                head_end = blank.find("\n", name_end) if language == "ruby" else brace if brace >= 0 else min(end, blank.find("\n", name_end) % (len(blank) + 1))
                for base in bases(blank[name_end:head_end], language):
                    f.inherits.append({"base": base, "enclosing": qualified, "span": span(line, col, line, col)})
            if kind not in ("field", "package") and name[:1] != "(":
                stack.append((end, qualified, symbol))
        f.inherits = first_wins(f.inherits, "base")

    def references(self, f: Facts, text: str, blank: str, starts: list[int], language: str) -> None:
        owners: list[str | None] = [None] * (len(starts) + 2)
        for s in sorted(f.symbols[1:], key=lambda s: (s["span"]["start_line"], -s["span"]["end_line"])):  # inner ones later
            lo, hi = s["span"]["start_line"], min(s["span"]["end_line"], len(starts))
            owners[lo : hi + 1] = [s["qualified_name"]] * (hi + 1 - lo)
        owner = owners.__getitem__

        blocks = [m.span() for m in re.finditer(r"^import\s*\([^)]*\)", blank, re.M)] if language == "go" else []
        for pattern in IMPORTS.get(language, []):
            for m in re.compile(pattern, re.M).finditer(text):
                at = m.start() + len(m[0]) - len(m[0].lstrip())
                if blank[at] == " " and not (text[at] in "\"'" and any(lo < at < hi for lo, hi in blocks)):
                    continue  # inside a comment or string, or a string of its own outside of an import block
                if blocks and not m[0].lstrip().startswith("import") and not any(lo < at < hi for lo, hi in blocks):
                    continue
                line, col = self.position(starts, text, at)
                names = re.findall(r"[\w$*]+(?:\s+as\s+[\w$]+)?", m.groupdict().get("names") or "")
                alias = next((n.split()[-1] for n in names if " as " in n), None)
                f.imports.append({"ordinal": len(f.imports), "module": m["module"], "names": list(dict.fromkeys(n.split()[0] for n in names)), "alias": alias, "enclosing": owner(line), "span": span(line, col, line, col + len(m[0].strip()))})
        declared = {(s["span"]["start_line"], s["name"]) for s in f.symbols[1:]}
        for m in _CALL.finditer(blank):
            parts = re.split(r"\.|->|::|\?\.", m["chain"])
            line, col = self.position(starts, text, m.start())
            if parts[-1] in _NOT_CALLS or (line, parts[-1]) in declared:
                continue
            f.calls.append({"callee": parts[-1], "receiver": ".".join(parts[:-1]) or None, "enclosing": owner(line), "span": span(line, col, line, col + len(m[0]))})
        f.calls = first_wins(f.calls, "callee")
        f.node_count = len(f.symbols) + len(f.calls) + len(f.imports)  # declarations and references stand for nodes

    def balance(self, f: Facts, blank: str, language: str) -> None:
        """Brackets (and ``end`` blocks) give the faults, and the statements at the top level those that are clean: a
        statement ends with its closing bracket, a semicolon, or a line, and is clean if no fault lies in it."""
        depth: list[tuple[str, int]] = []
        line, clean, faulty, begun = 1, 0, False, False
        for m in _BLOCKS.get(language, _BRACKETS).finditer(blank):
            c = m[0]
            if c == "\n" or c == ";":
                line += c == "\n"
                if not depth and begun:
                    clean += not faulty
                    faulty = begun = False
                continue
            begun = True
            if m.lastgroup == "opens" or c in "([{":
                depth.append(("do" if m.lastgroup == "opens" else c, line))
                f.max_depth = max(f.max_depth, len(depth))
            elif c in _CLOSES:
                if depth and depth[-1][0] == _CLOSES[c]:
                    depth.pop()
                else:
                    f.say("ERROR", "parse.error_node", f"unexpected {c!r}", line, "statement")
                    faulty = True
                    del depth[-1:]
                if not depth and c in ("}", "end"):
                    clean += not faulty
                    faulty = begun = False
        if not depth and begun:
            clean += not faulty
        for c, at in depth:
            f.say("ERROR", "parse.missing_token", f"{c!r} is never closed", at, "block")
        if any(d["severity"] == "ERROR" for d in f.diagnostics):
            f.parse_status, f.parse_error = ("PARTIAL" if clean else "FAILED"), f.diagnostics[0]["message"]
            if not clean:
                f.say("ERROR", "parse.no_clean_statements", "no top-level statement is clean", None, "file")


#: Where the head of a declaration ends: at its body, its semicolon, or a blank line.
_INDENT = re.compile(r"[ \t]*")
_HEAD_END, _BRACE = re.compile(r"[{;]|\n(?=\n)"), re.compile(r"[{}]")
_CLOSES = {")": "(", "]": "[", "}": "{", "end": "do", "until": "do"}
_BRACKETS = re.compile(r"[()\[\]{};\n]|[^\s()\[\]{};]+")
_OTHER = r"\b(?:end|until)\b|[()\[\]{};\n]|\w+|[^\s()\[\]{};\w]+"
#: Languages whose blocks end with a word.  In Ruby a word behind an expression is a modifier and opens none.
_BLOCKS = {
    "ruby": re.compile(rf"(?P<opens>(?:(?<=\n)|^)[ \t]*(?:(?:while|until|for)\b[^\n]*|(?:class|module|def|if|unless|case|begin)\b)|\bdo\b(?=[ \t]*(?:\|[^|\n]*\|)?[ \t]*(?:\n|$))|(?<=[=(])[ \t]*(?:if|case|begin)\b)|{_OTHER}"),
    "lua": re.compile(rf"(?P<opens>\b(?:function|if|do|repeat)\b)|{_OTHER}"),
}
