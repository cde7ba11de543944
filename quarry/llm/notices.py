"""The notice of a file about itself: that a tool emitted it, or that it was copied from another project.

A notice stands in a comment, never in a string.  It is read by a small grammar rather than by a list of
phrases: at the head of a line an *act* (of producing or of copying), perhaps behind a subject such as
"this file was" and adverbs, and then *evidence* from the same comment: the source it came from, the tool,
a version, or a warning not to edit.  An act that always means a tool ("generated") needs one piece of
evidence, an act that people do as well ("built", "copied") needs two.  A warning at the head of a line
needs the act, or how to produce the file anew.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from quarry.llm.syntax import lexer

# The words of the grammar, per part of speech; all in lower case.
SUBJECT = (
    r"(?:(?:attention|warning|note|notice|caution|important|hinweis|achtung|atención|atenção|uwaga|внимание)\W+)?"
    r"(?:(?:this|the following|these|all|entire|the contents? of this) )?(?:(?:source |whole |entire )?(?:file|files|code|module|class|classes|script|package|header|program|unit|bindings|types|client|stubs) )?"
    r"(?:(?:diese |die )?(?:datei|quelldatei) |(?:ce |le )?(?:fichier|code) |(?:este |el )?(?:archivo|fichero|código) |(?:este )?(?:arquivo|ficheiro|código) |(?:ten |niniejszy )?plik |(?:этот |данный )?(?:файл|код) )?"
    r"(?:(?:is|was|are|were|has been|have been|gets|is being|wurde|wird|ist|a été|est|fue|ha sido|es|está|foi|é|został|zostały|jest|был|была) )?"
)
ADVERB = (
    r"(?:(?:automatically|auto|mechanically|programmatically|machine|verbatim|unmodified|unchanged|untouched|as[- ]is|directly|originally|wholesale|straight|entirely|exactly|currently|completely|"
    r"automatisch|maschinell|unverändert|ursprünglich|automatiquement|tel quel|automáticamente|automaticamente|sin cambios|sem alterações|automatycznie|bez zmian|автоматически|без изменений)[ -])*"
)
GENERATED = (
    r"(?:auto-?|machine-?)?generated|auto-?gen(?:erate)?d?|generiert|généré[es]*|generad[oa]s?|gerad[oa]s?|wygenerowan\w+|сгенерирован\w*"
)
MADE = (
    r"built|produced|created|written|emitted|compiled|rendered|derived|exported|output|synthesi[sz]ed|transpiled|translated|assembled|constructed|dumped|printed|expanded|scaffolded|converted|"
    r"erzeugt|erstellt|gebaut|produit[es]*|créé[es]*|construit[es]*|producid[oa]|cread[oa]|construid[oa]|criad[oa]|produzid[oa]|utworzon\w+|zbudowan\w+|создан\w*|собран\w*|получен\w*"
)
COPIED = (
    r"adapted(?= verbatim)|copied|taken|imported|vendored|borrowed|mirrored|lifted|pulled|extracted|synced|bundled|included|forked|reproduced|duplicated|cloned|embedded|fetched|downloaded|sourced|checked in|"
    r"kopiert|übernommen|copié[es]*|repris[es]*|tiré[es]*|copiad[oa]|tomad[oa]|retirad[oa]|skopiowan\w+|zaczerpnięt\w+|скопирован\w*|взят\w*"
)
COPY = r"(?:(?:a|an|the|our|eine|une|una|uma) )?(?:(?:vendored|local|verbatim|unmodified|unchanged|exact|pristine|bundled|private|frozen|plain|direct|straight|full|partial|in-tree|upstream|third-party) )*(?:copy|snapshot|mirror|fork|clone|drop|import|checkout|replica|kopie|copie|copia|cópia|kopia|копия)"
FROM = r"(?:from|out of|of|aus|von|des?|du|à partir d[eu]|a partir d[eo]|desde|d[oa]|z|ze|из|с)"
BY = r"(?:by|with|using|via|through|mit|durch|par|avec|por|con|com|przez|przy pomocy|за допомогою|с помощью|программой)"

_NAME = r"[\w@][\w.+@/:-]*"
_NOT_TOOLS = r"(?!(?:hand|us|me|him|her|them|you|care|default|design|mistake|the (?:team|user|caller|author|maintainers?)|love|reference|value|name|id|its?|this|that|these|those|all|any|each|every|some|more|less|no)\b)"
#: What a tool reads: a file of an interface language or template, or a thing that describes an interface.
_SOURCE = rf"(?:[^\s]*[\w-]\.(?:proto|idl|thrift|graphqls?|xsd|wsdl|schema|json|ya?ml|toml|xml|csv|g4?|y|yy|l|lex|peg|tmpl|tpl|mustache|jinja2?|j2|in|def|td|fbs|avsc|avdl|capnp|raml|pyx|coffee|less|scss|sql|rl|re|ebnf|bnf|abnf|asn1?|mib|dtd)\b|(?:\S+ ){{0,4}}(?:schemas?|specs?|specifications?|definitions?|grammars?|idl|protos?|descriptors?|wsdl|openapi|schemat\w*|definición|definição|описани\w*|схем\w*)\b)"
_VERSION = r"(?:\bv?\d+(?:\.\d+)+[\w.+-]*|@v?\d[\w.+-]*)"
_LABELLED = r"(?:version|release|rev(?:ision)?|tag|commit|changeset|fassung|wersj\w+|versión|versão|верси\w+)[ :#=]+[\w.+-]*\d[\w.+-]*"
_PROJECT = r"(?:sources?|library|lib|project|package|repository|repo|tree|distribution|upstream|codebase|module|bibliothek|projekt\w*|bibliothèque|projet|paquet|biblioteca|proyecto|projeto|bibliotek\w*|проект\w*|библиотек\w*)"
_WARNING = (
    r"(?:(?:please )?(?:do not|don'?t|never|must not|should not|no|avoid|not) (?:be |to )?(?:manual(?:ly)? |hand[- ]?)?(?:edit|edits|edited|editing|modify|modified|modifying|change|changed|touch|alter|patch)\b|(?:hand|manual|local|any|your|all)[- ](?:edits?|changes|modifications?)\b"
    r"|(?:changes|edits|modifications)(?: \S+){0,5} (?:lost|overwritten|discarded|undone|reverted|clobbered|replaced)|edit (?:the |its )?\S+(?: \S+)? instead|read[- ]only|keep unchanged"
    r"|nicht (?:von hand |manuell )?(?:bearbeiten|ändern|editieren)|ne pas (?:modifier|éditer)|no (?:lo |la )?(?:edit|modifi)\w+|não (?:o |a )?(?:edit|modifi|alter)\w+|nie (?:edyt|modyfik|zmieni)\w+|не (?:редактир|измен|прав)\w+)"
)
_ANEW = r"(?:re-?(?:generat|build|built|creat|compil|run)\w*|source of truth|next (?:run|build|generation|release)|(?:auto-?)?generated|generator)\b"

_HEAD = re.compile(rf"[^\w<@*]*(?:{SUBJECT}{ADVERB})(?P<act>(?P<generated>{GENERATED})|(?P<made>{MADE})|(?P<copy>{COPY}(?= (?:of|from|aus|von|de|des|du|d[oa]|z|из)\b| \S+ (?:of|from)\b))|(?P<copied>{COPIED}))\b", re.I)
_WARNED = re.compile(rf"[^\w<@*]*(?:{SUBJECT})(?:{_WARNING})", re.I)
_FROM_SOURCE = re.compile(rf"\b{FROM} (?:the |den |der |dem |le |la |el |o )?{_SOURCE}", re.I)
_TOOL_KIND = r"(?:compiler|generator|tool|tools|script|plugin|processor|preprocessor|codegen|build|pipeline|bundler|transpiler|translator|makefile|program|utility)"
_BY_TOOL = re.compile(rf"\b{BY} (?:(?:the |an? )?(?:\S+ ){{0,4}}{_TOOL_KIND}\b|{_NOT_TOOLS}[`'\"]?{_NAME}[`'\"]?(?=\W*$|[.,;:)] | ?[-–(;,|/]| \(?v?\d| (?:from|aus|on|at|to|de|z|из|desde|à partir|a partir)\b| (?-i:[A-Z])\w+(?:\W|$)))", re.I)
_COPIED_FROM = re.compile(rf"(?:\b(?:in|over|down|without changes)\b,? ?|{ADVERB})*\b{FROM} (?:the |das |dem |der |la |le |el |o |a )?{_NAME}", re.I)
_EXPLICIT = re.compile(rf"(?:{_VERSION})", re.I)
_NAMED = re.compile(rf"(?:{_LABELLED})", re.I)
_OF_PROJECT = re.compile(rf"\b{_PROJECT}\b", re.I)
_AS_IS = re.compile(r"\b(?:verbatim|unmodified|unchanged|untouched|as[- ]is|keep unchanged|do not (?:patch|fork|edit)|unverändert|tel quel|sin cambios|bez zmian|без изменений)\b", re.I)
_WARNS, _RENEWS = re.compile(_WARNING, re.I), re.compile(_ANEW, re.I)
_ELSE_LOST = re.compile(r"\b(?:will|would|gets?|are) (?:be )?(?:lost|overwritten)\W*$", re.I)
_WHOLE_FILE = re.compile(r"\b(?:this|entire|diese|ce|le|este|el|ten|niniejszy|этот|данный)? ?(?:file|code|datei|fichier|archivo|fichero|arquivo|ficheiro|plik|файл) (?:is|was|has been|wurde|ist|a été|est|fue|es|foi|é|został|jest|был)\b", re.I)
_AUTOMATIC = re.compile(r"\b(?:auto|automatically|machine|mechanically|programmatically|automatisch|maschinell|automatiquement|automáticamente|automaticamente|automatycznie|автоматически)\b", re.I)
_COMPLEMENT = re.compile(rf"\W*(?:\w+\W+)?(?:{FROM}|{BY})\b", re.I)
#: Marks of tools that need no more evidence, and banners of published libraries.
_MARK = re.compile(r"\W*(?:@generated\b|<auto-?generated\b|code generated (?:by|from) .*do not edit|(?:this (?:file|code) is )?auto-?generated (?:file|code)\b|(?:automatically )?generated (?:code|file)\b|generated automatically)", re.I)
_BANNER = re.compile(rf"\W*(?:@license {_NAME} v?\d|{_NAME} v?\d+\.\d+(?:\.\d+)?[\w.-]*\W.*\blicen[cs]ed?\b|(?:this file is )?part of {_NAME} v?\d[\w.]*[;,:] *upstream copy|distributed with the upstream\b|originally (?:part of|from) (?:the )?{_NAME} {_PROJECT}\b|(?:upstream|origin|original source|vendored from)\s*[:=]\s*{_NAME}.*\d)", re.I)
#: A text without any of these parts of words (in lower case) has no notice.
PARTS = [
    "generat", "generier", "generad", "générér", "généré", "gerad", "autogen", "auto-gen", "wygenerowan", "сгенерирован",
    "built", "produced", "created", "written", "emitted", "compiled", "rendered", "derived", "exported", "output", "synthesi", "transpiled", "translated", "assembled", "constructed",
    "dumped", "printed", "expanded", "scaffolded", "converted", "erzeugt", "erstellt", "gebaut", "produit", "créé", "construi", "producid", "cread", "criad", "produzid", "utworzon", "zbudowan", "создан", "собран", "получен",
    "adapted", "copied", "taken", "imported", "vendored", "borrowed", "mirror", "lifted", "pulled", "extracted", "synced", "bundled", "included", "fork", "reproduced", "duplicated", "clone", "embedded", "fetched",
    "downloaded", "sourced", "checked in", "kopi", "übernommen", "copi", "repris", "tiré", "tomad", "retirad", "zaczerpnięt", "скопирован", "взят", "копи", "copy", "snapshot", "drop of", "import of", "checkout", "replica",
    "edit", "modif", "touch", "changes", "alter", "bearbeiten", "ändern", "edyt", "zmieni", "редактир", "измен", "@license", "licen", "upstream", "origin", "distributed",
]
PARTS_PATTERN = re.compile("|".join(map(re.escape, sorted(set(PARTS)))))
_MARKS = re.compile(r"^[\s/*#!;-]*(?:<!--\s*)?")


def comment_blocks(text: str, language: str | None) -> Iterator[list[str]]:
    """The comments of ``text`` as lists of lines without their marks; line comments on consecutive lines are one.

    Of a text without a known language, every line that begins with a comment mark is a comment."""
    block: list[str] = []
    if language is None:
        for line in text.splitlines():
            bare = line.lstrip()
            if bare[:2] in ("//", "/*", "<!") or bare[:1] in ("#", "*", ";"):
                block.append(_MARKS.sub("", line).strip())
            elif block:
                yield block
                block = []
        if block:
            yield block
        return
    end = -1
    for m in lexer.FIRST[lexer.LANGUAGES[language][0]].finditer(text):
        t = m[0]
        if t[0] != "#" and t[:2] not in ("//", "/*"):
            continue
        between = text[end : m.start()] if end >= 0 else "\n\n"
        if block and (between.strip() or between.count("\n") > 1):
            yield block
            block = []
        block += [_MARKS.sub("", line).strip() for line in t.splitlines()]
        end = m.end()
    if block:
        yield block


def comment_lines(text: str, language: str | None) -> Iterator[str]:
    for block in comment_blocks(text, language):
        yield from block


def line_kind(line: str, behind: str) -> str | None:
    """What a comment says that has ``line`` and, joined, the lines ``behind`` it: generated, vendored or None."""
    if _MARK.match(line):
        return "generated"
    if _BANNER.match(line):
        return "vendored"
    m = _HEAD.match(line)
    if not m:
        m = _WARNED.match(line)
        if m and (_RENEWS.search(f"{line} {behind}") or _ELSE_LOST.search(line, m.end())):
            return "generated"
        return None
    rest = f"{line[m.end():]} {behind}".strip()
    if m["generated"] or m["made"]:
        near = line[m.end() :]
        # the act's own complement has to follow at once: "generated from", "built automatically by"
        follows = _COMPLEMENT.match(near)
        source, tool = _FROM_SOURCE.search(near), _BY_TOOL.search(near)
        warned = _WARNS.search(rest)
        automatic = _AUTOMATIC.search(m[0]) or _AUTOMATIC.match(near.strip())
        if m["generated"]:
            whole = _WHOLE_FILE.search(m[0]) and re.match(r"\W*(?:$|automat|[.;!])", near)
            alone = not near.strip() and (not m[0].isascii() or re.search(r"automa\w+ \S+$", m[0], re.I))
            return "generated" if follows and (source or tool) or _AUTOMATIC.match(near.strip()) or warned or whole or alone else None
        if automatic and (follows or re.match(r"\W*(?:$|(?:code|file)\b)", near, re.I)):
            return "generated"
        evidence = bool(source) + bool(tool) + bool(warned) + bool(automatic) + bool(tool and _EXPLICIT.search(near))
        return "generated" if follows and (source or tool) and evidence >= 2 else None
    near = rest
    if not _COPIED_FROM.match(near) and not m["copy"]:
        return None
    sentence = re.split(r"(?<=[a-z)])[.;!] ", near)[0]
    evidence = 2 * bool(_EXPLICIT.search(sentence) or re.search(r"\bvendored\b", m["act"], re.I) or (m["act"].lower() == "adapted")) + bool(_NAMED.search(sentence)) + bool(_OF_PROJECT.search(sentence)) + bool(_AS_IS.search(m[0] + " " + near)) + bool(re.search(r"\bupstream\b|\bthat project\b", near, re.I))
    return "vendored" if evidence >= 2 else None


def notice_kind(text: str, language: str | None) -> str | None:
    """``generated`` or ``vendored`` by the file's own notice in a comment; None otherwise."""
    if not PARTS_PATTERN.search(text.lower()):
        return None
    for block in comment_blocks(text, language):
        for i, line in enumerate(block):
            if PARTS_PATTERN.search(line.lower()):
                kind = line_kind(line, " ".join(block[i + 1 :]))
                if kind:
                    return kind
    return None
