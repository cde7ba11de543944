"""Scalar functions over source text, as column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Limits and markers of stored signatures and documentation.
SIGNATURE_CHARS, DOC_CHARS, CHARS_PER_TOKEN = 200, 1200, 4
DOC_MARKERS = ["///", "//!", "//", "/**", "/*", "*", "#", "--", ";;", "%", "\\"]
DECORATOR_MARKERS = ["@", "#", "[", "///", "//", "/*", "*"]
#: Line ends as a reader of Unicode text sees them.
LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def _quoted(markers: list[str]) -> str:
    return "|".join("".join("\\" + c if not c.isalnum() else c for c in m) for m in markers)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text: Column) -> Column:
    """Without white space at both ends (all of Unicode's)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def lines(text: Column | str) -> Column:
    """The lines of a text without their ends; the end of the last line begins no further line."""
    parts = F.split(_col(text), LINE_ENDS)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_count(text: Column | str) -> Column:
    """Line feeds, and one more if the text doesn't end with one."""
    t = _col(text)
    return (F.length(t) - F.length(F.replace(t, F.lit("\n"))) + F.when((t != "") & ~t.endswith("\n"), 1).otherwise(0)).cast("int")


def estimate_tokens(text: Column | str) -> Column:
    """A quarter of the characters, at least 1; 0 for an empty text, null for a null."""
    t = _col(text)
    return F.when(t == "", 0).when(t.isNotNull(), F.greatest(F.lit(1), F.floor(F.length(t) / CHARS_PER_TOKEN))).cast("int")


def hash_text(text: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(_col(text), 256))


def decoded(content: Column | str) -> Column:
    """Bytes as text; invalid bytes become U+FFFD."""
    return F.make_valid_utf8(_col(content).cast("string"))


def slice_lines(text: Column | str, start_line: Column, end_line: Column) -> Column:
    """Lines start_line to end_line (from 1, both included) joined by line feeds; '' if there are none."""
    all_lines = lines(text)
    first = F.greatest(F.lit(1), start_line)
    return F.array_join(F.slice(all_lines, first, F.greatest(F.lit(0), end_line - first + 1)), "\n")


def signature_of(text: Column | str) -> Column:
    """The first line that is neither blank nor an annotation or comment, at most 200 characters; ''."""
    marks = _quoted(DECORATOR_MARKERS)
    kept = F.filter(F.transform(lines(text), strip), lambda x: (x != "") & ~x.rlike(f"^(?:{marks})"))
    return F.coalesce(F.substring(F.try_element_at(kept, F.lit(1)), 1, SIGNATURE_CHARS), F.when(_col(text).isNotNull(), ""))


def clean_doc(raw: Column | str) -> Column:
    """Documentation without comment marks: of each line one leading mark goes, and quotes if the same line
    opens and closes them; at most 1200 characters."""
    marks = _quoted(DOC_MARKERS)

    def unquoted(x: Column) -> Column:
        out, n = x, F.length(x)
        for q in ("'", '"', "'''", '"""'):
            out = F.when(x.startswith(q) & x.endswith(q) & (n > 2), strip(F.substring(x, F.lit(len(q) + 1), F.greatest(F.lit(0), n - 2 * len(q))))).otherwise(out)
        return out

    cleaned = F.transform(lines(raw), lambda x: unquoted(strip(F.regexp_replace(strip(x), f"^(?:{marks})", ""))))
    return F.substring(strip(F.array_join(cleaned, "\n")), 1, DOC_CHARS)


def module_path(path: Column | str) -> Column:
    """A dotted module name from a path; files that stand for their directory take its name."""
    p = _col(path)
    stem = F.regexp_replace(p, r"\.[^./]*$", "")
    parts = F.filter(F.split(stem, "/"), lambda x: x != "")
    last = F.try_element_at(parts, F.lit(-1))
    kept = F.when(last.isin("__init__", "index", "mod"), F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 1))).otherwise(parts)
    return F.when(F.size(kept) > 0, F.array_join(kept, ".")).otherwise(stem)


def module_name(dotted: Column | str) -> Column:
    """The last segment of a dotted module name."""
    return F.element_at(F.split(_col(dotted), r"\."), -1)


def looks_like_identifier(text: Column | str) -> Column:
    """Letters, digits, ``_``, ``.`` and ``$`` of ASCII only, at least one."""
    return _col(text).rlike(r"^[A-Za-z0-9_.$]+$")
