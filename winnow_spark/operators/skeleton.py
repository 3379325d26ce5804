"""Declarations of source code: a line scanner that keeps signatures and drops bodies."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LINES, MAX_COMMENTS, MAX_SYMBOL_LINES, MAX_IMPORTS = 400, 4, 40, 60

# Patterns and words that define what a line is.
DECLARATION = (
    r"\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\w*",
    r"\s*(?:export\s+)?(?:abstract\s+)?class\s+\w+",
    r"\s*(?:export\s+)?(?:interface|type|enum|trait|struct|record)\s+\w+",
    r"\s*(?:export\s+)?(?:const|let|var)\s+\w+",
    r"\s*(?:public|private|protected|internal|static|final|override|pub|fn|func|def|sub)\b",
    r"\s*(?:async\s+)?def\s+\w+",
    r"\s*[A-Za-z_]\w*\s*(?:\(|:\s*[\w<>\[\]{}]|=\s*(?:async\s*)?\()",
)
KEEP_ALWAYS = (
    r"\s*(?:import|export)\b",
    r"\s*(?:#include|use|require|package|namespace|using|module)\b",
    r"\s*(?://|#|<!--|\*|/\*)",
    r"\s*@",
    r"\s*\}",
)
NOISE = (
    r"\s*$",
    r"\s*[)\]}>;,]+\s*$",
    r"\s*(?:console\.log|print|fmt\.Println|System\.out\.println)\b",
)
COMMENT = r"\s*(?://|#|<!--|\*|/\*)"
CONTAINER = r"\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|interface|enum|struct|trait|namespace)\s"
METHOD = r"\s*(?:(?:public|private|protected|internal|static|readonly|abstract|override|final|async|get|set)\s+)*([A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\s*\([^)]*\)\s*(?::[^;{]*)?\{\s*$"
PROPERTY = (
    r"\s*(?:(?:public|private|protected|internal|static|readonly)\s+)*[A-Za-z_$][\w$]*\s*(?:\?|[:=])[^;{]*;?\s*$",
    r"\s*[A-Za-z_$][\w$]*\s*[:(][^;{]*[;{]\s*$",
)
NAMED = r"\b(?:function|class|interface|type|enum|def|struct|trait|const|let|var)\s+([A-Za-z_$][\w$]*)"
CONTROL = frozenset("if for while switch catch return else do try finally function case with new typeof await yield".split())
IMPORT = r"^\s*(?:import|from|use|require|include)\b"

_any = lambda patterns: re.compile("|".join(f"(?:{p})" for p in patterns), re.ASCII)
_declaration, _always, _noise, _property = map(_any, (DECLARATION, KEEP_ALWAYS, NOISE, PROPERTY))
_comment, _container, _method, _named = (re.compile(p, re.ASCII) for p in (COMMENT, CONTAINER, METHOD, NAMED))
_literal = re.compile(r"""//.*|/\*.*?\*/|/\*.*|(["'`])(?:\\.|(?!\1)[^\\])*(?:\1|\\?$)""")


def strip_literals(line: str) -> str:
    """Without comments; quoted strings become empty ones. What is left open goes to the line's end."""
    return _literal.sub(lambda m: '""' if m[1] else "", line)


def brace_delta(line: str) -> int:
    bare = strip_literals(line)
    return bare.count("{") - bare.count("}")


def method_name(line: str) -> str | None:
    found = _method.match(line)
    return found[1] if found and found[1] not in CONTROL else None


def symbol_name(line: str) -> str | None:
    found = _named.search(line) or _method.match(line)
    return found and found[1]


def is_member(line: str) -> bool:
    return not _noise.match(line) and bool(method_name(line) or _container.match(line) or _property.match(line))


def indent_width(line: str) -> int:
    return sum(2 if c == "\t" else 1 for c in line[: len(line) - len(line.lstrip(" \t"))])


@dataclass
class _Skeleton:
    """Lines and symbols kept so far; ``truncated`` once something did not fit."""

    most: int
    lines: list[str] = field(default_factory=list)
    symbols: list[tuple[str | None, int]] = field(default_factory=list)
    truncated: bool = False

    def add(self, line: str) -> bool:
        if len(self.lines) >= self.most:
            self.truncated = True
            return False
        self.lines.append(line)
        return True

    def block(self, source: list[str], at: int, opened: int) -> int:
        """Members of the block opened at line ``at``, then its closers; the line after it."""
        container, depth, owed, end = bool(_container.match(source[at])), opened, opened, at + 1
        while end < len(source) and depth > 0:
            line, change = source[end], brace_delta(source[end])
            if _comment.match(line):
                fits = container and depth == 1 and len(self.lines) < self.most
                if fits:
                    self.lines.append(line)
                    owed += max(change, 0)
                elif container:
                    self.truncated = True
            elif container and depth == 1 and is_member(line) and self.add(line):
                self.symbols.append((symbol_name(line) or "", end + 1))
                owed += max(change, 0)
            depth += change
            end += 1
        for level in range(owed - 1, -1, -1):
            if not self.add(" " * (indent_width(source[at]) + 2 * level) + "}"):
                break
        return end


def skeletonize_text(text: str | None, max_lines: int = MAX_LINES) -> tuple[str, list[tuple[str | None, int]], int, int, bool]:
    """(text, symbols (name, line), lines kept, lines in all, truncated)."""
    source = (text or "").split("\n") if text is not None else []
    out, comments, depth, at = _Skeleton(max_lines), [], 0, 0
    while at < len(source):
        line = source[at]
        change = brace_delta(line)
        if _comment.match(line):
            comments.append(line)
            depth += change
        elif _noise.match(line):
            comments = []
            depth += change
        elif (_always.match(line) or _declaration.match(line)) if depth == 0 else method_name(line):
            held = comments if len(comments) <= MAX_COMMENTS else []
            comments = []
            if not all(out.add(kept) for kept in [*held, line]):
                break
            name = symbol_name(line)
            if name:
                out.symbols.append((name, at + 1))
            if change > 0:
                at = out.block(source, at, change)
                continue
            depth = max(0, depth + change)
        else:
            comments = []
            depth = max(0, depth + change)
        at += 1
    return "\n".join(out.lines), out.symbols, len(out.lines), len(source), out.truncated


def skeletonize(text: Column, max_lines: int = MAX_LINES) -> Column:
    """STRUCT text, symbols, lines_kept, lines_total, truncated."""

    @F.pandas_udf("text string, symbols array<struct<name:string,line:int>>, lines_kept int, lines_total int, truncated boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [skeletonize_text(t, max_lines) for t in texts]
            rows = [(t, [{"name": n, "line": k} for n, k in s], *rest) for t, s, *rest in rows]
            yield pd.DataFrame(rows, columns=["text", "symbols", "lines_kept", "lines_total", "truncated"], dtype=object)

    return run(text)


def symbol_source(text: str | None, name: str) -> str | None:
    """The first declaration of ``name`` with its block, 40 lines at most."""
    lines = (text or "").split("\n")
    start = re.compile(rf"\b(?:function|class|interface|type|enum|def|struct|trait|const|let|var)\s+{re.escape(name)}\b", re.ASCII)
    at = next((i for i, line in enumerate(lines) if name and start.search(line)), None)
    if at is None:
        return None
    opened = closed = 0
    for end in range(at, min(len(lines), at + MAX_SYMBOL_LINES)):
        opened += lines[end].count("{") + lines[end].count("(")
        closed += lines[end].count("}") + lines[end].count(")")
        if end > at and 0 < opened <= closed:
            break
    return "\n".join(lines[at : end + 1])


def extract_symbol(text: Column, name: str) -> Column:
    return F.pandas_udf(lambda texts: pd.Series([symbol_source(t, name) for t in texts], dtype=object), "string")(text)


def summarize_imports(text: Column) -> Column:
    """Import lines, trimmed, the first 60."""
    trimmed = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(IMPORT)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.slice(trimmed, 1, MAX_IMPORTS)
