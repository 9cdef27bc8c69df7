"""Definitions in one source file: small scanners used inside tasks.

What counts as a definition:

* Python: every `def` and `class`, nested ones included.
* Go: functions, methods, and type specs as struct, interface or type.
* Java: classes, records, interfaces, enums, their methods and constructors.
* TypeScript and TSX: classes, interfaces, enums, type aliases, functions,
  functions bound to a name, methods and method signatures, constructors.

Text is handled as Latin-1, so one character is one byte and every offset is a
byte offset.
"""

from __future__ import annotations

import ast
import re
import warnings
from typing import NamedTuple

ID = r"[A-Za-z_$\x80-\xff][\w$\x80-\xff]*"
CONTAINERS = ("class", "interface", "struct", "enum")


class Definition(NamedTuple):
    """A named range of the file."""

    name: str
    kind: str
    name_at: int
    start: int
    end: int


def definitions(source: bytes, lang: str) -> list[Definition]:
    """Definitions of a file in source order."""
    text = source.decode("latin-1")
    if lang == "python":
        found = _python(source, text)
    else:
        code = _blank(text, lang)
        found = _go(code) if lang == "go" else _braced(code, lang)
    return sorted(found, key=lambda d: (d.start, -d.end))


def enclosing(starts: list[int], ends: list[int], kinds: list[str]) -> list[int]:
    """Index of the smallest container around each range, -1 for none.

    A container is never its own parent; among equal ranges the first wins.
    Ranges of a parsed file nest, so one sweep with a stack finds them; ranges
    that cross are compared one by one.
    """
    at: dict[tuple[int, int], list[int]] = {}
    for i, kind in enumerate(kinds):
        if kind in CONTAINERS:
            at.setdefault((starts[i], ends[i]), []).append(i)
    order = sorted(set(zip(starts, ends)), key=lambda r: (r[0], -r[1]))
    outer: dict[tuple[int, int], tuple[int, int] | None] = {}
    stack: list[tuple[int, int]] = []
    for rng in order:
        while stack and stack[-1][1] <= rng[0] and stack[-1][1] < rng[1]:
            stack.pop()
        if stack and stack[-1][1] < rng[1]:
            return _enclosing_crossed(starts, ends, at)
        outer[rng] = stack[-1] if stack else None
        if rng in at:
            stack.append(rng)
    parents = []
    for i, rng in enumerate(zip(starts, ends)):
        same = [j for j in at.get(rng, ())[:2] if j != i]
        around = outer[rng]
        parents.append(same[0] if same else at[around][0] if around else -1)
    return parents


def _enclosing_crossed(starts: list[int], ends: list[int], at: dict) -> list[int]:
    by_span = sorted(((e - s, ix[0], s, e) for (s, e), ix in at.items()))
    parents = []
    for i, (s, e) in enumerate(zip(starts, ends)):
        best = -1
        for _, _, cs, ce in by_span:
            inside = [j for j in at[cs, ce][:2] if j != i] if cs <= s and ce >= e else []
            if inside:
                best = inside[0]
                break
        parents.append(best)
    return parents


def _python(source: bytes, text: str) -> list[Definition]:
    starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def offset(line: int, column: int) -> int:
        return min(starts[min(line, len(starts)) - 1] + column, len(text))

    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _python_by_indent(text)
    found = []
    todo = [tree]
    while todo:
        node = todo.pop()
        todo.extend(ast.iter_child_nodes(node))
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            start = offset(node.lineno, node.col_offset)
            found.append(Definition(node.name, kind, start, start, offset(node.end_lineno, node.end_col_offset)))
    return found


def _python_by_indent(text: str) -> list[Definition]:
    """For files Python cannot parse: a body ends where the indent returns."""
    heads = re.compile(rf"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+({ID})", re.M)
    lines = [(m.start(), m.end(), len(m[1])) for m in re.finditer(r"^([ \t]*)[^\s#].*$", text, re.M)]
    found = []
    for m in heads.finditer(text):
        indent, end = len(m[1]), m.end()
        later = (l for l in lines if l[0] > m.start())
        for start, stop, width in later:
            if width <= indent:
                break
            end = stop
        name = m[3].encode("latin-1").decode("utf-8", "replace")
        found.append(Definition(name, "class" if m[2] == "class" else "function", m.start(3), m.start() + indent, end))
    return found


_STRINGS = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
_COMMENTS = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
_HIDDEN = {
    "go": re.compile(rf"{_COMMENTS}|`[^`]*`|{_STRINGS}"),
    "java": re.compile(rf'{_COMMENTS}|"""[\s\S]*?"""|{_STRINGS}'),
    "typescript": re.compile(
        rf"{_COMMENTS}|`(?:\\[\s\S]|[^`\\])*`|{_STRINGS}|(?<=[(,=:\[!&|?;])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/"
    ),
}


def _blank(text: str, lang: str) -> str:
    """The text with comments and literals turned into spaces."""
    hidden = _HIDDEN["typescript" if lang == "tsx" else lang]
    return hidden.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _pairs(code: str, marks: str) -> dict[int, int]:
    """Position of the closing mark for every opening one."""
    pairs, stack = {}, []
    for m in re.finditer(f"[{re.escape(marks)}]", code):
        if m[0] == marks[0]:
            stack.append(m.start())
        elif stack:
            pairs[stack.pop()] = m.start()
    pairs.update((left, len(code)) for left in stack)
    return pairs


def _line_end(code: str, at: int) -> int:
    end = code.find("\n", at)
    return len(code) if end < 0 else end


def _name(raw: str) -> str:
    return raw.encode("latin-1").decode("utf-8", "replace")


def _go(code: str) -> list[Definition]:
    braces, parens = _pairs(code, "{}"), _pairs(code, "()")
    found = []

    def body_end(at: int) -> int:
        """End of a declaration that starts at `at`: its body, or its line."""
        for m in iter(lambda: re.compile(r"[({\n]").search(code, at), None):
            at = m.end()
            if m[0] == "(":
                at = parens[m.start()]
            elif m[0] == "{":
                if not re.search(r"\b(?:interface|struct)\s*\Z", code[max(0, m.start() - 12) : m.start()]):
                    return braces[m.start()] + 1
                at = braces[m.start()]
            else:
                return m.start()
        return len(code)

    for m in re.finditer(rf"^func\s*(\([^)]*\))?\s*({ID})\s*[\[(]", code, re.M):
        found.append(Definition(_name(m[2]), "method" if m[1] else "function", m.start(2), m.start(), body_end(m.end() - 1)))

    spec = re.compile(rf"({ID})\s*(?:\[[^\]\n]*[^\]\d\n][^\]\n]*\])?\s*(=?)\s*(struct|interface)?\b")

    def type_spec(at: int) -> int:
        m = spec.match(code, at)
        if not m:
            return at
        kind = m[3] if m[3] else "type"
        brace = code.find("{", m.end()) if m[3] else code.find("{", m.end(), _line_end(code, at))
        end = braces[brace] + 1 if brace >= 0 else _line_end(code, at)
        found.append(Definition(_name(m[1]), kind, at, at, end))
        return end

    for m in re.finditer(rf"^[ \t]*type[ \t]+(?={ID})", code, re.M):
        type_spec(m.end())
    for m in re.finditer(r"^[ \t]*type\s*\(", code, re.M):
        at, close = m.end(), parens[m.end() - 1]
        while nxt := re.compile(rf"^\s*(?={ID})", re.M).search(code, at, close):
            end = type_spec(nxt.end())
            at = max(end, nxt.end() + 1)
    return found


_TYPE_HEAD = {
    "java": re.compile(rf"\b(class|interface|enum|record)\s+({ID})(?=\s*[<({{]|\s+(?:extends|implements|permits)\b)"),
    "ts": re.compile(rf"(?<![.\w$])(class|interface|enum)\s+({ID})(?=\s*[<{{]|\s+(?:extends|implements)\b)"),
}
_CALL = re.compile(rf"({ID})\s*(?:<[^<>()]*>\s*)?\(")
_NOT_NAMES = {
    "if", "for", "while", "switch", "catch", "function", "return", "new", "throw", "else", "do", "try", "synchronized",
    "assert", "super", "this", "await", "typeof", "yield", "case", "in", "of", "delete", "void", "with", "import",
}
_JAVA_PREFIX = re.compile(r"\A[\w\s.<>,\[\]?&$\x80-\xff]*\Z")
_TS_PREFIX = re.compile(
    r"\A(?:\s*(?:public|private|protected|static|abstract|async|override|readonly|declare|get|set)\b|\s*\*|\s*#)*\s*\Z"
)
_TS_TYPE = re.compile(rf"(?<![.\w$])type\s+({ID})\s*(?:<[^=;{{}}]*>)?\s*=")
_TS_FUNCTION = re.compile(rf"\bfunction\b\s*\*?\s*({ID})\s*[<(]")
_TS_BOUND = re.compile(
    rf"\b(?:const|let|var)\s+({ID})\s*(?::[^=\n]+)?=\s*(?:async\s*)?"
    rf"(?:function\b|(?:<[^>\n]*>\s*)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=\n{{]+)?=>|{ID}\s*=>)"
)


def _braced(code: str, lang: str) -> list[Definition]:
    """Java and TypeScript: types first, then members directly in their bodies."""
    java = lang == "java"
    braces, parens = _pairs(code, "{}"), _pairs(code, "()")
    found, bodies = [], {}
    for m in _TYPE_HEAD["java" if java else "ts"].finditer(code):
        at = m.end()
        while (nxt := re.compile(r"[({;]").search(code, at)) and nxt[0] == "(":
            at = parens[nxt.start()]
        if not nxt or nxt[0] == ";":
            continue
        kind = "class" if m[1] == "record" else m[1]
        end = braces[nxt.start()] + 1
        found.append(Definition(_name(m[2]), kind, m.start(2), _statement_start(code, m.start()), end))
        bodies[nxt.start()] = m[2]
    if not java:
        found += _ts_functions(code, braces, parens)

    marks = sorted([*braces, *braces.values()])
    stack: list[int] = []
    upcoming = iter(marks)
    nxt_mark = next(upcoming, None)
    for m in _CALL.finditer(code):
        while nxt_mark is not None and nxt_mark < m.start():
            if nxt_mark in braces:
                stack.append(nxt_mark)
            elif stack:
                stack.pop()
            nxt_mark = next(upcoming, None)
        owner = bodies.get(stack[-1]) if stack else None
        if owner is None or m[1] in _NOT_NAMES:
            continue
        member = _member(code, m, owner, java, braces, parens)
        if member:
            found.append(member)
    return found


def _statement_start(code: str, at: int) -> int:
    """First non-blank position after the previous `;`, `{` or `}`."""
    left = max(code.rfind(c, 0, at) for c in ";{}") + 1
    return left + re.compile(r"\s*").match(code, left, at).end() - left


def _member(code: str, m: re.Match, owner: str, java: bool, braces: dict, parens: dict) -> Definition | None:
    start = _statement_start(code, m.start())
    prefix = code[start : m.start()]
    if java:
        prefix = re.sub(rf"@{ID}(?:\.{ID})*(?:\s*\([^()]*(?:\([^()]*\)[^()]*)*\))?", " ", prefix)
        prefix = prefix if _JAVA_PREFIX.match(prefix) else None
        words = re.sub(r"\b(?:public|private|protected|static|final|abstract|native|strictfp|synchronized|default)\b|<[^()]*?>(?=\s)", " ", prefix or "").split()
        if prefix is None or (not words and m[1] != owner) or {"new", "return", "record"} & set(words):
            return None
        if prefix.rstrip().endswith(","):     # an enum constant
            return None
    else:
        # Without semicolons a member starts on its own line.
        prefix = prefix[prefix.rfind("\n") + 1 :]
        prefix = re.sub(r"@[\w$.]+(?:\([^()]*\))?", " ", prefix)
        if not _TS_PREFIX.match(prefix):
            return None
        start = max(start, m.start() - len(prefix.lstrip()))
    close = parens[m.end() - 1]
    tail = re.compile(r"\s*(?:throws\b[^{;]*|default\b[^;]*)?" if java else r"\s*(?::[^;{}=\n]*(?:\{[^{}\n]*\}[^;{}=\n]*)?)?").match(code, close + 1)
    at = tail.end()
    mark = code[at : at + 1]
    if mark == "{":
        end = braces[at] + 1
    elif mark == ";" or (not java and mark in ("\n", "}", "")):
        end = at + (mark == ";")
    else:
        return None
    kind = "constructor" if (java and not words) or (not java and m[1] == "constructor") else "method"
    return Definition(_name(m[1]), kind, m.start(1), start, end)


def _ts_functions(code: str, braces: dict, parens: dict) -> list[Definition]:
    found = [
        Definition(_name(m[1]), "type", m.start(1), m.start(), _type_end(code, m.end(), braces)) for m in _TS_TYPE.finditer(code)
    ]
    for pattern in (_TS_FUNCTION, _TS_BOUND):
        for m in pattern.finditer(code):
            at = m.end()
            if pattern is _TS_FUNCTION or not m[0].endswith(">"):
                opening = code.find("(", m.end() - 1)
                at = parens.get(opening, len(code)) if opening >= 0 else at
            head = re.compile(r"[^{;\n]*").match(code, at)
            brace = head.end()
            end = braces[brace] + 1 if code[brace : brace + 1] == "{" else _line_end(code, at)
            found.append(Definition(_name(m[1]), "function", m.start(1), m.start(), end))
    return found


def _type_end(code: str, at: int, braces: dict) -> int:
    m = re.compile(r"[;{\n]").search(code, at)
    if not m:
        return len(code)
    return braces[m.start()] + 1 if m[0] == "{" else m.start()
