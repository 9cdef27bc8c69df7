"""From RE2 syntax, which users write, to java.util.regex, which Spark runs.

The two dialects agree on most patterns.  The translation settles the rest:

* `^`, `$`, `\\b`, `\\s`, `\\v`, POSIX classes and `(?i)` are written out so
  that they mean what RE2 means by them;
* groups never capture, because no operator reads a group;
* what RE2 refuses (look-around, back-references, possessive or nested
  repeats, counts above 1000) raises ValueError.
"""

from __future__ import annotations

import re

_WORD = "[0-9A-Za-z_]"
_ASSERTIONS = {
    "b": f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))",
    "B": f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))",
    "A": r"\A",
    "z": r"\z",
}
_SPACE = r"\t\n\f\r "
_NOT_SPACE = r"\x00-\x08\x0B\x0E-\x1F\x21-\x{10FFFF}"
_CONTROL = {"a": r"\x07", "f": r"\f", "t": r"\t", "n": r"\n", "r": r"\r", "v": r"\x0B"}
_POSIX = {
    "alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl",
    "digit": "Digit", "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct",
    "upper": "Upper", "xdigit": "XDigit",
}
_REPEAT = re.compile(r"\{(\d+)(,(\d*))?\}")
_MAX_REPEAT = 1000


def quote(text: str) -> str:
    """`text` as a Java pattern that matches exactly it."""
    return re.sub(r"([^0-9A-Za-z_/ ])", r"\\\1", text)


def re2_to_java(pattern: str, *, multiline: bool = True, dotall: bool = False) -> str:
    """Translate `pattern`; `multiline` is RE2's (?m), `dotall` its (?s)."""
    out = ["(?ds)" if dotall else "(?d)"]
    scopes = [multiline]      # value of the m flag, one entry per open group
    ends: list[bool] = [True]  # whether all finished alternatives end in a word character
    folds = re.search(r"\(\?[a-z]*i", pattern) is not None
    # Whether the text so far, and the text before its last item, ends in one.
    word, word_before = False, False
    i, repeatable, repeated = 0, False, False
    while i < len(pattern):
        ch = pattern[i]
        if ch in "*+?" or (ch == "{" and _REPEAT.match(pattern, i)):
            start, i = i, _repeat(pattern, i, out, repeatable, repeated)
            if pattern[start] in "*?{":
                word = word and word_before
            repeated = True
            continue
        repeated, repeatable = False, True
        word_before = word
        if ch == "\\":
            if pattern.startswith("\\b", i) and not folds and (word or _opens_word(pattern, i + 2)):
                # One side is known, so only the other has to be looked at.
                out.append(f"(?!{_WORD})" if word else f"(?<!{_WORD})")
                i += 2
                continue
            word = pattern[i + 1 : i + 2] in ("w", "d")
            i = _escape(pattern, i, out)
            continue
        if ch == "[":
            word = False
            i = _char_class(pattern, i, out)
            continue
        if ch == "(":
            i, flags, opens = _group(pattern, i, out)
            word = False
            if opens:
                scopes.append(scopes[-1])
                ends.append(True)
                repeatable = False
            if flags is not None and "m" in flags:
                scopes[-1] = not flags.startswith("-") and "m" in flags.split("-")[0]
            continue
        word = ch.isascii() and (ch.isalnum() or ch == "_")
        if ch == ")":
            if len(scopes) == 1:
                raise ValueError("unexpected ): " + pattern)
            scopes.pop()
            word, word_before = ends.pop() and word_before, False
            out.append(")")
        elif ch == "^":
            out.append("(?<![^\\n])" if scopes[-1] else r"\A")
        elif ch == "$":
            out.append("(?![^\\n])" if scopes[-1] else r"\z")
        elif ch == "|":
            repeatable = False
            ends[-1] = ends[-1] and word_before
            out.append("|")
        elif ch == ".":
            out.append(".")
        else:
            out.append(quote(ch))
        i += 1
    if len(scopes) != 1:
        raise ValueError("missing closing ): " + pattern)
    return "".join(out)


def _opens_word(pattern: str, i: int) -> bool:
    """Whether whatever matches from `i` on must begin with an ASCII word character."""
    item = re.compile(r"\\[dw]|[0-9A-Za-z_]").match(pattern, i)
    if item:
        return pattern[item.end() : item.end() + 1] not in ("*", "?", "{")
    group = re.compile(r"\((?:\?:|\?P?<\w+>)?(?!\?)").match(pattern, i)
    if not group or not _opens_word(pattern, group.end()):
        return False
    depth, at = 1, group.end()
    for token in re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|[()|]", re.S).finditer(pattern, at):
        depth += {"(": 1, ")": -1}.get(token[0], 0)
        if token[0] == "|" and depth == 1 and not _opens_word(pattern, token.end()):
            return False
        if depth == 0:
            return pattern[token.end() : token.end() + 1] not in ("*", "?", "{")
    return False


def _repeat(pattern: str, i: int, out: list[str], repeatable: bool, repeated: bool) -> int:
    if repeated:
        raise ValueError("invalid nested repetition operator: " + pattern)
    if not repeatable:
        raise ValueError("missing argument to repetition operator: " + pattern)
    counted = _REPEAT.match(pattern, i)
    if counted:
        low, high = int(counted[1]), int(counted[3]) if counted[3] else None
        if low > _MAX_REPEAT or (high is not None and (high > _MAX_REPEAT or high < low)):
            raise ValueError("invalid repeat count: " + pattern)
    token = counted[0] if counted else pattern[i]
    i += len(token)
    if i < len(pattern) and pattern[i] == "?":
        token, i = token + "?", i + 1
    out.append(token)
    return i


def _group(pattern: str, i: int, out: list[str]) -> tuple[int, str | None, bool]:
    """Returns the next index, the flags set, and whether a scope was opened."""
    if not pattern.startswith("(?", i):
        out.append("(?:")
        return i + 1, None, True
    named = re.compile(r"\(\?P?<[A-Za-z_]\w*>").match(pattern, i)
    if named:
        out.append("(?:")
        return named.end(), None, True
    flagged = re.compile(r"\(\?([ims]*(?:-[ims]+)?)([:)])").match(pattern, i)
    if not flagged:
        raise ValueError("invalid or unsupported group syntax: " + pattern)
    # UNICODE_CASE makes (?i) fold beyond ASCII; m is written out by hand.
    java = flagged[1].replace("m", "").replace("i", "iu")
    java = java[:-1] if java.endswith("-") else java
    opens = flagged[2] == ":"
    out.append(f"(?{java}:" if opens else f"(?{java})" if java else "")
    return flagged.end(), flagged[1], opens


def _unescape(pattern: str, i: int) -> tuple[str, int] | None:
    """The escape at `i` when it names one character, as Java writes it."""
    nxt = pattern[i + 1 : i + 2]
    if nxt in _CONTROL and nxt:
        return _CONTROL[nxt], i + 2
    if nxt == "x":
        code = re.compile(r"\\x(?:([0-9A-Fa-f]{2})|\{([0-9A-Fa-f]{1,6})\})").match(pattern, i)
        if not code or int(code[1] or code[2], 16) > 0x10FFFF:
            raise ValueError("invalid escape sequence: " + pattern)
        return r"\x{%X}" % int(code[1] or code[2], 16), code.end()
    octal = re.compile(r"\\(0[0-7]{0,2}|[1-7][0-7]{1,2})").match(pattern, i)
    if octal:
        return r"\x{%X}" % int(octal[1], 8), octal.end()
    if nxt and nxt.isascii() and not nxt.isalnum():
        return "\\" + nxt, i + 2
    return None


def _perl_or_property(pattern: str, i: int, inside: bool) -> tuple[str, int] | None:
    nxt = pattern[i + 1 : i + 2]
    if nxt and nxt in "dDwW":
        return "\\" + nxt, i + 2
    if nxt and nxt in "sS":
        body = _SPACE if nxt == "s" else _NOT_SPACE
        return (body if inside else f"[{body}]"), i + 2
    prop = re.compile(r"\\([pP])(?:\{(\^?)(\w+)\}|([A-Z]))").match(pattern, i)
    if prop:
        negated = (prop[1] == "P") != bool(prop[2])
        name = prop[3] or prop[4]
        name = name if len(name) <= 2 else "Is" + name
        return r"\%s{%s}" % ("P" if negated else "p", name), prop.end()
    return None


def _escape(pattern: str, i: int, out: list[str]) -> int:
    if pattern.startswith("\\Q", i):
        end = pattern.find("\\E", i)
        body = pattern[i + 2 :] if end < 0 else pattern[i + 2 : end]
        out.append(quote(body))
        return len(pattern) if end < 0 else end + 2
    nxt = pattern[i + 1 : i + 2]
    if nxt in _ASSERTIONS and nxt:
        out.append(_ASSERTIONS[nxt])
        return i + 2
    found = _perl_or_property(pattern, i, inside=False) or _unescape(pattern, i)
    if not found:
        raise ValueError("invalid escape sequence: " + pattern)
    out.append(found[0])
    return found[1]


def _char_class(pattern: str, i: int, out: list[str]) -> int:
    out.append("[")
    i += 1
    if pattern.startswith("^", i):
        out.append("^")
        i += 1
    first = True
    while i < len(pattern) and (first or pattern[i] != "]"):
        first = False
        posix = re.compile(r"\[:(\^?)(\w+):\]").match(pattern, i)
        if posix:
            if posix[2] == "word":
                out.append(r"\W" if posix[1] else r"\w")
            elif posix[2] == "space":
                out.append(r"\S" if posix[1] else r"\s")
            elif posix[2] in _POSIX:
                out.append(r"\%s{%s}" % ("P" if posix[1] else "p", _POSIX[posix[2]]))
            else:
                raise ValueError("invalid character class range: " + pattern)
            i = posix.end()
        elif pattern[i] == "\\":
            found = _perl_or_property(pattern, i, inside=True) or _unescape(pattern, i)
            if not found:
                raise ValueError("invalid escape sequence: " + pattern)
            out.append(found[0])
            i = found[1]
        else:
            # "-" keeps its meaning; "[", "&", "^" and "]" are plain here.
            out.append(pattern[i] if pattern[i] == "-" else quote(pattern[i]))
            i += 1
    if i >= len(pattern):
        raise ValueError("missing closing ]: " + pattern)
    out.append("]")
    return i + 1


def _glob_body(pattern: str) -> str:
    """A path glob as an RE2 pattern without anchors."""
    parts = re.compile(r"\*\*/|\*\*|\*|\?|\[[^\]]*\]|[\s\S]").findall(pattern)
    meaning = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "".join(
        meaning.get(p) or (p if len(p) > 1 else re.sub(r"([^0-9A-Za-z_/])", r"\\\1", p) if p.isascii() else p)
        for p in parts
    )


def glob_to_java(pattern: str) -> str | None:
    """A path glob as an anchored Java pattern over the whole path.

    `*` and `?` stop at `/`, `**` crosses it and `**/` may stand for nothing.
    `[...]` is a character class.  A glob without `/` looks at the last path
    segment only.  None when the class is malformed: such a glob matches
    nothing.
    """
    try:
        body = re2_to_java(_glob_body(pattern), multiline=False)
    except ValueError:
        return None
    flags, body = body[:4], body[4:]
    # without a slash only the last segment counts, whatever the pattern could cross
    prefix = "" if "/" in pattern else r"(?:[\s\S]*/)?(?=[^/]*\z)"
    return rf"{flags}\A{prefix}(?:{body})\z"


def path_to_re2(pattern: str) -> tuple[str, bool] | None:
    """Any path pattern as an RE2 pattern, and whether it looks at the last segment only."""
    if pattern == "":
        return None
    if not is_glob(pattern):
        return rf"\A{re.escape(pattern.removesuffix('/'))}(?:\z|/)", False
    body = _glob_body(pattern)
    try:
        re2_to_java(body, multiline=False)
    except ValueError:
        return None
    return rf"\A(?:{body})\z", "/" not in pattern


def is_glob(pattern: str) -> bool:
    """Whether a path pattern is a glob rather than a literal path."""
    return any(c in pattern for c in "*?[")


def path_to_java(pattern: str) -> str | None:
    """Any path pattern (glob or literal ancestor path) as one Java pattern."""
    if pattern == "":
        return None
    if is_glob(pattern):
        return glob_to_java(pattern)
    return rf"\A{quote(pattern.removesuffix('/'))}(?:\z|/)"


def repeats_group(pattern: str) -> bool:
    """Whether an RE2 pattern puts `*`, `+` or a count after a group."""
    plain = re.sub(r"\\Q[\s\S]*?(?:\\E|\Z)|\\[\s\S]|\[\^?\]?(?:\[:[^\]]*:\]|\\[\s\S]|[^\]])*\]", "x", pattern)
    return re.search(r"\)(?:[*+]|\{\d)", plain) is not None


_LITERAL_BYTES = 3


def required_literals(pattern: str) -> list[bytes] | None:
    """Texts of which every match has one, with A-Z in lower case; None where that can't be told.

    Only plain characters in a row count, of three bytes or more, and a group
    counts if it must be there.  `pattern` is one that re2_to_java accepts.
    """
    folds = re.search(r"\(\?[a-z]*i", pattern) is not None
    token = re.compile(
        r"(?P<quote>\\Q[\s\S]*?(?:\\E|\Z))|(?P<escape>\\(?:x\{[0-9A-Fa-f]+\}|x..|[pP](?:\{[^}]*\}|.)|[\s\S]))"
        r"|(?P<set>\[\^?\]?(?:\[:[^\]]*:\]|\\[\s\S]|[^\]\\])*\])|(?P<open>\((?:\?(?:P?<\w+>|[ims]*(?:-[ims]+)?[:)]))?)"
        r"|(?P<close>\))|(?P<either>\|)|(?P<any>[.^$])|(?P<plain>[\s\S])")
    repeat = re.compile(r"(\*|\+|\?|\{(\d+)(?:,\d*)?\})\??")

    def better(a: list[bytes] | None, b: list[bytes] | None) -> list[bytes] | None:
        return max((x for x in (a, b) if x), key=lambda x: min(map(len, x)), default=None)

    def alternatives(i: int) -> tuple[list[bytes] | None, int]:
        branches: list[list[bytes] | None] = []
        best: list[bytes] | None = None
        run = b""

        def ended(best: list[bytes] | None, run: bytes) -> list[bytes] | None:
            return better(best, [run]) if len(run) >= _LITERAL_BYTES else best

        while i < len(pattern):
            item = token.match(pattern, i)
            kind, i = item.lastgroup, item.end()
            inner, char = None, b""
            if kind == "close":
                break
            if kind == "either":
                branches.append(ended(best, run))
                best, run = None, b""
                continue
            if kind == "open" and not item[0].endswith(")"):
                inner, i = alternatives(i)
            elif kind == "plain" or (kind == "escape" and len(item[0]) == 2 and item[0][1].isascii() and not item[0][1].isalnum()):
                text = item[0][-1]
                if not folds or (text.isascii() and text not in "kKsS"):
                    char = text.encode().lower()
            times = repeat.match(pattern, i)
            least = 1
            if times:
                least = {"*": 0, "?": 0, "+": 1}.get(times[1], int(times[2] or 0))
                i = times.end()
            if char and least:
                run += char
            if not char or times:
                best, run = better(ended(best, run), inner if least else None), b""
        branches.append(ended(best, run))
        return (None if None in branches else [x for b in branches for x in b]), i

    return alternatives(0)[0]
