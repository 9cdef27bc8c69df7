"""Line alignment of two texts and its unified rendering: a helper for tasks.

A longest common subsequence is found with bit vectors: one big integer per
side line, so two files of a hundred thousand lines take a second or two.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np

# Bytes of stored bit vectors above which a side is split in two.
_STORE_BYTES = 32 << 20


def split_lines(data: bytes) -> list[bytes]:
    """Lines with their newline; a last line without one differs from one with."""
    parts = data.split(b"\n")
    lines = [p + b"\n" for p in parts[:-1]]
    return lines + [parts[-1]] if parts[-1] else lines


def is_binary(data: bytes) -> bool:
    """A NUL within the first 8000 bytes."""
    return b"\x00" in data[:8000]


def line_counts(old: bytes, new: bytes) -> tuple[int, int]:
    """(added, deleted) lines of a smallest edit."""
    a, b = split_lines(old), split_lines(new)
    same = len(matches(a, b))
    return len(b) - same, len(a) - same


def matches(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    # A line only one side has never matches.
    left, right = set(a[head : len(a) - tail]), set(b[head : len(b) - tail])
    ai = [i for i in range(head, len(a) - tail) if a[i] in right]
    bi = [j for j in range(head, len(b) - tail) if b[j] in left]
    codes: dict[bytes, int] = {}
    x = [codes.setdefault(a[i], len(codes)) for i in ai]
    y = [codes.setdefault(b[j], len(codes)) for j in bi]
    middle = [(ai[i], bi[j]) for i, j in _align(x, y)]
    return (
        [(i, i) for i in range(head)] + middle + [(len(a) - tail + k, len(b) - tail + k) for k in range(tail)]
    )


def _vectors(x: list[int], y: list[int], keep: bool) -> list[int]:
    """Bit vectors after each item of x; a zero bit j marks a length step at y[j]."""
    where: dict[int, int] = {}
    for j, code in enumerate(y):
        where[code] = where.get(code, 0) | (1 << j)
    full = (1 << len(y)) - 1
    v, out = full, []
    for code in x:
        hit = v & where.get(code, 0)
        v = ((v + hit) | (v - hit)) & full
        if keep:
            out.append(v)
    return out if keep else [v]


def _lengths(v: int, n: int) -> np.ndarray:
    """Common-subsequence length with every prefix of y."""
    raw = np.frombuffer(v.to_bytes((n + 7) // 8, "little"), dtype=np.uint8)
    steps = 1 - np.unpackbits(raw, bitorder="little")[:n].astype(np.int64)
    return np.concatenate([[0], np.cumsum(steps)])


def _align(x: list[int], y: list[int]) -> list[tuple[int, int]]:
    if not x or not y:
        return []
    if len(x) > 1 and len(x) * len(y) // 8 > _STORE_BYTES:
        half = len(x) // 2
        down = _lengths(_vectors(x[:half], y, keep=False)[0], len(y))
        up = _lengths(_vectors(x[half:][::-1], y[::-1], keep=False)[0], len(y))[::-1]
        cut = int(np.argmax(down + up))
        rest = _align(x[half:], y[cut:])
        return _align(x[:half], y[:cut]) + [(i + half, j + cut) for i, j in rest]
    rows = _vectors(x, y, keep=True)
    out, j = [], len(y)
    for i in range(len(x) - 1, -1, -1):
        before = rows[i - 1] if i else (1 << len(y)) - 1
        # Walk to the last length step of row i within y[:j].
        steps = ~rows[i] & ((1 << j) - 1)
        if not steps:
            break
        last = steps.bit_length() - 1
        mask = (1 << (last + 1)) - 1
        if (~before & mask).bit_count() == (~rows[i] & mask).bit_count():
            continue
        # Row i adds a step within y[:last+1]: its own match ends there.
        at = last
        while y[at] != x[i]:
            at -= 1
        out.append((i, at))
        j = at
    return out[::-1]


def _blob_id(data: bytes) -> str:
    return hashlib.sha1(b"blob %d\0" % len(data) + data).hexdigest()[:7]


def unified(path: str, old: bytes | None, new: bytes | None, old_path: str | None = None, context: int = 3) -> str:
    """A patch in git's shape for one file; None stands for an absent side."""
    before, after = old_path or path, path
    out = [f"diff --git a/{before} b/{after}\n"]
    ids = (_blob_id(old) if old is not None else "0000000", _blob_id(new) if new is not None else "0000000")
    if old is None:
        out.append(f"new file mode 100644\nindex {ids[0]}..{ids[1]}\n")
    elif new is None:
        out.append(f"deleted file mode 100644\nindex {ids[0]}..{ids[1]}\n")
    else:
        if old_path:
            out.append(f"similarity index 100%\nrename from {before}\nrename to {after}\n")
        if old == new:
            return "".join(out)
        out.append(f"index {ids[0]}..{ids[1]} 100644\n")
    sides = ("/dev/null" if old is None else f"a/{before}", "/dev/null" if new is None else f"b/{after}")
    old, new = old or b"", new or b""
    if is_binary(old) or is_binary(new):
        return "".join(out) + f"Binary files {sides[0]} and {sides[1]} differ\n"
    hunks = _hunks(split_lines(old), split_lines(new), context)
    return "".join(out) + (f"--- {sides[0]}\n+++ {sides[1]}\n" + hunks if hunks else "")


def _hunks(a: list[bytes], b: list[bytes], context: int) -> str:
    """All hunks; changes closer than twice the context share one."""
    edits: list[tuple[int, int, int, int]] = []
    i = j = 0
    for mi, mj in [*matches(a, b), (len(a), len(b))]:
        if mi > i or mj > j:
            edits.append((i, mi, j, mj))
        i, j = mi + 1, mj + 1
    groups: list[list[tuple[int, int, int, int]]] = []
    for edit in edits:
        if groups and edit[0] - groups[-1][-1][1] <= 2 * context:
            groups[-1].append(edit)
        else:
            groups.append([edit])
    return "".join(_hunk(a, b, group, context) for group in groups)


def _hunk(a: list[bytes], b: list[bytes], group: list[tuple[int, int, int, int]], context: int) -> str:
    lead = min(context, group[0][0])
    a0, b0 = group[0][0] - lead, group[0][2] - lead
    trail = min(context, len(a) - group[-1][1])
    a1, b1 = group[-1][1] + trail, group[-1][3] + trail
    body, at = [], a0
    for i0, i1, j0, j1 in group:
        body += [b" " + l for l in a[at:i0]] + [b"-" + l for l in a[i0:i1]] + [b"+" + l for l in b[j0:j1]]
        at = i1
    body += [b" " + l for l in a[at:a1]]
    text = b"".join(l if l.endswith(b"\n") else l + b"\n\\ No newline at end of file\n" for l in body)
    heading = next((l for l in reversed(a[:a0]) if re.match(rb"[A-Za-z_$]", l)), b"").strip()[:80]
    span = f"@@ -{_range(a0, a1)} +{_range(b0, b1)} @@" + (" " + heading.decode("utf-8", "ignore") if heading else "")
    return span + "\n" + text.decode("utf-8", "replace")


def _range(start: int, stop: int) -> str:
    count = stop - start
    first = start + 1 if count else start
    return str(first) if count == 1 else f"{first},{count}"
