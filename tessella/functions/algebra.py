"""Equality of short algebraic expressions, decided by value and never by running their text as code.

An expression is read by a small grammar (sums, products with or without a sign, quotients, powers, roots, fractions,
brackets, letters, pi) into a tree. Two are equal if their values agree at several fixed points of their letters: a
nonzero polynomial or quotient of the sizes at hand vanishes at all of them practically never. Where powers are too large
to be worked out there, the points lie on the unit circle, where a power of any degree has a value of size 1.
"""

from __future__ import annotations

import cmath
import math
import re

MAX_LENGTH, MAX_LETTERS, POINTS = 200, 4, 6
_TOKEN = re.compile(r"\s*(\d+\.?\d*(?:e[+-]?\d+)?|\.\d+|\\?sqrt|\\frac|\\cdot|\\times|\\pi|pi|[a-z]|\*\*|[-+*/^(){}\[\]])", re.IGNORECASE)


class Unreadable(ValueError):
    """The text isn't an expression of this grammar."""


def tokens(text: str) -> list[str]:
    if len(text) > MAX_LENGTH:
        raise Unreadable("too long")
    out, at, end = [], 0, len(text.rstrip())
    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            raise Unreadable(text)
        out.append({"\\cdot": "*", "\\times": "*", "\\pi": "pi", "**": "^", "\\sqrt": "sqrt", "[": "(", "]": ")"}.get(m[1], m[1]))
        at = m.end()
    return out


def parse(text: str):
    """A tree of ("number", x), ("letter", c), (operator, a, b) and ("sqrt", a)."""
    left = tokens(text)[::-1]

    def peek() -> str:
        return left[-1] if left else ""

    def take(want: str = "") -> str:
        if not left or want and left[-1] != want:
            raise Unreadable(text)
        return left.pop()

    def total():
        sign = take() if peek() in ("+", "-") else "+"
        out = product()
        if sign == "-":
            out = ("-", ("number", 0.0), out)
        while peek() in ("+", "-"):
            out = (take(), out, product())
        return out

    def product():
        out = power()
        while left and peek() not in ("+", "-", ")", "}"):
            out = (take(), out, power()) if peek() in ("*", "/") else ("*", out, power())
        return out

    def power():
        if peek() in ("+", "-"):
            return ("-", ("number", 0.0), power()) if take() == "-" else power()
        out = atom()
        return ("^", out, power()) if peek() == "^" and take() else out

    def braced():
        if peek() == "{":
            take()
            out = total()
            take("}")
            return out
        return atom()

    def atom():
        t = take()
        if t in ("(", "{"):
            out = total()
            take(")" if t == "(" else "}")
            return out
        if t == "\\frac":
            return ("/", braced(), braced())
        if t == "sqrt":
            return ("sqrt", braced())
        if t == "pi":
            return ("number", math.pi)
        if t[0].isdigit() or t[0] == ".":
            return ("number", float(t))
        if len(t) == 1 and t.isalpha():
            return ("letter", t)
        raise Unreadable(text)

    out = total()
    if left:
        raise Unreadable(text)
    return out


def letters(tree) -> set[str]:
    return {tree[1]} if tree[0] == "letter" else set() if tree[0] == "number" else set().union(*map(letters, tree[1:]))


def value(tree, at: dict[str, complex]) -> complex:
    kind = tree[0]
    if kind == "number":
        return complex(tree[1])
    if kind == "letter":
        return at[tree[1]]
    a = value(tree[1], at)
    if kind == "sqrt":
        return cmath.sqrt(a)
    b = value(tree[2], at)
    return a + b if kind == "+" else a - b if kind == "-" else a * b if kind == "*" else a / b if kind == "/" else a**b


def _agree(p, q, names: list[str], circle: bool, tolerance: float) -> bool:
    """Whether two trees agree at every point; the points' coordinates are positive, or angles between 0 and pi / 2."""
    for k in range(POINTS if names else 1):
        steps = {c: (i + 1) * (k + 2) % 7 for i, c in enumerate(names)}
        at = {c: cmath.rect(1, 0.3 + 0.17 * s + 0.011 * k) if circle else complex(0.37 + 0.61 * s + 0.011 * k) for c, s in steps.items()}
        x, y = value(p, at), value(q, at)
        if not (cmath.isfinite(x) and cmath.isfinite(y)):
            raise OverflowError
        if not abs(x - y) <= tolerance * max(abs(x), abs(y), 1.0):
            return False
    return True


def same(a: str, b: str, tolerance: float = 1e-9) -> bool:
    """Whether both can be read and have the same value at every point; what can't be read or worked out is not equal."""
    try:
        p, q = parse(a), parse(b)
        names = sorted(letters(p) | letters(q))
        if len(names) > MAX_LETTERS:
            return False
        try:
            return _agree(p, q, names, False, tolerance)
        except OverflowError:
            return bool(names) and _agree(p, q, names, True, tolerance)
    except (Unreadable, ArithmeticError, RecursionError, ValueError):
        return False
