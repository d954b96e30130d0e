"""The arithmetic expressions of wiki templates."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(<=|>=|!=|<>|[-+*/^()<>=])|([A-Za-z]+))")

#: Precedence of operators; all are left-associative.
_BINARY: dict[str, tuple[int, Callable[[float, float], float]]] = {
    "^": (9, lambda a, b: a**b),
    "*": (7, lambda a, b: a * b),
    "/": (7, lambda a, b: a / b),
    "div": (7, lambda a, b: a / b),
    "mod": (7, lambda a, b: math.fmod(int(a), int(b))),
    "+": (6, lambda a, b: a + b),
    "-": (6, lambda a, b: a - b),
    "round": (5, lambda a, b: _round(a, int(b))),
    **{s: (4, lambda a, b, f=f: float(f(a, b))) for s, f in (("<", lambda a, b: a < b), (">", lambda a, b: a > b), ("<=", lambda a, b: a <= b), (">=", lambda a, b: a >= b), ("=", lambda a, b: a == b), ("!=", lambda a, b: a != b), ("<>", lambda a, b: a != b))},
    "and": (3, lambda a, b: float(bool(a) and bool(b))),
    "or": (2, lambda a, b: float(bool(a) or bool(b))),
}
_UNARY: dict[str, Callable[[float], float]] = {
    "not": lambda a: float(not a), "abs": abs, "sin": math.sin, "cos": math.cos, "asin": math.asin, "acos": math.acos, "tan": math.tan,
    "atan": math.atan, "exp": math.exp, "ln": math.log, "ceil": math.ceil, "floor": math.floor, "trunc": math.trunc, "-": lambda a: -a, "+": lambda a: a,
}
_CONSTANTS = {"e": math.e, "pi": math.pi}
_UNARY_BINDS = 8


def _round(a: float, digits: int) -> float:
    scale = 10.0**digits
    return math.copysign(math.floor(abs(a) * scale + 0.5), a) / scale


def evaluate(text: str) -> float:
    """The value of an expression; raises ValueError if it is none. Truth is 1 and 0."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        match = _TOKEN.match(text, at)
        if not match:
            raise ValueError(f"unexpected {text[at]!r}")
        number, sign, word = match.groups()
        tokens.append(float(number) if number else sign or word.lower())
        at = match.end()
    place = 0

    def operand() -> float:
        nonlocal place
        if place >= len(tokens):
            raise ValueError("operand expected")
        token = tokens[place]
        place += 1
        if isinstance(token, float):
            return token
        if token == "(":
            value = climb(0)
            if place >= len(tokens) or tokens[place] != ")":
                raise ValueError("missing )")
            place += 1
            return value
        if token in _CONSTANTS:
            return _CONSTANTS[token]
        if token in _UNARY:
            return float(_UNARY[token](climb(_UNARY_BINDS)))
        raise ValueError(f"unexpected {token!r}")

    def climb(least: int) -> float:
        nonlocal place
        value = operand()
        while place < len(tokens) and tokens[place] in _BINARY and _BINARY[tokens[place]][0] >= least:
            binds, apply = _BINARY[tokens[place]]
            place += 1
            value = float(apply(value, climb(binds + 1)))
        return value

    try:
        value = climb(0)
    except (ZeroDivisionError, OverflowError) as error:
        raise ValueError(str(error)) from error
    if place != len(tokens):
        raise ValueError(f"unexpected {tokens[place]!r}")
    return value


@F.pandas_udf(T.DoubleType())
def evaluate_expressions(texts: pd.Series) -> pd.Series:
    """evaluate() of each distinct text; null where it is no expression, or nests deeper than Python's calls can."""
    known: dict[str, float | None] = {}
    for text in texts.dropna().unique():
        try:
            known[text] = evaluate(text)
        except (ValueError, TypeError, RecursionError):
            known[text] = None
    return texts.map(known).astype("float64")
