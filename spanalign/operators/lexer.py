"""Tokens of C-like text and the labels that they give, without a parser."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanalign.functions import scans

# Calls and casts that count as unsafe, words before an expression, operators that end an operand.
UNSAFE_CALLS = "malloc calloc realloc free alloca memcpy memmove memset strcpy strncpy strcat strncat sprintf vsprintf gets scanf sscanf".split()
UNSAFE_CASTS = "reinterpret_cast const_cast".split()
BEFORE_EXPRESSION = "return throw case sizeof co_return co_yield delete new".split()
ENDS_OPERAND = [")", "]", "++", "--"]
# Operators, longest first.
OPERATORS = "->* <<= >>= ... -> :: ++ -- && || <= >= == != += -= *= /= %= &= |= ^= << >> - + * / % & | ^ ~ ! < > = ? : ; , . ( ) [ ] { } #".split()

KINDS = {
    "comment": r"//[^\n]*|/\*(?s:.*?)\*/",
    "string": r'"(?:\\.|[^"\\\n])*"' + r"|'(?:\\.|[^'\\\n])*'",
    "name": "[A-Za-z_][A-Za-z0-9_]*",
    "number": r"[.]?[0-9][A-Za-z0-9_.']*",
    "operator": "|".join(re.sub(r"(\W)", r"\\\1", o) for o in OPERATORS),
}
#: One pattern for all kinds, for engines without named groups.
PATTERN = "|".join(KINDS.values())
_TOKEN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in KINDS.items()))


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, token) from left to right; blanks, comments and other characters give none."""
    return [(m.lastgroup, m[0]) for m in _TOKEN.finditer(text) if m.lastgroup != "comment"]


def _pointer_casts(toks: list) -> tuple[set, set]:
    """Places of the opening brackets of casts to pointers, and of the stars inside of them.

    Such a cast is a bracket of names and separators, at least one, then stars, a closing bracket, and what begins an operand.
    """
    opened, stars = set(), set()
    shape = "".join("(" if t == "(" else ")" if t == ")" else "*" if t == "*" else "&" if t in ("&", "-", "!", "~") else "n" if k == "name" else "s" if t in ("::", "<", ">", ",") else "v" if k in ("number", "string") else "." for k, t in toks)
    for m in re.finditer(r"\((?=([ns]+)(\*+)\)[nv(*&])", shape):
        opened.add(m.start())
        stars |= set(range(m.start(2), m.end(2)))
    return opened, stars


def labels(text: str) -> set[str]:
    """Which of * & new delete call cast a text shows: unary stars and ampersands, and unsafe calls and casts."""
    toks = [("", ""), *tokens(text), ("", "")]
    opened, stars = _pointer_casts(toks)
    found = {"cast"} if opened else set()
    for k, (kind, token) in enumerate(toks[1:-1], 1):
        (before_kind, before), (_, after) = toks[k - 1], toks[k + 1]
        if kind == "operator" and token in "*&" and k not in stars:
            if k == 1 or before_kind == "operator" and before not in ENDS_OPERAND or before in BEFORE_EXPRESSION:
                found.add(token)
        elif kind == "name":
            if token == "new" and before != "operator" or token == "delete" and before not in ("operator", "="):
                found.add(token)
            elif token in UNSAFE_CALLS and after == "(" and before not in (".", "->"):
                found.add("call")
            elif token in UNSAFE_CASTS and after == "<":
                found.add("cast")
    return found


def text_labels(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, label for each label that a text shows."""
    def find(data, ends):
        raw, first, rows, out = data.tobytes(), 0, [], []
        for k, end in enumerate(ends.tolist()):
            some = sorted(labels(raw[first:end].decode("utf-8", "replace")))
            rows += [k] * len(some)
            out += some
            first = end
        return np.array(rows, np.int64), [pa.array(out, pa.string())]

    return scans.scan(docs, key, text, find, "label string")


def unsafe_kind(node_type: str, callee: str, type_text: str) -> Column:
    """The unsafe kind of a syntax node from its type, the name it calls and the type it casts to; null for others."""
    return (
        F.when(F.col(node_type).isin("new_expression", "delete_expression", "pointer_expression"), F.col(node_type))
        .when((F.col(node_type) == "call_expression") & F.col(callee).isin(UNSAFE_CALLS), F.concat(F.lit("call:"), callee))
        .when((F.col(node_type) == "call_expression") & F.col(callee).isin(UNSAFE_CASTS), F.col(callee))
        .when((F.col(node_type) == "cast_expression") & F.contains(type_text, F.lit("*")), F.lit("pointer_cast"))
    )
