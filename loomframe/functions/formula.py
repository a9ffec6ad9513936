"""Derived variables: a small arithmetic language that compiles to a Column.

Grammar: sums of products of powers of atoms; an atom is a number, a declared name, a
parenthesised sum or a negated atom.  Inputs are read as doubles; division by zero, overflow
and whatever isn't finite give null.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError

TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d+)?|\.\d+)|([A-Za-z_]\w*)|(\*\*|[-+*/()]))")
NAME = re.compile(r"[A-Za-z_]\w*")


def tokens(formula: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = formula.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise EngineError("BUILD_FAILED", f"can't read {text[at:]!r}", formula=formula)
        kind = ("number", "name", "op")[m.lastindex - 1]
        out.append((kind, m[m.lastindex]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, formula: str, inputs: Sequence[str]):
        self.left, self.formula, self.inputs = tokens(formula), formula, set(inputs)

    def fail(self, why: str) -> EngineError:
        return EngineError("BUILD_FAILED", f"{why} in {self.formula!r}", formula=self.formula)

    def take(self, *ops: str) -> str | None:
        if self.left and self.left[0][0] == "op" and self.left[0][1] in ops:
            return self.left.pop(0)[1]
        return None

    def whole(self) -> Column:
        out = self.sum()
        if self.left:
            raise self.fail(f"unexpected {self.left[0][1]!r}")
        return out

    def sum(self) -> Column:
        out = self.product()
        while op := self.take("+", "-"):
            out = out + self.product() if op == "+" else out - self.product()
        return out

    def product(self) -> Column:
        out = self.signed()
        while op := self.take("*", "/"):
            out = out * self.signed() if op == "*" else F.try_divide(out, self.signed())
        return out

    def signed(self) -> Column:
        return -self.signed() if self.take("-") else self.signed() if self.take("+") else self.power()

    def power(self) -> Column:
        base = self.atom()
        return F.pow(base, self.signed()) if self.take("**") else base

    def atom(self) -> Column:
        if self.take("("):
            out = self.sum()
            if not self.take(")"):
                raise self.fail("missing )")
            return out
        kind, text = self.left.pop(0) if self.left else ("end", "")
        if kind == "number":
            return F.lit(float(text))
        if kind == "name":
            if text not in self.inputs:
                raise self.fail(f"undeclared name {text!r}")
            return F.col(text).try_cast("double")
        raise self.fail(f"expected a value, found {text or 'the end'!r}")


def compile_formula(formula: str, inputs: Sequence[str]) -> Column:
    value = _Parser(formula, inputs).whole()
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def derive(df: DataFrame, formula: str, out: str, inputs: Sequence[str]) -> DataFrame:
    """``df`` with column ``out``; every declared input must be there."""
    if not NAME.fullmatch(out):
        raise EngineError("BUILD_FAILED", f"bad output name {out!r}")
    if gone := [c for c in inputs if c not in df.columns]:
        raise EngineError("BUILD_FAILED", f"missing inputs {gone}")
    return df.withColumn(out, compile_formula(formula, inputs))
