"""Arithmetic column rules such as ``{UnitPrice} * {Quantity}``."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import AMOUNT

_PLACEHOLDER = re.compile(r"\{([A-Za-z0-9_]+)\}")
_WIDE = "decimal(38,12)"
_OPERATIONS: dict[type, Callable[[Column, Column], Column]] = {
    ast.Add: lambda a, b: F.try_add(a, b),
    ast.Sub: lambda a, b: F.try_subtract(a, b),
    ast.Mult: lambda a, b: F.try_multiply(a, b),
    ast.Div: lambda a, b: F.try_divide(a, b),
}


def arithmetic(template: str, value_of: Callable[[str], Column]) -> Column:
    """Turns a template into one Column; any failing operation gives 0.

    ``value_of`` supplies the amount of a placeholder. Only placeholders,
    numbers, ``+ - * /`` and parentheses are accepted.
    """
    if not template.strip():
        return F.lit(0).cast(AMOUNT)
    names: list[str] = []

    def place(found: re.Match) -> str:
        names.append(found.group(1))
        return f" _{len(names) - 1} "

    def build(node: ast.AST) -> Column:
        if isinstance(node, ast.Name) and node.id[1:].isdigit():
            return value_of(names[int(node.id[1:])])
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return F.lit(str(node.value)).cast(AMOUNT)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
            inner = build(node.operand)
            return -inner if isinstance(node.op, ast.USub) else inner
        if isinstance(node, ast.BinOp) and type(node.op) in _OPERATIONS:
            return _OPERATIONS[type(node.op)](build(node.left), build(node.right))
        raise ValueError(f"Not an arithmetic rule: {template}")

    try:
        tree = ast.parse(_PLACEHOLDER.sub(place, template).strip(), mode="eval")
    except SyntaxError as error:
        raise ValueError(f"Not an arithmetic rule: {template}") from error
    return F.coalesce(build(tree.body).try_cast(_WIDE), F.lit(0).cast(_WIDE))
