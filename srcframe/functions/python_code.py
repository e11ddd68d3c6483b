"""Syntax-tree work on Python texts: the two helpers that run in Arrow workers.

Both get null for every row that is no Python file, so Arrow carries only those texts.
"""

from __future__ import annotations

import ast
import hashlib
import math
import warnings

import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType

from srcframe.schemas import PYTHON_METRICS

_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
_BAD_SOURCE = (SyntaxError, ValueError, RecursionError, MemoryError)


def _parse(text: str) -> ast.Module:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return ast.parse(text)


def _own_points(node: ast.AST) -> int:
    """Decision points one node adds."""
    match node:
        case ast.If() | ast.IfExp() | ast.Assert():
            return 1
        case ast.For() | ast.AsyncFor() | ast.While():
            return 2 if node.orelse else 1
        case ast.Try():
            return len(node.handlers) + (1 if node.orelse else 0)
        case ast.BoolOp():
            return len(node.values) - 1
        case ast.comprehension():
            return 1 + len(node.ifs)
        case ast.Match():
            open_case = any(
                isinstance(c.pattern, ast.MatchAs) and c.pattern.pattern is None for c in node.cases
            )
            return max(0, len(node.cases) - open_case)
    return 0


def _points(node: ast.AST) -> int:
    """Decision points of a subtree; nested functions and classes count for themselves."""
    if isinstance(node, (*_DEFS, ast.ClassDef)):
        return 0
    below = () if isinstance(node, ast.Assert) else ast.iter_child_nodes(node)
    return _own_points(node) + sum(_points(child) for child in below)


def _functions(node: ast.AST):
    """Functions outside classes and other functions, in text order."""
    for child in ast.iter_child_nodes(node):
        if isinstance(child, _DEFS):
            yield child
        elif not isinstance(child, ast.ClassDef):
            yield from _functions(child)


def _terms(node: ast.AST):
    """(operators, operands) that one expression node adds to the volume counts."""
    match node:
        case ast.BinOp():
            return [node.op], [node.left, node.right]
        case ast.UnaryOp():
            return [node.op], [node.operand]
        case ast.BoolOp():
            return [node.op], node.values
        case ast.AugAssign():
            return [node.op], [node.target, node.value]
        case ast.Compare():
            return node.ops, [node.left, *node.comparators]
    return [], []


def _operand_key(node: ast.AST):
    """Names and constants are equal by value, other expressions only to themselves."""
    match node:
        case ast.Name():
            return node.id
        case ast.Attribute():
            return node.attr
        case ast.Constant():
            return node.value
    return id(node)


def _volume(tree: ast.Module) -> tuple[float, float]:
    """Halstead volume and effort. Operands are told apart by enclosing function."""
    ops, args = set(), set()
    n_ops = n_args = 0
    todo = [(tree, None)]
    while todo:
        node, scope = todo.pop()
        operators, operands = _terms(node)
        n_ops, n_args = n_ops + len(operators), n_args + len(operands)
        ops.update(type(o).__name__ for o in operators)
        args.update((scope, _operand_key(a)) for a in operands)
        if isinstance(node, _DEFS):
            todo += [(child, node.name) for child in node.body]
        else:
            todo += [(child, scope) for child in ast.iter_child_nodes(node)]
    words = len(ops) + len(args)
    volume = (n_ops + n_args) * math.log2(words) if words else 0.0
    effort = len(ops) / 2 * n_args / len(args) * volume if args else 0.0
    return volume, effort


def measure(text: str) -> dict | None:
    """Metrics of one file, None for blank or unparsable texts."""
    if not text.strip():
        return None
    try:
        tree = _parse(text)
        rows = [
            {
                "ord": i,
                "function_name": f.name,
                "line_number": f.lineno,
                "complexity_score": 1 + sum(_points(s) for s in f.body),
            }
            for i, f in enumerate(_functions(tree))
        ]
        volume, effort = _volume(tree)
    except _BAD_SOURCE:
        return None
    return {"functions": rows, "halstead_volume": volume, "halstead_effort": effort}


def _outer_functions(node: ast.AST):
    """Functions in the order of the text, without those inside another function."""
    for child in ast.iter_child_nodes(node):
        if isinstance(child, _DEFS):
            yield child
        else:
            yield from _outer_functions(child)


def _first_line(function) -> int:
    return min([function.lineno, *(d.lineno for d in function.decorator_list)])


def skeleton(text: str, anchors: bool = True) -> str | None:
    """The text with function bodies replaced by ``pass``; None when it does not parse.

    With ``anchors`` a comment before each function holds the hash of the removed lines.
    The emptied tree is printed first; where its functions stand is read from the print.
    """
    lines, digests = text.splitlines(), []
    try:
        tree = _parse(text)
        for function in _outer_functions(tree):
            removed = lines[function.body[0].lineno - 1:function.body[-1].end_lineno]
            digests.append(hashlib.sha256("\n".join(removed).encode()).hexdigest())
            function.body = [ast.Pass()]
        printed = ast.unparse(tree)
        if not anchors or not digests:
            return printed
        starts = [_first_line(f) - 1 for f in _outer_functions(_parse(printed))]
    except _BAD_SOURCE:
        return None
    out, done = printed.split("\n"), 0
    pieces = []
    for start, digest in zip(starts, digests, strict=True):
        indent = out[start][:len(out[start]) - len(out[start].lstrip())]
        # the empty line before a function stays next to it
        before = start - 1 if start > done and out[start - 1] == "" else start
        pieces += [*out[done:before], f"{indent}# body-sha256: {digest}", ""]
        done = start
    return "\n".join([*pieces, *out[done:]])


def _worker(result_type, job):
    """An Arrow function over texts that skips nulls.

    It is marked as not deterministic, else a filter on its result would be pushed
    below it and every text parsed twice.
    """
    @arrow_udf(result_type)
    def run(texts):
        rows = [None if t is None else job(t) for t in texts.to_pylist()]
        return pa.array(rows, to_arrow_type(result_type))

    return run.asNondeterministic()


python_metrics = _worker(PYTHON_METRICS, measure)
python_skeleton = _worker(StringType(), skeleton)
python_skeleton_plain = _worker(StringType(), lambda text: skeleton(text, anchors=False))
