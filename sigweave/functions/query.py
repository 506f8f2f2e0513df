"""Row predicates: pandas-style query strings to Spark SQL, and to checked Python for ordered folds. Nothing is eval'd unchecked."""

from __future__ import annotations

import ast
from collections.abc import Callable

_OPS = {ast.Eq: "=", ast.NotEq: "<>", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Mod: "%"}
_CALLS = {"abs", "min", "max", "round", "len"}
_SQL_CALLS = {"abs": "abs", "min": "least", "max": "greatest", "round": "bround", "len": "length"}


def to_sql(query: str, variables: dict | None = None) -> str:
    """Spark SQL of a query with ==, &, |, ~, and/or/not, in, chained comparisons and @variables."""
    tree = ast.parse(query.replace("@", "__var_"), mode="eval").body
    return _sql(tree, variables or {})


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(v, (list, tuple, set)):
        return "(" + ", ".join(_literal(x) for x in v) + ")"
    return repr(v)


def _sql(n: ast.AST, var: dict) -> str:
    if isinstance(n, ast.BoolOp):
        return "(" + (" AND " if isinstance(n.op, ast.And) else " OR ").join(_sql(v, var) for v in n.values) + ")"
    if isinstance(n, ast.BinOp) and isinstance(n.op, (ast.BitAnd, ast.BitOr)):
        return f"({_sql(n.left, var)} {'AND' if isinstance(n.op, ast.BitAnd) else 'OR'} {_sql(n.right, var)})"
    if isinstance(n, ast.BinOp) and type(n.op) in _OPS:
        return f"({_sql(n.left, var)} {_OPS[type(n.op)]} {_sql(n.right, var)})"
    if isinstance(n, ast.UnaryOp):
        return f"(NOT {_sql(n.operand, var)})" if isinstance(n.op, (ast.Not, ast.Invert)) else f"(-{_sql(n.operand, var)})"
    if isinstance(n, ast.Compare):
        parts, left = [], n.left
        for op, right in zip(n.ops, n.comparators, strict=True):
            if isinstance(op, (ast.In, ast.NotIn)):
                parts.append(f"({_sql(left, var)} {'NOT ' * isinstance(op, ast.NotIn)}IN {_sql(right, var)})")
            elif type(op) in _OPS:
                parts.append(f"({_sql(left, var)} {_OPS[type(op)]} {_sql(right, var)})")
            else:
                raise ValueError(f"unsupported comparison {ast.dump(op)}")
            left = right
        return parts[0] if len(parts) == 1 else "(" + " AND ".join(parts) + ")"
    if isinstance(n, ast.Name):
        return _literal(var[n.id[6:]]) if n.id.startswith("__var_") else f"`{n.id}`"
    if isinstance(n, ast.Constant):
        return _literal(n.value)
    if isinstance(n, (ast.List, ast.Tuple, ast.Set)):
        return "(" + ", ".join(_sql(x, var) for x in n.elts) + ")"
    if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in _SQL_CALLS and not n.keywords:
        return f"{_SQL_CALLS[n.func.id]}({', '.join(_sql(a, var) for a in n.args)})"
    raise ValueError(f"unsupported in a query: {ast.dump(n)}")


_ALLOWED = (ast.Expression, ast.BoolOp, ast.And, ast.Or, ast.UnaryOp, ast.Not, ast.USub, ast.BinOp, ast.Add, ast.Sub, ast.Mult, ast.Div, ast.Mod, ast.Compare, ast.Eq, ast.NotEq, ast.Lt, ast.LtE, ast.Gt, ast.GtE, ast.In, ast.NotIn, ast.Name, ast.Load, ast.Constant, ast.Call, ast.List, ast.Tuple)


def row_predicate(query: str) -> Callable[[dict], bool]:
    """A function of a row (dict) for a predicate of comparisons and arithmetic; a missing value makes it False."""
    tree = ast.parse(query, mode="eval")
    for n in ast.walk(tree):
        if not isinstance(n, _ALLOWED) or isinstance(n, ast.Call) and not (isinstance(n.func, ast.Name) and n.func.id in _CALLS):
            raise ValueError(f"unsupported in a predicate: {ast.dump(n)}")
    code = compile(tree, "<predicate>", "eval")
    names = {"__builtins__": {}, "abs": abs, "min": min, "max": max, "round": round, "len": len}

    def test(row: dict) -> bool:
        try:
            return bool(eval(code, names, row))  # only the node types above
        except (TypeError, ZeroDivisionError):
            return False

    return test
