"""A formula language over columns: parsed with Python's grammar, never run as Python, compiled to one Column.

Numbers, names (dotted names are one name), ``+ - * / **``, comparisons (chained), ``and or not``, ``a if c else b``, and
the functions of FUNCTIONS. All values are doubles, comparisons are 1 or 0; texts appear in ``==`` and ``!=`` only. Formulas
can be differentiated by a name, which gives another formula.
"""

from __future__ import annotations

import ast
import difflib
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchloom.functions import ieee

MAX_LENGTH = 10_000
#: Number of arguments of each function, None: one or more.
FUNCTIONS: dict[str, int | None] = {"log": 1, "log10": 1, "exp": 1, "sqrt": 1, "abs": 1, "min": None, "max": None, "round": None, "isfinite": 1, "where": 3}
CONSTANTS = {"nan": float("nan"), "inf": float("inf"), "True": 1.0, "False": 0.0}


class FormulaError(ValueError):
    """A formula that cannot be used: what is wrong, where, and what may be meant."""

    def __init__(self, text: str, column: int, message: str) -> None:
        super().__init__(f"{message}\n  {text}\n  {' ' * max(column, 0)}^")
        self.column = column


@dataclass(frozen=True)
class Num:
    value: float


@dataclass(frozen=True)
class Str:
    value: str


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Op:
    """An operator or function with its arguments; name is the operator's sign or the function's name."""

    name: str
    args: tuple


Node = Num | Str | Var | Op
_BINARY = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Pow: "**"}
_COMPARE = {ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Eq: "==", ast.NotEq: "!="}


def parse(text: str, known: Mapping | set | None = None, functions: Mapping[str, int | None] = FUNCTIONS) -> Node:
    """The formula's tree; ``known`` names are checked if given."""
    if len(text) > MAX_LENGTH:
        raise FormulaError(text[:60] + "...", 0, f"longer than {MAX_LENGTH} characters")
    plain = text.replace("−", "-").replace("·", "*").replace("×", "*").strip()
    try:
        tree = ast.parse(plain, mode="eval").body
    except (SyntaxError, ValueError, RecursionError) as e:
        raise FormulaError(plain, (getattr(e, "offset", 1) or 1) - 1, "not a formula") from None

    def wrong(node: ast.AST, message: str) -> FormulaError:
        return FormulaError(plain, getattr(node, "col_offset", 0), message)

    def name_of(node: ast.AST) -> str | None:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Attribute) and (head := name_of(node.value)):
            return f"{head}.{node.attr}"
        return None

    def convert(node: ast.AST) -> Node:
        if isinstance(node, ast.Constant):
            if isinstance(node.value, str):
                return Str(node.value)
            if isinstance(node.value, (bool, int, float)):
                return Num(float(node.value))
        if (name := name_of(node)) is not None:
            if name in CONSTANTS and (known is None or name not in known):
                return Num(CONSTANTS[name])
            if known is not None and name not in known:
                close = difflib.get_close_matches(name, list(known), 1)
                raise wrong(node, f"unknown name {name!r}" + (f", did you mean {close[0]!r}?" if close else f"; known: {', '.join(sorted(known)) or 'none'}"))
            return Var(name)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd, ast.Not)):
            arg = number(node.operand)
            return arg if isinstance(node.op, ast.UAdd) else Op("not" if isinstance(node.op, ast.Not) else "neg", (arg,))
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return Op(_BINARY[type(node.op)], (number(node.left), number(node.right)))
        if isinstance(node, ast.BoolOp):
            return Op("and" if isinstance(node.op, ast.And) else "or", tuple(number(v) for v in node.values))
        if isinstance(node, ast.Compare) and all(type(o) in _COMPARE for o in node.ops):
            sides = [convert(x) for x in (node.left, *node.comparators)]
            parts = []
            for o, a, b in zip(node.ops, sides[:-1], sides[1:], strict=True):
                sign = _COMPARE[type(o)]
                if (isinstance(a, Str) or isinstance(b, Str)) and sign not in ("==", "!="):
                    raise wrong(node, "texts can only be equal or not")
                parts.append(Op(sign, (a, b)))
            return parts[0] if len(parts) == 1 else Op("and", tuple(parts))
        if isinstance(node, ast.IfExp):
            return Op("where", (number(node.test), number(node.body), number(node.orelse)))
        if isinstance(node, ast.Call):
            function = name_of(node.func)
            if function not in functions:
                close = difflib.get_close_matches(function or "", list(functions), 1)
                raise wrong(node, f"unknown function {function!r}" + (f", did you mean {close[0]!r}?" if close else ""))
            if node.keywords or any(isinstance(a, ast.Starred) for a in node.args):
                raise wrong(node, "arguments have no names here")
            count = functions[function]
            args = tuple(convert(a) if function not in FUNCTIONS else number(a) for a in node.args)
            if not args or (count is not None and len(args) != count):
                raise wrong(node, f"{function} takes {count or 'some'} argument(s)")
            if function == "round":
                digits = args[1] if len(args) == 2 else Num(0.0)
                if isinstance(digits, Op) and digits.name == "neg" and isinstance(digits.args[0], Num):
                    digits = Num(-digits.args[0].value)
                if len(args) > 2 or not isinstance(digits, Num) or digits.value != int(digits.value) or abs(digits.value) > 15:
                    raise wrong(node, "round takes a value and a whole number from -15 to 15")
                args = (args[0], digits)
            return Op(function, args)
        raise wrong(node, f"{type(node).__name__} is not part of formulas")

    def number(node: ast.AST) -> Node:
        out = convert(node)
        if isinstance(out, Str):
            raise wrong(node, "a text can only be compared")
        return out

    out = convert(tree)
    if isinstance(out, Str):
        raise wrong(tree, "a text is not a formula")
    return out


def names(node: Node) -> list[str]:
    """The names in a formula, in order of appearance."""
    if isinstance(node, Var):
        return [node.name]
    return list(dict.fromkeys(n for a in node.args for n in names(a))) if isinstance(node, Op) else []


def _number(c: Column) -> Column:
    return c.cast("double")


def to_column(node: Node, env: Mapping[str, Column], texts: set[str] | frozenset[str] = frozenset(), extra: Mapping[str, Callable[..., Column]] | None = None) -> Column:
    """The formula as a double column; ``env`` gives the columns, ``texts`` names those that hold text."""

    def value(n: Node) -> Column:
        if isinstance(n, Num):
            return F.lit(n.value)
        if isinstance(n, Var):
            return _number(env[n.name])
        return _number(result(n))

    def test(n: Node) -> Column:
        """As a condition."""
        out = result(n) if isinstance(n, Op) and n.name in (*_COMPARE.values(), "and", "or", "not", "isfinite") else None
        return out if out is not None else ieee.truth(value(n))

    def result(n: Op) -> Column:
        name, args = n.name, n.args
        if extra and name in extra:
            return extra[name](*args)
        if name in _COMPARE.values():
            if any(isinstance(a, Str) or isinstance(a, Var) and a.name in texts for a in args):
                a, b = (F.lit(x.value) if isinstance(x, Str) else env[x.name].cast("string") for x in args)
                return F.coalesce(a == b if name == "==" else a != b, F.lit(False))
            return ieee.compare(name, value(args[0]), value(args[1]))
        if name == "and":
            return reduce(lambda a, b: a & b, map(test, args))
        if name == "or":
            return reduce(lambda a, b: a | b, map(test, args))
        if name == "not":
            return ~test(args[0])
        if name == "where":
            c = test(args[0])
            return F.when(c.isNull(), F.lit(None).cast("double")).when(c, value(args[1])).otherwise(value(args[2]))
        v = [value(a) for a in args]
        if name in ("min", "max"):
            return ieee.extreme(v, name == "max")
        if name == "round":
            return ieee.round_even(v[0], int(args[1].value))
        simple = {
            "+": lambda: v[0] + v[1], "-": lambda: v[0] - v[1], "*": lambda: v[0] * v[1], "/": lambda: ieee.divide(v[0], v[1]), "**": lambda: ieee.power(v[0], v[1]), "neg": lambda: -v[0],
            "log": lambda: ieee.log(v[0]), "log10": lambda: ieee.log(v[0], True), "exp": lambda: F.exp(v[0]), "sqrt": lambda: F.sqrt(v[0]), "abs": lambda: F.abs(v[0]),
            "isfinite": lambda: ieee.is_finite(v[0]), "sign": lambda: F.signum(v[0]),
        }
        return simple[name]()

    return value(node)


def compile_formula(text: str, df: DataFrame, extra: Mapping[str, Column] | None = None) -> Column:
    """The formula over the columns of ``df`` (and ``extra`` ones) as a double column."""
    env = {c: F.col(f"`{c}`") for c in df.columns} | dict(extra or {})
    texts = {f.name for f in df.schema if f.dataType.typeName() == "string"}
    return to_column(parse(text, env), env, texts)


def evaluate(node: Node, env: Mapping[str, np.ndarray | float | str]) -> np.ndarray | float:
    """The formula over arrays (or numbers), with the meaning that to_column has: IEEE arithmetic, comparisons 1 or 0 and 0 with nan, every number but 0 true."""

    def text(n: Node):
        return n.value if isinstance(n, Str) else env[n.name] if isinstance(n, Var) else None

    def is_text(n: Node) -> bool:
        return isinstance(n, Str) or isinstance(n, Var) and np.asarray(env[n.name]).dtype.kind in "OU"

    def value(n: Node):
        if isinstance(n, Num):
            return n.value
        if isinstance(n, Var):
            return np.asarray(env[n.name], float)
        return result(n)

    def truth(n: Node):
        return np.asarray(value(n), float) != 0

    def result(n: Op):
        if n.name in ("==", "!=") and any(is_text(a) for a in n.args):
            a, b = (np.asarray(text(x), object) for x in n.args)
            return ((a == b) if n.name == "==" else (a != b)).astype(float)
        if n.name == "and":
            return reduce(np.logical_and, map(truth, n.args)).astype(float)
        if n.name == "or":
            return reduce(np.logical_or, map(truth, n.args)).astype(float)
        if n.name == "not":
            return (~truth(n.args[0])).astype(float)
        if n.name == "where":
            return np.where(truth(n.args[0]), value(n.args[1]), value(n.args[2]))
        v = [np.asarray(value(a), float) for a in n.args]
        compared = {"<": np.less, "<=": np.less_equal, ">": np.greater, ">=": np.greater_equal, "==": np.equal, "!=": np.not_equal}
        simple = {"+": np.add, "-": np.subtract, "*": np.multiply, "/": np.divide, "**": np.power, "neg": np.negative, "log": np.log, "log10": np.log10, "exp": np.exp, "sqrt": np.sqrt, "abs": np.abs, "sign": np.sign}
        if n.name in compared:
            return compared[n.name](*v).astype(float)
        if n.name in ("min", "max"):
            return reduce(np.minimum if n.name == "min" else np.maximum, v)
        if n.name == "round":
            return np.round(v[0], int(n.args[1].value))
        if n.name == "isfinite":
            return np.isfinite(v[0]).astype(float)
        return simple[n.name](*v)

    with np.errstate(all="ignore"):
        return value(node)


def evaluate_with_uncertainty(text: str, env: Mapping[str, tuple[float, float]]) -> tuple[float, float]:
    """Value and standard uncertainty of a formula over independent inputs (value, u), by its derivatives."""
    node = parse(text, set(env))
    values = {n: v for n, (v, _) in env.items()}
    parts = [(float(evaluate(derivative(node, n), values)), env[n][1]) for n in names(node)]
    return float(evaluate(node, values)), sum((g * u) ** 2 for g, u in parts if g != 0) ** 0.5


def _simplify(name: str, *args: Node) -> Node:
    zero, one = Num(0.0), Num(1.0)
    a, b = (*args, None)[:2]
    if name == "+":
        return b if a == zero else a if b == zero else Op(name, args)
    if name == "-":
        return a if b == zero else Op("neg", (b,)) if a == zero else Op(name, args)
    if name == "*":
        return zero if zero in (a, b) else b if a == one else a if b == one else Op(name, args)
    if name == "/":
        return zero if a == zero else a if b == one else Op(name, args)
    if name == "neg":
        return zero if a == zero else Op(name, args)
    return Op(name, args)


def derivative(node: Node, name: str) -> Node:
    """The partial derivative by ``name``; of where, min and max that of the branch taken, of round and comparisons 0."""
    if isinstance(node, Var):
        return Num(1.0 if node.name == name else 0.0)
    if not isinstance(node, Op) or name not in names(node):
        return Num(0.0)
    s = _simplify
    args = node.args
    d = [derivative(a, name) for a in args]
    two = Num(2.0)
    match node.name:
        case "+" | "-":
            return s(node.name, *d)
        case "neg":
            return s("neg", d[0])
        case "*":
            return s("+", s("*", d[0], args[1]), s("*", args[0], d[1]))
        case "/":
            return s("-", s("/", d[0], args[1]), s("/", s("*", args[0], d[1]), s("**", args[1], two)))
        case "**":
            base = s("*", s("*", args[1], Op("**", (args[0], s("-", args[1], Num(1.0))))), d[0])
            return base if d[1] == Num(0.0) else s("+", base, s("*", s("*", node, Op("log", (args[0],))), d[1]))
        case "log":
            return s("/", d[0], args[0])
        case "log10":
            return s("/", d[0], s("*", args[0], Num(2.302585092994046)))
        case "exp":
            return s("*", node, d[0])
        case "sqrt":
            return s("/", s("*", Num(0.5), d[0]), node)
        case "abs":
            return s("*", Op("sign", (args[0],)), d[0])
        case "where":
            return Op("where", (args[0], d[1], d[2]))
        case "min" | "max":
            out = d[-1]
            for a, g in list(zip(args, d, strict=True))[-2::-1]:
                out = Op("where", (Op("==", (a, node)), g, out))
            return out
    return Num(0.0)


def substitute(node: Node, by: Mapping[str, Node]) -> Node:
    """The formula with names replaced by formulas."""
    if isinstance(node, Var):
        return by.get(node.name, node)
    return Op(node.name, tuple(substitute(a, by) for a in node.args)) if isinstance(node, Op) else node
