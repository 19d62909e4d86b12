"""The include/exclude expression language, compiled to Spark columns.

Grammar, loosest first: ``|`` ``||``, ``&`` ``&&``, comparisons and ``~`` ``!~``, ``+ -``, ``* / %``, unary ``! -``, subscripts. Semantics:

* A comparison with a list is true if any element (any pair for two lists) fits; ``!=`` is the negation of ``=``.
* ``=`` compares as numbers if both sides are numbers, else as text. A missing value is the text "." and false; ordered
  comparisons with it are false. Every predicate compiles to a boolean that is never null, so that ``!`` of a missing comparison holds.
* Arithmetic with a missing value or a list of several, and MIN, MAX, AVG of nothing, give a missing value.
* ``GT`` compares with the genotype classes (alt ref mis het hom RR RA AA aA R A hap) or with a genotype's text.

Names are bound by a ``Scope``: columns of a typed frame, or ``info`` and ``samples`` of a frame read from VCF.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteloom.functions import genotypes as G
from siteloom.functions import prob
from siteloom.functions import variants as V
from siteloom.functions.lets import let, number

_LEX = re.compile(
    r"""\s*(?:(?P<num>\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<file>@[\w./-]+)|(?P<name>(?:(?:INFO|FORMAT|FMT)/|/)?%?[A-Za-z_][\w.]*)"""
    r"""|(?P<op>\|\||&&|==|!=|<=|>=|=~|!~|[-+*/%&|<>=~!()\[\],:]))"""
)
_ESCAPED, _ESCAPES = re.compile(r"\\(.)"), {"t": "\t", "n": "\n", "r": "\r", "\\": "\\", '"': '"', "'": "'"}
_CLASSES = frozenset("alt ref mis het hom A R RR RA AR AA aA Aa HOM HET HAP hap".split())
_BINARY = {"|": 1, "||": 1, "&": 2, "&&": 2, **dict.fromkeys(("=", "==", "!=", "<", "<=", ">", ">=", "~", "=~", "!~"), 3), "+": 4, "-": 4, "*": 5, "/": 5, "%": 5}
_UNARY = 6


class ExpressionError(ValueError):
    pass


def lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected {text[at:at + 10]!r} in {text!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


@dataclass(frozen=True)
class Node:
    kind: str
    value: object = None
    args: tuple = ()


def parse(text: str) -> Node:
    """The expression's tree: num, str, file, name, call, index, unary and binary nodes."""
    tokens, at = lex(text), 0

    def peek() -> tuple[str, str]:
        return tokens[at] if at < len(tokens) else ("end", "")

    def take(value: str | None = None) -> tuple[str, str]:
        nonlocal at
        t = peek()
        if value is not None and t[1] != value or t[0] == "end":
            raise ExpressionError(f"expected {value or 'a value'} but found {t[1] or 'the end'} in {text!r}")
        at += 1
        return t

    def subscript(n: Node) -> Node:
        while peek()[1] == "[":
            take("[")
            parts: list[list[str]] = [[]]
            while peek()[1] != "]":
                t = take()[1]
                if t == ":":
                    parts.append([])
                else:
                    parts[-1].append(t)
            take("]")
            n = Node("index", tuple("".join(p) or "*" for p in parts), (n,))
        return n

    def prefix() -> Node:
        kind, value = take()
        if value == "(":
            n = climb(0)
            take(")")
            return subscript(n)
        if value in ("!", "-"):
            return Node("unary", value, (climb(_UNARY),))
        if kind == "num":
            return Node("num", float(value))
        if kind == "str":
            return Node("str", _ESCAPED.sub(lambda m: _ESCAPES.get(m[1], m[0]), value[1:-1]))
        if kind == "file":
            return Node("file", value[1:])
        if kind == "name":
            if peek()[1] == "(":
                take("(")
                args = []
                while peek()[1] != ")":
                    args.append(climb(0))
                    if peek()[1] == ",":
                        take(",")
                take(")")
                return subscript(Node("call", value.upper(), tuple(args)))
            return subscript(Node("name", value))
        raise ExpressionError(f"unexpected {value!r} in {text!r}")

    def climb(least: int) -> Node:
        left = prefix()
        while peek()[1] in _BINARY and _BINARY[peek()[1]] > least:
            op = take()[1]
            right = climb(_BINARY[op])
            left = Node("binary", {"||": "|", "&&": "&", "==": "=", "=~": "~"}.get(op, op), (left, right))
            if _BINARY[op] == 3 and _BINARY.get(peek()[1]) == 3:
                raise ExpressionError(f"comparisons don't chain in {text!r}")
        return left

    out = climb(0)
    if at < len(tokens):
        raise ExpressionError(f"unexpected {peek()[1]!r} in {text!r}")
    return out


@dataclass
class Value:
    """A compiled value: kind num, str or bool; ``many`` if it's an array of them."""

    column: Column
    kind: str
    many: bool = False
    gt: bool = False


@dataclass
class Scope:
    """Where names are found. ``kinds`` gives a column's kind where it isn't a number; ``samples`` is an array of structs."""

    kinds: dict[str, tuple[str, bool]]
    info: Column | None = None
    samples: Column | None = None
    sample: Column | None = None

    def fixed(self, name: str) -> Value | None:
        ref, alts = F.col("ref"), F.col("alts")
        bits = lambda: V.variant_class(ref, alts)
        made: dict[str, Callable[[], Value]] = {
            "CHROM": lambda: Value(F.col("chrom"), "str"), "POS": lambda: Value(F.col("pos"), "num"), "ID": lambda: Value(F.col("id"), "str"),
            "REF": lambda: Value(ref, "str"), "ALT": lambda: Value(alts, "str", True), "QUAL": lambda: Value(F.col("qual"), "num"),
            "FILTER": lambda: Value(F.col("filters"), "str", True), "N_ALT": lambda: Value(F.size(alts), "num"),
            "TYPE": lambda: Value(F.split(V.class_label(bits()), ","), "str", True), "ILEN": lambda: Value(V.ilen(ref, alts), "num"),
            "N_SAMPLES": lambda: Value(F.size(self.samples) if self.samples is not None else F.lit(0), "num"),
        }
        return made[name]() if name in made else None

    def named(self, name: str) -> Value:
        where, _, tag = name.rpartition("/")
        where, plain = where.upper(), tag.lstrip("%")
        if where not in ("", "INFO", "FMT", "FORMAT"):
            raise ExpressionError(f"unknown namespace in {name!r}")
        if not where and (v := self.fixed(plain.upper())) is not None:
            return v
        per_sample = where in ("FMT", "FORMAT")
        if plain.upper() == "GT" and where != "INFO":
            if self.sample is not None:
                return Value(self.sample["alleles"], "num", True, gt=True)
            if self.samples is not None:
                return Value(F.transform(self.samples, lambda s: s["alleles"]), "num", True, gt=True)
            return Value(F.col("alleles"), "num", True, gt=True)
        if self.info is None:
            kind, many = self.kinds.get(plain.lower(), ("num", False))
            return Value(F.col(plain.lower()), kind, many)
        if self.sample is not None and not where == "INFO":
            return Value(self.sample["fmt"][plain], "str", True)
        if per_sample and self.samples is not None:
            return Value(F.flatten(F.transform(self.samples, lambda s: F.coalesce(s["fmt"][plain], F.array(F.lit("."))))), "str", True)
        return Value(self.info[plain], "str", True)


#: Kinds of the columns of typed frames that aren't single numbers.
TYPED = Scope({"ad": ("num", True), "pl": ("num", True), "ac": ("num", True), "phased": ("bool", False), "sample": ("str", False), "alleles": ("num", True)})


def vcf_scope() -> Scope:
    """Of frames with ``info`` (map of tag to texts) and ``samples`` (structs of sample, alleles, phased, fmt)."""
    return Scope({}, F.col("info"), F.col("samples"))


def _number(v: Column, kind: str) -> Column:
    return v.cast("double") if kind == "num" else number(v)


def _number_array(v: Value) -> Column:
    return F.transform(v.column, lambda x: _number(x, v.kind)) if v.many else F.array(_number(v.column, v.kind))


def _text(v: Column, kind: str) -> Column:
    if kind == "num":
        whole = v.cast("double") == F.floor(v.cast("double"))
        v = F.when(whole, v.cast("decimal(20,0)").cast("string")).otherwise(v.cast("string"))
    return F.coalesce(v, F.lit("."))


def _equal(a: Column, ak: str, b: Column, bk: str) -> Column:
    x, y = _number(a, ak), _number(b, bk)
    if ak == bk == "num":
        return F.coalesce(x == y, a.isNull() & b.isNull())
    return F.coalesce(x == y, _text(a, ak) == _text(b, bk))


def _pairs(a: Value, b: Value, test: Callable[[Column, Column], Column]) -> Column:
    """Whether any element, or any pair of elements, fits; false for empty and missing lists."""
    yes = lambda x, y: F.coalesce(test(x, y), F.lit(False))
    if a.many and b.many:
        out = F.exists(a.column, lambda x: F.exists(b.column, lambda y: yes(x, y)))
    elif a.many:
        out = F.exists(a.column, lambda x: yes(x, b.column))
    elif b.many:
        out = F.exists(b.column, lambda y: yes(a.column, y))
    else:
        out = yes(a.column, b.column)
    return F.coalesce(out, F.lit(False))


def truth(v: Value) -> Column:
    """0, NaN, "", "." and missing are false; a list is true if any element is."""
    if v.kind == "bool":
        one = lambda x: F.coalesce(x, F.lit(False))
    elif v.kind == "num":
        one = lambda x: F.coalesce((x != 0) & ~F.isnan(x.cast("double")), F.lit(False))
    else:
        one = lambda x: F.coalesce(~x.isin("", ".", "0"), F.lit(False))
    return F.coalesce(F.exists(v.column, one), F.lit(False)) if v.many else one(v.column)


class Compiler:
    def __init__(self, scope: Scope, files: Callable[[str], list[str]] | None = None) -> None:
        self.scope, self.files = scope, files or _lines_of

    def value(self, n: Node) -> Value:
        return getattr(self, f"_{n.kind}")(n)

    def _num(self, n: Node) -> Value:
        return Value(F.lit(n.value), "num")

    def _str(self, n: Node) -> Value:
        return Value(F.lit(n.value), "str")

    def _file(self, n: Node) -> Value:
        return Value(F.array(*map(F.lit, self.files(n.value))) if self.files(n.value) else F.array().cast("array<string>"), "str", True)

    def _name(self, n: Node) -> Value:
        if n.value.upper() == "F_MISSING":
            return self._call(Node("call", "F_MISSING"))
        return self.scope.named(n.value)

    def _chosen(self, spec: str, samples: Column | None = None) -> Callable[[Column, Column], Column]:
        """The test of an element and its index that a subscript asks for: ``*``, ``3``, ``1-4``, ``2-``, ``0,3`` and, of samples, ``@file`` of names."""
        if spec.startswith("@"):
            names = self.files(spec[1:])
            return lambda x, i: x["sample"].isin(*names) if names else F.lit(False)
        tests = []
        for part in spec.split(","):
            lo, dash, hi = part.partition("-")
            if part == "*":
                tests.append(lambda i: F.lit(True))
            elif lo.isdigit() and (not hi or hi.isdigit()):
                tests.append(lambda i, lo=int(lo), hi=int(hi) if hi else None if dash else int(lo): (i >= lo) & (F.lit(True) if hi is None else i <= hi))
            else:
                raise ExpressionError(f"bad subscript [{spec}]")
        return lambda x, i: reduce(lambda a, b: a | b, [t(i) for t in tests])

    def _index(self, n: Node) -> Value:
        if n.value[0].startswith("@") and len(n.value) == 1:
            n = Node("index", (n.value[0], "*"), n.args)
        if any(not (x == "*" or x.isdigit()) for x in n.value):
            return self._several(n)
        v = self.value(n.args[0])
        if len(n.value) == 1:
            if n.value[0] == "*" or not v.many:
                return v if v.many or n.value[0] in ("*", "0") else Value(F.lit(None).cast("double" if v.kind == "num" else "string"), v.kind)
            return Value(F.get(v.column, F.lit(int(n.value[0]))), v.kind, False)
        sample, at = n.value
        name = n.args[0].value.rpartition("/")[2]
        if self.scope.samples is None:
            raise ExpressionError("a sample subscript needs samples")
        chosen = self.scope.samples if sample == "*" else F.array_compact(F.array(F.get(self.scope.samples, F.lit(int(sample)))))
        if name.upper() == "GT":
            return Value(F.transform(chosen, lambda s: s["alleles"]), "num", True, gt=True)
        each = F.transform(chosen, lambda s: s["fmt"][name])
        return Value(F.flatten(each) if at == "*" else F.transform(each, lambda x: F.get(x, F.lit(int(at)))), "str", True)

    def _several(self, n: Node) -> Value:
        """Subscripts of several elements, or of samples by name."""
        if len(n.value) == 1:
            v = self.value(n.args[0])
            if not v.many:
                raise ExpressionError(f"[{n.value[0]}] needs a list")
            picked = self._chosen(n.value[0])
            return Value(F.filter(v.column, lambda x, i: picked(x, i)), v.kind, True, v.gt)
        if self.scope.samples is None:
            raise ExpressionError("a sample subscript needs samples")
        whom, which = self._chosen(n.value[0]), self._chosen(n.value[1])
        name = n.args[0].value.rpartition("/")[2]
        chosen = F.filter(self.scope.samples, lambda s, i: whom(s, i))
        if name.upper() == "GT":
            return Value(F.transform(chosen, lambda s: s["alleles"]), "num", True, gt=True)
        return Value(F.flatten(F.transform(chosen, lambda s: F.filter(s["fmt"][name], lambda x, i: which(x, i)))), "str", True)

    def _unary(self, n: Node) -> Value:
        v = self.value(n.args[0])
        return Value(~truth(v), "bool") if n.value == "!" else Value(-_number(v.column, v.kind), "num")

    def _binary(self, n: Node) -> Value:
        op, (left, right) = n.value, n.args
        if op in "&|":
            a, b = truth(self.value(left)), truth(self.value(right))
            return Value(a & b if op == "&" else a | b, "bool")
        for x, y in ((left, right), (right, left)):
            if y.kind == "str" and op in ("=", "!=") and self._is_gt(x):
                return Value(self._genotype(self.value(x), y.value, op == "!="), "bool")
        a, b = self.value(left), self.value(right)
        if op in ("=", "!="):
            same = _pairs(a, b, lambda x, y: _equal(x, a.kind, y, b.kind))
            if (a.many and right.kind == "str" and right.value == ".") or (b.many and left.kind == "str" and left.value == "."):
                c = a.column if a.many else b.column
                same = same | c.isNull() | F.coalesce(F.size(c) == 0, F.lit(False))
            return Value(same if op == "=" else ~same, "bool")
        if op in ("~", "!~"):
            if right.kind != "str":
                raise ExpressionError("a pattern must be a text")
            hit = _pairs(a, Value(F.lit(""), "str"), lambda x, _: _text(x, a.kind).rlike(right.value))
            return Value(hit if op == "~" else ~hit, "bool")
        if op in ("<", "<=", ">", ">="):
            test = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}[op]
            return Value(_pairs(a, b, lambda x, y: test(_number(x, a.kind), _number(y, b.kind))), "bool")
        x, y = (F.when(F.size(v.column) == 1, _number(F.get(v.column, F.lit(0)), v.kind)) if v.many else _number(v.column, v.kind) for v in (a, b))
        return Value({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y), "%": lambda: F.when(y != 0, x % y)}[op](), "num")

    def _is_gt(self, n: Node) -> bool:
        n = n.args[0] if n.kind == "index" else n
        return n.kind == "name" and n.value.rpartition("/")[2].upper() == "GT"

    def _genotype(self, v: Value, text: str, negate: bool) -> Column:
        def one(a: Column) -> Column:
            if text in _CLASSES:
                return G.is_class(a, text)
            want = [None if x == "." else int(x) for x in re.split(r"[/|]", text)]
            return F.coalesce((F.size(a) == len(want)) & reduce(lambda x, y: x & y, [F.get(a, F.lit(i)).eqNullSafe(F.lit(w)) for i, w in enumerate(want)]), F.lit(False))

        nested = self.scope.samples is not None and self.scope.sample is None
        hit = F.coalesce(F.exists(v.column, one), F.lit(False)) if nested else one(v.column)
        return ~hit if negate else hit

    def _numbers(self, args: tuple) -> Column:
        parts = []
        for n in args:
            parts.append(_number_array(self.value(n)))
        return F.array_compact(F.coalesce(F.concat(*parts) if len(parts) > 1 else parts[0], F.array().cast("array<double>")))

    def _call(self, n: Node) -> Value:
        name, args = n.value, n.args
        name = name.removeprefix("SMPL_")
        name = {"SSUM": "SUM", "SMIN": "MIN", "SMAX": "MAX", "SAVG": "AVG", "SMEAN": "AVG", "MEAN": "AVG", "SMEDIAN": "MEDIAN", "SSTDEV": "STDEV"}.get(name, name)
        if name in ("N_PASS", "F_PASS", "F_MISSING"):
            return self._passing(name, args)
        if name == "COUNT":
            v = self.value(args[0])
            if not v.many:
                return Value(truth(v).cast("int"), "num")
            return Value(F.coalesce(F.size(F.filter(v.column, lambda x: truth(Value(x, v.kind)))), F.lit(0)), "num")
        if name == "STRLEN":
            v = self.value(args[0])
            return Value(F.transform(v.column, F.octet_length) if v.many else F.octet_length(v.column), "num", v.many)
        x = self._numbers(args)
        if name == "SUM":
            return Value(F.aggregate(x, F.lit(0.0), lambda s, v: s + v), "num")
        if name == "AVG":
            return Value(let(x, lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda s, e: s + e) / F.size(v))), "num")
        if name in ("MIN", "MAX"):
            return Value(F.array_min(x) if name == "MIN" else F.array_max(x), "num")
        if name == "MEDIAN":
            middle = lambda s, size: F.when(size > 0, (F.get(s, F.floor((size - 1) / 2).cast("int")) + F.get(s, F.floor(size / 2).cast("int"))) / 2)
            return Value(let(F.array_sort(x), lambda s: middle(s, F.size(s))), "num")
        if name == "STDEV":
            spread = lambda v, mean: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + (e - mean) * (e - mean)) / F.size(v))
            return Value(let(x, lambda v: F.when(F.size(v) < 2, 0.0).otherwise(let(F.aggregate(v, F.lit(0.0), lambda s, e: s + e) / F.size(v), lambda m: spread(v, m)))), "num")
        if name in ("ABS", "PHRED"):
            v = self.value(args[0])
            f = (lambda c: F.abs(_number(c, v.kind))) if name == "ABS" else (lambda c: F.least(-4.3429 * F.ln(_number(c, v.kind)), F.lit(99.0)))
            return Value(F.transform(v.column, f) if v.many else f(v.column), "num", v.many)
        if name == "BINOM":
            return Value(let(x, lambda v: prob.binom_two_sided(F.get(v, F.lit(0)), F.get(v, F.lit(1)))), "num")
        if name == "FISHER":
            at = (0, 1, 2, 3) if len(args) == 1 else (0, 2, 1, 3)  # two pairs go in as (a0, b0, a1, b1)
            return Value(let(x, lambda v: prob.fisher_two_sided(*(F.get(v, F.lit(i)) for i in at))), "num")
        raise ExpressionError(f"unknown function {name}")

    def _passing(self, name: str, args: tuple) -> Value:
        if self.scope.samples is None:
            raise ExpressionError(f"{name} needs samples")

        def test(s: Column) -> Column:
            if name == "F_MISSING":
                return G.any_missing(s["alleles"])
            inner = Scope(self.scope.kinds, self.scope.info, self.scope.samples, s)
            return truth(Compiler(inner, self.files).value(args[0]))

        passed, n = F.size(F.filter(self.scope.samples, test)), F.size(self.scope.samples)
        return Value(passed, "num") if name == "N_PASS" else Value(F.when(n > 0, passed / n).otherwise(0.0), "num")


def _lines_of(path: str) -> list[str]:
    with open(path) as f:
        return [line.strip() for line in f if line.strip()]


def compile_value(text: str, scope: Scope = TYPED, files: Callable[[str], list[str]] | None = None) -> Column:
    return Compiler(scope, files).value(parse(text)).column


def compile_filter(text: str, scope: Scope = TYPED, sample: bool = False, files: Callable[[str], list[str]] | None = None) -> Column:
    """A boolean column that is never null. With ``sample`` rows are a sample's; FMT/X and X are then its columns."""
    return truth(Compiler(scope, files).value(parse(text)))
