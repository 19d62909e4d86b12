"""The projection template language, compiled to a string column.

``%CHROM %POS %ID %REF %ALT %QUAL %FILTER %END %TYPE %N_ALT %N_SAMPLES``, ``%INFO/X`` and ``%X``, ``%X{i}`` for the i-th element, escapes and ``%%``; ``[ ... ]`` is
repeated for each sample, where ``%SAMPLE %GT %TGT`` and tags of the sample hold; ``%SUM(X) %AVG(X) %MIN(X) %MAX(X) %SMPL_COUNT(X)`` take values over samples, within a loop of the
sample alone; ``%N_PASS(EXPR)`` counts samples; ``%PBINOM(X)`` within a loop scores how unevenly a call's two alleles share X.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import expression as E
from siteloom.functions import genotypes as G
from siteloom.functions import prob
from siteloom.functions import variants as V
from siteloom.functions.lets import let, number

_TOKEN = re.compile(r"%%|%(?P<call>[A-Z_]+)\((?P<arg>(?:[^()]|\([^()]*\))*)\)|%(?P<ns>INFO/|FORMAT/|FMT/|/)?(?P<tag>[A-Za-z_][\w.]*)(?:\{(?P<at>\d+)\})?|\\(?P<esc>[ntr\\])")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\"}
_dot = lambda c: let(c, lambda x: F.when((x == "") | x.isNull(), ".").otherwise(x))


class TemplateError(ValueError):
    pass


def number_text(x: Column) -> Column:
    """A number as text: whole ones without a point."""
    return let(x, lambda v: F.when(v == F.floor(v), v.cast("decimal(20,0)").cast("string")).otherwise(v.cast("string")))


def _core(tag: str, df: DataFrame) -> Column | None:
    c = {
        "CHROM": lambda: F.col("chrom"), "POS": lambda: F.col("pos").cast("string"), "ID": lambda: F.col("id"), "REF": lambda: F.col("ref"),
        "ALT": lambda: F.array_join("alts", ","), "QUAL": lambda: number_text(F.col("qual")), "FILTER": lambda: F.array_join("filters", ";"),
        "N_ALT": lambda: F.size("alts").cast("string"), "TYPE": lambda: V.class_label(V.variant_class(F.col("ref"), F.col("alts"))),
        "END": lambda: V.end(F.col("pos"), F.col("ref"), F.col("end") if "end" in df.columns else F.lit(None)).cast("string"),
        "N_SAMPLES": lambda: (F.size("samples") if "samples" in df.columns else F.lit(0)).cast("string"),
    }.get(tag)
    return c() if c else None


def _text(c: Column, kind: object, at: str | None) -> Column:
    """A field as text; of an array all elements, or the one ``at``."""
    name = kind.typeName()
    if name == "array":
        inner = kind.elementType.typeName()
        one = (lambda x: number_text(x)) if inner in ("double", "float") else (lambda x: x.cast("string"))
        if at:
            return one(F.get(c, F.lit(int(at))))
        return F.array_join(F.transform(c, lambda x: F.coalesce(one(x), F.lit("."))), ",")
    if at:
        return number_text(c.cast("double")) if at == "0" and name in ("double", "float") else c.cast("string") if at == "0" else F.lit(None).cast("string")
    return number_text(c) if name in ("double", "float") else c.cast("string")


def _tag(name: str, at: str | None, df: DataFrame, sample: Column | None, record: bool) -> Column:
    if sample is not None and not record:
        kinds = {f.name: f.dataType for f in df.schema["samples"].dataType.elementType.fields}
        if name == "SAMPLE":
            return sample["sample"]
        if name == "GT" and "alleles" in kinds:
            return G.render(sample["alleles"], sample["phased"])
        if name == "TGT":
            return G.translate(sample["alleles"], sample["phased"], F.col("ref"), F.col("alts"))
        if name.lower() in kinds:
            return _text(sample[name.lower()], kinds[name.lower()], at)
        if "fmt" in kinds:
            raw = sample["fmt"][name]
            value = F.get(raw, F.lit(int(at))) if at else F.array_join(raw, ",")
            return F.coalesce(value, F.array_join(F.col("info")[name], ",")) if "info" in df.columns and not at else value
    if not record or name.lower() not in df.columns:
        if at and name in ("ALT", "FILTER"):
            return F.get("alts" if name == "ALT" else "filters", F.lit(int(at)))
        core = _core(name, df)
        if core is not None:
            return core
    if "info" in df.columns:
        values = F.col("info")[name]
        return F.get(values, F.lit(int(at))) if at else F.array_join(values, ",")
    if name.lower() in df.columns:
        return _text(F.col(name.lower()), df.schema[name.lower()].dataType, at)
    return F.lit(None).cast("string")


def _skewed_reads(sample: Column, values: Column) -> Column:
    """Phred-scaled P that a diploid call's two alleles have equal shares of ``values``: 0 for equal counts, 99 at most, missing without reads or a call."""
    count = lambda i: number(F.get(values, F.get(sample["alleles"], F.lit(i))), "int")

    def score(p: Column) -> Column:
        return F.when(p >= 1, 0.0).when(p <= 0, 99.0).otherwise(-prob.PHRED * F.ln(p))

    def of(reads: Column) -> Column:
        a, b = reads["a"], reads["b"]
        text = let(let(prob.binom_two_sided(a, b), score), lambda x: significant(x))
        return F.when(a.isNotNull() & b.isNotNull() & (a + b > 0), text)

    return F.when(F.size(sample["alleles"]) == 2, let(F.struct(count(0).alias("a"), count(1).alias("b")), of))


def significant(x: Column, digits: int = 6) -> Column:
    """A number as text to so many significant digits, without trailing zeros."""
    before = F.when(F.abs(x) >= 1, F.floor(F.log10(F.abs(x))).cast("int") + 1).otherwise(0)
    places = F.greatest(digits - before, F.lit(0))

    def shown(p: Column) -> Column:
        text = F.lit(None).cast("string")
        for n in range(digits + 1):
            text = F.when(p == n, F.format_string(f"%.{n}f", x)).otherwise(text)
        return text

    text = let(let(places, shown), lambda t: F.when(t.contains("."), F.rtrim(F.rtrim(t, F.lit("0")), F.lit("."))).otherwise(t))
    return F.when(x == F.floor(x), x.cast("decimal(20,0)").cast("string")).otherwise(text)


def _called(name: str, arg: str, df: DataFrame, scope: E.Scope, sample: Column | None) -> Column:
    arg = arg.strip()
    if name in ("N_PASS", "F_PASS", "COUNT"):
        return number_text(E.compile_value(f"{name}({arg})", scope))
    arg = arg.lstrip("%")
    inside = E.Scope(scope.kinds, scope.info, scope.samples, sample) if sample is not None and scope.info is not None else scope
    values = E.Compiler(inside).value(E.parse(arg))
    if name == "PBINOM":
        return F.lit(None).cast("string") if sample is None else _skewed_reads(sample, values.column)
    if name == "SMPL_COUNT":
        known = lambda x: x.isNotNull() & (x.cast("string") != ".") & (x.cast("string") != "")
        n = F.size(F.filter(values.column, known)) if values.many else known(values.column).cast("int")
        return F.coalesce(n, F.lit(0)).cast("string")
    return number_text(E.compile_value(f"{'AVG' if name == 'MEAN' else name}({arg})", inside))


def _pieces(text: str) -> list[tuple[bool, str]]:
    """(in a sample loop, piece) in order. Brackets within a token, such as a subscript in a call, are the token's."""
    out, at, loop, held = [], 0, False, ""
    while at < len(text):
        m = _TOKEN.match(text, at)
        step = m[0] if m else text[at]
        if not m and step in "[]":
            if (step == "[") == loop:
                raise TemplateError(f"unbalanced [ ] in {text!r}")
            out.append((loop, held))
            loop, held = not loop, ""
        else:
            held += step
        at += len(step)
    if loop:
        raise TemplateError(f"unbalanced [ ] in {text!r}")
    return [x for x in [*out, (loop, held)] if x[1]]


def compile_template(text: str, df: DataFrame, scope: E.Scope | None = None) -> Column:
    scope = scope or (E.vcf_scope() if "info" in df.columns else E.TYPED)

    def part(text: str, sample: Column | None) -> Column:
        out, at = [], 0
        for m in _TOKEN.finditer(text):
            if m.start() > at:
                out.append(F.lit(text[at : m.start()]))
            at = m.end()
            if m["esc"]:
                out.append(F.lit(_ESCAPES[m["esc"]]))
            elif m[0] == "%%":
                out.append(F.lit("%"))
            elif m["call"]:
                out.append(_dot(_called(m["call"], m["arg"], df, scope, sample)))
            else:
                out.append(_dot(_tag(m["tag"], m["at"], df, sample, m["ns"] in ("INFO/", "/"))))
        if at < len(text):
            out.append(F.lit(text[at:]))
        return F.concat(*out) if out else F.lit("")

    def each_sample(piece: str) -> Column:
        return F.array_join(F.transform("samples", lambda s: part(piece, s)), "")

    made = [each_sample(piece) if loop else part(piece, None) for loop, piece in _pieces(text)]
    return F.concat(*made) if made else F.lit("")


def render_sites(sites: DataFrame, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``line``: the template rendered for each site."""
    return sites.select(*keep, compile_template(text, sites).alias("line"))


def header_row(text: str, samples: list[str] = (), numbered: bool = True) -> str:
    """The line of column names of a template, ``#[1]CHROM ...``; sample loops are written out for each sample."""
    n = 0

    def name(m: re.Match, sample: str | None) -> str:
        nonlocal n
        if m["esc"]:
            return _ESCAPES[m["esc"]]
        if m[0] == "%%":
            return "%"
        n += 1
        what = m["tag"] or f"{m['call']}({m['arg']})"
        return (f"[{n}]" if numbered else "") + (f"{sample}:{what}" if sample else what)

    out = []
    for loop, piece in _pieces(text):
        for s in samples if loop else [None]:
            out.append(_TOKEN.sub(lambda m, s=s: name(m, s), piece))
    return "#" + "".join(out)
