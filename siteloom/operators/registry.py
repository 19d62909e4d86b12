"""Operators by name, so that a pipeline can be given as text: ``name key=value ...`` steps joined by ``|``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Operator = Callable[..., DataFrame]
_OPERATORS: dict[str, Operator] = {}


class UnknownOperator(KeyError):
    pass


def operator(name: str) -> Callable[[Operator], Operator]:
    """Registers ``f(df, **options) -> DataFrame``."""

    def add(f: Operator) -> Operator:
        if name in _OPERATORS:
            raise ValueError(f"operator {name} is registered already")
        _OPERATORS[name] = f
        return f

    return add


def names() -> list[str]:
    return sorted(_OPERATORS)


def apply(df: DataFrame, steps: str) -> DataFrame:
    """Applies registered operators one after another: ``filter expr='QUAL>20' | sort | head n=10``."""
    import shlex

    for step in steps.split("|") if "'" not in steps and '"' not in steps else _split(steps):
        name, *options = shlex.split(step)
        if name not in _OPERATORS:
            raise UnknownOperator(name)
        df = _OPERATORS[name](df, **dict(o.split("=", 1) for o in options))
    return df


def _split(steps: str) -> list[str]:
    out, quote = [""], ""
    for c in steps:
        if c == "|" and not quote:
            out.append("")
            continue
        if c in "'\"" and quote in ("", c):
            quote = "" if quote else c
        out[-1] += c
    return out


def _register_defaults() -> None:
    from siteloom.functions.expression import TYPED, compile_filter, vcf_scope
    from siteloom.functions.template import render_sites
    from siteloom.operators import filters, joins, rewrite, windows

    scope = lambda df: vcf_scope() if "info" in df.columns else TYPED
    operator("filter")(lambda df, expr: df.where(compile_filter(expr, scope(df))))
    operator("exclude")(lambda df, expr: df.where(~compile_filter(expr, scope(df))))
    operator("soft-filter")(lambda df, expr, name, mode="": filters.soft_filter(df, compile_filter(expr, scope(df)), name, mode))
    operator("query")(lambda df, format: render_sites(df, format))
    operator("types")(lambda df, of: filters.of_types(df, *of.split(",")))
    operator("head")(lambda df, n="10": df.limit(int(n)))
    operator("sort")(lambda df: joins.sort_sites(df))
    operator("split-multiallelic")(lambda df: rewrite.split_multiallelic(df))
    operator("trim-symbolic")(lambda df, always="0": rewrite.trim_symbolic(df, always == "1"))
    operator("remove")(lambda df, what, keep="0": rewrite.remove_annotations(df, *what.split(","), keep=keep == "1"))
    operator("snp-gap")(lambda df, gap, types="indel": filters.snp_gap(df, int(gap), tuple(types.split(","))))
    operator("indel-gap")(lambda df, gap: filters.indel_gap(df, int(gap)))
    operator("variant-distance")(lambda df: windows.variant_distance(df))
    operator("cluster-size")(lambda df, width: windows.cluster_size(df, int(width)))
    operator("scatter")(lambda df, size: windows.scatter(df, int(size)))


_register_defaults()
