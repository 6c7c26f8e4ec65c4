"""Per-line arrays of a sample: subsets, support, padding, cuts, and recurrences over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once: named within a lambda as an expression, it would be for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def kept_numbers(keep: Column) -> Column:
    """1-based numbers of the lines with a mark of 1."""
    return F.filter(F.transform(keep, lambda k, i: F.when(k == 1, i + 1)), lambda x: x.isNotNull())


def subset(values: Column, numbers: Column) -> Column:
    """The values at the 0-based ``numbers``, in their order."""
    return bound(values, lambda v: F.transform(numbers, lambda i: F.get(v, i)))


def keep_floor(keep: Column, original: Column | float, multiplier: float) -> Column:
    """The least keep ratio of a view: that of its source, or its share of kept lines times ``multiplier`` up to .65."""
    ratio = F.aggregate(keep, F.lit(0), lambda s, k: s + k) / F.greatest(F.lit(1), F.size(keep))
    return F.greatest(F.lit(original), F.least(F.lit(0.65), ratio * multiplier))


def support_lines(asked: Column, n: Column, share: float = 0.2) -> Column:
    """The 1-based lines that a labeller may turn into SUPPORT: distinct, in the file, the first ``share`` of all."""
    most = F.greatest(F.lit(1), F.floor(n * F.lit(share) + 1e-9)).cast("int")
    return bound(n, lambda m: F.slice(F.array_sort(F.array_distinct(F.filter(asked, lambda x: x.between(1, m)))), F.lit(1), most))


def apply_support(roles: Column, chosen: Column) -> Column:
    return bound(chosen, lambda c: F.transform(roles, lambda r, i: F.when((r != "CORE") & F.array_contains(c, i + 1), "SUPPORT").otherwise(r)))


def padded(values: Column, size: int, fill) -> Column:
    """``values`` cut or filled up to ``size``."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(fill), size)), 1, size)


def packed(values: Column, mask: Column) -> Column:
    """The values whose mask is set, close together."""
    pair = F.zip_with(values, mask, lambda v, m: F.struct(v.alias("v"), m.alias("m")))
    return F.transform(F.filter(pair, lambda x: x["m"]), lambda x: x["v"])


def without_blank_end(lines: Column, strip: bool = False) -> Column:
    """Lines up to the last that isn't empty (with ``strip``: that isn't white space)."""
    full = lambda x: F.trim(x) != "" if strip else x != ""
    last = F.aggregate(F.transform(lines, lambda x, i: F.when(full(x), i + 1).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
    return F.slice(lines, F.lit(1), last)


def line_at(lengths: Column, offset: Column) -> Column:
    """The 0-based line that holds a character offset, every line ending with one further character."""
    step = lambda at: lambda s, n: F.struct((s["end"] + n + 1).alias("end"), (s["line"] + (s["end"] + n + 1 <= at).cast("int")).alias("line"))
    line = bound(offset, lambda at: F.aggregate(lengths, F.struct(F.lit(0).alias("end"), F.lit(0).alias("line")), step(at))["line"])
    return F.greatest(F.lit(0), F.least(line, F.size(lengths) - 1))


def _both(s: Column, to: int, w: list[list[float]]) -> tuple[Column, Column]:
    return s["a"] + w[to][0], s["b"] + w[to][1]


def crf_normalizer(emissions: Column, start: list[float], trans: list[list[float]], end: list[float]) -> Column:
    """Log of the summed scores of all taggings of a two-tag chain; ``emissions``: struct(a, b) by place; ``trans`` is
    by [to][from]. One pass with two running sums. Null for no places."""
    def lse(x: Column, y: Column) -> Column:
        top = F.greatest(x, y)
        return top + F.log(F.exp(x - top) + F.exp(y - top))

    first = F.struct((F.get(emissions, F.lit(0))["a"] + start[0]).alias("a"), (F.get(emissions, F.lit(0))["b"] + start[1]).alias("b"))
    step = lambda s, e: F.struct((lse(*_both(s, 0, trans)) + e["a"]).alias("a"), (lse(*_both(s, 1, trans)) + e["b"]).alias("b"))
    last = F.aggregate(F.slice(emissions, F.lit(2), F.size(emissions)), first, step)
    return F.when(F.size(emissions) > 0, lse(last["a"] + end[0], last["b"] + end[1]))


def crf_decode(emissions: Column, start: list[float], trans: list[list[float]], end: list[float]) -> Column:
    """(score, tags) of the best tagging; the earlier tag wins a tie. One pass keeps the two best scores and where each
    came from, another goes back."""
    first = F.struct((F.get(emissions, F.lit(0))["a"] + start[0]).alias("a"), (F.get(emissions, F.lit(0))["b"] + start[1]).alias("b"), F.lit("").alias("back"))

    def step(s: Column, e: Column) -> Column:
        (a0, a1), (b0, b1) = _both(s, 0, trans), _both(s, 1, trans)
        came = F.when(a1 > a0, F.when(b1 > b0, "3").otherwise("1")).otherwise(F.when(b1 > b0, "2").otherwise("0"))
        return F.struct((F.greatest(a0, a1) + e["a"]).alias("a"), (F.greatest(b0, b1) + e["b"]).alias("b"), F.concat(s["back"], came).alias("back"))

    last = F.aggregate(F.slice(emissions, F.lit(2), F.size(emissions)), first, step)
    xa, xb = last["a"] + end[0], last["b"] + end[1]
    go = lambda s, c: F.concat(F.when(F.substring(s, 1, 1) == "0", F.when(c.isin("1", "3"), "1").otherwise("0")).otherwise(F.when(c.isin("2", "3"), "1").otherwise("0")), s)
    tags = F.aggregate(F.reverse(F.filter(F.split(last["back"], ""), lambda c: c != "")), F.when(xb > xa, "1").otherwise("0"), go)
    return F.when(F.size(emissions) > 0, F.struct(F.greatest(xa, xb).alias("score"), tags.alias("tags")))


def crf_score(emissions: Column, tags: Column, start: list[float], trans: list[list[float]], end: list[float]) -> Column:
    """The score of given tags (0 or 1 by place) of a two-tag chain; its loss is the normalizer less this. Null for no
    places or tags of another number."""
    pick = lambda t, a, b: F.when(t == 1, F.lit(b)).otherwise(F.lit(a))
    own = F.zip_with(emissions, tags, lambda e, t: F.when(t == 1, e["b"]).otherwise(e["a"]))
    step = F.zip_with(F.slice(tags, F.lit(1), F.size(tags) - 1), F.slice(tags, F.lit(2), F.size(tags)), lambda was, t: F.when(t == 1, pick(was, *trans[1])).otherwise(pick(was, *trans[0])))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    ends = pick(F.get(tags, F.lit(0)), *start) + pick(F.element_at(tags, -1), *end)
    return F.when((F.size(emissions) > 0) & (F.size(emissions) == F.size(tags)), ends + total(own) + total(step))


def log_chance(yes: Column, no: Column) -> Column:
    """Log of the share of ``yes`` in a softmax of the two."""
    return -F.log1p(F.exp(no - yes))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
