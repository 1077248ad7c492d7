"""Number expressions. A missing number is NULL, never NaN."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire import fixed_values as fv


def number(value: Column) -> Column:
    """Double, or null where the value is no number."""
    cast = value.try_cast("double")
    return F.when(~F.isnan(cast), cast)


def safe_ln(value: Column) -> Column:
    return F.ln(F.when(value > 0, value))


def positive_part(value: Column) -> Column:
    return F.when(value > 0, value)


def negative_part(value: Column) -> Column:
    return F.when(value < 0, F.abs(value))


def entropy(counts: Sequence[Column]) -> Column:
    """Minus the sum of p ln(p + 1e-10) over the shares; 0 where all counts are 0."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in counts])

    def term(count: Column) -> Column:
        p = F.try_divide(count, total)
        return F.coalesce(p * F.ln(p + F.lit(1e-10)), F.lit(0.0))

    return -reduce(lambda a, b: a + b, [term(c) for c in counts])


def all_present(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])


def below(value: Column, limit: Column) -> Column:
    """1 where value < limit, else 0; a missing side counts as not below."""
    return F.coalesce((value < limit).cast("int"), F.lit(0))


def binary_label(prob: Column, cut: float = fv.LABEL_CUT) -> Column:
    return (prob >= cut).cast("int")


def label_name(label: Column) -> Column:
    return F.when(label == 1, fv.LABEL_YES).when(label == 0, fv.LABEL_NO)


def label_value(name: Column) -> Column:
    return F.when(name == fv.LABEL_YES, 1).when(name == fv.LABEL_NO, 0)


def is_sure(prob: Column) -> Column:
    return (prob >= fv.SURE_YES) | (prob <= fv.SURE_NO)


def sigmoid(value: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-value))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once and use it in ``body``.

    A lambda computes outer expressions again for every element; its own argument
    is computed once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(scores: Column) -> Column:
    """Shares of exp(score), shifted by the largest score against overflow."""

    def shares(powers: Column) -> Column:
        total = F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x)
        return _let(total, lambda t: F.transform(powers, lambda x: x / t))

    return _let(F.array_max(scores), lambda top: _let(F.transform(scores, lambda x: F.exp(x - top)), shares))


def argmax(scores: Column) -> Column:
    """Position of the largest score from 0, the first on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
