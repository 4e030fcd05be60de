"""Array Column expressions for scores: softmax, argmax, confidence maps, pad/cut, masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body`` as a lambda variable.

    An outer expression used inside a higher-order function's lambda is evaluated again for every
    array element; binding it first keeps per-row work linear in the array length.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def softmax(z: Column | str) -> Column:
    """Numerically stable softmax of a numeric array (as doubles); linear in the array length."""
    zc = F.transform(_col(z), lambda x: x.cast("double"))

    def with_max(a: Column) -> Column:
        return let(F.array_max(a), lambda m: let(F.transform(a, lambda x: F.exp(x - m)), normalise))

    def normalise(e: Column) -> Column:
        return let(F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x), lambda s: F.transform(e, lambda x: x / s))

    return let(zc, with_max)


def argmax(p: Column | str) -> Column:
    """0-based index of the largest value; ties go to the lowest index."""
    pc = _col(p)
    return (F.array_position(pc, F.array_max(pc)) - 1).cast("int")


def argmin(p: Column | str) -> Column:
    pc = _col(p)
    return (F.array_position(pc, F.array_min(pc)) - 1).cast("int")


def confidence_map(labels: list[str] | Column, probs: Column | str) -> Column:
    """``map<label, probability>`` in class-id order."""
    lab = F.array(*[F.lit(x) for x in labels]) if isinstance(labels, list) else labels
    return F.map_from_arrays(lab, _col(probs))


def label_of(labels: list[str], idx: Column | str) -> Column:
    """Class name of a 0-based class id (``element_at`` on a literal array)."""
    return F.element_at(F.array(*[F.lit(x) for x in labels]), _col(idx) + 1)


def pad_truncate(ids: Column | str, length: int, pad: int = 0) -> Column:
    """Cut to ``length`` items, then pad with ``pad`` up to ``length``."""
    a = _col(ids)
    cut = F.slice(a, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(length) - F.size(cut))))


def attention_mask(ids: Column | str, length: int) -> Column:
    """1 for real positions, 0 for padding, over ``length`` positions."""
    return let(F.size(_col(ids)), lambda n: F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: (i <= n).cast("int")))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)),
                       F.lit(0.0), lambda s, x: s + x)
