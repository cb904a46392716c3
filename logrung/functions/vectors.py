"""Row-local vector arithmetic: softmax, pooling and loss terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Floors and the default exponent of the noise-tolerant loss.
PROBABILITY_FLOOR = 1e-8
COUNT_FLOOR = 1e-9
GCE_Q = 0.7


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits, shifted by its maximum."""
    wide = F.transform(logits, lambda x: x.cast("double"))
    powers = F.transform(wide, lambda x: F.exp(x - F.array_max(wide)))
    return F.transform(
        powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x)
    )


def argmax(values: Column) -> Column:
    """0-based place of the first largest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def mean_pool(vectors: Column, mask: Column, width: int) -> Column:
    """Mean of the vectors whose mask is 1; the count is floored, not zero."""
    kept = F.zip_with(vectors, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m))
    zero = F.array_repeat(F.lit(0.0), width)
    total = F.aggregate(kept, zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
    count = F.aggregate(mask, F.lit(0.0), lambda acc, m: acc + m)
    return F.transform(total, lambda x: x / F.greatest(count, F.lit(COUNT_FLOOR)))


def gce_loss(p: Column, q: float = GCE_Q) -> Column:
    """Generalised cross entropy (1 - p**q) / q of the target probability."""
    if not 0.0 < q <= 1.0:
        raise ValueError("q must lie in (0, 1]")
    return (F.lit(1.0) - F.pow(F.greatest(p, F.lit(PROBABILITY_FLOOR)), F.lit(q))) / F.lit(q)


def wce_loss(p: Column, weight: Column) -> Column:
    """Class-weighted cross entropy -w ln p of the target probability."""
    return -weight * F.log(p)


def label_probability(probabilities: Column, label: Column) -> Column:
    """The probability given to the row's own class."""
    return F.element_at(probabilities, label.cast("int") + 1)
