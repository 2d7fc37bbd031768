"""Small column expressions with the null and rounding rules that the operators share."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12
DAYS_PER_MONTH = 30.4375


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rounded(x: str | Column, digits: int = 6) -> Column:
    """Half-up rounding by plain arithmetic, the same in any engine with IEEE doubles."""
    scale = float(10**digits)
    return F.floor(col(x).cast("double") * scale + 0.5).cast("double") / scale


def divided(a: str | Column, b: str | Column) -> Column:
    """a / b, null where |b| is (almost) zero."""
    return F.when(F.abs(col(b)) > TINY, col(a) / col(b))


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson's r over the rows that have both, an aggregate; null (not an error) where either has no spread."""
    a, b = col(x).cast("double"), col(y).cast("double")
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread > 0, F.covar_pop(a, b) / spread)


def clipped_between(x: str | Column, low, high) -> Column:
    """greatest and least skip nulls, so a null is kept by hand."""
    return F.when(col(x).isNotNull(), F.least(F.greatest(col(x), F.lit(low)), F.lit(high)))


def logistic(x: str | Column) -> Column:
    return 1.0 / (1.0 + F.exp(-col(x)))


def logit(p: str | Column, floor: float = 1e-6) -> Column:
    held = clipped_between(p, floor, 1 - floor)
    return F.log(held / (1 - held))


def category(x: str | Column) -> Column:
    return F.coalesce(col(x).cast("string"), F.lit("Missing"))


def month(x: str | Column) -> Column:
    return F.date_format(col(x), "yyyy-MM")


def strip(x: str | Column) -> Column:
    """Trim all white space at both ends (trim() strips spaces only)."""
    return F.regexp_replace(col(x), r"^\s+|\s+$", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Cody's rational approximations, numerators and denominators from the highest power down: of (cdf - 1/2) / z in z^2, of the
#: upper tail over exp(-z^2 / 2) in |z|, and of that ratio's departure from its asymptote in 1 / z^2.
CENTRE = (0.065682337918207449113, 2.2352520354606839287, 161.02823106855587881, 1067.6894854603709582, 18154.981253343561249), (1.0, 47.20258190468824187, 976.09855173777669322, 10260.932208618978205, 45507.789335026729956)
SIDE = (
    (1.0765576773720192317e-8, 0.39894151208813466764, 8.8831497943883759412, 93.506656132177855979, 597.27027639480026226, 2494.5375852903726711, 6848.1904505362823326, 11602.651437647350124, 9842.7148383839780218),
    (1.0, 22.266688044328115691, 235.38790178262499861, 1519.377599407554805, 6485.558298266760755, 18615.571640885098091, 34900.952721145977266, 38912.003286093271411, 19685.429676859990727),
)
FAR = (0.02307344176494017303, 0.21589853405795699, 0.1274011611602473639, 0.022235277870649807, 0.001421619193227893466, 2.9112874951168792e-5), (1.0, 1.28426009614491121, 0.468238212480865118, 0.0659881378689285515, 0.00378239633202758244, 7.29751555083966205e-5)


def _ratio(terms: tuple[tuple[float, ...], tuple[float, ...]], x):
    above, below = (reduce(lambda held, c: held * x + c, rest, first) for first, *rest in terms)
    return above / below


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution function (error below 1e-15), plain arithmetic that names z often: best a column."""
    size, square = F.abs(z), z * z
    inverse = 1 / square
    fall = F.exp(-square / 2)
    upper = fall * F.when(size <= 5.656854249492381, _ratio(SIDE, size)).otherwise((0.3989422804014327 - inverse * _ratio(FAR, inverse)) / size)
    return F.when(size <= 0.67448975, 0.5 + z * _ratio(CENTRE, square)).when(z > 0, 1 - upper).otherwise(upper)


def normal_cdf_array(z: np.ndarray) -> np.ndarray:
    """The same of a batch of numbers."""
    size, square = np.abs(z), z * z
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        inverse = 1 / square
        tail = np.where(size <= 5.656854249492381, _ratio(SIDE, np.minimum(size, 6.0)), (0.3989422804014327 - inverse * _ratio(FAR, inverse)) / size)
    upper = np.exp(-square / 2) * tail
    return np.where(size <= 0.67448975, 0.5 + z * _ratio(CENTRE, np.minimum(square, 1.0)), np.where(z > 0, 1 - upper, upper))
