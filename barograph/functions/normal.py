"""Normal and Student distributions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of Wichura's algorithm AS 241 (PPND16) for the normal quantile, numerators and denominators from the constant on.
CENTRE = (
    (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
)
MIDDLE = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _ratio(table, x: Column) -> Column:
    def poly(cs) -> Column:
        out = F.lit(cs[-1])
        for c in reversed(cs[:-1]):
            out = out * x + c
        return out

    return poly(table[0]) / poly(table[1])


def norm_ppf(p: Column) -> Column:
    """Quantile of the standard normal distribution; -inf at 0 and inf at 1."""
    q = p - 0.5
    r = F.sqrt(-F.ln(F.least(p, 1 - p)))
    tail = F.when(r <= 5, _ratio(MIDDLE, r - 1.6)).otherwise(_ratio(FAR, r - 5.0))
    inside = F.when(F.abs(q) <= 0.425, q * _ratio(CENTRE, 0.180625 - q * q)).otherwise(F.signum(q) * tail)
    return F.when(p == 0, float("-inf")).when(p == 1, float("inf")).otherwise(inside)


def norm_cdf(x: Column) -> Column:
    """Standard normal distribution function: a power series to 4 deviations, a continued fraction beyond."""
    a = F.least(F.abs(x), F.lit(38.0))
    density = F.exp(-a * a / 2) / math.sqrt(2 * math.pi)
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(70)), F.struct(a.alias("term"), a.alias("total")), lambda s, k: F.struct((s["term"] * a * a / (2 * k + 1)).alias("term"), (s["total"] + s["term"] * a * a / (2 * k + 1)).alias("total")))
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), F.lit(0.0), lambda s, k: k / (a + s))
    upper = F.when(a < 4, 0.5 - density * terms["total"]).otherwise(density / (a + fraction))
    return F.when(x < 0, upper).otherwise(1 - upper)


def student_sf(t: Column, df: Column) -> Column:
    """P(T > t) of Student's distribution with a whole number of degrees of freedom, by its finite trigonometric series."""
    theta = F.atan(F.abs(t) / F.sqrt(df))
    c2 = F.cos(theta) * F.cos(theta)
    odd = df % 2 == 1
    n = F.greatest(F.floor((df - F.when(odd, 3).otherwise(2)) / 2).cast("int"), F.lit(0))
    step = lambda s, k: F.struct((s["term"] * c2 * F.when(odd, 2.0 * k / (2 * k + 1)).otherwise((2.0 * k - 1) / (2 * k))).alias("term"), (s["total"] + s["term"] * c2 * F.when(odd, 2.0 * k / (2 * k + 1)).otherwise((2.0 * k - 1) / (2 * k))).alias("total"))
    series = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")), step)["total"]
    inner_odd = 2 / math.pi * (theta + F.when(df > 1, F.sin(theta) * F.cos(theta) * series).otherwise(0.0))
    inner = F.when(odd, inner_odd).otherwise(F.sin(theta) * series)
    half = (1 - inner) / 2
    return F.when(t >= 0, half).otherwise(1 - half)
