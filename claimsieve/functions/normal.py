"""Standard normal distribution as SQL text (Spark has no built-in).

The inverse is Wichura's algorithm AS 241 (PPND16, Applied Statistics 37, 1988);
the distribution function is West's double-precision evaluation of Hart's
rational approximation (Wilmott Magazine, 2005). Both stay inside generated code.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from .text import double, with_expressions

# --- fixed values: AS 241 coefficients, constant term first ------------------
CENTRAL_NUM = [
    3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
    4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3,
]
CENTRAL_DEN = [
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3,
]
MIDDLE_NUM = [
    1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
    1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4,
]
MIDDLE_DEN = [
    1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9,
]
TAIL_NUM = [
    6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
    2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7,
]
TAIL_DEN = [
    1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
    7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15,
]

# --- fixed values: Hart/West coefficients, constant term first ---------------
HART_NUM = [
    220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383,
    6.37396220353165, 0.700383064443688, 3.52624965998911e-02,
]
HART_DEN = [
    440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674,
    86.7807322029461, 16.064177579207, 1.75566716318264, 8.83883476483184e-02,
]


def polynomial(x: str, coefficients: list[float]) -> str:
    """Horner form; the constant term comes first."""
    text = double(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        text = f"({text} * {x} + {double(c)})"
    return text


def _quantile(q: str, square: str, root: str) -> str:
    """AS 241 from q = p − 1/2, square = 0.180625 − q² and root = √(−ln min(p, 1−p))."""
    central = f"{q} * {polynomial(square, CENTRAL_NUM)} / {polynomial(square, CENTRAL_DEN)}"
    near, far = f"({root} - {double(1.6)})", f"({root} - {double(5.0)})"
    middle = f"{polynomial(near, MIDDLE_NUM)} / {polynomial(near, MIDDLE_DEN)}"
    tail = f"{polynomial(far, TAIL_NUM)} / {polynomial(far, TAIL_DEN)}"
    outer = f"(CASE WHEN {root} <= {double(5.0)} THEN {middle} ELSE {tail} END)"
    return (
        f"(CASE WHEN abs({q}) <= {double(0.425)} THEN {central} "
        f"WHEN {q} < {double(0.0)} THEN -{outer} ELSE {outer} END)"
    )


def normal_ppf(p: str) -> str:
    """Quantile of the standard normal distribution for 0 < p < 1, as one expression."""
    q = f"(({p}) - {double(0.5)})"
    return _quantile(q, f"({double(0.180625)} - {q} * {q})", f"sqrt(-ln(least(({p}), {double(1.0)} - ({p}))))")


def with_normal_ppf(df: DataFrame, new: dict[str, str]) -> DataFrame:
    """Add quantile columns for SQL probabilities.

    Intermediate values are columns of their own, so they are computed once and the
    generated code stays small.
    """
    steps = [
        {f"_p_{c}": p for c, p in new.items()},
        {f"_q_{c}": f"_p_{c} - {double(0.5)}" for c in new},
        {f"_s_{c}": f"{double(0.180625)} - _q_{c} * _q_{c}" for c in new}
        | {f"_r_{c}": f"sqrt(-ln(least(_p_{c}, {double(1.0)} - _p_{c})))" for c in new},
        {c: _quantile(f"_q_{c}", f"_s_{c}", f"_r_{c}") for c in new},
    ]
    for step in steps:
        df = with_expressions(df, step)
    return df.drop(*[f"_{k}_{c}" for c in new for k in "pqsr"])


def normal_cdf(x: str) -> str:
    """Distribution function of the standard normal distribution."""
    z = f"abs({x})"
    density = f"exp(-{z} * {z} / {double(2.0)})"
    near = f"{density} * {polynomial(z, HART_NUM)} / {polynomial(z, HART_DEN)}"
    fraction = f"({z} + {double(0.65)})"
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = f"({z} + {double(k)} / {fraction})"
    far = f"{density} / {fraction} / {double(math.sqrt(2 * math.pi))}"
    upper = (
        f"(CASE WHEN {z} > {double(37.0)} THEN {double(0.0)} "
        f"WHEN {z} < {double(7.07106781186547)} THEN {near} ELSE {far} END)"
    )
    return f"(CASE WHEN ({x}) > {double(0.0)} THEN {double(1.0)} - {upper} ELSE {upper} END)"
