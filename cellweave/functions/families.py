"""Exponential families in numpy (M16): density h(x) exp(T(x) . eta(theta) - A(theta)).

Parameters broadcast over rows; `params` holds what is fitted per feature, by maximum
likelihood (Newton's method from the moments) or by moments: Beta's nu = m (1 - m) / v - 1,
Gamma's rate = m / v. Either needs only means of x, x squared and the statistics.
"""

from __future__ import annotations

import numpy as np

from .special import bisect, digamma, lgamma, trigamma


class Family:
    name = ""

    def __init__(self, **params):
        self.params = params

    def statistics(self, x) -> tuple[np.ndarray, ...]:
        return (np.asarray(x, float),)

    def natural(self, theta) -> tuple[np.ndarray, ...]:
        return (np.asarray(theta, float),)

    def partition(self, theta) -> np.ndarray:
        raise NotImplementedError

    def mean(self, theta) -> np.ndarray:
        """Derivative of the log-partition, for families with T(x) = x."""
        raise NotImplementedError

    def log_base(self, x) -> np.ndarray:
        return np.zeros_like(np.asarray(x, float))

    def inverse_link(self, x) -> np.ndarray:
        """The parameter at which the density of x is greatest."""
        raise NotImplementedError

    def gradient(self, x, theta) -> np.ndarray:
        """Derivative of the loss: of the log-partition less that of T(x) . eta."""
        return self.mean(theta) - np.asarray(x, float)

    def fit(self, x, method: str = "mle") -> Family:
        """The parameters of each column of x."""
        x = np.asarray(x, float)
        return self.fit_means(x.mean(axis=0), (x**2).mean(axis=0), [t.mean(axis=0) for t in self.statistics(x)], method)

    def fit_means(self, mean, square, statistics, method: str = "mle") -> Family:
        """The same from the means of x, x squared and the statistics."""
        return self

    def log_density(self, x, theta) -> np.ndarray:
        dot = sum(t * e for t, e in zip(self.statistics(x), self.natural(theta), strict=True))
        return self.log_base(x) + dot - self.partition(theta)

    def density(self, x, theta) -> np.ndarray:
        return np.exp(self.log_density(x, theta))

    def loss(self, x, theta) -> float:
        """Negative log-likelihood without the base measure."""
        dot = sum(t * e for t, e in zip(self.statistics(x), self.natural(theta), strict=True))
        return float(-(dot - self.partition(theta)).sum())


class Gaussian(Family):
    name = "gaussian"

    def partition(self, theta):
        return np.asarray(theta, float) ** 2 / 2

    def mean(self, theta):
        return np.asarray(theta, float)

    def log_base(self, x):
        return -(np.asarray(x, float) ** 2) / 2 - np.log(2 * np.pi) / 2

    def inverse_link(self, x):
        return np.asarray(x, float)


class Bernoulli(Family):
    name = "bernoulli"

    def partition(self, theta):
        return np.logaddexp(0, theta)

    def mean(self, theta):
        return 1 / (1 + np.exp(-np.asarray(theta, float)))

    def inverse_link(self, x):
        """The logit, cut at max_val: at 0 and 1 the same as the ratio form, defined between."""
        top = self.params.get("max_val", 30.0)
        with np.errstate(divide="ignore"):
            x = np.asarray(x, float)
            return np.clip(np.log(x) - np.log1p(-x), -top, top)


class Poisson(Family):
    name = "poisson"

    def partition(self, theta):
        return np.exp(np.asarray(theta, float))

    def mean(self, theta):
        return np.exp(np.asarray(theta, float))

    def log_base(self, x):
        return -lgamma(np.asarray(x, float) + 1)

    def inverse_link(self, x):
        """max(ln x, min_val): 0 and 1 both map to the least value, as in common use."""
        with np.errstate(divide="ignore"):
            return np.maximum(np.log(np.asarray(x, float)), self.params.get("min_val", 1e-20))


class Beta(Family):
    """theta is the mean, nu = a + b is fitted per feature."""

    name = "beta"
    eps = 1e-4

    def _x(self, x):
        return np.clip(np.asarray(x, float), self.eps, 1 - self.eps)

    def _mean(self, theta):
        return np.clip(np.asarray(theta, float), 1e-9, 1 - 1e-9)

    def _slope(self, theta):
        return 1.0

    def gradient(self, x, theta):
        a, b = self.natural(theta)
        u, v = self.statistics(x)
        return self.params.get("nu", 1.0) * (digamma(a) - digamma(b) - u + v) * self._slope(theta)

    def statistics(self, x):
        x = self._x(x)
        return np.log(x), np.log1p(-x)

    def natural(self, theta):
        t, nu = self._mean(theta), self.params.get("nu", 1.0)
        return t * nu, (1 - t) * nu

    def partition(self, theta):
        a, b = self.natural(theta)
        return lgamma(a) + lgamma(b) - lgamma(a + b)

    def log_base(self, x):
        a, b = self.statistics(x)
        return -a - b

    def fit_means(self, mean, square, statistics, method="mle"):
        m = np.clip(np.asarray(mean, float), self.eps, 1 - self.eps)
        nu = np.maximum(m * (1 - m) / np.maximum(square - np.asarray(mean) ** 2, 1e-12) - 1, 1e-3)
        if method == "mle":
            # digamma(a) - digamma(a + b) = mean ln x, and b with ln (1 - x).
            a, b = m * nu, (1 - m) * nu
            for _ in range(100):
                f = digamma(a) - digamma(a + b) - statistics[0], digamma(b) - digamma(a + b) - statistics[1]
                p, q, r = trigamma(a), trigamma(b), trigamma(a + b)
                det = p * q - (p + q) * r
                step = ((q - r) * f[0] + r * f[1]) / det, (r * f[0] + (p - r) * f[1]) / det
                new = np.maximum(a - step[0], a / 4), np.maximum(b - step[1], b / 4)
                done = max(np.abs(new[0] / a - 1).max(initial=0), np.abs(new[1] / b - 1).max(initial=0)) < 1e-10
                a, b = np.minimum(new[0], 1e8), np.minimum(new[1], 1e8)
                if done:
                    break
            nu = a + b
        self.params["nu"] = nu
        return self

    def inverse_link(self, x):
        a, b = self.statistics(x)
        nu = self.params.get("nu", 1.0) * np.ones_like(a)
        return bisect(lambda t: digamma(t * nu) - digamma((1 - t) * nu) - (a - b), np.full_like(a, 1e-9), np.full_like(a, 1 - 1e-9), eps=1e-7)


class SigmoidBeta(Beta):
    """As beta, with theta the logit of the mean."""

    name = "sigmoid_beta"

    def _mean(self, theta):
        return np.clip(1 / (1 + np.exp(-np.asarray(theta, float))), 1e-9, 1 - 1e-9)

    def _slope(self, theta):
        t = self._mean(theta)
        return t * (1 - t)

    def inverse_link(self, x):
        t = super().inverse_link(x)
        return np.log(t) - np.log1p(-t)


class Gamma(Family):
    """Shape theta + 1 and rate nu, which is fitted per feature."""

    name = "gamma"

    def statistics(self, x):
        x = np.asarray(x, float)
        return np.log(np.maximum(x, 1e-300)), x

    def _shape(self, theta):
        return np.maximum(np.asarray(theta, float) + 1, 1e-6)

    def natural(self, theta):
        shape = self._shape(theta)
        return shape - 1, -self.params.get("nu", 1.0) * np.ones_like(shape)

    def partition(self, theta):
        shape = self._shape(theta)
        return lgamma(shape) - shape * np.log(self.params.get("nu", 1.0))

    def gradient(self, x, theta):
        return digamma(self._shape(theta)) - np.log(self.params.get("nu", 1.0)) - self.statistics(x)[0]

    def fit_means(self, mean, square, statistics, method="mle"):
        mean = np.maximum(np.asarray(mean, float), 1e-12)
        nu = mean / np.maximum(square - mean**2, 1e-12)
        if method == "mle":
            # ln k - digamma(k) = s for the shape k; the rate is k / mean.
            s = np.maximum(np.log(mean) - statistics[0], 1e-9)
            k = (3 - s + np.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
            for _ in range(50):
                k = np.maximum(k - (np.log(k) - digamma(k) - s) / (1 / k - trigamma(k)), k / 4)
            nu = k / mean
        self.params["nu"] = nu
        return self

    def inverse_link(self, x):
        target = np.log(np.maximum(np.asarray(x, float) * self.params.get("nu", 1.0), 1e-300))
        return bisect(lambda t: digamma(t + 1) - target, np.full_like(target, 0.0), np.full_like(target, 1e7), eps=1e-6)


class LogNormal(Family):
    """theta is the mean of ln x, nu its standard deviation, fitted per feature."""

    name = "log_normal"

    def _ln(self, x):
        return np.log(np.maximum(np.asarray(x, float), 1e-5))

    def statistics(self, x):
        return self._ln(x), self._ln(x) ** 2

    def natural(self, theta):
        theta, nu = np.asarray(theta, float), self.params.get("nu", 1.0)
        return theta / nu**2, -1 / (2 * nu**2) * np.ones_like(theta)

    def partition(self, theta):
        nu = self.params.get("nu", 1.0)
        return np.asarray(theta, float) ** 2 / (2 * nu**2) + np.log(nu)

    def log_base(self, x):
        return -self._ln(x) - np.log(2 * np.pi) / 2

    def gradient(self, x, theta):
        return (np.asarray(theta, float) - self._ln(x)) / self.params.get("nu", 1.0) ** 2

    def fit_means(self, mean, square, statistics, method="mle"):
        """Moments of ln x are its maximum likelihood."""
        self.params["nu"] = np.sqrt(np.maximum(statistics[1] - np.asarray(statistics[0]) ** 2, 1e-12))
        return self

    def inverse_link(self, x):
        return self._ln(x)


FAMILIES = {f.name: f for f in (Gaussian, Bernoulli, Poisson, Beta, SigmoidBeta, Gamma, LogNormal)} | {"lognormal": LogNormal}
