"""Regressions of several variables. Cross products are sums of one scan, so any number of rows gives a small matrix, which the driver solves; a
second scan, where errors need residuals, is sums as well. Rows with a null or non-finite value are left out; variables that depend linearly on others are refused."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.named import named
from ..sources.tables import table

CONST = "const"


@dataclass
class Fit:
    """Coefficients of names with their covariance."""

    names: list[str]
    beta: np.ndarray
    cov: np.ndarray
    n: int
    r2: float = float("nan")

    def table(self, spark) -> DataFrame:
        """(term, estimate, error, z, p, stars): normal tails, as is usual with robust errors."""
        rows = []
        for name, b, s in zip(self.names, self.beta, np.sqrt(np.diag(self.cov)), strict=True):
            z = b / s if s > 0 else math.copysign(math.inf, b) if b else 0.0
            p = math.erfc(abs(z) / math.sqrt(2))
            rows.append((name, float(b), float(s), float(z), p, "***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else ""))
        return spark.createDataFrame(rows, "term string, estimate double, error double, z double, p double, stars string")

    def adjusted(self) -> float:
        return 1 - (1 - self.r2) * (self.n - 1) / (self.n - len(self.beta))

    def wald(self) -> tuple[float, float]:
        """F of all slopes being zero by this covariance, and its tail."""
        at = [i for i, x in enumerate(self.names) if x != CONST]
        f = float(self.beta[at] @ np.linalg.solve(self.cov[np.ix_(at, at)], self.beta[at])) / len(at)
        return f, f_tail(f, len(at), self.n - len(self.beta))


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f), by integrating the beta density of F's ratio after a change of variable that is smooth at both ends."""
    if f <= 0:
        return 1.0
    cut = d2 / (d2 + d1 * f)  # the tail is the beta distribution (d2/2, d1/2) below this
    a, b = d2 / 2, d1 / 2
    t = (np.arange(20_000) + 0.5) / 20_000
    angle = t * math.asin(math.sqrt(cut))
    log = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + (2 * a - 1) * np.log(np.sin(angle)) + (2 * b - 1) * np.log(np.cos(angle))
    return float(min(1.0, 2 * math.asin(math.sqrt(cut)) * np.exp(log).mean()))


def whole(df: DataFrame, values: dict[str, Column], *more: Column) -> DataFrame:
    """The values as doubles, rows without all of them left out."""
    rows = df.select(*[v.cast("double").alias(k) for k, v in values.items()], *more)
    for k in values:
        rows = rows.where(F.col(k).isNotNull() & ~F.isnan(k) & (F.abs(k) < float("inf")))
    return rows


def product_sums(rows: DataFrame, names: list[str], weight: Column | None = None) -> np.ndarray:
    """The matrix of sums of (weighted) products of columns."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    w = F.lit(1.0) if weight is None else weight
    got = rows.agg(*[F.coalesce(F.sum(w * F.col(names[i]) * F.col(names[j])), F.lit(0.0)).alias(f"s{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((len(names), len(names)))
    for (i, j), v in zip(pairs, got, strict=True):
        out[i, j] = out[j, i] = v
    return out


def inverse(a: np.ndarray) -> np.ndarray:
    scale = 1 / np.sqrt(np.maximum(np.diag(a), 1e-300))
    scaled = a * scale[:, None] * scale
    if not np.isfinite(scaled).all() or np.linalg.cond(scaled) > 1e13:
        raise ValueError("the variables depend linearly on each other, or there are too few rows")
    return np.linalg.inv(scaled) * scale[:, None] * scale


def dot(names: list[str], beta: np.ndarray) -> Column:
    out = F.lit(0.0)
    for name, b in zip(names, beta, strict=True):
        out = out + F.lit(float(b)) * F.col(name)
    return out


def _centred(rows: DataFrame, names: list[str]) -> tuple[DataFrame, np.ndarray, int]:
    """rows with columns less their means, the means, and the number of rows: products of what is left keep their digits."""
    got = rows.agg(F.count("*"), *[F.avg(c) for c in names]).first()
    if not got[0]:
        raise ValueError("no whole rows")
    mean = np.array(got[1:], float)
    return rows.select(*[(F.col(c) - F.lit(float(m))).alias(c) for c, m in zip(names, mean, strict=True)], *[c for c in rows.columns if c not in names]), mean, got[0]


def ols(df: DataFrame, y: Column, x: dict[str, Column], errors: str = "hc3", cluster: Column | None = None) -> Fit:
    """Least squares with a constant. errors: classic, hc3 (residuals by their leverage) or cluster (sums within groups, which are an aggregate by the group).

    The slopes are those of centred variables; the constant and its covariance follow from them."""
    names = list(x)
    rows, mean, n = _centred(whole(df, {"__y": y, **x}, *([cluster.alias("__g")] if cluster is not None else [])), ["__y", *names])
    s = product_sums(rows, ["__y", *names])
    inv = inverse(s[1:, 1:])
    beta = inv @ s[1:, 0]
    k, rss = len(names) + 1, s[0, 0] - beta @ s[1:, 0]
    if n <= k:
        raise ValueError("fewer rows than variables")
    # in terms of (1, x - mean) the two blocks do not meet
    left = rows.withColumn("__one", F.lit(1.0)).withColumn("__e", F.col("__y") - dot(names, beta))
    every = ["__one", *names]
    bread = np.zeros((k, k))
    bread[0, 0], bread[1:, 1:] = 1 / n, inv
    if errors == "classic":
        cov = bread * rss / (n - k)
    elif errors == "hc3":
        lever = F.lit(1 / n)
        for i, a in enumerate(names):
            lever = lever + F.col(a) * dot(names, inv[i])
        cov = bread @ product_sums(left, every, (F.col("__e") / (1 - lever)) ** 2) @ bread
    elif errors == "cluster":
        sums = left.groupBy("__g").agg(*[F.sum(F.col("__e") * F.col(c)).alias(c) for c in every])
        groups = sums.count()
        cov = bread @ product_sums(sums, every) @ bread * (groups / (groups - 1)) * ((n - 1) / (n - k))
    else:
        raise ValueError("errors must be classic, hc3 or cluster")
    turn = np.eye(k)
    turn[0, 1:] = -mean[1:]
    beta = turn @ np.concatenate([[mean[0]], beta])
    return Fit([CONST, *names], beta, turn @ cov @ turn.T, n, 1 - rss / s[0, 0] if s[0, 0] > 0 else float("nan"))


def two_stage(df: DataFrame, y: Column, x: dict[str, Column], z: dict[str, Column]) -> Fit:
    """Two-stage least squares with a constant: x are explained by the instruments z, which hold the exogenous ones of x as well. One scan."""
    names, tools = list(x), [f"__z{i}" for i in range(len(z))]
    rows, mean, n = _centred(whole(df, {"__y": y, **x, **dict(zip(tools, z.values(), strict=True))}), ["__y", *names, *tools])
    s = product_sums(rows, ["__y", *names, *tools])
    k = len(names)
    xy, xx, zx, zy = s[1 : k + 1, 0], s[1 : k + 1, 1 : k + 1], s[k + 1 :, 1 : k + 1], s[k + 1 :, 0]
    by = zx.T @ inverse(s[k + 1 :, k + 1 :])
    bread = inverse(by @ zx)
    beta = bread @ by @ zy
    rss = s[0, 0] - 2 * beta @ xy + beta @ xx @ beta
    cov = np.zeros((k + 1, k + 1))
    cov[0, 0], cov[1:, 1:] = 1 / n, bread
    turn = np.eye(k + 1)
    turn[0, 1:] = -mean[1 : k + 1]
    return Fit([CONST, *names], turn @ np.concatenate([[mean[0]], beta]), turn @ cov @ turn.T * rss / (n - k - 1), n, 1 - rss / s[0, 0])


def logit(df: DataFrame, y: Column, x: dict[str, Column], rounds: int = 30, digits: float = 1e-10) -> Fit:
    """Logistic regression with a constant by Newton's method, a scan a round, until no coefficient moves by more than `digits` of its size. y is 0 or 1."""
    names = [CONST, *x]
    rows = whole(df, {"__y": y, CONST: F.lit(1.0), **x})
    beta, n = np.zeros(len(names)), rows.count()
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-dot(names, beta)))
        each = rows.withColumn("__p", p)
        pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
        w = F.col("__p") * (1 - F.col("__p"))
        got = each.agg(*[F.sum((F.col("__y") - F.col("__p")) * F.col(c)) for c in names], *[F.sum(w * F.col(names[i]) * F.col(names[j])) for i, j in pairs]).first()
        slope, h = np.array(got[: len(names)], float), np.zeros((len(names), len(names)))
        for (i, j), v in zip(pairs, got[len(names) :], strict=True):
            h[i, j] = h[j, i] = v
        inv = inverse(h)
        move = inv @ slope
        beta = beta + move
        if (np.abs(move) <= digits * np.maximum(1, np.abs(beta))).all():
            return Fit(names, beta, inv, n)
    raise ValueError(f"no maximum found in {rounds} rounds: the outcome may be told apart without error")


def discontinuity(df: DataFrame, y: Column, running: Column, cut: float, width: float) -> Fit:
    """Sharp regression discontinuity: the jump `above` at the cut, with a slope of its own on either side, over rows within `width`."""
    at = running.cast("double") - F.lit(cut)
    above = (at >= 0).cast("double")
    return ols(df.where(F.abs(at) <= width), y, {"above": above, "slope": at, "slope_above": above * at})


_CENTRED = """m as (select avg(l_extendedprice) as y, avg(l_quantity) as a, avg(l_discount) as b from lineitem), d as (select l.l_extendedprice - m.y as y, l.l_quantity - m.a as a, l.l_discount - m.b as b, l_suppkey as g from lineitem l, m),
    s as (select count(*) as n, sum(a * a) as aa, sum(a * b) as ab, sum(b * b) as bb, sum(a * y) as ay, sum(b * y) as by_, sum(y * y) as yy from d), v as (select *, bb / (aa * bb - ab * ab) as iaa, -ab / (aa * bb - ab * ab) as iab, aa / (aa * bb - ab * ab) as ibb from s),
    f as (select *, iaa * ay + iab * by_ as ba, iab * ay + ibb * by_ as bb_ from v)"""
_ERRORS = """select term, estimate, error from (select unnest([{'term': 'l_quantity', 'estimate': ba, 'error': sqrt(c * (iaa * iaa * maa + 2 * iaa * iab * mab + iab * iab * mbb))}, {'term': 'l_discount', 'estimate': bb_, 'error': sqrt(c * (iab * iab * maa + 2 * iab * ibb * mab + ibb * ibb * mbb))}], recursive := true) from k)"""


def _lineitem(spark, folder):
    return table(spark, folder, "lineitem"), F.col("l_extendedprice"), {c: F.col(c) for c in ("l_quantity", "l_discount")}


@named("stat_regression", f"""with {_CENTRED}, e as (select d.*, (d.y - ba * d.a - bb_ * d.b) / (1 - 1 / n - (d.a * d.a * iaa + 2 * d.a * d.b * iab + d.b * d.b * ibb)) as e from d, f),
    q as (select sum(e * e * a * a) as maa, sum(e * e * a * b) as mab, sum(e * e * b * b) as mbb from e), k as (select *, 1 as c from f, q) {_ERRORS}""")
def stat_regression(spark, folder):
    """Price on quantity and discount with HC3 errors (STA3)."""
    return ols(*_lineitem(spark, folder)).table(spark).where(f"term <> '{CONST}'").select("term", "estimate", "error")


@named("stat_clustered", f"""with {_CENTRED}, e as (select d.*, d.y - ba * d.a - bb_ * d.b as e from d, f), g as (select g, sum(e * a) as ea, sum(e * b) as eb from e group by g),
    q as (select count(*) as gs, sum(ea * ea) as maa, sum(ea * eb) as mab, sum(eb * eb) as mbb from g), k as (select *, gs / (gs - 1) * (n - 1) / (n - 3) as c from f, q) {_ERRORS}""")
def stat_clustered(spark, folder):
    """The same with errors clustered by supplier (STA4)."""
    rows, y, x = _lineitem(spark, folder)
    return ols(rows, y, x, "cluster", F.col("l_suppkey")).table(spark).where(f"term <> '{CONST}'").select("term", "estimate", "error")


_STEP = "b{i} as materialized (select any_value(b0) + (sum(p * (1 - p) * x * x) * sum(y - p) - sum(p * (1 - p) * x) * sum((y - p) * x)) / (sum(p * (1 - p)) * sum(p * (1 - p) * x * x) - sum(p * (1 - p) * x) ** 2) as b0, any_value(b1) + (sum(p * (1 - p)) * sum((y - p) * x) - sum(p * (1 - p) * x) * sum(y - p)) / (sum(p * (1 - p)) * sum(p * (1 - p) * x * x) - sum(p * (1 - p) * x) ** 2) as b1 from (select *, 1 / (1 + exp(-(b0 + b1 * x))) as p from d, b{j}))"


@named("stat_logit", "with d as (select (l_returnflag = 'R')::int as y, l_quantity / 50 as x from lineitem), b0 as (select 0.0::double as b0, 0.0::double as b1), " + ", ".join(_STEP.format(i=i, j=i - 1) for i in range(1, 9))
    + " select unnest(['const', 'quantity']) as term, unnest([round(b0, 7), round(b1, 7)]) as estimate from b8")
def stat_logit(spark, folder):
    """Is a line returned, by its quantity? Logistic regression (STA4)."""
    fit = logit(table(spark, folder, "lineitem"), (F.col("l_returnflag") == "R").cast("int"), {"quantity": F.col("l_quantity") / 50})
    return fit.table(spark).select("term", F.round("estimate", 7).alias("estimate"))


@named("stat_instrumented", """with j as (select l_extendedprice as y, l_quantity as x, p_retailprice as z from lineitem join part on l_partkey = p_partkey), m as (select avg(y) as y, avg(x) as x, avg(z) as z, count(*) as n from j),
    s as (select sum((j.z - m.z) * (j.y - m.y)) as zy, sum((j.z - m.z) * (j.x - m.x)) as zx, sum((j.z - m.z) * (j.z - m.z)) as zz, any_value(m.n) as n, any_value(m.y) as my, any_value(m.x) as mx from j, m),
    r as (select sum((j.y - s.my - zy / zx * (j.x - s.mx)) ** 2) as rss from j, s) select 'l_quantity' as term, zy / zx as estimate, sqrt(rss / (n - 2) * zz) / abs(zx) as error from s, r""")
def stat_instrumented(spark, folder):
    """Price on quantity, with the part's retail price as the instrument, by two stages (STA4)."""
    line, part = table(spark, folder, "lineitem"), table(spark, folder, "part").select("p_partkey", "p_retailprice")
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    fit = two_stage(rows, F.col("l_extendedprice"), {"l_quantity": F.col("l_quantity")}, {"z": F.col("p_retailprice")})
    return fit.table(spark).where(f"term <> '{CONST}'").select("term", "estimate", "error")


@named("stat_jump", """select regr_intercept(l_extendedprice, l_quantity - 25) filter (l_quantity >= 25) - regr_intercept(l_extendedprice, l_quantity - 25) filter (l_quantity < 25) as jump, count(*) as n from lineitem where abs(l_quantity - 25) <= 10""")
def stat_jump(spark, folder):
    """Does the price jump at a quantity of 25? A regression discontinuity with a slope on either side (STA4)."""
    fit = discontinuity(table(spark, folder, "lineitem"), F.col("l_extendedprice"), F.col("l_quantity"), 25, 10)
    return spark.createDataFrame([(float(fit.beta[1]), fit.n)], "jump double, n bigint")
