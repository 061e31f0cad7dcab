"""Mixing sources to target weights with soft domain membership.

A naive Bayes classifier learns domains from a labelled table: on a bounded sample
of its rows, the `n_features` most informative of the distinct lower-cased words and
of a few marks of form are chosen by mutual information. Its posteriors p give every
document a share in every domain, stated in ten-thousandths, and a document of t tokens
has t * p expected tokens in each. Rates 0 <= r (<= `max_rate`) then minimise
|sum r t p - target|^2; of all rates that do, those nearest to 1 are taken (least
sum t (r - 1)^2).

They are found by projected gradient steps with late projection: a rate is the
projection on its bounds of 1 - p . z, where z gathers the gradients of all steps, each
scaled by 1/t, so that rates do not depend on length. A step is taken in the metric of
the K x K matrix sum t p p' over the rows between their bounds, with the best of several
lengths, and the pull towards 1 is lessened level by level. So rates are a closed
expression of K numbers, a step needs the K totals and that matrix only, and rows of
equal posteriors are one row of the table that is summed. The steps end when the duality
gap proves that the totals are within `enough` of the best ones, relative to the target;
if the gap stays wider, a warning says by how much, and beyond LOOSE times that it is an
error and not a result.

Rows are never collected; the driver sees K numbers and a matrix a step and `n_features`
weights. Null and empty texts have no tokens and the posteriors of their marks. Without
any labelled row there is no domain and every rate is 1. Repeated rows count each time,
null ids too. Further columns are ignored. All of it is DataFrame functions.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, materialize

#: A distance up to so many times ENOUGH, which rounding may leave, is told in a warning; more is an error.
LOOSE = 20
#: Bounds of the fit: labelled ids of the input taken (those of the smallest hashes) and features kept.
SAMPLE, N_FEATURES = 8000, 64
#: Relative distance of the totals from the best ones, the unit of posteriors, the levels of the pull towards 1, and the step lengths tried.
ENOUGH, UNIT, LEVELS, LENGTHS = 5e-5, 1e-4, tuple(10.0**-k for k in range(1, 16, 2)), tuple(4.0**-k for k in range(12))


def _features(text: Column) -> Column:
    """Distinct words of a text, lower case, and marks of its form. Marks hold a blank, so no word equals one."""
    body = F.lower(F.coalesce(text, F.lit("")))
    all_words = F.split(F.translate(body, ".,;:!?()\"'\n\t\r", " " * 13), " +")
    words, lines = F.array_distinct(all_words), F.split(body, "\n")
    n = F.greatest(F.length(body), F.lit(1))

    def share(name: str, count: Column) -> Column:
        return F.concat(F.lit(f"{name} "), F.least(F.floor(F.lit(50) * count / n), F.lit(9)).cast("string"))

    upper = F.length(F.coalesce(text, F.lit(""))) - F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[A-Z]", ""))
    marks = [
        share("upper", upper),
        share("symbols", F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))),
        share("shouts", F.length(body) - F.length(F.translate(body, "!", ""))),
        F.concat(F.lit("variety "), F.floor(F.lit(10) * F.size(words) / F.size(all_words)).cast("string")),
        F.concat(F.lit("lines "), F.floor(F.lit(10) * F.size(F.array_distinct(lines)) / F.size(lines)).cast("string")),
        F.concat(F.lit("size "), F.floor(F.log2(n.cast("double"))).cast("string")),
    ]
    return F.array_union(words, F.array(*marks))


@dataclass
class Classifier:
    domains: list[str]
    prior: list[float]
    features: list[str]
    weights: list[list[float]]  # of each domain, for each feature

    def posteriors(self, features: Column) -> list[Column]:
        """The log-posterior of each domain up to a constant, from the features of a row."""
        if len(self.domains) < 2:
            return [F.lit(1.0) for _ in self.domains]
        if not self.features:
            return [F.lit(p) for p in self.prior]
        known = F.array_intersect(features, F.array(*map(F.lit, self.features)))

        def total(prior: float, weights: list[float]) -> Column:
            table = F.create_map(*(F.lit(x) for pair in zip(self.features, weights) for x in pair))
            return F.aggregate(known, F.lit(prior), lambda acc, f: acc + F.element_at(table, f))

        return [total(p, w) for p, w in zip(self.prior, self.weights)]


def learn(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", sample: int = SAMPLE, n_features: int = N_FEATURES) -> Classifier:
    """Fit on the rows of `docs` of at most `sample` ids of `labelled` (id, domain) that `docs` has; an id with several domains takes the first by name."""
    known = labelled.select(F.col(id_col).cast("long").alias("id"), F.col(domain_col).alias("domain")).where("id is not null and domain is not null")
    present = known.groupBy("id").agg(F.min("domain").alias("domain")).join(docs.select(F.col(id_col).cast("long").alias("id")), "id", "left_semi")
    chosen = checkpoint(present.orderBy(F.xxhash64("id"), "id").limit(sample))
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = read.select("domain", F.explode(_features(F.col("text"))).alias("feature"))
    totals = {r.domain: r["count"] for r in read.groupBy("domain").count().collect()}
    domains = sorted(totals)
    if not domains:
        return Classifier([], [], [], [])
    n = sum(totals.values())
    counts = rows.groupBy("feature").agg(*(F.count_if(F.col("domain") == d).alias(f"n{k}") for k, d in enumerate(domains)))
    seen = sum((F.col(f"n{k}") for k in range(len(domains))), F.lit(0))

    def part(joint: Column, a: Column, b: int) -> Column:
        return F.when(joint > 0, joint / n * F.log(joint * n / (a * b))).otherwise(0.0)

    gain = sum((part(F.col(f"n{k}"), seen, totals[d]) + part(totals[d] - F.col(f"n{k}"), n - seen, totals[d]) for k, d in enumerate(domains)), F.lit(0.0))
    best = counts.where((seen >= 5) & (seen < n)).withColumn("gain", gain).orderBy(F.desc("gain"), "feature").limit(n_features).collect()
    features, weights = [r.feature for r in best], []
    prior = []
    for k, d in enumerate(domains):
        weights.append([math.log((r[f"n{k}"] + 0.5) / (totals[d] + 1)) for r in best])
        prior.append(math.log(totals[d] / n))
    return Classifier(domains, prior, features, weights)


def memberships(docs: DataFrame, model: Classifier, kept: Column | None = None, text_col: str = "text") -> DataFrame:
    """(kept, tokens, p0, p1, ...): what `kept` says of each row (its id), its whitespace words and its domain posteriors, which add up to 1."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select((F.col("doc_id").cast("long") if kept is None else kept).alias("kept"), text.alias("text"))
    df = df.select("kept", F.size(F.filter(F.split("text", "\\s+"), lambda w: w != "")).cast("double").alias("tokens"), _features(F.col("text")).alias("features"))
    k = range(len(model.domains))
    if len(k) < 2:
        return df.select("kept", "tokens", *(F.lit(1.0).alias(f"p{j}") for j in k))
    df = df.select("kept", "tokens", *(c.alias(f"l{j}") for j, c in enumerate(model.posteriors(F.col("features")))))
    top = F.greatest(*(F.col(f"l{j}") for j in k))
    df = df.select("kept", "tokens", *(F.exp(F.col(f"l{j}") - top).alias(f"l{j}") for j in k))
    total = sum((F.col(f"l{j}") for j in k), F.lit(0.0))
    df = df.select("kept", "tokens", F.array_position(F.array(*(F.col(f"l{j}") for j in k)), 1.0).alias("first"), *(F.round(F.col(f"l{j}") / total / UNIT).alias(f"q{j}") for j in k))
    rest = F.lit(1 / UNIT) - sum((F.when(F.col("first") == j + 1, 0.0).otherwise(F.col(f"q{j}")) for j in k), F.lit(0.0))
    return df.select("kept", "tokens", *((F.when(F.col("first") == j + 1, rest).otherwise(F.col(f"q{j}")) * UNIT).alias(f"p{j}") for j in k))


def cells(members: DataFrame, k: int) -> DataFrame:
    """(tokens, p0, p1, ...): the tokens of all rows with equal posteriors."""
    return checkpoint(members.groupBy(*(f"p{j}" for j in range(k))).agg(F.sum("tokens").alias("tokens")))


def _rate(z: np.ndarray, max_rate: float | None) -> Column:
    rate = F.greatest(F.lit(1.0) - sum((F.col(f"p{j}") * float(x) for j, x in enumerate(z)), F.lit(0.0)), F.lit(0.0))
    return rate if max_rate is None else F.least(rate, F.lit(float(max_rate)))


def _solve(summed: DataFrame, target: np.ndarray, max_rate: float | None, enough: float) -> tuple[np.ndarray, np.ndarray]:
    """The z of the best rates for rows (tokens, p0...), whose tokens add up to 1, and the totals reached."""
    k = len(target)
    p = [F.col(f"p{j}") for j in range(k)]
    add = lambda x: F.coalesce(F.sum(F.col("tokens") * x), F.lit(0.0))
    half = [(i, j) for i in range(k) for j in range(i, k)]
    along = F.col("along")

    def beside(points: list[np.ndarray]) -> DataFrame:
        """Each row beside each point, a handful: the points are data and not constants of the code, which stays compiled."""
        listed = F.explode(F.lit([[float(n), *map(float, z)] for n, z in enumerate(points)]))
        rows = summed.select("tokens", *p, listed.alias("z"))
        return rows.select("tokens", *p, F.col("z")[0].alias("n"), sum((c * F.col("z")[j + 1] for j, c in enumerate(p)), F.lit(0.0)).alias("along"))

    rate = F.greatest(1 - along, F.lit(0.0))
    free = along < 1
    if max_rate is not None:
        rate, free = F.least(rate, F.lit(float(max_rate))), free & (along > 1 - max_rate)
    sums = [add(along * rate + (rate - 1) * (rate - 1) / 2), *(add(c * rate) for c in p), *(add(F.when(free, p[i] * p[j]).otherwise(0.0)) for i, j in half)]

    def at(points: list[np.ndarray], pull: float) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Of each z the dual value, the totals and the matrix of the free rows, all in one pass."""
        found = beside(points).groupBy("n").agg(*(c.alias(f"s{n}") for n, c in enumerate(sums))).collect()  # one row for each point
        out = []
        for z, row in zip(points, sorted(found)):
            r = np.array(row[1:], float)
            metric = np.zeros((k, k))
            for (i, j), x in zip(half, r[k + 1 :]):
                metric[i, j] = metric[j, i] = x
            out.append((float(r[0] - target @ z - pull * (z @ z) / 2), r[1 : k + 1], metric))
        return out

    def gap(reached: np.ndarray) -> float:
        """How far half the squared distance can still fall, by a bound from the dual problem."""
        off = reached - target
        below, least = beside([off]).agg(add(F.greatest(-along, F.lit(0.0))).alias("a"), F.min(along).alias("b")).first()
        if max_rate is None:
            bound = off + max(0.0, -least)  # posteriors add up to 1, so no row is below 0 along it
            against = float(bound @ target)
        else:
            bound, against = off, float(off @ target + max_rate * below)
        size = max(float(bound @ bound), 1e-300)
        share = max(-against / size, 0.0)  # of the bound that proves most
        return float(off @ off) / 2 + share * share * size / 2 + share * against

    scale = max(float(np.abs(target).max()), 1e-3)
    near = (enough * scale) ** 2 / 2
    gram = np.zeros((k, k))
    for (i, j), x in zip(half, summed.agg(*(add(p[i] * p[j]).alias(f"g{i}_{j}") for i, j in half)).first()):
        gram[i, j] = gram[j, i] = x
    size, axes = np.linalg.eigh(gram)
    axes = axes[:, size > 1e-13 * max(size.max(), 1e-300)]  # along the others no row has anything, so rates don't depend on them
    z, best = np.zeros(k), (np.inf, np.zeros(k), np.zeros(k))
    for pull in LEVELS:
        starts = [z, z * 100]
        found = at(starts, pull)
        best_start = int(np.argmax([f[0] for f in found]))
        z, now = starts[best_start], found[best_start]
        for _ in range(100):
            slope = axes.T @ (now[1] - target - pull * z)
            if np.abs(slope).max() <= enough / 50 * scale:
                break
            move = axes @ np.linalg.solve(axes.T @ now[2] @ axes + pull * np.eye(axes.shape[1]), slope)
            tried = [z + length * move for length in LENGTHS]
            found = at(tried, pull)
            n = int(np.argmax([f[0] for f in found]))
            if found[n][0] <= now[0]:
                break  # no better than rounding allows
            z, now = tried[n], found[n]
        best = min(best, (gap(now[1]), z, now[1]), key=lambda b: b[0])
        if best[0] <= near:
            break
    if best[0] > near * LOOSE**2:
        raise RuntimeError(f"rates are not at their best: the totals may be {math.sqrt(2 * best[0]) / scale:.2g} of the target away from it")
    if best[0] > near:
        warnings.warn(f"rates are not proved to be at their best: the totals may be {math.sqrt(2 * best[0]) / scale:.2g} of the target away from it", stacklevel=2)
    return best[1], best[2]


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float], max_rate: float | None = None, enough: float = ENOUGH, summed: DataFrame | None = None) -> tuple[DataFrame, dict[str, float]]:
    """`members` with a column `rate`, and the domain totals reached. `targets` are token totals, 0 for domains not named; `summed` are the `cells` of the members, if they are known."""
    summed = cells(members, len(domains)) if summed is None else summed
    total = summed.agg(F.sum("tokens")).first()[0] or 0.0
    if not domains or not total:
        return members.withColumn("rate", F.lit(1.0)), dict.fromkeys(domains, 0.0)
    target = np.array([targets.get(d, 0.0) for d in domains]) / total
    z, reached = _solve(summed.withColumn("tokens", F.col("tokens") / total), target, max_rate, enough)
    return members.withColumn("rate", _rate(z, max_rate)), dict(zip(domains, (reached * total).tolist()))


def natural_totals(summed: DataFrame, domains: list[str]) -> dict[str, float]:
    """Expected tokens of each domain at rate 1."""
    if not domains:
        return {}
    row = summed.agg(*(F.coalesce(F.sum(F.col("tokens") * F.col(f"p{j}")), F.lit(0.0)).alias(f"s{j}") for j in range(len(domains)))).first()
    return dict(zip(domains, map(float, row)))


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, targets: dict[str, float] | None = None, scale: dict[str, float] | None = None, max_rate: float | None = None, id_col: str = "doc_id", text_col: str = "text", kept: Column | None = None) -> tuple[DataFrame, list[str]]:
    """(kept, tokens, p0.., rate) and the domains of p0...; `kept` is the id unless told. Give token `targets`, `weights` of the total that rate 1 has, or for each domain a `scale` of what it has at rate 1."""
    model = learn(docs, labelled, id_col, text_col)
    members = materialize(memberships(docs, model, F.col(id_col).cast("long") if kept is None else kept, text_col))
    summed = cells(members, len(model.domains))
    natural = natural_totals(summed, model.domains)
    if scale is not None:
        targets = {d: n * scale.get(d, 0.0) for d, n in natural.items()}
    if targets is None:
        share = sum(weights.values()) if weights else 1.0
        targets = {d: sum(natural.values()) * w / share for d, w in weights.items()} if weights else natural
    return fit_rates(members, model.domains, targets, max_rate, summed=summed)[0], model.domains


def domain_of_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from rows of quality and toxicity marks: toxic, else low, else clean; null marks are no label."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean")
    return labels.select("doc_id", domain.alias("domain"))
