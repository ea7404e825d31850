"""Mixing sources to target weights by soft membership.

A classifier learned from a labelled table predicts each document's posterior over domains. Nonnegative document
rates are then fitted by projected-gradient least squares so that the expected tokens of each domain, counted by
posterior, match the targets: each step moves every document's rate along the gradient and projects it. DataFrame and
SQL functions only: the classifier's features are exact words, matched with array functions, and every gradient is one
distributed sum.
"""

from __future__ import annotations

import json
import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import fresh_names, stored

#: Shares of tokens wanted of each domain of labelled_domains().
TARGETS = {"clean": 0.97, "low": 0.01, "toxic": 0.02}


@dataclass(frozen=True)
class MixSettings:
    """`sample` bounds (in expectation) the labelled documents that the classifier learns from, and `features` its words."""

    sample: int = 20_000
    features: int = 64
    min_documents: int = 5
    smoothing: float = 0.5
    steps: int = 30
    tolerance: float = 1e-4


def labelled_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a table doc_id, quality, toxic: toxic, else low quality, else clean; rows with nulls teach nothing."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").otherwise("clean")
    return labels.filter(F.col("toxic").isNotNull() & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", domain.alias("domain"))


_BREAKS = ".,;:!?\"()\n\t\r\x0b\x0c"


def text_words(text: Column) -> Column:
    """Words of a text, lower-case and without the punctuation that ends sentences."""
    return F.split(F.translate(F.lower(F.coalesce(text, F.lit(""))), _BREAKS, " " * len(_BREAKS)), " ")


def with_features(docs: DataFrame, text: str, out: str) -> DataFrame:
    """`docs` with `out`: the distinct words of each text, and marks of its shape: few words, many symbols, much repetition.

    Each step is a column of its own, so that none is computed twice.
    """
    words, n, distinct, symbols = fresh_names([*docs.columns, out], "words", "n", "distinct", "symbols")
    c = lambda name: F.col(f"`{name}`")
    body = F.coalesce(c(text), F.lit(""))
    split = docs.withColumn(words, text_words(body))
    split = split.withColumns({n: F.size(c(words)), distinct: F.array_distinct(c(words)), symbols: F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))})
    marks = F.array(F.when(c(n) < 20, F.lit("<few>")), F.when(c(symbols) > 0.3 * c(n), F.lit("<symbols>")), F.when(F.size(c(distinct)) < 0.3 * c(n), F.lit("<repeated>")))
    return split.withColumn(out, F.concat(c(distinct), F.array_compact(marks))).drop(words, n, distinct, symbols)


@dataclass(frozen=True)
class Classifier:
    """Logits of a document without any feature, and what each feature's presence adds."""

    domains: list[str]
    prior: list[float]
    weights: dict[str, list[float]]

    def with_logits(self, docs: DataFrame, text: str, out: list[str]) -> DataFrame:
        """`docs` with a logit for each domain."""
        if not self.weights:
            return docs.withColumns({o: F.lit(float(p)) for o, p in zip(out, self.prior)})
        known = F.from_json(F.lit(json.dumps(list(self.weights))), "array<string>")
        features, hits = fresh_names([*docs.columns, *out], "features", "hits")
        seen = with_features(docs, text, features).withColumn(hits, F.array_intersect(F.col(features), known))
        weight = [F.from_json(F.lit(json.dumps({w: x[i] for w, x in self.weights.items()})), "map<string,double>") for i in range(len(out))]
        add = lambda i: lambda acc, w: acc + F.element_at(weight[i], w)
        return seen.withColumns({o: F.aggregate(F.col(hits), F.lit(float(self.prior[i])), add(i)) for i, o in enumerate(out)}).drop(features, hits)


def posteriors(logits: list[Column]) -> Column:
    """Array of a posterior for each logit."""
    top = F.greatest(*logits) if len(logits) > 1 else logits[0]
    odds = [F.exp(x - top) for x in logits]
    total = odds[0]
    for o in odds[1:]:
        total = total + o
    return F.array(*[o / total for o in odds])


def learn(docs: DataFrame, labelled: DataFrame, domains: list[str], settings: MixSettings, key: str = "doc_id", text: str = "text") -> Classifier:
    """Bernoulli naive Bayes over the words that tell domains apart most (by chi-square)."""
    labelled = labelled.filter(F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    n = labelled.count()
    if n > settings.sample:  # by hash, so that every source and length is met alike
        labelled = labelled.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < math.ceil(1e6 * settings.sample / n))
    known = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).join(labelled, "doc_id")
    hot = [F.sum((F.col("domain") == d).cast("long")).alias(f"n{i}") for i, d in enumerate(domains)]
    seen = stored(with_features(known, "text", "words").select("domain", "words"), "labelled")
    totals = [int(x or 0) for x in seen.agg(*hot).first()]
    everything = sum(totals)
    prior = [math.log((t + 1) / (everything + len(domains))) for t in totals]
    if not everything:
        return Classifier(domains, prior, {})
    counts = seen.select("domain", F.explode("words").alias("word")).groupBy("word").agg(*hot, F.count("*").alias("n"))
    expected = [F.col("n") * F.lit(t / everything) for t in totals]
    terms = [F.when(e > 0, (F.col(f"n{i}") - e) * (F.col(f"n{i}") - e) / e).otherwise(0.0) for i, e in enumerate(expected)]
    chi = terms[0]
    for t in terms[1:]:
        chi = chi + t
    best = counts.filter((F.col("n") >= settings.min_documents) & (F.col("word") != "")).withColumn("chi", F.round(chi, 6)).orderBy(F.desc("chi"), "word").limit(settings.features).collect()
    a = settings.smoothing
    rates = {r["word"]: [(r[f"n{i}"] + a) / (totals[i] + 2 * a) for i in range(len(domains))] for r in best}
    # a word that is absent counts too: all are first taken as absent, and a present one adds its odds
    base = [x + sum(math.log(1 - r[i]) for r in rates.values()) for i, x in enumerate(prior)]
    return Classifier(domains, base, {w: [math.log(x / (1 - x)) for x in r] for w, r in rates.items()})


@dataclass(frozen=True)
class Fit:
    """The steps of a fit, by which a document's rate follows from its posterior alone, and by how much of all wanted tokens each domain is missed."""

    steps: list[list[float]]
    miss: list[float]

    def rate(self, posterior: Column, floor: Column) -> Column:
        """1, moved by each step along the posterior and projected on rates of `floor` or more after each."""
        if not self.steps:
            return F.greatest(floor, F.lit(1.0))
        taken = F.from_json(F.lit(json.dumps(self.steps)), "array<array<double>>")
        dot = lambda s: F.aggregate(F.zip_with(posterior, s, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
        return F.aggregate(taken, F.lit(1.0), lambda r, s: F.greatest(floor, r - dot(s)))


def fit_rates(groups: DataFrame, targets: list[float], settings: MixSettings) -> Fit:
    """Rates of `floor` or more, all 1 at first, by projected gradient on the squared misses of the domain totals.

    `groups` has p (array), tokens and, where rates have a floor other than 0, floor. Misses are measured in the metric of the first
    Hessian and rates in that of their tokens, in which the gradient of a rate is p . M . miss and its Lipschitz constant 1: steps
    of length 1 never raise the misses. A fit that ends beyond the tolerance gives a warning with both.
    """
    d, wanted = len(targets), max(float(sum(targets)), 1.0)
    floor = F.col("floor") if "floor" in groups.columns else F.lit(0.0)
    p = [F.element_at("p", i + 1) for i in range(d)]
    pairs = [F.coalesce(F.sum(F.col("tokens") * p[i] * p[j]), F.lit(0.0)) for i in range(d) for j in range(d)]
    hessian = np.array([float(x) for x in groups.agg(*[x.alias(f"h{k}") for k, x in enumerate(pairs)]).first()]).reshape(d, d)
    metric = np.linalg.pinv(hessian, rcond=1e-9)
    steps: list[list[float]] = []
    goal, before = np.array(targets, float), float("inf")
    while True:
        rate = Fit(steps, []).rate(F.col("p"), floor)
        sums = groups.select("tokens", "p", rate.alias("rate")).agg(*[F.coalesce(F.sum(F.col("tokens") * p[i] * F.col("rate")), F.lit(0.0)).alias(f"s{i}") for i in range(d)]).first()
        miss = np.array([float(x) for x in sums]) - goal
        size, energy = float(np.abs(miss).sum()), float(miss @ metric @ miss)
        if size <= settings.tolerance * wanted or len(steps) >= settings.steps or energy > before * (1 - 1e-3):
            break  # met, out of steps, or as near as nonnegative rates come
        before = energy
        steps.append((metric @ miss).tolist())
    share = (miss / wanted).tolist()
    if size > settings.tolerance * wanted:
        warnings.warn(f"mixing misses its targets by {[round(x, 6) for x in share]} of {wanted:.0f} tokens after {len(steps)} steps", stacklevel=2)
    return Fit(steps, share)


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, settings: MixSettings | None = None, key: str = "doc_id", text: str = "text", budget: float | None = None, keep: list[str] | None = None, whole: str | None = None) -> DataFrame:
    """`docs` (its columns `keep`, if given) with columns tokens, posteriors (one for each domain in order of `targets`), rate, copies and
    miss (of the whole fit: by how much of all wanted tokens the domains are missed, added up).

    `labelled` is (doc_id, domain). Tokens are words between spaces and line ends; `budget` tokens are wanted in all, as many as there
    are if None, and each domain's share is its weight. copies = floor(rate + u), with u in [0, 1) from a hash of the id, so that
    expected copies equal the rate. Null text has no tokens and the prior as posterior; repeated rows count each; null ids are one id;
    an empty table, or no label of these domains, gives the prior everywhere. Names that clash get an underscore.

    With a domain `whole`, documents that are likeliest of it have a rate of 1 or more; the other domains' shares are then at most
    what there is of them, so that none is multiplied to fill its share, and `whole` has the rest of the budget.
    """
    targets, settings = targets or TARGETS, settings or MixSettings()
    domains = list(targets)
    weights = np.array([targets[d] for d in domains]) / sum(targets.values())
    model = learn(docs, labelled, domains, settings, key, text)
    tokens_, post_, rate_, copies_, miss_, *logits = fresh_names(docs.columns, "tokens", "posteriors", "rate", "copies", "miss", *[f"logit{i}" for i in range(len(domains))])
    q = lambda c: F.col(f"`{c}`")
    body = q(text)
    tokens = F.regexp_count(F.coalesce(body, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    scored = model.with_logits(docs.withColumn(tokens_, tokens), text, logits).withColumn(post_, posteriors([F.col(x) for x in logits]))
    scored = stored(scored.select(*[q(c) for c in keep or docs.columns], q(tokens_), q(post_)), "posteriors")
    p = [F.element_at(q(post_), i + 1) for i in range(len(domains))]
    floor = F.lit(0.0)
    if whole is not None:
        floor = F.when(p[domains.index(whole)] >= F.array_max(q(post_)), 1.0).otherwise(0.0)
    groups = scored.select(q(post_).alias("p"), q(tokens_).cast("double").alias("tokens"), floor.alias("floor"))
    sums = groups.agg(*[F.coalesce(F.sum(x), F.lit(0.0)) for x in (F.col("tokens"), *[F.col("tokens") * F.element_at("p", i + 1) for i in range(len(domains))])]).first()
    goal = weights * (sums[0] if budget is None else budget)
    if whole is not None:
        most = np.minimum(goal, np.array(sums[1:], float))
        k = domains.index(whole)
        most[k] = goal.sum() - np.delete(most, k).sum()
        goal = most
    fit = fit_rates(groups, goal.tolist(), settings)
    rate = F.round(fit.rate(q(post_), floor), 9)
    u = F.pmod(F.xxhash64(F.lit("copies"), q(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return scored.withColumn(rate_, rate).withColumns({copies_: F.floor(q(rate_) + u).cast("int"), miss_: F.lit(float(np.abs(fit.miss).sum()))})


def mixed(docs: DataFrame, labelled: DataFrame, **options) -> DataFrame:
    """The rows of `docs` as often as mix() says, with the columns of `docs`."""
    out = mix(docs, labelled, **options)
    copies = out.columns[-2]
    return out.withColumn(fresh_names(out.columns, "copy")[0], F.explode(F.expr(f"CASE WHEN `{copies}` > 0 THEN sequence(1, `{copies}`) END"))).select(*[F.col(f"`{c}`") for c in docs.columns])
