"""Mixing sources to target weights by soft membership (operator 10).

A labelled table trains a classifier of domains (multinomial naive Bayes over hashed words, softened by a temperature
that is fitted on held-out labels); every document gets posteriors over the domains from its whole text;
projected-gradient least squares then fits nonnegative rates of documents so that the expected tokens of each domain,
summed over all documents, match their targets.

DataFrame functions only.  Posteriors are whole millionths (``UNIT``).  Documents whose posteriors round to the same
steps of 1/``GRID`` share a rate, and every cell of that grid carries the exact expected tokens of its documents: the
totals that are fitted are those of the documents' own posteriors, and every gradient step is one small aggregation.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twigline.llm.common import packed, stable_key, staged, unpacked

DOMAINS = ("good", "low", "toxic")
BUCKETS = 1 << 13
#: Labelled rows that the classifier is fitted on, at most.
LABEL_ROWS = 20_000
#: One in so many labelled texts is held out to fit the temperature, and its bounds.
HELD_OUT, COLDEST, HOTTEST = 5, 0.1, 1000.0
#: All domains together weigh so much, of their counts, in each domain's: rare words say little.
SHRINK = 0.1
UNIT, GRID = 1_000_000, 100
STEPS = 60
TOLERANCE = 1e-6
#: Share of the mean second moment added to each domain's: bounds how much more a domain that few texts differ in weighs.
DAMPING = 0.01
#: Cells up to which their rates are broadcast; three domains have at most 5,151.
BROADCAST_CELLS = 200_000


def domain_of() -> Column:
    """The domain of a labelled row: quality and toxic to one of DOMAINS."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")


def features(text: Column) -> Column:
    """Buckets of a text's words (letters, lower case) and of its runs of other signs, each once."""
    bucket = lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int")
    words = F.transform(F.split(F.lower(text), "[^\\p{L}]+"), bucket)
    signs = F.transform(F.split(text, "[\\p{L}\\s]+"), lambda x: bucket(F.concat(F.lit("#"), x)))
    return F.array_distinct(F.concat(words, signs))


@dataclass
class DomainModel:
    priors: list[float]  # log
    weights: list[list[float]]  # domain x bucket: log probability against the first domain
    temperature: float = 1.0  # scores are divided by it: words of a text are not independent
    domains: tuple[str, ...] = DOMAINS


def _log_weights(counts: list, held: tuple[bool, ...], domains: tuple[str, ...]) -> list[list[float]]:
    seen = {d: [0.1] * BUCKETS for d in domains}
    for r in counts:
        if r["held"] in held:
            seen[r["domain"]][r["bucket"]] += r["count"]
    pooled = [SHRINK * sum(c) for c in zip(*seen.values(), strict=True)]
    extra = sum(pooled)
    totals = {d: math.log(sum(seen[d]) + extra) for d in domains}
    logs = {d: [math.log(c + q) - totals[d] for c, q in zip(seen[d], pooled, strict=True)] for d in domains}
    return [[round(a - b, 4) for a, b in zip(logs[d], logs[domains[0]], strict=True)] for d in domains]


def fit_temperature(scored: list[tuple[int, list[float]]], priors: list[float]) -> float:
    """The temperature from COLDEST to HOTTEST with the least log loss on (domain, scores); the loss is convex in its inverse."""
    if not scored:
        return 1.0

    def loss(cold: float) -> float:
        out = 0.0
        for d, scores in scored:
            logits = [a + cold * x for a, x in zip(priors, scores, strict=True)]
            top = max(logits)
            out += top + math.log(sum(math.exp(x - top) for x in logits)) - logits[d]
        return out

    low, high = 1 / HOTTEST, 1 / COLDEST
    for _ in range(30):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return 2 / (low + high)


def train_domains(
    docs: DataFrame,
    labels: DataFrame,
    label_rows: int = LABEL_ROWS,
    domain: Column | None = None,
    domains: tuple[str, ...] = DOMAINS,
) -> DomainModel:
    """From at most ``label_rows`` labelled documents, chosen by a hash of the id; words are counted in the cluster.

    ``domain`` (default: ``domain_of()``) gives a labelled row's domain, one of ``domains``; others teach nothing.  The
    temperature is fitted on held-out texts with the weights of the others; the model's weights are those of all.
    """
    name = (domain_of() if domain is None else domain).alias("domain")
    sample = labels.select("doc_id", name).filter(F.col("doc_id").isNotNull() & F.col("domain").isin(*domains))
    sample = sample.orderBy(stable_key("doc_id"), "doc_id", "domain").limit(label_rows).distinct()
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(sample), "doc_id")
    # copies of a text are held out together
    rows = rows.withColumn("held", F.pmod(stable_key("text"), F.lit(HELD_OUT)) == 0)
    words = rows.select("domain", "held", F.explode(features(F.col("text"))).alias("bucket"))
    counts = words.groupBy("domain", "held", "bucket").count().collect()  # at most 2 x domains x BUCKETS rows
    of = rows.groupBy("domain").agg(F.count_distinct("doc_id").alias("count")).collect()
    n = {d: 1.0 for d in domains}
    for r in of:
        n[r["domain"]] += r["count"]
    every = sum(n.values())
    priors = [math.log(n[d] / every) for d in domains]
    scored = rows.filter("held").select("doc_id", "domain", features(F.col("text")).alias("_f"))
    scored = scored.select("doc_id", "domain", F.struct(*_scores(_log_weights(counts, (False,), domains))).alias("s"))
    scored = scored.groupBy("doc_id", "domain").agg(F.min("s").alias("s")).collect()  # at most label_rows rows
    temperature = fit_temperature([(domains.index(r["domain"]), [0.0, *r["s"]]) for r in scored], priors)
    return DomainModel(priors, _log_weights(counts, (False, True), domains), temperature, tuple(domains))


def _sum_of(array: Column, places: str) -> Column:
    return F.aggregate(places, F.lit(0.0), lambda acc, i: acc + F.element_at(array, i + 1))


def _scores(weights: list[list[float]]) -> list[Column]:
    """_s1, _s2, ...: sums of the weights over the buckets in _f."""
    # one literal each, folded by the optimiser
    arrays = [F.split(F.lit(",".join(map(str, w))), ",").cast("array<double>") for w in weights[1:]]
    return [_sum_of(a, "_f").alias(f"_s{d}") for d, a in enumerate(arrays, 1)]


def memberships(docs: DataFrame, model: DomainModel, keep: list[str]) -> DataFrame:
    """_keep (a struct of the columns ``keep``), tokens (words), q0, q1, ...: posteriors in whole millionths that add up
    to ``UNIT``, and p0, p1, ...: their cell, in steps of 1/``GRID`` that add up to ``GRID``."""
    k = len(model.domains)
    rows = docs.select(packed(keep), F.coalesce("text", F.lit("")).alias("_t"))
    tokens = F.size(F.filter(F.split(F.trim("_t"), "\\s+"), lambda x: x != "")).alias("tokens")
    rows = rows.select("_keep", features(F.col("_t")).alias("_f"), tokens)
    rows = rows.select("_keep", "tokens", *_scores(model.weights))
    logits = [F.lit(model.priors[0])] + [F.lit(model.priors[d]) + F.col(f"_s{d}") / model.temperature for d in range(1, k)]
    rows = rows.select("_keep", "tokens", *[x.alias(f"_l{d}") for d, x in enumerate(logits)])
    top = F.greatest(*[F.col(f"_l{d}") for d in range(k)])
    rows = rows.select("_keep", "tokens", *[F.exp(F.col(f"_l{d}") - top).alias(f"_e{d}") for d in range(k)])
    total = sum((F.col(f"_e{d}") for d in range(1, k)), F.col("_e0"))
    # floors of the cumulated shares: whole steps that add up exactly
    run = F.lit(0.0)
    upto = []
    for d in range(k - 1):
        run = run + F.col(f"_e{d}") / total
        upto.append(F.floor(run * UNIT + 0.5).cast("long").alias(f"_u{d}"))
    rows = rows.select("_keep", F.col("tokens").cast("long").alias("tokens"), *upto)
    ends = [F.lit(0).cast("long"), *[F.col(f"_u{d}") for d in range(k - 1)], F.lit(UNIT).cast("long")]
    cells = [F.expr("0")] + [F.expr(f"cast((_u{d} * {GRID} + {UNIT // 2}) div {UNIT} as int)") for d in range(k - 1)] + [F.lit(GRID)]
    exact = [(ends[d + 1] - ends[d]).alias(f"q{d}") for d in range(k)]
    rough = [(cells[d + 1] - cells[d]).cast("int").alias(f"p{d}") for d in range(k)]
    return rows.select("_keep", "tokens", *exact, *rough)


def _largest(m: list[list[float]]) -> float:
    """Largest eigenvalue of a small positive semidefinite matrix, by power iteration, or slightly more."""
    v, size = [1.0] * len(m), 1.0
    for _ in range(100):
        w = [sum(a * b for a, b in zip(row, v, strict=True)) for row in m]
        size = math.sqrt(sum(x * x for x in w)) or 1.0
        v = [x / size for x in w]
    return 1.001 * size


def _solve(m: list[list[float]], b: list[float]) -> list[float]:
    """Gauss-Jordan elimination of a small positive definite system."""
    n = len(b)
    a = [[*row, x] for row, x in zip(m, b, strict=True)]
    for i in range(n):
        k = max(range(i, n), key=lambda r: abs(a[r][i]))
        a[i], a[k] = a[k], a[i]
        for r in range(n):
            if r != i:
                f = a[r][i] / a[i][i]
                a[r] = [x - f * y for x, y in zip(a[r], a[i], strict=True)]
    return [a[i][n] / a[i][i] for i in range(n)]


def least_rate(domains: tuple[str, ...], thinned: dict[str, float] | None) -> Column:
    """The least rate of a cell (p0, p1, ...): 0, or, with ``thinned``, 1 unless every document that the cell can hold
    has at least the posterior named for one of these domains."""
    if thinned is None:
        return F.lit(0.0)
    # a cell's steps are within one of its documents' posteriors
    sure = [F.col(f"p{d}") > math.floor(thinned[name] * GRID + 1e-9) for d, name in enumerate(domains) if name in thinned]
    return F.when(F.greatest(F.lit(False), F.lit(False), *sure), 0.0).otherwise(1.0)


def rate_after(steps: list[list[float]], least: Column) -> Column:
    """(rate, before, ahead) of a cell from its mean posteriors e0, e1, ..., after these steps from rate 1.

    A step is its momentum and its slope for each domain.  It goes down the slope from ``ahead``, which lies beyond
    the rate by the momentum's part of its last move, ``rate - before``, and no further than to the ``least`` rate.
    """
    start = F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("before"), F.lit(1.0).alias("ahead"))
    if not steps:
        return start
    flat = ";".join(",".join(map(repr, s)) for s in steps)
    history = F.transform(F.split(F.lit(flat), ";"), lambda x: F.split(x, ",").cast("array<double>"))

    def move(at: Column, step: Column) -> Column:
        ahead = at["rate"] + step[0] * (at["rate"] - at["before"])
        slope = sum((F.col(f"e{d}") * step[d + 1] for d in range(1, len(steps[0]) - 1)), F.col("e0") * step[1])
        rate = F.greatest(least, ahead - slope)
        return F.struct(rate.alias("rate"), at["rate"].alias("before"), ahead.alias("ahead"))

    return F.aggregate(history, start, move)


def _descend(cells: DataFrame, p: list[Column], floor: Column, have: list[float], target: list[float], slope, least: float, steps: int):  # noqa: ANN001, ANN202
    """(steps, totals) down to where the totals were nearest to their targets; ``slope`` makes a step of a gap."""
    k = len(p)
    distance = lambda x: sum((a - b) ** 2 for a, b in zip(x, target, strict=True))
    taken: list[list[float]] = []
    totals, before, pace, momentum = have, have, 1.0, 0.0
    nearest = (distance(have), 0, have)
    while True:
        gap = [a - b for a, b in zip(totals, target, strict=True)]
        if max(map(abs, gap)) <= least or len(taken) == steps:
            break
        # totals are linear in the rates
        ahead = [g + momentum * (a - b) for g, a, b in zip(gap, totals, before, strict=True)]
        taken.append([momentum, *slope(ahead)])
        at, mass = F.col("at"), F.col("mass")
        turn = F.sum(mass * (at["ahead"] - at["rate"]) * (at["rate"] - at["before"]))
        row = cells.withColumn("at", rate_after(taken, floor)).agg(*[F.sum(mass * x * at["rate"]) for x in p], turn).first()
        before, totals = totals, [x or 0.0 for x in row[:k]]
        nearest = min(nearest, (distance(totals), len(taken), totals))
        still = max(abs(a - b) for a, b in zip(totals, before, strict=True)) <= least / 10
        if still and momentum == 0:
            break
        if still or (row[k] or 0.0) > 0:
            pace, momentum = 1.0, 0.0
        else:
            then = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
            pace, momentum = then, (pace - 1) / then
    return taken[: nearest[1]], nearest[2]


def fit_rates(
    members: DataFrame,
    weights: dict[str, float] | None = None,
    gains: dict[str, float] | None = None,
    steps: int = STEPS,
    domains: tuple[str, ...] = DOMAINS,
    thinned: dict[str, float] | None = None,
) -> tuple[DataFrame, dict]:
    """(p0, p1, ..., rate) for every cell of posteriors that occurs, and a report.

    Targets are either ``weights`` (shares of the present total of tokens) or ``gains`` (factors on each domain's
    present expected tokens).  With ``thinned`` (domain: posterior) only documents surely in one of these domains may be
    taken less than once; a gain below 1 then is a factor on the tokens of those documents, as no others can give way.
    Gradients are taken per token.  Each step moves every rate along its posteriors and projects it to its least rate
    (zero, or one) or above, with momentum (Beck and Teboulle, 2009) that starts anew when a step turns against its
    last move (O'Donoghue and Candes, 2015).

    Targets that can be reached are reached in few steps in the metric of the inverse token-weighted second moment of
    the cells' mean posteriors, damped by ``DAMPING``.  If that does not reach them, the fit starts anew and minimises
    the plain squared distance of expected from target tokens, in the metric of which nothing else counts.  Of either,
    the rates are those after the step that came nearest to the targets: never farther than without any.

    The report has the present, target and reached tokens of each domain, the steps taken, the largest distance from a
    target as a share of all tokens (``gap``), and whether that is within ``TOLERANCE`` (``matched``).
    """
    k = len(domains)
    names = [f"p{d}" for d in range(k)]
    exact = [F.sum((F.col("tokens") * F.col(f"q{d}")).cast("decimal(38,0)")).alias(f"t{d}") for d in range(k)]
    cells = members.groupBy(*names).agg(F.sum("tokens").cast("double").alias("mass"), *exact)
    mean = [
        F.when(F.col("mass") > 0, F.col(f"t{d}").cast("double") / UNIT / F.col("mass")).otherwise(F.col(f"p{d}") / GRID).alias(f"e{d}")
        for d in range(k)
    ]
    cells = staged(cells.select(*names, "mass", *mean), "cells")
    # every step reads the cells again: few of them go into one file
    if k <= 3:
        cells = staged(cells.coalesce(1), "cells-together")  # at most (GRID + 1)(GRID + 2) / 2 rows
    p = [F.col(f"e{d}") for d in range(k)]
    floor = least_rate(domains, thinned)
    moments = cells.agg(
        *[F.sum(F.col("mass") * p[i] * p[j]).alias(f"m{i}{j}") for i in range(k) for j in range(i, k)],
        *[F.sum(F.col("mass") * x).alias(f"t{i}") for i, x in enumerate(p)],
        *[F.sum(F.col("mass") * x * floor).alias(f"f{i}") for i, x in enumerate(p)],
    ).first()
    have = [moments[f"t{i}"] or 0.0 for i in range(k)]
    every = sum(have)
    if weights is not None:
        share = sum(weights.values())
        target = [every * weights.get(d, 0.0) / share for d in domains]
    else:
        bound = [moments[f"f{i}"] or 0.0 for i in range(k)]
        gain = [(gains or {}).get(d, 1.0) for d in domains]
        target = [x * g if g >= 1 else b + (x - b) * g for x, b, g in zip(have, bound, gain, strict=True)]
    plain = [[moments[f"m{min(i, j)}{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)]
    ridge = DAMPING / k * sum(plain[i][i] for i in range(k)) + 1e-9
    damped = [[plain[i][j] + (ridge if i == j else 0.0) for j in range(k)] for i in range(k)]
    least = TOLERANCE * max(1.0, every)
    off = lambda totals: max(abs(a - b) for a, b in zip(totals, target, strict=True))
    taken, totals = _descend(cells, p, floor, have, target, lambda gap: _solve(damped, gap), least, steps)
    if off(totals) > least:
        top = _largest(plain)
        taken, totals = _descend(cells, p, floor, have, target, lambda gap: [x / top for x in gap], least, 2 * steps)
    gap = off(totals) / max(1.0, every)
    report = {"present": have, "target": target, "reached": totals, "steps": len(taken), "gap": gap, "matched": gap <= TOLERANCE}
    return cells.select(*names, rate_after(taken, floor)["rate"].alias("rate")), report


def mix(
    docs: DataFrame,
    labels: DataFrame,
    weights: dict[str, float] | None = None,
    gains: dict[str, float] | None = None,
    keep: list[str] | None = None,
    domain: Column | None = None,
    domains: tuple[str, ...] = DOMAINS,
    thinned: dict[str, float] | None = None,
) -> tuple[DataFrame, dict]:
    """``keep`` (default doc_id) with tokens, the posteriors p_<domain> and the rate of every document, and the report
    of ``fit_rates``.  Kept columns with a result's name give way.

    Null or empty texts have no words: the prior is their posterior, and they weigh nothing.  Labels that are null or of
    unknown documents teach nothing; without labels all posteriors are equal.  A rate depends on the posterior alone, so
    ties and repeated rows get equal rates.  An empty table gives no rows.  Targets that no allowed rates can reach
    are approached in the least-squares sense, and the report says how far they are.
    """
    made = ["tokens", *[f"p_{d}" for d in domains], "rate"]
    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in made]
    model = train_domains(docs, labels, domain=domain, domains=domains)
    members = staged(memberships(docs, model, keep), "memberships")
    rates, report = fit_rates(members, weights, gains, domains=domains, thinned=thinned)
    rates = staged(rates, "rates")
    names = [f"p{d}" for d in range(len(domains))]
    small = rates.count() <= BROADCAST_CELLS
    out = members.join(F.broadcast(rates) if small else rates, names)
    shown = [(F.col(f"q{i}") / UNIT).alias(f"p_{d}") for i, d in enumerate(domains)]
    return out.select(*unpacked(keep), "tokens", *shown, "rate"), report


def mixing_rates(docs: DataFrame, labels: DataFrame, *args, **options) -> DataFrame:  # noqa: ANN002, ANN003
    """The rates of ``mix``; warns if they don't match the targets."""
    rates, report = mix(docs, labels, *args, **options)
    if not report["matched"]:
        warnings.warn(f"targets are missed by {report['gap']:.2%} of all tokens: {report}", stacklevel=2)
    return rates


#: Shares of tokens that the query aims at.
TARGET_WEIGHTS = {"good": 0.85, "low": 0.10, "toxic": 0.05}


def op10_mixing(spark, sf_dir):  # noqa: ANN001, ANN201
    """Rates of all documents for the target weights."""
    from twigline.llm.common import table

    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), TARGET_WEIGHTS)
