"""Soft-membership mixing of documents to target domain weights, with DataFrame functions only."""

from __future__ import annotations

import math
import warnings
from collections.abc import Collection
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import materialize

#: Weight of staying at rate 1 beside reaching the targets.
RIDGE = 1e-6
#: Domains that the table of labels defines, and the weights of the production query.
DOMAINS = ("clean", "poor", "toxic")
TARGETS = {"clean": 0.90, "poor": 0.08, "toxic": 0.02}
_BREAKS = ".,;:!?()[]{}<>\"'|/\\*#%&$@=+_~\n\t\r\x0b\x0c"


def domain_of() -> Column:
    """toxic if marked so, else poor if quality is 0, else clean; null without either mark."""
    known = F.col("toxic").isNotNull() | F.col("quality").isNotNull()
    return F.when(known, F.when(F.coalesce("toxic", F.lit(0)) == 1, "toxic").when(F.coalesce("quality", F.lit(1)) == 0, "poor").otherwise("clean"))


def with_features(docs: DataFrame, *keep: Column) -> DataFrame:
    """``doc_id, tokens`` (words between white space) and ``marks``: the distinct words, lower case and without signs, and ``#`` marks of the text's shape. ``keep``: other columns to carry along."""
    kept = [f"_{k}" for k in range(len(keep))]
    text = F.coalesce("text", F.lit(""))
    flat = docs.select("doc_id", text.alias("t"), F.filter(F.split(F.translate(text, "\n\t\r\x0b\x0c", "     "), " "), lambda w: w != "").alias("raw"), *[c.alias(n) for c, n in zip(keep, kept, strict=True)])
    words = F.filter(F.split(F.translate(F.lower("t"), _BREAKS, " " * len(_BREAKS)), " "), lambda w: w != "")
    n, size = F.greatest(F.size("raw"), F.lit(1)), F.greatest(F.length("t"), F.lit(1))
    upper, signs, digits = (F.regexp_count("t", F.lit(p)) for p in (r"\p{Lu}", r"[!|#%&$*]", r"[0-9]"))
    mark = lambda cond, name: F.when(cond, F.lit(name))
    marked = flat.select("doc_id", F.size("raw").cast("long").alias("tokens"), F.array_distinct(words).alias("words"), n.alias("n"), upper.alias("u"), signs.alias("s"), digits.alias("d"), size.alias("size"), *kept)
    shape = F.array_compact(
        F.array(
            mark(F.col("u") > 0.4 * F.col("size"), "#upper"),
            mark(F.col("s") > 0.3 * F.col("n"), "#signs"),
            mark(F.col("d") > 0.1 * F.col("size"), "#digits"),
            mark(F.size("words") < 0.3 * F.col("n"), "#repeats"),
            mark(F.col("n") < 8, "#short"),
            mark(F.col("n") > 3000, "#long"),
        )
    )
    return marked.select("doc_id", "tokens", F.concat("words", shape).alias("marks"), *kept)


def labelled_sample(labels: DataFrame, most_rows: int) -> DataFrame:
    """``label_id, domain`` of at most ``most_rows`` labelled documents, by the hash of doc_id; a document labelled twice has its worse label."""
    one = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    known = one.select(F.col("doc_id").alias("label_id"), domain_of().alias("domain")).filter("domain is not null")
    return known.orderBy(F.xxhash64("label_id"), "label_id").limit(most_rows)


def fit_classifier(docs: DataFrame, labels: DataFrame, domains: tuple[str, ...] = DOMAINS, most_rows: int = 8000, lexicon: int = 200, least_docs: int = 5, least_lift: float = 1.5) -> tuple[dict[str, float], dict[str, list[float]], list[str]]:
    """Logistic regression from labelled documents: (log-odds of each domain if no lexicon mark is there, what each mark adds to them, domains that have labels).

    Fitted on at most ``most_rows`` labelled rows. The ``lexicon`` marks that tell the
    domains apart best (chi-squared), among those of up to 64 characters in
    ``least_docs`` documents or more and with log-odds in some domain that differ by
    ``least_lift`` or more from all documents' (common words of one language are weak),
    and the rows' numbers by the lexicon marks they have, at most ``most_rows`` sets, are
    all that reaches the driver. Marks that go together share their weight, so many
    weak ones together don't outweigh a domain's own (:func:`_regress`).
    """
    chosen = F.broadcast(labelled_sample(labels, most_rows))  # most_rows rows at most
    known = with_features(docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("label_id"), "left_semi")).join(chosen, F.col("doc_id") == F.col("label_id"))
    known = materialize(known.select("domain", "marks"), "labelled", few_files=True)
    sizes = {r.domain: r.n for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    n = [sizes.get(d, 0) for d in domains]
    total = max(sum(n), 1)
    prior = {d: float(x) for d, x in zip(domains, n, strict=True)}
    per = known.select("domain", F.explode("marks").alias("mark")).filter("length(mark) <= 64").groupBy("mark").agg(*[F.sum((F.col("domain") == d).cast("long")).alias(f"n{k}") for k, d in enumerate(domains)])
    df = reduce(lambda a, b: a + b, [F.col(f"n{k}") for k in range(len(domains))])
    p = df / F.lit(float(total))
    chi = reduce(lambda a, b: a + b, [F.lit(float(n[k])) * F.pow(F.col(f"n{k}") / F.lit(max(n[k], 1.0)) - p, 2) for k in range(len(domains))])
    logit = lambda hit, of: F.log((hit + 0.5) / (of - hit + 0.5))
    lift = F.greatest(*[F.abs(logit(F.col(f"n{k}"), F.lit(float(n[k]))) - logit(df, F.lit(float(total)))) if n[k] else F.lit(0.0) for k in range(len(domains))], F.lit(0.0))
    best = per.withColumn("df", df).filter((F.col("df") >= least_docs) & (F.col("df") < total) & (lift >= least_lift)).withColumn("chi", chi / (p * (1 - p))).orderBy(F.desc("chi"), "mark").limit(lexicon).collect()
    marks = [r.mark for r in best]
    absent = {d: math.log((prior[d] + 1) / (total + len(domains))) for d in domains}
    present = [d for d in domains if prior[d] > 0]
    if not marks or len(present) < 2:
        return absent, {}, present
    sets = known.groupBy("domain", F.array_sort(F.array_intersect("marks", F.array(*[F.lit(m) for m in marks]))).alias("hits")).agg(F.count("*").alias("n")).orderBy("domain", "hits").collect()
    at, x = {m: k for k, m in enumerate(marks)}, np.zeros((len(sets), len(marks)))
    for k, r in enumerate(sets):
        x[k, [at[m] for m in r.hits]] = 1
    bias, weight = _regress(x, np.array([present.index(r.domain) for r in sets]), np.array([float(r.n) for r in sets]), len(present))
    absent |= {d: float(bias[k]) for k, d in enumerate(present)}
    # a domain without labels stays as unlikely as its prior says
    low = min(absent[d] for d in present) - math.log(total + len(domains))
    absent |= {d: low for d in domains if d not in present}
    return absent, {m: [float(weight[k, present.index(d)]) if d in present else 0.0 for d in domains] for k, m in enumerate(marks)}, present


def _regress(x: np.ndarray, y: np.ndarray, n: np.ndarray, classes: int, penalty: float = 0.5, steps: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression of rows ``x`` with numbers ``n`` on classes ``y``, by Newton's method with halved steps where a whole one doesn't lower the loss: (bias of each class, [features, classes] weights, of squared size times ``penalty`` / 2)."""
    m, f = x.shape
    z = np.hstack([np.ones((m, 1)), x])
    beta = np.zeros((f + 1, classes))
    beta[0] = np.log(np.maximum(np.bincount(y, weights=n, minlength=classes), 0.5) / n.sum())
    ridge = np.full(f + 1, penalty)
    ridge[0] = 1e-3
    want = np.eye(classes)[y]

    def loss(at: np.ndarray) -> tuple[float, np.ndarray]:
        logit = z @ at
        logit -= logit.max(1, keepdims=True)
        log_p = logit - np.log(np.exp(logit).sum(1, keepdims=True))
        return float(0.5 * (ridge[:, None] * at**2).sum() - n @ (log_p * want).sum(1)), np.exp(log_p)

    now, p = loss(beta)
    for _ in range(steps):
        grad = z.T @ (n[:, None] * (p - want)) + ridge[:, None] * beta
        hess = np.zeros(((f + 1) * classes,) * 2)
        for a in range(classes):
            for b in range(a, classes):
                w = n * p[:, a] * ((a == b) - p[:, b])
                block = (z * w[:, None]).T @ z
                rows, cols = slice(a * (f + 1), (a + 1) * (f + 1)), slice(b * (f + 1), (b + 1) * (f + 1))
                hess[rows, cols] = block
                hess[cols, rows] = block.T
        hess[np.diag_indices_from(hess)] += np.tile(ridge, classes)
        move = np.linalg.solve(hess, grad.T.ravel()).reshape(classes, f + 1).T
        size = 1.0
        while (after := loss(beta - size * move))[0] > now - 1e-4 * size * (grad * move).sum() and size > 1e-6:
            size /= 2
        beta = beta - size * move
        now, p = after
        if np.abs(size * move).max() < 1e-6:
            break
    return beta[0], beta[1:]


def posteriors(docs: DataFrame, absent: dict[str, float], weights: dict[str, list[float]], *keep: Column) -> DataFrame:
    """``doc_id, tokens, p`` (a struct with each domain's posterior) of every document, and ``_0``...: the columns to ``keep``."""
    domains = list(absent)
    kept = [f"_{k}" for k in range(len(keep))]
    marks = F.array(*[F.lit(w) for w in weights]) if weights else F.array().cast("array<string>")
    hits = with_features(docs, *keep).select("doc_id", "tokens", F.array_intersect("marks", marks).alias("hits"), *kept)

    def log_odds(k: int, d: str) -> Column:
        if not weights:
            return F.lit(absent[d])
        table = F.create_map(*[x for w, row in weights.items() for x in (F.lit(w), F.lit(row[k]))])
        return F.aggregate("hits", F.lit(absent[d]), lambda a, w: a + F.element_at(table, w))

    logs = [log_odds(k, d) for k, d in enumerate(domains)]
    out = hits.select("doc_id", "tokens", *[x.alias(f"l{k}") for k, x in enumerate(logs)], *kept)
    top = F.greatest(*[F.col(f"l{k}") for k in range(len(domains))]) if len(domains) > 1 else F.col("l0")
    out = out.select("doc_id", "tokens", *[F.exp(F.col(f"l{k}") - top).alias(f"e{k}") for k in range(len(domains))], *kept)
    both = reduce(lambda a, b: a + b, [F.col(f"e{k}") for k in range(len(domains))])
    # rounding makes documents with the same marks one row of the fit below
    return out.select("doc_id", "tokens", F.struct(*[F.round(F.col(f"e{k}") / both, 9).alias(d) for k, d in enumerate(domains)]).alias("p"), *kept)


def _walk(domains: list[str], steps: list[list[float]], ridge: float, p: str = "p") -> Column:
    """A document's (rate, look-ahead) after the given steps of accelerated projected gradient descent, from 1; its posteriors are all it depends on."""
    at = lambda r, y: F.struct(r.alias("rate"), y.alias("ahead"))
    if not steps:
        return at(F.lit(1.0), F.lit(1.0))
    eta = 1 / (1 + ridge)
    seq = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])

    def move(x: Column, e: Column) -> Column:
        grad = reduce(lambda a, b: a + b, [F.col(f"{p}.{d}") * F.get(e, F.lit(k)) for k, d in enumerate(domains)])
        rate = F.greatest(F.lit(0.0), x["ahead"] - F.lit(eta) * (grad + F.lit(ridge) * (x["ahead"] - F.lit(1.0))))
        return at(rate, rate + F.get(e, F.lit(len(domains))) * (rate - x["rate"]))

    return F.aggregate(seq, at(F.lit(1.0), F.lit(1.0)), move)


def _rate(domains: list[str], steps: list[list[float]], ridge: float, p: str = "p") -> Column:
    return _walk(domains, steps, ridge, p)["rate"]


def fit_rates(members: DataFrame, targets: dict[str, float], budget: float | None = None, ridge: float = RIDGE, tolerance: float = 1e-4, most_steps: int = 100, labelled: Collection[str] | None = None) -> tuple[list[list[float]], dict[str, float]]:
    """Projected gradient descent for nonnegative rates r of ``members(tokens, p)``.

    With a ``budget`` (tokens in all), weighted least squares: minimises
    (s - b)' G^-1 (s - b), where s are the expected domain totals sum(r tokens p), b is
    budget x target, and G the domains' Gram matrix sum(tokens p p'), so that domains
    which the classifier confuses don't slow the descent; and ``ridge`` times the
    token-weighted squares of r - 1. By default the wanted domain (of the largest
    target) sets the budget: b is its own total in proportion to the targets, it has
    no residual, and a document surely of it stays at rate 1; scarce domains get rates
    above 1, others below. The step is scaled by each document's tokens and
    accelerated (Nesterov), negative rates are projected to 0. In a step the cluster
    sums two numbers per domain; the driver sends back one.

    Domains that aren't in ``labelled`` (default: all are) have no residual either, nor,
    without a budget, have those that the posteriors can't tell from the wanted one or
    whose documents are more of it than the target's proportion: a warning names the
    targets left unmet.

    Returns every step's weighted residuals and momentum, from which :func:`_rate`
    computes any document's rate again, and the totals reached.
    """
    domains = list(targets)
    members = materialize(members.groupBy("p").agg(F.sum("tokens").alias("tokens")), "posteriors")
    expected = [F.sum(F.col(f"x.{k}") * F.col("tokens") * F.col(f"p.{d}")).alias(f"{k}_{d}") for k in ("rate", "ahead") for d in domains]

    def totals(steps: list[list[float]]) -> tuple[dict[str, float], dict[str, float]]:
        row = members.select("p", "tokens", _walk(domains, steps, ridge).alias("x")).agg(*expected).first()
        return tuple({d: float(row[f"{k}_{d}"] or 0) for d in domains} for k in ("rate", "ahead"))

    base, _ = now, ahead = totals([])
    row = members.agg(*[F.sum(F.col("tokens") * F.col(f"p.{a}") * F.col(f"p.{b}")).alias(f"{i}_{j}") for i, a in enumerate(domains) for j, b in enumerate(domains)]).first()
    gram = np.array([float(x or 0) for x in row]).reshape(len(domains), len(domains))
    moved = [k for k, d in enumerate(domains) if base[d] > 0 and (labelled is None or d in labelled)]
    weight = sum(targets[domains[k]] for k in moved)
    if not moved or weight <= 0:
        return [], now
    scaled = gram
    share = {d: targets[d] / weight for d in domains}
    wanted = max(moved, key=lambda k: targets[domains[k]])
    if budget is None:
        ratio = np.array([targets[d] / targets[domains[wanted]] for d in domains])
        scaled = gram - np.outer(ratio, gram[wanted])
        apart = 1 - gram[wanted] ** 2 / np.maximum(gram[wanted, wanted] * gram.diagonal(), 1e-300)
        moved = [k for k in moved if k != wanted and apart[k] > 0.01 and scaled[k, k] > 0]
    if unmet := [d for k, d in enumerate(domains) if k not in moved and targets[d] > 0 and (budget is not None or k != wanted)]:
        warnings.warn(f"targets of {', '.join(unmet)} can't be met: no labels, no documents, or none that can be told apart", stacklevel=2)
    inverse = np.zeros_like(gram)
    inverse[np.ix_(moved, moved)] = np.linalg.pinv(scaled[np.ix_(moved, moved)], rcond=1e-12)

    def residuals(s: dict[str, float]) -> np.ndarray:
        goal = [s[domains[wanted]] * targets[d] / targets[domains[wanted]] if budget is None else budget * share[d] for d in domains]
        return np.array([s[d] - g if k in moved else 0.0 for k, (d, g) in enumerate(zip(domains, goal, strict=True))])

    steps: list[list[float]] = []
    while True:
        whole = now[domains[wanted]] / share[domains[wanted]] if budget is None else budget
        if all(abs(x) <= tolerance * max(share[d], 1e-3) * whole for d, x in zip(domains, residuals(now), strict=True)):
            break
        if len(steps) >= most_steps:
            warnings.warn(f"rates miss the targets by more than {tolerance} after {most_steps} steps: {residuals(now)} tokens", stacklevel=2)
            break
        steps.append([*(inverse @ residuals(ahead)).tolist(), len(steps) / (len(steps) + 3)])
        now, ahead = totals(steps)
    return steps, now


def _fit(docs: DataFrame, labels: DataFrame, targets: dict[str, float], budget: float | None, most_rows: int) -> tuple[dict[str, float], dict[str, list[float]], DataFrame, list[list[float]]]:
    absent, weights, labelled = fit_classifier(docs, labels, tuple(targets), most_rows)
    members = materialize(posteriors(docs, absent, weights), "members", few_files=True)
    steps, _ = fit_rates(members.select("tokens", "p"), targets, budget, labelled=labelled)
    return absent, weights, members, steps


def _copies(rate: Column, seed: int, snap: float) -> Column:
    chance = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    whole = F.floor(rate)
    return F.when(F.abs(rate - F.round(rate)) < snap, F.round(rate).cast("long")).otherwise(whole + (chance < rate - whole).cast("long"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None, seed: int = 11, snap: float = 1e-6, most_rows: int = 8000) -> DataFrame:
    """Rates and copies that bring ``docs(doc_id, text)`` to target domain weights.

    A classifier from ``labels(doc_id, quality, toxic)`` (:func:`fit_classifier`)
    gives each whole text's domain posteriors; :func:`fit_rates` finds the rates.
    ``copies`` is a rate's whole part, plus one with the rest as probability by the
    hash of doc_id; a rate within ``snap`` (rounding noise) of a whole number is taken
    for it. So the totals of copies are those of rates but for the draw.

    Returns a row per input row: ``doc_id, tokens, p_<domain>..., rate, copies``.
    Null texts have no tokens and the posteriors of a text without marks; null and
    repeated ids are rows like others (equal ids share their chance); other columns
    are ignored. Without labels all posteriors are equal and all rates 1; so they are
    if only one domain has labels and no ``budget`` is given. Empty input: no rows.
    """
    targets = dict(targets or TARGETS)
    _, _, members, steps = _fit(docs, labels, targets, budget, most_rows)
    rated = members.select("doc_id", "tokens", *[F.col(f"p.{d}").alias(f"p_{d}") for d in targets], _rate(list(targets), steps, RIDGE).alias("rate"))
    return rated.withColumn("copies", _copies(F.col("rate"), seed, snap))


def mixed_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None, seed: int = 11, snap: float = 1e-6, most_rows: int = 8000) -> DataFrame:
    """``docs``, all its columns, each row as often as :func:`mix` says: no join, the rate is computed where the text is."""
    targets = dict(targets or TARGETS)
    absent, weights, _, steps = _fit(docs, labels, targets, budget, most_rows)
    found = posteriors(docs, absent, weights, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    # a generator of one row: without it the optimizer would push conditions on `copies`, and with them all that they are made of, below
    found = found.select(F.explode(F.array(F.struct("doc_id", "p", "_0"))).alias("x")).select("x.doc_id", "x.p", "x._0")
    counted = found.select("_0", _copies(_rate(list(targets), steps, RIDGE), seed, snap).alias("copies"))
    return counted.select(F.explode(F.array_repeat("_0", F.col("copies").cast("int"))).alias("row")).select(*[F.col(f"row.`{c}`") for c in docs.columns])
