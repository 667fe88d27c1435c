"""Mixing to target weights: soft domain membership and rates by distributed projected gradient."""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import located, materialise, maybe_broadcast

#: Word buckets, and the bound on those that the classifier keeps; its table has as many rows and is broadcast.
BUCKETS, FEATURES = 65536, 256
#: The bound on labelled documents of each domain that are learnt.
SAMPLE = 3000
#: Deviations from a fair share that make a word a sign of a domain; rounds and weight decay of the regression.
Z, STEPS, DECAY = 5.0, 30, 1e-4
#: The share of all tokens by which expected totals may miss their targets; the least gain of a round where they
#: are out of reach; steps followed in one expression.
TOLERANCE, GAIN, CHUNK = 1e-4, 1e-5, 25

log = logging.getLogger(__name__)


def label_domains(labels: DataFrame) -> DataFrame:
    """``doc_id, domain`` of the labels table: toxic, or else good or poor."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", domain.alias("domain")).filter("domain IS NOT NULL").distinct()


def _words(text: str):
    return F.filter(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), r"\s+"), lambda w: w != "")


def _bucket(word):
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def fit_domains(docs: DataFrame, known: DataFrame, domains: list[str], sample: int = SAMPLE) -> tuple[dict[int, list[float]], list[float]]:
    """Softmax regression over the words that tell domains apart: (weights for the domains of each bucket, biases).

    Of each domain a hash sample of about `sample` labelled documents is learnt, each text once: copies
    would vouch for each of their words. Spark picks the sample, maps words to buckets and counts them;
    the driver fits FEATURES weights a domain to the sample's kept buckets, as many rows as the bound
    allows. Biases are set to the domains' shares among all labels.
    """
    k = len(domains)
    labelled = dict(known.groupBy("domain").count().collect())
    ids = known.filter(_chosen(F.xxhash64(F.lit("domains"), "doc_id"), {d: n for d, n in labelled.items()}, sample))
    number = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("domain")) - 1
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most about k * sample ids
    rows = rows.groupBy(F.xxhash64("text").alias("key"), number.cast("int").alias("domain")).agg(F.first("text").alias("text"))
    rows = materialise(rows.select("key", "domain", F.array_distinct(F.transform(_words("text"), _bucket)).alias("buckets")), "mix-sample")
    held = dict(rows.groupBy("domain").count().collect())
    if any(n > 2 * sample for n in held.values()):  # ids that repeat have brought more texts than the bound allows
        rows = rows.filter(_chosen(F.col("key"), held, sample))
        held = dict(rows.groupBy("domain").count().collect())
    total, every = sum(held.values()), sum(labelled.get(d, 0) for d in domains)
    prior = np.log([(labelled.get(d, 0) + 1) / (every + k) for d in domains]) - np.log([(held.get(i, 0) + 1) / (total + k) for i in range(k)])
    features = _signs(rows, k)
    weight = np.zeros((k, len(features) + 1))
    if features and total:
        listed = _literal(features)
        own = F.transform(F.array_intersect("buckets", listed), lambda x: F.array_position(listed, x))
        found = rows.select("domain", F.array_join(own.cast("array<string>"), " ").alias("f")).orderBy("domain", "f").collect()
        x, y = np.zeros((len(found), len(features) + 1), np.float32), np.zeros((len(found), k))
        x[:, 0] = 1
        for i, r in enumerate(found):
            x[i, [int(v) for v in r["f"].split()]] = 1
            y[i, r["domain"]] = 1
        first, second = np.zeros_like(weight), np.zeros_like(weight)
        for step in range(1, STEPS + 1):
            z = x @ weight.T
            p = np.exp(z - z.max(axis=1, keepdims=True))
            slope = DECAY * weight + np.round((p / p.sum(axis=1, keepdims=True) - y).T @ x / total, 12)
            first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
            weight -= 0.3 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    return {b: [round(float(w), 9) for w in weight[:, i + 1]] for i, b in enumerate(features)}, [float(x) for x in weight[:, 0] + prior]


def _literal(values: list) -> F.Column:
    return F.expr("array(" + ", ".join(f"{v:.9f}D" if isinstance(v, float) else str(v) for v in values) + ")")


def _chosen(key: F.Column, counts: dict, sample: int) -> F.Column:
    """Whether a row of a domain is among about `sample` ones, by a hash; all are, if the domain has no more."""
    cuts = {d: int(sample / n * 2**31) for d, n in counts.items() if n > sample}
    if not cuts:
        return F.lit(True)
    table = F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair])
    return F.pmod(key, F.lit(2**31)) < F.coalesce(F.try_element_at(table, F.col("domain")), F.lit(2**31))


def _signs(rows: DataFrame, k: int) -> list[int]:
    """The FEATURES buckets whose count in some domain is furthest from a fair share of all domains' words."""
    counts = rows.select("domain", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(*[F.sum((F.col("domain") == i).cast("double")).alias(f"n{i}") for i in range(k)])
    found = sorted(tuple(r) for r in counts.collect())  # at most BUCKETS rows
    if not found:
        return []
    bucket, n = np.array([r[0] for r in found]), np.array([r[1:] for r in found])
    fair = n.sum(axis=1, keepdims=True) * n.sum(axis=0) / max(n.sum(), 1.0)
    z = (np.abs(n - fair) / np.sqrt(np.maximum(fair, 0.5))).max(axis=1)
    order = np.lexsort((bucket, -z))
    good = [i for i in order if z[i] >= Z and n[i].sum() >= 5][:FEATURES]
    return sorted(int(bucket[i]) for i in good)


def posteriors(docs: DataFrame, weights: dict[int, list[float]], priors: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, loc_file, loc_row, n_tokens, p0, p1, ...`` for every row, from one scan without a shuffle.

    In the row itself a document's words become buckets, those of the weight table (at most FEATURES,
    in the plan as a literal) are kept, and their weights are added in place. Weights have nine
    decimals, and so have their sums: rounding takes off no more than the order of adding.
    """
    k = len(priors)
    listed = sorted(weights)
    rows = located(docs, F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.select("doc_id", "loc_file", "loc_row", _words("text").alias("words"))
    held = F.array_intersect(F.array_distinct(F.transform("words", _bucket)), _literal(listed)) if listed else F.array().cast("array<int>")
    rows = rows.select("doc_id", "loc_file", "loc_row", F.size("words").cast("long").alias("n_tokens"), held.alias("held"))
    place = F.transform("held", lambda b: F.array_position(_literal(listed), b).cast("int") - 1) if listed else F.col("held")
    rows = rows.select("doc_id", "loc_file", "loc_row", "n_tokens", place.alias("held"))
    summed = lambda i: F.round(F.aggregate("held", F.lit(0.0), lambda s, at: s + F.get(_literal([weights[b][i] for b in listed]), at)), 9) if listed else F.lit(0.0)
    rows = rows.select("doc_id", "loc_file", "loc_row", "n_tokens", *[(summed(i) + F.lit(float(priors[i]))).alias(f"z{i}") for i in range(k)])
    top = F.greatest(*[F.col(f"z{i}") for i in range(k)]) if k > 1 else F.col("z0")
    rows = rows.select("*", *[F.exp(F.col(f"z{i}") - top).alias(f"e{i}") for i in range(k)])
    whole = sum(F.col(f"e{i}") for i in range(k))
    return rows.select("doc_id", "loc_file", "loc_row", "n_tokens", *[(F.col(f"e{i}") / whole).alias(f"p{i}") for i in range(k)])


def rate_column(steps: list[list[float]], k: int, most: float, rate: F.Column | None = None):
    """The rate that projected steps give a row of posteriors, from `rate` or 1: after each step it is cut to [0, most]."""
    rate = F.least(F.lit(1.0), F.lit(float(most))) if rate is None else rate
    for step in steps:
        move = sum(F.col(f"p{i}") * F.lit(float(step[i])) for i in range(k))
        rate = F.least(F.lit(float(most)), F.greatest(F.lit(0.0), rate - move))
    return rate


def fit_rates(soft: DataFrame, k: int, targets: list[float] | None, shares: list[float], most: float) -> tuple[DataFrame, list[float], list[float]]:
    """Projected-gradient least squares for rates r in [0, most] with sum(r * tokens * p) = targets.

    The gradient of the squared misses is scaled by each document's tokens. With G = sum(tokens * p p') it is
    scaled further by the inverse of G over the rows whose rate is within (0, most), which the step moves;
    where that brings little, by one over the largest eigenvalue of G over all rows, with which a step
    never overshoots, times a length that doubles while it helps. Each round is a scan of soft (stored, four columns or so)
    that follows every row's rate through the steps and sums within tasks; no row is shuffled and the
    driver sees k numbers and G. Rounds go on until the targets are met, or until one brings them nearer
    by less than GAIN of their own size (targets out of reach); each CHUNK of steps is stored, so that plans stay short. Without targets, `shares` are weighed so that the first domain keeps all its tokens.
    Returns (soft with ``rate``, targets, expected tokens at the end).
    """
    names, t = [f"p{i}" for i in range(k)], F.col("n_tokens").cast("double")
    cells = soft.withColumn("rate", rate_column([], k, most))

    def scan(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of the domains at the rates behind the steps, and G over all rows and over those in between."""
        rows = cells.select(*names, t.alias("t"), rate_column(steps, k, most, F.col("rate")).alias("rate"))
        free = F.when((F.col("rate") > 0) & (F.col("rate") < most), F.col("t")).otherwise(0.0)
        pairs = [(a, b) for i, a in enumerate(names) for b in names[: i + 1]]
        sums = [F.sum(F.col("rate") * F.col("t") * F.col(a)) for a in names] + [F.sum(w * F.col(a) * F.col(b)) for w in (F.col("t"), free) for a, b in pairs]
        row = [x or 0.0 for x in rows.agg(*[x.alias(f"s{i}") for i, x in enumerate(sums)]).first()]
        g = np.zeros((2, k, k))
        for n, (a, b) in enumerate(pairs):
            i, j = names.index(a), names.index(b)
            g[0, i, j] = g[0, j, i] = row[k + n]
            g[1, i, j] = g[1, j, i] = row[k + len(pairs) + n]
        return np.array(row[:k]), g[0], g[1]

    expected, every, free = scan([])
    have = every.sum(axis=1)
    goal = np.array([have[0] / shares[0] * s for s in shares] if targets is None else targets, float)
    if not have.sum():
        return cells, list(goal), [0.0] * k
    plain = np.eye(k) / np.linalg.eigvalsh(every).max()
    apart = lambda x: float((x - goal) @ (x - goal))
    size, steps, direct, length, turn = float(goal @ goal), [], True, 1.0, 0
    while np.abs(expected - goal).max() > TOLERANCE * max(goal.sum(), 1.0):
        turn += 1
        tries = [("free", np.linalg.pinv(free, rcond=1e-9))] * direct + [("long", length * plain)] * (length > 1) + [("plain", plain)]
        for kind, scale in tries:
            step = [round(float(x), 9) for x in scale @ (expected - goal)]
            moved, _, between = scan([*steps, step])
            if kind == "plain" or apart(moved) < (0.9 if kind == "free" else 1.0) * apart(expected):
                break
        steps.append(step)
        gain = apart(expected) - apart(moved)
        expected, free = moved, between
        if kind != "free" and gain <= GAIN * size:
            break
        direct = kind == "free" or turn % 4 == 0
        if kind == "long" or kind == "plain" and length == 1:
            length *= 2
        elif kind == "plain":
            length = max(1.0, length / 4)
        if len(steps) == CHUNK:
            cells, steps = materialise(cells.withColumn("rate", rate_column(steps, k, most, F.col("rate"))), "mix-rates"), []
    return cells.withColumn("rate", rate_column(steps, k, most, F.col("rate"))), list(goal), list(expected)


def mix(
    docs: DataFrame,
    labels: DataFrame,
    shares: dict[str, float],
    total: float | None = None,
    most: float = 8.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: str = "mix",
) -> DataFrame:
    """Rates at which to take documents so that expected domain tokens match target weights.

    A softmax regression learnt from the labels table gives each document its posteriors over
    the domains of `shares` (label_domains; tokens are words between white space). Rates r in
    [0, most] make sum(r * tokens * posterior) as near as can be to share * total for each domain;
    without `total` the first domain keeps all its tokens. Expected totals and targets are logged, as
    a warning where they differ (mix_totals gives them as rows). ``copies`` is the rate rounded up or down by
    a seeded hash of the row, with the rate as its mean.

    Null and empty texts have no tokens and the posteriors of the prior. Rows that repeat are rows of
    their own. Without labels the priors are even. An empty table gives no rows. Other columns are not
    read. Columns: ``doc_id, loc_file, loc_row, n_tokens, p_<domain> ..., rate, copies``.
    """
    domains = list(shares)
    weight = [shares[d] / sum(shares.values()) for d in domains]
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    weights, priors = fit_domains(plain, label_domains(labels).filter(F.col("domain").isin(domains)), domains)
    soft = materialise(posteriors(docs, weights, priors, id_col, text_col), "mix-posteriors")
    rated, goal, expected = fit_rates(soft, len(domains), None if total is None else [w * total for w in weight], weight, most)
    missed = max(abs(e - g) for e, g in zip(expected, goal, strict=True)) > TOLERANCE * max(sum(goal), 1.0)
    told = ", ".join(f"{d} {e:.1f} of {g:.1f}" for d, e, g in zip(domains, expected, goal, strict=True))
    log.log(logging.WARNING if missed else logging.INFO, "expected tokens of target: %s", told)
    chance = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "loc_file", "loc_row"), F.lit(1 << 30)) / float(1 << 30)
    return rated.select(
        "doc_id", "loc_file", "loc_row", "n_tokens", *[F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)], "rate",
        F.floor(F.col("rate") + F.when(F.col("rate") >= most - 1e-9, 0.0).otherwise(chance) + 1e-9).cast("int").alias("copies"),
    )


def mix_totals(mixture: DataFrame, shares: dict[str, float], total: float | None = None) -> DataFrame:
    """``domain, target, expected, taken`` of what mix() gave for these shares and total.

    ``expected`` sums the tokens by rate and posterior, ``taken`` by the copies that were drawn.
    """
    domains = list(shares)
    weight = [float(shares[d]) / sum(shares.values()) for d in domains]
    tokens = {"have": F.col("n_tokens"), "expected": F.col("rate") * F.col("n_tokens"), "taken": F.col("copies") * F.col("n_tokens")}
    each = [F.coalesce(F.sum(n * F.col(f"p_{d}")), F.lit(0.0)).alias(f"{name}{i}") for name, n in tokens.items() for i, d in enumerate(domains)]
    whole = F.col("have0") / weight[0] if total is None else F.lit(float(total))
    row = lambda i, d: F.struct(F.lit(d).alias("domain"), (whole * weight[i]).alias("target"), F.col(f"expected{i}").alias("expected"), F.col(f"taken{i}").alias("taken"))
    return mixture.agg(*each).select(F.inline(F.array(*[row(i, d) for i, d in enumerate(domains)])))


def take_mixture(docs: DataFrame, mixture: DataFrame) -> DataFrame:
    """The rows of docs, each as often as mixture's copies say (0 drops it), with all their columns.

    Null and empty texts and repeated rows are rows like any other; ids don't matter, as rows are told
    by file and place. An empty table stays empty, and columns of any name are carried along in a struct.
    docs is the frame that mix() was given, as read from files (common.stored() makes any frame so).
    """
    changed = materialise(mixture.filter("copies <> 1").select("loc_file", "loc_row", "copies"), "mix-copies")
    rows = located(docs, F.struct("*").alias("row")).join(maybe_broadcast(changed, changed.count()), ["loc_file", "loc_row"], "left")
    times = F.coalesce("copies", F.lit(1))
    return rows.filter(times > 0).select("row", F.explode(F.sequence(F.lit(1), times)).alias("copy")).select("row.*")
