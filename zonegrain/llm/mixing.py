"""Mixing to target weights with soft membership.

A naive Bayes classifier over hashed words, fitted on all rows of a labelled table, gives each document a posterior
over domains: every word of them counts, and the table is of fixed size.
Rates x >= 0 of documents are then fitted so that the expected domain token totals, sum of tokens * posterior * rate, match
the targets: least squares by accelerated projected gradient. A step needs one number for each domain from all documents, so only those
pass through the driver; the rates stay in a table. All of it is DataFrame operations.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonegrain.llm import common

#: Hash buckets of the classifier's words.
BUCKETS = 1 << 16
#: Shares of tokens by language that the registered query and the pipeline ask for.
TARGETS = {"de": 0.15, "en": 0.58, "es": 0.11, "fr": 0.16}
#: Misfit of a domain, relative to the total, at which the fit ends; and steps in which the loss must fall by a fifth, or it ends.
TOLERANCE, WINDOW = 1e-4, 6
#: Steps after which the rates are written down, so that no expression grows with the number of steps.
WRITE_EVERY = 8


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def classifier(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> tuple[DataFrame, list[float]]:
    """(bucket, log likelihoods by domain) of the buckets that labelled rows fill, and log priors, from labelled (doc_id, domain)."""
    known = common.saved(labelled.where(F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain")), "mix-labels")
    words = common.labelled(docs, known, "mix-known").select("domain", F.explode(_words(F.col("text"))).alias("word"))
    counts = [f"n{i}" for i in range(len(domains))]
    found = common.saved(words.groupBy(_bucket(F.col("word")).alias("bucket")).agg(*(F.count_if(F.col("domain") == d).alias(c) for c, d in zip(counts, domains, strict=True))), "mix-words")
    totals = found.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts)).first()
    rows = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    seen = sum(rows.values())
    prior = [float(np.log((rows.get(d, 0) + 1) / (seen + len(domains)))) for d in domains]
    return found.select("bucket", *(F.log((F.col(c) + 0.5) / (totals[c] + 0.5 * BUCKETS)).alias(f"like{i}") for i, c in enumerate(counts))), prior


def posteriors(docs: DataFrame, model: DataFrame, prior: list[float]) -> DataFrame:
    """doc_id, text_a, text_b, tokens, posterior (array by domain) for each row: softmax of log prior + log likelihood / sqrt(known words)."""
    text = common.text_column(docs)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), *common.text_keys(text), text.alias("text"))
    words = rows.select("row", "doc_id", "text_a", "text_b", F.explode_outer(_words(F.col("text"))).alias("word")).select("row", "doc_id", "text_a", "text_b", F.isnotnull("word").cast("long").alias("one"), F.when(F.isnotnull("word"), _bucket(F.col("word"))).alias("bucket"))
    n = len(prior)
    sums = words.join(F.broadcast(model), "bucket", "left").groupBy("row").agg(F.any_value("doc_id").alias("doc_id"), F.any_value("text_a").alias("text_a"), F.any_value("text_b").alias("text_b"), F.sum("one").alias("tokens"), F.count("like0").alias("known"), *(F.coalesce(F.sum(f"like{i}"), F.lit(0.0)).alias(f"l{i}") for i in range(n)))
    z = F.array(*(F.lit(prior[i]) + F.col(f"l{i}") / F.sqrt(F.greatest("known", F.lit(1))) for i in range(n)))
    odds = sums.select("doc_id", "text_a", "text_b", "tokens", z.alias("z")).withColumn("e", F.transform("z", lambda x: F.exp(x - F.array_max("z"))))
    return odds.select("doc_id", "text_a", "text_b", "tokens", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, b: a + b)).alias("posterior"))


def _dot(p: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(p, v, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def fit_rates(members: DataFrame, targets: list[float], max_rate: float | None = None, tolerance: float = TOLERANCE) -> tuple[DataFrame, list[float]]:
    """members (doc_id, tokens, posterior) with rate, and the relative misfit by domain. targets: tokens by domain.

    Minimises sum over domains of (sum of tokens * posterior * rate - target)^2 over 0 <= rate (<= max_rate), from rate 1,
    in the metric in which a document weighs as many as its tokens: equal posteriors get equal rates. It ends at the
    tolerance, or where the loss stands still: then the targets can't be met, which the misfit tells.
    """
    k, total = len(targets), float(sum(targets)) or 1.0
    t, p = F.col("tokens"), lambda i: F.get("posterior", F.lit(i))
    gram = members.agg(*(F.coalesce(F.sum(t * p(i) * p(j)), F.lit(0.0)).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k))).first()
    m = np.array([[gram[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / total
    rate = 1 / max(float(np.linalg.eigvalsh(m).max()), 1e-12)
    clip = lambda x: F.greatest(F.lit(0.0), x) if max_rate is None else F.least(F.lit(float(max_rate)), F.greatest(F.lit(0.0), x))
    table, past, beta, last, best = members.withColumn("x", F.lit(1.0)).withColumn("y", F.lit(1.0)), [], 1.0, np.inf, []

    def now() -> DataFrame:
        """The rates after the steps since the table was written."""
        if not past:
            return table
        moves = F.array(*(F.struct(F.array(*map(F.lit, g)).alias("g"), F.lit(b).alias("b")) for g, b in past))
        step = lambda s, move: clip(s["y"] - _dot(F.col("posterior"), move["g"]))
        state = F.aggregate(moves, F.struct(F.col("x").alias("x"), F.col("y").alias("y")), lambda s, move: F.struct(step(s, move).alias("x"), (step(s, move) + move["b"] * (step(s, move) - s["x"])).alias("y")))
        return table.withColumn("s", state).withColumns({"x": F.col("s.x"), "y": F.col("s.y")}).drop("s")

    while True:
        sums = now().agg(*(F.coalesce(F.sum(t * p(j) * F.col(c)), F.lit(0.0)).alias(f"{c}{j}") for c in "xy" for j in range(k))).first()
        misfit = [(sums[f"x{j}"] - targets[j]) / total for j in range(k)]
        loss = sum(e * e for e in misfit)
        if loss > last:
            beta = 1.0  # overshot: start the acceleration again
        last = loss
        best.append(min([loss, *best[-1:]]))
        slow = len(best) > WINDOW and best[-WINDOW - 1] - best[-1] <= 0.2 * best[-1]
        if slow or max(map(abs, misfit), default=0) < tolerance:
            break
        after = (1 + np.sqrt(1 + 4 * beta * beta)) / 2
        past.append(([float(rate * (sums[f"y{j}"] - targets[j]) / total) for j in range(k)], float((beta - 1) / after)))
        beta = after
        if len(past) == WRITE_EVERY:
            table, past = common.saved(now(), "rates"), []
    return now().withColumn("rate", F.col("x")).drop("x", "y"), misfit


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], max_rate: float | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, text_a, text_b, tokens (words), domain (likeliest), posterior (map by domain), rate, expected_tokens, misfit.

    labelled: (doc_id, domain). The target of a domain is its weight times the largest total for which no domain is
    asked for more tokens than it has; misfit is the largest difference of a domain, relative to the total. A null or
    empty text has no tokens and the prior as its posterior. Repeated rows and rows without doc_id are documents of their
    own. Without labelled rows all posteriors are equal. An empty table gives no row. Of docs only doc_id and text are read.
    """
    names = sorted(weights)
    model, prior = classifier(docs, labelled, names)
    members = common.saved(posteriors(docs, common.saved(model, "mix-model"), prior), "members")
    have = members.agg(*(F.coalesce(F.sum(F.col("tokens") * F.get("posterior", F.lit(i))), F.lit(0.0)).alias(f"h{i}") for i in range(len(names)))).first()
    share = np.array([weights[d] for d in names], float) / sum(weights.values())
    total = min((have[f"h{i}"] / s for i, s in enumerate(share) if s > 0), default=0.0)
    rated, misfit = fit_rates(members, [float(s * total) for s in share], max_rate)
    place = F.array_position("posterior", F.array_max("posterior")).cast("int")
    return rated.select("doc_id", "text_a", "text_b", "tokens", F.element_at(F.array(*map(F.lit, names)), place).alias("domain"), F.map_from_arrays(F.array(*map(F.lit, names)), "posterior").alias("posterior"), "rate", (F.col("tokens") * F.col("rate")).alias("expected_tokens"), F.lit(float(max(map(abs, misfit), default=0.0))).alias("misfit"))


def by_language(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of the registered query: documents that labels names, with their language as the domain."""
    return labels.select("doc_id").distinct().join(docs.select("doc_id", F.col("lang").alias("domain")), "doc_id")


def chosen(docs: DataFrame, rated: DataFrame, seed: int = 1) -> DataFrame:
    """The rows of docs that a rate keeps: with a probability of the rate (at most 1), drawn by a hash of doc_id and text."""
    draw = F.pmod(F.xxhash64("doc_id", "text_a", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return common.without(docs, rated.where(draw >= F.col("rate")).select("doc_id", "text_a", "text_b"), common.text_keys(common.text_column(docs)))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = mix(docs, by_language(docs, labels), TARGETS)
    return out.select("doc_id", "tokens", "domain", *(F.col("posterior")[d].alias(f"p_{d}") for d in sorted(TARGETS)), "rate", "expected_tokens", "misfit")
