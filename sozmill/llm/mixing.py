"""Mixing sources to target weights: soft memberships, then document rates by projected-gradient least squares.

A naive Bayes classifier over tokenizer ids, fitted on a bounded sample of labelled rows, gives every document posteriors
over the target sources, sharpened by the document's own label. Rates r >= 0, at most the source's repeats, are fitted so
that the expected tokens of every source match its target: the unknowns stay distributed, each step aggregates one number
per source, and the driver holds only those. A factor per source
then makes its own documents' tokens meet the target, and rates become whole copies by a shift that closes the rest.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sozmill.functions.keys import key
from sozmill.llm.sample import bounded_sample
from sozmill.session import cut

FIT_DOCUMENTS = 6_000
FIT_TOKENS = 400
#: How often a document's own source label is taken to be wrong.
LABEL_NOISE = 0.02
STEPS = 40
TOLERANCE = 1e-4
#: A pass that lessens the error by less than this part of it counts as none; after two such the fit ends.
STALL = 0.01
#: Part of the largest possible mix that is filled, so that the scarcest source's rates can differ between documents.
FILL = 0.98
#: Resolution of the shift that turns rates into whole copies.
SHIFT_BINS = 8192
#: Sources a mix may have; a vector of so many numbers goes to the driver each step.
MOST_SOURCES = 1_000
#: Sources up to which gradients are scaled by the memberships' Gram matrix.
GRAM_SOURCES = 64
#: Largest classifier that is sent to every task.
MOST_BYTES = 256 << 20


def default_vocabulary() -> str:
    """Path of the public multilingual byte-level vocabulary of this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def load_tokenizer(path: str):
    """A tiktoken encoder of a rank file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def fit_classifier(rows: list[tuple[int, str]], sources: int, path: str, fit_tokens: int = FIT_TOKENS) -> np.ndarray:
    """Log probabilities (token, source) of a naive Bayes model with add-one smoothing over all texts' frequencies."""
    encoder = load_tokenizer(path)
    counts = np.zeros((encoder.n_vocab, sources))
    for source, text in rows:
        np.add.at(counts[:, source], encoder.encode_ordinary(text[: 4 * fit_tokens])[:fit_tokens], 1)
    overall = counts.sum(1, keepdims=True) + 0.1
    smoothed = counts + overall / overall.sum() * 1000.0
    return np.log(smoothed / smoothed.sum(0, keepdims=True)).astype(np.float32)


def memberships(documents: DataFrame, sources: list[str], vocabulary: str, fit_documents: int = FIT_DOCUMENTS, fit_tokens: int = FIT_TOKENS, label_noise: float = LABEL_NOISE) -> DataFrame:
    """(doc_id, label, tokens, posterior) of documents with one of the sources; tokens over whole texts."""
    label_noise = min(max(label_noise, 1e-9), 1 - 1e-9)
    numbers = F.create_map(*[F.lit(x) for i, s in enumerate(sources) for x in (s, i)])
    rows = documents.withColumn("label", numbers[F.coalesce(key("source"), F.lit(""))]).where("label is not null and doc_id is not null and text is not null")
    rows = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "label", "text")
    sample = bounded_sample(rows, "doc_id", fit_documents).select("label", F.substring("text", 1, 4 * fit_tokens).alias("text"))
    table = fit_classifier([(r["label"], r["text"]) for r in sample.collect()], len(sources), vocabulary, fit_tokens)
    if table.nbytes > MOST_BYTES:
        raise ValueError(f"the classifier has {table.nbytes} bytes, more than tasks may be sent")
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        encoder, weights = load_tokenizer(vocabulary), shared.value
        for pdf in batches:
            labels = pdf["label"].to_numpy(np.int64)
            encoded = [encoder.encode_ordinary(t) for t in pdf["text"]]
            n = np.array([len(e) for e in encoded], np.int64)
            # Token evidence is far from independent; its root tempers it.
            logits = np.array([weights[e].sum(0) / np.sqrt(len(e)) if e else np.zeros(weights.shape[1]) for e in encoded]).reshape(len(n), -1)
            logits += np.log(label_noise / max(1, weights.shape[1] - 1))
            logits[np.arange(len(n)), labels] += np.log(1 - label_noise) - np.log(label_noise / max(1, weights.shape[1] - 1))
            p = np.exp(logits - logits.max(1, keepdims=True)) if len(n) else logits
            p /= p.sum(1, keepdims=True) if len(n) else 1
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "tokens": n, "posterior": [r.tobytes() for r in p.astype(np.float32)]})

    return rows.mapInPandas(run, "doc_id long, label int, tokens long, posterior binary")


def _posteriors(pdf: pd.DataFrame, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(pdf["posterior"]), np.float32).reshape(len(pdf), size).astype(float)


def _rates(labels: np.ndarray, p: np.ndarray, caps: np.ndarray, start: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """Rates of documents: their source's start, less the part of every source's correction that is theirs, projected to [0, cap]."""
    return np.clip(start[labels] - p @ taken, 0.0, caps[labels])


def fit_rates(members: DataFrame, targets: np.ndarray, caps: np.ndarray, available: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start rates and corrections by source with which the expected tokens of every source are near ``targets``.

    Least squares of expected minus wanted tokens by projected gradient: a document's rate depends on the corrections
    alone, so a pass does the same little work for each document however many went before. Gradients are scaled by the
    Gram matrix of the memberships of documents that aren't at a bound, which saves most passes. Each pass brings the
    driver one row per source.
    """
    size = len(targets)
    start = np.minimum(np.divide(targets, available, out=np.zeros(size), where=available > 0), caps)
    taken, best, least, stale = np.zeros(size), np.zeros(size), np.inf, 0
    # The matrix of many sources isn't worth its size: each gradient is then scaled by its source's tokens.
    wide = size if size <= GRAM_SOURCES else 0
    for _ in range(STEPS):
        now = taken.copy()

        def totals(batches):
            sums, gram = np.zeros(size), np.zeros((size, wide))
            for pdf in batches:
                if len(pdf):
                    p, n, labels = _posteriors(pdf, size), pdf["tokens"].to_numpy(float), pdf["label"].to_numpy()
                    rate = _rates(labels, p, caps, start, now)
                    sums += (rate * n) @ p
                    free = (rate > 0) & (rate < caps[labels])
                    gram += (p[free] * n[free, None]).T @ p[free, :wide]
            yield pd.DataFrame({"source": np.arange(size), "expected": sums, "gram": list(gram)})

        found = members.mapInPandas(totals, "source int, expected double, gram array<double>")
        found = found.groupBy("source").agg(F.sum("expected").alias("expected"), *[F.sum(F.get("gram", i)).alias(f"g{i}") for i in range(wide)]).collect()
        expected, gram = np.zeros(size), np.zeros((size, size))
        for r in found:
            expected[r["source"]] = r["expected"]
            gram[r["source"], :wide] = r[2:]
        off = expected - targets
        # Sources without a share still get a part of others' documents, so the least possible error need not be 0.
        error = float(np.sqrt((off**2).sum()))
        stale = stale + 1 if error > least * (1 - STALL) else 0
        if error < least:
            best, least = now, error
        if least <= TOLERANCE * max(targets.sum(), 1.0) or stale >= 2 or not len(found):
            break
        gram[np.diag_indices(size)] += (1e-3 if wide else 1.0) * np.maximum(available, 1.0)
        taken = now + np.linalg.solve(gram, off)
    return start, best


def own_factors(spread: list[tuple[int, float, int]], goal: np.ndarray, caps: np.ndarray) -> np.ndarray:
    """Per source, the factor on its documents' rates with which its own tokens meet the goal, rates staying within caps.

    ``spread`` holds tokens by source and rate in thousandths, at most 1,000 * max_repeats rows a source.
    """
    factors = np.ones(len(goal))
    for i in range(len(goal)):
        r = np.array([x[1] for x in spread if x[0] == i])
        n = np.array([x[2] for x in spread if x[0] == i], float)
        if not len(r) or goal[i] <= 0 or not (r * n).any():
            continue
        low, high = 0.0, 1e6
        for _ in range(80):
            middle = (low * high) ** 0.5 if low > 0 else high / 1024
            low, high = (middle, high) if (np.minimum(r * middle, caps[i]) * n).sum() < goal[i] else (low, middle)
            if low == 0 and high < 1e-9:
                break
        factors[i] = high
    return factors


def mix(
    documents: DataFrame, targets: DataFrame, vocabulary: str | None = None, fit_documents: int = FIT_DOCUMENTS, fit_tokens: int = FIT_TOKENS, fill: float = FILL, label_noise: float = LABEL_NOISE
) -> tuple[DataFrame, DataFrame]:
    """Selection (doc_id, source, tokens, rate, copies) and shares (source, target_share, actual_share, expected_share, documents, copies, tokens).

    actual_share counts a document's tokens for the source it is labelled with, expected_share divides them by its
    posteriors. The classifier is fitted on about ``fit_documents`` documents and ``fit_tokens`` tokens of each.

    The mix is ``fill`` times as large as the repeats allow: the least over sources of tokens * max_repeats / share. Shares are scaled to
    1 over the sources that have a share above 0 and documents; other sources and documents of unlisted sources are not
    selected, listed sources without either are reported with 0. Null texts have no tokens and aren't selected, null
    max_repeats mean 1, a source listed twice counts with its greatest share; doc_id is taken as unique (repeated rows are
    selected each); other columns are ignored. Empty tables give empty results.
    """
    spark = documents.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    wanted = targets.select(key("source").alias("source"), F.greatest(F.lit(0.0), F.coalesce(F.nanvl("target_share", F.lit(0.0)), F.lit(0.0))).alias("share"), F.greatest(F.lit(0), F.coalesce("max_repeats", F.lit(1))).alias("cap"))
    listed = wanted.where("source is not null").groupBy("source").agg(F.max("share").alias("share"), F.max("cap").alias("cap")).orderBy("source").limit(MOST_SOURCES + 1).collect()
    if len(listed) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    names = [r["source"] for r in listed] or [""]
    members = cut(memberships(documents, names, vocabulary, fit_documents, fit_tokens, label_noise))
    size = len(names)
    tokens = np.zeros(size)
    for r in members.groupBy("label").agg(F.sum("tokens").alias("t")).collect():
        tokens[r["label"]] = r["t"]
    caps = np.array([float(r["cap"]) for r in listed] or [0.0])
    share = np.array([r["share"] for r in listed] or [0.0]) * (tokens > 0) * (caps > 0)
    share = share / share.sum() if share.sum() > 0 else share
    total = fill * min((tokens[i] * caps[i] / share[i] for i in range(size) if share[i] > 0), default=0.0)
    goal, caps = total * share, caps * (share > 0)
    start, taken = fit_rates(members, goal, caps, tokens)

    def rated(batches):
        for pdf in batches:
            yield pdf.assign(rate=_rates(pdf["label"].to_numpy(), _posteriors(pdf, size), caps, start, taken) if len(pdf) else np.empty(0))

    rates = cut(members.mapInPandas(rated, "doc_id long, label int, tokens long, posterior binary, rate double"))
    spread = rates.groupBy("label", F.round(F.col("rate"), 3).alias("rate")).agg(F.sum("tokens").alias("tokens")).collect() if total else []
    factors = own_factors([(r["label"], r["rate"], r["tokens"]) for r in spread], goal, caps)
    factor_of = F.element_at(F.array(*[F.lit(float(f)) for f in factors]), F.col("label") + 1)
    cap_of = F.element_at(F.array(*[F.lit(float(c)) for c in caps]), F.col("label") + 1)
    # copies = floor(x + shift): within one unit of shift every document gains its next copy exactly once.
    unit = (F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    rates = rates.withColumn("rate", F.least(F.col("rate") * factor_of, cap_of))
    placed = cut(rates.withColumn("x", F.col("rate") + unit).withColumn("low", F.floor(F.col("x") - 0.5)).withColumn("cap", cap_of))
    bounded = lambda c: F.least(F.greatest(c, F.lit(0)), F.col("cap")).cast("bigint")
    placed = placed.select("doc_id", "label", "tokens", "posterior", "rate", bounded(F.col("low")).alias("base"), bounded(F.col("low") + 1).alias("more"), F.floor((F.col("low") + 1.5 - F.col("x")) * SHIFT_BINS).cast("int").alias("bin"))
    bins = placed.groupBy("label", "bin").agg(F.sum(F.col("tokens") * F.col("base")).alias("base"), F.sum(F.col("tokens") * (F.col("more") - F.col("base"))).alias("gain"))
    reach = Window.partitionBy("label").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("label")
    goal_of = F.element_at(F.array(*[F.lit(float(g)) for g in goal]), F.col("label") + 1)
    error = F.abs(F.sum("base").over(whole) + F.sum("gain").over(reach) - goal_of)
    shift = bins.select("label", "bin", error.alias("error")).groupBy("label").agg(F.min_by("bin", F.struct("error", "bin")).alias("last"))
    name_of = F.element_at(F.array(*[F.lit(s) for s in names]), F.col("label") + 1)
    chosen = placed.join(F.broadcast(shift), "label").select("doc_id", name_of.alias("source"), "tokens", "posterior", "rate", F.when(F.col("bin") <= F.col("last"), F.col("more")).otherwise(F.col("base")).alias("copies"))
    chosen = cut(chosen.where("copies > 0 and tokens > 0"))

    def domains(batches):
        sums = np.zeros(size)
        for pdf in batches:
            if len(pdf):
                sums += (pdf["tokens"] * pdf["copies"]).to_numpy(float) @ _posteriors(pdf, size)
        yield pd.DataFrame({"source": names, "expected": sums})

    plan = spark.createDataFrame([(n, float(s)) for n, s in zip(names, share) if n], "source string, target_share double")
    used = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    by_domain = chosen.mapInPandas(domains, "source string, expected double").groupBy("source").agg(F.sum("expected").alias("expected"))
    all_used = used.agg(F.sum("tokens").alias("all"))
    shares = plan.join(used, "source", "left").join(by_domain, "source", "left").crossJoin(F.broadcast(all_used)).select(
        "source", "target_share", F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)).alias("actual_share"), F.coalesce(F.col("expected") / F.col("all"), F.lit(0.0)).alias("expected_share"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "copies", "tokens")],
    )
    return chosen.drop("posterior"), shares
