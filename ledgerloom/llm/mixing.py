"""Mixing sources to target weights (problem 9).

Soft-membership mixing. A multinomial classifier over token ids, fitted on a bounded sample of labelled
rows, gives each document posteriors over the domains. Distributed projected gradient descent
(preconditioned by the Gram matrix of the memberships) fits a rate between 0 and the cap for every
document by least squares, such that the expected token totals of the domains match the targets twice: by the
posteriors of the documents, and by their labels (the source where it is a domain, the posteriors
where it is not). The last rounds correct the labels alone, since those shares are asked for exactly; so inside
a source the documents are chosen that bring the posterior totals near the targets too. Rates become whole
copies by systematic rounding over the cumulated rates of a source.

Documents with equal text are one text: the record with the least id stands for it, under the smallest
cap of the sources that hold it, so no text is used more often than any of its sources allows.
The wanted total is the largest at which every target can be met within the caps.

Bounds: the sample for the classifier has about ``sample_per_source`` rows of each source, of at most
``sample_chars`` characters each; weights are domains x vocabulary. Tokens, posteriors, rates and shares cover
all documents; equal memberships (posteriors in steps of 1/64) share a cell, and the cells stay
distributed. A round collects the sums and the Gram matrix: (2 x domains + 1) x 2 x domains numbers.

Defined results: null text -> not used; texts of no tokens -> 0 copies; a domain without documents
cannot get its share and is left out of the total (its actual share is 0); empty tables -> no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.tokens import TOKENIZER, encoding
from ledgerloom.session import stage


def fit_classifier(sample: pd.DataFrame, domains: list[str], path: str = TOKENIZER, smoothing: float = 0.5) -> np.ndarray:
    """Log weights (domains x vocabulary) of a multinomial model; sample has text and source."""
    enc = encoding(path)
    counts = np.full((len(domains), enc.n_vocab), smoothing, np.float64)
    at = {d: i for i, d in enumerate(domains)}
    for text, source in zip(sample.text, sample.source):
        ids, n = np.unique(enc.encode_ordinary(text), return_counts=True)
        counts[at[source], ids.astype(np.int64)] += n
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def posteriors(weights: np.ndarray, ids: list[int], temperature: float = 0.1) -> np.ndarray:
    """Posteriors of one document. Tokens of a document depend on each other, so its evidence counts at
    ``temperature`` of an independent sample's."""
    s = weights[:, ids].sum(axis=1, dtype=np.float64) * temperature
    p = np.exp(s - s.max())
    return p / p.sum()


def sized(docs: DataFrame, weights: np.ndarray, domains: list[str], path: str = TOKENIZER) -> DataFrame:
    """``docs``(id, text, source) -> id, source, key (of the text), tokens, label (number of the domain, -1), member array<int> in 64ths, guess."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = getattr(sys, "_token_encodings", None)
        if held is None:
            held = sys._token_encodings = {}
        if path not in held:
            held[path] = encoding(path)
        enc, at = held[path], {d: i for i, d in enumerate(domains)}
        for pdf in batches:
            tokens, members, guesses = [], [], []
            for text in pdf.text:
                ids = enc.encode_ordinary(text)
                p = posteriors(weights, ids)
                q = np.rint(p * 64).astype(int)
                q[int(np.argmax(q))] += 64 - q.sum()
                tokens.append(len(ids))
                members.append(q.tolist())
                guesses.append(domains[int(np.argmax(p))])
            yield pd.DataFrame({"id": pdf.id, "source": pdf.source, "key": pdf.key, "tokens": tokens, "label": [at.get(s, -1) for s in pdf.source], "member": members, "guess": guesses})

    kind = docs.schema["id"].dataType.simpleString()
    keyed = docs.select("id", "source", "text", F.md5("text").alias("key"))
    return keyed.mapInPandas(run, f"id {kind}, source string, key string, tokens int, label int, member array<int>, guess string")


def memberships(label: np.ndarray, member: list, k: int) -> np.ndarray:
    """Rows of label membership (the posteriors where there is no label) and posteriors."""
    soft = np.array(member, dtype=np.float64).reshape(-1, k) / 64
    hard = np.where((label < 0)[:, None], soft, np.eye(k)[np.maximum(label, 0)])
    return np.hstack([hard, soft])


def replay(rows: np.ndarray, cap: np.ndarray, steps: list[list[float]]) -> np.ndarray:
    """The rates after the given steps of the projected gradient."""
    rate = np.zeros(len(rows))
    for s in steps:
        rate = np.clip(rate - rows @ np.array(s), 0.0, cap)
    return rate


def next_step(off: np.ndarray, gram: np.ndarray, down: np.ndarray, up: np.ndarray, labels_only: bool, ridge: float = 0.02) -> np.ndarray:
    """The step against the totals that are off. ``gram`` is that of all documents, so a step towards both
    memberships does not overshoot; that of labels moves by what is off over the tokens that can still move that
    way, which clipping only makes shorter."""
    k = len(off) // 2
    if labels_only:
        return np.concatenate([np.where(off[:k] > 0, off[:k] / np.maximum(down, 1.0), off[:k] / np.maximum(up, 1.0)), np.zeros(k)])
    return np.linalg.solve(gram + ridge * max(np.trace(gram) / (2 * k), 1e-9) * np.eye(2 * k), off)


def fit_rates(cells: DataFrame, target: np.ndarray, total: float, mass: np.ndarray, soft_rounds: int = 6, rounds: int = 40, tolerance: float = 1e-7) -> list[list[float]]:
    """The steps of the projected gradient, to be replayed by ``replay``. ``cells``: label, member, cap, tokens."""
    k = len(target)
    goal = np.concatenate([target * total] * 2)
    steps = [np.concatenate([-target * total / np.maximum(mass, 1.0), np.zeros(k)]).tolist()]  # one rate for each label
    for done in range(rounds):
        taken = list(steps)

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    v, cap, tokens = memberships(pdf.label.to_numpy(), pdf.member.tolist(), k), pdf.cap.to_numpy(np.float64), pdf.tokens.to_numpy(np.float64)
                    r = replay(v, cap, taken)  # noqa: B023
                    x = np.concatenate([(r * tokens) @ v, (tokens * (r > 0)) @ v[:, :k], (tokens * (r < cap)) @ v[:, :k], ((v * tokens[:, None]).T @ v).ravel()])
                    yield pd.DataFrame({"k": np.arange(len(x), dtype=np.int32), "x": x})

        got = np.zeros(4 * k + 4 * k * k)
        for r in cells.mapInPandas(sums, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():
            got[r.k] = r.x
        off, down, up, gram = got[: 2 * k] - goal, got[2 * k : 3 * k], got[3 * k : 4 * k], got[4 * k :].reshape(2 * k, 2 * k)
        labels_only = done >= soft_rounds
        if labels_only and np.abs(off[:k]).max() <= tolerance * total:
            break
        steps.append(next_step(off, gram, down, up, labels_only).tolist())
    return steps


def sampled(x: DataFrame, counts: dict[str, int], per_source: int) -> Column:
    """Whether a row is in the sample: about ``per_source`` of each source, by 64 bits of its id."""
    keep = F.lit(False)
    for s, n in counts.items():
        below = min((per_source << 64) // max(n, 1), (1 << 64) - 1) - (1 << 63)
        keep = keep | ((F.col("source") == s) & (F.xxhash64("id") <= F.lit(below).cast("bigint")))
    return keep


def mix_sources(docs: DataFrame, targets: DataFrame, id_col: str, text_col: str, source_col: str, path: str = TOKENIZER, sample_per_source: int = 300, sample_chars: int = 20_000) -> DataFrame:
    """id, source, guess, member, tokens, rate, copies, target_share, actual_share of each text that is used.
    ``targets``(source, target_share, max_repeats) is a small table: one row per domain."""
    goals = {r.source: (float(r.target_share), int(r.max_repeats)) for r in targets.select("source", "target_share", "max_repeats").collect()}
    domains = sorted(goals)
    k = len(domains)
    x = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source")).filter("text is not null")
    short = x.filter((F.length("text") <= sample_chars) & F.col("source").isin(domains))
    sizes = {r.source: r["n"] for r in short.groupBy("source").agg(F.count("*").alias("n")).collect()}
    sample = short.filter(sampled(short, sizes, sample_per_source)).select("text", "source").toPandas()
    weights = fit_classifier(sample, domains, path)
    rows = stage(sized(x, weights, domains, path))

    caps = F.expr("map(" + ", ".join(f"'{d}', {goals[d][1]}" for d in domains) + ")")
    cap = F.coalesce(F.try_element_at(caps, F.col("source")), F.lit(min(c for _, c in goals.values())))
    texts = rows.withColumn("cap", cap).groupBy("key").agg(F.min_by(F.struct("id", "source", "guess", "tokens", "label", "member"), "id").alias("r"), F.min("cap").alias("cap")).select("r.*", "cap").filter("tokens > 0")
    texts = stage(texts)
    cells = stage(texts.groupBy("label", "member", "cap").agg(F.sum("tokens").alias("tokens")))
    part = [F.when(F.col("label") == i, 1.0).when(F.col("label") < 0, F.col("member")[i] / 64).otherwise(0.0) * F.col("tokens") for i in range(k)]
    got = cells.select(*[F.sum(p).alias(f"m{i}") for i, p in enumerate(part)], *[F.sum(p * F.col("cap")).alias(f"r{i}") for i, p in enumerate(part)]).first()
    mass = np.array([got[f"m{i}"] or 0.0 for i in range(k)])
    target = np.array([goals[d][0] if m > 0 else 0.0 for d, m in zip(domains, mass)])
    target = target / max(target.sum(), 1e-12)
    total = min(((got[f"r{i}"] or 0.0) / t for i, t in enumerate(target) if t > 0), default=0.0)
    steps = fit_rates(cells, target, total, mass) if total else []

    def rates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = memberships(pdf.label.to_numpy(), pdf.member.tolist(), k)
            yield pdf.assign(rate=np.rint(replay(v, pdf.cap.to_numpy(np.float64), steps) * 1e9).astype(np.int64))

    kind = texts.schema["id"].dataType.simpleString()
    # systematic rounding over the rates (in 1e-9) cumulated along the sizes of a source: classes of size, hash buckets in them
    parts = max(16, texts.count() // 1_000_000)
    own = ["owner", "size", "part"]
    rated = texts.mapInPandas(rates, f"id {kind}, source string, guess string, tokens int, label int, member array<int>, cap int, rate bigint")
    rated = rated.select("*", F.coalesce("source", F.lit("")).alias("owner"), F.floor(F.log2(F.col("tokens") + 1) * 8).alias("size"), F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"))
    rated = stage(rated)
    exact = lambda c: F.sum(F.col(c).cast("decimal(28,0)"))
    by_part = rated.groupBy(*own).agg(F.sum("rate").alias("n"))
    by_size = by_part.groupBy("owner", "size").agg(exact("n").alias("n"))
    before = lambda w: F.coalesce(exact("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes_before = by_size.select("owner", "size", before(Window.partitionBy("owner").orderBy("size")).alias("s"))  # some 300 sizes at most
    parts_before = by_part.select(*own, before(Window.partitionBy("owner", "size").orderBy("part")).alias("p"))
    offset = parts_before.join(sizes_before, ["owner", "size"]).select(*own, ((F.col("p") + F.col("s")) % 1_000_000_000).cast("bigint").alias("offset"))
    upto = F.col("offset") + F.sum("rate").over(Window.partitionBy(*own).orderBy("tokens", "id")) + 500_000_000
    ranked = rated.join(offset, own).withColumn("upto", upto)
    copies = F.floor(F.col("upto") / 1_000_000_000) - F.floor((F.col("upto") - F.col("rate")) / 1_000_000_000)
    used = stage(ranked.withColumn("copies", copies.cast("int")).filter("copies > 0").select("id", "source", "guess", "member", "tokens", (F.col("rate") / 1e9).alias("rate"), "copies"))
    reached = used.agg(F.sum(F.col("tokens") * F.col("copies")).alias("n")).first().n or 1
    whole = used.groupBy("source").agg((F.sum(F.col("tokens") * F.col("copies")) / F.lit(reached)).alias("actual_share"))
    wanted = targets.select("source", F.col("target_share").cast("double").alias("target_share"))
    return used.join(whole, used.source.eqNullSafe(whole.source)).drop(whole.source).join(wanted, "source", "left").withColumnRenamed("id", id_col)


def shares(mixture: DataFrame, targets: DataFrame, id_col: str) -> DataFrame:
    """source, target_share, actual_share, soft_share (by the posteriors), tokens, texts, most_copies for every wanted source."""
    domains = sorted(r.source for r in targets.select("source").distinct().collect())  # one row per domain
    got = mixture.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(id_col).alias("texts"), F.max("copies").alias("most_copies"), F.max("actual_share").alias("actual_share"))
    mass = F.col("tokens") * F.col("copies")
    soft = mixture.agg(*[(F.sum(F.col("member")[i] * mass) / 64 / F.sum(mass)).alias(f"s{i}") for i in range(len(domains))])
    soft = soft.select(F.inline(F.array(*[F.struct(F.lit(d).alias("source"), F.coalesce(f"s{i}", F.lit(0.0)).alias("soft_share")) for i, d in enumerate(domains)])))
    x = targets.select("source", "target_share", "max_repeats").join(got, "source", "left").join(soft, "source", "left")
    return x.fillna(0, ["tokens", "texts", "most_copies", "actual_share", "soft_share"])
