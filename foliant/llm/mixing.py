"""Problem 9: mix sources to target shares, with soft membership.

Each document gets a nonnegative rate (how often its text is used). The expected tokens of source j are the sum over
documents of rate x tokens x P(j | document); projected-gradient least squares moves them to share_j x T, T being the tokens
of all documents, with every rate between 0 and the repeats that its memberships allow.

Membership: a document with a source belongs to it wholly. For one without, a naive Bayes classifier over hashed words,
fitted to a bounded sample of labelled documents (`sample_rows`, by hash) and tempered on its held-out half, gives the
posterior. Documents of one source share every gradient, so they enter as one row per source; those with a soft membership
are kept in a table of (tokens, posterior, rate), and one step is one aggregate over it of as many numbers as there are targets.
Every `window` steps the rates are written with it, so a pass replays fewer than `window` steps: at most `steps` passes and
`steps` / `window` writes, fewer where the rates settle.

Whether a source can reach its share is a matter of its own documents. The descent is therefore continued from the solved
mix with the soft documents held at rate 0, over one row per source: a source whose rate comes to rest at its cap with its expected
tokens short of the target cannot.

Names are compared trimmed and in lower case, and come out as the targets spell them. All sources without a target are one
class, '(other)', with target 0.

Defined cases: null or blank sources are unlabelled; null texts have no tokens; with no labelled documents or no targets,
unlabelled documents belong to '(other)'; null shares are 0 and null repeats 0; of targets whose names are equal after
trimming, the first in code point order counts; repeated documents count each; empty tables give a report with 0 tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.keys import Carried
from foliant.llm import tokens
from foliant.session import cut

OTHER = "(other)"
WIDTH = 4096  # hashed word features


def normal(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def features(text: str | None) -> np.ndarray:
    """Hashed word counts; digits fall together."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    x = np.zeros(WIDTH, dtype=np.float32)
    for w, n in seen.items():
        x[zlib.crc32(w.encode("utf-8", "surrogatepass")) % WIDTH] += n
    return x


@dataclass
class Classifier:
    """Multinomial naive Bayes with a temperature that makes its posteriors honest on held-out rows."""

    classes: int
    prior: np.ndarray
    weights: np.ndarray
    heat: float = 1.0

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], classes: int) -> Classifier:
        y = np.asarray(labels, dtype=int)

        def count(rows: range) -> tuple[np.ndarray, np.ndarray]:
            word = np.full((classes, WIDTH), 0.05)
            n = np.zeros(classes)
            for i in rows:
                word[y[i]] += features(texts[i])
                n[y[i]] += 1
            prior = np.log((n + 1e-3) / (n.sum() + 1e-3 * classes))
            return prior, np.log(word / word.sum(axis=1, keepdims=True))

        held = range(0, len(texts), 2)
        best = cls(classes, *count(range(1, len(texts), 2)))
        x = [features(texts[i]) for i in held]
        loss = {}
        for heat in (1.0, 0.5, 0.2, 0.1, 0.05, 0.02, 0.01, 0.0):
            best.heat = heat
            p = best.predict_rows(x)
            loss[heat] = -float(np.mean(np.log(p[np.arange(len(x)), y[list(held)]] + 1e-12))) if x else 0.0
        return cls(classes, *count(range(len(texts))), heat=min(loss, key=loss.get))

    def predict_rows(self, x: list[np.ndarray]) -> np.ndarray:
        if not x:
            return np.zeros((0, self.classes))
        z = self.prior + self.heat * (np.stack(x) @ self.weights.T)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None]) -> np.ndarray:
        return self.predict_rows([features(t) for t in texts])


def _step_rates(p: np.ndarray, cap: np.ndarray, history: list[np.ndarray], start: float | np.ndarray) -> np.ndarray:
    """Rates after the projected steps of the history: r <- clip(r - P residual, 0, cap)."""
    r = np.minimum(np.broadcast_to(start, len(p)), cap)
    for residual in history:
        r = np.clip(r - p @ residual, 0.0, cap)
    return r


@dataclass
class Mix:
    """names: targets and '(other)' last; rates: of wholly labelled documents by class; own_rates: the same where they alone count;
    passes: over the documents of soft membership; history: the residuals, from which any document's rate follows."""

    names: list[str]
    share: np.ndarray
    repeats: np.ndarray
    measured: DataFrame
    total: float
    labelled: np.ndarray
    expected: np.ndarray
    rates: np.ndarray
    own_rates: np.ndarray
    history: list[np.ndarray]
    passes: int
    key: str

    def light(self) -> Mix:
        """Without the tables, for workers."""
        return replace(self, measured=None)

    def short(self) -> np.ndarray:
        """Per class whether its own documents, used as often as allowed, stay short of the target: their rate has come to rest at
        the cap, and what they give there is less than the target; that last comparison is exact."""
        goal = self.share * self.total
        at_cap = self.own_rates >= self.repeats - 1e-6
        return at_cap & (self.repeats * self.labelled < goal)


def _own(labelled: np.ndarray, goal: np.ndarray, repeats: np.ndarray, rates: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """The projected gradient over wholly labelled documents alone, from the rates given until they rest. Every step leaves a
    fifth of the distance, so some 15 are enough; no data are read."""
    scale = np.where(labelled > 0, labelled, 1.0)
    while True:
        after = np.clip(rates - 0.8 * (rates * labelled - goal) / scale, 0.0, repeats)
        if np.abs(after - rates).max() <= tolerance:
            return after
        rates = after


def solve(
    df: DataFrame, targets: list[tuple[str, float, int]], key: str = "doc_id", text: str = "text", source: str = "source",
    sample_rows: int = 4000, steps: int = 40, window: int = 8, vocabulary: str = tokens.RANKS,
) -> Mix:
    """Fit the mix. targets: (source, target_share, max_repeats), a small fixed table."""
    spark = df.sparkSession
    chosen: dict[str, tuple[str, float, int]] = {}
    for name, share, most in sorted(targets, key=lambda t: t[0] or ""):
        chosen.setdefault((name or "").strip(" ").lower(), (name, float(share or 0), int(most or 0)))
    lookup = {k: i for i, k in enumerate(chosen)}
    other = len(lookup)
    names = [v[0] for v in chosen.values()] + [OTHER]
    share = np.array([v[1] for v in chosen.values()] + [0.0])
    repeats = np.array([float(v[2]) for v in chosen.values()] + [1.0])

    carried = Carried(df, [key])
    rows = df.select(*carried.cols, F.col(text).alias("_t"), normal(F.col(source)).alias("_s"))
    share_of = min(1.0, sample_rows / max(1, df.count()))
    picked = rows.filter((F.col("_s") != "") & (F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(share_of * 1_000_000) + 1))
    sample = picked.select("_t", "_s").limit(sample_rows).collect()
    model = Classifier.fit([r[0] or "" for r in sample], [lookup.get(r[1], other) for r in sample], other + 1) if sample and lookup else None
    handed = spark.sparkContext.broadcast((lookup, model, vocabulary))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookup, model, vocabulary = handed.value
        for batch in batches:
            label = [lookup.get(s, other) if s else -1 for s in batch["_s"]]
            soft = [i for i, x in enumerate(label) if x < 0]
            p: list[list[float] | None] = [None] * len(label)
            if model:
                for i, row in zip(soft, model.predict([batch["_t"].iloc[i] for i in soft])):
                    p[i] = row.tolist()
            else:
                label = [other if x < 0 else x for x in label]
            yield pd.DataFrame({key: batch[key], "tokens": [tokens.count(t, vocabulary) for t in batch["_t"]], "label": label, "posterior": p})

    measured = cut(rows.mapInPandas(measure, f"{carried.schema}, tokens int, label int, posterior array<float>").select(*carried.back, "tokens", "label", "posterior"))
    sums = {r[0]: float(r[1] or 0) for r in measured.groupBy("label").agg(F.sum("tokens")).collect()}  # one row per target
    labelled = np.array([sums.get(j, 0.0) for j in range(other + 1)])
    total = sum(sums.values())
    goal, eye, start = share * total, np.eye(other + 1), 1.0
    has_soft = sums.get(-1, 0.0) > 0
    soft = measured.filter("label < 0").select("tokens", "posterior", F.lit(start).alias("rate"))
    soft_schema = "tokens int, posterior array<float>, rate double"
    passes = 0

    def moved(batch: pd.DataFrame, recent: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        p = np.stack(batch["posterior"].to_numpy()).astype(float)
        return p, _step_rates(p, p @ repeats, recent, batch["rate"].to_numpy())

    def masses(recent: list[np.ndarray] | None) -> np.ndarray:
        """Expected tokens per class of the soft documents, `recent` steps after their written rates; at rate 1 if None."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros(other + 1)
            for batch in batches:
                if len(batch):
                    p, r = moved(batch, recent or [])
                    out += ((1.0 if recent is None else r) * batch["tokens"].to_numpy()) @ p
            yield pd.DataFrame({"j": range(other + 1), "m": out})

        nonlocal passes
        passes += 1
        got = soft.mapInPandas(run, "j int, m double").groupBy("j").agg(F.sum("m")).collect()  # one row per target
        return np.array([v for _, v in sorted(got)]) if got else np.zeros(other + 1)

    def written(recent: list[np.ndarray]) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(rate=moved(batch, recent)[1]) if len(batch) else batch

        return cut(soft.mapInPandas(run, soft_schema))

    scale = labelled + (masses(None) if has_soft else 0.0)
    scale = np.where(scale > 0, scale, 1.0)
    history, recent = [], []
    rates = np.minimum(np.full(other + 1, start), repeats)
    for _ in range(steps):
        expected = rates * labelled + (masses(recent) if has_soft else 0.0)
        step = 0.8 * (expected - goal) / scale
        history.append(step), recent.append(step)
        before, rates = rates, _step_rates(eye, repeats, [step], rates)
        if np.abs(rates - before).max() < 1e-5:
            break
        if has_soft and len(recent) == window:
            soft, recent = written(recent), []
    expected = rates * labelled + (masses(recent) if has_soft else 0.0)
    own = _own(labelled, goal, repeats, rates)
    return Mix(names, share, repeats, measured, total, labelled, expected, rates, own, history, passes, key)


def _apply(mix: Mix, batch: pd.DataFrame, carry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rates, copies, likeliest class, memberships) of a batch. Copies are rates rounded up or down so that the tokens
    rounded away so far in this task, kept per class in carry, stay below one document; never above the repeats allowed."""
    label = batch["label"].to_numpy()
    best, p = label.copy(), np.zeros((len(label), len(mix.names)))
    hard, soft = np.flatnonzero(label >= 0), np.flatnonzero(label < 0)
    p[hard, label[hard]] = 1.0
    if len(soft):
        p[soft] = np.stack(batch["posterior"].iloc[soft].to_numpy()).astype(float)
        best[soft] = p[soft].argmax(axis=1)
    cap = p @ mix.repeats
    rate = _step_rates(p, cap, mix.history, 1.0)
    copies = np.zeros(len(label), dtype=int)
    for i, (r, size, j, most) in enumerate(zip(rate, batch["tokens"].to_numpy(), best, np.floor(cap + 1e-6))):
        whole = int(r + 1e-9)
        missing = carry[j] + (r - whole) * size
        if whole < most and missing > size / 2:
            whole += 1
            missing -= size
        copies[i], carry[j] = whole, missing
    return rate, copies, best, p


def documents(mix: Mix) -> DataFrame:
    """(key, source, tokens, rate, copies); documents that are not used stay, with 0 copies. source: the class of a
    labelled document, the likeliest of a soft one."""
    key, light = mix.key, mix.light()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry = np.zeros(len(light.names))
        for batch in batches:
            rate, copies, best, _ = _apply(light, batch, carry)
            yield pd.DataFrame({key: batch[key], "source": [light.names[x] for x in best], "tokens": batch["tokens"], "rate": rate, "copies": copies})

    carried = Carried(mix.measured, [key])
    out = mix.measured.select(*carried.cols, "tokens", "label", "posterior").mapInPandas(run, f"{carried.schema}, source string, tokens int, rate double, copies int")
    return out.select(*carried.back, "source", "tokens", "rate", "copies")


def report(mix: Mix) -> DataFrame:
    """One row per target: what was asked for, what there is, what the mix gives, soft documents counting by membership.
    reachable: the source's own documents can give its share, see Mix.short."""
    light, short = mix.light(), mix.short()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry, out = np.zeros(len(light.names)), np.zeros(len(light.names))
        for batch in batches:
            _, copies, _, p = _apply(light, batch, carry)
            out += (copies * batch["tokens"].to_numpy()) @ p
        yield pd.DataFrame({"j": range(len(out)), "m": out})

    used = dict(mix.measured.mapInPandas(run, "j int, m double").groupBy("j").agg(F.sum("m")).collect())  # one row per target
    given = sum(used.values()) or 1.0
    rows = []
    for j, name in enumerate(mix.names[:-1]):
        goal, most = float(mix.share[j] * mix.total), float(mix.repeats[j] * mix.labelled[j])
        got = used.get(j, 0.0)
        rows.append((name, float(mix.share[j]), int(mix.repeats[j]), int(mix.labelled[j]), goal, most, float(mix.rates[j]), float(mix.expected[j]), got, got / given, not bool(short[j])))
    schema = "source string, target_share double, max_repeats int, source_tokens long, target_tokens double, capacity_tokens double, rate double, expected_tokens double, mix_tokens double, actual_share double, reachable boolean"
    return mix.measured.sparkSession.createDataFrame(rows, schema)
