"""Toxicity by a convolutional text classifier, trained in numpy.

A word's vector joins the rows that ``HASHES`` hash functions pick from tables
of ``BUCKETS`` rows, so two words share a whole vector only if all their hashes
agree. Filters of several widths run over the words' vectors (each text padded
at its end), rectified and max-pooled over the whole text; a logistic unit reads
the pooled values with weights of 0 or more, so that words can only add to a
text's score and short texts are not suspect for want of others. Only the positions that win a maximum receive gradient, so
training touches few rows of the tables. Training draws both classes evenly;
the epoch with the least validation loss is kept, and a logistic calibration on
the validation part, weighted to the classes' true shares, makes the score a
probability of label 1.

Thresholds are calibrated by language on the validation part as well: each
language gets the score that maximises its F1 (the common one where it has too
few positives). Scores never see language, source or id.

Every labelled row is learnt from. Up to ``LOCAL_ROWS`` of them are trained on where
they are collected; more are dealt into shards of about ``SHARD`` rows, trained on
in parallel: each epoch every shard starts from the common network, goes through its
own rows, and what shards have changed is averaged, a table row over the shards that
touched it. Loss, calibration and thresholds come from all rows of the validation
part, as counts by logit in steps of 1 / ``STEPS``. Only networks and such counts reach
the driver. ``per_class`` bounds the rows of each label, if a sample is wanted.

Defined results: null and empty texts are one padding position and get the score
that the model gives it; with no labels, or labels of one class only, every
score is that class's share (0 without labels). A document with several labels
is toxic if any says so. Repeated rows score alike.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.operators.util import broadcast_if_bounded

from .common import bound_batches, save

LOCAL_ROWS, SHARD = 5000, 8192
#: Labelled ids that may be broadcast, some 30 MB; with more, Spark chooses the join.
BROADCAST_IDS = 1_000_000
#: Counts of logits: steps of one, and the greatest.
STEPS, LIMIT = 256, 30
#: Rows of the word tables that are averaged as one record.
BLOCK = 1024
HASHES, BUCKETS, DIM = 3, 1 << 15, 6
WIDTHS, FILTERS = (1, 2, 3), 8
#: Documents seen in training, over all epochs, and the most epochs.
VISITS, MAX_EPOCHS = 30_000, 30
BATCH = 32
RATE, DECAY = 0.1, 1e-4
MIN_POSITIVES = 5
SEED = 20

_WORD = re.compile(r"[^\W_]+")
_CACHE = 200_000
_CHUNK = 1 << 15


class Hashes(dict):
    """Word to 64-bit hash, remembering words up to a bounded number."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) >= _CACHE:
            self.clear()
        if len(word) <= 40:
            self[word] = h
        return h

    def of(self, text: str | None) -> np.ndarray:
        words = _WORD.findall((text or "").lower())
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def buckets(hashes: np.ndarray) -> np.ndarray:
    """Rows of the tables for each word, 1 and up; row 0 is the padding."""
    shifts = (np.arange(HASHES) * 21).astype(np.uint64)
    return 1 + ((hashes[:, None] >> shifts) % np.uint64(BUCKETS - 1)).astype(np.int64)


class Network:
    """Tables of word vectors, filters of each width, and the logistic unit."""

    def __init__(self, state: dict[str, np.ndarray] | None = None):
        if state is None:
            rng = np.random.default_rng(SEED)
            state = {"table": rng.normal(0, 0.1, (HASHES, BUCKETS, DIM)).astype(np.float32)}
            state["table"][:, 0] = 0
            for w in WIDTHS:
                state[f"filter{w}"] = rng.normal(0, 0.3, (w * HASHES * DIM, FILTERS)).astype(np.float32)
                state[f"bias{w}"] = np.zeros(FILTERS, np.float32)
            state["out"] = np.abs(rng.normal(0, 0.3, len(WIDTHS) * FILTERS)).astype(np.float32)
            state["out_bias"] = np.full(1, -1, np.float32)
        self.state = state
        self.seen: dict[str, np.ndarray] = {}

    def _vectors(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([self.state["table"][k][rows[:, k]] for k in range(HASHES)], axis=1)

    def _convolve(self, vectors: np.ndarray, w: int) -> np.ndarray:
        n, d = len(vectors) - w + 1, vectors.shape[1]
        f = self.state[f"filter{w}"]
        out = vectors[:n] @ f[:d]
        for k in range(1, w):
            out += vectors[k:n + k] @ f[k * d:(k + 1) * d]
        return out

    def pooled(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greatest filter values of a text, where they are, and the padded table rows."""
        pad = max(WIDTHS) - 1
        rows = np.concatenate([buckets(hashes), np.zeros((pad + (len(hashes) == 0), HASHES), np.int64)])
        values, places = [], []
        for w in WIDTHS:
            best = place = None
            n = len(rows) - pad
            for lo in range(0, n, _CHUNK):
                hi = min(n, lo + _CHUNK)
                out = self._convolve(self._vectors(rows[lo:hi + w - 1]), w)
                at = out.argmax(axis=0)
                top = out[at, np.arange(FILTERS)]
                if best is None:
                    best, place = top, at
                else:
                    place = np.where(top > best, at + lo, place)
                    best = np.maximum(top, best)
            values.append(best + self.state[f"bias{w}"])
            places.append(place)
        return np.concatenate(values), np.concatenate(places), rows

    def logit(self, hashes: np.ndarray) -> float:
        values, _, _ = self.pooled(hashes)
        return float(np.maximum(values, 0) @ self.state["out"] + self.state["out_bias"][0])

    def _step(self, name: str, at, gradient: np.ndarray) -> None:
        """Adagrad, on the touched rows only."""
        total = self.seen.setdefault(name, np.full(self.state[name].shape, 1e-4, np.float32))
        if at is Ellipsis:
            gradient = gradient + DECAY * self.state[name]
        total[at] += gradient ** 2
        self.state[name][at] -= RATE * gradient / np.sqrt(total[at])

    def train_batch(self, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray | None = None) -> None:
        d = HASHES * DIM
        weights = np.ones(len(texts)) if weights is None else weights
        sums = {k: np.zeros_like(v) for k, v in self.state.items() if k != "table"}
        touched, pushes = [], []
        for hashes, y, weight in zip(texts, labels, weights):
            values, places, rows = self.pooled(hashes)
            live = np.maximum(values, 0)
            p = 1 / (1 + np.exp(-np.clip(live @ self.state["out"] + self.state["out_bias"][0], -30, 30)))
            g = np.float32(weight * (p - y) / len(texts))
            sums["out"] += g * live
            sums["out_bias"] += g
            back = g * self.state["out"] * (values > 0)
            for i, w in enumerate(WIDTHS):
                part = slice(i * FILTERS, (i + 1) * FILTERS)
                at = places[part][:, None] + np.arange(w)  # (filters, w)
                used = rows[at.ravel()]
                vectors = self._vectors(used).reshape(FILTERS, w * d)
                sums[f"filter{w}"] += (vectors * back[part, None]).T
                sums[f"bias{w}"] += back[part]
                push = (self.state[f"filter{w}"].T * back[part, None]).reshape(FILTERS * w, HASHES, DIM)
                touched.append(used)
                pushes.append(push)
        for name, gradient in sums.items():
            self._step(name, Ellipsis, gradient)
        np.maximum(self.state["out"], 0, out=self.state["out"])
        used, push = np.concatenate(touched), np.concatenate(pushes)
        for k in range(HASHES):
            rows, where = np.unique(used[:, k], return_inverse=True)
            total = np.zeros((len(rows), DIM), np.float32)
            np.add.at(total, where, push[:, k])
            total[rows == 0] = 0
            self._step("table", (k, rows), total)


class Classifier:
    """A trained network with its calibration and the languages' thresholds."""

    def __init__(self, network: Network | None, scale: float = 1.0, shift: float = 0.0, constant: float = 0.0,
                 thresholds: dict[str | None, float] | None = None, threshold: float = 0.5):
        self.network, self.scale, self.shift, self.constant = network, scale, shift, constant
        self.thresholds, self.threshold = thresholds or {}, threshold

    def score(self, hashes: np.ndarray) -> float:
        if self.network is None:
            return self.constant
        z = self.scale * self.network.logit(hashes) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _loss(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum())


def _calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the logits that minimise the weighted loss, by Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        r, h = weight * (p - y), weight * p * (1 - p) + 1e-9
        gradient = np.array([(r * z).sum() + 1e-3 * (a - 1), r.sum() + 1e-3 * b])
        hessian = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        a, b = a - step[0], b - step[1]
    return (a, b) if a > 0 else (1.0, 0.0)


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The score that maximises F1, midway to the next lower one."""
    order = np.argsort(-p)
    p, hit = p[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(p) + 1) + y.sum())
    best = int(f1.argmax())
    return float((p[best] + (p[best + 1] if best + 1 < len(p) else 0.0)) / 2)


def train(rows: list[tuple[np.ndarray, int, str | None]], shares: dict[int, float]) -> Classifier:
    """From (hashes, label, language) rows, and the share of each label that was sampled."""
    rows = sorted(rows, key=lambda r: (r[1], len(r[0]), r[0].tobytes()))  # the same model for any order of rows
    y = np.array([r[1] for r in rows])
    if not len(rows) or y.min() == y.max():
        return Classifier(None, constant=float(y.mean()) if len(rows) else 0.0)
    rng = np.random.default_rng(SEED)
    held = np.zeros(len(rows), bool)
    for label in (0, 1):  # a quarter of each class is for validation
        of = np.flatnonzero(y == label)
        held[rng.permutation(of)[:len(of) // 4]] = True
    if len(set(y[held])) < 2:
        held[:] = True  # too few rows to part
    learn = np.flatnonzero(~held) if not held.all() else np.arange(len(rows))
    check = np.flatnonzero(held)
    weight = np.array([1 / shares[int(v)] for v in y])[check]
    network, best, kept = Network(), np.inf, None
    by_class = [learn[y[learn] == v] for v in (0, 1)]
    half = max(map(len, by_class))
    for _ in range(max(3, min(MAX_EPOCHS, VISITS // (2 * half)))):
        drawn = np.concatenate([rng.permutation(np.resize(rng.permutation(c), half)) for c in by_class])
        drawn = rng.permutation(drawn)
        for lo in range(0, len(drawn), BATCH):
            part = drawn[lo:lo + BATCH]
            network.train_batch([rows[i][0] for i in part], y[part])
        z = np.array([network.logit(rows[i][0]) for i in check])
        loss = _loss(1 / (1 + np.exp(-np.clip(z, -30, 30))), y[check], np.ones(len(check)))
        if loss < best:
            best, kept = loss, ({k: v.copy() for k, v in network.state.items()}, z)
    network, z = Network(kept[0]), kept[1]
    scale, shift = _calibrate(z, y[check], weight)
    p = 1 / (1 + np.exp(-np.clip(scale * z + shift, -30, 30)))
    langs = np.array([rows[i][2] or "" for i in check])
    thresholds = {lang: _best_threshold(p[langs == lang], y[check][langs == lang]) for lang in sorted(set(langs.tolist()))
                  if y[check][langs == lang].sum() >= MIN_POSITIVES}
    return Classifier(network, scale, shift, thresholds=thresholds, threshold=_best_threshold(p, y[check]))


def _threshold(p: np.ndarray, hits: np.ndarray, n: np.ndarray) -> float:
    """``_best_threshold`` from the positives and rows of each distinct score."""
    order = np.argsort(-p)
    p, hit = p[order], np.cumsum(hits[order])
    f1 = 2 * hit / (np.cumsum(n[order]) + hits.sum())
    best = int(f1.argmax())
    return float((p[best] + (p[best + 1] if best + 1 < len(p) else 0.0)) / 2)


def _dense(state: dict[str, np.ndarray]) -> list[str]:
    return sorted(k for k in state if k != "table")


def _blocks(state: dict[str, np.ndarray]) -> dict[int, np.ndarray]:
    """The parameters as records (rows, width): -1 all but the tables, then the tables' rows by ``BLOCK``."""
    rows = state["table"].reshape(-1, DIM)
    return {-1: np.concatenate([state[k].ravel() for k in _dense(state)])[:, None]} \
        | {i // BLOCK: rows[i:i + BLOCK] for i in range(0, len(rows), BLOCK)}


def _add(state: dict[str, np.ndarray], change: dict[int, np.ndarray]) -> None:
    """Add changes of records to the parameters, in place."""
    rows = state["table"].reshape(-1, DIM)
    for block, by in change.items():
        if block >= 0:
            rows[block * BLOCK:block * BLOCK + len(by)] += by
            continue
        at = 0
        for k in _dense(state):
            state[k] += by[at:at + state[k].size].reshape(state[k].shape)
            at += state[k].size


def _words(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint64)


def _epoch(rows: DataFrame, network: Network, weights: dict[int, float], epoch: int) -> None:
    """One epoch over the shards, which are the partitions of ``rows``; the network then has their average."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((network.state, network.seen))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state, seen = shared.value
        net = Network({k: v.copy() for k, v in state.items()})
        net.seen = {k: v.copy() for k, v in seen.items()}
        texts, labels = [], []

        def step() -> None:
            y = np.array(labels)
            net.train_batch(texts, y, np.array([weights[v] for v in labels]))
            texts.clear(), labels.clear()

        for batch in batches:
            for words, toxic in zip(batch["words"], batch["toxic"]):
                texts.append(_words(words.as_py()))
                labels.append(toxic.as_py())
                if len(texts) == BATCH:
                    step()
        if texts:
            step()
        shard, found = TaskContext.get().partitionId(), []
        old, new, old_seen, new_seen = map(_blocks, (state, net.state, seen, net.seen))
        for block in old:
            more = new_seen[block] - old_seen[block]
            touched = more.any(axis=1) if block >= 0 else np.full(len(more), more.any())
            if touched.any():
                found.append((block, shard, np.concatenate(
                    [new[block] - old[block], more, touched[:, None]], axis=1).astype(np.float32).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()),
                                          pa.array([f[2] for f in found], pa.binary())], ["block", "shard", "change"])

    def average(table: pa.Table) -> pa.Table:
        block, total = table["block"][0].as_py(), 0.0
        for change in table.sort_by("shard")["change"]:  # the same sum whatever the order of arrival
            total = total + np.frombuffer(change.as_py(), np.float32).astype(np.float64)
        total = total.reshape(-1, 2 * (DIM if block >= 0 else 1) + 1)
        mean = total[:, :-1] / np.maximum(total[:, -1:], 1)
        return pa.table({"block": pa.array([block], pa.int32()), "change": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})

    order = F.xxhash64("key", F.lit(epoch))
    changed = rows.sortWithinPartitions(order, "key").select("words", "toxic") \
        .mapInArrow(learn, "block int, shard int, change binary").groupBy("block") \
        .applyInArrow(average, "block int, change binary").collect()
    shared.unpersist()
    for r in changed:
        width = DIM if r.block >= 0 else 1
        both = np.frombuffer(r.change, np.float32).reshape(-1, 2 * width)
        _add(network.state, {r.block: both[:, :width]})
        _add(network.seen, {r.block: both[:, width:]})
    np.maximum(network.state["out"], 0, out=network.state["out"])


def _logits(rows: DataFrame, network: Network) -> DataFrame:
    """(lang, toxic, at, n): how many rows have a logit of ``at`` / ``STEPS``."""
    shared = rows.sparkSession.sparkContext.broadcast(network.state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(shared.value)
        for batch in batches:
            z = np.array([net.logit(_words(w.as_py())) for w in batch["words"]])
            at = np.rint(np.clip(z, -LIMIT, LIMIT) * STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["lang"], batch["toxic"], pa.array(at, pa.int32())], ["lang", "toxic", "at"])

    return rows.select("words", "lang", "toxic").mapInArrow(run, "lang string, toxic int, at int") \
        .groupBy("lang", "toxic", "at").agg(F.count(F.lit(1)).alias("n"))


def _counts(logits: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logit, label and count of rows over all languages: at most 2 * 2 * ``LIMIT`` * ``STEPS`` records."""
    found = sorted((r.at, r.toxic, r.n) for r in logits.groupBy("toxic", "at").agg(F.sum("n").alias("n")).collect())
    return (np.array([f[0] for f in found]) / STEPS, np.array([f[1] for f in found]), np.array([f[2] for f in found], float))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train_shards(rows: DataFrame) -> Classifier:
    """Train on (key, words, toxic, lang) rows, on all of them; their partitions are the shards."""
    rows = rows.withColumn("held", F.pmod(F.xxhash64("key", F.lit(SEED)), F.lit(4)) == 0)
    n = {(r.held, r.toxic): r["count"] for r in rows.groupBy("held", "toxic").count().collect()}
    apart = all((held, label) in n for held in (False, True) for label in (0, 1))  # else too few rows to part
    learn, check = (rows.filter("not held"), rows.filter("held")) if apart else (rows, rows)
    of = {v: n.get((False, v), 0) + (0 if apart else n.get((True, v), 0)) for v in (0, 1)}
    weights = {v: sum(of.values()) / (2 * of[v]) for v in (0, 1)}  # both classes count evenly
    network, best, kept = Network(), np.inf, None
    network.seen = {k: np.full(v.shape, 1e-4, np.float32) for k, v in network.state.items()}
    for epoch in range(max(3, min(MAX_EPOCHS, VISITS // sum(of.values())))):
        _epoch(learn, network, weights, epoch)
        z, y, m = _counts(_logits(check, network))
        loss = _loss(_sigmoid(z), y, m * np.where(y == 1, weights[1], weights[0]))
        if loss < best:
            best, kept = loss, ({k: v.copy() for k, v in network.state.items()}, (z, y, m))
    network, (z, y, m) = Network(kept[0]), kept[1]
    scale, shift = _calibrate(z, y, m)

    def threshold(table: pa.Table) -> pa.Table:
        z, y, m = (np.array(table[c]) for c in ("at", "toxic", "n"))
        enough = (m * y).sum() >= MIN_POSITIVES
        best = _threshold(_sigmoid(scale * z / STEPS + shift), m * y, m) if enough else None
        return pa.table({"lang": table["lang"][:1], "best": pa.array([best], pa.float64())})

    by_lang = _logits(check, network).groupBy(F.coalesce("lang", F.lit("")).alias("lang"), "toxic", "at") \
        .agg(F.sum("n").alias("n")).groupBy("lang").applyInArrow(threshold, "lang string, best double").filter("best is not null")
    thresholds = {r.lang: r.best for r in by_lang.collect()}
    return Classifier(network, scale, shift, thresholds=thresholds, threshold=_threshold(_sigmoid(scale * z + shift), m * y, m))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = Hashes()
    for batch in batches:
        packed = [zlib.compress(hashes.of(t.as_py()).tobytes(), 1) for t in batch["text"]]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], pa.array(packed, pa.binary()), batch["toxic"], batch["lang"]],
                                         ["doc_id", "key", "words", "toxic", "lang"])


def fit(docs: DataFrame, labels: DataFrame, per_class: int | None = None) -> Classifier:
    """Train on documents (doc_id, text, lang) with labels (doc_id, toxic): on all, or a sample of ``per_class`` of each label."""
    marked = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic is not null") \
        .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    if per_class is not None:
        return _fit_sample(docs, marked, per_class)
    bound_batches(docs.sparkSession)
    ids = marked.count()
    chosen = broadcast_if_bounded(marked, ids, BROADCAST_IDS)
    # an id may repeat: rows that repeat id and text are one
    rows = docs.select("doc_id", "text", "lang").join(chosen, "doc_id") \
        .select("doc_id", F.xxhash64(F.lit(1), "doc_id", "text", F.lit(SEED)).alias("key"), "text", "toxic", "lang")
    schema = "doc_id long, key long, words binary, toxic int, lang string"
    dealt = rows.mapInArrow(_hashed, schema).repartition(max(1, -(-ids // SHARD)), "doc_id", "key")  # the only shuffle of words
    found = save(dealt.groupBy("doc_id", "key").agg(
        F.first("toxic").alias("toxic"), F.min("lang").alias("lang"), F.first("words").alias("words")).drop("doc_id"))
    n = found.groupBy("toxic").count().collect()
    total = sum(r["count"] for r in n)
    if total <= LOCAL_ROWS or len(n) < 2:
        if len(n) < 2:  # one class, or none: no row is needed for it
            return Classifier(None, constant=float(n[0].toxic) if n else 0.0)
        return train([(_words(r.words), r.toxic, r.lang) for r in found.collect()], {0: 1.0, 1: 1.0})
    return train_shards(found)


def _fit_sample(docs: DataFrame, marked: DataFrame, per_class: int) -> Classifier:
    """Train on about ``per_class`` rows of each label, picked by a hash of the id: they may be broadcast and collected."""
    def cut(counts: list, per: int) -> tuple[dict[int, float], Column]:
        shares = {r.toxic: min(1.0, per / r["count"]) for r in counts}
        limit = F.lit(0.0)
        for label, share in shares.items():
            limit = F.when(F.col("toxic") == label, F.lit(share)).otherwise(limit)
        return shares, limit

    def draw(*of: Column) -> Column:
        return F.pmod(F.xxhash64(*of, F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)

    shares, limit = cut(marked.groupBy("toxic").count().collect(), per_class)
    chosen = F.broadcast(marked.filter(draw(F.col("doc_id")) < limit))  # about 2 * per_class ids
    # an id may repeat: its rows are counted and drawn again, those that repeat id and text as one
    rows = docs.select("doc_id", "text", "lang").join(chosen, "doc_id") \
        .withColumn("drawn", draw(F.lit(1), F.col("doc_id"), F.col("text")))
    own = ["toxic", "doc_id", "drawn"]
    again, limit = cut(rows.select(*own).distinct().groupBy("toxic").count().collect(), per_class)
    shares = {k: v * again.get(k, 1.0) for k, v in shares.items()}
    rows = rows.filter(F.col("drawn") < limit).dropDuplicates(own)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([hashes.of(t.as_py()).tobytes() for t in batch["text"]], pa.binary()),
                 batch["toxic"], batch["lang"]], ["words", "toxic", "lang"])

    found = rows.mapInArrow(hashed, "words binary, toxic int, lang string").collect()
    return train([(np.frombuffer(r.words, np.uint64), r.toxic, r.lang) for r in found], shares)


def score(docs: DataFrame, model: Classifier, text: str = "text", keep: tuple[str, ...] = ("*",),
          lang: str = "lang") -> DataFrame:
    """The ``keep`` columns as a struct ``row`` with score, threshold (of the row's language) and flagged."""
    state = model.network.state if model.network else None
    shared = docs.sparkSession.sparkContext.broadcast(
        (state, model.scale, model.shift, model.constant, model.thresholds, model.threshold))
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("body"), F.col(lang).alias("tongue"))
    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType()),
                           T.StructField("threshold", T.DoubleType()), T.StructField("flagged", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, *rest = shared.value
        model = Classifier(Network(state) if state else None, *rest)
        hashes = Hashes()
        for batch in batches:
            scores = [model.score(hashes.of(t.as_py())) for t in batch["body"]]
            cut = [model.thresholds.get(x or "", model.threshold) for x in batch["tongue"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["row"], pa.array(scores, pa.float64()), pa.array(cut, pa.float64()),
                 pa.array([s >= c for s, c in zip(scores, cut)], pa.bool_())],
                ["row", "score", "threshold", "flagged"])

    return rows.mapInArrow(run, schema)
