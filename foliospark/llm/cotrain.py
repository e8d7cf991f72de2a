"""A quality classifier from two views of a document: what it says and what is known of it.

One logistic regression reads the text (which words are there, how its characters are made
up), the other the metadata (source, language, stated length). In each round either labels the
unlabelled documents it is most sure of for the other. At the end the views are calibrated and
combined on labelled documents that neither was fitted on, and every document is scored.

Fitting takes a bounded sample, the documents of least id hash: at most ``LABELLED`` with
labels and ``POOL`` without.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.texts import (BLANK_SPLIT, Texts, bounded_batches, hashes_of, mix, pieces,
                                  texts_of, words_of)

LABELLED, POOL = 4096, 2048
#: Hashed words of the text view, and hashed values of the metadata view.
BITS = 18
WORD_BUCKETS, META_BUCKETS = 1 << BITS, 1 << 12
#: Words count as a whole and by their first bytes.
PREFIXES = (5, 7)
#: A word takes part when it is in so many documents of the sample and its share among bad
#: ones is so many standard deviations from the share of all.
LEAST_DOCS, LEAST_DEVIATION = 5, 3.0
#: Rounds of exchange, and the share of the pool that a view may label in each.
ROUNDS, EXCHANGE = 3, 0.05
#: A view passes on only what it holds for this sure, after its own calibration.
SURE = 0.95
#: Share of good documents of the calibration sample that the cutoff may reject.
REJECTED_GOOD = 0.003
STEPS, PENALTY = 300, 1e-1
#: Rows of a sample that are scored at once.
BLOCK_ROWS = 512

#: Characters whose share in the text is a number of its own.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[]^_{|}~0\n"
_CLASS = np.zeros(256, np.int64)
for _i, _c in enumerate(MARKS):
    _CLASS[ord(_c)] = _i + 1
_CLASS[ord("1"):ord("9") + 1] = _CLASS[ord("0")]
_CLASS[ord("A"):ord("Z") + 1] = len(MARKS) + 1
NUMBERS = len(MARKS) + 1 + 3


class Features:
    """Sparse rows: ``index`` and ``value`` of each row from ``first`` on."""

    def __init__(self, first: np.ndarray, index: np.ndarray, value: np.ndarray, size: int):
        self.first, self.size = first, size
        self.index, self.value = index.astype(np.int32), value.astype(np.float32)
        self.row = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))

    def __len__(self) -> int:
        return len(self.first) - 1

    def dot(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self))
        for at in range(0, len(self), BLOCK_ROWS):       # what is made on the way stays small
            end = min(at + BLOCK_ROWS, len(self))
            part = slice(int(self.first[at]), int(self.first[end]))
            out[at:end] = np.bincount(self.row[part] - np.int32(at),
                                      self.value[part] * weights[self.index[part]], end - at)
        return out

    def back(self, rows: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, self.value * rows[self.row], self.size)

    @staticmethod
    def stack(parts: list[Features]) -> Features:
        sizes = np.concatenate([np.diff(p.first) for p in parts])
        return Features(np.append(0, np.cumsum(sizes)), np.concatenate([p.index for p in parts]),
                        np.concatenate([p.value for p in parts]), parts[0].size)


def text_features(texts: Texts) -> Features:
    """Words that are there (1 each) and numbers of the characters, as one sparse row."""
    n = len(texts)
    words = words_of(texts.lower(), ~_PUNCTUATION & BLANK_SPLIT)
    keys = [words.hashes]
    for size in PREFIXES:
        keys.append(hashes_of(texts.lower().data, words.starts,
                              np.minimum(words.ends, words.starts + size)) + np.uint64(size))
    owner = words.texts() << BITS
    key = np.unique(np.concatenate([owner | (k & np.uint64(WORD_BUCKETS - 1)).astype(np.int64)
                                    for k in keys]))
    word_row, word = key >> BITS, key & (WORD_BUCKETS - 1)
    text = np.repeat(np.arange(n), texts.sizes())
    width = len(MARKS) + 2
    held = np.bincount(text * width + _CLASS[texts.data], minlength=n * width).reshape(n, width)
    size = np.maximum(texts.sizes(), 1)
    count = words.counts()
    numbers = np.column_stack([
        np.log1p(1000 * held[:, 1:] / size[:, None]) / 2, np.log1p(count) / 5,
        np.log1p(texts.sizes() / np.maximum(count, 1)),
        np.bincount(word_row, minlength=n) / np.maximum(3 * count, 1)])
    row = np.concatenate([word_row, np.repeat(np.arange(n), NUMBERS)])
    index = np.concatenate([word, np.tile(np.arange(NUMBERS) + WORD_BUCKETS, n)])
    value = np.concatenate([np.ones(len(word)), numbers.ravel()])
    by = np.argsort(row, kind="stable")
    return Features(np.searchsorted(row[by], np.arange(n + 1)), index[by], value[by],
                    WORD_BUCKETS + NUMBERS)


_PUNCTUATION = np.array([c < 0x80 and not chr(c).isalnum() for c in range(256)])


def meta_features(rows: pa.RecordBatch) -> Features:
    """Source, language, their pair and the stated length in steps; null is a value."""
    n = len(rows)
    source, lang = rows.column("source").to_pylist(), rows.column("lang").to_pylist()
    length = [-1 if v is None else max(int(v), 0).bit_length() for v in
              rows.column("n_chars").to_pylist()]
    names = [f"{k}" for s, g, c in zip(source, lang, length)
             for k in (("s", s), ("g", g), ("c", c), ("sg", s, g))]
    column = texts_of(pa.array(names, pa.string()))
    index = (hashes_of(column.data, column.offsets[:-1], column.offsets[1:])
             % np.uint64(META_BUCKETS)).astype(np.int64)
    return Features(np.arange(n + 1) * 4, index, np.ones(4 * n), META_BUCKETS)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def telling(features: Features, target: np.ndarray, always: int) -> Features:
    """Only the features that go with the target, and those from ``always`` on."""
    n, bad = len(target), float((1 - target).sum())
    there = np.bincount(features.index, minlength=features.size)
    among_bad = np.bincount(features.index, (1 - target)[features.row], features.size)
    share = bad / n
    spread = np.sqrt(there * share * (1 - share) * (1 - np.minimum(there, n) / n) + 1e-9)
    use = (there >= LEAST_DOCS) & (np.abs(among_bad - there * share) > LEAST_DEVIATION * spread)
    use[always:] = True
    keep = use[features.index]
    return Features(np.append(0, np.cumsum(np.bincount(features.row[keep], minlength=n))),
                    features.index[keep], features.value[keep], features.size)


class Logistic:
    """Logistic regression by full gradient steps with AdaGrad; classes weigh the same.
    Features before ``always`` take part only if they go with the target."""

    def __init__(self, size: int, always: int = 0):
        self.weights, self.bias, self.always = np.zeros(size), 0.0, always

    def fit(self, features: Features, target: np.ndarray) -> Logistic:
        self.weights[:], self.bias = 0, 0.0
        if self.always:
            features = telling(features, target, self.always)
        share = np.clip(target.mean(), 1e-6, 1 - 1e-6)
        weight = np.where(target == 1, 0.5 / share, 0.5 / (1 - share)) / len(target)
        squares, bias_squares = np.full(len(self.weights), 1e-12), 1e-12
        for _ in range(STEPS):
            error = weight * (sigmoid(self.score(features)) - target)
            gradient = features.back(error) + PENALTY * self.weights / len(self.weights) ** 0.5
            squares += gradient * gradient
            self.weights -= 0.1 * gradient / np.sqrt(squares)
            bias_squares += error.sum() ** 2
            self.bias -= 0.1 * error.sum() / bias_squares ** 0.5
        return self

    def score(self, features: Features) -> np.ndarray:
        return features.dot(self.weights) + self.bias


def calibrate(scores: np.ndarray, target: np.ndarray) -> np.ndarray:
    """(weights..., bias) of a logistic map of standardised columns of scores."""
    middle, scale = scores.mean(0), scores.std(0) + 1e-9
    x = np.column_stack([(scores - middle) / scale, np.ones(len(scores))])
    w = np.zeros(x.shape[1])
    goal = target * (1 - 2e-3) + 1e-3
    for _ in range(50):                               # Newton steps
        p = sigmoid(x @ w)
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, x.T @ (p - goal) + 1e-2 * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] / scale) @ middle)


class CoTrained:
    """Both views with their calibration and the cutoff."""

    def __init__(self, views: list[Logistic], combine: np.ndarray, cutoff: float):
        self.views, self.combine, self.cutoff = views, combine, cutoff

    def score(self, features: list[Features]) -> np.ndarray:
        scores = np.column_stack([v.score(f) for v, f in zip(self.views, features)])
        return sigmoid(scores @ self.combine[:-1] + self.combine[-1])


def _rows(features: Features, rows: np.ndarray) -> Features:
    size = np.diff(features.first)[rows]
    shift = (features.first[:-1][rows] - np.cumsum(size) + size).astype(np.int32)
    at = np.repeat(shift, size)
    at += np.arange(len(at), dtype=np.int32)
    return Features(np.append(0, np.cumsum(size)), features.index[at], features.value[at],
                    features.size)


def co_train(labelled: list[Features], target: np.ndarray, pool: list[Features],
             rounds: int = ROUNDS) -> CoTrained | None:
    """``labelled`` and ``pool``: the two views. None without documents of both classes. A
    quarter of the labelled ones is kept for calibration."""
    if len(set(target.tolist())) < 2:
        return None
    held = np.arange(len(target)) % 4 == 3
    if len(set(target[held].tolist())) < 2 or len(set(target[~held].tolist())) < 2:
        held = np.zeros(len(target), dtype=bool)
    fit, check = np.flatnonzero(~held), np.flatnonzero(held if held.any() else ~held)
    taken = [np.zeros(0, np.int64)] * 2               # pool rows that each view learns from
    given = [np.zeros(0)] * 2
    views = [Logistic(labelled[0].size, WORD_BUCKETS), Logistic(labelled[1].size)]
    for turn in range(rounds + 1):
        for k, view in enumerate(views):
            parts = [_rows(labelled[k], fit)]
            if len(taken[k]):
                parts.append(_rows(pool[k], taken[k]))
            view.fit(parts.pop() if len(parts) == 1 else Features.stack(parts),
                     np.concatenate([target[fit], given[k]]))
        if turn == rounds or not len(pool[0]):
            break
        for k, view in enumerate(views):
            one = calibrate(view.score(_rows(labelled[k], check))[:, None], target[check])
            p = sigmoid(view.score(pool[k]) * one[0] + one[1])
            other = 1 - k
            free = np.setdiff1d(np.flatnonzero(np.maximum(p, 1 - p) >= SURE), taken[other])
            best = free[np.argsort(-np.abs(p[free] - 0.5), kind="stable")]
            best = best[:int(EXCHANGE * len(p))]
            taken[other] = np.append(taken[other], best)
            given[other] = np.append(given[other], (p[best] > 0.5).astype(float))
    scores = np.column_stack([v.score(_rows(f, check)) for v, f in zip(views, labelled)])
    combine = calibrate(scores, target[check])
    good = np.sort(sigmoid(scores @ combine[:-1] + combine[-1])[target[check] == 1])
    cutoff = min(0.5, float(good[int(REJECTED_GOOD * len(good))]))
    return CoTrained(views, combine, cutoff)


_SAMPLE = "doc_id bigint, good int, view int, feature array<int>, value array<float>"


def _sample_features(batches):
    for batch in batches:
        for rows, texts in pieces(batch):
            for k, f in enumerate((text_features(texts), meta_features(rows))):
                first = pa.array(f.first.astype(np.int32))
                numbers = f.index >= WORD_BUCKETS        # all other features count as 1
                of = np.append(0, np.cumsum(numbers, dtype=np.int32))[f.first].astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    rows.column(0), rows.column(rows.schema.get_field_index("good")),
                    pa.array(np.full(len(rows), k, np.int32)),
                    pa.ListArray.from_arrays(first, pa.array(f.index.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(of), pa.array(f.value[numbers]))],
                    names=["doc_id", "good", "view", "feature", "value"])


def _sample(part: pa.Table, view: int) -> Features:
    """The rows of one view of the sample. Words of fewer documents than any fit asks for stay
    out: their weight would be 0."""
    lists = part.column("feature").chunks
    size = np.concatenate([np.zeros(0, np.int64), *(
        pc.list_value_length(c).to_numpy(zero_copy_only=False) for c in lists)]).astype(np.int64)
    index = np.concatenate([np.zeros(0, np.int32), *(c.flatten().to_numpy() for c in lists)])
    value = np.ones(len(index), np.float32)
    value[index >= WORD_BUCKETS] = np.concatenate([np.zeros(0, np.float32), *(
        c.flatten().to_numpy() for c in part.column("value").chunks)])
    width = (WORD_BUCKETS + NUMBERS, META_BUCKETS)[view]
    if view == 0:
        use = np.bincount(index, minlength=width) >= LEAST_DOCS
        use[WORD_BUCKETS:] = True
        keep = use[index]
        ends = np.append(0, np.cumsum(keep, dtype=np.int32))[np.append(0, np.cumsum(size))]
        index, value, size = index[keep], value[keep], np.diff(ends)
    return Features(np.append(0, np.cumsum(size)).astype(np.int64), index, value, width)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED,
        pool: int = POOL) -> CoTrained | None:
    """A document is good when a label says quality 1 and none says quality 0 or toxic 1."""
    known = labels.select("doc_id", "quality", "toxic") \
        .filter("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)") \
        .groupBy("doc_id").agg(F.min(
            F.when((F.coalesce("quality", F.lit(1)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1)
            .otherwise(0)).alias("good"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    others = docs.select("doc_id").filter("doc_id IS NOT NULL").distinct() \
        .join(known, "doc_id", "left_anti").orderBy(F.xxhash64("doc_id"), "doc_id").limit(pool)
    # At most ``labelled`` + ``pool`` ids.
    ids = chosen.unionAll(others.select("doc_id", F.lit(None).cast("int").alias("good")))
    rows = bounded_batches(docs).select("doc_id", "text", "lang", "source", "n_chars") \
        .join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]) \
        .mapInArrow(_sample_features, _SAMPLE).toArrow()
    views = [[], []]
    targets = None
    for k in (1, 0):                                  # the small view first: its rows go away
        part = rows.filter(pc.equal(rows.column("view"), k))
        if k == 1:
            rows = rows.filter(pc.equal(rows.column("view"), 0))
        else:
            del rows
        good = np.array([-1 if g is None else g for g in part.column("good").to_pylist()], np.int64)
        by_id = np.argsort(part.column("doc_id").to_numpy(), kind="stable")
        every = _sample(part, k)
        del part
        by_hash = by_id[np.argsort(mix(np.arange(len(good)).astype(np.uint64)), kind="stable")]
        with_label = by_hash[good[by_hash] >= 0]
        views[k] = [_rows(every, with_label), _rows(every, by_id[good[by_id] < 0])]
        targets = good[with_label]
        del every
    return co_train([v[0] for v in views], targets, [v[1] for v in views])


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The table with score (0 to 1, higher is better) and kept.

    A null text is an empty one; null metadata is a value of its own. Without labels of both
    classes nothing is learned: every score is 1 and every document kept. Other columns of
    any name stay as they are, but for ``score`` and ``kept``.
    """
    docs = bounded_batches(docs.drop("score", "kept"))
    model = fit(docs, labels)
    if model is None:
        return docs.withColumns({"score": F.lit(1.0), "kept": F.lit(True)})
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        m = sent.value
        for batch in batches:
            for rows, texts in pieces(batch):
                score = m.score([text_features(texts), meta_features(rows)])
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(score), pa.array(score >= m.cutoff)],
                    names=[*rows.schema.names, "score", "kept"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()),
                           T.StructField("kept", T.BooleanType())])
    return docs.mapInArrow(judge, schema)
