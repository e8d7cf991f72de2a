"""A log-bilinear language model over word classes, trained with noise-contrastive estimation.

Counts of all training words give the smoothed unigram base. The model predicts the class of
the next word from the classes of the two before it: each frequent word (and the end of a
text) is a class of its own, all others fall into classes by their hash. The prediction is
bilinear, score(c | a, b) = (A[a] + B[b]) . R[c] + bias[c], and normalised exactly: the
normalisers of all contexts come from batched matrix products. Within its class a word has its
smoothed share of the counts, so the log-probabilities of known words and of one unknown word
for each class add up to one.

Training runs where the text is: every partition of the training rows makes its own pass of
minibatch gradient steps and the parameters are averaged, weighted by tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.langmix import held_out
from foliospark.llm.texts import BLANK_SPLIT, Texts, bounded_batches, mix, pieces, words_of
from foliospark.session import stored

#: Classes of one frequent word each, and classes of all other words.
FREQUENT, RARE = 191, 64
#: Words whose counts every task holds; counts of the others are joined.
COMMON = 1 << 16
DIMENSIONS = 16
#: Training: tokens of a step, noise classes of a step, step size, passes over a piece.
STEP_TOKENS, NOISE, RATE, PASSES = 1024, 64, 0.1, 1
LN10 = float(np.log(10))

#: Class of the end of a text, and of the start of one; hashed words count as themselves.
END, START = 0, FREQUENT + RARE + 1
CLASSES = FREQUENT + RARE + 1


def token_hashes(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text)."""
    words = words_of(texts.lower(), BLANK_SPLIT)
    return words.hashes.view(np.int64), words.first


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts; the word is its 64-bit hash."""
    def count(batches):
        for batch in batches:
            for _, texts in pieces(batch, size=4 << 20):
                word, n = np.unique(token_hashes(texts)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n, pa.int64())],
                                                 names=["word", "n"])

    return bounded_batches(docs).select("text").mapInArrow(count, "word bigint, n bigint") \
        .groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """What every task knows: the common words' counts and the class of any word."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, classes: np.ndarray):
        by = np.argsort(words)
        self.words, self.counts, self.classes = words[by], counts[by], classes[by]

    def look_up(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, count or -1 where the word is not common) of each word."""
        hashed = (mix(word.view(np.uint64)) % np.uint64(RARE)).astype(np.int64) + FREQUENT + 1
        if not len(self.words):
            return hashed, np.full(len(word), -1)
        at = np.searchsorted(self.words, word)
        at[at == len(self.words)] = 0
        known = self.words[at] == word
        return (np.where(known, self.classes[at], hashed), np.where(known, self.counts[at], -1))


def build_vocabulary(counts: DataFrame) -> Vocabulary:
    """The ``COMMON`` most frequent words, ties by hash; the first ``FREQUENT`` are classes."""
    top = counts.orderBy(F.desc("n"), "word").limit(COMMON).toArrow()
    word, n = top.column("word").to_numpy(), top.column("n").to_numpy()
    rank = np.lexsort([word, -n])
    classes = (mix(word.view(np.uint64)) % np.uint64(RARE)).astype(np.int64) + FREQUENT + 1
    classes[rank[:FREQUENT]] = np.arange(len(rank[:FREQUENT])) + 1
    return Vocabulary(word.copy(), n.copy(), classes)


def _streams(texts: Texts, vocabulary: Vocabulary):
    """Classes of all tokens of some texts, each text closed by its end, with the classes of
    the two tokens before; and the words' hashes and counts."""
    word, first = token_hashes(texts)
    kind, count = vocabulary.look_up(word)
    n = len(texts)
    place = np.arange(len(word)) + np.repeat(np.arange(n), np.diff(first))
    target = np.full(len(word) + n, END)
    target[place] = kind
    begin = first + np.arange(n + 1)
    one = np.append(START, target[:-1])
    two = np.append([START, START], target[:-2])[:len(target)]
    one[begin[:-1]] = START
    two[begin[:-1]] = START
    second = begin[:-1] + 1
    two[second[second < begin[1:]]] = START
    return target, one, two, begin, word, first, count


class Model:
    """Parameters of the bilinear form; ``bias`` starts at the log of the class frequencies."""

    SHAPES = ((CLASSES + 1, DIMENSIONS), (CLASSES + 1, DIMENSIONS), (CLASSES, DIMENSIONS),
              (CLASSES,))

    def __init__(self, parts: list[np.ndarray]):
        self.A, self.B, self.R, self.bias = parts

    @classmethod
    def start(cls, frequency: np.ndarray) -> Model:
        rng = np.random.default_rng(7)
        parts = [rng.normal(0, 0.1, s).astype(np.float32) for s in cls.SHAPES[:3]]
        return cls([*parts, np.log(frequency).astype(np.float32)])

    @classmethod
    def unpacked(cls, flat: np.ndarray) -> Model:
        ends = np.cumsum([int(np.prod(s)) for s in cls.SHAPES])
        return cls([f.reshape(s).astype(np.float32) for f, s in
                    zip(np.split(flat, ends[:-1]), cls.SHAPES)])

    def packed(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in (self.A, self.B, self.R, self.bias)])

    def normalisers(self) -> np.ndarray:
        """Log of the sum over all classes, for every pair of classes before."""
        out = np.empty((CLASSES + 1, CLASSES + 1), np.float32)
        for a in range(CLASSES + 1):                  # one matrix product for each class before
            scores = (self.A[a] + self.B) @ self.R.T + self.bias
            top = scores.max(1, keepdims=True)
            out[a] = np.log(np.exp(scores - top).sum(1)) + top[:, 0]
        return out

    def log_prob(self, one, two, target, normalisers) -> np.ndarray:
        score = np.einsum("ij,ij->i", self.A[one] + self.B[two], self.R[target])
        return score + self.bias[target] - normalisers[one, two]


class Trainer:
    """Gradient steps with AdaGrad; one set of noise classes serves a whole step."""

    def __init__(self, model: Model, noise: np.ndarray, seed: int):
        self.model, self.noise = model, noise
        self.rng = np.random.default_rng(seed)
        self.seen = [np.full(p.shape[0], 1e-2, np.float32)
                     for p in (model.A, model.B, model.R, model.bias)]

    def _move(self, k: int, part: np.ndarray, rows: np.ndarray, gradient: np.ndarray) -> None:
        order = np.argsort(rows, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(rows[order]) != 0))
        at = rows[order[first]]
        total = np.add.reduceat(gradient[order], first, axis=0)
        size = np.diff(np.append(first, len(rows)))
        square = (total * total).mean(1) if total.ndim > 1 else total * total
        self.seen[k][at] += square / size
        scale = RATE / np.sqrt(self.seen[k][at] * size)
        part[at] += total * (scale[:, None] if total.ndim > 1 else scale)

    def step(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> None:
        m, q = self.model, self.noise
        drawn = self.rng.choice(CLASSES, NOISE, p=q)
        context = m.A[one] + m.B[two]
        # Real against noise: the model's score less the log of the expected noise.
        true = np.einsum("ij,ij->i", context, m.R[target]) + m.bias[target] \
            - np.log(NOISE * q[target]).astype(np.float32)
        false = context @ m.R[drawn].T + m.bias[drawn] - np.log(NOISE * q[drawn]).astype(np.float32)
        up = 1 / (1 + np.exp(np.clip(true, -30, 30)))
        down = -1 / (1 + np.exp(-np.clip(false, -30, 30)))
        to_context = up[:, None] * m.R[target] + down @ m.R[drawn]
        to_drawn = down.T @ context
        rows = np.concatenate([target, drawn])
        to_rows = np.concatenate([up[:, None] * context, to_drawn])
        to_bias = np.concatenate([up, down.sum(0)])
        self._move(0, m.A, one, to_context)
        self._move(1, m.B, two, to_context)
        self._move(2, m.R, rows, to_rows)
        self._move(3, m.bias, rows, to_bias)


def train(docs: DataFrame, vocabulary: Vocabulary, frequency: np.ndarray,
          passes: int = PASSES) -> Model:
    """The average of the models of all partitions of (text), weighted by their tokens."""
    start = Model.start(frequency)
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, start.packed(), frequency))

    def fit(batches):
        vocabulary, flat, frequency = sent.value
        trainer = Trainer(Model.unpacked(flat), frequency, 11)
        tokens = 0
        for batch in batches:
            for _, texts in pieces(batch):
                target, one, two, *_ = _streams(texts, vocabulary)
                for _ in range(passes):
                    order = trainer.rng.permutation(len(target))
                    for at in range(0, len(order), STEP_TOKENS):
                        rows = order[at:at + STEP_TOKENS]
                        trainer.step(one[rows], two[rows], target[rows])
                tokens += len(target)
        if tokens:
            flat = trainer.model.packed().astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat * tokens),
                 pa.array(np.full(len(flat), tokens), pa.int64())], names=["at", "v", "n"])

    rows = bounded_batches(docs).select("text").mapInArrow(fit, "at int, v double, n bigint") \
        .groupBy("at").agg((F.sum("v") / F.sum("n")).alias("v")).toArrow()
    flat = start.packed().astype(np.float64)
    flat[rows.column("at").to_numpy()] = rows.column("v").to_numpy()
    return Model.unpacked(flat)


def score(docs: DataFrame, training, passes: int = PASSES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row.

    ``training`` is a condition on the rows to learn from. Every text, a null or empty one as
    well, has one end token. Rows may share a doc_id. Without training rows nothing is known:
    all counts are 0 and the model knows the class frequencies only.
    """
    docs = bounded_batches(docs).select("doc_id", "text", training.alias("learn"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    learn = docs.filter("learn")
    counts = stored(count_words(learn), "counts")
    ends = learn.count()
    words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, types = words + ends, distinct + (ends > 0)
    vocabulary = build_vocabulary(counts)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def classed(batches):
        for batch in batches:
            word, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at, _ = sent.value.look_up(word)
            yield pa.RecordBatch.from_pydict({
                "class": pa.array(np.arange(CLASSES), pa.int32()),
                "mass": pa.array(np.bincount(at, n + 0.5, CLASSES))})

    # Mass of each class: its words' smoothed counts, and half a count for an unknown one.
    mass = np.full(CLASSES, 0.5)
    mass[END] += ends
    for at, m in counts.select("word", "n").mapInArrow(classed, "class int, mass double") \
            .groupBy("class").agg(F.sum("mass")).collect():
        mass[at] += m
    model = train(learn, vocabulary, mass / mass.sum(), passes)
    tables = docs.sparkSession.sparkContext.broadcast((model, model.normalisers(), np.log(mass)))
    base = float(np.log(tokens + 0.5 * (types + 1)))

    def scored(batches):
        model, normalisers, log_mass = tables.value
        row = 0
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        for batch in batches:
            for rows, texts in pieces(batch):
                target, one, two, begin, word, first, count = _streams(texts, sent.value)
                n = len(rows)
                log_class = model.log_prob(one, two, target, normalisers) - log_mass[target]
                text = np.repeat(np.arange(n), np.diff(begin))
                value = np.bincount(text, log_class, n)
                of = np.repeat(np.arange(n), np.diff(first))
                common = count >= 0
                held = np.bincount(of[common], np.log(count[common] + 0.5), n) + np.log(ends + 0.5)
                known = np.bincount(of[common], minlength=n) + (ends > 0)
                numbers = (np.int64(part) << 40) + row + np.arange(n)
                row += n
                yield pa.RecordBatch.from_arrays([
                    pa.array(numbers), rows.column(0), rows.column(2),
                    pa.array(np.diff(begin), pa.int64()), pa.array(known, pa.int64()),
                    pa.array(held), pa.array(value), pa.nulls(n, pa.int64()),
                    pa.array(np.ones(n, np.int64))], names=_NAMES)
                # The other words of each text, once each, for the join with the counts.
                rare = np.flatnonzero(~common)
                by = rare[np.lexsort([word[rare], of[rare]])]
                head = np.append(True, (np.diff(of[by]) != 0) | (word[by][1:] != word[by][:-1])) \
                    if len(by) else np.zeros(0, bool)
                at = np.flatnonzero(head)
                if len(at):
                    m = len(at)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(numbers[of[by[at]]]), pa.nulls(m, rows.schema.field(0).type),
                        pa.nulls(m, pa.bool_()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()),
                        pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()),
                        pa.array(word[by[at]]),
                        pa.array(np.diff(np.append(at, len(by))), pa.int64())], names=_NAMES)

    parts = stored(docs.select("doc_id", "text", "learn").mapInArrow(
        scored, f"row bigint, doc_id {kind}, learn boolean, n_tokens bigint, known bigint, "
                "held double, value double, word bigint, n bigint"), "scored")
    rare = parts.filter("word IS NOT NULL").select("row", "word", F.col("n").alias("times")) \
        .join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("found"))
    held = F.col("held") + F.coalesce("more", F.lit(0.0))
    return parts.filter("word IS NULL").drop("word", "n").join(rare, "row", "left").select(
        "doc_id", (~F.col("learn")).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        ((held - F.col("n_tokens") * base) / LN10).alias("base_score"),
        ((held + F.col("value")) / LN10).alias("score"))


_NAMES = ["row", "doc_id", "learn", "n_tokens", "known", "held", "value", "word", "n"]


def score_documents(docs: DataFrame) -> DataFrame:
    return score(docs, ~held_out(F.col("doc_id"), 5, 1))
