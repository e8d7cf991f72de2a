"""Language mixtures of documents by expectation-maximisation over byte n-grams.

Training counts hashed n-grams of every text of each language. A document is then a mixture
of languages: EM estimates the proportions from the likelihoods of its n-grams, languages are
tried from the largest proportion down, and one more is kept only while it raises the
log-likelihood by more than its penalty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.texts import LOWER, Texts, bounded_batches, eight_bytes, mix, pieces

#: Bytes of the n-grams, and the number of hashed ones in the model.
GRAMS = (2, 4)
BUCKETS = 1 << 14
#: Rounds of EM over all languages, and over each smaller set.
ROUNDS, SET_ROUNDS = 6, 4
#: Share below which a language is not tried.
LEAST_SHARE = 0.02
#: Log-likelihood that a further language has to bring, times the log of the n-grams.
PENALTY = 1.0
SMOOTHING = 0.5
UNKNOWN = "und"

#: Letters in lower case, bytes of other characters as they are, all else blank.
_LETTERS = np.array([LOWER[c] if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256)],
                    np.uint8)


def grams(texts: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size of n-gram (bucket of all n-grams, where each text's begin). What is no
    letter counts as one blank; n-grams of blanks only are left out."""
    n = len(texts.data)
    if not n:
        return [(np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)) for _ in GRAMS]
    data = _LETTERS[texts.data]
    # Runs of blanks become one.
    keep = np.ones(n, dtype=bool)
    keep[1:] = (data[1:] != 0x20) | (data[:-1] != 0x20)
    keep[texts.offsets[:-1][texts.offsets[:-1] < n]] = True
    through = np.append(0, np.cumsum(keep))
    data, offsets = data[keep], through[texts.offsets]
    view = eight_bytes(data)[:-1]
    found = []
    for size in GRAMS:
        ok = np.ones(len(data), dtype=bool)
        for k in range(1, size):                      # n-grams that would leave their text
            ok[np.maximum(offsets[1:] - k, offsets[:-1])[np.diff(offsets) > 0]] = False
        word = view & np.uint64((1 << 8 * size) - 1)
        ok &= word != np.uint64(int.from_bytes(b" " * size, "little"))
        where = np.append(0, np.cumsum(ok))[offsets]
        found.append((((mix(word[ok] + np.uint64(size << 56))) % np.uint64(BUCKETS))
                      .astype(np.int32), where))
    return found


def train(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages in order, log probability of each bucket in each of them, each language's share
    of all n-grams), from (text, lang).

    Rows without a language or a text are left out. The model has one row of ``BUCKETS``
    numbers for each language.
    """
    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for rows, texts in pieces(batch):
                langs = np.array(rows.column(1).to_pylist(), dtype=object)
                for bucket, where in grams(texts):
                    for lang in set(langs.tolist()):
                        mine = np.repeat(langs == lang, np.diff(where))
                        held[lang] = held.get(lang, 0) + np.bincount(bucket[mine],
                                                                     minlength=BUCKETS)
        for lang, counts in held.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(some), pa.string()), "bucket": pa.array(some, pa.int32()),
                "n": pa.array(counts[some], pa.int64())})

    counted = bounded_batches(docs).select("text", "lang") \
        .filter("lang IS NOT NULL AND text IS NOT NULL") \
        .mapInArrow(count, "lang string, bucket int, n bigint") \
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counted.column("lang").to_pylist()))
    number = {lang: i for i, lang in enumerate(langs)}
    table = np.full((len(langs), BUCKETS), SMOOTHING)
    rows = np.array([number[x] for x in counted.column("lang").to_pylist()], np.int64)
    if len(rows):
        table[rows, counted.column("bucket").to_numpy()] += counted.column("n").to_numpy()
    size = table.sum(1, keepdims=True)
    return langs, np.log(table / size).astype(np.float32), (size / size.sum()).ravel()


def _em(p: np.ndarray, count: np.ndarray, share: np.ndarray, rounds: int) -> np.ndarray:
    """Proportions after some rounds of EM; ``p``: likelihoods of distinct n-grams, ``count`` times
    each."""
    total = count.sum()
    for _ in range(rounds):
        share = share * ((count / (p @ share)) @ p) / total
    return share


def mixture(count: np.ndarray, logs: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Proportions of the languages in one text, 0 for those not in its set. ``logs`` and
    ``p``: of its distinct n-grams, each row of ``p`` scaled to a largest value of 1."""
    langs = p.shape[1]
    full = _em(p, count, np.full(langs, 1 / langs, np.float32), ROUNDS)
    alone = count @ logs
    best = int(alone.argmax())
    share = np.zeros(langs)
    share[best] = 1
    value = float(count @ np.log(p[:, best]))
    penalty = PENALTY * np.log(count.sum() + 1)
    rank = np.argsort(-full, kind="stable")
    for k in range(2, langs + 1):
        if full[rank[k - 1]] < LEAST_SHARE:
            break
        some = p[:, rank[:k]]
        tried = _em(some, count, full[rank[:k]] / full[rank[:k]].sum(), SET_ROUNDS)
        got = float(count @ np.log(some @ tried))
        if got - value <= penalty:
            break
        value = got
        share[:] = 0
        share[rank[:k]] = tried
    return share


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict(docs: DataFrame, langs: list[str], model: np.ndarray, prior: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score, mixture): the language with the largest proportion, that
    proportion, and all languages of the set.

    ``und`` with score 0 where the text is null or has no letter, or no language was learned.
    A text with a letter but without an n-gram, which is one ASCII letter, gets the language with
    the largest share ``prior`` and that as its score. Ties go to the language that sorts first.
    ``lang`` and ``source`` are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast((langs, model, prior))

    def guess(batches):
        langs, model, prior = sent.value
        scaled = np.exp(model - model.max(0)).T.copy() if langs else None
        logs = model.T.copy()
        for batch in batches:
            for rows, texts in pieces(batch):
                n = len(rows)
                share = np.zeros((n, len(langs)))
                lettered = np.array([_has_letter(t) for t in rows.column(1).to_pylist()], dtype=bool)
                found = grams(texts)
                for i in np.flatnonzero(lettered) if langs else ():
                    held = np.concatenate([b[w[i]:w[i + 1]] for b, w in found])
                    count = np.bincount(held, minlength=BUCKETS)
                    some = np.flatnonzero(count)
                    if len(some):
                        share[i] = mixture(count[some].astype(np.float32), logs[some], scaled[some])
                    else:
                        share[i, prior.argmax()] = prior.max()
                top = share.argmax(1) if langs else np.zeros(n, np.int64)
                score = np.clip(share[np.arange(n), top], 0, 1) if langs else np.zeros(n)
                certain = score > 0
                yield pa.RecordBatch.from_pydict({
                    "doc_id": rows.column(0),
                    "lang_pred": pa.array([langs[t] if f else UNKNOWN for t, f in zip(top, certain)],
                                          pa.string()),
                    "score": pa.array(score, pa.float64()),
                    "mixture": pa.array([{langs[i]: float(s) for i, s in enumerate(row) if s > 0}
                                         for row in share],
                                        pa.map_(pa.string(), pa.float64()))})

    return bounded_batches(docs).select("doc_id", "text").mapInArrow(
        guess, f"doc_id {kind}, lang_pred string, score double, mixture map<string,double>")


def held_out(doc_id, parts: int, part: int):
    """crc32 of the id as text, modulo ``parts``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def identify(docs: DataFrame, parts: int = 4, part: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) with a model of the rows that are not held out."""
    out = held_out(F.col("doc_id"), parts, part)
    return predict(docs, *train(docs.filter(~out))).select(
        "doc_id", out.alias("held_out"), "lang_pred", "score", "mixture")
