"""Language of whole texts by mixture inference.

Each language has a model of hashed byte n-grams within words; the likelihood of a run of RUN words is the product over its n-grams. A text
is a mixture: expectation-maximisation finds the proportions of languages that make its runs likeliest. Languages join
the set one at a time, best first, as long as the log likelihood gains more than half the log of the number of runs (the
penalty of one more proportion). The prediction is the language with the largest proportion, the score that proportion.

Runs of punctuation belong to no word. Words that repeat in a text count as often as they stand. The model has BUCKETS counts for
every learned language, and that is what comes to the driver and the tasks: it grows with languages, not documents.

Defined cases: a null text or one without a letter is ``und`` with score 0; so is every text if nothing could be learned; a text
with letters but without a word of known n-grams gets the language with most training words; ties go to the language first in
code point order; repeated rows get equal results."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factwright.llm import words as W
from factwright.llm.common import id_text

BITS = 15
BUCKETS = 1 << BITS
SIZES = (3,)  # bytes of the n-grams; a word is framed by one space byte at each side
RUN = 8  # words in a row that share a language
ROUNDS = 10
TRUST = 0.6  # power of a word's likelihood, as its n-grams overlap
SMOOTH = 0.5


def held_out():
    return F.pmod(F.crc32(id_text()), F.lit(5)) == 0


def _grams(offsets, raw):
    """(word of each n-gram, bucket, words per text as bounds) of one block."""
    w = W.split(offsets, raw, W.LETTERS, hashed=False)
    n = len(w.start)
    size = w.end - w.start + 2
    at = np.concatenate([[0], np.cumsum(size)])
    framed = np.full(at[-1], 32, np.uint64)
    inner = np.ones(at[-1], bool)
    inner[at[:-1]] = False
    inner[at[1:] - 1] = False
    framed[inner] = w.buf[W.LETTERS[w.buf]]
    word = np.repeat(np.arange(n), size)
    words, buckets = [], []
    for k in SIZES:
        if len(framed) < k:
            continue
        code = np.full(len(framed) - k + 1, k, np.uint64)
        for i in range(k):
            code = code << np.uint64(8) | framed[i : len(framed) - k + 1 + i]
        same = word[: len(code)] == word[k - 1 :]
        words.append(word[: len(code)][same])
        buckets.append(((code[same] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32))
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), w.bound
    return np.concatenate(words), np.concatenate(buckets), w.bound


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log probabilities, words) of all documents (text, lang). Counts are summed within tasks and in Spark."""

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for first, offsets, raw in W.blocks(batch.column("text")):
                word, bucket, bound = _grams(offsets, raw)
                own = langs[first : first + len(offsets) - 1]
                names = sorted(set(own))
                code = np.array([names.index(x) for x in own])
                of = code[np.searchsorted(bound, word, "right") - 1] if len(word) else np.zeros(0, np.int64)
                for i, name in enumerate(names):
                    t = total.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                    t[:BUCKETS] += np.bincount(bucket[of == i], minlength=BUCKETS)
                    t[BUCKETS] += int(np.diff(bound)[code == i].sum())
        for name, t in total.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(t[at])], names=["lang", "bucket", "n"])

    rows = docs.where("lang is not null and text is not null").select("text", "lang")
    found = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(found["lang"].unique().tolist())
    counts = np.zeros((len(names), BUCKETS + 1))
    counts[found["lang"].map(names.index).to_numpy(dtype=np.int64), found["bucket"].to_numpy()] = found["n"]
    words, counts = counts[:, BUCKETS], counts[:, :BUCKETS] + SMOOTH
    return names, np.log(counts / counts.sum(axis=1, keepdims=True)), words


def mixtures(loglik: np.ndarray, bound: np.ndarray, prior: int) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, likeliest) of languages of each text. loglik: runs by languages; text i has runs bound[i] to bound[i + 1]."""
    n, count = len(bound) - 1, np.diff(bound)
    langs = loglik.shape[1]
    some = np.flatnonzero(count)
    out = np.zeros((n, langs))
    if not len(some):
        return out, np.full(n, prior)
    of = np.repeat(np.arange(len(some)), count[some])
    starts = bound[some]
    p = np.exp(loglik - loglik.max(axis=1, keepdims=True))

    def fit(chosen):
        share = chosen / chosen.sum(axis=1, keepdims=True)
        for _ in range(ROUNDS):
            r = p * share[of]
            r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
            share = np.add.reduceat(r, starts, axis=0) / count[some][:, None]
        return share, np.add.reduceat(np.log(np.maximum((p * share[of]).sum(axis=1), 1e-300)), starts)

    alone = np.add.reduceat(np.log(np.maximum(p, 1e-300)), starts, axis=0)
    chosen = np.zeros((len(some), langs))
    chosen[np.arange(len(some)), alone.argmax(axis=1)] = 1
    share, best = chosen.copy(), alone.max(axis=1)
    full, _ = fit(np.ones((len(some), langs)))  # proportions with all languages say which to try next
    for _ in range(langs - 1):
        left = np.where(chosen > 0, -1.0, full)
        following = left.argmax(axis=1)
        tried = chosen.copy()
        tried[np.arange(len(some)), following] = 1
        new, ll = fit(tried)
        better = ll > best + 0.5 * np.log(np.maximum(count[some], 2)) + 1e-9
        if not better.any():
            break
        chosen[better], share[better], best[better] = tried[better], new[better], ll[better]
    out[some] = share
    pick = out.argmax(axis=1)
    pick[count == 0] = prior
    return out, pick


def predict(docs: DataFrame, names: list[str], logp: np.ndarray, words: np.ndarray) -> DataFrame:
    """Per document: doc_id, lang_pred, score, and mixture, the languages of its set with their proportions."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(logp)
    prior = int(words.argmax()) if len(words) else 0

    def each(batches):
        for batch in batches:
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            for first, offsets, raw in W.blocks(batch.column("text")):
                n = len(offsets) - 1
                own = letters[first : first + n]
                if names:
                    word, bucket, bound = _grams(offsets, raw)
                    runs = -(-np.diff(bound) // RUN)
                    starts = np.concatenate([[0], np.cumsum(runs)])
                    run = np.repeat(starts[:-1], np.diff(bound)) + (np.arange(bound[-1]) - np.repeat(bound[:-1], np.diff(bound))) // RUN
                    of = run[word]
                    loglik = np.stack([np.bincount(of, weights=shared.value[i][bucket], minlength=starts[-1]) for i in range(len(names))], axis=1)
                    share, pick = mixtures(TRUST * loglik, starts, prior)
                else:
                    share, pick, own = np.zeros((n, 1)), np.zeros(n, np.int64), np.zeros(n, bool)
                got = [names[k] if ok else "und" for k, ok in zip(pick, own)]
                score = np.where(own, share[np.arange(n), pick], 0.0).clip(0, 1)
                sets = [[(names[k], float(row[k])) for k in np.flatnonzero(row > 0)] if ok else [] for row, ok in zip(share, own)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, n), pa.array(got, pa.string()), pa.array(score), pa.array(sets, pa.map_(pa.string(), pa.float64()))],
                    names=["doc_id", "lang_pred", "score", "mixture"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(each, f"doc_id {kind}, lang_pred string, score double, mixture map<string, double>")
