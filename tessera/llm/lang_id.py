"""Language identification by interpolated Kneser-Ney character models.

One model per language is learned from a bounded sample of labelled documents (`per_language` documents each,
chosen by a hash; the rest of the corpus only enters by being scored). n-gram counts are made in Spark; their
probabilities in all languages are stored in sorted hash arrays: keys in order, with an index on their leading
bits, beside rows of one log-probability per language. A document's language is the one of lowest
length-normalised cross-entropy over its whole text.

The score is the share of the best language when cross-entropies are turned into odds, with a temperature fitted
on sample documents that were kept out of the counts; these, and the same with their letters shuffled, also set, per
language, the cross-entropy beyond which a document is rejected as none of the languages. Defined cases: a null text or one without letters is `und` with score 0
and is rejected; without labelled documents everything is `und`; ties go to the language that sorts first;
unlabelled documents are scored like others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_texts, table

ORDER = 4
#: Bound of the sample that models are fitted on, and the share of it that calibrates.
PER_LANGUAGE, CALIBRATE = 400, 0.25
#: A document is rejected when its cross-entropy is this far on the way from its language's mean to that of shuffled letters.
REJECT = 0.6
_MIX = np.uint64(0x9E3779B97F4A7C15)

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space for what is no letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((ord(chr(c).lower()[0]) if chr(c).isalpha() else 32 for c in range(0x110000)), np.uint32, 0x110000)
    return _letters


def normal(text: str) -> np.ndarray:
    """Lower-case letters with one space between words and one at either end; empty without letters."""
    codes = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = codes == 32
    codes = codes[~(space & np.concatenate(([True], space[:-1])))]
    if len(codes) and codes[-1] == 32:
        codes = codes[:-1]
    return np.concatenate(([32], codes, [32])).astype(np.uint64) if len(codes) else np.zeros(0, np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def keys_of(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that ends at each position from n - 1 on."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(m, n, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x5851F42D4C957F2D) + codes[i : i + m]
    return _mixed(h)


def ngrams(codes: np.ndarray, n: int) -> list[tuple]:
    """Distinct n-grams (as code points) and their counts."""
    m = len(codes) - n + 1
    if m <= 0:
        return []
    grams, counts = np.unique(np.stack([codes[i : i + m] for i in range(n)], 1), axis=0, return_counts=True)
    return list(zip(map(tuple, grams.tolist()), counts.tolist()))


def kneser_ney(counts: dict[tuple, int], order: int) -> tuple[dict[tuple, float], dict[tuple, float]]:
    """Interpolated probabilities of all n-grams up to `order` that occur, and back-off weights of all contexts.

    counts: n-grams of the highest order. Lower orders count the different characters before an n-gram.
    """
    levels = {order: dict(counts)}
    for n in range(order - 1, 0, -1):
        lower: dict[tuple, int] = {}
        for gram in levels[n + 1]:
            lower[gram[1:]] = lower.get(gram[1:], 0) + 1
        levels[n] = lower
    prob: dict[tuple, float] = {}
    weight: dict[tuple, float] = {}
    for n in range(1, order + 1):
        level = levels[n]
        ones = sum(1 for c in level.values() if c == 1)
        twos = sum(1 for c in level.values() if c == 2)
        discount = min(max(ones / (ones + 2 * twos), 0.1), 0.9) if ones else 0.5
        total: dict[tuple, int] = {}
        kinds: dict[tuple, int] = {}
        for gram, c in level.items():
            total[gram[:-1]] = total.get(gram[:-1], 0) + c
            kinds[gram[:-1]] = kinds.get(gram[:-1], 0) + 1
        for context, t in total.items():
            weight[context] = discount * kinds[context] / t
        if n == 1:
            weight[()] = max(weight.get((), 1.0), 1e-3)
        for gram, c in level.items():
            below = prob[gram[1:]] if n > 1 else 1.0 / (len(level) + 1)
            prob[gram] = max(c - discount, 0.0) / total[gram[:-1]] + weight[gram[:-1]] * below
    return prob, weight


class HashArrays:
    """Rows of numbers by 64-bit key: keys sorted, with an index on their leading bits."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.rows = keys[order], rows[order]
        self.shift = np.uint64(64 - max(8, int(len(keys)).bit_length() + 2))
        heads = (self.keys >> self.shift).astype(np.int64)
        self.first = np.searchsorted(heads, np.arange((1 << int(64 - self.shift)) + 1)).astype(np.int32)
        self.keys = np.append(self.keys, np.uint64(0))  # so that a probe past the end reads something

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        at = self.first[(keys >> self.shift).astype(np.int64)]
        out = np.where(self.keys[at] == keys, at, -1)
        open_ = np.flatnonzero(self.keys[at] < keys)
        while len(open_):
            open_ = open_[at[open_] < len(self.keys) - 1]
            at[open_] += 1
            now = self.keys[at[open_]]
            hit = (now == keys[open_]) & (at[open_] < len(self.rows))
            out[open_[hit]] = at[open_[hit]]
            open_ = open_[(now < keys[open_]) & (at[open_] < len(self.keys) - 1)]
        out[out >= len(self.rows)] = -1
        return out


class Models:
    """Character models of all languages, and their calibration."""

    def __init__(self, langs: list[str], counts: list[dict[tuple, int]], order: int = ORDER):
        self.langs, self.order = langs, order
        self.temperature = np.float64(10.0)
        self.limit = np.full(len(langs), np.inf)
        fitted = [kneser_ney(c, order) for c in counts]
        grams = sorted(set().union(*(p for p, _ in fitted)))
        contexts = sorted(set().union(*(w for _, w in fitted)))
        unseen = [w.get((), 1.0) / (sum(len(g) == 1 for g in p) + 1) for p, w in fitted]

        def prob(i: int, gram: tuple) -> float:
            p, w = fitted[i]
            if gram in p:
                return p[gram]
            return w.get(gram[:-1], 1.0) * prob(i, gram[1:]) if len(gram) > 1 else unseen[i]

        self.log_unseen = np.log(np.array(unseen, np.float64))
        self.grams, self.contexts = [], []
        for n in range(order + 1):
            own = [g for g in grams if len(g) == n]
            self.grams.append(HashArrays(_keys(own, n), np.log(np.array([[prob(i, g) for i in range(len(langs))] for g in own]).reshape(len(own), len(langs)))))
            own = [c for c in contexts if len(c) == n]
            self.contexts.append(HashArrays(_keys(own, n), np.log(np.array([[w.get(c, 1.0) for _, w in fitted] for c in own]).reshape(len(own), len(langs)))))

    def cross_entropy(self, docs: list[np.ndarray]) -> np.ndarray:
        """Nats a character of each document (as from normal(), not empty) in each language."""
        n, pad = self.order, np.full(self.order - 2, 32, np.uint64)
        codes = np.concatenate([x for d in docs for x in (pad, d)])
        # positions whose character is predicted: all of a document but its leading space
        size = np.array([len(d) for d in docs])
        ends = np.cumsum(size + len(pad))
        counted = np.ones(len(codes), bool)
        starts = ends - size - len(pad)
        for k in range(len(pad) + 1):
            counted[starts + k] = False
        at = np.flatnonzero(counted)
        total = np.zeros((len(at), len(self.langs)))
        open_ = np.arange(len(at))
        for k in range(n, 0, -1):
            ends_at = at[open_]
            row = self.grams[k].find(keys_of(codes, k)[ends_at - k + 1])
            hit = row >= 0
            total[open_[hit]] += self.grams[k].rows[row[hit]]
            open_, ends_at = open_[~hit], ends_at[~hit]
            if not len(open_):
                break
            if k > 1:  # the context's weight, where the context is known
                row = self.contexts[k - 1].find(keys_of(codes, k - 1)[ends_at - k + 1])
                known = row >= 0
                total[open_[known]] += self.contexts[k - 1].rows[row[known]]
        total[open_] += self.log_unseen
        sums = np.add.reduceat(total, np.concatenate(([0], np.cumsum(size - 1)[:-1])), axis=0)
        return -sums / (size - 1)[:, None]

    def calibrate(self, docs: list[tuple[str, np.ndarray]]) -> None:
        """Temperature by likelihood, and each language's limit of rejection, from documents of known language and the same with their letters shuffled."""
        docs = [(lang, d) for lang, d in docs if len(d) and lang in self.langs]
        if not docs:
            return
        h = self.cross_entropy([d for _, d in docs])
        true = np.array([self.langs.index(lang) for lang, _ in docs])
        rows = np.arange(len(true))
        grid = 2.0 ** np.arange(0, 7.5, 0.5)
        self.temperature = grid[np.argmax([np.log(_share(h, t)[rows, true] + 1e-12).sum() for t in grid])]
        rng = np.random.default_rng(1)
        noise = self.cross_entropy([np.concatenate((d[:1], rng.permutation(d[1:]))) for _, d in docs]).min(1)
        for i in range(len(self.langs)):
            if (true == i).sum() >= 10:
                usual = np.median(h[true == i, i])
                self.limit[i] = usual + REJECT * max(np.median(noise[true == i]) - usual, 0.5)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) of each text."""
        docs = [normal(t or "") for t in texts]
        some = [i for i, d in enumerate(docs) if len(d)] if self.langs else []
        out = [("und", 0.0, True)] * len(docs)
        if some:
            h = self.cross_entropy([docs[i] for i in some])
            best = h.argmin(1)
            score = _share(h, self.temperature)[np.arange(len(some)), best]
            far = h[np.arange(len(some)), best] > self.limit[best]
            for i, b, s, f in zip(some, best.tolist(), score.tolist(), far.tolist()):
                out[i] = (self.langs[b], min(max(s, 0.0), 1.0), f)
        return out


def _keys(grams: list[tuple], n: int) -> np.ndarray:
    h = np.full(len(grams), n, np.uint64)
    codes = np.array(grams, np.uint64).reshape(len(grams), n)
    for i in range(n):
        h = h * np.uint64(0x5851F42D4C957F2D) + codes[:, i]
    return _mixed(h)


def _share(h: np.ndarray, temperature: float) -> np.ndarray:
    odds = np.exp(-temperature * (h - h.min(1, keepdims=True)))
    return odds / odds.sum(1, keepdims=True)


def in_test(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, order: int = ORDER) -> Models:
    """Models from the text and lang of at most per_language labelled documents a language.

    Documents are taken by the smallest hashes of (doc_id, text); rows that are equal in both count once. How many rows a language
    has says below which hash these lie; languages where that holds too few (rows that are equal) are ranked whole.
    """
    known = docs.where(F.col("lang").isNotNull() & ~in_test(F.col("doc_id")))
    labelled = known.where(F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    share = F.least(F.lit(1.0), F.lit(3.0 * per_language + 300) / F.count("*"))
    shares = known.groupBy("lang").agg(share.alias("share"))
    every = labelled.select("lang", "h").join(F.broadcast(shares), "lang")  # a row a language
    near = every.where(F.col("h").cast("double") / 2.0**64 + 0.5 <= F.col("share")).groupBy("lang", "h").agg(F.max("share").alias("share")).cache()
    cached = near
    short = [r.lang for r in near.groupBy("lang").agg(F.count("*").alias("n"), F.max("share").alias("share")).where((F.col("n") < per_language) & (F.col("share") < 1)).collect()]
    missing = [r.lang for r in shares.where("share < 1").join(near.select("lang").distinct(), "lang", "left_anti").collect()]
    if short or missing:
        near = near.where(~F.col("lang").isin(short)).unionByName(every.where(F.col("lang").isin(short + missing)).distinct())
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    bound = near.withColumn("rank", rank).where(F.col("rank") <= per_language).groupBy("lang").agg(F.max("h").alias("most"), F.count("*").alias("have"))
    sample = labelled.join(F.broadcast(bound), "lang").where("h <= most").dropDuplicates(["lang", "h"])  # per_language rows a language at most
    held = (F.pmod(F.xxhash64("h"), F.lit(1000)) < int(1000 * CALIBRATE)) & (F.col("have") >= 20)
    sample = sample.select("lang", "text", held.alias("held")).repartition(8).cache()

    def count(batches):
        for batch in batches:
            out: dict[tuple, int] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = np.concatenate((np.full(order - 2, 32, np.uint64), normal(text)))
                for gram, n in ngrams(codes, order) if len(codes) >= order else ():
                    out[lang, gram] = out.get((lang, gram), 0) + n
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.string()), pa.array([list(k[1]) for k in out], pa.list_(pa.int64())), pa.array(list(out.values()), pa.int64())], names=["lang", "gram", "n"])

    rows = sample.where("not held").select("lang", "text").mapInArrow(count, "lang string, gram array<long>, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()
    calibration = [(r.lang, normal(r.text)) for r in sample.where("held").select("lang", "text").collect()]
    sample.unpersist()
    cached.unpersist()
    langs = sorted({r.lang for r in rows})
    counts: list[dict[tuple, int]] = [{} for _ in langs]
    for r in rows:
        counts[langs.index(r.lang)][tuple(r.gram)] = r.n
    models = Models(langs, counts, order)
    models.calibrate(calibration)
    return models


def identify(docs: DataFrame, models: Models, keep: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """The columns `keep` (and text) and lang_pred, score, rejected. The models' size is bounded by the sample they were fitted on."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(texts: list) -> list:
        out = []
        for at in range(0, len(texts), 200):
            out += shared.value.predict(texts[at : at + 200])
        cols = [list(c) for c in zip(*out)]
        return [texts, *cols] if with_text else cols

    return map_texts(docs, list(keep), run, "text string, " * with_text + "lang_pred string, score double, rejected boolean", most=300_000)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, train(docs))
    return out.select("doc_id", in_test(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
