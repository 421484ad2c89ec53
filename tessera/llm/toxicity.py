"""Toxicity: boosted trees over dense lexicon and style features, isotonically calibrated.

Defined results: a null, empty or wordless text scores 0.0 and is not toxic; rows repeat as they
come, each scored alone; an empty table gives an empty result. Only the id and text columns are
read, so other columns may have any name. Texts are scored whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import Recent, array_slices, bounded_sample, segment_sum, starts_of, table, tokenized
from .trees import BoostedTrees, Isotonic

#: A public-knowledge start of the insult lexicon; the rest is mined from the labels.
SEED = "idiot idiots moron morons stupid loser losers trash scum pathetic worthless disgusting clown clowns dumb imbecile".split()
SECOND = set("you your yours yourself yourselves u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer tú ti usted ustedes vos vuestro vuestra".split())
LEET = str.maketrans("013457@$!|", "oieastasii")
FEATURES = (
    "log_words", "strong_density", "strong_hits", "strong_distinct", "weak_density", "weak_hits", "weight_density", "max_weight",
    "near_second", "second_density", "capitals", "exclaim", "punctuation", "obfuscated", "hidden_hits", "sentences",
)
STRONG, PREFIXES = 3.0, range(3, 9)
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W_]+")


def units(word: str) -> list[str]:
    """What a word may be listed by: itself, and each of its beginnings marked by *."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k)]


class Words:
    """Raw tokens' attributes: weight, flags, exclamation marks, signs at the edges, a hash of the word where it has a weight."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.rows = Recent(self._row, alone=True)

    def weight(self, word: str) -> float:
        get = self.lexicon.get
        return max([get(u, 0.0) for u in units(word)], default=0.0)

    def _row(self, raw: str) -> tuple[float, int, int, int, int]:
        core = _EDGE.sub("", raw)
        word = core.lower()
        weight, hidden = self.weight(word) if word else 0.0, 0.0
        odd = bool(word) and not word.isalpha() and any(c.isalpha() for c in word) and not any(c in word for c in "-'’\n")
        if odd:  # letters with digits or signs inside: read it as if they were letters
            for plain in {_INNER.sub("", word.translate(LEET)), _INNER.sub("", word)}:
                hidden = max(hidden, self.weight(plain))
        weight = max(weight, hidden)
        caps = core.isupper() and sum(c.isalpha() for c in core) > 1
        flags = (word in SECOND) | caps << 1 | odd << 2 | (hidden > 0) << 3 | (raw[-1:] in ".!?") << 4
        return weight, flags, raw.count("!"), len(raw) - len(core), zlib.crc32(word.encode("utf-8", "surrogatepass")) if weight else 0


_memo: dict[int, Words] = {}


def features(texts: pa.Array, lexicon: dict[str, float], version: int) -> np.ndarray:
    """One row of FEATURES for each text, none of them null."""
    words = _memo.get(version)
    if words is None:
        _memo.clear()
        words = _memo[version] = Words(lexicon)
    distinct, index, sizes = tokenized(texts)
    table_ = np.array(list(map(words.rows.__getitem__, distinct)), np.float64).reshape(-1, 5)
    flags = table_[:, 1].astype(np.int64)
    at, n, doc = starts_of(sizes), np.maximum(sizes, 1), np.repeat(np.arange(len(texts)), sizes)
    s = lambda v: segment_sum(v[index], at)
    flag = lambda k: flags >> k & 1
    hits = np.flatnonzero((table_[:, 0] > 0)[index])
    weight, owner, second = table_[index[hits], 0], doc[hits], flag(0)[index]
    per = lambda v: np.bincount(owner, v, len(texts))
    strong = weight >= STRONG
    top = np.zeros(len(texts))
    np.maximum.at(top, owner, weight)
    near = np.zeros(len(hits))
    for shift in (-3, -2, -1, 1, 2, 3):  # a second-person pronoun at most 3 words off, in the same text
        other = np.clip(hits + shift, 0, max(len(index) - 1, 0))
        near = np.maximum(near, second[other] * (doc[other] == owner)) if len(hits) else near
    pairs = np.unique(owner[strong] << 32 | table_[index[hits[strong]], 4].astype(np.int64))
    sum_strong, sum_weak = per(strong), per(~strong)
    return np.stack([
        np.log1p(sizes), sum_strong / n, sum_strong, np.bincount(pairs >> 32, minlength=len(texts)), sum_weak / n, sum_weak, per(weight) / n, top,
        per(near) / n, s(flag(0)) / n, s(flag(1)) / n, s(table_[:, 2]) / n, s(table_[:, 3]) / n, s(flag(2)) / n, s(flag(3)), s(flag(4)) / n,
    ], 1)


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: BoostedTrees | None = None
    scale: Isotonic | None = None
    threshold: float = 0.5
    version: int = 0

    def __post_init__(self):
        self.version = digest(self.lexicon)

    def score(self, texts: pa.Array) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        x = features(texts, self.lexicon, self.version)
        if self.trees is None:  # labels of one class only: the share of listed words decides
            p = 1 - np.exp(-60 * x[:, 1])
        else:
            p = self.scale(self.trees.decision(x))
        return np.where(x[:, 0] > 0, p, 0.0)


def digest(lexicon: dict[str, float]) -> int:
    """Names a lexicon in the workers' memo."""
    return int.from_bytes(hashlib.sha256(repr(sorted(lexicon.items())).encode()).digest()[:8], "big")


def _unit_counts(batches):
    for batch in batches:
        bad, all_ = Counter(), Counter()
        fold = batch.column("fold").to_pylist()
        toxic = batch.column("toxic").to_pylist()
        for text, f, t in zip(batch.column("text").to_pylist(), fold, toxic):
            seen = {u for raw in set((text or "").split()) if (w := _EDGE.sub("", raw).lower()) for u in units(w)}
            for u in seen:
                all_[f, u] += 1
            if t:
                for u in seen:
                    bad[f, u] += 1
        keys = list(bad) + [k for k in all_ if k not in bad]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([bad[k] for k in keys], pa.int64()), pa.array([all_[k] for k in keys], pa.int64())], ["fold", "unit", "bad", "n"])


def mine_lexicon(sample: DataFrame, least: int = 3) -> dict[int, dict[str, float]]:
    """Units by fold (0, 1) and over both (-1), weighted by smoothed log odds against clean documents.

    All units count that `least` toxic texts of the sample have, and a quarter of whose texts are toxic: as many as the
    bounded sample of labelled rows gives.
    """
    totals = {r[0]: (r[1], r[2]) for r in sample.groupBy("fold").agg(F.sum("toxic"), F.count("*")).collect()}
    counts = sample.select("fold", "toxic", "text").mapInArrow(_unit_counts, "fold int, unit string, bad bigint, n bigint")
    per = counts.groupBy("unit").agg(*[F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for f in (0, 1) for c in ("bad", "n")])
    both = per.withColumn("bad", F.col("bad0") + F.col("bad1")).withColumn("n", F.col("n0") + F.col("n1"))
    rows = both.filter((F.col("bad") >= least) & (F.col("bad") * 4 >= F.col("n"))).collect()
    out: dict[int, dict[str, float]] = {}
    for f, pick in ((0, lambda r: (r.bad0, r.n0)), (1, lambda r: (r.bad1, r.n1)), (-1, lambda r: (r.bad, r.n))):
        tox = sum(totals[k][0] for k in totals if f in (-1, k))
        all_ = sum(totals[k][1] for k in totals if f in (-1, k))
        lex = dict.fromkeys(SEED, 4.0)
        for r in rows:
            b, n = pick(r)
            if b >= least:
                odds = math.log((b + 0.5) / (tox + 1)) - math.log((n - b + 0.5) / (all_ - tox + 1))
                if odds > 1 and odds > 2.5 * math.sqrt(1 / (b + 0.5) + 1 / (n - b + 0.5)):
                    lex[r.unit] = max(min(odds, 6.0), lex.get(r.unit, 0.0))
        out[f] = lex
    return out


def train(documents: DataFrame, labels: DataFrame, max_rows: int = 8_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5) -> ToxicityModel:
    """Fit on a bounded sample of labelled rows: about max_rows by the id's hash.

    The lexicon is mined on one half for the features of the other, so that its densities on training
    rows aren't flattered. The trees' scores are calibrated on rows that those trees didn't see.
    Contradicting labels of one id count by their greatest; null ids and labels don't count.
    """
    want = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).filter(F.col("id").isNotNull() & F.col("toxic").isNotNull())
    want = bounded_sample(want, "id", max_rows).groupBy("id").agg(F.max("toxic").alias("toxic"))
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(want), "id").withColumn("fold", F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(2)).cast("int"))
    # At most about max_rows texts, spread over all tasks: they may come from a few splits of the table.
    sample = sample.repartition(documents.sparkSession.sparkContext.defaultParallelism, "id").persist()
    try:
        lexicons = mine_lexicon(sample)
        names = {f: digest(lexicons[f]) for f in lexicons}

        def vectors(batches):
            for batch in batches:
                fold = np.array(batch.column("fold").to_pylist(), int)
                out = np.zeros((len(fold), len(FEATURES)))
                texts = batch.column("text").fill_null("")
                for f in (0, 1):
                    if (at := np.flatnonzero(fold == f)).size:
                        out[at] = np.concatenate([features(part, lexicons[1 - f], names[1 - f]) for part in array_slices(texts.take(pa.array(at)))])
                yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.string()), batch.column("toxic"), pa.array(fold, pa.int32()), pa.array(list(out), pa.list_(pa.float64()))], ["id", "toxic", "fold", "x"])

        got = sample.select("id", "toxic", "fold", "text").mapInArrow(vectors, "id string, toxic int, fold int, x array<double>").toArrow().sort_by([("id", "ascending")])
    finally:
        sample.unpersist()
    y = np.array(got.column("toxic").to_pylist(), float)
    lexicon = lexicons[-1]
    if not (0 < y.sum() < len(y)):
        return ToxicityModel(lexicon, threshold=threshold)
    x = np.array(got.column("x").to_pylist())
    part = np.arange(len(y)) % 3
    held = np.zeros(len(y))
    for k in range(3):
        seen = part != k
        held[~seen] = BoostedTrees().fit(x[seen], y[seen]).decision(x[~seen])
    return ToxicityModel(lexicon, BoostedTrees().fit(x, y), Isotonic().fit(held, y), threshold)


def scorer(model: ToxicityModel):
    """A column function: text -> probability of toxicity."""

    @arrow_udf("double")
    def toxicity(texts: pa.Array) -> pa.Array:
        parts = [model.score(part) for part in array_slices(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return toxicity


def score_documents(documents: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, toxicity, toxic) for each row of documents."""
    p = documents.select(F.col(id_col).alias(id_col), scorer(model)(F.col(text_col)).alias("toxicity"))
    return p.withColumn("toxic", (F.col("toxicity") >= F.lit(model.threshold)).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score_documents(documents, train(documents, table(spark, sf_dir, "labels")))
