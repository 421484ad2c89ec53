"""Language identification by rank-order n-gram profiles and out-of-place distance.

Every document's most frequent character n-grams (1 to 3 letters, padded at word ends) are ranked and
compared with each language's ranked profile; an n-gram that a profile lacks costs the full profile
length. The lowest sum wins, ties going to the alphabetically first language.

Defined results: a null, empty or letterless text is "und" with distance 1.0. A text whose best
normalised distance exceeds max_distance is "und". An empty table gives an empty result, and
without any labelled text to train on every row is "und". Repeated rows are each identified. Only
the named columns are read, so other columns may have any name. Long texts are read whole: counts
are made in runs of RUN letters and then merged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import bounded_sample, starts_of, table, text_slices

GRAMS, RUN, UND = 3, 1 << 20, "und"
_BITS = np.uint64(44)
_MASK = (np.uint64(1) << _BITS) - np.uint64(1)
#: A multiplier for each length: a blank is 0, so " a" and "a" are one number that only the length tells apart.
_MIX = [np.uint64(x) for x in (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
_LETTER: list[np.ndarray] = []


def _letter(point: int) -> int:
    """A letter's code in lower case, or 0 for what isn't a letter, such as an emoji."""
    c = chr(point)
    low = c.lower()
    return 0 if not c.isalpha() else ord(low) if len(low) == 1 else point


def _letters() -> np.ndarray:
    """_letter of the code points under 65536."""
    if not _LETTER:
        _LETTER.append(np.array([_letter(i) for i in range(65536)], np.uint32))
    return _LETTER[0]


def ranked(texts: list[str], top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The top n-grams of each text: text index, gram, count, rank from 0 by (count down, gram up).

    A gram is a 44-bit mixed code; two different grams of one text sharing a code is a matter of 1 in 10^7.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = _letters()[points & np.uint32(65535)]
    if (far := np.flatnonzero(points >= 65536)).size:  # beyond the table, few distinct ones
        seen, place = np.unique(points[far], return_inverse=True)
        code[far] = np.array([_letter(int(i)) for i in seen], np.uint32)[place]
    doc = np.repeat(np.arange(len(texts), dtype=np.uint32), sizes)
    keep = code > 0
    # Word by word, as a word that ends a text has no blank after it to mark its end.
    starts = np.flatnonzero(keep & np.concatenate([[True], ~keep[:-1] | (doc[1:] != doc[:-1])])) if len(code) else np.zeros(0, np.int64)
    letters, owner = code[keep], doc[keep]
    if not len(letters):
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    ordinal = np.cumsum(keep) - 1
    first = ordinal[starts]  # each word's first letter among the letters
    lengths = np.diff(np.concatenate([first, [len(letters)]]))
    # A blank, which is the next text's where the text changes, before each word, and one at the end.
    n = len(letters) + len(first) + 1
    at = np.arange(len(letters)) + np.repeat(np.arange(1, len(first) + 1), lengths)
    line, who = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    line[at] = letters
    who[at] = owner
    blanks = first + np.arange(len(first))
    who[blanks] = owner[first]
    who[-1] = owner[-1]
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    for a in range(0, n, RUN):
        b = min(n, a + RUN)
        piece = line[a : min(n, b + GRAMS - 1)]
        mine = who[a:b] << _BITS
        m = b - a
        made = []
        gram = piece[:m].copy()
        letter = piece > 0
        made.append((mine | ((gram * _MIX[1]) >> np.uint64(20)) & _MASK)[letter[:m]])
        for k in range(2, GRAMS + 1):
            if len(piece) < k:
                break
            m = min(b - a, len(piece) - k + 1)
            gram = (gram[:m] << np.uint64(21)) | piece[k - 1 : k - 1 + m]
            ok = np.ones(m, bool)
            for inner in range(1, k - 1):  # no blank within
                ok &= letter[inner : inner + m]
            if k == 2:
                ok &= letter[:m] | letter[1 : 1 + m]
            mixed = (gram ^ (gram >> np.uint64(29))) * _MIX[k]
            made.append((mine[:m] | (mixed >> np.uint64(20)) & _MASK)[ok])
        both = np.sort(np.concatenate(made))
        head = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
        keys.append(both[head])
        counts.append(np.diff(np.concatenate([head, [len(both)]])))
    key, count = np.concatenate(keys), np.concatenate(counts)
    if len(keys) > 1:
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, count = key[head], np.add.reduceat(count, head)
    owner = (key >> _BITS).astype(np.int64)
    order = np.argsort((owner << 40) | ((1 << 39) - count), kind="stable")  # keys are sorted: ties stay by gram
    owner, key, count = owner[order], key[order], count[order]
    rank = np.arange(len(owner)) - starts_of(np.bincount(owner, minlength=len(texts)))[owner]
    best = rank < top
    return owner[best], (key & _MASK)[best], count[best], rank[best]


@dataclass
class Profiles:
    languages: list[str]
    grams: np.ndarray  # sorted codes of all profiles
    ranks: np.ndarray  # [language, gram]: the rank, or `top` where the profile lacks it
    top: int
    max_distance: float

    def identify(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest language (-1: none), its normalised distance, and the second's lead."""
        best, dist, lead = np.full(len(texts), -1), np.ones(len(texts)), np.zeros(len(texts))
        if not texts or not self.languages:
            return best, dist, lead
        owner, gram, _, rank = ranked(texts, self.top)
        if not len(owner):
            return best, dist, lead
        place = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        known = self.grams[place] == gram
        n = np.bincount(owner, minlength=len(texts))
        sums = np.empty((len(self.languages), len(texts)))
        for i in range(len(self.languages)):
            theirs = np.where(known, self.ranks[i, place], self.top)
            out = np.where(theirs < self.top, np.abs(theirs - rank), self.top)
            sums[i] = np.bincount(owner, out, len(texts))
        sums = sums / (np.maximum(n, 1) * self.top)
        best = np.where(n > 0, sums.argmin(0), -1)
        dist = np.where(n > 0, sums.min(0), 1.0)
        lead = np.where(n > 0, np.sort(sums, 0)[1] - sums.min(0), 0.0) if len(sums) > 1 else lead
        return np.where(dist <= self.max_distance, best, -1), dist, lead


def train(documents: DataFrame, max_docs: int = 400, top: int = 400, max_distance: float = 0.9, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Profiles:
    """Profiles from a bounded sample: about max_docs labelled documents a language, by the id's hash.

    Grams are ranked by their count over the sample, ties by code. Rows whose language, id or text is null don't count.
    """
    rows = documents.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("id").isNotNull())
    sample = bounded_sample(rows, "id", max_docs, "lang")

    def counted(batches):
        for batch in batches:
            langs = np.array([x for x in batch.column("lang").to_pylist()], object)
            for first, texts in text_slices(batch.column("text")):
                owner, gram, count, _ = ranked(texts, 1 << 40)
                theirs = langs[first : first + len(texts)]
                for lang in sorted(set(theirs)):
                    mine = (theirs == lang)[owner]
                    codes, inverse = np.unique(gram[mine], return_inverse=True)
                    total = np.bincount(inverse, count[mine], len(codes)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(total)], ["lang", "gram", "n"])

    counts = sample.select("lang", "text").mapInArrow(counted, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranks = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1).filter(F.col("r") < top)
    got = ranks.collect()  # at most `top` rows a language
    languages = sorted({r.lang for r in got})
    grams = np.unique(np.array([r.gram for r in got], np.uint64))
    table_ = np.full((len(languages), len(grams)), top, np.int64)
    for r in got:
        table_[languages.index(r.lang), np.searchsorted(grams, np.uint64(r.gram))] = r.r
    return Profiles(languages, grams, table_, top, max_distance)


def identifier(profiles: Profiles):
    """A column function: text -> struct(lang, distance, lead)."""

    @arrow_udf("struct<lang: string, distance: double, lead: double>")
    def identify(texts: pa.Array) -> pa.Array:
        best, dist, lead = [np.zeros(0, int)], [np.zeros(0)], [np.zeros(0)]
        for _, rows in text_slices(texts):
            b, d, s = profiles.identify(rows)
            best.append(b), dist.append(d), lead.append(s)
        names = np.array([*profiles.languages, UND], object)  # -1 is the last
        return pa.StructArray.from_arrays([pa.array(names[np.concatenate(best)], pa.string()), pa.array(np.concatenate(dist)), pa.array(np.concatenate(lead))], ["lang", "distance", "lead"])

    return identify


def keeper(profiles: Profiles, least_lead: float = 0.1):
    """A column function (text, declared language) -> whether a language filter keeps the row.

    Rejected is a text of no profile's language, and one that is declared in a profile's language while
    another's is nearer by at least least_lead. A null or unknown declaration rejects nothing.
    """

    def keep(texts: pa.Array, declared: pa.Array) -> pa.Array:
        out, said = [], declared.to_pylist()
        for first, rows in text_slices(texts):
            best, _, lead = profiles.identify(rows)
            for b, ahead, lang in zip(best, lead, said[first : first + len(rows)]):
                out.append(bool(b >= 0 and (lang not in profiles.languages or lang == profiles.languages[b] or ahead < least_lead)))
        return pa.array(out, pa.bool_())

    return arrow_udf(keep, "boolean")


def identify_documents(documents: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, language, distance, lead) for each row of documents."""
    got = documents.select(F.col(id_col).alias(id_col), identifier(profiles)(F.col(text_col)).alias("found"))
    return got.select(id_col, F.col("found.lang").alias("language"), F.col("found.distance").alias("distance"), F.col("found.lead").alias("lead"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return identify_documents(documents, train(documents))
