"""Operator 1: language identification of mixed-language text.

Each word's script, from ranges of code points, narrows the candidate languages to those that were learned with
that script. Letter trigrams (with word ends) give every word a log-likelihood in each candidate, and Viterbi over
the words with a switching penalty labels spans, which `spans` lists. The language with most letters is the
prediction; the score is its share of the letters. A word in a script that a language was not learned with costs that
language more than two switches, so such a word (a name, say) can stand within a span only by a detour.

A path without a switch is provably best when no stretch of words gains half the penalty in any other language: a
path with m >= 2 stretches outside the best language gains less than m / 2 penalties and pays m - 1 at least, and one
with a single such stretch and a switch pays more than it gains. Cumulative sums over a whole batch decide that; only
the other texts run Viterbi word by word.

The model is fitted on a bounded sample of labelled rows (SAMPLE_ROWS, by hash of the id; whole texts). It holds a
table of trigram buckets x languages of at most CELLS numbers: BUCKETS buckets, halved until they fit, which begins
beyond 256 languages; any number of languages is learned. Prediction is row by row: no shuffle, memory of a
batch. Null or letterless text gives `und`; rows with a null id or language are not learned from; equal rows give
equal results; without labelled rows every text is `und`; an empty table gives no rows; input columns travel in a
struct, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm._common import beside, spread, table
from grainmill.llm._text import by_size, code_points, letters

BUCKETS = 1 << 16
SAMPLE_ROWS = 4000
CELLS = 1 << 24
SWITCH = 14.0
UNLIKELY = -30.0

#: First code points of script ranges and their scripts, in order.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x1380, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "other"), (0x20000, "han"),
]
SCRIPT_NAMES = sorted({s for _, s in SCRIPTS})
_STARTS = np.array([a for a, _ in SCRIPTS], np.uint32)
_SCRIPT = np.array([SCRIPT_NAMES.index(s) for _, s in SCRIPTS], np.int64)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # buckets (a power of two) x languages, log-probabilities
    scripts: np.ndarray  # scripts x languages, whether a candidate


def _lower(text: str) -> str:
    """Lower case without change of length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def trigrams(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Of the letters of all texts: bucket of the trigram around each; of the words: their script, first letter (as a
    place among the letters), and text; first word of each text (one more at the end); code point of each letter, and of
    each text's start, among those of all texts."""
    cp, at = code_points([_lower(t) for t in texts])
    is_letter = letters()[cp]
    masked = np.where(is_letter, cp, 0).astype(np.uint32)
    pad = np.concatenate([[np.uint32(0)], masked, [np.uint32(0)]]).astype(np.uint32)
    place = np.flatnonzero(is_letter)
    a, b, c = pad[place], pad[place + 1], pad[place + 2]
    h = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    bucket = h >> np.uint32(16)
    first = np.flatnonzero(a == 0)
    text_of = np.searchsorted(at, place[first], "right") - 1
    words = np.searchsorted(text_of, np.arange(len(texts) + 1))
    script = _SCRIPT[np.searchsorted(_STARTS, b[first], "right") - 1] if len(first) else np.zeros(0, np.int64)
    return bucket, script, first, text_of, words, place, at


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id", rows: int = SAMPLE_ROWS) -> Model:
    """Counts over a sample of `rows` rows at most; what reaches the driver is bounded by buckets x languages."""
    known = labelled.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{order}`").alias("id")).where("lang IS NOT NULL AND id IS NOT NULL")
    ids = known.select("id").orderBy(F.xxhash64("id"), "id").limit(rows).distinct()
    sample = known.join(F.broadcast(ids), "id", "left_semi")  # at most `rows` ids

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(1).to_pylist()
            for at, texts in by_size(batch.column(0)):
                bucket, script, first, _, words, *_ = trigrams([t or "" for t in texts])
                ends = np.append(first, len(bucket))[words]
                for k, name in enumerate(names[at : at + len(texts)]):
                    own = found.setdefault(name, np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64))
                    own[:BUCKETS] += np.bincount(bucket[ends[k] : ends[k + 1]], minlength=BUCKETS)
                    own[BUCKETS:] += np.bincount(script[words[k] : words[k + 1]], minlength=len(SCRIPT_NAMES))
        for name, n in found.items():
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k.astype(np.int32)), pa.array(n[k])], ["lang", "bucket", "n"])

    counts = sample.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = counts["lang"].combine_chunks().dictionary_encode() if len(counts) else pa.array([], pa.string()).dictionary_encode()
    order_ = sorted(range(len(names.dictionary)), key=lambda k: names.dictionary[k].as_py())
    languages = [names.dictionary[k].as_py() for k in order_]
    place = np.argsort(order_)[names.indices.to_numpy()] if languages else np.zeros(0, np.int64)
    buckets = BUCKETS
    while buckets * len(languages) > CELLS and buckets > 1:
        buckets //= 2
    full = np.zeros((buckets + len(SCRIPT_NAMES), len(languages)))
    row = counts["bucket"].to_numpy()
    np.add.at(full, (np.where(row < BUCKETS, row & (buckets - 1), row - BUCKETS + buckets), place), counts["n"].to_numpy())
    grams, scripts = full[:buckets] + 0.1, full[buckets:]
    scores = np.log(grams / grams.sum(0, keepdims=True)) if languages else grams
    return Model(languages, scores.astype(np.float32), scripts >= 0.002 * np.maximum(scripts.sum(0, keepdims=True), 1))


def viterbi(words: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Best path of languages through words x languages log-likelihoods."""
    n, m = words.shape
    came = np.empty((n, m), np.int32)
    if m > 24:
        best, each = words[0].astype(np.float64), np.arange(m)
        for k in range(1, n):
            where = int(best.argmax())
            jump = best[where] - penalty
            stay = best >= jump
            came[k] = np.where(stay, each, where)
            best = np.where(stay, best, jump) + words[k]
        best = best.tolist()
    else:
        rows = words.tolist()
        best, span = rows[0], range(m)
        for k in range(1, n):
            top = max(best)
            where, jump, row = best.index(top), top - penalty, rows[k]
            came[k] = [i if best[i] >= jump else where for i in span]
            best = [(x if x >= jump else jump) + y for x, y in zip(best, row, strict=True)]
    path = np.empty(n, np.int32)
    path[-1] = best.index(max(best))
    for k in range(n - 1, 0, -1):
        path[k - 1] = came[k, path[k]]
    return path


def label(texts: list[str], model: Model, penalty: float = SWITCH, spans: bool = False) -> list[tuple]:
    """(language, share of letters, number of spans) of each text; with spans, also their (start, end, language), in code
    points: from a span's first word to the end of its last."""
    out: list[tuple] = [("und", 0.0, 0, [])[: 3 + spans]] * len(texts)
    bucket, script, first, _, words, place, at = trigrams(texts)
    if not len(first) or not model.languages:
        return out
    scores = np.add.reduceat(model.scores[bucket & np.uint32(len(model.scores) - 1)], first, axis=0).astype(np.float64)
    allowed = model.scripts[script]
    allowed |= ~allowed.any(1, keepdims=True)
    scores = np.where(allowed, scores, scores.max(1, keepdims=True) + UNLIKELY)
    last = np.append(first[1:], len(bucket)) - 1
    size = last - first + 1
    full = np.flatnonzero(np.diff(words))  # texts with words
    start = words[:-1][full]
    best = np.add.reduceat(scores, start, axis=0).argmax(1)
    owner = np.repeat(np.arange(len(full)), np.diff(words)[full])
    gain = scores - scores[np.arange(len(scores)), best[owner]][:, None]
    total = np.cumsum(gain, axis=0)
    before = total - gain
    total -= before[start][owner]
    before -= before[start][owner]
    step = -1e7 * owner[:, None]  # each text far below the one before, so that the running minimum starts anew
    most = np.maximum.reduceat(total + step - np.minimum.accumulate(before + step, axis=0), start, axis=0).max(1)
    for j, k in enumerate(full):
        a, b = words[k], words[k + 1]
        plain = most[j] < penalty / 2
        if plain and not spans:
            out[k] = (model.languages[best[j]], 1.0, 1)
            continue
        path = np.full(b - a, best[j]) if plain else viterbi(scores[a:b], penalty)
        share = np.bincount(path, weights=size[a:b], minlength=len(model.languages))
        turns = np.flatnonzero(np.diff(path)) + 1
        out[k] = (model.languages[share.argmax()], float(share.max() / share.sum()), 1 + len(turns))
        if spans:
            begins, ends = np.append(0, turns), np.append(turns, b - a) - 1
            out[k] += ([(int(place[first[a + x]] - at[k]), int(place[last[a + y]] - at[k]) + 1, model.languages[path[x]]) for x, y in zip(begins, ends, strict=True)],)
    return out


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, spans: bool = False) -> DataFrame:
    """row: a struct of the columns to keep (all, unless named); lang_pred, score, n_spans and, if wanted, spans: array of
    struct<start, end, lang> in code points, end exclusive."""
    row = F.struct(*([F.col(f"`{c}`") for c in keep] if keep else ["*"])).alias("row")
    kind = docs.select(row).schema["row"].dataType
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CELLS numbers at most
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    kinds = [pa.string(), pa.float64(), pa.int32(), span][: 3 + spans]
    names = ["lang_pred", "score", "n_spans", "spans"][: 3 + spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in by_size(batch.column(1)):
                found = [list(c) for c in zip(*label([t or "" for t in texts], shared.value, spans=spans), strict=True)]
                if spans:
                    found[3] = [[{"start": a, "end": b, "lang": x} for a, b, x in own] for own in found[3]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *[pa.array(c, t) for c, t in zip(found, kinds, strict=True)]], ["row", *names])

    schema = "lang_pred string, score double, n_spans int" + ", spans array<struct<start:int,end:int,lang:string>>" * spans
    return docs.select(row, F.col(f"`{text}`").alias("text")).mapInArrow(run, beside(kind, schema))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.crc32(F.col("doc_id").cast("string")) % 4
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).withColumn("held_out", F.coalesce(rest == 2, F.lit(False)))
    model = fit(docs.where(rest != 2))  # a null id is not learned from
    return predict(docs, model, keep=["doc_id", "held_out"]).select("row.*", "lang_pred", "score", "n_spans")
