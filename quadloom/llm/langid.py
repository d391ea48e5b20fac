"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadloom.llm.common import only, slices, table, utf8_buffer
from quadloom.llm.quality import BYTE, mixed, spans_hash
from quadloom.sources.staging import staged

#: Character n-gram lengths and the number of hashed features.
LENGTHS, FEATURES = (1, 2, 3), 1 << 15
#: The classifier is fitted on at most so many documents of each language: those of the smallest hashed ids.
SAMPLE = 600
#: Follow the regularised leader: learning rate, its offset, and the elastic net's two penalties.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.002, 0.0005, 4
#: One sampled document in so many is kept for the temperature.
CALIBRATION = 5
UNKNOWN = "und"
#: Documents scoring less than this are rejected by the filter.
MIN_SCORE = 0.4
LETTER = regex.compile(r"\p{L}")

_letters = np.zeros(256, bool)
_letters[[*range(65, 91), *range(97, 123)]] = True


def ngram_counts(data: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed features of each text and how often each occurs; characters are code points, ASCII in lower case."""
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    start = np.flatnonzero((data & 0xC0) != 0x80)
    edge = np.append(start, len(data))
    doc = np.searchsorted(at, start, "right") - 1
    values = BYTE[lower]
    features = np.full((len(LENGTHS), len(start)), -1, np.int64)
    for k, n in enumerate(LENGTHS):
        i = np.arange(max(0, len(start) - n + 1))
        i = i[doc[i] == doc[i + n - 1]]
        features[k, i] = (spans_hash(values, edge[i], edge[i + n]) + mixed(np.full(1, n, np.uint64)) >> np.uint64(40)).astype(np.int64) % FEATURES
    first = np.searchsorted(doc, np.arange(len(at)))
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        x = features[:, a:b].ravel()
        count = np.bincount(x[x >= 0], minlength=FEATURES)
        ids = np.flatnonzero(count)
        out.append((ids, count[ids]))
    return out


def tf_idf(ids: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Logarithmic term frequency times inverse document frequency, of length 1."""
    x = np.log1p(counts) * idf[ids]
    norm = np.sqrt(x @ x)
    return x / norm if norm else x


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(samples: list[tuple[np.ndarray, np.ndarray, str]], seed: int = 11) -> dict:
    """A model from (features, counts, language): follow the regularised leader, then a temperature.

    Per weight, z sums the gradients and n their squares; a weight is 0 while |z| is under the first penalty, and
    shrinks with the second. The temperature minimises the log loss of the documents kept aside.
    """
    langs = sorted({x[2] for x in samples})
    order = np.random.default_rng(seed).permutation(len(samples))
    held = [samples[i] for i in order[::CALIBRATION]] if len(samples) >= 5 * CALIBRATION else []
    train = [samples[i] for k, i in enumerate(order) if not held or k % CALIBRATION]
    df = np.bincount(np.concatenate([x[0] for x in train] or [np.zeros(0, np.int64)]), minlength=FEATURES)
    idf = np.log((1 + len(train)) / (1 + df)) + 1
    z, n = np.zeros((FEATURES + 1, len(langs))), np.zeros((FEATURES + 1, len(langs)))

    def weights(rows: np.ndarray) -> np.ndarray:
        zr = z[rows]
        l1 = np.where(rows == FEATURES, 0.0, L1)[:, None]
        return np.where(np.abs(zr) <= l1, 0.0, -(zr - np.sign(zr) * l1) / ((BETA + np.sqrt(n[rows])) / ALPHA + L2))

    vectors = [(np.append(i, FEATURES), np.append(tf_idf(i, c, idf), 1.0), langs.index(y)) for i, c, y in train]
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(vectors)):
            rows, x, y = vectors[k]
            w = weights(rows)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[rows] + g * g) - np.sqrt(n[rows])) / ALPHA
            z[rows] += g - sigma * w
            n[rows] += g * g
    w = weights(np.arange(FEATURES + 1))
    model = {"langs": langs, "idf": idf, "w": w[:-1].astype(np.float32), "b": w[-1], "t": 1.0}
    if held and len(langs) > 1:
        logits = np.array([logit(model, i, c) for i, c, _ in held])
        y = np.array([langs.index(x[2]) for x in held])
        loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean()
        model["t"] = float(min(np.geomspace(0.05, 10, 121), key=loss))
    return model


def logit(model: dict, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return tf_idf(ids, counts, model["idf"]) @ model["w"][ids] + model["b"]


def bounded_sample(docs: DataFrame, per_lang: int = SAMPLE) -> DataFrame:
    """At most per_lang documents (lang, text) of each non-null language, those of the smallest hashes of id and text.

    A language's share of the hash range is set from its count, so that about 1.5 per_lang rows stay; only those,
    however many the language has, meet in the task that cuts exactly. Rows that agree in id and text count once. A language
    that chance gives fewer rows than per_lang keeps those.
    """
    marked = docs.where("text is not null and lang is not null").select("lang", "text", F.xxhash64(F.col("doc_id").cast("string"), F.xxhash64("text")).alias("_h"))
    share = F.least(F.lit(1.0), F.lit(1.5 * per_lang + 50) / F.count("*"))
    # stored, so that Spark knows their size and sends them to all tasks while they are small
    limits = staged(marked.groupBy("lang").agg((share * float(1 << 63) * 2 - float(1 << 63)).alias("_most")))
    some = marked.select("lang", "_h").join(limits, "lang").where(F.col("_h") <= F.col("_most")).select("lang", "_h").distinct()
    last = staged(some.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_h"))).where(F.col("_n") <= per_lang).groupBy("lang").agg(F.max("_h").alias("_last")))
    found = marked.join(last, "lang").where("_h <= _last")
    return found.groupBy("lang", "_h").agg(F.first("text").alias("text")).select("lang", "text")


def features_of(docs: DataFrame) -> DataFrame:
    """(lang, ids, counts) of whole texts."""

    def run(batches):
        for batch in batches:
            data, at = utf8_buffer(batch.column(0))
            for lo, hi in slices(at, 1 << 20):
                got = ngram_counts(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.array([x[0] for x in got], pa.list_(pa.int32())), pa.array([x[1] for x in got], pa.list_(pa.int32()))], names=["lang", "ids", "counts"])

    return docs.select("text", "lang").mapInArrow(run, "lang string, ids array<int>, counts array<int>")


def train(docs: DataFrame, per_lang: int = SAMPLE) -> dict:
    """Fit on a bounded sample of labelled documents (doc_id, text, lang): at most per_lang of a language.

    Only the sample's features, at most FEATURES pairs of numbers a document, come to the driver, as Arrow arrays. Without any
    labelled text the model has no languages and predicts UNKNOWN.
    """
    samples = []
    for batch in features_of(bounded_sample(docs, per_lang)).toArrow().to_batches():
        lists = [batch.column(i) for i in (1, 2)]
        at = [x.offsets.to_numpy() for x in lists]
        ids, counts = (x.values.to_numpy() for x in lists)
        samples += [(ids[a:b], counts[c:d], lang) for a, b, c, d, lang in zip(at[0], at[0][1:], at[1], at[1][1:], batch.column(0).to_pylist(), strict=False)]
    samples.sort(key=lambda x: (x[2], x[0].tobytes(), x[1].tobytes()))
    return fit(samples)


def _scored(batches, text_at: int, model: dict):
    """Each batch in slices of bounded size, with the language and score of each row's text."""
    for batch in batches:
        data, at = utf8_buffer(batch.column(text_at))
        for lo, hi in slices(at, 1 << 20):
            part, ends = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            ascii_letters = np.diff(np.concatenate([[0], np.cumsum(_letters[part], dtype=np.int64)])[ends]) > 0
            langs, scores = [], []
            for k, (ids, counts) in enumerate(ngram_counts(part, ends)):
                lettered = ascii_letters[k] or LETTER.search(part[ends[k] : ends[k + 1]].tobytes().decode())
                if not lettered or not model["langs"]:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = softmax(logit(model, ids, counts) / model["t"])
                langs.append(model["langs"][int(p.argmax())])
                scores.append(min(1.0, float(p.max())))
            yield batch.slice(lo, hi - lo), pa.array(langs, pa.string()), pa.array(scores, pa.float64())


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score (calibrated probability) of every whole text.

    UNKNOWN with score 0 for null texts, texts without a letter, and where the model knows no language. Of languages
    with equal probability the first by name is given. Repeated rows and null ids are kept; an empty table stays
    empty; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for rows, langs, scores in _scored(batches, 1, sent.value):
            yield pa.RecordBatch.from_arrays([rows.column(0), langs, scores], names=[id_col, "lang_pred", "score"])

    source = only(docs, id_col, text_col)
    return source.mapInArrow(run, f"`{id_col}` {source.dtypes[0][1]}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """True for a third of the ids, by CRC-32 of their text; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, per_lang: int = SAMPLE) -> DataFrame:
    """Train on docs that aren't held out, and predict all of docs from their text alone."""
    model = train(docs.where(~held_out()).select("doc_id", "text", "lang"), per_lang)
    return predict(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE, text_col: str = "text") -> DataFrame:
    """docs without those whose language can't be told: UNKNOWN, or a best probability below min_score.

    Learns from lang where it is given; without a lang column, or any label, nothing can be told and all rows go.
    """
    known = docs.withColumn("lang", F.lit(None).cast("string")) if "lang" not in docs.columns else docs
    model = train(known.where(~held_out()).select("doc_id", F.col(f"`{text_col}`").alias("text"), "lang"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches):
        for rows, _, scores in _scored(batches, at, sent.value):
            keep = pa.array(scores.to_numpy(zero_copy_only=False) >= max(min_score, 1e-300))
            yield pa.RecordBatch.from_arrays(rows.filter(keep).columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
