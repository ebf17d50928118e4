"""Language identification by averaged hashed subword embeddings and a linear softmax (operator 4).

A text is the average of the embeddings of its subwords (byte n-grams within words, with word borders), followed by a
linear layer and softmax, as in Joulin et al., "Bag of Tricks for Efficient Text Classification" (2017).  Trained by
stochastic gradient descent in numpy on a bounded sample; a temperature and a rejection threshold are calibrated on
sample rows that training did not see.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twigline.llm.common import stable_key

BUCKETS = 1 << 15
DIMENSIONS = 8
GRAMS = (1, 2, 3, 4)
#: Rows of each language in the training sample, at most; languages learned, at most: the most frequent (ties: by name).
ROWS_PER_LANG = 700
MAX_LANGS = 200
#: Bytes of bucket counts that the sample may bring to the driver, shared evenly by the languages.
SAMPLE_BYTES = 256 << 20
EPOCHS = 6
#: Share of well labelled calibration rows that either rejection threshold may cost.
REJECT_SHARE = 0.001
#: Share of texts of held-out languages that the share of seen subwords has to tell apart, to count at all.
LEAST_CAUGHT = 0.5
UNDETERMINED = "und"

#: ASCII letters and every byte of multi-byte characters belong to words; the rest separates them.
_WORD_BYTE = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])


#: Characters of a slice of a long text.
SLICE = 1 << 16
_GAP = re.compile(r"[ \t-\r]")


def subwords(text: str) -> np.ndarray:
    """Bucket of every subword of the lower-cased text."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", dtype=np.uint8)
    raw = np.where(_WORD_BYTE[raw], raw, np.uint8(32))
    blank = raw == 32
    raw = raw[~(blank & np.concatenate([[False], blank[:-1]]))]  # one separator between words
    blank = raw == 32
    out = []
    for n in GRAMS:
        m = len(raw) - n + 1
        if m <= 0:
            continue
        code = np.zeros(m, dtype=np.uint32)
        inner = np.zeros(m, dtype=bool)
        for k in range(n):
            code |= raw[k : k + m].astype(np.uint32) << np.uint32(8 * k)
            if 0 < k < n - 1 or n == 1:
                inner |= blank[k : k + m]
        code = (code + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(2654435761)
        out.append((code >> np.uint32(32 - 15))[~inner])
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint32)


def slices(text: str) -> Iterator[str]:
    """A whole text in runs cut at white space: their subwords together are the text's."""
    at = 0
    while len(text) - at > SLICE:
        cut = _GAP.search(text, at + SLICE)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def subword_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text, and how often each occurs."""
    parts = [subwords(s) for s in slices(text)]
    if len(parts) == 1:
        return np.unique(parts[0], return_counts=True)
    every = sum(np.bincount(p, minlength=BUCKETS) for p in parts)
    ids = np.flatnonzero(every)
    return ids.astype(np.uint32), every[ids]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    langs: list[str]
    embeddings: np.ndarray  # buckets x dimensions
    weights: np.ndarray  # dimensions x languages
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0  # least score that is not rejected
    seen: np.ndarray | None = None  # whether a bucket occurs in the training rows
    least_seen: float = 0.0  # least share of seen subwords that is not rejected

    def folded(self) -> np.ndarray:
        """Logits of every bucket: averaging them equals averaging embeddings first."""
        return (self.embeddings @ self.weights).astype(np.float32)

    def predict(self, text: str | None, folded: np.ndarray | None = None) -> tuple[str, float, bool]:
        """(language, score, rejected) of a whole text."""
        if not self.langs or not has_letter(text):
            return UNDETERMINED, 0.0, True
        folded = self.folded() if folded is None else folded
        total, n, seen = np.zeros(folded.shape[1]), 0, 0
        for part in slices(text):
            ids = subwords(part)
            total += folded[ids].sum(axis=0, dtype=np.float64)
            n += len(ids)
            if self.seen is not None:
                seen += np.count_nonzero(self.seen[ids])
        if not n:
            return UNDETERMINED, 0.0, True
        p = _softmax((total / n + self.bias) / self.temperature)
        best = int(p.argmax())
        unlike = self.seen is not None and seen < self.least_seen * n
        return self.langs[best], float(p[best]), bool(p[best] < self.threshold or unlike)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(samples: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7, epochs: int = EPOCHS) -> LanguageModel:
    """From (language, distinct buckets, their counts) of whole texts. Every fifth row calibrates.

    Rejection has two thresholds, both bounded by ``REJECT_SHARE``: on the score, and on the share of a text's subwords
    that occur in training rows.  The latter is calibrated on held-out languages: each language in turn is unknown to
    the others' subwords, and the threshold is the least that rejects such texts as well as any within the bound.  If it
    rejects less than ``LEAST_CAUGHT`` of them, as where all languages share their subwords, it is left out.
    """
    langs = sorted({s[0] for s in samples})
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(samples))
    held = order[: len(samples) // 5] if len(samples) >= 20 else order[:0]
    train = order[len(held) :]
    e = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    w = np.zeros((DIMENSIONS, max(1, len(langs))))
    w += rng.normal(0, 0.1, w.shape)
    bias = np.zeros(max(1, len(langs)))
    code = {x: i for i, x in enumerate(langs)}
    steps, total = 0, max(1, epochs * len(train))
    for _ in range(epochs):
        for i in rng.permutation(train):
            lang, ids, counts = samples[i]
            if not len(ids):
                continue
            lr = 2.0 * (1 - steps / total)
            steps += 1
            share = counts / counts.sum()
            h = share @ e[ids]
            g = _softmax(h @ w + bias)
            g[code[lang]] -= 1
            back = w @ g
            w -= lr * np.outer(h, g)
            e[ids] -= lr * 4 * share[:, None] * back[None, :]
    model = LanguageModel(langs, e, w, bias)
    rows = [(code[s[0]], (s[2] / s[2].sum()) @ e[s[1]] @ w + bias) for s in (samples[i] for i in held) if len(s[1])]
    if rows:
        y, z = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])

        def loss(t: float) -> float:
            return float(-np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean())

        model.temperature = min((0.1 * 1.25**k for k in range(24)), key=loss)
        p = _softmax(z / model.temperature)
        right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
        if len(right):
            model.threshold = float(right[int(REJECT_SHARE * len(right))]) * 0.999
    _calibrate_novelty(model, [samples[i] for i in train], [samples[i] for i in held])
    return model


def _calibrate_novelty(model: LanguageModel, train: list, held: list) -> None:
    by_lang = {x: np.zeros(BUCKETS, dtype=np.int32) for x in model.langs}
    for lang, ids, _ in train:
        by_lang[lang][ids] += 1
    every = sum(by_lang.values(), np.zeros(BUCKETS, dtype=np.int32))
    model.seen = every > 0

    def share(seen: np.ndarray, row: tuple) -> float:
        return float(row[2][seen[row[1]]].sum() / row[2].sum())

    rows = [r for r in held if len(r[1])]
    # a training row is judged by the other training rows
    known = np.sort([share(model.seen, r) for r in rows] + [share(every > 1, r) for r in train if len(r[1])])
    unknown = np.array([share(every > by_lang[r[0]], r) for r in rows])
    if len(unknown) and len(model.langs) > 1:
        most = known[int(REJECT_SHARE * len(known))]  # no threshold above this is within the bound
        caught = np.sort(unknown[unknown < most])
        if len(caught) >= LEAST_CAUGHT * len(unknown):
            # halfway between the unknown texts that can be told apart and the known ones
            model.least_seen = float((caught[-1 - len(caught) // 100] + most) / 2)


def train_language_model(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    key_cols: tuple[str, ...] = ("doc_id",),
    rows_per_lang: int = ROWS_PER_LANG,
) -> LanguageModel:
    """Fit on at most ``rows_per_lang`` rows of each language (of ``MAX_LANGS`` languages), chosen by a hash.

    A language's distinct keys are counted first, so that only about as many rows as are wanted are ranked, however
    frequent it is.  Then only the sample's texts are read; the driver gets the bucket counts of whole texts, never
    texts, and of a language no more than its part of ``SAMPLE_BYTES``, at four bytes for each byte of text and gram
    length, or for all buckets.
    """
    from pyspark.sql import Window

    spark = docs.sparkSession
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    keyed = rows.select(stable_key(*key_cols).alias("_h"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    most = F.least(F.lit(BUCKETS), F.octet_length("text") * len(GRAMS)) * 4
    narrow = keyed.select("_h", "lang", most.cast("long").alias("most"))
    langs = narrow.groupBy("lang").agg(F.approx_count_distinct("_h").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS)
    langs = langs.collect()
    # a hash below its language's bound: half as many again as wanted
    share = {r["lang"]: min(1.0, 1.5 * rows_per_lang / max(1, r["n"]) + 1e-12) for r in langs}
    bounds = spark.createDataFrame([(x, p * 2.0**63) for x, p in share.items()], "lang string, bound double")
    low = narrow.join(F.broadcast(bounds), "lang").filter(F.shiftrightunsigned("_h", 1).cast("double") <= F.col("bound"))
    low = low.groupBy("_h", "lang").agg(F.max("most").alias("most"))
    by_lang = Window.partitionBy("lang").orderBy("_h")
    so_far = F.sum("most").over(by_lang.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    picked = low.withColumns({"_n": F.row_number().over(by_lang), "_bytes": so_far})
    picked = picked.filter((F.col("_n") <= rows_per_lang) & ((F.col("_n") == 1) | (F.col("_bytes") <= SAMPLE_BYTES // max(1, len(langs)))))
    picked = picked.select("_h", "lang").collect()  # a bounded sample's keys
    if not picked:
        return LanguageModel([], np.zeros((BUCKETS, DIMENSIONS)), np.zeros((DIMENSIONS, 1)), np.zeros(1))
    sample = spark.createDataFrame(picked, "_h long, lang string").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [subword_counts(t.as_py()) for t in batch.column(1)]
            ids = [i.astype("<u2").tobytes() for i, _ in out]
            counts = [c.astype("<f4").tobytes() for _, c in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())],
                ["lang", "h", "ids", "counts"],
            )

    texts = keyed.join(F.broadcast(sample), ["_h", "lang"], "left_semi").select("lang", "text", F.col("_h").alias("h"))
    got = texts.mapInArrow(count, "lang string, h long, ids binary, counts binary")
    # rows with one key and language but different texts: the one with the most counts, then the greatest
    best = F.max(F.struct(F.length("ids"), "ids", "counts")).alias("b")
    found = got.groupBy("h", "lang").agg(best).select("h", "lang", "b.ids", "b.counts").collect()
    samples = [
        (r.lang, np.frombuffer(r.ids, "<u2"), np.frombuffer(r.counts, "<f4"))
        for r in sorted(found, key=lambda r: (r.h, r.lang))
    ]
    return fit(samples)


def predict_language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and lang_pred, lang_score, lang_rejected.

    Only the text is looked at, as a whole.  Null texts, and texts without a letter, are ``und`` with score 0 and
    rejected; so is everything when there was nothing to learn from.  Other texts are rejected for a low score or for
    subwords that the training texts scarcely hold.  Equal texts get equal values; an empty table gives no rows.  Columns of ``docs`` with these names give way.
    """
    columns = [c for c in docs.columns if c not in ("lang_pred", "lang_score", "lang_rejected")]
    spark = docs.sparkSession
    spark_model = spark.sparkContext.broadcast(model)  # BUCKETS x DIMENSIONS doubles: 2 MB
    at = columns.index(text_col)
    schema = docs.select(*columns).schema.add("lang_pred", "string").add("lang_score", "double").add("lang_rejected", "boolean")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = spark_model.value
        folded = m.folded()
        for batch in batches:
            out = [m.predict(t.as_py(), folded) for t in batch.column(at)]
            langs, scores, rejected = ([x[k] for x in out] for k in range(3))
            added = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            names = [*batch.schema.names, "lang_pred", "lang_score", "lang_rejected"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names)

    return docs.select(*columns).mapInArrow(predict, schema)


def held_out(id_col: str = "doc_id"):  # noqa: ANN201
    """The fold that takes no part in learning: crc32 of the id as text, modulo 4, is 2. Null ids: false."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op4_language_id(spark, sf_dir):  # noqa: ANN001, ANN201
    """Predicted language of every document; learns from three of four folds."""
    from twigline.llm.common import table

    docs = table(spark, sf_dir, "documents")
    model = train_language_model(docs.filter(~held_out() & F.col("doc_id").isNotNull()))
    narrow = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict_language(narrow, model).select(
        "doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected")
    )
