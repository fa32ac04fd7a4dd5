"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is lower-cased, ASCII characters other than letters become spaces, and
byte n-grams of ``ORDERS`` that don't reach over a word's edges are hashed into
``BUCKETS`` rows. A document's vector is the mean of its rows' embeddings; a
linear softmax on it gives the class. Both are trained by stochastic gradient
descent in numpy on a bounded sample of labelled rows. As the model is linear
behind the mean, embedding and output layer fold into one row of class logits
for each bucket for prediction, which reads whole texts.

Sample bound: ``per_class`` labelled rows of each class, chosen by a hash of
the id. Each chosen text gives its whole bag of buckets and those of two
snippets of at most ``SNIPPET`` bytes, its beginning and one from anywhere, so
that short texts are learned too. Bags are made on the executors; a bag has at
most ``BUCKETS`` entries of four bytes. All other steps read all rows and
whole texts.

Calibration: a tenth of the sample is held back from training. A temperature
is fitted on it by likelihood. A text is rejected if its score is lower than
that of all but ``reject_share`` of the correctly labelled bags held back (but
never if it is over the cap between chance and certainty, ``CAP``), or if it has
``FEW`` subwords or more and the share of them met in training lies further
below the median than three times the distance of all but ``reject_share``,
and by ``SLACK`` at least: random letters and languages that were not learned.

Defined results: text that is null or has no letter (Unicode category L) is
``und`` with score 0 and rejected; with no labelled row everything is ``und``;
rows with null lang or null doc_id are predicted but not learned from;
repeated rows give the same result. Extra columns pass through; columns named
like a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.llm.common import add_columns, table, texts_of
from lamella.llm.tokens import release_tokenizers

BUCKETS = 1 << 16
ORDERS = (3, 4)
DIM = 16
SNIPPET = 400
PER_CLASS = 1000
MIN_STEPS = 1500
#: A score over 1/k + CAP (1 - 1/k) with k languages is not rejected.
CAP = 1 / 3
FEW = 20
#: Least distance of the limit of known subwords from the median.
SLACK = 0.2
UNKNOWN = "und"

_SPACED = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_LETTER = regex.compile(r"\p{L}")


def subwords(text: bytes) -> np.ndarray:
    """Bucket of each n-gram of a text in UTF-8, words edged by one space."""
    low = text.decode("utf-8", "replace").lower().encode().translate(_SPACED)
    raw = np.frombuffer(b" " + b" ".join(low.split()) + b" ", dtype=np.uint8)
    out = []
    for n in ORDERS:
        if len(raw) < n:
            continue
        count = len(raw) - n + 1
        key = raw[:count].astype(np.uint32)
        inner = np.ones(count, dtype=bool)
        for j in range(1, n):
            part = raw[j : j + count]
            key = key * np.uint32(0x01000193) ^ part
            if j < n - 1:
                inner &= part != 0x20
        key ^= key >> np.uint32(15)
        key *= np.uint32(0x2C1B3C6D)
        key ^= key >> np.uint32(16)
        out.append(key[inner] & np.uint32(BUCKETS - 1))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


@dataclass
class Model:
    classes: list[str]
    logits: np.ndarray  # (BUCKETS, classes + 1): embedding times output layer, and whether the bucket was met in training
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0
    known_below: float = 0.0

    def raw(self, rows: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, float]:
        """Class scores of a bag of buckets, and the share of known ones."""
        if not len(rows):
            return self.bias.copy(), 1.0
        found = np.take(self.logits, rows, axis=0)
        mean = found.sum(axis=0, dtype=np.float64) / len(rows) if weights is None else weights.astype(np.float64) @ found
        return mean[:-1] + self.bias, float(mean[-1])

    def predict(self, text: bytes | None) -> tuple[str, float, bool]:
        """Language, calibrated probability of it, and whether it is rejected."""
        if not text or not self.classes or not _LETTER.search(text.decode("utf-8", "replace")):
            return UNKNOWN, 0.0, True
        rows = subwords(text)
        z, known = self.raw(rows)
        p = softmax(z / self.temperature)
        best = int(np.argmax(p))
        return self.classes[best], float(p[best]), bool(p[best] < self.reject_below or len(rows) >= FEW and known < self.known_below)


Bag = tuple[np.ndarray, np.ndarray]


def bag(rows: np.ndarray) -> Bag:
    """Distinct buckets and their shares."""
    found, n = np.unique(rows, return_counts=True)
    return found.astype(np.uint16), (n / max(1, len(rows))).astype(np.float16)


def bags_of(text: str, seed: int) -> list[Bag]:
    """The whole text's bag, and those of a snippet at its beginning and of one from anywhere; without empty ones."""
    raw = text.encode()
    rng = np.random.default_rng(seed & 0xFFFFFFFF)
    size = int(rng.integers(40, SNIPPET))
    start = int(rng.integers(0, max(1, len(raw) - size)))
    parts = [raw] if len(raw) <= size else [raw, raw[:size], raw[start : start + size]]
    found = [subwords(p.decode("utf-8", "ignore").encode()) for p in parts]
    return [bag(rows) for rows in found if len(rows)]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[list[Bag], str]], seed: int = 7, epochs: int = 4, rate: float = 0.5, reject_share: float = 0.001) -> Model:
    """rows: (bags of a text, lang). One gradient step a batch of bags; the rate falls linearly."""
    classes = sorted({lang for _, lang in rows})
    if not classes:
        return Model([], np.zeros((BUCKETS, 1), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = max(1, len(rows) // 10)
    validation, learned = [rows[i] for i in order[:held]], [rows[i] for i in order[held:]] or [rows[i] for i in order]
    of = {c: i for i, c in enumerate(classes)}
    bags, labels = [b for bs, _ in learned for b in bs], [of[lang] for bs, lang in learned for _ in bs]
    embed = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, len(classes)), dtype=np.float32)
    bias = np.zeros(len(classes), dtype=np.float32)
    batch, steps = 16, 0
    epochs = max(epochs, -(-MIN_STEPS * batch // max(1, len(bags))))  # a small sample is read more often
    total = max(1, epochs * -(-len(bags) // batch))
    for _ in range(epochs):
        mix = rng.permutation(len(bags))
        for low in range(0, len(mix), batch):
            taken = mix[low : low + batch]
            flat = np.concatenate([bags[i][0] for i in taken])
            weight = np.concatenate([bags[i][1] for i in taken]).astype(np.float32)
            counts = np.array([len(bags[i][0]) for i in taken])
            owner = np.repeat(np.arange(len(taken)), counts)
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
            mean = np.add.reduceat(embed[flat] * weight[:, None], starts, axis=0)
            y = np.zeros((len(taken), len(classes)), dtype=np.float32)
            y[np.arange(len(taken)), [labels[i] for i in taken]] = 1
            grad = softmax(mean @ out + bias) - y
            step = rate * (1 - steps / total)
            back = grad @ out.T
            out -= step * mean.T @ grad / len(taken) * 4
            bias -= step * 0.1 * grad.mean(axis=0)
            np.add.at(embed, flat, (-step * 40 / len(taken)) * back[owner] * weight[:, None])
            steps += 1
    seen = np.zeros((BUCKETS, 1), np.float32)
    for rows_of, _ in bags:
        seen[rows_of] = 1
    model = Model(classes, np.hstack([embed @ out, seen]).astype(np.float32), bias.astype(np.float64))
    return calibrate(model, validation, reject_share)


def calibrate(model: Model, rows: list[tuple[list[Bag], str]], reject_share: float) -> Model:
    bags, labels = [b for bs, _ in rows for b in bs], np.array([model.classes.index(lang) for bs, lang in rows for _ in bs])
    if not bags:
        return model
    found = [model.raw(*b) for b in bags]
    scores, known = np.array([z for z, _ in found]), np.array([k for _, k in found])
    grid = np.geomspace(0.02, 20, 60)
    likelihood = [np.log(softmax(scores / t)[np.arange(len(labels)), labels] + 1e-12).sum() for t in grid]
    model.temperature = float(grid[int(np.argmax(likelihood))])
    p = softmax(scores / model.temperature)
    right = p.argmax(axis=1) == labels
    k = len(model.classes)
    if right.any():
        model.reject_below = float(min(1 / k + CAP * (1 - 1 / k), np.quantile(p.max(axis=1)[right], reject_share)))
    many = np.array([len(b[0]) >= FEW for b in bags])
    if (right & many).any():
        median, low = np.quantile(known[right & many], [0.5, reject_share])
        model.known_below = float(median - max(SLACK, 3 * (median - low)))
    return model


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, mod 3, is 1."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def sample(documents: DataFrame, id_col: str, text_col: str, lang_col: str, per_class: int) -> list[tuple[list[Bag], str]]:
    """Bags of at most ``per_class`` labelled rows of each class outside the held-out part, the same ones for the same table."""
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    draw = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    limit = F.lit(0)
    for lang, n in counts.items():
        limit = F.when(F.col("lang") == lang, F.lit(min(1 << 30, int(1.2 * per_class / n * (1 << 30)) + 1))).otherwise(limit)
    chosen = rows.where(draw < limit).select("lang", draw.alias("draw"), F.col("id").cast("string").alias("id"), "text")

    def make(batches):
        release_tokenizers()
        for batch in batches:
            found = [bags_of(text, draw) for draw, text in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())]
            bags = [[{"rows": r.tobytes(), "share": w.tobytes()} for r, w in bs] for bs in found]
            kind = pa.list_(pa.struct([("rows", pa.binary()), ("share", pa.binary())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(bags, kind)], names=["lang", "draw", "id", "bags"])

    by_class: dict[str, list[tuple]] = {}
    for r in chosen.mapInArrow(make, "lang string, draw long, id string, bags array<struct<rows: binary, share: binary>>").collect():
        bags = [(np.frombuffer(b["rows"], np.uint16), np.frombuffer(b["share"], np.float16)) for b in r["bags"]]
        by_class.setdefault(r["lang"], []).append((r["draw"], r["id"], bags))
    return [(bags, lang) for lang in sorted(by_class) for _, _, bags in sorted(by_class[lang], key=lambda x: x[:2])[:per_class]]


RESULT = T.StructType(
    [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_rejected", T.BooleanType())]
)


def fit(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_class: int = PER_CLASS) -> Model:
    return train(sample(documents, id_col, text_col, lang_col, per_class))


def predict(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """documents with lang_pred, score and lang_rejected. The model, of fixed size, is broadcast."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        release_tokenizers()
        held = shared.value
        return lambda texts: [held.predict(t) for t in texts_of(texts)]

    return add_columns(documents, [text_col], RESULT, make)


def keep_identified(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Rows that the model does not reject, columns as they were."""
    return predict(documents, model, text_col).where(~F.col("lang_rejected")).select(*[F.col(f"`{c}`") for c in documents.columns])


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = predict(documents.select("doc_id", "text"), fit(documents))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "lang_rejected")
