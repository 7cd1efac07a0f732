"""Languages of documents and of their parts, with a confidence (problem 5).

Method: averaged embeddings of hashed subwords (character 1- to 4-grams) under
a linear softmax, trained by stochastic gradient descent in numpy on a bounded
sample of labelled rows. Labels are noisy, so rows that a first model
contradicts are dropped before the second. A temperature, fitted on held-out
sentences, calibrates the confidence; below a threshold nothing is assigned, save a
record's main language.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.sentences import split_sentences
from tessella.plans.runtime import spread

# Notations of a language label, besides tags such as "en-US".
NAMES = {
    "zh": "zh zho chi chinese 中文 汉语 漢語 简体中文 繁體中文 mandarin cn",
    "en": "en eng english englisch 英文 英语",
    "de": "de deu ger german deutsch 德语",
    "fr": "fr fra fre french français francais 法语",
    "es": "es spa spanish español espanol castellano 西班牙语",
    "pt": "pt por portuguese português portugues 葡萄牙语",
    "ja": "ja jpn japanese 日本語 日语 jp",
    "ru": "ru rus russian русский 俄语",
}
_CODES = {name: code for code, names in NAMES.items() for name in names.split()}
#: Labelled rows per language (and table) that train the model, sentences of one row, characters of one sentence.
SAMPLE_ROWS, SAMPLE_SENTENCES, SAMPLE_CHARS = 240, 8, 300
BUCKETS, DIMENSIONS, ORDERS = 1 << 17, 12, (1, 2, 3, 4)
#: Characters whose subwords are held at once.
PIECE_CHARS = 1_000_000
EPOCHS, LEAST_STEPS, RATE, BATCH = 6, 1500, 12.0, 64
#: The same for the first model, which only tells wrong labels from right ones.
FIRST_EPOCHS, FIRST_STEPS = 3, 500
#: Confidence under which a sentence gets no language, and under which not even its record's main language.
LEAST, LEAST_MAIN = 0.6, 0.3
_LETTERS = re.compile(r"[^\W\d_]+")
_EAST = re.compile(r"[぀-ヿ㐀-鿿]")


def label_code(label: Column) -> Column:
    """The two-letter code that a label names, in whatever notation; null if it names none."""
    plain = F.lower(F.trim(label))
    table = F.create_map(*[F.lit(x) for pair in _CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, plain), F.try_element_at(table, F.regexp_extract(plain, r"^([a-z]{2,3})[-_]", 1)))


def has_words(sentence: str) -> bool:
    """Whether a sentence has words enough to be in a language: names and codes alone have not."""
    if len(_EAST.findall(sentence)) >= 4:
        return True
    return sum(len(w) > 1 and (len(w) > 3 or not w.isupper() or sentence.isupper()) for w in _LETTERS.findall(sentence)) >= 4


def _grams(sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, sentence number) of every subword of the sentences."""
    text = "\n".join(" " + " ".join(_LETTERS.findall(s.lower())) + " " for s in sentences) + "\n"
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = points == 10
    owner = (np.cumsum(ends) - ends).astype(np.int32)
    buckets, owners = [], []
    h = np.zeros(len(points), np.uint64)
    crossing = np.zeros(len(points), bool)
    with np.errstate(over="ignore"):
        for n in range(1, max(ORDERS) + 1):
            m = len(points) - n + 1
            if m <= 0:
                break
            h = (h[:m] ^ points[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
            crossing = crossing[:m] | ends[n - 1 :]
            if n in ORDERS:
                keep = ~crossing if n > 1 else ~crossing & (points[:m] != 32)
                buckets.append((h[keep] & np.uint64(BUCKETS - 1)).astype(np.int32))
                owners.append(owner[:m][keep])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Model:
    """Per bucket the scores of the languages (embedding times output layer)."""

    languages: list[str]
    table: np.ndarray
    temperature: float = 1.0

    def probabilities(self, sentences: list[str]) -> np.ndarray:
        """A row per sentence; worked off in pieces of ``PIECE_CHARS``, so that memory doesn't follow the batch."""
        parts, begin, size = [np.zeros((0, len(self.languages)))], 0, 0
        for i, s in enumerate(sentences, 1):
            size += len(s)
            if size >= PIECE_CHARS or i == len(sentences):
                parts.append(self._piece(sentences[begin:i]))
                begin, size = i, 0
        return np.concatenate(parts)

    def _piece(self, sentences: list[str]) -> np.ndarray:
        buckets, owners = _grams(sentences)
        count = np.maximum(np.bincount(owners, minlength=len(sentences)), 1)
        scores = np.stack([np.bincount(owners, self.table[buckets, c], len(sentences)) for c in range(len(self.languages))], 1) / count[:, None]
        scores = scores / self.temperature
        scores = np.exp(scores - scores.max(1, keepdims=True))
        return scores / scores.sum(1, keepdims=True)


def _descend(sentences: list[str], targets: np.ndarray, classes: int, seed: int, least_epochs: int = EPOCHS, least_steps: int = LEAST_STEPS) -> np.ndarray:
    """Trains embeddings and output layer; their product."""
    rng = np.random.default_rng(seed)
    embedding = (rng.random((BUCKETS, DIMENSIONS), np.float32) - 0.5) / DIMENSIONS
    output = np.zeros((DIMENSIONS, classes), np.float32)
    buckets, owners = _grams(sentences)
    order = np.argsort(owners, kind="stable")
    buckets = buckets[order]
    starts = np.searchsorted(owners[order], np.arange(len(sentences) + 1))
    del owners, order
    usable = np.flatnonzero(np.diff(starts) > 0)
    per_epoch = len(usable) // BATCH + 1
    epochs = max(least_epochs, -(-least_steps // per_epoch))
    steps, step = epochs * per_epoch, 0
    for _ in range(epochs):
        rng.shuffle(usable)
        for at in range(0, len(usable), BATCH):
            rate = RATE * max(0.05, 1 - step / steps) / BATCH
            step += 1
            batch = usable[at : at + BATCH]
            sizes = starts[batch + 1] - starts[batch]
            take = np.repeat(starts[batch] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            b = buckets[take]
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            hidden = np.add.reduceat(embedding[b], first, 0) / sizes[:, None]
            z = hidden @ output
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), targets[batch]] -= 1
            back = (p @ output.T).astype(np.float32) * np.float32(8 * rate) / sizes[:, None].astype(np.float32)
            output -= rate * (hidden.T @ p)
            # Subwords of one bucket are added up first: a sparse update touches each bucket once.
            order = np.argsort(b, kind="stable")
            b = b[order]
            heads = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            embedding[b[heads]] -= np.add.reduceat(back[np.repeat(np.arange(len(batch)), sizes)[order]], heads, 0)
    return embedding @ output


def _unaccented(text: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", text) if not unicodedata.combining(x))


#: Models that this process has trained, by their sample: a second query over the same rows needn't train again.
_TRAINED: dict[str, Model | None] = {}
MODELS_KEPT = 4


def fit(rows: list[tuple[str, str]], seed: int = 7) -> Model | None:
    """A model from (code, sentence) rows with noisy codes; None if they name fewer than two languages.

    The same rows and seed give the same model, so it is kept by their digest.
    """
    digest = hashlib.md5(repr((seed, rows)).encode()).hexdigest()
    if digest not in _TRAINED:
        while len(_TRAINED) >= MODELS_KEPT:
            _TRAINED.pop(next(iter(_TRAINED)))
        _TRAINED[digest] = _fit(rows, seed)
    return _TRAINED[digest]


def _fit(rows: list[tuple[str, str]], seed: int) -> Model | None:
    rows = [(c, s) for c, s in rows if has_words(s)]
    languages = sorted({c for c, _ in rows})
    if len(languages) < 2:
        return None
    number = {c: i for i, c in enumerate(languages)}

    def train(pairs: list[tuple[str, str]], *least: int) -> Model:
        # Every other sentence comes without accents too.
        more = pairs + [(c, _unaccented(s)) for c, s in pairs[::2] if not s.isascii() and not _EAST.search(s) and c != "ru"]
        return Model(languages, _descend([s for _, s in more], np.array([number[c] for c, _ in more]), len(languages), seed, *least))

    first = train(rows, FIRST_EPOCHS, FIRST_STEPS)
    p = first.probabilities([s for _, s in rows])
    agreed = [x for x, q, best in zip(rows, p[np.arange(len(rows)), [number[c] for c, _ in rows]], p.argmax(1)) if languages[best] == x[0] and q > 0.5]
    rng = np.random.default_rng(seed)
    held = rng.random(len(agreed)) < 0.15
    model = train([x for x, h in zip(agreed, held) if not h])
    test = [x for x, h in zip(agreed, held) if h]
    if test:
        truth = np.array([number[c] for c, _ in test])
        losses = {}
        for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0):
            model.temperature = t
            q = model.probabilities([s for _, s in test])[np.arange(len(test)), truth]
            losses[t] = -np.log(np.maximum(q, 1e-9)).mean()
        model.temperature = min(losses, key=losses.get)
    return model


def training_rows(labelled: DataFrame, label: str, texts: Column, key: str, per_language: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """(code, sentence) of at most ``per_language`` rows of each language named, drawn by a hash of the key."""
    rows = labelled.select(label_code(F.col(label)).alias("code"), texts.alias("texts"), F.col(key).alias("k")).where("code is not null")
    order = Window.partitionBy("code").orderBy(F.xxhash64("k"), "k")
    drawn = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language).select("code", F.slice("texts", 1, SAMPLE_SENTENCES).alias("texts"), "k")
    out = []
    for row in sorted(drawn.collect(), key=lambda r: (r.code, str(r.k))):
        sentences = [s[:SAMPLE_CHARS] for t in row.texts or [] if t for s in split_sentences(t)]
        out += [(row.code, s) for s in sentences[:SAMPLE_SENTENCES]]
    return out


def languages_of_parts(records: DataFrame, model: Model | None, key: str = "rec_id", parts: str = "parts") -> DataFrame:
    """``(key, part_no, lang, confidence, n_chars)``: the languages of each part (array element, from 0) of a record.

    A part has a language if at least one of its sentences is in it; confidence
    is that of its surest sentence. Null, empty and wordless parts, and
    sentences under the least confidence, have none. A sentence of middling
    confidence goes to the record's main language if that is its second; the
    sure sentences beside it speak for the main language, so LEAST_MAIN is enough.
    """
    schema = f"{key} {records.schema[key].dataType.simpleString()}, part_no int, lang string, confidence double, n_chars bigint"
    shared = records.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            owners, sentences = [], []
            for i, texts in enumerate(batch["parts"]):
                for n, text in enumerate(texts if texts is not None else []):
                    for s in split_sentences(text):
                        if m is not None and has_words(s):
                            owners.append((i, n))
                            sentences.append(s)
            if not sentences:
                continue
            p = m.probabilities(sentences)
            sure = np.where(p.max(1) >= 0.9, p.argmax(1), -1)
            weight: dict[int, np.ndarray] = {}
            for (i, _), c, s in zip(owners, sure, sentences):
                if c >= 0:
                    weight.setdefault(i, np.zeros(p.shape[1]))[c] += len(s)
            out: dict[tuple[int, int, int], list] = {}
            for x, ((i, n), s) in enumerate(zip(owners, sentences)):
                c, main = int(p[x].argmax()), -1
                if sure[x] < 0 and i in weight:
                    main = int(weight[i].argmax())
                    if p[x].max() < 0.8 and p[x][main] >= max(0.2, np.sort(p[x])[-2]):
                        c = main
                q = float(p[x][c])
                if q < (LEAST_MAIN if c == main else LEAST):
                    continue
                got = out.setdefault((i, n, c), [0.0, 0])
                got[0] = max(got[0], q)
                got[1] += len(s)
            if not out:
                continue
            keys = batch[key].tolist()
            yield pd.DataFrame([(keys[i], n, m.languages[c], q, size) for (i, n, c), (q, size) in out.items()], columns=[key, "part_no", "lang", "confidence", "n_chars"])

    return spread(records.select(key, F.col(parts).alias("parts"))).mapInPandas(run, schema)


def news_model(bodies: DataFrame, documents: DataFrame | None = None) -> Model | None:
    """The model trained on the labelled rows of both tables."""
    rows = training_rows(bodies, "lang", F.concat(F.array("title"), F.coalesce("paragraphs", F.array().cast("array<string>"))), "rec_id")
    if documents is not None:
        rows += training_rows(documents, "lang", F.array("text"), "doc_id")
    return fit(rows)


def record_parts(bodies: DataFrame) -> DataFrame:
    """``bodies`` with title (part 0) and paragraphs (from 1) in one array; null keys fall out."""
    return bodies.where(F.col("rec_id").isNotNull()).select("rec_id", F.concat(F.array("title"), F.coalesce("paragraphs", F.array().cast("array<string>"))).alias("parts"))


def unnamed_languages(bodies: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """``(rec_id, para_no, lang)``: languages of titles and paragraphs that the record's label doesn't name."""
    found = languages_of_parts(record_parts(bodies), news_model(bodies, documents))
    # What the label names travels with the record's key; labels are short, so the join is on keys only.
    named = bodies.select(F.col("rec_id").alias("rec_id"), label_code(F.col("lang")).alias("named"))
    return found.join(named, "rec_id").where("named is null or named <> lang").select("rec_id", F.col("part_no").alias("para_no"), "lang").distinct()


def record_languages(bodies: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """``(rec_id, lang, confidence)``: the main language of each record by characters; both null where no part has words."""
    found = languages_of_parts(record_parts(bodies), news_model(bodies, documents))
    sums = found.groupBy("rec_id", "lang").agg(F.sum("n_chars").alias("n"), F.sum(F.col("confidence") * F.col("n_chars")).alias("w"))
    best = sums.groupBy("rec_id").agg(F.max_by(F.struct("lang", "w"), F.struct("n", "lang")).alias("best"), F.sum("n").alias("total"))
    main = best.select("rec_id", F.col("best.lang").alias("lang"), F.round(F.col("best.w") / F.col("total"), 4).alias("confidence"))
    return bodies.select("rec_id").where("rec_id is not null").distinct().join(main, "rec_id", "left")
