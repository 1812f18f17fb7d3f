"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

Strings are words as UTF-8 bytes in lower case, over an alphabet of 32 symbols; words longer than
``WIDTH`` bytes are taken in overlapping stretches, and a run of four or more one-letter words also
counts as the word they spell. The kernel counts common subsequences of three symbols, each
discounted by the span it takes, so gaps and inserted characters lower a match but do not end it.

Training takes a bounded sample of at most ``SAMPLE`` labelled texts of either label, drawn from those of
1 to ``LONGEST`` characters, each a sentence to the machine; of their clean words the ``COMPARED`` with
the least checksums and a third as many of the most common are compared. A key labelled both ways counts
as toxic. Texts of any length are scored whole. A toxic one is only known to hold some insult, so the machine is trained in rounds: it
picks each toxic sentence's likeliest words and the hardest words of clean ones, and is fitted again. The surest words also stand there with a character inserted. The landmarks are words that tell the labels apart and common clean words.
As the kernel's features are the 32**3 triples, the fitted sum over landmarks folds into one table,
and scoring a word is a sum of table entries. A text's score is a logistic function of its two
highest-scoring words, set to the rate of toxic rows among all labelled ones.

Only text enters a score. A null or empty text has no words and gets the score of the lowest word
score; repeated rows get equal scores; without labels of both kinds every score is the share of
toxic ones (0 without any). Empty tables give no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from gleaner.llm.common import TEXT_ROWS, documents, ranges, trim, trimmed

#: Texts of either label that are learned from, and the longest of them in characters.
SAMPLE, LONGEST = 2500, 20_000
#: Symbols of a subsequence's span, its discount for each, bytes of a stretch and its step.
SPAN, DECAY, WIDTH, STEP = 8, 0.6, 24, 16
LANDMARKS, ROUNDS, THRESHOLD = 96, 4, 0.3
#: Words that training compares with the landmarks, besides those of toxic texts; sure words that get variants.
COMPARED, VARIED = 30_000, 60
#: Lowest score that a word can have.
FLOOR = -4.0
#: Words of texts whose highest scores are found together.
PLACES = 1 << 18
#: The symbol of a word's beginning.
MARK = 27
_SYMBOLS = np.full(256, 26)
_SYMBOLS[97:123] = np.arange(26)
_SYMBOLS[128:192] = 28 + np.arange(64) % 4
_OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def _norms() -> np.ndarray:
    """By length, the norm that a string's distinct triples would give."""
    out = np.zeros(WIDTH + 1)
    for n in range(3, WIDTH + 1):
        out[n] = np.sqrt(sum((n - b) * DECAY ** (2 * (b + 1)) for _, b in _OFFSETS if b < n))
    return np.maximum(out, 1e-9)


_NORMS = _norms()


def stretches(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols (a row each, padded), lengths and word numbers of all words' stretches."""
    words = words.cast(pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    sizes = np.diff(offsets) + 1  # a word begins with a mark of its own
    count = 1 + np.maximum(0, -(-(sizes - WIDTH) // STEP))
    owner = np.repeat(np.arange(len(words)), count)
    begin = STEP * ranges(np.zeros(len(words), np.int64), count)
    length = np.minimum(WIDTH, sizes[owner] - begin)
    place = begin[:, None] + np.arange(WIDTH)  # in the word with its mark
    at = np.clip(offsets[:-1][owner][:, None] + place - 1, 0, max(0, len(data) - 1))
    symbols = np.where(place == 0, MARK, _SYMBOLS[data[at]] if len(data) else 0)
    return np.where(np.arange(WIDTH) < length[:, None], symbols, 0), length, owner


def triple_sums(symbols: np.ndarray, length: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each stretch the discounted sum of the table over its triples, by its norm."""
    out = np.zeros(len(length))
    order = np.argsort(length, kind="stable")
    cuts = np.searchsorted(length[order], [0, 7, 10, 14, 18, WIDTH + 1])
    for i, j in zip(cuts[:-1], cuts[1:]):  # like lengths together, so that short words cost little
        rows = order[i:j]
        if not len(rows):
            continue
        width = int(length[rows].max())
        s = symbols[rows, :width]
        high, mid = s * 1024, s * 32
        total = np.zeros(len(rows))
        for a, b in _OFFSETS:
            if b < width:
                k = high[:, : width - b] + mid[:, a : a + width - b] + s[:, b:]
                total += DECAY ** (b + 1) * np.where(np.arange(width - b) + b < length[rows, None], table[k], 0).sum(1)
        out[rows] = total / _NORMS[length[rows]]
    return out


def many_triple_sums(symbols: np.ndarray, length: np.ndarray, tables: np.ndarray, step: int = 1024) -> np.ndarray:
    """As :func:`triple_sums` for many tables at once, given as a row of all tables' entries for each triple."""
    out = np.zeros((len(length), tables.shape[1]), np.float32)
    order = np.argsort(length, kind="stable")
    for i in range(0, len(order), step):
        rows = order[i : i + step]
        width = int(length[rows].max())
        s = symbols[rows, :width]
        total = np.zeros((len(rows), tables.shape[1]), np.float32)
        for a, b in _OFFSETS:
            for j in range(width - b):  # words of like length stand together, so few are shorter
                live = np.flatnonzero(length[rows] > j + b)
                total[live] += np.float32(DECAY ** (b + 1)) * tables[s[live, j] * 1024 + s[live, j + a] * 32 + s[live, j + b]]
        out[rows] = total / _NORMS[length[rows]][:, None].astype(np.float32)
    return out


def triples(word: bytes) -> np.ndarray:
    """The feature vector of a word's first stretch over all triples, by its norm (landmarks are stretches)."""
    s = np.append(MARK, _SYMBOLS[np.frombuffer(word[: WIDTH - 1], np.uint8)])
    out = np.zeros(32**3)
    for a, b in _OFFSETS:
        if b < len(s):
            np.add.at(out, s[: len(s) - b] * 1024 + s[a : a + len(s) - b] * 32 + s[b:], DECAY ** (b + 1))
    return out / _NORMS[len(s)]


def words_of(texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of the texts, each place's word number, and where each text's places begin."""
    low = pc.utf8_lower(pa.array(texts, pa.large_string()).fill_null(""))
    split = pc.ascii_split_whitespace(low)
    words, cuts = split.flatten(), split.offsets.to_numpy()
    single = (pc.binary_length(words).to_numpy() == 1).astype(np.int8)
    if single.sum() >= 4:  # the words that runs of one-letter words spell stand in place of their first letter
        edge = np.zeros(len(words) + 1, bool)
        edge[cuts] = True
        step = np.diff(np.append(0, single))
        starts = np.flatnonzero((single == 1) & ((step == 1) | edge[:-1]))
        ends = np.flatnonzero((single == 1) & (np.append(single[1:], 0) == 0) | (single == 1) & edge[1:]) + 1
        long = ends - starts >= 4
        if long.any():
            spelled = ["".join(words[i:j].to_pylist()) for i, j in zip(starts[long].tolist(), ends[long].tolist())]
            mask = np.zeros(len(words), bool)
            mask[starts[long]] = True
            words = pc.replace_with_mask(words, pa.array(mask), pa.array(spelled, pa.large_string()))
    seen = words.dictionary_encode()
    return seen.dictionary, seen.indices.to_numpy(), cuts


def vocabulary_of(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """As :func:`words_of`, a group of texts at a time, so that little more than the word numbers is held."""
    index: dict[str, int] = {}
    codes, sizes, begin, chars = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0, 0
    for i, text in enumerate(texts):
        chars += len(text)
        if chars >= 1 << 20 or i == len(texts) - 1:
            words, places, cuts = words_of(texts[begin : i + 1])
            number = np.fromiter((index.setdefault(w, len(index)) for w in words.to_pylist()), np.int32, len(words))
            codes.append(number[places])
            sizes.append(np.diff(cuts))
            begin, chars = i + 1, 0
    return pa.array(list(index), pa.large_string()), np.concatenate(codes), np.append(0, np.cumsum(np.concatenate(sizes)))


class Model:
    """A table of triples' weights with a bias, and the logistic function of two word scores."""

    def __init__(self, table: np.ndarray, bias: float, logistic: np.ndarray, constant: float | None = None):
        self.table, self.bias, self.logistic, self.constant = table, bias, logistic, constant

    def word_scores(self, words: pa.Array, step: int = 16384) -> np.ndarray:
        parts = [self._word_scores(words.slice(i, step)) for i in range(0, len(words), step)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _word_scores(self, words: pa.Array) -> np.ndarray:
        symbols, length, owner = stretches(words)
        scores = triple_sums(symbols, length, self.table) + self.bias
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
        return np.maximum(FLOOR, np.maximum.reduceat(scores, first)) if len(first) else scores

    def tops(self, words: pa.Array, codes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """For each text the scores of its two highest-scoring places (FLOOR where there are none)."""
        scores, out, i = self.word_scores(words), np.full((len(cuts) - 1, 2), FLOOR), 0
        while i < len(out):  # texts of about PLACES words at a time
            j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + PLACES, "right")) - 1)
            score, sizes = scores[codes[cuts[i] : cuts[j]]], np.diff(cuts[i : j + 1])
            full = np.flatnonzero(sizes > 0)
            if len(full):
                starts = (cuts[i:j] - cuts[i])[full]
                best = np.maximum.reduceat(score, starts)
                owner = np.repeat(np.arange(len(full)), sizes[full])
                place = np.maximum.reduceat(np.where(score == best[owner], np.arange(len(score)), -1), starts)
                score[place], out[i + full, 0] = FLOOR, best
                out[i + full, 1] = np.maximum.reduceat(score, starts)
            i = j
        return out

    def scores(self, texts: list[str | None], group_chars: int = 2_000_000) -> np.ndarray:
        """The score, 0 to 1, of every whole text."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out, group, chars = [], [], 0
        for i, text in enumerate(texts):
            group.append(text)
            chars += len(text or "")
            if chars >= group_chars or i == len(texts) - 1:
                x = self.tops(*words_of(group)) @ self.logistic[:2] + self.logistic[2]
                out.append(1 / (1 + np.exp(-np.clip(x, -30, 30))))
                group, chars = [], 0
        return np.concatenate(out) if out else np.zeros(0)


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 4.0) -> np.ndarray:
    """Weights (bias last) of a linear machine with squared hinge loss, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(30):
        on = y * (x @ w) < 1
        s = x[on] * (c * weight[on])[:, None]
        new = np.linalg.solve(ridge + s.T @ x[on], s.T @ y[on])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _variants(words: list[bytes]) -> list[bytes]:
    """Words with one character inserted or doubled, or with a mark between all letters."""
    out = [w[:i] + x + w[i:] for n, w in enumerate(words) for i in range(1, len(w)) for x in (b"-", b"*", w[i - 1 : i], bytes([97 + (7 * n + 3 * i) % 26]))]
    return out + [mark.join(w[i : i + 1] for i in range(len(w))) for w in words if w.isascii() for mark in (b".", b"-")]


def train(texts: list[str], toxic: list[int], rate: float | None = None) -> Model:
    """Fit on labelled texts. ``rate`` is the share of toxic rows among all that are labelled: the
    sample has more of them, so the logistic function's constant moves to that rate."""
    unique = {}
    for text, label in zip(texts, toxic):
        unique.setdefault(text, int(label))  # copies would lend weight to the words of one text
    y = np.array(list(unique.values()))
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(32**3), 0.0, np.zeros(3), float(y.mean()) if len(y) else 0.0)
    vocabulary, codes, cuts = vocabulary_of(list(unique))
    del unique
    names = [w.encode() for w in vocabulary.to_pylist()]
    sets = [np.unique(codes[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    hits = np.zeros((2, len(names)))
    for s, label in zip(sets, y):
        hits[label, s] += 1
    odds = np.log((hits[1] + 0.5) / (y.sum() + 1)) - np.log((hits[0] + 0.5) / (len(y) - y.sum() + 1))
    evidence = odds * np.sqrt(hits[1]) * (odds > 1.5)
    telling = np.argsort(-evidence, kind="stable")
    common = np.argsort(-hits[0], kind="stable")
    # Landmarks: words that tell the labels apart and common clean words, none too like another.
    landmarks, features = [], np.zeros((LANDMARKS, 32**3))
    for words, share in ((telling, LANDMARKS // 2), (common, LANDMARKS)):
        for k in words[: 20 * LANDMARKS]:
            if len(landmarks) >= share:
                break
            if len(names[k]) >= 3 and (words is common or odds[k] > 1.5 and hits[1, k] >= 2):
                f = triples(names[k])
                if (features[: len(landmarks)] @ f).max(initial=0) < 0.95:
                    features[len(landmarks)] = f
                    landmarks.append(k)
    features = features[: len(landmarks)]
    if not landmarks:
        return Model(np.zeros(32**3), 0.0, np.zeros(3), float(y.mean()))
    values, vectors = np.linalg.eigh(features @ features.T)
    values = np.maximum(values, 1e-6)
    root = vectors @ np.diag(values**-0.5) @ vectors.T

    tables, root = np.ascontiguousarray(features.T, np.float32), root.astype(np.float32)
    del landmarks, values, vectors

    def mapped_words(words: pa.Array, step: int = 16384) -> tuple[np.ndarray, np.ndarray]:
        """Features of all stretches of the words, and where each word's begin."""
        out, begins, done = [np.zeros((0, len(features)), np.float32)], [np.zeros(0, np.int64)], 0
        for i in range(0, len(words), step):
            symbols, length, owner = stretches(words.slice(i, step))
            out.append(many_triple_sums(symbols, length, tables) @ root)
            begins.append(done + np.flatnonzero(np.append(True, owner[1:] != owner[:-1])))
            done += len(owner)
        return np.concatenate(out), np.concatenate(begins)

    def likeliest(stretches_: np.ndarray, begins: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word the row of its highest-scoring stretch, and that score."""
        scores = stretches_ @ w[:-1].astype(np.float32) + np.float32(w[-1])
        best = np.maximum.reduceat(scores, begins)
        word = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(scores))))
        return np.maximum.reduceat(np.where(scores == best[word], np.arange(len(scores)), -1), begins), best

    chosen = np.zeros(len(names), bool)
    chosen[(odds > 0.5) & (hits[1] > 0)] = True
    chosen[common[: COMPARED // 3]] = True
    chosen[np.argsort([zlib.crc32(w) for w in names], kind="stable")[:COMPARED]] = True
    pieces, begins = mapped_words(vocabulary.filter(pa.array(chosen)))
    rows = begins  # of the chosen words' likeliest stretches
    row_of = np.cumsum(chosen) - 1  # of a chosen word, in rows
    common = common[chosen[common]]
    negative = common[:4000]
    inserted = np.zeros((0, len(features)))
    clean = [s[chosen[s]] for s, label in zip(sets, y) if not label]
    sentences = [s[chosen[s]] for s, label in zip(sets, y) if label]
    positive = np.array([k for s in sentences for k in s[np.argsort(-evidence[s], kind="stable")[:2]] if evidence[k] > 0], np.int64)
    if not len(positive):
        return Model(np.zeros(32**3), 0.0, np.zeros(3), float(y.mean()))
    for turn in range(ROUNDS):
        x = np.vstack([pieces[rows[row_of[positive]]], inserted, pieces[rows[row_of[negative]]]]).astype(float)
        sizes = [len(positive), len(inserted), len(negative)]
        sign = np.repeat([1.0, 1.0, -1.0], sizes)
        w = _svm(x, sign, np.repeat([1000 / max(1, sizes[0]), 1000 / max(1, sizes[1]), 1000 / max(1, sizes[2])], sizes))
        scores = np.full(len(names), FLOOR)
        rows, scores[chosen] = likeliest(pieces, begins, w)
        ranked = (s[np.argsort(-scores[s], kind="stable")[:4]] for s in sentences)
        positive = np.array([k for s in ranked for n, k in enumerate(s) if odds[k] > 2.0 and (n < 2 or scores[k] > 0)], np.int64)
        hard = [k for s in clean for k in s[np.argsort(-scores[s], kind="stable")[:3]]]
        negative = np.concatenate([common[:2000], np.array(hard, np.int64)])
        if not len(positive):
            break
        if turn >= ROUNDS // 2 - 1:  # by now the words picked most often are insults
            picked, often = np.unique(positive, return_counts=True)
            sure = [names[k] for k in picked[np.argsort(-often, kind="stable")][:VARIED] if len(names[k]) >= 4 and odds[k] > 2.5]
            variants = _variants(sure)
            if variants:
                parts, first = mapped_words(pa.array(variants, pa.large_binary()))
                inserted = parts[likeliest(parts, first, w)[0]]
    model = Model((root @ w[:-1]) @ features, float(w[-1]), np.zeros(3))
    model.logistic = _logistic(model.tops(vocabulary, codes, cuts), y.astype(float))
    if rate is not None and 0 < rate < 1:
        drawn = y.mean()
        model.logistic[2] += np.log(rate / (1 - rate)) - np.log(drawn / (1 - drawn))
    return model


def learnable(key: str):
    """Rows that labels may be learned from: crc32 of the key as text, modulo 4, is not 2."""
    return F.crc32(F.col(key).cast("string")) % 4 != 2


def train_on(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on at most ``SAMPLE`` labelled texts of either label, the first by a hash of the key.

    Labels whose text is absent, empty or over ``LONGEST`` characters take no place in the sample.
    """
    marked = labels.where(F.col(label).isin(0, 1) & learnable(key)).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("label"))
    texts = df.where(F.length(text).between(1, LONGEST)).select(key, F.col(text).alias("text"))
    present = marked.join(texts.select(key), key, "left_semi")  # keys alone, so no text is shuffled
    drawn = [present.where(F.col("label") == v).orderBy(F.xxhash64(key), key).limit(SAMPLE) for v in (0, 1)]
    rows = []
    for part in drawn:
        rows += texts.join(part, key).orderBy(F.xxhash64(key), key).limit(SAMPLE).select("text", "label").collect()
    rate = marked.agg(F.avg("label")).first()[0]
    model = train([r["text"] for r in rows], [r["label"] for r in rows], rate)
    del rows, part
    trim()
    return model


def score_toxicity(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with the columns toxicity (0 to 1) and toxic (1 from ``THRESHOLD`` on)."""
    kept = df.drop("toxicity", "toxic")
    schema = StructType([*kept.schema.fields, StructField("toxicity", DoubleType()), StructField("toxic", IntegerType())])
    shared, at = df.sparkSession.sparkContext.broadcast(model), kept.columns.index(text)

    def run(batches):
        for batch in batches:
            scores = shared.value.scores(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], names=schema.names)

    return kept.mapInArrow(trimmed(run, TEXT_ROWS), schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train_on(docs, documents(spark, sf_dir, "labels"))
    held_out = F.coalesce(~learnable("doc_id"), F.lit(False))
    return score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic").alias("predicted"))
