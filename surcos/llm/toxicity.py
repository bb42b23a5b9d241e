"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words sums over the subsequences of ``ORDER`` characters that both have;
an occurrence that spans more characters than it has counts ``DECAY`` per gap, so inserted
and gapped characters weaken a match but do not break it. Words carry a mark at either end.
Sentences are scored by their worst word; a run of single characters is also read as one word.

Training sees at most ``MAX_LABELLED`` labelled documents (by hash of their id). Words of
toxic sentences whose document frequency is far above that in clean documents are the
witnesses of their sentences, words of clean sentences the counterexamples; after a first
fit the clean words that score highest are added; the strongest witnesses are also learnt bent.
``LANDMARKS`` of these words span the
Nyström space, in which a linear support vector machine is fitted. Since the kernel is a
sum over subsequences, the weighted landmarks collapse into one table of subsequence
weights, and a word costs one look-up per subsequence.

A logistic fit on the training documents turns the highest sentence scores, their number
and the number of sentences into a score from 0 to 1. Only the text enters a score.

Defined cases: null and empty texts have no sentences and get the score of that; very long
words are read in overlapping windows of ``LONGEST`` characters; null labels are not
learnt from; without labels of both kinds every score is the share of toxic labels (0 if
there are none); repeated rows score alike.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surcos.llm.words import flat_words, slices
from surcos.sources.scratch import materialise

ORDER = 3
DECAY = 0.6
SPAN = 7  # characters that an occurrence may extend over
LONGEST = 24
MAX_LABELLED = 20_000
MAX_WORDS = 60_000  # counted words that training takes to the driver
SIGNAL = 2.2  # standard errors by which a witness is more frequent in toxic documents
WITNESSES, OTHERS = 1500, 3000
LANDMARKS = 512
VARIED = 100  # witnesses that are also learnt with a character put in, doubled or left out
COST = 20.0
SLICE = 24 << 20
_SIGMA = 64
_TRIM = ".,;:!?\"'()[]{}<>|#*$%&_-+=/\\~`"
_ENDS = r"[.!?]\W*$"
_INNER = re.compile(r"[\W_]+")
FEATURES = 6


def _codes() -> np.ndarray:
    """Character classes 3.. by code point: letters of their own, the rest by remainder; 1 and 2 are the ends."""
    code = np.arange(0x110000) % (_SIGMA - 40) + 40
    for k, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789"):
        code[ord(c)] = 3 + k
    return code.astype("u1")


_CODE = _codes()


def _shapes(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all subsequences of a word of n codes, and their weights."""
    at = [
        (i, *rest)
        for i in range(n - ORDER + 1)
        for rest in itertools.combinations(range(i + 1, min(n, i + SPAN)), ORDER - 1)
    ]
    at = np.array(at)
    return at, DECAY ** (at[:, -1] - at[:, 0] + 1 - ORDER)


_SHAPES = {n: _shapes(n) for n in range(ORDER, LONGEST + 3)}


def coded(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per word length: which words, and their codes with end marks.

    Longer words come as windows; words with other signs inside come without these as well.
    """
    owner, parts = [], []
    squeezed = [(k, _INNER.sub("", w)) for k, w in enumerate(words) if not w.isalnum()]
    for k, w in [*enumerate(words), *(x for x in squeezed if len(x[1]) > 2)]:
        if len(w) <= LONGEST:
            owner.append(k)
            parts.append(w)
        else:
            for i in range(0, len(w) - LONGEST // 2, LONGEST // 2):
                owner.append(k)
                parts.append(w[i : i + LONGEST])
    size = np.array([len(p) for p in parts], "i8")
    flat = _CODE[np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")]
    begin = np.cumsum(size) - size
    own = np.array(owner, "i8")
    for n in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == n)
        for i in range(0, len(at), 8192):
            rows = at[i : i + 8192]
            body = flat[begin[rows][:, None] + np.arange(n)]
            ends = np.ones((len(rows), 1), "u1")
            yield own[rows], np.concatenate([ends, body, 2 * ends], axis=1)


def _index(codes: np.ndarray, places: np.ndarray) -> np.ndarray:
    index = codes[:, places[0]].astype("i4")
    for p in places[1:]:
        index = index * _SIGMA + codes[:, p]
    return index


def word_scores(words: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    """The decision function of each word; -inf for an empty one."""
    out = np.full(len(words), -np.inf, "f4")
    for own, codes in coded(words):
        places, weight = _SHAPES[codes.shape[1]]
        total = np.zeros(len(codes), "f4")
        for p, w in zip(places, weight):
            total += np.float32(w) * table[_index(codes, p)]
        np.maximum.at(out, own, total / np.float32(np.sqrt((weight**2).sum())) + np.float32(bias))
    return out


def feature_rows(words: list[str]):
    """Scaled subsequence weights of each word as (rows, columns, values); windows of a word add up."""
    rows, columns, values = [], [], []
    for own, codes in coded(words):
        places, weight = _SHAPES[codes.shape[1]]
        scale = weight / np.sqrt((weight**2).sum())
        for p, w in zip(places, scale):
            rows.append(own)
            columns.append(_index(codes, p))
            values.append(np.full(len(own), w))
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(values)


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel values of words and landmarks."""
    r, c, v = feature_rows(landmarks)
    used, place = np.unique(c, return_inverse=True)
    dense = np.zeros((len(used), len(landmarks)))
    np.add.at(dense, (place, r), v)
    out = np.zeros((len(words), len(landmarks)))
    for i in range(0, len(words), 500):
        r, c, v = feature_rows(words[i : i + 500])
        k = np.minimum(np.searchsorted(used, c), len(used) - 1)
        hit = used[k] == c
        np.add.at(part := np.zeros((len(words[i : i + 500]), len(used))), (r[hit], k[hit]), v[hit])
        out[i : i + 500] = part @ dense
    return out


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Linear squared-hinge machine by Newton steps on the rows inside the margin; last entry: bias."""
    x = np.concatenate([z, np.ones((len(z), 1))], axis=1)
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        inside = y * (x @ w) < 1
        a, c = x[inside], COST * weight[inside]
        new = np.linalg.solve(ridge + a.T @ (a * c[:, None]), a.T @ (c * y[inside]))
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


@dataclass
class Model:
    table: np.ndarray  # subsequence weights
    bias: float
    logistic: np.ndarray  # of the document features, last entry: intercept


def _fit_words(words: list[str], y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    order = np.argsort(-weight, kind="stable")
    pick = lambda label: [words[k] for k in order if y[k] == label][: LANDMARKS // 2]
    landmarks = pick(1) + pick(-1)
    value, vector = np.linalg.eigh(kernel(landmarks, landmarks))
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    w = _svm(kernel(words, landmarks) @ root, y, weight)
    share = root @ w[:-1]
    r, c, v = feature_rows(landmarks)
    table = np.zeros(_SIGMA**ORDER)
    np.add.at(table, c, v * share[r])
    return table.astype("f4"), float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    ridge = 0.1 * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def sentences(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Trimmed lower-case words of the texts, the sentence number of each, and the text of each sentence.

    Runs of three or more single characters follow at the end as further words of their sentence.
    """
    flat, begin = flat_words(texts)
    closes = pc.match_substring_regex(flat, _ENDS).to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, bool)
    last = np.zeros(len(flat), bool)
    last[begin[1:][begin[1:] > begin[:-1]] - 1] = True
    breaks = closes | last
    sentence = np.cumsum(breaks) - breaks
    doc = np.repeat(np.arange(len(texts)), np.diff(begin))
    of = doc[breaks]
    plain = pc.utf8_trim(pc.utf8_lower(flat), characters=_TRIM)
    single = pc.equal(pc.utf8_length(plain), 1).to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, bool)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype("i1"), [0]])))
    runs = [(a, b) for a, b in zip(edge[::2], edge[1::2]) if b - a >= 3]
    if runs:
        more = pa.array(["".join(plain[a:b].to_pylist()) for a, b in runs], plain.type)
        plain = pa.concat_arrays([plain, more])
        sentence = np.concatenate([sentence, sentence[[b - 1 for _, b in runs]]])
    return plain, sentence, of


def document_features(texts: pa.Array, table: np.ndarray, bias: float) -> np.ndarray:
    plain, sentence, of = sentences(texts)
    out = np.zeros((len(texts), FEATURES))
    out[:, :3] = -2.0
    if len(of) == 0:
        return out
    words = plain.dictionary_encode()
    score = word_scores(words.dictionary.to_pylist(), table, bias)[words.indices.to_numpy()]
    worst = np.full(len(of), -2.0)
    np.maximum.at(worst, sentence, np.clip(score, -2.0, 2.0))
    count = lambda k: np.log1p(np.bincount(of[k], minlength=len(texts)))
    order = np.lexsort((-worst, of))
    start = np.searchsorted(of[order], np.arange(len(texts)))
    stop = np.searchsorted(of[order], np.arange(len(texts)), "right")
    for k in range(3):
        has = start + k < stop
        out[has, k] = worst[order][start[has] + k]
    for k, limit in enumerate((0.0, 0.5)):
        out[:, 3 + k] = count(sentence[score > limit])
    out[:, 5] = count(np.arange(len(of)))
    return out


def _word_counts(train: DataFrame) -> DataFrame:
    """In how many toxic and clean documents each word occurs; ``train``: text, toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                plain, sentence, of = sentences(part.column("text"))
                words = plain.dictionary_encode()
                code = words.indices.to_numpy()
                toxic = part.column("toxic").to_numpy(zero_copy_only=False)
                met = np.unique(code.astype("i8") << 32 | of[sentence]) if len(code) else np.zeros(0, "i8")
                n = len(words.dictionary)
                hot = toxic[met & 0xFFFFFFFF] == 1
                all_ = np.bincount(met >> 32, minlength=n)
                bad = np.bincount(met[hot] >> 32, minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [words.dictionary, pa.array(bad, pa.int64()), pa.array(all_ - bad, pa.int64())], ["word", "bad", "good"]
                )

    counted = train.mapInArrow(run, "word string, bad bigint, good bigint").where("word <> ''")
    return counted.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def _bent(word: str) -> list[str]:
    """A word with a character put in, one doubled and one left out, all in the middle."""
    m = len(word) // 2
    return [word[:m] + "x" + word[m:], word[:m] + word[m - 1 :], word[:m] + word[m + 1 :]] if len(word) > 3 else []


def bounded(labels: DataFrame, toxic: str = "toxic", key: str = "doc_id", most: int = MAX_LABELLED) -> DataFrame:
    """At most ``most`` labels 0 or 1, as (``key``, ``toxic``); few enough to broadcast to the texts."""
    known = labels.where(F.col(toxic).isin(0, 1)).select(key, toxic)
    n = known.count()
    if n > most:  # an even share by hash, a little below the bound, which the limit then only enforces
        known = known.where(F.pmod(F.xxhash64(F.lit(5), key), F.lit(1_000_003)) < int(970_003 * most / n)).limit(most)
    return known


def fit(labelled: DataFrame, text: str = "text", toxic: str = "toxic") -> Model:
    """Learn from the rows with label 0 or 1; :func:`bounded` keeps their number in bounds."""
    known = labelled.where(F.col(toxic).isin(0, 1))
    train = materialise(known.select(F.col(text).alias("text"), F.col(toxic).cast("int").alias("toxic")), "labelled")
    sizes = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        share = bad / (bad + good) if bad + good else 0.0
        flat = np.zeros(FEATURES + 1)
        flat[-1] = np.log((share + 1e-9) / (1 - share + 1e-9))
        return Model(np.zeros(_SIGMA**ORDER, "f4"), 0.0, flat)
    words = _learn_words(train)
    return Model(*words, _logistic(*_features(train, words)))


def _learn_words(train: DataFrame) -> tuple[np.ndarray, float]:
    """Table and bias from the words of ``train`` (text, toxic)."""
    counts = materialise(_word_counts(train), "labelled-words")
    sizes = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return np.zeros(_SIGMA**ORDER, "f4"), 0.0
    odds = F.log(((F.col("bad") + 0.5) / bad) / ((F.col("good") + 0.5) / good))
    usual = F.col("good") / good * bad
    signal = (F.col("bad") - usual) / F.sqrt(usual + 1)
    ranked = counts.select("word", "bad", "good", odds.alias("odds"), signal.alias("signal")).orderBy(
        F.desc(F.col("signal") >= SIGNAL), F.desc("good"), F.xxhash64("word")).limit(MAX_WORDS)
    table = ranked.toPandas()
    gain = table["bad"].to_numpy() * table["odds"].to_numpy()
    witness = np.flatnonzero((table["signal"] >= SIGNAL) & (table["odds"] > 1.5))
    witness = witness[np.argsort(-gain[witness], kind="stable")][:WITNESSES]
    clean = np.flatnonzero((table["good"] >= 1) & (table["odds"] < 0.7))
    spread = clean[np.linspace(0, len(clean) - 1, min(len(clean), OTHERS)).astype(int)] if len(clean) else clean
    words = table["word"].tolist()
    bent = [(k, b) for k in witness[:VARIED].tolist() for b in _bent(words[k])]
    model = np.zeros(_SIGMA**ORDER, "f4"), 0.0
    for _ in range(2 if len(witness) and len(spread) else 0):
        rows = np.concatenate([witness, spread])
        y = np.concatenate([np.ones(len(witness)), -np.ones(len(spread))])
        weight = np.concatenate([np.sqrt(gain[witness]), np.log1p(table["good"].to_numpy()[spread])])
        weight[y > 0] *= weight[y < 0].sum() / weight[y > 0].sum()
        more = np.array([weight[np.flatnonzero(rows == k)[0]] / 4 for k, _ in bent])
        model = _fit_words(
            [words[k] for k in rows] + [b for _, b in bent], np.append(y, np.ones(len(bent))), np.append(weight, more)
        )
        score = word_scores([words[k] for k in clean], *model)
        hard = clean[np.argsort(-score, kind="stable")[: OTHERS // 4]]
        spread = np.unique(np.concatenate([spread, hard]))
    return model


def _features(docs: DataFrame, model: tuple[np.ndarray, float]) -> tuple[np.ndarray, np.ndarray]:
    """Document features and labels, in an order that does not depend on the layout."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                x = document_features(part.column("text"), *shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), part.column("toxic")], ["x", "toxic"])

    rows = docs.select("text", "toxic").mapInArrow(run, "x array<double>, toxic int").toPandas()
    x = np.array(rows["x"].tolist(), "f8").reshape(-1, FEATURES)
    y = rows["toxic"].to_numpy("f8")
    order = np.lexsort((*x.T, y))
    return x[order], y[order]


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``doc``, ``score`` and ``worst`` (the highest sentence score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the table is of fixed size, 1 MB
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), F.col(f"`{text}`").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, "_text", SLICE):
                x = document_features(part.column("_text"), m.table, m.bias)
                p = 1 / (1 + np.exp(-np.clip(x @ m.logistic[:-1] + m.logistic[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(p), pa.array(x[:, 0])], ["doc", "score", "worst"])

    return given.mapInArrow(run, f"doc {given.schema['doc'].dataType.simpleString()}, score double, worst double")


def held_out(doc_id: Column) -> Column:
    """Documents that no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
