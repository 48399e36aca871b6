"""Language identification with string kernels, Nystroem landmarks and one-versus-rest kernel ridge regression.

The kernel of two texts is the blended-spectrum presence kernel: the number of character n-grams (1 to `grams`)
that both hold, over the root of the product of their own numbers. It is a cosine of presence vectors, so a batch
of texts is scored by three matrix products: presence x landmarks, kernel x whitening, features x weights. Every n-gram
has a number of its own, whatever its script; the model holds those of the landmarks, all others count as unshared.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

_PIECE = 1 << 20
_BITS = 21  # of a code point; three fit a long
_NONE = (1 << _BITS) - 1  # no code point: fills the places of shorter n-grams
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Per code point: 0 no letter, else the code point of its single-character lower case."""
    global _letters
    if _letters is None:
        low = np.zeros(sys.maxunicode + 1, np.int32)
        for c in range(sys.maxunicode + 1):
            ch = chr(c)
            if ch.isalpha():
                one = ch.lower()
                low[c] = ord(one) if len(one) == 1 else c
        _letters = low
    return _letters


def _codes(text: str) -> Iterator[np.ndarray]:
    """Lower-cased letters of a text in pieces, every run of other characters as one 0, framed by 0."""
    low, last = _letter_table(), -1
    for at in range(0, max(len(text), 1), _PIECE):
        raw = np.frombuffer(text[at : at + _PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        own = low[raw].astype(np.int64)
        own = np.concatenate([np.zeros(int(last < 0), np.int64), own, np.zeros(int(at + _PIECE >= len(text)), np.int64)])
        keep = (own != 0) | (np.concatenate([[last], own[:-1]]) != 0)
        own = own[keep]
        if len(own):
            last = int(own[-1])
            yield own


def text_grams(text: str, grams: int = 3) -> np.ndarray:
    """The distinct character n-grams, 1 to `grams`, of a whole text as sorted numbers, one for each n-gram."""
    kept, parts = np.zeros(0, np.int64), []
    for own in _codes(text):
        c = np.concatenate([kept, own])
        for n in range(1, grams + 1):
            number = np.full(max(len(c) - n + 1, 0), (1 << _BITS * (3 - n)) - 1, np.int64)
            for k in range(n):
                number = (number << _BITS) | c[k : k + len(number)]
            parts.append(np.unique(number))
        kept = c[len(c) - grams + 1 :] if grams > 1 else c[:0]
    return np.unique(np.concatenate(parts))


@dataclass
class LanguageModel:
    languages: list[str]
    grams: int
    known: np.ndarray  # sorted numbers of all n-grams that a landmark holds
    landmarks: np.ndarray  # known n-grams x landmarks, 1 where the landmark holds it
    white: np.ndarray  # landmarks x features
    weights: np.ndarray  # (features + 1) x languages
    least_known: float = 0.0  # the share of known n-grams from which a language can be told

    def seen(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text the number of its n-grams and how many are known; and the presence of the known ones, as rows."""
        own, held = np.zeros(len(texts)), np.zeros(len(texts))
        presence = np.zeros((len(texts), len(self.known)), np.float32)
        for i, t in enumerate(texts):
            g = text_grams(t, self.grams)
            at = np.searchsorted(self.known, g)
            at = at[np.append(self.known, -1)[at] == g]
            presence[i, at] = 1.0
            own[i], held[i] = len(g), len(at)
        return own, held, presence

    def kernel(self, own: np.ndarray, presence: np.ndarray) -> np.ndarray:
        """Shared n-grams over the root of the product of the numbers of n-grams."""
        theirs = np.sqrt(np.maximum(self.landmarks.sum(0, dtype=np.float32), 1.0))
        some = np.flatnonzero(presence.any(0))
        shared = presence[:, some] @ self.landmarks[some].astype(np.float32)
        return shared / np.sqrt(np.maximum(own, 1.0))[:, None] / theirs[None, :]

    def scored(self, texts: list[str], batch: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """(score per language, share of known n-grams) of each text."""
        scores, shares = [np.zeros((0, len(self.languages)))], [np.zeros(0)]
        for i in range(0, len(texts), batch):
            own, held, presence = self.seen(texts[i : i + batch])
            x = self.kernel(own, presence) @ self.white
            scores.append(np.hstack([x, np.ones((len(x), 1))]) @ self.weights)
            shares.append(held / np.maximum(own, 1))
        return np.vstack(scores), np.concatenate(shares)


def fit(texts: list[str], langs: list[str], landmarks: int = 160, grams: int = 3, ridge: float = 1.0, landmark_chars: int = 2_000) -> LanguageModel | None:
    """Fit on labelled texts; None if there are none. Rows must come in a fixed order.

    Each language has the same number of landmarks, `landmarks` in all but four each at least: its first texts in the
    order given, of which `landmark_chars` characters from the middle count. All n-grams that they hold are columns. The
    other texts, whole, give the ridge regression; those that are no landmark also the share of known n-grams under
    which no language can be told, half of the smallest found.
    """
    if not 1 <= grams <= 3:
        raise ValueError("grams must be 1, 2 or 3")
    languages = sorted(set(langs))
    if not languages:
        return None
    most = max(4, -(-landmarks // len(languages)))
    pick, taken = [], dict.fromkeys(languages, 0)
    for i, lang in enumerate(langs):
        if taken[lang] < most:
            taken[lang] += 1
            pick.append(i)

    def middle(t: str) -> str:
        start = max(0, len(t) - landmark_chars) // 2
        return t[start : start + landmark_chars]

    parts = [text_grams(middle(texts[i]), grams) for i in pick]
    known = np.unique(np.concatenate(parts))
    held = np.zeros((len(known), len(pick)), np.uint8)
    for k, g in enumerate(parts):
        held[np.searchsorted(known, g), k] = 1
    model = LanguageModel(languages, grams, known, held, np.zeros((len(pick), 0)), np.zeros((0, 0)))
    values, vectors = np.linalg.eigh(model.kernel(held.sum(0), held.T.astype(np.float32)).astype(np.float64))
    some = values > 1e-6 * max(values.max(), 1e-12)
    model.white = vectors[:, some] / np.sqrt(values[some])
    # Every language weighs the same, however many texts it has.
    number = {lang: langs.count(lang) for lang in languages}
    size = model.white.shape[1] + 1
    left, right, shares = ridge * np.eye(size), np.zeros((size, len(languages))), []
    left[-1, -1] = 1e-6
    no_landmark = np.ones(len(texts), bool)
    no_landmark[pick] = False
    for i in range(0, len(texts), 64):
        own, found, presence = model.seen(texts[i : i + 64])
        x = np.hstack([model.kernel(own, presence) @ model.white, np.ones((len(own), 1))])
        part = langs[i : i + 64]
        weighed = x * np.array([len(langs) / len(languages) / number[lang] for lang in part])[:, None]
        left += weighed.T @ x
        right += weighed.T @ np.array([[float(lang == one) for one in languages] for lang in part])
        shares += (found / np.maximum(own, 1))[no_landmark[i : i + 64]].tolist()
    model.weights = np.linalg.solve(left, right)
    model.least_known = 0.5 * min(shares, default=0.0)
    return model


def training_sample(docs: DataFrame, per_language: int = 200, max_chars: int = 20_000, max_texts: int = 10_000) -> tuple[list[str], list[str]]:
    """Labelled texts by hash of the doc_id: at most `per_language` for each language.

    With more than max_texts / per_language languages each has its even share of `max_texts`, eight texts at least. Of a
    text longer than `max_chars` that many characters count, from a place drawn by the hash. Only rows with a non-null
    lang, a text that is not empty and a doc_id with crc32(doc_id as text) mod 4 other than 2 are taken.
    """
    own = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2) & (F.length("text") > 0))
    own = own.withColumn("h", F.xxhash64("doc_id"))
    counts = own.groupBy("lang").count().collect()
    if not counts:
        return [], []
    most = min(per_language, max(8, max_texts // len(counts)))
    # Half more than wanted in the mean, so that a full sample is near certain; the order is by hash.
    shares = [(r["lang"], min(1.0, (1.5 * most + 50) / r["count"])) for r in counts]
    share = docs.sparkSession.createDataFrame(shares, "lang string, share double")
    place = F.shiftrightunsigned("h", 11) / float(1 << 53)
    from_ = F.pmod("h", F.greatest(F.length("text") - max_chars + 1, F.lit(1))).cast("int") + 1
    part = F.when(F.length("text") > max_chars, F.substring("text", from_, F.lit(max_chars))).otherwise(F.col("text"))
    rows = own.join(F.broadcast(share), "lang").where(place <= F.col("share")).select("lang", place.alias("place"), "doc_id", part.alias("text")).collect()
    rows.sort(key=lambda r: (r["place"], r["doc_id"], r["text"]))
    taken: dict[str, int] = {}
    texts: list[tuple] = []
    for r in rows:
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= most:
            texts.append((r["text"], r["lang"]))
    return [t for t, _ in texts], [lang for _, lang in texts]


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """All columns of `docs` plus lang_pred, lang_score and lang_known, from the text alone.

    lang_known is the share of the text's n-grams that the landmarks hold. Null text, text without a letter, and a model
    without languages give `und` with 0 for both. Whole texts are scored; of equal scores the first language in order of
    code point wins; a column of the same name is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = ("lang_pred", "lang_score", "lang_known")
    rest = [c for c in docs.columns if c not in added]

    def run(batches):
        model = shared.value
        low = _letter_table()
        for b in (part for whole in batches for part in slices(whole)):
            texts = b.column(b.schema.get_field_index("text")).cast(pa.string()).to_pylist()
            pred, score, known = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
            some = [i for i, t in enumerate(texts) if t and model and low[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)].any()]
            for k in range(0, len(some), 64):
                part = some[k : k + 64]
                got, shares = model.scored([texts[i] for i in part])
                best = got.argmax(1)
                for i, j, row, share in zip(part, best, got, shares, strict=True):
                    pred[i] = model.languages[j]
                    score[i] = float(min(1.0, max(0.0, row[j])))
                    known[i] = float(share)
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index(c)) for c in rest] + [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(known, pa.float64())],
                names=[*rest, *added],
            )

    schema = docs.select(*(F.col(f"`{c}`") for c in rest)).schema.add("lang_pred", "string").add("lang_score", "double").add("lang_known", "double")
    return docs.select(*(F.col(f"`{c}`") for c in rest)).mapInArrow(run, schema)


def identify(docs: DataFrame, per_language: int = 200, **options) -> DataFrame:
    """Fit on the bounded sample of `docs` and predict all its rows; see `training_sample` and `predict`."""
    return predict(docs, fit(*training_sample(docs, per_language), **options))


def keep_identified(docs: DataFrame, per_language: int = 200, **options) -> DataFrame:
    """`docs` without the rows whose language cannot be told: `und`, or too few n-grams that any language has.

    The least share of known n-grams comes from the labelled texts (`fit`), which all have twice as many.
    """
    if "lang" not in docs.columns:
        raise ValueError("the model learns from a lang column")
    model = fit(*training_sample(docs, per_language), **options)
    told = predict(docs, model).where((F.col("lang_pred") != "und") & (F.col("lang_known") >= (model.least_known if model else 0.0)))
    return told.select(*(F.col(f"`{c}`") for c in docs.columns))
