"""Secret scanning: pattern candidates, and a small character convolutional network that scores each in its context.

Pattern findings always stay. The network reads every candidate, the pattern findings and other long tokens, whole and with
the characters before and after it, in overlapping windows of which the highest score counts; it is trained in numpy on labelled findings. Its outputs are calibrated (Platt), and the
threshold is the highest that keeps the wanted recall on findings held out of the training. Tokens above it are added.
"""

from __future__ import annotations

import hashlib
import re
import string
from bisect import bisect_left
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base kinds, their patterns and least lengths.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "learned")
_WORDS = ("passw", "secret", "token", "apikey", "api_key")

_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
BEFORE, INSIDE, AFTER = 24, 56, 16
_CHARS = string.ascii_letters + string.digits + string.punctuation + " \n\t"
_CODE = np.full(0x110000, len(_CHARS) + 1, np.int16)
_CODE[[ord(c) for c in _CHARS]] = np.arange(1, len(_CHARS) + 1)
_SIZE = len(_CHARS) + 2


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base findings by start, then kind; null text is empty."""
    if not text:
        return []
    out = []
    low = text.lower()
    # Characters outside ASCII may lower-case to ASCII letters; that only lets the pattern itself decide.
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str | None, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Further candidates: tokens of 20 or more characters with a letter and a digit that touch no base finding."""
    out = []
    starts = [s for s, _, _ in base]
    ends = list(accumulate((e for _, _, e in base), max))
    for m in _TOKEN.finditer(text or ""):
        before = bisect_left(starts, m.end())
        if before and ends[before - 1] > m.start():
            continue
        t = m[0]
        if any(c.isdigit() for c in t) and any(c.isalpha() for c in t):
            out.append((m.start(), m.end()))
    return out


def _view(text: str, start: int, end: int) -> np.ndarray:
    """Codes of the context before a candidate, of its first characters, and of the context after, padded with 0."""
    out = np.zeros(BEFORE + INSIDE + AFTER, np.int16)
    stop = min(end, start + INSIDE)
    before, inside = text[max(0, start - BEFORE) : start], text[start : stop + AFTER]
    for part, at in ((before, BEFORE - len(before)), (inside, BEFORE)):
        if part:
            out[at : at + len(part)] = _CODE[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)]
    return out


def _windows(start: int, end: int) -> list[int]:
    """Starts of the windows that cover a candidate; each but the first overlaps the one before by half."""
    if end - start <= INSIDE:
        return [start]
    return [*range(start, end - INSIDE, INSIDE // 2), end - INSIDE]


@dataclass
class Network:
    """Embedding, one convolution, ReLU, maximum over places, a logistic unit; then Platt's scale and shift."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float
    width: int
    scale: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5

    def _windows(self, codes: np.ndarray) -> np.ndarray:
        x = self.embed[codes]
        n = x.shape[1] - self.width + 1
        return np.concatenate([x[:, k : k + n] for k in range(self.width)], axis=2)

    def logits(self, codes: np.ndarray) -> np.ndarray:
        parts = []
        for i in range(0, len(codes), 256):
            a = self._windows(codes[i : i + 256]) @ self.kernel + self.bias
            parts.append(np.maximum(a.max(1), 0) @ self.out + self.shift)
        return np.concatenate(parts) if parts else np.zeros(0)

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(codes) + self.offset, -40, 40)))


def train(codes: np.ndarray, labels: np.ndarray, recall: float = 0.95, filters: int = 24, width: int = 5, dims: int = 12, epochs: int = 12, seed: int = 7) -> Network:
    """Train on four fifths of the findings (Adam), calibrate and set the threshold on the rest.

    The threshold is the highest probability at which `recall` of the held-out secrets is found.
    """
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(codes))
    cut = len(codes) * 4 // 5
    fit, rest = order[:cut], order[cut:]
    net = Network(
        rng.normal(0, 0.3, (_SIZE, dims)).astype(np.float32),
        rng.normal(0, (2 / (width * dims)) ** 0.5, (width * dims, filters)).astype(np.float32),
        np.zeros(filters, np.float32),
        rng.normal(0, 0.3, filters).astype(np.float32),
        0.0,
        width,
    )
    params = ["embed", "kernel", "bias", "out"]
    first = {p: np.zeros_like(getattr(net, p)) for p in params}
    second = {p: np.zeros_like(getattr(net, p)) for p in params}
    step, m_shift, v_shift = 0, 0.0, 0.0
    for _ in range(epochs):
        rng.shuffle(fit)
        for i in range(0, len(fit), 64):
            part = fit[i : i + 64]
            w = net._windows(codes[part])
            a = w @ net.kernel + net.bias
            top = a.argmax(1)
            best = np.take_along_axis(a, top[:, None, :], 1)[:, 0]
            hidden = np.maximum(best, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ net.out + net.shift, -40, 40)))
            d = ((p - labels[part]) / len(part)).astype(np.float32)
            dh = d[:, None] * net.out * (best > 0)
            rows = np.arange(len(part))[:, None]
            picked = w[rows, top]
            grad = {"out": hidden.T @ d, "bias": dh.sum(0), "kernel": np.einsum("bfw,bf->wf", picked, dh)}
            dx = np.einsum("bf,wf->bfw", dh, net.kernel).reshape(len(part), filters, width, dims)
            grad["embed"] = np.zeros_like(net.embed)
            for k in range(width):
                np.add.at(grad["embed"], codes[part][rows, top + k], dx[:, :, k])
            step += 1
            for name in params:
                g = grad[name]
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                move = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                setattr(net, name, (getattr(net, name) - 0.004 * move).astype(np.float32))
            g = float(d.sum())
            m_shift, v_shift = 0.9 * m_shift + 0.1 * g, 0.999 * v_shift + 0.001 * g * g
            net.shift -= 0.004 * m_shift / (1 - 0.9**step) / ((v_shift / (1 - 0.999**step)) ** 0.5 + 1e-8)
    z, y = net.logits(codes[rest]), labels[rest]
    for _ in range(200):  # Platt: logistic regression of the labels on the logits, with smoothed targets
        p = 1 / (1 + np.exp(-np.clip(net.scale * z + net.offset, -40, 40)))
        t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        net.scale -= 0.5 * float(((p - t) * z).mean()) / max(1.0, float((z * z).mean()))
        net.offset -= 0.5 * float((p - t).mean())
    found = np.sort(net.probability(codes[rest][y > 0]))
    net.threshold = float(found[int((1 - recall) * len(found))]) if len(found) else 1.0
    return net


def labelled_findings(n: int = 3000, seed: int = 11) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """Labelled findings made from a fixed seed: (text, start, end) and 1 for a secret, 0 for none.

    Secrets are random keys of usual alphabets and lengths, with or without a name before them. Others are long words,
    identifiers, paths, version strings, numbers and repeated patterns with digits.
    """
    rng = np.random.default_rng(seed)
    alphabets = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", "0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "_-"]
    syllables = ["ba", "con", "der", "en", "ing", "lo", "ment", "ra", "ti", "tion", "un", "ver", "wh", "ou", "sch"]
    names = ["key = ", "auth: ", "credential=", "Bearer ", "token: ", "secret_key=\"", "AWS_SECRET ", "", "", ""]
    plain = ["see ", "file ", "http://", "in the ", "id ", "page ", "", "release ", "path: ", "class "]

    def word() -> str:
        return "".join(rng.choice(syllables, rng.integers(2, 5)))

    texts, labels = [], []
    for i in range(n):
        lead = " ".join(word() for _ in range(rng.integers(1, 5))) + " "
        if i % 2:
            chars = list(alphabets[rng.integers(len(alphabets))])
            body = "".join(rng.choice(chars, rng.integers(20, 65)))
            lead += names[rng.integers(len(names))]
        else:
            shape = rng.integers(5)
            if shape == 0:
                body = "_".join(word() for _ in range(rng.integers(3, 7))) + str(rng.integers(100))
            elif shape == 1:
                body = "/".join(word() for _ in range(rng.integers(3, 6))) + "/" + str(rng.integers(10_000))
            elif shape == 2:
                body = "-".join(str(rng.integers(10, 9999)) for _ in range(rng.integers(5, 9))) + "x"
            elif shape == 3:
                body = "".join(word().title() for _ in range(rng.integers(4, 8))) + str(rng.integers(1000))
            else:
                body = (word() + str(rng.integers(10))) * int(rng.integers(4, 9))
            body = (body + "_" + word() + word() + "_2")[: rng.integers(24, 80)].ljust(20, "0")
            lead += plain[rng.integers(len(plain))]
        texts.append((lead + body + " " + word(), len(lead), len(lead) + len(body)))
        labels.append(i % 2)
    return texts, np.array(labels, np.float32)


@lru_cache(maxsize=4)
def trained(recall: float = 0.95, findings: int = 3000) -> Network:
    texts, labels = labelled_findings(findings)
    return train(np.stack([_view(*t) for t in texts]), labels, recall)


_SCHEMA = "doc_id long, findings array<struct<start:int,kind:string,stop:int,score:double>>, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scores(net: Network, spans: Iterable[tuple[str, int, int]]) -> list[float]:
    """Per (text, start, end) the highest probability of its windows, in bounded blocks."""
    views, owners, best = [], [], []

    def flush():
        for i, q in zip(owners, net.probability(np.stack(views)).tolist(), strict=True):
            best[i] = max(best[i], q)
        views.clear()
        owners.clear()

    for i, (text, start, end) in enumerate(spans):
        best.append(0.0)
        for at in _windows(start, end):
            views.append(_view(text, at, end))
            owners.append(i)
            if len(views) == 4096:
                flush()
    if views:
        flush()
    return best


def scan(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """Per row: doc_id, findings with scores, base counts, the digest of the base spans, and all spans as text.

    Offsets count code points, ends are exclusive. Null and empty texts have no findings. Every row is scanned on its
    own, so repeated rows and null ids give rows alike; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network or trained())

    def run(batches):
        net = shared.value
        for b in batches:
            base, more, text = [], [], b.column(1).to_pylist()
            for t in text:
                base.append(base_spans(t))
                more.append(candidates(t, base[-1]))
            spans = ((t, s, e) for t, own, extra in zip(text, base, more, strict=True) for s, e in [*((s, e) for s, _, e in own), *extra])
            p = _scores(net, spans)
            out, at = [], 0
            for d, own, extra in zip(b.column(0).to_pylist(), base, more, strict=True):
                scored = [(x, p[at + i]) for i, x in enumerate(own)]
                at += len(own)
                scored += [((s, 3, e), p[at + i]) for i, (s, e) in enumerate(extra) if p[at + i] >= net.threshold]
                at += len(extra)
                scored.sort()
                kinds = [k for _, k, _ in own]
                out.append(
                    {
                        "doc_id": d,
                        "findings": [{"start": s, "kind": KINDS[k], "stop": e, "score": q} for (s, k, e), q in scored],
                        "n_assign": kinds.count(0),
                        "n_access": kinds.count(1),
                        "n_hex": kinds.count(2),
                        "base_sha256": hashlib.sha256(_text(own).encode()).hexdigest(),
                        "spans": _text([x for x, _ in scored]),
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)


_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("findings", pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("stop", pa.int32()), ("score", pa.float64())]))),
        ("n_assign", pa.int64()),
        ("n_access", pa.int64()),
        ("n_hex", pa.int64()),
        ("base_sha256", pa.string()),
        ("spans", pa.string()),
    ]
)
