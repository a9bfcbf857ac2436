"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads the whole text from both ends of each window and labels every byte; it is trained in numpy by
backpropagation through time. Windows overlap: a position is pooled from the one window in which it has CONTEXT bytes of
the text on either side, or the text's end, so state runs across words and spaces. A document's probabilities are the
normalised geometric mean of those at all its letters (and all bytes of longer characters), over the whole text.

Defined results: null text, or text without a letter, is `und` with score 0; documents with null lang, or in the
held-out fifth, are not learned from; without any training row every result is `und`; repeated rows give repeated
results; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import arrow_map, by_pieces, held_out, utf8

#: Rows of each language that training sees, those with the smallest hash of the identifier.
DOCS_PER_LANG = 120
#: Windows of each language, drawn from these rows, and their bytes.
WINDOWS_PER_LANG, TRAIN_BYTES = 12_000, 48
HIDDEN, STEPS, BATCH, RATE, SEED = 12, 300, 256, 0.02, 7
#: Bytes of a window that are pooled, and those read on either side of them for context alone.
WINDOW, CONTEXT = 224, 16
#: Windows that go through the network at once, fewer with more than LANGS languages.
ROWS, LANGS = 1024, 16

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Direction:
    """One direction of the network: inputs as rows of a table, one for each byte, and 256 for padding."""

    NAMES = ("inputs", "recur", "bias")

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.h = hidden
        self.inputs = (rng.standard_normal((257, 3 * hidden)) * 0.3).astype(np.float32)
        self.recur = (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.bias = np.zeros(3 * hidden, np.float32)

    def forward(self, x: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, list]:
        """x: steps by rows of bytes; live: 1 where there is one. Returns the state after each step and what backward needs."""
        h, n = self.h, x.shape[1]
        state, states, kept = np.zeros((n, h), np.float32), [], []
        for t in range(len(x)):
            a = self.inputs[x[t]] + self.bias
            u = state @ self.recur
            gates = _sigmoid(a[:, : 2 * h] + u[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            c = np.tanh(a[:, 2 * h :] + r * u[:, 2 * h :])
            m = live[t][:, None]
            new = m * ((1 - z) * c + z * state) + (1 - m) * state
            kept.append((state, z, r, c, u[:, 2 * h :], m))
            states.append(new)
            state = new
        return np.stack(states), kept

    def read(self, x: np.ndarray, live: np.ndarray, out: np.ndarray) -> None:
        """The states of forward() into out, steps by units by rows, without what backward needs."""
        h, n = self.h, x.shape[1]
        # sigmoid(v) = tanh(v / 2) / 2 + 1 / 2, with the inner half in the weights. Units come first: slices are whole blocks.
        half = np.repeat(np.array([0.5, 0.5, 1], np.float32), h)
        inputs = np.ascontiguousarray(((self.inputs + self.bias) * half).T)
        recur = np.ascontiguousarray((self.recur * half).T)
        state, a, u = np.zeros((h, n), np.float32), np.empty((3 * h, n), np.float32), np.empty((3 * h, n), np.float32)
        gates, z, r, c = a[: 2 * h], a[:h], a[h : 2 * h], a[2 * h :]
        full = live.all(1)
        for t in range(len(x)):
            np.take(inputs, x[t], axis=1, out=a, mode="clip")
            np.matmul(recur, state, out=u)
            gates += u[: 2 * h]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            r *= u[2 * h :]
            c += r
            np.tanh(c, out=c)
            new = out[t]
            np.subtract(state, c, out=new)
            new *= z
            new += c
            if not full[t]:
                np.copyto(new, state, where=live[t] == 0)
            state = new

    def backward(self, x: np.ndarray, kept: list, grads: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the parameters, given those of the states after each step."""
        h = self.h
        out = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        carry = np.zeros_like(kept[0][0])
        for t in range(len(x) - 1, -1, -1):
            state, z, r, c, uc, m = kept[t]
            d = grads[t] + carry
            carry, d = d * (1 - m), d * m
            dc = d * (1 - z) * (1 - c * c)
            dz = d * (state - c) * z * (1 - z)
            dr = dc * uc * r * (1 - r)
            da = np.concatenate((dz, dr, dc), 1)
            du = np.concatenate((dz, dr, dc * r), 1)
            carry += d * z + du @ self.recur.T
            out["recur"] += state.T @ du
            out["bias"] += da.sum(0)
            np.add.at(out["inputs"], x[t], da)
        return out


@dataclass
class Network:
    langs: list[str]
    ahead: Direction = field(repr=False)
    back: Direction = field(repr=False)
    out: np.ndarray = field(repr=False)
    out_bias: np.ndarray = field(repr=False)

    @classmethod
    def new(cls, langs: list[str], hidden: int = HIDDEN, seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        return cls(langs, Direction(rng, hidden), Direction(rng, hidden), (rng.standard_normal((2 * hidden, len(langs))) * 0.1).astype(np.float32), np.zeros(len(langs), np.float32))

    def run(self, x: np.ndarray, live: np.ndarray):
        """Log-probabilities of each language at each position, steps by rows by languages, and what training needs."""
        fs, fk = self.ahead.forward(x, live)
        bs, bk = self.back.forward(x[::-1], live[::-1])
        both = np.concatenate((fs, bs[::-1]), 2)
        logits = both @ self.out + self.out_bias
        logits -= logits.max(2, keepdims=True)
        return logits - np.log(np.exp(logits).sum(2, keepdims=True)), (fk, bk, both)

    def sums(self, x: np.ndarray, live: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Rows by languages: log-probabilities summed over the positions of each row, each times its weight."""
        h, (steps, n) = self.ahead.h, x.shape
        both = np.empty((2, steps, h, n), np.float32)
        self.ahead.read(x, live, both[0])
        self.back.read(x[::-1], live[::-1], both[1, ::-1])
        logits = np.matmul(self.out[:h].T, both[0])
        logits += np.matmul(self.out[h:].T, both[1])
        logits += self.out_bias[:, None]
        logits -= logits.max(1, keepdims=True)
        logits -= np.log(np.exp(logits).sum(1, keepdims=True))
        logits *= weight[:, None, :]
        return logits.sum(0, dtype=np.float64).T

    def gradients(self, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[np.ndarray, np.ndarray]]]:
        """Mean loss over all positions, and each parameter with its gradient."""
        logs, (fk, bk, both) = self.run(x, live)
        total = live.sum()
        loss = -float((logs[:, np.arange(len(y)), y] * live).sum() / total)
        d = np.exp(logs)
        d[:, np.arange(len(y)), y] -= 1
        d *= (live / total)[:, :, None]
        h = self.ahead.h
        ds = d @ self.out.T
        fg = self.ahead.backward(x, fk, ds[:, :, :h])
        bg = self.back.backward(x[::-1], bk, ds[::-1, :, h:])
        pairs = [(self.out, np.tensordot(both, d, ((0, 1), (0, 1)))), (self.out_bias, d.sum((0, 1)))]
        pairs += [(getattr(self.ahead, k), fg[k]) for k in Direction.NAMES] + [(getattr(self.back, k), bg[k]) for k in Direction.NAMES]
        return loss, pairs


def padded(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Steps by rows of bytes, and 1 where a byte is."""
    sizes = np.array([len(s) for s in segments])
    steps = int(sizes.max())
    x = np.full((len(segments), steps), 256, np.int64)
    live = np.arange(steps) < sizes[:, None]
    x[live] = np.frombuffer(b"".join(segments), np.uint8)
    return x.T.copy(), live.T.astype(np.float32)


def train(texts: list[bytes], langs: list[str], steps: int = STEPS, windows_per_lang: int = WINDOWS_PER_LANG, seed: int = SEED) -> Network | None:
    """Fit a network by Adam on windows drawn from texts with a letter, as many of each language."""
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    pools = []
    for name in names:
        own = [t.lower() for t, lang in zip(texts, langs, strict=True) if lang == name and _LETTER[np.frombuffer(t, np.uint8)].any()]
        pool = []
        for k in rng.integers(0, len(own), windows_per_lang) if own else ():
            at = int(rng.integers(0, max(1, len(own[k]) - TRAIN_BYTES + 1)))
            pool.append(own[k][at : at + TRAIN_BYTES])
        pools.append(pool)
    examples = [(w, k) for k, pool in enumerate(pools) for w in pool if w]
    net = Network.new(names, seed=seed)
    if not examples:
        return net
    moments: list | None = None
    for step in range(1, steps + 1):
        chosen = [examples[i] for i in rng.integers(0, len(examples), BATCH)]
        x, live = padded([w for w, _ in chosen])
        _, pairs = net.gradients(x, live, np.array([k for _, k in chosen]))
        moments = moments or [(np.zeros_like(p), np.zeros_like(p)) for p, _ in pairs]
        rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
        for (p, g), (m, v) in zip(pairs, moments, strict=True):
            g = np.clip(g, -1, 1)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first pooled position and end of the pooled positions of each window over texts of such sizes."""
    counts = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), counts)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)) * WINDOW
    return text, start, np.minimum(start + WINDOW, sizes[text])


def pooled(net: Network, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Mean log-probabilities over all letters of each text, and how many there are."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(t.lower() for t in texts), np.uint8)
    is_letter = _LETTER[data]
    letters = np.concatenate(([0], np.cumsum(is_letter)))
    base = np.cumsum(sizes) - sizes
    text, start, end = windows(sizes)
    left, right = np.maximum(start - CONTEXT, 0), np.minimum(end + CONTEXT, sizes[text])
    use = letters[base[text] + end] > letters[base[text] + start]
    order = np.flatnonzero(use)[np.argsort((right - left)[use], kind="stable")]
    total = np.zeros((len(texts), len(net.langs)))
    rows = max(1, ROWS * LANGS // max(LANGS, len(net.langs)))
    for at in range(0, len(order), rows):
        part = order[at : at + rows]
        step = np.arange((right - left)[part].max())[:, None]
        live = step < (right - left)[part]
        place = np.minimum((base[text] + left)[part] + step, len(data) - 1)
        weight = is_letter[place] & (step >= (start - left)[part]) & (step < (end - left)[part])
        np.add.at(total, text[part], net.sums(np.where(live, data[place], 256), live, weight.astype(np.float32)))
    positions = letters[base + sizes] - letters[base]
    return total / np.maximum(positions, 1)[:, None], positions


def training_rows(documents: DataFrame, per_lang: int = DOCS_PER_LANG) -> tuple[list[bytes], list[str]]:
    """At most per_lang texts of each language, chosen by a hash of the identifier."""
    light = documents.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "lang")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = light.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_lang).drop("n")
    rows = documents.join(F.broadcast(chosen.dropDuplicates(["doc_id", "lang"])), ["doc_id", "lang"], "left_semi").select("doc_id", "text", "lang")
    # Repeated identifiers can bring more rows than were chosen.
    rows = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_lang).orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "lang").collect()
    return [(r["text"] or "").encode() for r in rows], [r["lang"] for r in rows]


def identify(documents: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each document."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "held_out", "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_pieces(batches, "text"):
            texts = utf8(batch.column(2))
            found = np.array([_has_letter(t) for t in texts], bool)
            if net is None or not found.any():
                lang, score = ["und"] * len(texts), np.zeros(len(texts))
            else:
                logs, positions = pooled(net, texts)
                p = np.exp(logs - logs.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                found &= positions > 0
                lang = [net.langs[k] if ok else "und" for k, ok in zip(p.argmax(1), found, strict=True)]
                score = np.where(found, p.max(1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score)], names=names)

    return arrow_map(documents.select("doc_id", held_out().alias("held_out"), "text"), run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def _has_letter(text: bytes) -> bool:
    data = np.frombuffer(text, np.uint8)
    return bool(_LETTER[data & 0x7F][data < 128].any()) or (not text.isascii() and any(c.isalpha() for c in text.decode()))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(documents, train(*training_rows(documents)))
