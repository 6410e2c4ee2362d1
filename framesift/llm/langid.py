"""Language identification by a bidirectional gated recurrent network over bytes.

Two recurrent layers of gated units read a text's UTF-8 bytes forwards and backwards; every byte
position gets a distribution over the languages from both states, and the mean log-probability over
the positions, pooled over the whole text, decides.  Texts are cut into overlapping windows so that
many of them run side by side in one array; a window's margins only warm the states up, and each
byte is labelled once.  The network is trained in numpy by backpropagation through time on a
bounded sample of windows; it is some thousand numbers, which every task gets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import bounded
from framesift.session import cut_lineage

UNDETERMINED = "und"
#: Hidden units per direction, bytes labelled per window, bytes of margin on either side.
UNITS, WINDOW, MARGIN = 8, 240, 8
#: Documents in the training sample, windows taken from each, bytes per training window.
TRAIN_DOCS, TRAIN_WINDOWS, TRAIN_BYTES = 3000, 2, 48
EPOCHS, BATCH, RATE, SEED = 12, 128, 0.02, 7
#: Windows that run side by side.
LANES = 2048


@dataclass
class Network:
    """Languages and weights; per direction the input table (256, 3u), recurrent (u, 3u) and output (u, k) weights."""

    langs: list[str]
    weights: dict[str, np.ndarray]
    prior: np.ndarray


def _squash(x: np.ndarray, room: np.ndarray) -> np.ndarray:
    """x / (1 + |x|) in place: a squashing function several times cheaper than tanh; its slope is (1 - |y|) squared."""
    np.abs(x, out=room)
    room += 1
    return np.divide(x, room, out=x)


def _states(codes: np.ndarray, table: np.ndarray, rec: np.ndarray, backwards: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(position, state (u, lanes)) along ``codes`` (positions, lanes), for inference.

    Arrays are units-first, so that every elementwise step runs along the lanes; buffers are reused.
    A gate is (1 + squash) / 2, and the half of the reset gate is folded into the weights.
    """
    u, lanes = rec.shape[0], codes.shape[1]
    gates, cand = np.ascontiguousarray(rec[:, : 2 * u].T), np.ascontiguousarray(rec[:, 2 * u:].T) * np.float32(0.5)
    tab = np.ascontiguousarray(table.T)
    x, g, room = np.empty((3 * u, lanes), np.float32), np.empty((2 * u, lanes), np.float32), np.empty((2 * u, lanes), np.float32)
    h, n, r = np.zeros((u, lanes), np.float32), np.empty((u, lanes), np.float32), np.empty((u, lanes), np.float32)
    for t in range(len(codes) - 1, -1, -1) if backwards else range(len(codes)):
        np.take(tab, codes[t], axis=1, out=x, mode="clip")
        np.matmul(gates, h, out=g)
        g += x[: 2 * u]
        _squash(g, room)
        np.multiply(g[u:], h, out=r)
        r += h
        np.matmul(cand, r, out=n)
        n += x[2 * u:]
        _squash(n, room[:u])
        h -= n
        h *= 0.5
        np.multiply(g[:u], h, out=r)
        h += r
        h += n
        yield t, h


def window_scores(net: Network, codes: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Sum over each window's own positions of the log-probabilities: (languages, lanes)."""
    w, k = net.weights, len(net.langs)
    codes = codes.astype(np.intp)
    use = valid.any(axis=1)
    ahead = np.empty((len(codes), k, codes.shape[1]), np.float32)
    fo, bo, bias = np.ascontiguousarray(w["fo"].T), np.ascontiguousarray(w["bo"].T), w["b"][:, None]
    for t, h in _states(codes, w["fx"], w["fh"], False):
        if use[t]:
            np.matmul(fo, h, out=ahead[t])
    total, e = np.zeros((k, codes.shape[1]), np.float32), np.empty((k, codes.shape[1]), np.float32)
    for t, h in _states(codes, w["bx"], w["bh"], True):
        if use[t]:
            z = ahead[t]
            z += bo @ h
            z += bias
            z -= z.max(axis=0)
            np.exp(z, out=e)
            z -= np.log(e.sum(axis=0))
            z *= valid[t]
            total += z
    return total


def _windows(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(lanes, positions) of a text's windows: byte codes padded with spaces, and which positions count."""
    n = max(1, -(-len(raw) // WINDOW))
    padded = np.full(n * WINDOW + 2 * MARGIN, 32, np.uint8)
    padded[MARGIN: MARGIN + len(raw)] = np.frombuffer(raw, np.uint8)
    view = np.lib.stride_tricks.sliding_window_view(padded, WINDOW + 2 * MARGIN)[::WINDOW]
    inside = np.zeros(n * WINDOW, bool)
    inside[: len(raw)] = True
    return view, inside.reshape(n, WINDOW)


def log_probabilities(net: Network, raws: list[bytes]) -> np.ndarray:
    """Mean log-probability per byte of each language for each text, over all its bytes: (texts, languages)."""
    out = np.zeros((len(raws), len(net.langs)))
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def flush(final: bool) -> None:
        """Run full arrays of lanes; what is over waits for the next texts unless these were the last."""
        every, inside, owner = (np.concatenate(x) for x in zip(*held))
        held.clear()
        stop = len(every) if final else len(every) // LANES * LANES
        for i in range(0, stop, LANES):
            own = owner[i: i + LANES]
            codes = np.ascontiguousarray(every[i: i + LANES].T)
            valid = np.zeros(codes.shape, np.float32)
            valid[MARGIN: MARGIN + WINDOW] = inside[i: i + LANES].T
            scores = window_scores(net, codes, valid)
            for k in range(len(out[0])):
                out[:, k] += np.bincount(own, scores[k], len(out))
        if stop < len(every):
            held.append((every[stop:], inside[stop:], owner[stop:]))

    waiting = 0
    for k, raw in enumerate(raws):
        view, inside = _windows(raw)
        held.append((view, inside, np.full(len(view), k)))
        waiting += len(view)
        if waiting >= 4 * LANES:
            flush(False)
            waiting = sum(len(x[0]) for x in held)
    if held:
        flush(True)
    return out / np.maximum(1, [len(r) for r in raws])[:, None]


def _forward(codes: np.ndarray, table: np.ndarray, rec: np.ndarray) -> dict:
    """Forward pass that keeps what the backward pass needs; lanes-first arrays (positions, lanes, …)."""
    u = rec.shape[0]
    steps, lanes = codes.shape
    h = np.zeros((steps + 1, lanes, u))
    zr, n = np.empty((steps, lanes, 2 * u)), np.empty((steps, lanes, u))
    x = table[codes]
    for t in range(steps):
        a = x[t, :, : 2 * u] + h[t] @ rec[:, : 2 * u]
        zr[t] = 0.5 + 0.5 * a / (1 + np.abs(a))
        c = x[t, :, 2 * u:] + (zr[t, :, u:] * h[t]) @ rec[:, 2 * u:]
        n[t] = c / (1 + np.abs(c))
        h[t + 1] = n[t] + zr[t, :, :u] * (h[t] - n[t])
    return {"h": h, "zr": zr, "n": n}


def _backward(codes: np.ndarray, table: np.ndarray, rec: np.ndarray, kept: dict, into: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input table and the recurrent weights, from the gradient ``into`` of every state."""
    u = rec.shape[0]
    h, zr, n = kept["h"], kept["zr"], kept["n"]
    d_rec, d_x = np.zeros_like(rec), np.empty((*codes.shape, 3 * u))
    carry = np.zeros_like(h[0])
    for t in range(len(codes) - 1, -1, -1):
        d = into[t] + carry
        z, r = zr[t, :, :u], zr[t, :, u:]
        d_n = d * (1 - z) * (1 - np.abs(n[t])) ** 2
        d_rh = d_n @ rec[:, 2 * u:].T
        d_z = d * (h[t] - n[t]) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
        d_r = d_rh * h[t] * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
        d_zr = np.concatenate([d_z, d_r], axis=1)
        d_rec[:, 2 * u:] += (r * h[t]).T @ d_n
        d_rec[:, : 2 * u] += h[t].T @ d_zr
        carry = d * z + d_rh * r + d_zr @ rec[:, : 2 * u].T
        d_x[t] = np.concatenate([d_zr, d_n], axis=1)
    flat, bytes_ = d_x.reshape(-1, 3 * u), codes.ravel()
    return np.stack([np.bincount(bytes_, flat[:, i], 256) for i in range(3 * u)], axis=1), d_rec


def loss_and_gradient(w: dict[str, np.ndarray], codes: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all positions (positions, lanes) with one target per lane, and its gradient."""
    back = codes[::-1]
    f, b = _forward(codes, w["fx"], w["fh"]), _forward(back, w["bx"], w["bh"])
    hf, hb = f["h"][1:], b["h"][1:][::-1]
    z = hf @ w["fo"] + hb @ w["bo"] + w["b"]
    z -= z.max(axis=2, keepdims=True)
    p = np.exp(z)
    p /= p.sum(axis=2, keepdims=True)
    lanes = np.arange(codes.shape[1])
    loss = -np.log(np.maximum(p[:, lanes, target], 1e-12)).mean()
    p[:, lanes, target] -= 1
    p /= codes.size
    flat = p.reshape(-1, p.shape[2])
    grad = {"fo": hf.reshape(len(flat), -1).T @ flat, "bo": hb.reshape(len(flat), -1).T @ flat, "b": flat.sum(axis=0)}
    grad["fx"], grad["fh"] = _backward(codes, w["fx"], w["fh"], f, p @ w["fo"].T)
    grad["bx"], grad["bh"] = _backward(back, w["bx"], w["bh"], b, (p @ w["bo"].T)[::-1])
    return float(loss), grad


def initial(languages: int, units: int = UNITS, seed: int = SEED) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = {}
    for d in "fb":
        w[f"{d}x"] = rng.normal(0, 0.5, (256, 3 * units))
        w[f"{d}h"] = rng.normal(0, 1 / np.sqrt(units), (units, 3 * units))
        w[f"{d}o"] = rng.normal(0, 0.5, (units, languages))
    return w | {"b": np.zeros(languages)}


def train(raws: list[bytes], langs: list[str], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Network from a bounded list of labelled texts; Adam on random windows, languages drawn evenly."""
    names = sorted(set(langs))
    if not names:
        return Network([], {}, np.zeros(0))
    at = {n: i for i, n in enumerate(names)}
    counts = np.bincount([at[x] for x in langs], minlength=len(names))
    prior = counts / counts.sum()
    w = initial(len(names), seed=seed)
    if len(names) == 1:
        return Network(names, {k: v.astype(np.float32) for k, v in w.items()}, prior)
    rng = np.random.default_rng(seed)
    long = [i for i, r in enumerate(raws) if r.strip()]
    rows, target = [], []
    for i in long:
        for _ in range(TRAIN_WINDOWS):
            start = int(rng.integers(0, max(1, len(raws[i]) - TRAIN_BYTES)))
            rows.append(np.frombuffer(raws[i][start: start + TRAIN_BYTES].ljust(TRAIN_BYTES), np.uint8))
            target.append(at[langs[i]])
    codes, target = np.array(rows).reshape(-1, TRAIN_BYTES), np.array(target, int)
    share = 1 / np.maximum(1, np.bincount(target, minlength=len(names)))[target]
    m, v, step = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    rounds = epochs * -(-len(codes) // BATCH)
    for k in range(rounds):
        pick = rng.choice(len(codes), BATCH, p=share / share.sum()) if len(codes) else []
        if not len(pick):
            break
        _, g = loss_and_gradient(w, codes[pick].T, target[pick])
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        step += 1
        rate = RATE * (1 - k / rounds)
        for name, x in g.items():
            x = x * min(1.0, 1.0 / max(norm, 1e-12))
            m[name] = 0.9 * m[name] + 0.1 * x
            v[name] = 0.999 * v[name] + 0.001 * x * x
            w[name] -= rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
    return Network(names, {k: x.astype(np.float32) for k, x in w.items()}, prior)


def fit(labelled: DataFrame, most: int = TRAIN_DOCS) -> Network:
    """Network from rows (doc_id, text, lang); at most ``most`` of them, the first by a hash of text and id.

    A window is all that training reads of a text, so only a bounded piece of it goes to the driver.
    """
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    start = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - 4 * TRAIN_BYTES, F.lit(1))).cast("int") + 1
    pieces = known.select(F.substring("text", start, F.lit(4 * TRAIN_BYTES)).cast("binary").alias("t"), F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("o"))
    total = labelled.where(F.col("lang").isNotNull()).count()
    # Written before it is collected: the driver then gets the rows themselves, not every task's candidates.
    rows = cut_lineage(bounded(pieces, F.col("o"), most, total), "sample").collect()
    rows = sorted(rows, key=lambda r: (r.o, bytes(r.t)))
    return train([bytes(r.t) for r in rows], [r.lang for r in rows])


#: Positions are far from independent; the pooled mean counts as so many independent ones.
POOL = 8.0


def classify(net: Network, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(language, probability) of whole UTF-8 texts; ``und`` and 0 without a letter, or when nothing was learned."""
    pred, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
    use = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t.decode("utf-8", "replace")))] if net.langs else []
    if use:
        logs = log_probabilities(net, [bytes(texts[i]) for i in use])
        p = np.exp((logs - logs.max(axis=1, keepdims=True)) * POOL)
        p /= p.sum(axis=1, keepdims=True)
        pred[use] = np.array(net.langs, object)[p.argmax(axis=1)]
        score[use] = p.max(axis=1)
    return pred, score


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, lang_pred, score) for every row.

    ``score`` is the probability of the language from the pooled log-probabilities.  A text that is
    null or holds no letter is ``und`` with score 0; so is every text when nothing was learned.
    Repeated rows come back as often as they are there, a null doc_id stays null, and columns other
    than doc_id and text are not read.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pred, score = classify(net, b["text"].tolist())
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang_pred": pred, "score": score})

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInPandas(rows, f"doc_id {kind}, lang_pred string, score double")


def language(text: Column, net: Network) -> Column:
    """Predicted language of a text as a column; only the text goes through Python."""

    @F.pandas_udf("string")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(classify(net, texts.tolist())[0])

    return label(text.cast("binary"))
