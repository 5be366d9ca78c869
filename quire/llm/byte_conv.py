"""A convolutional network over bytes, in numpy.

A text's UTF-8 is cut into chunks of CHUNK bytes that share OVERLAP bytes with the next, so
that every WIDTH bytes lie within one. Bytes become vectors; FILTERS learned filters look at
WIDTH of them at every second place; their maxima over a chunk pass a hidden layer; its
maxima and means over all chunks of the text, whatever their number, give one probability.
All layers are learned together by Adam.
"""

from __future__ import annotations

import numpy as np

CHUNK, OVERLAP = 512, 32
WIDTH, STRIDE = 8, 2
DEPTH, FILTERS, HIDDEN = 8, 32, 16
#: Chunks that go through the filters together, so that a text of any length takes the same memory.
TOGETHER = 256
#: Steps of learning, each on BATCH texts; a small sample is gone through more often.
STEPS, BATCH, RATE, SEED = 560, 32, 8e-3, 20

_PLACES = (CHUNK - WIDTH) // STRIDE + 1


def chunk_starts(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all texts' chunks within the bytes, and whose they are; an empty text has one."""
    step = CHUNK - OVERLAP
    n = np.maximum(1, -(-(np.diff(offsets) - OVERLAP) // step))
    whose = np.repeat(np.arange(len(n)), n)
    return offsets[:-1][whose] + (np.arange(len(whose)) - np.repeat(np.cumsum(n) - n, n)) * step, whose


def chunk_bytes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The chunks, filled up with zeros behind the ends of their texts."""
    at = starts[:, None] + np.arange(CHUNK)
    if not len(data):
        return np.zeros(at.shape, np.uint8)
    return np.where(at < stops[:, None], data[np.minimum(at, len(data) - 1)], np.uint8(0))


def fresh() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)

    def normal(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    return {"byte": normal(256, DEPTH, scale=0.5), "filter": normal(WIDTH * DEPTH, FILTERS, scale=(WIDTH * DEPTH) ** -0.5), "filter0": np.zeros(FILTERS, np.float32),
            "hidden": normal(FILTERS, HIDDEN, scale=FILTERS ** -0.5), "hidden0": np.zeros(HIDDEN, np.float32), "out": normal(2 * HIDDEN, scale=0.1), "out0": np.zeros(1, np.float32)}


def _windows(chunks: np.ndarray, model) -> np.ndarray:
    """[chunk, place, what a filter sees], without a copy."""
    x = np.take(model["byte"], chunks, axis=0).reshape(len(chunks), CHUNK * DEPTH)
    return np.lib.stride_tricks.sliding_window_view(x, WIDTH * DEPTH, axis=1)[:, ::STRIDE * DEPTH]


def _filtered(seen: np.ndarray, model) -> np.ndarray:
    flat = np.ascontiguousarray(seen).reshape(-1, WIDTH * DEPTH)
    return (flat @ model["filter"]).reshape(len(seen), _PLACES, FILTERS)


def chunk_features(chunks: np.ndarray, model) -> np.ndarray:
    pooled = np.maximum(_filtered(_windows(chunks, model), model).max(axis=1) + model["filter0"], 0)
    return np.maximum(pooled @ model["hidden"] + model["hidden0"], 0)


def scores(data: np.ndarray, offsets: np.ndarray, model) -> np.ndarray:
    """The probability of every text."""
    starts, whose = chunk_starts(offsets)
    n = len(offsets) - 1
    most, total = np.zeros((n, HIDDEN), model["hidden"].dtype), np.zeros((n, HIDDEN), np.float64)
    for i in range(0, len(starts), TOGETHER):
        part, own = starts[i:i + TOGETHER], whose[i:i + TOGETHER]
        found = chunk_features(chunk_bytes(data, part, offsets[1:][own]), model)
        np.maximum.at(most, own, found)
        np.add.at(total, own, found)
    total /= np.bincount(whose, minlength=n)[:, None]
    logit = np.concatenate([most, total], axis=1) @ model["out"].astype(np.float64) + float(model["out0"][0])
    return 1 / (1 + np.exp(-logit))


def _gradients(chunks, whose, labels, weights, model):
    """Of the weighted log loss of texts whose chunks are given."""
    seen = _windows(chunks, model)
    value = _filtered(seen, model)
    where = value.argmax(axis=1)
    pooled = np.take_along_axis(value, where[:, None], axis=1)[:, 0] + model["filter0"]
    up = np.maximum(pooled, 0)
    inner = up @ model["hidden"] + model["hidden0"]
    found = np.maximum(inner, 0)
    n = len(labels)
    kind = model["hidden"].dtype
    most, total = np.zeros((n, HIDDEN), kind), np.zeros((n, HIDDEN), kind)
    np.maximum.at(most, whose, found)
    np.add.at(total, whose, found)
    share = (1 / np.bincount(whose, minlength=n)).astype(kind)
    total *= share[:, None]
    logit = np.concatenate([most, total], axis=1) @ model["out"] + model["out0"]
    error = ((1 / (1 + np.exp(-logit)) - labels) * weights).astype(kind)
    grad = {"out": np.concatenate([most, total], axis=1).T @ error, "out0": np.array([error.sum()], kind)}
    d_found = error[whose, None] * (model["out"][HIDDEN:] * share[whose, None] + model["out"][:HIDDEN] * (found == most[whose]))
    d_inner = d_found * (inner > 0)
    grad["hidden"], grad["hidden0"] = up.T @ d_inner, d_inner.sum(axis=0)
    d_pooled = (d_inner @ model["hidden"].T) * (pooled > 0)
    grad["filter0"] = d_pooled.sum(axis=0)
    # Only the window that won counts for a chunk and filter.
    row = np.arange(len(chunks))
    grad["filter"] = np.empty_like(model["filter"])
    d_byte = np.zeros((256, DEPTH), np.float64)
    for f in range(FILTERS):
        grad["filter"][:, f] = seen[row, where[:, f]].T @ d_pooled[:, f]
        for k in range(WIDTH):
            sums = np.bincount(chunks[row, where[:, f] * STRIDE + k], weights=d_pooled[:, f], minlength=256)
            d_byte += sums[:, None] * model["filter"][k * DEPTH:(k + 1) * DEPTH, f]
    grad["byte"] = d_byte.astype(kind)
    return grad


def train(texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
    """The network that fits labels (0 or 1) of whole texts; the same for the same input."""
    model, rng = fresh(), np.random.default_rng(SEED + 1)
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    model["out0"][0] = np.log((labels @ weights + 1) / ((1 - labels) @ weights + 1))
    weights = weights / weights.mean()
    order = np.zeros(0, np.int64)
    for step in range(1, STEPS + 1):
        if len(order) < BATCH:
            order = np.concatenate([order, rng.permutation(len(texts))])
        picked, order = np.unique(order[:BATCH]), order[BATCH:]
        offsets = np.concatenate([[0], np.cumsum([len(texts[i]) for i in picked])])
        data = np.frombuffer(b"".join(texts[i] for i in picked), np.uint8)
        starts, whose = chunk_starts(offsets)
        grad = _summed(data, offsets, starts, whose, labels[picked], weights[picked], model)
        rate = RATE * (1 - step / STEPS) + RATE / 50
        for k, g in grad.items():
            g = g / len(picked)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            model[k] = (model[k] - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    return model


def _summed(data, offsets, starts, whose, labels, weights, model):
    """Gradients of a batch, in groups of whole texts of about TOGETHER chunks."""
    total, i, n = None, 0, len(labels)
    bounds = np.searchsorted(whose, np.arange(n + 1))
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + TOGETHER, "right")) - 1)
        part = slice(bounds[i], bounds[j])
        own = whose[part]
        grad = _gradients(chunk_bytes(data, starts[part], offsets[1:][own]), own - i, labels[i:j], weights[i:j], model)
        total = grad if total is None else {k: total[k] + g for k, g in grad.items()}
        i = j
    return total
