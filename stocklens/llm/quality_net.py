"""Quality of a text as one probability: a convolutional network over its bytes, in numpy.

Each byte position gets the response of learned filters over four bytes.  Responses are max-pooled over
blocks, two neighbouring blocks make a chunk, so chunks overlap by half and cover the whole text.  One
more channel marks bytes inside a stretch of four that also stood up to 32 bytes before.  The mean and
the maximum of the chunks, and the length, go through a small hidden layer to the probability.

The network is fitted on a bounded sample of labelled rows (``FIT_ROWS``; of texts above ``FIT_CHARS`` parts from
all over them); very long texts are scored whole.  Missing and empty texts are one empty chunk and get a score too; repeated texts get equal scores; an
empty table gives an empty result; without labels of both kinds the score is the labels' mean, or 0.5
without any.  Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from stocklens.llm.labelled import sample_of, usable_labels
from stocklens.llm.tasks import by_batches, text_rows

FIT_ROWS, FIT_CHARS = 4_000, 40_000
BLOCK = 128
_FILTERS, _TAPS, _HIDDEN, _LAGS, _RUN = 16, 4, 16, 32, 4
_GROUP = 1 << 20


@dataclass
class Network:
    """Filters [tap, byte, filter], their bias, and the two dense layers."""

    taps: np.ndarray
    bias: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    outer: np.ndarray
    outer_bias: float
    pairs: tuple[np.ndarray, np.ndarray] | None = None

    def prepared(self) -> Network:
        """With the filters summed for each pair of bytes, so that four bytes take two lookups."""
        first = (self.taps[0][:, None, :] + self.taps[1][None, :, :] + self.bias).reshape(65536, -1)
        second = (self.taps[2][:, None, :] + self.taps[3][None, :, :]).reshape(65536, -1)
        self.pairs = first.astype(np.float32), second.astype(np.float32)
        return self


def laid_out(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes with each text padded by zeros to whole blocks, blocks by text, bytes by text.

    There are always so many zeros that a filter or a lag never sees the text before.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    blocks = -(-(sizes + _LAGS + _TAPS) // BLOCK)
    padded = b"".join(t.ljust(int(n) * BLOCK, b"\0") for t, n in zip(texts, blocks, strict=True))
    return np.frombuffer(padded, np.uint8), blocks, sizes


def _repeats(data: np.ndarray) -> np.ndarray:
    """Per block, the share of bytes that end a stretch of four seen up to 32 bytes before."""
    found = np.zeros(len(data), bool)
    there = data != 0
    for lag in range(2, _LAGS + 1):
        same = np.zeros(len(data), bool)
        same[lag:] = (data[lag:] == data[:-lag]) & there[lag:]
        run = same.copy()
        for back in range(1, _RUN):
            run[back:] &= same[:-back]
        found |= run
    return found.reshape(-1, BLOCK).mean(1, dtype=np.float32)


def _responses(data: np.ndarray, begin: int, end: int, network: Network) -> np.ndarray:
    """The filters over the four bytes that end at each position from ``begin`` to ``end``."""
    first, second = network.prepared().pairs if network.pairs is None else network.pairs
    missing = np.zeros(max(0, _TAPS - 1 - begin), np.uint8)
    seen = np.concatenate([missing, data[max(0, begin - _TAPS + 1) : end]]).astype(np.int32)
    two = (seen[:-1] << 8) | seen[1:]
    count = end - begin
    response = first[two[:count]]
    response += second[two[2 : count + 2]]
    return response


def _chunks(pooled: np.ndarray, blocks: np.ndarray, combine) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring blocks of a text combined; the first chunk of each text."""
    ends = np.cumsum(blocks)
    single = blocks == 1
    follower = np.minimum(np.arange(len(pooled)) + 1, len(pooled) - 1)
    last = np.zeros(len(pooled), bool)
    last[ends - 1] = True
    follower[last] = np.flatnonzero(last)
    keep = ~last
    keep[(ends - 1)[single]] = True
    both = combine(pooled, pooled[follower])[keep]
    return both, np.concatenate([[0], np.cumsum(np.maximum(blocks - 1, 1))[:-1]])


def _features(z: np.ndarray, repeats: np.ndarray, blocks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per text: mean and maximum over chunks of the pooled responses and of the repeats, and length."""
    chunk, first = _chunks(z, blocks, np.maximum)
    again, _ = _chunks(repeats, blocks, lambda a, b: (a + b) / 2)
    counts = np.maximum(blocks - 1, 1)[:, None]
    return np.concatenate(
        [
            np.add.reduceat(chunk, first) / counts,
            np.maximum.reduceat(chunk, first),
            (np.add.reduceat(again, first) / counts[:, 0])[:, None] * 4,
            np.maximum.reduceat(again, first)[:, None] * 4,
            np.log1p(sizes)[:, None] / 8,
        ],
        axis=1,
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def score(texts: Sequence[str], network: Network) -> np.ndarray:
    """The probability of label 1 of each text."""
    result = np.empty(len(texts))
    raw = [t.encode() for t in texts]
    begin = 0
    while begin < len(raw):
        end, held = begin, 0
        while end < len(raw) and (not held or held + len(raw[end]) <= _GROUP):
            held += max(len(raw[end]), BLOCK)
            end += 1
        data, blocks, sizes = laid_out(raw[begin:end])
        pooled, repeats = [], []
        for part in range(0, len(data), _GROUP):  # a long text in parts; each sees what stood before it
            margin = min(part, BLOCK)
            stop = min(part + _GROUP, len(data))
            repeats.append(_repeats(data[part - margin : stop])[margin // BLOCK :])
            response = _responses(data, part, stop, network)
            pooled.append(response.reshape(-1, BLOCK, response.shape[1]).max(1))
        z = np.maximum(np.concatenate(pooled), 0)
        x = _features(z, np.concatenate(repeats), blocks, sizes)
        hidden = np.tanh(x @ network.inner + network.inner_bias)
        result[begin:end] = _sigmoid(hidden @ network.outer + network.outer_bias)
        begin = end
    return result


def fitted(
    texts: Sequence[str], labels: Sequence[int], epochs: int = 8, batch: int = 64, seed: int = 7
) -> Network:
    """A network fitted by Adam on the mean log loss; gradients pass through the positions of the maxima."""
    random = np.random.default_rng(seed)
    y = np.asarray(labels, float)
    share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    width = 2 * _FILTERS + 3
    network = Network(
        random.normal(0, 0.25, (_TAPS, 256, _FILTERS)).astype(np.float32),
        np.full(_FILTERS, 0.1, np.float32),
        random.normal(0, 0.25, (width, _HIDDEN)),
        np.zeros(_HIDDEN),
        random.normal(0, 0.25, _HIDDEN),
        float(np.log(share / (1 - share))),
    )
    if len(set(labels)) < 2:
        network.outer[:] = 0
        return network.prepared()
    raw = [t.encode() for t in texts]
    names = ("taps", "bias", "inner", "inner_bias", "outer", "outer_bias")
    moments = {n: (np.zeros_like(getattr(network, n)), np.zeros_like(getattr(network, n))) for n in names}
    step = 0
    for epoch in range(epochs):
        order = random.permutation(len(raw))
        rate = 0.01 * (1 - epoch / epochs) + 0.001
        for begin in range(0, len(order), batch):
            some = order[begin : begin + batch]
            gradients = _gradients([raw[i] for i in some], y[some], network)
            step += 1
            for name, gradient in gradients.items():
                first, second = moments[name]
                first += 0.1 * (gradient - first) if np.ndim(first) else 0
                second += 0.01 * (gradient**2 - second) if np.ndim(second) else 0
                if not np.ndim(first):
                    network.outer_bias -= rate * float(gradient)
                    continue
                scaled = (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
                setattr(network, name, getattr(network, name) - (rate * scaled).astype(first.dtype))
            network.pairs = None
    return network.prepared()


def _gradients(raw: list[bytes], y: np.ndarray, network: Network) -> dict[str, np.ndarray]:
    data, blocks, sizes = laid_out(raw)
    padded = np.concatenate([np.zeros(_TAPS - 1, np.uint8), data])
    response = network.bias + sum(network.taps[j][padded[j : j + len(data)]] for j in range(_TAPS))
    by_block = response.reshape(-1, BLOCK, _FILTERS)
    at = by_block.argmax(1)
    pooled = np.take_along_axis(by_block, at[:, None, :], 1)[:, 0]
    z = np.maximum(pooled, 0)
    x = _features(z, _repeats(data), blocks, sizes)
    hidden = np.tanh(x @ network.inner + network.inner_bias)
    error = (_sigmoid(hidden @ network.outer + network.outer_bias) - y) / len(y)
    back = np.outer(error, network.outer) * (1 - hidden**2)
    to_x = back @ network.inner.T
    # through mean and maximum over chunks, and the maximum of two blocks, back to the blocks
    chunk, first = _chunks(z, blocks, np.maximum)
    counts = np.maximum(blocks - 1, 1)
    owner = np.repeat(np.arange(len(raw)), counts)
    top = np.maximum.reduceat(chunk, first)
    is_top = chunk == top[owner]
    ties = np.add.reduceat(is_top, first)[owner]
    to_chunk = to_x[owner, :_FILTERS] / counts[owner][:, None]
    to_chunk += np.where(is_top, to_x[owner, _FILTERS : 2 * _FILTERS] / ties, 0)
    start = np.cumsum(blocks) - blocks
    left = np.arange(len(chunk)) - first[owner] + start[owner]
    right = np.where(blocks[owner] > 1, left + 1, left)
    to_left = z[left] >= z[right]
    to_z = np.zeros_like(z)
    np.add.at(to_z, left, np.where(to_left, to_chunk, 0))
    np.add.at(to_z, right, np.where(to_left, 0, to_chunk))
    to_z = np.where(pooled > 0, to_z, 0)
    place = at + (np.arange(len(at)) * BLOCK)[:, None]
    taps = np.zeros_like(network.taps)
    column = np.arange(_FILTERS)[None, :]
    for j in range(_TAPS):
        flat = padded[place + j].astype(np.int64) * _FILTERS + column
        summed = np.bincount(flat.ravel(), weights=to_z.ravel(), minlength=256 * _FILTERS)
        taps[j] = summed.reshape(256, _FILTERS)
    return {
        "taps": taps,
        "bias": to_z.sum(0),
        "inner": x.T @ back,
        "inner_bias": back.sum(0),
        "outer": hidden.T @ error,
        "outer_bias": np.float64(error.sum()),
    }


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", divisor: int = 3, left_out: int = 1
) -> Network:
    """A network fitted on the bounded sample; ids whose remainder is ``left_out`` stay unseen."""
    usable = usable_labels(labels, label, divisor, left_out)
    rows = sample_of(text_rows(docs), usable, FIT_ROWS, FIT_CHARS).select("doc_id", "text", "label")
    sample = rows.toPandas().sort_values(["doc_id", "text"])
    return fitted(sample["text"].tolist(), sample["label"].tolist())


def scored(
    docs: DataFrame, network: Network, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id`` and ``score`` of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(rows: dict[str, list]) -> dict[str, list]:
        return {"doc_id": rows["doc_id"], "score": score(rows["text"], shared.value)}

    kind = docs.schema[id_column].dataType.simpleString()
    return by_batches(text_rows(docs, id_column, text_column), run, f"doc_id {kind}, score double")
