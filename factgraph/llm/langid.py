"""Language identification with a bidirectional gated recurrent network over bytes, in numpy.

The network reads a text's UTF-8 bytes (A-Z lower-cased) in both directions and labels every byte
position, blanks, digits and signs included; a document's probabilities are the mean over all
positions of the whole text. A text is read in stretches of ``STRETCH`` bytes. The state of either
direction starts ``MARGIN`` bytes outside of its stretch, so that each position has at least so much
of the text on both sides; beyond the ends of the text stand zero bytes. It is trained by
backpropagation through time on a bounded sample: ``stretches_per_doc`` places drawn from all of the
text of ``docs_per_language`` documents of each language, those with the smallest hash of their id.

Gates use softsign in the place of tanh and the logistic function.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without training
rows every text is ``und``; more than ``max_languages`` languages are an error, none is left out;
repeated rows are predicted alike, each; an empty table gives an empty result; only the id, text and
lang columns are read. Texts may have any length and script, with or without blanks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgraph.llm.rows import id_type

LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
STRETCH, MARGIN = 64, 8
WIDTH = STRETCH + 2 * MARGIN


def bytes_of(text: str) -> bytes:
    return text.encode().lower()


def stretches(data: bytes) -> np.ndarray:
    """One row of ``WIDTH`` bytes per stretch; the positions between the margins are the text's, once each."""
    n = -(-len(data) // STRETCH)
    whole = np.frombuffer(bytes(MARGIN) + data + bytes(n * STRETCH - len(data) + MARGIN), np.uint8)
    return np.lib.stride_tricks.sliding_window_view(whole, WIDTH)[::STRETCH]


def _squash(x: np.ndarray) -> np.ndarray:
    """Softsign, in the place of tanh: the same shape, and several times cheaper; gates are (1 + it) / 2."""
    return x / (1 + np.abs(x))


def _slope(y: np.ndarray) -> np.ndarray:
    """The derivative of ``_squash`` where its value is y."""
    return (1 - np.abs(y)) ** 2


@dataclass
class Network:
    """Parameters: per direction a byte table (256, 3H), a recurrence (H, 3H) and a bias; then the labels."""

    languages: list[str]
    params: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, languages: list[str], hidden: int = 8, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        params = {}
        for d in "fb":
            params[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * hidden))
            params[f"u{d}"] = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden))
            params[f"c{d}"] = np.zeros(3 * hidden)
            params[f"o{d}"] = rng.normal(0, hidden**-0.5, (hidden, len(languages)))
        params["bias"] = np.zeros(len(languages))
        return cls(languages, {k: v.astype(np.float32) for k, v in params.items()})

    def _direction(self, x: np.ndarray, d: str, keep: bool) -> tuple[list[np.ndarray], list]:
        """States after each byte, in reading order; with ``keep`` also what the backward pass needs."""
        table, u, c = self.params[f"x{d}"], self.params[f"u{d}"], self.params[f"c{d}"]
        size = u.shape[0]
        h, states, kept = np.zeros((len(x), size), np.float32), [], []
        for t in range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1):
            a, b = table[x[:, t]] + c, h @ u
            gates = 0.5 + 0.5 * _squash(a[:, : 2 * size] + b[:, : 2 * size])
            z, r = gates[:, :size], gates[:, size:]
            n = _squash(a[:, 2 * size :] + r * b[:, 2 * size :])
            new = n + z * (h - n)
            if keep:
                kept.append((t, h, z, r, n, b[:, 2 * size :]))
            h = new
            states.append(h)
        return states, kept

    def _states(self, x: np.ndarray, d: str) -> list[np.ndarray]:
        """As ``_direction`` without what training keeps; features by row, so that every step is contiguous."""
        table, u = np.ascontiguousarray((self.params[f"x{d}"] + self.params[f"c{d}"]).T), np.ascontiguousarray(self.params[f"u{d}"].T)
        size, columns = u.shape[1], np.ascontiguousarray(x.T)
        h, states = np.zeros((size, len(x)), np.float32), []
        for t in range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1):
            a, b = table.take(columns[t], axis=1), u @ h
            gates = _squash(a[: 2 * size] + b[: 2 * size])
            gates *= 0.5
            gates += 0.5
            b[2 * size :] *= gates[size:]
            b[2 * size :] += a[2 * size :]
            n = _squash(b[2 * size :])
            h = n + gates[:size] * (h - n)
            states.append(h)
        return states if d == "f" else states[::-1]

    def position_sums(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Label probabilities (n, languages) of stretches, summed over the first ``sizes`` positions between the margins."""
        of, ob, bias = self.params["of"].T, self.params["ob"].T, self.params["bias"][:, None]
        total = np.zeros((len(bias), len(x)), np.float32)
        forward, backward = self._states(x[:, : MARGIN + STRETCH], "f"), self._states(x[:, MARGIN:], "b")
        most = int(sizes.max()) if len(sizes) else 0
        for t in range(most):
            logits = of @ forward[MARGIN + t] + ob @ backward[t] + bias
            logits -= logits.max(axis=0)
            np.exp(logits, out=logits)
            logits /= logits.sum(axis=0)
            total += logits if t < STRETCH and (sizes > t).all() else logits * (sizes > t)
        return total.T

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions, and its gradients by backpropagation through time."""
        size, length = self.params["uf"].shape[0], x.shape[1]
        runs = {d: self._direction(x, d, True) for d in "fb"}
        at = {d: dict(zip((k[0] for k in runs[d][1]), runs[d][0], strict=True)) for d in "fb"}
        grads = {k: np.zeros_like(v) for k, v in self.params.items()}
        loss, back = 0.0, {}
        for t in range(length):
            logits = at["f"][t] @ self.params["of"] + at["b"][t] @ self.params["ob"] + self.params["bias"]
            logits = logits - logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(axis=1, keepdims=True)
            loss -= float(np.log(p[np.arange(len(y)), y] + 1e-12).sum())
            p[np.arange(len(y)), y] -= 1
            p /= x.size
            grads["bias"] += p.sum(axis=0)
            for d in "fb":
                grads[f"o{d}"] += at[d][t].T @ p
            back[t] = p
        for d in "fb":
            u, carry = self.params[f"u{d}"], np.zeros((len(x), size), np.float32)
            for t, h, z, r, n, bn in reversed(runs[d][1]):
                dh = carry + back[t] @ self.params[f"o{d}"].T
                dn = dh * (1 - z) * _slope(n)
                dz = dh * (h - n) * 0.5 * _slope(2 * z - 1)
                dr = dn * bn * 0.5 * _slope(2 * r - 1)
                da = np.concatenate((dz, dr, dn), axis=1)
                db = np.concatenate((dz, dr, dn * r), axis=1)
                np.add.at(grads[f"x{d}"], x[:, t], da)
                grads[f"c{d}"] += da.sum(axis=0)
                grads[f"u{d}"] += h.T @ db
                carry = dh * z + db @ u.T
        return loss / x.size, grads


def train(x: np.ndarray, labels: np.ndarray, languages: list[str], *, hidden: int = 8, epochs: int = 4, batch: int = 128, rate: float = 0.01, seed: int = 0) -> Network:
    """Adam on rows of bytes, all positions labelled; deterministic for given rows."""
    net, rng = Network.fresh(languages, hidden, seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.params.items()}
    second = {k: np.zeros_like(v) for k, v in net.params.items()}
    step = 0
    for epoch in range(epochs):
        order, speed = rng.permutation(len(x)), rate * 0.5**epoch
        for at in range(0, len(x), batch):
            step += 1
            some = order[at : at + batch]
            _, grads = net.gradients(x[some], labels[some])
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                net.params[k] = (net.params[k] - speed * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def pool(net: Network, texts: list[str | None], block: int = 4096) -> tuple[list[str], list[float]]:
    """The most probable language of each text, by the mean over all byte positions, ``block`` stretches at a time."""
    known = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
    sums = np.zeros((len(texts), len(net.languages)))
    rows, owners, sizes, held = [], [], [], 0

    def flush() -> None:
        x, owner, size = np.concatenate(rows), np.concatenate(owners), np.concatenate(sizes)
        for at in range(0, len(x), block):
            some = slice(at, at + block)
            np.add.at(sums, owner[some], net.position_sums(x[some], size[some]))
        rows.clear()
        owners.clear()
        sizes.clear()

    for i in known:
        data = bytes_of(texts[i])
        found = stretches(data)
        rows.append(found)
        owners.append(np.full(len(found), i))
        sizes.append(np.minimum(STRETCH, len(data) - STRETCH * np.arange(len(found))))
        held += len(found)
        if held >= 4 * block:
            flush()
            held = 0
    if rows:
        flush()
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    for i in known:
        langs[i], scores[i] = net.languages[int(sums[i].argmax())], min(1.0, float(sums[i].max() / max(sums[i].sum(), 1e-9)))
    return langs, scores


def _draw(stretches_per_doc: int):
    """Some places of each text, drawn by the document's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = bytes_of(text or "")
                rng = np.random.default_rng(key)
                starts = rng.integers(0, max(1, len(data) - WIDTH + 1), stretches_per_doc if len(data) > WIDTH else 1)
                drawn.append([data[a : a + WIDTH].ljust(WIDTH, b"\0") for a in sorted(set(starts.tolist()))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(drawn, pa.list_(pa.binary()))], names=["key", "lang", "places"])

    return run


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 400, stretches_per_doc: int = 8, max_languages: int = 200, **options) -> Network | None:
    """Train on a bounded sample of the documents that have a language and a letter; None without any.

    One pass finds the sample: every task keeps its first ``docs_per_language`` of each language before
    anything is shuffled. A second reads the texts.
    """
    usable = docs.select(F.col(id_col).alias("id_"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    key = F.coalesce(F.crc32(F.col("id_").cast("string")), F.lit(0))
    ranked = usable.select("id_", "lang", key.alias("key")).withColumn("rank_", F.row_number().over(Window.partitionBy("lang").orderBy("key", "id_")))
    chosen = ranked.where(F.col("rank_") <= docs_per_language).select("id_", "lang", "key").distinct().limit(docs_per_language * max_languages + 1).collect()
    languages = sorted({r["lang"] for r in chosen})
    if len(languages) > max_languages or len(chosen) > docs_per_language * max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not chosen:
        return None
    # The broadcast side has docs_per_language rows a language at most.
    ids = F.broadcast(docs.sparkSession.createDataFrame(chosen, f"id_ {id_type(docs, id_col)}, lang string, key long"))
    same = usable["id_"].eqNullSafe(ids["id_"]) & (usable["lang"] == ids["lang"])
    rows = usable.join(ids, same).select("key", usable["lang"], "text").mapInArrow(_draw(stretches_per_doc), "key long, lang string, places array<binary>").collect()
    rows = sorted((r["lang"], r["key"], [bytes(p) for p in r["places"]]) for r in rows)
    places = [(p, languages.index(lang)) for lang, _, found in rows for p in found]
    x = np.frombuffer(b"".join(p for p, _ in places), np.uint8).reshape(len(places), WIDTH)
    return train(x, np.array([y for _, y in places]), languages, **options)


def predict(docs: DataFrame, net: Network | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``lang_pred`` and ``score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            langs, scores = pool(net, texts) if net else ([UNKNOWN] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type(docs, id_col)}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def contract(docs: DataFrame) -> DataFrame:
    """Learn from documents that are not held out, then predict every document."""
    net = learn(docs.where(~held_out("doc_id")))
    return predict(docs, net).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
