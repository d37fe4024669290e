"""Language identification: a bidirectional gated recurrent network over bytes.

Texts are cut into spans of ``SPAN`` bytes, which start from zero states both in training and in use. Every byte gets a
probability for each language from the forward and the backward state at it; a text's are their means. The network is
small, so that all spans of a block advance together as one matrix a step.

The fit uses at most ``SAMPLE_SPANS`` spans of at most ``SAMPLE_DOCS`` whole texts, in both the smallest hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.llm.shared import blocks, text_bytes
from loamwork.sources.tables import table

SPAN, HIDDEN = 96, 8
SAMPLE_DOCS, SAMPLE_SPANS = 4000, 16_000
Params = dict[str, np.ndarray]


def initial(classes: int, hidden: int = HIDDEN, seed: int = 5) -> Params:
    """For each direction: gate inputs by byte, recurrent weights of the gates and of the candidate; then the output."""
    random, out = np.random.default_rng(seed), {}
    for d in "fb":
        out[f"in_{d}"] = random.normal(0, 0.5, (256, 3 * hidden))
        out[f"gates_{d}"] = random.normal(0, hidden**-0.5, (hidden, 2 * hidden))
        out[f"cand_{d}"] = random.normal(0, hidden**-0.5, (hidden, hidden))
        out[f"out_{d}"] = random.normal(0, hidden**-0.5, (hidden, classes))
    out["bias"] = np.zeros(classes)
    return {k: v.astype(np.float32) for k, v in out.items()}


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def states(p: Params, d: str, spans: np.ndarray, real: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States at every step, (steps, spans, hidden). ``spans`` and ``real``: (steps, spans); beyond a span's end the state is 0."""
    steps, n = spans.shape
    hidden = p[f"cand_{d}"].shape[0]
    out = np.zeros((steps, n, hidden), np.float32)
    h = np.zeros((n, hidden), np.float32)
    full = real.all(axis=1)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        x = p[f"in_{d}"][spans[t]]
        gates = h @ p[f"gates_{d}"]
        gates += x[:, : 2 * hidden]
        sigmoid(gates)
        update, reset = gates[:, :hidden], gates[:, hidden:]
        cand = (reset * h) @ p[f"cand_{d}"]
        cand += x[:, 2 * hidden :]
        cand *= 2
        sigmoid(cand)
        cand *= 2
        cand -= 1
        new = cand - h
        new *= update
        new += h
        if not full[t]:
            new *= real[t][:, None]
        if keep is not None:
            keep.append((t, h, update, reset, cand))
        out[t] = h = new
    return out


def probabilities(p: Params, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    logits = forward @ p["out_f"] + backward @ p["out_b"] + p["bias"]
    logits -= logits.max(axis=-1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=-1, keepdims=True)
    return logits


def gradients(p: Params, spans: np.ndarray, real: np.ndarray, target: np.ndarray) -> tuple[float, Params]:
    """Mean cross-entropy over all real positions and its gradients, by backpropagation through time."""
    kept = {"f": [], "b": []}
    h = {d: states(p, d, spans, real, kept[d]) for d in "fb"}
    prob = probabilities(p, h["f"], h["b"])
    weight = real / real.sum()
    picked = np.take_along_axis(prob, np.broadcast_to(target[None, :, None], (*spans.shape, 1)), axis=2)[..., 0]
    loss = float(-(np.log(picked + 1e-9) * weight).sum())
    dlogits = prob
    np.put_along_axis(dlogits, np.broadcast_to(target[None, :, None], (*spans.shape, 1)), (picked - 1)[..., None], axis=2)
    dlogits *= weight[..., None]
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    grads["bias"] = dlogits.sum(axis=(0, 1))
    for d in "fb":
        hidden = p[f"cand_{d}"].shape[0]
        grads[f"out_{d}"] = np.einsum("tnh,tnk->hk", h[d], dlogits)
        dh_all = dlogits @ p[f"out_{d}"].T
        carry = np.zeros_like(dh_all[0])
        for t, before, update, reset, cand in reversed(kept[d]):
            dh = (dh_all[t] + carry) * real[t][:, None]
            dcand = dh * update * (1 - cand**2)
            dupdate = dh * (cand - before) * update * (1 - update)
            through = dcand @ p[f"cand_{d}"].T
            dreset = through * before * reset * (1 - reset)
            dgates = np.concatenate([dupdate, dreset], axis=1)
            carry = dh * (1 - update) + through * reset + dgates @ p[f"gates_{d}"].T
            grads[f"gates_{d}"] += before.T @ dgates
            grads[f"cand_{d}"] += (reset * before).T @ dcand
            np.add.at(grads[f"in_{d}"], spans[t], np.concatenate([dgates, dcand], axis=1))
        assert hidden
    return loss, grads


def fit(spans: np.ndarray, lengths: np.ndarray, target: np.ndarray, classes: int, steps: int = 220, batch: int = 192, rate: float = 0.02, seed: int = 11) -> Params:
    """Adam over random batches; ``spans``: (n, SPAN) bytes, ``lengths``: real bytes of each. A class's weight is even."""
    p, random = initial(classes), np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    chance = 1 / np.bincount(target, minlength=classes)[target]
    chance /= chance.sum()
    for step in range(1, steps + 1):
        i = random.choice(len(spans), size=batch, p=chance)
        real = (np.arange(spans.shape[1])[:, None] < lengths[i][None, :]).astype(np.float32)
        _, grads = gradients(p, spans[i].T, real, target[i])
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        now = rate * min(1.0, 3 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g**2
            p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def cut_spans(data: np.ndarray, at: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a block as (spans, steps), with each span's length and row."""
    sizes = np.diff(at)
    counts = -(-sizes // span)
    row = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = at[row] + nth * span
    lengths = np.minimum(span, at[row + 1] - start)
    index = start[:, None] + np.arange(span)
    padded = np.append(data, np.zeros(span, np.uint8))
    out = padded[np.minimum(index, len(data))]
    out[np.arange(span)[None, :] >= lengths[:, None]] = 0
    return out, lengths, row


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def training_spans(docs: DataFrame, limit: int = SAMPLE_DOCS, spans_limit: int = SAMPLE_SPANS) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Spans of at most ``limit`` different texts, with lengths, classes and the classes' names.

    Texts are chosen by (id, language, hash of the text), as ids may repeat, with the least hashes of these; copies of a
    chosen row are dropped before anything is collected. Every span of a chosen text is a row, wherever it stands, and
    the ``spans_limit`` rows with the least hashes are taken.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0) & ~held_out())
    keyed = known.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.xxhash64("text").alias("key"), "text")
    chosen = keyed.select("doc_id", "lang", "key").orderBy(F.xxhash64("doc_id", "key"), "doc_id", "key", "lang").limit(limit).distinct()

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            data, at = text_bytes(block.column("text"))
            spans, lengths, row = cut_spans(data, at)
            first = np.searchsorted(row, np.arange(block.num_rows + 1))
            langs, of, nth = block.column("lang").to_pylist(), pa.array(row), pa.array((np.arange(len(row)) - first[row]).astype(np.int32))
            yield pa.record_batch(
                [block.column("doc_id").take(of), block.column("key").take(of), pa.array([langs[r] for r in row.tolist()], pa.string()), nth, pa.array([x[:n].tobytes() for x, n in zip(spans, lengths.tolist(), strict=True)], pa.binary())],
                names=["doc_id", "key", "lang", "nth", "span"],
            )

    texts = keyed.join(F.broadcast(chosen), ["doc_id", "lang", "key"]).select("doc_id", "key", "lang", "text")
    once = texts.mapInArrow(taken, "doc_id long, key long, lang string, nth int, span binary").dropDuplicates(["doc_id", "key", "lang", "nth"])
    drawn = once.orderBy(F.xxhash64("doc_id", "key", "nth"), "doc_id", "key", "nth", "lang").limit(spans_limit)
    rows = sorted((r.doc_id, r.key, r.lang, r.nth, bytes(r.span)) for r in drawn.collect())
    names = sorted({r[2] for r in rows})
    spans = np.zeros((len(rows), SPAN), np.uint8)
    for i, r in enumerate(rows):
        spans[i, : len(r[4])] = np.frombuffer(r[4], np.uint8)
    return spans, np.array([len(r[4]) for r in rows], np.int64), np.array([names.index(r[2]) for r in rows], np.int64), names


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def predictions(docs: DataFrame, p: Params | None, names: list[str]) -> DataFrame:
    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", 1 << 19):
            data, at = text_bytes(block.column("text"))
            total = np.zeros((block.num_rows, max(1, len(names))))
            if p is not None and len(data):
                spans, lengths, row = cut_spans(data, at)
                real = (np.arange(SPAN)[:, None] < lengths[None, :]).astype(np.float32)
                steps = np.ascontiguousarray(spans.T)
                prob = probabilities(p, states(p, "f", steps, real), states(p, "b", steps, real))
                by_span = np.einsum("tnk,tn->nk", prob, real)
                np.add.at(total, row, by_span)
            total /= np.maximum(np.diff(at), 1)[:, None]
            letters = np.array([has_letter(x) for x in block.column("text").to_pylist()], bool)
            known = letters & (len(names) > 0)
            best = total.argmax(axis=1)
            lang = [names[k] if ok else "und" for k, ok in zip(best, known, strict=True)]
            score = np.where(known, np.clip(total.max(axis=1), 0, 1), 0.0)
            yield pa.record_batch([block.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(labelled, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, limit: int = SAMPLE_DOCS) -> DataFrame:
    """Language of every row of ``docs``: doc_id, held_out, lang_pred, score.

    ``und`` with score 0 where the text is null or has no letter, and for all rows if there is nothing to learn from.
    A null id counts as not held out and is not learned from. Rows are judged each for itself, so repeated rows get equal
    answers; of equal probabilities the language first in order is taken. An empty table gives no rows, other columns
    make no difference, and texts are read whole.
    """
    spans, lengths, target, names = training_spans(docs, limit)
    p = fit(spans, lengths, target, len(names)) if len(names) else None
    return predictions(docs, p, names).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op6_language_id": op6_language_id}
ORACLES: dict[str, str] = {}
