"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy."""
from __future__ import annotations

import gc
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out

WINDOW, STRIDE, HIDDEN, WORD_DIM, CHAR_DIM, CHAR_BINS, VOCAB = 64, 32, 12, 12, 8, 1 << 14, 8192      # a passage of 32 words is whole in a window
TRAIN_DOCS, TRAIN_BYTES, ROUNDS, STEPS, BATCH, RATE = 1500, 3 << 20, 5, 80, 128, 0.004     # bounds of the labelled sample: rows and bytes a class
EDGE = ".,;:!?*%&$#|\"'()[]{}<>-"
KNOWN_WORDS = 300_000


def char_bins(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 3- to 5-grams of each word's bytes between borders: (bins, how many each word has), word by word."""
    marked = [b"<" + (w.encode() or b" ") + b">" for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    text = np.frombuffer(b"".join(marked) + b"\0" * 4, np.uint8).astype(np.uint32)
    stop = np.repeat(np.cumsum(size), size)
    at = np.arange(len(stop))
    owner = np.repeat(np.arange(len(marked)), size)
    bins, owners, rolling = [], [], text[:len(stop)]
    for n in (2, 3, 4, 5):
        rolling = rolling * np.uint32(0x01000193) ^ text[n - 1:n - 1 + len(stop)]
        if n > 2:
            ok = at + n <= stop
            mixed = rolling[ok] * np.uint32(0x9E3779B1)
            bins.append((mixed >> np.uint32(18)).astype(np.int64))
            owners.append(owner[ok])
    bins, owners = np.concatenate(bins), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return bins[order], np.bincount(owners, minlength=len(marked))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def summed(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each index below n."""
    order = np.argsort(index, kind="stable")
    at = index[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    out = np.zeros((n, rows.shape[1]), np.float32)
    out[at[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


class Net:
    """Parameters `p`, the vocabulary, and the final scale that turns a document's highest window into a probability."""

    def __init__(self, vocab: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        self.vocab = {w: i + 1 for i, w in enumerate(vocab)}        # 0: any other word

        def start(*shape: int, scale: float) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)
        self.p = {"word": start(len(vocab) + 1, WORD_DIM, scale=0.1), "char": start(CHAR_BINS, CHAR_DIM, scale=0.1),
                  "att": start(2 * h, h, scale=0.3), "att_b": np.zeros(h, np.float32), "att_v": start(h, scale=0.3),
                  "out": start(2 * h, scale=0.3), "out_b": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"x{side}": start(d, 3 * h, scale=d ** -0.5), f"b{side}": np.zeros(3 * h, np.float32),
                       f"u{side}": start(h, 3 * h, scale=h ** -0.5)}
        self.scale = (1.0, 0.0, 0.0)

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """Input vector of each distinct word, and what the backward pass needs."""
        ids = np.array([self.vocab.get(w.strip(EDGE), 0) for w in words], np.int64)
        bins, n = char_bins(words)
        sums = np.add.reduceat(self.p["char"][bins], np.append(0, np.cumsum(n)[:-1]), axis=0)
        return np.hstack([self.p["word"][ids], sums / np.sqrt(n)[:, None]]).astype(np.float32), (ids, bins, n)

    def run(self, side: str, gates: np.ndarray, index: np.ndarray, mask: np.ndarray | None, keep: list | None) -> np.ndarray:
        """States of one direction over windows `index` (rows of word positions); `keep` gathers the steps for training."""
        h, u = HIDDEN, self.p[f"u{side}"]
        state = np.zeros((len(index), h), np.float32)
        out = np.empty((index.shape[1], len(index), h), np.float32)
        for t in (range(index.shape[1]) if side == "f" else range(index.shape[1] - 1, -1, -1)):
            x, r = gates[index[:, t]], state @ u
            zr = x[:, :2 * h] + r[:, :2 * h]
            zr *= np.float32(0.5)
            np.tanh(zr, out=zr)
            zr *= np.float32(0.5)
            zr += np.float32(0.5)                           # logistic
            new = zr[:, h:] * r[:, 2 * h:]
            new += x[:, 2 * h:]
            np.tanh(new, out=new)
            after = np.subtract(state, new, out=out[t])
            after *= zr[:, :h]
            after += new
            if mask is not None:
                np.copyto(after, state, where=~mask[:, t, None])
            if keep is not None:
                keep.append((t, state, zr, new, r[:, 2 * h:]))
            state = after
        return out.transpose(1, 0, 2)

    def logits(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray | None, keep: dict | None = None) -> np.ndarray:
        states = np.concatenate([self.run(s, x @ self.p[f"x{s}"] + self.p[f"b{s}"], index, mask,
                                          None if keep is None else keep.setdefault(s, [])) for s in "fb"], axis=2)
        hidden = np.tanh(states @ self.p["att"] + self.p["att_b"])
        score = hidden @ self.p["att_v"]
        if mask is not None:
            score = np.where(mask, score, -1e9)
        weight = np.exp(score - score.max(1, keepdims=True))
        weight /= weight.sum(1, keepdims=True)
        pooled = (states * weight[:, :, None]).sum(1)
        if keep is not None:
            keep |= {"states": states, "hidden": hidden, "weight": weight, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["out_b"][0]

    def gradients(self, words: list[str], index: np.ndarray, mask: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict:
        """Of the weighted log loss, through time in both directions, down to words and character grams."""
        p, h, keep = self.p, HIDDEN, {}
        x, (ids, bins, n) = self.inputs(words)
        off = ((sigmoid(self.logits(x, index, mask, keep)) - label) * weight / max(1.0, weight.sum())).astype(np.float32)
        g = {"out": keep["pooled"].T @ off, "out_b": off.sum(keepdims=True)}
        pooled = off[:, None] * p["out"]
        by_state = (keep["states"] * pooled[:, None, :]).sum(2)
        score = keep["weight"] * (by_state - (by_state * keep["weight"]).sum(1, keepdims=True))
        hidden = score[:, :, None] * p["att_v"] * (1 - keep["hidden"] ** 2)
        g |= {"att_v": np.einsum("bt,bth->h", score, keep["hidden"]), "att_b": hidden.sum((0, 1)),
              "att": np.einsum("bti,bth->ih", keep["states"], hidden, optimize=True)}
        states = keep["weight"][:, :, None] * pooled[:, None, :] + hidden @ p["att"].T
        to_x = np.zeros_like(x)
        for k, side in enumerate("fb"):
            u, raws = p[f"u{side}"], np.empty((index.shape[1], len(index), 3 * h), np.float32)
            gu, back = np.zeros_like(u), np.zeros((len(index), h), np.float32)
            for t, before, zr, new, rn in reversed(keep[side]):
                live = mask[:, t, None]
                full = states[:, t, k * h:(k + 1) * h] + back
                here = full * live
                z, r = zr[:, :h], zr[:, h:]
                dn = here * (1 - z) * (1 - new ** 2)
                dz = here * (before - new) * z * (1 - z)
                dr = dn * rn * r * (1 - r)
                raws[t] = np.hstack([dz, dr, dn])
                pre = np.hstack([dz, dr, dn * r])
                gu += before.T @ pre
                back = here * z + pre @ u.T + full * ~live
            gates = summed(index.T.ravel(), raws.reshape(-1, 3 * h), len(x))
            g |= {f"u{side}": gu, f"x{side}": x.T @ gates, f"b{side}": gates.sum(0)}
            to_x += gates @ p[f"x{side}"].T
        g["word"] = summed(ids, to_x[:, :WORD_DIM], len(p["word"]))
        g["char"] = summed(bins, np.repeat(to_x[:, WORD_DIM:] / np.sqrt(n)[:, None].astype(np.float32), n, axis=0), CHAR_BINS)
        return g


def windows(n: int) -> list[int]:
    """Starts of the overlapping windows over n words; the last ends with the text."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


class Windows:
    """All windows of texts given as word numbers, laid end to end once; the rows of a step are cut from there when they are needed."""

    def __init__(self, docs: list[list[int]]):
        size = np.array([len(d) for d in docs], np.int64)
        self.flat = np.concatenate([*(np.asarray(d, np.int32) for d in docs), np.zeros(WINDOW, np.int32)])
        starts = [np.array(windows(n), np.int64) for n in size.tolist()]
        self.owner = np.repeat(np.arange(len(docs), dtype=np.int32), [len(x) for x in starts])
        self.start = np.concatenate(starts) + np.repeat(np.cumsum(size) - size, [len(x) for x in starts])
        self.length = np.minimum(size, WINDOW).astype(np.int32)[self.owner]

    def rows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers, mask) of some windows."""
        mask = np.arange(WINDOW) < self.length[which, None]
        return np.where(mask, self.flat[self.start[which, None] + np.arange(WINDOW)], 0), mask


def numbered(texts: list[list[str]]) -> tuple[list[str], list[list[int]]]:
    """The distinct words, and the texts as their numbers."""
    place = Places()
    return place.words, [[place[w] for w in words] for words in texts]


def train(texts: list[str], labels: np.ndarray, shares: tuple[float, float], seed: int = 3) -> Net:
    """Fit on labelled texts; `shares` are the natural frequencies of label 0 and 1, for the final scale.

    A label holds for a text, not for each window: after the first round (all windows once, STEPS steps at least) only those windows of a positive text stay positive
    that score near its highest; its others are left out. A fifth of the texts fits the scale from a text's highest window.
    """
    rng = np.random.default_rng(seed)
    split = [t.lower().split() or [""] for t in texts]
    tune = rng.random(len(texts)) < 0.2
    count = Counter(w for s, t in zip(split, tune) if not t for w in {w.strip(EDGE) for w in s})
    net = Net([w for w, c in sorted(count.items(), key=lambda x: (-x[1], x[0])) if c >= 3 and w][:VOCAB])
    words, at = numbered(split)
    del split
    if not words or len(set(labels.tolist())) < 2:
        net.scale = (0.0, 0.0, float(np.log((shares[1] + 1e-6) / (shares[0] + 1e-6))))
        return net
    all_windows = Windows(at)
    owner = all_windows.owner
    chosen = np.flatnonzero(~tune[owner])
    label = labels[owner].astype(np.float32)
    weight = np.where(label > 0, 0.5, 1.0).astype(np.float32)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0

    def step_inputs(rows: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words that some windows hold, the windows as their places among these, and the mask."""
        index, mask = all_windows.rows(rows)
        used, again = np.unique(index, return_inverse=True)
        return [words[i] for i in used.tolist()], again.reshape(index.shape), mask

    def scored(rows: np.ndarray) -> np.ndarray:
        out = []
        for a in range(0, len(rows), 2048):
            held, place, mask = step_inputs(rows[a:a + 2048])
            out.append(net.logits(net.inputs(held)[0], place, mask))
        return np.concatenate(out)
    for turn in range(ROUNDS):
        live = chosen[weight[chosen] > 0]
        again = max(1, -(-STEPS * BATCH // max(1, len(live))))
        mixed = np.concatenate([rng.permutation(live) for _ in range(again)])
        for a in range(0, len(mixed), BATCH):
            rows = mixed[a:a + BATCH]
            held, place, mask = step_inputs(rows)
            g = net.gradients(held, place, mask, label[rows], weight[rows])
            step += 1
            for k, v in g.items():
                v = np.clip(v, -1, 1)
                m[k] += 0.1 * (v - m[k])
                s[k] += 0.01 * (v * v - s[k])
                net.p[k] -= RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.99 ** step)) + 1e-6)
        if turn + 1 < ROUNDS:
            z = np.full(len(owner), -np.inf)
            z[chosen] = scored(chosen)
            top = np.full(len(texts), -np.inf)
            np.maximum.at(top, owner, z)
            near = z >= np.minimum(top[owner] - 1e-6, 0.0)
            weight = np.where(label > 0, near, 1.0).astype(np.float32)
    rows = np.flatnonzero(tune[owner])
    if len(rows) and len(set(labels[tune].tolist())) == 2:
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, owner[rows], scored(rows))
        net.scale = platt(top[tune], np.log(np.bincount(owner, minlength=len(texts)))[tune], labels[tune], shares)
    return net


def platt(top: np.ndarray, length: np.ndarray, label: np.ndarray, shares: tuple[float, float]) -> tuple[float, float, float]:
    """Logistic fit of the label on (highest window, log of the number of windows, 1), classes weighted to their natural shares."""
    x = np.stack([np.clip(top, -12, 12), length, np.ones(len(top))], axis=1)
    weight = np.where(label > 0, shares[1] / label.mean(), shares[0] / (1 - label.mean()))
    b = np.zeros(3)
    for _ in range(50):
        p = sigmoid(x @ b)
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(3)
        b += np.linalg.solve(hess, x.T @ (weight * (label - p)) - 0.5 * b)
    return tuple(b.tolist())


class Places(dict):
    """Numbers words in the order in which they are asked for."""

    def __init__(self):
        super().__init__()
        self.words: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n


class Scorer:
    """Scores texts with a trained net; the gate inputs of words already seen are remembered (at most KNOWN_WORDS)."""

    def __init__(self, net: Net):
        self.net, self.place = net, Places()
        self.gates = {s: np.zeros((KNOWN_WORDS, 3 * HIDDEN), np.float32) for s in "fb"}

    def positions(self, words: list[list[str]]) -> list[list[int]]:
        if len(self.place) > KNOWN_WORDS // 2:
            self.place = Places()
        done, place = len(self.place), self.place
        out = [[place[w] for w in ws] for ws in words]
        while len(place) > len(self.gates["f"]):             # one slice may bring more words than are remembered
            self.gates = {s: np.vstack([g, np.zeros_like(g)]) for s, g in self.gates.items()}
        for a in range(done, len(place), 8192):
            part = place.words[a:a + 8192]
            x, _ = self.net.inputs(part)
            for s, g in self.gates.items():
                g[a:a + len(part)] = x @ self.net.p[f"x{s}"] + self.net.p[f"b{s}"]
        return out

    def windowed(self, index: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        net = self.net
        states = np.concatenate([net.run(s, self.gates[s], index, mask, None) for s in "fb"], axis=2)
        score = np.tanh(states @ net.p["att"] + net.p["att_b"]) @ net.p["att_v"]
        if mask is not None:
            score = np.where(mask, score, -1e9)
        weight = np.exp(score - score.max(1, keepdims=True))
        return ((states @ net.p["out"]) * weight).sum(1) / weight.sum(1) + net.p["out_b"][0]

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 for each text; a text without words gets the same score whatever it holds."""
        split = [t.lower().split() or [""] for t in texts]
        every = Windows(self.positions(split))
        owner, full = every.owner, every.length == WINDOW
        z = np.empty(len(owner), np.float32)
        for rows, masked in ((np.flatnonzero(full), False), (np.flatnonzero(~full), True)):
            for a in range(0, len(rows), 2048):
                part = rows[a:a + 2048]
                index, mask = every.rows(part)
                z[part] = self.windowed(index, mask if masked else None)
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, owner, z)
        a, b, c = self.net.scale
        return sigmoid(a * np.clip(top, -12, 12) + b * np.log(np.bincount(owner, minlength=len(texts))) + c)


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """A bounded sample of labelled texts outside the held-out fold, `rows` a class (smallest hashes), and the class counts.

    Of the rows that share an id one text stays, that of the smallest hash."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    picks = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)]
    pick = picks[0].unionByName(picks[1])
    texts = docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id")      # at most 2 x rows small rows
    texts = texts.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return texts, known.groupBy("y").count()


def bounded(sample: DataFrame, size: int) -> DataFrame:
    """Rows (doc_id, y, text) of each class, in hash order, as long as their texts add up to `size` bytes; a text longer than a twentieth of
    that takes no part, none is cut."""
    bytes_ = F.octet_length(F.coalesce("text", F.lit("")))
    order = Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id")
    return sample.where(bytes_ <= size // 20).withColumn("total", F.sum(bytes_).over(order)).where(F.col("total") <= size).drop("total")


def fit(docs: DataFrame, labels: DataFrame) -> Net:
    """Train on a bounded sample of the labelled rows outside the held-out fold: at most TRAIN_DOCS rows and TRAIN_BYTES of text a class,
    which is what reaches the driver. All windows of a sampled text are learned from."""
    sample, counts = labelled(docs, labels, "toxic", TRAIN_DOCS)
    rows = sorted((r.doc_id, r.text or "", r.y) for r in bounded(sample, TRAIN_BYTES).collect())
    n = {r.y: r["count"] for r in counts.collect()}
    total = max(1, sum(n.values()))
    net = train([r[1] for r in rows], np.array([r[2] for r in rows], float), (n.get(0, 0) / total, n.get(1, 0) / total))
    del rows
    gc.collect()
    return net


def scores_of(batches: Iterator[pa.RecordBatch], net: Net, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with the scores of their texts."""
    scorer = Scorer(net)
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            yield part, scorer.score([t or "" for t in part.column(part.schema.get_field_index(column)).to_pylist()])


def score_batches(batches: Iterator[pa.RecordBatch], net: Net) -> Iterator[pa.RecordBatch]:
    for part, score in scores_of(batches, net, "text"):
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score.astype(np.float64))], ["doc_id", "score"])


def keep_batches(batches: Iterator[pa.RecordBatch], net: Net, most: float) -> Iterator[pa.RecordBatch]:
    for part, score in scores_of(batches, net, "text"):
        yield part.filter(pa.array(score < most))


def scored(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id and score of every whole text: the highest of all its overlapping windows, as a probability.

    Null and empty texts get the score of no words; repeated rows score alike; only the text is an input; an empty table gives
    none. Without labelled rows of both classes every score is the share of toxic labels.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(lambda b: score_batches(b, net), "doc_id bigint, score double")


def kept(docs: DataFrame, net: Net, most: float = 0.5) -> DataFrame:
    """The documents that score below `most`, with the columns of `docs`; rows stay where they are, nothing is shuffled.

    Null and empty texts score as no words do, repeated rows alike, so they stay or go together; an empty table stays empty."""
    return docs.mapInArrow(lambda b: keep_batches(b, net, most), docs.schema)
