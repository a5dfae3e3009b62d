"""Language of a text by a small bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of one word at a time, from both ends, and gives every position a distribution over
the languages; a text's distribution is the mean over all its positions. Words are the segments: the states start anew
at white space, so a position's label depends on its word alone, equal words are run once per batch, and memory does not
grow with a text. Runs of more than ``SEGMENT`` bytes are cut into segments. A-Z are lower-cased first.

Training is plain numpy: cross-entropy at every position, backpropagated through time, with Adam. It uses a bounded
sample of labelled texts (``PER_LANG`` rows a language, the lowest hashes; of each, at most ``WORDS`` segments);
nothing else is bounded. Language values are those seen with a label, in order.

Null text, or text without a letter (a character for which ``str.isalpha`` holds), is ``und`` with score 0. If no
row can be learned from, all are ``und``. Repeated rows get equal labels. Other columns are kept by ``label``.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
SEGMENT = 32       # bytes
HIDDEN = 16
EMBED = 12
PER_LANG = 300     # labelled texts of a language to learn from
WORDS = 80         # segments of a text to learn from
EPOCHS = 2
BATCH = 256
SEED = 11
MEMO = 100_000     # words remembered by a task
SLICE = 128        # texts whose words are counted at a time


def segments(text: str) -> list[bytes]:
    """Words of a text as bytes, long ones cut; every byte that is not white space is in one of them."""
    out = []
    for word in text.encode("utf-8", "surrogatepass").lower().split():
        out += [word] if len(word) <= SEGMENT else [word[i:i + SEGMENT] for i in range(0, len(word), SEGMENT)]
    return out


def _pad(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids (256: no byte) and lengths."""
    lengths = np.array([len(w) for w in words], np.int64)
    ids = np.full((len(words), int(lengths.max())), 256, np.int64)
    ids[np.arange(ids.shape[1]) < lengths[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    return ids, lengths


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Two gated recurrent layers side by side (left to right, right to left) and a softmax on both states."""

    def __init__(self, n_out: int, seed: int = SEED):
        rng = np.random.default_rng(seed)

        def init(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.w = {"e": init(257, EMBED) * 4}
        for d in "fb":
            self.w |= {f"x{d}": init(EMBED, 3 * HIDDEN), f"h{d}": init(HIDDEN, 2 * HIDDEN), f"c{d}": init(HIDDEN, HIDDEN),
                       f"i{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.w |= {"o": init(2 * HIDDEN, n_out), "ob": np.zeros(n_out, np.float32)}

    def _run(self, d: str, ids: np.ndarray, inside: np.ndarray, keep: bool):
        w, (n, steps) = self.w, ids.shape
        table = w["e"] @ w[f"x{d}"] + w[f"i{d}"]
        h, states, tape = np.zeros((n, HIDDEN), np.float32), np.zeros((n, steps, HIDDEN), np.float32), []
        for t in (range(steps) if d == "f" else range(steps - 1, -1, -1)):
            a = table[ids[:, t]]
            gates = _sigmoid(a[:, :2 * HIDDEN] + h @ w[f"h{d}"])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            rh = r * h
            c = np.tanh(a[:, 2 * HIDDEN:] + rh @ w[f"c{d}"])
            on = inside[:, t, None]
            new = np.where(on, h + z * (c - h), h)
            if keep:
                tape.append((t, h, z, r, rh, c, on))
            h = states[:, t] = new
        return states, tape

    def forward(self, ids: np.ndarray, lengths: np.ndarray, keep: bool = False):
        inside = np.arange(ids.shape[1]) < lengths[:, None]
        (f, tape_f), (b, tape_b) = self._run("f", ids, inside, keep), self._run("b", ids, inside, keep)
        both = np.concatenate((f, b), 2)
        logits = both @ self.w["o"] + self.w["ob"]
        p = np.exp(logits - logits.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        return p, inside, both, tape_f, tape_b

    def gradients(self, ids: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
        """Mean loss over positions, and its gradient by backpropagation through time."""
        w = self.w
        p, inside, both, tape_f, tape_b = self.forward(ids, lengths, True)
        n = inside.sum()
        rows = np.arange(len(ids))[:, None]
        at = np.arange(ids.shape[1])[None, :]
        loss = -(np.log(p[rows, at, labels[:, None]] + 1e-9) * inside).sum() / n
        dl = p.copy()
        dl[rows, at, labels[:, None]] -= 1
        dl *= inside[:, :, None] / n
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["o"] = both.reshape(-1, 2 * HIDDEN).T @ dl.reshape(-1, dl.shape[2])
        g["ob"] = dl.sum((0, 1))
        dboth = dl @ w["o"].T
        for d, tape, ds in (("f", tape_f, dboth[:, :, :HIDDEN]), ("b", tape_b, dboth[:, :, HIDDEN:])):
            table = np.zeros((257, 3 * HIDDEN), np.float32)
            dh = np.zeros((len(ids), HIDDEN), np.float32)
            for t, h, z, r, rh, c, on in reversed(tape):
                dnew = (ds[:, t] + dh)
                act = np.where(on, dnew, 0)
                dz = act * (c - h) * z * (1 - z)
                dc = act * z * (1 - c * c)
                drh = dc @ w[f"c{d}"].T
                dr = drh * h * r * (1 - r)
                dg = np.concatenate((dz, dr), 1)
                g[f"h{d}"] += h.T @ dg
                g[f"c{d}"] += rh.T @ dc
                np.add.at(table, ids[:, t], np.concatenate((dg, dc), 1))
                dh = np.where(on, 0, dnew) + act * (1 - z) + drh * r + dg @ w[f"h{d}"].T
            g[f"i{d}"] = table.sum(0)
            g[f"x{d}"] = w["e"].T @ table
            g["e"] += table @ w[f"x{d}"].T
        return float(loss), g

    def train(self, words: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = SEED) -> None:
        rng, m, v, step = np.random.default_rng(seed), {}, {}, 0
        total = epochs * (-(-len(words) // BATCH))
        for _ in range(epochs):
            order = rng.permutation(len(words))
            for k in range(0, len(order), BATCH):
                at = order[k:k + BATCH]
                ids, lengths = _pad([words[i] for i in at])
                _, g = self.gradients(ids, lengths, labels[at])
                step += 1
                now = rate * (1 - 0.9 * step / total)
                for name, grad in g.items():
                    m[name] = 0.9 * m.get(name, 0) + 0.1 * grad
                    v[name] = 0.999 * v.get(name, 0) + 0.001 * grad * grad
                    self.w[name] -= (now * (m[name] / (1 - 0.9 ** step)) / (np.sqrt(v[name] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)

    def pool_words(self, words: list[bytes]) -> np.ndarray:
        """For each word the sum of its positions' distributions."""
        out = np.zeros((len(words), len(self.w["ob"])), np.float64)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for k in range(0, len(order), 2048):
            at = order[k:k + 2048]
            ids, lengths = _pad([words[i] for i in at])
            p, inside = self.forward(ids, lengths)[:2]
            out[at] = (p * inside[:, :, None]).sum(1)
        return out


def sample(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """lang, draw and the first ``WORDS`` segments of the ``per_lang`` labelled texts of each language with the lowest hashes (all if
    there are fewer), copies once.

    Hash cutoffs come from counts of different texts, for which hashes move and no text, so no language is sorted in one task; a
    cutoff lets about half as many more through, and the collector drops those. Texts are cut into segments in the tasks.
    """
    labelled = docs.where("lang is not null and text is not null").select("text", "lang", F.xxhash64("text").alias("draw"))
    counts = labelled.select("lang", "draw").distinct().groupBy("lang").count().collect()      # the network has an output for each
    schema = "lang string, draw long, words array<binary>"
    if not counts:
        return docs.sparkSession.createDataFrame([], schema)
    cut = F.create_map(*(x for r in counts for x in (F.lit(r["lang"]), F.lit(int(min(1.0, (1.5 * per_lang + 20) / r["count"]) * (1 << 30))))))
    drawn = labelled.where(F.pmod("draw", F.lit(1 << 30)) <= cut[F.col("lang")])

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()      # no more than are drawn
        for batch in batches:
            rows = []
            for text, lang, draw in zip(batch.text, batch.lang, batch.draw, strict=True):
                if (lang, draw) not in seen:
                    seen.add((lang, draw))
                    rows.append((lang, draw, segments(text)[:WORDS]))
            yield pd.DataFrame(rows, columns=["lang", "draw", "words"])

    return drawn.mapInPandas(cut_up, schema).dropDuplicates(["lang", "draw"])


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> tuple[list[str], Network | None]:
    """Languages and a network learned from the labelled rows of ``docs`` (text, lang)."""
    drawn = sample(docs, per_lang).toPandas()
    if drawn.empty:
        return [], None
    drawn["place"] = drawn.draw % (1 << 30)
    drawn = drawn.sort_values(["lang", "place", "draw"]).groupby("lang").head(per_lang)
    langs = sorted(drawn.lang.unique())
    words, labels = [], []
    for found, lang in zip(drawn.words, drawn.lang, strict=True):
        own = [bytes(w) for w in found]
        words += own
        labels += [langs.index(lang)] * len(own)
    if not words:
        return [], None
    network = Network(len(langs))
    if len(langs) > 1:
        network.train(words, np.array(labels))
    return langs, network


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def label(docs: DataFrame, langs: list[str], network: Network | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added; every byte of every text that is not white space is read."""
    shared = docs.sparkSession.sparkContext.broadcast(network)     # a few thousand numbers
    names = np.array(langs)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        net, memo, sums = shared.value, {}, np.zeros((0, len(langs)))     # a word's place, and the sums at the places
        for texts in batches:
            pred, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            if net is not None:
                for a in range(0, len(texts), SLICE):
                    counts = [Counter(segments(t)) if t and has_letter(t) else Counter() for t in texts[a:a + SLICE]]
                    if len(memo) > MEMO:
                        memo.clear()
                        sums = sums[:0]
                    new = list(set().union(*counts) - memo.keys())
                    memo.update(zip(new, range(len(memo), len(memo) + len(new)), strict=True))
                    sums = np.concatenate((sums, net.pool_words(new)))
                    for i, c in enumerate(counts, a):
                        if c:
                            mean = np.fromiter(c.values(), np.float64, len(c)) @ sums[np.fromiter(map(memo.__getitem__, c), np.int64, len(c))]
                            mean /= mean.sum()
                            best = int(mean.argmax())
                            pred[i], score[i] = names[best], min(1.0, float(mean[best]))
            yield pd.DataFrame({"lang_pred": pred, "score": score})

    predict = predict.asNondeterministic()      # else a filter on its result is pushed below it, with a second run of the network
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "_found")]
    return docs.select(*kept, predict("text").alias("_found")).select(*kept, "_found.lang_pred", "_found.score")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def report(docs: DataFrame) -> DataFrame:
    """Learns from rows that are not held out, predicts all."""
    docs = docs.select("doc_id", "text", "lang", (fold(F.col("doc_id")) == 1).alias("held_out"))
    langs, network = fit(docs.where("not held_out").select("text", "lang"))
    return label(docs.select("doc_id", "held_out", "text"), langs, network).select("doc_id", "held_out", "lang_pred", "score")


def known(docs: DataFrame) -> DataFrame:
    """``docs`` without texts that have no language (null, or no letter); a missing ``lang`` is filled with what the network finds.

    If nothing could be learned, ``lang`` stays as it is and the texts with a letter stay all the same.
    """
    langs, network = fit(docs.select("text", "lang"))
    if network is None:
        @F.pandas_udf("boolean")
        def lettered(texts: pd.Series) -> pd.Series:
            return pd.Series([bool(t) and has_letter(t) for t in texts], dtype=bool)

        return docs.where(lettered("text"))
    # columns by place, so that no name of theirs clashes with what is added
    placed = docs.select(*(F.col(c).alias("text" if c == "text" else f"_{i}") for i, c in enumerate(docs.columns)))
    found = label(placed, langs, network).where(F.col("lang_pred") != UNKNOWN)
    kept = ["text" if c == "text" else f"_{i}" for i, c in enumerate(docs.columns)]
    return found.select(*((F.coalesce(F.col(at), "lang_pred") if c == "lang" else F.col(at)).alias(c) for at, c in zip(kept, docs.columns, strict=True)))
