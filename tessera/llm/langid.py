"""Language ID by a linear-chain conditional random field over words.

Words are runs of letters (A-Z, a-z and every non-ASCII byte of UTF-8), with A-Z and the capitals of Latin-1 in lower case. A word's features
are its prefixes and suffixes of one to three bytes, its byte bigrams and trigrams, and itself (the lexicon), each hashed to a row of
weights. Chains are runs of up to CHAIN words of a document; transitions are learned. Training follows the gradient of the conditional
likelihood (expected less observed counts, by forward-backward) on a bounded sample: of each language the SAMPLE documents with the least
hash of doc_id, and of each at most SAMPLE_WORDS words; a part of the chains is spliced from two languages, so that the transitions know
code-switched text. Each word of every whole text gets its marginals by forward-backward; a document's language is the one with the greatest mean
marginal, which is the score.

Null text or text without a letter: `und`, score 0. No usable label anywhere: `und`, score 0. A null doc_id is not held out and not learned
from. Repeated rows get equal results; extra columns do not take part; an empty table gives no rows. lang, source and doc_id are no
input of a prediction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common

SAMPLE, SAMPLE_WORDS, CHAIN, TABLE = 120, 400, 48, 1 << 16
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lowered(buf: np.ndarray) -> np.ndarray:
    out = LOWER[buf]
    after_c3 = np.flatnonzero(buf[:-1] == 0xC3) + 1
    capital = after_c3[(buf[after_c3] >= 0x80) & (buf[after_c3] <= 0x9E) & (buf[after_c3] != 0x97)]
    out[capital] += 32
    return out


def letter_runs(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word."""
    n = len(buf)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    inside = LETTER[buf]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offs[:-1][offs[:-1] < n]] = False
    last = offs[1:] - 1
    after[last[last >= 0]] = False
    start = np.flatnonzero(inside & ~before)
    return start, np.flatnonzero(inside & ~after) + 1, np.searchsorted(offs, start, "right") - 1


def affixes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rows of the weights of each word's prefixes, suffixes and of the word itself: 7 a word, -1 where it is too short."""
    values = common.BYTE[buf]
    out = np.full((len(start), 7), -1, np.int64)
    for k in (1, 2, 3):
        ok = end - start >= k
        for col, s in ((k - 1, start), (k + 2, end - k)):
            h = common.runs_hash(values, s[ok], s[ok] + k)
            out[ok, col] = (common.mix(h + np.uint64(col)) % np.uint64(TABLE)).astype(np.int64)
    out[:, 6] = (common.mix(common.runs_hash(values, start, end) + np.uint64(99)) % np.uint64(TABLE)).astype(np.int64)
    return out


def grams(buf: np.ndarray, k: int) -> np.ndarray:
    return (common.mix(common.grams_hash(common.BYTE[buf], k) + np.uint64(k * 1001)) % np.uint64(TABLE)).astype(np.int64)


def emissions(buf: np.ndarray, start: np.ndarray, end: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of the weights of each word's features."""
    rows = affixes(buf, start, end)
    padded = np.vstack([weights, np.zeros((1, weights.shape[1]), weights.dtype)])
    out = np.zeros((len(start), weights.shape[1]))
    for c in range(rows.shape[1]):
        out += padded[rows[:, c]]
    for k in (2, 3):
        g = grams(buf, k)
        total = np.zeros((len(buf) + 1, weights.shape[1]))
        np.cumsum(weights[g], axis=0, out=total[1 : len(g) + 1], dtype=float)
        has = end - start >= k
        out[has] += total[end[has] - k + 1] - total[start[has]]
    return out


def chains(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end word of the chains: up to CHAIN consecutive words of one row."""
    n = len(row)
    head = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if n else np.zeros(0, np.int64)
    size = np.diff(np.r_[head, n])
    parts = -(-size // CHAIN)
    at = np.repeat(np.arange(len(head)), parts)
    k = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
    first = head[at] + k * CHAIN
    return first, np.minimum(first + CHAIN, head[at] + size[at])


def forward_backward(score: np.ndarray, mask: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals (chains, words, labels), expected transitions and the log partition sum, of padded chains."""
    n, t, k = score.shape
    top = score.max(axis=2, keepdims=True)
    e, a_ = np.exp(score - top), np.exp(trans)
    alpha, norm = np.zeros((n, t, k)), np.ones((n, t))
    alpha[:, 0] = e[:, 0]
    for i in range(t):
        if i:
            alpha[:, i] = (alpha[:, i - 1] @ a_) * e[:, i]
        norm[:, i] = alpha[:, i].sum(axis=1)
        alpha[:, i] /= norm[:, i, None]
    beta = np.ones((n, t, k))
    pair = np.zeros((k, k))
    for i in range(t - 2, -1, -1):
        on = mask[:, i + 1]
        down = e[:, i + 1] * beta[:, i + 1] / norm[:, i + 1, None]
        pair += (alpha[on, i].T @ down[on]) * a_
        beta[:, i] = np.where(on[:, None], down @ a_.T, 1.0)
    logz = float(((np.log(norm) + top[:, :, 0]) * mask).sum())
    return alpha * beta, pair, logz


def pad(first: np.ndarray, end: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = int((end - first).max(initial=1))
    at = first[:, None] + np.arange(t)[None, :]
    mask = at < end[:, None]
    at = np.where(mask, at, first[:, None])
    return values[at], mask, at


class Model:
    def __init__(self, labels: list[str], weights: np.ndarray, trans: np.ndarray) -> None:
        self.labels, self.weights, self.trans = labels, weights, trans

    def marginals(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of each word and its marginals."""
        buf = lowered(buf)
        start, end, row = letter_runs(buf, offs)
        out = np.zeros((len(start), len(self.labels)))
        if len(start):
            em = emissions(buf, start, end, self.weights)
            first, last = chains(row)
            for a in range(0, len(first), 2048):
                f, z = first[a : a + 2048], last[a : a + 2048]
                score, mask, at = pad(f, z, em)
                p = forward_backward(score, mask, self.trans)[0]
                out[at[mask]] = p[mask]
        return start, end, row, out

    def label_words(self, text: str) -> list[tuple[str, str, float]]:
        """Each word of a text with its language and that one's marginal."""
        raw = text.encode()
        buf = np.frombuffer(raw, np.uint8)
        start, end, _, p = self.marginals(buf, np.array([0, len(buf)]))
        best = p.argmax(axis=1)
        return [(raw[s:e].decode("utf-8", "replace"), self.labels[b], float(p[i, b])) for i, (s, e, b) in enumerate(zip(start, end, best, strict=True))]


def fit(texts: list[str], langs: list[str], epochs: int = 4, rate: float = 0.25, seed: int = 3) -> Model:
    """The model of (text, language) pairs by minibatch gradient steps scaled per weight (Adagrad)."""
    labels = sorted(set(langs))
    k, rng = len(labels), np.random.default_rng(seed)
    weights, trans = np.zeros((TABLE, k)), np.zeros((k, k))
    raws = [t.encode() for t in texts]
    offs = np.cumsum([0, *(len(r) for r in raws)])
    buf = lowered(np.frombuffer(b"".join(raws), np.uint8))
    start, end, row = letter_runs(buf, offs)
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    keep = nth < SAMPLE_WORDS
    start, end, row = start[keep], end[keep], row[keep]
    if not len(start) or k < 2:
        return Model(labels, weights, trans)
    gold = np.array([labels.index(x) for x in langs])[row]
    feats = affixes(buf, start, end)
    g2, g3 = grams(buf, 2), grams(buf, 3)
    first, last = chains(row)
    square, square_t = np.full(TABLE * k, 1e-6), np.full((k, k), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(first))
        for lo in range(0, len(order), 64):
            pick = order[lo : lo + 64]
            words = [np.arange(first[c], last[c]) for c in pick]
            for i in range(0, len(words) - 1, 4):  # every fourth chain is spliced with its neighbour: code-switched
                a, b = words[i], words[i + 1]
                ca, cb = int(rng.integers(1, len(a) + 1)), int(rng.integers(0, len(b)))
                words[i] = np.r_[a[:ca], b[cb:]][: 2 * CHAIN]
            flat = np.concatenate(words)
            cuts = np.cumsum([0, *(len(w) for w in words)])
            em = np.zeros((len(flat), k))
            ids, who = [], []
            for c in range(7):
                ok = feats[flat, c] >= 0
                ids.append(feats[flat[ok], c])
                who.append(np.flatnonzero(ok))
            for size, g in ((2, g2), (3, g3)):
                n = np.maximum(0, end[flat] - start[flat] - size + 1)
                w = np.repeat(np.arange(len(flat)), n)
                ids.append(g[start[flat][w] + np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)])
                who.append(w)
            ids, who = np.concatenate(ids), np.concatenate(who)
            for c in range(k):
                em[:, c] = np.bincount(who, weights=weights[ids, c], minlength=len(flat))
            score, mask, at = pad(cuts[:-1], cuts[1:], em)
            p, pair, _ = forward_backward(score, mask, trans)
            delta = np.zeros((len(flat), k))
            delta[at[mask]] = p[mask]
            delta[np.arange(len(flat)), gold[flat]] -= 1
            seen = np.zeros((k, k))
            for w in words:
                np.add.at(seen, (gold[w[:-1]], gold[w[1:]]), 1)
            uniq, inv = np.unique(ids, return_inverse=True)
            grad = np.stack([np.bincount(inv, weights=delta[who, c], minlength=len(uniq)) for c in range(k)], axis=1) / len(words) + 1e-5 * weights[uniq]
            cell = uniq[:, None] * k + np.arange(k)[None, :]
            square[cell] += grad**2
            weights[uniq] -= rate * grad / np.sqrt(square[cell])
            gt = (pair - seen) / len(words) + 1e-3 * trans
            square_t += gt**2
            trans -= 0.2 * rate * gt / np.sqrt(square_t)
    return Model(labels, weights.astype(np.float32), trans)


def held_out() -> "F.Column":
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the `sample` documents of each language with the least hash of doc_id that are not held out."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = usable.select("doc_id", "lang").withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample).select("doc_id", "lang").distinct()
    rows = usable.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text")).collect()
    rows = sorted(rows, key=lambda r: (r.lang, r.doc_id))
    return fit([r.text for r in rows], [r.lang for r in rows])


def predict(docs: DataFrame, model: Model, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep`, and the language and its score under `names`, of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)

    def run(batches):
        m = shared.value
        for b in batches:
            n = b.num_rows
            lang, score = np.full(n, -1), np.zeros(n)
            texts = b.column(len(keep))
            for lo, hi, buf, offs in common.text_slices(texts):
                if not m.labels:
                    break
                _, _, row, p = m.marginals(buf, offs)
                if not len(row):
                    continue
                total = np.stack([np.bincount(row, weights=p[:, c], minlength=hi - lo) for c in range(p.shape[1])], axis=1)
                words = np.bincount(row, minlength=hi - lo)
                ascii_ = np.bincount(np.searchsorted(offs, np.flatnonzero(LETTER[:128][np.minimum(buf, 127)] & (buf < 128)), "right") - 1, minlength=hi - lo)
                for i in np.flatnonzero((words > 0) & (ascii_ == 0)):  # only non-ASCII bytes: signs are no letters
                    if not any(c.isalpha() for c in texts[lo + int(i)].as_py()):
                        words[i] = 0
                ok = np.flatnonzero(words)
                best = total[ok].argmax(axis=1)
                lang[lo + ok] = best
                score[lo + ok] = np.clip(total[ok, best] / words[ok], 0, 1)
            found = [m.labels[x] if x >= 0 else "und" for x in lang]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(found, pa.string()), pa.array(score)], names=[*keep, *names])

    schema = "".join(f"`{c}` {kinds[c]}, " for c in keep) + f"{names[0]} string, {names[1]} double"
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    common.tune(docs.sparkSession)
    out = predict(docs, train(docs), ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def accept(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents with a language: those of no letter, or of a score below `least`, go. Rows and columns are otherwise unchanged."""
    common.tune(docs.sparkSession)
    out = predict(docs, train(docs), docs.columns, ("_lang", "_score"))
    return out.where((F.col("_lang") != "und") & (F.col("_score") >= least)).select(*docs.columns)


def op9_language(spark, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return identify(common.table(spark, sf_dir, "documents"))
