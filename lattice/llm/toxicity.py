"""Toxicity of texts whose words may be disguised: decode a noisy channel, then score what was meant.

A word is suspect if a digit or sign stands beside a letter in it, a letter comes three times running,
its letters stand apart (``w o r d``, ``w.o.r.d``) or it mixes them. Its lattice has, at each character,
the letters that it may stand for, with a cost for each kind of disguise: a look-alike, a dropped
separator, a dropped repetition; a separator may also be a word's bound. The Viterbi path through the whole lattice
under a character trigram model of the corpus is the word as it was meant. Original and restored words are both scored.

Scoring: word forms and word beginnings that come with the label are weighed by log odds, counted over
a bounded sample of labelled rows that are not held out; a logistic curve over the largest weight and the number
of such forms gives the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.llm.quality import labelled
from lattice.llm.shared import Task, drop_table, held_out, small_batches, table
from lattice.llm.text import ALNUM, GRAPH, LOWER, U64, blocks, mix, span_hashes, spans

# Letters that a sign may stand for.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "*": "aeiou",
}
SEPARATORS = " .-_*~"
COST_LOOK, COST_DROP, COST_REPEAT = 1.0, 0.5, 0.7  # in natural log units, beside the language model's
BEGIN = (4, 5, 6, 7, 8)  # lengths in bytes of word beginnings that are forms of their own
RUN = 3  # letters that stand apart, from so many on, are decoded as a run
COUNTED = 1 << 20  # forms that a task holds before it passes on their counts

_b = np.arange(256)
_LETTER = (_b >= 97) & (_b <= 122)
_SIGN = np.isin(_b, [ord(c) for c in LOOK_ALIKES if c not in "(<"])
_DIGIT = (_b >= 48) & (_b <= 57)
_MARK = np.isin(_b, [ord(c) for c in "!\"'(),.:;?[]{}"])
#: Classes of the character model: 0 a word's bound, 1-26 letters, 27 any other byte of a word.
_CLASS = np.where(_LETTER, _b - 96, np.where(ALNUM, 27, 0)).astype(np.int64)
N_CLASS = 28


@dataclass(frozen=True)
class CharModel:
    """Log probabilities of a class after two others, from interpolated counts."""

    log: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> CharModel:
        """counts: by (class, class, class) over the corpus."""
        c3 = counts.reshape(N_CLASS, N_CLASS, N_CLASS).astype(float)
        c2, c1 = c3.sum(0), c3.sum((0, 1))
        p1 = (c1 + 1) / (c1.sum() + N_CLASS)
        p2 = (c2 + 5 * p1) / (c2.sum(1, keepdims=True) + 5)
        p3 = (c3 + 5 * p2[None]) / (c3.sum(2, keepdims=True) + 5)
        return CharModel(np.log(p3))


def steps(ch: str) -> list[tuple[str, float]]:
    """The letters that a character may stand for, each with its cost."""
    return ([(ch, 0.0)] if ch.isalpha() else []) + [(c, COST_LOOK) for c in LOOK_ALIKES.get(ch, "")]


def restore(word: str, model: CharModel) -> str:
    """The likeliest words behind a disguised one (lower-case): the path of least cost through the whole lattice.

    A state is the last two classes and the character taken last; a step takes or drops a character, or
    ends a word at a separator. There are at most N_CLASS squared states for each character of the word's alphabet.
    """
    log = model.log
    # (class before, last class, character before) -> cost, letters as (letters before, last); chains, so that long words take linear time
    states: dict[tuple, tuple] = {(0, 0, ""): (0.0, None)}
    for ch in word:
        after: dict[tuple, tuple] = {}

        def offer(key: tuple, cost: float, letters: tuple | None) -> None:
            if key not in after or cost < after[key][0]:  # noqa: B023
                after[key] = (cost, letters)  # noqa: B023

        options = steps(ch)
        for (a, b, before), (cost, letters) in states.items():
            for c, extra in options:
                k = ord(c) - 96 if "a" <= c <= "z" else 27
                offer((b, k, ch), cost + extra - log[a, b, k], (letters, c))
            if ch in SEPARATORS or not options:
                offer((a, b, before), cost + COST_DROP, letters)
                if letters and b:
                    offer((b, 0, ch), cost - log[a, b, 0], (letters, " "))
            if letters and ch == before:
                offer((a, b, before), cost + COST_REPEAT, letters)
        states = after
    _, letters = min(((cost - (log[a, b, 0] if b else 0.0), letters) for (a, b, _), (cost, letters) in states.items()), key=lambda x: x[0])
    out = []
    while letters:
        letters, c = letters
        out.append(c)
    return "".join(reversed(out)).strip(" ")


def suspects(low: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(text, first byte, end byte) of disguised words in a lower-cased block."""
    if len(low) < 3:
        return
    starts, ends, at = spans(low, offsets, GRAPH)
    letter, sign = _LETTER[low], _SIGN[low]
    flag = np.zeros(len(low), bool)
    flag[:-1] |= sign[:-1] & letter[1:]
    flag[1:] |= sign[1:] & letter[:-1]
    flag[2:] |= letter[2:] & (low[2:] == low[1:-1]) & (low[2:] == low[:-2])
    apart = np.isin(low, [ord(c) for c in SEPARATORS if c != " "])
    flag[2:-1] |= apart[2:-1] & letter[1:-2] & letter[3:] & apart[:-3]  # a separator on either side of a single letter
    size = ends - starts
    word = np.unique(np.searchsorted(starts, np.flatnonzero(flag), side="right") - 1)
    word = word[(word >= 0) & (size[word] >= 3)] if len(word) else word
    for w in word.tolist():
        yield int(np.searchsorted(at, w, side="right")) - 1, int(starts[w]), int(ends[w])
    named = np.concatenate(([0], np.cumsum(letter | _DIGIT[low])))
    core = named[ends] - named[starts]
    plain = np.concatenate(([0], np.cumsum(_MARK[low])))
    # Letters that stand apart: one letter or digit, or a sign, with punctuation beside it at most.
    single = (size == 1) & (letter | sign)[starts] | (size <= 3) & (core == 1) & (plain[ends] - plain[starts] == size - 1) if len(starts) else np.zeros(0, bool)
    edge = np.diff(np.concatenate(([0], single.astype(np.int8), [0])))
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        for t in range(int(np.searchsorted(at, a, side="right")) - 1, int(np.searchsorted(at, b - 1, side="right"))):
            x, y = max(a, int(at[t])), min(b, int(at[t + 1]))
            if y - x >= RUN:
                yield t, int(starts[x]), int(ends[y - 1])


_SIGNS = re.escape("@$!|+(<*")


class Restorer:
    """Restores under one model, with a memo of short words; a task has its own."""

    def __init__(self, model: CharModel):
        self.model, self.memo = model, {}

    def __call__(self, data: bytes) -> tuple[bytes, bytes]:
        """The restored word or words, and the reading whose signs at the end are letters too, if there are any."""
        if data in self.memo:
            return self.memo[data]
        text = data.decode("utf-8", "replace")
        before, core, signs, after = re.fullmatch(rf"([^\w{_SIGNS}]*)(.*?)([{_SIGNS}]*)([^\w{_SIGNS}]*)", text, re.DOTALL).groups()
        plain = restore(core, self.model) if core else ""
        # Signs at the end may be letters or punctuation: both readings.
        found = (before + plain + signs + after).encode(), restore(core + signs, self.model).encode() if signs else b""
        if len(data) <= 200:
            if len(self.memo) > 50_000:
                self.memo.clear()
            self.memo[data] = found
        return found


def restore_texts(texts: list[str], model: CharModel) -> list[str]:
    """Whole texts with their disguised words restored, in lower case where they were."""
    out, restored = [], Restorer(model)
    for text in texts:
        data = (text or "").encode()
        low = LOWER[np.frombuffer(data, np.uint8)]
        parts, last = [], 0
        for _, a, b in sorted(suspects(low, np.array([0, len(low)]))):
            if a >= last:
                parts += [data[last:a], restored(low[a:b].tobytes())[0]]
                last = b
        out.append(b"".join([*parts, data[last:]]).decode("utf-8", "replace"))
    return out


def forms(buf: np.ndarray, offsets: np.ndarray, restored: Restorer, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, form) hashes of all words, restored words and their beginnings; only those in ``known`` if given."""
    low = LOWER[buf]
    own = [(low, offsets, None)]
    found = [(t, w) for t, a, b in suspects(low, offsets) for w in restored(low[a:b].tobytes()) if w]
    if found:
        data = b"".join(w for _, w in found)
        own.append((LOWER[np.frombuffer(data, np.uint8)], np.concatenate(([0], np.cumsum([len(w) for _, w in found]))), np.array([t for t, _ in found])))
    texts, hashes = [], []
    coarse = None
    if known is not None:
        coarse = np.zeros(1 << 20, bool)
        coarse[(known >> U64(44)).astype(np.int64)] = True
    for data, bounds, of in own:
        starts, ends, at = spans(data, bounds, ALNUM)
        text = np.repeat(np.arange(len(at) - 1), np.diff(at))
        text = text if of is None else of[text]
        for k in (0, *BEGIN):
            fit = ends - starts > k if k else np.ones(len(starts), bool)
            h = span_hashes(data, starts[fit], starts[fit] + k if k else ends)
            h = mix(h + U64(k)) if k else h
            t = text[fit]
            if known is not None:
                maybe = coarse[(h >> U64(44)).astype(np.int64)]
                h, t = h[maybe], t[maybe]
                at_ = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                hit = known[at_] == h if len(known) else np.zeros(len(h), bool)
                h, t = h[hit], t[hit]
            texts.append(t)
            hashes.append(h)
    return np.concatenate(texts), np.concatenate(hashes)


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(N_CLASS**3, np.int64)
    for batch in batches:
        for _, _, buf, offsets in blocks(batch):
            c = np.insert(_CLASS[LOWER[buf]], offsets, 0)  # texts are apart
            if len(c) > 2:
                counts += np.bincount(c[:-2] * N_CLASS**2 + c[1:-1] * N_CLASS + c[2:], minlength=N_CLASS**3)
    code = np.flatnonzero(counts)
    yield pa.RecordBatch.from_pydict({"code": code, "n": counts[code]})


def char_model(docs: DataFrame) -> CharModel:
    """The character model of all texts: each task counts its own, at most 28**3 sums reach the driver."""
    small_batches(docs.sparkSession)
    rows = docs.select("text").mapInArrow(Task(_trigrams), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(N_CLASS**3, np.int64)
    for code, n in rows:
        counts[code] = n
    return CharModel.of(counts)


@dataclass(frozen=True)
class Toxicity:
    """Weights of known forms (sorted hashes) and the curve (intercept, largest weight, log of their number)."""

    chars: CharModel
    known: np.ndarray
    weight: np.ndarray
    curve: tuple[float, float, float]

    def evidence(self, buf: np.ndarray, offsets: np.ndarray, restored: Restorer) -> np.ndarray:
        """Largest weight and log number of distinct known forms of each text."""
        out = np.zeros((len(offsets) - 1, 2))
        text, h = forms(buf, offsets, restored, self.known)
        at = np.searchsorted(self.known, h)
        pair = np.unique(text * max(1, len(self.known)) + at)
        text, at = pair // max(1, len(self.known)), pair % max(1, len(self.known))
        np.maximum.at(out[:, 0], text, self.weight[at] if len(self.known) else 0)
        out[:, 1] = np.log1p(np.bincount(text, minlength=len(out)))
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * evidence[:, 0] + c * evidence[:, 1], -30, 30)))


def _count(batches: Iterator[pa.RecordBatch], chars: CharModel, known: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """In how many texts each form is, by label and half: code = 2 * half + label. A form may come in several rows."""
    gathered: list[list[np.ndarray]] = [[], [], [], []]
    restored, held = Restorer(chars), 0

    def counts() -> Iterator[pa.RecordBatch]:
        for c, parts in enumerate(gathered):
            h, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, U64), return_counts=True)
            for k in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_pydict({"form": h[k : k + 100_000].view(np.int64), "code": pa.array([c] * len(h[k : k + 100_000]), pa.int32()), "n": n[k : k + 100_000]})
            parts.clear()

    for batch in batches:
        code = batch.column(1).to_numpy()
        for i, j, buf, offsets in blocks(batch):
            text, h = forms(buf, offsets, restored, known)
            order = np.lexsort((h, text))
            text, h = text[order], h[order]
            new = np.concatenate(([True], (np.diff(text) != 0) | (h[1:] != h[:-1])))[: len(h)]
            for c in range(4):
                gathered[c].append(h[new & (code[i:j][text] == c)])
            held += int(new.sum())
            if held >= COUNTED:
                yield from counts()
                held = 0
    yield from counts()


def _evidence(batches: Iterator[pa.RecordBatch], models: list[Toxicity]) -> Iterator[pa.RecordBatch]:
    restored = Restorer(models[0].chars)
    for batch in batches:
        for i, j, buf, offsets in blocks(batch):
            code = batch.column(1).to_numpy()[i:j]
            both = np.where((code >= 2)[:, None], models[0].evidence(buf, offsets, restored), models[1].evidence(buf, offsets, restored))
            yield pa.RecordBatch.from_pydict({"y": pa.array(code % 2, pa.int32()), "a": both[:, 0], "b": both[:, 1]})


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Logistic regression of the label on evidence by Newton's method; the intercept alone if there is one class.

    More evidence never lowers the score: a slope that comes out below 0 is left out and the rest fitted again.
    """
    if not len(y):
        return (0.0, 0.0, 0.0)
    if y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return (float(np.log(share / (1 - share))), 0.0, 0.0)
    used = [0, 1]
    while True:
        a = np.column_stack((np.ones(len(x)), x[:, used]))
        w = np.zeros(a.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
        if (w[1:] >= 0).all():
            break
        used.pop(int(np.argmin(w[1:])))
    slope = dict(zip(used, w[1:], strict=True))
    return float(w[0]), float(slope.get(0, 0.0)), float(slope.get(1, 0.0))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, support: int = 4, odds: float = 3.0) -> Toxicity:
    """Fits on at most ``max_rows`` labels. Forms need ``support`` texts with the label and a log odds ratio of ``odds``.

    Weights are counted on either half of the sample and the curve is fitted to the other half's texts, so
    it sees evidence as strong as new texts give; the weights that count are those of both halves.
    """
    spark = docs.sparkSession
    small_batches(spark)
    chars = char_model(docs)
    code = (F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(2)) * 2 + F.col("y")).cast("int").alias("code")
    sample = table(labelled(docs, labels, "toxic", max_rows).select("text", code), "toxic-sample")
    spark_counts = "form long, code int, n long"
    pos = sample.where("code % 2 = 1").mapInArrow(Task(_count, chars=chars, known=None), spark_counts)
    pos = pos.groupBy("form").agg(*(F.sum(F.when(F.col("code") == c, F.col("n")).otherwise(0)).alias(f"p{c}") for c in (1, 3))).where(f"p1 + p3 >= {support}").toPandas()
    pos = pos.assign(form=pos["form"].to_numpy().view(U64) if len(pos) else np.zeros(0, U64)).sort_values("form")
    known = pos["form"].to_numpy(U64)
    neg = sample.where("code % 2 = 0").mapInArrow(Task(_count, chars=chars, known=known), spark_counts).groupBy("form", "code").agg(F.sum("n").alias("n")).toPandas()
    n = {c: pos[f"p{c}"].to_numpy(float) for c in (1, 3)} | {c: np.zeros(len(known)) for c in (0, 2)}
    for c in (0, 2):
        own = neg[neg["code"] == c]
        n[c][np.searchsorted(known, own["form"].to_numpy().view(U64))] = own["n"].to_numpy()
    total = dict(sample.groupBy("code").count().collect())

    def weighed(codes: tuple[int, ...], need: float) -> Toxicity:
        p, q = (sum(n[c] for c in codes if c % 2 == y) for y in (1, 0))
        tp, tq = (sum(total.get(c, 0) for c in codes if c % 2 == y) for y in (1, 0))
        w = np.log((p + 0.5) / (tp + 1)) - np.log((q + 0.5) / (tq + 1))
        keep = (p >= need) & (w >= odds)
        return Toxicity(chars, known[keep], w[keep], (0.0, 0.0, 0.0))

    halves = [weighed((0, 1), support / 2), weighed((2, 3), support / 2)]
    rows = sample.mapInArrow(Task(_evidence, models=halves), "y int, a double, b double").toPandas().sort_values(["y", "a", "b"])
    drop_table(sample)
    whole = weighed((0, 1, 2, 3), support)
    return Toxicity(chars, whole.known, whole.weight, fit_curve(rows[["a", "b"]].to_numpy(float), rows["y"].to_numpy(float)))


def _score(batches: Iterator[pa.RecordBatch], shared, threshold: float, clean: bool) -> Iterator[pa.RecordBatch]:
    """Batches of (text, more) with score and prediction, or those below the threshold as they are."""
    model: Toxicity = shared.value
    restored = Restorer(model.chars)
    for batch in batches:
        for i, j, buf, offsets in blocks(batch):
            score = model.score(model.evidence(buf, offsets, restored))
            own = batch.slice(i, j - i)
            if clean:
                yield own.filter(pa.array(score < threshold))
            else:
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*own.schema.names, "score", "predicted"])


def _run(docs: DataFrame, model: Toxicity, threshold: float, clean: bool) -> tuple[DataFrame, dict[str, str]]:
    """The rows under names of our own, and those names by the columns' names."""
    spark = docs.sparkSession
    small_batches(spark)
    more = [f for f in docs.schema.fields if f.name != "text"]
    names = {"text": "text"} | {f.name: f"_{k}" for k, f in enumerate(more)}
    own = docs.select("text", *(F.col(f"`{f.name}`").alias(names[f.name]) for f in more))
    kinds = "text string" + "".join(f", {names[f.name]} {f.dataType.simpleString()}" for f in more) + ("" if clean else ", score double, predicted int")
    return own.mapInArrow(Task(_score, shared=spark.sparkContext.broadcast(model), threshold=threshold, clean=clean), kinds), names


def scored(docs: DataFrame, model: Toxicity, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, with _score and _predicted; own columns of these names give way. Null and empty texts score as texts without evidence."""
    found, names = _run(docs, model, threshold, False)
    kept = [n for n in docs.columns if n not in ("_score", "_predicted")]
    return found.select(*(F.col(names[n]).alias(n) for n in kept), F.col("score").alias("_score"), F.col("predicted").alias("_predicted"))


def keep_clean(docs: DataFrame, model: Toxicity, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below the threshold; null and empty texts are scored as texts without evidence."""
    found, names = _run(docs, model, threshold, True)
    return found.select(*(F.col(names[n]).alias(n) for n in docs.columns))


def score(docs: DataFrame, model: Toxicity, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; rows with the same or a null doc_id stay apart."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), "text")
    found = scored(own, model, threshold)
    return found.select("doc_id", "held_out", F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))
