"""Quality rules: weak supervision instead of an all-must-pass filter.

Each rule looks at a few counts of a text and votes good, bad or abstains; several rules look at the same
kind of fault from different sides. The vote patterns of all documents are counted (at most 3**rules patterns,
whatever the corpus), expectation-maximisation over those counts estimates how often each rule votes good,
votes bad and abstains on good texts and on bad ones (so abstentions tell as much as they differ between the two),
and the posterior probability of good decides. A bad vote that no other rule supports weighs as much as its
rule is found to be reliable: it can be outvoted, and texts without any bad vote can be rejected.

Null, empty and blank texts count as no words; rows are judged one by one, so repeated rows get equal results; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written
from . import text as tx

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper_words", "n_marked_words", "n_plain_words", "n_bars", "n_bangs", "n_ended_lines", "n_distinct")
RULES = ("symbols", "density", "plain", "bars", "capitals", "bangs", "sentences", "repetition", "lines", "variety", "word_length")

_symbol = np.zeros(256, bool)
_symbol[[ord(c) for c in "#*$%&|<>"]] = True
_bar, _bang, _newline = ord("|"), ord("!"), 10
_upper = np.zeros(256, bool)
_upper[0x41:0x5B] = True
_low = np.zeros(256, bool)
_low[0x61:0x7B] = True
_letter = tx.ALNUM_WORDS.copy()
_letter[0x30:0x3A] = False
_end = np.zeros(256, bool)
_end[[ord(c) for c in ".!?:;\"')"]] = True


def counts(t: tx.Texts) -> dict[str, np.ndarray]:
    """The counts of each text of a slice."""
    starts, ends, offset = t.words(tx.SPACE_WORDS)
    n_words = np.diff(offset)
    owner = np.repeat(np.arange(t.n), n_words)
    data = t.data
    point = ((data & 0xC0) != 0x80) & tx.SPACE_WORDS[data]
    words = t.hashes(starts, ends, tx.BYTES)

    hashed, at = tx.windows(words, offset, 3)
    again, _ = tx.repeats(hashed, owner[at])
    cover = np.zeros(len(words) + 1, np.int32)
    for j in range(3):
        cover[at[again] + j] = 1
    seen = np.concatenate(([0], np.cumsum(cover[: len(words)])))

    breaks = np.flatnonzero(data == _newline)
    left = np.concatenate((t.start[:-1], breaks + 1))
    right = np.concatenate((breaks, t.start[1:]))
    left.sort()
    right.sort()
    line_owner = np.minimum(np.searchsorted(t.start, left, "right") - 1, t.n - 1)
    first, last = np.searchsorted(starts, left), np.searchsorted(starts, right)
    filled = last > first
    left, right, line_owner, last = left[filled], right[filled], line_owner[filled], last[filled]
    line_owner = owner[last - 1]
    _, dup = tx.repeats(t.hashes(left, right, tx.BYTES), line_owner)
    ended = _end[data[ends[last - 1] - 1]]

    def per_word(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[ends] - total[starts]

    def by(groups: np.ndarray) -> np.ndarray:
        return np.bincount(groups, minlength=t.n).astype(np.int64)

    upper, low, marks = per_word(_upper[data]), per_word(_low[data]), per_word(_symbol[data])
    _, old = tx.repeats(words, owner)
    return {
        "n_words": n_words.astype(np.int64),
        "word_chars": t.per_text(point),
        "n_symbols": t.per_text(_symbol[data]),
        "n_dup_lines": by(line_owner[dup]),
        "n_repeat_words": seen[offset[1:]] - seen[offset[:-1]],
        "n_lines": by(line_owner),
        "n_upper_words": by(owner[(upper >= 2) & (low == 0)]),
        "n_marked_words": by(owner[marks > 0]),
        "n_plain_words": by(owner[per_word(_letter[data]) >= ends - starts - 1]),
        "n_bars": t.per_text(data == _bar),
        "n_bangs": t.per_text(data == _bang),
        "n_ended_lines": by(line_owner[ended]),
        "n_distinct": n_words - by(owner[old]),
    }


def votes(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Per rule 1 (good), -1 (bad) or 0 (abstains)."""
    n = np.maximum(c["n_words"], 1)
    lines = np.maximum(c["n_lines"], 1)

    def vote(value: np.ndarray, good, bad) -> np.ndarray:
        return np.where(bad(value), -1, np.where(good(value), 1, 0)).astype(np.int8)

    return {
        "symbols": vote(c["n_marked_words"] / n, lambda x: x < 0.03, lambda x: x > 0.10),
        "density": vote(c["n_symbols"] / np.maximum(c["word_chars"], 1), lambda x: x < 0.005, lambda x: x > 0.02),
        "plain": vote(c["n_plain_words"] / n, lambda x: x > 0.90, lambda x: x < 0.75),
        "bars": vote(c["n_bars"] / n, lambda x: x < 0.01, lambda x: x > 0.05),
        "capitals": vote(c["n_upper_words"] / n, lambda x: x < 0.10, lambda x: x > 0.40),
        "bangs": vote(c["n_bangs"] / n, lambda x: x < 0.02, lambda x: x > 0.15),
        "sentences": vote(c["n_ended_lines"] / lines, lambda x: x > 0.65, lambda x: x < 0.5),
        "repetition": vote(c["n_repeat_words"] / n, lambda x: x < 0.08, lambda x: x > 0.25),
        "lines": np.where(c["n_lines"] < 4, 0, vote(c["n_dup_lines"] / lines, lambda x: x < 0.10, lambda x: x > 0.15)),
        "variety": vote(c["n_distinct"] / np.sqrt(n), lambda x: x > 5, lambda x: x < 4.5),
        "word_length": vote(c["word_chars"] / n, lambda x: (x > 3) & (x < 9), lambda x: (x < 2) | (x > 14)),
    }


def patterns(c: dict[str, np.ndarray]) -> np.ndarray:
    """The votes on each text as one base-3 number."""
    v = votes(c)
    return sum((v[r].astype(np.int32) + 1) * 3**k for k, r in enumerate(RULES))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the counts of COUNTS and the votes as one base-3 number ``pattern``."""
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS) + ", pattern int"

    def of(batch: pa.RecordBatch):
        for t in tx.slices(batch.column(1)):
            c = counts(t)
            code = patterns(c)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(t.first, t.n), *(pa.array(c[k]) for k in COUNTS), pa.array(code.astype(np.int32))],
                names=[id_col, *COUNTS, "pattern"],
            )

    return tx.mapped(docs.select(F.col(id_col), F.col(text_col)), of, schema)


#: What is taken as seen of each rule before any text is: bad votes, abstentions and good votes, on good texts and on bad ones.
SEEN_IF_GOOD, SEEN_IF_BAD = (0.5, 1.0, 8.5), (3.5, 2.0, 4.5)
SEEN_TEXTS = (4.0, 1.0)  # good and bad texts


def fitted(pattern: np.ndarray, count: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, dict]:
    """Posterior probability of good for each pattern, and the estimated accuracies.

    Rules are independent given whether a text is good. A text is at first as likely bad as its votes say, a bad
    vote counting four times a good one. The priors are those of ten texts a rule, so that they fade as texts come.
    """
    k = len(RULES)
    v = (pattern[:, None] // 3 ** np.arange(k)) % 3  # 0 bad, 1 abstains, 2 good
    one_hot = np.stack([v == o for o in range(3)], 2).astype(float)
    w = count.astype(float)
    against, speaking_for = (v == 0).sum(1), (v == 2).sum(1)
    bad = np.clip((against + 0.1) / (against + speaking_for / 4 + 1), 0.02, 0.98)
    share = 0.5
    if_good = if_bad = np.full((k, 3), 1 / 3)
    for _ in range(rounds):
        old = bad
        if_good = np.einsum("p,pko->ko", w * (1 - bad), one_hot) + SEEN_IF_GOOD
        if_bad = np.einsum("p,pko->ko", w * bad, one_hot) + SEEN_IF_BAD
        if_good, if_bad = (x / x.sum(1, keepdims=True) for x in (if_good, if_bad))
        share = (w @ bad + SEEN_TEXTS[1]) / (w.sum() + sum(SEEN_TEXTS))
        ratio = np.log(share / (1 - share)) + np.einsum("pko,ko->p", one_hot, np.log(if_bad / if_good))
        bad = 1 / (1 + np.exp(-np.clip(ratio, -500, 500)))
        if np.abs(bad - old).max(initial=0) < 1e-10:
            break
    accuracy = {r: {"bad_if_good": float(if_good[i, 0]), "bad_if_bad": float(if_bad[i, 0]), "good_if_good": float(if_good[i, 2]), "good_if_bad": float(if_bad[i, 2])} for i, r in enumerate(RULES)}
    return 1 - bad, accuracy | {"share_bad": float(share)}


def posteriors(rows: DataFrame) -> dict[int, float]:
    """Posterior of good of every vote pattern met; at most 3**11 rows reach the driver."""
    seen = rows.filter(F.col("n_words") > 0).groupBy("pattern").count().collect()
    pattern = np.array([r["pattern"] for r in seen], np.int64)
    good, _ = fitted(pattern, np.array([r["count"] for r in seen], np.int64))
    return dict(zip(pattern.tolist(), good.tolist()))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_least: float = 0.5, max_repeat_percent: int = 50, min_words: int = 50) -> DataFrame:
    """Per row: id, counts, ``base_failed``, ``quality`` (posterior of good) and ``kept``.

    Texts are counted once and the counts written to the shared folder; the posteriors' table is broadcast as it has
    a fixed bound.
    """
    rows = written(measured(docs, id_col, text_col), "counts")
    model = docs.sparkSession.createDataFrame(list(posteriors(rows).items()), "pattern int, quality double")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return (
        rows.join(F.broadcast(model), "pattern", "left")
        .withColumn("quality", F.coalesce("quality", F.lit(0.0)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= at_least))
        .select(id_col, *COUNTS, "base_failed", "kept", "quality")
    )


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_least: float = 0.5, max_repeat_percent: int = 50, min_words: int = 50) -> DataFrame:
    """The rows of ``docs`` that pass, all columns unchanged. Rows are judged where they are read: no shuffle."""
    model = posteriors(measured(docs, id_col, text_col))
    at = docs.columns.index(text_col)

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = np.zeros(len(batch), bool)
        for t in tx.slices(batch.column(at)):
            c = counts(t)
            good = np.array([model.get(p, 0.0) for p in patterns(c).tolist()]) >= at_least
            sound = (c["n_words"] >= min_words) & (100 * c["n_repeat_words"] <= max_repeat_percent * c["n_words"])
            keep[t.first : t.first + t.n] = good & sound
        return batch.filter(pa.array(keep))

    return tx.mapped(docs, of, docs.schema)
