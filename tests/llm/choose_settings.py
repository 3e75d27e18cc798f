"""How the settings of operators 6 and 8 are chosen: by folds of the training rows alone.

    python -m tests.llm.choose_settings /root/testdata/sf0.1

Held-out rows (the remainders that the queries keep back) are dropped before
anything else happens. The others fall into FOLDS folds by a hash of their id.
Printed for each setting, over all folds: wrong rows of class 1, wrong rows of
class 0 at the threshold, and the log loss a row.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from itertools import product
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from rippleframe.llm import qda, toxicity
from rippleframe.llm.wordbytes import LOWER, PUNCTUATION, Prefix, chained, flat, mix, word_ranges

FOLDS = 4


def labelled(sf_dir: str, label: str, held_out: int, modulus: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(texts, labels, folds) of the labelled rows that are not held out."""
    docs = dict(zip(*(c.to_pylist() for c in pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).columns), strict=True))
    marks = pq.read_table(f"{sf_dir}/labels.parquet", columns=["doc_id", label])
    rows = [(i, y) for i, y in zip(*(c.to_pylist() for c in marks.columns), strict=True) if y is not None and i in docs and crc32(str(i).encode()) % modulus != held_out]
    rows.sort(key=lambda r: crc32(b"order" + str(r[0]).encode()))
    return pa.array([docs[i] or "" for i, _ in rows], pa.string()), np.array([y for _, y in rows]), np.array([crc32(b"fold" + str(i).encode()) % FOLDS for i, _ in rows])


def report(name: str, p: np.ndarray, y: np.ndarray, threshold: float) -> None:
    q = np.clip(p, 1e-6, 1 - 1e-6)
    loss = -np.where(y == 1, np.log(q), np.log(1 - q)).mean()
    print(f"{name}: missed {np.sum((p < threshold) & (y == 1))} of {np.sum(y == 1)}, false {np.sum((p >= threshold) & (y == 0))} of {np.sum(y == 0)}, loss {loss:.5f}", flush=True)


def across(y: np.ndarray, fold: np.ndarray, predict: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The score of each row by the model of the other folds."""
    p = np.zeros(len(y))
    for f in range(FOLDS):
        p[fold == f] = predict(np.flatnonzero(fold != f), np.flatnonzero(fold == f))
    return p


def wider(data: np.ndarray, offsets: np.ndarray, longest: int, gaps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Features without word starts: n-grams up to a length and pairs with so many words between."""
    data = LOWER[data]
    starts, ends, doc = word_ranges(data, offsets, PUNCTUATION)
    h = Prefix(data).of(starts, ends)
    found, owner = [h], [doc]
    for n in range(2, longest + 1):
        at, grams = chained(h, doc, n)
        found.append(grams)
        owner.append(doc[at])
    for gap in gaps:
        far = np.flatnonzero(doc[: len(h) - gap - 1] == doc[gap + 1 :])
        found.append(mix(mix(h[far] * np.uint64(3 + 2 * gap)) + h[far + gap + 1]))
        owner.append(doc[far])
    place = np.concatenate(found) & np.uint64((1 << toxicity.BITS) - 1)
    return toxicity.distinct_places(place.astype(np.int64), np.concatenate(owner))


def toxic_by_windows(sf_dir: str) -> None:
    """Skip-grams of wider windows and longer n-grams in place of word starts."""
    texts, y, fold = labelled(sf_dir, "toxic", 2, 4)
    for longest, gaps in ((2, (1,)), (2, (1, 2)), (3, (1, 2, 3)), (2, (1, 2, 3, 4))):
        place, doc = wider(*flat(texts), longest, gaps)
        sets = np.split(place, np.searchsorted(doc, np.arange(1, len(y))))

        def predict(train: np.ndarray, test: np.ndarray) -> np.ndarray:
            w = toxicity.fit([(sets[k], int(y[k])) for k in train])
            return np.array([1 / (1 + np.exp(-np.clip(w[-1] + w[sets[k]].sum(), -35, 35))) for k in test])

        report(f"toxicity, n-grams to {longest}, words between {gaps}", across(y, fold, predict), y, toxicity.THRESHOLD)


def toxic(sf_dir: str) -> None:
    texts, y, fold = labelled(sf_dir, "toxic", 2, 4)
    for stems in ((), toxicity.STEMS):
        toxicity.STEMS = stems
        place, doc = toxicity.distinct_places(*toxicity.buckets(*flat(texts)))
        sets = np.split(place, np.searchsorted(doc, np.arange(1, len(y))))
        for l1, alpha, epochs in product((3.0, 10.0), (0.3, 1.0), (2, 4)):
            toxicity.L1, toxicity.ALPHA, toxicity.EPOCHS = l1, alpha, epochs

            def predict(train: np.ndarray, test: np.ndarray) -> np.ndarray:
                w = toxicity.fit([(sets[k], int(y[k])) for k in train])
                return np.array([1 / (1 + np.exp(-np.clip(w[-1] + w[sets[k]].sum(), -35, 35))) for k in test])

            report(f"toxicity, word starts {stems or 'none'}, L1 {l1}, rate {alpha}, passes {epochs}", across(y, fold, predict), y, toxicity.THRESHOLD)


def quality(sf_dir: str) -> None:
    texts, y, fold = labelled(sf_dir, "quality", 0, 5)
    x = qda.statistics(*flat(texts))
    for without, shrinkage in product((None, "stutter", "failed_lines"), (0.03, 0.1, 0.3)):
        use = [k for k, name in enumerate(qda.NAMES) if name != without]

        def predict(train: np.ndarray, test: np.ndarray) -> np.ndarray:
            part = {c: x[train][y[train] == c] for c in (0, 1)}
            cov = {c: np.cov(v.T, bias=True) for c, v in part.items()}
            full = {c: (float(len(v)), np.where(np.isin(np.arange(x.shape[1]), use), v.mean(axis=0), 0), np.where(np.outer(np.isin(np.arange(x.shape[1]), use), np.isin(np.arange(x.shape[1]), use)), cov[c], 0)) for c, v in part.items()}
            # a statistic left out has the same mean and spread in both classes and so says nothing
            return qda.Discriminant(full, shrinkage).scores(np.where(np.isin(np.arange(x.shape[1]), use), x[test], 0))

        report(f"quality, without {without or 'nothing'}, shrinkage {shrinkage}", across(y, fold, predict), y, qda.THRESHOLD)


if __name__ == "__main__":
    quality(sys.argv[1])
    toxic_by_windows(sys.argv[1])
    toxic(sys.argv[1])
