"""Substitutes from a masked language model, whatever library runs it.

An ``Encoder`` is all that is needed of the model. It is made once a Python worker, from a function that Spark ships, so
that no weights travel with tasks. Contexts are scored in padded batches of like length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexshift.operators.context import MASK


class Encoder(Protocol):
    """A model with its vocabulary. ``first``, ``last`` and ``unknown`` are the numbers of the signs that begin and end a text and stand for unknown pieces."""

    vocabulary: list[str]
    first: int
    last: int
    unknown: int

    def probabilities(self, ids: np.ndarray, attention: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A row a text: the probability of each piece of the vocabulary at the place ``at``."""
        ...


_made: dict[Callable[[], Encoder], tuple[Encoder, dict[str, int]]] = {}


def encoder_of(load: Callable[[], Encoder]) -> tuple[Encoder, dict[str, int]]:
    """The process's encoder and the numbers of its pieces."""
    if load not in _made:
        made = load()
        _made[load] = made, {p: i for i, p in enumerate(made.vocabulary)}
    return _made[load]


def padded(texts: list[list[int]], first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and attention of texts of pieces, between the first and last sign, padded with 0 to the longest."""
    width = max(map(len, texts)) + 2
    ids, attention = np.zeros((len(texts), width), np.int64), np.zeros((len(texts), width), np.int64)
    for row, seen, t in zip(ids, attention, texts, strict=True):
        row[: len(t) + 2] = [first, *t, last]
        seen[: len(t) + 2] = 1
    return ids, attention


def _usable(piece: str, stopwords: frozenset[str]) -> bool:
    return len(piece) > 1 and piece not in stopwords and not any(x in piece for x in ("##", "...", "["))


@dataclass(frozen=True)
class MaskedModel:
    """Ranks substitutes for contexts with one mask; ``load`` makes the encoder and must be importable on the executors."""

    load: Callable[[], Encoder]
    stopwords: frozenset[str] = frozenset()
    batch: int = 4000

    def filled(self, mentions: DataFrame, top_k: int = 5) -> DataFrame:
        """``mentions`` with ``top_terms, top_term_probs``: the ``top_k`` usable pieces of largest probability at the mask of ``context``.

        Exactly ``top_k`` come out as long as the vocabulary has so many; ties go to the piece that comes first in it. A
        NULL context, or one without a mask, has NULL in both.
        """
        load, stopwords, size = self.load, self.stopwords, self.batch
        names = [c for c in mentions.columns if c not in ("top_terms", "top_term_probs")]
        rows = mentions.select(*(F.col(f"`{c}`") for c in names))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", top_terms array<string>, top_term_probs array<double>"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder, number = encoder_of(load)
            usable = np.array([_usable(p, stopwords) for p in encoder.vocabulary])
            for b in batches:
                contexts = b.column(names.index("context")).to_pylist()
                terms: list[list[str] | None] = [None] * len(contexts)
                sure: list[list[float] | None] = [None] * len(contexts)
                todo = sorted((i for i, c in enumerate(contexts) if c and MASK in c), key=lambda i: len(contexts[i]))
                for part in (todo[a : a + size] for a in range(0, len(todo), size)):
                    ids, attention = padded([[number.get(p, encoder.unknown) for p in contexts[i]] for i in part], encoder.first, encoder.last)
                    p = encoder.probabilities(ids, attention, np.array([contexts[i].index(MASK) + 1 for i in part]))
                    order = np.argsort(-np.where(usable, p, -1.0), 1, kind="stable")[:, : min(top_k, int(usable.sum()))]
                    for i, o, q in zip(part, order, p, strict=True):
                        terms[i], sure[i] = [encoder.vocabulary[k] for k in o], q[o].tolist()
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(terms, pa.list_(pa.string())), pa.array(sure, pa.list_(pa.float64()))], names=[*names, "top_terms", "top_term_probs"])

        return rows.mapInArrow(run, schema)
