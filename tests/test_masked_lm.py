import numpy as np
import pytest

from lexshift.operators import context, masked_lm

VOCABULARY = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "a", "the", "river", "mill", "old", "##s", "wait...", "stone", "house"]


class Fake:
    """Prefers pieces that stand near the mask, nearer ones more; notes the shapes it was given."""

    vocabulary, first, last, unknown = VOCABULARY, 2, 3, 1
    made = 0
    shapes: list[tuple[int, ...]] = []

    def __init__(self):
        Fake.made += 1

    def probabilities(self, ids, attention, at):
        assert (ids[:, 0] == 2).all() and all(row[n - 1] == 3 and not row[n:].any() for row, n in zip(ids, attention.sum(1), strict=True))
        assert (ids[np.arange(len(ids)), at] == VOCABULARY.index("[MASK]")).all()
        Fake.shapes.append(ids.shape)
        out = np.full((len(ids), len(VOCABULARY)), 1e-3)
        for row, t, k in zip(out, ids, at, strict=True):
            for j, piece in enumerate(t):
                row[piece] += 1 / (1 + abs(j - k))
        return out / out.sum(1, keepdims=True)


def load():
    return Fake()


@pytest.mark.parametrize("batch", [1, 4000])
def test_filled(spark, batch):
    rows = [("t", 1, ["the", "old", "[MASK]", "##s", "river"]), ("t", 2, ["unseen", "[MASK]", "mill"]), ("u", 3, None), ("u", 4, ["no", "mask"]), ("u", 5, ["[MASK]"])]
    df = spark.createDataFrame(rows, "term string, pos int, context array<string>")
    got = {r["pos"]: r for r in masked_lm.MaskedModel(load, frozenset(["the"]), batch).filled(df, 3).collect()}
    assert got[1]["top_terms"][:2] == ["old", "river"] and got[2]["top_terms"][0] == "mill"
    assert got[3]["top_terms"] is None and got[4]["top_terms"] is None and len(got[5]["top_terms"]) == 3
    for r in got.values():
        for t in r["top_terms"] or []:
            assert t in {"river", "mill", "old", "stone", "house"}
        assert r["top_term_probs"] is None or r["top_term_probs"] == sorted(r["top_term_probs"], reverse=True)
    assert masked_lm.MaskedModel(load).filled(df.limit(0)).count() == 0
    assert max(len(r["top_terms"] or []) for r in masked_lm.MaskedModel(load).filled(df, 99).collect()) == 6  # all usable ones


def test_one_encoder_a_process_and_padding():
    before = Fake.made
    assert masked_lm.encoder_of(load)[0] is masked_lm.encoder_of(load)[0] and Fake.made <= before + 1
    ids, attention = masked_lm.padded([[7], [7, 8, 9]], 2, 3)
    assert ids.tolist() == [[2, 7, 3, 0, 0], [2, 7, 8, 9, 3]] and attention.tolist() == [[1, 1, 1, 0, 0], [1] * 5]


def test_from_documents(spark):
    docs = spark.createDataFrame([("d", ["the", "old", "mill##s", "river", "house"])], "id string, tokens array<string>")
    found = spark.createDataFrame([("mills", "d", 2), ("old", "d", 1)], "term string, id string, pos int")
    rows = masked_lm.MaskedModel(load).filled(context.windows(docs, found, 2), 2).collect()
    assert {r["term"]: r["context"] for r in rows} == {"mills": ["the", "old", "[MASK]", "river", "house"], "old": ["the", "[MASK]", "mill", "##s"]}
    assert all(len(r["top_terms"]) == 2 for r in rows)
