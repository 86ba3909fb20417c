import random

import numpy as np
import pytest

from lexshift.llm import leaks


def vocabulary(n):
    r = random.Random(9)
    return ["".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 4))) for _ in range(n)]


WORDS = vocabulary(3000)


def passage(r, n):
    return [r.choice(WORDS) for _ in range(n)]


@pytest.fixture(scope="module")
def made():
    r = random.Random(8)
    instruction = passage(r, 15)
    items = {i: (instruction if i < 5 else []) + passage(r, 40) for i in range(12)}
    items[11] = items[10][:20] + ["changed"] + items[10][21:]
    docs, want = {}, set()

    def doc(words, *leaked):
        k = len(docs)
        docs[k] = " ".join(passage(r, 60) + words + passage(r, 60))
        want.update((k, i) for i in leaked)
        return k

    doc(items[6][3:18], 6)
    doc(items[6][3:9])  # six words
    doc(instruction)  # shared by five items
    doc(r.sample(items[7], 40))  # another order
    doc(items[8], 8)
    doc(items[10][22:38], 10, 11)  # two items share it
    edited = items[9][:30]
    edited[6] = "xx"
    doc(edited[:13] + ["added"] + edited[13:20] + edited[21:], 9)  # changed, added, dropped
    k = doc(items[7][5:25], 7)
    docs[k] = docs[k].upper().replace(" ", ", <b> ", 90)
    text = " ".join(items[5][2:20])
    docs[len(docs)] = "start " + text.replace("a", "а").replace(items[5][6], items[5][6][:2] + "-\n" + items[5][6][2:]) + " end"
    want.add((len(docs) - 1, 5))
    docs[len(docs)] = docs[0]
    want.add((len(docs) - 1, 6))
    return docs, items, want


@pytest.mark.parametrize(("small", "hot"), [(10**7, 10**6), (-1, 10**6), (-1, 3)])
def test_leaks(spark, made, small, hot):
    docs, items, want = made
    d = spark.createDataFrame([(k, t, "x") for k, t in docs.items()] + [(900, None, "x"), (901, "", "x"), (902, "<p>", "x"), (0, docs[0], "x")], "doc_id bigint, text string, run string")
    i = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()] + [(99, None), (98, ""), (6, " ".join(items[6]))], "item_id bigint, text string")
    rows = leaks.leaks(d.repartition(3), i, broadcast_bytes=small, hot_rows=hot).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want and len(rows) == len(want)
    assert leaks.leaks(d.limit(0), i).count() == 0 and leaks.leaks(d, i.limit(0)).count() == 0


class Index:
    """The search of one process: filter, seeds and verification without Spark."""

    def __init__(self, items):
        self.memory = leaks.Numbers()
        self.items = [(i, self.memory.of(ws)) for i, ws in items]
        self.seeds = {}
        for n, (_, ws) in enumerate(self.items):
            for key, at in zip(*(x.tolist() for x in leaks.seeds(ws)), strict=True):
                self.seeds.setdefault(key, []).append((n, at))
        power = leaks.Filter.power_for(max(1, len(self.seeds)))
        slots = np.zeros(1 << (power - 6), np.uint64)
        for at, bits in leaks.Filter.bits(np.array(list(self.seeds), np.uint64), power):
            np.bitwise_or.at(slots, at, bits)
        self.filter = leaks.Filter(slots)

    def leaks(self, texts):
        best = {}
        for d, ws, keys, places in leaks.surroundings(texts, self.filter, self.memory):
            hits = {}
            for key, place in zip(keys.view(np.uint64).tolist(), places.tolist(), strict=True):
                for n, at in self.seeds.get(key, []):
                    hits.setdefault(n, []).append((place, at))
            for n, hs in hits.items():
                if run := leaks.longest(ws.tolist(), self.items[n][1].tolist(), hs):
                    best[d, self.items[n][0]] = max(run, best.get((d, self.items[n][0]), 0))
        return [(d, i, run) for (d, i), run in best.items()]


def brute(doc, item):
    """The longest exact run."""
    best = 0
    for k in range(len(doc)):
        for j in range(len(item)):
            n = 0
            while k + n < len(doc) and j + n < len(item) and doc[k + n] == item[j + n]:
                n += 1
            best = max(best, n)
    return best


def test_exact_runs_like_brute_force():
    r = random.Random(10)
    items = [passage(r, 30) for _ in range(8)]
    docs = []
    for _ in range(60):
        it = r.choice(items)
        a = r.randint(0, 15)
        docs.append(passage(r, r.randint(0, 20)) + it[a : a + r.randint(0, 20)] + passage(r, 20))
    index = Index(list(enumerate(items)))
    got = {(d, i) for d, i, _ in index.leaks([" ".join(d) for d in docs])}
    want = {(d, i) for d, x in enumerate(docs) for i, y in enumerate(items) if brute(x, y) >= leaks.MIN_RUN}
    assert want <= got and all(brute(docs[d], items[i]) >= 5 for d, i in got)


def test_long_document():
    r = random.Random(11)
    item = passage(r, 20)
    index = Index([(1, item)])
    text = " ".join(passage(r, 100_000) + item + passage(r, 50_000))
    assert [x[1:] for x in index.leaks([None, text])] == [(1, 20)]


def test_edits_near_ends_and_close_to_each_other():
    r = random.Random(12)
    item = WORDS[:40]
    index = Index([(1, item)])
    around = lambda ws: " ".join([r.choice(WORDS[100:]) for _ in range(20)] + ws + [r.choice(WORDS[100:]) for _ in range(20)])
    one = item[:12]
    edited = [one[:10] + ["xx"] + one[11:], one[:1] + ["xx"] + one[2:], one[:11] + ["xx"] + one[11:], one[:1] + ["xx"] + one[1:], item[:11] + item[12:13], item[:1] + item[2:13]]
    edited.append(item[:6] + ["xx"] + item[7:8] + ["yy"] + item[9:15])  # one equal word between two edits
    edited.append(item[:6] + ["xx"] + item[6:7] + item[8:14])  # added, then dropped
    assert [d for d, _, _ in index.leaks([around(x) for x in edited])] == list(range(len(edited)))
    assert not list(index.leaks([around(x) for x in (item[:6], item[:11], item[:5] + ["xx", "yy"] + item[7:12], r.sample(item, 40))]))


def test_a_long_copy_edited_every_few_words_is_one_run():
    r = random.Random(13)
    item = passage(r, 400)
    edited = [("xx" if n % 4 == 3 else w) for n, w in enumerate(item)]
    assert Index([(1, item)]).leaks([" ".join(edited)]) == [(0, 1, 399)]


def test_markup_and_entities():
    item = ["märchen", *WORDS[:11]]
    tag = '<a href="' + "x" * 500 + '">'
    text = tag + " M&auml;rchen " + f" {tag}\n".join(WORDS[:11]) + "</a>"
    assert [x[1:] for x in Index([(1, [w for x in item for w in leaks.words(x)])]).leaks([text])] == [(1, 12)]
    assert leaks.words("a < b and c > d") == ["a", "b", "and", "c", "d"]


def test_filter_lets_all_its_keys_through_and_few_others():
    r = np.random.default_rng(14)
    keys, others = (r.integers(0, 2**63, 20_000).astype(np.uint64) * np.uint64(2) for _ in "ab")
    power = leaks.Filter.power_for(len(keys))
    slots = np.zeros(1 << (power - 6), np.uint64)
    for at, bits in leaks.Filter.bits(keys, power):
        np.bitwise_or.at(slots, at, bits)
    f = leaks.Filter(slots)
    assert len(f.holds(keys)) == len(keys) and len(f.holds(others)) < 20
    assert leaks.Filter.power_for(10**12) == leaks.MOST_BITS
