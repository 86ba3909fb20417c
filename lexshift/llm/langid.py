"""Problem 8: the language of documents and of their segments, by hierarchical discrimination.

A first linear support vector machine tells the language family; within a family, one-versus-one linear machines
separate the closely related languages. The features of a stretch of text are the mean of its words' features (the word
and its character n-grams between word bounds), so that the decision of any stretch is the mean of scores by word: a
word is scored once a task, and all stretches of a text follow from running sums.

The machines are fitted on the driver on at most MAX_SAMPLES passages of labelled texts, a documented bound; all texts are
cut into passages whole. Confidences are calibrated on passages that were held out. The family is decided first, then the
language within it.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexshift.llm.canon import canonical

#: Labelled passages that the machines are fitted on at most; words of a passage.
MAX_SAMPLES, PASSAGE = 4000, 64
#: Documents, and passages of them, that a second fit takes besides, where their label agrees with the first.
MAX_DOCS, MAX_DOC_PASSAGES = 600, 1000
#: Running words from which on a stretch in another language counts, and how many of them in a row must speak for it.
MIN_STRETCH, CORE = 8, 7
#: Cost of a change of language, in nats, between two words of a sentence and between sentences, and how much a word's score weighs against it; fitted on held-out mixtures of the labelled samples.
SWITCH, SWITCH_AT_END, TEMPER = 7.0, 4.0, 0.5
#: n-gram lengths; words kept scored by a task; lengths of stretches on which confidences are calibrated.
NGRAMS, CACHE, LENGTHS = (1, 2, 3, 4), 400_000, (1, 2, 4, 8, 16, 32)
#: The families. A language that is not named is a family of its own.
FAMILIES = {"eng": "germanic", "ger": "germanic", "swe": "germanic", "lat": "italic"}
#: How labels spell the languages, in lower case without blanks around.
SPELLINGS = {
    "eng": ["eng", "en", "english", "en-us", "en-gb", "en_us", "en_gb", "englisch", "engelska", "anglais"],
    "ger": ["ger", "de", "deu", "german", "deutsch", "de-de", "de-at", "de_de", "tyska", "allemand", "gmh", "goh"],
    "lat": ["lat", "la", "latin", "latina", "latein", "la-va"],
    "swe": ["swe", "sv", "swedish", "svenska", "sv-se", "sv_se", "schwedisch", "se"],
}

_NOISE = re.compile(r"</?[A-Za-z!?][^<>]*>|https?://\S+")
_BROKEN = re.compile(r"(?<=\w)[-¬] ?\n+(?=\w)")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_END = re.compile(r"[.!?;:\"“”„«»()\[\]…]|\n\n")
PLAIN = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "å": "aa", "ß": "ss", "æ": "ae", "ø": "oe"})


def cleaned(text: str | None) -> str:
    """A text in lower case, levelled, without markup; words broken at a line's end are joined."""
    text = text or ""
    if "&" in text:
        text = html.unescape(text)
    text = canonical(text) or ""
    if "<" in text or "http" in text:
        text = _NOISE.sub(" ", text)
    if "\n" in text:
        text = _BROKEN.sub("", text)
    return text.lower()


def running_words(text: str | None) -> list[str]:
    """The words of a text, without figures."""
    return _WORD.findall(cleaned(text))


def starts_of_sentences(text: str | None) -> np.ndarray:
    """Of each running word, whether the end of a sentence, a quotation or a paragraph stands before it."""
    plain = cleaned(text)
    words = np.array([m.start() for m in _WORD.finditer(plain)], np.int64)
    ends = np.searchsorted([m.start() for m in _END.finditer(plain)], words)  # ends before each word
    return np.diff(ends, prepend=0) > 0


def features(word: str) -> list[str]:
    held = f"^{word}$"
    return ["=" + word, *(held[i : i + n] for n in NGRAMS for i in range(len(held) - n + 1))]


class Rows:
    """The sparse matrix of samples by features, as two factors: words of each sample, features of each word.

    A sample is the mean of its words' rows, a word's row has 1 / sqrt(features) where it has a feature. The last column
    is the same for all. Products cost the entries of the factors, and nothing dense of samples by features is made.
    """

    def __init__(self, samples: list[list[int]], words: list[list[int]], sizes: list[int], width: int) -> None:
        self.size = np.array([len(x) for x in samples], np.int64)
        self.word = np.fromiter((w for x in samples for w in x), np.int64, int(self.size.sum()))
        self.sample = np.repeat(np.arange(len(samples)), self.size)
        self.share = 1 / self.size[self.sample]
        held = np.array([len(x) for x in words], np.int64)
        self.column = np.fromiter((c for x in words for c in x), np.int64, int(held.sum()))
        self.owner = np.repeat(np.arange(len(words)), held)
        self.weight = 1 / np.sqrt(np.array(sizes, float))
        self.width = width

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        by_word = np.bincount(self.owner, v[self.column], len(self.weight)) * self.weight
        return np.bincount(self.sample, by_word[self.word] * self.share, len(self.size)) + 0.1 * v[-1]

    def back(self, u: np.ndarray) -> np.ndarray:
        """The transposed matrix times ``u``."""
        by_word = np.bincount(self.word, u[self.sample] * self.share, len(self.weight)) * self.weight
        out = np.bincount(self.column, by_word[self.owner], self.width)
        out[-1] = 0.1 * u.sum()
        return out

    def squares(self, block: int = 1000) -> np.ndarray:
        """The squared length of each row, a block of rows at a time."""
        starts, out = np.concatenate([[0], np.cumsum(np.bincount(self.owner, minlength=len(self.weight)))]), []
        ends = np.concatenate([[0], np.cumsum(self.size)])
        for a in range(0, len(self.size), block):
            part = slice(ends[a], ends[min(a + block, len(self.size))])
            w = self.word[part]
            n = starts[w + 1] - starts[w]
            at = np.repeat(starts[w] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            key = np.repeat(self.sample[part] - a, n) * self.width + self.column[at]
            cells, inverse = np.unique(key, return_inverse=True)
            value = np.bincount(inverse, np.repeat(self.share[part] * self.weight[w], n))
            out.append(np.bincount(cells // self.width, value**2, min(block, len(self.size) - a)))
        return np.concatenate(out) + 0.01


class Model:
    """The fitted machines: ``contests`` are the families against each other, then pairs within a family."""

    def __init__(self, texts: list[tuple[str, str]], size: int = 8, step: int = 4, calibrated: bool = True) -> None:
        samples: list[tuple[str, list[str]]] = []
        for lang, text in texts:
            plain = running_words(text)
            bare = ["".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c)) for w in plain]
            for ws in sorted({tuple(x) for x in (plain, [w.translate(PLAIN) for w in plain], bare)}):
                samples += [(lang, list(ws[i : i + size])) for i in range(0, max(1, len(ws) - size // 2), step) if ws]
        self.langs = sorted({lang for lang, _ in samples})
        self.family = {x: FAMILIES.get(x, x) for x in self.langs}
        self.families = sorted(set(self.family.values()))
        if len(self.langs) < 2:
            raise ValueError("samples of two languages at least are needed")
        times = Counter(w for _, ws in samples for w in ws)
        of = {w: features(w) for w in sorted(times)}
        often: Counter[str] = Counter(f for w, n in times.items() for f in set(of[w]) if n > 1 or not f.startswith("="))
        self.column = {f: i for i, f in enumerate(sorted(f for f, n in often.items() if n > 1 or f.startswith("=")))}
        number = {w: i for i, w in enumerate(of)}
        rows = [[number[w] for w in ws] for _, ws in samples]
        known = [[i for f in fs if (i := self.column.get(f)) is not None] for fs in of.values()]
        lengths = [len(fs) for fs in of.values()]
        own = np.array([lang for lang, _ in samples])
        fam = np.array([self.family[lang] for lang in own])
        self.contests: list[tuple[str, str]] = list(combinations(self.families, 2))
        self.split = len(self.contests)
        self.contests += [(a, b) for a, b in combinations(self.langs, 2) if self.family[a] == self.family[b]]
        fits = []
        for k, (a, b) in enumerate(self.contests):
            side = fam if k < self.split else own
            at = np.flatnonzero((side == a) | (side == b))
            fits.append(fitted(Rows([rows[i] for i in at], known, lengths, len(self.column) + 1), side[at] == a))
        self.weights, self.scale = np.stack([w for w, _ in fits], 1), np.array([s for _, s in fits])
        #: By contest, what a mean score is multiplied by to be a confidence: the first, and the second for each doubling of the words.
        self.sure = np.stack([self.scale, np.zeros(len(fits))], 1)
        if calibrated:
            self.calibrate(texts, size, step)

    def calibrate(self, texts: list[tuple[str, str]], size: int, step: int) -> None:
        """Fit the confidences of stretches of LENGTHS words on passages that the machines have not seen, in two halves."""
        half = [zlib.crc32(t.encode()) & 1 for _, t in texts]
        seen: list[list[tuple[float, int, bool]]] = [[] for _ in self.contests]
        for k in (0, 1):
            rest = [x for x, h in zip(texts, half, strict=True) if h != k]
            if {lang for lang, t in rest if running_words(t)} != set(self.langs):
                return  # too few passages to hold any out
            other = Model(rest, size, step, calibrated=False)
            for (lang, text), h in zip(texts, half, strict=True):
                if h == k and (ws := running_words(text)):
                    total = np.concatenate([np.zeros((1, len(self.contests))), np.cumsum(other.scores(ws)[0], 0)])
                    for n in LENGTHS:
                        for at in range(0, len(ws) - n + 1, n):
                            for c, (a, b) in enumerate(self.contests):
                                side = self.family[lang] if c < self.split else lang
                                if side in (a, b):
                                    seen[c].append(((total[at + n, c] - total[at, c]) / n, n, side == a))
        for c, rows in enumerate(seen):
            if rows:
                self.sure[c] = confident(*(np.array(x) for x in zip(*rows, strict=True)))

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' shares in each contest's decision, a row a word; and the share of their features that the samples have."""
        get = self.column.get
        sizes, rows, owner = [], [], []
        for n, w in enumerate(words):
            fs = features(w)
            own = [i for f in fs if (i := get(f)) is not None]
            sizes.append(len(fs))
            rows += own
            owner += [n] * len(own)
        at, of, size = np.array(rows, np.int64), np.array(owner, np.int64), np.array(sizes, float)
        out = np.zeros((len(words), len(self.contests)))
        for k in range(len(self.contests)):
            out[:, k] = np.bincount(of, self.weights[at, k], len(words))
        return out / np.sqrt(size)[:, None] + 0.1 * self.weights[-1], np.bincount(of, minlength=len(words)) / size

    def logs(self, means: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
        """Log confidences by language, from mean scores (any shape, contests last); calibrated if the numbers of words are given."""
        scale = self.scale if words is None else np.maximum(self.sure[:, 0] + self.sure[:, 1] * np.log2(words)[..., None], 1e-3)
        z = np.clip(means * scale, -30, 30)
        for_a, for_b = -np.logaddexp(0, -z), -np.logaddexp(0, z)
        family, within = np.zeros((*means.shape[:-1], len(self.langs))), np.zeros((*means.shape[:-1], len(self.langs)))
        for k, (a, b) in enumerate(self.contests):
            for n, lang in enumerate(self.langs):
                side = self.family[lang] if k < self.split else lang
                if side in (a, b):
                    (family if k < self.split else within)[..., n] += (for_a if side == a else for_b)[..., k]
        for f in self.families:  # what a family has is shared out to its languages
            own = [n for n, lang in enumerate(self.langs) if self.family[lang] == f]
            within[..., own] -= _total(within[..., own])
            family[..., own] += np.log(len(own))
        out = family + within
        return out - _total(out)

    def choice(self, logs: np.ndarray) -> np.ndarray:
        """The language of each row of log confidences: the family first, then the language within it."""
        of = np.array([self.families.index(self.family[x]) for x in self.langs])
        best = np.stack([_total(logs[..., of == f])[..., 0] for f in range(len(self.families))], -1).argmax(-1)
        return np.where(of == best[..., None], logs, -np.inf).argmax(-1)


def _total(logs: np.ndarray) -> np.ndarray:
    top = logs.max(-1, keepdims=True)
    return top + np.log(np.exp(logs - top).sum(-1, keepdims=True))


def fitted(x: Rows, yes: np.ndarray, c: float = 30.0, rounds: int = 80) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by accelerated descent, and the scale that makes its margins comparable."""
    y = np.where(yes, 1.0, -1.0)
    weight = np.where(yes, 0.5 / max(1, yes.sum()), 0.5 / max(1, (~yes).sum())) * c
    steep = 1 + 2 * float((weight * x.squares()).sum())
    w = v = np.zeros(x.width)
    for i in range(rounds):
        short = np.maximum(0, 1 - y * (x @ v))
        new = v - (v - 2 * x.back(weight * short * y)) / steep
        w, v = new, new + i / (i + 3) * (new - w)
    return w, float(3 / max(1e-6, np.median(np.abs(x @ w))))


def confident(mean: np.ndarray, words: np.ndarray, right: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic regression without intercept on the mean score and the mean score times the doublings of the words; both sides weigh alike."""
    x = np.stack([mean, mean * np.log2(words)], 1)
    weight = np.where(right, 0.5 / max(1, right.sum()), 0.5 / max(1, (~right).sum()))
    out = np.zeros(2)
    ridge = np.diag(1e-6 * np.square(x).mean(0) + 1e-12)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ out, -30, 30)))
        out = out + np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + ridge, x.T @ (weight * (right - p)) - ridge @ out)
    return out


def label_code(column: Column, langs: list[str]) -> Column:
    """Which of ``langs`` a label names, by SPELLINGS or by its own code; ``other`` for a value that names none of them, NULL for none."""
    plain = F.lower(F.trim(column))
    out = F.when(plain.isNull() | (plain == ""), F.lit(None).cast("string"))
    for code in langs:
        out = out.when(plain.isin(sorted({*SPELLINGS.get(code, []), code.lower()})), code)
    return out.otherwise("other")


class Detector:
    """Languages of batches of texts; keeps the scores of words it has seen."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.seen: dict[str, int] = {}
        self.scores = np.zeros((1024, len(model.contests) + 1))  # the last column: the share of known features
        self.emit = np.zeros((1024, len(model.langs)))

    def learn(self, words: set[str]) -> None:
        """Score words not seen before, all at once."""
        new = [w for w in words if w not in self.seen]
        n = len(self.seen)
        if n + len(new) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros((n + 2 * len(new), self.scores.shape[1]))])
            self.emit = np.concatenate([self.emit, np.zeros((len(self.scores) - len(self.emit), self.emit.shape[1]))])
        made, known = self.model.scores(new)
        self.scores[n : n + len(new)] = np.column_stack([made, known])
        self.emit[n : n + len(new)] = self.model.logs(made * TEMPER)
        self.seen.update(zip(new, range(n, n + len(new)), strict=True))

    def segments(self, texts: list[str | None]) -> list[list[tuple[int, int, str, float, float]]]:
        """Of each text its stretches: first word, words, language, confidence, share of known features. Texts without running words have none."""
        if len(self.seen) > CACHE:
            self.seen.clear()
        m = self.model
        out: list[list[tuple[int, int, str, float, float]]] = [[] for _ in texts]
        split = [(i, ws) for i, t in enumerate(texts) if (ws := running_words(t))]
        if not split:
            return out
        self.learn({w for _, ws in split for w in ws})
        docs = [(i, np.fromiter(map(self.seen.__getitem__, ws), np.int64, len(ws))) for i, ws in split]
        sums = np.concatenate([np.zeros((1, self.scores.shape[1])), np.cumsum(self.scores[np.concatenate([d for _, d in docs])], 0)])
        starts = np.cumsum([0, *(len(d) for _, d in docs)])

        def judged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Language, confidence and share of known features of the words from ``a`` to ``b``."""
            means = (sums[b] - sums[a]) / (b - a)[:, None]
            logs = m.logs(means[:, :-1], b - a)
            lang = m.choice(logs)
            return lang, np.exp(logs[np.arange(len(lang)), lang]), means[:, -1]

        main, sure, known = judged(starts[:-1], starts[1:])
        # a text stays in its main language unless some stretch of MIN_STRETCH words gains more than a change costs: the best
        # stretch that ends at each word starts where the running sum of the lead over the main language was lowest
        flat, of = np.concatenate([d for _, d in docs]), np.repeat(np.arange(len(docs)), np.diff(starts))
        lead = self.emit[flat]
        lead = lead - lead[np.arange(len(flat)), main[of]][:, None]
        after = np.cumsum(lead, 0)
        apart = (np.abs(after).max() * 2 + 1) * of[:, None]  # sets the texts so far apart that each begins its own minimum
        lowest = np.minimum.accumulate(after - lead - apart, 0) + apart
        back, gain = MIN_STRETCH - 1, np.full(len(flat), -np.inf)
        rest = max(0, len(flat) - back)
        gain[back:] = np.where(of[back:] == of[:rest], (after[back:] - lowest[:rest]).max(1), -np.inf)
        mixed = np.maximum.reduceat(gain, starts[:-1]) > SWITCH_AT_END
        mixed &= np.diff(starts) >= 2 * MIN_STRETCH
        for n, (i, d) in enumerate(docs):
            if not mixed[n]:
                out[i] = [(0, len(d), m.langs[main[n]], float(sure[n]), float(known[n]))]
        found: list[tuple[int, int, int]] = []
        for group in _groups([(n, docs[n][1]) for n in np.flatnonzero(mixed)]):
            ends = [starts_of_sentences(texts[docs[n][0]]) for n, _ in group]
            for n, path in zip((n for n, _ in group), self.paths([d for _, d in group], ends), strict=True):
                found += [(n, a, b) for a, b in self.firm(docs[n][1], path)]
        if found:
            n, a, b = np.array(found).T
            lang = judged(starts[n] + a, starts[n] + b)[0]
            first = np.flatnonzero(np.concatenate([[True], (n[1:] != n[:-1]) | (lang[1:] != lang[:-1])]))  # neighbours in one language are one stretch
            n, a, b = n[first], a[first], b[np.concatenate([first[1:] - 1, [len(b) - 1]])]
            lang, sure, known = judged(starts[n] + a, starts[n] + b)
            for n_, a_, b_, x_, s_, k_ in zip(*(v.tolist() for v in (n, a, b, lang, sure, known)), strict=True):
                out[docs[n_][0]].append((a_, b_ - a_, m.langs[x_], s_, k_))
        return out

    def paths(self, docs: list[np.ndarray], ends: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
        """The best stretches (start, end, language) of several texts at once, each of MIN_STRETCH words at least.

        A change costs less where ``ends`` says that a sentence begins. As a stretch is entered only with its first
        MIN_STRETCH words, a word at its edge that fits the neighbour too does not make it too short.
        """
        longest, k, least, every = max(map(len, docs)), len(self.model.langs), MIN_STRETCH, np.arange(len(docs))
        total, cost = np.zeros((longest + 1, len(docs), k)), np.full((longest, len(docs)), SWITCH)
        for n, d in enumerate(docs):
            total[1 : len(d) + 1, n] = np.cumsum(self.emit[d], 0)
            total[len(d) + 1 :, n] = total[len(d), n]  # a text that has ended goes on with nothing to emit
            cost[: len(d), n] = np.where(ends[n], SWITCH_AT_END, SWITCH)
        sizes = np.array([len(d) for d in docs])
        best = total.copy()  # by words read and language
        entered, came = np.zeros(total.shape, bool), np.zeros(total.shape[:2], np.int8)
        for t in range(least + 1, longest + 1):
            best[t] = best[t - 1] + total[t] - total[t - 1]
            if t < 2 * least:
                continue
            at = t - least
            came[at] = top = best[at].argmax(1)
            new = (best[at][every, top] - cost[at])[:, None] + total[t] - total[at]
            entered[t] = (new > best[t]) & (sizes >= t)[:, None]
            best[t] = np.where(entered[t], new, best[t])
        out: list[list[tuple[int, int, int]]] = []
        for n, size in enumerate(sizes.tolist()):
            lang, end, t, found = int(best[size, n].argmax()), size, size, []
            while t > 0:
                if entered[t, n, lang]:
                    found.append((t - least, end, lang))
                    end = t = t - least
                    lang = int(came[t, n])
                else:
                    t -= 1
            out.append([*reversed([*found, (0, end, lang)])])
        return out


    def firm(self, doc: np.ndarray, path: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
        """The bounds of the stretches of a path without those that consist of few foreign words and neighbours drawn in.

        A short stretch stays if the run of its words that speaks most for it, against a neighbour's language, has CORE words.
        """
        out: list[list[int]] = []
        for i, (a, b, x) in enumerate(path):
            others = [path[j][2] for j in (i - 1, i + 1) if 0 <= j < len(path)]
            if b - a < 2 * MIN_STRETCH and any(_best_run(self.emit[doc[a:b], x] - self.emit[doc[a:b], y]) < CORE for y in others):
                x = -1
            if out and (x < 0 or out[-1][2] in (x, -1)):
                out[-1][1:] = b, max(x, out[-1][2])
            else:
                out.append([a, b, x])
        return [(a, b) for a, b, _ in out]


def _best_run(lead: np.ndarray) -> int:
    """The length of the run with the largest sum."""
    total = np.concatenate([[0.0], np.cumsum(lead)])
    gain = total[None, :] - total[:, None]
    a, b = np.unravel_index(np.argmax(np.triu(gain)), gain.shape)
    return int(b - a)


def _groups(docs: list[tuple[int, np.ndarray]], cells: int = 200_000) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Texts of like length, so many that their padded words stay below ``cells``."""
    held: list[tuple[int, np.ndarray]] = []
    for d in sorted(docs, key=lambda x: len(x[1])):
        if held and len(d[1]) * (len(held) + 1) > cells:
            yield held
            held = []
        held.append(d)
    if held:
        yield held


def _passages(rows: DataFrame, most: int) -> list[tuple[str, str]]:
    """Language and text of at most ``most`` passages of PASSAGE words, in the order of their hash; every text is cut whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = [(x, " ".join(ws[at : at + PASSAGE])) for x, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for ws in [running_words(t)] for at in range(0, len(ws), PASSAGE)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in cut], pa.string()) for k in (0, 1)], names=["lang", "passage"])

    made = rows.select(F.col("lang").cast("string"), "text").where("lang IS NOT NULL AND text IS NOT NULL").mapInArrow(run, "lang string, passage string")
    return sorted((r.lang, r.passage) for r in made.orderBy(F.md5(F.concat_ws("|", "lang", "passage")), "lang").limit(most).collect())


def fit(samples: DataFrame, lang: str = "lang", text: str = "text", most: int = MAX_SAMPLES, documents: DataFrame | None = None) -> Model:
    """The machines for a table of labelled texts: all are cut whole into passages of PASSAGE words, of which at most ``most``
    are taken, in the order of their hash.

    With ``documents`` (``doc_id, text, lang``, labels partly wrong) the machines are fitted once more, on at most
    MAX_DOC_PASSAGES passages of about MAX_DOCS of them as well, namely those whose label is what the first machines say.
    """
    known = _passages(samples.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")), most)
    if documents is None:
        return Model(known)
    first = Model(known, calibrated=False)
    rows = documents.select("doc_id", "text", label_code(F.col("lang"), first.langs).alias("lang")).where(F.col("lang").isin(first.langs) & F.col("text").isNotNull())
    share = min(1.0, MAX_DOCS / max(1, documents.count()))
    more = _passages(rows.where(F.xxhash64("doc_id") <= F.lit(min(2**63 - 1, int((share * 2 - 1) * 2**63)))), MAX_DOC_PASSAGES)
    judged = Detector(first).segments([t for _, t in more])
    return Model(known + [x for x, found in zip(more, judged, strict=True) if [s[2] for s in found] == [x[0]]])


def segments(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per stretch: ``doc_id``, the columns ``keep``, ``first_word, words, language, confidence, known``.

    Stretches follow each other and cover all running words; one in another language than its neighbours has
    MIN_STRETCH words at least. ``known`` is the share of the words' features that the samples have: it is low for text in
    none of the model's languages, of which the nearest is named all the same. NULL, empty and blank texts and those without
    running words give no row; long texts are read whole; repeated rows each give their own. Rows are treated one by one,
    without a shuffle.
    """
    names = [doc_id, *keep]
    source = documents.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{text}`").alias("_text")).where("_text IS NOT NULL")
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in names) + ", first_word int, words int, language string, confidence double, known double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                got = [(i, *s) for i, ss in enumerate(detector.segments(part.column(len(names)).to_pylist())) for s in ss]
                if got:
                    rows, first, size, lang, sure, known = zip(*got, strict=True)
                    own = part.take(pa.array(rows, pa.int32()))
                    yield pa.RecordBatch.from_arrays([*own.columns[: len(names)], pa.array(first, pa.int32()), pa.array(size, pa.int32()), pa.array(lang), pa.array(sure, pa.float64()), pa.array(known, pa.float64())], names=[*names, "first_word", "words", "language", "confidence", "known"])

    return source.mapInArrow(run, schema)


def document_languages(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, language, words, confidence, label, n_languages``: a row for each language really used in a document.

    Repeated rows of one document id count once: where their labels or texts differ, the row with the first label (NULL
    before all) and the least hash of its text. Confidence is the mean by words.
    """
    rows = documents.withColumn("label", label_code(F.col("lang"), model.langs)).withColumn("copy", F.xxhash64("text"))
    found = segments(rows, model, keep=("label", "copy"))
    each = found.groupBy("doc_id").agg(F.collect_set(F.struct("label", "copy", "first_word", "words", "language", "confidence")).alias("s"))
    of = lambda x: F.struct(x["label"].alias("label"), x["copy"].alias("copy"))
    once = each.select("doc_id", "s", F.array_min(F.transform("s", of)).alias("one")).select("doc_id", F.filter("s", lambda x: of(x).eqNullSafe(F.col("one"))).alias("s"))
    long = once.select("doc_id", F.size(F.array_distinct("s.language")).cast("bigint").alias("n_languages"), F.inline("s"))
    return long.groupBy("doc_id", "language").agg(F.sum("words").alias("words"), (F.sum(F.col("confidence") * F.col("words")) / F.sum("words")).alias("confidence"), F.min("label").alias("label"), F.min("n_languages").alias("n_languages"))


def wrong_labels(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang`` of documents whose label is missing or wrong, or that mix languages."""
    rows = document_languages(documents, model)
    return rows.where("n_languages > 1 OR label IS NULL OR label <> language").select("doc_id", F.col("language").alias("lang"))
