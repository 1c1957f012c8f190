"""Subject areas of documents: classifier chains over term, source and structure features, decoded by beam search."""

from __future__ import annotations

import copy
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.sources import stage_table

from .arrow import batch, lists_of

BEAM, MOST_LABELS, HELD_CELLS = 8, 2, 5_000_000
SENTENCE_WORDS, LEAST_WORDS, SURE = 24, 4, 2.5
#: A word in a larger share of the sentences belongs to a language, not to a subject, unless this share of those sentences treat one subject.
EVERYWHERE, PURE = 0.02, 0.8

#: Per document and subject: terms, source, shares of the sentences and signs of them.
FEATURES, FOLDS = 9, 5

_BREAK = re.compile(r"(?<=[.!?])[\"')\]]*\s+|[\r\n]+|<[^<>]{1,80}>|\{\"|\"\}")
_WORD = re.compile(r"[^\W\d_]+")
_CODE = re.compile(r"[{}=;|\\]|\d")


def sentences(text: str | None) -> list[list[str]]:
    """The words of each prose sentence: no headers, tables, dumps or code. Runs of over ``SENTENCE_WORDS`` words, as where punctuation is missing, are taken by halves of that length."""
    out = []
    for part in _BREAK.split(text or ""):
        if not part:
            continue
        words = _WORD.findall(part.lower())
        if len(words) < LEAST_WORDS or 4 * len(_CODE.findall(part)) > len(part):
            continue
        if len(words) <= SENTENCE_WORDS:
            out.append(words)
        else:
            step = SENTENCE_WORDS // 2
            out += [words[i : i + step] for i in range(0, len(words), step) if len(words) - i >= LEAST_WORDS]
    return out


class Read:
    """The sentences of documents as numbers: word codes one after another, where each sentence begins, the document of each, and every word of a sentence once."""

    def __init__(self, split: list[list[list[str]]]):
        flat = [s for d in split for s in d]
        code: dict[str, int] = {}
        codes = np.array([code.setdefault(w, len(code)) for s in flat for w in s], np.int64)
        self._hold(list(code), codes, np.array([len(s) for s in flat], np.int64), np.repeat(np.arange(len(split)), [len(d) for d in split]))

    @classmethod
    def of(cls, words: pa.Array, sizes: pa.Array) -> Read:
        """From two columns of lists: the words of each document, one after another, and how many of them each of its sentences has."""
        coded, read = pc.list_flatten(words).cast(pa.string()).dictionary_encode(), cls.__new__(cls)
        doc = pc.list_parent_indices(sizes).to_numpy(zero_copy_only=False).astype(np.int64)
        read._hold(coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(sizes).to_numpy(zero_copy_only=False).astype(np.int64), doc)
        return read

    def _hold(self, words: list[str], codes: np.ndarray, lengths: np.ndarray, doc: np.ndarray) -> None:
        self.words, self.codes, self.doc = words, codes, doc
        self.starts = np.cumsum(lengths) - lengths
        pairs = np.unique(np.repeat(np.arange(len(lengths)), lengths) * max(len(words), 1) + codes)
        self.sentence, self.word = pairs // max(len(words), 1), pairs % max(len(words), 1)

    def counts(self, classes: np.ndarray, k: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In how many of the wanted sentences of each class each word is, and how many such sentences there are."""
        kept = wanted[self.sentence]
        cell = self.word[kept] * (k + 1) + classes[self.sentence[kept]]
        return np.bincount(cell, minlength=len(self.words) * (k + 1)).reshape(-1, k + 1).astype(float), np.bincount(classes[wanted], minlength=k + 1).astype(float)

    def classes(self, odds: np.ndarray) -> np.ndarray:
        """The subject of each sentence by the log-odds of its words; the number of subjects where it has none."""
        k = odds.shape[1]
        if not len(self.starts):
            return np.zeros(0, np.int64)
        scores = np.stack([np.add.reduceat(odds[:, s][self.codes], self.starts) for s in range(k)], axis=1)
        return np.where(scores.max(axis=1) >= SURE, scores.argmax(axis=1), k)


def log_odds(c: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """How much each word speaks for each subject, from the sentences of each class it is in (the last class is none); 0 for rare words and those of a language."""
    n, rest = totals[:-1], totals.sum() - totals[:-1]
    told, all_ = c.sum(axis=1, keepdims=True), max(totals.sum(), 1)
    for_it = c[:, :-1]
    odds = np.log((for_it + 2 * n / all_ + 1e-6) / (n + 2)) - np.log((told - for_it + 2 * rest / all_ + 1e-6) / (rest + 2))
    pure = for_it.max(axis=1, keepdims=True, initial=0) >= PURE * told
    return np.clip(odds, -3, 3) * (told >= 3) * ((told <= EVERYWHERE * all_) | pure)


class Lexicon:
    """How much each word speaks for each subject: log-odds, learnt from sentences. Words that speak for none are left out."""

    def __init__(self, words: list[str], odds: np.ndarray):
        used = np.nonzero(odds.any(axis=1))[0]
        self.code = {words[i]: n + 1 for n, i in enumerate(used.tolist())}
        self.odds = np.concatenate([np.zeros((1, odds.shape[1])), odds[used]])

    def scores(self, split: list[list[str]]) -> np.ndarray:
        if not split:
            return np.zeros((0, self.odds.shape[1]))
        get = self.code.get
        codes = [get(w, 0) for s in split for w in s]
        starts = np.cumsum([0] + [len(s) for s in split[:-1]])
        return np.add.reduceat(self.odds[codes], starts, axis=0)


def _newton(sums, widths: list[int], penalty: float, rounds: int = 25) -> list[np.ndarray]:
    """Weights of logistic regressions with an L2 penalty, the last weight being that of the constant, by Newton's method. ``sums`` gets the weights of each that has not come to rest yet, by number, and gives the gradient and the curvature of each, summed over its rows."""
    ws, moving = [np.zeros(n) for n in widths], set(range(len(widths)))
    for _ in range(rounds):
        for i, (gradient, curvature) in sums({i: ws[i] for i in sorted(moving)}).items():
            ridge = np.full(widths[i], penalty)
            ridge[-1] = 1e-3
            step = np.linalg.solve(curvature + np.diag(ridge + 1e-9), gradient + ridge * ws[i])
            ws[i] = ws[i] - step
            if np.abs(step).max() < 1e-6:
                moving.discard(i)
        if not moving:
            break
    return ws


def _slopes(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return x.T @ (p - y), (x * (p * (1 - p))[:, None]).T @ x


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression on the rows of ``x``; its last column is the constant."""
    return _newton(lambda ws: {0: _slopes(x, y, ws[0])}, [x.shape[1]], penalty)[0]


def _calibration_error(held: list[tuple[np.ndarray, np.ndarray]]) -> float:
    """The mean distance between the probability given and the share that is true, over ten bins of probability, weighted by their size."""
    if not held:
        return 0.0
    p, y = (np.concatenate(x) for x in zip(*held))
    at = np.minimum((p * 10).astype(int), 9)
    size = np.bincount(at, minlength=10)
    return float(np.abs(np.bincount(at, p, 10) - np.bincount(at, y, 10)).sum() / max(size.sum(), 1))


def source_odds(held: dict[str, np.ndarray], prior: np.ndarray) -> dict[str, np.ndarray]:
    """How much each source speaks for each subject, from its documents of each subject and their number."""
    return {s: np.log((c[:-1] + 5 * prior + 1e-3) / (c[-1] + 5)) - np.log(prior + 1e-3) for s, c in sorted(held.items())}


class Chain:
    """One logistic regression for each subject in order of frequency; each also sees the subjects decided before it.

    What the regressions are fitted on is out of fold: the lexicon and the sources that give a document its features are learnt from the labels of the other ``FOLDS`` - 1 folds. Their logits are
    calibrated (Platt: a scale and a shift for each subject) on folds judged by the weights of the others; ``calibration_error`` is what is left.
    """

    def __init__(self, subjects: list[str], rows: list[tuple[str | None, str | None, set[int]]], more: list[str | None] = ()):
        k = len(subjects)
        self.subjects = subjects
        texts, sources = [t for t, _, _ in rows], [s for _, s, _ in rows]
        split = [sentences(t) for t in texts]
        labels = np.zeros((len(rows), k))
        for i, (_, _, ls) in enumerate(rows):
            labels[i, sorted(ls)] = 1
        read = Read(split + [sentences(t) for t in more])
        self.prior = labels.mean(axis=0) if len(rows) else np.zeros(k)
        self.order = np.argsort(-self.prior, kind="stable")
        fold = np.arange(len(rows)) % FOLDS
        own, everywhere = np.zeros((len(rows), k, FEATURES)), np.zeros((len(rows), 3))
        for part in range(min(FOLDS, len(rows))):  # no document's features come from its own label
            at = np.nonzero(fold == part)[0]
            self._learn(read, labels, sources, fold != part)
            own[at], everywhere[at] = self.features([split[i] for i in at], [sources[i] for i in at], [texts[i] for i in at])
        self._learn(read, labels, sources, np.ones(len(rows), bool))
        self.weights, self.scale, held = [], [], []
        for n, s in enumerate(self.order):
            x = np.concatenate([own[:, s], everywhere, labels[:, self.order[:n]], np.ones((len(rows), 1))], axis=1)
            y = labels[:, s]
            if not len(rows):
                self.weights.append(np.zeros(x.shape[1]))
                self.scale.append(np.array([1.0, 0.0]))
                continue
            self.weights.append(_logistic(x, y))
            z = np.zeros(len(rows))
            for part in range(min(FOLDS, len(rows))):  # each fold judged by the weights of the others
                z[fold == part] = x[fold == part] @ (_logistic(x[fold != part], y[fold != part]) if (fold != part).any() else self.weights[-1])
            pair = np.stack([z, np.ones(len(rows))], axis=1)
            self.scale.append(_logistic(pair, y, 1e-3) if 0 < y.sum() < len(y) else np.array([1.0, 0.0]))
            held.append((1 / (1 + np.exp(-np.clip(pair @ self.scale[-1], -30, 30))), y))
        self.calibration_error = _calibration_error(held)

    def _learn(self, read: Read, labels: np.ndarray, sources: list[str | None], taught: np.ndarray) -> None:
        """The lexicon and the sources, from the labels of the documents ``taught`` and from what stands beside known words there and in the unlabelled texts."""
        k = len(self.subjects)
        n = len(labels)
        known = np.concatenate([taught & (labels.sum(axis=1) == 1), np.zeros(max(int(read.doc.max(initial=-1)) + 1 - n, 0), bool)])
        kind = np.concatenate([labels.argmax(axis=1) if n else np.zeros(0, np.int64), np.zeros(len(known) - n, np.int64)])
        odds = log_odds(*read.counts(kind[read.doc], k, known[read.doc]))
        wanted = np.concatenate([taught, np.ones(len(known) - n, bool)])[read.doc]
        for _ in range(3):
            odds = log_odds(*read.counts(read.classes(odds), k, wanted))
        self.lexicon = Lexicon(read.words, odds)
        held: dict[str, np.ndarray] = {}
        for i in np.nonzero(taught)[0].tolist():
            held.setdefault(sources[i] or "", np.zeros(k + 1))[:] += np.append(labels[i], 1)
        self.sources = source_odds(held, self.prior)

    def features(self, split: list[list[list[str]]], sources: list[str | None], texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each document and subject: terms (mean log-odds), source, and what share of the sentences treat it; for each document: structure."""
        k = len(self.subjects)
        flat = [s for d in split for s in d]
        doc = np.repeat(np.arange(len(split)), [len(d) for d in split])
        scores = self.lexicon.scores(flat)
        sure = (scores.max(axis=1) >= SURE) if len(scores) else np.zeros(0, bool)
        kind = scores.argmax(axis=1) if len(scores) else np.zeros(0, np.int64)
        counts = np.bincount(doc[sure] * k + kind[sure], minlength=len(split) * k).reshape(len(split), k).astype(float)
        total = np.bincount(doc, minlength=len(split)).astype(float)
        clear = counts.sum(axis=1)
        mean = np.stack([np.bincount(doc, scores[:, s], len(split)) for s in range(k)], axis=1) / np.maximum(total, 1)[:, None] if len(scores) else np.zeros((len(split), k))
        share, of_clear = counts / np.maximum(total, 1)[:, None], counts / np.maximum(clear, 1)[:, None]
        none = np.zeros(k)
        prior = np.array([self.sources.get(s or "", none) for s in sources]).reshape(len(split), k)
        other = np.stack([np.delete(of_clear, s, axis=1).max(axis=1) if k > 1 else np.zeros(len(split)) for s in range(k)], axis=1)
        own = np.stack([np.clip(mean, -5, 10), prior, share, of_clear, share >= 0.25, of_clear >= 0.25, share >= 0.5, counts >= 2, other], axis=2).astype(float)
        length = np.log1p(total)
        marked = np.array([bool(t) and "<" in t for t in texts], float)
        everywhere = np.stack([length, 1 - clear / np.maximum(total, 1), marked], axis=1)
        return own, everywhere

    def decode(self, texts: list[str | None], sources: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The most probable combination of 1 to ``MOST_LABELS`` subjects of each document, as a mask, and its probability; a beam of ``BEAM`` partial combinations is kept along the chain. Documents without a prose sentence that treats any subject have none."""
        n, k = len(texts), len(self.subjects)
        split = [sentences(t) for t in texts]
        own, everywhere = self.features(split, sources, texts)
        beam, worth = np.zeros((n, 1, k)), np.zeros((n, 1))
        for step, s in enumerate(self.order):
            w = self.weights[step]
            base = np.concatenate([own[:, s], everywhere], axis=1)
            logit = (base @ w[: base.shape[1]])[:, None] + beam[:, :, self.order[:step]] @ w[base.shape[1] : base.shape[1] + step] + w[-1]
            logit = self.scale[step][0] * logit + self.scale[step][1]
            yes, no = -np.logaddexp(0, -logit), -np.logaddexp(0, logit)
            yes = np.where(beam.sum(axis=2) >= MOST_LABELS, -np.inf, yes)
            with_it = beam.copy()
            with_it[:, :, s] = 1
            beam, worth = np.concatenate([beam, with_it], axis=1), np.concatenate([worth + no, worth + yes], axis=1)
            if beam.shape[1] > BEAM:
                # the empty combination stays in the beam until the end, as it may only be the start of a later one
                top = np.argsort(-worth, axis=1, kind="stable")[:, :BEAM]
                top[:, -1] = np.where((top == 0).any(axis=1), top[:, -1], 0)
                beam, worth = np.take_along_axis(beam, top[:, :, None], 1), np.take_along_axis(worth, top, 1)
                empty = (beam.sum(axis=2) == 0).argmax(axis=1)
                front = np.arange(n)
                beam[front, empty], beam[front, 0] = beam[front, 0].copy(), beam[front, empty].copy()
                worth[front, empty], worth[front, 0] = worth[front, 0].copy(), worth[front, empty].copy()
        worth = np.where(beam.sum(axis=2) == 0, -np.inf, worth)
        best = worth.argmax(axis=1)
        mask = beam[np.arange(n), best] > 0
        mask[~(own[:, :, 2] > 0).any(axis=1)] = False
        return mask, np.exp(worth[np.arange(n), best])


def train(documents: DataFrame, key: str, text: str, source: str, labels: DataFrame, label_key: str, label: str, subjects: list[str]) -> Chain:
    """A chain trained on all labelled documents, in the way of ``Chain``; all unlabelled ones lend their words to the lexicon and decide no label. Labels are trimmed and lower-cased; those that name no subject are left out.

    The texts stay in the tasks: they are split once, and read four times for the counts of all folds' lexicons. What comes to the driver are the sentences of each class
    that words are in (words of at least three sentences), labels by source, and sums of the regressions' slopes. Folds go by a hash of the id.
    """
    names = {s.strip().lower(): i for i, s in enumerate(subjects)}
    k = len(subjects)
    known = labels.select(F.col(label_key).cast("long").alias("id"), F.lower(F.trim(F.col(label).cast("string"))).alias("s")).where(F.col("id").isNotNull() & F.col("s").isin(list(names)))
    by_row = known.groupBy("id").agg(F.collect_set("s").alias("ls"))
    whole = documents.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("t"), F.col(source).cast("string").alias("src")).join(by_row, "id", "left")
    schema = pa.schema([("fold", pa.int32()), ("src", pa.string()), ("t", pa.string()), ("ls", pa.list_(pa.int32())), ("words", pa.list_(pa.string())), ("sizes", pa.list_(pa.int32()))])

    def split(batches):
        for whole in batches:
            for b in (whole.slice(i, 2000) for i in range(0, whole.num_rows, 2000)):
                texts, ls = b.column("t").to_pylist(), [None if x is None else [names[v] for v in x] for x in b.column("ls").to_pylist()]
                found, kept = [sentences(t) for t in texts], pa.array([t if x is not None else None for t, x in zip(texts, ls)], pa.string())
                yield batch(schema, b.column("fold"), b.column("src"), kept, pa.array(ls, schema.field("ls").type), pa.array([[w for s in d for w in s] for d in found], schema.field("words").type), pa.array([[len(s) for s in d] for d in found], schema.field("sizes").type))

    numbered = whole.select(F.when(F.col("ls").isNotNull(), F.pmod(F.xxhash64("id"), F.lit(FOLDS))).otherwise(-1).cast("int").alias("fold"), "src", "t", "ls")
    read = stage_table(numbered.mapInArrow(split, "fold int, src string, t string, ls array<int>, words array<string>, sizes array<int>"), "sentences")
    labelled = read.where("ls is not null")
    held = labelled.groupBy(F.coalesce("src", F.lit("")).alias("src"), "fold").agg(F.count("*").alias("n"), *[F.sum(F.array_contains("ls", i).cast("long")).alias(f"s{i}") for i in range(k)]).toArrow()
    chain = Chain(list(subjects), [])
    if not held.num_rows or not k:
        return chain
    of_fold, of_source = held.column("fold").to_numpy(), held.column("src").to_pylist()
    counts = np.stack([held.column(f"s{i}").to_numpy() for i in range(k)] + [held.column("n").to_numpy()], axis=1).astype(float)
    rows = np.array([counts[of_fold == part, k].sum() for part in range(FOLDS)])
    chain.prior = counts[:, :k].sum(axis=0) / rows.sum()
    chain.order = np.argsort(-chain.prior, kind="stable")
    lexicons, chains = _learn_lexicons(read, k), []
    for part in range(FOLDS + 1):  # the last has learnt from all
        own = copy.copy(chain)
        own.lexicon = Lexicon(*lexicons[part])
        by_source: dict[str, np.ndarray] = {}
        for i in np.nonzero(of_fold != part)[0].tolist():
            by_source.setdefault(of_source[i], np.zeros(k + 1))[:] += counts[i]
        own.sources = source_odds(by_source, own.prior)
        chains.append(own)
    return _fit(chains, labelled, rows)


def _learn_lexicons(read: DataFrame, k: int) -> list[tuple[list[str], np.ndarray]]:
    """Words and their log-odds: for each fold from the labels of the others, and from all, with what stands beside known words in four readings."""
    sums = [F.sum(f"c{i}").alias(f"c{i}") for i in range(k + 1)]
    schema = pa.schema([("word", pa.string()), ("part", pa.int32())] + [(f"c{i}", pa.int64()) for i in range(k + 1)])
    context, shared = read.sparkSession.sparkContext, None
    found: list[tuple[list[str], np.ndarray]] = []

    def count(batches):
        at_word, cells = ({}, None) if shared is None else shared.value
        seen: dict[str, int] = {"": 0}  # which is no word: the sentences themselves
        total = np.zeros((1024, FOLDS + 1, k + 1), np.int64)

        def held():
            for part in range(FOLDS + 1):
                used = np.nonzero(total[: len(seen), part].any(axis=1))[0]
                words = list(seen)
                yield batch(schema, pa.array([words[i] for i in used.tolist()], pa.string()), np.full(len(used), part), *total[used, part].T)

        for whole in batches:
            for b in (whole.slice(i, 5000) for i in range(0, whole.num_rows, 5000)):
                r, fold = Read.of(b.column("words"), b.column("sizes")), b.column("fold").to_numpy(zero_copy_only=False)
                if not len(r.starts):
                    continue
                if shared is None:
                    several = b.column("ls").to_pylist()
                    one = np.array([len(x or []) == 1 for x in several])
                    kind = np.array([x[0] if x else 0 for x in several])[r.doc]
                else:
                    codes = np.array([at_word.get(w, len(at_word)) for w in r.words])
                index = np.array([seen.setdefault(w, len(seen)) for w in r.words])
                if len(seen) > len(total):
                    total = np.concatenate([total, np.zeros((max(len(seen) - len(total), len(total)), *total.shape[1:]), np.int64)])
                for part in range(FOLDS + 1):
                    taught = fold != part
                    of, sentences_ = r.counts(kind if shared is None else r.classes(cells[part][codes]), k, (taught & one if shared is None else taught)[r.doc])
                    total[index, part] += of.astype(np.int64)
                    total[0, part] += sentences_.astype(np.int64)
                if len(seen) * total.shape[1] * total.shape[2] > HELD_CELLS:
                    yield from held()
                    seen, total = {"": 0}, np.zeros_like(total[:1024])
        yield from held()

    for turn in range(4):
        source = read.where("size(ls) = 1") if turn == 0 else read
        got = source.select("fold", "ls", "words", "sizes").mapInArrow(count, ", ".join(["word string", "part int", *[f"c{i} long" for i in range(k + 1)]])).groupBy("word", "part").agg(*sums)
        got = got.where(" + ".join(f"c{i}" for i in range(k + 1)) + " >= 3 or word = ''").toArrow()
        if shared is not None:
            shared.unpersist()
        part, words = got.column("part").to_numpy(), np.array(got.column("word").to_pylist(), object)
        c, found = np.stack([got.column(f"c{i}").to_numpy() for i in range(k + 1)], axis=1).astype(float).reshape(len(part), k + 1), []
        for p in range(FOLDS + 1):
            mine = np.nonzero(part == p)[0]
            mine = mine[np.argsort(words[mine], kind="stable")]
            totals = c[mine[words[mine] == ""]].sum(axis=0)
            mine = mine[words[mine] != ""]
            found.append((words[mine].tolist(), log_odds(c[mine], totals)))
        every = {w: i for i, w in enumerate(sorted({w for ws, _ in found for w in ws}))}
        cells = np.zeros((FOLDS + 1, len(every) + 1, k))
        for p, (ws, odds) in enumerate(found):
            cells[p, [every[w] for w in ws]] = odds
        shared = context.broadcast((every, cells)) if turn < 3 else None
    return found


def _fit(chains: list[Chain], labelled: DataFrame, rows: np.ndarray) -> Chain:
    """The chain that has learnt from all, with its regressions and their calibration, from the features that the others give the documents of their folds. ``rows``: labelled documents by fold."""
    chain, k = chains[-1], len(chains[-1].subjects)
    context, order = labelled.sparkSession.sparkContext, chains[-1].order
    learnt = context.broadcast(chains[:FOLDS])

    def examples(batches):
        schema = pa.schema([("fold", pa.int32()), ("x", pa.list_(pa.float64()))])
        for whole in batches:
            for b in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                fold = b.column("fold").to_numpy()
                for part in np.unique(fold).tolist():
                    mine = b.filter(pa.array(fold == part))
                    texts, ls = mine.column("t").to_pylist(), mine.column("ls").to_pylist()
                    own, everywhere = learnt.value[part].features([sentences(t) for t in texts], mine.column("src").to_pylist(), texts)
                    y = np.zeros((len(ls), k))
                    for i, x in enumerate(ls):
                        y[i, x] = 1
                    flat = np.concatenate([own.reshape(len(ls), -1), everywhere, y], axis=1)
                    yield batch(schema, np.full(len(ls), part), lists_of(flat))

    held = stage_table(labelled.select("fold", "src", "t", "ls").mapInArrow(examples, "fold int, x array<double>"), "examples")

    def over(each) -> dict:
        """The sums of what ``each`` gives, by name, for the folds, features, structure and labels of the examples."""

        def add(batches):
            total: dict[int, np.ndarray] = {}
            for b in batches:
                if not b.num_rows:
                    continue
                x = pc.list_flatten(b.column("x")).to_numpy().reshape(b.num_rows, -1)
                own, everywhere, y = x[:, : k * FEATURES].reshape(len(x), k, FEATURES), x[:, k * FEATURES : k * FEATURES + 3], x[:, k * FEATURES + 3 :]
                for name, v in each(b.column("fold").to_numpy(), own, everywhere, y):
                    total[name] = total[name] + v if name in total else v
            schema = pa.schema([("name", pa.int32()), ("v", pa.list_(pa.float64()))])
            if total:
                yield batch(schema, np.array(list(total)), pa.array([v.tolist() for v in total.values()], schema.field("v").type))

        out: dict[int, np.ndarray] = {}
        for name, v in held.mapInArrow(add, "name int, v array<double>").collect():
            out[name] = out[name] + np.array(v) if name in out else np.array(v)
        return out

    def seen(n: int, own, everywhere, y) -> np.ndarray:
        """What the regression of step ``n`` sees."""
        return np.concatenate([own[:, order[n]], everywhere, y[:, order[:n]], np.ones((len(y), 1))], axis=1)

    def flat(slopes) -> np.ndarray:
        return np.concatenate([slopes[0], slopes[1].reshape(-1)])

    def sums(each, ws: dict) -> dict:
        got = over(each)
        none = {i: np.zeros(len(w) * (len(w) + 1)) for i, w in ws.items()}
        return {i: (v[: len(ws[i])], v[len(ws[i]) :].reshape(len(ws[i]), -1)) for i, v in (none | got).items()}

    def weights(ws: dict) -> dict:
        def each(fold, own, everywhere, y):
            for n in range(k):
                mine = [i for i in ws if i // (FOLDS + 1) == n]
                x = seen(n, own, everywhere, y) if mine else None
                for i in mine:
                    rest = fold != i % (FOLDS + 1)
                    yield i, flat(_slopes(x[rest], y[rest, order[n]], ws[i]))

        return sums(each, ws)

    fitted = _newton(weights, [FEATURES + 3 + n + 1 for n in range(k) for _ in range(FOLDS + 1)], 1.0)
    fitted = [fitted[n * (FOLDS + 1) : (n + 1) * (FOLDS + 1)] for n in range(k)]
    chain.weights = [x[FOLDS] for x in fitted]
    judges = [[x[part] if rows.sum() > rows[part] else x[FOLDS] for part in range(FOLDS)] for x in fitted]

    def judged(n: int, fold, own, everywhere, y) -> np.ndarray:
        """The logit of each example, by the weights of the other folds, and 1."""
        x, z = seen(n, own, everywhere, y), np.zeros(len(y))
        for part in range(FOLDS):
            z[fold == part] = x[fold == part] @ judges[n][part]
        return np.stack([z, np.ones(len(z))], axis=1)

    def scales(ws: dict) -> dict:
        return sums(lambda fold, own, everywhere, y: [(n, flat(_slopes(judged(n, fold, own, everywhere, y), y[:, order[n]], w))) for n, w in ws.items()], ws)

    told = [0 < chain.prior[s] < 1 for s in order]
    chain.scale = [w if t else np.array([1.0, 0.0]) for w, t in zip(_newton(scales, [2] * k, 1e-3), told)]

    def bins(fold, own, everywhere, y):
        for n in range(k):
            p = 1 / (1 + np.exp(-np.clip(judged(n, fold, own, everywhere, y) @ chain.scale[n], -30, 30)))
            at = np.minimum((p * 10).astype(int), 9)
            yield 0, np.concatenate([np.bincount(at, minlength=10), np.bincount(at, p, 10), np.bincount(at, y[:, order[n]], 10)])

    size, given, true = over(bins)[0].reshape(3, 10)
    chain.calibration_error = float(np.abs(given - true).sum() / max(size.sum(), 1))
    learnt.unpersist()
    return chain


def assign_subjects(documents: DataFrame, key: str, text: str, source: str, chain: Chain) -> DataFrame:
    """``id, subject, probability`` of every document and subject that the chain gives it. NULL and empty texts, and texts without prose on any subject, give no rows. A repeated row is assigned each time."""
    schema = pa.schema([("id", pa.int64()), ("subject", pa.string()), ("probability", pa.float64())])
    shared = documents.sparkSession.sparkContext.broadcast(chain)

    def assign(batches):
        for whole in batches:
            for b in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                mask, worth = shared.value.decode(b.column(1).to_pylist(), b.column(2).to_pylist())
                row, s = np.nonzero(mask)
                yield batch(schema, b.column(0).take(pa.array(row)), pa.array([shared.value.subjects[i] for i in s.tolist()], pa.string()), worth[row])

    return documents.select(F.col(key).cast("long"), F.col(text).cast("string"), F.col(source).cast("string")).mapInArrow(assign, "id long, subject string, probability double")


