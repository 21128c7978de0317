"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over all words through an inverted index."""

from __future__ import annotations

import hashlib
import math
import pickle
import re
import string
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireframe.llm.common import Cut, new_folder, store_of

BETWEEN_WORDS = re.compile(r"\W+")
#: What a run stands for that is no single term: none, not known yet, and from there down the others.
NOTHING, NEW, OTHER = -1, -2, -3
MARKS = string.punctuation.replace("_", "")  # characters of no word that often stand around one
TOGETHER = 4 << 20  # bytes of texts whose runs are looked up together
#: Lengths of the word beginnings that are terms beside whole words (a term with an asterisk is a beginning).
BEGINNINGS = (4, 5, 6, 7)
#: A beginning's so manieth occurrence in a text is a term of its own (its number stands after the asterisk): a chance
#: word may begin like a bad one, several in one text seldom do.
OCCURRENCES = (2, 3, 4)
#: How much longer the markers' part of a vector is than its words' part.
MARKED = 2.0
#: The cosine from which an example counts as a near copy of a text.
COPY = 0.98
SCORES = "doc_id long, held_out boolean, score double, predicted int, evidence array<long>, cosines array<double>"


def held_out(doc_id: Column) -> Column:
    """True for the rows whose labels nothing is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def word_counts(text: str | None) -> Counter:
    words = Counter(BETWEEN_WORDS.split((text or "").lower()))
    words.pop("", None)
    return words


def terms_of(text: str | None) -> set[str]:
    """All words of a text in lower case, their beginnings, and the further occurrences of beginnings."""
    words = word_counts(text)
    begun: Counter = Counter()
    for w, n in words.items():
        for k in BEGINNINGS:
            if len(w) > k:
                begun[f"{w[:k]}*"] += n
    return {*words, *begun} | {f"{b}{o}" for b, n in begun.items() for o in OCCURRENCES if n >= o}


class Tally:
    """In how many toxic and other texts each of terms_of() is; texts are taken many at a time."""

    def __init__(self):
        self.texts = np.zeros(2, np.int64)
        self.words: dict[str, int] = {}
        self.stems: dict[str, int] = {}
        self.stem_of: list[list[int]] = [[] for _ in BEGINNINGS]  # of each word, -1 where it is too short
        self.seen: dict[int, np.ndarray] = {}  # by occurrence (0: whole words), a row for each label

    def add(self, texts: list[str | None], toxic: list[int]) -> None:
        label = np.array(toxic, np.int64)
        self.texts += np.bincount(label, minlength=2)
        found = [word_counts(t) for t in texts]
        for w in {w for own in found for w in own if w not in self.words}:
            self.words[w] = len(self.words)
            for k, stem_of in zip(BEGINNINGS, self.stem_of, strict=True):
                stem_of.append(self.stems.setdefault(f"{w[:k]}*", len(self.stems)) if len(w) > k else -1)
        text = np.repeat(np.arange(len(found)), [len(own) for own in found])
        word = np.array([self.words[w] for own in found for w in own], np.int64)
        number = np.array([n for own in found for n in own.values()], np.int64)
        self._put(0, label[text], word)
        for stem_of in self.stem_of:
            stem = np.array(stem_of, np.int64)[word]
            long = stem >= 0
            keys, at = np.unique(text[long] * (len(self.stems) or 1) + stem[long], return_inverse=True)
            many = np.bincount(at, number[long], len(keys))
            begun, stem = np.divmod(keys, len(self.stems) or 1)
            for o in (1, *OCCURRENCES):
                self._put(o, label[begun[many >= o]], stem[many >= o])

    def _put(self, occurrence: int, label: np.ndarray, term: np.ndarray) -> None:
        size = len(self.stems if occurrence else self.words)
        now = np.bincount(label * size + term, minlength=2 * size).reshape(2, size)
        if occurrence in self.seen:
            now[:, : self.seen[occurrence].shape[1]] += self.seen[occurrence]
        self.seen[occurrence] = now

    def rows(self) -> Iterator[tuple[str, int, int]]:
        """(term, toxic, other), and "" for the texts themselves."""
        yield "", int(self.texts[1]), int(self.texts[0])
        for o, seen in self.seen.items():
            for term, toxic, other in zip(self.stems if o else self.words, seen[1].tolist(), seen[0].tolist(), strict=False):
                if toxic or other:
                    yield term + str(o) * (o > 1), toxic, other


UPTO = np.arange(1 << 16)


def ranges(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [first, first + many) in a row."""
    steps = np.repeat(first - np.cumsum(many) + many, many)
    global UPTO
    if len(UPTO) < len(steps):
        UPTO = np.arange(2 * len(steps))
    steps += UPTO[: len(steps)]
    return steps


@dataclass
class Index:
    """Labelled examples as unit TF-IDF vectors over all their words, equal vectors as one entry with counts of both labels.

    The last ``marks`` terms of the vocabulary are the markers of toxic examples; where a text has some, they make a
    second part of its vector, MARKED times as long as the words' part.

    The ``width`` commonest terms have a row each of a dense matrix, so one product gives their share of the cosines of
    many texts in single precision; the other terms' posting lists give the rest in double precision. The largest of each
    ``block`` entries give a threshold that the k best reach, and for entries that can be among the k best the commonest
    terms' share is worked out in double precision, too. So the result is exact.
    """

    vocabulary: list[str]
    idf: np.ndarray
    k: int = 16
    width: int = 512
    block: int = 64
    prior: float = 0.5
    marks: int = 0
    clear: tuple[int, int] = (0, 0)  # toxic and other examples without any word
    clear_ids: list[int] = field(default_factory=list)
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0))
    other: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ids: list[int] = field(default_factory=list)
    keys: dict[bytes, int] = field(default_factory=dict)  # an entry by its counts' digest
    steps: tuple[list[float], list[float]] | None = None

    def vector(self, counts) -> tuple[np.ndarray, np.ndarray]:
        """(terms, weights) of ((term, count), ...)."""
        pairs = np.asarray(counts, np.int64).reshape(-1, 2)
        terms = pairs[:, 0]
        weights = (1 + np.log(pairs[:, 1])) * self.idf[terms]
        marked = terms >= len(self.idf) - self.marks
        if marked.any() and not marked.all():
            weights[marked] *= MARKED * np.linalg.norm(weights[~marked]) / np.linalg.norm(weights[marked])
        return terms, weights / np.linalg.norm(weights)

    @staticmethod
    def key(counts) -> bytes:
        return hashlib.sha1(np.asarray(counts, np.int64).tobytes()).digest()

    def build(self, examples: Iterable[tuple]) -> None:
        """examples: (doc_id, toxic, counts)."""
        tallies: list[list[int]] = []
        rows, seen, good = [], 0, 0
        clear, clear_ids = [0, 0], []
        for doc_id, toxic, counts in examples:
            seen, good = seen + 1, good + toxic
            if not len(counts):
                clear[0 if toxic else 1] += 1
                clear_ids = [min([doc_id, *clear_ids])]
                continue
            e = self.keys.setdefault(self.key(counts), len(tallies))
            if e == len(tallies):
                tallies.append([0, 0, doc_id])
                terms, weights = self.vector(counts)
                rows.append((terms.astype(np.int32), weights))
            tallies[e][0 if toxic else 1] += 1
            tallies[e][2] = min(tallies[e][2], doc_id)
        self.clear, self.clear_ids = (clear[0], clear[1]), clear_ids
        self.prior = (good + 0.5) / (seen + 1)
        n = len(tallies)
        self.toxic, self.other = (np.array([t[i] for t in tallies], np.float64) for i in (0, 1))
        self.ids = [t[2] for t in tallies]
        entry = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t, _ in rows])
        terms = np.concatenate([np.zeros(0, np.int32), *(t for t, _ in rows)])
        weights = np.concatenate([np.zeros(0), *(w for _, w in rows)])
        del rows
        common = np.sort(np.argsort(-np.bincount(terms, minlength=len(self.idf)), kind="stable")[: self.width])
        self.place = np.full(len(self.idf), -1, np.int32)  # a term's row in the dense matrices
        self.place[common] = np.arange(len(common))
        at = self.place[terms]
        own = at >= 0
        # What each entry has in the dense matrix, in double precision.
        self.rows, self.weights = at[own], weights[own]
        self.starts = np.searchsorted(entry[own], np.arange(n + 1))
        self.dense = np.zeros((len(common), -(-n // self.block) * self.block), np.float32)
        self.dense[self.rows, entry[own]] = self.weights
        rest = np.nonzero(~own)[0]
        rest = rest[np.argsort(terms[rest], kind="stable")]
        self.posted, self.posted_weights = entry[rest], weights[rest]
        self.first = np.searchsorted(terms[rest], np.arange(len(self.idf) + 1))

    def all_nearest(self, queries: list, without: list[tuple[int, int] | None] | None = None) -> list[list[tuple[int, float, float, float]]]:
        """nearest() of each query, with one matrix product for all of them."""
        n, m = len(self.ids), len(queries)
        if not m or not n:
            return [[] for _ in queries]
        vectors = [self.vector(c) for c in queries]
        wide = np.zeros((m, len(self.dense)))
        for own, (terms, weights) in zip(wide, vectors, strict=True):
            at = self.place[terms]
            own[at[at >= 0]] = weights[at >= 0]
        rough = wide.astype(np.float32) @ self.dense

        def least_of(scores: np.ndarray) -> float:
            """The score of the one after the k best, which may be needed where one example is left out."""
            return max(0.0, float(np.partition(scores, len(scores) - self.k - 1)[len(scores) - self.k - 1]) - 1e-4) if len(scores) > self.k else 0.0

        out = []
        for i, (terms, weights) in enumerate(vectors):
            leave = without[i] if without else None
            first = self.first[terms]
            many = self.first[terms + 1] - first
            at = ranges(first, many)
            rest = np.bincount(self.posted[at], self.posted_weights[at] * np.repeat(weights, many), rough.shape[1])
            row = rough[i] + rest
            found = np.nonzero(row[:n] > least_of(row.reshape(-1, self.block).max(axis=1)))[0]
            found = found[row[found] > least_of(row[found])]
            if not len(found):
                out.append([])
                continue
            score = rest[found] + [wide[i, self.rows[a:b]] @ self.weights[a:b] for a, b in zip(self.starts[found].tolist(), self.starts[found + 1].tolist(), strict=True)]
            order = np.lexsort((found, -score))
            found, score = found[order], score[order]
            size = self.toxic[found] + self.other[found]
            if leave:
                size = size - (found == leave[0])
            enough = np.searchsorted(np.cumsum(size), self.k)
            keep = score >= score[min(enough, len(score) - 1)] - 1e-9
            near = []
            for e, s in zip(found[keep].tolist(), score[keep].tolist(), strict=True):
                a, b = self.toxic[e], self.other[e]
                if leave and e == leave[0]:
                    a, b = a - leave[1], b - (1 - leave[1])
                if a + b > 0:
                    near.append((e, min(1.0, s), a, b))
            out.append(near)
        return out

    def nearest(self, counts, without: tuple[int, int] | None = None) -> list[tuple[int, float, float, float]]:
        """(entry, cosine, toxic, other) of the k nearest examples and all that tie with the last, best first.

        without: (entry, label), one example to leave out.
        """
        return self.all_nearest([counts], [without])[0]

    def vote(self, near: list[tuple[int, float, float, float]], before: float | None = None) -> float:
        """Examples vote with 1 / (0.05 + distance), the distance being 1 - cosine; ``before``, or the prior, has one vote."""
        good = (self.prior if before is None else before) + sum(a / (1.05 - s) for _, s, a, _ in near)
        return good / (1 + sum((a + b) / (1.05 - s) for _, s, a, b in near))

    def votes(self, examples: list[tuple]) -> list[tuple[float, int]]:
        """(vote, label) of the examples that have a word, each left out in its turn."""
        own = [(y, c) for _, y, c in examples if len(c)]
        near = self.all_nearest([c for _, c in own], [(self.keys[self.key(c)], y) for y, c in own])
        return [(self.vote(x), y) for x, (y, _) in zip(near, own, strict=True)]

    def calibrate(self, examples: list[tuple]) -> None:
        self.fit_steps(self.votes(examples))

    def fit_steps(self, votes: list[tuple[float, int]]) -> None:
        """Fit monotone steps (pool adjacent violators) from votes to rates."""
        pools: list[list[float]] = []  # lowest and highest vote, toxic, all
        for v, y in sorted(votes):
            pools.append([v, v, y, 1])
            while len(pools) > 1 and (pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3] or pools[-2][1] == pools[-1][0]):
                last = pools.pop()
                pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
        if pools:
            x = [v for p in pools for v in (p[0], p[1])]
            y = [(p[2] + 0.5) / (p[3] + 1) for p in pools for _ in range(2)]
            self.steps = (x, np.maximum.accumulate(y).tolist())

    def scores(self, queries: list) -> list[tuple[float, list[int], list[float]]]:
        """For each: calibrated score, and up to 5 nearest examples with their cosines.

        Steps come from examples without their copies, so near copies of a text vote once more, after the steps."""
        found = iter(self.all_nearest([c for c in queries if len(c)]))
        out = []
        for counts in queries:
            if not len(counts):
                toxic, other = self.clear
                out.append(((toxic + self.prior) / (toxic + other + 1), list(self.clear_ids), [1.0] * len(self.clear_ids)))
                continue
            near = next(found)
            raw = self.vote(near)
            if self.steps:
                raw = float(np.interp(raw, *self.steps))
            raw = self.vote([x for x in near if x[1] >= COPY], raw)
            out.append((raw, [self.ids[e] for e, *_ in near[:5]], [s for _, s, *_ in near[:5]]))
        return out

    def score(self, counts) -> tuple[float, list[int], list[float]]:
        return self.scores([counts])[0]


class Reader:
    """Counts a vocabulary's words and markers in texts; words that the vocabulary lacks are passed over.

    Words never reach over white space, so texts are split into runs there, and the distinct runs of many texts are looked
    up together, in lower case and without marks around them. Only those that are no plain words then, or begin like a
    marker, are taken one by one.
    """

    def __init__(self, vocabulary: list[str], marks: int = 0):
        self.own = len(vocabulary) - marks
        self.markers: dict[str, list[tuple[int, int]]] = {}  # by word or beginning: (term, the occurrence that it stands for)
        for i, term in enumerate(vocabulary[self.own :], self.own):
            stem, star, occurrence = term.partition("*")
            self.markers.setdefault(stem + star, []).append((i, int(occurrence or 1)))
        marked = np.nonzero(self._marked(pa.array(vocabulary[: self.own], pa.string())))[0].tolist()
        self.marked = {vocabulary[i]: i for i in marked}  # the words that are markers or begin like one
        self.code = {w: i for i, w in enumerate(vocabulary[: self.own]) if w not in self.marked}

    def _marked(self, words: pa.Array) -> np.ndarray:
        """Which of the words are markers or begin like one."""
        out = np.zeros(len(words), bool)
        if self.markers:
            stems = pa.array([x.removesuffix("*") for x in self.markers], pa.string())
            for some in (words, *(pc.utf8_slice_codeunits(words, 0, k) for k in BEGINNINGS)):
                out |= pc.is_in(some, value_set=stems).to_numpy(zero_copy_only=False)
        return out

    def _run(self, run: str) -> tuple[list[int], list[str]]:
        """(words of the vocabulary, stems of markers) in a run without white space."""
        low = run.lower()
        bare = low.strip(MARKS)
        words = [bare] if bare.isalnum() else [w for w in BETWEEN_WORDS.split(low) if w]
        stems = [x for w in words for x in (w, *(f"{w[:k]}*" for k in BEGINNINGS if len(w) > k)) if x in self.markers] if self.markers else []
        return [t for w in words if (t := self.marked.get(w, -1)) >= 0 or (t := self.code.get(w, -1)) >= 0], stems

    def counts(self, text: str | None) -> np.ndarray:
        """all_counts() of one text."""
        return next(self.all_counts([text]))

    def all_counts(self, texts: pa.Array | list[str | None]) -> Iterator[np.ndarray]:
        """For each text (term, count) rows by term; a beginning counts where a longer word goes on, and its further
        occurrences once. A null text is empty."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
        at = 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, "right")))
            yield from self._together(texts.slice(at, upto - at))
            at = upto

    def _together(self, texts: pa.Array) -> list[np.ndarray]:
        split = pc.utf8_split_whitespace(texts)
        runs = split.flatten().dictionary_encode()
        bare = pc.utf8_trim(pc.ascii_lower(runs.dictionary), MARKS)
        codes = np.fromiter(map(self.code.get, bare.to_numpy(zero_copy_only=False), repeat(NEW)), np.int64, len(bare))
        new = np.nonzero(codes == NEW)[0]
        rest = bare.take(pa.array(new))
        plain = pc.match_substring_regex(rest, "^[0-9a-zß-öø-ÿ]*$").to_numpy(zero_copy_only=False) & ~self._marked(rest)
        codes[new[plain]] = NOTHING
        others: list[tuple[list[int], list[str]]] = []
        for at, run in zip(new[~plain].tolist(), runs.dictionary.take(pa.array(new[~plain])).to_pylist(), strict=True):
            words, begun = self._run(run)
            if len(words) < 2 and not begun:
                codes[at] = words[0] if words else NOTHING
            else:
                codes[at] = OTHER - len(others)
                others.append((words, begun))
        code = codes[runs.indices.to_numpy()]
        text = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
        wide = self.own or 1
        keys, numbers = np.unique((text * wide + code)[code >= 0], return_counts=True)
        first = np.searchsorted(keys, np.arange(len(texts) + 1) * wide).tolist()
        out = [np.stack([keys[a:b] - i * wide, numbers[a:b]], axis=1) for i, (a, b) in enumerate(zip(first, first[1:], strict=False))]
        more: dict[int, list[int]] = defaultdict(list)
        odd = np.nonzero(code <= OTHER)[0]
        for i, c in zip(text[odd].tolist(), code[odd].tolist(), strict=True):
            more[i].append(OTHER - c)
        for i, found in more.items():
            own, stems = dict(out[i].tolist()), Counter()
            for o in found:
                for t in others[o][0]:
                    own[t] = own.get(t, 0) + 1
                stems.update(others[o][1])
            for x, n in stems.items():
                own |= {t: n if o == 1 else 1 for t, o in self.markers[x] if n >= o}
            out[i] = np.array(sorted(own.items()), np.int64).reshape(-1, 2)
        return out


@dataclass
class Stored:
    """An index in the shared folder, and the steps from votes to rates."""

    path: str
    steps: tuple[list[float], list[float]] | None = None

    def open(self) -> Index:
        """A worker reads an index once, and then needs no reader of another vocabulary."""
        if self.path not in OPENED:
            OPENED.clear()
            READERS.clear()
            OPENED[self.path] = _kept(self.path)
        OPENED[self.path].steps = self.steps
        return OPENED[self.path]

    def reader(self) -> Reader:
        index = self.open()
        if self.path not in READERS:
            READERS.clear()
            READERS[self.path] = Reader(index.vocabulary, index.marks)
        return READERS[self.path]


OPENED: dict[str, Index] = {}
READERS: dict[str, Reader] = {}


def opened(index: Index | Stored) -> tuple[Index, Reader]:
    return (index.open(), index.reader()) if isinstance(index, Stored) else (index, Reader(index.vocabulary, index.marks))


def _keep(folder: str, name: str, what) -> str:
    """Pickle something into a new file of a shared folder and return its path."""
    system, at = store_of(folder)
    system.create_dir(at, recursive=True)
    path = f"{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(f"{at}/{path}") as out:
        pickle.dump(what, out, 5)
    return f"{folder}/{path}"


def _kept(path: str):
    system, at = store_of(path)
    with system.open_input_stream(at) as source:
        return pickle.load(source)


def in_groups(items: list, size: int = 128) -> Iterator[list]:
    for at in range(0, len(items), size):
        yield items[at : at + size]


COUNTED = "doc_id long, held_out boolean, counts binary"


def packed(counts: np.ndarray) -> bytes:
    """(term, count) rows as 32-bit numbers: the steps from term to term, then the counts."""
    return np.concatenate([np.diff(counts[:, 0], prepend=0), counts[:, 1]]).astype("<i4").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    steps, numbers = np.frombuffer(raw, "<i4").reshape(2, -1)
    return np.stack([np.cumsum(steps, dtype=np.int64), numbers], axis=1)


def text_digest(docs: DataFrame) -> Column:
    """A text's SHA-256 (hexadecimal); a null one counts as empty."""
    return F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256)


def count_terms(docs: DataFrame, vocabulary: str, marks: int, digests: bool = False) -> DataFrame:
    """(doc_id, held_out, counts): the packed() counts of a stored vocabulary's terms in each row's whole text.

    With ``digests`` there is a fourth column, digest, by which decisions on texts find their rows (see clean()).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = READERS.get(vocabulary)
        if reader is None:
            READERS.clear()
            OPENED.clear()
            reader = READERS.setdefault(vocabulary, Reader(_kept(vocabulary), marks))
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                counts = pa.array(map(packed, reader.all_counts(b.column(2))), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), counts, *b.columns[3:]], names=["doc_id", "held_out", "counts", *b.schema.names[3:]])
            pa.default_memory_pool().release_unused()

    own = [text_digest(docs).alias("digest")] if digests else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"), *own)
    return rows.mapInArrow(run, COUNTED + ", digest string" * digests)


def document_frequencies(counted: DataFrame) -> DataFrame:
    """(term, n): in how many rows of count_terms() each term is; term -1 has the number of rows.

    Each task adds its rows up, so at most a row for each task and term is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(0, np.int64), 0
        for b in batches:
            rows += b.num_rows
            found = np.bincount(np.concatenate([np.zeros(0, np.int64), *(unpacked(x)[:, 0] for x in b.column(0).to_pylist())]))
            if len(found) < len(seen):
                seen[: len(found)] += found
            else:
                found[: len(seen)] += seen
                seen = found
        terms = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(terms, -1).astype(np.int32)), pa.array(np.append(seen[terms], rows))], names=["term", "n"])

    return counted.select("counts").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, most_examples: int = 20_000, k: int = 16) -> Index | Stored:
    """fit_and_count() without the counts."""
    cut = Cut(docs.sparkSession)
    index, counted = fit_and_count(docs, labels, most_examples, k, cut)
    if counted is not None:
        cut.drop(counted)
    return index


def fit_and_count(docs: DataFrame, labels: DataFrame, most_examples: int = 20_000, k: int = 16, cut: Cut | None = None, digests: bool = False) -> tuple[Index | Stored, DataFrame | None]:
    """An index of labelled examples, and count_terms() of all documents, from which score_counted() goes on.

    Learn from the labelled documents that are not held out, at most ``most_examples`` of them (by hash of doc_id).

    The vocabulary is all words of these examples, and as markers the terms that mark toxic examples beyond chance (a
    Chernoff bound over all terms seen); a word with a chosen beginning that is as precise is no marker of its own.
    Terms weigh by how few of all documents have them. A label above zero is toxic, any other is not, null ones are
    passed over; of several labels of one document the largest counts, of several rows of one doc_id the least text.
    One task builds the index and writes it into the shared folder; its size is bounded by the examples. Without
    examples of both kinds there is nothing to count (None).
    """
    cut = cut or Cut(docs.sparkSession)
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    toxic = F.coalesce(F.max(F.col("toxic").cast("int") > 0), F.lit(False)).cast("int").alias("toxic")
    chosen = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_examples)
    # At most most_examples rows of two numbers.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(cut(chosen, "chosen")), "doc_id")
    texts = cut(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), "examples")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                tally.add(*(x.to_pylist() for x in b.slice(at, 512).columns))
        terms, toxic, other = zip(*tally.rows(), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(toxic, pa.int64()), pa.array(other, pa.int64())], names=["term", "toxic", "other"])

    tallied = cut(texts.select("text", "toxic").mapInArrow(count, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")), "terms")
    whole = tallied.where("term = ''").first()
    toxic, other = (whole.toxic, whole.other) if whole else (0, 0)
    if not toxic or not other:
        cut.drop(texts, tallied)
        return Index([], np.zeros(0), prior=(toxic + 0.5) / (toxic + other + 1), clear=(toxic, other)), None
    rate = toxic / (toxic + other)
    p, n = F.col("toxic") / (F.col("toxic") + F.col("other")), F.col("toxic") + F.col("other")
    excess = n * (p * F.log(p / rate) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - rate))).otherwise(0))
    good = tallied.where((F.col("term") != "") & (p > max(0.5, rate)) & (excess >= math.log(100 * tallied.count()))).collect()
    precision = {r.term: r.toxic / (r.toxic + r.other) for r in good}

    def covered(term: str) -> bool:
        stem, _, occurrence = term.partition("*")
        return any(precision.get(f"{stem[:k]}*{occurrence}", -1) >= precision[term] for k in BEGINNINGS if k < len(stem))

    markers = sorted(r.term for r in good if not covered(r.term))
    folder = new_folder(docs.sparkSession, "index")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [w for b in batches for w in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([_keep(folder, "vocabulary", [*words, *markers])])], names=["path"])

    # The words of at most most_examples texts.
    words = tallied.where("term != '' AND instr(term, '*') = 0").select("term").repartition(1).sortWithinPartitions("term")
    vocabulary = words.mapInArrow(number, "path string").first().path
    counted = cut(count_terms(docs, vocabulary, len(markers), digests), "counted")
    frequencies = cut(document_frequencies(counted), "frequencies")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(_kept(vocabulary)) + 1)  # the last one, -1, is the number of rows
        for b in batches:
            seen[b.column(0).to_numpy()] = b.column(1).to_numpy()
        idf = np.log((seen[-1] + 1) / (seen[:-1] + 1)) + 1
        yield pa.RecordBatch.from_arrays([pa.array([_keep(folder, "weights", idf)])], names=["path"])

    weights = frequencies.repartition(1).mapInArrow(weigh, "path string").first().path  # a number for each word

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        READERS.clear()
        index = Index(_kept(vocabulary), _kept(weights), k=k, marks=len(markers))
        reader = Reader(index.vocabulary, index.marks)
        index.build((d, y, c) for b in batches for d, c, y in zip(b.column(0).to_pylist(), reader.all_counts(b.column(1)), b.column(2).to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([_keep(folder, "index", index)])], names=["path"])

    # At most most_examples texts, which the task reads batch by batch.
    ordered = texts.repartition(1).sortWithinPartitions("doc_id")
    stored = Stored(ordered.select("doc_id", "text", "toxic").mapInArrow(build, "path string").first().path)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index, reader = opened(stored)
            found = []
            for group in in_groups([(0, y, c) for c, y in zip(reader.all_counts(b.column(0)), b.column(1).to_pylist(), strict=True)]):
                found += index.votes(group)
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in found], pa.float64()), pa.array([y for _, y in found], pa.int32())], names=["vote", "toxic"])

    fitted = Index([], np.zeros(0))
    # At most most_examples rows of two numbers.
    fitted.fit_steps([tuple(r) for r in texts.select("text", "toxic").repartition(24).mapInArrow(votes, "vote double, toxic int").collect()])
    cut.drop(texts, tallied, frequencies)
    return Stored(stored.path, fitted.steps), counted


def of_texts(index: Index | Stored, texts: list[str | None]) -> list[tuple[float, list[int], list[float]]]:
    """Index.scores() of texts, equal ones worked out once."""
    own, reader = opened(index)
    known: dict = dict.fromkeys(texts)
    for group in in_groups(list(known)):
        known.update(zip(group, own.scores(list(reader.all_counts(group))), strict=True))
    return [known[t] for t in texts]


def _scored(b: pa.RecordBatch, out: list, threshold: float) -> pa.RecordBatch:
    scores = pa.array([s for s, _, _ in out], pa.float64())
    predicted = pa.array([int(s >= threshold) for s, _, _ in out], pa.int32())
    arrays = [b.column(0), b.column(1), scores, predicted, pa.array([e for _, e, _ in out], pa.list_(pa.int64())), pa.array([c for _, _, c in out], pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in SCORES.split(", ")])


def score(docs: DataFrame, index: Index | Stored, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence, cosines), one row per document.

    Only the text is scored, all of it: its words' counts are compared with all examples that share one. evidence has up
    to 5 nearest examples' doc_id, cosines how near they are. Null and empty texts, and texts without any word of an
    example, have the rate of examples without a word. Null ids stay null and are not held out; repeated rows come out as
    often; an empty table gives no rows; other columns are left out. Without labels of both kinds every score is the
    rate that the labels have (0.5 without any).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _scored(b, of_texts(index, b.column(2).to_pylist()), threshold)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCORES)


def score_counted(counted: DataFrame, index: Stored, threshold: float = 0.7) -> DataFrame:
    """score() of the rows of count_terms(), whose texts need not be read again; equal counts are worked out once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.open()
        for b in batches:
            rows = b.column(2).to_pylist()
            known: dict = dict.fromkeys(rows)
            for group in in_groups(list(known)):
                known.update(zip(group, own.scores([unpacked(x) for x in group]), strict=True))
            yield _scored(b, [known[x] for x in rows], threshold)

    return counted.select("doc_id", "held_out", "counts").mapInArrow(run, SCORES)


def toxic_digests(counted: DataFrame, index: Stored, threshold: float = 0.7) -> DataFrame:
    """(digest) of the texts in count_terms(digests=True) that score at or above the threshold, each once.

    A worker holds the index for a task and gives it back then, as what comes after needs the memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.open()
        try:
            for b in batches:
                rows = b.column(0).to_pylist()
                known: dict = dict.fromkeys(rows)
                for group in in_groups(list(known)):
                    known.update(zip(group, (s for s, *_ in own.scores([unpacked(x) for x in group])), strict=True))
                yield pa.RecordBatch.from_arrays([b.column(1).filter(pa.array([known[x] >= threshold for x in rows], pa.bool_()))], names=["digest"])
        finally:
            del own
            OPENED.clear()
            READERS.clear()

    return counted.select("counts", "digest").mapInArrow(run, "digest string").distinct()


def clean(docs: DataFrame, index: Index | Stored, threshold: float = 0.7, counted: DataFrame | None = None, cut: Cut | None = None) -> DataFrame:
    """The rows of docs whose text scores below the threshold, all their columns as they were.

    With ``counted`` (count_terms(digests=True) of docs) texts need not be read again: the digests of toxic texts are
    found from the counts, and rows go by an anti-join on their text's digest.
    """
    if counted is not None:
        cut = cut or Cut(docs.sparkSession)
        mark = "_" * (1 + max(map(len, docs.columns)))  # no column of docs begins like this
        toxic = cut(toxic_digests(counted, index, threshold), "toxic", (counted,)).withColumnRenamed("digest", f"{mark}digest")
        return docs.join(toxic, text_digest(docs) == F.col(f"{mark}digest"), "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [s < threshold for s, *_ in of_texts(index, b.column(b.schema.get_field_index("text")).to_pylist())]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
