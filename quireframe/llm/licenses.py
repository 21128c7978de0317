"""License scans: an inverted index of winnowed template fingerprints picks candidates, banded alignment measures them."""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from quireframe.llm.license_texts import TEMPLATES

WORD = re.compile(r"\w+")
BETWEEN = re.compile(r"\W+")
MATCH = pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("words", pa.int32()), ("coverage", pa.float64())])


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def winnow(words: list[str], k: int = 3, widest: int = 4, least: int = 8) -> list[int]:
    """Where the fingerprints of a template begin: of each window of shingles (``k`` words in a row) the one with the
    least hash, the last of equal ones. A window has ``widest`` shingles, or fewer where else the template would have
    less than ``least`` windows of its own."""
    n = max(1, len(words) - k + 1)
    window = max(1, min(widest, n // least))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k])) for i in range(n)]
    return sorted({min(range(at, at + window), key=lambda i: (hashes[i], -i)) for at in range(n - window + 1)})


def align(template: list[str], words: list[str], low: int, high: int) -> tuple[int, int, int, int]:
    """(score, matched words, first, last) of the best local alignment of a template with words, on diagonals low to high.

    The diagonal of template word i and word j is j - i. A match counts 2, a mismatch or a gap -1. Of equal alignments
    the one with more matches, the shorter and then the earlier one counts. first and last are places in words.
    """
    none = (0, 0, 0)
    best = (0, 0, 0, 0)
    width = high - low + 1
    before = [none] * (width + 2)
    for i, t in enumerate(template):
        row = [none] * (width + 2)
        for b in range(width):
            j = i + low + b
            if not 0 <= j < len(words):
                continue
            s, m, f = before[b + 1]  # places are shifted by one; the next row's diagonal has the same place
            if t == words[j]:
                new = (s + 2, m + 1, f if s else j)
            else:
                new = (s - 1, m, f)
            for s, m, f in (before[b + 2], row[b]):
                if (s - 1, m, f) > new:
                    new = (s - 1, m, f)
            if new[0] > 0:
                row[b + 1] = new
                if (new[0], new[1], new[2] - j, -j) > (best[0], best[1], best[2] - best[3], -best[3]):
                    best = (*new, j)
        before = row
    return best


@dataclass
class Run:
    """Fingerprints of a template that follow each other near one diagonal: first and last places, diagonals, how many."""

    first_i: int
    first_j: int
    last_i: int
    last_j: int
    low: int
    high: int
    last: int
    hits: int = 1


def runs_of(hits: list[tuple[int, int]], size: int, reach: int) -> list[Run]:
    """The runs of a template's hits (place in the template, place in the text), by place in the text.

    A hit goes on from the run with the nearest diagonal, at most ``reach`` away, that is not as far in the template.
    Open runs stand by diagonal; those too far behind in the text to go on are passed over.
    """
    out: list[Run] = []
    open_: dict[int, list[Run]] = {}
    for i, j in hits:
        d = j - i
        near = []
        for b in range(d // (reach + 1) - 1, d // (reach + 1) + 2):
            if own := open_.get(b):
                own[:] = [r for r in own if j - r.last_j <= size + reach]
                near += [r for r in own if r.last_i < i and abs(d - r.last) <= reach]
        if near:
            r = min(near, key=lambda r: (abs(d - r.last), -r.last_j))
            open_[r.last // (reach + 1)].remove(r)
            r.last_i, r.last_j, r.low, r.high, r.last, r.hits = i, j, min(d, r.low), max(d, r.high), d, r.hits + 1
        else:
            r = Run(i, j, i, j, d, d, d)
            out.append(r)
        open_.setdefault(r.last // (reach + 1), []).append(r)
    return out


def chains_of(runs: list[Run], size: int) -> list[list[Run]]:
    """Chains of two runs or more that follow each other in template and text with at most ``size`` words between:
    a template with something longer put in or left out. Each run takes the predecessor with most fingerprints."""
    runs = sorted(runs, key=lambda r: r.first_j)
    total, before = [r.hits for r in runs], [-1] * len(runs)
    for n, r in enumerate(runs):
        for m in range(n - 1, -1, -1):
            p = runs[m]
            if p.first_j < r.first_j - 3 * size:
                break
            if p.first_i < r.first_i and p.last_i < r.last_i and r.first_j - p.last_j <= size and r.hits + total[m] > total[n]:
                total[n], before[n] = r.hits + total[m], m
    out, used = [], set()
    for n in sorted(range(len(runs)), key=lambda n: (-total[n], n)):
        chain = []
        while n >= 0 and n not in used:
            used.add(n)
            chain.append(runs[n])
            n = before[n]
        if len(chain) > 1:
            out.append(chain[::-1])
    return out


@dataclass
class Templates:
    """License templates as words, and the inverted index of their fingerprints: phrase to (template, place)."""

    texts: dict[str, str]
    k: int = 3
    least: float = 0.8

    def __post_init__(self):
        import ahocorasick

        self.names = sorted(n for n in self.texts if words_of(self.texts[n]))
        self.words = [words_of(self.texts[n]) for n in self.names]
        postings: dict[str, list[tuple[int, int]]] = {}
        for t, words in enumerate(self.words):
            for i in winnow(words, self.k):
                postings.setdefault(" ".join(words[i : i + self.k]), []).append((t, i))
        self.index = ahocorasick.Automaton()
        for phrase, found in postings.items():
            self.index.add_word(f" {phrase} ", (len(phrase) + 1, found))
        if postings:
            self.index.make_automaton()

    def find(self, text: str | None) -> list[tuple[str, int, int, int, float]]:
        """(license, start, end, matched words, coverage) of every match, by start; start and end in code points.

        Runs of a template's fingerprints near one diagonal are candidates; the template is aligned in a band around each.
        Runs that follow each other are a candidate too, in a band around all of them: so a template with a clause put in
        or left out is matched by what it keeps. Coverage is the share of the template's words that match. Of matches that overlap the one with
        more matched words stays, then the one with the higher coverage, the earlier, the first by name.
        """
        if not text or not len(self.index):
            return []
        plain = f" {BETWEEN.sub(' ', text).strip().lower()} "
        hits = sorted((end - n, found) for end, (n, found) in self.index.iter(plain))
        if not hits:
            return []
        spans = [m.span() for m in WORD.finditer(text)]
        words = words_of(text)
        by_template: dict[int, list[tuple[int, int]]] = {}
        at, place = 0, 0
        for start, found in hits:
            place += plain.count(" ", at, start)
            at = start
            for t, i in found:
                by_template.setdefault(t, []).append((i, place))
        matches = []
        for t, own in by_template.items():
            reach, size = self._reach(t), len(self.words[t])
            runs = runs_of(own, size, reach)
            bands = [(r.low - reach, r.high + reach) for r in runs]
            bands += [(min(r.low for r in chain) - reach, max(r.high for r in chain) + reach) for chain in chains_of(runs, size)]
            for low, high in sorted(set(bands)):
                first = max(0, low)
                _, matched, a, b = align(self.words[t], words[first : max(first, high + size)], low - first, high - first)
                if matched >= self.least * size:
                    matches.append((matched, matched / size, first + a, first + b, self.names[t]))
        kept: list[tuple] = []  # by place; none overlaps another
        for matched, coverage, a, b, name in sorted(set(matches), key=lambda m: (-m[0], -m[1], m[2], m[3], m[4])):
            at = bisect(kept, (a,))
            if (at == 0 or kept[at - 1][1] < a) and (at == len(kept) or b < kept[at][0]):
                kept.insert(at, (a, b, name, matched, coverage))
        return [(name, spans[a][0], spans[b][1], matched, coverage) for a, b, name, matched, coverage in kept]

    def _reach(self, t: int) -> int:
        """How far an alignment may leave its fingerprints' diagonals: an eighth of the template, four words at least, less than all."""
        return min(max(4, len(self.words[t]) // 8), len(self.words[t]) - 1)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """(doc_id, matches array<struct<license, start, end, words, coverage>>), one row per document.

    Every shingle of the whole text is looked up in the index of the templates' fingerprints; a match covers at least
    ``least`` of a template's words. The index has the size of the templates, whatever the data; nothing is shuffled.
    Null and empty texts have no matches. Null ids stay null, repeated rows come out as often, an empty table gives no
    rows, other columns are left out. Without templates nothing matches.
    """
    texts = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(texts, least=least)
        names = [f.name for f in MATCH]
        for b in batches:
            found = [[dict(zip(names, m, strict=True)) for m in known.find(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(MATCH))], names=["doc_id", "matches"])

    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, matches array<struct<license string, start long, end long, words int, coverage double>>")
