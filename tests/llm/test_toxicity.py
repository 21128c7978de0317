import zlib

import numpy as np

from quireframe.llm import toxicity
from quireframe.llm.contract import op2_toxicity


def brute(index, examples, counts, k):
    terms, w = index.vector(counts)
    q = np.zeros(len(index.vocabulary))
    q[terms] = w
    scores = []
    for _, y, c in examples:
        v = np.zeros(len(index.vocabulary))
        if c:
            t, x = index.vector(c)
            v[t] = x
        scores.append((float(q @ v), y))
    scores = sorted((s for s in scores if s[0] > 0), reverse=True)
    least = scores[min(k, len(scores)) - 1][0] if scores else 0
    return sorted(s for s in scores if s[0] >= least - 1e-9)


def test_index_is_exact():
    rng = np.random.default_rng(5)
    index = toxicity.Index([f"t{i}" for i in range(40)], rng.uniform(1, 4, 40), k=7, width=8)
    examples = []
    for d in range(400):
        terms = sorted(rng.choice(40, rng.integers(0, 5), replace=False).tolist())
        examples.append((d, int(rng.integers(0, 2)), tuple((t, int(rng.integers(1, 3))) for t in terms)))
    index.build(examples)
    for _, _, c in examples[:150]:
        if c:
            near = index.nearest(c)
            got = sorted(x for _, s, a, b in near for x in [(s, 1)] * int(a) + [(s, 0)] * int(b))
            want = brute(index, examples, c, 7)
            assert [y for _, y in got] == [y for _, y in want] or np.allclose([s for s, _ in got], [s for s, _ in want])
            assert len(got) == len(want)
    index.calibrate(examples)
    assert all(0 <= index.score(c)[0] <= 1 for _, _, c in examples)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op2_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    own = [(rows[d].predicted, y) for d, y in labels.items() if rows[d].held_out]
    assert sum(p == y for p, y in own) / len(own) > 0.95
    assert sum(p for p, y in own if y) / max(1, sum(y for _, y in own)) > 0.7


def test_hard_rows(spark):
    docs = spark.createDataFrame([(i, "you idiot " * (i % 3 + 1) if i % 2 else "a kind word", 0.5) for i in range(60)] + [(None, "idiot", 0.1), (70, None, 0.1), (71, "", 0.1), (71, "", 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (5, None), (3, 1)], "doc_id long, toxic int")
    index = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, index).collect()
    assert len(rows) == 64 and all(r.predicted == (r.doc_id is None or (r.doc_id < 60 and r.doc_id % 2)) for r in rows)
    kept = toxicity.clean(docs, index).collect()
    assert len(kept) == 33 and kept[0].asDict().keys() == {"doc_id", "text", "score"}
    assert toxicity.score(docs.limit(0), index).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}


def test_copies_of_examples_without_markers(spark):
    """Words of one toxic example are no markers, yet its copy has it as the nearest, at any number of labels."""
    for many in (40, 400):
        rows = [(i, " ".join(f"word{(i * 7 + j * j) % 97}" for j in range(12))) for i in range(many)]
        bad = next(i for i in range(many) if zlib.crc32(str(i).encode()) % 3 != 1)
        rows[bad] = (bad, "seldom heard nasty slurs in a row")
        docs = spark.createDataFrame([*rows, (1000, rows[bad][1]), (1001, rows[bad][1] + " word1"), (1002, "unheard of")], "doc_id long, text string")
        labels = spark.createDataFrame([(i, int(i == bad or i % 10 == 0)) for i in range(many)], "doc_id long, toxic int")
        got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
        assert got[1000].predicted == 1 and got[1000].evidence[0] == bad and got[1000].cosines[0] > 0.999
        assert got[1001].evidence[0] == bad and len({r.score for r in got.values()}) > 2


def test_query_against_plain_cosine(spark, sf):
    """Every document's nearest examples by whole TF-IDF vectors, weights from all documents, against all pairs."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    examples = sorted(d for d in labels if d in texts)
    stored = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    index, _ = toxicity.opened(stored)
    words = {w for d in examples for w in toxicity.word_counts(texts[d])}
    assert set(index.vocabulary[: len(index.vocabulary) - index.marks]) == words
    counts = {d: toxicity.word_counts(t) for d, t in texts.items()}
    seen = {w: sum(w in c for c in counts.values()) for w in words}
    idf = {w: np.log((len(texts) + 1) / (n + 1)) + 1 for w, n in seen.items()}
    assert np.allclose(index.idf[: len(words)], [idf[w] for w in index.vocabulary[: len(words)]])
    marked = {d: {i - len(words): n for i, n in toxicity.Reader(index.vocabulary, index.marks).counts(t).tolist() if i >= len(words)} for d, t in texts.items()}

    def vector(d):
        own = {w: (1 + np.log(n)) * idf[w] for w, n in counts[d].items() if w in words}
        more = {i: (1 + np.log(n)) * index.idf[len(words) + i] for i, n in marked[d].items()}
        if own and more:
            scale = toxicity.MARKED * np.sqrt(sum(x * x for x in own.values()) / sum(x * x for x in more.values()))
            more = {i: x * scale for i, x in more.items()}
        length = np.sqrt(sum(x * x for x in [*own.values(), *more.values()]))
        return {k: x / length for k, x in (own | more).items()}

    vectors = {d: vector(d) for d in texts}
    for r in op2_toxicity(spark, sf).collect():
        own = vectors[r.doc_id]
        cosines = sorted({d: sum(x * vectors[d].get(k, 0) for k, x in own.items()) for d in examples}.values(), reverse=True)
        classes = sorted({round(c, 9) for c in cosines if c > 0}, reverse=True)
        assert np.allclose(sorted({round(c, 9) for c in r.cosines}, reverse=True)[:3], classes[: min(3, len(set(round(c, 9) for c in r.cosines)))], atol=1e-7)


def test_odd_labels_and_repeated_rows(spark):
    docs = spark.createDataFrame([(i % 40, "vile word here" if i % 2 else f"quiet words {i % 7}") for i in range(400)] + [(41, "x" * 200_000), (42, "vile " * 50_000)], "doc_id int, text string")
    labels = spark.createDataFrame([(i, (2 if i % 4 == 1 else 1) if i % 2 else -1) for i in range(40)], "doc_id int, toxic int")
    rows = toxicity.score(docs, toxicity.fit(docs, labels, most_examples=30)).collect()
    assert len(rows) == 402 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == r.doc_id % 2 for r in rows if r.doc_id < 40)
    index, counted = toxicity.fit_and_count(docs, labels, most_examples=30)
    again = toxicity.score_counted(counted, index).collect()
    assert sorted((r.doc_id, r.score) for r in again) == sorted((r.doc_id, r.score) for r in rows)


def test_runs_are_split_as_words():
    words = ["Word,", "don't", "(x)", "É.a", "_a", "a_", "İx", "...", "x–y", "“quoted”", "ſt", "Straße!", "a.b.c", "٣", "½", "x²"]
    reader = toxicity.Reader(sorted({w for t in words for w in toxicity.word_counts(t)}))
    for t in [*words, " ".join(words)]:
        assert {reader_word(reader, i): n for i, n in reader.counts(t).tolist()} == dict(toxicity.word_counts(t))
    assert np.array_equal(toxicity.unpacked(toxicity.packed(reader.counts(" ".join(words)))), reader.counts(" ".join(words)))


def reader_word(reader, i):
    return next(w for w, k in (*reader.code.items(), *reader.marked.items()) if k == i and w == w.lower() and w.isalnum() | ("_" in w))


def test_texts_are_counted_together():
    """What is no plain word is split once for many texts, however many have it; counts are those of each text alone."""
    odd = ["don't", "a.b.c", "Éa", "ΟΔΟΣ,", "İx", "“quoted”", "vileness", "_a", "$$x%"]
    texts = [" ".join([f"word{i % 7}"] * (i % 3) + [odd[i % len(odd)], "vile,", "VILE "]) for i in range(300)] + [None, "", " \x1c\x85\u2003"]
    words = sorted({w for t in texts for w in toxicity.word_counts(t)} - {"word3"})
    reader = toxicity.Reader([*words, "vile", "vile*", "vile*2"], 3)
    taken = []
    reader._run = lambda run, own=reader._run: taken.append(run) or own(run)
    together = list(reader.all_counts(texts))
    assert len(together) == len(texts) and len(taken) == len(set(taken)) <= len(odd) + 2
    for text, counts in zip(texts, together, strict=True):
        own = toxicity.word_counts(text)
        begun = own["vileness"]
        want = {i: own[w] for i, w in enumerate(words) if own[w]} | {len(words) + i: n for i, n in enumerate((own["vile"], begun, int(begun > 1))) if n}
        assert dict(counts.tolist()) == want and counts[:, 0].tolist() == sorted(want)
        assert np.array_equal(reader.counts(text), counts)


def test_index_keeps_each_weight_once():
    """Terms outside the dense matrix are in posting lists only, and groups of texts give what each alone does."""
    rng = np.random.default_rng(11)
    index = toxicity.Index([f"t{i}" for i in range(300)], rng.uniform(1, 4, 300), k=5, width=16, marks=20)
    examples = [(d, int(rng.integers(0, 2)), tuple((int(t), int(rng.integers(1, 4))) for t in np.sort(rng.choice(300, rng.integers(1, 40), replace=False)))) for d in range(700)]
    index.build(examples)
    assert len(index.rows) + len(index.posted) == sum(len(c) for _, _, c in examples)
    queries = [c for _, _, c in examples[:200]]
    for c, near in zip(queries, index.all_nearest(queries), strict=True):
        want = brute(index, examples, c, 5)
        got = sorted(x for _, s, a, b in near for x in [(s, 1)] * int(a) + [(s, 0)] * int(b))
        assert np.allclose([s for s, _ in got], [s for s, _ in want], atol=1e-12) and near == index.nearest(c)


def test_tally_of_terms():
    texts = ["Worthless worthy words, worthless", None, "", "word words wordy wordless", "ÉTÉS étés étésien", "a worth of words"] * 3
    toxic = [i % 2 for i in range(len(texts))]
    tally = toxicity.Tally()
    for at in range(0, len(texts), 4):
        tally.add(texts[at : at + 4], toxic[at : at + 4])
    want: dict[str, list[int]] = {}
    for t, y in zip(texts, toxic, strict=True):
        for term in toxicity.terms_of(t) | {""}:
            want.setdefault(term, [0, 0])[1 - y] += 1
    rows = list(tally.rows())
    assert len(rows) == len(want) and {t: [a, b] for t, a, b in rows} == want
    assert list(toxicity.Tally().rows()) == [("", 0, 0)]
