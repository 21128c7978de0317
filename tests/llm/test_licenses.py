import random

from quireframe.llm.contract import op3_licenses
from quireframe.llm.license_texts import TEMPLATES
from quireframe.llm.licenses import Templates, align, scan, winnow, words_of


def brute(text, least=0.8):
    """Every template aligned with the whole text on all diagonals, best match first, found ones cut out."""
    words, out = words_of(text or ""), []
    for name in sorted(TEMPLATES):
        t, rest = words_of(TEMPLATES[name]), list(words)
        while True:
            _, matched, a, b = align(t, rest, -len(t), len(rest))
            if matched < least * len(t):
                break
            out.append((matched, matched / len(t), a, b, name))
            rest[a : b + 1] = ["\0"] * (b + 1 - a)
    kept = []
    for m in sorted(out, key=lambda m: (-m[0], -m[1], m[2], m[3], m[4])):
        if all(m[3] < o[2] or o[3] < m[2] for o in kept):
            kept.append(m)
    return sorted((a, b, n, round(c, 6)) for _, c, a, b, n in kept)


def by_words(text, found):
    starts, at = {}, 0
    for i, w in enumerate(words_of(text)):
        at = text.lower().index(w, at)
        starts[at] = i
        at += len(w)
    ends = {s + len(w): i for (s, i), w in zip(starts.items(), words_of(text), strict=True)}
    return sorted((starts[s], ends[e], n, round(c, 6)) for n, s, e, _, c in found)


def test_against_all_diagonals():
    rng = random.Random(4)
    known = Templates(TEMPLATES)
    filler = "the of under license software public version and to be".split()
    for _ in range(12):
        parts = []
        for name in rng.sample(sorted(TEMPLATES), 2):
            words = TEMPLATES[name].split()
            for _ in range(rng.randint(0, len(words) // 15)):
                k = rng.randrange(len(words))
                words[k : k + 1] = rng.choice([[], ["changed"], [words[k], "added"]])
            parts += rng.choices(filler, k=rng.randint(0, 25)) + words
        text = " ".join(parts)
        assert by_words(text, known.find(text)) == brute(text)


def test_every_template_is_found_twice():
    known = Templates(TEMPLATES)
    for name, t in TEMPLATES.items():
        text = f"Hello.\n{t}\n\n{t} bye"
        assert [(m[0], m[4]) for m in known.find(text)] == [(name, 1.0)] * 2
        assert words_of(text[known.find(text)[0][1] : known.find(text)[0][2]]) == words_of(t)


def test_winnowing_leaves_no_gap():
    words = [f"w{i % 37}" for i in range(200)]
    picked = winnow(words, 3, 4)
    assert all(any(at <= p < at + 4 for p in picked) for at in range(len(words) - 5)) and len(picked) < 150


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op3_licenses(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    notices = [t for n, t in TEMPLATES.items() if n.endswith("notice")]
    for r in rows:
        want = sum(docs[r.doc_id].count(t) for t in notices)
        assert r.n_matches == want and (r.licenses.count(",") + 1 if r.licenses else 0) == want
    assert sum(r.n_matches for r in rows) > 0


def test_hard_rows(spark):
    long = "word " * 200_000 + TEMPLATES["MIT"] + " word" * 100_000
    rows = [(1, None), (2, ""), (3, long), (None, "Released under the MIT License."), (4, "İ released UNDER the\n\tmit--License"), (4, "İ released UNDER the\n\tmit--License"), (5, "Released under the MIT License. " * 50)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, matches string")
    got = sorted(((r.doc_id or 0, [(m.license, m.start, m.end, m.coverage) for m in r.matches]) for r in scan(df).collect()))
    assert got[1:3] == [(1, []), (2, [])] and got[0][1] == [("MIT notice", 0, 30, 1.0)]
    assert got[3] == (3, [("MIT", 1_000_000, 1_000_000 + len(TEMPLATES["MIT"]) - 1, 1.0)])
    assert got[4] == got[5] == (4, [("MIT notice", 2, 34, 1.0)]) and len(got[6][1]) == 50
    assert scan(df.limit(0)).count() == 0 and all(not r.matches for r in scan(df, {}).collect())


def test_clauses_put_in_and_left_out():
    """A published variant with a clause more, and a text whose many repeated phrases open many runs."""
    known = Templates(TEMPLATES)
    extra = " 3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. "
    third = TEMPLATES["BSD-3-Clause"].index(" 3. Neither")
    text = TEMPLATES["BSD-3-Clause"][:third] + extra + TEMPLATES["BSD-3-Clause"][third:].replace(" 3. ", " 4. ")
    found = known.find("Some words. " + text)
    assert [m[0] for m in found] == ["BSD-3-Clause"] and found[0][4] > 0.98 and found[0][1] == len("Some words. ") and found[0][2] >= len("Some words. " + text) - 2
    words = [f"w{i}" for i in range(60)]
    for n in range(5, 60, 6):
        words[n : n + 3] = ["again", "and", "again"]
    own = Templates({"own": " ".join(words)})
    noisy = "again and again " * 40 + " ".join(words[:20]) + " again and again" * 12 + " ".join(words[20:])
    assert [m[0] for m in own.find(noisy)] == ["own"]
