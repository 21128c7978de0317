import heapq
import itertools
import random
import re
import zlib
from hashlib import sha256

from quireframe.llm import dialogues

SCHEMA = "conv_id long, turn long, role string, text string, audit string"
SOLID = re.compile(r"[^\x20\x09-\x0D]")
GRAMMAR = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = {}
    for conv_id, turn, role, text in rows:
        own = out.setdefault(conv_id, [])
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, own in out.items()}


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = SOLID.findall(text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, audit, repaired) by a search from the cheapest prefix on that keeps whole strings: at equal costs the
    least string is found by trying them all."""
    best = None
    heap = [(0, "", 0, "", ())]
    seen = set()
    while heap:
        cost, audit, i, initials, out = heapq.heappop(heap)
        if best is not None and cost > best[0]:
            return best
        if (cost, audit, i, initials[-1:], len(initials) == 0) in seen:
            continue
        seen.add((cost, audit, i, initials[-1:], len(initials) == 0))
        if i == len(rows) and GRAMMAR.fullmatch(initials) and (best is None or audit < best[1]):
            best = (cost, audit, out)
        for role in ("user", "assistant"):
            new = initials + role[0]
            if GRAMMAR.fullmatch(new) or GRAMMAR.fullmatch(new + "a") or GRAMMAR.fullmatch(new + "ua"):
                heapq.heappush(heap, (cost + 5, audit + "I", i, new, (*out, (role, ""))))
        if i < len(rows):
            _, own, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, initials, out))
            if faults[i] not in ("blank", "duplicate"):
                for role, extra, label in ((own, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")):
                    new = initials + role[:1]
                    if role and (GRAMMAR.fullmatch(new) or GRAMMAR.fullmatch(new + "a") or GRAMMAR.fullmatch(new + "ua")):
                        heapq.heappush(heap, (cost + extra + 5 * (faults[i] == "truncated"), audit + label, i + 1, new, (*out, (role, text))))
    return best


def plain(rows, search=cheapest):
    out = []
    for conv_id, own in damage(rows).items():
        faults = faults_of(own)
        cost, audit, repaired = search(own, faults)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        digest = sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out.append((conv_id, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return out


def strings(rows, faults):
    """(cost, audit, repaired) backwards, whole label strings held by every state: another way for long conversations."""
    far = 10**9
    inf = (far, "", ())
    nexts = lambda q: (3, "assistant") if q == 2 else (2, "user")
    plus = lambda v, cost, label, row: (v[0] + cost, label + v[1], (row, *v[2]) if row else v[2])

    def relaxed(v):
        for _ in range(4):
            v = [min(v[q], plus(v[nexts(q)[0]], 5, "I", (nexts(q)[1], "")), key=lambda x: x[:2]) for q in range(4)]
        return v

    v = relaxed([(0, "", ()), inf, inf, (0, "", ())])
    for (_, role, text), fault in zip(reversed(rows), reversed(faults), strict=True):
        new = []
        for q in range(4):
            ways = [plus(v[q], 2, "D", None)]
            if fault not in ("blank", "duplicate"):
                late = 5 * (fault == "truncated")
                to, other = nexts(q)
                if role[:1] == other[0]:
                    ways.append(plus(v[to], late, "K", (role, text)))
                elif q == 0 and role[:1] == "s":
                    ways.append(plus(v[1], late, "K", (role, text)))
                ways.append(plus(v[to], 1 + late, "R", (other, text)))
            new.append(min(ways, key=lambda x: x[:2]))
        v = relaxed(new)
    return v[0]


def check(spark, rows, search=cheapest):
    got = dialogues.repair(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA))
    assert got.columns == [x.split()[0] for x in dialogues.RESULT.split(", ")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain(rows, search), key=repr)


def made(rng, conv_id, n):
    texts = ["Yes.", "No!", "Why?", "open", "  ", "", "x. \t\n", "one ", "! ", None]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "unknown", None]
    return [(conv_id, rng.choice([i, i, i, i // 2, None]), rng.choice(roles), rng.choice([*texts, f"t{i}.", f"t{i}.", f"u{i}"])) for i in range(n)]


def test_hard_rows(spark):
    check(spark, [])
    check(spark, [(None, None, None, None), (1, None, "user", "a."), (2, 5, "", "b."), (2, 9, "assistant", "b."), (3, 1, "system", "only.")])
    ends = ["f", "ff", ".f", "x.\x0c", "\x0b\x0c\t\r\n ", "x!\x0b", "x?\x85", "\xa0", "t", "u", ".\u2003", "0", "b."]
    check(spark, [(c, i, role, text) for c in range(40, 60) for i, text in enumerate(ends) for role in ("user", "assistant")][:: 3], strings)
    gone = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    check(spark, [(gone, 0, "user", "a.")])


def test_random_conversations_against_a_search(spark):
    rng = random.Random(7)
    check(spark, [r for c in range(250) for r in made(rng, c, rng.randint(1, 7))])


def test_two_plain_ways_agree():
    rng = random.Random(3)
    for c in range(300):
        for own in damage(made(rng, c, rng.randint(1, 8))).values():
            assert strings(own, faults_of(own)) == cheapest(own, faults_of(own))


def test_long_conversations_in_pieces(spark, monkeypatch):
    """Pieces of 16 rows: the same functions as for those of 1024, on conversations of up to 700 rows and one with null id."""
    monkeypatch.setattr(dialogues, "CHUNK", 16)
    rng = random.Random(11)
    rows = [r for c, n in ((1, 700), (2, 17), (3, 16), (4, 90), (None, 120), (6, 3)) for r in made(rng, c, n)]
    rows += [(9, 0, "user", "Same.")] * 40 + [(8, i, "system", "Never ends") for i in range(50)]
    check(spark, rows, strings)


def test_pieces_compose():
    """The state behind a piece and the costs before it are those of the whole, wherever it is cut."""
    rng = random.Random(5)
    symbols = [rng.randrange(9) for _ in range(60)]
    arcs, whole = dialogues.backwards(symbols, dialogues.END)
    path, end = dialogues.forwards(arcs, 0)
    for at in range(61):
        right, behind = dialogues.backwards(symbols[at:], dialogues.END)
        left, costs = dialogues.backwards(symbols[:at], behind)
        t = dialogues.transfer(symbols[:at])
        assert costs == whole == tuple(min(t[4 * q + e] + behind[e] for e in range(4)) for q in range(4))
        first, state = dialogues.forwards(left, 0)
        second, last = dialogues.forwards(right, state)
        assert [a.labels for a in first + second] == [a.labels for a in path] and last == end
