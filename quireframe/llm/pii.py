"""Personal data in texts by weak supervision: labelers vote, expectation-maximisation weighs them, a classifier decides.

Only DataFrame functions: patterns give candidate spans inside each row; labelers vote on each candidate; the votes are
counted by pattern of votes; expectation-maximisation over those counts estimates how reliable each labeler is and how
likely each pattern is personal data; with these soft labels a naive Bayes classifier over span features is trained.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireframe.llm.common import Cut

KINDS = ("email", "ip", "card", "phone")
# Possessive repeats keep the matcher from recursing on very long runs; the look-behind keeps it from trying a run again
# from each of its characters. Both match exactly what the plain patterns match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What else may be personal data: spelt-out addresses, colon-separated addresses, national phone numbers.
WIDE = (
    r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z0-9-]++)++"
    r"|(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"
    r"|(?<![0-9A-Za-z+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])"
)
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
# The gazetteers of the labelers.
DOMAINS = "com org net edu gov mil int info biz io dev app co ai me tv us uk de fr es it nl be ch at pt pl se no fi dk ie cz gr ru ua tr cn jp kr in au nz ca mx br ar cl za eu"
CARD_STARTS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5|4[4-9])|35|30[0-5]|3[689])"
COUNTRY_CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|3[578][0-9]|42[013]|5[09][0-9]|6[7-9][0-9]|8[058][0-9]|9[679][0-9])"
RESERVED = r"^0*(?:0|127|255)\."
GOOD_CUES = r"(?i)(?:mail|contact|call|tel|phone|fax|mobile|card|visa|pay|\bip|host|addr|write|reach|from)\W*\w*\W*$"
BAD_CUES = r"(?i)(?:token|passw|secret|key|hash|sha|digest|version|isbn|order|serial|invoice)\W*$|[=#]\W*$"
VOTERS = ("form", "checksum", "gazetteer", "cue", "counter_cue", "border")
#: Longest context that a candidate keeps.
BEFORE = 24


def _cut_at(text: Column, pattern: str, found: Column) -> Column:
    return F.when(F.size(found) > 0, F.split(text, pattern, -1))


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _is_base(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    n = F.char_length(_digits(m))
    if kind == "card":
        return n.between(13, 19) & _luhn(_digits(m))
    return n.between(9, 15)


def _sign(good: Column, bad: Column | None = None) -> Column:
    if bad is None:
        bad = ~good
    return F.when(good, 1).when(bad, -1).otherwise(0)


def _votes(kind: str, m: Column, base: Column, before: Column, after: Column) -> Column:
    digits = _digits(m)
    n = F.char_length(digits)
    top = F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1))
    checksum, known = {
        "email": (_sign(top.rlike("^[a-z]{2,}$")), _sign(top.isin(DOMAINS.split()))),
        "ip": (_sign(base | m.contains(":")), _sign(m.contains(":"), m.rlike(RESERVED))),
        "card": (_sign(_luhn(digits)), _sign(digits.rlike(CARD_STARTS))),
        "phone": (_sign(n.between(10, 13), ~n.between(9, 15)), _sign(m.rlike(COUNTRY_CODES), m.startswith("+"))),
    }[kind]
    touches = before.rlike("[A-Za-z0-9_]$") | after.rlike("^[A-Za-z0-9_]")
    none = F.lit(False)
    votes = (_sign(base, none), checksum, known, _sign(before.rlike(GOOD_CUES), none), _sign(none, before.rlike(BAD_CUES)), _sign(none, touches))
    return F.array(*[v.cast("int") for v in votes])


def _features(m: Column, votes: Column, before: Column, after: Column) -> Column:
    """Span features, each with a few values; the votes are among them."""
    kinds = lambda c: F.when(c == "", "none").when(c.rlike("[A-Za-z]"), "letter").when(c.rlike("[0-9]"), "digit").when(c.rlike(r"\s"), "space").otherwise("mark")
    named = [F.concat(F.lit(f"{v}="), votes[i].cast("string")) for i, v in enumerate(VOTERS)]
    named += [
        F.concat(F.lit("before="), kinds(F.right(before, F.lit(1)))),
        F.concat(F.lit("after="), kinds(F.left(after, F.lit(1)))),
        F.concat(F.lit("length="), F.least(F.floor(F.char_length(m) / 4), F.lit(8)).cast("string")),
        F.concat(F.lit("separators="), F.least(F.char_length(F.regexp_replace(m, r"[A-Za-z0-9]", "")), F.lit(4)).cast("string")),
    ]
    return F.array(*named)


def _starts(parts: str) -> Column:
    """Where each match starts, in code points, from the gaps before the matches and their lengths.

    Matches are added up in stretches of about the root of their number, so that no long array is copied for each.
    """
    stretch = f"CAST(ceil(sqrt(size({parts}))) AS INT)"
    inner = f"aggregate(slice({parts}, a + 1, {stretch}), named_struct('at', o.at, 'out', CAST(array() AS ARRAY<INT>)), (s, p) -> named_struct('at', s.at + p.gap + p.n, 'out', concat(s.out, array(s.at + p.gap))))"
    outer = f"transform(array({inner}), x -> named_struct('at', x.at, 'out', concat(o.out, array(x.out))))[0]"
    first = "named_struct('at', 0, 'out', CAST(array() AS ARRAY<ARRAY<INT>>))"
    return F.expr(f"IF(size({parts}) = 0, CAST(array() AS ARRAY<INT>), aggregate(sequence(0, size({parts}) - 1, {stretch}), {first}, (o, a) -> {outer}, o -> flatten(o.out)))")


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, found): each row of docs as a struct, so that no column's name clashes, and all candidate spans of its text.

    A span has kind (its place in KINDS), start, end (code points, end exclusive), base (whether it is one of the
    fixed patterns' spans), votes and features. Null texts have none.
    """
    patterns = PATTERNS | {"wide": WIDE}
    df = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("whole"))
    df = df.withColumns({f"m_{k}": F.regexp_extract_all("whole", F.lit(p), F.lit(0)) for k, p in patterns.items()})
    df = df.withColumns({f"s_{k}": _cut_at(F.col("whole"), p, F.col(f"m_{k}")) for k, p in patterns.items()})

    def parts(k: str) -> Column:
        gaps = F.col(f"s_{k}")
        return F.transform(
            F.col(f"m_{k}"),
            lambda m, i: F.struct(
                m.alias("m"), F.char_length(gaps[i]).alias("gap"), F.char_length(m).alias("n"),
                F.right(gaps[i], F.lit(BEFORE)).alias("before"), F.left(gaps[i + 1], F.lit(1)).alias("after"),
            ),
        )

    df = df.withColumns({f"p_{k}": parts(k) for k in patterns})
    df = df.withColumns({f"at_{k}": _starts(f"p_{k}") for k in patterns})

    def span(number: Column, kind: str, p: Column, start: Column, base: Column) -> Column:
        return F.struct(number.alias("kind"), start.alias("start"), (start + p["n"]).alias("end"), base.alias("base"), p["m"].alias("m"), p["before"].alias("before"), p["after"].alias("after"))

    def spans(k: str) -> Column:
        at = F.col(f"at_{k}")
        every = F.transform(F.col(f"p_{k}"), lambda p, i: span(F.lit(KINDS.index(k)), k, p, at[i], _is_base(k, p["m"])))
        likely = (lambda s: s["base"] | F.char_length(_digits(s["m"])).between(13, 19)) if k == "card" else (lambda s: s["base"])
        return F.filter(every, likely)

    at = F.col("at_wide")
    kind = lambda m: F.when(m.rlike("^[0-9A-Fa-f]{1,4}:"), 1).when(m.rlike(r"^[(0-9][0-9() .-]+$"), 3).otherwise(0)
    wide = F.transform(F.col("p_wide"), lambda p, i: span(kind(p["m"]), "wide", p, at[i], F.lit(False)))
    df = df.withColumn("every", F.concat(*[spans(k) for k in KINDS], wide))
    base = F.filter("every", lambda s: s["base"])
    df = df.withColumn("base", base)
    more = F.filter("every", lambda s: ~s["base"] & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))

    def judged(s: Column) -> Column:
        votes = reduce(lambda out, k: F.when(s["kind"] == k, _votes(KINDS[k], s["m"], s["base"], s["before"], s["after"])).otherwise(out), range(3), _votes("phone", s["m"], s["base"], s["before"], s["after"]))
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), votes.alias("votes"), s["m"].alias("m"), s["before"].alias("before"), s["after"].alias("after"))

    df = df.withColumn("voted", F.transform(F.concat("base", more), judged))
    found = F.transform("voted", lambda s: F.struct(s["kind"], s["start"], s["end"], s["base"], s["votes"], _features(s["m"], s["votes"], s["before"], s["after"]).alias("features")))
    return df.select("row", found.alias("found"))


@dataclass
class Model:
    """What training learns: each labeler's accuracy by kind, and the classifier's weights by 'kind feature=value'.

    Its size is bounded by the features' values, a few hundred numbers, whatever the data.
    """

    accuracy: dict[str, dict[str, float]]
    weights: dict[str, float]

    def log_odds(self, span: Column) -> Column:
        if not self.weights:
            return F.lit(-1.0)
        names = list(self.weights)
        weights = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.lit(self.weights[n]) for n in names]))
        kind = span["kind"].cast("string")
        terms = F.concat(F.array(F.lit("bias")), span["features"])
        return F.aggregate(terms, F.lit(0.0), lambda total, f: total + F.coalesce(F.try_element_at(weights, F.concat(kind, F.lit(" "), f)), F.lit(0.0)))


def expectation_maximisation(counts: DataFrame, rounds: int = 25) -> DataFrame:
    """(kind, accuracy array, patterns array<struct<v, n, y>>) from (kind, votes array<int>, n long).

    Votes of 1, -1 and 0 (abstains); y is the probability that a candidate with these votes is personal data. The
    labelers err independently given the truth, each with one accuracy by kind (kept in 0.55 to 0.99, which fixes
    which class is which). All rounds run in one expression over the patterns of a kind, at most 3^6 of them.
    """
    accuracy = ", ".join(
        f"least(0.99D, greatest(0.55D, aggregate(q, 4D, (s, x) -> s + if(x.v[{j}] = 0, 0D, x.n * if(x.v[{j}] > 0, x.y, 1 - x.y)))"
        f" / aggregate(q, 5D, (s, x) -> s + if(x.v[{j}] = 0, 0D, x.n))))"
        for j in range(len(VOTERS))
    )
    prior = "least(0.99D, greatest(0.01D, aggregate(q, 0.5D, (s, x) -> s + x.n * x.y) / aggregate(q, 1D, (s, x) -> s + x.n)))"
    learnt = f"named_struct('prior', {prior}, 'a', array({accuracy}))"
    odds = " + ".join(f"x.v[{j}] * ln(m.a[{j}] / (1 - m.a[{j}]))" for j in range(len(VOTERS)))
    again = f"transform(array({learnt}), m -> transform(q, x -> named_struct('v', x.v, 'n', x.n, 'y', 1 / (1 + exp(-(ln(m.prior / (1 - m.prior)) + {odds}))))))[0]"
    first = "transform(p, x -> named_struct('v', x.v, 'n', x.n, 'y', 1 / (1 + exp(-aggregate(x.v, 0D, (s, y) -> s + y)))))"
    grouped = counts.groupBy("kind").agg(F.collect_list(F.struct(F.col("votes").alias("v"), F.col("n").cast("double").alias("n"))).alias("p"))
    done = grouped.select("kind", F.expr(f"aggregate(sequence(1, {rounds}), {first}, (q, r) -> {again})").alias("q"))
    return done.select("kind", F.expr(f"array({accuracy})").alias("accuracy"), F.col("q").alias("patterns"))


def train(found: DataFrame) -> Model:
    """Estimate the labelers' reliabilities and train the span classifier on all candidates() of all rows.

    Candidates should be written before (as by Cut), so that texts are searched once for training and for what follows.
    """
    cut = Cut(found.sparkSession)
    spans = found.select(F.explode("found").alias("s")).select("s.kind", "s.votes", "s.features")
    counts = spans.groupBy("kind", "votes").agg(F.count("*").alias("n"))
    learnt = cut(expectation_maximisation(counts), "learnt")
    soft = learnt.select("kind", F.explode("patterns").alias("p")).select("kind", F.col("p.v").alias("votes"), F.col("p.y").alias("y"))
    # At most 4 * 3^6 rows, whatever the data.
    each = spans.join(F.broadcast(soft), ["kind", "votes"]).select("kind", "y", F.explode(F.concat(F.array(F.lit("bias")), "features")).alias("feature"))
    sums = each.groupBy("kind", "feature").agg(F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad")).collect()
    totals = {r.kind: r for r in sums if r.feature == "bias"}
    from math import log

    weights = {}
    for r in sums:
        t = totals[r.kind]
        if r.feature == "bias":
            weights[f"{r.kind} bias"] = log((t.good + 1) / (t.bad + 1))
        else:
            weights[f"{r.kind} {r.feature}"] = log((r.good + 0.5) / (t.good + 1)) - log((r.bad + 0.5) / (t.bad + 1))
    accuracy = {KINDS[r.kind]: dict(zip(VOTERS, r.accuracy, strict=True)) for r in learnt.select("kind", "accuracy").collect()}
    cut.drop(learnt)
    return Model(accuracy, weights)


def _spans(model: Model) -> Column:
    """The spans of ``found`` that stay, by kind, then start."""
    kept = F.filter("found", lambda s: s["base"] | (model.log_odds(s) >= 0))
    ordered = F.array_sort(F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"))))
    names = F.array(*map(F.lit, KINDS))
    return F.transform(ordered, lambda s: F.struct(names[s["kind"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")))


def find(found: DataFrame, model: Model, column: str = "spans") -> DataFrame:
    """The rows of candidates() with one more column: array<struct<kind string, start int, end int, base boolean>> by kind, then start.

    All base spans, and the other candidates that the classifier takes. Null and empty texts have an empty array;
    every row comes out once, in any number of repeats; an empty table stays one; a column of the new name is replaced.
    """
    names = [c for c in found.schema["row"].dataType.names if c != column]
    return found.select(*[F.col("row")[c].alias(c) for c in names], _spans(model).alias(column))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, model: Model) -> DataFrame:
    """Per row of candidates(): doc_id, counts of the base spans by kind, SHA-256 of the joined base spans, and all spans joined."""
    df = found.select(F.col("row.doc_id").cast("long").alias("doc_id"), _spans(model).alias("spans")).withColumn("base", F.filter("spans", lambda s: s["base"]))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return df.select("doc_id", *[count(k) for k in KINDS], F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(found: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of candidates() with each span of the text replaced by its kind in brackets, as in [EMAIL].

    Spans that overlap are replaced together, under the kind of the first. Null texts stay null, empty ones empty;
    repeated rows stay as often, an empty table stays one. A column n_chars is set to the new length.
    """
    schema = found.schema["row"].dataType
    step = lambda a, s: F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(F.struct(s["start"], a["at"].alias("from"), s["kind"]))).alias("out"))).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")))
    by_start = F.array_sort(F.transform(_spans(model), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    none = F.array().cast("array<struct<start:int,from:int,kind:string>>")
    whole = F.col("row")[text].cast("string")
    df = found.select("row", whole.alias("whole"), by_start.alias("spans")).withColumn("cuts", F.aggregate("spans", F.struct(F.lit(0).alias("at"), none.alias("out")), step))
    pieces = F.transform("cuts.out", lambda c: F.concat(F.col("whole").substr(c["from"] + 1, c["start"] - c["from"]), F.lit("["), F.upper(c["kind"]), F.lit("]")))
    new = F.concat(F.array_join(pieces, ""), F.col("whole").substr(F.col("cuts.at") + 1, F.lit(2147483647)))
    df = df.withColumn("whole", F.when(F.size("spans") > 0, new).otherwise(F.col("whole")))
    own = {c: F.col("row")[c] for c in schema.names}
    own[text] = F.col("whole").cast(schema[text].dataType)
    if "n_chars" in own:
        own["n_chars"] = F.char_length("whole").cast(schema["n_chars"].dataType)
    return df.select(*[v.alias(c) for c, v in own.items()])
