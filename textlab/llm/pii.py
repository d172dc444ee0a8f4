"""Personal data by fixed forms and by bootstrapped contexts (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textlab.llm.common import text_key, written

#: kinds in the order in which spans with one start are listed
KINDS = ("email", "ip", "card", "phone")

# The forms of the four kinds. Repeats that nothing can follow are possessive, so that a
# long run costs no stack; a run is tried from its first character or from the end of the match
# before, since what fails there fails further on too. A card has 14 digits at least, so shorter runs
# are no match at all; longer ones are matched whole and dropped.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_MARK = {"email": "@", "ip": ".", "phone": "+"}

#: identifier-like tokens: runs without white space that hold a digit or an at sign
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: a number that a further group of digits may follow, and such a group
OPENS, GROUP = r"^[+(]*[0-9][0-9()./-]*(?<![./-])$", r"^\(?[0-9][0-9()./-]*[.,;:!?)\]>}\"']*$"
#: what may stand around a token; a bracket stays that holds its first digits
LEAD, TRAIL = r"^(?:[\[<{\"']|\((?![0-9]+\)[^0-9]{0,2}[0-9]))*+", r"[.,;:!?)\]>}\"']+$"
#: a lexical pattern is the two words before an identifier, or the one where there are no two
PATTERN = r"(?<![^\x20\x09-\x0D])(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++)?[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+\z"

BLOCK = 256
_FOUND = "array<struct<start:int,m:string,before:string,near:boolean>>"


def _located(form: str) -> Column:
    """Matches of ``form`` in ``text``, leftmost and non-overlapping, with their code point offsets, the
    last two words before them, and whether just a space parts them from the match before: the pieces
    between matches give the offsets."""
    found = F.regexp_extract_all("text", F.lit(form), F.lit(0))
    pieces = F.split("text", form, -1)
    both = F.zip_with(pieces, found, lambda p, m: F.struct(p.alias("p"), m.alias("m")))

    def step(s, x):
        # the words go on through earlier matches; brackets and quotes that open belong to no word
        def add(before):
            at = s["at"] + F.length(x["p"])
            return F.struct((at + F.length(x["m"])).alias("at"), F.concat(before, x["m"]).alias("tail"), F.concat(s["out"], F.array(F.struct(
                at.alias("start"), x["m"].alias("m"), before.alias("before"), (x["p"] == " ").alias("near")))).alias("out"))

        before = F.regexp_extract(F.rtrim(F.concat(s["tail"], x["p"]), F.lit("([<{\"'")), PATTERN, 0)
        return F.when(x["m"].isNull(), s).otherwise(F.element_at(F.transform(F.array(before), add), 1))

    def block(s, part):
        inner = F.aggregate(part, F.struct(s["at"].alias("at"), s["tail"].alias("tail"), F.array().cast(_FOUND).alias("out")), step)
        return F.transform(F.array(inner), lambda v: F.struct(v["at"].alias("at"), v["tail"].alias("tail"), F.concat(s["out"], F.array(v["out"])).alias("out")))[0]

    # appending is a copy, so it is done in blocks and over blocks: texts with many matches stay cheap
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast(f"array<{_FOUND}>").alias("out"))
    return F.element_at(F.transform(F.array(both), lambda v: F.flatten(F.aggregate(
        F.transform(F.sequence(F.lit(0), F.size(v) - 1, F.lit(BLOCK)), lambda b: F.slice(v, b + 1, BLOCK)),
        start, block, lambda s: s["out"]))), 1)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def value(i):
        v = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (F.lit(1) + i % 2)
        return v - F.when(v > 9, 9).otherwise(0)
    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + value(i))
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda x: (F.length(F.regexp_replace(x, "^0+", "")) <= 3)
                        & (F.coalesce(F.regexp_replace(x, "^0+", "").try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        n = F.length(_digits(m))
        return F.when(n.between(14, 19), luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


_SPANS = "array<struct<start:int,kind:int,end:int,m:string,before:string>>"


def _base(kind: str) -> Column:
    k = KINDS.index(kind)
    spans = F.transform(F.filter(_located(FORMS[kind]), lambda x: _valid(kind, x["m"])), lambda x: F.struct(
        x["start"].alias("start"), F.lit(k).alias("kind"), (x["start"] + F.length(x["m"])).alias("end"),
        x["m"].alias("m"), x["before"].alias("before")))
    may = F.col("text").rlike("[0-9]") if kind == "card" else F.contains(F.col("text"), F.lit(_MARK[kind]))
    return F.coalesce(F.when(may, spans), F.array().cast(_SPANS))


def base_spans() -> Column:
    """All spans of the fixed forms in ``text``, by start, then kind."""
    return F.array_sort(F.concat(*[_base(k) for k in KINDS]))


_TOKENS = "array<struct<start:int,end:int,m:string,before:string,at:int,opens:boolean,goes:boolean>>"


def _trimmed(m: Column) -> tuple[Column, Column]:
    """How much punctuation stands before a token, and the token without what stands around it."""
    return F.length(F.regexp_extract(m, LEAD, 0)), F.regexp_replace(F.regexp_replace(m, LEAD, ""), TRAIL, "")


def _tokens() -> Column:
    """Identifier-like tokens of ``text``: where they are without the punctuation around them, as they
    stand there (``m`` from ``at`` on), and whether a number may go on after them or goes on in them."""
    def cut(x):
        lead, body = _trimmed(x["m"])
        return F.struct((x["start"] + lead).alias("start"), (x["start"] + lead + F.length(body)).alias("end"), x["m"].alias("m"),
                        x["before"].alias("before"), x["start"].alias("at"), x["m"].rlike(OPENS).alias("opens"), (x["near"] & x["m"].rlike(GROUP)).alias("goes"))
    may = F.col("text").rlike("[0-9@]")
    return F.coalesce(F.when(may, F.transform(_located(TOKEN), cut)), F.array().cast(_TOKENS))


def _candidates(tokens: Column) -> Column:
    """Tokens as spans, the groups of digits of one number together."""
    def whole(run):
        first = F.element_at(run, 1)
        lead, body = _trimmed(F.array_join(F.transform(run, lambda t: t["m"]), " "))
        return F.struct((first["at"] + lead).alias("start"), F.lit(-1).alias("kind"), (first["at"] + lead + F.length(body)).alias("end"),
                        body.alias("m"), first["before"].alias("before"))

    def runs(v):
        def goes_on(i):
            last = F.get(v, i - 2)
            return F.coalesce(F.get(v, i - 1)["goes"] & last["opens"] & (last["at"] + F.length(last["m"]) + 1 == F.get(v, i - 1)["at"]), F.lit(False))
        heads = F.filter(F.sequence(F.lit(1), F.size(v)), lambda i: ~goes_on(i))
        return F.element_at(F.transform(F.array(heads), lambda h: F.transform(
            h, lambda i, j: whole(F.slice(v, i, F.coalesce(F.get(h, j + 1), F.size(v) + 1) - i)))), 1)

    return F.coalesce(F.when(F.size(tokens) > 0, F.element_at(F.transform(F.array(tokens), runs), 1)), F.array().cast(_SPANS))


def _joined(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _edges(rows: DataFrame, spans: str) -> DataFrame:
    """Occurrences (doc_id, k, start, end, kind, pattern, instance) of spans that have a word before them.
    In patterns all words that hold a digit or an at sign are one."""
    s = rows.select("doc_id", "k", F.explode(spans).alias("s"))
    words = F.filter(F.split("s.before", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    pattern = F.array_join(F.transform(words, lambda w: F.when(w.rlike("[0-9@]"), "#").otherwise(F.lower(w))), " ")
    return s.select("doc_id", "k", "s.start", "s.end", "s.kind", pattern.alias("pattern"), F.lower("s.m").alias("instance")).filter("pattern <> ''")


def learn_patterns(seeds: DataFrame, unknown: DataFrame, confidence: float = 0.6, support: int = 4, rounds: int = 3
                   ) -> tuple[DataFrame, DataFrame]:
    """Scores the graph of patterns and instances: (pattern, kind, conf) and (instance, kind, score).

    A pattern's confidence in a kind is the sum of its distinct instances' scores over their number, a
    seed counting 1 and an unknown token its score so far; it is accepted from ``confidence`` on if that
    sum is ``support`` or more. An unknown instance's score is 1 - product of (1 - conf) over the
    accepted patterns it occurs in. Each round is two joins along the distinct edges, so that a string
    copied into many documents counts once.
    """
    seed = written(seeds.select("pattern", "instance", "kind").distinct(), "seeds")
    # only patterns that seeds occur in can ever be accepted first; others join in over known instances
    token = written(unknown.select("pattern", "instance").distinct(), "tokens")
    n = seed.select("pattern", "instance").unionByName(token).distinct().groupBy("pattern").agg(F.count("*").alias("n"))
    n = written(n, "degrees")
    hits = seed.groupBy("pattern", "kind").agg(F.count("*").cast("double").alias("f"))
    scores = None
    for r in range(rounds):
        f = hits
        if scores is not None:
            f = f.unionByName(token.join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("f")))
        best = (f.groupBy("pattern", "kind").agg(F.sum("f").alias("f")).filter(F.col("f") >= support)
                .join(n, "pattern").withColumn("conf", F.col("f") / F.col("n")).filter(F.col("conf") >= confidence)
                .groupBy("pattern").agg(F.max(F.struct("conf", (-F.col("kind")).alias("k"))).alias("b"))
                .select("pattern", (-F.col("b.k")).alias("kind"), F.least(F.col("b.conf"), F.lit(0.999)).alias("conf")))
        best = written(best, "patterns")
        scores = written(token.join(best, "pattern").groupBy("instance", "kind")
                         .agg((1 - F.exp(F.sum(F.log1p(-F.col("conf"))))).alias("score")), "scores")
    return best, scores


def find_personal_data(docs: DataFrame, confidence: float = 0.6, support: int = 4, rounds: int = 3) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, base and spans as arrays of (start, kind, end) with
    offsets in code points, end exclusive.

    Spans of the fixed forms are the seeds. The two words before a seed, or the one where the text has no
    two, are a lexical pattern; identifier-like tokens and numbers of several groups of digits outside all seeds that follow accepted patterns are added with the kind of
    the pattern. Documents are read once; what follows works on spans and tokens only.

    Nulls and empty texts have no spans. Rows with a null doc_id are judged like others; rows that
    repeat one are told apart by their text. Other columns are not read; empty tables give no rows.
    """
    src = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = src.select("doc_id", text_key().alias("k"), base_spans().alias("base"), _tokens().alias("all"))
    rows = rows.withColumn("free", F.expr("filter(all, t -> t.end > t.start and not exists(base, b -> b.start < t.end and t.start < b.end))"))
    rows = written(rows.select("doc_id", "k", "base", _candidates(F.col("free")).alias("free")), "spans")
    seeds, unknown = _edges(rows, "base"), _edges(rows, "free")
    patterns, scores = learn_patterns(seeds, unknown, confidence, support, rounds)
    good = scores.filter(F.col("score") >= confidence).select("instance", "kind")
    added = (unknown.drop("kind").join(patterns.select("pattern", "kind"), "pattern").join(good, ["instance", "kind"])
             .groupBy(F.col("doc_id").alias("_d"), F.col("k").alias("_k"))
             .agg(F.collect_set(F.struct("start", "kind", "end")).alias("added")))
    plain = F.expr("transform(base, b -> struct(b.start as start, b.kind as kind, b.end as end))")
    out = rows.join(added, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("k") == F.col("_k")), "left")
    return out.select("doc_id", plain.alias("base"),
                      F.array_sort(F.concat(plain, F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>")))).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns of ``find_personal_data``."""
    count = [F.expr(f"cast(size(filter(base, b -> b.kind = {k})) as long)").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *count, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
