"""Chat formatting: roles of a transcript's turns by a hidden Markov model, then canonical rendering.

The hidden state is the speaker's role; it stays within a turn and changes between turns. Each line is
observed by its speaker marker ("User:", "### Assistant", "<|system|>" ...), the size of the line and
whether it asks. Viterbi finds the most likely roles. A conversation is never gathered: rows are cut into
blocks of their order; a block's part of a conversation that goes on in other blocks is summed up by
the best scores between its first and last states (max-plus matrices), chains of those matrices fix the
states at the cuts, and each block then decodes its own part. Chains are bounded too: the matrices of GROUP
blocks are joined to one first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textlab.llm.common import text_key, written
from textlab.operators.indexing import assign_row_id

# Roles, and the names that transcripts give their speakers.
ROLES = ("system", "user", "assistant", "tool")
NAMES = {
    "system": ("system", "instruction", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "prompt", "me", "q"),
    "assistant": ("assistant", "ai", "bot", "gpt", "model", "answer", "response", "agent", "a"),
    "tool": ("tool", "function", "observation"),
}
#: observed categories of a line: no marker or one of each role, bits of its length, asks or not
MARKERS, SIZES = 1 + len(ROLES), 12
FEATURES = MARKERS + SIZES + 2
#: rows of a block, and blocks of a group
BLOCK, GROUP = 1024, 1024

_ROLE_OF = {n: i for i, r in enumerate(ROLES) for n in NAMES[r]}
_MARKER = re.compile(r"^[\s#>*<|\[(]{0,8}(" + "|".join(sorted(_ROLE_OF, key=len, reverse=True)) +
                     r")(?:[*|\])>]{0,4}\s?:[*]{0,2}|[|\])>]{1,3})\s*", re.IGNORECASE)


def speaker(line: str) -> tuple[int, str]:
    """0 and the line, or 1 + the role that its marker names and the line without the marker."""
    m = _MARKER.match(line[:64])
    return (1 + _ROLE_OF[m[1].lower()], line[m.end():]) if m else (0, line)


def observe(text: str | None) -> np.ndarray:
    """Counts of the categories over the lines of a turn. A null text has no lines."""
    out = np.zeros(FEATURES, np.int64)
    for i, line in enumerate((text or "").split("\n") if text else ()):
        marker, said = speaker(line) if i == 0 else (0, line)
        out[marker] += 1
        out[MARKERS + min(len(said).bit_length(), SIZES - 1)] += 1
        out[MARKERS + SIZES + said.rstrip().endswith("?")] += 1
    return out


@dataclass(frozen=True)
class Model:
    """Log probabilities: of the first role, of a role after a role, of a category given a role."""

    first: np.ndarray
    after: np.ndarray
    seen: np.ndarray

    @staticmethod
    def of_counts(first: np.ndarray, after: np.ndarray, seen: np.ndarray, prior: float = 0.5) -> "Model":
        def log(x):
            return np.log((x + prior) / (x + prior).sum(axis=-1, keepdims=True))
        groups = np.split(seen, [MARKERS, MARKERS + SIZES], axis=1)
        return Model(log(first), log(after), np.concatenate([log(g) for g in groups], axis=1))

    @staticmethod
    def unlearned() -> "Model":
        """For transcripts without any labelled turn: markers name their role, users and assistants alternate."""
        after = np.array([[0, 8, 2, 0], [0, 1, 8, 1], [0, 8, 1, 1], [0, 1, 8, 1]], float)
        seen = np.ones((len(ROLES), FEATURES))
        seen[:, 0] = 50
        seen[np.arange(len(ROLES)), 1 + np.arange(len(ROLES))] = 200
        seen[1, -1] = 2
        return Model.of_counts(np.array([3, 6, 1, 0], float), after, seen)


def span_scores(emit: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Best score of a part from each state of its first row to each of its last, all emissions included."""
    n = emit.shape[1]
    best = np.full((n, n), -np.inf)
    best[np.arange(n), np.arange(n)] = emit[0]
    for e in emit[1:]:
        best = (best[:, :, None] + after[None]).max(axis=1) + e
    return best


def decode(emit: np.ndarray, after: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Most likely states of consecutive rows, given what the first and the last states score besides."""
    best, back = start + emit[0], []
    for e in emit[1:]:
        step = best[:, None] + after
        back.append(step.argmax(axis=0))
        best = step.max(axis=0) + e
    out = [int((best + end).argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return np.array(out[::-1])


def joined(parts: list[np.ndarray], after: np.ndarray) -> np.ndarray:
    """Span scores of consecutive parts as one."""
    best = parts[0]
    for p in parts[1:]:
        step = (best[:, :, None] + after[None]).max(axis=1)
        best = (step[:, :, None] + p[None]).max(axis=1)
    return best


def chain(parts: list[np.ndarray], after: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """First and last state of each consecutive part, from their span scores and from what the first
    state of all and the last state of all score besides."""
    starts, ends = [], []
    for k, p in enumerate(parts):
        starts.append(start if k == 0 else (ends[-1][:, None] + after).max(axis=0))
        ends.append((starts[-1][:, None] + p).max(axis=0))
    out = []
    for k in range(len(parts) - 1, -1, -1):
        j = int((ends[k] + end).argmax())
        i = int((starts[k] + parts[k][:, j]).argmax())
        out.append((i, j))
        end = after[:, i]
    return out[::-1]


def only(state: int) -> np.ndarray:
    out = np.full(len(ROLES), -np.inf)
    out[state] = 0.0
    return out


def observed(turns: DataFrame) -> DataFrame:
    """Turns in order, with ``row_id`` (dense over all), ``conv`` (the conversation as text) and ``seen``."""
    t = turns.select("conv_id", "turn", "role", "text").withColumn("_k", text_key())
    t = t.withColumn("conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    t = assign_row_id(t, ["conv", "turn", "_k"]).drop("_k")
    kept = [c for c in t.columns]

    def run(batches):
        for batch in batches:
            seen = [observe(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seen, pa.list_(pa.int64()))], names=[*kept, "seen"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in t.schema)
    return written(t.mapInArrow(run, f"{kinds}, seen array<long>"), "turns")


def fit(seen: DataFrame) -> Model:
    """Counts over the turns whose role is one of ROLES: emissions, first roles of conversations, and roles after
    the role of the turn before. What reaches the driver is one row for each (pair of) role(s)."""
    at = {r: i for i, r in enumerate(ROLES)}
    known = seen.filter(F.col("role").isin(*ROLES))
    first, after, emit = np.zeros(len(ROLES)), np.zeros((len(ROLES),) * 2), np.zeros((len(ROLES), FEATURES))
    for r in known.groupBy("role").agg(*[F.sum(F.col("seen")[i]) for i in range(FEATURES)]).collect():
        emit[at[r[0]]] = r[1:]
    if not emit.any():
        return Model.unlearned()
    # rows in their order: the one before is found by its number, of which there is one, whatever the conversation's size
    role = F.when(F.col("role").isin(*ROLES), F.col("role"))
    before = seen.select((F.col("row_id") + 1).alias("_next"), F.col("conv").alias("_c"), role.alias("last"))
    pairs = known.select("row_id", "conv", "role").join(before, F.col("row_id") == F.col("_next"), "left")
    opens = F.coalesce(F.col("_c") != F.col("conv"), F.lit(True))
    for opening, last, role, n in pairs.groupBy(opens.alias("opens"), F.when(~opens, F.col("last")).alias("last"), "role").count().collect():
        if opening:
            first[at[role]] += n
        elif last is not None:
            after[at[last], at[role]] += n
    return Model.of_counts(first, after, emit)


def roles(seen: DataFrame, model: Model, block: int = BLOCK) -> DataFrame:
    """(row_id, state): the most likely role of each turn, by Viterbi over whole conversations."""
    rows = seen.select("row_id", "conv", "seen").withColumn("block", F.expr(f"row_id div {block}"))

    def parts(pdf: pd.DataFrame):
        """Consecutive rows of one conversation within a block, and whether they touch its edges."""
        pdf = pdf.sort_values("row_id")
        conv = pdf["conv"].to_numpy()
        cut = np.flatnonzero(conv[1:] != conv[:-1]) + 1
        ids, emit = pdf["row_id"].to_numpy(), np.stack(pdf["seen"].to_numpy()) @ model.seen.T
        bounds = [0, *cut.tolist(), len(conv)]
        for s, e in zip(bounds[:-1], bounds[1:]):
            yield conv[s], ids[s:e], emit[s:e], s == 0 or e == len(conv)

    def inner(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [(i, decode(e, model.after, model.first, np.zeros(len(ROLES)))) for _, i, e, edge in parts(pdf) if not edge]
        return _states(out)

    def edges(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [(pdf["block"].iloc[0], c, i[0], span_scores(e, model.after).ravel().tolist()) for c, i, e, edge in parts(pdf) if edge]
        return pd.DataFrame(found, columns=["block", "conv", "at", "scores"])

    def square(pdf: pd.DataFrame) -> list[np.ndarray]:
        return [np.reshape(x, (len(ROLES),) * 2) for x in pdf["scores"]]

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        return pd.DataFrame({"conv": pdf["conv"].iloc[:1], "group": pdf["group"].iloc[:1], "scores": [joined(square(pdf), model.after).ravel().tolist()]})

    def between(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("group")
        ends = chain(square(pdf), model.after, model.first, np.zeros(len(ROLES)))
        return pd.DataFrame({"conv": pdf["conv"], "group": pdf["group"], "start": [i for i, _ in ends], "end": [j for _, j in ends]})

    def within(pdf: pd.DataFrame, fixed: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        ends = chain(square(pdf), model.after, only(fixed["start"].iloc[0]), only(fixed["end"].iloc[0]))
        return pd.DataFrame({"block": pdf["block"], "at": pdf["at"], "start": [i for i, _ in ends], "end": [j for _, j in ends]})

    def outer(pdf: pd.DataFrame, fixed: pd.DataFrame) -> pd.DataFrame:
        ends = {a: (i, j) for a, i, j in zip(fixed["at"], fixed["start"], fixed["end"])}
        return _states([(i, decode(e, model.after, only(ends[i[0]][0]), only(ends[i[0]][1]))) for _, i, e, edge in parts(pdf) if edge])

    by_block = rows.groupBy("block")
    cut = by_block.applyInPandas(edges, "block long, conv string, at long, scores array<double>")
    cut = written(cut.withColumn("group", F.expr(f"block div {GROUP}")), "cuts")
    groups = cut.groupBy("conv", "group").applyInPandas(group, "conv string, group long, scores array<double>")
    groups = groups.groupBy("conv").applyInPandas(between, "conv string, group long, start int, end int")
    ends = (cut.groupBy("conv", "group").cogroup(groups.groupBy("conv", "group"))
            .applyInPandas(within, "block long, at long, start int, end int"))
    kind = "row_id long, state int"
    return by_block.applyInPandas(inner, kind).unionByName(by_block.cogroup(written(ends, "ends").groupBy("block")).applyInPandas(outer, kind))


def _states(found: list) -> pd.DataFrame:
    if not found:
        return pd.DataFrame({"row_id": np.zeros(0, np.int64), "state": np.zeros(0, np.int32)})
    return pd.DataFrame({"row_id": np.concatenate([i for i, _ in found]), "state": np.concatenate([s for _, s in found]).astype(np.int32)})


#: a line that some speaker may begin: a name of up to four words, each with a capital, and a colon
_NAMED = re.compile(r"^[ \t]{0,3}([A-Z][\w.'-]{0,19}(?: [A-Z][\w.'-]{0,19}){0,3}):(?:[ \t]+|$)")


def speakers_of(lines: list[str]) -> set[str]:
    """Names that begin two lines or more of a transcript and are not known ones: its own speakers."""
    seen: dict[str, int] = {}
    for line in lines:
        m = _NAMED.match(line)
        if m and not speaker(line)[0]:
            seen[m[1]] = seen.get(m[1], 0) + 1
    return {name for name, n in seen.items() if n > 1}


def turns_of(transcripts: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) from raw transcripts (conv_id, text): a line with a speaker marker
    begins a turn, and so does one with a name that the transcript gives a speaker more than once (it is left out of the text);
    lines without go on with the turn; roles are unknown (null)."""
    src = transcripts.select("conv_id", "text")

    def run(batches):
        for batch in batches:
            out = []
            for conv, text in zip(batch.column("conv_id").to_pylist(), batch.column("text").to_pylist()):
                found: list[list[str]] = []
                lines = text.split("\n") if text else []
                own = speakers_of(lines)
                for line in lines:
                    name = _NAMED.match(line)
                    named = bool(name) and name[1] in own
                    if not found or named or speaker(line)[0]:
                        found.append([])
                    found[-1].append(line[name.end():] if named else line)
                out += [(conv, i, "\n".join(x)) for i, x in enumerate(found)]
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field("conv_id").type), pa.array(cols[1], pa.int64()),
                                              pa.array(cols[2], pa.string())], names=["conv_id", "turn", "text"])

    kind = src.schema["conv_id"].dataType.simpleString()
    return src.mapInArrow(run, f"conv_id {kind}, turn long, text string").withColumn("role", F.lit(None).cast("string"))


#: what begins a marker of the canonical form
_MARK = re.compile(r"<(\\*)\|")


def render(role: str, text: str | None) -> str:
    """A turn in canonical form. Its own speaker marker, blank lines before it and white space after it go; where it holds what would
    begin a marker, a backslash comes between (one more where there are some), so that no text opens or closes a turn."""
    first, _, rest = (text or "").partition("\n")
    marker, said = speaker(first)
    said = re.sub(r"^(?:[^\S\n]*\n)+", "", (said if marker else first) + "\n" + rest).rstrip()
    return f"<|{role}|>\n{_MARK.sub(lambda m: '<' + chr(92) + m[1] + '|', said)}\n<|end|>\n"


def _rendered(states: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = [render(ROLES[state], text) for state, text in zip(batch.column("state").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "turn", "role", "guess")), pa.array(out, pa.string())],
                                             names=["conv_id", "turn", "role", "guess", "rendered"])

    named = states.withColumn("guess", F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.col("state") + 1))
    src = named.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "guess", "state", "text")
    kind = src.schema["conv_id"].dataType.simpleString()
    return src.mapInArrow(run, f"conv_id {kind}, turn long, role string, guess string, rendered string")


def format_chats(turns: DataFrame, learn_from: str = "crc32(conv_id) % 5 <> 0", block: int = BLOCK) -> DataFrame:
    """One row per row of (conv_id, turn, role, text): conv_id, turn, role as given, guess, the role
    recovered without looking at it, and rendered, the turn in canonical form.

    Roles are used for counts only, in conversations where ``learn_from`` holds; where no turn there has a
    known role, markers alone decide. Turns are ordered by number (null first), then by a hash of the
    text. Nulls: rows with a null conv_id are one conversation, a null text is an empty turn, a null or
    other role is no example. Repeated rows are turns of their own. Empty tables give no rows. Other
    columns are not read.
    """
    seen = observed(turns)
    model = fit(seen.withColumn("conv_id", F.col("conv_id").cast("string")).filter(learn_from))
    states = roles(seen, model, block).withColumnRenamed("row_id", "_row")
    return _rendered(seen.join(states, F.col("row_id") == F.col("_row")))
