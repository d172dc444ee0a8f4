"""Run reports as text lines: format, frame, parse, average.

A report is a DataFrame ``(run, line_no, line)``; files are only an
interchange format (see ``textlab.sources``).  Numbers shown with two
decimals are ratios of counts rounded half-to-even on exact integers, the
same in Spark and in the DuckDB oracle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from textlab.functions.formats import float_text, report_slice

# fixed values: the report layout (class name column 12 wide, then 4 columns
# of 1 space + 9 wide; 2 decimals; rows 2/3 classes, 5 accuracy, 9 MCC)
HEADERS = ["precision", "recall", "f1-score", "support"]
HEADER_LINE = "{:>12s} ".format("") + "".join(" {:>9}".format(h) for h in HEADERS)
RULE_LINE = "============================"
STAR_LINE = "********************************"
# slices of the per-run report, as Python [start:stop]
CLASS_SLICES = {"precision": (19, 23), "recall": (29, 33), "f1": (39, 43)}
ACCURACY_SLICE = (39, 44)
MCC_OFFSET = 5


def _cell(x: str) -> str:
    # ' {:>9}' : one space, right-aligned to 9, never truncated
    return f"lpad({x}, CAST(greatest(10, length({x}) + 1) AS INT), ' ')"


def ratio_parts() -> dict[str, tuple[str, str]]:
    """name -> (numerator SQL, denominator SQL) over columns tp, fp, fn, tn for
    every two-decimal number of the report (zero denominators read as 0/1 in
    the averages, as the per-class value is then 0)."""
    s0, s1, n = "(tn + fp)", "(tp + fn)", "(tp + fp + fn + tn)"
    fr = {
        "p0": ("tn", "(tn + fn)"), "r0": ("tn", "(tn + fp)"), "f0": ("2 * tn", "(2 * tn + fn + fp)"),
        "p1": ("tp", "(tp + fp)"), "r1": ("tp", "(tp + fn)"), "f1": ("2 * tp", "(2 * tp + fp + fn)"),
    }

    def nz(k):
        a, b = fr[k]
        return (f"(CASE WHEN {b} = 0 THEN 0 ELSE {a} END)", f"(CASE WHEN {b} = 0 THEN 1 ELSE {b} END)")

    out = dict(fr)
    out["acc"] = ("tp + tn", n)
    for m in ("p", "r", "f"):
        (a0, b0), (a1, b1) = nz(m + "0"), nz(m + "1")
        out["m" + m] = (f"{a0} * {b1} + {a1} * {b0}", f"2 * {b0} * {b1}")
        out["w" + m] = (f"{a0} * {b1} * {s0} + {a1} * {b0} * {s1}", f"{b0} * {b1} * {n}")
    return out


def _lines_sql(text: dict[str, str]) -> list[tuple[int, str]]:
    s0, s1, n = "(tn + fp)", "(tp + fn)", "(tp + fp + fn + tn)"

    def row(name, p, r, f, sup):
        return (f"lpad('{name}', 12, ' ') || ' ' || {_cell(text[p])} || {_cell(text[r])} || "
                f"{_cell(text[f])} || {_cell(f'CAST({sup} AS STRING)')}")

    blank = "'" + " " * 10 + "'"
    acc = (f"lpad('accuracy', 12, ' ') || ' ' || {blank} || {blank} || {_cell(text['acc'])} || "
           f"{_cell(f'CAST({n} AS STRING)')}")
    return [
        (0, f"'{HEADER_LINE}'"), (1, "''"),
        (2, row("0", "p0", "r0", "f0", s0)), (3, row("1", "p1", "r1", "f1", s1)),
        (4, "''"), (5, acc),
        (6, row("macro avg", "mp", "mr", "mf", n)), (7, row("weighted avg", "wp", "wr", "wf", n)),
    ]


def _report_text_columns(cm: DataFrame, keep: list[str]) -> DataFrame:
    """Spark: the same numbers in stages (num/den, quotient, rounded value, text),
    so no expression is repeated inside another."""
    parts = ratio_parts()
    big = "DECIMAL(38,0)"
    d = cm.select(*keep, *[F.col(c).cast(big).alias(c) for c in ("tp", "fp", "fn", "tn")])
    d = d.select("*", *[F.expr(f"CAST(({a}) AS {big}) * 100").alias(f"_n_{k}") for k, (a, _) in parts.items()],
                 *[F.expr(f"CAST(({b}) AS {big})").alias(f"_d_{k}") for k, (_, b) in parts.items()])
    d = d.select("*", *[F.expr(f"CASE WHEN _d_{k} = 0 THEN CAST(0 AS {big}) ELSE _n_{k} div _d_{k} END")
                        .alias(f"_q_{k}") for k in parts])
    d = d.select("*", *[F.expr(f"_n_{k} - _q_{k} * _d_{k}").alias(f"_r_{k}") for k in parts])
    d = d.select("*", *[F.expr(f"CASE WHEN _d_{k} = 0 THEN CAST(0 AS {big}) WHEN 2 * _r_{k} > _d_{k} OR "
                               f"(2 * _r_{k} = _d_{k} AND _q_{k} % 2 = 1) THEN _q_{k} + 1 ELSE _q_{k} END")
                        .alias(f"_v_{k}") for k in parts])
    d = d.select(*keep, "tp", "fp", "fn", "tn",
                 *[F.expr(f"CAST(_v_{k} div 100 AS STRING) || '.' || lpad(CAST(_v_{k} % 100 AS STRING), 2, '0')")
                   .alias(f"_t_{k}") for k in parts])
    return d


MCC_SQL = ("(CASE WHEN tp + fp = 0 OR tp + fn = 0 OR tn + fp = 0 OR tn + fn = 0 THEN 0.0 ELSE "
           "(CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) "
           "* (tn + fp) * (tn + fn)) END)")


def format_report(cm: DataFrame, run: str = "run") -> DataFrame:
    """Per-run report lines ``(run, line_no, line)`` from confusion counts:
    the classification table, a rule, and ``MCC: x`` with all its digits, so that averages over text lose nothing."""
    staged = _report_text_columns(cm, [run])
    rows = _lines_sql({k: f"_t_{k}" for k in ratio_parts()})
    lines = [F.struct(F.lit(i).alias("line_no"), F.expr(e).alias("line")) for i, e in rows]
    lines.append(F.struct(F.lit(8).alias("line_no"), F.lit(RULE_LINE).alias("line")))
    lines.append(F.struct(F.lit(9).alias("line_no"),
                          F.concat(F.lit("MCC: "), float_text(F.expr(MCC_SQL))).alias("line")))
    return staged.select(run, F.inline(F.array(*lines)))


def format_appended_report(cm: DataFrame, run: str = "run") -> DataFrame:
    """The append-mode layout: 12-line records ``MCC``, table, stars; line
    numbers run over all records in run order."""
    staged = _report_text_columns(cm, [run])
    rows = _lines_sql({k: f"_t_{k}" for k in ratio_parts()})
    lines = [F.struct(F.lit(0).alias("off"),
                      F.concat(F.lit("MCC: "), F.format_string("%.3f", F.expr(MCC_SQL))).alias("line"))]
    lines += [F.struct(F.lit(i + 1).alias("off"), F.expr(e).alias("line")) for i, e in rows]
    lines += [F.struct(F.lit(9).alias("off"), F.lit("").alias("line")),
              F.struct(F.lit(10).alias("off"), F.lit(STAR_LINE).alias("line")),
              F.struct(F.lit(11).alias("off"), F.lit("").alias("line"))]
    out = staged.select(run, F.inline(F.array(*lines)))
    # record index = rank of the run; the run table has one row per run
    rank = cm.select(run, F.dense_rank().over(Window.orderBy(run)).alias("_rec"))
    return (out.join(rank, run).select(run, ((F.col("_rec") - 1) * 12 + F.col("off")).alias("line_no"), "line"))


def frame_report_records(lines: DataFrame, size: int = 12, line_no: str = "line_no") -> DataFrame:
    """Cut a line stream into fixed-size records: (record, offset) for every line."""
    return lines.withColumn("record", F.expr(f"cast({line_no} as bigint) div {int(size)}")) \
        .withColumn("offset", F.col(line_no) % size)


def parse_report(lines: DataFrame, run: str = "run", line_no: str = "line_no") -> DataFrame:
    """Per-run numbers from report text at the fixed offsets: per class
    precision / recall / F1 (lines 2, 3), accuracy (line 5), MCC (line 9)."""
    ln = F.col(line_no)
    vals = []
    for cls, ln_no in (("0", 2), ("1", 3)):
        for m, (a, b) in CLASS_SLICES.items():
            vals.append(F.max(F.when(ln == ln_no, report_slice("line", a, b))).alias(f"{m}_{cls}"))
    vals.append(F.max(F.when(ln == 5, report_slice("line", *ACCURACY_SLICE))).alias("accuracy"))
    vals.append(F.max(F.when(ln == 9, F.trim(F.expr(f"substring(line, {MCC_OFFSET + 1})")).try_cast("double")))
                .alias("mcc"))
    return lines.groupBy(run).agg(*vals)


def parse_appended_report(framed: DataFrame) -> DataFrame:
    """Numbers from framed append-mode records: MCC at offset 0, classes at 3/4, accuracy at 6."""
    o = F.col("offset")
    vals = [F.max(F.when(o == 0, F.trim(F.expr(f"substring(line, {MCC_OFFSET + 1})")).try_cast("double"))).alias("mcc")]
    for cls, off in (("0", 3), ("1", 4)):
        for m, (a, b) in CLASS_SLICES.items():
            vals.append(F.max(F.when(o == off, report_slice("line", a, b))).alias(f"{m}_{cls}"))
    vals.append(F.max(F.when(o == 6, report_slice("line", 39, 43))).alias("accuracy"))
    return framed.groupBy("record").agg(*vals)


def average_parsed(parsed: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """Mean of every parsed number over runs (what the reference prints)."""
    cols = metrics or [c for c in parsed.columns if c not in ("run", "record")]
    return parsed.agg(*[F.avg(c).alias(c) for c in cols], F.count("*").cast("bigint").alias("n_runs"))


# fixed values: the blocks of averages that end a collected report and an appended one; {} stands for a number
AVERAGES = (
    "The average results to be reported",
    "negative class:",
    "precesion: {precision_0}, recall: {recall_0}, f1_score: {f1_0}",
    "positive class:",
    "precesion: {precision_1}, recall: {recall_1}, f1_score: {f1_1}",
    "Accuracy: {accuracy}",
    "MCC : {mcc}",
)
FINAL_RESULTS = (
    "******************Final Results**********************",
    "N: {precision_0},{recall_0},{f1_0}",
    "P: {precision_1},{recall_1},{f1_1}",
    "Acc:{accuracy}",
    "MCC: {mcc}",
)


def format_averages(parsed: DataFrame, order: str = "run", layout: Sequence[str] = AVERAGES) -> DataFrame:
    """(line_no, line): ``layout`` filled with the means of the parsed numbers over runs. The numbers are added up in the order of
    ``order``, as a loop over the reports does, so that all digits agree; there is one row per run to add up. Without
    reports there are no lines."""
    import re
    names = [c for c in parsed.columns if c != order]
    rows = parsed.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *names))).alias("_r")).filter(F.size("_r") > 0)

    def mean(c):
        return F.aggregate("_r", F.lit(0.0), lambda s, r: s + r[c]) / F.size("_r")

    rows = rows.select(*[float_text(mean(c)).alias(c) for c in names])
    lines = []
    for i, text in enumerate(layout):
        parts = [F.lit(t) if k % 2 == 0 else F.col(t) for k, t in enumerate(re.split(r"\{(\w+)\}", text))]
        lines.append(F.struct(F.lit(i).alias("line_no"), F.concat(*parts).alias("line")))
    return rows.select(F.inline(F.array(*lines)))


def concat_reports(lines: DataFrame, epoch_log: DataFrame | None = None, run: str = "run", line_no: str = "line_no",
                   title: str = "Results on test set", averages: bool = False) -> DataFrame:
    """All runs in one ordered document ``(doc_line, run, section, line)``: a title, then per run an
    ``EXP i`` header, its report, its epoch log (lines in the same layout) and a separator; with ``averages``, the
    averages over the reports at the end. ``doc_line``
    counts from 0 over the document; runs are in text order."""
    from textlab.operators.indexing import assign_row_id

    def part(df: DataFrame, section: int, no, line, end: bool = False) -> DataFrame:
        return df.select(F.lit(end).alias("_end"), F.col(run).cast("string").alias(run), F.lit(section).alias("section"), no.cast("bigint").alias(line_no),
                         line.alias("line"))

    runs = lines.select(run).distinct()
    name = F.col(run).cast("string")
    parts = [part(runs.agg(F.min(name).alias(run)).filter(F.col(run).isNotNull()), 0, F.lit(0), F.lit(title)),
             part(runs, 1, F.lit(0), F.concat(F.lit("EXP "), name, F.lit(" "))), part(lines, 2, F.col(line_no), F.col("line")),
             part(runs, 4, F.lit(0), F.lit("-" * 64))]
    if epoch_log is not None:
        parts.append(part(epoch_log, 3, F.col(line_no), F.col("line")))
    if averages:
        mean = format_averages(parse_report(lines, run, line_no), run).withColumn(run, F.lit(None).cast("string"))
        parts.append(part(mean, 5, F.col("line_no"), F.col("line"), end=True))
    doc = parts[0]
    for p in parts[1:]:
        doc = doc.unionByName(p)
    return assign_row_id(doc, ["_end", run, "section", line_no], "doc_line").select("doc_line", run, "section", "line")
