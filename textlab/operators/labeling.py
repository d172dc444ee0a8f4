"""Label sections by the mentions of their own publication."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from textlab.operators.joins import DEFAULT_BROADCAST_BYTES, broadcast_if_small, measured_bytes
from textlab.session import written


def build_publications(ann: DataFrame, id_col: str = "id", title_col: str = "pub_title",
                       mention_cols: Sequence[str] = ("mention",), order_col: str = "row_no") -> DataFrame:
    """One row per publication: first title seen, first row number, sorted set of mentions.

    Mention columns are named, not positional.  ``collect_set`` is combined
    map-side, so a publication annotated a million times with the same names
    ships only its distinct names through the shuffle.
    """
    names = F.array(*[F.col(c) for c in mention_cols])
    return (ann.groupBy(F.col(id_col).alias("file_id"))
            .agg(F.min_by(F.col(title_col), F.col(order_col)).alias("publication_name"),
                 F.min(order_col).alias("pub_order"),
                 F.array_sort(F.array_compact(F.array_distinct(F.flatten(F.collect_set(names)))))
                 .alias("mentions")))


def count_publications(ann: DataFrame, id_col: str = "id", title_col: str = "pub_title",
                       order_col: str = "row_no") -> DataFrame:
    """Distinct ids, and distinct titles taken from the first row of each id."""
    pubs = build_publications(ann, id_col, title_col, (title_col,), order_col)
    return pubs.agg(F.count("*").alias("n_ids"),
                    F.count_distinct("publication_name").alias("n_titles"))


def _longest_first(matches: Column) -> Column:
    # longest mention first, then the smallest string: a fixed tie rule
    # (the reference keeps whichever match its set iteration met last)
    return F.array_sort(matches, lambda a, b: F.when(F.length(a) > F.length(b), -1)
                        .when(F.length(a) < F.length(b), 1)
                        .when(a < b, -1).when(a > b, 1).otherwise(0))


def join_pub_sections(pubs: DataFrame, sections: DataFrame, key: str = "file_id",
                      max_broadcast_bytes: int | None = None) -> DataFrame:
    """Inner equi-join of sections to their annotated publication.

    The publication side is broadcast when its measured size is under the
    bound, so sections are never shuffled; above it the join shuffles on the
    file id and AQE splits a hot id's sections over several tasks.
    """
    side, _ = broadcast_if_small(pubs, max_broadcast_bytes)
    return sections.join(side, key, "inner")


#: names from which on a publication's sections are read once for all of them, and sections that share one automaton's task
MANY_NAMES, BLOCK_SECTIONS = 64, 50_000


def _automaton_matches(sections: DataFrame, names: DataFrame, key: str, text_col: str, block: int = BLOCK_SECTIONS) -> DataFrame:
    """``sections`` with ``_matches``, the names of their publication that the text contains, in the order of ``names`` (key, mentions).

    Each publication's names become one automaton that reads a section once, however many there are. A publication's sections are
    dealt out in blocks, and its names go to each block, in front of the sections; a task holds one automaton at a time."""
    from collections.abc import Iterator

    import pyarrow as pa

    size = sections.groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    sized, _ = broadcast_if_small(size.select(F.col(key).alias("_key"), "_blocks"))
    same = F.col(key) == F.col("_key")
    rows = sections.join(sized, same).withColumn("_block", F.pmod(F.xxhash64(*sections.columns), F.col("_blocks")).cast("int"))
    rows = rows.select(F.col(key).alias("_key"), "_block", F.lit(1).alias("_kind"), F.lit(None).cast("array<string>").alias("_names"),
                       F.struct(*[F.col(c) for c in sections.columns]).alias("_row"), F.col(text_col).alias("_text"))
    heads = names.join(sized, same).select("_key", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), F.lit(0).alias("_kind"),
                                           F.col("mentions").alias("_names"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.lit(None).cast("string").alias("_text"))
    dealt = heads.unionByName(rows).repartition("_key", "_block").sortWithinPartitions("_key", "_block", "_kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick
        tree, every, blank = None, [], []
        for batch in batches:
            kind, text = batch.column("_kind").to_pylist(), batch.column("_text")
            where, found = [], []
            for i, k in enumerate(kind):
                if k == 0:
                    every = batch.column("_names")[i].as_py()
                    blank = [j for j, m in enumerate(every) if m == ""]
                    tree = ahocorasick.Automaton()
                    for j, m in enumerate(every):
                        if m:
                            tree.add_word(m, j)
                    tree.make_automaton()
                    continue
                t = text[i].as_py()
                hits = set() if t is None else {j for _, j in tree.iter(t)} | set(blank) if len(tree) else set(blank)
                where.append(i)
                found.append([every[j] for j in sorted(hits)])
            yield pa.RecordBatch.from_arrays([batch.column("_row").take(pa.array(where, pa.int64())), pa.array(found, pa.list_(pa.string()))], names=["_row", "_matches"])

    out = dealt.select("_kind", "_names", "_row", "_text").mapInArrow(run, StructType([rows.schema["_row"], StructField("_matches", ArrayType(StringType()))]))
    return out.select("_row.*", "_matches")


def _matched(sections: DataFrame, pubs: DataFrame, text_col: str, max_broadcast_bytes: int | None, key: str = "file_id",
             many: int = MANY_NAMES) -> DataFrame:
    """Sections with their publication's columns, and as ``_matches`` those of its mentions that the text contains.

    Up to ``many`` names are looked for one by one inside the row; the sections of publications with more go through an automaton.
    A stream of sections cannot be dealt out by publication and stays with the former."""
    side, _ = broadcast_if_small(pubs, max_broadcast_bytes)
    if sections.isStreaming:
        many = 1 << 31
    long = F.coalesce(F.size("mentions") > F.lit(many), F.lit(False))
    few = sections.join(side.filter(~long), key, "inner")
    few = few.withColumn("_matches", F.filter("mentions", lambda m: F.contains(F.col(text_col), m))).drop("mentions")
    names = side.filter(long)
    if names.isEmpty():
        return few
    rest = sections.join(names.drop("mentions"), key, "inner")
    return few.unionByName(_automaton_matches(rest, names.select(key, "mentions"), key, text_col))


def label_sections(sections: DataFrame, pubs: DataFrame, text_col: str = "section_txt",
                   negative: str = "None", keep_matches: bool = False,
                   max_broadcast_bytes: int | None = None) -> DataFrame:
    """Exactly one row per section: label 1 and the chosen mention when the text
    contains any mention of its publication, else label 0 and ``negative``."""
    j = _matched(sections, pubs, text_col, max_broadcast_bytes)
    out = (j.withColumn("dataset", F.coalesce(F.try_element_at(_longest_first(F.col("_matches")), F.lit(1)),
                                              F.lit(negative)))
           .withColumn("label", (F.size("_matches") > 0).cast("int")))
    return out.withColumnRenamed("_matches", "matches") if keep_matches else out.drop("_matches")


def match_mentions(sections: DataFrame, pubs: DataFrame, text_col: str = "section_txt",
                   max_broadcast_bytes: int | None = None) -> DataFrame:
    """All (section, mention) pairs where the section's text contains a mention
    of its own publication.  Matching runs inside each section row over its
    publication's names; no pair is formed that does not match."""
    j = _matched(sections, pubs, text_col, max_broadcast_bytes)
    return j.select("*", F.explode("_matches").alias("mention")).drop("_matches")


def interior_tokens(text: Column) -> Column:
    """Distinct interior whitespace tokens of a passage.

    When the passage occurs in a document, each interior token (one with
    whitespace on both sides inside the passage) is also a whole
    whitespace-delimited token of the document, so any is an exact blocking key.
    """
    toks = F.split(text, r"\s+", -1)
    inner = F.slice(toks, 2, F.greatest(F.size(toks) - 2, F.lit(0)))
    return F.array_distinct(F.filter(inner, lambda t: F.length(t) > 0))


def _grams(token: Column, sizes: Sequence[int]) -> Column:
    """Distinct character runs of the given sizes."""
    def of(n):
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(token), F.lit(1))), lambda i: i + (n - 1) <= F.length(token))
        return F.transform(starts, lambda i: F.substring(token, i, F.lit(n)))
    return F.array_distinct(F.concat(*[of(n) for n in sizes]))


def contain_pairs(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text",
                  item_key: str = "item_id", item_text: str = "text",
                  max_broadcast_bytes: int | None = None) -> DataFrame:
    """All (document, item) pairs where the document contains the item's text,
    for a corpus-wide dictionary of passages.

    Blocking instead of a nested loop, by equi-joins on tokens.  A passage with
    interior tokens is keyed by the one that the fewest documents hold: the documents' tokens that are
    interior to some passage are written once, counted, and met by the keys.  A
    shorter one (one or two words) can sit inside longer words: its first word
    meets the corpus's distinct tokens by a run of up to three characters, and
    the tokens that contain it are its keys; without such passages no run is made.  Candidates are (document, item)
    keys only; texts meet them once, to be verified with ``contains``.  A
    passage without any word is compared with every document, as its result is.
    """
    it = items.select(F.col(item_key).alias("item_id"), F.col(item_text).alias("item_text")).filter("item_text is not null")
    it = it.withColumn("inner", interior_tokens(F.col("item_text")))
    first_word = F.get(F.filter(F.split("item_text", r"\s+", -1), lambda t: F.length(t) > 0), 0)
    it = written(it.withColumn("word", F.when(F.size("inner") == 0, first_word)).withColumn("n", F.length("word")), "items")
    longer, sizes, blanks = it.agg(F.count_if(F.size("inner") > 0), F.collect_set(F.least("n", F.lit(3))), F.count_if((F.size("inner") == 0) & F.col("word").isNull())).first()
    # words, keys and texts of the passages are all parts of these rows, so one measure holds for each of them
    limit = DEFAULT_BROADCAST_BYTES if max_broadcast_bytes is None else max_broadcast_bytes
    part = F.broadcast if measured_bytes(it) <= limit else (lambda df: df)
    d = docs.select(F.col(doc_key).alias("doc_id"), F.col(doc_text).alias("doc_text"))
    toks = d.select("doc_id", F.explode(F.array_distinct(F.split("doc_text", r"\s+", -1))).alias("token"))
    found = []
    if longer:
        inner = it.select("item_id", F.xxhash64("item_text").alias("which"), F.size("inner").alias("need"), F.explode("inner").alias("token"))
        hits = written(toks.join(part(inner.select("token").distinct()), "token", "left_semi"), "hits")
        df = hits.groupBy("token").agg(F.count("*").alias("df"))
        # a passage one of whose words no document holds occurs nowhere
        keyed = (inner.join(df, "token").groupBy("item_id", "which", "need").agg(F.min(F.struct("df", "token")).alias("k"), F.count("*").alias("found"))
                 .filter("found >= need").select("item_id", F.col("k.token").alias("token")))
        found.append(hits.join(part(keyed), "token").select("doc_id", "item_id"))
    if sizes:
        short = it.filter("word is not null").select("item_id", "word", F.substring("word", 1, 3).alias("gram"))
        grams = toks.select("token").distinct().select("token", F.explode(_grams(F.col("token"), sorted(sizes))).alias("gram"))
        inside = grams.join(part(short), "gram").filter(F.contains("token", F.col("word"))).select("item_id", "token")
        keys, _ = broadcast_if_small(inside, max_broadcast_bytes)
        found.append(toks.join(keys, "token").select("doc_id", "item_id"))
    pairs = d.select("doc_id", F.lit(None).cast(it.schema["item_id"].dataType).alias("item_id")).limit(0)
    if found:
        cand, _ = broadcast_if_small(reduce(DataFrame.unionByName, found).distinct(), max_broadcast_bytes)
        pairs = (d.join(cand, "doc_id").join(part(it.select("item_id", "item_text")), "item_id")
                 .filter(F.contains("doc_text", F.col("item_text"))).select("doc_id", "item_id"))
    if not blanks:
        return pairs
    blank = it.filter("size(inner) = 0 and word is null").agg(F.collect_set(F.struct("item_id", "item_text")).alias("b")).scalar()
    every = d.withColumn("blanks", blank).select("doc_id", F.explode(F.filter("blanks", lambda x: F.contains(F.col("doc_text"), x["item_text"]))).alias("b"))
    return pairs.unionByName(every.select("doc_id", F.col("b.item_id").alias("item_id")))
