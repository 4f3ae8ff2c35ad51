"""Benchmark decontamination over a positional inverted index.

The index is a table of postings (row, position, term) of those training tokens that the
test items use; it is written once to the shared folder. A phrase's candidates come from
the postings of its rarest term; they are intersected with the offset-adjusted postings of
its second rarest, and what is left with those of all further terms. Frequent words are
therefore read only for rows that hold two rarer words of a phrase in their places.

DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_kept, few, id_and_text, keep, without

# Fixed value: words after lower-casing A-Z are runs of characters outside these.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(column) -> F.Column:
    """The words of a text; none for null. Text of one byte a character takes the faster lower()."""
    ascii_only = F.length(column) == F.octet_length(column)
    low = F.when(ascii_only, F.lower(column)).otherwise(F.translate(column, _UPPER, _LOWER))
    return F.coalesce(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def item_windows(items: DataFrame, width: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, win, terms): each item's windows; ``win`` is the same for the same words."""
    w = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col).cast("string")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (width - 1)))
    return w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, width))).alias("terms")).select("item_id", F.concat_ws(" ", "terms").alias("win"), "terms").distinct()


def term_numbers(words: DataFrame) -> DataFrame:
    """(word, term): a number from 0 on for each distinct word, unique whatever the partitions; null words have none."""
    return words.where("word is not null").distinct().select("word", F.monotonically_increasing_id().alias("term"))


def build_index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (rid, doc_id, pos, term) of the tokens listed in ``terms`` (word, term).

    Each row also has a posting of term -1 at the position behind its last word, so rows
    without any listed word are in the index too, with their number of words. Null texts
    have no words; repeated rows and null ids get rows of their own; further columns are
    ignored; an empty table gives an empty index.
    """
    src = id_and_text(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("rid"), "doc_id", words(F.col("text")).alias("w"))
    # the empty word can't occur in a text: it marks the end
    tokens = src.select("rid", "doc_id", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "word"))
    listed = terms.select("word", "term").unionByName(terms.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(-1).cast("long").alias("term")))
    return tokens.join(few(listed), "word").select("rid", "doc_id", "pos", "term")


def ranked_windows(windows: DataFrame, terms: DataFrame, counts: DataFrame) -> DataFrame:
    """(wid, off, term, rank, n): the windows' terms, the rarest in the training rows first."""
    each = windows.select("wid", F.posexplode("terms").alias("off", "word")).join(few(terms), "word").join(few(counts), "term", "left")
    order = Window.partitionBy("wid").orderBy(F.coalesce("freq", F.lit(0)), "off")
    return each.select("wid", "off", "term", F.coalesce("freq", F.lit(0)).alias("freq")).withColumn("rank", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("wid")))


def phrase_matches(index: DataFrame, ranked: DataFrame) -> DataFrame:
    """(rid, doc_id, start, wid, n): where all terms of a window follow each other in a row.

    Every place counts, overlapping ones too; repeated rows are told apart by ``rid``; an
    empty index or no windows give no rows.
    """
    first = ranked.where("rank = 1 and freq > 0").select("wid", "off", "term", "n")
    second = ranked.where("rank = 2").select("wid", F.col("off").alias("off2"), F.col("term").alias("term2"))
    both = first.join(second, "wid", "left")
    found = index.join(few(both), "term").select("rid", "doc_id", (F.col("pos") - F.col("off")).alias("start"), "wid", "n", "off2", "term2").where("start >= 0")
    # one-word windows are found by that
    single = found.where("term2 is null").select("rid", "doc_id", "start", "wid", "n")
    asked = found.where("term2 is not null").select("rid", "doc_id", "start", "wid", "n", (F.col("start") + F.col("off2")).alias("pos"), F.col("term2").alias("term"))
    seconds = index.join(few(second.select(F.col("term2").alias("term")).distinct()), "term", "left_semi").select("rid", "pos", "term")
    pairs = keep(asked.join(seconds, ["rid", "pos", "term"]).select("rid", "doc_id", "start", "wid", "n"), "pairs")
    rest = ranked.where("rank > 2").select("wid", "off", "term")
    near = index.join(few(pairs.select("rid").distinct()), "rid", "left_semi").select("rid", "pos", "term")
    wanted = pairs.join(few(rest), "wid").select("rid", "doc_id", "start", "wid", "n", (F.col("start") + F.col("off")).alias("pos"), "term")
    full = wanted.join(near, ["rid", "pos", "term"]).groupBy("rid", "doc_id", "start", "wid", "n").agg(F.count("*").alias("c")).where("c = n - 2").drop("c")
    return reduce(DataFrame.unionByName, [single, pairs.where("n = 2"), full])


def proximity_matches(index: DataFrame, ranked: DataFrame, slop: int) -> DataFrame:
    """(rid, wid, pos): where all distinct terms of a window lie within ``slop`` positions of its rarest term's.

    The rarest term's postings are narrowed by those of the second rarest term near them,
    then of the third; only rows that are left are asked for the rest. Positions are cut into
    cells, and each looked-for place asks the two that it reaches into, so joins stay ones of
    equal keys. A place of the rarest term counts once, however often the others occur near
    it; an empty index or no windows give no rows.
    """
    cell = 2 * slop + 1
    once = ranked.groupBy("wid", "term").agg(F.min("rank").alias("rank"))
    once = once.withColumn("nth", F.row_number().over(Window.partitionBy("wid").orderBy("rank"))).withColumn("kinds", F.count("*").over(Window.partitionBy("wid")))
    once = keep(once.select("wid", "term", "nth", "kinds"), "distinct-terms")
    first = once.where("nth = 1").select("wid", "term", "kinds")
    left = index.join(few(first), "term").select("rid", "wid", "kinds", F.col("pos").alias("at"))
    done, kept = [left.where("kinds = 1")], [once]
    spans = F.array_distinct(F.array(*[F.floor((F.col("at") + d) / cell) for d in (-slop, slop)]))
    near = lambda postings: postings.select("rid", "term", "pos", F.floor(F.col("pos") / cell).alias("c"))

    def narrowed(left, terms, postings):
        """Places with the number of distinct terms near them."""
        asked = left.join(few(terms), "wid").withColumn("c", F.explode(spans))
        hit = asked.join(near(postings), ["rid", "term", "c"]).where(F.abs(F.col("pos") - F.col("at")) <= slop)
        return hit.groupBy("rid", "wid", "kinds", "at").agg(F.count_distinct("term").alias("k"))

    for nth in (2, 3):
        terms = once.where(F.col("nth") == nth).select("wid", "term")
        postings = index.join(few(terms.select("term").distinct()), "term", "left_semi")
        left = keep(narrowed(left.where(F.col("kinds") >= nth), terms, postings).drop("k"), "near")
        kept.append(left)
        done.append(left.where(F.col("kinds") == nth))
    many = left.where("kinds > 3")
    postings = index.where("term >= 0").join(few(many.select("rid").distinct()), "rid", "left_semi")
    done.append(narrowed(many, once.where("nth > 3").select("wid", "term"), postings).where("k = kinds - 3"))
    out = keep(reduce(DataFrame.unionByName, [d.select("rid", "wid", F.col("at").alias("pos")) for d in done]), "proximity")
    drop_kept(*kept)
    return out


def prepare(docs: DataFrame, items: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text"):
    """The items' windows, their terms, the written index, and the ranked windows."""
    of_items = keep(item_windows(items, width), "windows")
    numbered = keep(of_items.select("win", "terms").distinct().select(F.monotonically_increasing_id().alias("wid"), "win", "terms"), "windows")
    terms = keep(term_numbers(numbered.select(F.explode("terms").alias("word"))), "terms")
    index = keep(build_index(docs, terms, id_col, text_col), "postings")
    counts = index.where("term >= 0").groupBy("term").agg(F.count("*").alias("freq"))
    ranked = keep(ranked_windows(numbered, terms, counts), "ranked")
    return of_items, numbered, terms, index, ranked


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW, least: int = 2, id_col: str = "doc_id", text_col: str = "text", slop: int | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_items >= least); with ``slop`` also n_near.

    n_near counts the items of which a window's distinct words all lie within ``slop`` words
    of its rarest one's (by all rows; of equally rare ones the first), in any order.

    A word is hit if it lies in an occurrence of a window: ``width`` consecutive words of
    an item, or all words of a shorter one. items_sha256 is the digest of the distinct ids
    of items with occurring windows, sorted as strings and joined by commas (none: of the
    empty string). A null text has no words and no hits; an item without words has no
    windows; an item whose id is null hits words but isn't counted. Repeated rows are kept
    apart; items with the same words all count; further columns are ignored; empty tables
    give an empty result or rows without hits.
    """
    of_items, numbered, terms, index, ranked = prepare(docs, items, width, id_col, text_col)
    found = keep(phrase_matches(index, ranked), "matches")
    hit = found.select("rid", F.explode(F.sequence("start", F.col("start") + F.col("n").cast("int") - 1)).alias("pos")).distinct().groupBy("rid").agg(F.count("*").alias("n_hit"))
    names = numbered.select("wid", "win").join(of_items.select("item_id", "win"), "win").select("wid", "item_id").where("item_id is not null").distinct()
    which = found.select("rid", "wid").distinct().join(few(names), "wid").select("rid", F.col("item_id").cast("string").alias("item")).distinct()
    named = which.groupBy("rid").agg(F.count("*").alias("n_items"), F.concat_ws(",", F.sort_array(F.collect_list("item"))).alias("list"))
    rows = index.where("term = -1").select("rid", "doc_id", F.col("pos").cast("long").alias("n_words"))
    out = rows.join(hit, "rid", "left").join(named, "rid", "left").select(
        "rid", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("list", F.lit("")).cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_items", F.lit(0)) >= least).alias("contaminated"),
    )
    near = []
    if slop is not None:
        # rows are told apart by rid until here, so the count is joined before it goes
        near = [proximity_matches(index, ranked, slop)]
        counts = near[0].select("rid", "wid").distinct().join(few(names), "wid").groupBy("rid").agg(F.count_distinct("item_id").alias("n_near"))
        out = out.join(counts, "rid", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))
    out = keep(out.drop("rid"), "contamination")
    drop_kept(of_items, numbered, terms, index, ranked, found, *near)
    return out


def keep_clean(docs: DataFrame, items: DataFrame, width: int = WINDOW, least: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold windows of fewer than ``least`` items.

    Rows with null texts stay; rows that share an id, or have none, are judged one by one;
    columns of any further name stay as they are; an empty table gives an empty result.
    """

    def leaks(rows):
        got = contamination(rows, items, width, least)
        out = got.where("contaminated").select("doc_id")
        out._reads = [got]
        return out

    return without(docs, id_col, text_col, leaks)
