"""Candidate works of a reference from a catalogue table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from bibspark.functions.text import normalize_doi, normalize_text
from bibspark.operators.keys import join_same, spread
from bibspark.staging import staged

KEY = ["bib_id", "index"]
#: Works, and sets of words, that meet in one task.
BLOCK_WORKS, BLOCK_REFERENCES = 20_000, 20_000
#: Works that a word meets one by one; a word of more works is common. It changes no result.
RARE = 20


def lookup(references: DataFrame, catalogue: DataFrame, doi: str = "doi", out: str = "found") -> DataFrame:
    """References with the catalogue's work of the same DOI, or null; of several the least id's."""
    works = catalogue.select(normalize_doi(F.col("work.doi")).alias("_of_doi"), F.col("work").alias(out)).where("_of_doi is not null")
    first = works.groupBy("_of_doi").agg(F.min_by(out, F.struct(f"{out}.id", F.to_json(out))).alias(out))
    by = [c for c, kind in references.dtypes if not kind.startswith(("map", "variant"))]
    return references.withColumn("_doi_key", spread(doi, *by)).join(first, F.col("_doi_key") == F.col("_of_doi"), "left").drop("_of_doi", "_doi_key")


def _ranked(words: pa.Array, places: np.ndarray, weights: np.ndarray, asked: pa.ListArray, works: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each list of words its best works: (list, work, weight) by weight, then by place.

    ``words`` and ``places`` are an inverted index: the works (by place) that hold each word,
    sorted by word; a work's weight is the sum over the words that it shares.
    """
    firsts = np.nonzero(np.append(True, pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)))[0] if len(words) else np.zeros(0, np.int64)
    ends = np.append(firsts, len(words))
    known = pc.index_in(asked.flatten(), value_set=words.take(pa.array(firsts)))
    known = pc.fill_null(known, -1).to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(asked), 0).to_numpy(zero_copy_only=False)
    at, out = 0, ([], [], [])
    for i, n in enumerate(sizes):
        own = known[at : at + n]
        at += n
        hits = [(ends[k], ends[k + 1]) for k in own[own >= 0]]
        if not hits:
            continue
        place = np.concatenate([places[a:b] for a, b in hits])
        # each work's words in one order, so that equal sets have equal sums
        total = np.bincount(place, np.concatenate([weights[a:b] for a, b in hits]), works)
        found = np.nonzero(total)[0]
        score = np.round(total[found], 9)
        if len(found) > limit:
            near = score >= np.partition(score, -limit)[-limit]
            found, score = found[near], score[near]
        best = np.lexsort((found, -score))[:limit]
        for column, values in zip(out, (np.full(len(best), i), found[best], score[best]), strict=True):
            column.append(values)
    return tuple(np.concatenate(c) if c else np.zeros(0) for c in out)


def _shared(asked: Column, held: Column) -> Column:
    """The weight of the words of ``asked`` (word and weight, by word) that are in ``held``."""
    hits = F.filter(asked, lambda w: F.array_contains(held, w["word"]))
    return F.round(F.aggregate(hits, F.lit(0.0), lambda total, w: total + w["weight"]), 9)


def _sets(rows: DataFrame, row: str, spreads: DataFrame) -> DataFrame:
    """Rows with ``known`` (their catalogue words with weights, by word), ``common`` and ``rare`` words."""
    words = rows.select(row, F.explode("words").alias("word"))
    often, seldom = (spreads.where(c).select("word", "weight", F.lit(c == "rare").alias("rare")) for c in ("not rare", "rare"))
    # a common word has many rows and there are few of them; the others have few works each
    found = words.join(often, "word").unionByName(words.join(seldom, "word"))
    found = found.groupBy(F.col(row).alias("_row")).agg(F.array_sort(F.collect_list(F.struct("word", "weight", "rare"))).alias("known"))
    named = lambda rare: F.transform(F.filter("known", lambda w: w["rare"] == F.lit(rare)), lambda w: w["word"])
    found = found.withColumns({"common": named(False), "rare": named(True)})
    return rows.drop("words").join(found, F.col(row) == F.col("_row")).drop("_row")


def _meet(asked: DataFrame, index: DataFrame, limit: int) -> DataFrame:
    """``set``, ``id`` and ``weight``: the best few works for each different set of words.

    Works and sets meet in blocks: each pair of blocks is one task with its own inverted index,
    which keeps the best few works of each set, so rows grow with the number of blocks and not
    with the length of a word's list.
    """
    n_works = max(1, -(-index.count() // BLOCK_WORKS))
    n_asked = max(1, -(-asked.count() // BLOCK_REFERENCES))
    index = index.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_works)).cast("int"))
    index = index.select("id", F.explode("known").alias("w"), "block").select("id", "w.word", "w.weight", "block")
    index = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("set"), F.lit(n_asked)).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_works - 1))))

    def best(cell: tuple, sets: pa.Table, own: pa.Table) -> pa.Table:
        own = own.sort_by([("word", "ascending"), ("id", "ascending")])
        ids = pc.unique(own["id"]).combine_chunks() if isinstance(pc.unique(own["id"]), pa.ChunkedArray) else pc.unique(own["id"])
        ids = ids.take(pc.array_sort_indices(ids))
        places = pc.index_in(own["id"], value_set=ids).to_numpy().astype(np.int64)
        lists = sets["set"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        words = own["word"].combine_chunks()
        words = words.chunk(0) if isinstance(words, pa.ChunkedArray) and words.num_chunks else words
        row, work, score = _ranked(words, places, own["weight"].to_numpy(), lists, len(ids), limit) if own.num_rows else (np.zeros(0),) * 3
        return pa.table({"set": sets["set"].take(pa.array(row.astype(np.int64))), "id": ids.take(pa.array(work.astype(np.int64))), "weight": pa.array(score.astype(float))})

    schema = StructType([asked.schema["set"], StructField("id", index.schema["id"].dataType), *StructType.fromDDL("weight double").fields])
    cell = ["part", "block"]
    hits = asked.groupBy(*cell).cogroup(index.groupBy(*cell)).applyInArrow(best, schema)
    best_few = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("less"), "id"))), 1, limit)
    return hits.groupBy("set").agg(best_few.alias("best"))


def search(references: DataFrame, catalogue: DataFrame, limit: int = 5) -> DataFrame:
    """bib_id, index, pos (from 1) and work: the ``limit`` works that share the rarest words.

    A shared title word counts 1 / ln(n + 1.5), n being the number of works with the word; ties
    go to the lesser work id. All words count. Of works that share an id one is searched.

    A work that shares a word of RARE works at most with a reference is a hit by that word. Any
    other one has the weight of the common words alone, and is only among the best if it is so
    by these; so references and works of equal sets of common words are alike, ``limit`` works
    stand for each set, and the best of these are found once for each set of a reference.
    """
    works = catalogue.select(F.col("work.id").alias("id"), normalize_text(F.col("work.title")).alias("title")).groupBy("id").agg(F.min("title").alias("title"))
    split = lambda text: F.array_sort(F.array_distinct(F.filter(F.split(text, " "), lambda w: w != "")))
    works = staged(works.select(F.monotonically_increasing_id().alias("row"), "id", split(F.col("title")).alias("words")), "search-titles")
    asked = references.select(*KEY, split(normalize_text(F.col("raw"))).alias("words")).where(F.size("words") > 0)
    asked = staged(asked.withColumn("row", F.monotonically_increasing_id()), "search-references")
    counts = works.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    spreads = staged(counts.select("word", (1 / F.log(F.col("n") + 1.5)).alias("weight"), (F.col("n") <= RARE).alias("rare")), "search-words")
    works = staged(_sets(works, "row", spreads), "search-works")
    asked = staged(_sets(asked, "row", spreads), "search-asked")

    # by rare words: of several that a work shares, the least one meets it
    mine = asked.select(*KEY, "known", F.col("rare").alias("_own"), F.explode("rare").alias("word"))
    posts = works.select("id", F.col("known.word").alias("held"), F.col("rare").alias("_rare"), F.explode("rare").alias("_word"))
    first = F.array_min(F.array_intersect("_own", "_rare")) == F.col("word")
    by_rare = mine.join(posts, (F.col("word") == F.col("_word")) & first).select(*KEY, "known", "id", "held")

    # by sets of common words
    has_common, nth = F.size("common") > 0, F.row_number().over(Window.partitionBy("common").orderBy("id"))
    index = works.where(has_common).withColumn("nth", nth).where(F.col("nth") <= limit)
    index = staged(index.select("id", F.filter("known", lambda w: ~w["rare"]).alias("known"), F.col("known.word").alias("held")), "search-index")
    sets = staged(asked.where(has_common).select(F.col("common").alias("set")).distinct(), "search-sets")
    met = _meet(sets, index, limit).select("set", F.explode("best.id").alias("id"))
    met = staged(join_same(met, index.select("id", "held"), ["id"]), "search-met")
    by_sets = asked.join(met, F.col("common") == F.col("set")).select(*KEY, "known", "id", "held")

    hits = by_rare.unionByName(by_sets).select(*KEY, F.struct((-_shared(F.col("known"), F.col("held"))).alias("less"), "id").alias("hit"))
    top = hits.groupBy(*KEY).agg(F.slice(F.array_sort(F.collect_set("hit")), 1, limit).alias("top"))
    top = top.select(*KEY, F.posexplode("top").alias("at", "hit")).select(*KEY, (F.col("at") + 1).alias("pos"), F.col("hit.id").alias("id"))
    full = catalogue.select(F.col("work.id").alias("id"), "work").groupBy("id").agg(F.min_by("work", F.to_json("work")).alias("work"))
    return join_same(top, full, ["id"]).select(*KEY, "pos", "work")
