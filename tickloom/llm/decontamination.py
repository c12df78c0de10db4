"""Benchmark decontamination by spaced seeds, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import materialise, read, text_column

#: 1: a word that counts; 0: one that may differ. The first pattern passes over replaced words that
#: repeat every 4, 5, 6, 7 or 8 words, the second those that repeat every 3.
MASKS = ("1110111", "11011011")
#: Items of fewer words have no seed; down to this many they are found by all their words.
SHORTEST = 4
#: Seeds of the benchmark, and texts with a hit, that are broadcast at most; beyond, a shuffle joins them.
BROADCAST_SEEDS, BROADCAST_TEXTS = 200_000, 1_000_000


def words(text):
    """Words (runs outside space and 0x09-0x0D) with A-Z in lower case."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def let(value, then):
    """``then`` of a value that is computed once, however often ``then`` uses it."""
    return F.transform(F.array(value), then)[0]


def _seeds(h, masks):
    """The number of word hashes, and the hashes of every position under each mask, one mask after the other."""
    def under(mask):
        last = F.size(h) - len(mask)
        held = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.lit(mask), *(h[i + j] for j, c in enumerate(mask) if c == "1")))
        return F.when(last >= 0, held).otherwise(F.array().cast("array<bigint>"))

    return F.struct(F.size(h).alias("n"), F.concat(*(under(m) for m in masks)).alias("s"))


def _position(n, at, masks):
    """Word position of the ``at``-th seed of a text of ``n`` words."""
    out, before = None, F.lit(0)
    for mask in masks:
        count = F.greatest(n - len(mask) + 1, F.lit(0))
        here = at - before
        out = F.when(here < count, here) if out is None else out.when(here < count, here)
        before = before + count
    return out


def seeds(rows: DataFrame, keys: list[str], masks=MASKS) -> DataFrame:
    """``keys..., seed, pos`` for each seed of each row's ``words``."""
    made = rows.select(*keys, F.explode(F.array(let(F.transform("words", lambda w: F.xxhash64(w)), lambda h: _seeds(h, masks)))).alias("made"))
    made = made.select(*keys, F.col("made.n").alias("n"), F.col("made.s").alias("s"))
    return made.select(*keys, "n", F.posexplode("s").alias("at", "seed")).select(*keys, "seed", _position(F.col("n"), F.col("at"), masks).alias("pos"))


def _best(same, penalty: int):
    """The best run of a diagonal (1 for an equal word, less ``penalty`` for another): its end, length and equal words."""
    names = ("score", "n", "eq", "best", "best_end", "best_n", "best_eq")

    def step(s, x):
        score = s["score"] + F.when(x["same"], 1).otherwise(-penalty)
        more, n, eq = score > 0, s["n"] + 1, s["eq"] + x["same"].cast("int")
        better = score > s["best"]
        values = (F.greatest(score, F.lit(0)), F.when(more, n).otherwise(0), F.when(more, eq).otherwise(0), F.greatest(score, s["best"]), F.when(better, x["at"]).otherwise(s["best_end"]), F.when(better, n).otherwise(s["best_n"]), F.when(better, eq).otherwise(s["best_eq"]))
        return F.struct(*(v.alias(k) for k, v in zip(names, values, strict=True)))

    numbered = F.transform(same, lambda x, i: F.struct(x.alias("same"), (i + 1).alias("at")))
    return F.aggregate(numbered, F.struct(*(F.lit(0).alias(k) for k in names)), step)


def _item_seeds(items: DataFrame, masks) -> tuple[DataFrame, list[str]]:
    """Seeds of the items, and the masks that texts need: the given ones, and for shorter items one of all their words."""
    shortest = min(map(len, masks))
    short = sorted(r.n for r in items.where((F.size("words") < shortest) & (F.size("words") >= SHORTEST)).select(F.size("words").alias("n")).distinct().collect())
    made = seeds(items.where(F.size("words") >= shortest), ["item"], masks)
    for n in short:
        made = made.unionByName(seeds(items.where(F.size("words") == n), ["item"], ["1" * n]))
    return made.withColumnRenamed("pos", "item_pos").distinct().join(items.select("item", F.size("words").alias("item_size")), "item"), [*masks, *("1" * n for n in short)]


def overlaps(docs: DataFrame, benchmark: DataFrame, masks=MASKS, least: int = 13, share: float = 0.6) -> DataFrame:
    """``doc_id, text_hash, item_id, start, n_words, n_same``: verified overlaps of texts with benchmark items.

    Hashes of the words that each mask keeps are joined between items and texts. Around a hit, item and
    text are laid side by side at that distance; the run with the most equal words, less one for each
    different one, is an overlap if a ``share`` of its words is equal, and ``least`` words or that share
    of the item's. Items shorter than any mask have to be there with all their words; those of under
    ``SHORTEST`` words, which texts hold by chance, only count as texts of these words and no others.
    The best overlap of each text and item is given; ``start`` is the word of the text that it begins at.

    ``text_hash`` (``xxhash64`` of the text) tells rows with one id apart; repeated rows give one
    overlap. Null and empty texts and items have none; very long texts are taken whole; null ids stay;
    empty tables give no rows; other columns are ignored. Of equal runs the shorter one is given, then
    the sooner. Hashes that many texts hold meet only items that hold them too.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text")).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    items = materialise(benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(text_column(benchmark)).alias("words")).where(F.size("words") > 0).distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    made, needed = _item_seeds(items, masks)
    item_seeds = materialise(made, "item-seeds")
    held = F.broadcast(item_seeds) if item_seeds.count() <= BROADCAST_SEEDS else item_seeds
    hits = seeds(texts.select("doc_id", "text_hash", words(F.col("text")).alias("words")), ["doc_id", "text_hash"], needed).join(held, "seed")
    # each text with what to lay beside it: it is read once more, and only its words there go on
    hits = hits.select("doc_id", "text_hash", F.struct("item", "item_size", (F.col("pos") - F.col("item_pos")).alias("shift")).alias("hit")).groupBy("doc_id", "text_hash").agg(F.collect_set("hit").alias("hits"))
    hits = materialise(hits.withColumnRenamed("doc_id", "hit_id").withColumnRenamed("text_hash", "hit_hash"), "hits")
    met = F.broadcast(hits) if hits.count() <= BROADCAST_TEXTS else hits
    laid = texts.join(met, texts["doc_id"].eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")))
    beside = let(words(F.col("text")), lambda w: F.transform("hits", lambda h: F.struct(h["item"].alias("item"), h["shift"].alias("shift"), F.slice(w, F.greatest(h["shift"], F.lit(0)) + 1, h["item_size"]).alias("part"))))
    laid = laid.select("doc_id", "text_hash", F.explode(beside).alias("laid")).select("doc_id", "text_hash", "laid.*").distinct()
    item_rows = items.select("item", "item_id", F.col("words").alias("item_words"))
    laid = laid.join(F.broadcast(item_rows) if held is not item_seeds else item_rows, "item")
    item_size, first = F.size("item_words"), F.greatest(F.col("shift"), F.lit(0))
    same = F.transform(F.slice("item_words", F.greatest(-F.col("shift"), F.lit(0)) + 1, F.least(item_size, F.size("part"))), lambda w, i: w == F.col("part")[i])
    laid = laid.select("doc_id", "text_hash", "item_id", first.alias("first"), item_size.alias("item_size"), F.explode(F.array(let(same, lambda s: _best(s, 1)))).alias("best"))
    best = laid.select("doc_id", "text_hash", "item_id", "item_size", (F.col("first") + F.col("best.best_end") - F.col("best.best_n")).alias("start"), F.col("best.best_n").alias("n_words"), F.col("best.best_eq").alias("n_same"))
    enough = F.when(F.col("item_size") < min(map(len, masks)), F.col("item_size")).otherwise(F.least(F.lit(least), F.ceil(share * F.col("item_size"))))
    found = best.where((F.col("n_same") >= enough) & (F.col("n_same") >= share * F.col("n_words")))
    tiny = items.where(F.size("words") < SHORTEST).select("item_id", "words")
    alone = texts.where(F.length("text") > 0).select("doc_id", "text_hash", words(F.col("text")).alias("words")).where((F.size("words") > 0) & (F.size("words") < SHORTEST)).join(tiny, "words")
    found = found.drop("item_size").unionByName(alone.select("doc_id", "text_hash", "item_id", F.lit(0).alias("start"), F.size("words").alias("n_words"), F.size("words").alias("n_same")))
    top = found.groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct("n_same", (-F.col("n_words")).alias("fewer"), (-F.col("start")).alias("sooner"))).alias("top"))
    return top.select("doc_id", "text_hash", "item_id", (-F.col("top.sooner")).cast("long").alias("start"), (-F.col("top.fewer")).cast("long").alias("n_words"), F.col("top.n_same").cast("long").alias("n_same"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item, null and empty texts among them."""
    bad = overlaps(docs, benchmark, **options).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    bad = materialise(bad, "contaminated")
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["bad_id"]) & (F.xxhash64(text_column(docs)) == bad["bad_hash"]), "left_anti")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_hash")
