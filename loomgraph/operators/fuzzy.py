"""Nearest names by a weighted ratio or by edits, exactly, without letting every name meet every id.

By a weighted ratio: blocks of names go down trees of ids by their beginnings (``subsequences``). A first look that follows the
likeliest beginnings gives scores that the answer must reach; then all beginnings are left that can't reach them.

By edits: ids are indexed by their different pairs of characters (grams). An insertion or deletion takes at most two grams from a name,
so an id within some number of them holds all but twice as many of the name's grams: it must hold one of any set that is one
larger. Where that rules out nothing, a name meets the ids of its group, dealt over SALTS tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import subsequences
from loomgraph.operators.blocks import runs
from loomgraph.plans.shared import cut

GRAM = 2
#: Rarest grams of a name that find its first candidates, and how many of these are scored.
FIRST_GRAMS = 8
FIRST = 24
SALTS = 16
#: Names and ids of a group that meet in one task, and blocks of a group's names at most; tasks at most; pairs passed on at once.
NAMES_IN_BLOCK, NAME_BLOCKS, IDS_IN_BLOCK, MOST_CELLS, PAIRS_AT_ONCE = 500, 8, 100_000, 2000, 5000
# Weights of the weighted ratio, and how many times longer a text must be to be matched in parts.
TOKEN_WEIGHT, PART_WEIGHT, SMALL_PART_WEIGHT = 0.95, 0.9, 0.6
PARTS_FROM, SMALL_PARTS_FROM = 1.5, 8.0


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of its table at a time in the bits of one integer."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    every = (1 << len(a)) - 1
    open_ = every
    for c in b:
        hit = open_ & places.get(c, 0)
        open_ = (open_ + hit | open_ - hit) & every
    return len(a) - open_.bit_count()


def ratio(a: str, b: str) -> float:
    """Characters in common over all, of 100."""
    return 200.0 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def part_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a part of the longer one that is as long, or shorter at either end."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0 if long else 100.0
    n = len(short)
    windows = {long[max(0, k) : k + n] for k in range(1 - n, len(long))}
    best = max(ratio(short, w) for w in windows)
    if len(a) == len(b):  # either may be the one that is cut
        best = max(best, *(ratio(long, short[max(0, k) : k + n]) for k in range(1 - n, n)))
    return best


def token_ratio(a: str, b: str, parts: bool = False) -> float:
    """The better of two ratios: of the words in order, and of what the sets of words have beside the shared ones."""
    x, y = a.split(), b.split()
    compare = part_ratio if parts else ratio
    best = compare(" ".join(sorted(x)), " ".join(sorted(y)))
    shared, left, right = sorted(set(x) & set(y)), sorted(set(x) - set(y)), sorted(set(y) - set(x))
    if not x or not y:
        return 0.0
    if shared and (parts or not left or not right):
        return 100.0
    one, two, both = " ".join(left), " ".join(right), " ".join(shared)
    if parts:
        return max(best, part_ratio(one, two))
    gap = bool(both)
    lengths = len(both) + gap + len(one), len(both) + gap + len(two)
    apart = len(one) + len(two) - 2 * common(one, two)
    best = max(best, 100.0 * (1 - apart / sum(lengths)))
    for n in lengths if shared else ():
        best = max(best, 200.0 * len(both) / (len(both) + n))
    return best


def weighted_ratio(a: str, b: str) -> float:
    """The best of the plain ratio and the weighted ones of words and of parts; 0 if either text is empty."""
    if not a or not b:
        return 0.0
    times = max(len(a), len(b)) / min(len(a), len(b))
    whole = ratio(a, b)
    if times < PARTS_FROM:
        return max(whole, TOKEN_WEIGHT * token_ratio(a, b))
    weight = PART_WEIGHT if times <= SMALL_PARTS_FROM else SMALL_PART_WEIGHT
    return max(whole, weight * part_ratio(a, b), TOKEN_WEIGHT * weight * token_ratio(a, b, parts=True))


def grams(text: Column) -> Column:
    """The different runs of GRAM characters."""
    last = F.length(text) - GRAM + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda k: F.substring(text, k, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def indexed(known: DataFrame) -> DataFrame:
    """(same, gram, id) of the ids (same, id)."""
    return known.select("same", "id", F.explode(grams(F.col("id"))).alias("gram"))


def rarest_first(asked: DataFrame, index: DataFrame) -> DataFrame:
    """(name, same, g): each name's grams with the number of ids that hold them, the rarest first."""
    held = index.groupBy("same", "gram").agg(F.count("*").alias("n"))
    each = asked.select("name", "same", F.explode_outer(grams(F.col("name"))).alias("gram")).join(held, ["same", "gram"], "left")
    listed = F.sort_array(F.collect_list(F.when(F.col("gram").isNotNull(), F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))))
    return each.groupBy("name", "same").agg(listed.alias("g"))


def holding(names: DataFrame, some: Column, index: DataFrame) -> DataFrame:
    """(name, same, id, shared): ids that hold any of the grams ``some`` of a name, and how many of them."""
    each = names.select("name", "same", F.explode(some).alias("x")).select("name", "same", F.col("x.gram").alias("gram"))
    return each.join(index, ["same", "gram"]).groupBy("name", "same", "id").agg(F.count("*").alias("shared"))


def meeting(names: DataFrame, known: DataFrame) -> DataFrame:
    """Each name with all ids of its group; a large group is dealt over SALTS tasks."""
    spread = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return spread.join(known.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")), ["same", "salt"]).drop("salt")


def scored(pairs: DataFrame, least: float) -> DataFrame:
    """(name, same, id, score) of the pairs that reach ``least`` and their name's ``bound``."""
    names = ["name", "same", "id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(4)]
            rows = [(n, s, i, x) for n, s, i, b in zip(*columns) if (x := round(weighted_ratio(n, i), 6)) >= max(least, b)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.float64()))], names=names)

    return pairs.select("name", "same", "id", "bound").mapInArrow(run, "name string, same string, id string, score double")


def cells(names: DataFrame, known: DataFrame) -> DataFrame:
    """(same, i, j, few, text, bound): names (with a bound) and ids of a group dealt to blocks, each sent to all blocks of the other side.

    A group has at most NAME_BLOCKS blocks of names, so ids are copied as often at most; blocks of ids have about IDS_IN_BLOCK.
    """
    count = lambda side, n: side.groupBy("same").agg(F.count("*").alias(n))
    a = F.least(F.ceil(F.col("n") / NAMES_IN_BLOCK), F.lit(NAME_BLOCKS)).cast("int").alias("a")
    sizes = cut(count(names, "n").join(count(known, "m"), "same").select("same", a, F.ceil(F.col("m") / IDS_IN_BLOCK).cast("int").alias("b")))
    tasks = min(MOST_CELLS, sizes.agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 1)
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = names.join(sizes, "same").select("same", own("name", "a").alias("i"), all_of("b").alias("j"), F.lit(True).alias("few"), F.col("name").alias("text"), F.col("bound").cast("double"))
    right = known.join(sizes, "same").select("same", all_of("a").alias("i"), own("id", "b").alias("j"), F.lit(False), F.col("id"), F.lit(0.0))
    # few rows make much work, so the number of tasks is given
    return left.union(right).repartition(tasks, "same", "i", "j").sortWithinPartitions("same", "i", "j")


def likely(names: DataFrame, known: DataFrame, k: int, least: float, followed: int | None = None) -> DataFrame:
    """(name, same, id, bound): the pairs of names (name, same, bound) and ids of a group that may be among the ``k`` best and reach the bound.

    With ``followed``, pairs of a first look only. Subsequences in common bound the ratios of texts of one word each; a text of several
    words, or an id that is too long for a tree, meets all.
    """
    columns = ["name", "same", "id", "bound"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in runs(batches, ["same", "i", "j"]):
            same, few = cell["same"].iloc[0], cell["few"].to_numpy()
            texts, bounds = cell["text"].to_numpy(), cell["bound"].to_numpy()
            worded = lambda x: any(c.isspace() for c in x)
            ids = sorted(x for x in texts[~few] if x or least <= 0)
            plain = [x for x in ids if x and len(x) <= subsequences.LONGEST and "\0" not in x and not worded(x)]
            held = set(plain)
            odd = [x for x in ids if x not in held]
            asked = sorted(((n, b) for n, b in zip(texts[few], bounds[few]) if n or least <= 0), key=lambda x: len(x[0]))
            single = [x for x in asked if x[0] and not worded(x[0])]
            if followed is None:
                met = set(n for n, _ in single)
                for name, bound in asked:
                    whole = odd if name in met else ids
                    for at in range(0, len(whole), PAIRS_AT_ONCE):
                        part = whole[at : at + PAIRS_AT_ONCE]
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array([same] * len(part)), pa.array(part), pa.array([bound] * len(part))], names=columns)
            if not plain:
                continue
            tree, every = subsequences.Tree(plain), np.array(plain, object)
            at = 0
            while at < len(single):
                batch = single[at : at + subsequences.NAMES]
                batch = batch[: max(1, subsequences.NAMES * subsequences.WORD // len(batch[-1][0]))]
                at += len(batch)
                of, limits = np.array([n for n, _ in batch], object), np.array([b for _, b in batch])
                for x, y in subsequences.search(tree, of.tolist(), np.maximum(limits, least), k, PARTS_FROM, PART_WEIGHT, followed):
                    yield pa.RecordBatch.from_arrays([pa.array(of[x], pa.string()), pa.array([same] * len(x), pa.string()), pa.array(every[y], pa.string()), pa.array(limits[x], pa.float64())], names=columns)

    return cells(names, known).mapInArrow(run, "name string, same string, id string, bound double")


def nearest(asked: DataFrame, known: DataFrame, k: int, least: float) -> DataFrame:
    """(name, same, id, score, place): up to ``k`` ids of the name's group with the best weighted ratio, ties by id.

    ``asked`` is (name, same), ``known`` (id, same), both texts; what is null is left out, and what repeats counts once. Exact:
    no id that belongs to the answer is passed over.
    """
    names = cut(asked.select("name", "same").where("name is not null and same is not null").distinct())
    known = cut(known.select("id", "same").where("id is not null and same is not null").distinct())
    first = likely(names.withColumn("bound", F.lit(float(least))), known, k, least, subsequences.FOLLOWED)
    reached = scored(first, least).groupBy("name", "same").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    bound = F.coalesce(F.get("s", F.lit(k - 1)), F.lit(float(least)))
    bounded = cut(names.join(reached, ["name", "same"], "left").select("name", "same", bound.alias("bound")))
    best = Window.partitionBy("name", "same").orderBy(F.desc("score"), "id")
    return scored(cut(likely(bounded, known, k, least)), least).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def fewest_edits(asked: DataFrame, known: DataFrame, tie: Column, name: str = "name") -> DataFrame:
    """(name, id, edits): the id with the fewest edits of each name, then the least ``tie`` (of the columns ``name`` and id), then by id.

    The column of names in ``asked`` is called ``name``, that of ``known`` id. An edit takes at most GRAM grams, so once a first candidate bounds the edits, a name meets
    only ids that hold one of its rarest grams; a name that is too short for that meets all ids whose length allows it.
    """
    everywhere = F.lit("").alias("same")
    asked = asked.select(F.col(name).alias("name"), everywhere).where("name is not null").distinct()
    known = cut(known.select("id", everywhere).where("id is not null").distinct())
    index = cut(indexed(known))
    names = cut(rarest_first(asked, index))
    first = holding(names, F.slice(F.filter("g", lambda x: x["n"] > 0), 1, FIRST_GRAMS), index)
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("shared"), "id"))
    near = first.withColumn("place", place).where(F.col("place") <= FIRST).groupBy("name").agg(F.min(F.levenshtein("name", "id")).alias("most"))
    # without any candidate there are at most as many edits as the longer text has characters
    bounded = cut(names.join(near, "name", "left").withColumn("open", F.col("most").isNull() | (F.size("g") < GRAM * F.col("most") + 1)))
    alike = holding(bounded.where("not open"), F.slice("g", F.lit(1), (GRAM * F.col("most") + 1).cast("int")), index).select("name", "id")
    others = meeting(bounded.where("open").select("name", "same", "most"), known).where(F.col("most").isNull() | (F.abs(F.length("name") - F.length("id")) <= F.col("most")))
    pairs = alike.union(others.select("name", "id")).withColumnRenamed("name", name)
    best = F.min(F.struct(F.levenshtein(name, "id").alias("edits"), tie.alias("tie"), F.col("id")))
    return pairs.groupBy(name).agg(best.alias("b")).select(name, "b.id", "b.edits")


def containing(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(name, id): the ids that contain a name. Such an id holds all of the name's grams, so a name meets only those with its rarest one.

    ``asked`` is (name), ``known`` (id). A name without a gram meets all ids; nulls are left out, and what repeats counts once.
    """
    everywhere = F.lit("").alias("same")
    asked = asked.select("name", everywhere).where("name is not null").distinct()
    known = cut(known.select("id", everywhere).where("id is not null").distinct())
    index = cut(indexed(known))
    names = cut(rarest_first(asked, index))
    found = holding(names.where(F.size("g") > 0), F.slice("g", F.lit(1), F.lit(1)), index).select("name", "id")
    short = meeting(names.where(F.size("g") == 0).select("name", "same"), known).select("name", "id")
    return found.union(short).where(F.contains("id", F.col("name")))
